"""Vector best-fit packing of token sequences.

A bin has three capacities: tokens, documents and attention cost (the sum of squared piece lengths). Pieces are dealt
over shards of about ``SHARD`` pieces by a hash, longest first within a shard; each goes to the open bin that can take it
under every capacity and scores best, by the norm of what would be left (``norm``) or by the weighted dot product of its
demand with what is free (``dot``). A shard leaves a few bins that more pieces could have filled: bins under ``FULL`` of
their tokens are taken apart again, and the pieces of all shards' are dealt and packed once more, until one shard holds
what is left or its pieces no longer halve. Tokens are encoded word by word, each distinct word of a batch once.

Defined results: a null or empty text is the separator alone; repeated documents are packed each for itself; ties in
length are broken by id and piece, ties in score by the older bin; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from functools import reduce
from itertools import compress
from operator import not_
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import texts, written

LENGTH = 2048
SEPARATOR = 0
SHARD = 6_000
DOCUMENTS = LENGTH  # a piece has a token at least: these two refuse a bin only where a caller asks for less
ATTENTION = LENGTH * LENGTH
WEIGHTS = (1.0, 1.0, 1.0)  # of tokens, documents and attention in the score
FULL = 0.95
KNOWN_WORDS = 600_000
ENDS = frozenset((b".", b",", b";", b":", b"!", b"?"))


class WordEncoder:
    """Ids of texts, as arrays. No token crosses white space, so each distinct word is encoded once and remembered.

    A Python worker keeps its encoders over its tasks; of the words it remembers two generations of ``KNOWN_WORDS``. The
    tokenizer lower-cases, and splits a final mark from the ASCII letter or digit before it, which the memory makes use of.
    A text with ``<|`` in it may hold special tokens and is encoded as it is.
    """

    held: ClassVar[dict[tuple, WordEncoder]] = {}

    @classmethod
    def of(cls, path: str, special_as_text: bool = False) -> WordEncoder:
        key = path, special_as_text
        if key not in cls.held:
            cls.held[key] = cls(*key)
        return cls.held[key]

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.ids: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        (self.bar,) = self.tokenizer.encode("|", add_special_tokens=False).ids

    def _direct(self, bodies: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([b.decode() for b in bodies], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of words without a bar, encoded as one text with bars between them."""
        found = np.array(self.tokenizer.encode(b" | ".join(words).decode(), add_special_tokens=False).ids, self.kind)
        ends = np.append(np.flatnonzero(found == self.bar), len(found)).tolist()
        starts = [0, *(e + 1 for e in ends[:-1])]
        return [found[a:b].tobytes() for a, b in zip(starts, ends)]

    def _learn(self, words: set[bytes]) -> None:
        if len(self.ids) > KNOWN_WORDS:
            self.ids, self.older = {}, self.ids
        known, older, ends, new = self.ids, self.older, {}, set()
        for word in words:
            if word in older:
                known[word] = older[word]
            elif word[-1:] in ENDS and word[-2:-1].isalnum():
                ends[word] = word[:-1]
                new.add(word[:-1])
                new.add(word[-1:])
            else:
                new.add(word)
        for word in older.keys() & new:
            known[word] = older[word]
        new.difference_update(known.keys() & new)
        plain = [w for w in new if b"|" not in w]
        for i in range(0, len(plain), 4096):
            part = plain[i: i + 4096]
            known.update(zip(part, self._words(part)))
        barred = [w for w in new if b"|" in w]
        known.update(zip(barred, self._direct(barred)))
        for word, stem in ends.items():
            known[word] = known[stem] + known[word[-1:]]

    def encode(self, bodies: list[bytes]) -> list[np.ndarray]:
        found, unknown = [], set()
        for body in bodies:
            if b"<|" in body:
                found.append((None, self._direct([body]), ()))
                continue
            words = body.lower().split()
            ids = list(map(self.ids.get, words))
            holes = list(compress(range(len(words)), map(not_, ids)))
            unknown.update(words[i] for i in holes)
            found.append((words, ids, holes))
        self._learn(unknown)
        for words, ids, holes in found:
            for i in holes:
                ids[i] = self.ids[words[i]]
        return [np.frombuffer(b"".join(ids), self.kind) for _, ids, _ in found]


def groups_of(items: list, size: int = 200):
    return (items[i: i + size] for i in range(0, len(items), size))


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, text: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``, and with ``with_ids`` the ids themselves."""
    def run(batches):
        encoder = WordEncoder.of(tokenizer)
        for batch in batches:
            names, bodies = batch.column("doc_id").to_pylist(), texts(batch, text)
            for part in groups_of(list(range(len(names)))):
                rows = []
                for name, ids in zip((names[i] for i in part), encoder.encode([bodies[i] for i in part])):
                    tokens = np.append(ids, SEPARATOR).astype("<u4")
                    for number, start in enumerate(range(0, len(tokens), length)):
                        piece = tokens[start: start + length]
                        rows.append((name, number, start, len(piece), zlib.crc32(piece.tobytes()), piece))
                *columns, cut = zip(*rows)
                arrays = [pa.array(c, t) for c, t in zip(
                    columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                if with_ids:
                    arrays.append(pa.array([c.astype(np.int64) for c in cut], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names_of)

    names_of = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacities, weights=WEIGHTS, by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces come longest first."""
    full = np.array(capacities, float)
    scale = np.asarray(weights, float) / full
    least = lengths[-1] if len(lengths) else 0
    free = np.empty((len(lengths), 3))
    open_bins = np.empty(0, np.int64)
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        demand = np.array([n, 1.0, float(n) * n])
        if (demand > full).any():
            raise ValueError(f"a piece of {n} tokens exceeds the capacities {tuple(capacities)}")
        room = free[open_bins]
        fits = np.flatnonzero((room >= demand).all(axis=1))
        if fits.size:
            left = room[fits] - demand
            score = (-((left * scale) ** 2).sum(axis=1) if by == "norm" else (room[fits] * scale) @ (demand * scale))
            chosen = open_bins[fits[int(np.argmax(score))]]
        else:
            chosen, made = made, made + 1
            free[chosen] = full
            open_bins = np.append(open_bins, chosen)
        bins[i], offsets[i] = chosen, int(full[0] - free[chosen, 0])
        free[chosen] -= demand
        if free[chosen, 0] < least or free[chosen, 1] < 1:
            open_bins = open_bins[open_bins != chosen]
    return bins, offsets


def pack(cut: DataFrame, length: int = LENGTH, max_documents: int = DOCUMENTS, max_attention: float = ATTENTION,
         weights=WEIGHTS, by: str = "norm", shard_pieces: int = SHARD, full: float = FULL) -> DataFrame:
    """``cut`` (a written table of pieces) with ``sequence_id`` and ``offset``; its column ``row``, a number of each
    piece, deals the pieces over shards, so that equal rows do not meet in one."""
    capacities = length, max_documents, max_attention

    def shards_of(pieces: DataFrame) -> int:
        return max(1, round(pieces.count() / shard_pieces))

    def filled(pieces: DataFrame, shards: int, first_shard: int) -> DataFrame:
        """``pieces`` in bins whose numbers begin at ``first_shard``; ``rest`` marks those of bins that are not ``full``."""
        def fill(shard: pa.Table) -> pa.Table:
            shard = shard.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
            lengths = shard["length"].to_numpy()
            bins, offsets = best_fit(lengths, capacities, weights, by)
            rest = np.bincount(bins, lengths)[bins] < full * length
            first = shard["shard"][0].as_py() + first_shard << 32
            return shard.drop_columns("shard").append_column("sequence_id", pa.array(first + bins)).append_column(
                "offset", pa.array(offsets)).append_column("rest", pa.array(rest))

        added = {"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "rest": F.lit(False)}
        return pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).groupBy("shard").applyInArrow(
            fill, pieces.withColumns(added).schema)

    parts, left, first, shards = [], cut, 0, shards_of(cut)
    while True:
        placed = filled(left, shards, first)
        if shards == 1:
            break
        placed = written(placed, "placed-pieces")
        left = placed.where("rest").drop("sequence_id", "offset", "rest")
        fewer = shards_of(left)
        if fewer > shards // 2:
            break
        parts.append(placed.where("NOT rest"))
        first, shards = first + shards, fewer
    return reduce(DataFrame.unionByName, [*parts, placed]).drop("row", "rest")


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, text: str = "text", **limits) -> DataFrame:
    cut = pieces(docs, tokenizer, length, text).withColumn("row", F.monotonically_increasing_id())
    return pack(written(cut, "pieces"), length, **limits)
