"""Token counts from flat token files.

A token file is nothing but little-endian token ids; a separator id ends each document. Files are cut into blocks that are
read by range and searched for separators as arrays; a running maximum over the blocks of a file hands each block the
place of the last separator before it, and a running sum the number of documents, so documents that cross blocks are
stitched without reading anything twice.

Defined results: an empty document has 0 tokens; tokens behind the last separator of a file are a document that is not
``terminated``; an empty file has no documents; a null text is written as an empty document.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import texts
from sluice.llm.packing import WordEncoder, groups_of

DTYPE = "<u2"
SEPARATOR = 49407  # <|endoftext|>
FILE_TOKENS = 16_000_000
BLOCK_TOKENS = 1_000_000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI."""
    head, mark, rest = path.partition(":/")
    return fs.FileSystem.from_uri(f"{head}:///{rest.lstrip('/')}" if mark and head == "file" else path)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, text: str = "text", separator: int = SEPARATOR,
                 file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes token files below ``folder``, which all executors must share, as it runs; gives ``file, ordinal, doc_id``.

    A file appears under its name when it is complete, so a task that is run again replaces it by the same bytes.
    Special tokens in a text are ordinary text: the separator stands nowhere else.
    """
    def run(batches):
        encoder, part, number = WordEncoder.of(tokenizer, special_as_text=True), TaskContext.get().partitionId(), 0
        held, names, size = [], [], 0

        def flushed():
            store, base = _opened(folder)
            store.create_dir(base)
            name = f"tokens-{part:06d}-{number:04d}.bin"
            hidden = f"{base}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as out:
                for ids in held:
                    out.write(ids.tobytes())
            store.move(hidden, f"{base}/{name}")
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(names)), pa.array(range(len(names)), pa.int64()), pa.array(names, pa.int64())],
                ["file", "ordinal", "doc_id"])

        for batch in batches:
            ids, bodies = batch.column("doc_id").to_pylist(), texts(batch, text)
            for some in groups_of(list(range(len(ids)))):
                for i, tokens in zip(some, encoder.encode([bodies[i] for i in some])):
                    held.append(np.append(tokens, separator).astype(DTYPE))
                    names.append(ids[i])
                    size += len(tokens) + 1
                if size >= file_tokens:
                    yield flushed()
                    held, names, size, number = [], [], 0, number + 1
        if names:
            yield flushed()

    store, base = _opened(folder)
    store.create_dir(base)  # there may be no document at all
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(
        run, "file string, ordinal long, doc_id long")


def blocks(spark: SparkSession, folder: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``path, block, last, ends, tokens``: the separators of each block by their place in the file."""
    width = np.dtype(DTYPE).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    cut = files.select(
        "path", (F.col("length") / width).cast("long").alias("tokens"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / (block_tokens * width))))
        .alias("block"))

    def search(batches):
        for batch in batches:
            for path, tokens, block in zip(*(batch.column(c).to_pylist() for c in ("path", "tokens", "block"))):
                store, name = _opened(path)
                first = block * block_tokens
                with store.open_input_file(name) as source:
                    source.seek(first * width)
                    found = np.frombuffer(source.read(min(block_tokens, tokens - first) * width), DTYPE)
                ends = first + np.flatnonzero(found == separator)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block]), pa.array([tokens]), pa.array([ends], pa.list_(pa.int64()))],
                    ["path", "block", "tokens", "ends"])

    return cut.repartition("path", "block").mapInArrow(
        search, "path string, block long, tokens long, ends array<bigint>")


def count_tokens(spark: SparkSession, folder: str, separator: int = SEPARATOR,
                 block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``file, ordinal, token_start, n_tokens, terminated``: a row per document of each token file below ``folder``."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(-1).cast("long")
    stitched = blocks(spark, folder, separator, block_tokens).withColumns({
        "n": F.size("ends"),
        "last": F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)}).withColumns({
        "documents": F.coalesce(F.sum("n").over(before), F.lit(0)),
        "open": F.coalesce(F.max("last").over(before), none),
        "final": F.lead("block").over(Window.partitionBy("path").orderBy("block")).isNull()})
    end = F.coalesce("last", "open")
    tail = F.when(F.col("final") & (end + 1 < F.col("tokens")), F.array(F.col("tokens"))).otherwise(
        F.array().cast("array<bigint>"))
    rows = stitched.select(
        "path", "documents", "open", "tokens", "ends", F.posexplode(F.concat("ends", tail)).alias("at", "end"))
    start = F.when(F.col("at") == 0, F.col("open")).otherwise(F.get("ends", F.col("at") - 1)) + 1
    return rows.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("documents") + F.col("at")).alias("ordinal"),
        start.alias("token_start"), (F.col("end") - start).alias("n_tokens"), (F.col("end") < F.col("tokens")).alias("terminated"))
