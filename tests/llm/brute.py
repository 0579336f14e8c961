"""The contracts in plain Python, one function each, over lists of (id, text)."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
STRIPPED = " \t\n\x0b\x0c\r"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def licenses(docs):
    for name, text in docs:
        words = ALNUM_WORD.findall(lower(text))
        found = [(i, label) for phrase, label in BASE.items() for i in range(len(words))
                 if words[i: i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in found]
        yield (name, len(words), len(found), min(places, default=None), max(places, default=None),
               ",".join(sorted({label for _, label in found})))


def fingerprint(text):
    words = BLANK_WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(docs, distance=4):
    prints = [fingerprint(text) for _, text in docs]
    known = np.array(sorted(set(prints)), np.uint64)
    root = list(range(len(known)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, fp in enumerate(known):
        for j in np.flatnonzero(np.bitwise_count(known[:i] ^ fp) <= distance).tolist():
            root[find(i)] = find(j)
    at = {int(fp): find(i) for i, fp in enumerate(known)}
    least = defaultdict(list)
    for (name, _), fp in zip(docs, prints):
        if name is not None:
            least[at[fp]].append(name)
    for (name, _), fp in zip(docs, prints):
        yield name, f"{fp:016x}", min(least[at[fp]], default=None)


def covered(starts, width):
    return {i + k for i in starts for k in range(width)}


def quality(docs):
    for name, text in docs:
        text = text or ""
        words = BLANK_WORD.findall(text)
        windows = [tuple(words[i: i + 5]) for i in range(len(words) - 4)]
        counts = Counter(windows)
        filled = [line for line in text.split("\n") if BLANK_WORD.search(line)]
        repeated = len(covered([i for i, w in enumerate(windows) if counts[w] > 1], 5))
        yield (name, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
               len(filled) - len(set(filled)), repeated, len(words) < 10 or 100 * repeated > 20 * len(words))


def lines(docs, least=10):
    split = [(name, (text or "").split("\n")) for name, text in docs]
    key = lambda line: lower(line.strip(STRIPPED))
    counts = Counter(k for _, parts in split for k in {key(p) for p in parts})
    for name, parts in split:
        kept = [p for p in parts if not key(p) or counts[key(p)] < least]
        yield name, len(parts), len(parts) - len(kept), sha("\n".join(kept))


def benchmark_hits(docs, items, window=10):
    wanted = defaultdict(set)
    for item, text in items:
        words = ALNUM_WORD.findall(lower(text))
        for i in range(max(len(words) - window, 0) + 1 if words else 0):
            wanted[tuple(words[i: i + window])].add(str(item))
    sizes = {len(w) for w in wanted}
    for name, text in docs:
        words = ALNUM_WORD.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if tuple(words[i: i + n]) in wanted:
                    hit |= covered([i], n)
                    found |= wanted[tuple(words[i: i + n])]
        yield name, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def pieces(docs, tokenizer, length=2048):
    for name, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for number, start in enumerate(range(0, len(ids), length)):
            part = np.array(ids[start: start + length], "<u4")
            yield name, number, start, len(part), zlib.crc32(part.tobytes())


def passages(docs, window=35):
    split = [(name, BLANK_WORD.findall(text or "")) for name, text in docs]
    counts = Counter(tuple(w[i: i + window]) for _, w in split for i in range(len(w) - window + 1))
    for name, words in split:
        gone = covered([i for i in range(len(words) - window + 1) if counts[tuple(words[i: i + window])] > 1], window)
        yield name, len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def hosts(urls, rules):
    for name, url in urls:
        _, mark, rest = (url or "").partition("://")
        host = re.match(r"[^/?#]*", rest)[0] if mark else ""
        path = re.match(r"[^?#]*", rest[len(host):])[0] if mark else ""
        host = lower(host)
        fits = [(len(d + p), d + p, said) for said, d, p in rules
                if (host == d or host.endswith("." + d)) and path.startswith(p)]
        yield (name, host, path, *(max(fits)[1:] if fits else (None, None)))


def merkle(rows):
    """(doc_id, source, lang, n_chars, text) to (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda row: sha("".join(map(field, row)))

    def climb(digests):
        """The last node and, for every start, its siblings (left, right) level by level."""
        paths, at = [[] for _ in digests], list(range(len(digests)))
        while len(digests) > 1:
            runs = [digests[i: i + 16] for i in range(0, len(digests), 16)]
            for path, i in zip(paths, at):
                run, j = runs[i // 16], i % 16
                path.append(("".join(run[:j]), "".join(run[j + 1:])))
            at, digests = [i // 16 for i in at], [sha("".join(run)) for run in runs]
        return digests[0], paths

    by_source = defaultdict(list)
    for row in rows:
        by_source[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in sources]
    if not trees:
        return
    root, tops = climb([t[0] for t in trees])
    for source, (subroot, paths), top in zip(sources, trees, tops):
        for (_, _, digest, row), path in zip(sorted(by_source[source], key=lambda x: x[:3]), paths):
            touched = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
            end = leaf((*row[:4], lower(row[4]))) if touched else digest
            for left, right in path + top:
                end = sha(left + end + right)
            yield (row[0], digest, subroot, root, sha("".join(a + b for a, b in path + top)), end, end == root)


def jaccard_groups(docs, width=3, part=9, whole=10):
    words = [tuple(BLANK_WORD.findall(lower(t))) for _, t in docs]
    sets = [{w[i: i + width] for i in range(max(1, len(w) - width + 1))} if w else set() for w in words]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            few, many = sorted((len(a), len(sets[j])))
            if a and whole * few >= part * many and whole * len(a & sets[j]) >= part * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(docs):
        if name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    for i, (name, _) in enumerate(docs):
        yield name, len(sets[i]), least.get(find(i))


def phrases(docs, least=30, top=2000):
    """(lang, text) to (lang, rank, phrase, a, l, r, n, score)."""
    counts, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i: i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        frequent = {w: c for w, c in f.items() if c >= least and len(w) > 1}
        held = Counter()
        for w, c in frequent.items():
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    held[w[i: i + k]] = max(held[w[i: i + k]], c)
        rows = []
        for w, a in frequent.items():
            if not 100 * held[w] >= 80 * a:
                score, k = min((2_000_000 * a // (f[w[:k]] + f[w[k:]]), k) for k in range(1, len(w)))
                rows.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            yield lang, rank, phrase.decode(), -a, l, r, n[lang], -score
