"""DuckDB SQL for the queries that SQL can express, written from their contracts."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from sluice.llm.quality_rules import CURRENT, POLICIES, RULES

BLANK = r"[\x20\x09-\x0D]"


def _lower(text: str) -> str:
    return f"translate({text}, '{ascii_uppercase}', '{ascii_lowercase}')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{BLANK}+'), lambda x: x <> '')"


def _alnum_words(text: str) -> str:
    return rf"regexp_extract_all({_lower(f'''coalesce({text}, '')''')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


QUALITY_RULES = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_words('text')} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS filled
  FROM documents),
win AS (
  SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS k
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM (SELECT rid, i, unnest(range(5)) AS o FROM rep) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '{BLANK}+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS BIGINT) AS n_letters,
         CAST(len(filled) AS BIGINT) AS n_lines,
         CAST(len(filled) - len(list_distinct(filled)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT ({' OR '.join(f'({condition})' for name, condition in RULES if name in POLICIES[CURRENT])}) AS kept
FROM m
"""

LINE_DEDUP = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT *, {_lower(f"regexp_replace(line, '^{BLANK}+|{BLANK}+$', '', 'g')")} AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
j AS (SELECT k.rid, k.i, k.line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key),
r AS (SELECT rid, count(*) AS n, count(*) FILTER (gone) AS dropped,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM j GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_lines, CAST(dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256
FROM d JOIN r USING (rid)
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_alnum_words('text')} AS words FROM documents),
b AS (SELECT item_id, {_alnum_words('text')} AS words FROM benchmark),
p AS (
  SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS phrase
  FROM (SELECT item_id, words, least(len(words), 10) AS n, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS i
        FROM b WHERE len(words) > 0)),
w AS (
  SELECT rid, i, n, array_to_string(words[i:i + n - 1], ' ') AS phrase
  FROM (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))),
h AS (SELECT rid, i, n, item_id FROM w JOIN p USING (n, phrase)),
c AS (SELECT rid, count(DISTINCT i + o) AS hit FROM (SELECT rid, i, unnest(range(n)) AS o FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS items, string_agg(name, ',' ORDER BY name) AS names
      FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS name FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words('text')} AS words FROM documents),
w AS (
  SELECT rid, i, md5(array_to_string(words[i:i + 34], ' ')) AS k
  FROM (SELECT rid, words, unnest(range(1, len(words) - 33)) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
c AS (SELECT DISTINCT rid, i + o AS place FROM (SELECT rid, i, unnest(range(35)) AS o FROM r)),
x AS (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM d),
k AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS kept FROM x ANTI JOIN c USING (rid, place) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of the ASCII digits of a number, bit by bit."""
    byte = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: {byte}), 4294967295)"


def _leaf(text: str) -> str:
    values = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(
        f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END" for v in values) + ")"


def _merkle(levels: int = 6, top_levels: int = 4) -> str:
    """The trees level by level: 16 ** levels rows of a source and 16 ** top_levels sources at most."""
    up = ("SELECT s, i // 16 AS i, (n + 15) // 16 AS n, list(h ORDER BY i) AS below, sha256(string_agg(h, '' ORDER BY i)) AS h "
          "FROM {} WHERE n > 1 GROUP BY s, i // 16, n")
    step = ("SELECT rid, x.s, x.i // 16 AS i, x.n2 AS n, "
            "sha256(array_to_string(below[1:x.i % 16], '') || x.digest || array_to_string(below[x.i % 16 + 2:], '')) AS digest, "
            "x.proof || array_to_string(below[1:x.i % 16], '') || array_to_string(below[x.i % 16 + 2:], '') AS proof "
            "FROM (SELECT *, (n + 15) // 16 AS n2 FROM {0} WHERE n > 1) x JOIN {1} y ON x.s = y.s AND x.i // 16 = y.i "
            "UNION ALL SELECT rid, s, i, n, digest, proof FROM {0} WHERE n = 1")
    parts = [
        f"d AS (SELECT row_number() OVER () AS rid, doc_id, source, {_leaf('text')} AS leaf, CASE WHEN "
        f"{_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_leaf(_lower('text'))} END AS altered FROM documents)",
        "l0 AS (SELECT rid, leaf AS h, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, "
        "row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, "
        "count(*) OVER (PARTITION BY source) AS n FROM d)"]
    parts += [f"l{k + 1} AS ({up.format(f'l{k}')})" for k in range(levels)]
    subroots = " UNION ALL ".join(f"SELECT s, h FROM l{k} WHERE n = 1" for k in range(levels + 1))
    parts += [f"sub AS ({subroots})", "t0 AS (SELECT 0 AS s, s AS i, h, (SELECT count(*) FROM sub) AS n FROM sub)"]
    parts += [f"t{k + 1} AS ({up.format(f't{k}')})" for k in range(top_levels)]
    roots = " UNION ALL ".join(f"SELECT h FROM t{k} WHERE n = 1" for k in range(top_levels + 1))
    parts += ["f0 AS (SELECT rid, s, i, n, coalesce(altered, leaf) AS digest, '' AS proof FROM l0 JOIN d USING (rid))"]
    parts += [f"f{k + 1} AS ({step.format(f'f{k}', f'l{k + 1}')})" for k in range(levels)]
    parts += [f"g0 AS (SELECT rid, 0 AS s, s AS i, (SELECT count(*) FROM sub) AS n, digest, proof FROM f{levels})"]
    parts += [f"g{k + 1} AS ({step.format(f'g{k}', f't{k + 1}')})" for k in range(top_levels)]
    return (f"WITH {', '.join(parts)}, r AS ({roots}) "
            "SELECT d.doc_id, leaf, sub.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, digest AS folded_root, "
            f"digest = r.h AS verified FROM g{top_levels} g JOIN d ON g.rid = d.rid JOIN l0 ON l0.rid = d.rid JOIN sub ON sub.s = l0.s, r")

JACCARD_JOIN = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_words(_lower("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + 2], ' ') AS k
      FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
z AS (SELECT rid, n, k FROM s JOIN n USING (rid)),
p AS (SELECT a.rid AS x, b.rid AS y FROM z a JOIN z b ON a.k = b.k AND a.rid <> b.rid
        AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
      GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT rid, rid AS o FROM d UNION SELECT r.rid, p.y FROM r JOIN p ON r.o = p.x),
c AS (SELECT r.rid, min(o.doc_id) AS component_id FROM r JOIN d o ON r.o = o.rid GROUP BY r.rid)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (rid) JOIN c USING (rid)
"""

PHRASES = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang,
             unnest(string_split_regex({_lower("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 5)) AS k)),
f AS (SELECT lang, w[i:i + k - 1] AS w, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT f.lang, f.w, f.f AS a, cut, l.f AS l, r.f AS r,
             CAST((2000000 * CAST(f.f AS HUGEINT)) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1) f
      JOIN f l ON l.lang = f.lang AND l.w = f.w[1:cut] JOIN f r ON r.lang = f.lang AND r.w = f.w[cut + 1:]),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1),
u AS (SELECT lang, w[i:i + m - 1] AS w, max(f) AS f
      FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2)) GROUP BY ALL),
e AS (SELECT b.*, array_to_string(b.w, ' ') AS phrase FROM b LEFT JOIN u ON b.lang = u.lang AND b.w = u.w
      WHERE u.f IS NULL OR 100 * u.f < 80 * b.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


ORACLE = {
    "op4_quality_rules": QUALITY_RULES,
    "op6_line_dedup": LINE_DEDUP,
    "op7_decontamination": DECONTAMINATION,
    "op9_substring_dedup": SUBSTRING_DEDUP,
    "op11_jaccard_join": JACCARD_JOIN,
    "op12_merkle_manifest": _merkle(),
    "op13_phrase_collocations": PHRASES,
}
