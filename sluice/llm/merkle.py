"""Merkle manifest of a table: a tree per source, a tree over the sources, and a proof of every row.

Rows are leaves, in the order of their ids per source; runs of ``FAN`` nodes become one node until one is left, and the
trees' last nodes are the leaves of a tree over the sources. Positions come from range partitions (``places``), so a
source with a third of all rows is hashed by many tasks; a run holds ``FAN`` nodes at most.

Proofs are found by pointer jumping: every inner node starts with a pointer to its parent and the segment of siblings
on that step; each self-join replaces the pointer by the pointer of the node that it shows at and appends that node's
segments, which doubles the distance, until all pointers have left the root. Leaves, 15 of 16 nodes, join last: one jump
appends all segments of their parent, so that a leaf's proof is never written or shuffled. Nodes hold the digests below
them as one text; a segment is what stands left and right of a child there.

Defined results: rows that share an id are ordered by their digest; null ids come first and are never tampered with;
repeated rows are leaves of their own; null values are ``-``; a lone leaf is its tree's last node, a lone tree's last node
is the root; a table without rows has no rows. Columns that are not named are left out of the digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import ascii_lower, written
from sluice.llm.places import numbered, ordered, positioned, spans

FAN = 16
DIGEST = 64  # hex digits
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1  # the tree over the sources
SEGMENTS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def tampered_with(doc_id: Column) -> Column:
    """Whether the contract's tampering touches a row."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _levels(leaves: int) -> int:
    """How often runs of ``FAN`` have to be joined until one node is left."""
    count, levels = leaves, 0
    while count > 1:
        count, levels = -(-count // FAN), levels + 1
    return levels


def _inner(below: DataFrame) -> DataFrame:
    """The next level over ``tree, level, i, digest, n``, where ``n`` counts the nodes of the level in the tree."""
    runs = below.where("n > 1").groupBy("tree", "level", F.expr(f"i div {FAN}").alias("i"), "n").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "digest"))), lambda x: x.digest), "").alias("below"))
    return runs.select("tree", (F.col("level") + 1).alias("level"), "i", F.sha2("below", 256).alias("digest"),
                       F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), "below")


def _tree(leaves: DataFrame, levels: int, purpose: str) -> list[DataFrame]:
    """All levels over ``leaves``, each written; ``below`` holds the digests below a node."""
    made, at = [], leaves
    for _ in range(levels):
        at = written(_inner(at), purpose)
        made.append(at)
    return made


def _to_parent(trees: int) -> dict[str, Column]:
    """Where the parent of a node ``tree, level, i, n`` is and which child of it the node is; null above the root."""
    inside, up = F.col("n") > 1, (F.col("tree") != TOP) & F.lit(trees > 1)
    spot = lambda here, top: F.when(inside, here).when(up, top)
    return {
        "up_tree": spot(F.col("tree"), F.lit(TOP).cast("long")),
        "up_level": spot(F.col("level") + 1, F.lit(1)),
        "up_i": spot(F.expr(f"i div {FAN}"), F.expr(f"tree div {FAN}")),
        "child": spot(F.pmod("i", F.lit(FAN)), F.pmod("tree", F.lit(FAN))),
    }


def _segment(below: str, child: str) -> Column:
    start = F.col(child).cast("int") * DIGEST
    return F.struct(F.substring(F.col(below), F.lit(1), start).alias("left"),
                    F.substring(F.col(below), start + DIGEST + 1, F.length(below)).alias("right"))


AT = ("tree", "level", "i")
UP = ("up_tree", "up_level", "up_i")


def _ahead(nodes: DataFrame) -> DataFrame:
    """``nodes`` under other names, so that they can be joined to those that point at them."""
    return nodes.select(*[F.col(c).alias(f"its_{c}") for c in nodes.columns])


def _meets() -> Column:
    same = [F.col(u) == F.col(f"its_{a}") for u, a in zip(UP, AT)]
    return same[0] & same[1] & same[2]


def proofs(inner: DataFrame, trees: int, levels: int) -> DataFrame:
    """Inner nodes with ``path``, the segments from the node up to the root, lowest first."""
    nodes = inner.withColumns(_to_parent(trees))
    step = F.when(F.col("child").isNull(), F.array().cast(SEGMENTS)).otherwise(
        F.array(_segment("its_below", "child")).cast(SEGMENTS))
    state = written(nodes.join(_ahead(inner.select(*AT, "below")), _meets(), "left").select(
        *AT, *UP, step.alias("path")), "proof-steps")
    distance = 1
    while distance < levels:
        open_steps = state.where("up_level IS NOT NULL").join(_ahead(state), _meets()).select(
            *AT, *[F.col(f"its_{u}").alias(u) for u in UP], F.concat("path", "its_path").alias("path"))
        state = written(state.where("up_level IS NULL").unionByName(open_steps), "proof-jumps")
        distance *= 2
    return state.select(*AT, "path").join(inner.select(*AT, "below"), list(AT))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", order: str = "doc_id",
             altered: Column | None = None, when: Column | None = None) -> dict[str, DataFrame | str | None]:
    """``leaves`` (``order``, ``leaf``, ``subroot``, ``path``, ``altered``: the digest with ``altered`` as the last column
    where ``when`` holds, else null), ``subroots`` (``group``, ``tree``, ``digest``, ``n``), ``nodes`` and the ``root``."""
    values = [F.col(c) for c in columns]
    other = leaf_digest([*values[:-1], altered]) if altered is not None else F.lit(None).cast("string")
    hashed = written(  # texts are hashed once; ordering samples its input before it reads it
        docs.select(F.col(order).alias("_id"), F.col(group).alias("_source"), leaf_digest(values).alias("leaf"),
                    F.when(when if when is not None else F.lit(altered is not None), other).alias("altered")), "merkle-digests")
    rows = ordered(hashed, ["_source", "_id", "leaf"], "merkle-leaves")
    parts = spans(rows, ["_source"])
    sources = written(numbered(parts.groupBy("_source").agg(F.sum("_rows").alias("n")), ["_source"], "tree"), "merkle-sources")
    trees, most = sources.agg(F.count("*"), F.max("n")).first()
    if not trees:
        none = rows.select("_id", "leaf", "altered", F.col("leaf").alias("subroot"), F.array().cast(SEGMENTS).alias("path"))
        return {"leaves": none.withColumnRenamed("_id", order), "subroots": sources.select(
            F.col("_source").alias(group), "tree", F.lit("").alias("digest"), "n"), "nodes": None, "root": None}
    its = sources.select(F.col("_source").alias("_its_source"), "tree", "n")
    found = parts.join(its, F.col("_source").eqNullSafe(F.col("_its_source"))).drop("_its_source")
    leaves = written(
        positioned(rows, found, ["_source"], "i").select("_id", "tree", F.lit(0).alias("level"), "i", "leaf", "altered", "n"),
        "merkle-placed")

    made = _tree(leaves.select("tree", "level", "i", F.col("leaf").alias("digest"), "n"), _levels(most), "merkle-level")
    last = leaves.where("n = 1").select("tree", F.col("leaf").alias("digest"))
    for level in made:
        last = last.unionByName(level.where("n = 1").select("tree", "digest"))
    subroots = written(last, "merkle-subroots")
    top = _tree(
        subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("i"), "digest",
                        F.lit(trees).alias("n")), _levels(trees), "merkle-top")
    root = (top[-1] if top else subroots).select("digest").first()[0]  # one row
    result = {"subroots": sources.select(F.col("_source").alias(group), "tree", "n").join(subroots, "tree"), "root": root}
    if not made and not top:  # one leaf
        alone = leaves.select(F.col("_id").alias(order), "leaf", "altered", F.col("leaf").alias("subroot"),
                              F.array().cast(SEGMENTS).alias("path"))
        return {**result, "leaves": alone, "nodes": None}
    inner = (made + top)[0]
    for level in (made + top)[1:]:
        inner = inner.unionByName(level)
    nodes = proofs(inner, trees, len(made) + len(top)).join(subroots.withColumnRenamed("digest", "subroot"), "tree", "left")
    # Sixteen leaves at most share a parent, so no key of this join is hot.
    subroot = F.when(F.col("n") == 1, F.col("leaf")).otherwise(F.col("its_subroot"))
    jumped = leaves.withColumns(_to_parent(trees)).join(_ahead(nodes), _meets(), "left").select(
        F.col("_id").alias(order), "leaf", "altered", subroot.alias("subroot"),
        F.concat(F.array(_segment("its_below", "child")).cast(SEGMENTS), "its_path").alias("path"))
    return {**result, "leaves": jumped, "nodes": inner}


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step.left, step.right)), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step.left, digest, step.right), 256))


def verified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their digests and proofs, held against a copy of the table that was tampered with."""
    made = manifest(docs, altered=ascii_lower(F.col("text")), when=tampered_with(F.col("doc_id")))
    root = F.lit(made["root"]).cast("string")
    found = made["leaves"].select(
        "doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
