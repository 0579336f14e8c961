"""Topic scan: selections and projections applied to JSON records while they are parsed.

Only the attributes that a criterion names are parsed. Everything here is row-local, so a scan never shuffles; the one
exception is the per-partition tail marker, which aggregates to one row per topic partition.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import required_literals
from ..functions.records import JSON_WRITE, attribute_text, quoted, record_bytes
from ..schemas import TIME
from ..sources.topics import WATERMARK_DELAY, expand, with_watermark


@dataclass(frozen=True)
class Selection:
    """Keep a record by one attribute.

    ``values``: the attribute equals one of them; a record without the attribute goes.
    ``pattern``: the pattern occurs anywhere in the attribute's text; a record without the attribute stays.
    """

    attribute: str
    values: tuple = ()
    pattern: str | None = None

    def __post_init__(self):
        if bool(self.values) == (self.pattern is not None):
            raise ValueError("a selection takes either values or a pattern")


@dataclass(frozen=True)
class TopicCriteria:
    """What a query needs of a topic. Nothing given means everything.

    ``partition_keys`` are ``(attribute, kind)`` pairs with kind ``string``, ``int`` or ``long``.
    """

    selections: tuple[Selection, ...] = ()
    projections: tuple[str, ...] = ()
    partition_keys: tuple[tuple[str, str], ...] = ()
    num_sources: int = 1
    num_partitions: int = 1

    @property
    def filters(self) -> bool:
        return bool(self.selections or self.projections)

    def attributes(self) -> list[str]:
        """Projections first, then the attributes only selections look at."""
        named = [*self.projections, *(s.attribute for s in self.selections)]
        return list(dict.fromkeys(named))


def _both(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left & right, conditions, F.lit(True))


# ---- typed rows --------------------------------------------------------------------------------------------------

def _occurs(selection: Selection, kind: T.DataType) -> Column | None:
    """Cheap test on the raw text that every matching record passes, or None if there is no safe one.

    An integer is written with its plain digits. A string is written as it is unless escaped, hence the backslash.
    """
    value = F.col("value")
    if isinstance(kind, T.IntegralType):
        return reduce(lambda a, b: a | b, [value.contains(str(v)) for v in selection.values])
    if isinstance(kind, T.StringType):
        seen = [value.contains(v) for v in selection.values]
        return reduce(lambda a, b: a | b, seen, value.contains("\\"))
    return None


_NUMERIC = set("0123456789+-.eE")


def _may_occur(selection: Selection, kind: T.DataType) -> Column | None:
    """The same for a pattern: a record that has the attribute has one of the pattern's required texts.

    Numbers may be written otherwise than they read, so runs of their characters are only looked for in integers.
    """
    value, literals = F.col("value"), required_literals(selection.pattern)
    if literals is None or not isinstance(kind, (T.IntegralType, T.StringType)):
        return None
    if isinstance(kind, T.StringType) and any(_NUMERIC.issuperset(text) for text in literals):
        return None
    absent = ~value.contains(f'"{selection.attribute}"')
    return reduce(lambda a, b: a | b, [value.contains(text) for text in literals], absent | value.contains("\\"))


def scan_topic(
    records: DataFrame,
    schema: T.StructType,
    criteria: TopicCriteria = TopicCriteria(),
    *,
    on_malformed: str = "fail",
    watermark: str | None = WATERMARK_DELAY,
) -> DataFrame:
    """Typed rows of a topic: parse what the criteria name, select, then project.

    With ``on_malformed`` other than ``fail`` a text test runs before the parser, so most records of a selective scan
    are never parsed; broken records among them then go unseen.
    """
    known = {f.name: f for f in schema.fields}
    wanted = criteria.attributes() if criteria.projections else list(
        dict.fromkeys([*known, *(s.attribute for s in criteria.selections)])
    )
    unknown = [name for name in wanted if name not in known]
    if unknown:
        raise ValueError(f"the topic has no attributes {unknown}")
    rows = records.where(F.col("value").isNotNull())
    patterns = [s for s in criteria.selections if s.pattern is not None]
    exact = [s for s in criteria.selections if s.pattern is None]
    if on_malformed != "fail":
        for selection in criteria.selections:
            occurs = _occurs if selection.pattern is None else _may_occur
            test = occurs(selection, known[selection.attribute].dataType)
            rows = rows if test is None else rows.where(test)
    if patterns:
        rows = _matching(rows, patterns, on_malformed)
    def listed(row: Column) -> Column:
        return _both([
            row[s.attribute].isin([F.lit(v).cast(known[s.attribute].dataType) for v in s.values]) for s in exact
        ])

    parsed = T.StructType([known[name] for name in wanted])
    rows = expand(rows, "value", parsed, on_malformed, listed if exact else None)
    output = criteria.projections or known
    return with_watermark(rows.select(*[F.col("row")[name].alias(name) for name in output]), watermark)


def scan_topics(topics: dict, criteria: dict[str, TopicCriteria], **options) -> dict[str, DataFrame]:
    """``scan_topic`` for ``{topic: (records, schema)}``; a topic without criteria is read whole."""
    return {
        topic: scan_topic(records, schema, criteria.get(topic, TopicCriteria()), **options)
        for topic, (records, schema) in topics.items()
    }


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fails early if a projection left out a column that is used later."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"the projection leaves out {missing}")
    return df


def carries_time(criteria: TopicCriteria, time: str = TIME) -> bool:
    return not criteria.projections or time in criteria.projections


# ---- raw records -------------------------------------------------------------------------------------------------

def _variant_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.VariantType()) for name in names])


def _accepts(selection: Selection, attribute: Column) -> Column:
    text = attribute_text(attribute)
    if selection.pattern is not None:
        return attribute.isNull() | text.rlike(selection.pattern)
    listed = [str(v).lower() if isinstance(v, bool) else str(v) for v in selection.values]
    return F.coalesce(text.isin(listed), F.lit(False))


def _matching(records: DataFrame, selections: list[Selection], on_malformed: str) -> DataFrame:
    attributes = list(dict.fromkeys(s.attribute for s in selections))
    return expand(records, "value", _variant_schema(attributes), on_malformed, _test(selections)).drop("row")


def _test(selections):
    return (lambda row: _both([_accepts(s, row[s.attribute]) for s in selections])) if selections else None


def _output(criteria: TopicCriteria) -> Column:
    if not criteria.projections:
        return F.col("value")
    return F.to_json(F.struct(*[F.col("row")[n].alias(n) for n in criteria.projections]), JSON_WRITE)


def _kept(records: DataFrame, criteria: TopicCriteria, on_malformed: str) -> DataFrame:
    """The matching records with their projected values. No schema needed."""
    rows = records.where(F.col("value").isNotNull())
    if criteria.filters:
        schema = _variant_schema(criteria.attributes())
        rows = expand(rows, "value", schema, on_malformed, _test(criteria.selections))
        rows = rows.withColumn("value", _output(criteria))
    return rows.select(*records.columns)


def _judged(records: DataFrame, criteria: TopicCriteria, on_malformed: str) -> DataFrame:
    """All records with a value, plus ``kept`` and the projected ``output``."""
    rows = records.where(F.col("value").isNotNull())
    if not criteria.filters:
        return rows.select("*", F.lit(True).alias("kept"), F.col("value").alias("output"))
    rows = expand(rows, "value", _variant_schema(criteria.attributes()), on_malformed)
    test = _test(criteria.selections)
    kept = test(F.col("row")) if test else F.lit(True)
    return rows.select(*records.columns, kept.alias("kept"), _output(criteria).alias("output"))


def scan_records(
    records: DataFrame,
    criteria: TopicCriteria = TopicCriteria(),
    *,
    tail_marker: bool = False,
    on_malformed: str = "fail",
) -> DataFrame:
    """Records in, records out: non-matching ones dropped, JSON values trimmed to the projections in list order.

    Attributes that a record lacks stay absent and JSON nulls stay null. Without criteria the input comes back as it
    is. ``tail_marker`` (batch only) keeps the last position of every topic partition: if its record is not kept, a
    record with null key and value stands in for it.
    """
    if not criteria.filters and not criteria.partition_keys:
        return records
    kept = _kept(records, criteria, on_malformed)
    if not tail_marker:
        return kept
    if records.isStreaming:
        raise ValueError("tail markers are for batch scans; a stream keeps its own offsets")
    place = ("topic", "partition")
    ends = records.groupBy(*place).agg(F.max("offset").alias("offset"))
    kept_ends = kept.groupBy(*[F.col(p).alias(f"kept_{p}") for p in place]).agg(
        F.max("offset").alias("kept_offset")
    )
    same_place = _both([F.col(p).eqNullSafe(F.col(f"kept_{p}")) for p in place])
    open_ends = ends.join(kept_ends, same_place, "left").where(
        F.col("kept_offset").isNull() | (F.col("kept_offset") < F.col("offset"))
    )
    typed = {f.name: f.dataType for f in records.schema.fields}
    markers = open_ends.select(*[
        F.col(name) if name in (*place, "offset") else F.lit(None).cast(typed[name]).alias(name)
        for name in records.columns
    ])
    return kept.unionByName(markers)


def _totals(output: Column, kept: Column | None = None) -> list[Column]:
    read, sent = record_bytes(F.col("key"), F.col("value")), record_bytes(F.col("key"), output)
    kept = F.col("kept") if kept is None else kept
    count = lambda flag: F.sum(F.when(flag, 1).otherwise(0)).cast("bigint")
    return [
        F.count(F.lit(1)).alias("records"),
        count(kept).alias("kept"),
        count(~kept).alias("removed"),
        F.sum(read).cast("bigint").alias("bytes_read"),
        F.sum(F.when(kept, sent).otherwise(0)).cast("bigint").alias("bytes_sent"),
    ]


def scan_stats(records: DataFrame, criteria: TopicCriteria, *, on_malformed: str = "fail") -> DataFrame:
    """Records read, kept and removed and the bytes saved, per topic."""
    judged = _judged(records, criteria, on_malformed)
    stats = judged.groupBy("topic").agg(*_totals(F.col("output")))
    return stats.withColumn("bytes_saved", F.col("bytes_read") - F.col("bytes_sent"))


def compare_stats(records: DataFrame, criteria: dict[str, TopicCriteria], name: str = "query") -> DataFrame:
    """``scan_stats`` for several criteria over one topic, which is read and parsed once; ``name`` tells them apart."""
    rows = records.where(F.col("value").isNotNull())
    attributes = tuple(dict.fromkeys(a for c in criteria.values() for a in c.attributes()))
    rows = expand(rows, "value", _variant_schema(list(attributes)), "fail")
    row = F.col("row")
    judged = rows.select("topic", "key", "value", *[
        F.struct(
            (_test(c.selections)(row) if c.selections else F.lit(True)).alias("kept"), _output(c).alias("output"),
        ).alias(f"by{i}") for i, c in enumerate(criteria.values())])
    reports = judged.groupBy("topic").agg(*[
        F.struct(F.lit(label).alias(name), *_totals(F.col(f"by{i}.output"), F.col(f"by{i}.kept"))).alias(f"by{i}")
        for i, label in enumerate(criteria)])
    each = reports.select("topic", F.inline(F.array(*[F.col(f"by{i}") for i in range(len(criteria))])))
    return each.withColumn("bytes_saved", F.col("bytes_read") - F.col("bytes_sent"))


SCAN_METRICS = "scan"


def observed_scan(records: DataFrame, criteria: TopicCriteria, *, on_malformed: str = "fail") -> DataFrame:
    """``scan_records`` that reports its totals as the observation ``scan`` of every (micro-)batch."""
    judged = _judged(records, criteria, on_malformed).observe(SCAN_METRICS, *_totals(F.col("output")))
    return judged.where("kept").withColumn("value", F.col("output")).select(*records.columns)


KEY_ROW = "_key_row"


def with_key_row(records: DataFrame, criteria: TopicCriteria, value: str = "value") -> DataFrame:
    """Adds the partition key attributes, parsed from the JSON value once: the generator keeps the parser in one place."""
    names = [name for name, _ in criteria.partition_keys]
    row = F.from_json(F.col(value), ", ".join(f"{quoted(n)} VARIANT" for n in names))
    return records.withColumn(KEY_ROW, F.explode(F.array(row)))


def key_fields(criteria: TopicCriteria) -> list[tuple[Column, str]]:
    """Partition key columns over ``with_key_row``: wrong types count as empty text or 0, absent ones as null."""
    row = F.col(KEY_ROW)
    fields = []
    for name, kind in criteria.partition_keys:
        attribute = row[name]
        spelled = F.schema_of_variant(attribute)
        if kind == "string":
            read = F.when(spelled == "STRING", attribute.cast("string")).otherwise(F.lit(""))
        else:
            whole = F.when(spelled == "BIGINT", F.try_variant_get(attribute, "$", "bigint")).otherwise(F.lit(0))
            if kind == "int":
                low = whole.bitwiseAND(F.lit(0xFFFFFFFF))
                whole = ((low + F.lit(0x80000000)) % F.lit(0x100000000)) - F.lit(0x80000000)
            read = whole
        fields.append((F.when(attribute.isNotNull(), read), kind))
    return fields
