"""Text and JSON helpers for topic records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
JSON_WRITE = {"timestampFormat": TIME_FORMAT, "timestampNTZFormat": TIME_FORMAT}


def to_value(columns=None) -> Column:
    """JSON text of the named columns (all by default); null fields are left out."""
    return F.to_json(F.struct(*(columns or ["*"])), JSON_WRITE)


def attribute_text(attribute: Column) -> Column:
    """Text of a JSON attribute held as VARIANT.

    Strings as they are, numbers and booleans as JSON text, JSON null as ``null``, arrays and objects as the empty
    string. SQL NULL means that the record does not have the attribute.
    """
    nested = F.schema_of_variant(attribute).rlike("^(OBJECT|ARRAY)")
    return (
        F.when(F.is_variant_null(attribute), F.lit("null"))
        .when(nested, F.lit(""))
        .otherwise(attribute.cast("string"))
    )


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def words(text) -> Column:
    """Lower-cased words of a text; anything outside ``[A-Za-z0-9_]`` separates."""
    return F.array_remove(F.split(F.lower(text), r"\W+"), "")


def record_bytes(key, value) -> Column:
    size = lambda part: F.coalesce(F.octet_length(part), F.lit(0))
    return (size(key) + size(value)).cast("bigint")


# Fixed value: a series label such as {name="stack_service.replica.task"}.
SERIES_LABEL = r'="[^_]+_([^.]+\.[^.]+)\..*"'


def service_name(label, metric: str) -> Column:
    """``metric_service.replica`` out of a series label; a label without replica stays as it is."""
    label = F.col(label) if isinstance(label, str) else label
    service = F.regexp_extract(label, SERIES_LABEL, 1)
    return F.when(service != "", F.concat(F.lit(f"{metric}_"), service)).otherwise(label)
