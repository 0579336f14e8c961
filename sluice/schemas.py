"""Row types of the topics and of the query results."""

from __future__ import annotations

from pyspark.sql import types as T

TIME = "dateTime"

_LONG, _TEXT = T.LongType(), T.StringType()

# Names, order and types of the topic columns. "time" stands for the event-time type.
TOPIC_COLUMNS = {
    "bid": [("auction", _LONG), ("bidder", _LONG), ("price", _LONG), (TIME, "time"), ("extra", _TEXT)],
    "auction": [
        ("id", _LONG), ("itemName", _TEXT), ("description", _TEXT), ("initialBid", _LONG), ("reserve", _LONG),
        ("expires", "time"), ("seller", _LONG), ("category", _LONG), (TIME, "time"), ("extra", _TEXT),
    ],
    "person": [
        ("id", _LONG), ("name", _TEXT), ("emailAddress", _TEXT), ("creditCard", _TEXT), ("city", _TEXT),
        ("state", _TEXT), (TIME, "time"), ("extra", _TEXT),
    ],
}

# The column whose decimal text is the record key of a topic.
TOPIC_KEYS = {"bid": "auction", "auction": "id", "person": "id"}

# Names, order and types of the result columns.
RESULT_COLUMNS = {
    "q0": [("auction", _LONG), ("bidder", _LONG), ("price", _LONG), (TIME, "time")],
    "q1": [
        ("auction", _LONG), ("bidder", _LONG), ("price", T.DecimalType(23, 3)), (TIME, "time"), ("extra", _TEXT),
    ],
    "q2": [("auction", _LONG), ("price", _LONG)],
    "q3": [("name", _TEXT), ("city", _TEXT), ("state", _TEXT), ("id", _LONG)],
    "q5": [("auction", _LONG), ("num", _LONG)],
    "q8": [("id", _LONG), ("name", _TEXT), ("stime", "time")],
    "q11": [("bidder", _LONG), ("bid_count", _LONG), ("starttime", "time"), ("endtime", "time")],
    "q11_composite": [
        ("extra", _TEXT), ("auction", _LONG), ("bidder", _LONG), ("bid_count", _LONG), ("starttime", "time"),
        ("endtime", "time"),
    ],
}

_TIME_TYPES = {
    "ntz": T.TimestampNTZType(),  # batch: timestamps without zone
    "ltz": T.TimestampType(),     # streams: a watermark needs this type
    "millis": T.LongType(),       # records that carry epoch milliseconds
}


def _struct(columns, time: str) -> T.StructType:
    stamp = _TIME_TYPES[time]
    return T.StructType([T.StructField(name, stamp if kind == "time" else kind) for name, kind in columns])


def topic_schema(topic: str, time: str = "ntz") -> T.StructType:
    return _struct(TOPIC_COLUMNS[topic], time)


def result_schema(query: str, time: str = "ntz") -> T.StructType:
    return _struct(RESULT_COLUMNS[query], time)
