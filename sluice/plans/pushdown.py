"""The auction queries straight from topic records, with or without their selections and projections pushed into the scan.

With pushdown a record is dropped or trimmed while it is parsed; without it every record becomes a full row first. The
result is the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import Selection, TopicCriteria, compare_stats, scan_topics
from ..schemas import TIME, topic_schema
from ..sources.mapped import HOT_AUCTIONS
from . import auctions

# What each query needs of each topic it reads.
NEEDS = {
    "q0": {"bid": TopicCriteria(projections=("auction", "bidder", "price", TIME))},
    "q1": {"bid": TopicCriteria(projections=("auction", "bidder", "price", TIME, "extra"))},
    "q2": {"bid": TopicCriteria(selections=(Selection("auction", HOT_AUCTIONS),), projections=("auction", "price"))},
    "q3": {
        "auction": TopicCriteria(
            selections=(Selection("category", (auctions.LOCAL_CATEGORY,)),), projections=("id", "seller")
        ),
        "person": TopicCriteria(
            selections=(Selection("state", auctions.LOCAL_STATES),), projections=("id", "name", "city", "state")
        ),
    },
    "q5": {"bid": TopicCriteria(projections=("auction", TIME))},
    "q8": {
        "person": TopicCriteria(projections=("id", "name", TIME)),
        "auction": TopicCriteria(projections=("seller", TIME)),
    },
    "q11": {"bid": TopicCriteria(projections=("bidder", TIME))},
}

# The rest of a query once its topics are scanned; selections that the scan has made are not made again.
_REST = {
    "q0": lambda t, **p: auctions.q0(t["bid"]),
    "q1": lambda t, **p: auctions.q1(t["bid"], **p),
    "q2": lambda t, **p: t["bid"],
    "q3": lambda t, **p: auctions.join_sellers(t["auction"], t["person"], **p),
    "q5": lambda t, **p: auctions.q5(t["bid"], **p),
    "q8": lambda t, **p: auctions.q8(t["person"], t["auction"], **p),
    "q11": lambda t, **p: auctions.q11(t["bid"], **p),
}


def _time(records: DataFrame) -> str:
    return "ltz" if records.isStreaming else "ntz"


def over_topics(query: str, records: dict[str, DataFrame], *, pushdown: bool = True, on_malformed: str = "fail",
                **parameters) -> DataFrame:
    """A query over the raw records of its topics, ``{topic: records}``; batch or streams.

    With ``on_malformed="drop"`` records are also tested as text before they are parsed.
    """
    needs = NEEDS[query]
    topics = {topic: (records[topic], topic_schema(topic, _time(records[topic]))) for topic in needs}
    scanned = scan_topics(topics, needs if pushdown else {}, on_malformed=on_malformed)
    if not pushdown:
        scanned = {topic: _selected(rows, needs[topic]) for topic, rows in scanned.items()}
    return _REST[query](scanned, **parameters)


def _selected(rows: DataFrame, criteria: TopicCriteria) -> DataFrame:
    for selection in criteria.selections:
        rows = rows.where(F.col(selection.attribute).isin(*selection.values))
    return rows.select(*criteria.projections)


def savings(records: dict[str, DataFrame], queries=tuple(NEEDS)) -> DataFrame:
    """Per query and topic: records and bytes read, kept and saved by the pushdown."""
    by_topic: dict[str, dict[str, TopicCriteria]] = {}
    for query in queries:
        for topic, criteria in NEEDS[query].items():
            by_topic.setdefault(topic, {})[query] = criteria
    return reduce(DataFrame.unionByName, [compare_stats(records[t], criteria) for t, criteria in by_topic.items()])
