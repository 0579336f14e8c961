"""Analytics over time series of measured runs, in long form.

Samples have the columns ``run_id, query, parallelism, throughput, variant, service, replica, metric, ts, value``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import service_name
from ..functions.timing import duration, interval, seconds_between, time_slice
from ..operators.timeline import even_slices, previous_row, running_sum

# The share of every topic in the event mix and the topics that a query reads.
TOPIC_SHARES = {"bid": 0.92, "auction": 0.06, "person": 0.02}
QUERY_TOPICS = {
    1: ("bid",), 2: ("bid",), 3: ("auction", "person"), 5: ("bid",), 8: ("auction", "person"), 11: ("bid",),
}
FLOOR_RATIO = 0.95
WARM_UP = "30 seconds"
WARM_UP_SAMPLES = 10
RATE_WINDOW = "30 seconds"
VARIANTS = ("plain", "pushed")

# The service names of every role whose core use is reported, and of the role whose network use is.
ROLE_SERVICES = {"processing": "^taskmanager$", "storage": "^storage$", "proxy": "^proxy$"}
RECEIVER = "processing"


def _slice(samples: DataFrame, time: str, time_slices) -> Column:
    """The slice of a time by a width or a function; without one, slices hold even parts of the samples."""
    if time_slices is None:
        time_slices = even_slices([samples], time)
    return time_slices(time) if callable(time_slices) else time_slice(time, time_slices)


def instant_rate(samples: DataFrame, series: Sequence[str], *, time: str = "ts", value: str = "value",
                 tie: Sequence[str] = (), window: str = RATE_WINDOW, time_slices=None) -> DataFrame:
    """Adds the per-second ``rate`` of a counter from each sample and the one before it.

    Null for the first sample and where the two are further apart than the window. After a reset the new reading is
    the increase. ``tie`` orders samples of one instant; two samples at the same instant have no rate.
    """
    looked = previous_row(
        samples, list(series), [time, *tie], _slice(samples, time, time_slices), {"_time": time, "_value": value})
    elapsed = seconds_between(F.col(time), F.col("_time"))
    increase = F.when(F.col(value) < F.col("_value"), F.col(value)).otherwise(F.col(value) - F.col("_value"))
    usable = (elapsed > 0) & (elapsed <= duration(window).total_seconds())
    return looked.withColumn("rate", F.when(usable, increase / elapsed)).drop("_time", "_value")


def counter(readings: DataFrame, series: Sequence[str], amount: Column, *, time: str = "ts", tie: Sequence[str] = (),
            time_slices=None, name: str = "value") -> DataFrame:
    """Turns increments into an ever-growing counter per series."""
    return running_sum(readings, list(series), [time, *tie], _slice(readings, time, time_slices), amount, name)


def rename_series(samples: DataFrame, metric: str, label: str = "label", name: str = "series") -> DataFrame:
    return samples.withColumn(name, service_name(label, metric))


def totals(samples: DataFrame, by: Sequence[str] = (), *, time: str = "ts", value: str = "value") -> DataFrame:
    """Sum of the series that share a name, or of all series, per instant."""
    return samples.groupBy(*by, time).agg(F.sum(value).alias("total"))


def side_by_side(samples: DataFrame, series: Sequence[str], *, column: str = "series", time: str = "ts",
                 value: str = "value") -> DataFrame:
    """One column per named series and one row per instant at which any of them has a sample."""
    named = samples.where(F.col(column).isin(*series))
    return named.groupBy(time).pivot(column, list(series)).agg(F.max(value))


def stacked(*frames: DataFrame) -> DataFrame:
    """Series of several queries in one long frame."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def with_elapsed(samples: DataFrame, run: Sequence[str] = ("run_id", "variant"), *, time: str = "ts") -> DataFrame:
    """Adds the seconds since the first sample of the run; each variant of a run is a launch of its own."""
    starts = samples.groupBy(*run).agg(F.min(time).alias("_start"))
    joined = samples.join(starts, list(run))
    return joined.withColumn("elapsed", seconds_between(F.col(time), F.col("_start"))).drop("_start")


def after_warm_up(samples: DataFrame, run: Sequence[str] = ("run_id", "variant"), *, time: str = "ts", warm_up: str = WARM_UP,
                  samples_cut: int = WARM_UP_SAMPLES) -> DataFrame:
    """Drops the warm-up time of every run and then its first instants.

    Only the end of the cut is looked up per run: the ranking keeps a handful of rows per run on the map side, and the
    samples meet it in a join.
    """
    starts = samples.groupBy(*run).agg(F.min(time).alias("_start"))
    warm = samples.join(starts, list(run)).where(F.col(time) > F.col("_start") + interval(warm_up)).drop("_start")
    if not samples_cut:
        return warm
    first = Window.partitionBy(*run).orderBy(time)
    instants = warm.select(*run, time).distinct()
    cut = instants.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= samples_cut)
    ends = cut.groupBy(*run).agg(F.max(time).alias("_cut"))
    # Whatever is after the cut instants is after the warm-up time too.
    return samples.join(ends, list(run)).where(F.col(time) > F.col("_cut")).drop("_cut")


def expected_throughput(query, throughput, parallelism, ratio: float = 1.0) -> Column:
    """Events per second that a query reads: its topics' shares of the rate, times the parallelism."""
    share = F.lit(None).cast("double")
    for number, topics in QUERY_TOPICS.items():
        share = F.when(F.col(query) == number, F.lit(sum(TOPIC_SHARES[t] for t in topics))).otherwise(share)
    return F.col(throughput) * F.col(parallelism) * share * F.lit(ratio)


def above_floor(samples: DataFrame, *, metric: str = "tput", ratio: float = FLOOR_RATIO) -> DataFrame:
    """All samples of the instants at which a run's throughput is above the floor.

    Runs of queries 2 and 3 are kept whole: they drop most of what they read, so their rate says nothing.
    """
    floor = expected_throughput("query", "throughput", "parallelism", ratio)
    unchecked = F.col("query").isin(2, 3)
    fast = (
        samples.where(~unchecked & (F.col("metric") == metric))
        .groupBy("run_id", "variant", "ts", floor.alias("_floor"))
        .agg(F.sum("value").alias("_rate"))
        .where(F.col("_rate") > F.col("_floor"))
        .select("run_id", "variant", "ts")
    )
    checked = samples.where(~unchecked).join(fast, ["run_id", "variant", "ts"], "left_semi")
    return checked.unionByName(samples.where(unchecked))


RUN = ("run_id", "query", "parallelism", "throughput", "variant")


def role_usage(samples: DataFrame, roles: dict[str, str] = ROLE_SERVICES, receiver: str = RECEIVER) -> DataFrame:
    """Core use per role and received bytes per second of a run: means per replica, summed over the replicas.

    ``roles`` maps roles to patterns of service names, for series that bear the number of their replica in the name.
    """
    role = F.lit(None).cast("string")
    for name, pattern in roles.items():
        cores = (F.col("metric") == "cpu_rate") & F.col("service").rlike(pattern)
        role = F.when(cores, F.lit(name)).otherwise(role)
    received = (F.col("metric") == "network_rate") & F.col("service").rlike(roles[receiver])
    role = F.when(received, F.lit("network")).otherwise(role)
    means = (
        samples.withColumn("role", role).where(F.col("role").isNotNull())
        .groupBy(*RUN, "role", "replica").agg(F.avg("value").alias("_mean"))
    )
    return means.groupBy(*RUN, "role").agg(F.sum("_mean").alias("usage"))


def executed_runs(samples: DataFrame, runs: DataFrame, variants: Sequence[str] = VARIANTS) -> DataFrame:
    """Rows of executed runs that have rows in every variant; samples or, far fewer, their usage."""
    complete = (
        samples.where(F.col("variant").isin(*variants)).groupBy("run_id")
        .agg(F.count_distinct("variant").alias("_variants")).where(F.col("_variants") == len(variants))
    )
    done = runs.where(F.col("state") == "executed").select("run_id").distinct()
    return samples.join(complete.join(done, "run_id").select("run_id"), "run_id", "left_semi")


def compare_variants(usage: DataFrame, variants: Sequence[str] = VARIANTS) -> DataFrame:
    """Mean use of each variant over repeated runs and their ratio, per query, parallelism, throughput and role."""
    plain, pushed = variants
    setting = ("query", "parallelism", "throughput", "role")
    wide = usage.groupBy(*setting).pivot("variant", list(variants)).agg(F.avg("usage"))
    return wide.withColumn("ratio", F.when(F.col(plain) != 0, F.col(pushed) / F.col(plain)))


def job_role_means(samples: DataFrame, patterns: dict[str, str], *, job: str = "variant", time: str = "ts") -> DataFrame:
    """Mean over time, per job, of the summed series whose service matches a role's pattern."""
    roles = F.array_compact(F.array(*[
        F.when(F.col("service").rlike(pattern), F.lit(role)) for role, pattern in patterns.items()
    ]))
    matched = samples.select(job, time, "value", F.explode(roles).alias("role"))
    sums = matched.groupBy(job, "role", time).agg(F.sum("value").alias("_sum"))
    return sums.groupBy(job, "role").agg(F.avg("_sum").alias("mean_use"))
