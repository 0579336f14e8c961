"""Session settings and the shared folder that streams and checkpoints write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

BATCH_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Settings that a streaming query takes from the session it starts in.
STREAM_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Sessions of one key are merged on the map side first, so a hot key shuffles few rows.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
    # Operators above a reused exchange do not see the watermark below it and would never close a window.
    "spark.sql.exchange.reuse": "false",
}


def build_session(app: str = "sluice", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the batch defaults; ``conf`` keys use ``__`` for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in BATCH_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def stream_session(spark: SparkSession, *, count_state: bool = True) -> SparkSession:
    """A sibling session carrying the streaming settings; the caller's own session is left as it is.

    Without ``count_state`` progress updates do not tell the rows of state (``numRowsTotal``), which cost a read of the
    state store before every write.
    """
    sibling = spark.newSession()
    local = spark.sparkContext.master.startswith("local")
    # The number of state partitions is fixed when a query first starts.
    partitions = spark.sparkContext.defaultParallelism if local else spark.conf.get("spark.sql.shuffle.partitions")
    sibling.conf.set("spark.sql.shuffle.partitions", partitions)
    for key, value in STREAM_CONF.items():
        sibling.conf.set(key, value)
    sibling.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", str(count_state).lower())
    return sibling


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's ``spark.checkpoint.dir``.

    Only a local master may do without the setting; it then gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sluice-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
