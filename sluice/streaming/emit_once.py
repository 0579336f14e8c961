"""Stream twin of the emit-once join: seller details and waiting auctions as keyed state, taken a bucket at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.emit_once import PERSON_FIELDS, salts_of, seller_salts
from ..operators.windows import count_up
from ..schemas import TIME
from .precombine import PAGES, as_bytes, combine_copies

DETAILS = "name string, city string, state string"
OUTPUT = f"{DETAILS}, id bigint, has_id boolean, copies bigint"
# State keys per state partition, each one call of the processor in a micro-batch.
BUCKETS_PER_PARTITION = 2
EARLIEST = -(1 << 63)
KNOWN, WAITING = ["page", "seller", *PERSON_FIELDS], ["page", "seller", "id", "has_id"]


class EmitOnceJoin(StatefulProcessor):
    """State per bucket of sellers, in pages: the latest details of the sellers that have appeared, and the set of
    auctions that wait for the others. A call reads the pages of the sellers in its rows and writes those that changed.

    The rows of a micro-batch are matched as of their event time, persons first; across micro-batches arrival decides.
    """

    def __init__(self, key_type: str):
        text = pa.string()
        seller = pa.int64() if key_type == "bigint" else text
        self.known_schema = pa.schema([("seller", seller), *[(f, text) for f in PERSON_FIELDS]])
        self.waiting_schema = pa.schema([("seller", seller), ("id", pa.int64()), ("has_id", pa.bool_())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "page int", "known binary, waiting binary")

    def _read(self, pages: list[int]) -> tuple[pd.DataFrame, pd.DataFrame]:
        known, waiting = [], []
        for page in pages:
            held = self.pages.getValue((page,))
            for data, frames in zip(held or (), (known, waiting)):
                if data:
                    frames.append(pa.ipc.open_stream(bytes(data)).read_pandas().assign(page=page))
        return tuple(
            pd.concat(frames, ignore_index=True)[columns] if frames else schema.empty_table().to_pandas().assign(page=0)[columns]
            for frames, schema, columns in ((known, self.known_schema, KNOWN), (waiting, self.waiting_schema, WAITING)))

    def _write(self, pages: list[int], known: pd.DataFrame, waiting: pd.DataFrame) -> None:
        parts = [
            (dict(iter(frame.drop(columns="page").groupby(frame["page"]))), schema)
            for frame, schema in ((known, self.known_schema), (waiting, self.waiting_schema))]
        for page in pages:
            self.pages.updateValue((page,), tuple(
                _bytes(frames[page], schema) if page in frames else None for frames, schema in parts))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows), ignore_index=True)
        people, items = table[table["is_person"]], table[~table["is_person"]]
        known, waiting = self._read(table["page"].unique().tolist())
        # Versions of one instant from least to greatest, nulls least; the last one counts.
        versions = people.sort_values(["at", *PERSON_FIELDS], na_position="first").drop_duplicates(["seller", "at"], keep="last")
        line = pd.concat([known.assign(at=EARLIEST), versions[[*KNOWN, "at"]]]) if len(known) else versions[[*KNOWN, "at"]]
        matched = pd.merge_asof(
            items[["at", *WAITING, "copies"]].sort_values("at", kind="stable"),
            line[["seller", "at", *PERSON_FIELDS]].assign(found=True), on="at", by="seller")
        found = matched["found"].notna()
        yield matched.loc[found, [*PERSON_FIELDS, "id", "has_id", "copies"]]

        early = matched.loc[~found, WAITING]
        all_waiting = pd.concat([waiting, early]).drop_duplicates() if len(early) else waiting
        firsts = versions.drop_duplicates("seller")
        firsts = firsts[~firsts["seller"].isin(known["seller"])]
        goes = all_waiting["seller"].isin(firsts["seller"])
        released = all_waiting[goes].merge(firsts[["seller", *PERSON_FIELDS]], on="seller")
        yield released.assign(copies=1)[[*PERSON_FIELDS, "id", "has_id", "copies"]]

        stays = all_waiting[~goes]
        changed = set(versions["page"]) | set(early["page"])
        newest = pd.concat([known, versions[KNOWN]]) if len(versions) else known
        self._write(sorted(changed), newest.drop_duplicates("seller", keep="last"), stays)

    def close(self) -> None:
        pass


def _bytes(frame: pd.DataFrame, schema: pa.Schema) -> bytes:
    return as_bytes(pa.Table.from_pandas(frame, schema, preserve_index=False))


def emit_once_stream(auction: DataFrame, person: DataFrame, *, key_type: str = "bigint",
                     salts: int | None = None, hot: Sequence | None = None) -> DataFrame:
    """``name, city, state, id``, each auction once.

    Sellers share buckets, so that a micro-batch is worked off in a few calls. The auctions of a seller are dealt over
    salts, an id always to the same one, so the waiting ids stay a set; every bucket of a seller's salts knows the seller.
    Where the sellers that may be hot are known (``hot``, the same after every restart), all others have a single salt
    and their persons a single copy.
    Copies of an auction are counted per task before they are shuffled. Rows without a seller match nothing.
    """
    spark = auction.sparkSession
    salts = salts or seller_salts(spark)
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = lambda salt: F.pmod(F.xxhash64("seller", salt), F.lit(buckets)).cast("int")
    page = F.pmod(F.xxhash64(F.lit(1), "seller"), F.lit(PAGES)).cast("int").alias("page")
    at = F.coalesce(F.unix_micros(TIME), F.lit(EARLIEST + 1))
    number, every_salt = salts_of(F.col("seller"), salts, hot, key_type)
    salt = F.pmod(F.xxhash64("id"), number).cast("int")
    items = combine_copies(auction.select(F.col("seller").cast(key_type).alias("seller"), at.alias("at"), "id").where(
        "seller IS NOT NULL").select("seller", bucket(salt).alias("bucket"), "at", "id")).select(
        "seller", "bucket", page, "at", F.coalesce("id", F.lit(0).cast("bigint")).alias("id"), F.col("id").isNotNull().alias("has_id"),
        "copies", F.lit(False).alias("is_person"), *[F.lit(None).cast("string").alias(f) for f in PERSON_FIELDS])
    sellers = person.select(F.col("id").cast(key_type).alias("seller"), at.alias("at"), *PERSON_FIELDS).where(
        "seller IS NOT NULL").select(
        "seller", F.explode(F.array_distinct(F.transform(every_salt, bucket))).alias("bucket"), page, "at",
        F.lit(0).cast("bigint").alias("id"), F.lit(False).alias("has_id"), F.lit(1).cast("bigint").alias("copies"),
        F.lit(True).alias("is_person"), *PERSON_FIELDS)
    emitted = items.unionByName(sellers).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=EmitOnceJoin(key_type), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
    copies = count_up(emitted, F.lit(1).cast("bigint"), F.col("copies"), "_copy")
    return copies.select(*PERSON_FIELDS, F.when(F.col("has_id"), F.col("id")).alias("id"))
