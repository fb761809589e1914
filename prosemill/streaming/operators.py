"""Streaming forms of the run log's operators, and a runner that drives them over what is there."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

STALE_SECONDS = 15
BATCH_SIZE, BATCH_SECONDS = 8, 0.1


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; only a local master
    may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='prosemill-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern may name one file
    return rows.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else c for c, t in rows.dtypes])


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns its result table, read from the shared
    folder; with mode "update" each batch's rows are kept with their batch number."""
    spark = stream.sparkSession
    folder = shared_folder(spark)

    schema = StructType([*stream.schema.fields, StructField("_batch", LongType())])
    spark.createDataFrame([], schema).write.parquet(f"{folder}/out/none")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/b{number}")

    (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        .foreachBatch(write).start().awaitTermination()
    )
    return spark.read.schema(schema).parquet(f"{folder}/out/*")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The last version of each key of an update stream."""
    values = [c for c in rows.columns if c not in keys and c != "_batch"]
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v"))
    return kept.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def sessions(events: DataFrame, user: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of a user closed by a gap, final once the watermark has passed them."""
    return events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tally(events: DataFrame, key: str, delta: str) -> DataFrame:
    """A running tally with retractions: rows carry +1 or -1 and add up by key."""
    return events.groupBy(key).agg(F.sum(delta).alias("tally"), F.count("*").alias("rows"))


def counted_late(events: DataFrame, by: str, ts: str, upto: DataFrame, allowed: str) -> DataFrame:
    """Of a stream, rows in time and late ones by key; ``upto`` is one row with the watermark."""
    late = F.coalesce(F.col(ts) < F.col("upto") - F.expr(f"INTERVAL {allowed}"), F.lit(False))
    return events.join(F.broadcast(upto)).groupBy(by).agg(F.count_if(~late).alias("in_time"), F.count_if(late).alias("late"))  # one row


def _lock(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Owner, time of the last heartbeat and how often the lock was taken over.

    An owner keeps the lock by heartbeats; another takes it once it is stale; only the owner frees
    it."""
    owner, seen, taken = state.get if state.exists else (None, 0.0, 0)
    for row in pd.concat(list(batches)).sort_values(["at", "who"]).itertuples():
        free = owner is None or row.at - seen > STALE_SECONDS
        if row.action == "release":
            if owner == row.who:
                owner = None
        elif free and owner != row.who:
            taken, owner, seen = taken + 1, row.who, row.at
        elif owner == row.who:
            seen = row.at
    state.update((owner, seen, taken))
    yield pd.DataFrame({"lock": [key[0]], "owner": [owner], "seen": [seen], "taken": [taken]})


def locks(actions: DataFrame) -> DataFrame:
    """actions (lock, who, at double seconds, action) as the state of each lock."""
    return actions.groupBy("lock").applyInPandasWithState(
        _lock, "lock long, owner string, seen double, taken long", "owner string, seen double, taken long", "update", GroupStateTimeout.NoTimeout
    )


def upsert_batches(stream: DataFrame, key: str, state: str, fold: Callable[[DataFrame, DataFrame | None], DataFrame]) -> None:
    """A keyed table kept by batches: each batch is folded into the table's last version, which is
    written beside the old one, so a failed batch leaves the old version whole."""
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        old = spark.read.parquet(f"{state}/v{number - 1}") if number else None
        fold(batch, old).write.mode("overwrite").parquet(f"{state}/v{number}")

    stream.writeStream.option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()


def micro_batches(requests: DataFrame, model: str, order: str, size: int = BATCH_SIZE) -> DataFrame:
    """Requests numbered into batches of one model each, in order: the batch form of filling a queue
    up to ``size``."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(model).orderBy(order)) - 1
    return requests.withColumn("batch", F.floor(at / size)).withColumn("place", at % size)
