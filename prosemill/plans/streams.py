"""Streaming queries; each drains its stream, so its rows are those of the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.plans.registry import query, table
from prosemill.streaming import operators as op


@query("""SELECT event_type AS key, sum(CASE WHEN value < 5 THEN -1 ELSE 1 END) AS tally, count(*) AS rows FROM events GROUP BY event_type""")
def streamed_retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = op.source(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.when(F.col("value") < 5, -1).otherwise(1).alias("delta"))
    return op.latest(op.drained(op.tally(e, "key", "delta"), "update"), "key")


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS events FROM s GROUP BY user_id""")
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = op.drained(op.sessions(op.source(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", "6 hours", "40 days"), "complete")
    last = s.join(F.broadcast(s.agg(F.max("_batch").alias("_batch"))), "_batch")  # one row
    return last.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("""WITH m AS (SELECT max(ts) AS upto FROM events), e AS (SELECT event_type, ts < m.upto - INTERVAL 10 DAY AS late FROM events, m) SELECT event_type, count(*) FILTER (NOT late) AS in_time, count(*) FILTER (late) AS late FROM e GROUP BY event_type""")
def late_rows_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's rows held against a watermark that is known beforehand."""
    upto = table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("upto"))
    counts = op.counted_late(op.source(spark, sf_dir, "events").select("event_type", "ts"), "event_type", "ts", upto, "10 days")
    return op.latest(op.drained(counts, "update"), "event_type")


_FREE = f"(f.owner IS NULL OR a.since - f.seen > {op.STALE_SECONDS})"


@query(f"""WITH RECURSIVE a AS MATERIALIZED (SELECT user_id % 10 AS lock, user_id::VARCHAR AS who, epoch_us(ts) / 1e6 AS since, event_type = 'error' AS frees, row_number() OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts), user_id::VARCHAR) AS k FROM events),
f AS (SELECT DISTINCT lock, 0::BIGINT AS k, NULL::VARCHAR AS owner, 0::DOUBLE AS seen, 0::BIGINT AS taken FROM a UNION ALL
 SELECT f.lock, a.k, CASE WHEN a.frees THEN nullif(f.owner, a.who) WHEN {_FREE} THEN a.who ELSE f.owner END, CASE WHEN NOT a.frees AND ({_FREE} OR f.owner = a.who) THEN a.since ELSE f.seen END,
  f.taken + (NOT a.frees AND {_FREE} AND f.owner IS DISTINCT FROM a.who)::BIGINT FROM f JOIN a ON a.lock = f.lock AND a.k = f.k + 1)
SELECT lock, arg_max(struct_pack(x := owner), k).x AS owner, arg_max(seen, k) AS seen, max(taken) AS taken FROM f GROUP BY lock""")
def streamed_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = op.source(spark, sf_dir, "events")
    actions = e.select(
        (F.col("user_id") % 10).alias("lock"), F.col("user_id").cast("string").alias("who"), F.unix_micros("ts").cast("double").alias("us"), F.when(F.col("event_type") == "error", "release").otherwise("beat").alias("action")
    )
    return op.latest(op.drained(op.locks(actions.select("lock", "who", (F.col("us") / 1e6).alias("at"), "action")), "update"), "lock")


@query("""SELECT event_type AS model, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 8 AS batch, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 8 AS place FROM events""")
def micro_batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), "event_id")
    return op.micro_batches(e, "model", "event_id").select("model", "event_id", F.col("batch").cast("long").alias("batch"), F.col("place").cast("long").alias("place"))


@query("""SELECT conv_id AS session_id, count(*) AS entries, max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def streamed_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metadata kept by foreachBatch: counts add up, the last turn is the largest."""
    state = op.shared_folder(spark)
    c = op.source(spark, sf_dir, "conversations")

    def fold(batch: DataFrame, old: DataFrame | None) -> DataFrame:
        new = batch.groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("entries"), F.max("turn").alias("last_turn"))
        both = new.unionByName(old) if old is not None else new
        return both.groupBy("session_id").agg(F.sum("entries").alias("entries"), F.max("last_turn").alias("last_turn"))

    op.upsert_batches(c, "session_id", state, fold)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(state)
    listed = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    newest = max(int(f.getPath().getName()[1:]) for f in listed if f.getPath().getName().startswith("v"))
    return spark.read.parquet(f"{state}/v{newest}")
