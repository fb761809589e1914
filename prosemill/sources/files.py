"""Files in and out, all through Spark, so any store that it reaches will do."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one text file with dense numbers from 0, in file order.

    Partitions keep file order, so a line's number is its place in its partition and the sizes of
    those before it; only one count a partition is gathered for that.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("mid"))
    part = F.shiftright("mid", 33)
    sizes = lines.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("part", before.alias("base"))
    return lines.withColumn("part", part).join(base, "part").select((F.col("base") + F.col("mid").bitwiseAND((1 << 33) - 1)).alias("idx"), "line")


def read_pairs(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Two line-aligned files as idx, source, target; files of unequal length are an error."""
    s, t = numbered_lines(spark, source), numbered_lines(spark, target)
    n, m = s.count(), t.count()
    if n != m:
        raise ValueError(f"{source} has {n} lines, {target} {m}")
    return s.withColumnRenamed("line", "source").join(t.withColumnRenamed("line", "target"), "idx")


def head(rows: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    """The first n rows by index, not a sample."""
    return rows.where(F.col(idx) < n)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """A partial run's records (index, prediction) from JSON lines of any of its shapes: malformed
    lines are dropped, the last record of an index counts."""
    schema = "index long, idx long, i long, prediction string, output string, text string, _bad string"
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = raw.where("_bad is null").select(
        F.coalesce("index", "idx", "i").alias("index"), F.coalesce("prediction", "output", "text").alias("prediction"), F.monotonically_increasing_id().alias("at")
    )
    return rows.where("index is not null").groupBy("index").agg(F.max_by("prediction", "at").alias("prediction"))


def to_do(rows: DataFrame, done: DataFrame, idx: str = "index") -> DataFrame:
    """What a resumed run still has to do."""
    return rows.join(done.select(idx), idx, "left_anti")


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The path of the file changed last."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")  # contents aren't read
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    return row.p if row else None


def as_json(rows: DataFrame, *keys: str, name: str = "json") -> DataFrame:
    """One JSON object a row, keys in the given order, null ones left out."""
    return rows.select(F.to_json(F.struct(*keys)).alias(name))


def with_provenance(rows: DataFrame, run: str, commit: str) -> DataFrame:
    return rows.withColumn("provenance", F.struct(F.lit(run).alias("run"), F.lit(commit).alias("commit"), F.current_timestamp().alias("recorded_at")))


def refuse_other_run(known: DataFrame, model: str, seed: int) -> None:
    """Stops before records of another model or seed are reused; rows without identity pass."""
    other = known.where(F.col("model").isNotNull() & ((F.col("model") != model) | ~F.col("seed").eqNullSafe(F.lit(seed)))).limit(1).count()
    if other:
        raise ValueError("these records belong to another run")


def nfkc(rows: DataFrame, text: str) -> DataFrame:
    """rows with the text in Unicode's compatibility form; ASCII texts, which it doesn't change,
    come back as they are."""
    import unicodedata

    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return rows.mapInArrow(run, rows.schema)
