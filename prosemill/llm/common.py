"""What the operators of this subpackage share: scratch tables, word hashes, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
GOLDEN = 0x9E3779B97F4A7C15


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table, dealt to all cores where its files have fewer splits than there are cores; larger
    tables are read as they lie."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def scratch(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is read from ``spark.checkpoint.dir``. Only a local master, where driver and executors are
    one process, may go without; a cluster without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='prosemill-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, so a lost executor
    costs only the tasks at hand. The files go when the JVM ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = where
    return out


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing to come reads."""
    for df in tables:
        where = df._scratch
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs (doc_id, text, row = xxhash64 of the text) with ids of which none stands for two texts.

    Where doc_ids repeat with different texts, all rows are numbered anew in the order of doc_id and
    row; the second result then has the new numbers: doc_id, row, own. Rows without doc_id have no
    number. Else docs are as they are, and there is no second result.
    """
    named = docs.where("doc_id is not null")
    if named.groupBy("doc_id").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a != b").isEmpty():
        return docs, None
    names = saved(named.select("doc_id", "row").distinct().orderBy("doc_id", "row").withColumn("own", F.monotonically_increasing_id()), "names")
    own = names.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "own")
    both = docs.join(own, (docs["doc_id"] == own["d"]) & (docs["row"] == own["r"]), "left")
    return both.select(F.col("own").alias("doc_id"), *[c for c in docs.columns if c != "doc_id"]), names


_holder = None


def hold(owner) -> None:
    """``owner`` may remember things in this process from now on; what another one remembered goes by its
    forget(). A Python worker outlives a stage, and memory that one operator fills is the next one's."""
    global _holder
    if _holder is owner:
        return
    if _holder is not None:
        _holder.forget()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
            ctypes.CDLL(None).malloc_trim(0)
    _holder = owner


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, cast; every other column, whatever its name, is left behind.

    pick(df, doc_id="long", text="string"). Columns whose names differ from a wanted one in case
    only don't clash: the exact spelling wins.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    out = []
    for name, kind in wanted.items():
        if name not in names:
            raise ValueError(f"the table has no column {name}")
        out.append(F.col(f"c{names.index(name)}").cast(kind).alias(name))
    return plain.select(*out)


def texts_in(batch: pa.RecordBatch, name: str) -> list[str]:
    """A column of strings; null is ''."""
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def parts_of(batches: Iterator[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the strings of each hold about ``most`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


# --------------------------------------------------------------------------- hashes of words

_MULT = [U64(int(x) | 1) for x in np.random.default_rng(20240611).integers(1, 2**63, 64, dtype=np.uint64)]
_BYTE = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's last steps."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of several texts, A-Z lowered, as 64-bit hashes.

    ``first[i]:first[i + 1]`` are the words of text i; ``start`` and ``end`` their byte offsets in
    the text's UTF-8.
    """

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        low, high = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[low:high] if raw is not None and high > low else np.zeros(0, np.uint8)
        offsets = offsets - low
        inside = ~_SPACE[data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        opens[cuts] = inside[cuts]
        closes[cuts - 1] = inside[cuts - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        size = end - start
        self.first = np.searchsorted(start, offsets).astype(np.int64)
        self.first[-1:] = len(start)
        if len(start):
            power = np.full(int(size.max()), _BASE, U64)
            power[0] = 1
            power = np.multiply.accumulate(power)
            at = np.flatnonzero(inside)
            begins = np.concatenate(([0], np.cumsum(size)[:-1]))
            place = np.arange(len(at)) - np.repeat(begins, size)
            self.hash = mix(np.add.reduceat(_BYTE[data[at]] * power[place], begins) + size.astype(U64))
        else:
            self.hash = np.zeros(0, U64)
        doc = np.repeat(offsets[:-1], np.diff(self.first)) if len(column) else np.zeros(0, np.int64)
        self.start, self.end = start - doc, end - doc

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word shingles in order, and for each text where its own begin (one more
        at the end). A text of 1 to n - 1 words has one: the whole sequence."""
        count = np.diff(self.first)
        each = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
        first = np.concatenate(([0], np.cumsum(each)))
        padded = np.concatenate((self.hash, np.zeros(n, U64)))
        total = len(self.hash)
        whole = np.zeros(total, U64)
        for j in range(n):
            whole += padded[j : j + total] * _MULT[j]
        keep = np.arange(total) - np.repeat(self.first[:-1], count) < np.repeat(each, count)
        out = mix(whole[keep] + U64(n))
        for i in np.flatnonzero((count > 0) & (count < n)):
            own = self.hash[self.first[i] : self.first[i + 1]]
            out[first[i]] = mix((own * np.array(_MULT[: len(own)], U64)).sum(dtype=U64, keepdims=True) + U64(1000 + len(own)))[0]
        return out, first


# --------------------------------------------------------------------------- components

def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (u long, v long): rows (node, component), component the
    smallest node reachable. Union-find by alternating large-star and small-star steps, which hang
    every node on the smallest neighbour; each round's table is written, so no plan grows.

    A hub's edges all have one key. The least neighbours are found by partial aggregation and
    written before edges are joined with them, so that a hub's part of the join can be split."""
    e = saved(
        edges.where("u is not null and v is not null and u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    state = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "least")
        large = saved(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        own = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(own, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, saved(small.unionByName(own.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(old, least, large, own)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
