"""Approximate nearest neighbours by a forest of sorted hash strings.

Each tree turns a vector by a random rotation of its own; the string names the coordinates of largest
magnitude and their signs, the largest first (cross-polytope hashing, which needs far fewer trees
than signs of single projections). A tree is the sorted array of its strings. A query descends in all
trees to its longest prefixes and ascends in all of them together, one symbol at a time, until it has
enough different candidates; those that the last step adds are taken by the number of trees in which
they share the prefix. Candidates are scored exactly.

The index is dealt into shards of bounded size, by length of the vectors first: inner products rank
vectors of like length as angles do. Each shard's forest is built once, by the task that holds it, and
the stated queries stream past it in batches. A shard keeps its best k a query; the k best of all
shards are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.llm.common import pick, saved

TREES, SYMBOLS = 256, 6
SHARD = 8192
#: Different candidates that a query ascends for: this share of the shard, and so many times k at
#: least. README has the recall that this gives.
SHARE, TIMES_K = 0.12, 6
#: Vectors of one shard differ in length by a factor of 2 ** (1 / BANDS) at most.
BANDS = 4
SEED = 11


@lru_cache(maxsize=4)
def rotations(dim: int) -> np.ndarray:
    """TREES random rotations, (number, dim, dim)."""
    rng = np.random.default_rng(SEED)
    return np.stack([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(TREES)]).astype(np.float32)


def symbols(dim: int) -> int:
    """Symbols of a string: SYMBOLS, or as many as there are coordinates or fit into 63 bits."""
    return max(1, min(SYMBOLS, dim, int(63 / np.log2(2 * dim + 1))))


def hash_strings(x: np.ndarray) -> np.ndarray:
    """(TREES, rows) strings as integers of base 2 * dim, the first symbol leading."""
    rows, dim = np.arange(len(x)), x.shape[1]
    out = np.zeros((TREES, len(x)), np.int64)
    scaled = (x / np.abs(x).max(axis=1, keepdims=True)).astype(np.float32)
    for t, r in enumerate(rotations(dim)):
        y = scaled @ r
        size = np.abs(y)
        for _ in range(symbols(dim)):
            best = size.argmax(axis=1)
            out[t] = out[t] * (2 * dim) + 2 * best + (y[rows, best] > 0)
            size[rows, best] = -1
    return out


class Forest:
    def __init__(self, x: np.ndarray):
        self.x, self.base, self.length = x, 2 * x.shape[1], symbols(x.shape[1])
        strings = hash_strings(x)
        order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, order, axis=1)
        self.order = order.astype(np.int32).ravel()
        self.tree = np.arange(TREES) * len(x)

    def candidates(self, queries: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query the rows that share a prefix with it in some tree, the prefixes as long as
        still give ``least`` rows; all rows only where no prefix at all gives as many."""
        strings = hash_strings(queries)
        ranges = []
        for cut in range(self.length):  # symbols cut off at the end
            unit = self.base**cut
            low = strings // unit * unit
            ends = [np.searchsorted(s, np.concatenate((a, a + unit))) for s, a in zip(self.sorted, low, strict=True)]
            a, b = np.split(np.stack(ends, axis=1), 2)
            ranges.append((a + self.tree, b - a))
        for q in range(len(queries)):
            votes = np.zeros(len(self.x), np.int64)
            for start, size in ranges:
                start, size = start[q], size[q]
                total = int(size.sum())
                at = np.arange(total) + np.repeat(start - np.cumsum(size) + size, size)
                votes += np.bincount(self.order[at], minlength=len(votes))
                found = np.flatnonzero(votes)
                if len(found) >= least:
                    share = votes[found]
                    yield found[share >= np.partition(share, len(share) - least)[len(share) - least]]
                    break
            else:
                yield np.arange(len(self.x))


def _answers(forest: Forest, ids: np.ndarray, asked: pa.RecordBatch, k: int) -> pa.RecordBatch:
    x = _matrix(asked.column("v"))
    query_ids, rows = (asked.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row"))
    least = min(len(ids), max(TIMES_K * k, int(SHARE * len(ids))) + 1)  # itself may be one of them
    parts: list[tuple] = []
    for q, found in enumerate(forest.candidates(x, least)):
        found = found[ids[found] != query_ids[q]]
        score = (forest.x[found] * x[q]).sum(axis=1)
        if len(found) > k:  # ties with the k-th stay for the order below
            top = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
            found, score = found[top], score[top]
        best = np.lexsort((ids[found], -score))[:k]
        parts.append((np.full(len(best), query_ids[q]), np.full(len(best), rows[q]), ids[found[best]], score[best]))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "row", "vec_id", "score"])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, np.float64).reshape(len(column), -1)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """cell, query, vec_id, row, v: sorted by the first two, so a shard's rows come before its
        queries. One forest is held at a time."""
        at, held, forest, ids = None, [], None, None
        for batch in batches:
            cell, query = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            key = np.stack((cell, query.astype(np.int64)), axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)] if len(key) else []
            for a, b in zip(cuts, cuts[1:]):
                if cell[a] != at:
                    at, held, forest = cell[a], [], None
                part = batch.slice(a, b - a)
                if not query[a]:
                    held.append(part)
                elif held or forest:
                    if forest is None:
                        forest = Forest(np.concatenate([_matrix(p.column("v")) for p in held]))
                        ids = np.concatenate([p.column("vec_id").to_numpy() for p in held])
                        held = []
                    yield _answers(forest, ids, part, k)

    return run


def nearest(vectors: DataFrame, is_query: Column | None = None, k: int = 20) -> DataFrame:
    """The k rows of vectors (vec_id, embedding) of largest inner product found for each query row:
    query_id long, rank int from 1, vec_id long, score double; nearest first, ties to the smaller
    vec_id. Queries are the rows where ``is_query`` holds (default: vec_id divisible by 20).

    Scores are of the original components in double precision. Rows without vec_id take no part,
    nor do vectors that are null, empty, zero or hold null or non-finite components; vectors of
    different lengths don't meet. A query's own vec_id is never among its answers; repeated query
    rows are answered once, repeated candidates are each an answer. With fewer than k candidates all
    are returned. Other columns are left behind; an empty table gives an empty result.
    """
    v = F.col("v")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    band = F.round(F.log2(squares) / 2 * BANDS)  # null where the squares are too small to add up
    band = F.greatest(F.lit(-9999), F.least(F.lit(9999), F.coalesce(band, F.lit(-9999)))).cast("int")
    rows = (
        pick(vectors, vec_id="long", embedding="array<double>").withColumnRenamed("embedding", "v")
        .where("vec_id is not null and v is not null").where(~F.exists(v, bad) & F.exists(v, lambda x: x != 0))
        .select("vec_id", "v", F.xxhash64("vec_id", "v").alias("row"), F.size("v").alias("dim"), band.alias("band"))
    )
    is_query = is_query if is_query is not None else F.col("vec_id") % 20 == 0
    counts = saved(rows.groupBy("dim", "band").agg(F.ceil(F.count("*") / SHARD).alias("shards")), "shards")
    cell = F.xxhash64("dim", "band", "shard").alias("cell")
    spread = F.pmod(F.xxhash64("row", F.lit(7)), F.col("shards")).alias("shard")
    base = rows.join(counts, ["dim", "band"]).select("*", spread).select(cell, F.lit(False).alias("query"), "vec_id", "row", "v")
    cells = counts.select("dim", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    asked = rows.where(is_query).dropDuplicates(["vec_id", "row"]).drop("band")
    asked = asked.join(cells, "dim").select(cell, F.lit(True).alias("query"), "vec_id", "row", "v")
    found = (
        base.unionByName(asked).repartition("cell").sortWithinPartitions("cell", "query")
        .mapInArrow(_search(k), "query_id long, row long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
