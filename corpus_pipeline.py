"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; run()
writes each stage's rows as Parquet in the shared folder and reads them again for the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm.common import parts_of, read, saved, texts_in
from prosemill.llm.near_dedup import near_duplicates
from prosemill.llm.packing import packed
from prosemill.llm.secrets import Scanner, redacted
from prosemill.llm.substring_dedup import repeated_passages
from prosemill.llm.toxicity import THRESHOLD, fit, training_rows

#: The packed sequences' length in tokens.
CAPACITY = 1024


def _with_texts(batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
    """The batch with other texts, and with their lengths where it has n_chars."""
    new = {"text": texts, "n_chars": [None if t is None else len(t) for t in texts]}
    return pa.RecordBatch.from_arrays(
        [pa.array(new[f.name], f.type) if f.name in new else c for c, f in zip(batch.columns, batch.schema, strict=True)], schema=batch.schema
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; null and empty texts stay."""
    model = spark.sparkContext.broadcast(fit(training_rows(docs, read(spark, sf_dir, "labels"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in parts_of(batches, "text", 1 << 20):
            yield batch.filter(pa.array([s < THRESHOLD for s in own.scores(texts_in(batch, "text"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more):
    that of smallest doc_id. Rows without doc_id stay. Rows that share a doc_id are told apart by
    their texts."""
    gone = near_duplicates(docs, n=5, percent=80).where("not first").select("doc_id", "row").distinct()
    return _by_row(docs).join(gone.hint("merge"), ["doc_id", "row"], "left_anti").select(docs.columns)


def _by_row(docs: DataFrame) -> DataFrame:
    """docs, and the hash of the text by which operators tell rows of one doc_id apart."""
    return docs.withColumn("row", F.xxhash64(F.col("text").cast("string")))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier document has too. Every
    document stays; its other words are unchanged. Rows that share a doc_id lose what was found in
    their own text."""
    found = repeated_passages(docs, words=50, n=5, percent=80)
    cuts = found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "end")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "text", 4 << 20):
            texts = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                texts.append(without(text, [(c["start"], c["end"]) for c in cuts]) if cuts and text else text)
            yield _with_texts(batch.drop_columns("cuts"), texts)

    joined = _by_row(docs).join(cuts.hint("merge"), ["doc_id", "row"], "left").select(*docs.columns, "cuts")
    return joined.mapInArrow(run, docs.schema)


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without the given stretches, each with the white space after it."""
    out, at = [], 0
    for a, b in sorted(cuts):
        if b <= at:
            continue
        out.append(text[at : max(at, a)])
        at = b
        while at < len(text) and text[at] in " \t\n\v\f\r":
            at += 1
    return "".join(out) + text[at:]


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in them replaced by a mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner()
        for batch in parts_of(batches, "text", 4 << 20):
            yield _with_texts(batch, [t and redacted(t, own.spans(t)) for t in batch.column("text").to_pylist()])

    return docs.mapInArrow(run, docs.schema)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of CAPACITY tokens."""
    return packed(docs, capacity=CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: No stage has a SQL counterpart; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
