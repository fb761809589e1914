"""Parallel corpora: cleaning, statistics, overlap audits, example selection."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions.text import collapsed, content_tokens, jaccard, overlap_norm, stripped, word_list
from prosemill.sources.files import nfkc

# fixed values: marks of broken encodings
STRICT = ("â", "Ã")
TARGETED = (r"â\s*''", r"â\s*€\s*™", r"Ã\s*©", r"Ã\s*¹", r"Ã\s*¶", r"â\s*€\s*œ", r"â\s*€\s*")
DISAMBIGUATION = (
    r"(may (also )?refer to|may (also )?mean|might (also )?mean|is the name of|can (also )?refer to|can mean)\s*:\s*$"
)
MALFORMED = r"[,;:]\s*[.!?]$|\.\.|,,|\s,"


def is_damaged(text: Column, mode: str, strict: Sequence[str] = STRICT, targeted: Sequence[str] = TARGETED) -> Column:
    """Whether a filter of the given mode (strict, targeted, none) drops the text."""
    if mode == "none":
        return F.lit(False)
    if mode == "strict":
        out = F.lit(False)
        for mark in strict:
            out = out | text.contains(mark)
        return out
    if mode == "targeted":
        return text.rlike("|".join(f"(?:{p})" for p in targeted))
    raise ValueError(f"unknown filter {mode!r}")


def clean_pairs(pairs: DataFrame, mode: str, collapse_first: bool = False, **marks) -> DataFrame:
    """Pairs (source, target) that the filter keeps, white space collapsed; either order of the two
    steps is in use."""
    s, t = F.col("source"), F.col("target")
    if collapse_first:
        pairs = pairs.withColumn("source", collapsed(s)).withColumn("target", collapsed(t))
    kept = pairs.where(~(is_damaged(F.coalesce(s, F.lit("")), mode, **marks) | is_damaged(F.coalesce(t, F.lit("")), mode, **marks)))
    return kept.withColumn("source", collapsed(s)).withColumn("target", collapsed(t))


def split_statistics(texts: DataFrame, split: str, text: str, dropped: Column) -> DataFrame:
    """Per split: raw, dropped and kept rows, and of the kept the vocabulary and words a text.

    The words' row statistics and the vocabulary are two aggregations: the first has one row per
    split and task to shuffle, the second one per distinct word.
    """
    rows = texts.select(F.col(split).alias("split"), collapsed(F.col(text)).alias("t"), F.coalesce(dropped, F.lit(False)).alias("gone"))
    rows = rows.withColumn("w", F.when(~F.col("gone"), word_list(F.col("t"))))
    n = F.size("w")
    stats = rows.groupBy("split").agg(
        F.count("*").alias("raw"),
        F.count_if("gone").alias("dropped"),
        F.count_if(~F.col("gone")).alias("kept"),
        F.bround(F.avg(F.when(F.col("w").isNotNull(), n)), 1).alias("mean_words"),
        F.percentile(F.when(F.col("w").isNotNull(), n), F.lit(0.5)).alias("median_words"),
        F.min(F.when(F.col("w").isNotNull(), n)).cast("long").alias("min_words"),
        F.max(F.when(F.col("w").isNotNull(), n)).cast("long").alias("max_words"),
    )
    vocabulary = (
        rows.where(~F.col("gone")).select("split", F.explode(F.transform("w", F.lower)).alias("word")).distinct()
        .groupBy("split").agg(F.count("*").alias("vocabulary"))
    )
    return stats.join(vocabulary, "split", "left").withColumn("vocabulary", F.coalesce("vocabulary", F.lit(0)))


def filter_divergence(texts: DataFrame, text: str, strict: Sequence[str] = STRICT, targeted: Sequence[str] = TARGETED) -> DataFrame:
    """How two filters differ: what either, both or one only drops, and what each keeps."""
    t = F.coalesce(F.col(text), F.lit(""))
    a, b = is_damaged(t, "strict", strict), is_damaged(t, "targeted", targeted=targeted)
    return texts.select(a.alias("a"), b.alias("b")).agg(
        F.count("*").alias("total"),
        F.count_if("a").alias("strict_drops"),
        F.count_if("b").alias("targeted_drops"),
        F.count_if(F.col("a") & F.col("b")).alias("both_drop"),
        F.count_if(F.col("a") & ~F.col("b")).alias("only_strict"),
        F.count_if(F.col("b") & ~F.col("a")).alias("only_targeted"),
        F.count_if(~F.col("a")).alias("strict_keeps"),
        F.count_if(~F.col("b")).alias("targeted_keeps"),
    )


def divergence_examples(texts: DataFrame, key: str, text: str, strict: Sequence[str] = STRICT, targeted: Sequence[str] = TARGETED, n: int = 12, chars: int = 200) -> DataFrame:
    """The first n texts by key, cut short, that one of the filters drops and the other doesn't."""
    t = F.coalesce(F.col(text), F.lit(""))
    a, b = is_damaged(t, "strict", strict), is_damaged(t, "targeted", targeted=targeted)
    only = F.when(a & ~b, "strict").when(b & ~a, "targeted")
    return texts.select(key, only.alias("only"), F.substring(t, 1, chars).alias("example")).where("only is not null").orderBy(key).limit(n)


def overlap_audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (idx, text) against right (text) after normalisation: items, unique items, overlapping
    items and their share. The right side is made distinct, so its repeats don't count."""
    return _overlaps(left, right).agg(
        F.count("*").alias("left_items"),
        F.countDistinct("norm").alias("left_unique"),
        F.count("hit").alias("overlapping"),
        F.bround(100.0 * F.count("hit") / F.greatest(F.count("*"), F.lit(1)), 2).alias("overlap_pct"),
    )


def _overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """left's idx and normal form, and ``hit`` where right has it; both in compatibility form first."""
    l = nfkc(left.select("idx", "text"), "text").select("idx", "text", overlap_norm(F.col("text")).alias("norm"))
    r = nfkc(right.select("text"), "text").select(overlap_norm(F.col("text")).alias("norm")).distinct().withColumn("hit", F.lit(1))
    return l.join(r, "norm", "left")


def overlap_examples(left: DataFrame, right: DataFrame, n: int = 5, chars: int = 220) -> DataFrame:
    """Indices of left's overlapping items, and of the first n also the text, cut short."""
    hits = _overlaps(left, right).where("hit is not null").select("idx", "text")
    first = hits.orderBy("idx").limit(n).select(F.col("idx").alias("i"), F.substring("text", 1, chars).alias("example"))
    return hits.join(F.broadcast(first), F.col("idx") == F.col("i"), "left").select("idx", "example")  # n rows


def exact_duplicates(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Groups of texts that are equal after normalisation: smallest key and number of copies."""
    return (
        nfkc(texts.select(key, text), text).select(key, overlap_norm(F.col(text)).alias("norm")).where("norm != ''").groupBy(F.sha2("norm", 256).alias("norm_sha"))
        .agg(F.min(key).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    )


#: Counters for the order of tokens, and 64-bit words of a set's signature.
COUNTERS, SIGNATURE = 1 << 20, 8


def jaccard_matches(left: DataFrame, right: DataFrame, percent: int = 90) -> DataFrame:
    """Pairs of left (lid, text) and right (rid, text) whose sets of normalised tokens have a
    Jaccard similarity of ``percent`` or more.

    Equal sets are one class, whose ids are put back at the end. Exact prefix filtering: with tokens
    in one order, best from rare to common, two such sets have their first common token among their
    first size - ceil(percent * size) + 1 tokens, so only those are joined on. There a pair goes on if
    as many common tokens as it needs can still follow in both sets, and if few enough bits of the sets'
    signatures differ: each such bit stands for a token that one set has alone. What is left is compared.
    """
    l, r = _classes(left, "lid"), _classes(right, "rid")
    slot = F.explode(F.transform(F.array_distinct(_tokens(right)), lambda w: F.pmod(F.xxhash64(w), F.lit(COUNTERS))))
    counted = right.select(slot.alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).toArrow()  # COUNTERS rows at most
    counts = np.zeros(COUNTERS, np.int64)
    counts[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    counts = left.sparkSession.sparkContext.broadcast(counts)

    a, b = (_prefixes(x, counts, percent).toDF("token", *[f"{k}{c}" for c in ("", "_n", "_at", *range(SIGNATURE))]) for x, k in ((l, "lid"), (r, "rid")))
    n, m = F.col("lid_n"), F.col("rid_n")
    differ = sum((F.bit_count(F.col(f"lid{i}").bitwiseXOR(F.col(f"rid{i}"))) for i in range(SIGNATURE)), F.lit(0))
    needed = percent * (n + m)
    follow = (100 + percent) * (1 + F.least(n - F.col("lid_at"), m - F.col("rid_at"))) >= needed
    pairs = a.hint("merge").join(b, (a["token"] == b["token"]) & follow & ((100 + percent) * (n + m - differ) >= 2 * needed)).select("lid", "rid").distinct()
    x, y = l.toDF("lid", "a", "lids"), r.toDF("rid", "b", "rids")
    both, union = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    found = pairs.join(x, "lid").join(y, "rid").where(100 * both >= percent * union).select("lids", "rids", jaccard(F.col("a"), F.col("b")).alias("jaccard"))
    return found.select(F.explode("lids").alias("lid"), "rids", "jaccard").select("lid", F.explode("rids").alias("rid"), "jaccard")


def _tokens(df: DataFrame) -> Column:
    return F.split(overlap_norm(df["text"]), " ")


def _classes(df: DataFrame, k: str) -> DataFrame:
    """The distinct sets of tokens: a hash that leads back to them, tokens, and the ids that have them."""
    rows = df.select(k, F.array_sort(F.array_distinct(_tokens(df))).alias("tokens")).where(F.get("tokens", F.lit(0)) != "")
    return rows.groupBy("tokens").agg(F.collect_list(k).alias("ids")).select(F.xxhash64("tokens").alias("key"), "tokens", "ids")


def _prefixes(classes: DataFrame, counts, percent: int) -> DataFrame:
    """Rows (token, key, size of the set, the token's place from 1, signature) of each set's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, tokens = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy()
            size = pc.list_value_length(batch.column(1)).to_numpy().astype(np.int64)
            begin = np.cumsum(size) - size
            row = np.repeat(np.arange(len(keys)), size)
            bits = tokens.view(np.uint64)
            bit = np.uint64(1) << (bits & np.uint64(63))
            word = bits >> np.uint64(6) & np.uint64(SIGNATURE - 1)
            signature = [np.bitwise_or.reduceat(np.where(word == np.uint64(w), bit, np.uint64(0)), begin).view(np.int64) for w in range(SIGNATURE)]
            order = np.lexsort((tokens, counts.value[tokens % COUNTERS], row))
            at = np.arange(len(tokens)) - begin[row] + 1
            keep = at <= (size + percent * -size // 100 + 1)[row]
            of = row[keep]
            columns = [tokens[order][keep], keys[of], size[of], at[keep], *[x[of] for x in signature]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "key", "n", "at", *[f"s{i}" for i in range(SIGNATURE)]])

    hashed = classes.select("key", F.transform("tokens", lambda w: F.xxhash64(w)))
    return hashed.mapInArrow(run, "token long, key long, n long, at long, " + ", ".join(f"s{i} long" for i in range(SIGNATURE)))


def well_formed(text: Column) -> Column:
    t = stripped(text)
    return t.rlike(r"^\p{Lu}") & t.rlike(r"[.!?]$") & ~t.rlike(MALFORMED)


def retains_meaning(source: Column, reference: Column, least: float = 0.5) -> Column:
    r = content_tokens(reference)
    share = F.size(F.array_intersect(r, content_tokens(source))) / F.size(r)
    return F.coalesce((F.size(r) > 0) & (share >= least), F.lit(False))


def seeded_indices(total: int, n: int, seed: int) -> list[int]:
    """Ascending indices as random.Random(seed).sample draws them."""
    return sorted(random.Random(seed).sample(range(total), min(n, total)))


def seeded_sample(rows: DataFrame, n: int, seed: int, idx: str = "idx") -> DataFrame:
    """The rows whose dense index was drawn; n is a bounded sample size."""
    drawn = [(i,) for i in seeded_indices(rows.count(), n, seed)]
    chosen = rows.sparkSession.createDataFrame(drawn, f"{idx} long")
    return rows.join(F.broadcast(chosen), idx, "left_semi")


def select_examples(pairs: DataFrame, order: DataFrame, n: int = 3, least_words: int = 20) -> DataFrame:
    """The first n pairs (idx, source, references) in the order (idx, rank) whose source is long
    enough and that have a well-formed reference which keeps the meaning; the first such one."""
    fit = F.filter("references", lambda r: well_formed(r) & retains_meaning(F.col("source"), r))
    found = pairs.where(F.size(word_list(F.col("source"))) >= least_words).withColumn("reference", stripped(F.get(fit, F.lit(0))))
    return found.where("reference is not null and reference != ''").join(order, "idx").orderBy("rank").limit(n).select("idx", "rank", "source", "reference")


def excluded(rows: DataFrame, gone: DataFrame, idx: str = "idx") -> DataFrame:
    """Rows whose index isn't listed; a listed index that no row has is an error."""
    unknown = gone.join(rows, idx, "left_anti").limit(1).count()
    if unknown:
        raise ValueError("an index to exclude is out of range")
    return rows.join(gone, idx, "left_anti")


def aligned(left: DataFrame, right: DataFrame, idx: str = "idx") -> DataFrame:
    """Position-wise 1:1 join; sides of unequal length are an error."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows on one side, {m} on the other")
    return left.join(right, idx)


