"""Reference metrics from n-gram counts, and paired bootstrap tests.

Rows are (idx, source, candidate, references array). Each metric deals the rows by idx once, before
it explodes the n-grams of all sides; all that follows by document, order and n-gram stays within a
partition, so texts are shuffled and n-grams never are. Nothing is joined.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions.text import ngrams, ptb_sentences

ORDERS = (1, 2, 3, 4)


def _split(text: Column) -> Column:
    return F.split(F.lower(text), " ")


def by_idx(rows: DataFrame) -> DataFrame:
    """The rows dealt by idx, so that aggregates by idx and more need no exchange."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "idx")


def gram_counts(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, n, gram and s, c, t: counts in the source, the candidate and all references."""
    sides = [("s", F.array("source")), ("c", F.array("candidate")), ("t", F.col("references"))]

    def grams(texts: Column, side: str, n: int) -> Column:
        each = F.flatten(F.transform(texts, lambda x: ngrams(_split(x), n)))
        return F.transform(each, lambda g: F.struct(F.lit(side).alias("side"), F.lit(n).alias("n"), g.alias("gram")))

    parts = [grams(texts, side, n) for side, texts in sides for n in ORDERS]
    long = by_idx(rows).select(*keep, F.explode(F.flatten(F.array(*parts))).alias("x"))
    return long.groupBy(*keep, "x.n", "x.gram").agg(*[F.count_if(F.col("x.side") == side).alias(side) for side, _ in sides])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def document_sari(rows: DataFrame, sentences=ptb_sentences) -> DataFrame:
    """D-SARI of each row: idx, keep, deletion, addition, d_sari (0 to 1).

    Counts of source and candidate are multiplied by the number of references; deletion counts
    precision only; addition is over distinct n-grams; lengths and sentence counts penalise."""
    r = F.size("references")
    length = lambda c: F.size(F.split(F.lower(c), " "))
    mean = lambda f: F.floor(F.aggregate(F.transform("references", f), F.lit(0), lambda a, x: a + x) / r).cast("int")
    head = rows.select(
        "idx", "source", "candidate", "references", r.alias("r"), length(F.col("candidate")).alias("o"), length(F.col("source")).alias("i"),
        mean(lambda x: F.size(F.split(F.lower(x), " "))).alias("ref"), sentences(F.lower("candidate")).alias("so"), mean(lambda x: sentences(F.lower(x))).alias("sr"),
    )
    keys = ["idx", "r", "o", "i", "ref", "so", "sr"]
    g = gram_counts(head, keys)
    s, c, t = F.col("s") * F.col("r"), F.col("c") * F.col("r"), F.col("t")
    k = F.least(s, c)
    good, all_ = F.least(k, t), F.least(s, t)
    d = F.greatest(s - c, F.lit(0))
    kept = F.greatest(d - t, F.lit(0))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    by_n = g.groupBy(*keys, "n").agg(
        _ratio(total(F.when(k > 0, good / k)), F.count_if(k > 0)).alias("kp"), _ratio(total(F.when(all_ > 0, good / all_)), F.count_if(all_ > 0)).alias("kr"),
        _ratio(total(F.when(d > 0, kept / d)), F.count_if(d > 0)).alias("dp"),
        _ratio(F.count_if((c > 0) & (s == 0) & (t > 0)), F.count_if((c > 0) & (s == 0))).alias("ap"), _ratio(F.count_if((c > 0) & (s == 0) & (t > 0)), F.count_if((t > 0) & (s == 0))).alias("ar"),
    )
    n = len(ORDERS)
    mean_n = by_n.groupBy(*keys).agg(
        (F.sum(_f1(F.col("kp"), F.col("kr"))) / n).alias("k"), (F.sum("dp") / n).alias("d"), (F.sum(_f1(F.col("ap"), F.col("ar"))) / n).alias("a")
    )
    o, i, ref, so, sr = (F.col(x) for x in ("o", "i", "ref", "so", "sr"))
    lp1 = F.when(o >= ref, 1.0).otherwise(F.exp((o - ref) / F.greatest(o, F.lit(1))))
    lp2 = F.when(o > ref, F.exp((ref - o) / F.greatest(i - ref, F.lit(1)))).otherwise(1.0)
    slp = F.exp(-F.abs(sr - so) / F.greatest(sr, so, F.lit(1)))
    out = mean_n.select("idx", (F.col("k") * lp2 * slp).alias("keep"), (F.col("d") * lp2).alias("deletion"), (F.col("a") * lp1).alias("addition"))
    return out.withColumn("d_sari", (F.col("keep") + F.col("deletion") + F.col("addition")) / 3)


def sari_statistics(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Per row and order the sums that corpus SARI is made of; they add over rows."""
    rows = rows.withColumn("r", F.size("references"))
    g = gram_counts(rows, [*keep, "r"])
    s, c, t = F.col("s") * F.col("r"), F.col("c") * F.col("r"), F.col("t")
    k, d = F.least(s, c), F.greatest(s - c, F.lit(0))
    new = F.col("c") * (F.col("s") == 0).cast("int")
    return g.groupBy(*keep, "n").agg(
        F.sum(F.least(k, t)).alias("keep_good"), F.sum(k).alias("keep_sys"), F.sum(F.least(s, t)).alias("keep_ref"),
        F.sum(F.greatest(d - t, F.lit(0))).alias("del_good"), F.sum(d).alias("del_sys"), F.sum(F.greatest(s - t, F.lit(0))).alias("del_ref"),
        F.count_if((new > 0) & (t > 0)).alias("add_good"), F.count_if(new > 0).alias("add_sys"), F.count_if((t > 0) & (F.col("s") == 0)).alias("add_ref"),
    )


SARI_SUMS = ("keep_good", "keep_sys", "keep_ref", "del_good", "del_sys", "del_ref", "add_good", "add_sys", "add_ref")


def sari_from(stats: DataFrame, by: list[str]) -> DataFrame:
    """Corpus SARI (0 to 100) of summed statistics: mean of keep F1, deletion precision, add F1."""
    total = stats.groupBy(*by, "n").agg(*[F.sum(x).alias(x) for x in SARI_SUMS])
    c = {x: F.col(x).cast("double") for x in SARI_SUMS}
    one = (
        _f1(_ratio(c["keep_good"], c["keep_sys"]), _ratio(c["keep_good"], c["keep_ref"]))
        + _ratio(c["del_good"], c["del_sys"])
        + _f1(_ratio(c["add_good"], c["add_sys"]), _ratio(c["add_good"], c["add_ref"]))
    ) / 3
    return total.groupBy(*by).agg((100 * F.sum(one) / len(ORDERS)).alias("sari"))


def corpus_sari(rows: DataFrame, *by: str) -> DataFrame:
    return sari_from(sari_statistics(rows, [*by, "idx"]), list(by))


def corpus_bleu(rows: DataFrame, *by: str) -> DataFrame:
    """BLEU (0 to 100) on white-space tokens: clipped n-gram precision up to 4 and brevity penalty
    against the closest reference length; 0 if an order has no match."""
    keys = [*by, "idx"]
    toks = lambda x: F.split(x, " ")
    n_c = F.size(toks(F.col("candidate")))
    lengths = F.transform("references", lambda x: F.size(toks(x)))
    closest = F.array_min(F.transform(lengths, lambda x: F.struct(F.abs(x - n_c).alias("d"), x.alias("n"))))["n"]
    sides = [F.array("candidate"), F.col("references")]

    def grams(texts: Column, i: int, n: int) -> Column:
        return F.flatten(F.transform(texts, lambda x: F.transform(ngrams(toks(x), n), lambda g: F.struct(F.lit(i).alias("side"), F.lit(n).alias("n"), g.alias("gram"), F.xxhash64(x).alias("of")))))

    parts = [grams(texts, i, n) for i, texts in enumerate(sides) for n in ORDERS]
    long = by_idx(rows).select(*keys, F.explode(F.flatten(F.array(*parts))).alias("x"))
    per_text = long.groupBy(*keys, "x.side", "x.n", "x.gram", "x.of").agg(F.count("*").alias("k"))
    g = per_text.groupBy(*keys, "n", "gram").agg(F.max(F.when(F.col("side") == 0, F.col("k"))).alias("c"), F.max(F.when(F.col("side") == 1, F.col("k"))).alias("t"))
    match = g.where("c is not null").groupBy(*by, "n").agg(F.sum(F.least("c", F.coalesce("t", F.lit(0)))).alias("m"), F.sum("c").alias("k"))
    score = match.groupBy(*by).agg(F.exp(F.sum(F.log(F.col("m") / F.col("k"))) / 4).alias("p"), F.min("m").alias("least"), F.count("*").alias("orders"))
    size = rows.groupBy(*by).agg(F.sum(n_c).alias("c"), F.sum(closest).alias("r"))
    both = score.join(size, list(by)) if by else score.crossJoin(size)  # one row each
    bp = F.when(F.col("c") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("c")))
    return both.select(*by, F.when((F.col("least") > 0) & (F.col("orders") == 4), 100 * bp * F.col("p")).otherwise(F.lit(0.0)).alias("bleu"))


def normalised_for_scoring(rows: DataFrame, systems: list[str], form) -> tuple[DataFrame, DataFrame]:
    """Every system's output in the form that references have, and how many of each changed by it:
    system, changed, n."""
    new = rows.withColumns({s: form(F.col(s)) for s in systems})
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("system"), (~F.col(s).eqNullSafe(form(F.col(s)))).alias("changed")) for s in systems]))
    changed = rows.select(each.alias("x")).groupBy("x.system").agg(F.count_if("x.changed").alias("changed"), F.count("*").alias("n"))
    return new, changed


#: Up to so many rows a bootstrap draws by random.Random, as its description does; above, and in
#: blocks of about so many rows, by numpy's generators.
BLOCK = 2048


def block_times(block: int, sizes: list[int], resamples: int, seed: int) -> np.ndarray:
    """(resamples, rows of the block): how often each resample draws each row. A resample draws as
    many rows as all blocks hold, with replacement; a block finds its share of them by halving."""
    n = sum(sizes)
    if len(sizes) == 1 and n <= BLOCK:
        rng = random.Random(seed)
        return np.stack([np.bincount([rng.randrange(n) for _ in range(n)], minlength=n) for _ in range(resamples)])
    low, high, node = 0, len(sizes), 1
    draws = np.full(resamples, n)
    while high - low > 1:
        mid = (low + high) // 2
        a, b = sum(sizes[low:mid]), sum(sizes[mid:high])
        first = np.random.default_rng([seed, 0, node]).binomial(draws, a / (a + b) if a + b else 0.5)
        draws, low, high, node = (first, low, mid, 2 * node) if block < mid else (draws - first, mid, high, 2 * node + 1)
    size = sizes[block]
    return np.random.default_rng([seed, 1, block]).multinomial(draws, np.full(size, 1 / size))


def resampled(rows: DataFrame, idx: DataFrame, width: int, resamples: int, seed: int) -> DataFrame:
    """(resample, sums): the sums, over each resample, of rows' (idx, values array<double> of
    that width); idx holds all indices once, and rows without values count as zeros."""
    n = idx.count()
    blocks = -(-n // BLOCK) or 1
    block = F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int").alias("block")
    sizes = [0] * blocks
    for b, k in idx.groupBy(block).count().collect():
        sizes[b] = k

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("idx")
        values = np.array(part.column("values").to_pylist(), np.float64)
        sums = block_times(part.column("block")[0].as_py(), sizes, resamples, seed) @ values
        return pa.table([pa.array(range(resamples), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["resample", "sums"])

    zeros = F.array_repeat(F.lit(0.0), width)
    full = idx.select("idx").join(rows, "idx", "left").select(block, "idx", F.coalesce("values", zeros).alias("values"))
    each = full.groupBy("block").applyInArrow(run, "resample int, sums array<double>")
    long = each.select("resample", F.posexplode("sums").alias("i", "x")).groupBy("resample", "i").agg(F.sum("x").alias("x"))
    return long.groupBy("resample").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("sums"))


def paired_bootstrap(scores: DataFrame, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """scores (idx, a, b), each idx once, of a metric that is a mean over rows: difference a - b and
    p, the share of resamples in which a isn't larger (ties aren't wins); p is 1 without rows."""
    each = resampled(scores.select("idx", F.array(F.col("a") - F.col("b")).alias("values")), scores.select("idx"), 1, resamples, seed)
    p = each.agg((1 - F.count_if(F.col("sums")[0] > 0) / F.nullif(F.count("*"), F.lit(0))).alias("p"), F.count("*").alias("resamples"))
    mean = scores.agg(F.count("*").alias("n"), F.avg(F.col("a") - F.col("b")).alias("delta"))
    return mean.crossJoin(p).select("n", "delta", "resamples", F.coalesce("p", F.lit(1.0)).alias("p"))  # one row each


def paired_bootstrap_sari(a: DataFrame, b: DataFrame, idx: DataFrame, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """For SARI, which isn't a mean over rows: statistics of both systems (idx, n, sums) are weighted
    and summed again in each resample of idx. Mean difference, its 2.5 and 97.5 percentiles and p."""
    both = a.withColumn("sys", F.lit("a")).unionByName(b.withColumn("sys", F.lit("b")))
    cells = [(sys, n) for sys in "ab" for n in ORDERS]
    values = [F.coalesce(F.sum(F.when((F.col("sys") == sys) & (F.col("n") == n), F.col(x))), F.lit(0)).cast("double") for sys, n in cells for x in SARI_SUMS]
    each = resampled(both.groupBy("idx").agg(F.array(*values).alias("values")), idx, len(values), resamples, seed)
    k = len(SARI_SUMS)
    parts = [
        F.struct(F.lit(sys).alias("sys"), F.lit(n).alias("n"), *[F.col("sums")[i * k + j].alias(x) for j, x in enumerate(SARI_SUMS)]) for i, (sys, n) in enumerate(cells)
    ]
    weighted = each.select("resample", F.explode(F.array(*parts)).alias("x")).select("resample", "x.*")
    d = sari_from(weighted, ["sys", "resample"]).groupBy("resample").agg((F.max(F.when(F.col("sys") == "a", F.col("sari"))) - F.max(F.when(F.col("sys") == "b", F.col("sari")))).alias("d"))
    return d.agg(
        F.avg("d").alias("delta"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"),
        (1 - F.count_if(F.col("d") > 0) / F.count("*")).alias("p"),
    )


def seed_summary(scores: DataFrame, *by: str) -> DataFrame:
    """Mean of a metric over runs, and its population deviation if there is more than one."""
    return scores.groupBy(*by).agg(F.avg("value").alias("mean"), F.when(F.count("*") > 1, F.stddev_pop("value")).alias("deviation"), F.count("*").alias("runs"))


__all__ = ["corpus_bleu", "corpus_sari", "document_sari", "paired_bootstrap", "paired_bootstrap_sari", "resampled", "sari_statistics", "seed_summary"]
