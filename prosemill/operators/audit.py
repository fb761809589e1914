"""Site audits and profiles: latency, skip pivots, snapshot differences, labelling samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROSE_WORDS, LABEL_WORDS = 12, 8


def order_statistics(rows: DataFrame, by: list[str], value: str, targets: dict[str, tuple[float, Column]]) -> DataFrame:
    """Exact values at sorted places: targets name a share and the place (from 0) near it, as a
    column of the group's size n.

    A sketch brackets each place between two values of the group a few thousandths apart; only what
    lies between them is counted by value and ordered, so no group is ever sorted or held whole.
    """
    v = F.col(value)
    names = list(targets)
    shares = [x for name in names for x in (max(0.0, targets[name][0] - 0.002), min(1.0, targets[name][0] + 0.002))]
    head = rows.groupBy(*by).agg(F.count(v).alias("n"), F.percentile_approx(v, [float(x) for x in shares], 10_000).alias("b"))
    near = rows.join(head, by) if by else rows.crossJoin(head)  # one row
    low, high = lambda i: F.col("b")[2 * i], lambda i: F.col("b")[2 * i + 1]
    below = near.groupBy(*by).agg(*[F.count_if(v < low(i)).alias(f"below{i}") for i in range(len(names))])
    inside = F.filter(F.array(*[F.when(v.between(low(i), high(i)), F.lit(i)) for i in range(len(names))]), lambda x: x.isNotNull())
    kept = near.select(*by, v.alias("v"), F.explode(inside).alias("i")).groupBy(*by, "i", "v").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*by, "i").orderBy("v"))
    placed = kept.withColumn("upto", upto)
    facts = head.select(*by, "n").join(below, by) if by else head.select("n").crossJoin(below)
    placed = placed.join(facts, by) if by else placed.crossJoin(facts)
    found = [
        F.min(F.when((F.col("i") == i) & (F.col(f"below{i}") + F.col("upto") > targets[name][1]), F.col("v"))).alias(name) for i, name in enumerate(names)
    ]
    return placed.groupBy(*by, "n").agg(*found)


def latency_summary(samples: DataFrame, value: str, *by: str) -> DataFrame:
    """Median (interpolated), mean, p95, maximum and minimum; p95 is the sorted value at
    min(n - 1, floor(0.95 n)). All are exact."""
    rows = samples.where(F.col(value).isNotNull()).select(*by, value)
    n = F.col("n")
    places = {
        "_low": (0.5, F.floor((n - 1) / 2)),
        "_high": (0.5, F.floor(n / 2)),
        "p95": (0.95, F.least(n - 1, F.floor(0.95 * n))),
    }
    order = order_statistics(rows, list(by), value, places)
    rest = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"))
    both = order.join(rest, list(by)) if by else order.crossJoin(rest)  # one row each
    return both.select(*by, "n", ((F.col("_low") + F.col("_high")) / 2).alias("median"), "mean", "p95", "max", "min")


def throughput(samples: DataFrame, wall_ms: float, chars: str, *by: str) -> DataFrame:
    """Requests, and requests and characters a second of the time that a user waits."""
    n, c = F.count("*"), F.coalesce(F.sum(chars), F.lit(0))
    return samples.groupBy(*by).agg(n.alias("requests"), F.round(n / (wall_ms / 1000), 2).alias("requests_per_second"), F.round(c / (wall_ms / 1000), 1).alias("chars_per_second"))


def token_lengths(samples: DataFrame, value: str, *by: str) -> DataFrame:
    quantile = lambda q: F.percentile(value, F.lit(q)).alias(f"p{round(100 * q)}")
    return samples.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), quantile(0.9), quantile(0.95), quantile(0.99), F.max(value).cast("long").alias("max"))


def reason_pivot(items: DataFrame, by: str, reason: str, reasons: list[str]) -> DataFrame:
    """A column for each reason with its count, 0 where there is none."""
    return items.groupBy(by).agg(*[F.count_if(F.col(reason) == r).alias(r.replace("-", "_")) for r in reasons])


def reason_table(items: DataFrame, by: str, reason: str) -> DataFrame:
    """The pivot in long form, over all reasons that occur anywhere: by, reason, n, 0 where a row of
    by has none. Both vocabularies are small."""
    some = items.where(F.col(reason).isNotNull()).groupBy(by, reason).agg(F.count("*").alias("n"))
    every = items.select(by).distinct().crossJoin(some.select(reason).distinct())  # vocabularies, not rows
    return every.join(some, [by, reason], "left").select(by, reason, F.coalesce("n", F.lit(0)).alias("n"))


def reason_samples(items: DataFrame, reason: str, text: str, order: str, k: int = 5, chars: int = 160) -> DataFrame:
    """Per reason its count and its first k texts, cut short: a bounded list, by rank."""
    rows = items.where(F.col(reason).isNotNull())
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy(reason).orderBy(order))).where(F.col("rank") <= k)
    texts = first.groupBy(reason).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring(F.trim(text), 1, chars).alias("t")))), lambda x: x["t"]).alias("samples"))
    return rows.groupBy(reason).agg(F.count("*").alias("n")).join(texts, reason)


def labelling_candidates(items: DataFrame) -> DataFrame:
    """Skipped prose in scope, outside boilerplate; a heading's own reason is left out, no reason
    isn't."""
    return items.where((F.col("status") == "skipped") & F.col("in_scope") & ~F.col("in_boilerplate") & (F.col("words") >= LABEL_WORDS) & ~F.col("reason").eqNullSafe("section-heading"))


def hash_sample(items: DataFrame, by: list[str], text: str, k: int = 3) -> DataFrame:
    """The k rows of each stratum whose text's SHA-256 is smallest."""
    items = items.withColumn("sha", F.sha2(F.col(text), 256))
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("sha", *[c for c in items.columns if c != "sha" and c not in by]))).where(F.col("rank") <= k)


def selection_analysis(items: DataFrame, *by: str, document: bool = False) -> DataFrame:
    """Prose skipped in scope, boilerplate sent and what was sent outside the scope; the sent side
    is null where whole sections are sent."""
    skipped, sent = F.col("status") == "skipped", F.col("status") == "sent"
    prose = F.col("words") >= PROSE_WORDS
    null = lambda c: F.lit(None).cast("long") if document else c
    return items.groupBy(*by).agg(
        F.count_if(skipped & F.col("in_scope") & prose).alias("prose_skipped"), F.coalesce(F.sum(F.when(skipped & F.col("in_scope") & prose, F.col("words"))), F.lit(0)).alias("prose_skipped_words"),
        null(F.count_if(sent & F.col("in_boilerplate"))).alias("boilerplate_sent"), null(F.count_if(sent & ~F.col("in_scope"))).alias("sent_outside"),
    )


def page_rollup(requests: DataFrame, *by: str) -> DataFrame:
    """Requests of a page: shares, words, compression of changed ones, guard reasons as a map."""
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 3)
    n, changed = F.count("*"), F.count_if("changed")
    totals = requests.groupBy(*by).agg(
        n.alias("requests"), F.count_if("cached").alias("from_cache"), changed.alias("changed"), (n - changed).alias("unchanged"), share(changed, n).alias("changed_share"),
        F.count("reason").alias("guarded"), F.percentile("words", F.lit(0.5)).alias("words_median"), F.max("words").alias("words_max"),
        F.percentile(F.when(F.col("changed") & (F.col("chars") > 0), F.col("out_chars") / F.col("chars")), F.lit(0.5)).alias("compression_median"),
    )
    reasons = requests.where("reason is not null").groupBy(*by, "reason").agg(F.count("*").alias("k")).groupBy(*by)
    return totals.join(reasons.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "k")))).alias("guard_reasons")), list(by), "left")


def totals_by(rows: DataFrame, cut: str, sums: list[str], share_of: str) -> DataFrame:
    """Sums by cut and percentages of one of them, rounded; a dash where that one is 0."""
    out = rows.groupBy(cut).agg(*[F.sum(s).alias(s) for s in sums])
    pct = lambda c: F.when(F.col(share_of) > 0, F.concat(F.floor(100 * F.col(c) / F.col(share_of) + 0.5).cast("string"), F.lit("%"))).otherwise("—")
    return out.select(cut, *sums, *[pct(c).alias(f"{c}_pct") for c in sums if c != share_of])


def tag_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of tags (page, tag, n) that differ between two snapshots; a missing tag counts 0."""
    b, a = before.withColumnRenamed("n", "before"), after.withColumnRenamed("n", "after")
    both = b.join(a, ["page", "tag"], "full_outer").select("page", "tag", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return both.where("before != after")


def positional_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Items (page, pos, value) that differ at their position; pages whose numbers of items differ
    have one row with a null position."""
    count = lambda d, c: d.groupBy("page").agg(F.count("*").alias(c))
    n = count(before, "n").join(count(after, "m"), "page", "full_outer").withColumn("same", F.coalesce(F.col("n") == F.col("m"), F.lit(False)))
    pairs = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), ["page", "pos"]).join(n.where("same").select("page"), "page")
    differ = pairs.where(~F.col("before").eqNullSafe(F.col("after"))).select("page", "pos", "before", "after")
    return differ.unionByName(n.where("not same").select("page", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")))


def attribute_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Attributes (page, pos, attrs array) lost and gained at each position."""
    b, a = before.withColumnRenamed("attrs", "b"), after.withColumnRenamed("attrs", "a")
    out = b.join(a, ["page", "pos"]).select("page", "pos", F.array_except("b", "a").alias("lost"), F.array_except("a", "b").alias("gained"))
    return out.where((F.size("lost") > 0) | (F.size("gained") > 0))


def lost_anchors(before: DataFrame, after: DataFrame, page_text: DataFrame) -> DataFrame:
    """Anchors (page, pos, label) whose label became empty: misplaced if the page still has the text,
    deleted if not, orphaned if the anchor is gone."""
    gone = before.where("label != ''").join(after.withColumnRenamed("label", "now"), ["page", "pos"], "left").where("coalesce(now, '') = ''")
    return gone.join(page_text, "page").select(
        "page", "pos", "label", F.when(F.col("now").isNull(), "orphaned").when(F.contains(F.col("text"), F.col("label")), "misplaced").otherwise("deleted").alias("kind")
    )


def revert_equality(before: Column, after: Column, own: str = r'\s(?:class|title|data-simplified)="[^"]*"') -> dict[str, Column]:
    """Equal bytes, equal without the extension's attributes, equal text."""
    bare = lambda c: F.regexp_replace(c, own, "")
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " "))
    return {"identical": before == after, "identical_bare": bare(before) == bare(after), "identical_text": text(before) == text(after)}
