"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find groups.

Texts with equal shingle sets fall into one class, so copies never meet each other again; a class
signs once. Three steps then find all links without a row for each pair of a group:

1. Every class is verified, on full sets, with the smallest one of each of its band buckets whose
   signature allows a link. The links found make groups; most buckets then hold one group only, and
   nothing more is asked of them.
2. In the buckets of several groups, signatures tell which groups can be linked at all: blocks of
   classes of different groups give spanning forests, whose components are the neighbourhoods.
3. Within a neighbourhood all such classes of different groups are verified against each other, in
   blocks of bounded size; a block pair gives a spanning forest of its links.

Stars, buckets and neighbourhoods of any size are cut into blocks, and blocks or pairs of blocks go to
tasks; classes of one group are never held against each other again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import GOLDEN, U64, Words, components, discard, hold, mix, parts_of, pick, saved, told_apart

#: Bands times rows is the length of a signature. At a similarity of 0.8 all 24 bands miss with a
#: probability of (1 - 0.8 ** 4) ** 24 = 3e-6.
BANDS, ROWS = 24, 4
#: Pairs are verified where this share of the signature agrees; at a similarity of 0.8 fewer agree
#: with a probability of about 1e-5.
LEAST_AGREEING = 0.62
#: Classes that a task compares with as many others at most, about, and the shingles they have.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
MAX_ELEMENTS = 1 << 16


def superminhash(elements: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (texts x m) of the sets elements[first[i]:first[i + 1]].

    In step j each element draws rank j + r for one more place of its own random permutation
    (Fisher-Yates, so its m places are correlated). A text is done once all of its places hold less
    than j + 1: later steps can't lower them. All elements of all unfinished texts step at once.
    """
    n = len(first) - 1
    h = np.full(n * m, np.iinfo(np.uint64).max, U64)
    doc = np.repeat(np.arange(n), np.diff(first))
    place = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
    for j in range(m):
        if not len(doc):
            break
        draw = mix(elements + U64((j + 1) * GOLDEN & (2**64 - 1)))
        k = j + ((draw >> U64(32)) * U64(m - j) >> U64(32)).astype(np.int64)
        at = np.arange(len(doc))
        slot = place[at, k].astype(np.int64)
        place[at, k] = place[:, j]
        np.minimum.at(h, doc * m + slot, U64(j << 48) | mix(draw ^ U64(GOLDEN)) >> U64(16))
        open_ = h.reshape(n, m).max(axis=1) >= U64((j + 1) << 48)
        keep = open_[doc]
        if not keep.all():
            doc, elements, place = doc[keep], elements[keep], place[keep]
    return h.reshape(n, m)


def distinct_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, ascending, one text after the other."""
    values, first = words.shingles(n)
    own = [np.unique(values[first[i] : first[i + 1]]) for i in range(len(first) - 1)]
    size = [len(x) for x in own]
    return (np.concatenate(own) if own else values), np.concatenate(([0], np.cumsum(size, dtype=np.int64)))


def _blocks(first: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(first) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(first, first[at] + MAX_ELEMENTS, side="right")) - 1)
        yield at, min(to, n)
        at = to


def _signer(n: int):
    m = BANDS * ROWS
    salt = np.array([(b + 1) * GOLDEN & (2**64 - 1) for b in range(BANDS)], U64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(None)
        for batch in parts_of(batches, "text", 2 << 20):
            values, first = distinct_sets(Words(batch.column(1)), n)
            size = np.diff(first)
            filled = np.concatenate((np.zeros(1, U64), np.cumsum(values, dtype=U64)))
            twice = np.concatenate((np.zeros(1, U64), np.cumsum(mix(values ^ U64(0x5851F42D4C957F2D)), dtype=U64)))
            key = [mix(x[first[1:]] - x[first[:-1]] + size.astype(U64)) for x in (filled, twice)]
            h = np.zeros((len(size), m), U64)
            for a, b in _blocks(first):
                h[a:b] = superminhash(values[first[a] : first[b]], first[a : b + 1] - first[a], m)
            rows = mix(h).reshape(len(size), BANDS, ROWS)
            band = np.zeros((len(size), BANDS), U64)
            for r in range(ROWS):
                band = mix(band * U64(3) + rows[:, :, r] + salt)
            some = size > 0
            sig = mix(h).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size, pa.int64()),
                    pa.array(key[0].view(np.int64), mask=~some),
                    pa.array(key[1].view(np.int64), mask=~some),
                    pa.array([x if s else None for x, s in zip(band.view(np.int64), some, strict=True)], pa.list_(pa.int64())),
                    pa.array([x.tobytes() if s else None for x, s in zip(sig, some, strict=True)], pa.binary()),
                    batch.column(2),
                ],
                ["doc_id", "n_shingles", "k1", "k2", "bands", "sig", "row"],
            )

    return sign


def _setter(n: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "text", 2 << 20):
            values, first = distinct_sets(Words(batch.column(1)), n)
            own = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), own], ["node", "own"])

    return sets


def _close(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v and their signatures: the pairs whose signatures allow a link."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, BANDS * ROWS) for i in (2, 3))
        yield batch.select(["u", "v"]).filter(pa.array((a == b).mean(axis=1) >= LEAST_AGREEING))


def _starred(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """task, centre (null for the others), node, own, the centre first: its verified links."""
        task, centre, own = None, None, None
        for batch in batches:
            u, v = [], []
            tasks, isolated = (batch.column(i).to_pylist() for i in (0, 1))
            values = batch.column(3)
            first = np.concatenate(([0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))))
            flat = values.flatten().to_numpy()
            for i, (t, is_centre, node) in enumerate(zip(tasks, isolated, batch.column(2).to_pylist(), strict=True)):
                mine = flat[first[i] : first[i + 1]]
                if is_centre:
                    task, centre, own = t, node, mine
                    continue
                if t != task:
                    raise ValueError("a star has no centre")
                at = np.searchsorted(own, mine)
                both = int((own[np.minimum(at, len(own) - 1)] == mine).sum())
                if 100 * both >= percent * (len(own) + len(mine) - both):
                    u.append(min(centre, node))
                    v.append(max(centre, node))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _stars_verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (centre u, v) whose full sets are similar enough. A centre's pairs are dealt into
    tasks of about BLOCK; each has the centre's set once and streams the others past it."""
    count = saved(pairs.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "blocks")
    dealt = saved(pairs.join(count, "u").select("u", "v", F.xxhash64("u", F.pmod(F.xxhash64("v"), F.col("blocks"))).alias("task")), "dealt")
    sides = dealt.select(F.col("v").alias("node"), "task", F.lit(False).alias("centre")).unionByName(
        dealt.select(F.col("u").alias("node"), "task", F.lit(True).alias("centre")).distinct()
    )
    return (
        sides.join(sets, "node").select("task", "centre", "node", "own")
        .repartition("task").sortWithinPartitions("task", F.desc("centre")).mapInArrow(_starred(percent), "u long, v long")
    )


class _Forest:
    """Union-find over 0..n-1; ``edges`` are the joins made."""

    def __init__(self, root: np.ndarray):
        self.root, self.edges = root, []

    def others(self, i: int) -> np.ndarray:
        """Those after i that are not joined with it."""
        return np.flatnonzero(self.root[i + 1 :] != self.root[i]) + i + 1

    def join(self, i: int, js: np.ndarray) -> None:
        for r in np.unique(self.root[js]):
            self.edges.append((i, int(js[self.root[js] == r][0])))
            self.root[self.root == r] = self.root[i]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each task, which is the first column; the batches come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1), len(task)]
        for k in range(len(cuts) - 1):
            part = batch.slice(cuts[k], cuts[k + 1] - cuts[k])
            if held and held[0].column(0)[0] != part.column(0)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _edges(node: np.ndarray, forest: _Forest) -> pa.RecordBatch:
    a, b = (np.array([node[e[i]] for e in forest.edges], np.int64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])


def _of_groups(grp: np.ndarray) -> _Forest:
    """A forest in which members of one group are joined."""
    _, first, number = np.unique(grp, return_index=True, return_inverse=True)
    return _Forest(first[number])


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """task, node, grp, size, sig: a forest of the groups whose members' signatures and sizes
        allow a link."""
        for rows in _grouped(batches):
            _, at = np.unique(rows.column(1).to_numpy(), return_index=True)
            grp, size = (rows.column(i).to_numpy()[at] for i in (2, 3))
            sig = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint8).reshape(len(rows), -1)[at]
            forest = _of_groups(grp)
            for i in range(len(grp) - 1):
                js = forest.others(i)
                js = js[100 * np.minimum(size[i], size[js]) >= percent * np.maximum(size[i], size[js])]
                if len(js):
                    js = js[(sig[js] == sig[i]).mean(axis=1) >= LEAST_AGREEING]
                    forest.join(i, js)
            yield _edges(grp, forest)

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """task, node, grp, own: a forest of the verified links between different groups."""
        for rows in _grouped(batches):
            node, at = np.unique(rows.column(1).to_numpy(), return_index=True)
            own = rows.column(3).to_pylist()
            own = [np.array(own[i], np.int64) for i in at]
            size = np.array([len(x) for x in own])
            forest = _of_groups(rows.column(2).to_numpy()[at])
            _, value, shared = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            doc = np.repeat(np.arange(len(node)), size)
            keep = shared[value] > 1  # only these can be common
            doc, value = doc[keep], (np.cumsum(shared > 1) - 1)[value[keep]]
            order = np.argsort(value, kind="stable")
            doc, value = doc[order], value[order]
            common = np.zeros((len(node), len(node)), np.float32)
            for low in range(0, int(value[-1]) + 1 if len(value) else 0, 4096):
                a, b = np.searchsorted(value, (low, low + 4096))
                part = np.zeros((len(node), 4096), np.float32)
                part[doc[a:b], value[a:b] - low] = 1
                common += part @ part.T
            for i in range(len(node) - 1):
                js = forest.others(i)
                both = common[i, js].astype(np.int64)
                forest.join(i, js[100 * both >= percent * (size[i] + size[js] - both)])
            yield _edges(node, forest)

    return run


def _tasks(rows: DataFrame, key: str, kept: list[str], run) -> DataFrame:
    """The edges (u, v) that ``run`` finds within each key between rows of different grp. Rows of a
    key are dealt into blocks of about BLOCK rows and BLOCK_SHINGLES of their size; those of one grp
    are dealt into blocks of their own where they fill some, else by grp. Each pair of a key's blocks
    is one task, but for two of one grp."""
    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / BLOCK_SHINGLES))
    own = saved(
        rows.groupBy(key, "grp").agg(F.count("*").alias("n"), F.sum("size").alias("sum"))
        .withColumn("big", F.when((F.col("n") > BLOCK // 2) | (F.col("sum") > BLOCK_SHINGLES // 2), F.col("grp"))),
        "dealt",
    )
    rest = saved(own.where("big is null").groupBy(key).agg(F.sum("n").alias("rest"), F.sum("sum").alias("rest_sum")), "rest")
    own = saved(own.join(rest, key, "left"), "dealt")
    number = F.when(F.col("big").isNotNull(), F.pmod(F.xxhash64("node"), blocks("n", "sum"))).otherwise(
        F.pmod(F.xxhash64("grp"), blocks("rest", "rest_sum"))
    )
    dealt = rows.drop("n").join(own, [key, "grp"]).withColumn("block", F.xxhash64(key, F.coalesce("big", F.lit(-1)), number))
    of = saved(dealt.select(key, "block", "big").distinct(), "blocks")
    a = of.select(key, F.col("block").alias("a"), F.col("big").alias("big_a"))
    b = of.select(key, F.col("block").alias("b"), F.col("big").alias("big_b"))
    pairs = a.join(b, key).where("a <= b and coalesce(big_a != big_b, true)")
    pairs = saved(pairs.select("a", "b", F.xxhash64("a", "b").alias("task")), "pairs")
    sides = pairs.select(F.col("a").alias("block"), "task").unionByName(pairs.where("a != b").select(F.col("b").alias("block"), "task"))
    return (
        dealt.select("block", *kept).join(sides, "block").select("task", *kept)
        .repartition("task").sortWithinPartitions("task").mapInArrow(run, "u long, v long")
    )


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document of docs (doc_id, text): doc_id, n_shingles long (distinct n-word
    shingles), component_id long, kept boolean, row long (xxhash64 of the text), first boolean.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets; words
    are ``[^\\x20\\x09-\\x0D]+``, A-Z lowered. component_id is the smallest doc_id reachable over
    links; kept is doc_id = component_id, so one document of a group stays.

    Null or empty texts have an empty set and are linked with nothing; a text of fewer than n words
    is one shingle. A row without doc_id is linked with nothing, has no component and is kept. Rows
    of equal doc_id and text are one document, and each returns a row; where texts differ, rows that
    share a doc_id are documents of their own. first tells these apart: of a group it holds for one
    document only, one of those kept. An empty table gives an empty result. Texts of any length are
    read whole.
    """
    docs = pick(docs, doc_id="long", text="string").withColumn("row", F.xxhash64("text"))
    docs, names = told_apart(docs)
    found = _components_of(docs, n, percent).withColumn("first", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    if names is not None:
        found = saved(found, "found")
        for c in ("doc_id", "component_id"):
            back = names.select(F.col("own").alias(c), F.col("doc_id").alias("real"))
            found = found.join(back, c, "left").withColumn(c, F.col("real")).drop("real")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return found.select("doc_id", "n_shingles", "component_id", kept, "row", "first")


def _components_of(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, row, component_id for docs (doc_id, text, row), no doc_id with two texts."""
    signed = saved(
        docs.mapInArrow(_signer(n), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sig binary, row long"), "signed"
    )
    classes = saved(
        signed.where("k1 is not null and doc_id is not null").groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig")),
        "classes",
    )
    groups = saved(_groups(docs.select("doc_id", "text"), classes, n, percent), "groups")
    named = saved(
        classes.select("k1", "k2", "node").join(groups, "node", "left")
        .select("k1", "k2", F.coalesce("component", "node").alias("g")),
        "named",
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("g", "doc_id"))
    return (
        signed.select("doc_id", "n_shingles", "k1", "k2", "row").join(named, ["k1", "k2"], "left")
        .select("doc_id", "n_shingles", "row", component.alias("component_id"))
    )


def _groups(docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, component) of the linked classes."""
    members = classes.select("node", "size", "sig", F.explode("bands").alias("bucket"))
    stars = saved(
        members.groupBy("bucket").agg(F.min(F.struct("node", "size", "sig")).alias("c"), F.count("*").alias("n")).where("n > 1").select("bucket", "c"),
        "stars",
    )
    met = saved(members.join(stars, "bucket"), "met")
    tried = (
        met.where("node != c.node").where(_close("size", "c.size", percent)).select(F.col("c.node").alias("u"), F.col("node").alias("v"), F.col("c.sig").alias("a"), F.col("sig").alias("b"))
        .mapInArrow(_agreeing, "u long, v long").distinct()
    )
    tried = saved(tried, "tried")
    sets = saved(
        docs.join(met.select(F.col("node").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        .mapInArrow(_setter(n), "node long, own array<long>"),
        "sets",
    )
    links = saved(_stars_verified(tried, sets, percent), "links")
    groups = saved(components(links), "groups")

    grouped = saved(
        met.select("bucket", "node", "size", "sig").join(groups, "node", "left").select("bucket", "node", "size", "sig", F.coalesce("component", "node").alias("grp")),
        "grouped",
    )
    discard(met, tried)
    mixed = saved(grouped.groupBy("bucket").agg(F.min("grp").alias("a"), F.max("grp").alias("b")).where("a != b").select("bucket"), "mixed")
    left = saved(grouped.join(mixed, "bucket"), "left")
    hoods = saved(components(_tasks(left, "bucket", ["node", "grp", "size", "sig"], _likely(percent))), "hoods")
    if hoods.isEmpty():
        return groups
    near = left.select("node", "grp", "size").distinct().join(hoods.select(F.col("node").alias("grp"), F.col("component").alias("hood")), "grp")
    near = saved(near.join(sets, "node"), "near")
    more = saved(_tasks(near, "hood", ["node", "grp", "own"], _linked(percent)), "more")
    return groups if more.isEmpty() else components(links.unionByName(more))
