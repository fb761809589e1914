"""Best-fit packing of token sequences by exact complements.

Only the histogram of piece lengths (at most ``capacity`` counts) reaches the driver. From it a
plan is made: sums of one, two or three lengths that exactly fill a gap are looked up in an index and
consumed under their availability counts, the residual lengths are packed best-fit. The plan has one
entry for each kind of sequence and its count, so its size depends on the capacity alone. Pieces then
look up their place by their rank among pieces of equal length; ranks come from counts by input
partition, joined by a merge, as that table grows with the partitions.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prosemill.llm.byte_bpe import Memo
from prosemill.llm.common import parts_of, pick, saved, texts_in

END = 2
#: Words that a worker remembers; a word's ids are short.
REMEMBERED = 1_200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _letters() -> dict[int, str]:
    """The character of each byte in the tokenizer's vocabulary: printable ones stand for
    themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


_LETTERS = _letters()


class Encoder:
    """The ids of whole texts, as little-endian unsigned 32-bit numbers.

    Words of Latin letters, with one mark after them or none, are one match of the tokenizer's
    split pattern each and go to its model directly; all else takes the tokenizer's whole way. So
    does everything with a tokenizer whose ids differ on the probes.
    """

    PROBES = ("Plain words, and naïve ones: Straße!", " lead  two\n\nlines ; x1 don't I'LL\t.", "", "UPPER?Mixed .end é\u00a0ü  ")

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.memo = Memo(self._words, REMEMBERED)
        self.plain = False
        self.marks = {}
        try:
            self.marks = {m: self._piece(m) for m in ".,;:!?"}
            self.plain = any(x != y for x, y in zip(self.ids(list(self.PROBES)), self._whole(self.PROBES), strict=True))
        except Exception:  # a model of another kind may refuse single words
            self.plain = True
        self.memo.known.clear()

    def _whole(self, texts) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _piece(self, text: str) -> bytes:
        """The ids of printable characters and spaces that are one match of the split pattern."""
        mapped = text.replace(" ", _LETTERS[32]) if text.isascii() else text.encode().decode("latin-1").translate(_LETTERS)
        found = self.model.tokenize(mapped)
        return struct.pack(f"<{len(found)}I", *[x.id for x in found])

    def _words(self, words: list[str], before: str) -> list[bytes]:
        out: list[bytes] = []
        slow, known = [], self.memo.known
        for i, w in enumerate(words):
            mark = self.marks.get(w[-1:], b"")
            stem = w[:-1] if mark else w
            if before and stem.isalpha() and max(stem) < "\u0250":
                out.append(((mark and known.get(stem)) or self._piece(before + stem)) + mark)
            else:
                out.append(b"")
                slow.append(i)
        if slow:
            found = self.tokenizer.encode_batch_fast([before + words[i] for i in slow], add_special_tokens=False)
            for i, x in zip(slow, found, strict=True):
                out[i] = np.array(x.ids, "<u4").tobytes()
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.plain:
            return self._whole(texts)
        return [b"".join(x) for x in self.memo.of(texts)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the executor's tasks are parallel
    return Encoder(path)


# --------------------------------------------------------------------------- the plan

Kinds = list[tuple[tuple[int, ...], int]]


class Lengths:
    """Pieces left, by length, and an index of the sums of two of them.

    ``pairs`` has, for each sum, in how many ways two lengths that are left make it; it is worked out
    anew only when a length runs out. A sum of three is looked up as its largest length and the sum
    of the other two.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.have = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.have[length] = n
        self.stale = True

    @property
    def pairs(self) -> np.ndarray:
        if self.stale:
            n = len(self.have)
            some = np.fft.rfft(self.have > 0, 2 * n)
            self.found = np.rint(np.fft.irfft(some * some, 2 * n)[:n])
            self.stale = False
        return self.found

    def times(self, kind: tuple[int, ...], most: int) -> int:
        """How often the lengths of a kind can be taken together, ``most`` at most."""
        return min([most, *[int(self.have[x]) // n for x, n in Counter(kind).items()]])

    def take(self, kind: tuple[int, ...], times: int) -> None:
        for x in kind:
            self.have[x] -= times
            self.stale |= self.have[x] == 0

    def two(self, a: int, gaps: np.ndarray) -> tuple[int, tuple[int, ...]] | None:
        """A gap that a and another length of at most a fill, the other as long as can be."""
        rest = gaps - a
        fits = rest <= a
        rest = rest[fits]
        fits = np.flatnonzero((rest > 0) & (self.have[rest] > (rest == a)))
        return (int(rest[fits[-1]]) + a, (a, int(rest[fits[-1]]))) if len(fits) else None

    def three(self, a: int, gaps: np.ndarray) -> tuple[int, tuple[int, ...]] | None:
        """The smallest gap that a and two lengths of at most a fill, the two as unlike as can be."""
        for gap in gaps[self.pairs[gaps - a] > 0]:
            rest = int(gap) - a
            b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
            for x in b[(self.have[b] > 0) & (self.have[rest - b] > 0)][::-1]:
                if self.times(kind := (a, int(x), rest - int(x)), 1):
                    return int(gap), kind
        return None


def plan(counts: dict[int, int], capacity: int) -> Kinds:
    """Kinds of sequences, each the lengths in it and how many such sequences there are."""
    return planned(counts, capacity)[0]


def planned(counts: dict[int, int], capacity: int) -> tuple[Kinds, Counter]:
    """The plan, and how many gaps one, two and three lengths filled exactly.

    Sums of several lengths use up short ones, which now and then costs the rest a sequence; then
    sums of at most two, or one, are what fills.
    """
    tried = [_plan(counts, capacity, most) for most in (3, 2, 1)]
    return min(tried, key=lambda x: sum(n for _, n in x[0]))


def _plan(counts: dict[int, int], capacity: int, most: int) -> tuple[Kinds, Counter]:
    """Longest first, so that short lengths are spared: where one, two or at most ``most`` lengths,
    this one the longest of them, fill a gap exactly, they do, as often as their counts allow; else
    the length goes best-fit, into the smallest gap that holds it, or into new sequences.
    """
    left = Lengths(counts, capacity)
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by gap: kinds with that gap and their counts
    waiting = np.zeros(capacity + 1, np.int64)  # sequences by gap
    filled: Counter = Counter()

    def put(gap: int, pieces: tuple[int, ...], times: int) -> None:
        left.take(pieces, times)
        rest = gap - sum(pieces)
        waiting[gap] -= times
        waiting[rest] += times
        while times:
            kind, n = open_[gap].pop()
            if n > times:
                open_[gap].append((kind, n - times))
            open_.setdefault(rest, []).append((kind + pieces, min(n, times)))
            times -= min(n, times)
        if rest == 0:
            filled[len(pieces)] += 1

    def new(a: int) -> None:
        each = capacity // a
        full, rest = divmod(int(left.have[a]), each)
        for kind, n in (((a,) * each, full), ((a,) * rest, int(rest > 0))):
            if n:
                left.take(kind, n)
                gap = capacity - sum(kind)
                open_.setdefault(gap, []).append((kind, n))
                waiting[gap] += n

    for a in range(capacity, 0, -1):
        while n := int(left.have[a]):
            gaps = a + np.flatnonzero(waiting[a:])
            if not len(gaps):
                new(a)
            elif gaps[0] == a:
                put(a, (a,), min(n, int(waiting[a])))
            elif (most > 1 and (hit := left.two(a, gaps))) or (most > 2 and (hit := left.three(a, gaps))):
                put(*hit, left.times(hit[1], int(waiting[hit[0]])))
            else:
                gap = int(gaps[0])
                each = min(gap // a, n)
                put(gap, (a,) * each, min(int(waiting[gap]), n // each))
    return [x for kinds in open_.values() for x in kinds], filled


class Places:
    """Sequence and offset of the pieces of a length by rank, from a plan."""

    def __init__(self, kinds: list[tuple[tuple[int, ...], int]]):
        taken: Counter = Counter()
        rows = []
        number = 0
        for kind, n in kinds:
            offset = 0
            for length in kind:
                rows.append((length, taken[length], number, offset))
                taken[length] += n
                offset += length
            number += n
        rows.sort()
        self.sequences = number
        self.length, self.rank, self.number, self.offset = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 4
        self.key = (self.length << 48) + self.rank

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) + rank, side="right") - 1
        return self.number[at] + rank - self.rank[at], self.offset[at]


# --------------------------------------------------------------------------- the operator

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int, path: str, with_ids: bool = False) -> DataFrame:
    """The pieces of each document and, for each, the input partition and the rank among that
    partition's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(path), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for batch in parts_of(batches, "text", 2 << 20):
            doc, number, start, length, crc, data, local = [], [], [], [], [], [], []
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.ids(texts_in(batch, "text")), strict=True):
                ids += END.to_bytes(4, "little")
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k in range(len(cuts) - 1):
                    a, b = cuts[k], cuts[k + 1]
                    doc.append(doc_id)
                    number.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(memoryview(ids)[4 * a : 4 * b]))
                    local.append(met[b - a])
                    met[b - a] += 1
                    if with_ids:
                        data.append(np.frombuffer(ids[4 * a : 4 * b], "<u4").astype(np.int32))
            columns = [
                pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()), pa.array([part] * len(doc), pa.int32()), pa.array(local, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
            if with_ids:
                columns.append(pa.array(data, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = _PIECES + ", part int, local long" + (", ids array<int>" if with_ids else "")
    return pick(docs, doc_id="long", text="string").mapInArrow(run, schema)


def packed(docs: DataFrame, capacity: int = 1024, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, piece int, start long, length long,
    ids_crc32 long, sequence_id long, offset long; with_ids adds ids array<int>.

    A document is its ids and then id 2. Longer ones than ``capacity`` are cut into pieces of that
    length, only the first piece being shorter. Sequences are gapless from offset 0.

    A null or empty text is the one id 2. Rows with a null or repeated doc_id are packed like any
    other. Of pieces of equal length it is open which goes where. An empty table gives an empty
    result. Texts of any length are encoded whole.
    """
    path = tokenizer_path or default_tokenizer()
    spark = docs.sparkSession
    all_ = saved(pieces(docs, capacity, path, with_ids), "pieces")
    by_part = saved(all_.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    places = spark.sparkContext.broadcast(Places(plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = places.value
        for batch in batches:
            rank = batch.column("first").to_numpy(zero_copy_only=False) + batch.column("local").to_numpy(zero_copy_only=False)
            number, offset = own.of(batch.column("length").to_numpy(zero_copy_only=False), rank)
            kept = [c for c in batch.schema.names if c not in ("first", "local", "part")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(number), pa.array(offset)], [*kept, "sequence_id", "offset"]
            )

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = _PIECES + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return all_.join(first.hint("merge"), ["length", "part"]).select(*names, "first", "local").mapInArrow(place, schema)
