"""Toxicity by compression distance: which of two zstandard dictionaries tells a window shorter.

Dictionaries are trained by zstandard's COVER algorithm on the words of ordinary and of toxic
documents, whole texts of both, in several sizes and segment lengths: a small dictionary keeps only
what is frequent in its class. Windows are words with their spaces. A window's cell, for a pair of
dictionaries, is its length and the bytes it takes after either. zstandard never matches the last
bytes of an input, so a constant text that ends all dictionaries goes before and after each window
and costs the same everywhere.

A cell's weight is the log-odds of toxic against ordinary documents that hold such a window. Weights
and all that follows come from documents that the dictionaries were not trained on, in turns
(cross-fitting); the dictionaries of the last turn are the model's. A document's evidence is what its
windows' weights say together, for each pair: the largest, the means of the largest few, the sum and
the number of the positive ones. A ridge logistic regression over these gives the score, moved so
that it passes the threshold where fewest documents are on the wrong side.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.common import hold, parts_of, pick, texts_in

#: The model is fitted on so many labelled documents of each class at most, of at most so many
#: characters each, chosen by a hash of doc_id. Scores always cover whole texts.
TOXIC_SAMPLE, ORDINARY_SAMPLE, LONGEST_SAMPLE = 1500, 4000, 20_000
#: Dictionaries: bytes, and COVER's segment and sequence lengths; for a toxic one also the number of
#: the ordinary one that it is held against.
ORDINARY = ((110 << 10, 64, 8), (110 << 10, 16, 6))
TOXIC = ((32 << 10, 64, 8, 0), (32 << 10, 16, 6, 1), (8 << 10, 16, 8, 0), (2 << 10, 16, 8, 0), (4 << 10, 16, 6, 1))
LEVEL = 12
FOLDS = 5
RIDGE = 5.0
#: An ordinary document on the wrong side counts as so many toxic ones.
DROPPED = 4
AROUND = b"<0123456789|a window of text|9876543210>"
THRESHOLD = 0.3
#: A cell needs so many fitted documents for a weight; others weigh nothing, or KNOWN.
SEEN, KNOWN = 3, -1.0
#: Evidence of a pair: the largest weight and means of so many largest, then three sums and the mean.
LARGEST = (1, 2, 4, 8, 16)
WIDTH = len(LARGEST) + 4
#: Words that a worker remembers.
REMEMBERED = 400_000
_WORD = re.compile(r"[^\W\d_]+")
#: The shortest sample that COVER takes.
_SAMPLE = 8

#: A cell is one number: 10 bits each for a window's bytes and for those it takes after the ordinary
#: and the toxic dictionary; longer ones are cut to what that holds.
BITS = 10
_MOST = (1 << BITS) - 1
Weights = tuple[np.ndarray, np.ndarray]  # cells, ascending, and their weights
Dictionaries = tuple[tuple[bytes, ...], tuple[bytes, ...]]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def windows(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _trained(texts: list[str], size: int, k: int, d: int) -> bytes:
    """A dictionary of at most ``size`` bytes; of little text, the text itself. Words with a sequence
    of d bytes are samples, filled with spaces to the length that COVER needs."""
    samples = [s.ljust(_SAMPLE) for t in texts for w in windows(t) if len(s := f" {w} ".encode()) >= d]
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(f" {w} ".encode() for t in texts for w in windows(t)))[-size:]


def dictionaries(ordinary: list[str], toxic: list[str]) -> Dictionaries:
    return tuple(_trained(ordinary, *x) for x in ORDINARY), tuple(_trained(toxic, *x[:3]) for x in TOXIC)


class Compressors:
    """Bytes that a word takes after each dictionary."""

    def __init__(self, of: Dictionaries):
        self.all = [[self._one(d) for d in side] for side in of]

    @staticmethod
    def _one(content: bytes) -> zstandard.ZstdCompressor:
        primed = zstandard.ZstdCompressionDict(content + AROUND, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def cells(self, words: list[str]) -> np.ndarray:
        """The words' cells (words x pairs of dictionaries)."""
        own = [f" {w} ".encode() for w in words]
        data = [AROUND + x + AROUND for x in own]
        cut = lambda sizes: np.minimum(np.fromiter(sizes, np.int32, len(words)), _MOST)
        n = cut(map(len, own)) << 2 * BITS
        a, b = ([cut(len(x) for x in map(c.compress, data)) for c in side] for side in self.all)
        return np.stack([n | a[x[3]] << BITS | taken for taken, x in zip(b, TOXIC, strict=True)], axis=1)


def column(weights: Weights, cells: np.ndarray) -> np.ndarray:
    """The weights of cells. One that no fitted document holds weighs nothing, or KNOWN where the
    ordinary dictionary is the better one: texts that it was trained on have cells that others lack."""
    known, values = weights
    rest = np.where((cells >> BITS & _MOST) < (cells & _MOST), KNOWN, 0.0)
    if not len(known):
        return rest
    at = np.minimum(np.searchsorted(known, cells), len(known) - 1)
    return np.where(known[at] == cells, values[at], rest)


def _weighed(weights: list[Weights], cells: np.ndarray) -> np.ndarray:
    return np.stack([column(w, cells[:, j]) for j, w in enumerate(weights)], axis=1)


def together(weights: np.ndarray) -> np.ndarray:
    """The evidence of a document from its windows' weights (windows x pairs)."""
    n = len(weights)
    most = min(n, LARGEST[-1])
    top = -np.sort(-(np.partition(weights, n - most, axis=0)[n - most :] if n > most else weights), axis=0)
    sums = np.cumsum(top, axis=0)
    largest = [sums[min(k, n) - 1] / min(k, n) for k in LARGEST]
    positive = np.log1p(np.where(weights > 0.5, weights, 0).sum(axis=0))
    return np.concatenate([*largest, positive, np.log1p((weights > 1.5).sum(axis=0)), positive - 0.5 * math.log(n), weights.mean(axis=0)])


@dataclass
class Model:
    of: Dictionaries = ((), ())
    weights: list[Weights] = field(default_factory=list)
    slopes: list[float] = field(default_factory=list)
    bias: float = -6.0
    _known: dict = field(default_factory=dict, repr=False, compare=False)
    _table: list = field(default_factory=list, repr=False, compare=False)
    _compressors: Compressors | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"} | {"_known": {}, "_table": [], "_compressors": None}

    def forget(self) -> None:
        self._known.clear()
        self._table.clear()
        self._compressors = None

    def _number(self, words: list[str]) -> list[int]:
        """Each word's row in the table of weights."""
        hold(self)
        known = self._known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                self._table.clear()
                new = list(dict.fromkeys(words))
            if not self._compressors:
                self._compressors = Compressors(self.of)
            at = sum(map(len, self._table))
            self._table.append(_weighed(self.weights, self._compressors.cells(new)).astype(np.float32))
            known.update(zip(new, range(at, at + len(new)), strict=True))
        return [known[w] for w in words]

    def evidence(self, texts: list[str]) -> list[np.ndarray | None]:
        """What the windows of each text say together; None without any window."""
        words = [windows(t) if self.weights else [] for t in texts]
        first = np.cumsum([0, *map(len, words)])
        at = np.array(self._number([w for x in words for w in x]), np.int64)
        table = np.concatenate(self._table) if self._table else np.zeros((0, 0), np.float32)
        self._table = [table] if len(table) else []
        return [together(table[at[a:b]].astype(np.float64)) if b > a else None for a, b in zip(first[:-1], first[1:], strict=True)]

    def scores(self, texts: list[str]) -> list[float]:
        """The probability that a text is toxic; the least there is without any window."""
        out = []
        for x in self.evidence(texts):
            logit = -30.0 if x is None and self.slopes else self.bias + (float(np.dot(self.slopes, x)) if x is not None else 0.0)
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))))
        return out


def _odds(held: list[np.ndarray], y: np.ndarray) -> list[Weights]:
    """For each pair of dictionaries, the weights of the cells that documents hold."""
    out = []
    n1, n0 = y.sum(), (1 - y).sum()
    for j in range(len(TOXIC)):
        own = [np.unique(x[:, j]) for x in held]
        cells, number = np.unique(np.concatenate(own), return_inverse=True)
        toxic = np.repeat(y, [len(x) for x in own])
        ones, all_ = (np.bincount(number, w, len(cells)) for w in (toxic, None))
        seen = all_ >= SEEN
        odds = np.log((ones + 0.3) / (n1 + 0.6)) - np.log((all_ - ones + 0.3) / (n0 + 0.6))
        out.append((cells[seen], odds[seen]))
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and bias of a ridge logistic regression, by Newton's steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], RIDGE), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def fit(labelled: list[tuple[str, int]]) -> Model:
    """A model from (text, toxic 0/1). Without FOLDS texts of both classes its scores are all alike."""
    labelled = [(t, y) for t, y in dict.fromkeys(labelled) if windows(t)]  # copies say nothing new
    classes = [[t for t, y in labelled if y == k] for k in (0, 1)]
    if min(map(len, classes)) < FOLDS:
        return Model()
    held: list[np.ndarray] = []  # by document: the cells of its windows
    y, fold = [], []
    for f in reversed(range(FOLDS)):
        of = dictionaries(*[[t for i, t in enumerate(c) if i % FOLDS != f] for c in classes])
        compressors = Compressors(of)
        texts = [windows(t) for c in classes for t in c[f::FOLDS]]
        number = {w: i for i, w in enumerate(dict.fromkeys(w for words in texts for w in words))}
        cells = compressors.cells(list(number))
        held += [cells[[number[w] for w in words]] for words in texts]
        y += [label for label, c in enumerate(classes) for _ in c[f::FOLDS]]
        fold += [f] * len(texts)
    y, fold = np.array(y), np.array(fold)
    x = np.zeros((len(y), WIDTH * len(TOXIC)))
    for f in range(FOLDS):
        weights = _odds([h for h, g in zip(held, fold, strict=True) if g != f], y[fold != f])
        for i in np.flatnonzero(fold == f):
            x[i] = together(_weighed(weights, held[i]))
    slopes, bias = _logistic(x, y)
    logit = x @ slopes + bias
    steps = np.unique(logit)
    cuts = np.concatenate(([steps[0] - 1], (3 * steps[1:] + steps[:-1]) / 4, [steps[-1] + 1]))  # nearer to the toxic side
    wrong = np.searchsorted(np.sort(logit[y == 1]), cuts) + DROPPED * ((y == 0).sum() - np.searchsorted(np.sort(logit[y == 0]), cuts))
    cut = float(cuts[wrong == wrong.min()].mean())
    return Model(of, _odds(held, y), slopes.tolist(), bias - cut + math.log(THRESHOLD / (1 - THRESHOLD)))


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The bounded sample that the model is fitted on; held-out rows are never in it."""
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    labels = pick(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic in (0, 1)").where(usable)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = labels.where("toxic = 1").orderBy(order, "doc_id").limit(TOXIC_SAMPLE)
    chosen = chosen.unionByName(labels.where("toxic = 0").orderBy(order, "doc_id").limit(ORDINARY_SAMPLE))
    rows = (
        pick(docs, doc_id="long", text="string").where(F.length("text").between(1, LONGEST_SAMPLE))
        .join(F.broadcast(chosen), "doc_id").collect()  # at most TOXIC_SAMPLE + ORDINARY_SAMPLE documents
    )
    return [(r.text, r.toxic) for r in sorted(rows, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text))]


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out boolean, score double, predicted int.

    held_out is whether crc32(doc_id as text) mod 4 is 2; the score is of the text alone, all of
    it. Null and empty texts have no window and the least score. Null doc_ids (not held out) and
    repeated ones keep their rows; other columns are left behind; an empty table gives an empty
    result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dictionaries and cells of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in parts_of(batches, "text", 1 << 20):
            ids = batch.column(0).to_pylist()
            scores = own.scores(texts_in(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([i is not None and held_out(i) for i in ids], pa.bool_()),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
