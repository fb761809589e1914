"""Byte-level BPE by a sentencepiece model that is written straight from the rank file.

The model is serialised here, field by field, from the vocabulary: each token's bytes, mapped to
one character a byte, become a piece scored by its negative rank, normalisation is the identity and
nothing is trained. sentencepiece's BPE merges the best-scored pair first, the leftmost of equals,
which is the merge order of the ranks. Each match of the split pattern is encoded separately.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from prosemill.llm.common import hold, parts_of, pick, texts_in

#: Words that a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 600_000, 64
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, kind: int, value: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(value)) + value if kind == 2 else value)


def _flag(number: int, n: int) -> bytes:
    return _field(number, 0, _varint(n & (1 << 64) - 1))


#: One letter for each byte: none is a space, and none is special to sentencepiece.
LETTER = [chr(0x4E00 + b) for b in range(256)]
_LETTERS = {b: LETTER[b] for b in range(256)}


def letters(data: bytes) -> str:
    return data.decode("latin-1").translate(_LETTERS)


def serialised(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: pieces by rank, <unk> after the last of them."""
    import struct

    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = _field(1, 2, letters(token).encode()) + _field(2, 5, struct.pack("<f", -float(rank)))
        out += _field(1, 2, piece)
    out += _field(1, 2, _field(1, 2, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _flag(3, 2))
    trainer = _flag(3, 2) + _flag(4, len(tokens) + 1) + _flag(40, len(tokens)) + _flag(41, -1) + _flag(42, -1) + _flag(43, -1)
    normalizer = _field(1, 2, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return bytes(out) + _field(2, 2, trainer) + _field(3, 2, normalizer)


class Memo:
    """Values of the words of texts, each worked out once and then looked up.

    A text is cut at single spaces between other characters, which no match of the split pattern
    crosses; each word but the first stands for a space and itself. ``work`` gives the values of
    words without their space; what is remembered is bounded.
    """

    def __init__(self, work: Callable[[list[str], str], list], most: int = REMEMBERED):
        self.work, self.most, self.known = work, most, {}

    def forget(self) -> None:
        self.known.clear()

    def of(self, texts: list[str]) -> list[list]:
        hold(self)
        cuts = [t.split(" ") for t in texts]
        new = set().union(*cuts).difference(self.known)
        if odd := {w for w in new if not w or w[0].isspace() or w[-1].isspace()}:
            cuts = [c if odd.isdisjoint(c) else _BETWEEN.split(t) for c, t in zip(cuts, texts, strict=True)]
            new = set().union(*cuts).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = set().union(*cuts)
        kept = [w for w in new if 0 < len(w) <= LONGEST and not w[0].isspace() and not w[-1].isspace()]
        self.known.update(zip(kept, self.work(kept, " "), strict=True))
        rest = list(new.difference(kept))
        once = dict(zip(rest, self.work(rest, " "), strict=True))
        firsts = self.work([c[0] for c in cuts], "")
        if once:
            find = lambda w: once[w] if w in once else self.known[w]
            return [[f, *map(find, c[1:])] for f, c in zip(firsts, cuts, strict=True)]
        return [[f, *map(self.known.__getitem__, c[1:])] for f, c in zip(firsts, cuts, strict=True)]


class Codec:
    """encode(text) and decode(ids) as tiktoken's encode_ordinary and decode_bytes."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks = read_ranks(ranks_path)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=serialised(self.ranks))
        self.pattern = regex.compile(pattern)
        self.bytes_of = sorted(self.ranks, key=self.ranks.__getitem__)
        self.memo = Memo(lambda words, before: [self._both(before + w) for w in words])

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for match in self.pattern.findall(text):
            data = match.encode()
            if (rank := self.ranks.get(data)) is not None:
                ids.append(rank)
            else:
                ids += self.sp.encode(letters(data))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def _both(self, text: str) -> tuple[bytes, bytes]:
        """The ids in decimal, a space after each, and the decoded bytes."""
        ids = self.encode(text)
        return b"".join([b"%d " % i for i in ids]), self.decode(ids)

    def digest(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of its ids, SHA-256 of the ids joined by spaces and of the
        bytes that they decode to."""
        for parts in self.memo.of(texts):
            ids = b"".join([x[0] for x in parts])
            yield ids.count(b" "), hashlib.sha256(ids[:-1]).hexdigest(), hashlib.sha256(b"".join([x[1] for x in parts])).hexdigest()


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encoded(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded binary for each row of docs (doc_id, text); the operator's
    general form."""
    path, pattern = ranks_path or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in parts_of(batches, "text", 4 << 20):
            ids = [own.encode(t) for t in texts_in(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.binary())],
                ["doc_id", "ids", "decoded"],
            )

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens long, ids_sha256 string,
    decoded_sha256 string.

    Whole texts are encoded, each match of the pattern separately and without special tokens (their
    strings are ordinary text), and the ids decoded again. Null and empty texts have no ids; both
    digests are then those of no bytes. Rows with a null or repeated doc_id are kept as they are,
    other columns are left behind, an empty table gives an empty result.
    """
    path, pattern = ranks_path or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in parts_of(batches, "text", 2 << 20):
            rows = list(own.digest(texts_in(batch, "text")))
            n, ids, decoded = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return pick(docs, doc_id="long", text="string").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
