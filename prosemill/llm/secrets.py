"""Secrets in texts: fixed patterns, and strings that are new to primed zstandard compression.

A candidate of the second kind is a long run of key-like characters with a sensitive word shortly
before it. Two compressors, primed with a dictionary of common identifiers, compress the text
around it without and with the candidate: the bytes it adds, against its length, say how much of it
is new. Prose, paths and identifiers repeat what the dictionary or the surroundings hold and add
little; random keys add nearly all of their information.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from prosemill.llm.common import parts_of, pick, texts_in

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run is taken whole or, where it is shorter, not at all: as [0-9a-f]+ with a least length.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: Sensitive words; one of them must stand within SURROUNDING characters before a candidate.
SENSITIVE = ("password", "passwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "private key", "access key", "bearer", "authorization", "auth")
SURROUNDING = 64
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)), re.ASCII | re.IGNORECASE)
SHORTEST = 16
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A text without any of these, in lower case, has no sensitive word and no assignment.
_STEMS = ("passw", "secret", "token", "key", "credential", "bearer", "auth")
#: Bytes that a candidate must add for each of its characters. Base64 holds 0.75 bytes a character, a
#: decimal number 0.42. Letters alone must be of both cases, this share of either at least, and be
#: newer: words and names joined by capitals are letters, too.
NOVELTY, NUMBER_NOVELTY, LETTER_NOVELTY, EITHER_CASE = 0.6, 0.33, 0.65, 0.28
_DIGIT, _LETTER, _UPPER = re.compile("[0-9]"), re.compile("[A-Za-z]"), re.compile("[A-Z]")


def least_novelty(own: str) -> float:
    """What a candidate's characters demand; more than any can add where they rule a key out."""
    if _DIGIT.search(own):
        return NOVELTY if _LETTER.search(own) else NUMBER_NOVELTY
    upper = len(_UPPER.findall(own)) / max(1, len(_LETTER.findall(own)))
    return LETTER_NOVELTY if EITHER_CASE <= upper <= 1 - EITHER_CASE else 9.0


#: What code and prose around secrets commonly hold; it primes both compressors.
IDENTIFIERS = """
the and for with that this from have not are was which their would there been will more when said each
function return const let var class def import from export public private static void int string bool
true false null none self this new async await try except catch finally raise throw if else elif while
username user_name email address host hostname port database db_name url uri endpoint path file directory
https http www example com org net api v1 v2 v3 get post put delete patch headers content-type application json
password passwd secret token api_key apikey access_key secret_key client_id client_secret private_key public_key
authorization bearer basic session cookie csrf nonce signature certificate BEGIN END PRIVATE KEY RSA
config settings environment production staging development testing default timeout retry max_retries
connection connect request response status code message error warning info debug log logger level
created_at updated_at deleted_at timestamp date time datetime utc id uuid name type value key index count size
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef 00000000 11111111 12345678
aaaaaaaaaaaaaaaa xxxxxxxxxxxxxxxx ---------------- ================ ________________ ////////////////
"""


def sensitive(text: str) -> bool:
    low = text.lower()
    return any(x in low for x in _STEMS)


class Scanner:
    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 9):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(
            level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def novelty(self, text: str, start: int, end: int) -> float:
        """Marginal compressed bytes a character of text[start:end] in its surroundings."""
        before = text[max(0, start - 4 * SURROUNDING) : start]
        after = text[end : end + 4 * SURROUNDING]
        own = text[start:end]
        size = lambda t: len(self.compressor.compress(t.encode("utf-8", "replace")))
        return (size(before + after + own) - size(before + after)) / len(own)

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the fixed patterns' matches, the failing ones dropped."""
        out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if sensitive(text) else []
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        return sorted(out)

    def novel(self, text: str) -> list[tuple[int, int, int]]:
        """Spans that compression finds new, each a whole candidate."""
        out, done = [], 0
        for word in _SENSITIVE.finditer(text) if sensitive(text) else ():
            at, last = max(done, word.end()), word.end() + SURROUNDING
            while m := _CANDIDATE.search(text, at, last + SHORTEST):
                end = done = at = _CANDIDATE.match(text, m.start()).end()
                least = least_novelty(text[m.start() : end])
                if least < 9 and self.novelty(text, m.start(), end) >= least:
                    out.append((m.start(), 3, end))
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Base and novel spans by start, then kind. A span that a base span covers is not novel."""
        base = self.base(text)
        more = [x for x in self.novel(text) if not any(b[0] <= x[0] and x[2] <= b[2] for b in base)]
        return sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex long, base_sha256
    string, spans string, n_novel long, secrets array<string> (the texts of the spans, in order).

    spans are kind:start:end by start, then kind as in KINDS, comma-joined; code points, end
    exclusive. base_sha256 is of the same string of the base kinds alone. Null and empty texts hold
    none. Whole texts of any length are scanned; null or repeated doc_ids keep their rows; other
    columns are left behind; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner()
        for batch in parts_of(batches, "text", 8 << 20):
            counts: list[list[int]] = [[], [], [], []]
            digests, spans, found = [], [], []
            for text in texts_in(batch, "text"):
                all_ = own.spans(text)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in all_))
                digests.append(hashlib.sha256(joined([x for x in all_ if x[1] < 3]).encode()).hexdigest())
                spans.append(joined(all_))
                found.append([text[a:b] for a, _, b in all_])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts[:3]], pa.array(digests), pa.array(spans), pa.array(counts[3], pa.int64()), pa.array(found, pa.list_(pa.string()))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel", "secrets"],
            )

    return pick(docs, doc_id="long", text="string").mapInArrow(
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long, secrets array<string>",
    )


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with each stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]
