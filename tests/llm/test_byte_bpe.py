import hashlib
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from prosemill.llm import byte_bpe

CODEC = byte_bpe.Codec(byte_bpe.default_ranks(), byte_bpe.default_pattern())
OWN = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.default_ranks()), special_tokens={}
)


def expected(text):
    ids = OWN.encode_ordinary(text)
    data = OWN.decode_bytes(ids)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(data).hexdigest()


TRICKY = st.text(alphabet=st.sampled_from(list(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 ​　'sdtrevml aAbZ019²é漢😀.,;!-_|<>́٣")), max_size=40)


@settings(max_examples=400, deadline=None)
@given(TRICKY | st.text(max_size=60))
def test_as_tiktoken(text):
    text = text.encode("utf-8", "ignore").decode()
    assert CODEC.encode(text) == OWN.encode_ordinary(text)
    assert list(CODEC.digest([text])) == [expected(text)]
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


def test_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {r.doc_id: expected(r.text or "") for r in docs.collect()}
    got = {r[0]: tuple(r[1:]) for r in byte_bpe.encode_digests(docs).collect()}
    assert got == want


def test_edges(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh") for _ in range(60_000)) + "\n\n\n   " + "x" * 5000
    rows = [(None, "a  b", 1), (1, None, 2), (1, "", 3), (1, "<|endoftext|> it's", 4), (2, long, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, TEXT long")
    got = sorted(((r[0] or 0), *r[1:]) for r in byte_bpe.encode_digests(df).collect())
    assert got == sorted((d or 0, *expected(t or "")) for d, t, _ in rows)
    assert byte_bpe.encode_digests(df.where("false")).count() == 0
    assert [bytes(r.decoded) for r in byte_bpe.encoded(df).where("doc_id = 2").collect()] == [long.encode()]
