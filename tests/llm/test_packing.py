import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prosemill.llm.packing import Encoder, Places, default_tokenizer, packed, plan, planned

TOKENIZER = Tokenizer.from_file(default_tokenizer())
TOKENIZER.encode_special_tokens = True


def holds(rows, docs, capacity):
    want = {}
    for d, t in docs:
        want.setdefault(d, []).append([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2])
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert set(got) == set(want)
    for d, sets in want.items():
        pieces = Counter()
        for ids in sets:
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                pieces[(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
        assert pieces == Counter((r.piece, r.start, r.length, r.ids_crc32) for r in got[d])
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r.length for r in rows)


def test_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packed(docs).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    n, tokens = holds(rows, texts, 1024)
    assert n <= -(-tokens // 1024) + 1


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_exact_sums_carry_the_plan(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("text").collect()]
    lengths = [n for x in Encoder(default_tokenizer()).ids(texts) for n in [(len(x) // 4 + 1) % 1024, *[1024] * ((len(x) // 4 + 1) // 1024)] if n]
    kinds, filled = planned(Counter(lengths), 1024)
    assert filled[1] > 20 and filled[2] > 20
    if sf == "0.1":
        assert filled[3] > 20
    sequences = sum(n for _, n in kinds)
    assert sequences <= best_fit(lengths, 1024) and sequences <= -(-sum(lengths) // 1024) * 1.003
    several = sum(n for kind, n in kinds if len(kind) > 1)
    assert sum(n for kind, n in kinds if len(kind) > 1 and sum(kind) == 1024) > several * 0.6


def test_other_tokenizers_take_the_whole_way(tmp_path):
    """A tokenizer that lower-cases and splits otherwise."""
    from tokenizers import models, normalizers, pre_tokenizers

    own = Tokenizer(models.WordLevel({"<unk>": 0, "plain": 1, "words": 2}, unk_token="<unk>"))
    own.normalizer, own.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.Whitespace()
    own.save(path := str(tmp_path / "words.json"))
    assert Encoder(path).ids(["Plain words, x"]) == [np.array([1, 2, 0, 0], "<u4").tobytes()]
    assert not Encoder(default_tokenizer()).plain


def test_edges(spark):
    rng = random.Random(1)
    texts = ["", None, "a  b\n c ", "<|endoftext|>", " lead", "x" * 3000, "word " * 1023, "word " * 1022 + "word", "é  漢\x85 z " * 900]
    docs = [(rng.choice([1, 2, None, 3]), t) for t in texts * 3]
    df = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, Text int")
    for capacity in (1024, 16):
        holds(packed(df, capacity).collect(), docs, capacity)
    with_ids = packed(df, 64, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in with_ids)
    assert packed(df.where("false")).count() == 0


def best_fit(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((fit or capacity) - x)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=25))
def test_plan_places_every_piece(counts):
    kinds = plan(counts, 60)
    used = Counter()
    for kind, n in kinds:
        assert sum(kind) <= 60 and n > 0
        for x in kind:
            used[x] += n
    assert used == Counter(counts)
    places, seen = Places(kinds), set()
    for x, n in counts.items():
        for number, offset in zip(*places.of(np.full(n, x), np.arange(n))):
            seen |= {(int(number), int(offset) + i) for i in range(x)}
    assert len(seen) == sum(x * n for x, n in counts.items())
    lengths = [x for x, n in counts.items() for _ in range(n)]
    assert sum(n for _, n in kinds) <= best_fit(lengths, 60)


@pytest.mark.parametrize("seed", range(3))
def test_plan_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(5, 1, 5000).astype(int) + 1, 1024)
    kinds = plan(Counter(lengths.tolist()), 1024)
    assert sum(n for _, n in kinds) <= -(-lengths.sum() // 1024) + 1
