import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
from prosemill.llm.packing import encoder, default_tokenizer
from prosemill.llm.secrets import Scanner, redacted

ALPHABET = "bcdfghklmnprst"
BAD = ["zqvermin", "xwretch", "qqfoul"]


def corpus(rng):
    word = lambda: "".join(rng.choice(ALPHABET) for _ in range(rng.randint(2, 7)))
    text = lambda k: [word() for _ in range(k)]
    shared, rows, toxic = text(70), [], {}
    for i in range(240):
        t = text(rng.randint(60, 120))
        if i % 3 == 0:
            t[rng.randrange(len(t))] = rng.choice(BAD)
            toxic[i] = 1
        elif i % 10 == 1:
            t[20:20] = shared
        elif i % 10 == 2:
            t.append("token = abcdef123456")
        rows.append((i, " ".join(t), "en", f"s{i % 5}", None))
    for i in (4, 8, 13):
        copy = rows[i][1].split(" ")
        copy[-1] = "changed"
        rows.append((1000 + i, " ".join(copy), "en", "s0", 3))
    rows += [(2000, None, "en", "s1", 0), (2001, "", "en", "s1", 0)]
    return rows, toxic


def brute(rows, toxic):
    rows = [r for r in rows if not any(b in (r[1] or "") for b in BAD)]
    sets = {r[0]: {tuple(w[i : i + 5]) for w in [(r[1] or "").split()] for i in range(len(w) - 4)} for r in rows}
    ids = sorted(sets)
    gone = {b for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    out, seen = {}, set()
    for d, t, *_ in sorted(r for r in rows if r[0] not in gone):
        w = (t or "").split(" ") if t else []
        drop = [False] * len(w)
        own = set()
        for i in range(len(w) - 49):
            g = tuple(w[i : i + 50])
            own.add(g)
            if g in seen:
                drop[i : i + 50] = [True] * 50
        seen |= own
        out[d] = " ".join(x for x, y in zip(w, drop) if not y)
    scanner = Scanner()
    return {d: redacted(t, scanner.spans(t)) for d, t in out.items()}


def test_run_as_brute_force(spark, tmp_path):
    rows, toxic = corpus(random.Random(6))
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, toxic.get(r[0], 0)) for r in rows[:240]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    want = brute(rows, toxic)
    assert len(want) < len(rows) and any("[secret]" in t for t in want.values())
    ids = dict(zip(want, encoder(default_tokenizer()).ids(list(want.values()))))
    got, used = defaultdict(dict), defaultdict(list)
    for r in corpus_pipeline.run(spark, d).collect():
        got[r.doc_id][r.start] = (r.length, r.ids_crc32)
        used[r.sequence_id].append((r.offset, r.length))
    assert set(got) == set(want)
    import zlib

    for k, parts in got.items():
        data = ids[k] + (2).to_bytes(4, "little")
        assert sum(n for n, _ in parts.values()) * 4 == len(data)
        assert all(zlib.crc32(data[4 * a : 4 * (a + n)]) == c for a, (n, c) in parts.items())
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= corpus_pipeline.CAPACITY


def test_stages_keep_the_columns_and_take_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.pack(spark, docs, small).count() == 0


def test_without():
    assert corpus_pipeline.without("a b c d", [(2, 3), (2, 5)]) == "a d"
    assert corpus_pipeline.without("abc", []) == "abc" and np.size(corpus_pipeline.without("ab", [(0, 2)])) == 1


def test_rows_that_share_an_id(spark, small):
    """Copies and passages are judged by a row's own text; rows without doc_id stay as they are."""
    rng = random.Random(8)
    text = lambda k: " ".join("".join(rng.choice(ALPHABET) for _ in range(6)) for _ in range(k))
    x, y, z, shared = text(80), text(90), text(70), text(60)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, x), (2, x), (2, y), (3, z + " " + shared), (5, shared + " " + y[:200]), (5, z[:100]), (None, x), (None, None), (6, None), (6, shared), (7, y), (7, y)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, small)
    want = [r for r in rows if r not in ((2, x), (7, y))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(want, key=key)
    cut = corpus_pipeline.drop_repeated_passages(spark, kept, small).collect()
    want = [(i, {(5, shared + " " + y[:200]): y[:200], (6, shared): ""}.get((i, t), t)) for i, t in want]
    assert sorted(((r.doc_id, r.text) for r in cut), key=key) == sorted(want, key=key)
    assert all(r.n_chars == (0 if r.text is None or r.text else len(r.text)) or r.n_chars == len(r.text or "") or r.n_chars is None for r in cut)
