import math
import random
import zlib

import numpy as np

from prosemill.llm.toxicity import BITS, KNOWN, LARGEST, TOXIC, WIDTH, Compressors, Model, column, dictionaries, fit, held_out, score_toxicity, together, training_rows

SYLLABLES = ["th", "on", "er", "an", "re", "ed", "in", "ou", "ha", "st", "en", "ti"]
BAD = ["wretched", "vermin", "imbecile", "zqualor"]


def documents(n, rng, copies=True):
    out = []
    for i in range(n):
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", ",", "."])
        out.append((i, " ".join(words), toxic))
    return out


def test_held_out_accuracy(spark):
    rows = documents(900, random.Random(1))
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, TEXT string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    sample = training_rows(docs, labels)
    assert {t for t, _ in sample} == {t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    truth = {i: y for i, _, y in rows}
    got = score_toxicity(docs, fit(sample)).collect()
    assert len(got) == 900
    test = [r for r in got if r.held_out]
    assert {r.doc_id for r in test} == {i for i in truth if held_out(i)}
    assert sum(r.predicted == truth[r.doc_id] for r in test) / len(test) > 0.95
    toxic = [r for r in test if truth[r.doc_id]]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_held_out_by_language(spark):
    """The larger table: marker words in one language, families of rare words in the others."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    got = score_toxicity(docs, fit(training_rows(docs, labels))).where("held_out")
    rows = got.join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    for lang, recall, precision in (("en", 0.9, 0.95), ("de", 0.7, 0.75), ("fr", 0.7, 0.75)):
        own = [r for r in rows if r.lang == lang]
        both = sum(r.predicted and r.toxic for r in own)
        assert both >= recall * sum(r.toxic for r in own) and both >= precision * sum(r.predicted for r in own), lang


def test_small_windows_and_weights():
    """Evidence against a plain reckoning; cells against single compressions."""
    rng = random.Random(5)
    w = np.array([[rng.uniform(-2, 4) for _ in TOXIC] for _ in range(23)])
    got = together(w).reshape(WIDTH, -1)
    for j in range(len(TOXIC)):
        own = sorted(w[:, j], reverse=True)
        want = [sum(own[:k]) / k for k in LARGEST]
        positive = math.log1p(sum(v for v in own if v > 0.5))
        want += [positive, math.log1p(sum(v > 1.5 for v in own)), positive - 0.5 * math.log(23), sum(own) / 23]
        assert np.allclose(got[:, j], want)
    assert np.allclose(together(w[:3]).reshape(WIDTH, -1)[3:5, 0], w[:3, 0].mean())
    of = dictionaries(["the plain words of a text " * 3], ["vermin and wretched things " * 3])
    many = Compressors(of).cells(["vermin", "plain"])
    assert (many == np.concatenate([Compressors(of).cells([w]) for w in ("vermin", "plain")])).all()
    size, a, b = many >> 2 * BITS, many >> BITS & 1023, many & 1023
    assert (size == [[8], [7]]).all() and (b[0] < a[0]).all() and (a[1] < b[1]).all()
    known = np.array([1 << 20 | 5 << 10 | 3, 2 << 20 | 5 << 10 | 3])
    cells = np.array([2 << 20 | 5 << 10 | 3, 1 << 20 | 4 << 10 | 3, 1 << 20 | 3 << 10 | 4])
    assert column((known, np.array([0.5, 1.5])), cells).tolist() == [1.5, 0.0, KNOWN]


def test_edges(spark):
    model = fit([(t, y) for _, t, y in documents(300, random.Random(2))])
    rows = [(None, "the"), (1, None), (1, ""), (2, "12 !! \n"), (3, "vermin " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(score_toxicity(df, model).collect(), key=lambda r: (r.doc_id or 0, r.score))
    assert [r.predicted for r in got] == [0, 0, 0, 0, 1]
    assert score_toxicity(df.where("false"), model).count() == 0
    assert fit([]) == Model() and fit([("a b", 1)]) == Model()
    assert {r.predicted for r in score_toxicity(df, Model()).collect()} == {0}
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert training_rows(df, labels) == []
