"""Queries next to their SQL on rows that the generated tables hold few of or none."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
from oracle import TABLES, compare

from prosemill.plans.catalog import ORACLES, QUERIES


def said(spark, small, folder, name, **rows):
    """What compare says of a query over small tables, some of them replaced by rows."""
    for t in TABLES:
        if t in rows:
            pq.write_table(pa.Table.from_pylist(rows[t]), folder / f"{t}.parquet")
        else:
            os.symlink(f"{small}/{t}.parquet", folder / f"{t}.parquet")
    return compare(spark, str(folder), name, QUERIES[name], ORACLES[name])


def test_lines_that_begin_with_their_number(spark, small, tmp_path):
    texts = ["0 zero here\n1219 one here\n2 two here\n33 three here 3", "  spaces before\nand after  \n  both sides  ", "", None, "1\n1\n1\n\n4"]
    docs = [{"doc_id": i, "text": t, "lang": "en", "source": "src1", "n_chars": 1} for i, t in enumerate(texts)]
    assert said(spark, small, tmp_path, "aligned_text_nodes", documents=docs) == ""


def talk(*texts):
    return [{"conv_id": 1, "turn": i, "role": "user", "text": t} for i, t in enumerate(texts)]


def test_short_answers_that_break_another_rule(spark, small, tmp_path):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty one"
    rows = talk(long, "the the the the", long, "I'm sorry, I cannot", long, "Text: so", long, "...", long, None, long, "", "Published", "Other things", "Published it", "42", "13", "")
    assert said(spark, small, tmp_path, "retention_and_hallucination", conversations=rows) == ""


def test_jaccard_of_copies_and_sizes(spark, small, tmp_path):
    """All pairs, copies and ids that come twice included, by hash filters as by brute force."""
    import random

    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    sets = [draw.sample(words, draw.randint(1, 50)) for _ in range(60)]
    sets += [s[: len(s) * 2 // 3] + draw.sample(words, draw.randint(0, 9)) for s in sets] + sets[:9] + [["the"]] * 5 + [list(reversed(sets[0]))]
    rows = [{"conv_id": i // 3, "turn": i % 3 if i != 50 else 1, "role": draw.choice(["user", "assistant"]), "text": " ".join(s)} for i, s in enumerate(sets)]
    rows += [{"conv_id": 900, "turn": 0, "role": "assistant", "text": t} for t in (None, "", "?!")]
    assert said(spark, small, tmp_path, "near_duplicates_jaccard", conversations=rows) == ""


def test_jaccard_carries_no_set_per_token(spark):
    """What a token of a prefix takes along is bounded, however long its text."""
    from prosemill.operators import corpus

    docs = spark.createDataFrame([(1, "a b"), (2, "a b c")], "id long, text string")
    plan = corpus.jaccard_matches(docs.withColumnRenamed("id", "lid"), docs.withColumnRenamed("id", "rid"), 50)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "explode(tokens" not in plan


def test_code_words_beside_letters_beyond_ascii(spark, small, tmp_path):
    texts = ["Le élet est une à deux.", "one leté two three four", "one xlet two three four", "one let two three four", "é=>é one two", "one _var two three four", "functioné one two three"]
    page = "<html><head><title>t</title></head><body><article><h1>One two three four</h1>{}</article></body></html>"
    pages = [{"page_id": i, "url": "u", "html": page.format(f"<p>{t}</p>")} for i, t in enumerate(texts)]
    assert said(spark, small, tmp_path, "html_units", pages=pages) == ""


def test_turns_that_loop_are_counted_as_loops(spark, tmp_path):
    """The one rule that the SQL lacks."""
    rows = talk("One two three four.", "so the, the the the end", "One two three four.", "Complex: the the the the", "the the the")
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "conversations.parquet")
    got = {r.reason: r.n for r in QUERIES["prompted_guard_counts"](spark, str(tmp_path)).collect()}
    assert got == {"degenerate_repetition": 1, "prompt_echo": 1, "accepted": 2}
