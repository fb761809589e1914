"""Page units, write-back, files and streams."""

import pytest

from prosemill.operators import page_units, write_back
from prosemill.sources import files


def units(spark, html, document=False):
    df = page_units.with_reasons(page_units.page_units(spark.createDataFrame([(1, html)], "page_id long, html string")), document)
    return [(r.tag, r.raw.strip(), r.reason) for r in df.orderBy("pos", "chunk").collect()]


def test_leaves_and_reasons(spark):
    html = "<article><h1>Title here is long</h1><p>One two three four.<br>five<p>Code { x; }</p><pre><p>a b c d</p></pre><ul><li>see https://a b c<li>1 2 3 4</ul><p translate=no>x y z w</p><span>lone span text here now</span></article>"
    got = units(spark, html)
    assert ("p", "One two three four.", None) in got and ("p", "five", "under-min-words") in got
    assert ("p", "Code { x; }", "code-like-text") in got and ("p", "a b c d", "code-or-preformatted") in got
    assert ("li", "see https://a b c", "bare-url") in got and ("li", "1 2 3 4", "no-letters") in got
    assert ("p", "x y z w", "opted-out") in got and ("span", "lone span text here now", None) in got
    assert ("h1", "Title here is long", "section-heading") in units(spark, html, document=True)


def test_chunks_strip_and_pin():
    page = page_units.Page("<p>a<sup>1</sup> b\n\nc <i aria-hidden=true>x</i><b class='x notranslate'>Name</b></p>")
    chunks = page.chunks(1)
    assert [["".join(t for t, _, _ in c)] for c in chunks] == [["a b\n\n"], ["c Name"]]
    assert [p for _, _, p in chunks[1]] == [False, True]
    assert page_units.joined_chunks(["a", "b", "c"], ["a", "b\n\n", "c"]) == "a\nb\n\nc"
    assert page_units.plain_and_links('<a href="/x">go</a> now') == ("go now", [{"text": "go", "url": "/x"}])


def test_section_groups(spark):
    html = "<article><h2>A b c d</h2>" + "".join(f"<p>{'word ' * 100}{i}</p>" for i in range(5)) + "<h2>E f g h</h2><p>One two three four</p></article>"
    got = page_units.section_groups(page_units.page_units(spark.createDataFrame([(1, html)], "page_id long, html string"))).orderBy("at").collect()
    assert [(r.section, r.group_no) for r in got] == [(1, 0), (1, 0), (1, 0), (1, 1), (1, 1), (2, 0)]


@pytest.mark.parametrize(
    ("texts", "output", "nested", "pinned", "want"),
    [
        (["The cat", "sat down"], "The cat sat down", [], [], ["The cat ", "sat down"]),
        (["Old text", "link", "more"], "New text link and more", [False, True, False], [], ["New text ", "link and ", "more"]),
        (["alpha", "NAME", "omega"], "beta NAME gamma", [], [False, True, False], ["beta ", "", " gamma"]),
        (["a"], "whole answer", [], [], ["whole answer"]),
        ([], "x", [], [], []),
    ],
)
def test_align(texts, output, nested, pinned, want):
    got = write_back.align(texts, output, nested, pinned)
    assert got == want or "".join(got) == output.replace("NAME", "")


def test_distribute():
    units = ["Cats like warm milk very much.", "Dogs chase red balls in parks.", "Birds sing songs at dawn."]
    assert write_back.distribute(units, "Cats like milk. Dogs chase balls. They run in parks. Birds sing.") == ["Cats like milk.", "Dogs chase balls. They run in parks.", "Birds sing."]
    assert write_back.distribute(units, "") == ["", "", ""]
    assert write_back.distribute(["a", "b"], "One. Two.") == ["One.", "Two."]


def test_files(spark, tmp_path):
    (tmp_path / "s").write_text("a\nb\nc\n")
    (tmp_path / "t").write_text("x\ny\nz\n")
    got = files.read_pairs(spark, str(tmp_path / "s"), str(tmp_path / "t")).orderBy("idx").collect()
    assert [tuple(r) for r in got] == [(0, "a", "x"), (1, "b", "y"), (2, "c", "z")]
    (tmp_path / "t").write_text("x\n")
    with pytest.raises(ValueError):
        files.read_pairs(spark, str(tmp_path / "s"), str(tmp_path / "t"))
    (tmp_path / "c.jsonl").write_text('{"index": 1, "prediction": "p"}\n{"idx": 2, "output": "q"}\nbroken\n{"index": 1, "prediction": "r"}\n')
    done = files.read_checkpoint(spark, str(tmp_path / "c.jsonl"))
    assert sorted(map(tuple, done.collect())) == [(1, "r"), (2, "q")]
    assert files.to_do(spark.range(1, 4).withColumnRenamed("id", "index"), done).count() == 1
    assert files.newest(spark, str(tmp_path / "c*")).endswith("c.jsonl")
    assert files.nfkc(spark.createDataFrame([("ﬁ",), ("a",), (None,)], "t string"), "t").collect()[0].t == "fi"
