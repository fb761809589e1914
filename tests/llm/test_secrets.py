import hashlib
import random
import re
import string

from prosemill.llm.secrets import KINDS, Scanner, find_secrets, joined, redacted

PATTERNS = (
    (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def brute(text):
    out = []
    for k, (pattern, ok) in enumerate(PATTERNS):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return sorted(out)


def random_text(rng):
    bits = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "AKIA", "\n", "é", "K", "ſ", "ab12", "deadbeef" * 3, "F", "AKIA" + "Z9" * 9, "x.y-z", "token=", "abcdef0123456789"]
    return "".join(rng.choice(bits) for _ in range(rng.randrange(30)))


def test_base_as_brute_force():
    rng, scanner = random.Random(2), Scanner()
    for _ in range(4000):
        t = random_text(rng)
        assert scanner.base(t) == brute(t), t
        assert set(scanner.base(t)) <= set(scanner.spans(t))


def test_novel_strings():
    rng, scanner = random.Random(4), Scanner()
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    text = f"send the header Authorization Bearer {key} with it"
    assert [text[a:b] for a, k, b in scanner.spans(text) if KINDS[k] == "novel"] == [key]
    assert scanner.spans("authorization of the_example_connection_timeout_1 and created_at_updated_at_1") == []
    assert scanner.spans(f"no such word near it {key}") == []
    assert redacted(text, scanner.spans(text)) == "send the header Authorization Bearer [secret] with it"


def test_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in find_secrets(docs).collect():
        base = brute(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()


def test_edges(spark):
    rows = [(None, "token=abcdefg"), (1, None), (1, ""), (2, "a" * 200_000), (3, "password" + " " * 50_000 + "=x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, Text int")
    got = sorted((r.doc_id or 0, r.spans) for r in find_secrets(df).collect())
    assert got == [(0, "assign:0:13"), (1, ""), (1, ""), (2, "hex:0:200000"), (3, "")]
    assert find_secrets(df.where("false")).count() == 0


def test_keys_of_every_alphabet_are_novel():
    """Random keys after a sensitive word are reported; words, identifiers and repeats are not."""
    import random
    import string

    rng, scanner = random.Random(1), Scanner()

    def reported(make):
        texts = ["Some words before it. auth bearer " + make() + " and then the text goes on" for _ in range(100)]
        return sum(bool(scanner.novel(t)) for t in texts)

    for alphabet, n in ((string.ascii_letters, 24), (string.digits, 20), (string.ascii_letters + string.digits, 32), ("0123456789abcdef", 23)):
        assert reported(lambda: "".join(rng.choice(alphabet) for _ in range(n))) >= 95  # noqa: B023
    parts = "th on er an re ed in ou ha st en ti".split()
    assert reported(lambda: "".join(rng.choice(parts) for _ in range(12))) == 0
    assert reported(lambda: "getUserNameFromAccessTokenFactoryBean") == 0
    key = "k4" + "".join(rng.choice(string.ascii_letters) for _ in range(30))
    assert scanner.novel(f"{key} {key} {key} token {key}") == []


def test_novel_spans_as_their_definition():
    """Brute force: every run of key-like characters that begins in reach of a sensitive word, judged
    by the bytes it adds."""
    import random
    import re
    import string

    from prosemill.llm.secrets import SENSITIVE, SHORTEST, SURROUNDING, least_novelty

    rng, scanner = random.Random(3), Scanner()
    for _ in range(60):
        words = []
        for _ in range(rng.randint(5, 60)):
            words.append(rng.choice([rng.choice(SENSITIVE), "plain", "a", "".join(rng.choice(string.ascii_letters + string.digits + "_-") for _ in range(rng.choice([5, 17, 30])))]))
        text = " ".join(words)
        ends = [m.end() for m in re.finditer("|".join(map(re.escape, SENSITIVE)), text, re.IGNORECASE)]
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}={0,2}", text):
            near = any(e <= m.start() <= e + SURROUNDING for e in ends)
            if near and scanner.novelty(text, *m.span()) >= least_novelty(m[0]):
                want.append((m.start(), 3, m.end()))
        got = scanner.novel(text)
        assert [x for x in got if x in want] == got
        inside = [x for x in want if not any(x[0] < e < x[2] for e in ends)]
        assert set(inside) <= set(got) and SHORTEST == 16
