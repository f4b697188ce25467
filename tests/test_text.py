import random

import pytest
from pyspark.sql import functions as F

from proxsearch.functions import codec, text
from proxsearch.functions.snippets import snippets
from proxsearch.functions.wildcard import legacy_matches, matches, star_budget

ACUTE, KL, HA = "́", "כל", "הא"
GOLDEN = [
    ("Hello, hello WORLD", [("Hello", 0, 0, 5), ("hello", 1, 7, 5), ("WORLD", 2, 13, 5)], None),
    ("a bb", [("bb", 0, 2, 2)], None),
    ("don't stop", [("don", 0, 0, 3), ("stop", 1, 6, 4)], None),
    ("abc123def", [("abc", 0, 0, 3), ("def", 1, 6, 3)], None),
    ('say "quo"ted" now', [("say", 0, 0, 3), ("quoted", 1, 5, 8), ("now", 2, 14, 3)], None),
    (f"e{ACUTE}tude étude", [("etude", 0, 0, 6), ("tude", 1, 8, 4)], None),
    ("well-known", [("well", 0, 0, 4), ("known", 1, 5, 5)], None),
    (f"{KL}־{HA}", [(KL, 0, 0, 2), (HA, 1, 3, 2)], None),
    ("open <tag never closed word", [("open", 0, 0, 4)], None),
    ("foo<b>bar</b> next one", [("foobar", 0, 0, 13), ("next", 1, 14, 4), ("one", 2, 19, 3)], [("fooarnext", 0, 0, 18), ("one", 1, 19, 3)]),
    ("x<i>y</i>", [("xy", 0, 0, 9)], []),
    ("word</b>", [("word", 0, 0, 8)], None),
    (f"{'w' * 44} {'w' * 45} ok", [("w" * 44, 0, 0, 44), ("ok", 1, 91, 2)], None),
    ("", [], None), (" \t\n", [], None), ("123 4", [], None), (None, [], None),
]


@pytest.mark.parametrize("mode", ["clean", "swallow"])
def test_golden_tokens(spark, mode):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(GOLDEN)], "doc_id long, text string")
    want = [(i, *w) for i, (_, c, s) in enumerate(GOLDEN) for w in (c if mode == "clean" or s is None else s)]
    assert sorted(map(tuple, text.tokens(docs, tag_mode=mode).collect()), key=lambda r: (r[0], r[2])) == want
    plain = text.word_positions(docs, tag_mode=mode).select("doc_id", "word", F.col("position").cast("int"))
    assert sorted(map(tuple, plain.collect()), key=lambda r: (r[0], r[2])) == [w[:3] for w in want]
    with pytest.raises(ValueError):
        text.tokens(docs, tag_mode="other")


def scan(s, mode):
    """The tokenizer, one character after the other."""
    letter = lambda c: c.isascii() and c.isalpha() or "א" <= c <= "ת"
    mark = lambda c: c == '"' or "֑" <= c <= "ׇ" and c != "־"
    out, i = [], 0

    def tag(i, inside):
        while i < len(s) and s[i] != ">":
            i += 1
        if i < len(s):
            i += 2 if inside and mode == "swallow" else 1
        return min(i, len(s))

    while i < len(s):
        if letter(s[i]):
            start, word = i, ""
            while i < len(s) and (letter(s[i]) or mark(s[i]) or s[i] == "<"):
                if s[i] == "<":
                    i = tag(i, True)
                else:
                    word += s[i] if letter(s[i]) else ""
                    i += 1
            if 2 <= len(word) <= 44:
                out.append((word, len(out), start, i - start))
        else:
            i = tag(i, False) if s[i] == "<" else i + 1
    return out


@pytest.mark.parametrize("mode", ["clean", "swallow"])
def test_tokens_equal_a_scanner(spark, mode):
    rng = random.Random(7)
    texts = ["".join(rng.choice('abcXY  <>"אַ־3\n') for _ in range(rng.randrange(60))) for _ in range(3000)]
    got: dict[int, list] = {}
    for r in text.tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tag_mode=mode).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert [sorted(got.get(i, []), key=lambda w: w[1]) for i in range(len(texts))] == [scan(t, mode) for t in texts]


def test_long_words_and_many_tags_need_no_stack(spark):
    docs = spark.createDataFrame([(1, "a" * 1_000_000), (2, "ab" + "<b>" * 200_000 + "c")], "doc_id long, text string")
    assert [tuple(r) for r in text.tokens(docs).collect()] == [(2, "abc", 0, 0, 600_003)]


def bounded(pattern, word, k):
    """The pattern matcher: backs up to the last star only."""
    core = len(pattern.rstrip("*?"))
    p = w = 0
    star, at, used = -1, 0, 0
    while w < len(word):
        if p < len(pattern) and pattern[p] == "*":
            star, at, used, p = p, w, 0, p + 1
        elif p < len(pattern) and (pattern[p] == "?" or pattern[p] == word[w]):
            p, w = p + 1, w + 1
        elif star >= 0 and used < k:
            used += 1
            p, w = star + 1, at + used
        else:
            return False
    return all(c == "*" or (c == "?" and i >= core) for i, c in enumerate(pattern[p:], p))


GOLDEN_WILD = {
    ("the", "the"): "TT", ("the", "The"): "FF", ("a*", "abc"): "TT", ("a*", "abcd"): "FT", ("ab*", "abcde"): "TT", ("ab*", "abcdef"): "FT", ("abc*", "abcdefgh"): "TT", ("abc*", "abcdefghi"): "FF",
    ("*ing", "standing"): "TT", ("*ing", "understanding"): "FF", ("th?", "th"): "TT", ("th?", "the"): "TT", ("th?", "them"): "FF", ("t?e", "te"): "FF", ("??", "to"): "TT", ("*", "to"): "TT", ("*", "the"): "FT",
    ("?", "ab"): "FF", ("*a*b", "aXXaXb"): "FT", ("a**b", "aXXXXb"): "FT",
}


def test_golden_wildcards(spark):
    words = sorted({w for _, w in GOLDEN_WILD})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    patterns = sorted({p for p, _ in GOLDEN_WILD})
    cols = [matches(F.col("w"), p, b).alias(f"{i}_{b}") for i, p in enumerate(patterns) for b in ("scaled", "fixed5")]
    got = {r["w"]: r for r in df.select("w", *cols).collect()}
    for (p, w), want in GOLDEN_WILD.items():
        i = patterns.index(p)
        assert (got[w][f"{i}_scaled"], got[w][f"{i}_fixed5"]) == (want[0] == "T", want[1] == "T"), (p, w)


def test_wildcards_equal_a_matcher(spark):
    rng = random.Random(8)
    patterns = sorted({"".join(rng.choice("ab*?") for _ in range(rng.randrange(1, 7))) for _ in range(120)})
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(0, 8))) for _ in range(200)})
    df = spark.createDataFrame([(w,) for w in words], "w string").coalesce(1)
    for part in (patterns[i : i + 30] for i in range(0, len(patterns), 30)):
        for r in df.select("w", *[matches(F.col("w"), p).alias(f"m{i}") for i, p in enumerate(part)]).collect():
            for i, p in enumerate(part):
                if set(p) & set("*?"):
                    assert r[f"m{i}"] == bounded(p, r["w"], star_budget(p)), (p, r["w"])


def test_legacy_matchers(spark):
    df = spark.createDataFrame([("other",), ("there",), ("the",), ("a.b",)], "w string")
    for p, want in (("the", {"the"}), ("The*", {"there", "the"}), ("*er", {"other"}), ("*the*", {"other", "there", "the"}), ("t*e", {"there", "the"}), ("a?b", {"a.b"}), ("*", {"other", "there", "the", "a.b"})):
        assert {r["w"] for r in df.where(legacy_matches(F.col("w"), p)).collect()} == want, p


def test_snippets(spark):
    rows = [
        ("alpha beta gamma delta", [[(1, 6, 4), (3, 17, 5)]], 3, ["ha <mark>beta</mark> gamma <mark>delta</mark>"]),
        ('<p class="x">alpha <b>be</b>ta gamma</p>', [[(0, 13, 5), (1, 22, 8)]], 4, ["<mark>alpha</mark> <mark>beta</mark> gam"]),
        ("a > b word tail", [[(0, 6, 4)]], 100, ["b <mark>word</mark> tail"]),
        ("any", [], 100, []), (None, [[(0, 0, 2)]], 100, []),
    ]
    for t, m, window, want in rows:
        df = spark.createDataFrame([(t, m)], "t string, m array<array<struct<position:int,char_start:int,char_len:int>>>")
        got = df.select(snippets(F.col("t"), F.col("m"), window)).first()[0]
        assert got == want


def test_codec(spark):
    rng = random.Random(9)
    lists = [[], [5], [0, 0, 7], [rng.randrange(1 << 31) for _ in range(50)]]
    df = spark.createDataFrame([(x,) for x in lists], "v array<long>")
    got = df.select(codec.delta_encode(F.col("v")).alias("d"), "v").withColumn("r", codec.delta_decode(F.col("d"))).collect()
    for r in got:
        assert r["r"] == r["v"] and r["d"] == [b - a for a, b in zip([0, *r["v"]], r["v"], strict=False)]
    sizes = [r[0] for r in spark.createDataFrame([(x,) for x in (0, 127, 128, 16383, 16384, 2097152, 268435456, -1)], "v long").select(codec.varint_size(F.col("v"))).collect()]
    assert sizes == [1, 1, 2, 2, 3, 4, 5, 5]


def test_scripts_and_marks(spark):
    row = spark.createDataFrame([("<b>x</b> <a\nb>", "אַ־בא", "étude na<b>ive a")], "a string, b string, c string").select(text.strip_tags(F.col("a")), text.strip_hebrew_marks(F.col("b")), text.unicode_words(F.col("c"))).first()
    assert tuple(row) == ("x <a\nb>", "אבא", ["étude", "naive"])
