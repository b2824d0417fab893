import re

import pytest
from loomquill.functions import text as X
from loomquill.functions.text import Patterns
from loomquill.operators import tone as T
from pyspark.sql import functions as F


def one(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", expr(F.col("t"))).orderBy("i").collect()]


def test_clean_text(spark):
    assert one(spark, ["a-\nb  c\n d ", None, "", "x  y\x1cz"], X.clean_text) == ["ab c d", "", "", "x y z"]


def test_tokens(spark):
    got = one(spark, ["Åsa och ÖVER 12 a-b Émile", None, ""], lambda c: X.tokens(c, 3, ["och"]))
    assert got == [["åsa", "över", "émile"], None, []]
    assert one(spark, ["a bb"], lambda c: X.tokens(c, 1)) == [["a", "bb"]]


def split_rule(t):
    """The rule in Python: mask the stops of abbreviations, cut behind the others."""
    listed = "|".join(re.escape(a + ".") for a in sorted(X.ABBREVIATIONS, key=len, reverse=True))
    masked = re.sub(rf"\b(?:{listed})", lambda m: m.group().replace(".", "\0"), t, flags=re.IGNORECASE)
    at, out = 0, []
    for m in re.finditer(r"(?<=[.!?])[\"'’»)\]]*\s+", masked):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(t)))
    spans = []
    for a, b in out:
        s = t[a:b].strip()
        if s:
            a += len(t[a:b]) - len(t[a:b].lstrip())
            spans.append((a, a + len(s)))
    return spans


SAMPLES = ["Ett. Två! Tre? Fyra", "Bl.a. detta. T.ex. det", 'Han sa "ja." Sedan gick han.', "Pi är 3.14 ca. 22 m.m. och slut.", "", "   ", ". . .", "A.\n\nB.)  C", "nr. 5 och XNR. 6", "kr. Kr. åkr. slut", "f.d. e.d. etc. Nej.»  Jo"]


def test_sentences(spark, rng_texts):
    texts = SAMPLES + rng_texts
    want = [[t[a:b] for a, b in split_rule(t)] for t in texts]
    assert one(spark, texts, X.sentences) == want
    got = one(spark, texts, T.sentence_spans)
    assert [[(s.start, s.end) for s in r] for r in got] == [split_rule(t) for t in texts]
    assert one(spark, [None], X.sentences) == [[]]


@pytest.fixture(scope="module")
def rng_texts():
    import random

    gen = random.Random(1)
    bits = ["ca.", "T.ex.", "ord", "Ord", "3.5", ".", "!", "?", '"', "»", ")", " ", "  ", "\n", "över", "nr.", "xca.", "åkl."]
    return ["".join(gen.choice(bits) + gen.choice(["", " "]) for _ in range(gen.randrange(40))) for _ in range(300)]


PAT = Patterns(("de rika", "de rikaste", "folk", "vanligt folk"), {"de rikaste": ("länderna", "kommunerna")})


def test_word_borders_and_longest_first(spark):
    texts = ["De rikaste betalar", "de rikaste länderna", "de rikaste  kommunerna och folk", "folket", "Åfolk", "VANLIGT FOLK, folk", None]
    assert one(spark, texts, lambda c: X.matches(c, PAT)) == [["de rikaste"], [], ["folk"], [], [], ["vanligt folk", "folk"], None]


def test_spans_equal_matches(spark):
    import random

    gen = random.Random(4)
    words = ["de", "rika", "rikaste", "länderna", "folk", "vanligt", "folket", ".", "Ö"]
    texts = [" ".join(gen.choice(words) for _ in range(gen.randrange(25))) for _ in range(400)]
    assert not PAT.overlapping
    spans = one(spark, texts, lambda c: T.find_spans(c, PAT))
    assert [[s.pattern for s in r] for r in spans] == one(spark, texts, lambda c: X.matches(c, PAT))
    assert all(t[s.start : s.end].lower() == s.pattern for t, r in zip(texts, spans) for s in r)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    fast = T.measure(df, PAT).select("hits").collect()
    exact = df.select(T._sentences_with_span(F.col("text"), PAT)).collect()
    assert [r[0] for r in fast] == [r[0] for r in exact]


def test_overlapping_exclusions_take_the_exact_way(spark):
    p = Patterns(("rika", "de rika"), {"de rika": ("länderna",)})
    df = spark.createDataFrame([("de rika länderna.",), ("de rika folk. rika länderna",)], "text string")
    assert p.overlapping and [r.hits for r in T.measure(df, p).collect()] == [0, 2]


@pytest.mark.parametrize("words", [(), ("a", "A"), (" ",), ("a.b",)])
def test_bad_tables(words):
    with pytest.raises(ValueError):
        Patterns(words)


def test_slug(spark):
    got = one(spark, [" Åsa Öberg-Lind ", "ASA OBERG", "José  Núñez", "", "--", "Ørsted ü"], X.slug)
    assert got == ["asa-oberg-lind", "asa-oberg", "jose-nunez", "", "", "orsted-u"]


def test_lexicon_score(spark):
    got = one(spark, ["bra bra dåligt", "inte alls bra", None, "bra, x"], lambda c: X.lexicon_score(c, {"bra": 1.0, "dåligt": 2.0}, {"inte alls": 3.0}))
    assert [round(x, 6) for x in got] == [round(400 / 3, 6), round(400 / 3, 6), 0.0, 0.0]


def test_lix_words(spark):
    assert one(spark, ["Två ord_3 åäö 12x", None], X.reading_words) == [["Två", "ord", "3", "åäö", "12", "x"], []]
