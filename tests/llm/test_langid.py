import math

import numpy as np
import pyarrow as pa
import pytest

from loomquill.llm import langid as G
from loomquill.llm.queries import TOKENIZERS, table


def tiny():
    vocab = [b" ", b"a", b"b", b" a", b"ab", b"ba", b" ab", "é".encode()]
    return vocab, G.fit_texts(["ab ba ab", "ba ba é", "b b"], ["x", "y", "x"], vocab)


def brute_word(model, vocab, word, lang):
    """Sum over all segmentations, by recursion over bytes."""
    p = {}
    for v in vocab:
        h = G._poly(np.frombuffer(v, dtype=np.uint8)[None, :])[0, -1]
        p[v] = model.probs[np.searchsorted(model.keys, h), lang]
    s = b" " + word
    acc = [1.0] + [0.0] * len(s)
    for i in range(1, len(s) + 1):
        acc[i] = acc[i - 1] * G.FLOOR + sum(acc[i - k] * p.get(s[i - k : i], 0.0) for k in range(1, i + 1))
    return math.log(acc[-1])


def test_forward_is_the_sum_over_segmentations():
    vocab, model = tiny()
    for text in ("ab", "ba", "abba", "é", "zab", "aéb", "bbbbbbbbbb"):
        data, off = np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text.encode())])
        low, s, e, _ = G.words_of(data, off)
        got = G.log_words(model, low, s, e)[0]
        assert np.allclose(got, [brute_word(model, vocab, text.encode(), k) for k in range(2)])


def brute_long(model, vocab, word, lang):
    """The same sum in exact fractions."""
    from fractions import Fraction

    p = {v: Fraction(float(model.probs[np.searchsorted(model.keys, G._poly(np.frombuffer(v, dtype=np.uint8)[None, :])[0, -1]), lang])) for v in vocab}
    s = b" " + word
    acc = [Fraction(1)]
    for i in range(1, len(s) + 1):
        x = acc[i - 1] * Fraction(G.FLOOR) + sum(acc[i - k] * p.get(s[i - k : i], 0) for k in range(1, min(i, 40) + 1))
        acc.append(x.limit_denominator(10**400) if i % 50 == 0 else x)
    x = acc[-1]
    return (math.log(x.numerator) - math.log(x.denominator)) if x else -math.inf


def test_long_words_and_sentences_without_blanks_are_whole():
    vocab = [b" ", b"a", b"b", b"ab", b"ba", "中文".encode(), "的".encode(), "语言识别需要很多字".encode(), b"a" * 37]
    model = G.fit_texts(["ab ba ab aaa", "ba ba 中文的", "b b 的的"], ["x", "y", "x"], vocab)
    assert model.longest == 37
    for text in ("ab" * 100, "中文的语言识别需要很多字" * 12, "a" * 150 + "é" * 20):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        low, s, e, _ = G.words_of(data, np.array([0, len(data)]))
        assert len(s) == 1
        assert np.allclose(G.log_words(model, low, s, e)[0], [brute_long(model, vocab, text.encode(), k) for k in range(2)], rtol=1e-9)
    got = G.score_texts(pa.array(["a" * 100, "中文的语言。识别需要", "ПРИВЕТ", "привет", "b" * 9000, None]), model).to_pylist()
    assert [r["n_words"] for r in got] == [1, 2, 1, 1, 1, 0] and got[2] == got[3] and all(math.isfinite(r["per_byte"]) for r in got)


def test_probabilities_sum_to_one():
    _, model = tiny()
    assert np.allclose(model.probs.sum(axis=0), 1) and (model.probs[-1] == 0).all()


@pytest.fixture(scope="module")
def fitted(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    return docs, G.fit(docs, f"{TOKENIZERS}/piece_bpe_32k.model", per_language=60)


def test_held_out_accuracy(fitted):
    docs, model = fitted
    rows = G.identify(docs, model).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars > 100").toPandas()
    assert (rows.language == rows.lang).mean() > 0.97


def test_memory_of_words_changes_nothing(fitted):
    docs, model = fitted
    texts = pa.array([r.text for r in docs.limit(80).collect()])
    first = G.score_texts(texts, model).to_pylist()
    assert first == G.score_texts(texts, model).to_pylist()
    one = [G.score_texts(pa.array([t.as_py()]), model).to_pylist()[0] for t in texts]
    assert [r["language"] for r in one] == [r["language"] for r in first]


def test_odd_rows(make, fitted):
    _, model = fitted
    rows = [(1, None), (2, ""), (3, "123 ..."), (None, "the house of the people"), (4, "x" * 100_000), (5, "und der die das"), (5, "und der die das")]
    got = G.identify(make(rows), model).collect()
    assert len(got) == 7
    for r in got:
        assert (r.language is None) == (r.doc_id in (1, 2, 3)) and (r.n_words == 0) == (r.language is None)
    assert G.identify(make([]), model).count() == 0
    from pyspark.sql import functions as F

    d = make(rows).withColumn("lang", F.when(F.col("doc_id") == 4, None).otherwise("de"))
    kept = G.keep_identified(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} >= {4, 5}
    assert not {1, 2, 3} & {r.doc_id for r in kept.collect()}


def test_keeps_clean_documents(fitted):
    docs, model = fitted
    n = docs.where("n_chars > 30").count()
    assert G.keep_identified(docs, model).count() >= 0.97 * n


def test_without_languages(spark, make):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = G.fit(d, f"{TOKENIZERS}/piece_bpe_32k.model")
    assert G.identify(make([(1, "word")]), model).first().language is None
