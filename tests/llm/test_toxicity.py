import itertools
import math
import time

import numpy as np
import pyarrow as pa
import pytest

from loomquill.llm import toxicity as X
from loomquill.llm.queries import table

SF1 = "/root/testdata/sf0.1"


def brute_marginals(em, trans):
    """P(label = 1) of each token by summing over all label sequences."""
    total, ones = 0.0, np.zeros(len(em))
    for ys in itertools.product((0, 1), repeat=len(em)):
        w = math.exp(sum(e * y for e, y in zip(em, ys)) + sum(trans[a][b] for a, b in zip(ys, ys[1:])))
        total += w
        ones += np.array(ys) * w
    return ones / total


def test_forward_backward_is_the_sum_over_all_sequences():
    gen = np.random.default_rng(3)
    sizes = [1, 4, 7, 2]
    em, trans = gen.normal(0, 2, sum(sizes)), gen.normal(0, 1, (2, 2))
    first = np.cumsum([0, *sizes[:-1]])
    got = X.marginals(em, first, trans)
    want = np.concatenate([brute_marginals(em[a : a + n], trans) for a, n in zip(first, sizes)])
    assert np.allclose(got, want, atol=1e-9)


def plain_marginals(em, first, trans):
    """The same recursion word by word."""
    t, n = np.exp(trans), len(em)
    a, b = em.copy(), np.zeros(n)
    heads = set(first.tolist())
    for i in range(1, n):
        if i not in heads:
            a[i] += X._step(a[i - 1], t)
    for i in range(n - 2, -1, -1):
        if i + 1 not in heads:
            b[i] = X._step(em[i + 1] + b[i + 1], t.T)
    return 1 / (1 + np.exp(-np.clip(a + b, -40, 40)))


def test_long_sentences_in_blocks_equal_word_by_word():
    gen = np.random.default_rng(4)
    sizes = [1, X.BLOCK, X.BLOCK + 1, 3000, 5, 2 * X.BLOCK, 1]
    em, trans = gen.normal(0, 6, sum(sizes)), gen.normal(0, 2, (2, 2))
    first = np.cumsum([0, *sizes[:-1]])
    assert np.allclose(X.marginals(em, first, trans), plain_marginals(em, first, trans), atol=1e-9)
    # a long sentence takes about as long as the same words in short ones
    em = gen.normal(0, 3, 200_000)
    began = time.perf_counter()
    X.marginals(em, np.arange(0, len(em), 8), trans)
    short = time.perf_counter() - began
    X.marginals(em, np.array([0]), trans)
    assert time.perf_counter() - began - short < 8 * short + 0.5


def test_long_words_that_differ_in_the_middle_differ():
    a, b = (np.frombuffer(f"abcdefgh{c}stuvwxyz".encode(), dtype=np.uint8) for c in "xy")
    s, e = np.array([0]), np.array([17])
    assert X.features(a, s, e)[0, 0] != X.features(b, s, e)[0, 0]


def test_range_hash_of_long_texts_is_the_same():
    from loomquill.llm import textkit as tk

    data = np.frombuffer(("some words in a row " * 150_000).encode() + b"x" * 3_000_000, dtype=np.uint8)
    s, e = tk.runs(tk.WORD[data], np.array([0, len(data)]))
    assert (tk.range_hash(data, s, e) == tk._range_hash(data, s, e)).all()


@pytest.fixture(scope="module")
def fitted(spark):
    docs = table(spark, SF1, "documents")
    return docs, X.fit(docs, table(spark, SF1, "labels"))


def test_finds_held_out_toxic_documents_and_leaves_clean_ones(spark, fitted):
    docs, _ = fitted
    labels = table(spark, SF1, "labels").select("doc_id", "toxic").distinct().toPandas().set_index("doc_id").toxic
    texts = docs.toPandas().set_index("doc_id").text
    ids = [i for i in labels.index if i in texts.index]
    train, held = [i for i in ids if i % 3], [i for i in ids if i % 3 == 0]
    crf = X.train([texts[i] for i in train], labels[train].to_numpy())
    got = X.score_texts(pa.array([texts[i] for i in held]), crf).field("toxic").to_numpy(zero_copy_only=False)
    y = labels[held].to_numpy().astype(bool)
    # one in seven toxic documents of this table has an invented marker that is too rare to be learned from it
    assert (got & y).sum() / y.sum() >= 0.8
    assert (got & ~y).sum() / (~y).sum() <= 0.02
    profane = np.array([any(w in texts[i].lower().split() for w in ("idiot", "scum", "moron", "clown", "trash", "loser")) for i in held])
    assert (got & y & profane).sum() >= 0.97 * (y & profane).sum()


def test_spans_are_offsets_into_the_text(fitted):
    docs, crf = fitted
    rows = X.toxic_spans(docs, crf).where("toxic").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert rows
    for r in rows:
        for s in r.spans:
            part = r.text[s.start : s.end]
            assert part and part == part.strip() and 0.5 <= s.score <= 1
            assert (s.start == 0 or not r.text[s.start - 1].isalnum()) and (s.end == len(r.text) or not r.text[s.end].isalnum())


def test_odd_rows(spark, make, fitted):
    _, crf = fitted
    rows = [(1, None), (None, "some words"), (2, ""), (3, "..."), (4, "same"), (4, "same"), (5, "word " * 300_000)]
    got = {(r.doc_id, r.n_tokens): r for r in X.toxic_spans(make(rows), crf).collect()}
    assert got[(1, 0)].score == 0 and got[(2, 0)].spans == [] and (None, 2) in got and (5, 300_000) in got
    assert X.toxic_spans(make(rows), crf).count() == 7
    assert X.toxic_spans(make([]), crf).count() == 0
    kept = X.drop_toxic(make(rows), crf)
    assert kept.count() == 7 and kept.columns == make(rows).columns


def test_without_labels_nothing_is_toxic(spark, make):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    crf = X.fit(make([(1, "a b")]), none)
    assert not X.toxic_spans(make([(1, "a b")]), crf).first().toxic


def invented(gen, n):
    return ["".join(chr(97 + c) for c in gen.integers(0, 26, 8)) for _ in range(n)]


def marked(texts, toxic):
    data, _, s, e, _, _, y = X.distant_labels(texts, np.array(toxic))
    return {bytes(data[a:b]).decode() for a, b, hit in zip(s, e, y) if hit}


def test_a_marker_in_one_percent_of_many_toxic_documents_is_labelled():
    gen = np.random.default_rng(5)
    common = invented(gen, 300)
    text = lambda *more: " ".join([*gen.choice(common, 30), *more])
    texts = [text("loudmarker") for _ in range(1980)] + [text("raremarker") for _ in range(20)] + [text() for _ in range(2000)]
    assert marked(texts, [1] * 2000 + [0] * 2000) == {"loudmarker", "raremarker"}


def test_words_of_near_copies_and_of_few_documents_are_no_markers():
    gen = np.random.default_rng(6)
    common, own = invented(gen, 300), invented(gen, 60)
    copies = []
    for _ in range(40):
        t = list(own)
        t[gen.integers(0, 60)] = str(gen.choice(common))
        copies.append(" ".join(t))
    rest = [" ".join([*gen.choice(common, 30), "sixtimes"][: 31 if k < 6 else 30]) for k in range(200)]
    assert marked(copies + rest, [1] * 240) == set()
    clean = [" ".join(gen.choice(common, 30)) for _ in range(200)]
    assert marked(copies + rest + clean, [1] * 240 + [0] * 200) == set()


def test_spanish_markers_of_a_real_sample_are_labelled(spark):
    labels = table(spark, SF1, "labels").where("toxic is not null").groupBy("doc_id").agg({"toxic": "max"}).withColumnRenamed("max(toxic)", "y")
    rows = table(spark, SF1, "documents").join(labels, "doc_id").select("text", "y", "lang").toPandas().drop_duplicates("text")
    data, _, s, e, row, _, y = X.distant_labels(rows.text.tolist(), rows.y.to_numpy())
    hit = np.zeros(len(rows), dtype=bool)
    hit[row[y]] = True
    toxic = rows.y.to_numpy() == 1
    assert hit[toxic & (rows.lang == "es").to_numpy()].sum() >= 25 and not hit[~toxic].any()
