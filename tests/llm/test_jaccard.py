import re

import oracle
import pytest

from loomquill.llm import jaccard as J
from loomquill.llm.queries import QUERIES


def gram_set(t, n=J.N):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, threshold):
    sets = {}
    for i, t in rows:
        if i is not None and t is not None:
            sets[i] = max(sets.get(i, ""), t)
    sets = {i: gram_set(t) for i, t in sets.items()}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def pairs_of(found):
    """All pairs of documents, from classes and pairs of representatives."""
    classes, pairs = found
    docs = {}
    for r in classes.collect():
        docs.setdefault(r.rep, []).append(r.doc_id)
    out = {(a, b): 1.0 for d in docs.values() for a in d for b in d if a < b}
    for r in pairs.collect():
        for a in docs[r.a]:
            for b in docs[r.b]:
                assert (min(a, b), max(a, b)) not in out
                out[min(a, b), max(a, b)] = round(r.jaccard, 6)
    return out


def summary(ids, links):
    """What similar_documents gives, from all pairs."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = dict.fromkeys(ids, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return sorted((i, find(i), n[i]) for i in ids)


def near_copies(rng, groups=25):
    vocab = [f"w{k}" for k in range(300)] + ["the", "of"] * 20
    rows, k = [], 0
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, 6)):
            t = list(base)
            for _ in range(rng.randrange(0, 8)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((k, " ".join(t)))
            k += 1
    return rows


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9, 1.0])
def test_equals_brute_force(make, rng, threshold):
    rows = near_copies(rng)
    want = brute(rows, threshold)
    assert pairs_of(J.classes_and_pairs(make(rows), threshold=threshold)) == want
    assert sorted(map(tuple, J.similar_documents(make(rows), threshold=threshold).collect())) == summary([i for i, _ in rows], want)


def test_split_grams_lose_and_repeat_nothing(make, rng, monkeypatch):
    """Every gram with four or more documents is hot here, and few pairs are held."""
    rows = near_copies(rng)
    for k in range(60):
        rows.append((1000 + k, " ".join(f"y{j}" for j in range(50)) + f" z{k}"))
    from loomquill.llm import jaccard

    hot, blocks, candidates = 2, jaccard._blocks, jaccard._candidates
    monkeypatch.setattr(jaccard, "_blocks", lambda n, _: blocks(n, hot))
    monkeypatch.setattr(jaccard, "_candidates", lambda t, _: candidates(t, hot))
    assert pairs_of(J.classes_and_pairs(make(rows))) == brute(rows, J.THRESHOLD)


def test_odd_rows(make, rng):
    long = " ".join(f"v{k}" for k in range(30_000))
    rows = [(1, None), (None, "a b c d"), (2, ""), (3, "?!"), (4, "a b c d"), (5, "A b C d"), (5, "A b C d"), (6, "a"), (7, "A"), (8, long), (9, long + " tail"), (10, "a b c d")]
    assert pairs_of(J.classes_and_pairs(make(rows))) == brute(rows, J.THRESHOLD)
    assert sorted(map(tuple, J.similar_documents(make(rows)).collect())) == summary([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], brute(rows, J.THRESHOLD))
    assert J.similar_documents(make([])).count() == 0
    left = {r.doc_id for r in J.one_of_each(make(rows)).collect()}
    assert left == {1, None, 2, 3, 4, 6, 8}
    assert J.one_of_each(make(rows)).columns == make(rows).columns


def test_large_groups_of_copies(make):
    base = " ".join(f"x{k}" for k in range(40))
    rows = [(i, base + f" t{i % 3}") for i in range(1500)]
    assert J.classes_and_pairs(make(rows))[1].count() == 3
    assert {tuple(r)[1:] for r in J.similar_documents(make(rows)).collect()} == {(0, 1499)}


def test_bitmaps_bound_the_difference(rng):
    import numpy as np

    for _ in range(200):
        a = {rng.getrandbits(59) for _ in range(rng.randrange(1, 2000))}
        b = set(rng.sample(sorted(a), rng.randrange(len(a)))) | {rng.getrandbits(59) for _ in range(rng.randrange(1, 300))}
        x, y = (J._bitmaps(np.array(sorted(s), dtype=np.uint64), np.array([len(s)]))[0].as_py() for s in (a, b))
        assert J.least_difference(x, y) <= len(a ^ b)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)], "a long, b long")
    assert {r.node: r.root for r in J.components(edges).collect()} == {2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 21: 20}


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert not oracle.difference(QUERIES["op5_ngram_jaccard"](spark, sf), J.SQL, sf)


def cluster(rng, n, words=80, edits=4):
    """Texts that differ from one in a few words each, and one far from most of them."""
    base = [f"b{k}" for k in range(words)]
    texts = []
    for k in range(n):
        w = list(base)
        for at in rng.sample(range(words), 14 if k == n - 1 else rng.randrange(edits + 1)):
            w[at] = f"e{rng.randrange(40)}"
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("grams", [2_000_000, 1500])
def test_pairs_of_a_cluster_are_counted_and_not_listed(make, rng, monkeypatch, grams):
    """A cluster's pairs grow with its square, so they mustn't become rows; one part or several."""
    texts = cluster(rng, 150) + [t for _, t in near_copies(rng, 8)] + [f"b{k} b{k + 1} b{k + 2}" for k in range(20)]
    rows = list(enumerate(texts + texts[:20]))
    rng.shuffle(rows)
    listed = {}

    def written(df, name, keep=J.written):
        listed[name] = (out := keep(df, name)).count()
        return out

    monkeypatch.setattr(J, "written", written)
    monkeypatch.setattr(J, "STAR_GRAMS", grams, raising=False)
    got = sorted(map(tuple, J.similar_documents(make(rows)).collect()))
    links = brute(rows, J.THRESHOLD)
    assert got == summary([i for i, _ in rows], links)
    assert listed["candidates"] < len(links) / 5
