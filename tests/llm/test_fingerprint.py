import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from loomquill.llm import fingerprint as P
from loomquill.llm import textkit as tk


def chunks(t):
    x = t.encode()
    (cuts,) = tk.cdc_cuts(np.frombuffer(x, dtype=np.uint8), np.array([0, len(x)]), *P.SIZES)
    return {x[a:b] for a, b in zip([0, *cuts[:-1]], cuts)}


def brute(rows, threshold):
    texts = {}
    for i, t in rows:
        if i is not None and t:
            texts[i] = max(texts.get(i, ""), t)
    sets = {i: chunks(t) for i, t in texts.items()}
    w = lambda s: sum(map(len, s))
    return {(a, b): round(w(sets[a] & sets[b]) / w(sets[a]), 6) for a in sets for b in sets if a != b and w(sets[a] & sets[b]) >= threshold * w(sets[a]) - 1e-9}


def pairs_of(found):
    """All ordered pairs of documents, from classes and pairs of representatives."""
    classes, pairs = found
    docs: dict = {}
    for r in classes.collect():
        docs.setdefault(r.rep, []).append(r.doc_id)
    out = {(a, b): 1.0 for d in docs.values() for a in d for b in d if a != b}
    for r in pairs.collect():
        for a in docs[r.a]:
            for b in docs[r.b]:
                assert (a, b) not in out
                out[a, b] = round(r.containment, 6)
    return out


def summary(rows, pairs):
    """What containment gives, from all ordered pairs."""
    ids = sorted({i for i, _ in rows if i is not None})
    same: dict = {}
    for i in ids:
        same.setdefault(frozenset(chunks(max([t for k, t in rows if k == i and t], default="") or "")), []).append(i)
    first = {i: c[0] for c in same.values() for i in c}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    outer, inner, best = dict.fromkeys(ids, 0), dict.fromkeys(ids, 0), {}
    for (a, b), c in pairs.items():
        outer[a] += 1
        inner[b] += 1
        best[a] = min(best.get(a, (0, 0)), (-1, first[a]) if first[a] == first[b] else (-c, first[b]), key=lambda x: (x[0], x[1] != first[a], x[1]))
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return sorted((i, find(i), outer[i], inner[i], best[i][1] if i in best else None, -best[i][0] if i in best else None) for i in ids)


def family(rng, groups=15):
    word = lambda: "".join(rng.choice("abcdefgåé ") for _ in range(rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(200)) for _ in range(5)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(1, 600))]
        for _ in range(rng.randrange(1, 5)):
            t = list(base)
            at = rng.randrange(len(t))
            t[at : at + rng.randrange(3)] = [word()] if rng.random() < 0.7 else []
            rows.append((len(rows), " ".join(t) + (rng.choice(passages) if rng.random() < 0.5 else "")))
    return rows


@pytest.mark.parametrize("threshold", [0.1, 0.5, 0.8, 1.0])
def test_equals_brute_force(make, rng, threshold):
    rows = family(rng)
    rows += [(1000 + i, t) for i, t in rows[:12]] + [(2000 + i, t) for i, t in rows[:12]]
    want = brute(rows, threshold)
    assert len(want) > 10 and pairs_of(P.classes_and_pairs(make(rows), threshold)) == want
    if threshold == 0.5:
        assert sorted(map(tuple, P.containment(make(rows), threshold).collect())) == summary(rows, want)


def test_a_part_is_contained_and_a_shift_does_not_matter(make, rng):
    base = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(1500))
    got = pairs_of(P.classes_and_pairs(make([(1, base), (2, "something ahead " + base), (3, base[2000:6000])])))
    assert got[1, 2] > 0.9 and got[2, 1] > 0.9 and got[3, 1] > 0.7 and (1, 3) not in got


def test_odd_rows(make, rng):
    long = " ".join(str(rng.random()) for _ in range(20_000))
    rows = [(1, None), (None, "abc"), (2, ""), (3, "abc"), (4, "abc"), (4, "abc"), (5, long), (6, long + "x"), (7, long)]
    assert pairs_of(P.classes_and_pairs(make(rows))) == brute(rows, P.THRESHOLD)
    assert sorted(map(tuple, P.containment(make(rows)).collect())) == summary(rows, brute(rows, P.THRESHOLD))
    assert P.containment(make([])).count() == 0


def test_many_copies_and_a_popular_passage(make, rng):
    passage = " ".join(str(rng.random()) for _ in range(60))
    rows = [(i, passage + f" own {i % 3}") for i in range(900)] + [(1000 + i, passage + " ".join(str(rng.random()) for _ in range(200))) for i in range(60)]
    assert pairs_of(P.classes_and_pairs(make(rows))) == brute(rows, P.THRESHOLD)


def near_copies(rows, least):
    """Unordered pairs of different texts whose sets of word 3-grams have at least that Jaccard similarity."""
    sets = {i: set(zip(w, w[1:], w[2:])) for i, t in rows for w in [t.split()]}
    at: dict = {}
    for i, s in sets.items():
        for g in s:
            at.setdefault(g, []).append(i)
    met = {(a, b) for p in at.values() if len(p) <= 60 for a in p for b in p if a < b}
    return {(a, b) for a, b in met if least <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 1}


def test_near_copies_with_scattered_edits_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").dropDuplicates(["doc_id"])
    got = pairs_of(P.classes_and_pairs(docs))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for least, share in ((0.6, 0.95), (0.8, 1.0)):
        want = near_copies(rows, least)
        found = {(a, b) for a, b in want if (a, b) in got or (b, a) in got}
        assert len(want) > 30 and len(found) >= share * len(want), least


def test_short_texts_with_a_word_changed_in_twenty_are_found(make, rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for k in range(40):
        t = [word() for _ in range(60)]
        rows.append((2 * k, " ".join(t)))
        for at in range(rng.randrange(20), 60, 20):
            t[at] = word()
        rows.append((2 * k + 1, " ".join(t)))
    got = pairs_of(P.classes_and_pairs(make(rows)))
    assert sum((2 * k, 2 * k + 1) in got or (2 * k + 1, 2 * k) in got for k in range(40)) >= 34
    assert all(a // 2 == b // 2 for a, b in got)


def hubs_and_cluster(rng):
    """Short texts of a common line and one of their own, long ones with that line, and near copies of one text."""
    word = lambda: "".join(rng.choice("abcdefgåé") for _ in range(rng.randrange(3, 9)))
    line = " ".join(word() for _ in range(14)) + "."
    texts = [f"{line}\n{' '.join(word() for _ in range(k % 9))}" for k in range(80)]
    texts += [f"{' '.join(word() for _ in range(60))}\n{line}\n{' '.join(word() for _ in range(40))}" for _ in range(80)]
    base = [word() for _ in range(150)]
    for k in range(120):
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(150)] = word()
        texts.append(" ".join(w) + ("\n" + line) * (k % 5 == 0))
    return list(enumerate(texts + texts[::9]))


@pytest.mark.parametrize("tokens", [150_000, 700])
def test_pairs_of_hubs_and_of_a_cluster_are_counted_and_not_listed(make, rng, monkeypatch, tokens):
    """They grow with the square of the input, so they mustn't become rows; a star of one part or several."""
    rows = hubs_and_cluster(rng)
    rng.shuffle(rows)
    listed = {}

    def written(df, name, keep=P.written):
        listed[name] = (out := keep(df, name)).count()
        return out

    monkeypatch.setattr(P, "written", written)
    monkeypatch.setattr(P, "STAR_TOKENS", tokens, raising=False)
    want = brute(rows, P.THRESHOLD)
    assert sorted(map(tuple, P.containment(make(rows)).collect())) == summary(rows, want)
    assert listed["containment-candidates"] < len(want) / 4


def tallied(tally, *args):
    """Rows by document, and the MB that were held at most."""
    tracemalloc.start()
    out = tally(*args)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return {r["doc"]: (r["root"], r["outer"], r["inner"], r["containment"], r["other"]) for r in out.to_pylist()}, most


def test_a_large_star_is_tallied_in_little_memory():
    """4000 short sets of one cluster make 16 million pairs, and each set has three kinds."""
    m, common = 4000, [(k << P.WEIGHT_BITS) | 20 for k in range(1, 5)]
    tokens = [[*common, ((100 + k) << P.WEIGHT_BITS) | 16] for k in range(m)]
    kinds = [[{"total": 96 + 32 * j, "copies": 1, "least": 10 * k + j} for j in range(3)] for k in range(m)]
    got = pa.table({"doc": [10 * k for k in range(m)], "total": [96] * m, "tokens": pa.array(tokens, pa.list_(pa.int64())), "kinds": pa.array(kinds, pa.list_(pa.struct([(c, pa.int64()) for c in ("total", "copies", "least")]))), "part": [0] * m})
    found, most = tallied(P._star_tally(0.5), (pa.scalar(0),) * 3, got)
    every = 3 * (m - 1)
    want = {10 * k + j: (0, every, every, 80 / (96 + 32 * j), 0 if k else 10) if j < 3 else None for k in range(m) for j in range(3)}
    assert {d: (*r[:3], round(r[3], 9), r[4]) for d, r in found.items()} == {d: (*r[:3], round(r[3], 9), r[4]) for d, r in want.items()}
    assert most < 150


def test_a_common_line_of_many_kinds_is_tallied_in_little_memory():
    """800 totals of a common line, and 12 000 texts that have it."""
    line, n, kinds = (1 << P.WEIGHT_BITS) | 60, 12_000, 800
    struct = pa.struct([(c, pa.int64()) for c in ("total", "copies", "least")])
    own = [[{"total": 61 + j, "copies": 2, "least": j} for j in range(kinds)]] + [[{"total": 200, "copies": 1, "least": 1000 + k}] for k in range(n)]
    tokens = [[line]] + [[line, ((5 + k) << P.WEIGHT_BITS) | 50] for k in range(n)]
    left = pa.table({"doc": [0, *range(1000, 1000 + n)], "total": [61] + [200] * n, "tokens": pa.array(tokens, pa.list_(pa.int64())), "kinds": pa.array(own, pa.list_(struct))})
    found, most = tallied(P._tally(0.5), (pa.scalar(0),), left, pa.table({"a": [0] * n, "b": list(range(1000, 1000 + n))}))
    within = 120 - 61 + 1  # totals of up to twice the line
    assert found == {j: (0, n, 0, 60 / (61 + j), 1000) for j in range(within)} | {1000 + k: (0, 0, 2 * within, None, None) for k in range(n)}
    assert most < 50


@pytest.mark.parametrize(("sets", "pairs"), [(20, 400_000), (8192, 30)])
def test_small_parts_of_stars_and_cells_of_hot_digests(make, rng, monkeypatch, sets, pairs):
    monkeypatch.setattr(P, "STAR_SETS", sets, raising=False)
    monkeypatch.setattr(P, "PAIRS_BLOCK", pairs)
    met = P._met
    cells = []

    def counted(*args, **more):
        left, right = met(*args, **more)
        cells.append(right.groupBy("pair_block").count().agg({"count": "max"}).first()[0])
        return left, right

    monkeypatch.setattr(P, "_met", counted)
    parts = []
    stars = P._stars

    def split(*args):
        out = stars(*args)
        parts.append(out.agg({"parts": "max"}).first()[0])
        return out

    monkeypatch.setattr(P, "_stars", split)
    rows = hubs_and_cluster(rng)
    assert sorted(map(tuple, P.containment(make(rows)).collect())) == summary(rows, brute(rows, P.THRESHOLD))
    assert parts[0] > 1 if sets == 20 else cells[0] <= 10 * pairs
