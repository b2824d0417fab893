import numpy as np
import oracle
import pytest

from loomquill.llm import linededup as D
from loomquill.llm.queries import QUERIES

LONG = "this line has more than twenty characters"


def brute(rows, least=20):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for k, x in enumerate(t.split("\n")):
            if len(x) >= least:
                first.setdefault(x, (i, k))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        keep = lines if i is None else [x for k, x in enumerate(lines) if len(x) < least or first[x] == (i, k)]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_perfect_hash_is_minimal_and_perfect(n):
    h = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    h = np.unique(h)
    pilots = D.build_mph(h)
    at = D._slots(h, pilots[D._bucket(h, len(h))], len(h))
    assert sorted(at.tolist()) == list(range(len(h)))


def test_counts_and_first_documents_whatever_the_fingerprints(monkeypatch):
    """All fingerprints collide; every line still has its own slot, and large counts are exact."""
    import pyarrow as pa

    monkeypatch.setattr(D, "_print", lambda h: np.zeros(len(h), dtype=np.uint32))
    gen = np.random.default_rng(1)
    h = np.unique(gen.integers(-(1 << 63), 1 << 63, 4000))
    n = np.where(gen.random(len(h)) < 0.1, gen.integers(2, 1000, len(h)), 1)
    doc = gen.integers(-5, 1 << 40, len(h))
    row = D._index_shard((pa.scalar(0),), pa.table({"h": h, "n": n, "doc": doc}))
    shard = D.Shard(*(np.frombuffer(row[c][0].as_py(), dtype=t) for c, t in D._KINDS))
    count, first = shard.probe(h.view(np.uint64))
    assert (count == n).all() and (first == np.where(n > 1, doc, 0)).all()


def test_equals_brute_force(make, rng):
    pool = [f"{LONG} number {k}" for k in range(30)] + ["short", ""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for i in range(200)]
    rows += [(None, f"{LONG}\n{LONG}"), (500, None), (501, ""), (502, "\n\n"), (503, (LONG + "\n") * 20_000)]
    got = sorted((tuple(r) for r in D.line_dedup(make(rows)).collect()), key=str)
    assert got == brute(rows)


def test_repeated_rows_stay_equal(make):
    got = [tuple(r) for r in D.line_dedup(make([(1, f"{LONG}\nx"), (1, f"{LONG}\nx"), (2, LONG)])).collect()]
    assert sorted(got) == [(1, f"{LONG}\nx", 2, 0), (1, f"{LONG}\nx", 2, 0), (2, "", 1, 1)]


def test_empty_table_and_columns(make):
    assert D.line_dedup(make([])).count() == 0
    df = make([(1, LONG)])
    assert D.dedup_text(df).columns == [*df.columns, "__clean", "_lines", "_dropped"]


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert not oracle.difference(QUERIES["op2_line_dedup"](spark, sf), D.SQL, sf)
