import pytest

from loomquill.llm import bpe
from loomquill.llm.queries import TOKENIZERS

FILE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def whole(texts):
    codec = bpe.Codec.get(FILE)
    return [codec.encode((t or "").encode()).tolist() for t in texts]


@pytest.fixture(scope="module")
def shared_rows():
    import random

    gen = random.Random(2)
    word = lambda: "".join(gen.choice("abcdeèß中 1'") for _ in range(gen.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(700)) for _ in range(4)] + ["x" * 5000, " " * 3000, "a  \n\n  b" * 600, "ééé" * 900]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(gen.randrange(60))), gen.choice(passages), gen.choice(["", " ", "\n", "'s", "7"]), gen.choice(passages), word()]
        rows.append((i, "".join(parts)))
    return rows + [(1, rows[1][1]), (None, rows[2][1]), (100, ""), (101, None), (102, passages[0] * 40)]


def test_equals_encoding_the_whole_text(make, shared_rows):
    got = bpe.encode(make(shared_rows), FILE).collect()
    assert len(got) == len(shared_rows) and all(r.round_trip for r in got)
    want = sorted((str(i), t) for (i, _), t in zip(shared_rows, whole([t for _, t in shared_rows])))
    assert sorted((str(r.doc_id), r.tokens) for r in got) == want


def test_some_rows_reuse_chunks(make, shared_rows):
    from loomquill.llm import chunkstore as cs

    held = cs.repeated(make(shared_rows).selectExpr("cast(text as binary) as text"), bpe.SIZES, "t").value
    import pyarrow as pa

    used = [any(cs.is_shared(held, d)) for _, _, _, d in cs.chunks_of(pa.array([t for _, t in shared_rows], pa.string()), bpe.SIZES)]
    assert sum(used) > 20


def test_real_documents(docs):
    got = {r.doc_id: r for r in bpe.encode(docs, FILE).collect()}
    rows = docs.select("doc_id", "text").collect()
    for r, want in zip(rows, whole([r.text for r in rows])):
        assert got[r.doc_id].tokens == want and got[r.doc_id].n_bytes == len((r.text or "").encode())


def test_decode(spark, docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.decode(bpe.encode(docs, FILE), FILE).collect():
        assert r.text == text[r.doc_id]
    odd = spark.createDataFrame([(1, None), (2, [])], "doc_id long, tokens array<int>")
    assert [tuple(r) for r in bpe.decode(odd, FILE).orderBy("doc_id").collect()] == [(1, None), (2, "")]


def test_very_long_runs_of_blanks(make):
    """Pieces as the pattern makes them, by Python's own engine, each encoded alone."""
    import regex

    codec = bpe.Codec.get(FILE)
    plain = lambda t: [i for m in regex.finditer(bpe.PATTERN, t) for i in codec.encoder._core_bpe.encode_single_piece(m.group().encode())]
    for blank in (" ", "\n", "\u3000", " \n\t"):
        for text in (f"a{blank * 12_000}b", f"{blank * 12_000}", f"x  {blank * 12_000}", f"it's{blank * 11_000}\nnot {blank * 15_000}9"):
            assert codec.tokens(text) == plain(text)
    rows = [(1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 1_000_000), (3, "x" * 1_000_000), (4, "!" * 1_000_000)]
    got = {r.doc_id: r for r in bpe.encode(make(rows), FILE).collect()}
    assert all(got[i].round_trip and got[i].n_bytes == len(t) for i, t in rows)


def test_empty_table(make):
    assert bpe.encode(make([]), FILE).count() == 0
