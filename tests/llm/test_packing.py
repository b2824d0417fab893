from pyspark.sql import functions as F

from loomquill.llm import packing as P


def least_cost(sizes, lengths):
    """The least total cost of any packing, over all partitions of the pieces into bins."""
    from functools import cache

    cost = lambda n: min(16.0 + c + c * c / 8192.0 for c in lengths if c >= n)
    n = len(sizes)
    weight = [sum(sizes[i] for i in range(n) if m >> i & 1) for m in range(1 << n)]

    @cache
    def best(left):
        if not left:
            return 0.0
        low = left & -left
        rest, sub, out = left ^ low, left ^ low, float("inf")
        while True:
            if weight[sub | low] <= max(lengths):
                out = min(out, cost(weight[sub | low]) + best(rest ^ sub))
            if not sub:
                return out
            sub = (sub - 1) & rest

    return best((1 << n) - 1)


def smallest_size(sizes, lengths):
    """Best fit that always opens the smallest size that holds the piece."""
    bins = []
    for n in sorted(sizes, reverse=True):
        fits = [b for b in bins if b[0] - b[1] >= n]
        b = min(fits, key=lambda b: b[0] - b[1]) if fits else [min(c for c in lengths if c >= n), 0]
        bins += [] if fits else [b]
        b[1] += n
    return sum(16.0 + c + c * c / 8192.0 for b in bins for c in [min(c for c in lengths if c >= b[1])])


def test_costs_lie_between_the_optimum_and_the_smallest_size():
    import random

    gen, ours, simple, best = random.Random(3), 0.0, 0.0, 0.0
    for _ in range(60):
        sizes = [gen.randrange(40, 2500) for _ in range(gen.randrange(1, 10))]
        bins = P.pack(list(enumerate(sizes)))
        got = P.total_cost(bins)
        low, high = least_cost(sizes, P.LENGTHS), smallest_size(sizes, P.LENGTHS)
        assert low - 1e-6 <= got <= high + 1e-6
        ours, simple, best = ours + got, simple + high, best + low
        assert sorted(k for b in bins for k in b[2:]) == list(range(len(sizes))) and all(sum(sizes[k] for k in b[2:]) == b[1] <= b[0] for b in bins)
    assert ours < simple and ours < 1.05 * best


def test_larger_bins_are_opened_to_be_shared():
    bins = P.pack([(k, 300) for k in range(300)])
    assert P.total_cost(bins) < 0.8 * smallest_size([300] * 300, P.LENGTHS) and max(b[0] for b in bins) > 512
    import random

    gen = random.Random(8)
    sizes = [gen.randrange(200, 500) for _ in range(400)]
    assert P.total_cost(P.pack(list(enumerate(sizes)))) < 0.95 * smallest_size(sizes, P.LENGTHS)


def test_every_word_is_packed_once(docs):
    rows = P.best_fit(docs, lengths=(64, 256, 1024)).collect()
    words = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    got: dict = {}
    bins: dict = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece_start, r.piece_length))
        bins.setdefault((r.bin_id, r.capacity, r.used), []).append((r.bin_offset, r.piece_length))
    assert {i: sum(n for _, n in p) for i, p in got.items()} == {i: n for i, n in words.items() if n}
    for p in got.values():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
    for (_, cap, used), p in bins.items():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
        assert at == used <= cap and all(c >= cap or c < used for c in (64, 256, 1024))


def test_word_count_is_split(spark):
    texts = ["", " ", "a", " a\tb\n\nc ", "å é", "x\x0b\x0cy\r", "w " * 200_000, None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(P.word_count(F.col("t"))).collect()]
    assert got == [len(t.split()) if t else 0 for t in texts]


def test_odd_rows(make):
    rows = [(1, None), (None, "a b"), (2, ""), (3, "  \n"), (4, "a b c"), (4, "a b c"), (5, "w " * 100_000)]
    got = P.best_fit(make(rows)).collect()
    assert sorted((r.doc_id, r.piece_length) for r in got if r.doc_id == 4) == [(4, 3), (4, 3)]
    assert {r.doc_id for r in got} == {4, 5} and sum(r.piece_length for r in got if r.doc_id == 5) == 100_000
    assert P.best_fit(make([])).count() == 0
    by_col = P.best_fit(make(rows).withColumn("size", F.col("doc_id") - 3), length_col="size").collect()
    assert sorted(r.piece_length for r in by_col) == [1, 1, 2]


def test_loss_is_small(docs):
    bins = {(r.bin_id, r.capacity, r.used) for r in P.best_fit(docs).collect()}
    assert sum(b[2] for b in bins) / sum(b[1] for b in bins) > 0.9


def test_the_query_packs_tokens(spark, tmp_path):
    from loomquill.llm import bpe
    from loomquill.llm import queries as Q

    rows = [(1, "a b c"), (2, "xq7" * 30_000), (3, None), (4, ""), (5, "Zwölf Boxkämpfer, naïve façade! " * 900), (6, "  \n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op7_best_fit_packing(spark, str(tmp_path)).collect()
    tokens = {r.doc_id: r.n_tokens for r in Q.op4_bpe(spark, str(tmp_path)).collect()}
    packed: dict = {}
    for r in got:
        packed.setdefault(r.doc_id, []).append((r.piece_start, r.piece_length))
    assert {i: sum(n for _, n in p) for i, p in packed.items()} == {i: n for i, n in tokens.items() if n}
    assert len(packed[2]) > 1 and all(r.piece_length <= r.used <= r.capacity <= 8192 for r in got)
    for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", bpe.token_count(F.col("text"), f"{Q.TOKENIZERS}/byte_bpe_50k.tiktoken").alias("n")).collect():
        assert r.n == tokens[r.doc_id]
