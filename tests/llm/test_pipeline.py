import corpus_pipeline as C
import pytest
from test_jaccard import brute as near
from test_linededup import brute as lines

from loomquill.llm import bpe
from loomquill.llm.queries import TOKENIZERS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage, over whole tables."""
    from loomquill.llm.support import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, f in C.STAGES:
        got = written(f(spark, docs, SF), f"t-{name}")
        out[name] = (docs, got)
        docs = got
    return out


def test_order_and_columns(spark, stages):
    assert [n for n, _ in C.STAGES] == ["toxicity", "language", "line_dedup", "near_duplicates", "packing"]
    names = spark.read.parquet(f"{SF}/documents.parquet").dtypes
    for n, (_, got) in list(stages.items())[:-1]:
        assert got.dtypes == names, n


def test_toxicity(spark):
    """On a table with enough labels; a document stays exactly if its text, scored on its own, is clean."""
    import pyarrow as pa

    from loomquill.llm import toxicity as X

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in C.clean_speech(spark, docs, sf).collect()}
    crf = X.fit(docs, labels)
    rows = docs.collect()
    assert kept == {r.doc_id for r in rows if not X.score_texts(pa.array([r.text], pa.string()), crf).field("toxic")[0].as_py()}
    profane = {r.doc_id for r in rows if len({"idiot", "scum", "moron", "clown", "trash", "loser"} & set(r.text.lower().split())) > 1}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()} - {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert profane and not profane & kept and len(clean & kept) >= 0.99 * len(clean & {r.doc_id for r in rows})


def test_language(stages):
    docs, got = stages["language"]
    assert got.count() >= 0.97 * docs.where("n_chars > 30").count()


def test_line_dedup(stages):
    docs, got = stages["line_dedup"]
    want = {i: t for i, t, *_ in lines([(r.doc_id, r.text) for r in docs.collect()])}
    rows = got.collect()
    assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def test_near_duplicates(stages):
    docs, got = stages["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in near(rows, 0.6):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {r.doc_id for r in got.collect()} == {i for i in root if find(i) == i}


def test_packing(stages):
    docs, got = stages["packing"]
    words = {r.doc_id: len(bpe.Codec.get(f"{TOKENIZERS}/byte_bpe_50k.tiktoken").encoder.encode_ordinary(r.text)) for r in docs.collect()}
    packed: dict = {}
    for r in got.collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.piece_length
    assert packed == {i: n for i, n in words.items() if n}


def test_run(spark, stages):
    a = C.run(spark, SF)
    assert sorted(map(str, a.collect())) == sorted(map(str, stages["packing"][1].collect()))


def test_odd_rows_go_through_every_stage(spark):
    from pyspark.sql import functions as F

    whole = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (None, None, None, None, None), (2, "word " * 50_000, "en", "s", 250_000), (2, "word " * 50_000, "en", "s", 250_000), (3, "?", "xx", "s", 1)], whole.schema)
    odd = odd.withColumn("size", F.lit(1)).withColumn("_text", F.lit(1))
    for docs in (odd, odd.limit(0)):
        for _, f in C.STAGES:
            docs = f(spark, docs, SF)
            docs.collect()


def test_stages_begin_with_collected_garbage(spark):
    """Else the heap that an earlier stage took stays beside the Python workers of the next one."""
    from loomquill.llm.support import rested

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    count = lambda: sum(b.getCollectionCount() for b in beans)
    before = count()
    rested(spark)
    assert count() >= before + 2
