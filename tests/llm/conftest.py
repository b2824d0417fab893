import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) with extra columns whose names clash with inner ones."""

    def build(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.select("doc_id", "text", *[F.lit(7).alias(c) for c in ("h", "n", "k", "size", "token", "block", "uid", "doc", "a", "b", "_text", "_keep", "_lid", "lines", "_clean", "_gone")]) if extra else df

    return build
