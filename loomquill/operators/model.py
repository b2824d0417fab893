"""Text classification inside Spark: a trained linear model, or any scorer that is loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquill.functions import text


def _words(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("_words", F.coalesce(text.tokens(F.col(text_col), 2), F.array().cast("array<string>")))


def train(df: DataFrame, text_col: str = "text", label_col: str = "label", features: int = 1 << 16, rounds: int = 30) -> PipelineModel:
    """Weighted TF-IDF logistic regression; classes weigh the same whatever their size."""
    counts = df.groupBy(label_col).agg((1.0 / F.count("*")).alias("_weight"))
    rows = _words(df.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()), text_col).join(F.broadcast(counts), label_col)
    stages = [
        StringIndexer(inputCol=label_col, outputCol="_label", stringOrderType="alphabetAsc"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features", minDocFreq=2),
        LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=rounds, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(rows)


def predict(df: DataFrame, model: PipelineModel, text_col: str = "text") -> DataFrame:
    """`df` with probs (map of class to probability) and pred."""
    from pyspark.ml.functions import vector_to_array

    labels = model.stages[0].labels
    rows = _words(df, text_col)
    for stage in model.stages[1:]:
        rows = stage.transform(rows)
    p = vector_to_array("probability")
    probs = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), p)
    pred = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
    return rows.select(*df.columns, probs.alias("probs"), pred.alias("pred"))


def score_with(df: DataFrame, load: Callable[[], Callable[[list[str]], list[Sequence[float]]]], classes: Sequence[str], text_col: str = "text", id_col: str = "id", max_words: int = 512, batch: int = 64) -> DataFrame:
    """(id, probs) by a scorer of text batches; `load` runs once for each task.  Texts are cut to the model's window of words."""
    window = F.array_join(F.slice(F.split(F.coalesce(text_col, F.lit("")), r"\s+"), 1, max_words), " ")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for pdf in frames:
            texts = pdf["_text"].tolist()
            rows = [r for k in range(0, len(texts), batch) for r in score(texts[k : k + batch])]
            yield pd.DataFrame({"id": pdf["id"], "probs": [dict(zip(classes, map(float, r))) for r in rows]})

    return df.select(F.col(id_col).cast("string").alias("id"), window.alias("_text")).mapInPandas(run, "id string, probs map<string,double>")
