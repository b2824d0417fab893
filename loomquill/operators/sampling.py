"""Reproducible samples, splits by speaker, class weights, classifier metrics and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquill import schema


def digest_order(seed: int, *cols: str) -> Column:
    """A key that looks random and depends on the seed and the row alone."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c) for c in cols]).cast("binary"))


def random_rows(df: DataFrame, limit: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    return df.orderBy(digest_order(seed, id_col), id_col).limit(limit)


def balanced_sample(df: DataFrame, per_group: int, seed: int = 42, group_col: str = "party", id_col: str = "id") -> DataFrame:
    """At most `per_group` rows of each group, by digest of their id; null groups go."""
    w = Window.partitionBy(group_col).orderBy(digest_order(seed, id_col), id_col)
    return df.where(F.col(group_col).isNotNull()).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= per_group).drop("_rank")


def newest_of_each(df: DataFrame, cap: int, group_col: str = "party", time_col: str = "created_at", id_col: str = "tweet_id") -> DataFrame:
    """The `cap` newest rows of each group: the quota of a capped feed."""
    w = Window.partitionBy(group_col).orderBy(F.desc(time_col), id_col)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= cap).drop("_rank")


def held_out_speakers(df: DataFrame, share: float = 0.15, seed: int = 42, speaker_col: str = "speaker") -> DataFrame:
    """(speaker): about `share` of the speakers, each by its own digest, so that new speakers move nobody else.

    Write the result and reuse it: a split is only comparable with itself.
    """
    who = df.select(F.coalesce(speaker_col, F.lit(schema.UNKNOWN_SPEAKER)).alias("speaker")).distinct()
    first = F.conv(F.substring(digest_order(seed, "speaker"), 1, 8), 16, 10).cast("double")
    return who.where(first / float(1 << 32) < share)


def speaker_split(df: DataFrame, held_out: DataFrame, speaker_col: str = "speaker") -> tuple[DataFrame, DataFrame]:
    """(training, test): no speaker is in both."""
    named = df.withColumn(speaker_col, F.coalesce(speaker_col, F.lit(schema.UNKNOWN_SPEAKER)))
    key = held_out.select(F.col("speaker").alias(speaker_col))
    return named.join(key, speaker_col, "left_anti"), named.join(key, speaker_col, "left_semi")


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, n, weight): 1 / n, for a sampler or a weighted loss."""
    return df.groupBy(label_col).agg(F.count("*").alias("n")).withColumn("weight", 1.0 / F.col("n"))


def with_class_weight(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.join(F.broadcast(class_weights(df, label_col).select(label_col, "weight")), label_col)


def confusion(df: DataFrame, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    return df.groupBy(label_col, pred_col).agg(F.count("*").alias("n"))


def metrics(df: DataFrame, classes: Sequence, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """One row: n, accuracy, and macro precision, recall and F1 over a fixed list of classes; a class without support counts 0."""
    table = confusion(df, label_col, pred_col)
    sums = []
    for i, c in enumerate(classes):
        hit, said, true = (F.col(label_col) == F.lit(c)) & (F.col(pred_col) == F.lit(c)), F.col(pred_col) == F.lit(c), F.col(label_col) == F.lit(c)
        sums += [F.sum(F.when(x, F.col("n")).otherwise(0)).alias(f"{k}{i}") for k, x in (("t", hit), ("p", said), ("l", true))]
    one = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.when(F.col(label_col) == F.col(pred_col), F.col("n")).otherwise(0)).alias("right"), *sums)
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    mean = lambda xs: sum(xs[1:], xs[0]) / len(xs)
    k = range(len(classes))
    precision, recall = [part(f"t{i}", f"p{i}") for i in k], [part(f"t{i}", f"l{i}") for i in k]
    f1 = [part(2 * F.col(f"t{i}"), F.col(f"p{i}") + F.col(f"l{i}")) for i in k]
    return one.select("n", part("right", "n").alias("accuracy"), mean(precision).alias("precision"), mean(recall).alias("recall"), mean(f1).alias("macro_f1"))


def argmax_label(probs: Column) -> Column:
    """The label of the largest probability of a map; of equal ones the first in the alphabet."""
    best = F.array_max(F.map_values(probs))
    return F.array_min(F.map_keys(F.map_filter(probs, lambda k, v: v == best)))


def ranked_probabilities(df: DataFrame, classes: Sequence[str], probs_col: str = "probs", id_col: str = "id") -> DataFrame:
    """(id, label, p, rank) of all classes; a missing one has 0."""
    each = df.select(id_col, F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.coalesce(F.try_element_at(F.col(probs_col), F.lit(c)), F.lit(0.0)).alias("p")) for c in classes])).alias("x"))
    return each.select(id_col, "x.label", "x.p").withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("p"), "label")))


def parse_party(answer: Column, codes: Sequence[str], names: Mapping[str, str]) -> Column:
    """A class from free text: the first of the codes, longest first, that it contains, else that of the first full name (name to class), else null."""
    up = F.upper(F.coalesce(answer, F.lit("")))
    picks = [F.when(F.contains(up, F.lit(c.upper())), c) for c in sorted(codes, key=lambda c: (-len(c), codes.index(c)))]
    picks += [F.when(F.contains(up, F.lit(n.upper())), c) for n, c in names.items()]
    return F.coalesce(*picks)


def profiles(df: DataFrame, reference: Sequence[float], group_col: str = "label", vector_col: str = "embedding", dims: int = 8) -> DataFrame:
    """(group, n, raw_i, dev_i): mean vectors, and their difference from a reference."""
    means = df.groupBy(group_col).agg(F.count("*").alias("n"), *[F.avg(F.col(vector_col)[i].cast("double")).alias(f"raw_{i}") for i in range(dims)])
    return means.select("*", *[(F.col(f"raw_{i}") - F.lit(float(reference[i]))).alias(f"dev_{i}") for i in range(dims)])


def reference_distribution(df: DataFrame, per_group: int, seed: int = 42, group_col: str = "label", id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 8) -> DataFrame:
    """One row of mean components over a balanced sample."""
    return balanced_sample(df, per_group, seed, group_col, id_col).agg(*[F.avg(F.col(vector_col)[i].cast("double")).alias(f"ref_{i}") for i in range(dims)])


def reference_of(table: DataFrame, dims: int = 8) -> DataFrame:
    """The reference a profile table was made with: mean of raw minus deviation."""
    return table.agg(*[F.avg(F.col(f"raw_{i}") - F.col(f"dev_{i}")).alias(f"ref_{i}") for i in range(dims)])


def cost_per_1000(calls: DataFrame, prices: DataFrame, model_col: str = "model") -> DataFrame:
    """(model, n, cost) from prompt and completion tokens and prices for each token; a model without a price has no cost."""
    sums = calls.groupBy(model_col).agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("pt"), F.sum("completion_tokens").alias("ct"))
    spent = F.col("pt") * F.col("prompt_price") + F.col("ct") * F.col("completion_price")
    return sums.join(prices, model_col, "left").select(model_col, "n", (spent / F.col("n") * 1000).alias("cost_per_1000"))


def open_plan(models: DataFrame, topics: DataFrame, kinds: DataFrame, samples: DataFrame, done: DataFrame) -> DataFrame:
    """Every (model, topic, kind, sample) that isn't done yet.

    The lists of a plan are broadcast: a product of their partitions would be a task for each combination.  What is done counts once, before it moves.
    """
    every = models.select("model").crossJoin(F.broadcast(topics.select("topic"))).crossJoin(F.broadcast(kinds.select("kind"))).crossJoin(F.broadcast(samples.select("sample")))
    key = ["model", "topic", "kind", "sample"]
    return every.join(done.select(*key).distinct(), key, "left_anti")


def benchmark_sample(df: DataFrame, held_out: DataFrame, per_group: int = 40, first_year: int = 2015, over_chars: int = 200, seed: int = 42, group_col: str = "party", id_col: str = "id") -> DataFrame:
    """Long enough recent speeches of held-out speakers, as many of each group."""
    _, test = speaker_split(df.where((F.col("year") >= first_year) & (F.length("text") > over_chars)), held_out)
    return balanced_sample(test, per_group, seed, group_col, id_col)


def precision_sample(rows: DataFrame, size: int, seed: int = 13, group_col: str = "party", id_col: str = "id") -> DataFrame:
    """Rows to be judged by hand: `size` divided by the number of groups from each group, at least one, in the order of their digests."""
    groups = max(1, rows.where(F.col(group_col).isNotNull()).select(group_col).distinct().count())
    return balanced_sample(rows, max(1, size // groups), seed, group_col, id_col)


def test_rows(df: DataFrame, frozen: DataFrame | None, held_out: DataFrame, per_group: int | None = None, seed: int = 42, group_col: str = "party", id_col: str = "id") -> DataFrame:
    """The rows of a frozen list of ids where there is one, else those of the held-out speakers; as many of each group where told."""
    rows = df.join(frozen.select(id_col).distinct(), id_col, "left_semi") if frozen is not None else speaker_split(df, held_out)[1]
    return rows if per_group is None else balanced_sample(rows, per_group, seed, group_col, id_col)


def as_vector(probs: Column, classes: Sequence[str]) -> Column:
    """A map of probabilities as an array in the order of the classes; a missing one has 0."""
    return F.array(*[F.coalesce(F.try_element_at(probs, F.lit(c)), F.lit(0.0)) for c in classes])


def argmax_accuracy(df: DataFrame, probs_col: str = "probs", label_col: str = "label") -> DataFrame:
    """(n, accuracy) of the most probable labels, to calibrate a scorer on a balanced sample."""
    return df.agg(F.count("*").alias("n"), F.avg((argmax_label(F.col(probs_col)) == F.col(label_col)).cast("double")).alias("accuracy"))
