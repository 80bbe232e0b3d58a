"""Ranking and its evaluation, without gathering scores on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathrank.operators.ranges import cumulated, numbered


def rank_nodes(scores: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k nodes of the highest scores; ties by id."""
    return scores.orderBy(F.desc(score), key).limit(k)


def _by_score(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives of each distinct score (p, n), of it and all scores above it (tp, fp), and of all; of each group ``by``."""
    grouped = df.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(label) > 0).alias("p"), F.count_if(F.col(label) <= 0).alias("n"))
    return cumulated(grouped, [F.desc("s")], ["p", "n"], by).select(*by, "s", "p", "n", (F.col("before_p") + F.col("p")).alias("tp"), (F.col("before_n") + F.col("n")).alias("fp"), "all_p", "all_n")


def _roc() -> Column:
    below = F.col("all_n") - F.col("fp") + F.col("n") / 2.0
    return F.try_divide(F.sum(F.col("p") * below), (F.max("all_p") * F.max("all_n")).cast("double")).alias("roc_auc")


def _pr() -> Column:
    precision = F.col("tp") / (F.col("tp") + F.col("fp")).cast("double")
    ahead = F.col("tp") + F.col("fp") - F.col("p") - F.col("n")
    last = F.when(ahead == 0, 1.0).otherwise((F.col("tp") - F.col("p")) / F.when(ahead == 0, 1).otherwise(ahead).cast("double"))
    return F.try_divide(F.sum(F.col("p") * (precision + last) / 2.0), F.max("all_p").cast("double")).alias("pr_auc")


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """The chance that a positive scores above a negative, ties half; null without either."""
    return _by_score(df, score, label).agg(_roc())


def pr_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the precision-recall curve by trapezoids, from recall 0 and precision 1."""
    return _by_score(df, score, label).agg(_pr())


def split_aucs(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """(by, n_rows, n_positive, roc_auc, pr_auc) of all splits at once: scores are counted, ranged and summed up together."""
    g = _by_score(df, score, label, by)
    return g.groupBy(*by).agg((F.max("all_p") + F.max("all_n")).alias("n_rows"), F.max("all_p").alias("n_positive"), _roc(), _pr())


def hit_rates(df: DataFrame, score: str, label: str, key: str, ks: Sequence[int] = (), percents: Sequence[float] = (), by: Sequence[str] = ()) -> DataFrame:
    """(by, cut, k, hits, rate): positives among the first k, divided by k, for numbers and for top percentages; of each group ``by``."""
    ranked = numbered(df.select(*by, key, score, label), [F.desc(score), F.asc(key)], "rank", by)
    cuts = [(f"top_{k}", F.lit(k).cast("long")) for k in ks] + [(f"top_{p}%", F.floor(F.col("n_all") * p / 100.0).cast("long")) for p in percents]
    counted = F.array(*[F.struct(F.lit(name).alias("cut"), F.max(k).alias("k"), F.count_if((F.col("rank") < k) & (F.col(label) > 0)).alias("hits")) for name, k in cuts]).alias("found")
    found = ranked.groupBy(*by).agg(counted) if by else ranked.agg(counted)
    return found.select(*by, F.inline("found")).withColumn("k", F.coalesce("k", F.lit(0))).withColumn("rate", F.try_divide(F.col("hits").cast("double"), F.col("k")))


def regression_errors(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    d = F.col(predicted) - F.col(actual)
    return df.agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"))


def accuracy(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    return df.agg(F.avg(F.when(F.col(predicted) == F.col(actual), 1.0).otherwise(0.0)).alias("accuracy"))


def score_nodes(train: DataFrame, rows: DataFrame, features: Sequence[str], label: str, key: str, max_iter: int = 20) -> DataFrame:
    """(key, score): the positive class's probability by a logistic regression that Spark fits on ``train``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_features", withMean=True), LogisticRegression(featuresCol="_features", labelCol=label, maxIter=max_iter)]
    model = Pipeline(stages=stages).fit(train.fillna(0, subset=list(features)).withColumn(label, F.col(label).cast("double")))
    return model.transform(rows.fillna(0, subset=list(features))).select(key, vector_to_array("probability")[1].alias("score"))
