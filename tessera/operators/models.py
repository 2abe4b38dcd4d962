"""Out-of-fold models over pair or entity features, calibration, bagging and scoring hooks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.context import hash_order


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """df with a vector of the features; a missing one is -1 with a flag beside it, since the trees don't route missing values."""
    filled = {f"__v{i}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(-1.0)) for i, c in enumerate(features)}
    flags = {f"__m{i}": (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double") for i, c in enumerate(features)}
    out = df.withColumns(filled | flags)
    return VectorAssembler(inputCols=[*filled, *flags], outputCol="__x").transform(out).drop(*filled, *flags)


@dataclass
class FoldModels:
    """One model per fold, each trained without the rows of its fold."""

    features: list[str]
    models: list

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """Scores by the model that didn't see the row's fold; rows of fold -1 get the mean of all models."""
        x = assembled(df, self.features)
        for i, m in enumerate(self.models):
            m = m.copy({m.predictionCol: f"__c{i}", m.probabilityCol: f"__p{i}", m.rawPredictionCol: f"__r{i}"})
            x = m.transform(x).withColumn(f"__p{i}", vector_to_array(F.col(f"__p{i}"))[1]).drop(f"__c{i}", f"__r{i}")
        ps = [F.col(f"__p{i}") for i in range(len(self.models))]
        own = reduce(lambda a, b: a.when(F.col("fold") == b[0], b[1]), enumerate(ps[1:], 1), F.when(F.col("fold") == 0, ps[0]))
        return x.withColumn(out, own.otherwise(sum(ps[1:], ps[0]) / len(ps))).drop("__x", *[f"__p{i}" for i in range(len(ps))])

    def importance(self) -> dict[str, float]:
        """Summed over folds; a feature and the flag that it is missing count together."""
        n, total = len(self.features), dict.fromkeys(self.features, 0.0)
        for m in self.models:
            for i, v in enumerate(m.featureImportances.toArray()):
                total[self.features[i % n]] += float(v)
        return total


def fit_folds(df: DataFrame, features: list[str], *, label: str = "label", entity: str = "s1_uid", n_folds: int = 4, trees: int = 20, depth: int = 5, max_entities: int | None = None, seed: int = 1) -> FoldModels:
    """Model k learns from entities of the other folds; 5 % of those entities are held out to stop early.

    df has fold.  ``max_entities``: a hash sample of entities to learn from.
    """
    if max_entities is not None:
        n = df.select(entity).distinct().count()
        if n > max_entities:
            df = df.where(hash_order(entity, seed=seed) < int(max_entities / n * (1 << 32)))
    x = assembled(df, features).select(entity, "fold", F.col(label).cast("double").alias("label"), "__x").withColumn("stop", hash_order(entity, seed=seed + 1) % 20 == 0).cache()
    gbt = GBTClassifier(featuresCol="__x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed)
    stopping = gbt.copy({gbt.validationIndicatorCol: "stop", gbt.validationTol: 0.001})
    try:
        # a fold of few entities may have none to stop on
        held = {r["fold"]: r["n"] for r in x.groupBy("fold").agg(F.count_if("stop").alias("n")).collect()}  # one row a fold
        some = [sum(n for f, n in held.items() if f != k) > 0 for k in range(n_folds)]
        return FoldModels(features, [(stopping if some[k] else gbt).fit(x.where(F.col("fold") != k)) for k in range(n_folds)])
    finally:
        x.unpersist()


@dataclass
class Calibrator:
    """A monotone map of scores to probabilities for each profile; a profile with few rows uses ``fallback``'s."""

    models: dict[str, IsotonicRegressionModel]
    fallback: str

    def apply(self, df: DataFrame, score: str, out: str = "q", prof: str = "prof") -> DataFrame:
        kept = None
        known = list(self.models)
        use = F.when(F.col(prof).isin(known), F.col(prof)).otherwise(F.lit(self.fallback))
        for name, m in self.models.items():
            bounds, values = list(map(float, m.boundaries)), list(map(float, m.predictions))
            kept = interpolated(F.col(score), bounds, values) if kept is None else F.when(use == name, interpolated(F.col(score), bounds, values)).otherwise(kept)
        return df.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), kept)))


def interpolated(x: Column, bounds: list[float], values: list[float]) -> Column:
    """The piecewise linear function through (bounds, values), constant outside: a look-up in two short arrays."""
    b, v = F.array(*map(F.lit, bounds)), F.array(*map(F.lit, values))
    n = F.size(F.filter(b, lambda y: y <= x))
    lo, hi = F.greatest(n, F.lit(1)), F.least(n + 1, F.lit(len(bounds)))
    x0, x1, y0, y1 = F.element_at(b, lo), F.element_at(b, hi), F.element_at(v, lo), F.element_at(v, hi)
    return F.when((x1 > x0) & (x >= x0), y0 + (y1 - y0) * (x - x0) / (x1 - x0)).otherwise(y0)


def fit_calibrator(df: DataFrame, score: str, *, label: str = "label", prof: str = "prof", fallback: str | None = None, min_rows: int = 1000) -> Calibrator:
    counts = {r[prof]: r["n"] for r in df.groupBy(prof).agg(F.count("*").alias("n")).collect()}  # one row a profile
    fallback = fallback or max(counts, key=lambda k: (counts[k], k))
    iso = IsotonicRegression(featuresCol="__s", labelCol="label")
    fit = lambda rows: iso.fit(rows.select(F.col(score).cast("double").alias("__s"), F.col(label).cast("double").alias("label")))
    return Calibrator({k: fit(df.where(F.col(prof) == k)) for k, n in counts.items() if n >= min_rows or k == fallback}, fallback)


def bag_mean(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Mean of the columns that aren't null or NaN; null if none is left."""
    xs = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs[1:]), F.coalesce(xs[0], F.lit(0.0)))
    n = sum((x.isNotNull().cast("int") for x in xs[1:]), xs[0].isNotNull().cast("int"))
    return df.withColumn(out, F.when(n > 0, total / n))


def auc(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """One row: area under the ROC curve, by ranks with ties in the middle, and average precision, from one pass over distinct scores.

    Scores are first counted, so the running sums range over distinct scores in range partitions' totals, not rows in one task.
    """
    g = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).groupBy(F.round(F.col(score).cast("double"), 6).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    down = Window.orderBy(F.desc("s"))  # a million distinct values at most
    c = g.withColumns({"tp": F.sum("p").over(down), "all": F.sum("n").over(down)}).withColumn("neg", F.col("n") - F.col("p"))
    c = c.withColumn("tp_before", F.col("tp") - F.col("p"))
    return c.agg(
        (F.sum(F.col("neg") * (F.col("tp_before") + F.col("p") / 2)) / (F.sum("p") * F.sum("neg"))).alias("auc"),
        (F.sum(F.col("p") * F.col("tp") / F.col("all")) / F.sum("p")).alias("average_precision"),
    )


def built_in_auc(df: DataFrame, score: str, label: str = "label") -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label).evaluate(df.select(F.col(score).cast("double"), F.col(label).cast("double")))


#: A scorer maps frames of pairs with their texts to scores: a lexical one here, a neural one where there is a runtime for it.
Scorer = Callable[[pd.DataFrame], pd.Series]


def score_pairs(pairs: DataFrame, scorer: Scorer, columns: list[str], out: str = "ce") -> DataFrame:
    """pairs with a scorer's output over the named columns, batch by batch."""
    def run(f: pd.DataFrame) -> pd.Series:
        return scorer(f).astype("float64")

    return pairs.withColumn(out, F.pandas_udf(run, "double")(F.struct(*columns)))


def lexical_scorer(a: str, b: str) -> Scorer:
    from tessera.functions.similarity import token_set

    return lambda f: pd.Series([token_set(x or "", y or "") for x, y in zip(f[a], f[b])])


def merge_halves(first: DataFrame, second: DataFrame, score: str = "ce") -> DataFrame:
    """Scores of two cross-fitted halves: the only one, or the mean of both."""
    return first.unionByName(second).groupBy("s1_uid", "rec_uid").agg(F.avg(score).alias(score))

