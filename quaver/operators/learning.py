"""Learning to rank on feature rows: session folds, boosted trees, pairwise models, out-of-fold scores and seed averages (MLlib)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import TASK, top


def folds(rows: DataFrame, k: int, seed: str, group: str = "session_id") -> DataFrame:
    """rows with fold 0..k-1, one a group: groups in the order of a seeded SHA-256 are dealt out in turn, so folds differ by one group at most."""
    g = rows.select(group).distinct().withColumn("drawn", F.sha2(F.concat_ws(":", F.lit(seed), F.col(group).cast("string")), 256))
    # a global order without one task: rank within 256 ranges of the first two digits, plus the ranges before
    g = g.withColumn("range", F.substring("drawn", 1, 2))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = g.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    nth = F.row_number().over(Window.partitionBy("range").orderBy("drawn", group)) - 1
    dealt = g.withColumn("nth", nth).join(F.broadcast(sizes), "range").select(group, ((F.col("nth") + F.col("before")) % k).cast("int").alias("fold"))
    return rows.join(dealt, group)


def _vector(columns: list[str]):
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in columns)))


def fit_trees(rows: DataFrame, columns: list[str], rounds: int = 10, depth: int = 4, seed: int = 7):
    """Boosted trees with logistic loss on label."""
    from pyspark.ml.classification import GBTClassifier

    d = rows.select(_vector(columns).alias("features"), F.col("label").cast("double").alias("label"))
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=seed).fit(d)


def scored(model, rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with score, the model's margin."""
    from pyspark.ml.functions import vector_to_array

    d = rows.withColumn("features", _vector(columns))
    out = "rawPrediction"
    return model.transform(d).withColumn("score", vector_to_array(out)[1]).select(*rows.columns, "score")


def pairs(rows: DataFrame, columns: list[str], negatives: int, seed: str, keys: list[str] | None = None) -> DataFrame:
    """Differences of each positive and `negatives` drawn others of its task, both ways: a bounded number a positive, not all pairs."""
    keys = keys or TASK
    x = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in columns))
    drawn = F.sha2(F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in keys), F.col("item_id").cast("string")), 256)
    neg = top(rows.where("label = 0").withColumn("drawn", drawn), keys, [F.col("drawn"), F.col("item_id")], negatives, "draw").select(*keys, x.alias("xn"))
    j = rows.where("label = 1").select(*keys, x.alias("xp")).join(neg, keys)
    up = j.select(F.zip_with("xp", "xn", lambda a, b: a - b).alias("x"), F.lit(1.0).alias("label"))
    return up.unionAll(j.select(F.zip_with("xn", "xp", lambda a, b: a - b).alias("x"), F.lit(0.0).alias("label")))


def fit_pairwise(rows: DataFrame, columns: list[str], negatives: int = 10, seed: str = "p", keys: list[str] | None = None) -> list[float]:
    """Weights of a linear ranker: logistic regression without intercept on differences."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    d = pairs(rows, columns, negatives, seed, keys).select(array_to_vector("x").alias("features"), "label")
    return [float(w) for w in LogisticRegression(fitIntercept=False, regParam=1e-3, maxIter=50).fit(d).coefficients]


def linear_score(rows: DataFrame, columns: list[str], weights: list[float]) -> DataFrame:
    s = F.lit(0.0)
    for c, w in zip(columns, weights, strict=True):
        s = s + F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) * w
    return rows.withColumn("score", s)


def out_of_fold(rows: DataFrame, columns: list[str], k: int = 3, seed: str = "f", rounds: int = 5) -> DataFrame:
    """Every row scored by a model that has not seen its session."""
    d = folds(rows, k, seed)
    out = None
    for i in range(k):
        part = scored(fit_trees(d.where(F.col("fold") != i), columns, rounds), d.where(F.col("fold") == i), columns)
        out = part if out is None else out.unionAll(part)
    return out


def seed_average(rows: DataFrame, train: DataFrame, columns: list[str], seeds: list[int], rounds: int = 5) -> DataFrame:
    """rows with score, the mean margin of models by seed."""
    out = rows
    for s in seeds:
        out = scored(fit_trees(train, columns, rounds, seed=s), out, columns).withColumnRenamed("score", f"score_{s}")
    total = sum((F.col(f"score_{s}") for s in seeds), F.lit(0.0))
    return out.withColumn("score", total / len(seeds)).drop(*(f"score_{s}" for s in seeds))


def lambdas(rows: DataFrame, keys: list[str] | None = None, at: int = 20) -> DataFrame:
    """rows (keys, item_id, label, score, x) with y and w, the gradient and curvature of nDCG for pairs of a task's positives and
    others. A task is one group, as long as its list of candidates."""
    import numpy as np
    import pandas as pd

    keys = keys or TASK

    def of_task(d: pd.DataFrame) -> pd.DataFrame:
        s, label = d["score"].to_numpy(), d["label"].to_numpy() > 0
        rank = np.empty(len(d))
        rank[np.lexsort((d["item_id"].to_numpy(), -s))] = np.arange(1, len(d) + 1)
        gain = np.where(rank <= at, 1 / np.log2(rank + 1), 0)
        y, w = np.zeros(len(d)), np.full(len(d), 1e-6)
        best = (1 / np.log2(np.arange(2, 2 + min(label.sum(), at)))).sum()
        for p in np.flatnonzero(label):
            other = ~label
            rho = 1 / (1 + np.exp(np.clip(s[p] - s[other], -30, 30)))
            change = np.abs(gain[p] - gain[other]) / best
            y[p] += (rho * change).sum()
            y[other] -= rho * change
            w[p] += (rho * (1 - rho) * change).sum()
            w[other] += rho * (1 - rho) * change
        return d.assign(y=y, w=w)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    return rows.groupBy(*keys).applyInPandas(of_task, f"{kinds}, y double, w double")


def lambda_ensemble(train: DataFrame, other: DataFrame, columns: list[str], seeds: list[int], rounds: int = 5, depth: int = 4, rate: float = 0.3, least: int = 20) -> DataFrame:
    """other with score: the mean over seeds of boosted regression trees that follow the lambdas of nDCG. Each seed's trees see a
    hash's four fifths of the tasks. Missing features are a value of their own beside a flag, so they are not mistaken for small ones."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import DecisionTreeRegressor

    features = array_to_vector(F.array(*(c for n in columns for c in (F.coalesce(F.col(n).cast("double"), F.lit(0.0)), F.col(n).isNull().cast("double")))))
    out = other.withColumn("features", features).withColumn("score", F.lit(0.0))
    for seed in seeds:
        kept = train.where(F.pmod(F.xxhash64(F.lit(seed), *TASK), F.lit(5)) > 0)
        held = kept.select(*TASK, "item_id", F.col("label").cast("double").alias("label"), *columns).withColumn("score", F.lit(0.0))
        trees = []
        for _ in range(rounds):
            step = lambdas(held).withColumn("features", features).withColumn("target", F.col("y") / F.col("w")).persist()
            tree = DecisionTreeRegressor(featuresCol="features", labelCol="target", weightCol="w", maxDepth=depth, minInstancesPerNode=least, seed=seed, predictionCol="q_add").fit(step)
            trees.append(tree)
            held = tree.transform(step).withColumn("score", F.col("score") + rate * F.col("q_add")).select(*TASK, "item_id", "label", *columns, "score")
            step.unpersist()
        for tree in trees:
            out = tree.transform(out).withColumn("score", F.col("score") + F.col("q_add") * (rate / len(seeds))).drop("q_add")
    return out.drop("features")


def importances(model, columns: list[str]) -> list[tuple[str, float]]:
    """Features by gain, descending."""
    return sorted(zip(columns, (float(x) for x in model.featureImportances), strict=True), key=lambda x: (-x[1], x[0]))
