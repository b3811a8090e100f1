"""Ranking metrics, coverage, changes, composites and checks. Predictions are keys, item_id, rank; labels are keys, label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import TASK, numbered


def gain(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def hits(predictions: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Labels with the rank of their item, null if it is not predicted."""
    keys = keys or TASK
    p = predictions.select(*keys, F.col("item_id").alias("label"), "rank")
    return labels.select(*keys, "label").join(p, [*keys, "label"], "left")


def ndcg_multi(predictions: DataFrame, labels: DataFrame, k: int = 20, keys: list[str] | None = None) -> DataFrame:
    """One row: the mean over tasks with labels of DCG over the best DCG of min(labels, k)."""
    keys = keys or TASK
    per = hits(predictions, labels.distinct(), keys).groupBy(*keys).agg(F.sum(F.when(F.col("rank") <= k, gain(F.col("rank"))).otherwise(0.0)).alias("dcg"), F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return per.agg(F.count("*").alias("tasks"), F.round(F.avg(F.col("dcg") / ideal), 6).alias("ndcg"))


def ndcg_single(predictions: DataFrame, labels: DataFrame, k: int = 20, keys: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """The mean over all tasks, by columns of the key if asked for; a task without a hit counts 0."""
    h = hits(predictions, labels, keys)
    return h.groupBy(*(by or [])).agg(F.count("*").alias("tasks"), F.round(F.avg(F.when(F.col("rank") <= k, gain(F.col("rank"))).otherwise(0.0)), 6).alias("ndcg"))


def ndcg_zero_fill(predictions: DataFrame, labels: DataFrame, k: int = 20, keys: list[str] | None = None) -> DataFrame:
    """The mean over tasks whose label is in the pool, and that times their share."""
    h = hits(predictions, labels, keys)
    g = F.when(F.col("rank") <= k, gain(F.col("rank"))).otherwise(0.0)
    s = h.agg(F.count("*").alias("tasks"), F.count("rank").alias("positive"), F.sum(F.when(F.col("rank").isNotNull(), g)).alias("sum"))
    mean = F.try_divide("sum", "positive")
    return s.select("tasks", "positive", F.round(mean, 6).alias("positive_mean"), F.round(mean * F.col("positive") / F.col("tasks"), 6).alias("zero_fill"))


def hit_recall(predictions: DataFrame, labels: DataFrame, ks: list[int], depth: int, keys: list[str] | None = None) -> DataFrame:
    """k, hits, recall; null for k beyond the depth lists were cut to."""
    h = hits(predictions, labels, keys)
    one = h.agg(F.count("*").alias("n"), *(F.count(F.when(F.col("rank") <= k, 1)).alias(f"h{k}") for k in ks))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.when(F.lit(k <= depth), F.col(f"h{k}")).alias("hits")) for k in ks))).alias("r")
    return one.select("n", rows).select("r.k", "r.hits", F.round(F.col("r.hits") / F.col("n"), 6).alias("recall"))


def base_recovery(predictions: DataFrame, base: DataFrame, labels: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """Tasks by who hits within k: both, this source only, the base only or neither."""
    keys = keys or TASK
    a = hits(predictions, labels, keys).select(*keys, F.coalesce(F.col("rank") <= k, F.lit(False)).alias("source"))
    b = hits(base, labels, keys).select(*keys, F.coalesce(F.col("rank") <= k, F.lit(False)).alias("base"))
    kind = F.when(F.col("source") & F.col("base"), "both").when(F.col("source"), "source_only").when(F.col("base"), "base_only").otherwise("neither")
    return a.join(b, keys).groupBy(kind.alias("who")).agg(F.count("*").alias("tasks"))


def pool_report(pool: DataFrame, labels: DataFrame, ks: list[int], keys: list[str] | None = None) -> DataFrame:
    """One row: sizes of pools (mean, quantiles, greatest), and the share of labels within the first k and in all: the oracle's gain."""
    keys = keys or TASK
    n = pool.groupBy(*keys).agg(F.count("*").alias("n"))
    size = labels.select(*keys).distinct().join(n, keys, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    q = F.percentile("n", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    s = size.agg(F.round(F.avg("n"), 6).alias("mean_size"), q.alias("q"), F.max("n").alias("max_size"))
    h = hits(pool, labels, keys).agg(F.round(F.avg(F.col("rank").isNotNull().cast("int")), 6).alias("oracle"), *(F.round(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")), 6).alias(f"recall_{k}") for k in ks))
    return s.crossJoin(h).select("mean_size", *(F.col("q")[i].alias(f"p{p}") for i, p in enumerate((50, 95, 99))), "max_size", "oracle", *(f"recall_{k}" for k in ks))


def change_stats(before: DataFrame, after: DataFrame, k: int = 20, keys: list[str] | None = None) -> DataFrame:
    """One row: tasks, lists that differ, first places that differ, mean overlap of the first k."""
    keys = keys or TASK
    a, b = (d.where(F.col("rank") <= k).select(*keys, "item_id", F.col("rank").alias(r)) for d, r in ((before, "ra"), (after, "rb")))
    per = a.join(b, [*keys, "item_id"], "full").groupBy(*keys).agg(
        F.max((~F.col("ra").eqNullSafe(F.col("rb"))).cast("int")).alias("changed"),
        F.max(((F.coalesce("ra", F.lit(0)) == 1) != (F.coalesce("rb", F.lit(0)) == 1)).cast("int")).alias("first"),
        F.sum((F.col("ra").isNotNull() & F.col("rb").isNotNull()).cast("int")).alias("overlap"),
    )
    return per.agg(F.count("*").alias("tasks"), F.sum("changed").alias("changed"), F.sum("first").alias("first_changed"), F.round(F.avg("overlap"), 6).alias("mean_overlap"))


def catalog_diversity(predictions: DataFrame, catalog: DataFrame) -> DataFrame:
    n = catalog.agg(F.countDistinct("item_id").alias("catalog"))
    return predictions.agg(F.countDistinct("item_id").alias("seen")).crossJoin(n).select("seen", "catalog", F.round(F.col("seen") / F.col("catalog"), 6).alias("diversity"))


def composite(ndcg: Column, catalog: Column, lexical: Column, judge: Column) -> Column:
    return 0.5 * ndcg + 0.1 * catalog + 0.1 * lexical + 0.3 * (judge - 1) / 4


def decomposition(runs: DataFrame) -> DataFrame:
    """runs: run (order), ndcg, catalog, lexical, judge. Composite, its parts' differences to the first run, and what they are worth in nDCG. Seven digits: halves of six-digit measures end there."""
    c = runs.withColumn("composite", composite(*(F.col(x) for x in ("ndcg", "catalog", "lexical", "judge"))))
    base = c.agg(F.min_by(F.struct("ndcg", "catalog", "lexical", "judge", "composite"), "run").alias("b"))
    diff = lambda x, w: F.round((F.col(x) - F.col(f"b.{x}")) * w, 7).alias(f"d_{x}")
    return c.crossJoin(F.broadcast(base)).select("run", F.round("composite", 7).alias("composite"), diff("ndcg", 0.5), diff("catalog", 0.1), diff("lexical", 0.1), diff("judge", 0.075), F.round((F.col("composite") - F.col("b.composite")) / 0.5, 7).alias("ndcg_equivalent"))


def correlations(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """feature, n, pearson, spearman against target. Ranks are means over ties, from running counts of distinct values by ranges."""
    out = None
    for c in columns:
        d = df.select(F.col(c).cast("double").alias("x"), F.col(target).cast("double").alias("y")).where("x is not null and y is not null")
        ranked = d
        for v in ("x", "y"):
            n = d.groupBy(v).agg(F.count("*").alias("n"))
            ranked = ranked.join(numbered(n, [v], "before", "n").select(v, (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{v}")), v)
        row = ranked.agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.corr("rx", "ry"), 6).alias("spearman")).select(F.lit(c).alias("feature"), "n", "pearson", "spearman")
        out = row if out is None else out.unionAll(row)
    return out


def resubmissions(runs: DataFrame) -> DataFrame:
    """runs: artifact, digest, at, judge. The latest row an artifact; digests with two or more of them and two judges."""
    latest = runs.groupBy("artifact", "digest").agg(F.max_by("judge", "at").alias("judge"))
    g = latest.groupBy("digest").agg(F.count("*").alias("runs"), F.countDistinct("judge").alias("judges"), F.min("judge").alias("least"), F.max("judge").alias("most"))
    return g.where("runs >= 2 and judges >= 2")


def violations(predictions: DataFrame, catalog: DataFrame, tasks: DataFrame, k: int, response: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Tasks and what is wrong with their submission: missing, unknown task, wrong length, repeated or unknown items, gaps in ranks, empty response."""
    keys = keys or TASK
    told = lambda d, what: d.select(*keys, F.lit(what).alias("violation")).distinct()
    per = predictions.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("distinct"), F.max("rank").alias("last"), F.countDistinct("rank").alias("ranks"))
    out = told(tasks.join(per, keys, "left_anti"), "missing").unionAll(told(per.join(tasks, keys, "left_anti"), "unknown task"))
    out = out.unionAll(told(per.where(F.col("n") != k), "length")).unionAll(told(per.where(F.col("distinct") < F.col("n")), "repeated item")).unionAll(told(per.where((F.col("ranks") != F.col("n")) | (F.col("last") != F.col("n"))), "ranks"))
    out = out.unionAll(told(predictions.join(catalog.select("item_id"), "item_id", "left_anti"), "not in catalog"))
    if response:
        out = out.unionAll(told(predictions.where(F.coalesce(F.trim(response), F.lit("")) == ""), "empty response"))
    return out


def mixture(visible_sum: Column, hidden: Column, x: Column, total: Column) -> Column:
    """The overall mean if hidden rows score x."""
    return (visible_sum + hidden * x) / total


def required(visible_sum: Column, hidden: Column, target: Column, total: Column) -> Column:
    """What hidden rows must score for an overall mean of target."""
    return (target * total - visible_sum) / hidden
