"""Fusion of ranked sources, quotas, exclusion, back-fill and sampling. Lists are keys, source, source_order, item_id, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import TASK, top

# Quotas of source groups in their order.
QUOTAS = {"lexical": 260, "exact": 80, "metadata_tags": 70, "segment": 40, "history": 40, "tail": 10}


def lists(sources: dict[str, DataFrame], caps: dict[str, int] | None = None, keys: list[str] | None = None) -> DataFrame:
    """One relation of several sources' lists, each cut to its cap; source_order is the order of the dict."""
    keys = keys or TASK
    out = None
    for i, (name, df) in enumerate(sources.items()):
        part = df.select(*keys, F.lit(name).alias("source"), F.lit(i).alias("source_order"), "item_id", "rank")
        if caps and name in caps:
            part = part.where(F.col("rank") <= caps[name])
        out = part if out is None else out.unionByName(part)
    return out


def rrf(ranked: DataFrame, k: int | None = None, keys: list[str] | None = None, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: score, then number of sources, best rank, first source, item_id. Rounded to 12 digits: ranks of a few hundred differ in the sixth.

    Dealt by task once, for the sums and the order alike."""
    keys = keys or TASK
    s = ranked.repartition(*keys).groupBy(*keys, "item_id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 12).alias("score"), F.count("*").alias("n_sources"), F.min("rank").alias("best_rank"), F.min("source_order").alias("first_source"))
    return top(s, keys, [F.desc("score"), F.desc("n_sources"), F.asc("best_rank"), F.asc("first_source"), F.asc("item_id")], k).select(*keys, "item_id", "rank", "score", "n_sources", "best_rank", "first_source")


def quota(ranked: DataFrame, groups: dict[str, list[str]], quotas: dict[str, int], k: int, keys: list[str] | None = None) -> DataFrame:
    """Groups in order each give up to their quota of items that no group before gave, out of their first 3 * quota by RRF; what is
    missing to k comes from the first 2k over all sources. One pass a group: each depends on what was taken before."""
    keys = keys or TASK
    taken = None
    for i, (name, sources) in enumerate(groups.items()):
        n = quotas[name]
        new = rrf(ranked.where(F.col("source").isin(sources)), 3 * n, keys).select(*keys, "item_id", F.col("rank").alias("at"))
        if taken is not None:
            new = new.join(taken.select(*keys, "item_id"), [*keys, "item_id"], "left_anti")
        new = top(new, keys, [F.col("at")], n).select(*keys, "item_id", F.struct(F.lit(i).alias("g"), F.col("rank").alias("r")).alias("place"))
        taken = new if taken is None else taken.unionAll(new)
    fill = rrf(ranked, 2 * k, keys).select(*keys, "item_id", F.struct(F.lit(len(groups)).alias("g"), F.col("rank").alias("r")).alias("place")).join(taken.select(*keys, "item_id"), [*keys, "item_id"], "left_anti")
    return top(taken.unionAll(fill), keys, [F.col("place")], k).select(*keys, "item_id", "rank")


def ordered_union(ranked: DataFrame, excluded: DataFrame | None = None, labels: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Sources in order, each item at its first place; excluded items go, unless they are the task's label."""
    keys = keys or TASK
    placed = ranked.groupBy(*keys, "item_id").agg(F.min(F.struct("source_order", "rank")).alias("place"))
    if excluded is not None:
        gone = excluded.select(*keys, "item_id").distinct()
        if labels is not None:
            gone = gone.join(labels.select(*keys, F.col("label").alias("item_id")), [*keys, "item_id"], "left_anti")
        placed = placed.join(gone, [*keys, "item_id"], "left_anti")
    return top(placed, keys, [F.col("place"), F.col("item_id")], None).select(*keys, "item_id", "rank")


def sample_negatives(candidates: DataFrame, most: int, head: int, seed: str, keys: list[str] | None = None) -> DataFrame:
    """candidates: keys, item_id, rank, label (0 or 1). Positives, the first `head` negatives and a random tail up to `most` rows
    a task; the tail's order is the SHA-256 of seed, task and item. Tasks of at most `most` rows stay whole."""
    keys = keys or TASK
    n = candidates.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("label").alias("positives"))
    c = candidates.join(n, keys)
    drawn = F.sha2(F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in keys), F.col("item_id").cast("string")), 256)
    c = c.withColumn("drawn", drawn)
    negatives = top(c.where("label = 0"), keys, [F.col("rank")], None, "nth")
    room = F.greatest(F.lit(0), F.least(F.lit(head), most - F.col("positives")))
    first = negatives.where((F.col("n") <= most) | (F.col("nth") <= room))
    tail = top(negatives.where((F.col("n") > most) & (F.col("nth") > room)), keys, [F.col("drawn"), F.col("item_id")], None, "draw")
    tail = tail.where(F.col("draw") <= most - F.col("positives") - room)
    columns = [*keys, "item_id", "rank", "label"]
    return c.where("label = 1").select(columns).unionAll(first.select(columns)).unionAll(tail.select(columns))


def require_positive(candidates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Candidates of tasks that have their label among them."""
    keys = keys or TASK
    return candidates.join(candidates.where("label = 1").select(*keys).distinct(), keys, "left_semi")


def force_positive(candidates: DataFrame, labels: DataFrame, catalog: DataFrame, most: int, keys: list[str] | None = None) -> DataFrame:
    """Lists of a task without any of its labels are cut to make room within `most` for those that the catalog has, which come last in
    order of id; other lists stay. candidates: keys, item_id, rank; labels: keys, item_id. Rows with label 0 or 1, and forced."""
    keys = keys or TASK
    marked = candidates.select(*keys, "item_id", "rank").join(labels.select(*keys, "item_id", F.lit(1).alias("label")).distinct(), [*keys, "item_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    without = marked.groupBy(*keys).agg(F.max("label").alias("has")).where("has = 0").select(*keys)
    missing = labels.select(*keys, "item_id").distinct().join(without, keys).join(catalog.select("item_id"), "item_id", "left_semi")
    missing = top(missing, keys, [F.asc("item_id")], None, "nth")
    n = missing.groupBy(*keys).agg(F.count("*").alias("n"))
    kept = marked.join(n, keys, "left").where((F.coalesce("n", F.lit(0)) == 0) | (F.col("rank") <= most - F.col("n")))
    last = kept.groupBy(*keys).agg(F.max("rank").alias("last"))
    forced = missing.join(last, keys, "left").select(*keys, "item_id", (F.coalesce("last", F.lit(0)) + F.col("nth")).cast("int").alias("rank"), F.lit(1).alias("label"), F.lit(True).alias("forced"))
    return kept.select(*keys, "item_id", F.col("rank").cast("int").alias("rank"), "label", F.lit(False).alias("forced")).unionAll(forced)


def backfill(ranked: DataFrame, excluded: DataFrame, spare: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """Lists without excluded items, filled to k with spare's items in order that are neither excluded nor there."""
    keys = keys or TASK
    gone = excluded.select(*keys, "item_id").distinct()
    both = ranked.select(*keys, "item_id", F.struct(F.lit(0).alias("g"), F.col("rank").alias("r")).alias("place")).unionAll(spare.select(*keys, "item_id", F.struct(F.lit(1).alias("g"), F.col("rank").alias("r")).alias("place")))
    placed = both.join(gone, [*keys, "item_id"], "left_anti").groupBy(*keys, "item_id").agg(F.min("place").alias("place"))
    return top(placed, keys, [F.col("place"), F.col("item_id")], k).select(*keys, "item_id", "rank", (F.col("place.g") == 1).alias("filled"))


def protected(scored: DataFrame, primary: DataFrame, protect: int, k: int, keys: list[str] | None = None) -> DataFrame:
    """The first `protect` of the primary list stay where they are; then score, primary rank (missing: last), item_id."""
    keys = keys or TASK
    p = primary.select(*keys, "item_id", F.col("rank").alias("primary_rank"))
    j = scored.select(*keys, "item_id", "score").join(p, [*keys, "item_id"], "left").withColumn("primary_rank", F.coalesce("primary_rank", F.lit(9999)))
    kept = F.col("primary_rank") <= protect
    order: list[Column] = [F.when(kept, F.col("primary_rank")).otherwise(protect + 1), F.desc("score"), F.asc("primary_rank"), F.asc("item_id")]
    return top(j, keys, order, k).select(*keys, "item_id", "rank", "primary_rank")
