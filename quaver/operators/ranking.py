"""Top-k lists in long form: key columns, item_id, rank, score. Ties never depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUDGE = 1e-9
#: The key of a task.
TASK = ["session_id", "turn_number"]
#: Partitions of a catalog's values: they compress so well that by size they would be a few, each sorted as one.
SPREAD = 128


def top(df: DataFrame, keys: list[str], order: list[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """The first k rows of each key by order, with their rank from 1. Spark limits a window's groups before it shuffles them."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(rank) <= k)


def scored_top(scored: DataFrame, k: int | None, keys: list[str] | None = None, popularity: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """Top k by score, rounded first so that float sums in another order can't flip a tie; then popularity, then item_id.

    Sums of simple weights may end in exactly a half at the last digit; the nudge before rounding makes all of these go up."""
    keys = keys or TASK
    s = scored.withColumn("score", F.round(F.col("score") + NUDGE, digits))
    if popularity is not None:
        s = s.join(popularity, "item_id", "left").withColumn("popularity", F.coalesce("popularity", F.lit(0.0)))
        return top(s, keys, [F.desc("score"), F.desc("popularity"), F.asc("item_id")], k).select(*keys, "item_id", "rank", "score")
    return top(s, keys, [F.desc("score"), F.asc("item_id")], k).select(*keys, "item_id", "rank", "score")


def range_bounds(df: DataFrame, column: str, parts: int = 64, sample: int = 4096) -> list:
    """Values that cut a column into about equal ranges: of a bounded sample in the order of a hash. Any bounds give right results, good
    ones even tasks."""
    drawn = sorted(r[0] for r in df.select(F.col(column).alias("v")).where("v is not null").distinct().orderBy(F.xxhash64("v")).limit(sample).collect())
    return [drawn[i * len(drawn) // parts] for i in range(1, parts)] if len(drawn) > parts else drawn[1:]


def numbered(df: DataFrame, order: list[str], name: str, weight: str | None = None) -> DataFrame:
    """df with its row number from 0 in an order (or, with weight, the sum of it over the rows before) without a global window: numbers
    within ranges of the first column, and the totals of the ranges before."""
    bounds = range_bounds(df, order[0])
    at = F.lit(0)
    for b in bounds:
        at = at + F.when(F.col(order[0]) >= F.lit(b), 1).otherwise(0)
    d = df.withColumn("q_range", at)
    one = F.col(weight) if weight else F.lit(1)
    sizes = d.groupBy("q_range").agg(F.sum(one).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("q_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("q_range", before.alias("q_before"))  # a row a range
    inside = F.coalesce(F.sum(one).over(Window.partitionBy("q_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("q_inside", inside).join(F.broadcast(offsets), "q_range").withColumn(name, F.col("q_inside") + F.col("q_before")).drop("q_range", "q_inside", "q_before")


def exactly(ranked: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """ranked as it is; an error if a list has not k items."""
    keys = keys or TASK
    n = ranked.groupBy(*keys).agg(F.count("*").alias("q_n"))
    bad = F.raise_error(F.concat(F.lit("a list has not "), F.lit(str(k)), F.lit(" items: "), F.concat_ws(":", *(F.col(c).cast("string") for c in keys))))
    told = n.select(*keys, F.when(F.col("q_n") == k, True).otherwise(bad.cast("boolean")).alias("q_ok"))
    return ranked.join(told, keys).where("q_ok").select(*ranked.columns)


def first_places(df: DataFrame, keys: list[str], place: str = "place") -> DataFrame:
    """Each item once, at its first place: duplicates go without relying on row order."""
    return df.groupBy(*keys, "item_id").agg(F.min(place).alias(place))


def popular(items: DataFrame, k: int) -> DataFrame:
    """item_id, pop_rank of the k most popular items: a limit in every partition, then one of the k's."""
    best = items.select("item_id", "popularity").orderBy(F.desc("popularity"), "item_id").limit(k)
    return best.select("item_id", F.row_number().over(Window.orderBy(F.desc("popularity"), "item_id")).alias("pop_rank"))


def padded(ranked: DataFrame, tasks: DataFrame, pop: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """Lists of exactly k: what is missing comes from pop (item_id, pop_rank; at least k rows beyond any list), flagged is_pad.

    pop has at most a few k rows, a bound the caller chose: it is one array, and each list takes from it what it lacks, no more."""
    keys = keys or TASK
    kept = top(ranked.select(*keys, "item_id", "rank"), keys, [F.col("rank"), F.col("item_id")], k, "place")
    held = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "item_id"))).alias("held"))
    spare = pop.agg(F.array_sort(F.collect_list(F.struct("pop_rank", "item_id"))).alias("spare"))
    j = tasks.select(*keys).distinct().join(held, keys, "left").crossJoin(F.broadcast(spare))
    own = F.transform(F.coalesce("held", F.array().cast(held.schema["held"].dataType)), lambda x: x.item_id)
    j = j.withColumn("own", own)
    more = F.slice(F.filter(F.transform("spare", lambda x: x.item_id), lambda x: ~F.array_contains("own", x)), 1, F.greatest(F.lit(k) - F.size("own"), F.lit(0)))
    flag = lambda a, pad: F.transform(a, lambda x: F.struct(x.alias("item_id"), F.lit(pad).alias("is_pad")))
    out = j.select(*keys, F.posexplode(F.concat(flag(F.col("own"), False), flag(more, True))).alias("at", "x"))
    return out.select(*keys, "x.item_id", (F.col("at") + 1).cast("int").alias("rank"), "x.is_pad")
