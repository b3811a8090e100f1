"""Capped lists unfolded for a task where the task is: what is unfolded is summed and cut in place and never shuffled.

Each task's row carries what it holds, pairs of a list and a weight, and the items that are gone. Lists are counted first; they go
to executors once. Where they number more rows than MOST, there are none and the callers join instead, with the same results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import NUDGE

#: Rows of lists that executors hold, and unfolded rows that a task has in memory at once.
MOST, ROWS = 1_000_000, 1 << 20


def list_key(field: Column | str, value: Column | str) -> Column:
    return F.xxhash64(F.col(field) if isinstance(field, str) else field, F.col(value) if isinstance(value, str) else value)


class Lists:
    """Lists of items in flat arrays. Items are numbered by popularity, then id, so that numbers settle ties; lists by value."""

    def __init__(self, table):
        f = table.to_pandas()
        ids = f[["item_id", "popularity"]].drop_duplicates("item_id").sort_values(["popularity", "item_id"], ascending=[False, True])
        self.ids = ids["item_id"].reset_index(drop=True)
        f = f.sort_values(["field", "value", "place"]).reset_index(drop=True)
        self.item = self.number(f["item_id"])
        self.weight = f["weight"].to_numpy("float64")
        first = np.flatnonzero(~f.duplicated(["field", "value"]).to_numpy())
        self.start, self.size = first, np.diff(np.append(first, len(f)))
        keys = f["list"].to_numpy("int64")[first]
        self.at = np.argsort(keys)
        self.keys = keys[self.at]

    def number(self, items) -> np.ndarray:
        import pandas as pd

        return pd.Index(self.ids).get_indexer(items).astype("int64")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The lists' numbers; -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, self.at[i], -1)


def held_lists(lists: DataFrame, popularity: DataFrame | None = None):
    """A broadcast of lists(field, value, item_id, place, weight); None if they have more than MOST rows."""
    named = lists.select("field", "value", "item_id", "place", F.col("weight").cast("double").alias("weight"), list_key("field", "value").alias("list"))
    rows = named.limit(MOST + 1).persist()
    try:
        if rows.count() > MOST:
            return None
        if popularity is None:
            every = rows.withColumn("popularity", F.lit(0.0))
        else:
            few = popularity.join(F.broadcast(rows.select("item_id").distinct()), "item_id", "left_semi")
            every = rows.join(few.groupBy("item_id").agg(F.max("popularity").alias("popularity")), "item_id", "left").withColumn("popularity", F.coalesce("popularity", F.lit(0.0)))
        table = every.toArrow()
    finally:
        rows.unpersist()
    out = Lists(table)
    if len(np.unique(out.keys)) < len(out.keys):  # two lists of one key: as good as never
        return None
    return lists.sparkSession.sparkContext.broadcast(out)


def gathered(history: DataFrame, values: DataFrame, fields: list[int], keys: list[str], weight: Column, gone: bool = True) -> DataFrame:
    """keys, held (list, w of each value of each item) and gone (the items, or none)."""
    v = values.where(F.col("field").isin(fields)).select("item_id", "field", list_key("field", "value").alias("list"))
    h = history.join(v, "item_id").select(*keys, "item_id", "list", weight.cast("double").alias("w")).repartition(*keys)
    return h.groupBy(*keys).agg(F.collect_list(F.struct("list", "w")).alias("held"), F.collect_list(F.when(F.lit(gone), F.col("item_id"))).alias("gone"))


def _expanded(lists: Lists, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists by number: the row each unfolded entry comes from, and its place in the lists' arrays."""
    size = lists.size[of]
    row = np.repeat(np.arange(len(of)), size)
    ends = np.cumsum(size)
    return row, np.arange(len(row)) - np.repeat(ends - size, size) + np.repeat(lists.start[of], size)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, "int64")


def _by_sum(lists: Lists, task: np.ndarray, of: np.ndarray, w: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """task, item, score of all unfolded items but the gone ones, in order of task, score and item."""
    n = max(len(lists.ids), 1)
    row, at = _expanded(lists, of)
    key, s = task[row] * n + lists.item[at], w[row] * lists.weight[at]
    order = np.argsort(key, kind="stable")
    key, s = key[order], s[order]
    first = _runs(key)
    key, s = key[first], np.add.reduceat(s, first) if len(first) else s
    if len(gone):
        kept = ~np.isin(key, gone, assume_unique=False)
        key, s = key[kept], s[kept]
    micro = np.rint((s + NUDGE) * 1e6)
    order = np.lexsort((key, -micro, key // n))
    return key[order] // n, key[order] % n, micro[order] / 1e6


def _by_place(lists: Lists, task: np.ndarray, of: np.ndarray, w: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """task, item, score (none) in order of task and first place: the largest weight, then the list, then the place in it."""
    n = max(len(lists.ids), 1)
    order = np.lexsort((of, -w, task))
    row, at = _expanded(lists, of[order])
    key = task[order][row] * n + lists.item[at]
    by_key = np.argsort(key, kind="stable")
    first = np.sort(by_key[_runs(key[by_key])])
    key = key[first]
    return key // n, key % n, np.zeros(len(key))


def unfolded(held: DataFrame, lists, keys: list[str], k: int, by: str = "sum") -> DataFrame:
    """The first k items of each row of gathered(): by the sum of weights times the lists' weights, or by first place."""
    import pyarrow as pa

    names = ", ".join(f"{c} {held.schema[c].dataType.simpleString()}" for c in keys)
    kind = held.schema["gone"].dataType.elementType.simpleString()
    order, most = {"sum": _by_sum, "place": _by_place}[by], ROWS

    def rows(x: Lists, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h, g = b.column("held"), b.column("gone")
        flat = h.flatten()
        task = np.repeat(np.arange(len(h)), h.value_lengths().to_numpy(zero_copy_only=False))
        of, w = x.find(flat.field("list").to_numpy(zero_copy_only=False)), flat.field("w").to_numpy(zero_copy_only=False)
        use = (of >= 0) & ((w > 0) | (by == "place"))
        task, of, w = task[use], of[use], w[use]
        # a list that a task holds more than once is unfolded once
        one = task * max(len(x.size), 1) + of
        by_one = np.argsort(one, kind="stable")
        first = _runs(one[by_one])
        if len(first):
            w = (np.add if by == "sum" else np.maximum).reduceat(w[by_one], first)
            task, of = task[by_one][first], of[by_one][first]
        gone_of = np.repeat(np.arange(len(g)), g.value_lengths().to_numpy(zero_copy_only=False))
        gone = x.number(g.flatten().to_pandas())
        gone_of, gone = gone_of[gone >= 0], gone[gone >= 0]
        ends = np.cumsum(x.size[of])
        lo = 0
        while lo < len(of):
            begun = ends[lo] - x.size[of[lo]]
            hi = max(np.searchsorted(ends, begun + most, "right"), lo + 1)
            if hi < len(of):  # a task stays whole
                start = np.searchsorted(task, task[hi])
                hi = start if start > lo else np.searchsorted(task, task[lo], "right")
            a, z = task[lo], task[hi - 1]
            own = gone[np.searchsorted(gone_of, a) : np.searchsorted(gone_of, z, "right")], gone_of[np.searchsorted(gone_of, a) : np.searchsorted(gone_of, z, "right")]
            t, item, score = order(x, task[lo:hi], of[lo:hi], w[lo:hi], own[1] * max(len(x.ids), 1) + own[0])
            first = _runs(t)
            rank = np.arange(len(t)) - np.repeat(first, np.diff(np.append(first, len(t)))) + 1
            top = rank <= k
            t, item, score, rank = t[top], item[top], score[top], rank[top]
            columns = [b.column(c).take(pa.array(t)) for c in keys]
            columns += [pa.array(x.ids.to_numpy()[item], type=g.type.value_type), pa.array(rank.astype("int32")), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "item_id", "rank", "score"])
            lo = hi

    def run(batches):
        for b in batches:
            yield from rows(lists.value, b)

    return held.mapInArrow(run, f"{names}, item_id {kind}, rank int, score double")
