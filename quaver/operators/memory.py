"""Views of a task for query memories: its query, the user's last texts, the last items' metadata and the profile, by variant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .ranking import TASK

# The views beside the query that each variant has, and the weights of views.
MEMORY = {"current": (), "recent": ("recent",), "profile": ("profile",), "recent_profile": ("recent", "profile"), "history_music": ("recent", "music", "profile")}
VIEW_WEIGHTS = {"query": 1.0, "recent": 0.55, "music": 0.35, "profile": 0.45}


def item_text(items: DataFrame) -> DataFrame:
    """item_id, text: name, artist, album and tags in one line."""
    return items.select("item_id", F.concat_ws(" ", "name", "artist", "album", F.array_join("tags", " ")).alias("text"))


def recent_item_text(history: DataFrame, items: DataFrame, last: int = 2, keys: list[str] | None = None) -> DataFrame:
    """Per task: lines of the metadata of its last items, oldest first; items that the catalog has not are left out."""
    keys = keys or TASK
    lines = history.where(F.col("recency") <= last).join(item_text(items), "item_id")
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("recency")).alias("at"), "text"))), lambda x: x.text), "\n").alias("music"))


def recent_queries(tasks: DataFrame, last: int = 2) -> DataFrame:
    """Per task of a session with one before it: the queries of its last tasks, oldest first, in lines."""
    before = tasks.select("session_id", F.col("turn_number").alias("at"), F.col("query").alias("line"))
    j = tasks.select(*TASK).join(before, "session_id").where((F.col("at") < F.col("turn_number")) & (F.col("at") >= F.col("turn_number") - last))
    return j.groupBy(*TASK).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x.line), "\n").alias("recent"))


def profile_words(profiles: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, profile: a user's attributes in one line; unknown ones are empty."""
    return profiles.select(key, F.concat_ws(" ", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)).alias("profile"))


def views(tasks: DataFrame, history: DataFrame, items: DataFrame, profiles: DataFrame, fields: list[str]) -> DataFrame:
    """tasks (session_id, turn_number, user_id, query) with recent, music and profile; empty where there is none."""
    j = tasks.join(recent_queries(tasks), TASK, "left").join(recent_item_text(history, items), TASK, "left").join(profile_words(profiles, "user_id", fields), "user_id", "left")
    return j.select(*tasks.columns, *(F.coalesce(c, F.lit("")).alias(c) for c in ("recent", "music", "profile")))


def document(variant: str):
    """The text of a task that a search index holds: the variant's views in lines, without empty ones."""
    return F.concat_ws("\n", *(F.nullif(F.col(c), F.lit("")) for c in ("query", *MEMORY[variant])))


def merged_ngrams(seen: DataFrame, variant: str, keys: list[str] | None = None) -> DataFrame:
    """keys, ngram, weight: n-grams of the variant's views by their weights; of an n-gram in several views the largest counts."""
    keys = keys or TASK
    every = F.concat(*(X.weighted_ngrams(F.col(c), VIEW_WEIGHTS[c]) for c in ("query", *MEMORY[variant])))
    return seen.select(*keys, F.inline(every)).groupBy(*keys, "ngram").agg(F.max("weight").alias("weight"))
