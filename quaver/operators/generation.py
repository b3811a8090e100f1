"""Response generation: prompt inputs as DataFrames, a plug point for any generator, and templates where there is none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def grounding(items: DataFrame) -> DataFrame:
    """item_id, grounding: what a response may say about an item; null and empty fields are left out."""
    part = lambda label, c: F.when(F.length(F.trim(F.coalesce(c, F.lit("")))) > 0, F.concat(F.lit(f"{label}: "), F.trim(c)))
    tags = F.array_join(X.clean_tags(F.col("tags")), ", ")
    return items.select("item_id", F.concat_ws("; ", part("title", F.col("name")), part("artist", F.col("artist")), part("album", F.col("album")), part("tags", tags)).alias("grounding"))


def profile_text(profiles: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, profile: 'field: value' parts of what is known about a user."""
    return profiles.select(key, F.concat_ws(", ", *(F.when(F.length(F.trim(F.coalesce(F.col(f).cast("string"), F.lit("")))) > 0, F.concat(F.lit(f"{f}: "), F.trim(F.col(f).cast("string")))) for f in fields)).alias("profile"))


def prompts(tasks: DataFrame, firsts: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, query, item_id, style, grounding of each task's first item. style is one of eight by the key."""
    style = X.style_bucket(F.concat_ws(":", *(F.col(k).cast("string") for k in keys)))
    return tasks.join(firsts.where("rank = 1").select(*keys, "item_id"), keys).join(grounding(items), "item_id", "left").select(*keys, "query", "item_id", style.alias("style"), F.coalesce("grounding", F.lit("")).alias("grounding"))


def generate(prompts: DataFrame, generator: Callable, items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, response. generator maps a list of prompt texts to texts, a batch at a time; what it leaves empty gets the template."""

    def run(batches):
        for b in batches:
            b["response"] = generator((b["grounding"] + "\n" + b["query"]).tolist())
            yield b[[*keys, "item_id", "response"]]

    kinds = ", ".join(f"{k} {prompts.schema[k].dataType.simpleString()}" for k in [*keys, "item_id"])
    made = prompts.mapInPandas(run, f"{kinds}, response string").join(items.select("item_id", "name", "artist"), "item_id", "left")
    clean = F.nullif(X.postclean(F.coalesce("response", F.lit(""))), F.lit(""))
    return made.select(*keys, F.coalesce(clean, X.fallback_response(F.col("name"), F.col("artist"))).alias("response"))


def compare_variants(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tasks, and whether both variants keep every task's list of items."""
    j = a.select(*keys, F.col("items").alias("x")).join(b.select(*keys, F.col("items").alias("y")), keys, "full")
    return j.agg(F.count("*").alias("tasks"), F.bool_and(F.col("x").eqNullSafe(F.col("y"))).alias("ranking_preserved"))
