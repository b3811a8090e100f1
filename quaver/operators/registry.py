"""Candidate sources by name: which of them a profile has, how many they fetch and keep, and for which intents they are asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Groups of sources, profiles, rows fetched and rows kept.
EXACT = ("exact_track_current", "exact_artist_current", "exact_album_current", "exact_tag_current")
METADATA = ("metadata_bm25_text_full_context", "metadata_bm25_tag_full_context", "metadata_bm25_text_current_user_turn", "metadata_bm25_tag_current_user_turn")
SEGMENT = ("popular_by_artist_current", "popular_by_tag_current", "popular_by_user_age_country", "popular_by_history_artist")
HISTORY = ("history_same_artist", "history_same_tag", "history_cf_mean", "history_audio_mean", "history_recent_neighbors")
TEXT = ("bm25_recent_turns", "bm25_full_context")
WHOLE = ("metadata_bm25_full_context", "metadata_bm25_current_user_turn")
PROFILES = {
    "shared": (*TEXT, *WHOLE, "exact_current_union", "dense_text_recent", "user_cf_bpr", "history_cf_bpr_item2item", "popularity_fallback"),
    "A": (*TEXT, *WHOLE, "exact_current_union"),
    "B": (*TEXT, *WHOLE, *EXACT),
    "C": (*TEXT, *METADATA, *EXACT),
    "D": (*TEXT, *METADATA, *EXACT, *SEGMENT),
    "E": (*TEXT, *METADATA, *EXACT, *SEGMENT, *HISTORY),
    "F": (*TEXT, *METADATA, *EXACT, *SEGMENT, *HISTORY),
    "G": (*TEXT, *METADATA, *EXACT, *SEGMENT, *HISTORY, "popularity_fallback"),
}
FETCH = {"popularity_fallback": 200, "user_cf_bpr": 2000, "metadata_bm25_full_context": 1500, "metadata_bm25_text_full_context": 1500, "metadata_bm25_tag_full_context": 1500} | dict.fromkeys([*TEXT, WHOLE[1], *METADATA[2:], *HISTORY[2:], "dense_text_recent", "history_cf_bpr_item2item"], 1000) | dict.fromkeys([*EXACT, *SEGMENT, *HISTORY[:2], "exact_current_union"], 500)
KEEP = {"metadata_bm25_full_context": 400, "metadata_bm25_text_full_context": 350, "metadata_bm25_current_user_turn": 200, "dense_text_recent": 200, "user_cf_bpr": 200, "exact_tag_current": 80, "metadata_bm25_tag_current_user_turn": 80} | dict.fromkeys(TEXT, 250) | dict.fromkeys(["exact_current_union", "exact_artist_current", "history_cf_bpr_item2item", *METADATA[1:3]], 150) | dict.fromkeys([EXACT[0], EXACT[2], *HISTORY], 100) | dict.fromkeys([*SEGMENT, "popularity_fallback"], 50)
# Profiles that ask by intent, and the intents for which a source is asked; others are always asked.
GATED = ("F", "G")
ASKED = dict.fromkeys(HISTORY, ("similarity_request", "ambiguous")) | dict.fromkeys(SEGMENT, ("mood_or_genre", "ambiguous")) | dict.fromkeys(["exact_tag_current", *METADATA[1::2]], ("mood_or_genre", "ambiguous", "similarity_request"))


def allowed(source: str, intent: Column, profile: str) -> Column:
    """Whether a source is asked for a task of that intent."""
    return intent.isin(list(ASKED[source])) if profile in GATED and source in ASKED else F.lit(True)


def candidates(profile: str, sources: dict[str, Callable[[int], DataFrame]], intents: DataFrame, keys: list[str], fetch: dict[str, int] | None = None, keep: dict[str, int] | None = None) -> DataFrame:
    """source, source_order, keys, item_id, rank of a profile's sources, each fetched, gated by the task's intent and cut.

    sources: by name, a function of the number of rows to fetch; those that are not given are left out. intents: keys, intent."""
    fetch, keep = FETCH | (fetch or {}), KEEP | (keep or {})
    out = None
    for order, name in enumerate(n for n in PROFILES[profile] if n in sources):
        found = sources[name](fetch[name]).where(F.col("rank") <= keep[name])
        if profile in GATED and name in ASKED:
            found = found.join(intents.where(allowed(name, F.col("intent"), profile)).select(*keys), keys, "left_semi")
        part = found.select(F.lit(name).alias("source"), F.lit(order).alias("source_order"), *keys, "item_id", F.col("rank").cast("int").alias("rank"))
        out = part if out is None else out.unionAll(part)
    return out


def scored_once(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Of an item that a source gives twice, the first place and the largest score: keys, source, item_id, rank, score."""
    return ranked.groupBy(*keys, "source", "item_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
