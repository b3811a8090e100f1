"""Candidate sources: each gives keys, item_id, score (or rank) in long form, from relations of plays, values and indexes.

values: item_id, field (0 track, 1 artist, 2 album, 3 tag), value, popularity.  index: field, value, item_id, pop_rank.
history: keys, item_id, recency from 1.  Sums are taken per value before lists are unfolded, so a hot value is unfolded once
a task, not once an occurrence; lists are cut to their caps before they join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import unfolding as N
from .ranking import SPREAD, TASK, scored_top, top

# fields' weights (artist, album, tag), caps (artist, album, tag) and turns of history, by variant of continuity.
CONTINUITY = {
    "album": ((0.0, 1.0, 0.0), (0, 120, 0), None),
    "artist": ((1.0, 0.0, 0.0), (160, 0, 0), None),
    "album_artist": ((0.65, 1.0, 0.0), (140, 120, 0), None),
    "artist_album": ((1.0, 0.6, 0.0), (180, 100, 0), None),
    "recent2_album_artist": ((0.7, 1.0, 0.0), (140, 120, 0), 2),
    "recent1_album_artist": ((0.7, 1.0, 0.0), (140, 120, 0), 1),
    "album_artist_tag": ((0.65, 1.0, 0.08), (140, 120, 24), None),
}
# Weights of entity fields; caps (other fields, tags) and user turns before the current one, by variant.
ENTITY_WEIGHTS = (4.0, 2.8, 2.2, 0.9)
ENTITY = {"current": (180, 60, 0), "recent2": (180, 60, 2), "recent4": (180, 60, 4), "tight": (80, 24, 0)}
# Turns of history, key weights (track, artist, album, tag), label weights (direct, artist, tag), by variant of transitions.
TRANSITION = {
    "recent1": (1, (2.5, 1.6, 1.3, 0.25), (2.0, 0.45, 0.08)),
    "recent2": (2, (2.2, 1.4, 1.1, 0.22), (2.0, 0.45, 0.08)),
    "all": (None, (1.8, 1.2, 0.9, 0.18), (2.0, 0.45, 0.08)),
    "artist_album": (None, (0.0, 1.7, 1.2, 0.0), (2.0, 0.35, 0.0)),
}


def value_index(values: DataFrame) -> DataFrame:
    """field, value, item_id, pop_rank: the items of each value by popularity, then id."""
    w = Window.partitionBy("field", "value").orderBy(F.desc("popularity"), "item_id")
    return values.select("field", "value", "item_id", "popularity").repartition(SPREAD, "item_id").distinct().withColumn("pop_rank", F.row_number().over(w)).drop("popularity")


def capped(index: DataFrame, caps: tuple[int, ...], first: int = 1) -> DataFrame:
    """index without what is beyond its field's cap; caps begin with field `first`.

    The largest cap and the fields are told on their own: Spark limits groups before it shuffles them by the one, reads less by the other."""
    keep = F.lit(False)
    for k, cap in enumerate(caps, first):
        if cap:
            keep = keep | ((F.col("field") == k) & (F.col("pop_rank") <= cap))
    fields = [k for k, cap in enumerate(caps, first) if cap]
    return index.where(F.col("field").isin(fields)).where(F.col("pop_rank") <= max(caps)).where(keep)


def _weighed(index: DataFrame) -> DataFrame:
    """index as lists of weights by place."""
    return index.select("field", "value", "item_id", F.col("pop_rank").alias("place"), rank_weight(F.col("pop_rank")).alias("weight"))


def by_field(weights: tuple[float, ...], first: int = 0) -> Column:
    out = F
    for k, w in enumerate(weights, first):
        out = out.when(F.col("field") == k, F.lit(float(w)))
    return out.otherwise(F.lit(0.0))


def recency_weight(c: Column) -> Column:
    """Null for recency 0, which filters keep out but may be computed before them."""
    return F.try_divide(F.lit(1.0), F.log2(c + 1))


def rank_weight(c: Column) -> Column:
    return 1 / F.log2(c + 2)


def continuity(history: DataFrame, values: DataFrame, index: DataFrame, variant: str, k: int, keys: list[str] | None = None) -> DataFrame:
    """Items that share artist, album or tags with the history, without the history itself."""
    keys = keys or TASK
    weights, caps, recent = CONTINUITY[variant]
    h = history if recent is None else history.where(F.col("recency") <= recent)
    w = by_field(weights, 1)
    lists = N.held_lists(_weighed(capped(index, caps)), values)
    if lists is not None:
        fields = [f for f, x in enumerate(weights, 1) if x > 0]
        return N.unfolded(N.gathered(h, values, fields, keys, recency_weight(F.col("recency")) * w), lists, keys, k)
    held = h.join(values.select("item_id", "field", "value").where("field >= 1"), "item_id").groupBy(*keys, "field", "value").agg(F.sum(recency_weight(F.col("recency")) * w).alias("w"))
    scored = held.where("w > 0").join(capped(index, caps), ["field", "value"]).groupBy(*keys, "item_id").agg(F.sum(F.col("w") * rank_weight(F.col("pop_rank"))).alias("score"))
    return scored_top(scored.join(h.select(*keys, "item_id").distinct(), [*keys, "item_id"], "left_anti"), k, keys, values.groupBy("item_id").agg(F.max("popularity").alias("popularity")))


def entities(texts: DataFrame, values: DataFrame, index: DataFrame, variant: str, k: int, keys: list[str]) -> DataFrame:
    """Items of every indexed value (of three letters or more) that occurs as a phrase in texts(keys, text)."""
    cap, tag_cap, _ = ENTITY[variant]
    found = texts.select(*keys, F.explode(X.phrases(F.col("text"))).alias("value")).distinct()
    some = capped(index, (cap, cap, cap, tag_cap), 0).where(F.length("value") >= 3)
    scored = found.join(some, "value").groupBy(*keys, "item_id").agg(F.sum(by_field(ENTITY_WEIGHTS) * rank_weight(F.col("pop_rank"))).alias("score"))
    return scored_top(scored, k, keys, values.groupBy("item_id").agg(F.max("popularity").alias("popularity")))


def label_expansion(labels: DataFrame, values: DataFrame, index: DataFrame, direct: float, artist: float, tag: float, artist_top: int, tag_top: int) -> DataFrame:
    """label, item_id, weight: the label itself, and the first items of its artists and tags."""
    own = labels.select("label").distinct()
    w = by_field((artist, 0.0, tag), 1)
    near = own.join(values.where("field in (1, 3)").select(F.col("item_id").alias("label"), "field", "value"), "label").join(capped(index, (artist_top, 0, tag_top)), ["field", "value"])
    both = own.select("label", F.col("label").alias("item_id"), F.lit(float(direct)).alias("w")).unionAll(near.select("label", "item_id", (w * rank_weight(F.col("pop_rank"))).alias("w")))
    return both.groupBy("label", "item_id").agg(F.sum("w").alias("weight"))


def _expanded(labelled: DataFrame, keys: list[str], values: DataFrame, index: DataFrame, weights: tuple[float, float, float], tops: tuple[int, int]) -> DataFrame:
    """Sums of label expansions of labelled(keys, label, w): summed per artist and tag first, then unfolded."""
    direct, artist, tag = weights
    own = labelled.groupBy(*keys, "label").agg(F.sum("w").alias("w"))
    near = values.where("field in (1, 3)").select(F.col("item_id").alias("label"), F.col("field").alias("of"), F.col("value").alias("held"), by_field((artist, 0.0, tag), 1).alias("share"))
    near = own.join(near, "label").groupBy(*keys, "of", "held").agg(F.sum(F.col("w") * F.col("share")).alias("w")).where("w > 0")
    lists = capped(index, (tops[0], 0, tops[1])).select(F.col("field").alias("of"), F.col("value").alias("held"), "item_id", "pop_rank")
    near = near.join(lists, ["of", "held"]).select(*keys, "item_id", (F.col("w") * rank_weight(F.col("pop_rank"))).alias("w"))
    return own.select(*keys, F.col("label").alias("item_id"), (F.col("w") * direct).alias("w")).unionAll(near).groupBy(*keys, "item_id").agg(F.sum("w").alias("score"))


def _transition_keys(history: DataFrame, values: DataFrame, weights: tuple[float, ...], keys: list[str]) -> DataFrame:
    """keys, field, key, kw: a track is the key of itself, its artists, albums and tags."""
    own = history.select(*keys, F.lit(0).alias("field"), F.col("item_id").cast("string").alias("key"), "recency")
    near = history.join(values.where("field >= 1").select("item_id", "field", F.col("value").alias("key")), "item_id").select(*keys, "field", "key", "recency")
    return own.unionAll(near).select(*keys, "field", "key", (by_field(weights) * recency_weight(F.col("recency"))).alias("kw")).where("kw > 0")


def transition_index(train_history: DataFrame, labels: DataFrame, values: DataFrame, index: DataFrame, variant: str, postings: int = 220, artist_top: int = 80, tag_top: int = 16) -> DataFrame:
    """field, key, item_id, weight: what followed a key in training, unfolded to like items; the first `postings` of each key."""
    recent, key_weights, label_weights = TRANSITION[variant]
    h = train_history if recent is None else train_history.where(F.col("recency") <= recent)
    labelled = _transition_keys(h, values, key_weights, TASK).join(labels, TASK).groupBy("field", "key", "label").agg(F.sum("kw").alias("w"))
    scored = _expanded(labelled, ["field", "key"], values, index, label_weights, (artist_top, tag_top))
    return top(scored, ["field", "key"], [F.desc(F.round("score", 6)), F.asc("item_id")], postings).select("field", "key", "item_id", F.col("score").alias("weight"))


def transition(history: DataFrame, values: DataFrame, postings: DataFrame, variant: str, k: int) -> DataFrame:
    recent, key_weights, _ = TRANSITION[variant]
    h = history if recent is None else history.where(F.col("recency") <= recent)
    # where tracks are keys themselves, there are as many lists as tracks, and they are not tried
    lists = None if key_weights[0] else N.held_lists(postings.select("field", F.col("key").alias("value"), "item_id", F.lit(0).alias("place"), "weight"), values)
    if lists is not None:
        fields = [f for f, x in enumerate(key_weights) if x > 0]
        held = N.gathered(h, values, fields, TASK, recency_weight(F.col("recency")) * by_field(key_weights), gone=False)
        return N.unfolded(held, lists, TASK, k)
    asked = _transition_keys(h, values, key_weights, TASK).groupBy(*TASK, "field", "key").agg(F.sum("kw").alias("kw"))
    scored = asked.join(postings, ["field", "key"]).groupBy(*TASK, "item_id").agg(F.sum(F.col("kw") * F.col("weight")).alias("score"))
    return scored_top(scored, k, TASK, values.groupBy("item_id").agg(F.max("popularity").alias("popularity")))


def neighbor_memory(neighbors: DataFrame, labels: DataFrame, values: DataFrame, index: DataFrame, k: int, keys: list[str], artist_top: int = 120, tag_top: int = 24, scale: float = 0.25) -> DataFrame:
    """neighbors: keys, neighbor, rank, score of like training queries; labels: neighbor, label. Their labels, unfolded, weighted by likeness."""
    w = F.log1p("score") * rank_weight(F.col("rank"))
    labelled = neighbors.where("score > 0").select(*keys, "neighbor", w.alias("w")).join(labels, "neighbor")
    scored = _expanded(labelled, keys, values, index, (1.0, 0.45, 0.12 * scale), (artist_top, tag_top))
    return scored_top(scored, k, keys, values.groupBy("item_id").agg(F.max("popularity").alias("popularity")))


def label_memory_index(train_grams: DataFrame, labels: DataFrame, keys: list[str], values: DataFrame, index: DataFrame, min_df: int = 2, expand_df: int = 10, postings: int = 200, expanded: int = 300, artist_top: int = 120, tag_top: int = 80) -> DataFrame:
    """ngram, idf, item_id, kind (direct, artist or tag), value: what training queries with an n-gram led to."""
    n = train_grams.select(*keys).distinct().agg(F.count("*").alias("tasks"))
    df = train_grams.groupBy("ngram").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    df = df.crossJoin(F.broadcast(n)).select("ngram", "df", (F.log((F.col("tasks") + 1.0) / (F.col("df") + 1.0)) + 1).alias("idf"))
    led = train_grams.select(*keys, "ngram").join(df, "ngram").join(labels, keys)
    direct = led.groupBy("ngram", "idf", F.col("label").alias("item_id")).agg(F.count("*").cast("double").alias("value"))
    direct = top(direct, ["ngram"], [F.desc("value"), F.asc("item_id")], postings).select("ngram", "idf", "item_id", F.lit("direct").alias("kind"), "value")
    wide = led.where(F.col("df") >= expand_df).join(values.where("field in (1, 3)").select(F.col("item_id").alias("label"), "field", F.col("value").alias("v")), "label")
    counts = top(wide.groupBy("ngram", "idf", "field", "v").agg(F.count("*").alias("n")), ["ngram", "field"], [F.desc("n"), F.asc("v")], postings)
    near = counts.join(capped(index, (artist_top, 0, tag_top)).withColumnRenamed("value", "v"), ["field", "v"])
    near = near.groupBy("ngram", "idf", "field", "item_id").agg(F.round(F.sum(F.col("n") * rank_weight(F.col("pop_rank"))), 6).alias("value"))
    near = top(near, ["ngram", "field"], [F.desc("value"), F.asc("item_id")], expanded)
    return direct.unionAll(near.select("ngram", "idf", "item_id", F.when(F.col("field") == 1, "artist").otherwise("tag").alias("kind"), "value"))


def label_memory(grams: DataFrame, memory: DataFrame, popularity: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """grams: keys, ngram, weight."""
    w = F.when(F.col("kind") == "direct", 1.0).when(F.col("kind") == "artist", 0.45).otherwise(0.12)
    scored = grams.join(memory, "ngram").groupBy(*keys, "item_id").agg(F.sum(F.col("weight") * F.col("idf") * w * F.col("value")).alias("score"))
    return scored_top(scored, k, keys, popularity)


def cross_session(tasks: DataFrame, plays: DataFrame, k: int = 50) -> DataFrame:
    """Items of the same user's other sessions by the number of those sessions; tasks have user_id.

    Counted per user once; what the task's own session adds is taken off again, so no session meets another. Dealt once by user and item,
    over partitions enough: ids compress so well that by size they would be a few."""
    p = plays.where("user_id is not null and trim(cast(user_id as string)) <> ''").select("user_id", "session_id", "item_id").repartition(SPREAD, "user_id", "item_id").distinct()
    n = p.groupBy("user_id", "item_id").agg(F.count("*").alias("n"))
    own = p.select("session_id", "user_id", "item_id", F.lit(1).alias("own"))
    j = tasks.select(*TASK, "user_id").join(n, "user_id").join(own, ["session_id", "user_id", "item_id"], "left")
    scored = j.withColumn("score", (F.col("n") - F.coalesce("own", F.lit(0))).cast("double")).where("score > 0")
    return scored_top(scored, k)


def cross_session_pools(tasks: DataFrame, pools: list[DataFrame], k: int = 50) -> DataFrame:
    """Items of the same user's other sessions in several pools, by the number of (pool, session) that have them, then by first sight: pool,
    session, turn. tasks: session_id, turn_number, user_id; pools: user_id, session_id, turn_number, item_id; users without an id have none.

    Counted per user and item once, dealt by both. A task's own session is taken off again; should it hold the first sight, the second session's counts."""
    known = "user_id is not null and trim(cast(user_id as string)) <> ''"
    every = None
    for i, p in enumerate(pools):
        part = p.where(known).select("user_id", F.lit(i).alias("pool"), "session_id", "turn_number", "item_id")
        every = part if every is None else every.unionAll(part)
    per = every.repartition(SPREAD, "user_id", "item_id").groupBy("user_id", "item_id", "pool", "session_id").agg(F.min("turn_number").alias("at"))
    by_session = per.groupBy("user_id", "item_id", "session_id").agg(F.count("*").alias("n"), F.min(F.struct("pool", "session_id", "at")).alias("first"))
    two = top(by_session, ["user_id", "item_id"], [F.col("first")], 2, "nth").groupBy("user_id", "item_id").agg(F.min("first").alias("first"), F.max("first").alias("second"))
    total = by_session.groupBy("user_id", "item_id").agg(F.sum("n").alias("n")).join(two, ["user_id", "item_id"])
    own = by_session.select("session_id", "user_id", "item_id", F.col("n").alias("own"))
    j = tasks.select(*TASK, "user_id").join(total, "user_id").join(own, ["session_id", "user_id", "item_id"], "left")
    j = j.withColumn("score", (F.col("n") - F.coalesce("own", F.lit(0))).cast("double")).where("score > 0")
    seen = F.when(F.col("first.session_id") == F.col("session_id"), F.col("second")).otherwise(F.col("first"))
    return top(j.withColumn("seen", seen), TASK, [F.desc("score"), F.asc("seen")], k).select(*TASK, "item_id", "rank", "score")


def activity(tasks: DataFrame, found: DataFrame, keys: list[str], fields: dict[int, str]) -> DataFrame:
    """One row: tasks, those of them with anything found (keys, field), their share, and those with something of each field."""
    hit = found.groupBy(*keys).agg(*(F.max(F.col("field") == k).alias(f"active_{n}") for k, n in fields.items()))
    j = tasks.select(*keys).join(hit.withColumn("active", F.lit(True)), keys, "left")
    return j.agg(F.count("*").alias("tasks"), F.count_if("active").alias("active"), F.round(F.count_if("active") / F.count("*"), 6).alias("active_rate"), *(F.count_if(f"active_{n}").alias(f"active_{n}") for n in fields.values()))


def segment_counts(plays: DataFrame, values: DataFrame, segments: dict[str, Column]) -> DataFrame:
    """segment_type, segment, item_id, n: plays by segment of the player, and by artist and tag of the item."""
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("segment_type"), c.cast("string").alias("segment")) for k, c in segments.items())))
    by_user = plays.select("item_id", named.alias("s")).select("s.*", "item_id").where("segment is not null and segment <> ''").groupBy("segment_type", "segment", "item_id").agg(F.count("*").alias("n"))
    total = plays.groupBy("item_id").agg(F.count("*").alias("n"))
    kind = F.when(F.col("field") == 1, "artist").otherwise("tag")
    by_item = total.join(values.where("field in (1, 3)"), "item_id").select(kind.alias("segment_type"), F.col("value").alias("segment"), "item_id", "n")
    return by_user.unionAll(by_item)


def ladder(asked: DataFrame, counts: DataFrame, levels: list[str], k: int, keys: list[str]) -> DataFrame:
    """asked: keys and one column a level with its segment. The first level that has any items gives the list."""
    every = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.lit(n).alias("segment_type"), F.col(n).cast("string").alias("segment")) for i, n in enumerate(levels))))
    have = counts.select("segment_type", "segment").distinct()
    best = asked.select(*keys, every.alias("s")).select(*keys, "s.*").join(have, ["segment_type", "segment"]).groupBy(*keys).agg(F.min(F.struct("level", "segment_type", "segment")).alias("b"))
    lists = top(counts.select("segment_type", "segment", "item_id", "n"), ["segment_type", "segment"], [F.desc("n"), F.asc("item_id")], k)
    return best.select(*keys, "b.segment_type", "b.segment").join(lists, ["segment_type", "segment"]).select(*keys, "segment_type", "item_id", "rank")


def contained_values(texts: DataFrame, values: DataFrame, keys: list[str], limit: int = 100_000) -> DataFrame:
    """keys, field, value of every value that occurs in a normalised text, inside words too. A theta join has no key: values are
    broadcast if they number at most limit; beyond it they meet texts in blocks of that many."""
    v = values.select("field", "value").where("value <> ''").distinct()
    t = texts.select(*keys, X.normalize_text(F.col("text")).alias("text"))
    blocks = max(1, -(-v.count() // limit))
    v = v.withColumn("block", F.pmod(F.xxhash64("field", "value"), F.lit(blocks)))
    found = [t.join(F.broadcast(v.where(F.col("block") == i)), F.contains("text", "value")).select(*keys, "field", "value") for i in range(blocks)]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


def history_same(history: DataFrame, values: DataFrame, index: DataFrame, field: int, cap: int, keys: list[str] | None = None) -> DataFrame:
    """Items with the artists (field 1) or tags (3) of the history: values in the order they were first seen, items by popularity."""
    keys = keys or TASK
    some = index.where((F.col("field") == field) & (F.col("pop_rank") <= cap))
    lists = N.held_lists(_weighed(some))
    if lists is not None:
        return N.unfolded(N.gathered(history, values, [field], keys, F.col("recency")), lists, keys, cap, "place").select(*keys, "item_id", "rank")
    seen = history.join(values.where(F.col("field") == field).select("item_id", "value"), "item_id").groupBy(*keys, "value").agg(F.max("recency").alias("seen"))
    near = seen.join(some, "value")
    placed = near.groupBy(*keys, "item_id").agg(F.min(F.struct((-F.col("seen")).alias("s"), "value", "pop_rank")).alias("place"))
    return top(placed, keys, [F.col("place"), F.col("item_id")], cap).select(*keys, "item_id", "rank")
