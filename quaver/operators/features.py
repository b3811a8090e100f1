"""Features of candidates: one wide row a task and item, from long lists by conditional aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from .ranking import TASK

MISSING = 9999


def _ranks(pool: DataFrame, ranked: DataFrame, sources: list[str], keys: list[str]) -> DataFrame:
    """pool's rows with one rank column a source; null where the source has not the item."""
    wide = ranked.groupBy(*keys, "item_id").agg(*(F.min(F.when(F.col("source") == s, F.col("rank"))).alias(f"r_{s}") for s in sources))
    return pool.join(wide, [*keys, "item_id"], "left")


def _total(columns) -> F.Column:
    out = F.lit(0.0)
    for c in columns:
        out = out + c
    return out


def ltr_rank_features(pool: DataFrame, ranked: DataFrame, sources: list[str], keys: list[str] | None = None) -> DataFrame:
    """pool: keys, item_id, rank. Per source hit, rank (null if missing) and reciprocal rank; over all: sum, best and number."""
    keys = keys or TASK
    w = _ranks(pool.withColumnRenamed("rank", "candidate_rank"), ranked, sources, keys)
    r = {s: F.col(f"r_{s}") for s in sources}
    inv = {s: F.coalesce(1.0 / (60 + c), F.lit(0.0)) for s, c in r.items()}
    out = [F.col("candidate_rank").cast("double").alias("f_candidate_rank"), F.round(1 / F.log2(F.col("candidate_rank") + 1), 6).alias("f_rank_discount")]
    for s in sources:
        out += [F.when(r[s].isNotNull(), 1.0).otherwise(0.0).alias(f"f_{s}_hit"), r[s].cast("double").alias(f"f_{s}_rank"), F.round(inv[s], 6).alias(f"f_{s}_rrf")]
    best = F.least(*r.values()) if len(r) > 1 else next(iter(r.values()))
    out += [F.round(_total(inv.values()), 6).alias("f_rrf_score"), best.cast("double").alias("f_best_source_rank"), _total(F.when(c.isNotNull(), 1.0).otherwise(0.0) for c in r.values()).alias("f_source_hit_count")]
    return w.select(*keys, "item_id", *out)


def rank_only(pool: DataFrame, primary: DataFrame, ranked: DataFrame, topk: dict[str, int], version: int = 2, keys: list[str] | None = None) -> DataFrame:
    """5 features of the primary rank, 4 (version 1) or 5 (version 2) a source, and 6 or 8 over all. Missing ranks give 0, clipped ones topk + 1."""
    keys = keys or TASK
    turn = F.col("turn_number")
    w = _ranks(pool, ranked, list(topk), keys).join(primary.select(*keys, "item_id", F.col("rank").alias("p")), [*keys, "item_id"], "left")
    p = F.coalesce("p", F.lit(MISSING))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    inverse = lambda c: F.when(c < MISSING, F.round(1.0 / c, 6)).otherwise(0.0)
    out = [inverse(p).alias("primary_inv_rank"), flag(p == 1).alias("primary_is_top1"), *(flag(p <= n).alias(f"primary_in_top{n}") for n in (5, 10, 20))]
    r = {s: F.coalesce(f"r_{s}", F.lit(MISSING)) for s in topk}
    for s, n in topk.items():
        clipped = F.least(r[s], F.lit(n + 1)).cast("double")
        out += [inverse(r[s]).alias(f"{s}_inv_rank"), flag(r[s] <= 5).alias(f"{s}_in_top5"), flag(r[s] <= 20).alias(f"{s}_in_top20"), clipped.alias(f"{s}_rank_clipped")]
        if version == 2:
            out.append(F.round(clipped / (n + 1), 6).alias(f"{s}_rank_pct"))
    hits = _total(flag(c < MISSING) for c in r.values())
    best = F.least(*r.values()) if len(r) > 1 else next(iter(r.values()))
    rrf = lambda k: F.round(_total(F.when(c < MISSING, 1.0 / (k + c)).otherwise(0.0) for c in r.values()), 6)
    out.append(F.round(hits / len(topk), 6).alias("source_hit_rate"))
    out += [hits.alias("source_hit_count")] if version == 2 else []
    out += [inverse(best).alias("source_best_inv_rank"), rrf(60).alias("source_rrf_sum_k60")]
    out += [rrf(200).alias("source_rrf_sum_k200")] if version == 2 else []
    out += [turn.cast("double").alias("f_turn"), flag(turn <= 2).alias("is_early_turn"), flag(turn >= 3).alias("is_followup_turn")]
    return w.select(*keys, "item_id", *out)


def lexical(pool: DataFrame, texts: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """pool: keys, item_id; texts: keys, text; items: item_id, name, artist, album, tags, popularity. Phrase matches, word overlaps and counts."""
    j = pool.select(*keys, "item_id").join(texts.select(*keys, X.normalize_text(F.col("text")).alias("t")), keys).join(items, "item_id")
    n = {f: X.normalize_text(F.col(f)) for f in ("name", "artist", "album")}
    tags = F.array_join(X.as_values(F.col("tags")), " ")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return j.select(
        *keys,
        "item_id",
        *(flag(X.phrase_in(c, F.col("t"))).alias(f"f_{f}_match") for f, c in n.items()),
        *(X.token_overlap(c, F.col("t")).cast("double").alias(f"f_{f}_overlap") for f, c in n.items()),
        X.token_overlap(tags, F.col("t")).cast("double").alias("f_tag_overlap"),
        F.size("tags").cast("double").alias("f_tag_count"),
        F.col("popularity").alias("f_popularity"),
        _total(flag(F.length(F.coalesce(F.col(f), F.lit(""))) > 0) for f in ("name", "artist", "album")).alias("f_field_count"),
    )


def history_features(pool: DataFrame, history: DataFrame, items: DataFrame, vectors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Items of the history with the candidate's artist, tags they share, and mean and greatest cosine to the history's vectors (0 if none)."""
    keys = keys or TASK
    it = items.select("item_id", "artist", "tags")
    c = pool.select(*keys, "item_id").join(it, "item_id").join(vectors.select("item_id", V.unit(F.col("v")).alias("v")), "item_id", "left")
    h = history.join(it, "item_id").join(vectors.select("item_id", V.unit(F.col("v")).alias("v")), "item_id", "left").select(*keys, F.col("artist").alias("ha"), F.col("tags").alias("ht"), F.col("v").alias("hv"))
    cosine = F.when(F.col("v").isNotNull() & F.col("hv").isNotNull(), F.greatest(V.dot(F.col("v"), F.col("hv")), F.lit(0.0)))
    j = c.join(h, keys, "left")
    return j.groupBy(*keys, "item_id").agg(
        F.coalesce(F.sum((F.col("artist") == F.col("ha")).cast("double")), F.lit(0.0)).alias("f_same_artist"),
        F.coalesce(F.sum(F.size(F.array_intersect("tags", "ht")).cast("double")), F.lit(0.0)).alias("f_same_tags"),
        F.count("ha").cast("double").alias("f_history"),
        F.round(F.coalesce(F.avg(cosine), F.lit(0.0)), 6).alias("f_mean_cosine"),
        F.round(F.coalesce(F.max(cosine), F.lit(0.0)), 6).alias("f_max_cosine"),
    )


def miscellaneous(pool: DataFrame, tasks: DataFrame, ranked: DataFrame, explicit: list[str], keys: list[str] | None = None) -> DataFrame:
    """Features of the task beside each candidate: turn, items before, words of its texts, whether a source of explicit matches has the
    item, its intent, and flags of vectors that are missing. tasks: keys, turn, n_history, current, full, recent, intent, user_v, history_v."""
    keys = keys or TASK
    hit = ranked.where(F.col("source").isin(explicit)).select(*keys, "item_id", F.lit(1.0).alias("hit")).distinct()
    n = lambda c: F.size(F.array_distinct(X.words(X.normalize_text(F.col(c))))).cast("double")
    j = pool.select(*keys, "item_id").join(tasks, keys).join(hit, [*keys, "item_id"], "left")
    return j.select(
        *keys,
        "item_id",
        F.coalesce("turn", F.lit(0)).cast("double").alias("f_turn_number"),
        F.col("n_history").cast("double").alias("f_history_count"),
        *(n(c).alias(f"f_{c}_query_len") for c in ("full", "current", "recent")),
        F.coalesce("hit", F.lit(0.0)).alias("f_has_explicit_source_hit"),
        *((F.col("intent") == i).cast("double").alias(f"f_intent_{i}") for i in (*X.INTENTS, "ambiguous")),
        *((~F.coalesce(V.is_valid(F.col(f"{c}_v")), F.lit(False))).cast("double").alias(f"f_missing_{c}_embedding") for c in ("user", "history")),
    )


def lexical_views(pool: DataFrame, texts: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Matches of an item's fields with the current and the full text, and words its tags share with these and the recent one.
    texts: keys, current, full, recent."""
    j = pool.select(*keys, "item_id").join(texts.select(*keys, *(X.normalize_text(F.col(c)).alias(f"t_{c}") for c in ("current", "full", "recent"))), keys).join(items, "item_id")
    tags = F.array_join(X.as_values(F.col("tags")), " ")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return j.select(
        *keys,
        "item_id",
        *(flag(X.phrase_in(X.normalize_text(F.col(f)), F.col(f"t_{v}"))).alias(f"f_{f}_exact_{v}") for v in ("current", "full") for f in ("name", "artist", "album")),
        *(X.token_overlap(tags, F.col(f"t_{v}")).cast("double").alias(f"f_tag_overlap_{v}") for v in ("current", "full", "recent")),
    )


def vector_features(pool: DataFrame, spaces: dict[str, DataFrame], of: dict[str, tuple[str, DataFrame]], keys: list[str] | None = None) -> DataFrame:
    """Cosines of candidates with vectors of the task. spaces: by name, item_id and v; of: by feature, the space and keys, q (one vector a
    task). A missing or invalid vector on either side gives 0."""
    keys = keys or TASK
    out = pool.select(*keys, "item_id")
    for name, (space, queries) in of.items():
        v = spaces[space].select("item_id", V.unit(F.col("v")).alias("v"))
        q = queries.select(*keys, V.unit(F.col("q")).alias("q"))
        out = out.join(v, "item_id", "left").join(q, keys, "left")
        cosine = F.when(F.col("v").isNotNull() & F.col("q").isNotNull(), V.dot(F.col("v"), F.col("q")))
        out = out.withColumn(name, F.round(F.coalesce(cosine, F.lit(0.0)), 6)).drop("v", "q")
    return out


def feature_columns(columns: list[str]) -> list[str]:
    """Names of features, which begin with f_, sorted."""
    return sorted(c for c in columns if c.startswith("f_"))


def sources_of(columns: list[str]) -> list[str]:
    """Sources that have a hit, rank and rrf feature each, by the features' names."""
    names = set(columns)
    return sorted(c[2:-4] for c in names if c.startswith("f_") and c.endswith("_hit") and {f"{c[:-4]}_rank", f"{c[:-4]}_rrf"} <= names)


def with_extra(features: DataFrame, provider=None) -> DataFrame:
    """A hook for further columns, such as sources' confidence: provider maps the table to more columns; by default there are none."""
    return features.select("*", *(provider(features) if provider else []))


def standardised(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less the training mean, by the training deviation; a deviation under 1e-6 counts as 1. The statistics are one row."""
    s = train.agg(*(a for c in columns for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))))
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") < 1e-6, 1.0).otherwise(F.col(f"s_{c}"))
    return df.crossJoin(F.broadcast(s)).select(*(F.round(z(c), 6).alias(c) if c in columns else F.col(c) for c in df.columns))


def zscores(df: DataFrame, columns: list[str], keys: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Each column by its mean and deviation within the task; one row or none apart give 0. Statistics are joined, not windowed, so a large task stays split."""
    keys = keys or TASK
    s = df.groupBy(*keys).agg(F.count("*").alias("n"), *(a for c in columns for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))))
    z = lambda c: F.when((F.col("n") <= 1) | (F.col(f"s_{c}") <= 1e-12), 0.0).otherwise((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"))
    return df.join(s, keys).select(*(F.round(z(c), digits).alias(c) if c in columns else F.col(c) for c in df.columns))


def blend(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """score: the weighted mean of columns."""
    total = sum(weights.values())
    return df.withColumn("score", F.round(_total(F.col(c) * (w / total) for c, w in weights.items()), 6))
