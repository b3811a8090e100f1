"""Queries on session audits and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import features as E
from ..operators import learning as L
from ..operators import ranking as K
from . import ranking as R
from .store import stored
from .views import ITEMS, PLAYS, items, plays, table

DETECTORS = ["late", "promo", "heavy"]


def _frame(s, d) -> DataFrame:
    """Turns with three flags of their orders and lines as detectors, and progress from the order's status."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("session_id"), (F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("urgent"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("progress"))
    i = items(s, d).select("item_id", F.col("popularity").alias("pop"))
    f = A.turn_frame(plays(s, d), items(s, d)).join(o, "session_id").join(i, "item_id")
    return f.select("session_id", "turn_number", "item_id", "same_adjacent", "same_cumulative", "lagged", "progress", (F.col("turn_number") >= 4).alias("late"), F.col("urgent").alias("promo"), (F.col("pop") >= 30).alias("heavy"))


def turn_frame(s, d):
    return A.turn_frame(plays(s, d), items(s, d)).drop("item_id")


def session_stats(s, d):
    return A.session_stats(_frame(s, d), DETECTORS)


def rates(s, d):
    return A.rates(A.session_stats(_frame(s, d), DETECTORS), ["detector"])


def pivot_by_turn(s, d):
    return A.by_turn(_frame(s, d), DETECTORS)


def turn_standardized(s, d):
    return A.standardized(_frame(s, d), ["promo", "heavy"])


_STRATA = {"AUTOMOBILE": 20, "BUILDING": 30, "FURNITURE": 10, "HOUSEHOLD": 25, "MACHINERY": 5000}


def strata_sample(s, d):
    r = A.stratified_sample(table(s, d, "customer").select("c_custkey", "c_mktsegment"), F.col("c_mktsegment"), _STRATA, "c_custkey", "a1")
    return r.select("c_custkey", "stratum", "draw", "population", "weight")


def _judged(s, d):
    """Turns with a label from the line's return flag."""
    li = table(s, d, "lineitem")
    label = F.when(F.col("l_returnflag") == "R", "YES").when(F.col("l_returnflag") == "N", "NO").otherwise("UNCERTAIN")
    return li.select("l_orderkey", "l_partkey", "l_shipdate", "l_quantity", label.alias("label"), F.col("l_quantity").alias("weight"), (F.col("l_discount") > 0.05).alias("late"), (F.col("l_tax") > 0.04).alias("promo"), (F.col("l_quantity") > 30).alias("heavy"))


def weighted_prf(s, d):
    return A.weighted_errors(_judged(s, d), "label", DETECTORS, "weight")


def error_rows(s, d):
    e = A.error_rows(_judged(s, d), "label", DETECTORS, ["l_orderkey", "l_partkey"])
    return e.groupBy("l_orderkey", "detector", "error").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("checksum"))


def integrity(s, d):
    """Texts of documents as a form against a manifest of the ones that labels cover."""
    docs = table(s, d, "documents")
    form = docs.join(table(s, d, "labels"), "doc_id", "left").select("doc_id", "text", F.when(F.col("quality") == 1, "YES").when(F.col("toxic") == 1, "MAYBE").otherwise("NO").alias("label"))
    manifest = docs.where("lang <> 'es'").select("doc_id", F.sha2(F.when(F.col("lang") == "de", F.trim(F.concat("text", F.lit("x")))).otherwise(F.col("text")), 256).alias("sha256"))
    return A.integrity(form, manifest, "doc_id", ["YES", "NO", "UNCERTAIN"], "text")


def bootstrap_ci(s, d):
    """Repeat rates of flagged turns with intervals over sessions."""
    st = A.session_stats(_frame(s, d), DETECTORS).groupBy("session_id", "detector").agg(F.sum("n_hit_same").alias("a"), F.sum("n_hit").alias("b"))
    return A.bootstrap(st, "session_id", ["detector"], ("a", "b"), 200)


def irls_sandwich(s, d):
    """Repeats by detector with turn effects; errors by session."""
    f = _frame(s, d).where("same_cumulative is not null").withColumn("one", F.lit(1)).withColumn("y", F.col("same_cumulative").cast("int"))
    turns = sorted(r.turn_number for r in f.select("turn_number").distinct().collect())[1:]  # the first turn with a value is the baseline
    f = f.select("*", *((F.col("turn_number") == t).cast("int").alias(f"t{t}") for t in turns))
    return A.cluster_logistic(f.withColumn("promo", F.col("promo").cast("int")), ["one", "promo", *(f"t{t}" for t in turns)], "y", "session_id")


def oof_folds(s, d):
    return L.folds(plays(s, d).select("session_id").distinct(), 5, "f3")


_COLUMNS = ["primary_inv_rank", "continuity_inv_rank", "artist_inv_rank", "source_hit_count", "source_rrf_sum_k60", "f_turn"]


def _training(s, d):
    return stored(s, d, "training", lambda: _build_training(s, d))


def _build_training(s, d):
    f = R.rank_only_v2(s, d).join(R._labels(s, d), K.TASK)
    return f.select(*K.TASK, "item_id", *_COLUMNS, (F.col("item_id") == F.col("label")).cast("int").alias("label"))


def gbt_rerank(s, d):
    """Top 20 by boosted trees that have not seen the task's session."""
    out = L.out_of_fold(_training(s, d), _COLUMNS, 2, "f", 3)
    return K.scored_top(out.select(*K.TASK, "item_id", "score"), 20)


def pairwise_rerank(s, d):
    """Top 20 by a linear pairwise ranker, blended by z-scores with the fused score."""
    t = _training(s, d)
    scored = L.linear_score(t, _COLUMNS, L.fit_pairwise(t, _COLUMNS))
    fused = R._fused(s, d).select(*K.TASK, "item_id", F.col("score").alias("fused"))
    j = scored.select(*K.TASK, "item_id", F.col("score").alias("pairwise")).join(fused, [*K.TASK, "item_id"])
    return K.scored_top(E.blend(E.zscores(j, ["pairwise", "fused"]), {"pairwise": 0.6, "fused": 0.4}).select(*K.TASK, "item_id", "score"), 20)


def popularity_stream(s, d):
    """The most played items of segments, kept up to date as a stream."""
    from ..streaming.popularity import replay

    return replay(s, d).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


_FRAME = f"""{PLAYS}, {ITEMS}, tf0 AS (SELECT p.*, artist, min(turn_number) OVER (PARTITION BY session_id, artist) AS first, lag(artist) OVER w AS before, max((artist IS NOT NULL)::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM plays p LEFT JOIN items USING (item_id) WINDOW w AS (PARTITION BY session_id ORDER BY turn_number)),
  tf1 AS (SELECT session_id, turn_number, item_id, CASE WHEN artist IS NOT NULL AND before IS NOT NULL THEN artist = before END AS same_adjacent, CASE WHEN artist IS NOT NULL AND known = 1 THEN first < turn_number END AS same_cumulative FROM tf0),
  tf AS (SELECT *, lag(same_cumulative) OVER (PARTITION BY session_id ORDER BY turn_number) AS lagged FROM tf1),
  fr AS MATERIALIZED (SELECT tf.*, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS progress, turn_number >= 4 AS late, o_orderpriority IN ('1-URGENT', '2-HIGH') AS promo, popularity >= 30 AS heavy FROM tf JOIN orders ON o_orderkey = session_id JOIN items USING (item_id)),
  ex AS (SELECT session_id, turn_number, same_cumulative, progress, unnest([{{detector: 'late', hit: late}}, {{detector: 'promo', hit: promo}}, {{detector: 'heavy', hit: heavy}}]) AS x FROM fr WHERE same_cumulative IS NOT NULL),
  e AS (SELECT session_id, turn_number, same_cumulative AS same, progress AS good, x.detector AS detector, x.hit AS hit FROM ex)"""
_NUMBERS = "count(*) AS n, count(*) FILTER (WHERE hit) AS n_hit, count(*) FILTER (WHERE hit AND same) AS n_hit_same, count(*) FILTER (WHERE NOT hit AND same) AS n_other_same, count(*) FILTER (WHERE hit AND good) AS n_hit_good, count(*) FILTER (WHERE NOT hit AND good) AS n_other_good, count(*) FILTER (WHERE hit AND same AND good) AS n_hit_same_good"
_JUDGED = "j AS (SELECT l_orderkey, l_partkey, l_returnflag = 'R' AS yes, l_quantity AS w, unnest([{detector: 'late', hit: l_discount > 0.05}, {detector: 'promo', hit: l_tax > 0.04}, {detector: 'heavy', hit: l_quantity > 30}]) AS x FROM lineitem WHERE l_returnflag IN ('R', 'N'))"
SQL = {
    "turn_frame": f"WITH {_FRAME} SELECT session_id, turn_number, same_adjacent, same_cumulative, lagged FROM tf",
    "session_stats": f"WITH {_FRAME} SELECT session_id, detector, {_NUMBERS} FROM e WHERE good IS NOT NULL GROUP BY 1, 2",
    "rates": f"""WITH {_FRAME}, t AS (SELECT detector, {_NUMBERS} FROM e WHERE good IS NOT NULL GROUP BY 1) SELECT detector, n, n_hit, round(n_hit_same / n_hit, 6) AS same_if_hit, round(n_other_same / (n - n_hit), 6) AS same_if_other, round(n_hit_same / n_hit - n_other_same / (n - n_hit), 6) AS same_gap,
      round(n_hit_good / n_hit, 6) AS good_if_hit, round(n_other_good / (n - n_hit), 6) AS good_if_other, round(n_hit_good / n_hit - n_other_good / (n - n_hit), 6) AS good_gap, round(n_hit_same_good / nullif(n_hit_same, 0), 6) AS good_if_hit_same FROM t""",
    "pivot_by_turn": f"WITH {_FRAME} SELECT detector, turn_number, count(*) AS n, sum(hit::INT)::BIGINT AS n_hit, round(avg(same::INT) FILTER (WHERE hit), 6) AS same_if_hit, round(avg(same::INT) FILTER (WHERE NOT hit), 6) AS same_if_other FROM e GROUP BY 1, 2",
    "turn_standardized": f"""WITH {_FRAME}, t AS (SELECT detector, turn_number, count(*) FILTER (WHERE hit) AS nh, count(*) FILTER (WHERE NOT hit) AS no, avg(same::INT) FILTER (WHERE hit) AS a, avg(same::INT) FILTER (WHERE NOT hit) AS b FROM e WHERE detector <> 'late' GROUP BY 1, 2 HAVING nh > 0 AND no > 0)
      SELECT detector, count(*) AS turns, sum(nh)::BIGINT AS n, round(sum(nh * a) / sum(nh), 6) AS same_if_hit, round(sum(nh * b) / sum(nh), 6) AS same_if_other, round(sum(nh * a) / sum(nh) - sum(nh * b) / sum(nh), 6) AS difference FROM t GROUP BY 1""",
    "strata_sample": f"""WITH z AS (SELECT c_custkey, c_mktsegment AS stratum, CASE c_mktsegment {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _STRATA.items())} ELSE 0 END AS size, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(concat_ws(':', 'a1', c_custkey)), c_custkey) AS draw, count(*) OVER (PARTITION BY c_mktsegment) AS population FROM customer)
      SELECT c_custkey, stratum, draw::INT AS draw, population, round(population / least(population, size), 6) AS weight FROM z WHERE draw <= size""",
    "weighted_prf": f"WITH {_JUDGED}, s AS (SELECT x.detector AS detector, count(*) AS n, coalesce(sum(w) FILTER (WHERE yes AND x.hit), 0) AS tp, coalesce(sum(w) FILTER (WHERE NOT yes AND x.hit), 0) AS fp, coalesce(sum(w) FILTER (WHERE yes AND NOT x.hit), 0) AS fn FROM j GROUP BY 1) SELECT detector, n, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM s",
    "error_rows": f"WITH {_JUDGED} SELECT l_orderkey, x.detector AS detector, CASE WHEN x.hit THEN 'false_positive' ELSE 'false_negative' END AS error, count(*) AS n, sum(l_partkey)::BIGINT AS checksum FROM j WHERE yes <> x.hit GROUP BY 1, 2, 3",
    "integrity": """SELECT doc_id::VARCHAR AS key, 'not in manifest' AS problem FROM documents WHERE lang = 'es' UNION ALL SELECT d.doc_id::VARCHAR, 'label' FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND quality <> 1 AND toxic = 1 UNION ALL SELECT doc_id::VARCHAR, 'changed text' FROM documents WHERE lang = 'de'""",
    "oof_folds": "SELECT session_id, ((row_number() OVER (ORDER BY sha256('f3:' || session_id), session_id) - 1) % 5)::INT AS fold FROM (SELECT DISTINCT l_orderkey AS session_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey)",
}
ROWS_ONLY = ["irls_sandwich", "gbt_rerank", "pairwise_rerank"]
QUERIES = {n: globals()[n] for n in [*SQL, *ROWS_ONLY]}
