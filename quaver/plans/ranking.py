"""Queries on fusion, features and metrics, over lists of three sources for the tasks to evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import features as E
from ..operators import fusion as U
from ..operators import metrics as M
from ..operators import ranking as K
from ..operators import tasks as T
from . import behaviour as B
from .retrieval import _Q, POPULAR, _queries
from .store import stored
from .views import HISTORY, ITEMS, NORM, PLAYS, TASKS, VALUES, dev_tasks, items, messages, table

CAPS = {"continuity": 40, "cross": 30, "artist": 40}
_KEY = "session_id, turn_number"


def lists(s, d) -> DataFrame:
    return stored(s, d, "lists", lambda: _lists(s, d))


def _fused(s, d) -> DataFrame:
    return stored(s, d, "fused", lambda: U.rrf(lists(s, d), 50))


def _lists(s, d) -> DataFrame:
    return U.lists({"continuity": B._continuity("album_artist")(s, d), "cross": _cross(s, d), "artist": B.history_same_artist(s, d)}, CAPS)


def _cross(s, d) -> DataFrame:
    return stored(s, d, "cross", lambda: B.cross_session(s, d))


def _labels(s, d):
    return dev_tasks(s, d).select("session_id", "turn_number", "label")


def _candidates(s, d):
    c = _fused(s, d).join(_labels(s, d), K.TASK)
    return c.select(*K.TASK, "item_id", "rank", "score", (F.col("item_id") == F.col("label")).cast("int").alias("label"))


def rrf_union(s, d):
    return U.rrf(lists(s, d), 50)


def quota_union(s, d):
    return U.quota(lists(s, d), {"history": ["continuity", "artist"], "users": ["cross"]}, {"history": 15, "users": 8}, 40)


def ordered_union_excl(s, d):
    seen = B._dev_history(s, d)
    return U.ordered_union(lists(s, d), seen, _labels(s, d))


def neg_sampling(s, d):
    return U.sample_negatives(_candidates(s, d), 20, 8, "s7")


def require_positive(s, d):
    return U.require_positive(_candidates(s, d)).select(*K.TASK, "item_id", "rank", "label")


def backfill20(s, d):
    """Cross-session lists without what the session has played, filled from the most popular items."""
    spare = dev_tasks(s, d).select(*K.TASK).crossJoin(F.broadcast(K.popular(items(s, d), 60).withColumnRenamed("pop_rank", "rank")))
    return U.backfill(_cross(s, d), B._dev_history(s, d), spare, 20)


def protect_prefix(s, d):
    return U.protected(_fused(s, d), _cross(s, d), 3, 20)


def ltr_rank_feats(s, d):
    return E.ltr_rank_features(_fused(s, d), lists(s, d), list(CAPS))


def _rank_only(version):
    def run(s, d):
        every = lists(s, d)
        return E.rank_only(_fused(s, d), every.where("source = 'cross'"), every, {"continuity": 40, "artist": 40}, version)

    return run


rank_only_v1, rank_only_v2 = _rank_only(1), _rank_only(2)


def ltr_lexical(s, d):
    """Catalog queries against the items of their brand."""
    q = _queries(s, d)
    pool = q.select("q", F.substring_index("q", "/", 1).alias("artist")).join(items(s, d).select("item_id", "artist"), "artist")
    return E.lexical(pool, q, items(s, d), ["q"])


def ltr_history(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))
    return E.history_features(_fused(s, d), B._dev_history(s, d), items(s, d), e)


def _wide(s, d):
    c = _candidates(s, d).join(items(s, d).select("item_id", "popularity"), "item_id")
    return c.select(*K.TASK, "item_id", (1.0 / F.col("rank")).alias("a"), F.col("popularity").alias("b"))


def group_zscore(s, d):
    return E.zscores(_wide(s, d), ["a", "b"])


def blend(s, d):
    b = E.blend(E.zscores(_wide(s, d), ["a", "b"], digits=9), {"a": 0.7, "b": 0.3})
    return K.scored_top(b.select(*K.TASK, "item_id", "score"), 20)


def ndcg_multi(s, d):
    """Labels are all items of the played item's artist."""
    it = items(s, d).select("item_id", "artist")
    t = _labels(s, d).join(it.withColumnRenamed("item_id", "label"), "label").select(*K.TASK, "artist").join(it, "artist")
    labels = t.select(*K.TASK, F.col("item_id").alias("label"))
    return M.ndcg_multi(_fused(s, d), labels)


def ndcg_single(s, d):
    return M.ndcg_single(_fused(s, d), _labels(s, d))


def ndcg_zero_fill(s, d):
    return M.ndcg_zero_fill(_fused(s, d), _labels(s, d))


def pool_recall_oracle(s, d):
    return M.pool_report(U.rrf(lists(s, d), None), _labels(s, d), [20, 50, 100])


def hit_recall(s, d):
    return M.hit_recall(_fused(s, d), _labels(s, d), [1, 5, 20, 50, 100], 50)


def by_turn(s, d):
    return M.ndcg_single(_cross(s, d), _labels(s, d), by=["turn_number"])


def source_overlap(s, d):
    return M.base_recovery(_cross(s, d), B._continuity("album_artist")(s, d), _labels(s, d), 50)


def change_stats(s, d):
    return M.change_stats(U.rrf(lists(s, d), 20), protect_prefix(s, d))


def catalog_diversity(s, d):
    return M.catalog_diversity(U.rrf(lists(s, d), 20), items(s, d))


def validator(s, d):
    """Cross-session lists as they are, and what is wrong with them as submissions of 20."""
    p = _cross(s, d).where("rank <= 20")
    return M.violations(p, items(s, d).where("popularity > 20"), dev_tasks(s, d).select(*K.TASK), 20)


def correlations(s, d):
    o = table(s, d, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_tax", F.col("l_linenumber").alias("line"))
    return M.correlations(o, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "line"])


def composite(s, d):
    """Runs are months: stand-ins for the four measures come from their orders."""
    return M.decomposition(_runs(s, d))


def _runs(s, d):
    o = table(s, d, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run")).agg(
        F.round(F.avg("o_totalprice") / 1e6, 6).alias("ndcg"),
        F.round(F.countDistinct("o_custkey") / F.lit(1e4), 6).alias("catalog"),
        F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("lexical"),
        F.round(1 + F.count("*") / F.lit(1e3), 6).alias("judge"),
    )


def resubmissions(s, d):
    """Customers as artifacts and their segments as digests, judged by the priority of their orders."""
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    at = F.struct("o_orderdate", "o_orderkey")
    return M.resubmissions(o.select(F.col("c_custkey").alias("artifact"), F.concat_ws("|", "c_mktsegment", "c_nationkey").alias("digest"), at.alias("at"), F.substring("o_orderpriority", 1, 1).alias("judge")))


def blind_probe(s, d):
    """Per first turn, how often the label is first, and what hidden tasks must score for a mean of a half."""
    h = M.hits(_cross(s, d), _labels(s, d))
    v = h.agg(F.count("*").alias("total"), F.count(F.when(F.col("turn_number") <= 3, 1)).alias("visible"), F.sum(F.when((F.col("turn_number") <= 3) & (F.col("rank") <= 20), M.gain(F.col("rank"))).otherwise(0.0)).alias("v"))
    hidden = F.col("total") - F.col("visible")
    return v.select("total", "visible", F.round("v", 6).alias("visible_sum"), F.round(M.mixture(F.col("v"), hidden, F.lit(0.25), F.col("total")), 6).alias("mixture"), F.round(M.required(F.col("v"), hidden, F.lit(0.5), F.col("total")), 6).alias("required"))


def chat_batch(s, d):
    """End to end for the tasks to evaluate: sources, fusion, exclusion, padding to 20 and a response about the first item."""
    fused = U.ordered_union(U.lists({"fused": _fused(s, d)}), B._dev_history(s, d))
    full = K.padded(fused.where("rank <= 20"), dev_tasks(s, d), K.popular(items(s, d), 60), 20)
    it = items(s, d).select("item_id", X.fallback_response(F.col("name"), F.col("artist")).alias("response"))
    firsts = full.where("rank = 1").join(it, "item_id").select(*K.TASK, "response")
    return full.groupBy(*K.TASK).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x.item_id.cast("string")), ",").alias("items"), F.sum(F.col("is_pad").cast("long")).alias("n_pad")).join(firsts, K.TASK)


def dialogue_entities(s, d):
    """Entities in dialogues: phrases of user texts that are titles, by the dialogue's tasks."""
    t = T.tasks(messages(s, d).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content")))
    words = t.select("session_id", "seq", F.explode(X.phrases(F.col("query"))).alias("phrase"))
    titles = table(s, d, "documents").select(F.col("doc_id").alias("item_id"), X.normalize_text(F.substring_index("text", ".", 1)).alias("phrase")).where("phrase <> ''")
    return words.join(titles, "phrase").groupBy("session_id", "seq", "phrase").agg(F.count("*").alias("documents"), F.min("item_id").alias("first_id"))


_LISTS = f"""s0 AS MATERIALIZED ({B.SQL["continuity_album_artist"]}), s1 AS MATERIALIZED ({B.SQL["cross_session"]}), s2 AS MATERIALIZED ({B.SQL["history_same_artist"]}),
 ranked AS MATERIALIZED (SELECT {_KEY}, 'continuity' AS source, 0 AS source_order, item_id, rank FROM s0 WHERE rank <= 40 UNION ALL SELECT {_KEY}, 'cross', 1, item_id, rank FROM s1 WHERE rank <= 30 UNION ALL SELECT {_KEY}, 'artist', 2, item_id, rank FROM s2 WHERE rank <= 40)"""


def _rrf(source: str = "ranked", k: int | None = None) -> str:
    return f"""SELECT {_KEY}, item_id, CAST(row_number() OVER (PARTITION BY {_KEY} ORDER BY score DESC, n_sources DESC, best_rank, first_source, item_id) AS INT) AS rank, score, n_sources, best_rank, first_source FROM (
      SELECT {_KEY}, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, count(*) AS n_sources, min(rank) AS best_rank, min(source_order) AS first_source FROM {source} GROUP BY {_KEY}, item_id)""" + (f" QUALIFY rank <= {k}" if k else "")


_BASE = f"WITH {ITEMS}, {VALUES}, {PLAYS}, {TASKS}, {HISTORY}, {_LISTS}, fused AS MATERIALIZED ({_rrf(k=50)}), cand AS MATERIALIZED (SELECT {_KEY}, item_id, rank, score, (item_id = label)::INT AS label FROM fused JOIN tasks USING (session_id, turn_number))"
_HITS = "hits AS (SELECT t.session_id, t.turn_number, t.label, p.rank FROM tasks t LEFT JOIN {0} p ON p.session_id = t.session_id AND p.turn_number = t.turn_number AND p.item_id = t.label)"
_G = "CASE WHEN rank <= 20 THEN 1 / log2(rank + 1) ELSE 0 END"
_INV = "CASE WHEN {0} IS NOT NULL THEN round(1.0::DOUBLE / {0}, 6) ELSE 0 END"
_RO = f"""{_BASE}, w AS (SELECT f.session_id, f.turn_number, f.item_id, p.rank AS p, c.rank AS c, a.rank AS a FROM fused f LEFT JOIN (SELECT * FROM ranked WHERE source = 'cross') p USING (session_id, turn_number, item_id)
  LEFT JOIN (SELECT * FROM ranked WHERE source = 'continuity') c USING (session_id, turn_number, item_id) LEFT JOIN (SELECT * FROM ranked WHERE source = 'artist') a USING (session_id, turn_number, item_id))"""


def _rank_only_sql(version: int) -> str:
    out = [f"{_INV.format('p')} AS primary_inv_rank", "coalesce(p = 1, false)::INT::DOUBLE AS primary_is_top1", *(f"coalesce(p <= {n}, false)::INT::DOUBLE AS primary_in_top{n}" for n in (5, 10, 20))]
    for s, r in (("continuity", "c"), ("artist", "a")):
        out += [f"{_INV.format(r)} AS {s}_inv_rank", f"coalesce({r} <= 5, false)::INT::DOUBLE AS {s}_in_top5", f"coalesce({r} <= 20, false)::INT::DOUBLE AS {s}_in_top20", f"least(coalesce({r}, 9999), 41)::DOUBLE AS {s}_rank_clipped"]
        out += [f"round(least(coalesce({r}, 9999), 41)::DOUBLE / 41, 6) AS {s}_rank_pct"] if version == 2 else []
    hits = "((c IS NOT NULL)::INT + (a IS NOT NULL)::INT)::DOUBLE"
    out.append(f"round({hits} / 2, 6) AS source_hit_rate")
    out += [f"{hits} AS source_hit_count"] if version == 2 else []
    rrf = lambda k: f"round(coalesce(1.0::DOUBLE / ({k} + c), 0) + coalesce(1.0::DOUBLE / ({k} + a), 0), 6) AS source_rrf_sum_k{k}"
    out += [f"{_INV.format('least(c, a)')} AS source_best_inv_rank", rrf(60)]
    out += [rrf(200)] if version == 2 else []
    out += ["turn_number::DOUBLE AS f_turn", "(turn_number <= 2)::INT::DOUBLE AS is_early_turn", "(turn_number >= 3)::INT::DOUBLE AS is_followup_turn"]
    return f"{_RO} SELECT {_KEY}, item_id, {', '.join(out)} FROM w"


def _ltr_sql() -> str:
    r = {"continuity": "c", "cross": "p", "artist": "a"}
    out = ["f.rank::DOUBLE AS f_candidate_rank", "round(1 / log2(f.rank + 1), 6) AS f_rank_discount"]
    for s, c in r.items():
        out += [f"({c} IS NOT NULL)::INT::DOUBLE AS f_{s}_hit", f"{c}::DOUBLE AS f_{s}_rank", f"round(coalesce(1.0::DOUBLE / (60 + {c}), 0), 6) AS f_{s}_rrf"]
    out += [f"round({' + '.join(f'coalesce(1.0::DOUBLE / (60 + {c}), 0)' for c in r.values())}, 6) AS f_rrf_score", "least(c, p, a)::DOUBLE AS f_best_source_rank", f"({' + '.join(f'({c} IS NOT NULL)::INT' for c in r.values())})::DOUBLE AS f_source_hit_count"]
    return f"{_RO} SELECT session_id, turn_number, item_id, {', '.join(out)} FROM w JOIN fused f USING (session_id, turn_number, item_id)"


_SHARED = lambda a, b: f"len(list_intersect(list_distinct(list_filter(string_split({a}, ' '), lambda t: t <> '')), string_split({b}, ' ')))::DOUBLE"
_Z = "CASE WHEN count(*) OVER w <= 1 OR stddev_pop({0}) OVER w <= 1e-12 THEN 0 ELSE ({0} - avg({0}) OVER w) / stddev_pop({0}) OVER w END"
_WIDE = f"{_BASE}, wide AS (SELECT {_KEY}, item_id, 1.0::DOUBLE / rank AS a, popularity AS b FROM cand JOIN items USING (item_id))"
_COS = "list_dot_product({0}, {1})"
_UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))"
_RUNS = "runs AS (SELECT strftime(o_orderdate, '%Y-%m') AS run, round(avg(o_totalprice) / 1e6, 6) AS ndcg, round(count(DISTINCT o_custkey) / 1e4, 6) AS catalog, round(avg((o_orderstatus = 'F')::INT), 6) AS lexical, round(1 + count(*) / 1e3, 6) AS judge FROM orders GROUP BY 1)"
_PROTECT = f"SELECT * FROM (SELECT {_KEY}, item_id, CAST(row_number() OVER (PARTITION BY {_KEY} ORDER BY CASE WHEN pr <= 3 THEN pr ELSE 4 END, score DESC, pr, item_id) AS INT) AS rank, pr AS primary_rank FROM (SELECT f.session_id, f.turn_number, f.item_id, f.score, coalesce(c.rank, 9999) AS pr FROM fused f LEFT JOIN s1 c USING (session_id, turn_number, item_id))) WHERE rank <= 20"
_QUOTA = f"""{_BASE}, g1 AS (SELECT {_KEY}, item_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY rank) AS r FROM ({_rrf("(SELECT * FROM ranked WHERE source IN ('continuity', 'artist'))", 45)}) QUALIFY r <= 15),
  g2 AS (SELECT {_KEY}, item_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY rank) AS r FROM ({_rrf("(SELECT * FROM ranked WHERE source = 'cross')", 24)}) x ANTI JOIN g1 USING (session_id, turn_number, item_id) QUALIFY r <= 8),
  tk AS (SELECT *, 0 AS g FROM g1 UNION ALL SELECT *, 1 FROM g2),
  al AS (SELECT * FROM tk UNION ALL SELECT {_KEY}, item_id, rank, 2 FROM ({_rrf(k=80)}) x ANTI JOIN tk USING (session_id, turn_number, item_id))
  SELECT {_KEY}, item_id, CAST(row_number() OVER (PARTITION BY {_KEY} ORDER BY g, r) AS INT) AS rank FROM al QUALIFY rank <= 40"""
_CORR = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM (SELECT {e}::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem))"
    for c, e in (("l_quantity", "l_quantity"), ("l_discount", "l_discount"), ("l_tax", "l_tax"), ("line", "l_linenumber"))
)
_GONE = "NOT EXISTS (SELECT 1 FROM history h WHERE h.session_id = x.session_id AND h.turn_number = x.turn_number AND h.item_id = x.item_id)"
SQL = {
    "rrf_union": f"{_BASE} SELECT * FROM fused",
    "quota_union": _QUOTA,
    "ordered_union_excl": f"""{_BASE}, pl AS (SELECT {_KEY}, item_id, min(ROW(source_order, rank)) AS place FROM ranked GROUP BY ALL)
      SELECT x.session_id, x.turn_number, x.item_id, CAST(row_number() OVER (PARTITION BY x.session_id, x.turn_number ORDER BY place, x.item_id) AS INT) AS rank FROM pl x JOIN tasks t USING (session_id, turn_number) WHERE x.item_id = t.label OR {_GONE}""",
    "neg_sampling": f"""{_BASE}, n AS (SELECT *, count(*) OVER (PARTITION BY {_KEY}) AS n, sum(label) OVER (PARTITION BY {_KEY}) AS pos FROM cand), ng AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY rank) AS nth, greatest(0, least(8, 20 - pos)) AS room FROM n WHERE label = 0),
      tl AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY sha256(concat_ws(':', 's7', session_id, turn_number, item_id)), item_id) AS draw FROM ng WHERE n > 20 AND nth > room)
      SELECT {_KEY}, item_id, rank, label FROM n WHERE label = 1 UNION ALL SELECT {_KEY}, item_id, rank, label FROM ng WHERE n <= 20 OR nth <= room UNION ALL SELECT {_KEY}, item_id, rank, label FROM tl WHERE draw <= 20 - pos - room""",
    "require_positive": f"{_BASE} SELECT {_KEY}, item_id, rank, label FROM cand SEMI JOIN (SELECT session_id, turn_number FROM cand WHERE label = 1) USING (session_id, turn_number)",
    "backfill20": f"""{_BASE}, {POPULAR}, b AS (SELECT {_KEY}, item_id, 0 AS g, rank AS r FROM s1 UNION ALL SELECT session_id, turn_number, item_id, 1, pop_rank FROM tasks, pop WHERE pop_rank <= 60),
      x AS (SELECT {_KEY}, item_id, min(ROW(g, r)) AS place, min(g) AS g FROM b GROUP BY ALL)
      SELECT {_KEY}, item_id, CAST(row_number() OVER (PARTITION BY {_KEY} ORDER BY place, item_id) AS INT) AS rank, g = 1 AS filled FROM x WHERE {_GONE} QUALIFY rank <= 20""",
    "protect_prefix": f"{_BASE} {_PROTECT}",
    "ltr_rank_feats": _ltr_sql(),
    "rank_only_v1": _rank_only_sql(1),
    "rank_only_v2": _rank_only_sql(2),
    "ltr_lexical": f"""WITH {ITEMS}, {_Q}, j AS (SELECT q, i.*, {NORM.format("text")} AS t, {NORM.format("name")} AS n, {NORM.format("artist")} AS ar, {NORM.format("album")} AS al, array_to_string(list_filter(list_transform(tags, lambda x: {NORM.format("x")}), lambda x: x <> ''), ' ') AS tg FROM qs JOIN items i ON i.artist = split_part(q, '/', 1))
      SELECT q, item_id, {", ".join(f"(contains(' ' || t || ' ', ' ' || {c} || ' '))::INT::DOUBLE AS f_{f}_match, {_SHARED(c, 't')} AS f_{f}_overlap" for f, c in (("name", "n"), ("artist", "ar"), ("album", "al")))},
      {_SHARED("tg", "t")} AS f_tag_overlap, len(tags)::DOUBLE AS f_tag_count, popularity AS f_popularity, ((length(name) > 0)::INT + (length(artist) > 0)::INT + (length(album) > 0)::INT)::DOUBLE AS f_field_count FROM j""",
    "ltr_history": f"""{_BASE}, em AS (SELECT vec_id AS item_id, {_UNIT} AS v FROM embeddings), c AS (SELECT {_KEY}, item_id, artist, tags, v FROM fused JOIN items USING (item_id) LEFT JOIN em USING (item_id)),
      h AS (SELECT session_id, turn_number, artist AS ha, tags AS ht, v AS hv FROM history JOIN items USING (item_id) LEFT JOIN em USING (item_id))
      SELECT c.session_id, c.turn_number, c.item_id, coalesce(sum((artist = ha)::INT), 0)::DOUBLE AS f_same_artist, coalesce(sum(len(list_intersect(list_distinct(tags), ht))), 0)::DOUBLE AS f_same_tags, count(ha)::DOUBLE AS f_history,
      round(coalesce(avg(greatest({_COS.format("v", "hv")}, 0)) FILTER (WHERE v IS NOT NULL AND hv IS NOT NULL), 0), 6) AS f_mean_cosine, round(coalesce(max(greatest({_COS.format("v", "hv")}, 0)) FILTER (WHERE v IS NOT NULL AND hv IS NOT NULL), 0), 6) AS f_max_cosine FROM c LEFT JOIN h USING (session_id, turn_number) GROUP BY ALL""",
    "group_zscore": f"{_WIDE} SELECT {_KEY}, item_id, round({_Z.format('a')}, 6) AS a, round({_Z.format('b')}, 6) AS b FROM wide WINDOW w AS (PARTITION BY {_KEY})",
    "blend": f"{_WIDE}, z AS (SELECT {_KEY}, item_id, round({_Z.format('a')}, 9) AS a, round({_Z.format('b')}, 9) AS b FROM wide WINDOW w AS (PARTITION BY {_KEY})), sc AS (SELECT {_KEY}, item_id, round(a * 0.7::DOUBLE + b * 0.3::DOUBLE, 6) AS score FROM z) SELECT {_KEY}, item_id, CAST(row_number() OVER (PARTITION BY {_KEY} ORDER BY score DESC, item_id) AS INT) AS rank, score FROM sc QUALIFY rank <= 20",
    "ndcg_multi": f"""{_BASE}, lb AS (SELECT DISTINCT t.session_id, t.turn_number, b.item_id AS label FROM tasks t JOIN items a ON a.item_id = t.label JOIN items b ON b.artist = a.artist),
      per AS (SELECT lb.session_id, lb.turn_number, sum({_G}) AS dcg, count(*) AS n FROM lb LEFT JOIN fused f ON f.session_id = lb.session_id AND f.turn_number = lb.turn_number AND f.item_id = lb.label GROUP BY ALL)
      SELECT count(*) AS tasks, round(avg(dcg / list_sum(list_transform(range(1, least(n, 20) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg FROM per""",
    "ndcg_single": f"{_BASE}, {_HITS.format('fused')} SELECT count(*) AS tasks, round(avg({_G}), 6) AS ndcg FROM hits",
    "ndcg_zero_fill": f"{_BASE}, {_HITS.format('fused')} SELECT count(*) AS tasks, count(rank) AS positive, round(avg({_G}) FILTER (WHERE rank IS NOT NULL), 6) AS positive_mean, round(sum({_G}) / count(*), 6) AS zero_fill FROM hits",
    "pool_recall_oracle": f"""{_BASE}, whole AS MATERIALIZED ({_rrf()}), {_HITS.format("whole")}, sz AS (SELECT t.session_id, t.turn_number, count(w.item_id) AS n FROM tasks t LEFT JOIN whole w USING (session_id, turn_number) GROUP BY ALL)
      SELECT * FROM (SELECT round(avg(n), 6) AS mean_size, quantile_cont(n, 0.5)::DOUBLE AS p50, quantile_cont(n, 0.95)::DOUBLE AS p95, quantile_cont(n, 0.99)::DOUBLE AS p99, max(n) AS max_size FROM sz), (SELECT round(avg((rank IS NOT NULL)::INT), 6) AS oracle, round(avg(coalesce(rank <= 20, false)::INT), 6) AS recall_20, round(avg(coalesce(rank <= 50, false)::INT), 6) AS recall_50, round(avg(coalesce(rank <= 100, false)::INT), 6) AS recall_100 FROM hits)""",
    "hit_recall": f"{_BASE}, {_HITS.format('fused')} SELECT k::INT AS k, CASE WHEN k <= 50 THEN count(*) FILTER (WHERE rank <= k) END AS hits, CASE WHEN k <= 50 THEN round(count(*) FILTER (WHERE rank <= k) / count(*), 6) END AS recall FROM hits, (SELECT unnest([1, 5, 20, 50, 100]) AS k) GROUP BY k",
    "by_turn": f"{_BASE}, {_HITS.format('s1')} SELECT turn_number, count(*) AS tasks, round(avg({_G}), 6) AS ndcg FROM hits GROUP BY 1",
    "source_overlap": f"{_BASE}, {_HITS.format('s1')}, hb AS (SELECT t.session_id, t.turn_number, p.rank FROM tasks t LEFT JOIN s0 p ON p.session_id = t.session_id AND p.turn_number = t.turn_number AND p.item_id = t.label) SELECT CASE WHEN x AND y THEN 'both' WHEN x THEN 'source_only' WHEN y THEN 'base_only' ELSE 'neither' END AS who, count(*) AS tasks FROM (SELECT coalesce(a.rank <= 50, false) AS x, coalesce(b.rank <= 50, false) AS y FROM hits a JOIN hb b USING (session_id, turn_number)) GROUP BY 1",
    "change_stats": f"""{_BASE}, a AS (SELECT {_KEY}, item_id, rank AS ra FROM fused WHERE rank <= 20), b AS (SELECT {_KEY}, item_id, rank AS rb FROM ({_PROTECT})), per AS (SELECT {_KEY}, max((ra IS DISTINCT FROM rb)::INT) AS c, max(((coalesce(ra, 0) = 1) <> (coalesce(rb, 0) = 1))::INT) AS f, sum((ra IS NOT NULL AND rb IS NOT NULL)::INT) AS o FROM a FULL JOIN b USING (session_id, turn_number, item_id) GROUP BY ALL)
      SELECT count(*) AS tasks, sum(c)::BIGINT AS changed, sum(f)::BIGINT AS first_changed, round(avg(o), 6) AS mean_overlap FROM per""",
    "catalog_diversity": f"{_BASE} SELECT (SELECT count(DISTINCT item_id) FROM fused WHERE rank <= 20) AS seen, (SELECT count(*) FROM items) AS catalog, round((SELECT count(DISTINCT item_id) FROM fused WHERE rank <= 20) / (SELECT count(*) FROM items), 6) AS diversity",
    "validator": f"""{_BASE}, p AS (SELECT * FROM s1 WHERE rank <= 20), per AS (SELECT {_KEY}, count(*) AS n, max(rank) AS last FROM p GROUP BY ALL)
      SELECT {_KEY}, 'missing' AS violation FROM tasks ANTI JOIN per USING (session_id, turn_number) UNION ALL SELECT {_KEY}, 'length' FROM per WHERE n <> 20 UNION ALL SELECT DISTINCT {_KEY}, 'not in catalog' FROM p JOIN items USING (item_id) WHERE popularity <= 20""",
    "correlations": _CORR,
    "composite": f"WITH {_RUNS}, c AS (SELECT *, 0.5 * ndcg + 0.1 * catalog + 0.1 * lexical + 0.3 * (judge - 1) / 4 AS composite FROM runs), b AS (SELECT * FROM c ORDER BY run LIMIT 1) SELECT c.run, round(c.composite, 7) AS composite, {', '.join(f'round((c.{x} - b.{x}) * {w}::DOUBLE, 7) AS d_{x}' for x, w in (('ndcg', 0.5), ('catalog', 0.1), ('lexical', 0.1), ('judge', 0.075)))}, round((c.composite - b.composite) / 0.5, 7) AS ndcg_equivalent FROM c, b",
    "resubmissions": "WITH l AS (SELECT c_custkey, concat_ws('|', c_mktsegment, c_nationkey) AS digest, max_by(left(o_orderpriority, 1), ROW(o_orderdate, o_orderkey)) AS judge FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) SELECT digest, count(*) AS runs, count(DISTINCT judge) AS judges, min(judge) AS least, max(judge) AS most FROM l GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT judge) >= 2",
    "blind_probe": f"{_BASE}, {_HITS.format('s1')}, v AS (SELECT count(*) AS total, count(*) FILTER (WHERE turn_number <= 3) AS visible, sum(CASE WHEN turn_number <= 3 AND rank <= 20 THEN 1 / log2(rank + 1) ELSE 0 END) AS v FROM hits) SELECT total, visible, round(v, 6) AS visible_sum, round((v + (total - visible) * 0.25::DOUBLE) / total, 6) AS mixture, round((0.5::DOUBLE * total - v) / (total - visible), 6) AS required FROM v",
    "chat_batch": f"""{_BASE}, {POPULAR}, x AS (SELECT * FROM fused), kept AS (SELECT {_KEY}, item_id, r AS rank FROM (SELECT {_KEY}, item_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY rank) AS r FROM x WHERE {_GONE}) WHERE r <= 20),
      al AS (SELECT {_KEY}, item_id, rank, 0 AS pad FROM kept UNION ALL SELECT session_id, turn_number, item_id, pop_rank, 1 FROM (SELECT session_id, turn_number, item_id, pop_rank FROM tasks, pop WHERE pop_rank <= 60) ANTI JOIN kept USING (session_id, turn_number, item_id)),
      f AS (SELECT {_KEY}, item_id, pad, r AS rank FROM (SELECT {_KEY}, item_id, pad, row_number() OVER (PARTITION BY {_KEY} ORDER BY pad, rank, item_id) AS r FROM al) WHERE r <= 20)
      SELECT f.session_id, f.turn_number, string_agg(f.item_id::VARCHAR, ',' ORDER BY rank) AS items, sum(pad)::BIGINT AS n_pad, max(CASE WHEN rank = 1 THEN 'I think you''ll really enjoy "' || name || '" by ' || artist || ' — it lines up well with what you''re looking for. Want a few more in a similar vein?' END) AS response FROM f JOIN items i ON i.item_id = f.item_id GROUP BY ALL""",
    "dialogue_entities": f"""WITH w AS (SELECT conv_id AS session_id, turn AS seq, list_filter(string_split({NORM.format("text")}, ' '), lambda t: t <> '') AS w FROM conversations WHERE role = 'user' AND trim(text) <> ''),
      ph AS (SELECT DISTINCT session_id, seq, phrase FROM ({" UNION ALL ".join(f"SELECT session_id, seq, unnest({B._grams('w', n)}) AS phrase FROM w" for n in range(1, 9))}) WHERE length(phrase) >= 3),
      ti AS (SELECT doc_id, {NORM.format("split_part(text, '.', 1)")} AS phrase FROM documents) SELECT session_id, seq, phrase, count(*) AS documents, min(doc_id) AS first_id FROM ph JOIN ti USING (phrase) WHERE phrase <> '' GROUP BY ALL""",
}
QUERIES = {n: globals()[n] for n in SQL}
