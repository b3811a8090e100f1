"""Queries on behavioural candidate sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieval as R
from ..operators import sources as S
from .retrieval import _Q, _bm25, _queries
from .texts import _CT, _grams
from .views import HISTORY, ITEMS, NORM, PLAYS, TASKS, VALUES, dev_tasks, history, items, plays, table, values


def _base(s, d):
    v = values(items(s, d))
    return v, S.value_index(v)


def _dev_history(s, d) -> DataFrame:
    return history(dev_tasks(s, d), plays(s, d))


def segment_popularity(s, d):
    return S.segment_counts(_profiled(s, d), values(items(s, d)), _segments())


def _profiled(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment", "c_nationkey")
    return plays(s, d).where("train").join(c, "user_id", "left")


def _segments():
    return {"global": F.lit("all"), "segment": F.col("c_mktsegment"), "segment_nation": F.concat_ws("|", "c_mktsegment", "c_nationkey")}


def by_artist(s, d):
    """The most played items of each query's artists."""
    v, _ = _base(s, d)
    counts = _item_counts(s, d, v)
    asked = S.contained_values(_queries(s, d), v.where("field = 1"), ["q"])
    merged = asked.join(counts.where("field = 1"), ["field", "value"]).groupBy("q", "item_id").agg(F.sum("n").cast("double").alias("score"))
    return S.scored_top(merged, 50, ["q"])


def _item_counts(s, d, v):
    n = plays(s, d).where("train").groupBy("item_id").agg(F.count("*").alias("n"))
    return v.select("field", "value", "item_id").join(n, "item_id")


def by_tag(s, d):
    v, _ = _base(s, d)
    asked = S.contained_values(_queries(s, d), v.where("field = 3"), ["q"])
    merged = asked.join(_item_counts(s, d, v).where("field = 3"), ["field", "value"]).groupBy("q", "item_id").agg(F.sum("n").cast("double").alias("score"))
    return S.scored_top(merged, 50, ["q"])


def by_user_ladder(s, d):
    """Segment by nation, then segment, then all: for every customer with a task, and for one no table knows."""
    counts = segment_popularity(s, d)
    c = table(s, d, "customer")
    known = c.select(F.col("c_custkey").alias("user_id"), F.concat_ws("|", "c_mktsegment", "c_nationkey").alias("segment_nation"), F.col("c_mktsegment").alias("segment"))
    users = dev_tasks(s, d).select("user_id").distinct().unionAll(c.limit(1).select(F.lit(-1).cast("long").alias("user_id")))
    return S.ladder(users.join(known, "user_id", "left").withColumn("global", F.lit("all")), counts, ["segment_nation", "segment", "global"], 50, ["user_id"])


def substring_values(s, d):
    return S.contained_values(_queries(s, d), values(items(s, d)), ["q"])


def history_same_artist(s, d):
    v, i = _base(s, d)
    return S.history_same(_dev_history(s, d), v, i, 1, 100)


def history_same_tag(s, d):
    v, i = _base(s, d)
    return S.history_same(_dev_history(s, d), v, i, 3, 100)


def _continuity(variant: str):
    def run(s, d):
        v, i = _base(s, d)
        return S.continuity(_dev_history(s, d), v, i, variant, 100)

    return run


def _entity(variant: str):
    def run(s, d):
        """Catalog queries; the recent variants also see the query of the brand's type before."""
        v, i = _base(s, d)
        q = _queries(s, d)
        back = S.ENTITY[variant][2]
        if back:
            from pyspark.sql import Window

            w = Window.partitionBy(F.substring_index("q", "/", 1)).orderBy("q").rowsBetween(-back, 0)
            q = q.withColumn("texts", F.collect_list("text").over(w)).select("q", F.explode("texts").alias("text"))
        return S.entities(q, v, i, variant, 100, ["q"])

    return run


def _train(s, d):
    p = plays(s, d).where("train")
    t = p.select("session_id", "turn_number", F.col("item_id").alias("label"))
    return history(t, p), t


def _transition(variant: str):
    def run(s, d):
        v, i = _base(s, d)
        h, labels = _train(s, d)
        return S.transition(_dev_history(s, d), v, S.transition_index(h, labels, v, i, variant), variant, 100)

    return run


def cross_session(s, d):
    return S.cross_session(dev_tasks(s, d), plays(s, d))


def label_expansion(s, d):
    v, i = _base(s, d)
    labels = plays(s, d).where("train").select(F.col("item_id").alias("label"))
    e = S.label_expansion(labels, v, i, 1.0, 0.45, 0.12 * 0.25, 120, 24)
    return e.select("label", "item_id", F.round("weight", 6).alias("weight"))


def _labelled_queries(s, d):
    """Training queries: every part's name and type, with the part as its label."""
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("neighbor"), F.concat_ws(" ", "p_name", "p_type").alias("text")), p.select(F.col("p_partkey").alias("neighbor"), F.col("p_partkey").alias("label"))


def neighbor_memory(s, d):
    v, i = _base(s, d)
    texts, labels = _labelled_queries(s, d)
    found = R.Bm25(texts, "neighbor", F.col("text")).top(_queries(s, d), ["q"], F.col("text"), 240).withColumnRenamed("item_id", "neighbor")
    return S.neighbor_memory(found, labels, v, i, 100, ["q"])


def label_memory(s, d):
    v, i = _base(s, d)
    texts, labels = _labelled_queries(s, d)
    grams = texts.select("neighbor", F.inline(X.weighted_ngrams(F.col("text")))).select("neighbor", "ngram")
    memory = S.label_memory_index(grams, labels, ["neighbor"], v, i)
    asked = _queries(s, d).select("q", F.inline(X.weighted_ngrams(F.col("text"))))
    return S.label_memory(asked, memory, v.groupBy("item_id").agg(F.max("popularity").alias("popularity")), 100, ["q"])


VI = "vi AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY field, value ORDER BY popularity DESC, item_id) AS pop_rank FROM (SELECT DISTINCT * FROM vals)), pops AS (SELECT item_id, max(popularity) AS popularity FROM vals GROUP BY 1)"
_B = f"WITH {ITEMS}, {VALUES}, {VI}, {PLAYS}, {TASKS}, {HISTORY}"
_KEY = "session_id, turn_number"


def _case(weights, first=0) -> str:
    return "CASE field " + " ".join(f"WHEN {k} THEN CAST({w} AS DOUBLE)" for k, w in enumerate(weights, first)) + " ELSE 0 END"


def _within(caps, first=1) -> str:
    return "(" + " OR ".join(f"(field = {k} AND pop_rank <= {c})" for k, c in enumerate(caps, first) if c) + ")"


def _top(scored: str, keys: str, k: int, pop: bool = True) -> str:
    """scored: a relation with keys, item_id, score."""
    tie = "coalesce(popularity, 0) DESC, " if pop else ""
    return f"SELECT {keys}, item_id, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, {tie}item_id) AS INT) AS rank, score FROM (SELECT * REPLACE (round(score + 1e-9, 6) AS score) FROM ({scored})) {'LEFT JOIN pops USING (item_id)' if pop else ''} QUALIFY rank <= {k}"


def _continuity_sql(variant: str) -> str:
    weights, caps, recent = S.CONTINUITY[variant]
    when = f"AND recency <= {recent}" if recent else ""
    scored = f"""SELECT {_KEY}, v2.item_id, sum(({_case(weights, 1).replace("field", "v.field")}) / log2(recency + 1) / log2(v2.pop_rank + 2)) AS score FROM history h JOIN vals v ON v.item_id = h.item_id
      JOIN (SELECT * FROM vi WHERE {_within(caps)}) v2 ON v2.field = v.field AND v2.value = v.value WHERE true {when} GROUP BY {_KEY}, v2.item_id"""
    scored = f"SELECT * FROM ({scored}) x WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.session_id = x.session_id AND h.turn_number = x.turn_number AND h.item_id = x.item_id {when})"
    return f"{_B} {_top(scored, _KEY, 100)}"


def _entity_sql(variant: str) -> str:
    cap, tag, back = S.ENTITY[variant]
    texts = "SELECT q, text FROM qs" if not back else f"SELECT a.q, b.text FROM (SELECT *, row_number() OVER (PARTITION BY split_part(q, '/', 1) ORDER BY q) AS n FROM qs) a JOIN (SELECT *, row_number() OVER (PARTITION BY split_part(q, '/', 1) ORDER BY q) AS n FROM qs) b ON split_part(a.q, '/', 1) = split_part(b.q, '/', 1) AND b.n BETWEEN a.n - {back} AND a.n"
    grams = " UNION ALL ".join(f"SELECT q, unnest({_grams('w', n)}) AS value FROM w" for n in range(1, 9))
    scored = f"SELECT q, item_id, sum({_case(S.ENTITY_WEIGHTS)} / log2(pop_rank + 2)) AS score FROM ph JOIN vi USING (value) WHERE length(value) >= 3 AND {_within((cap, cap, cap, tag), 0)} GROUP BY q, item_id"
    return f"WITH {ITEMS}, {VALUES}, {VI}, {_Q}, w AS (SELECT q, string_split({NORM.format('text')}, ' ') AS w FROM ({texts})), ph AS (SELECT DISTINCT q, value FROM ({grams})) {_top(scored, 'q', 100)}"


def _expand(direct, artist, tag, artist_top, tag_top) -> str:
    return f"""ex AS MATERIALIZED (SELECT label, item_id, sum(w) AS weight FROM (SELECT label, label AS item_id, CAST({direct} AS DOUBLE) AS w FROM labels UNION ALL
      SELECT label, vi.item_id, CASE vi.field WHEN 1 THEN CAST({artist} AS DOUBLE) ELSE CAST({tag} AS DOUBLE) END / log2(vi.pop_rank + 2) FROM labels JOIN vals v ON v.item_id = label AND v.field IN (1, 3) JOIN vi ON vi.field = v.field AND vi.value = v.value WHERE (vi.field = 1 AND vi.pop_rank <= {artist_top}) OR (vi.field = 3 AND vi.pop_rank <= {tag_top})) GROUP BY ALL)"""


def _transition_sql(variant: str) -> str:
    recent, kw, lw = S.TRANSITION[variant]
    when = f"WHERE recency <= {recent}" if recent else ""
    keyed = "SELECT {0}session_id, turn_number, 0 AS field, CAST(item_id AS VARCHAR) AS key, recency FROM {1} UNION ALL SELECT {0}session_id, turn_number, v.field, v.value, recency FROM {1} JOIN vals v USING (item_id) WHERE v.field >= 1"
    return f"""{_B}, th AS (SELECT a.session_id, a.turn_number, a.item_id AS label, b.item_id, a.turn_number - b.turn_number AS recency FROM plays a JOIN plays b ON a.session_id = b.session_id AND b.turn_number < a.turn_number WHERE a.train),
      labels AS (SELECT DISTINCT item_id AS label FROM plays WHERE train), {_expand(*lw, 80, 16)},
      led AS (SELECT field, key, label, sum({_case(kw)} / log2(recency + 1)) AS w FROM ({keyed.format("label, ", "th")}) {when} GROUP BY ALL HAVING w > 0),
      po AS MATERIALIZED (SELECT * FROM (SELECT field, key, item_id, sum(w * weight) AS weight FROM led JOIN ex USING (label) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY field, key ORDER BY round(weight, 6) DESC, item_id) <= 220),
      asked AS (SELECT session_id, turn_number, field, key, sum({_case(kw)} / log2(recency + 1)) AS kw FROM ({keyed.format("", "history")}) {when} GROUP BY ALL HAVING kw > 0)
      {_top(f"SELECT {_KEY}, item_id, sum(kw * weight) AS score FROM asked JOIN po USING (field, key) GROUP BY ALL", _KEY, 100)}"""


def _counts_by(field: int) -> str:
    scored = f"SELECT q, item_id, CAST(sum(n) AS DOUBLE) AS score FROM (SELECT DISTINCT q, value FROM qs, vals WHERE field = {field} AND contains({NORM.format('text')}, value)) JOIN (SELECT value, item_id, n FROM vals JOIN (SELECT item_id, count(*) AS n FROM plays WHERE train GROUP BY 1) USING (item_id) WHERE field = {field}) USING (value) GROUP BY ALL"
    return f"WITH {ITEMS}, {VALUES}, {PLAYS}, {_Q} {_top(scored, 'q', 50, False)}"


def _same_sql(field: int) -> str:
    return f"""{_B}, seen AS (SELECT session_id, turn_number, value, max(recency) AS seen FROM history JOIN vals USING (item_id) WHERE field = {field} GROUP BY ALL)
      SELECT session_id, turn_number, item_id, CAST(row_number() OVER (PARTITION BY session_id, turn_number ORDER BY place, item_id) AS INT) AS rank FROM (
        SELECT session_id, turn_number, item_id, min(ROW(-seen, value, pop_rank)) AS place FROM seen JOIN vi USING (value) WHERE field = {field} AND pop_rank <= 100 GROUP BY ALL) QUALIFY rank <= 100"""


_SEG = f"""WITH {ITEMS}, {VALUES}, {PLAYS}, pr AS (SELECT p.*, c_mktsegment, c_nationkey FROM plays p LEFT JOIN customer ON c_custkey = user_id WHERE train),
  seg AS MATERIALIZED (SELECT 'global' AS segment_type, 'all' AS segment, item_id, count(*) AS n FROM pr GROUP BY 3 UNION ALL SELECT 'segment', c_mktsegment, item_id, count(*) FROM pr WHERE c_mktsegment <> '' GROUP BY 2, 3
   UNION ALL SELECT 'segment_nation', concat_ws('|', c_mktsegment, c_nationkey), item_id, count(*) FROM pr WHERE concat_ws('|', c_mktsegment, c_nationkey) <> '' GROUP BY 2, 3
   UNION ALL SELECT CASE field WHEN 1 THEN 'artist' ELSE 'tag' END, value, item_id, n FROM vals JOIN (SELECT item_id, count(*) AS n FROM pr GROUP BY 1) USING (item_id) WHERE field IN (1, 3))"""
_LM = " UNION ALL ".join(f"SELECT id, unnest({_grams('w', n)}) AS ngram, CAST({w} AS DOUBLE) AS weight FROM ({{0}})" for n, w in X.NGRAM_WEIGHTS.items())
_NAMES = "SELECT p_partkey AS id, p_name || ' ' || p_type AS text FROM part"
_BM = _bm25("SELECT id AS item_id, text FROM (" + _NAMES + ")", "SELECT q, text FROM (SELECT concat_ws('/', p_brand, p_type) AS q, concat_ws(' by ', max(p_name), p_brand, p_type) AS text FROM part GROUP BY p_brand, p_type)", "q", 240)
SQL = {
    "segment_popularity": f"{_SEG} SELECT * FROM seg",
    "by_artist": _counts_by(1),
    "by_tag": _counts_by(3),
    "by_user_ladder": f"""{_SEG}, us AS (SELECT user_id, concat_ws('|', c_mktsegment, c_nationkey) AS sn, c_mktsegment AS sg FROM (SELECT DISTINCT user_id FROM plays WHERE NOT train AND turn_number >= 1 UNION ALL SELECT -1) LEFT JOIN customer ON c_custkey = user_id),
      lv AS (SELECT user_id, 0 AS level, 'segment_nation' AS segment_type, sn AS segment FROM us UNION ALL SELECT user_id, 1, 'segment', sg FROM us UNION ALL SELECT user_id, 2, 'global', 'all' FROM us),
      b AS (SELECT user_id, segment_type, segment FROM lv SEMI JOIN seg USING (segment_type, segment) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY level) = 1),
      l AS (SELECT segment_type, segment, item_id, CAST(row_number() OVER (PARTITION BY segment_type, segment ORDER BY n DESC, item_id) AS INT) AS rank FROM seg QUALIFY rank <= 50)
      SELECT user_id, segment_type, item_id, rank FROM b JOIN l USING (segment_type, segment)""",
    "substring_values": f"WITH {ITEMS}, {VALUES}, {_Q} SELECT DISTINCT q, field, value FROM qs, vals WHERE contains({NORM.format('text')}, value)",
    "history_same_artist": _same_sql(1),
    "history_same_tag": _same_sql(3),
    "cross_session": f"WITH {PLAYS}, {TASKS} " + _top("SELECT t.session_id, t.turn_number, p.item_id, CAST(count(DISTINCT p.session_id) AS DOUBLE) AS score FROM tasks t JOIN plays p ON p.user_id = t.user_id AND p.session_id <> t.session_id GROUP BY ALL", _KEY, 50, False),
    "label_expansion": f"WITH {ITEMS}, {VALUES}, {VI}, {PLAYS}, labels AS (SELECT DISTINCT item_id AS label FROM plays WHERE train), {_expand(1.0, 0.45, 0.12 * 0.25, 120, 24)} SELECT label, item_id, round(weight, 6) AS weight FROM ex",
    "neighbor_memory": f"WITH {ITEMS}, {VALUES}, {VI}, labels AS (SELECT p_partkey AS label FROM part), {_expand(1.0, 0.45, 0.12 * 0.25, 120, 24)}, nb AS ({_BM}) "
    + _top("SELECT q, ex.item_id, sum(ln(1 + nb.score) / log2(nb.rank + 2) * ex.weight) AS score FROM nb JOIN ex ON ex.label = nb.item_id WHERE nb.score > 0 GROUP BY ALL", "q", 100),
    "label_memory": f"""WITH {ITEMS}, {VALUES}, {VI}, {_Q}, tg AS MATERIALIZED (SELECT DISTINCT id, ngram FROM ({_LM.format(f"SELECT id, {_CT.format('text')} AS w FROM ({_NAMES})")})),
      df AS (SELECT ngram, count(*) AS df, ln(((SELECT count(DISTINCT id) FROM tg) + 1.0) / (count(*) + 1.0)) + 1 AS idf FROM tg GROUP BY 1 HAVING count(*) >= 2),
      led AS MATERIALIZED (SELECT ngram, df, idf, id AS label FROM tg JOIN df USING (ngram)),
      di AS (SELECT * FROM (SELECT ngram, idf, label AS item_id, 'direct' AS kind, CAST(count(*) AS DOUBLE) AS value FROM led GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY ngram ORDER BY value DESC, item_id) <= 200),
      ct AS (SELECT * FROM (SELECT ngram, idf, field, value AS v, count(*) AS n FROM led JOIN vals ON item_id = label WHERE df >= 10 AND field IN (1, 3) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY ngram, field ORDER BY n DESC, v) <= 200),
      ne AS (SELECT * FROM (SELECT ngram, idf, ct.field AS field, item_id, round(sum(n / log2(pop_rank + 2)), 6) AS value FROM ct JOIN vi ON vi.field = ct.field AND vi.value = ct.v WHERE (ct.field = 1 AND pop_rank <= 120) OR (ct.field = 3 AND pop_rank <= 80) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY ngram, field ORDER BY value DESC, item_id) <= 300),
      me AS (SELECT ngram, idf, item_id, 1.0 AS k, value FROM di UNION ALL SELECT ngram, idf, item_id, CASE field WHEN 1 THEN 0.45 ELSE 0.12 END, value FROM ne),
      qg AS (SELECT DISTINCT id AS q, ngram, weight FROM ({_LM.format(f"SELECT q AS id, {_CT.format('text')} AS w FROM qs")}))
      """
    + _top("SELECT q, item_id, sum(weight * idf * k * value) AS score FROM qg JOIN me USING (ngram) GROUP BY ALL", "q", 100),
}
QUERIES = {n: globals()[n] for n in SQL}
for _v in S.CONTINUITY:
    QUERIES[f"continuity_{_v}"], SQL[f"continuity_{_v}"] = _continuity(_v), _continuity_sql(_v)
for _v in S.ENTITY:
    QUERIES[f"entity_{_v}"], SQL[f"entity_{_v}"] = _entity(_v), _entity_sql(_v)
for _v in S.TRANSITION:
    QUERIES[f"transition_{_v}"], SQL[f"transition_{_v}"] = _transition(_v), _transition_sql(_v)
