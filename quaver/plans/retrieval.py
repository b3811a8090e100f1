"""Queries on retrieval: BM25, exact phrases, popularity and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import ranking as K
from ..operators import retrieval as R
from .texts import _sql_list
from .views import HISTORY, ITEMS, NORM, PLAYS, TASKS, VALUES, dev_tasks, history, items, messages, plays, table, values

CONV = ["conv_id", "turn"]


def users(s, d):
    return messages(s, d).where("role = 'user'").select("conv_id", "turn", "text")


def bm25_docs_top20(s, d):
    return R.Bm25(table(s, d, "documents"), "doc_id", F.col("text")).top(users(s, d), CONV, F.col("text"), 20)


def bm25_fielded(s, d):
    """Item searches by what a dialogue's texts share with name and type lines."""
    p = table(s, d, "part")
    doc = X.fields_text({"track_name": F.col("p_name"), "tag_list": F.col("p_type")})
    q = p.select("p_brand", F.concat_ws(" ", "p_type", F.substring_index("p_name", " ", 1)).alias("query")).distinct()
    return R.Bm25(p, "p_partkey", doc).top(q, ["p_brand", "query"], F.col("query"), 10)


def exact_index(s, d):
    return R.exact_index(values(items(s, d))).select("field", "value", "item_id", "pop_rank", F.col("n_items").cast("long").alias("n_items"))


def _queries(s, d):
    """Queries over the catalog: every brand with every type and a name of its own."""
    p = table(s, d, "part")
    return p.groupBy("p_brand", "p_type").agg(F.max("p_name").alias("name")).select(F.concat_ws("/", "p_brand", "p_type").alias("q"), F.concat_ws(" by ", "name", "p_brand", "p_type").alias("text"))


def _hits(s, d, k):
    return R.exact_hits(_queries(s, d), R.exact_index(values(items(s, d))), ["q"], F.col("text"), k, most=8)


def exact_ranked(s, d):
    return R.exact_ranked(_hits(s, d, 20), ["q"], 20)


def exact_by_field(s, d):
    return R.exact_by_field(_hits(s, d, 50), ["q"], 50)


def exact_hybrid(s, d):
    hits = _hits(s, d, 50)
    return R.exact_hybrid(R.exact_ranked(_hits(s, d, 20), ["q"], 20), R.exact_by_field(hits, ["q"], 50), ["q"], 60)


def exact_padded(s, d):
    found = R.exact_hybrid(R.exact_ranked(_hits(s, d, 20), ["q"], 20), R.exact_by_field(_hits(s, d, 50), ["q"], 50), ["q"], 60)
    return K.padded(found, _queries(s, d), K.popular(items(s, d), 160), 100, ["q"])


def popularity_top(s, d):
    return K.popular(items(s, d), 100)


def cosine_top20(s, d):
    """The first vector of each label against all vectors."""
    e = table(s, d, "embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    return R.cosine_top(q, e.withColumnRenamed("vec_id", "item_id").withColumnRenamed("embedding", "v"), ["label"], 20)


def _vector_history(s, d):
    """Histories whose items have a vector (items are matched to vectors by number)."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")).where(V.is_valid(F.col("v")))
    return history(dev_tasks(s, d), plays(s, d)).join(e, "item_id"), e


def history_mean_top20(s, d):
    h, e = _vector_history(s, d)
    q = V.mean_of(["session_id", "turn_number"], h.withColumn("v", V.unit(F.col("v"))), "v", "q")
    return R.cosine_top(q, e, ["session_id", "turn_number"], 20)


def recent_neighbor_top20(s, d):
    h, e = _vector_history(s, d)
    q = h.groupBy("session_id", "turn_number").agg(F.min_by("v", "recency").alias("q"))
    return R.cosine_top(q, e, ["session_id", "turn_number"], 20)


def user_vector_top20(s, d):
    """Customers' vectors (matched by number) against all vectors; customers without one have no rows."""
    e = table(s, d, "embeddings")
    q = table(s, d, "customer").join(e, F.col("c_custkey") == F.col("vec_id")).select("c_custkey", F.col("embedding").alias("q"))
    return R.cosine_top(q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")), ["c_custkey"], 20)


_TOK = f"list_filter(regexp_extract_all(lower({{0}}), '[\\p{{{{L}}}}\\p{{{{N}}}}_]{{{{2,}}}}'), lambda t: t NOT IN {_sql_list(X.BM25_STOPWORDS)})"


def _bm25(docs: str, queries: str, keys: str, k: int) -> str:
    """docs: item_id, text; queries: keys, text."""
    return f"""WITH dt AS (SELECT item_id, {_TOK.format("text")} AS tokens FROM ({docs})), st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM dt),
      po AS (SELECT item_id, term, dl, count(*) AS tf FROM (SELECT item_id, len(tokens) AS dl, unnest(tokens) AS term FROM dt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
      q AS (SELECT DISTINCT {keys}, unnest({_TOK.format("text")}) AS term FROM ({queries})),
      sc AS (SELECT {keys}, item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) + 1e-9, 6) AS score FROM q JOIN po USING (term) JOIN df USING (term), st GROUP BY {keys}, item_id)
      SELECT {keys}, item_id, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, item_id) AS INT) AS rank, score FROM sc QUALIFY rank <= {k}"""


_VALIDV = f"""CASE WHEN len(string_split(value, ' ')) = 1 THEN value NOT IN {_sql_list(X.KEY_STOPWORDS)} AND (length(value) >= CASE WHEN field = 3 THEN 3 ELSE 4 END OR (length(value) >= 2 AND regexp_matches(value, '[0-9]')))
  ELSE length(array_to_string(list_filter(string_split(value, ' '), lambda t: t NOT IN {_sql_list(X.KEY_STOPWORDS)}), '')) >= 4 END"""
INDEX = f"""idx AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY field, value ORDER BY popularity DESC, item_id) AS pop_rank, count(*) OVER (PARTITION BY field, value) AS n_items FROM (SELECT DISTINCT * FROM vals WHERE {_VALIDV}))"""
_Q = "qs AS (SELECT concat_ws('/', p_brand, p_type) AS q, concat_ws(' by ', max(p_name), p_brand, p_type) AS text FROM part GROUP BY p_brand, p_type)"
_NG = f"""qt AS (SELECT q, string_split({NORM.format("text")}, ' ') AS t FROM qs),
  ng AS MATERIALIZED (SELECT q, value, n_tokens, length(replace(value, ' ', '')) AS n_chars, row_number() OVER (PARTITION BY q ORDER BY n_tokens DESC, pos) - 1 AS ngram_rank FROM (
    SELECT q, value, n_tokens, min(pos) AS pos FROM (SELECT q, n AS n_tokens, i AS pos, array_to_string(list_slice(t, i, i + n - 1), ' ') AS value FROM (SELECT q, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM qt, (SELECT unnest(range(1, 9)) AS n))) GROUP BY ALL))"""


def _hit_sql(name: str, k: int) -> str:
    return f"""{name} AS MATERIALIZED (SELECT h.*, i.item_id, i.popularity, i.pop_rank FROM (SELECT *, coalesce(sum(n_items) OVER (PARTITION BY q, field ORDER BY ngram_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
      FROM ng JOIN (SELECT DISTINCT field, value, n_items FROM idx) USING (value)) h JOIN idx i ON i.field = h.field AND i.value = h.value WHERE b < {8 * k})"""


_RANKED = "rk AS (SELECT q, item_id, row_number() OVER (PARTITION BY q ORDER BY best, item_id) AS rank FROM (SELECT q, item_id, min(ROW(-n_tokens, -n_chars, field, ngram_rank, -popularity)) AS best FROM h20 GROUP BY ALL) QUALIFY rank <= 20)"
_FIELD = "bf AS (SELECT q, field, item_id, row_number() OVER (PARTITION BY q, field ORDER BY place, item_id) AS rank FROM (SELECT q, field, item_id, min(ROW(ngram_rank, pop_rank)) AS place FROM h50 GROUP BY ALL) QUALIFY rank <= 50)"
_HYBRID = "hy AS (SELECT q, item_id, row_number() OVER (PARTITION BY q ORDER BY place, item_id) AS rank FROM (SELECT q, item_id, min(ROW(f, rank)) AS place FROM (SELECT q, item_id, -1 AS f, rank FROM rk UNION ALL SELECT q, item_id, field, rank FROM bf) GROUP BY ALL) QUALIFY rank <= 60)"
_EXACT = f"WITH {ITEMS}, {VALUES}, {INDEX}, {_Q}, {_NG}, {_hit_sql('h20', 20)}, {_hit_sql('h50', 50)}, {_RANKED}, {_FIELD}, {_HYBRID}"
POPULAR = "pop AS (SELECT item_id, row_number() OVER (ORDER BY popularity DESC, item_id) AS pop_rank FROM items)"
_UNIT = "list_transform({0}, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))))"


def _cosine(queries: str, keys: str, k: int) -> str:
    return f"""sc AS (SELECT {keys}, item_id, round(list_dot_product(a, b), 6) AS score FROM (SELECT {keys}, {_UNIT.format("q")} AS a FROM ({queries})), (SELECT vec_id AS item_id, {_UNIT.format("embedding")} AS b FROM embeddings))
      SELECT {keys}, item_id, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, item_id) AS INT) AS rank, score FROM sc QUALIFY rank <= {k}"""


_VH = f"WITH {PLAYS}, {TASKS}, {HISTORY}, vh AS (SELECT h.*, embedding FROM history h JOIN embeddings ON vec_id = item_id)"
SQL = {
    "bm25_docs_top20": _bm25("SELECT doc_id AS item_id, text FROM documents", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'", "conv_id, turn", 20),
    "bm25_fielded": _bm25("SELECT p_partkey AS item_id, 'track_name: ' || lower(p_name) || chr(10) || 'tag_list: ' || lower(p_type) AS text FROM part", "SELECT DISTINCT p_brand, p_type || ' ' || string_split(p_name, ' ')[1] AS query, p_type || ' ' || string_split(p_name, ' ')[1] AS text FROM part", "p_brand, query", 10),
    "exact_index": f"WITH {ITEMS}, {VALUES}, {INDEX} SELECT field, value, item_id, CAST(pop_rank AS INT) AS pop_rank, n_items FROM idx",
    "exact_ranked": f"{_EXACT} SELECT q, item_id, CAST(rank AS INT) AS rank FROM rk",
    "exact_by_field": f"{_EXACT} SELECT q, field, item_id, CAST(rank AS INT) AS rank FROM bf",
    "exact_hybrid": f"{_EXACT} SELECT q, item_id, CAST(rank AS INT) AS rank FROM hy",
    "exact_padded": f"""{_EXACT}, {POPULAR} SELECT q, item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY is_pad, rank, item_id) AS INT) AS place_, is_pad FROM (SELECT q, item_id, rank, false AS is_pad FROM hy
      UNION ALL SELECT q, item_id, pop_rank, true FROM (SELECT qs.q, pop.* FROM qs, pop) x WHERE NOT EXISTS (SELECT 1 FROM hy WHERE hy.q = x.q AND hy.item_id = x.item_id)) QUALIFY place_ <= 100""",
    "popularity_top": f"WITH {ITEMS}, {POPULAR} SELECT item_id, CAST(pop_rank AS INT) AS pop_rank FROM pop WHERE pop_rank <= 100",
    "cosine_top20": "WITH " + _cosine("SELECT label, min_by(embedding, vec_id) AS q FROM embeddings GROUP BY label", "label", 20),
    "history_mean_top20": f"{_VH}, mv AS (SELECT session_id, turn_number, list(x ORDER BY pos) AS q FROM (SELECT session_id, turn_number, pos, avg(v[pos]) AS x FROM (SELECT session_id, turn_number, {_UNIT.format('embedding')} AS v FROM vh), (SELECT unnest(range(1, 65)) AS pos) GROUP BY ALL) GROUP BY ALL), "
    + _cosine("SELECT * FROM mv", "session_id, turn_number", 20),
    "recent_neighbor_top20": f"{_VH}, mv AS (SELECT session_id, turn_number, min_by(embedding, recency) AS q FROM vh GROUP BY ALL), " + _cosine("SELECT * FROM mv", "session_id, turn_number", 20),
    "user_vector_top20": "WITH " + _cosine("SELECT c_custkey, embedding AS q FROM customer JOIN embeddings ON c_custkey = vec_id", "c_custkey", 20),
}
SQL["exact_padded"] = "SELECT q, item_id, place_ AS rank, is_pad FROM (" + SQL["exact_padded"] + ")"
QUERIES = {n: globals()[n] for n in SQL}
