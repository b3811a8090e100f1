"""Queries on values, features and studies: parsing, hashes, sets, features of tasks, forced labels, intervals by resampling, artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import audit as A
from ..operators import features as E
from ..operators import fusion as U
from ..operators import generation as N
from ..operators import learning as L
from ..operators import memory as M
from ..operators import ranking as K
from ..sources import files as S
from . import dialogue as D
from . import ranking as R
from .audits import _COLUMNS, _FRAME, _frame, _training, bootstrap_ci, popularity_stream  # noqa: F401
from .dialogue import DT, _past, _profiles, _RECENT, told
from .retrieval import POPULAR
from .views import ITEMS, NORM, PLAYS, dev_tasks, items, plays, table


def safe_floats(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", X.safe_float(F.substring_index("p_brand", "#", -1)).alias("number"), X.safe_float(F.col("p_name")).alias("none"), X.safe_float(F.try_element_at(F.split("p_brand", "#"), F.lit(2))).alias("listed"))


def strict_bools(s, d):
    o = table(s, d, "orders")
    return o.select("o_orderkey", X.strict_bool(F.when(F.col("o_orderstatus") == "F", " TRUE").otherwise("false ")).alias("closed"))


def canonical_hashes(s, d):
    return table(s, d, "documents").select("doc_id", X.canonical_hash("doc_id", "lang", "source").alias("digest"))


def md5_sample(s, d):
    """100 documents in the order of their keys' MD5."""
    return K.top(table(s, d, "documents").select(F.lit("all").alias("of"), "doc_id"), ["of"], [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")], 100).select("doc_id", "rank")


def tag_sets(s, d):
    """Whether a turn's tags meet the previous turn's."""
    p = plays(s, d).join(items(s, d).select("item_id", X.name_set(F.col("tags")).alias("tags")), "item_id", "left")
    before = F.lag("tags").over(Window.partitionBy("session_id").orderBy("turn_number"))
    return p.withColumn("before", before).where("before is not null").select("session_id", "turn_number", X.sets_meet(F.col("tags"), F.col("before")).alias("meets"))


def longest_key(s, d):
    from ..operators import retrieval as T
    from .views import values

    return T.longest_key(T.exact_index(values(items(s, d))))


def standardised(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.lit(3.0).alias("constant"))
    train = li.where("l_orderkey % 10 < 8")
    z = E.standardised(li, train, ["l_quantity", "l_discount", "constant"])
    return z.groupBy("l_orderkey").agg(F.count("*").alias("n"), *(F.round(F.sum(c), 6).alias(c) for c in ("l_quantity", "l_discount", "constant")))


def feature_names(s, d):
    """Features of ranks by name, and the sources that have them."""
    f = E.with_extra(R.ltr_rank_feats(s, d), lambda t: [(F.col("f_rrf_score") * 2).alias("f_extra")])
    names, sources = E.feature_columns(f.columns), E.sources_of(f.columns)
    return s.createDataFrame([(n, next((x for x in sources if n.startswith(f"f_{x}_")), None)) for n in names], "feature string, source string")


def _dialogue_pool(s, d) -> DataFrame:
    """Dialogue tasks to evaluate with the items of their label's artist."""
    it = items(s, d).select("item_id", "artist")
    t = told(s, d).where("not train").join(it.withColumnRenamed("item_id", "label"), "label")
    return t.select(*K.TASK, "artist").join(it, "artist").select(*K.TASK, "item_id")


def _texts(s, d) -> DataFrame:
    t = told(s, d)
    full = F.concat_ws("\n", F.nullif(F.coalesce("recent", F.lit("")), F.lit("")), "query")
    return t.join(M.recent_queries(t), K.TASK, "left").select(*K.TASK, "user_id", F.col("query").alias("current"), full.alias("full"), F.coalesce("recent", F.lit("")).alias("recent"))


def ltr_lexical_views(s, d):
    return E.lexical_views(_dialogue_pool(s, d), _texts(s, d), items(s, d), K.TASK)


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))


def _history_vectors(s, d):
    h = _past(told(s, d)).join(_vectors(s, d), "item_id").withColumn("v", V.unit(F.col("v")))
    return V.mean_of(K.TASK, h, "v", "q")


def _user_vectors(s, d):
    return told(s, d).join(_vectors(s, d).select(F.col("item_id").alias("user_id"), F.col("v").alias("q")).where("user_id % 3 <> 0"), "user_id").select(*K.TASK, "q")


def ltr_vectors(s, d):
    """Cosines of candidates with the user's and the history's vectors, in two spaces of which the second is the first, turned around."""
    v = _vectors(s, d)
    back = v.select("item_id", F.reverse("v").alias("v"))
    h = _history_vectors(s, d)
    return E.vector_features(_dialogue_pool(s, d), {"cf": v, "audio": back}, {"f_user_cosine": ("cf", _user_vectors(s, d)), "f_history_cosine": ("cf", h), "f_history_audio_cosine": ("audio", h)})


def ltr_misc(s, d):
    t = _texts(s, d)
    n = _past(told(s, d)).groupBy(*K.TASK).agg(F.count("*").alias("n_history"))
    users = _user_vectors(s, d).withColumnRenamed("q", "user_v")
    h = _history_vectors(s, d).withColumnRenamed("q", "history_v")
    tasks = t.join(n, K.TASK, "left").join(users, K.TASK, "left").join(h, K.TASK, "left")
    tasks = tasks.select(*K.TASK, F.col("turn_number").alias("turn"), F.coalesce("n_history", F.lit(0)).alias("n_history"), "current", "full", "recent", X.intent(F.col("current")).alias("intent"), "user_v", "history_v")
    pool = _dialogue_pool(s, d)
    explicit = pool.where("item_id % 4 = 0").select(*K.TASK, "item_id", F.lit("exact_track_current").alias("source"))
    return E.miscellaneous(pool, tasks, explicit, ["exact_track_current"])


def force_positive(s, d):
    c = R._fused(s, d).select(*K.TASK, "item_id", "rank")
    labels = dev_tasks(s, d).select(*K.TASK, F.col("label").alias("item_id"))
    return U.force_positive(c, labels, items(s, d).where("item_id % 5 <> 0"), 30)


def exactly20(s, d):
    return K.exactly(K.padded(R._cross(s, d).where("rank <= 20"), dev_tasks(s, d), K.popular(items(s, d), 60), 20), 20)


def standardized_interval(s, d):
    return A.standardized_bootstrap(_frame(s, d), ["promo", "heavy"], 100)


def stratified_interval(s, d):
    """Detectors judged by return flags; strata are order priorities, clusters are orders. The strata, a row each, are broadcast: dealt by
    them, all that follows would have as many tasks as there are strata."""
    li = table(s, d, "lineitem").join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    size = li.groupBy("o_orderpriority").agg((F.count("*") * 10).alias("population"))
    label = F.when(F.col("l_returnflag") == "R", "YES").when(F.col("l_returnflag") == "N", "NO").otherwise("UNCERTAIN")
    j = li.join(F.broadcast(size), "o_orderpriority").select("l_orderkey", "o_orderpriority", "population", label.alias("label"), (F.col("l_discount") > 0.05).alias("late"), (F.col("l_quantity") > 30).alias("heavy"))
    return A.stratified_bootstrap(j, "label", ["late", "heavy"], "o_orderpriority", "population", "l_orderkey", 50)


def ledger_artifacts(s, d):
    """Customers as runs and suppliers as artifacts with a number of records."""
    c = table(s, d, "customer")
    kind = F.col("c_custkey") % 4
    name = F.when(kind == 0, F.concat(F.lit("exp/submission_"), "c_custkey", F.lit(".zip"))).when(kind == 1, F.concat(F.lit("/abs/path/"), "c_custkey")).otherwise(F.concat(F.lit("run_"), "c_custkey", F.lit(".json")))
    ledger = c.select(F.col("c_custkey").alias("run"), name.alias("artifact"))
    n = table(s, d, "supplier")
    files = n.select(F.when(F.col("s_suppkey") % 4 < 2, F.concat("s_suppkey", F.lit(".json"))).otherwise(F.concat(F.lit("run_"), "s_suppkey", F.lit(".json"))).alias("file"), F.when(F.col("s_suppkey") % 3 == 0, 79).otherwise(80).alias("records"))
    return S.resolve_artifacts(ledger, files, 80)


def profile_texts(s, d):
    """A user's profile in both forms: named parts, and one line of values."""
    p = _profiles(s, d)
    return N.profile_text(p, "user_id", ["c_mktsegment", "n_name"]).join(M.profile_words(p, "user_id", ["c_mktsegment", "n_name"]).withColumnRenamed("profile", "line"), "user_id")


def prompt_inputs(s, d):
    """What a generator is given for each dialogue task: the query, the item, a style and what may be said of the item."""
    t = told(s, d)
    firsts = t.select(*K.TASK, F.col("label").alias("item_id"), F.lit(1).alias("rank"))
    return N.prompts(t.select(*K.TASK, "query"), firsts, items(s, d), K.TASK).drop("style")


def generated(s, d):
    """Responses by a stand-in generator that answers some prompts and leaves others to the template."""
    t = told(s, d)
    firsts = t.select(*K.TASK, F.col("label").alias("item_id"), F.lit(1).alias("rank"))
    prompts = N.prompts(t.select(*K.TASK, "query"), firsts, items(s, d), K.TASK)
    return N.generate(prompts, lambda texts: ["Response: **" + x.split(";")[0] + "**" if len(x) % 2 else "" for x in texts], items(s, d), K.TASK)


def variants_compared(s, d):
    a = R._fused(s, d).where("rank <= 5").groupBy(*K.TASK).agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("items"))
    b = R._fused(s, d).where("rank <= 5 and (rank < 5 or turn_number <> 3)").groupBy(*K.TASK).agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("items"))
    return N.compare_variants(a, b, K.TASK)


def lambdarank_rerank(s, d):
    """Top 20 by boosted trees with listwise gradients, averaged over two seeds, for tasks that no tree has seen."""
    t = L.folds(_training(s, d), 2, "l")
    train, other = t.where("fold = 0"), t.where("fold = 1")
    return K.scored_top(L.lambda_ensemble(train, other, _COLUMNS, [3, 4], rounds=3).select(*K.TASK, "item_id", "score"), 20)


def importance_table(s, d):
    t = _training(s, d)
    told_ = L.importances(L.fit_trees(t, _COLUMNS, 3), _COLUMNS)
    return s.createDataFrame([(n, i + 1, g) for i, (n, g) in enumerate(told_)], "feature string, rank int, gain double")


# ---------------------------------------------------------------- SQL

_UNI = "('0x' || left(md5(concat_ws(':', '{0}', {1}, replicate)), 10))::BIGINT::DOUBLE / 1099511627776.0"


def _poisson(u: str) -> str:
    out, total, p = [], 0.0, 0.36787944117144233
    for i in range(8):
        total += p
        out.append(f"({u} >= {total!r})::INT")
        p /= i + 1
    return "(" + " + ".join(out) + ")"


def _replicates(stats: str, seed: str, cluster: str, n: int) -> str:
    return f"(SELECT *, {_poisson('u')} AS k FROM (SELECT *, {_UNI.format(seed, cluster)} AS u FROM {stats}, (SELECT unnest(range(1, {n} + 1)) AS replicate)) WHERE {_poisson('u')} > 0)"


_TEXT = f"{DT}, {_RECENT}, tx AS MATERIALIZED (SELECT dt.session_id, dt.turn_number, dt.user_id, query AS current, concat_ws(chr(10), nullif(coalesce(recent, ''), ''), query) AS full, coalesce(recent, '') AS recent FROM dt LEFT JOIN re USING (session_id, turn_number))"
_POOL = "dp AS MATERIALIZED (SELECT dt.session_id, dt.turn_number, b.item_id FROM dt JOIN items a ON a.item_id = dt.label JOIN items b ON b.artist = a.artist WHERE NOT dt.train)"
_IN = "(contains(' ' || {1} || ' ', ' ' || {0} || ' ') AND {0} <> '')::INT::DOUBLE"
_BOTH = "len(list_intersect(list_distinct(list_filter(string_split({0}, ' '), lambda t: t <> '')), string_split({1}, ' ')))::DOUBLE"
_U = "list_transform({0}, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))))"
_HV = f"hv AS MATERIALIZED (SELECT session_id, turn_number, list(x ORDER BY pos) AS q FROM (SELECT session_id, turn_number, pos, avg(v[pos]) AS x FROM (SELECT session_id, turn_number, {_U.format('embedding')} AS v FROM past JOIN embeddings ON vec_id = item_id), (SELECT unnest(range(1, 65)) AS pos) GROUP BY ALL) GROUP BY ALL)"
_UV = "uv AS MATERIALIZED (SELECT session_id, turn_number, embedding AS q FROM dt JOIN embeddings ON vec_id = user_id WHERE user_id % 3 <> 0)"
_COS = "round(coalesce(list_dot_product({0}, {1}), 0), 6)"


def _misc_sql() -> str:
    from .texts import SQL as TEXT_SQL

    intent = TEXT_SQL["intent_bucket"]
    case = intent[intent.index("CASE") : intent.rindex("END") + 3].replace("coalesce(text", "coalesce(current")
    n = lambda c: f"len(list_distinct(list_filter(string_split({NORM.format(c)}, ' '), lambda t: t <> '')))::DOUBLE"
    return f"""WITH {ITEMS}, {_TEXT}, {_POOL}, {_HV}, {_UV}, nh AS (SELECT session_id, turn_number, count(*) AS n FROM past GROUP BY 1, 2), itx AS (SELECT *, {case} AS intent FROM (SELECT *, current AS text FROM tx))
      SELECT dp.session_id, dp.turn_number, dp.item_id, dp.turn_number::DOUBLE AS f_turn_number, coalesce(nh.n, 0)::DOUBLE AS f_history_count, {", ".join(f"{n(chr(34) + c + chr(34))} AS f_{c}_query_len" for c in ("full", "current", "recent"))},
      (item_id % 4 = 0)::INT::DOUBLE AS f_has_explicit_source_hit, {", ".join(f"(intent = '{i}')::INT::DOUBLE AS f_intent_{i}" for i in (*X.INTENTS, "ambiguous"))}, (uv.q IS NULL)::INT::DOUBLE AS f_missing_user_embedding, (hv.q IS NULL)::INT::DOUBLE AS f_missing_history_embedding
      FROM dp JOIN itx USING (session_id, turn_number) LEFT JOIN nh USING (session_id, turn_number) LEFT JOIN uv USING (session_id, turn_number) LEFT JOIN hv USING (session_id, turn_number)"""


_STRATA = """sr AS (SELECT l_orderkey AS g, o_orderpriority AS stratum, (count(*) OVER (PARTITION BY o_orderpriority) * 10)::DOUBLE AS population, l_returnflag, l_returnflag = 'R' AS yes, unnest([{detector: 'late', hit: l_discount > 0.05}, {detector: 'heavy', hit: l_quantity > 30}]) AS x FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  ss AS MATERIALIZED (SELECT g, stratum, population, x.detector AS detector, count(*) AS n, count(*) FILTER (WHERE x.hit AND yes) AS tp, count(*) FILTER (WHERE x.hit AND NOT yes) AS fp, count(*) FILTER (WHERE NOT x.hit AND yes) AS fn FROM sr WHERE l_returnflag IN ('R', 'N') GROUP BY ALL)"""


def _measures(sums: str, by: str) -> str:
    t = f"SELECT {by}, count(*) AS have, sum(population / n * tp) AS tp, sum(population / n * fp) AS fp, sum(population / n * fn) AS fn FROM ({sums}) GROUP BY {by}"
    return f"SELECT {by}, have, unnest([{{m: 'precision', v: tp / nullif(tp + fp, 0)}}, {{m: 'recall', v: tp / nullif(tp + fn, 0)}}, {{m: 'f1', v: 2 * tp / nullif(2 * tp + fp + fn, 0)}}]) AS x FROM ({t})"


_QUANT = "count(*) AS replicates, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high"
_STRATIFIED = f"""WITH {_STRATA}, st AS (SELECT count(DISTINCT stratum) AS strata FROM ss),
  po AS (SELECT detector, x.m AS measure, round(x.v, 6) AS estimate FROM ({_measures("SELECT detector, stratum, population, sum(n) AS n, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ss GROUP BY ALL", "detector")})),
  rp AS (SELECT detector, replicate, x.m AS measure, x.v AS v, have FROM ({_measures(f"SELECT replicate, detector, stratum, population, sum(n * k) AS n, sum(tp * k) AS tp, sum(fp * k) AS fp, sum(fn * k) AS fn FROM {_replicates('ss', 's', 'g', 50)} GROUP BY ALL", "detector, replicate")}), st WHERE have = strata)
  SELECT detector, measure, any_value(estimate) AS estimate, {_QUANT} FROM po JOIN rp USING (detector, measure) WHERE v IS NOT NULL GROUP BY 1, 2"""
_STANDARD = f"""WITH {_FRAME}, su AS MATERIALIZED (SELECT session_id, detector, turn_number, count(*) FILTER (WHERE hit) AS nh, count(*) FILTER (WHERE hit AND same) AS sh, count(*) FILTER (WHERE NOT hit) AS no, count(*) FILTER (WHERE NOT hit AND same) AS so FROM e WHERE detector <> 'late' GROUP BY ALL),
  t AS MATERIALIZED (SELECT detector, turn_number, sum(nh) AS t_nh, sum(sh) AS t_sh, sum(no) AS t_no, sum(so) AS t_so FROM su GROUP BY ALL HAVING sum(nh) > 0 AND sum(no) > 0),
  po AS (SELECT detector, count(*) AS turns, sum(t_nh)::BIGINT AS n, round(sum(t_nh * (t_sh / t_nh - t_so / t_no)) / sum(t_nh), 6) AS difference FROM t GROUP BY 1),
  su2 AS MATERIALIZED (SELECT su.* FROM su SEMI JOIN t USING (detector, turn_number)),
  r AS (SELECT detector, replicate, turn_number, sum(nh * k) AS nh, sum(sh * k) AS sh, sum(no * k) AS no, sum(so * k) AS so FROM {_replicates('su2', 't', 'session_id', 100)} GROUP BY ALL),
  pe AS (SELECT detector, replicate, count(d) AS have, sum(t_nh * d) / sum(t_nh) AS v FROM (SELECT *, sh / nullif(nh, 0) - so / nullif(no, 0) AS d FROM r JOIN t USING (detector, turn_number)) GROUP BY ALL)
  SELECT detector, any_value(turns) AS turns, any_value(n) AS n, any_value(difference) AS difference, {_QUANT} FROM po JOIN pe USING (detector) WHERE have = turns AND v IS NOT NULL GROUP BY 1"""
_Z = "round(({0} - (SELECT avg({0}) FROM tr)) / (SELECT CASE WHEN stddev_pop({0}) < 1e-6 THEN 1.0 ELSE stddev_pop({0}) END FROM tr), 6)"
SQL = {
    "safe_floats": "SELECT p_partkey, coalesce(try_cast(split_part(p_brand, '#', -1) AS DOUBLE), 0) AS number, coalesce(try_cast(p_name AS DOUBLE), 0) AS none, coalesce(try_cast(string_split(p_brand, '#')[2] AS DOUBLE), 0) AS listed FROM part",
    "strict_bools": "SELECT o_orderkey, o_orderstatus = 'F' AS closed FROM orders",
    "canonical_hashes": """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS digest FROM documents""",
    "md5_sample": "SELECT doc_id, CAST(row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) AS INT) AS rank FROM documents QUALIFY rank <= 100",
    "tag_sets": f"WITH {PLAYS}, {ITEMS}, x AS (SELECT session_id, turn_number, list_distinct(list_transform(tags, lambda t: lower(trim(t)))) AS tags FROM plays LEFT JOIN items USING (item_id)), y AS (SELECT *, lag(tags) OVER (PARTITION BY session_id ORDER BY turn_number) AS before FROM x) SELECT session_id, turn_number, list_has_any(tags, before) AS meets FROM y WHERE before IS NOT NULL",
    "longest_key": f"{D._TB.replace('AS MATERIALIZED', 'AS')} SELECT least(max(len(string_split(value, ' '))), 12)::INT AS most FROM idx",
    "standardised": f"WITH li AS (SELECT *, 3.0::DOUBLE AS constant FROM lineitem), tr AS (SELECT * FROM li WHERE l_orderkey % 10 < 8) SELECT l_orderkey, count(*) AS n, {', '.join(f'round(sum({c}), 6) AS {c}' for c in ('l_quantity', 'l_discount', 'constant'))} FROM (SELECT l_orderkey, {', '.join(f'{_Z.format(c)} AS {c}' for c in ('l_quantity', 'l_discount', 'constant'))} FROM li) GROUP BY 1",
    "ltr_lexical_views": f"""WITH {ITEMS}, {_TEXT}, {_POOL}, j AS (SELECT dp.session_id, dp.turn_number, dp.item_id, {NORM.format("current")} AS c, {NORM.format('"full"')} AS f, {NORM.format("recent")} AS r, {NORM.format("name")} AS nm, {NORM.format("artist")} AS ar, {NORM.format("album")} AS al, array_to_string(list_filter(list_transform(tags, lambda x: {NORM.format("x")}), lambda x: x <> ''), ' ') AS tg FROM dp JOIN tx USING (session_id, turn_number) JOIN items USING (item_id))
      SELECT session_id, turn_number, item_id, {", ".join(f"{_IN.format(c, v[0])} AS f_{n}_exact_{v}" for v in ("current", "full") for n, c in (("name", "nm"), ("artist", "ar"), ("album", "al")))}, {", ".join(f"{_BOTH.format('tg', v[0])} AS f_tag_overlap_{v}" for v in ("current", "full", "recent"))} FROM j""",
    "ltr_vectors": f"""WITH {ITEMS}, {DT}, {_POOL}, {_HV}, {_UV}, em AS (SELECT vec_id AS item_id, {_U.format("embedding")} AS v, list_reverse({_U.format("embedding")}) AS b FROM embeddings)
      SELECT dp.session_id, dp.turn_number, dp.item_id, {_COS.format(_U.format("uv.q"), "v")} AS f_user_cosine, {_COS.format(_U.format("hv.q"), "v")} AS f_history_cosine, {_COS.format(_U.format("hv.q"), "b")} AS f_history_audio_cosine
      FROM dp LEFT JOIN em USING (item_id) LEFT JOIN uv USING (session_id, turn_number) LEFT JOIN hv USING (session_id, turn_number)""",
    "ltr_misc": _misc_sql(),
    "force_positive": f"""{R._BASE}, lb AS (SELECT session_id, turn_number, label AS item_id FROM tasks), wo AS (SELECT session_id, turn_number FROM cand GROUP BY 1, 2 HAVING max(label) = 0), mi AS (SELECT lb.* FROM lb SEMI JOIN wo USING (session_id, turn_number) WHERE item_id % 5 <> 0),
      kp AS (SELECT c.session_id, c.turn_number, c.item_id, c.rank, c.label FROM cand c LEFT JOIN mi USING (session_id, turn_number) WHERE mi.item_id IS NULL OR c.rank <= 29)
      SELECT session_id, turn_number, item_id, rank, label, false AS forced FROM kp UNION ALL SELECT m.session_id, m.turn_number, m.item_id, (coalesce(max(k.rank), 0) + 1)::INT, 1, true FROM mi m LEFT JOIN kp k USING (session_id, turn_number) GROUP BY ALL""",
    "exactly20": f"""{R._BASE}, {POPULAR} SELECT session_id, turn_number, item_id, CAST(row_number() OVER (PARTITION BY session_id, turn_number ORDER BY is_pad, rank, item_id) AS INT) AS rank, is_pad FROM (SELECT session_id, turn_number, item_id, rank, false AS is_pad FROM s1 WHERE rank <= 20
      UNION ALL SELECT session_id, turn_number, item_id, pop_rank, true FROM (SELECT t.session_id, t.turn_number, pop.* FROM tasks t, pop WHERE pop_rank <= 60) x WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE rank <= 20 AND s1.session_id = x.session_id AND s1.turn_number = x.turn_number AND s1.item_id = x.item_id))
      QUALIFY row_number() OVER (PARTITION BY session_id, turn_number ORDER BY is_pad, rank, item_id) <= 20""",
    "standardized_interval": _STANDARD,
    "stratified_interval": _STRATIFIED,
    "ledger_artifacts": r"""WITH le AS (SELECT c_custkey AS run, CASE c_custkey % 4 WHEN 0 THEN 'exp/submission_' || c_custkey || '.zip' WHEN 1 THEN '/abs/path/' || c_custkey ELSE 'run_' || c_custkey || '.json' END AS artifact FROM customer),
      fi AS (SELECT CASE WHEN s_suppkey % 4 < 2 THEN s_suppkey || '.json' ELSE 'run_' || s_suppkey || '.json' END AS file, CASE WHEN s_suppkey % 3 = 0 THEN 79 ELSE 80 END AS records FROM supplier),
      tr AS (SELECT run, artifact, b, unnest([{k: 0, f: b}, {k: 1, f: CASE WHEN NOT contains(b, '.') THEN b || '.zip' END}, {k: 2, f: CASE WHEN NOT contains(b, '.') THEN b || '.json' END}, {k: 3, f: nullif(regexp_extract(b, '^submission_(.*)\.zip$', 1), '') || '.json'}]) AS x FROM (SELECT *, regexp_extract(artifact, '([^/]*)$', 1) AS b FROM le)),
      fo AS (SELECT run, min_by(file, x.k) AS file, min_by(records, x.k) AS records FROM tr JOIN fi ON fi.file = x.f GROUP BY run)
      SELECT run, artifact, file, CASE WHEN file IS NULL THEN 'artifact_not_found' WHEN records <> 80 THEN 'record_count:' || records END AS reason FROM le LEFT JOIN fo USING (run)""",
    "profile_texts": "SELECT c_custkey AS user_id, concat_ws(', ', CASE WHEN trim(coalesce(c_mktsegment, '')) <> '' THEN 'c_mktsegment: ' || trim(c_mktsegment) END, 'n_name: ' || n_name) AS profile, concat_ws(' ', coalesce(c_mktsegment, ''), n_name) AS line FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "variants_compared": f"{R._BASE}, a AS (SELECT session_id, turn_number, count(*) FILTER (WHERE rank <= 5) AS x, count(*) FILTER (WHERE rank <= 5 AND (rank < 5 OR turn_number <> 3)) AS y FROM fused GROUP BY 1, 2) SELECT count(*) AS tasks, bool_and(x = y) AS ranking_preserved FROM a",
}
SQL["bootstrap_ci"] = f"""WITH {_FRAME}, st AS MATERIALIZED (SELECT session_id, detector, count(*) FILTER (WHERE hit AND same) AS a, count(*) FILTER (WHERE hit) AS b FROM e WHERE good IS NOT NULL GROUP BY ALL),
  po AS (SELECT detector, round(sum(a) / sum(b), 6) AS estimate FROM st GROUP BY 1), r AS (SELECT detector, replicate, sum(a * k) / nullif(sum(b * k), 0) AS v FROM {_replicates("st", "b", "session_id", 200)} GROUP BY ALL)
  SELECT detector, any_value(estimate) AS estimate, {_QUANT} FROM po JOIN r USING (detector) WHERE v IS NOT NULL GROUP BY 1"""
SQL["popularity_stream"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"
ROWS_ONLY = ["feature_names", "prompt_inputs", "generated", "lambdarank_rerank", "importance_table"]
QUERIES = {n: globals()[n] for n in [*SQL, *ROWS_ONLY]}
