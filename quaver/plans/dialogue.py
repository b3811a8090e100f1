"""Queries over dialogue tasks that have an item: query memories by variant, source profiles, pools of other sessions, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import memory as M
from ..operators import ranking as K
from ..operators import registry as G
from ..operators import retrieval as R
from ..operators import sources as S
from ..operators import tasks as T
from .behaviour import VI, _expand, _segments, _top
from .retrieval import INDEX, _bm25, _hit_sql, _NG, _UNIT
from .store import stored
from .texts import _CT, _grams
from .views import ITEMS, NORM, PLAYS, VALUES, items, messages, plays, table, values


def told(s, d) -> DataFrame:
    """session_id, turn_number, user_id, label, query, train: user messages; each has an item by number, and names the one after it."""
    m = messages(s, d).where("role = 'user' and text is not null and trim(text) <> ''")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    label = 1 + (F.col("conv_id") * 31 + F.col("turn") * 7) % 200
    t = m.select(F.col("conv_id").alias("session_id"), n.alias("turn_number"), (1 + F.col("conv_id") % 150).alias("user_id"), label.alias("label"), "text", (F.col("conv_id") % 10 < 8).alias("train"))
    near = table(s, d, "part").select((F.col("p_partkey") - 1).alias("label"), "p_name", "p_brand")
    return t.join(near, "label").select("session_id", "turn_number", "user_id", "label", F.concat_ws(" ", "text", F.lit("like"), "p_name", F.lit("by"), "p_brand").alias("query"), "train")


def _past(t: DataFrame) -> DataFrame:
    """session_id, turn_number, item_id, recency of the items of a task's session before it."""
    h = t.select("session_id", F.col("turn_number").alias("at"), F.col("label").alias("item_id"))
    return t.select(*K.TASK).join(h, "session_id").where("at < turn_number").select(*K.TASK, "item_id", (F.col("turn_number") - F.col("at")).alias("recency"))


def _profiles(s, d) -> DataFrame:
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("user_id"), "c_mktsegment", "n_name")


def _seen(s, d) -> DataFrame:
    t = told(s, d)
    return M.views(t, _past(t), items(s, d), _profiles(s, d), ["c_mktsegment", "n_name"])


def memory_documents(s, d):
    v = _seen(s, d)
    out = None
    for variant in M.MEMORY:
        part = v.select(F.lit(variant).alias("variant"), *K.TASK, M.document(variant).alias("document"))
        out = part if out is None else out.unionAll(part)
    return out


def recent_item_text(s, d):
    return M.recent_item_text(_past(told(s, d)), items(s, d))


def merged_ngrams(s, d):
    return M.merged_ngrams(_seen(s, d), "history_music").withColumn("weight", F.round("weight", 6))


def _label_memory(variant: str):
    def run(s, d):
        v, seen = values(items(s, d)), _seen(s, d)
        train = seen.where("train")
        memory = S.label_memory_index(M.merged_ngrams(train, variant).select(*K.TASK, "ngram"), train.select(*K.TASK, "label"), K.TASK, v, S.value_index(v))
        return S.label_memory(M.merged_ngrams(seen.where("not train"), variant), memory, v.groupBy("item_id").agg(F.max("popularity").alias("popularity")), 100, K.TASK)

    return run


def _neighbor_memory(variant: str):
    def run(s, d):
        v, seen = values(items(s, d)), _seen(s, d)
        number = (F.col("session_id") * 1000 + F.col("turn_number")).alias("neighbor")
        train = seen.where("train").select(number, "label", M.document(variant).alias("text"))
        asked = seen.where("not train").select(*K.TASK, M.document(variant).alias("text"))
        found = R.Bm25(train, "neighbor", F.col("text")).top(asked, K.TASK, F.col("text"), 240).withColumnRenamed("item_id", "neighbor")
        return S.neighbor_memory(found, train.select("neighbor", "label"), v, S.value_index(v), 100, K.TASK)

    return run


# ---------------------------------------------------------------- profiles of sources


def _tasks(s, d) -> DataFrame:
    return told(s, d).where("not train").select((F.col("session_id") * 1000 + F.col("turn_number")).alias("q"), *K.TASK, "user_id", F.col("query").alias("text"))


def _sources(s, d) -> dict:
    """All sources that need no language model, over dialogue tasks keyed by q."""
    t, it = _tasks(s, d), items(s, d)
    v = values(it)
    index, key = S.value_index(v), ["q"]
    past = _past(told(s, d)).join(t.select(*K.TASK, "q"), K.TASK).select("q", "item_id", "recency")
    recent = M.recent_queries(told(s, d)).join(t, K.TASK, "right").select("q", F.concat_ws("\n", F.nullif(F.coalesce("recent", F.lit("")), F.lit("")), "text").alias("text"))
    counts = plays(s, d).where("train").groupBy("item_id").agg(F.count("*").alias("n"))
    by_value = v.select("field", "value", "item_id").join(counts, "item_id")
    held = lambda fields: R.Bm25(it.select("item_id", X.fields_text(fields).alias("doc")), "item_id", F.col("doc"))
    tags = F.array_join("tags", " ")
    texts = {"track_name": F.col("name"), "artist_name": F.col("artist"), "album_name": F.col("album")}
    base, whole, text_only, tag_only = ({"track_name": F.col("name"), "artist_name": F.col("artist")}, texts | {"tag_list": tags}, texts, {"tag_list": tags})
    search = lambda fields, asked: lambda n: held(fields).top(asked, key, F.col("text"), n)
    exact = lambda field: lambda n: R.exact_by_field(R.exact_hits(t, R.exact_index(v), key, F.col("text"), n, most=8), key, n).where(F.col("field") == field)

    def counted(field):
        def run(n):
            asked = S.contained_values(t, v.where(F.col("field") == field), key)
            return K.scored_top(asked.join(by_value.where(F.col("field") == field), ["field", "value"]).groupBy("q", "item_id").agg(F.sum("n").cast("double").alias("score")), n, key)

        return run

    def by_user(n):
        c = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment", "c_nationkey")
        sums = S.segment_counts(plays(s, d).where("train").join(c, "user_id", "left"), v, _segments())
        asked = t.select("q", "user_id").join(c, "user_id", "left").select("q", F.concat_ws("|", "c_mktsegment", "c_nationkey").alias("segment_nation"), F.col("c_mktsegment").alias("segment"), F.lit("all").alias("global"))
        return S.ladder(asked, sums, ["segment_nation", "segment", "global"], n, key)

    def by_past_artist(n):
        asked = past.join(v.where("field = 1").select("item_id", "field", "value"), "item_id").select("q", "field", "value").distinct()
        return K.scored_top(asked.join(by_value, ["field", "value"]).groupBy("q", "item_id").agg(F.sum("n").cast("double").alias("score")), n, key)

    e = table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")).where(V.is_valid(F.col("v")))

    def near(latest):
        def run(n):
            h = past.join(e, "item_id")
            q = h.groupBy("q").agg(F.min_by("v", "recency").alias("v0")) if latest else V.mean_of(key, h.withColumn("v", V.unit(F.col("v"))), "v", "v0")
            return R.cosine_top(q, e, key, n, query="v0")

        return run

    def fallback(n):
        return t.select("q").crossJoin(F.broadcast(K.popular(it, n))).select("q", "item_id", F.col("pop_rank").alias("rank"))

    return {
        "bm25_recent_turns": search(base, recent),
        "bm25_full_context": search(base, t),
        "metadata_bm25_text_full_context": search(text_only, recent),
        "metadata_bm25_tag_full_context": search(tag_only, recent),
        "metadata_bm25_text_current_user_turn": search(text_only, t),
        "metadata_bm25_tag_current_user_turn": search(tag_only, t),
        "metadata_bm25_full_context": search(whole, recent),
        "metadata_bm25_current_user_turn": search(whole, t),
        **{name: exact(k) for k, name in enumerate(G.EXACT)},
        "popular_by_artist_current": counted(1),
        "popular_by_tag_current": counted(3),
        "popular_by_user_age_country": by_user,
        "popular_by_history_artist": by_past_artist,
        "history_same_artist": lambda n: S.history_same(past, v, index, 1, n, key),
        "history_same_tag": lambda n: S.history_same(past, v, index, 3, n, key),
        "history_cf_mean": near(False),
        "history_recent_neighbors": near(True),
        "popularity_fallback": fallback,
    }


def _intents(s, d):
    return _tasks(s, d).select("q", X.intent(F.col("text")).alias("intent"))


def _held(s, d) -> dict:
    """The sources, each written once at its number of rows to fetch: profiles share them."""
    found = _sources(s, d)
    return {name: lambda n, name=name: stored(s, d, f"source-{name}-{n}", lambda: found[name](n).select("q", "item_id", "rank")) for name in found}


def _profile(profile: str):
    def run(s, d):
        return G.candidates(profile, _held(s, d), _intents(s, d), ["q"])

    return run


def four_corpora(s, d):
    """Four BM25 corpora over items: name and artist, all fields, fields without tags, and tags."""
    src = _sources(s, d)
    names = {"baseline": "bm25_full_context", "metadata": "metadata_bm25_current_user_turn", "metadata_text": "metadata_bm25_text_current_user_turn", "metadata_tag": "metadata_bm25_tag_current_user_turn"}
    out = None
    for corpus, name in names.items():
        part = src[name](30).select(F.lit(corpus).alias("corpus"), "q", "item_id", "rank", "score")
        out = part if out is None else out.unionAll(part)
    return out


def scored_once(s, d):
    """The same source over two views of a task: its first place and its largest score."""
    src = _sources(s, d)
    two = [src[n](50).select("q", F.lit("bm25").alias("source"), "item_id", "rank", "score") for n in ("bm25_full_context", "bm25_recent_turns")]
    return G.scored_once(two[0].unionAll(two[1]), ["q"])


def entity_activity(s, d):
    """Dialogue tasks with an item's name, artist, album or tag, and their number by field."""
    v, t = values(items(s, d)), _tasks(s, d)
    found = t.select("q", F.explode(X.phrases(F.col("text"))).alias("value")).join(v.select("field", "value").where("length(value) >= 3").distinct(), "value")
    return S.activity(t, found, ["q"], {0: "track", 1: "artist", 2: "album", 3: "tag"})


def public_music(s, d):
    return T.before_last_turn(plays(s, d).where("not train")).select("session_id", "turn_number", "item_id")


def cross_session_pools(s, d):
    """Every turn to evaluate against two pools: other public sessions, then training sessions; ties by first sight."""
    p = plays(s, d)
    tasks = p.where("not train").select("session_id", "turn_number", "user_id")
    return S.cross_session_pools(tasks, [T.before_last_turn(p.where("not train")), p.where("train")], 50)


def cross_session_padded(s, d):
    found = S.cross_session_pools(plays(s, d).where("not train").select("session_id", "turn_number", "user_id").where("turn_number = 1"), [plays(s, d).where("train")], 50)
    return K.padded(found, plays(s, d).where("not train and turn_number = 1"), K.popular(items(s, d), 150), 100)


def history_ids(s, d):
    """Items of a session's history: music messages by content, and ids that assistants name; a message is music or names an id by turn."""
    p = plays(s, d).where("not train")
    uuid = _uuid(F.md5(F.col("item_id").cast("string")))
    m = p.select("session_id", F.col("turn_number").alias("seq"), F.when(F.col("turn_number") % 2 == 1, "music").otherwise("assistant").alias("role"), F.when(F.col("turn_number") % 2 == 1, uuid).otherwise(F.concat(F.lit("try track_id:  "), F.upper(uuid), F.lit(", or not"))).alias("content"))
    return T.history_ids(m)


def _uuid(h):
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def item_lines(s, d):
    it = items(s, d)
    return it.select("item_id", X.item_line(F.col("item_id"), {"name": F.col("name"), "artist": F.col("artist"), "tags": F.array_join("tags", ", ")}).alias("line"))


def music_views(s, d):
    """Dialogue messages with each task's item as a music message behind it: music is told by the item's line, by the assistant."""
    t = told(s, d)
    m = t.select("session_id", (F.col("turn_number") * 2).alias("seq"), F.lit("user").alias("role"), F.col("query").alias("content"))
    music = t.select("session_id", (F.col("turn_number") * 2 + 1).alias("seq"), F.lit("music").alias("role"), F.col("label").cast("string").alias("content"))
    it = items(s, d)
    lines = it.select(F.col("item_id").cast("string").alias("item_id"), X.item_line(F.col("item_id"), {"name": F.col("name"), "artist": F.col("artist")}).alias("line"))
    return T.told_messages(m.unionAll(music), lines)


# ---------------------------------------------------------------- SQL

DT = """dt0 AS (SELECT conv_id AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS turn_number, 1 + conv_id % 150 AS user_id, 1 + (conv_id * 31 + turn * 7) % 200 AS label, text, conv_id % 10 < 8 AS train FROM conversations WHERE role = 'user' AND text IS NOT NULL AND trim(text) <> ''),
  dt AS MATERIALIZED (SELECT session_id, turn_number, user_id, label, concat_ws(' ', text, 'like', p_name, 'by', p_brand) AS query, train FROM dt0 JOIN part ON p_partkey - 1 = label),
  past AS MATERIALIZED (SELECT a.session_id, a.turn_number, b.label AS item_id, a.turn_number - b.turn_number AS recency FROM dt a JOIN dt b ON a.session_id = b.session_id AND b.turn_number < a.turn_number)"""
_MUSIC = "mu AS (SELECT session_id, turn_number, string_agg(concat_ws(' ', name, artist, album, array_to_string(tags, ' ')), chr(10) ORDER BY recency DESC) AS music FROM past JOIN items USING (item_id) WHERE recency <= 2 GROUP BY 1, 2)"
_RECENT = "re AS (SELECT a.session_id, a.turn_number, string_agg(b.query, chr(10) ORDER BY b.turn_number) AS recent FROM dt a JOIN dt b ON a.session_id = b.session_id AND b.turn_number < a.turn_number AND b.turn_number >= a.turn_number - 2 GROUP BY 1, 2)"
_SEEN = f"{DT}, {_MUSIC}, {_RECENT}, pf AS (SELECT c_custkey AS user_id, concat_ws(' ', coalesce(c_mktsegment, ''), n_name) AS profile FROM customer JOIN nation ON c_nationkey = n_nationkey), seen AS MATERIALIZED (SELECT dt.*, coalesce(recent, '') AS recent, coalesce(music, '') AS music, coalesce(profile, '') AS profile FROM dt LEFT JOIN re USING (session_id, turn_number) LEFT JOIN mu USING (session_id, turn_number) LEFT JOIN pf USING (user_id))"
_KEY = "session_id, turn_number"


def _doc(variant: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(f"nullif({c}, '')" for c in ("query", *M.MEMORY[variant])) + ")"


def _merged(variant: str) -> str:
    parts = " UNION ALL ".join(f"SELECT {_KEY}, train, label, CAST({M.VIEW_WEIGHTS[c]} AS DOUBLE) AS v, {_CT.format(c)} AS w FROM seen" for c in ("query", *M.MEMORY[variant]))
    grams = " UNION ALL ".join(f"SELECT {_KEY}, train, label, unnest({_grams('w', n)}) AS ngram, CAST({w} AS DOUBLE) * v AS weight FROM parts" for n, w in X.NGRAM_WEIGHTS.items())
    return f"parts AS MATERIALIZED ({parts}), mg AS MATERIALIZED (SELECT {_KEY}, train, label, ngram, max(weight) AS weight FROM ({grams}) GROUP BY ALL)"


def _label_memory_sql(variant: str) -> str:
    return f"""WITH {ITEMS}, {VALUES}, {VI}, {_SEEN}, {_merged(variant)}, tg AS (SELECT session_id * 1000 + turn_number AS id, ngram, label FROM mg WHERE train),
      df AS (SELECT ngram, count(*) AS df, ln(((SELECT count(DISTINCT id) FROM tg) + 1.0) / (count(*) + 1.0)) + 1 AS idf FROM tg GROUP BY 1 HAVING count(*) >= 2),
      led AS MATERIALIZED (SELECT ngram, df, idf, label FROM tg JOIN df USING (ngram)),
      di AS (SELECT * FROM (SELECT ngram, idf, label AS item_id, CAST(count(*) AS DOUBLE) AS value FROM led GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY ngram ORDER BY value DESC, item_id) <= 200),
      ct AS (SELECT * FROM (SELECT ngram, idf, field, value AS v, count(*) AS n FROM led JOIN vals ON item_id = label WHERE df >= 10 AND field IN (1, 3) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY ngram, field ORDER BY n DESC, v) <= 200),
      ne AS (SELECT * FROM (SELECT ngram, idf, ct.field AS field, item_id, round(sum(n / log2(pop_rank + 2)), 6) AS value FROM ct JOIN vi ON vi.field = ct.field AND vi.value = ct.v WHERE (ct.field = 1 AND pop_rank <= 120) OR (ct.field = 3 AND pop_rank <= 80) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY ngram, field ORDER BY value DESC, item_id) <= 300),
      me AS (SELECT ngram, idf, item_id, 1.0 AS k, value FROM di UNION ALL SELECT ngram, idf, item_id, CASE field WHEN 1 THEN 0.45 ELSE 0.12 END, value FROM ne)
      """ + _top(f"SELECT {_KEY}, item_id, sum(weight * idf * k * value) AS score FROM mg JOIN me USING (ngram) WHERE NOT train GROUP BY ALL", _KEY, 100)


def _neighbor_memory_sql(variant: str) -> str:
    bm = _bm25(f"SELECT session_id * 1000 + turn_number AS item_id, {_doc(variant)} AS text FROM seen WHERE train", f"SELECT {_KEY}, {_doc(variant)} AS text FROM seen WHERE NOT train", _KEY, 240)
    return f"WITH {ITEMS}, {VALUES}, {VI}, {_SEEN}, labels AS (SELECT DISTINCT label FROM seen WHERE train), {_expand(1.0, 0.45, 0.12 * 0.25, 120, 24)}, nb AS ({bm}), nl AS (SELECT session_id * 1000 + turn_number AS item_id, label FROM seen WHERE train) " + _top(f"SELECT {_KEY}, ex.item_id, sum(ln(1 + nb.score) / log2(nb.rank + 2) * ex.weight) AS score FROM nb JOIN nl USING (item_id) JOIN ex USING (label) WHERE nb.score > 0 GROUP BY ALL", _KEY, 100)


_TQ = f"{DT}, {_RECENT}, qs AS MATERIALIZED (SELECT session_id * 1000 + turn_number AS q, {_KEY}, user_id, query AS text FROM dt WHERE NOT train), rq AS MATERIALIZED (SELECT q, concat_ws(chr(10), nullif(coalesce(recent, ''), ''), text) AS text FROM qs LEFT JOIN re USING (session_id, turn_number)), qp AS MATERIALIZED (SELECT q, item_id, recency FROM past JOIN qs USING (session_id, turn_number))"
_LINES = {f: f"'{f}: ' || lower({c})" for f, c in (("track_name", "name"), ("artist_name", "artist"), ("album_name", "album"), ("tag_list", "array_to_string(tags, ' ')"))}


def _search(fields: tuple[str, ...], asked: str, n: int) -> str:
    docs = "SELECT item_id, concat_ws(chr(10), " + ", ".join(_LINES[f] for f in fields) + ") AS text FROM items"
    return f"SELECT q, item_id, rank, score FROM ({_bm25(docs, f'SELECT q, text FROM {asked}', 'q', n)})"


_TEXTS = ("track_name", "artist_name", "album_name")
_COUNTED = "SELECT q, item_id, rank FROM ({0})"


def _source_sql(name: str) -> str:
    """SELECT q, item_id, rank of a source, given items, vals, idx, vi, plays, qs, rq, qp, hN (exact hits) and embeddings."""
    n = G.FETCH[name]
    if "bm25" in name:
        fields = _TEXTS[:2] if name in G.TEXT else _TEXTS if "_text_" in name else ("tag_list",) if "_tag_" in name else (*_TEXTS, "tag_list")
        asked = "qs" if name == "bm25_full_context" or name.endswith("current_user_turn") else "rq"
        return f"SELECT q, item_id, rank FROM ({_search(fields, asked, n)})"
    if name in G.EXACT:
        return f"SELECT q, item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY place, item_id) AS INT) AS rank FROM (SELECT q, item_id, min(ROW(ngram_rank, pop_rank)) AS place FROM hx WHERE field = {G.EXACT.index(name)} GROUP BY ALL) QUALIFY rank <= {n}"
    n_by = "(SELECT value, field, item_id, n FROM vals JOIN (SELECT item_id, count(*) AS n FROM plays WHERE train GROUP BY 1) USING (item_id))"
    if name in ("popular_by_artist_current", "popular_by_tag_current"):
        field = 1 if "artist" in name else 3
        return _COUNTED.format(_top(f"SELECT q, item_id, CAST(sum(n) AS DOUBLE) AS score FROM (SELECT DISTINCT q, field, value FROM qs, vals WHERE field = {field} AND contains({NORM.format('text')}, value)) JOIN {n_by} USING (field, value) GROUP BY ALL", "q", n, False))
    if name == "popular_by_history_artist":
        return _COUNTED.format(_top(f"SELECT q, item_id, CAST(sum(n) AS DOUBLE) AS score FROM (SELECT DISTINCT q, field, value FROM qp JOIN vals USING (item_id) WHERE field = 1) JOIN {n_by} USING (field, value) GROUP BY ALL", "q", n, False))
    if name == "popular_by_user_age_country":
        return f"""SELECT q, item_id, rank FROM (WITH pr AS (SELECT p.*, c_mktsegment, c_nationkey FROM plays p LEFT JOIN customer ON c_custkey = user_id WHERE train),
          seg AS MATERIALIZED (SELECT 'global' AS t, 'all' AS sg, item_id, count(*) AS n FROM pr GROUP BY 3 UNION ALL SELECT 'segment', c_mktsegment, item_id, count(*) FROM pr WHERE c_mktsegment <> '' GROUP BY 2, 3 UNION ALL SELECT 'segment_nation', concat_ws('|', c_mktsegment, c_nationkey), item_id, count(*) FROM pr GROUP BY 2, 3),
          us AS (SELECT q, c_mktsegment, c_nationkey FROM qs LEFT JOIN customer ON c_custkey = user_id), lv AS (SELECT q, 0 AS level, 'segment_nation' AS t, concat_ws('|', c_mktsegment, c_nationkey) AS sg FROM us UNION ALL SELECT q, 1, 'segment', c_mktsegment FROM us UNION ALL SELECT q, 2, 'global', 'all' FROM us),
          b AS (SELECT q, t, sg FROM lv SEMI JOIN seg USING (t, sg) QUALIFY row_number() OVER (PARTITION BY q ORDER BY level) = 1), l AS (SELECT t, sg, item_id, CAST(row_number() OVER (PARTITION BY t, sg ORDER BY n DESC, item_id) AS INT) AS rank FROM seg QUALIFY rank <= {n}) SELECT q, item_id, rank FROM b JOIN l USING (t, sg))"""
    if name in G.HISTORY[:2]:
        field = 1 if "artist" in name else 3
        return f"""SELECT q, item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY place, item_id) AS INT) AS rank FROM (SELECT q, item_id, min(ROW(-seen, value, pop_rank)) AS place FROM
          (SELECT q, value, max(recency) AS seen FROM qp JOIN vals USING (item_id) WHERE field = {field} GROUP BY ALL) JOIN vi USING (value) WHERE field = {field} AND pop_rank <= {n} GROUP BY ALL) QUALIFY rank <= {n}"""
    if name in ("history_cf_mean", "history_recent_neighbors"):
        q = "SELECT q, min_by(embedding, recency) AS v0 FROM qp JOIN embeddings ON vec_id = item_id GROUP BY q" if name == "history_recent_neighbors" else f"SELECT q, list(x ORDER BY pos) AS v0 FROM (SELECT q, pos, avg(v[pos]) AS x FROM (SELECT q, {_UNIT.format('embedding')} AS v FROM qp JOIN embeddings ON vec_id = item_id), (SELECT unnest(range(1, 65)) AS pos) GROUP BY ALL) GROUP BY ALL"
        return f"SELECT q, item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, item_id) AS INT) AS rank FROM (SELECT q, item_id, round(list_dot_product(a, b), 6) AS score FROM (SELECT q, {_UNIT.format('v0')} AS a FROM ({q})), (SELECT vec_id AS item_id, {_UNIT.format('embedding')} AS b FROM embeddings)) QUALIFY rank <= {n}"
    return f"SELECT q, item_id, pop_rank AS rank FROM qs, (SELECT item_id, row_number() OVER (ORDER BY popularity DESC, item_id) AS pop_rank FROM items) WHERE pop_rank <= {n}"


_HAVE = {*G.TEXT, *G.WHOLE, *G.METADATA, *G.EXACT, *G.SEGMENT, *G.HISTORY, "popularity_fallback"} - {"history_audio_mean"}
_TB = f"WITH {ITEMS}, {VALUES}, {INDEX}, {VI}, {PLAYS}, {_TQ}, {_NG}, {_hit_sql('hx', 500)}"


def _profile_sql(profile: str) -> str:
    from .texts import SQL as TEXT_SQL

    intent = TEXT_SQL["intent_bucket"]
    case = intent[intent.index("CASE") : intent.rindex("END") + 3]
    parts = []
    for order, name in enumerate(n for n in G.PROFILES[profile] if n in _HAVE):
        gate = f" AND q IN (SELECT q FROM itn WHERE intent IN ({', '.join(repr(x) for x in G.ASKED[name])}))" if profile in G.GATED and name in G.ASKED else ""
        parts.append(f"SELECT '{name}' AS source, {order} AS source_order, q, item_id, CAST(rank AS INT) AS rank FROM ({_source_sql(name)}) WHERE rank <= {G.KEEP[name]}{gate}")
    return f"{_TB}, itn AS MATERIALIZED (SELECT q, {case} AS intent FROM qs) " + " UNION ALL ".join(parts)


_CROSS = """tk AS ({tasks}), pl AS ({pools}), fr AS (SELECT user_id, pool, session_id AS s2, item_id, min(turn_number) AS at FROM pl WHERE user_id IS NOT NULL GROUP BY ALL),
  xs AS (SELECT t.session_id, t.turn_number, f.item_id, CAST(count(*) AS DOUBLE) AS score, min(ROW(f.pool, f.s2, f.at)) AS first FROM tk t JOIN fr f ON f.user_id = t.user_id AND f.s2 <> t.session_id GROUP BY ALL),
  xr AS (SELECT session_id, turn_number, item_id, CAST(row_number() OVER (PARTITION BY session_id, turn_number ORDER BY score DESC, first) AS INT) AS rank, score FROM xs QUALIFY rank <= 50)"""
_PUBLIC = "SELECT * EXCLUDE (last) FROM (SELECT *, max(turn_number) OVER (PARTITION BY session_id) AS last FROM plays WHERE NOT train) WHERE turn_number < last"
_UUID = "concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32])"
SQL = {
    "memory_documents": f"WITH {ITEMS}, {_SEEN} " + " UNION ALL ".join(f"SELECT '{v}' AS variant, {_KEY}, {_doc(v)} AS document FROM seen" for v in M.MEMORY),
    "recent_item_text": f"WITH {ITEMS}, {DT}, {_MUSIC} SELECT * FROM mu",
    "merged_ngrams": f"WITH {ITEMS}, {_SEEN}, {_merged('history_music')} SELECT {_KEY}, ngram, round(weight, 6) AS weight FROM mg",
    "four_corpora": f"{_TB} " + " UNION ALL ".join(f"SELECT '{c}' AS corpus, q, item_id, rank, score FROM ({_search(f, 'qs', 30)})" for c, f in (("baseline", _TEXTS[:2]), ("metadata", (*_TEXTS, "tag_list")), ("metadata_text", _TEXTS), ("metadata_tag", ("tag_list",)))),
    "scored_once": f"{_TB} SELECT q, 'bm25' AS source, item_id, min(rank) AS rank, max(score) AS score FROM ({_search(_TEXTS[:2], 'qs', 50)} UNION ALL {_search(_TEXTS[:2], 'rq', 50)}) GROUP BY ALL",
    "entity_activity": f"""{_TB}, ea AS MATERIALIZED (SELECT DISTINCT q, field FROM ng JOIN vals USING (value) WHERE length(value) >= 3)
      SELECT count(*) AS tasks, CAST((SELECT count(DISTINCT q) FROM ea) AS BIGINT) AS active, round((SELECT count(DISTINCT q) FROM ea) / count(*), 6) AS active_rate, """
    + ", ".join(f"CAST((SELECT count(*) FROM ea WHERE field = {k}) AS BIGINT) AS active_{n}" for k, n in enumerate(("track", "artist", "album", "tag")))
    + " FROM qs",
    "public_music": f"WITH {PLAYS} SELECT session_id, turn_number, item_id FROM ({_PUBLIC})",
    "cross_session_pools": f"WITH {PLAYS}, {_CROSS.format(tasks='SELECT session_id, turn_number, user_id FROM plays WHERE NOT train', pools=f'SELECT 0 AS pool, user_id, session_id, turn_number, item_id FROM ({_PUBLIC}) UNION ALL SELECT 1, user_id, session_id, turn_number, item_id FROM plays WHERE train')} SELECT * FROM xr",
    "cross_session_padded": f"""WITH {PLAYS}, {ITEMS}, {_CROSS.format(tasks='SELECT session_id, turn_number, user_id FROM plays WHERE NOT train AND turn_number = 1', pools='SELECT 0 AS pool, user_id, session_id, turn_number, item_id FROM plays WHERE train')},
      pop AS (SELECT item_id, row_number() OVER (ORDER BY popularity DESC, item_id) AS pop_rank FROM items QUALIFY pop_rank <= 150)
      SELECT session_id, turn_number, item_id, CAST(place AS INT) AS rank, is_pad FROM (SELECT *, row_number() OVER (PARTITION BY session_id, turn_number ORDER BY is_pad, r, item_id) AS place FROM (SELECT session_id, turn_number, item_id, rank AS r, false AS is_pad FROM xr
        UNION ALL SELECT t.session_id, t.turn_number, pop.item_id, pop_rank, true FROM tk t, pop WHERE NOT EXISTS (SELECT 1 FROM xr WHERE xr.session_id = t.session_id AND xr.turn_number = t.turn_number AND xr.item_id = pop.item_id))) WHERE place <= 100""",
    "history_ids": f"WITH {PLAYS} SELECT session_id, turn_number AS seq, CASE WHEN turn_number % 2 = 1 THEN {_UUID} ELSE upper({_UUID}) END AS item_id FROM (SELECT *, md5(CAST(item_id AS VARCHAR)) AS h FROM plays WHERE NOT train)",
    "item_lines": f"WITH {ITEMS} SELECT item_id, 'track_id: ' || item_id || ', name: ' || lower(name) || ', artist: ' || lower(artist) || ', tags: ' || lower(array_to_string(tags, ', ')) AS line FROM items",
    "music_views": f"WITH {ITEMS}, {DT} SELECT session_id, turn_number * 2 AS seq, 'user' AS role, query AS content FROM dt UNION ALL SELECT session_id, turn_number * 2 + 1, 'assistant', 'track_id: ' || label || ', name: ' || lower(name) || ', artist: ' || lower(artist) FROM dt JOIN items ON item_id = label",
}
QUERIES = {n: globals()[n] for n in SQL}
for _v in list(M.MEMORY)[1:]:
    QUERIES[f"label_memory_{_v}"], SQL[f"label_memory_{_v}"] = _label_memory(_v), _label_memory_sql(_v)
for _v in ("current", "recent_profile", "history_music"):
    QUERIES[f"neighbor_memory_{_v}"], SQL[f"neighbor_memory_{_v}"] = _neighbor_memory(_v), _neighbor_memory_sql(_v)
for _v in ("B", "D", "G"):
    QUERIES[f"candidates_{_v}"], SQL[f"candidates_{_v}"] = _profile(_v), _profile_sql(_v)
