"""Queries on text functions and dialogue tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import tasks as T
from .views import NORM, PLAYS, items, messages, plays, table


def _sql_list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def dialogue(s: SparkSession, d: str) -> DataFrame:
    return messages(s, d).select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def norm_text(s, d):
    return table(s, d, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("norm"))


def content_tokens(s, d):
    return messages(s, d).select("conv_id", "turn", F.posexplode(X.content_tokens(F.col("text"))).alias("pos", "token"))


def phrase_ngrams(s, d):
    return messages(s, d).where("role = 'user'").select("conv_id", "turn", F.explode(X.phrases(F.col("text"))).alias("phrase"))


def weighted_ngrams(s, d):
    """Query n-grams of the current message and, at 0.55, of the two user messages before; the larger weight wins."""
    t = T.recent_user_text(dialogue(s, d))
    now = t.select("session_id", "seq", F.inline(X.weighted_ngrams(F.col("query"))))
    old = t.select("session_id", "seq", F.inline(X.weighted_ngrams(F.col("recent"), 0.55)))
    return now.unionAll(old).groupBy("session_id", "seq", "ngram").agg(F.round(F.max("weight"), 6).alias("weight"))


def key_validity(s, d):
    p = table(s, d, "part")
    keys = p.select(F.lit(False).alias("tag"), X.normalize_text(F.col("p_name")).alias("key")).unionAll(p.select(F.lit(True), F.explode(F.split(X.normalize_text(F.col("p_name")), " "))))
    keys = keys.unionAll(messages(s, d).select(F.lit(False), F.explode(F.split(X.normalize_text(F.col("text")), " "))))
    return keys.where("key <> ''").distinct().select("tag", "key", X.key_is_valid(F.col("key"), F.col("tag")).alias("valid"))


def intent_bucket(s, d):
    return messages(s, d).select("conv_id", "turn", X.intent(F.col("text")).alias("intent"))


def detector_flags(s, d):
    return messages(s, d).select("conv_id", "turn", *(F.col("text").rlike(p).alias(n) for n, p in X.DETECTORS.items()))


def style_bucket(s, d):
    return table(s, d, "documents").select("doc_id", X.style_bucket(F.col("doc_id").cast("string")).alias("bucket"))


def distinct2(s, d):
    """By role: distinct word bigrams over all, texts whose first five words are another's too, and apologies."""
    t = messages(s, d).select("role", F.col("text"), F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)).alias("w"))
    grams = t.select("role", F.explode(X.ngrams(F.col("w"), 2)).alias("g")).groupBy("role", "g").agg(F.count("*").alias("n"))
    a = grams.groupBy("role").agg(F.round(F.count("*") / F.sum("n"), 6).alias("distinct2"), F.sum("n").alias("bigrams"))
    opened = t.groupBy("role", F.array_join(F.slice("w", 1, 5), " ").alias("o")).agg(F.count("*").alias("n"), F.sum(F.lower("text").rlike(X.APOLOGY).cast("long")).alias("sorry"))
    b = opened.groupBy("role").agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated_openings"), F.sum("sorry").alias("apologies"))
    return b.join(a, "role", "left")


def response_features(s, d):
    """By role: surface features of the texts."""
    t = messages(s, d).select("role", "text", F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_']+)"), F.lit(1)).alias("w"))
    opening = F.lower(F.array_join(F.slice("w", 1, 5), " "))
    return t.groupBy("role").agg(
        F.round(F.avg(F.size("w")), 6).alias("mean_words"),
        F.round(F.avg(F.rtrim("text").endswith("?").cast("int")), 6).alias("question_end_rate"),
        F.round(F.avg(F.regexp_count("text", F.lit("!"))), 6).alias("exclamation_per_response"),
        F.round(F.avg(F.col("text").rlike(X.SORRY).cast("int")), 6).alias("apology_rate"),
        F.round(F.avg(F.regexp_count("text", F.lit(r"[.!?]+(?:\s|$)"))), 6).alias("mean_sentences"),
        F.round(F.countDistinct(F.when(F.size("w") > 0, opening)) / F.count("*"), 6).alias("opening_unique_rate"),
    )


def tag_clean(s, d):
    tags = F.concat(F.split("p_name", " "), F.array("p_type", "p_brand", F.upper("p_type"), F.concat(F.lit("90s "), F.col("p_type")), F.lit("x7y")))
    return table(s, d, "part").select("p_partkey", F.array_join(X.clean_tags(tags), ", ").alias("tags"))


def postclean(s, d):
    """Texts dressed with labels, emphasis and quotes, and undressed again."""
    dressed = F.concat(F.lit("Final Response: ANSWER:  \"**"), F.left("text", F.lit(20)), F.lit("** "), F.col("text"), F.lit('" '))
    return messages(s, d).select("conv_id", "turn", X.postclean(dressed).alias("clean"))


def fallback_text(s, d):
    return items(s, d).select("item_id", X.fallback_response(F.col("name"), F.when(F.col("popularity") > 25, F.col("artist"))).alias("response"))


def text_hash(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(X.squeeze_blanks(F.col("text")), 256).alias("sha256"), F.md5("text").alias("md5"))


def release_year(s, d):
    o = table(s, d, "orders")
    return o.select("o_orderkey", X.release_year(F.col("o_orderpriority"), F.date_format("o_orderdate", "'on' dd.MM.yyyy")).alias("year"))


def item_text(s, d):
    """Index documents of items, and how many of their fields are not empty."""
    p = table(s, d, "part")
    fields = {"name": F.col("p_name"), "brand": F.col("p_brand"), "type": F.when(F.col("p_size") > 5, F.col("p_type"))}
    n = sum((F.length(F.coalesce(v, F.lit(""))) > 0).cast("int") for v in fields.values())
    return p.select("p_partkey", X.fields_text(fields).alias("document"), n.alias("n_fields"))


def task_explode(s, d):
    return T.tasks(dialogue(s, d))


def nested_tasks(s, d):
    """Messages through the nested and the parallel form of sessions and back."""
    n = T.nest(dialogue(s, d))
    p = n.select("session_id", F.transform("conversations", lambda m: m.role).alias("role"), F.transform("conversations", lambda m: m.content).alias("content"))
    return T.from_parallel(p)


def query_views(s, d):
    return T.query_views(dialogue(s, d))


def recent_user_text(s, d):
    return T.recent_user_text(dialogue(s, d))


def last_turn_tasks(s, d):
    return T.last_message(dialogue(s, d))


def history_items(s, d):
    """Items of each session's turns by recency at its end."""
    from pyspark.sql import Window

    p = plays(s, d)
    return p.select("session_id", "item_id", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn_number"))).alias("recency"))


def exclusion_sets(s, d):
    return T.exclusions(plays(s, d)).groupBy("session_id", "turn_number").agg(F.count("*").alias("n_excluded"), F.sum("item_id").alias("checksum"))


_D = "SELECT conv_id AS session_id, turn AS seq, role, text AS content FROM conversations"
_U = f"SELECT session_id, seq, content AS query, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS turn_number FROM ({_D}) WHERE role = 'user' AND trim(content) <> ''"
_CT = f"list_filter(string_split({NORM}, ' '), lambda t: t <> '' AND t NOT IN {_sql_list(X.QUERY_STOPWORDS)} AND (length(t) >= 3 OR regexp_matches(t, '[0-9]')))"
_RECENT = f"""u AS ({_U}), rec AS (SELECT t.session_id, t.seq, t.query, coalesce(string_agg(u2.query, ' ' ORDER BY u2.turn_number), '') AS recent
  FROM u t LEFT JOIN u u2 ON u2.session_id = t.session_id AND u2.turn_number < t.turn_number AND u2.turn_number >= t.turn_number - 2 GROUP BY ALL)"""


def _grams(tokens: str, n: int) -> str:
    return f"list_transform(range(1, len({tokens}) - {n} + 2), lambda i: array_to_string(list_slice({tokens}, i, i + {n} - 1), ' '))"


_WG = " UNION ALL ".join(f"SELECT session_id, seq, unnest({_grams('w', n)}) AS ngram, {w} * v AS weight FROM ct" for n, w in X.NGRAM_WEIGHTS.items())
_INTENT = "CASE " + " ".join(f"WHEN regexp_matches({NORM.format('text')}, {_quoted(p)}) THEN '{n}'" for n, p in X.INTENTS.items()) + " ELSE 'ambiguous' END"
_VALID = f"""CASE WHEN len(string_split(key, ' ')) = 1 THEN key NOT IN {_sql_list(X.KEY_STOPWORDS)} AND (length(key) >= CASE WHEN tag THEN 3 ELSE 4 END OR (length(key) >= 2 AND regexp_matches(key, '[0-9]')))
  ELSE length(array_to_string(list_filter(string_split(key, ' '), lambda t: t NOT IN {_sql_list(X.KEY_STOPWORDS)}), '')) >= 4 END"""
_POST = "trim(c)"
for _ in range(3):
    _POST = f"trim(regexp_replace({_POST}, {_quoted(X.SCAFFOLD)}, ''))"
_POST = rf"regexp_replace(regexp_replace({_POST}, '\*\*([^*\n]+)\*\*', '\1', 'g'), '\*([^*\n]+)\*', '\1', 'g')"
_TAGFIT = f"length(t) BETWEEN 2 AND 40 AND len(list_filter(string_split(lower(t), ' '), lambda w: NOT (regexp_matches(w, {_quoted(X.ERA_TOKEN)}) OR regexp_matches(w, {_quoted(X.WORD_TOKEN)})))) = 0"

SQL = {
    "norm_text": f"SELECT doc_id, {NORM.format('text')} AS norm FROM documents",
    "content_tokens": f"SELECT conv_id, turn, CAST(i - 1 AS INT) AS pos, w[i] AS token FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id, turn, {_CT.format('text')} AS w FROM conversations))",
    "phrase_ngrams": "SELECT DISTINCT conv_id, turn, phrase FROM ("
    + " UNION ALL ".join(f"SELECT conv_id, turn, unnest({_grams('w', n)}) AS phrase FROM w" for n in range(1, 9))
    + ") WHERE length(phrase) >= 3",
    "weighted_ngrams": f"WITH {_RECENT}, ct AS (SELECT session_id, seq, {_CT.format('query')} AS w, 1.0 AS v FROM rec UNION ALL SELECT session_id, seq, {_CT.format('recent')}, 0.55 FROM rec) SELECT session_id, seq, ngram, round(CAST(max(weight) AS DOUBLE), 6) AS weight FROM ({_WG}) GROUP BY ALL",
    "key_validity": f"""SELECT tag, key, {_VALID} AS valid FROM (SELECT DISTINCT * FROM (
      SELECT false AS tag, {NORM.format("p_name")} AS key FROM part UNION ALL SELECT true, unnest(string_split({NORM.format("p_name")}, ' ')) FROM part
      UNION ALL SELECT false, unnest(string_split({NORM.format("text")}, ' ')) FROM conversations) WHERE key <> '')""",
    "intent_bucket": f"SELECT conv_id, turn, {_INTENT} AS intent FROM conversations",
    "detector_flags": "SELECT conv_id, turn, " + ", ".join(f"regexp_matches(text, {_quoted(p)}) AS {n}" for n, p in X.DETECTORS.items()) + " FROM conversations",
    "style_bucket": "SELECT doc_id, CAST(CAST('0x' || right(md5(CAST(doc_id AS VARCHAR)), 1) AS INT) % 8 AS INT) AS bucket FROM documents",
    "distinct2": rf"""WITH t AS (SELECT role, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM conversations),
      g AS (SELECT role, g, count(*) AS n FROM (SELECT role, unnest({_grams("w", 2)}) AS g FROM t) GROUP BY ALL),
      a AS (SELECT role, round(count(*) / sum(n), 6) AS distinct2, CAST(sum(n) AS BIGINT) AS bigrams FROM g GROUP BY role),
      o AS (SELECT role, array_to_string(list_slice(w, 1, 5), ' ') AS o, count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(text), {_quoted(X.APOLOGY)})) AS sorry FROM t GROUP BY 1, 2)
      SELECT o.role, CAST(coalesce(sum(o.n) FILTER (WHERE o.n > 1), 0) AS BIGINT) AS repeated_openings, CAST(sum(sorry) AS BIGINT) AS apologies, any_value(a.distinct2) AS distinct2, any_value(a.bigrams) AS bigrams FROM o LEFT JOIN a USING (role) GROUP BY o.role""",
    "response_features": rf"""WITH t AS (SELECT role, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}_'']+') AS w FROM conversations)
      SELECT role, round(avg(len(w)), 6) AS mean_words, round(avg(CAST(ends_with(rtrim(text), '?') AS INT)), 6) AS question_end_rate, round(avg(length(text) - length(replace(text, '!', ''))), 6) AS exclamation_per_response,
      round(avg(CAST(regexp_matches(text, {_quoted(X.SORRY)}) AS INT)), 6) AS apology_rate, round(avg(len(regexp_extract_all(text, '[.!?]+(?:\s|$)'))), 6) AS mean_sentences,
      round(count(DISTINCT CASE WHEN len(w) > 0 THEN lower(array_to_string(list_slice(w, 1, 5), ' ')) END) / count(*), 6) AS opening_unique_rate FROM t GROUP BY role""",
    "tag_clean": f"""WITH t AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), [p_type, p_brand, upper(p_type), '90s ' || p_type, 'x7y']) AS tags FROM part),
      f AS (SELECT p_partkey, list_filter(list_transform(tags, lambda t: trim(t)), lambda t: {_TAGFIT}) AS f FROM t)
      SELECT p_partkey, array_to_string(list_slice(list_filter(f, lambda t, i: NOT list_contains(list_transform(list_slice(f, 1, i - 1), lambda s: lower(s)), lower(t))), 1, 8), ', ') AS tags FROM f""",
    "postclean": f"""SELECT conv_id, turn, CASE WHEN length(x) >= 2 AND left(x, 1) IN ('"', '''', '“') AND right(x, 1) IN ('"', '''', '”') THEN trim(substr(x, 2, length(x) - 2)) ELSE x END AS clean
      FROM (SELECT conv_id, turn, {_POST} AS x FROM (SELECT conv_id, turn, 'Final Response: ANSWER:  "**' || left(text, 20) || '** ' || text || '" ' AS c FROM conversations))""",
    "fallback_text": """SELECT p_partkey AS item_id, 'I think you''ll really enjoy "' || coalesce(nullif(trim(p_name), ''), 'this track') || '"' || coalesce(' by ' || CASE WHEN n > 25 THEN nullif(trim(p_brand), '') END, '') ||
      ' — it lines up well with what you''re looking for. Want a few more in a similar vein?' AS response FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""",
    "text_hash": r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS sha256, md5(text) AS md5 FROM documents",
    "release_year": "SELECT o_orderkey, CAST(coalesce(nullif(regexp_extract(o_orderpriority, '((?:19|20)[0-9]{2})', 1), ''), nullif(regexp_extract(strftime(o_orderdate, 'on %d.%m.%Y'), '((?:19|20)[0-9]{2})', 1), ''), '0') AS INT) AS year FROM orders",
    "item_text": "SELECT p_partkey, concat_ws(chr(10), 'name: ' || lower(p_name), 'brand: ' || lower(p_brand), CASE WHEN p_size > 5 THEN 'type: ' || lower(p_type) END) AS document, CAST(2 + (p_size > 5)::INT AS INT) AS n_fields FROM part",
    "task_explode": f"SELECT session_id, seq, query, CAST(turn_number AS INT) AS turn_number FROM ({_U})",
    "nested_tasks": f"SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS INT) AS seq, role, content FROM ({_D})",
    "query_views": f"""WITH u AS ({_U}), h AS (SELECT session_id, seq AS pos, role, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'assistant' END || ': ' || coalesce(content, '') AS line FROM ({_D})),
      j AS (SELECT u.session_id, u.seq, u.query, h.pos, h.role, h.line, row_number() OVER (PARTITION BY u.session_id, u.seq ORDER BY pos DESC) AS back FROM u JOIN h ON h.session_id = u.session_id AND h.pos <= u.seq)
      SELECT session_id, seq, query, string_agg(line, chr(10) ORDER BY pos) AS full, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE back <= 5) AS recent, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE role IN ('user', 'assistant')) AS dialogue FROM j GROUP BY 1, 2, 3""",
    "recent_user_text": f"WITH {_RECENT} SELECT * FROM rec",
    "last_turn_tasks": f"SELECT session_id, max(seq) AS seq, max_by(content, seq) AS query, max_by(role, seq) AS role, max(seq) + 1 AS next_turn FROM ({_D}) GROUP BY 1",
    "history_items": f"WITH {PLAYS} SELECT session_id, item_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn_number DESC) AS INT) AS recency FROM plays",
    "exclusion_sets": f"WITH {PLAYS} SELECT session_id, turn_number, count(*) AS n_excluded, CAST(sum(item_id) AS BIGINT) AS checksum FROM (SELECT DISTINCT a.session_id, a.turn_number, b.item_id FROM plays a JOIN plays b ON b.session_id = a.session_id AND b.turn_number < a.turn_number) GROUP BY 1, 2",
}
SQL["phrase_ngrams"] = f"WITH w AS (SELECT conv_id, turn, list_filter(string_split({NORM.format('text')}, ' '), lambda t: t <> '') AS w FROM conversations WHERE role = 'user') " + SQL["phrase_ngrams"]
QUERIES = {n: globals()[n] for n in SQL}
