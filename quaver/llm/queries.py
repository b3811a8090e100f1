"""The queries opN_<name> over whole tables, and their SQL where it can be told in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.session import ship
from . import decontamination, language_id, line_dedup, minhash_dedup, packing, quality_rules, substring_dedup, token_counts, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"), declared="lang", host="source")
    return found.select("doc_id", "language", "text_language", "confidence", "accepted")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over raw pages, with all four kinds of evidence: text, <html lang>, address suffix, host."""
    pages = language_id.page_evidence(table(spark, sf_dir, "pages"))
    found = language_id.identify(pages, id_col="page_id", declared="lang", suffix="suffix", host="source")
    return found.select("page_id", "language", "text_language", "confidence", "accepted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.assess(table(spark, sf_dir, "documents")).select(*columns)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_line_dedup, op3_minhash_dedup, op4_language_id, op5_quality_rules, op6_warc, op7_packing, op8_token_counts, op9_substring_dedup, op10_toxicity, pipeline, language_id_pages)}


_LOWER_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER_AZ.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(10, len(ws)) AS m, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS w
  FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM iw WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, regexp_extract_all({_LOWER_AZ.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), dm AS (
  SELECT doc_id, m, i, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS w
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM windows) WHERE len(ws) >= m)
), hits AS (
  SELECT d.doc_id, d.i, d.m, x.item FROM dm d JOIN windows x ON x.m = d.m AND x.w = d.w
), counted AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(dw.ws) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(n.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN counted c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP3_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format(_LOWER_AZ.format("coalesce(text, '')"))} AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM d WHERE len(ws) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * x.c >= 85 * (na.n + nb.n - x.c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), c AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""


#: The last part is the base-32 form of a hexadecimal SHA-1: 5 hexadecimal digits are 4 letters.
OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), f AS (
  SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first FROM p
), x AS (
  SELECT *, sha1(h) AS d FROM f
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(d, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM x
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op3_minhash_dedup": OP3_SQL, "op6_warc": OP6_SQL}
