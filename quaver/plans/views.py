"""Relations that the queries start from, over the tables of a folder; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.ranking import SPREAD
from .session import ship

#: Sessions that begin from this day on are evaluated, earlier ones are learned from.
DEV_FROM = "2000-06-01"
SEQ = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def plays(spark: SparkSession, d: str) -> DataFrame:
    """user_id, session_id, turn_number, item_id, train: played items in order; turns count from 1."""
    turn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*SEQ))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", turn.alias("turn_number"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", (F.col("o_orderdate") < F.lit(DEV_FROM).cast("timestamp")).alias("train"))
    return li.join(o, "l_orderkey").select(F.col("o_custkey").alias("user_id"), F.col("l_orderkey").alias("session_id"), "turn_number", F.col("l_partkey").alias("item_id"), "train")


def items(spark: SparkSession, d: str) -> DataFrame:
    """item_id, name, artist, album, tags, popularity."""
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    p = table(spark, d, "part").repartition(SPREAD, "p_partkey")
    return p.join(n, p.p_partkey == n.l_partkey, "left").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"), F.split("p_name", " ").alias("tags"), F.coalesce("n", F.lit(0)).cast("double").alias("popularity"))


def dev_tasks(spark: SparkSession, d: str) -> DataFrame:
    """session_id, turn_number, user_id, label: the last turn of every session to evaluate."""
    last = F.max("turn_number").over(Window.partitionBy("session_id"))
    p = plays(spark, d).where("not train").withColumn("last", last).where("turn_number = last")
    return p.select("session_id", "turn_number", "user_id", F.col("item_id").alias("label"))


def history(tasks: DataFrame, p: DataFrame) -> DataFrame:
    """session_id, turn_number, item_id, recency (1: the latest) of the items played before each task."""
    h = p.select("session_id", F.col("turn_number").alias("at"), "item_id")
    j = tasks.select("session_id", "turn_number").join(h, "session_id").where("at < turn_number")
    return j.select("session_id", "turn_number", "item_id", (F.col("turn_number") - F.col("at")).alias("recency"))


def values(it: DataFrame) -> DataFrame:
    """item_id, field, value, popularity: one row a normalised value of track, artist, album and tag, fields 0 to 3."""
    one = lambda f, c: it.select("item_id", F.lit(f).alias("field"), X.normalize_text(F.col(c)).alias("value"), "popularity")
    tags = it.select("item_id", F.lit(3).alias("field"), F.explode(F.array_distinct(X.as_values(F.col("tags")))).alias("value"), "popularity")
    return one(0, "name").unionAll(one(1, "artist")).unionAll(one(2, "album")).unionAll(tags).where("value <> ''")


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"

#: The relations above as common table expressions.
PLAYS = f"""plays AS (
  SELECT o.o_custkey AS user_id, l.l_orderkey AS session_id, l.turn_number, l.l_partkey AS item_id, o.o_orderdate < TIMESTAMP '{DEV_FROM}' AS train
  FROM (SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(SEQ)}) AS INT) AS turn_number FROM lineitem) l
  JOIN orders o ON o.o_orderkey = l.l_orderkey)"""
ITEMS = """items AS (
  SELECT p_partkey AS item_id, p_name AS name, p_brand AS artist, p_type AS album, string_split(p_name, ' ') AS tags, CAST(coalesce(n, 0) AS DOUBLE) AS popularity
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""
TASKS = """tasks AS (
  SELECT session_id, turn_number, user_id, item_id AS label FROM plays WHERE NOT train QUALIFY turn_number = max(turn_number) OVER (PARTITION BY session_id))"""
HISTORY = """history AS (
  SELECT t.session_id, t.turn_number, p.item_id, t.turn_number - p.turn_number AS recency FROM tasks t JOIN plays p ON p.session_id = t.session_id AND p.turn_number < t.turn_number)"""
VALUES = f"""vals AS (
  SELECT item_id, field, value, popularity FROM (
    SELECT item_id, 0 AS field, {NORM.format("name")} AS value, popularity FROM items UNION ALL SELECT item_id, 1, {NORM.format("artist")}, popularity FROM items
    UNION ALL SELECT item_id, 2, {NORM.format("album")}, popularity FROM items
    UNION ALL SELECT DISTINCT item_id, 3, {NORM.format("tag")}, popularity FROM (SELECT item_id, unnest(tags) AS tag, popularity FROM items)) WHERE value <> '')"""
