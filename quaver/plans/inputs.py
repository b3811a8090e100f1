"""Queries on readers and writers: each writes tables into the shared folder by one way and gives what is read back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ranking as K
from ..sources import config as C
from ..sources import files as S
from .ranking import _cross, _BASE
from .store import shared_folder
from .views import dev_tasks, items, table


def _new(s, name: str) -> str:
    return f"{shared_folder(s)}/inputs-{uuid.uuid4().hex}/{name}"


def later_split_wins(s, d):
    """Customers in two splits: the second has every third one, with a name of its own and a column more."""
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    second = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("SECOND").alias("c_mktsegment"), F.col("c_custkey").alias("more"))
    return S.union_splits([c, second], "c_custkey")


def copies_kept_or_replaced(s, d):
    """A table is written, a second write over it is ignored, and a third replaces it."""
    path, n = _new(s, "copy.parquet"), table(s, d, "nation").select("n_nationkey", "n_name")
    S.write_table(n.where("n_nationkey < 10"), path)
    S.write_table(n.where("n_nationkey < 5"), path, "ignore")
    first = s.createDataFrame(S.read_table(s, path).collect(), n.schema)  # at most ten rows
    S.write_table(n.where("n_nationkey >= 20"), path, "overwrite")
    return first.withColumn("step", F.lit("ignored")).unionAll(S.read_table(s, path).withColumn("step", F.lit("replaced")))


def kinds_by_extension(s, d):
    """Parts through parquet, csv and lines of JSON; csv gives strings, with leading zeros and empty cells kept."""
    p = table(s, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("key"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_name")).alias("name"))
    out = None
    for kind in ("parquet", "csv", "jsonl"):
        path = _new(s, f"t.{kind}")
        S.write_table(p, path)
        part = S.read_table(s, path, ["key", "name"]).select(F.lit(kind).alias("kind"), "key", "name")
        out = part if out is None else out.unionAll(part)
    return out


def named_columns(s, d):
    """Columns by name and type; what the file has not is null."""
    return S.read_columns(s, f"{d}/supplier.parquet", {"s_suppkey": "string", "s_name": "string", "s_nothing": "double"})


def predictions_read(s, d):
    """Lists as records of predictions, written and read back, cut to 10."""
    path = _new(s, "predictions.jsonl")
    S.write_table(S.predictions(_lists(s, d)).withColumn("session_id", F.col("session_id").cast("string")), path)
    return S.read_predictions(s, path, 10)


def _lists(s, d) -> DataFrame:
    return K.padded(_cross(s, d).where("rank <= 20"), dev_tasks(s, d), K.popular(items(s, d), 60), 20)


def zipped_predictions(s, d):
    """Nations' suppliers as a zipped submission, read back."""
    path = _new(s, "submission.zip")
    p = table(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_nationkey")).alias("session_id"), F.lit(1).alias("turn_number"), F.col("s_suppkey").alias("item_id"), F.row_number().over(K.Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("rank"))
    S.zip_submission(S.predictions(p), path)
    return S.read_zipped(s, path).select("session_id", "turn_number", F.posexplode("predicted_track_ids").alias("at", "item_id"))


def submission_rules(s, d):
    """Problems of four submissions: one good, one nested, one long of name, one whose records lack a field."""
    import io
    import zipfile

    folder = _new(s, "zips")
    good = [{"session_id": "a", "user_id": "u", "turn_number": 1, "predicted_track_ids": ["x"], "predicted_response": "r"}]
    for name, member, data in (("good.zip", "prediction.json", good), ("nested.zip", "in/prediction.json", good), ("n" * 60 + ".zip", "prediction.json", good), ("lacking.zip", "prediction.json", [{k: v for k, v in good[0].items() if k != "user_id"}])):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr(member, json.dumps(data))
        S.put(s, f"{folder}/{name}", held.getvalue())
    return S.submission_problems(s, folder)


def ledger_lines(s, d):
    """Runs as JSON lines with blank ones between."""
    path = _new(s, "ledger")
    o = table(s, d, "supplier").select(F.explode(F.array(F.to_json(F.struct(F.col("s_suppkey").alias("run"), F.col("s_acctbal").alias("judge"))), F.lit("  "))).alias("value"))
    o.write.text(path)
    return S.read_ledger(s, path, "run bigint, judge double")


def catalog_ids(s, d):
    """Ids of a text file, of a JSON array, and of JSON records."""
    keys = [str(r.n_nationkey) for r in table(s, d, "nation").collect()]  # 25 rows
    out = None
    for name, data in (("a.txt", "\n".join([*keys, "", " "])), ("b.json", json.dumps(keys)), ("c.json", json.dumps([{"track_id": k} for k in keys]))):
        path = _new(s, name)
        S.put(s, path, data.encode())
        part = S.read_catalog_ids(s, path).select(F.lit(name).alias("file"), "item_id")
        out = part if out is None else out.unionAll(part)
    return out


def config_chain(s, d):
    told = {"base": {"a": 1, "m": {"x": 1, "y": 2}, "l": [1, 2]}, "mid": {"_base": "base", "m": {"y": 3}, "l": [9]}, "top": {"_base": ["base", "mid"], "a": 5}}
    c = C.resolve("top", told)
    return s.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in c.items()], "name string, value string")


def appended_batches(s, d):
    """Two batches in a frozen schema, the second without a column."""
    path = _new(s, "rows.parquet")
    li = table(s, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    schema = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_quantity", T.DoubleType()), T.StructField("l_discount", T.DoubleType())])
    S.append_batches([li.where("l_orderkey % 2 = 0"), li.where("l_orderkey % 2 = 1").drop("l_discount")], path, schema)
    r = s.read.parquet(path)
    return r.groupBy((F.col("l_orderkey") % 2).alias("batch")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.count("l_discount").alias("discounts"))


def shard_totals(s, d):
    """Summaries of days, merged: totals, and means weighted by counts."""
    e = table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum(F.col("value").isNotNull().cast("long")).alias("known"), F.avg("value").alias("mean"))
    t = S.combine_summaries(e, "n", ["known"], ["mean"])
    return t.select("n", "known", F.round("mean", 6).alias("mean"))


def task_shard(s, d):
    """Every seventh order from the third, by price and key."""
    return S.shard(table(s, d, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], 7, 3)


def report_table(s, d):
    return s.createDataFrame([(S.markdown(table(s, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")),)], "report string")


_PAD = f"""{_BASE}, pop AS (SELECT item_id, row_number() OVER (ORDER BY popularity DESC, item_id) AS pop_rank FROM items), pd AS (SELECT session_id, turn_number, item_id, CAST(row_number() OVER (PARTITION BY session_id, turn_number ORDER BY is_pad, rank, item_id) AS INT) AS r FROM (SELECT session_id, turn_number, item_id, rank, false AS is_pad FROM s1 WHERE rank <= 20
  UNION ALL SELECT session_id, turn_number, item_id, pop_rank, true FROM (SELECT t.session_id, t.turn_number, pop.* FROM tasks t, pop WHERE pop_rank <= 60) x WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE rank <= 20 AND s1.session_id = x.session_id AND s1.turn_number = x.turn_number AND s1.item_id = x.item_id)))"""
_KINDS = "SELECT '{0}' AS kind, lpad(p_partkey::VARCHAR, 6, '0') AS key, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS name FROM part"
SQL = {
    "later_split_wins": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'SECOND' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS more FROM customer",
    "copies_kept_or_replaced": "SELECT n_nationkey, n_name, 'ignored' AS step FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, n_name, 'replaced' FROM nation WHERE n_nationkey >= 20",
    "kinds_by_extension": " UNION ALL ".join(_KINDS.format(k) for k in ("parquet", "csv", "jsonl")),
    "named_columns": "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, CAST(NULL AS DOUBLE) AS s_nothing FROM supplier",
    "predictions_read": f"{_PAD} SELECT session_id::VARCHAR AS session_id, turn_number, r AS rank, item_id::VARCHAR AS item_id FROM pd WHERE r <= 10",
    "zipped_predictions": "SELECT 's' || s_nationkey AS session_id, 1 AS turn_number, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS at, s_suppkey::VARCHAR AS item_id FROM supplier",
    "submission_rules": f"SELECT 'nested.zip' AS file, 'nested' AS problem UNION ALL SELECT '{'n' * 60}.zip', 'long name' UNION ALL SELECT 'lacking.zip', 'missing user_id'",
    "ledger_lines": "SELECT s_suppkey AS run, s_acctbal AS judge FROM supplier",
    "catalog_ids": " UNION ALL ".join(f"SELECT '{f}' AS file, n_nationkey::VARCHAR AS item_id FROM nation" for f in ("a.txt", "b.json", "c.json")),
    "config_chain": """SELECT 'a' AS name, '5' AS value UNION ALL SELECT 'm', '{"x": 1, "y": 3}' UNION ALL SELECT 'l', '[9]'""",
    "appended_batches": "SELECT l_orderkey % 2 AS batch, count(*) AS n, sum(l_quantity) AS quantity, count(CASE WHEN l_orderkey % 2 = 0 THEN l_discount END) AS discounts FROM lineitem GROUP BY 1",
    "shard_totals": "SELECT count(*) AS n, count(value) AS known, round(sum(m * n) / sum(n), 6) AS mean FROM (SELECT value, NULL AS m, NULL AS n FROM events WHERE false)",
    "task_shard": "SELECT o_totalprice, o_orderkey FROM orders QUALIFY (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) % 7 = 3",
    "report_table": "SELECT '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS report FROM region",
}
SQL["shard_totals"] = "SELECT sum(n)::BIGINT AS n, sum(known)::BIGINT AS known, round(sum(m * n) / sum(n), 6) AS mean FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(value) AS known, avg(value) AS m FROM events GROUP BY 1)"
QUERIES = {n: globals()[n] for n in SQL}
