"""Readers and writers: tables by extension, predictions, catalogs of ids, zipped submissions, shards, reports and run ledgers."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import TASK, numbered

PREDICTION = "session_id string, user_id string, turn_number int, predicted_track_ids array<string>, predicted_response string"


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """parquet, csv, json or jsonl by extension; only columns, if given. csv columns without a schema are strings, empty cells stay empty."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    r = spark.read.schema(schema) if schema else spark.read
    if kind == "parquet":
        df = r.parquet(path)
    elif kind == "csv":
        df = r.csv(path, header=True, nullValue="\x00", emptyValue="", multiLine=True, escape='"')
    elif kind in ("json", "jsonl"):
        df = r.json(path, multiLine=kind == "json")
    else:
        raise ValueError(f"no reader for .{kind}")
    return df.select(columns) if columns else df


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """parquet, csv or jsonl by extension. mode 'ignore' skips what exists, 'overwrite' replaces it; writers commit as a whole."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    w = df.write.mode(mode)
    if kind == "parquet":
        w.parquet(path)
    elif kind == "csv":
        w.csv(path, header=True, escape='"')
    elif kind in ("json", "jsonl"):
        w.json(path)
    else:
        raise ValueError(f"no writer for .{kind}")


def union_splits(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of several tables; of rows with the same key, the one of the last table stays."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("q_split", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    # among rows of one table with one key, the one with the least hash of its columns
    columns = [c for c in out.columns if c != "q_split"]
    place = F.struct((-F.col("q_split")).alias("split"), F.xxhash64(F.to_json(F.struct(*columns))).alias("mark"))
    return out.groupBy(F.col(key).alias("q_key")).agg(F.min_by(F.struct(*columns), place).alias("q_row")).select("q_row.*")


def read_columns(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Named columns with their types; what the file has not is null. Only the schema is read to tell."""
    df = spark.read.parquet(path)
    return df.select(*((F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in a frozen schema: missing columns are null, new ones are an error."""
    new = [c for c in df.columns if c not in schema.fieldNames()]
    if new:
        raise ValueError(f"columns that the schema has not: {new}")
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def read_predictions(spark: SparkSession, path: str, k: int, allow_short: bool = False) -> DataFrame:
    """session_id, turn_number, item_id, rank from a JSON array or lines of records; lists are cut to k; a shorter one fails unless allowed."""
    df = spark.read.schema(PREDICTION).json(path, multiLine=path.endswith(".json"))
    ids: Column = F.slice("predicted_track_ids", 1, k)
    if not allow_short:
        ids = F.when(F.size("predicted_track_ids") >= k, ids).otherwise(F.raise_error(F.lit(f"a list has fewer than {k} items")))
    return df.select("session_id", "turn_number", F.posexplode(ids).alias("rank", "item_id")).withColumn("rank", F.col("rank") + 1)


def predictions(ranked: DataFrame, keys: list[str] | None = None, response: str | None = None) -> DataFrame:
    """One record a task: its key and predicted_track_ids in order."""
    keys = keys or TASK
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x.item_id.cast("string")).alias("predicted_track_ids")
    more = [F.max(response).alias("predicted_response")] if response else []
    return ranked.groupBy(*keys).agg(ids, *more)


def read_zipped(spark: SparkSession, path: str, member: str = "prediction.json") -> DataFrame:
    """Records of a JSON member of zip files; a file is unpacked where it is read."""

    def unzip(batches):
        import pandas as pd

        for b in batches:
            records = []
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    records += [json.dumps(r) for r in json.loads(z.read(member))]
            yield pd.DataFrame({"record": records})

    raw = spark.read.format("binaryFile").load(path).select("content")
    return raw.mapInPandas(unzip, "record string").select(F.from_json("record", PREDICTION).alias("r")).select("r.*")


def zip_submission(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A zip with prediction.json. A submission is a small file by contract: more than `most` records are refused."""
    records = [json.loads(r) for r in df.limit(most + 1).toJSON().collect()]
    if len(records) > most:
        raise ValueError(f"a submission has at most {most} records")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("prediction.json", json.dumps(records, ensure_ascii=False))
    put(df.sparkSession, path, held.getvalue())


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a small file, wherever Spark can write."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def submission_problems(spark: SparkSession, path: str, most_name: int = 63) -> DataFrame:
    """file, problem of zipped submissions: a name that is too long, no prediction.json at the root, no array in it, a record without a
    required field."""
    need = ["session_id", "user_id", "turn_number", "predicted_track_ids", "predicted_response"]

    def inspect(batches):
        import pandas as pd

        for b in batches:
            out = []
            for p, content in zip(b["path"], b["content"], strict=True):
                name = p.rsplit("/", 1)[-1]
                if len(name) > most_name:
                    out.append((name, "long name"))
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if "prediction.json" not in z.namelist():
                        out.append((name, "nested" if any(n.endswith("prediction.json") for n in z.namelist()) else "no prediction.json"))
                        continue
                    told = json.loads(z.read("prediction.json"))
                if not isinstance(told, list):
                    out.append((name, "no array"))
                    continue
                out += [(name, f"missing {f}") for f in need if any(f not in r for r in told)]
            yield pd.DataFrame(out, columns=["file", "problem"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(inspect, "file string, problem string")


def append_batches(batches: list[DataFrame], path: str, schema: T.StructType) -> None:
    """Appends tables one after another in a frozen schema: what a batch lacks is null, a new column is an error before anything of it is written."""
    for b in batches:
        conform(b, schema).write.mode("append").parquet(path)


def resolve_artifacts(ledger: DataFrame, artifacts: DataFrame, expected: int) -> DataFrame:
    """ledger (run, artifact) with the file that each names and, if it can't be used, why: artifacts are file, records. A name without an
    ending may be of a .zip or .json; submission_x.zip may be x.json. A file needs the expected number of records."""
    base = F.regexp_extract("artifact", r"([^/]*)$", 1)
    bare = ~base.contains(".")
    stem = F.regexp_extract(base, r"^submission_(.*)\.zip$", 1)
    names = F.filter(F.array(base, F.when(bare, F.concat(base, F.lit(".zip"))), F.when(bare, F.concat(base, F.lit(".json"))), F.when(stem != "", F.concat(stem, F.lit(".json")))), lambda x: x.isNotNull())
    tried = ledger.select("run", F.posexplode(names).alias("at", "file"))
    found = tried.join(artifacts, "file").groupBy("run").agg(F.min_by(F.struct("file", "records"), "at").alias("f"))
    j = ledger.join(found, "run", "left").select("run", "artifact", F.col("f.file").alias("file"), F.col("f.records").alias("records"))
    reason = F.when(F.col("file").isNull(), "artifact_not_found").when(F.col("records") != expected, F.concat(F.lit("record_count:"), F.col("records").cast("string")))
    return j.select("run", "artifact", "file", reason.alias("reason"))


def read_catalog_ids(spark: SparkSession, path: str) -> DataFrame:
    """item_id from lines of a .txt, or from a .json array of ids or of records with track_id."""
    if path.endswith(".txt"):
        return spark.read.text(path).select(F.trim("value").alias("item_id")).where("item_id <> ''").distinct()
    text = spark.read.text(path, wholetext=True)
    each = F.explode(F.from_json("value", "array<string>")).alias("x")
    x = text.select(each)
    return x.select(F.coalesce(F.get_json_object("x", "$.track_id"), F.col("x")).alias("item_id")).distinct()


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Runs from JSON lines; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def shard(rows: DataFrame, order: list[str], n: int, i: int) -> DataFrame:
    """Every n-th row in an order, from the i-th: for work that is handed to separate processes."""
    return numbered(rows, order, "q_at").where(F.col("q_at") % n == i).drop("q_at")


def combine_summaries(shards: DataFrame, weight: str, sums: list[str], means: list[str]) -> DataFrame:
    """Totals of counts, and means weighted by a count."""
    return shards.agg(*(F.sum(c).alias(c) for c in dict.fromkeys([weight, *sums])), *((F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(weight))).alias(c) for c in means))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A Markdown table. A report is small by contract: more than `most` rows are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *(line(r) for r in rows)])
