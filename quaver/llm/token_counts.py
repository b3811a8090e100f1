"""Token counts of flat, unindexed token files by a separator scan.

A token file is nothing but little-endian 16-bit ids, documents one after another, each ended by an end-of-document id. Files
are dealt out in blocks; a block is searched for the end id as one vector operation. Documents that go over blocks are
stitched by a prefix scan: the place of the last end id before a block is a running maximum over the blocks' summaries, the
ordinal of its first document a running sum. Only summaries and end positions are ever moved, never ids.

write_token_files() makes such files from documents. A task writes under a name of its own attempt and returns the name; only
names returned by tasks that succeeded are in the manifest, so lost executors and repeated attempts leave no duplicates.

Null and empty texts are documents of no ids; rows that repeat are documents of their own; a null doc_id stays null. Ids after the last end id of a file are a document that is not terminated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path, slices
from .tokens import default_tokenizer, text_ids

END_OF_TEXT = 50256
BLOCK = 1 << 20


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def _write(folder: str, path: str, end: int):
    out = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_ids", pa.int64()), ("first", pa.int64()), ("docs", pa.list_(pa.string()))])
    mark = np.array([end], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, coder, n, first = TaskContext.get(), text_ids(path, plain=True), 0, 0
        target = f"{folder}/tokens-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        system, local = _open(target)
        system.create_dir(local.rpartition("/")[0], recursive=True)
        with system.open_output_stream(local) as file:
            for batch in batches:
                for rows in slices(batch, 0):
                    data = b"".join(x + mark for x in coder.ids(rows.column(0).to_pylist()))
                    n += len(data) // 2
                    file.write(data)
                    if rows.num_columns > 1:
                        docs = pa.array([rows.column(1).to_pylist()], pa.list_(pa.string()))
                        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([first], pa.int64()), docs], schema=out)
                    first += rows.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([target]), pa.array([n], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.string()))], schema=out)

    return run


def _written(docs: DataFrame, folder: str, path: str | None, end: int) -> DataFrame:
    texts = docs.select(F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *([docs["doc_id"].cast("string").alias("doc")] if "doc_id" in docs.columns else []))
    return materialize(texts.mapInArrow(_write(folder, path or default_tokenizer(), end), "shard bigint, path string, n_ids bigint, first bigint, docs array<string>"), "token-files")


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end: int = END_OF_TEXT) -> DataFrame:
    """Writes flat token files, one a partition, into folder (a URI that all executors share). Returns their manifest: shard, path, n_ids."""
    return _written(docs, folder, path, end).where("path is not null").select("shard", "path", "n_ids")


def _scan(block: int, end: int):
    out = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("n_ids", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, n_ids, k in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                system, local = _open(path)
                lo = k * block
                with system.open_input_file(local) as file:
                    ids = np.frombuffer(file.read_at(2 * min(block, n_ids - lo), 2 * lo), "<u2")
                ends = np.flatnonzero(ids == end) + lo
                column = pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([k]), pa.array([n_ids]), column], schema=out)

    return run


def scan_token_files(files: DataFrame, block: int = BLOCK, end: int = END_OF_TEXT) -> DataFrame:
    """Per document of the files (shard, path, n_ids): shard, document (its ordinal there), start, n_tokens without the end id, terminated."""
    blocks = files.where("n_ids > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_ids") - 1) / block).cast("long"))))
    blocks = blocks.repartition(F.col("shard"), F.col("block"))
    found = materialize(blocks.select("shard", "path", "n_ids", "block").mapInArrow(_scan(block, end), "shard bigint, block bigint, n_ids bigint, ends array<bigint>"), "token-ends")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select(
        "shard",
        "block",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("documents"),
        F.coalesce(F.max(F.try_element_at("ends", F.lit(-1)) + 1).over(before), F.lit(0)).alias("begins"),
        "n_ids",
        "ends",
    )
    docs = scanned.select("shard", "documents", "begins", F.posexplode("ends").alias("k", "at"), "ends").select(
        "shard",
        (F.col("documents") + F.col("k")).alias("document"),
        F.when(F.col("k") == 0, F.col("begins")).otherwise(F.try_element_at("ends", F.col("k")) + 1).alias("start"),
        "at",
    )
    closed = docs.select("shard", "document", "start", (F.col("at") - F.col("start")).alias("n_tokens"), F.lit(True).alias("terminated"))
    tail = found.groupBy("shard").agg(F.sum(F.size("ends")).alias("document"), F.coalesce(F.max(F.try_element_at("ends", F.lit(-1)) + 1), F.lit(0)).alias("start"), F.max("n_ids").alias("n"))
    tail = tail.where("start < n").select("shard", "document", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return closed.unionAll(tail)


def token_counts(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """Writes docs as flat token files in the shared folder and counts their documents' tokens by scanning them: what the scan
    finds, and the doc_id that the manifest has for each document of a file."""
    made = _written(docs, scratch_path(docs.sparkSession, "flat"), path, END_OF_TEXT)
    ids = made.where("docs is not null").select("shard", "first", F.posexplode("docs").alias("k", "doc"))
    kind = docs.schema["doc_id"].dataType
    ids = ids.select("shard", (F.col("first") + F.col("k")).alias("document"), F.col("doc").cast(kind).alias("doc_id"))
    counts = scan_token_files(made.where("path is not null").select("shard", "path", "n_ids"), block)
    return counts.join(ids, ["shard", "document"], "left").select("doc_id", *counts.columns)
