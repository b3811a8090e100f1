from __future__ import annotations

from pathlib import Path

from pyspark.sql import Row

import __spark_entry__
import corpus_pipeline
from quaver.llm import language_id, queries

from .fixtures import ODD, documents
from .test_dedup import brute_lines, components
from .test_filters import brute_contamination, brute_fusion
from .test_tokens import check_pack


def test_every_operator_is_registered():
    names = set(__spark_entry__.queries())
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(queries.queries())


def plain_stage(name, rows, items, spark, docs):
    """What a stage should leave of rows (of the columns of documents), by plain Python."""
    if name == "language_id":
        langs, table = language_id.train(docs)
        told = brute_fusion([(r.text, r.lang, None, r.source) for r in rows], langs, table)
        return [r for r, (language, p) in zip(rows, told, strict=True) if language != "und" and p >= 0.5]
    if name == "line_dedup":
        gone, out = brute_lines([(r.doc_id, r.text) for r in rows]), []
        for r in rows:
            left = [x for k, x in enumerate((r.text or "").split("\n")) if k not in gone[r.doc_id, r.text]]
            if not gone[r.doc_id, r.text] or any(x.strip(" \t\r\x0b\x0c") for x in left):
                out.append(r if r.text is None else Row(**(r.asDict() | {"text": "\n".join(left)})))
        return out
    if name == "minhash_dedup":
        rows = sorted(rows, key=lambda r: r.doc_id)
        want, _ = components([r.text for r in rows], 80)
        return [r for i, r in enumerate(rows) if want[i] == i]
    dirty = [x[-1] for x in brute_contamination([r.text for r in rows], items)]
    return [r for r, x in zip(rows, dirty, strict=True) if not x]


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = documents(spark, [t for t in ODD if not t or len(t) < 6000], langs=["en", None] * 4 + ["en"] * (len([t for t in ODD if not t or len(t) < 6000]) - 8), first=10**6).select(*docs.columns)
    docs = docs.unionAll(odd)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_dedup", "decontamination", "packing"]
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"file://{tmp_path}/{k}"
        stage(spark, before, sf).write.parquet(out)
        after = spark.read.parquet(out)
        rows, got = before.collect(), after.collect()
        if name == "packing":
            check_pack(got, [(r.doc_id, r.text) for r in rows], 2048)
        else:
            assert after.columns == docs.columns
            order = lambda r: (r.doc_id, r.text or "")
            assert sorted(map(tuple, got), key=str) == sorted((tuple(r[c] for c in docs.columns) for r in plain_stage(name, rows, items, spark, before)), key=str), (name, order)
            assert len(got) < len(rows) or name == "line_dedup"
        before = after
    first = spark.read.parquet(f"file://{tmp_path}/4").where("doc_id < 1000000").select("doc_id").distinct().count()
    assert abs(corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() - first) <= 3  # the odd rows count in the model


def test_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0, name


def test_the_rest_stands_without_the_subpackage():
    root = Path(__spark_entry__.__file__).parent
    for p in root.rglob("*.py"):
        text = p.read_text()
        if "llm" not in p.parts and p.name not in ("corpus_pipeline.py", "__spark_entry__.py"):
            assert "llm" not in text, p
