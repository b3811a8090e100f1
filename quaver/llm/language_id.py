"""Language identification by Bayesian evidence fusion.

Evidence of a document: its text (naive Bayes over hashed letter trigrams), the language its markup declares, the suffix of its
address and its host. Trigram counts of every language come from all texts that declare it, in one grouped aggregation of
partition sums; a background class "und" with a flat distribution stands for text in no language.

Text log likelihoods are tempered, since trigrams overlap: no text counts for more than evidence_cap trigrams. From the text
posteriors of all documents, grouped soft counts give P(declared | language) and host priors that are smoothed level by level:
host towards its suffix, suffix towards the whole corpus, each with the weight of `pull` documents. The fused posterior is
text x declared x host prior; a document is accepted if its best language is not "und" and has at least min_confidence.

Scale: the text is read twice and never shuffled; all else are narrow rows. Every declared language is learned, unless the
caller sets max_langs; the model takes BINS numbers a language, and a task counts for at most BLOCK languages at a time. Host
and declared tables are broadcast only if counted small; otherwise joined by a shuffle, where a hot host is split. Nulls: a text
without letters has no text evidence and is "und"; null declared, suffix or host are values of their own. Rows that repeat are
told one by one. With no declared language anywhere nothing can be learned and every document is "und".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, broadcast_if_small, chunks, lists, materialize, string_buffers

BINS, BLOCK, EVIDENCE_CAP, PULL, MIN_CONFIDENCE = 8192, 64, 60, 20.0, 0.5
UND = "und"

_LETTER = LOWER.copy()
_LETTER[[b for b in range(0x80) if not 0x61 <= int(LOWER[b]) <= 0x7A]] = 0x20


def trigram_bins(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bin) of every trigram of letters and blanks; trigrams of two blanks or across documents are left out."""
    b = _LETTER[buf].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y, z = b[:-2], b[1:-1], b[2:]
    blank = (x == 0x20).astype(np.int8) + (y == 0x20) + (z == 0x20)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    own = (blank < 2) & (doc[2:] == doc[:-2])
    bins = ((x * np.uint32(0x9E3779B1) ^ y * np.uint32(0x85EBCA77) ^ z * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(19)
    return doc[:-2][own], bins[own].astype(np.int64)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}

    def counted() -> pa.RecordBatch:
        names = list(total)
        counts = lists([total[x] for x in names], pa.int64()) if names else pa.array([], pa.list_(pa.int64()))
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), counts], names=["lang", "counts"])

    for batch in batches:
        buf, offsets = string_buffers(batch.column(1))
        coded = batch.column(0).dictionary_encode()
        names, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for i, _, raw, at in chunks(buf, offsets):
            doc, bins = trigram_bins(raw, at)
            of = lang[i + doc]
            order = np.argsort(of, kind="stable")
            held, first = np.unique(of[order], return_index=True)
            for k, part in zip(held.tolist(), np.split(bins[order], first[1:]), strict=len(held) > 0):
                if names[k] not in total:
                    if len(total) >= BLOCK:
                        yield counted()
                    total[names[k]] = np.zeros(BINS, np.int64)
                total[names[k]] += np.bincount(part, minlength=BINS)
    yield counted()


def train(docs: DataFrame, declared: str = "lang", text: str = "text", max_langs: int | None = None) -> tuple[list[str], np.ndarray]:
    """Languages (all declared ones, or the max_langs most declared, by name) and the log probability of every bin in each; the
    last row is "und"."""
    rows = docs.select(docs[declared].cast("string").alias("lang"), docs[text].cast("string").alias("text")).where(f"lang is not null and lang <> '{UND}' and text is not null")
    names = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    langs = sorted(r.lang for r in (names if max_langs is None else names.limit(max_langs)).collect())
    if not langs:
        return [UND], np.full((1, BINS), -np.log(BINS))
    index = {x: i for i, x in enumerate(langs)}
    chosen = rows if max_langs is None else rows.where(F.col("lang").isin(langs))
    sums = chosen.mapInArrow(_learn, "lang string, counts array<bigint>")
    counts = np.zeros((len(langs), BINS))
    for r in sums.select("lang", F.posexplode("counts").alias("bin", "n")).where("n > 0").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[index[r.lang], r.bin] = r.n  # at most BINS rows a language
    counts += 0.5
    return [*langs, UND], np.vstack([np.log(counts / counts.sum(axis=1, keepdims=True)), np.full((1, BINS), -np.log(BINS))])


def _score(model: np.ndarray, cap: int):
    out = pa.schema([("row", pa.string()), ("mark", pa.int64()), ("declared", pa.string()), ("suffix", pa.string()), ("host", pa.string()), ("ll", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.T.astype(np.float32)
        for batch in batches:
            buf, offsets = string_buffers(batch.column(5))
            for i, j, raw, at in chunks(buf, offsets):
                doc, bins = trigram_bins(raw, at)
                n = np.bincount(doc, minlength=j - i)
                ll = np.stack([np.bincount(doc, weights=weight[bins, k], minlength=j - i) for k in range(weight.shape[1])], axis=1).astype(float)
                ll *= (np.minimum(n, cap) / np.maximum(n, 1))[:, None]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * weight.shape[1], weight.shape[1], dtype=np.int32)), pa.array(ll.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(5)), flat], schema=out)

    return run


def _softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def _sums(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """by, and counts: the sums of the n elements of post, combined before the shuffle."""
    return rows.groupBy(*by).agg(*(F.sum(F.col("post")[i]).alias(f"c{i}") for i in range(n))).select(*by, F.array(*(f"c{i}" for i in range(n))).alias("counts"))


def _smoothed(counts: Column, towards: Column, pull: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(counts, towards, lambda c, p: (c + pull * p) / (total + pull))


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", declared: str | None = "lang", suffix: str | None = None, host: str | None = "source", min_confidence: float = MIN_CONFIDENCE, cap: int = EVIDENCE_CAP, pull: float = PULL, max_langs: int | None = None, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """Per document: its id, mark (a hash of its text), text_language (by the text alone), language, confidence, accepted.

    declared, suffix and host name columns of evidence; None leaves that evidence out."""
    langs, table = model or train(docs, declared, text, max_langs)
    n = len(langs)
    column = lambda c: F.lit("") if c is None else F.coalesce(docs[c].cast("string"), F.lit(""))
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("string").alias("row"), F.xxhash64(body).alias("mark"), column(declared).alias("declared"), column(suffix).alias("suffix"), column(host).alias("host"), body.alias("text"))
    scored = rows.mapInArrow(_score(table, cap), "row string, mark bigint, declared string, suffix string, host string, ll array<double>")
    scored = materialize(scored.withColumn("post", _softmax(F.col("ll"))), "likelihoods")
    hosts = materialize(_sums(scored, ["suffix", "host"], n), "hosts")
    suffixes = hosts.groupBy("suffix").agg(*(F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(n))).select("suffix", F.array(*(f"c{i}" for i in range(n))).alias("all_counts"))
    every = hosts.agg(*(F.sum(F.col("counts")[i]) for i in range(n))).first()
    whole = sum(x or 0 for x in every)
    base = F.array(*(F.lit(((x or 0) + 1) / (whole + n)) for x in every))
    prior = hosts.join(suffixes, "suffix").select("suffix", "host", _smoothed(F.col("counts"), _smoothed(F.col("all_counts"), base, pull), pull).alias("prior"))
    told = _sums(scored, ["declared"], n)
    # P(declared | language): soft counts over the language's total, towards the share of the declared value
    share = F.aggregate("counts", F.lit(0.0), lambda s, x: s + x) / F.lit(max(whole, 1.0))
    totals = F.array(*(F.lit(float(x or 0)) for x in every))
    says = told.select("declared", F.zip_with("counts", totals, lambda c, t: F.log((c + pull * share) / (t + pull))).alias("says"))
    fused = scored.join(broadcast_if_small(prior, hosts.count()), ["suffix", "host"]).join(broadcast_if_small(says, scored.select("declared").distinct().count()), "declared")
    total = F.zip_with(F.zip_with("ll", F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b), "says", lambda a, b: a + b)
    letters = F.exists("ll", lambda x: x != 0)
    names = F.array(*map(F.lit, langs))
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    fused = fused.withColumn("p", _softmax(total)).withColumn("language", F.when(letters, best(F.col("p"))).otherwise(UND)).withColumn("confidence", F.when(letters, F.array_max("p")).otherwise(0.0))
    return fused.select(
        F.col("row").cast(docs.schema[id_col].dataType).alias(id_col),
        "mark",
        F.when(letters, best(F.col("post"))).otherwise(UND).alias("text_language"),
        "language",
        F.round("confidence", 6).alias("confidence"),
        ((F.col("language") != UND) & (F.col("confidence") >= min_confidence)).alias("accepted"),
    )


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, without the documents that identify() does not accept."""
    verdict = materialize(identify(docs, **options).where("not accepted").select(F.col("doc_id").alias("gone"), "mark").distinct(), "rejected")
    other = broadcast_if_small(verdict, verdict.count())
    mark = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(other, docs["doc_id"].eqNullSafe(other["gone"]) & (mark == other["mark"]), "left_anti")


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, lang, suffix and source of raw pages: visible text, the language declared in <html lang>, the last label of
    the host and the host. All null where the page has none."""
    html = F.col("html")
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))
    lang = F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit(""))
    return pages.select("page_id", bare.alias("text"), lang.alias("lang"), F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit("")).alias("suffix"), host.alias("source"))
