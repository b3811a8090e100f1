"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon (learned from the training fold by grouped counts, plus fixed seeds), how
close its words come to a second person, capitals, punctuation, repeated letters and obfuscation (marks or digits inside
words). Trees are MLlib's, boosted on a fit fold of labelled rows; an isotonic regression on the rest of the training fold
turns their margins into probabilities. Rows whose crc32(doc_id as text) mod 4 is 2 are held out of all learning. The label,
lang, source and doc_id are never features.

Scale: one pass over texts gives one narrow row a document, and one over labelled texts gives the lexicon, whose words are
counted by grouped aggregation. The lexicon is bounded by lexicon_size. Training reads at most max_rows labelled rows (all, if
there are fewer), chosen by a hash of their text, not by order.

The score is 0.98 of the calibrated probability and 0.02 of the sigmoid of twice the margin, so that rows on one step of the
calibration keep the trees' order.

Null and empty texts are scored like any other, from zero features. A doc_id that repeats in labels counts as toxic if any row
says so; documents that repeat are scored one by one, and each row with a label is learned from. With only one class in the
training fold every score is that class's share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

HELD_OUT, CUT, LEXICON, MAX_ROWS = 2, 0.3, 400, 400_000
# Words of insult in four languages, and words of the second person.
SEEDS = "idiot idiots moron morons scum clown stupid dumb worthless pathetic disgusting trash loser losers garbage vermin filth imbecile fool hate ugly dummkopf blöd arschloch abschaum trottel idioten connard imbécile débile crétin ordure imbécil estúpido basura idiota escoria"
SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi vous ton ta votre tú usted vosotros os"
_WORD = re.compile(r"[^\W\d_]+")
_SEEDS, _SECOND = frozenset(SEEDS.split()), frozenset(SECOND.split())
_ODD_INSIDE = re.compile(r"[^\W\d_][*@$#!0-9._-]+[^\W\d_]")
_LONG_RUN = re.compile(r"([^\W\d_])\1\1")
_DIGITS = str.maketrans("013457@$!", "oieastasi")
FEATURES = ("words", "lexicon", "lexicon_count", "lexicon_max", "seeds", "seed_count", "near_second", "second", "capitals", "shouted", "exclaims", "questions", "marks", "symbols", "runs", "obfuscated", "hidden", "digits", "mean_length", "distinct")


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """Dense features of one text, in the order of FEATURES."""
    words = _WORD.findall(text)
    low = [w.lower() for w in words]
    n, chars = max(1, len(words)), max(1, len(text))
    get = lexicon.get
    weights = [w for w in map(get, low) if w is not None]
    hits = [i for i, w in enumerate(low) if w in lexicon or w in _SEEDS]
    seeds = sum(1 for w in low if w in _SEEDS)
    second = [i for i, w in enumerate(low) if w in _SECOND]
    near = 0.0
    if hits and second:
        gaps = _least_gap(hits, second)
        near = 1.0 / float(gaps) if gaps else 1.0
    odd = _ODD_INSIDE.findall(text)
    hidden = 0
    if odd:
        for part in text.split():
            if _ODD_INSIDE.search(part):
                bare = part.lower().translate(_DIGITS)
                if any(w in lexicon or w in _SEEDS for w in _WORD.findall(bare)) or re.sub(r"[\W\d_]+", "", part.lower()) in _SEEDS:
                    hidden += 1
    count = text.count
    return [
        float(np.log1p(len(words))),
        100 * sum(weights) / n,
        float(len(weights)),
        max(weights, default=0.0),
        100 * seeds / n,
        float(seeds),
        near,
        100 * len(second) / n,
        sum(map(str.isupper, words)) / n,
        sum(1 for w in words if len(w) > 2 and w.isupper()) / n,
        1000 * count("!") / chars,
        1000 * count("?") / chars,
        1000 * sum(map(count, ".,;:")) / chars,
        1000 * sum(map(count, "#*$%&|<>")) / chars,
        1000 * len(_LONG_RUN.findall(text)) / chars,
        1000 * len(odd) / chars,
        float(hidden),
        1000 * sum(map(count, "0123456789")) / chars,
        sum(map(len, words)) / n,
        len(set(low)) / n,
    ]


def _least_gap(a: list[int], b: list[int]) -> int:
    """The least distance between two sorted lists of places."""
    at = np.searchsorted(b, a)
    b = np.array(b)
    a = np.array(a)
    return int(min(np.abs(a - b[np.minimum(at, len(b) - 1)]).min(), np.abs(a - b[np.maximum(at - 1, 0)]).min()))


def _featured(lexicon: dict[str, float]):
    out = pa.schema([("doc", pa.string()), ("f", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                f = [features(t, lexicon) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(f, out.field(1).type)], schema=out)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: documents with each word, by label."""
    seen: dict[str, list[int]] = {}
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in {x.lower() for x in _WORD.findall(text)}:
                seen.setdefault(w, [0, 0])[toxic] += 1
        if len(seen) > 500_000:
            yield _flush(seen)
    if seen:
        yield _flush(seen)


def _flush(seen: dict[str, list[int]]) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["word", "clean", "toxic"])
    seen.clear()
    return batch


def learn_lexicon(labelled: DataFrame, size: int = LEXICON) -> dict[str, float]:
    """The words whose presence speaks most for toxicity, with their log odds: labelled(toxic, text)."""
    total = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    bad, good = total.t, total.n - total.t
    if not bad or not good:
        return {}
    counts = labelled.select("toxic", "text").mapInArrow(_counted, "word string, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (good + 1.0))
    strong = counts.where(F.col("toxic") >= F.greatest(F.lit(3), F.lit(bad * 0.002))).withColumn("odds", odds).where("odds > 1.5")
    return {r.word: float(r.odds) for r in strong.orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "word").limit(size).collect()}


def _fold(doc: str):
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(doc), F.lit("")), "utf-8")), F.lit(4))


def score(docs: DataFrame, labels: DataFrame, rounds: int = 40, depth: int = 4, lexicon_size: int = LEXICON, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score (a calibrated probability), predicted (score >= 0.3)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("string").alias("doc"), text.alias("text"))
    marks = labels.select(labels["doc_id"].cast("string").alias("doc"), labels["toxic"].cast("int").alias("toxic")).where("doc is not null and toxic in (0, 1)")
    marks = marks.groupBy("doc").agg(F.max("toxic").alias("toxic")).where(_fold("doc") != HELD_OUT)
    known = marks.count()
    if known > max_rows:
        marks = marks.where(F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < int((1 << 20) * max_rows / known))
    marks = materialize(marks, "marks")
    lexicon = learn_lexicon(rows.join(marks, "doc").select("toxic", "text"), lexicon_size)
    made = materialize(rows.mapInArrow(_featured(lexicon), "doc string, f array<double>"), "features")
    train = materialize(made.join(marks, "doc"), "training")
    train = train.select(array_to_vector("f").alias("features"), F.col("toxic").cast("double").alias("label"), F.pmod(F.xxhash64("f"), F.lit(4)).alias("part"))
    fit, rest = train.where("part < 3").persist(), train.where("part = 3").persist()
    share = train.agg(F.avg("label")).first()[0]
    doc = F.col("doc").cast(docs.schema["doc_id"].dataType).alias("doc_id")
    held = (_fold("doc") == HELD_OUT).alias("held_out")
    if fit.agg(F.countDistinct("label")).first()[0] < 2 or rest.isEmpty():
        flat = float(share or 0.0)
        return made.select(doc, held, F.lit(flat).alias("score"), F.lit(int(flat >= CUT)).alias("predicted"))
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.15, subsamplingRate=0.8, seed=7, minInstancesPerNode=5, maxMemoryInMB=128).fit(fit)
    margin = lambda d: trees.transform(d).withColumn("margin", vector_to_array("rawPrediction")[1])
    calibrated = margin(rest).select("margin", "label")
    isotonic = IsotonicRegression(featuresCol="margin", labelCol="label").fit(calibrated)
    fit.unpersist()
    rest.unpersist()
    scored = isotonic.transform(margin(made.select("doc", array_to_vector("f").alias("features"))).select("doc", "margin"))
    # calibration gives steps; a small share of the margin's own order keeps ties apart
    smooth = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.98 * F.col("prediction") + 0.02 / (1 + F.exp(-2 * F.col("margin")))))
    return scored.select(doc, held, smooth.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
