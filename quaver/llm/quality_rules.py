"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared with references, one a language, by the
Jensen-Shannon distance (base 2, so 0 to 1). A reference is the sum over all documents of a language tag that pass the base
rules; a tag of fewer than min_reference such documents is none. A document is held to the nearest reference, so a wrong or
missing tag costs nothing, and its own counts are taken off that of its own tag, so it never vouches for itself. Short texts
have noisy histograms: below min_chars or min_words (of words) a distance is not judged, and without any reference none is.

The common words of a tag are learned: those with a share of at least common_share of its words. Words are first counted in
BINS hashed bins, one grouped aggregation; only those in bins of that share, few, are then counted one by one. The number of
common words is bounded by 1 / common_share a tag, whatever the size of the corpus, and no tag is left out.

Base rules: fewer than min_words_base words, or more than half of the words in 3-word windows that recur.

Scale: texts are read three times (bins, candidates, measures) and never shuffled; all else are narrow rows. References go to
the tasks; they are a row a tag with min_reference documents. Nulls and empty texts have no words and fail the base rules; a
null language is a tag of its own. Rows that repeat are judged alike, one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Words, chunks, lists, materialize, shingles, string_buffers

#: Bins of characters: other ASCII, lower-case vowels, other lower-case letters, capitals, digits, blanks, sentence marks, other marks, symbols, Latin beyond ASCII, other scripts.
CLASSES = 11
SYMBOLS = b"#*$%&|<>"
MIN_WORDS_BASE, REPEAT_PERCENT = 50, 50
MIN_CHARS, MIN_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 200, 100, 0.28, 0.42
COMMON_SHARE, MIN_REFERENCE, WORD_BINS, TAGS = 0.004, 20, 4096, 64


def _classes() -> np.ndarray:
    t = np.zeros(256, np.int64)
    for k, chars in ((1, b"aeiou"), (2, b"bcdfghjklmnpqrstvwxyz"), (3, bytes(range(0x41, 0x5B))), (4, b"0123456789"), (5, b" \t\n\r"), (6, b".,;:!?'\"-"), (7, b"()[]{}/\\_@+=~^`"), (8, SYMBOLS)):
        t[list(chars)] = k
    t[0x80:0xC0] = -1  # a character's further bytes
    t[0xC0:0xCA] = 9
    t[0xCA:] = 10
    return t


_CLASS = _classes()
_BARE = np.zeros(256, bool)
_BARE[[b for b in range(256) if _CLASS[b] in (6, 7, 8)]] = True


def plain_words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Lower-cased words without the marks around and within them."""
    bare = buf.copy()
    bare[_BARE[bare]] = 0x20
    return Words(bare, offsets, WHITE, lower=True)


def _tagged_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """(tag, hashes) of the words of runs of texts, of one tag each."""
    for batch in batches:
        buf, offsets = string_buffers(batch.column(1))
        coded = batch.column(0).dictionary_encode()
        names, tag = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j, raw, at in chunks(buf, offsets):
            words = plain_words(raw, at)
            of = np.repeat(tag[i:j], np.diff(words.first))
            for k in np.unique(of).tolist():
                yield names[k], words.hash[of == k]


def _bin(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(WORD_BINS - 1)).astype(np.int64)


def _binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by tag and bin."""
    total: dict[str, np.ndarray] = {}

    def counted() -> pa.RecordBatch:
        names = list(total)
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), lists([total[x] for x in names], pa.int64()) if names else pa.array([], pa.list_(pa.int64()))], names=["lang", "n"])
        total.clear()
        return out

    for tag, hashes in _tagged_words(batches):
        if tag not in total and len(total) >= TAGS:
            yield counted()
        total[tag] = total.get(tag, 0) + np.bincount(_bin(hashes), minlength=WORD_BINS)
    yield counted()


def _candidates(heavy: dict[str, np.ndarray]):
    """Words of heavy bins, by tag and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, list[np.ndarray]] = {}
            for tag, hashes in _tagged_words(iter([batch])):
                if tag in heavy:
                    total.setdefault(tag, []).append(hashes[heavy[tag][_bin(hashes)]])
            for tag, parts in total.items():
                word, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([tag] * len(word), pa.string()), pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "word", "n"])

    return run


def common_words(rows: DataFrame, share: float = COMMON_SHARE) -> np.ndarray:
    """The hashes, sorted, of all words with that share of the words of any tag: rows(lang, text)."""
    bins = rows.mapInArrow(_binned, "lang string, n array<bigint>").select("lang", F.posexplode("n").alias("bin", "n")).where("n > 0").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    bins = materialize(bins, "word-bins")
    totals = bins.groupBy("lang").agg(F.sum("n").alias("total"))
    heavy: dict[str, np.ndarray] = {}
    # at most 1 / share bins a tag
    for r in bins.join(totals, "lang").where(F.col("n") >= share * F.col("total")).select("lang", "bin").toLocalIterator():
        heavy.setdefault(r.lang, np.zeros(WORD_BINS, bool))[r.bin] = True
    if not heavy:
        return np.zeros(0, np.uint64)
    words = rows.mapInArrow(_candidates(heavy), "lang string, word bigint, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = words.join(totals, "lang").where(F.col("n") >= share * F.col("total")).select("word").distinct()
    return np.sort(np.array([r.word for r in words.collect()], np.int64).view(np.uint64))  # at most 1 / share words a tag


def repeated_words(hashes: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more."""
    if len(hashes) < 4:
        return 0
    grams = shingles(hashes, 3)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    hit = np.zeros(len(grams), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    cover = np.zeros(len(hashes), bool)
    for k in range(3):
        cover[k : k + len(grams)] |= hit
    return int(cover.sum())


def measure(buf: np.ndarray, offsets: np.ndarray, common: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every text of a chunk; common: the sorted hashes of the words that have a bin each."""
    n, size = len(offsets) - 1, len(buf)
    words = Words(buf, offsets, WHITE, lower=False)
    at = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets]
    kind = _CLASS[buf]
    out = {"n_words": np.diff(words.first), "word_chars": np.diff(at(WHITE[buf] & (kind >= 0))), "n_symbols": np.diff(at(kind == 8))}
    doc = np.repeat(np.arange(n), np.diff(offsets))
    width = len(common) + 1
    hist = np.zeros((n, CLASSES + width), np.int64)
    own = kind >= 0
    hist[:, :CLASSES] = np.bincount(doc[own] * CLASSES + kind[own], minlength=n * CLASSES).reshape(n, CLASSES)
    plain = plain_words(buf, offsets)
    column = np.full(len(plain.hash), len(common))
    if len(common):
        spot = np.minimum(np.searchsorted(common, plain.hash), len(common) - 1)
        column = np.where(common[spot] == plain.hash, spot, len(common))
    of = np.repeat(np.arange(n), np.diff(plain.first))
    hist[:, CLASSES:] = np.bincount(of * width + column, minlength=n * width).reshape(n, width)
    out["hist"] = hist
    # lines: split at line feeds, with a word
    lines = Words(buf, offsets, ~(np.arange(256) == 0x0A), lower=False)
    held = np.concatenate([[0], np.cumsum(words_start_flags(words, size))])
    full = held[lines.end] > held[lines.start]
    repeat, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(n):
        own_lines = lines.hash[lines.first[d] : lines.first[d + 1]][full[lines.first[d] : lines.first[d + 1]]]
        if len(own_lines) > 1:
            dup[d] = len(own_lines) - len(np.unique(own_lines))
        repeat[d] = repeated_words(words.hash[words.first[d] : words.first[d + 1]])
    return out | {"n_dup_lines": dup, "n_repeat_words": repeat}


def words_start_flags(words: Words, size: int) -> np.ndarray:
    flags = np.zeros(size, np.int64)
    flags[words.start] = 1
    return flags


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(common: np.ndarray):
    out = pa.schema([("key", pa.string()), ("lang", pa.string()), *((c, pa.int64()) for c in _COUNTS), ("hist", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = string_buffers(batch.column(2))
            for i, j, raw, at in chunks(buf, offsets):
                m = measure(raw, at, common)
                hist = lists(list(m["hist"].astype(np.int32)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *(pa.array(m[c]) for c in _COUNTS), hist], schema=out)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's documents and sums of histograms, by tag."""
    total: dict[str, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.int64()))], names=["lang", "hist"])
        total.clear()
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        hist = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in set(langs.tolist()):
            if lang not in total and len(total) >= 16 * TAGS:
                yield flush()
            own = langs == lang
            total[lang] = total.get(lang, 0) + np.append(own.sum(), hist[own].sum(axis=0, dtype=np.int64))
    if total:
        yield flush()


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of counts p to the counts q, one row for all or a row each."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = np.atleast_2d(q)
    q = q / np.maximum(q.sum(axis=1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip(kl / 2, 0, 1))


def _judged(references: dict[str, np.ndarray], max_char: float, max_word: float, min_chars: int, min_words: int):
    out = pa.schema([("key", pa.string()), *((c, pa.int64()) for c in _COUNTS), ("base_failed", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                hist = batch.column("hist").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
                failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
                tags = np.array(batch.column("lang").to_pylist(), object)
                nearest = np.full((2, batch.num_rows), np.inf)
                for tag, reference in references.items():
                    own = np.where((tags == tag) & ~failed, 1, 0)[:, None]
                    for k, part in enumerate((slice(0, CLASSES), slice(CLASSES, None))):
                        # a document's own counts are no part of what it is held to
                        nearest[k] = np.minimum(nearest[k], distance(hist[:, part], reference[None, part] - own * hist[:, part]))
                nearest[np.isinf(nearest)] = 0
                c, w = nearest
                kept = ~failed & ((c <= max_char) | (hist[:, :CLASSES].sum(axis=1) < min_chars)) & ((w <= max_word) | (hist[:, CLASSES:].sum(axis=1) < min_words))
                yield pa.RecordBatch.from_arrays([batch.column("key"), *(batch.column(k) for k in _COUNTS), batch.column("base_failed"), pa.array(c), pa.array(w), pa.array(kept)], schema=out)

    return run


def assess(docs: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, min_reference: int = MIN_REFERENCE, common_share: float = COMMON_SHARE) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, its distances to the nearest references, kept."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("string").alias("key"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"), text.alias("text"))
    common = common_words(rows.select("lang", "text"), common_share)
    counts = ", ".join(f"{c} bigint" for c in _COUNTS)
    made = rows.mapInArrow(_measured(common), f"key string, lang string, {counts}, hist array<int>")
    failed = F.expr(f"n_words < {MIN_WORDS_BASE} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")
    made = materialize(made.withColumn("base_failed", failed), "measured")
    sums = made.where("not base_failed").select("lang", "hist").mapInArrow(_summed, "lang string, hist array<bigint>")
    sums = sums.select("lang", F.posexplode("hist").alias("bin", "n")).groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    tags = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("h")).where(F.col("h")[0]["n"] >= min_reference)
    references = {r.lang: np.array([x.n for x in r.h[1:]], np.int64) for r in tags.collect()}  # a row a tag with enough documents
    schema = f"key string, {counts}, base_failed boolean, char_distance double, word_distance double, kept boolean"
    judged = made.select("key", "lang", *_COUNTS, "base_failed", "hist").mapInArrow(_judged(references, max_char, max_word, min_chars, min_words), schema)
    return judged.select(F.col("key").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *(c for c in judged.columns if c != "key"))
