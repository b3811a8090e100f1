"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of all test items feed one suffix automaton. Documents stream through it: after every word the pair
(state, length) gives the longest suffix that occurs in any item. Where that length reaches the window, the window's words
are hit, and the state's ancestor for the window length names the items. Hit spans longer than a limit are cut out, and
documents that are covered beyond a limit are dropped.

Scale: items are split into blocks of at most block_words words (a longer item is cut into segments that overlap by a
window less one word, which keeps every window). An automaton has at most two states a word, so what a task holds is bounded
by block_words whatever the size of the benchmark; documents pass all blocks one after another and partial results of a
document are merged by its row key. With one block, the usual case, nothing is shuffled.

Null texts and texts without a word have no hits; null items and items without a word have no windows; a null item_id hits
but is not counted or listed; repeated items count once by their id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, Words, broadcast_if_small, chunks, materialize, shingles, slices, string_buffers

WINDOW = 10
BLOCK_WORDS = 200_000
WINDOW_BITS, MOST_BITS = 16, 1 << 30
_TABLE = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and gives the runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_TABLE).split()


class Automaton:
    """A generalised suffix automaton over word ids with, for each state, the items of the window that ends there."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for i, ws in items if ws]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.shortest = min([window, *(len(ws) for _, ws in coded)])
        self._name_windows(coded)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def step(self, state: int, n: int, w: int) -> tuple[int, int]:
        """The state and length of the longest suffix that occurs in an item, after one more word."""
        nxt, link, length = self.next, self.link, self.length
        while state and w not in nxt[state]:
            state = link[state]
            n = length[state]
        to = nxt[state].get(w)
        return (0, 0) if to is None else (to, n + 1)

    def _at(self, state: int, n: int) -> int:
        """The state that holds the suffix of n words of a state's strings."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _name_windows(self, coded: list[tuple[str | None, list[int]]]) -> None:
        full: dict[int, set] = {}
        short: dict[int, dict[int, set]] = {}
        for item, ws in coded:
            state = n = 0
            for w in ws:
                state, n = self.step(state, n, w)
                if n >= self.window:
                    full.setdefault(self._at(state, self.window), set()).add(item)
            if len(ws) < self.window:
                short.setdefault(self._at(state, len(ws)), {}).setdefault(len(ws), set()).add(item)
        #: For each state: its ancestor of the window length or -1, and the whole short items among its suffixes as (length, items).
        self.window_state = [-1] * len(self.next)
        self.short: list[tuple] = [()] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            own = tuple(sorted(short.get(s, {}).items()))
            self.short[s] = (self.short[up] if up >= 0 else ()) + own
            if self.length[s] >= self.window:
                self.window_state[s] = s if up < 0 or self.length[up] < self.window else self.window_state[up]
        self.items = full

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans [first, end) in order, merged where they touch, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.zeros(len(ids) + 2, np.int8)
        known[1:-1] = ids >= 0
        edge = np.diff(known)
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if b - a < self.shortest:  # every window lies within a run of known words
                continue
            state = n = 0
            for at, w in enumerate(ids[a:b].tolist(), a):
                state, n = self.step(state, n, w)
                reach = 0
                if n >= self.window:
                    reach = self.window
                    found |= self.items[self.window_state[state]]
                for m, items in self.short[state]:
                    if m <= n:
                        reach = max(reach, m)
                        found |= items
                if reach:
                    lo = at + 1 - reach
                    while spans and spans[-1][1] >= lo:
                        lo = min(lo, spans.pop()[0])
                    spans.append((lo, at + 1))
        return spans, found


def _segments(item: str | None, words: list[bytes], window: int, most: int) -> Iterator[tuple[str | None, list[bytes]]]:
    """An item as it is, or, if it is very long, overlapping segments that hold all its windows."""
    for at in range(0, max(1, len(words) - window + 1), most):
        yield item, words[at : at + most + window - 1]


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """Automata over bounded blocks of items; items reach the driver one block at a time."""
    block, n = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    for row in rows.toLocalIterator():
        for part in _segments(row.item_id, words_of(row.text.encode()), window, block_words):
            block.append(part)
            n += len(part[1])
            if n >= block_words:
                yield Automaton(block, window)
                block, n = [], 0
    if block:
        yield Automaton(block, window)


_SPANS = "array<struct<a:int,b:int>>"


def _scanner(automaton: Automaton | None):
    out = pa.schema([("key", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            buf, offsets = string_buffers(batch.column(1))
            raw, at = buf.tobytes(), offsets.tolist()
            n, spans, items = [], [], []
            for i in range(batch.num_rows):
                words = words_of(raw[at[i] : at[i + 1]])
                s, found = automaton.scan(words) if automaton and words else ([], set())
                n.append(len(words))
                spans.append([{"a": a, "b": b} for a, b in s])
                items.append(sorted(x for x in found if x is not None))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(spans, out.field(2).type), pa.array(items, out.field(3).type)], schema=out)

    return run


_JOINED = (
    "aggregate(spans, cast(array() as array<struct<a:int,b:int>>), (acc, s) -> "
    "if(size(acc) > 0 and element_at(acc, -1).b >= s.a, concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, s.b)))), concat(acc, array(s))))"
)


def _several(blocks: Iterator[Automaton]) -> tuple[Automaton | None, bool]:
    """The first block, and whether there are more."""
    first = next(blocks, None)
    return first, next(blocks, None) is not None


class Prefilter:
    """A bit set of the hashes of all windows of a benchmark: a document without any has no hit."""

    def __init__(self, benchmark: DataFrame, window: int, most_bits: int = MOST_BITS):
        self.window, hashes, size = window, {}, 0
        texts = benchmark.select(F.col("text").cast("string").alias("text")).where("text is not null")
        for row in texts.toLocalIterator():
            raw = np.frombuffer(row.text.encode(), np.uint8)
            words = Words(raw, np.array([0, len(raw)]), ALNUM, lower=True).hash
            m = min(window, len(words))
            if m:
                hashes.setdefault(m, []).append(shingles(words, m))
                size += len(words) - m + 1
        self.lengths = sorted(hashes)
        self.mask = np.uint64((1 << min(max(20, (WINDOW_BITS * size).bit_length()), most_bits.bit_length() - 1)) - 1)
        self.bits = np.zeros(int(self.mask) // 8 + 1, np.uint8)
        for parts in hashes.values():
            at = np.unique(np.concatenate(parts) & self.mask)
            np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))

    def may_hit(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text whether a window may occur, and its number of words."""
        buf, offsets = string_buffers(column)
        hit, n = np.zeros(len(column), bool), np.zeros(len(column), np.int64)
        for i, j, raw, at in chunks(buf, offsets):
            w = Words(raw, at, ALNUM, lower=True)
            n[i:j] = np.diff(w.first)
            doc = np.repeat(np.arange(i, j), np.diff(w.first))
            for m in self.lengths:
                if len(doc) >= m:
                    g = shingles(w.hash, m) & self.mask
                    known = (self.bits[(g >> np.uint64(3)).astype(np.int64)] >> (g & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    hit[doc[: len(g)][known & (doc[: len(g)] == doc[m - 1 :])]] = True
        return hit, n


def _sifted(bits, column: str, wanted: bool, report: bool):
    """The rows whose text may have a hit, or those whose text has none; of these, for a report, key and n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, n = bits.value.may_hit(batch.column(batch.schema.get_field_index(column)).cast(pa.string()))
            at = np.flatnonzero(hit == wanted)
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n[at])], names=["key", "n_words"]) if report else rows

    return run


def _united(candidates: DataFrame, blocks: Iterator[Automaton]) -> DataFrame:
    """row, n_words, spans, items of candidates (row, text) over all blocks, of rows with a span. One block at a time is held."""
    rows = candidates.select(F.col("row").cast("string").alias("key"), "text")
    every = None
    for a in blocks:
        found = materialize(rows.mapInArrow(_scanner(a), f"key string, n_words bigint, spans {_SPANS}, items array<string>").where(F.size("spans") > 0), "block")
        every = found if every is None else every.unionAll(found)
    merged = every.groupBy("key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.select(F.col("key").cast("long").alias("row"), "n_words", F.expr(_JOINED).alias("spans"), "items")


def match_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of docs: key (the id as a string), n_words, spans of hit words [a, b) and items (their ids, sorted)."""
    rows = docs.select(F.col(id_col).cast("string").alias("key"), F.col("text").cast("string").alias("text"))
    first, more = _several(automata(benchmark, window, block_words))
    schema = f"key string, n_words bigint, spans {_SPANS}, items array<string>"
    if not more:
        return rows.mapInArrow(_scanner(first), schema)
    bits = docs.sparkSession.sparkContext.broadcast(Prefilter(benchmark, window))
    candidates = materialize(rows.mapInArrow(_sifted(bits, "text", True, False), "key string, text string"), "candidates").withColumn("row", F.monotonically_increasing_id())
    clean = rows.mapInArrow(_sifted(bits, "text", False, True), "key string, n_words bigint").select("key", "n_words", F.expr(f"cast(array() as {_SPANS})").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    united = _united(candidates, automata(benchmark, window, block_words))
    hit = candidates.select("row", "key").join(united, "row").select("key", "n_words", "spans", "items")
    missed = candidates.join(united, "row", "left_anti").select("key", "text").mapInArrow(_scanner(None), schema)
    return clean.unionAll(hit).unionAll(missed)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The report: id, n_words, n_hit, n_items, items, contaminated."""
    kind = docs.schema[id_col].dataType
    return match_spans(docs, benchmark, id_col, window, block_words).select(
        F.col("key").cast(kind).alias(id_col),
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.b - x.a).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        (F.size("spans") > 0).alias("contaminated"),
    )


def _cutter(automaton: Automaton | None, min_span: int, max_coverage: float):
    """Cuts the spans of the automaton or, without one, those of the last column, which goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, whole.schema.get_field_index("text"))):
            column = batch.schema.get_field_index("text")
            texts, keep = batch.column(column).to_pylist(), []
            given = None
            if automaton is None:
                given = [[(s["a"], s["b"]) for s in x or ()] for x in batch.column(batch.num_columns - 1).to_pylist()]
                batch = batch.select(list(range(batch.num_columns - 1)))
            for i, text in enumerate(texts):
                raw = (text or "").encode()
                words = words_of(raw)
                found = given[i] if given is not None else automaton.scan(words)[0] if words else []
                spans = [s for s in found if s[1] - s[0] >= min_span]
                if not spans:
                    keep.append(i)
                elif sum(b - a for a, b in spans) <= max_coverage * len(words):
                    keep.append(i)
                    texts[i] = cut(raw, spans).decode()
            made = batch.set_column(column, batch.schema.field(column), pa.array(texts, batch.schema.field(column).type))
            yield made.take(pa.array(keep, pa.int64()))

    return run


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """raw without the bytes from the first to the last word of each span."""
    table = np.frombuffer(_TABLE, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = table[np.frombuffer(raw, np.uint8)] != 0x20
    edge = np.diff(inside.astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : start[a]])
        at = end[b - 1]
    return b"".join([*out, raw[at:]])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_span: int = 1, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs, all columns, without hit spans of at least min_span words; documents whose such spans hold more than
    max_coverage of their words are dropped (0: every document with such a span). Clean texts stay as they are, nulls too."""
    first, more = _several(automata(benchmark, window, block_words))
    if not more:
        return docs.mapInArrow(_cutter(first, min_span, max_coverage), docs.schema) if first else docs
    # all blocks scan the whole text before anything is cut
    bits = docs.sparkSession.sparkContext.broadcast(Prefilter(benchmark, window))
    candidates = materialize(docs.mapInArrow(_sifted(bits, "text", True, False), docs.schema), "candidates")
    candidates = candidates.select(F.monotonically_increasing_id().alias("row"), F.struct(*(candidates[c] for c in docs.columns)).alias("d"))
    hits = materialize(_united(candidates.select("row", F.col("d.text").cast("string").alias("text")), automata(benchmark, window, block_words)).select("row", "spans"), "spans")
    joined = candidates.join(broadcast_if_small(hits, hits.count()), "row", "left").select("d.*", "spans")
    return docs.mapInArrow(_sifted(bits, "text", False, False), docs.schema).unionAll(joined.mapInArrow(_cutter(None, min_span, max_coverage), docs.schema))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of the query op1."""
    r = contamination(docs, benchmark)
    return r.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def items_digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
