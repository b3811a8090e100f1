"""Near-duplicate passages by compact windows.

A text is its sequence of 5-word shingles. Under a hash function, the nodes of its Cartesian tree (least hash at the root, the
first of equal ones) that span at least W shingles are its compact windows (l, c, r): every subsequence that starts in [l, c]
and ends in [c, r] has its least hash at c, so all of them are kept as one. Passages of min_words words are subsequences of
W shingles; those of a window start in the interval [max(l, c - W + 1), min(c, r - W + 1)]. The functions go in pairs, and the
intervals of a pair are joined: where two overlap, all passages that start in the overlap share both least hashes, and
these two are the signature of that joint window. Passages of equal words have equal signatures under every pair; of passages
with similarity 0.8, each pair of functions agrees on 0.64, and one of three on 0.95.

1. A class is the documents of one text; those of a class of several repeat as a whole (kind copy).
2. Signatures that only one class has are dropped: (signature, class) is counted, combined before the shuffle, and joined with
   what repeats. Nothing else of the windows is moved or kept.
3. The texts of classes with a repeated signature are read once more. Around the centers of repeated windows of the first pair,
   frames of min_words - 4 words at offsets of 5 are taken. A passage of min_words that is repeated word for word has its
   center at the same place in both texts, so one frame lies inside it in both. Frames are compared as words, by a 128-bit
   digest of them; those of two or more classes are exact passages, told to within 4 words at either end. Nothing is paired: a
   passage of any number of documents costs a row a document and frame.
4. Near-duplicate passages are sought where windows lie outside exact passages. Windows that no passage of any length can hold,
   because too many of the distinct shingles around them are near no other class's windows, go first; that is certain. Per
   signature the rest meet the windows of one class, the hub; the shingles of both texts are compared along the diagonals of
   their centers, and passages with the similarity are near, once their words confirm it. Windows that are still outside all
   passages meet another hub in the next of `rounds` rounds, which cost no more than their rows.
5. Every window that holds a place outside all passages then meets all other classes' windows around places of such lists, by rare
   shingles of which similar windows have one in common (a prefix filter): no similar pair is left out. Windows meet by their
   contents, the sets of shingles that several classes have, so that copies and near copies of a window count once.

Results are rows of documents that hold repeated passages; others have none: doc_id, start, end (words [start, end)), kind
(copy, exact or near), class_id (a document that holds the passage, the same for all that hold it word for word), text_id (a
hash of the text, which tells rows with one doc_id and different texts apart). Of a class of several documents the first has the exact and near rows.
Null and short texts hold none. Rows without a doc_id take no part. Rows that repeat a doc_id and its text are one document.
Doc_ids may be of any type that can be cast to a string and ordered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK, LOWER, SHINGLE, WHITE, Words, broadcast_if_small, chunks, lists, materialize, mix, shingles, slices, string_buffers

MIN_WORDS, BANDS, STEP, ROUNDS = 50, 3, 5, 3
#: Starts whose windows are found at once, and classes a task remembers so as not to repeat equal texts.
STARTS, REMEMBERED = 1 << 18, 1 << 18
#: Shingles of texts that a task keeps at once while it compares pairs.
KEPT = 1 << 22
#: Bits a text, and at most, in the set that says which texts a join may need.
SIEVE_BITS, MOST_BITS = 16, 1 << 26
_SEED = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_PLACE = np.uint64((1 << 24) - 1)
_LOWER = bytes(LOWER)


def compact_windows(h: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(l, c, r), all inclusive, of the Cartesian tree's nodes of at least width values, in order of c; of equal least values the
    first is the root."""
    centers = np.unique(_centers(h, width)).tolist()
    # ancestors of a node that spans width values do so too, hence what bounds a node on either side is among the centers
    left, right, open_ = [0] * len(centers), [len(h) - 1] * len(centers), []
    for i, c in enumerate(centers):
        while open_ and h[centers[open_[-1]]] > h[c]:
            right[open_.pop()] = c - 1
        left[i] = centers[open_[-1]] + 1 if open_ else 0
        open_.append(i)
    return list(zip(left, centers, right, strict=True))


def _centers(h: np.ndarray, width: int) -> np.ndarray:
    """For every start the place of the first least of width values: minima over spans that double."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    m, span = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return (np.minimum(m[:n], m[width - span :][:n]) & _PLACE).astype(np.int64)


def joint_windows(words: np.ndarray, first: np.ndarray, width: int, n: int, bands: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(band, document, signature, first start, last start, center) of the joint windows of the texts first[i]:first[i + 1] of words,
    STARTS starts at a time; places count in words."""
    for a in range(0, len(words) - width - n + 2, STARTS):
        part = words[a : a + STARTS + width + n - 2]
        g = shingles(part, n)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(np.clip(first, a, a + len(part))))
        starts = len(g) - width + 1
        own = np.flatnonzero(doc[:starts] == doc[width + n - 2 :])
        if not len(own):
            continue
        for band in range(bands):
            c, d = (_centers(mix(g ^ _SEED[2 * band + k]), width)[own] for k in (0, 1))
            new = np.ones(len(own), bool)
            new[1:] = (c[1:] != c[:-1]) | (d[1:] != d[:-1]) | (np.diff(own) > 1)
            head = np.flatnonzero(new)
            last = np.append(head[1:], len(own)) - 1
            v = mix(mix(g[c[head]] ^ _SEED[20 + band]) + g[d[head]])
            yield band, doc[own[head]], v, own[head] + a, own[last] + a, c[head] + a


def _bit_set(values: DataFrame, name: str, most_bits: int = MOST_BITS):
    """A set of bits of bounded size, as a broadcast: two bits a value of a column of 64-bit hashes."""
    spark = values.sparkSession
    value = F.col(name)
    size = 1 << min(most_bits.bit_length() - 1, max(12, (SIEVE_BITS * values.agg(F.approx_count_distinct(name)).first()[0]).bit_length()))
    at = values.select(F.explode(F.array(value.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(value, 32).bitwiseAND(F.lit(size - 1)))).alias("at"))
    set_ = at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size >> 6, np.uint64)
    bits[set_.column("i").to_numpy()] = set_.column("bits").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(bits)


def _in_bits(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """True for every value of the set, and for few others."""
    last = np.uint64(64 * len(bits) - 1)
    ok = np.ones(len(values), bool)
    for at in (values & last, (values >> np.uint64(32)) & last):
        ok &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


def _sieve(reps: DataFrame, most_bits: int = MOST_BITS):
    """A test of columns: true for every rep of reps, and for few others, so that a join moves few rows in vain."""
    shared = _bit_set(reps, "rep", most_bits)

    @F.arrow_udf("boolean")
    def may_be(column: pa.Array) -> pa.Array:
        return pa.array(_in_bits(shared.value, column.to_numpy(zero_copy_only=False).view(np.uint64)))

    return may_be


def _signed(width: int, n: int, bands: int):
    """The signatures of each text, each once: (v, rep). A task passes over texts that it has had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if len(had) > REMEMBERED:
                had.clear()
            fresh = [i for i, x in enumerate(ids.tolist()) if not (x in had or had.add(x))]
            if not fresh:
                continue
            batch = batch.take(pa.array(fresh))
            ids = ids[fresh]
            buf, offsets = string_buffers(batch.column(1))
            for i, _, raw, at in chunks(buf, offsets):
                w = Words(raw, at, WHITE, lower=True)
                docs, values = [], []
                for _, doc, v, *_ in joint_windows(w.hash, w.first, width, n, bands):
                    order = np.lexsort((v, doc))
                    doc, v = doc[order], v[order]
                    new = np.ones(len(v), bool)
                    new[1:] = (v[1:] != v[:-1]) | (doc[1:] != doc[:-1])
                    docs.append(doc[new])
                    values.append(v[new])
                if docs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values).view(np.int64)), pa.array(ids[i:][np.concatenate(docs)])], names=["v", "rep"])

    return run


def _opened(width: int, n: int, bands: int, frame: int):
    """The windows of repeated signatures (v, center c) and the frames (f, a) of each text, beside it."""
    i64, i32 = pa.int64(), pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, CHUNK):
                live = batch.column(1)
                buf, offsets = string_buffers(batch.column(2))
                w = Words(buf, offsets, WHITE, lower=True)
                space = mix(np.arange(batch.num_rows, dtype=np.uint64) + np.uint64(1))  # each text has signatures of its own
                known = np.sort(live.flatten().to_numpy().view(np.uint64) ^ np.repeat(space, live.value_lengths().to_numpy()))
                found, spots = [], []
                for band, doc, v, s, e, c in joint_windows(w.hash, w.first, width, n, bands):
                    mine = v ^ space[doc]
                    k = np.flatnonzero(known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine)
                    at = w.first[doc[k]]
                    found.append(np.stack([doc[k], v[k].view(np.int64), c[k] - at]))
                    if band == 0:
                        spots.append(np.stack([doc[k], s[k] - at, e[k] - at, c[k] - at]))
                doc, v, c = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
                order = np.argsort(doc, kind="stable")
                cut = np.cumsum(np.bincount(doc, minlength=batch.num_rows))[:-1]
                of, start = _frame_starts(np.concatenate(spots, axis=1) if spots else np.zeros((4, 0), np.int64), frame, np.diff(w.first))
                starts = np.split(start, np.cumsum(np.bincount(of, minlength=batch.num_rows))[:-1])
                digests = []
                for row, own in enumerate(starts):
                    text = buf[offsets[row] : offsets[row + 1]].tobytes().translate(_LOWER).split() if len(own) else []
                    digests.append([hashlib.blake2b(b" ".join(text[a : a + frame]), digest_size=16).digest() for a in own.tolist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), lists(np.split(v[order], cut), i64), lists(np.split(c[order], cut), i32), pa.array(digests, pa.list_(pa.binary())), lists(starts, i32)],
                    names=["rep", "text", "v", "c", "f", "a"],
                )

    return run


def _frame_starts(spots: np.ndarray, frame: int, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, start), each once and sorted, of the frames at multiples of STEP before each center that a passage which starts in the
    interval can hold; spots: text, first start, last start, center."""
    doc, s, e, c = (x[:, None] for x in spots)
    a = c - np.arange(0, frame, STEP)[None, :]
    ok = (a >= s) & (a < e + STEP) & (a + frame <= n_words[doc])
    both = np.unique(np.stack([np.broadcast_to(doc, a.shape)[ok], a[ok]]), axis=1) if ok.any() else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def _islands(spans: DataFrame) -> DataFrame:
    """(rep, a, b, first): spans of one rep that touch or overlap, joined; first is the least class among them."""
    before = Window.partitionBy("rep").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("rep").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col("a") <= F.max("b").over(before), 0).otherwise(1)
    marked = spans.withColumn("new", new).withColumn("island", F.sum("new").over(upto))
    return marked.groupBy("rep", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("first").alias("first")).drop("island")


def _similar(ga: list[int], gb: list[int], spots: set[tuple[int, int]], width: int, percent: int, thrifty: bool = False) -> Iterator[tuple[int, int, int]]:
    """(x, y, d): every window of width shingles from x to y in a is similar to the one d before it in b. On the diagonal of each
    spot all windows that hold it are compared, and on from there as long as they are similar. thrifty: spots whose places lie in
    passages found before, in a and in b, are passed over; texts of one repeated line have as many diagonals as lines."""
    found: list[tuple[int, int, int]] = []
    lines: dict[int, list[int]] = {}
    for x, y in spots:
        lines.setdefault(x - y, []).append(x)
    for d, at in lines.items():
        first, last = max(0, d), min(len(ga), len(gb) + d) - width
        x = first
        for k, c in enumerate(sorted(at)):
            if k and c < x - 1:
                continue
            if thrifty and any(a <= c < b + width for a, b, _ in found) and any(a - e <= c - d < b - e + width for a, b, e in found):
                continue
            lo, hi = max(x, c - width + 1), min(c, last)
            if lo > hi:
                continue
            # to the left as long as windows are similar
            while lo > x and _alike(ga[lo - 1 : lo - 1 + width], gb[lo - 1 - d : lo - 1 - d + width], percent):
                lo -= 1
            pa_, pb, common, start, bad = {}, {}, 0, None, 0
            for own, other, part in ((pa_, pb, ga[lo : lo + width]), (pb, pa_, gb[lo - d : lo - d + width])):
                for v in part:
                    own[v] = own.get(v, 0) + 1
                    common += own[v] == 1 and v in other
            x = lo
            while True:
                good = 100 * common >= percent * (len(pa_) + len(pb) - common)
                if good and start is None:
                    start = x
                if not good and start is not None:
                    found.append((start, x - 1, d))
                    yield found[-1]
                    start = None
                bad = 0 if good else bad + 1
                if x >= last or (x >= hi and bad > width // 4):  # two edits next to each other spoil a few windows only
                    break
                for own, other, gone, new in ((pa_, pb, ga[x], ga[x + width]), (pb, pa_, gb[x - d], gb[x - d + width])):
                    own[gone] -= 1
                    if not own[gone]:
                        del own[gone]
                        common -= gone in other
                    own[new] = own.get(new, 0) + 1
                    common += own[new] == 1 and new in other
                x += 1
            if start is not None:
                found.append((start, x, d))
                yield found[-1]
            x += 1


def _alike(p: list, q: list, percent: int) -> bool:
    common = len(set(p) & set(q))
    return 100 * common >= percent * (len(set(p)) + len(set(q)) - common)


def _before(g: np.ndarray, width: int) -> np.ndarray:
    """The place of the same value before each, along the last axis; -width where there is none."""
    order = np.argsort(g, axis=-1, kind="stable")
    held = np.take_along_axis(g, order, -1)
    same = held[..., 1:] == held[..., :-1]
    out = np.full(g.shape, -width)
    np.put_along_axis(out, order[..., 1:], np.where(same, order[..., :-1], -width), -1)
    return out


def _hopeful(g: np.ndarray, foreign: np.ndarray, c: np.ndarray, width: int, percent: int) -> np.ndarray:
    """Which places c may lie in a window that is similar to a text that lacks the foreign shingles: at most (100 - percent) percent of
    a similar window's distinct shingles are lacking."""
    n = len(g) - width + 1
    i = np.arange(len(g))
    first = np.maximum(np.maximum(_before(g, width) + 1, i - width + 1), 0)  # of the windows from first to i it is the first of its kind

    def distinct(some: np.ndarray) -> np.ndarray:
        return np.cumsum(np.bincount(first[some], minlength=len(g) + 1) - np.bincount(i[some] + 1, minlength=len(g) + 1))[:n]

    good = np.concatenate([[0], np.cumsum(100 * distinct(foreign) <= (100 - percent) * distinct(np.ones(len(g), bool)))])
    return good[np.clip(c + 1, 0, n)] > good[np.clip(c - width + 1, 0, n)]


def _promising(g: np.ndarray, at_x: np.ndarray, room_x: np.ndarray, at_y: np.ndarray, room_y: np.ndarray, width: int, percent: int) -> np.ndarray:
    """Which spots may lie in similar windows, for many at once. at: a spot's place in g; room: places before it and after it in its
    text, as (n, 2). Of either window at most (100 - percent) percent of the shingles may be nowhere within width of the other's spot."""
    k = np.arange(1 - width, width)
    n = np.arange(len(at_x), dtype=np.uint64)[:, None]
    sides = []
    for at, room in ((at_x, room_x), (at_y, room_y)):
        inside = (k >= -room[:, :1]) & (k <= room[:, 1:])
        value = g[np.where(inside, at[:, None] + k, 0)] ^ mix(n + np.uint64(1))  # each spot in a space of its own
        sides.append((value, inside))
    good = None
    for (value, inside), (other, held) in (sides, sides[::-1]):
        missing = inside & ~np.isin(value, other[held])
        row = np.where(inside, value, np.arange(len(k), dtype=np.uint64))
        held_twice = np.sort(row, axis=1)
        repeats = np.flatnonzero((held_twice[:, 1:] == held_twice[:, :-1]).any(axis=1))
        lost, kinds = (_sums(np.where(inside, x, width), width) for x in (missing, np.ones(missing.shape, bool)))
        for lo in range(0, len(repeats), 256):  # distinct ones: of a window's shingles the first of each kind
            some = repeats[lo : lo + 256]
            first = (_before(row[some], width)[:, None, :] < np.arange(width)[None, :, None]) & _windows_around(width)
            kinds[some], lost[some] = first.sum(axis=2), (first & missing[some][:, None, :]).sum(axis=2) + _sums(np.where(inside[some], 0, width), width)
        few = 100 * lost <= (100 - percent) * kinds
        few &= lost < width
        good = few if good is None else good & few
    return good.any(axis=1)


def _sums(x: np.ndarray, width: int) -> np.ndarray:
    """Sums of width neighbours along rows."""
    total = np.zeros((len(x), x.shape[1] + 1), np.int32)
    np.cumsum(x, axis=1, out=total[:, 1:])
    return total[:, width:] - total[:, :-width]


def _windows_around(width: int) -> np.ndarray:
    """Which places each window around a spot holds."""
    at, s = np.arange(2 * width - 1)[None, :], np.arange(width)[:, None]
    return ((at >= s) & (at < s + width))[None]


def _compared(width: int, percent: int, n: int, block: int = 2048):
    """Pairs of texts with the places of agreeing windows, to spans in x whose shingle sets are similar to those of spans in y: told by
    hashes of shingles and confirmed on their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}  # a text is in many pairs of a task
        for whole in batches:
            for part in slices(whole, 3):
                out = [[], [], [], [], [], []]
                xs, ys = (part.column(i).to_numpy().tolist() for i in (0, 1))
                tx, ty = part.column(3), part.column(4)
                first: dict[int, pa.Scalar] = {}
                for reps, column in ((xs, tx), (ys, ty)):
                    for i, rep in enumerate(reps):
                        if rep not in first:
                            first[rep] = column[i]
                new = [rep for rep in first if rep not in kept]
                kept.update(zip(new, (shingles(w, n) for w in _hashes(pa.array([first[rep].as_py() for rep in new], pa.string()))), strict=True))
                grams = [kept[rep] for rep in first]
                if sum(map(len, kept.values())) > KEPT:
                    kept.clear()
                number = {rep: i for i, rep in enumerate(first)}
                size = np.array([len(x) for x in grams], np.int64)
                base = np.cumsum(size) - size
                flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
                spots = part.column(2)
                pair = np.repeat(np.arange(part.num_rows), spots.value_lengths().to_numpy())
                cx, cy = (spots.flatten().field(i).to_numpy().astype(np.int64) for i in (0, 1))
                nx, ny = (np.array([number[r] for r in reps], np.int64)[pair] for reps in (xs, ys))
                ok = np.zeros(len(pair), bool)
                for lo in range(0, len(pair), block):
                    at = slice(lo, lo + block)
                    room = lambda m, c: np.stack([c[at], size[m[at]] - 1 - c[at]], axis=1)  # noqa: E731, B023
                    ok[at] = _promising(flat, base[nx[at]] + cx[at], room(nx, cx), base[ny[at]] + cy[at], room(ny, cy), width, percent)
                left = np.flatnonzero(ok)
                for row, some in zip(*_runs(pair[left], left), strict=True):
                    x, y = xs[row], ys[row]
                    told = list(_similar(grams[number[x]].tolist(), grams[number[y]].tolist(), set(zip(cx[some].tolist(), cy[some].tolist(), strict=True)), width, percent, thrifty=True))
                    for xa, xb, ya, yb in _on_words(told, tx[row].as_py(), ty[row].as_py(), width, percent, n):
                        for k, v in enumerate((x, xa, xb, y, ya, yb)):
                            out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["x", "xa", "xb", "y", "ya", "yb"])

    return run


def _on_words(told: list[tuple[int, int, int]], tx: str, ty: str, width: int, percent: int, n: int) -> list[tuple[int, int, int, int]]:
    """(xa, xb, ya, yb), in words, of what _similar told of two texts, if their words confirm it."""
    if not told:
        return []
    fa, fb = (list(zip(*(w[i:] for i in range(n)), strict=False)) for w in (t.encode().translate(_LOWER).split() for t in (tx, ty)))
    sure = (w for w in told if all(_alike(fa[s : s + width], fb[s - w[2] : s - w[2] + width], percent) for s in {*range(w[0], w[1] + 1, width), w[1]}))
    return [(a, b + width + n - 1, a - d, b - d + width + n - 1) for a, b, d in sure]


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Sorted keys, each once, with the values of each."""
    found, start = np.unique(keys, return_index=True)
    return found.tolist(), np.split(values, start[1:]) if len(found) else []


def _hashes(column: pa.Array) -> list[np.ndarray]:
    """The word hashes of every text."""
    out = []
    buf, offsets = string_buffers(column)
    for i, j, raw, at in chunks(buf, offsets):
        w = Words(raw, at, WHITE, lower=True)
        out += [w.hash[w.first[d] : w.first[d + 1]] for d in range(j - i)]
    return out


def _near(met: DataFrame, texts: DataFrame, width: int, percent: int, n: int, name: str) -> DataFrame:
    """(rep, a, b, first) of both sides of near passages of met (x, y, cx, cy), pairs of classes and of centers of windows that agree."""
    pairs = met.groupBy("x", "y").agg(F.collect_set(F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"))).alias("spots"))
    needed = texts.where(_sieve(met.select(F.explode(F.array("x", "y")).alias("rep")))("rep"))
    text = lambda c, t: needed.select(F.col("rep").alias(c), F.col("text").alias(t))
    both = pairs.join(text("x", "tx"), "x").join(text("y", "ty"), "y").select("x", "y", "spots", "tx", "ty")
    found = materialize(both.mapInArrow(_compared(width, percent, n), "x bigint, xa bigint, xb bigint, y bigint, ya bigint, yb bigint"), name)
    first = F.least("x", "y").alias("first")
    return found.select(F.col("x").alias("rep"), F.col("xa").alias("a"), F.col("xb").alias("b"), first).unionAll(found.select(F.col("y").alias("rep"), F.col("ya").alias("a"), F.col("yb").alias("b"), first))


def _outside(windows: DataFrame, spans: DataFrame) -> DataFrame:
    """windows, with free: no span of the class holds the center's shingle."""
    held = spans.groupBy("rep").agg(F.collect_set(F.struct("a", "b")).alias("held"))
    inside = F.exists("held", lambda s: (s.a <= F.col("c")) & (F.col("c") < s.b))
    return windows.join(held, "rep", "left").withColumn("free", ~F.coalesce(inside, F.lit(False))).drop("held")


def _open_lists(windows: DataFrame) -> DataFrame:
    """The windows of signatures with a window outside passages that has another class to meet."""
    open_ = windows.groupBy("v").agg(F.max("free").alias("free"), F.min("rep").alias("x"), F.max("rep").alias("y")).where("free and x <> y").select("v")
    return windows.join(open_, "v", "left_semi")


def _one_inside(windows: DataFrame) -> DataFrame:
    """windows, of those inside passages one a class and signature."""
    return windows.groupBy("v", "rep", "free", F.when(F.col("free"), F.col("c")).otherwise(-1).alias("at")).agg(F.min("c").alias("c")).select("v", "rep", "c", "free")


def _around(width: int, n: int):
    """The distinct shingles within width of the places c of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 2):
                found = []
                for words, c in zip(_hashes(part.column(2)), part.column(1), strict=True):
                    g = shingles(words, n)
                    at = np.array(c.as_py(), np.int64)
                    edge = np.zeros(len(g) + 1, np.int64)
                    np.add.at(edge, np.clip(at - width + 1, 0, len(g)), 1)
                    np.add.at(edge, np.clip(at + width, 0, len(g)), -1)
                    found.append(np.unique(g[np.cumsum(edge)[:-1] > 0]).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), lists(found, pa.int64())], names=["rep", "g"])

    return run


def _kept(width: int, percent: int, n: int):
    """The places c of each text that lie in a window with few shingles of the text's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 3):
                kept = []
                for words, c, own in zip(_hashes(part.column(3)), part.column(1), part.column(2), strict=True):
                    g, at = shingles(words, n), np.array(c.as_py(), np.int64)
                    foreign = np.isin(g.view(np.int64), np.array(own.as_py() or [], np.int64))
                    kept.append(at[_hopeful(g, foreign, at, width, percent)])
                yield pa.RecordBatch.from_arrays([part.column(0), lists(kept, pa.int32())], names=["rep", "c"])

    return run


def _with_hope(windows: DataFrame, texts: DataFrame, width: int, percent: int, n: int) -> DataFrame:
    """windows without those outside passages whose every passage has too many shingles that are near no other class's windows: by
    counts of shingles, exactly, and without pairs."""
    texts = texts.where(_sieve(windows)("rep"))
    places = windows.groupBy("rep").agg(F.collect_set("c").alias("c")).join(texts, "rep")
    near = places.select("rep", "c", "text").mapInArrow(_around(width, n), "rep bigint, g array<bigint>").select("rep", F.explode("g").alias("g"))
    own = near.groupBy("g").agg(F.min("rep").alias("rep"), F.max("rep").alias("y")).where("rep = y").groupBy("rep").agg(F.collect_list("g").alias("own"))
    free = windows.where("free")
    asked = free.groupBy("rep").agg(F.collect_set("c").alias("c")).join(own, "rep", "left").join(texts, "rep")
    kept = asked.select("rep", "c", "own", "text").mapInArrow(_kept(width, percent, n), "rep bigint, c array<int>")
    kept = materialize(kept.select("rep", F.explode("c").alias("c")), "hopeful")
    return free.join(kept, ["rep", "c"], "left_semi").unionByName(windows.where("not free"))


def _contents(width: int, percent: int, n: int, wanted=None):
    """(t, k, rep, s, e, free, lead): runs s to e of starts of hopeful windows of width that hold a place c and are one content k, a row a
    shingle t by which they can meet similar ones. lead: the first row of a run; free: a window of the run holds a free place.

    Shingles that no other class has make no window similar; the content is the set of the others and the number of all. In the
    order of all shingles, rarest first, similar sets have one in common among their first ones: as many as may be lacking and one
    more. Windows without repeats meet one another by fewer than they need to meet smaller sets, which they do under names of their
    own. Without wanted, a set of bits of names, only windows with a free place and smaller sets are given, with it only names in it."""
    full = -(-2 * percent * width // (100 + percent))  # what two windows without repeats have in common, if similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 4):
                told: list[list[np.ndarray]] = [[] for _ in range(7)]
                for rep, words, c, free, known in zip(part.column(0).to_pylist(), _hashes(part.column(4)), part.column(1), part.column(2), part.column(3), strict=True):
                    g = shingles(words, n).view(np.int64)
                    kinds, g = np.unique(g, return_inverse=True)
                    count = np.ones(len(kinds), np.int64)
                    if known.is_valid and len(known.values):
                        f = known.values.field(0).to_numpy()
                        i = np.minimum(np.searchsorted(kinds, f), len(kinds) - 1)
                        mine = kinds[i] == f
                        count[i[mine]] = known.values.field(1).to_numpy()[mine]
                    order = np.lexsort((kinds, count))
                    kinds = kinds[order].view(np.uint64)  # by rank
                    rank = np.empty(len(kinds), np.int64)
                    rank[order] = np.arange(len(kinds))
                    alone = int((count == 1).sum())
                    windows = np.lib.stride_tricks.sliding_window_view(rank[g], width)
                    c, free = c.values.to_numpy(), free.values.to_numpy(zero_copy_only=False)
                    has_free = _holding(c[free], width, len(windows))
                    starts = np.flatnonzero(_holding(c, width, len(windows)))
                    for lo in range(0, len(starts), 4096):
                        s = starts[lo : lo + 4096]
                        some = np.sort(windows[s], axis=1)
                        new = np.ones(some.shape, bool)
                        new[:, 1:] = some[:, 1:] != some[:, :-1]
                        nth = new.cumsum(axis=1)
                        d = nth[:, -1]
                        shared = new & (some >= alone)
                        room = shared.sum(axis=1)[:, None] - np.stack([np.where(d == width, full, width + 1), (percent * d + 99) // 100], axis=1)
                        keep = (room >= 0).any(axis=1) & (has_free[s] | (d < width) if wanted is None else True)
                        s, some, shared, room, d = s[keep], some[keep], shared[keep], room[keep], d[keep]
                        if not len(s):
                            continue
                        k = mix(np.where(shared, mix(kinds[some]), np.uint64(0)).sum(axis=1, dtype=np.uint64) + mix(d.astype(np.uint64)))
                        head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (np.diff(s) > 1)]))
                        e = s[np.append(head[1:], len(s)) - 1]
                        run_free = np.logical_or.reduceat(has_free[s], head)
                        some, shared, room, d = some[head], shared[head], room[head], d[head]
                        nth = shared.cumsum(axis=1)
                        names = []
                        for way in (0, 1):
                            by = shared & (nth <= room[:, way : way + 1] + 1)
                            if wanted is None and way:
                                by &= (d < width)[:, None]
                            row, at = np.nonzero(by)
                            t = kinds[some[row, at]]
                            names.append((row, mix(t) if way else t))
                        row, t = (np.concatenate(x) for x in zip(*names, strict=True))
                        if wanted is not None:
                            ok = _in_bits(wanted.value, t)
                            row, t = row[ok], t[ok]
                        by_run = np.argsort(row, kind="stable")
                        row, t = row[by_run], t[by_run]
                        lead = np.ones(len(row), bool)
                        lead[1:] = row[1:] != row[:-1]
                        for column, x in zip(told, (t.view(np.int64), k[head].view(np.int64)[row], np.full(len(row), rep), s[head][row], e[row], run_free[row], lead), strict=True):
                            column.append(x)
                if told[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in told], names=["t", "k", "rep", "s", "e", "free", "lead"])

    return run


def _holding(c: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n windows of width hold a place c."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(c - width + 1, 0, n), 1)
    np.add.at(edge, np.clip(c + 1, 0, n), -1)
    return np.cumsum(edge)[:n] > 0


def _agreeing(width: int, percent: int, n: int):
    """Pairs of texts with lists of starts of windows to compare, each of one side with each of the other, to the starts of similar ones
    and to the spans around them as in _compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        inner = np.arange(width)
        for whole in batches:
            for part in slices(whole, 3):
                out: list[list] = [[] for _ in range(5)]
                for x, y, lists_, tx, ty in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                    if sum(map(len, kept.values())) > KEPT:
                        kept.clear()
                    new = {rep: text for rep, text in ((x, tx), (y, ty)) if rep not in kept}
                    kept.update(zip(new, (shingles(w, n) for w in _hashes(pa.array(list(new.values()), pa.string()))), strict=True))
                    ga, gb = kept[x], kept[y]
                    spots: dict[tuple[int, int], float] = {}
                    for some in lists_:
                        sa, sb = np.array(some["sx"], np.int64), np.array(some["sy"], np.int64)
                        for i in range(0, len(sa), 256):
                            for j in range(0, len(sb), 256):
                                ca, cb = sa[i : i + 256], sb[j : j + 256]
                                va, vb = ga[ca[:, None] + inner], gb[cb[:, None] + inner]
                                kinds = np.unique(va)
                                at = np.minimum(np.searchsorted(kinds, vb), len(kinds) - 1)
                                ma, mb = np.zeros((len(ca), len(kinds)), np.float32), np.zeros((len(cb), len(kinds)), np.float32)
                                ma[np.arange(len(ca))[:, None], np.searchsorted(kinds, va)] = 1
                                row, col = np.nonzero(kinds[at] == vb)
                                mb[row, at[row, col]] = 1
                                common = (ma @ mb.T).astype(np.int64)
                                da, db = (1 + (np.diff(np.sort(v, axis=1), axis=1) != 0).sum(axis=1) for v in (va, vb))
                                union = da[:, None] + db[None, :] - common
                                p, q = np.nonzero(100 * common >= percent * union)
                                spots.update(zip(zip(ca[p].tolist(), cb[q].tolist(), strict=True), (common[p, q] / union[p, q]).tolist(), strict=True))
                    told = list(_similar(ga.tolist(), gb.tolist(), set(spots), width, percent, thrifty=True)) if spots else []
                    spans = _on_words(told, tx, ty, width, percent, n)
                    if spans:
                        for column, v in zip(out, (x, y, _best(spots, 0), _best(spots, 1), spans), strict=True):
                            column.append(v)
                several = lambda *names: pa.list_(pa.struct([(name, pa.int64()) for name in names]))
                kinds_ = (pa.int64(), pa.int64(), several("s", "at"), several("s", "at"), several("xa", "xb", "ya", "yb"))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds_, strict=True)], names=["x", "y", "xs", "ys", "spans"])

    return run


def _best(spots: dict[tuple[int, int], float], side: int) -> list[dict[str, int]]:
    """For each start s of one side the start of the other side's most similar window."""
    best: dict[int, tuple[float, int]] = {}
    for pair, alike in spots.items():
        best[pair[side]] = max(best.get(pair[side], (0.0, 0)), (alike, pair[1 - side]))
    return [{"s": s, "at": at} for s, (_, at) in sorted(best.items())]


def _all_near(windows: DataFrame, texts: DataFrame, width: int, percent: int, n: int) -> DataFrame:
    """(rep, a, b, first) of near passages of windows (v, rep, c, free): every window that holds a free place meets every window of another
    class that holds a place, of whatever signature, and none that is similar is lost. Windows of one content are similar to the
    same others; so contents meet, by one or two texts that hold them, and all that hold a similar one are told of it. Those that hold a
    free place are compared beyond the window with up to two of the texts."""
    texts = texts.where(_sieve(windows)("rep"))
    spots = windows.groupBy("rep", "c").agg(F.max("free").alias("free"))
    places = spots.groupBy("rep").agg(F.collect_list(F.struct("c", "free")).alias("p")).select("rep", F.col("p.c").alias("c"), F.col("p.free").alias("free")).join(texts, "rep")
    near = places.select("rep", "c", "text").mapInArrow(_around(width, n), "rep bigint, g array<bigint>").select("rep", F.explode("g").alias("g"))
    counts = near.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    known = near.join(counts, "g").groupBy("rep").agg(F.collect_list(F.struct("g", "n")).alias("known"))
    asked = materialize(places.join(known, "rep", "left").select("rep", "c", "free", "known", "text"), "places")
    schema = "t bigint, k bigint, rep bigint, s bigint, e bigint, free boolean, lead boolean"
    wanted = _bit_set(asked.mapInArrow(_contents(width, percent, n), schema).select("t").distinct(), "t")
    held = materialize(asked.mapInArrow(_contents(width, percent, n, wanted), schema), "contents")
    # a content is met in the first text that holds it; where that is the other side's too, in the last one
    contents = held.groupBy("k", "t").agg(F.min(F.struct("rep", "s")).alias("lo"), F.max(F.struct("rep", "s")).alias("hi"), F.max("free").alias("free"))
    contents = materialize(contents, "met")
    both = F.array(F.struct("lo.rep", "lo.s", F.lit(None).cast("long").alias("beside")), F.struct("hi.rep", "hi.s", F.col("lo.rep").alias("beside")))
    held_by = contents.select("k", "t", "free", F.explode(F.when(F.col("lo.rep") == F.col("hi.rep"), F.slice(both, 1, 1)).otherwise(both)).alias("h"))
    lists_ = held_by.groupBy("t", F.col("h.rep").alias("rep"), F.col("h.beside").alias("beside"), "free").agg(F.collect_list("h.s").alias("s"))
    one = lists_.where("free").select("t", F.col("rep").alias("x"), F.col("beside").alias("bx"), F.col("s").alias("sx"))
    other = lists_.select("t", F.col("rep").alias("y"), F.col("beside").alias("by"), F.col("s").alias("sy"), "free")
    apart = "x <> y and (x < y or not free) and ((bx is null and by is null) or (bx = y and by is null) or (by = x and bx is null))"
    pairs = one.join(other, "t").where(apart).select("x", "y", "sx", "sy")
    own = contents.where("free and lo.rep <> hi.rep").groupBy("k").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    own = own.groupBy(F.col("lo.rep").alias("x"), F.col("hi.rep").alias("y"), "k").agg(F.collect_list("lo.s").alias("sx"), F.collect_list("hi.s").alias("sy")).drop("k")
    pairs = materialize(pairs.unionAll(own).groupBy("x", "y").agg(F.collect_set(F.struct("sx", "sy")).alias("lists")), "pairs")
    text = lambda c, t: texts.select(F.col("rep").alias(c), F.col("text").alias(t))
    met = pairs.join(text("x", "tx"), "x").join(text("y", "ty"), "y").select("x", "y", "lists", "tx", "ty")
    found = met.mapInArrow(_agreeing(width, percent, n), "x bigint, y bigint, xs array<struct<s: bigint, at: bigint>>, ys array<struct<s: bigint, at: bigint>>, spans array<struct<xa: bigint, xb: bigint, ya: bigint, yb: bigint>>")
    found = materialize(found, "near")
    first = F.least("x", "y").alias("first")
    spans = found.select("x", "y", F.explode("spans").alias("w"))
    spans = spans.select(F.col("x").alias("rep"), F.col("w.xa").alias("a"), F.col("w.xb").alias("b"), first).unionAll(spans.select(F.col("y").alias("rep"), F.col("w.ya").alias("a"), F.col("w.yb").alias("b"), first))
    hits = found.select(F.col("x").alias("rep"), F.col("y").alias("other"), F.explode("xs").alias("w")).unionAll(found.select(F.col("y").alias("rep"), F.col("x").alias("other"), F.explode("ys").alias("w")))
    hits = hits.select("rep", F.col("w.s").alias("s"), F.struct("other", "w.at").alias("o")).join(held_by.select("k", F.col("h.rep").alias("rep"), F.col("h.s").alias("s")).distinct(), ["rep", "s"])
    hits = hits.groupBy("k").agg(F.min("o").alias("p"), F.max("o").alias("q"))
    all_ = materialize(held.where("lead").join(hits, "k").where("p.other <> q.other or p.other <> rep").select("rep", "s", "e", "free", "p", "q"), "similar")
    partner = F.when(F.col("p.other") == F.col("rep"), F.col("q.other")).otherwise(F.col("p.other"))
    members = all_.select("rep", F.col("s").alias("a"), (F.col("e") + width + n - 1).alias("b"), F.least("rep", partner).alias("first"))
    more = all_.where("free").select(F.col("rep").alias("x"), F.col("s").cast("int").alias("cx"), F.explode(F.array("p", "q")).alias("o")).where("x <> o.other")
    more = more.select("x", F.col("o.other").alias("y"), "cx", F.col("o.at").cast("int").alias("cy")).distinct()
    return spans.unionAll(members).unionAll(_near(more, texts, width, percent, n, "near"))


def _near_passages(windows: DataFrame, exact: DataFrame, texts: DataFrame, width: int, percent: int, n: int, rounds: int) -> DataFrame:
    """(rep, a, b, first) of near passages of windows (rep, v, c) outside exact ones."""
    schema = "rep bigint, a bigint, b bigint, first bigint"
    found = windows.sparkSession.createDataFrame([], schema)
    all_ = materialize(_open_lists(_outside(windows, exact)), "open")
    if all_.isEmpty():
        return found
    all_ = materialize(_open_lists(_with_hope(all_, texts, width, percent, n)), "open")
    now = _one_inside(all_).withColumn("met", F.lit(False))
    for k in range(rounds):
        if now.isEmpty():
            break
        # a list's next hub is a class that has been none of its hubs; it meets the others once, so no pair of a list is made twice
        hubs = now.where("not met").groupBy("v").agg(F.min_by(F.struct("rep", "c", "free"), F.struct(F.xxhash64("rep", F.lit(k)), "rep")).alias("hub"))
        joined = materialize(now.join(hubs, "v"), "hubs")
        met = joined.where("not met and rep <> hub.rep and (free or hub.free)")
        near = _near(met.select(F.col("rep").alias("x"), F.col("hub.rep").alias("y"), F.col("c").alias("cx"), F.col("hub.c").alias("cy")), texts, width, percent, n, f"near-{k}")
        found = found.unionAll(near)
        if k + 1 < rounds:
            # a hub has met its whole list: it is open no more
            left = joined.select("v", "rep", "c", (F.col("free") & (F.col("rep") != F.col("hub.rep"))).alias("free"), (F.col("met") | (F.col("rep") == F.col("hub.rep"))).alias("met"))
            was = left.where("met").select("v", "rep").distinct().withColumn("met", F.lit(True))
            still = _one_inside(_open_lists(_outside(left.where("free").select("v", "rep", "c"), near).unionByName(left.where("not free").select("v", "rep", "c", "free"))))
            now = materialize(still.join(was, ["v", "rep"], "left").withColumn("met", F.coalesce("met", F.lit(False))), "open")
    # what lies outside all passages meets all that it has not met, and all places of a class
    left = _outside(all_.where("free").select("v", "rep", "c"), found).unionByName(all_.where("not free").select("v", "rep", "c", "free"))
    left = materialize(_open_lists(left), "open")
    if left.isEmpty():
        return found
    return found.unionAll(_all_near(left, texts, width, percent, n))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = 80, bands: int = BANDS, n: int = SHINGLE, rounds: int = ROUNDS) -> DataFrame:
    """Rows doc_id, start, end, kind, class_id and text_id of all documents that hold repeated passages of min_words words or more."""
    width, frame = min_words - n + 1, min_words - STEP + 1
    text = docs["text"].cast("string")
    keyed = docs.where(docs["doc_id"].isNotNull() & (F.length(text) >= 2 * min_words - 1))
    rows = keyed.select(F.xxhash64(text).alias("rep"), text.alias("text"))
    # classes of several documents, and the first document of each class
    members = materialize(keyed.select(docs["doc_id"].alias("doc"), F.xxhash64(text).alias("rep")).distinct(), "members")
    classes = materialize(members.groupBy("rep").agg(F.min("doc").alias("first_doc"), F.count("*").alias("copies")), "classes")
    copied = classes.where("copies > 1")
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n")
    sized = keyed.select(docs["doc_id"].alias("doc"), F.xxhash64(text).alias("rep"), text.alias("text")).join(broadcast_if_small(copied, copied.count()), "rep").select("doc", "rep", "first_doc", n_words).distinct()
    copies = sized.where(F.col("n") >= min_words).select("doc", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.lit("copy").alias("kind"), F.col("first_doc").alias("class_id"), F.col("rep").alias("text_id"))
    # signatures of several classes, and the texts that have them
    signed = rows.mapInArrow(_signed(width, n, bands), "v bigint, rep bigint")
    repeated = materialize(signed.groupBy("v").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("v"), "signatures")
    live = materialize(signed.join(repeated, "v", "left_semi").groupBy("rep").agg(F.collect_set("v").alias("live")), "live")
    needed = rows.where(_sieve(live)("rep")).dropDuplicates(["rep"]).join(live, "rep")
    opened = needed.select("rep", "live", "text").mapInArrow(_opened(width, n, bands, frame), "rep bigint, text string, v array<bigint>, c array<int>, f array<binary>, a array<int>")
    opened = materialize(opened, "windows")
    texts = opened.select("rep", "text")
    # passages repeated word for word
    frames = opened.select("rep", F.explode(F.arrays_zip("f", "a")).alias("x")).select("rep", "x.f", F.col("x.a").cast("long").alias("a"))
    shared = frames.groupBy("f").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first <> last").select("f", "first")
    exact = materialize(_islands(frames.join(shared, "f").select("rep", "a", (F.col("a") + frame).alias("b"), "first")), "exact")
    # near-duplicate passages elsewhere
    windows = opened.select("rep", F.explode(F.arrays_zip("v", "c")).alias("x")).select("rep", "x.v", "x.c")
    near = _islands(_near_passages(windows, exact, texts, width, percent, n, rounds))
    both = exact.withColumn("kind", F.lit("exact")).unionByName(near.withColumn("kind", F.lit("near")))
    named = both.join(classes.select("rep", F.col("first_doc").alias("doc")), "rep").join(classes.select(F.col("rep").alias("first"), F.col("first_doc").alias("class_id")), "first")
    out = copies.unionAll(named.select("doc", F.col("a").alias("start"), F.col("b").alias("end"), "kind", "class_id", F.col("rep").alias("text_id")))
    return out.withColumnRenamed("doc", "doc_id")
