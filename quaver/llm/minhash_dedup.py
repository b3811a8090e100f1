"""Near-duplicate documents by bottom-k sketches from one hash function.

1. Every document becomes its set of 64-bit shingle hashes; the hash is the one function, so its k smallest are the sketch.
   Equal sets (a 128-bit digest of the whole set) are one class from here on, however many copies there are.
2. Inverted lists of retained values: a value held by one class only shows that it has no partner there. Of a document with
   a partner of similarity s, k retained values hold about s k shared ones, so a class of more than k shingles with fewer than
   least(k) shared retained values has no partner and goes (for a link at the threshold the chance of that is below 1e-5, from
   the binomial). Of a class of at most k shingles all are retained, and its partner's sketch lacks at most the partner's
   shingles beyond k: a certain bound.
3. The few classes left are read in full. Exact numbers of shingles that no other class has bound every similarity from above,
   and a prefix of the rarest shared ones is all that is listed (two sets with the similarity share a value of both prefixes).
4. Each list has a hub, the class with the smallest part of shingles of its own. Members meet the hub, not one another: one
   pair a member. Exact intersections on whole sets confirm links, and components are found.
5. What can still be missed are links between members of one list that are in different components. With D = the symmetric
   difference to the hub, known exactly, |x ^ y| >= |Dx| + |Dy| - 2 min(|Dx| - ux, |Dy| - uy), u the shingles of one class
   only. Members for which that rules out everyone in the list go without being paired; the rest outside the hub's component
   are paired with list members in other components if that bound and the one from parity maps (bits that differ between
   two sets' parities never outnumber their symmetric difference) allow it, filtered by the estimate from the union sketch,
   and confirmed on whole sets. So groups of near copies cost about their size, and no link is lost to a cap.

Nulls and texts without words have no shingles and are linked with nothing; fewer words than a shingle are one shingle. Rows
without doc_id take part in nothing (component null, kept). Rows that repeat a doc_id get the same answer.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SHINGLE, WHITE, Words, broadcast_if_small, chunks, lists, materialize, shingles, string_buffers
from .graph import connected_components

K = 64
#: Bits of a whole set's parity map.
BITS = 1024
#: Standard deviations of a binomial that a sketch's count may fall below its mean.
SLACK = 5.0


def least_shared(k: int, percent: int) -> int:
    """The fewest of k retained values that a document of more shingles shares if it has a partner."""
    s = percent / 100
    return max(1, math.floor(s * k - SLACK * math.sqrt(k * s * (1 - s))))


def least_shared_whole(n: int, k: int, percent: int) -> int:
    """The fewest of all n <= k shingles that a document shares with sketches if it has a partner. A partner of m shingles shares
    at least percent (n + m) / (100 + percent) and retains all but m - k of its own."""
    sizes = range(-(-n * percent // 100), 100 * n // percent + 1)
    return max(1, min((-(-percent * (n + m) // (100 + percent)) - max(0, m - k) for m in sizes), default=1))


def _sets(n: int, k: int | None):
    """Per document: size, digest and sketch of its set of shingles (k None: the whole set), sorted as unsigned numbers."""
    names = ["key", "n", "digest", "values"] + ["parity"] * (k is None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = string_buffers(batch.column(1))
            for i, j, raw, at in chunks(buf, offsets):
                words = Words(raw, at, WHITE, lower=True)
                size, digest, values, parity = [], [], [], []
                for d in range(j - i):
                    own = np.unique(shingles(words.hash[words.first[d] : words.first[d + 1]], n))
                    size.append(len(own))
                    digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    values.append((own if k is None else own[:k]).view(np.int64))
                    if k is None:
                        odd = np.bincount((own & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
                        parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                columns = [batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), lists(values, pa.int64())] + ([lists(parity, pa.int64())] if k is None else [])
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


_SET = "n bigint, digest binary, values array<bigint>"
_WHOLE = f"{_SET}, parity array<bigint>"


def _shared(postings: DataFrame) -> DataFrame:
    """postings(rep, value, ...) of values that several reps hold, with df, their number."""
    df = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    return postings.join(df, "value")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, k: int, estimate: bool) -> DataFrame:
    """pairs(a, b) with na, nb and common = the exact size of the intersection; estimate: only where the union sketch allows a link."""
    first, second = (sets.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("values").alias(f"v{c}")) for c in "ab")
    both = pairs.join(first, "a").join(second, "b")
    if estimate:
        # hashes are sorted as unsigned numbers; flipping the top bit lets array_sort see that order
        flip = lambda v: F.transform(F.slice(v, 1, k), lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))
        both = both.withColumn("sa", flip(F.col("va"))).withColumn("sb", flip(F.col("vb")))
        both = both.withColumn("u", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k))
        seen = F.size(F.array_intersect("u", F.array_intersect("sa", "sb")))
        s = percent / 100
        floor = F.floor(s * F.size("u") - SLACK * F.sqrt(F.size("u") * F.lit(s * (1 - s))))
        both = both.where(seen >= floor)
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("va", "vb")).cast("long").alias("common"))


def _linked(percent: int) -> Column:
    return F.expr(f"100 * common >= {percent} * (na + nb - common)")


def _listed(sets: DataFrame, percent: int) -> DataFrame:
    """(value, rep, n, own): the prefix of each class's rarest shared shingles; own counts those that no other class has."""
    postings = sets.select("rep", "n", F.explode("values").alias("value"))
    shared = materialize(_shared(postings), "shared")
    mine = shared.groupBy("rep", "n").agg(F.count("*").alias("s")).withColumn("own", F.col("n") - F.col("s"))
    need = F.ceil(F.col("n") * percent / 100)
    mine = mine.where(F.col("s") >= need).withColumn("take", F.col("n") - need + 1 - F.col("own")).select("rep", "own", "take")
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("df", "value"))
    return shared.join(mine, "rep").withColumn("nth", nth).where("nth <= take").select("value", "rep", "n", "own")


def _candidates(docs: DataFrame, percent: int, k: int, n: int) -> tuple[DataFrame, DataFrame]:
    """(sketched, sets): key, n, digest of every document, and rep, n, values (whole sets) of the classes that may have a partner."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].alias("key"), text.alias("text"))
    key = f"key {docs.schema['doc_id'].dataType.simpleString()}"
    sketched = materialize(rows.mapInArrow(_sets(n, k), f"{key}, {_SET}"), "sketches")
    classes = sketched.where("n > 0 and key is not null").groupBy("digest").agg(F.min("key").alias("rep"), F.min("n").alias("n"), F.min("values").alias("values"))
    classes = materialize(classes, "classes")
    shared = _shared(classes.select("rep", "n", F.explode("values").alias("value"))).groupBy("rep", "n").agg(F.count("*").alias("s"))
    sizes = [least_shared_whole(i, k, percent) for i in range(k + 1)]
    least = F.when(F.col("n") <= k, F.element_at(F.array(*map(F.lit, sizes)), F.least(F.col("n"), F.lit(k)).cast("int") + 1)).otherwise(least_shared(k, percent))
    alive = materialize(shared.where(F.col("s") >= least).select("rep"), "alive")
    chosen = broadcast_if_small(alive, alive.count())
    # a repeated doc_id may stand for several texts; the class's digest tells which is meant
    wanted = rows.join(chosen, rows["key"] == chosen["rep"], "left_semi").mapInArrow(_sets(n, None), f"{key}, {_WHOLE}")
    reps = classes.join(chosen, "rep", "left_semi").select(F.col("rep"), "digest")
    sets = wanted.join(reps, (wanted["key"] == reps["rep"]) & (wanted["digest"] == reps["digest"]), "left_semi")
    return sketched, materialize(sets.groupBy(F.col("key").alias("rep")).agg(F.min("n").alias("n"), F.min("values").alias("values"), F.min("parity").alias("parity")), "sets")


def _links(sets: DataFrame, percent: int, k: int) -> DataFrame:
    """(rep, component) of all classes that are linked with another."""
    listed = materialize(_listed(sets, percent), "lists")
    hubs = listed.groupBy("value").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("part"), "rep")).alias("h"), F.count("*").alias("size")).where("size > 1")
    members = materialize(listed.join(hubs.select("value", F.col("h.rep").alias("hub")), "value"), "members")
    stars = members.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    met = materialize(_verified(stars, sets, percent, k, estimate=False), "met")
    links = met.where(_linked(percent)).select("a", "b")
    label = connected_components(links)
    # what the hubs have not linked: members of one list in different components
    d = met.select(F.col("a").alias("rep"), F.col("b").alias("hub"), (F.col("na") + F.col("nb") - 2 * F.col("common")).alias("d"))
    placed = members.join(d, ["rep", "hub"], "left").na.fill(0, ["d"]).join(label.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("value", "rep", "hub", "n", "own", "d", F.coalesce("component", "rep").alias("c"))
    home = label.select(F.col("node").alias("hub"), F.col("component").alias("home"))
    placed = placed.join(home, "hub", "left").withColumn("home", F.coalesce("home", "hub"))
    mixed = placed.groupBy("value").agg(F.max(F.col("c") != F.col("home")).alias("mixed")).where("mixed").select("value")
    placed = materialize(placed.join(mixed, "value", "left_semi").join(sets.select("rep", "parity"), "rep"), "placed")
    room = (100 - percent) / (100 + percent)  # a link leaves at most room * (nx + ny) in the symmetric difference
    span = placed.groupBy("value").agg(F.min("d").alias("d_least"), F.max("n").alias("n_most"))
    minor = placed.where("c <> home").join(span, "value")
    minor = minor.where(F.col("d") + F.col("d_least") - 2 * (F.col("d") - F.col("own")) <= room * (F.col("n") + F.col("n_most")))
    x, y = (t.select("value", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "own", "d", "c", "parity"))) for t, s in ((minor, "x"), (placed, "y")))
    bound = F.expr(f"d_x + d_y - 2 * least(d_x - own_x, d_y - own_y) <= {room!r} * (n_x + n_y) and own_x + own_y <= {room!r} * (n_x + n_y)")
    near = F.expr(f"100 * n_x >= {percent} * n_y and 100 * n_y >= {percent} * n_x")
    # each element of the symmetric difference changes one bit of parity, so the bits that differ are never more than it
    differ = F.aggregate(F.zip_with("parity_x", "parity_y", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    pairs = x.join(y, (x["value"] == y["value"]) & (F.col("c_x") != F.col("c_y")) & near & bound & (differ <= room * (F.col("n_x") + F.col("n_y"))))
    pairs = pairs.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct()
    late = materialize(_verified(pairs, sets, percent, k, estimate=True).where(_linked(percent)).select("a", "b"), "late")
    if late.isEmpty():
        return label
    return connected_components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(late))


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = K, n: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links of that similarity in percent), kept."""
    sketched, sets = _candidates(docs, percent, k, n)
    label = _links(sets, percent, k)
    classes = sketched.where("n > 0 and key is not null").groupBy("digest").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    classes = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.where("copies > 1 or component is not null").select(F.col("digest").alias("d"), F.coalesce("component", "rep").alias("c"))
    rows = sketched.select("key", "n", "digest").join(classes, (F.col("digest") == F.col("d")) & (F.col("n") > 0) & F.col("key").isNotNull(), "left")
    component = F.coalesce("c", "key")
    return rows.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, k: int = K, n: int = SHINGLE) -> DataFrame:
    """docs, all columns, without all but the first (by doc_id) of each group of near duplicates; of rows that repeat a doc_id the one whose
    columns have the least hash stays."""
    r = materialize(near_duplicates(docs, percent, k, n), "near")
    total = r.count()
    gone = materialize(r.where("not kept").select("doc_id").distinct(), "gone")
    left = docs.join(broadcast_if_small(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
    named = r.where("doc_id is not null")
    repeated = named.groupBy("doc_id").count().where("count > 1")
    if total and not repeated.isEmpty():
        ids = repeated.select("doc_id")
        several = left.join(ids, "doc_id", "left_semi")
        one = several.groupBy("doc_id").agg(F.min_by(F.struct(*(several[c] for c in docs.columns)), F.xxhash64(F.to_json(F.struct(*(several[c] for c in docs.columns))))).alias("one"))
        left = left.join(ids, "doc_id", "left_anti").select(*docs.columns).unionAll(one.select("one.*"))
    return left
