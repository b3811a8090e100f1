"""Text and vector retrieval: BM25, exact phrase matches and cosine, each as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from .ranking import NUDGE, SPREAD, first_places, scored_top, top


#: Queries and documents of a block at most; a task has one block of each and a sum for every document of it.
BM25_QUERIES, BM25_DOCUMENTS = 1 << 17, 1 << 16
#: Blocks of documents and pairs of blocks that a search has at least (blocks of a thousand documents aside), so that its work spreads.
BM25_BLOCKS, BM25_CELLS = 24, 48


class Bm25:
    """An index of documents(doc, text): tokens, document frequencies and totals.

    Every query meets every document that shares a term, in blocks: a task adds up the weights of one block of documents for one
    block of queries and passes on its own k best only. No pair of a query and a document is ever a row. Terms meet as hashes
    of 64 bits."""

    def __init__(self, docs: DataFrame, doc: str, text: Column, k1: float = 1.5, b: float = 0.75):
        self.tokens = docs.select(F.col(doc).alias("item_id"), X.bm25_tokens(text).alias("tokens")).withColumn("dl", F.size("tokens"))
        once = docs.groupBy(doc).count().where("count > 1").isEmpty()
        # where ids are unique, a text's terms are told apart in its row
        postings = self.tokens.select(F.explode(F.array_distinct("tokens")).alias("term")) if once else self.tokens.select("item_id", "dl", F.explode("tokens").alias("term")).distinct()
        self.df = postings.groupBy("term").agg(F.count("*").alias("df"))
        self.total = self.tokens.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
        self.k1, self.b = k1, b

    def asked(self, queries: DataFrame, keys: list[str], text: Column, n_docs: int) -> DataFrame:
        """keys, terms: a query's terms that documents have, each once, with their idf."""
        q = queries.select(*keys, F.explode(F.array_distinct(X.bm25_tokens(text))).alias("term")).distinct()
        idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        terms = q.select("term").distinct().join(self.df, "term").select("term", idf.alias("idf"))
        return q.join(terms, "term").groupBy(*keys).agg(F.collect_list(F.struct(F.xxhash64("term").alias("term"), "idf")).alias("terms"))

    def top(self, queries: DataFrame, keys: list[str], text: Column, k: int) -> DataFrame:
        sizes = self.total.first()
        q = self.asked(queries, keys, text, sizes["n_docs"])
        d = self.tokens.where("dl > 0").select("item_id", "dl", F.transform("tokens", lambda x: F.xxhash64(x)).alias("tokens"))
        if not sizes["n_docs"]:
            return scored_top(q.select(*keys, F.lit(None).cast(d.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("score")).where("false"), k, keys)
        nd = max(-(-sizes["n_docs"] // BM25_DOCUMENTS), min(BM25_BLOCKS, -(-sizes["n_docs"] // 1024)))
        nq = max(-(-queries.count() // BM25_QUERIES), -(-BM25_CELLS // nd), 1)
        q = q.withColumn("qb", F.pmod(F.xxhash64(*keys), F.lit(nq)).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(nd - 1))))
        d = d.withColumn("db", F.pmod(F.xxhash64("item_id"), F.lit(nd)).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
        names = ", ".join(f"{c} {q.schema[c].dataType.simpleString()}" for c in keys)
        kind = d.schema["item_id"].dataType.simpleString()
        sums = _bm25_block(keys, k, float(sizes["avgdl"] or 1.0), self.k1, self.b)
        return scored_top(q.groupBy("qb", "cell").cogroup(d.groupBy("cell", "db")).applyInArrow(sums, f"{names}, item_id {kind}, score double"), k, keys)


def _bm25_block(keys: list[str], k: int, avgdl: float, k1: float, b: float):
    """The k best documents of a block for each query of a block. Rows of one id are one document; rows of one id and length share counts."""

    def sums(queries, documents):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        names, kinds = [*keys, "item_id", "score"], [*(queries.schema.field(c).type for c in keys), documents.schema.field("item_id").type, pa.float64()]
        q, d = one(queries.column("terms")), one(documents.column("tokens"))
        if not len(q) or not len(d):
            return pa.Table.from_arrays([pa.array([], type=t) for t in kinds], names=names)
        flat = q.flatten()
        asked, idf = flat.field("term").to_numpy(zero_copy_only=False), flat.field("idf").to_numpy(zero_copy_only=False)
        vocabulary, first, term_of = np.unique(asked, return_index=True, return_inverse=True)
        idf = idf[first]
        ends = np.cumsum(q.value_lengths().to_numpy(zero_copy_only=False))
        # documents in order of id
        coded = one(one(documents.column("item_id")).dictionary_encode(null_encoding="encode"))
        order = pc.array_sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
        place = np.empty(len(order), "int64")
        place[order] = np.arange(len(order))
        item = place[coded.indices.to_numpy(zero_copy_only=False)]
        ids = coded.dictionary.take(pa.array(order))
        dl = one(documents.column("dl")).to_numpy(zero_copy_only=False).astype("int64")
        # postings of the terms that are asked for
        tokens = d.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(d)), d.value_lengths().to_numpy(zero_copy_only=False))
        at = np.minimum(np.searchsorted(vocabulary, tokens), len(vocabulary) - 1)
        held = vocabulary[at] == tokens
        at, row = at[held], row[held]
        alike = np.unique(np.stack([item, dl], 1), axis=0, return_inverse=True)
        pair, tf = np.unique(at * len(alike[0]) + alike[1].ravel()[row], return_counts=True)
        of, (item, dl) = pair // len(alike[0]), alike[0][pair % len(alike[0])].T
        w = idf[of] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)))
        starts = np.searchsorted(of, np.arange(len(vocabulary) + 1))
        once = len(alike[0]) == len(ids)
        rows, best, scores, n = [], [], [], len(ids)
        total = np.zeros(n)
        begin = 0
        for i, end in enumerate(ends):
            total[:] = 0
            for t in term_of[begin:end]:
                x = slice(starts[t], starts[t + 1])
                if once:
                    total[item[x]] += w[x]
                else:
                    np.add.at(total, item[x], w[x])
            begin = end
            least = np.partition(total, n - k)[n - k] if k < n else 0.0
            # the k best and all that may tie with the last of them, by rounded score and then id
            near = np.flatnonzero(total >= least - 3e-6) if least > 3e-6 else np.flatnonzero(total)
            score = np.rint((total[near] + NUDGE) * 1e6)
            near_order = np.lexsort((near, -score))[:k]
            rows.append(np.full(len(near_order), i))
            best.append(near[near_order])
            scores.append(score[near_order] / 1e6)
        rows, best = np.concatenate(rows), np.concatenate(best)
        return pa.Table.from_arrays([*(one(queries.column(c)).take(pa.array(rows)) for c in keys), ids.take(pa.array(best)), pa.array(np.concatenate(scores))], names=names)

    return sums


def exact_index(values: DataFrame) -> DataFrame:
    """(field, value, item_id, popularity, pop_rank, n_items) of values(item_id, field, value, popularity) that are fit as keys."""
    fit = values.where(X.key_is_valid(F.col("value"), F.col("field") == 3)).repartition(SPREAD, "item_id").distinct()
    w = Window.partitionBy("field", "value")
    return fit.withColumn("pop_rank", F.row_number().over(w.orderBy(F.desc("popularity"), "item_id"))).withColumn("n_items", F.count("*").over(w))


def query_ngrams(queries: DataFrame, keys: list[str], text: Column, most: int) -> DataFrame:
    """keys, value, n_tokens, n_chars, ngram_rank (from 0): distinct n-grams, longest first, then by place."""
    t = queries.select(*keys, X.words(X.normalize_text(text)).alias("t"))
    every = [t.select(*keys, F.lit(n).alias("n_tokens"), F.posexplode(X.ngrams(F.col("t"), n)).alias("at", "value")) for n in range(1, most + 1)]
    all_ = every[0]
    for e in every[1:]:
        all_ = all_.unionAll(e)
    once = all_.groupBy(*keys, "value", "n_tokens").agg(F.min("at").alias("at"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n_tokens"), "at")
    return once.select(*keys, "value", "n_tokens", F.length(F.replace("value", F.lit(" "), F.lit(""))).alias("n_chars"), (F.row_number().over(order) - 1).alias("ngram_rank"))


def longest_key(index: DataFrame, cap: int = 12) -> DataFrame:
    """One row, most: the words of the longest key, at most cap; queries need no longer n-grams."""
    return index.agg(F.least(F.max(F.size(F.split("value", " "))), F.lit(cap)).alias("most"))


def exact_hits(queries: DataFrame, index: DataFrame, keys: list[str], text: Column, k: int, most: int = 12, factor: int = 8) -> DataFrame:
    """n-grams that are keys, with their items. Per task and field, n-grams are taken in order until their items number
    factor * k; the one that crosses is the last."""
    sizes = index.groupBy("field", "value").agg(F.count("*").alias("n_items"))
    hit = query_ngrams(queries, keys, text, most).join(sizes, "value")
    before = Window.partitionBy(*keys, "field").orderBy("ngram_rank").rowsBetween(Window.unboundedPreceding, -1)
    kept = hit.withColumn("before", F.coalesce(F.sum("n_items").over(before), F.lit(0))).where(F.col("before") < factor * k).drop("n_items", "before")
    return kept.join(index, ["field", "value"]).drop("n_items")


def exact_ranked(hits: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Items by their best match: more words, more characters, the earlier field, the earlier n-gram, popularity; then item_id.

    What is beyond k in a key's list has k items of that list before it, so it is not unfolded."""
    hits = hits.where(F.col("pop_rank") <= k)
    best = F.min(F.struct((-F.col("n_tokens")).alias("a"), (-F.col("n_chars")).alias("b"), F.col("field").alias("c"), F.col("ngram_rank").alias("d"), (-F.col("popularity")).alias("e")))
    return top(hits.groupBy(*keys, "item_id").agg(best.alias("best")), keys, [F.col("best"), F.col("item_id")], k).select(*keys, "item_id", "rank")


def exact_by_field(hits: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Per field: items of the longest n-gram first, each once. What is beyond k in a key's list has k items of that list before it."""
    hits = hits.where(F.col("pop_rank") <= k)
    placed = first_places(hits.withColumn("place", F.struct("ngram_rank", "pop_rank")), [*keys, "field"])
    return top(placed, [*keys, "field"], [F.col("place"), F.col("item_id")], k).select(*keys, "field", "item_id", "rank")


def exact_hybrid(ranked: DataFrame, by_field: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ranked list, then each field's in order; an item stays at its first place."""
    both = ranked.select(*keys, "item_id", F.struct(F.lit(-1).alias("field"), F.col("rank")).alias("place")).unionAll(by_field.select(*keys, "item_id", F.struct("field", "rank").alias("place")))
    return top(first_places(both, keys), keys, [F.col("place"), F.col("item_id")], k).select(*keys, "item_id", "rank")


def cosine_top(queries: DataFrame, items: DataFrame, keys: list[str], k: int, query: str = "q", vector: str = "v") -> DataFrame:
    """Top k items by cosine of vectors; vectors that are not valid take no part.

    Every query meets every item in blocks: items are dealt to tasks, each block of queries goes to all of them once, scores
    of a block are one matrix product, and a task passes on its own k best only."""
    q = queries.select(*keys, V.unit(F.col(query)).alias("q_vector")).where("q_vector is not null")
    v = items.select("item_id", V.unit(F.col(vector)).alias("v")).where("v is not null")
    return scored_top(_block_products(q, v, keys, k), k, keys)


#: Rows of a block of queries and of one of items at most; both are matrices of that many rows in a task. Each block goes to all of the
#: other kind, so large blocks are moved less often; of their product a task holds the rows of STRIP queries at once.
QUERY_BLOCK, ITEM_BLOCK, STRIP = 1 << 16, 1 << 16, 256
#: Pairs of blocks that a search has at least (blocks of a strip aside), so that its work spreads.
COSINE_CELLS = 24


def _block_products(q: DataFrame, v: DataFrame, keys: list[str], k: int) -> DataFrame:
    import numpy as np
    import pandas as pd

    names = ", ".join(f"{c} {q.schema[c].dataType.simpleString()}" for c in keys)
    kind = v.schema["item_id"].dataType.simpleString()

    def block(df: DataFrame, cols: list[str], rows: int, least: int) -> tuple[DataFrame, int]:
        count = df.count()
        n = max(1, -(-count // rows), min(least, -(-count // STRIP)))
        return df.withColumn("block", F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")), n

    v, nv = block(v, ["item_id"], ITEM_BLOCK, 1)
    q, nq = block(q, keys, QUERY_BLOCK, -(-COSINE_CELLS // nv))
    cells = q.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nv - 1)))).withColumnRenamed("block", "qb")
    held = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumnRenamed("block", "vb")

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in [*keys, "item_id", "score"]})
        b = b.sort_values("item_id")
        vectors = np.array(b["v"].tolist()).T
        return pd.concat([strip(a.iloc[i : i + STRIP], b, vectors) for i in range(0, len(a), STRIP)], ignore_index=True)

    def strip(a: pd.DataFrame, b: pd.DataFrame, vectors) -> pd.DataFrame:
        s = np.round(np.array(a["q_vector"].tolist()) @ vectors, 6)
        # the k best and all that tie with the last of them, by score and then item; the rest is not sorted
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if k < s.shape[1] else np.full(len(s), -np.inf)
        some = (s >= least[:, None]).sum(axis=1).max()
        near = np.argpartition(-s, min(some, s.shape[1]) - 1, axis=1)[:, :some]
        near.sort(axis=1)
        order = np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(near, order, 1)
        rows = np.repeat(np.arange(len(a)), best.shape[1])
        out = {c: a[c].to_numpy()[rows] for c in keys}
        return pd.DataFrame(out | {"item_id": b["item_id"].to_numpy()[best.ravel()], "score": np.take_along_axis(s, best, 1).ravel()})

    left, right = cells.groupBy("qb", "other"), held.withColumnRenamed("other", "qb2").groupBy("qb2", "vb")
    return left.cogroup(right).applyInPandas(product, f"{names}, item_id {kind}, score double")
