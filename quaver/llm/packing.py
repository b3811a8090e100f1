"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue, the concatenation of its documents' ids. A queue earns credit in proportion to its target for every
id that is packed, and is served a quantum of ids when its credit covers one; the credit less what was served is its deficit,
which is carried over windows (sequences) and partitions. At any time each queue with ids left is within one quantum of its
target, so every window has the target mixture as closely as its quanta allow. Queues that run dry leave their turns to the
others, so every id is packed.

This schedule has a closed form, which is what makes it parallel. Quantum c of queue s is due at (c + 1) / w_s; quanta are
served by due time, ties in queue order (larger queues first). The ids before quantum (s, c) are the sum over queues t of min(T_t, q * n_t), where n_t
= floor((c + 1) w_t / w_s), or one less on a tie if t comes after s. So a document's place needs only the totals T (one number
a queue) and its offset in its queue (a prefix sum of partition totals), and no task ever sees more than its own documents.
Queues of equal weight are summed together, so many small sources cost little more than their distinct weights (targets are
held in parts of 2^SHARE_BITS).

The output leaves no gap: only the last sequence can be short, so padding is less than one sequence for the whole corpus.
Every source is a queue, however many there are (max_queues is accepted and has no effect). Null or empty texts are one id,
the end mark. A null source is a queue of its own. Repeated rows are packed like any others. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, slices
from .tokens import default_tokenizer, text_ids

SEQUENCE, QUANTUM, END, MAX_QUEUES, SHARE_BITS = 2048, 256, 1, 256, 20


def _tokenise(path: str, end: int):
    out = pa.schema([("doc", pa.string()), ("queue", pa.string()), ("part", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    mark = np.array([end], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, used = TaskContext.get().partitionId(), {}
        coder = text_ids(path)
        for batch in batches:
            for rows in slices(batch, 2):
                queues = rows.column(1).to_pylist()
                ids = [x + mark for x in coder.ids(rows.column(2).to_pylist())]
                n, at = [len(x) // 2 for x in ids], []
                for q, k in zip(queues, n, strict=True):
                    at.append(used.get(q, 0))
                    used[q] = at[-1] + k
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], schema=out)

    return run


def tokenised(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """A table (doc, queue, part, at, n, ids): each text's ids, and where they start among the partition's ids of the queue."""
    source = docs["source"].cast("string")
    queue = F.coalesce(F.concat(F.lit("s:"), source), F.lit("-"))
    rows = docs.select(docs["doc_id"].cast("string").alias("doc"), queue.alias("queue"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    made = rows.mapInArrow(_tokenise(path or default_tokenizer(), end), "doc string, queue string, part int, at bigint, n bigint, ids binary")
    return materialize(made, "tokens")


class Schedule:
    """Places of ids: totals by queue name, and target weights (by default each queue's share of all ids)."""

    def __init__(self, totals: dict[str, int], weights: dict[str, float] | None = None, quantum: int = QUANTUM):
        self.names = sorted(totals, key=lambda n: (-totals[n], n))
        self.index = {n: i for i, n in enumerate(self.names)}
        self.total = np.array([totals[n] for n in self.names], np.int64)
        w = np.array([(weights or totals).get(n, 0) for n in self.names], float)
        self.weight = np.maximum(1, np.round(w / max(w.sum(), 1e-300) * (1 << SHARE_BITS))).astype(np.int64)
        self.quantum = quantum
        # queues of one weight, in order, which is from the largest down, and the sums of their totals
        order = np.argsort(self.weight, kind="stable")
        self.groups = np.split(order, np.flatnonzero(np.diff(self.weight[order])) + 1) if len(order) else []
        self.sums = [np.concatenate([[0], np.cumsum(self.total[g])]) for g in self.groups]

    def place(self, s: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Ids before quantum c of queue s, for arrays of both."""
        before = np.zeros(len(s), np.int64)
        for g, sums in zip(self.groups, self.sums, strict=True):
            due = (c + 1) * self.weight[g[0]]
            n = -(-due // self.weight[s]) - 1  # quanta of each queue that are due earlier
            before += self._served(g, sums, n, np.full(len(s), len(g)))
            # on a tie, queues in front of s have one more
            front = np.where(due % self.weight[s] == 0, np.searchsorted(g, s), 0)
            tied = np.flatnonzero(front)
            before[tied] += self._served(g, sums, n[tied] + 1, front[tied]) - self._served(g, sums, n[tied], front[tied])
        return before

    def _served(self, g: np.ndarray, sums: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Ids in the first n quanta of each of the first k queues of a group."""
        full = np.minimum(k, np.searchsorted(-self.total[g], -n * self.quantum, side="right"))
        return full * n * self.quantum + sums[k] - sums[full]

    def pieces(self, s: np.ndarray, start: np.ndarray, n: np.ndarray, sequence: int) -> tuple[np.ndarray, ...]:
        """(row, start in document, length, place) of the pieces of documents that lie at start in queue s with n ids."""
        q = self.quantum
        first, last = start // q, (start + n - 1) // q
        count = last - first + 1
        row = np.repeat(np.arange(len(s)), count)
        c = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
        lo, hi = np.maximum(start[row], c * q), np.minimum((start + n)[row], (c + 1) * q)
        at = self.place(s[row], c) + lo - c * q
        # quanta that follow one another directly, in one document, are one piece
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + (hi - lo)[:-1])
        head = np.flatnonzero(new)
        size = np.add.reduceat(hi - lo, head) if len(head) else np.zeros(0, np.int64)
        row, begin, at = row[head], (lo - start[row])[head], at[head]
        # cut at the ends of sequences
        count = (at + size - 1) // sequence - at // sequence + 1
        k = np.repeat(np.arange(len(row)), count)
        nth = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
        edge = (at // sequence)[k] * sequence + nth * sequence
        lo, hi = np.maximum(at[k], edge), np.minimum((at + size)[k], edge + sequence)
        return row[k], begin[k] + lo - at[k], hi - lo, lo


def _pack(schedule: Schedule, sequence: int, with_ids: bool):
    fields = [("doc", pa.string()), ("queue", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    out = pa.schema(fields + ([("ids", pa.binary())] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            start = batch.column("at").to_numpy(zero_copy_only=False) + batch.column("base").to_numpy(zero_copy_only=False)
            queue = batch.column("queue")
            s = np.array([schedule.index[x] for x in queue.to_pylist()], np.int64)
            row, begin, length, place = schedule.pieces(s, start, n, sequence)
            ids, crc, raw = batch.column("ids"), [], []
            held, words = -1, None
            for r, a, b in zip(row.tolist(), begin.tolist(), (begin + length).tolist(), strict=True):
                if r != held:
                    held, words = r, np.frombuffer(ids[r].as_buffer(), "<u2").astype("<u4")
                piece = words[a:b].tobytes()
                crc.append(zlib.crc32(piece))
                if with_ids:
                    raw.append(piece)
            take = pa.array(row, pa.int64())
            columns = [batch.column("doc").take(take), queue.take(take), pa.array(begin), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(place // sequence), pa.array(place % sequence)]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(raw, pa.binary())] if with_ids else []), schema=out)

    return run


def pack(docs: DataFrame, path: str | None = None, weights: dict[str | None, float] | None = None, sequence: int = SEQUENCE, quantum: int = QUANTUM, end: int = END, with_ids: bool = False, max_queues: int = MAX_QUEUES) -> DataFrame:
    """One row a piece: doc_id, source's queue, start and length in its document, ids_crc32, doc_tokens, sequence_id, offset in
    the sequence, and with_ids its ids (little-endian unsigned 32-bit). weights: target shares by source; by default the corpus's own."""
    if quantum > sequence:
        raise ValueError("a quantum is at most a sequence")
    rows = tokenised(docs, path, end)
    parts = materialize(rows.groupBy("part", "queue").agg(F.sum("n").alias("ids")), "token-parts")
    totals = {r.queue: r.total for r in parts.groupBy("queue").agg(F.sum("ids").alias("total")).collect()}  # one row a source
    named = {("-" if k is None else f"s:{k}"): v for k, v in weights.items()} if weights else None
    schedule = Schedule(totals, named, quantum)
    from pyspark.sql import Window

    w = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", "queue", F.coalesce(F.sum("ids").over(w), F.lit(0)).alias("base"))
    placed = rows.join(broadcast_if_small(bases, parts.count()), ["part", "queue"]).select("doc", "queue", "at", "n", "ids", "base")
    schema = "doc string, queue string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids
    made = placed.mapInArrow(_pack(schedule, sequence, with_ids), schema)
    return made.select(F.col("doc").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *(c for c in made.columns if c != "doc"))
