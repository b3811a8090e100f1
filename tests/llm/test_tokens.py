from __future__ import annotations

import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quaver.llm import packing, token_counts
from quaver.llm.common import scratch_path
from quaver.llm.tokens import TextIds, default_tokenizer

from .fixtures import ODD, documents, prose

HF = Tokenizer.from_file(default_tokenizer())
CODER = TextIds(default_tokenizer())
PLAIN = TextIds(default_tokenizer(), plain=True)
ALPHABET = st.sampled_from([*"abAB' \n\t.,!0019éß東", " ", " ", "'s", "<|endoftext|>", "  ", "\x1c", "the ", "\r\n"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), max_size=4))
def test_cached_ids_are_the_tokenizers(texts):
    want = [HF.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in CODER.ids(texts)] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(ALPHABET, max_size=25).map("".join))
def test_plain_ids_have_no_special_token(text):
    assert 50256 not in np.frombuffer(PLAIN.ids([text])[0], "<u2").tolist()


def check_pack(rows, docs, sequence):
    ids = {d: HF.encode(t or "", add_special_tokens=False).ids + [1] for d, t in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
    assert pieces.keys() == ids.keys()
    for d, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[d])
    fill = []
    for s in sorted(sequences):
        at = 0
        for p in sorted(sequences[s], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        fill.append(at)
    assert all(x == sequence for x in fill[:-1]) and 0 < fill[-1] <= sequence and sorted(sequences) == list(range(len(fill)))


def test_pack_is_a_partition_of_all_ids(spark):
    texts = ODD + [prose(n, n) for n in range(1, 300, 7)]
    sources = [None if i % 11 == 0 else f"s{i % 3}" for i in range(len(texts))]
    docs = documents(spark, texts, sources=sources).repartition(3)
    rows = packing.pack(docs, sequence=64, quantum=16).collect()
    check_pack(rows, list(enumerate(texts)), 64)
    few = packing.pack(docs, sequence=64, quantum=16, max_queues=2).collect()
    check_pack(few, list(enumerate(texts)), 64)


def test_pack_gives_the_same_twice(spark):
    docs = documents(spark, [prose(50, i) for i in range(30)], sources=[f"s{i % 4}" for i in range(30)])
    assert sorted(packing.pack(docs, sequence=512).collect()) == sorted(packing.pack(docs, sequence=512).collect())


def test_every_window_holds_the_target_mixture(spark):
    docs = documents(spark, [prose(200, i) for i in range(60)], sources=["big" if i % 3 else "small" for i in range(60)])
    rows = packing.pack(docs, sequence=512, quantum=64, weights={"big": 0.5, "small": 0.5}).collect()
    held = defaultdict(lambda: defaultdict(int))
    for r in rows:
        held[r.sequence_id][r.queue] += r.length
    total = sum(r.length for r in rows if r.queue == "s:small")
    for s in range(2 * total // 512 - 1):
        assert abs(held[s]["s:small"] - 256) <= 2 * 64


def test_schedule_is_deficit_round_robin():
    """The closed form against credits that are counted quantum by quantum."""
    totals = {"a": 1000, "b": 333, "c": 77, "d": 1}
    s = packing.Schedule(totals, quantum=10)
    left, served, order = dict(totals), {k: 0 for k in totals}, []
    while any(left.values()):
        # the queue whose next quantum is due first; ties in queue order
        k = min((k for k in s.names if left[k]), key=lambda k: ((served[k] + 1) / int(s.weight[s.index[k]]), k))
        order.append((k, served[k], totals[k] - left[k]))
        served[k] += 1
        left[k] -= min(10, left[k])
    at = 0
    for k, c, start in order:
        assert s.place(np.array([s.index[k]]), np.array([c]))[0] == at
        at += min(10, totals[k] - start)


def test_schedule_of_many_queues_of_equal_weights():
    rng = np.random.default_rng(4)
    totals = {f"q{i}": int(x) for i, x in enumerate(rng.integers(1, 60, 80))}
    for weights in (None, {k: i % 3 + 1.0 for i, k in enumerate(totals)}):
        s = packing.Schedule(totals, weights, quantum=10)
        due = sorted((Fraction(c + 1, int(s.weight[i])), i, c) for i, k in enumerate(s.names) for c in range(-(-totals[k] // 10)))
        sizes = [min(10, totals[s.names[i]] - 10 * c) for _, i, c in due]
        got = s.place(np.array([i for _, i, _ in due]), np.array([c for _, _, c in due]))
        assert got.tolist() == [sum(sizes[:j]) for j in range(len(sizes))]


def test_weights_hold_for_more_sources_than_256(spark):
    texts = [prose(100, i) for i in range(40)] + [prose(2, i) for i in range(300)]
    sources = ["big" if i % 2 else "small" for i in range(40)] + [f"x{i}" for i in range(300)]
    docs = documents(spark, texts, sources=sources)
    rows = packing.pack(docs, sequence=512, quantum=64, weights={"big": 0.75, "small": 0.25}).collect()
    check_pack(rows, list(enumerate(texts)), 512)
    assert {r.queue for r in rows} == {f"s:{x}" for x in sources}
    held = defaultdict(int)
    for r in rows:
        held[r.sequence_id, r.queue] += r.length
    for k in range(2):
        assert abs(held[k, "s:big"] - 384) <= 128 and abs(held[k, "s:small"] - 128) <= 128


def test_pack_of_nothing(spark):
    assert packing.pack(documents(spark, [])).count() == 0


def test_token_counts_by_scan(spark):
    texts = ODD + ["", ""] + [prose(n, n) for n in range(1, 200, 9)]
    docs = documents(spark, texts).coalesce(1)
    want = [len(PLAIN.ids([t or ""])[0]) // 2 for t in texts]
    for block in (7, 64, 1 << 20):
        rows = sorted(token_counts.token_counts(docs, block=block).collect())
        assert [r.n_tokens for r in rows] == want and [r.document for r in rows] == list(range(len(want)))
        assert all(r.terminated for r in rows)
    many = token_counts.token_counts(documents(spark, texts).repartition(3), block=50).collect()
    assert sorted(r.n_tokens for r in many) == sorted(want)


def test_scan_keeps_what_is_not_terminated(spark, tmp_path):
    ids = np.array([5, 6, 50256, 50256, 7, 8, 9], "<u2")
    (tmp_path / "x.bin").write_bytes(ids.tobytes())
    files = spark.createDataFrame([(0, f"file://{tmp_path}/x.bin", 7), (1, f"file://{tmp_path}/none.bin", 0)], "shard bigint, path string, n_ids bigint")
    for block in (1, 2, 3, 100):
        rows = sorted(token_counts.scan_token_files(files, block).collect())
        assert [(r.document, r.start, r.n_tokens, r.terminated) for r in rows] == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 3, False)]


def test_token_counts_of_nothing(spark):
    assert token_counts.token_counts(documents(spark, [])).count() == 0
    assert scratch_path(spark, "x")
