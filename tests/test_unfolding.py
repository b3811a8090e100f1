"""Lists unfolded where tasks are: the same results as by joins, and nothing unfolded is shuffled."""

from __future__ import annotations

import random

import pytest

from quaver.operators import sources, unfolding


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(5)
    kinds = {1: 3, 2: 2, 3: 4}
    values = [(i, f, f"v {r.randrange(n)}", float(i % 4)) for i in range(300) for f, n in kinds.items()]
    history = [(s, 5, r.randrange(300), 5 - t) for s in range(60) for t in range(1, 5)] + [(0, 5, 7, 2), (0, 5, 7, 3), (1, 5, 999, 1)]
    v = spark.createDataFrame(values, "item_id bigint, field int, value string, popularity double")
    return v, spark.createDataFrame(history, "session_id bigint, turn_number int, item_id bigint, recency int")


def shuffled_after_lists(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Exchange" in plan.split("MapInArrow")[0]


@pytest.mark.parametrize("variant", list(sources.CONTINUITY))
def test_continuity_by_lists_is_continuity_by_joins(spark, tables, monkeypatch, variant):
    v, h = tables
    run = lambda: sources.continuity(h, v, sources.value_index(v), variant, 30)
    df = run()
    assert not shuffled_after_lists(df)
    got = sorted(df.collect())
    monkeypatch.setattr(unfolding, "ROWS", 100)  # a chunk is a task
    assert sorted(run().collect()) == got
    monkeypatch.setattr(unfolding, "MOST", 0)
    assert sorted(run().collect()) == got and got


@pytest.mark.parametrize("field", [1, 3])
def test_history_same_by_lists_is_history_same_by_joins(spark, tables, monkeypatch, field):
    v, h = tables
    run = lambda: sources.history_same(h, v, sources.value_index(v), field, 40)
    df = run()
    assert not shuffled_after_lists(df)
    got = sorted(df.collect())
    monkeypatch.setattr(unfolding, "ROWS", 100)
    assert sorted(run().collect()) == got
    monkeypatch.setattr(unfolding, "MOST", 0)
    assert sorted(run().collect()) == got and got


def test_lists_of_text_ids(spark, monkeypatch):
    v = spark.createDataFrame([(x, 1, "a", 1.0) for x in ("q", "é", "z", "b")] + [("z", 2, "m", 1.0)], "item_id string, field int, value string, popularity double")
    h = spark.createDataFrame([("s", 2, "q", 1), ("s", 2, None, 2)], "session_id string, turn_number int, item_id string, recency int")
    run = lambda: [(r.item_id, r.rank) for r in sorted(sources.continuity(h, v, sources.value_index(v), "artist", 9).collect(), key=lambda r: r.rank)]
    got = run()
    monkeypatch.setattr(unfolding, "MOST", 0)
    assert run() == got and len(got) == 3


def test_without_items_there_are_no_rows(spark, tables):
    v, h = tables
    assert sources.continuity(h, v.where("false"), sources.value_index(v.where("false")), "album", 9).count() == 0
    assert sources.history_same(h.where("false"), v, sources.value_index(v), 1, 9).count() == 0


def test_transition_by_lists_is_transition_by_joins(spark, tables, monkeypatch):
    v, h = tables
    train = h.select((h["session_id"] + 1000).alias("session_id"), "turn_number", "item_id", "recency")
    labels = train.select("session_id", "turn_number", ((train["session_id"] * 7) % 300).alias("label")).distinct()
    run = lambda: sources.transition(h, v, sources.transition_index(train, labels, v, sources.value_index(v), "artist_album"), "artist_album", 30)
    df = run()
    assert not shuffled_after_lists(df)
    got = sorted(df.collect())
    monkeypatch.setattr(unfolding, "MOST", 0)
    assert sorted(run().collect()) == got and got
