"""Queries against their SQL on the smallest tables, and hand-made cases for what order, ties and nulls decide."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quaver.functions import text as X
from quaver.operators import audit, features, fusion, generation, metrics, ranking, sources
from quaver.operators import tasks as T
from quaver.plans import registry
from quaver.sources import config, files

TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations pages".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


#: One or two of each module; the driver compares all.
SAMPLE = ["norm_text", "weighted_ngrams", "query_views", "tag_clean", "exact_ranked", "bm25_docs_top20", "continuity_album_artist_tag", "entity_recent2", "transition_recent1", "cross_session", "by_user_ladder", "rrf_union", "quota_union", "protect_prefix", "rank_only_v2", "blend", "hit_recall", "chat_batch", "turn_frame", "strata_sample", "label_memory_history_music", "cross_session_pools", "history_ids", "ltr_misc", "force_positive", "stratified_interval", "standardized_interval", "bootstrap_ci", "ledger_artifacts", "kinds_by_extension", "submission_rules", "task_shard", "correlations", "popularity_stream"]


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_its_sql(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=str)
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(map(plain, r)) for r in rel.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall()), key=str)
    assert got == want


def test_every_query_has_sql_or_says_so():
    from quaver.plans import audits, studies

    assert set(registry.queries()) - set(registry.oracle_sql()) == {*audits.ROWS_ONLY, *studies.ROWS_ONLY}


def lists(spark, **by):
    return fusion.lists({n: spark.createDataFrame([(1, 1, x, i) for i, x in enumerate(xs, 1)], "session_id int, turn_number int, item_id string, rank int") for n, xs in by.items()})


def test_fusion_of_two_lists(spark):
    rows = fusion.rrf(lists(spark, a=["x", "y"], b=["y", "z"]), None).collect()
    got = {r.item_id: (r.rank, r.score) for r in rows}
    assert got == {"y": (1, round(1 / 61 + 1 / 62, 12)), "x": (2, round(1 / 61, 12)), "z": (3, round(1 / 62, 12))}


def test_ties_do_not_depend_on_row_order(spark):
    df = lists(spark, a=list("abcdef"), b=list("fedcba"))
    a = fusion.rrf(df, None).collect()
    assert a == fusion.rrf(df.orderBy("item_id"), None).collect() == fusion.rrf(df.repartition(3), None).collect()


def test_pads_come_last_and_cold_tasks_are_filled(spark):
    tasks = spark.createDataFrame([(1, 1), (2, 1)], "session_id int, turn_number int")
    ranked = spark.createDataFrame([(1, 1, 9, 1), (1, 1, 3, 2)], "session_id int, turn_number int, item_id int, rank int")
    pop = spark.createDataFrame([(i, i) for i in range(1, 9)], "item_id int, pop_rank int")
    rows = ranking.padded(ranked, tasks, pop, 4).collect()
    by = {s: [r.item_id for r in sorted(rows, key=lambda r: r.rank) if r.session_id == s] for s in (1, 2)}
    assert by == {1: [9, 3, 1, 2], 2: [1, 2, 3, 4]}


def test_continuity_leaves_out_what_was_played(spark):
    v = spark.createDataFrame([(i, 2, "alb", float(i)) for i in (1, 2, 3)], "item_id int, field int, value string, popularity double")
    h = spark.createDataFrame([(1, 2, 3, 1)], "session_id int, turn_number int, item_id int, recency int")
    rows = sources.continuity(h, v, sources.value_index(v), "album", 10).collect()
    assert [(r.item_id, r.rank, r.score) for r in rows] == [(2, 1, round(1 / math.log2(4), 6)), (1, 2, round(1 / math.log2(5), 6))]


def test_cross_session_counts_sessions_of_known_users(spark):
    p = spark.createDataFrame([("u", 1, 7), ("u", 2, 7), ("u", 2, 7), ("u", 2, 8), ("u", 3, 8), (" ", 4, 9), (" ", 5, 9), (None, 6, 9)], "user_id string, session_id int, item_id int")
    t = spark.createDataFrame([(1, 1, "u"), (4, 1, " "), (6, 1, None)], "session_id int, turn_number int, user_id string")
    rows = sources.cross_session(t, p).collect()
    assert [(r.session_id, r.item_id, r.score) for r in sorted(rows, key=lambda r: r.rank)] == [(1, 8, 2.0), (1, 7, 1.0)]


def test_gain_by_rank(spark):
    labels = spark.createDataFrame([(i, 1, "x") for i in range(4)], "session_id int, turn_number int, label string")
    p = spark.createDataFrame([(0, 1, "x", 1), (1, 1, "x", 20), (2, 1, "x", 21)], "session_id int, turn_number int, item_id string, rank int")
    assert metrics.ndcg_single(p, labels).first().ndcg == round((1 + 1 / math.log2(21)) / 4, 6)
    assert metrics.hit_recall(p, labels, [20, 100], 50).orderBy("k").collect()[1].hits is None


def test_zscores_of_constant_and_single_groups(spark):
    df = spark.createDataFrame([(1, 1, "a", 3.0), (2, 1, "a", 5.0), (2, 1, "b", 5.0), (3, 1, "a", 1.0), (3, 1, "b", 3.0)], "session_id int, turn_number int, item_id string, s double")
    rows = {(r.session_id, r.item_id): r.s for r in features.zscores(df, ["s"]).collect()}
    assert rows == {(1, "a"): 0.0, (2, "a"): 0.0, (2, "b"): 0.0, (3, "a"): -1.0, (3, "b"): 1.0}


def test_composite_arithmetic(spark):
    from pyspark.sql import functions as F

    assert round(spark.range(1).select(metrics.composite(F.lit(0.4355), F.lit(0.028), F.lit(0.5925), F.lit(4.05)).alias("c")).first().c, 5) == 0.50855


def test_detectors_differ_on_novelty(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a different artist",), ("something new",), ("more of the same",)], "t string")
    rows = df.select(*(F.col("t").rlike(p) for p in X.DETECTORS.values())).collect()
    assert [tuple(r) for r in rows] == [(True, True, True), (True, False, False), (False, False, False)]


def test_early_stop_takes_the_list_that_crosses(spark):
    from pyspark.sql import functions as F

    from quaver.operators import retrieval

    v = spark.createDataFrame([(i, 1, "long name", 1.0) for i in range(9)] + [(100 + i, 1, "name", 1.0) for i in range(3)] + [(200, 1, "long", 1.0)], "item_id int, field int, value string, popularity double")
    q = spark.createDataFrame([("q", "the long name")], "q string, text string")
    hits = retrieval.exact_hits(q, retrieval.exact_index(v), ["q"], F.col("text"), 1)
    assert {r.item_id for r in hits.collect()} == set(range(9))
    assert [r.item_id for r in retrieval.exact_ranked(hits, ["q"], 1).collect()] == [0]


def test_tasks_survive_without_history(spark):
    m = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "music", "x1"), (1, 2, "user", "more"), (2, 0, "user", None)], "session_id int, seq int, role string, content string")
    rows = {(r.session_id, r.seq): r for r in T.query_views(m, 1).collect()}
    assert set(rows) == {(1, 0), (1, 2)} and rows[1, 0].full == "user: hi"
    assert rows[1, 2].recent == "assistant: x1\nuser: more" and rows[1, 2].dialogue == "user: hi\nuser: more"


def test_logistic_has_the_closed_form(spark):
    rows = [(1, 0, g, int(g < 3)) for g in range(10)] + [(1, 1, g, int(g < 6)) for g in range(10)]
    out = audit.cluster_logistic(spark.createDataFrame(rows, "one int, x int, g int, y int"), ["one", "x"], "y", "g").collect()
    assert [round(r.beta, 5) for r in out] == [round(math.log(3 / 7), 5), round(math.log(6 / 4) - math.log(3 / 7), 5)] and all(r.se > 0 for r in out)


def test_sampling_keeps_positives_and_the_head(spark):
    c = spark.createDataFrame([(1, 1, i, i + 1, int(i == 25)) for i in range(30)] + [(2, 1, i, i + 1, 0) for i in range(5)], "session_id int, turn_number int, item_id int, rank int, label int")
    rows = fusion.sample_negatives(c, 10, 4, "s").collect()
    one = {r.item_id for r in rows if r.session_id == 1}
    assert len(one) == 10 and {0, 1, 2, 3, 25} <= one and sum(r.session_id == 2 for r in rows) == 5


def test_files_round_trip(spark, tmp_path):
    ranked = spark.createDataFrame([("s", 1, f"t{i}", i) for i in range(1, 5)], "session_id string, turn_number int, item_id string, rank int")
    records = files.predictions(ranked)
    files.write_table(records, f"{tmp_path}/p.jsonl")
    assert [r.item_id for r in files.read_predictions(spark, f"{tmp_path}/p.jsonl", 3).orderBy("rank").collect()] == ["t1", "t2", "t3"]
    with pytest.raises(Exception, match="fewer than 9"):
        files.read_predictions(spark, f"{tmp_path}/p.jsonl", 9).collect()
    files.zip_submission(records, f"{tmp_path}/s.zip")
    assert files.read_zipped(spark, f"{tmp_path}/s.zip").first().predicted_track_ids == ["t1", "t2", "t3", "t4"]
    for kind in ("parquet", "csv"):
        files.write_table(ranked, f"{tmp_path}/r.{kind}")
        assert files.read_table(spark, f"{tmp_path}/r.{kind}", ["item_id"]).count() == 4
    assert files.read_columns(spark, f"{tmp_path}/r.parquet", {"item_id": "string", "more": "float"}).first().more is None
    with pytest.raises(ValueError, match="schema has not"):
        files.conform(ranked.withColumn("new", ranked["rank"]), ranked.schema)
    (tmp_path / "ids.txt").write_text("a\n\nb\n")
    (tmp_path / "ids.json").write_text('["a", {"track_id": "b"}]')
    for name in ("ids.txt", "ids.json"):
        assert sorted(r.item_id for r in files.read_catalog_ids(spark, f"{tmp_path}/{name}").collect()) == ["a", "b"]
    assert "| s | 1 |" in files.markdown(ranked)


def test_later_splits_win(spark):
    a, b = spark.createDataFrame([(1, "old"), (2, "x")], "id int, v string"), spark.createDataFrame([(1, "new")], "id int, v string")
    assert dict(files.union_splits([a, b], "id").collect()) == {1: "new", 2: "x"}


def test_configurations_inherit():
    c = {"a": {"x": {"p": 1, "q": [1, 2]}, "y": 1}, "b": {"_base": "a", "x": {"q": [3]}}, "l": {"_base": "l"}}
    assert config.resolve("b", c) == {"x": {"p": 1, "q": [3]}, "y": 1}
    with pytest.raises(ValueError):
        config.resolve("l", c)


def test_generated_text_is_cleaned_or_replaced(spark):
    it = spark.createDataFrame([(1, "Song", "Band", "Album", ["rock", "x1y"])], "item_id int, name string, artist string, album string, tags array<string>")
    t = spark.createDataFrame([("a", "play"), ("b", "play")], "k string, query string")
    firsts = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, item_id int, rank int")
    p = generation.prompts(t, firsts, it, ["k"])
    assert p.first().grounding == "title: Song; artist: Band; album: Album; tags: rock"
    out = dict(generation.generate(p, lambda texts: ["Response: *hello*", ""][: len(texts)] if len(texts) > 1 else [""], it, ["k"]).collect())
    assert all(v == "hello" or v.startswith("I think you'll really enjoy \"Song\" by Band") for v in out.values())


def test_profiles_gate_and_cut_their_sources(spark):
    from quaver.operators import registry as G

    assert set(G.FETCH) == set(G.KEEP) == {n for p in G.PROFILES.values() for n in p} and len(G.PROFILES["G"]) == 20
    ranked = spark.createDataFrame([(q, i, i) for q in (1, 2) for i in range(1, 200)], "q int, item_id int, rank int")
    asked = []
    found = {n: (lambda k, n=n: asked.append((n, k)) or ranked.where(f"rank <= {k}")) for n in ("exact_tag_current", "history_same_artist", "popularity_fallback", "metadata_bm25_full_context")}
    intents = spark.createDataFrame([(1, "explicit_entity"), (2, "ambiguous")], "q int, intent string")
    rows = G.candidates("G", found, intents, ["q"]).groupBy("source", "q").count().collect()
    assert {(r.source, r.q): r["count"] for r in rows} == {("exact_tag_current", 2): 80, ("history_same_artist", 2): 100, ("popularity_fallback", 1): 50, ("popularity_fallback", 2): 50}
    assert asked == [("exact_tag_current", 500), ("history_same_artist", 500), ("popularity_fallback", 200)]
    assert {r.q for r in G.candidates("E", found, intents, ["q"]).where("source = 'history_same_artist'").collect()} == {1, 2}


def test_numbers_by_ranges_are_row_numbers(spark):
    rows = [(float((i * 7919) % 100), i) for i in range(5000)] + [(None, -1)]
    df = spark.createDataFrame(rows, "x double, k int").repartition(7)
    got = {r.k: r.n for r in ranking.numbered(df.where("x is not null"), ["x", "k"], "n").collect()}
    assert got == {k: i for i, (x, k) in enumerate(sorted(rows[:-1]))}


def test_a_list_that_is_not_full_is_an_error(spark):
    df = spark.createDataFrame([(1, 1, 5, 1), (1, 1, 6, 2), (2, 1, 5, 1)], "session_id int, turn_number int, item_id int, rank int")
    assert ranking.exactly(df.where("session_id = 1"), 2).count() == 2
    with pytest.raises(Exception, match="not 2 items: 2:1"):
        ranking.exactly(df, 2).collect()
    with pytest.raises(Exception, match="truth value"):
        spark.sql("select 'maybe' b").select(X.strict_bool(F.col("b"))).collect()


def test_first_sight_in_another_session_counts(spark):
    p = spark.createDataFrame([("u", "s1", 1, "a"), ("u", "s2", 1, "b"), ("u", "s2", 2, "a"), ("u", "s3", 1, "b"), (" ", "s4", 1, "a"), (None, "s5", 1, "a")], "user_id string, session_id string, turn_number int, item_id string")
    tasks = spark.createDataFrame([("s1", 2, "u"), ("s2", 3, "u"), ("s9", 1, "u"), ("s8", 1, " ")], "session_id string, turn_number int, user_id string")
    rows = sources.cross_session_pools(tasks, [p], 5).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.rank):
        got.setdefault(r.session_id, []).append((r.item_id, r.score))
    assert got == {"s1": [("b", 2.0), ("a", 1.0)], "s2": [("a", 1.0), ("b", 1.0)], "s9": [("a", 2.0), ("b", 2.0)]}


def test_lambdas_push_positives_up(spark):
    from quaver.operators import learning

    rows = [(1, 1, i, float(i == 3), float(-i)) for i in range(6)]
    got = {r.item_id: r.y for r in learning.lambdas(spark.createDataFrame(rows, "session_id int, turn_number int, item_id int, label double, score double")).collect()}
    assert got[3] > 0 and all(y < 0 for i, y in got.items() if i != 3) and abs(sum(got.values())) < 1e-9 and got[0] < got[5]


def test_reports_and_batches_refuse_what_does_not_fit(spark, tmp_path):
    df = spark.range(5).toDF("a")
    assert files.markdown(df, 5).count("\n") == 6
    with pytest.raises(ValueError, match="at most 4"):
        files.markdown(df, 4)
    with pytest.raises(ValueError, match="has not"):
        files.append_batches([df.withColumnRenamed("a", "b")], f"file://{tmp_path}/x", df.schema)


def test_bm25_in_blocks_is_bm25(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quaver.operators import retrieval

    texts = ["red ring", "red red bolt", "blue ring ring", "", None, "red ring", "old plate bolt"]
    docs = spark.createDataFrame([(i % 6 if i != 3 else None, t) for i, t in enumerate(texts)] + [(2, "ring red bolt"), (None, "red")], "doc bigint, text string")
    q = spark.createDataFrame([("a", "red ring ring"), ("b", "bolt"), ("c", "nothing like it"), ("a", "red ring ring")], "q string, text string")
    rows = [(d, [w for w in (t or "").split()]) for d, t in docs.collect()]
    mean, want = sum(len(w) for _, w in rows) / len(rows), {}
    tf = {}
    for d, w in rows:
        for t in w:
            tf[t, d, len(w)] = tf.get((t, d, len(w)), 0) + 1
    for key, text in {("a", "red ring"), ("b", "bolt")}:
        for t in text.split():
            df = sum(1 for x in tf if x[0] == t)
            for (term, d, dl), n in tf.items():
                if term == t:
                    want[key, d] = want.get((key, d), 0) + math.log(1 + (len(rows) - df + 0.5) / (df + 0.5)) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * dl / mean))
    for queries, documents in ((1 << 17, 1 << 16), (1, 2)):
        monkeypatch.setattr(retrieval, "BM25_QUERIES", queries)
        monkeypatch.setattr(retrieval, "BM25_DOCUMENTS", documents)
        found = retrieval.Bm25(docs, "doc", F.col("text")).top(q, ["q"], F.col("text"), 9)
        assert "CoGroup" in found._jdf.queryExecution().executedPlan().toString()  # pairs of a query and a document are never rows
        got = {(r.q, r.item_id): r.score for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in got)
    assert [r.rank for r in found.where("q = 'a'").orderBy("rank").collect()] == list(range(1, 1 + sum(k == "a" for k, _ in want)))
    assert retrieval.Bm25(docs.where("false"), "doc", F.col("text")).top(q, ["q"], F.col("text"), 9).count() == 0


def test_rows_are_not_dealt_by_stratum(spark, sf_dir):
    plan = registry.queries()["stratified_interval"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(o_orderpriority" not in "".join(x for x in plan.splitlines() if "Sort" not in x and "REPARTITION" in x)
    assert "SortMergeJoin [o_orderpriority" not in plan


def test_a_hash_is_computed_once_a_replicate(spark):
    df = spark.createDataFrame([(1, 2)], "g int, n int")
    plan = audit._replicated(df, "g", 9, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
    got = sorted((r.replicate, r.k) for r in audit._replicated(df, "g", 50, "s").collect())
    want = df.select(F.explode(F.sequence(F.lit(1), F.lit(50))).alias("i"), "g").select("i", audit.resample("s", F.col("g"), F.col("i")).alias("k")).where("k > 0").collect()
    assert got == sorted((r.i, r.k) for r in want)


def test_key_lists_are_cut_before_they_unfold(spark):
    from quaver.operators import retrieval

    v = spark.createDataFrame([(i, 1, f"name {n}", float(i % 5)) for i in range(40) for n in range(i % 3)] + [(i, 2, "long name 0", 1.0) for i in range(30)], "item_id int, field int, value string, popularity double").distinct()
    q = spark.createDataFrame([("q", "the long name 0 or name 1")], "q string, text string")
    hits = retrieval.exact_hits(q, retrieval.exact_index(v), ["q"], F.col("text"), 4)
    for of in (retrieval.exact_ranked, retrieval.exact_by_field):
        cut = of(hits, ["q"], 4)
        assert "WindowGroupLimit [field" in cut._jdf.queryExecution().executedPlan().toString()
        whole = of(hits.withColumn("pop_rank", F.col("pop_rank") * 0 - 1 if of is retrieval.exact_ranked else F.col("pop_rank")), ["q"], 4)
        assert sorted(cut.collect()) == sorted(whole.collect())
    by = {}
    for r in hits.collect():
        by.setdefault(r.field, {}).setdefault(r.item_id, []).append((r.ngram_rank, r.pop_rank))
    want = {(f, i) for f, x in by.items() for i in sorted(x, key=lambda i: (min(x[i]), i))[:4]}
    assert {(r.field, r.item_id) for r in retrieval.exact_by_field(hits, ["q"], 4).collect()} == want


def test_cosine_does_not_depend_on_blocks(spark, monkeypatch):
    from quaver.operators import retrieval

    rows = [(i, [math.sin(i * (k + 1)) for k in range(4)]) for i in range(60)]
    v = spark.createDataFrame(rows, "item_id int, v array<double>")
    q = v.select(F.col("item_id").alias("k"), F.col("v").alias("q"))
    whole = sorted(retrieval.cosine_top(q, v, ["k"], 5).collect())
    for queries, items, strip in ((1 << 16, 1 << 16, 7), (20, 25, 8), (7, 60, 1)):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", queries)
        monkeypatch.setattr(retrieval, "ITEM_BLOCK", items)
        monkeypatch.setattr(retrieval, "STRIP", strip)
        assert sorted(retrieval.cosine_top(q, v, ["k"], 5).collect()) == whole
    assert len(whole) == 295  # the first vector is zero


def test_fusion_deals_rows_once(spark):
    plan = fusion.rrf(lists(spark, a=["x", "y"], b=["y", "z"]), None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_plays_are_dealt_once_by_user_and_item(spark):
    p = spark.createDataFrame([("u", 1, 1, 7), ("u", 2, 1, 7), ("v", 3, 1, 8)], "user_id string, session_id int, turn_number int, item_id int")
    t = p.select("session_id", "turn_number", "user_id").distinct()
    for df in (sources.cross_session(t, p), sources.cross_session_pools(t, [p])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f"hashpartitioning(user_id, item_id, {ranking.SPREAD})" in __import__("re").sub(r"#\d+L?", "", plan)
        assert [(r.session_id, r.item_id) for r in df.orderBy("session_id").collect()] == [(1, 7), (2, 7)]
