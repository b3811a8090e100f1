from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

from quaver.llm import decontamination, language_id, quality_rules, toxicity, warc

from .fixtures import ODD, documents, prose


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(texts, items, window=10):
    wins = [(i, tuple(w[k : k + min(window, len(w))])) for i, w in ((i, item_words(t)) for i, t in items) for k in range(max(1, len(w) - window + 1)) if w]
    out = []
    for t in texts:
        w, hit, found = item_words(t), set(), set()
        for i, g in wins:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(str(i))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, prose(30, 3)), (2, prose(12, 4) + " " + prose(9, 5)), (10, "tiny item"), (11, "Tiny, item!"), (12, None), (13, "..."), (14, "single"), (3, prose(10, 3)), (1, prose(30, 3))]


def contaminated_texts():
    p = prose(30, 3).split()
    return [*ODD, " ".join(p[5:20]), "x " + " ".join(p[:9]), "x " + " ".join(p[:10]) + " y " + " ".join(p[15:27]), "a TINY-item here and a Single one", prose(9, 5) + " z", " ".join(p).upper(), "tiny", "été tiny item été"]


def test_contamination_is_that_of_all_windows(spark):
    texts, bench = contaminated_texts(), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = brute_contamination(texts, ITEMS)
    rows = sorted(decontamination.digest(documents(spark, texts), bench).collect())
    assert [tuple(r[1:]) for r in rows] == want
    blocks = decontamination.contamination(documents(spark, texts), bench, block_words=15).collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in sorted(blocks, key=lambda r: r.doc_id)] == [(a, b, c, e) for a, b, c, _, e in want]


def test_spans_are_cut_and_covered_documents_dropped(spark):
    p = prose(30, 3)
    texts = [f"{prose(60, 8)} -- {p}! {prose(5, 9)}", p + " end", prose(40, 11), None, ""]
    docs, bench = documents(spark, texts), spark.createDataFrame([(1, p)], "item_id bigint, text string")
    left = {r.doc_id: r for r in decontamination.remove_contamination(docs, bench).collect()}
    assert set(left) == {0, 2, 3, 4} and left[0].text == f"{prose(60, 8)} -- ! {prose(5, 9)}" and left[2].text == texts[2] and left[3].text is None and left[4].n_words == "clash"
    assert {r.doc_id for r in decontamination.remove_contamination(docs, bench, max_coverage=0.0).collect()} == {2, 3, 4}
    assert {r.doc_id for r in decontamination.remove_contamination(docs, bench, min_span=31).collect()} == {0, 1, 2, 3, 4}
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.remove_contamination(docs, empty).count() == 5 and decontamination.digest(documents(spark, []), bench).count() == 0
    assert not any(r.contaminated for r in decontamination.digest(docs, empty).collect())


def test_blocks_of_items_decide_together(spark):
    a, b = prose(20, 3), prose(20, 4)
    long = prose(12, 8).split()
    bench = spark.createDataFrame([(1, a), (2, b), (3, " ".join(long)), (4, " ".join(long[6:] + a.split()[:6]))], "item_id bigint, text string")
    texts = [f"{a} {prose(12, 20)} {b}", f"x {' '.join(long)} {' '.join(a.split()[:6])} " + prose(40, 21), prose(30, 22), None]
    docs = documents(spark, texts)
    repeated = docs.unionAll(documents(spark, [a])).unionAll(docs.selectExpr("cast(null as bigint) doc_id", *docs.columns[1:]))
    one, many = ([sorted(map(str, decontamination.contamination(repeated, bench, block_words=n).collect())) for n in (10**6, 15)])
    assert one == many and len(one) == 9
    one, many = ([sorted(map(str, decontamination.remove_contamination(repeated, bench, block_words=n).collect())) for n in (10**6, 15)])
    assert one == many and not any(prose(12, 20) in r for r in many)


def brute_quality(text):
    text = text or ""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    w = split(text)
    lines = [x for x in text.split("\n") if split(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


QUALITY = [t if t is None or len(t) < 4000 else t[:4000] for t in ODD] + ["a b c a b c d\na b\n\n \na b\r\na b\n", "x\ny\nx\nx", "# * $%&|<> é|", "a\tb\x0bc\x0cd " * 20, "a a a a a a"]


def test_base_counts_are_those_of_the_text(spark):
    rows = sorted(quality_rules.assess(documents(spark, QUALITY, langs=[None, "en"] * (len(QUALITY) // 2) + ["fr"] * (len(QUALITY) % 2))).collect())
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows] == [brute_quality(t) for t in QUALITY]
    assert all(not r.kept for r in rows if r.base_failed)
    assert quality_rules.assess(documents(spark, [])).count() == 0


def brute_verdict(texts, langs, o=quality_rules):
    """kept of every text, by dicts: learned common words, references of 20 texts, each text's own counts taken off."""
    def split(t):
        return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub(r"[.,;:!?'\"()\[\]{}/\\_@+=~^`#*$%&|<>-]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) if w]

    def kind(c):
        for k, chars in ((1, "aeiou"), (2, "bcdfghjklmnpqrstvwxyz"), (4, "0123456789"), (5, " \t\n\r"), (6, ".,;:!?'\"-"), (7, "()[]{}/\\_@+=~^`"), (8, "#*$%&|<>")):
            if c in chars:
                return k
        return 3 if "A" <= c <= "Z" else 0 if c < "\x80" else 9 if c < "\u0280" else 10

    langs = [x or "" for x in langs]
    words = [split(t) for t in texts]
    counts = {x: Counter(w for ws, y in zip(words, langs, strict=True) if y == x for w in ws) for x in set(langs)}
    common = {w for c in counts.values() for w, k in c.items() if k >= o.COMMON_SHARE * sum(c.values())}
    hist = [(Counter(map(kind, t or "")), Counter(w if w in common else "" for w in ws)) for t, ws in zip(texts, words, strict=True)]
    failed = [brute_quality(t)[-1] for t in texts]
    references = {}
    for x in set(langs):
        own = [h for h, y, f in zip(hist, langs, failed, strict=True) if y == x and not f]
        if len(own) >= o.MIN_REFERENCE:
            references[x] = tuple(sum((h[k] for h in own), Counter()) for k in (0, 1))

    def distance(p, q):
        np_, nq = max(sum(p.values()), 1), max(sum(q.values()), 1)
        total = 0.0
        for k in p | q:
            a, b = p[k] / np_, q[k] / nq
            m = (a + b) / 2
            total += (a * np.log2(a / m) if a else 0) + (b * np.log2(b / m) if b else 0)
        return np.sqrt(max(total / 2, 0))

    out = []
    for h, x, f in zip(hist, langs, failed, strict=True):
        near = [min((distance(h[k], r[k] - h[k] if y == x and not f else r[k]) for y, r in references.items()), default=0) for k in (0, 1)]
        out.append(not f and (near[0] <= o.MAX_CHAR_DISTANCE or sum(h[0].values()) < o.MIN_CHARS) and (near[1] <= o.MAX_WORD_DISTANCE or sum(h[1].values()) < o.MIN_WORDS))
    return out


def test_verdicts_are_those_of_plain_sums(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    soup = [" ".join(f"w{i}%%%&&& ***{i}$$$ ###" for i in range(300)), None, "", " ".join(f"zz{i}q" for i in range(400))]
    texts, langs = [r.text for r in rows] + soup, [r.lang for r in rows] + ["spam", None, "en", "lone"]
    got = sorted(quality_rules.assess(documents(spark, texts, langs=langs).repartition(5)).collect())
    want = brute_verdict(texts, langs)
    assert [r.kept for r in got] == want
    assert not want[len(rows)] and not want[len(rows) + 3] and sum(want) > 0.6 * len(rows)


def test_more_than_sixty_four_tags_are_references(spark):
    rng = np.random.default_rng(4)
    texts, langs = [], []
    for k in range(70):
        own = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(40)]
        for _ in range(25):
            texts.append(" ".join(rng.choice(own, 120)))
            langs.append(f"l{k}")
    rows = quality_rules.assess(documents(spark, texts, langs=langs)).collect()
    assert all(r.kept or r.base_failed for r in rows) and sum(r.kept for r in rows) > 0.95 * len(rows)


def test_distance():
    p = np.array([[1, 0], [1, 1], [0, 0]])
    assert np.allclose(quality_rules.distance(p, np.array([1, 1])), [0.55787, 0, 0.70711], atol=1e-4)


def test_languages_are_told(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = documents(spark, [None, "", "12345 %%%", "qxzvk wqjxz kzzqv xxqjw vvkqz zqxjk wvxzq"], langs=["en", None, "en", "en"], sources=[None] * 4, first=10**6).select(*docs.columns)
    rows = {r.doc_id: r for r in language_id.identify(docs.unionAll(odd)).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(rows[i].language == t for i, t in truth.items()) > 0.98 * len(truth)
    assert [rows[10**6 + i].accepted for i in range(4)] == [False] * 4
    left = language_id.keep_identified(docs.unionAll(odd))
    assert left.columns == docs.columns and left.count() == sum(r.accepted for r in rows.values())
    # text alone is enough, and a wrong tag does not outweigh it
    from pyspark.sql import functions as F

    model = language_id.train(docs)
    wrong = language_id.identify(docs.where("n_chars > 400").withColumn("lang", F.lit("de")), model=model).collect()
    assert sum(r.language == truth[r.doc_id] for r in wrong) > 0.95 * len(wrong)
    assert language_id.identify(documents(spark, [])).count() == 0
    assert {r.language for r in language_id.identify(documents(spark, ["some text"], langs=[None])).collect()} == {"und"}


def test_more_than_sixteen_languages_are_told(spark):
    rng = np.random.default_rng(2)
    n, texts, langs = 20, [], []
    for k in range(n):
        own = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(30)]
        for _ in range(10 + n - k):
            texts.append(" ".join(rng.choice(own, 60)))
            langs.append(f"l{k:02d}")
    docs = documents(spark, texts, langs=langs)
    rows = language_id.identify(docs).collect()
    assert all(r.text_language == r.language == langs[r.doc_id] and r.accepted for r in rows) and len(rows) == len(texts)
    assert language_id.train(docs, max_langs=3)[0] == ["l00", "l01", "l02", "und"]


def brute_fusion(rows, langs, table, cap=60, pull=20.0):
    """language and confidence of rows (text, declared, suffix, host), one by one: the model's likelihoods, then counts in dicts."""
    n, ll, letters = len(langs), [], []
    for text, *_ in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        _, bins = language_id.trigram_bins(raw, np.array([0, len(raw)]))
        x = np.zeros(n)
        for b in bins:
            x += table[:, b].astype(np.float32)
        ll.append(x * min(len(bins), cap) / max(len(bins), 1))
        letters.append(len(bins) > 0)
    post = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in ll]
    total = sum(post)
    whole = total.sum()
    base = (total + 1) / (whole + n)
    by = lambda *at: {k: sum(p for p, r in zip(post, rows, strict=True) if tuple(r[i] or "" for i in at) == k) for k in {tuple(r[i] or "" for i in at) for r in rows}}
    suffixes, hosts, told = by(2), by(2, 3), by(1)
    out = []
    for r, x, seen in zip(rows, ll, letters, strict=True):
        c = suffixes[r[2] or "",]
        level = (c + pull * base) / (c.sum() + pull)
        h = hosts[r[2] or "", r[3] or ""]
        prior = (h + pull * level) / (h.sum() + pull)
        t = told[r[1] or "",]
        says = (t + pull * t.sum() / whole) / (total + pull)
        z = x + np.log(prior) + np.log(says)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        out.append((langs[int(p.argmax())], p.max()) if seen else ("und", 0.0))
    return out


def test_fusion_of_four_kinds_of_evidence(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odd = spark.createDataFrame([(9001, None, None), (9002, "https://a.example.fr/x", "<html lang=fr>12 %%"), (9003, "nowhere", ""), (9003, "nowhere", "")], "page_id bigint, url string, html string")
    evidence = language_id.page_evidence(pages.unionAll(odd))
    model = language_id.train(evidence)
    got = sorted(language_id.identify(evidence, id_col="page_id", suffix="suffix", host="source", model=model).collect(), key=lambda r: r.page_id)
    rows = sorted(evidence.collect(), key=lambda r: r.page_id)
    want = brute_fusion([(r.text, r.lang, r.suffix, r.source) for r in rows], *model)
    assert len({r.suffix for r in rows}) > 3 and len({r.source for r in rows}) > 10
    for r, (language, confidence) in zip(got, want, strict=True):
        assert r.language == language and abs(r.confidence - confidence) < 1e-5 and r.accepted == (language != "und" and confidence >= 0.5)


def test_languages_are_told_without_their_tags(spark):
    """Truth held apart from evidence: rows of odd id have no tag, and theirs are compared."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    hidden = docs.selectExpr("doc_id", "text", "if(doc_id % 2 = 1, null, lang) lang", "source", "n_chars")
    rows = [r for r in language_id.identify(hidden).collect() if r.doc_id % 2]
    assert sum(r.language == truth[r.doc_id] for r in rows) > 0.97 * len(rows)


def test_page_evidence(spark):
    rows = [(1, "https://User@Example.ORG:8080/x", '<html LANG="fr-CA"><script>var a="<p>";</script><p>Bonjour &amp; salut</p>'), (2, None, None), (3, "no url", "plain")]
    e = sorted(language_id.page_evidence(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())
    assert (e[0].lang, e[0].suffix, e[0].source, e[0].text.split()) == ("fr", "org", "example.org", ["Bonjour", "&amp;", "salut"])
    assert (e[1].lang, e[1].text) == (None, None) and (e[2].suffix, e[2].text) == (None, "plain")


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>é\r\n\r\nWARC/1.1\r\n</p>", None, "", "same", "same", "x" * 300000, "same"]
    pages = spark.createDataFrame([(i, f"http://a.example/{i} b", h, "clash") for i, h in enumerate(html)], "page_id bigint, url string, html string, record_type string").repartition(3)
    for compression in ("none", "gzip"):
        path = f"file://{tmp_path}/{compression}"
        warc.archive_pages(pages, path, compression=compression)
        rows = sorted(warc.read_back(spark, path).collect())
        for r, h in zip(rows, html, strict=True):
            raw = (h or "").encode()
            first = min(i for i, x in enumerate(html) if (x or "") == (h or ""))
            assert (r.payload_bytes, r.payload_digest) == (len(raw), warc.sha1_base32(raw))
            assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
        full = spark.read.format("warc").option("path", path).load()
        got = full.where("record_type = 'response'").collect()
        assert {bytes(r.payload) for r in got} == {(h or "").encode() for h in html}
        plan = full.where("record_type = 'revisit' and target_uri = 'http://a.example/4%20b'")
        assert [r.record_id for r in plan.collect()] == ["<urn:page:4>"]


def test_pushed_predicates_pass_over_payloads(tmp_path):
    reader = warc.WarcReader({"path": f"file://{tmp_path}", "verify": "true"})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_length",), 3)]))
    assert len(left) == 1 and reader.wanted == {"record_type": {"revisit"}}
    bad = warc.record({"record_id": "<a>", "record_type": "response", "target_uri": "u", "date": "d", "payload": b"abc", "payload_digest": "sha1:WRONG", "payload_length": 3, "refers_to": None})
    (tmp_path / "a.warc").write_bytes(bad)
    assert list(reader.records(f"{tmp_path}/a.warc")) == []  # a wrong digest is not seen: the payload is never read
    import pytest

    with pytest.raises(ValueError, match="digest"):
        list(warc.WarcReader({"path": f"file://{tmp_path}", "verify": "true"}).records(f"{tmp_path}/a.warc"))
    (tmp_path / "cut.warc").write_bytes(bad[:-10])
    with pytest.raises(ValueError, match="cut off"):
        list(warc.WarcReader({"path": f"file://{tmp_path}"}).records(f"{tmp_path}/cut.warc"))


def test_appends_add_up_and_overwrites_replace(spark, tmp_path):
    """Each write is by a writer of its own, as of another application."""
    path = f"file://{tmp_path}/w"
    write = lambda lo, n, mode: spark.range(lo, lo + n).selectExpr("concat('<', id, '>') record_id", "'response' record_type", "concat('http://h/a b\t', id) target_uri", "'1970-01-01T00:00:00Z' date", "cast('x' as binary) payload", "'sha1:X' payload_digest", "1L payload_length", "cast(null as string) refers_to").repartition(2).write.format("warc").option("path", path).mode(mode).save()
    read = lambda: sorted(int(r.record_id[1:-1]) for r in spark.read.format("warc").option("path", path).load().collect())
    warc.register(spark)
    write(0, 5, "append")
    write(5, 5, "append")
    assert read() == list(range(10))
    write(20, 3, "overwrite")
    assert read() == [20, 21, 22]
    write(30, 2, "append")
    assert read() == [20, 21, 22, 30, 31]
    names = [p.name for p in (tmp_path / "w").iterdir() if p.name.endswith(".warc")]
    assert len(names) == len(set(names)) == 4
    assert {r.target_uri for r in spark.read.format("warc").option("path", path).load().where("record_id = '<30>'").collect()} == {"http://h/a%20b%0930"}


def test_small_blocks_read_like_large_ones(tmp_path):
    import gzip
    import io

    one = lambda i: warc.record({"record_id": f"<{i}>", "record_type": "response", "target_uri": "u", "date": "d", "payload": b"p\r\n\r\nq" * i, "payload_digest": "sha1:X", "payload_length": 6 * i, "refers_to": None})

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    plain = b"".join(map(one, range(30)))
    for kind, raw in ((warc._Plain, plain), (warc._Gzip, b"".join(gzip.compress(one(i)) for i in range(30)))):
        for block in (1, 7, 100, 1 << 20):
            source, got = kind(File(raw), block), []
            while (head := source.head()) is not None:
                if head.strip():
                    h = warc.parse_head(head)
                    n = int(h["content-length"])
                    i = int(h["warc-record-id"][1:-1])
                    got.append(i)
                    if i % 3:
                        source.skip(n)
                    else:
                        assert warc._payload("application/http", source.take(n)) == b"p\r\n\r\nq" * i
            assert got == list(range(30))


def test_warc_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 3000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("doc_id < 3000")
    odd = documents(spark, [None, "", "!!!"], first=10**6).select(*docs.columns)
    rows = {r.doc_id: r for r in toxicity.score(docs.unionAll(odd), labels, rounds=8).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    held = [(rows[x.doc_id].score, x.toxic) for x in labels.collect() if rows[x.doc_id].held_out]
    good, bad = [s for s, t in held if not t], [s for s, t in held if t]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.9 and len(rows) == 3003


def test_the_nearest_pair_of_a_long_text_counts():
    text = "idiot " * 2100 + "word " * 50 + "idiot you " + "word you " * 900
    assert toxicity.features(text, {})[toxicity.FEATURES.index("near_second")] == 1.0
    text = "you " + "word " * 9 + "idiot " * 2100 + "word " * 4 + "you"
    assert toxicity.features(text, {})[toxicity.FEATURES.index("near_second")] == 0.2


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.score for r in toxicity.score(documents(spark, ["a", None]), none).collect()] == [0.0, 0.0]
    assert toxicity.score(documents(spark, []), none).count() == 0
