from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from quaver.llm import line_dedup, minhash_dedup, substring_dedup
from quaver.llm.common import mix, shingles
from quaver.llm.graph import connected_components

from .fixtures import ODD, documents, prose


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingle_set(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(texts, percent):
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def mutated(text, share, rng):
    w = text.split()
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = f"z{rng.randrange(10**9)}"
    return " ".join(w)


def near_texts():
    rng = random.Random(5)
    texts = list(ODD)
    for g in range(6):
        base = prose(rng.choice((30, 120, 400)), 50 + g)
        texts += [mutated(base, rng.choice((0.0, 0.005, 0.01, 0.02, 0.05)), rng) for _ in range(14)]
    passage = prose(60, 999)
    texts += [prose(25, 200 + i) + " " + passage for i in range(15)]  # one passage in most of each text
    texts += [base, base.upper().replace("Z", "z")]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("percent", [80, 85])
def test_components_are_those_of_all_pairs(spark, percent):
    texts = near_texts()
    want, sizes = components(texts, percent)
    rows = sorted(minhash_dedup.near_duplicates(documents(spark, texts), percent).collect())
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows] == [(i, sizes[i], want[i], want[i] == i) for i in range(len(texts))]


@pytest.mark.parametrize("percent", [80, 85])
def test_partners_of_more_shingles_than_a_sketch_holds(spark, percent):
    texts = []
    for n in range(60, 67):
        for i in range(5):
            ws = [f"n{n}x{i}w{j}" for j in range(100 * n // percent + 4)]
            texts += [" ".join(ws[: n + 4]), " ".join(ws)]
    want, sizes = components(texts, percent)
    assert all(want[i] == i - i % 2 for i in range(len(texts)))
    rows = sorted(minhash_dedup.near_duplicates(documents(spark, texts), percent).collect())
    assert [(r.n_shingles, r.component_id) for r in rows] == list(zip(sizes, want, strict=True))


def test_one_of_each_group_stays(spark):
    texts = near_texts()
    want, _ = components(texts, 80)
    docs = documents(spark, texts)
    left = minhash_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [i for i in range(len(texts)) if want[i] == i]


def test_rows_that_repeat_or_have_no_id(spark):
    docs = documents(spark, [prose(60, 1), prose(60, 2)]).unionAll(documents(spark, [prose(60, 1)]))
    null = documents(spark, [prose(60, 1)]).selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars", "n_words", "keep")
    rows = minhash_dedup.near_duplicates(docs.unionAll(null)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id is not None) == [(0, 0, True), (0, 0, True), (1, 1, True)]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert sorted(str(r.doc_id) for r in minhash_dedup.drop_near_duplicates(docs.unionAll(null)).collect()) == ["0", "1", "None"]


def test_ids_may_be_strings(spark):
    texts = near_texts()
    want, _ = components(texts, 80)
    docs = documents(spark, texts)
    named = docs.selectExpr("concat('k', 1000 + doc_id) doc_id", *docs.columns[1:])
    rows = sorted(minhash_dedup.near_duplicates(named).collect())
    assert [r.component_id for r in rows] == [f"k{1000 + w}" for w in want]
    twice = minhash_dedup.drop_near_duplicates(named.unionAll(named.selectExpr("doc_id", "concat(text, ' more')", *docs.columns[2:])))
    assert twice.columns == docs.columns and len({r.doc_id for r in twice.collect()}) == twice.count()


def test_near_duplicates_of_nothing(spark):
    assert minhash_dedup.near_duplicates(documents(spark, [])).count() == 0
    assert minhash_dedup.drop_near_duplicates(documents(spark, [None, "", "a"])).count() == 3


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(200, 200)] + [(301, 300), (302, 301), (300, 302)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{x: 100 for x in range(100, 130)}, **{x: 300 for x in (300, 301, 302)}}


def brute_lines(texts, min_docs=10, depth=3, similar=0.7, min_tokens=3):
    """For each text (its number is its id; those of one number in a list of pairs are one document) the places of the lines that go."""
    leaves, lines = defaultdict(set), []
    for doc, text in texts:
        for pos, line in enumerate((text or "").split("\n")):
            t = tuple(x for x in re.split(r"[\x20\t\x0b\x0c\r]+", line) if x)
            if t:
                m = tuple("<*>" if re.search("[0-9]", x) else x for x in t)
                leaf = ("exact", t) if len(t) < min_tokens else (len(t), m[:depth])
                leaves[leaf].add(doc)
                lines.append((doc, text, pos, t, m, leaf))
    lines = [x for x in lines if len(leaves[x[-1]]) >= min_docs]
    held = defaultdict(set)
    for doc, _, _, _, m, leaf in lines:
        for at, x in enumerate(m):
            held[leaf, at, x].add(doc)
    named, docs = [], defaultdict(set)
    for doc, text, pos, t, m, leaf in lines:
        g = tuple(x if x != "<*>" and len(held[leaf, at, x]) >= min_docs else None for at, x in enumerate(m))
        template = (leaf, g) if leaf[0] != "exact" and sum(x is not None for x in g) >= similar * len(g) else t
        named.append((template, doc, text, pos))
        docs[template].add(doc)
    first = {}
    for template, doc, _, pos in named:
        first[template] = min(first.get(template, (doc, pos)), (doc, pos))
    gone = defaultdict(set)
    for template, doc, text, pos in named:
        if len(docs[template]) >= min_docs and first[template] != (doc, pos):
            gone[doc, text].add(pos)
    return gone


def test_lines_that_go_are_those_of_plain_counts(spark):
    rng = random.Random(6)
    texts = []
    for i in range(120):
        lines = [prose(rng.randrange(1, 12), i) if rng.random() < 0.5 else rng.choice(("Les.", "read more", f"page {i} of {i + 3}", f"user n{i} from {chr(97 + i % 7)} logged in today at noon", "a b c d", f"a b {chr(97 + i % 20)} d e")) for _ in range(rng.randrange(12))]
        texts.append(rng.choice(("\n", "\r\n", "\n\n")).join(lines))
    pairs = [*enumerate(texts + ODD), *enumerate(texts[:15]), (3, "another text\nLes.\nread more"), (4, None)]
    docs = spark.createDataFrame([(str(i), t, "clash", 1) for i, t in pairs], "doc_id string, text string, gone string, stays int").repartition(4)
    gone = brute_lines([(str(i), t) for i, t in pairs])
    want = [(str(i), None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[str(i), t])) for i, t in pairs]
    got = [(r.doc_id, r.text) for r in line_dedup.drop_recurring_lines(docs, drop_empty=False).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(map(len, gone.values())) > 100
    report = line_dedup.line_report(docs).collect()
    assert sum(r.n_dropped for r in report) == sum(len(gone[str(i), t]) for i, t in pairs)
    assert sum(r.n_lines for r in report) == sum(bool(x.strip(" \t\r\x0b\x0c")) for _, t in pairs for x in (t or "").split("\n"))


def test_recurring_templates_go_but_for_the_first(spark):
    log = "user {} logged in from host {}"
    texts = [f"{prose(20, i)}\n{log.format(f'n{i}x', chr(97 + i) * 3)}\n{prose(12, 100 + i)}" for i in range(12)]
    texts += [None, "", "\n\n", "only this line is here once"]
    rows = {r.doc_id: r for r in line_dedup.line_report(documents(spark, texts)).collect()}
    assert [rows[i].n_dropped for i in range(16)] == [0] + [1] * 11 + [0] * 4
    assert [rows[i].n_lines for i in range(16)] == [3] * 12 + [0, 0, 0, 1]
    docs = documents(spark, texts)
    left = {r.doc_id: r for r in line_dedup.drop_recurring_lines(docs).collect()}
    assert len(left) == 16 and left[12].text is None and left[3].text == "\n".join(texts[3].split("\n")[::2]) and left[0].text == texts[0]
    assert left[3].n_words == "clash"


def test_lines_in_few_documents_stay(spark):
    texts = [f"a line of words that is shared here\n{prose(15, i)}" for i in range(9)]
    assert sum(r.n_dropped for r in line_dedup.line_report(documents(spark, texts)).collect()) == 0
    texts = ["the same whole document"] * 30
    left = line_dedup.drop_recurring_lines(documents(spark, texts)).collect()
    assert [r.doc_id for r in left] == [0]


def test_prose_with_a_common_beginning_stays(spark):
    texts = [f"it was the {' '.join(prose(12, i).split())}" for i in range(40)]
    assert sum(r.n_dropped for r in line_dedup.line_report(documents(spark, texts)).collect()) == 0


def test_short_lines_recur_word_for_word(spark):
    texts = [f"{prose(15, i)}\nLes.\nAnd  ornd.\n{i}\npage {i}\n\nrow{i % 3} x" for i in range(12)] + ["Les."] + ["few words"] * 9
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in line_dedup.line_report(docs).collect()}
    assert [rows[i].n_dropped for i in range(22)] == [0] + [2] * 11 + [1] + [0] * 9
    left = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(docs).collect()}
    assert left[0] == texts[0] and left[5] == texts[5].replace("Les.\nAnd  ornd.\n", "") and 12 not in left and len(left) == 21


def test_line_dedup_of_nothing(spark):
    assert line_dedup.line_report(documents(spark, [])).count() == 0


def test_repeated_passages_are_found(spark):
    rng = random.Random(3)
    passages = [prose(n, 700 + n) for n in (50, 55, 80, 200)]
    texts, holds = list(ODD), defaultdict(set)
    for i in range(40):
        p = rng.randrange(4)
        holds[p].add(len(texts))
        texts.append(prose(rng.randrange(10, 200), 10 + i) + " " + passages[p] + " " + prose(rng.randrange(10, 100), 5000 + i))
    rows = substring_dedup.repeated_passages(documents(spark, texts)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for ids in holds.values():
        if len(ids) > 1:
            told = [{r.class_id for r in by[i] if r.kind == "exact"} for i in ids]
            assert set.intersection(*told) and set.union(*told) <= ids
    held = {i for ids in holds.values() for i in ids}
    assert {r.doc_id for r in rows} - held <= {i for i, t in enumerate(ODD) if t and len(t.split()) >= 50}


def test_copies_and_near_passages(spark):
    rng = random.Random(8)
    passage = prose(150, 77)
    texts = [prose(80, 1), prose(80, 1), prose(30, 2), prose(30, 2), prose(40, 3) + " " + passage, prose(40, 4) + " " + mutated(passage, 0.02, rng), prose(90, 6)]
    rows = substring_dedup.repeated_passages(documents(spark, texts)).collect()
    assert {(r.doc_id, r.class_id) for r in rows if r.kind == "copy"} == {(0, 0), (1, 0)}
    assert {r.doc_id for r in rows} == {0, 1, 4, 5}


def planted(k, n, every=45):
    """A passage of n words and a near copy, one word in `every` changed: no 46 words are the same, 50 are similar."""
    w = [f"p{k}w{i}" for i in range(n)]
    return w, [f"q{k}w{i}" if i % every == every - 1 else x for i, x in enumerate(w)]


def test_near_passages_meet_beyond_their_hubs(spark):
    first, second, hubs = [], [], []
    for k in range(24):
        a, b = planted(k, 89)
        hubs.append(" ".join(f"h{k}w{i}" if i % 15 == 14 else x for i, x in enumerate(a)))
        first.append(prose(60, 300 + k) + " " + " ".join(a))
        second.append(prose(60, 600 + k) + " " + " ".join(b))
    rows = substring_dedup.repeated_passages(documents(spark, hubs + first + second)).collect()
    found = {r.doc_id for r in rows if r.kind == "near"}
    assert found == set(range(24, 72))


def test_near_passages_of_long_lists_all_meet(spark):
    """Two near texts among forty that hold their signatures, and shingles of one another, but are similar to neither."""
    import numpy as np

    from quaver.llm.common import WHITE, Words

    rng, texts, near = random.Random(4), [], set()
    for k in range(16):
        a = [f"p{k}w{i}" for i in range(60)]
        b = [f"q{k}w{i}" if i == 30 else w for i, w in enumerate(a)]
        signed = []
        for w in (a, b):
            raw = np.frombuffer(" ".join(w).encode(), np.uint8)
            told = Words(raw, np.array([0, len(raw)]), WHITE, lower=True)
            signed.append({(band, v) for band, _, vs, *_ in substring_dedup.joint_windows(told.hash, told.first, 46, 5, 3) for v in vs.tolist()})
        if signed[0] & signed[1]:
            near |= {len(texts), len(texts) + 1}
        texts += [" ".join(a), " ".join(b)]
        texts += [" ".join(f"r{k}w{i}v{rng.randrange(8)}" if i % 15 == 7 else w for i, w in enumerate(a)) for _ in range(40)]
    assert len(near) >= 28
    rows = substring_dedup.repeated_passages(documents(spark, texts)).collect()
    assert near <= {r.doc_id for r in rows if r.kind == "near"}
    assert substring_dedup.repeated_passages(documents(spark, texts), rounds=0).where("kind = 'near'").select("doc_id").distinct().count() >= len(near)


def test_near_copies_meet_by_their_contents(spark, monkeypatch):
    """Copies with one edit each, at few places: twice as many make no more than about twice the rows of any table."""
    made = {}

    def counted(df, name, old=substring_dedup.materialize):
        out = old(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(substring_dedup, "materialize", counted)
    rows = []
    for n in (40, 80):
        made.clear()
        texts = [" ".join(f"e{k}" if i == 20 + 8 * (k % 4) else f"w{i}" for i in range(64)) for k in range(n)]
        found = substring_dedup.repeated_passages(documents(spark, texts), rounds=0)
        assert found.select("doc_id").distinct().count() == n
        rows.append(dict(made))
    assert all(rows[1][name] <= 3 * max(count, 100) for name, count in rows[0].items()), rows


def test_near_passages_are_reported_whole(spark):
    a, b = planted(1, 2000)
    rows = substring_dedup.repeated_passages(documents(spark, [" ".join(a), " ".join(b)])).collect()
    assert sorted((r.doc_id, r.start, r.end, r.kind) for r in rows) == [(0, 0, 2000, "near"), (1, 0, 2000, "near")]
    assert len({r.class_id for r in rows}) == 1


def test_windows_beside_a_spot_are_all_compared():
    rng = random.Random(1)
    for _ in range(100):
        a = [rng.randrange(60) if rng.random() < 0.3 else i for i in range(rng.randrange(20, 120))]
        b = [7] * rng.randrange(9) + [rng.randrange(1000) if rng.random() < 0.08 else x for x in a]
        spots = {(x, y) for x in range(len(a)) for y in range(len(b)) if a[x] == b[y] and rng.random() < 0.1}
        got = {(x, d) for s, e, d in substring_dedup._similar(a, b, spots, 10, 60) for x in range(s, e + 1)}
        near = {(x, d) for d in {x - y for x, y in spots} for x in range(max(0, d), min(len(a), len(b) + d) - 9) if substring_dedup._alike(a[x : x + 10], b[x - d : x - d + 10], 60)}
        assert {(x, d) for x, d in near if any(x <= c < x + 10 and c - y == d for c, y in spots)} <= got <= near


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.repeated_passages(documents(spark, [])).count() == 0


def test_windows_are_the_nodes_of_the_tree():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 3, 10, 60, 300):
        for most in (8, 1 << 40):  # with ties and without
            h = rng.integers(0, most, n).astype(np.uint64) << np.uint64(24)
            want = []
            for c in range(n):
                a = c
                while a > 0 and h[a - 1] > h[c]:
                    a -= 1
                b = c
                while b + 1 < n and h[b + 1] >= h[c]:
                    b += 1
                if b - a + 1 >= 5:
                    want.append((a, c, b))
            assert substring_dedup.compact_windows(h, 5) == want


def test_joint_windows_are_the_intervals_of_both_trees():
    import numpy as np

    rng = np.random.default_rng(2)
    width, n = 12, 5
    texts = [rng.integers(0, most, size).astype(np.uint64) for size, most in ((0, 9), (15, 9), (16, 1 << 60), (200, 1 << 60), (300, 4))]
    words, first = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    old, substring_dedup.STARTS = substring_dedup.STARTS, 64  # blocks end within texts
    try:
        got = defaultdict(set)
        for band, doc, v, s, e, c in substring_dedup.joint_windows(words, first, width, n, 2):
            for row in zip(doc.tolist(), v.tolist(), s.tolist(), e.tolist(), c.tolist(), strict=True):
                for at in range(row[2], row[3] + 1):
                    assert at not in {x for d, x, *_ in got[band] if d == row[0]}
                    got[band].add((row[0], at - first[row[0]], row[1], row[4] - first[row[0]]))
    finally:
        substring_dedup.STARTS = old
    for band in range(2):
        want, signature = set(), {}
        for d, t in enumerate(texts):
            g = shingles(t, n) if len(t) >= width + n - 1 else t[:0]
            trees = [substring_dedup.compact_windows(mix(g ^ substring_dedup._SEED[2 * band + k]), width) for k in (0, 1)]
            for lo, c, hi in trees[0]:
                for lo2, c2, hi2 in trees[1]:
                    for at in range(max(lo, c - width + 1, lo2, c2 - width + 1), min(c, hi - width + 1, c2, hi2 - width + 1) + 1):
                        want.add((d, at, (int(g[c]), int(g[c2])), c))
        assert {(d, at, c) for d, at, _, c in want} == {(d, at, c) for d, at, _, c in got[band]}
        for d, at, pair, c in want:
            signature.setdefault(pair, set()).update(v for d2, at2, v, c2 in got[band] if (d2, at2) == (d, at))
        assert all(len(x) == 1 for x in signature.values()) and len({min(x) for x in signature.values()}) == len(signature)


def brute_near(a, b, width, n=5):
    """Words of a and of b in windows with similarity 0.8 or more, over all pairs of windows; for texts that repeat no shingle."""
    import numpy as np

    ga, gb = (list(zip(*(w[i:] for i in range(n)), strict=False)) for w in (a, b))
    at = {g: i for i, g in enumerate(gb)}
    m = np.zeros((len(ga) + 1, len(gb) + 1), np.int32)
    for i, g in enumerate(ga):
        if g in at:
            m[i + 1, at[g] + 1] = 1
    m = m.cumsum(0).cumsum(1)
    common = m[width:, width:] - m[:-width, width:] - m[width:, :-width] + m[:-width, :-width]
    x, y = np.nonzero(100 * common >= 80 * (2 * width - common))
    size = width + n - 1
    return {i for s in set(x.tolist()) for i in range(s, s + size)}, {i for s in set(y.tolist()) for i in range(s, s + size)}


def test_passages_against_all_pairs_of_windows(spark):
    """500 texts: every passage of 50 words that is repeated word for word is found, and of near ones nine tenths of the words."""
    rng = random.Random(11)
    texts = []
    for k in range(50):
        passage = prose(rng.choice((50, 60, 90, 150)), 9000 + k).split()
        for j in range(10):
            w = [f"m{k}.{j}.{i}" if rng.random() < (0, 0.01, 0.02, 0.03)[k % 4] else x for i, x in enumerate(passage)]
            if k % 3 == 0:
                del w[rng.randrange(len(w))]
            texts.append(prose(rng.randrange(5, 40), 100_000 + 10 * k + j).split() + w + prose(rng.randrange(5, 40), 200_000 + 10 * k + j).split())
    exact, near = defaultdict(set), defaultdict(set)
    for k in range(0, 500, 10):
        for x in range(k, k + 10):
            for y in range(k, x):
                p, q = brute_near(texts[x], texts[y], 46)
                near[x] |= p
                near[y] |= q
                where = {tuple(texts[y][i : i + 50]): i for i in range(len(texts[y]) - 49)}
                for i in range(len(texts[x]) - 49):
                    j = where.get(tuple(texts[x][i : i + 50]))
                    if j is not None:
                        exact[x] |= set(range(i + 4, i + 46))  # ends are told to within four words
                        exact[y] |= set(range(j + 4, j + 46))
    rows = substring_dedup.repeated_passages(documents(spark, [" ".join(t) for t in texts])).collect()
    found, found_exact = defaultdict(set), defaultdict(set)
    for r in rows:
        found[r.doc_id] |= set(range(r.start, r.end))
        if r.kind == "exact":
            found_exact[r.doc_id] |= set(range(r.start, r.end))
    for x in range(500):
        assert exact[x] <= found_exact[x]
    for r in rows:  # nothing else is reported, but for runs of 46 to 49 words
        assert set(range(r.start, r.end)) <= near[r.doc_id] or (r.kind == "exact" and r.end - r.start < 50)
    total = sum(map(len, near.values()))
    assert total > 10_000 and sum(len(near[x] & found[x]) for x in near) >= 0.9 * total
    print("recall by words", sum(len(near[x] & found[x]) for x in near) / total)


def test_few_texts_are_moved_that_no_join_needs(spark):
    reps = spark.range(40_000).selectExpr("xxhash64(id) rep")
    some = reps.limit(4_000)
    for bits, most in ((1 << 26, 1_500), (1 << 12, 36_000)):  # a set that is too small lets more pass, and loses none
        passed = reps.where(substring_dedup._sieve(some, bits)("rep"))
        assert passed.join(some, "rep", "left_semi").count() == 4_000
        assert passed.count() - 4_000 <= most
    assert reps.where(substring_dedup._sieve(reps.limit(0))("rep")).count() == 0


def test_rows_of_one_id_and_different_texts_are_told_apart(spark):
    p = prose(60, 5)
    docs = documents(spark, [prose(70, 1) + " " + p, prose(20, 2) + " " + p, p]).selectExpr("if(doc_id < 2, 'x', 'y') doc_id", "text", "lang", "source", "n_chars", "n_words", "keep")
    rows = substring_dedup.repeated_passages(docs.unionAll(docs.where("doc_id = 'y'"))).collect()
    want = [("x", 20, 80), ("x", 70, 130), ("y", 0, 60)]
    for r, (doc, a, b) in zip(sorted(rows, key=lambda r: (r.doc_id, r.start)), want, strict=True):
        assert r.doc_id == doc and r.kind == "exact" and a <= r.start <= a + 4 and b - 4 <= r.end <= b
    assert len({r.class_id for r in rows}) == 1 and len({r.text_id for r in rows}) == 3
