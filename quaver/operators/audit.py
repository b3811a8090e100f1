"""Session audits: turn frames, sufficient statistics, rates, standardisation, samples with design weights, and weighted errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turn_frame(plays: DataFrame, artists: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Per turn: whether its artist is the previous turn's (same_adjacent), is one of all earlier turns' (same_cumulative), and the
    previous turn's same_cumulative (lagged). Null where either side has no artist. artists: item_id, artist.

    That an artist was heard before is whether its first turn is earlier, so no set grows along a session."""
    w = Window.partitionBy("session_id").orderBy("turn_number")
    p = plays.join(artists.select("item_id", "artist"), "item_id", "left")
    first = F.min("turn_number").over(Window.partitionBy("session_id", "artist"))
    known = F.max(F.col("artist").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("first", first).withColumn("known", F.coalesce(known, F.lit(0)))
    cumulative = F.when(F.col("artist").isNotNull() & (F.col("known") == 1), F.col("first") < F.col("turn_number"))
    before = F.lag("artist").over(w)
    p = p.withColumn("same_adjacent", F.when(F.col("artist").isNotNull() & before.isNotNull(), F.col("artist") == before)).withColumn("same_cumulative", cumulative)
    p = p.withColumn("lagged", F.lag("same_cumulative").over(w))
    return p.select("session_id", "turn_number", "item_id", "same_adjacent", "same_cumulative", "lagged")


def session_stats(frame: DataFrame, detectors: list[str], outcome: str = "progress") -> DataFrame:
    """Per session and detector: numbers of turns, flagged turns, repeats and progress among flagged and other turns. frame has the
    detectors' and outcome's boolean columns; turns without same_cumulative or outcome take no part."""
    f = frame.where(F.col("same_cumulative").isNotNull() & F.col(outcome).isNotNull())
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("detector"), F.col(d).alias("hit")) for d in detectors)))
    f = f.select("session_id", "same_cumulative", F.col(outcome).alias("good"), each.alias("x")).select("session_id", "same_cumulative", "good", "x.*")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    hit, same, good = F.col("hit"), F.col("same_cumulative"), F.col("good")
    return f.groupBy("session_id", "detector").agg(F.count("*").alias("n"), n(hit).alias("n_hit"), n(hit & same).alias("n_hit_same"), n(~hit & same).alias("n_other_same"), n(hit & good).alias("n_hit_good"), n(~hit & good).alias("n_other_good"), n(hit & same & good).alias("n_hit_same_good"))


def rates(stats: DataFrame, by: list[str]) -> DataFrame:
    """Rates and their gaps from totals; a rate of nothing is null."""
    t = stats.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "n_hit", "n_hit_same", "n_other_same", "n_hit_good", "n_other_good", "n_hit_same_good")))
    other = F.col("n") - F.col("n_hit")
    a, b = F.try_divide(F.col("n_hit_same"), F.col("n_hit")), F.try_divide(F.col("n_other_same"), other)
    g, h = F.try_divide(F.col("n_hit_good"), F.col("n_hit")), F.try_divide(F.col("n_other_good"), other)
    r = lambda c, n: F.round(c, 6).alias(n)
    return t.select(*by, "n", "n_hit", r(a, "same_if_hit"), r(b, "same_if_other"), r(a - b, "same_gap"), r(g, "good_if_hit"), r(h, "good_if_other"), r(g - h, "good_gap"), r(F.try_divide(F.col("n_hit_same_good"), F.col("n_hit_same")), "good_if_hit_same"))


def by_turn(frame: DataFrame, detectors: list[str]) -> DataFrame:
    """Per detector and turn: turns, flagged ones, and the repeat rates of both."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("detector"), F.col(d).alias("hit")) for d in detectors)))
    f = frame.where("same_cumulative is not null").select("turn_number", F.col("same_cumulative").cast("int").alias("same"), each.alias("x")).select("turn_number", "same", "x.*")
    return f.groupBy("detector", "turn_number").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("int")).alias("n_hit"), F.round(F.avg(F.when(F.col("hit"), F.col("same"))), 6).alias("same_if_hit"), F.round(F.avg(F.when(~F.col("hit"), F.col("same"))), 6).alias("same_if_other"))


def standardized(frame: DataFrame, detectors: list[str]) -> DataFrame:
    """Repeat rates of flagged and other turns weighted to the flagged turns' own distribution over turn numbers that both have."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("detector"), F.col(d).alias("hit")) for d in detectors)))
    f = frame.where("same_cumulative is not null").select("turn_number", F.col("same_cumulative").cast("int").alias("same"), each.alias("x")).select("turn_number", "same", "x.*")
    t = f.groupBy("detector", "turn_number").agg(F.sum(F.col("hit").cast("int")).alias("nh"), F.sum((~F.col("hit")).cast("int")).alias("no"), F.avg(F.when(F.col("hit"), F.col("same"))).alias("a"), F.avg(F.when(~F.col("hit"), F.col("same"))).alias("b")).where("nh > 0 and no > 0")
    s = t.groupBy("detector").agg(F.count("*").alias("turns"), F.sum("nh").alias("n"), (F.sum(F.col("nh") * F.col("a")) / F.sum("nh")).alias("a"), (F.sum(F.col("nh") * F.col("b")) / F.sum("nh")).alias("b"))
    return s.select("detector", "turns", "n", F.round("a", 6).alias("same_if_hit"), F.round("b", 6).alias("same_if_other"), F.round(F.col("a") - F.col("b"), 6).alias("difference"))


def stratified_sample(rows: DataFrame, stratum: Column, sizes: dict[str, int], key: str, seed: str) -> DataFrame:
    """Exactly sizes[s] rows of each stratum (all, if it has fewer), in the order of a seeded SHA-256 of the key, with N / n weights."""
    r = rows.withColumn("stratum", stratum).withColumn("drawn", F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256))
    total = r.groupBy("stratum").agg(F.count("*").alias("population"))
    w = Window.partitionBy("stratum").orderBy("drawn", key)
    size = F
    for s, n in sizes.items():
        size = size.when(F.col("stratum") == s, n)
    size = size.otherwise(0)
    picked = r.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= size).join(total, "stratum")
    return picked.withColumn("weight", F.round(F.col("population") / F.least(F.col("population"), size), 6)).drop("drawn")


def weighted_errors(rows: DataFrame, label: str, detectors: list[str], weight: str) -> DataFrame:
    """Per detector: weighted precision, recall and F1 against a label column of YES, NO and UNCERTAIN; the last are left out."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("detector"), F.col(d).alias("hit")) for d in detectors)))
    r = rows.where(F.col(label).isin("YES", "NO")).select((F.col(label) == "YES").alias("yes"), F.col(weight).alias("w"), each.alias("x")).select("yes", "w", "x.*")
    s = r.groupBy("detector").agg(*(F.sum(F.when(c, F.col("w")).otherwise(0.0)).alias(n) for n, c in (("tp", F.col("yes") & F.col("hit")), ("fp", ~F.col("yes") & F.col("hit")), ("fn", F.col("yes") & ~F.col("hit")))), F.count("*").alias("n"))
    p, q = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return s.select("detector", "n", F.round(p, 6).alias("precision"), F.round(q, 6).alias("recall"), F.round(F.try_divide(2 * p * q, p + q), 6).alias("f1"))


def error_rows(rows: DataFrame, label: str, detectors: list[str], keys: list[str]) -> DataFrame:
    """False positives and negatives of each detector."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("detector"), F.col(d).alias("hit")) for d in detectors)))
    r = rows.where(F.col(label).isin("YES", "NO")).select(*keys, (F.col(label) == "YES").alias("yes"), each.alias("x")).select(*keys, "yes", "x.*")
    return r.where("yes <> hit").select(*keys, "detector", F.when(F.col("hit"), "false_positive").otherwise("false_negative").alias("error"))


def integrity(form: DataFrame, manifest: DataFrame, key: str, allowed: list[str], text: str) -> DataFrame:
    """Rows of key and problem: not in the other table, repeated, a label not allowed, or a text whose SHA-256 is not the manifest's."""
    told = lambda d, what: d.select(F.col(key).cast("string").alias("key"), F.lit(what).alias("problem"))
    out = told(form.join(manifest, key, "left_anti"), "not in manifest").unionAll(told(manifest.join(form, key, "left_anti"), "not in form"))
    out = out.unionAll(told(form.groupBy(key).count().where("count > 1"), "repeated")).unionAll(told(form.where(~F.coalesce(F.col("label").isin(allowed), F.lit(False))), "label"))
    both = form.select(key, F.sha2(text, 256).alias("now")).join(manifest.select(key, "sha256"), key)
    return out.unionAll(told(both.where(~F.col("now").eqNullSafe(F.col("sha256"))), "changed text"))


def design(frame: DataFrame, x: list[str], y: str, cluster: str) -> DataFrame:
    return frame.select(F.array(*(F.col(c).cast("double") for c in x)).alias("x"), F.col(y).cast("double").alias("y"), F.col(cluster).cast("string").alias("g"))


def cluster_logistic(frame: DataFrame, x: list[str], y: str, cluster: str, most: int = 100, tolerance: float = 1e-10):
    """Logistic regression by iteratively reweighted least squares with cluster-robust errors: rows (term, beta, se, odds, p).

    Every step is one aggregate of K * (K + 1) / 2 + K sums; only those reach the driver. Errors come from one sum a cluster."""
    import math

    import numpy as np

    d = design(frame, x, y, cluster).where(F.col("y").isNotNull()).persist()
    k = len(x)
    beta = np.zeros(k)
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def eta(b) -> Column:
        e = F.lit(0.0)
        for i in range(k):
            e = e + F.col("x")[i] * float(b[i])
        return F.greatest(F.least(e, F.lit(35.0)), F.lit(-35.0))

    for _ in range(most):
        p = 1 / (1 + F.exp(-eta(beta)))
        s = d.withColumn("p", p).withColumn("w", F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-12)))
        row = s.agg(*(F.sum(F.col("x")[i] * F.col("x")[j] * F.col("w")) for i, j in upper), *(F.sum(F.col("x")[i] * (F.col("y") - F.col("p"))) for i in range(k))).first()
        info = np.zeros((k, k))
        for (i, j), v in zip(upper, row, strict=False):
            info[i, j] = info[j, i] = v
        step = np.linalg.solve(info, np.array(row[len(upper) :], float))
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    s = d.withColumn("r", F.col("y") - 1 / (1 + F.exp(-eta(beta))))
    per = s.groupBy("g").agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i] * F.col("r")).alias(f"s{i}") for i in range(k)))
    row = per.agg(F.count("*"), F.sum("n"), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i, j in upper)).first()
    d.unpersist()
    groups, n = row[0], row[1]
    meat = np.zeros((k, k))
    for (i, j), v in zip(upper, row[2:], strict=True):
        meat[i, j] = meat[j, i] = v
    bread = np.linalg.inv(info)
    cov = bread @ meat @ bread * (groups / max(1, groups - 1)) * ((n - 1) / max(1, n - k))
    se = np.sqrt(np.diag(cov))
    rows = [(t, float(round(b, 6)), float(round(e, 6)), float(round(math.exp(b), 6)), float(round(math.erfc(abs(b / e) / math.sqrt(2)), 6))) for t, b, e in zip(x, beta, se, strict=True)]
    return frame.sparkSession.createDataFrame(rows, "term string, beta double, se double, odds double, p double")


def resample(seed: str, cluster: Column, replicate: Column) -> Column:
    """A Poisson(1) count from the MD5 of seed, cluster and replicate: the same wherever and whenever it is asked for."""
    return poisson(uniform(seed, cluster, replicate))


def uniform(seed: str, cluster: Column, replicate: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), cluster.cast("string"), replicate.cast("string"))), 1, 10), 16, 10).cast("double") / F.lit(float(1 << 40))


def poisson(u: Column) -> Column:
    total, p, count = 0.0, 0.36787944117144233, F.lit(0)
    for i in range(8):  # its cumulative probabilities
        total += p
        count = count + F.when(u >= total, 1).otherwise(0)
        p /= i + 1
    return count


def _interval(per: DataFrame, by: list[str], value: str) -> DataFrame:
    q = per.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("replicates"), F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return q.select(*by, "replicates", F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


def _replicated(stats: DataFrame, cluster: str, replicates: int, seed: str) -> DataFrame:
    """The hash is unfolded with the replicate: computed after it, the filter and each comparison would compute it again."""
    drawn = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda i: F.struct(i.alias("replicate"), uniform(seed, F.col(cluster), i).alias("u")))
    r = stats.withColumn("drawn", F.explode(drawn)).select(*stats.columns, "drawn.*")
    return r.withColumn("k", poisson(F.col("u"))).where("k > 0").drop("u")


def bootstrap(stats: DataFrame, cluster: str, by: list[str], ratio: tuple[str, str], replicates: int = 500, seed: str = "b") -> DataFrame:
    """Per group: a ratio of sums, and its 2.5 and 97.5 percentiles over cluster resamples.

    Each cluster has a Poisson(1) weight in each replicate, from a hash: rows are reweighted where they are, so a group of any size is
    spread over tasks, and results repeat. At a thousand clusters this is the multinomial resample to within its own noise."""
    top, bottom = ratio
    point = stats.groupBy(*by).agg(F.round(F.try_divide(F.sum(top), F.sum(bottom)), 6).alias("estimate"))
    per = _replicated(stats, cluster, replicates, seed).groupBy(*by, "replicate").agg(F.try_divide(F.sum(F.col(top) * F.col("k")), F.sum(F.col(bottom) * F.col("k"))).alias("v"))
    return point.join(_interval(per, by, "v"), by).select(*by, "estimate", "replicates", "low", "high")


def standardized_bootstrap(frame: DataFrame, detectors: list[str], replicates: int = 200, seed: str = "t") -> DataFrame:
    """The standardised difference of repeat rates with its interval over session resamples. The turns compared and their weights are
    those of the whole sample; a replicate where either side of a turn has no weight is left out."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("detector"), F.col(d).alias("hit")) for d in detectors)))
    f = frame.where("same_cumulative is not null").select("session_id", "turn_number", F.col("same_cumulative").cast("int").alias("same"), each.alias("x")).select("session_id", "turn_number", "same", "x.*")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    stats = f.groupBy("session_id", "detector", "turn_number").agg(n(F.col("hit")).alias("nh"), n(F.col("hit") & (F.col("same") == 1)).alias("sh"), n(~F.col("hit")).alias("no"), n(~F.col("hit") & (F.col("same") == 1)).alias("so"))
    t = stats.groupBy("detector", "turn_number").agg(*(F.sum(c).alias(f"t_{c}") for c in ("nh", "sh", "no", "so"))).where("t_nh > 0 and t_no > 0")
    point = t.groupBy("detector").agg(F.count("*").alias("turns"), F.sum("t_nh").alias("n"), F.round(F.sum(F.col("t_nh") * (F.col("t_sh") / F.col("t_nh") - F.col("t_so") / F.col("t_no"))) / F.sum("t_nh"), 6).alias("difference"))
    r = _replicated(stats.join(t.select("detector", "turn_number"), ["detector", "turn_number"], "left_semi"), "session_id", replicates, seed)
    sums = r.groupBy("detector", "replicate", "turn_number").agg(*(F.sum(F.col(c) * F.col("k")).alias(c) for c in ("nh", "sh", "no", "so")))
    rate = F.try_divide(F.col("sh"), F.col("nh")) - F.try_divide(F.col("so"), F.col("no"))
    per = sums.join(t.select("detector", "turn_number", "t_nh"), ["detector", "turn_number"]).withColumn("d", rate).groupBy("detector", "replicate")
    per = per.agg(F.count("d").alias("have"), (F.sum(F.col("t_nh") * F.col("d")) / F.sum("t_nh")).alias("v")).join(point.select("detector", "turns"), "detector").where("have = turns")
    return point.join(_interval(per, ["detector"], "v"), "detector").select("detector", "turns", "n", "difference", "replicates", "low", "high")


def stratified_bootstrap(judged: DataFrame, label: str, detectors: list[str], stratum: str, population: str, cluster: str, replicates: int = 200, seed: str = "s") -> DataFrame:
    """Precision, recall and F1 of detectors with intervals: clusters are resampled over all strata alike, and in each replicate the rows of a
    stratum share its population anew. Replicates in which a stratum has no row are left out. judged: label YES or NO, detectors' flags."""
    rows = judged.where(F.col(label).isin("YES", "NO")).select(F.col(cluster).alias("g"), F.col(stratum).alias("stratum"), F.col(population).cast("double").alias("population"), (F.col(label) == "YES").alias("yes"), *(F.col(d).alias(f"hit_{i}") for i, d in enumerate(detectors)))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    yes, counts = F.col("yes"), ["tp", "fp", "fn"]
    counted = lambda i, hit: [n(hit & yes).alias(f"tp_{i}"), n(hit & ~yes).alias(f"fp_{i}"), n(~hit & yes).alias(f"fn_{i}")]
    # detectors stay side by side until replicates are summed: a cluster's weight is drawn once for all of them
    stats = rows.groupBy("g", "stratum", "population").agg(F.count("*").alias("n"), *(c for i in range(len(detectors)) for c in counted(i, F.col(f"hit_{i}"))))
    wide = ["n", *(f"{c}_{i}" for i in range(len(detectors)) for c in counts)]

    def by_detector(sums: DataFrame, by: list[str]) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(d).alias("detector"), *(F.col(f"{c}_{i}").alias(c) for c in counts)) for i, d in enumerate(detectors))))
        return sums.select(*by, "n", each.alias("x")).select(*by, "n", "x.*")

    strata = rows.select("stratum").distinct().agg(F.count("*").alias("strata"))

    def measures(sums: DataFrame, by: list[str]) -> DataFrame:
        """sums: by, stratum, population, n, tp, fp, fn."""
        w = F.col("population") / F.col("n")
        t = sums.groupBy(*by).agg(F.count("*").alias("have"), *(F.sum(w * F.col(c)).alias(c) for c in ("tp", "fp", "fn")))
        p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
        f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
        told = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in (("precision", p), ("recall", r), ("f1", f1)))))
        return t.select(*by, "have", told.alias("m")).select(*by, "have", "m.*")

    per_stratum = ["stratum", "population"]
    point = measures(by_detector(stats.groupBy(*per_stratum).agg(*(F.sum(c).alias(c) for c in wide)), per_stratum), ["detector"]).select("detector", "measure", F.round("v", 6).alias("estimate"))
    r = _replicated(stats, "g", replicates, seed).groupBy("replicate", *per_stratum).agg(*(F.sum(F.col(c) * F.col("k")).alias(c) for c in wide))
    per = measures(by_detector(r, ["replicate", *per_stratum]), ["detector", "replicate"]).crossJoin(F.broadcast(strata)).where("have = strata")
    return point.join(_interval(per, ["detector", "measure"], "v"), ["detector", "measure"]).select("detector", "measure", "estimate", "replicates", "low", "high")
