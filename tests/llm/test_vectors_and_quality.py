"""Centroid clustering, whitening and quality rules against brute force, and on awkward rows."""

import collections
import hashlib
import math
import re

import numpy as np
from pyspark.sql import functions as F

from claimloom.llm import centroid_clustering, quality_rules, whitening

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, kind="float"):
    """Vectors with extra columns whose names the operators use themselves."""
    table = [(i, v, "x", 3, 4) for i, v in rows]
    return spark.createDataFrame(table, f"vec_id long, embedding array<{kind}>, x string, cluster int, y int")


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


# --- clustering -----------------------------------------------------------------------------------------------


def brute_clusters(rows, size, clusters, rounds):
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(64 * c))) for c in v]) for i, v in rows if usable(v) and len(v) == size]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] is not None and hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:clusters]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, x in kept:
            members[near(x)[1]].append(x)
        centroids = [[sum(c) // len(members[k]) for c in zip(*members[k])] if members[k] else old for k, old in enumerate(centroids)]
    found = [(i, *near(x)) for i, x in kept]
    inertia = collections.Counter()
    for _, d, k in found:
        inertia[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return collections.Counter((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for i, d, k in found)


def test_clusters_match_brute_force(spark):
    random = np.random.default_rng(1)
    hot = random.normal(size=64).tolist()
    rows = [(i, random.normal(size=64).tolist()) for i in range(120)] + [(200 + i, hot) for i in range(60)] + [(7, hot), (7, [0.5] * 64), (None, hot)]
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [NAN] * 64), (305, [INF] + [0.0] * 63), (306, [None] + [0.0] * 63), (307, [-1.0] * 64), (308, [1e300] + [0.0] * 63)]
    for size, rounds in ((16, 3), (5, 1)):
        got = centroid_clustering.cluster(vectors(spark, rows, "double"), clusters=size, rounds=rounds).collect()
        assert collections.Counter(tuple(r) for r in got) == brute_clusters(rows, 64, size, rounds)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, [-0.1, 5.0])]
    got = centroid_clustering.cluster(vectors(spark, rows), size=2).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_clusters([(i, [float(np.float32(c)) for c in v]) for i, v in rows], 2, 16, 3)
    assert {r.inertia for r in got} == {0}
    empty = centroid_clustering.cluster(vectors(spark, rows).filter("false"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroid_clustering.cluster(vectors(spark, [(1, None), (2, [1.0])])).count() == 0


def test_ties_and_empty_clusters(spark):
    table = spark.createDataFrame([(1, [0, 0]), (2, [4, -3])], "vec_id long, x array<int>")
    centroids = [[0, 0], [0, 0], [9, 9]]
    found = table.select(centroid_clustering.nearest(F.col("x"), centroids).alias("n")).collect()
    assert [(r.n.cluster, r.n.distance) for r in found] == [(0, 0), (0, 25)]
    assert centroid_clustering.moved_centroids(table, centroids) == [[2, -2], [0, 0], [9, 9]]


def test_clustering_is_native(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", centroid_clustering.integers(F.col("embedding")).alias("x"))
    centroids = centroid_clustering.first_centroids(table)
    plan = table.select(centroid_clustering.nearest(F.col("x"), centroids))._jdf.queryExecution().toString()
    assert "zip" in plan.lower() and not re.search("Python|Pandas|Arrow|Cartesian|Join", plan)
    assert len(centroid_clustering.moved_centroids(table, centroids)) == 16


# --- whitening ------------------------------------------------------------------------------------------------


def test_scatter_is_exact():
    random = np.random.default_rng(2)
    for low, high, rows in ((-50, 70, 300), (10**6, 10**6 + 1, 65), (-(2**40), 2**40, 64), (-(2**61), 2**61, 5), (3, 4, 1)):
        y = random.integers(low, high, size=(rows, 6))
        y[:, 2] = y[0, 2]
        sums, cross = whitening.scatter(y)
        big = y.astype(object)
        assert sums.tolist() == big.sum(axis=0).tolist() and cross.tolist() == (big.T @ big).tolist()


def check_whitening(got, rows, dim, components=16):
    kept = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if v and usable(v) and len(v) == dim]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums)
    covariance = (centred.T @ centred / n**3).astype(float)
    values = np.linalg.eigvalsh(covariance)[::-1]
    k = max(r.component for r in got)
    assert k == min(components, int((values > 1e-9 * values[0]).sum())) and len(got) == k * len(kept)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-4
    for r in got:
        assert abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-4 * r.explained
    by = collections.defaultdict(dict)
    for r in got:
        by[r.vec_id, r.deviation].setdefault(r.component, []).append(r.whitened)
    want = collections.Counter()
    for i, x in kept:
        want[i, sum((n * a - s) ** 2 for a, s in zip(x, sums))] += 1
    assert want == collections.Counter({key: len(v[1]) for key, v in by.items()})
    # Squared whitened lengths do not depend on signs or on the base of equal eigenvalues.
    if k == dim:
        inverse = np.linalg.inv(covariance)
        for i, x in kept:
            d = (np.array(x, dtype=object) - np.array([s / n for s in sums])).astype(float)
            mine = by[i, sum((n * a - s) ** 2 for a, s in zip(x, sums))]
            assert math.isclose(sum(v[0] ** 2 for v in mine.values()), d @ inverse @ d, rel_tol=1e-6)


def test_whitening_matches_brute_force(spark):
    random = np.random.default_rng(4)
    mix = random.normal(size=(8, 8)) * np.geomspace(1, 0.2, 8)
    rows = [(i, (random.normal(size=8) @ mix + 40).tolist()) for i in range(150)]
    rows += [(500 + i, rows[0][1]) for i in range(70)] + [(3, rows[5][1]), (3, rows[3][1]), (None, rows[4][1])]
    awkward = [(300, None), (301, []), (302, [1.0] * 7), (304, [NAN] * 8), (305, [INF] + [0.0] * 7), (306, [None] + [0.0] * 7)]
    got = whitening.whiten(vectors(spark, rows + awkward, "double")).collect()
    check_whitening(got, rows, 8)
    assert {r.vec_id for r in got} == {i for i, _ in rows}


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check_whitening(whitening.query(spark, SF).collect(), rows, 64)


def test_whitening_without_variance(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitening.whiten(vectors(spark, rows))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    line = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])])).collect()
    assert {r.component for r in line} == {1} and math.isclose(line[0].explained, 1.0)
    wide = whitening.whiten(vectors(spark, [(i, [1e15 * i, -1e15 * i * i]) for i in range(4)], "double")).collect()
    assert len(wide) == 8 and all(r.deviation is None for r in wide)


# --- quality rules --------------------------------------------------------------------------------------------

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, kept string, g0 int, salt int, n_words int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "k", 1, 2, 3) for i, t, lang, s in rows], DOCS)


def brute_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    count = lambda chars: sum(text.count(c) for c in chars)
    return (len(words), sum(map(len, words)), count("#*$%&|<>"), len(lines) - len(set(lines)), len(covered), count("!?"), count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), len(lines))


def test_counts_match_brute_force(spark):
    prose = " ".join(f"w{i % 9}" for i in range(300))
    rows = [(1, prose), (2, None), (3, ""), (4, " \t\n "), (5, "a\nb\na\n\na "), (6, "ünï çod€ \U0001f642!?"), (7, "a b c d e f g h " * 2), (8, "a b c d e f g " * 3), (9, "\n\nx\n"), (None, "ABC #$% | x"),
            (5, "a\nb\na\n\na "), (10, "x" * 3_000_000 + "\n" + "y z " * 20_000), (11, "a\r\na\r\nb\va\f")]
    docs = docs_frame(spark, [(i, t, "en", "s") for i, t in rows])
    names = quality_rules.COUNTS
    got = collections.Counter((r.doc_id, *(r[c] for c in names)) for r in quality_rules.measures(docs).collect())
    assert got == collections.Counter((i, *brute_counts(t)) for i, t in rows)
    real = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r[c] for c in names) for r in quality_rules.measures(real).collect()}
    assert got == {r.doc_id: brute_counts(r.text) for r in real.collect()}


def test_sketches_merge_and_bound_quantiles(spark):
    random = np.random.default_rng(6)
    values = [(k, int(v)) for k in ("a", "b", None) for v in random.lognormal(5, 2, size=400)] + [("a", 0)] * 100
    table = spark.createDataFrame(values, "g string, value long")
    parts = [quality_rules.sketch(p, ["g"], {"m": F.col("value")}) for p in table.randomSplit([0.3, 0.7], 1)]
    whole = quality_rules.sketch(table, ["g"], {"m": F.col("value")})
    joined = quality_rules.merged(parts[0].unionByName(parts[1]), ["g"])
    key = lambda df: sorted(map(tuple, df.select("g", "measure", "low", "n").collect()), key=str)
    assert key(joined) == key(whole)
    for r in quality_rules.quartiles(whole, ["g"]).collect():
        mine = sorted(v for k, v in values if k == r.g)
        for q in (25, 50, 75):
            exact = mine[-(-len(mine) * q // 100) - 1]
            assert r[f"q{q}"] <= exact <= r[f"q{q}"] * (1 + 2.0 ** (1 - quality_rules.BITS))
    top = quality_rules.quartiles(quality_rules.merged(whole, []), []).first()
    assert top.docs == len(values)


def test_rules_follow_their_group(spark):
    """A source that writes in capitals sets its own fence; the same text elsewhere falls."""
    body = lambda k, up: " ".join((f"Word{(i * 7 + k) % 97}" if not up else f"WORD{(i * 7 + k) % 97}") for i in range(60))
    rows = [(k, body(k, True), "en", "loud") for k in range(250)] + [(1000 + k, body(k, False), "en", "calm") for k in range(250)]
    rows += [(5000, body(5, True), "en", "calm"), (5001, body(5, False), "en", "loud"), (5002, body(6, False), None, None), (5003, None, "en", None), (5004, "short text", "en", "calm"), (None, body(3, False), "en", "calm"), (5005, "a b c " * 50, "en", "calm")]
    got = {r.doc_id: r for r in quality_rules.judge(docs_frame(spark, rows)).collect()}
    assert len(got) == len(rows) and all(got[k].kept for k in (*range(250), *range(1000, 1250), 5001, 5002, None))
    assert got[5000].failed == ["capitals"] and not got[5000].kept and not got[5000].base_failed
    assert all(got[k].base_failed and not got[k].kept for k in (5003, 5004, 5005))
    assert quality_rules.judge(docs_frame(spark, [])).count() == 0


def test_quality_labels(spark):
    """Most documents labelled poor go, nearly all others of enough words stay."""
    table = quality_rules.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = table.filter("n_words >= 20").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[0] < 0.1 and kept[1] > 0.97
