"""Boosting against plain numpy, and running sums and quantiles under skew."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from railbird.operators import boosting, decisions
from railbird.operators.prefix import prefix_sums, quantiles, ranged


def plain(x, y, edges, rounds, rate, depth, least):
    """Boosting row by row of the definition, on values instead of bins and in floats."""
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    trees = []

    def grow(rows, level, g, h):
        best = (1e-12, None)
        if level < depth:
            for f, cuts in enumerate(edges):
                for c in cuts:
                    left = x[rows, f] <= c
                    if left.sum() < least or (~left).sum() < least:
                        continue
                    gl, hl, gr, hr = g[rows][left].sum(), h[rows][left].sum(), g[rows][~left].sum(), h[rows][~left].sum()
                    gain = gl**2 / hl + gr**2 / hr - (gl + gr) ** 2 / (hl + hr)
                    if gain > best[0] + 1e-7:
                        best = (gain, (f, c))
        if best[1] is None:
            return -rate * g[rows].sum() / h[rows].sum()
        f, c = best[1]
        return f, c, grow(rows[x[rows, f] <= c], level + 1, g, h), grow(rows[x[rows, f] > c], level + 1, g, h)

    def value(t, r):
        while isinstance(t, tuple):
            t = t[2] if r[t[0]] <= t[1] else t[3]
        return t

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        t = grow(np.arange(len(y)), 0, p - y, p * (1 - p))
        trees.append(t)
        raw = raw + np.array([value(t, r) for r in x])
    return raw, trees, value


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=2000), rng.integers(0, 4, 2000), rng.exponential(size=2000), rng.integers(0, 2, 2000)])
    y = (np.sin(2 * x[:, 0]) + (x[:, 1] == 2) * x[:, 2] + rng.normal(size=2000) * 0.5 > 0.4).astype(int)
    return x, y, rng.integers(0, 3, 2000)


def frame(spark, data):
    x, y, fold = data
    rows = [(i, [float(v) for v in r], int(t), int(k)) for i, (r, t, k) in enumerate(zip(x, y, fold, strict=True))]
    return spark.createDataFrame(rows, "id long, v array<double>, y int, fold int").repartition(5)


def test_equals_plain_boosting(spark, data, monkeypatch):
    """Every fold's model and a smaller feature set, over two refreshes, and rows that it did not see."""
    monkeypatch.setattr(boosting, "REFRESH", 4)
    monkeypatch.setattr(boosting, "BLOCK", 300)
    x, y, fold = data
    edges = [np.quantile(x[:, 0], np.linspace(0.1, 0.9, 9)), np.array([0.0, 1.0, 2.0]), np.quantile(x[:, 2], [0.2, 0.4, 0.6, 0.8]), np.array([0.0])]
    d = frame(spark, data)
    sets = {"all": (0, 1, 2, 3), "few": (0, 3)}
    b = boosting.fit(d, "v", "y", "fold", 4, [(k, s) for s in sets.values() for k in range(3)], rounds=10, rate=0.1, edges=edges)
    got = {(r.id, r.features): r.p for r in boosting.score(d, "v", "fold", b, ["id"], [n for n in sets for _ in range(3)]).collect()}
    for name, use in sets.items():
        for k in range(3):
            train = fold != k
            own = [e if f in use else [] for f, e in enumerate(edges)]
            _, trees, value = plain(x[train], y[train], own, 10, 0.1, 3, boosting.LEAST)
            start = np.log(y[train].mean() / (1 - y[train].mean()))
            for i in np.flatnonzero(~train)[:150]:
                want = 1 / (1 + np.exp(-(start + sum(value(t, x[i]) for t in trees))))
                assert got[i, name] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("heavy", [2**24, 50])
def test_few_different_rows_are_one_job_with_the_same_trees(spark, data, monkeypatch, heavy):
    """900 jobs a model took too long; rows that repeat count as often as they are there, and trees are those of a job a level."""
    monkeypatch.setattr(boosting, "HEAVY", heavy)
    d = frame(spark, data)
    d = d.unionByName(d.filter("id % 3 = 0")).unionByName(d.filter("id < 2").withColumn("z", F.explode(F.sequence(F.lit(1), F.lit(70)))).drop("z"))
    models = [(0, (0, 1, 2, 3)), (1, (0, 3)), (None, (0, 1, 2, 3))]
    store = spark._jsparkSession.sparkContext().statusStore()
    jobs = lambda: store.jobsList(None).size()
    before = jobs()
    one = boosting.fit(d, "v", "y", "fold", 4, models, rounds=20)
    assert jobs() - before < 20
    monkeypatch.setattr(boosting, "LOCAL", 0)
    many = boosting.fit(d, "v", "y", "fold", 4, models, rounds=20, edges=one.edges)
    for a, b in zip(one.models, many.models, strict=True):
        assert len(a.trees) == len(b.trees) == 20
        for s, t in zip(a.trees, b.trees, strict=True):
            assert all((p == q).all() for p, q in zip(s, t, strict=True))


def test_trees_do_not_depend_on_the_partitions(spark, data, monkeypatch):
    d = frame(spark, data)
    one = boosting.fit(d, "v", "y", "fold", 4, [(0, (0, 1, 2, 3))], rounds=5)
    monkeypatch.setattr(boosting, "TASKS", 2)  # sums meet in groups of tasks
    monkeypatch.setattr(boosting, "BLOCK", 100)
    two = boosting.fit(d.repartition(3, "y"), "v", "y", "fold", 4, [(0, (0, 1, 2, 3))], rounds=5, edges=one.edges)
    for s, t in zip(one.models[0].trees, two.models[0].trees, strict=True):
        assert all((a == b).all() for a, b in zip(s, t, strict=True))


def test_edges_of_bins(spark):
    rows = [([float(i % 3), float(i), 5.0],) for i in range(5000)]
    e = boosting.bin_edges(spark.createDataFrame(rows, "v array<double>"), "v", 3)
    assert e[0].tolist() == [0.0, 1.0] and len(e[1]) == 254 and len(e[2]) == 0
    assert np.abs(np.bincount(boosting.binned(np.array(rows)[:, 0], e)[1]) - 5000 / 255).max() < 3
    assert boosting.binned(np.array([[np.nan, np.inf, -1.0]]), e)[:, 0].tolist() == [2, 254, 0]


def test_one_label_and_no_rows(spark, data):
    x, y, fold = data
    d = frame(spark, (x, np.ones_like(y), fold))
    b = boosting.fit(d, "v", "y", "fold", 4, [(0, (0, 1))], rounds=2)
    assert {r.p for r in boosting.score(d, "v", "fold", b, ["id"]).collect()} == {1.0, None}
    b = boosting.fit(d.limit(0), "v", "y", "fold", 4, [(0, (0, 1))], rounds=2)
    assert boosting.score(d.limit(0), "v", "fold", b, ["id"]).count() == 0


def test_importance_equals_scoring_every_row_anew(spark):
    from test_operators import planted

    d = planted(spark)
    got = {r.feature: r["drop"] for r in decisions.permutation_importance(d, ["u", "v", "w"], repeats=2, rounds=20).collect()}
    a, n = decisions._with_array(d)
    b = boosting.fit(a, "v", "y", "fold", n, [(0, (0, 1, 2))], 20)
    rows = a.filter("fold = 0").select(F.xxhash64("hand_id", "action_index").alias("r"), "y", "v").collect()
    auc = lambda p, y: np.mean([(s > t) + 0.5 * (s == t) for s in p[y == 1] for t in p[y == 0]])
    x, y, rid = np.array([r.v for r in rows]), np.array([r.y for r in rows]), np.array([r.r for r in rows])
    score = lambda z: np.round(boosting.probability(b.models[0].raw(b.binned(z))), 6)
    for i, name in enumerate(["u", "v", "w"]):
        drops = []
        for k in range(2):
            h = {r.r: r.h for r in spark.createDataFrame([(int(v),) for v in rid], "r long").select("r", F.xxhash64("r", F.lit(103 + k)).alias("h")).collect()}
            one, two = np.argsort(rid), np.array(sorted(range(len(rid)), key=lambda j: (h[rid[j]], rid[j])))
            z = x.copy()
            z[one, i] = x[two, i]
            drops.append(auc(score(x), y) - auc(score(z), y))
        assert got[name] == pytest.approx(np.mean(drops), abs=2e-6)


def test_ranks_with_one_far_score(spark):
    """Equal widths would put all but one score into one task."""
    d = spark.range(200_000).select((F.col("id") * 1.0).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y")).unionByName(spark.createDataFrame([(1e12, 1)], "s double, y int"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in ranged(d, "s").groupBy("_part").count().collect()]
        assert len(sizes) == 4 and max(sizes) <= 2 * np.mean(sizes)
        r = decisions.auc(d, F.col("y"), "s").first()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    y = np.append(np.arange(200_000) % 3 == 0, True)
    pos = y.sum()
    assert r.roc_auc == pytest.approx((np.flatnonzero(y).sum() + pos - pos * (pos + 1) / 2) / (pos * (len(y) - pos)), abs=1e-6)


def test_prefix_sums(spark):
    rows = [(k, i, i % 5) for k in (None, "a", "b") for i in range(40 if k else 3)]
    got = {(r.k, r.i): (r.before_c, r.total_c) for r in prefix_sums(spark.createDataFrame(rows, "k string, i int, c long").repartition(6), ["k"], [F.desc("i")], ["c"]).collect()}
    for k, i, _ in rows:
        mine = [(j, c) for x, j, c in rows if x == k]
        assert got[k, i] == (sum(c for j, c in mine if j > i), sum(c for _, c in mine))


def test_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in np.round(rng.normal(size=300), 1)] + [("b", 7.5)] + [("c", None)] * 3 + [(None, float(v)) for v in rng.normal(size=10)] + [("a", None), ("d", 1e12), ("d", -3.0)] + [("e", 2.0)] * 50
    d = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "top": 1.0, "low": 0.0}
    got = {r.k: r[1:] for r in quantiles(d, ["k"], "v", shares).collect()}
    want = {r.k: tuple(r.q) if r.q else (None,) * 5 for r in d.groupBy("k").agg(F.percentile("v", list(shares.values())).alias("q")).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12) if v[0] is not None else got[k] == v
    assert quantiles(d, [], "v", {"m": 0.5}).first().m == pytest.approx(d.agg(F.percentile("v", 0.5)).first()[0], rel=1e-12)
    assert quantiles(d.limit(0), [], "v", {"m": 0.5}).collect()[0].m is None


def test_importance_is_fitted_in_one_job(spark, monkeypatch):
    """held-out rows are scored by trees that come of one job, and the drop of a planted feature is seen."""
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(5)
    rows = [(str(i), 0, float(a), float(b), int(a > 0), i % 5) for i, (a, b) in enumerate(rng.normal(size=(1500, 2)))]
    d = spark.createDataFrame(rows, "hand_id string, action_index long, a double, b double, y int, fold int").withColumn("x", array_to_vector(F.array("a", "b")))
    seen, grown = [], boosting._grown
    monkeypatch.setattr(boosting, "_grown", lambda *a: seen.append(a[3]) or grown(*a))
    drop = {r.feature: r["drop"] for r in decisions.permutation_importance(d, ["a", "b"], repeats=2, rounds=20).collect()}
    assert seen == [1] and drop["a"] > 0.3 and abs(drop["b"]) < 0.05
