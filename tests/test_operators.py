"""Operators on small hand-written tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from railbird.operators import decisions, metrics, outliers, sequence, sessions

ACT = "hand_id string, action_index long, street string, player_name string, action_type string, amount long, bb long"


def acts(spark, *rows):
    return spark.createDataFrame([("h", i, s, p, t, a, 50) for i, (s, p, t, a) in enumerate(rows)], ACT)


def test_squeeze_and_four_bets(spark):
    a = acts(spark, ("preflop", "A", "raise", 150), ("preflop", "B", "call", 150), ("preflop", "C", "raise", 600), ("preflop", "A", "raise", 1500), ("preflop", "C", "fold", 0))
    f = {r.player_name: r for r in sequence.player_first(a).collect()}
    assert f["C"].raises_before == 1 and not f["C"].is_folded_to and f["A"].is_folded_to
    r = {x.player_name: x for x in sequence.response_after_event(a).collect()}
    assert r["A"].vs_3bet == "raise" and r["C"].vs_4bet == "fold"


def test_limp_then_raise_is_not_folded_to(spark):
    a = acts(spark, ("preflop", "A", "call", 50), ("preflop", "B", "raise", 200))
    b = {r.player_name: r for r in sequence.player_first(a).collect()}["B"]
    assert b.raises_before == 0 and not b.is_folded_to


def test_window_forms_equal_join_forms(spark):
    rng = np.random.default_rng(0)
    rows = [(str(h), i, str(rng.choice(["preflop", "flop"])), str(rng.choice(list("ABC"))), str(rng.choice(["fold", "check", "call", "bet", "raise"])), int(rng.integers(0, 3)) * 50, 50) for h in range(60) for i in range(12)]
    df = spark.createDataFrame(rows, ACT)
    df.createOrReplaceTempView("acts")
    got = {(r.hand_id, r.street, r.player_name): (r.opp, r.hit) for r in sequence.check_then_raise(df).collect()}
    want = {}
    for h, s, p in {(r[0], r[2], r[3]) for r in rows if r[2] == "flop" and r[4] == "check"}:
        here = [r for r in rows if r[0] == h and r[2] == s]
        c = min(r[1] for r in here if r[3] == p and r[4] == "check")
        opp = any(r[1] > c and r[4] == "bet" and r[3] != p for r in here)
        want[h, s, p] = (opp, opp and any(r[1] > c and r[4] == "raise" and r[3] == p for r in here))
    assert got == want
    first = {(r.hand_id, r.player_name): (r.action_index, r.raises_before, r.is_folded_to) for r in sequence.player_first(df).collect()}
    for (h, p), v in first.items():
        pre = [r for r in rows if r[0] == h and r[2] == "preflop"]
        i = min(r[1] for r in pre if r[3] == p)
        assert v == (i, sum(r[1] < i and r[4] == "raise" and r[5] > 50 for r in pre), not any(r[1] < i and r[4] in ("call", "raise", "bet") for r in pre))


def test_rates_of_sums(spark):
    s = spark.createDataFrame([("X", 10, 5, 2, 1, 4, 100, 50), ("X", 90, 9, 3, 0, 6, -100, 50)], "dataset string, player_hands long, vpip_count long, pfr_count long, three_bets long, three_bet_opps long, net_won long, bb long")
    r = metrics.recombine(s, "dataset").first()
    assert r.vpip_pct == 14.0 and r.three_bet_pct == 10.0 and r.bb100 == 0.0


def test_one_session_for_equal_times(spark):
    e = spark.createDataFrame([("d", 2014, "P", t, ts, i) for i, (t, ts) in enumerate([("a", "2014-01-01 00:00:00"), ("a", "2014-01-01 05:00:00"), ("b", "2014-01-01 05:00:00")])], "dataset string, year int, player_name string, table_name string, timestamp string, hand_id int")
    s = sessions.player_sessions(e.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")))
    assert [r.session_no for r in s.orderBy("hand_id").collect()] == [1, 2, 2]


@pytest.mark.parametrize(("x", "bucket"), [(0.0, 0), (0.3, 1), (0.31, 2), (1.05, 5), (9.0, 7)])
def test_bucket_edges(spark, x, bucket):
    assert spark.range(1).select(decisions.size_bucket(F.lit(x)).alias("b")).first().b == bucket


def test_thin_peers(spark):
    cols = [c for c in outliers.STYLE if c != "vpip_pfr_gap"]
    rows = [("A", 2014, f"p{i}", 50, *[float(i + j) for j in range(len(cols))]) for i in range(29)] + [("B", 2014, f"p{i}", 50, *[float(i + j) for j in range(len(cols))]) for i in range(30)]
    p = spark.createDataFrame(rows, "dataset string, year int, player_name string, hands int, " + ", ".join(f"{c} double" for c in cols))
    assert {r.dataset for r in outliers.peers(p, 40, 30).collect()} == {"B"}


def test_auc_with_ties(spark):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.4, 0), (0.9, 1), (0.9, 1), (0.2, 0), (-3.0, 1)]
    r = decisions.auc(spark.createDataFrame(rows, "s double, y int"), F.col("y"), "s").first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert r.roc_auc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]), abs=1e-6)


def test_planted_outliers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    x[7] = 12.0
    v = spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    iso = outliers.isolation_forest(v, trees=60).orderBy(F.desc("iso_score")).first()
    far = outliers.lof(v, k=20).orderBy(F.desc("lof_score")).first()
    assert iso.vec_id == 7 and far.vec_id == 7 and iso.iso_flag and far.lof_flag


def test_folds_keep_groups_together(spark):
    g = spark.createDataFrame([(f"s{i}", 10 * i) for i in range(11)], "session string, n int")
    f = [r.fold for r in decisions.group_folds(g).collect()]
    assert sorted(set(f)) == [0, 1, 2, 3, 4] and len(f) == 11


def planted(spark):
    """Labels that only two features together tell, and a third feature without meaning."""
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        u, v, w = (float(x) for x in rng.random(3))
        y = int((u > 0.45) != (v > 0.35))
        rows.append((str(i), 0, f"P{i % 9}", f"s{i % 10}", y, float(y), i % 2, [u, v, w]))
    df = spark.createDataFrame(rows, "hand_id string, action_index long, player_name string, session string, label int, y double, fold long, f array<double>")
    return df.withColumn("x", array_to_vector("f")).cache()


def test_boosting_finds_what_a_line_does_not(spark):
    s = decisions.out_of_fold(planted(spark), ("constant", "logistic", "boosted"), 2, 5)
    got = {r.model: r.roc_auc for r in decisions.auc(s, F.col("label"), "p", "model").collect()}
    assert got["boosted"] > 0.9 > 0.75 > got["logistic"] and got["boosted"] > got["constant"]
    drop = {r.feature: r["drop"] for r in decisions.permutation_importance(planted(spark), ["u", "v", "w"], repeats=1, rounds=5).collect()}
    assert min(drop["u"], drop["v"]) > 0.2 > 0.1 > abs(drop["w"])


def test_models_have_the_rounds_of_the_survey():
    import inspect

    of = lambda f, name: inspect.signature(f).parameters[name].default
    assert of(decisions.out_of_fold, "rounds") == of(decisions.permutation_importance, "rounds") == 300
    assert of(decisions.permutation_importance, "repeats") == 5


def test_group_folds_and_split(spark):
    rows = [(f"s{i:03d}", i % 7) for i in range(200)]
    g = spark.createDataFrame(rows, "session string, n long").repartition(9)
    want = {s: k % 5 for k, (s, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert {r.session: r.fold for r in decisions.group_folds(g).collect()} == want
    test = [r.test for r in decisions.group_split(g).collect()]
    assert 20 <= sum(test) <= 60 and len(test) == 200


def test_accuracy_of_scores(spark):
    d = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.4, 0), (0.2, 1)], "p double, y int")
    r = decisions.auc(d, F.col("y"), "p").first()
    assert r.accuracy == 0.5 and r.n == 4 and decisions.auc(d, F.col("y"), "p", threshold=0.6).first().accuracy == 0.75


def test_vectors_that_are_null_or_ragged(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)] + [(100, None), (101, [1.0]), (102, [1.0, None, 2.0, 3.0]), (103, [float("nan")] * 4), (104, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    pc = {r.vec_id: r for r in outliers.pca(df).collect()}
    assert len(pc) == 65 and pc[0].pc1 is not None and all(pc[i].pc1 is None for i in range(100, 105))
    x = outliers.isolation_forest(df, trees=10, sample=16).collect()
    assert len(x) == 65 and sum(r.iso_score is None for r in x) == 5
    assert outliers.nearest(df, 3).select("id").distinct().count() == 60
    load = outliers.pca_loadings(df).collect()
    assert len(load) == 8 and 0 < sum({r.component: r.explained for r in load}.values()) <= 1
    none = df.filter("vec_id >= 100")
    assert outliers.pca(none).filter("pc1 is not null").count() == 0 and outliers.isolation_forest(none, trees=2).count() == 5


def test_isolation_forest_finds_a_far_row_among_many(spark):
    """With 256 of 4,001 rows in each of 300 trees, the far row is in some 19 of them."""
    df = spark.range(4000).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    r = outliers.isolation_forest(df.unionByName(spark.createDataFrame([(9999, [50.0, 50.0])], "vec_id long, embedding array<double>")))
    top = r.orderBy(F.desc("iso_score")).first()
    assert top.vec_id == 9999 and top.iso_flag


@pytest.mark.parametrize("n", [40, 64, 3000])
def test_every_tree_has_its_rows(spark, n):
    good = spark.range(n).select("id", F.array(F.rand(1)).alias("v"))
    rows = outliers.smallest_hashes(good, 30, 64, 42)
    assert [r["count"] for r in rows.groupBy("tree").count().collect()] == [min(64, n)] * 30
    h = {r.id: r.h for r in good.select("id", F.xxhash64("id", F.lit(7), F.lit(42)).alias("h")).collect()}
    assert {r.id for r in rows.filter("tree = 7").collect()} == set(sorted(h, key=h.get)[:64])


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(90, 3)), 1)
    x[40:60] = x[40]  # equal rows: ties go to the smaller id
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.id, r.rank): r.other for r in outliers.nearest(df, 4, block=32).collect()}
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    for i in range(90):
        order = sorted((j for j in range(90) if j != i), key=lambda j: (d[i, j], j))[:4]
        assert [got[i, k + 1] for k in range(4)] == order


def test_facts_need_one_exchange_by_hand(spark, sf):
    from railbird.plans import population

    for name, scans in (("metrics_postflop", 3), ("metrics_by_year", 3), ("metrics_check_raise", 3)):
        plan = population.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == 2 and "Join" not in plan and plan.count("FileScan") == scans, name
        assert "hashpartitioning(hand_id" in plan


def test_folds_equal_the_tables_of_single_steps(spark, sf):
    """Flags of the fold against the windows that give first actions, answers and check-raises."""
    from railbird.sources import fixture

    h, p = fixture.hands_players(spark, sf)
    a = fixture.actions(spark, sf)
    facts = {(r.hand_id, r.player_name): r for r in sequence.player_hand_facts(h, p, a).collect()}
    pa = sequence.primary_actions(h, a)
    first = {(r.hand_id, r.player_name): r for r in sequence.player_first(pa).collect()}
    assert all((facts[k].first_action == (first[k].action_type if k in first else None)) for k in facts)
    assert all(facts[k].three_bet_opp == (k in first and first[k].raises_before == 1) for k in facts)
    assert all(facts[k].rfi_ft_opp == (k in first and first[k].is_folded_to and facts[k].position != "BB") for k in facts)
    answers = {(r.hand_id, r.player_name): (r.vs_3bet, r.vs_4bet) for r in sequence.response_after_event(pa).collect()}
    assert all((facts[k].vs_3bet, facts[k].vs_4bet) == answers.get(k, (None, None)) for k in facts)
    xr = {(r.hand_id, r.player_name, r.street): (r.opp, r.hit) for r in sequence.check_then_raise(pa).collect()}
    for k, r in facts.items():
        for st in ("flop", "turn", "river"):
            assert (r[f"check_raise_{st}_opp"], r[f"check_raise_{st}_hit"]) == xr.get((*k, st), (False, False))
    pfa = {r.hand_id: r.pfa for r in sequence.preflop_aggressor(pa).collect()}
    assert all(r.cbet_opp <= (pfa.get(k[0]) == k[1]) for k, r in facts.items())
    assert sum(r.hand_first for r in facts.values()) == len({k[0] for k in facts})


def test_hands_are_not_broadcast(spark, sf):
    """Hands grow with the corpus; a few columns of their files look small enough to be sent through the driver."""
    from railbird.operators import audits, checks, sequence
    from railbird.plans import scoring
    from railbird.sources import fixture

    o = fixture.dealt(spark, sf)
    h, p = fixture.hands_players(spark, sf)
    made = [*fixture.derived_hands_players(o), fixture.derived_actions(o)]
    joined = [sequence.primary_players(h, p), sequence.primary_actions(h, fixture.actions(spark, sf)), checks.zero_sum(h, p), audits.player_sketches(h, p).select("players"), scoring._acts(spark, sf), scoring._labelled(spark, sf)]
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    for d in made:
        assert "Join" not in plan(d) and plan(d).count("Exchange") == 1
    for d in joined:
        assert "SortMergeJoin" in plan(d)
        assert not [x for x in plan(d).splitlines() if "BroadcastHashJoin [hand_id" in x]


def test_nearest_moves_rows_by_sides_not_by_blocks(spark):
    """Eight blocks of the form before, which moved every row once for each block in a join of blocks."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4096, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    near = outliers.nearest(df, 5)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan
    got = {(r.id, r.rank): r.other for r in near.collect()}
    assert len(got) == 4096 * 5
    for i in range(0, 4096, 97):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert [got[i, r + 1] for r in range(5)] == list(np.argsort(d)[:5])


def test_nearest_of_very_many_equal_rows():
    x = np.zeros((300, 8))
    dist, other = outliers._nearest_of(np.arange(300), x, np.arange(9000), np.zeros((9000, 8)), 3)
    assert (dist == 0).all() and other[0].tolist() == [1, 2, 3] and other[2].tolist() == [0, 1, 3]
