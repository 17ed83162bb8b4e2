"""Hands played from logs and from stated money, and bounded draws."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from railbird.operators import decisions

SEATS = "hand string, seat int, player_name string, position string, stack_start long, blind long, bb long"


def _table(spark, hand, stacks, blinds, actions, bb=100):
    seats = [(hand, i + 1, f"n{i + 1}", str(i), s, b, bb) for i, (s, b) in enumerate(zip(stacks, blinds))]
    return seats, [(hand, i, a) for i, a in enumerate(actions)]


def _play(spark, *hands):
    seats = spark.createDataFrame([x for h in hands for x in h[0]], SEATS)
    log = spark.createDataFrame([x for h in hands for x in h[1]], "hand string, step long, action string")
    return {(r.hand_id, r.action_index): r for r in decisions.replay(log, seats).collect()}


def test_a_short_call_is_capped_by_the_stack(spark):
    # Seat 3 raises to 300, seat 1 holds 120 behind its blind of 50: it calls 120 and is all in; seat 2 must still add 200.
    h = _table(spark, "a", [170, 1000, 1000], [50, 100, 0], ["d dh p1 ????", "p3 cbr 300", "p1 cc", "p2 cc", "d db AhKd7c", "p2 cc", "p3 cbr 700", "p2 cc", "p2 sm 2c3d"])
    r = _play(spark, h)
    assert sorted(k[1] for k in r) == [1, 2, 3, 5, 6, 7]
    one = r["a", 2]
    assert (one.decision, one.to_call_bb, one.pot_bb, one.all_in, one.facing_bet, one.raises_before) == ("call", 1.2, 4.5, True, True, 2)
    assert one.size_pot == 120 / 450 and one.spr == 120 / 450 and one.pot_odds == 120 / 570
    two = r["a", 3]
    assert (two.to_call_bb, two.pot_bb, two.all_in, two.players_left) == (2.0, 5.7, False, 3)
    check = r["a", 5]
    assert (check.street, check.decision, check.size_pot, check.in_position, check.actions_before, check.raises_before) == ("flop", "check", 0.0, False, 0, 0)
    # 700 is what is left: a bet, as nothing is in on the flop; last to act, raiser before the flop.
    bet = r["a", 6]
    assert (bet.decision, bet.all_in, bet.in_position, bet.was_preflop_aggressor, bet.actions_before) == ("bet", True, True, True, 1)
    assert (r["a", 7].decision, r["a", 7].to_call_bb, r["a", 7].all_in, r["a", 7].pot_bb) == ("call", 7.0, True, 14.7)


def test_folds_streets_without_actions_and_reraises(spark):
    h = _table(spark, "b", [500, 500, 500], [50, 100, 0], ["p3 f", "p1 cbr 250", "p2 cbr 500", "p1 cc", "d db", "d db", "d db", "p1 cc"])
    r = _play(spark, h)
    assert [r["b", i].decision for i in (0, 1, 2, 3)] == ["fold", "raise", "raise", "call"]
    assert r["b", 1].size_pot == 200 / 150 and r["b", 2].all_in and r["b", 3].all_in and r["b", 3].to_call_bb == 2.5
    assert [r["b", i].players_left for i in (0, 1, 2)] == [3, 2, 2]
    # Three boards dealt in a row: the river. Nothing is left to bet, and a check with an empty stack is all in.
    last = r["b", 7]
    assert (last.street, last.decision, last.to_call_bb, last.all_in, last.spr) == ("river", "check", 0.0, True, 0.0)


def test_no_blinds_unknown_seats_and_empty_logs(spark):
    free = _table(spark, "c", [100, 100], [None, 0], ["p1 cc", "p9 cbr 50", "p2 cbr 40", "nonsense", "p1 f"])
    idle = _table(spark, "d", [100], [0], ["d db"])
    lone = ([], [("e", 0, "p1 f")])
    r = _play(spark, free, idle, lone)
    assert sorted(r) == [("c", 0), ("c", 2), ("c", 4)]
    assert (r["c", 0].pot_bb, r["c", 0].spr, r["c", 0].raises_before, r["c", 2].decision, r["c", 2].size_pot) == (0.0, 0.0, 0, "bet", 0.0)


def test_features_need_one_exchange(spark):
    cols = "hand_id string, action_index long, street string, player_name string, seat long, position string, action_type string, amount long, bb long, stack_start long"
    a = spark.createDataFrame([("h", 1, "preflop", "x", 1, "SB", "post_sb", 50, 100, 1000), ("h", 2, "preflop", "y", 2, "BB", "post_bb", 100, 100, 1000), ("h", 3, "preflop", "x", 1, "SB", "fold", None, 100, 1000)], cols)
    d = decisions.features(a)
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [(r.action_index, r.decision, r.to_call_bb, r.pot_bb, r.players_left, r.raises_before) for r in d.collect()] == [(3, "fold", 0.5, 1.5, 2, 1)]


def test_draws_are_the_smallest_digests_of_hot_entities(spark):
    rows = [(e, i, (i * 37 + len(e)) % 101 / 100.0, int(e < "c")) for e, n in (("a", 900), ("b", 7), ("c", 3), ("d", 600), ("f", 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "e string, id long, s double, y int")
    ks, reps = (1, 5, 40), 3
    got = {r.k: (r.entities, r.roc_auc) for r in decisions.evidence_curve(df, "e", F.col("y"), "s", "id", ks, reps).collect()}
    for k in ks:
        aucs, n = [], 0
        for rep in range(1, reps + 1):
            means = []
            for e in "abcdf":
                mine = sorted((hashlib.md5(f"7/{rep}/{r[1]}".encode()).hexdigest(), r[1], r[2], r[3]) for r in rows if r[0] == e)
                if len(mine) >= k:
                    means.append((sum(round(x[2] * 10000) for x in mine[:k]) / 10000.0 / k, mine[0][3]))
            pos, neg = [m for m, y in means if y], [m for m, y in means if not y]
            aucs.append(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)))
            n = len(means)
        assert got[k][0] == n and abs(got[k][1] - sum(aucs) / reps) < 2e-6


def test_draws_move_a_row_once(spark):
    """Rows are copied for the repeats behind the exchange by entity, and the windows need none of their own."""
    df = spark.createDataFrame([("a", i, 0.5, 1) for i in range(300)] + [("b", i, 0.25, 0) for i in range(3)], "e string, id long, s double, y int")
    asked = []
    auc = decisions.auc
    try:
        decisions.auc = lambda m, *a, **b: asked.append(m) or auc(m, *a, **b)
        out = {r.k: (r.entities, r.roc_auc) for r in decisions.evidence_curve(df, "e", F.col("y"), "s", "id", (1, 3, 4), 2).collect()}
    finally:
        decisions.auc = auc
    assert out == {1: (2, 1.0), 3: (2, 1.0), 4: (1, None)}
    plan = asked[0]._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert "Window" in above and "Exchange" not in above
