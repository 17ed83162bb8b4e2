"""Queries: decision features and supervised scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from railbird.operators import decisions, sequence
from railbird.plans.population import _c, _r
from railbird.plans.schema import POSTS
from railbird.plans.stored import stored
from railbird.session import table
from railbird.sources import decision_log, fixture

#: LEAST_HERE is the least number of decisions on the test tables, where few entities have the LEAST of the study.
FOLDS, LEAST, LEAST_HERE, KS, REPEATS = 5, 50, 10, (1, 5, 10, 25, 50, 100, 200), 20


def _acts(spark, sf_dir):
    h, p = fixture.hands_players(spark, sf_dir)
    h = sequence.primary_hands(h).select("hand_id", "year", "table_name", "bb")
    return fixture.actions(spark, sf_dir).join(p.select("hand_id", "player_name", "seat", "position", "stack_start").hint("merge"), ["hand_id", "player_name"]).join(h.hint("merge"), "hand_id")


def _labelled(spark, sf_dir):
    a = _acts(spark, sf_dir)
    d = decisions.features(a)
    s = a.select("hand_id", F.concat_ws("-", "year", "table_name").alias("session")).distinct()
    label = (F.substring("player_name", 2, 9).cast("int") % 6 == 0).cast("int")
    return d.join(s.hint("merge"), "hand_id").withColumn("label", label)


def decision_features(spark, sf_dir):
    return decisions.features(_acts(spark, sf_dir)).select(*[c for c in COLS])


COLS = ["hand_id", "action_index", "player_name", "street", "position", "players_left", "raises_before", "actions_before", "facing_bet", "pot_bb", "to_call_bb", "pot_odds", "spr", "in_position", "was_preflop_aggressor", "decision", "size_pot", "all_in"]


def decision_mix(spark, sf_dir):
    return decisions.mix(_labelled(spark, sf_dir))


def style_stats(spark, sf_dir):
    return decisions.style(_labelled(spark, sf_dir))


def bet_size_histogram(spark, sf_dir):
    return decisions.size_histogram(_labelled(spark, sf_dir))


def size_buckets(spark, sf_dir):
    d = decisions.features(_acts(spark, sf_dir))
    return d.groupBy(decisions.size_bucket(F.col("size_pot")).alias("bucket")).agg(F.count("*").alias("n"))


def _folds(d):
    return decisions.group_folds(d.groupBy("session").agg(F.count("*").alias("n")), FOLDS)


def group_kfold(spark, sf_dir):
    return _folds(_labelled(spark, sf_dir))


def group_split(spark, sf_dir):
    return decisions.group_split(_labelled(spark, sf_dir).select("session").distinct())


def entity_scores(spark, sf_dir):
    d = _labelled(spark, sf_dir).withColumn("score", F.floor(F.col("size_pot") / (1 + F.col("size_pot")) * 10000).cast("long"))
    e = d.groupBy("player_name", "session").agg(F.count("*").alias("decisions"), (F.sum("score") / 10000.0 / F.count("*")).alias("mean_score"), F.max("label").alias("label"))
    return e.filter(F.col("decisions") >= LEAST_HERE).withColumn("label", F.col("label").cast("long"))


def entity_auc(spark, sf_dir):
    return decisions.auc(entity_scores(spark, sf_dir), F.col("label"), "mean_score")


def auc_ap(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return decisions.auc(e, F.col("event_type") == "purchase", "value")


def evidence_curve(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return decisions.evidence_curve(e, "user_id", (F.col("user_id") % 6 == 0).cast("int"), "value", "event_id", KS, REPEATS)


def _design(spark, sf_dir):
    d = stored(_labelled(spark, sf_dir))
    return stored(decisions.assembled(d).join(_folds(d).select("session", "fold"), "session"))


def oof_scores(spark, sf_dir):
    s = decisions.out_of_fold(_design(spark, sf_dir), ("constant", "logistic", "boosted"), FOLDS)
    return decisions.auc(s.withColumn("p", F.round("p", 6)), F.col("label"), "p", "model")


def oof_entities(spark, sf_dir):
    s = decisions.out_of_fold(_design(spark, sf_dir), ("logistic",), FOLDS)
    return decisions.entity_scores(s, ["player_name", "session"], "p", "label", LEAST_HERE)


def feature_ablation(spark, sf_dir):
    """Out-of-fold AUC of boosting, by decision and by entity, with all features, with coarse bet sizes, and without bet sizes."""
    d = stored(_labelled(spark, sf_dir)).withColumn("size_bucket", decisions.size_bucket(F.col("size_pot")))
    numeric = (*decisions.NUMERIC, "size_bucket")
    names = decisions.feature_names(numeric)
    sets = {"all": set(names) - {"size_bucket"}, "coarse": set(names) - {"size_pot"}, "none": set(names) - {"size_pot", "size_bucket"}}
    x = stored(decisions.assembled(d, numeric=numeric).join(_folds(d).select("session", "fold"), "session"))
    s = stored(decisions.ablation(x, sets, names, FOLDS).withColumn("p", F.round("p", 6)))
    e = decisions.auc(decisions.entity_scores(s, ["features", "player_name", "session"], "p", "label", LEAST), F.col("label"), "mean_score", "features")
    return decisions.auc(s, F.col("label"), "p", "features").join(e.select("features", F.col("roc_auc").alias("entity_auc")), "features", "left")


def permutation_importance(spark, sf_dir):
    return decisions.permutation_importance(_design(spark, sf_dir), decisions.feature_names())


def ingest_decision_log(spark, sf_dir):
    a = _acts(spark, sf_dir).filter("action_type not like 'post%'")
    return decision_log.read_actions(decision_log.render(a))


def decision_replay(spark, sf_dir):
    """Decision features from the logs alone: calls and stacks are played through, no amount of a call is read."""
    a = _acts(spark, sf_dir)
    log = decision_log.read_actions(decision_log.render(a.filter("action_type not like 'post%'"), boards=True))
    blind = F.sum(F.when(F.col("action_type").isin(*POSTS), F.col("amount")))
    seats = a.groupBy(F.col("hand_id").alias("hand"), "player_name").agg(*[F.first(c).alias(c) for c in ("seat", "position", "stack_start", "bb")], blind.alias("blind"))
    return decisions.replay(log, seats).select(*COLS)


QUERIES = {
    f.__name__: f
    for f in (
        decision_features, decision_mix, style_stats, bet_size_histogram, size_buckets, group_kfold, group_split, entity_scores, entity_auc, auc_ap, evidence_curve, oof_scores, oof_entities, feature_ablation, permutation_importance, ingest_decision_log, decision_replay,
    )
}

_A = fixture.SQL + """,
da AS (SELECT a.*, p.seat, p.position, p.stack_start, h.bb, h.year, h.table_name FROM actions a JOIN players p USING (hand_id, player_name) JOIN hands h ON h.hand_id = a.hand_id WHERE h.is_primary),
d1 AS (SELECT *, sum(CASE WHEN action_type IN ('post_sb', 'post_bb', 'call', 'bet') THEN amount ELSE 0 END) OVER (PARTITION BY hand_id, street, player_name ORDER BY action_index) AS s_ FROM da),
d2 AS (SELECT *, s_ + greatest(0, coalesce(max(CASE WHEN action_type = 'raise' THEN amount - s_ END) OVER (PARTITION BY hand_id, street, player_name ORDER BY action_index), 0)) AS in_ FROM d1),
d3 AS (SELECT *, coalesce(lag(in_) OVER (PARTITION BY hand_id, street, player_name ORDER BY action_index), 0) AS had FROM d2),
d4 AS (SELECT *, in_ - had AS add_, coalesce(sum(in_ - had) OVER (PARTITION BY hand_id ORDER BY action_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pot,
  coalesce(max(in_) OVER (PARTITION BY hand_id, street ORDER BY action_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bet,
  coalesce(sum(in_ - had) OVER (PARTITION BY hand_id, player_name ORDER BY action_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
  coalesce(sum((action_type IN ('raise', 'bet'))::INT) OVER (PARTITION BY hand_id, street ORDER BY action_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rb,
  coalesce(sum((action_type NOT LIKE 'post%')::INT) OVER (PARTITION BY hand_id, street ORDER BY action_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ab FROM d3),
d5 AS (SELECT *, least(greatest(bet - had, 0), stack_start - spent) AS cl,
  (SELECT count(DISTINCT x.player_name) FROM da x WHERE x.hand_id = d4.hand_id) - (SELECT count(*) FROM da x WHERE x.hand_id = d4.hand_id AND x.action_type = 'fold' AND x.action_index < d4.action_index) AS pleft,
  (SELECT max(x.seat) FROM da x WHERE x.hand_id = d4.hand_id AND NOT EXISTS (SELECT 1 FROM da y WHERE y.hand_id = x.hand_id AND y.player_name = x.player_name AND y.action_type = 'fold' AND y.action_index < d4.action_index)) AS last_seat,
  (SELECT arg_max(x.player_name, x.action_index) FROM da x WHERE x.hand_id = d4.hand_id AND x.street = 'preflop' AND x.action_type = 'raise' AND x.action_index < d4.action_index) AS pfa FROM d4 WHERE action_type NOT LIKE 'post%'),
df AS (SELECT hand_id, action_index, player_name, street, position, pleft::BIGINT AS players_left, (rb + CASE WHEN street = 'preflop' THEN 1 ELSE 0 END)::BIGINT AS raises_before, ab::BIGINT AS actions_before, cl > 0 AS facing_bet,
  pot::DOUBLE / bb AS pot_bb, cl::DOUBLE / bb AS to_call_bb, CASE WHEN cl > 0 THEN cl::DOUBLE / (pot + cl) ELSE 0.0 END AS pot_odds, CASE WHEN pot > 0 THEN (stack_start - spent)::DOUBLE / pot ELSE 0.0 END AS spr,
  street <> 'preflop' AND seat = last_seat AS in_position, street <> 'preflop' AND coalesce(pfa = player_name, false) AS was_preflop_aggressor, action_type AS decision, CASE WHEN pot > 0 THEN add_::DOUBLE / pot ELSE 0.0 END AS size_pot,
  action_type IN ('call', 'bet', 'raise') AND stack_start - spent - add_ <= 0 AS all_in, year || '-' || table_name AS session, (substr(player_name, 2)::INT % 6 = 0)::INT AS label FROM d5)
"""


def _sh(hit: str, opp: str) -> str:
    return _r(f"100.0::DOUBLE * {_c(f'({hit}) AND ({opp})')} / nullif({_c(opp)}, 0)")


_BUCKET = "CASE WHEN size_pot <= 0 THEN 0 " + " ".join(f"WHEN size_pot <= {e} THEN {i}" for i, e in enumerate(decisions.SIZE_EDGES) if i) + f" ELSE {len(decisions.SIZE_EDGES)} END::BIGINT"
_HIST = "least(floor(least(size_pot, 2.5) / 0.1::DOUBLE), 24)::BIGINT"


def _auc(src: str, keys: str = "") -> str:
    """AUC and average precision of ``src(keys, s, y)`` by average ranks."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""c_ AS (SELECT {k}s, sum(y)::BIGINT AS p, count(*) AS n FROM {src} GROUP BY {k}s), w_ AS (SELECT *, coalesce(sum(n) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n1, coalesce(sum(p) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p1, sum(p) OVER ({part}) AS tp, sum(n) OVER ({part}) AS tn FROM c_),
auc_ AS (SELECT {k}max(tn)::BIGINT AS n, max(tp)::BIGINT AS positives, {_r('(sum(p * (2 * n1 + n + 1)) - max(tp) * (max(tp) + 1))::DOUBLE / 2 / nullif((max(tp) * (max(tn) - max(tp)))::DOUBLE, 0)', 6)} AS roc_auc, {_r('sum(p * (tp - p1)::DOUBLE / (tn - n1)) / nullif(max(tp), 0)', 6)} AS avg_precision, {_r('sum(CASE WHEN s >= 0.5 THEN p ELSE n - p END)::DOUBLE / max(tn)', 6)} AS accuracy FROM w_ {f'GROUP BY {keys}' if keys else ''})"""


#: The hands played step by step: a recursive query carries stacks, street and pot from one action to the next.
_REPLAY = _A.replace("WITH s0", "WITH RECURSIVE s0", 1) + """,
ls AS (SELECT hand_id, list_position(['preflop', 'flop', 'turn', 'river'], street) - 1 AS sx, seat, row_number() OVER (PARTITION BY hand_id ORDER BY action_index) AS n,
  CASE WHEN action_type = 'fold' THEN 'f' WHEN action_type IN ('check', 'call') THEN 'cc' ELSE 'cbr' END AS kind, amount AS target FROM da WHERE action_type NOT LIKE 'post%'),
lg AS MATERIALIZED (SELECT *, n - 1 + sx AS step FROM ls),
se AS (SELECT hand_id, any_value(bb) AS bb, player_name, any_value(seat) AS seat, any_value(position) AS position, any_value(stack_start) AS stack, coalesce(sum(amount) FILTER (action_type LIKE 'post%'), 0)::BIGINT AS blind FROM da GROUP BY hand_id, player_name),
h_ AS (SELECT hand_id, any_value(bb) AS bb, list(seat ORDER BY seat) AS ss, list(player_name ORDER BY seat) AS names, list(position ORDER BY seat) AS places, list((stack - blind)::BIGINT ORDER BY seat) AS stack, list(blind ORDER BY seat) AS has, sum(blind)::BIGINT AS pot, max(blind) AS bet FROM se GROUP BY hand_id),
rp AS (SELECT hand_id, bb, ss, names, places, 0::BIGINT AS n, 0::BIGINT AS sx, stack, has, list_transform(ss, lambda x: false) AS gone, pot, bet, (bet > 0)::BIGINT AS raises, 0::BIGINT AS acts, 0::BIGINT AS pfa,
  0::BIGINT AS step, 0::BIGINT AS w, 0::BIGINT AS players_left, 0::BIGINT AS raises_before, 0::BIGINT AS actions_before, 0::BIGINT AS to_call, 0::BIGINT AS pot_before, 0::BIGINT AS mine, false AS in_position, false AS aggressor, '' AS decision, 0::BIGINT AS added FROM h_
UNION ALL
SELECT hand_id, bb, ss, names, places, n, sx, list_transform(stack, lambda x, i: CASE WHEN i = w THEN x - added ELSE x END), list_transform(has, lambda x, i: CASE WHEN i = w THEN x + added ELSE x END),
  list_transform(gone, lambda x, i: CASE WHEN i = w THEN kind = 'f' ELSE x END), pot + added, CASE WHEN kind = 'cbr' THEN target ELSE bet END, raises + (kind = 'cbr')::BIGINT, acts + 1, CASE WHEN kind = 'cbr' AND sx = 0 THEN w ELSE pfa END,
  step, w, len(list_filter(gone, lambda x: NOT x))::BIGINT, raises, acts, to_call, pot, mine, sx > 0 AND w = list_max(list_transform(gone, lambda x, i: CASE WHEN x THEN 0 ELSE i END)), sx > 0 AND pfa = w,
  CASE kind WHEN 'f' THEN 'fold' WHEN 'cc' THEN CASE WHEN to_call > 0 THEN 'call' ELSE 'check' END ELSE CASE WHEN bet > 0 THEN 'raise' ELSE 'bet' END END, added
FROM (SELECT *, CASE kind WHEN 'cc' THEN to_call WHEN 'cbr' THEN target - has[w] ELSE 0 END AS added FROM (SELECT *, stack[w] AS mine, least(bet - has[w], stack[w]) AS to_call FROM (
  SELECT r.hand_id, r.bb, r.ss, r.names, r.places, l.n, l.sx, r.stack, CASE WHEN l.sx > r.sx THEN list_transform(r.has, lambda x: 0::BIGINT) ELSE r.has END AS has, r.gone, r.pot, CASE WHEN l.sx > r.sx THEN 0 ELSE r.bet END AS bet,
    CASE WHEN l.sx > r.sx THEN 0 ELSE r.raises END AS raises, CASE WHEN l.sx > r.sx THEN 0 ELSE r.acts END AS acts, r.pfa, l.step, list_position(r.ss, l.seat)::BIGINT AS w, l.kind, l.target
  FROM rp r JOIN lg l ON l.hand_id = r.hand_id AND l.n = r.n + 1))))
SELECT hand_id, step AS action_index, names[w] AS player_name, ['preflop', 'flop', 'turn', 'river'][sx + 1] AS street, places[w] AS position, players_left, raises_before, actions_before, to_call > 0 AS facing_bet, pot_before::DOUBLE / bb AS pot_bb, to_call::DOUBLE / bb AS to_call_bb,
  CASE WHEN to_call > 0 THEN to_call::DOUBLE / (pot_before + to_call) ELSE 0.0 END AS pot_odds, CASE WHEN pot_before > 0 THEN mine::DOUBLE / pot_before ELSE 0.0 END AS spr, in_position, aggressor AS was_preflop_aggressor, decision,
  CASE WHEN pot_before > 0 AND (decision IN ('call', 'bet', 'raise')) THEN added::DOUBLE / pot_before ELSE 0.0 END AS size_pot, decision <> 'fold' AND mine = added AS all_in FROM rp WHERE n > 0"""

_ENT = _A + f", sc AS (SELECT *, floor(size_pot / (1 + size_pot) * 10000)::BIGINT AS score FROM df), en AS (SELECT player_name, session, count(*) AS decisions, sum(score)::DOUBLE / 10000.0 / count(*) AS mean_score, max(label)::BIGINT AS label FROM sc GROUP BY ALL HAVING count(*) >= 10)"
ORACLES = {
    "decision_features": _A + " SELECT " + ", ".join(COLS) + " FROM df",
    "decision_mix": _A + " SELECT label, " + ", ".join(f"{_r(_c(f'decision = {chr(39)}{k}{chr(39)}') + '::DOUBLE / count(*)', 4)} AS \"{k}\"" for k in decisions.CATEGORICAL["decision"]) + " FROM df GROUP BY label",
    "style_stats": _A + f", hp AS (SELECT label, hand_id, player_name, bool_or(decision IN ('call', 'raise')) AS v, bool_or(decision = 'raise') AS r FROM df WHERE street = 'preflop' GROUP BY ALL), h2 AS (SELECT label, {_sh('v', 'true')} AS vpip_pct, {_sh('r', 'true')} AS pfr_pct FROM hp GROUP BY label), g AS (SELECT label, {_sh(chr(100) + 'ecision = ' + repr('raise'), 'street = ' + repr('preflop') + ' AND raises_before = 2')} AS three_bet_pct, {_sh('decision = ' + repr('bet'), 'street = ' + repr('flop') + ' AND was_preflop_aggressor AND NOT facing_bet')} AS flop_cbet_pct, {_sh('decision = ' + repr('fold'), 'street = ' + repr('flop') + ' AND facing_bet')} AS fold_to_flop_bet_pct, {_sh('decision = ' + repr('raise'), 'street = ' + repr('flop') + ' AND facing_bet')} AS raise_vs_flop_bet_pct, {_sh('size_pot > 1.05', 'decision IN ' + repr(('bet', 'raise')) + ' AND street <> ' + repr('preflop'))} AS overbet_pct, {_sh('all_in', 'true')} AS all_in_pct FROM df GROUP BY label) SELECT * FROM h2 JOIN g USING (label)",
    "bet_size_histogram": _A + f", b AS (SELECT street, label, {_HIST} AS bin, count(*) AS n FROM df WHERE decision IN ('bet', 'raise') AND street <> 'preflop' GROUP BY ALL) SELECT street, label, bin, n, {_r('n::DOUBLE / (sum(n) OVER (PARTITION BY street, label) * 0.1::DOUBLE)', 6)} AS density FROM b",
    "size_buckets": _A + f" SELECT {_BUCKET} AS bucket, count(*) AS n FROM df GROUP BY ALL",
    "group_split": _A + " SELECT DISTINCT session, ('0x' || substr(md5('42/' || session), 1, 12))::BIGINT::DOUBLE < 0.2::DOUBLE * 281474976710656.0::DOUBLE AS test FROM df",
    "group_kfold": _A + f", se AS (SELECT session, count(*) AS n FROM df GROUP BY ALL) SELECT session, n, (row_number() OVER (ORDER BY n DESC, session) - 1) % {FOLDS} AS fold FROM se",
    "entity_scores": _ENT + " SELECT player_name, session, decisions, mean_score, label FROM en",
    "entity_auc": _ENT + ", z_ AS (SELECT mean_score AS s, label AS y FROM en), " + _auc("z_") + " SELECT * FROM auc_",
    "auc_ap": "WITH z_ AS (SELECT value AS s, (event_type = 'purchase')::INT AS y FROM events), " + _auc("z_") + " SELECT * FROM auc_",
    "evidence_curve": f"WITH r0 AS (SELECT user_id, (user_id % 6 = 0)::INT AS y, value, event_id, unnest(range(1, {REPEATS} + 1)) AS rep FROM events), r1 AS (SELECT *, row_number() OVER (PARTITION BY user_id, rep ORDER BY md5('7/' || rep || '/' || event_id), event_id) AS rn, count(*) OVER (PARTITION BY user_id, rep) AS cnt FROM r0), r2 AS (SELECT *, unnest([{', '.join(map(str, KS))}]) AS k FROM r1), z_ AS (SELECT k, rep, user_id, sum(round(value * 10000)::BIGINT)::DOUBLE / 10000.0 / count(*) AS s, max(y) AS y FROM r2 WHERE rn <= k AND cnt >= k GROUP BY ALL), " + _auc("z_", "k, rep") + f" SELECT k, max(n) AS entities, {_r('sum(round(roc_auc * 1e6)::BIGINT)::DOUBLE / 1e6::DOUBLE / count(*)', 6)} AS roc_auc FROM auc_ GROUP BY k",
    "decision_replay": _REPLAY,
    "ingest_decision_log": _A + " SELECT hand_id AS hand, row_number() OVER (PARTITION BY hand_id ORDER BY action_index) - 1 AS step, 'p' || seat || ' ' || CASE WHEN action_type = 'fold' THEN 'f' WHEN action_type IN ('check', 'call') THEN 'cc' ELSE 'cbr ' || amount END AS action FROM da WHERE action_type NOT LIKE 'post%'",
}
