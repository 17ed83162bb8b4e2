"""Queries: population metrics, player panel, sessions and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from railbird.operators import metrics, pairs, panel, sequence, sessions
from railbird.session import table
from railbird.sources import fixture

MIN_HANDS, MIN_YEARS, MIN_SHARED, CAREER = 40, 3, 5, 100
GAP_S, REGULAR = 12 * 3600, 10


def facts(spark, sf_dir):
    h, p = fixture.hands_players(spark, sf_dir)
    return sequence.player_hand_facts(h, p, fixture.actions(spark, sf_dir))


def _pa(spark, sf_dir):
    return sequence.primary_actions(fixture.hands(spark, sf_dir), fixture.actions(spark, sf_dir))


def metrics_overall(spark, sf_dir):
    return metrics.overall(facts(spark, sf_dir), "dataset")


def metrics_by_position(spark, sf_dir):
    return metrics.by_position(facts(spark, sf_dir))


def metrics_by_year(spark, sf_dir):
    return metrics.by_year(facts(spark, sf_dir))


def metrics_preflop(spark, sf_dir):
    return metrics.preflop(facts(spark, sf_dir), "dataset")


def metrics_postflop(spark, sf_dir):
    return metrics.postflop(facts(spark, sf_dir))


def metrics_check_raise(spark, sf_dir):
    return metrics.check_raise(facts(spark, sf_dir))


def metrics_bb100(spark, sf_dir):
    return metrics.bb100(facts(spark, sf_dir), sequence.primary_hands(fixture.hands(spark, sf_dir)))


def matchup_btn_vs_bb(spark, sf_dir):
    return metrics.responses(facts(spark, sf_dir), F.col("opener_position") == "BTN", "bb_response")


def matchup_bb_defense(spark, sf_dir):
    return metrics.responses(facts(spark, sf_dir), F.lit(True), "bb_response")


def matchup_sb_first_in(spark, sf_dir):
    return metrics.responses(facts(spark, sf_dir), (F.col("position") == "SB") & F.col("rfi_ft_opp"), "first_action")


def three_bet_sizing(spark, sf_dir):
    return metrics.three_bet_sizing(sequence.annotated(_pa(spark, sf_dir)))


def recombine_rates(spark, sf_dir):
    f = facts(spark, sf_dir)
    c = lambda x: F.count(F.when(F.col(x), 1))
    slices = f.groupBy("dataset", "year").agg(F.count("*").alias("player_hands"), c("vpip").alias("vpip_count"), c("pfr").alias("pfr_count"), c("three_bet_hit").alias("three_bets"), c("three_bet_opp").alias("three_bet_opps"), F.sum("net_won").alias("net_won"), F.max("bb").alias("bb"))
    return metrics.recombine(slices, "dataset")


def _panel(spark, sf_dir):
    return panel.player_year(facts(spark, sf_dir))


def player_year(spark, sf_dir):
    return _panel(spark, sf_dir).filter(F.col("hands") >= MIN_HANDS)


def player_dispersion(spark, sf_dir):
    return panel.dispersion(_panel(spark, sf_dir), min_hands=MIN_HANDS)


def bb100_dispersion(spark, sf_dir):
    return panel.dispersion(_panel(spark, sf_dir), ("bb100",), MIN_HANDS)


def player_stayers(spark, sf_dir):
    return panel.stayers(_panel(spark, sf_dir), MIN_YEARS, MIN_HANDS)


def panel_overview(spark, sf_dir):
    return panel.overview(_panel(spark, sf_dir))


def cohort_retention(spark, sf_dir):
    return panel.cohort_retention(_panel(spark, sf_dir))


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("events").alias("dataset"), F.year("ts").cast("long").alias("year"), F.col("user_id").alias("player_name"), F.col("event_type").alias("table_name"), F.col("ts").alias("timestamp"), F.col("event_id").alias("hand_id"))


def table_gaps(spark, sf_dir):
    return sessions.table_gaps(_events(spark, sf_dir))


def player_sessions(spark, sf_dir):
    return sessions.player_sessions(_events(spark, sf_dir), GAP_S).select("player_name", "hand_id", "gap_s", "session_no")


def _sess(spark, sf_dir):
    return sessions.sessions(sessions.player_sessions(_events(spark, sf_dir), GAP_S))


def session_table(spark, sf_dir):
    return _sess(spark, sf_dir)


def session_summary(spark, sf_dir):
    return sessions.summary(sessions.player_sessions(_events(spark, sf_dir), GAP_S), _sess(spark, sf_dir), REGULAR)


def session_player_year(spark, sf_dir):
    return sessions.player_year(_sess(spark, sf_dir), REGULAR)


def _seated(spark, sf_dir):
    h, p = fixture.hands_players(spark, sf_dir)
    return sequence.primary_hands(h).select("hand_id", "dataset", "year", "table_name", "timestamp", "bb").hint("merge").join(p.select("hand_id", "player_name", "net_won"), "hand_id")


def pairs_expand(spark, sf_dir):
    x = pairs.expand(_seated(spark, sf_dir))
    return x.groupBy("dataset", "year", "table_name").agg(F.count("*").alias("pair_hands"), F.count_distinct("player_a", "player_b").alias("pairs"), F.sum("net_a").alias("net_a"), F.sum("net_b").alias("net_b"))


def _py(spark, sf_dir):
    return pairs.by_year(pairs.expand(_seated(spark, sf_dir)), MIN_SHARED)


def pairs_year(spark, sf_dir):
    return _py(spark, sf_dir)


def pairs_career(spark, sf_dir):
    return pairs.career(_py(spark, sf_dir))


def _vol(spark, sf_dir):
    return pairs.volume(_seated(spark, sf_dir), "dataset")


def pairs_export(spark, sf_dir):
    return pairs.export(pairs.career(_py(spark, sf_dir)), _vol(spark, sf_dir), CAREER)


def pairs_players(spark, sf_dir):
    return pairs.per_player(pairs.career(_py(spark, sf_dir)), _vol(spark, sf_dir), CAREER, MIN_HANDS)


def pairs_summary(spark, sf_dir):
    return pairs.summary(pairs.career(_py(spark, sf_dir)), _vol(spark, sf_dir), MIN_HANDS)


QUERIES = {
    f.__name__: f
    for f in (
        metrics_overall, metrics_by_position, metrics_by_year, metrics_preflop, metrics_postflop, metrics_check_raise, metrics_bb100, matchup_btn_vs_bb, matchup_bb_defense, matchup_sb_first_in, three_bet_sizing, recombine_rates,
        player_year, player_dispersion, bb100_dispersion, player_stayers, panel_overview, cohort_retention, table_gaps, player_sessions, session_table, session_summary, session_player_year,
        pairs_expand, pairs_year, pairs_career, pairs_export, pairs_players, pairs_summary,
    )
}

_S = fixture.SQL + sequence.SQL


def _r(x: str, d: int = 2) -> str:
    return f"floor(({x})::DOUBLE * {10.0**d} + 0.5) / {10.0**d}"


def _pct(hit: str, n: str, d: int = 2) -> str:
    return _r(f"100.0::DOUBLE * ({hit}) / nullif({n}, 0)", d)


def _c(cond: str) -> str:
    return f"count(*) FILTER ({cond})"


_BB = _r("100.0::DOUBLE * sum(net_won) / max(bb) / count(*)")
_CB, _CH = "is_pfa AND flop_ok", "is_pfa AND flop_ok AND bet_flop"
_XR = ", ".join(
    f"{_c(f'street = {chr(39)}{s}{chr(39)} AND opp')} AS check_raise_{s}_opps, {_c(f'street = {chr(39)}{s}{chr(39)} AND opp AND again')} AS check_raise_{s}_count, "
    f"{_pct(_c(f'street = {chr(39)}{s}{chr(39)} AND opp AND again'), _c(f'street = {chr(39)}{s}{chr(39)} AND opp'))} AS check_raise_{s}_pct"
    for s in ("flop", "turn", "river")
)
PANEL = f""",
panel AS (SELECT dataset, year, player_name, count(*) AS hands, {_c('vpip')} AS vpip_count, {_pct(_c('vpip'), 'count(*)')} AS vpip_pct, {_c('pfr')} AS pfr_count, {_pct(_c('pfr'), 'count(*)')} AS pfr_pct,
 {_c('three_bet_opp')} AS three_bet_opps, {_c('three_bet_hit')} AS three_bets, {_pct(_c('three_bet_hit'), _c('three_bet_opp'))} AS three_bet_pct, count(vs_3bet) AS fold_to_3bet_opps, {_c("vs_3bet = 'fold'")} AS fold_to_3bet_count,
 {_pct(_c("vs_3bet = 'fold'"), 'count(vs_3bet)')} AS fold_to_3bet_pct, count(bb_response) AS bb_defense_opps, {_c("bb_response = 'fold'")} AS bb_fold_count, {_c("bb_response = 'call'")} AS bb_call_count, {_c("bb_response = 'raise'")} AS bb_three_bet_count,
 {_pct(_c("bb_response = 'fold'"), 'count(bb_response)')} AS bb_fold_pct, {_pct(_c("bb_response = 'call'"), 'count(bb_response)')} AS bb_call_pct, {_pct(_c("bb_response = 'raise'"), 'count(bb_response)')} AS bb_three_bet_pct,
 {_c(_CB)} AS cbet_opps, {_c(_CH)} AS cbets, {_pct(_c(_CH), _c(_CB))} AS cbet_pct, {_BB} AS bb100 FROM facts GROUP BY ALL)
"""
_P = _S + PANEL


def _spread(names: tuple[str, ...]) -> str:
    parts = " UNION ALL ".join(f"SELECT dataset, year, hands, '{m}' AS metric, {m} AS value FROM panel WHERE hands >= {MIN_HANDS} AND {m} IS NOT NULL" for m in names)
    return f""", long AS ({parts}) SELECT dataset, year, metric, count(*) AS n_players, median(hands)::DOUBLE AS median_hands, sum(round(value * 100)::BIGINT)::DOUBLE / 100.0 / count(*) AS mean, {_r('coalesce(stddev_samp(value), 0.0)', 4)} AS std, {_r('quantile_cont(value, 0.25)', 4)} AS p25,
{_r('quantile_cont(value, 0.5)', 4)} AS p50, {_r('quantile_cont(value, 0.75)', 4)} AS p75, {_r('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)', 4)} AS iqr FROM long GROUP BY ALL"""


def _resp(where: str, col: str) -> str:
    cols = ", ".join(f"{_c(f'{col} = {chr(39)}{k}{chr(39)}')} AS {k}s, {_pct(_c(f'{col} = {chr(39)}{k}{chr(39)}'), 'count(*)')} AS {k}_pct" for k in ("fold", "call", "raise"))
    return f" SELECT dataset, count(*) AS opps, {cols} FROM facts WHERE {col} IS NOT NULL AND {where} GROUP BY dataset"


_D = [m for m in panel.RATES if m != "bb_fold_pct"]
EVENTS = f"""WITH e AS (SELECT 'events' AS dataset, year(ts) AS year, user_id AS player_name, event_type AS table_name, ts AS timestamp, event_id AS hand_id FROM events),
g AS (SELECT *, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1e6::DOUBLE AS gap_s FROM e WINDOW w AS (PARTITION BY year, player_name ORDER BY timestamp, hand_id)),
n AS (SELECT *, sum(CASE WHEN gap_s IS NULL OR gap_s > {GAP_S} THEN 1 ELSE 0 END) OVER (PARTITION BY year, player_name ORDER BY timestamp, hand_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM g),
s AS (SELECT dataset, year, player_name, session_no, count(*) AS hands, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 6e7::DOUBLE AS minutes, count(DISTINCT table_name) AS tables, hour(min(timestamp)) AS start_hour FROM n GROUP BY ALL),
reg AS (SELECT player_name FROM s GROUP BY ALL HAVING sum(hands) >= {REGULAR})
"""
PAIRS = _S + f""",
se AS (SELECT h.hand_id, h.dataset, h.year, h.table_name, h.timestamp, h.bb, p.player_name, p.net_won FROM hands h JOIN players p USING (hand_id) WHERE is_primary),
px AS (SELECT a.hand_id, a.dataset, a.year, a.table_name, a.timestamp, a.bb, a.player_name AS player_a, b.player_name AS player_b, a.net_won AS net_a, b.net_won AS net_b FROM se a JOIN se b ON a.hand_id = b.hand_id AND a.player_name < b.player_name),
py AS (SELECT dataset, year, player_a, player_b, count(*) AS shared_hands, count(DISTINCT timestamp::DATE) AS shared_days, count(DISTINCT (table_name, timestamp::DATE)) AS shared_sessions, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
  sum(net_a)::BIGINT AS net_a, sum(net_b)::BIGINT AS net_b, max(bb) AS bb FROM px GROUP BY ALL HAVING count(*) >= {MIN_SHARED}),
pc AS (SELECT dataset, player_a, player_b, sum(shared_hands)::BIGINT AS shared_hands, sum(shared_days)::BIGINT AS shared_days, sum(shared_sessions)::BIGINT AS shared_sessions, count(DISTINCT year) AS years_together, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
  sum(net_a)::BIGINT AS net_a, sum(net_b)::BIGINT AS net_b, max(bb) AS bb FROM py GROUP BY ALL),
vo AS (SELECT dataset, player_name, count(*) AS hands FROM se GROUP BY ALL),
lo AS (SELECT dataset, player_a AS player_name, player_b AS partner, shared_hands FROM pc UNION ALL SELECT dataset, player_b, player_a, shared_hands FROM pc)
"""
ORACLES = {
    "metrics_overall": _S + f" SELECT *, {_r('vpip_pct - pfr_pct')} AS vpip_pfr_gap_pp FROM (SELECT dataset, count(DISTINCT hand_id) AS hands, count(*) AS player_hands, {_c('vpip')} AS vpip_count, {_c('pfr')} AS pfr_count, {_pct(_c('vpip'), 'count(*)')} AS vpip_pct, {_pct(_c('pfr'), 'count(*)')} AS pfr_pct FROM facts GROUP BY dataset)",
    "metrics_by_position": _S + f" SELECT dataset, position, count(*) AS player_hands, {_pct(_c('vpip'), 'count(*)')} AS vpip_pct, {_pct(_c('pfr'), 'count(*)')} AS pfr_pct, {_c('rfi_opp')} AS rfi_opps, {_c('rfi_hit')} AS rfi_count, {_pct(_c('rfi_hit'), _c('rfi_opp'))} AS rfi_pct, {_c('rfi_ft_opp')} AS rfi_folded_to_opps, {_c('rfi_ft_hit')} AS rfi_folded_to_count, {_pct(_c('rfi_ft_hit'), _c('rfi_ft_opp'))} AS rfi_folded_to_pct FROM facts GROUP BY ALL",
    "metrics_by_year": _S + f" SELECT dataset, year, count(DISTINCT hand_id) AS hands, count(*) AS player_hands, {_pct(_c('vpip'), 'count(*)')} AS vpip_pct, {_pct(_c('pfr'), 'count(*)')} AS pfr_pct, {_c('three_bet_opp')} AS three_bet_opps, {_pct(_c('three_bet_hit'), _c('three_bet_opp'))} AS three_bet_pct, {_c(_CB)} AS cbet_opps, {_pct(_c(_CH), _c(_CB))} AS cbet_pct, {_BB} AS bb100 FROM facts GROUP BY ALL",
    "metrics_preflop": _S + " SELECT dataset, " + ", ".join(f"{_c(o)} AS {n}_opps, {_c(h)} AS {n}s, {_pct(_c(h), _c(o))} AS {n}_pct" for n, o, h in (("three_bet", "three_bet_opp", "three_bet_hit"), ("cold_four_bet", "cold_four_bet_opp", "cold_four_bet_hit"), ("four_bet", "four_bet_opp", "four_bet_hit")))
    + ", " + ", ".join(f"count({c}) AS fold_to_{n}_opps, {_c(f'{c} = {chr(39)}fold{chr(39)}')} AS fold_to_{n}_count, {_pct(_c(f'{c} = {chr(39)}fold{chr(39)}'), f'count({c})')} AS fold_to_{n}_pct, {_c(f'{c} = {chr(39)}call{chr(39)}')} AS call_{n}_count, {_pct(_c(f'{c} = {chr(39)}call{chr(39)}'), f'count({c})')} AS call_{n}_pct" for n, c in (("3bet", "vs_3bet"), ("4bet", "vs_4bet"))) + " FROM facts GROUP BY dataset",
    "metrics_postflop": _S + f""", m AS (SELECT dataset, {_c(_CB)} AS cbet_opps, {_c(_CH)} AS cbets, {_pct(_c(_CH), _c(_CB))} AS cbet_pct, {_c('is_pfa AND turn_ok')} AS turn_cbet_opps, {_pct(_c('is_pfa AND turn_ok AND bet_turn'), _c('is_pfa AND turn_ok'))} AS turn_cbet_pct,
 {_c('is_pfa AND river_ok')} AS river_cbet_opps, {_pct(_c('is_pfa AND river_ok AND bet_river'), _c('is_pfa AND river_ok'))} AS river_cbet_pct, {_c(_CH + ' AND bet_turn')} AS double_barrels, {_pct(_c(_CH + ' AND bet_turn'), _c(_CH))} AS double_barrel_pct, {_c(_CH + ' AND bet_turn AND bet_river')} AS triple_barrels FROM facts GROUP BY dataset),
 r AS (SELECT dataset, count(*) AS fold_to_cbet_opps, {_c("response = 'fold'")} AS fold_to_cbet_count, {_pct(_c("response = 'fold'"), 'count(*)')} AS fold_to_cbet_pct FROM cr GROUP BY dataset), xq AS (SELECT dataset, {_XR} FROM xr GROUP BY dataset)
 SELECT * FROM m LEFT JOIN r USING (dataset) LEFT JOIN xq USING (dataset)""",
    "metrics_check_raise": _S + f" SELECT dataset, {_XR} FROM xr GROUP BY dataset",
    "metrics_bb100": _S + f""", p AS (SELECT 'overall' AS granularity, dataset, NULL::BIGINT AS year, count(DISTINCT hand_id) AS hands, count(*) AS player_hands, {_BB} AS bb100 FROM facts GROUP BY dataset UNION ALL SELECT 'year', dataset, year, count(DISTINCT hand_id), count(*), {_BB} FROM facts GROUP BY dataset, year),
 ra AS (SELECT dataset, NULL::BIGINT AS year, coalesce(rake, 0) AS rake, bb FROM hands WHERE is_primary UNION ALL SELECT dataset, year, coalesce(rake, 0), bb FROM hands WHERE is_primary),
 r AS (SELECT dataset, year, {_r('-100.0::DOUBLE * sum(rake) / max(bb) / (count(*) * 6)')} AS rake_bb100_equiv, {_pct(_c('rake > 0'), 'count(*)', 1)} AS pct_hands_raked, {_r('sum(rake)::DOUBLE / max(bb) / nullif(' + _c('rake > 0') + ', 0)', 3)} AS avg_rake_bb_when_raked FROM ra GROUP BY dataset, year)
 SELECT granularity, p.dataset, p.year, hands, player_hands, bb100, rake_bb100_equiv, pct_hands_raked, avg_rake_bb_when_raked FROM p JOIN r ON p.dataset = r.dataset AND p.year IS NOT DISTINCT FROM r.year""",
    "matchup_btn_vs_bb": _S + _resp("opener_position = 'BTN'", "bb_response"),
    "matchup_bb_defense": _S + _resp("true", "bb_response"),
    "matchup_sb_first_in": _S + _resp("position = 'SB' AND rfi_ft_opp", "first_action"),
    "three_bet_sizing": _S + " SELECT dataset, count(*) AS three_bets, sum(amount)::DOUBLE / max(bb) / count(*) AS mean_bb, median(amount::DOUBLE / bb) AS median_bb, (sum(amount) FILTER (amount::DOUBLE / bb < 40))::DOUBLE / max(bb) / count(*) FILTER (amount::DOUBLE / bb < 40) AS mean_bb_without_large FROM pr JOIN (SELECT hand_id, dataset, bb FROM hands) USING (hand_id) WHERE raise_n = 2 GROUP BY dataset",
    "recombine_rates": _S + f" SELECT dataset, count(*) AS player_hands, {_c('vpip')} AS vpip_count, {_c('pfr')} AS pfr_count, {_c('three_bet_hit')} AS three_bets, {_c('three_bet_opp')} AS three_bet_opps, {_pct(_c('vpip'), 'count(*)')} AS vpip_pct, {_pct(_c('pfr'), 'count(*)')} AS pfr_pct, {_pct(_c('three_bet_hit'), _c('three_bet_opp'))} AS three_bet_pct, {_BB} AS bb100 FROM facts GROUP BY dataset",
    "player_year": _P + f" SELECT * FROM panel WHERE hands >= {MIN_HANDS}",
    "player_dispersion": _P + _spread(panel.RATES),
    "bb100_dispersion": _P + _spread(("bb100",)),
    "player_stayers": _P + f", q AS (SELECT *, count(*) OVER k AS years_active, (sum(hands) OVER k)::BIGINT AS hands_total FROM panel WHERE hands >= {MIN_HANDS} WINDOW k AS (PARTITION BY dataset, player_name)) SELECT dataset, player_name, year, hands, years_active, hands_total, row_number() OVER o AS year_index, " + ", ".join(f"{m} - lag({m}) OVER o AS d_{m}" for m in _D) + f" FROM q WHERE years_active >= {MIN_YEARS} WINDOW o AS (PARTITION BY dataset, player_name ORDER BY year)",
    "panel_overview": _P + " SELECT dataset, count(*) AS player_years, count(DISTINCT player_name) AS players, min(year) AS first_year, max(year) AS last_year, median(hands)::DOUBLE AS median_hands FROM panel GROUP BY dataset",
    "cohort_retention": _P + f", f AS (SELECT dataset, player_name, min(year) AS cohort FROM panel GROUP BY ALL), z AS (SELECT dataset, cohort, count(*) AS cohort_players FROM f GROUP BY ALL) SELECT dataset, cohort, year - cohort AS age, count(DISTINCT player_name) AS players, max(cohort_players) AS cohort_players, {_pct('count(DISTINCT player_name)', 'max(cohort_players)')} AS retention_pct FROM panel JOIN f USING (dataset, player_name) JOIN z USING (dataset, cohort) GROUP BY ALL",
    "table_gaps": EVENTS + f", t AS (SELECT *, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY year, table_name ORDER BY timestamp, hand_id))) / 1e6::DOUBLE AS tg FROM e) SELECT dataset, year, count(*) AS hands, count(DISTINCT table_name) AS tables, {_r('quantile_cont(tg, 0.1)', 1)} AS gap_p10_s, {_r('quantile_cont(tg, 0.5)', 1)} AS gap_p50_s, {_r('quantile_cont(tg, 0.9)', 1)} AS gap_p90_s, {_pct(_c('tg <= 120'), 'count(*)')} AS pct_gaps_le_2min, {_pct(_c('tg > 3600'), 'count(*)')} AS pct_gaps_gt_1h FROM t WHERE tg IS NOT NULL GROUP BY ALL",
    "player_sessions": EVENTS + " SELECT player_name, hand_id, gap_s, session_no FROM n",
    "session_table": EVENTS + " SELECT * FROM s",
    "session_summary": EVENTS + f", a AS (SELECT dataset, year, count(DISTINCT player_name) AS regulars, {_r('quantile_cont(gap_s, 0.5)', 1)} AS player_gap_p50_s, {_pct(_c('gap_s <= 120'), 'count(*)')} AS pct_player_gaps_le_2min, {_pct(_c('gap_s > 86400'), 'count(*)')} AS pct_player_gaps_gt_1day FROM n WHERE gap_s IS NOT NULL AND player_name IN (SELECT player_name FROM reg) GROUP BY ALL), b AS (SELECT dataset, year, count(*) AS sessions, quantile_cont(hands, 0.5)::DOUBLE AS session_hands_p50, {_r('quantile_cont(minutes, 0.5)', 1)} AS session_minutes_p50, quantile_cont(tables, 0.5)::DOUBLE AS session_tables_p50, {_pct(_c('hands = 1'), 'count(*)')} AS pct_single_hand_sessions FROM s WHERE player_name IN (SELECT player_name FROM reg) GROUP BY ALL) SELECT * FROM a JOIN b USING (dataset, year)",
    "session_player_year": EVENTS + f" SELECT dataset, year, player_name, sum(hands)::BIGINT AS hands, count(*) AS sessions, {_r('median(hands)', 1)} AS session_hands_median, {_r('median(minutes)', 1)} AS session_minutes_median, {_r('max(minutes)', 1)} AS session_minutes_max, {_r('sum(round(minutes * 6e7)::BIGINT)::DOUBLE / 3.6e9::DOUBLE', 1)} AS hours_played, max(tables) AS max_tables, {_pct(_c('hands = 1'), 'count(*)')} AS pct_single_hand_sessions, {_r('median(start_hour)', 1)} AS start_hour_median FROM s GROUP BY ALL HAVING sum(hands) >= {REGULAR}",
    "pairs_expand": PAIRS + " SELECT dataset, year, table_name, count(*) AS pair_hands, count(DISTINCT (player_a, player_b)) AS pairs, sum(net_a)::BIGINT AS net_a, sum(net_b)::BIGINT AS net_b FROM px GROUP BY ALL",
    "pairs_year": PAIRS + " SELECT * FROM py",
    "pairs_career": PAIRS + " SELECT * FROM pc",
    "pairs_export": PAIRS + f" SELECT pc.dataset, player_a, player_b, shared_hands, shared_days, shared_sessions, years_together, first_seen, last_seen, a.hands AS hands_a, b.hands AS hands_b, {_pct('shared_hands', 'a.hands')} AS share_of_a_pct, {_pct('shared_hands', 'b.hands')} AS share_of_b_pct, {_r('net_a::DOUBLE / bb')} AS net_bb_a_in_shared, {_r('net_b::DOUBLE / bb')} AS net_bb_b_in_shared FROM pc LEFT JOIN vo a ON a.dataset = pc.dataset AND a.player_name = player_a LEFT JOIN vo b ON b.dataset = pc.dataset AND b.player_name = player_b WHERE shared_hands >= {CAREER}",
    "pairs_players": PAIRS + f", g AS (SELECT dataset, player_name, count(*) AS unique_opponents, {_c(f'shared_hands >= {CAREER}')} AS m, {_c('shared_hands >= 500')} AS n500, {_c('shared_hands >= 1000')} AS n1000 FROM lo GROUP BY ALL), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, player_name ORDER BY shared_hands DESC, partner) AS rn FROM lo) WHERE rn = 1) SELECT vo.dataset, vo.player_name, vo.hands, coalesce(unique_opponents, 0) AS unique_opponents, coalesce(m, 0) AS unique_opponents_min_shared, partner AS top_partner, shared_hands AS top_partner_hands, {_pct('shared_hands', 'vo.hands')} AS top_partner_share_pct, coalesce(n500, 0) AS n_partners_ge_500, coalesce(n1000, 0) AS n_partners_ge_1000 FROM vo LEFT JOIN g USING (dataset, player_name) LEFT JOIN t ON t.dataset = vo.dataset AND t.player_name = vo.player_name WHERE vo.hands >= {MIN_HANDS}",
    "pairs_summary": PAIRS + f", k AS (SELECT dataset, shared_hands, row_number() OVER (PARTITION BY dataset ORDER BY shared_hands DESC) AS rn, count(*) OVER (PARTITION BY dataset) AS np FROM pc), c AS (SELECT dataset, {_pct('sum(shared_hands) FILTER (rn <= 100)', 'sum(shared_hands)')} AS top100_pair_hands_pct, {_pct('sum(shared_hands) FILTER (rn <= greatest(1, floor(np * 0.01::DOUBLE + 0.5)))', 'sum(shared_hands)')} AS top1pct_pairs_hands_pct FROM k GROUP BY dataset), v AS (SELECT dataset, floor(sum(hands) / 6.0::DOUBLE + 0.5)::BIGINT AS primary_hands, count(*) AS n_players, {_c(f'hands >= {MIN_HANDS}')} AS n_players_min_hands FROM vo GROUP BY dataset), n AS (SELECT dataset, count(*) AS n_pairs_slice_min, " + ", ".join(f"{_c(f'shared_hands >= {m}')} AS n_pairs_ge_{m}" for m in (100, 200, 500, 1000, 5000)) + f", max(shared_hands) AS max_shared_hands, {_r('quantile_cont(shared_hands, 0.5)', 1)} AS p50_shared, {_r('quantile_cont(shared_hands, 0.9)', 1)} AS p90_shared, {_r('quantile_cont(shared_hands, 0.99)', 1)} AS p99_shared FROM pc GROUP BY dataset) SELECT * FROM n JOIN c USING (dataset) JOIN v USING (dataset)",
}
