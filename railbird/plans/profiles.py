"""Queries: audits, checks and outlier profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from railbird.operators import audits, checks, metrics, outliers, panel, sequence
from railbird.plans import hands as hq
from railbird.plans import population as pop
from railbird.plans.population import MIN_HANDS, _c, _pct, _r
from railbird.plans.stored import stored
from railbird.session import table
from railbird.sources import fixture

PEERS = 30


def _h(spark, sf_dir):
    return fixture.hands(spark, sf_dir)


def audit_hand_counts(spark, sf_dir):
    return audits.hand_counts(_h(spark, sf_dir), years=hq.YEARS)


def audit_monthly(spark, sf_dir):
    return audits.monthly(_h(spark, sf_dir), hq.YEARS)


def audit_players_dealt(spark, sf_dir):
    return audits.players_dealt(_h(spark, sf_dir), hq.YEARS)


def audit_dealt_distribution(spark, sf_dir):
    text = F.concat_ws(",", F.transform(F.map_entries("dealt_distribution"), lambda x: F.concat(x["key"], F.lit(":"), x["value"])))
    return audits.dealt_distribution(_h(spark, sf_dir)).select("dataset", "year", text.alias("dealt_distribution"))


def audit_unique_players(spark, sf_dir):
    h, p = fixture.hands_players(spark, sf_dir)
    return audits.unique_players(h, p, years=hq.YEARS)


def audit_unique_players_sketch(spark, sf_dir):
    """The same from sketches of each slice; small counts come out exact, larger ones within about 1 %."""
    h, p = fixture.hands_players(spark, sf_dir)
    return audits.unique_players(h, p, approximate=True, years=hq.YEARS)


def _dup(spark, sf_dir):
    return fixture.with_duplicates(_h(spark, sf_dir))


def audit_duplicates_summary(spark, sf_dir):
    return audits.duplicates_summary(_dup(spark, sf_dir))


def audit_duplicates_by_dataset(spark, sf_dir):
    return audits.duplicates_by_dataset(_dup(spark, sf_dir))


def audit_duplicates_top(spark, sf_dir):
    d = audits.duplicates_top(_dup(spark, sf_dir))
    return d.select("hand_id", "count", "first_dataset", "first_file", "cross_dataset", F.concat_ws(",", "datasets").alias("datasets"), F.concat_ws(",", F.transform("occurrences", lambda x: x["file"])).alias("files"))


YEARS = list(range(1995, 2003))


def audit_coverage_matrix(spark, sf_dir):
    return audits.coverage_matrix(_h(spark, sf_dir), YEARS, hq.YEARS)


def corpus_metadata(spark, sf_dir):
    return audits.metadata(_h(spark, sf_dir))


def stratified_pick(spark, sf_dir):
    return audits.stratified_pick(_h(spark, sf_dir).select("dataset", "year", "source_file"))


def _counted(spark, sf_dir):
    """The facts, computed once and summed up, for checks of several metrics; a few hundred rows."""
    return stored(metrics.counted(pop.facts(spark, sf_dir), "dataset", "year", "position"))


def _bb100(spark, sf_dir, counted):
    return metrics.bb100(counted, sequence.primary_hands(_h(spark, sf_dir)))


def _long(spark, sf_dir):
    c = _counted(spark, sf_dir)
    o = metrics.overall(c, "dataset").select("dataset", "vpip_pct", "pfr_pct")
    b = metrics.by_position(c).filter("position = 'BTN'").select("dataset", F.col("rfi_folded_to_pct").alias("btn_rfi_folded_to_pct"))
    p = metrics.preflop(c, "dataset").select("dataset", "three_bet_pct", "cold_four_bet_pct", "fold_to_3bet_pct", "call_3bet_pct", "fold_to_4bet_pct")
    q = metrics.postflop(c).select("dataset", "cbet_pct", "fold_to_cbet_pct", "check_raise_flop_pct")
    r = _bb100(spark, sf_dir, c).filter("granularity = 'overall'").select("dataset", "bb100")
    wide = o.join(b, "dataset", "left").join(p, "dataset", "left").join(q, "dataset", "left").join(r, "dataset", "left")
    return wide.unpivot(["dataset"], list(checks.RANGES), "metric", "value")


def check_ranges(spark, sf_dir):
    return checks.ranges(_long(spark, sf_dir))


def check_invariants(spark, sf_dir):
    c = _counted(spark, sf_dir)
    return checks.invariants(metrics.overall(c, "dataset"), metrics.by_position(c), metrics.postflop(c), _bb100(spark, sf_dir, c))


def check_zero_sum(spark, sf_dir):
    h, p = fixture.hands_players(spark, sf_dir)
    return checks.zero_sum(h.filter("is_primary"), p)


def check_rake_drag(spark, sf_dir):
    return checks.rake_drag(pop.metrics_bb100(spark, sf_dir))


def _panel(spark, sf_dir):
    return panel.player_year(pop.facts(spark, sf_dir))


def quality_checks(spark, sf_dir):
    text = F.concat_ws(",", F.transform(F.map_entries("by_dataset"), lambda x: F.concat(x["key"], F.lit(":"), x["value"])))
    return outliers.quality_checks(_panel(spark, sf_dir)).select("check", "rows", text.alias("by_dataset"))


def panel_clean(spark, sf_dir):
    c = outliers.clean(_panel(spark, sf_dir))
    return c.groupBy("dataset").agg(F.count("*").alias("rows"), F.median("bb100").alias("median_bb100"))


def histogram_density(spark, sf_dir):
    return outliers.histogram(_panel(spark, sf_dir), "bb100", -300.0, 600.0, 90, "dataset")


def _peers(spark, sf_dir):
    return outliers.peers(_panel(spark, sf_dir), MIN_HANDS, PEERS)


def peer_filter(spark, sf_dir):
    return _peers(spark, sf_dir).select("dataset", "year", "player_name", "hands", "vpip_pfr_gap", "peers")


def zscores(spark, sf_dir):
    z = outliers.zscores(_peers(spark, sf_dir))
    return z.select("dataset", "year", "player_name", *[metrics.rounded(F.col(f"z_{c}"), 4).alias(f"z_{c}") for c in outliers.STYLE])


def style_correlation(spark, sf_dir):
    return outliers.correlation(_peers(spark, sf_dir))


def _flagged(spark, sf_dir):
    return outliers.reasons(outliers.zscores(_peers(spark, sf_dir))).filter("farthest >= 2.5")


def outlier_reasons(spark, sf_dir):
    return _flagged(spark, sf_dir).select("dataset", "year", "player_name", "why")


def reason_share(spark, sf_dir):
    return outliers.reason_share(_flagged(spark, sf_dir))


def pca_map(spark, sf_dir):
    return outliers.pca(table(spark, sf_dir, "embeddings"))


def pca_components(spark, sf_dir):
    return outliers.pca_loadings(table(spark, sf_dir, "embeddings"))


def isolation_forest(spark, sf_dir):
    return outliers.isolation_forest(table(spark, sf_dir, "embeddings"))


def lof(spark, sf_dir):
    s = outliers.lof(table(spark, sf_dir, "embeddings"))
    return s.select("vec_id", metrics.rounded(F.col("lof_score"), 5).alias("lof_score"), "lof_flag")


def outlier_agreement(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return outliers.agreement(outliers.isolation_forest(v), outliers.lof(v))


QUERIES = {
    f.__name__: f
    for f in (
        audit_hand_counts, audit_monthly, audit_players_dealt, audit_dealt_distribution, audit_unique_players, audit_unique_players_sketch, audit_duplicates_summary, audit_duplicates_by_dataset, audit_duplicates_top, audit_coverage_matrix, corpus_metadata, stratified_pick,
        check_ranges, check_invariants, check_zero_sum, check_rake_drag, quality_checks, panel_clean, histogram_density, peer_filter, zscores, style_correlation, outlier_reasons, reason_share, pca_map, pca_components, isolation_forest, lof, outlier_agreement,
    )
}

_F, _P = fixture.SQL, pop._P
_D = fixture.SQL + hq.DUPLICATED
_AUD = "is_usd AND NOT is_cap"
_LIST = "list_position(['NL50', 'NL200', 'NL5K'], dataset)"
_Z = pop._P + (
    f", pe AS (SELECT *, {_r('vpip_pct - pfr_pct')} AS vpip_pfr_gap FROM panel WHERE hands >= {MIN_HANDS} AND " + " AND ".join(f"{c} IS NOT NULL" for c in outliers.STYLE if c != "vpip_pfr_gap")
    + f"), pg AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY dataset, year) AS peers FROM pe) WHERE peers >= {PEERS}), zs AS (SELECT *, "
    + ", ".join(f"({c} - avg({c}) OVER k) / nullif(stddev_samp({c}) OVER k, 0) AS z_{c}" for c in outliers.STYLE) + " FROM pg WINDOW k AS (PARTITION BY dataset, year))"
)
_FLAG = (
    _Z + ", it AS (" + " UNION ALL ".join(f"SELECT dataset, year, player_name, '{c}' AS name, z_{c} AS z FROM zs" for c in outliers.STYLE)
    + "), rk AS (SELECT *, row_number() OVER (PARTITION BY dataset, year, player_name ORDER BY abs(z) DESC, name) AS n FROM it), fl AS (SELECT dataset, year, player_name, string_agg(name || ' ' || CASE WHEN z >= 0 THEN '+' ELSE '-' END || printf('%.1f', abs(z)) || 'σ', ', ' ORDER BY n) FILTER (n <= 3) AS why, max(name) FILTER (n = 1) AS dominant, max(abs(z)) AS farthest FROM rk GROUP BY ALL HAVING max(abs(z)) >= 2.5)"
)
_METRICS = {"metrics_overall": ("vpip_pct", "pfr_pct"), "metrics_preflop": ("three_bet_pct", "cold_four_bet_pct", "fold_to_3bet_pct", "call_3bet_pct", "fold_to_4bet_pct"), "metrics_postflop": ("cbet_pct", "fold_to_cbet_pct", "check_raise_flop_pct")}


def _sub(name: str) -> str:
    return f"({pop.ORACLES[name]})"


ORACLES = {
    "audit_hand_counts": _F + f" SELECT dataset, year, count(*) AS total, {_c('is_usd')} AS usd, {_c('NOT is_usd')} AS non_usd, {_c('is_cap')} AS cap, {_c('NOT is_cap')} AS non_cap, {_c(_AUD)} AS included FROM hands GROUP BY ROLLUP (dataset, year)",
    "audit_monthly": _F + f" SELECT dataset, strftime(timestamp, '%Y-%m') AS year_month, {_c(_AUD)} AS included_hands, count(*) AS total_hands FROM hands GROUP BY ALL",
    "audit_players_dealt": _F + f" SELECT dataset, year, count(*) AS hands, {_c('num_players_dealt = 6')} AS hands_6_dealt, {_c(_AUD)} AS included, {_c(_AUD + ' AND num_players_dealt = 6')} AS included_6_dealt, {_pct(_c('num_players_dealt = 6'), 'count(*)')} AS pct_6_dealt, {_pct(_c(_AUD + ' AND num_players_dealt = 6'), _c(_AUD))} AS pct_included_6 FROM hands GROUP BY ROLLUP (dataset, year)",
    "audit_dealt_distribution": _F + " SELECT dataset, year, string_agg(num_players_dealt || ':' || n, ',' ORDER BY num_players_dealt) AS dealt_distribution FROM (SELECT dataset, year, num_players_dealt, count(*) AS n FROM hands GROUP BY ALL) GROUP BY ALL",
    "audit_unique_players": _F + f" SELECT dataset, year, count(DISTINCT player_name) AS unique_players, count(DISTINCT hand_id) AS included_hands, count(*) AS player_hand_instances, {_r('count(*)::DOUBLE / count(DISTINCT player_name)')} AS avg_hands_per_player FROM (SELECT h.dataset, h.year, h.hand_id, p.player_name FROM hands h JOIN players p USING (hand_id) WHERE {_AUD}) GROUP BY ROLLUP (dataset, year)",
    "audit_duplicates_summary": _D + f", g AS (SELECT hand_id, count(*) AS n, count(DISTINCT dataset) AS nd FROM dup GROUP BY ALL HAVING count(*) > 1) SELECT count(*) AS duplicate_ids, coalesce(sum(n - 1), 0)::BIGINT AS extra_occurrences, {_c('nd = 1')} AS within_dataset, {_c('nd > 1')} AS cross_dataset FROM g",
    "audit_duplicates_by_dataset": _D + " SELECT dataset, count(DISTINCT hand_id) AS duplicate_ids FROM dup WHERE hand_id IN (SELECT hand_id FROM dup GROUP BY ALL HAVING count(*) > 1) GROUP BY dataset",
    "audit_duplicates_top": _D + f", t AS (SELECT hand_id, count(*) AS count FROM dup GROUP BY ALL HAVING count(*) > 1 ORDER BY count DESC, hand_id LIMIT 100), o AS (SELECT dup.*, t.count, row_number() OVER (PARTITION BY hand_id ORDER BY {_LIST}, year, source_file, block_no) AS occ FROM dup JOIN t USING (hand_id)) SELECT hand_id, count, arg_min(dataset, occ) AS first_dataset, arg_min(source_file, occ) AS first_file, count(DISTINCT dataset) > 1 AS cross_dataset, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets, string_agg(source_file, ',' ORDER BY occ) AS files FROM o WHERE occ <= 5 GROUP BY hand_id, count",
    "audit_coverage_matrix": _F + " SELECT dataset, " + ", ".join(f"{_c(_AUD + f' AND year = {y}')} AS n_{y}" for y in YEARS) + ", " + ", ".join(f"{_r('log10(' + _c(_AUD + f' AND year = {y}') + ' + 1.0)', 6)} AS log_{y}" for y in YEARS) + " FROM hands GROUP BY dataset",
    "corpus_metadata": _F + f" SELECT dataset, year, {_c('is_primary')} AS primary_hands, {_c('is_included')} AS included_hands FROM hands GROUP BY GROUPING SETS ((dataset, year), (dataset), ())",
    "stratified_pick": _F + " SELECT dataset, year, arg_min(source_file, md5('42/' || source_file)) AS source_file FROM hands GROUP BY ALL",
    "check_ranges": "WITH l AS (" + " UNION ALL ".join([f"SELECT dataset, '{m}' AS metric, {m} AS value FROM {_sub(q)}" for q, ms in _METRICS.items() for m in ms] + [f"SELECT dataset, 'btn_rfi_folded_to_pct', rfi_folded_to_pct FROM {_sub('metrics_by_position')} WHERE position = 'BTN'", f"SELECT dataset, 'bb100', bb100 FROM {_sub('metrics_bb100')} WHERE granularity = 'overall'"])
    + "), r(metric, low, high) AS (VALUES " + ", ".join(f"('{k}', {lo}::DOUBLE, {hi}::DOUBLE)" for k, (lo, hi) in checks.RANGES.items()) + ") SELECT dataset, metric, value, low, high, coalesce(value BETWEEN low AND high, false) AS ok FROM l JOIN r USING (metric)",
    "check_invariants": f"SELECT dataset, 'pfr_le_vpip' AS name, pfr_pct <= vpip_pct AS ok FROM {_sub('metrics_overall')} UNION ALL SELECT dataset, 'btn_rfi_gt_lj_rfi', max(rfi_pct) FILTER (position = 'BTN') > max(rfi_pct) FILTER (position = 'LJ') FROM {_sub('metrics_by_position')} GROUP BY dataset UNION ALL SELECT dataset, 'double_barrels_le_cbets', double_barrels <= cbets FROM {_sub('metrics_postflop')} UNION ALL SELECT 'all', 'rake_order', max(r) FILTER (dataset = 'NL50') <= max(r) FILTER (dataset = 'NL200') AND max(r) FILTER (dataset = 'NL200') <= max(r) FILTER (dataset = 'NL5K') FROM (SELECT dataset, rake_bb100_equiv AS r FROM {_sub('metrics_bb100')} WHERE granularity = 'overall')",
    "check_zero_sum": _F + f", z AS (SELECT h.dataset, sum(p.net_won) + max(coalesce(h.rake, 0)) AS r FROM hands h JOIN players p USING (hand_id) WHERE is_primary GROUP BY h.hand_id, h.dataset) SELECT dataset, count(*) AS hands, {_c('abs(r) > 1')} AS bad_hands, {_pct(_c('abs(r) > 1'), 'count(*)', 3)} AS bad_pct, sum(r)::BIGINT AS residual_cents, {_c('abs(r) > 1')} = 0 AS ok FROM z GROUP BY dataset",
    "check_rake_drag": f"SELECT dataset, bb100, rake_bb100_equiv, {_r('abs(bb100 - rake_bb100_equiv)')} AS gap, {_r('abs(bb100 - rake_bb100_equiv)')} <= 0.5 AS ok FROM {_sub('metrics_bb100')} WHERE granularity = 'overall'",
    "quality_checks": _P + ", q AS (" + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", dataset, count(*) FILTER ({v}) AS n FROM panel GROUP BY dataset" for k, v in outliers.QUALITY.items()) + ") SELECT \"check\", sum(n)::BIGINT AS rows, coalesce(string_agg(dataset || ':' || n, ',' ORDER BY dataset) FILTER (n > 0), '') AS by_dataset FROM q GROUP BY \"check\"",
    "panel_clean": _P + " SELECT dataset, count(*) AS rows, median(CASE WHEN dataset <> 'NL50' THEN bb100 END) AS median_bb100 FROM panel WHERE cbets <= cbet_opps AND vpip_pct <> 0 GROUP BY dataset",
    "histogram_density": _P + f", b AS (SELECT dataset, least(floor((least(greatest(bb100, -300.0), 600.0) + 300.0) / 10.0), 89)::BIGINT AS bin FROM panel WHERE bb100 IS NOT NULL), c AS (SELECT dataset, bin, count(*) AS n FROM b GROUP BY ALL) SELECT dataset, bin, n, {_r('n::DOUBLE / (sum(n) OVER (PARTITION BY dataset) * 10.0::DOUBLE)', 8)} AS density, (bin * 10.0 - 300.0)::DOUBLE AS bin_low FROM c",
    "peer_filter": _Z + " SELECT dataset, year, player_name, hands, vpip_pfr_gap, peers FROM pg",
    "zscores": _Z + " SELECT dataset, year, player_name, " + ", ".join(f"{_r(f'z_{c}', 4)} AS z_{c}" for c in outliers.STYLE) + " FROM zs",
    "style_correlation": _Z + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_r(f'corr({a}, {b})', 6)} AS corr FROM pg" for a in outliers.STYLE for b in outliers.STYLE if a < b),
    "outlier_reasons": _FLAG + " SELECT dataset, year, player_name, why FROM fl",
    "reason_share": _FLAG + f" SELECT dominant, count(*) AS n, {_r('count(*)::DOUBLE / sum(count(*)) OVER ()', 4)} AS share FROM fl GROUP BY dominant",
    "lof": f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.id, b.id AS other, sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))) AS dist FROM e a JOIN e b ON a.id <> b.id),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS rk FROM d) WHERE rk <= 35), k AS (SELECT id AS other, max(dist) AS kd FROM n GROUP BY id), l AS (SELECT id, 1 / avg(greatest(dist, kd)) AS lrd FROM n JOIN k USING (other) GROUP BY id),
s AS (SELECT n.id, avg(f.lrd) AS m FROM n JOIN l f ON f.id = n.other GROUP BY n.id), x AS (SELECT s.id, m / lrd AS lof FROM s JOIN l USING (id)) SELECT id AS vec_id, {_r('lof', 5)} AS lof_score, lof > (SELECT quantile_cont(lof, 0.99) FROM x) AS lof_flag FROM x""",
}
ORACLES["audit_unique_players_sketch"] = ORACLES["audit_unique_players"]
