"""Queries on the hand fixture: ingest round trips and the action-sequence views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.operators import ingest, sequence
from railbird.sources import fixture, handtext

#: The test tables' hands are older than the study.
YEARS = (1995, 2025)
Q = "hand_id, dataset, timestamp, year, month, stakes_raw, sb, bb, is_usd, is_cap, is_ante, is_included, is_primary, table_name, max_players, button_seat, num_players_dealt"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, p = fixture.hands_players(spark, sf_dir)
    return handtext.render(h, p, fixture.actions(spark, sf_dir))


def _ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parsed(ingest.folder_fields(ingest.blocks(_texts(spark, sf_dir))))


def _broken(texts: DataFrame) -> DataFrame:
    """Texts with a hand in five broken: header, table line, marker or seats taken away."""
    b = ingest.blocks(texts)
    k = F.regexp_extract("block", ingest.HEADER, 1).cast("long")
    kind = F.when(k % 5 == 0, k.cast("long").bitwiseAND(3))
    cut = (
        F.when(kind == 0, F.regexp_replace("block", r"#\d+:", "#:"))
        .when(kind == 1, F.regexp_replace("block", r"(?m)^Table .*\n", ""))
        .when(kind == 2, F.regexp_replace("block", r"\*\*\* HOLE CARDS \*\*\*\n", ""))
        .when(kind == 3, F.regexp_replace("block", r"(?m)^Seat \d+: .* in chips\)\n", ""))
        .otherwise(F.col("block"))
    )
    return b.withColumn("block", cut)


def ingest_scan(spark, sf_dir):
    t = ingest.folder_fields(_texts(spark, sf_dir))
    return t.select("source_file", "dataset", "file_year")


def ingest_blocks(spark, sf_dir):
    b = ingest.blocks(_texts(spark, sf_dir))
    return b.select("source_file", F.regexp_extract("block", ingest.HEADER, 1).alias("hand_id"), F.col("block_no").cast("long").alias("block_no"))


def ingest_hands(spark, sf_dir):
    return ingest.hands_of(_ok(spark, sf_dir).filter("status = 'ok'"), YEARS).select(*Q.split(", "))


def ingest_hand_summary(spark, sf_dir):
    cols = "hand_id, num_players_flop, pot_total, rake, board_flop, board_turn, board_river, last_street, had_showdown".split(", ")
    return ingest.hands_of(_ok(spark, sf_dir).filter("status = 'ok'"), YEARS).select(*cols)


def ingest_players(spark, sf_dir):
    # These columns of the players come of the seats' lines alone.
    return ingest.seat_rows(_ok(spark, sf_dir).filter("status = 'ok'"))


def ingest_net_won(spark, sf_dir):
    return ingest.players_of(_ok(spark, sf_dir).filter("status = 'ok'")).select("hand_id", "player_name", "net_won")


def ingest_showdown(spark, sf_dir):
    return ingest.shown_cards(_ok(spark, sf_dir).filter("status = 'ok'"))


def ingest_actions(spark, sf_dir):
    a = ingest.actions_of(_ok(spark, sf_dir).filter("status = 'ok' and not is_ante"))
    return a.select("hand_id", "action_index", "street", "player_name", "action_type", "amount")


def ingest_rejects(spark, sf_dir):
    b = ingest.folder_fields(_broken(_texts(spark, sf_dir)))
    return ingest.parsed(b).groupBy("status", F.coalesce("message", F.lit("")).alias("message")).agg(F.count("*").alias("n"))


def ingest_stats(spark, sf_dir):
    return ingest.slice_stats(_ok(spark, sf_dir), YEARS)


def dedupe_first_wins(spark, sf_dir):
    h = fixture.with_duplicates(fixture.hands(spark, sf_dir))
    return ingest.first_wins(h.select("hand_id", "dataset", "year", "source_file", "block_no")).withColumn("block_no", F.col("block_no").cast("long"))


def scan_pruned(spark, sf_dir):
    h = fixture.hands(spark, sf_dir).filter("dataset = 'NL200' AND year = 1997")
    return h.groupBy("dataset", "year").agg(F.count("*").alias("hands"), F.sum("pot_total").alias("pot"))


def primary_players(spark, sf_dir):
    h, p = fixture.hands_players(spark, sf_dir)
    return sequence.primary_players(h, p).select("hand_id", "player_name", "position", "net_won", "dataset", "year", "bb")


def _pa(spark, sf_dir):
    return sequence.primary_actions(fixture.hands(spark, sf_dir), fixture.actions(spark, sf_dir))


def primary_actions(spark, sf_dir):
    return _pa(spark, sf_dir).select("hand_id", "action_index", "street", "player_name", "action_type", "amount", "dataset", "bb")


def preflop_raises(spark, sf_dir):
    return sequence.preflop_raises(_pa(spark, sf_dir))


def preflop_aggressor(spark, sf_dir):
    return sequence.preflop_aggressor(_pa(spark, sf_dir))


def first_voluntary(spark, sf_dir):
    return sequence.first_voluntary(_pa(spark, sf_dir))


def player_first(spark, sf_dir):
    return sequence.player_first(_pa(spark, sf_dir))


def response_after_event(spark, sf_dir):
    return sequence.response_after_event(_pa(spark, sf_dir))


def check_then_raise(spark, sf_dir):
    return sequence.check_then_raise(_pa(spark, sf_dir)).filter("opp")


QUERIES = {
    f.__name__: f
    for f in (
        ingest_scan, ingest_blocks, ingest_hands, ingest_players, ingest_actions, ingest_hand_summary, ingest_net_won, ingest_showdown, ingest_rejects, ingest_stats, dedupe_first_wins, scan_pruned,
        primary_players, primary_actions, preflop_raises, preflop_aggressor, first_voluntary, player_first, response_after_event, check_then_raise,
    )
}
_F, _S = fixture.SQL, fixture.SQL + sequence.SQL
DUPLICATED = """,
dh AS (SELECT hand_id, dataset, year, 0::BIGINT AS block_no FROM hands UNION ALL SELECT hand_id, dataset, year, 1 FROM hands WHERE hand_id::BIGINT % 50 = 0
  UNION ALL SELECT hand_id, CASE dataset WHEN 'NL50' THEN 'NL200' WHEN 'NL200' THEN 'NL5K' ELSE 'NL50' END, year, 2 FROM hands WHERE hand_id::BIGINT % 150 = 0),
dup AS (SELECT *, dataset || '/' || year || '/f' || (hand_id::BIGINT % 7) || '.txt' AS source_file FROM dh)
"""
ORACLES = {
    "ingest_scan": _F + " SELECT DISTINCT source_file, dataset, year AS file_year FROM hands",
    "ingest_blocks": _F + " SELECT source_file, hand_id, row_number() OVER (PARTITION BY source_file ORDER BY hand_id::BIGINT) - 1 AS block_no FROM hands WHERE is_usd OR NOT is_usd",
    "ingest_hands": _F + f" SELECT {Q} FROM hands WHERE is_usd",
    "ingest_hand_summary": _F + " SELECT hand_id, num_players_flop, pot_total, rake, board_flop, board_turn, board_river, last_street, had_showdown FROM hands WHERE is_usd",
    "ingest_players": _F + " SELECT hand_id, player_name, seat, CASE WHEN num_players_dealt = 5 AND position = 'LJ' THEN NULL ELSE position END AS position, stack_start FROM players JOIN hands USING (hand_id) WHERE is_usd",
    "ingest_net_won": _F + " SELECT hand_id, player_name, net_won FROM players JOIN hands USING (hand_id) WHERE is_usd",
    "ingest_showdown": _F + " SELECT hand_id, player_name, hole_card_1, hole_card_2 FROM players JOIN hands USING (hand_id) WHERE is_usd AND showed_hand",
    "ingest_actions": _F + " SELECT hand_id, row_number() OVER (PARTITION BY hand_id ORDER BY action_index) - 1 AS action_index, street, player_name, action_type, amount FROM actions JOIN hands USING (hand_id) WHERE is_usd AND NOT is_ante",
    "ingest_rejects": _F + """, b AS (SELECT *, CASE WHEN hand_id::BIGINT % 5 = 0 THEN hand_id::BIGINT & 3 END AS kind FROM hands),
m AS (SELECT CASE WHEN kind = 0 THEN 'missing or malformed header' WHEN NOT is_usd THEN 'non_usd' WHEN kind = 1 THEN 'missing table line' WHEN kind = 2 THEN 'missing hole cards marker' WHEN kind = 3 THEN 'no seats found' ELSE '' END AS message FROM b)
SELECT CASE message WHEN '' THEN 'ok' WHEN 'non_usd' THEN 'non_usd' ELSE 'parse_error' END AS status, message, count(*) AS n FROM m GROUP BY ALL""",
    "ingest_stats": _F + """ SELECT dataset, year AS file_year, count(*) AS blocks, count(*) FILTER (is_usd) AS parsed, count(*) FILTER (is_included) AS included, count(*) FILTER (is_primary) AS primary_hands,
count(*) FILTER (is_usd AND NOT is_cap AND is_ante) AS ante_excluded, count(*) FILTER (NOT is_usd) AS non_usd, 0::BIGINT AS errors, count(DISTINCT source_file) AS files FROM hands GROUP BY ALL""",
    "dedupe_first_wins": _F + DUPLICATED + """ SELECT hand_id, dataset, year, source_file, block_no FROM (SELECT *, row_number() OVER (PARTITION BY hand_id ORDER BY list_position(['NL50', 'NL200', 'NL5K'], dataset), year, source_file, block_no) AS n FROM dup) WHERE n = 1""",
    "scan_pruned": _F + " SELECT dataset, year, count(*) AS hands, sum(pot_total)::BIGINT AS pot FROM hands WHERE dataset = 'NL200' AND year = 1997 GROUP BY ALL",
    "primary_players": _S + " SELECT hand_id, player_name, position, net_won, dataset, year, bb FROM pp",
    "primary_actions": _S + " SELECT hand_id, action_index, street, player_name, action_type, amount, dataset, bb FROM pa",
    "preflop_raises": _S + " SELECT hand_id, action_index, player_name, amount, raise_n FROM pr",
    "preflop_aggressor": _S + " SELECT hand_id, pfa FROM ag",
    "first_voluntary": _S + " SELECT hand_id, player_name, action_index, action_type, amount, rn FROM fv",
    "player_first": _S + " SELECT hand_id, player_name, action_index, action_type, amount, raises_before, is_folded_to FROM pf",
    "response_after_event": _S + " SELECT coalesce(v3.hand_id, v4.hand_id) AS hand_id, coalesce(v3.player_name, v4.player_name) AS player_name, v3.response AS vs_3bet, v4.response AS vs_4bet FROM v3 FULL JOIN v4 USING (hand_id, player_name)",
    "check_then_raise": _S + " SELECT hand_id, street, player_name, opp, opp AND again AS hit FROM xr WHERE opp",
}
