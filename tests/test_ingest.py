"""Hand-written hands: parsing, money, rejects, files and incremental runs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from railbird.operators import ingest, sequence
from railbird.sources import decision_log, handtext, slices
from railbird.streaming.incremental import ingest_new_files

HEAD = "PokerStars Hand #{n}:  Hold'em No Limit ({stakes}) - 2014/01/02 3:04:05 ET\n"
SEATS = "Table 'Alpha II' 6-max Seat #6 is the button\n" + "".join(f"Seat {i}: {p} ($50 in chips)\n" for i, p in enumerate(["Ann B", "Bob", "Cy", "Di", "Ed", "Flo"], 1))
BLINDS = "Ann B: posts small blind $0.25\nBob: posts big blind $0.50\n*** HOLE CARDS ***\n"
OPEN = "Cy: raises $1 to $1.50\nDi: folds\nEd: calls $1.50\nFlo: folds\nAnn B: folds\nBob: calls $1\n"
FLOP = "*** FLOP *** [Ah Kd 7c]\nBob: checks\nCy: bets $2\nEd: folds\nBob: raises $4 to $6\nCy: calls $4\n"
END = "*** TURN *** [Ah Kd 7c] [2s]\nBob: checks\nCy: checks\n*** RIVER *** [Ah Kd 7c 2s] [9h]\nBob: bets $5\nCy: folds\nUncalled bet ($5) returned to Bob\nBob collected $16.05 from pot\n*** SUMMARY ***\nTotal pot $16.75 | Rake $0.70\nSeat 2: Bob (big blind) collected ($16.05)\n\n"
FULL = HEAD.format(n=1, stakes="$0.25/$0.50 USD") + SEATS + BLINDS + OPEN + FLOP + END
WALK = HEAD.format(n=2, stakes="$0.25/$0.50 USD") + SEATS + BLINDS + "Cy: folds\nDi: folds\nEd: folds\nFlo: folds\nAnn B: folds\nUncalled bet ($0.25) returned to Bob\nBob collected $0.50 from pot\n*** SUMMARY ***\nTotal pot $0.50 | Rake $0\n\n"


def parse(spark, text, path="NL50/2014/a.txt"):
    f = spark.createDataFrame([(path, text)], "source_file string, value string")
    return ingest.parsed(ingest.folder_fields(ingest.blocks(f)))


@pytest.fixture(scope="module")
def full(spark):
    return parse(spark, "preamble\n" + FULL + WALK)


def test_money(spark, full):
    net = {(r.hand_id, r.player_name): r.net_won for r in ingest.players_of(full).collect()}
    assert net["1", "Bob"] == 1605 + 500 - (150 + 600 + 500)
    assert net["1", "Cy"] == -(150 + 600) and net["1", "Ed"] == -150 and net["1", "Ann B"] == -25
    assert sum(v for (h, _), v in net.items() if h == "1") == -70
    assert net["2", "Bob"] == 25 and net["2", "Ann B"] == -25


def test_hand(full):
    h = {r.hand_id: r for r in ingest.hands_of(full).collect()}
    one = h["1"]
    assert (one.dataset, one.sb, one.bb, one.table_name, one.button_seat, one.num_players_dealt) == ("NL50", 25, 50, "Alpha II", 6, 6)
    assert (one.board_flop, one.board_turn, one.board_river, one.last_street, one.pot_total, one.rake) == ("[Ah Kd 7c]", "2s", "9h", "river", 1675, 70)
    assert one.num_players_flop == 2 and one.is_primary and not one.had_showdown and str(one.timestamp) == "2014-01-02 03:04:05"
    assert h["2"].last_street == "preflop" and h["2"].num_players_flop == 0


def test_facts(full):
    f = {(r.hand_id, r.player_name): r for r in sequence.player_hand_facts(ingest.hands_of(full), ingest.players_of(full), ingest.actions_of(full)).collect()}
    cy, bob = f["1", "Cy"], f["1", "Bob"]
    assert cy.rfi_hit and cy.rfi_ft_hit and cy.pfr and cy.cbet_opp and cy.cbet_hit and cy.position == "LJ"
    assert not bob.pfr and bob.vpip and bob.bb_response == "call"
    x = {(r.street, r.player_name): r.hit for r in sequence.check_then_raise(sequence.primary_actions(ingest.hands_of(full), ingest.actions_of(full))).collect() if r.hand_id == "1"}
    assert x["flop", "Bob"] and not x["turn", "Bob"]


@pytest.mark.parametrize(
    ("text", "status"),
    [
        (FULL.replace("#1:", "#:"), "parse_error"), (FULL.replace("Table 'Alpha II'", "Tisch"), "parse_error"), (FULL.replace("*** HOLE CARDS ***\n", ""), "parse_error"), (FULL.replace(" in chips", ""), "parse_error"),
        (FULL.replace("$0.25/$0.50 USD", "€0.25/€0.50 EUR"), "non_usd"), (FULL, "ok"),
    ],
)
def test_status(spark, text, status):
    assert [r.status for r in parse(spark, text).collect()] == [status]


def test_summary_only_and_show(spark):
    t = FULL.replace("Bob collected $16.05 from pot\n", "*** SHOW DOWN ***\nBob: shows [Qs Qd] (a pair)\n")
    p = {r.player_name: r for r in ingest.players_of(parse(spark, t)).collect()}
    assert p["Bob"].net_won == 1605 + 500 - 1250 and (p["Bob"].hole_card_1, p["Bob"].hole_card_2) == ("Qs", "Qd")


def test_short_handed(spark):
    t = FULL.replace("Seat 3: Cy ($50 in chips)\n", "").replace("Seat 4: Di ($50 in chips)\n", "")
    pos = {r.player_name: r.position for r in ingest.seat_rows(parse(spark, t)).collect()}
    assert pos == {"Ann B": "SB", "Bob": "BB", "Ed": "CO", "Flo": "BTN"}


def test_raises_state_totals(spark):
    a = spark.createDataFrame([("1", i, "preflop", "P", t, v) for i, (t, v) in enumerate([("post_bb", 50), ("raise", 150), ("raise", 500), ("fold", 0)])], "hand_id string, action_index long, street string, player_name string, action_type string, amount long")
    assert ingest.invested(a).first().invested == 500


def test_empty_inputs(spark):
    f = spark.createDataFrame([], "source_file string, value string")
    p = ingest.parsed(ingest.folder_fields(ingest.blocks(f)))
    assert ingest.hands_of(p).count() == 0 and ingest.players_of(p).count() == 0 and ingest.rejects(p).count() == 0


def test_files_slices_and_increments(spark, tmp_path):
    root = tmp_path / "corpus" / "NL50" / "2014"
    root.mkdir(parents=True)
    (root / "a.txt").write_text(FULL)
    t = handtext.read_texts(spark, str(tmp_path / "corpus"))
    assert [(r.dataset, r.file_year) for r in t.collect()] == [("NL50", 2014)]
    run = lambda: ingest_new_files(spark, str(tmp_path / "corpus"), str(tmp_path / "out"), str(tmp_path / "cp"))
    run()
    (root / "b.txt").write_text(FULL + WALK)
    run()
    run()
    hands = spark.read.parquet(str(tmp_path / "out" / "hands"))
    assert sorted(r.hand_id for r in hands.collect()) == ["1", "2"]
    assert [(r.hand_id, r.error_type) for r in spark.read.parquet(str(tmp_path / "out" / "parse_errors")).collect()] == [("1", "duplicate")]
    h = hands.drop("batch")
    path = str(tmp_path / "slices")
    slices.write_slices(h, path)
    slices.write_slices(h.limit(1), path)  # the slice is there already
    got = slices.read_slices(spark, path)
    assert got.count() == 2
    assert "PartitionFilters: [isnotnull(dataset" in got.filter("dataset = 'NL50'")._jdf.queryExecution().toString()
    slices.write_report(h.groupBy("dataset").agg(F.count("*").alias("n")), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).first().n == "2"


def test_unreadable_files_and_new_checkpoints(spark, tmp_path):
    root = tmp_path / "corpus" / "NL50" / "2014"
    root.mkdir(parents=True)
    (root / "a.txt").write_text(FULL)
    (root / "bad.txt").write_bytes(b"PokerStars Hand #9: \xff\xfe\xff")
    t = handtext.read_texts(spark, str(tmp_path / "corpus"))
    assert handtext.unreadable(t).count() == 0 and handtext.unreadable(t.withColumn("value", F.lit(None).cast("string"))).count() == 2
    out = str(tmp_path / "out")
    ingest_new_files(spark, str(tmp_path / "corpus"), out, str(tmp_path / "cp1"))
    errors = lambda: sorted((r.error_type, r.hand_id) for r in spark.read.parquet(f"{out}/parse_errors").collect())
    assert [e for e, _ in errors()] == ["parse_error"]  # a block whose head cannot be parsed
    # Another checkpoint reads the files again and must not overwrite what the first one wrote.
    (root / "c.txt").write_text(WALK)
    ingest_new_files(spark, str(tmp_path / "corpus"), out, str(tmp_path / "cp2"))
    assert sorted(r.hand_id for r in spark.read.parquet(f"{out}/hands").collect()) == ["1", "2"]
    assert ("duplicate", "1") in errors()


def test_bytes_that_are_no_utf8_cost_no_hand(spark, tmp_path):
    """Three hands, one of a player with a Latin-1 name."""
    root = tmp_path / "corpus" / "NL50" / "2014"
    root.mkdir(parents=True)
    hands = [FULL.replace("#1:", f"#{i}:", 1) for i in (11, 12, 13)]
    data = "".join(hands).encode().replace(b"Bob", b"Jos\xe9")
    (root / "a.txt").write_bytes(data)
    t = handtext.read_texts(spark, str(tmp_path / "corpus"))
    p = ingest.parsed(ingest.folder_fields(ingest.blocks(t.select("source_file", "value"))))
    assert sorted(r.hand_id for r in ingest.hands_of(p).collect()) == ["11", "12", "13"]
    assert ingest.players_of(p).filter(F.col("player_name") == "Jos\ufffd").count() == 3
    out = str(tmp_path / "out")
    ingest_new_files(spark, str(tmp_path / "corpus"), out, str(tmp_path / "cp"))
    assert spark.read.parquet(f"{out}/hands").count() == 3 and spark.read.parquet(f"{out}/parse_errors").count() == 0


def test_tables_are_read_as_slices(spark, sf):
    from railbird.plans import hands
    from railbird.sources import fixture

    assert fixture.folder(spark, sf) == fixture.folder(spark, sf)
    plan = hands.scan_pruned(spark, sf)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan
    assert fixture.players(spark, sf).join(fixture.hands(spark, sf), "hand_id", "left_anti").count() == 0


def test_study_years(spark):
    from railbird.plans import schema

    h = spark.createDataFrame([(2010,), (2011,), (2025,)], "year long").selectExpr("year", "true is_usd", "false is_cap")
    assert h.filter(schema.included_audit()).count() == 2 and h.filter(schema.included_audit((1995, 2025))).count() == 3


def test_decision_log(spark):
    logs = spark.createDataFrame([("h", "players = ['A']\nactions = ['d dh p1 AsKs', 'p1 cbr 250', 'p2 f']\n"), ("g", "nothing")], "hand string, value string")
    assert [(r.step, r.action) for r in decision_log.read_actions(logs).orderBy("step").collect()] == [(0, "d dh p1 AsKs"), (1, "p1 cbr 250"), (2, "p2 f")]


@pytest.mark.parametrize("name", ["ingest_hands", "ingest_hand_summary", "ingest_players", "ingest_actions"])
def test_ingest_reads_the_texts_once(spark, sf, name):
    """F8, F9, F10, F18: blocks were rendered and parsed again for each part of a hand, and the parts joined."""
    import re

    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # The texts themselves are made of one scan of the players for the seats, and one for the winner.
    assert len(re.findall(r"posexplode\(filter\(split\(", plan)) == 1


def test_hands_with_one_id_stay_apart(spark):
    """Two blocks of one id are two hands, each with its own boards and players on the flop."""
    one = "PokerStars Hand #9:  Hold'em No Limit ($0.25/$0.50 USD) - 2014/05/06 9:00:00 ET\nTable 'T' 6-max Seat #1 is the button\n" + "".join(f"Seat {i}: {n} ($50.00 in chips)\n" for i, n in enumerate("abc", 1))
    one += "*** HOLE CARDS ***\na: calls $0.50\n"
    two = one + "*** FLOP *** [2c 3d 4h]\na: checks\nb: folds\nc: bets $1.00\na: calls $1.00\n"
    p = parse(spark, one + "*** SUMMARY ***\nTotal pot $1.00 | Rake $0.00\n\n" + two + "*** SUMMARY ***\nTotal pot $3.00 | Rake $0.10\n\n")
    assert sorted((r.board_flop, r.num_players_flop, r.pot_total) for r in ingest.hands_of(p).collect() if r.board_flop) == [("[2c 3d 4h]", 2, 300)]
    assert ingest.hands_of(p).count() == 2
