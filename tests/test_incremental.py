"""Incremental ingest of three tables, filters of known ids, and sketches of players."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F
from test_ingest import FULL, WALK

from railbird.operators import audits, ingest
from railbird.sources import handtext
from railbird.streaming import incremental


def hand(n: int, year: int = 2014, text: str = FULL) -> str:
    return text.replace(f"#{1 if text == FULL else 2}:", f"#{n}:", 1).replace("2014/01/02", f"{year}/01/02")


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus" / "NL50" / "2014"
    root.mkdir(parents=True)
    return tmp_path, root


def _ids(spark, out, kind="hands"):
    return sorted(r.hand_id for r in incremental.table(spark, out, kind).select("hand_id").distinct().collect())


def test_three_tables_and_copies(spark, corpus):
    tmp, root = corpus
    out = str(tmp / "out")
    run = lambda: incremental.ingest_new_files(spark, str(tmp / "corpus"), out, str(tmp / "cp"))
    # A hand twice in a file, and a third time in the next with another action.
    (root / "a.txt").write_text(hand(1) + hand(1) + hand(2, text=WALK))
    (root / "b.txt").write_text(hand(1).replace("Di: folds", "Di: calls $1.50"))
    run()
    (root / "c.txt").write_text(hand(2, text=WALK) + hand(7, 2015))
    run()
    run()
    assert _ids(spark, out) == _ids(spark, out, "players") == _ids(spark, out, "actions") == ["1", "2", "7"]
    assert incremental.table(spark, out).count() == 3 and incremental.table(spark, out, "players").count() == 18
    errors = sorted((r.hand_id, r.error_type) for r in incremental.table(spark, out, "parse_errors").collect())
    assert errors == [("1", "duplicate"), ("1", "duplicate"), ("2", "duplicate")]
    f = handtext.read_texts(spark, str(root / "a.txt"))
    one = ingest.parsed(ingest.folder_fields(ingest.blocks(spark.createDataFrame([("NL50/2014/a.txt", hand(1))], "source_file string, value string"))))
    same = lambda t, cols: sorted(map(str, t.filter("hand_id = '1'").select(*cols).collect()))
    for kind, want in (("players", ingest.players_of(one)), ("actions", ingest.actions_of(one))):
        assert same(incremental.table(spark, out, kind), want.columns) == same(want, want.columns)
    assert f.count() == 1
    # Sketches of all batches count as the tables do.
    got = {(r.dataset, r.year): (r.unique_players, r.included_hands, r.player_hand_instances) for r in incremental.unique_players(spark, out).collect()}
    want = audits.unique_players(incremental.table(spark, out), incremental.table(spark, out, "players"))
    assert got == {(r.dataset, r.year): (r.unique_players, r.included_hands, r.player_hand_instances) for r in want.collect()} and len(got) == 4


def test_batches_without_their_name_are_not_there_and_a_rerun_changes_nothing(spark, corpus):
    tmp, root = corpus
    out = tmp / "out"
    run = lambda: incremental.ingest_new_files(spark, str(tmp / "corpus"), str(out), str(tmp / "cp"))
    (root / "a.txt").write_text(hand(1))
    run()
    (root / "b.txt").write_text(hand(1) + hand(3))
    run()
    rows = {k: sorted(map(str, incremental.table(spark, str(out), k).collect())) for k in (*incremental.TABLES, "parse_errors")}
    # The second batch fails before it names itself: its rows are not there, and the next run writes them again.
    [last] = [p for p in (out / "batches").iterdir() if p.name.endswith("-1")]
    shutil.rmtree(last)
    for p in (tmp / "cp" / "commits").iterdir():
        if p.name.strip(".").startswith("1"):
            p.unlink()
    assert _ids(spark, str(out)) == ["1"]
    run()
    assert rows == {k: sorted(map(str, incremental.table(spark, str(out), k).collect())) for k in rows}


def test_only_slices_that_may_hold_an_id_are_read(spark, corpus, monkeypatch):
    tmp, root = corpus
    out = str(tmp / "out")
    (root / "a.txt").write_text(hand(1) + hand(4, 2016))
    incremental.ingest_new_files(spark, str(tmp / "corpus"), out, str(tmp / "cp"))
    read, real = [], incremental._read
    monkeypatch.setattr(incremental, "_read", lambda s, *paths, base=None: read.extend(p for p in paths if "/hands/" in p) or real(s, *paths, base=base))
    ids = spark.createDataFrame([("4",), ("99",), ("77",)], "hand_id string")
    assert [r.hand_id for r in incremental.known_ids(spark, out, ids, "none").collect()] == ["4"]
    assert read and all(p.endswith("hand_year=2016") for p in read)
    read.clear()
    assert incremental.known_ids(spark, out, ids.filter("hand_id = '99'"), "none").count() == 0 and not read


def test_filters_pass_every_id_they_hold_and_few_others(spark):
    held = spark.range(20000).select(F.col("id").cast("string").alias("hand_id"), (F.col("id") % 2).alias("hand_year"))
    f = incremental.filters(held).withColumn("batch", F.lit("b"))
    assert f.select("pieces").distinct().first()[0] == 4 and f.count() == 8
    hits = incremental.may_hold(spark.range(30000).select(F.col("id").cast("string").alias("hand_id")), f)
    assert hits.join(held, ["hand_id", "hand_year"], "left_semi").count() == 20000
    assert hits.join(held, ["hand_id", "hand_year"], "left_anti").count() < 0.06 * 40000
    assert incremental.may_hold(held, f.limit(0)).count() == 0


def test_sketches_of_many_players(spark):
    h = spark.range(30000).select(F.col("id").cast("string").alias("hand_id"), F.when(F.col("id") % 3 == 0, "NL50").otherwise("NL200").alias("dataset"), (2012 + F.col("id") % 2).alias("year"), F.lit(True).alias("is_usd"), F.lit(False).alias("is_cap"))
    p = h.select("hand_id", F.explode(F.array(*[F.concat(F.lit("p"), (F.col("hand_id").cast("long") * 7 + i) % 50000) for i in range(4)])).alias("player_name"))
    exact, near = ({(r.dataset, r.year): r for r in audits.unique_players(h, p, approximate=a).collect()} for a in (False, True))
    assert exact.keys() == near.keys() and len(near) == 7
    for k, r in exact.items():
        assert abs(near[k].unique_players - r.unique_players) <= 0.02 * r.unique_players
        assert (near[k].included_hands, near[k].player_hand_instances) == (r.included_hands, r.player_hand_instances)
    assert audits.unique_players(h.limit(0), p, approximate=True).count() == audits.unique_players(h.limit(0), p).filter("included_hands > 0").count() == 0
