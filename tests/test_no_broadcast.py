"""Queries on hands send no hands, seats or orders through the driver, from the orders on."""

from __future__ import annotations

import re

import pytest

#: Queries that the driver's memory once stopped, with their findings.
NAMES = {
    "audit_dealt_distribution": "F2",
    "audit_duplicates_by_dataset": "F3",
    "audit_duplicates_summary": "F4",
    "audit_duplicates_top": "F5",
    "audit_hand_counts": "F6",
    "audit_monthly": "F7",
    "audit_players_dealt": "F8",
    "audit_unique_players": "F9",
    "audit_unique_players_sketch": "F10",
    "bb100_dispersion": "F11",
    "bet_size_histogram": "F12",
    "check_invariants": "F13",
    "check_rake_drag": "F14",
    "check_then_raise": "F15",
    "check_zero_sum": "F16",
    "corpus_metadata": "F17",
    "decision_features": "F18",
    "decision_mix": "F19",
    "decision_replay": "F20",
    "dedupe_first_wins": "F21",
    "entity_scores": "F22",
}


def broadcasts(spark, run) -> list[str]:
    """Columns of every broadcast in the executions of ``run``."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    done = {x.executionId() for x in _listed(store)}
    run()
    bus.waitUntilEmpty(30_000)
    plans = [x.physicalPlanDescription() for x in _listed(store) if x.executionId() not in done]
    assert plans
    return [c for p in plans for c in re.findall(r"\) BroadcastExchange\nInput \[\d+\]: \[(.*)\]", p)]


def _listed(store):
    x = store.executionsList()
    return [x.apply(i) for i in range(x.size())]


@pytest.mark.parametrize("name", NAMES)
def test_hands_do_not_pass_through_the_driver(spark, sf, name, monkeypatch):
    import __spark_entry__
    from railbird.sources import fixture

    monkeypatch.setattr(fixture, "_written", {})
    seen = broadcasts(spark, lambda: __spark_entry__.queries()[name](spark, sf).write.format("noop").mode("overwrite").save())
    # The top ids of duplicates are cut to 100 rows before they are sent.
    hands = [c for c in seen if re.search(r"\b(hand_id|k)#", c) and not re.fullmatch(r"hand_id#\w+, count#\w+", c)]
    assert not hands
