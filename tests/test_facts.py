"""Metrics read the tables once and count their facts without a fold for each player."""

from __future__ import annotations

import re

import pytest
from test_no_broadcast import _listed

#: Queries that once took too long, with their findings.
NAMES = {
    "check_invariants": "F2",
    "check_ranges": "F3",
    "metrics_by_year": "F11",
    "quality_checks": "F12",
    "style_correlation": "F13",
    "panel_overview": "F14",
    "metrics_check_raise": "F15",
    "metrics_postflop": "F16",
    "metrics_bb100": "F17",
}


def plans(spark, run) -> list[str]:
    """The physical plans of the executions of ``run``."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    done = {x.executionId() for x in _listed(store)}
    run()
    bus.waitUntilEmpty(30_000)
    return [x.physicalPlanDescription() for x in _listed(store) if x.executionId() not in done]


@pytest.mark.parametrize("name", NAMES)
def test_facts_come_once_and_in_batches(spark, sf, name):
    import __spark_entry__
    from railbird.sources import fixture

    # The smallest tables have too few peers, and what is empty is not planned.
    sf = sf.replace("sf0.001", "sf0.01") if name == "style_correlation" else sf
    fixture.folder(spark, sf)
    seen = plans(spark, lambda: __spark_entry__.queries()[name](spark, sf).write.format("noop").mode("overwrite").save())
    trees = [p.split("== Initial Plan ==")[0] for p in seen]
    assert sum(len(re.findall(r"MapInArrow \(\d+\)", t)) for t in trees) == 1
