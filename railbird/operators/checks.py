"""Data checks as tables of (name, ok, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.functions.rates import count_if, pct, rounded

#: Plausible ranges of the rates.
RANGES = {
    "vpip_pct": (22.0, 38.0), "pfr_pct": (12.0, 24.0), "btn_rfi_folded_to_pct": (30.0, 75.0), "three_bet_pct": (3.0, 18.0), "cold_four_bet_pct": (1.0, 15.0), "fold_to_3bet_pct": (40.0, 80.0), "call_3bet_pct": (5.0, 55.0),
    "fold_to_4bet_pct": (30.0, 90.0), "cbet_pct": (45.0, 85.0), "fold_to_cbet_pct": (25.0, 65.0), "check_raise_flop_pct": (5.0, 25.0), "bb100": (-15.0, 2.0),
}


def ranges(metrics: DataFrame) -> DataFrame:
    """``metrics(dataset, metric, value)`` against the rules; a missing value is not ok."""
    spark = metrics.sparkSession
    rules = spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in RANGES.items()], "metric string, low double, high double")
    j = metrics.join(F.broadcast(rules), "metric")
    return j.select("dataset", "metric", "value", "low", "high", F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False)).alias("ok"))


def invariants(overall: DataFrame, by_position: DataFrame, postflop: DataFrame, bb100: DataFrame) -> DataFrame:
    """Orderings that must hold in every dataset, and the order of rake over the stakes."""
    rfi = lambda p: F.max(F.when(F.col("position") == p, F.col("rfi_pct")))
    parts = [
        overall.select("dataset", F.lit("pfr_le_vpip").alias("name"), (F.col("pfr_pct") <= F.col("vpip_pct")).alias("ok")),
        by_position.groupBy("dataset").agg(F.lit("btn_rfi_gt_lj_rfi").alias("name"), (rfi("BTN") > rfi("LJ")).alias("ok")),
        postflop.select("dataset", F.lit("double_barrels_le_cbets").alias("name"), (F.col("double_barrels") <= F.col("cbets")).alias("ok")),
    ]
    r = bb100.filter("granularity = 'overall'").agg(*[F.max(F.when(F.col("dataset") == d, F.col("rake_bb100_equiv"))).alias(d) for d in ("NL50", "NL200", "NL5K")])
    parts.append(r.select(F.lit("all").alias("dataset"), F.lit("rake_order").alias("name"), ((F.col("NL50") <= F.col("NL200")) & (F.col("NL200") <= F.col("NL5K"))).alias("ok")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def zero_sum(hands: DataFrame, players: DataFrame, tolerance: int = 1) -> DataFrame:
    """Per dataset: hands whose results and rake do not add up to zero within ``tolerance`` cents, their share, and the residual."""
    s = players.groupBy("hand_id").agg(F.sum("net_won").alias("net")).join(hands.select("hand_id", "dataset", "rake").hint("merge"), "hand_id")
    s = s.withColumn("r", F.col("net") + F.coalesce("rake", F.lit(0)))
    bad = count_if(F.abs("r") > tolerance)
    return s.groupBy("dataset").agg(F.count("*").alias("hands"), bad.alias("bad_hands"), pct(bad, F.count("*"), 3).alias("bad_pct"), F.sum("r").alias("residual_cents"), (bad == 0).alias("ok"))


def rake_drag(bb100: DataFrame, within: float = 0.5) -> DataFrame:
    """The players' result must equal the rake's share of it, per dataset."""
    o = bb100.filter("granularity = 'overall'")
    gap = rounded(F.abs(F.col("bb100") - F.col("rake_bb100_equiv")))
    return o.select("dataset", "bb100", "rake_bb100_equiv", gap.alias("gap"), (gap <= within).alias("ok"))
