"""Sessions from gaps between events, and their summaries.

The generic columns are dataset, year, player_name, table_name, timestamp, hand_id. A session number is a running count over
one total order (time, then id), so equal times cannot split differently from run to run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railbird.functions.rates import rounded
from railbird.operators.prefix import quantiles
from railbird.plans.stored import stored


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")).cast("double") / 1e6


def _share(cond: Column) -> Column:
    return rounded(F.lit(100.0) * F.count(F.when(cond, 1)) / F.count("*"))


def table_gaps(hands: DataFrame) -> DataFrame:
    w = W.partitionBy("dataset", "year", "table_name").orderBy("timestamp", "hand_id")
    g = hands.withColumn("gap_s", (F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(F.lag("timestamp").over(w).cast("timestamp"))).cast("double") / 1e6).filter("gap_s is not null")
    g = stored(g.select("dataset", "year", "table_name", "gap_s"))
    q = quantiles(g, ["dataset", "year"], "gap_s", {"gap_p10_s": 0.1, "gap_p50_s": 0.5, "gap_p90_s": 0.9})
    q = q.select("dataset", "year", *[rounded(F.col(c), 1).alias(c) for c in q.columns[2:]])
    r = g.groupBy("dataset", "year").agg(
        F.count("*").alias("hands"), F.count_distinct("table_name").alias("tables"),
        _share(F.col("gap_s") <= 120).alias("pct_gaps_le_2min"), _share(F.col("gap_s") > 3600).alias("pct_gaps_gt_1h"),
    )
    return r.join(q, ["dataset", "year"])


def player_sessions(seated: DataFrame, gap_s: float = 1800, by: tuple[str, ...] = ("dataset", "year")) -> DataFrame:
    """Adds gap_s and session_no. ``by`` keeps sessions inside its groups; () lets them span."""
    w = W.partitionBy(*by, "player_name").orderBy("timestamp", "hand_id")
    gap = (F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(F.lag("timestamp").over(w).cast("timestamp"))).cast("double") / 1e6
    s = seated.withColumn("gap_s", gap)
    new = F.when(F.col("gap_s").isNull() | (F.col("gap_s") > gap_s), 1).otherwise(0)
    return s.withColumn("session_no", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)))


def sessions(gaps: DataFrame) -> DataFrame:
    first, last = F.min("timestamp"), F.max("timestamp")
    minutes = (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))).cast("double") / 6e7
    return gaps.groupBy("dataset", "year", "player_name", "session_no").agg(F.count("*").alias("hands"), minutes.alias("minutes"), F.count_distinct("table_name").alias("tables"), F.hour(first).cast("long").alias("start_hour"))


def summary(gaps: DataFrame, sess: DataFrame, min_hands: int) -> DataFrame:
    regulars = sess.groupBy("player_name").agg(F.sum("hands").alias("h")).filter(F.col("h") >= min_hands).select("player_name")
    keys = ["dataset", "year"]
    g = stored(gaps.filter("gap_s is not null").join(regulars, "player_name", "left_semi").select(*keys, "player_name", "gap_s"))
    gap = quantiles(g, keys, "gap_s", {"p": 0.5}).select(*keys, rounded(F.col("p"), 1).alias("player_gap_p50_s"))
    g = g.groupBy(*keys).agg(
        F.count_distinct("player_name").alias("regulars"), _share(F.col("gap_s") <= 120).alias("pct_player_gaps_le_2min"), _share(F.col("gap_s") > 86400).alias("pct_player_gaps_gt_1day")
    )
    s = stored(sess.join(regulars, "player_name", "left_semi").select(*keys, *[F.col(c).cast("double").alias(c) for c in ("hands", "minutes", "tables")]))
    long = s.unpivot(keys, ["hands", "minutes", "tables"], "metric", "value")
    of = lambda c: F.max(F.when(F.col("metric") == c, F.col("p")))
    mid = quantiles(long, [*keys, "metric"], "value", {"p": 0.5}).groupBy(*keys).agg(of("hands").alias("session_hands_p50"), rounded(of("minutes"), 1).alias("session_minutes_p50"), of("tables").alias("session_tables_p50"))
    s = s.groupBy(*keys).agg(F.count("*").alias("sessions"), _share(F.col("hands") == 1).alias("pct_single_hand_sessions"))
    return g.join(gap, keys).join(s, keys).join(mid, keys)


def player_year(sess: DataFrame, min_hands: int) -> DataFrame:
    g = sess.groupBy("dataset", "year", "player_name").agg(
        F.sum("hands").alias("hands"), F.count("*").alias("sessions"), rounded(F.median("hands"), 1).alias("session_hands_median"), rounded(F.median("minutes"), 1).alias("session_minutes_median"),
        rounded(F.max("minutes"), 1).alias("session_minutes_max"), rounded(F.sum(F.round(F.col("minutes") * 6e7).cast("long")).cast("double") / 3.6e9, 1).alias("hours_played"), F.max("tables").alias("max_tables"),
        _share(F.col("hands") == 1).alias("pct_single_hand_sessions"), rounded(F.median("start_hour"), 1).alias("start_hour_median"),
    )
    return g.filter(F.col("hands") >= min_hands)
