"""Players who sit together: pair tables by year and career, per-player and per-dataset summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railbird.functions.rates import count_if, pct, rounded
from railbird.operators.prefix import quantiles
from railbird.plans.stored import stored


def expand(seated: DataFrame) -> DataFrame:
    """One row per hand and pair a < b: the hand's players are collected (at most a table's seats) and exploded twice, no self-join."""
    one = F.struct("player_name", "net_won")
    g = seated.groupBy("hand_id", "dataset", "year", "table_name", "timestamp", "bb").agg(F.array_sort(F.collect_list(one)).alias("p"))
    pairs = F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b["player_name"] > a["player_name"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    x = g.withColumn("x", F.explode(pairs))
    return x.select(
        "hand_id", "dataset", "year", "table_name", "timestamp", "bb", F.col("x.a.player_name").alias("player_a"), F.col("x.b.player_name").alias("player_b"), F.col("x.a.net_won").alias("net_a"), F.col("x.b.net_won").alias("net_b")
    )


def by_year(pairs: DataFrame, min_shared: int = 5) -> DataFrame:
    """Shared hands, days and table-days per pair and year. A first sum by pair, table and day keeps the distinct counts small."""
    keys = ["dataset", "year", "player_a", "player_b"]
    d = pairs.groupBy(*keys, "table_name", F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.sum("net_a").alias("a"), F.sum("net_b").alias("b"), F.max("bb").alias("bb")
    )
    g = d.groupBy(*keys).agg(
        F.sum("n").alias("shared_hands"), F.count_distinct("day").alias("shared_days"), F.count("*").alias("shared_sessions"), F.min("lo").alias("first_seen"), F.max("hi").alias("last_seen"),
        F.sum("a").alias("net_a"), F.sum("b").alias("net_b"), F.max("bb").alias("bb"),
    )
    return g.filter(F.col("shared_hands") >= min_shared)


def volume(seated: DataFrame, *keys: str) -> DataFrame:
    return seated.groupBy(*keys, "player_name").agg(F.count("*").alias("hands"))


def career(year_pairs: DataFrame) -> DataFrame:
    """Sums over the years that reached the yearly threshold."""
    return year_pairs.groupBy("dataset", "player_a", "player_b").agg(
        *[F.sum(c).alias(c) for c in ("shared_hands", "shared_days", "shared_sessions")], F.count_distinct("year").alias("years_together"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        *[F.sum(c).alias(c) for c in ("net_a", "net_b")], F.max("bb").alias("bb"),
    )


def export(pairs: DataFrame, vol: DataFrame, min_shared: int) -> DataFrame:
    p = pairs.filter(F.col("shared_hands") >= min_shared)
    for side in "ab":
        p = p.join(vol.select("dataset", F.col("player_name").alias(f"player_{side}"), F.col("hands").alias(f"hands_{side}")), ["dataset", f"player_{side}"], "left")
    bb = lambda c: rounded(F.col(c).cast("double") / F.col("bb"))
    return p.select(
        "dataset", "player_a", "player_b", "shared_hands", "shared_days", "shared_sessions", "years_together", "first_seen", "last_seen", "hands_a", "hands_b",
        pct(F.col("shared_hands"), F.col("hands_a")).alias("share_of_a_pct"), pct(F.col("shared_hands"), F.col("hands_b")).alias("share_of_b_pct"), bb("net_a").alias("net_bb_a_in_shared"), bb("net_b").alias("net_bb_b_in_shared"),
    )


def symmetric(pairs: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.col("player_a").alias("player_name"), F.col("player_b").alias("partner")), F.struct(F.col("player_b").alias("player_name"), F.col("player_a").alias("partner")))
    return pairs.select("dataset", F.explode(both).alias("x"), "shared_hands").select("dataset", "x.*", "shared_hands")


def per_player(pairs: DataFrame, vol: DataFrame, min_shared: int, min_hands: int, marks: tuple[int, int] = (500, 1000)) -> DataFrame:
    """Opponents and the top partner (most shared hands, then the first name): an aggregate, no ranking of all partners."""
    s = F.col("shared_hands")
    top = F.min(F.struct((-s).alias("n"), "partner"))
    g = symmetric(pairs).groupBy("dataset", "player_name").agg(
        F.count("*").alias("unique_opponents"), count_if(s >= min_shared).alias("unique_opponents_min_shared"), *[count_if(s >= m).alias(f"n_partners_ge_{m}") for m in marks], top.alias("top")
    )
    v = vol.filter(F.col("hands") >= min_hands).join(g, ["dataset", "player_name"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return v.select(
        "dataset", "player_name", "hands", zero("unique_opponents"), zero("unique_opponents_min_shared"), F.col("top.partner").alias("top_partner"), (-F.col("top.n")).alias("top_partner_hands"),
        pct(-F.col("top.n"), F.col("hands")).alias("top_partner_share_pct"), *[zero(f"n_partners_ge_{m}") for m in marks],
    )


def summary(pairs: DataFrame, vol: DataFrame, min_hands: int, marks: tuple[int, ...] = (100, 200, 500, 1000, 5000)) -> DataFrame:
    """Per dataset: quantiles, threshold counts, and the share of the top 100 and the top 1 % of pairs.

    The pairs are first counted by their number of shared hands, so the running totals are over few distinct values
    and no dataset's pairs are sorted in one task.
    """
    s = F.col("shared_hands")
    n = pairs.groupBy("dataset").agg(
        F.count("*").alias("n_pairs_slice_min"), *[count_if(s >= m).alias(f"n_pairs_ge_{m}") for m in marks], F.max(s).alias("max_shared_hands"), F.sum(s).alias("total"),
    )
    byvalue = stored(pairs.groupBy("dataset", "shared_hands").agg(F.count("*").alias("c")))
    marked = quantiles(byvalue, ["dataset"], "shared_hands", {"p50_shared": 0.5, "p90_shared": 0.9, "p99_shared": 0.99}, weight="c")
    n = n.join(marked.select("dataset", *[rounded(F.col(c), 1).alias(c) for c in marked.columns[1:]]), "dataset")
    w = W.partitionBy("dataset").orderBy(F.desc("shared_hands")).rowsBetween(W.unboundedPreceding, -1)
    r = byvalue.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0))).join(n.select("dataset", "n_pairs_slice_min", "total"), "dataset")
    one = F.greatest(F.lit(1), F.floor(F.col("n_pairs_slice_min") * 0.01 + 0.5))
    part = lambda k: F.sum(F.greatest(F.lit(0), F.least(F.col("c"), k - F.col("before"))) * s)
    top = r.groupBy("dataset").agg(pct(part(F.lit(100)), F.max("total")).alias("top100_pair_hands_pct"), pct(part(one), F.max("total")).alias("top1pct_pairs_hands_pct"))
    v = vol.groupBy("dataset").agg(F.floor(F.sum("hands") / 6.0 + 0.5).cast("long").alias("primary_hands"), F.count("*").alias("n_players"), count_if(F.col("hands") >= min_hands).alias("n_players_min_hands"))
    return n.join(top, "dataset").join(v, "dataset").drop("total")
