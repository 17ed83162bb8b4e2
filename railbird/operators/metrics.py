"""Population rates from the facts tables: one registry of (opportunity, hit) flags, any grain by one group-by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird.functions.rates import count_if, pct, rounded

def per_hundred(net: Column, bb: Column, hands: Column) -> Column:
    """Result per hundred hands in big blinds. Hands of one dataset share their blind, so cents are summed exactly first."""
    return rounded(F.lit(100.0) * net / bb / hands)


FLAGS = (
    "vpip", "pfr", "rfi_opp", "rfi_hit", "rfi_ft_opp", "rfi_ft_hit", "three_bet_opp", "three_bet_hit", "cold_four_bet_opp", "cold_four_bet_hit", "four_bet_opp", "four_bet_hit", "cbet_opp", "cbet_hit", "turn_cbet_opp", "turn_cbet_hit",
    "river_cbet_opp", "river_cbet_hit", "double_barrel", "triple_barrel", *[f"check_raise_{s}_{x}" for s in ("flop", "turn", "river") for x in ("opp", "hit")],
)
ANSWERS = ("vs_3bet", "vs_4bet", "cbet_response")


def counted(facts: DataFrame, *keys: str) -> DataFrame:
    """The facts summed up at ``keys``. The rates below take these sums as they take the facts, so several of them need the facts once."""
    kinds = [count_if(F.col(a) == k).alias(f"{a}_{k}") for a in ANSWERS for k in ("fold", "call")]
    return facts.groupBy(*keys).agg(
        F.count("*").alias("n"), count_if(F.col("hand_first")).alias("n_hands"), *[count_if(F.col(c)).alias(c) for c in FLAGS], *[F.count(a).alias(a) for a in ANSWERS], *kinds,
        F.sum("net_won").alias("net_won"), F.max("bb").alias("bb"),
    )


class _Terms:
    """How rows, flags and answers are counted in facts, and in the sums of ``counted``."""

    def __init__(self, t: DataFrame):
        self.summed = "n_hands" in t.columns

    def rows(self) -> Column:
        return F.sum("n") if self.summed else F.count("*")

    def hands(self) -> Column:
        return F.sum("n_hands") if self.summed else count_if(F.col("hand_first"))

    def flag(self, name: str) -> Column:
        return F.sum(name) if self.summed else count_if(F.col(name))

    def answers(self, name: str) -> Column:
        return F.sum(name) if self.summed else F.count(name)

    def answer(self, name: str, kind: str) -> Column:
        return F.sum(f"{name}_{kind}") if self.summed else count_if(F.col(name) == kind)


def overall(facts: DataFrame, *keys: str) -> DataFrame:
    """Hands, player-hands, VPIP and PFR at ``keys``; the gap is the difference of the two rounded rates."""
    t = _Terms(facts)
    n, c = t.rows(), t.flag
    g = facts.groupBy(*keys).agg(
        t.hands().alias("hands"), n.alias("player_hands"), c("vpip").alias("vpip_count"), c("pfr").alias("pfr_count"), pct(c("vpip"), n).alias("vpip_pct"), pct(c("pfr"), n).alias("pfr_pct"),
    )
    return g.withColumn("vpip_pfr_gap_pp", rounded(F.col("vpip_pct") - F.col("pfr_pct")))


def by_position(facts: DataFrame) -> DataFrame:
    t = _Terms(facts)
    n, c = t.rows(), t.flag
    return facts.groupBy("dataset", "position").agg(
        n.alias("player_hands"), pct(c("vpip"), n).alias("vpip_pct"), pct(c("pfr"), n).alias("pfr_pct"), c("rfi_opp").alias("rfi_opps"), c("rfi_hit").alias("rfi_count"),
        pct(c("rfi_hit"), c("rfi_opp")).alias("rfi_pct"), c("rfi_ft_opp").alias("rfi_folded_to_opps"), c("rfi_ft_hit").alias("rfi_folded_to_count"),
        pct(c("rfi_ft_hit"), c("rfi_ft_opp")).alias("rfi_folded_to_pct"),
    )


def by_year(facts: DataFrame) -> DataFrame:
    t = _Terms(facts)
    n, c = t.rows(), t.flag
    return facts.groupBy("dataset", "year").agg(
        t.hands().alias("hands"), n.alias("player_hands"), pct(c("vpip"), n).alias("vpip_pct"), pct(c("pfr"), n).alias("pfr_pct"),
        c("three_bet_opp").alias("three_bet_opps"), pct(c("three_bet_hit"), c("three_bet_opp")).alias("three_bet_pct"), c("cbet_opp").alias("cbet_opps"),
        pct(c("cbet_hit"), c("cbet_opp")).alias("cbet_pct"), per_hundred(F.sum("net_won"), F.max("bb"), n).alias("bb100"),
    )


def preflop(facts: DataFrame, *keys: str) -> DataFrame:
    """3-bets, 4-bets by both rules, and the answers to them; one group-by, no joins."""
    t = _Terms(facts)
    c, r = t.flag, t.answer
    out = []
    for name, opp, hit in (("three_bet", "three_bet_opp", "three_bet_hit"), ("cold_four_bet", "cold_four_bet_opp", "cold_four_bet_hit"), ("four_bet", "four_bet_opp", "four_bet_hit")):
        out += [c(opp).alias(f"{name}_opps"), c(hit).alias(f"{name}s"), pct(c(hit), c(opp)).alias(f"{name}_pct")]
    for name, col in (("3bet", "vs_3bet"), ("4bet", "vs_4bet")):
        n = t.answers(col)
        out += [n.alias(f"fold_to_{name}_opps"), r(col, "fold").alias(f"fold_to_{name}_count"), pct(r(col, "fold"), n).alias(f"fold_to_{name}_pct")]
        out += [r(col, "call").alias(f"call_{name}_count"), pct(r(col, "call"), n).alias(f"call_{name}_pct")]
    return facts.groupBy(*keys).agg(*out)


def postflop(facts: DataFrame) -> DataFrame:
    """Continuation bets, barrels, the answers to flop bets and check-raises; one group-by, no joins."""
    t = _Terms(facts)
    c = t.flag
    # No answer in a dataset is no rate: null, not 0.
    answers = F.nullif(t.answers("cbet_response"), F.lit(0))
    fold = F.when(answers.isNotNull(), t.answer("cbet_response", "fold"))
    return facts.groupBy("dataset").agg(
        c("cbet_opp").alias("cbet_opps"), c("cbet_hit").alias("cbets"), pct(c("cbet_hit"), c("cbet_opp")).alias("cbet_pct"),
        c("turn_cbet_opp").alias("turn_cbet_opps"), pct(c("turn_cbet_hit"), c("turn_cbet_opp")).alias("turn_cbet_pct"),
        c("river_cbet_opp").alias("river_cbet_opps"), pct(c("river_cbet_hit"), c("river_cbet_opp")).alias("river_cbet_pct"),
        c("double_barrel").alias("double_barrels"), pct(c("double_barrel"), c("cbet_hit")).alias("double_barrel_pct"), c("triple_barrel").alias("triple_barrels"),
        answers.alias("fold_to_cbet_opps"), fold.alias("fold_to_cbet_count"), pct(fold, answers).alias("fold_to_cbet_pct"), *_check_raises(t),
    )


def _check_raises(t: _Terms) -> list[Column]:
    out = []
    for s in ("flop", "turn", "river"):
        opp, hit = t.flag(f"check_raise_{s}_opp"), t.flag(f"check_raise_{s}_hit")
        out += [opp.alias(f"check_raise_{s}_opps"), hit.alias(f"check_raise_{s}_count"), pct(hit, opp).alias(f"check_raise_{s}_pct")]
    return out


def check_raise(facts: DataFrame) -> DataFrame:
    """Check-raises per dataset, one group of columns per street."""
    return facts.groupBy("dataset").agg(*_check_raises(_Terms(facts)))


def bb100(facts: DataFrame, hands: DataFrame) -> DataFrame:
    """Result and rake per hundred, overall and by year in one pass each (grouping sets)."""

    def sets(df: DataFrame, *aggs: Column) -> DataFrame:
        g = df.groupingSets([[F.col("dataset")], [F.col("dataset"), F.col("year")]], F.col("dataset"), F.col("year")).agg(*aggs, F.grouping("year").alias("_g"))
        return g.withColumn("granularity", F.when(F.col("_g") == 1, "overall").otherwise("year")).drop("_g")

    t = _Terms(facts)
    n = F.count("*")
    p = sets(facts, t.hands().alias("hands"), t.rows().alias("player_hands"), per_hundred(F.sum("net_won"), F.max("bb"), t.rows()).alias("bb100"))
    rake, raked = F.coalesce("rake", F.lit(0)), count_if(F.col("rake") > 0)
    r = sets(
        hands,
        rounded(F.lit(-100.0) * F.sum(rake) / F.max("bb") / (n * 6)).alias("rake_bb100_equiv"),
        pct(raked, n, 1).alias("pct_hands_raked"),
        rounded(F.sum(rake) / F.max("bb") / F.nullif(raked, F.lit(0)), 3).alias("avg_rake_bb_when_raked"),
    )
    same = (p["granularity"] == r["granularity"]) & (p["dataset"] == r["dataset"]) & p["year"].eqNullSafe(r["year"])
    return p.join(r, same).select(p["granularity"], p["dataset"], p["year"], "hands", "player_hands", "bb100", "rake_bb100_equiv", "pct_hands_raked", "avg_rake_bb_when_raked")


def responses(facts: DataFrame, cond: Column, col: str) -> DataFrame:
    """Shares of fold, call and raise among the answers in ``col`` of the rows that satisfy ``cond``."""
    f = facts.filter(cond & F.col(col).isNotNull())
    n = F.count("*")
    k = {x: count_if(F.col(col) == x) for x in ("fold", "call", "raise")}
    return f.groupBy("dataset").agg(n.alias("opps"), *[v.alias(f"{x}s") for x, v in k.items()], *[pct(v, n).alias(f"{x}_pct") for x, v in k.items()])


def three_bet_sizing(raises: DataFrame, large: int = 40) -> DataFrame:
    """Size of second raises in big blinds: mean, median, and mean without those of ``large`` or more."""
    x = F.col("amount").cast("double") / F.col("bb")
    r = raises.filter("raise_n = 2")
    small = F.when(x < large, F.col("amount"))
    return r.groupBy("dataset").agg(
        F.count("*").alias("three_bets"), (F.sum("amount") / F.max("bb") / F.count("*")).alias("mean_bb"), F.median(x).alias("median_bb"),
        (F.sum(small) / F.max("bb") / F.count(small)).alias("mean_bb_without_large"),
    )


RECOMBINED = {"vpip_pct": ("vpip_count", "player_hands"), "pfr_pct": ("pfr_count", "player_hands"), "three_bet_pct": ("three_bets", "three_bet_opps")}


def recombine(slices: DataFrame, *keys: str) -> DataFrame:
    """Rates of sums over pre-aggregated slices, never means of rates; bb/100 weighs slices by their player-hands."""
    counts = sorted({c for pair in RECOMBINED.values() for c in pair})
    g = slices.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts], F.sum("net_won").alias("net_won"), F.max("bb").alias("bb"))
    rates = {name: pct(F.col(hit), F.col(opp)) for name, (hit, opp) in RECOMBINED.items()}
    return g.withColumns(rates).withColumn("bb100", per_hundred(F.col("net_won"), F.col("bb"), F.col("player_hands"))).drop("net_won", "bb")
