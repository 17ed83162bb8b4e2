"""Corpus audits: counts by dataset and year, players, duplicates, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railbird.functions.rates import count_if, pct, rounded
from railbird.plans import schema as S


def hand_counts(hands: DataFrame, year: str = "year", years: tuple[int, int] = S.STUDY_YEARS) -> DataFrame:
    """Counts per dataset and folder year, with totals (null keys). Inclusion looks at the hand's own year."""
    inc = S.included_audit(years)
    h = hands.withColumn("_inc", inc).withColumn("_y", F.col(year))
    g = h.rollup("dataset", "_y").agg(
        F.count("*").alias("total"), count_if(F.col("is_usd")).alias("usd"), count_if(~F.col("is_usd")).alias("non_usd"), count_if(F.col("is_cap")).alias("cap"), count_if(~F.col("is_cap")).alias("non_cap"), count_if(F.col("_inc")).alias("included")
    )
    return g.withColumnRenamed("_y", "year")


def monthly(hands: DataFrame, years: tuple[int, int] = S.STUDY_YEARS) -> DataFrame:
    return hands.groupBy("dataset", F.date_format("timestamp", "yyyy-MM").alias("year_month")).agg(count_if(S.included_audit(years)).alias("included_hands"), F.count("*").alias("total_hands"))


def players_dealt(hands: DataFrame, years: tuple[int, int] = S.STUDY_YEARS) -> DataFrame:
    six, inc, n = F.col("num_players_dealt") == 6, S.included_audit(years), F.count("*")
    h = hands.withColumns({"_six": six, "_inc": inc})
    g = h.rollup("dataset", "year").agg(n.alias("hands"), count_if(F.col("_six")).alias("hands_6_dealt"), count_if(F.col("_inc")).alias("included"), count_if(F.col("_six") & F.col("_inc")).alias("included_6_dealt"))
    return g.withColumns({"pct_6_dealt": pct(F.col("hands_6_dealt"), F.col("hands")), "pct_included_6": pct(F.col("included_6_dealt"), F.col("included"))})


def dealt_distribution(hands: DataFrame) -> DataFrame:
    """Map players dealt -> hands, per dataset and year: counts first, then a map of a handful of entries."""
    g = hands.groupBy("dataset", "year", "num_players_dealt").agg(F.count("*").alias("n"))
    return g.groupBy("dataset", "year").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("num_players_dealt", "n")))).alias("dealt_distribution"))


def unique_players(hands: DataFrame, players: DataFrame, approximate: bool = False, years: tuple[int, int] = S.STUDY_YEARS) -> DataFrame:
    """Players, hands and seats of included hands at year, dataset and grand level; distinct counts do not add up, so each level counts anew.

    ``approximate`` counts from sketches (``player_sketches``) that are united upward, so seats are read once.
    """
    if approximate:
        return unique_players_of(player_sketches(hands, players, years))
    h = hands.filter(S.included_audit(years)).select("hand_id", "dataset", "year")
    # Hands grow with the corpus, so they are not broadcast, however small their files look.
    seats = h.hint("merge").join(players.select("hand_id", "player_name"), "hand_id")
    g = seats.rollup("dataset", "year").agg(F.count_distinct("player_name").alias("unique_players"), F.count("*").alias("player_hand_instances"))
    n = h.rollup("dataset", "year").agg(F.count("*").alias("included_hands"))
    j = g.join(n, g["dataset"].eqNullSafe(n["dataset"]) & g["year"].eqNullSafe(n["year"]))
    return j.select(g["dataset"], g["year"], "unique_players", "included_hands", "player_hand_instances", rounded(F.col("player_hand_instances") / F.col("unique_players")).alias("avg_hands_per_player"))


def player_sketches(hands: DataFrame, players: DataFrame, years: tuple[int, int] = S.STUDY_YEARS, size: int = 14) -> DataFrame:
    """(dataset, year, players, hands, seats) of included hands: a mergeable sketch of the slice's players (2**``size`` registers, about 0.8 % error) and exact counts.

    Stored for each slice or batch; a new slice adds its row and the old ones are not read again. Hands without seats do not count.
    """
    h = hands.filter(S.included_audit(years)).select("hand_id", "dataset", "year")
    per = h.hint("merge").join(players.select("hand_id", "player_name"), "hand_id")
    seats = per.groupBy("dataset", "year").agg(F.hll_sketch_agg("player_name", size).alias("players"), F.count("*").alias("seats"))
    n = h.groupBy("dataset", "year").agg(F.count("*").alias("hands"))
    return seats.join(n, seats["dataset"].eqNullSafe(n["dataset"]) & seats["year"].eqNullSafe(n["year"])).select(seats["dataset"], seats["year"], "players", "hands", "seats")


def unique_players_of(sketches: DataFrame) -> DataFrame:
    """``unique_players`` from stored ``player_sketches``, any number of rows a slice."""
    g = sketches.rollup("dataset", "year").agg(F.hll_sketch_estimate(F.hll_union_agg("players")).alias("unique_players"), F.sum("hands").alias("included_hands"), F.sum("seats").alias("player_hand_instances"))
    return g.filter("included_hands is not null").withColumn("avg_hands_per_player", rounded(F.col("player_hand_instances") / F.col("unique_players")))


def _per_id(hands: DataFrame) -> DataFrame:
    return hands.groupBy("hand_id").agg(F.count("*").alias("n"), F.collect_set("dataset").alias("ds")).filter("n > 1")


def duplicates_summary(hands: DataFrame) -> DataFrame:
    many = F.size("ds") > 1
    return _per_id(hands).agg(F.count("*").alias("duplicate_ids"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("extra_occurrences"), count_if(~many).alias("within_dataset"), count_if(many).alias("cross_dataset"))


def duplicates_by_dataset(hands: DataFrame) -> DataFrame:
    return _per_id(hands).select(F.explode("ds").alias("dataset")).groupBy("dataset").agg(F.count("*").alias("duplicate_ids"))


def duplicates_top(hands: DataFrame, top: int = 100, sample: int = 5) -> DataFrame:
    """The ``top`` ids by count (then by id) with their first place and a sample of occurrences; ``datasets`` covers the sample."""
    order = [F.array_position(F.array(*[F.lit(d) for d in S.DATASETS]), F.col("dataset")), F.col("year"), F.col("source_file"), F.col("block_no")]
    ids = hands.groupBy("hand_id").agg(F.count("*").alias("count")).filter("count > 1").orderBy(F.desc("count"), "hand_id").limit(top)
    w = W.partitionBy("hand_id").orderBy(*order)
    occ = hands.join(F.broadcast(ids), "hand_id").withColumn("occ", F.row_number().over(w)).filter(F.col("occ") <= sample)
    g = occ.groupBy("hand_id", "count").agg(
        F.array_sort(F.collect_list(F.struct("occ", F.col("source_file").alias("file"), "dataset"))).alias("occurrences"), F.array_sort(F.collect_set("dataset")).alias("datasets")
    )
    return g.select("hand_id", "count", F.col("occurrences")[0]["dataset"].alias("first_dataset"), F.col("occurrences")[0]["file"].alias("first_file"), (F.size("datasets") > 1).alias("cross_dataset"), "datasets", "occurrences")


def coverage_matrix(hands: DataFrame, years: list[int], study: tuple[int, int] = S.STUDY_YEARS) -> DataFrame:
    """Included hands by dataset and year, zero filled, each with log10(n + 1)."""
    m = hands.groupBy("dataset").pivot("year", years).agg(count_if(S.included_audit(study))).fillna(0)
    return m.select("dataset", *[F.col(str(y)).alias(f"n_{y}") for y in years], *[rounded(F.log10(F.col(str(y)) + 1.0), 6).alias(f"log_{y}") for y in years])


def metadata(hands: DataFrame) -> DataFrame:
    g = hands.groupingSets([[F.col("dataset"), F.col("year")], [F.col("dataset")], []], F.col("dataset"), F.col("year"))
    return g.agg(count_if(F.col("is_primary")).alias("primary_hands"), count_if(F.col("is_included")).alias("included_hands"))


def stratified_pick(files: DataFrame, seed: int = 42) -> DataFrame:
    """One file of each dataset and year, chosen by a digest of seed and path: the same in every run."""
    return files.groupBy("dataset", "year").agg(F.min_by("source_file", F.md5(F.concat(F.lit(f"{seed}/"), "source_file"))).alias("source_file"))
