"""Running sums and exact quantiles over sorted rows without a task that sees them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railbird.plans.stored import stored


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` stored in ranges of ``order``, whose bounds Spark samples; ``_part`` is the range."""
    return stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def prefix_sums(df: DataFrame, keys: list[str], order: list[Column | str], sums: list[str]) -> DataFrame:
    """Adds before_<c> (sum of c over the earlier rows of its ``keys``) and total_<c> for each of ``sums``.

    ``order`` must order the rows of a key fully. Rows are sorted in ranges of (keys, order); sums inside a range are one window, and those of the
    ranges (one row a key and range) another, so neither a large key nor a far value puts many rows into one task.
    """
    s = ranged(df, *keys, *order)
    parts = s.groupBy(*keys, "_part").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_{c}") for c in sums])
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumns({f"_b_{c}": F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)) for c in sums} | {f"total_{c}": F.sum(f"_{c}").over(W.partitionBy(*keys)) for c in sums}).drop(*[f"_{c}" for c in sums])
    inside = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    same = reduce(lambda x, k: x & s[k].eqNullSafe(parts[k]), keys, s["_part"] == parts["_part"])
    j = s.join(parts, same).select(*[s[c] for c in s.columns if c != "_part"], *[parts[c] for c in parts.columns if c not in (*keys, "_part")])
    return j.withColumns({f"before_{c}": F.col(f"_b_{c}") + F.col(f"_i_{c}") for c in sums}).drop(*[f"_{x}_{c}" for c in sums for x in "bi"])


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], weight: str | None = None) -> DataFrame:
    """One row per ``keys`` with the exact, linearly interpolated quantiles of ``value`` (as ``percentile`` gives) under the names of ``shares``; nulls do not count.
    ``weight`` is the number of rows that a row stands for.

    Rows are counted by distinct value first, numbered by ``prefix_sums``, and only the two neighbours of each quantile meet.
    A key without values gets nulls.
    """
    every = df.select(*keys).distinct() if keys else None
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    c = prefix_sums(c, keys, ["_v"], ["n"])
    out = []
    for name, share in shares.items():
        at = (F.col("total_n") - 1) * F.lit(float(share))
        for side, row in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            out.append(F.max(F.when((F.col("before_n") <= row) & (row < F.col("before_n") + F.col("n")), F.col("_v"))).alias(f"_{side}_{name}"))
    r = c.groupBy(*keys).agg(F.max("total_n").alias("_n"), *out)
    part = lambda share: (F.col("_n") - 1) * F.lit(float(share)) - F.floor((F.col("_n") - 1) * F.lit(float(share)))
    # The form of ``percentile``: (1 - part) * low + part * high.
    mixed = lambda n, s: F.when(F.col(f"_lo_{n}") == F.col(f"_hi_{n}"), F.col(f"_lo_{n}")).otherwise((1 - part(s)) * F.col(f"_lo_{n}") + part(s) * F.col(f"_hi_{n}"))
    r = r.select(*keys, *[mixed(n, s).alias(n) for n, s in shares.items()])
    if not keys:
        return r
    right = r.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *shares)
    same = reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(f"_k_{k}")), keys, F.lit(True))
    return every.join(right, same, "left").select(*keys, *shares)
