"""Helpers shared by the operators: slices of Arrow batches, samples and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird.plans.stored import forget, stored

__all__ = ["forget", "min_label_components", "share_of", "sliced", "stored"]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of at most ``rows`` rows and about ``most_bytes`` (or one row), so that what a Python worker holds stays small."""
    for b in batches:
        todo = [b.slice(lo, rows) for lo in range(0, b.num_rows, rows)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > most_bytes:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def share_of(share: float, *columns: str) -> Column:
    """True for a ``share`` (0 to 1) of all values of ``columns``, chosen by their 64-bit hash; no share is too small for it."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(*columns) < -(2**63) + int(share * 2**64)


def min_label_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: one row ``(node, root)`` per node with an edge.

    root is the smallest node of the component. Alternates the large-star and small-star
    contractions (Kiveris et al. 2014), each one a partial minimum per node and one join, so a node
    with very many edges is pre-aggregated on the map side and its join can be split by AQE. Rounds
    grow with the logarithm of the component size. Nulls and loops are ignored. The tables of a round are
    deleted once the next one is written.
    """

    def star(e: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
        side = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
        # Stored, so that both sides of the join are dealt out for it alone and AQE can split a hot node.
        low = stored(side.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        j = side.join(low, "a")
        if large:
            out = j.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return stored(out.filter("a <> b").distinct()), low

    e = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct())
    before = None
    for _ in range(max_rounds if e.limit(1).count() else 0):
        wide, low = star(e, True)
        forget(e, low)
        e, low = star(wide, False)
        forget(wide, low)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        if before:
            raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
