"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A document is first taken in whole copies,
``floor(target / source size)`` times; the words still missing come from one further copy of some
documents. Their inclusion probabilities are proportional to the square root of the document's size
(longer texts are likelier, by less than their length), and a document's place in the draw is the
ratio of random odds to inclusion odds, ``Q = (U/(1-U)) / (p/(1-p))``; documents are taken in the
order of Q until the source's missing words are reached (Rosen 1997). U comes from a digest of the
id, so a rerun draws the same documents.

The cut in that order is found by two rounds of binned sums and one exact window over the distinct places
of a single bin, so no source, however large, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railbird.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating; null is the last source.
WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times.
MOST_COPIES = 3
#: Bins of each of the two rounds.
BINS = 4096
#: Up to so many sources their table (about 100 bytes each) is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sizes(source, source_size, spread)`` -> + target double, whole long, missing double, rate double.

    One row per source. Targets share all words by weight; a target stops at ``most`` times its
    source and the excess is shared again by weight. In the order of cap/weight, the sources before
    the first that its share does not fill are capped, so running sums give the fixed point.
    """
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(by_source)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(nth - 1, F.lit(len(weights))) + 1).cast("long")
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    s = s.withColumns(
        {
            "nth": F.row_number().over(order),
            "left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "rest": F.sum("weight").over(after),
        }
    )
    free = F.col("cap") * F.col("rest") >= F.col("weight") * F.col("left")
    s = s.withColumn("at", F.min(F.when(free, F.struct("nth", "left", "rest"))).over(every))
    share = (F.col("weight") * F.col("at.left")).cast("double") / F.col("at.rest")
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), share))
    s = s.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    )
    s = s.withColumn("missing", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double"))
    return s.withColumn("rate", F.when(F.col("spread") > 0, F.col("missing") / F.col("spread").cast("double")).otherwise(F.lit(0.0))).select(
        "source", "source_size", "target", "whole", "missing", "rate"
    )


def _with_sources(docs: DataFrame, sources: DataFrame) -> DataFrame:
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    right = sources.withColumnRenamed("source", "_s")
    return docs.join(F.broadcast(right) if few else right, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")


def _drawn(docs: DataFrame, id_col: str, text: str, source: str, seed: str) -> DataFrame:
    """(doc, _source, _size, _p, _u, _id, _tie): doc holds all columns of a row; _p is the 10-bit square root of the size."""
    tie = F.md5(F.coalesce(F.col(text), F.lit("")))
    # Rows without an id draw by their text, so that they are sampled too.
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), tie))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 12), 16, 10).cast("double") + 0.5
    d = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(source).alias("_source"), word_count(F.col(text)).alias("_size"),
        (u / F.lit(float(2**48))).alias("_u"), key.alias("_id"), tie.alias("_tie"),
    )
    return d.withColumn("_p", F.floor(F.sqrt(F.col("_size").cast("double")) * 1024).cast("long"))


def _place(rate: Column) -> Column:
    """Q/(1+Q), which orders as Q does and lies between 0 and 1."""
    p = F.greatest(F.least(rate * F.col("_p"), F.lit(1 - 1e-12)), F.lit(1e-12))
    q = (F.col("_u") / (1 - F.col("_u"))) / (p / (1 - p))
    return q / (1 + q)


def _boundary(binned: DataFrame, bin_col: str) -> DataFrame:
    """The first bin of each source in which the words before it and its own reach what is missing."""
    order = W.partitionBy("_source").orderBy(bin_col)
    c = binned.withColumn("_cum", F.sum("_words").over(order))
    c = c.filter((F.col("_cum").cast("double") >= F.col("missing")) & ((F.col("_cum") - F.col("_words")).cast("double") < F.col("missing")))
    return c.groupBy("_source").agg(F.min(F.struct(F.col(bin_col), (F.col("_cum") - F.col("_words")).alias("before"))).alias("_b"))


def _cut(last: DataFrame) -> DataFrame:
    """(source, cut of (_v, _id, _tie, k, n)): the last place taken from; of its n equal rows k are taken.

    Equal places (repeated rows) are one row with a count, so they do not meet one by one.
    """
    at = last.groupBy("_source", "_v", "_id", "_tie").agg(F.first("_size").alias("s"), F.count("*").alias("n"), F.first("missing").alias("missing"))
    order = W.partitionBy("_source").orderBy("_v", "_id", "_tie").rowsBetween(W.unboundedPreceding, -1)
    at = at.withColumn("before", F.coalesce(F.sum(F.col("s") * F.col("n")).over(order), F.lit(0)))
    # The j-th of the rows is taken if that brings the sum nearer to what is missing.
    nearer = lambda j: (F.col("missing") - (F.col("before") + (j - 1) * F.col("s")).cast("double")) >= ((F.col("before") + j * F.col("s")).cast("double") - F.col("missing"))
    j = F.floor((F.col("missing") - F.col("before")) / F.col("s") + 0.5)
    k = F.when(nearer(j + 1), j + 1).when(nearer(j), j).otherwise(j - 1)
    at = at.withColumn("k", F.least(F.greatest(k, F.lit(0)), F.col("n"))).filter("k > 0")
    return at.groupBy(F.col("_source").alias("source")).agg(F.max(F.struct("_v", "_id", "_tie", "k", "n")).alias("cut"))


def _first_of_equals(edge: DataFrame) -> DataFrame:
    """``edge`` (rows that share their source's cut) with _chosen for cut.k of them; numbered task by task, so no task sees them all."""
    edge = stored(edge.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()))
    parts = edge.groupBy("_source", "_part").agg(F.count("*").alias("_c"))
    earlier = W.partitionBy("_source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("_source").alias("_s"), F.col("_part").alias("_t"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_offset"))
    nth = F.row_number().over(W.partitionBy("_source", "_part").orderBy("_nth"))
    j = edge.withColumn("_nth", nth).join(parts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_t")))
    return j.withColumn("_chosen", F.col("_offset") + F.col("_nth") <= F.col("cut.k")).drop("_s", "_t", "_part", "_nth", "_offset")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix-1") -> DataFrame:
    """(doc, size, source_size, target, copies, taken) for every row of ``docs``; copies is 0 or more.

    doc is a struct of all columns of ``docs``, so names of its columns cannot clash with ours. Null and empty
    texts have size 0: they come along with whole copies of their source, and take no words. A null source is a source of its own. Rows without an id draw by a digest of their
    text. Equal places are ordered by id and text digest; repeated rows share a place, and as many of
    them are taken as bring the source nearest to its target (which of them is open, as they are equal in id, text and source). An
    empty table gives an empty result. No document is taken more than ``MOST_COPIES`` times.
    """
    d = _drawn(docs, id_col, text, source, seed)
    # One pass over the texts; what the draw needs of a row is a few numbers and a digest.
    drawn = stored(d.select("_source", "_size", "_p", "_u", "_id", "_tie"))
    sizes = drawn.groupBy(F.col("_source").alias("source")).agg(
        F.sum("_size").alias("source_size"), F.sum((F.col("_p") * F.col("_size")).cast("decimal(30,0)")).alias("spread")
    )
    sources = stored(source_targets(sizes))
    slim = _with_sources(drawn, sources).filter("missing > 0 and _size > 0")
    slim = slim.withColumn("_v", _place(F.col("rate"))).withColumn("_b1", F.floor(F.col("_v") * BINS))
    slim = slim.withColumn("_b2", F.floor((F.col("_v") * BINS - F.col("_b1")) * BINS))
    one = slim.groupBy("_source", "_b1").agg(F.sum("_size").alias("_words"), F.first("missing").alias("missing"))
    b1 = _boundary(one, "_b1").select(F.col("_source").alias("source"), F.col("_b._b1").alias("c1"), F.col("_b.before").alias("w1"))
    at = stored(sources.join(b1, sources["source"].eqNullSafe(b1["source"]), "left").drop(b1["source"]))
    inside = _with_sources(slim.select("_source", "_size", "_v", "_b1", "_b2", "_id", "_tie"), at.select("source", "missing", "c1", "w1"))
    inside = inside.filter("_b1 = c1").withColumn("missing", F.col("missing") - F.col("w1"))
    two = inside.groupBy("_source", "_b2").agg(F.sum("_size").alias("_words"), F.first("missing").alias("missing"))
    b2 = _boundary(two, "_b2").select(F.col("_source").alias("source"), F.col("_b._b2").alias("c2"), F.col("_b.before").alias("w2"))
    last = _with_sources(inside, b2).filter("_b2 = c2").withColumn("missing", F.col("missing") - F.col("w2"))
    for extra in (b2.select("source", "c2"), _cut(last)):
        at = at.join(extra, at["source"].eqNullSafe(extra["source"]), "left").drop(extra["source"])
    at = stored(at)
    out = _with_sources(d, at).withColumn("_v", _place(F.col("rate")))
    b = F.floor(F.col("_v") * BINS)
    bb = F.floor((F.col("_v") * BINS - b) * BINS)
    key, cut = F.struct("_v", "_id", "_tie"), F.struct("cut._v", "cut._id", "cut._tie")
    within = (bb < F.col("c2")) | ((bb == F.col("c2")) & (key <= cut))
    wanted = (F.col("missing") > 0) & (F.col("_size") > 0)
    out = out.withColumn("_chosen", F.coalesce(wanted & ((b < F.col("c1")) | ((b == F.col("c1")) & within)), F.lit(False)))
    if at.filter("cut.k < cut.n").limit(1).count():
        split = F.coalesce(F.col("_chosen") & (F.col("cut.k") < F.col("cut.n")) & (key == cut), F.lit(False))
        out = out.filter(~split).unionByName(_first_of_equals(out.filter(split)))
    out = out.withColumn("copies", F.col("whole") + F.col("_chosen").cast("long"))
    return out.select("doc", F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         (('0x' || substr(md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u,
         md5(coalesce(text, '')) AS tie, coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, ''))) AS id
  FROM documents),
p AS (SELECT *, floor(sqrt(size::DOUBLE) * 1024)::BIGINT AS p FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum((p * size)::HUGEINT)::DOUBLE AS spread FROM p GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source ASC NULLS LAST) AS nth FROM w),
f AS (SELECT *, (SELECT sum(source_size) FROM w) - coalesce(sum(3 * source_size) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
             sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM o),
a AS (SELECT lft, rest FROM f WHERE 3 * source_size * rest >= weight * lft ORDER BY nth LIMIT 1),
t AS (SELECT f.source, f.source_size, f.spread, least((3 * f.source_size)::DOUBLE, (f.weight * a.lft)::DOUBLE / a.rest::DOUBLE) AS target FROM f, a),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
m AS (SELECT *, target - (whole * source_size)::DOUBLE AS missing FROM g),
r AS (SELECT p.*, m.source_size, m.target, m.whole, m.missing,
             greatest(least((CASE WHEN m.spread > 0 THEN m.missing / m.spread ELSE 0 END) * p.p, 1 - 1e-12::DOUBLE), 1e-12::DOUBLE) AS pi
      FROM p JOIN m ON p.source IS NOT DISTINCT FROM m.source),
q AS (SELECT *, ((u / (1 - u)) / (pi / (1 - pi))) / (1 + ((u / (1 - u)) / (pi / (1 - pi)))) AS v FROM r),
c AS (SELECT *, sum(CASE WHEN size > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY (size = 0), v, id, tie ROWS UNBOUNDED PRECEDING) AS cum FROM q)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN missing > 0 AND size > 0 AND missing - (cum - size)::DOUBLE >= cum::DOUBLE - missing THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
