"""License scan by diagonal voting, with DataFrame functions only.

All rolling word k-grams of every text are joined by hash to the positions at which they stand in the
templates. A hit at word ``pos`` of the text and ``tpos`` of the template votes for the diagonal
``pos - tpos``. Votes are counted for each (text, template, diagonal); neighbouring diagonals are
merged, so that a few inserted or missing words do not split a match; a merged span counts when it
covers enough of the template's k-grams within a length like the template's. A hit itself is checked
on the words, so equal hashes of different words never count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What counts as a word, and the phrases that every scan must report.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Further templates: (label, words).
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-4", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("public-domain", "this work is in the public domain"),
    ("proprietary", "no part of this publication may be reproduced without permission"),
)
K = 2
#: Diagonals at most so far apart are merged.
NEAR = 2
#: Part of a template's k-grams that a span must hold.
COVER = 0.8


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _template_rows() -> list[tuple]:
    rows = []
    for n, (label, phrase) in enumerate([(b, a) for a, b in BASE] + list(TEMPLATES)):
        w = phrase.split()
        rows += [(n, label, n < len(BASE), len(w) - K + 1, i, w[i], w[i + 1]) for i in range(len(w) - K + 1)]
    return rows


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Null and empty texts have no words and no labels, score 0. Repeated rows and repeated ids stay
    rows of their own (a row number within the scan keeps them apart). Texts of one word have no
    k-gram. Further columns of ``docs`` are not carried. The templates are a fixed table of about a
    hundred k-grams and the only thing broadcast; only hits, and one row per text, are shuffled.
    """
    spark = docs.sparkSession
    t = spark.createDataFrame(_template_rows(), "tmpl int, label string, is_base boolean, grams int, tpos int, w1 string, w2 string")
    t = F.broadcast(t.withColumn("h", F.xxhash64("w1", "w2")))
    d = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), words(F.col(text)).alias("w"))
    d = d.withColumn("n_words", F.size("w").cast("long"))
    # A k-gram takes its own words along and nothing else of the text, so time and memory are linear in a text's length.
    gram = lambda x, i: F.struct(F.xxhash64(x, F.get(F.col("w"), i + 1)).alias("h"), x.alias("a"), F.get(F.col("w"), i + 1).alias("b"))
    grams = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), gram)
    # The last entry, without a hash, keeps texts without a hit.
    none = F.lit(None).cast("struct<h:bigint,a:string,b:string>")
    g = d.select("_row", "_id", "n_words", F.posexplode(F.concat(grams, F.array(none))).alias("pos", "g"))
    g = g.select("_row", "_id", "n_words", "pos", F.col("g.h").alias("gh"), F.col("g.a").alias("a"), F.col("g.b").alias("b"))
    hit = (F.col("a") == F.col("w1")) & (F.col("b") == F.col("w2"))
    j = g.join(t, g["gh"] == t["h"], "left").filter(hit | F.col("gh").isNull())
    votes = j.groupBy("_row", "_id", "n_words", "tmpl", "label", "is_base", "grams", (F.col("pos") - F.col("tpos")).alias("diag")).agg(
        F.collect_set("tpos").alias("tposs"), F.min("pos").alias("lo"), (F.max("pos") + K).alias("hi")
    )
    by = W.partitionBy("_row", "tmpl").orderBy("diag")
    near = votes.withColumn("span", F.sum(F.when(F.col("diag") - F.lag("diag").over(by) <= NEAR, 0).otherwise(1)).over(by))
    spans = near.groupBy("_row", "_id", "n_words", "tmpl", "label", "is_base", "grams", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("tposs")))).alias("covered"),
        (F.max("hi") - F.min("lo")).alias("width"),
        F.count(F.when(F.size("tposs") == F.col("grams"), 1)).alias("whole"),
        F.min(F.when(F.size("tposs") == F.col("grams"), F.col("diag"))).alias("first"),
        F.max(F.when(F.size("tposs") == F.col("grams"), F.col("diag"))).alias("last"),
    )
    base = F.col("is_base") & (F.col("whole") > 0)
    share = F.col("covered").cast("double") / F.col("grams")
    found = (F.col("whole") > 0) | (~F.col("is_base") & (share >= COVER) & (F.col("width") <= 2 * (F.col("grams") + K - 1)))
    joined = lambda cond: F.concat_ws(",", F.array_sort(F.collect_set(F.when(cond, F.col("label")))))
    return spans.groupBy("_row", "_id", "n_words").agg(
        F.coalesce(F.sum(F.when(base, F.col("whole"))), F.lit(0)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(found).alias("labels"),
        F.coalesce(F.max(F.when(found, share)), F.lit(0.0)).alias("score"),
    ).select(F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


ORACLE = (
    "WITH tm(tmpl, label, is_base, grams, tpos, w1, w2) AS (VALUES "
    + ", ".join(f"({n}, '{lb}', {str(b).lower()}, {g}, {i}, '{a}', '{c}')" for n, lb, b, g, i, a, c in _template_rows())
    + rf"""),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
g AS (SELECT r, i - 1 AS pos, w[i] AS w1, w[i + 1] AS w2 FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM d)),
v AS (SELECT r, tmpl, label, is_base, grams, pos - tpos AS diag, count(DISTINCT tpos) AS votes, list(DISTINCT tpos) AS ts, min(pos) AS lo, max(pos) + {K} AS hi
      FROM g JOIN tm USING (w1, w2) GROUP BY ALL),
n AS (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY r, tmpl ORDER BY diag) <= {NEAR} THEN 0 ELSE 1 END AS fresh FROM v),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY r, tmpl ORDER BY diag) AS span FROM n),
m AS (SELECT r, label, is_base, grams, len(list_distinct(flatten(list(ts)))) AS covered, max(hi) - min(lo) AS width, count(*) FILTER (votes = grams) AS whole,
             min(diag) FILTER (votes = grams) AS first, max(diag) FILTER (votes = grams) AS last FROM s GROUP BY r, tmpl, label, is_base, grams, span),
f AS (SELECT *, is_base AND whole > 0 AS base, whole > 0 OR (NOT is_base AND covered::DOUBLE / grams >= {COVER} AND width <= 2 * (grams + {K} - 1)) AS found FROM m),
a AS (SELECT r, sum(whole) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(last) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found) AS labels,
             max(covered::DOUBLE / grams) FILTER (found) AS score FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN a USING (r)
"""
)
