"""Phrase collocations by sorted count streams, in the layout of external language-model estimation.

1. Every word of a piece of text begins one window of ``longest`` words, fewer at the end of the piece. Windows are counted where the
   text is read, segment by segment; what follows the same words travels as one row, and rows meet by these words once.
2. Phrases seen at least ``least`` times are the count stream. A part of a phrase is at least as frequent as the phrase, so the
   stream holds all parts of all its phrases.
3. The stream is sorted in prefix order (first word, second, ..) over ranges of whole keys. There a phrase comes
   after all its prefixes, so one pass in lockstep gives every row the counts of its prefixes. The result is sorted again in suffix order (last word
   first), where the same pass gives the counts of its suffixes. Nothing is looked up by hash. Ranges of whole keys split
   a frequent word's phrases over many tasks; the counts that a task's first rows need from the task before are at most
   ``longest - 1`` numbers, fetched for all tasks at once.
4. Each cut of a phrase takes its left part from the prefixes and its right part from the suffixes, in exact integers. A
   phrase whose extension by one word is frequent enough goes: what holds it in more words holds such an extension too, which is at
   least as frequent.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railbird.llm.common import sliced, stored

LONGEST, LEAST, COVER, TOP = 3, 10, 50, 2000
SCALE = 1_000_000
CUTS = r"[.,;:!?\x0A-\x0D]"
#: Bytes of text counted at once by a worker.
SEGMENT = 4 << 20
#: Rows of a batch that a worker returns.
ROWS = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
#: Kind of a byte: 0 word, 1 blank, 2 cut.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def _segments(data: bytes, size: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """(first byte, end, end of the words that windows of the segment still need); segments end behind a word."""
    word, more = re.compile(rb"[^\x20\x09-\x0D.,;:!?]*"), re.compile(rb"(?:[\x20\x09]+[^\x20\x09-\x0D.,;:!?]+){0,%d}" % (longest - 1))
    lo = 0
    while lo < len(data):
        hi = word.match(data, min(lo + size, len(data))).end()
        yield lo, hi, more.match(data, hi).end()
        lo = hi


def windows(texts: list[bytes], langs: list[str], size: int, longest: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, pa.Array]]:
    """(codes, counts, languages, words) of the distinct windows of each segment of ``texts``, sorted by their codes.

    codes: language, first word, second word, ..; ``len(words)`` stands for none.
    """
    names, lang_of = np.unique(np.array(langs, object), return_inverse=True)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    data = b"\n".join(texts)
    for lo, hi, end in _segments(data, size, longest):
        # A function of its own, so that a segment's arrays go before its result is used.
        found = _windows_of(np.frombuffer(data, np.uint8, end - lo, lo), hi - lo, lambda at, lo=lo: lang_of[np.searchsorted(begins, at + lo, "right") - 1], len(names), longest)
        if found:
            yield found[0], found[1], names, found[2]


def _windows_of(b: np.ndarray, size: int, language: Callable[[np.ndarray], np.ndarray], langs: int, longest: int) -> tuple[list[np.ndarray], np.ndarray, pa.Array] | None:
    b = _LOWERED[b]
    kind = _KIND[b]
    edge = np.diff(np.concatenate([[1], kind != 0, [1]]).astype(np.int8))
    first, behind = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    count = int((first < size).sum())  # windows that begin in this segment
    if not count:
        return None
    piece = np.cumsum(kind == 2, dtype=np.int32)[first]
    offsets = np.concatenate([[0], np.cumsum(behind - first)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(b[kind == 0])).dictionary_encode()
    code, none = words.indices.to_numpy().astype(np.int64), len(words.dictionary)  # none: past the end of the piece
    parts = [code[:count] * langs + language(first[:count])]
    for k in range(1, longest):
        nxt = np.full(count, none)
        there = max(0, min(count, len(code) - k))
        nxt[:there] = np.where(piece[k : there + k] == piece[:there], code[k : there + k], none)
        parts.append(nxt)
    key, spaces, kept = parts[-1], [none + 1], []
    for p in parts[-2::-1]:
        if (int(p.max()) + 1) * int(np.prod(spaces, dtype=object)) >= 2**62:  # the words so far become numbers of what there is of them
            seen, key = np.unique(key, return_inverse=True)
            kept.append((seen, spaces))
            spaces = [len(seen)]
        key = p * int(np.prod(spaces, dtype=object)) + key
        spaces = [int(p.max()) + 1, *spaces]
    seen, counts = np.unique(key, return_counts=True)
    head, *rest = _unfolded(seen, spaces, kept)
    return [head % langs, head // langs, *rest], counts, words.dictionary


def _unfolded(key: np.ndarray, spaces: list[int], kept: list) -> list[np.ndarray]:
    digits: list[np.ndarray] = []
    while True:
        own = []
        for space in reversed(spaces[1:]):
            key, d = np.divmod(key, space)
            own.append(d)
        own = [key, *own[::-1]]  # from the first word on
        if not kept:
            return digits + own
        seen, spaces = kept.pop()
        digits += own[:-1]
        key = seen[own[-1]]


def tied(codes: list[np.ndarray], counts: np.ndarray, names: np.ndarray, words: pa.Array, longest: int) -> Iterator[pa.Array]:
    """Lines of a segment's windows: a phrase of fewer than ``longest`` words, its count, and a line of count, tab, word for each word that follows it.

    The phrase is the language, a tab, and words tied by spaces; only phrases of ``longest - 1`` words have further lines. One text is the
    narrowest row.
    """
    none = len(words)
    text = lambda n: pc.cast(pa.array(n), pa.string())
    for m in range(longest - 1, 0, -1):
        new = np.any([np.diff(c, prepend=-1) != 0 for c in codes[: m + 1]], axis=0)
        at = np.flatnonzero(new)
        whole = codes[m][at] != none
        own = text(np.add.reduceat(counts, at)[whole])
        head = pc.binary_join_element_wise(*[words.take(pa.array(c[at[whole]])) for c in codes[1 : m + 1]], " ")
        head = pc.binary_join_element_wise(pa.array(names[codes[0][at[whole]]], pa.string()), head, "\t")
        if m == longest - 1:
            follows = codes[longest] != none
            lines = pc.binary_join_element_wise(text(counts[follows]), words.take(pa.array(codes[longest][follows])), "\t")
            ends = np.concatenate([[0], np.cumsum(follows)])[[*at, len(follows)]]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), lines).filter(pa.array(whole))
            own = pc.binary_join_element_wise(own, pc.binary_join(lists, "\n"), "\n")
        yield pc.binary_join_element_wise(head, own, "\n")


def _counted(longest: int, size: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1 << 14, size):
            texts = [t or b"" for t in b.column(0).cast(pa.binary()).to_pylist()]
            for found in windows(texts, b.column(1).to_pylist(), size, longest):
                for part in tied(*found, longest):
                    whole = pa.RecordBatch.from_arrays([part], ["lines"])
                    yield from (whole.slice(lo, rows) for lo in range(0, whole.num_rows, rows))

    return run


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, w1, w2, .., f): all words of a language, and the phrases of 2 to ``longest`` words that occur ``least`` times; stored."""
    d = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    head = F.substring_index("lines", "\n", 1)
    rows = d.mapInArrow(_counted(longest, SEGMENT, ROWS), "lines string").repartition(head)
    line = rows.select(head.alias("head"), F.explode(F.slice(F.split("lines", "\n"), 2, 2**31 - 1)).alias("line")).filter("line <> ''")
    # No word has a tab or blank. What follows one head lies in one partition, so this is no second exchange.
    line = line.select("head", F.substring_index("line", "\t", 1).cast("long").alias("f"), F.when(F.col("line").contains("\t"), F.substring_index("line", "\t", -1)).alias("tail"))
    c = line.groupBy("head", "tail").agg(F.sum("f").alias("f"))
    words = F.substring_index("head", "\t", -1)
    c = c.filter((F.col("f") >= least) | (F.col("tail").isNull() & ~words.contains(" ")))
    language = F.left(F.col("head"), F.char_length("head") - F.char_length(words) - 1)
    every = F.split(F.concat_ws(" ", words, "tail"), " ")
    return stored(c.select(language.alias("lang"), *[F.get(every, F.lit(k)).alias(f"w{k + 1}") for k in range(longest)], "f"))


def _lockstep(names: list[str], keys: list[str], carried: list[str], prefix: str):
    """Adds the counts of a row's prefixes in the order of ``keys``: ``{prefix}1`` .. for the first word, the first two, ..

    ``_part`` is the task. A count that lies in an earlier task is null.
    """
    heads = [f"{prefix}{k}" for k in range(1, len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: list[int | None] = [None] * len(heads)  # counts of the latest phrases of 1, 2, .. words
        for b in batches:
            f = b.column("f").to_numpy(zero_copy_only=False).astype(np.int64)
            size = len(keys) - sum(b.column(k).is_null().to_numpy(zero_copy_only=False).astype(np.int64) for k in keys)
            out = []
            for k in range(1, len(keys)):
                own = size == k
                at = np.maximum.accumulate(np.where(own, np.arange(len(f)), -1)) if len(f) else np.zeros(0, np.int64)
                known = f[np.maximum(at, 0)]
                values = pa.array(np.where(at >= 0, known, last[k - 1] or 0), pa.int64(), mask=(size <= k) | ((at < 0) & (last[k - 1] is None)))
                if len(f) and at[-1] >= 0:
                    last[k - 1] = int(known[-1])
                out.append(values)
            parts = pa.array(np.full(len(f), part, np.int32))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names + carried), *out, parts], [*names, *carried, *heads, "_part"])

    return run


def prefix_counts(stream: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """``stream(lang, f, ..)`` with the counts of each row's prefixes in the order of ``keys`` (words; null after the last).

    ``stream`` must hold every prefix of its rows. One range sort, one pass, and for every task the rows that its beginning lacks.
    """
    names = ["lang", *keys, "f"]
    carried = [c for c in stream.columns if c not in names]
    heads = [f"{prefix}{k}" for k in range(1, len(keys))]
    by_key = stream.repartitionByRange("lang", *keys).sortWithinPartitions("lang", *keys)  # nulls first: a prefix comes before what it begins
    schema = ", ".join([*(f"`{c}` {t}" for c, t in by_key.select(*names, *carried).dtypes), *(f"{h} long" for h in heads), "_part int"])
    out = stored(by_key.mapInArrow(_lockstep(names, keys, carried, prefix), schema))
    # All rows of a task that lack a count share the words it belongs to: they go on with what the task before began.
    size = sum((F.col(k).isNotNull().cast("int") for k in keys[1:]), F.lit(1))
    for k in range(1, len(keys)):
        lacks = F.col(heads[k - 1]).isNull() & (size > k)
        open_ = out.filter(lacks).groupBy("_part").agg(*[F.first(c).alias(f"_{c}") for c in ["lang", *keys[:k]]])
        same = reduce(lambda x, c: x & (F.col(f"_{c}") == F.col(c)), keys[:k], F.col("_lang") == F.col("lang"))
        same &= F.lit(True) if k == len(keys) else F.col(keys[k]).isNull()
        # One row a task.
        found = out.select("lang", *keys, "f").join(F.broadcast(open_), same).select("_part", F.col("f").alias("_open"))
        out = out.join(F.broadcast(found), "_part", "left").withColumn(heads[k - 1], F.coalesce(heads[k - 1], F.when(size > k, F.col("_open")))).drop("_open")
    return out.drop("_part")


def _big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def scored(stream: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, m, a, l, r, score, p1.., s1..) of the phrases of two words or more in ``stream(lang, w1, .., f)``, which holds all their parts.

    m: words; p and s: counts of the first and last 1, 2, .. words.
    """
    keys = [f"w{i}" for i in range(1, longest + 1)]
    left = prefix_counts(stream, keys, "p")
    # Suffix order: the last word first.
    size = sum((F.col(k).isNotNull().cast("int") for k in keys[1:]), F.lit(1))
    back = [f"v{i}" for i in range(1, longest + 1)]
    turned = left.select("lang", "f", *[c for c in left.columns if c.startswith("p")], *[F.get(F.array(*keys), size - i).alias(b) for i, b in enumerate(back, 1)])
    both = prefix_counts(turned, back, "s")
    size = sum((F.col(b).isNotNull().cast("int") for b in back[1:]), F.lit(1))
    both = both.withColumn("m", size).filter("m > 1")
    cuts = []
    for k in range(1, longest):
        le, ri = F.col(f"p{k}"), F.get(F.array(*[F.col(f"s{j}") for j in range(1, longest)]), F.col("m") - k - 1)
        # Counts have at most 16 digits and a score at most 7, so the product fits into 38.
        product = f"CAST(f AS DECIMAL(16,0)) * CAST(f AS DECIMAL(16,0)) * CAST({SCALE} AS DECIMAL(7,0))"
        score = F.expr(f"{product} DIV (CAST(_l{k} AS DECIMAL(16,0)) * CAST(_r{k} AS DECIMAL(16,0)))")
        both = both.withColumns({f"_l{k}": F.when(F.col("m") > k, le), f"_r{k}": F.when(F.col("m") > k, ri)}).withColumn(f"_c{k}", score)
        cuts.append(F.when(F.col("m") > k, F.struct(F.col(f"_c{k}").alias("score"), F.lit(k).alias("k"), F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r"))))
    both = both.withColumn("cut", F.array_min(F.filter(F.array(*cuts), lambda c: c.isNotNull())))
    phrase = F.array_join(F.reverse(F.array(*back)), " ")
    return both.select("lang", phrase.alias("phrase"), F.col("m").cast("int").alias("m"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score", *[c for c in both.columns if c[0] in "ps" and c[1:].isdigit()])


def mine(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, cover: int = COVER, top: int = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``longest`` words of every language.

    a, l, r: occurrences of the phrase and of its two parts at its lowest-scoring cut; n: all words of the language; score:
    floor(1000000 a a / (l r)), exact. A phrase that lies in a longer one with at least ``cover`` percent of its occurrences is left
    out. A null language is ``und``. Null and empty texts, and texts of cuts and blanks only, hold no word; repeated rows count each
    time; a very long text is counted in segments. Ties go by occurrences, then by the phrase's bytes. An empty table gives no
    row. Counts may have 16 digits. Other columns are not read, whatever their names.
    """
    counts = phrases(docs, text, lang, longest, least)
    s = stored(scored(counts.filter(F.col("f") >= least), longest))
    shorter = lambda drop_last: F.array_join(F.slice(F.split("phrase", " "), F.lit(1) if drop_last else F.lit(2), F.col("m") - 1), " ")
    part = lambda c: F.get(F.array(*[F.col(f"{c}{j}") for j in range(1, longest)]), F.col("m") - 2)
    covers = lambda c: _big("a") * 100 >= _big(part(c)) * cover
    # At most 100 / cover extensions on each side can hold so much of a phrase, so this is no larger than the phrases.
    held = s.filter("m > 2").select("lang", F.explode(F.array(F.when(covers("p"), shorter(True)), F.when(covers("s"), shorter(False)))).alias("phrase")).filter("phrase is not null").distinct()
    s = s.hint("merge").join(held.hint("merge"), ["lang", "phrase"], "left_anti")
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # The limit is found in every task first, so a language's window sees at most ``top`` rows of each.
    s = s.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    n = counts.filter(F.col("w2").isNull()).groupBy("lang").agg(F.sum("f").alias("n"))
    return s.join(n, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{CUTS}')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
i AS (SELECT lang, unnest(list_zip(w, w[2:], w[3:])) AS t FROM w WHERE len(w) > 0),
g AS (SELECT lang, 1 AS m, t[1] AS phrase FROM i UNION ALL SELECT lang, 2, t[1] || ' ' || t[2] FROM i WHERE t[2] IS NOT NULL UNION ALL SELECT lang, 3, t[1] || ' ' || t[2] || ' ' || t[3] FROM i WHERE t[3] IS NOT NULL),
c AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE m = 1 GROUP BY lang),
k AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE m > 1 AND f >= 10),
j AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS j FROM k)),
cut AS (SELECT j.lang, j.phrase, x.f AS l, y.f AS r, j.j, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score FROM j JOIN c x ON x.lang = j.lang AND x.phrase = lp JOIN c y ON y.lang = j.lang AND y.phrase = rp),
b AS (SELECT lang, phrase, arg_min(l, score * 10 + j) AS l, arg_min(r, score * 10 + j) AS r, min(score) AS score FROM cut GROUP BY ALL),
h AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM k WHERE m = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM k WHERE m = 3) GROUP BY ALL),
s AS (SELECT k.lang, k.phrase, a, l, r, score, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, k.phrase) AS rank
  FROM k JOIN b ON b.lang = k.lang AND b.phrase = k.phrase LEFT JOIN h ON h.lang = k.lang AND h.phrase = k.phrase WHERE 100 * coalesce(most, 0) < 50 * a)
SELECT s.lang, rank, phrase, a, l, r, n, score FROM s JOIN n USING (lang) WHERE rank <= 2000
"""
