"""Language-model scores: a probabilistic suffix tree over bytes, beside unigram word scores.

A text is lower-cased (A-Z) and its words are joined by single spaces and closed by a newline, so the
model's probability of that byte string is a probability of the token sequence. Windows of ``DEPTH`` + 1 bytes are counted over all
training texts, and shorter ones are sums of them. A context is retained if it occurs at least
``LEAST_COUNT`` times and its next-symbol distribution diverges from that of the context one byte shorter; each
retained context is smoothed towards the shorter one, and the longest retained suffix of a context scores the next symbol.

The tree is a Spark table for each depth: a join brings what the shorter context says of the next symbol, a window over the
symbols of one context (256 at most) decides whether it is retained. At the last depth this gives the probability of every window
of any text. The most frequent windows, at most ``MOST_WINDOWS``, are looked up inside the task that reads a text; all others are
joined. Which ones these are changes no score.

The word part: counts of all training words, joined with the words of each text. Words above a
fixed share of all tokens (a bounded number) are broadcast; only rare words are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railbird.llm.common import forget, sliced, stored

DEPTH = 5
#: Windows that are looked up inside a task, at most (20 bytes each).
MOST_WINDOWS = 2_000_000
#: Least count of a context, and least divergence from the shorter context (log-likelihood ratio, and a symbol in it).
LEAST_COUNT, LEAST_G2, LEAST_KL = 20, 30.0, 0.005
SMOOTHING = 20.0
#: Words of at least this share of all training tokens are frequent: at most 1/FREQUENT of them.
FREQUENT = 5e-6
PIECE = 1 << 19
#: Distinct windows that one task holds before it sends their counts on.
HELD = 1_000_000
_U = np.uint64
END = 10
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 10 == 0


def _words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def normalized(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): each text as DEPTH newlines, its words with single spaces, a newline."""
    data = _LOWER[data]
    space = _SPACE[data]
    start = np.zeros(len(data) + 1, bool)
    start[offsets[:-1]] = True
    # A space stays where a word ends before it and another word of the same text follows.
    before = np.concatenate([[True], space[:-1]]) | start[:-1]
    keep = ~space | ~before
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    body, doc, blank = data[keep], doc[keep], space[keep]
    body = np.where(blank, np.uint8(32), body)
    last = np.concatenate([doc[1:] != doc[:-1], [True]]) if len(doc) else np.zeros(0, bool)
    keep = ~(blank & last)
    body, doc = body[keep], doc[keep]
    sizes = np.bincount(doc, minlength=len(offsets) - 1) if len(doc) else np.zeros(len(offsets) - 1, np.int64)
    off = np.concatenate([[0], np.cumsum(sizes + DEPTH + 1)]).astype(np.int64)
    out = np.full(int(off[-1]), END, np.uint8)
    out[np.arange(len(body)) + (doc + 1) * DEPTH + doc] = body
    return out, off


def _pieces(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of stretches of about PIECE bytes."""
    text = text.cast(pa.large_string()) if text.type != pa.large_string() else text
    if text.null_count:
        text = text.fill_null("")
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(text):
        hi = min(len(text), max(lo + 1, int(np.searchsorted(off, off[lo] + PIECE, "right")) - 1))
        yield lo, hi, *normalized(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def _windows(x: np.ndarray) -> np.ndarray:
    """The DEPTH + 1 bytes that end at each symbol, oldest byte first; 0 for the first DEPTH symbols."""
    x = x.astype(np.uint64)
    key = np.zeros(len(x), np.uint64)
    for k in range(DEPTH + 1):
        key[DEPTH:] |= x[k : len(x) - DEPTH + k] << _U(8 * (DEPTH - k))
    return key


def _real(n: int, off: np.ndarray) -> np.ndarray:
    """Which of ``n`` symbols are scored: all but the DEPTH newlines before each text."""
    real = np.ones(n, bool)
    for k in range(DEPTH):
        real[off[:-1] + k] = False
    return real


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, c) of the windows of DEPTH + 1 bytes (oldest byte first) in a task's texts; those of held-out texts count 0."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def flush() -> pa.RecordBatch:
        k, c = np.concatenate([p for p, _ in parts]), np.concatenate([p for _, p in parts])
        keys, at = np.unique(k, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(np.bincount(at, weights=c, minlength=len(keys)).astype(np.int64))], names=["key", "c"])

    for b in batches:
        out = b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, x, off in _pieces(b.column("text")):
            key, real = _windows(x), _real(len(x), off)
            train = np.repeat(~out[lo:hi], np.diff(off))
            for some, one in ((real & train, 1), (real & ~train, 0)):
                keys, n = np.unique(key[some], return_counts=True)
                parts.append((keys, n * one))
                held += len(keys)
            if held > HELD:
                yield flush()
                parts, held = [], 0
    if parts:
        yield flush()


def suffix_tree(texts: DataFrame) -> list[DataFrame]:
    """For ``texts(text, held_out)``: for each depth 0 to DEPTH the table (key, c, n, kept, p) of all windows of depth + 1 bytes.

    key is the window as packed bytes, its last byte the next symbol and the others its context; c its count in training texts, n that of
    its context, kept whether the context is retained, p the probability of the symbol by the longest retained
    suffix of the context. A context without training text is never retained.
    """
    grams = {DEPTH: stored(texts.mapInArrow(_count_windows, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")))}
    for d in range(DEPTH - 1, -1, -1):
        shorter = F.col("key").bitwiseAND((1 << (8 * (d + 1))) - 1)
        grams[d] = stored(grams[d + 1].groupBy(shorter.alias("key")).agg(F.sum("c").alias("c")))
    total = grams[0].agg(F.sum("c")).first()[0] or 0
    levels = [grams[0].select("key", "c", F.lit(total).cast("long").alias("n"), F.lit(True).alias("kept"), ((F.col("c") + 0.5) / (total + 128.0)).alias("p"))]
    for d in range(1, DEPTH + 1):
        below = levels[-1].select(F.col("key").alias("low"), (F.col("c") / F.greatest("n", F.lit(1))).alias("q"), F.col("p").alias("shorter"))
        g = grams[d].withColumn("low", F.col("key").bitwiseAND((1 << (8 * d)) - 1)).join(below, "low")
        context = W.partitionBy("ctx")
        g = g.withColumn("ctx", F.shiftright("key", 8)).withColumns({"n": F.sum("c").over(context), "a": F.sum(F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / F.col("q")))).over(context)})
        gain = F.col("a") - F.col("n") * F.log(F.col("n").cast("double"))  # n times the divergence
        kept = (F.col("n") >= LEAST_COUNT) & (gain >= LEAST_KL * F.col("n")) & (2 * gain >= LEAST_G2)
        g = g.withColumn("kept", F.coalesce(kept, F.lit(False)))
        p = F.when(F.col("kept"), (F.col("c") + SMOOTHING * F.col("shorter")) / (F.col("n") + SMOOTHING)).otherwise(F.col("shorter"))
        levels.append(stored(g.select("key", "c", "n", "kept", p.alias("p"))))
        forget(grams[d])
    return levels


class Lookup:
    """log10 probabilities of windows, found by key: sorted by a mixed key, with the first place of each value of its leading bits."""

    MIX = _U(0x9E3779B97F4A7C15)

    def __init__(self, key: np.ndarray, value: np.ndarray):
        mixed = key.astype(np.uint64) * self.MIX
        order = np.argsort(mixed)
        self.key, self.value = mixed[order], value[order].astype(np.float32)
        bits = max(1, int(len(key)).bit_length())
        self.shift = _U(64 - bits)
        lead = (self.key >> self.shift).astype(np.int64)
        self.start = np.searchsorted(lead, np.arange((1 << bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.start).max()) if len(key) else 0

    def __call__(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, 0 where there is none; which keys are missing)."""
        mixed = key * self.MIX
        lead = (mixed >> self.shift).astype(np.int64)
        at, end = self.start[lead], self.start[lead + 1]
        out, missing = np.zeros(len(key), np.float32), np.ones(len(key), bool)
        todo = np.flatnonzero(at < end)
        for _ in range(self.longest):
            place = at[todo]
            hit = self.key[place] == mixed[todo]
            found = todo[hit]
            out[found], missing[found] = self.value[place[hit]], False
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
            if not len(todo):
                break
        return out, missing


def frequent_windows(windows: DataFrame, most: int = MOST_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(the windows of the highest counts, ``most`` at most; all others), cut at one count."""
    step = 1.1
    rank = F.floor(F.log(F.col("c").cast("double")) / float(np.log(step)))
    ranks = windows.filter("c > 0").groupBy(rank.alias("rank")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()  # some hundred rows
    least, held = None, 0
    for r in sorted(ranks, key=lambda r: -r["rank"]):
        held += r["n"]
        if held > most:
            break
        least = r["least"]
    if least is None:
        return windows.limit(0), windows
    return windows.filter(F.col("c") >= least), windows.filter(F.col("c") < least)


def _scorer(lookup: Lookup, frequent: np.ndarray, value: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        ctx = TaskContext.get()
        serial = (ctx.partitionId() if ctx else os.getpid()) << 33
        for b in sliced(batches, 2048):
            scores, odd, counts = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, x, off in _pieces(b.column("text")):
                key, real = _windows(x), _real(len(x), off)
                p, missing = lookup(key)
                p[~real] = 0
                scores.append(np.add.reduceat(p.astype(np.float64), off[:-1]))
                rest = np.flatnonzero(missing & real)
                odd.append(key[rest].astype(np.int64))
                counts.append(np.diff(np.searchsorted(rest, off)))
            score = np.concatenate(scores)
            odd = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]), pa.int32()), pa.array(np.concatenate(odd)))
            col = b.column("h")
            off = col.offsets.to_numpy().astype(np.int64)
            h = col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
            off = off - off[0]
            at = np.minimum(np.searchsorted(frequent, h), max(len(frequent) - 1, 0))
            hit = frequent[at] == h if len(frequent) else np.zeros(len(h), bool)
            v = np.concatenate([[0.0], np.cumsum(np.where(hit, value[at] if len(frequent) else 0.0, 0.0))])
            k = np.concatenate([[0], np.cumsum(hit)])
            rest = h[~hit]
            roff = off - k[off]
            rows = np.arange(b.num_rows, dtype=np.int64) + serial
            serial += b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), b.column("id"), b.column("held_out"), pa.array(np.diff(off) + 1), pa.array(score), pa.array(v[off[1:]] - v[off[:-1]]), pa.array(np.diff(k[off])), pa.ListArray.from_arrays(pa.array(roff, pa.int32()), pa.array(rest)), odd],
                names=["row", "id", "held_out", "n_tokens", "score", "seen", "known", "rare", "odd"],
            )

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learns from the rows that are not held out (``held_out``: crc32 of the id as text mod 10 is 0; a null
    id counts as the empty text). Null and empty texts are the end token alone. Repeated rows are
    counted and scored as often as they stand. Without training rows every count is 0. Words are counted by
    64-bit hash. Further columns are not carried.
    """
    kind = dict(docs.dtypes)[id_col]
    d = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text).alias("text"))
    train = d.filter(~F.col("held_out"))
    hashes = F.transform(_words(F.col("text")), lambda w: F.xxhash64(w))
    counts = stored(train.select(F.explode(hashes).alias("h")).groupBy("h").agg(F.count("*").alias("c")))
    words = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    ends = train.count()
    n, v = words[1] + ends, words[0] + (1 if ends else 0)
    top = counts.filter(F.col("c") >= max(1.0, FREQUENT * n)).filter("c > 1").collect()  # at most 1 / FREQUENT rows
    top.sort(key=lambda r: r["h"])
    frequent = np.array([r["h"] for r in top], np.int64)
    # Sums of log10(c + 0.1), relative to an unknown word's -1.
    value = np.log10(np.array([r["c"] for r in top], np.float64) + 0.1) + 1
    spark = docs.sparkSession
    *shorter, windows = suffix_tree(d.select("text", "held_out"))
    forget(*shorter)
    top, others = frequent_windows(windows)
    top = top.select("key", F.log10("p").alias("p")).toArrow()  # MOST_WINDOWS rows at most
    lookup = Lookup(top.column("key").to_numpy(), top.column("p").to_numpy())
    shared = spark.sparkContext.broadcast((lookup, frequent, value))
    schema = f"row long, id {kind}, held_out boolean, n_tokens long, score double, seen double, known long, rare array<long>, odd array<long>"

    def run(batches):
        yield from _scorer(*shared.value)(batches)

    rows = stored(d.select("id", "held_out", "text", hashes.alias("h")).mapInArrow(run, schema))
    rare = rows.select("row", F.explode("rare").alias("h")).join(counts, "h")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("c") + 0.1) + 1).alias("s"), F.count("*").alias("k"))
    odd = rows.select("row", F.explode("odd").alias("key")).join(others.select("key", F.log10("p").alias("p")), "key")
    rest = stored(odd.groupBy("row").agg(F.sum("p").alias("rest")))
    out = rows.drop("rare", "odd").join(rare, "row", "left").join(rest, "row", "left")
    norm = float(np.log10(n + 0.1 * (v + 1)))
    end_known = 1 if ends else 0
    end_value = float(np.log10(ends + 0.1)) + 1
    total = F.col("seen") + F.coalesce("s", F.lit(0.0)) + end_value
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0)) + end_known).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (total - F.col("n_tokens") * (1 + norm)).alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
