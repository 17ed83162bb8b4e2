"""Jaccard join on sets of word n-grams by MinHash banding.

1. Every text becomes words, word hashes, n-gram hashes and the band hashes of its MinHash signature;
   band and row counts are chosen for a target recall at the threshold (``choose_bands``). Texts
   with the same words are one class from here on, so exact copies cost nothing.
2. Classes are shuffled on their band hashes; each bucket gives a star of candidate links, whose connected
   components are the candidate clusters. A cluster of one block is compared as a whole. A larger one is compared as a whole or
   bucket by bucket, whichever moves fewer texts, so that chains of chance candidates do not multiply the work; a pair that shares
   several buckets counts in the one of its lowest band.
3. What is compared is dealt into blocks of bounded size, and every pair of blocks is one row that compares the full
   n-gram sets of its members. It gives a link count per member and a spanning forest of
   the links, never the pairs themselves.
4. Components of the forests are the final classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird.llm.common import min_label_components, sliced, stored

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.999
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A block holds about so many classes and so many words. A group of B blocks moves B * B / 2 of them.
BLOCK_DOCS, BLOCK_WORDS = 512, 1_000_000
#: Columns of the membership matrix that are multiplied at a time.
SLICE = 8192
_U = np.uint64


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective rows for which a pair at the threshold is met with ``recall``."""
    best = (1, 1)
    for rows in range(1, 17):
        p = threshold**rows
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - p))) if p < 1 else 1
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def ngrams(values: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes of all texts one after another, offsets). A text of 1 to n-1 words has one n-gram, all its words."""
    values = values.astype(np.uint64, copy=False)
    c = _constants(n, 11)
    sizes = np.diff(offsets)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    out_off = np.concatenate([[0], np.cumsum(counts)])
    total = int(out_off[-1])
    # The place of each n-gram's first word among all words.
    at = np.arange(total) - np.repeat(out_off[:-1], counts) + np.repeat(offsets[:-1], counts)
    left = np.repeat(offsets[1:], counts) - at
    padded = np.concatenate([values, np.zeros(n, np.uint64)])
    h = np.zeros(total, np.uint64)
    for k in range(n):
        h += np.where(left > k, padded[at + k] * c[k] + c[k], _U(0))
    return _mix(h), out_off


def band_hashes(h: np.ndarray, offsets: np.ndarray, bands: int, rows: int, cached: int = 1 << 15) -> np.ndarray:
    """Band hashes (texts x bands) of the MinHash signatures; texts without n-grams must have been left out."""
    a, b = _constants(bands * rows, 23), _constants(bands * rows, 29)
    docs = len(offsets) - 1
    sig = np.empty((bands * rows, docs), np.uint64)
    lo = 0
    while lo < docs:  # so many texts at a time as the processor's cache holds
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + cached, "right")) - 1)
        part, starts = h[offsets[lo] : offsets[hi]], offsets[lo:hi] - offsets[lo]
        for k in range(bands * rows):
            sig[k, lo:hi] = np.minimum.reduceat(part * a[k] + b[k], starts)
        lo = hi
    out = np.empty((docs, bands), np.uint64)
    c = _constants(rows, 31)
    for band in range(bands):
        x = np.full(docs, band + 1, np.uint64)
        for r in range(rows):
            x = _mix(x + (sig[band * rows + r] >> _U(16)) * c[r])
        out[:, band] = x
    return out


def _signer(bands: int, rows: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            col = b.column("h")
            offsets = col.offsets.to_numpy().astype(np.int64)
            values = col.values.to_numpy(zero_copy_only=False).view(np.uint64)[offsets[0] : offsets[-1]]
            h, off = ngrams(values, offsets - offsets[0], n)
            some = np.diff(off) > 0
            got = band_hashes(h, np.concatenate([off[:-1][some], off[-1:]]), bands, rows) if some.any() else np.empty((0, bands), np.uint64)
            # Texts without a word have no bands.
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]), pa.int32()), pa.array(got.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in ("id", "key", "row", "words")], lists], names=["id", "key", "row", "words", "bands"])

    return run


def compare(sets: list[np.ndarray], split: int, threshold: float) -> np.ndarray:
    """Boolean links among sets of n-gram hashes; with 0 < split < len only between the first ``split`` and the others."""
    m = len(sets)
    sets = [np.unique(s) for s in sets]
    sizes = np.array([len(s) for s in sets], np.int64)
    which = np.repeat(np.arange(m), sizes)
    vocab, col = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(col, minlength=len(vocab)) > 1
    place = np.cumsum(often) - 1
    keep = often[col]
    col, which = place[col[keep]], which[keep]
    order = np.argsort(col, kind="stable")
    col, which = col[order], which[order]
    cut = split if 0 < split < m else 0  # rows before it meet those after it; without it all meet all
    inter = np.zeros((cut or m, m - cut), np.float32)
    total = int(often.sum())
    for lo in range(0, total, SLICE):
        s, e = np.searchsorted(col, [lo, lo + SLICE])
        x = np.zeros((m, min(SLICE, total - lo)), np.float32)
        x[which[s:e], col[s:e] - lo] = 1
        inter += x[: cut or m] @ x[cut:].T
    inter = np.rint(inter).astype(np.int64)
    union = sizes[: cut or m, None] + sizes[None, cut:] - inter
    near = (union > 0) & (inter >= threshold * union - 1e-9)
    if not cut:
        np.fill_diagonal(near, False)
        return near
    linked = np.zeros((m, m), bool)
    linked[:cut, cut:], linked[cut:, :cut] = near, near.T
    return linked


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row the smallest row index that links lead to (itself, if none)."""
    m = len(linked)
    label = np.arange(m)
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], m).min(axis=1, initial=m))
        if (low == label).all():
            return label
        label = low


def only_lowest(linked: np.ndarray, bands: np.ndarray, bucket: int) -> np.ndarray:
    """``linked`` without the pairs that share a bucket of a lower band than that of ``bucket``."""
    own = int((bands[0] == bucket).argmax())
    for band in range(own):
        linked = linked & (bands[:, band, None] != bands[None, :, band])
    return linked


def _verifier(n: int, threshold: float, by_bucket: bool):
    def members(chunk: pa.Scalar) -> tuple[list[int], list[int], list[np.ndarray], np.ndarray]:
        items = chunk.values
        off = items.field("h").offsets.to_numpy().astype(np.int64)
        values = items.field("h").values.to_numpy(zero_copy_only=False).view(np.uint64)
        h, goff = ngrams(values[off[0] : off[-1]], off - off[0], n)
        bands = np.zeros((len(items), 0), np.int64)
        if by_bucket:
            b = items.field("bands")
            at = b.offsets.to_numpy()
            bands = b.values.to_numpy()[at[0] : at[-1]].reshape(len(items), -1)
        return items.field("node").to_pylist(), items.field("mult").to_pylist(), [h[goff[i] : goff[i + 1]] for i in range(len(goff) - 1)], bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 16, 1 << 20):
            node: list[int] = []
            links: list[int] = []
            other: list[int | None] = []
            for i in range(b.num_rows):
                nodes, mult, sets, bands = members(b.column("ma")[i])
                split = len(nodes)
                if b.column("mb")[i].is_valid:
                    n2, m2, s2, b2 = members(b.column("mb")[i])
                    nodes, mult, sets, bands = nodes + n2, mult + m2, sets + s2, np.concatenate([bands, b2])
                if len(nodes) < 2:
                    continue
                linked = compare(sets, split, threshold)
                if by_bucket:
                    linked = only_lowest(linked, bands, b.column("cluster")[i].as_py())
                count = linked @ np.array(mult, np.int64)
                root = forest(linked)
                for k in np.flatnonzero(count):
                    node.append(nodes[k])
                    links.append(int(count[k]))
                    other.append(nodes[root[k]] if root[k] != k else None)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64()), pa.array(other, pa.int64())], names=["node", "links", "other"])

    return run


def block_pairs(members: DataFrame, sizes: DataFrame, payload: list[str]) -> DataFrame:
    """(cluster, ma, mb) for every pair of blocks of each cluster; mb is null where a block meets itself.

    ``members(cluster, node, ..payload)``; ``sizes(cluster, blocks)``. A member goes to a block by a hash of its
    node. A block is one row (an array of bounded length), so a very large cluster is many rows of
    about equal size under different keys. ``forget`` of the result deletes its blocks.
    """
    placed = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocks = stored(placed.groupBy("cluster", "blocks", "block").agg(F.collect_list(F.struct("node", *payload)).alias("m")))
    crossed = blocks.filter("blocks > 1")  # clusters of one block move no more
    tasks = sizes.select("cluster", "blocks", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"))
    tasks = tasks.select("cluster", "block", F.explode(F.sequence(F.col("block"), (F.col("blocks") - 1).cast("int"))).alias("block2"))
    # One row per pair of blocks, so joins on (cluster, block) are as even as the blocks are.
    j = tasks.filter("block < block2").join(crossed.select("cluster", "block", F.col("m").alias("ma")), ["cluster", "block"])
    j = j.join(crossed.select("cluster", F.col("block").alias("block2"), F.col("m").alias("mb")), ["cluster", "block2"])
    same = blocks.select("cluster", F.col("m").alias("ma"), F.lit(None).cast(blocks.schema["m"].dataType).alias("mb"))
    out = same.filter(F.size("ma") > 1).unionByName(j.select("cluster", "ma", "mb"))
    out._stored_path = blocks._stored_path
    return out


def _blocks_of(count: str, words: str):
    return F.greatest(F.ceil(F.col(count) / BLOCK_DOCS), F.ceil(F.col(words) / BLOCK_WORDS)).cast("int")


def bucket_plan(large: DataFrame, entries: DataFrame) -> DataFrame:
    """(cluster, bucket, blocks) of the clusters that are compared bucket by bucket, as that moves fewer classes than comparing them whole.

    ``large(cluster, c, blocks)`` are the clusters of several blocks, ``entries(cluster, bucket, node, words)`` their members' buckets.
    """
    b = entries.groupBy("cluster", "bucket").agg(F.count("*").alias("n"), F.sum("words").alias("s")).filter("n > 1")
    b = stored(b.select("cluster", "bucket", "n", _blocks_of("n", "s").alias("blocks")))
    cost = b.groupBy("cluster").agg(F.sum(F.col("n") * F.col("blocks")).alias("cost"))
    better = large.join(cost, "cluster").filter(F.col("cost") < F.col("c") * F.col("blocks")).select("cluster")
    return b.join(better, "cluster", "left_semi").select("cluster", "bucket", "blocks")


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: (id, n_links, class_id, kept).

    n_links counts the other rows whose word n-gram set has a Jaccard similarity of at least
    ``threshold``; class_id is the smallest id reachable over links, kept says id = class_id. Words are
    lower-cased; texts of 1 to n-1 words have one n-gram of all their words; null texts, and texts without
    a word, link with nothing. Repeated rows link with each other. A null id counts as a
    row but is never a class id unless the class has no other. Further columns are not carried.
    """
    bands, rows = choose_bands(threshold, recall)
    kind = dict(docs.dtypes)[id_col]
    t = docs.select(F.col(id_col).alias("id"), words_of(F.col(text)).alias("w"))
    t = t.select("id", F.md5(F.concat_ws(" ", "w")).alias("key"), F.size("w").alias("words"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    t = t.withColumn("row", F.monotonically_increasing_id())
    schema = f"id {kind}, key string, row long, words int, bands array<long>"
    signed = stored(t.mapInArrow(_signer(bands, rows, n), schema))
    classes = stored(signed.filter("words > 0").groupBy("key").agg(
        F.min("row").alias("node"), F.count("*").alias("mult"), F.first("words").alias("words"), F.first("bands").alias("bands"), F.min("id").alias("id")
    ))
    buckets = classes.select("node", F.explode("bands").alias("bh"))
    stars = buckets.groupBy("bh").agg(F.min("node").alias("lo"), F.count("*").alias("c")).filter("c > 1").select("bh", "lo")
    candidates = buckets.join(stars, "bh").filter("node <> lo").select(F.col("node").alias("a"), F.col("lo").alias("b"))
    clusters = min_label_components(candidates).withColumnRenamed("root", "cluster")
    cand = stored(clusters.join(classes.select("node", "id", "key", "mult", "words"), "node"))
    sizes = cand.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("words").alias("s"))
    # Stored, as the minima below: both sides of the joins are then dealt out for them alone, and AQE can split a hot key.
    sizes = stored(sizes.select("cluster", "c", _blocks_of("c", "s").alias("blocks")))
    # One row of each candidate class, that of its smallest id, brings the words. Both joins of texts with ids are merge joins
    # at every size: the ids grow with the corpus, so a plan that broadcasts them on small inputs says nothing about large ones.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).join(cand.hint("merge"), F.col("id").eqNullSafe(F.col("_id")))
    # Not written as an equality, which would become a second join key and cut every text into words before the shuffle.
    texts = texts.withColumn("w", words_of(F.col("text"))).filter(F.instr(F.md5(F.concat_ws(" ", "w")), F.col("key")) == 1)
    members = texts.select("cluster", "node", "mult", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    members = members.groupBy("cluster", "node", "mult").agg(F.first("h").alias("h"))
    schema = "node long, links long, other long"
    large = sizes.filter("blocks > 1")
    if large.limit(1).count():
        members = stored(members)
        own = cand.join(large.select("cluster"), "cluster", "left_semi").select("cluster", "node", "words")
        entries = own.join(classes.select("node", "bands"), "node").select("cluster", "node", "words", F.explode(F.array_distinct("bands")).alias("bucket"))
        plan = stored(bucket_plan(large, entries))
        some = entries.join(plan.select("cluster", "bucket"), ["cluster", "bucket"], "left_semi").select("bucket", "node")
        by_bucket = some.join(members, "node").join(classes.select("node", "bands"), "node").select(F.col("bucket").alias("cluster"), "node", "mult", "bands", "h")
        by_bucket = block_pairs(by_bucket, plan.select(F.col("bucket").alias("cluster"), "blocks"), ["mult", "bands", "h"])
        whole = sizes.join(plan.select("cluster"), "cluster", "left_anti").select("cluster", "blocks")
        found = block_pairs(members, whole, ["mult", "h"]).mapInArrow(_verifier(n, threshold, False), schema)
        found = stored(found.unionByName(by_bucket.mapInArrow(_verifier(n, threshold, True), schema)))
    else:
        found = stored(block_pairs(members, sizes.select("cluster", "blocks"), ["mult", "h"]).mapInArrow(_verifier(n, threshold, False), schema))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = min_label_components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    c = classes.select("key", "id", "node", "mult").join(links, "node", "left").join(roots, "node", "left")
    c = stored(c.select("key", "id", F.coalesce("root", "node").alias("root"), (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    low = stored(c.groupBy("root").agg(F.min("id").alias("class_id")))
    c = c.join(low, "root").select("key", "n_links", "class_id")
    linked = signed.filter("words > 0").select("id", "key").join(c, "key").select("id", "n_links", "class_id")
    alone = signed.filter("words = 0").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("class_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns (of any name), that stand for their class in ``similarity_classes``; each once.

    Texts without a word and null texts are classes of their own and stay. Rows of a class that repeat its smallest id stay once; an
    id under several classes stays once for each. An empty table gives an empty result.
    """
    kept = similarity_classes(docs, id_col, text).filter("kept").groupBy(F.col(id_col).alias("kept")).agg(F.count("*").alias("rows"))
    kept = stored(kept)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    out = d.join(kept.select("kept").hint("merge"), F.col("id").eqNullSafe(F.col("kept")), "left_semi")
    if kept.filter("rows > 1").limit(1).count():  # an id that stands for several rows: equal texts under it stay once
        key = F.md5(F.concat_ws(" ", words_of(F.col("text"))))
        out = out.withColumn("key", F.coalesce(F.nullif(key, F.md5(F.lit(""))), F.col("text"), F.lit(""))).dropDuplicates(["id", "key"])
    return out.select("doc.*")
