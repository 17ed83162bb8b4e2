"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations.

1. Equal vectors become one class. A vector is rotated by three rounds of random signs and a fast
   Walsh-Hadamard transform; the signed axis nearest to the result is its cross-polytope hash. A table
   joins several such hashes; besides its own bucket a vector enters the buckets that it misses by
   least (multiprobe). The number of tables follows from the meeting probability of simulated pairs at
   the threshold.
2. Tight groups: the vectors of one bucket of the first table that lie within half the threshold angle
   of the bucket's leader all link with one another (angles obey the triangle inequality), so such a
   cell is counted, not paired. All other vectors are cells of their own.
3. Buckets hold distinct cells. They are compared in blocks. Cells of one vector give link counts and a spanning forest
   of a pair of blocks, never pairs; a pair that shares several buckets counts in the least of them. With a tight group on
   one side, cells whose angle can allow a link give one pair of cells. By the same inequality most of these link wholly; only for
   the rest the members are compared, in blocks, giving counts per member.
4. Components of the linked cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.llm.common import min_label_components, sliced, stored
from railbird.llm.ngram_join import _mix, block_pairs

THRESHOLD, RECALL = 0.9, 0.995
PROBES = 3
#: Cells of a block; BLOCK x TILE of them are compared at once.
BLOCK, TILE = 1024, 256
#: More tables than this are not tried; fewer hashes in a table (fuller buckets) reach the recall instead.
MOST_TABLES = 48
_EPS = 1e-9


def _signs(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2, (count, 3, dim)).astype(np.float64) * 2 - 1


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def codes(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 5) -> np.ndarray:
    """Bucket numbers (rows x tables x (1 + probes)) of unit vectors; the first of each table is the vector's own."""
    n, dim = x.shape
    p = max(2, 1 << (dim - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, p - dim)))
    signs = _signs(p, tables * hashes, seed)
    out = np.zeros((n, tables, 1 + probes), np.int64)
    r = np.arange(n)
    for t in range(tables):
        best, other, loss = np.zeros((hashes, n), np.int64), np.zeros((hashes, 3, n), np.int64), np.zeros((hashes, 3, n))
        for k in range(hashes):
            y = x
            for s in signs[t * hashes + k]:
                y = hadamard(y * s)
            size = np.abs(y)
            top = np.argpartition(-size, min(3, p - 1), axis=1)[:, :4] if p > 4 else np.argsort(-size, axis=1)
            order = np.argsort(-size[r[:, None], top], axis=1, kind="stable")
            top = top[r[:, None], order]
            signed = 2 * top + (y[r[:, None], top] < 0)
            best[k] = signed[:, 0]
            for c in range(min(3, top.shape[1] - 1)):
                other[k, c], loss[k, c] = signed[:, c + 1], size[r, top[:, 0]] - size[r, top[:, c + 1]]
        base = np.zeros(n, np.int64)
        for k in range(hashes):
            base = base * (2 * p) + best[k]
        out[:, t, 0] = base
        # The nearest other buckets: one of the hashes takes its second to fourth axis.
        weight = np.array([(2 * p) ** (hashes - 1 - k) for k in range(hashes)], np.int64)
        moved = (base + (other - best[:, None]) * weight[:, None, None]).reshape(-1, n)
        rank = np.argsort(loss.reshape(-1, n), axis=0, kind="stable")[:probes]
        out[:, t, 1 : 1 + len(rank)] = moved[rank, r].T
        out[:, t, 1 + len(rank) :] = base[:, None]
    return out


@lru_cache(maxsize=64)
def choose_tables(rows: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL, probes: int = PROBES) -> tuple[int, int]:
    """(tables, hashes): about one entry per bucket, and tables enough to meet simulated pairs at the threshold with ``recall``."""
    p = max(2, 1 << (dim - 1).bit_length())
    g = np.random.default_rng(3)
    a = g.normal(size=(2000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = g.normal(size=(2000, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    c = threshold * a + np.sqrt(1 - threshold**2) * b
    hashes = int(np.clip(np.ceil(np.log(max(rows, 2)) / np.log(2 * p) - 0.5), 1, 6))
    while True:
        u, v = codes(a, 4, hashes, probes), codes(c, 4, hashes, probes)
        met = np.clip((u[:, :, :, None] == v[:, :, None, :]).any((2, 3)).mean(), 0.0, 0.999)
        tables = int(max(2, np.ceil(np.log(1 - recall) / np.log(1 - met)))) if met else MOST_TABLES + 1
        if tables <= MOST_TABLES or hashes == 1:
            return tables, hashes
        hashes -= 1


def _matrix(col: pa.Array) -> np.ndarray:
    off = col.offsets.to_numpy()
    x = col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].reshape(len(col), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hasher(rows: int, threshold: float, recall: float, first_only: bool, names: list[str]):
    """Adds the bucket of the first table (one row each) or all buckets (array) to rows with column ``v``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2048):
            v, dims = b.column("v"), np.diff(b.column("v").offsets.to_numpy())
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim))
                # Vectors are padded to a power of two, on which the meeting probability rests.
                tables, hashes = choose_tables(rows, 1 << (int(dim) - 1).bit_length(), threshold, recall)
                part = b.take(at)
                got = codes(_matrix(part.column("v")), 1 if first_only else tables, hashes, 0 if first_only else PROBES)
                cols = [part.column(k) for k in names]
                if first_only:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(got[:, 0, 0])], names=[*names, "code"])
                else:
                    # Table and length are mixed into a bucket's 64-bit name.
                    where = (np.uint64(dim) << np.uint64(8)) + np.arange(tables, dtype=np.uint64)
                    named = np.sort(_mix(got.astype(np.uint64) + _mix(where)[None, :, None]).view(np.int64).reshape(len(got), -1), axis=1)
                    offsets = pa.array(np.arange(len(named) + 1) * named.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(offsets, pa.array(named.ravel()))], names=[*names, "buckets"])

    return run


def _share_less(a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
    """For rows of ``a`` and ``b`` (sorted bucket lists of pairs): do both hold a bucket less than ``bucket``?"""
    out = np.zeros(len(a), bool)
    for k in range(a.shape[1]):
        some = np.flatnonzero(~out & (a[:, k] < bucket))
        if not len(some):
            break  # lists are sorted
        out[some] = (a[some, k, None] == b[some]).any(1)
    return out


def _near_cells(threshold: float):
    """Links of a block pair: (node, links, other) for cells of one vector, and (a, b, whole) for pairs of cells with a tight group."""
    theta = np.arccos(threshold)

    def members(chunk: pa.Scalar):
        items = chunk.values
        lists = items.field("buckets")
        off = lists.offsets.to_numpy()
        wide = lists.values.to_numpy()[off[0] : off[-1]]
        single = items.field("single").to_numpy(zero_copy_only=False)
        at = np.zeros(len(items), np.int64)
        at[single] = np.arange(single.sum())
        return items.field("node").to_numpy(), _matrix(items.field("v")), items.field("radius").to_numpy(), items.field("weight").to_numpy(), single, at, wide.reshape(int(single.sum()), -1) if single.any() else np.zeros((0, 1), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["node", "links", "other", "a", "b", "whole"], [pa.int64()] * 5 + [pa.bool_()]
        for batch in sliced(batches, 64, 1 << 20):
            out: list[tuple] = []
            for bucket, ma, mb in zip(batch.column("cluster").to_pylist(), batch.column("ma"), batch.column("mb")):
                node, x, r, weight, single, at, lists = members(ma)
                n2, x2, r2, weight2, single2, at2, lists2 = members(mb) if mb.is_valid else (node, x, r, weight, single, at, lists)
                m = len(node)
                count = np.zeros(m + len(n2) if mb.is_valid else m, np.int64)
                root = np.arange(len(count))
                shift = m if mb.is_valid else 0
                for lo in range(0, m, TILE):
                    rows = slice(lo, lo + TILE)
                    cos = x[rows] @ x2.T
                    both = single[rows, None] & single2
                    i, j = np.nonzero(both & (cos >= threshold))
                    i += lo
                    keep = i < j if not mb.is_valid else np.ones(len(i), bool)
                    i, j = i[keep], j[keep]
                    for part in range(0, len(i), 200_000):
                        p, q = i[part : part + 200_000], j[part : part + 200_000]
                        fresh = ~_share_less(lists[at[p]], lists2[at2[q]], bucket)
                        p, q = p[fresh], q[fresh]
                        np.add.at(count, p, weight2[q])
                        np.add.at(count, q + shift, weight[p])
                        _join(root, p, q + shift)
                    if not both.all():
                        angle = np.arccos(np.clip(cos, -1, 1))
                        reach = r[rows, None] + r2
                        near = ~both & (angle <= theta + reach + _EPS)
                        i, j = np.nonzero(near)
                        if not mb.is_valid:
                            i, j = i[i + lo < j], j[i + lo < j]
                        whole = angle[i, j] + reach[i, j] <= theta - _EPS
                        out += [(None, None, None, min(a, c), max(a, c), bool(w)) for a, c, w in zip(node[i + lo].tolist(), n2[j].tolist(), whole) if a != c]
                every = np.concatenate([node, n2]) if mb.is_valid else node
                for k in np.flatnonzero(count):
                    out.append((int(every[k]), int(count[k]), int(every[root[k]]) if root[k] != k else None, None, None, None))
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return run


def _join(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Joins the trees of ``root`` along the links p - q, so that every member names its tree's smallest."""
    while len(p):
        a, b = root[p], root[q]
        differ = a != b
        p, q, a, b = p[differ], q[differ], a[differ], b[differ]
        if not len(p):
            return
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def _member_links(threshold: float):
    """Exact link counts between the members of two cells' blocks: (node, links, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node: list[int] = []
            links: list[int] = []
            pair: list[tuple[int, int]] = []
            for a, b, ma, mb in zip(*[batch.column(k) for k in ("a", "b", "ma", "mb")]):
                p, q = ma.values, mb.values
                linked = _matrix(p.field("v")) @ _matrix(q.field("v")).T >= threshold
                for side, other, hit in ((p, q, linked), (q, p, linked.T)):
                    count = hit @ other.field("mult").to_numpy()
                    for k in np.flatnonzero(count):
                        node.append(side.field("node")[k].as_py())
                        links.append(int(count[k]))
                        pair.append((a.as_py(), b.as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(links, pa.int64()), pa.array([x for x, _ in pair], pa.int64()), pa.array([x for _, x in pair], pa.int64())],
                names=["node", "links", "a", "b"],
            )

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``vectors``: (id, n_links, component_id, kept).

    Two rows link when the cosine of their vectors, in double precision, is at least ``threshold``.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    vectors of different length do not link with each other. Repeated rows and equal vectors link.
    component_id is the smallest id reachable over links (null ids only if there is no other); kept says
    id = component_id. Found pairs are exact; a pair at the threshold is found with
    probability ``recall``. Further columns are not carried.
    """
    kind = dict(vectors.dtypes)[vec]
    kind = kind if kind == "array<float>" else "array<double>"
    v = F.col(vec).cast(kind)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    t = vectors.select(F.col(id_col).alias("id"), F.when(good, v).alias("v"))
    t = t.withColumn("key", F.md5(F.array_join(F.col("v").cast("array<string>"), ","))).withColumn("row", F.monotonically_increasing_id())
    rows = stored(t.select("id", "key", "row", "v"))
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("row").alias("node"), F.count("*").alias("mult"), F.min("id").alias("id"), F.first("v").alias("v"))
    classes = stored(classes)
    total = classes.count()
    cols = "key string, node long, mult long, id " + dict(vectors.dtypes)[id_col] + f", v {kind}"
    names = ["key", "node", "mult", "id", "v"]
    coded = stored(classes.select(*names).mapInArrow(_hasher(total, threshold, recall, True, names), cols + ", code long").withColumn("dim", F.size("v")))
    leaders = stored(coded.groupBy("dim", "code").agg(F.min(F.struct("node", "v")).alias("leader")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    cos = dot(F.col("v"), F.col("leader.v")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("leader.v"), F.col("leader.v")))
    angle = F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0)))
    half = float(np.arccos(threshold)) / 2 - 1e-6
    inside = F.coalesce(angle <= half, F.lit(False)) | (F.col("node") == F.col("leader.node"))
    m = coded.join(leaders, ["dim", "code"]).select(
        "key", "node", "mult", "id", "v", F.when(inside, F.col("leader.node")).otherwise(F.col("node")).alias("cell"), F.when(inside & (F.col("node") != F.col("leader.node")), angle + 1e-7).otherwise(F.lit(0.0)).alias("angle")
    )
    m = stored(m)
    cells = stored(m.groupBy("cell").agg(F.sum("mult").alias("weight"), F.max("angle").alias("radius"), F.count("*").alias("c")))
    # Every member enters its buckets under its cell's name; equal (bucket, cell) rows meet on the map side.
    hashed = stored(m.select("cell", "v").mapInArrow(_hasher(total, threshold, recall, False, ["cell"]), "cell long, buckets array<long>"))
    entries = stored(hashed.select("cell", F.explode("buckets").alias("bucket")).distinct())
    full = stored(entries.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("bucket").alias("cluster"), F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    single = F.col("c") == 1
    centers = m.filter("node = cell").select("cell", "v").join(cells.select("cell", "radius", "weight", single.alias("single")), "cell")
    lists = hashed.join(cells.filter(single).select("cell"), "cell", "left_semi")
    centers = centers.join(lists, "cell", "left").withColumn("buckets", F.coalesce("buckets", F.array().cast("array<long>")))
    in_bucket = entries.withColumnRenamed("bucket", "cluster").join(full.select("cluster"), "cluster", "left_semi").join(stored(centers), "cell")
    members = in_bucket.withColumnRenamed("cell", "node")
    payload = ["v", "radius", "weight", "single", "buckets"]
    near = block_pairs(members, full, payload).mapInArrow(_near_cells(threshold), "node long, links long, other long, a long, b long, whole boolean")
    near = stored(near)
    singles = near.filter("node is not null").groupBy(F.col("node").alias("cell")).agg(F.sum("links").alias("met"))
    trees = near.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    pairs = stored(near.filter("a is not null").select("a", "b", "whole").distinct())
    weights = cells.select("cell", "weight")
    whole = pairs.filter("whole").select("a", "b")
    sides = whole.unionByName(whole.select(F.col("b").alias("a"), F.col("a").alias("b")))
    added = sides.join(weights, F.col("b") == F.col("cell")).groupBy("a").agg(F.sum("weight").alias("added")).withColumnRenamed("a", "cell")
    # The other pairs of cells: their members, in blocks.
    open_pairs = pairs.filter("not whole").select("a", "b")
    touched = stored(open_pairs.select(F.col("a").alias("cell")).unionByName(open_pairs.select(F.col("b").alias("cell"))).distinct().join(cells, "cell").select("cell", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    placed = m.join(touched, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocks = stored(placed.groupBy("cell", "block").agg(F.collect_list(F.struct("node", "mult", "v")).alias("m")))
    j = open_pairs.join(blocks.select(F.col("cell").alias("a"), F.col("m").alias("ma")), "a").join(blocks.select(F.col("cell").alias("b"), F.col("m").alias("mb")), "b")
    exact = stored(j.select("a", "b", "ma", "mb").mapInArrow(_member_links(threshold), "node long, links long, a long, b long"))
    links = exact.groupBy("node").agg(F.sum("links").alias("links"))
    roots = min_label_components(whole.unionByName(exact.select("a", "b").distinct()).unionByName(trees)).withColumnRenamed("node", "cell")
    per_cell = cells.select("cell", "weight").join(added, "cell", "left").join(singles, "cell", "left").join(roots, "cell", "left")
    n = F.col("weight") - 1 + F.coalesce("added", F.lit(0)) + F.coalesce("met", F.lit(0))
    per_cell = stored(per_cell.select("cell", n.alias("n"), F.coalesce("root", "cell").alias("root")))
    c = stored(m.select("key", "node", "id", "cell").join(per_cell, "cell").join(links, "node", "left").select("key", "id", "root", (F.col("n") + F.coalesce("links", F.lit(0))).alias("n_links")))
    low = stored(c.groupBy("root").agg(F.min("id").alias("component_id")))
    c = c.join(low, "root").select("key", "n_links", "component_id")
    linked = rows.filter("key is not null").select("id", "key").join(c, "key").select("id", "n_links", "component_id")
    alone = rows.filter("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, v FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM e JOIN c USING (vec_id) LEFT JOIN k USING (vec_id)
"""
