"""Near copies of texts, vectors and pictures against brute force."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

from railbird.llm import embed_dedup, media, ngram_join


def components(links: dict) -> dict:
    root = {i: i for i in links}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, js in links.items():
        for j in js:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in links}


def shingles(t: str | None) -> set:
    w = re.findall(ngram_join.WORD, (t or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def check_texts(spark, texts: dict, keep: bool = True):
    s = {i: shingles(t) for i, t in texts.items()}
    links = {i: {j for j in s if j != i and s[i] and s[j] and len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8} for i in s}
    want = {i: (len(links[i]), c) for i, c in components(links).items()}
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in texts.items()], "doc_id long, text string, node string, mult int")
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.similarity_classes(df).collect()}
    assert got == want
    if not keep:
        return
    kept = {r.doc_id for r in ngram_join.one_of_each(df).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}


def test_texts(spark):
    rng = random.Random(1)
    base = [rng.choices([f"w{n}" for n in range(400)], k=rng.randint(20, 120)) for _ in range(12)]
    texts, n = {}, 0
    for b in base:
        for edits in (0, 0, 1, 1, 2, 3, 6):
            w = list(b)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
            texts[n] = " ".join(w)
            n += 1
    for t in (None, "", "   ", "!!!", "one", "One", "one two", "HATIN!! EAOU!! ONE!! TWO!! SIX!!", "a " * 3000, "IS", "é ü"):
        texts[n] = t
        n += 1
    check_texts(spark, texts)


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 7)
    rng = random.Random(2)
    b = [f"w{n}" for n in range(60)]
    texts = {}
    for i in range(40):
        w = list(b)
        w[rng.randrange(60)] = f"x{i}"
        texts[i] = " ".join(w)
    check_texts(spark, texts, keep=False)


def test_large_clusters_by_buckets_or_whole(spark, monkeypatch):
    """A chain of groups that only chance candidates join, compared bucket by bucket and as a whole: the same links."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 4)
    rng = random.Random(3)
    texts, n = {}, 0
    shared = [f"s{k}" for k in range(60)]
    for g in range(8):  # groups whose texts share half of their words with the next group's
        b = shared[:30] + [f"g{g}w{k}" for k in range(30)]
        for _ in range(6):
            w = list(b)
            w[rng.randrange(60)] = f"x{n}"
            texts[n] = " ".join(w)
            n += 1
    real = ngram_join.bucket_plan
    used = []

    def always(large, entries):
        plan = real(large.withColumn("blocks", large.blocks * 1000), entries)
        used.append(plan.count())
        return plan

    monkeypatch.setattr(ngram_join, "bucket_plan", always)
    check_texts(spark, texts, keep=False)
    assert used and used[0] > 0


def test_texts_moved_for_a_large_cluster(spark):
    """A cluster of 12,800 distinct texts is 25 blocks: 300 pairs of blocks move one block each, where blocks of 64 texts would make 19,900."""
    from pyspark.sql import functions as F

    members = spark.range(12_800).select(F.lit(1).cast("long").alias("cluster"), F.col("id").alias("node"), F.array("id").alias("h"))
    blocks = -(-12_800 // ngram_join.BLOCK_DOCS)
    sizes = spark.createDataFrame([(1, blocks)], "cluster long, blocks int")
    pairs = ngram_join.block_pairs(members, sizes, ["h"]).select(F.size("ma").alias("a"), F.size("mb").alias("b")).collect()
    crossed = [r for r in pairs if r.b is not None and r.b > 0]
    assert len(crossed) == blocks * (blocks - 1) // 2 == 300 and len(pairs) - len(crossed) == blocks
    assert sum(r.a * r.b for r in crossed) + sum(r.a * (r.a - 1) // 2 for r in pairs if r not in crossed) == 12_800 * 12_799 // 2


def test_one_of_each_keeps_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "u", 7), (2, "a b c d e f", "v", 8), (3, None, "w", 9)], "doc_id long, text string, _kept string, kept int")
    assert sorted(map(tuple, ngram_join.one_of_each(df).collect())) == [(1, "a b c d e f", "u", 7), (3, None, "w", 9)]
    assert ngram_join.one_of_each(df).columns == df.columns


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_links, r.class_id) for r in ngram_join.similarity_classes(df).collect())
    assert got == [(-1, 2, 5), (5, 2, 5), (5, 2, 5), (9, 0, 9)]
    assert ngram_join.one_of_each(df).count() == 2
    assert ngram_join.similarity_classes(df.limit(0)).count() == 0


def test_bands_reach_their_recall():
    bands, rows = ngram_join.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 128


def check_vectors(spark, rows):
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float) / np.linalg.norm(v)
    links = {i: {j for j in good if j != i and i in good and len(good[i]) == len(good[j]) and float(good[i] @ good[j]) >= 0.9} for i, _ in rows}
    want = {i: (len(links[i]), c) for i, c in components(links).items()}
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cell int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()}
    same = sum(got[i][:2] == want[i] for i in want)
    assert len(got) == len(want) and all(k == (c == i) for i, (_, c, k) in got.items())
    return same / len(want)


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 5)
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        c = rng.normal(size=32)
        for noise in (0, 0, 0.05, 0.1, 0.2, 0.3, 0.33, 0.36):
            rows.append((len(rows), [float(np.float32(x)) for x in c + noise * rng.normal(size=32)]))
    rows += [(500, None), (501, []), (502, [0.0] * 32), (503, [float("nan")] * 32), (504, [None, *[1.0] * 31]), (505, [1.0, 2.0]), (506, [2.0, 4.0]), (507, [1.0]), (508, [-1.0])]
    assert check_vectors(spark, rows) == 1.0


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(150):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(len(rows), a.tolist()), (len(rows) + 1, (0.905 * a + np.sqrt(1 - 0.905**2) * b).tolist())]
    assert check_vectors(spark, rows) >= 0.97


def test_hot_group_of_spread_vectors(spark, monkeypatch):
    """A group whose vectors link with one another but are no tight group: counted in blocks, each pair once."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 40)
    monkeypatch.setattr(embed_dedup, "TILE", 16)
    rng = np.random.default_rng(12)
    c = rng.normal(size=64)
    c /= np.linalg.norm(c)
    rows = []
    for i in range(300):
        v = c + 0.25 * (u := rng.normal(size=64)) / np.linalg.norm(u)
        rows.append((i, v.tolist()))
    rows += [(1000 + i, rng.normal(size=64).tolist()) for i in range(200)]
    assert check_vectors(spark, rows) >= 0.99


def test_tables_reach_the_recall_at_any_size():
    for rows, dim in ((10, 3), (10_000, 64), (10**9, 64), (10**11, 700)):
        tables, hashes = embed_dedup.choose_tables(rows, dim)
        assert 2 <= tables and (tables <= embed_dedup.MOST_TABLES or hashes == 1)


def test_many_vector_lengths(spark):
    rows = [(n, [1.0] * (n // 2 + 1)) for n in range(2010)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {n: (1, n - n % 2) for n in range(2010)}


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_dedup.near_duplicates(df).count() == 0
    assert media.copies(media.pictures(df)).count() == 0


def png(p: np.ndarray) -> bytes:
    def chunk(kind, body):
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    h, w = p.shape
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    lines, up = b"", np.zeros(w, np.int64)
    for y, row in enumerate(p.astype(np.int64)):
        kind = y % 5
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], up[:-1]])
        q = left + up - corner
        da, db, dc = abs(q - left), abs(q - up), abs(q - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        lines += bytes([kind]) + ((row - [0 * row, left, up, (left + up) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
        up = row
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_decoders():
    p = np.random.default_rng(0).integers(0, 256, (20, 31)).astype(np.uint8)
    assert (media.decode(png(p)) == p).all()
    assert (media.decode(b"P5 31 20 255\n" + p.tobytes()) == p).all()
    for bad in (None, b"", b"GIF89a", b"P5 9 9 255\n1", png(p)[:60]):
        assert media.decode(bad) is None


@pytest.mark.parametrize("edit", [lambda p: p[7:-9, 12:], lambda p: np.rot90(p), lambda p: p * 0.6 + 40, lambda p: np.rot90(p[5:, :-11], 2)])
def test_edited_copies_agree(edit):
    rng = np.random.default_rng(5)
    near, far = [], []
    pics = [media.decode(media.picture(rng.normal(size=64), 0)) for _ in range(8)]
    for i, p in enumerate(pics):
        a, b = media.describe(p[None])[0], media.describe(edit(p)[None])[0]
        near.append(media.agreement(*a, *b) >= media.AGREE)
        far.append(media.agreement(*a, *media.describe(edit(pics[i - 1])[None])[0]) >= media.AGREE)
    assert all(near) and not any(far)


def test_copies(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(10):
        v = rng.normal(size=64)
        rows += [(len(rows) + k, bytearray(media.picture(v, k)), "x") for k in range(4)]
    rows += [(90, None, ""), (91, bytearray(b"no picture"), ""), (92, bytearray(b"no picture"), ""), (93, rows[0][1], "")]
    df = spark.createDataFrame(rows, "image_id long, image binary, node string")
    got = {r.image_id: r.class_id for r in media.copies(df).collect()}
    assert sum(got[i] == i - i % 4 for i in range(40)) >= 38
    assert got[90] == 90 and got[92] == 91 and got[93] == 0 and got[91] == 91


@pytest.mark.parametrize("groups", [20, 70])
def test_copies_against_all_pairs(spark, groups):
    """Classes by all pairs that agree, at two sizes: no false link, and nearly all of the true ones are found."""
    rng = np.random.default_rng(groups)
    rows = []
    for _ in range(groups):
        v = rng.normal(size=64)
        rows += [(len(rows) + k, bytearray(media.picture(v, k))) for k in rng.permutation(4)[: rng.integers(1, 4)].tolist()]
    rows = [(i, b) for i, (_, b) in enumerate(rows)] + [(None, rows[0][1]), (None, None)]
    found = {i: media.describe(media.decode(bytes(b))[None])[0] for i, b in rows if i is not None}
    links = {i: {j for j in found if j != i and media.agreement(*found[min(i, j)], *found[max(i, j)]) >= media.AGREE} for i in found}
    want = components(links)
    got = media.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()
    assert len(got) == len(rows) and [r.class_id for r in got if r.image_id is None] in ([0, None], [None, 0])
    classes = {r.image_id: r.class_id for r in got if r.image_id is not None}
    pairs = {(i, j) for i in want for j in want if i < j and want[i] == want[j]}
    mine = {(i, j) for i in classes for j in classes if i < j and classes[i] == classes[j]}
    assert mine <= pairs and len(mine) >= 0.9 * len(pairs) > 0


def test_copies_in_crowded_keys(spark):
    """Every key is shared by many unrelated pictures, and unrelated ones are its first and last."""
    rng = np.random.default_rng(8)
    rows, want = [], set()

    def add(node, z, bits, keys):
        rows.append((node, [float(x) for x in (*z[0], *z[1])], bytearray(np.packbits(bits, axis=1).tobytes()), [int(k) for k in keys]))

    for g in range(60):
        z, bits, keys = rng.uniform(0, 100, (2, 12)), rng.random((12, 256)) < 0.5, np.arange(12) % 3
        add(1000 + g, z, bits, keys)
        if g % 3 == 1:
            add(2000 + g, z + 5, bits ^ (rng.random(bits.shape) < 0.05), keys)
            want.add((1000 + g, 2000 + g))
    for node in (1, 9999):
        add(node, rng.uniform(0, 100, (2, 12)), rng.random((12, 256)) < 0.5, np.arange(12) % 3)
    df = spark.createDataFrame(rows, "node long, xy array<float>, bits binary, keys array<long>")
    assert {(r.a, r.b) for r in media.links(df).collect()} == want


def test_small_crops_and_strong_shrinking():
    rng = np.random.default_rng(9)
    half = lambda p: (p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]) / 4
    crop, small, other = [], [], []
    pics = []
    for _ in range(8):
        fine, coarse = media._box(media._box(rng.normal(size=(1, 448, 448)), 2), 1)[0], np.kron(media._box(rng.normal(size=(1, 112, 112)), 1)[0], np.ones((4, 4)))
        coarse = media._box(coarse[None], 3)[0]
        pics.append(np.clip(128 + 40 * (fine / fine.std() + coarse / coarse.std()), 0, 255).round())
    same = lambda p, q: media.agreement(*media.describe(p[None])[0], *media.describe(q[None])[0]) >= media.AGREE
    for i, p in enumerate(pics):
        crop.append(same(p, p[200:312, 150:262]))
        small.append(same(p, half(half(p))))
        other.append(same(pics[i - 1], half(half(p))) or same(pics[i - 1], p[200:312, 150:262]))
    assert sum(crop) >= 7 and sum(small) >= 7 and not any(other)


def turned(p: np.ndarray, degrees: float, scale: float) -> np.ndarray:
    """A picture scaled, or the middle of it turned, between its pixels by bilinear weights."""
    h, w = p.shape
    side = int(min(h, w) * (0.68 if degrees else min(scale, 1)))
    y, x = np.mgrid[:side, :side] - (side - 1) / 2
    a = np.deg2rad(degrees)
    u, v = (np.cos(a) * y + np.sin(a) * x) / scale + (h - 1) / 2, (np.cos(a) * x - np.sin(a) * y) / scale + (w - 1) / 2
    i, j = np.clip(np.floor(u).astype(int), 0, h - 2), np.clip(np.floor(v).astype(int), 0, w - 2)
    fy, fx = u - i, v - j
    return (p[i, j] * (1 - fy) * (1 - fx) + p[i + 1, j] * fy * (1 - fx) + p[i, j + 1] * (1 - fy) * fx + p[i + 1, j + 1] * fy * fx).round()


@pytest.mark.parametrize(("degrees", "scale"), [(20, 1.0), (45, 1.0), (0, 0.8), (0, 1.3)])
def test_keys_of_freely_turned_and_scaled_copies(degrees, scale):
    """Of the copies that agree, nine in ten share enough keys to be compared; unrelated pictures do not agree."""
    rng = np.random.default_rng(11)
    pics = []
    for _ in range(24):
        fine, coarse = media._box(media._box(rng.normal(size=(1, 224, 224)), 2), 1)[0], media._box(rng.normal(size=(1, 224, 224)), 6)[0]
        pics.append(np.clip(128 + 40 * (fine / fine.std() + coarse / coarse.std()), 0, 255).round())
    agree, met, wrong = 0, 0, 0
    for i, p in enumerate(pics):
        a, b = media.describe(p[None])[0], media.describe(turned(p, degrees, scale)[None])[0]
        if media.agreement(*a, *b) >= media.AGREE:
            agree += 1
            met += len(np.intersect1d(media.corner_keys(a[1]), media.corner_keys(b[1]))) >= media.SHARED
        wrong += media.agreement(*media.describe(pics[i - 1][None])[0], *b) >= media.AGREE
    assert agree >= 18 and met >= 0.9 * agree and not wrong


def test_descriptors_move_by_group_not_by_pair(spark):
    """All pairs of 80 pictures are candidates; what moves is a few copies of each picture's descriptors."""
    rng = np.random.default_rng(12)
    z, bits = rng.uniform(0, 100, (80, 2, 40)), rng.random((80, 40, 256)) < 0.5
    for k in range(0, 80, 8):
        z[k + 1], bits[k + 1] = z[k] + 3, bits[k] ^ (rng.random((40, 256)) < 0.05)
    rows = [(i, [float(x) for x in z[i].ravel()], bytearray(np.packbits(bits[i], axis=1).tobytes())) for i in range(80)]
    one_each = spark.createDataFrame(rows, "node long, xy array<float>, bits binary")
    pairs = spark.createDataFrame([(i, j) for i in range(80) for j in range(i + 1, 80)], "a long, b long")
    store, bus = spark._jsparkSession.sparkContext().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def moved():
        bus.waitUntilEmpty(30_000)
        x = store.executorList(False)
        return sum(x.apply(i).totalShuffleWrite() for i in range(x.size()))

    before = moved()
    got = {(r.a, r.b) for r in media.verified(one_each, pairs).collect()}
    assert got == {(k, k + 1) for k in range(0, 80, 8)}
    assert moved() - before < 1.5e6  # 3,160 pairs of 1.6 KB each would be 10 MB and more
