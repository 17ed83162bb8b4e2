"""Collocations against a plain count of the whole text."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from railbird.llm import collocations as c


def plain(rows, longest, least, cover, top):
    out = []
    f, n = Counter(), Counter()
    for text, lang in rows:
        lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang or "und", tuple(w[i : i + m])] += 1
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, w), a in good.items():
        inside = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
        if any(x == lang and len(v) > len(w) and 100 * b >= cover * a and inside(v) for (x, v), b in good.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    res, rank = [], Counter()
    for lang, score, a, phrase, l, r, total in sorted(out):  # noqa: E741
        rank[lang] += 1
        if rank[lang] <= top:
            res.append((lang, rank[lang], phrase.decode(), -a, l, r, total, -score))
    return sorted(res)


def texts(seed, docs=60):
    rng = np.random.default_rng(seed)
    words = ["The", "the", "of", "a\x01", "a", "é", "ÀB", "Zz", "_", "x-y", " ", "in", "new", "York", "city"]
    p = rng.dirichlet(np.ones(len(words)))
    rows = []
    for i in range(docs):
        t = ""
        for w in rng.choice(words, rng.integers(0, 60), p=p):
            t += w + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " new York city "], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.02, 0.08])
        rows.append((t, [None, "en", "de", "und"][i % 4]))
    return rows + [(None, "en"), ("", "fr"), (" .,\t", "fr"), ("new York city " * 900, "en"), rows[0], rows[0]]


@pytest.fixture
def many_tasks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("seed", "longest", "least", "top"), [(0, 3, 10, 2000), (1, 3, 2, 7), (2, 4, 3, 2000), (3, 2, 2, 2000)])
def test_equals_a_plain_count(spark, many_tasks, monkeypatch, seed, longest, least, top):
    """Ranges cut through the phrases of single words, and texts are counted in segments of 40 bytes."""
    monkeypatch.setattr(c, "SEGMENT", 40)
    monkeypatch.setattr(c, "ROWS", 3)
    rows = texts(seed)
    d = spark.createDataFrame(rows, "text string, lang string").withColumns({x: F.lit(1) for x in ("f", "phrase", "w1", "_part", "n", "rank")})
    want = plain(rows, longest, least, 50, top)
    assert rows_of(c.mine(d, longest=longest, least=least, top=top)) == want and len(want) > 5


def stream(spark, rows):
    return spark.createDataFrame([(g, f, *(p.split() + [None] * 3)[:3]) for g, p, f in rows], "lang string, f long, w1 string, w2 string, w3 string")


def test_counts_that_begin_in_an_earlier_task(spark, many_tasks):
    """One first word with 3,000 second words fills many tasks; their counts of it come from the task where it stands."""
    rows = [("en", "the", 40_000), *[("en", f"w{i}", 10 + i) for i in range(3000)], *[("en", f"the w{i}", 10) for i in range(3000)], *[("en", f"the w7 w{i}", 10) for i in range(50)]]
    rows += [("en", f"w7 w{i}", 11) for i in range(50)]
    s = c.scored(stream(spark, rows))
    got = {r.phrase: r for r in s.collect()}
    assert len(got) == 3100
    assert all(got[f"the w{i}"].l == 40_000 and got[f"the w{i}"].r == 10 + i and got[f"the w{i}"].score == 10**6 * 100 // (40_000 * (10 + i)) for i in range(3000))
    for i in range(50):
        r = got[f"the w7 w{i}"]
        assert (r.l, r.r, r.score) == min([(40_000, 11, 10**8 // (40_000 * 11)), (10, 10 + i, 10**8 // (10 * (10 + i)))], key=lambda x: x[2])


def test_products_past_64_bits(spark):
    a, l, r = 987_654_321_012_345, 1_234_567_890_123_456, 998_765_432_101_234
    s = c.scored(stream(spark, [("x", "p", l), ("x", "q", r), ("x", "p q", a)])).first()
    assert (s.a, s.l, s.r, s.score) == (a, l, r, 10**6 * a * a // (l * r))


def test_edges(spark):
    d = spark.createDataFrame([], "text string, lang string")
    assert c.mine(d).count() == 0
    assert c.mine(spark.createDataFrame([(None, None), ("", "en"), (". ,", "en")], "text string, lang string")).count() == 0


@pytest.mark.parametrize(("size", "longest"), [(1, 3), (7, 2), (30, 4), (10**6, 3)])
def test_windows_of_segments(size, longest):
    """Each word of every text begins one window, however the texts are cut into segments."""
    rows = texts(9, 12)
    got = Counter()
    for codes, counts, names, words in c.windows([(t or "").encode() for t, _ in rows], [g or "und" for _, g in rows], size, longest):
        for g, *key, n in zip(*(x.tolist() for x in codes), counts.tolist(), strict=True):
            got[names[g], *(words[k].as_py() if k < len(words) else None for k in key)] += n
    want = Counter()
    for t, g in rows:
        lower = re.sub("[A-Z]", lambda x: x[0].lower(), t or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            for i in range(len(w)):
                want[(g or "und", *(w[i : i + longest] + [None] * longest)[:longest])] += 1
    assert got == want


def test_keys_past_64_bits():
    """Six words from 20,000 give keys that have to be folded twice."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 20_000, 30_000)]
    [(codes, counts, _, known)] = c.windows([" ".join(words).encode()], ["x"], 1 << 20, 6)
    name = [*known.to_pylist(), None]
    got = {tuple(name[i] for i in k) for k in zip(*(x.tolist() for x in codes[1:]), strict=True)}
    assert got == {tuple((words[i : i + 6] + [None] * 6)[:6]) for i in range(len(words))} and counts.sum() == 30_000
