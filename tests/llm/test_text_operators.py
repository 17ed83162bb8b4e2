"""Licenses, private data, toxicity, mixing, language model and chat on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import connection, rows as plain_rows

from railbird.llm import chat, license_scan, lm, mixing, pii, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    (1, "Licensed under CC BY-NC 4.0. cc-by; All Rights  Reserved"), (2, None), (3, ""), (4, "one"), (5, "GENERAL PUBLIC LICENSE " * 400), (6, "all rights all rights reserved rights reserved"),
    (6, "This work is licensed under the very GNU General Public License, version 3."), (None, "cc by"), (8, "Éric ﬁ ÀB İ cc by"), (9, "Released under MIT License"),
]


def docs(spark, data, extra=True):
    df = spark.createDataFrame([(i, t, "s", "en") for i, t in data], "doc_id long, text string, source string, label string")
    return df if extra else df.select("doc_id", "text")


def test_licenses_base(spark):
    got = license_scan.scan(docs(spark, TEXTS)).collect()
    want = []
    for i, t in TEXTS:
        w = re.findall(license_scan.WORD, (t or "").translate(LOW))
        at = [(k, lb) for p, lb in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want.append((i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({lb for _, lb in at}))))
    key = lambda x: str(x)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == sorted(want, key=key)
    by = {(r.doc_id, r.n_words): r for r in got}
    assert "cc-by-nc" in by[1, 12].labels and "gpl-3" in by[6, 13].labels  # one word inserted
    assert by[9, 4].labels == "" and by[9, 4].score == 0.0
    assert all(0 <= r.score <= 1 for r in got)
    assert license_scan.scan(docs(spark, TEXTS).limit(0)).count() == 0


def test_licenses_sql(spark):
    df = docs(spark, TEXTS)
    c = connection("/nonexistent")
    c.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    rel = c.sql(license_scan.ORACLE)
    got = license_scan.scan(df)
    norm = lambda cols, data: plain_rows(cols, [tuple(None if x is None or x != x else x for x in r) for r in data])
    assert norm(got.columns, [tuple(r) for r in got.collect()]) == norm(list(rel.columns), rel.fetchall())


def test_licenses_of_long_texts_take_linear_time(spark):
    import time

    def took(n: int) -> float:
        df = spark.createDataFrame([(1, "word other all rights reserved thing " * (n // 6))], "doc_id long, text string")
        began = time.perf_counter()
        (r,) = license_scan.scan(df).collect()
        assert r.n_words == n // 6 * 6 and r.n_base == n // 6 and r.last_word == n // 6 * 6 - 4
        return time.perf_counter() - began

    took(1000)
    assert took(320_000) <= 3 * took(80_000) + 5


def brute_pii(t: str):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_pii_base_equals_brute_force():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("ab@@..-+10 2(9é") for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == brute_pii(t), t
    assert pii.base_spans("1" * 50_000) == [] and pii.base_spans("a" * 50_000 + "@") == []


def test_pii_table(spark):
    text = "é write ann@mail.example.com or +1 (017) 555-7713 from 10.0.0.1, card 4539 1488 0343 6467"
    data = [(i, text) for i in range(30)] + [(31, None), (32, ""), (33, "none"), (33, "none")]
    df = docs(spark, data)
    crf = pii.learn(df)
    got = {r.doc_id: r for r in pii.detect(df, crf).collect()}
    assert (got[0].n_email, got[0].n_ip, got[0].n_card, got[0].n_phone) == (1, 1, 1, 1)
    assert got[0].base_sha256 == hashlib.sha256(pii.join_spans(brute_pii(text)).encode()).hexdigest()
    assert got[31].spans == "" and got[31].base_sha256 == hashlib.sha256(b"").hexdigest()
    spelt = pii.find("write joe [at] mail [dot] example [dot] com", crf, [])
    assert [k for k, _, _ in spelt] == ["email"]
    red = {r.doc_id: r for r in pii.detect(df, crf, redact=True).collect()}
    assert red[0].text == "é write <EMAIL> or <PHONE> from <IP>, card <CARD>" and red[31].text is None and red[0].label == "en"
    assert pii.detect(df.limit(0), pii.learn(df.limit(0))).count() == 0


def test_pii_is_linear_and_has_no_fixed_cut():
    crf = pii.SemiCrf({"phone:bias": 1.0})
    line = "call " + " ".join(f"{i:03d} {5557700 + i}" for i in range(400))
    found = {line[s:e] for _, s, e in pii.find(line, crf, [])}
    assert "022 5557722" in {line[s:e] for _, s, e in pii.candidates(line, 0, len(line))} and len(found) >= 150
    # Base spans and further spans never overlap, also among very many of both.
    text = " ".join(f"a{i}@x.example.com or 017 555{i:04d}, +1 (017) 555-{i:04d}" for i in range(1500))
    base = pii.base_spans(text)
    extra = sorted((s, e) for _, s, e in pii.find(text, crf, base)[len(base) :])
    cover = sorted((s, e) for _, s, e in base)
    assert extra and all(a[1] <= b[0] for a, b in zip(sorted(extra + cover), sorted(extra + cover)[1:]))


def pii_variants(rng) -> tuple[str, str]:
    """A planted personal datum written in a way that the base patterns do not match, and the text of it."""
    name, host = rng.choice(["ann", "joe.b", "kim_9", "lee"]), rng.choice(["mail.example.com", "site.org", "box.example.net"])
    kind = rng.randrange(3)
    if kind == 0:
        return "email", f"{name} [at] {host.replace('.', ' [dot] ')}"
    if kind == 1:
        return "email", f"{name} at {host.replace('.', ' dot ')}"
    return "phone", f"{rng.randint(1, 9)} (0{rng.randint(10, 99)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"


def test_pii_added_spans_on_held_out_variants(spark):
    """Precision and recall of the spans that the field adds, on planted forms in texts it has not learned from (figures in the README)."""
    rng = random.Random(11)
    filler = "the paper was read by many people in 1998 and cost 25 dollars at page 117 of volume 3".split()
    base = lambda: rng.choice([f"u{rng.randint(1, 999)}@mail.example.com", f"+1 (0{rng.randint(10, 99)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}", f"10.0.{rng.randint(0, 255)}.{rng.randint(1, 255)}"])
    train = [(i, " ".join([*rng.choices(filler, k=12), rng.choice(["write", "call", "mail", "see"]), base(), *rng.choices(filler, k=12)])) for i in range(400)]
    crf = pii.learn(docs(spark, train))
    hits = found = planted = 0
    for _ in range(300):
        kind, form = pii_variants(rng)
        cue = "mail" if kind == "email" else "tel"
        text = " ".join([*rng.choices(filler, k=10), cue, form, *rng.choices(filler, k=10)])
        own = pii.base_spans(text)
        extra = pii.find(text, crf, own)[len(own) :]
        at = text.index(form)
        planted += 1
        hits += any(k == kind and s < at + len(form) and e > at for k, s, e in extra)
        found += len(extra)
    print("recall", hits / planted, "precision", hits / max(found, 1))
    assert hits / planted >= 0.6 and hits / found >= 0.8


def test_semi_markov_decoding_is_best():
    rng = random.Random(0)
    text = "1 22 333 44 555"
    segs = pii.candidates(text + " 6666666", 0, len(text) + 8)[:12]
    crf = pii.SemiCrf({f: rng.uniform(-2, 2) for k, s, e in segs for f in pii.features(text, k, s, min(e, len(text)))})
    best = 0.0
    for m in range(1 << len(segs)):
        pick = [x for i, x in enumerate(segs) if m >> i & 1]
        if all(a[2] <= b[1] or b[2] <= a[1] for i, a in enumerate(pick) for b in pick[:i]):
            best = max(best, sum(crf.score(pii.features(text, *x)) for x in pick))
    got = sum(crf.score(pii.features(text, *x)) for x in crf.decode(text, segs))
    assert got == pytest.approx(best)
    names, p = crf.marginals(text, segs)
    assert all(0 <= q <= 1 for q in p)


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(3)
    words = [f"w{i}o" for i in range(300)]
    data, labels = [], []
    for i in range(400):
        w = rng.choices(words, k=40)
        if i % 5 == 0:
            for _ in range(4):
                w[rng.randrange(40)] = rng.choice(["zorgab", "zorgun", "zorgeti"])
        data.append((i, " ".join(w) + "."))
        labels.append((i, 0, int(i % 5 == 0)))
    df = docs(spark, data + [(900, None), (901, "")])
    lab = spark.createDataFrame(labels + [(1, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, lab)
    assert any(s.startswith("zorg") for s in model[0])
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [i for i in range(400) if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    assert np.mean([got[i].predicted == int(i % 5 == 0) for i in held]) > 0.97
    assert got[900].predicted == 0 and got[901].score == got[900].score
    assert toxicity.clean(df, model).filter("doc_id = 900").count() == 1
    assert toxicity.score(df.limit(0), toxicity.learn(df.limit(0), lab.limit(0))).count() == 0


def test_toxic_grammar():
    i = ("I", 3.0)
    plain = toxicity.clause_weight([i])[0]
    assert toxicity.clause_weight([("T", 0), ("O", 0), i])[0] > plain > toxicity.clause_weight([("N", 0), i])[0]
    assert toxicity.clause_weight([("R", 0), ("O", 0), i])[0] < plain
    assert toxicity.clause_weight([i, ("O", 0), ("T", 0)])[0] > plain
    assert toxicity.clause_weight([("K", 3.0)])[0] == 0 and toxicity.clause_weight([("T", 0), ("K", 3.0)])[0] > 0


def plain_toxic_features(stems: dict, text: str) -> list[float]:
    """The grammar said word by word, without automata: what marks hold at a word follows from the words before it."""
    sums = [0.0] * 7
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        words = toxicity.WORD.findall(clause)
        lex = [max([stems.get(w + "$", 0.0), *[stems.get(w[:n], 0.0) for n in toxicity.PREFIXES if n <= len(w)]]) for w in words]
        kind = ["I" if v > 0 else toxicity.word_class(w) for w, v in zip(words, lex)]
        if not any(k in "IK" for k in kind):
            continue
        total, last, counts = 0.0, 0.0, [0, 0, 0, 0]
        for i, k in enumerate(kind):
            before = lambda c, n: c in kind[max(0, i - n) : i]  # noqa: B023, E731
            neg, rep, tgt = before("N", toxicity.NEGATION_SCOPE), "R" in kind[:i], before("T", toxicity.NEAR)
            if k == "I" or (k == "K" and tgt):
                last = (lex[i] if k == "I" else 3.0) * (0.4 if neg else 1) * (0.6 if rep else 1) * (1.3 if tgt else 1)
                total += last
                counts = [counts[0] + tgt, counts[1] + neg, counts[2] + rep, counts[3] + (k == "K")]
            elif k == "T" and before("I", toxicity.NEAR):
                total += last * 0.3
                counts[0] += 1
                last = 0.0
        if total > 0:
            sums = [sums[0] + total, sums[1] + 1, max(sums[2], total), *[a + b for a, b in zip(sums[3:], counts)]]
    return [math.log1p(x) for x in sums]


def test_toxic_features_equal_plain_recursion(spark):
    rng = random.Random(8)
    stems = {"zor": 2.0, "blarg$": 3.0, "moron$": 1.5}
    words = ["zorgab", "blarg", "blargs", "moron", "you", "du", "not", "said", "kill", "the", "house", "nie", "ruft", "stab", "él", "İx"]
    lex = toxicity.Lexicon(stems)
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". ", "! ", "\n", ": "]) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    for t in texts:
        assert lex.features(t) == pytest.approx(plain_toxic_features(stems, t)), t
    w = np.array([-2.0, 1, 0.5, 0.25, 0.1, -0.3, -0.2, 0.4])
    rows = [(i, t) for i, t in enumerate(texts[:60])] + [(5, texts[5]), (5, texts[5])]
    got = toxicity.score(docs(spark, rows), (stems, w)).collect()
    want = Counter((i, round(1 / (1 + math.exp(-(w[0] + np.dot(w[1:], plain_toxic_features(stems, t))))), 9)) for i, t in rows)
    assert Counter((r.doc_id, round(r.score, 9)) for r in got) == want  # repeated rows stay and score alike


def test_toxicity_of_long_texts():
    import time

    lex = toxicity.Lexicon({"blarg$": 3.0})

    def took(n: int) -> float:
        began = time.perf_counter()
        lex.features("you are a blarg and so. " * n)
        return time.perf_counter() - began

    took(100)
    assert took(40_000) <= 8 * took(10_000) + 0.5


def test_samples_do_not_vanish(spark):
    from railbird.llm.common import share_of

    n = spark.range(200_000).filter(share_of(1e-3, "id")).count()
    assert 120 <= n <= 290 and spark.range(1000).filter(share_of(1.0, "id")).count() == 1000
    assert spark.range(1).select(share_of(1e-15, "id")).first() is not None


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", "c", None]), 999, f"u{i}") for i in range(600)] + [(7, None, "a", 999, "x"), (8, "x y", "d", 999, "y"), (8, "x y", "d", 999, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, _source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and Counter(tuple(r.doc) for r in got) == Counter(rows)  # the caller's columns, also size and _source, stay
    by: dict = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        by.setdefault(r.doc.source, []).append(r)
    total = sum(r.size for r in got)
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(total)
    for rs in by.values():
        assert rs[0].source_size == sum(r.size for r in rs) and abs(sum(r.taken for r in rs) - rs[0].target) <= 40
        assert rs[0].target <= 3 * rs[0].source_size
    again = mixing.mix(df.repartition(7)).collect()
    assert Counter((r.doc.doc_id, r.size, r.taken) for r in got) == Counter((r.doc.doc_id, r.size, r.taken) for r in again)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_of_repeated_rows_and_rows_without_id(spark):
    """500 equal rows share a place, and so many of them are taken as the target asks for; rows without ids are drawn by their text."""
    rows = [(1, "one two three", "a") for _ in range(500)] + [(i, "w " * (i % 9), "b") for i in range(2, 300)] + [(None, f"t{i} x", "c") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).collect()
    for source, most in (("a", 3), ("b", 8), ("c", 2)):
        rs = [r for r in got if r.doc.source == source]
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= most, source
    assert {r.copies for r in got if r.doc.source == "c"} != {0} and len(got) == len(rows)
    c = connection("/nonexistent")
    c.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    want = Counter((None if i is None or i != i else i, s, t) for i, s, _, _, t in c.sql(mixing.ORACLE).fetchall())
    assert Counter((r.doc.doc_id, r.size, r.taken) for r in got) == want


def test_word_scores_equal_brute_force(spark):
    rng = random.Random(5)
    data = [(i, " ".join(rng.choices(["the", "Of", "é", "x%d" % rng.randrange(90), "zz", ""], k=rng.randint(0, 30)))) for i in range(150)] + [(3, "\t a\x0bB \n"), (151, None), (151, None), (None, "the end")]
    got = lm.score(docs(spark, data)).collect()
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + ["\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t in data if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(tok(t)), sum(w in c for w in tok(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(t)), 6)) for i, t in data)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and lm.score(docs(spark, data).limit(0)).count() == 0


def plain_suffix_tree(data):
    """Counts, retained contexts and the probability function of the training texts, in plain Python."""
    d = lm.DEPTH
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    form = lambda t: b"\n" * d + b" ".join(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").translate(LOW).encode())) + b"\n"
    counts: dict = {}
    for i, t in data:
        n = form(t)
        for k in range(d, len(n)) if not held(i) else ():
            for size in range(d + 1):
                counts.setdefault(n[k - size : k], Counter())[n[k]] += 1
    kept = {b""}
    for ctx, nexts in counts.items():
        n, low = sum(nexts.values()), counts[ctx[1:]]
        kl = sum(c / n * math.log(c / n / (low[x] / sum(low.values()))) for x, c in nexts.items())
        if ctx and n >= lm.LEAST_COUNT and kl >= lm.LEAST_KL and 2 * n * kl >= lm.LEAST_G2:
            kept.add(ctx)

    def p(ctx: bytes, x: int) -> float:
        nexts = counts.get(ctx, Counter())
        if not ctx:
            return (nexts[x] + 0.5) / (sum(nexts.values()) + 128)
        low = p(ctx[1:], x)
        return (nexts[x] + lm.SMOOTHING * low) / (sum(nexts.values()) + lm.SMOOTHING) if ctx in kept else low

    return form, kept, p


def lm_texts(n: int = 300):
    rng = random.Random(6)
    words = ["abra", "cadabra", "Öl", "lorem", "ipsum", "zebra"]
    return [(i, " ".join(rng.choices(words, [50, 40, 5, 9, 8, 1], k=rng.randint(0, 25)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "\t Unseen\x0bwörds \n"), (10, "abra abra")]


def test_suffix_tree_equals_brute_force(spark):
    data = lm_texts()
    form, kept, p = plain_suffix_tree(data)
    df = docs(spark, data)
    levels = lm.suffix_tree(df.select("text", lm.held_out(df.doc_id).alias("held_out")))
    got = {int(r.key >> 8).to_bytes(d, "big") for d, level in enumerate(levels) for r in level.filter("kept").collect()}
    assert got == kept and len(kept) > 20
    for r in levels[lm.DEPTH].collect():
        w = int(r.key).to_bytes(lm.DEPTH + 1, "big")
        assert r.p == pytest.approx(p(w[:-1], w[-1]))


def test_scores_equal_brute_force_wherever_windows_are_looked_up(spark, monkeypatch):
    data = lm_texts()
    form, _, p = plain_suffix_tree(data)
    score = lambda t: sum(math.log10(p(n[k - lm.DEPTH : k], n[k])) for n in [form(t)] for k in range(lm.DEPTH, len(n)))
    want = Counter((i, round(score(t), 3)) for i, t in data)
    for most in (2_000_000, 60, 0):
        monkeypatch.setattr(lm.frequent_windows, "__defaults__", (most,))
        assert Counter((r.doc_id, round(r.score, 3)) for r in lm.score(docs(spark, data)).collect()) == want


def test_tree_stays_near_the_words_on_held_out_texts(spark):
    """Bits a byte of held-out texts of known words: a tree of five bytes is worse than the words (1.36 against 1.24), by less than 0.25."""
    rng = random.Random(4)
    syllables = ["ka", "lo", "mi", "ten", "sur", "vo", "pra", "ne"]
    vocabulary = ["".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(3000)]
    data = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(500)]
    got = [r for r in lm.score(docs(spark, data)).collect() if r.held_out]
    size = sum(len(t) + 1 for i, t in data if zlib.crc32(str(i).encode()) % 10 == 0)
    tree, words = (-sum(x) / math.log10(2) / size for x in ([r.score for r in got], [r.base_score for r in got]))
    print("bits a byte", tree, words)
    assert words < tree < words + 0.25


def test_lookup():
    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 1 << 48, 5000).astype(np.uint64))
    known = rng.random(len(key)) < 0.5
    found = lm.Lookup(key[known].astype(np.int64), np.arange(known.sum()))
    value, missing = found(key)
    assert (missing == ~known).all() and (value[known] == np.arange(known.sum())).all()
    value, missing = lm.Lookup(np.zeros(0, np.int64), np.zeros(0))(key)
    assert missing.all() and not value.any()


CHAT = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé"), (1, 3, "ann", None), (2, 0, "system", "x"), (None, 5, None, "lost"), (-1, 6, "unknown", "found"), (None, 7, "unknown", "two"), (1, 700, "bob", "bye"), (1, 2, "bob", "hé"), (1, None, "ann", "early")]


def test_chat(spark, monkeypatch):
    df = spark.createDataFrame([(*t, "p") for t in CHAT], "conv_id long, turn long, role string, text string, participant string")
    r = chat.rotate(df)
    t = {(x.conv_id, x.participant): x for x in chat.whole_texts(r).collect()}
    assert set(t) == {(1, "ann"), (1, "bob"), (None, None), (None, "unknown"), (-1, "unknown")}
    ann = t[1, "ann"]
    assert ann.text == "<|assistant|>early<|end|><|system|>be kind<|end|><|assistant|>hi<|end|><|user bob|>hé<|end|><|user bob|>hé<|end|><|assistant|><|end|><|user bob|>bye<|end|>"
    assert [ann.text[m.start : m.stop] for m in ann.masks] == ["<|assistant|>early<|end|>", "<|assistant|>hi<|end|>", "<|assistant|><|end|>"]
    assert t[None, "unknown"].text == "<|user|>lost<|end|><|assistant|>two<|end|>" and t[None, None].text == "<|assistant|>lost<|end|><|user unknown|>two<|end|>"
    assert chat.rotate(df.limit(0)).count() == 0
    texts = chat.rotate(df.withColumn("conv_id", df.conv_id.cast("string")))
    assert {x.conv_id for x in texts.collect()} == {"1", "-1", None}
    plain = lambda d: Counter(map(tuple, d.collect()))
    whole = plain(r)
    monkeypatch.setattr(chat, "CROWDED", 1)
    monkeypatch.setattr(chat, "STRETCH", 2)
    assert plain(chat.rotate(df)) == whole
    monkeypatch.setattr(chat, "BLOCK", 2)
    monkeypatch.setattr(chat, "BROADCAST_BLOCKS", 0)
    assert plain(chat.rotate(df)) == whole


def test_turns_that_are_no_whole_numbers(spark, monkeypatch):
    """Fractions, signs, infinities, NaN and null keep their order in crowded blocks too."""
    numbers = [i / 10 for i in range(-30, 60)] + [1.2, 1.7, 1.2, -0.5, float("inf"), float("-inf"), float("nan"), float("nan"), None, None, 1e300, 2.0**62]
    df = spark.createDataFrame([(1, x, ["ann", "bob", None][i % 3], f"t{i}") for i, x in enumerate(numbers)], "conv_id long, turn double, role string, text string")
    plain = lambda d: Counter(map(tuple, d.collect()))
    want = plain(chat.rotate(df))
    seq = {r.piece.split(">")[1].split("<")[0]: r.seq for r in chat.rotate(df).filter("participant = 'ann'").collect()}
    rank = lambda x: (x is not None, x is not None and x != x, 0 if x is None or x != x else x)
    order = [rank(numbers[int(t[1:])]) for t in sorted(seq, key=seq.get)]
    assert order == sorted(order) and len(order) == len(numbers)
    for crowded in (5, 1):
        monkeypatch.setattr(chat, "CROWDED", crowded)
        assert plain(chat.rotate(df)) == want
        whole = chat.rotate(df.filter("turn is null or abs(turn) < 100").selectExpr("conv_id", "cast(turn * 10 as decimal(20, 1)) turn", "role", "text"))
        assert whole.count() == 3 * df.filter("turn is null or abs(turn) < 100").count()


def test_chat_sql_and_a_long_conversation(spark, monkeypatch):
    rng = random.Random(9)
    rows = CHAT + [(5, rng.randint(0, 40), rng.choice(["ann", "bob", None, "system", "c c"]), rng.choice(["a", "bé", "x" * 50, None])) for _ in range(400)] + [(6, i, f"p{i % 3}", "t" * (i % 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    c = connection("/nonexistent")
    c.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    rel = c.sql(chat.ORACLE)
    norm = lambda cols, data: plain_rows(cols, [tuple(None if x is None or x != x else x for x in r) for r in data])
    want = norm(list(rel.columns), rel.fetchall())
    for crowded in (100_000, 60):
        monkeypatch.setattr(chat, "CROWDED", crowded)
        got = chat.rotate(df)
        assert norm(got.columns, [tuple(r) for r in got.collect()]) == want
