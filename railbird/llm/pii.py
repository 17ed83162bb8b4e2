"""Personal data by fixed patterns and a semi-Markov conditional random field.

The fixed patterns give the base spans, which always stay. The field works on islands around
digits and at-signs: permissive rules propose candidate segments of bounded length, features see a
segment as a whole (digit count, check digit, separators, octets, the words before it), and dynamic
programming over the island chooses boundaries and types of non-overlapping segments jointly.
Weights are learned by conditional likelihood on a bounded sample of documents, labelled by the fixed
patterns and by variants of the spans they found (spelt-out addresses, numbers without a prefix).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.llm.common import share_of, sliced

#: The kinds in their order and the base patterns (possessive where that changes no match).
KINDS = ("email", "ip", "card", "phone")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TRIGGER = re.compile(r"[0-9@]")
#: Learning reads about so many documents at most, and so many distinct islands in them (those of the least digests).
MAX_SAMPLE = 6_000
MAX_ISLANDS = 1_500
#: Number groups in one candidate segment, characters between two of them, and signs before the first.
MAX_GROUPS, MAX_GAP, MAX_LEAD = 8, 4, 2
NUMBER_RUN = re.compile(r"[+(]?[0-9](?:[().\x20/-]*[0-9])*")
GROUP = re.compile(r"[0-9]+")
AT_RUN = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:\s?[\[(]?\s?(?:@|\bat\b)\s?[\])]?\s?)[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[\[(]?\s?\bdot\b\s?[\])]?\s?)[A-Za-z0-9-]{1,63}){1,5}")
CUES = {k: frozenset(v.split()) for k, v in {"email": "mail email contact e-mail correo courriel", "ip": "ip host server addr address", "card": "card visa mastercard credit karte carte tarjeta", "phone": "tel phone call mobile fax telefon téléphone teléfono"}.items()}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Base spans by kind in the order of ``KINDS``, then by start; offsets in code points."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        # The leftmost match with this at-sign begins where its run of address characters does.
        start = at
        while start > end and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        m = EMAIL_HOST.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if not TRIGGER.search(text):
        return out
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isascii() and c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches that can hold a segment: number runs of 7 digits or more, and addresses."""
    found = [m.span() for m in NUMBER_RUN.finditer(text) if m.end() - m.start() >= 7 and sum(c.isdigit() for c in m.group()) >= 4]
    if "@" in text or " at " in text or "[at]" in text:
        found += [m.span() for m in AT_RUN.finditer(text) if "@" in m.group() or "dot" in m.group()]
    found.sort()
    out: list[tuple[int, int]] = []
    for s, e in found:
        if out and s <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def candidates(text: str, begin: int, end: int) -> list[Span]:
    """Candidate segments of an island: (kind, start, end), at most MAX_GROUPS number groups each."""
    out: set[Span] = set()
    for m in NUMBER_RUN.finditer(text, begin, end):
        groups = [g.span() for g in GROUP.finditer(text, *m.span())]
        for i, (s, _) in enumerate(groups):
            lead = {s}
            while s > begin and text[s - 1] in "+(" and len(lead) <= MAX_LEAD:
                s -= 1
                lead.add(s)
            n = 0
            for j in range(i, min(i + MAX_GROUPS, len(groups))):
                if j > i and groups[j][0] - groups[j - 1][1] > MAX_GAP:
                    break
                n += groups[j][1] - groups[j][0]
                if n > 19:
                    break
                if n >= 4:
                    for b in lead:
                        out.update((k, b, groups[j][1]) for k in KINDS[1:])
    for m in AT_RUN.finditer(text, begin, end):
        out.add(("email", *m.span()))
    return sorted(out, key=lambda x: (x[2], x[1], x[0]))


def features(text: str, kind: str, s: int, e: int) -> list[str]:
    """Names of the whole-segment features."""
    seg = text[s:e]
    before = [w.strip(":.,;()").lower() for w in text[max(0, s - 40) : s].split()[-2:]]
    digits = "".join(c for c in seg if "0" <= c <= "9")
    f = ["bias", "cue" if any(w in CUES[kind] for w in before) else "no-cue"]
    f.append("left-" + ("edge" if s == 0 or text[s - 1].isspace() else "glued" if text[s - 1].isalnum() or text[s - 1] in "+(.-" else "mark"))
    f.append("right-" + ("edge" if e == len(text) or text[e].isspace() else "glued" if text[e].isalnum() or text[e] == "-" else "mark"))
    if kind == "email":
        f += ["sign" if "@" in seg else "spelt", "dots" if "." in seg else "no-dots", "spaces" if " " in seg else "tight", "marked" if "[" in seg or "(" in seg else "plain"]
    else:
        n, parts = len(digits), seg.split(".")
        f += [f"digits-{n}", "luhn" if n >= 13 and luhn(digits) else "no-luhn", "plus" if seg[0] == "+" else "no-plus"]
        f += ["seps-" + "".join(sorted({c for c in seg[1:] if not c.isdigit()}))[:4], f"groups-{min(len(GROUP.findall(seg)), 6)}"]
        if kind == "ip":
            f.append("octets" if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts) else "no-octets")
    return [f"{kind}:{x}" for x in f]


class SemiCrf:
    """Segments score the sum of their features' weights; what lies outside of segments scores 0."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w = weights or {}

    def score(self, names: list[str]) -> float:
        return sum([self.w.get(n, 0.0) for n in names])

    def decode(self, text: str, segs: list[Span]) -> list[Span]:
        """The best set of non-overlapping segments (``segs`` ordered by end)."""
        ends = [e for _, _, e in segs]
        best: list[tuple[float, int, int]] = [(0.0, -1, 0)]  # (score, segment taken or -1, state before it)
        for i, (k, s, e) in enumerate(segs):
            prev = bisect_left(ends, s + 1, 0, i)
            v = best[prev][0] + self.score(features(text, k, s, e))
            best.append((v, i, prev) if v > best[-1][0] else (best[-1][0], -1, i))
        out, i = [], len(segs)
        while i:
            _, seg, prev = best[i]
            if seg >= 0:
                out.append(segs[seg])
            i = prev
        return out[::-1]

    def marginals(self, text: str, segs: list[Span]) -> tuple[list[list[str]], list[float]]:
        """Features of each segment and the probability that it is chosen (forward and backward sums)."""
        names = [features(text, *x) for x in segs]
        v = [self.score(x) for x in names]
        ends, n = [e for _, _, e in segs], len(segs)
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        prev = [bisect_left(ends, s + 1, 0, i) for i, (_, s, _) in enumerate(segs)]
        fwd = [0.0]
        for i in range(n):
            fwd.append(add(fwd[i], fwd[prev[i]] + v[i]))
        # Outside sums along the same lattice, from the end.
        out = [-math.inf] * (n + 1)
        out[n] = 0.0
        for i in range(n - 1, -1, -1):
            out[i] = add(out[i], out[i + 1]) if out[i] > -math.inf else out[i + 1]
            back = out[i + 1] + v[i]
            out[prev[i]] = add(out[prev[i]], back) if out[prev[i]] > -math.inf else back
        return names, [math.exp(min(0.0, fwd[prev[i]] + v[i] + out[i + 1] - fwd[n])) for i in range(n)]

    def learn(self, data: list[tuple[str, list[Span]]], rounds: int = 8, rate: float = 0.3, decay: float = 1e-3) -> SemiCrf:
        """Stochastic gradient of the conditional likelihood; ``data`` are islands with their gold spans."""
        order = list(range(len(data)))
        for epoch in range(rounds):
            random.Random(epoch).shuffle(order)
            step = rate / (1 + 0.5 * epoch)
            for i in order:
                text, gold = data[i]
                segs = candidates(text, 0, len(text))
                for g in gold:
                    if g not in segs:
                        segs.append(g)
                segs.sort(key=lambda x: (x[2], x[1], x[0]))
                names, p = self.marginals(text, segs)
                for seg, fs, q in zip(segs, names, p):
                    d = step * ((seg in gold) - q)
                    if abs(d) > 1e-5:
                        for f in fs:
                            self.w[f] = self.w.get(f, 0.0) * (1 - step * decay) + d
        return self


def _snippets(text: str) -> list[tuple[str, list[Span]]]:
    """Islands with some text around them and their base spans (the longest where some overlap)."""
    base = sorted(base_spans(text), key=lambda x: (x[1] - x[2], x[1]))
    out = []
    for s, e in islands(text):
        a, b = max(0, s - 30), min(len(text), e + 10)
        gold: list[Span] = []
        for k, x, y in base:
            if a <= x and y <= b and all(y <= g[1] or x >= g[2] for g in gold):
                gold.append((k, x, y))
        out.append((text[a:b], sorted((k, x - a, y - a) for k, x, y in gold)))
    return out


def variants(text: str, gold: list[Span]) -> list[tuple[str, list[Span]]]:
    """The same island with its only span written as people also write it."""
    if len(gold) != 1:
        return []
    k, s, e = gold[0]
    seg = text[s:e]
    forms = []
    if k == "email":
        forms = [seg.replace("@", " [at] ").replace(".", " [dot] "), seg.replace("@", " at ").replace(".", " dot ")]
    elif k == "phone":
        forms = ["tel " + seg[1:]]
    return [(text[:s] + f + text[e:], [(k, s + (4 if f.startswith("tel ") else 0), s + len(f))]) for f in forms]


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = MAX_SAMPLE, islands_most: int = MAX_ISLANDS) -> SemiCrf:
    """The field, learned from about ``most`` documents with a digit or an at-sign, chosen by the hash of their id and text.

    Of their distinct islands the ``islands_most`` with the least digests are used. Null texts have none; without islands
    the field finds nothing. Repeated texts are one island.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    n = rows.count()
    if n > most:
        rows = rows.filter(share_of(most / n, "_id", "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(hashlib.md5(t.encode()).hexdigest(), t, join_spans(g)) for text in pdf["text"] for t, g in _snippets(text)]
            yield pd.DataFrame(got, columns=["h", "text", "spans"])

    found = rows.select("text").mapInPandas(run, "h string, text string, spans string").distinct().orderBy("h").limit(islands_most).collect()
    data = []
    for r in found:
        gold = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        data.append((r["text"], gold))
        data += variants(r["text"], gold)
    return SemiCrf().learn(data)


def find(text: str, crf: SemiCrf, base: list[Span]) -> list[Span]:
    """Base spans and the field's further spans, which overlap none of them."""
    out = list(base)
    taken: list[list[int]] = []  # what the base spans cover, as stretches that do not touch
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    ends = [e for _, e in taken]
    free = lambda s, e: (k := bisect_right(ends, s)) == len(taken) or taken[k][0] >= e
    for begin, end in islands(text):
        segs = [x for x in candidates(text, begin, end) if free(x[1], x[2])]
        if segs:
            a, b = max(0, begin - 30), min(len(text), end + 10)
            part = text[a:b]
            out += [(k, s + a, e + a) for k, s, e in crf.decode(part, [(k, s - a, e - a) for k, s, e in segs])]
    return out


def detect(docs: DataFrame, crf: SemiCrf, id_col: str = "doc_id", text: str = "text", redact: bool = False) -> DataFrame:
    """One row per row of ``docs``: (id, n_email, n_ip, n_card, n_phone, base_sha256, spans[, text]).

    The counts and base_sha256 are those of the base spans; spans holds all. With ``redact`` every column of
    ``docs`` is kept instead and the text has each span replaced by ``<KIND>`` (overlapping spans by the
    first one's). Null and empty texts have no spans, repeated rows stay, other columns are not read. Map-only.
    """
    kind = dict(docs.dtypes)[id_col]

    def spans_of(t) -> tuple[list[Span], list[Span]]:
        if not t:
            return [], []
        base = base_spans(t)
        return base, find(t, crf, base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans = [], []
            for t in b.column("text").to_pylist():
                base, every = spans_of(t)
                for k, c in zip(KINDS, counts):
                    c.append(sum(k == x for x, _, _ in base))
                digests.append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                spans.append(join_spans(every))
            cols = [b.column("id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    def run_redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            at = b.schema.get_field_index(text)
            masked = [t and mask(t, spans_of(t)[1]) for t in b.column(at).to_pylist()]
            yield b.set_column(at, text, pa.array(masked, pa.string()))

    if redact:
        return docs.mapInArrow(run_redact, docs.schema)
    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])
