"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer maps words to classes: insult (with a weight), threat, target, negation, reported
speech, or none. Insult stems are learned: word beginnings and whole words whose documents
are labelled toxic far more often than chance allows (a likelihood-ratio test, corrected for the
number of candidates). Four small transducers read the classes of a clause: the scope of a negation, a
running report, a target near by, and a pending insult that a later target completes. Their
composition weighs each insult or threat of the clause. The clause weights give the document's
features, and a logistic model learned from the same rows turns them into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.llm.common import share_of, sliced, stored

#: Learning reads about so many labelled rows at most (a share of them by a hash of the id).
MAX_LABELLED = 20_000
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Distinct stems that one task counts before it sends them on.
HELD_STEMS = 100_000
#: Words within so many words of an insult are near it.
NEAR = 4
NEGATION_SCOPE = 3

#: Closed classes of the four languages of the corpus.
TARGET = frozenset("you your yours yourself he she they him her them du dich dir ihr euch sie tu te toi vous il elle ils usted tú ti él ella ellos".split())
NEGATION = frozenset("not never no isn't aren't wasn't nicht kein keine nie ne pas jamais nunca jamás".split())
REPORT = frozenset("said says wrote writes quoted quotes claimed called according sagte schrieb laut dit écrit selon dijo escribió según".split())
THREAT = frozenset("kill murder hurt beat destroy burn shoot stab töten schlagen tuer frapper matar golpear".split())
SEED_INSULTS = frozenset("idiot moron stupid scum trash pathetic worthless loser".split())

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE_END = re.compile(r"[.!?;:\n]+")


def word_class(word: str) -> str:
    return "T" if word in TARGET else "N" if word in NEGATION else "R" if word in REPORT else "K" if word in THREAT else "O"


class Transducer:
    """States 0..n-1 over classes; ``step(state, symbol)`` gives (state, output)."""

    def __init__(self, table: dict[tuple[int, str], tuple[int, str]], default: dict[int, tuple[int, str]]):
        self.table, self.default = table, default

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.table.get((state, symbol)) or self.default[state]


def countdown(symbol: str, length: int, mark: str) -> Transducer:
    """Marks the ``length`` words after ``symbol``."""
    default = {s: (max(s - 1, 0), mark if s else "") for s in range(length + 1)}
    return Transducer({(s, symbol): (length, mark if s else "") for s in range(length + 1)}, default)


def latch(symbol: str, mark: str) -> Transducer:
    """Marks everything after ``symbol`` until the clause ends."""
    return Transducer({(0, symbol): (1, "")}, {0: (0, ""), 1: (1, mark)})


GRAMMAR = (countdown("N", NEGATION_SCOPE, "neg"), latch("R", "rep"), countdown("T", NEAR, "tgt"), countdown("I", NEAR, "ins"))
#: Weight of an insult or threat by the marks at its place.
FACTOR = {"neg": 0.4, "rep": 0.6, "tgt": 1.3}


def clause_weight(symbols: list[tuple[str, float]]) -> tuple[float, int, int, int, int]:
    """(weight, targeted, negated, reported, threats) of one clause of (class, lexical weight)."""
    states = [0] * len(GRAMMAR)
    total, last = 0.0, 0.0
    targeted = negated = reported = threats = 0
    for symbol, weight in symbols:
        marks = set()
        for k, machine in enumerate(GRAMMAR):
            states[k], out = machine.step(states[k], symbol)
            if out:
                marks.add(out)
        if symbol in "IK":
            if symbol == "K":
                if "tgt" not in marks:
                    continue  # a threat needs somebody it is meant for
                threats += 1
            last = weight
            for m in ("neg", "rep", "tgt"):
                last *= FACTOR[m] if m in marks else 1.0
            total += last
            targeted += "tgt" in marks
            negated += "neg" in marks
            reported += "rep" in marks
        elif symbol == "T" and "ins" in marks:
            total += last * (FACTOR["tgt"] - 1)
            targeted += 1
            last = 0.0
    return total, targeted, negated, reported, threats


class Lexicon:
    """Finds stems (word beginnings, or whole words ending in ``$``) with one Aho-Corasick pass."""

    def __init__(self, stems: dict[str, float]):
        import ahocorasick

        self.stems = stems
        self.auto = ahocorasick.Automaton()
        for s in {s.rstrip("$") for s in stems} | THREAT:
            self.auto.add_word(s, len(s))
        self.auto.make_automaton()

    def weight(self, word: str) -> float:
        get = self.stems.get
        return max([get(word + "$", 0.0), *[get(word[:n], 0.0) for n in PREFIXES if n <= len(word)]])

    def features(self, text: str | None) -> list[float]:
        """Features of the matched clauses; all zero without any."""
        low = (text or "").lower()
        starts = [e + 1 - n for e, n in self.auto.iter(low)]
        starts = sorted({s for s in starts if not (s and low[s - 1].isalpha())})
        sums = np.zeros(7)
        done = 0
        for s in starts:
            if s < done:
                continue
            # The clause begins after the last end mark since the clause before, so every character is looked at once.
            begin = max(max(low.rfind(c, done, s) for c in ".!?;:\n") + 1, done)
            m = CLAUSE_END.search(low, s)
            done = m.start() if m else len(low)
            symbols = []
            for w in WORD.findall(low, begin, done):
                v = self.weight(w)
                symbols.append(("I", v) if v > 0 else (c := word_class(w), 3.0 if c == "K" else 0.0))
            total, *counts = clause_weight(symbols)
            if total > 0:
                sums += [total, 1, 0, *counts]
                sums[2] = max(sums[2], total)
        return [*np.log1p(sums).tolist()]


def _stem_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of stems, sent on whenever HELD_STEMS of them are held."""
    pos, neg = Counter(), Counter()

    def flush() -> pd.DataFrame:
        items = [(s, c, 0) for s, c in pos.items()] + [(s, 0, c) for s, c in neg.items()]
        pos.clear()
        neg.clear()
        return pd.DataFrame(items, columns=["stem", "pos", "neg"])

    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            words = set(WORD.findall((text or "").lower()))
            found = {w + "$" for w in words}
            for n in PREFIXES:
                found.update([w[:n] for w in words if len(w) >= n])
            (pos if toxic else neg).update(found)
            if len(pos) + len(neg) >= HELD_STEMS:
                yield flush()
    yield flush()


def sample_share(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """About ``most`` rows at most: those whose id's hash falls under the share; all of a smaller table."""
    n = df.count()
    return df if n <= most else df.filter(share_of(most / n, id_col))


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Stems with their log odds, from ``sample(text, toxic)`` of distinct texts."""
    sizes = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    p, n = float(sizes[0] or 0), float(sizes[1] or 0)
    if not p or not n:
        return {s + "$": 3.0 for s in SEED_INSULTS}
    counts = sample.mapInPandas(_stem_counts, "stem string, pos long, neg long").groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = stored(counts.filter("pos >= 2"))
    tried = counts.count()
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    x = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    share = p / (p + n)
    g2 = 2 * (x(a, (a + b) * share) + x(b, (a + b) * (1 - share)))
    odds = F.log((a + 0.5) / (p + 1)) - F.log((b + 0.5) / (n + 1))
    good = counts.select("stem", odds.alias("odds"), g2.alias("g2")).filter((F.col("g2") >= 2 * float(np.log(max(tried, 10)))) & (F.col("odds") >= 2.5))
    rows = good.collect()  # as the sample is bounded, so are its stems
    return {r["stem"]: float(r["odds"]) for r in rows} or {s + "$": 3.0 for s in SEED_INSULTS}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the first is the bias) by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = MAX_LABELLED) -> tuple[dict[str, float], np.ndarray]:
    """(stems, weights) from the labelled rows that are not held out; labels without a value are left out."""
    lab = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and _id is not null")
    lab = sample_share(lab.filter(~held_out(F.col("_id"))), "_id", most)
    # At most about ``most`` ids are broadcast.
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(lab), "_id")
    sample = stored(rows.groupBy("text").agg(F.max("toxic").alias("toxic")))
    stems = learn_stems(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(stems)
        for pdf in batches:
            yield pd.DataFrame({"f": [lex.features(t) for t in pdf["text"]], "toxic": pdf["toxic"]})

    got = sample.mapInPandas(run, "f array<double>, toxic int").collect()
    x, y = np.array([r["f"] for r in got]).reshape(len(got), 7), np.array([r["toxic"] for r in got], float)
    if not len(got) or y.min() == y.max():
        return stems, np.array([-3.0, 2.0, 0, 0, 0, 0, 0, 0])
    return stems, fit_logistic(x, y)


def held_out(id_col):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, held_out, score, predicted).

    Null and empty texts match nothing and get the score of a text without matches. Repeated rows
    get equal scores. Further columns are neither read nor carried. Map-only.
    """
    kind = dict(docs.dtypes)[id_col]
    probability = _probability(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = probability()
        for b in sliced(batches):
            s = p(b.column("text"))
            out = [b.column("id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "held_out", "score", "predicted"])

    src = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text).alias("text"))
    return src.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below 0.5. Map-only; cases as in ``score``."""
    probability = _probability(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = probability()
        for b in sliced(batches):
            yield b.filter(pa.array(p(b.column(b.schema.get_field_index(text))) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def _probability(model: tuple[dict[str, float], np.ndarray]):
    """A function that a task calls once for its scorer of Arrow text columns."""
    stems, w = model

    def make():
        lex = Lexicon(stems)

        def of(texts: pa.Array) -> np.ndarray:
            f = np.array([lex.features(t) for t in texts.to_pylist()]).reshape(len(texts), 7)
            return 1 / (1 + np.exp(-np.clip(w[0] + f @ w[1:], -30, 30)))

        return of

    return make
