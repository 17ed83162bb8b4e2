"""SentencePiece (BPE) encoding and decoding with a prefix table of last tokens.

For every prefix of a word the table keeps the one token that ends the encoding of that prefix. All
pieces that end at a position come from one Aho-Corasick pass; a piece ``t`` is the last token
there if and only if it is compatible with the last token ``u`` of the prefix before it, that is, if
encoding the string ``u + t`` alone gives exactly ``[u, t]``. Greedy merging never looks across a
boundary that it does not merge, so a sequence is the encoding exactly when all its neighbours are
compatible. The ids are recovered backwards from the end of the table.

Texts are first cut where no piece of the vocabulary can reach across (two neighbouring characters
that no piece holds side by side in the classes below), which leaves words; a word that a Python
worker has met before comes from a memory bounded in bytes. Only the ids of a word are remembered, and its decoded text where that
is not the word itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.llm.common import sliced

SPACE = "▁"
#: Bytes of words, and number of pairs of pieces, that one Python worker remembers, about.
MEMORY_BYTES = 48 << 20
MEMORY_PAIRS = 150_000
#: Bytes of ids in one batch of results, about.
BATCH_BYTES = 4 << 20
#: Longer words are encoded piecewise without being remembered.
MEMORY_CHARS = 64


class PieceTable:
    """Vocabulary of one SentencePiece BPE model with byte fallback, and the prefix-table encoder."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bos, self.eos = m.bos_id(), m.eos_id()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.text: list[str] = [""] * m.get_piece_size()
        self.byte_id = [0] * 256
        self.byte_of: dict[int, int] = {}
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_of[i] = int(p[3:5], 16)
                self.byte_id[self.byte_of[i]] = i
            elif not m.is_control(i) and not m.is_unknown(i):
                self.ids[p], self.score[p], self.text[i] = i, m.get_score(i), p.replace(SPACE, " ")
        auto = ahocorasick.Automaton()
        for p, i in self.ids.items():
            auto.add_word(p, (i, len(p)))
        auto.make_automaton()
        self.auto = auto
        self.piece = {i: p for p, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.chars = {p for p in self.ids if len(p) == 1}
        self.cut = self._cuts()

    def _cuts(self) -> re.Pattern:
        """The widest of a few word patterns across whose boundaries no piece reaches."""
        letter = re.compile(r"[^\W\d_]")
        kind = lambda c: "s" if c == SPACE else "d" if c in "0123456789" else "l" if letter.match(c) else "o"
        seen = {kind(a) + kind(b) for p in self.ids for a, b in zip(p, p[1:])}
        if {"ls", "ds", "os"} & seen:
            return re.compile(r"(?s).+")
        if not {"lo", "ol", "ld", "dl", "od", "do"} & seen:
            return re.compile(rf"(?s){SPACE}*(?:[^\W\d_{SPACE}]+|[0-9]+|(?:(?![^\W\d_]|[0-9]|{SPACE}).)+)|{SPACE}+")
        return re.compile(rf"(?s){SPACE}*[^{SPACE}]+|{SPACE}+")

    def merge(self, symbols: list[str]) -> list[str]:
        """Greedy merging: the neighbours whose joint piece scores best, the leftmost of equals."""
        s, score = list(symbols), self.score
        while True:
            best, at = None, -1
            for k in range(len(s) - 1):
                v = score.get(s[k] + s[k + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, k
            if at < 0:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def fits(self, u: int, t: int) -> bool:
        """Pair compatibility: does ``u + t`` encode to ``[u, t]``? u is -1 at the start of a word."""
        a, b = self.piece.get(u, ""), self.piece[t]
        ok = self.merge(list(a + b)) == ([a, b] if a else [b])
        if len(self.pairs) >= MEMORY_PAIRS:
            self.pairs.clear()
        self.pairs[u * len(self.text) + t] = ok
        return ok

    def encode_word(self, w: str) -> list[int]:
        out: list[int] = []
        start, known = 0, self.chars
        if known.issuperset(w):
            return self._span(w)
        for k, c in enumerate(w):
            if c not in known:  # no piece holds it: its bytes stand alone
                if k > start:
                    out += self._span(w[start:k])
                out += [self.byte_id[b] for b in c.encode("utf-8")]
                start = k + 1
        if start < len(w):
            out += self._span(w[start:] if start else w)
        return out

    def _span(self, w: str) -> list[int]:
        n, pairs, size = len(w), self.pairs, len(self.text)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for end, (t, long) in self.auto.iter(w):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - long
            u = last[begin]
            if u < 0 and begin:
                continue
            ok = pairs.get(u * size + t)
            if ok is None:
                ok = self.fits(u, t)
            if ok:
                last[end], back[end] = t, begin
        ids = []
        while n:
            ids.append(last[n])
            n = back[n]
        return ids[::-1]

    def decode_ids(self, ids: list[int]) -> str:
        """Text of whole words' ids; byte tokens that are not UTF-8 become U+FFFD each."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.text[i] for i in ids])
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.text[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


class _Words(dict):
    """word -> ids as little-endian unsigned 32-bit integers.

    Two generations share the memory: when the younger one is full it becomes the older one, whose words return
    to the younger one when they are met again. ``decoded`` has the words that decode to another text than their own.
    """

    def __init__(self, table: PieceTable):
        super().__init__()
        self.table, self.older, self.held = table, {}, 0
        self.decoded: dict[str, str] = {}

    def __missing__(self, w: str) -> bytes:
        got = self.older.get(w)
        if got is None:
            ids = self.table.encode_word(w)
            got = b"".join([i.to_bytes(4, "little") for i in ids])
            text = self.table.decode_ids(ids)
            if text != w.replace(SPACE, " "):
                self.decoded[w] = text
        if len(w) <= MEMORY_CHARS:
            self.held += 180 + len(w) + len(got)
            if self.held > MEMORY_BYTES // 2:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[w] = got
        return got


_loaded: dict[str, _Words] = {}


def _words(model_file: str) -> _Words:
    if model_file not in _loaded:
        _loaded.clear()  # a worker keeps one model
        _loaded[model_file] = _Words(PieceTable(model_file))
    return _loaded[model_file]


def encode_one(words: _Words, text: str | None) -> tuple[bytes, str]:
    """(ids with begin and end id as little-endian uint32 bytes, decoded text) of one text."""
    t = words.table
    head, tail = t.bos.to_bytes(4, "little"), t.eos.to_bytes(4, "little")
    if not text:
        return head + tail, ""
    if len(words.decoded) > 10_000:
        words.decoded = {k: v for k, v in words.decoded.items() if k in words or k in words.older}
    marked = (SPACE + text).replace(" ", SPACE)
    found = t.cut.findall(marked)
    ids = b"".join([words[w] for w in found])
    if words.decoded:
        odd = words.decoded
        decoded = "".join([odd[w] if w in odd else w.replace(SPACE, " ") for w in found])
    else:
        decoded = marked.replace(SPACE, " ")  # every word decodes to itself
    return head + ids + tail, decoded[1:]


def encode(docs: DataFrame, model_file: str, text: str = "text", id_col: str = "doc_id", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: (id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>][, decoded]).

    Null and empty texts encode to the begin and end id and decode to the empty text. Repeated rows
    stay. Further columns of ``docs`` are not carried. Map-only: no shuffle; a long text is one row,
    cut into words, so memory follows the longest text, not the partition.
    """
    extra = (", ids array<int>" if with_ids else "") + (", decoded string" if with_text else "")
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(model_file)
        for b in sliced(batches):
            done, held = 0, 0
            rows: list[tuple[int, str, str, bytes | None, str | None]] = []
            for k, text in enumerate(b.column("text")):
                raw, decoded = encode_one(words, text.as_py())
                rows.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest(), raw if with_ids else None, decoded if with_text else None))
                held += (len(raw) if with_ids else 0) + (len(decoded) if with_text else 0)
                if held >= BATCH_BYTES or k + 1 == b.num_rows:
                    yield batch(b.column("id").slice(done, k + 1 - done), rows)
                    done, held, rows = k + 1, 0, []

    def batch(ids: pa.Array, rows: list) -> pa.RecordBatch:
        sizes = np.array([r[0] for r in rows], np.int64)
        out = {id_col: ids, "n_tokens": pa.array(sizes), "ids_sha256": pa.array([r[1] for r in rows], pa.string()), "decoded_sha256": pa.array([r[2] for r in rows], pa.string())}
        if with_ids:
            flat = np.frombuffer(b"".join([r[3] for r in rows]), "<u4").astype(np.int32)
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
        if with_text:
            out["decoded"] = pa.array([r[4] for r in rows], pa.string())
        return pa.RecordBatch.from_pydict(out)

    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
