from __future__ import annotations

import hashlib
import random

import numpy as np
import sentencepiece

from railbird.llm import sp_tokens
from railbird.llm.queries import tokenizer_file

ALPHABET = "ab cde  \n\t▁日é💩\x00<s></s>1290.,'\"ſ²٣"


def test_same_as_the_library():
    words = sp_tokens._words(tokenizer_file())
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())
    rng = random.Random(5)
    texts = ["", " ", "   ", "x" * 3000, "the quick brown fox " * 50, *[" " * n + "a" + " " * (n % 3) for n in range(40)]]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for t in texts:
        ids, back = sp_tokens.encode_one(words, t)
        want = lib.encode(t, add_bos=True, add_eos=True)
        assert list(np.frombuffer(ids, "<u4")) == want, t
        assert back == lib.decode(want), t


def test_table(spark):
    rows = [(1, "Hello  world", "x"), (1, "Hello  world", "x"), (2, None, "y"), (None, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sp_tokens.encode(df, tokenizer_file()).collect()
    assert len(got) == 4 and sum(r.n_tokens == 2 for r in got) == 2
    r = next(r for r in got if r.doc_id == 1)
    assert r.decoded == "Hello  world" and r.n_tokens == len(r.ids)
    assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert sp_tokens.encode(df.limit(0), tokenizer_file()).count() == 0
