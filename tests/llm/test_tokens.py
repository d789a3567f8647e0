"""Token ids of batches: words are parted at once and a part is looked up once, with any memory the ids of the tokenizer."""

import random

import numpy as np
import pyarrow as pa

from runlake.llm import queries
from runlake.llm.tokens import TokenIds


def test_words_of_a_batch_are_parted_at_once(monkeypatch):
    ids = TokenIds(*queries.tokenizer_file())
    looked, found = [], []
    part, pattern = ids._part, ids.pattern
    monkeypatch.setattr(ids, "_part", lambda p: looked.append(p) or part(p))

    class Counted:
        def findall(self, text):
            found.append(text)
            return pattern.findall(text)

    monkeypatch.setattr(ids, "pattern", Counted())
    texts = pa.array([f"Word{'abcdefghij'[i % 10] * (i // 10 + 1)}, and (words)" for i in range(400)])
    first = ids.batch(texts)
    assert len(found) == 1 and len(looked) == len(set(looked)) > 400
    again = ids.batch(texts)
    assert len(found) == 2 and len(looked) == len(set(looked))
    assert [a.tolist() for a in first] == [a.tolist() for a in again]


def test_batches_of_odd_words_are_the_tokenizer_s():
    rng = random.Random(4)
    signs = "abAB'sS,.!19 \n\t\x1c\x85 　éÉİßΣς日́ﬁ<|>²½_-"
    for most in (1, 20, 100_000):
        ids = TokenIds(*queries.tokenizer_file(), most=most)
        plain = ids.tokenizer
        for _ in range(12):
            texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(40)]
            texts += rng.choice([["<|endoftext|> a"], [""], [None], ["a"], ["Ab-c"]])
            got = [x.tolist() for x in ids.batch(pa.array(texts, pa.string()))]
            assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
            assert len(ids.words) <= most and len(ids.parts) <= 2 * most
        for texts in ([], [None], ["", " "], ["日本"], ["one"]):
            got = [x.tolist() for x in ids.batch(pa.array(texts, pa.string()))]
            assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        sliced = pa.array(["before", "Some words", "more", "after"])[1:3]
        assert [x.tolist() for x in ids.batch(sliced)] == [plain.encode(t, add_special_tokens=False).ids for t in ("Some words", "more")]


def test_without_a_pattern_words_go_to_the_tokenizer():
    text, _ = queries.tokenizer_file()
    ids = TokenIds(text)
    texts = ["It's two words,", None, "日本 x"]
    assert [x.tolist() for x in ids.batch(pa.array(texts))] == [ids.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert np.frombuffer(ids("x y"), "<u4").tolist() == ids.tokenizer.encode("x y", add_special_tokens=False).ids
