from __future__ import annotations

import numpy as np
import pyarrow as pa

from sondeframe.llm import wordscan as S


def test_pieces_hash_as_a_whole(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abCD e"), n)) for n in (0, 3, 90, 4000)] + ["x" * 700, "y " * 90, None]

    def run():
        return [(w.hashes.tolist(), w.bounds.tolist(), [w.grams(n)[1].tolist() for n in (1, 2, 5, 8, 50)]) for _, w in S.scan(pa.array(texts, pa.string()), lower=True, limit=1000)]

    whole = run()
    monkeypatch.setattr(S, "PIECE", 64)
    assert run() == whole


def test_equal_words_and_grams_have_equal_hashes():
    (_, words), = S.scan(pa.array(["a bb a bb c a bb", "bb c"]))
    h = words.hashes
    assert h[0] == h[2] == h[5] and h[1] == h[3] == h[6] == h[7] and h[4] == h[8] and len(set(h.tolist())) == 3
    at, grams = words.grams(2)
    assert at.tolist() == [0, 1, 2, 3, 4, 5, 7] and grams[0] == grams[2] == grams[5] and grams[3] == grams[6] and len(set(grams.tolist())) == 4


def test_grams_tell_orders_apart():
    (_, words), = S.scan(pa.array([" ".join(map(str, range(60))), " ".join(map(str, [1, 0, *range(2, 60)])), " ".join(map(str, range(60)))]))
    for n in (2, 3, 5, 7, 8, 13, 50):
        at, grams = words.grams(n)
        per = 60 - n + 1
        assert (grams[:per] == grams[2 * per :]).all() and grams[0] != grams[per] and len(set(grams[:per].tolist())) == per
