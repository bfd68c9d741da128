"""Texts much longer than a block: the same results as in one piece, in bounded memory."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from test_operators import prose

from lodestack.llm import language, toxicity

GAPS = [" ", "  ", "\n", ", ", " - ", "é ", " \t "]


def long_text(seed, words):
    rng = random.Random(seed)
    return "".join(rng.choice(["ring", "Stone", "über", "a", "x1y", "Ärger", "light"]) + rng.choice(GAPS) for _ in range(words))


def raw(*texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def test_features_of_pieces_are_those_of_the_whole():
    for seed in range(40):
        text = long_text(seed, 400) if seed % 4 else "z" * 900 + long_text(seed, 50)
        data, off = raw("short one", text, "", "another short")
        whole = {(i + int(b >> 12), int(b & 4095)) for i, _, both in toxicity.distinct_features(data, off, 12, 1 << 30) for b in both}
        cut = {(i + int(b >> 12), int(b & 4095)) for i, _, both in toxicity.distinct_features(data, off, 12, 97) for b in both}
        on = np.arange(4096) % 3 == 0
        some = {(i + int(b >> 12), int(b & 4095)) for i, _, both in toxicity.distinct_features(data, off, 12, 97, on) for b in both}
        assert some == {(r, f) for r, f in whole if on[f]}
        assert cut == whole and all((np.diff(both) > 0).all() for _, _, both in toxicity.distinct_features(data, off, 12, 97))


def test_n_grams_of_pieces_are_those_of_the_whole():
    def grams(data, off, limit):
        out = []
        for i, _, o, low, starts in language._pieces(data, off, limit):
            for n in language.ORDERS:
                h, ok = language._grams(low, n)
                row = language._within(o, n, len(low))
                ok &= row >= 0
                ok[starts:] = False
                out += [(i + int(r), n, int(g)) for r, g in zip(row[ok], h[ok], strict=True)]
        return sorted(out)

    for seed in range(20):
        data, off = raw("short one", long_text(seed, 300), "x", "", prose(random.Random(seed), 40))
        assert grams(data, off, 101) == grams(data, off, 1 << 30)


def test_memory_follows_the_block_not_the_text():
    column = pa.array([long_text(1, 400_000)])
    size = len(column[0].as_py().encode())
    assert size > 2_500_000
    model = language.Model(["en", "fr"], np.random.default_rng(0).integers(0, 4, (1, 1 << 16)).astype(np.uint8), np.array([0.1, 0.1]))
    weights = toxicity.Weights(np.ones(1 << 16, np.float32), 0.0)
    for work in (lambda: language.score_batch(model, column), lambda: toxicity.score_column(weights, column)):
        work()
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        print(peak / size)
        assert peak < 12 * size + 40 * (1 << 20)
