import random
import zlib

import numpy as np
from helpers import sentence

from tideglass.llm import linear, words


def test_words_are_runs_of_letters_and_digits():
    s = words.WordStream([words.encode(t) for t in ("Hello, wörld-2", "hello wörld 2", None, "?!")])
    assert list(np.diff(s.offsets)) == [3, 3, 0, 0]
    assert (s.hashes[:3] == s.hashes[3:]).all() and len(set(s.hashes[:3].tolist())) == 3
    starts, ends = s.spans(0)
    assert [words.encode("Hello, wörld-2")[a:b].decode() for a, b in zip(starts, ends, strict=True)] == ["hello", "wörld", "2"]


def test_grams_match_brute_force():
    rng = random.Random(1)
    texts = [sentence(rng, n) for n in (0, 1, 4, 5, 6, 40)]
    s = words.WordStream([words.encode(t) for t in texts])
    flat, offsets = words.grams(s.hashes, s.offsets, 5)
    seen: dict[tuple[str, ...], int] = {}
    for i, t in enumerate(texts):
        w = t.split()
        expected = [tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1 if w else 0))]
        got = flat[offsets[i] : offsets[i + 1]].tolist()
        assert len(got) == len(expected)
        for gram, h in zip(expected, got, strict=True):
            assert seen.setdefault(gram, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_texts_stand_alone():
    parts = list(words.chunks(["a", None, "b" * 50, "c"], size=10))
    assert [(i, len(p)) for i, p in parts] == [(0, 2), (2, 1), (3, 1)]


def test_features_and_ftrl_learn_a_word():
    rng = random.Random(2)
    texts = [sentence(rng, 30) + (" worthless" if i % 3 == 0 else "") for i in range(300)]
    spec = linear.FeatureSpec((("word", 1), ("surface", 2), ("shape", 1), ("repeat", 2), ("stem", 1), ("root", 1)), bits=16)
    idx, offsets = linear.features([*texts, None, ""], spec)
    assert len(offsets) == 303 and offsets[-1] == offsets[-3]
    rows = [idx[offsets[i] : offsets[i + 1]].astype(np.int64) for i in range(300)]
    y = np.array([i % 3 == 0 for i in range(300)], float)
    model = linear.fit_ftrl(rows[:200], y[:200], 16)
    p = model.predict(idx, offsets)
    assert ((p[200:300] > 0.5) == (y[200:] > 0)).mean() > 0.95
    same = linear.fit_ftrl(rows[:200], y[:200], 16)
    assert zlib.crc32(model.weights.tobytes()) == zlib.crc32(same.weights.tobytes())


def test_sparse_dot_product_is_the_sum_of_weights():
    model = linear.FtrlModel(np.arange(8, dtype=np.float32), 0.5)
    assert model.logits(np.array([1, 3, 7]), np.array([0, 2, 2, 3])).tolist() == [4.5, 0.5, 7.5]
