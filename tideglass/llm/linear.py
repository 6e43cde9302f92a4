"""Hashed word n-gram features and logistic regression by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from .words import SHAPE_BYTES, SPACE_BYTES, WORD_BYTES, WordStream, chunks, grams


@dataclass(frozen=True)
class FeatureSpec:
    """families: (kind, n) with kind 'surface' (words between white space, as written), 'shape' (the
    same with letters, digits and repeats folded), 'word' (lower-cased letters and digits), 'stem'
    and 'root' (their first five and four bytes) or 'repeat' (n equal words in a row). Features are present or absent."""

    families: tuple[tuple[str, int], ...]
    bits: int = 20


def features(texts: Sequence[str | None], spec: FeatureSpec) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature numbers of each text, ascending, and their offsets."""
    out, sizes = [], []
    for _, held in chunks(texts, 1 << 17):
        raw = [(t or "").encode("utf-8", "replace") for t in held]
        low = [(t or "").lower().encode("utf-8", "replace") for t in held]
        streams: dict[str, WordStream] = {}
        keys = []
        for number, (kind, n) in enumerate(spec.families):
            base = "surface" if kind == "repeat" else kind
            if base not in streams:
                streams[base] = {
                    "surface": lambda: WordStream(raw, SPACE_BYTES),  # noqa: B023
                    "shape": lambda: WordStream(raw, SHAPE_BYTES, squeeze=True),  # noqa: B023
                    "word": lambda: WordStream(low, WORD_BYTES),  # noqa: B023
                    "stem": lambda: WordStream(low, WORD_BYTES, prefix=5),  # noqa: B023
                    "root": lambda: WordStream(low, WORD_BYTES, prefix=4),  # noqa: B023
                }[base]()
            s = streams[base]
            if kind == "repeat":
                same = np.concatenate(([False], s.hashes[1:] == s.hashes[:-1]))
                same[np.clip(s.offsets[:-1], 0, max(0, len(same) - 1))] = False
                doc = np.repeat(np.arange(len(held)), np.diff(s.offsets))[same[: len(s.hashes)]] if len(s.hashes) else np.zeros(0, np.int64)
                h = np.full(len(doc), n, np.uint64)
            else:
                h, to = grams(s.hashes, s.offsets, n)
                doc = np.repeat(np.arange(len(held)), np.diff(to))
            slot = ((h * np.uint64(2 * number + 0x9E3779B1)) >> np.uint64(64 - spec.bits)).astype(np.int64)
            keys.append(doc.astype(np.int64) << 32 | slot)
        flat = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        out.append((flat & 0xFFFFFFFF).astype(np.int32))
        sizes.append(np.bincount(flat >> 32, minlength=len(held)))
    if not out:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    return np.concatenate(out), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


#: Passes over the rows, however many there are.
EPOCHS = 6


@dataclass
class FtrlModel:
    """weights[f] for feature f, a bias, and the weights of dense extra inputs."""

    weights: np.ndarray
    bias: float = 0.0
    extra: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def logits(self, idx: np.ndarray, offsets: np.ndarray, extra: np.ndarray | None = None) -> np.ndarray:
        """Sparse dot products, one per text."""
        total = np.concatenate(([0.0], np.cumsum(self.weights[idx], dtype=np.float64)))
        dense = extra @ self.extra if extra is not None and len(self.extra) else 0.0
        return total[offsets[1:]] - total[offsets[:-1]] + self.bias + dense

    def predict(self, idx: np.ndarray, offsets: np.ndarray, extra: np.ndarray | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(idx, offsets, extra), -35, 35)))


def fit_ftrl(rows: Sequence[np.ndarray], labels: np.ndarray, bits: int, *, extra: np.ndarray | None = None, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 0.01, epochs: int = EPOCHS, seed: int = 0) -> FtrlModel:
    """Per-coordinate FTRL-proximal over the rows in a seeded random order, ``epochs`` times; deterministic."""
    dense = 0 if extra is None else extra.shape[1]
    size = (1 << bits) + 1 + dense
    z, n = np.zeros(size), np.zeros(size)
    tail = np.arange(1 << bits, size)
    penal = np.full(size, l1)
    penal[tail] = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return -(zi - np.sign(zi) * penal[i]) * (np.abs(zi) > penal[i]) / ((beta + np.sqrt(n[i])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i = np.concatenate((rows[r], tail))
            x = np.ones(len(i))
            if dense:
                x[-dense:] = extra[r]
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[r]) * x
            step = g * g
            z[i] += g - (np.sqrt(n[i] + step) - np.sqrt(n[i])) / alpha * w
            n[i] += step
    w = weights(np.arange(size))
    return FtrlModel(w[: 1 << bits].astype(np.float32), float(w[1 << bits]), w[(1 << bits) + 1 :])
