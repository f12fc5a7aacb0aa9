"""Hashed character n-grams of texts, as numpy arrays, and a linear classifier on them."""

from __future__ import annotations

import numpy as np

PRIME = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the rolling hash


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(letters: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of each n-gram, of 2^bits; empty where the text is shorter."""
    if len(letters) < n:
        return np.empty(0, np.int64)
    h = np.full(len(letters) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * PRIME + letters[i : len(letters) - n + 1 + i]
    h ^= h >> np.uint64(29)
    h *= PRIME
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Distinct:
    """The different n-grams of one text after another, without sorting: the last place of each bucket is marked."""

    def __init__(self, sizes: tuple[int, ...], bits: int):
        self.sizes, self.bits = sizes, bits
        self.last = np.zeros(1 << bits, np.int64)

    def __call__(self, text: str) -> np.ndarray:
        letters = codes(text)
        found = np.concatenate([hashed(letters, n, self.bits) for n in self.sizes])
        place = np.arange(len(found))
        self.last[found] = place
        return found[self.last[found] == place]


def logistic(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, l2: float, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on rows of active features, each worth ``scale`` of its bucket.

    Plain full-batch descent with momentum and a step from the largest row, so it gives the same model every time.
    Classes weigh alike. The weights returned have the scale multiplied in.
    """
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    used, flat = np.unique(np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64), return_inverse=True)
    value = scale[used][flat]
    row = np.repeat(np.arange(len(rows)), np.diff(starts))
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    step = 4.0 / max(1e-9, np.bincount(row, value**2, len(rows)).max(initial=0) + 1 + 4 * l2)
    w, b, vw, vb = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    for _ in range(rounds):
        z = np.bincount(row, value * w[flat], len(rows)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels)
        vw = 0.9 * vw - step * (np.bincount(flat, value * g[row], len(used)) + l2 * w)
        vb = 0.9 * vb - step * g.sum()
        w, b = w + vw, b + vb
    out = np.zeros(len(scale))
    out[used] = w * scale[used]
    return out, float(b)
