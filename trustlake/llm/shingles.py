"""Sets of hashed word shingles, per text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import tokens

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB)


def hashes(t: tokens.Texts, words: int = 5) -> tuple[tokens.Words, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lowered, and the hash of the shingle that begins at each."""
    w = tokens.words(t)
    h = np.zeros(len(w.hash), np.uint64)
    n = max(0, len(h) - words + 1)
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(_ODD[(k + 1) % len(_ODD)]) + w.hash[k : k + n] * np.uint64(_ODD[k % len(_ODD)])
    h[:n] = tokens.mix(total)
    return w, h


def sets(t: tokens.Texts, words: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, sorted; with fewer words the whole sequence as one; without words none."""
    w, h = hashes(t, words)
    for i in range(len(t)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= words:
            yield np.unique(h[a : b - words + 1])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for y in w.hash[a:b]:
                x = tokens.mix(x * np.uint64(_ODD[0]) + y)
            yield x
        else:
            yield np.zeros(0, np.uint64)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    k = np.searchsorted(b, a)
    return int((b[np.minimum(k, len(b) - 1)] == a).sum())
