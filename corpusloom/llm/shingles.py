"""Word shingles as sorted 64-bit fingerprints."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def word_prints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words (A-Z lower-cased) of the texts, end to end, and the texts' word counts."""
    prints, sizes = [], []
    for text in texts:
        words = text.encode().lower().split() if text else []
        prints += map(xxh3_64_intdigest, words)
        sizes.append(len(words))
    return np.array(prints, np.uint64), np.array(sizes, np.int64)


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """A fingerprint of the ``width`` words from each place that has as many from there."""
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = (h ^ words[k : n + k]) * _M1
        h = (h ^ h >> np.uint64(32)) * _M2 + _M3
    return mix(h)


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    return h[new]


def shingle_set(text: str | None, width: int = 3) -> np.ndarray:
    """Distinct shingles of ``width`` words (A-Z lower-cased), sorted; fewer words make one, none make none."""
    words, _ = word_prints([text])
    return distinct(rolled(words, min(width, len(words)))) if len(words) else np.zeros(0, np.uint64)


def text_shingles(texts: list[str | None], width: int, weight) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its ``shingle_set`` and, beside it, the least ``weight`` of a shingle's words.

    ``weight`` maps an array of words' fingerprints to one of small numbers.
    """
    words, sizes = word_prints(texts)
    if not len(words):
        return [(np.zeros(0, np.uint64), np.zeros(0, np.uint8))] * len(texts)
    heavy = weight(words)
    whole = rolled(words, width) if len(words) >= width else None
    least = heavy
    if whole is not None:
        least = heavy[: len(whole)].copy()
        for k in range(1, width):
            np.minimum(least, heavy[k : len(whole) + k], out=least)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= width:
            own, light = whole[at : at + n - width + 1], least[at : at + n - width + 1]
            order = np.argsort(own)
            own, light = own[order], light[order]
            new = np.ones(len(own), bool)
            new[1:] = own[1:] != own[:-1]
            out.append((own[new], light[new]))
        elif n:
            out.append((rolled(words[at : at + n], n), heavy[at : at + n].min(keepdims=True)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.uint8)))
        at += n
    return out
