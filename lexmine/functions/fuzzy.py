"""Fuzzy likeness from its public definition: Indel ratios of whole texts, tokens and parts."""

from __future__ import annotations

import functools
import heapq

import numpy as np


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a row of bits for each letter of b."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * _lcs(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a part of the longer one that is as long, or a shorter part at its ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    n = len(a)
    parts = {b[max(0, k) : k + n] for k in range(1 - n, len(b))}
    return max(ratio(a, p) for p in parts)


def _tokens(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_ratio(a: str, b: str) -> float:
    """The better of the ratio of sorted tokens and of shared tokens with the rest of each side."""
    both, x, y = _tokens(a, b)
    best = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    if both:
        if not x or not y:
            return 100.0
        best = max(best, ratio(both, f"{both} {x}"), ratio(both, f"{both} {y}"), ratio(f"{both} {x}", f"{both} {y}"))
    return best


def partial_token_ratio(a: str, b: str) -> float:
    both, x, y = _tokens(a, b)
    return 100.0 if both else max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(x, y))


def weighted_ratio(a: str, b: str) -> float:
    """The best of several ratios, each with a weight that depends on how different the lengths are."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * token_ratio(a, b))
    scale = 0.9 if longer <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


#: Ratios that a worker remembers: users share many texts.
_remembered = functools.lru_cache(maxsize=1 << 16)(weighted_ratio)


def _counts(text: str) -> np.ndarray:
    """How often each of 32 classes of letters occurs; classes of several letters only raise what two texts may share."""
    return np.minimum(np.bincount(np.frombuffer(text.encode("utf-32-le"), "<u4") % 32, minlength=32), 255).astype(np.uint8)


class Leaders:
    """Texts that others are looked up among, by weighted_ratio, exactly, but without scoring all of them.

    An upper bound of the ratio follows from lengths, letters in common and whether a token is shared; it is taken
    for all leaders at once, and leaders are scored from the highest bound on until no other can be among the best.
    """

    def __init__(self):
        self.texts: list[str] = []
        self.scored = 0
        self._counts, self._sizes = np.zeros((16, 32), np.uint8), np.zeros((16, 3), np.int32)
        self._by_token: dict[str, list[int]] = {}

    @staticmethod
    def _lengths(text: str) -> tuple[int, int, int]:
        """Of a text, of its tokens with single spaces, of its different tokens."""
        tokens = text.split()
        return len(text), len(" ".join(tokens)), len(" ".join(set(tokens)))

    def add(self, text: str) -> None:
        k = len(self.texts)
        if k == len(self._counts):
            self._counts, self._sizes = np.concatenate([self._counts, np.zeros_like(self._counts)]), np.concatenate([self._sizes, np.zeros_like(self._sizes)])
        self._counts[k], self._sizes[k] = _counts(text), self._lengths(text)
        for token in set(text.split()):
            self._by_token.setdefault(token, []).append(k)
        self.texts.append(text)

    def bounds(self, text: str) -> np.ndarray:
        """No leader's ratio with the text is higher than this."""
        n = len(self.texts)
        whole, spaced, distinct = self._lengths(text)
        if not n or not text:
            return np.zeros(n)
        sizes = self._sizes[:n].astype(np.float64)
        common = np.minimum(self._counts[:n], _counts(text)).sum(axis=1, dtype=np.uint16).astype(np.float64)
        shared = np.zeros(n, bool)
        for token in set(text.split()):
            shared[self._by_token.get(token, [])] = True
        short, long = np.minimum(sizes[:, 0], whole), np.maximum(sizes[:, 0], whole)
        with np.errstate(divide="ignore", invalid="ignore"):
            times = long / short
            near = 0.95 * np.where(shared, 100.0, np.minimum(100.0, 200 * common / (sizes[:, 1] + spaced)))
            scale = np.where(times <= 8, 0.9, 0.6)
            part = np.minimum(100.0, 200 * common / (short + common))
            tokens = np.where(shared, 100.0, np.minimum(100.0, 200 * common / (np.minimum(sizes[:, 2], distinct) + common)))
            far = scale * np.maximum(part, 0.95 * tokens)
            bound = np.maximum(200 * common / (sizes[:, 0] + whole), np.where(times < 1.5, near, far))
        bound = np.where(np.isfinite(bound), bound, 100.0)
        bound[(sizes[:, 0] > 255) | (whole > 255)] = 100.0  # counts end at 255
        bound[sizes[:, 0] == 0] = 0.0
        return bound + 1e-9

    def best(self, text: str, cutoff: float, limit: int = 1) -> list[tuple[float, int]]:
        """(ratio, number) of the likest leaders with the cut-off or more; the earlier of equal ones first."""
        bound = self.bounds(text)
        some = np.flatnonzero(bound >= cutoff)
        found: list[tuple[float, int]] = []  # a heap of (ratio, -number)
        for k in some[np.argsort(-bound[some], kind="stable")].tolist():
            if len(found) == limit and bound[k] < found[0][0]:
                break
            self.scored += 1
            score = _remembered(text, self.texts[k])
            if score >= cutoff:
                (heapq.heappushpop if len(found) == limit else heapq.heappush)(found, (score, -k))
        return [(score, -k) for score, k in sorted(found, key=lambda f: (-f[0], -f[1]))]
