"""Exact character n-grams of whole texts as 63-bit codes, counted with numpy."""

from __future__ import annotations

import numpy as np

_SLICE = 1 << 20  # characters counted at once; slices overlap by two, so no n-gram is lost or counted twice
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter; built once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def points(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every non-letter 0, runs of those once, and 0 at either end."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where(letter_table()[cp], cp, 0)
    cp = np.concatenate([np.zeros(1, np.uint32), cp, np.zeros(1, np.uint32)])
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 0) | (cp[:-1] != 0)
    return cp[keep].astype(np.int64)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums counts of equal codes."""
    if len(parts) == 1:
        return parts[0]
    codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def counts(text: str, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and counts of the n-grams of 1 to ``longest`` (at most 3) characters.

    A word's ends are 0; no n-gram spans two words. The code of abc is a + b * 2**21 + c * 2**42, shorter
    n-grams have 0x1FFFFF in the unused places, which is no code point.
    """
    p = points(text)
    none, parts = 0x1FFFFF, []
    for i in range(0, max(1, len(p) - 2), _SLICE):
        q = p[i : i + _SLICE + 2]
        own = q[: _SLICE] if i + _SLICE + 2 < len(p) else q
        got = [own[own != 0] | (none << 21) | (none << 42)]
        if longest >= 2 and len(q) > 1:
            a, b = q[:-1][: len(own)], q[1:][: len(own)]
            got.append(a | (b << 21) | (none << 42))
        if longest >= 3 and len(q) > 2:
            a, b, c = q[:-2][: len(own)], q[1:-1][: len(own)], q[2:][: len(own)]
            got.append((a | (b << 21) | (c << 42))[b != 0])
        parts.append(np.unique(np.concatenate(got), return_counts=True))
    return merged(parts)
