"""Hashed character n-grams of whole texts."""

from __future__ import annotations

import numpy as np

PIECE = 1 << 16


def codes(text: str) -> np.ndarray:
    """Lower-cased code points with a space at both ends; digits are one symbol."""
    a = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    a[(a >= 48) & (a <= 57)] = 48
    return a


def pieces(a: np.ndarray, orders: tuple[int, ...], bits: int):
    """Arrays of bucket numbers of all n-grams, a bounded piece of the text at a time."""
    longest = max(orders)
    for at in range(0, max(1, len(a)), PIECE):
        part = a[at : at + PIECE + longest - 1]
        for n in orders:
            m = min(PIECE, len(part) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF))
            for i in range(n):
                h = (h ^ part[i : i + m]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA6B)
            yield h >> np.uint32(32 - bits)
