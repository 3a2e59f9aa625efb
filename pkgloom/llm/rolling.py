"""Rolling polynomial hashes over folded characters, computed for a whole Arrow batch at once.

A lookup table folds every code point: letters and digits to their lower case, everything else to 0 (skipped). The
hash of a text is the polynomial of its folded symbols, one separator between runs; the folded texts themselves are
never built as strings. Arithmetic wraps at 2**64, so equal hashes are candidates only and are always verified.
"""

from __future__ import annotations

import functools
import sys

import numpy as np

#: Two odd multipliers, so that a pair of hashes has 128 bits.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@functools.cache
def fold_table() -> np.ndarray:
    """Folded symbol per code point; 0 marks what is skipped."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or 0x20000 <= code < 0xE0000:
            continue
        c = chr(code)
        if c.isalpha() or c.isdecimal():
            table[code] = ord(c.lower()[0])
    table[0x20000:0x32000] = np.arange(0x20000, 0x32000)
    return table


@functools.lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(base)
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and the offset of each text (one more than there are texts)."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, offsets


def text_hashes(texts: list[str]) -> list[np.ndarray]:
    """For each base, the hash of each text's key spelling. A text with nothing but skipped characters gives 0."""
    points, offsets = code_points(texts)
    if not len(points):
        return [np.zeros(len(texts), dtype=np.uint64) for _ in BASES]
    symbols = fold_table()[points]
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    held = np.flatnonzero(symbols)
    if not len(held):
        return [np.zeros(len(texts), dtype=np.uint64) for _ in BASES]
    kept, of = symbols[held].astype(np.uint64), owner[held]
    # a separator counts where skipped characters lie between two kept ones of the same text
    gap = np.zeros(len(held), dtype=np.int64)
    gap[1:] = (np.diff(held) > 1) & (of[1:] == of[:-1])
    place = np.arange(len(held)) + np.cumsum(gap)
    first = np.searchsorted(of, np.arange(len(texts)), side="left")
    last = np.searchsorted(of, np.arange(len(texts)), side="right")
    some = last > first
    end = np.zeros(len(texts), dtype=np.int64)
    end[some] = place[last[some] - 1]
    exponent = end[of] - place
    most = int(exponent.max()) + 2
    out = []
    starts = first[some]
    with np.errstate(over="ignore"):
        for base in BASES:
            p = powers(int(base), most)
            terms = kept * p[exponent]
            terms += np.where(gap == 1, np.uint64(32) * p[np.minimum(exponent + 1, most - 1)], np.uint64(0))
            sums = np.zeros(len(texts), dtype=np.uint64)
            sums[some] = np.add.reduceat(terms, starts)
            out.append(sums)
    return out


def same_spelling(a: str | None, b: str | None) -> bool:
    """Whether two texts have the same key spelling: two pointers that skip and fold, without building strings."""
    table, a, b = fold_table(), a or "", b or ""
    i = j = 0
    started = False
    while True:
        gap_a = gap_b = False
        while i < len(a) and not table[ord(a[i])]:
            i, gap_a = i + 1, True
        while j < len(b) and not table[ord(b[j])]:
            j, gap_b = j + 1, True
        if i == len(a) or j == len(b):
            return i == len(a) and j == len(b)
        if started and gap_a != gap_b or table[ord(a[i])] != table[ord(b[j])]:
            return False
        started, i, j = True, i + 1, j + 1
