"""Simple-8b: varying counts of ids packed in 64-bit words, in blocks that are coded and decoded side by side.

A word's top four bits select (count, bits); 60 bits hold the ids, the first lowest. Selector ESCAPE
stands alone and the next word is one raw id, for ids of more than 60 bits. Every block holds
exactly BLOCK ids (the last of a file the rest) and starts at a known word.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: (ids, bits of each) by selector.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
BLOCK = 4096


def _widest(bits: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Largest of bits[:, i:i+c] at each i, for the counts of the selectors; 255 beyond the row's end."""
    out, span, w = {}, bits, 1
    by_power = {1: bits}

    def slid(a: np.ndarray, k: int) -> np.ndarray:
        b = np.full_like(a, 255)
        if k < a.shape[1]:
            b[:, : a.shape[1] - k] = a[:, k:]
        return b

    while w * 2 <= most:
        span = np.maximum(span, slid(span, w))
        w *= 2
        by_power[w] = span
    for c, _ in SELECTORS:
        p = 1 << (c.bit_length() - 1)
        out[c] = by_power[p] if p == c else np.maximum(by_power[p], slid(by_power[p], c - p))
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words of each block) of an array of unsigned ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    blocks = -(-n // BLOCK)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[:n] = ids
    bits = np.full(blocks * BLOCK, 255, np.uint8)
    bits[:n] = np.maximum(np.frexp(ids.astype(np.float64))[1], 1)
    widest = _widest(bits.reshape(blocks, BLOCK), 60)
    count, kind = np.ones((blocks, BLOCK), np.uint8), np.full((blocks, BLOCK), ESCAPE, np.uint8)
    for k in range(len(SELECTORS) - 1, -1, -1):
        c, b = SELECTORS[k]
        fits = widest[c] <= b
        count[fits], kind[fits] = c, k
    flat = count.ravel()
    begins = np.zeros(blocks * BLOCK, bool)
    at, ends = np.arange(blocks) * BLOCK, np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    while len(at):  # one word of every block at a time
        begins[at] = True
        at = at + flat[at]
        on = at < ends
        at, ends = at[on], ends[on]
    starts = np.flatnonzero(begins)
    kinds = kind.ravel()[starts]
    wide = kinds == ESCAPE
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(wide)[:-1]])
    words = np.zeros(len(starts) + int(wide.sum()), np.uint64)
    words[place] = kinds.astype(np.uint64) << np.uint64(60)
    words[place[wide] + 1] = full[starts[wide]]
    for k, (c, b) in enumerate(SELECTORS):
        own = np.flatnonzero(kinds == k)
        if len(own):
            packed = words[place[own]]
            first = starts[own]
            for j in range(c):
                packed |= full[first + j] << np.uint64(j * b)
            words[place[own]] = packed
    per_block = np.bincount(starts // BLOCK, weights=1 + wide, minlength=blocks).astype(np.uint32)
    return words, per_block


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of whole blocks, or of one."""
    kinds = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(kinds == ESCAPE).tolist():
        if not raw[i]:  # else a raw id that looks like an escape
            raw[i + 1] = True
    counts = np.zeros(16, np.int64)
    counts[: len(SELECTORS)] = [c for c, _ in SELECTORS]
    sizes = counts[kinds]
    sizes[raw] = 1
    sizes[(kinds == ESCAPE) & ~raw] = 0
    first = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint64)
    out[first[raw]] = words[raw]
    for k, (c, b) in enumerate(SELECTORS):
        own = np.flatnonzero((kinds == k) & ~raw)
        mask = np.uint64((1 << b) - 1)
        for j in range(c if len(own) else 0):
            out[first[own] + j] = (words[own] >> np.uint64(j * b)) & mask
    return out
