"""Byte-level BPE ids of whole texts: vectorised pre-tokenisation, and a bounded cache in front of the tokenizers library.

Texts that hold a special token's string, or a code point that this Python's Unicode tables do not know, go to the
library as they are; for all others the pre-tokens are found in numpy and only unseen ones are encoded by the library.
"""

from __future__ import annotations

import os

import numpy as np

from marginalia.llm.textkernel import LETTER, WHITE, SpanCache, classes_of, code_points, pieces, utf8_places

#: Distinct pre-tokens that a worker keeps.
CACHE = 1 << 20
#: The contractions of the byte-level pattern.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_APOSTROPHE, _BLANK = 0x27, 0x20


def token_bounds(points: np.ndarray, off: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens ``contraction| ?letters| ?numbers| ?others|space(?!other)|space`` of texts joined at off."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    opens = np.zeros(n + 1, bool)  # starts of texts
    opens[off] = True
    opens = opens[:n]
    change = opens.copy()
    change[1:] |= classes[1:] != classes[:-1]
    white = classes == WHITE
    after_white = np.zeros(n, bool)
    after_white[1:] = white[:-1]
    after_white &= ~opens
    run = np.flatnonzero(change & ~white)
    before = run[after_white[run]]
    start = opens | (change & white)
    start[before - 1] = True
    blank = np.zeros(n, bool)
    blank[1:] = points[:-1] == _BLANK
    blank &= ~opens
    start[run[~blank[run]]] = True
    for p in np.flatnonzero((points == _APOSTROPHE) & start):
        here = "".join(map(chr, points[p : p + 3]))
        for c in CONTRACTIONS:
            if here.startswith(c) and not opens[p + 1 : p + len(c)].any():
                q = p + len(c)
                start[p + 1 : q] = False
                if q < n:
                    start[q] |= classes[q] == LETTER
                break
    return np.flatnonzero(start)


class ByteTokens:
    """Encoder of one tokenizer file, with a cache; keep one per worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.byte_len = np.zeros(self.lib.get_vocab_size() + 1, np.int64)
        for token, i in self.lib.get_vocab(with_added_tokens=False).items():
            self.byte_len[i] = len(token)
        self.cache = SpanCache(CACHE, 1 << 25)

    def _learn(self, new: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unseen pre-tokens (by number) in a new order, their ids, and how many each has: those of a blank and letters come first, encoded in strings of many."""
        plain = np.array([w[0] == " " and len(w) > 1 and w[1:].isalpha() for w in words], bool)
        easy, odd = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        parts, counts = [], []
        for low in range(0, len(easy), 4096):
            some = [words[i] for i in easy[low : low + 4096]]
            ids = np.array(self.lib.encode("".join(some), add_special_tokens=False).ids, np.int32)
            ends = np.cumsum([len(w.encode()) for w in some])
            parts.append(ids)
            counts.append(np.diff(np.searchsorted(np.cumsum(self.byte_len[ids]), ends, "left") + 1, prepend=0))
        for e in self.lib.encode_batch([words[i] for i in odd], add_special_tokens=False) if odd else ():
            parts.append(np.array(e.ids, np.int32))
            counts.append(np.array([len(e.ids)]))
        return new[easy + odd], np.concatenate(parts), np.concatenate(counts)

    def _piece(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points, off = code_points(texts)
        kinds = classes_of(points)
        starts = token_bounds(points, off, kinds)
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        joined = "".join(texts)
        data = np.frombuffer(joined.encode(), np.uint8)
        place = np.arange(len(points) + 1) if len(data) == len(points) else utf8_places(points)
        found = self.cache.find(data, place[starts], place[ends], lambda new: self._learn(new, [joined[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]))
        ids, counts = self.cache.gather(found)
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, off, "left")]

    def _odd(self, text: str) -> bool:
        if any(s in text for s in self.specials):
            return True
        if text.isascii():
            return False
        import unicodedata

        return any(unicodedata.category(c) in ("Cn", "Cs") for c in set(text))

    def encode(self, texts: list[str]):
        """Yields (low, high, ids, bounds): ids of texts[low:high] joined, bounds[i]:bounds[i+1] those of the i-th."""
        odd = np.array([self._odd(t) for t in texts], bool)
        low = 0
        for stop in [*np.flatnonzero(odd).tolist(), len(texts)]:
            part = texts[low:stop]
            for a, b in pieces(np.array([len(t) for t in part], np.int64)) if part else ():
                yield low + a, low + b, *self._piece(part[a:b])
            if stop < len(texts):
                ids = np.array(self.lib.encode(texts[stop], add_special_tokens=False).ids, np.int64)
                yield stop, stop + 1, ids, np.array([0, len(ids)])
            low = stop + 1


_kept: dict[str, ByteTokens] = {}


def encoder(path: str) -> ByteTokens:
    """The worker's encoder of this file."""
    if path not in _kept:
        _kept[path] = ByteTokens(path)
    return _kept[path]
