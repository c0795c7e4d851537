"""Vectorised text primitives: code points, token bounds, rolling hashes, an open-addressing table.

Everything works on whole texts in pieces of bounded size, so memory does not follow the longest batch.
"""

from __future__ import annotations

import contextlib
import hashlib
import unicodedata

import numpy as np

#: Code points (or bytes) handled at once; a single longer text makes a piece of its own.
PIECE = 1 << 18

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


#: Spans of more bytes are hashed by BLAKE2b.
LONG = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def lanes(raw: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit number that starts at each byte (zeros beyond the end), and one more at the end."""
    padded = np.concatenate([raw, np.zeros(9, np.uint8)])
    return np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hashes of the bytes raw[start:end], equal for equal spans wherever they stand.

    Eight bytes at a time are mixed into a state. Who does not know the key cannot make two spans collide, so callers that
    decide by hashes alone take a random one; the others compare the bytes of spans that a hash brings together.
    """
    n = ends - starts
    at, salt = lanes(raw), np.uint64(key & (1 << 64) - 1)
    with np.errstate(over="ignore"):
        h = mix((at[starts] & _FIRST[np.minimum(n, 8)]) ^ mix(n.astype(np.uint64) + salt))
        some, done = np.flatnonzero((n > 8) & (n <= LONG)), 8
        while len(some):
            lane = at[starts[some] + done] & _FIRST[np.minimum(n[some] - done, 8)]
            h[some] = mix((h[some] + salt) * _ODD ^ lane)
            done += 8
            some = some[n[some] > done]
    secret = int(salt).to_bytes(8, "little")
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, key=secret).digest(), "little")
    return h


def equal_spans(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether the bytes a[a_start:a_end] and b[b_start:b_end] are the same, pair by pair."""
    n = a_ends - a_starts
    same = n == b_ends - b_starts
    left, right, some, done = lanes(a), lanes(b), np.flatnonzero(same & (n <= LONG)), 0
    while len(some):
        differs = (left[a_starts[some] + done] ^ right[b_starts[some] + done]) & _FIRST[np.minimum(n[some] - done, 8)] != 0
        same[some[differs]] = False
        done += 8
        some = some[~differs & (n[some] > done)]
    for i in np.flatnonzero(same & (n > LONG)).tolist():
        same[i] = np.array_equal(a[a_starts[i] : a_ends[i]], b[b_starts[i] : b_ends[i]])
    return same


def spare() -> None:
    """Hand memory that a task no longer needs back to the system: workers live on between stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def pieces(sizes: np.ndarray, most: int = PIECE):
    """Ranges (low, high) of items whose sizes sum to about most."""
    ends = np.cumsum(sizes)
    low, n = 0, len(sizes)
    while low < n:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
        yield low, high
        low = high


def slices(batch, rows: int = 512):
    """A record batch in slices of few rows, so that Python strings exist for one slice at a time."""
    for low in range(0, batch.num_rows, rows):
        yield batch.slice(low, rows)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ascii_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of the texts raw[offsets[i]:offsets[i+1]], A-Z lower-cased.

    Returns the bytes (lower-cased, from offsets[0]), word starts and ends in them, and the text of each word.
    """
    raw = _LOWER[raw[offsets[0] : offsets[-1]]]
    off = offsets - offsets[0]
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[:-1] = ~_SPACE[raw]
    first = inside.copy()
    first[1:] -= inside[:-1]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    if len(cut):  # a text's end also ends a word
        joined = cut[(inside[cut] == 1) & (inside[cut - 1] == 1)]
    else:
        joined = cut
    starts, ends = np.flatnonzero(first[:-1] == 1), np.flatnonzero(first == -1)
    if len(joined):
        joined = np.unique(joined)
        starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
    return raw, starts, ends, np.searchsorted(off, starts, "right") - 1


# --- classes of code points, for pre-tokenisation
LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 4
#: The code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes = np.zeros(0x110000, np.uint8)
_classes[WHITE_SPACE] = WHITE


def classes_of(points: np.ndarray) -> np.ndarray:
    """LETTER, NUMBER, WHITE or OTHER for each code point; the table is filled as points are met."""
    found = _classes[points]
    if not found.all():
        for p in np.unique(points[found == 0]):
            kind = unicodedata.category(chr(p))[0]
            _classes[p] = {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
        found = _classes[points]
    return found


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts joined, and the texts' offsets."""
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), off


class HashTable:
    """64-bit keys to int64 values in numpy arrays; vectorised lookup, insertion in bulk, bounded size."""

    def __init__(self, bits: int = 16, most: int = 1 << 21):
        self.most = most
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.vals = np.full(1 << bits, -1, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where there is none."""
        mask = len(self.keys) - 1
        at = self._slot(keys)
        got, out = self.keys[at], self.vals[at]
        miss = np.flatnonzero((got != keys) & (out >= 0))
        while len(miss):
            at[miss] = (at[miss] + 1) & mask
            got = self.keys[at[miss]]
            val = self.vals[at[miss]]
            out[miss] = val
            miss = miss[(got != keys[miss]) & (val >= 0)]
        return out

    def put(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Add keys that are not there yet, each once. Beyond the bound, the caller should clear()."""
        if (self.n + len(keys)) * 2 > len(self.keys):
            held = self.vals >= 0
            k, v = self.keys[held], self.vals[held]
            self._make(max(self.bits + 1, int((len(k) + len(keys)) * 2).bit_length()))
            self._place(k, v)
        self._place(keys, vals)

    def _place(self, keys: np.ndarray, vals: np.ndarray) -> None:
        mask, at, left = len(self.keys) - 1, self._slot(keys), np.arange(len(keys))
        self.n += len(keys)
        while len(left):
            free = self.vals[at[left]] < 0
            _, first = np.unique(at[left], return_index=True)
            win = np.zeros(len(left), bool)
            win[first] = True
            win &= free
            took = left[win]
            self.keys[at[took]], self.vals[at[took]] = keys[took], vals[took]
            left = left[~win]
            at[left] = (at[left] + 1) & mask


def utf8_places(points: np.ndarray) -> np.ndarray:
    """Byte offset of each code point in UTF-8, and the end."""
    place = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000), out=place[1:])
    return place


def _longer(a: np.ndarray, need: int) -> np.ndarray:
    """a, or a copy with room for need entries at least."""
    if need <= len(a):
        return a
    new = np.zeros(max(need, 2 * len(a)), a.dtype)
    new[: len(a)] = a
    return new


class SpanCache:
    """Token ids of byte spans met before: found by hash, confirmed by their bytes, bounded in entries and bytes.

    ids[first[i]:first[i + 1]] are the ids of entry i, text[at[i]:at[i + 1]] its bytes.
    """

    def __init__(self, entries: int, size: int = 1 << 24):
        self.entries, self.size = entries, size
        self.clear()

    def clear(self) -> None:
        self.table, self.n = HashTable(16), 0
        self.first, self.at = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids, self.text = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.uint8)

    def _add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Entry numbers of new spans with their ids, joined, and how many each has."""
        k, n = len(starts), self.n
        sizes = ends - starts
        self.first, self.at = _longer(self.first, n + k + 1), _longer(self.at, n + k + 1)
        self.first[n + 1 : n + k + 1], self.at[n + 1 : n + k + 1] = self.first[n] + np.cumsum(counts), self.at[n] + np.cumsum(sizes)
        self.ids, self.text = _longer(self.ids, int(self.first[n + k])), _longer(self.text, int(self.at[n + k]))
        self.ids[self.first[n] : self.first[n + k]] = flat
        self.text[self.at[n] : self.at[n + k]] = data[ragged(starts, sizes)]
        self.n = n + k
        return np.arange(n, n + k)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> np.ndarray:
        """Entry numbers of the spans data[start:end].

        encode(spans by number) gives those not met before in an order of its own, their ids joined in it, and their counts.
        """
        if self.n > self.entries or self.at[self.n] > self.size:
            self.clear()
        keys = span_hashes(data, starts, ends)
        found = self.table.get(keys)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            new, one = np.unique(keys[miss], return_index=True)
            order, flat, counts = encode(miss[one])
            self.table.put(keys[order], self._add(data, starts[order], ends[order], flat, counts))
            found[miss] = self.table.get(keys[miss])
        other = np.flatnonzero(~equal_spans(data, starts, ends, self.text, self.at[found], self.at[found + 1]))
        if len(other):  # spans that only share a hash get entries that no hash leads to
            order, flat, counts = encode(other)
            found[order] = self._add(data, starts[order], ends[order], flat, counts)
        return found

    def gather(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of entries one after the other, and how many each has."""
        counts = self.first[found + 1] - self.first[found]
        return self.ids[ragged(self.first[found], counts)], counts


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each span, one span after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
