"""BPE with word ends by a minimal acyclic transducer of frequent words; unseen words are merged exactly.

Words of the whole corpus are counted, the most frequent ones are encoded once by exact merges and compiled into a
minimal automaton that shares prefixes and suffixes: every transition carries the number of words it skips,
so the sum along a word's path is its number, which leads to its ids. The compiled arrays are one byte
string of bounded size, broadcast; the workers of an executor memory-map its one file of it, and all words of a piece
of text walk it side by side. Words that it does not hold are merged by rank (long ones with a heap), through a bounded
cache that compares the bytes of every word it finds.

Defined results: null text counts as empty and has no ids. Special tokens' strings in a text become their ids, as
the tokenizers library has it. Every row gets a row; ids may be null or repeat, columns beside id and text
are not read. An empty table gives no rows. Which words are compiled changes speed only, never ids.
"""

from __future__ import annotations

import heapq
import json
import os
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.serializers import pickle_protocol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import most_frequent
from marginalia.llm.textkernel import LETTER, NUMBER, WHITE, HashTable, SpanCache, classes_of, code_points, mix, pieces, ragged, slices, spare, span_hashes, utf8_places

#: Words compiled into the transducer: bounds what is broadcast (about 16 MB).
LEXICON = 1 << 16
#: A worker reports words that it met so often at least.
LEAST_COUNT = 3
#: Distinct words that a counting worker holds before it reports its sums so far and starts anew.
COUNTED = 1 << 17
#: Words of more bytes have no place in the transducer.
LONGEST = 256
#: Merged words that a worker keeps.
CACHE = 1 << 18
#: Words of more bytes are merged with a heap.
LONG_WORD = 48
#: The contractions of the word pattern.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


class Rules:
    """A tokenizer file: normal form, words, merges, specials."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        model = conf["model"]
        kinds = [n["type"] for n in conf["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"]:
            raise ValueError("a tokenizer of lower-cased words with word ends is expected")
        self.path, self.end, self.vocab = path, model["end_of_word_suffix"], model["vocab"]
        self.ranks = {}
        for r, m in enumerate(model["merges"]):
            self.ranks[tuple(m.split(" ")) if isinstance(m, str) else tuple(m)] = r
        self.specials = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.tokens = [""] * (max([*self.vocab.values(), *self.specials.values()]) + 1)
        for t, i in [*self.vocab.items(), *self.specials.items()]:
            self.tokens[i] = t
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)))
        # printable stand-ins of bytes: those that print stand for themselves, the others follow from U+0100 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        self.letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self._number()

    def _number(self) -> None:
        """The merges as numbers: a string's id, or one beyond all ids where the vocabulary lacks it."""
        number = dict(self.vocab)
        self.known = max(number.values()) + 1
        of = lambda t: number.setdefault(t, self.known + len(number))
        self.inner = np.array([of(self.letter[b]) for b in range(256)], np.int64)
        self.final = np.array([of(self.letter[b] + self.end) for b in range(256)], np.int64)
        pairs = np.array([(of(a) << 32 | of(b), r, of(a + b)) for (a, b), r in self.ranks.items()], np.int64).reshape(-1, 3)
        self.pairs = HashTable(18)
        self.pairs.put(mix(pairs[:, 0].astype(np.uint64)), np.arange(len(pairs)))
        self.rank, self.merged = np.append(pairs[:, 1], 1 << 40), np.append(pairs[:, 2], -1)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of the merge of two symbols, -1 (which has the highest rank) for none; symbol -1 stands beside every word."""
        keys = mix((left << 32 | right).astype(np.uint64))
        return np.where((left >= 0) & (right >= 0), self.pairs.get(keys.ravel()).reshape(keys.shape), -1)

    def merge_all(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words data[start:end] (some of them, by number) in a new order, their ids joined in it, and how many each has.

        Words of like length are merged side by side: in each round every word merges its pair of the least rank, the
        leftmost of these, and looks up the two pairs that this makes.
        """
        order, parts, counts, size = [], [], [], ends[some] - starts[some]
        for low, high in ((0, 6), (6, 10), (10, 18), (18, LONG_WORD)):
            own = some[(size > low) & (size <= high)]
            for k in range(0, len(own), 1 << 14):
                self._side_by_side(data, starts, ends, own[k : k + (1 << 14)], order, parts, counts)
        for i in some[size > LONG_WORD].tolist():
            ids = self.merge(data[starts[i] : ends[i]].tobytes())
            order.append(np.array([i]))
            parts.append(np.array(ids, np.int32))
            counts.append(np.array([len(ids)]))
        return np.concatenate(order), np.concatenate(parts), np.concatenate(counts)

    def _side_by_side(self, data, starts, ends, own, order, parts, counts) -> None:
        n = ends[own] - starts[own]
        width = int(n.max())
        inside = np.arange(width) < n[:, None]
        symbols = np.where(inside, self.inner[data[np.where(inside, starts[own][:, None] + np.arange(width), 0)]], -1)
        symbols[np.arange(len(own)), n - 1] = self.final[data[ends[own] - 1]]
        found = self._pair(symbols[:, :-1], symbols[:, 1:])
        while True:
            ranks = self.rank[found]
            at = ranks.argmin(1) if width > 1 else np.zeros(len(own), np.int64)
            on = ranks[np.arange(len(own)), at] < 1 << 40 if width > 1 else np.zeros(len(own), bool)
            if not on.all():
                done = symbols[~on]
                real = (done >= 0) & (done < self.known)
                order.append(own[~on])
                parts.append(done[real].astype(np.int32))
                counts.append(real.sum(1))
                own, symbols, found, at = own[on], symbols[on], found[on], at[on]
            if not len(own):
                return
            rows, width = np.arange(len(own)), width - 1
            symbols[rows, at] = self.merged[found[rows, at]]
            keep = np.arange(width) + (np.arange(width) > at[:, None])  # all but the symbol that was merged into its left one
            symbols = np.take_along_axis(symbols, keep, 1)
            found = np.take_along_axis(found, keep[:, : width - 1], 1) if width > 1 else found[:, :0]
            for j in (at - 1, at):
                real = np.flatnonzero((j >= 0) & (j < width - 1))
                found[real, j[real]] = self._pair(symbols[real, j[real]], symbols[real, j[real] + 1])

    def normal(self, text: str) -> str:
        """Composed and lower-cased, each code point by itself."""
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word by exact merges in the order of rank."""
        parts = [self.letter[b] for b in word]
        parts[-1] += self.end
        if len(parts) > LONG_WORD:
            return [self.vocab[p] for p in self._merge_long(parts) if p in self.vocab]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.vocab[p] for p in parts if p in self.vocab]

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same merges with a heap of pairs by rank and place over a linked list of the parts."""
        ranks, n = self.ranks, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:  # merged meanwhile
                continue
            parts[i], parts[j], k = left + right, "", after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p]

    def ids_of(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        if not words:
            return []
        ends = np.cumsum([len(w) for w in words])
        starts = ends - [len(w) for w in words]
        order, flat, counts = self.merge_all(np.frombuffer(b"".join(words), np.uint8), starts, ends, np.arange(len(words)))
        out: list[list[int]] = [[]] * len(words)
        for i, ids in zip(order.tolist(), np.split(flat, np.cumsum(counts)[:-1]), strict=True):
            out[i] = ids.tolist()
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


def word_spans(points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``contraction|letters|number|others`` of normal texts joined at off."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = classes_of(points)
    opens = np.zeros(n + 1, bool)
    opens[off] = True
    opens = opens[:n]
    start = opens | (kinds == NUMBER)
    start[1:] |= kinds[1:] != kinds[:-1]
    for p in np.flatnonzero((points == 0x27) & start):
        here = "".join(map(chr, points[p : p + 3]))
        for c in CONTRACTIONS:
            if here.startswith(c) and not opens[p + 1 : p + len(c)].any():
                q = p + len(c)
                start[p + 1 : q] = False
                if q < n:
                    start[q] |= kinds[q] == LETTER
                break
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    real = kinds[starts] != WHITE
    return starts[real], ends[real]


# --- the transducer
def compile_words(words: list[bytes], ids: list[list[int]]) -> bytes:
    """A minimal acyclic automaton of distinct words; word i in sorted order has number i. words and ids: parallel."""
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    final: list[bool] = []
    edges: list[tuple[tuple[int, int], ...]] = []

    def state(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(edges)
            final.append(node[0])
            edges.append(key[1])
        return register[key]

    path: list[list] = [[False, []]]  # [accepts, finished edges] from the start to the last letter
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], state(node)))

    for i in order:
        word = words[i]
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        close(same)
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
        last = word
    close(0)
    root = state(path[0])
    below = [0] * len(edges)  # words from a state on; its targets have smaller numbers
    rows = []
    for s in range(len(edges)):
        n = int(final[s])
        for label, to in edges[s]:
            rows.append((s << 8 | label, to, n))
            n += below[to]
        below[s] = n
    keys, to, skip = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    size = 1 << max(4, int(len(keys) * 3).bit_length())
    table = np.full(size, -1, np.int64)
    at, left = (mix(keys.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64), np.arange(len(keys))
    place = np.zeros(len(keys), np.int64)
    while len(left):
        _, first = np.unique(at[left], return_index=True)
        win = np.zeros(len(left), bool)
        win[first] = True
        win &= table[at[left]] < 0
        table[at[left[win]]], place[left[win]] = keys[left[win]], at[left[win]]
        left = left[~win]
        at[left] = (at[left] + 1) & (size - 1)
    target, skipped = np.zeros(size, np.int32), np.zeros(size, np.int32)
    target[place], skipped[place] = to, skip
    counts = np.array([len(ids[i]) for i in order], np.int64)
    flat = np.array([x for i in order for x in ids[i]], np.int32)
    head = np.array([root, len(edges), size, len(words), len(flat)], np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    # wide numbers first, so that all stand at multiples of their width
    return b" " * PAD + MAGIC + b"".join(a.tobytes() for a in (head, table, bounds, target, skipped, flat, np.array(final, np.uint8)))


#: The compiled form starts with this; spaces ahead of it bring it to a multiple of eight in a pickled file.
MAGIC = b"lexicon1"
PAD = -pickle.dumps(bytes(1 << 17), pickle_protocol).index(bytes(1 << 17)) % 8


def mapped(shared) -> np.ndarray:
    """The bytes of a broadcast compiled form: the executor's file of the broadcast, memory-mapped by all of its workers.

    Where there is no such file (an encrypted broadcast), the worker's own copy.
    """
    path = getattr(shared, "_path", None)
    if path and os.path.exists(path):
        raw = np.memmap(path, np.uint8, "r")
        if MAGIC in raw[:256].tobytes():
            return raw
    return np.frombuffer(shared.value, np.uint8)


class Lexicon:
    """A compiled transducer over bytes, which may be a memory-mapped file."""

    def __init__(self, data: bytes | np.ndarray):
        raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else np.asarray(data)
        at = raw[:256].tobytes().index(MAGIC) + len(MAGIC)
        raw = raw[at:]
        raw = raw.copy() if raw.ctypes.data % 8 else raw
        root, states, size, n, flat = raw[:40].view(np.int64).tolist()
        self.root, self.size, at = root, size, 40
        for name, kind, length in (("table", np.int64, size), ("bounds", np.int64, n + 1), ("target", np.int32, size), ("skip", np.int32, size), ("ids", np.int32, flat), ("final", np.uint8, states)):
            width = np.dtype(kind).itemsize * length
            setattr(self, name, raw[at : at + width].view(kind))
            at += width

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the words data[start:end], -1 for those that it does not hold; one letter of all words at a time."""
        out = np.full(len(starts), -1, np.int64)
        live, state, number, at = np.arange(len(starts)), np.full(len(starts), self.root, np.int64), np.zeros(len(starts), np.int64), starts.copy()
        mask = self.size - 1
        while len(live):
            over = at == ends[live]
            if over.any():
                good = over & (self.final[state] == 1)
                out[live[good]] = number[good]
                on = ~over
                live, state, number, at = live[on], state[on], number[on], at[on]
            key = state << 8 | data[at]
            slot = (mix(key.astype(np.uint64)) & np.uint64(mask)).astype(np.int64)
            got = self.table[slot]
            seek = np.flatnonzero((got != key) & (got >= 0))
            while len(seek):
                slot[seek] = (slot[seek] + 1) & mask
                got[seek] = self.table[slot[seek]]
                seek = seek[(got[seek] != key[seek]) & (got[seek] >= 0)]
            on = got == key
            slot = slot[on]
            live, at, number, state = live[on], at[on] + 1, number[on] + self.skip[slot], self.target[slot].astype(np.int64)
        return out


class Encoder:
    """Rules, lexicon and the cache of merged words of one task."""

    def __init__(self, path: str, compiled: bytes | np.ndarray):
        self.rules, self.lexicon = Rules(path), Lexicon(compiled)
        self.cache = SpanCache(CACHE)
        self.library = None

    def _piece(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normal texts joined, and each text's bounds in them."""
        points, off = code_points(texts)
        starts, ends = word_spans(points, off)
        data = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
        if len(data) == len(points):
            b_starts, b_ends = starts, ends
        else:
            place = utf8_places(points)
            b_starts, b_ends = place[starts], place[ends]
        number = self.lexicon.find(data, b_starts, b_ends)
        known, rare = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        counts, first = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        first[known] = self.lexicon.bounds[number[known]]
        counts[known] = self.lexicon.bounds[number[known] + 1] - first[known]
        if len(rare):
            s, e = b_starts[rare], b_ends[rare]
            found = self.cache.find(data, s, e, lambda new: self.rules.merge_all(data, s, e, new))
            first[rare], counts[rare] = self.cache.first[found], self.cache.first[found + 1] - self.cache.first[found]
        ids = np.zeros(int(counts.sum()), np.int32)
        place = np.cumsum(counts) - counts
        for own, source in ((known, self.lexicon.ids), (rare, self.cache.ids)):
            ids[ragged(place[own], counts[own])] = source[ragged(first[own], counts[own])]
        return ids, np.concatenate([place, [len(ids)]])[np.searchsorted(starts, off, "left")]

    def _whole(self, text: str) -> np.ndarray | None:
        """Ids of a text that holds specials or unknown code points; None for all others."""
        rules = self.rules
        if rules.cut.search(text):
            parts, low = [], 0
            for m in rules.cut.finditer(text):
                parts += [self._one(text[low : m.start()]), np.array([rules.specials[m[0]]], np.int32)]
                low = m.end()
            return np.concatenate([*parts, self._one(text[low:])])
        if not text.isascii() and any(unicodedata.category(c) in ("Cn", "Cs") for c in set(text)):
            from tokenizers import Tokenizer

            self.library = self.library or Tokenizer.from_file(rules.path)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
        return None

    def _one(self, text: str) -> np.ndarray:
        return self._piece([self.rules.normal(text)])[0]

    def encode(self, texts: list[str]):
        """Yields (low, high, ids, bounds) for ranges of the texts of bounded size."""
        low, odd = 0, {i: w for i, t in enumerate(texts) if (w := self._whole(t)) is not None}
        for stop in [*odd, len(texts)]:
            part = texts[low:stop]
            for a, b in pieces(np.array([len(t) for t in part], np.int64)) if part else ():
                yield low + a, low + b, *self._piece([self.rules.normal(t) for t in part[a:b]])
            if stop in odd:
                yield stop, stop + 1, odd[stop], np.array([0, len(odd[stop])])
            low = stop + 1


# --- on Spark
def word_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """word (UTF-8), n: counts over all documents, of words that a worker met LEAST_COUNT times at least since its last report."""

    def count(batches):
        rules, counts = Rules(path), Counter()

        def emit():
            kept = [(w, c) for w, c in counts.items() if c >= LEAST_COUNT]
            for low in range(0, len(kept), 50_000):
                words, ns = zip(*kept[low : low + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(ns, pa.int64())], ["word", "n"])
            counts.clear()

        for batch in (b for whole in batches for b in slices(whole)):
            texts = [rules.normal(t or "") for t in batch[0].to_pylist()]
            for a, b in pieces(np.array([len(t) for t in texts], np.int64)):
                points, off = code_points(texts[a:b])
                starts, ends = word_spans(points, off)
                raw = "".join(texts[a:b]).encode("utf-8", "surrogatepass")
                data = np.frombuffer(raw, np.uint8)
                if len(data) != len(points):
                    place = utf8_places(points)
                    starts, ends = place[starts], place[ends]
                short = np.flatnonzero(ends - starts <= LONGEST)
                starts, ends = starts[short], ends[short]
                _, first, n = np.unique(span_hashes(data, starts, ends), return_index=True, return_counts=True)
                for s, e, c in zip(starts[first].tolist(), ends[first].tolist(), n.tolist(), strict=True):
                    counts[raw[s:e]] += c
            if len(counts) > COUNTED:
                yield from emit()
        yield from emit()
        spare()

    found = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "word binary, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, text_col: str = "text", words: int = LEXICON) -> bytes:
    """The compiled transducer of the corpus' most frequent words; the driver gets at most words of them."""
    rules = Rules(path)
    top, _ = most_frequent(word_counts(docs, path, text_col), "word", "n", words)
    return compile_words(top, rules.ids_of(top))


def encode_texts(docs: DataFrame, path: str, compiled: bytes | None = None, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """id, token_ids (binary: little-endian unsigned 32-bit ids), decoded (the decoded text), one row per document."""
    compiled = build_lexicon(docs, path, text_col) if compiled is None else compiled
    shared = docs.sparkSession.sparkContext.broadcast(compiled)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = Encoder(path, mapped(shared))
        for batch in (b for whole in batches for b in slices(whole)):
            ids, texts = batch[0], [t or "" for t in batch[1].to_pylist()]
            for a, b, tokens, bounds in enc.encode(texts):
                raw = [tokens[bounds[i] : bounds[i + 1]] for i in range(b - a)]
                columns = [ids.slice(a, b - a), pa.array([r.astype("<u4").tobytes() for r in raw], pa.binary())]
                if decode:
                    columns.append(pa.array([enc.rules.decode(r.tolist()) for r in raw], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "token_ids", "decoded"][: len(columns)])
        del enc
        spare()

    schema = f"id {kind}, token_ids binary" + ", decoded string" * decode
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "token_ids", to: str = "decoded") -> DataFrame:
    """encoded with a column of decoded texts; null ids give null."""

    @F.arrow_udf("string")
    def text(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rules = Rules(path)
        for ids in parts:
            yield pa.array([None if b is None else rules.decode(np.frombuffer(b, "<u4").tolist()) for b in ids.to_pylist()], pa.string())

    return encoded.withColumn(to, text(ids_col))
