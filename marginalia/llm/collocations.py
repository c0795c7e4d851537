"""Phrase collocations: contiguous patterns grown to the right from frequent prefixes, scored against their parts.

Words are counted first; the frequent ones form a lexicon of bounded size whose ids, packed side by side, stand for an
occurrence of a prefix and what follows it (its projected pointer). Pointers are summed up where they are read and dealt
by their prefix; a task grows the patterns of its prefixes depth first, extending only what is frequent. The prefixes of
very frequent words are dealt by their longer patterns instead, so that no task gets a hot prefix whole. Phrases with a
word beyond the lexicon are counted as strings by a plain aggregation: the lexicon's size changes speed only.

Defined results: a null text is empty and yields nothing; a null lang counts as UNKNOWN; repeated rows count again; ids
and other columns are not read, so names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import secrets

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.llm.common import discard, materialise, partitions
from marginalia.llm.textkernel import HashTable, _LOWER, buffers, equal_spans, mix, pieces, ragged, span_hashes, spare

UNKNOWN = "und"
#: Words of the lexicon: the most frequent ones (about 40 bytes each where they are used).
LEXICON = (1 << 20) - 1
#: Pointers that a task sums up before it passes them on, and those that a bucket of prefixes should have.
GATHER, BUCKET = 1 << 22, 1 << 20
#: Distinct words that a counting task holds before it passes them on; bytes of text handled at once.
HELD_WORDS, CHUNK = 1 << 19, 1 << 20
#: A lang's best phrases are found in so many parts first, or as many as there are shuffle partitions.
PARTS = 64

_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _BREAK


def words_in_pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts raw[offsets[i]:offsets[i + 1]]: lower-cased bytes, starts, ends, text of each, and its piece (a number that grows)."""
    data, off = _LOWER[raw[offsets[0] : offsets[-1]]], offsets - offsets[0]
    kind = _KIND[data]
    inside = kind == 0
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = off[1:] > off[:-1]
    before[off[:-1][full]], after[off[1:][full] - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    text = np.searchsorted(off, starts, "right") - 1
    return data, starts, ends, text, np.cumsum(kind == _BREAK)[starts] + text


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang_keys: np.ndarray, key: int) -> np.ndarray:
    """Keyed hashes of words, told apart by lang."""
    return mix(span_hashes(data, starts, ends, key) ^ lang_keys)


def _lang_hashes(langs: list[str], key: int) -> np.ndarray:
    coded = [x.encode() for x in langs]
    ends = np.cumsum([len(c) for c in coded], dtype=np.int64)
    return span_hashes(np.frombuffer(b"".join(coded), np.uint8), ends - np.array([len(c) for c in coded], np.int64), ends, key ^ 0x5BD1E995) if coded else np.zeros(0, np.uint64)


def _chunks(batch, key: int):
    """Chunks of a batch (lang, text): words, their keys and langs (names and number of each word's)."""
    import pyarrow.compute as pc

    coded = pc.dictionary_encode(batch["lang"])
    langs, of_text = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    hashes = _lang_hashes(langs, key)
    raw, off = buffers(batch["text"])
    for a, b in pieces(np.diff(off), CHUNK):
        data, starts, ends, text, piece = words_in_pieces(raw, off[a : b + 1])
        lang = of_text[a:b][text]
        yield data, starts, ends, piece, lang, langs, word_keys(data, starts, ends, hashes[lang], key)


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n of all words of texts(lang, text)."""
    key = secrets.randbits(64)

    def run(batches):
        import pyarrow as pa

        kept: list[tuple] = []  # keys, counts, langs and words of chunks

        def merged():
            keys = np.concatenate([k for k, *_ in kept])
            counts, langs, words = np.concatenate([c for _, c, *_ in kept]), pa.concat_arrays([x for *_, x, _ in kept]), pa.concat_arrays([w for *_, w in kept])
            distinct, first, at = np.unique(keys, return_index=True, return_inverse=True)
            kept[:] = [(distinct, np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64), langs.take(pa.array(first)), words.take(pa.array(first)))]

        def out():
            _, counts, langs, words = kept.pop()
            for low in range(0, len(counts), 1 << 16):
                part = slice(low, low + (1 << 16))
                n = len(counts[part])
                yield pa.RecordBatch.from_arrays([langs.slice(low, n), words.slice(low, n), pa.array(counts[part])], ["lang", "word", "n"])

        for batch in batches:
            for data, starts, ends, _, lang, langs, keys in _chunks(batch, key):
                if not len(keys):
                    continue
                distinct, first, counts = np.unique(keys, return_index=True, return_counts=True)
                size = ends[first] - starts[first]
                off = np.concatenate([[0], np.cumsum(size)])
                words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data[ragged(starts[first], size)].tobytes()))
                kept.append((distinct, counts, pa.array(langs, pa.large_string()).take(pa.array(lang[first])), words))
                if sum(len(k) for k, *_ in kept) > 4 * HELD_WORDS:
                    merged()
                    if len(kept[0][0]) > HELD_WORDS:
                        yield from out()
        if kept:
            merged()
            yield from out()
        spare()

    return texts.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Lexicon:
    """The frequent words that have ids (from 1, the most frequent first), found by keyed hash and confirmed by their bytes."""

    def __init__(self, langs: list[str], words: list[str], counts: list[int], length: int, hot: int):
        coded = [w.encode() for w in words]
        self.names, self.key = sorted(set(langs)), 0
        number = {x: i for i, x in enumerate(self.names)}
        self.lang = np.array([number[x] for x in langs], np.int64)
        self.size = np.array([len(c) for c in coded], np.int64)
        self.ends = np.cumsum(self.size)
        self.text = np.frombuffer(b"".join(coded), np.uint8)
        self.hot = np.concatenate([[False], np.array(counts, np.int64) > hot])
        self.length, self.bits = length, max(1, len(words).bit_length())
        while True:  # a key under which no two entries share a hash
            self.key = secrets.randbits(64)
            self.keys = word_keys(self.text, self.ends - self.size, self.ends, _lang_hashes(self.names, self.key)[self.lang], self.key)
            if len(np.unique(self.keys)) == len(words):
                break
        self.table = None

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def ids(self, data, starts, ends, lang, langs, keys) -> np.ndarray:
        """Ids of words, 0 for those beyond the lexicon."""
        if self.table is None:
            self.table = HashTable(max(4, (2 * len(self.keys)).bit_length()))
            self.table.put(self.keys, np.arange(len(self.keys)))
        found = self.table.get(keys)
        met = np.flatnonzero(found >= 0)
        at = found[met]
        number = {x: i for i, x in enumerate(self.names)}
        here = np.array([number.get(x, -1) for x in langs], np.int64)[lang[met]] if len(langs) else np.zeros(0, np.int64)
        sure = (here == self.lang[at]) & equal_spans(data, starts[met], ends[met], self.text, self.ends[at] - self.size[at], self.ends[at])
        out = np.zeros(len(keys), np.int64)
        out[met[sure]] = at[sure] + 1
        return out

    def word(self, i: int) -> str:
        return self.text[self.ends[i - 1] - self.size[i - 1] : self.ends[i - 1]].tobytes().decode()


def followed(ids: np.ndarray, piece: np.ndarray, length: int) -> np.ndarray:
    """A row for each word: its id and those of the words that follow in its piece, zeros after an unknown one."""
    rows = np.zeros((len(ids), length), np.int64)
    rows[:, 0] = ids
    for k in range(1, length):
        rows[: len(ids) - k, k] = np.where((piece[k:] == piece[: len(ids) - k]) & (rows[: len(ids) - k, k - 1] > 0), ids[k:], 0)
    return rows


def packed(rows: np.ndarray, bits: int) -> np.ndarray:
    code = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        code = (code << np.uint64(bits)) | rows[:, k].astype(np.uint64)
    return code


def pointers(rows: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Codes of projected occurrences and what they are dealt by: the prefix, or for hot prefixes each longer pattern itself."""
    rows = rows[(rows[:, 0] > 0) & (rows[:, 1] > 0)]
    hot = lexicon.hot[rows[:, 0]]
    codes, deals = [packed(rows[~hot], lexicon.bits)], [mix(rows[~hot, 0].astype(np.uint64))]
    rows = rows[hot]
    for depth in range(2, lexicon.length + 1):
        some = rows[rows[:, depth - 1] > 0].copy()
        some[:, depth:] = 0
        codes.append(packed(some, lexicon.bits))
        deals.append(mix(codes[-1]))
    return np.concatenate(codes), np.concatenate(deals)


def grow(columns: list[np.ndarray], counts: np.ndarray, hot: np.ndarray, support: int, longest: int):
    """(ids, count) of the frequent patterns of two words or more among sorted pointers, prefix by prefix and depth first."""

    def runs(depth: int, low: int, high: int) -> list[tuple[int, int]]:
        cut = np.flatnonzero(np.diff(columns[depth][low:high])) + low + 1
        return list(zip([low, *cut.tolist()], [*cut.tolist(), high], strict=True))

    def extend(prefix: tuple[int, ...], low: int, high: int):
        depth = len(prefix)
        for a, b in runs(depth, low, high):
            word, n = int(columns[depth][a]), int(total[b] - total[a])
            if word and n >= support:
                yield (*prefix, word), n
                if depth + 1 < longest and b > a:
                    yield from extend((*prefix, word), a, b)

    total = np.concatenate([[0], np.cumsum(counts)])
    if not len(counts):
        return
    for a, b in runs(0, 0, len(counts)):
        first = int(columns[0][a])
        if hot[first]:  # each pointer of a hot prefix is a pattern of its own
            for i in (np.flatnonzero(counts[a:b] >= support) + a).tolist():
                yield tuple(int(c[i]) for c in columns if c[i]), int(counts[i])
        elif total[b] - total[a] >= support:
            yield from extend((first,), a, b)


def _planes(x: np.ndarray) -> bytes:
    """Sorted numbers as byte planes of their differences, which compress well."""
    return np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.uint64)[:, 0], dtype=np.uint64)


def coded_phrases(texts: DataFrame, lexicon: Lexicon, support: int, buckets: int) -> DataFrame:
    """lang, phrase, n of frequent phrases of two words or more whose words all are in the lexicon."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def project(batches):
        import pyarrow as pa

        lex = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            codes, which = np.concatenate([c for c, _ in held]), np.concatenate([w for _, w in held])
            held.clear()
            order = np.lexsort((codes, which))
            codes, which = codes[order], which[order]
            new = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (which[1:] != which[:-1])])) if len(codes) else np.zeros(0, np.int64)
            counts = np.diff(np.append(new, len(codes))).astype(np.uint64)
            codes, which = codes[new], which[new]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1, [len(which)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([int(which[a])], pa.int32()), pa.array([_planes(codes[a:b])], pa.binary()), pa.array([np.ascontiguousarray(counts[a:b]).view(np.uint8).reshape(-1, 8).T.tobytes()], pa.binary())], ["bucket", "codes", "counts"])

        for batch in batches:
            for data, starts, ends, piece, lang, langs, keys in _chunks(batch, lex.key):
                codes, deal = pointers(followed(lex.ids(data, starts, ends, lang, langs, keys), piece, lex.length), lex)
                held.append((codes, (deal % np.uint64(buckets)).astype(np.int32)))
                if sum(len(c) for c, _ in held) > GATHER:
                    yield from out()
        if held:
            yield from out()
        spare()

    def mine(table):
        import pyarrow as pa

        lex = shared.value
        codes = np.concatenate([_from_planes(x) for x in table["codes"].to_pylist()])
        counts = np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.uint64)[:, 0] for x in table["counts"].to_pylist()])
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        codes, counts = codes[new], np.add.reduceat(counts, new)
        mask = np.uint64((1 << lex.bits) - 1)
        columns = [((codes >> np.uint64(lex.bits * (lex.length - 1 - k))) & mask).astype(np.int64) for k in range(lex.length)]
        found = list(grow(columns, counts, lex.hot, support, lex.length))
        spare()
        phrases = [" ".join(lex.word(i) for i in ids) for ids, _ in found]
        return pa.table({"lang": pa.array([lex.names[lex.lang[ids[0] - 1]] for ids, _ in found], pa.string()), "phrase": pa.array(phrases, pa.string()), "n": pa.array([n for _, n in found], pa.int64())})

    return texts.mapInArrow(project, "bucket int, codes binary, counts binary").groupBy("bucket").applyInArrow(mine, "lang string, phrase string, n bigint")


def other_phrases(texts: DataFrame, lexicon: Lexicon, support: int) -> DataFrame:
    """lang, phrase, n of frequent phrases with a word beyond the lexicon."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        import pyarrow as pa

        lex = shared.value
        for batch in batches:
            for data, starts, ends, piece, lang, langs, keys in _chunks(batch, lex.key):
                rare = lex.ids(data, starts, ends, lang, langs, keys) == 0
                found: dict[tuple[int, bytes], int] = {}
                for size in range(2, lex.length + 1):
                    n = len(rare) - size + 1
                    if n <= 0:
                        continue
                    some = np.flatnonzero((piece[:n] == piece[size - 1 :]) & np.any([rare[k : k + n] for k in range(size)], axis=0))
                    for i in some.tolist():
                        phrase = b" ".join(data[starts[j] : ends[j]].tobytes() for j in range(i, i + size))
                        found[int(lang[i]), phrase] = found.get((int(lang[i]), phrase), 0) + 1
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i, _ in found], pa.string()), pa.array([p.decode() for _, p in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "phrase", "n"])
        spare()

    return texts.mapInArrow(run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= support)


def frequent_phrases(texts: DataFrame, support: int, longest: int, lexicon_size: int = LEXICON) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of all phrases of one word to longest that occur support times, and (lang, n) of all words; both written."""
    words = materialise(word_counts(texts), "words")
    totals = materialise(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    frequent = words.filter(F.col("n") >= support)
    n_frequent = frequent.count()
    all_words = sum(r["n"] for r in totals.agg(F.sum("n").alias("n")).collect() if r["n"])
    buckets = max(partitions(texts.sparkSession), -(-all_words // BUCKET))
    single = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n")
    if not n_frequent or longest < 2:
        return materialise(single, "phrases"), totals
    room = min(lexicon_size, (1 << (64 // longest)) - 1)
    listed = frequent.orderBy(F.desc("n"), "lang", "word").limit(room).toArrow() if n_frequent > room else frequent.toArrow().sort_by([("n", "descending"), ("lang", "ascending"), ("word", "ascending")])
    lexicon = Lexicon(listed["lang"].to_pylist(), listed["word"].to_pylist(), listed["n"].to_pylist(), longest, max(support, all_words // buckets // 2))
    del listed
    found = coded_phrases(texts, lexicon, support, buckets)
    if n_frequent > room:
        found = found.unionByName(other_phrases(texts, lexicon, support))
    phrases = materialise(single.unionByName(found.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "n")), "phrases")
    discard(words)
    return phrases, totals


def _part(words: Column, start: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates of two words or more with a, and l, r and score of their lowest-scoring cut (of equal ones the first)."""
    w = F.split("phrase", " ")
    cuts = phrases.filter("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("*", _part(w, 1, F.col("k")).alias("left"), _part(w, F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    known = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  exact to 38 digits
    a2 = (wide("a") * wide("a")).cast("decimal(30,0)") * F.lit(1000000).cast("decimal(8,0)")
    cuts = cuts.withColumn("__top", a2.cast("decimal(38,0)")).withColumn("__by", (wide("l") * wide("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("__top div __by").cast("bigint"))
    return cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "size", "a", "c.l", "c.r", "c.score")


def maximal(candidates: DataFrame, percent: int = 50) -> DataFrame:
    """Candidates that stand in no longer candidate which has percent of their occurrences or more."""
    w = F.split("phrase", " ")
    inner = candidates.filter("size > 2").select("lang", "a", w.alias("w"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    inner = inner.select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("i")).select("lang", _part(F.col("w"), F.col("i"), F.col("k")).alias("phrase"), F.col("a").alias("__longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("__longer").alias("__longer"))
    return candidates.join(inner, ["lang", "phrase"], "left").filter(F.col("__longer").isNull() | (100 * F.col("__longer") < percent * F.col("a"))).drop("__longer")


def collocations(docs: DataFrame, support: int = 10, longest: int = 3, top: int = 2000, percent: int = 50, lang_col: str = "lang", text_col: str = "text", lexicon_size: int = LEXICON) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's top phrases by score, then a, then the phrase's bytes."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    phrases, totals = frequent_phrases(texts, support, longest, lexicon_size)
    kept = maximal(materialise(scored(phrases), "candidates"), percent)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = kept.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(max(PARTS, partitions(docs.sparkSession)))))
    parts = parts.withColumn("__rank", F.row_number().over(W.partitionBy("lang", "__part").orderBy(*best))).filter(F.col("__rank") <= top)
    ranked = parts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
