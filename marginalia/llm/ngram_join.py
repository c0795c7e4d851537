"""N-gram Jaccard join over tries of globally ordered shingle sets.

1. Every document becomes the set of its distinct word shingles, 63-bit hashes under a random key of the run, so that no
   text can be made to collide with another. Shingles that many documents share get numbers above all others,
   by count; so the numeric order is a global order, rarest first.
2. Documents with equal sets form one class. A class shows the first ``n - ceil(t n) + 1`` shingles of its set: two sets
   within the threshold share one of them at least, so classes that share none need not meet.
3. Of the classes that show a shingle, and have a partner of like size there, the most connected one leads; a group is a leader with all classes that show a
   shingle it leads. Groups larger than GROUP shingles are cut into blocks.
4. A group in one block is screened: the lesser counts of two sets' bucket histograms, added up, bound their overlap.
   In a block the sets, most frequent shingles first, are a trie: sorted sequences whose common starts are nodes. One
   traversal carries all sets down as queries, adds up their overlap with a node once for all sets below it, and lets
   go of a query where even the remaining lengths cannot reach the overlap that the threshold asks for.
5. Links make components. Blocks of one group are then joined across, for those members only that are not in their
   leader's component yet. Within a group only links that connect something new are reported.

Defined results: null and empty texts and texts without words have an empty set and link with nothing. Fewer words than a
shingle has make one shingle. Rows with null or repeated ids are documents of their own; a component's id is the least
id in it, null if all are null. Columns beside id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.llm.common import discard, hot_rows, materialise, most_frequent, split_join
from marginalia.llm.components import components
from marginalia.llm.textkernel import HashTable, ascii_words, buffers, mix, pieces, spare, span_hashes

#: Shingles with a place of their own in the global order, at most (16 bytes each, broadcast); all others follow their
#: hash. The number changes how many sets meet, never which are linked.
COMMON, LEAST_COMMON = 1 << 17, 6
#: Shingles of a block, about: what one step of one task holds.
GROUP = 1 << 20
#: Cells of the membership matrix of a traversal.
CELLS = 1 << 25
#: Tokens of an edge between two looks at the bounds.
EDGE = 64
#: Shingles that a counting worker holds at once.
COUNTED = 1 << 21
#: Classes of a group that are screened against each other; larger groups go to the trie as they are.
SCREENED = 4096
#: Ids, and keys listed beside them, up to this many (about 10 MB) are broadcast to a scan; more are joined by a shuffle.
BROADCAST_IDS = 100_000
TOP = np.uint64(1 << 63)


# --- sets
def shingle_sets(raw: np.ndarray, off: np.ndarray, words: int, key: int = 0):
    """Yields the sorted distinct 63-bit shingle hashes, under a key, of each text raw[off[i]:off[i+1]]."""
    for a, b in pieces(np.diff(off)):
        data, starts, ends, text = ascii_words(raw, off[a : b + 1])
        tokens = span_hashes(data, starts, ends, key)
        counts = np.bincount(text, minlength=b - a) if len(text) else np.zeros(b - a, np.int64)
        h = np.zeros(max(len(tokens) - words + 1, 0), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(words):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + tokens[j : j + len(h)])
        h >>= np.uint64(1)
        first = np.cumsum(counts) - counts
        for i in range(b - a):
            n, f = int(counts[i]), int(first[i])
            if n >= words:
                yield np.unique(h[f : f + n - words + 1])
            elif n:
                yield np.array([int.from_bytes(hashlib.md5(b"%d:" % n + tokens[f : f + n].tobytes()).digest()[:8], "little") >> 1], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


class Order:
    """The global order: common shingles, given from the rarest to the most frequent, come after all others. key: of the hashes."""

    def __init__(self, common: np.ndarray, key: int):
        self.common, self.key, self.table = common, key, None

    def __getstate__(self):
        return self.common, self.key

    def __setstate__(self, state):
        self.__init__(*state)

    def sets(self, column, words: int):
        """Shingle sets of an Arrow column of texts."""
        return shingle_sets(*buffers(column), words, self.key)

    def place(self, shingles: np.ndarray) -> np.ndarray:
        """Shingles as numbers of the global order, sorted."""
        if self.table is None:
            self.table = HashTable(18)
            if len(self.common):
                self.table.put(self.common << np.uint64(1), np.arange(len(self.common)))
        at = self.table.get(shingles << np.uint64(1))
        return np.sort(np.where(at >= 0, TOP + at.astype(np.uint64), shingles))


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """Least intersection size with which sets of n and m are linked: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def shown(n: int, percent: int) -> int:
    """Shingles that a set of n shows: with one less, a partner could avoid them all."""
    return n - -(-percent * n // 100) + 1


# --- the screen
def histogram(s: np.ndarray) -> bytes:
    """Counts of a set's shingles in a power of two of buckets, about eight in each; halving the buckets adds neighbours."""
    bits = max(4, int(len(s) - 1).bit_length() - 3) if len(s) else 4
    at = (mix(s) >> np.uint64(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_link(sizes: np.ndarray, histograms: list[bytes], percent: int) -> np.ndarray:
    """Which sets have a partner that their histograms allow: no overlap exceeds the sum of the lesser counts."""
    n, keep = len(sizes), np.zeros(len(sizes), bool)
    width = np.array([len(h) for h in histograms])
    rows = [np.frombuffer(h, np.uint8) for h in histograms]
    full = np.array([bool((r == 255).any()) for r in rows])
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        wider = np.flatnonzero((width > w) & (sizes * percent <= 100 * sizes[own].max()))
        others = np.concatenate([own, wider])
        table = np.stack([rows[i].astype(np.int32).reshape(w, -1).sum(1) for i in others])
        order = np.argsort(sizes[others], kind="stable")
        others, table = others[order], table[order]
        reach = np.searchsorted(sizes[others] * percent, sizes[own] * 100, "right")
        place = np.empty(n, np.int64)
        place[others] = np.arange(len(others))
        for i, end in zip(own.tolist(), reach.tolist(), strict=True):
            a = place[i] + 1
            if a < end:
                most = np.minimum(table[a - 1], table[a:end]).sum(1, dtype=np.int64)
                near = (most >= least_overlap(sizes[others[a:end]], sizes[i], percent)) | full[others[a:end]] | full[i]
                if near.any():
                    keep[i] = True
                    keep[others[a:end][near]] = True
    return keep


# --- the trie
def trie_links(sets: list[np.ndarray], percent: int, labels: np.ndarray, queries: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) between sets (numbers of the global order, sorted) that connect different labels.

    labels: sets with the same label are connected already; they change as links are found. queries: the sets that
    ask, each other one only answers (all ask when it is None). Every pair that could connect two labels is decided.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, ranks = np.unique(np.concatenate(sets), return_inverse=True)
    ranks = (len(values) - 1 - ranks).astype(np.int64)  # most frequent first
    at = np.concatenate([[0], np.cumsum(sizes)])
    paths = [ranks[at[i] : at[i + 1]][::-1] for i in range(n)]
    order = sorted(range(n), key=lambda i: paths[i].astype(">u4").tobytes())
    seq, size = [paths[i] for i in order], sizes[order]
    asks = np.ones(n, bool) if queries is None else queries[order]
    label, links = labels[order].copy(), []
    common = [0] * n  # tokens shared with the set before
    for i in range(1, n):
        m = min(len(seq[i]), len(seq[i - 1]))
        differs = np.flatnonzero(seq[i][:m] != seq[i - 1][:m])
        common[i] = int(differs[0]) if len(differs) else m
    asking = np.flatnonzero(asks)
    chunk = max(1, CELLS // max(len(values), 1))
    for low in range(0, len(asking), chunk):
        some = asking[low : low + chunk]
        member = np.zeros((len(some), len(values)), bool)
        for row, q in enumerate(some):
            member[row, seq[q]] = True
        # nodes: sets [a, b) that share their first `depth` tokens; the queries still alive with their overlaps so far
        stack = [(0, n, 0, np.arange(len(some)), np.zeros(len(some), np.int64))]
        while stack:
            a, b, depth, alive, got = stack.pop()
            end = len(seq[a]) if b - a == 1 else min(common[a + 1 : b])
            least, most = int(size[a:b].min()), int(size[a:b].max())
            if queries is None:  # of a pair, the set that sorts first asks
                keep = some[alive] < b - (b - a == 1)
                alive, got = alive[keep], got[keep]
            if b - a == 1:
                keep = label[some[alive]] != label[a]
                alive, got = alive[keep], got[keep]
            asked = size[some[alive]]
            need = least_overlap(asked, least, percent)
            keep = (percent * least <= 100 * asked) & (100 * most >= percent * asked)
            alive, got, need = alive[keep], got[keep], need[keep]
            while depth < end and len(alive):
                step = min(end, depth + EDGE)
                tokens = seq[a][depth:step]
                got = got + member[np.ix_(alive, tokens)].sum(1)
                depth = step
                left = np.minimum(size[some[alive]] - got, most - depth)
                keep = got + left >= need
                alive, got, need = alive[keep], got[keep], need[keep]
            if not len(alive):
                continue
            if b - a == 1:
                for q, g in zip(some[alive].tolist(), got.tolist(), strict=True):
                    if label[q] != label[a] and 100 * g >= percent * (size[q] + size[a] - g):
                        links.append((order[q], order[a]))
                        label[label == label[q]] = label[a]
                continue
            cuts = [a, *[i for i in range(a + 1, b) if common[i] == depth], b]
            for c, d in zip(cuts, cuts[1:], strict=False):
                if len(seq[c]) == depth and d - c > 1:  # a set that ends here, before longer ones
                    stack.append((c, c + 1, depth, alive, got))
                    c += 1
                stack.append((c, d, depth, alive, got))
    labels[order] = label
    return links


# --- on Spark
def _scan(docs: DataFrame, function, schema: str) -> DataFrame:
    return docs.mapInArrow(function, schema)


def common_shingles(texts: DataFrame, words: int, key: int, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The corpus' most frequent shingles, from the most frequent on, and their counts, which cover every document.

    A worker reports shingles that it met in several of the documents it holds at once; the driver gets at most most of
    the sums.
    """

    def count(batches):
        import pyarrow as pa

        held, size = [], 0

        def emit():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys[n > 1].view(np.int64)), pa.array(n[n > 1])], ["s", "n"])

        for batch in batches:
            for s in shingle_sets(*buffers(batch["__text"]), words, key):
                held.append(s)
                size += len(s)
                if size > COUNTED:
                    yield emit()
                    size = 0
        if held:
            yield emit()
        spare()

    found = _scan(texts.select("__text"), count, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COMMON)
    shingles, counts = most_frequent(found, "s", "n", most)
    return np.array(shingles, np.uint64), np.array(counts, np.int64)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes()).digest()


def shingled(texts: DataFrame, order, words: int, percent: int) -> DataFrame:
    """__id, n, class (digest of the set), its histogram and the shown shingles of every document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            low, rows = 0, []
            ids = batch["__id"]

            def flush(low, rows):
                n, digests, counts, firsts = zip(*rows, strict=True)
                off = np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32)
                shown_ = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(firsts).view(np.int64), pa.int64()))
                return pa.RecordBatch.from_arrays([ids.slice(low, len(rows)), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(counts, pa.binary()), shown_], ["__id", "n", "class", "counts", "shown"])

            size = 0
            for s in order.value.sets(batch["__text"], words):
                placed = order.value.place(s)
                rows.append((len(s), _digest(s), histogram(s), placed[: shown(len(s), percent)] if len(s) else s))
                size += len(s)
                if len(rows) == 2000 or size > GROUP:
                    yield flush(low, rows)
                    low, rows, size = low + len(rows), [], 0
            if rows:
                yield flush(low, rows)
        spare()

    return _scan(texts, run, "__id bigint, n bigint, class binary, counts binary, shown array<bigint>")


def _sets(texts: DataFrame, placed: DataFrame, classes: DataFrame, order, words: int) -> DataFrame:
    """placed(key, class, label, asks) with the set of each class (sorted numbers of the global order as bytes).

    One document of each class is read again and its set made once, for all of its keys; nothing but the rows of
    the blocks is shuffled after that.
    """
    wanted = placed.groupBy("class").agg(F.collect_list(F.struct("key", "asks")).alias("to"), F.min("label").alias("label"))
    wanted = materialise(wanted.join(classes.select("class", F.coalesce("__id", F.lit(-(2**63))).alias("__i")), "class"), "wanted")
    n = wanted.agg(F.coalesce(F.sum(F.size("to")), F.lit(0)) + F.count(F.lit(1))).first()[0]
    docs = texts.withColumn("__i", F.coalesce("__id", F.lit(-(2**63)))).join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, "__i")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            expected, low = batch["class"].to_pylist(), 0
            held: list[tuple[int, bytes]] = []

            def flush():
                part = batch.take(pa.array([i for i, _ in held], pa.int64()))
                return pa.RecordBatch.from_arrays([part["class"], part["to"], part["label"], pa.array([x for _, x in held], pa.binary())], ["class", "to", "label", "set"])

            for i, s in enumerate(order.value.sets(batch["__text"], words)):
                if _digest(s) == expected[i]:  # an id may repeat with another text
                    held.append((i, order.value.place(s).tobytes()))
                    low += len(s)
                if low > GROUP:
                    yield flush()
                    held, low = [], 0
            if held:
                yield flush()
        spare()

    made = docs.select("__text", "class", "to", "label").mapInArrow(run, "class binary, to array<struct<key:string,asks:boolean>>, label binary, set binary")
    return made.select("class", "label", "set", F.inline("to"))


def _screened(rows: DataFrame, percent: int) -> DataFrame:
    """key and class of the rows(key, class, n, counts) that have a partner of their key that the histograms allow."""

    def run(batches):
        import pyarrow as pa

        key, held = None, []

        def solve():
            if len(held) > 1:
                ok = may_link(np.array([n for _, n, _ in held], np.int64), [c for *_, c in held], percent)
                if ok.any():
                    return pa.RecordBatch.from_arrays([pa.array([key] * int(ok.sum()), pa.string()), pa.array([h[0] for h, k in zip(held, ok, strict=True) if k], pa.binary())], ["key", "class"])

        for batch in batches:
            for k, *row in zip(*(batch[c].to_pylist() for c in ("key", "class", "n", "counts")), strict=True):
                if k != key:
                    if (out := solve()) is not None:
                        yield out
                    key, held = k, []
                held.append(row)
        if (out := solve()) is not None:
            yield out

    return rows.repartition("key").sortWithinPartitions("key").select("key", "class", "n", "counts").mapInArrow(run, "key string, class binary")


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """Links u, v found in blocks of rows(key, class, set, label, asks); rows of a key come together, one key at a time is held."""

    def run(batches):
        import pyarrow as pa

        key, held = None, []

        def solve():
            if len(held) < 2:
                return None
            sets = [np.frombuffer(s, np.uint64) for _, s, _, _ in held]
            _, labels = np.unique([x for _, _, x, _ in held], return_inverse=True)
            asks = np.array([a for *_, a in held], bool)
            found = trie_links(sets, percent, labels, None if asks.all() else asks)
            if found:
                return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i, _ in found], pa.binary()), pa.array([held[j][0] for _, j in found], pa.binary())], ["u", "v"])

        for batch in batches:
            for k, *row in zip(*(batch[c].to_pylist() for c in ("key", "class", "set", "label", "asks")), strict=True):
                if k != key:
                    if (out := solve()) is not None:
                        yield out
                    key, held = k, []
                if not held or held[-1][0] != row[0]:
                    held.append(row)
                else:  # one class asks and answers
                    held[-1][3] = held[-1][3] or row[3]
        if (out := solve()) is not None:
            yield out

    dealt = rows.repartition("key").sortWithinPartitions("key", "class")
    return dealt.select("key", "class", "set", "label", "asks").mapInArrow(run, "u binary, v binary")


def _with_partners(tokens: DataFrame, percent: int) -> DataFrame:
    """token, class, n, c (rows of the token that stay) of tokens(class, n, token, early) with a partner of like size."""
    by_size = W.partitionBy("token").orderBy("n", "class")
    ahead = F.lead("n").over(by_size)
    behind = F.max(F.when(F.col("early"), F.col("n"))).over(by_size.rowsBetween(W.unboundedPreceding, -1))
    marked = tokens.withColumn("ahead", ahead).withColumn("behind", behind)
    near = (F.col("early") & (F.col("n") * 100 >= F.col("ahead") * percent)) | (F.col("behind") * 100 >= F.col("n") * percent)
    return marked.filter(near).withColumn("c", F.count(F.lit(1)).over(W.partitionBy("token"))).select("token", "class", "n", "c")


def _with_partners_hot(tokens: DataFrame, percent: int) -> DataFrame:
    """The same for hot tokens, of which there are few: sizes are summed up first, so no task gets all rows of a token.

    Rows of equal size are partners of each other here, whatever their order.
    """
    sizes = tokens.groupBy("token", "n").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("early").cast("bigint")).alias("e"))
    by_size = W.partitionBy("token").orderBy("n")
    behind = F.max(F.when(F.col("e") > 0, F.col("n"))).over(by_size.rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.withColumn("ahead", F.lead("n").over(by_size)).withColumn("behind", behind)
    up = F.coalesce((F.col("k") > 1) | (F.col("n") * 100 >= F.col("ahead") * percent), F.lit(False))
    down = F.coalesce(F.col("behind") * 100 >= F.col("n") * percent, F.lit(False))
    # rows of this size that stay: early ones for what is ahead, all for what is behind, and for another early one of their size
    early_stays = up | down | (F.col("e") > 1)
    late_stays = down | (F.col("e") > 0)
    stay = F.when(early_stays, F.col("e")).otherwise(0) + F.when(late_stays, F.col("k") - F.col("e")).otherwise(0)
    sizes = materialise(sizes.select("token", "n", early_stays.alias("es"), late_stays.alias("ls"), F.sum(stay).over(W.partitionBy("token")).alias("c")), "hot-sizes")
    facts = F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes
    return tokens.join(facts, ["token", "n"]).filter(F.when(F.col("early"), F.col("es")).otherwise(F.col("ls"))).select("token", "class", "n", "c")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id reachable by links of Jaccard percent / 100 or more)."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    key_ = secrets.randbits(64)
    common, frequency = common_shingles(texts, words, key_)
    order = docs.sparkSession.sparkContext.broadcast(Order(common[::-1].copy(), key_))
    rows = materialise(shingled(texts, order, words, percent), "shingled")
    total = rows.count()
    classes = materialise(rows.filter("n > 0").groupBy("class").agg(F.min("__id").alias("__id"), F.max("n").alias("n"), F.first("counts").alias("counts"), F.count(F.lit(1)).alias("copies")), "set-classes")
    # one showing of each class: copies of a set are dropped by id, by a broadcast while they are few
    least = classes.filter("copies > 1").select("class", F.col("__id").alias("__least"), "copies")
    copies = materialise(split_join(rows.filter("n > 0").select("__id", "class"), least, "class", "copies", total).filter("not (__id <=> __least)").select("__id", "class"), "copies")
    firsts = rows.filter("n > 0").join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, ["__id", "class"], "left_anti")
    # Of a linked pair, the first shingle in common stands early in the smaller set (a short way, "early") and in what the
    # larger one shows, and their sizes are within the percentage; rows of a shingle without such a partner go.
    early = F.col("at") < F.col("n") - F.ceil(F.lit(2.0) * percent * F.col("n") / (100 + percent) - 1e-9) + 1
    tokens = firsts.select("class", "n", F.posexplode("shown").alias("at", "token")).select("class", "n", "token", early.alias("early"))
    hot = int((frequency >= hot_rows(total)).sum())
    # a shingle's place in the order tells whether it is hot: numbers from 2**63 on, negative as signed ones, are common
    is_hot = (F.col("token") < 0) & (F.col("token") >= F.lit(len(common) - hot - 2**63))
    shared = _with_partners(tokens.filter(~is_hot) if hot else tokens, percent)
    if hot:
        shared = shared.unionByName(_with_partners_hot(tokens.filter(is_hot), percent))
    shared = materialise(shared, "shared-shingles")
    discard(copies)

    # the most connected class that shows a shingle leads it
    reach = shared.groupBy("class").agg(F.sum("c").alias("reach"))
    placed = materialise(shared.join(reach, "class").select("token", "class", "n", F.struct("reach", "class").alias("rank")), "placed-shingles")
    discard(shared)
    leads = placed.groupBy("token").agg(F.max("rank").alias("top"), F.count(F.lit(1)).alias("k")).select("token", F.col("top.class").alias("leader"), "k")
    members = materialise(split_join(placed, leads, "token", "k", placed.count()).select("leader", "class", "n").distinct(), "members")
    discard(placed)
    totals = members.groupBy("leader").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")).filter("k > 1").withColumn("blocks", F.ceil(F.col("total") / GROUP).cast("int"))
    totals = totals.select("leader", "blocks", (F.col("k") <= SCREENED).alias("screened"), "k")
    members = split_join(members, totals, "leader", "k", members.count())
    members = materialise(members.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")), "blocks")

    is_leader = F.col("class") == F.col("leader")
    every = F.when(is_leader, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    inside = members.select("leader", "class", "blocks", "screened", F.explode(every).alias("block"))
    key = lambda *c: F.md5(F.concat_ws(":", F.hex("leader"), *c))
    # a small group in one block is screened by histograms first, so that only sets with a likely partner are made; the
    # members of a group in several blocks may find theirs in another one and stay
    screened = (F.col("blocks") == 1) & F.col("screened")
    whole = members.filter(screened).select(key("block").alias("key"), "class").join(classes.select("class", "n", "counts"), "class")
    asked = _screened(whole, percent).unionByName(inside.filter(~screened).select(key("block").alias("key"), "class"))
    asked = asked.select("key", "class", F.col("class").alias("label"), F.lit(True).alias("asks"))
    links = materialise(_links(_sets(texts, asked, classes, order, words), percent), "links")
    found = components(links)

    split = members.filter("blocks > 1")
    if not split.isEmpty():
        found = materialise(found, "components")
        named = split.join(found.withColumnRenamed("v", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
        # every leader here has more than GROUP shingles below it, so these tables are short
        home = named.filter(is_leader).select("leader", F.col("label").alias("home"))
        named = materialise(named.join(F.broadcast(home), "leader").withColumn("out", F.col("label") != F.col("home")), "split-members")
        load = named.filter("out").groupBy("leader").agg(F.ceil(F.sum("n") / GROUP).cast("int").alias("rounds"))
        named = named.join(F.broadcast(load), "leader")
        turn = F.pmod(F.xxhash64("class", F.lit("turn")), F.col("rounds")).cast("int")
        queries = named.filter("out").withColumn("turn", turn).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
        answers = named.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1))).withColumn("asks", F.lit(False))
        columns = [key("turn", "block").alias("key"), "class", "label", "asks"]
        across = queries.select(*columns).unionByName(answers.select(*columns)).groupBy("key", "class", "label").agg(F.max("asks").alias("asks"))
        links = materialise(links.unionByName(_links(_sets(texts, across, classes, order, words), percent)), "links")
        found = components(links)

    # class by class first: the label, the least id of all classes of the label; then once for every row
    named = classes.select("class", "__id", "copies").join(found.withColumnRenamed("v", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    named = materialise(named, "labelled")
    least = named.groupBy("label").agg(F.min("__id").alias("component_id"), F.count(F.lit(1)).alias("k"))
    owned = materialise(split_join(named, least, "label", "k", named.count()).select("class", "component_id", "copies"), "class-components")
    order.destroy()
    discard(members, links, named, classes)
    whole = split_join(rows.filter("n > 0").select("__id", "n", "class"), owned, "class", "copies", total).select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return whole.unionByName(rows.filter("n = 0").select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), F.col("__id").alias("component_id")))
