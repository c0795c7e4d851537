"""Ranked lexical search: an inverted index in shards of documents, posting blocks of variable size, block-max pruning.

Every task cuts the documents that it reads into shards of bounded size and inverts each. A posting has the document's
place in its shard and its impact (the part of the score that does not depend on how rare the term is). The postings of a
term are cut into blocks by dynamic programming: the sum of (block maximum - impact), the error of the bounds, and a
price for each block is least. A search takes the queries in batches and each shard by itself: between the ends of all
blocks of a query's terms lie windows, whose bound sums the block maxima times the weights of the terms that have a
posting in the window (the pivot test, for all windows of a shard at once); windows are opened in falling order of bound, and those whose bound cannot reach the k-th best score are skipped, never decoded.
The result is exact: ties at the bound are opened too, and the best of the shards meet in one ranking.

Nothing is gathered by term, so frequent words, hot sources and copies cost their own postings only. Queries and the
weights of their terms are broadcast in batches of a stated number of terms; all other data are shuffled by shard.

Defined results: null texts have no terms, so a null query ranks nothing and a null document is never found; null and
repeated ids are documents or queries of their own (null ids first among equal scores); with no terms at all, nothing is
ranked; an empty table gives an empty result; other columns are not read, so names cannot clash.
"""

from __future__ import annotations

import secrets

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.llm.common import discard, materialise
from marginalia.llm.textkernel import _LOWER, buffers, equal_spans, pieces, ragged, span_hashes, spare

#: Terms are runs of these: letters and digits of ASCII, and all beyond it.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Term occurrences and documents of a shard at most (one longer document makes a shard of its own).
SHARD_TERMS, SHARD_DOCS = 1 << 21, 1 << 16
#: Postings of a block at most, its price in mean impacts of its list, and postings that are cut at once.
BLOCK, PRICE, STRETCH = 64, 4.0, 4096
#: Terms of the queries of a batch; windows opened in the first round and in a later one.
BATCH_TERMS, FIRST_WINDOWS, MOST_WINDOWS = 1 << 18, 16, 256
#: Bytes of text looked at at once.
CHUNK = 1 << 20
#: Fixed values of the score.
SCALE, PER_TF, PER_LENGTH, BASE, SLOPE = 1_000_000_000, 1000, 8, 10, 90

_INSIDE = np.ones(256, bool)
_INSIDE[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


def terms_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of the texts raw[offsets[i]:offsets[i + 1]]: lower-cased bytes, starts, ends, and the text of each."""
    data, off = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    inside = _INSIDE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = off[1:] > off[:-1]
    before[off[:-1][full]], after[off[1:][full] - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return _LOWER[data], starts, ends, np.searchsorted(off, starts, "right") - 1


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each span among the distinct ones, and the first of each; hashes are confirmed by bytes."""
    while True:
        _, first, number = np.unique(span_hashes(data, starts, ends, key), return_index=True, return_inverse=True)
        if equal_spans(data, starts, ends, data, starts[first][number], ends[first][number]).all():
            return number, first
        key = secrets.randbits(64)


def cut_blocks(impacts: np.ndarray, bounds: np.ndarray, price: float = PRICE, most: int = BLOCK) -> np.ndarray:
    """Last postings of the blocks of lists impacts[bounds[i]:bounds[i + 1]], none empty.

    Exact dynamic programming under blocks of at most most postings, in stretches of STRETCH postings of a list, which
    advance side by side: cost(block) = size * maximum - sum + price, where the sums of a list are the same for every cut.
    """
    low, high = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        low.extend(range(a, b, STRETCH))
        high.extend([*range(a + STRETCH, b, STRETCH), b])
    low, high = np.array(low, np.int64), np.array(high, np.int64)
    size = high - low
    back = np.ones(len(impacts), np.int64)  # postings of the best last block of what ends at each posting
    mean = np.add.reduceat(impacts, low) / size if len(low) else np.zeros(0)
    classes = (1, 8, most, STRETCH)
    for least, largest in zip(classes[:-1], classes[1:], strict=True):
        some = np.flatnonzero((size > least) & (size <= largest))
        some = some[np.argsort(-size[some], kind="stable")]
        for at in range(0, len(some), 1 << 14):
            _advance(impacts, low[some[at : at + (1 << 14)]], size[some[at : at + (1 << 14)]], mean[some[at : at + (1 << 14)]] * price, min(most, largest), back)
    ends, left = [], high.copy()
    alive = np.flatnonzero(left > low)
    while len(alive):
        ends.append(left[alive] - 1)
        left[alive] -= back[left[alive] - 1]
        alive = alive[left[alive] > low[alive]]
    return np.sort(np.concatenate(ends)) if ends else np.zeros(0, np.int64)


def _advance(impacts, low, size, price, width, back) -> None:
    """Fill back for stretches in falling order of size: column j % width has the cost before posting j and the maximum from it on."""
    top, cost, best = np.zeros((len(low), width)), np.full((len(low), width), np.inf), np.zeros(len(low))
    column = np.arange(width)
    for i in range(int(size[0])):
        n = int(np.searchsorted(-size, -i, "left"))  # stretches of more than i postings
        used, here, x = min(i + 1, width), i % width, impacts[low[:n] + i].astype(np.float64)
        np.maximum(top[:n, :used], x[:, None], out=top[:n, :used])
        top[:n, here], cost[:n, here] = x, best[:n]
        length = (i - column[:used]) % width + 1
        total = cost[:n, :used] + length * top[:n, :used]
        choice = np.argmin(total, axis=1)
        best[:n] = total[np.arange(n), choice] + price[:n]
        back[low[:n] + i] = length[choice]


def invert(data, starts, ends, doc, n_docs: int, n_terms: int, n_all: int, key: int):
    """Terms of a shard: words' first spans, bounds of their postings, documents and impacts, last postings of blocks and block bounds."""
    number, first = distinct_spans(data, starts, ends, key)
    code, tf = np.unique(number.astype(np.int64) * n_docs + doc, return_counts=True)
    term, doc = code // n_docs, code % n_docs
    length = np.bincount(doc, weights=tf, minlength=n_docs).astype(np.int64)
    m = BASE + (SLOPE * length * n_all) // max(n_terms, 1)
    impact = (SCALE * tf) // (PER_TF * tf + PER_LENGTH * m[doc])
    bounds = np.searchsorted(term, np.arange(len(first) + 1))
    last = cut_blocks(impact, bounds)
    maxima = np.maximum.reduceat(impact, np.concatenate([[0], last[:-1] + 1])) if len(last) else impact
    return first, bounds, doc, impact, last, np.searchsorted(last, bounds), maxima


INDEX = "shard string, term string, df bigint, ends binary, maxima binary, docs binary, impacts binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The index as a written table (INDEX), and the number of documents with a term.

    A row for each term of each shard; the row of term '' has the ids of the shard's documents (impacts: 1 where null).
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sizes = texts.select(F.regexp_count("text", F.lit(TERM)).cast("bigint").alias("n"))
    n_docs, n_terms = sizes.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    key = secrets.randbits(64)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, made, held, have, documents = TaskContext.get().partitionId(), 0, [], 0, 0

        def shard():
            nonlocal made, have, documents
            ids = pa.concat_arrays([h[-1] for h in held])
            shift = np.cumsum([0, *(len(h[0]) for h in held)])
            base = np.cumsum([0, *(len(h[-1]) for h in held)])
            data = np.concatenate([h[0] for h in held])
            starts, ends = (np.concatenate([h[k] + s for h, s in zip(held, shift[:-1], strict=True)]) for k in (1, 2))
            doc = np.concatenate([h[3] + b for h, b in zip(held, base[:-1], strict=True)])
            held.clear()
            name, made, have, documents = f"{task}-{made}", made + 1, 0, 0
            first, bounds, doc, impact, last, blocks, maxima = invert(data, starts, ends, doc, len(ids), n_terms, n_docs, key)
            small, place = np.uint16 if len(ids) <= 1 << 16 else np.uint32, doc
            yield pa.RecordBatch.from_pydict({
                "shard": [name], "term": [""], "df": pa.array([len(ids)], pa.int64()), "ends": pa.array([b""], pa.binary()), "maxima": pa.array([b""], pa.binary()),
                "docs": pa.array([ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()), "impacts": pa.array([np.asarray(ids.is_null()).astype(np.uint8).tobytes()], pa.binary()),
            })
            for a in range(0, len(first), 4096):
                some = range(a, min(a + 4096, len(first)))
                lists = [(bounds[i], bounds[i + 1], blocks[i], blocks[i + 1]) for i in some]
                binary = lambda x, kind, pairs: pa.array([x[p:q].astype(kind).tobytes() for p, q in pairs], pa.binary())
                post, block = [(p, q) for p, q, *_ in lists], [(p, q) for *_, p, q in lists]
                yield pa.RecordBatch.from_pydict({
                    "shard": [name] * len(some), "term": [data[starts[first[i]] : ends[first[i]]].tobytes().decode() for i in some], "df": pa.array([q - p for p, q in post], pa.int64()),
                    "ends": binary(place[last], small, block), "maxima": binary(maxima, np.uint32, block), "docs": binary(place, small, post), "impacts": binary(impact, np.uint32, post),
                })

        for batch in batches:
            raw, off = buffers(batch["text"])
            for a, b in pieces(np.diff(off), CHUNK):
                low = a
                data, starts, ends, text = terms_of(raw, off[a : b + 1])
                while low < b:  # as many documents as the shard has room for
                    begin = np.searchsorted(text, low - a)
                    room = np.searchsorted(text, np.arange(low - a, b - a), "right") - begin <= SHARD_TERMS - have
                    n = min(int(np.argmin(room)) if not room.all() else b - low, SHARD_DOCS - documents)
                    if n == 0 and held:
                        yield from shard()
                        continue
                    n = max(n, 1)
                    end = np.searchsorted(text, low - a + n)
                    if end > begin:
                        x, y = starts[begin], ends[end - 1]
                        held.append((data[x:y].copy(), starts[begin:end] - x, ends[begin:end] - x, text[begin:end] - (low - a), batch["id"].slice(low, n)))
                        have, documents = have + int(end - begin), documents + n
                    low += n
        if held:
            yield from shard()
        spare()

    return materialise(texts.mapInArrow(run, INDEX), "search-index"), n_docs


class Posting:
    """A term's postings in a shard: documents, impacts, and the last document and maximum of each block."""

    def __init__(self, docs, impacts, ends, maxima):
        self.docs, self.impacts, self.ends, self.maxima = docs.astype(np.int64), impacts.astype(np.int64), ends.astype(np.int64), np.append(maxima.astype(np.int64), 0)


def best_of_shard(lists: list[Posting], weights: list[int], ids: np.ndarray, null: np.ndarray, k: int, scratch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the shard's k best above 0, equal scores by id. scratch: zeros for every document, given back as such."""
    ends = np.unique(np.concatenate([p.ends for p in lists]))
    bound, edges = np.zeros(len(ends), np.int64), []
    for p, w in zip(lists, weights, strict=True):  # the pivot test of all windows: a term counts where its cursor comes to stand
        edge = np.concatenate([[0], np.searchsorted(p.docs, ends, "right")])
        bound += np.where(edge[1:] > edge[:-1], w * p.maxima[np.searchsorted(p.ends, ends)], 0)
        edges.append(edge)
    order = np.argsort(-bound, kind="stable")
    falling = bound[order]
    kept_docs, kept, least, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 0, FIRST_WINDOWS
    while at < len(order) and falling[at] >= least:
        upto = min(at + step, int(np.searchsorted(-falling, -least, "right")))
        chosen = np.sort(order[at:upto])
        met = []
        for p, w, edge in zip(lists, weights, edges, strict=True):
            some = ragged(edge[chosen], edge[chosen + 1] - edge[chosen])
            docs = p.docs[some]
            scratch[docs] += w * p.impacts[some]
            met.append(docs)
        docs = np.unique(np.concatenate(met))
        scores = scratch[docs]
        scratch[docs] = 0
        good = scores >= least
        kept_docs, kept = np.concatenate([kept_docs, docs[good]]), np.concatenate([kept, scores[good]])
        if len(kept) > k:
            least = max(1, int(np.partition(kept, len(kept) - k)[len(kept) - k]))
            kept_docs, kept = kept_docs[kept >= least], kept[kept >= least]
        at, step = upto, min(2 * step, MOST_WINDOWS)
    first = np.lexsort((ids[kept_docs], ~null[kept_docs], -kept))[:k]
    return kept_docs[first], kept[first]


def query_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """query (a number of its own), item, terms (distinct) of items with a term; written."""
    low = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = items.select(F.col(item_col).alias("item"), F.array_distinct(F.regexp_extract_all(low, F.lit(f"({TERM})"), F.lit(1))).alias("terms"))
    return materialise(found.filter(F.size("terms") > 0).withColumn("query", F.monotonically_increasing_id()), "search-queries")


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id", batch_terms: int = BATCH_TERMS) -> DataFrame:
    """item, rank, id, score: the k best documents of the index for each item."""
    queries = query_terms(items, item_col, text_col)
    total = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    batches = max(1, -(-total // batch_terms))
    found = None
    for b in range(batches):
        part = queries.filter(F.pmod(F.xxhash64("query"), F.lit(batches)) == b) if batches > 1 else queries
        some = _search_batch(index, n_docs, part, k)
        found = some if found is None else found.unionByName(some)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("id"), "shard", "place"))).filter(F.col("rank") <= k)
    names = queries.select("query", "item")
    return ranked.join(F.broadcast(names) if total <= BATCH_TERMS else names, "query").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search_batch(index: DataFrame, n_docs: int, queries: DataFrame, k: int) -> DataFrame:
    """query, id, score, shard, place: the k best of every shard."""
    spark = index.sparkSession
    asked = materialise(queries.select(F.explode("terms").alias("term")).distinct(), "search-terms")
    weights = index.join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("df").alias("df")).select("term", F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("bigint").alias("w"))
    weight = {r["term"]: r["w"] for r in weights.collect()}  # BATCH_TERMS at most, but for a longer single query
    listed = [(r["query"], [t for t in r["terms"] if weight.get(t, 0) > 0]) for r in queries.select("query", "terms").toLocalIterator()]
    shared = spark.sparkContext.broadcast((listed, weight))

    def run(key, table):
        import pyarrow as pa

        listed, weight = shared.value
        terms, lists, ids, null = table["term"].to_pylist(), {}, None, None
        for i, term in enumerate(terms):
            get = lambda c, i=i: table[c][i].as_py()
            if term == "":
                ids, null = np.frombuffer(get("docs"), "<i8"), np.frombuffer(get("impacts"), np.uint8) > 0
        small = np.uint16 if len(ids) <= 1 << 16 else np.uint32
        for term, docs, impacts, ends, maxima in zip(terms, *(table[c].to_pylist() for c in ("docs", "impacts", "ends", "maxima")), strict=True):
            if term:
                lists[term] = Posting(np.frombuffer(docs, small), np.frombuffer(impacts, np.uint32), np.frombuffer(ends, small), np.frombuffer(maxima, np.uint32))
        scratch, out = np.zeros(len(ids), np.int64), []
        for query, asked_terms in listed:
            here = [t for t in asked_terms if t in lists]
            if here:
                docs, scores = best_of_shard([lists[t] for t in here], [weight[t] for t in here], ids, null, k, scratch)
                out.append((np.full(len(docs), query), docs, scores))
        query, docs, scores = (np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(3))
        spare()
        return pa.table({"query": pa.array(query, pa.int64()), "id": pa.array(ids[docs], pa.int64(), mask=null[docs]), "score": pa.array(scores, pa.int64()), "shard": pa.array([key[0].as_py()] * len(docs), pa.string()), "place": pa.array(docs, pa.int64())})

    wanted = index.join(F.broadcast(asked.unionByName(spark.createDataFrame([("",)], "term string"))), "term")
    return wanted.groupBy("shard").applyInArrow(run, "query bigint, id bigint, score bigint, shard string, place bigint")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item, rank, id, score of each item's k best documents, over an index of docs built for this call."""
    index, n_docs = build_index(docs, id_col, text_col)
    found = materialise(search(index, n_docs, items, k, item_col, text_col, id_col), "search-results")
    discard(index)
    return found
