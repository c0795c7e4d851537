"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded from learned embeddings of its byte trigrams
and from shares of character kinds; gated attention, learned from document labels alone, weighs the
passages, and the weighted representation of the whole document is scored.

Defined results: null text counts as empty; a text without words is one empty passage and gets a score like any other.
Training uses at most TRAIN_DOCS documents with non-null labels, as many of each label as there are up to half of them, and whole:
texts are taken in a fixed order up to TRAIN_BYTES in all, and every passage of them is learned. With one
label only every score is that label (0 or 1), without any it is 0.5. The balanced sample is weighted half way back (by
the square root) to the counts of all held-in labels. Null or repeated ids keep a row each; columns beside id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import discard
from marginalia.llm.textkernel import ascii_words, buffers, mix, pieces, spare, span_hashes
from marginalia.llm.training import Adam, balanced_ids, labelled_texts, remainder, sample_table, sigmoid

#: Words of a passage.
PASSAGE = 48
#: Bounds of the training sample: documents, and bytes of their whole texts.
TRAIN_DOCS, TRAIN_BYTES = 1600, 1 << 24
BUCKETS, EMBED, HIDDEN, ATTEND = 4096, 12, 12, 8
#: Bytes of text scored at once.
CHUNK = 1 << 19
#: SCALE brings mean embeddings to the range of the shares; DECAY keeps single trigrams from deciding.
EPOCHS, BATCH, RATE, SCALE, DECAY = 8, 64, 0.02, 4, 1e-3

_KINDS = np.zeros((256, 8), np.float32)
_KINDS[65:91, 0] = 1  # upper case
_KINDS[97:123, 1] = 1  # lower case
_KINDS[48:58, 2] = 1  # digits
for _c in b".,;:!?'\"()-":
    _KINDS[_c, 3] = 1  # punctuation
for _c in b"!#$%&*+/<=>@[\\]^_`{|}~":
    _KINDS[_c, 4] = 1  # symbols
for _c in b" \t\n\r\x0b\x0c":
    _KINDS[_c, 5] = 1
_KINDS[10, 6] = 1  # line ends
_KINDS[128:, 7] = 1
STATS = _KINDS.shape[1] + 3


def passages(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of all passages in the bytes from off[0] on, each text's bounds in passages, and each passage's share of distinct words."""
    lower, starts, ends, text = ascii_words(raw, off)
    base = off - off[0]
    n_texts = len(off) - 1
    words = np.bincount(text, minlength=n_texts) if len(text) else np.zeros(n_texts, np.int64)
    first_word = np.cumsum(words) - words
    rank = np.arange(len(starts)) - first_word[text] if len(starts) else np.zeros(0, np.int64)
    opens = np.flatnonzero(rank % PASSAGE == 0)
    each = np.maximum(-(-words // PASSAGE), 1)
    bounds = np.concatenate([[0], np.cumsum(each)])
    begin = np.repeat(base[:-1], each)
    begin[bounds[text[opens]] + rank[opens] // PASSAGE] = starts[opens]
    begin[bounds[:-1]] = base[:-1]  # what stands before the first word belongs to the first passage
    end = np.append(begin[1:], base[-1])
    last = bounds[1:] - 1
    end[last] = base[1:]
    distinct = np.ones(len(begin), np.float32)
    if len(starts):
        home = bounds[text] + rank // PASSAGE
        marks = mix(home.astype(np.uint64)) ^ span_hashes(lower, starts, ends)
        _, first = np.unique(marks, return_index=True)
        all_words = np.bincount(home, minlength=len(begin))
        distinct = np.where(all_words > 0, np.bincount(home[first], minlength=len(begin)) / np.maximum(all_words, 1), 1).astype(np.float32)
    return begin, end, bounds, distinct


def trigrams(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts at each byte, zeros beyond the end of its span; the spans lie one after the other."""
    first = data.astype(np.uint32)
    second, third = np.zeros_like(first), np.zeros_like(first)
    second[:-1], third[:-2] = first[1:], first[2:]
    last = end[end > begin] - 1
    second[last], third[last] = 0, 0
    third[end[end > begin + 1] - 2] = 0
    h = (first * np.uint32(0x01000193) ^ second) * np.uint32(0x01000193) ^ third
    h = h * np.uint32(0x9E3779B1)
    return (h >> np.uint32(20)).astype(np.int64)


def span_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums over [begin, end) of consecutive spans; zero for empty ones."""
    out = np.zeros((len(begin), values.shape[1]), np.float32)
    full = np.flatnonzero(end > begin)
    if len(full):
        out[full] = np.add.reduceat(values, begin[full], axis=0)
    return out


def stats_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    size = np.maximum(end - begin, 1)[:, None]
    shares = span_sums(_KINDS[data], begin, end) / size
    return np.concatenate([shares, np.log1p(size) / 8, size / np.maximum(shares[:, 5:6] * size, 1) / 16, 4 * distinct[:, None]], 1).astype(np.float32)


def fresh(seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.RandomState(seed)
    shape = {"e": (BUCKETS, EMBED), "w": (EMBED + STATS, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, ATTEND), "u": (HIDDEN, ATTEND), "a": (ATTEND,), "o": (HIDDEN,), "c": (1,)}
    return {k: (r.randn(*s) * (0.3 / np.sqrt(s[0] if len(s) > 1 and k != "e" else 1) if k != "c" else 0)).astype(np.float32) for k, s in shape.items()}


def forward(p: dict, x: np.ndarray, bounds: np.ndarray) -> dict:
    """Bags of encoded inputs x (mean embedding beside stats) to document scores; bounds: each bag's passages."""
    h = np.tanh(x @ p["w"] + p["b"])
    t, s = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
    z = (t * s) @ p["a"]
    bag = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    top = np.maximum.reduceat(z, bounds[:-1])
    e = np.exp(z - top[bag])
    weight = e / np.add.reduceat(e, bounds[:-1])[bag]
    rep = np.add.reduceat(h * weight[:, None], bounds[:-1], axis=0)
    return {"x": x, "h": h, "t": t, "s": s, "w": weight, "rep": rep, "bag": bag, "logit": rep @ p["o"] + p["c"][0]}


def backward(p: dict, f: dict, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters but e, and of x."""
    d_rep = d_logit[:, None] * p["o"]
    d_h = f["w"][:, None] * d_rep[f["bag"]]
    d_w = (f["h"] * d_rep[f["bag"]]).sum(1)
    mean = np.bincount(f["bag"], weights=f["w"] * d_w, minlength=len(d_logit)).astype(np.float32)
    d_z = f["w"] * (d_w - mean[f["bag"]])
    d_t, d_s = d_z[:, None] * p["a"] * f["s"] * (1 - f["t"] ** 2), d_z[:, None] * p["a"] * f["t"] * f["s"] * (1 - f["s"])
    d_h = d_h + d_t @ p["v"].T + d_s @ p["u"].T
    d_a = d_h * (1 - f["h"] ** 2)
    grads = {"w": f["x"].T @ d_a, "b": d_a.sum(0), "v": f["h"].T @ d_t, "u": f["h"].T @ d_s, "a": (f["t"] * f["s"]).T @ d_z, "o": f["rep"].T @ d_logit, "c": np.array([d_logit.sum()], np.float32)}
    return grads, d_a @ p["w"].T


def fit(bags: list[list[tuple[np.ndarray, np.ndarray]]], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> dict:
    """Parameters from bags of passages (trigram buckets, stats), labels and the documents' weights."""
    p = fresh(seed)
    adam, r = Adam(p, RATE, DECAY), np.random.RandomState(seed)
    for _ in range(epochs):
        order = r.permutation(len(bags))
        for low in range(0, len(order), BATCH):
            some = order[low : low + BATCH]
            sizes = np.array([len(bags[i]) for i in some])
            flat = [x for i in some for x in bags[i]]
            grams = np.concatenate([g for g, _ in flat])
            lengths = np.array([len(g) for g, _ in flat])
            begin = np.cumsum(lengths) - lengths
            count = np.maximum(lengths, 1)[:, None]
            mean = span_sums(p["e"][grams], begin, begin + lengths) / count
            f = forward(p, np.concatenate([mean * SCALE, np.stack([s for _, s in flat])], 1), np.concatenate([[0], np.cumsum(sizes)]))
            d = ((sigmoid(f["logit"]) - y[some]) * weight[some] / len(some)).astype(np.float32)
            grads, d_x = backward(p, f, d)
            d_e = np.repeat(d_x[:, :EMBED] * SCALE / count, lengths, axis=0)
            grads["e"] = np.stack([np.bincount(grams, weights=d_e[:, j], minlength=BUCKETS) for j in range(EMBED)], 1).astype(np.float32)
            adam.step(grads)
    return p


def score_batch(p: dict, column) -> np.ndarray:
    """Scores of an Arrow column of whole texts; every passage counts."""
    raw, off = buffers(column)
    out = np.zeros(len(off) - 1)
    for a, b in pieces(np.diff(off), CHUNK):
        data = raw[off[a] : off[b]]
        begin, end, bounds, distinct = passages(raw, off[a : b + 1])
        # a very long text is embedded in runs of whole passages
        mean = np.zeros((len(begin), EMBED), np.float32)
        stats = np.zeros((len(begin), STATS), np.float32)
        for i, j in pieces(end - begin, CHUNK):
            part = data[begin[i] : end[j - 1]]
            buckets = trigrams(part, begin[i:j] - begin[i], end[i:j] - begin[i])
            mean[i:j] = span_sums(p["e"][buckets], begin[i:j] - begin[i], end[i:j] - begin[i]) / np.maximum(end[i:j] - begin[i:j], 1)[:, None]
            stats[i:j] = stats_of(part, begin[i:j] - begin[i], end[i:j] - begin[i], distinct[i:j])
        out[a:b] = sigmoid(forward(p, np.concatenate([mean * SCALE, stats], 1), bounds)["logit"])
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_DOCS, held_in=None, most_bytes: int = TRAIN_BYTES) -> dict | float:
    """Parameters, or the constant score where labels cannot tell. labels(id, label): of repeated ids the lowest label counts."""
    held = labels.filter(remainder(id_col, 5) != 0 if held_in is None else held_in).groupBy(id_col).agg(F.min(label).alias("y"))
    counts = {int(r["y"]): r["count"] for r in held.na.drop().groupBy("y").count().collect()}
    if len(counts) < 2:
        return float(next(iter(counts))) if counts else 0.5
    chosen = balanced_ids(held, "y", most, id_col)
    found = sample_table(labelled_texts(docs, chosen, id_col, text_col, docs.schema[id_col].dataType.simpleString()), most, most_bytes)

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            raw, off = buffers(batch["text"])
            for i, (key, y) in enumerate(zip(batch["key"].to_pylist(), batch["y"].to_pylist(), strict=True)):
                data = raw[off[i] : off[i + 1]]
                begin, end, _, distinct = passages(raw, off[i : i + 2])
                grams, stats = trigrams(data, begin, end).astype(np.uint16), stats_of(data, begin, end, distinct)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([y], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (grams, (end - begin).astype(np.int64), stats)]], ["key", "y", "grams", "sizes", "stats"])

    sample = sorted(tuple(r) for r in found.select("key", "y", "text").mapInArrow(rows, "key bigint, y int, grams binary, sizes binary, stats binary").collect())
    discard(found)
    if len({v for _, v, *_ in sample}) < 2:
        return float(sample[0][1]) if sample else 0.5
    bags = []
    for _, _, grams, sizes, stats in sample:
        ends = np.cumsum(np.frombuffer(sizes, np.int64))
        bags.append(list(zip(np.split(np.frombuffer(grams, np.uint16), ends[:-1]), np.frombuffer(stats, np.float32).reshape(-1, STATS), strict=True)))
    y = np.array([v for _, v, *_ in sample], np.float32)
    share = {v: (y == v).mean() for v in (0, 1)}
    total = sum(counts.values())
    # half way between the sample's balance and the corpus': rare labels keep a say
    weight = np.array([np.sqrt(counts.get(int(v), 1) / total / share[int(v)]) for v in y], np.float32)
    return fit(bags, y, weight / weight.mean())


def scores(docs: DataFrame, params: dict | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every whole text; the parameters travel with the task (about 200 KB)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = np.full(batch.num_rows, params) if isinstance(params, float) else score_batch(params, batch[1])
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(got, pa.float64())], ["id", "score"])
        spare()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Train on held-in labels and score every document: id, held_out, score, predicted."""
    out = scores(docs, train(docs, labels, "quality", id_col, text_col), id_col, text_col)
    return out.select(id_col, (remainder(id_col, 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
