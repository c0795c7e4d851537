"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word's input joins an embedding of the word (of a bounded training vocabulary, else of none) and the mean embedding of
its character n-grams (of 3 and 6 bytes, word ends marked). Two GRUs read a window of WINDOW words forwards and
backwards, attention pools their states, a logistic output scores the window. All windows, each STEP words after the
other, are scored; a document's score is its highest.

Training: a document is toxic if one of its windows is, so after a few steps on all windows with their document's label
only each document's highest window is learned. The sample's windows are first spread evenly over each document; then
executors score every window of the sampled documents and hand back the highest. Words start from their smoothed log
odds; words are left out at random so that characters count; the weights used are a running mean, stopped where the loss
of a fifth of the sample, which is never learned, is least; the output's offset is where F1 on that fifth, at the
labels' rate in the corpus, is greatest.

Defined results: null text counts as empty; a text without words is one empty window. Training uses at most TRAIN_DOCS whole
documents of at most TRAIN_BYTES with non-null labels, evenly over the labels. Without labels every score is 0; with one label only, that
label. Null or repeated ids keep a row each; columns beside id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import discard
from marginalia.llm.textkernel import HashTable, ascii_words, buffers, pieces, ragged, spare, span_hashes
from marginalia.llm.training import Adam, balanced_ids, labelled_texts, remainder, sample_table, sigmoid

WINDOW, STEP = 32, 24
#: Bounds of the training sample (documents, windows of each that a phase learns from, bytes of whole texts) and of the vocabulary.
TRAIN_DOCS, TRAIN_WINDOWS, TRAIN_BYTES, VOCABULARY, LEAST_DOCS = 1600, 16, 1 << 25, 8192, 3
WORD, CHAR, HIDDEN, ATTEND, GRAM_BITS = 6, 10, 8, 8, 14
#: Bytes of the character n-grams.
ORDERS = (3, 6)
CHUNK = 1 << 19
#: Steps on all windows, on the highest of the even ones, and on the highest of all; windows of a step.
STEPS, BATCH, RATE, DECAY = (40, 60, 200), 256, 0.015, 1e-3
#: Share of words left out of a step; weight of a label's rate (1: balanced, 0: as in the sample); pseudo-documents of the log odds.
DROP, BALANCE, PRIOR = 0.3, 0.5, 2.0


# --- inputs
class Words:
    """The words of texts: their bytes, distinct forms, and of each word the text and the number of its form."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.data, starts, ends, self.text = ascii_words(raw, off)
        # marks around a word are not part of it
        edge = _PUNCTUATION[self.data]
        for _ in range(3):
            starts = starts + (edge[starts] & (starts < ends - 1)) if len(starts) else starts
            ends = ends - (edge[ends - 1] & (starts < ends - 1)) if len(ends) else ends
        keys = span_hashes(self.data, starts, ends)
        self.keys, first, self.form = np.unique(keys, return_index=True, return_inverse=True)
        self.starts, self.ends = starts[first], ends[first]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """N-gram buckets of all forms with their ends marked, form by form, and how many each has."""
        n = self.ends - self.starts
        size = n + 2
        begin = np.cumsum(size) - size
        marked = np.zeros(int(size.sum()), np.uint32)
        marked[begin], marked[begin + size - 1] = 1, 2
        marked[ragged(begin + 1, n)] = self.data[ragged(self.starts, n)]
        form = np.repeat(np.arange(len(n)), size)
        last, at, h = (begin + size)[form], np.arange(len(marked)), np.zeros(len(marked), np.uint32)
        buckets, forms = [], []
        for k in range(1, max(ORDERS) + 1):
            ahead = np.zeros(len(marked), np.uint32)
            ahead[: max(len(marked) - k + 1, 0)] = marked[k - 1 :]
            h = (h ^ ahead) * np.uint32(0x01000193) + np.uint32(k)
            if k in ORDERS:
                whole = at + k <= last
                buckets.append((h[whole] * np.uint32(0x9E3779B1) >> np.uint32(32 - GRAM_BITS)).astype(np.int64))
                forms.append(form[whole])
        of = np.concatenate(forms)
        return np.concatenate(buckets)[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(n))


_PUNCTUATION = np.zeros(256, np.int64)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1


def windows(words_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of every window of texts of so many words, and each text's bounds in windows."""
    each = np.maximum(-(-np.maximum(words_of - (WINDOW - STEP), 1) // STEP), 1)
    bounds = np.concatenate([[0], np.cumsum(each)])
    text = np.repeat(np.arange(len(words_of)), each)
    rank = np.arange(bounds[-1]) - bounds[text]
    base = np.cumsum(words_of) - words_of
    return base[text] + rank * STEP, np.clip(words_of[text] - rank * STEP, 0, WINDOW), bounds


# --- the network
def fresh(vocabulary: int, seed: int = 9) -> dict[str, np.ndarray]:
    r = np.random.RandomState(seed)
    normal = lambda *s, scale=1.0: (r.randn(*s) * scale).astype(np.float32)
    p = {"ew": normal(vocabulary + 1, WORD, scale=0.1), "ec": normal(1 << GRAM_BITS, CHAR, scale=0.2)}
    for d in "fb":
        p |= {f"x{d}": normal(WORD + CHAR, 3 * HIDDEN, scale=0.4), f"b{d}": np.zeros(3 * HIDDEN, np.float32), f"h{d}": normal(HIDDEN, 3 * HIDDEN, scale=0.3)}
    return p | {"a": normal(2 * HIDDEN, ATTEND, scale=0.4), "v": normal(ATTEND, scale=0.4), "o": normal(2 * HIDDEN, scale=0.3), "c": np.zeros(1, np.float32)}


def gru(x: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (T, B, H) of a GRU over projected inputs x (T, B, 3H: reset, update, candidate); masked steps carry the state on."""
    steps, batch, _ = x.shape
    h, out, tape = np.zeros((batch, HIDDEN), np.float32), np.empty((steps, batch, HIDDEN), np.float32), []
    for t in range(steps):
        g = h @ u
        rz = 1 / (1 + np.exp(-(x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])))
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        n = np.tanh(x[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        new = np.where(mask[t][:, None], new, h)
        if keep:
            tape.append((h, r, z, n, g[:, 2 * HIDDEN :]))
        h = new
        out[t] = h
    return out, tape


def gru_back(d_out: np.ndarray, u: np.ndarray, mask: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u."""
    steps, batch, _ = d_out.shape
    d_x, d_u, d_h = np.zeros((steps, batch, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((batch, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, r, z, n, gn = tape[t]
        d = d_h + d_out[t]
        on = mask[t][:, None]
        live = np.where(on, d, 0)
        d_n = live * (1 - z) * (1 - n * n)
        d_z = live * (h - n) * z * (1 - z)
        d_r = d_n * gn * r * (1 - r)
        d_g = np.concatenate([d_r, d_z, d_n * r], 1)
        d_x[t] = np.concatenate([d_r, d_z, d_n], 1)
        d_u += h.T @ d_g
        d_h = np.where(on, live * z, d) + d_g @ u.T
    return d_x, d_u


def score_windows(p: dict, project: dict, form: np.ndarray, first: np.ndarray, length: np.ndarray, keep: bool = False):
    """Logits of windows of word forms; project: inputs of each form already multiplied by the GRUs' weights."""
    steps = max(int(length.max()) if len(length) else 0, 1)
    mask = np.arange(steps)[:, None] < length[None]
    at = np.where(mask, first[None] + np.arange(steps)[:, None], 0)
    number = np.where(mask, form[at], 0) if len(form) else np.zeros_like(at)
    if not len(project["f"]):
        project = {d: np.zeros((1, 3 * HIDDEN), np.float32) for d in "fb"}
    hf, tf = gru(project["f"][number], p["hf"], mask, keep)
    hb, tb = gru(project["b"][number[::-1]], p["hb"], mask[::-1], keep)
    h = np.concatenate([hf, hb[::-1]], 2)
    t = np.tanh(h @ p["a"])
    e = np.where(mask, t @ p["v"], -1e9)
    weight = np.exp(e - e.max(0)) * mask
    weight = weight / np.maximum(weight.sum(0), 1e-9)
    rep = (h * weight[:, :, None]).sum(0)
    logit = rep @ p["o"] + p["c"][0]
    return logit, (mask, number, h, t, weight, rep, tf, tb)


def embed(p: dict, known: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Inputs of word forms: numbers in the vocabulary (0: none), their n-grams and how many."""
    begin = np.cumsum(n) - n
    mean = np.add.reduceat(p["ec"][grams], begin, axis=0) / n[:, None] if len(n) else np.zeros((0, CHAR), np.float32)
    return np.concatenate([p["ew"][known] * (known > 0)[:, None], mean], 1).astype(np.float32)


def projected(p: dict, x: np.ndarray) -> dict:
    return {d: x @ p[f"x{d}"] + p[f"b{d}"] for d in "fb"}


def gradients(p: dict, known: np.ndarray, grams: np.ndarray, n: np.ndarray, form: np.ndarray, first: np.ndarray, length: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Loss and gradients of all parameters for a batch of windows."""
    x = embed(p, known, grams, n)
    logit, (mask, number, h, t, att, rep, tf, tb) = score_windows(p, projected(p, x), form, first, length, True)
    prob = sigmoid(logit)
    loss = float(-(weight * np.where(y > 0, np.log(prob + 1e-9), np.log(1 - prob + 1e-9))).sum())
    d = ((prob - y) * weight).astype(np.float32)
    g = {"o": rep.T @ d, "c": np.array([d.sum()], np.float32)}
    d_rep = d[:, None] * p["o"]
    d_att = (h * d_rep[None]).sum(2)
    d_e = att * (d_att - (att * d_att).sum(0))
    d_t = d_e[:, :, None] * p["v"] * (1 - t * t)
    g["v"], g["a"] = np.einsum("tb,tba->a", d_e, t), np.einsum("tbh,tba->ha", h, d_t)
    d_h = att[:, :, None] * d_rep[None] + d_t @ p["a"].T
    dxf, g["hf"] = gru_back(d_h[:, :, :HIDDEN], p["hf"], mask, tf)
    dxb, g["hb"] = gru_back(d_h[::-1, :, HIDDEN:], p["hb"], mask[::-1], tb)
    dxb = dxb[::-1]
    d_x = np.zeros_like(x)
    for key, dx in (("f", dxf), ("b", dxb)):
        by_form = np.stack([np.bincount(number[mask], weights=dx[mask][:, j], minlength=len(x)) for j in range(3 * HIDDEN)], 1).astype(np.float32)
        g[f"x{key}"], g[f"b{key}"] = x.T @ by_form, by_form.sum(0)
        d_x += by_form @ p[f"x{key}"].T
    g["ew"] = np.zeros_like(p["ew"])
    np.add.at(g["ew"], known, d_x[:, :WORD] * (known > 0)[:, None])
    spread = np.repeat(d_x[:, WORD:] / n[:, None], n, axis=0)
    g["ec"] = np.stack([np.bincount(grams, weights=spread[:, j], minlength=1 << GRAM_BITS) for j in range(CHAR)], 1).astype(np.float32)
    return loss, g


class Model:
    def __init__(self, params: dict, vocabulary: np.ndarray):
        self.p, self.vocabulary = params, vocabulary
        self.table = None

    def __getstate__(self):
        return self.p, self.vocabulary

    def __setstate__(self, state):
        self.__init__(*state)

    def known(self, keys: np.ndarray) -> np.ndarray:
        """Numbers (from 1) of words in the vocabulary, 0 for others."""
        if self.table is None:
            self.table = HashTable(14)
            self.table.put(self.vocabulary, np.arange(1, len(self.vocabulary) + 1))
        return np.maximum(self.table.get(keys), 0)

    def prepare(self, raw: np.ndarray, off: np.ndarray):
        words = Words(raw, off)
        return words, self.known(words.keys), *words.grams()

    def logits(self, raw: np.ndarray, off: np.ndarray, batch: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of the texts, and each text's bounds in them."""
        words, known, grams, n = self.prepare(raw, off)
        project = projected(self.p, embed(self.p, known, grams, n))
        first, length, bounds = windows(np.bincount(words.text, minlength=len(off) - 1) if len(words.text) else np.zeros(len(off) - 1, np.int64))
        return np.concatenate([score_windows(self.p, project, words.form, first[i : i + batch], length[i : i + batch])[0] for i in range(0, len(first), batch)]), bounds

    def scores(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Highest window score of each text."""
        logits, bounds = self.logits(raw, off)
        return sigmoid(np.maximum.reduceat(logits, bounds[:-1]).astype(np.float64))


class Sample:
    """Documents as windows of words, with labels; held: documents that are scored but never learned."""

    def __init__(self, texts: list[list[bytes]], y: np.ndarray, held: np.ndarray):
        self.y, self.held = y, held
        sizes, flat = np.array([len(t) for t in texts]), [w for t in texts for w in t]
        self.bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        off = np.concatenate([[0], np.cumsum([len(w) for w in flat])]).astype(np.int64)
        self.words = Words(np.frombuffer(b"".join(flat), np.uint8), off)
        self.grams, self.n = self.words.grams()
        self.gram_at = np.cumsum(self.n) - self.n
        per = np.bincount(self.words.text, minlength=len(flat))
        self.first, self.length = np.cumsum(per) - per, np.minimum(per, WINDOW)

    def vocabulary(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the words that LEAST_DOCS documents have at least, and their smoothed log odds of label 1."""
        pairs = np.unique(np.stack([self.words.form, self.doc[self.words.text]]), axis=1)
        held_in = pairs[:, ~self.held[pairs[1]]]
        docs = np.bincount(held_in[0], minlength=len(self.words.keys))
        often = np.flatnonzero(docs >= LEAST_DOCS)
        often = often[np.lexsort((self.words.keys[often], -docs[often]))[:VOCABULARY]]
        toxic = np.bincount(held_in[0], weights=self.y[held_in[1]], minlength=len(self.words.keys))[often]
        ones = float(self.y[~self.held].sum())
        zeros = float((~self.held).sum()) - ones
        odds = np.log((toxic + PRIOR) / (ones + 2 * PRIOR)) - np.log((docs[often] - toxic + PRIOR) / (zeros + 2 * PRIOR))
        return self.words.keys[often], np.clip(odds, -3, 3) / 2

    def known(self, model: Model) -> np.ndarray:
        return model.known(self.words.keys)

    def logits(self, p: dict, known: np.ndarray) -> np.ndarray:
        project = projected(p, embed(p, known, self.grams, self.n))
        return np.concatenate([score_windows(p, project, self.words.form, self.first[i : i + 4096], self.length[i : i + 4096])[0] for i in range(0, len(self.doc), 4096)])


class Trainer:
    """A model in training: its own weights, their running mean, and the best of these so far."""

    def __init__(self, sample: Sample, seed: int = 9):
        keys, odds = sample.vocabulary()
        self.model = Model(fresh(len(keys), seed), keys)
        self.model.p["ew"][1:, 0] = odds
        self.mean = {k: v.copy() for k, v in self.model.p.items()}
        self.adam, self.random, self.done = Adam(self.model.p, RATE, DECAY), np.random.RandomState(seed), 0
        share = np.array([max(float((sample.y[~sample.held] == v).mean()), 1e-9) for v in (0, 1)])
        self.balance = (0.5 / share) ** BALANCE

    def learn(self, s: Sample, known: np.ndarray, chosen: np.ndarray) -> None:
        """One step on some windows."""
        at = ragged(s.first[chosen], s.length[chosen])
        forms, form = np.unique(s.words.form[at], return_inverse=True)
        label = s.y[s.doc[chosen]].astype(np.float32)
        if len(forms):
            kept = known[forms] * (self.random.rand(len(forms)) >= DROP)
            start = np.cumsum(s.length[chosen]) - s.length[chosen]
            weight = self.balance[label.astype(int)] / len(chosen)
            _, g = gradients(self.model.p, kept, s.grams[ragged(s.gram_at[forms], s.n[forms])], s.n[forms], form, start, s.length[chosen], label, weight)
            self.adam.step(g)
        self.done += 1
        a = min(0.95, self.done / (self.done + 9))
        for k, v in self.model.p.items():
            self.mean[k] += (1 - a) * (v - self.mean[k])

    def on_all(self, s: Sample, steps: int) -> None:
        known, mine = s.known(self.model), np.flatnonzero(~s.held[s.doc])
        while steps > 0:
            order = self.random.permutation(mine)
            for low in range(0, min(len(order), steps * BATCH), BATCH):
                self.learn(s, known, order[low : low + BATCH])
                steps -= 1

    def on_highest(self, s: Sample, steps: int) -> tuple[dict, np.ndarray]:
        """Best running mean by the loss of held documents, and the documents' logits with it."""
        known, best, left = s.known(self.model), (np.inf, self.mean, np.zeros(0)), steps
        while True:
            logits = s.logits(self.mean, known)
            top = np.maximum.reduceat(logits, s.bounds[:-1])
            weight, p = self.balance[s.y[s.held]], sigmoid(top[s.held])
            loss = float(-(weight * np.where(s.y[s.held] > 0, np.log(p + 1e-6), np.log(1 - p + 1e-6))).sum())
            if loss < best[0] or not len(best[2]):
                best = (loss, {k: v.copy() for k, v in self.mean.items()}, top)
            if left <= 0:
                return best[1], best[2]
            self.adam.rate = RATE if left > steps * 0.4 else RATE / 4
            highest = np.array([a + int(logits[a:b].argmax()) for a, b in zip(s.bounds[:-1], s.bounds[1:], strict=True)])
            order = self.random.permutation(highest[~s.held])
            for low in range(0, len(order), BATCH // 2):
                self.learn(s, known, order[low : low + BATCH // 2])
                left -= 1


def offset(top: np.ndarray, y: np.ndarray, rate: float) -> float:
    """The logit where F1 is greatest when label 1 has this rate: the middle of the best cuts, 0 with too few documents."""
    if min((y == 0).sum(), (y == 1).sum()) < 5:
        return 0.0
    weight = np.where(y == 1, rate / (y == 1).mean(), (1 - rate) / (y == 0).mean())
    order = np.argsort(-top, kind="stable")
    caught, flagged = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * caught / (flagged + (weight * y).sum())
    sorted_ = top[order]
    cuts = np.append((sorted_[1:] + sorted_[:-1]) / 2, sorted_[-1] - 1)
    real = np.append(sorted_[1:] < sorted_[:-1], True)
    return float(np.median(cuts[real & (f1 >= f1[real].max() - 1e-12)]))


def fit(texts: list[list[bytes]], y: np.ndarray, rate: float | None = None, held: np.ndarray | None = None, again=None, seed: int = 9) -> Model:
    """Train on documents given as windows of words, with their labels.

    rate: label 1's rate in the corpus (that of the sample if None). held: documents to stop and cut by (a fifth of each
    label if None). again(model): a second sample (texts, labels, held) of the highest of all windows, if given.
    """
    if held is None:
        held, order = np.zeros(len(y), bool), np.random.RandomState(seed).permutation(len(y))
        for v in (0, 1):
            own = order[y[order] == v]
            held[own[: len(own) // 5]] = True
    if not held.any() or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    sample = Sample(texts, y, held)
    trainer = Trainer(sample, seed)
    trainer.on_all(sample, STEPS[0])
    best, top = trainer.on_highest(sample, STEPS[1])
    if again is not None:
        texts, y, held_ = again(Model(best, trainer.model.vocabulary))
        sample = Sample(texts, y, held_ if held.any() and len(set(y[~held_])) == 2 else np.zeros(len(y), bool))
    best, top = trainer.on_highest(sample, STEPS[2])
    if sample.held.any():
        best["c"] = best["c"] - np.float32(offset(top[sample.held], sample.y[sample.held], float(sample.y.mean()) if rate is None else rate))
    return Model(best, trainer.model.vocabulary)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_DOCS, held_in=None) -> Model | float:
    """A model, or the constant score where labels cannot tell. labels(id, label): of repeated ids the highest label counts."""
    held = labels.filter(remainder(id_col, 5) != 0 if held_in is None else held_in).groupBy(id_col).agg(F.max(label).alias("y")).na.drop()
    chosen = balanced_ids(held, "y", most, id_col)
    if len({y for _, y in chosen}) < 2:
        return float(chosen[0][1]) if chosen else 0.0
    rate = held.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    found = sample_table(labelled_texts(docs, chosen, id_col, text_col, docs.schema[id_col].dataType.simpleString()), most, TRAIN_BYTES)

    def sample(model: Model | None) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
        """Windows of the sampled documents: spread evenly, or with a model the highest of all."""

        def rows(batches):
            import pyarrow as pa

            for batch in batches:
                raw, off = buffers(batch["text"])
                for i, (key, y) in enumerate(zip(batch["id"].to_pylist(), batch["y"].to_pylist(), strict=True)):
                    data, starts, ends, _ = ascii_words(raw, off[i : i + 2])
                    first, length, _ = windows(np.array([len(starts)]))
                    if model is None:
                        use = np.unique(np.linspace(0, len(first) - 1, min(len(first), TRAIN_WINDOWS)).astype(int))
                    else:
                        use = np.sort(np.argsort(-model.logits(raw, off[i : i + 2])[0], kind="stable")[:TRAIN_WINDOWS])
                    parts = [data[starts[first[j]] : ends[first[j] + length[j] - 1]].tobytes() if length[j] else b"" for j in use]
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([y], pa.int32()), pa.array([parts], pa.list_(pa.binary()))], ["id", "y", "parts"])

        got = sorted((r["id"], r["y"], [bytes(x) for x in r["parts"]]) for r in found.mapInArrow(rows, "id bigint, y int, parts array<binary>").collect())
        return [t for _, _, t in got], np.array([y for _, y, _ in got]), np.array([i % 5 == 0 for i, _, _ in got], bool)

    texts, y, aside = sample(None)
    if len(set(y)) < 2:
        return float(y[0]) if len(y) else 0.0
    model = fit(texts, y, rate, aside, sample)
    discard(found)
    return model


def scores(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every whole text; the model travels with the task (under 1 MB)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = np.full(batch.num_rows, model if isinstance(model, float) else 0.0)
            if not isinstance(model, float):
                raw, off = buffers(batch[1])
                for a, b in pieces(np.diff(off), CHUNK):
                    out[a:b] = model.scores(raw, off[a : b + 1])
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(out, pa.float64())], ["id", "score"])
        spare()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Train on held-in labels and score every document: id, held_out, score, predicted."""
    out = scores(docs, train(docs, labels, "toxic", id_col, text_col), id_col, text_col)
    return out.select(id_col, (remainder(id_col, 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
