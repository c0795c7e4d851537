"""Language identification in two steps: the family first, then one-versus-one linear support vector machines in it.

Features are shares of hashed letter 1- to 3-grams of the whole text (lower-cased; everything but letters is a gap).
The score is the share of the votes won times the share of the text's letters that the sample has, so a foreign script
scores low.
Families come from a fixed table of language codes; a code it does not have is a family of its own. One linear SVM for each
family against the others chooses the family; one for each pair of its languages votes within it.

Defined results: null text or text without a letter gives ``und`` with score 1. Training uses at most TRAIN_DOCS held-in
documents with a non-null label, evenly over the languages; without any, every text gives ``und`` with score 0. Null or
repeated ids keep a row each; columns beside id, text and (for training) lang are not read. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import discard, without
from marginalia.llm.textkernel import LETTER, classes_of, code_points, pieces, slices, spare
from marginalia.llm.training import balanced_ids, labelled_texts, remainder, sample_table, sigmoid

#: Documents that the classifier is fitted on, at most: the bound of its sample.
TRAIN_DOCS = 1600
#: Buckets of each order of n-grams.
BUCKETS, ORDERS = 4096, 3
#: Language codes by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("hi", "bn", "mr", "pa", "ur"),
}
UNKNOWN = "und"


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-cased texts joined (one row per order), each text's bounds in them, and their letters (32: a gap)."""
    points, off = code_points(texts)
    letters = np.where(classes_of(points) == LETTER, points, 32).astype(np.uint32) if len(points) else points
    gap = np.zeros(len(letters), bool)
    gap[1:] = (letters[1:] == 32) & (letters[:-1] == 32)
    gap[off[:-1][off[:-1] < len(gap)]] = False  # a text does not depend on the one before it in the batch
    keep = ~gap
    place = np.concatenate([[0], np.cumsum(keep)])
    x, off = letters[keep].astype(np.uint64), place[off]
    out, h, left = np.zeros((ORDERS, len(x)), np.int64), np.zeros(len(x), np.uint64), np.repeat(off[1:], np.diff(off)) - np.arange(len(x))
    with np.errstate(over="ignore"):
        for k in range(ORDERS):
            ahead = np.full(len(x), 32, np.uint64)
            ahead[: len(x) - k] = x[k:]
            ahead[left <= k] = 32  # nor on the one after it
            h = (h + ahead + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            out[k] = (h & np.uint64(BUCKETS - 1)).astype(np.int64) + k * BUCKETS
    return out, off, x


def _spans_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values over [off[i], off[i+1]), zero for empty spans."""
    out = np.zeros((len(off) - 1, values.shape[1]), np.float64)
    full = np.flatnonzero(np.diff(off) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, off[full], axis=0, dtype=np.float64)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 3) -> np.ndarray:
    """Weights (the last one the bias) of a linear SVM with squared hinge loss, by dual coordinate descent. y: 1 or -1."""
    n = len(x)
    w, alpha, half = np.zeros(x.shape[1] + 1), np.zeros(n), 0.5 / c
    q = (x * x).sum(1) + 1 + half
    rng = np.random.RandomState(seed)
    for _ in range(epochs):
        for i in rng.permutation(n):
            g = y[i] * (x[i] @ w[:-1] + w[-1]) - 1 + half * alpha[i]
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[:-1] += step * x[i]
                w[-1] += step
                alpha[i] = new
    return w


class Model:
    """Linear outputs: one for each family (none when there is one family), then one for each pair of languages of a family.

    letters: the code points of letters that the sample has. chance: the least score that a text of these letters can
    have, whatever the outputs: even families, even votes.
    """

    def __init__(self, langs: list[str], weights: np.ndarray, letters: np.ndarray):
        self.langs, self.weights, self.letters = langs, weights.astype(np.float32), letters
        self.families = sorted({family_of(x) for x in langs})
        self.members = {f: [x for x in langs if family_of(x) == f] for f in self.families}
        self.pairs = [(f, a, b) for f in self.families for a, b in combinations(self.members[f], 2)]
        self.chance = (0.5 if self.pairs else 1.0) / max(len(self.families), 1)

    @classmethod
    def fit(cls, x: np.ndarray, y: list[str], letters: np.ndarray) -> Model:
        langs = sorted(set(y))
        model, y = cls(langs, np.zeros((x.shape[1] + 1, 0)), letters), np.array(y)
        of = np.array([family_of(v) for v in y])
        columns = [fit_svm(x, np.where(of == f, 1, -1)) for f in model.families] if len(model.families) > 1 else []
        for _, a, b in model.pairs:
            own = (y == a) | (y == b)
            columns.append(fit_svm(x[own], np.where(y[own] == a, 1, -1)))
        return cls(langs, np.stack(columns, 1) if columns else np.zeros((x.shape[1] + 1, 0)), letters)

    def predict(self, out: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score for each row of linear outputs."""
        n, f = len(out), len(self.families)
        first = f if f > 1 else 0
        margins = out[:, :first] if first else np.zeros((n, 1))
        chosen = margins.argmax(1)
        soft = np.exp(2 * (margins - margins.max(1, keepdims=True)))
        sure = soft.max(1) / soft.sum(1)
        langs, scores = [""] * n, np.zeros(n)
        for k, family in enumerate(self.families):
            own, members = np.flatnonzero(chosen == k), self.members[family]
            votes = np.zeros((len(own), len(members)))
            for j, (g, a, b) in enumerate(self.pairs):
                if g == family:
                    p = sigmoid(2 * out[own, first + j])
                    votes[:, members.index(a)] += p
                    votes[:, members.index(b)] += 1 - p
            best = votes.argmax(1) if len(own) else []
            for i, row in enumerate(own):
                langs[row] = members[best[i]]
                scores[row] = sure[row] * (votes[i, best[i]] / (len(members) - 1) if len(members) > 1 else 1.0)
        return langs, scores

    def outputs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Linear outputs of whole texts, and the share of their letters that the sample has (-1 without a letter)."""
        lowered = [t.lower() for t in texts]
        out, known = np.zeros((len(texts), self.weights.shape[1])), np.full(len(texts), -1.0)
        for a, b in pieces(np.array([len(t) for t in lowered], np.int64)):
            hashed, off, x = grams(lowered[a:b])
            total = np.zeros((b - a, self.weights.shape[1]))
            for k in range(ORDERS):
                total += _spans_sum(self.weights[hashed[k]], off)
            out[a:b] = SCALE * total / np.maximum(np.diff(off), 1)[:, None] + self.weights[-1]
            letter = x != 32
            ours = letter & (self.letters[np.minimum(np.searchsorted(self.letters, x), len(self.letters) - 1)] == x) if len(self.letters) else letter
            n, m = (np.diff(np.concatenate([[0], np.cumsum(v)])[off]) for v in (letter, ours))
            known[a:b] = np.where(n > 0, m / np.maximum(n, 1), -1.0)
        return out, known


#: Shares of n-grams are small; this brings them to the range that the SVMs expect.
SCALE = 20.0


def features(texts: list[str]) -> np.ndarray:
    """Dense features of whole texts."""
    out = np.zeros((len(texts), ORDERS * BUCKETS), np.float32)
    for i, t in enumerate(texts):
        hashed, off, _ = grams([t.lower()])
        if off[-1]:
            out[i] = SCALE * np.bincount(hashed.ravel(), minlength=ORDERS * BUCKETS) / off[-1]
    return out


def train(docs: DataFrame, most: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_in=None) -> Model | None:
    """Fit on a bounded, hash-chosen sample of the held-in documents; executors make the features."""
    held_in = remainder(id_col, 3) != 1 if held_in is None else held_in
    chosen = balanced_ids(docs.filter(held_in & F.col(text_col).isNotNull()), lang_col, most, id_col)
    if not chosen:
        return None
    langs = sorted({y for _, y in chosen})
    sample = sample_table(labelled_texts(docs, [(i, langs.index(y)) for i, y in chosen], id_col, text_col, docs.schema[id_col].dataType.simpleString()), most)

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for y, t in zip(batch["y"].to_pylist(), batch["text"].to_pylist(), strict=True):
                x = features([t or ""])[0]
                at = np.flatnonzero(x)
                own = np.unique(grams([(t or "").lower()])[2]).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([at.astype(np.uint16).tobytes()]), pa.array([x[at].tobytes()]), pa.array([own.tobytes()])], ["y", "at", "x", "letters"])

    found = sorted((r["y"], bytes(r["at"]), bytes(r["x"]), bytes(r["letters"])) for r in sample.mapInArrow(rows, "y int, at binary, x binary, letters binary").collect())
    discard(sample)
    letters = np.unique(np.concatenate([np.frombuffer(r[3], np.uint32) for r in found])).astype(np.uint64) if found else np.zeros(0, np.uint64)
    x = np.zeros((len(found), ORDERS * BUCKETS), np.float32)
    for i, (_, at, v, _) in enumerate(found):
        x[i, np.frombuffer(at, np.uint16)] = np.frombuffer(v, np.float32)
    return Model.fit(x, [langs[y] for y, *_ in found], letters[letters != 32])


def annotate(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score of every whole text, in place of columns of these names.

    The model travels with the task (about 50 KB for each output).
    """
    docs = without(docs, "lang_pred", "lang_score")
    names = [*docs.columns, "lang_pred", "lang_score"]
    at = docs.columns.index(next(c for c in docs.columns if c.lower() == text_col.lower()))

    def run(batches):
        import pyarrow as pa

        for batch in (b for whole in batches for b in slices(whole)):
            texts = batch[at].cast(pa.large_string()).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if model is not None and texts:
                out, known = model.outputs([t or "" for t in texts])
                langs, scores = model.predict(out)
                langs = [x if k >= 0 else UNKNOWN for x, k in zip(langs, known, strict=True)]
                scores = np.where(known >= 0, np.clip(scores * known, 0, 1), 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)
        spare()

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema] + [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every document."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return annotate(own, model).select(F.col("id").alias(id_col), "lang_pred", F.col("lang_score").alias("score"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> DataFrame:
    """Train on the held-in documents and predict every one: id, held_out, lang_pred, score."""
    model = train(docs, most, id_col, text_col, lang_col)
    out = predict(docs, model, id_col, text_col)
    return out.select(id_col, (remainder(id_col, 3) == 1).alias("held_out"), "lang_pred", "score")
