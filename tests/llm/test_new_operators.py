"""Quality rules, ranked search and collocations against brute force, with nulls, empty tables, ties, repeats, clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import collocations, quality_rules, ranked_search
from tests.llm.test_operators import EMPTY, ODD, WORDS, frame, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- quality rules
def counts_of(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    n, rep = len(w), len(covered)
    failed = n < 20 or 100 * rep > 30 * n
    letters = sum(any(c.isalpha() for c in x) for x in w)
    stop = {*quality_rules.STOP_WORDS, *(x[0].upper() + x[1:] for x in quality_rules.STOP_WORDS)}
    share = lambda a, b: a / b if b else None
    symbols = len(re.findall(r"[#*$%&|<>]", t))
    values = {
        "mean_word_chars": share(sum(map(len, w)), n), "symbols_per_word": share(symbols, n), "stop_word_share": share(sum(x in stop for x in w), n), "duplicate_line_share": share(len(lines) - len(set(lines)), len(lines)),
        "letter_word_share": share(letters, n), "ellipsis_line_share": share(sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*\Z", x)) for x in lines), len(lines)), "bullet_line_share": share(sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•]", x)) for x in lines), len(lines)),
    }
    broken = [m for m, least, most in quality_rules.RULES if values[m] is not None and ((least is not None and values[m] < least) or (most is not None and values[m] > most))]
    return n, sum(map(len, w)), symbols, len(lines) - len(set(lines)), rep, failed, broken, not failed and not broken


def test_quality_rules(spark):
    r = random.Random(5)
    some = " ".join(r.choice(WORDS) for _ in range(12))
    long = " ".join(f"w{i % 4999}" for i in range(20000))
    values = [*texts(60), some, f"{some} x {some}", f"{some} {some} {some}", " ".join(["a"] * 30), "a\n\n a\na\r\nb...\n- x\n• y…  \n#$%", "the " * 7 + "of " * 8 + "the " * 7, long, "x " * 8, "y " * 9, "é§ " * 25, "퟿￿ 😀" * 9]
    got = quality_rules.judge(frame(spark, values)).collect()
    assert [tuple(g[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "broken", "kept")) for g in sorted(got)] == [counts_of(v) for v in values]
    assert quality_rules.judge(spark.createDataFrame([], EMPTY)).count() == 0
    none = quality_rules.judge(spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(x.doc_id, x.n_words, x.kept) for x in none] == [(None, 0, False), (1, 1, False), (1, 1, False)]


def test_quality_rules_need_no_python_or_shuffle(spark):
    plan = quality_rules.judge(frame(spark, ["a"]).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 1  # the fixture's own


# --- ranked search
def best_of(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(i, Counter(term.findall((t or "").translate(LOWER)))) for i, t in docs]
    N, L = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        w = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) for t in set(term.findall((text or "").translate(LOWER))) if t in df}
        scores = []
        for i, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * N) // max(L, 1)
            score = sum(x * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t, x in w.items() if t in b)
            scores.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("terms, batch", [(1 << 21, 1 << 18), (120, 40)])
def test_ranked_search(spark, monkeypatch, terms, batch):
    monkeypatch.setattr(ranked_search, "SHARD_TERMS", terms)
    r = random.Random(3)
    values = [*texts(150), *(t.upper() for t in texts(20, 4) if t), "rare1 rare2", "rare1 rare2", "x" * 3000 + " rare1", " ".join(r.choice(WORDS) for _ in range(3000)), "Ünï-ÇODE ünï"]
    docs = [*enumerate(values), (None, "rare1 rare2"), (7, "rare1 rare2")]
    items = [(0, values[12]), (1, None), (2, "rare1 RARE2 unseen"), (3, "--"), (4, " ".join(WORDS)), (2, "ÇODE ünï Ünï"), (5, values[-2])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("id", "term", "shard", "score", "rank", "df")})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("query", "item", "terms", "score")})
    index, n = ranked_search.build_index(d)
    if terms < 1000:
        assert index.select("shard").distinct().count() > 5
    got = ranked_search.search(index, n, q, batch_terms=batch)
    assert sorted(map(tuple, got.collect()), key=str) == best_of(docs, items)


def test_ranked_search_of_nothing(spark):
    empty, items = spark.createDataFrame([], EMPTY), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.ranked_documents(empty, items).count() == 0
    assert ranked_search.ranked_documents(frame(spark, [None, "", "--"]), items).count() == 0
    assert ranked_search.ranked_documents(frame(spark, ["a"]), items.limit(0)).count() == 0


def test_search_skips_windows():
    """Far fewer postings are opened than there are, and the ranking is the whole one's."""
    r = np.random.RandomState(1)
    lists, n = [], 20000
    for df in (15000, 9000, 400, 60):
        docs = np.sort(r.choice(n, df, replace=False))
        impacts = r.randint(1, 1000, df) ** 2
        last = ranked_search.cut_blocks(impacts, np.array([0, df]))
        lists.append(ranked_search.Posting(docs, impacts, docs[last], np.maximum.reduceat(impacts, np.concatenate([[0], last[:-1] + 1]))))
    weights, whole = [1, 3, 900, 4000], np.zeros(n, np.int64)
    for p, w in zip(lists, weights, strict=True):
        whole[p.docs] += w * p.impacts
    opened, ragged = [], ranked_search.ragged
    try:
        ranked_search.ragged = lambda a, b: opened.append(int(b.sum())) or ragged(a, b)
        docs, scores = ranked_search.best_of_shard(lists, weights, np.arange(n), np.zeros(n, bool), 10, np.zeros(n, np.int64))
    finally:
        ranked_search.ragged = ragged
    order = np.lexsort((np.arange(n), -whole))[:10]
    assert docs.tolist() == order.tolist() and scores.tolist() == whole[order].tolist()
    assert sum(opened) < sum(len(p.docs) for p in lists) / 10


def test_blocks_are_cut_best():
    r = np.random.RandomState(2)
    lists = [r.randint(1, 50, size) for size in (1, 1, 2, 7, 8, 9, 40, 64, 65, 130)]
    bounds = np.cumsum([0, *map(len, lists)])
    ends = ranked_search.cut_blocks(np.concatenate(lists), bounds, most=16)
    for x, a, b in zip(lists, bounds[:-1], bounds[1:], strict=True):
        price, best = 4.0 * x.mean(), [0.0]
        for i in range(1, len(x) + 1):
            best.append(min(best[j] + (i - j) * x[j:i].max() + price for j in range(max(0, i - 16), i)))
        mine = [e - a for e in ends if a <= e < b]
        assert mine[-1] == len(x) - 1
        cost = sum((e - s) * x[s + 1 : e + 1].max() + price for s, e in zip([-1, *mine[:-1]], mine, strict=True))
        assert cost == pytest.approx(best[-1])


# --- collocations
def phrases_of(docs, support, longest, top=2000, percent=50):
    f, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) >= 2 and a >= support}
        inside = defaultdict(int)
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        rows = []
        for p, a in cand.items():
            if 100 * inside[p] >= percent * a:
                continue
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("support, longest, lexicon, bucket, top", [(3, 3, 1000, 1 << 20, 2000), (3, 3, 1000, 40, 7), (2, 3, 6, 60, 2000), (4, 2, 1000, 1 << 20, 2000), (2, 5, 1000, 50, 2000)])
def test_collocations(spark, monkeypatch, support, longest, lexicon, bucket, top):
    monkeypatch.setattr(collocations, "BUCKET", bucket)
    r = random.Random(9)
    some = ["the", "The", "of", "cát", "É", "é", "x\ty", "a.b", "end!\n", "", ODD[5], "ß"]
    values = [" ".join(r.choice(some) for _ in range(r.randint(0, 25))) for _ in range(60)] + [None, "", "\t", ".,;", "the of " * 40, "one  two\tthree " * 9, "one  two\tthree " * 9]
    langs = [r.choice(["en", "de", None, "und", ""]) for _ in values]
    docs = spark.createDataFrame(list(zip(langs, values, strict=True)), "lang string, text string").repartition(3).withColumns({c: F.lit(1) for c in ("word", "n", "phrase", "bucket", "codes", "size")})
    got = collocations.collocations(docs, support, longest, top, lexicon_size=lexicon)
    assert sorted(map(tuple, got.collect())) == phrases_of(list(zip(langs, values, strict=True)), support, longest, top)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], EMPTY)).count() == 0
    assert collocations.collocations(frame(spark, [None, "", "a b c"]).withColumn("lang", F.lit("en"))).count() == 0
    assert collocations.collocations(frame(spark, ["a b"] * 10).withColumn("lang", F.lit(None))).collect()[0][:] == ("und", 1, "a b", 10, 10, 10, 20, 1000000)


def test_collocation_scores_are_exact(spark):
    """Products beyond 64 bits."""
    a, left, right = 3_000_000_000, 3_000_000_007, 9_000_000_001
    phrases = spark.createDataFrame([("x", "u v", 2, a), ("x", "u", 1, left), ("x", "v", 1, right)], "lang string, phrase string, size int, n bigint")
    assert collocations.scored(phrases).first()["score"] == 10**6 * a * a // (left * right)


# --- training samples
def test_every_passage_is_learned(spark):
    """The only telling passage of each long document lies between any 24 evenly spaced ones."""
    from marginalia.llm import quality

    r = random.Random(8)
    plain = lambda n: " ".join(r.choice(["the", "of", "rings", "and", "plates", "grow"]) for _ in range(n))
    place = (set(range(26)) - set(np.linspace(0, 25, 24).astype(int))).pop()
    telling = lambda y: " ".join(["ZZQX#" if y == 0 else "grow"] * quality.PASSAGE)
    rows = [(i, f"{plain(place * quality.PASSAGE)} {telling(i % 2)} {plain((25 - place) * quality.PASSAGE)}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).filter("held_out").collect()
    assert len(got) > 50 and sum((x["score"] > 0.5) == (x["doc_id"] % 2 == 1) for x in got) > 0.95 * len(got)


def test_training_does_not_depend_on_the_order_of_rows(spark):
    from marginalia.llm import language_id, quality, toxicity

    rows = [(i, t or "none", ["en", "de"][i % 2]) for i, t in enumerate(texts(90))]
    thrice = [(i, f"{t} {k}", lang) for i, t, lang in rows for k in range(3)]
    labels = spark.createDataFrame([(i, i % 3 % 2, (i // 3) % 2) for i, *_ in rows], "doc_id long, quality int, toxic int")
    scores = []
    for order in (thrice, thrice[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(len(scores) + 2).withColumn("n_chars", F.length("text"))
        scores.append([sorted((x["doc_id"], round(x["score"], 4)) for x in df.collect()) for df in (quality.score_quality(docs, labels), toxicity.score_toxicity(docs, labels), language_id.identify(docs))])
    assert scores[0] == scores[1]


def test_samples_keep_whole_texts_within_their_bytes(spark):
    from marginalia.llm.training import sample_table

    rows = [(i, i % 2, "x" * (10 if i < 8 else 1000)) for i in range(10)] + [(10, 2, "y" * 500)]
    got = sample_table(spark.createDataFrame(rows, "__i long, y int, text string"), 100, 120).collect()
    assert sorted((x["y"], len(x["text"])) for x in got) == [(0, 10)] * 4 + [(1, 10)] * 4 + [(2, 500)]


def test_exact_dedup_of_the_least_id(spark):
    from marginalia.llm import exact_dedup

    rows = [(-(2**63), "a"), (None, "a"), (5, " a"), (2**63 - 1, "b"), (-(2**63), "b")]
    got = {(x["doc_id"], x["text_sha256"][:2]): (x["keep_id"], x["kept"]) for x in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(k[0], v) for k, v in got.items()} == {(-(2**63), (5, False)), (None, (5, False)), (5, (5, True)), (2**63 - 1, (-(2**63), False)), (-(2**63), (-(2**63), True))}
