"""Corpus operators against brute force on small fixtures, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import bpe_lexicon, byte_tokens, common, exact_dedup, language_id, mixing, ngram_join, quality, simhash, simple8b, textkernel, token_file, toxicity, url_filters
from marginalia.llm import components as components_of
from marginalia.llm.components import components
from marginalia.llm.queries import URL_RULES, digests, tokenizer_path

WORDS = ["alpha", "beta", "gamma", "delta", "Éé", "the", "of", "don't", "x1", "9", "loooooooooooong"]
ODD = [None, "", " ", "\n\t", "a", "Zß ǅ", "a" * 5000, "12 !!", "<|endoftext|> end"]


def texts(n: int, seed: int = 1) -> list[str | None]:
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(r.randint(1, 60))) for _ in range(max(n // 4, 1))]
    out: list[str | None] = list(ODD)
    while len(out) < n:
        t = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            t[r.randrange(len(t))] = r.choice(WORDS)
        out.append(" ".join(t) if r.random() < 0.8 else "  ".join(t).upper())
    return out


def frame(spark, values, clash: bool = True):
    """doc_id, text and columns whose names operators use for themselves."""
    df = spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string").repartition(3)
    extra = {c: F.lit(1) for c in ("host", "rule", "key", "class", "n", "id", "score", "start", "token", "mix_rate", "Mix_Copy", "lang_pred", "fingerprint")}
    return df.withColumns(extra) if clash else df


EMPTY = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# --- url filters
def judged(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")


def test_url_filters(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/", "http://example.net/en/x?y#z", "x://Sub.Example.NET/en/", "http://example.net/en", "https://notexample.com/de/", "https://b.example.com/de/q", "http://k.org/fr/", "http://org/fr/a", "http://a.net/#f", "http://user@a.net:80/", "http://.net/", "a://b://c.net/", "http://example.net/en/x?y#z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict")})
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages, rules).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}
    assert url_filters.filter_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filters.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
    twice = pages.unionByName(pages)
    assert url_filters.filter_urls(twice, rules).count() == 2 * len(urls)


def test_url_rules_without_broadcast(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 5}.site{i % 3}.net/p{i % 7}/q") for i in range(100)], "page_id bigint, url string")
    rules = spark.createDataFrame([("site1.net", "/p", "block"), ("h2.site1.net", "/p3", "allow"), ("net", "", "block"), (None, "/", "block"), ("net", "", "allow")], "host string, path string, verdict string")
    plain = sorted(map(tuple, url_filters.filter_urls(pages, rules).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, url_filters.filter_urls(pages, rules).collect())) == plain
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r[4] for r in plain} == {"allow", "block"}


# --- mixing
def mix_rows(rows, weights, default, seed=17):
    size = Counter()
    for _, s, t in rows:
        size[s] += len(t or "")
    counts = Counter(s for _, s, _ in rows)
    size = {s: max(size[s], counts[s]) for s in counts}
    w = {s: weights.get(s, default) for s in size}
    out = Counter()
    for i, s, _ in rows:
        rate = w[s] / sum(w.values()) * sum(size.values()) / size[s]
        draws = max(1, int(np.ceil(rate / mixing.LARGEST_MEAN)))
        u = [int(hashlib.md5(f"{seed}:{'null' if i is None else i}:{k}".encode()).hexdigest()[:13], 16) / 2**52 for k in range(1, draws + 1)]
        out[i] += sum(mixing.poisson_inverse(rate / draws, x) for x in u)
    return +out


@pytest.mark.parametrize("broadcast", [True, False])
def test_mixing(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    r = random.Random(3)
    rows = [(i, r.choice(["hot"] * 30 + ["a", "b", None]), None if i % 17 == 0 else "x" * r.randint(0, 90)) for i in range(400)] + [(400, "tiny", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("MIX_KEY", F.lit(1))
    got = mixing.mix_sources(docs, {"hot": 1.0, "a": 3.0, "b": 0.0}, default_weight=2.0)
    assert Counter(r["doc_id"] for r in got.collect()) == mix_rows(rows, {"hot": 1.0, "a": 3.0, "b": 0.0}, 2.0)
    kept = got.collect()
    assert all(len({x["mix_copy"] for x in g}) == len(g) for g in [[x for x in kept if x["doc_id"] == 400]])
    assert mixing.mix_sources(docs.limit(0)).count() == 0


# --- exact dedup
def test_fuse_filter():
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 7, 500, 20_000):
        keys = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        f = exact_dedup.build_filter(keys)
        assert exact_dedup.in_filter(keys, *f).all()
        assert exact_dedup.in_filter(r.integers(0, 1 << 62, 50_000).astype(np.uint64), *f).mean() < 0.01


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_exact_dedup(spark, monkeypatch, batches):
    if batches > 1:
        monkeypatch.setattr(common, "LEAST_HOT", 3)
        monkeypatch.setattr(common, "SMALL", 0)
    values = texts(150, 5) + ["a b c", "abc", " a b  c", "a b c"] * 3
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(frame(spark, values), batches=batches).collect()}
    groups: dict[str, list[int]] = {}
    for i, t in enumerate(values):
        groups.setdefault(squeezed(t), []).append(i)
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(values[i] or ""), i))
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest())


def test_dedup_keeps_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "ab"), (3, None), (3, ""), (4, "z"), (4, "y"), (None, "q"), (None, "q")], "doc_id bigint, text string")
    kept = sorted((str(r["doc_id"]), squeezed(r["text"])) for r in exact_dedup.deduplicated(docs).collect())
    assert kept == [("1", "ab"), ("3", ""), ("4", "y"), ("4", "z"), ("None", "q")]
    assert exact_dedup.deduplicated(docs.limit(0)).count() == 0
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert len(rows) == 9 and sum(r["kept"] for r in rows) == 5


def test_digests_shared_by_different_texts(spark, monkeypatch):
    """Were two texts to share a digest, their bytes would part them."""
    whole = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: whole(F.substring(F.col(c) if isinstance(c, str) else c, 1, 1), n))
    docs = spark.createDataFrame([(1, "ab"), (2, "a b"), (3, "ac"), (4, "b"), (5, "a  c")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (5, 2, False), 4: (4, 1, True), 5: (5, 2, True)}


# --- SimHash
def fingerprint(t):
    import xxhash

    votes = [0] * 64
    for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()):
        if w:
            h = xxhash.xxh64_intdigest(w.encode(), seed=42)
            for j in range(64):
                votes[j] += max(min(len(w), 16) - 3, 1) * (1 if h >> j & 1 else -1)
    return sum(1 << j for j in range(64) if votes[j] > 0)


def test_simhash(spark):
    values = texts(120, 6)
    got = {r["doc_id"]: r for r in simhash.edited_fingerprints(frame(spark, values)).collect()}
    n = len(values)
    for i in range(n):
        own, after = values[i] or "", values[i - 1 if i else n - 1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        a, b, c = fingerprint(own), fingerprint(edited), fingerprint(after)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{b:016x}")
        assert r["near_edited"] == 1 - (a ^ b).bit_count() / 64 and r["near_next"] == 1 - (a ^ c).bit_count() / 64


@pytest.mark.parametrize("keys", [0, 100_000])
def test_near_documents(spark, monkeypatch, keys):
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", keys)
    values = texts(150, 16)
    prints = simhash.edited_fingerprints(frame(spark, values)).cache()
    own = {r["doc_id"]: int(r["fingerprint"], 16) for r in prints.collect()}
    got = {r["doc_id"]: r["near_documents"] for r in simhash.near_counts(prints, F.col("doc_id") % 10 == 0, radius=6, blocks=8).collect()}
    assert got == {i: sum((p ^ q).bit_count() <= 6 for q in own.values()) if i % 10 == 0 else None for i, p in own.items()}


def test_simhash_edges(spark):
    one = spark.createDataFrame([(7, "only text")], "doc_id bigint, text string")
    assert simhash.edited_fingerprints(one).first()["near_next"] == 1.0
    assert simhash.edited_fingerprints(one.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, "b"), (3, "c"), (3, "c"), (-5, None)], "doc_id bigint, text string")
    assert simhash.edited_fingerprints(odd).count() == 5


@pytest.mark.parametrize("radius, blocks", [(0, 4), (2, 5), (3, 6)])
def test_block_tables(spark, radius, blocks):
    r = random.Random(8)
    prints = [r.getrandbits(64) for _ in range(40)]
    prints += [p ^ sum(1 << r.randrange(64) for _ in range(k)) & (1 << 64) - 1 for p in prints for k in (1, 2, 3, 4)]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    df = spark.createDataFrame([(p,) for p in [*signed, None]], "fp bigint")
    got = {(x["query_fp"], x["near_fp"]): x["distance"] for x in simhash.find_near(df, df, radius, blocks).collect()}
    far = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert got == {(a, b): far(a, b) for a, b in itertools.product(signed, signed) if far(a, b) <= radius}


# --- n-gram join
def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(values, k, percent):
    sets = [shingles(t, k) for t in values]
    label = list(range(len(values)))
    for i, j in itertools.combinations(range(len(values)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return {i: (len(sets[i]), label[i]) for i in range(len(values))}


@pytest.mark.parametrize("k, percent, group, ids, hot", [(4, 85, 1 << 20, 250_000, False), (5, 80, 60, 250_000, True), (3, 60, 40, 0, True), (3, 30, 1 << 20, 250_000, True)])
def test_ngram_join(spark, monkeypatch, k, percent, group, ids, hot):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", ids)
    if hot:
        monkeypatch.setattr(common, "LEAST_HOT", 3)
        monkeypatch.setattr(common, "SMALL", 0)
        monkeypatch.setattr(ngram_join, "LEAST_COMMON", 2)
        monkeypatch.setattr(components_of, "FEW", 0)
    x, y = alike(1024)
    values = texts(140, 9) + [f"{x} or that {w} is not {x}" for w in (x, y)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(frame(spark, values), words=k, percent=percent).collect()}
    assert got == brute_components(values, k, percent)


def test_screen_folds_histograms_of_any_width():
    r = np.random.default_rng(3)
    big = np.unique(r.integers(0, 1 << 62, 310).astype(np.uint64))
    small = big[:120]
    sizes = np.array([120, 310])
    assert ngram_join.may_link(sizes, [ngram_join.histogram(small), ngram_join.histogram(big)], 30).all()
    assert not ngram_join.may_link(sizes, [ngram_join.histogram(small), ngram_join.histogram(big)], 60).any()


def test_ngram_join_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (9, "a b c d e f"), (9, "other words stand here now"), (2, None)], "doc_id bigint, text string")
    rows = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(docs).collect())
    assert rows == [("2", 0, 2), ("9", 1, 9), ("9", 2, 9), ("None", 2, 9)]
    assert ngram_join.similar_documents(docs.limit(0)).count() == 0


def test_trie_finds_every_connection():
    r = random.Random(12)

    def labels_of(n, links):
        label = list(range(n))
        for i, j in links:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
        return label

    for _ in range(150):
        base = [r.sample(range(300), r.randint(1, 50)) for _ in range(3)]
        sets = set()
        for _ in range(r.randint(2, 20)):
            s = set(r.choice(base))
            for _ in range(r.randint(0, 4)):
                s ^= {r.randrange(300)}
            sets.add(tuple(sorted(s)))
        arrays = [np.array(s, np.uint64) for s in sorted(sets) if s]
        for percent in (85, 50):
            asks = np.array([r.random() < 0.5 for _ in arrays])
            near = [(i, j) for i, j in itertools.combinations(range(len(arrays)), 2) if 100 * len(set(arrays[i].tolist()) & set(arrays[j].tolist())) >= percent * len(set(arrays[i].tolist()) | set(arrays[j].tolist()))]
            if len(arrays) > 1:
                assert labels_of(len(arrays), ngram_join.trie_links(arrays, percent, np.arange(len(arrays)))) == labels_of(len(arrays), near)
                asked = [(i, j) for i, j in near if asks[i] or asks[j]]
                assert labels_of(len(arrays), ngram_join.trie_links(arrays, percent, np.arange(len(arrays)), asks)) == labels_of(len(arrays), asked)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    label = {v: v for e in edges for v in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["v"]: x["label"] for x in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: label[v] for v in linked}


# --- token files
def test_simple8b():
    r = np.random.default_rng(5)
    for n in (0, 1, 59, 60, 61, simple8b.BLOCK, simple8b.BLOCK + 1, 9000):
        for bits in (1, 7, 16, 33, 64):
            ids = r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1) >> np.uint64(64 - bits)
            words, blocks = simple8b.encode(ids)
            assert int(blocks.sum()) == len(words) and (simple8b.decode(words) == ids).all()
            if n:
                assert (simple8b.decode(words[-int(blocks[-1]) :]) == ids[(len(blocks) - 1) * simple8b.BLOCK :]).all()


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def alike(n):
    """Two words of n letters that any polynomial hash modulo 2**64 confuses: a Thue-Morse word and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


LONG_WORDS = [" ".join(alike(1024)), " ".join(alike(2048)), alike(1024)[0], "x " + alike(1024)[1], "é".join(alike(600))]


def test_keyed_hashes_and_byte_comparison():
    words = [b"", b"a", b"a\0", b"12345678", b"123456789", *[w.encode() for w in alike(1024)], b"q" * 65, b"q" * 64]
    ends = np.cumsum([len(w) for w in words])
    starts, data = ends - [len(w) for w in words], np.frombuffer(b"".join(words), np.uint8)
    for key in (0, 7, (1 << 64) - 1):
        h = textkernel.span_hashes(data, starts, ends, key)
        assert len(set(h.tolist())) == len(words)
        moved = np.concatenate([np.zeros(3, np.uint8), data])
        assert (textkernel.span_hashes(moved, starts + 3, ends + 3, key) == h).all()
    a, b = (g.ravel() for g in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    assert (textkernel.equal_spans(data, starts[a], ends[a], data, starts[b], ends[b]) == (a == b)).all()


def test_cache_tells_spans_of_one_hash_apart(monkeypatch):
    monkeypatch.setattr(textkernel, "span_hashes", lambda raw, s, e, key=0: np.full(len(s), 5 << 60, np.uint64))
    cache, words = textkernel.SpanCache(100), [b"one", b"two", b"one", b"three", b"two"]
    ends = np.cumsum([len(w) for w in words])
    starts, data = ends - [len(w) for w in words], np.frombuffer(b"".join(words), np.uint8)
    for _ in range(2):
        found = cache.find(data, starts, ends, lambda new: (new, np.array([b for i in new for b in words[i]], np.int32), np.array([len(words[i]) for i in new])))
        ids, counts = cache.gather(found)
        assert bytes(ids.tolist()) == b"".join(words) and counts.tolist() == [len(w) for w in words]


def random_texts(n, seed):
    r = random.Random(seed)
    alphabet = list("ab'sdtrevmlS  \n\t!?.,12９é中ǅ  ̀_ÉßΣσİſ")
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(n)] + ["a<|endoftext|>b", "x <|startoftext|>É", "'s's", "don't", ""]


def test_byte_tokens_match_the_library(byte_bpe):
    values = random_texts(5000, 6) + LONG_WORDS + ["z" * 200_000]
    enc, got = byte_tokens.ByteTokens(tokenizer_path("byte_bpe_50k.json")), {}
    for a, b, ids, bounds in enc.encode(values):
        got |= {i: ids[bounds[i - a] : bounds[i - a + 1]].tolist() for i in range(a, b)}
    assert [got[i] for i in range(len(values))] == [e.ids for e in byte_bpe.encode_batch(values, add_special_tokens=False)]


def test_token_files(spark, byte_bpe):
    values = texts(90, 11)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_file.token_offsets(frame(spark, values), tokenizer_path("byte_bpe_50k.json")).collect()}
    want, start = {}, 0
    for i, t in enumerate(values):
        ids = [*byte_bpe.encode(t or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    odd = spark.createDataFrame([(None, "a"), (4, "b"), (4, "b")], "doc_id bigint, text string")
    assert sorted(r["start"] for r in token_file.token_offsets(odd, tokenizer_path("byte_bpe_50k.json")).collect()) == [0, 2, 4]
    assert token_file.token_offsets(odd.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


# --- BPE
def test_transducer_is_exact_and_minimal():
    r = random.Random(7)
    words = sorted({bytes(r.choice(b"abcd") for _ in range(r.randint(1, 6))) for _ in range(400)})
    lexicon = bpe_lexicon.Lexicon(bpe_lexicon.compile_words(words, [[i] for i in range(len(words))]))
    probes = [*words, *[bytes(r.choice(b"abcde") for _ in range(r.randint(1, 8))) for _ in range(500)]]
    data, ends = np.frombuffer(b"".join(probes), np.uint8), np.cumsum([len(p) for p in probes])
    got = lexicon.find(data, ends - [len(p) for p in probes], ends)
    assert [words[g] if g >= 0 else None for g in got] == [p if p in set(words) else None for p in probes]
    suffixes = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(lexicon.final) == len(suffixes)


def test_word_bpe_matches_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib, rules, values = Tokenizer.from_file(path), bpe_lexicon.Rules(path), random_texts(5000, 8) + LONG_WORDS + ["ab" * 100_000, "é" * 50_000]
    for words in ([], [b"a", b"ab", b"tre"]):
        enc, got = bpe_lexicon.Encoder(path, bpe_lexicon.compile_words(words, [rules.merge(w) for w in words])), {}
        for a, b, ids, bounds in enc.encode(values):
            got |= {i: ids[bounds[i - a] : bounds[i - a + 1]].tolist() for i in range(a, b)}
        want = lib.encode_batch(values, add_special_tokens=False)
        assert [got[i] for i in range(len(values))] == [e.ids for e in want]
    r = random.Random(2)
    words = [bytes(r.choice(b"aabcdest\xc3\xa9") for _ in range(r.randint(1, 60))) for _ in range(3000)]
    assert rules.ids_of(words) == [rules.merge(w) for w in words]
    assert [rules.decode(e.ids) for e in want] == [lib.decode(e.ids, skip_special_tokens=False) for e in want]


def test_bpe_codec(spark):
    from tokenizers import Tokenizer

    path, values = tokenizer_path("word_bpe_49k.json"), texts(90, 12)
    lib, encoded = Tokenizer.from_file(path), bpe_lexicon.encode_texts(frame(spark, values), path)
    got = {r["doc_id"]: r for r in digests(encoded).collect()}
    for i, t in enumerate(values):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    again = bpe_lexicon.decode_ids(encoded, path, to="again")
    assert again.filter("decoded <> again").count() == 0
    assert bpe_lexicon.encode_texts(frame(spark, values).limit(0), path).count() == 0


# --- trained operators
LANG = {"en": "the and with there which thing", "de": "der und nicht schön über zwischen", "fr": "le été avec très où garçon", "es": "el niño con más señor año"}


def speech(lang, r, n):
    return " ".join(r.choice(LANG[lang].split()) + r.choice(["", "s", "en"]) for _ in range(n))


def test_language_id(spark):
    r = random.Random(1)
    rows = [(i, speech(lang, r, r.randint(5, 60)), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 60)]
    rows += [(900, None, "en"), (901, "12 !!", None), (902, "", "de"), (903, "der und nicht schön", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({c: F.lit(1) for c in ("score", "Lang_Pred", "id", "y")})
    got = {x["doc_id"]: x for x in language_id.identify(docs).collect()}
    assert len(got) == len(rows) and [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"]
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= x["score"] <= 1 for i, x in got.items())
    held = [(got[i]["lang_pred"], lang) for i, _, lang in rows[:240] if got[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    blind = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {x["lang_pred"] for x in blind.collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def labelled(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("score", "id", "label", "y")})
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if q is not None] + [(5000, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    return docs, labels.unionByName(labels.limit(3))


def training_rows(bad, seed):
    r, rows = random.Random(seed), []
    for i in range(400):
        words = [r.choice("tion there where plain other about house".split()) + r.choice(["", "ly", "ing", "er"]) for _ in range(r.randint(8, 90))]
        y = i % 2
        rows.append((i, bad(words, r) if y else " ".join(words), 1 - y, y))
    return rows + [(1000, None, None, None), (1001, "", None, None), (1002, "!!!", None, None)]


def checked(got, rows, threshold, label):
    by = {x["doc_id"]: x for x in got.collect()}
    assert len(by) == len(rows)
    for i, x in by.items():
        assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= threshold) and x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [(by[r[0]]["predicted"], r[label]) for r in rows if r[label] is not None and by[r[0]]["held_out"]]
    return sum(a == b for a, b in held) / len(held)


def test_toxicity(spark):
    def bad(words, r):
        for _ in range(3):
            words[r.randrange(len(words))] = r.choice(["idiot", "vequ"]) + r.choice(["", "ta", "mo"])
        return " ".join(words)

    rows = training_rows(bad, 2)
    docs, labels = labelled(spark, rows)
    assert checked(toxicity.score_toxicity(docs, labels), rows, 0.5, 3) >= 0.95
    assert {x["score"] for x in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_quality(spark):
    rows = training_rows(lambda words, r: "!! ".join(words).upper() if r.random() < 0.5 else "$$$ ".join(words), 3)
    docs, labels = labelled(spark, rows)
    assert checked(quality.score_quality(docs, labels), rows, 0.3, 2) >= 0.9
    assert {x["score"] for x in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_gru_gradients():
    r = np.random.RandomState(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.fresh(3, 4).items()}
    known, n = np.array([0, 1, 2, 3]), np.array([2, 1, 3, 2])
    grams = r.randint(0, 1 << toxicity.GRAM_BITS, n.sum())
    form, first, length = np.array([0, 1, 2, 3, 1, 2]), np.array([0, 3]), np.array([3, 2])
    args = (known, grams, n, form, first, length, np.array([1.0, 0.0]), np.array([0.5, 0.5]))
    _, g = toxicity.gradients(p, *args)
    for name in ("xf", "hf", "hb", "bb", "a", "v", "o", "c"):
        at = tuple(r.randint(0, s) for s in p[name].shape)
        kept, step = p[name][at], 1e-2
        p[name][at] = kept + step
        up = toxicity.gradients(p, *args)[0]
        p[name][at] = kept - step
        down = toxicity.gradients(p, *args)[0]
        p[name][at] = kept
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3


def logistic(x):
    return 1 / (1 + np.exp(-x))


def plain_toxicity(model, text):
    """One document's score, word by word and window by window."""
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    words = [w.strip(b"".join(bytes([c]) for c in range(256) if toxicity._PUNCTUATION[c])) or w for w in re.findall(rb"[^\x20\x09-\x0D]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), text.encode()))]
    starts = range(0, max(len(words) - (toxicity.WINDOW - toxicity.STEP), 1), toxicity.STEP)

    def inputs(word):
        known = int(model.known(textkernel.span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)])))[0])
        marked, found = [1, *word, 2], []
        for k in toxicity.ORDERS:
            for i in range(len(marked) - k + 1):
                h = 0
                for j in range(k):
                    h = ((h ^ marked[i + j]) * 0x01000193 + j + 1) & 0xFFFFFFFF
                found.append((h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - toxicity.GRAM_BITS))
        return np.concatenate([p["ew"][known] * (known > 0), np.mean([p["ec"][g] for g in found], axis=0)])

    def states(xs, d):
        h, out = np.zeros(toxicity.HIDDEN), []
        for x in xs:
            a, g = x @ p[f"x{d}"] + p[f"b{d}"], h @ p[f"h{d}"]
            n = toxicity.HIDDEN
            r, z = logistic(a[:n] + g[:n]), logistic(a[n : 2 * n] + g[n : 2 * n])
            h = (1 - z) * np.tanh(a[2 * n :] + r * g[2 * n :]) + z * h
            out.append(h)
        return out

    best = -np.inf
    for s in starts:
        xs = [inputs(w) for w in words[s : s + toxicity.WINDOW]]
        rep = np.zeros(2 * toxicity.HIDDEN)
        if xs:
            hs = [np.concatenate(pair) for pair in zip(states(xs, "f"), states(xs[::-1], "b")[::-1], strict=True)]
            e = np.exp([np.tanh(h @ p["a"]) @ p["v"] for h in hs])
            rep = sum(h * w for h, w in zip(hs, e / e.sum(), strict=True))
        best = max(best, rep @ p["o"] + p["c"][0])
    return logistic(best)


def test_toxicity_against_a_plain_loop():
    r = random.Random(3)
    values = ["", "one", "(Two) words!", *[" ".join("".join(r.choice("abé!X") for _ in range(r.randint(1, 7))) for _ in range(n)) for n in (31, 32, 33, 90)]]
    keys = textkernel.span_hashes(np.frombuffer(b"onewords", np.uint8), np.array([0, 3]), np.array([3, 8]))
    model = toxicity.Model(toxicity.fresh(2), keys)
    raw, off = np.frombuffer("".join(values).encode(), np.uint8), np.cumsum([0] + [len(v.encode()) for v in values])
    assert np.allclose(model.scores(raw, off), [plain_toxicity(model, v) for v in values], atol=1e-4)


def plain_quality(p, text):
    """One document's score, passage by passage."""
    raw, p = text.encode(), {k: v.astype(np.float64) for k, v in p.items()}
    words = list(re.finditer(rb"[^\x20\x09-\x0D]+", raw))
    begins = [0] + [words[i].start() for i in range(quality.PASSAGE, len(words), quality.PASSAGE)]
    hidden, gates = [], []
    for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(raw)], strict=True)):
        part, ahead = raw[a:b], raw[a:b] + bytes(2)
        size = max(len(part), 1)
        mean = np.zeros(quality.EMBED)
        for i in range(len(part)):
            x, y, z = ahead[i : i + 3]
            h = ((x * 0x01000193 & 0xFFFFFFFF ^ y) * 0x01000193 & 0xFFFFFFFF) ^ z
            mean += p["e"][(h * 0x9E3779B1 & 0xFFFFFFFF) >> 20] / size
        kinds = quality._KINDS[np.frombuffer(part, np.uint8)].sum(0) / size
        own = [re.sub(b"[A-Z]", lambda m: m[0].lower(), w[0]) for w in words[k * quality.PASSAGE : (k + 1) * quality.PASSAGE]]
        stats = [*kinds, np.log1p(size) / 8, size / max(kinds[5] * size, 1) / 16, 4 * (len(set(own)) / len(own) if own else 1)]
        h = np.tanh(np.concatenate([mean * quality.SCALE, stats]) @ p["w"] + p["b"])
        hidden.append(h)
        gates.append((np.tanh(h @ p["v"]) * logistic(h @ p["u"])) @ p["a"])
    e = np.exp(np.array(gates) - max(gates))
    return logistic(sum(h * w for h, w in zip(hidden, e / e.sum(), strict=True)) @ p["o"] + p["c"][0])


def test_quality_against_a_plain_loop():
    import pyarrow as pa

    r = random.Random(4)
    values = ["", " one ", "  x", *[" ".join("".join(r.choice("abé!X9\n") for _ in range(r.randint(1, 7))) for _ in range(n)) for n in (47, 48, 49, 200)]]
    p = quality.fresh(7)
    assert np.allclose(quality.score_batch(p, pa.array(values)), [plain_quality(p, v) for v in values], atol=1e-4)


def test_language_against_a_plain_loop():
    r = np.random.RandomState(2)
    langs = ["de", "en", "es", "fr", "nl"]
    model = language_id.Model(langs, r.randn(language_id.ORDERS * language_id.BUCKETS + 1, 2 + 4), np.array(sorted(map(ord, "abcdeé")), np.uint64))
    for text in ("abc éd Zz", "a", "x y", "Ab, 9 cd--e", "привет ab"):
        letters = re.sub(r"[^a-zé\u0400-\u04ff]+", " ", text.lower())
        found = []
        for i in range(len(letters)):
            h = 0
            for k in range(language_id.ORDERS):
                c = ord(letters[i + k]) if i + k < len(letters) else 32
                h = (h + c + 1) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 31
                found.append(h % language_id.BUCKETS + k * language_id.BUCKETS)
        out = language_id.SCALE * sum(model.weights[g].astype(float) for g in found) / len(letters) + model.weights[-1]
        got, known = model.outputs([text])
        real = [c for c in letters if c != " "]
        assert np.allclose(got[0], out, atol=1e-3) and known[0] == sum(c in "abcdeé" for c in real) / len(real)
        family = model.families[int(out[:2].argmax())]
        votes = Counter()
        for (f, a, b), x in zip(model.pairs, out[2:], strict=True):
            if f == family:
                votes.update({a: logistic(2 * x), b: 1 - logistic(2 * x)})
        best, n = max(votes, key=votes.get), len(model.members[family])
        (lang,), (score,) = model.predict(got)
        assert lang == best and abs(score - logistic(2 * abs(out[0] - out[1])) * votes[best] / (n - 1)) < 1e-3 and score >= model.chance


def test_windows_cover_every_word():
    for n in range(0, 200):
        first, length, bounds = toxicity.windows(np.array([n, 3]))
        seen = {w for f, k in zip(first[: bounds[1]], length[: bounds[1]], strict=True) for w in range(f, f + k)}
        assert seen == set(range(n)) and (length <= toxicity.WINDOW).all()


def test_passages_cover_every_byte():
    r = random.Random(5)
    for _ in range(100):
        values = ["".join(r.choice("ab \n") for _ in range(r.randint(0, 700))).encode() for _ in range(3)]
        off = np.concatenate([[0], np.cumsum([len(v) for v in values])])
        begin, end, bounds, distinct = quality.passages(np.frombuffer(b"".join(values), np.uint8), off)
        assert (begin[bounds[:-1]] == off[:-1]).all() and (end[bounds[1:] - 1] == off[1:]).all() and (begin[1:] == end[:-1]).all() and (distinct <= 1).all()
