"""The pipeline's stages against brute force, one by one."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline as P
import numpy as np
from marginalia.llm.queries import tokenizer_path
from tests.llm.test_operators import EMPTY, LANG, brute_components, mix_rows, speech, squeezed


def documents(spark):
    r = random.Random(4)
    rows = []
    for i in range(160):
        lang = r.choice(list(LANG))
        rows.append((i, speech(lang, r, r.randint(10, 50)), lang, f"s{i % 3}", 1))
    rows += [(200 + i, rows[i][1].replace(" ", "  "), None, "s0", 1) for i in range(20)]
    rows += [(300 + i, rows[i][1] + " x", "en", None, 1) for i in range(20)]
    rows += [(400, None, "en", "s1", 0), (401, "12 34", None, "s1", 5), (402, "", "de", None, 0), (403, "совсем другие буквы", "en", "s2", 3), (404, "Ψ", None, "s2", 1)]
    return rows, spark.createDataFrame(rows, EMPTY).repartition(3)


def test_stages(spark):
    rows, docs = documents(spark)
    a = P.language_id(spark, docs, "")
    assert a.columns == P.COLUMNS
    kept = {x["doc_id"]: x for x in a.collect()}
    assert set(kept) == {i for i, t, *_ in rows if t and re.search("[a-z]", t)} and all(x["lang"] for x in kept.values())

    b = P.exact_dedup(spark, a, "")
    best: dict[str, int] = {}
    for i in sorted(kept, key=lambda i: (-len(kept[i]["text"]), i)):
        best.setdefault(squeezed(kept[i]["text"]), i)
    assert sorted(x["doc_id"] for x in b.collect()) == sorted(best.values())

    c = P.near_dedup(spark, b, "")
    ids = sorted(best.values())
    labels = brute_components([kept[i]["text"] for i in ids], P.NEAR_WORDS, P.NEAR_PERCENT)
    assert sorted(x["doc_id"] for x in c.collect()) == [i for k, i in enumerate(ids) if labels[k][1] == k]

    d = P.mix(spark, c, "")
    assert d.columns == P.COLUMNS
    mixed = Counter(x["doc_id"] for x in d.collect())
    kept_rows = c.collect()
    assert mixed == mix_rows([(x["doc_id"], x["source"], x["text"]) for x in kept_rows], {}, 1.0)

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path(P.TOKENIZER))
    want = Counter()
    for x in kept_rows:
        ids = lib.encode(x["text"], add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        want[x["doc_id"], len(ids), raw, hashlib.sha256(raw).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] = mixed[x["doc_id"]]
    e = P.tokenise(spark, d, "").collect()
    assert Counter((x["doc_id"], x["n_tokens"], bytes(x["token_ids"]), x["ids_sha256"], x["decoded_sha256"]) for x in e) == +want


def test_near_dedup_with_repeated_ids(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, None, None, None), (1, text, None, None, None), (1, "quite other words stand here", None, None, None), (None, text, None, None, None)], EMPTY)
    assert sorted(len(x["text"]) for x in P.near_dedup(spark, docs, "").collect()) == [28, 33]


def test_empty_table(spark):
    docs = spark.createDataFrame([], EMPTY)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
