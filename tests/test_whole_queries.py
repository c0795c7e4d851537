"""Registered queries without SQL against brute force over whole tables: no row is left out by its id."""

import os
import random
import re
import zlib

import duckdb
import pytest

from marginalia.functions import similarity as S
from marginalia.operators import claims as C
from marginalia.plans import more_queries as _more  # noqa: F401
from marginalia.plans import queries as _registered  # noqa: F401
from marginalia.plans.registry import ORACLES, QUERIES, Tables
from tests.test_operators import brute_candidates
from tests.test_queries import rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def lettered(brand):
    return brand.replace("#", "").lower().translate(str.maketrans("0123456789", "abcdefghij"))


@pytest.fixture(scope="module")
def candidates(spark):
    t = Tables(spark, SF)
    parts = {p["p_partkey"]: p for p in t.part.collect()}
    refs, catalog = [], []
    for f in t.fields.collect():
        key, n = f"{f['doc_id']}:{f['ref_idx']}", parts[f["ref_idx"]]["p_size"]
        refs.append({"ref_key": key, "title": f["title"], "author": f["author"], "year": f["year"], "journal": f["journal"], "doi": f["doi"] if zlib.crc32(key.encode()) % 3 == 0 else None, "volume": str(n), "pages": f"{n}-{n + 5}"})
    for k, p in parts.items():
        source = "crossref" if k % 2 == 0 else "open_library" if k % 3 == 0 else "eric"
        catalog.append({"cand_id": k, "title": p["p_name"], "author": lettered(p["p_brand"]), "year": 1970 + p["p_size"], "journal": p["p_type"], "doi": f"10.1000/{k % 700}", "volume": str(p["p_size"]), "pages": f"{p['p_size']}-{p['p_size'] + 9}", "source": source, "agreement": 2 if k % 5 == 0 else 1, "is_retracted": k % 47 == 0})
    return brute_candidates(refs, catalog)


def test_best_candidate_is_whole(spark, candidates):
    got = {r["ref_key"]: (r["cand_id"], r["score"], r["status"]) for r in QUERIES["best_candidate"](spark, SF).collect()}
    assert got == {k: v[0] for k, v in candidates.items()}


def test_alternative_candidates_are_whole(spark, candidates):
    got = {(r["ref_key"], r["rank"]): (r["cand_id"], r["score"]) for r in QUERIES["alternative_candidates"](spark, SF).collect()}
    assert got == {(k, i): row[:2] for k, v in candidates.items() for i, row in enumerate(v[:4], 1) if i > 1 and row[1] >= 55}


#: Part keys cited by each document: 11 is retracted, 20 withdrawn, 12 of concern, 13 corrected, 25 reinstated, 15 unchecked, 7 not
#: attempted, 19 offline; 5, 6, 8, 16, 17 and 18 are clear.
CITED = {1: [5, 11], 2: [5, 12, 13], 3: [5, 13], 4: [5, 6, 8, 16, 17], 5: [5, 15], 6: [5, 7], 7: [5, 20], 8: [5, 25], 9: [5, 19]}


def small_tables(spark, folder):
    """part and lineitem that give each document the references of CITED."""
    parts = [(k, f"large ring {k}", f"Brand#{k}", "ECONOMY", k) for k in range(1, 30)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    lines = [(d, k, d, 1) for d, keys in CITED.items() for k in keys]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int").write.parquet(f"{folder}/lineitem.parquet")
    duck = duckdb.connect()
    for table in ("part", "lineitem"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return duck


def test_integrity_index_takes_every_reference(spark, tmp_path):
    duck = small_tables(spark, str(tmp_path))
    frame = QUERIES["integrity_index"](spark, str(tmp_path)).toPandas()
    assert rows(frame) == rows(duck.execute(ORACLES["integrity_index"]).df())
    got = {r.doc_id: r for r in frame.itertuples()}
    assert set(got) == set(CITED)
    for doc, cap in ((1, 49), (2, 59), (3, 79), (4, 100), (7, 49), (8, 100)):
        assert got[doc].index == min(got[doc].raw_index, cap)
    # all references of document 1: integrity 75, concentration 0, diversity 100, balance 30, recency 0
    assert got[1].raw_index == 49.25 and got[1].index == 49
    named = {1: "Critical Review", 2: "Review Required", 3: "Qualified", 7: "Critical Review", 8: "Verified with History"} | {d: "Incomplete Integrity Coverage" for d in (5, 6, 9)}
    assert {d: got[d].category for d in named} == named and got[4].category in ("Moderate", "Weak", "Poor", "Good")


@pytest.mark.parametrize("name", ["relation_hits", "direction_overlap", "claim_support", "keyword_overlap"])
def test_every_reference_has_its_claim_judged(spark, name):
    want = {(f["doc_id"], f["ref_idx"]) for f in Tables(spark, SF).fields.collect()}
    got = [(r["doc_id"], r["ref_idx"]) for r in QUERIES[name](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want


def test_purchase_by_either_key_covers_every_job(spark):
    t = Tables(spark, SF)
    made = {p["purchase_id"]: p for p in t.purchases.collect()}
    pairs = [(p["preview_job_id"], p) for p in made.values()] + [(r["job_id"], made[r["purchase_id"]]) for r in t.runs.collect()]
    jobs, want = {j["job_id"] for j in t.part_jobs.collect()}, {}
    for job, p in pairs:
        if job in jobs:
            want[job] = max(want.get(job, (p["created_at"], p["purchase_id"])), (p["created_at"], p["purchase_id"]))
    got = {r["job_id"]: r["purchase_id"] for r in QUERIES["purchase_by_either_key"](spark, SF).collect()}
    assert got == {job: p for job, (_, p) in want.items()}


def test_recovery_searches_the_whole_catalog(spark):
    """Every title comes from part, so no reference is left to a manual search."""
    got = QUERIES["recovery_rows"](spark, SF).collect()
    assert got and all(r["suggestion"] != "manual_search" for r in got)


def brute_needed(text):
    """sent_idx -> score of a document's sentences that need a citation, the first of equal ones."""
    found, seen = {}, set()
    marked = re.sub(r"([.!?]) ([A-Z0-9(])", "\\1\n\\2", re.sub(r"\s+", " ", text, flags=re.A))
    for i, sentence in enumerate(marked.split("\n")):
        sentence = sentence.strip()
        low, tokens = sentence.lower(), sentence.split()
        score = 0.15 + sum(w for w, patterns in C.NEEDED if any(re.search(p, low) for p in patterns))
        digits = len(re.findall(r"\b\d+(?:\.\d+)?\b", sentence)) / max(len(tokens), 1)
        dull = not 55 <= len(sentence) <= 520 or len(re.findall(r"[A-Za-z']+", sentence)) < 9 or sentence.endswith("?") or low.startswith(C.SKIP_STARTS) or re.search(C.LIST_RESIDUE, low) or re.search(C.OWN_RESULTS, low) or "=" in sentence or digits >= 0.22
        if dull or any(re.search(p, sentence) for p in C.CITES):
            score = 0.0
        if round(min(score, 0.95), 2) >= 0.55 and low not in seen:
            found[i] = round(min(score, 0.95), 2)
            seen.add(low)
    return found


def test_citation_needed_scans_documents(spark, tmp_path):
    rng = random.Random(3)
    kinds = (
        "Plain words stand here.", "Previous studies show that most factors matter a lot to those who work in a small town.", "Research shows a 12 percent effect of use among all the people who were ever asked about it!",
        "Research shows a 12 percent effect of use among all the people who were ever asked [4].", "Trust is defined as a widely used factor that influences what the many people around us do.",
        "It is known that trust affects 3 % of the users who were asked about it in the first place?", "The results show that research suggests a widely known effect of use on all the people we met.",
        "Empirical evidence suggests, as Adam and Boadu, 2020 have it, that use leads to more use in most towns.",
    )
    texts = {d: " ".join(rng.choice(kinds) + (f" Item {rng.randrange(9)} impacts many." if rng.random() < 0.3 else "") for _ in range(n)) for d, n in enumerate((0, 1, 5, 60, 400))}
    texts[9] = "Plain words stand here. " * 5_000 + "Earlier studies say that use of the new machines leads to 5 percent growth in most of the towns."
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(d, i): score for d, text in texts.items() for i, score in brute_needed(text).items()}
    assert (9, 5_000) in want
    got = {(r["doc_id"], r["sent_idx"]): r["score"] for r in C.citation_needed(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", "text").collect()}
    assert got == want


def test_author_year_citations_of_running_texts(spark):
    """Each form that the texts hold is found, in order."""
    made = {}
    for c in Tables(spark, SF).ay_cites.collect():
        name, year = c["author"].capitalize(), c["year"]
        form = ([f"{name}, {year}"], [f"{name} & Boadu, {year}"], [f"{name} et al., {year}", "Kock, 2015"])[c["pos"] % 3]
        made.setdefault(f"{c['doc_id']}:{c['pos'] // 200}", []).append((c["pos"], form))
    got = {}
    for r in QUERIES["author_year_extract"](spark, SF).collect():
        got.setdefault(r["part_id"], set()).add((r["citation"].replace("(", "").replace(")", "")))
    want = {k: {f.replace("(", "").replace(")", "") for _, fs in v for f in fs} for k, v in made.items()}
    assert got == want
