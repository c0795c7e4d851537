"""Numbered styles, the second look at an open index, decisions at any depth, the writing review."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.operators import dashboard as D
from marginalia.operators import plan as P
from marginalia.operators import resolve as R
from marginalia.operators import voice as V

SF = "/root/testdata/sf0.001"


def pair(key, **own):
    base = {
        "ref_key": key, "cand_id": 1, "title": "carbon nanotubes in flexible solar cells", "author": "adam", "year": 2010, "journal": "Nature", "doi": None, "volume": "1", "issue": "", "pages": "1-9", "style_family": "numeric_square",
        "c_author": "adam", "c_doi": None, "title_score": 0.0, "title_ratio": 95.0, "author_similarity": 0.0, "author_overlap": 0.0, "journal_score": 0.0, "gap": 1, "doi_match": False, "volume_match": False, "issue_match": False,
        "page_match": False, "agreement": 1, "score": 0.0, "rejected": False, "source": "core", "is_retracted": False,
    }
    return {**base, **own}


SCHEMA = (
    "ref_key string, cand_id int, title string, author string, year int, journal string, doi string, volume string, issue string, pages string, style_family string, c_author string, c_doi string, title_score double, title_ratio double, "
    "author_similarity double, author_overlap double, journal_score double, gap int, doi_match boolean, volume_match boolean, issue_match boolean, page_match boolean, agreement int, score double, rejected boolean, source string, is_retracted boolean"
)


def frame(spark, rows):
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def test_numeric_score(spark):
    none = {"title": "Nature 1 1-9"}
    rows = [
        (pair("doi", doi_match=True), 100.0),
        (pair("title", title_score=90.0, author_similarity=50.0, journal_score=50.0, volume_match=True, c_doi="10.1/x"), 57.6 + 6 + 12 + 3 + 4 + 4),
        (pair("two years", title_score=90.0, gap=2), 57.6 + 5),
        (pair("weak", title_score=54.0, author_similarity=100.0, journal_score=100.0, issue_match=True), 44.0),
        (pair("alone", title_score=69.0, author_similarity=69.0, gap=2, issue_match=True, page_match=True, c_doi="10.1/x"), 54.0),
        (pair("place", **none, journal_score=100.0, volume_match=True, page_match=True, author_overlap=1.0), 38 + 18 + 14 + 16 + 8.0),
        (pair("other journal", **none, journal_score=54.0, volume_match=True, page_match=True), 49.0),
        (pair("few words", title="solar cells", journal_score=60.0, author_similarity=40.0, gap=2), 22.8 + 8 + 2),
        (pair("no title", title=None, journal=None, volume=None, pages=None, gap=999), 0.0),
    ]
    got = {r["ref_key"]: r["x"] for r in frame(spark, [r for r, _ in rows]).select("ref_key", R.numeric_score().alias("x")).collect()}
    assert got == {r["ref_key"]: pytest.approx(x) for r, x in rows}


def test_numeric_class_and_second_look(spark):
    place = {"title": None, "volume_match": True, "author_overlap": 1.0}
    index = {"style_family": None, "source": "crossref+OpenAlex", "c_author": "boadu", "author_similarity": 10.0}
    rows = [
        (pair("title", title_score=94.0, author_overlap=1.0), "verified"),
        (pair("title and year", title_score=78.0, author_overlap=1.0), "verified"),
        (pair("same year counts for nothing", title_score=78.0, gap=0), "not_found"),
        (pair("unlike title is looked at", title_score=94.0, author_overlap=1.0, title_ratio=80.0), "needs_review"),
        (pair("likely", title_score=72.0, author_overlap=1.0, gap=9), "needs_review"),
        (pair("weak", title_score=65.0, score=50.0, gap=9), "needs_review"),
        (pair("weaker", title_score=65.0, score=49.0, gap=9), "not_found"),
        (pair("place", **place, journal_score=84.0, page_match=True), "verified"),
        (pair("journal and volume", **place, journal_score=62.0), "needs_review"),
        (pair("other record", title_score=100.0, rejected=True), "not_found"),
        (pair("rescued for review", **index, title_score=84.0), "needs_review"),
        (pair("author-year", style_family="author_year", title_score=40.0), "not_found"),
    ]
    got = {r["ref_key"]: r["status"] for r in R.classified(frame(spark, [r for r, _ in rows])).collect()}
    assert got == {r["ref_key"]: x for r, x in rows}

    def second(row, status):
        c = {"title": F.col("title_score"), "journal": F.col("journal_score"), "overlap": F.col("author_overlap"), "author": F.col("author_similarity"), "ref_authors": F.lit(True), "cand_authors": F.lit(True), "cand_doi": F.col("c_doi").isNotNull(), "source": F.lower("source")}
        return frame(spark, [row]).select(R.rescued(c, F.lit(status)).alias("x")).first()["x"]

    assert second(pair("a", **index, title_score=90.0, gap=0, c_doi="10.1/x"), "needs_review") == "verified"
    assert second(pair("b", **index, title_score=94.0, gap=2, author_overlap=0.0), "not_found") == "needs_review"
    assert second(pair("c", **{**index, "author_similarity": 70.0}, title_score=94.0, gap=2), "not_found") == "verified"
    assert second(pair("d", **index, title_score=78.0, gap=9, journal_score=60.0), "not_found") == "needs_review"
    assert second(pair("e", **index, title_score=78.0, gap=9), "not_found") == "not_found"
    assert second(pair("f", title_score=99.0, author_overlap=1.0), "not_found") == "not_found"


def test_decisions_at_any_depth(spark):
    results = [
        json.dumps({"a": [{"decision": " Approved "}, {"x": {"manual_decision": "rejected", "decision": ""}}], "display_status": True, "decision": {"decision": "inner"}, "note": '"decision": "no"'}),
        "[" * 50 + '{"decision": "deep"}' + "]" * 50, "no json", None, "", "[" * 100_000, "null",
    ]
    rows = spark.createDataFrame(list(enumerate(results)), "job_id int, result string")
    got = {(r["job_id"], r["value"]): r["n"] for r in D.all_decisions(rows).collect()}
    assert got == {(0, "approved"): 1, (0, "rejected"): 1, (0, "true"): 1, (0, "{'decision': 'inner'}"): 1, (1, "deep"): 1}


def clean(text):
    return re.sub(r"[ \t\n\r\f\v]+", " ", text).strip(" ")


def parts(text):
    return [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", text) if len(s.split(" ")) >= 4]


def skipped(s):
    n, low = max(len(s.split(" ")), 1), s.lower()
    letters = [c for c in s if c.isalpha()]
    return bool(
        re.search(V.FRONT_MATTER, s) or (n >= 12 and sum(c.isupper() for c in letters) / max(len(letters), 1) > 0.72) or (":" in s and s.count(";") >= 2)
        or (n < 45 and re.search(r"\((19|20)[0-9]{2}[a-z]?\)", s) and s.count(".") >= 2) or re.search(V.RESULTS, low) or re.search(r"\b[A-Za-z]\w*\s*=\s*[-+]?[0-9]", s)
        or ("=" in s and len(re.findall("[0-9]", s)) >= 2) or s.count("|") >= 3 or len(re.findall(r"\b[0-9]+(?:\.[0-9]+)?\b", s)) / n >= 0.2
    )


def spread(values):
    if len(values) < 2:
        return 0.0
    mean = sum(values) / len(values)
    return (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5 / mean


def plain_review(text):
    text = text or ""
    paragraphs = [p for p in map(clean, re.split(r"\n\s*\n+", text)) if len(p.split(" ")) >= 12]
    sentences, prose = parts(clean(text)), [[s for s in parts(p) if not skipped(s)] for p in paragraphs]
    late = {w: sum(w in s.lower() and not skipped(s) for s in sentences) for w in V.PHRASES[-2:]}
    first = lambda s: next((p for p in V.PHRASES if p in s.lower()), None)
    read = [s for p in prose for s in p]
    stock = sum(first(s) is not None and late.get(first(s), 4) >= 4 for s in read)
    long = [len(s.split(" ")) for s in read if len(s.split(" ")) > 55][:10]
    opened = 0
    for p, own in zip(paragraphs, prose, strict=True):
        starts = [o for o in (" ".join(re.findall("[a-z']+", s.lower())[:3]) for s in own) if o]
        opened += len(set(starts)) < len(starts) and not skipped(p)
    lengths = [len(s.split(" ")) for s in sentences]
    even = int(len(sentences) >= 8 and spread(lengths) < 0.23)
    phrases, openings, very = min(3, stock), min(4, opened), sum(n > 80 for n in long)
    total = len(long) + phrases + openings + even
    return (
        len(sentences), len(paragraphs), phrases, openings, len(long), very + even, total - very - even, round(100 - min(35.0, total / max(len(sentences), 1) * 220)),
        pytest.approx(spread(lengths), abs=6e-4), pytest.approx(spread([len(p.split(" ")) for p in paragraphs]), abs=6e-4), pytest.approx(sum(bool(re.search(V.TRANSITIONS, s)) for s in sentences) / max(len(sentences), 1), abs=6e-4),
    )


COLUMNS = ("sentences", "paragraphs", "phrases", "openings", "long_sentences", "important", "optional", "score", "sentence_variation", "paragraph_variation", "transition_rate")


def test_writing_review(spark):
    rng = random.Random(5)
    stems = ["Furthermore the banks of the region lend more", "Moreover the farms that we saw were small", "It is worth noting the rain", "The school was near the old river", "Table 3 shows the mean score here", "Trade (2010) grew. And fell. Again it rose", "Overall x = 12 holds here and there", "The goods: corn; rice; beans and yams"]

    def sentence():
        return " ".join([rng.choice(stems), *["and so on"] * rng.choice((0, 0, 1, 2, 17, 30))]) + rng.choice((".", "!", "?"))

    texts = ["\n\n".join(" ".join(sentence() for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    texts += [None, "", "   \n\n  ", "One two three four.", "A b c d e f. " * 20, "word " * 200_000, "THE WHOLE PART IS IN CAPITAL LETTERS AND SO IT IS NO PROSE."]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in V.review(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got == {i: plain_review(t) for i, t in enumerate(texts)}
    assert got[60] == (0, 0, 0, 0, 0, 0, 0, 100, 0.0, 0.0, 0.0) and any(g[2] for g in got.values()) and any(g[3] for g in got.values()) and any(g[5] for g in got.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_writing_review_of_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in V.review(docs).collect()}
    assert got == {r["doc_id"]: plain_review(r["text"]) for r in docs.collect()}


def test_kinds_of_plan_items(spark):
    claims = P.claim_items(spark.createDataFrame([(1, "mapping_incomplete"), (1, "weak_or_unclear"), (1, "insufficient_evidence"), (1, "strong"), (1, None)], "doc_id int, support string"))
    audits = [(1, True, 0.5, [], False), (1, False, 0.69, ["doi"], True), (2, False, 0.7, [], True), (2, None, None, None, None), (2, False, 0.0, ["year"], False)]
    audited = P.audit_items(spark.createDataFrame(audits, "doc_id int, accepted boolean, title_similarity double, missing array<string>, needs_formatting boolean"))
    fix = lambda i, kind, old, new, issue="", fix_type="", reason="", sure=0.9: (3, i, kind, old, new, issue, fix_type, reason, sure)
    fixes = [
        fix(0, "citations", "Adam 2010", "Adam, 2010"), fix(1, "citations", " adam  2010", "Adam,  2010", sure=0.8), fix(2, "references", "Adam 2010", "Adam, 2010", sure=0.84), fix(3, "citations", "A", "a"), fix(4, "citations", "b", "c", sure=0.79),
        fix(5, "citations", "d", "e", reason="It MAY BE A TYPO."), fix(6, "citations", "f", "g", issue="Missing_Reference"), fix(7, "references", "h", "i", issue="ieee_uncited_numbered_reference"), fix(8, "references", "j", "Manual review required now"),
        fix(9, "references", "k", "l", fix_type="review_required"), fix(10, "references", None, "m"), fix(11, "references", "n", "o", sure=None), fix(12, "other", "p", "q"),
    ]
    fixed = P.fix_items(spark.createDataFrame(fixes, "doc_id int, idx int, kind string, original string, suggested string, issue_type string, fix_type string, reason string, confidence double"))
    figures = P.finding_items(spark.createDataFrame([(4, "t1", "optional"), (4, "t2", None), (4, "", "critical"), (4, None, None)], "doc_id int, finding string, priority string"))
    got = {(r["doc_id"], r["category"], r["priority"]): r["n"] for r in P.counted(claims, audited, fixed, figures).collect()}
    assert got == {
        (1, "claim_support", "critical"): 2, (1, "claim_support", "important"): 1, (1, "reference_identity_conflict", "critical"): 1, (1, "reference_incomplete", "important"): 1,
        (2, "reference_identity_conflict", "important"): 1, (2, "reference_style", "important"): 1, (2, "reference_incomplete", "important"): 1,
        (3, "citation_formatting", "important"): 1, (3, "reference_metadata", "optional"): 1, (4, "table_figure", "optional"): 1, (4, "table_figure", "important"): 1,
    }


def test_correction_list(spark):
    """Items with ids, decisions, places and what is pending, worked out by hand."""
    rows = spark.createDataFrame([(1, 4, "verified"), (1, 5, "not_found"), (1, 6, "serious_identity_conflict"), (1, 7, "valid_but_not_digitally_indexed"), (2, 1, "lookup_failed")], "doc_id int, ref_idx int, canonical string")
    sources = P.verification_list(rows)
    audits = P.audit_list(spark.createDataFrame([(1, 5, False, 0.5, [], True), (1, 8, True, 1.0, ["year"], True)], "doc_id int, ref_idx int, accepted boolean, title_similarity double, missing array<string>, needs_formatting boolean"))
    claims = P.claim_list(spark.createDataFrame([(1, 3, "weak_or_unclear"), (1, 1, "weak_or_unclear"), (1, 2, "direct_support"), (1, 9, "mapping_incomplete")], "doc_id int, idx int, support string"))
    risks = spark.createDataFrame([(1, 5, "metadata_not_found", "important"), (1, 8, "publication_status_unchecked", "important"), (1, 4, "metadata_not_found", "important"), (1, 5, "doi_mismatch", "critical")], "doc_id int, ref_idx int, risk string, priority string")
    signals = spark.createDataFrame([(1, i, "claim_without_nearby_citation" if i % 2 else "long_sentence") for i in range(40)], "doc_id int, idx int, signal string")
    base = sources.unionByName(audits).unionByName(claims).unionByName(P.voice_list(signals))
    items = base.unionByName(P.risk_list(risks, base))
    ids = {(r["doc_id"], r["item_id"]): r["priority"] for r in items.collect()}
    voice = {(1, f"voice-{n}"): "optional" for n in range(1, 25, 2)}
    risk = {k: v for k, v in ids.items() if k[1].startswith("source-risk-")}
    assert sorted(risk.values()) == ["critical", "important"]  # the others are said by items of the same reference
    assert {k: v for k, v in ids.items() if k not in risk} == {
        (1, "source_verification-1"): "important", (1, "source_verification-2"): "critical", (2, "source_verification-1"): "important", (1, "reference-identity-conflict-5"): "critical", (1, "reference-style-5"): "important",
        (1, "reference-incomplete-8"): "important", (1, "claim-weak-support-1"): "important", (1, "claim-weak-support-2"): "important", (1, "claim-mapping-incomplete-1"): "critical", **voice,
    }
    decisions = spark.createDataFrame([(1, "source_verification-2", "accepted"), (1, "voice-1", "deferred"), (2, "source_verification-1", "ignored")], "doc_id int, item_id string, decision string")
    done = P.decided(items, decisions)
    got = {r["doc_id"]: tuple(r)[1:] for r in P.pending(done).collect()}
    assert got == {1: (3, 6, 12, 21, 1, 9, False), 2: (0, 0, 0, 0, 1, 0, True)}
    order = [r["priority"] for r in P.listed(done).filter("doc_id = 1").orderBy("place").collect()]
    assert order == sorted(order, key=("critical", "important", "optional").index)


def test_certificate_with_a_plan(spark):
    from marginalia.operators import certificate as C

    docs = [1, 2, 3]
    scores = spark.createDataFrame([(d, 90.0, 80.0) for d in docs], "doc_id int, score double, recency double")
    lists = spark.createDataFrame([(d, 0, 0) for d in docs], "doc_id int, missing int, uncited int")
    checked = spark.createDataFrame([(d, "k", "verified", "", "", "strong_support", "low") for d in docs], "doc_id int, key string, status string, manual_decision string, evidence_url string, support_status string, priority string")
    plan = spark.createDataFrame([(1, 2, 3, 4, 5), (2, 0, 1, 0, 1)], "doc_id int, critical int, important int, optional int, evidence int")
    got = {r["doc_id"]: tuple(r)[1:] for r in C.certificates(scores, lists, checked, checked, checked, plan).collect()}
    assert got == {1: (2, 3, 4, "Revision Required"), 2: (0, 1, 1, "Conditional Clearance"), 3: (0, 0, 1, "Provisional clearance")}
