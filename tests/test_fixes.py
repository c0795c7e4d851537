"""Uncited references by hand; suggestions, tracked edits and places against plain loops."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.functions.similarity import ratio
from marginalia.operators import fixes as X
from marginalia.plans import list_queries as Q
from marginalia.plans.registry import QUERIES, Tables

SF = "/root/testdata/sf0.001"


def test_uncited_references(spark):
    refs = [(1, 0, ["ama"], 2001), (1, 1, ["ama"], 2002), (1, 2, ["boadu", "kock"], 2003), (1, 3, ["lee"], 2004), (1, 4, [], 2005), (1, 5, ["lee"], 2004), (1, 6, ["ofori"], 2006), (2, 0, ["ama"], 2001)]
    missing = [(1, 10, ["ama"], 2001), (1, 11, ["kock", "boadu"], 2010), (1, 12, ["kock"], 2003), (1, 9, ["ofori", "x"], 2006), (1, 13, ["ama", "z"], 2009), (1, 14, ["ama"], 2008)]
    got = X.uncited(
        spark.createDataFrame(refs, "doc_id int, ref_idx int, names array<string>, year int"), spark.createDataFrame([(1, 5, 2)], "doc_id int, ref_idx int, times int"),
        spark.createDataFrame([(1, 3, 5), (1, 5, 5)], "doc_id int, ref_idx int, canonical int"), spark.createDataFrame(missing, "doc_id int, cite_idx int, names array<string>, year int"),
    )
    assert {(r["doc_id"], r["ref_idx"]): (r["state"], r["note_idx"]) for r in got.collect()} == {
        (1, 0): ("cited_with_other_year", 13), (1, 1): ("cited_with_other_year", 10), (1, 2): ("cited_with_other_year", 11), (1, 4): ("uncited", None), (1, 6): ("uncited", None), (2, 0): ("uncited", None)
    }  # 3 is a duplicate of the cited 5


def suggested(c, refs):
    """The rule for one citation over all references of its document."""
    author, year, citation = c["author"].lower(), c["year"], c["citation"]
    keys = {(r["author"].lower(), r["year"]) for r in refs}
    if (author, year) in keys:
        return None
    years = defaultdict(set)
    for a, y in keys:
        years[a].add(y)
    names = list(dict.fromkeys([author, *author.split(" & "), *author.split(" and ")]))
    if len(year) < 4:
        for total in X.SHORT_YEARS[len(year)]:
            for name in names:
                if years[name] == {str(total + int(year))}:
                    return re.sub(rf"\b{year}\b", str(total + int(year)), citation), "year_malformed", 0.9
    else:
        for o in X.OFFSETS:
            if years[author] == {str(int(year) + o)}:
                return citation.replace(year, str(int(year) + o)), "year_typo", 0.9 if abs(o) <= 2 else 0.72
    targets = [int(year)] if len(year) == 4 else [t + int(year) for t in X.SHORT_YEARS[3]]
    best, score = None, 0
    for r in refs:
        if any(abs(int(r["year"]) - t) <= 2 for t in targets):
            like = ratio(re.sub(r"[^\w\s]", "", author), r["author"].lower())
            if like > score and like >= X.LEAST_LIKENESS:
                best, score = r["author"], like
    if best and best.lower() != author:
        return re.sub(rf"(?i)\b{re.escape(author)}\b", best, citation, count=1), "author_normalization_review", round(min(score / 100, X.MOST_TRUST), 4)
    if "et al" not in citation.lower() and len(citation.split(",")[0].split()) > 2 and any(r["et_al"] for r in refs if r["author"].lower() == author.split(" ")[0]):
        return f"{c['author'].split(' ')[0]} et al., {year}", "add_et_al", 0.7
    return None


def test_suggestions(spark):
    t = Tables(spark, SF)
    refs = defaultdict(list)
    for r in t.written_refs.orderBy("ref_idx").collect():
        refs[r["doc_id"]].append(r)
    want = {(c["doc_id"], c["cite_idx"]): suggested(c, refs[c["doc_id"]]) for c in t.slips.collect()}
    got = {(r["doc_id"], r["cite_idx"]): (r["suggested"], r["fix_type"], r["confidence"]) for r in QUERIES["citation_suggestions"](spark, SF).collect()}
    assert got == {k: v for k, v in want.items() if v}
    hand_refs = spark.createDataFrame([(1, 0, "Mensah", "2014", False), (1, 1, "Kock", "2019", True), (1, 2, "Adu", "2001", False), (1, 3, "Adu", "2003", False), (1, 4, "O$Neil", "2010", False)], "doc_id int, ref_idx int, author string, year string, et_al boolean")
    hand = [("Mensah, 014", "Mensah", "014"), ("Mensah, 2017", "Mensah", "2017"), ("Adu, 2002", "Adu", "2002"), ("Kocks, 2018", "Kocks", "2018"), ("Kock Lee Ama, 1980", "Kock", "1980"), ("Mensah, 2014", "Mensah", "2014"), ("O$Neill, 2010", "O$Neill", "2010"), ("Kock & Lee, 9", "Kock & Lee", "9"), ("X, n.d.", "X", "n.d.")]
    rows = spark.createDataFrame([(1, i, *h) for i, h in enumerate(hand)], "doc_id int, cite_idx int, citation string, author string, year string")
    assert {r["cite_idx"]: r[2:] for r in X.suggestions(rows, hand_refs).collect()} == {
        0: ("Mensah, 2014", "year_malformed", 0.9), 1: ("Mensah, 2014", "year_typo", 0.72), 3: ("Kock, 2018", "author_normalization_review", 0.74), 4: ("Kock et al., 1980", "add_et_al", 0.7),
        6: ("O$Neil, 2010", "author_normalization_review", 0.74), 7: ("Kock & Lee, 2019", "year_malformed", 0.9),
    }


def edits_of(paragraph, changes, peers):
    found = []
    for ch in changes:
        old, new = ch["old_names"], ch["new_names"]
        if sum(p["name"].lower() == old[0].lower() and p["year"].lower() == ch["old_year"].lower() for p in peers) > 1:
            continue
        names = re.escape(old[0]) + ("" if len(old) == 1 else r"\s+(?:and|&)\s+" + re.escape(old[1]) if len(old) == 2 else r"\s+et\s+al\.")
        for m in re.finditer(rf"(?<!\w){names}\s*(,\s*|\(\s*){re.escape(ch['old_year'])}\b(\s*\))?", paragraph, re.I):
            narrative = m[1].lstrip().startswith("(")
            text = new[0] if len(new) == 1 else (" and " if narrative else " & ").join(new) if len(new) == 2 else new[0] + " et al."
            text += (" (" if narrative else ", ") + ch["new_year"] + (m[2] or "")
            if text != m[0]:
                found.append((m.start(), -len(m[0]), ch["ref_idx"], m[0], text))
    out, end = [], 0
    for start, size, ref, original, text in sorted(found):
        if start >= end:
            out.append((start, original, text, ref))
            end = start - size
    return out


def applied(paragraph, edits):
    for start, original, text, _ in reversed(edits):
        paragraph = paragraph[:start] + text + paragraph[start + len(original) :]
    return paragraph


def test_tracked_edits(spark):
    t = Tables(spark, SF)
    changes, peers = Q._changes(t)
    by_doc, peers_of, copies = defaultdict(list), defaultdict(list), Counter()
    for c in changes.collect():
        by_doc[c["doc_id"]].append(c)
    for p in peers.collect():
        peers_of[p["doc_id"]].append(p)
    paragraphs = Q._manuscripts(t).collect()
    for p in paragraphs:
        copies[p["doc_id"], p["text"]] += 1
    want = {(p["doc_id"], p["para_idx"]): edits_of(p["text"], by_doc[p["doc_id"]], peers_of[p["doc_id"]]) if copies[p["doc_id"], p["text"]] == 1 else [] for p in paragraphs}
    got = defaultdict(list)
    for e in QUERIES["tracked_edits"](spark, SF).collect():
        got[e["doc_id"], e["para_idx"]].append((e["start"], e["original"], e["replacement"], e["ref_idx"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v} and len(got) > 20
    texts = {(p["doc_id"], p["para_idx"]): p["text"] for p in QUERIES["edited_paragraphs"](spark, SF).collect()}
    assert texts == {(p["doc_id"], p["para_idx"]): applied(p["text"], want[p["doc_id"], p["para_idx"]]) for p in paragraphs}


def test_overlapping_and_ambiguous_edits(spark):
    text = "Ama and Boadu (2001) say so, as does Boadu (2001); see (boadu, 2001), Adu et al., 2002a and (Kock (2003)). Boadusky, 2001. Ama  & Boadu, 2001"
    rows = [(0, ["Boadu"], "2001", ["Mensah", "Ofori"], "2001"), (1, ["Ama", "Boadu"], "2001", ["Lee", "Kim"], "2005b"), (2, ["Adu", "X", "Y"], "2002a", ["Adu"], "2002"), (3, ["Kock"], "2003", ["Kocks"], "2003"), (4, ["Kock"], "n.d.", ["Z"], "2003")]
    changes = spark.createDataFrame([(1, *r) for r in rows], "doc_id int, ref_idx int, old_names array<string>, old_year string, new_names array<string>, new_year string")
    peers = spark.createDataFrame([(1, "Kock", "2003"), (1, "kock", "2003"), (1, "Boadu", "2001"), (1, "Ama", "2001")], "doc_id int, name string, year string")
    p = spark.createDataFrame([(1, 0, text), (1, 1, "Boadu, 2001"), (1, 2, "Boadu, 2001"), (2, 0, text)], "doc_id int, para_idx int, text string")
    out = {(r["doc_id"], r["para_idx"]): r["text"] for r in X.edited(p, X.citation_edits(p, changes, peers)).collect()}
    assert out[1, 0] == "Lee and Kim (2005b) say so, as does Mensah and Ofori (2001); see (Mensah & Ofori, 2001), Adu, 2002 and (Kock (2003)). Boadusky, 2001. Lee & Kim, 2005b"
    assert out[1, 1] == out[1, 2] == "Boadu, 2001" and out[2, 0] == text


def test_places_of_passages(spark):
    text = "INTRODUCTION\n\nOne two three. Four\nfive six! Seven (8) nine.\n\n2.1 Methods of work\n\n" + "word " * 600 + "\n\nThe  END of\tit all. Here we go again, and on."
    cases = [(0, "four five  SIX"), (1, "seven (8) nine"), (2, "the end of it"), (3, "nowhere"), (4, ""), (5, None), (6, "xx INTRODUCTION xx"), (7, "Here we go again, and on."), (8, "2.1 methods")]
    passages = spark.createDataFrame([(1, i, x) for i, x in cases], "doc_id int, item_id int, passage string")
    got = {r["item_id"]: (r["page"], r["section"], r["paragraph"], r["sentence"]) for r in X.located(passages, spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")).collect()}
    lost = (None, "2.1 Methods of work", None, None)
    assert got == {
        0: (1, "INTRODUCTION", 2, 2), 1: (1, "INTRODUCTION", 2, 3), 2: (2, "2.1 Methods of work", 5, 1), 3: lost, 4: lost, 5: lost, 6: (1, "INTRODUCTION", 1, 1), 7: (2, "2.1 Methods of work", 5, 2), 8: (1, "2.1 Methods of work", 3, 1)
    }


@pytest.mark.parametrize("name", ["citation_suggestions", "tracked_edits"])
def test_keys_are_unique(spark, name):
    key = ["doc_id", "cite_idx"] if name == "citation_suggestions" else ["doc_id", "para_idx", "start"]
    assert QUERIES[name](spark, SF).groupBy(key).count().filter(F.col("count") > 1).count() == 0
