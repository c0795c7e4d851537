"""Providers, reference fields and context fit against literal cases."""

import json

from pyspark.sql import functions as F

from marginalia.operators import context as X
from marginalia.operators import fields as D
from marginalia.sources import providers

ITEMS = {
    "crossref": json.dumps({"DOI": "10.1/ABC", "title": ["On <i>rings</i> &amp; plates"], "issued": {"date-parts": [[2019, 3]]}, "author": [{"family": "O'Neil", "given": "A."}, {"family": "Boadu"}], "container-title": ["J. Rings"], "volume": "3", "issue": "2", "article-number": "e12", "publisher": "P", "type": "Journal-Article", "relation": {"is-retracted-by": [{"id": "x"}]}}),
    "openalex": json.dumps({"doi": "https://doi.org/10.1/x", "display_name": "T", "publication_year": 2020, "authorships": [{"author": {"display_name": "Ana María Brüggen"}}], "primary_location": {"source": {"display_name": "J"}}, "biblio": {"volume": "1", "issue": None, "first_page": "5"}, "is_retracted": True}),
    "datacite": json.dumps({"id": "10.5/z", "attributes": {"doi": "10.5/Z", "titles": [{"title": "Data"}], "publicationYear": 2018, "creators": [{"name": "Smith, Jo"}], "types": {"resourceTypeGeneral": "Dataset"}}}),
    "semantic_scholar": json.dumps({"externalIds": {"DOI": "10.2/s"}, "title": "S", "year": 2001, "authors": [{"name": "Jo Smith"}], "venue": "V", "journal": {"pages": "1-2"}}),
    "europepmc": json.dumps({"doi": "10.3/e", "title": "E.", "pubYear": "1999", "authorString": "Smith J, Adam AB and Lee K", "journalTitle": "EJ", "isRetracted": "Yes"}),
    "pubmed": json.dumps({"title": "P", "pubdate": "2004 Mar 3", "authors": [{"name": "Needham D"}], "fulljournalname": "PJ", "articleids": [{"idtype": "pubmed", "value": "7"}, {"idtype": "doi", "value": "10.4/p"}]}),
    "google_books": json.dumps({"volumeInfo": {"title": "B", "publishedDate": "2010-05", "authors": ["Jane Roe"], "publisher": "Pub", "printType": "BOOK"}}),
    "open_library": json.dumps({"title": "OL", "first_publish_year": 1950, "author_name": ["R. Roe"]}),
    "eric": json.dumps({"title": "ER", "publicationdateyear": 1988, "author": ["Poe, Edgar"], "source": "ERJ"}),
    "core": json.dumps({"title": "C", "yearPublished": 2012, "authors": [{"name": "Moe, M."}], "doi": "10.6/c"}),
    "doaj": json.dumps({"bibjson": {"title": "D", "year": "2013", "author": [{"name": "K. Koe"}], "identifier": [{"type": "doi", "id": "10.7/d"}], "journal": {"title": "DJ", "volume": "9"}}}),
    "arxiv": "<entry><title>A\n title</title><published>2021-01-02T00:00:00Z</published><author><name>Ada Loe</name></author><author><name>Bo Hoe</name></author><arxiv:doi xmlns:arxiv='x'>10.8/a</arxiv:doi></entry>",
    "unknown": "{}",
}


def test_providers_share_one_schema(spark):
    rows = [*ITEMS.items(), ("crossref", "not json"), ("crossref", None)]
    got = providers.catalog(spark.createDataFrame(rows, "source string, item string")).collect()
    assert len(got) == len(rows)
    by = {r["source"]: r for r in reversed(got)}
    fact = {s: (r["doi"], r["title"], r["year"], r["author"], r["is_retracted"]) for s, r in by.items()}
    assert fact == {
        "crossref": ("10.1/abc", "On rings & plates", 2019, "o'neil;boadu", True), "openalex": ("10.1/x", "T", 2020, "brüggen", True), "datacite": ("10.5/z", "Data", 2018, "smith", False), "semantic_scholar": ("10.2/s", "S", 2001, "smith", False),
        "europepmc": ("10.3/e", "E.", 1999, "smith;adam;lee", True), "pubmed": ("10.4/p", "P", 2004, "needham", False), "google_books": (None, "B", 2010, "roe", False), "open_library": (None, "OL", 1950, "roe", False),
        "eric": (None, "ER", 1988, "poe", False), "core": ("10.6/c", "C", 2012, "moe", False), "doaj": ("10.7/d", "D", 2013, "koe", False), "arxiv": ("10.8/a", "A title", 2021, "loe;hoe", False), "unknown": (None, "", None, "", False),
    }
    assert (by["crossref"]["pages"], by["crossref"]["type"], by["openalex"]["pages"], by["semantic_scholar"]["journal"]) == ("e12", "journal-article", "5", "V")


def test_fields_of_references(spark):
    texts = [
        "Smith, J. (2020a). A work on rings (2nd ed.). Big Press. https://doi.org/10.1000/abc.", "[3] Kock, N. 2015. Common bias. Journal of Rings, 12(4): 123–130.",
        "Pronovost P, Needham D. An intervention to decrease infections. N Engl J Med. 2006;355(26):2725-32.", "No date here", None,
    ]
    got = [r["fields"] for r in D.with_fields(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, reference string").coalesce(1)).orderBy("i").collect()]
    assert (got[0]["authors"], got[0]["year"], got[0]["title"], got[0]["edition"], got[0]["publisher"], got[0]["doi"], got[0]["kind"]) == ("Smith, J.", "2020a", "A work on rings", "2nd ed.", "Big Press", "10.1000/abc", "book")
    assert (got[1]["authors"], got[1]["title"], got[1]["source"], got[1]["volume"], got[1]["issue"], got[1]["pages"]) == ("Kock, N", "Common bias", "Journal of Rings", "12", "4", "123–130")
    assert (got[2]["title"], got[2]["source"], got[2]["year"], got[2]["volume"], got[2]["issue"], got[2]["pages"]) == ("An intervention to decrease infections", "N Engl J Med", "2006", "355", "26", "2725-32")
    assert got[3]["confidence"] == got[4]["confidence"] == "low"
    # (authors, year, title, source, volume, issue, pages, publisher, edition, doi, isbn, url, kind, confidence)
    more = {
        "Ama, K., & Boadu, J. K. (2019). On bias, again: a view of 2010. Journal of Rings and Plates, 3(1-2), e12.": ("Ama, K., & Boadu, J. K.", "2019", "On bias, again: a view of 2010", "Journal of Rings and Plates", "3", "1-2", "e12", "", "", "", "", "", "article", "high"),
        "World Bank. (n.d.). Doing business.": ("World Bank.", "n.d.", "Doing business", "", "", "", "", "", "", "", "", "", "report", "medium"),
        "(4) World Bank. 2015b. Doing business. Author. ISBN: 978-3-16-148410-0": ("World Bank", "2015b", "Doing business", "", "", "", "", "Author", "", "", "9783161484100", "", "book", "high"),
        "Adu, K. (2020). A title. Rings, 7, 4 – 9. doi: 10.5555/a.b; https://a.org/x.": ("Adu, K.", "2020", "A title", "Rings", "7", "", "4 – 9", "", "", "10.5555/a.b", "", "https://a.org/x", "article", "high"),
        "J. Monod, R. Yoshida. A thing of 1999. J Med. 2001; 12: 3-4.": ("J. Monod, R. Yoshida", "2001", "A thing of 1999", "J Med", "12", "", "3-4", "", "", "", "", "", "article", "high"),
        "": ("",) * 12 + ("unknown", "low"),
    }
    names = ("authors", "year", "title", "source", "volume", "issue", "pages", "publisher", "edition", "doi", "isbn", "url", "kind", "confidence")
    assert {t: tuple(D.parse_fields(t)[n] for n in names) for t in more} == more
    assert D.numeric_authors("J. Monod, R. Yoshida and K. Okeyoshi") == ["monod", "yoshida", "okeyoshi"] and D.numeric_authors("Pronovost P, Needham D, et al.") == ["pronovost", "needham"]
    assert D.numeric_entries("[1] One work 2001. [2] Two, see [7] too. [3] Three.") == ["[1] One work 2001.", "[2] Two, see [7] too.", "[3] Three."] and D.numeric_entries("no marks") == []


def test_styles_numbers_and_kinds(spark):
    row = spark.range(1).select(
        D.style_family(F.lit(" IEEE - Square/Bracket ")).alias("a"), D.style_family(F.lit("Nature")).alias("b"), D.style_family(F.lit("APA")).alias("c"), D.style_label(F.lit("numeric_round")).alias("d"),
        D.reference_number(F.lit("[12] Work"), F.lit(0)).alias("n1"), D.reference_number(F.lit("7) Work"), F.lit(0)).alias("n2"), D.reference_number(F.lit("Work 12."), F.lit(4)).alias("n3"),
        D.kind_flags(F.lit("Clinical handbook, ISBN 978-3-16-148410-0"), F.lit(None).cast("string"), F.lit("")).alias("k"), D.protocol_code(F.lit("UCC-2020/2021")).alias("p1"), D.protocol_code(F.lit("Smith, 2020")).alias("p2"),
        D.personal_communication(F.lit("KA, 12 March 2019")).alias("m1"), D.personal_communication(F.lit("HCP, 2023")).alias("m2"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"]) == ("numeric_square", "numeric_superscript", "author_year", "Numeric round bracket, Vancouver / ACS")
    assert (row["n1"], row["n2"], row["n3"], row["p1"], row["p2"], row["m1"], row["m2"]) == (12, 7, 5, True, False, True, False)
    assert row["k"]["has_isbn"] and row["k"]["looks_health"] and row["k"]["looks_book"] and not row["k"]["looks_arxiv"]


def test_context_fit(spark):
    schema = "i int, claim string, candidate string, abstract_terms int, metadata_relevance int, concepts array<string>, generic array<string>, subjects array<string>, topics array<string>, locations array<string>, sections array<string>, disciplines array<string>, populations array<string>, places array<string>"
    concepts = ["trust", "adoption", "banks", "study"]
    good = "trust affects adoption in banks a panel data study of firms in ghana"
    rows = [
        (1, "Trust affects adoption", good, 20, 60, concepts, ["study"], ["firms"], ["trust"], ["ghana"], [], [], [], []),
        (2, "Trust affects adoption", good, 3, 60, concepts, ["study"], ["firms"], ["trust"], ["ghana"], [], [], [], []),
        (3, "Trust affects adoption", "a study of something else", 20, 0, concepts, ["study"], [], [], ["ghana"], [], [], [], []),
        (4, "Trust affects adoption", "trust and adoption are correlated in banks", 20, 0, concepts, ["study"], [], [], [], [], [], [], []),
    ]
    got = {r["i"]: (r["score"], r["passes"], r["review"], r["label"], r["reasons"]) for r in X.context_fit(spark.createDataFrame(rows, schema)).collect()}
    # 40 + 12 + 16 + 12 + 8 (panel data) + 7 + 3
    assert got[1] == (98, True, False, "strong_structured_context_fit", [])
    assert got[2][1:] == (False, True, "manual_full_text_review_required", ["no_usable_abstract"])
    assert got[3][4] == ["few_specific_concepts", "generic_keywords_only", "location_not_found", "relationship_unconfirmed", "score_below_70"] and got[3][3] == "out_of_scope_or_general_keyword_match"
    # 30 + 12 + 0 + 12 + 0 + 0
    assert got[4][0] == 54 and "relationship_differs" in got[4][4]
    row = spark.range(1).select(X.title_relevance(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("c"), F.lit("d")), F.lit(1)).alias("r"), X.required_evidence(F.lit("A policy on firms")).alias("e"), X.required_evidence(F.lit("About 12 % of firms")).alias("q")).first()
    assert row["r"] == 22 + 8 and row["e"].startswith("primary legal") and row["q"].startswith("population-based")


def test_references_in_their_styles(spark):
    from marginalia.operators import references as R

    many = [f"A{i}, B." for i in range(1, 24)]
    rows = [
        ("apa7", ["Ama, K.", "Boadu, L."], "2001", "on rings: a view of iPads", "Ring Letters", "3", "1", "1–9", "doi:10.1/x", None, None), ("apa7", many, "", "On rings", "", "", "", "", None, "Big Press", "2nd"), ("apa7", ["World Bank"], "2020", "Doing", None, None, None, None, None, "World  Bank", "3rd ed."),
        ("apa6", many[:8], "2001", "T", "J", "3", "3", None, "https://doi.org/10.1/y", None, None), ("harvard", many[:3], "2001", "T", "J", "3", "3", "4", "10.1/z", None, None), ("harvard", many[:4], None, "a book", "", None, None, None, None, "Press", "2nd ed."),
        ("vancouver", many[:2], "2001", "T.", "J.", "3", "1", "4", "10.1/z", None, None), ("ieee", None, None, None, None, None, None, None, None, None, None), ("apa6", [], None, "", "J", None, None, None, None, None, None), ("apa7", [" "], None, None, "J", "4", None, "9", None, None, None),
    ]
    refs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, style string, authors array<string>, year string, title string, source string, volume string, issue string, pages string, doi string, publisher string, edition string")
    assert [r["reference"] for r in R.formatted(refs).orderBy("i").collect()] == [
        "Ama, K., & Boadu, L. (2001). On rings: A view of iPads. *Ring Letters*, *3*(1), 1–9. https://doi.org/10.1/x",
        ", ".join(many[:19]) + ", … A23, B. (n.d.). *On rings* (2nd ed.). Big Press.",
        "World Bank (2020). *Doing* (3rd ed.).",
        ", ".join(many[:6]) + ", … A8, B. (2001). T. *J*, *3*. doi:10.1/y",
        "A1, B., A2, B., and A3, B. (2001). 'T'. *J*, 3(3), pp. 4. doi:10.1/z",
        "A1, B. et al. (n.d.). *A book* (2nd ed.). Press.",
        "A1 B., A2 B. T. J. 2001;3(1):4. doi:10.1/z",
        "", "[Incomplete reference]", "[Incomplete reference]",
    ]
