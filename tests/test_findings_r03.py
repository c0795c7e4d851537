"""Cases that the findings of the third round name: results on odd texts, and rows that must not multiply."""

import duckdb
from pyspark.sql import functions as F

from marginalia.functions.similarity import most_alike, ratio
from marginalia.functions.tables import kept
from marginalia.operators import author_year as AY
from marginalia.operators import claims as C
from marginalia.operators import extract as X
from marginalia.operators import fixes as FX
from marginalia.operators import references as R
from marginalia.operators import resolve as S
from marginalia.operators import review as V
from marginalia.operators import verify as VE
from marginalia.plans import list_queries as _lists  # noqa: F401  registers queries
from marginalia.plans import more_queries as _more  # noqa: F401  registers queries
from marginalia.plans import queries as _plans  # noqa: F401  registers queries
from marginalia.plans.registry import ORACLES, QUERIES


def test_page_quality_takes_accented_letters_as_bounds(spark):
    texts = ["señ a b c ñy 5", "aó b c dé", "ñ1999é and ñ10.1234/xé", "a b c", "", "(é1999é)"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.quality for r in docs.select("doc_id", R.page_quality(docs.text).alias("quality")).collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert got == dict(c.execute(ORACLES["page_text_quality"]).fetchall())


def most_rows(spark, df) -> int:
    """The largest number of rows that any operator of a plan puts out."""
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    ran = store.executionsList().last()
    values, metrics = store.executionMetrics(ran.executionId()), ran.metrics()
    found = [0]
    for i in range(metrics.size()):
        m = metrics.apply(i)
        if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
            found.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return max(found)


def test_recovery_rows_do_not_multiply_by_entries_of_a_title(spark):
    rows = spark.range(2000).selectExpr("id AS doc_id", "1L AS ref_idx", "IF(id = 7, 'none', 'a title') AS title", "IF(id = 8, NULL, 2000) AS year")
    catalog = spark.range(2000).selectExpr("'a title' AS title", "CAST(1990 + id % 11 AS INT) AS year", "id AS cand_id")
    got = V.recovery_rows(rows, catalog)
    assert most_rows(spark, got) <= 10_000  # 4,000,000 pairs of rows and entries
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, []).append((r.rank, r.suggestion))
    assert sorted(found[3]) == [(1, "10"), (2, "21"), (3, "32")] and found[7] == [(0, "manual_search")]
    assert sorted(found[8]) == [(1, "0"), (2, "1"), (3, "2")]  # no year: all are equally near


def test_citations_meet_references_by_year_alone(spark):
    refs = spark.range(300).selectExpr("1L AS doc_id", "id AS ref_idx", "concat('Mensah, A. (', 1700 + id, '). On rings. Shelf 120015, 3(1), 1-9.') AS reference")
    cites = spark.createDataFrame([(1, i, f"(someone Mensah {1700 + i})", None) for i in range(200, 300)] + [(1, 400, "mensah, 2001", None), (1, 401, "ofori, 1950", 5), (1, 402, "mensah 2000", None), (1, 403, "on 2001", None)], "doc_id long, cite_idx long, citation string, default_ref long")
    got = {r.cite_idx: (r.ref_idx, r.tier) for r in VE.resolve_citations(cites, refs).collect()}
    assert got[401] == (5, "default") and got[250] == (None, "none")
    assert got[402] == (None, "none") and got[400] == (0, "author_year_inside")  # 2001 stands within 120015
    assert most_rows(spark, VE.resolve_citations(cites, refs)) < 3000  # pieces of three letters: 300 references offered over 15,000


def test_author_year_parses_each_distinct_string_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return AY.parse_citation(text)

    cites = spark.range(5000).selectExpr("id % 50 AS doc_id", "id AS cite_idx", "concat('Mensah, ', 1990 + id % 7) AS citation")
    got = AY._with_parts(cites, "citation", counted, "key string, year string")
    assert got.count() == 5000 and got.count() == 5000
    assert seen.value <= 14  # 7 strings, twice where a checkpoint is computed again; each branch of a plan parsed every row's batch


def test_records_that_tie_are_not_all_paired(spark):
    works = spark.range(40).selectExpr("CAST(id AS STRING) AS ref_key", "'rings of growth' AS title", "concat('name', id) AS author", "2000 AS year", "'shelf' AS journal", "IF(id % 4 = 0, concat('10.1/', id), NULL) AS doi", "'' AS volume", "'' AS issue", "'' AS pages")
    catalog = spark.range(600).selectExpr("id AS cand_id", "'rings of growth' AS title", "concat('name', id % 5) AS author", "CAST(2000 + id % 2 AS INT) AS year", "'shelf' AS journal", "IF(id % 7 = 0, NULL, concat('10.1/', id % 60)) AS doi", "'' AS volume", "'' AS issue", "'' AS pages", "IF(id % 3 = 0, 'eric', 'crossref') AS source", "1 AS agreement", "id % 11 = 0 AS is_retracted")
    plain = S.classified(S.scored(works, catalog, S.blocked(works, catalog)))
    for most, pick in ((1, S.best_candidates), (4, S.alternatives)):
        rows = lambda df: sorted((r.ref_key, r["rank"], r.cand_id, r.score, r.status) for r in df.collect())
        assert rows(pick(S.resolved(works, catalog, most))) == rows(pick(plain))
    assert most_rows(spark, S.resolved(works, catalog, 1)) < most_rows(spark, plain) / 2


SF = "/root/testdata/sf0.001"


def used(df, text: str) -> int:
    """How often a text stands in the plan of a query after all rules."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(text)


def test_words_of_a_signature_are_made_once(spark):
    assert used(QUERIES["shingle_signature"](spark, SF), "regexp_extract_all(") == 1


def test_pairs_of_passages_are_found_once(spark):
    assert used(QUERIES["passage_places"](spark, SF), "benchmark") == 0 and used(QUERIES["passage_places"](spark, SF), "transform(sequence") == 0
    plan = QUERIES["passage_places"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "seed" not in plan  # the pairs are written and read by three branches


def test_words_of_a_phrase_are_made_once(spark):
    plan = QUERIES["signature_overlap"](spark, SF)
    assert used(plan, "regexp_extract_all(") == 2 and used(plan, "md5(") == 0  # one for each side


def test_sentences_are_scored_once_and_pieces_miss_nothing(spark):
    assert used(QUERIES["citation_needed"](spark, SF), "retrieved from") == 1
    samples = ["p < 0.05", "12.5 per cent of", "7%", "a sub-saharan view", "the odds ratio is", "it is well established", "he is well", "often"]
    low = spark.createDataFrame([(x,) for x in samples], "s string")
    for _, patterns in C.NEEDED:
        for p in patterns:
            assert low.filter(C.found_in(low.s, p) != low.s.rlike(p)).count() == 0


def test_citations_of_texts_are_parsed_once(monkeypatch):
    seen, parse = [], AY.parse_citation
    monkeypatch.setattr(AY, "parse_citation", lambda text: seen.append(text) or parse(text))
    AY._is_citation.cache_clear()
    for _ in range(5):
        assert AY.citations_of("Mensah (2001) finds it. So it is (Ofori, 1999; Kock, 2015).") == ["Mensah, 2001", "Ofori, 1999", "Kock, 2015"]
    assert len(seen) == 3
    AY._is_citation.cache_clear()


def test_lists_of_vancouver_numbers_are_no_ranges(spark):
    texts = spark.createDataFrame([(1, "[1, 2] (3) [4 ,5,99999999999] [1] (2-4) []"), (2, None)], "doc_id long, text string")
    got = X.vancouver_counts(texts)
    assert {(r.doc_id, r.num): r.n for r in got.collect()} == {(1, 1): 2, (1, 2): 1, (1, 3): 1, (1, 4): 1, (1, 5): 1}
    assert used(got, "sequence(") == 0


def test_kept_tables_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.range(100).repartition(3).select(counted("id").alias("n"), F.when(F.col("id") > 4, F.array("id")).alias("a"))
    assert kept(rows).agg(F.sum("n"), F.sum(F.size("a"))).first() == (4950, 95)
    assert seen.value == 100  # a checkpoint counts its rows first
    assert kept(spark.range(3).select("id", F.lit(None).alias("none"))).filter("none is null").count() == 3


def test_verification_pairs_each_class_of_records_once(spark, monkeypatch):
    works = spark.range(30).selectExpr("CAST(id AS STRING) AS ref_key", "'rings of growth' AS title", "concat('name', id) AS author", "2000 AS year", "'shelf' AS journal", "IF(id % 3 = 0, concat('10.1/', id), NULL) AS doi", "'3' AS volume", "'' AS issue", "'' AS pages")
    catalog = spark.range(700).selectExpr("concat('c', id) AS cand_id", "'rings of growth' AS title", "concat('name', id % 5) AS author", "2001 AS year", "'shelf' AS journal", "concat('10.1/', id % 100) AS doi", "'3' AS volume", "'' AS issue", "'' AS pages", "IF(id % 2 = 0, 'crossref', 'openalex') AS source", "1 AS agreement", "id % 7 = 0 AS is_retracted")
    pairs, score = [], VE.scored
    monkeypatch.setattr(VE, "scored", lambda refs, records, found, *known: pairs.append(found.count()) or score(refs, records, found, *known))
    got = {r.ref_key: (r.status, r.cand_id, r.score) for r in VE.verified(works, catalog).collect()}
    assert sum(pairs) < 1500  # a title lookup alone paired 30 works with 350 records
    every = S.classified(S.scored(works, catalog, works.select("ref_key").crossJoin(catalog.select("cand_id"))))
    best = {r.ref_key: (r.status, r.score) for r in S.best_candidates(every).collect()}
    assert {k: (s, p) for k, (s, _, p) in got.items() if k not in "03"} == {k: v for k, v in best.items() if k not in "03"} and got["1"][1] == min(f"c{i}" for i in range(700) if i % 7 and i % 2 == 0)  # crossref is asked first; names have no digits, so all authors are alike


def test_likeness_known_ahead_is_that_of_the_pairs(spark):
    works = spark.createDataFrame([(str(i), t, a, 2000, j, None, "", "", "") for i, (t, a, j) in enumerate([("Rings of growth", "ama;boadu", "Shelf"), (None, None, None), ("plates", "", "Shelf of rings")])], "ref_key string, title string, author string, year int, journal string, doi string, volume string, issue string, pages string")
    catalog = works.select(F.concat(F.lit("c"), "ref_key").alias("cand_id"), *S.FIELDS, F.lit("eric").alias("source"), F.lit(1).alias("agreement"), F.lit(False).alias("is_retracted"))
    pairs, known = works.select("ref_key").crossJoin(catalog.select("cand_id")), S.known_likeness(works, catalog)
    assert set(known) == {"t", "j", "a"}
    columns = ["ref_key", "cand_id", *[to for _, _, to in S.METRICS], "score", "rejected"]
    assert sorted(map(tuple, S.scored(works, catalog, pairs, known).select(columns).collect())) == sorted(map(tuple, S.scored(works, catalog, pairs).select(columns).collect()))


def test_tables_of_the_plan_are_read_by_all_branches(spark):
    for name in ("plan_readiness", "revision_comparison", "certificate_clearance"):
        assert used(QUERIES[name](spark, SF), "p_name") == 0  # references meet part once, not in every branch


def test_changes_meet_paragraphs_with_their_year(spark):
    paras = spark.range(40).selectExpr("1L AS doc_id", "id AS para_idx", "IF(id = 7, 'So says Ama, 1967-8, it is', concat('It is so (Ama, ', 1960 + id, ')')) AS text")
    changes = spark.range(40).selectExpr("1L AS doc_id", "id AS ref_idx", "array('Ama') AS old_names", "CAST(1960 + id AS STRING) AS old_year", "array('Adu') AS new_names", "CAST(1960 + id AS STRING) AS new_year")
    got = FX.citation_edits(paras, changes, changes.selectExpr("doc_id", "old_names[0] AS name", "old_year AS year"))
    assert {(r.para_idx, r.ref_idx, r.replacement) for r in got.collect()} == {(i, i, f"Adu, {1960 + i}" + ("" if i == 7 else ")")) for i in range(40)}
    assert most_rows(spark, got) <= 400  # 1,600 pairs of the name alone


def test_a_citation_takes_the_most_alike_of_a_list(spark):
    cites = spark.range(300).selectExpr("1L AS doc_id", "id AS cite_idx", "concat('Mensah', id, 'x, 2010') AS citation", "concat('Mensah', id, 'x') AS author", "'2010' AS year")
    refs = spark.range(300).selectExpr("1L AS doc_id", "299 - id AS ref_idx", "concat('Mensah', id) AS author", "CAST(2008 + id % 5 AS STRING) AS year", "false AS et_al")
    got = FX.suggestions(cites, refs.withColumn("author", F.expr("IF(ref_idx = 299, 'Mensah7', author)")))  # 7 stands twice
    assert {(r.cite_idx, r.suggested, r.fix_type) for r in got.collect()} == {(i, best_of(i), "author_normalization_review") for i in range(300)}
    assert most_rows(spark, got) <= 3000  # 90,000 pairs of names


def best_of(i):
    """What cite i of the test above is taken for: the name most alike, of several the one of the least ref_idx."""
    names = {299 - n: f"mensah{7 if n == 0 else n}" for n in range(300)}
    return "M" + names[min(names, key=lambda r: (-ratio(f"mensah{i}x", names[r]), r))][1:] + ", 2010"


def test_most_alike_is_that_of_plain_loops(spark):
    rows = [("ama", ["boadu", "amas", None, "ams", "ama"]), ("ama", ["amas", "amat"]), (None, ["ama"]), ("ama", []), ("ama", None), ("ama", [None]), ("", ["", "a"]), ("kock", ["x", "y"])]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, r struct<a:string,b:array<string>>").repartition(1).select("i", most_alike("ratio", F.col("r.a"), F.col("r.b")).alias("m"))
    got = {r.i: tuple(r.m) for r in df.collect()}
    want = {}
    for i, (a, texts) in enumerate(rows):
        scores = [-1 if t is None or a is None else ratio(a, t) for t in texts or []]
        want[i] = (max(scores), scores.index(max(scores))) if scores and max(scores) >= 0 else (None, None)
    assert got == want


def test_blocks_of_an_audit_are_read_once(spark):
    blocks = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_orderkey AS doc_id", "l_linenumber AS block_idx", "'Table 1. Growth' AS text")
    for audit in (X.table_audit(blocks), X.audit_findings(blocks)):
        plan = audit._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1 and "Join " not in plan and "l_linenumber" in plan


def test_audit_of_skipped_and_lost_documents(spark):
    rows = [
        *[(1, i, t) for i, t in enumerate(["List of tables", "Table 1. Growth", "See Table 4."])], *[(2, i, t) for i, t in enumerate(["Table 2. A", "Table 5. B", "Table 9. C", "Figure 1. D", "Figure 3. E", "See Table 2 and Figure 5."])],
        *[(None, i, t) for i, t in enumerate(["Table 1. A", "Table 1. B", "See Table 7 and Figure 1."])], (3, 0, None),
    ]
    blocks = spark.createDataFrame(rows, "doc_id int, block_idx int, text string")
    assert {tuple(r) for r in X.table_audit(blocks).collect()} == {(1, 0, 0, 0, 0, 0, 0), (2, 3, 2, 4, 1, 2, 8), (None, 0, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0, 0)}
    got = sorted((r.doc_id or 0, r.type, r.block_idx, r.kind, r.number) for r in X.audit_findings(blocks).fillna({"block_idx": -1, "number": ""}).collect())
    assert got == [
        (0, "missing_target", 2, "figure", "1"), (0, "missing_target", 2, "table", "7"), (0, "numbering_sequence", -1, "table", ""), (2, "first_mention_after", 0, "table", "2"), (2, "label_mismatch", 5, "figure", "5"), (2, "numbering_sequence", -1, "figure", ""), (2, "numbering_sequence", -1, "table", ""),
        (2, "unreferenced", 1, "table", "5"), (2, "unreferenced", 2, "table", "9"), (2, "unreferenced", 3, "figure", "1"), (2, "unreferenced", 4, "figure", "3"),
    ]
