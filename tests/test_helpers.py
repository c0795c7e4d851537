"""Functions and readers without a query of their own, by literal cases."""

import datetime

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import claims as C
from marginalia.operators import dashboard as D
from marginalia.operators import extract as X
from marginalia.operators import references as R
from marginalia.sources import readers
from marginalia.streaming import windows as S


def test_jobs_index_and_csv(spark, tmp_path):
    (tmp_path / "jobs.jsonl").write_text('{"job_id": "a", "status": "done", "result": {"x": [1, 2]}}\n{"job_id": "b", "result": "text"}\nnot json\n')
    got = sorted(map(tuple, readers.read_jobs(spark, str(tmp_path / "jobs.jsonl")).collect()), key=str)
    assert got == [("a", "done", '{"x":[1,2]}'), ("b", None, "text"), (None, None, None)]
    events = spark.createDataFrame([("10.1/a", "retraction", 1), ("10.1/a", "retraction", 1), ("10.1/b", "correction", 2)], "doi string, event_type string, record_id int")
    for _ in range(2):  # written again, it is replaced
        readers.write_index(events, str(tmp_path / "index"), ["doi", "event_type"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "index")).collect())) == [("10.1/a", "retraction", 1), ("10.1/b", "correction", 2)]
    D.export_csv(spark.createDataFrame([(1, "a, b", None)], "x int, y string, z string").coalesce(1), ["y", "z"], str(tmp_path / "csv"))
    lines = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert lines[0] == "y,z" and lines[1].startswith('"a, b"') and len(lines) == 2


def test_superscripts_clusters_and_embedded_entries(spark):
    rows = spark.createDataFrame([(1, "Shown before¹² and also²,\u2009then^{3,5-7}."), (2, "none")], "doc_id int, text string")
    assert sorted(r["num"] for r in X.superscript_citations(rows).collect()) == [2, 3, 5, 6, 7, 12]
    one = spark.range(1).select(
        X.cluster_items(F.lit("(Ama, 2001; Boadu, 2002;)")).alias("c"), R.embedded_entries(F.lit("Ama, K. 2001. One. Boadu, L. 2002. Two.")).alias("e"), R.file_family(F.lit("My-Thesis_FINAL v3 (copy).DOCX")).alias("f"),
        R.purged(F.lit('{"text": "long", "words": "12", "refs": "3"}'), ["words", "refs"]).alias("p"), T.lookup_text(F.lit("On Rings: doi: 10.1/x https://a.b/c (2nd)")).alias("l"),
    ).first()
    assert one["c"] == ["Ama, 2001", "Boadu, 2002"] and one["e"] == ["Ama, K. 2001. One.", "Boadu, L. 2002. Two."]
    assert (one["f"], one["p"], one["l"]) == ("my thesis", '{"words":"12","refs":"3"}', "on rings 2nd")


def test_coach_and_authors(spark):
    paras = [(1, 0, 0, True, False), (1, 0, 1, True, True), (1, 1, 0, True, True), (1, 1, 1, True, False), (1, 2, 0, True, True), (2, 0, 0, True, True), (2, 0, 1, True, True)]
    got = C.coach(spark.createDataFrame(paras, "doc_id int, para_idx int, sent_idx int, is_claim boolean, cites boolean")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 2)]
    m = spark.createDataFrame([(["ama", "boadu"], ["boadu", "ama"])], "a array<string>, b array<string>").select(R.author_metrics(F.col("a"), F.col("b")).alias("m")).first()["m"]
    assert (m["overlap"], m["similarity"]) == (2, 100.0)


def test_sessions(spark):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    rows = spark.createDataFrame([(1, at(9, 0)), (1, at(9, 20)), (1, at(10, 0)), (2, at(9, 10))], "user_id int, ts timestamp")
    got = sorted((r["user_id"], r["start"].hour, r["n"]) for r in S.session_counts(rows).collect())
    assert got == [(1, 9, 2), (1, 10, 1), (2, 9, 1)]
