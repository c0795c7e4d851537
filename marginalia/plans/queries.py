"""Queries over the derived tables, one for each operator, with the SQL that DuckDB checks them by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.similarity import similarity
from marginalia.functions.tables import dealt, kept
from marginalia.operators import author_year as AY
from marginalia.operators import certificate as CE
from marginalia.operators import claims as C
from marginalia.operators import dashboard as D
from marginalia.operators import events as E
from marginalia.operators import extract as X
from marginalia.operators import integrity as I
from marginalia.operators import ledger as L
from marginalia.operators import plan as P
from marginalia.operators import reconcile as R
from marginalia.operators import resolve as S
from marginalia.operators import review as V
from marginalia.operators import voice as VO
from marginalia.plans.registry import Tables, query

YEAR = 2020
DAY = "1996-06-30"


def _day():
    return F.lit(DAY).cast("date")


def _dated(df: DataFrame) -> DataFrame:
    """Dates as text, which both engines print alike."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


# --- reconciliation
@query("""SELECT doc_id, sum(c)::BIGINT AS citations, count(*) FILTER (c > 0) AS distinct_cited, count(*) FILTER (c > 0 AND r > 0) AS matched, count(*) FILTER (c > 0 AND r = 0) AS missing,
  count(*) FILTER (c = 0 AND r > 0) AS uncited, count(*) FILTER (r > 0) AS "references", round(coalesce(count(*) FILTER (c > 0 AND r > 0) * 100.0::DOUBLE / nullif(count(*) FILTER (c > 0), 0), 0.0), 4) AS match_rate
  FROM (SELECT doc_id, num, sum(c) AS c, max(r) AS r FROM (SELECT doc_id, num, 1 AS c, 0 AS r FROM {cites} UNION ALL SELECT doc_id, num, 0, 1 FROM {refs}) GROUP BY 1, 2) GROUP BY 1""")
def match_summary(t: Tables) -> DataFrame:
    return R.match_summary(t.cites, t.refs)


@query("""SELECT c.doc_id, pos, c.num, coalesce(r.ref_idx, -1) AS ref_idx, CASE WHEN r.ref_idx IS NULL THEN 'missing' ELSE 'matched' END AS status FROM {cites} c LEFT JOIN (SELECT doc_id, num, max(ref_idx) AS ref_idx FROM {refs} GROUP BY 1, 2) r ON c.doc_id = r.doc_id AND c.num = r.num""")
def reconcile_numeric(t):
    return R.reconcile_numeric(t.cites, t.refs).na.fill(-1, ["ref_idx"])


@query("""SELECT doc_id, num, count(*) AS count_in_text, min(pos) AS first_pos FROM {cites} c WHERE NOT EXISTS (SELECT 1 FROM {refs} r WHERE r.doc_id = c.doc_id AND r.num = c.num) GROUP BY 1, 2""")
def missing_citations(t):
    return R.missing_citations(t.cites, t.refs)


@query("""SELECT doc_id, ref_idx, num FROM {refs} r WHERE NOT EXISTS (SELECT 1 FROM {cites} c WHERE r.doc_id = c.doc_id AND r.num = c.num)""")
def uncited_references(t):
    return R.uncited_references(t.cites, t.refs)


@query("""SELECT r.doc_id, ref_idx, coalesce(n, 0) AS times_cited, coalesce(array_to_string(p[1:6], ','), '') AS cited_by FROM {refs} r LEFT JOIN
  (SELECT doc_id, num, count(*) AS n, list_sort(list_distinct(list(pos))) AS p FROM {cites} GROUP BY 1, 2) c ON r.doc_id = c.doc_id AND r.num = c.num""")
def times_cited(t):
    return R.times_cited(t.cites, t.refs)


@query("""SELECT doc_id, alias, coalesce(max(ref_idx) FILTER (prefer), min(ref_idx)) AS ref_idx FROM (SELECT doc_id, ref_idx, author || '|' || year AS alias, false AS prefer FROM {fields} UNION ALL
  SELECT doc_id, ref_idx, substr(author, 1, 6) || '|' || year, true FROM {fields}) GROUP BY 1, 2""")
def alias_keys(t):
    return R.alias_keys(t.fields)


_AY = """SELECT c.doc_id, c.author, c.year, n, coalesce(k, 0) AS n_candidates, ref_idx, CASE WHEN k IS NULL THEN 'missing' WHEN k > 1 THEN 'ambiguous_same_author_year' ELSE 'matched' END AS flag
  FROM (SELECT doc_id, author, year, count(*) AS n FROM {ay_cites} GROUP BY ALL) c LEFT JOIN (SELECT doc_id, author, year, count(*) AS k, min(ref_idx) AS ref_idx FROM {fields} GROUP BY ALL) f
  ON c.doc_id = f.doc_id AND c.author = f.author AND c.year = f.year"""


@query(f"SELECT * REPLACE (coalesce(ref_idx, -1) AS ref_idx) FROM ({_AY})")
def reconcile_author_year(t):
    return R.reconcile_author_year(t.ay_cites, t.fields).na.fill(-1, ["ref_idx"])


_OTHER = f"""SELECT m.doc_id, m.author, m.year, f.ref_idx, (100 - least(abs(m.year - f.year) * 4, 24))::INT AS score FROM ({_AY}) m JOIN {{fields}} f ON m.doc_id = f.doc_id AND m.author = f.author
  AND abs(m.year - f.year) <= 5 WHERE m.flag = 'missing' QUALIFY row_number() OVER (PARTITION BY m.doc_id, m.author, m.year ORDER BY abs(m.year - f.year), f.ref_idx) = 1"""


@query(_OTHER)
def possible_other_year(t):
    return R.other_year(R.reconcile_author_year(t.ay_cites, t.fields).filter("flag = 'missing'"), t.fields)


@query(f"""SELECT m.doc_id, count(*) FILTER (p.ref_idx IS NOT NULL) AS possible, count(*) FILTER (p.ref_idx IS NULL) AS missing FROM ({_AY}) m LEFT JOIN ({_OTHER}) p
  ON m.doc_id = p.doc_id AND m.author = p.author AND m.year = p.year WHERE m.flag = 'missing' GROUP BY 1""")
def split_missing(t):
    missing = R.reconcile_author_year(t.ay_cites, t.fields).filter("flag = 'missing'")
    return R.split_missing(missing, R.other_year(missing, t.fields))


@query("""SELECT coalesce(r.doc_id, c.doc_id) AS doc_id, coalesce(r.num, c.num) AS num, coalesce(ref_idx, -1) AS ref_idx, coalesce(times, 0) AS times FROM {refs} r FULL JOIN (SELECT doc_id, num, count(*) AS times FROM {cites} GROUP BY 1, 2) c
  ON r.doc_id = c.doc_id AND r.num = c.num""")
def reference_to_intext(t):
    return R.reference_to_intext(t.cites, t.refs).na.fill(-1, ["ref_idx"])


# --- author-year strings
def _author_year(t):
    return AY.parsed_citations(t.ay_strings), AY.parsed_references(t.ref_strings)


@query()
def author_year_edges(t):
    """Every citation string with its reference by alias, ambiguity or likeness."""
    return AY.reconcile(*_author_year(t)).na.fill(-1, ["ref_idx"])


@query()
def author_year_summary(t):
    cites, refs = _author_year(t)
    edges = kept(AY.reconcile(cites, refs).drop("citation"))
    return AY.summary(edges, AY.reference_counts(edges, cites, refs))


@query()
def author_year_possible(t):
    cites, refs = _author_year(t)
    missing = cites.join(AY.reconcile(cites, refs).filter("flag = 'missing'").select("doc_id", "cite_idx"), ["doc_id", "cite_idx"], "left_semi")
    return AY.possible_matches(missing, refs)


@query()
def author_year_extract(t):
    """Citations in running texts: the narrative and the bracketed ones of each part of a document."""
    name = F.concat(F.upper(F.substring("author", 1, 1)), F.substring("author", 2, 40))
    form = F.when(F.col("pos") % 3 == 0, F.concat(name, F.lit(" ("), F.col("year"), F.lit(") finds growth"))).when(F.col("pos") % 3 == 1, F.concat(F.lit("Growth is slow ("), name, F.lit(" & Boadu, "), F.col("year"), F.lit(")"))).otherwise(F.concat(F.lit("It holds ("), name, F.lit(" et al., "), F.col("year"), F.lit("; Kock, 2015)")))
    parts = t.ay_cites.groupBy("doc_id", F.floor(F.col("pos") / 200).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", form.alias("s")))), lambda x: x["s"]), ". ").alias("text"))
    found = AY.extract(parts.select(F.concat_ws(":", "doc_id", "part").alias("doc_id"), "text"))
    return found.select(F.col("doc_id").alias("part_id"), "cite_idx", "citation")


@query("""SELECT doc_id, alias, coalesce(max(ref_idx) FILTER (prefer), min(ref_idx)) AS ref_idx FROM (SELECT doc_id, ref_idx, author || '|' || year AS alias, false AS prefer FROM {fields} UNION ALL SELECT doc_id, ref_idx, 'boadu|' || year, false FROM {fields} WHERE ref_idx % 3 = 0
  UNION ALL SELECT doc_id, ref_idx, author || x || year, true FROM {fields}, (SELECT unnest(['+boadu|', '+etal|']) AS x) WHERE ref_idx % 3 = 0 UNION ALL SELECT doc_id, ref_idx, 'boadu+' || author || '|' || year, true FROM {fields} WHERE ref_idx % 3 = 0) GROUP BY 1, 2""")
def author_year_aliases(t):
    return AY.aliases(AY.parsed_references(t.ref_strings))


# --- publication events
_INDEX = """SELECT DISTINCT doi, event_type, event_date, record_id FROM (SELECT '10.1000/' || regexp_extract(link, '10[.]1000/([0-9]+)', 1) AS doi,
  CASE WHEN label = 'Reinstatement' THEN 'reinstatement' WHEN label = 'Expression_of_Concern' THEN 'expression_of_concern' WHEN label = 'Retraction' THEN 'retraction' WHEN label = 'Withdrawal' THEN 'withdrawal' WHEN label = 'Corrigendum' THEN 'correction' ELSE 'other_update' END AS event_type,
  event_date, record_id FROM {raw_events}) QUALIFY row_number() OVER (PARTITION BY event_type, doi, event_date ORDER BY record_id) = 1"""


@query(_INDEX)
def event_index(t):
    return E.event_index(t.raw_events)


_FOLD = f"""SELECT doi, list_reduce(list_prepend('clear', list(event_type ORDER BY coalesce(nullif(event_date, ''), '9999'), CASE event_type WHEN 'expression_of_concern' THEN 1 WHEN 'correction' THEN 2 WHEN 'retraction' THEN 3 WHEN 'withdrawal' THEN 3 WHEN 'reinstatement' THEN 4 ELSE 5 END, event_type)),
  lambda s, t: CASE WHEN t = 'retraction' THEN 'retracted' WHEN t = 'withdrawal' THEN 'withdrawn' WHEN t = 'reinstatement' THEN 'reinstated' WHEN t = 'expression_of_concern' AND s NOT IN ('retracted', 'withdrawn') THEN 'expression_of_concern' WHEN t = 'correction' AND s = 'clear' THEN 'corrected' ELSE s END) AS s,
  count(*) AS k FROM ({_INDEX}) GROUP BY 1"""


@query(f"""SELECT doc_id, ref_idx, CASE WHEN f.doi IN ('10.1000/3', '10.1000/77') AND s IS NOT NULL THEN 'publication_notice' ELSE coalesce(s, 'clear') END AS publication_status, coalesce(k, 0) AS event_count FROM {{fields}} f LEFT JOIN ({_FOLD}) e ON e.doi = f.doi""")
def publication_status(t):
    notices = t.spark.createDataFrame([("10.1000/3",), ("10.1000/77",)], "doi string")
    return E.publication_status(t.fields, E.event_index(t.raw_events), notices)


@query("""SELECT doc_id, count(*) AS total, count(*) FILTER (publication_status IN ('retracted', 'withdrawn')) AS retracted_or_withdrawn, count(*) FILTER (publication_status = 'expression_of_concern') AS expression_of_concern,
  count(*) FILTER (publication_status = 'corrected') AS corrected, count(*) FILTER (publication_status = 'reinstated') AS reinstated, count(*) FILTER (publication_status = 'publication_notice') AS publication_notice,
  count(*) FILTER (publication_status = 'clear' AND event_count > 0) AS other_update, count(*) FILTER (publication_status = 'clear' AND event_count = 0) AS no_recorded_event, count(*) FILTER (publication_status <> 'unchecked') AS checked,
  count(*) FILTER (publication_status = 'unchecked') AS unchecked, bool_and(publication_status <> 'unchecked') AS complete FROM {verification} GROUP BY 1""")
def publication_summary(t):
    return E.publication_summary(t.verification)


@query(f"""WITH v AS (SELECT *, coalesce(lower(doi), replace(lower(ref_doi), 'https://doi.org/', '')) AS k, replace(lower(coalesce(ref_doi, '')), 'https://doi.org/', '') AS own FROM {{verification}}), w AS (SELECT *, min(ref_idx) OVER (PARTITION BY doc_id, k) AS first_idx FROM v),
  risks AS (SELECT doc_id, 'metadata_not_found' AS risk, 'important' AS priority FROM w WHERE status = 'not_found'
  UNION ALL SELECT doc_id, CASE WHEN publication_status IN ('retracted', 'withdrawn') THEN 'retracted_or_withdrawn' WHEN publication_status = 'expression_of_concern' THEN 'expression_of_concern' WHEN publication_status = 'publication_notice' THEN 'publication_notice'
    WHEN publication_status = 'corrected' THEN 'corrected_publication' WHEN publication_status = 'reinstated' THEN 'reinstated_publication' WHEN publication_status = 'unchecked' THEN 'publication_status_unchecked' ELSE 'other_publication_update' END,
    CASE WHEN publication_status IN ('retracted', 'withdrawn', 'expression_of_concern') THEN 'critical' WHEN publication_status IN ('corrected', 'unchecked') THEN 'important' ELSE 'optional' END FROM w WHERE publication_status <> 'clear' OR event_count > 0
  UNION ALL SELECT doc_id, 'corrected_or_superseded', 'important' FROM w WHERE update_type = 'Erratum' AND publication_status NOT IN ('corrected', 'reinstated', 'publication_notice')
  UNION ALL SELECT doc_id, 'older_source', 'optional' FROM w WHERE {YEAR} - year > 10 UNION ALL SELECT doc_id, 'non_scholarly_source', 'important' FROM w WHERE source_type = 'Blog' UNION ALL SELECT doc_id, 'doi_mismatch', 'critical' FROM w WHERE own <> '' AND own <> doi
  UNION ALL SELECT doc_id, 'duplicate_publication_entry', 'important' FROM w WHERE ref_idx > first_idx UNION ALL SELECT doc_id, 'journal_on_configured_review_list', 'critical' FROM w WHERE lower(journal) IN ('economy', 'economy brushed steel')
  UNION ALL SELECT doc_id, 'reference_link_unavailable', 'optional' FROM w WHERE link_status = '404')
  SELECT doc_id, risk, priority, count(*) AS n FROM risks GROUP BY ALL""")
def source_risks(t):
    return E.source_risks(t.verification, YEAR, ("economy", "economy brushed steel"))


# --- integrity
_SUM = """SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'likely') AS likely, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'not_found') AS not_found,
  count(*) FILTER (status = 'offline') AS offline, round(sum(CASE status WHEN 'verified' THEN 1.0::DOUBLE WHEN 'likely' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*) * 100 + 1e-9, 2) AS integrity FROM {verification} GROUP BY 1"""
_DIV = """SELECT doc_id, coalesce(round((1.0::DOUBLE - least(1.0::DOUBLE, sum(c * c)::DOUBLE / (sum(c) * sum(c)) * 5)) * 100, 2), 100.0) AS concentration,
  coalesce(round((ln(sum(c)::DOUBLE) - sum(c * ln(c::DOUBLE)) / sum(c)) / CASE WHEN count(*) > 1 THEN ln(count(*)::DOUBLE) ELSE 1.0 END * 100, 2), 0.0) AS diversity
  FROM (SELECT doc_id, a, count(*) AS c FROM (SELECT doc_id, trim(unnest(string_split(author, ','))) AS a FROM {verification}) WHERE a <> '' GROUP BY 1, 2) GROUP BY 1"""
_TEMP = """SELECT doc_id, b AS balance, r AS recency, round(r * 0.6::DOUBLE + b * 0.4::DOUBLE + 1e-9, 2) AS quality FROM (SELECT doc_id, round(1e-9 + CASE WHEN count(year) < 2 THEN 50.0::DOUBLE ELSE least(1.0::DOUBLE, (max(year) - min(year)) / 20.0::DOUBLE) * 100 END, 2) AS b,
  round(avg(CASE WHEN 2020 - year <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 + 1e-9, 2) AS r FROM {verification} GROUP BY 1)"""


@query(_SUM)
def verification_summary(t):
    return I.verification_summary(t.verification)


@query(_DIV)
def concentration_and_diversity(t):
    return I.concentration_and_diversity(t.verification)


@query(_TEMP)
def temporal_quality(t):
    return I.temporal(t.verification, YEAR)


_INTEGRITY = f"""SELECT doc_id, raw AS raw_index, CASE WHEN open THEN NULL ELSE least(raw, CASE WHEN ret THEN 49.0 WHEN con THEN 59.0 WHEN cor THEN 79.0 ELSE 100.0 END::DOUBLE) END AS index,
  CASE WHEN open THEN 'Incomplete Integrity Coverage' WHEN ret THEN 'Critical Review' WHEN con THEN 'Review Required' WHEN cor THEN 'Qualified' WHEN rei THEN 'Verified with History' WHEN raw >= 90 THEN 'Excellent' WHEN raw >= 80 THEN 'Very Good' WHEN raw >= 70 THEN 'Good' WHEN raw >= 60 THEN 'Moderate' WHEN raw >= 50 THEN 'Weak' ELSE 'Poor' END AS category
  FROM (SELECT s.doc_id, round(integrity * 0.35::DOUBLE + concentration * 0.2::DOUBLE + diversity * 0.2::DOUBLE + quality * 0.25::DOUBLE + 1e-9, 2) AS raw, ret, con, cor, rei, open FROM ({_SUM}) s JOIN ({_DIV}) d ON s.doc_id = d.doc_id JOIN ({_TEMP}) q ON q.doc_id = s.doc_id
  JOIN (SELECT doc_id, bool_or(publication_status IN ('retracted', 'withdrawn')) AS ret, bool_or(publication_status = 'expression_of_concern') AS con, bool_or(publication_status = 'corrected') AS cor, bool_or(publication_status = 'reinstated') AS rei,
  bool_or(publication_status = 'unchecked' OR status = 'offline' OR NOT attempted) AS open FROM {{verification}} GROUP BY 1) f ON f.doc_id = s.doc_id)"""


@query(_INTEGRITY)
def integrity_index(t):
    return I.integrity_index(t.verification, YEAR)


@query("""SELECT e.doc_id, expected, coalesce(processed, 0) AS processed, coalesce(matched, 0) AS matched, greatest(expected - coalesce(processed, 0), 0) AS pending, (coalesce(processed, 0) * 100 // expected)::BIGINT AS percentage,
  CASE WHEN coalesce(processed, 0) >= expected THEN 'completed' ELSE 'incomplete' END AS state FROM (SELECT doc_id, count(*) AS expected FROM {refs} GROUP BY 1) e LEFT JOIN
  (SELECT doc_id, count(*) FILTER (attempted) AS processed, count(*) FILTER (status IN ('verified', 'likely') AND attempted) AS matched FROM {verification} WHERE status <> 'offline' GROUP BY 1) d ON e.doc_id = d.doc_id""")
def coverage(t):
    return I.coverage(t.refs, t.verification.filter("status <> 'offline'"))


@query("""SELECT r.doc_id, r.ref_idx, coalesce(status, 'offline') AS status, status IS NULL AS missing_result FROM {refs} r LEFT JOIN (SELECT * FROM {verification} WHERE attempted) v ON r.doc_id = v.doc_id AND r.ref_idx = v.ref_idx""")
def with_outcomes(t):
    return I.with_outcomes(t.refs, t.verification.filter("attempted"))


@query("""WITH a AS (SELECT doc_id, num, pos, row_number() OVER (PARTITION BY doc_id, num ORDER BY pos) AS occurrence FROM (SELECT DISTINCT doc_id, num, pos FROM {cites})),
  b AS (SELECT doc_id, num, ref_idx AS other, row_number() OVER (PARTITION BY doc_id, num ORDER BY ref_idx) AS occurrence FROM {refs})
  SELECT a.doc_id, a.num, a.occurrence::INT AS occurrence, a.pos, coalesce(b.other, -1) AS other FROM a LEFT JOIN b USING (doc_id, num, occurrence)""")
def occurrence_join(t):
    a = t.cites.select("doc_id", "num", "pos").distinct()
    b = t.refs.withColumnRenamed("ref_idx", "other")
    return I.occurrence_join(a, b, ["doc_id", "num"], ["pos"], ["other"]).na.fill(-1, ["other"])


# --- ledger
_USABLE = f"available_at <= DATE '{DAY}' AND (expires_at IS NULL OR expires_at > DATE '{DAY}')"


@query(f"SELECT account_id, sum(remaining)::BIGINT AS balance, count(*) AS lots FROM {{lots}} WHERE {_USABLE} GROUP BY 1")
def balances(t):
    return L.balances(t.lots, _day())


_FIFO = f"""SELECT account_id, lot_id, units::BIGINT AS units FROM (SELECT account_id, lot_id, greatest(0, least(remaining, 20 - coalesce(sum(remaining) OVER (PARTITION BY account_id ORDER BY expires_at NULLS LAST, available_at, lot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS units,
  sum(remaining) OVER (PARTITION BY account_id) AS whole FROM {{lots}} WHERE {_USABLE}) WHERE whole >= 20 AND units > 0"""


@query(_FIFO)
def fifo_spend(t):
    return L.fifo_spend(t.lots, 20, _day())


@query(f"""SELECT account_id, lot_id, surplus::BIGINT AS surplus FROM (SELECT account_id, lot_id, remaining - greatest(0, least(remaining, 12 - coalesce(sum(remaining) OVER (PARTITION BY account_id ORDER BY available_at DESC, lot_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS surplus
  FROM {{lots}} WHERE {_USABLE}) WHERE surplus > 0""")
def rollover_surplus(t):
    return L.rollover_surplus(t.lots, 12, _day())


@query(f"""SELECT order_id, account_id, k::BIGINT AS month_no, (starts_at + to_months(k::INT))::DATE::VARCHAR AS due_at, (starts_at + to_months(k::INT + 1))::DATE::VARCHAR AS ends_at, credits FROM (SELECT *, unnest(range(0, months)) AS k FROM {{plans}} WHERE status = 'paid') WHERE (starts_at + to_months(k::INT))::DATE <= DATE '{DAY}'""")
def release_schedule(t):
    return _dated(L.release_schedule(t.plans, _day()))


@query(f"""SELECT account_id, order_id, e::VARCHAR AS ends_at FROM (SELECT *, (starts_at + to_months(months))::DATE AS e FROM {{plans}} WHERE status = 'paid') WHERE starts_at <= DATE '{DAY}' AND e > DATE '{DAY}' QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY e DESC, order_id DESC) = 1""")
def active_plan(t):
    return _dated(L.active_plan(t.plans, _day()))


@query("""SELECT DISTINCT o_custkey AS account_id, o_orderpriority AS event FROM {orders} WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM (SELECT o_custkey AS a, o_orderpriority AS e FROM {orders} WHERE o_orderstatus = 'F') l WHERE l.a = o_custkey AND l.e = o_orderpriority)""")
def insert_once(t):
    rows = t.orders.select(F.col("o_custkey").alias("account_id"), F.col("o_orderpriority").alias("event"), "o_orderstatus")
    return L.insert_once(rows.filter("o_orderstatus = 'F'"), rows.filter("o_orderstatus <> 'F'").drop("o_orderstatus"), ["account_id", "event"])


@query("""SELECT account_id, job_id, status FROM {jobs} QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC, job_id DESC) = 1""")
def latest_per_key(t):
    return L.latest(t.jobs.select("account_id", "job_id", "status", "created_at"), ["account_id"], [F.col("created_at").desc(), F.col("job_id").desc()]).drop("created_at")


@query(f"""SELECT s.lot_id, s.account_id, s.units, CASE WHEN expires_at <= DATE '1996-09-30' THEN 'reissued' ELSE 'returned' END AS how, CASE WHEN expires_at <= DATE '1996-09-30' THEN '1996-10-30' ELSE coalesce(expires_at::VARCHAR, '') END AS new_expiry FROM ({_FIFO}) s JOIN {{lots}} l ON l.lot_id = s.lot_id""")
def refunds(t):
    return _dated(L.refunds(L.fifo_spend(t.lots, 20, _day()), t.lots, F.lit("1996-09-30").cast("date"))).na.fill("", ["new_expiry"])


@query("""SELECT user_id, (floor(epoch(ts))::BIGINT // 3600 * 3600)::BIGINT AS bucket, count(*) AS n, count(*) > 2 AS limited FROM {events} GROUP BY 1, 2""")
def rate_buckets(t):
    return L.rate_buckets(t.events, 3600, 2)


# --- dashboards
_METRICS = """SELECT job_id, status, coalesce((result::JSON ->> '$.summary.word_count')::BIGINT, 0) AS words, CASE WHEN coalesce((result::JSON ->> '$.summary.reference_entries_found')::BIGINT, 0) > 0 THEN (result::JSON ->> '$.summary.reference_entries_found')::BIGINT ELSE 2 END AS "references",
  (result::JSON ->> '$.acii.score')::DOUBLE AS score, (result::JSON ->> '$.paid')::BOOLEAN AS paid FROM {jobs}"""


@query(_METRICS)
def job_metrics(t):
    return D.job_metrics(t.jobs)


@query("""SELECT count(*) AS jobs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'failed') AS failed, min(created_at)::DATE::VARCHAR AS first_day, max(created_at)::DATE::VARCHAR AS last_day,
  round(avg(nullif(processing_time, 0)) FILTER (status = 'completed'), 4) AS avg_seconds, round(count(*) FILTER (status = 'completed')::DOUBLE / nullif(count(*) FILTER (status IN ('completed', 'failed')), 0), 6) AS success_rate FROM {jobs}""")
def status_rollup(t):
    return _dated(D.status_rollup(t.jobs))


@query("""SELECT created_at::DATE::VARCHAR AS day, count(*) AS jobs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, round(avg(nullif(processing_time, 0)) + 1e-7, 4) AS avg_seconds FROM {jobs} GROUP BY 1""")
def daily_rollup(t):
    return _dated(D.daily_rollup(t.jobs))


@query("""SELECT day::VARCHAR AS day, greatest(coalesce(a, 0), coalesce(b, 0)) AS n FROM (SELECT o_orderdate::DATE AS day, count(*) AS a FROM {orders} GROUP BY 1) x FULL JOIN (SELECT l_shipdate::DATE AS day, count(*) AS b FROM {lineitem} WHERE l_linenumber = 1 GROUP BY 1) y USING (day)""")
def daily_overlay(t):
    a = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    b = t.lineitem.filter("l_linenumber = 1").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return _dated(D.overlay_daily(a, b))


@query("""SELECT job_id, item, result::JSON ->> ('$.decisions.' || item || '.decision') AS decision FROM {jobs}, (SELECT unnest(['a', 'b']) AS item) WHERE result::JSON ->> '$.decisions' IS NOT NULL""")
def json_decisions(t):
    return D.decisions(t.jobs)


@query("""SELECT job_id, result::JSON ->> ('$.decisions.' || item || '.decision') AS value, count(*) AS n FROM {jobs}, (SELECT unnest(['a', 'b']) AS item) WHERE result::JSON ->> '$.decisions' IS NOT NULL GROUP BY 1, 2""")
def all_decisions(t):
    return D.all_decisions(t.jobs)


@query(f"""SELECT sum(words)::BIGINT AS words, sum("references")::BIGINT AS "references", round(avg(score), 4) AS avg_score, count(*) FILTER (paid) AS paid FROM ({_METRICS})""")
def window_totals(t):
    return D.window_totals(D.job_metrics(t.jobs))


@query("""SELECT c_custkey, c_name FROM {customer} WHERE c_name ILIKE '%00012%' OR c_mktsegment ILIKE '%00012%'""")
def ilike_search(t):
    return D.search(t.customer, "00012", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name")


@query("SELECT job_id, status FROM {jobs} ORDER BY created_at DESC, job_id LIMIT 50")
def recent_jobs(t):
    return D.recent(t.jobs, [F.col("created_at").desc(), F.col("job_id")], 50).select("job_id", "status")


# --- plan
@query("""SELECT doc_id, ref_idx FROM {verification} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ref_idx) <= least(10, greatest(1, ceil(count(*) OVER (PARTITION BY doc_id) * 0.25::DOUBLE)))""")
def preview_rows(t):
    return P.preview(t.verification, ["doc_id"], ["ref_idx"]).select("doc_id", "ref_idx")


@query("""WITH a AS (SELECT doc_id, status, ref_idx, row_number() OVER (PARTITION BY doc_id, status ORDER BY ref_idx) AS turn, count(*) OVER (PARTITION BY doc_id) AS n FROM {verification}) SELECT doc_id, status, ref_idx FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY turn, status) <= least(10, greatest(1, ceil(n * 0.25::DOUBLE)))""")
def grouped_preview(t):
    return P.round_robin(t.verification, "doc_id", "status", ["ref_idx"]).select("doc_id", "status", "ref_idx")


@query("""SELECT l_partkey AS original, l_linenumber AS rank, l_discount AS confidence FROM {lineitem} QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, l_discount DESC, l_orderkey) = 1""")
def suggestion_priority(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("original"), F.col("l_linenumber").alias("rank"), F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("idx"))
    return P.best_suggestions(rows, ["original"]).drop("idx")


@query("""SELECT count(*) AS total, count(*) FILTER (c >= 0.85) AS high, count(*) FILTER (c >= 0.7 AND c < 0.85) AS medium, count(*) FILTER (c < 0.7) AS low FROM (SELECT (l_partkey % 100) / 100.0::DOUBLE AS c FROM {lineitem})""")
def suggestion_stats(t):
    return P.suggestion_stats(t.lineitem.select((F.col("l_partkey") % 100 / 100.0).alias("confidence")))


_PLAN = f"""v AS (SELECT *, coalesce(lower(doi), replace(lower(ref_doi), 'https://doi.org/', '')) AS k, replace(lower(coalesce(ref_doi, '')), 'https://doi.org/', '') AS own FROM {{verification}}), w AS (SELECT *, min(ref_idx) OVER (PARTITION BY doc_id, k) AS first_idx FROM v),
  risks AS (SELECT doc_id, ref_idx, 'metadata_not_found' AS risk, 'important' AS priority FROM w WHERE status = 'not_found'
  UNION ALL SELECT doc_id, ref_idx, CASE WHEN publication_status = 'unchecked' THEN 'publication_status_unchecked' ELSE 'other' END, CASE WHEN publication_status IN ('retracted', 'withdrawn', 'expression_of_concern') THEN 'critical' WHEN publication_status IN ('corrected', 'unchecked') THEN 'important' ELSE 'optional' END FROM w WHERE publication_status <> 'clear' OR event_count > 0
  UNION ALL SELECT doc_id, ref_idx, 'other', 'important' FROM w WHERE update_type = 'Erratum' AND publication_status NOT IN ('corrected', 'reinstated', 'publication_notice')
  UNION ALL SELECT doc_id, ref_idx, 'other', 'optional' FROM w WHERE {YEAR} - year > 10 UNION ALL SELECT doc_id, ref_idx, 'other', 'important' FROM w WHERE source_type = 'Blog' UNION ALL SELECT doc_id, ref_idx, 'other', 'critical' FROM w WHERE own <> '' AND own <> doi
  UNION ALL SELECT doc_id, ref_idx, 'other', 'important' FROM w WHERE ref_idx > first_idx UNION ALL SELECT doc_id, ref_idx, 'other', 'optional' FROM w WHERE link_status = '404'),
  open_ AS (SELECT doc_id, ref_idx FROM {{verification}} WHERE status <> 'verified' UNION SELECT doc_id, ref_idx FROM {{verification}} WHERE ref_doi IS NULL),
  lost AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_pos, num) AS n FROM (SELECT doc_id, num, min(pos) AS first_pos FROM {{cites}} c WHERE NOT EXISTS (SELECT 1 FROM {{refs}} r WHERE r.doc_id = c.doc_id AND r.num = c.num) GROUP BY 1, 2)),
  idle AS (SELECT doc_id, ref_idx, row_number() OVER (PARTITION BY doc_id ORDER BY ref_idx) AS n FROM {{refs}} r WHERE NOT EXISTS (SELECT 1 FROM {{cites}} c WHERE r.doc_id = c.doc_id AND r.num = c.num)),
  items AS (SELECT doc_id, 'missing_reference-' || n AS item_id, 'missing_reference' AS category, 'critical' AS priority FROM lost WHERE n <= 200 UNION ALL SELECT doc_id, 'uncited_reference-' || n, 'uncited_reference', 'important' FROM idle WHERE n <= 200
  UNION ALL SELECT doc_id, '', 'source_verification', 'important' FROM {{verification}} WHERE status <> 'verified'
  UNION ALL SELECT doc_id, '', 'claim_support', CASE support_status WHEN 'weak_or_unclear' THEN 'important' ELSE 'critical' END FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, support_status ORDER BY ref_idx) AS n FROM {{verification}} WHERE support_status IN ('weak_or_unclear', 'insufficient_evidence')) WHERE n <= 200
  UNION ALL SELECT doc_id, '', 'citation_needed', 'critical' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ref_idx) AS n FROM {{verification}} WHERE priority = 'High') WHERE n <= 200
  UNION ALL SELECT doc_id, '', 'reference_identity_conflict', CASE WHEN score < 70 THEN 'critical' ELSE 'important' END FROM {{verification}} WHERE score BETWEEN 1 AND 79 UNION ALL SELECT doc_id, '', 'reference_incomplete', 'important' FROM {{verification}} WHERE ref_doi IS NULL
  UNION ALL SELECT doc_id, '', 'reference_style', 'important' FROM {{verification}} WHERE ref_doi IS NOT NULL AND status = 'likely'
  UNION ALL SELECT doc_id, '', 'source_risk', priority FROM risks r WHERE risk = 'other' OR NOT EXISTS (SELECT 1 FROM open_ o WHERE o.doc_id = r.doc_id AND o.ref_idx = r.ref_idx)
  UNION ALL SELECT doc_id, '', 'academic_voice', 'optional' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM {{signals}} WHERE signal IN ('long_sentence', 'repeated_opening')) WHERE n <= 12)"""
_ITEMS = f"WITH {_PLAN} SELECT doc_id, category, priority, count(*) AS n FROM items GROUP BY 1, 2, 3"
_READY = f"""WITH {_PLAN}, t AS (SELECT i.*, coalesce(d.decision, 'pending') NOT IN ('accepted', 'rejected', 'ignored', 'resolved') AS todo FROM items i LEFT JOIN {{decisions}} d ON d.doc_id = i.doc_id AND d.item_id = i.item_id)
  SELECT doc_id, count(*) FILTER (todo AND priority = 'critical') AS critical, count(*) FILTER (todo AND priority = 'important') AS important, count(*) FILTER (todo AND priority = 'optional') AS optional, count(*) FILTER (todo) AS total, count(*) FILTER (NOT todo) AS decided,
  count(*) FILTER (todo AND category <> 'academic_voice') AS evidence, count(*) FILTER (todo AND priority = 'critical') = 0 AND count(*) FILTER (todo AND priority = 'important') <= 2 AS ready FROM t GROUP BY 1"""


def _written(t):
    """t with references and their verification written once, for the many branches of a plan that read them."""
    t.refs = kept(t.refs)
    t.verification = kept(t.verification)
    return t


def _listed(t):
    """The correction plan's items: missing and uncited references, sources, claims, sentences without a source, audits, risks, writing."""
    v = t.verification
    audits = v.select("doc_id", "ref_idx", (F.col("score") >= 80).alias("accepted"), (F.col("score") / 100.0).alias("title_similarity"), F.array_compact(F.array(F.when(F.col("ref_doi").isNull(), "doi"))).alias("missing"), (F.col("status") == "likely").alias("needs_formatting"))
    items = [
        P.numbered_items(R.missing_citations(t.cites, t.refs), "missing_reference", "critical", ["first_pos", "num"]), P.numbered_items(R.uncited_references(t.cites, t.refs), "uncited_reference", "important", ["ref_idx"]),
        P.verification_list(v.select("doc_id", "ref_idx", V.canonical_status(F.col("status")).alias("canonical"))), P.claim_list(v.select("doc_id", F.col("ref_idx").alias("idx"), V.canonical_support(F.col("support_status")).alias("support"))),
        P.numbered_items(v.filter("priority = 'High'"), "citation_needed", "critical", ["ref_idx"]), P.audit_list(audits), P.voice_list(t.signals),
    ]
    base = items[0]
    for i in items[1:]:
        base = base.unionByName(i)
    return base.unionByName(P.risk_list(E.risk_rows(v, YEAR), base))


def _pending(t):
    return P.pending(P.decided(_listed(t), t.decisions))


def _items(t):
    return P.counted(_listed(t).select("doc_id", "category", "priority"))


@query(_ITEMS)
def correction_plan(t):
    return _items(_written(t))


@query(_READY)
def plan_readiness(t):
    return _pending(_written(t))


@query(f"SELECT doc_id, category, priority, greatest(0, n - n // 2) AS resolved, greatest(0, n // 2 - n) AS added FROM ({_ITEMS})")
def revision_comparison(t):
    before = kept(_items(_written(t))).withColumn("kind", F.concat_ws("|", "category", "priority"))
    counts = before.select("doc_id", F.col("kind").alias("category"), "n")
    out = P.compare_revisions(counts, counts.withColumn("n", F.floor(F.col("n") / 2).cast("bigint")))
    parts = F.split("category", r"\|")
    return out.select("doc_id", parts[0].alias("category"), parts[1].alias("priority"), "resolved", "added")


_VERIFIED = """SELECT *, FROM (SELECT doc_id, count(*) AS rows, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'likely') AS likely, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'not_found') AS not_found, count(*) FILTER (status = 'offline') AS offline,
  count(*) FILTER (manual_decision = 'manual_verified') AS manual_verified, count(*) FILTER (manual_decision = 'manual_not_verified') AS manual_not_verified, count(*) FILTER (manual_decision = 'not_indexed_but_plausible') AS not_indexed_but_plausible, count(*) FILTER (manual_decision = 'keep_needs_review') AS keep_needs_review FROM {verification} GROUP BY 1)
  JOIN (SELECT doc_id, count(*) FILTER (r) AS manual_required, count(*) FILTER (r AND c) AS manual_cleared, count(*) FILTER (r AND NOT c) AS manual_unresolved FROM (SELECT doc_id, title, bool_or(status IN ('needs_review', 'not_found', 'offline')) AS r, bool_or(manual_decision = 'manual_verified' AND evidence_url <> '') AS c FROM {verification} GROUP BY 1, 2) GROUP BY 1) USING (doc_id)""".replace("*, FROM", "* FROM")
_CLAIMED = """SELECT doc_id, count(*) AS rows, count(*) FILTER (support_status = 'strong_support') AS strong_support, 0::BIGINT AS moderate_support, count(*) FILTER (support_status = 'related_evidence') AS related_evidence, count(*) FILTER (support_status = 'weak_or_unclear') AS weak_or_unclear,
  count(*) FILTER (support_status = 'insufficient_evidence') AS insufficient_evidence, 0::BIGINT AS no_evidence_found, count(*) FILTER (support_status <> 'strong_support') + count(*) FILTER (status IN ('needs_review', 'not_found', 'offline')) AS issues, count(*) FILTER (support_status = 'insufficient_evidence') AS critical,
  count(*) FILTER (support_status IN ('related_evidence', 'weak_or_unclear')) + count(*) FILTER (status IN ('needs_review', 'not_found', 'offline')) AS moderate FROM {verification} GROUP BY 1"""
_NEEDS = """SELECT doc_id, count(*) AS rows, count(*) FILTER (lower(priority) IN ('high', 'critical')) AS high, count(*) FILTER (priority IS NULL) AS medium, count(*) FILTER (lower(priority) IN ('low', 'minor')) AS low FROM {verification} GROUP BY 1"""
_LISTS = """SELECT doc_id, count(*) FILTER (c > 0 AND r = 0) AS missing, count(*) FILTER (c = 0 AND r > 0) AS uncited FROM (SELECT doc_id, num, sum(c) AS c, max(r) AS r FROM (SELECT doc_id, num, 1 AS c, 0 AS r FROM {cites} UNION ALL SELECT doc_id, num, 0, 1 FROM {refs}) GROUP BY 1, 2) GROUP BY 1"""


def _keyed_rows(t):
    return t.verification.withColumn("key", F.col("title"))


@query(_VERIFIED)
def certificate_verification_counts(t):
    return CE.verification_counts(_keyed_rows(t))


@query(_CLAIMED)
def claim_counts(t):
    return CE.claim_counts(t.verification)


@query(_NEEDS)
def citation_needed_counts(t):
    return CE.needed_counts(t.verification)


_CLEARED = f"""SELECT doc_id, critical, moderate, minor, CASE WHEN uncited = 0 AND missing = 0 AND manual_unresolved = 0 AND recency >= 60 THEN 'Provisional clearance' WHEN raw_index >= 85 AND critical = 0 AND moderate <= 5 THEN 'Clearance Recommended' WHEN raw_index >= 70 AND critical <= 5 THEN 'Conditional Clearance'
  WHEN raw_index >= 55 OR moderate > 0 THEN 'Limited Clearance' ELSE 'Revision Required' END AS clearance FROM (SELECT i.doc_id, raw_index, recency, uncited, missing, manual_unresolved, not_found + offline + manual_not_verified + missing + c.critical + high AS critical,
  needs_review + not_indexed_but_plausible + keep_needs_review + c.moderate + medium AS moderate, likely + uncited + low AS minor FROM ({_INTEGRITY}) i JOIN ({_TEMP}) r ON r.doc_id = i.doc_id JOIN ({_LISTS}) l ON l.doc_id = i.doc_id JOIN ({_VERIFIED}) v ON v.doc_id = i.doc_id JOIN ({_CLAIMED}) c ON c.doc_id = i.doc_id JOIN ({_NEEDS}) n ON n.doc_id = i.doc_id)"""


@query(f"""SELECT c.doc_id, greatest(c.critical, coalesce(p.critical, 0)) AS critical, greatest(moderate, coalesce(important, 0)) AS moderate, greatest(minor, coalesce(optional, 0)) AS minor,
  CASE WHEN p.critical > 0 THEN 'Revision Required' WHEN evidence > 0 AND clearance IN ('Provisional clearance', 'Clearance Recommended') THEN 'Conditional Clearance' ELSE clearance END AS clearance FROM ({_CLEARED}) c LEFT JOIN ({_READY}) p ON p.doc_id = c.doc_id""")
def certificate_clearance(t):
    """Decisions with the correction plan's pending items."""
    t = _written(t)
    scores = I.integrity_index(t.verification, YEAR).select("doc_id", F.col("raw_index").alias("score")).join(I.temporal(t.verification, YEAR).select("doc_id", "recency"), "doc_id")
    lists = R.match_summary(t.cites, t.refs).select("doc_id", "missing", "uncited")
    return CE.certificates(scores, lists, _keyed_rows(t), t.verification, t.verification, _pending(t))


@query(_CLEARED)
def certificate_risks(t):
    """Risks and decisions by the counts alone."""
    scores = I.integrity_index(t.verification, YEAR).select("doc_id", F.col("raw_index").alias("score")).join(I.temporal(t.verification, YEAR).select("doc_id", "recency"), "doc_id")
    lists = R.match_summary(t.cites, t.refs).select("doc_id", "missing", "uncited")
    return CE.certificates(scores, lists, _keyed_rows(t), t.verification, t.verification)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 140000 <= 15000 AND o_custkey % 700 <= 100 AND o_custkey % 2500 <= 300 THEN 'article' WHEN o_orderkey % 140000 <= 35000 AND o_custkey % 700 <= 200 AND o_custkey % 2500 <= 700 THEN 'research_paper'
  WHEN o_orderkey % 140000 <= 75000 AND o_custkey % 700 <= 350 AND o_custkey % 2500 <= 1400 THEN 'thesis' WHEN o_orderkey % 140000 <= 120000 AND o_custkey % 700 <= 600 AND o_custkey % 2500 <= 2400 THEN 'phd' ELSE 'custom_large' END AS tier FROM {orders}""")
def tier_recommendation(t):
    return t.orders.select("o_orderkey", P.recommended_tier(F.col("o_orderkey") % 140000, F.col("o_custkey") % 700, F.col("o_custkey") % 2500).alias("tier"))


# --- claims
_HITS = """WITH words AS (SELECT doc_id, ref_idx, claim, source_title, list_transform(list_filter(regexp_extract_all(lower(source_title), '[a-z]+'), lambda w: length(w) >= 3 AND w NOT IN ('effects', 'effect', 'and')), lambda w: w) AS w FROM {claims})
  SELECT doc_id, ref_idx, regexp_matches(lower(claim), '\\b(improv|enhanc|boost|strength)\\w*') AS improve, regexp_matches(lower(claim), '\\b(reduc|mitigat|lower|decreas)\\w*') AS reduce, regexp_matches(lower(claim), '\\b(caus|lead|result|produc)\\w*') AS cause, len(w) AS title_words FROM words"""


@query(_HITS)
def relation_hits(t):
    return _relation_hits(t.claims)


def _relation_hits(rows):
    c = rows.withColumn("r", C.relations(F.col("claim")))
    tw = F.size(F.filter(F.split(F.trim(F.regexp_replace(F.lower("source_title"), "[^a-z]+", " ")), " "), lambda w: (F.length(w) >= 3) & ~w.isin("effects", "effect", "and"))).cast("bigint")
    return c.select("doc_id", "ref_idx", *[F.array_contains("r", k).alias(k) for k in ("improve", "reduce", "cause")], tw.alias("title_words"))


_DIRECTION = """WITH f AS (SELECT doc_id, ref_idx, regexp_matches(lower(claim), 'improve|enhance|increase|boost|strengthen|beneficial|positive|advantage') AS cp, regexp_matches(lower(claim), 'reduce|decrease|mitigate|lower|minimize|negative|harmful|detrimental') AS cn,
  regexp_matches(lower(source_title), 'improve|enhance|increase|boost|strengthen|beneficial|positive|advantage') AS sp, regexp_matches(lower(source_title), 'reduce|decrease|mitigate|lower|minimize|negative|harmful|detrimental') AS sn FROM {claims})
  SELECT doc_id, ref_idx, CASE WHEN (cp AND sp) OR (cn AND sn) THEN 1.0 WHEN (cp OR cn) AND NOT (sp OR sn) THEN 0.4 WHEN (cp AND sn) OR (cn AND sp) THEN 0.0 ELSE 0.6 END::DOUBLE AS direction FROM f"""


@query(_DIRECTION)
def direction_overlap(t):
    return t.claims.select("doc_id", "ref_idx", C.direction(F.col("claim"), F.col("source_title")).alias("direction"))


_ANY = lambda words: "|".join(words)
_CONCEPT = "CASE " + " ".join(f"WHEN x IN ({', '.join(repr(w) for w in forms)}) THEN '{name}'" for name, forms in C.CONCEPTS.items()) + " ELSE x END"
_CONCEPTS = lambda c: f"list_distinct(list_transform(list_filter(regexp_extract_all({c}, '[a-z]{{{{{{{{3,}}}}}}}}'), lambda x: x NOT IN ({', '.join(repr(w) for w in sorted(T.STOPWORDS))})), lambda x: {_CONCEPT}))"
_RELATIONS = lambda c: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({c}, '{_ANY(p)}') THEN '{name}' END" for name, p in C.RELATIONS.items()) + "], lambda x: x IS NOT NULL)"
_CLAIM_SUPPORT = rf"""WITH a AS (SELECT doc_id, ref_idx, coalesce(claim, '') AS claim, coalesce(source_title, '') AS title, lower(trim(coalesce(status, ''))) AS st FROM {{{{claim_rows}}}}),
  b AS (SELECT *, regexp_replace(regexp_replace(claim, '(?i)\b({C.FRAMING})\b', '', 'g'), '(?i)\b({C.HEDGES})\b', '', 'g') AS x FROM a),
  c AS (SELECT *, trim(trim(regexp_replace(regexp_replace(regexp_replace(x, '\([^)]*\)', ' ', 'g'), '\[[^\]]*\]', ' ', 'g'), '\s+', ' ', 'g')), ' ,;:-') AS x2 FROM b),
  d AS (SELECT *, lower(CASE WHEN x2 = '' THEN claim ELSE x2 END) AS k, lower(title) AS s FROM c),
  e AS (SELECT *, {_CONCEPTS('k')} AS kc, {_CONCEPTS('s')} AS sc, {_RELATIONS('k')} AS kr, {_RELATIONS('s')} AS sr, regexp_matches(k, '{_ANY(C.POSITIVE)}') AS kp, regexp_matches(k, '{_ANY(C.NEGATIVE)}') AS kn, regexp_matches(s, '{_ANY(C.POSITIVE)}') AS sp, regexp_matches(s, '{_ANY(C.NEGATIVE)}') AS sn FROM d),
  f AS (SELECT *, len(list_intersect(kc, sc)) AS o, len(list_intersect(kr, sr)) AS ro, CASE WHEN (kp AND sp) OR (kn AND sn) THEN 1.0 WHEN (kp OR kn) AND NOT (sp OR sn) THEN 0.4 WHEN (kp AND sn) OR (kn AND sp) THEN 0.0 ELSE 0.6 END::DOUBLE AS dir FROM e),
  g AS (SELECT *, CASE WHEN claim = '' OR title = '' THEN 0.0 ELSE round(least(100.0, 40 * least(o / greatest(least(len(kc), 4), 1), 1.0) + CASE WHEN len(kr) = 0 THEN 0 ELSE 25 * ro / len(kr) END + 15 * dir + CASE WHEN o >= 1 THEN 15 ELSE 0 END
    + CASE WHEN o >= 1 AND ro >= 1 THEN 10 ELSE 0 END + CASE WHEN dir >= 0.8 THEN 10 ELSE 0 END + CASE WHEN o >= 2 THEN 10 ELSE 0 END), 1) END::DOUBLE AS raw_score FROM f),
  h AS (SELECT *, CASE WHEN raw_score >= 50 THEN 'strong_support' WHEN raw_score >= 35 THEN 'moderate_support' WHEN raw_score >= 20 THEN 'related_evidence' WHEN raw_score >= 10 THEN 'weak_or_unclear' ELSE 'insufficient_evidence' END AS raw_status,
    trim(claim) = '' OR regexp_matches(lower(claim), '{_ANY(C.NO_CLAIM)}') AS nothing FROM g),
  i AS (SELECT *, st IN ('likely', 'needs_review', 'not_found', 'offline', 'error', 'failed', 'unverified', 'unknown', '', 'none') AND (raw_score >= 10) AS gated FROM h)
  SELECT doc_id, ref_idx, raw_score, raw_status, CASE WHEN nothing THEN 0.0 WHEN gated THEN least(floor(raw_score), 49) ELSE raw_score END::DOUBLE AS support_score,
    CASE WHEN nothing THEN 'claim_not_extracted' WHEN gated AND st IN ('', 'unknown', 'none') THEN 'source_verification_unknown' WHEN gated THEN 'source_needs_review' ELSE raw_status END AS support_status FROM i"""


@query(_CLAIM_SUPPORT.replace("{{", "{").replace("}}", "}"))
def claim_support(t):
    return C.support(t.claim_rows).select("doc_id", "ref_idx", "raw_score", "raw_status", "support_score", "support_status")


_STOP = ", ".join(f"'{w}'" for w in C.FALLBACK_STOP)


@query(f"""SELECT doc_id, ref_idx, CASE WHEN k > 0 THEN least(40, 10 + 10 * k) ELSE 0 END::BIGINT AS score FROM (SELECT doc_id, ref_idx, len(list_intersect(list_filter(list_distinct(regexp_extract_all(lower(claim), '[a-z]{{{{4,}}}}')), lambda w: w NOT IN ({_STOP})), list_distinct(regexp_extract_all(lower(source_title), '[a-z]{{{{4,}}}}')))) AS k FROM {{claims}})""")
def keyword_overlap(t):
    return t.claims.select("doc_id", "ref_idx", C.keyword_overlap(F.col("claim"), F.col("source_title")).alias("score"))


_RE = lambda patterns: "|".join(p.replace("'", "''") for p in patterns).replace("{", "{{").replace("}", "}}")
_HAS = [p if "(?<=" not in p else r"[A-Za-z\)\]]\s*[⁰¹²³⁴⁵⁶⁷⁸⁹]+" for p in C.CITES]
_LOW_VALUE = (
    r"length(s) < 55 OR length(s) > 520 OR len(regexp_extract_all(s, '[A-Za-zÀ-ÖØ-öø-ÿ'']+')) < 9 OR ends_with(s, '?') OR regexp_matches(low, '^(" + _RE(C.SKIP_STARTS).replace(".", r"\.") + r")') OR regexp_matches(low, '^(hypothesis|objective|research question)\s*\d*[:.]') OR regexp_matches(low, '"
    + _RE([C.LIST_RESIDUE]) + "') OR regexp_matches(low, '" + _RE([C.OWN_RESULTS]) + r"') OR regexp_matches(s, '\b[A-Za-z][A-Za-z0-9_]*\s*=\s*[-+]?\d') OR regexp_matches(s, '[=+*/^]\s*[-+]?\d+(?:\.\d+)?') OR (contains(s, '=') AND len(regexp_extract_all(s, '\d')) >= 2)"
    + r" OR len(regexp_extract_all(s, '\b\d+(?:\.\d+)?\b')) / greatest(len(string_split(s, ' ')), 1)::DOUBLE >= 0.22"
)
_NEEDED_SCORE = "0.15 + " + " + ".join(f"CASE WHEN regexp_matches(low, '{_RE(patterns)}') THEN {weight} ELSE 0 END" for weight, patterns in C.NEEDED)


@query((r"""WITH l AS (SELECT text_id, string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?]) ([A-Z0-9(])', '\1␞\2', 'g'), '␞') AS l FROM {claim_texts}), s AS (SELECT text_id, unnest(range(len(l))) AS sent_idx, trim(unnest(l)) AS s FROM l), t AS (SELECT *, lower(s) AS low FROM s),
  z AS (SELECT text_id, sent_idx, low, CASE WHEN regexp_matches(s, '@HAS@') OR @LOW@ THEN 0 ELSE round(least(0.95, (@SCORE@)::DOUBLE), 2) END::DOUBLE AS score FROM t)
  SELECT text_id, min(sent_idx) AS sent_idx, max(score) AS score FROM z WHERE score >= 0.55 GROUP BY text_id, low""").replace("@HAS@", _RE(_HAS)).replace("@LOW@", _LOW_VALUE).replace("@SCORE@", _NEEDED_SCORE))
def citation_needed(t):
    """Sentences that need a source, over texts with claims, citations, own results, questions and repeats."""
    return C.citation_needed(t.claim_texts, "text_id", "text")


_SENT = r"""SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?]) ([A-Z0-9(])', '\1␞\2', 'g'), '␞')) AS s FROM {documents}"""


@query(f"""SELECT doc_id, count(*) AS sentences, round(avg(w), 4) AS mean_words, round(CASE WHEN count(*) > 1 THEN stddev_pop(w) / avg(w) ELSE 0.0 END, 4) AS cv FROM (SELECT doc_id, len(list_filter(string_split(regexp_replace(s, '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM ({_SENT})) WHERE w >= 4 GROUP BY 1""")
def voice_metrics(t):
    return C.length_metrics(t.documents, "doc_id", "text")


@query()
def voice_review(t):
    """The whole writing review of every document."""
    return VO.review(t.documents)


@query("""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g')) <> ''))::BIGINT AS paragraphs, length(text) AS chars FROM {documents}""")
def paragraph_counts(t):
    return t.documents.select("doc_id", F.size(T.paragraphs(F.col("text"))).cast("bigint").alias("paragraphs"), F.length("text").cast("bigint").alias("chars"))


# --- extraction
@query(r"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '\[([0-9][0-9,;\s\-]*)\]', 1)) AS p FROM {cite_texts}), q AS (SELECT doc_id, unnest(string_split(p, ',')) AS x FROM p)
  SELECT DISTINCT doc_id, unnest(CASE WHEN contains(x, '-') THEN range(split_part(x, '-', 1)::INT, split_part(x, '-', 2)::INT + 1) ELSE [x::BIGINT] END)::INT AS num FROM q""")
def square_citations(t):
    return X.numeric_citations(t.cite_texts, "square")


@query(r"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '\(([0-9][0-9]?[0-9]?(?:\s*[,;\-]\s*[0-9][0-9]?[0-9]?)*)\)', 1)) AS p FROM {cite_texts}) SELECT DISTINCT doc_id, trim(unnest(string_split(p, ',')))::INT AS num FROM p""")
def round_citations(t):
    return X.numeric_citations(t.cite_texts, "round")


@query(r"""SELECT DISTINCT doc_id, lower(regexp_extract(text, '([A-Z][A-Za-z0-9]+) \((?:19|20)[0-9][0-9]\)', 1)) AS author, regexp_extract(text, '[A-Za-z0-9]+ \(((?:19|20)[0-9][0-9])\)', 1) AS year FROM {cite_texts}""")
def author_year_citations(t):
    return X.author_year_citations(t.cite_texts)


@query(r"""SELECT doc_id, regexp_extract(lower(text), '(10[.][0-9]+/[a-z0-9]+)', 1) AS doi, try_cast(regexp_extract(text, '((?:19|20)[0-9][0-9])', 1) AS INT) AS year, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM {cite_texts}""")
def identifiers(t):
    c = F.col("text")
    return t.cite_texts.select("doc_id", T.normal_doi(c).alias("doi"), T.first_year(c).alias("year"), T.slug(c).alias("slug"))


@query(r"""SELECT doc_id, num, count(*) AS n FROM (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '[\[(]([0-9]+)[\])]', 1), flatten(list_transform(regexp_extract_all(text, '[\[(]([0-9]+(?:\s*,\s*[0-9]+)+)[\])]', 1), lambda x: regexp_split_to_array(x, '\s*,\s*')))))::INT AS num FROM {cite_texts}) GROUP BY ALL""")
def vancouver_counts(t):
    return X.vancouver_counts(t.cite_texts)


_MARKED = r"""b0 AS (SELECT * REPLACE (trim(regexp_replace(text, '\s+', ' ', 'g')) AS text) FROM {blocks}),
  b1 AS (SELECT *, CASE WHEN regexp_matches(text, '(?i)^(?:chapter\s+\w+|\d+(?:\.\d+)*\s+\w+)') AND length(text) < 120 THEN text END AS head, coalesce(style = 'Caption', false) AS styled, is_table OR is_graphic AS item FROM b0),
  b2 AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (o ROWS UNBOUNDED PRECEDING), 'Document body') AS section,
    coalesce(last_value(CASE WHEN regexp_matches(text, '(?i)^(?:list of tables|list of figures|table of contents|contents|references|bibliography)\b') AND length(text) < 90 THEN true WHEN head IS NOT NULL THEN false END IGNORE NULLS) OVER (o ROWS UNBOUNDED PRECEDING), false) AS skipped,
    bool_or(item) OVER (o ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, row_number() OVER o AS place FROM b1 WINDOW o AS (PARTITION BY doc_id ORDER BY block_idx)),
  b3 AS (SELECT *, regexp_extract(text, '(?i)^\s*(Table|Figure|Fig\.)\s+((?:\d+(?:\.\d+)*[A-Z]?|[A-Z]\d*))\s*(?:[.:–—-]\s*|\s+)(\S.*)$', ['label', 'num', 'title']) AS cap FROM b2 WHERE NOT skipped),
  b AS (SELECT *, cap.title <> '' AND NOT regexp_matches(cap.title, '(?i)^(?:shows?|presents?|illustrates?|depicts?|reports?|summari[sz]es?|lists?|provides?|compares?|describes?|displays?|indicates?|demonstrates?)\b')
    AND (styled OR near OR regexp_matches(text, '(?i)^\s*(?:Table|Figure|Fig\.)\s+\S+\s*[.:–—-]')) AS is_caption FROM b3),
  caps AS (SELECT doc_id, block_idx, place, CASE WHEN lower(cap.label) LIKE 'table%' THEN 'table' ELSE 'figure' END AS kind, upper(cap.num) AS number FROM b WHERE is_caption),
  spans AS (SELECT doc_id, block_idx, unnest(regexp_extract_all(text, '(?i)\b(?:Tables?|Figures?|Figs?\.)\s+(?:\d+(?:\.\d+)*[A-Z]?|[A-Z]\d*)\b(?:\s*(?:,|/|&|\band\b|[-–—])\s*(?:\d+(?:\.\d+)*[A-Z]?|[A-Z]\d*)\b)*')) AS span FROM b WHERE NOT is_caption),
  parts AS (SELECT doc_id, block_idx, CASE WHEN lower(span) LIKE 'table%' THEN 'table' ELSE 'figure' END AS kind, list_concat([''], regexp_extract_all(rest, '(?i)\s*(,|/|&|\band\b|[-–—])\s*(?:\d+(?:\.\d+)*[A-Z]?|[A-Z]\d*)\b', 1)) AS by_, regexp_extract_all(rest, '(?i)\b(\d+(?:\.\d+)*[A-Z]?|[A-Z]\d*)\b', 1) AS ns
    FROM (SELECT *, regexp_replace(span, '(?i)^(?:Tables?|Figures?|Figs?\.)\s+', '') AS rest FROM (SELECT *, span FROM spans)) ),
  nums AS (SELECT doc_id, block_idx, kind, ns, by_ FROM parts),
  calls AS (SELECT doc_id, block_idx, kind, unnest(flatten(list_transform(range(1, len(ns) + 1), lambda i: CASE WHEN i > 1 AND by_[i] IN ('-', '–', '—') AND regexp_matches(ns[i], '^\d+$') AND regexp_matches(ns[i - 1], '^\d+$')
    THEN list_transform(CASE WHEN try_cast(ns[i] AS INT) - try_cast(ns[i - 1] AS INT) BETWEEN 1 AND 30 THEN range(try_cast(ns[i - 1] AS INT) + 1, try_cast(ns[i] AS INT) + 1) ELSE [] END, lambda j: j::VARCHAR) ELSE [upper(ns[i])] END))) AS number FROM nums)"""
_FINDINGS = r"""found AS (SELECT doc_id, block_idx, 'duplicate_number' AS type, kind, number FROM caps QUALIFY count(*) OVER (PARTITION BY doc_id, kind, number) > 1
  UNION ALL SELECT c.doc_id, c.block_idx, CASE WHEN min(m.block_idx) IS NULL THEN 'unreferenced' ELSE 'first_mention_after' END, c.kind, c.number FROM caps c LEFT JOIN calls m ON m.doc_id = c.doc_id AND m.kind = c.kind AND m.number = c.number GROUP BY ALL HAVING min(m.block_idx) IS NULL OR min(m.block_idx) > c.block_idx
  UNION ALL SELECT doc_id, block_idx, CASE WHEN EXISTS (SELECT 1 FROM caps c WHERE c.doc_id = m.doc_id AND c.number = m.number) THEN 'label_mismatch' ELSE 'missing_target' END, kind, number FROM calls m WHERE NOT EXISTS (SELECT 1 FROM caps c WHERE c.doc_id = m.doc_id AND c.number = m.number AND c.kind = m.kind)
  UNION ALL SELECT doc_id, NULL, 'numbering_sequence', kind, NULL FROM (SELECT *, number::BIGINT <> lag(number::BIGINT) OVER (PARTITION BY doc_id, kind ORDER BY block_idx) + 1 AS odd FROM caps WHERE regexp_matches(number, '^\d+$')) GROUP BY doc_id, kind HAVING bool_or(odd)
  UNION ALL SELECT doc_id, block_idx, 'missing_caption', 'table', NULL FROM b WHERE is_table AND NOT EXISTS (SELECT 1 FROM caps c WHERE c.doc_id = b.doc_id AND c.kind = 'table' AND abs(c.place - b.place) <= 2)
  UNION ALL SELECT doc_id, block_idx, 'missing_caption_title', NULL, NULL FROM b WHERE NOT is_caption AND (styled OR near) AND regexp_matches(text, '(?i)^\s*(?:Table|Figure|Fig\.)\s+(?:[A-Z]|\d+)(?:\.\d+)*\s*$')
  UNION ALL SELECT doc_id, block_idx, 'missing_caption_number', NULL, NULL FROM b WHERE NOT is_caption AND styled AND text <> '' AND NOT regexp_matches(text, '(?i)^(Tables?|Figures?|Figs?\.)\s+(?:\d+(?:\.\d+)*[A-Z]?|[A-Z]\d*)\b'))"""


@query(f"WITH {_MARKED} SELECT doc_id, block_idx, section FROM b2")
def running_section(t):
    return X.section_blocks(t.blocks.drop("style")).select("doc_id", "block_idx", "section")


@query(f"WITH {_MARKED}, {_FINDINGS} SELECT doc_id, coalesce(block_idx, -1)::BIGINT AS block_idx, type, kind, number FROM found")
def table_findings(t):
    return X.audit_findings(t.blocks).select("doc_id", F.coalesce("block_idx", F.lit(-1)).cast("bigint").alias("block_idx"), "type", "kind", "number")


@query(f"""WITH {_MARKED}, {_FINDINGS} SELECT doc_id, coalesce(tables, 0) AS tables, coalesce(figures, 0) AS figures, coalesce(unreferenced, 0) AS unreferenced, coalesce(missing_targets, 0) AS missing_targets, coalesce(numbering_or_caption, 0) AS numbering_or_caption, coalesce(needs_review, 0) AS needs_review FROM (SELECT DISTINCT doc_id FROM {{blocks}})
  LEFT JOIN (SELECT doc_id, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind = 'figure') AS figures FROM caps GROUP BY 1) USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) FILTER (type = 'unreferenced') AS unreferenced, count(*) FILTER (type IN ('missing_target', 'label_mismatch')) AS missing_targets, count(*) FILTER (type IN ('duplicate_number', 'numbering_sequence', 'missing_caption', 'missing_caption_title', 'missing_caption_number')) AS numbering_or_caption, count(*) AS needs_review FROM found GROUP BY 1) USING (doc_id)""")
def table_audit(t):
    return X.table_audit(t.blocks)


@query(rf"WITH {_MARKED} SELECT doc_id, kind, block_idx, previous, num FROM (SELECT *, number::BIGINT AS num, lag(number::BIGINT) OVER (PARTITION BY doc_id, kind ORDER BY block_idx) AS previous FROM caps WHERE regexp_matches(number, '^\d+$')) WHERE num <> previous + 1")
def caption_gaps(t):
    return X.caption_gaps(t.blocks)


@query(f"WITH {_MARKED} SELECT doc_id, block_idx, (SELECT count(*) FROM b c WHERE c.doc_id = b.doc_id AND abs(c.block_idx - b.block_idx) <= 2 AND c.is_caption) AS captions_near FROM b WHERE NOT is_caption")
def nearby_captions(t):
    return X.nearby_captions(t.blocks)


@query(r"""SELECT doc_id, CASE WHEN len(w) >= 20 THEN sha256(array_to_string(w, ' ')) END AS fingerprint FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM {documents})""")
def document_fingerprint(t):
    return t.documents.select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))


def _padded(key: str, pad: int) -> str:
    return "".join(f"{b ^ pad:02X}" for b in key.encode().ljust(64, b"\0"))


@query(rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: substr(sha256(unhex('{_padded("key", 0x5C)}') || unhex(sha256(unhex('{_padded("key", 0x36)}') || encode(array_to_string(w[i:i + 4], ' '))))), 1, 24))))[1:128], ',') AS signature
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{{{L}}}}\p{{{{N}}}}_]+') AS w FROM {{documents}}) WHERE len(w) >= 20""")
def shingle_signature(t):
    return X.signatures(dealt(t.documents.select("doc_id", "text"), "doc_id"), "key").select("doc_id", F.array_join("signature", ",").alias("signature"))


@query(r"""WITH l AS (SELECT source, doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM {documents}), e AS (SELECT source, unnest(list_concat(l[1:4], l[greatest(len(l) - 3, 1):])) AS x FROM l),
  k AS (SELECT source, trim(regexp_replace(regexp_replace(lower(trim(x)), '\b[0-9]{{1,4}}\b', '#', 'g'), '\s+', ' ', 'g')) AS line FROM e), n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM {documents} GROUP BY 1)
  SELECT k.source, line, count(*) AS df, any_value(pages) AS pages FROM k JOIN n USING (source) WHERE length(line) >= 4 AND length(line) <= 120 AND pages >= 3 GROUP BY 1, 2 HAVING count(*) >= greatest(3, floor(any_value(pages) * 0.05::DOUBLE))""")
def repeated_lines(t):
    return X.repeated_lines(t.documents.select("source", F.col("doc_id").alias("page"), "text"), share=0.05)


# --- resolution
def _catalog(t):
    """part as a catalog of works: every other entry of a scholarly source, some of books, some retracted."""
    k = F.col("p_partkey")
    name = F.translate(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), "0123456789", "abcdefghij")
    return t.part.select(
        k.alias("cand_id"), F.col("p_name").alias("title"), name.alias("author"), (F.lit(1970) + F.col("p_size")).alias("year"), F.col("p_type").alias("journal"), F.concat(F.lit("10.1000/"), (k % 700).cast("string")).alias("doi"),
        F.col("p_size").cast("string").alias("volume"), F.lit("").alias("issue"), F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 9).cast("string")).alias("pages"),
        F.when(k % 2 == 0, "crossref").when(k % 3 == 0, "open_library").otherwise("eric").alias("source"), F.when(k % 5 == 0, 2).otherwise(1).alias("agreement"), (k % 47 == 0).alias("is_retracted"),
    )


def _wanted(t):
    """References as they are looked up: two in three give no DOI."""
    refs = t.fields.join(t.part.select(F.col("p_partkey").alias("ref_idx"), F.col("p_size").alias("size")), "ref_idx")
    refs = refs.select(F.concat_ws(":", "doc_id", "ref_idx").alias("ref_key"), "title", "author", "year", "journal", "doi", F.col("size").cast("string").alias("volume"), F.lit("").alias("issue"), F.concat(F.col("size").cast("string"), F.lit("-"), (F.col("size") + 5).cast("string")).alias("pages"))
    return refs.withColumn("doi", F.when(F.crc32("ref_key") % 3 == 0, F.col("doi")))


def _resolved(t, pick, most=1):
    keyed = S.keyed_works(_wanted(t))
    return S.spread(pick(S.resolved(S.works(keyed), _catalog(t), most)), keyed)


@query()
def best_candidate(t):
    return _resolved(t, S.best_candidates).select("ref_key", "cand_id", "score", "status", S.quality_label(F.col("score")).alias("quality"))


@query()
def strong_enough(t):
    return _resolved(t, S.strong_enough)


@query()
def strict_suggestions(t):
    """The best-fitting candidate that may be suggested for each reference that is not verified."""
    best = lambda rows: S.ranked(S.strict_pass(rows)).filter("strict_pass").groupBy("ref_key").agg(F.max(F.struct("fit_score", (-F.col("rank")).alias("r"), "cand_id")).alias("b"), F.max(F.col("status") == "verified").alias("verified"))
    return _resolved(t, lambda rows: best(rows).filter("not verified").select("ref_key", F.col("b.cand_id").alias("cand_id"), F.col("b.fit_score").alias("fit_score")))


@query()
def alternative_candidates(t):
    return _resolved(t, S.alternatives, 4).select("ref_key", "rank", "cand_id", "score")


@query("""WITH c AS (SELECT p_partkey AS cand_id, p_partkey % 83 AS score, CASE WHEN p_partkey % 4 = 0 THEN '10.1000/' || (p_partkey % 100) ELSE substr(lower(p_name), 1, 120) || '|' || (1970 + p_size) END AS key, CASE WHEN p_partkey % 2 = 0 THEN 'alpha' ELSE 'beta' END AS source FROM {part})
  SELECT key, arg_max(cand_id, (score, cand_id)) AS cand_id, max(score) AS score, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, count(*) AS n FROM c GROUP BY 1""")
def dedupe_candidates(t):
    c = _all_parts(t).withColumn("score", F.col("cand_id") % 83).withColumn("doi", F.when(F.col("cand_id") % 4 == 0, F.concat(F.lit("10.1000/"), (F.col("cand_id") % 100).cast("string"))))
    return S.dedupe_candidates(c)


def _all_parts(t):
    return t.part.select(F.col("p_partkey").alias("cand_id"), F.col("p_name").alias("title"), (F.lit(1970) + F.col("p_size")).alias("year"), F.when(F.col("p_partkey") % 2 == 0, "alpha").otherwise("beta").alias("source"))


@query("""SELECT doc_id, doi, count(*) AS n, arg_min(ref_idx, (-length(title), ref_idx)) AS canonical FROM {fields} GROUP BY 1, 2 HAVING count(*) > 1""")
def doi_clusters(t):
    return S.doi_clusters(t.fields)


@query()
def title_clusters(t):
    return S.title_clusters(t.fields)


@query()
def fuzzy_titles(t):
    a = t.part.select("p_partkey", F.col("p_name").alias("a"), F.col("p_type").alias("b"))
    return a.select("p_partkey", *[F.round(similarity(m, F.lower("a"), F.lower("b")), 4).alias(m) for m in ("ratio", "token_sort", "token_set", "partial", "sequence", "title", "manual_title")])


# --- functions
@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM {pages}""")
def strip_tags(t):
    return t.pages.select("page_id", F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " ")).alias("text"))


_WORDLESS = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"""WITH w AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS l FROM {{documents}})), d AS (SELECT doc_id, x, min(i) AS i FROM w WHERE length(x) >= 4 AND x NOT IN ({_WORDLESS}) GROUP BY 1, 2),
  f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 6) SELECT doc_id, coalesce(string_agg(x, ' ' ORDER BY i), '') AS words FROM (SELECT doc_id FROM {{documents}}) LEFT JOIN f USING (doc_id) GROUP BY 1""")
def significant_words(t):
    return t.documents.select("doc_id", F.array_join(T.significant_words(F.col("text")), " ").alias("words"))


@query("""SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role, length(text) AS chars, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS chars_so_far FROM {conversations}""")
def conversation_turns(t):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", "role", F.lag("role").over(w).alias("previous_role"), F.length("text").cast("bigint").alias("chars"), F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("chars_so_far"))
