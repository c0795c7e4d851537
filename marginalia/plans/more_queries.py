"""Queries over references as strings, access tables and document statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.tables import dealt, made_once
from marginalia.operators import access as A
from marginalia.operators import references as R
from marginalia.operators import plan as P
from marginalia.operators import review as V
from marginalia.operators import commerce as CO
from marginalia.operators import dashboard as D
from marginalia.operators import extract as X
from marginalia.operators import integrity as I
from marginalia.plans.queries import _DIV, _SUM, _TEMP, YEAR, _padded
from marginalia.plans.registry import DERIVED, query

DERIVED |= {
    "purchases": """SELECT o_orderkey AS purchase_id, o_custkey AS account_id, CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'P' THEN 'active' ELSE 'pending' END AS status, o_orderdate AS created_at,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INT) END AS expires_at, o_orderkey % 500 AS preview_job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'paystack' ELSE 'stripe' END AS provider,
        CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate ELSE NULL END AS confirmed_at, CASE WHEN o_orderkey % 4 = 1 THEN o_orderdate ELSE NULL END AS attempted_at FROM {orders}""",
    "runs": "SELECT DISTINCT l_orderkey AS purchase_id, l_partkey AS job_id FROM {lineitem} WHERE l_linenumber = 1",
    "part_jobs": "SELECT p_partkey AS job_id, CASE WHEN p_size % 3 = 0 THEN 'completed' WHEN p_size % 3 = 1 THEN 'failed' ELSE 'queued' END AS status, p_size % 7 = 0 AS content_deleted, p_size % 11 = 0 AS result_deleted FROM {part}",
    "accounts": "SELECT c_custkey AS account_id, concat('user', CAST(c_custkey AS STRING), '@example.org') AS email FROM {customer} WHERE c_nationkey <> 3",
    "grants": """SELECT o_orderkey AS job_id, o_custkey AS account_id, 1 + o_orderkey % 4 AS cost, 1 + o_orderkey % 4 AS credits, o_orderdate AS created_at, o_orderdate + INTERVAL '14' DAY AS recheck_until, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('f', CAST(o_orderkey % 40 AS STRING)) END AS fingerprint,
        CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey - 1 ELSE NULL END AS recheck_of, CASE WHEN o_orderkey % 6 = 0 THEN o_orderdate ELSE NULL END AS refunded_at FROM {orders} WHERE o_orderpriority <> '5-LOW'""",
    "reports": "SELECT o_orderkey AS job_id, o_custkey AS account_id, o_orderdate AS created_at FROM {orders}",
    "requests": """SELECT o_orderkey AS job_id, o_custkey AS account_id, 1 + o_orderkey % 4 AS cost, concat('f', CAST(o_orderkey % 40 AS STRING)) AS fingerprint, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 1 ELSE NULL END AS recheck_of FROM {orders}""",
    "records": """SELECT o_orderkey AS job_id, o_orderkey % 3 = 0 AS paid, o_totalprice AS amount, o_orderkey % 60 AS references, o_orderkey % 90 AS citations, o_orderkey % 30 AS verified, o_orderkey % 7 AS not_found FROM {orders}""",
    "uploads": "SELECT l_orderkey AS upload_id, l_shipdate AS ts, l_linenumber < 6 AS success, l_partkey % 50 AS references FROM {lineitem}",
    "wide_jobs": """SELECT o_orderkey AS job_id, concat('{{"online_verification":{{"summary":{{', CASE WHEN o_orderkey % 4 = 0 THEN concat('"total":', CAST(o_orderkey % 70 AS STRING), ',') ELSE '' END, '"verified":', CAST(o_orderkey % 40 AS STRING), ',"likely":"', CAST(o_orderkey % 9 AS STRING), '","not_found":-1}},"rows":[1,2,3]}}',
        CASE WHEN o_orderkey % 4 = 1 THEN ',"verification":{{"total":"12"}}' ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN ',"claim_support":[1,2]' ELSE ',"claim_support":7' END, ',"recovery":{{"missing_recovery":[1]', CASE WHEN o_orderkey % 2 = 0 THEN ',"verification_recovery":[1,2]' ELSE '' END, '}}',
        CASE WHEN o_orderkey % 5 = 0 THEN ',"suggestions":[1,2,3,4]' ELSE ',"suggestions":{{"citations":[1]}}' END, CASE WHEN o_orderkey % 6 = 0 THEN concat(',"evidence_resolution_workspace":{{"counts":{{"total":', CAST(o_orderkey % 11 AS STRING), ',"pending":2}}}}') ELSE concat(',"feature_usage":{{"evidence_issues_generated":', CAST(o_orderkey % 13 AS STRING), ',"evidence_workspace_analyses":"3","tracked_approvals_current":4,"academic_voice_signals":6}}') END,
        CASE WHEN o_orderkey % 7 = 0 THEN ',"correction_decisions":{{"a":{{"decision":"Accepted","track_operation":"replace"}},"b":{{"decision":"accepted","track_operation":"none"}},"c":{{"decision":"rejected","track_operation":"delete"}}}}' ELSE '' END,
        CASE o_orderkey % 3 WHEN 0 THEN ',"academic_voice_settings":{{"enabled":true}},"academic_voice_review":{{"signals":[1,2]}},"academic_voice_revisions":{{"x":1,"y":2}}' WHEN 1 THEN ',"academic_voice_settings":{{"enabled":false}}' ELSE '' END, '}}') AS result FROM {orders}""",
    "ref_lines": """SELECT l_orderkey AS doc_id, l_linenumber AS idx, min(CASE WHEN l_linenumber = 2 AND l_orderkey % 2 = 0 THEN 'References' WHEN l_linenumber = 6 AND l_orderkey % 3 = 0 THEN 'Appendix A' WHEN l_partkey % 3 = 0 THEN concat('[', CAST(l_linenumber AS STRING), '] Some work.')
        WHEN l_partkey % 3 = 1 THEN concat(CAST(l_linenumber AS STRING), '. Other work.') ELSE 'Smith, J. (2020). Work.' END) AS text FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
}


def _sentences(t):
    s = t.documents.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "s"))
    return s.withColumn("words", T.word_count(F.col("s")))


_SENT = r"""SELECT doc_id, unnest(l) AS s, unnest(range(0, len(l)))::INT AS sent_idx FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?]) ([A-Z0-9(])', '\1␞\2', 'g'), '␞') AS l FROM {documents})"""
_WORDS = "len(list_filter(string_split(s, ' '), lambda x: x <> ''))"


@query(rf"""SELECT doc_id, count(*) AS sentences, count(*) FILTER (length(t) >= 55 AND length(t) <= 520 AND {_WORDS} >= 9 AND len(regexp_extract_all(t, '[0-9]')) / greatest(length(t), 1)::DOUBLE < 0.22
  AND NOT regexp_matches(lower(t), '^(table|figure|chapter|appendix|section|keywords|abstract)')) AS claim_like FROM (SELECT *, trim(s) AS t FROM ({_SENT})) GROUP BY 1""")
def claim_like_sentences(t):
    return R.claim_like_counts(t.documents, "doc_id", "text")


@query(r"""SELECT doc_id, para_idx, w::BIGINT AS words, (coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 500 + 1)::BIGINT AS page FROM (SELECT doc_id, unnest(range(0, len(l)))::INT AS para_idx, len(list_filter(string_split(trim(regexp_replace(unnest(l), '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS w
  FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) > 0) AS l FROM {documents}))""")
def page_estimates(t):
    p = t.documents.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("para_idx", "p")).withColumn("words", T.word_count(F.col("p")))
    return A.page_estimates(p).select("doc_id", "para_idx", "words", "page")


@query("""SELECT doc_id, term, n FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM {documents}) WHERE length(term) >= 4 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) <= 24""")
def topic_profile(t):
    return A.topic_profile(t.documents, "doc_id", "text")


@query(r"""WITH p AS (SELECT doc_id, unnest(l) AS p, unnest(range(0, len(l)))::INT AS para_idx FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) > 0) AS l FROM {documents})),
  s AS (SELECT doc_id, para_idx, unnest(string_split(regexp_replace(p, '([.!?]) ([A-Z0-9(])', '\1␞\2', 'g'), '␞')) AS s FROM p)
  SELECT doc_id, para_idx, opening, count(*) AS n FROM (SELECT *, array_to_string(regexp_extract_all(lower(s), '[a-z'']+')[1:3], ' ') AS opening FROM s) WHERE opening <> '' GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def repeated_openings(t):
    p = t.documents.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("para_idx", "p"))
    return A.repeated_openings(p.select("doc_id", "para_idx", F.explode(T.sentences(F.col("p"))).alias("sentence")))


@query(r"""WITH a AS (SELECT item_id AS a_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS h FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM {benchmark})),
  b AS (SELECT doc_id AS b_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS h FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM {documents}))
  SELECT a_id, b_id, count(*) AS shared FROM a JOIN b USING (h) GROUP BY 1, 2""")
def signature_overlap(t):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    hashed = lambda df, i, o: made_once(dealt(df.select(F.col(i).alias(o), "text"), o), "w", words).select(o, T.ngrams(F.col("w"), 5).alias("hashes"))
    return A.shared_hashes(hashed(t.benchmark, "item_id", "a_id"), hashed(t.documents, "doc_id", "b_id"))


@query("""SELECT c.doc_id, c.author, c.year, ref_year, n FROM (SELECT DISTINCT doc_id, author, year FROM {ay_cites}) c JOIN (SELECT doc_id, author, min(year) AS ref_year, count(*) AS n FROM {fields} GROUP BY 1, 2 HAVING count(DISTINCT year) = 1) f ON f.doc_id = c.doc_id AND f.author = c.author WHERE c.year <> ref_year""")
def year_typos(t):
    return R.year_typos(t.ay_cites, t.fields)


@query("""SELECT doc_id, entry::BIGINT AS entry, count(*) AS lines, string_agg(text, ' ' ORDER BY idx) AS text FROM (SELECT *, sum(CASE WHEN text LIKE '[%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS entry FROM {ref_lines}) GROUP BY 1, 2""")
def merged_reference_lines(t):
    return R.merged_lines(t.ref_lines, F.col("text").startswith("["))


@query("""WITH h AS (SELECT *, max(CASE WHEN text = 'References' THEN idx END) OVER (PARTITION BY doc_id) AS h FROM {ref_lines}), s AS (SELECT *, min(CASE WHEN text LIKE 'Appendix%' AND idx > h THEN idx END) OVER (PARTITION BY doc_id) AS stop FROM h)
  SELECT doc_id, idx, text FROM s WHERE idx > h AND (stop IS NULL OR idx < stop)""")
def reference_block(t):
    return R.reference_block(t.ref_lines)


@query(r"""SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'unknown' WHEN a = greatest(a, b, c) THEN 'bracket' WHEN b = greatest(a, b, c) THEN 'numbered' ELSE 'author_year' END AS form FROM (SELECT doc_id, count(*) FILTER (regexp_matches(text, '^\[[0-9]+\]')) AS a,
  count(*) FILTER (regexp_matches(text, '^[0-9]+[.)]\s')) AS b, count(*) FILTER (regexp_matches(text, '^[A-Z][a-z]+, [A-Z]\.')) AS c FROM {ref_lines} GROUP BY 1)""")
def reference_list_format(t):
    return R.list_format(t.ref_lines)


DERIVED |= {
    "styled": """SELECT doc_id, ref_idx, CASE ref_idx % 4 WHEN 0 THEN 'apa7' WHEN 1 THEN 'apa6' WHEN 2 THEN 'harvard' ELSE 'ieee' END AS style, ref_idx % 24 AS n, concat(upper(substr(author, 1, 1)), substr(author, 2)) AS name, CASE WHEN ref_idx % 13 = 0 THEN '' ELSE CAST(year AS STRING) END AS year,
        CASE ref_idx % 11 WHEN 0 THEN NULL WHEN 1 THEN concat(title, ':  a view of ', author) ELSE title END AS title, CASE WHEN ref_idx % 5 = 0 THEN '' ELSE journal END AS source, CASE WHEN ref_idx % 7 = 0 THEN NULL ELSE CAST(1 + ref_idx % 9 AS STRING) END AS volume, CASE ref_idx % 3 WHEN 0 THEN '2' ELSE '' END AS issue,
        CASE WHEN ref_idx % 8 < 5 THEN '1–9' END AS pages, CASE WHEN ref_idx % 6 < 4 THEN doi END AS doi, CASE WHEN ref_idx % 10 = 0 THEN 'Big Press' END AS publisher, CASE ref_idx % 20 WHEN 0 THEN '2nd ed.' WHEN 10 THEN '3rd' END AS edition FROM {fields}""",
}


@query(r"""WITH a AS (SELECT *, list_transform(range(1, n + 1), lambda i: name || chr((96 + i)::INT) || ', A.') AS l, upper(substr(title, 1, 1)) || substr(title, 2) AS t0, coalesce(volume, '') AS v, coalesce(pages, '') AS p, coalesce(doi, '') AS d, coalesce(publisher, '') AS pub, coalesce(edition, '') AS ed FROM {styled}),
  b AS (SELECT *, coalesce(CASE WHEN contains(t0, ':  ') THEN split_part(t0, ':  ', 1) || ': A' || substr(split_part(t0, ':  ', 2), 2) ELSE t0 END, '') AS t, CASE WHEN year = '' THEN '(n.d.).' ELSE '(' || year || ').' END AS y,
    CASE WHEN n = 0 THEN '' WHEN style = 'ieee' THEN array_to_string(list_transform(l, lambda x: replace(x, ', ', ' ')), ', ') WHEN n = 1 THEN l[1] WHEN style = 'harvard' THEN CASE WHEN n > 3 THEN l[1] || ' et al.' WHEN n = 2 THEN l[1] || ' and ' || l[2] ELSE l[1] || ', ' || l[2] || ', and ' || l[3] END
      WHEN (style = 'apa7' AND n > 20) OR (style = 'apa6' AND n > 7) THEN array_to_string(l[1:CASE WHEN style = 'apa7' THEN 19 ELSE 6 END], ', ') || ', … ' || l[n] ELSE array_to_string(l[1:n - 1], ', ') || ', & ' || l[n] END AS names FROM a),
  c AS (SELECT *, CASE WHEN source <> '' THEN '*' || source || '*' || CASE WHEN v = '' THEN '' WHEN style = 'harvard' THEN ', ' || v || CASE WHEN issue <> '' THEN '(' || issue || ')' ELSE '' END || CASE WHEN p <> '' THEN ', pp. ' || p ELSE '' END
      ELSE ', *' || v || '*' || CASE WHEN issue <> '' AND issue <> v THEN '(' || issue || ')' ELSE '' END || CASE WHEN p <> '' THEN ', ' || p ELSE '' END END || '.' END AS j, trim(names || ' ' || y) AS lead_, CASE WHEN t = '' THEN '[No title]' ELSE t END AS tt, pub <> '' AND source = '' AS book FROM b),
  e AS (SELECT *, (CASE WHEN source <> '' THEN source ELSE pub END) || CASE WHEN year <> '' THEN CASE WHEN source <> '' OR pub <> '' THEN '. ' ELSE '' END || year ELSE '' END || CASE WHEN v <> '' THEN ';' || v ELSE '' END || CASE WHEN issue <> '' THEN '(' || issue || ')' ELSE '' END || CASE WHEN p <> '' THEN ':' || p ELSE '' END AS w FROM c)
  SELECT doc_id, ref_idx, CASE WHEN style <> 'ieee' AND names = '' AND t = '' THEN '[Incomplete reference]' WHEN style = 'ieee' THEN concat_ws(' ', CASE WHEN names <> '' THEN regexp_replace(names, '\.+$', '') || '.' END, CASE WHEN title <> '' THEN title || '.' END, CASE WHEN ed <> '' THEN regexp_replace(ed, '\.+$', '') || '.' END, CASE WHEN w <> '' THEN w || '.' END, CASE WHEN d <> '' THEN 'doi:' || d END)
    WHEN style = 'apa7' THEN concat_ws(' ', lead_, CASE WHEN book THEN '*' || t || '*' || CASE ed WHEN '' THEN '' WHEN '2nd ed.' THEN ' (2nd ed.)' ELSE ' (3rd ed.)' END || '. ' || pub || '.' ELSE tt || '.' END, CASE WHEN NOT book THEN j END, CASE WHEN d <> '' THEN 'https://doi.org/' || d END)
    WHEN style = 'harvard' AND book THEN concat_ws(' ', lead_, '*' || tt || '*' || CASE WHEN ed <> '' THEN ' (' || ed || ')' ELSE '' END || '.', pub || '.', CASE WHEN d <> '' THEN 'doi:' || d END)
    WHEN style = 'harvard' THEN concat_ws(' ', lead_, chr(39) || tt || chr(39) || '.', j, CASE WHEN d <> '' THEN 'doi:' || d END) ELSE concat_ws(' ', lead_, tt || '.', j, CASE WHEN d <> '' THEN 'doi:' || d END) END AS reference FROM e""")
def formatted_references(t):
    """References in four styles, with up to 23 authors and any part absent."""
    authors = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda i: F.concat(F.col("name"), F.chr(i + 96), F.lit(", A.")))).otherwise(F.array().cast("array<string>"))
    return R.formatted(t.styled.withColumn("authors", authors)).select("doc_id", "ref_idx", "reference")


DERIVED |= {
    "sketches": """SELECT doc_id, ref_idx, CASE WHEN ref_idx % 9 = 0 THEN '' ELSE author END AS authors, CASE WHEN ref_idx % 11 = 0 THEN NULL ELSE CAST(year AS STRING) END AS year, CASE WHEN ref_idx % 8 = 0 THEN '' ELSE title END AS title, CASE WHEN ref_idx % 4 = 0 THEN 'J.' WHEN ref_idx % 4 = 1 THEN NULL ELSE journal END AS source,
        CASE WHEN ref_idx % 3 = 0 THEN '1' END AS volume, '' AS issue, CAST(NULL AS STRING) AS pages, '' AS publisher, CASE WHEN ref_idx % 5 < 2 THEN upper(doi) END AS doi, CASE WHEN ref_idx % 13 = 0 THEN 'https://e.org/1' ELSE '' END AS url, CASE WHEN ref_idx % 7 = 0 THEN ref_idx % 120 ELSE 0 END AS messiness FROM {fields}""",
    "works": """SELECT source_api, concat(name, CASE source_api WHEN 'crossref' THEN '' ELSE ', A.' END) AS authors, year, CASE WHEN k % 19 = 0 AND source_api = 'crossref' THEN '' ELSE title END AS title, journal AS source, CASE WHEN k % 2 = 0 THEN '12' ELSE '' END AS volume, CASE source_api WHEN 'openalex' THEN '3' ELSE '' END AS issue,
        '1-9' AS pages, CASE source_api WHEN 'datacite' THEN 'Big Press' ELSE '' END AS publisher, doi, k % 47 = 0 AS is_retracted FROM (SELECT min(p_partkey) AS k, min(p_name) AS title, min(translate(lower(replace(p_brand, '#', '')), '0123456789', 'abcdefghij')) AS name, CAST(min(1970 + p_size) AS STRING) AS year, min(p_type) AS journal,
        concat('10.1000/', CAST(p_partkey % 700 AS STRING)) AS doi, CASE p_partkey % 3 WHEN 0 THEN 'crossref' WHEN 1 THEN 'openalex' ELSE 'datacite' END AS source_api FROM {part} GROUP BY p_partkey % 700, p_partkey % 3)""",
}
_REBUILT = r"""WITH c AS (SELECT *, CASE source_api WHEN 'crossref' THEN 0 WHEN 'openalex' THEN 1 ELSE 2 END AS rank FROM {works}), bt AS (SELECT lower(title) AS t, year AS y, arg_min(doi, (rank, doi)) AS found FROM c WHERE title <> '' GROUP BY 1, 2),
  m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doi ORDER BY rank) = 1),
  r AS (SELECT s.* REPLACE (coalesce(authors, '') AS authors, coalesce(s.year, '') AS year, coalesce(title, '') AS title, coalesce(source, '') AS source, coalesce(volume, '') AS volume, coalesce(pages, '') AS pages), CASE WHEN doi IS NOT NULL THEN lower(doi) ELSE coalesce(found, '') END AS d, CASE WHEN doi IS NOT NULL THEN 'original' WHEN found IS NOT NULL THEN 'found' ELSE 'missing' END AS doi_source FROM {sketches} s LEFT JOIN bt ON t = lower(title) AND y = s.year),
  j AS (SELECT r.*, m.source_api AS api, coalesce(m.is_retracted, false) AS retracted, @BETTER@ FROM r LEFT JOIN m ON m.doi = r.d),
  k AS (SELECT doc_id, ref_idx, d AS doi, doi_source, retracted, url, messiness, @FIELDS@, array_to_string(list_filter([@NAMES@], lambda x: x IS NOT NULL), ',') AS enhanced FROM j),
  z AS (SELECT *, d_ OR url <> '' AS linked, (authors = '')::INT + (year = '')::INT + (title = '')::INT + (source = '')::INT + (NOT (d_ OR url <> ''))::INT + (messiness > 0)::INT + retracted::INT AS n_issues FROM (SELECT *, doi <> '' AS d_ FROM k)),
  s AS (SELECT *, greatest(0, least(100, 100 - CASE WHEN authors = '' THEN 20 ELSE 0 END - CASE WHEN year = '' THEN 20 ELSE 0 END - CASE WHEN title = '' THEN 25 ELSE 0 END - CASE WHEN source = '' THEN 15 ELSE 0 END - CASE WHEN linked THEN 0 ELSE 10 END - least(20, messiness // 5) + CASE WHEN d_ THEN 5 ELSE 0 END))::BIGINT AS confidence FROM z)"""
_B = ("authors", "year", "title", "source", "volume", "issue", "pages", "publisher")
_REBUILT = _REBUILT.replace("@BETTER@", ", ".join(f"coalesce(m.title <> '' AND m.{f} <> '' AND (r.{f} = '' OR length(m.{f}) > length(r.{f})), false) AS b_{f}, m.{f} AS m_{f}" for f in _B)).replace("@FIELDS@", ", ".join(f"CASE WHEN b_{f} THEN m_{f} ELSE {f} END AS {f}" for f in _B)).replace("@NAMES@", ", ".join(f"CASE WHEN b_{f} THEN '{f}:' || api END" for f in _B))


def _rebuilt(t):
    return R.rebuilt(t.sketches, t.works, ("crossref", "openalex", "datacite"))


@query(_REBUILT + " SELECT doc_id, ref_idx, authors, year, title, source, volume, issue, pages, publisher, doi, doi_source, enhanced, confidence, n_issues::INT AS n_issues, confidence < 70 OR n_issues > 2 OR retracted AS needs_review FROM s")
def rebuilt_references(t):
    """References whose fields are filled from the records of three sources, with the source of each."""
    return _rebuilt(t).select("doc_id", "ref_idx", *R.REBUILT, "doi", "doi_source", F.array_join("enhanced", ",").alias("enhanced"), "confidence", F.size("issues").alias("n_issues"), "needs_review")


@query(_REBUILT + " SELECT doc_id, count(*) AS total, round(avg(confidence), 4) AS average_confidence, count(*) FILTER (doi <> '') AS with_doi, count(*) FILTER (doi_source = 'found') AS dois_found, count(*) FILTER (retracted) AS retracted, count(*) FILTER (confidence < 70 OR n_issues > 2 OR retracted) AS to_review FROM s GROUP BY 1")
def rebuild_stats(t):
    return R.rebuild_stats(_rebuilt(t))


@query("""SELECT doc_id, ref_idx, CASE WHEN doc_id % 2 = 0 THEN CASE ref_idx % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'A and B' ELSE 'A et al.' END || ' (' || year || ')' ELSE '(' || CASE ref_idx % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'A & B' ELSE 'A et al.' END || ', ' || year || ')' END AS citation FROM {fields}""")
def in_text_citations(t):
    names = F.slice(F.array(F.lit("A"), F.lit("B"), F.lit("C")), 1, (F.col("ref_idx") % 3 + 1).cast("int"))
    return t.fields.select("doc_id", "ref_idx", R.in_text(names, F.col("year"), F.col("doc_id") % 2 == 0).alias("citation"))


@query("""SELECT doc_id, ref_idx, array_to_string(list_filter([CASE WHEN ref_idx % 5 = 0 THEN 'missing_title' END, CASE WHEN ref_idx % 7 = 0 THEN 'missing_author' END, CASE WHEN ref_idx % 11 = 0 THEN 'missing_year' END, CASE ref_idx % 13 WHEN 0 THEN 'missing_doi' WHEN 1 THEN 'bad_doi' END], lambda x: x IS NOT NULL), ',') AS issues FROM {fields}""")
def reference_issues(t):
    i = F.col("ref_idx")
    doi = F.when(i % 13 == 0, "").when(i % 13 == 1, "11.x").otherwise(F.col("doi"))
    out = R.issues(F.when(i % 5 == 0, " ").otherwise(F.col("title")), F.when(i % 7 == 0, "").otherwise(F.col("author")), F.when(i % 11 != 0, F.col("year")), doi)
    return t.fields.select("doc_id", "ref_idx", F.array_join(out, ",").alias("issues"))


@query(r"""SELECT doc_id, idx, (CASE WHEN regexp_matches(text, '[.,;:]') THEN 0 ELSE 30 END + CASE WHEN regexp_matches(text, '\s{{3,}}') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(text, '[A-Z][a-z]+,?\s+[A-Z]\.') THEN 0 ELSE 15 END + CASE WHEN regexp_matches(text, '\b(19|20)[0-9]{{2}}\b') THEN 0 ELSE 20 END
  + CASE WHEN upper(text) = text AND lower(text) <> text THEN 15 ELSE 0 END)::BIGINT AS messiness FROM {ref_lines}""")
def messiness(t):
    return t.ref_lines.select("doc_id", "idx", R.messiness(F.col("text")).alias("messiness"))


_QUALITY = r"""CASE WHEN length(text) = 0 THEN 0.0 ELSE round(1e-9 + greatest(0.0, least(length(text) / 500.0::DOUBLE, 10.0) + least(len(regexp_extract_all(text, '[A-Za-z0-9_][''A-Za-z0-9_-]*')) / 100.0::DOUBLE, 10.0) + least(len(regexp_extract_all(text, '\b(?:19|20)[0-9]{{2}}[a-z]?\b')) * 0.5::DOUBLE, 5.0)
  + least(len(regexp_extract_all(text, '\([^)]{{1,180}}\b(?:19|20)[0-9]{{2}}[a-z]?\b[^)]{{0,180}}\)')) * 1.0::DOUBLE, 5.0) + least(len(regexp_extract_all(text, '\b10\.[0-9]{{4,9}}/\S+')) * 1.5::DOUBLE, 5.0) - least(len(regexp_extract_all(text, ' ')) * 0.5::DOUBLE, 5.0)
  - least(len(regexp_extract_all(text, '\b[A-Za-z]\s+[A-Za-z]\s+[A-Za-z]\b')) * 0.35::DOUBLE, 6.0)), 3) END"""


@query(f"SELECT doc_id, {_QUALITY} AS quality FROM {{documents}}")
def page_text_quality(t):
    return t.documents.select("doc_id", R.page_quality(F.col("text")).alias("quality"))


@query("""SELECT c.doc_id, c.pos, CASE WHEN c.author <> f.author AND c.year <> f.year THEN 'wrong_reference' WHEN c.author <> f.author THEN 'author_mismatch' ELSE 'year_mismatch' END AS mismatch FROM (SELECT DISTINCT doc_id, pos, author, year FROM {ay_cites}) c JOIN (SELECT doc_id, min(ref_idx) AS r FROM {fields} GROUP BY 1) m ON c.doc_id = m.doc_id
  JOIN {fields} f ON f.doc_id = m.doc_id AND f.ref_idx = m.r WHERE c.author <> f.author OR c.year <> f.year""")
def mismatches(t):
    first = t.fields.groupBy("doc_id").agg(F.min(F.struct("ref_idx", "author", "year")).alias("f"))
    j = t.ay_cites.select("doc_id", "pos", "author", "year").distinct().join(first, "doc_id")
    return j.select("doc_id", "pos", R.mismatch(F.col("author"), F.col("year"), F.col("f.author"), F.col("f.year")).alias("mismatch")).filter("mismatch is not null")


@query("""SELECT r.purchase_id, account_id, r.job_id FROM {runs} r JOIN {purchases} p USING (purchase_id) JOIN {part_jobs} j USING (job_id) WHERE p.status IN ('paid', 'active') AND (expires_at IS NULL OR expires_at > DATE '1997-01-01') AND j.status = 'completed' AND NOT content_deleted AND NOT result_deleted""")
def access_join(t):
    return A.access(t.purchases, t.runs, t.part_jobs, F.lit("1997-01-01").cast("date"))


@query("""SELECT job_id, arg_max(purchase_id, (created_at, purchase_id)) AS purchase_id FROM (SELECT preview_job_id AS job_id, purchase_id, created_at FROM {purchases} UNION ALL SELECT job_id, purchase_id, created_at FROM {runs} JOIN {purchases} USING (purchase_id)) WHERE job_id IN (SELECT job_id FROM {part_jobs}) GROUP BY 1""")
def purchase_by_either_key(t):
    return A.latest_by_either(t.purchases, t.runs, t.part_jobs)


@query("SELECT purchase_id, account_id FROM {purchases} WHERE created_at >= TIMESTAMP '1999-01-01'")
def retention(t):
    return A.retained(t.purchases, "created_at", F.lit("1999-01-01").cast("timestamp_ntz")).select("purchase_id", "account_id")


@query("""SELECT doc_id, kind, idx FROM (SELECT doc_id, ref_idx AS idx, 'not_found' AS kind, 0 AS r FROM {verification} WHERE status = 'not_found' UNION ALL SELECT doc_id, ref_idx, 'needs_review', 1 FROM {verification} WHERE status = 'needs_review' UNION ALL SELECT doc_id, ref_idx, 'low_score', 2 FROM {verification} WHERE score < 20)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r, idx) <= 40""")
def work_selection(t):
    v = t.verification.withColumn("idx", F.col("ref_idx"))
    return A.work_selection([("not_found", v.filter("status = 'not_found'")), ("needs_review", v.filter("status = 'needs_review'")), ("low_score", v.filter("score < 20"))], 40)


@query("""SELECT doc_id, status, ref_idx FROM (SELECT doc_id, status, ref_idx FROM {verification} QUALIFY row_number() OVER (PARTITION BY doc_id, status ORDER BY ref_idx) <= 3) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ref_idx) <= 8""")
def capped_signals(t):
    return A.capped_by_type(t.verification.select("doc_id", "status", "ref_idx"), "doc_id", "status", ["ref_idx"], 3, 8)


@query("""SELECT f.doc_id, f.ref_idx, coalesce(b.status, 'unknown') AS status FROM {fields} f LEFT JOIN (SELECT doi, arg_min(status, (CASE WHEN status IN ('verified', 'likely') THEN 0 ELSE 1 END, ref_idx, status)) AS status FROM {verification} WHERE attempted GROUP BY 1) b ON b.doi = f.doi""")
def trusted_lookup(t):
    rows = t.verification.filter("attempted").withColumn("key", F.col("doi"))
    return A.trusted_lookup(t.fields.select("doc_id", "ref_idx", F.col("doi").alias("key")), rows).drop("key")


@query(r"""SELECT doc_id, count(*) AS numbers, count(*) FILTER (labelled) AS labelled FROM (SELECT doc_id, regexp_matches(lower(c), '(table|figure|section)\s*$') AS labelled FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z ]*)[\[(]?[0-9]+', 1)) AS c FROM {cite_texts})) GROUP BY 1""")
def number_contexts(t):
    c = t.cite_texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z ]*)[\[(]?[0-9]+"), F.lit(1))).alias("c"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("numbers"), F.count_if(R.labelled_number(F.col("c"))).alias("labelled"))


@query("""SELECT job_id, coalesce(try_cast(try_cast(v AS DOUBLE) AS BIGINT), 0) AS n FROM (SELECT job_id, CASE job_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN CAST(job_id AS VARCHAR) ELSE job_id || '.25' END AS v FROM {jobs})""")
def safe_numbers(t):
    v = F.when(F.col("job_id") % 3 == 0, "x").when(F.col("job_id") % 3 == 1, F.col("job_id").cast("string")).otherwise(F.concat(F.col("job_id").cast("string"), F.lit(".25")))
    return t.jobs.select("job_id", R.safe_int(v).alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'ghana' ELSE 'global' END AS market, CASE WHEN c_nationkey % 3 = 0 THEN 'GHS' ELSE 'USD' END AS currency FROM {customer}""")
def payment_market(t):
    m = T.country_market(F.when(F.col("c_nationkey") % 3 == 0, "gh").otherwise("fr"))
    return t.customer.select("c_custkey", m["market"].alias("market"), m["currency"].alias("currency"))


# --- review
@query("""SELECT doc_id, ref_idx, CASE WHEN doc_id % 2 = 0 THEN title ELSE '' END AS title, status FROM {verification} QUALIFY doc_id % 2 = 0 OR row_number() OVER (PARTITION BY doc_id ORDER BY ref_idx) <= least(10, greatest(1, ceil(count(*) OVER (PARTITION BY doc_id) * 0.25::DOUBLE)))""")
def entitled_rows(t):
    out = V.entitled(t.verification.select("doc_id", "ref_idx", "title", "status"), F.col("doc_id") % 2 == 0, ["title"], "doc_id", ["ref_idx"])
    return out.na.fill("", ["title"])


@query("""SELECT r.doc_id, count(*) AS "references", count(*) FILTER (status IS NULL) AS unchecked, count(*) FILTER (status NOT IN ('verified', 'likely')) AS needs_work FROM {refs} r LEFT JOIN (SELECT * FROM {verification} WHERE attempted) v ON v.doc_id = r.doc_id AND v.ref_idx = r.ref_idx GROUP BY 1""")
def reference_audit(t):
    return V.reference_audit(t.refs, t.verification.filter("attempted"))


_ADVICE = f"""SELECT s.doc_id, total, integrity, recency, balance, diversity FROM ({_SUM}) s JOIN ({_TEMP}) t ON t.doc_id = s.doc_id JOIN ({_DIV}) d ON d.doc_id = s.doc_id"""


@query(f"""SELECT doc_id, CASE WHEN recency >= 70 THEN 'Recency is strong (' || p || '% ≤5 years). Maintain balance with foundational studies.' WHEN more <= 0 THEN 'Recency is acceptable (' || p || '% ≤5 years). Consider adding a few more recent sources.'
  ELSE 'Add approximately ' || more || ' recent source(s) (≤5 years) to improve scholarly relevance (current: ' || p || '%, target: 70%).' END AS recency_advice,
  CASE WHEN integrity >= 80 THEN 'Verification rate is excellent. Continue maintaining high standards.' WHEN integrity >= 60 THEN 'Verification rate is good (' || v || '%). Consider verifying ' || round_even(total * 0.2::DOUBLE, 0)::INT || ' more reference(s) to reach 80%.'
  WHEN integrity >= 40 THEN 'Verification rate needs improvement (' || v || '%). Run online verification for unverified references.' ELSE 'Low verification rate (' || v || '%). Strongly recommend running online verification for all references.' END AS verification_advice,
  CASE WHEN diversity >= 70 THEN 'Excellent author diversity. Citations are well-distributed.' WHEN diversity >= 50 THEN 'Good author diversity (' || e || '%). Consider citing from a broader range of research groups.' ELSE 'Limited author diversity (' || e || '%). Citation concentration is high. Expand to include more varied sources.' END AS diversity_advice,
  CASE WHEN integrity >= 60 AND recency >= 50 AND diversity >= 50 AND balance >= 40 THEN '' ELSE 'Focus on improving: ' || array_to_string(list_filter([CASE WHEN integrity < 60 THEN 'verification' END, CASE WHEN recency < 50 THEN 'recency' END, CASE WHEN diversity < 50 THEN 'diversity' END, CASE WHEN balance < 40 THEN 'temporal balance' END], lambda x: x IS NOT NULL), ', ') END AS priority
  FROM (SELECT *, round_even(recency, 0)::INT AS p, round_even(integrity, 0)::INT AS v, round_even(diversity, 0)::INT AS e, (round_even(0.7::DOUBLE * total, 0) - round_even(recency / 100 * total, 0))::INT AS more FROM ({_ADVICE}))""")
def recommendations(t):
    v = t.verification
    j = I.verification_summary(v).select("doc_id", "total", "integrity").join(I.temporal(v, YEAR), "doc_id").join(I.concentration_and_diversity(v), "doc_id")
    return j.select("doc_id", V.recommendation(F.col("recency"), F.col("total")).alias("recency_advice"), V.verification_advice(F.col("integrity"), F.col("total")).alias("verification_advice"), V.diversity_advice(F.col("diversity")).alias("diversity_advice"), V.priorities(F.col("integrity"), F.col("recency"), F.col("diversity"), F.col("balance")).alias("priority"))


@query("""SELECT doc_id AS id, array_to_string(list_filter(string_split(text, ' '), lambda w: w <> '')[1:180], ' ') AS text FROM {documents} WHERE len(list_filter(string_split(text, ' '), lambda w: w <> '')) > 0""")
def text_from_positions(t):
    index = t.documents.select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", " ")).alias("pos", "word")).filter("word <> ''")
    return V.text_of_positions(index)


@query("""SELECT doc_id, substr(text, greatest(instr(text, 'by Smith') - 20, 1), 8 + least(instr(text, 'by Smith') - 1, 20) + 40) AS context FROM {cite_texts} WHERE instr(text, 'by Smith') > 0""")
def citation_context(t):
    return t.cite_texts.select("doc_id", V.context(F.col("text"), F.lit("by Smith")).alias("context")).filter("context is not null")


@query("""SELECT doc_id, ref_idx, rank, suggestion FROM (SELECT v.doc_id, v.ref_idx, CASE WHEN c.cand_id IS NULL THEN 0 ELSE row_number() OVER w END AS rank, coalesce(c.cand_id::VARCHAR, 'manual_search') AS suggestion, row_number() OVER w AS rn FROM (SELECT * FROM {verification} WHERE status = 'not_found') v
  LEFT JOIN (SELECT p_partkey AS cand_id, p_name AS title, 1970 + p_size AS year FROM {part}) c ON c.title = v.title WINDOW w AS (PARTITION BY v.doc_id, v.ref_idx ORDER BY abs(v.year - c.year), c.cand_id)) WHERE rn <= 3""")
def recovery_rows(t):
    catalog = t.part.select(F.col("p_partkey").alias("cand_id"), F.col("p_name").alias("title"), (F.lit(1970) + F.col("p_size")).alias("year"))
    return V.recovery_rows(t.verification.filter("status = 'not_found'").select("doc_id", "ref_idx", "title", "year"), catalog)


@query("""SELECT doc_id, CASE status WHEN 'verified' THEN 'verified' WHEN 'likely' THEN 'verified_with_metadata_differences' WHEN 'not_found' THEN 'not_found' WHEN 'offline' THEN 'lookup_failed' ELSE 'possible_match_human_review' END AS status, count(*) AS n FROM {verification} GROUP BY 1, 2""")
def canonical_statuses(t):
    return t.verification.groupBy("doc_id", V.canonical_status(F.concat(F.lit(" "), F.upper("status"))).alias("status")).agg(F.count(F.lit(1)).alias("n"))


# --- commerce
@query("SELECT o.purchase_id, o.account_id, email FROM {purchases} o JOIN {accounts} a USING (account_id)")
def order_accounts(t):
    return CO.with_account(t.purchases, t.accounts).select("purchase_id", "account_id", "email")


@query("""SELECT r.account_id, r.job_id, coalesce(credits, -1) AS credits, refunded_at IS NOT NULL AS refunded FROM (SELECT * FROM {reports} QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC, job_id DESC) <= 100) r LEFT JOIN {grants} g USING (job_id)""")
def report_links(t):
    return CO.report_links(t.reports, t.grants).select("account_id", "job_id", F.coalesce("credits", F.lit(-1)).alias("credits"), F.col("refunded_at").isNotNull().alias("refunded"))


@query("SELECT g.job_id FROM {grants} g JOIN {jobs} j USING (job_id) WHERE refunded_at IS NULL AND j.status IN ('failed', 'error')")
def failed_grants(t):
    return CO.failed_grants(t.grants, t.jobs)


@query("""SELECT purchase_id, preview_job_id FROM {purchases} p JOIN {part_jobs} j ON j.job_id = p.preview_job_id WHERE p.provider = 'stripe' AND p.status IN ('paid', 'active') AND confirmed_at IS NULL AND j.status = 'completed' AND NOT content_deleted AND NOT result_deleted
  AND (expires_at IS NULL OR expires_at > TIMESTAMP '1996-01-01') AND (attempted_at IS NULL OR attempted_at < TIMESTAMP '1996-01-01' - INTERVAL '5 minutes')""")
def due_confirmations(t):
    return CO.due_confirmations(t.purchases, t.part_jobs, F.lit("1996-01-01").cast("timestamp_ntz")).select("purchase_id", "preview_job_id")


@query("SELECT r.purchase_id, r.job_id, coalesce(p.status, 'none') AS linked_status FROM {runs} r LEFT JOIN (SELECT * FROM {purchases} WHERE status <> 'pending') p USING (purchase_id)")
def linked_status(t):
    return CO.linked_status(t.runs, t.purchases.filter("status <> 'pending'")).na.fill("none", ["linked_status"])


@query("SELECT job_id, status FROM {jobs} WHERE job_id IN (SELECT job_id FROM {grants})")
def jobs_among(t):
    return CO.among(t.jobs, t.grants, "job_id").select("job_id", "status")


@query("""SELECT count(*) AS total_jobs, coalesce(sum(paid::INT), 0)::BIGINT AS paid_jobs, round(coalesce(sum(amount) FILTER (paid), 0.0)::DOUBLE, 2) AS revenue, sum("references")::BIGINT AS total_references, sum(citations)::BIGINT AS total_citations, sum(verified)::BIGINT AS total_verified, sum(not_found)::BIGINT AS total_not_found FROM {records}""")
def commercial_totals(t):
    return CO.commercial_totals(t.records).withColumn("revenue", F.col("revenue").cast("double"))


@query("""SELECT count(*) AS total_uploads, count(*) FILTER (success) AS total_processed, count(*) FILTER (NOT success) AS total_failed, coalesce(sum("references"), 0)::BIGINT AS total_references FROM {uploads} WHERE ts::DATE >= DATE '1995-06-01'""")
def upload_counters(t):
    return CO.upload_counters(t.uploads, F.lit("1995-06-01").cast("date"))


@query("""SELECT status, count(*) AS n FROM (SELECT lower(trim(coalesce(nullif(manual_decision, ''), nullif(update_type, ''), status))) AS status FROM {verification}) GROUP BY 1""")
def first_status(t):
    return CO.first_status(t.verification, ["manual_decision", "update_type", "status"])


@query("""WITH live AS (SELECT * FROM {grants} WHERE refunded_at IS NULL), twins AS (SELECT account_id, fingerprint, arg_min(job_id, (created_at, job_id)) AS duplicate_of FROM live WHERE recheck_until > TIMESTAMP '1996-06-30' AND fingerprint <> '' GROUP BY 1, 2),
  bal AS (SELECT account_id, sum(remaining)::BIGINT AS balance FROM {lots} WHERE available_at <= DATE '1996-06-30' AND (expires_at IS NULL OR expires_at > DATE '1996-06-30') GROUP BY 1),
  q AS (SELECT r.account_id, r.job_id, r.cost, coalesce(balance, 0) AS balance, CASE WHEN o.account_id <> r.account_id THEN 'refused_other_account' WHEN o.account_id IS NOT NULL THEN 'already_unlocked' WHEN t.duplicate_of IS NOT NULL THEN 'duplicate'
    WHEN r.recheck_of IS NOT NULL AND f.job_id IS NOT NULL AND u.recheck_of IS NULL AND r.cost <= f.cost THEN 'recheck' WHEN r.recheck_of IS NOT NULL THEN 'refused_recheck' ELSE 'credits' END AS kind
    FROM {requests} r LEFT JOIN live o ON o.job_id = r.job_id LEFT JOIN twins t ON t.account_id = r.account_id AND t.fingerprint = r.fingerprint LEFT JOIN (SELECT * FROM live WHERE recheck_of IS NULL AND recheck_until > TIMESTAMP '1996-06-30') f ON f.job_id = r.recheck_of AND f.account_id = r.account_id
    LEFT JOIN (SELECT DISTINCT recheck_of FROM live WHERE recheck_of IS NOT NULL) u ON u.recheck_of = r.recheck_of LEFT JOIN bal b ON b.account_id = r.account_id)
  SELECT account_id, job_id, kind, CASE WHEN kind = 'credits' THEN cost ELSE 0 END::BIGINT AS price, balance, kind NOT LIKE 'refused%' AND (kind <> 'credits' OR balance >= cost) AS can_unlock FROM q""")
def unlock_quotes(t):
    from marginalia.operators import ledger as L

    day = F.lit("1996-06-30")
    return CO.quotes(t.requests, t.grants, L.balances(t.lots, day.cast("date")), day.cast("timestamp_ntz"))


# --- dashboards over wider results
_NUM = lambda *paths: "coalesce(" + ", ".join(f"result::JSON ->> '{p}'" for p in paths) + ")"
_INT = lambda *paths: f"CASE WHEN regexp_matches({_NUM(*paths)}, '^[0-9]+$') THEN ({_NUM(*paths)})::BIGINT END"
_LEN = lambda p: f"CASE WHEN json_type(result::JSON, '{p}') = 'ARRAY' THEN json_array_length(result::JSON, '{p}')::BIGINT END"
_OBJ = lambda p: f"coalesce(json_type(result::JSON, '{p}') = 'OBJECT', false)"


@query(f"""SELECT job_id, coalesce({_INT('$.online_verification.summary.total')}, {_INT('$.verification.total')}, {_LEN('$.online_verification.rows')}, 0) AS verification_rows, {', '.join(f"coalesce({_INT(f'$.online_verification.summary.{k}')}, 0) AS {k}" for k in ('verified', 'likely', 'needs_review', 'not_found', 'offline'))} FROM {{wide_jobs}}""")
def verification_metrics(t):
    return D.verification_metrics(t.wide_jobs)


@query(f"""SELECT job_id, coalesce({_LEN('$.claim_support')}, 0) AS claims, coalesce({_LEN('$.recovery.missing_recovery')}, 0) + coalesce({_LEN('$.recovery.verification_recovery')}, 0) AS recovery, coalesce({_LEN('$.suggestions')}, {_LEN('$.suggestions.citations')}, 0) AS suggestions FROM {{wide_jobs}}""")
def work_metrics(t):
    return D.work_metrics(t.wide_jobs)


_WORK = lambda k, u: f"coalesce({_INT(f'$.evidence_resolution_workspace.counts.{k}', f'$.correction_plan.evidence_resolution_workspace.counts.{k}', f'$.feature_usage.{u}')}, 0) AS {k}"


@query(f"""SELECT job_id, {_WORK('total', 'evidence_issues_generated')}, {_WORK('pending', 'evidence_issues_pending')}, {_WORK('resolved', 'evidence_issues_resolved')}, CASE WHEN {_OBJ('$.evidence_resolution_workspace')} OR {_OBJ('$.correction_plan.evidence_resolution_workspace')} THEN 1 ELSE coalesce({_INT('$.feature_usage.evidence_workspace_analyses')}, 0) END::BIGINT AS analyses FROM {{wide_jobs}}""")
def evidence_metrics(t):
    return D.evidence_metrics(t.wide_jobs)


@query(f"""SELECT job_id, CASE WHEN {_OBJ('$.correction_decisions')} THEN 1 ELSE coalesce({_INT('$.feature_usage.tracked_approvals_current')}, 0) END::BIGINT AS approvals FROM {{wide_jobs}}""")
def tracked_approvals(t):
    return D.tracked_approvals(t.wide_jobs)


@query(f"""SELECT job_id, CASE result::JSON ->> '$.academic_voice_settings.enabled' WHEN 'true' THEN 1 ELSE 0 END::BIGINT AS enabled, {_OBJ('$.academic_voice_review')}::BIGINT AS completed, coalesce({_LEN('$.academic_voice_review.signals')}, {_INT('$.feature_usage.academic_voice_signals')}, 0) AS signals,
  CASE WHEN {_OBJ('$.academic_voice_revisions')} THEN 2 ELSE 0 END::BIGINT AS revisions FROM {{wide_jobs}}""")
def voice_flags(t):
    return D.voice_flags(t.wide_jobs)


# --- evidence workspace and normal forms
_CATEGORY = "CASE ref_idx % 6 WHEN 0 THEN 'source_verification' WHEN 1 THEN 'claim_support' WHEN 2 THEN 'missing_reference' WHEN 3 THEN 'citation_formatting' WHEN 4 THEN 'unknown_kind' ELSE 'citation_needed' END"
_GROUP = """CASE c WHEN 'source_verification' THEN CASE status WHEN 'not_found' THEN 'references_not_found' WHEN 'offline' THEN 'verification_lookup_failed' ELSE 'unresolved_verification' END WHEN 'claim_support' THEN 'unsupported_claims' WHEN 'missing_reference' THEN 'missing_references' WHEN 'citation_formatting' THEN 'other_corrections' WHEN 'citation_needed' THEN 'unsupported_claims' END"""


@query(f"""SELECT doc_id, g AS "group", count(*) AS total, count(*) FILTER (manual_decision = '') AS pending, count(*) FILTER (manual_decision <> '') AS resolved, array_to_string(list_sort(list(ref_idx)), ',') AS items FROM (SELECT *, {_GROUP} AS g FROM (SELECT *, {_CATEGORY} AS c FROM {{verification}})) WHERE g IS NOT NULL GROUP BY 1, 2""")
def evidence_workspace(t):
    rows = t.verification.select("doc_id", F.col("ref_idx").alias("item"), F.expr(_CATEGORY).alias("category"), "status", F.col("manual_decision").alias("decision"))
    return V.evidence_workspace(rows)


@query("""SELECT doc_id, ref_idx, CASE support_status WHEN 'strong_support' THEN 'direct_support' WHEN 'related_evidence' THEN 'partial_support' ELSE support_status END AS support, CASE WHEN lower(source_type) = 'blog' OR source_type IS NULL THEN status ELSE 'needs_review' END AS lookup FROM {verification}""")
def canonical_support(t):
    reported = F.when(F.lower("source_type") == "journal-article", "some other state").otherwise(F.concat(F.lit(" "), F.upper(F.replace("status", F.lit("_"), F.lit(" ")))))
    return t.verification.select("doc_id", "ref_idx", V.canonical_support(F.col("support_status")).alias("support"), V.lookup_state(reported).alias("lookup"))


@query("""SELECT doc_id, category, priority, count(*) AS n FROM (SELECT doc_id, 'claim_support' AS category, CASE support_status WHEN 'weak_or_unclear' THEN 'important' ELSE 'critical' END AS priority FROM {verification} WHERE support_status IN ('weak_or_unclear', 'insufficient_evidence')
  UNION ALL SELECT doc_id, 'reference_identity_conflict', 'critical' FROM {verification} WHERE score BETWEEN 1 AND 49 UNION ALL SELECT doc_id, 'reference_incomplete', 'important' FROM {verification} WHERE ref_doi IS NULL
  UNION ALL SELECT doc_id, 'reference_style', 'important' FROM {verification} WHERE ref_doi IS NOT NULL AND status = 'likely' UNION ALL SELECT doc_id, 'reference_metadata', CASE WHEN sure >= 85 THEN 'important' ELSE 'optional' END
    FROM (SELECT doc_id, arg_min(score, ref_idx) AS sure FROM {verification} WHERE lower(ref_doi) <> lower(doi) AND score >= 80 GROUP BY doc_id, lower(ref_doi), lower(doi))) GROUP BY 1, 2, 3""")
def plan_items(t):
    """Items of claims, audits and suggested fixes of every document."""
    v, empty = t.verification, F.lit("")
    audits = v.select("doc_id", (F.col("score") >= 50).alias("accepted"), (F.col("score") / 100.0).alias("title_similarity"), F.array_compact(F.array(F.when(F.col("ref_doi").isNull(), "doi"))).alias("missing"), (F.col("status") == "likely").alias("needs_formatting"))
    fixes = v.select("doc_id", F.col("ref_idx").alias("idx"), F.lit("references").alias("kind"), F.col("ref_doi").alias("original"), F.col("doi").alias("suggested"), empty.alias("issue_type"), empty.alias("fix_type"), empty.alias("reason"), (F.col("score") / 100.0).alias("confidence"))
    return P.counted(P.claim_items(v.select("doc_id", V.canonical_support(F.col("support_status")).alias("support"))), P.audit_items(audits), P.fix_items(fixes))


@query("SELECT doc_id, strip_accents(text) AS folded FROM {documents}")
def folded_text(t):
    return t.documents.select("doc_id", T.strip_accents(F.col("text")).alias("folded"))


@query("""SELECT page_id, sha256(lower(trim(url))) AS token FROM {pages}""")
def hashed_keys(t):
    return t.pages.select("page_id", F.sha2(F.lower(F.trim("url")), 256).alias("token"))


@query("""SELECT job_id, strftime(created_at + INTERVAL '86400 seconds', '%Y-%m-%dT%H:%M:%S') AS deadline FROM {jobs}""")
def deletion_deadlines(t):
    return t.jobs.select("job_id", F.date_format(F.col("created_at") + F.expr("INTERVAL '86400' SECOND"), "yyyy-MM-dd'T'HH:mm:ss").alias("deadline"))


@query(f"""SELECT doc_id, 1 AS page, CASE WHEN q1 > q0 THEN 'torn' ELSE 'whole' END AS engine FROM (SELECT doc_id, {_QUALITY} AS q0, {_QUALITY.replace('text', "regexp_replace(text, '([A-Za-z])', '\\1 ', 'g')")} AS q1 FROM {{documents}})""")
def best_pages(t):
    """Each text as two readers might give it: whole, and with its words torn apart."""
    own = t.documents.select("doc_id", F.lit(1).alias("page"), F.lit("whole").alias("engine"), F.lit(0).alias("rank"), "text")
    torn = own.withColumn("engine", F.lit("torn")).withColumn("rank", F.lit(1)).withColumn("text", F.regexp_replace("text", "([A-Za-z])", "$1 "))
    return R.best_pages(own.unionByName(torn)).select("doc_id", "page", "engine")


@query("""SELECT doc_id, place, text FROM (SELECT l_orderkey AS doc_id, 'b' || l_linenumber AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_quantity < 25 THEN 0 ELSE 1 END, l_extendedprice, l_quantity, l_linenumber) AS place FROM {lineitem})""")
def column_order(t):
    boxes = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(50.0).alias("width"), F.col("l_quantity").cast("double").alias("x0"), F.col("l_extendedprice").cast("double").alias("y0"), F.concat(F.lit("b"), F.col("l_linenumber").cast("string")).alias("text"))
    return R.column_order(boxes).select("doc_id", "place", "text")


@query(r"""WITH s AS (SELECT item_id AS a_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS h, len(w) AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM {benchmark}) WHERE len(w) >= 20),
  k AS (SELECT a_id, n, list_sort(list_transform(h, lambda g: substr(sha256(unhex('%s') || unhex(sha256(unhex('%s') || encode(g)))), 1, 24)))[1:128] AS g FROM s)
  SELECT a.a_id AS a_id, b.a_id AS b_id, round(len(list_intersect(a.g, b.g)) / greatest(len(a.g), len(b.g))::DOUBLE, 4) AS overlap FROM k a JOIN k b ON a.a_id < b.a_id WHERE len(list_intersect(a.g, b.g)) / greatest(len(a.g), len(b.g))::DOUBLE >= 0.6 AND least(a.n, b.n) / greatest(a.n, b.n)::DOUBLE >= 0.6""" % (_padded("key", 0x5C), _padded("key", 0x36)))
def matching_signatures(t):
    """Pairs of items whose signatures match: candidates share a hash, so no pair without one is looked at."""
    s = t.benchmark.select(F.col("item_id").alias("id"), X.signature(F.col("text"), "key").alias("s"), F.size(T.unicode_words(F.col("text"))).alias("n")).filter("s is not null")
    h = s.select("id", F.explode("s").alias("h"))
    pairs = h.select(F.col("id").alias("a_id"), "h").join(h.select(F.col("id").alias("b_id"), "h"), "h").filter("a_id < b_id").select("a_id", "b_id").distinct()
    full = pairs.join(s.select(F.col("id").alias("a_id"), F.col("s").alias("sa"), F.col("n").alias("na")), "a_id").join(s.select(F.col("id").alias("b_id"), F.col("s").alias("sb"), F.col("n").alias("nb")), "b_id")
    return X.signatures_match(full, "sa", "sb", "na", "nb").filter("matches").select("a_id", "b_id", "overlap")
