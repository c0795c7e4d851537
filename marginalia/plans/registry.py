"""Registry of queries and their DuckDB SQL, and the derived tables that both engines read.

A derived table is one SELECT in the dialect that Spark and DuckDB share; ``{name}`` stands for a base or
derived table. Operators themselves are DataFrame functions; the SQL of an oracle is written apart from them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The supplied corpus has no citations; these tables give the operators citations, references, jobs and ledgers.
DERIVED = {
    "cites": "SELECT l_suppkey AS doc_id, CAST(l_partkey AS STRING) AS num, l_orderkey * 10 + l_linenumber AS pos FROM {lineitem} WHERE l_linenumber >= 2",
    "refs": "SELECT DISTINCT l_suppkey AS doc_id, l_partkey AS ref_idx, CAST(l_partkey AS STRING) AS num FROM {lineitem} WHERE l_linenumber <= 2",
    "fields": """SELECT doc_id, ref_idx, p_name AS title, translate(lower(replace(p_brand, '#', '')), '0123456789', 'abcdefghij') AS author, 1970 + p_size AS year, p_type AS journal,
        concat('10.1000/', CAST(ref_idx % 700 AS STRING)) AS doi FROM {refs} JOIN {part} ON p_partkey = ref_idx""",
    "ay_cites": """SELECT l_suppkey AS doc_id, l_orderkey * 10 + l_linenumber AS pos, translate(lower(replace(p_brand, '#', '')), '0123456789', 'abcdefghij') AS author, 1970 + p_size + CASE WHEN l_orderkey % 9 = 0 THEN 1 ELSE 0 END AS year
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE l_linenumber >= 4""",
    "verification": """SELECT doc_id, ref_idx, title, CASE WHEN ref_idx % 4 = 0 THEN concat(author, ', co', translate(CAST(ref_idx % 9 AS STRING), '0123456789', 'abcdefghij')) ELSE author END AS author, year, journal, doi, ref_idx % 101 AS score,
        CASE WHEN ref_idx % 17 = 0 THEN 'https://doi.org/10.1000/other' WHEN ref_idx % 3 = 0 THEN NULL ELSE doi END AS ref_doi, CASE ref_idx % 19 WHEN 0 THEN 'Blog' WHEN 1 THEN 'journal-article' ELSE NULL END AS source_type,
        CASE ref_idx % 23 WHEN 0 THEN '404' WHEN 1 THEN '200' ELSE NULL END AS link_status, CASE WHEN ref_idx % 29 = 0 THEN 'Erratum' ELSE '' END AS update_type, CASE WHEN ref_idx % 8 = 0 THEN 1 ELSE 0 END AS event_count,
        CASE ref_idx % 31 WHEN 0 THEN 'manual_verified' WHEN 1 THEN 'manual_not_verified' WHEN 2 THEN 'not_indexed_but_plausible' WHEN 3 THEN 'keep_needs_review' ELSE '' END AS manual_decision, CASE WHEN ref_idx % 2 = 0 THEN 'https://e.org/1' ELSE '' END AS evidence_url,
        CASE ref_idx % 4 WHEN 0 THEN 'weak_or_unclear' WHEN 1 THEN 'insufficient_evidence' WHEN 2 THEN 'related_evidence' ELSE 'strong_support' END AS support_status,
        CASE ref_idx % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'low' WHEN 2 THEN NULL WHEN 3 THEN 'critical' ELSE 'minor' END AS priority,
        CASE ref_idx % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'likely' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'not_found' ELSE 'offline' END AS status,
        CASE ref_idx % 11 WHEN 0 THEN 'retracted' WHEN 1 THEN 'expression_of_concern' WHEN 2 THEN 'corrected' WHEN 3 THEN 'reinstated' WHEN 4 THEN 'unchecked' WHEN 9 THEN 'withdrawn' WHEN 10 THEN 'publication_notice' ELSE 'clear' END AS publication_status,
        ref_idx % 7 <> 0 AS attempted FROM {fields}""",
    "ay_strings": """SELECT DISTINCT doc_id, pos AS cite_idx, concat(upper(substr(author, 1, 1)), substr(author, 2), CASE pos % 4 WHEN 0 THEN ' et al., ' WHEN 1 THEN ' & Boadu, ' ELSE ', ' END, CAST(year AS STRING)) AS citation FROM {ay_cites}""",
    "ref_strings": """SELECT doc_id, ref_idx, concat(upper(substr(author, 1, 1)), substr(author, 2), ', A.', CASE WHEN ref_idx % 3 = 0 THEN ', & Boadu, K.' ELSE '' END, ' (', CAST(year AS STRING), '). On the ', title, ' of today. ', journal, ', 3(1), 1-9.') AS reference FROM {fields}""",
    "raw_events": """SELECT concat('https://doi.org/10.1000/', CAST(l_partkey % 700 AS STRING), '.') AS link, l_orderkey AS record_id,
        CASE l_orderkey % 6 WHEN 0 THEN 'Retraction' WHEN 1 THEN 'Expression_of_Concern' WHEN 2 THEN 'Corrigendum' WHEN 3 THEN 'Reinstatement' WHEN 4 THEN 'Withdrawal' ELSE 'New-Version Update' END AS label,
        CAST(CAST(l_shipdate AS DATE) AS STRING) AS event_date FROM {lineitem} WHERE l_linenumber = 7 AND l_quantity <= 12""",
    "jobs": """SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status, o_custkey AS account_id,
        o_orderdate AS created_at, o_totalprice AS processing_time,
        concat('{{"summary":{{"word_count":', CAST(o_orderkey % 9000 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN concat(',"reference_entries_found":', CAST(o_orderkey % 60 AS STRING)) ELSE '' END,
          '}},"raw_references":["a","b"],"acii":{{"score":', CAST(o_orderkey % 100 AS STRING), '.5}},"paid":', CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END,
          CASE WHEN o_orderkey % 5 = 0 THEN ',"decisions":{{"a":{{"decision":"approved"}},"b":{{"decision":"rejected"}}}}' ELSE '' END, '}}') AS result FROM {orders}""",
    "lots": """SELECT o_custkey AS account_id, o_orderkey AS lot_id, o_orderkey % 13 AS remaining, CAST(o_orderdate AS DATE) AS available_at,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INT) END AS expires_at FROM {orders}""",
    "plans": """SELECT o_orderkey AS order_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS starts_at, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 12 END AS months,
        CASE WHEN o_orderkey % 2 = 0 THEN 12 ELSE 30 END AS credits, CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE 'paid' END AS status FROM {orders}""",
    "claims": """SELECT doc_id, ref_idx, concat('Adoption ', CASE ref_idx % 5 WHEN 0 THEN 'improves' WHEN 1 THEN 'significantly reduces' WHEN 2 THEN 'may cause' WHEN 3 THEN 'raises' ELSE 'is linked to' END, ' ', title, ' productivity [', CAST(ref_idx AS STRING), ']') AS claim,
        concat(CASE ref_idx % 7 WHEN 0 THEN 'Improved ' WHEN 1 THEN 'Decreasing ' WHEN 2 THEN 'Effects of ' WHEN 3 THEN 'Uptake enhances ' WHEN 4 THEN 'Negative ' ELSE 'Acceptance and ' END, title, CASE WHEN ref_idx % 2 = 0 THEN ' performance' ELSE ' outcomes' END) AS source_title,
        CASE ref_idx % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'likely' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'not_found' ELSE 'offline' END AS status FROM {fields}""",
    "claim_rows": """SELECT doc_id, ref_idx, CASE ref_idx % 13 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('Results show that ', claim) WHEN 3 THEN concat('This study often (see [2])', '') WHEN 4 THEN concat(claim, ', which approximately lowers error and risk (Ama, 2020).') WHEN 5 THEN 'Zebras sing'
        WHEN 6 THEN 'No manuscript claim was extracted; review the cited sentence manually.' WHEN 7 THEN concat('It was found that farmers produce ', source_title) ELSE claim END AS claim,
        CASE ref_idx % 17 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Gravity waves' WHEN 3 THEN 'Product of results' WHEN 4 THEN concat(source_title, ' and reliable stability, raising trust') ELSE source_title END AS source_title,
        CASE ref_idx % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Verified ' WHEN 3 THEN 'likely' WHEN 4 THEN 'needs_review' WHEN 5 THEN 'not_found' WHEN 6 THEN 'offline' WHEN 7 THEN 'unknown' WHEN 8 THEN 'retracted' WHEN 9 THEN 'error' ELSE 'verified' END AS status FROM {claims}""",
    "cite_texts": """SELECT l_orderkey AS doc_id, concat('As shown [', CAST(min(l_linenumber) AS STRING), ',', CAST(max(l_linenumber) AS STRING), '-', CAST(max(l_linenumber) + min(l_partkey) % 4 AS STRING), '] and (', CAST(max(l_suppkey) % 90 AS STRING),
        ', ', CAST(min(l_suppkey) % 90 AS STRING), ') by Smith', CAST(min(l_partkey) % 5 AS STRING), ' (', CAST(1990 + min(l_partkey) % 30 AS STRING), '). See Table ', CAST(min(l_linenumber) AS STRING), ' and doi:10.1000/x', CAST(min(l_partkey) AS STRING), '.') AS text
        FROM {lineitem} GROUP BY l_orderkey""",
    "signals": "SELECT l_suppkey AS doc_id, l_orderkey * 10 + l_linenumber AS idx, min(CASE l_partkey % 5 WHEN 0 THEN 'claim_without_nearby_citation' WHEN 1 THEN 'long_sentence' WHEN 2 THEN 'possible_claim_needing_source_review' ELSE 'repeated_opening' END) AS signal FROM {lineitem} WHERE l_linenumber = 3 GROUP BY l_suppkey, l_orderkey * 10 + l_linenumber",
    "decisions": """SELECT doc_id, concat('uncited_reference-', CAST(rn AS STRING)) AS item_id, CASE WHEN rn % 2 = 0 THEN 'accepted' ELSE 'deferred' END AS decision FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ref_idx) AS rn FROM {refs}) WHERE rn % 3 = 0""",
    "claim_texts": """SELECT doc_id * 100000 + ref_idx AS text_id, concat('Growth matters to all. ', CASE ref_idx % 9 WHEN 0 THEN concat('Previous studies show that ', title, ' adoption significantly affects the performance of many firms and banks in the region.') WHEN 1 THEN concat('Trust in ', title, ' is defined as the willingness of most households to rely on the government for it.')
        WHEN 2 THEN concat('Previous studies [', CAST(ref_idx AS STRING), '] show that ', title, ' adoption significantly affects the performance of many firms.') WHEN 3 THEN concat('The results show that ', title, ' adoption leads to a large and lasting effect of trust on many firms.') WHEN 4 THEN concat('About 45 percent of students in ', title, ' say that inflation is a major problem, as scholars argue, for most of them.')
        WHEN 5 THEN concat('Table 3 shows that the relationship between ', title, ' and trust is commonly known to be a central factor in growth.') WHEN 6 THEN concat('The literature on ', title, ' results in several critical drivers of growth, and research suggests that it contributes to trust (Ama, 2001).')
        WHEN 7 THEN concat('Is the impact of ', title, ' on many firms and banks a major barrier that previous studies show to be widely known?') ELSE concat('It is well established that the influence of ', title, ' on economy and procurement often drives the growth of small firms.') END, ' ', CASE WHEN ref_idx % 4 = 0 THEN 'It is well established that the influence of rings on economy and procurement often drives the growth of small firms. It is well established that the influence of rings on economy and procurement often drives the growth of small firms.' ELSE 'No.' END) AS text FROM {fields}""",
    "blocks": """SELECT doc_id, block_idx, CASE p % 14 WHEN 0 THEN concat('Chapter ', n, '  on rings') WHEN 1 THEN concat(n, '.2 Methods') WHEN 2 THEN concat('Table ', n, '. Growth of rings') WHEN 3 THEN concat('Figure ', n, ': Growth of plates') WHEN 4 THEN concat('As Table ', n, ' and Table ', o, ' show, figure ', n, ' holds.')
        WHEN 5 THEN concat('See Tables ', n, ', 2 and ', o, '; also Fig. ', o, '.') WHEN 6 THEN concat('Figs. ', n, '–', o, ' are below, as is Table A', n, '.') WHEN 7 THEN concat('Table ', n, ' shows it.') WHEN 8 THEN CASE WHEN p % 3 = 0 THEN 'List of Tables' ELSE concat('Fig. ', n, ' A view') END
        WHEN 9 THEN concat('Table ', n, '.', o, ' Growth') WHEN 10 THEN concat('table ', n) WHEN 11 THEN concat('TABLE  A', n, ' - Sums') WHEN 12 THEN '' ELSE 'Plain body text.' END AS text, CASE WHEN p % 5 = 0 THEN 'Caption' WHEN p % 5 = 1 THEN 'Normal' END AS style, p % 14 = 12 AS is_table, p % 17 = 3 AS is_graphic
        FROM (SELECT l_orderkey AS doc_id, l_linenumber AS block_idx, min(l_partkey) AS p, CAST(min(l_suppkey) % 3 + 1 AS STRING) AS n, CAST(max(l_suppkey) % 4 + 2 AS STRING) AS o FROM {lineitem} GROUP BY l_orderkey, l_linenumber)""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_PLACE = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


class Tables:
    """Tables of one folder by name: base ones from Parquet, derived ones by their SELECT."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        sql = DERIVED[name]
        return self.spark.sql(sql, **{n: getattr(self, n) for n in sorted(set(_PLACE.findall(sql)))})


def oracle(sql: str) -> str:
    """SQL with the derived tables that it names as common table expressions."""
    need: dict[str, str] = {}

    def add(text: str) -> None:
        for n in _PLACE.findall(text):
            if n in DERIVED and n not in need:
                add(DERIVED[n])
                need[n] = _PLACE.sub(r"\1", DERIVED[n]).replace("{{", "{").replace("}}", "}")

    add(sql)
    body = _PLACE.sub(r"\1", sql).replace("{{", "{").replace("}}", "}").strip()
    parts = ",\n".join(f"{n} AS ({s})" for n, s in need.items())
    if not need:
        return body
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        return f"WITH {'RECURSIVE ' * recursive}{parts},\n{body[len('WITH RECURSIVE') if recursive else 4 :]}"
    return f"WITH {parts}\n{body}"


def query(sql: str | None = None, name: str | None = None):
    """Register function(tables) -> DataFrame under its name, with the SQL of its oracle."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[key] = oracle(sql)
        return f

    return add
