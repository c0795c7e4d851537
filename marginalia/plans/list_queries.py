"""Queries over reference lists and manuscripts: extraction in every layout, cuts, uncited references, suggestions, edits, places."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.functions.tables import dealt, kept, made_once
from marginalia.operators import fixes as FX
from marginalia.operators import lists as LI
from marginalia.plans.registry import DERIVED, query

_BODY = "A text cites (Missingauthor, 1999).\n\nResults from the survey in 2021. Kofi, K. 2001 is cited.\n\nReferences\n\n"
_END = "\n\nAppendix A\n\nSmith, J. (2001). Not a reference but part of an appendix. Nowhere, 1(2), 1-2."


def _laid_out(t, bare: bool = False):
    """Reference lists as manuscripts: paragraphs, lines, all in one, or wrapped after seven words, by the document's id."""
    text = F.regexp_replace("reference", r" \(([0-9]{4})\)\.", " $1.") if bare else F.col("reference")
    refs = F.transform(F.array_sort(F.collect_list(F.struct("ref_idx", text.alias("reference")))), lambda r: r["reference"])
    lists = t.ref_strings.groupBy("doc_id").agg(refs.alias("refs"))
    wrapped = F.regexp_replace(F.array_join(F.transform(F.split(F.array_join("refs", " "), " "), lambda w, i: F.when(i % 7 == 6, F.concat(w, F.lit("\n"))).otherwise(w)), " "), "\n ", "\n")
    kind = F.col("doc_id") % 4
    body = F.when(kind == 0, F.array_join("refs", "\n\n")).when(kind == 1, F.array_join("refs", "\n")).when(kind == 2, F.array_join("refs", " ")).otherwise(wrapped)
    return lists.select("doc_id", F.concat(F.lit(_BODY), body, F.lit(_END)).alias("text"), body.alias("body"))


_ONCE = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ref_idx, reference FROM (SELECT doc_id, min(ref_idx) AS i, arg_min({text}, ref_idx) AS reference FROM {{ref_strings}} GROUP BY doc_id, lower({text}))"


@query(_ONCE.format(text="reference"))
def reference_lists(t):
    """Every list comes back entry by entry, whatever its layout; what equals an entry before it counts once."""
    return LI.reference_lists(_laid_out(t)).select("doc_id", "ref_idx", "reference")


@query(r"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ref_idx) - 1 AS place, regexp_replace(reference, ' \(([0-9]{{4}})\)\.', ' \1.') AS reference FROM {ref_strings}")
def bare_year_entries(t):
    """Lists with bare years, run together: cut only where a dated entry has closed."""
    rows = _laid_out(t, bare=True).select("doc_id", F.posexplode(LI.cut_entries(F.col("body"))).alias("place", "reference"))
    return rows.select("doc_id", F.col("place").cast("bigint").alias("place"), "reference")


DERIVED |= {
    "named_refs": "SELECT doc_id, ref_idx, title, doi, year, author, CASE WHEN ref_idx % 3 = 0 THEN 'boadu' END AS second FROM {fields}",
    "named_cites": "SELECT doc_id, pos AS cite_idx, author, year, CASE WHEN pos % 4 = 1 THEN 'boadu' END AS second FROM {ay_cites}",
}


@query("""WITH times AS (SELECT r.doc_id, r.ref_idx, count(*) AS times FROM {named_refs} r JOIN {named_cites} c USING (doc_id, author, year) GROUP BY 1, 2),
  missing AS (SELECT c.* FROM {named_cites} c ANTI JOIN {named_refs} r USING (doc_id, author, year)),
  clusters AS (SELECT doc_id, ref_idx, first_value(ref_idx) OVER (PARTITION BY doc_id, doi ORDER BY -length(title), ref_idx) AS canonical FROM {named_refs} QUALIFY count(*) OVER (PARTITION BY doc_id, doi) > 1),
  nothing AS (SELECT r.* FROM {named_refs} r LEFT JOIN times t USING (doc_id, ref_idx) LEFT JOIN clusters k USING (doc_id, ref_idx) LEFT JOIN times x ON x.doc_id = r.doc_id AND x.ref_idx = k.canonical WHERE t.times IS NULL AND x.times IS NULL),
  notes AS (SELECT n.doc_id, n.ref_idx, min(m.cite_idx) AS note_idx FROM nothing n JOIN missing m ON m.doc_id = n.doc_id AND m.year <> n.year AND (m.author = n.author OR (n.second IS NOT NULL AND m.second IS NOT NULL AND list_sort([n.author, n.second]) = list_sort([m.author, m.second]))) GROUP BY 1, 2)
  SELECT doc_id, ref_idx, CASE WHEN note_idx IS NULL THEN 'uncited' ELSE 'cited_with_other_year' END AS state, coalesce(note_idx, -1) AS note_idx FROM nothing LEFT JOIN notes USING (doc_id, ref_idx)""")
def uncited_author_year(t):
    from pyspark.sql.window import Window as W

    r, c = t.named_refs, t.named_cites
    names = lambda df: df.withColumn("names", F.array_compact(F.array("author", "second")))
    keys = ["doc_id", "author", "year"]
    times = r.join(c.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")), keys).select("doc_id", "ref_idx", "times")
    same = W.partitionBy("doc_id", "doi")
    clusters = r.withColumn("n", F.count(F.lit(1)).over(same)).filter("n > 1").withColumn("canonical", F.first("ref_idx").over(same.orderBy(-F.length("title"), "ref_idx"))).select("doc_id", "ref_idx", "canonical")
    return FX.uncited(names(r).select("doc_id", "ref_idx", "names", "year"), times, clusters, names(c.join(r, keys, "left_anti")).select("doc_id", "cite_idx", "names", "year")).withColumn("note_idx", F.coalesce("note_idx", F.lit(-1)))


DERIVED |= {
    "slips": """SELECT doc_id, cite_idx, concat(upper(substr(a, 1, 1)), substr(a, 2), CASE WHEN cite_idx % 11 = 3 THEN ' Boadu Ama' ELSE '' END, ', ', y) AS citation, concat(upper(substr(a, 1, 1)), substr(a, 2)) AS author, y AS year
        FROM (SELECT doc_id, pos AS cite_idx, CASE pos % 5 WHEN 1 THEN substr(author, 1, length(author) - 1) WHEN 2 THEN concat(author, 's') ELSE author END AS a, CASE pos % 7 WHEN 2 THEN substr(CAST(year AS STRING), 2, 3) WHEN 3 THEN CAST(year + 3 AS STRING) WHEN 4 THEN CAST(year - 1 AS STRING) ELSE CAST(year AS STRING) END AS y FROM (SELECT doc_id, pos, min(author) AS author, min(year) AS year FROM {ay_cites} GROUP BY doc_id, pos))""",
    "written_refs": "SELECT doc_id, ref_idx, concat(upper(substr(author, 1, 1)), substr(author, 2)) AS author, CAST(year AS STRING) AS year, ref_idx % 4 = 0 AS et_al FROM {fields}",
}


@query()
def citation_suggestions(t):
    return FX.suggestions(t.slips, t.written_refs)


def _manuscripts(t):
    """Paragraphs with the citations of a document, five in each, in both forms."""
    name = F.concat(F.upper(F.substring("author", 1, 1)), F.substring("author", 2, 40))
    names = F.when(F.col("second").isNotNull(), F.concat(name, F.when(F.col("cite_idx") % 3 == 0, " & ").otherwise(" and "), F.lit("Boadu"))).otherwise(name)
    form = F.when(F.col("cite_idx") % 2 == 0, F.concat(names, F.lit(" ("), F.col("year").cast("string"), F.lit(") shows it"))).otherwise(F.concat(F.lit("It is so ("), names, F.lit(", "), F.col("year").cast("string"), F.lit(")")))
    rows = t.named_cites.select("doc_id", F.floor(F.col("cite_idx") / 50).alias("para_idx"), "cite_idx", form.alias("s"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cite_idx", "s"))), lambda x: x["s"]), ". ")
    return rows.groupBy("doc_id", "para_idx").agg(parts.alias("text"))


def _changes(t):
    name = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 40))
    r = t.named_refs.withColumns({"old_names": F.array_compact(F.array(name("author"), name("second"))), "old_year": F.col("year").cast("string")})
    new = F.when(F.col("ref_idx") % 4 == 0, F.array(F.lit("Mensah"))).when(F.col("ref_idx") % 4 == 1, F.array(F.lit("Mensah"), F.lit("Adu"))).when(F.col("ref_idx") % 4 == 2, F.array(F.lit("Mensah"), F.lit("Adu"), F.lit("Ofori"))).otherwise(F.col("old_names"))
    peers = r.select("doc_id", F.col("old_names")[0].alias("name"), F.col("old_year").alias("year"))
    return r.select("doc_id", "ref_idx", "old_names", "old_year", new.alias("new_names"), (F.col("year") + F.col("ref_idx") % 2).cast("string").alias("new_year")), peers


@query()
def tracked_edits(t):
    return FX.citation_edits(_manuscripts(t), *_changes(t))


@query()
def edited_paragraphs(t):
    p = _manuscripts(t)
    return FX.edited(p, FX.citation_edits(p, *_changes(t)))


_SPACED = "CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END"
#: Words of a passage by which documents that may hold it are found: the second to the seventh.
SEED = 6


@query(rf"""WITH d AS (SELECT doc_id, {_SPACED} AS text, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS flat FROM {{documents}}),
  i AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS needle FROM {{benchmark}}), s AS (SELECT *, array_to_string(string_split(needle, ' ')[2:7], ' ') AS seed FROM i WHERE len(string_split(needle, ' ')) >= 7),
  pairs AS (SELECT doc_id, item_id, needle FROM d JOIN s ON contains(' ' || flat || ' ', ' ' || seed || ' ')),
  q AS (SELECT doc_id, unnest(range(len(l))) AS para, unnest(l) AS p FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM d WHERE doc_id IN (SELECT doc_id FROM pairs))),
  w AS (SELECT *, len(list_filter(string_split(p, ' '), lambda x: x <> '')) AS w FROM q),
  h AS (SELECT *, coalesce(last_value(CASE WHEN w <= 14 AND ((p = upper(p) AND p <> lower(p)) OR regexp_matches(p, '(?i)^(chapter|section|[0-9]+(?:\.[0-9]+)*)\b')) THEN substr(p, 1, 160) END IGNORE NULLS) OVER o, 'Document body') AS section, sum(w) OVER o - w AS before FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY para)),
  m AS (SELECT pairs.doc_id, item_id, needle, para, section, before, p FROM pairs JOIN h ON h.doc_id = pairs.doc_id AND (contains(lower(p), needle) OR contains(needle, lower(p))) QUALIFY row_number() OVER (PARTITION BY pairs.doc_id, item_id ORDER BY para) = 1),
  z AS (SELECT doc_id, arg_max(section, para) AS lasts FROM h GROUP BY 1),
  f AS (SELECT *, list_transform(string_split(regexp_replace(p, '([.!?]) ', '\1␞', 'g'), '␞'), lambda x: lower(trim(x))) AS ss FROM m)
  SELECT pairs.doc_id, pairs.item_id, coalesce(before // 500 + 1, 0)::BIGINT AS page, coalesce(section, lasts) AS section, coalesce(para + 1, 0) AS paragraph, CASE WHEN p IS NULL THEN 0 ELSE greatest(coalesce(list_position(list_transform(ss, lambda x: contains(x, substr(f.needle, 1, 80)) OR contains(f.needle, substr(x, 1, 80))), true), 0), 1)::BIGINT END AS sentence
  FROM pairs LEFT JOIN f USING (doc_id, item_id) LEFT JOIN z ON z.doc_id = pairs.doc_id""")
def passage_places(t):
    """Where the passages of benchmark stand in documents that hold their seed: pages, sections, paragraphs and sentences."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    items = t.benchmark.select("item_id", F.col("text").alias("passage"), F.split(flat("text"), " ").alias("w")).filter(F.size("w") > SEED)
    items = items.select("item_id", "passage", F.array_join(F.slice("w", 2, SEED), " ").alias("seed"))
    words = made_once(dealt(t.documents.select("doc_id", "text"), "doc_id"), "w", F.split(flat("text"), " "))
    seeds = words.select("doc_id", F.explode(T.ngrams(F.col("w"), SEED)).alias("seed"))
    pairs = kept(seeds.join(items, "seed").select("doc_id", "item_id", "passage").distinct())  # read by three branches
    docs = t.documents.select("doc_id", F.expr(_SPACED).alias("text")).join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    return FX.located(pairs, docs).na.fill(0, ["page", "paragraph", "sentence"])


def _boxes(t):
    """lineitem as boxes of text on the pages of a supplier's document: some begin with a number, in brackets or bare."""
    text = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("["), (1 + F.col("l_partkey") % 40).cast("string"), F.lit("] work "), F.col("l_orderkey").cast("string"))).when(F.col("l_partkey") % 3 == 1, F.concat((1 + F.col("l_partkey") % 60).cast("string"), F.lit(". of "), F.col("l_orderkey").cast("string"))).otherwise(F.concat(F.lit("goes on "), F.col("l_orderkey").cast("string")))
    return t.lineitem.select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") % 5).cast("int").alias("page"), F.lit(50.0).alias("width"), F.col("l_quantity").cast("double").alias("x0"), F.col("l_extendedprice").cast("double").alias("y0"), text.alias("text"))


@query()
def boxed_references(t):
    return LI.numbered_references(_boxes(t))
