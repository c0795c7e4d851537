"""References and citations as strings: filters, repairs, formats, validation, mismatches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.functions.similarity import similarity
from marginalia.functions.text import sentences, word_count


def labelled_number(context: Column) -> Column:
    """Whether the words before a number name a table, figure, section or statistic, so that it is no citation."""
    return F.lower(context).rlike(r"(table|figure|fig\.|section|chapter|equation|appendix|p\s*[<=>]|n\s*=)\s*[\[(]?$")


def numeric_density(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[0-9]")) / F.greatest(F.length(text), F.lit(1))


def claim_like(sentence: Column) -> Column:
    """55 to 520 code points, nine words or more, few digits, no front matter."""
    low = F.lower(sentence)
    front = low.rlike("^(table|figure|chapter|appendix|section|keywords|abstract)")
    return (F.length(sentence) >= 55) & (F.length(sentence) <= 520) & (word_count(sentence) >= 9) & (numeric_density(sentence) < 0.22) & ~front


def claim_like_counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    s = texts.select(id_col, F.explode(sentences(F.col(text_col))).alias("s"))
    return s.groupBy(id_col).agg(F.count(F.lit(1)).alias("sentences"), F.count_if(claim_like(F.col("s"))).alias("claim_like"))


def year_typos(cites: DataFrame, fields: DataFrame) -> DataFrame:
    """Cited (doc_id, author, year) without a reference whose author has exactly one year in the list: that year may be meant."""
    years = fields.groupBy("doc_id", "author").agg(F.min("year").alias("ref_year"), F.max("year").alias("__last"), F.count(F.lit(1)).alias("n")).filter("ref_year = __last").drop("__last")
    return cites.select("doc_id", "author", "year").distinct().join(years, ["doc_id", "author"]).filter("year <> ref_year")


def mismatch(cite_author: Column, cite_year: Column, ref_author: Column, ref_year: Column) -> Column:
    """Kind of difference between a citation and its reference; null when they agree."""
    return F.when((cite_author != ref_author) & (cite_year != ref_year), "wrong_reference").when(cite_author != ref_author, "author_mismatch").when(cite_year != ref_year, "year_mismatch")


def merged_lines(lines: DataFrame, starts: Column) -> DataFrame:
    """lines(doc_id, idx, text) merged into entries: a line that starts one opens it, others continue it."""
    order = W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    grouped = lines.withColumn("entry", F.sum(F.when(starts, 1).otherwise(0)).over(order).cast("bigint"))
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return grouped.groupBy("doc_id", "entry").agg(F.count(F.lit(1)).alias("lines"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def reference_block(lines: DataFrame) -> DataFrame:
    """Lines after the last reference heading of a document and before the next stop heading."""
    low = F.lower(F.trim("text"))
    doc = W.partitionBy("doc_id")
    marked = lines.withColumn("h", F.max(F.when(low.isin("references", "bibliography", "works cited"), F.col("idx"))).over(doc))
    marked = marked.withColumn("stop", F.min(F.when(low.rlike("^(appendix|appendices|acknowledg|about the author)") & (F.col("idx") > F.col("h")), F.col("idx"))).over(doc))
    return marked.filter((F.col("idx") > F.col("h")) & (F.col("stop").isNull() | (F.col("idx") < F.col("stop")))).drop("h", "stop")


def list_format(lines: DataFrame) -> DataFrame:
    """The form of a document's reference list by vote: bracket, numbered or author-year; ties keep this order."""
    t = F.trim("text")
    votes = lines.groupBy("doc_id").agg(F.count_if(t.rlike(r"^\[[0-9]+\]")).alias("bracket"), F.count_if(t.rlike(r"^[0-9]+[.)]\s")).alias("numbered"), F.count_if(t.rlike(r"^[A-Z][a-z]+, [A-Z]\.")).alias("author_year"))
    top = F.greatest("bracket", "numbered", "author_year")
    return votes.select("doc_id", F.when(top == 0, "unknown").when(F.col("bracket") == top, "bracket").when(F.col("numbered") == top, "numbered").otherwise("author_year").alias("form"))


def embedded_entries(text: Column) -> Column:
    """Entries of a flattened author-year list: cut where a dated entry has ended and a new author begins."""
    marked = F.regexp_replace(text, r"([.!?]) ([A-Z][A-Za-z'’-]+, [A-Z]\.)", "$1␞$2")
    return F.transform(F.split(marked, "␞"), lambda s: F.trim(s))


# --- formats
def initials(given: Column) -> Column:
    """Initials of given names, each with a full stop."""
    return F.array_join(F.transform(F.filter(F.split(given, r"[\s.]+"), lambda g: g != ""), lambda g: F.concat(F.upper(F.substring(g, 1, 1)), F.lit("."))), " ")


def author_list(authors: Column, style: Column) -> Column:
    """An array of ``Surname, I.`` as its style joins it: APA 7 names up to 20 authors, APA 6 up to 7, Harvard up to 3, numbered styles all."""
    authors = F.filter(authors, lambda a: F.trim(a) != "")
    n, last = F.size(authors), F.element_at(authors, -1)
    head = lambda k: F.array_join(F.slice(authors, 1, k), ", ")
    joined = lambda sign: F.when(n == 1, F.element_at(authors, 1)).otherwise(F.concat(F.array_join(F.slice(authors, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(sign), last))
    apa = lambda most: F.when(n <= most, joined(", & ")).otherwise(F.concat(head(most - 1), F.lit(", … "), last))
    harvard = F.when(n > 3, F.concat(F.element_at(authors, 1), F.lit(" et al."))).when(n == 2, joined(" and ")).otherwise(joined(", and "))
    numeric = F.array_join(F.transform(authors, lambda a: F.replace(a, F.lit(", "), F.lit(" "))), ", ")
    return F.when(n < 1, "").when(style == "apa7", apa(20)).when(style == "apa6", apa(7)).when(style == "harvard", harvard).otherwise(numeric)


def sentence_case(text: Column) -> Column:
    """A title with single blanks whose first letter, and the first after each colon, is a capital; nothing else changes."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    lead = F.regexp_extract(t, r"^([^A-Za-zÀ-ÖØ-öø-ÿ]*)", 1)
    n = F.length(lead)
    t = F.concat(lead, F.upper(F.substr(t, n + 1, F.lit(1))), F.substr(t, n + 2))
    parts = F.split(t, r":\s*(?=[A-Za-zÀ-ÖØ-öø-ÿ])", -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.substr(p, F.lit(2))))), ": ")


def formatted(refs: DataFrame) -> DataFrame:
    """refs with reference, written in its style (apa7, apa6, harvard, or any numbered one); absent parts leave no marks behind.

    refs(style, authors, year, title, source, volume, issue, pages, doi, publisher, edition): authors an array, all else text. With a
    publisher and no source it is a book, whose edition is named and whose publisher is not, if it is the author. Without
    authors and title it is incomplete. What print sets in italics stands between asterisks.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    part = lambda cond, *cs: F.when(cond, F.concat(*[F.lit(c) if isinstance(c, str) else c for c in cs])).otherwise("")
    joined = lambda *cs: F.array_join(F.filter(F.array(*cs), lambda c: c != ""), " ")
    bare = lambda c: F.regexp_replace(c, r"\.+$", "")
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    doi = F.regexp_replace(F.regexp_replace(text("doi"), r"^https?://(?:dx\.)?doi\.org/", ""), r"(?i)^doi:", "")
    names, year, volume, issue, pages, source, publisher, edition = F.col("__names"), text("year"), text("volume"), text("issue"), text("pages"), text("source"), text("publisher"), text("edition")
    title = F.when(text("title") == "", "[No title]").otherwise(sentence_case(F.col("title")))
    lead = F.trim(F.concat(names, F.lit(" ("), F.when(year == "", "n.d.").otherwise(year), F.lit(").")))
    book, link, colon = (publisher != "") & (source == ""), part(doi != "", "https://doi.org/", doi), part(doi != "", "doi:", doi)
    apa_place = part(volume != "", ", *", volume, "*", part((issue != "") & (issue != volume), "(", issue, ")"), part(pages != "", ", ", pages))
    harvard_place = part(volume != "", ", ", volume, part(issue != "", "(", issue, ")"), part(pages != "", ", pp. ", pages))
    journal = lambda place: part(source != "", "*", source, "*", place, ".")
    named = F.when(edition.rlike(r"(?i)\bed\.?$"), edition).otherwise(F.concat(edition, F.lit(" ed.")))
    apa_book = F.concat(F.lit("*"), sentence_case(F.col("title")), F.lit("*"), part(edition != "", " (", named, ")"), part(key(names) != key(publisher), ". ", publisher), F.lit("."))
    stopped = F.concat(title, F.lit("."))
    apa7 = F.when(book, joined(lead, apa_book, link)).otherwise(joined(lead, stopped, journal(apa_place), link))
    harvard_book = joined(lead, F.concat(F.lit("*"), title, F.lit("*"), part(edition != "", " (", edition, ")"), F.lit(".")), F.concat(publisher, F.lit(".")), colon)
    harvard = F.when(book, harvard_book).otherwise(joined(lead, F.concat(F.lit("'"), title, F.lit("'.")), journal(harvard_place), colon))
    home = bare(F.when(source != "", source).otherwise(publisher))
    where = F.concat(home, part(year != "", F.when(home != "", ". ").otherwise(""), year), part(volume != "", ";", volume), part(issue != "", "(", issue, ")"), part(pages != "", ":", pages))
    numeric = joined(part(names != "", bare(names), "."), part(text("title") != "", bare(text("title")), "."), part(edition != "", bare(edition), "."), part(where != "", bare(where), "."), colon)
    style = F.col("style")
    nothing = style.isin("apa7", "apa6", "harvard") & (names == "") & (text("title") == "")
    out = F.when(nothing, "[Incomplete reference]").when(style == "apa7", apa7).when(style == "apa6", joined(lead, stopped, journal(apa_place), colon)).when(style == "harvard", harvard).otherwise(numeric)
    return refs.withColumn("__names", author_list(F.coalesce("authors", F.array().cast("array<string>")), F.col("style"))).withColumn("reference", out).drop("__names")


#: Fields that a record may add to or replace, what a missing one costs, and its issue.
REBUILT = ("authors", "year", "title", "source", "volume", "issue", "pages", "publisher")
LACKS = (("authors", 20, "Missing author(s)"), ("year", 20, "Missing publication year"), ("title", 25, "Missing title"), ("source", 15, "Missing journal/book title"))


def rebuilt(refs: DataFrame, catalog: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """refs with fields rebuilt from catalog records: doi, doi_source, enhanced (field:source), confidence, issues, needs_review, retracted.

    refs(doc_id, ref_idx, REBUILT, doi, url, messiness), catalog(REBUILT, doi, source_api, is_retracted), all text but the last ones. A
    reference without a DOI takes that of the record with its title and year, by the first source that has one. The record of a DOI, of the first source
    again, then fills every field that is empty and replaces every one that is shorter than its own, if it has a title.
    Confidence starts at 100, less for what is missing and up to 20 for a messy text, and 5 more for a DOI.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    low = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    rank = F.coalesce(*[F.when(F.col("source_api") == s, i) for i, s in enumerate(sources)], F.lit(len(sources)))
    c = catalog.withColumns({"rank": rank, "d": F.lower(text("doi"))}).filter("d <> ''")
    by_title = c.groupBy(low(F.col("title")).alias("t"), text("year").alias("y")).agg(F.min(F.struct("rank", "d")).alias("f")).filter("t <> '' and y <> ''").select("t", "y", F.col("f.d").alias("found"))
    records = c.groupBy("d").agg(F.min(F.struct("rank", "source_api", *[text(f).alias(f) for f in REBUILT], F.coalesce("is_retracted", F.lit(False)).alias("retracted"))).alias("m"))
    r = refs.withColumns({"own": F.lower(text("doi")), "t": low(F.col("title")), "y": text("year")}).join(by_title, ["t", "y"], "left")
    r = r.withColumn("doi", F.when(F.col("own") != "", F.col("own")).otherwise(F.coalesce("found", F.lit("")))).withColumn("doi_source", F.when(F.col("own") != "", "original").when(F.col("doi") != "", "found").otherwise("missing"))
    r = r.join(records, r["doi"] == records["d"], "left").drop("d", "t", "y", "own", "found")
    titled = F.coalesce(F.col("m.title"), F.lit("")) != ""
    better = {f: titled & (F.col(f"m.{f}") != "") & ((text(f) == "") | (F.length(F.col(f"m.{f}")) > F.length(text(f)))) for f in REBUILT}
    r = r.withColumn("enhanced", F.array_compact(F.array(*[F.when(better[f], F.concat(F.lit(f"{f}:"), F.col("m.source_api"))) for f in REBUILT])))
    r = r.withColumns({f: F.when(better[f], F.col(f"m.{f}")).otherwise(text(f)) for f in REBUILT}).withColumn("retracted", F.coalesce("m.retracted", F.lit(False))).drop("m")
    linked, messy = (F.col("doi") != "") | (text("url") != ""), F.coalesce("messiness", F.lit(0))
    score = F.lit(100) - F.when(~linked, 10).otherwise(0) - F.least(F.lit(20), F.floor(messy / 5)) + F.when(F.col("doi") != "", 5).otherwise(0)
    for f, points, _ in LACKS:
        score = score - F.when(F.col(f) == "", points).otherwise(0)
    issues = [F.when(F.col(f) == "", name) for f, _, name in LACKS] + [F.when(~linked, "No DOI or URL found"), F.when(messy > 0, "Original had messy formatting"), F.when(F.col("retracted"), "Retracted")]
    r = r.withColumns({"confidence": F.least(F.lit(100), F.greatest(F.lit(0), score)).cast("bigint"), "issues": F.array_compact(F.array(*issues))})
    return r.withColumn("needs_review", (F.col("confidence") < 70) | (F.size("issues") > 2) | F.col("retracted"))


def rebuild_stats(rows: DataFrame) -> DataFrame:
    """Per document: references, mean confidence, those with a DOI, DOIs found, retracted ones, those to review."""
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), F.round(F.avg("confidence"), 4).alias("average_confidence"), F.count_if(F.col("doi") != "").alias("with_doi"), F.count_if(F.col("doi_source") == "found").alias("dois_found"),
        F.count_if("retracted").alias("retracted"), F.count_if("needs_review").alias("to_review"),
    )


def in_text(surnames: Column, year: Column, narrative: Column) -> Column:
    """Citation of one, two or more authors, in brackets or as part of the sentence."""
    n = F.size(surnames)
    pair = lambda sign: F.concat(F.element_at(surnames, 1), F.lit(sign), F.element_at(surnames, 2))
    many = F.concat(F.element_at(surnames, 1), F.lit(" et al."))
    y = year.cast("string")
    inside = F.when(n == 1, F.element_at(surnames, 1)).when(n == 2, pair(" & ")).otherwise(many)
    outside = F.when(n == 1, F.element_at(surnames, 1)).when(n == 2, pair(" and ")).otherwise(many)
    return F.when(narrative, F.concat(outside, F.lit(" ("), y, F.lit(")"))).otherwise(F.concat(F.lit("("), inside, F.lit(", "), y, F.lit(")")))


def issues(title: Column, author: Column, year: Column, doi: Column) -> Column:
    """Names of what a reference lacks or has wrong."""
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim(title), F.lit("")) == "", "missing_title"), F.when(F.coalesce(F.trim(author), F.lit("")) == "", "missing_author"), F.when(year.isNull(), "missing_year"),
            F.when(F.coalesce(doi, F.lit("")) == "", "missing_doi").when(~doi.rlike("^10[.][0-9]+/[^ ]+$"), "bad_doi"), F.when(doi.contains(" "), "doi_spacing"),
        )
    )


def messiness(text: Column) -> Column:
    """0 to 100: 30 without any mark, 20 for three spaces in a row, 15 without a name and initial, 20 without a year, 15 in capitals."""
    name = text.rlike(r"[A-Z][a-z]+,\s+[A-Z]\.") | text.rlike(r"[A-Z][a-z]+\s+[A-Z]\.")
    shouts = (F.upper(text) == text) & (F.lower(text) != text)
    p = (
        F.when(text.rlike("[.,;:]"), 0).otherwise(30) + F.when(text.rlike(r"\s{3,}"), 20).otherwise(0) + F.when(name, 0).otherwise(15)
        + F.when(text.rlike(r"\b(19|20)[0-9]{2}\b"), 0).otherwise(20) + F.when(shouts, 15).otherwise(0)
    )
    return p.cast("bigint")


def page_quality(text: Column) -> Column:
    """Worth of a page's text: length, words, years, author-year citations and DOIs, each up to a bound, less blanks and letters set apart.

    Only A-Z, a-z, digits and ``_`` make words, so that an accented letter bounds one as a blank does; Java's own boundaries take it for a part.
    """
    count = lambda p: F.regexp_count(text, F.lit(p))
    up = lambda c, bound: F.least(c, F.lit(bound))
    begin, end, space = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])", r"[\t\n\f\r ]"
    year = rf"{begin}(?:19|20)[0-9]{{2}}[a-z]?{end}"
    cites = count(rf"\([^)]{{1,180}}{year}[^)]{{0,180}}\)")
    good = up(F.length(text) / 500.0, 10.0) + up(count(r"[A-Za-z0-9_]['A-Za-z0-9_-]*") / 100.0, 10.0) + up(count(year) * 0.5, 5.0) + up(cites * 1.0, 5.0) + up(count(rf"{begin}10\.[0-9]{{4,9}}/[^\t\n\f\r ]+") * 1.5, 5.0)
    bad = up(count(" ") * 0.5, 5.0) + up(count(rf"{begin}[A-Za-z]{space}+[A-Za-z]{space}+[A-Za-z]{end}") * 0.35, 6.0)
    return F.when(F.length(text) == 0, 0.0).otherwise(F.round(F.greatest(good - bad, F.lit(0.0)) + 1e-9, 3))


def best_pages(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, engine, rank, text): of the texts that several readers give a page, the worthiest; the first reader on a tie."""
    best = F.max_by(F.struct("engine", "text"), F.struct("quality", -F.col("rank")))
    return pages.withColumn("quality", page_quality(F.col("text"))).groupBy("doc_id", "page").agg(best.alias("b"), F.max("quality").alias("quality")).select("doc_id", "page", F.col("b.engine").alias("engine"), F.col("b.text").alias("text"), "quality")


def column_order(boxes: DataFrame) -> DataFrame:
    """boxes(doc_id, page, width, x0, y0, text) with their place in reading order: left column before right, then down, then across."""
    side = F.when(F.col("x0") < F.when(F.coalesce("width", F.lit(0.0)) > 0, F.col("width") / 2).otherwise(300.0), 0).otherwise(1)
    kept = boxes.withColumn("text", F.trim("text")).filter("text <> ''").withColumn("col", side)
    return kept.withColumn("place", F.row_number().over(W.partitionBy("doc_id", "page").orderBy("col", "y0", "x0", "text")))


def file_family(name: Column) -> Column:
    """A file name without its extension and words of revision."""
    stem = F.regexp_replace(F.lower(name), r"[.][a-z0-9]+$", "")
    stem = F.regexp_replace(stem, "(final|revised|revision|corrected|draft|copy|version|v[0-9]+)", " ")
    return F.trim(F.regexp_replace(stem, "[^a-z]+", " "))


def author_metrics(a: Column, b: Column) -> Column:
    """Shared surnames of two arrays, and the ratio of their sorted joins."""
    return F.struct(F.size(F.array_intersect(a, b)).alias("overlap"), similarity("ratio", F.array_join(F.array_sort(a), " "), F.array_join(F.array_sort(b), " ")).alias("similarity"))


def safe_int(c: Column, default: int = 0) -> Column:
    """Integer part of a number in text, else the default."""
    return F.coalesce(c.try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def purged(result: Column, keep: list[str]) -> Column:
    """A JSON object of text with only the kept keys, for deletion of content that keeps its counts."""
    m = F.from_json(result, "map<string,string>")
    return F.to_json(F.map_filter(m, lambda k, v: k.isin(keep)))
