"""What a manuscript can be mended by: uncited references, suggestions for citations, tracked edits, places of passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.functions.similarity import most_alike
from marginalia.functions.text import word_count

#: Years that a year of one, two or three digits may stand for, as sums; differences of a mistaken year in the order tried.
SHORT_YEARS = {3: (2000, 2010, 2020, 1900), 2: (2000, 1900), 1: (2000, 2010, 2020)}
OFFSETS = (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5)
#: Least likeness of an author's name, and the most that a suggestion by it is trusted.
LEAST_LIKENESS, MOST_TRUST = 75, 0.74
#: References of a list that a citation meets at once.
PIECE = 64


# --- uncited references
def _name_keys(names: Column) -> Column:
    """Keys that two lists of names share if their first names are equal, or both of their first two are the same two."""
    pair = F.array_sort(F.slice(names, 1, 2))
    return F.array_compact(F.array(F.when(F.size(names) >= 1, F.concat(F.lit("f|"), names[0])), F.when(F.size(F.array_distinct(pair)) == 2, F.concat(F.lit("p|"), F.array_join(pair, "|")))))


def uncited(refs: DataFrame, counts: DataFrame, clusters: DataFrame, missing: DataFrame) -> DataFrame:
    """doc_id, ref_idx, state, note_idx of references that nothing cites: uncited, or cited_with_other_year.

    refs(doc_id, ref_idx, names, year); counts(doc_id, ref_idx, times); clusters(doc_id, ref_idx, canonical) of duplicates, canonical
    ones included; missing(doc_id, cite_idx, names, year) are citations without a reference. A duplicate whose canonical reference
    is cited is not uncited. A reference of whose authors a missing citation has another year is told apart, with the first such citation.
    """
    times = counts.select("doc_id", "ref_idx", "times")
    r = refs.join(times, ["doc_id", "ref_idx"], "left").join(clusters, ["doc_id", "ref_idx"], "left")
    of_canonical = times.select("doc_id", F.col("ref_idx").alias("canonical"), F.col("times").alias("c_times"))
    r = r.join(of_canonical, ["doc_id", "canonical"], "left").filter((F.coalesce("times", F.lit(0)) == 0) & (F.coalesce("c_times", F.lit(0)) == 0))
    years = missing.select("doc_id", "cite_idx", "year", F.explode(_name_keys(F.col("names"))).alias("key")).groupBy("doc_id", "key", "year").agg(F.min("cite_idx").alias("cite_idx"))
    years = years.groupBy("doc_id", "key").agg(F.collect_list(F.struct("cite_idx", "year")).alias("years"))  # one entry a year
    asked = r.select("doc_id", "ref_idx", "year", F.explode_outer(_name_keys(F.col("names"))).alias("key")).join(years, ["doc_id", "key"], "left")
    other = F.array_min(F.transform(F.filter("years", lambda y: y["year"] != F.col("year")), lambda y: y["cite_idx"]))
    notes = asked.groupBy("doc_id", "ref_idx").agg(F.min(other).alias("note_idx"))
    return notes.select("doc_id", "ref_idx", F.when(F.col("note_idx").isNull(), "uncited").otherwise("cited_with_other_year").alias("state"), "note_idx")


# --- suggestions
def suggestions(cites: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id, cite_idx, suggested, fix_type, confidence: what a citation without a reference may have meant.

    cites(doc_id, cite_idx, citation, author, year), refs(doc_id, ref_idx, author, year, et_al), years as text. In this order: a year cut
    short, completed to one that the author has; a year within five of the author's; an author's name like one of
    a reference within two years; "et al." that is missing. Years are only changed where the author has one year and no reference
    has the cited one. Authors meet by document and name; the references of a document that a year may mean are gathered, and of each
    such list (in pieces of PIECE) a citation takes the one most alike, so that no pair of names is a row.
    """
    low = lambda c: F.lower(F.trim(c))
    r = refs.select("doc_id", "ref_idx", low(F.col("author")).alias("r_author"), F.col("author").alias("r_name"), F.substring("year", 1, 4).alias("r_year"), "et_al")
    # a citation of no document has no references; said here, so that the tables of both joins are one exchange
    c = cites.filter(F.col("year").rlike("^[0-9]{1,4}[a-z]?$") & F.col("doc_id").isNotNull()).withColumns({"a": low(F.col("author")), "base": F.regexp_replace("year", "[a-z]$", "")}).withColumn("digits", F.length("base"))
    number = F.col("base").cast("int")
    # one row for each of: the author as it stands, the parts of a pair, the first word; n is the place of a name among those whose year counts
    names = F.filter(F.transform(F.array_distinct(F.concat(F.array("a"), F.split("a", " & "), F.split("a", " and "))), F.trim), lambda n: n != "")
    simple, first = ~F.col("a").contains(" "), F.split_part("a", F.lit(" "), F.lit(1))
    asked = c.withColumn("name", F.explode(F.when(simple, F.array("a")).otherwise(F.array_distinct(F.concat(names, F.array("a"), F.array(first))))))
    asked = asked.withColumn("n", F.when(simple, (F.col("a") != "").cast("bigint")).otherwise(F.array_position(names, F.col("name"))))
    one = r.groupBy("doc_id", F.col("r_author").alias("name")).agg(F.collect_set("r_year").alias("years"), F.max("et_al").alias("with_et_al"))
    tried = asked.join(one, ["doc_id", "name"], "left").withColumn("y", F.when((F.size("years") == 1) & (F.col("n") > 0), F.col("years")[0]))
    short = F.coalesce(*[F.when(F.col("digits") == d, F.array_position(F.transform(F.array(*[F.lit(s) for s in sums]), lambda s: (s + number).cast("string")), F.col("y"))) for d, sums in SHORT_YEARS.items()])
    cut = F.when(F.col("y").isNotNull() & (F.col("digits") < 4), F.nullif(short, F.lit(0)))
    gap = F.col("y").cast("int") - number
    step = F.when((F.col("digits") == 4) & (F.col("n") == 1), F.nullif(F.array_position(F.array(*[F.lit(o) for o in OFFSETS]), gap), F.lit(0)))
    several = ~F.lower("citation").contains("et al") & (F.size(F.split(F.trim(F.split_part("citation", F.lit(","), F.lit(1))), r"\s+")) > 2)
    by_facts = tried.withColumns({"cut": cut, "step": step}).select(
        "doc_id", "cite_idx", F.struct("citation", "author", "year", "a", "base").alias("cite"), ((F.col("name") == F.col("a")) & F.array_contains("years", F.col("base"))).alias("known"),
        F.when(F.coalesce("cut", "step").isNotNull(), F.struct(F.coalesce("cut", "step").alias("order"), "n", "y", F.col("cut").isNotNull().alias("malformed"), gap.alias("gap"))).alias("by_year"),
        F.when(F.col("with_et_al"), (F.col("name") == first) & several).alias("et_al"),
    )
    # names: references offer themselves under each year within two
    full = c.select("doc_id", "cite_idx", F.trim(F.regexp_replace("a", r"[^\p{L}\p{N}_\s]", "")).alias("plain"), F.explode(F.when(F.col("digits") == 4, F.array("base")).otherwise(F.transform(F.array(*[F.lit(s) for s in SHORT_YEARS[3]]), lambda s: (s + number).cast("string")))).alias("target"))
    of_year = r.filter("r_author <> ''").groupBy("doc_id", "r_year").agg(F.collect_list(F.struct("ref_idx", "r_author", "r_name")).alias("offers"))
    offered = of_year.select("doc_id", "offers", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda o: (F.col("r_year").cast("int") + o).cast("string"))).alias("target"))
    offered = offered.groupBy("doc_id", "target").agg(F.sort_array(F.flatten(F.collect_list("offers"))).alias("offers"))
    pieces = F.transform(F.sequence(F.lit(1), F.size("offers"), F.lit(PIECE)), lambda i: F.slice("offers", i, PIECE))
    offered = offered.withColumn("offers", F.explode(F.when(F.size("offers") <= PIECE, F.array("offers")).otherwise(pieces)))
    met = full.join(offered, ["doc_id", "target"]).withColumn("like", most_alike("ratio", F.col("plain"), F.col("offers.r_author"))).filter(F.col("like.score") >= LEAST_LIKENESS)
    chosen = F.get("offers", F.col("like.place"))
    by_name = met.select("doc_id", "cite_idx", F.struct((-F.col("like.score")).alias("worst"), chosen["ref_idx"].alias("ref_idx"), chosen["r_author"].alias("r_author"), chosen["r_name"].alias("r_name")).alias("by_name"))
    # dealt by citation before they are sorted for it: there is next to nothing to sum up ahead
    every = by_facts.unionByName(by_name, allowMissingColumns=True).repartition("doc_id", "cite_idx").groupBy("doc_id", "cite_idx").agg(
        F.max("cite").alias("cite"), F.max("known").alias("known"), F.min("by_year").alias("t"), F.min("by_name").alias("b"), F.max("et_al").alias("et_al")
    )
    # regular expressions find whole words; the texts hold no backslash or dollar sign but as themselves
    literal = lambda text: F.regexp_replace(text, r"([\\$])", r"\\$1")
    in_year = F.when(F.col("t.malformed"), F.regexp_replace("cite.citation", F.concat(F.lit(r"(?i)\b\Q"), F.col("cite.base"), F.lit(r"\E\b")), literal(F.col("t.y")))).otherwise(F.replace("cite.citation", "cite.base", "t.y"))
    first_word = F.concat(F.lit(r"(?i)^(.*?)\b\Q"), F.col("cite.author"), F.lit(r"\E\b"))
    in_name = F.regexp_replace("cite.citation", first_word, F.concat(F.lit("$1"), literal(F.col("b.r_name"))))
    with_et_al = F.concat(F.split("cite.author", " ")[0], F.lit(" et al., "), F.col("cite.year"))
    year, name = F.col("t").isNotNull(), F.col("b.r_author") != F.col("cite.a")
    found = every.filter(~F.coalesce("known", F.lit(False)) & (year | F.coalesce(name, F.lit(False)) | F.coalesce("et_al", F.lit(False))))
    rule = lambda y, n, e: F.when(year, y).when(name, n).otherwise(e)
    kind = rule(F.when(F.col("t.malformed"), "year_malformed").otherwise("year_typo"), F.lit("author_normalization_review"), F.lit("add_et_al"))
    trust = rule(F.when(F.col("t.malformed") | (F.abs("t.gap") <= 2), 0.90).otherwise(0.72), F.least(-F.col("b.worst") / 100, F.lit(MOST_TRUST)), F.lit(0.70))
    return found.select("doc_id", "cite_idx", rule(in_year, in_name, with_et_al).alias("suggested"), kind.alias("fix_type"), F.round(trust, 4).alias("confidence"))


# --- tracked edits
def _escaped(name: Column) -> Column:
    return F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))


def citation_edits(paragraphs: DataFrame, changes: DataFrame, peers: DataFrame, style: str = "apa") -> DataFrame:
    """doc_id, para_idx, start, original, replacement, ref_idx: edits of in-text citations whose reference was replaced, none overlapping.

    paragraphs(doc_id, para_idx, text); changes(doc_id, ref_idx, old_names, old_year, new_names, new_year) of approved
    sources; peers(doc_id, name, year) of all references. A change is withheld where two references answer to its first name and year,
    and in paragraphs that stand more than once. Of edits that overlap the one that begins first goes through, the longer one of two.
    """
    n = lambda c: F.size(c)
    alike = peers.groupBy("doc_id", F.lower("name").alias("first"), F.lower("year").alias("old")).agg(F.count(F.lit(1)).alias("same"))
    valid = lambda c: F.col(c).rlike("(?i)^(?:19|20)[0-9]{2}[a-z]?$")
    ch = changes.filter((n("old_names") > 0) & (n("new_names") > 0) & valid("old_year") & valid("new_year")).withColumns({"first": F.lower(F.col("old_names")[0]), "old": F.lower("old_year")})
    ch = ch.join(alike, ["doc_id", "first", "old"], "left").filter(F.coalesce("same", F.lit(0)) <= 1)
    names = F.when(n("old_names") == 1, _escaped(F.col("old_names")[0])).when(n("old_names") == 2, F.concat(_escaped(F.col("old_names")[0]), F.lit(r"\s+(?:and|&)\s+"), _escaped(F.get("old_names", F.lit(1))))).otherwise(F.concat(_escaped(F.col("old_names")[0]), F.lit(r"\s+et\s+al\.")))
    ch = ch.withColumn("pattern", F.concat(F.lit(r"(?i)((?<![\p{L}\p{N}_])"), names, F.lit(r"\s*(?:,\s*|\(\s*)"), _escaped(F.col("old_year")), F.lit(r"\b(?:\s*\))?)")))
    twice = W.partitionBy("doc_id", F.xxhash64("text"))
    p = paragraphs.withColumn("copies", F.count(F.lit(1)).over(twice)).filter("copies = 1").drop("copies")
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_'’-]+)"), F.lit(1))))
    last = F.element_at(F.split("first", r"[^\p{L}\p{N}_'’-]+"), -1)  # a paragraph is looked at for a change only where it has the last word of its first name
    years = F.array_distinct(F.regexp_extract_all("text", F.lit("(?=((?:19|20)[0-9]{2}))"), F.lit(1)))  # and the digits of its year
    near = p.select("doc_id", "para_idx", years.alias("years"), words.alias("key")).join(ch.withColumn("key", last), ["doc_id", "key"]).filter(F.array_contains("years", F.substring("old", 1, 4))).drop("years").join(p, ["doc_id", "para_idx"])
    found = near.select("doc_id", "para_idx", "text", "ref_idx", "new_names", "new_year", F.explode(F.array_distinct(F.regexp_extract_all("text", "pattern", F.lit(1)))).alias("original"))
    narrative, close = F.regexp_extract("original", r"(\()", 1) != "", F.regexp_extract("original", r"(\s*\))$", 1)
    new = F.when(n("new_names") == 1, F.col("new_names")[0]).when(n("new_names") == 2, F.when(narrative | F.lit(style == "harvard"), F.array_join("new_names", " and ")).otherwise(F.array_join("new_names", " & "))).otherwise(F.concat(F.col("new_names")[0], F.lit(" et al.")))
    found = found.withColumn("replacement", F.concat(new, F.when(narrative, " (").otherwise(", "), F.col("new_year"), close)).filter("original <> replacement")
    pieces = F.split("text", F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), _escaped(F.col("original"))), -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.length(F.array_join(F.slice(pieces, 1, i), "")) + (i - 1) * F.length("original"))
    placed = found.filter(F.size(pieces) > 1).select("doc_id", "para_idx", F.explode(ends).alias("start"), "original", "replacement", "ref_idx")
    # a fold over the edits of a paragraph in order: one is dropped where it begins before the end of the last one kept
    edits = F.array_sort(F.collect_list(F.struct("start", (-F.length("original")).alias("size"), "ref_idx", "original", "replacement")))
    chosen = F.aggregate("edits", F.slice("edits", 1, 0), lambda kept, e: F.when((F.size(kept) == 0) | (e["start"] >= F.try_element_at(kept, F.lit(-1))["start"] - F.try_element_at(kept, F.lit(-1))["size"]), F.concat(kept, F.array(e))).otherwise(kept))
    return placed.groupBy("doc_id", "para_idx").agg(edits.alias("edits")).select("doc_id", "para_idx", F.inline(chosen)).drop("size")


def edited(paragraphs: DataFrame, edits: DataFrame) -> DataFrame:
    """paragraphs with edits applied, from the last to the first so that places stay right."""
    per = edits.groupBy("doc_id", "para_idx").agg(F.reverse(F.array_sort(F.collect_list(F.struct("start", "original", "replacement")))).alias("edits"))
    new = F.aggregate("edits", F.col("text"), lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["replacement"], F.substr(t, e["start"] + F.length(e["original"]) + 1)))
    return paragraphs.join(per, ["doc_id", "para_idx"], "left").select("doc_id", "para_idx", F.when(F.col("edits").isNull(), F.col("text")).otherwise(new).alias("text"))


# --- places of passages
def located(passages: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, item_id, page, section, paragraph, sentence of each of passages(id, item_id, passage) in the text of its document.

    A passage stands in the first paragraph that contains it or that it contains, in any case and with any blanks. Paragraphs end at
    blank lines; a page has 500 words; a section begins at a short paragraph in capitals or with a number, "chapter" or "section".
    Where no paragraph fits, the place is null and the section the document's last one.
    """
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\n\s*\n+"), flat), lambda p: p != "")
    p = docs.select(F.col(id_col), F.posexplode(parts).alias("para", "p")).withColumn("w", word_count(F.col("p")))
    order = W.partitionBy(id_col).orderBy("para")
    capitals = (F.col("p") == F.upper("p")) & (F.col("p") != F.lower("p"))
    heading = F.when((F.col("w") <= 14) & (capitals | F.col("p").rlike(r"(?i)^(chapter|section|[0-9]+(?:\.[0-9]+)*)\b")), F.substring("p", 1, 160))
    p = p.withColumns({"section": F.coalesce(F.last(heading, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit("Document body")), "before": F.coalesce(F.sum("w").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    n = passages.select(id_col, "item_id", F.lower(flat(F.coalesce("passage", F.lit("")))).alias("needle"))
    low = F.lower("p")
    fits = (F.col("needle") != "") & (low.contains(F.col("needle")) | F.col("needle").contains(low))
    met = n.join(p, id_col).filter(fits).groupBy(id_col, "item_id", "needle").agg(F.min(F.struct("para", "section", "before", "p")).alias("at"))
    sentences = F.transform(F.split(F.regexp_replace("at.p", r"([.!?]) ", "$1\x1e"), "\x1e"), lambda s: F.lower(F.trim(s)))
    first = F.array_position(F.transform(sentences, lambda s: s.contains(F.substring("needle", 1, 80)) | F.col("needle").contains(F.substring(s, 1, 80))), True)
    place = met.select(id_col, "item_id", (F.floor(F.col("at.before") / 500) + 1).cast("bigint").alias("page"), F.col("at.section").alias("s"), (F.col("at.para") + 1).cast("bigint").alias("paragraph"), F.greatest(first, F.lit(1)).cast("bigint").alias("sentence"))
    ends = p.groupBy(id_col).agg(F.max_by("section", "para").alias("end"))
    return n.select(id_col, "item_id").join(place, [id_col, "item_id"], "left").join(ends, id_col, "left").select(id_col, "item_id", "page", F.coalesce("s", "end", F.lit("Document body")).alias("section"), "paragraph", "sentence")
