"""Reference lists in any layout: three extractors side by side for each document, entries cut where a dated one has closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.operators.references import column_order

_NAME = r"\p{L}+(?:[-’']\p{L}+)*"
_PERSON = rf"{_NAME}(?: {_NAME}){{0,4}}, ?(?:\p{{Lu}}\.[ -]?)+"
_PEOPLE = rf"{_PERSON}(?:(?:, ?|,? ?(?:&|and) |, ?(?:&|and) ?){_PERSON})*"
_YEAR = r"(?:1[6-9]|20)\d{2}[a-z]?"
#: A date after the names: in round brackets, or bare with a mark of punctuation behind it.
_DATE = rf"[,;.]? ?(?:\((?:{_YEAR}|n\.d\.)[^()]{{0,20}}\)|{_YEAR} ?[.,:])"
_ORGANISATION = r"((?:\p{Lu}[\p{L}'’-]*|of|the|and|for|in|&)(?: (?:\p{Lu}[\p{L}'’-]*|of|the|and|for|in|&)){0,15})"
#: Words by which the author of an entry is known as an organisation.
ORGANISATIONS = (
    "university", "organisation", "organization", "ministry", "department", "agency", "association", "institute", "institution", "council",
    "commission", "bank", "service", "bureau", "authority", "office", "foundation", "nations",
)
#: Headings that open a list of references, and that end it.
HEADINGS = r"(?i)^(?:references|bibliography|works\s+cited|literature\s+cited|references\s*\[.*\]|references and notes)$"
END_HEADINGS = r"(?i)^(?:appendix|appendices|acknowledg|about the author|list of (?:tables|figures))"
#: Entries that an extractor must find to be believed, least characters of an entry, and where the tail of a text begins.
ENOUGH, LEAST_CHARS, TAIL = 5, 30, 0.7
_CUT = "\x1e"


def norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def starts_entry(text: Column) -> Column:
    """Whether a text begins with the names of people, or an organisation, and a date: the beginning of an entry."""
    org = F.regexp_extract(text, rf"^{_ORGANISATION}{_DATE}", 1)
    known = org.rlike(rf"(?i)\b(?:{'|'.join(ORGANISATIONS)})\b") | org.rlike(r"^\p{Lu}{2,12}$")
    return text.rlike(rf"^{_PEOPLE}{_DATE}") | ((org != "") & known)


def cut_entries(text: Column) -> Column:
    """Entries of an author-year list that runs on in one text.

    Candidates stand after the end of a sentence or an address, before names and a date. A fold over the pieces between them opens an entry only where the
    one before has its date, and the piece begins with people or a known kind of organisation; other pieces go on with the entry before.
    """
    marked = F.regexp_replace(norm(text), rf"((?:[.!?]|https?://\S+)) (?=(?:{_PEOPLE}|{_ORGANISATION}){_DATE})", f"$1{_CUT}")
    pieces = F.transform(F.filter(F.split(marked, _CUT), lambda p: p != ""), lambda p: F.struct(p.alias("text"), starts_entry(p).alias("starts"), p.rlike(rf"\b{_YEAR}\b").alias("dated")))
    none = F.array().cast("array<struct<text:string,dated:boolean>>")

    def step(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        new = F.struct(p["text"].alias("text"), p["dated"].alias("dated"))
        longer = F.struct(F.concat_ws(" ", last["text"], p["text"]).alias("text"), (last["dated"] | p["dated"]).alias("dated"))
        return F.when((F.size(done) == 0) | (p["starts"] & last["dated"]), F.concat(done, F.array(new))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer)))

    return F.transform(F.aggregate(pieces, none, step), lambda e: e["text"])


def repaired(entries: Column) -> Column:
    """Entries with what was torn off them: a number with an address or DOI, and what follows an open range of pages."""
    torn = lambda e: e.rlike(r"(?i)^\d{1,4}\s*[.\-–—]?\s+(?:https?://|doi\b|10\.)")

    def step(done: Column, e: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        open_range = last.rlike(r"[-–—]\s*$") & ~e.rlike(rf"^{_NAME},\s*\p{{Lu}}")
        joined = F.when(torn(e), F.concat_ws(" ", F.rtrim(F.regexp_replace(last, r"[ .]+$", "")), e)).otherwise(F.concat_ws(" ", last, e))
        return F.when((F.size(done) > 0) & (torn(e) | open_range), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(e)))

    return F.aggregate(entries, F.array().cast("array<string>"), step)


def _numbered(lines: Column, marker: str) -> Column:
    """Entries that begin with a marker at the start of a line; other lines go on, a blank one ends an entry."""
    marked = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(marker), F.concat(F.lit(_CUT), x)).when(x == "", F.lit("\x1d")).otherwise(x)), " ")
    return F.transform(F.slice(F.split(marked, _CUT), 2, 1 << 20), lambda e: F.trim(F.split(e, "\x1d")[0]))


def list_lines(docs: DataFrame, lines: str, to: str) -> DataFrame:
    """docs with the lines after the first heading of a list (else from the first line past 0.6 of the text that looks like an entry), up to the heading that ends it."""
    n = F.size(lines)
    at = F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    first = lambda test: F.get(F.transform(F.filter(at, test), lambda p: p["i"]), F.lit(0))
    like = lambda x: x.rlike(r"^\[\d+\]\s+\p{Lu}") | x.rlike(r"^\d{1,3}\.\s+\p{Lu}\p{Ll}") | starts_entry(norm(x))
    d = docs.withColumn("__heading", first(lambda p: p["x"].rlike(HEADINGS)))
    d = d.withColumn("__start", F.when(F.col("__heading").isNotNull(), F.col("__heading") + 1).otherwise(first(lambda p: (p["i"] > n * 0.6) & like(p["x"]))))
    d = d.withColumn("__end", F.coalesce(first(lambda p: (p["i"] > F.col("__start")) & p["x"].rlike(END_HEADINGS)), n))
    body = F.when(F.col("__start").isNotNull(), F.slice(lines, F.col("__start") + 1, F.greatest(F.col("__end") - F.col("__start"), F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return d.withColumn(to, body).drop("__heading", "__start", "__end")


def by_block(body: str) -> Column:
    """Entries of the lines of a list: by their markers where most have one, else cut as a running text."""
    votes = lambda p: F.size(F.filter(body, lambda x: x.rlike(p)))
    square, plain, people = votes(r"^\[\d+\]"), votes(r"^\d{1,3}[.)]\s"), votes(rf"^{_PERSON}")
    text = F.regexp_replace(F.array_join(F.filter(body, lambda x: x != ""), "\n"), r"(?<=\p{Ll})-\n(?=\p{Ll})", "")
    lines = F.col(body)
    return F.when((square > 0) & (square >= plain) & (square >= people), _numbered(lines, r"^\[\d+\]")).when((plain > 0) & (plain >= people), _numbered(lines, r"^\d{1,3}[.)]\s")).otherwise(cut_entries(text))


def by_pattern(text: Column) -> Column:
    """Pieces that look like entries wherever they stand: numbered ones with a title in quotation marks, dated ones of a single author."""
    forms = (r"(\[\d+\]\s+\p{Lu}[\p{L}.\s]+,\s+\p{Lu}[\p{L}.\s]+,\s+[\"“].+?[\"”])", r"((?m)^\d+\.\s+\p{Lu}[\p{L}.\s]+,\s+\p{Lu}[\p{L}.\s]+,\s+[\"“].+?[\"”])", r"(\p{Lu}\p{Ll}+,\s+\p{Lu}\.\s+\(\d{4}\)\.\s+\p{Lu}[\p{L}\s]+\.)")
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in forms])


def by_tail(lines: Column) -> Column:
    """Entries among the last lines of a text: a line with a year, a number in brackets, or an author opens or goes on with one."""
    tail = F.slice(lines, F.floor(F.size(lines) * TAIL).cast("int") + 1, F.greatest(F.size(lines), F.lit(1)))

    def step(acc: Column, x: Column) -> Column:
        year, number, author = x.rlike(r"\b(?:19|20)\d{2}\b"), x.rlike(r"\[\d+\]"), x.rlike(r"\p{Lu}\p{Ll}+,\s+\p{Lu}\.")
        leads = year | number | (author & (F.regexp_count(x, F.lit(r"\b\p{Lu}\p{Ll}{2,}\b")) >= 2))
        opens = number | (x.rlike(r"^\d+\.") & ~x.rlike(r"^\d{4}\.")) | (author & (F.length(acc["now"]) > 50))
        state = lambda now, out: F.struct(now.alias("now"), out.alias("out"))
        more, full = F.concat_ws(" ", acc["now"], x), F.concat(acc["out"], F.array(acc["now"]))
        return (
            F.when((x == "") & (F.length(acc["now"]) > LEAST_CHARS), state(F.lit(""), full)).when((x == "") | ((acc["now"] == "") & ~leads), state(acc["now"], acc["out"]))
            .when(acc["now"] == "", state(x, acc["out"])).when(leads & opens, state(x, full)).otherwise(state(more, acc["out"]))
        )

    end = lambda acc: F.when(F.length(acc["now"]) > LEAST_CHARS, F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"])
    return F.aggregate(tail, F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out")), step, end)


def plausible(entry: Column) -> Column:
    return (F.length(entry) > LEAST_CHARS) & (entry.rlike(r"\d{4}") | entry.rlike(r"\[\d+\]") | entry.rlike(r"\p{Lu}\p{Ll}+,\s+\p{Lu}\."))


def reference_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ref_idx, reference, extractor: the references of every text, in order and each once.

    The list under its heading is taken where it has ENOUGH plausible entries, else the pieces that look like entries where these are
    enough, else what the last lines give. Entries equal but for case and blanks count once, the first of them.
    """
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"(?:\r\n|\r|\n)\z", ""), r"\r\n|\r|\n"), lambda x: F.trim(x))
    d = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), lines.alias("__lines"))
    good = lambda c: F.filter(F.transform(c, norm), plausible)
    d = list_lines(d, "__lines", "__body").withColumn("__cut", by_block("__body")).withColumns({"__block": good(repaired(F.col("__cut"))), "__pattern": good(by_pattern(F.col("__text")))})
    d = d.withColumn("extractor", F.when(F.size("__block") >= ENOUGH, "block").when(F.size("__pattern") >= ENOUGH, "pattern").otherwise("tail"))
    found = F.when(F.col("extractor") == "block", F.col("__block")).when(F.col("extractor") == "pattern", F.col("__pattern")).otherwise(good(by_tail(F.col("__lines"))))
    rows = d.select(id_col, "extractor", F.posexplode(found).alias("place", "reference"))
    first = rows.groupBy(id_col, "extractor", F.lower("reference").alias("key")).agg(F.min(F.struct("place", "reference")).alias("f"))
    order = W.partitionBy(id_col).orderBy("f.place")
    return first.select(id_col, (F.row_number().over(order) - 1).cast("bigint").alias("ref_idx"), F.col("f.reference").alias("reference"), "extractor")



# --- numbered lists on pages
def reading_order(boxes: DataFrame) -> DataFrame:
    """boxes with place: their order in the document, page by page and column by column."""
    placed = column_order(boxes)
    return placed.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("page", "place")))


def longest_chain(numbers: list[int]) -> list[int]:
    """Places of the longest run of markers n, n + 1, n + 2 and so on in their order; of equally long ones the one that ends first, made of the earliest markers."""
    best: dict[int, tuple[int, int]] = {}  # of each number: length of the longest chain that ends with it, and where
    before, length, end = [-1] * len(numbers), 0, -1
    for i, n in enumerate(numbers):
        size, at = best.get(n - 1, (0, -1))
        before[i] = at
        if size + 1 > best.get(n, (0, -1))[0]:
            best[n] = (size + 1, i)
        if size + 1 > length:
            length, end = size + 1, i
    out = []
    while end >= 0:
        out.append(end)
        end = before[end]
    return out[::-1]


def numbered_references(boxes: DataFrame) -> DataFrame:
    """doc_id, number, reference of numbered lists set in boxes(doc_id, page, width, x0, y0, text), over pages and columns.

    A box may open an entry with ``[n]``, ``n.`` or ``n)``. Of these markers the longest chain of consecutive numbers is the list, so
    years, pages and numbers of tables that only look like markers go on with the entry that they stand in; what
    stands before the first marker is not part of it. Only the markers of a document meet in one place, not its boxes.
    """
    b = reading_order(boxes)
    number = F.coalesce(F.nullif(F.regexp_extract("text", r"^\s*\[([0-9]{1,4})\]", 1), F.lit("")), F.nullif(F.regexp_extract("text", r"^\s*([0-9]{1,4})[.)]\s", 1), F.lit(""))).try_cast("int")
    b = b.select("doc_id", F.col("place").cast("bigint").alias("place"), "text", number.alias("number"))
    kind = b.schema["doc_id"].dataType.simpleString()

    def chain(table):
        import pyarrow as pa

        order = table.sort_by("place")
        chosen = longest_chain(order["number"].to_pylist())
        return order.take(pa.array(chosen, pa.int64())).select(["doc_id", "place", "number"])

    starts = b.filter("number is not null").select("doc_id", "place", "number").groupBy("doc_id").applyInArrow(chain, f"doc_id {kind}, place bigint, number int")
    marked = b.drop("number").join(starts, ["doc_id", "place"], "left")
    owner = F.last("number", ignorenulls=True).over(W.partitionBy("doc_id").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    rows = marked.withColumn("entry", owner).filter("entry is not null")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: F.trim(x["text"])), " ")
    return rows.groupBy("doc_id", F.col("entry").alias("number")).agg(parts.alias("reference"))
