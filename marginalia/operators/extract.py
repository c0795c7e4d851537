"""Table-valued text functions: citations in their forms, blocks, captions, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.functions.tables import kept, made_once
from marginalia.functions.text import SUPERSCRIPTS, expand_numbers, hmac_sha256, ngrams, unicode_words

#: Opening and closing of the numeric forms.
FORMS = {"square": r"\[([0-9][0-9,;\s\-–]*)\]", "round": r"\(([0-9][0-9]?[0-9]?(?:\s*[,;\-–]\s*[0-9][0-9]?[0-9]?)*)\)"}


def numeric_citations(texts: DataFrame, style: str = "square", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, num: distinct cited numbers of a bracketed form, ranges expanded."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(FORMS[style]), F.lit(1))
    return texts.select(id_col, F.explode(F.array_distinct(F.flatten(F.transform(found, lambda p: expand_numbers(p))))).alias("num"))


def superscript_citations(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    plain = F.translate(F.regexp_replace(F.col(text_col), r"\^\{([0-9,\-]+)\}", "⟦$1⟧"), SUPERSCRIPTS, "⓪①②③④⑤⑥⑦⑧⑨")
    runs = F.array_union(F.regexp_extract_all(plain, F.lit("([⓪①②③④⑤⑥⑦⑧⑨]+)"), F.lit(1)), F.regexp_extract_all(plain, F.lit("⟦([0-9,\\-]+)⟧"), F.lit(1)))
    digits = F.transform(runs, lambda r: F.translate(r, "⓪①②③④⑤⑥⑦⑧⑨", "0123456789"))
    return texts.select(id_col, F.explode(F.array_distinct(F.flatten(F.transform(digits, lambda p: expand_numbers(p))))).alias("num"))


def vancouver_counts(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, num, n: single and list forms scanned apart, so that a number in both counts twice."""
    single = F.regexp_extract_all(F.col(text_col), F.lit(r"[\[(]([0-9]+)[\])]"), F.lit(1))
    several = F.regexp_extract_all(F.col(text_col), F.lit(r"[\[(]([0-9]+(?:\s*,\s*[0-9]+)+)[\])]"), F.lit(1))
    listed = F.transform(several, lambda p: F.array_compact(F.transform(F.split(F.regexp_replace(p, r"\s", ""), ","), lambda x: x.try_cast("int"))))  # lists have no ranges
    nums = F.concat(F.transform(single, lambda x: x.try_cast("int")), F.flatten(listed))
    return texts.select(id_col, F.explode(nums).alias("num")).groupBy(id_col, "num").agg(F.count(F.lit(1)).alias("n"))


def author_year_citations(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, author, year: distinct narrative ``Name (2020)`` and parenthetical ``(Name, 2020; Other, 2019)`` citations."""
    narrative = F.regexp_extract_all(F.col(text_col), F.lit(r"([A-Z][A-Za-z0-9]+(?: et al\.)? \((?:19|20)[0-9][0-9][a-z]?\))"), F.lit(1))
    inner = F.regexp_extract_all(F.col(text_col), F.lit(r"\(([A-Z][^()]*(?:19|20)[0-9][0-9][a-z]?)\)"), F.lit(1))
    parts = F.flatten(F.transform(inner, lambda p: F.split(p, r";\s*")))
    both = F.array_union(narrative, parts)
    rows = texts.select(id_col, F.explode(both).alias("c"))
    return rows.select(id_col, F.lower(F.regexp_extract("c", r"^([A-Z][A-Za-z0-9]+)", 1)).alias("author"), F.regexp_extract("c", r"((?:19|20)[0-9][0-9])", 1).alias("year")).filter("author <> '' and year <> ''").distinct()


def cluster_items(citation: Column) -> Column:
    """Items of a grouped citation."""
    return F.filter(F.transform(F.split(F.regexp_replace(citation, r"^[\[(]|[\])]$", ""), r"\s*;\s*"), lambda x: F.trim(x)), lambda x: x != "")


#: Forms of numbers, labels and captions of tables and figures, verbs that make a sentence of what looks like one, headings.
NUMBER = r"(?:\d+(?:\.\d+)*[A-Z]?|[A-Z]\d*)"
LABEL = rf"(?i)\b(Tables?|Figures?|Figs?\.)\s+({NUMBER})\b"
LINK = rf"\s*(,|/|&|\band\b|[-–—])\s*({NUMBER})\b"
CAPTION = rf"(?i)^\s*(Table|Figure|Fig\.)\s+({NUMBER})\s*(?:[.:–—-]\s*|\s+)(\S.*)$"
PLAIN_CAPTION, BARE_CAPTION = r"(?i)^\s*(?:Table|Figure|Fig\.)\s+\S+\s*[.:–—-]", r"(?i)^\s*(?:Table|Figure|Fig\.)\s+(?:[A-Z]|\d+)(?:\.\d+)*\s*$"
TITLE_VERBS = r"(?i)^(?:shows?|presents?|illustrates?|depicts?|reports?|summari[sz]es?|lists?|provides?|compares?|describes?|displays?|indicates?|demonstrates?)\b"
SKIPPED_HEADING, SECTION_HEADING = r"(?i)^(?:list of tables|list of figures|table of contents|contents|references|bibliography)\b", r"(?i)^(?:chapter\s+\w+|\d+(?:\.\d+)*\s+\w+)"
#: Links of a list of numbers that are read, numbers of a range at most, blocks around a table that its caption may have.
MOST_LINKS, MOST_RANGE, AROUND = 30, 30, 2


def section_blocks(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, block_idx, text and, where there are any, style) with the running section: the last heading at or before a block.

    A heading is a chapter or a numbered line of under 120 characters, or in a document with styles a block of a heading style;
    before the first it is the document body.
    """
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    styled = F.when(F.col("style").rlike(r"(?i)^Heading\s*\d"), F.nullif(F.substring(text, 1, 160), F.lit(""))) if "style" in blocks.columns else F.lit(None)
    head = F.coalesce(styled, F.when(text.rlike(SECTION_HEADING) & (F.length(text) < 120), text))
    order = W.partitionBy("doc_id").orderBy("block_idx").rowsBetween(W.unboundedPreceding, 0)
    return blocks.withColumn("section", F.coalesce(F.last(head, ignorenulls=True).over(order), F.lit("Document body")))


def _kind(label: Column) -> Column:
    return F.when(F.lower(label).startswith("table"), "table").otherwise("figure")


def marked_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that are read, with section, styled (a caption style), near (a table or graphic within two blocks), is_caption, kind, number.

    Lists of contents and references are left out, up to the next numbered heading. style, is_table and is_graphic may be absent.
    """
    return _marked(blocks).filter(~F.col("skipped")).drop("skipped")


def _marked(blocks: DataFrame) -> DataFrame:
    """All blocks, those in lists as skipped and no captions."""
    has = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in blocks.columns else F.lit(False)
    b = section_blocks(blocks).withColumn("text", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    b = b.withColumns({"item": has("is_table") | has("is_graphic"), "is_table": has("is_table"), "styled": F.coalesce(F.lower("style").contains("caption"), F.lit(False)) if "style" in blocks.columns else F.lit(False)})
    order = W.partitionBy("doc_id").orderBy("block_idx")
    stop = F.when(F.col("text").rlike(SKIPPED_HEADING) & (F.length("text") < 90), True).when(F.col("text").rlike(SECTION_HEADING) & (F.length("text") < 120), False)
    b = b.withColumns({"skipped": F.coalesce(F.last(stop, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(False)), "near": F.max("item").over(order.rowsBetween(-AROUND, AROUND)), "place": F.row_number().over(order)})
    title = F.regexp_extract("text", CAPTION, 3)
    is_caption = (title != "") & ~title.rlike(TITLE_VERBS) & (F.col("styled") | F.col("near") | F.col("text").rlike(PLAIN_CAPTION))
    b = b.withColumn("is_caption", ~F.col("skipped") & is_caption)
    return b.withColumns({"kind": F.when(F.col("is_caption"), _kind(F.regexp_extract("text", CAPTION, 1))), "number": F.when(F.col("is_caption"), F.upper(F.regexp_extract("text", CAPTION, 2)))})


def mentioned(text: Column) -> Column:
    """Array of (kind, number) of the tables and figures that a text speaks of: lists and ranges too, as ``Tables 1 and 2`` or ``Figs. 2–4``."""
    spans = F.regexp_extract_all(text, F.lit(rf"{LABEL}((?:{LINK}){{0,{MOST_LINKS}}})"), F.lit(0))
    digits = lambda x: x.rlike(r"^\d+$")

    def expanded(span: Column) -> Column:
        tail = F.regexp_extract(span, rf"{LABEL}(.*)$", 3)
        links = F.zip_with(F.regexp_extract_all(tail, F.lit(rf"(?i){LINK}"), F.lit(1)), F.regexp_extract_all(tail, F.lit(rf"(?i){LINK}"), F.lit(2)), lambda by, n: F.struct(by.alias("by"), n.alias("n")))

        def step(done: Column, x: Column) -> Column:
            last, by, n = F.element_at(done, -1), x["by"], x["n"]
            low, high = last.try_cast("int"), n.try_cast("int")
            run = by.isin("-", "–", "—") & digits(last) & digits(n)
            more = F.when((low < high) & (high - low <= MOST_RANGE), F.transform(F.sequence(low + 1, F.greatest(high, low + 1)), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
            return F.concat(done, F.when(run, more).otherwise(F.array(F.upper(n))))

        first, alone = F.array(F.upper(F.regexp_extract(span, LABEL, 2))), F.length(F.regexp_extract(span, LABEL, 0)) == F.length(span)
        numbers = F.when(alone, first).otherwise(F.aggregate(links, first, step))  # most have no list
        return F.transform(numbers, lambda n: F.struct(_kind(span).alias("kind"), n.alias("number")))

    return F.flatten(F.transform(spans, expanded))


def captions_and_callouts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, kind, number, block_idx, section) of captions, and of every mention in other blocks."""
    return _split(marked_blocks(blocks))


def _split(b: DataFrame) -> tuple[DataFrame, DataFrame]:
    caps = b.filter("is_caption").select("doc_id", "kind", "number", "block_idx", "section")
    return caps, b.filter("not is_caption").select("doc_id", "block_idx", "section", F.inline(mentioned(F.col("text"))))


#: Kinds, and types of findings of a caption, of a mention and of a block.
KINDS = ("table", "figure")
OF_CAPTIONS, OF_MENTIONS, OF_BLOCKS = ("duplicate_number", "unreferenced", "first_mention_after"), ("label_mismatch", "missing_target"), ("missing_caption", "missing_caption_title", "missing_caption_number")


def _judged(blocks: DataFrame) -> DataFrame:
    """A row for each caption and mention, at least one a block, skipped ones too, with kind and number, and a column for each type of finding that says whether it has it.

    All of a document meets in windows, so that blocks are dealt by document once and neither joined nor read again. What a block is
    found to be, or a step of its kind that does not follow (odd_table and odd_figure, the first of a document also jump_table and
    jump_figure), stands in its first row.
    """
    order = W.partitionBy("doc_id").orderBy("block_idx")
    before, upto = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    step = lambda kind: F.when((F.col("kind") == kind) & F.col("number").rlike(r"^\d+$"), F.col("number").cast("bigint"))
    b = _marked(blocks).withColumns({f"step_{k}": step(k) for k in KINDS})
    b = b.withColumns({**{f"odd_{k}": F.coalesce(F.col(f"step_{k}") != F.last(f"step_{k}", ignorenulls=True).over(before) + 1, F.lit(False)) for k in KINDS}, "captioned": F.max(F.coalesce(F.col("kind") == "table", F.lit(False))).over(order.rowsBetween(-AROUND, AROUND))})
    b = b.withColumns({f"jump_{k}": F.col(f"odd_{k}") & (F.count_if(F.col(f"odd_{k}")).over(upto) == 1) for k in KINDS})
    read = ~F.col("skipped")
    plain = read & ~F.col("is_caption")
    b = b.withColumns({
        "missing_caption": read & F.col("is_table") & ~F.col("captioned"), "missing_caption_title": plain & (F.col("styled") | F.col("near")) & F.col("text").rlike(BARE_CAPTION),
        "missing_caption_number": plain & F.col("styled") & (F.col("text") != "") & ~F.col("text").rlike(LABEL.replace(r"(?i)\b", "(?i)^")),
    })
    low = F.lower("text")
    mentions = F.when(read & (low.contains("table") | low.contains("fig")), mentioned(F.col("text")))  # others have no label
    entries = F.when(F.col("is_caption"), F.array(F.struct("kind", "number"))).otherwise(mentions)
    of_block = [*OF_BLOCKS, *[f"{c}_{k}" for c in ("odd", "jump") for k in KINDS]]
    rows = b.select("doc_id", F.col("block_idx").cast("bigint").alias("block_idx"), "section", "is_caption", *of_block, F.posexplode_outer(entries).alias("at", "entry"))
    rows = rows.select("doc_id", "block_idx", "section", "is_caption", "entry.kind", "entry.number", *[(F.col(c) & (F.coalesce("at", F.lit(0)) == 0)).alias(c) for c in of_block])
    # what has a number of one document, by kind; a block without a document has no peers
    peers, here = W.partitionBy("doc_id", "number"), F.col("doc_id").isNotNull()
    is_mention = F.col("kind").isNotNull() & ~F.col("is_caption")
    rows = rows.withColumns({**{f"captions_{k}": F.count_if(here & F.col("is_caption") & (F.col("kind") == k)).over(peers) for k in KINDS}, **{f"first_{k}": F.min(F.when(~F.col("is_caption") & (F.col("kind") == k), F.col("block_idx"))).over(peers) for k in KINDS}})
    of = lambda name: F.when(F.col("kind") == "table", F.col(f"{name}_table")).otherwise(F.col(f"{name}_figure"))
    others = F.when(F.col("kind") == "table", F.col("captions_figure")).otherwise(F.col("captions_table"))
    caption, lost = here & F.col("is_caption"), is_mention & (of("captions") == 0)
    return rows.withColumns({
        "duplicate_number": caption & (of("captions") > 1), "unreferenced": caption & of("first").isNull(), "first_mention_after": caption & F.coalesce(of("first") > F.col("block_idx"), F.lit(False)),
        "label_mismatch": lost & (others > 0), "missing_target": lost & (others == 0),
    })


def audit_findings(blocks: DataFrame) -> DataFrame:
    """doc_id, block_idx, type, priority, kind, number, section of everything amiss with tables, figures and what is said of them.

    Keys are kind and number, so Table 1 and Figure 1 are two; a mention whose number only the other kind has is a mismatch of labels.
    """
    text, block = F.lit(None).cast("string"), F.col("block_idx")
    row = lambda name, kind, number, at=block, section=F.col("section"): F.struct(at.alias("block_idx"), F.lit(name).alias("type"), F.lit("optional" if name == "first_mention_after" else "important").alias("priority"), kind.alias("kind"), number.alias("number"), section.alias("section"))
    found = [F.when(F.col(c), row(c, F.col("kind"), F.col("number"))) for c in (*OF_CAPTIONS, *OF_MENTIONS)]
    found += [F.when(F.col(c), row(c, F.lit("table") if c == "missing_caption" else text, text)) for c in OF_BLOCKS]
    found += [F.when(F.col(f"jump_{k}"), row("numbering_sequence", F.lit(k), text, F.lit(None).cast("bigint"), F.lit("Document body"))) for k in KINDS]
    return _judged(blocks).select("doc_id", F.inline(F.array_compact(F.array(*found))))


def table_audit(blocks: DataFrame) -> DataFrame:
    """Per document: tables, figures, unreferenced captions, missing targets (mismatches of labels too), faults of numbers or captions, all findings."""
    here, steps = F.col("doc_id").isNotNull(), [f"odd_{k}" for k in KINDS]
    n = {c: F.count_if(here & F.col(c)) for c in (*OF_CAPTIONS, *OF_MENTIONS, *OF_BLOCKS)} | {c: F.max(here & F.col(c)).cast("bigint") for c in steps}
    n |= {f"captions_{k}": F.count_if(here & F.col("is_caption") & (F.col("kind") == k)) for k in KINDS}
    total = lambda *names: sum((F.col(f"n_{c}") for c in names), F.lit(0).cast("bigint"))
    sums = _judged(blocks).groupBy("doc_id").agg(*[c.alias(f"n_{name}") for name, c in n.items()])
    return sums.select(
        "doc_id", total("captions_table").alias("tables"), total("captions_figure").alias("figures"), total("unreferenced").alias("unreferenced"), total(*OF_MENTIONS).alias("missing_targets"),
        total("duplicate_number", *OF_BLOCKS, *steps).alias("numbering_or_caption"), total(*OF_CAPTIONS, *OF_MENTIONS, *OF_BLOCKS, *steps).alias("needs_review"),
    )


def caption_gaps(blocks: DataFrame) -> DataFrame:
    """Numbers of captions that do not follow the one before of their kind, in the document's order."""
    caps, _ = captions_and_callouts(blocks)
    num = F.col("number").cast("bigint")
    steps = caps.filter(F.col("number").rlike(r"^\d+$")).withColumns({"num": num, "previous": F.lag(num).over(W.partitionBy("doc_id", "kind").orderBy("block_idx"))})
    return steps.filter(F.col("num") != F.col("previous") + 1).select("doc_id", "kind", "block_idx", "previous", "num")


def nearby_captions(blocks: DataFrame, span: int = AROUND) -> DataFrame:
    """Other blocks with the number of captions within span blocks: a window frame, not a band join."""
    b = marked_blocks(blocks)
    near = F.sum(F.col("is_caption").cast("bigint")).over(W.partitionBy("doc_id").orderBy("block_idx").rangeBetween(-span, span))
    return b.withColumn("captions_near", near).filter("not is_caption").select("doc_id", "block_idx", "captions_near")


def fingerprint(text: Column) -> Column:
    """SHA-256 of the words of a text of twenty words or more, else null."""
    w = unicode_words(text)
    return F.when(F.size(w) >= 20, F.sha2(F.array_join(w, " "), 256))


def signature(text: Column, key: str, k: int = 128) -> Column:
    """The k least keyed hashes of five-word shingles; null below twenty words."""
    return _least_hashes(unicode_words(text), key, k)


def _least_hashes(w: Column, key: str, k: int) -> Column:
    return F.when(F.size(w) >= 20, F.slice(F.sort_array(F.transform(F.array_distinct(ngrams(w, 5)), lambda g: F.substring(hmac_sha256(key, g), 1, 24))), 1, k))


def signatures(texts: DataFrame, key: str, text_col: str = "text", k: int = 128) -> DataFrame:
    """texts of twenty words or more with their signature; words and hashes are made once a text."""
    rows = made_once(texts, "__w", unicode_words(F.col(text_col))).filter(F.size("__w") >= 20)
    return rows.withColumn("signature", _least_hashes(F.col("__w"), key, k)).drop("__w")


def signatures_match(pairs: DataFrame, a: str, b: str, na: str, nb: str) -> DataFrame:
    """pairs whose signatures share 0.6 of the larger one and whose lengths in words are within 0.6 of each other."""
    shared = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))
    ratio = F.least(na, nb) / F.greatest(F.col(na), F.col(nb), F.lit(1))
    matches = F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & (F.least(na, nb) > 0) & (shared >= 0.6) & (ratio >= 0.6), F.lit(False))
    return pairs.withColumn("overlap", F.coalesce(F.round(shared, 4), F.lit(0.0))).withColumn("matches", matches)


def line_key(line: Column) -> Column:
    """A line by which headers and footers of pages are known: numbers of up to four digits as #."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"\b[0-9]{1,4}\b", "#"), r"\s+", " "))


def _edges(pages: DataFrame) -> DataFrame:
    lines = F.filter(F.split("text", r"\n"), lambda x: F.trim(x) != "")
    n = F.size("__l")
    ends = F.concat(F.slice("__l", 1, 4), F.slice("__l", F.greatest(n - 3, F.lit(1)), 4))
    return pages.withColumn("__l", lines).select("source", "page", F.explode(ends).alias("line"))


def repeated_lines(pages: DataFrame, share: float = 0.45, least: int = 3) -> DataFrame:
    """Keys of 4 to 120 characters among the first and last four lines of the pages of a source, met as often as a share of its pages (least at least)."""
    total = pages.groupBy("source").agg(F.countDistinct("page").alias("pages"))
    keys = _edges(pages).select("source", line_key(F.col("line")).alias("line")).filter((F.length("line") >= 4) & (F.length("line") <= 120))
    df = keys.groupBy("source", "line").agg(F.count(F.lit(1)).alias("df"))
    return df.join(total, "source").filter(F.col("pages") >= 3).filter(F.col("df") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share)))


def without_lines(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """Lines of pages whose key is not repeated, wherever they stand."""
    lines = pages.select("source", "page", F.posexplode(F.split("text", r"\n")).alias("idx", "raw")).withColumn("line", line_key(F.col("raw")))
    return lines.join(repeated.select("source", "line"), ["source", "line"], "left_anti")
