"""Column functions over text: normal forms, identifiers, markers, words. All stay in the JVM."""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dash and quote variants that count as one character.
DASHES, QUOTES = "‐‑‒–—−", "‘’‚‛“”„‟"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
#: Words without weight in titles and claims.
STOPWORDS = [
    "this", "that", "these", "those", "there", "their", "they", "them", "with", "from", "using", "used", "use", "study", "analysis", "method",
    "approach", "results", "table", "figure", "paper", "research", "journal", "review", "would", "could", "should", "might", "what", "when", "where",
    "which", "while", "about", "into", "through", "during", "without", "between", "among", "within", "across", "article", "articles", "author",
    "authors", "evidence", "model", "models", "framework", "frameworks", "effect", "effects", "role", "roles", "impact", "impacts", "relationship",
    "relationships", "factor", "factors", "based", "examines", "examined", "investigates", "investigated", "analyses", "data", "studies", "result",
    "finding", "findings", "conclusion", "conclusions", "discussion", "section", "chapter", "appendix",
]


def norm_space(c: Column) -> Column:
    """No-break spaces, dash and quote variants unified; runs of space closed up."""
    c = F.translate(c, "   " + DASHES + "‘’‚‛", "   " + "-" * len(DASHES) + "''''")
    c = F.translate(c, "“”„‟", '""""')
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_text(c: Column) -> Column:
    """Lower case, only word characters, blanks, ``-``, ``:`` and ``/`` left."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9_\s\-:/]", " "), r"\s+", " "))


#: The beginnings of a title that make it a publication notice; the longest forms first.
NOTICES = ("editorial expression of concern", "expression of concern", "retraction and replacement", "retraction", "withdrawal", "correction", "corrigendum", "erratum", "reinstatement")


def plain_metadata(c: Column) -> Column:
    """Text of a metadata field without markup, its five basic entities resolved, space closed up."""
    c = F.coalesce(c, F.lit(""))
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " "))


def notice_kind(title: Column) -> Column:
    """Kind of publication notice that a title announces (``Retraction: ...``), null for the title of a work."""
    kind = F.lower(F.regexp_extract(plain_metadata(title), rf"(?i)^\s*(?:notice\s+of\s+)?({'|'.join(NOTICES)})\s*[:.\-–—]", 1))
    return F.when(kind.contains("concern"), "expression_of_concern").when(kind.isin("corrigendum", "erratum"), "correction").when(kind != "", F.replace(kind, F.lit(" "), F.lit("_")))


def hmac_sha256(key: str, message: Column) -> Column:
    """Keyed hash in hexadecimal; the key's two paddings are constants, so it stays in the JVM."""
    padded = (hashlib.sha256(key.encode()).digest() if len(key.encode()) > 64 else key.encode()).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in padded)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def unicode_words(c: Column) -> Column:
    """Runs of letters, digits and underscores of any script, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def strip_accents(c: Column) -> Column:
    """Compatibility form without combining marks; no built-in function decomposes text."""

    @F.arrow_udf("string")
    def folded(texts: pa.Array) -> pa.Array:
        plain = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))
        return pa.array([t if t is None or t.isascii() else plain(t) for t in texts.to_pylist()], pa.string())

    return folded(c)


def lookup_text(c: Column) -> Column:
    """Text for equality joins: links and DOIs dropped, everything but letters and digits a blank."""
    c = F.regexp_replace(F.lower(c), r"https?://\S+", " ")
    c = F.regexp_replace(c, r"\bdoi:\s*\S+", " ")
    return F.trim(F.regexp_replace(c, r"[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def reference_key(c: Column) -> Column:
    """A reference without its leading number marker ([1], (1), 1., 1) or superscripts), lower-cased."""
    c = F.translate(c, SUPERSCRIPTS, "0123456789")
    return F.lower(F.trim(F.regexp_replace(c, r"^\s*[\[(]?[0-9]+[\])]?[.)]?\s*", "")))


def normal_doi(c: Column) -> Column:
    """The DOI in a text, lower-cased and without closing punctuation; null where there is none."""
    found = F.regexp_extract(F.lower(c), r"(10\.[0-9]+/[^\s\"'<>]+)", 1)
    return F.nullif(F.regexp_replace(found, r"[.,;:)\]}>]+$", ""), F.lit(""))


def first_year(c: Column) -> Column:
    return F.regexp_extract(c, r"((?:19|20)[0-9][0-9])", 1).try_cast("int")


def base_year(c: Column) -> Column:
    return F.regexp_replace(c, "[a-z]$", "")


def identifiers(c: Column) -> Column:
    """Struct of isbn, pmid, pmcid and arxiv found in a text; null where absent."""
    get = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.struct(
        get(r"(?i)isbn[:\s-]*([0-9][0-9\-]+[0-9Xx])").alias("isbn"), get(r"(?i)pmid[:\s]*([0-9]+)").alias("pmid"), get(r"(?i)(pmc[0-9]+)").alias("pmcid"), get(r"(?i)arxiv[:\s]*([0-9]+\.[0-9]+)").alias("arxiv")
    )


def volume_issue_pages(c: Column) -> Column:
    """Struct of volume, issue and pages of ``12(4): 123-130`` and like forms."""
    c = F.translate(c, DASHES, "-" * len(DASHES))
    get = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.struct(
        get(r"([0-9]+)\s*\([0-9]+\)").alias("volume"), get(r"[0-9]+\s*\(([0-9]+)\)").alias("issue"), F.coalesce(get(r"[:,]\s*([0-9]+-[0-9]+)"), get(r"pp?\.\s*([0-9]+(?:-[0-9]+)?)")).alias("pages")
    )


def words(c: Column, least: int = 3) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z]+", " "), " "), lambda w: F.length(w) >= least)


def significant_words(c: Column, limit: int = 6) -> Column:
    """First distinct words of four letters or more that are not stop words."""
    keep = F.filter(words(c, 4), lambda w: ~w.isin(STOPWORDS))
    return F.slice(F.array_distinct(keep), 1, limit)


def ngrams(tokens: Column, n: int) -> Column:
    """Phrases of n consecutive tokens. Shifted slices are zipped, so that the tokens are made a few times, not once a phrase."""
    count = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    shifted = [F.slice(tokens, F.lit(k + 1), count) for k in range(n)]
    return F.transform(F.arrays_zip(*shifted), lambda z: F.concat_ws(" ", *[z.getField(str(k)) for k in range(n)]))


def numeric_display(num: Column, style: Column) -> Column:
    """A number as its style shows it in the text."""
    return F.when(style == "superscript", F.translate(num, "0123456789", SUPERSCRIPTS)).when(style == "round", F.concat(F.lit("("), num, F.lit(")"))).otherwise(F.concat(F.lit("["), num, F.lit("]")))


def expand_numbers(payload: Column, longest: int = 50) -> Column:
    """``1,3-5`` to [1, 3, 4, 5]; a span longer than longest gives its ends."""
    parts = F.split(F.translate(F.regexp_replace(payload, r"\s", ""), DASHES, "-" * len(DASHES)), "[,;]")

    def one(p: Column) -> Column:
        a, b = F.regexp_extract(p, "^([0-9]+)", 1).try_cast("int"), F.regexp_extract(p, "^[0-9]+-([0-9]+)$", 1).try_cast("int")
        return F.when(b.isNull(), F.array(a)).when((b >= a) & (b - a <= longest), F.sequence(a, F.greatest(a, b))).otherwise(F.array(a, b))

    return F.array_compact(F.flatten(F.transform(parts, one)))


def sentences(c: Column) -> Column:
    """Sentences by an end mark, blanks and a capital, digit or bracket; marks are inserted, so that any regex engine can do it."""
    marked = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"([.!?]) ([A-Z0-9(])", "$1␞$2")
    return F.transform(F.split(marked, "␞"), lambda s: F.trim(s))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: F.length(p) > 0)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.regexp_replace(c, r"[ \t\n\r\x0b\x0c]+", " ")), " "), lambda w: w != "")).cast("bigint")


def country_market(country: Column) -> Column:
    """Market, currency and provider of a country code; the default market is global."""
    home = F.upper(country) == "GH"
    return F.struct(F.when(home, "ghana").otherwise("global").alias("market"), F.when(home, "GHS").otherwise("USD").alias("currency"), F.when(home, "paystack").otherwise("stripe").alias("provider"))
