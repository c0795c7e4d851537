"""Author-year citations: extraction, parsing, alias keys and reconciliation with a bibliography.

Strings are parsed in Arrow batches, text by text; everything between citations and references is joins on (document, key).
A citation is counted once a document, however often its string stands there.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.functions.similarity import similarity
from marginalia.functions.tables import kept

YEAR = r"(?:1[6-9]\d{2}|20\d{2})[a-z]?"
_YEAR = re.compile(rf"\b({YEAR})\b", re.I)
_NAME = r"[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’\-]+"
#: Words and phrases that lead into a citation and are no authors.
LEADS = (
    "see", "e.g", "eg", "i.e", "ie", "as", "in", "for", "from", "to", "at", "on", "by", "with", "within", "according", "adapted", "based", "cited", "citing", "reported", "like",
    "however", "similarly", "regrettably", "traditionally", "notably", "therefore", "thus", "hence", "consequently", "moreover", "furthermore", "additionally", "meanwhile", "nonetheless", "nevertheless", "overall",
    "generally", "specifically", "particularly", "importantly", "indeed", "likely", "likewise", "uncertainty", "firstly", "lastly", "finally", "also", "then", "next", "again", "still", "subsequently",
    "previously", "earlier", "later", "recently", "currently", "today", "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "last", "initially", "subsequent",
    "comparatively", "conversely", "alternatively", "accordingly", "interestingly", "relatedly", "moreso", "state", "for instance", "instance", "for example", "example", "more so",
)
#: Further words that lead into one, in running texts.
MORE_LEADS = ("according to", "as in", "and", "but", "cf", "compare", "e.g.", "following", "i.e.", "or", "see also", "since", "when", "while")
#: Words of data, methods and documents that are never the key of an author.
DOCUMENT_WORDS = (
    "survey", "field", "work", "fieldwork", "data", "dataset", "sample", "sampling", "questionnaire", "respondent", "respondents", "interview", "interviews", "observation", "observations", "experiment", "experiments", "variable", "variables",
    "table", "tables", "figure", "fig", "figures", "chapter", "section", "appendix", "appendices", "annex", "equation", "eq", "model", "models", "analysis", "analyses", "results", "result", "finding", "findings",
    "method", "methods", "methodology", "discussion", "introduction", "conclusion", "study", "studies", "paper", "thesis", "dissertation", "report", "policy", "policies", "source", "sources", "author", "authors",
    "construct", "constructs", "estimation", "estimated", "estimate", "estimates", "trend", "trends", "state", "states", "census", "surveys",
)
BLOCKED = frozenset(DOCUMENT_WORDS) | {x for x in LEADS if " " not in x}
#: These and a few more are no author by themselves.
NOT_AUTHORS = BLOCKED | {x for x in MORE_LEADS if " " not in x} | {"available", "journal", "press", "ssrn", "the", "this", "university"}
#: Words that make a phrase no author where it begins or ends with one of them.
EDGE_WORDS = ("field", "survey", "data", "sample", "questionnaire")
#: Small words that an organisation's acronym leaves out.
SMALL = frozenset("a an and at by department for from in limited ministry of on press the to with".split())
_LEADING = re.compile(r"^\s*(?:" + "|".join(re.escape(x) for x in sorted((*LEADS, *MORE_LEADS), key=len, reverse=True)) + r")(?:\s*,\s*|\s+|[,:;.\-]+\s*|$)", re.I)


# --- strings
def key_form(s: str) -> str:
    """Lower case without accents and quotes; only letters, digits, blanks, ``-``, ``&`` and ``/`` left."""
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s\-&/]", " ", re.sub(r"[“”\"'’`]", "", s))).strip()


def base_year(year: str) -> str:
    return year[:4]


def without_leads(s: str) -> str:
    for _ in range(5):
        m = _LEADING.match(s)  # a search would try the pattern at every place
        cut = (s[m.end() :] if m else s).strip(" ,;:()[]{}")
        if cut == s:
            break
        s = cut
    return s


def no_author(s: str) -> bool:
    """Whether words name no author: none, only blocked ones, three at most of which the last is one, or a phrase of a survey, data or a sample."""
    words = key_form(s).split()
    return not words or " ".join(words) in LEADS or all(w in NOT_AUTHORS for w in words) or (len(words) <= 3 and words[-1] in BLOCKED) or (len(words) > 1 and (words[0] in EDGE_WORDS or words[-1] in EDGE_WORDS))


def surnames(left: str) -> list[str]:
    """Keys of up to six surnames of what stands before a year: ``Surname, I.`` pairs, else the last word of each part."""
    s = without_leads(re.sub(r"\s+", " ", left).strip())
    s = re.sub(r"(’s|'s)\b", "", re.sub(r"\bet\s*\.?\s*al\.?", "", s, flags=re.I))
    found = re.findall(rf"\b({_NAME})\s*,\s*(?:[A-Z]\.[\s-]*){{1,5}}", s)
    if not found:
        for part in re.split(r"\s*(?:,|&|＆|\band\b)\s*", s):
            words = re.findall(r"[A-Za-zÀ-ÖØ-öø-ÿ'’\-]{2,}", re.sub(r"\b[A-Z]\b\.?", " ", part))
            if words:
                found.append(words[-1])
    keys = [k for k in dict.fromkeys(map(key_form, found)) if len(k) >= 2 and k not in NOT_AUTHORS]
    return keys[:6]


def first_key(left: str) -> str:
    """Key of the first author or organisation: a bracketed acronym, a surname before initials, else the last word before ``,``, ``&`` or ``and``."""
    s = without_leads(re.sub(r"\s+", " ", left).strip())
    if no_author(s):
        return ""
    if m := re.search(r"\(([A-Z][A-Z0-9/&\-]{1,15})\)", s):
        return key_form(m[1])
    if m := re.match(r"([A-Z][A-Za-z'\-]+)\s+[A-Z]{1,3}\b", s):
        return key_form(m[1])
    head = re.sub(r"\bet\s+al\.?", "", re.split(r"\s+(?:&|and|＆)\s+|,", s, maxsplit=1)[0]).strip()
    words = [w for w in re.sub(r"(’s|'s)\b", "", head).split() if re.search("[A-Za-z0-9]", w)]
    key = key_form(words[-1]) if words else ""
    return "" if key in NOT_AUTHORS else key


def acronyms(left: str) -> list[str]:
    """Short names of an organisation: in brackets, its tokens in capitals, or the first letters of its larger words."""
    out = []
    if m := re.search(r"\(([A-Z][A-Z0-9/&\-]{1,15})\)", left):
        out.append(m[1])
    capitals = "".join(re.findall(r"\b[A-Z][A-Z0-9/&\-]{1,15}\b", left))
    if 2 <= len(capitals) <= 15:
        out.append(capitals)
    if not re.search(r",\s*[A-Z]\.", left):
        letters = "".join(w[0] for w in re.findall(r"\b[A-Za-z][A-Za-z\-]+\b", left)[:18] if w.lower() not in SMALL)
        if 2 <= len(letters) <= 15:
            out.append(letters)
    return [k for k in dict.fromkeys(map(key_form, out)) if k and k not in NOT_AUTHORS]


def clean_citation(text: str) -> str:
    """A citation in one form: ``et al.`` spelt out, blanks around ``&``, a comma before the year, no leading words."""
    s = re.sub(r"\s+", " ", text).strip()
    s = re.sub(r"\bet\s*\.?\s*(?:al|la)\b\s*\.?", "et al.", s, flags=re.I)
    s = re.sub(r"\s*(?:&|＆)\s*", " & ", re.sub(r"\band\s+and\b", "and", s))
    s = re.sub(rf"\b(et al\.)\s*,?\s*({YEAR})\b", r"\1, \2", s, flags=re.I)
    s = re.sub(rf"({_NAME})'?\s+({YEAR})\b", r"\1, \2", s)
    return without_leads(re.sub(r"\s+,", ",", re.sub(r"\s+", " ", s)).strip(" ,;:()[]{}"))


def split_chunk(chunk: str) -> list[str]:
    """Citations joined in one chunk, cut at their years; a year without an author of its own belongs to the one before."""
    s = re.sub(r"\s*:\s*(?=[A-ZÀ-ÖØ-Þ])", "; ", clean_citation(chunk))
    years = list(_YEAR.finditer(s))
    if len(years) <= 1:
        return [s] if s else []
    out, author, end = [], "", 0
    for y in years:
        own = s[end : y.start()].strip(" ,;:()[]{}")
        author = own if re.search("[A-Za-zÀ-ÖØ-öø-ÿ]", own) else author
        if author:
            out.append(f"{author}, {y[1]}")
        end = y.end()
    return out


def parse_citation(text: str) -> dict | None:
    """key, year, names, candidate keys in their order, and whether it is bare (one author, no initials, no et al.); None without author or year."""
    s = re.sub(r"\b(p|pp)\.?\s*\d+(\s*[-–]\s*\d+)?\b", "", clean_citation(text), flags=re.I).strip()
    y = _YEAR.search(s)
    if not y:
        return None
    left = without_leads(s[: y.start()].strip(" ,;()"))
    if no_author(left):
        return None
    short = acronyms(left) if re.fullmatch(r"[A-Z][A-Z0-9/&\-]{1,15}", left) else []
    key, year, names = (short[0] if short else first_key(left)), y[1].lower(), surnames(left)
    if not key:
        return None
    base, etal = base_year(year), re.search(r"\bet al\.", s)
    keys = []
    if len(names) >= 2:
        keys += [f"{a}+{b}|{t}" for t in (year, base) for a, b in ((names[0], names[1]), (names[1], names[0]))]
    if etal:
        first = key_form(m[1]) if (m := re.search(rf"({_NAME})\s+et al", s)) else key
        keys += [f"{first}+etal|{t}" for t in (year, base)]
    keys += [f"{key}|{t}" for t in (year, base)] + [f"{n}|{t}" for n in names[:1] for t in (year, base)]
    initials = re.search(rf"{_NAME},\s*(?:[A-Z]\.?\s*){{1,5}}", left)
    two = len(names) >= 2 or re.search(r"\s(?:&|and)\s", left)
    return {"key": key, "year": year, "names": names, "keys": list(dict.fromkeys(keys)), "bare": not (initials or two or etal)}


#: Distinct pieces of texts whose parse a worker keeps.
MEMO = 1 << 16


@lru_cache(MEMO)
def _chunk(chunk: str) -> tuple[str, ...]:
    return tuple(split_chunk(chunk))


@lru_cache(MEMO)
def _cleaned(text: str) -> str:
    return clean_citation(text)


@lru_cache(MEMO)
def _is_citation(text: str) -> bool:
    return bool(text) and parse_citation(text) is not None


def citations_of(text: str) -> list[str]:
    """Distinct citations of a text, in brackets and in the sentence, in their order."""
    t = re.sub(r"\s*(?:&|＆)\s*", " & ", text.replace("’", "'"))
    found = []
    for m in re.finditer(rf"\(([^()]{{0,260}}?\b(?:19|20)\d{{2}}[a-z]?\b[^()]{{0,260}}?)\)", t):
        if not re.fullmatch(rf"\s*{YEAR}\s*", m[1]):
            found += [(m.start(), c) for chunk in m[1].split(";") if _YEAR.search(chunk) for c in _chunk(chunk)]
    authors = rf"{_NAME}(?:\s+et\s+al\.?|(?:\s*,\s*{_NAME}){{0,10}}(?:\s*,?\s*(?:&|and)\s+{_NAME})?)"
    for m in re.finditer(rf"\b({authors})(?:'s?)?\s*\(\s*((?:19|20)\d{{2}}[a-z]?(?:\s*[,;]\s*(?:19|20)\d{{2}}[a-z]?)*)\s*\)", t):
        found += [(m.start(), _cleaned(f"{m[1]}, {y.strip()}")) for y in re.split("[,;]", m[2])]
    return [c for c in dict.fromkeys(c for _, c in sorted(found, key=lambda x: x[0])) if _is_citation(c)]


def plausible(text: str) -> bool:
    """Whether a line may be a reference: 18 characters, a year, something like an author before it or like a title beside it."""
    y = _YEAR.search(text)
    if len(text) < 18 or not y:
        return False
    title = lambda s: len(re.findall(r"[A-Za-zÀ-ÖØ-öø-ÿ]{2,}", s)) >= 2
    after, before = text[y.end() :].lstrip(" ).,;:-").split(".", 1)[0], text[: y.start()].strip(" .;:-")
    person = bool(re.match(rf"\s*{_NAME}(?:\s*,\s*(?:[A-Z]\.|{_NAME})|\s+[A-Z]{{1,3}}\b)", text))
    return (title(after) or title(before.split(".")[-1])) and (person or bool(re.match(r"[A-ZÀ-ÖØ-Þ]", text)) or bool(re.search(r"\b(ssrn|arxiv|working paper|retrieved from|doi|report)\b", text, re.I)))


def parse_reference(text: str) -> dict | None:
    """key, year, names, plain aliases (the first wins) and preferred ones (the last wins) of a reference; None when it is not plausible."""
    s = re.sub(r"^\s*[\[(]?\d+[\])]?[.)]?\s+", "", re.sub(r"\s+", " ", text).strip())
    if not plausible(s):
        return None
    y = re.search(rf"\(\s*({YEAR})\s*\)", s) or _YEAR.search(s)
    left = s[: y.start()].strip(" ,;()")
    year, names, key = y[1].lower(), surnames(left), (m := re.match(rf"({_NAME})\s*,\s*[A-Z]\.", left)) and key_form(m[1]) or first_key(left)
    if not key:
        return None
    times = list(dict.fromkeys([year, base_year(year)]))
    plain = [f"{k}|{t}" for k in dict.fromkeys([key, *acronyms(left), *names[:2]]) for t in times]
    pair = [f"{x}|{t}" for x in (f"{names[0]}+{names[1]}", f"{names[1]}+{names[0]}", f"{names[0]}+etal") for t in times] if len(names) >= 2 else []
    return {"key": key, "year": year, "names": names, "left": left, "plain": plain, "preferred": pair}


# --- reference lists
_START = rf"{_NAME}(?:\s+{_NAME})?,\s+(?:[A-Z]\.[\s-]*)+"


def entries(text: str) -> list[str]:
    """Entries of an author-year reference list, however it was laid out: one a line, wrapped, or all in one paragraph.

    An entry begins with a surname and initials, at the start of a line or after the end of another entry, and has a
    year before the next one begins; anything else continues the entry before it.
    """
    joined = re.sub(r"(?<=[a-z])-\n(?=[a-z])", "", text.strip())
    marked = re.sub(rf"(?:^|\n|(?<=[.!?])\s)\s*(?={_START})", "\x1e", joined)
    out: list[str] = []
    for part in (re.sub(r"\s+", " ", p).strip() for p in marked.split("\x1e")):
        if not part:
            continue
        if out and not (_YEAR.search(out[-1]) and re.match(_START, part)):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


# --- on Spark
def _parsed(function, fields: str, column: Column) -> Column:
    """A parser of this module over a column of distinct texts, as a struct (null where it finds nothing)."""
    types = {"array<string>": pa.list_(pa.string()), "string": pa.string(), "boolean": pa.bool_()}
    kind = pa.struct([(name, types[t]) for name, t in (f.split(" ") for f in fields.split(", "))])

    @F.arrow_udf(f"struct<{', '.join(f.replace(' ', ':') for f in fields.split(', '))}>")
    def run(texts: pa.Array) -> pa.Array:
        found = [function(t) for t in texts.cast(pa.string()).to_pylist()]
        return pa.array([None if x is None else {f.name: x[f.name] for f in kind} for x in found], kind)

    return run(column)


def extract(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, cite_idx, citation of every text."""

    @F.arrow_udf("array<string>")
    def found(column: pa.Array) -> pa.Array:
        return pa.array([citations_of(t or "") for t in column.to_pylist()], pa.list_(pa.string()))

    return texts.select(F.col(id_col).alias("doc_id"), F.posexplode(found(F.col(text_col).cast("string"))).alias("cite_idx", "citation"))


def reference_entries(blocks: DataFrame) -> DataFrame:
    """doc_id, ref_idx, reference of reference blocks(doc_id, text): each block is the text of one list."""

    @F.arrow_udf("array<string>")
    def found(column: pa.Array) -> pa.Array:
        return pa.array([[e for e in entries(t or "") if plausible(e)] for t in column.to_pylist()], pa.list_(pa.string()))

    return blocks.select("doc_id", F.posexplode(found(F.col("text"))).alias("ref_idx", "reference"))


#: Distinct texts, and pairs of distinct names, that are sent to every task.
BROADCAST, PRODUCT = 1 << 17, 1 << 20


def _with_parts(rows: DataFrame, column: str, function, fields: str) -> DataFrame:
    """rows with p, what a parser makes of a text; each distinct text of the table is parsed once, and rows without a result go."""
    made = kept(rows.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("p", _parsed(function, fields, F.col(column))))
    made = F.broadcast(made) if made.count() <= BROADCAST else made
    return rows.join(made.filter("p is not null"), column)  # not before made is kept: the parser would be pushed below the distinct


def parsed_citations(cites: DataFrame) -> DataFrame:
    """cites(doc_id, cite_idx, citation) with key, year, names, keys and bare; strings that are no citations go."""
    fields = "key string, year string, names array<string>, keys array<string>, bare boolean"
    return _with_parts(cites, "citation", parse_citation, fields).select("doc_id", "cite_idx", "citation", "p.*")


def parsed_references(refs: DataFrame) -> DataFrame:
    """refs(doc_id, ref_idx, reference) with key, year, names, left and both kinds of aliases; implausible lines go."""
    fields = "key string, year string, names array<string>, left string, plain array<string>, preferred array<string>"
    return _with_parts(refs, "reference", parse_reference, fields).select("doc_id", "ref_idx", "reference", "p.*")


def _alike(a: DataFrame, b: DataFrame, score: Column) -> DataFrame | None:
    """All pairs of the values of two columns with their score, above 0, where few enough values are in use to try them all; else None.

    So names that recur in many documents are compared once, and documents meet by names that are known to be alike.
    """
    a, b = kept(a.distinct()), kept(b.distinct())
    return F.broadcast(kept(a.crossJoin(b).withColumn("score", score)).filter("score > 0")) if a.count() * b.count() <= PRODUCT else None


def aliases(refs: DataFrame) -> DataFrame:
    """doc_id, alias, ref_idx: of the references with an alias the last one that prefers it, else the first one that has it."""
    own = refs.select("doc_id", "ref_idx", F.explode("plain").alias("alias"), F.lit(False).alias("prefer"))
    pairs = refs.select("doc_id", "ref_idx", F.explode("preferred").alias("alias"), F.lit(True).alias("prefer"))
    return own.unionByName(pairs).groupBy("doc_id", "alias").agg(F.coalesce(F.max(F.when(F.col("prefer"), F.col("ref_idx"))), F.min("ref_idx")).alias("ref_idx"))


def reconcile(cites: DataFrame, refs: DataFrame, least: int = 74) -> DataFrame:
    """doc_id, cite_idx, citation, ref_idx, flag of parsed citations and references.

    A bare citation whose author and year several references share is ambiguous and goes to the first of them; else the first
    of its keys that is an alias decides; else the likeliest reference of the year, if its names are like enough.
    """
    years = lambda c: F.array_distinct(F.array(c, F.substring(c, 1, 4)))
    shared = refs.select("doc_id", "ref_idx", F.explode(F.transform(years(F.col("year")), lambda y: F.concat("key", F.lit("|"), y))).alias("alias")).groupBy("doc_id", "alias").agg(F.min("ref_idx").alias("ref_idx"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    offered = aliases(refs).withColumn("k", F.lit(0).cast("bigint")).unionByName(shared).withColumn("shared", F.col("k") > 0)
    ask = lambda k, is_shared: F.struct(F.lit(is_shared).alias("shared"), k.alias("alias"))
    first = F.when(F.col("bare"), F.array(ask(F.concat("key", F.lit("|"), F.substring("year", 1, 4)), True))).otherwise(F.slice(F.array(ask(F.lit(""), True)), 1, 0))
    asked = cites.select("doc_id", "cite_idx", F.posexplode(F.concat(first, F.transform("keys", lambda k: ask(k, False)))).alias("place", "a")).select("doc_id", "cite_idx", "place", "a.*")
    best = asked.join(offered, ["doc_id", "shared", "alias"]).groupBy("doc_id", "cite_idx").agg(F.min(F.struct("place", "alias", "ref_idx", "k")).alias("b"))
    found = cites.select("doc_id", "cite_idx", "citation", "names", F.substring("year", 1, 4).alias("y")).join(best, ["doc_id", "cite_idx"], "left")
    joined = lambda c: F.array_join(c, " ")
    overlap = F.bround(F.size(F.array_intersect("names", "other")) * 100.0 / F.greatest(F.size("names"), F.lit(1)), 0)
    fuzzy = F.when((F.size("names") > 0) & (F.size("other") > 0), F.bround(similarity("token_set", joined("names"), joined("other")) * 0.6 + similarity("partial", joined("names"), joined("other")) * 0.4, 0)).otherwise(0.0)
    score = F.greatest(overlap, fuzzy).cast("int")
    score = F.when(score >= least, score)
    others = refs.filter(F.size("names") > 0).groupBy("doc_id", F.substring("year", 1, 4).alias("y"), F.col("names").alias("other")).agg(F.min("ref_idx").alias("ref_idx"))
    rest = found.filter("b is null").filter(F.size("names") > 0).select("doc_id", "cite_idx", "names", "y")
    alike = _alike(cites.filter(F.size("names") > 0).select("names"), others.select("other"), score)
    scored = rest.join(others, ["doc_id", "y"]).withColumn("score", score).filter("score > 0") if alike is None else rest.join(others, ["doc_id", "y"]).join(alike, ["names", "other"])
    near = scored.groupBy("doc_id", "cite_idx").agg(F.max(F.struct("score", (-F.col("ref_idx")).alias("r"))).alias("n"))
    several = F.concat(F.lit("ambiguous_same_author_year:"), "b.alias", F.lit(";candidates="), F.col("b.k").cast("string"))
    flag = F.when(F.col("b.k") > 0, several).when(F.col("b").isNotNull(), F.concat(F.lit("alias:"), "b.alias")).when(F.col("n").isNotNull(), F.concat(F.lit("fuzzy:"), F.col("n.score").cast("string"))).otherwise("missing")
    return found.join(near, ["doc_id", "cite_idx"], "left").select("doc_id", "cite_idx", "citation", F.coalesce("b.ref_idx", -F.col("n.r")).alias("ref_idx"), flag.alias("flag"))


def reference_counts(edges: DataFrame, cites: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id, ref_idx, times_cited, uncited: an ambiguous citation counts for every reference that it may mean."""
    plain = edges.filter("ref_idx is not null and flag not like 'ambiguous%'").select("doc_id", "ref_idx", "cite_idx")
    may = edges.filter("flag like 'ambiguous%'").select("doc_id", "cite_idx").join(cites.select("doc_id", "cite_idx", "key", F.substring("year", 1, 4).alias("y")), ["doc_id", "cite_idx"])
    several = may.join(refs.select("doc_id", "ref_idx", "key", F.substring("year", 1, 4).alias("y")), ["doc_id", "key", "y"]).select("doc_id", "ref_idx", "cite_idx")
    n = plain.unionByName(several).groupBy("doc_id", "ref_idx").agg(F.count(F.lit(1)).alias("n"))
    return refs.select("doc_id", "ref_idx").join(n, ["doc_id", "ref_idx"], "left").select("doc_id", "ref_idx", F.coalesce("n", F.lit(0)).alias("times_cited"), F.col("n").isNull().alias("uncited"))


def possible_matches(missing: DataFrame, refs: DataFrame, span: int = 5) -> DataFrame:
    """The likeliest reference of each missing parsed citation: authors of 84 in its year, of 92 within span years; less 4 a year, 24 at most.

    Authors are equal (100), one within the other from five letters on (88), or as like as the greater of ratio and token set.
    A citation by an acronym needs the same one.
    """
    names = F.array_distinct(F.concat(F.array("key"), F.transform("plain", lambda a: F.substring_index(a, "|", 1))))
    other = refs.select("doc_id", "ref_idx", F.substring("year", 1, 4).cast("int").alias("ry"), F.explode(names).alias("alias"))
    acronym = F.col("citation").rlike(r"^[A-Z]{2,8}[^A-Za-z]*$")
    asked = missing.select("doc_id", "cite_idx", "key", F.substring("year", 1, 4).cast("int").alias("cy"), acronym.alias("short"))
    within = (F.length("key") >= 5) & (F.length("alias") >= 5) & (F.col("alias").contains(F.col("key")) | F.col("key").contains(F.col("alias")))
    like = F.greatest(similarity("ratio", F.col("key"), F.col("alias")), similarity("token_set", F.col("key"), F.col("alias")))
    score = F.when(F.col("key") == F.col("alias"), 100.0).when(within, 88.0).otherwise(like)
    score = F.when(score >= 84, score)
    alike = _alike(missing.select("key"), other.select("alias"), score)
    if alike is None:
        near = F.explode(F.sequence(F.col("cy") - span, F.col("cy") + span)).alias("ry")
        pairs = asked.select("*", near).join(other, ["doc_id", "ry"]).withColumn("author", score).filter("author > 0")
    else:
        pairs = asked.join(alike, "key").join(other, ["doc_id", "alias"]).filter(F.abs(F.col("cy") - F.col("ry")) <= span).withColumnRenamed("score", "author")
    pairs = pairs.filter(~F.col("short") | (F.col("key") == F.col("alias")))
    gap = F.abs(F.col("cy") - F.col("ry"))
    good = pairs.withColumn("gap", gap).filter(F.col("author") >= F.when(F.col("gap") == 0, 84).otherwise(92))
    good = good.withColumn("score", F.col("author") - F.least(F.col("gap") * 4, F.lit(24)))
    best = good.groupBy("doc_id", "cite_idx").agg(F.max(F.struct("score", (-F.col("ref_idx")).alias("r"), "gap", "author")).alias("b"))
    kind = F.when((F.col("b.gap") == 0) & (F.col("b.author") < 100), "name_variation").when((F.col("b.gap") > 0) & (F.col("b.author") >= 90), "year_variation").otherwise("name_year_variation")
    return best.select("doc_id", "cite_idx", (-F.col("b.r")).alias("ref_idx"), F.round("b.score", 4).alias("score"), kind.alias("kind"))


def summary(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """Per document: citations, matched, ambiguous, fuzzy, missing, references, uncited and the match rate in percent."""
    flag = F.col("flag")
    c = edges.groupBy("doc_id").agg(F.count(F.lit(1)).alias("citations"), F.count_if(flag != "missing").alias("matched"), F.count_if(flag.startswith("ambiguous")).alias("ambiguous"), F.count_if(flag.startswith("fuzzy")).alias("fuzzy"), F.count_if(flag == "missing").alias("missing"))
    r = counts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("references"), F.count_if("uncited").alias("uncited"))
    j = c.join(r, "doc_id", "full").na.fill(0)
    return j.withColumn("match_rate", F.round(F.coalesce(F.try_divide(F.col("matched") * F.lit(100.0), F.col("citations")), F.lit(0.0)), 1))
