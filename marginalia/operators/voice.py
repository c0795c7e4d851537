"""Writing review of whole documents: rhythm, stock phrases, long sentences, repeated openings and a readiness score."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stock phrases in their order; the last two count only from four of them in a document on.
PHRASES = (
    "it is important to note", "it is worth noting", "in today's rapidly evolving", "in the contemporary", "plays a crucial role",
    "a multifaceted approach", "underscores the importance", "this highlights the need", "in conclusion", "furthermore", "moreover",
)
#: Words that open a transition, marks of front matter, and marks of a manuscript's own results.
TRANSITIONS = r"(?i)^(however|furthermore|moreover|therefore|consequently|additionally|in addition|on the other hand|in conclusion|overall)\b"
FRONT_MATTER = (
    r"(?i)\b(university of cape coast|dissertation submitted|candidate[’']s declaration|list of tables|list of figures|acronyms?|abbreviation meaning|"
    r"table\s+1\s+distribution|partial fulfilment|award of master|statistical package for the social sciences|participants were required to meet the following criteria)\b"
)
RESULTS = (
    r"\b(table\s*\d+|as shown in table|the results? (?:show|indicate|reveal|demonstrate)|the findings? (?:show|indicate|reveal|suggest)|respondents?|mean score|"
    r"standard deviation|coefficient|correlation|regression|p\s*[<=>]|r\s*=|r[²2]\s*=|beta|β|t-value|f-value)\b"
)
#: Words of a long and of a very long sentence, and how many signals of each kind count.
LONG, VERY_LONG = 55, 80
MOST_LONG, MOST_PHRASES, MOST_OPENINGS = 10, 3, 4


def _clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _n_words(clean: Column) -> Column:
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))


def _sentences(clean: Column) -> Column:
    return F.filter(F.split(clean, r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: _n_words(s) >= 4)


def non_prose(clean: Column) -> Column:
    """Whether a sentence or paragraph is front matter, a heading, a list, a reference, a result or mostly numbers."""
    n = F.greatest(_n_words(clean), F.lit(1))
    length_of = lambda p: F.length(clean) - F.length(F.regexp_replace(clean, p, ""))
    count = lambda c: F.length(clean) - F.length(F.replace(clean, F.lit(c), F.lit("")))
    capitals = (n >= 12) & (length_of(r"\p{Lu}+") / F.greatest(length_of(r"\p{L}+"), F.lit(1)) > 0.72)
    listed = clean.contains(":") & (count(";") >= 2)
    entry = (n < 45) & (count(".") >= 2) & clean.rlike(r"\((?:19|20)\d{2}[a-z]?\)")
    equation = clean.contains("=") & (clean.rlike(r"\d[^\d]*\d") | clean.rlike(r"\b[A-Za-z][A-Za-z0-9_]*\s*=\s*[-+]?\d"))
    numbers = clean.rlike(r"\d") & (F.regexp_count(clean, F.lit(r"\b\d+(?:\.\d+)?\b")) / n >= 0.20)
    return listed | entry | equation | (count("|") >= 3) | numbers | capitals | clean.rlike(FRONT_MATTER) | F.lower(clean).rlike(RESULTS)


def _variation(lengths: Column) -> Column:
    """Coefficient of variation of an array of lengths, 0 below two of them; from whole sums, so that one pass is enough."""
    n, none = F.size(lengths).cast("bigint"), F.lit(0).cast("bigint")
    total = F.aggregate(lengths, none, lambda s, x: s + x)
    squares = F.aggregate(lengths, none, lambda s, x: s + x.cast("bigint") * x)
    return F.when(n < 2, 0.0).otherwise(F.coalesce(F.sqrt(n * squares - total * total) / F.nullif(total, none), F.lit(0.0)))


def review(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: what was read, variations, rate of transitions, signals by kind and priority, readiness score.

    Signals are sentences of more than 55 words (important beyond 80), stock phrases, paragraphs of 12 words or more in which two
    sentences open with the same three words, and a rhythm too even over eight sentences or more; of a kind the first ten,
    three, four and one count. Everything is computed inside the row. Null or empty text has no sentence and scores 100.
    """
    whole = F.coalesce(F.col(text_col), F.lit(""))
    prose = lambda p: F.filter(_sentences(p), lambda s: ~non_prose(s))
    holds = lambda s, phrase: F.lower(s).contains(phrase)
    d = texts.select(F.col(id_col), _sentences(_clean(whole)).alias("s"), F.filter(F.transform(F.split(whole, r"\n\s*\n+"), _clean), lambda p: _n_words(p) >= 12).alias("p"))
    d = d.withColumns({"prose": F.transform("p", prose), "late": F.filter("s", lambda s: (holds(s, PHRASES[-2]) | holds(s, PHRASES[-1])) & ~non_prose(s))})
    d = d.withColumns({"q": F.flatten("prose"), "n_f": F.size(F.filter("late", lambda s: holds(s, PHRASES[-2]))), "n_m": F.size(F.filter("late", lambda s: holds(s, PHRASES[-1])))})

    def stock(s: Column) -> Column:
        early = functools.reduce(operator.or_, [holds(s, x) for x in PHRASES[:-2]])
        return early | (holds(s, PHRASES[-2]) & (F.col("n_f") >= 4)) | (~holds(s, PHRASES[-2]) & holds(s, PHRASES[-1]) & (F.col("n_m") >= 4))

    def repeats(p: Column, sentences: Column) -> Column:
        opening = lambda s: F.array_join(F.slice(F.regexp_extract_all(F.lower(s), F.lit("([a-z']+)"), F.lit(1)), 1, 3), " ")
        starts = F.filter(F.transform(sentences, opening), lambda o: o != "")
        return (F.size(starts) > F.size(F.array_distinct(starts))) & ~non_prose(p)

    d = d.withColumns({
        "sentences": F.size("s"), "paragraphs": F.size("p"), "long": F.slice(F.filter(F.transform("q", _n_words), lambda w: w > LONG), 1, MOST_LONG), "phrases": F.least(F.lit(MOST_PHRASES), F.size(F.filter("q", stock))),
        "openings": F.least(F.lit(MOST_OPENINGS), F.size(F.filter(F.zip_with("p", "prose", repeats), lambda x: x))), "cv": _variation(F.transform("s", _n_words)), "paragraph_cv": _variation(F.transform("p", _n_words)),
        "rate": F.size(F.filter("s", lambda s: s.rlike(TRANSITIONS))) / F.greatest(F.size("s"), F.lit(1)),
    })
    d = d.withColumns({"even": F.when((F.col("sentences") >= 8) & (F.col("cv") < 0.23), 1).otherwise(0), "very": F.size(F.filter("long", lambda w: w > VERY_LONG))})
    signals = F.size("long") + F.col("phrases") + F.col("openings") + F.col("even")
    score = F.bround(100 - F.least(F.lit(35.0), signals / F.greatest(F.col("sentences"), F.lit(1)) * 220), 0)
    whole_number = lambda c, name: c.cast("bigint").alias(name)
    return d.select(
        id_col, *[whole_number(F.col(c), c) for c in ("sentences", "paragraphs", "phrases", "openings")], whole_number(F.size("long"), "long_sentences"), whole_number(F.col("very") + F.col("even"), "important"),
        whole_number(signals - F.col("very") - F.col("even"), "optional"), whole_number(score, "score"), F.round("cv", 3).alias("sentence_variation"), F.round("paragraph_cv", 3).alias("paragraph_variation"), F.round("rate", 3).alias("transition_rate"),
    )
