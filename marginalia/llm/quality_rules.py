"""Quality rules: a threshold table compiled into projections of counts and ratios of each text, without user functions.

Rules(measure, least, most) name measures of MEASURES; a text passes when every measure lies within its bounds (null:
none). The base counts come first, since repeated windows and dropped texts follow from them. Nothing is shuffled: every
text is judged where it is read, so a hot source, copies or very long texts only cost their own length.

Defined results: a null or empty text has all counts 0 and fails the base rule; repeated rows and ids are judged apart,
a null id stays null; an empty table gives an empty one; columns of the input other than the id are not returned, so
names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Words of a window, and the base rule: least words, most percent of words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Frequent function words of English, French, German and Spanish: running text has some of them.
STOP_WORDS = (
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "have", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with",
    "au", "ce", "dans", "des", "du", "en", "est", "et", "il", "la", "le", "les", "pas", "par", "pour", "que", "qui", "se", "sur", "un", "une",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "como", "con", "de", "del", "el", "es", "las", "los", "no", "para", "por", "su", "una", "y",
)

#: Measures by name, over the counted columns of a text.
MEASURES = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "stop_word_share": "n_stop_words / n_words",
    "duplicate_line_share": "n_dup_lines / n_lines",
    "letter_word_share": "n_letter_words / n_words",
    "ellipsis_line_share": "n_ellipsis_lines / n_lines",
    "bullet_line_share": "n_bullet_lines / n_lines",
}
#: The production table: measure, least, most.
RULES = (
    ("mean_word_chars", 2.0, 15.0),
    ("symbols_per_word", None, 0.2),
    ("stop_word_share", 0.02, None),
    ("duplicate_line_share", None, 0.5),
    ("letter_word_share", 0.6, None),
    ("ellipsis_line_share", None, 0.5),
    ("bullet_line_share", None, 0.9),
)


def _repeated(words: str, order: str) -> Column:
    """Words covered by windows that occur twice or more; order: (hash, place) of all windows, sorted.

    Windows of equal hash stand side by side there; what the hash brings together is compared word by word.
    """
    at = lambda j: F.get(F.col(order), j)
    text = lambda x: F.slice(F.col(words), x["i"] + 1, F.lit(WINDOW))
    same = lambda a, b: F.coalesce((a["h"] == b["h"]) & (text(a) == text(b)), F.lit(False))
    places = F.transform(F.col(order), lambda x, j: F.when(same(x, at(j + 1)) | F.when(j > 0, same(x, at(j - 1))).otherwise(False), x["i"]))
    return F.aggregate(
        F.array_sort(F.array_compact(places)),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
        lambda acc: acc["n"].cast("bigint"),
    )


def _capitalised(words: tuple[str, ...]) -> list[str]:
    return [*words, *(w[0].upper() + w[1:] for w in words)]


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the counts of every whole text that measures are made of."""
    pairs = lambda c, k: F.transform(c, lambda x, i: F.xxhash64(x, F.get(F.col(c), i + k)))
    number = lambda c: c.cast("bigint")
    how_many = lambda items, test: number(F.size(F.filter(items, test)))
    d = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    d = d.select("__id", "__text", F.regexp_extract_all("__text", F.lit(f"({WORD})"), F.lit(1)).alias("__words"), F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(WORD)).alias("__lines"))
    d = d.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    for k in (1, 2, 4):  # hashes of 2, 4 and 8 words that begin at each word
        d = d.withColumn("__h", pairs("__h", k))
    d = d.withColumn("__h", F.slice("__h", 1, F.greatest(F.size("__words") - WINDOW + 1, F.lit(0))))
    counts = [
        number(F.size("__words")).alias("n_words"), number(F.aggregate("__words", F.lit(0), lambda n, w: n + F.length(w))).alias("word_chars"), number(F.regexp_count("__text", F.lit(SYMBOLS))).alias("n_symbols"),
        number(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"), number(F.size("__lines")).alias("n_lines"), how_many("__words", lambda w: w.isin(*_capitalised(STOP_WORDS))).alias("n_stop_words"),
        number(F.regexp_count("__text", F.lit(r"\p{L}[^\x20\x09-\x0D]*"))).alias("n_letter_words"),
        how_many("__lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*\z")).alias("n_ellipsis_lines"), how_many("__lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]")).alias("n_bullet_lines"),
    ]
    d = d.select("__id", "__words", "__h", (F.size("__h") - F.size(F.array_distinct("__h"))).alias("__again"), *counts)
    # only texts in which a window repeats are sorted
    order = F.when(F.col("__again") > 0, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("__order", F.coalesce(order, F.array().cast("array<struct<h:bigint,i:int>>")))
    return d.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", _repeated("__words", "__order").alias("n_repeat_words"), "n_lines", "n_stop_words", "n_letter_words", "n_ellipsis_lines", "n_bullet_lines")


def compiled(rules) -> Column:
    """The array of names of the rules that a text breaks."""
    broken = []
    for measure, least, most in rules:
        value = F.expr(f"try_divide({', '.join(MEASURES[measure].split(' / '))})" if " / " in MEASURES[measure] else MEASURES[measure])
        out = F.lit(False)
        out = out | (value < least) if least is not None else out
        out = out | (value > most) if most is not None else out
        broken.append(F.when(out, F.lit(measure)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts, base_failed, kept, and broken: the names of the rules that a text breaks."""
    c = counted(docs, id_col, text_col)
    c = c.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).withColumn("broken", compiled(rules))
    return c.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
