"""Claims: concepts, relations, direction, support score and gate, citation-needed sentences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.tables import made_once
from marginalia.functions.text import STOPWORDS, sentences, word_count

#: Concept of each word.
CONCEPTS = {
    "improve": ("improves", "improve", "improved", "enhances", "enhance", "enhanced", "boosts", "boost", "strengthens", "strengthen", "optimises", "optimizes", "optimise", "optimize"),
    "reduce": ("reduces", "reduce", "reduced", "mitigates", "mitigate", "lowers", "lower", "decreases", "decrease", "minimizes", "minimize"),
    "increase": ("increases", "increase", "increased", "raises", "raise", "elevates", "elevate"),
    "adopt": ("adoption", "adopted", "adopt", "implementation", "implement", "use", "usage", "uptake", "acceptance"),
    "performance": ("performance", "productivity", "efficiency", "effectiveness", "outcome", "outcomes"),
    "transparency": ("transparency", "accountability", "openness"),
    "trust": ("trust", "credibility", "confidence"),
    "risk": ("risk", "uncertainty", "exposure"),
    "error": ("error", "errors", "mistake", "mistakes"),
    "corruption": ("corruption", "fraud", "misconduct", "unethical"),
    "reliability": ("reliability", "robustness", "stability", "consistency"),
    "positive": ("positive", "beneficial", "advantageous", "favorable"),
    "negative": ("negative", "harmful", "detrimental", "adverse"),
}
#: Patterns of each relation.
RELATIONS = {
    "improve": (r"\bimprov\w*\b", r"\benhanc\w*\b", r"\bboost\w*\b", r"\bstrength\w*\b"),
    "reduce": (r"\breduc\w*\b", r"\bmitigat\w*\b", r"\blower\w*\b", r"\bdecreas\w*\b"),
    "increase": (r"\bincreas\w*\b", r"\brais\w*\b", r"\belevat\w*\b"),
    "influence": (r"\binfluenc\w*\b", r"\baffect\w*\b", r"\bimpact\w*\b"),
    "predict": (r"\bpredict\w*\b", r"\bdetermin\w*\b", r"\bexplain\w*\b"),
    "associate": (r"\bassociat\w*\b", r"\brelat\w*\b", r"\blink\w*\b"),
    "cause": (r"\bcaus\w*\b", r"\blead\w*\b", r"\bresult\w*\b", r"\bproduc\w*\b"),
}
#: Words of direction, tested as parts of words.
POSITIVE = ("improve", "enhance", "increase", "boost", "strengthen", "beneficial", "positive", "advantage")
NEGATIVE = ("reduce", "decrease", "mitigate", "lower", "minimize", "negative", "harmful", "detrimental")
#: Framing and hedges that a claim is read without.
FRAMING = "this study|this paper|the study|the findings show that|results show that|it was found that|we find that|we show that"
HEDGES = "significantly|generally|often|may|might|can|could|appears to|tends to|seems to|potentially|possibly|approximately|roughly|about"


def simplify(claim: Column) -> Column:
    c = F.regexp_replace(claim, rf"(?i)\b({FRAMING})\b", "")
    c = F.regexp_replace(c, rf"(?i)\b({HEDGES})\b", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", " "), r"\[[^\]]*\]", " ")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"^[ ,;:-]+|[ ,;:-]+$", ""))


def concepts(text: Column) -> Column:
    """Distinct concepts of a text's words of three letters or more."""

    def concept(w: Column) -> Column:
        found = F
        for name, forms in CONCEPTS.items():
            found = found.when(w.isin(*forms), name)
        return found.otherwise(w)

    tokens = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z]+", " "), " "), lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS))
    return F.array_distinct(F.transform(tokens, concept))


def relations(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike("|".join(patterns)), F.lit(name)) for name, patterns in RELATIONS.items()]))


def direction(claim: Column, source: Column) -> Column:
    any_of = lambda c, ws: F.lower(c).rlike("|".join(ws))
    cp, cn, sp, sn = any_of(claim, POSITIVE), any_of(claim, NEGATIVE), any_of(source, POSITIVE), any_of(source, NEGATIVE)
    return F.when((cp & sp) | (cn & sn), 1.0).when((cp | cn) & ~(sp | sn), 0.4).when((cp & sn) | (cn & sp), 0.0).otherwise(0.6)


#: Least score of each level of support.
LEVELS = ((50, "strong_support"), (35, "moderate_support"), (20, "related_evidence"), (10, "weak_or_unclear"))
#: Parts of a text that only stands for a claim that was not extracted.
NO_CLAIM = (
    "claim could not be extracted", "claim not extracted", "review the cited sentence manually",
    "no manuscript claim was extracted", "citation searched:", "mapping was incomplete",
)
#: Levels that an untrusted source must not have, whatever the score, and the states of such a source.
GATED = ("strong_support", "moderate_support", "related_evidence", "weak_or_unclear", "title_overlap_review_required")
UNTRUSTED = ("likely", "needs_review", "not_found", "offline", "error", "failed", "unverified", "unknown", "", "none")


def scored_claims(claims: DataFrame) -> DataFrame:
    """claims(claim, source_title and, where there are any, source_abstract, source_concepts) with raw_score and raw_status.

    The simplified claim is scored (the claim itself where nothing is left of it) against title, abstract and concepts: 40 for
    concepts shared (of four at most), 25 for relations, 15 for direction, and credits for parts. Without a claim or title: 0.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    there = (text("claim") != "") & (text("source_title") != "")
    simple = simplify(text("claim"))
    parts = [F.nullif(text(c), F.lit("")) if c != "source_concepts" else F.nullif(F.array_join(c, " "), F.lit("")) for c in ("source_title", "source_abstract", "source_concepts") if c in claims.columns]
    c = claims.withColumn("__claim", F.when(simple == "", text("claim")).otherwise(simple)).withColumn("__source", F.lower(F.concat_ws(" ", *parts)))
    c = c.withColumns({"__c": concepts(F.col("__claim")), "__s": concepts(F.col("__source")), "__r": relations(F.col("__claim")), "__rs": relations(F.col("__source")), "__d": direction(F.col("__claim"), F.col("__source"))})
    c = c.withColumns({"__o": F.size(F.array_intersect("__c", "__s")), "__ro": F.size(F.array_intersect("__r", "__rs"))})
    ratio = F.least(F.col("__o") / F.greatest(F.least(F.size("__c"), F.lit(4)), F.lit(1)), F.lit(1.0))
    related = F.coalesce(F.try_divide(F.col("__ro").cast("double"), F.size("__r").cast("double")), F.lit(0.0))
    credit = lambda cond, points: F.when(cond, points).otherwise(0)
    one = F.col("__o") >= 1
    score = ratio * 40 + related * 25 + F.col("__d") * 15 + credit(one, 15) + credit(one & (F.col("__ro") >= 1), 10) + credit(F.col("__d") >= 0.8, 10) + credit(F.col("__o") >= 2, 10)
    c = c.withColumn("raw_score", F.when(there, F.round(F.least(score, F.lit(100.0)), 1)).otherwise(0.0))
    level = F
    for least, name in LEVELS:
        level = level.when(F.col("raw_score") >= least, name)
    return c.withColumn("raw_status", level.otherwise("insufficient_evidence")).drop("__claim", "__source", "__c", "__s", "__r", "__rs", "__d", "__o", "__ro")


def support(claims: DataFrame) -> DataFrame:
    """claims(claim, source_title, status, ...) with raw_score, raw_status, support_score and support_status.

    A claim that was not extracted has no score. A source that is not verified takes positive levels and scores of 50 down to
    source_needs_review (source_verification_unknown where no state is known), 49 at most and whole; other rows stay as they are.
    """
    c = scored_claims(claims)
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    claim = F.lower(F.trim(F.coalesce("claim", F.lit(""))))
    missing = claim == ""
    for phrase in NO_CLAIM:
        missing = missing | claim.contains(phrase)
    whole = F.floor("raw_score")
    gated = status.isin(*UNTRUSTED) & (F.col("raw_status").isin(*GATED) | (whole >= 50))
    unknown = status.isin("", "unknown", "none")
    return c.withColumns({
        "support_score": F.when(missing, 0.0).when(gated, F.least(whole, F.lit(49)).cast("double")).otherwise(F.col("raw_score")),
        "support_status": F.when(missing, "claim_not_extracted").when(gated & unknown, "source_verification_unknown").when(gated, "source_needs_review").otherwise(F.col("raw_status")),
    })


#: Words of a claim or title that the fallback score leaves out.
FALLBACK_STOP = (
    "this", "that", "with", "from", "using", "used", "study", "analysis",
    "method", "approach", "results", "paper", "research", "journal", "review",
    "effect", "effects", "relationship", "role", "model", "models", "findings",
)


def keyword_overlap(claim: Column, title: Column) -> Column:
    """Fallback score 10 + 10 for each shared word of four letters or more, 40 at most, 0 without any."""
    own = lambda c: F.array_except(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{4,})"), F.lit(1)), F.array(*[F.lit(w) for w in FALLBACK_STOP]))
    k = F.size(F.array_intersect(own(claim), own(title)))
    return F.when(k > 0, F.least(F.lit(40), k * 10 + 10)).otherwise(0).cast("bigint")


#: Families of patterns for a sentence that needs a citation, each with its weight; one hit of a family counts.
NEEDED = (
    (0.35, (
        r"\b(previous studies|prior studies|earlier studies|studies show|studies have shown|research shows|research suggests|empirical evidence|the literature|scholars argue|authors argue)\b",
        r"\b(it is widely|it is generally|it is commonly|it is well established|it is known)\b",
    )),
    (0.25, (
        r"\b(affects|influences|impacts|determines|predicts|drives|leads to|results in|contributes to|is associated with|is linked to|has a significant|significantly)\b",
        r"\b(effect of|impact of|relationship between|association between|determinants of|influence of|role of)\b",
    )),
    (0.22, (
        r"\b(is defined as|are defined as|refers to|can be defined as|is conceptualised as|is conceptualized as|theory posits|theory suggests|framework assumes)\b",
    )),
    (0.18, (
        r"\b\d+(?:\.\d+)?\s*(?:%|percent|per cent)\b",
        r"\b(p\s*[<=>]\s*0\.\d+|coefficient|regression|correlation|sample size|respondents|odds ratio|confidence interval)\b",
    )),
    (0.14, (
        r"\b(most|many|several|major|critical|central|important|increasingly|widely|commonly|generally|often|frequently)\b",
        r"\b(challenge|problem|barrier|driver|indicator|predictor|determinant|factor)\b",
    )),
    (0.08, (
        r"\b(ghana|africa|sub-saharan|government|public sector|university|students|households|firms|banks|economy|inflation|procurement)\b",
    )),
)
#: Forms of a citation that a sentence already has.
CITES = (
    r"\([^()]{0,220}\b(?:19|20)\d{2}[a-z]?\b[^()]{0,220}\)",
    r"\b[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'\-]+(?:\s+et\s+al\.?)?(?:\s+(?:and|&)\s+[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'\-]+)?\s*\(\s*(?:19|20)\d{2}[a-z]?\s*\)",
    r"\b[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'\-]+(?:\s+et\s+al\.?)?(?:\s+(?:and|&)\s+[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'\-]+)?\s*,\s*(?:19|20)\d{2}[a-z]?\b",
    r"\[(?:\s*\d{1,3}\s*(?:[-,;–—]\s*\d{1,3}\s*)*)\]",
    r"\(\s*\d{1,3}\s*(?:[-,;–—]\s*\d{1,3}\s*)*\)",
    r"(?<=[A-Za-z\)\]])\s*[⁰¹²³⁴⁵⁶⁷⁸⁹]+(?:\s*[,;\-–—]\s*[⁰¹²³⁴⁵⁶⁷⁸⁹]+)*",
)
#: Beginnings of sentences that need no source, rests of reference lists, and words of a manuscript's own results.
SKIP_STARTS = (
    "table ", "figure ", "appendix ", "chapter ", "section ",
    "source:", "note:", "notes:", "author's computation", "authors' computation",
    "this chapter", "this study", "the study", "the researcher", "the objective",
    "the purpose of this study", "the research question", "the hypothesis",
    "in this study", "in this chapter", "the next section",
)
#: Characters of a sentence that is looked at.
SHORTEST, LONGEST = 55, 520
LIST_RESIDUE = r"\bdoi\b|https?://|retrieved from|journal of|vol\.|pp\."
OWN_RESULTS = (
    r"\b(table\s*\d+|as shown in table|the results? (?:show|indicate|reveal|demonstrate)|"
    r"the findings? (?:show|indicate|reveal|suggest)|respondents?|mean score|standard deviation|"
    r"coefficient|correlation|regression|p\s*[<=>]|r\s*=|r[²2]\s*=|beta|β|t-value|f-value)\b"
)


def pieces(pattern: str) -> list[str]:
    """A text for each alternative of the last group of a pattern of NEEDED, or for the rest of its only one: what matches holds one of them."""
    inside = re.fullmatch(r".*?\(((?:\?:)?[^()]*)\)(?:\\b)?", pattern)[1].removeprefix("?:")
    found = [max(re.findall(r"(?:[a-z%0 -]|\\\.)+", re.sub(r"\\[sdw]|\[[^]]*\]|[*+?]", "\n", a)), key=len).replace("\\", "") for a in inside.split("|")]
    return [f for f in found if not any(o != f and o in f for o in found)]


def found_in(low: Column, pattern: str) -> Column:
    """Whether a pattern of NEEDED matches; the engine is asked only where one of its texts stands in the sentence."""
    there = F.lit(False)
    for p in pieces(pattern):
        there = there | low.contains(p)
    return there & low.rlike(pattern)


def cites(sentence: Column) -> Column:
    """Whether a sentence has a citation in some form."""
    found = F.lit(False)
    for p in CITES:
        found = found | sentence.rlike(p)
    return found


def low_value(sentence: Column) -> Column:
    """Whether a sentence is no claim that wants a source: too short or long, a question, a heading, a list's rest, an own result, numbers."""
    low = F.lower(sentence)
    n_words = F.regexp_count(sentence, F.lit(r"[A-Za-zÀ-ÖØ-öø-ÿ']+"))
    start = F.lit(False)
    for s in SKIP_STARTS:
        start = start | F.startswith(low, F.lit(s))
    equation = sentence.rlike(r"\b[A-Za-z][A-Za-z0-9_]*\s*=\s*[-+]?\d") | sentence.rlike(r"[=+*/^]\s*[-+]?\d+(?:\.\d+)?") | (sentence.contains("=") & (F.regexp_count(sentence, F.lit(r"\d")) >= 2))
    density = F.regexp_count(sentence, F.lit(r"\b\d+(?:\.\d+)?\b")) / F.greatest(word_count(sentence), F.lit(1))
    return (
        (F.length(sentence) < SHORTEST) | (F.length(sentence) > LONGEST) | (n_words < 9) | F.endswith(sentence, F.lit("?")) | start
        | low.rlike(r"^(hypothesis|objective|research question)\s*\d*[:.]") | low.rlike(LIST_RESIDUE) | low.rlike(OWN_RESULTS) | equation | (density >= 0.22)
    )


def needed_points(low: Column) -> Column:
    """0.15 and the weights of the families found in a sentence in lower case, 0.95 at most."""
    score = F.lit(0.15)
    for weight, patterns in NEEDED:
        hit = found_in(low, patterns[0])
        for p in patterns[1:]:
            hit = hit | found_in(low, p)
        score = score + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
    return F.round(F.least(score, F.lit(0.95)), 2)


def needed_score(sentence: Column) -> Column:
    """needed_points of a sentence; 0 for one that cites or makes no claim."""
    text = F.trim(F.regexp_replace(sentence, r"\s+", " "))
    return F.when(low_value(text) | cites(text), F.lit(0.0)).otherwise(needed_points(F.lower(text)))


def citation_needed(texts: DataFrame, id_col: str, text_col: str, least: float = 0.55) -> DataFrame:
    """id, sent_idx, score of sentences that need a citation, the first of equal sentences of a document.

    Cheap tests come first, and each column is made once a sentence: most sentences are too short, or have too few points, to be looked
    at for citations.
    """
    s = texts.select(F.col(id_col), F.posexplode(sentences(F.col(text_col))).alias("sent_idx", "sentence"))  # with single blanks, trimmed
    if least > 0:
        s = s.filter((F.length("sentence") >= SHORTEST) & (F.length("sentence") <= LONGEST))
    s = made_once(made_once(s, "key", F.lower("sentence")), "points", needed_points(F.col("key"))).filter(F.col("points") >= least)
    s = made_once(s, "score", F.when(low_value(F.col("sentence")) | cites(F.col("sentence")), F.lit(0.0)).otherwise(F.col("points"))).filter(F.col("score") >= least)
    return s.groupBy(id_col, "key").agg(F.min("sent_idx").cast("bigint").alias("sent_idx"), F.max("score").alias("score")).drop("key")


def coach(paras: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, para_idx, sent_idx, is_claim, cites) with two claims or more and one citation, in the last sentence."""
    g = paras.groupBy("doc_id", "para_idx").agg(F.count_if("is_claim").alias("claims"), F.count_if("cites").alias("n_cites"), F.max_by("cites", "sent_idx").alias("last"))
    return g.filter("claims >= 2 and n_cites = 1 and last").select("doc_id", "para_idx", "claims")


def length_metrics(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: sentences, mean words and coefficient of variation of sentence lengths."""
    s = texts.select(id_col, F.explode(sentences(F.col(text_col))).alias("s")).select(id_col, word_count(F.col("s")).alias("w")).filter("w >= 4")
    cv = F.coalesce(F.when(F.count(F.lit(1)) > 1, F.stddev_pop("w") / F.avg("w")), F.lit(0.0))
    return s.groupBy(id_col).agg(F.count(F.lit(1)).alias("sentences"), F.round(F.avg("w"), 4).alias("mean_words"), F.round(cv, 4).alias("cv"))
