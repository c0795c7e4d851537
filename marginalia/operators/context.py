"""Context fit: whether a candidate's metadata and abstract suit the claim that wants a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word patterns of the relationships that a claim or a candidate states; the first that is found counts.
RELATIONSHIPS = {
    "causal_or_effect": r"\b(?:affect(?:s|ed)?|cause(?:s|d)?|drive(?:s|n)?|influence(?:s|d)?|lead(?:s)?\s+to|result(?:s|ed)?\s+in|increase(?:s|d)?|reduce(?:s|d)?|improve(?:s|d)?|worsen(?:s|ed)?|determin(?:e|es|ed))\b",
    "association": r"\b(?:associat(?:e|ed|ion)|correlat(?:e|ed|ion)|relat(?:e|ed|ionship)|link(?:s|ed)?|predict(?:s|ed)?)\b",
    "comparison": r"\b(?:higher|lower|greater|less|more|difference|differ(?:s|ed)?|compar(?:e|ed|ison))\b",
    "prevalence_or_frequency": r"\b(?:prevalence|incidence|rate|frequency|proportion|percentage|majority|minority)\b",
    "descriptive_or_process": r"\b(?:describe(?:s|d)?|implement(?:s|ed|ation)|adopt(?:s|ed|ion)|experience(?:s|d)?|perceiv(?:e|ed)|report(?:s|ed)?)\b",
}
UNSPECIFIED = "descriptive_or_unspecified"
#: The kind of evidence that a claim needs, by its words or relationship, in this order.
EVIDENCE = (
    (r"\b(?:law|act|regulation|constitution|judgment|case law|policy)\b", None, "primary legal, policy or official institutional source"),
    (None, "causal_or_effect", "causal, longitudinal, experimental, quasi-experimental or strong synthesis evidence"),
    (r"\d+(?:\.\d+)?\s*%", "prevalence_or_frequency", "population-based quantitative evidence or official statistics"),
    (r"\b(?:experience|perception|view|barrier|theme)\b", None, "qualitative or mixed-method evidence from the stated population and setting"),
    (r"\b(?:define|definition|theory|framework|model)\b", None, "primary conceptual, theoretical or authoritative source"),
)
ANY_EVIDENCE = "empirical or authoritative evidence matching the claim scope"
#: Words of a candidate that make it evidence of a kind, by a word of the kind's name.
EVIDENCE_WORDS = (
    (("legal", "policy"), r"\b(?:law|legal|policy|government|official|regulation|court|judicial)\b"),
    (("causal",), r"\b(?:experiment|quasi-experiment|longitudinal|panel data|difference-in-differences|randomi[sz]ed|systematic review|meta-analysis|causal)\b"),
    (("quantitative", "statistics"), r"\b(?:survey|census|sample|quantitative|prevalence|incidence|regression|statistical|administrative data)\b"),
    (("qualitative",), r"\b(?:qualitative|interview|focus group|thematic|mixed method|ethnograph)\b"),
    (("conceptual", "theoretical"), r"\b(?:theory|theoretical|conceptual|framework|review)\b"),
)


def relationship(text: Column) -> Column:
    """The relationship that a text states first in the table's order."""
    out = F.lit(UNSPECIFIED)
    for name, pattern in reversed(RELATIONSHIPS.items()):
        out = F.when(F.lower(text).rlike(pattern), name).otherwise(out)
    return out


def required_evidence(claim: Column) -> Column:
    """The kind of evidence that a claim needs."""
    low, stated, out = F.lower(claim), relationship(claim), F.lit(ANY_EVIDENCE)
    for pattern, kind, name in reversed(EVIDENCE):
        hit = F.lit(False)
        hit = hit | low.rlike(pattern) if pattern else hit
        hit = hit | (stated == kind) if kind else hit
        out = F.when(hit, name).otherwise(out)
    return out


def evidence_matches(required: Column, text: Column) -> Column:
    """Whether a candidate's words make it evidence of the required kind; any text does for the general kind."""
    low, out = F.lower(text), F.trim(text) != ""
    for names, pattern in reversed(EVIDENCE_WORDS):
        named = F.lit(False)
        for n in names:
            named = named | F.lower(required).contains(n)
        out = F.when(named, low.rlike(pattern)).otherwise(out)
    return out


def context_fit(pairs: DataFrame) -> DataFrame:
    """pairs with score, passes, review, label and the reasons against a candidate.

    pairs(claim, candidate, abstract_terms, metadata_relevance, and arrays of terms: concepts, generic, subjects, topics,
    locations, sections, disciplines, populations, places). Terms are lower-cased words; locations and places may be
    phrases, looked for as such in the candidate.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("candidate"), F.lit(r"([a-z][a-z'-]{2,})"), F.lit(1)))
    found = lambda c: F.array_intersect(F.col(c), words)
    within = lambda c: F.filter(F.col(c), lambda t: F.lower("candidate").contains(t))
    share = lambda hit, c, most: F.size(hit) / F.greatest(F.lit(1), F.least(F.size(c), F.lit(most)))
    p = pairs.withColumns({"__c": found("concepts"), "__stated": relationship(F.col("claim")), "__other": relationship(F.col("candidate")), "__loc": within("locations")})
    p = p.withColumn("__specific", F.size(F.array_except("__c", "generic")))
    same = (F.col("__stated") == UNSPECIFIED) | (F.col("__stated") == F.col("__other"))
    unknown = F.col("__other") == UNSPECIFIED
    subject = F.when(F.size("subjects") == 0, F.lit(1.0)).otherwise(share(found("subjects"), "subjects", 5))
    scope = (F.size("locations") == 0) | (F.size("__loc") > 0)
    evidence = evidence_matches(required_evidence(F.col("claim")), F.col("candidate"))
    score = (
        share(F.col("__c"), "concepts", 10) * 40 + subject * 12 + F.when(same, 16).when(unknown, 7).otherwise(0) + F.when(scope, 12).otherwise(0) + F.when(evidence, 8).otherwise(0) + share(found("topics"), "topics", 12) * 7
        + F.least(F.lit(4), F.size(found("sections")) * 2) + F.least(F.lit(4), F.size(found("disciplines"))) + F.least(F.lit(4), F.size(found("populations")) * 2) + F.least(F.lit(4), F.size(within("places")) * 2) + F.least(F.col("metadata_relevance"), F.lit(100)) * 0.05
    )
    p = p.withColumn("score", F.bround(F.round(F.least(F.lit(100.0), score), 6), 0).cast("int"))
    generic_only = (F.size("__c") > 0) & (F.col("__specific") == 0)
    reasons = F.array_compact(F.array(
        F.when(F.col("__specific") < 2, "few_specific_concepts"), F.when(generic_only, "generic_keywords_only"), F.when(~scope, "location_not_found"), F.when(~same, F.when(unknown, "relationship_unconfirmed").otherwise("relationship_differs")),
        F.when(F.col("abstract_terms") < 12, "no_usable_abstract"), F.when(F.col("score") < 70, "score_below_70"),
    ))
    p = p.withColumn("reasons", reasons).withColumn("passes", F.size("reasons") == 0)
    review = ~F.col("passes") & (F.col("__specific") >= 2) & ~generic_only & scope & (same | unknown) & (F.col("score") >= 60)
    label = (
        F.when(F.col("passes") & (F.col("score") >= 85), "strong_structured_context_fit").when(F.col("passes"), "possible_structured_context_fit").when(F.col("review"), "manual_full_text_review_required")
        .when(F.col("score") >= 55, "weak_or_incomplete_context_fit").otherwise("out_of_scope_or_general_keyword_match")
    )
    return p.withColumn("review", review).withColumn("label", label).drop("__c", "__stated", "__other", "__loc", "__specific")


def title_relevance(title_terms: Column, context_terms: Column, phrase_hits: Column) -> Column:
    """Relevance of a title to a claim's context: 45 parts of shared terms and 8 for each of two phrases, 45 at most."""
    shared = F.size(F.array_intersect(title_terms, context_terms))
    ratio = F.when((F.size(title_terms) == 0) | (F.size(context_terms) == 0), 0.0).otherwise(shared / F.greatest(F.lit(1), F.least(F.size(title_terms), F.size(context_terms))))
    return F.least(F.lit(45), (F.bround(F.round(ratio * 45, 6), 0) + F.least(phrase_hits, F.lit(2)) * 8).cast("int"))
