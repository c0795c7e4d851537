"""Recorded answers of bibliographic services, as rows of one catalog schema.

A row of recorded(source, item) holds one work as the service gives it: JSON, or XML for the preprint service. Nothing is
fetched here. Parsing stays in the JVM: JSON is a variant, of which only the paths below are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import normal_doi, plain_metadata

COLUMNS = ("doi", "title", "year", "author", "journal", "volume", "issue", "pages", "publisher", "type", "is_retracted")

#: Where each service keeps a field; the first path that is filled counts.
PATHS = {
    "crossref": {"doi": ("$.DOI",), "title": ("$.title[0]",), "year": ("$.issued['date-parts'][0][0]", "$['published-print']['date-parts'][0][0]", "$['published-online']['date-parts'][0][0]"), "journal": ("$['container-title'][0]", "$['short-container-title'][0]"), "volume": ("$.volume",), "issue": ("$.issue",), "pages": ("$.page", "$['article-number']"), "publisher": ("$.publisher",), "type": ("$.type",)},
    "openalex": {"doi": ("$.doi",), "title": ("$.title", "$.display_name"), "year": ("$.publication_year",), "journal": ("$.primary_location.source.display_name",), "volume": ("$.biblio.volume",), "issue": ("$.biblio.issue",), "pages": ("$.biblio.first_page", "$.biblio.last_page"), "publisher": ("$.primary_location.source.host_organization_name",), "type": ("$.type",)},
    "datacite": {"doi": ("$.attributes.doi", "$.doi", "$.id"), "title": ("$.attributes.titles[0].title", "$.titles[0].title"), "year": ("$.attributes.publicationYear", "$.publicationYear"), "journal": ("$.attributes.container.title",), "volume": ("$.attributes.container.volume",), "issue": ("$.attributes.container.issue",), "pages": ("$.attributes.container.firstPage",), "publisher": ("$.attributes.publisher",), "type": ("$.attributes.types.resourceTypeGeneral",)},
    "semantic_scholar": {"doi": ("$.externalIds.DOI",), "title": ("$.title",), "year": ("$.year",), "journal": ("$.journal.name", "$.venue"), "volume": ("$.journal.volume",), "issue": (), "pages": ("$.journal.pages",), "publisher": (), "type": ("$.publicationTypes[0]",)},
    "europepmc": {"doi": ("$.doi",), "title": ("$.title",), "year": ("$.pubYear", "$.firstPublicationDate"), "journal": ("$.journalTitle", "$.journalInfo.journal.title"), "volume": ("$.journalVolume", "$.journalInfo.volume"), "issue": ("$.issue", "$.journalInfo.issue"), "pages": ("$.pageInfo",), "publisher": (), "type": ("$.pubType",)},
    "pubmed": {"doi": (), "title": ("$.title",), "year": ("$.pubdate",), "journal": ("$.fulljournalname", "$.source"), "volume": ("$.volume",), "issue": ("$.issue",), "pages": ("$.pages",), "publisher": (), "type": ("$.pubtype[0]",)},
    "google_books": {"doi": (), "title": ("$.volumeInfo.title",), "year": ("$.volumeInfo.publishedDate",), "journal": (), "volume": (), "issue": (), "pages": (), "publisher": ("$.volumeInfo.publisher",), "type": ("$.volumeInfo.printType",)},
    "open_library": {"doi": (), "title": ("$.title",), "year": ("$.first_publish_year",), "journal": (), "volume": (), "issue": (), "pages": (), "publisher": ("$.publisher[0]",), "type": ()},
    "eric": {"doi": ("$.doi", "$.url"), "title": ("$.title",), "year": ("$.publicationdateyear",), "journal": ("$.source",), "volume": (), "issue": (), "pages": (), "publisher": ("$.publisher",), "type": ("$.publicationtype[0]",)},
    "core": {"doi": ("$.doi",), "title": ("$.title",), "year": ("$.yearPublished",), "journal": ("$.journals[0].title",), "volume": (), "issue": (), "pages": (), "publisher": ("$.publisher",), "type": ("$.documentType",)},
    "doaj": {"doi": ("$.bibjson.identifier[0].id",), "title": ("$.bibjson.title",), "year": ("$.bibjson.year",), "journal": ("$.bibjson.journal.title",), "volume": ("$.bibjson.journal.volume",), "issue": ("$.bibjson.journal.number",), "pages": ("$.bibjson.start_page",), "publisher": ("$.bibjson.journal.publisher",), "type": ()},
}
#: Where each service keeps its list of authors, and the field of an entry (none: entries are names).
AUTHORS = {
    "crossref": ("$.author", "family"), "openalex": ("$.authorships", "author.display_name"), "datacite": ("$.attributes.creators", "name"), "semantic_scholar": ("$.authors", "name"), "pubmed": ("$.authors", "name"),
    "google_books": ("$.volumeInfo.authors", None), "open_library": ("$.author_name", None), "eric": ("$.author", None), "core": ("$.authors", "name"), "doaj": ("$.bibjson.author", "name"),
}


def surname(name: Column) -> Column:
    """Surname of ``Surname, Given``, ``Surname AB`` or ``Given Surname``, lower-cased."""
    n = F.trim(name)
    before = F.substring_index(n, ",", 1)
    initials = F.regexp_extract(n, r"^(\S+)\s+[A-Z]{1,3}$", 1)
    last = F.substring_index(n, " ", -1)
    return F.lower(F.when(n.contains(","), before).when(initials != "", initials).otherwise(last))


def _first(v: Column, paths: tuple[str, ...]) -> Column:
    if not paths:
        return F.lit("")
    return F.coalesce(*[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths], F.lit(""))


def _names(v: Column, source: str) -> Column:
    if source == "europepmc":
        return F.transform(F.split(F.coalesce(F.try_variant_get(v, "$.authorString", "string"), F.lit("")), r",| and "), surname)
    path, field = AUTHORS[source]
    entries = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(entries, lambda e: surname(F.coalesce(F.try_variant_get(e, "$" if field is None else f"$.{field}", "string"), F.lit(""))))


def _extras(v: Column, source: str, fields: dict[str, Column]) -> dict[str, Column]:
    if source == "crossref":
        kind = F.coalesce(F.try_variant_get(v, "$.relation['is-retracted-by']", "variant"), F.try_variant_get(v, "$.relation.retracts", "variant"))
        fields["is_retracted"] = kind.isNotNull()
    elif source == "openalex":
        fields["is_retracted"] = F.coalesce(F.try_variant_get(v, "$.is_retracted", "boolean"), F.lit(False))
    elif source == "europepmc":
        fields["is_retracted"] = F.lower(F.coalesce(F.try_variant_get(v, "$.isRetracted", "string"), F.lit(""))) == "yes"
    elif source == "pubmed":
        ids = F.coalesce(F.try_variant_get(v, "$.articleids", "array<variant>"), F.array().cast("array<variant>"))
        dois = F.filter(ids, lambda e: F.try_variant_get(e, "$.idtype", "string") == "doi")
        fields["doi"] = F.coalesce(F.try_variant_get(F.try_element_at(dois, F.lit(1)), "$.value", "string"), F.lit(""))
    return fields


def _preprint(item: Column) -> dict[str, Column]:
    """Fields of one entry of the preprint service's feed."""
    tag = lambda name: F.regexp_extract(item, rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</", 1)
    names = F.regexp_extract_all(item, F.lit(r"(?s)<name>(.*?)</name>"), F.lit(1))
    none = F.lit("")
    return {"doi": tag("doi"), "title": tag("title"), "year": tag("published"), "author": F.transform(names, surname), "journal": tag("journal_ref"), "volume": none, "issue": none, "pages": none, "publisher": none, "type": F.lit("preprint"), "is_retracted": F.lit(False)}


def catalog(recorded: DataFrame) -> DataFrame:
    """source and the catalog's columns of recorded(source, item): surnames joined by ``;``, years as numbers, normal DOIs.

    An item that cannot be read, or of a service that is not known, gives a row with empty fields, so that none is lost.
    """
    v, source = F.try_parse_json("item"), F.col("source")
    cases = {s: _extras(v, s, {**{c: _first(v, p) for c, p in paths.items()}, "author": _names(v, s), "is_retracted": F.lit(False)}) for s, paths in PATHS.items()}
    cases["arxiv"] = _preprint(F.col("item"))
    empty = {"author": F.array().cast("array<string>"), "is_retracted": F.lit(False)}
    chosen = {}
    for c in COLUMNS:
        value = empty.get(c, F.lit(""))
        for s, fields in cases.items():
            value = F.when(source == s, fields[c]).otherwise(value)
        chosen[c] = value
    out = recorded.select("source", *[chosen[c].alias(c) for c in COLUMNS])
    names = F.array_join(F.array_distinct(F.filter(F.transform("author", lambda a: F.regexp_replace(a, "[^\\p{L}'-]", "")), lambda a: a != "")), ";")
    return out.withColumns({"title": plain_metadata(F.col("title")), "doi": normal_doi(F.col("doi")), "year": F.regexp_extract("year", "((?:1[6-9]|20)[0-9]{2})", 1).try_cast("int"), "author": names, "type": F.lower("type"), "is_retracted": F.coalesce("is_retracted", F.lit(False))})
