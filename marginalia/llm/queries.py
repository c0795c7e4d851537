"""The queries opN_<name> over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.bpe_lexicon import encode_texts
from marginalia.llm.collocations import collocations
from marginalia.llm.common import materialise
from marginalia.llm.exact_dedup import exact_duplicates
from marginalia.llm.language_id import identify
from marginalia.llm.mixing import mix_sources
from marginalia.llm.ngram_join import similar_documents
from marginalia.llm.quality import score_quality
from marginalia.llm.quality_rules import RULES, STOP_WORDS, judge
from marginalia.llm.ranked_search import ranked_documents
from marginalia.llm.simhash import edited_fingerprints, near_counts
from marginalia.llm.token_file import token_offsets
from marginalia.llm.toxicity import score_toxicity
from marginalia.llm.url_filters import filter_urls

#: host, path, verdict of the production rules.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), words=4, percent=85)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def digests(encoded: DataFrame, id_col: str = "doc_id", *more: str) -> DataFrame:
    """Count and digests of encoded and decoded texts, and more columns as they are."""
    return encoded.select(
        id_col, *more, (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_texts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents; near_documents: for ids divisible by 50, the documents within Hamming radius 3."""
    prints = materialise(edited_fingerprints(table(spark, sf_dir, "documents")), "prints")
    return near_counts(prints, F.col("doc_id") % 50 == 0)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_offsets(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_url_filters, op2_language_id, op3_ngram_join, op4_mix_sources, op5_toxicity, op6_quality, op7_bpe_codec, op8_exact_dedup, op9_fingerprints, op10_token_file, op11_quality_rules, op12_ranked_search, op13_collocations]
    return {f.__name__: f for f in found}


_CASES = "\n".join(
    f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (h, p, _) in sorted(enumerate(URL_RULES), key=lambda r: -len(r[1][0] + r[1][1]))
)

OP1_SQL = f"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests)
SELECT page_id, host, path,
  CASE
{_CASES.format(*[h + p for h, p, _ in URL_RULES])}
  END AS rule,
  CASE
{_CASES.format(*[v for *_, v in URL_RULES])}
    ELSE 'allow'
  END AS verdict
FROM parts
"""

OP3_SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM worded),
shingles AS (SELECT doc_id, unnest(s) AS sh FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * c >= 85 * (len(p.s) + len(q.s) - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, min(y) AS component_id FROM sets JOIN reach ON x = doc_id GROUP BY doc_id, len(s)
"""

OP4_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source AS s, greatest(sum(coalesce(length(text), 0)), count(*)) AS size FROM documents GROUP BY source),
rates AS (
  SELECT s, 1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE * (SELECT sum(size) FROM sizes)::DOUBLE * 1.0::DOUBLE / size::DOUBLE AS rate FROM sizes),
draws AS (SELECT s, rate, greatest(ceil(rate / 16), 1)::INT AS draws FROM rates),
tables AS (
  SELECT s, 0 AS k, exp(-(rate / draws)) AS p, exp(-(rate / draws)) AS c, rate / draws AS mean FROM draws
  UNION ALL
  SELECT s, k + 1, p * mean / (k + 1), c + p * mean / (k + 1), mean FROM tables WHERE k < 72),
cdfs AS (SELECT s, list(c ORDER BY k) AS cdf FROM tables GROUP BY s),
counted AS (
  SELECT d.*, r.rate AS mix_rate, list_sum(list_transform(range(1, r.draws + 1), lambda i: len(list_filter(t.cdf, lambda c:
    c <= ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || i::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)))) AS n
  FROM documents d JOIN draws r ON d.source IS NOT DISTINCT FROM r.s JOIN cdfs t ON d.source IS NOT DISTINCT FROM t.s),
copies AS (SELECT * EXCLUDE (n), unnest(range(0, n::BIGINT))::INT AS mix_copy FROM counted)
SELECT *, md5('17:order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || mix_copy::VARCHAR) AS mix_key FROM copies
"""


OP8_SQL = """
WITH norm AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER g = 1 AS kept, sha256(t) AS text_sha256
FROM norm WINDOW g AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""


_MEASURES = {
    "mean_word_chars": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words", "stop_word_share": "n_stop_words / n_words", "duplicate_line_share": "n_dup_lines / n_lines",
    "letter_word_share": "n_letter_words / n_words", "ellipsis_line_share": "n_ellipsis_lines / n_lines", "bullet_line_share": "n_bullet_lines / n_lines",
}
_WITHIN = " AND ".join(f"coalesce({_MEASURES[m]} {sign} {bound}, true)" for m, least, most in RULES for sign, bound in ((">=", least), ("<=", most)) if bound is not None)
_STOP = ", ".join(f"'{w}', '{w[0].upper() + w[1:]}'" for w in STOP_WORDS)

OP11_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
worded AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
windows AS (
  SELECT r, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS x FROM worded WHERE len(w) > 8),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
covered AS (SELECT r, count(DISTINCT i + o)::BIGINT AS n FROM again, range(0, 8) v(o) GROUP BY r),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines, len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop_words,
    len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words, len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*\\z'))) AS n_ellipsis_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS n_bullet_lines
  FROM worded LEFT JOIN covered c USING (r)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_WITHIN} AS kept FROM based
"""

OP12_SQL = r"""
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT doc_id, len(w)::BIGINT AS n FROM tokens),
corpus AS (SELECT count(*) FILTER (n > 0) AS docs, sum(n)::BIGINT AS terms FROM sizes),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tokens) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (SELECT item_id, term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN dfs USING (term), corpus),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM weights JOIN tfs USING (term) JOIN sizes USING (doc_id), corpus GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM worded, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 10),
cuts AS (
  SELECT lang, phrase, k, a, c, array_to_string(w[1:c], ' ') AS lp, array_to_string(w[c + 1:], ' ') AS rp FROM cand, (VALUES (1), (2)) v(c) WHERE c < k),
scored AS (
  SELECT t.lang, t.phrase, t.k, t.a, c, x.a AS l, y.a AS r, ((1000000::HUGEINT * t.a * t.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts t JOIN f x ON x.lang = t.lang AND x.phrase = lp JOIN f y ON y.lang = t.lang AND y.phrase = rp),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM cand WHERE k = 3),
covered AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL),
ranked AS (
  SELECT p.*, row_number() OVER (PARTITION BY p.lang ORDER BY score DESC, a DESC, encode(p.phrase)) AS rank
  FROM lowest p LEFT JOIN covered o ON o.lang = p.lang AND o.phrase = p.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op3_ngram_join": OP3_SQL, "op4_mix_sources": OP4_SQL, "op8_exact_dedup": OP8_SQL, "op11_quality_rules": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_collocations": OP13_SQL}
