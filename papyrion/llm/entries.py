"""Queries that apply the training-data operators to their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, covertree, langid, media, mixing, packing, quality, secrets, toxicity, zipwarc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and domain (its language) of the documents that the labels table has reviewed."""
    known = docs.where(F.col("lang").isNotNull()).select("doc_id", F.col("lang").alias("domain"))
    return known.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id")


#: Shares of tokens by domain that operator 9 mixes to; other domains keep their natural share.
WEIGHTS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = quality.ratings(table(spark, sf_dir, "labels"))
    return quality.classify(table(spark, sf_dir, "documents"), graded)


def op3_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op5_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.documents_as_media(table(spark, sf_dir, "documents"), with_media=False)


def op7_bagminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op8_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zipwarc.round_trip(table(spark, sf_dir, "pages"))


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.rates(docs, domains(spark, docs, sf_dir), WEIGHTS)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


#: Base patterns of operator 4 for DuckDB: ASCII letters in either case are spelled out, as its engine folds others too.
_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_WORD = r"(?:[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*[0-9]{0,2}|[A-Z]+[0-9]{0,2}|[0-9]{1,8})"
_PART = rf"(?:{_WORD}(?:[_-]+{_WORD})*)?"
#: kind, pattern, and whether a match m counts.
_FINDERS = (
    ("assign", _ASSIGN, "length(regexp_extract(m, '{pattern}', 2)) >= 6"), ("access", "AKIA[A-Z0-9]{16,}", "true"), ("hex", "[0-9a-f]{24,}", "true"),
    *[(kind, pattern, f"NOT suppressed(m) AND len(list_filter(range(0, length(m) - {window - 1}), lambda i: list_entropy(string_split(substr(m, CAST(i + 1 AS INTEGER), {window}), '')) >= {bits} - 1e-9)) > 0") for kind, pattern, _, window, bits in secrets.CLASSES],
)


def _secrets_sql() -> str:
    quoted = lambda x: x.replace("'", "''")
    allowed = " OR ".join([
        "regexp_full_match(m, '[A-Za-z]+')", "regexp_full_match(m, '[a-z]+([_/-][a-z]+)+')", "len(list_distinct(string_split(m, ''))) = 1", "regexp_full_match(m, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}')",
        f"regexp_full_match(m, '(?:{_PART}/)+{_PART}')", "regexp_matches(m, '(?i)example|placeholder|changeme')",
    ])
    parts = []
    for rank, (kind, pattern, counts) in enumerate(_FINDERS):
        p = quoted(pattern)
        counts = counts.replace("{pattern}", p).replace("suppressed(m)", f"({allowed})")
        parts.append(f"""SELECT row_no, '{kind}' AS kind, {rank} AS rank, start_at, start_at + length(m) AS end_at FROM (
  SELECT row_no, m, CAST(sum(length(g) + length(m)) OVER (PARTITION BY row_no ORDER BY k) - length(m) AS BIGINT) AS start_at FROM (
    SELECT row_no, unnest(found) AS m, unnest(gaps[1:len(found)]) AS g, unnest(range(0, len(found))) AS k FROM (SELECT row_no, regexp_extract_all(t, '{p}') AS found, string_split_regex(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}')))) WHERE {counts}""")
    span = "string_agg(concat(kind, ':', start_at, ':', end_at), ',' ORDER BY start_at, rank)"
    return f"""WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)}),
a AS (SELECT row_no, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {span} FILTER (rank < 3) AS base, {span} AS spans FROM s GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (row_no)"""


QUERIES = {f.__name__: f for f in (
    op1_language_mixture, op2_ordinal_quality, op3_toxicity_grammar, op4_entropy_secrets, op5_cover_tree_search,
    op6_media_tiles, op7_bagminhash_classes, op8_zip_warc, op9_soft_mixing, op10_best_fit_packing,
)}

SQL = {
    "op5_cover_tree_search": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.r <> d.r WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 20
""",
    "op4_entropy_secrets": _secrets_sql(),
    "op8_zip_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_page FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST(concat('0x', substr(h, CAST(1 + i // 4 * 5 AS INTEGER), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first_page THEN first_page END AS refers_to FROM f
""",
}
