"""The registered queries of this package and the SQL counterparts of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import exact, fingerprints, language, merges, nearness, negatives, packing, pages, pieces, quality, repairs, secrets, toxicity
from .common import table

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_50k.tiktoken"


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"), model or public_tokenizers.path(PIECES))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path(BYTE_BPE))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearness.near_dedup(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints_with_edits(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs.repaired(table(spark, sf_dir, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    return merges.round_trips(table(spark, sf_dir, "documents"), ranks or public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_sentencepiece,
        op2_html_extraction,
        op3_language_id,
        op4_packing,
        op5_exact_dedup,
        op6_near_dedup,
        op7_quality,
        op8_secret_scan,
        op9_toxicity,
        op10_fingerprints,
        op11_conversation_repair,
        op12_byte_bpe,
        op13_hard_negatives,
    )
    return {f.__name__: f for f in own}


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW same AS (PARTITION BY norm)
"""

NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i+4] END, ' ') AS shingle
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i)
  WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT l.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, l.doc_id = component_id AS kept
FROM least l LEFT JOIN n ON n.doc_id = l.doc_id
"""


def secret_sql() -> str:
    parts = []
    for at, (kind, pattern, group, least) in enumerate(secrets.RULES):
        quoted = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""
  SELECT rid, '{kind}' AS kind, {at} AS kind_at, w, p, sum(g + w) OVER (PARTITION BY rid ORDER BY i) AS stop, {least} AS least
  FROM (SELECT rid, i, length(m[i]) AS w, length(p[i]) AS p, length(g[i]) AS g
        FROM (SELECT rid, regexp_extract_all(t, {quoted}, 0) AS m, regexp_extract_all(t, {quoted}, {group}) AS p, string_split_regex(t, {quoted}) AS g
              FROM d WHERE regexp_matches(t, {quoted})) AS f, unnest(range(1, len(m) + 1)) AS u(i)) AS e""")
    union = "\n  UNION ALL".join(parts)
    base = ", ".join(f"'{k}'" for k in secrets.BASE_KINDS)
    said = "kind || ':' || (stop - w) || ':' || stop, ',' ORDER BY stop - w, kind_at"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({union}
),
told AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg({said}) FILTER (kind IN ({base})) AS base, string_agg({said}) AS spans
  FROM (SELECT rid, kind, kind_at, CAST(w AS BIGINT) AS w, CAST(stop AS BIGINT) AS stop FROM found WHERE p >= least) AS f GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": EXACT_SQL, "op6_near_dedup": NEAR_SQL, "op8_secret_scan": secret_sql(), "op11_conversation_repair": repairs.SQL, "op13_hard_negatives": negatives.SQL}
