"""Registered queries of this subpackage and their DuckDB SQL, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, cdc_dedup, decontaminate, hmm_lm, jaccard_join, line_templates, quality_cascade, secret_scan, spelling_groups, suffix_dedup, token_alignment, toxicity, warc
from tessera.llm.text import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the quality cascade, one row a document."""
    return quality_cascade.apply(table(spark, sf_dir, "documents"))


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes, one row a document."""
    ranks = public_tokenizers.path(byte_bpe.RANKS)
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, keep=["doc_id"])
    return byte_bpe.digests(ids, ranks)


_SHINGLES = """
SELECT DISTINCT {id}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
FROM (SELECT {id}, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
      FROM {table} WHERE text IS NOT NULL)"""


@query("op3_decontaminate", f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}), b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS s FROM d JOIN b USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, CAST(s AS BIGINT) AS n_shared FROM s JOIN n USING (item_id) WHERE 100 * s >= 80 * n""")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they contain, a row a pair."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("containment")


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes and spans of each document, and a digest of the remaining bytes."""
    out = suffix_dedup.remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores learnt from the other four folds, one row a document."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_hmm_lm")
def op6_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and hidden Markov log10 probabilities, one row a document."""
    return hmm_lm.score(table(spark, sf_dir, "documents"))


@query("op7_jaccard_join", f"""
WITH RECURSIVE d AS ({_SHINGLES.format(id="doc_id", table="documents")}), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
s AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS s FROM d a JOIN d b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY x, y),
l AS (SELECT x, y FROM s JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * s >= 80 * (a.n + b.n - s)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT x AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(y) AS component_id FROM r LEFT JOIN n ON doc_id = x GROUP BY x""")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of near-duplicate links, one row a document."""
    return jaccard_join.join_components(table(spark, sf_dir, "documents"))


@query("op8_warc")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back, one row a page."""
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select(F.expr("try_cast(record_id AS bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.expr("try_cast(refers_to AS bigint)").alias("refers_to"))


@query("op9_cdc_dedup")
def op9_cdc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, repeats and removed bytes of each document, and a digest of what is kept."""
    out = cdc_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), stats=True)
    return out.select("doc_id", "n_bytes", "n_chunks", "n_repeats", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op10_line_templates")
def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and dropped lines of each document, and a digest of what is kept."""
    out = line_templates.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), n_lines_col="n_lines", n_dropped_col="n_dropped")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op11_spelling_groups")
def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, their counts, near words, forms and roots, one row a word."""
    return spelling_groups.group(table(spark, sf_dir, "documents"))


_SECRET_KINDS = "\nUNION ALL ".join(
    f"SELECT r, doc_id, source, {k} AS kind, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {g}) AS vals FROM d"
    for k, (p, g) in enumerate([(secret_scan.ASSIGN.replace("'", "''"), 2), (secret_scan.ACCESS, 0), (secret_scan.HEX, 0), (secret_scan.OWNED, 0)]))


@query("op12_secret_scan", f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
h AS ({_SECRET_KINDS}),
u AS (SELECT r, doc_id, source, kind, unnest(range(len(hits))) AS pos, unnest(hits) AS hit, unnest(vals) AS val, unnest(gaps[1:len(hits)]) AS gap FROM h WHERE len(hits) > 0),
e AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY r, kind ORDER BY pos) AS BIGINT) AS stop FROM u),
s AS (SELECT r, doc_id, source, kind, stop - length(hit) AS start, stop, val,
        regexp_matches(val, '{secret_scan.PLACEHOLDERS}') AS plain, regexp_matches(val, '[0-9]') AS digit, regexp_matches(val, '[a-z]') AS low, regexp_matches(val, '[A-Z]') AS up
      FROM e WHERE kind > 0 OR length(val) >= 8),
b AS (SELECT * FROM s WHERE kind < 3 OR digit AND low AND up AND NOT plain AND NOT EXISTS (SELECT 1 FROM s AS o WHERE o.r = s.r AND o.kind < 3 AND o.start < s.stop AND o.stop > s.start)),
o AS (SELECT val, count(*) AS n_owners FROM (SELECT DISTINCT val, source FROM b) GROUP BY val),
j AS (SELECT b.*, CASE WHEN plain OR n_owners >= {secret_scan.WIDE_OWNERS} THEN 'example' WHEN n_owners = 1 AND digit AND (low OR up) THEN 'live' ELSE 'shared' END AS verdict,
        (['assign', 'access', 'hex', 'owned'])[kind + 1] || ':' || start || ':' || stop AS said FROM b JOIN o USING (val)),
k AS (SELECT * FROM j WHERE kind < 3 OR verdict = 'live')
SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_owned,
  sha256(coalesce(string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY start, kind), '') AS spans,
  count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'shared') AS n_shared, count(*) FILTER (verdict = 'example') AS n_example
FROM d LEFT JOIN k ON d.r = k.r GROUP BY d.r""")
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by kind, a digest of the base spans, all spans, and verdicts by ownership, one row a document."""
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of two tokenizers, and how common the linked pairs are, one row a document."""
    docs = table(spark, sf_dir, "documents")
    return token_alignment.report(docs.select(F.col("doc_id").cast("long"), "text"))
