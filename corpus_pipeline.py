"""A corpus pipeline: each stage calls one operator of ``tessera.llm`` on what the stage before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame that is written as Parquet
and reread as the next one's docs; all but the last return the columns of documents.
Nulls: a null text scores the base rate, has no lines, links with nothing, contains
no test item and encodes to no tokens; a null id is kept by every stage. Rows with the
same id are one document for near duplicates, so they stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, decontaminate, jaccard_join, line_templates, toxicity
from tessera.llm.text import bound_batches, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay."""
    bound_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = "toxicity" + "_" * max(map(len, docs.columns))  # longer than any column
    return toxicity.score(docs, model, score_col=name).where(F.col(name) < 0.5).drop(name)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the lines of templates that recur; n_chars follows the text."""
    bound_batches(spark)
    out = line_templates.drop_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the least id stays."""
    bound_batches(spark)
    rest = jaccard_join.join_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(jaccard_join.small(materialize(rest, "duplicates")), "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item stay."""
    bound_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document."""
    bound_batches(spark)
    ranks = public_tokenizers.path(byte_bpe.RANKS)
    return byte_bpe.digests(byte_bpe.encode(docs, ranks, keep=["doc_id"]), ranks)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_recurring_lines), ("n-gram Jaccard join", drop_near_duplicates),
          ("benchmark decontamination", drop_leaks), ("byte-level BPE", encode)]
#: The toxicity model and the line templates can't be told in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
