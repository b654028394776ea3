"""Corpus pipeline: toxicity, MinHash near-dedup, benchmark decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes each stage's
result as Parquet to the shared folder and reads it back.  All but the last return the columns of ``docs``.

Edge cases: empty tables pass through; null texts are kept by the filters (they are not toxic, contaminated or
copies of anything) and offer no tokens to the mix; more columns than those of documents are carried along to the end,
whatever their names (helper columns take names that are not in use, in any case of letters).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourwise.llm.common import free_names, row_key, staged
from hourwise.llm.queries import table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the factorization machine predicts toxic; it learns from the labelled rows of ``docs``."""
    from hourwise.llm.toxicity import THRESHOLD, fit, score

    terms, model = fit(docs, table(spark, sf_dir, "labels"))
    (name,) = free_names(docs.columns, "score")
    return score(docs, terms, model, name).where(F.col(f"`{name}`") < THRESHOLD).select(*_names(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: of the smallest doc_id (null only where all are), then of the least row
    key.  Rows without words are copies of nothing and all stay."""
    from hourwise.llm.minhash import components_of

    rk = row_key(F.col("doc_id"), F.col("text"))
    found = components_of(docs.select("doc_id", "text"), rk).where("n > 0")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk")).alias("first"))
    (name,) = free_names(docs.columns, "rk")
    keep = staged(first.select(F.col("first.rk").alias(name)))
    # white space as minhash has it
    blank = F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "") == ""
    # repeats of a row go before the join, where a hot one is cut down in each task
    rows = docs.where(~blank).withColumn(name, rk).dropDuplicates([name])
    return rows.join(keep, name, "left_semi").select(*_names(docs)).unionByName(docs.where(blank))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    from hourwise.llm.decontaminate import contamination

    bad = contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    (name,) = free_names(docs.columns, "rk")
    keyed = docs.withColumn(name, row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(bad.select(F.col("rk").alias(name)).distinct(), name, "left_anti").select(*_names(docs))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; ``n_chars`` follows."""
    from hourwise.llm.pii import redacted

    out = redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*_names(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows selected by the target weights, once for each epoch: doc_id, domain, lang, source, n_tokens, epoch, then the text
    and all other columns."""
    from hourwise.llm.mixing import WEIGHTS, mix_sources

    weights = spark.createDataFrame(WEIGHTS, "domain string, lang string, source string, weight double")
    return mix_sources(docs, weights, carry=True)


def _names(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: The first stage is a trained model, which SQL cannot express; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return staged(STAGES[-1][1](spark, docs, sf_dir))
