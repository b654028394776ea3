"""The registered queries of this subpackage: thin, each through its operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourwise.llm.oracles import ORACLES  # noqa: F401 - the entry reads both


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourwise.llm.decontaminate import contamination

    c = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return c.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourwise.llm.urlfilter import RULES, url_verdicts

    return url_verdicts(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourwise.llm.ctw import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourwise.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourwise.llm.chat import format_digests

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return format_digests(conversations.unionByName(more))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourwise.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourwise.llm.embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourwise.llm.mixing import WEIGHTS, mix_sources

    weights = spark.createDataFrame(WEIGHTS, "domain string, lang string, source string, weight double")
    return mix_sources(table(spark, sf_dir, "documents"), weights)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourwise.llm.licenses import catalogue, scan

    return scan(table(spark, sf_dir, "documents"), catalogue(spark))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourwise.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("node")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the query's runs: with h = crc32(doc_id as text) and g = floor(h / 10), a text of n > 0
    words whose h ends in 0 becomes its words, word i >= a replaced by word a + (i - a) % p; a = g % n, p = 1 + floor((n - a) /
    (3 + g % 8)).  The words are then joined by one space."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    words = F.regexp_extract_all(F.when(F.col("g").isNotNull(), F.coalesce("text", F.lit(""))), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    d = d.withColumn("w", words).withColumn("n", F.size("w"))
    d = d.withColumn("a", F.expr("int(if(n > 0, g % n, 0))")).withColumn("p", F.expr("int(1 + floor((n - a) / (3 + g % 8)))"))
    planted = (
        "array_join(concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), int(ceil((n - a) / p)))), 1, n - a)), ' ')"
    )
    return d.select("doc_id", F.expr(f"CASE WHEN n > 0 THEN {planted} ELSE text END").alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourwise.llm.periodic import periodic_runs

    docs = with_planted_runs(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    r = periodic_runs(docs).withColumn("best", F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS s, -r.period AS q)))"))
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return r.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.expr("-best.s AS start"), F.expr("best.length AS length"), F.expr("-best.q AS period"),
        F.expr("(1000 * best.length) div (-best.q) AS exponent_milli"),
        F.sha2(F.expr(listed), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourwise.llm.whitening import whiten

    w = whiten(table(spark, sf_dir, "embeddings"))
    each = w.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error",
    )


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hourwise.llm.linededup import dedup_lines

    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_decontamination, op3_language_model, op4_toxicity, op5_chat, op6_pii, op7_embeddings,
        op8_mixing, op9_minhash, op10_licenses, op11_periodic_runs, op12_whitening, op13_line_dedup,
    )
}

