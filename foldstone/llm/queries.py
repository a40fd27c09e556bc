"""Queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import leaks, seen, tokens, topics


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seen(spark: SparkSession, sf_dir: str) -> seen.Seen:
    return seen.seen_before(_table(spark, sf_dir, "incoming_entries"), _table(spark, sf_dir, "sst_entries"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen.found(_seen(spark, sf_dir))


def p1_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen.error_rates(_seen(spark, sf_dir))


def p1_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``p1_error_rates`` that doesn't depend on chance: each batch's filters, keys and new keys."""
    return p1_error_rates(spark, sf_dir).select("batch", "filters", "keys", "new_keys")


def p1_filter_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen.filter_sizes(_seen(spark, sf_dir))


def p1_sealed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys the filters of each generation and batch hold."""
    return p1_filter_sizes(spark, sf_dir).select("part", "keys")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(_table(spark, sf_dir, "documents"))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the text that its ids give; equal to the text itself, and '' for NULL."""
    return tokens.texts_of(p6_ids(spark, sf_dir)).select("doc_id", F.col("text").alias("decoded"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item of each page with how much is printed and whether question and answer are there."""
    rows = leaks.leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))
    return rows.withColumn("score", F.round("score", 3)).withColumn("question_share", F.round("question_share", 3))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def _fitted(spark: SparkSession, sf_dir: str) -> topics.Fitted:
    return topics.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "subject_areas"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir).subjects().select("doc_id", "subject")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the corpus is made of: pages and words of each subject."""
    return _fitted(spark, sf_dir).subjects().groupBy("subject").agg(F.count("*").alias("pages"), F.round(F.sum("words"), 0).alias("words"))


def p8_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fitted topic with its subject and top terms."""
    return _fitted(spark, sf_dir).topics()


def _slice_sql(col: str, low: str, high: str, n: int) -> str:
    return f"CAST(least({n - 1}, ({col} - {low}) // greatest(1, ({high} - {low} + {n}) // {n})) AS INTEGER)"


_SLICES_SQL = f"""
    i AS (SELECT probe_id, key, min(probe_id) OVER () AS low, max(probe_id) OVER () AS high FROM incoming_entries WHERE key IS NOT NULL AND probe_id IS NOT NULL),
    a AS (SELECT DISTINCT key, {_slice_sql("probe_id", "low", "high", seen.BATCHES)} AS batch FROM i),
    e AS (SELECT run_id, key, min(run_id) OVER () AS low, max(run_id) OVER () AS high FROM sst_entries WHERE key IS NOT NULL),
    h AS (SELECT DISTINCT key, coalesce({_slice_sql("run_id", "low", "high", seen.GENERATIONS)}, 0) AS part FROM e)"""


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_error_rates, p1_batches, p1_filter_sizes, p1_sealed_keys, p6_ids, p6_roundtrip, p7_found, p7_leaks, p8_found, p8_mix, p8_topics)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            WITH i AS (SELECT DISTINCT probe_id, key FROM incoming_entries WHERE key IS NOT NULL AND probe_id IS NOT NULL),
            f AS (SELECT *, min(probe_id) OVER (PARTITION BY key) AS first FROM i)
            SELECT DISTINCT probe_id FROM f WHERE probe_id > first OR key IN (SELECT key FROM sst_entries WHERE key IS NOT NULL)""",
        "p1_batches": f"""
            WITH {_SLICES_SQL}, m AS (SELECT key, batch, min(batch) OVER (PARTITION BY key) AS since FROM a)
            SELECT batch, batch + {seen.GENERATIONS} AS filters, count(*) AS keys, count(*) FILTER (WHERE since = batch AND key NOT IN (SELECT key FROM h)) AS new_keys FROM m GROUP BY batch""",
        "p1_sealed_keys": f"""
            WITH {_SLICES_SQL} SELECT part, count(*) AS keys FROM h GROUP BY part
            UNION ALL SELECT batch + {seen.GENERATIONS}, count(*) FROM a WHERE batch < {seen.BATCHES - 1} GROUP BY batch""",
        "p6_roundtrip": "SELECT doc_id, coalesce(text, '') AS decoded FROM documents",
    }
