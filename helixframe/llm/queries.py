"""Queries of the language-model training-data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import formatdups, leakage, severity, tokens, topn


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The five best sites of every sample and small RNA."""
    sites = spark.read.parquet(f"{sf}/detected_sites.parquet")
    sites = sites.where(F.col("srna").isNotNull() & F.col("allen_score").isNotNull() & ~F.isnan("allen_score"))
    return topn.top_n(sites, ["sample_name", "srna"], [("allen_score", False), ("slice_site_rpm", True)], "site_id", 5)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Copies in another notation, with the first record of their group."""
    records = spark.read.parquet(f"{sf}/anno_mirna.parquet")
    return formatdups.same_records(records, ["name", "sequence"], "rec_id").where("first_id <> rec_id")


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One record of each group, with the number of its copies."""
    return formatdups.collapse(spark.read.parquet(f"{sf}/anno_mirna.parquet"), ["name", "sequence"], "rec_id")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_column(spark.read.parquet(f"{sf}/documents.parquet"), "text", ["doc_id"])


def _leaks(spark: SparkSession, sf: str, plan: leakage.WalkPlan) -> DataFrame:
    documents, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet")
    return leakage.find_leaks(documents, "doc_id", "text", items, "item_id", "text", plan)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with at least 12 successive words of an item. Equal passages collide in every walk, so one is enough."""
    return _leaks(spark, sf, leakage.WalkPlan(window=12, least=12, max_edits=0, walk=2.0, sampled=1.0)).select("doc_id", "item_id")


def p7_near(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with 12 words of an item, or all of a shorter one, of which one may be changed, put in or left out."""
    return _leaks(spark, sf, leakage.WalkPlan(sampled=1.0))


def _severity(spark: SparkSession, sf: str) -> DataFrame:
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/review_labels.parquet")
    return severity.score_documents(documents, "doc_id", "text", labels, "abusive", keep=["source"])


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Abusive, hateful or sexual documents."""
    return _severity(spark, sf).where("found").select("doc_id")


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The severity of every document."""
    return _severity(spark, sf).select("doc_id", "severity", "found")


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, severe documents and their rate for every source."""
    rates = _severity(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("found").alias("severe"), F.avg("severity").alias("mean_severity"))
    return rates.withColumn("rate", F.col("severe") / F.col("documents"))


_CANON = "regexp_replace({}, '[^A-Za-z0-9]', '', 'g')"
_PAIR = f"""
WITH c AS (
  SELECT rec_id, lower({_CANON.format('name')}) AS a, lower({_CANON.format('sequence')}) AS b
  FROM anno_mirna WHERE name IS NOT NULL AND sequence IS NOT NULL),
g AS (SELECT rec_id, min(rec_id) OVER (PARTITION BY least(a, b), greatest(a, b)) AS first_id FROM c)
"""

SQL = {
    "p3_found": """
SELECT sample_name, srna, CAST(rank_no AS INTEGER) AS rank_no, site_id FROM (
  SELECT sample_name, srna, site_id, row_number() OVER (PARTITION BY sample_name, srna ORDER BY allen_score,
    CASE WHEN slice_site_rpm IS NULL OR isnan(slice_site_rpm) THEN 1 ELSE 0 END,
    CASE WHEN isnan(slice_site_rpm) THEN NULL ELSE slice_site_rpm END DESC, site_id) AS rank_no
  FROM detected_sites WHERE srna IS NOT NULL AND allen_score IS NOT NULL AND NOT isnan(allen_score))
WHERE rank_no <= 5""",
    "p5_found": _PAIR + "SELECT first_id, rec_id FROM g WHERE first_id <> rec_id",
    "p5_groups": _PAIR + "SELECT first_id, count(*) AS copies FROM g GROUP BY first_id",
    "p7_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[p:p + 11], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d)),
iw AS (SELECT item_id, array_to_string(w[p:p + 11], ' ') AS t FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (t)""",
}

QUERIES = {
    "p3_found": p3_found, "p5_found": p5_found, "p5_groups": p5_groups, "p6_ids": p6_ids, "p7_found": p7_found, "p7_near": p7_near,
    "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates,
}
