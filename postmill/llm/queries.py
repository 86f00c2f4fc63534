"""Queries of this subpackage: p2, p3 and p5 to p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.history import covered_rows
from postmill.llm.leaks import leaked_items
from postmill.llm.names import link_names
from postmill.llm.near import joined_text, near_groups, near_pairs, row_pairs
from postmill.llm.packing import pack_texts
from postmill.llm.places import placed
from postmill.llm.postings import accepted_before
from postmill.llm.quality import not_prose, prose_distances


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "raw_jobs").select(F.col("row_id").alias("id"), joined_text("title", "description").alias("text"))


#: What TESTDATA.md asks for: at least half of the three-word sequences of two rows of 20 words or more.
SAME_POSTING = {"threshold": 0.5, "shingle": 3, "min_words": 20}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return row_pairs(*near_pairs(_postings(spark, d), **SAME_POSTING))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per posting: its class of near-duplicates and the number of its representative's links.

    A posting whose text is missing or too short to be compared is a class of its own.
    """
    rows = _postings(spark, d)
    own = lambda c: F.coalesce(c, "id").alias(c)
    return rows.select("id").join(near_groups(rows, **SAME_POSTING), "id", "left").select("id", own("rep"), own("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "raw_jobs").select("row_id", "batch_no", "global_id", "requisition_id", "company", "location")
    return accepted_before(rows, _company_names(spark, d), _t(spark, d, "places"))


def p3_covered(spark: SparkSession, d: str) -> DataFrame:
    """How much of each later posting's text earlier batches hold already, and which posting brought most of it."""
    rows = _t(spark, d, "raw_jobs").select("row_id", F.col("batch_no").alias("batch"), joined_text("title", "description").alias("text"))
    return covered_rows(rows)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = placed(_t(spark, d, "raw_jobs").select("row_id", "location"), _t(spark, d, "places"))
    return rows.select("row_id", F.explode("place_ids").alias("place_id"))


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that name no listed place, with the number of rows that have them."""
    rows = placed(_t(spark, d, "raw_jobs").select("row_id", "location"), _t(spark, d, "places"))
    return rows.where(F.array_contains("place_ids", 0)).groupBy("location").agg(F.count("*").alias("n_rows"))


def _company_names(spark: SparkSession, d: str) -> DataFrame:
    company = F.col("company").alias("name")
    return _t(spark, d, "raw_jobs").select(company).unionAll(_t(spark, d, "jobs").select(company))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    linked = link_names(_company_names(spark, d))
    other = linked.select(F.col("name").alias("name_b"), "org")
    return linked.withColumnRenamed("name", "name_a").join(other, "org").where("name_a < name_b").select("name_a", "name_b")


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per spelling: the organisation's first spelling by code points, and how many spellings it has."""
    linked = link_names(_company_names(spark, d))
    org = linked.groupBy("org").agg(F.min("name").alias("first_name"), F.count("*").alias("n_names"))
    return linked.join(org, "org").select("name", "first_name", "n_names")


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(_t(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return not_prose(_t(spark, d, "documents"), _t(spark, d, "doc_labels"))


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every document's statistics, distance from prose, and each statistic's part in it."""
    return prose_distances(_t(spark, d, "documents"), _t(spark, d, "doc_labels"))


QUERIES = {"p9_found": p9_found, "p9_statistics": p9_statistics, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_covered": p3_covered, "p5_found": p5_found, "p5_unmatched": p5_unmatched, "p6_found": p6_found, "p6_groups": p6_groups, "p7_pack": p7_pack, "p8_found": p8_found}
