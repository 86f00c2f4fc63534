"""Postings that are already accepted: by key, or by organisation, requisition and place."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.graph import components
from postmill.llm.history import key_rows
from postmill.llm.names import link_names
from postmill.llm.places import placed
from postmill.session import written


def plain_key(c: Column) -> Column:
    """A global key apart from how it is written: case, spaces, '/' for ':', a leading www., a number's '.0'."""
    k = F.regexp_replace(F.lower(c), r"[\s ]+", "")
    k = F.regexp_replace(F.regexp_replace(k, "/", ":"), r":www\.", ":")
    return F.nullif(F.regexp_replace(k, r"(\d)\.0+$", "$1"), F.lit(""))


def plain_requisition(c: Column) -> Column:
    """A requisition number apart from how it is written: its letters and digits, without a number's '.0'."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^(\D*\d+)\.0+$", "$1"), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def accepted_before(rows: DataFrame, names: DataFrame, places: DataFrame) -> DataFrame:
    """(first_row_id, row_id) for every row that stands for a posting of an earlier row.

    rows: row_id, batch_no, global_id, requisition_id, company, location; batches hold ascending
    row_ids. names: all spellings of organisations to be linked (column name). The same posting: equal
    plain keys, or the same organisation, plain requisition number and single listed place; and what
    follows from these through a chain. NULL or blank keys, numbers, companies and locations match
    nothing. Every repeated row is a case. Empty tables give an empty result.
    """
    base = rows.select("row_id", "batch_no", plain_key(F.col("global_id")).alias("g"), plain_requisition(F.col("requisition_id")).alias("req"), F.col("company").alias("name"), "location")
    numbered = base.where("req is not null and name is not null and location is not null").select("row_id", "req", "name", "location")
    with ThreadPoolExecutor(1) as aside:  # rounds of small jobs, and work on places that needs none of them: together they keep all cores busy
        orgs = aside.submit(link_names, names)
        at = placed(numbered, places).where("size(place_ids) = 1 and place_ids[0] != 0")
    same = at.join(orgs.result(), "name").select("row_id", F.xxhash64(F.lit("r"), "org", "req", F.col("place_ids")[0]).alias("r"))
    keyed = written(base.select("row_id", F.coalesce("batch_no", F.lit(0)).alias("batch"), F.when(F.col("g").isNotNull(), F.xxhash64(F.lit("g"), "g")).alias("g")).join(same, "row_id", "left"), "keys")
    keys = keyed.select(F.explode(F.array("g", "r")).alias("key"), "batch", F.col("row_id").alias("row"))
    first = written(key_rows(keys), "first")
    g, r = (first.select(F.col("key").alias(k), F.col("first_row").alias(f"{k}f")) for k in ("g", "r"))
    both = written(keyed.join(g, "g", "left").join(r, "r", "left").select("row_id", "gf", "rf"), "firsts")
    roots = components(both.where("gf != rf").select(F.col("gf").alias("a"), F.col("rf").alias("b")))
    found = both.withColumn("node", F.coalesce("gf", "rf")).join(roots, "node", "left").select(F.coalesce("root", "node").alias("first_row_id"), "row_id")
    return found.where("first_row_id != row_id")
