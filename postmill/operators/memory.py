"""What is remembered about companies, spent on calls, and waiting to be sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.keys import company_key
from postmill.functions.numbers import age_days, local_day


def company_memory(marks: DataFrame, blocked: DataFrame, now: Column, cooldown_days: int, window_days: int, most: int) -> DataFrame:
    """(company_key, n_recent, rejected_at, is_blocked, hides) for every company that is remembered.

    marks: company, state, updated_at; blocked: company. A company hides its postings while it is
    blocked, for cooldown_days after its latest rejection, and while it has most applications or more
    of the last window_days. Blank companies have no memory.
    """
    recent = (F.col("state") == "applied") & age_days(F.col("updated_at"), now).between(0, window_days)
    per = marks.select(company_key(F.col("company")).alias("company_key"), "state", "updated_at").where("company_key != ''").groupBy("company_key").agg(
        F.count_if(recent).alias("n_recent"), F.max(F.when(F.col("state") == "rejected", F.col("updated_at"))).alias("rejected_at")
    )
    keys = blocked.select(company_key(F.col("company")).alias("company_key")).where("company_key != ''").distinct().withColumn("is_blocked", F.lit(True))
    out = per.join(keys, "company_key", "full").select("company_key", F.coalesce("n_recent", F.lit(0)).alias("n_recent"), "rejected_at", F.coalesce("is_blocked", F.lit(False)).alias("is_blocked"))
    cooling = F.coalesce(age_days(F.col("rejected_at"), now).between(0, cooldown_days), F.lit(False))
    return out.withColumn("hides", F.col("is_blocked") | cooling | (F.col("n_recent") >= most))


def not_hidden(rows: DataFrame, memory: DataFrame, company: str = "company") -> DataFrame:
    """rows without those of companies that hide theirs; rows without a company stay."""
    hidden = memory.where("hides").select(F.col("company_key").alias("_k"))
    return rows.withColumn("_k", company_key(F.col(company))).join(hidden, "_k", "left_anti").drop("_k")


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls (model, input, cached, output) with cost, in millionths of what a price's unit is.

    prices: model, input_price, cached_price, output_price, each for a million tokens; cached tokens
    are part of the input. A model without a price costs NULL.
    """
    fresh = F.greatest(F.col("input") - F.col("cached"), F.lit(0))
    cost = fresh * F.col("input_price") + F.col("cached") * F.col("cached_price") + F.col("output") * F.col("output_price")
    return calls.join(prices, "model", "left").withColumn("cost", cost).drop("input_price", "cached_price", "output_price")


def spend_by(calls: DataFrame, at: str, zone: str) -> DataFrame:
    """Calls, tokens and cost in total, per day in a zone, and per model, in one pass; level names which."""
    days = calls.select(local_day(F.col(at), zone).alias("day"), "model", "input", "cached", "output", "cost")
    out = days.groupingSets([[], [F.col("day")], [F.col("model")]], "day", "model").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n_calls"), F.sum("input").alias("input"), F.sum("cached").alias("cached"), F.sum("output").alias("output"), F.sum("cost").alias("cost")
    )
    level = F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "day").otherwise("model")
    share = F.round(F.col("cached") * 100.0 / F.nullif(F.col("input"), F.lit(0)), 3)
    return out.select(level.alias("level"), "day", "model", "n_calls", "input", "cached", "output", "cost", share.alias("cached_share"))


def after_round(outbox: DataFrame, outcome: DataFrame, key: str, rounds: int) -> DataFrame:
    """outbox (key, status, n_attempts) after a round of sending; outcome: key, ok.

    Only pending rows move: to sent, or, if it was their last of so many rounds, to failed.
    """
    tried = outbox.join(outcome, key, "left")
    moves = (F.col("status") == "pending") & F.col("ok").isNotNull()
    n = F.when(moves, F.col("n_attempts") + 1).otherwise(F.col("n_attempts"))
    status = F.when(moves & F.col("ok"), "sent").when(moves & (n >= rounds), "failed").otherwise(F.col("status"))
    return tried.select(key, status.alias("status"), n.cast("int").alias("n_attempts"))
