"""How many refunds could explain what a settlement's named lines leave of its declared refunds.

A settlement's delta is its declared refunds less its named refund lines.  Its
candidates are the refunds of exactly that amount; the gates keep those that no
line names, made up to window_days before the settlement's date, of a transaction
with a processed payment that a line names.  What the gates take away shows
whether they do any work.

Candidates are counted, by amount and day, and never listed, so a popular amount
costs as many rows as it has days.  Settlements that are fully explained, and
those with no declared sum or date, have no delta.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators.ladder import WINDOW_DAYS, settled_parents
from tallyloom.sources.batch import DETAIL, LEDGER, SUMMARY, Batch, keep_first, read_csv


def load(spark: SparkSession, directory: str) -> Batch:
    """Ledger, lines and totals of a directory as they stand: nothing is validated, and a line is the first of its detail_id in the file."""
    read = lambda name, columns, *money: read_csv(spark, f"{directory}/{name}.csv", columns).withColumns({c: S.money(F.col(c)) for c in money})
    ledger = read("gateway_ledger", LEDGER, "amount_paise").withColumn("created_at", S.timestamp(F.col("created_at")))
    detail, again = keep_first(read("settlement_detail", DETAIL, "gross_effect_paise").withColumn("event_id", S.optional_text(F.col("event_id"))))
    summary = read("settlement_summary", SUMMARY, "refund_paise").withColumn("settlement_date", F.try_to_date("settlement_date"))
    none = spark.createDataFrame([], "utr string")
    return Batch(ledger, detail, again, summary, none, none)


def deltas(batch: Batch) -> DataFrame:
    """(settlement_id, settlement_date, declared_paise, named_paise, delta_paise) of settlements whose named lines leave some refund unexplained."""
    named = batch.detail.where("line_type = 'REFUND' and event_id is not null").groupBy("settlement_id").agg((-F.sum("gross_effect_paise")).alias("named_paise"))
    each = batch.summary.select("settlement_id", "settlement_date", F.col("refund_paise").alias("declared_paise")).join(named, "settlement_id", "left").fillna(0, ["named_paise"])
    return each.withColumn("delta_paise", F.col("declared_paise") - F.col("named_paise")).where("delta_paise > 0")


def candidates(batch: Batch, window_days: int = WINDOW_DAYS) -> DataFrame:
    """(settlement_id, delta_paise, n_amount, n_gated): refunds of the delta's amount, before and after the gates."""
    found = deltas(batch).select("settlement_id", "settlement_date", F.col("delta_paise"))
    refunds = batch.ledger.where("event_type = 'REFUND'").select("event_id", "txn_id", F.col("amount_paise").alias("delta_paise"), F.to_date("created_at").alias("day")).join(found.select("delta_paise").distinct(), "delta_paise", "left_semi")
    by_amount = refunds.groupBy("delta_paise").agg(F.count("*").alias("n_amount"))
    named = batch.detail.select("event_id").where("event_id is not null").distinct()
    free = refunds.join(named, "event_id", "left_anti").join(settled_parents(batch), "txn_id", "left_semi")
    by_day = free.groupBy("delta_paise", "day").agg(F.count("*").alias("n"))
    days = found.where("settlement_date is not null").select("settlement_id", "delta_paise", F.explode(F.sequence(F.date_sub("settlement_date", window_days), F.to_date("settlement_date"))).alias("day"))
    gated = days.join(by_day, ["delta_paise", "day"]).groupBy("settlement_id").agg(F.sum("n").alias("n_gated"))
    out = found.join(by_amount, "delta_paise", "left").join(gated, "settlement_id", "left").fillna(0, ["n_amount", "n_gated"])
    return out.select("settlement_id", "delta_paise", "n_amount", "n_gated")


def histogram(counted: DataFrame) -> DataFrame:
    """(stage, k, n_settlements): how many deltas have k candidates by amount alone, and after the gates."""
    both = F.array(F.struct(F.lit("amount").alias("stage"), F.col("n_amount").alias("k")), F.struct(F.lit("gates").alias("stage"), F.col("n_gated").alias("k")))
    return counted.select(F.explode(both).alias("x")).groupBy("x.stage", "x.k").agg(F.count("*").alias("n_settlements"))


def rates(counted: DataFrame) -> DataFrame:
    """One row: deltas examined, those with several candidates and their share, by amount and after the gates, and how many candidates the gates took."""
    s = counted.agg(F.count("*").alias("examined"), F.count_if(F.col("n_amount") > 1).alias("amount_ambiguous"), F.count_if(F.col("n_gated") > 1).alias("ambiguous"), F.coalesce(F.sum(F.col("n_amount") - F.col("n_gated")), F.lit(0)).alias("eliminated"))
    return s.select("examined", "amount_ambiguous", S.ratio(F.col("amount_ambiguous"), F.col("examined")).alias("amount_rate"), "ambiguous", S.ratio(F.col("ambiguous"), F.col("examined")).alias("rate"), "eliminated")
