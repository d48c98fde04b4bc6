"""Scores of decided cases against an answer key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import ratio


def judged(key: DataFrame, decided: DataFrame, expected: DataFrame, allocated: DataFrame) -> DataFrame:
    """A row for each case of the key: what was decided, and how its distinct (event, settlement) pairs compare.

    A case without a decision counts as ABSTAIN without pairs.
    """
    pair = ["case_id", "event_id", "settlement_id"]
    both = expected.select(*pair).distinct().withColumn("want", F.lit(1)).join(allocated.select(*pair).distinct().withColumn("have", F.lit(1)), pair, "full")
    counts = both.groupBy("case_id").agg(F.count_if(F.col("want").isNotNull() & F.col("have").isNotNull()).alias("tp"), F.count_if(F.col("want").isNull()).alias("fp"), F.count_if(F.col("have").isNull()).alias("fn"))
    rows = key.join(decided.select("case_id", "outcome", "category", "confidence"), "case_id", "left").join(counts, "case_id", "left").fillna(0, ["tp", "fp", "fn"]).fillna({"outcome": "ABSTAIN", "confidence": 0.0})
    return rows.withColumn("correct", (F.col("outcome") == F.col("expected_outcome")) & (F.col("fp") == 0) & (F.col("fn") == 0)).withColumn("correct_lax", (F.col("outcome") == F.col("expected_outcome")) & (F.col("fp") == 0))


def allocation_scores(rows: DataFrame) -> DataFrame:
    s = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("false_match", ratio(F.col("fp"), F.col("tp") + F.col("fp")))


def by_scenario(rows: DataFrame) -> DataFrame:
    return rows.groupBy("scenario").agg(F.count("*").alias("n_cases"), F.count_if("correct").alias("n_correct"), F.count_if("correct_lax").alias("n_correct_lax"))


def one_vs_rest(rows: DataFrame) -> DataFrame:
    """Precision and recall of each category, expected or predicted."""
    want = rows.where("expected_category is not null").select(F.col("expected_category").alias("label"), F.lit(1).alias("support"), F.lit(0).alias("predicted"), F.coalesce(F.col("category") == F.col("expected_category"), F.lit(False)).cast("int").alias("tp"))
    have = rows.where("category is not null").select(F.col("category").alias("label"), F.lit(0).alias("support"), F.lit(1).alias("predicted"), F.lit(0).alias("tp"))
    s = want.unionByName(have).groupBy("label").agg(*(F.sum(c).alias(c) for c in ("support", "predicted", "tp")))
    return s.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))


def confusion(rows: DataFrame) -> DataFrame:
    """Expected exceptions by what was reported; other outcomes under their own name."""
    said = F.when(F.col("outcome") == "EXCEPTION", F.col("category")).otherwise(F.col("outcome"))
    return rows.where("expected_outcome = 'EXCEPTION'").groupBy(F.col("expected_category").alias("expected"), said.alias("reported")).agg(F.count("*").alias("n"))


def abstentions(rows: DataFrame) -> DataFrame:
    held = F.col("outcome") == "ABSTAIN"
    return rows.agg(F.count_if(held).alias("n_abstained"), F.count_if(held & (F.col("expected_outcome") == "ABSTAIN")).alias("n_right"), F.count_if(held & (F.col("expected_outcome") != "ABSTAIN")).alias("n_missed"))


def idle_false_positives(rows: DataFrame) -> DataFrame:
    idle = F.col("expected_outcome") == "NO_ACTION"
    s = rows.agg(F.count_if(idle).alias("support"), F.count_if(idle & (F.col("outcome") == "EXCEPTION")).alias("n_false"))
    return s.withColumn("rate", ratio(F.col("n_false"), F.col("support")))


def curve(rows: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Coverage and precision of the decisions kept at each confidence threshold."""
    s = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    keep = (F.col("confidence") >= F.col("threshold")) & (F.col("outcome") != "ABSTAIN")
    s = s.groupBy("threshold").agg(F.count("*").alias("n_cases"), F.count_if(keep).alias("n_kept"), F.count_if(keep & F.col("correct")).alias("n_right"), F.sum(F.when(keep, F.col("fp")).otherwise(0)).alias("fp"), F.sum(F.when(keep, F.col("tp") + F.col("fp")).otherwise(0)).alias("claimed"))
    return s.select("threshold", "n_kept", ratio(F.col("n_kept"), F.col("n_cases")).alias("coverage"), ratio(F.col("n_right"), F.col("n_kept")).alias("precision"), ratio(F.col("fp"), F.col("claimed")).alias("false_match"))
