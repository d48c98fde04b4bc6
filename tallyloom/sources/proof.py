"""Proves that a batch asks what its answer key says it asks.

Each anonymous refund line of a contested, ambiguous or described case is set
beside all refunds of its amount, and what the file shows of them: whether a line
names them, when they were made, whether their payment settled, and what kind of
goods that payment's description is of.  Nothing that the generator knows is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ladder import WINDOW_DAYS, settled_parents
from tallyloom.operators.verdicts import bridge
from tallyloom.sources.batch import Batch
from tallyloom.sources.catalogue import NOTES, categorised

#: Scenarios that are about collisions, with the anonymous lines of a case, least and most.
LINES = {"CONTESTED_REFUND": (1, 1), "AMBIGUOUS_REFUND": (1, None), "DESCRIBED_REFUND": (2, 2)}


class Unproven(ValueError):
    """A batch does not bear out its answer key."""


def candidates(batch: Batch, key: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """(case_id, scenario, detail_id, settlement_id, amount_paise, event_id, survives, named): a row for each line and refund of its amount, one with a null event where there is none.

    survives: the refund passes the gates of consumption, window and lineage;
    named: its payment's goods are of the kind that the line's note is about.
    """
    of = bridge(key.where(F.col("scenario").isin(*LINES))).join(key.select("case_id", "scenario"), "case_id").drop("case_pos")
    lines = batch.detail.where("line_type = 'REFUND' and event_id is null").select("detail_id", "settlement_id", F.abs("gross_effect_paise").alias("amount_paise"), F.to_date("settled_at").alias("settled_on"), "reference_text")
    lines = categorised(lines, "reference_text", NOTES, "about").join(of, "settlement_id")
    payments = categorised(batch.ledger.where("event_type = 'PAYMENT'"), "description", name="goods").groupBy("txn_id").agg(F.min_by("goods", "event_id").alias("goods"))
    taken = batch.detail.select("event_id").where("event_id is not null").distinct().withColumn("taken", F.lit(True))
    refunds = batch.ledger.where("event_type = 'REFUND'").select("event_id", "txn_id", "amount_paise", F.to_date("created_at").alias("created_on"))
    refunds = refunds.join(lines.select("amount_paise").distinct(), "amount_paise", "left_semi").join(taken, "event_id", "left").join(settled_parents(batch).withColumn("parent", F.lit(True)), "txn_id", "left").join(payments, "txn_id", "left")
    pairs = lines.join(refunds, "amount_paise", "left")
    in_time = F.datediff("settled_on", "created_on").between(0, window_days)
    survives = F.col("event_id").isNotNull() & F.col("taken").isNull() & F.col("parent").isNotNull() & in_time
    return pairs.select("case_id", "scenario", "detail_id", "settlement_id", "amount_paise", "event_id", F.coalesce(survives, F.lit(False)).alias("survives"), "about", F.coalesce(F.col("about") == F.col("goods"), F.lit(False)).alias("named"))


def violations(batch: Batch, key: DataFrame, allocations: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """(case_id, rule): what a batch's answer key claims and the batch does not show.

    key: (case_id, scenario, settlement_ids); allocations: (event_id, settlement_id).
    """
    pairs = candidates(batch, key, window_days)
    right = allocations.select("event_id", "settlement_id").distinct()
    here = right.withColumn("here", F.lit(True))
    places = right.join(pairs.where("survives").select("event_id").distinct(), "event_id", "left_semi").groupBy("event_id").agg(F.count("*").alias("n_places"))
    pairs = pairs.join(here, ["event_id", "settlement_id"], "left").join(places, "event_id", "left")
    lone = F.col("survives") & F.when(F.col("scenario") == "DESCRIBED_REFUND", F.col("named")).otherwise(True)
    by_line = pairs.groupBy("case_id", "scenario", "detail_id").agg(
        F.count("event_id").alias("n"),
        F.count_if("survives").alias("n_left"),
        F.count_if(F.col("survives") & F.col("named")).alias("n_named"),
        F.count("about").alias("n_about"),
        F.count_if(lone & F.col("here").isNotNull()).alias("n_answer"),
        F.count_if(lone & (F.col("n_places") > 1)).alias("n_elsewhere"),
        F.count_if(~lone & F.col("here").isNotNull()).alias("n_wrong"),
    )
    s = F.col("scenario")
    contested, ambiguous, described = (s == name for name in LINES)
    one = lambda when, rule: F.when(when, rule)
    rules = F.array(
        one(contested & ~F.col("n").between(2, 4), "a contested line has 2 to 4 refunds of its amount"),
        one(contested & (F.col("n_left") != 1), "a contested line has one refund left"),
        one(contested & ((F.col("n_answer") != 1) | (F.col("n_elsewhere") > 0)), "a contested line's refund is allocated to its settlement alone"),
        one(((contested & (F.col("n_left") == 1)) | (described & (F.col("n_named") == 1))) & (F.col("n_wrong") > 0), "no other refund is allocated to the line's settlement"),
        one(~contested & (F.col("n_left") < 2), "an ambiguous or described line has two refunds left or more"),
        one(~contested & (F.col("n_about") == 0), "an ambiguous or described line's note is about a kind of goods"),
        one(ambiguous & (F.col("n_named") != F.col("n_left")), "an ambiguous line's note names all refunds left"),
        one(described & (F.col("n_named") != 1), "a described line's note names one refund left"),
        one(described & (F.col("n_named") == 1) & (F.col("n_answer") != 1), "a described line's refund is allocated to its settlement"),
    )
    found = by_line.select("case_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
    lines = pairs.groupBy("case_id").agg(F.countDistinct("detail_id").alias("n_lines"))
    of_case = key.where(s.isin(*LINES)).select("case_id", "scenario").join(lines, "case_id", "left").fillna(0, ["n_lines"])
    short = F.lit(False)
    for name, (least, most) in LINES.items():
        short = short | ((s == name) & ((F.col("n_lines") < least) | (F.col("n_lines") > (most or 1 << 60))))
    shared = pairs.groupBy("amount_paise").agg(F.countDistinct("scenario").alias("k")).where("k > 1").select("amount_paise")
    met = pairs.join(shared, "amount_paise", "left_semi").select("case_id").distinct()
    return found.unionByName(of_case.where(short).select("case_id", F.lit("a case has its number of anonymous lines").alias("rule"))).unionByName(met.select("case_id", F.lit("amounts of contested, ambiguous and described cases are apart").alias("rule")))


def proven(batch: Batch, key: DataFrame, allocations: DataFrame, window_days: int = WINDOW_DAYS) -> None:
    """Refuses a batch that breaks a rule, naming up to five cases."""
    if bad := violations(batch, key, allocations, window_days).orderBy("case_id", "rule").limit(5).collect():
        raise Unproven("; ".join(f"{r.case_id}: {r.rule}" for r in bad))
