"""One outcome for each case, and the operators' queue of those that need work."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyloom.functions import scalars as S
from tallyloom.operators import controls
from tallyloom.operators.ladder import DEFAULT, LadderRun, run_ladder
from tallyloom.sources.batch import Batch, load_batch, load_caseload

# What to do about each category.
ACTIONS = {
    "AMBIGUOUS_REFUND": "Ask the gateway which of the listed refunds the line settles.",
    "BANK_AMOUNT_MISMATCH": "Raise the difference with the bank.",
    "BANK_CREDIT_DUPLICATE": "Arrange the return of the surplus credit.",
    "BANK_CREDIT_MISSING": "Chase the credit by its UTR.",
    "CAPTURED_UNSETTLED": "Ask the gateway when these events settle.",
    "FEE_TAX_VARIANCE": "Dispute the fee or tax against the rate card.",
    "LINE_EQUATION_VIOLATION": "Ask for a corrected settlement export.",
    "ROLLUP_MISMATCH": "Ask for the lines behind the declared totals.",
    "SETTLEMENT_MISSING": "Ask for the settlement summary.",
    "SUMMARY_EQUATION_VIOLATION": "Ask for a corrected settlement summary.",
    "UNATTRIBUTED_SETTLEMENT_LINE": "Ask which event the line settles.",
    "UNKNOWN_EVENT_REFERENCE": "Ask for the event that the line names.",
    "UNKNOWN_METHOD": "Add the method to the pricing rules.",
}
FALLBACK = "Look into the evidence."


def unsettled(cases: DataFrame, ledger: DataFrame) -> DataFrame:
    """Cases without settlements: NO_ACTION if their known events never settle, else CAPTURED_UNSETTLED over what could."""
    own = cases.where(F.size("settlement_ids") == 0).select("case_id", F.explode_outer("event_ids").alias("event_id")).join(ledger.select("event_id", "status", "amount_paise"), "event_id", "left")
    can = S.settleable(F.col("status"))
    got = own.groupBy("case_id").agg(F.count("status").alias("known"), F.count_if(can).alias("open"), F.coalesce(F.sum(F.when(can, F.col("amount_paise"))), F.lit(0)).alias("exposure_paise"))
    idle = (F.col("known") > 0) & (F.col("open") == 0)
    return got.select("case_id", F.when(idle, "NO_ACTION").otherwise("EXCEPTION").alias("outcome"), F.when(~idle, "CAPTURED_UNSETTLED").alias("category"), F.lit(1.0).alias("confidence"), F.when(idle, 0).otherwise(F.col("exposure_paise")).cast("long").alias("exposure_paise"), F.array().cast("array<string>").alias("evidence"))


def bridge(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", F.posexplode("settlement_ids").alias("case_pos", "settlement_id"))


def verdicts(batch: Batch, cases: DataFrame, run: LadderRun, found: DataFrame | None = None) -> DataFrame:
    """(case_id, outcome, category, confidence, exposure_paise, evidence): abstention before exception before reconciliation.

    found: controls.all_findings of the cases' settlements, where they are at hand.
    """
    of = bridge(cases)
    # a line of the exact join names its event, so that no attribution of it is missed
    explained = run.accepted.where("not pass_name <=> 'exact_join'")
    findings = controls.settlement_findings(batch, of, explained) if found is None else controls.unexplained(found, explained)
    findings = findings.join(of, "settlement_id")
    hard = F.col("category") != controls.WARNING
    place = F.struct("case_pos", "block", "line_pos", "check_pos")
    found = findings.groupBy("case_id").agg(
        F.count_if(hard).alias("n_hard"),
        F.min_by(F.when(hard, F.col("category")), F.when(hard, place)).alias("first_hard"),
        F.sum(F.when(hard, F.col("exposure_paise"))).alias("hard_paise"),
        F.max(~hard).alias("warned"),
        F.transform(F.array_sort(F.collect_list(F.struct("case_pos", "block", "line_pos", "check_pos", F.concat_ws(": ", "category", "detail").alias("text")))), lambda x: x["text"]).alias("evidence"),
    )
    lines = batch.detail.select("detail_id", F.abs("net_effect_paise").alias("line_paise"))
    held = run.abstentions.join(lines, "detail_id", "left").join(of, "settlement_id").groupBy("case_id").agg(F.count("*").alias("n_held"), F.sum("line_paise").alias("held_paise"), F.array_sort(F.collect_list("reason")).alias("reasons"))
    sure = run.accepted.groupBy("settlement_id").agg(F.min("confidence").alias("confidence")).join(of, "settlement_id").groupBy("case_id").agg(F.min("confidence").alias("least"))
    rows = cases.where(F.size("settlement_ids") > 0).select("case_id").join(found, "case_id", "left").join(held, "case_id", "left").join(sure, "case_id", "left")
    outcome = F.when(F.col("n_held") > 0, "ABSTAIN").when(F.col("n_hard") > 0, "EXCEPTION").otherwise("RECONCILED")
    pick = lambda a, b, c: F.when(F.col("n_held") > 0, a).when(F.col("n_hard") > 0, b).otherwise(c)
    settled = rows.select(
        "case_id",
        outcome.alias("outcome"),
        pick(F.lit("AMBIGUOUS_REFUND"), F.col("first_hard"), F.when(F.col("warned"), controls.WARNING)).alias("category"),
        pick(F.lit(0.0), F.coalesce("least", F.lit(1.0)), F.coalesce("least", F.lit(1.0))).alias("confidence"),
        pick(F.col("held_paise"), F.col("hard_paise"), F.lit(0)).cast("long").alias("exposure_paise"),
        F.concat(F.coalesce("reasons", F.array().cast("array<string>")), F.coalesce("evidence", F.array().cast("array<string>"))).alias("evidence"),
    )
    return settled.unionByName(unsettled(cases, batch.ledger))


def allocations(cases: DataFrame, run: LadderRun) -> DataFrame:
    """(case_id, event_id, settlement_id): accepted claims of each case; one shared by two cases appears in both."""
    return bridge(cases).join(run.accepted, "settlement_id").select("case_id", "event_id", "settlement_id").distinct()


@dataclass(frozen=True)
class Reconciliation:
    batch: Batch
    cases: DataFrame
    run: LadderRun
    verdicts: DataFrame
    allocations: DataFrame


def reconcile(spark: SparkSession, directory: str, ladder=DEFAULT, residual=None) -> Reconciliation:
    """Loads a directory of CSV files and decides every case."""
    batch, cases = load_batch(spark, directory), load_caseload(spark, f"{directory}/answer_key_cases.csv")
    run = run_ladder(batch, ladder, residual)
    return Reconciliation(batch, cases, run, verdicts(batch, cases, run), allocations(cases, run))


def record_count(batch: Batch) -> int:
    """Events, unique lines and settlements of a batch, by which its throughput is told."""
    return sum(df.count() for df in (batch.ledger, batch.detail, batch.summary))


def queue(decided: DataFrame, cases: DataFrame) -> DataFrame:
    """Exceptions and abstentions with the action to take, largest exposure first by `rank_key`."""
    open_ = decided.where(F.col("outcome").isin("EXCEPTION", "ABSTAIN")).join(cases, "case_id", "left")
    return open_.select(
        "case_id", "outcome", F.coalesce("category", F.lit("UNCLASSIFIED")).alias("category"), "exposure_paise", S.rupees(F.col("exposure_paise")).alias("exposure_rupees"), "confidence",
        S.lookup(F.col("category"), ACTIONS, FALLBACK).alias("action"), S.join_ids(F.col("settlement_ids")).alias("settlement_ids"), S.join_ids(F.col("event_ids")).alias("event_ids"), F.array_join("evidence", "; ").alias("evidence"),
    ).withColumn("rank_key", F.struct((-F.col("exposure_paise")).alias("largest"), "case_id"))


def ranked(open_queue: DataFrame) -> DataFrame:
    return open_queue.orderBy("rank_key").drop("rank_key")


def by_category(open_queue: DataFrame) -> DataFrame:
    return open_queue.groupBy("category").agg(F.count("*").alias("n_cases"), F.sum("exposure_paise").alias("exposure_paise"))


def write_queue(open_queue: DataFrame, path: str) -> None:
    """One CSV part with a header; every cell is text that no spreadsheet runs."""
    rows = ranked(open_queue)
    rows.select(*(S.inert(F.col(c).cast("string")).alias(c) for c in rows.columns)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def top(open_queue: DataFrame, k: int) -> DataFrame:
    return ranked(open_queue).limit(k)


def rank_number(open_queue: DataFrame) -> DataFrame:
    """Place of each case within its outcome, for reports."""
    return open_queue.withColumn("place", F.row_number().over(W.partitionBy("outcome").orderBy("rank_key"))).drop("rank_key")
