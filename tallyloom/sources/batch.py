"""The reconciliation inputs: strict CSV scans, validation and the batch of named tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyloom.functions import scalars as S

# The files' columns.
LEDGER = ("event_id", "event_type", "txn_id", "order_id", "amount_paise", "currency", "status", "created_at", "method")
DETAIL = ("detail_id", "settlement_id", "event_id", "line_type", "gross_effect_paise", "fee_paise", "tax_paise", "net_effect_paise", "settled_at", "currency", "reference_text")
SUMMARY = ("settlement_id", "utr", "settlement_date", "gross_payment_paise", "refund_paise", "fee_paise", "tax_paise", "net_amount_paise", "line_count", "currency", "status")
BANK = ("bank_row_id", "utr", "posted_at", "credit_amount_paise", "currency")
PRICING = ("method", "fee_rate_bps", "gst_rate_bps")
CASES = ("case_id", "settlement_ids", "bank_row_ids", "event_ids")


class InvalidInput(ValueError):
    """A file breaks a rule; the message names up to five rows."""


@dataclass(frozen=True)
class Batch:
    """ledger, detail (unique by detail_id), duplicates (settlement_id, n_duplicates), summary, bank, pricing."""

    ledger: DataFrame
    detail: DataFrame
    duplicates: DataFrame
    summary: DataFrame
    bank: DataFrame
    pricing: DataFrame


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """All cells as strings by header name, with input_order, the order of rows in the file.

    The order follows the file's blocks, so lines may not span rows.
    """
    df = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    if lacking := [c for c in required if c not in df.columns]:
        raise InvalidInput(f"{path}: missing columns {', '.join(lacking)}")
    return df.select("*", F.monotonically_increasing_id().alias("input_order"))


def check(df: DataFrame, where: str, key: str, **rules: Column) -> DataFrame:
    """df, once no row breaks a rule; each rule holds for good rows."""
    bad = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    broken = df.select(F.col(key).alias("key"), F.filter(F.array(*bad), lambda x: x.isNotNull()).alias("rules")).where(F.size("rules") > 0).limit(5).collect()
    if broken:
        raise InvalidInput("; ".join(f"{where}:{r.key}: {', '.join(r.rules)}" for r in broken))
    return df


def _unique(df: DataFrame, where: str, key: str) -> None:
    if twice := df.groupBy(key).count().where("count > 1").limit(5).collect():
        raise InvalidInput(f"{where}: duplicate {key} {', '.join(str(r[0]) for r in twice)}")


def _filled(*names: str) -> dict[str, Column]:
    return {f"{n} is blank": F.length(S.strip(F.col(n))) > 0 for n in names}


def load_events(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, LEDGER)
    check(raw, path, "event_id", **_filled(*LEDGER), **{"amount is not positive money": S.money(F.col("amount_paise")) > 0, "unknown event_type": F.col("event_type").isin("PAYMENT", "REFUND"), "unknown status": F.col("status").isin(*S.SETTLEABLE, *S.NEVER_SETTLES), "bad created_at": S.is_timestamp(F.col("created_at"))})
    _unique(raw, path, "event_id")
    if raw.isEmpty():
        raise InvalidInput(f"{path}: no events")
    text = S.optional_text(F.col("description")) if "description" in raw.columns else F.lit(None).cast("string")
    return raw.select(*(S.strip(F.col(c)).alias(c) for c in ("event_id", "event_type", "txn_id", "order_id")), S.money(F.col("amount_paise")).alias("amount_paise"), "currency", "status", S.timestamp(F.col("created_at")).alias("created_at"), "method", text.alias("description"), "input_order")


def keep_first(detail: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unique lines by detail_id, the first in the file, and how many repeats each settlement's rows have."""
    return told_apart(numbered(detail))


def numbered(detail: DataFrame) -> DataFrame:
    """detail with nth, a row's place among those of its detail_id in the file."""
    return detail.withColumn("nth", F.row_number().over(W.partitionBy("detail_id").orderBy("input_order")))


def told_apart(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keep_first of lines that are numbered already."""
    again = ranked.where("nth > 1").groupBy("settlement_id").agg(F.count("*").alias("n_duplicates"))
    return ranked.where("nth = 1").drop("nth"), again


def load_details(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    raw = read_csv(spark, path, DETAIL)
    paise = ("gross_effect_paise", "fee_paise", "tax_paise", "net_effect_paise")
    first, again = keep_first(raw)
    gross = S.money(F.col("gross_effect_paise"))
    check(first, path, "detail_id", **_filled("detail_id", "settlement_id", "line_type", "currency"), **{f"{c} is not money": S.is_money(F.col(c)) for c in paise}, **{"unknown line_type": F.col("line_type").isin("PAYMENT", "REFUND"), "sign": F.when(F.col("line_type") == "PAYMENT", gross > 0).otherwise(gross < 0), "bad settled_at": S.is_timestamp(F.col("settled_at"))})
    typed = first.select("detail_id", "settlement_id", S.optional_text(F.col("event_id")).alias("event_id"), "line_type", *(S.money(F.col(c)).alias(c) for c in paise), S.timestamp(F.col("settled_at")).alias("settled_at"), "currency", S.optional_text(F.col("reference_text")).alias("reference_text"), "input_order")
    return typed, again


def load_settlements(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, SUMMARY)
    paise = [c for c in SUMMARY if c.endswith("_paise")]
    check(raw, path, "settlement_id", **_filled("settlement_id", "utr"), **{f"{c} is not money": S.is_money(F.col(c)) for c in paise}, **{"bad settlement_date": F.try_to_date(F.col("settlement_date")).isNotNull(), "bad line_count": F.col("line_count").try_cast("int").isNotNull()})
    _unique(raw, path, "settlement_id")
    return raw.select("settlement_id", "utr", F.to_date("settlement_date").alias("settlement_date"), *(S.money(F.col(c)).alias(c) for c in paise), F.col("line_count").cast("int").alias("line_count"), "currency", "status")


def load_bank(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, BANK)
    check(raw, path, "bank_row_id", **_filled("bank_row_id", "utr"), **{"credit is not money": S.is_money(F.col("credit_amount_paise")), "bad posted_at": S.is_timestamp(F.col("posted_at"))})
    _unique(raw, path, "bank_row_id")
    return raw.select("bank_row_id", "utr", S.timestamp(F.col("posted_at")).alias("posted_at"), S.money(F.col("credit_amount_paise")).alias("credit_amount_paise"), "currency")


def load_pricing(spark: SparkSession, path: str) -> DataFrame:
    """The last rule of a method holds."""
    raw = read_csv(spark, path, PRICING)
    if raw.isEmpty():
        raise InvalidInput(f"{path}: no pricing rules")
    return raw.groupBy("method").agg(F.max_by("fee_rate_bps", "input_order").cast("int").alias("fee_rate_bps"), F.max_by("gst_rate_bps", "input_order").cast("int").alias("gst_rate_bps"))


def load_caseload(spark: SparkSession, path: str) -> DataFrame:
    """Cases by the four id columns; the answers beside them are never read."""
    raw = read_csv(spark, path, CASES).select(*CASES)
    check(raw, path, "case_id", **_filled("case_id"))
    _unique(raw, path, "case_id")
    if raw.isEmpty():
        raise InvalidInput(f"{path}: no cases")
    return raw.select("case_id", *(S.split_ids(F.col(c)).alias(c) for c in CASES[1:]))


def load_batch(spark: SparkSession, directory: str) -> Batch:
    at = lambda name: f"{directory}/{name}.csv"
    detail, again = load_details(spark, at("settlement_detail"))
    return Batch(load_events(spark, at("gateway_ledger")), detail, again, load_settlements(spark, at("settlement_summary")), load_bank(spark, at("bank_statement")), load_pricing(spark, at("pricing_rules")))


def load_raw(spark: SparkSession, directory: str) -> Batch:
    """The batch as a baseline reads it: nothing is validated, cells that are no numbers are null, and repeats are dropped within a settlement only."""
    read = lambda name, columns: read_csv(spark, f"{directory}/{name}.csv", columns)
    money = lambda *names: {c: S.money(F.col(c)) for c in names}
    text = lambda *names: {c: S.optional_text(F.col(c)) for c in names}
    ledger = read("gateway_ledger", LEDGER).withColumns(money("amount_paise") | {"created_at": S.timestamp(F.col("created_at"))})
    ledger = ledger if "description" in ledger.columns else ledger.withColumn("description", F.lit(None).cast("string"))
    detail = read("settlement_detail", DETAIL).withColumns(money("gross_effect_paise", "fee_paise", "tax_paise", "net_effect_paise") | text("event_id", "reference_text") | {"settled_at": S.timestamp(F.col("settled_at"))})
    nth = detail.withColumn("nth", F.row_number().over(W.partitionBy("settlement_id", "detail_id").orderBy("input_order")))
    again = nth.where("nth > 1").groupBy("settlement_id").agg(F.count("*").alias("n_duplicates"))
    summary = read("settlement_summary", SUMMARY).withColumns(money("gross_payment_paise", "refund_paise", "fee_paise", "tax_paise", "net_amount_paise"))
    bank = read("bank_statement", BANK).withColumns(money("credit_amount_paise"))
    return Batch(ledger.withColumn("description", S.optional_text(F.col("description"))), nth.where("nth = 1").drop("nth"), again, summary, bank, load_pricing(spark, f"{directory}/pricing_rules.csv"))


def load_answer_key(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """(cases, allocations) to score against; allocations are distinct pairs."""
    cases = read_csv(spark, f"{directory}/answer_key_cases.csv", ("case_id", "scenario", "expected_outcome", "settlement_ids", "expected_exception_category"))
    category = S.optional_text(F.col("expected_exception_category"))
    check(cases, "answer_key_cases", "case_id", **{"unknown outcome": F.col("expected_outcome").isin("RECONCILED", "EXCEPTION", "NO_ACTION", "ABSTAIN"), "exception without category": (F.col("expected_outcome") != "EXCEPTION") | category.isNotNull()})
    _unique(cases, "answer_key_cases", "case_id")
    pairs = read_csv(spark, f"{directory}/answer_key_allocations.csv", ("event_id", "settlement_id")).select("event_id", "settlement_id").distinct()
    return cases.select("case_id", "scenario", "expected_outcome", category.alias("expected_category"), S.split_ids(F.col("settlement_ids")).alias("settlement_ids")), pairs


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
