"""Control findings: every broken accounting identity of a settlement, in a fixed order.

A finding has a block (its place among the settlement's checks), the line's
input order and a check number within the line; the first hard finding names a
case's category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import round_half_up
from tallyloom.sources.batch import Batch

# Categories of findings.
WARNING = "DUPLICATE_DETAIL_EXPORT_WARNING"
BREAKS = ("ROLLUP_MISMATCH", "SUMMARY_EQUATION_VIOLATION", "LINE_EQUATION_VIOLATION", "SETTLEMENT_MISSING")

FINDING = "block int, line_pos bigint, check_pos int, category string, detail string, exposure_paise bigint"


def _finding(block: int, line: Column, check: int, category: str, detail: Column, exposure: Column) -> Column:
    return F.struct(F.lit(block).alias("block"), line.cast("long").alias("line_pos"), F.lit(check).alias("check_pos"), F.lit(category).alias("category"), detail.alias("detail"), exposure.cast("long").alias("exposure_paise"))


def _text(template: str, *cols: str) -> Column:
    return F.format_string(template, *(F.col(c) for c in cols))


def rollup(detail: DataFrame) -> DataFrame:
    """Sums over a settlement's unique lines; refunds as positive amounts."""
    pay = F.col("line_type") == "PAYMENT"
    return detail.groupBy("settlement_id").agg(
        F.sum(F.when(pay, F.col("gross_effect_paise")).otherwise(0)).alias("r_gross"),
        F.sum(F.when(~pay, -F.col("gross_effect_paise")).otherwise(0)).alias("r_refund"),
        F.sum("fee_paise").alias("r_fee"),
        F.sum("tax_paise").alias("r_tax"),
        F.sum("net_effect_paise").alias("r_net"),
    )


def line_findings(batch: Batch, attributed: DataFrame | None = None, named: bool = False) -> DataFrame:
    """Findings of single lines; attributed: detail_ids that the ladder has explained; named: all findings, with their line's detail_id."""
    known = batch.ledger.select(F.col("event_id"), F.col("method"), F.lit(True).alias("in_ledger"))
    lines = batch.detail.join(known, "event_id", "left").join(batch.pricing, "method", "left")
    want_fee = round_half_up(F.col("gross_effect_paise") * F.col("fee_rate_bps"), 10_000)
    lines = lines.withColumn("want_fee", want_fee).withColumn("want_tax", round_half_up(F.col("want_fee") * F.col("gst_rate_bps"), 10_000))
    off = F.col("net_effect_paise") - (F.col("gross_effect_paise") - F.col("fee_paise") - F.col("tax_paise"))
    anonymous, order = F.col("event_id").isNull(), F.col("input_order")
    priced = F.col("in_ledger") & (F.col("line_type") == "PAYMENT")
    one = lambda when, *f: F.when(when, _finding(1, order, *f))
    checks = F.array(
        one(off != 0, 1, "LINE_EQUATION_VIOLATION", _text("%s: net %d != gross %d - fee %d - tax %d", "detail_id", "net_effect_paise", "gross_effect_paise", "fee_paise", "tax_paise"), F.abs(off)),
        one(anonymous, 2, "UNATTRIBUTED_SETTLEMENT_LINE", _text("%s: %s line carries no event_id", "detail_id", "line_type"), F.abs("net_effect_paise")),
        one(~anonymous & F.col("in_ledger").isNull(), 3, "UNKNOWN_EVENT_REFERENCE", _text("%s: event_id %s is not in the ledger", "detail_id", "event_id"), F.abs("net_effect_paise")),
        one(priced & F.col("fee_rate_bps").isNull(), 4, "UNKNOWN_METHOD", _text("%s: method %s is not in pricing rules", "detail_id", "method"), F.abs(F.col("fee_paise") + F.col("tax_paise"))),
        F.when(
            priced & F.col("fee_rate_bps").isNotNull(),
            F.when(F.col("fee_paise") != F.col("want_fee"), _finding(1, order, 5, "FEE_TAX_VARIANCE", _text("%s: fee %d != expected %d", "detail_id", "fee_paise", "want_fee"), F.abs(F.col("fee_paise") - F.col("want_fee")))).when(
                F.col("tax_paise") != F.col("want_tax"), _finding(1, order, 5, "FEE_TAX_VARIANCE", _text("%s: tax %d != expected %d", "detail_id", "tax_paise", "want_tax"), F.abs(F.col("tax_paise") - F.col("want_tax")))
            ),
        ),
    )
    found = lines.select("settlement_id", "detail_id", F.explode(F.filter(checks, lambda f: f.isNotNull())).alias("f")).select("settlement_id", "detail_id", "f.*")
    return found if named else unexplained(found, attributed)


def unexplained(found: DataFrame, attributed: DataFrame | None) -> DataFrame:
    """Findings without the detail_id of their lines, less those that an attribution explains; they meet the explained lines, not all lines, and only a missing attribution can be explained."""
    if attributed is None:
        return found.drop("detail_id")
    explained = attributed.select(F.col("detail_id").alias("explained")).distinct()
    return found.join(explained, (F.col("detail_id") == F.col("explained")) & (F.col("category") == "UNATTRIBUTED_SETTLEMENT_LINE"), "left_anti").drop("detail_id")


def credits(bank: DataFrame) -> DataFrame:
    """Count and sum of credits by utr; ids are kept for the few that repeat."""
    return bank.groupBy("utr").agg(F.count("*").alias("n_credits"), F.sum("credit_amount_paise").alias("credited"), F.array_sort(F.collect_list("bank_row_id")).alias("bank_row_ids"))


def summary_findings(batch: Batch) -> DataFrame:
    """Findings of the declared totals, the bank side and duplicate exports."""
    zero = ("r_gross", "r_refund", "r_fee", "r_tax", "r_net")
    s = batch.summary.join(rollup(batch.detail), "settlement_id", "left").join(credits(batch.bank), "utr", "left").join(batch.duplicates, "settlement_id", "left")
    s = s.fillna(0, [*zero, "n_credits", "credited", "n_duplicates"])
    net, none = F.col("net_amount_paise"), F.lit(0)
    control = F.col("gross_payment_paise") - F.col("refund_paise") - F.col("fee_paise") - F.col("tax_paise")
    pairs = (("gross_payment", "gross_payment_paise", "r_gross"), ("refund", "refund_paise", "r_refund"), ("fee", "fee_paise", "r_fee"), ("tax", "tax_paise", "r_tax"))
    checks = [F.when(F.col(a) != F.col(b), _finding(2, none, k, "ROLLUP_MISMATCH", _text(f"{label} %d != unique-line roll-up %d", a, b), F.abs(F.col(a) - F.col(b)))) for k, (label, a, b) in enumerate(pairs)]
    s = s.withColumn("control", control)
    checks += [
        F.when(net != F.col("control"), _finding(3, none, 0, "SUMMARY_EQUATION_VIOLATION", _text("net %d != gross - refund - fee - tax = %d", "net_amount_paise", "control"), F.abs(net - F.col("control")))),
        F.when(net != F.col("r_net"), _finding(4, none, 0, "ROLLUP_MISMATCH", _text("net %d != unique-line roll-up %d", "net_amount_paise", "r_net"), F.abs(net - F.col("r_net")))),
        F.when(F.col("n_credits") == 0, _finding(5, none, 0, "BANK_CREDIT_MISSING", _text("no bank row for utr %s", "utr"), F.abs(net)))
        .when(F.col("n_credits") > 1, _finding(5, none, 0, "BANK_CREDIT_DUPLICATE", F.concat(_text("utr %s credited %d times (", "utr", "n_credits"), F.array_join("bank_row_ids", ", "), F.lit(")")), F.abs(F.col("credited") - net)))
        .when(F.col("credited") != net, _finding(5, none, 0, "BANK_AMOUNT_MISMATCH", _text("credit %d != settlement net %d", "credited", "net_amount_paise"), F.abs(F.col("credited") - net))),
        F.when(F.col("n_duplicates") > 0, _finding(6, none, 0, WARNING, _text("%d duplicate detail_id row(s) ignored", "n_duplicates"), none)),
    ]
    return s.select("settlement_id", F.explode(F.filter(F.array(*checks), lambda f: f.isNotNull())).alias("f")).select("settlement_id", "f.*")


def missing_findings(batch: Batch, settlements: DataFrame) -> DataFrame:
    """The finding of each settlement named that has no summary row."""
    wanted = settlements.select("settlement_id").where("settlement_id is not null").distinct()
    missing = wanted.join(batch.summary.select("settlement_id"), "settlement_id", "left_anti")
    return missing.select("settlement_id", _finding(0, F.lit(0), 0, "SETTLEMENT_MISSING", _text("%s has no summary row", "settlement_id"), F.lit(0)).alias("f")).select("settlement_id", "f.*")


def settlement_findings(batch: Batch, settlements: DataFrame, attributed: DataFrame | None = None) -> DataFrame:
    """All findings of the settlements named; one without a summary row has that finding alone."""
    wanted = settlements.select("settlement_id").where("settlement_id is not null").distinct()
    present = wanted.join(batch.summary.select("settlement_id"), "settlement_id", "left_semi")
    return missing_findings(batch, settlements).unionByName(line_findings(batch, attributed).unionByName(summary_findings(batch)).join(present, "settlement_id", "left_semi"))


def all_findings(batch: Batch, settlements: DataFrame) -> DataFrame:
    """settlement_findings before any attribution, with the detail_id of those of a line: `unexplained` takes from them what an attribution explains, so that several attributions share them."""
    wanted = settlements.select("settlement_id").where("settlement_id is not null").distinct()
    present = wanted.join(batch.summary.select("settlement_id"), "settlement_id", "left_semi")
    whole = missing_findings(batch, settlements).unionByName(summary_findings(batch).join(present, "settlement_id", "left_semi"))
    return whole.withColumn("detail_id", F.lit(None).cast("string")).unionByName(line_findings(batch, named=True).join(present, "settlement_id", "left_semi"))


def ties_out(batch: Batch, settlements: DataFrame) -> DataFrame:
    """(settlement_id, ties): no break of the roll-up, the summary or a line, before any attribution.

    The same as settlement_findings without any of BREAKS, by the sums alone.
    """
    wanted = settlements.select("settlement_id").distinct()
    lines = batch.detail.join(wanted, "settlement_id", "left_semi")
    off = F.coalesce(F.col("net_effect_paise") != F.col("gross_effect_paise") - F.col("fee_paise") - F.col("tax_paise"), F.lit(False))
    sums = rollup(lines).join(lines.where(off).select("settlement_id").distinct().withColumn("off", F.lit(True)), "settlement_id", "left")
    s = wanted.join(batch.summary.withColumn("declared", F.lit(True)), "settlement_id", "left").join(sums, "settlement_id", "left").fillna(0, ["r_gross", "r_refund", "r_fee", "r_tax", "r_net"])
    control = F.col("gross_payment_paise") - F.col("refund_paise") - F.col("fee_paise") - F.col("tax_paise")
    pairs = (("gross_payment_paise", "r_gross"), ("refund_paise", "r_refund"), ("fee_paise", "r_fee"), ("tax_paise", "r_tax"), ("net_amount_paise", "r_net"))
    breaks = [F.col("declared").isNull(), F.col("off"), F.col("net_amount_paise") != control, *(F.col(a) != F.col(b) for a, b in pairs)]
    return s.select("settlement_id", (~F.greatest(*(F.coalesce(b, F.lit(False)) for b in breaks))).alias("ties"))
