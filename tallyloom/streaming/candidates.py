"""Amount and window gates over streams of ledger events and settlement lines.

An extension: uniqueness and feasibility need the closed batch, so what comes
out are candidates, to be judged once their window has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ladder import WINDOW_DAYS


def candidates(events: DataFrame, lines: DataFrame, window_days: int = WINDOW_DAYS, lateness: str = "1 day") -> DataFrame:
    """Anonymous refund lines beside refunds of their amount raised up to window_days before.

    Both inputs may be streams; state is kept for the window and the lateness.
    """
    refunds = events.where("event_type = 'REFUND'").select("event_id", "txn_id", F.col("amount_paise").alias("event_paise"), F.col("created_at").cast("timestamp").alias("created_at"))
    open_lines = lines.where("event_id is null and line_type = 'REFUND' and gross_effect_paise < 0").select("detail_id", "settlement_id", F.abs("gross_effect_paise").alias("line_paise"), F.col("settled_at").cast("timestamp").alias("settled_at"))
    refunds, open_lines = refunds.withWatermark("created_at", lateness), open_lines.withWatermark("settled_at", lateness)
    near = F.expr(f"event_paise = line_paise and settled_at >= created_at and settled_at <= created_at + interval {window_days} days")
    return refunds.join(open_lines, near).select("detail_id", "settlement_id", "event_id", "txn_id", F.col("line_paise").alias("amount_paise"))
