"""Scalar expressions: Column in, Column out.  Money is integer paise."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no product's identity.
STOP_WORDS = (
    "the", "and", "of", "at", "in", "on", "a", "an", "to", "set", "pack", "purchase", "refund", "return", "returned", "against", "raised", "approved", "customer", "back",
    "did", "not", "already", "sent", "collected", "rejected", "wrong", "damaged", "faulty", "defect", "defective", "missing", "torn", "broken", "dead", "past", "caused",
    "differed", "delivered", "shipped", "arrival", "transit", "doorstep", "size", "colour", "unit", "product", "item",
)

# Statuses of a ledger event.
SETTLEABLE = ("CAPTURED", "PROCESSED")
NEVER_SETTLES = ("CREATED", "FAILED")


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def optional_text(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def is_money(c: Column) -> Column:
    r"""An integer in ASCII digits; \z, as $ would admit a last line break."""
    return strip(c).rlike(r"^-?[0-9]+\z")


def money(c: Column) -> Column:
    return F.when(is_money(c), strip(c).cast("long"))


def is_timestamp(c: Column) -> Column:
    """A date and time without an offset."""
    return strip(c).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?\z") & F.try_to_timestamp(F.regexp_replace(strip(c), "T", " ")).isNotNull()


def timestamp(c: Column) -> Column:
    return F.when(is_timestamp(c), F.regexp_replace(strip(c), "T", " ").try_cast("timestamp_ntz"))


def round_half_up(numerator: Column, denominator: int) -> Column:
    """Integer quotient, ties away from zero."""
    n = F.abs(numerator).cast("decimal(38,0)") * 2 + denominator
    return F.signum(numerator).cast("long") * F.floor(n / (2 * denominator)).cast("long")


def settleable(status: Column) -> Column:
    return status.isin(*SETTLEABLE)


def signed(event_type: Column, amount: Column) -> Column:
    return F.when(event_type == "PAYMENT", amount).otherwise(-amount)


def line_ok(gross: Column, fee: Column, tax: Column, net: Column) -> Column:
    return net == gross - fee - tax


def rupees(c: Column) -> Column:
    return (c.cast("decimal(20,2)") / 100).cast("decimal(18,2)")


def allowance(kind: str, value: int, reference: Column, cap: int | None = None) -> Column:
    """What may differ: a fixed amount, basis points of the reference, or those up to a cap."""
    if kind not in ("FIXED", "PERCENTAGE", "PERCENTAGE_CAPPED") or value < 0:
        raise ValueError(f"no such tolerance: {kind} {value}")
    if (kind == "PERCENTAGE_CAPPED") != (cap is not None) or (cap or 0) < 0:
        raise ValueError("a cap of 0 or more belongs to PERCENTAGE_CAPPED, and only to it")
    if kind == "FIXED":
        return F.lit(value).cast("long")
    share = F.floor(F.abs(reference).cast("decimal(38,0)") * value / 10_000).cast("long")
    return F.least(share, F.lit(cap).cast("long")) if kind == "PERCENTAGE_CAPPED" else share


def admits(kind: str, value: int, expected: Column, actual: Column, cap: int | None = None) -> Column:
    return F.abs(expected - actual) <= allowance(kind, value, expected, cap)


def tokens(text: Column) -> Column:
    """Distinct lower-case words and numbers of two characters or more, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def inert(c: Column) -> Column:
    """A cell no spreadsheet runs: an apostrophe before a leading formula sign."""
    return F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), c)).otherwise(c)


def confidence_band(c: Column) -> Column:
    return F.when(c.isNull(), "deterministic").when(c < 0.5, "low").when(c < 0.8, "medium").otherwise("high")


def split_ids(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[|]"), lambda x: x != "")


def join_ids(c: Column) -> Column:
    return F.array_join(c, "|")


def subject(ids: Column) -> Column:
    return F.array_sort(F.array_distinct(ids))


def decision_id(action: Column, stage: Column, ids: Column) -> Column:
    """Identity of a decision: a hash of its action, stage and subject as JSON with sorted keys."""
    text = F.to_json(F.struct(action.alias("action"), stage.alias("stage"), subject(ids).alias("subject")))
    return F.concat(F.lit("dec_"), F.substring(F.sha2(text, 256), 1, 24))


def ratio(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def letter(position: Column) -> Column:
    """A to Z for positions from 0, and round again."""
    return F.chr(F.lit(65) + F.pmod(position, F.lit(26)))


def lookup(c: Column, table: Mapping[str, str], fallback: str | None) -> Column:
    entries = F.create_map(*(F.lit(x) for pair in sorted(table.items()) for x in pair))
    return F.coalesce(F.try_element_at(entries, c), F.lit(fallback))


def cost_usd(inputs: Column, cached: Column, outputs: Column, rate_in: Column, rate_out: Column) -> Column:
    """Dollars by rates a million tokens, cached input at a tenth; unknown rates cost nothing."""
    d = lambda c: c.cast("decimal(18,4)")
    total = d(inputs) * d(rate_in) + d(cached) * d(rate_in) / 10 + d(outputs) * d(rate_out)
    return F.coalesce(F.bround((total / 1_000_000).cast("decimal(24,10)"), 6), F.lit(0)).cast("decimal(18,6)")


def exact_money(c: Column) -> Column:
    """A number as text with two places; one that two places do not hold, in its own scale, is refused."""
    short = F.bround(c, 2)
    refused = F.raise_error(F.concat(F.lit("not exact at two places: "), c.cast("string"))).cast("string")
    return F.when(c.isNull() | (c == short), short.cast("decimal(38,2)").cast("string")).otherwise(refused)
