"""A seeded benchmark of reconciliation cases, generated by Spark at any size.

A plan gives each case a scenario, from a seeded permutation, and a size, so that
the events add up to the records asked for.  Each event has a role by its place in
its case, and all else follows by expressions over draws: numbers in [0, 1) from a
hash of the seed, what is drawn, and the row.  Nothing is looped over on the
driver but the scenarios.

Refund amounts of different kinds never meet, at any size, but where a kind is
about collisions.
"""

from __future__ import annotations

import datetime
from dataclasses import asdict, dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.scalars import round_half_up
from tallyloom.operators.controls import rollup
from tallyloom.sources import catalogue
from tallyloom.sources.batch import Batch, numbered, told_apart
from tallyloom.sources.kept import kept
from tallyloom.sources.ordering import permuted

# Percent of cases by family, in each family's own order, which settles equal remainders.
SHARES = {
    "primary": (("STRAIGHT_THROUGH", 37), ("DESCRIBED_REFUND", 6), ("REFUND_LATER_CYCLE", 10), ("CONTESTED_REFUND", 8), ("DUPLICATE_DETAIL_EXPORT", 8), ("CORROBORATED_REFUND", 6), ("CAPTURED_UNSETTLED", 6), ("NOT_SETTLEABLE", 6), ("FEE_TAX_VARIANCE", 4), ("AMBIGUOUS_REFUND", 4), ("BANK_CREDIT_MISSING", 3), ("BANK_CREDIT_DUPLICATE", 2)),
    "development": (("STRAIGHT_THROUGH", 16), ("DESCRIBED_REFUND", 10), ("CONTESTED_REFUND", 14), ("CORROBORATED_REFUND", 10), ("REFUND_LATER_CYCLE", 9), ("DUPLICATE_DETAIL_EXPORT", 9), ("AMBIGUOUS_REFUND", 8), ("CAPTURED_UNSETTLED", 6), ("FEE_TAX_VARIANCE", 6), ("NOT_SETTLEABLE", 5), ("BANK_CREDIT_MISSING", 4), ("BANK_CREDIT_DUPLICATE", 3)),
    "stress": (("STRAIGHT_THROUGH", 10), ("DESCRIBED_REFUND", 10), ("CONTESTED_REFUND", 14), ("REFUND_LATER_CYCLE", 10), ("DUPLICATE_DETAIL_EXPORT", 10), ("CORROBORATED_REFUND", 10), ("FEE_TAX_VARIANCE", 8), ("CAPTURED_UNSETTLED", 7), ("BANK_CREDIT_MISSING", 7), ("AMBIGUOUS_REFUND", 6), ("BANK_CREDIT_DUPLICATE", 5), ("NOT_SETTLEABLE", 3)),
}
OUTCOMES = {"FEE_TAX_VARIANCE": "EXCEPTION", "BANK_CREDIT_MISSING": "EXCEPTION", "BANK_CREDIT_DUPLICATE": "EXCEPTION", "CAPTURED_UNSETTLED": "EXCEPTION", "NOT_SETTLEABLE": "NO_ACTION", "AMBIGUOUS_REFUND": "ABSTAIN"}
METHODS = (("upi", 0, 0.46), ("card", 200, 0.28), ("netbanking", 175, 0.14), ("wallet", 200, 0.08), ("emi", 300, 0.04))
GST = 1800
# Rupees at which prices pile up, and bands of the other amounts with their weights.
PRICE_POINTS = (49, 99, 149, 199, 249, 299, 349, 399, 449, 499, 599, 699, 799, 899, 999, 1199, 1499, 1799, 1999, 2499, 2999, 3499, 3999, 4999, 5999, 7999, 9999, 12999, 14999, 19999, 24999, 29999, 49999)
BANDS = ((50, 500, 0.30), (500, 5_000, 0.42), (5_000, 50_000, 0.22), (50_000, 400_000, 0.06))
WHOLE_RUPEES = 0.60
# The first refund amount of each kind in paise; a kind with so many cases that it would reach the next moves that one up.
FIRST_PAISE = (("CORROBORATED_REFUND", 100), ("AMBIGUOUS_REFUND", 2_500), ("CONTESTED_REFUND", 10_000_100), ("DESCRIBED_REFUND", 20_000_101))
FEWEST = {"CONTESTED_REFUND": 5, "DESCRIBED_REFUND": 4}
MOST = 7
BANKS = ("HDFC", "ICICI", "AXIS", "KOTAK", "YESBANK")
#: Gates that the losing refunds of a contested amount fail.
LOSERS = ("GATE_1", "GATE_3", "GATE_5")


@dataclass(frozen=True)
class Config:
    """What to generate; a value out of its bounds is refused."""

    records: int = 500
    seed: int = 42
    family: str = "primary"
    start: datetime.date = field(default=datetime.date(2026, 6, 1))
    horizon_days: int = 45
    lag_days: int = 1
    window_days: int = 4
    skip_sundays: bool = True
    price_point_share: float = 0.45

    def __post_init__(self) -> None:
        rules = {
            "family": self.family in SHARES,
            "records: every case has 3 to 7": self.records >= 3,
            "horizon_days": self.horizon_days >= 1,
            "lag_days": self.lag_days >= 0,
            "window_days": self.window_days >= 0,
            "price_point_share": 0.0 <= self.price_point_share <= 1.0,
        }
        if broken := [k for k, ok in rules.items() if not ok]:
            raise ValueError("out of bounds: " + ", ".join(broken))

    @property
    def cases(self) -> int:
        """Some five records a case, as far as cases of 3 to 7 can hold the records."""
        return min(max((self.records + 2) // 5, -(-self.records // MOST)), self.records // 3)


@dataclass(frozen=True)
class Dataset:
    batch: Batch
    raw_detail: DataFrame
    cases: DataFrame
    key_cases: DataFrame
    key_allocations: DataFrame
    config: Config


def apportion(total: int, shares: tuple[int, ...]) -> list[int]:
    """Counts by largest remainder; ties go to the earlier share."""
    whole = sum(shares)
    counts = [total * s // whole for s in shares]
    rest = sorted(range(len(shares)), key=lambda i: (-(total * shares[i] % whole), i))
    for i in rest[: total - sum(counts)]:
        counts[i] += 1
    return counts


def settle_time(created: Column, lag_days: int = 1, skip_sundays: bool = True) -> Column:
    """11:30 on the day after, or on Monday where that is a Sunday."""
    day = F.date_add(F.to_date(created), lag_days)
    day = F.when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day) if skip_sundays else day
    return F.concat(day.cast("string"), F.lit(" 11:30:00")).cast("timestamp_ntz")


class Draws:
    """Draws by a seed: the same for the same salt and columns, on any cluster."""

    def __init__(self, seed: int):
        self.seed = seed

    def uniform(self, salt: str, *cols: str | Column) -> Column:
        """A number in [0, 1), of 53 bits."""
        return F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.lit(salt), *cols), 11) / F.lit(float(1 << 53))

    def below(self, n: int | Column, salt: str, *cols: str | Column) -> Column:
        return F.floor(self.uniform(salt, *cols) * n).cast("long")

    def of(self, values: tuple, salt: str, *cols: str | Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (self.below(len(values), salt, *cols) + 1).cast("int"))

    def weighted(self, values: tuple, weights: tuple[float, ...], salt: str, *cols: str | Column) -> Column:
        """A value by the inverse of the weights' distribution."""
        u, at, out = self.uniform(salt, *cols), 0.0, None
        for value, weight in list(zip(values, weights, strict=True))[:-1]:
            at += weight / sum(weights)
            out = F.when(u < at, F.lit(value)) if out is None else out.when(u < at, F.lit(value))
        return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))

    def amount(self, share: float, *cols: str | Column) -> Column:
        """Paise: a price point for that share, else evenly within a band drawn by weight, most of them in whole rupees."""
        band = self.weighted(tuple(range(len(BANDS))), tuple(b[2] for b in BANDS), "band", *cols)
        low, high = (F.element_at(F.array(*(F.lit(b[k]) for b in BANDS)), band + 1).cast("long") for k in (0, 1))
        whole = (low + self.below(high - low + 1, "rupees", *cols)) * 100
        exact = low * 100 + self.below((high - low) * 100 + 1, "paise", *cols)
        drawn = F.when(self.uniform("whole", *cols) < WHOLE_RUPEES, whole).otherwise(exact)
        return F.when(self.uniform("point", *cols) < share, self.of(PRICE_POINTS, "price", *cols) * 100).otherwise(drawn).cast("long")


def scenario_counts(config: Config) -> dict[str, int]:
    names, shares = zip(*SHARES[config.family], strict=True)
    return dict(zip(names, apportion(config.cases, shares), strict=True))


def plan(spark: SparkSession, config: Config) -> DataFrame:
    """(no, scenario, ordinal, grp, single, size): a row for each case; sizes add up to config.records.

    ordinal counts the cases of a scenario from 0.  Ambiguous cases go in pairs of
    one grp, the odd one out in the last of them; a single one is ambiguous by itself.
    """
    counts = scenario_counts(config)
    scenario, ordinal, at = F.lit(None).cast("string"), F.lit(None).cast("long"), 0
    for name, n in reversed(counts.items()):
        at += n
        begin = config.cases - at
        scenario = F.when(F.col("turn") >= begin, scenario).otherwise(scenario) if n == 0 else F.when((F.col("turn") >= begin) & (F.col("turn") < begin + n), F.lit(name)).otherwise(scenario)
        ordinal = F.when((F.col("turn") >= begin) & (F.col("turn") < begin + n), F.col("turn") - begin).otherwise(ordinal)
    cases = permuted(spark.range(config.cases).withColumnRenamed("id", "no"), config.seed, "no", name="turn").select("no", scenario.alias("scenario"), ordinal.alias("ordinal"))
    ambiguous = counts["AMBIGUOUS_REFUND"]
    last = F.greatest(F.lit(ambiguous // 2 - 1), F.lit(0))
    cases = cases.select("*", F.when(F.col("scenario") == "AMBIGUOUS_REFUND", F.least(F.floor(F.col("ordinal") / 2), last)).alias("grp"), F.lit(ambiguous == 1).alias("single"))
    few = F.lit(3)
    for name, n in FEWEST.items():
        few = F.when(F.col("scenario") == name, n).otherwise(few)
    few = F.when((F.col("scenario") == "AMBIGUOUS_REFUND") & F.col("single"), 4).otherwise(few)
    cases = kept(cases.withColumn("few", few))
    rest = config.records - (cases.agg(F.sum("few")).first()[0] or 0)
    if not 0 <= rest <= config.cases * MOST - (config.records - rest):
        raise ValueError(f"{config.records} records do not fit {config.cases} cases of these scenarios")
    room = cases.select("no", F.explode(F.sequence(F.col("few") + 1, F.lit(MOST))).alias("k"))
    more = permuted(room, config.seed, "no", "k").where(F.col("place") < rest).groupBy("no").agg(F.count("*").alias("more"))
    return cases.join(more, "no", "left").select("no", "scenario", "ordinal", "grp", "single", (F.col("few") + F.coalesce("more", F.lit(0))).cast("int").alias("size"))


def _is(*names: str) -> Column:
    return F.col("scenario").isin(*names)


def _any(*conditions: Column) -> Column:
    return reduce(or_, conditions)


def _roles(case: DataFrame, config: Config, d: Draws) -> DataFrame:
    """A row for each event of a case: is_refund, of (the payment that it returns), slot (its settlement, 0 for none), anonymous, made (when), amount_paise, method_of (whose method), kind (of goods)."""
    k, later, contested = F.col("k"), _is("REFUND_LATER_CYCLE"), _is("CONTESTED_REFUND")
    two = _is("DESCRIBED_REFUND") | (_is("AMBIGUOUS_REFUND") & F.col("single"))
    one = _is("CORROBORATED_REFUND") | (_is("AMBIGUOUS_REFUND") & ~F.col("single"))
    # a contested case: payment 1 is returned in part by 3 and by the losers after it, 2 carries the settlement
    n_lost = 1 + d.below(F.least(F.lit(4), F.col("size") - 3) - 1, "losers", "no")
    lost = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda j: F.when(j > n_lost, -1).when(j == 1, F.col("ordinal") % 3).otherwise(d.below(3, "gate", F.col("no"), j)).cast("int"))
    case = case.select("*", F.when(contested, n_lost.cast("int")).alias("n_lost"), F.when(contested, lost).alias("lost"))
    days = config.window_days
    offset = lambda j: F.when(F.col("lost")[j - 1] == 1, F.when(d.below(2, "side", F.col("no"), j) == 0, -days - 1 - d.below(3, "old", F.col("no"), j)).otherwise(1 + d.below(3, "after", F.col("no"), j))).otherwise(-d.below(days + 1, "within", F.col("no"), j))
    away = F.concat(F.array(-d.below(days + 1, "within", "no", F.lit(0))), F.transform(F.sequence(F.lit(1), F.col("n_lost")), offset))
    case = case.withColumn("away", F.when(contested, F.transform(away, lambda x: x.cast("int"))))
    case = case.withColumn("n_broken", F.when(contested, F.size(F.filter("lost", lambda g: g == 2))).otherwise(0))
    first = F.lit(str(config.start)).cast("date")
    clock = lambda day, seconds: F.timestamp_add("SECOND", seconds.cast("int"), day.cast("timestamp_ntz"))
    drawn = clock(F.date_add(first, d.below(config.horizon_days, "day", "no").cast("int")), d.below(86_400, "second", "no"))
    tied = clock(F.date_add(first, (F.col("grp") * 3 % max(1, config.horizon_days - 2)).cast("int")), F.lit(36_000))
    case = case.withColumn("began", F.when(_is("AMBIGUOUS_REFUND"), tied).otherwise(drawn))
    case = case.withColumn("target", F.to_date(settle_time(F.col("began"), config.lag_days, config.skip_sundays)))

    counts, paise, at = scenario_counts(config), F.lit(None).cast("long"), 0
    for name, base in FIRST_PAISE:
        at = max(at, base)
        paise = F.when(_is(name), at + (F.col("grp") if name == "AMBIGUOUS_REFUND" else F.col("ordinal"))).otherwise(paise)
        at += counts[name]
    case = case.withColumn("returned", paise.cast("long"))

    e = case.select("*", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("k"))
    loser = contested & (k > 3) & (k <= 3 + F.col("n_lost"))
    gate = F.when(loser, F.col("lost")[k - 4])
    broken = contested & (k == 4 + F.col("n_lost")) & (F.col("n_broken") > 0)
    is_refund = F.coalesce(_any(later & (k == 2), one & (k == 2), two & k.isin(3, 4), contested & (k == 3), loser), F.lit(False))
    parent = F.when(two, k - 2).when(loser & (gate == 2), 4 + F.col("n_lost")).otherwise(1)
    unsettled = _is("CAPTURED_UNSETTLED", "NOT_SETTLEABLE")
    slot = F.when(unsettled | broken, 0).when(loser, F.when(gate == 0, 2).otherwise(0)).when(later & (k > 1) | two & k.isin(2, 4) | contested & (k == 1), 2).otherwise(1)
    anonymous = is_refund & ~later & ~F.coalesce(loser, F.lit(False))
    e = e.select("*", is_refund.alias("is_refund"), F.when(is_refund, parent).alias("of"), slot.alias("slot"), anonymous.alias("anonymous"), gate.alias("gate"), F.coalesce(broken, F.lit(False)).alias("broken"))

    at_target = lambda n, seconds: clock(F.date_add("target", n.cast("int")), F.lit(seconds))
    lineage = F.array_min(F.filter(F.transform("away", lambda x, i: F.when((i == 0) | (F.col("lost")[i - 1] != 2), x)), lambda x: x.isNotNull()))
    broke = F.array_min(F.filter(F.transform("away", lambda x, i: F.when((i > 0) & (F.col("lost")[i - 1] == 2), x)), lambda x: x.isNotNull()))
    in_contest = F.when(F.col("is_refund"), at_target(F.col("away")[k - 3], 33_300)).when(k == 1, at_target(lineage - 1, 32_400)).when(F.col("broken"), at_target(broke - 1, 32_400)).otherwise(at_target(F.lit(-1), 28_800))
    minutes = F.when(two & k.isin(2, 4), 1).otherwise(0) + F.when(F.col("is_refund") & ~later, 60).otherwise(0)
    made = F.when(contested, in_contest).when(later & (k > 1), F.timestamp_add("DAY", F.lit(2), F.col("began"))).otherwise(F.timestamp_add("MINUTE", minutes, F.col("began")))

    price = lambda at_k: d.amount(config.price_point_share, F.col("no"), at_k)
    own, least, back = price(k), 100_000, F.col("returned")
    of_later = F.greatest(F.lit(5_000), F.floor(F.least(*(F.greatest(price(F.lit(j)), F.lit(least)) for j in (1, 3))) / 4))
    refund = F.when(later, of_later).otherwise(back)
    payment = (
        F.when(later & k.isin(1, 3), F.greatest(own, F.lit(least)))
        .when((one & (k == 1)) | (_is("AMBIGUOUS_REFUND") & two & (k <= 2)), F.greatest(own, back * 4, F.lit(5_000)))
        .when(two & (k <= 2), F.greatest(own, back + 100_000))
        .when(contested & (k == 1), (F.col("n_lost") + 3) * back)
        .when(contested & (k == 2), 3 * back)
        .when(F.col("broken"), (F.col("n_broken") + 2) * back)
        .otherwise(own)
    )
    whose = F.coalesce("of", "k")
    free = d.weighted(tuple(m[0] for m in METHODS), tuple(m[2] for m in METHODS), "method", "no", whose)
    upi = _any((one | contested) & (whose == 1), two & (whose <= 2), contested & ((whose == 2) | (whose == 4 + F.col("n_lost")) & (F.col("n_broken") > 0)))
    n = len(catalogue.CATEGORIES)
    kind = d.below(n, "kind", "no", whose)
    other = (d.below(n, "kind", "no", F.lit(1)) + 1 + d.below(n - 1, "other", "no")) % n
    kind = F.when(_is("AMBIGUOUS_REFUND") & (one & (whose == 1) | two & (whose <= 2)), F.col("grp") % n).when(_is("DESCRIBED_REFUND") & (whose == 2), other).otherwise(kind)
    return e.select("*", made.alias("made"), F.when(F.col("is_refund"), refund).otherwise(payment).cast("long").alias("amount_paise"), F.when(F.coalesce(upi, F.lit(False)), "upi").otherwise(free).alias("method"), kind.cast("int").alias("kind"), whose.alias("whose"))


def _text(texts: dict[str, tuple[str, ...]], kind: Column, pick: Column) -> Column:
    """The text at a place of a category's own."""
    table = F.array(*(F.array(*map(F.lit, texts[c])) for c in catalogue.CATEGORIES))
    return F.element_at(F.element_at(table, kind + 1), (pick + 1).cast("int"))


def generate(spark: SparkSession, config: Config = Config()) -> Dataset:  # noqa: B008
    """ledger, detail, summary, bank and pricing with the answer key of every case.

    Files are in seeded orders of their own, so that a place in one says nothing
    about a place in another.
    """
    d = Draws(config.seed)
    ident = lambda prefix, *c: F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("/", F.lit(config.seed), F.lit(prefix), *c), 256), 1, 14))
    case = plan(spark, config).withColumn("case_id", F.format_string("case_%05d", F.col("no") + 1))
    events = _roles(case, config, d)
    status = F.when(_is("CAPTURED_UNSETTLED") | F.col("broken"), "CAPTURED").when(_is("NOT_SETTLEABLE"), d.of(("CREATED", "FAILED"), "status", "no", "k")).otherwise("PROCESSED")
    product = F.when(~F.col("is_refund"), _text(catalogue.PRODUCTS, F.col("kind"), d.below(4, "product", "no", "k")))
    note = F.when(F.col("is_refund"), _text(catalogue.NOTES, F.col("kind"), d.below(3, "note", "no", "k"))).otherwise(d.of(catalogue.PAYMENT_NOTES, "note", "no", "k"))
    events = kept(
        events.select(
            "no", "case_id", "scenario", "k", "slot", "anonymous", "gate", "is_refund", ident("evt_", "no", "k").alias("event_id"), F.when(F.col("is_refund"), "REFUND").otherwise("PAYMENT").alias("event_type"),
            ident("txn_", "no", "whose").alias("txn_id"), ident("ord_", "no", "whose").alias("order_id"), "amount_paise", F.lit("INR").alias("currency"), F.when(F.col("is_refund"), "PROCESSED").otherwise(status).alias("status"),
            F.col("made").alias("created_at"), "method", product.alias("description"), note.alias("reference_text"),
            F.when(F.col("slot") > 0, ident("setl_", "no", "slot")).alias("settlement_id"), F.when(_is("REFUND_LATER_CYCLE") & (F.col("slot") == 2), settle_time(F.timestamp_add("DAY", F.lit(2), F.col("began")), config.lag_days, config.skip_sundays)).otherwise(settle_time(F.col("began"), config.lag_days, config.skip_sundays)).alias("settled_at"),
        )
    )

    rates = spark.createDataFrame([(m, r, GST) for m, r, _ in METHODS], "method string, fee_rate_bps int, gst_rate_bps int")
    lines = events.where("slot > 0").join(F.broadcast(rates), "method").withColumn("fee", round_half_up(F.col("amount_paise") * F.col("fee_rate_bps"), 10_000))
    varied = _is("FEE_TAX_VARIANCE") & (F.col("k") == 1)
    by_fee = varied & (d.below(2, "variance", "no") == 0)
    fee = F.col("fee") + F.when(by_fee, 100).otherwise(0)
    tax = round_half_up(fee * GST, 10_000) + F.when(varied & ~by_fee, 1).otherwise(0)
    lines = lines.select(
        ident("det_", "no", "k").alias("detail_id"), "settlement_id", F.when(~F.col("anonymous"), F.col("event_id")).alias("event_id"), F.col("event_type").alias("line_type"), F.when(F.col("is_refund"), -F.col("amount_paise")).otherwise(F.col("amount_paise")).alias("gross_effect_paise"),
        fee.alias("fee_paise"), tax.alias("tax_paise"), "settled_at", "currency", "reference_text", F.explode(F.when(_is("DUPLICATE_DETAIL_EXPORT") & (F.col("k") <= 2), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    lines = lines.withColumn("net_effect_paise", F.col("gross_effect_paise") - F.col("fee_paise") - F.col("tax_paise"))
    ranked = kept(numbered(permuted(lines, config.seed, "detail_id", "copy", name="input_order").drop("copy")))
    raw, (first, dups) = ranked.drop("nth"), told_apart(ranked)

    about = events.where("slot > 0").groupBy("settlement_id").agg(F.first("no").alias("no"), F.first("scenario").alias("scenario"), F.first("slot").alias("slot"), F.max(F.to_date("settled_at")).alias("settlement_date"))
    count = first.groupBy("settlement_id").agg(F.count("*").cast("int").alias("line_count"))
    totals = rollup(first).join(count, "settlement_id").join(about, "settlement_id")
    summary = totals.select("no", "slot", "settlement_id", F.concat(F.lit("UTIBN"), F.substring(F.sha2("settlement_id", 256), 1, 11)).alias("utr"), "settlement_date", F.col("r_gross").alias("gross_payment_paise"), F.col("r_refund").alias("refund_paise"), F.col("r_fee").alias("fee_paise"), F.col("r_tax").alias("tax_paise"), (F.col("r_gross") - F.col("r_refund") - F.col("r_fee") - F.col("r_tax")).alias("net_amount_paise"), "line_count", F.lit("INR").alias("currency"), F.lit("PROCESSED").alias("status"), "scenario")
    summary = kept(summary)
    copies = F.when(_is("BANK_CREDIT_MISSING"), 0).when(_is("BANK_CREDIT_DUPLICATE"), 2).otherwise(1)
    bank = summary.withColumn("copies", copies).where("copies > 0").select("no", "slot", "settlement_id", "utr", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n"), F.concat(F.col("settlement_date").cast("string"), F.lit(" 14:30:00")).cast("timestamp_ntz").alias("posted_at"), F.col("net_amount_paise").alias("credit_amount_paise"), "currency")
    narration = F.concat(F.lit("NEFT CR: "), d.of(BANKS, "bank", "utr", "n"), F.lit(" "), F.col("utr"), F.lit(" GATEWAY SETTLEMENT"))
    bank = kept(bank.select("*", F.concat(F.lit("bank_"), F.substring(F.sha2(F.concat_ws("/", "utr", "n"), 256), 1, 14)).alias("bank_row_id"), narration.alias("narration"), F.concat(F.lit("ref_"), F.substring(F.sha2(F.concat_ws("/", F.lit("ref"), "utr", "n"), 256), 1, 12)).alias("bank_ref")))

    listed = lambda df, key, name: df.groupBy("no").agg(F.transform(F.array_sort(F.collect_list(F.struct(*key, name))), lambda x: x[name]).alias(f"{name}s"))
    whole = case.join(listed(events, ["k"], "event_id"), "no").join(listed(summary, ["slot"], "settlement_id"), "no", "left").join(listed(bank, ["slot", "n"], "bank_row_id"), "no", "left")
    none = F.array().cast("array<string>")
    whole = kept(whole.select("case_id", "scenario", "event_ids", F.coalesce("settlement_ids", none).alias("settlement_ids"), F.coalesce("bank_row_ids", none).alias("bank_row_ids")))
    outcome = F.lit("RECONCILED")
    for name, result in OUTCOMES.items():
        outcome = F.when(_is(name), result).otherwise(outcome)
    category = F.when(outcome.isin("EXCEPTION", "ABSTAIN"), F.col("scenario")).when(_is("DUPLICATE_DETAIL_EXPORT"), "DUPLICATE_DETAIL_EXPORT_WARNING")
    key = whole.select("case_id", "scenario", outcome.alias("expected_outcome"), category.alias("expected_category"), "settlement_ids")
    known = events.where((F.col("slot") > 0) & ~(_is("AMBIGUOUS_REFUND") & F.col("is_refund"))).select("event_id", "settlement_id")
    pairs = known.join(bank.select("settlement_id", "bank_row_id"), "settlement_id", "left").select("event_id", "settlement_id", "bank_row_id")
    ledger = events.select("event_id", "event_type", "txn_id", "order_id", "amount_paise", "currency", "status", "created_at", "method", "description")
    batch = Batch(ledger, first, dups, summary.drop("no", "slot", "scenario"), bank.select("bank_row_id", "utr", "posted_at", "credit_amount_paise", "currency", "narration", "bank_ref"), rates)
    return Dataset(batch, raw, whole.select("case_id", "settlement_ids", "bank_row_ids", "event_ids"), key, pairs, config)


def metadata(data: Dataset) -> DataFrame:
    """(key, value) of a dataset: its configuration, and how many rows, cases by scenario and cases by outcome it has."""
    spark = data.cases.sparkSession
    c = data.config
    told = {f"config.{k}": str(v) for k, v in asdict(c).items()} | {"batch_id": f"batch_{c.family}_{c.seed}", "generated_at": f"{c.start}T00:00:00"}
    rows = {"gateway_events": data.batch.ledger, "detail_rows": data.raw_detail, "settlements": data.batch.summary, "bank_rows": data.batch.bank, "allocations": data.key_allocations, "cases": data.cases}
    out = spark.createDataFrame(sorted(told.items()), "key string, value string")
    for name, df in rows.items():
        out = out.unionByName(df.agg(F.count("*").cast("string").alias("value")).select(F.lit(f"rows.{name}").alias("key"), "value"))
    for kind, column in (("scenario", "scenario"), ("outcome", "expected_outcome")):
        out = out.unionByName(data.key_cases.groupBy(column).count().select(F.concat(F.lit(f"{kind}."), column).alias("key"), F.col("count").cast("string").alias("value")))
    return out


def write(data: Dataset, directory: str) -> None:
    """The CSV files that load_batch, load_caseload and load_answer_key read, each in a seeded order of its own, with batch_config.csv and dataset_meta.json."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
    join = lambda c: F.array_join(c, "|").alias(c)
    drawn = lambda df, *key: df.orderBy(F.xxhash64(F.lit(data.config.seed), *key), *key)
    key = data.key_cases.drop("settlement_ids").join(data.cases, "case_id").withColumnRenamed("expected_category", "expected_exception_category")
    meta = metadata(data)
    config = meta.where("key in ('batch_id', 'config.seed', 'config.family', 'rows.gateway_events', 'rows.cases', 'generated_at')").groupBy().pivot("key", ["batch_id", "config.seed", "config.family", "rows.gateway_events", "rows.cases", "generated_at"]).agg(F.first("value"))
    tables = {
        "gateway_ledger": drawn(data.batch.ledger, "event_id").withColumn("created_at", iso("created_at")),
        "settlement_detail": data.raw_detail.orderBy("input_order").drop("input_order").withColumn("settled_at", iso("settled_at")),
        "settlement_summary": drawn(data.batch.summary, "settlement_id"),
        "bank_statement": drawn(data.batch.bank, "bank_row_id").withColumn("posted_at", iso("posted_at")),
        "pricing_rules": data.batch.pricing,
        "answer_key_cases": key.orderBy("case_id").select("case_id", "scenario", "expected_outcome", "expected_exception_category", join("settlement_ids"), join("bank_row_ids"), join("event_ids")),
        "answer_key_allocations": drawn(data.key_allocations, "event_id", "settlement_id", "bank_row_id"),
        "batch_config": config.toDF("batch_id", "seed", "family", "n_gateway_events", "n_cases", "generated_at"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{directory}/{name}.csv")
    whole = meta.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(f"{directory}/dataset_meta.json")
