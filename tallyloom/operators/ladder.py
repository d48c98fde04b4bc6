"""The matching ladder: rungs that attribute settlement lines to ledger events, first claim first.

A rung takes the batch and the events consumed so far, and gives claims,
abstentions and counters.  The runner accepts a claim if its event and its line
are still free, in the order of rungs and of line ids.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyloom.operators import feasibility
from tallyloom.operators.controls import ties_out
from tallyloom.sources.batch import Batch
from tallyloom.sources.kept import kept

# Days a refund may precede its settlement, and the gates by name.
WINDOW_DAYS = 4
GATES = ("gate_1_unconsumed", "gate_3_window", "gate_4_currency", "gate_5_lineage", "gate_6_sign", "gate_7_controls", "gate_8_feasibility", "gate_9_uniqueness")

CLAIM = "settlement_id string, event_id string, detail_id string, pass_name string, tier string, confidence double, emit_order bigint"
ABSTENTION = "settlement_id string, detail_id string, pass_name string, candidate_event_ids array<string>, reason string"


@dataclass(frozen=True)
class PassResult:
    """waiting: the lines that abstain, without their candidates; listed: makes abstentions of some of them.  A rung whose lines share candidates gives these, so that lists are joined to lines last and never shuffled with them."""

    claims: DataFrame
    abstentions: DataFrame
    counters: DataFrame
    waiting: DataFrame | None = None
    listed: Callable[[DataFrame], DataFrame] | None = None


Rung = Callable[[Batch, DataFrame], PassResult]


def _counters(df: DataFrame, name: str, **sums: Column) -> DataFrame:
    wide = df.agg(*(F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in sums.items()))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(name).alias("pass_name"), F.lit(k).alias("counter"), F.col(k).alias("n")) for k in sums))).alias("x")).select("x.*")


def exact_join(batch: Batch, consumed: DataFrame) -> PassResult:
    """Claims every line that names an event of the ledger that is still free."""
    named = batch.detail.where("event_id is not null")
    found = named.join(batch.ledger.select("event_id"), "event_id", "left_semi").join(consumed, "event_id", "left_anti")
    claims = found.select("settlement_id", "event_id", "detail_id", F.lit("exact_join").alias("pass_name"), F.lit("CONFIRMED").alias("tier"), F.lit(1.0).alias("confidence"), F.col("input_order").alias("emit_order"))
    none = batch.detail.sparkSession.createDataFrame([], ABSTENTION)
    return PassResult(claims, none, _counters(named, "exact_join", examined=F.count("*")))


def settled_parents(batch: Batch) -> DataFrame:
    """txn_ids with a processed payment that some line names."""
    named = batch.detail.where("event_id is not null").select("event_id").distinct()
    return batch.ledger.where("event_type = 'PAYMENT' and status = 'PROCESSED'").join(named, "event_id", "left_semi").select("txn_id").distinct()


_LINE = ("amount_paise", "settled_on", "line_currency", "line_type", "outflow", "ties")
_EVENT = ("amount_paise", "created_on", "currency", "event_type", "taken", "parent")


def _sides(batch: Batch, consumed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Anonymous lines and the events of their amounts, each with what the gates ask of it."""
    mark = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    lines = batch.detail.where("event_id is null").select("detail_id", "settlement_id", "line_type", (F.col("gross_effect_paise") < 0).alias("outflow"), F.to_date("settled_at").alias("settled_on"), F.col("currency").alias("line_currency"), F.abs("gross_effect_paise").alias("amount_paise"))
    lines = kept(lines.join(ties_out(batch, lines.select("settlement_id")), "settlement_id", "left").withColumn("ties", F.coalesce("ties", F.lit(False))))
    taken = batch.detail.select("event_id").where("event_id is not null")
    taken = taken if consumed is None else taken.union(consumed.select("event_id"))
    events = batch.ledger.select("event_id", "event_type", "txn_id", "amount_paise", "currency", F.to_date("created_at").alias("created_on")).join(lines.select("amount_paise").distinct(), "amount_paise", "left_semi")
    events = events.join(mark(taken, "event_id", "taken"), "event_id", "left").join(mark(settled_parents(batch), "txn_id", "parent"), "txn_id", "left")
    return lines, kept(events.withColumns({"taken": F.coalesce("taken", F.lit(False)), "parent": F.coalesce("parent", F.lit(False))}))


def amount_candidates(batch: Batch) -> DataFrame:
    """Anonymous lines beside every event of their amount, payments included."""
    lines = batch.detail.where("event_id is null").select("detail_id", "settlement_id", F.abs("gross_effect_paise").alias("amount_paise"))
    return lines.join(batch.ledger.select("event_id", "amount_paise"), "amount_paise")


def amount_sides(batch: Batch) -> tuple[DataFrame, DataFrame]:
    """Anonymous lines (detail_id, amount_paise), and how many events there are of each amount, payments included (amount_paise, n_candidates)."""
    lines = batch.detail.where("event_id is null").select("detail_id", F.abs("gross_effect_paise").alias("amount_paise"))
    return lines, batch.ledger.groupBy("amount_paise").agg(F.count("*").alias("n_candidates"))


def n_candidates(batch: Batch) -> DataFrame:
    """(detail_id, n_candidates): how many amount_candidates an anonymous line has; lines are joined to the count, not to the events."""
    lines, events = amount_sides(batch)
    return lines.join(events, "amount_paise").select("detail_id", "n_candidates")


@dataclass(frozen=True)
class Gated:
    """classes: lines and events alike in all that gates 1 and 3 to 7 ask, in pairs of equal amount that pass gates 1 and 3, with n_pairs and first_failed, the first of the other gates that they fail (null: none); totals: one row, all pairs of equal amount (n_all) and those of taken events (n_taken)."""

    lines: DataFrame
    events: DataFrame
    classes: DataFrame
    totals: DataFrame

    def counts(self) -> DataFrame:
        """(first_failed, n_pairs) of all pairs of equal amount; those out of the window are what is left of the totals."""
        near = self.classes.groupBy("first_failed").agg(F.sum("n_pairs").alias("n_pairs"))
        far = self.totals.crossJoin(self.classes.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_near")))
        rest = F.array(F.struct(F.lit(GATES[0]).alias("first_failed"), F.col("n_taken").alias("n_pairs")), F.struct(F.lit(GATES[1]).alias("first_failed"), (F.col("n_all") - F.col("n_taken") - F.col("n_near")).alias("n_pairs")))
        return near.unionByName(far.select(F.explode(rest).alias("x")).select("x.*").where("n_pairs > 0"))

    def pairs(self) -> DataFrame:
        """(amount_paise, currency, settled_on, created_on, n_lines, n_events) of pairs that fail none of these gates, by days."""
        open_ = self.classes.where("first_failed is null")
        return open_.groupBy(*feasibility.PAIR).agg(F.max("n_lines").alias("n_lines"), F.max("n_events").alias("n_events"))

    def survivors(self) -> DataFrame:
        """(detail_id, settlement_id, event_id, amount_paise, currency, settled_on, created_on) of pairs that fail none of these gates."""
        open_ = self.classes.where("first_failed is null").select(*_LINE, *_EVENT[1:])
        return self.lines.join(open_, list(_LINE)).join(self.events, list(_EVENT)).select("detail_id", "settlement_id", "event_id", "amount_paise", "currency", "settled_on", "created_on")


def gated(batch: Batch, consumed: DataFrame | None, window_days: int = WINDOW_DAYS) -> Gated:
    """Candidates through gates 1 and 3 to 7.

    A pair's fate depends on its days, currencies, kinds and flags only, so
    classes of these are paired.  Pairs of taken events and pairs out of the window
    are only counted, by amount; the others meet by amount and day, a line class
    with the events of its window, or with all where a day is null, which the
    window does not judge.
    """
    lines, events = _sides(batch, consumed)
    own, other = lines.groupBy(*_LINE).agg(F.count("*").alias("n_lines")), events.groupBy(*_EVENT).agg(F.count("*").alias("n_events"))
    n = F.col("n_events")
    by_amount = other.groupBy("amount_paise").agg(F.sum(n).alias("n_all"), F.sum(F.when(F.col("taken"), n).otherwise(0)).alias("n_taken"))
    sums = own.groupBy("amount_paise").agg(F.sum("n_lines").alias("n_lines")).join(by_amount, "amount_paise")
    totals = sums.agg(*(F.coalesce(F.sum(F.col("n_lines") * F.col(c)), F.lit(0)).alias(c) for c in ("n_all", "n_taken")))
    free = other.where("not taken")
    columns = [*_LINE, *_EVENT[1:], "n_lines", "n_events"]
    days = own.where("settled_on is not null").withColumn("created_on", F.explode(F.sequence(F.date_sub("settled_on", window_days), F.col("settled_on"))))
    pairs = days.join(free, ["amount_paise", "created_on"]).select(*columns)
    for some, any_ in ((own.where("settled_on is null"), free), (own.where("settled_on is not null"), free.where("created_on is null"))):
        pairs = pairs.unionByName(some.join(any_, "amount_paise").select(*columns))
    failed = (
        F.when(F.col("currency") != F.col("line_currency"), GATES[2])
        .when(~F.col("parent"), GATES[3])
        .when((F.col("event_type") != "REFUND") | (F.col("line_type") != "REFUND") | ~F.col("outflow"), GATES[4])
        .when(~F.col("ties"), GATES[5])
    )
    return Gated(lines, events, kept(pairs.select("*", (F.col("n_lines") * F.col("n_events")).alias("n_pairs"), failed.alias("first_failed"))), totals)


def feasible(found: Gated, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Survivors of the local gates with `feasible` (gate 8): whether some largest assignment of lines to events uses the pairing.

    Lines of one day and amount are alike, and so are events, so days are judged
    by their counts, and only the answer is made of lines and events.
    """
    judged = feasibility.feasible(found.pairs(), window_days).select(*feasibility.PAIR, "feasible")
    return found.survivors().join(judged, list(feasibility.PAIR)).select("detail_id", "settlement_id", "event_id", "amount_paise", "feasible")


def refund_corroboration(batch: Batch, consumed: DataFrame, window_days: int = WINDOW_DAYS) -> PassResult:
    """Claims an anonymous refund line when exactly one event of its amount passes all gates; abstains at two or more."""
    name = "refund_corroboration"
    found = gated(batch, consumed, window_days)
    judged = kept(feasibility.feasible(found.pairs(), window_days))
    events = found.events.where("parent and not taken and event_type = 'REFUND'").select("event_id", "amount_paise", "currency", "created_on")
    day = ("amount_paise", "currency", "settled_on")
    named = judged.where("feasible").join(events, ["amount_paise", "currency", "created_on"]).groupBy(*day).agg(F.array_sort(F.collect_list("event_id")).alias("allowed"))
    by_day = kept(judged.groupBy(*day).agg(F.sum("n_events").alias("n_local")).join(named, list(day), "left").withColumn("n", F.size(F.coalesce("allowed", F.array().cast("array<string>")))))
    by_day = by_day.withColumnRenamed("currency", "line_currency")
    day = ["amount_paise", "line_currency", "settled_on"]
    open_ = (F.col("line_type") == "REFUND") & F.col("outflow") & F.col("ties")
    lines = found.lines.select("detail_id", "settlement_id", "amount_paise", "settled_on", F.when(open_, F.col("line_currency")).alias("line_currency"))
    few = by_day.select(*day, "n", F.when(F.col("n") == 1, F.col("allowed")[0]).alias("only"))
    state = kept(lines.join(few, day, "left").withColumn("n", F.coalesce("n", F.lit(-1))))
    claims = state.where("n = 1").select("settlement_id", F.col("only").alias("event_id"), "detail_id", F.lit(name).alias("pass_name"), F.lit("CONFIRMED").alias("tier"), F.lit(1.0).alias("confidence"), F.lit(0).cast("long").alias("emit_order"))
    reason = F.format_string("%d candidates survive gates 1-8 (%s); gate 9 requires exactly one", F.size("allowed"), F.array_join("allowed", ", "))
    waiting = state.where("n > 1 or n = 0").select("settlement_id", "detail_id", *day)

    def listed(some: DataFrame) -> DataFrame:
        lists = by_day.select(*day, F.coalesce("allowed", F.array().cast("array<string>")).alias("allowed"))
        return some.join(lists, day).select("settlement_id", "detail_id", F.lit(name).alias("pass_name"), F.col("allowed").alias("candidate_event_ids"), reason.alias("reason"))

    gates = _counters(found.counts(), name, candidates_by_amount=F.sum("n_pairs"), **{g: F.sum(F.when(F.col("first_failed") == g, F.col("n_pairs"))) for g in GATES[:6]})
    gates = gates.unionByName(_counters(judged, name, gate_8_feasibility=F.sum(F.when(~F.col("feasible"), F.col("n_lines") * F.col("n_events")))))
    gates = gates.unionByName(_counters(state, name, examined=F.count("*"), resolved=F.count_if(F.col("n") == 1), abstained=F.count_if((F.col("n") > 1) | (F.col("n") == 0)), unexplained=F.count_if(F.col("n") == -1), gate_9_uniqueness=F.count_if((F.col("n") > 1) | (F.col("n") == 0))))
    return PassResult(claims, listed(waiting), gates, waiting, listed)


JOIN_ONLY: tuple[tuple[str, Rung], ...] = (("exact_join", exact_join),)
DEFAULT: tuple[tuple[str, Rung], ...] = (*JOIN_ONLY, ("refund_corroboration", refund_corroboration))


@dataclass(frozen=True)
class LadderRun:
    accepted: DataFrame
    rejected: DataFrame
    abstentions: DataFrame
    counters: DataFrame


def first_claims(claims: DataFrame, taken: DataFrame) -> DataFrame:
    """claims with `reason`: null where accepted; the event is judged before the line, each by the order of emission.

    taken: (event_id, detail_id) of claims accepted before.  Exact where a rung
    claims a line at most once, as all rungs here do.
    """
    mark = lambda key, name: taken.select(key).distinct().withColumn(name, F.lit(True))
    ranked = claims.join(mark("event_id", "gone"), "event_id", "left").join(mark("detail_id", "held"), "detail_id", "left")
    place = F.struct("emit_order", "detail_id")
    winner = F.min(F.when(F.col("held").isNull(), place)).over(W.partitionBy("event_id"))
    ranked = ranked.withColumn("late", F.coalesce(place > winner, F.lit(False)) | F.col("gone").isNotNull())
    reason = F.when(F.col("late"), F.concat(F.lit("event "), F.col("event_id"), F.lit(" already consumed"))).when(F.col("held"), F.concat(F.lit("line "), F.col("detail_id"), F.lit(" already attributed")))
    return ranked.select(*claims.columns, reason.alias("reason"))


def run_ladder(batch: Batch, ladder: Sequence[tuple[str, Rung]] = DEFAULT, residual: Callable[[Batch, DataFrame, DataFrame], PassResult] | None = None) -> LadderRun:
    """The rungs in turn; residual, a last rung, sees only the abstentions still open."""
    spark = batch.detail.sparkSession
    accepted = spark.createDataFrame([], CLAIM + ", rung int")
    rejected, abstained, counters, results = None, None, None, []
    rungs = [*ladder] + ([("adjudication", None)] if residual else [])
    for k, (_, rung) in enumerate(rungs):
        consumed = accepted.select("event_id").distinct()
        open_lines = abstained.join(accepted, "detail_id", "left_anti").drop("rung") if abstained is not None else None
        result = rung(batch, consumed) if rung else residual(batch, consumed, open_lines)
        judged = kept(first_claims(result.claims, accepted).withColumn("rung", F.lit(k)))
        no = judged.where("reason is not null")
        accepted = accepted.unionByName(judged.where("reason is null").drop("reason"))
        rejected = no if rejected is None else rejected.unionByName(no)
        own = result.abstentions.withColumn("rung", F.lit(k))
        abstained = own if abstained is None else abstained.unionByName(own)
        results.append(result)
        counters = result.counters if counters is None else counters.unionByName(result.counters)
    waits = lambda r: r.abstentions if r.waiting is None else r.waiting
    last = None
    for k, r in enumerate(results):
        own = waits(r).select("detail_id", F.lit(k).alias("rung"))
        last = own if last is None else last.unionByName(own)
    last = last.join(accepted, "detail_id", "left_anti").groupBy("detail_id").agg(F.max("rung").alias("rung"))
    held = None
    for k, r in enumerate(results):
        own = waits(r).join(last.where(F.col("rung") == k), "detail_id", "left_semi")
        own = (own if r.listed is None else r.listed(own)).select("settlement_id", "detail_id", "pass_name", "candidate_event_ids", "reason")
        held = own if held is None else held.unionByName(own)
    return LadderRun(accepted, rejected, held, counters)
