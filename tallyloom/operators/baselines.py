"""Baseline matchers, and how far text similarity separates candidates."""

from __future__ import annotations

import dataclasses
import difflib
import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tallyloom.functions import scalars as S
from tallyloom.operators import controls
from tallyloom.operators.ladder import ABSTENTION, LadderRun, amount_sides, gated
from tallyloom.operators.verdicts import bridge, verdicts
from tallyloom.sources.batch import Batch
from tallyloom.sources.kept import kept


def per_settlement_first(detail: DataFrame) -> DataFrame:
    """The baselines' own rule for repeats: the first of a detail_id within each settlement."""
    w = W.partitionBy("settlement_id", "detail_id").orderBy("input_order")
    return detail.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def b1_claims(detail: DataFrame) -> DataFrame:
    """B1 claims whatever event a line names, known or not."""
    return per_settlement_first(detail).where("event_id is not null").select("settlement_id", "event_id", "detail_id")


def unconsumed_refunds(batch: Batch) -> DataFrame:
    return batch.ledger.where("event_type = 'REFUND'").join(batch.detail.select("event_id").where("event_id is not null"), "event_id", "left_anti")


def b2_claims(batch: Batch, order: DataFrame | None = None) -> DataFrame:
    """B2: the k-th anonymous refund line of an amount, in the visit order, takes the k-th free refund by id.

    order: (settlement_id, visit), the settlements as cases visit them; by default
    all of them, by id.
    """
    lines = batch.detail.where("event_id is null and line_type = 'REFUND' and settlement_id is not null")
    lines = lines.withColumn("visit", F.col("settlement_id")) if order is None else lines.join(order, "settlement_id")
    lines = lines.select("settlement_id", "detail_id", F.abs("gross_effect_paise").alias("amount_paise"), F.row_number().over(W.partitionBy(F.abs("gross_effect_paise")).orderBy("visit", "input_order")).alias("k"))
    events = unconsumed_refunds(batch).select("event_id", "amount_paise", F.row_number().over(W.partitionBy("amount_paise").orderBy("event_id")).alias("k"))
    return lines.join(events, ["amount_paise", "k"]).select("settlement_id", "event_id", "detail_id")


def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two lower-case texts; 0 if either is empty."""
    return pd.Series([difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


ratio_udf = F.pandas_udf(similarity, T.DoubleType())


def lexical_similarity(a: str, b: str):
    """The larger of token Jaccard and sequence ratio of two string columns; 0 if either is empty."""
    both = (F.coalesce(F.length(a), F.lit(0)) > 0) & (F.coalesce(F.length(b), F.lit(0)) > 0)
    one, two = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    return F.when(both, F.greatest(S.jaccard(S.tokens(one), S.tokens(two)), ratio_udf(one, two))).otherwise(F.lit(0.0))


def described(batch: Batch) -> DataFrame:
    """(txn_id, parent): the description of a transaction's first payment in the ledger, which may have none; by event id where the ledger keeps no order."""
    order = "input_order" if "input_order" in batch.ledger.columns else "event_id"
    return batch.ledger.where("event_type = 'PAYMENT'").groupBy("txn_id").agg(F.min_by("description", order).alias("parent"))


def b3_lines(batch: Batch) -> DataFrame:
    """Anonymous refund lines with their amount and note."""
    return batch.detail.where("event_id is null and line_type = 'REFUND'").select("settlement_id", "detail_id", "input_order", F.abs("gross_effect_paise").alias("amount_paise"), "reference_text")


def b3_ranks(batch: Batch) -> DataFrame:
    """(amount_paise, reference_text, event_id, parent, similarity): the free refunds of an amount beside each distinct note on its lines."""
    notes = b3_lines(batch).select("amount_paise", "reference_text").distinct()
    free = unconsumed_refunds(batch).select("event_id", "txn_id", "amount_paise").join(described(batch), "txn_id", "left").drop("txn_id")
    return alike(notes.join(free, "amount_paise"))


def alike(pairs: DataFrame) -> DataFrame:
    """pairs with the similarity of reference_text and parent, found once for each pair of texts."""
    texts = pairs.select("reference_text", "parent").distinct().withColumn("similarity", lexical_similarity("reference_text", "parent"))
    same = F.col("a.reference_text").eqNullSafe(F.col("t.reference_text")) & F.col("a.parent").eqNullSafe(F.col("t.parent"))
    return pairs.alias("a").join(texts.alias("t"), same).select("a.*", "t.similarity")


def b3_pairs(batch: Batch) -> DataFrame:
    """Anonymous refund lines beside the free refunds of their amount, with the similarity of note and description."""
    return _beside(b3_lines(batch), b3_ranks(batch)).select("settlement_id", "detail_id", "input_order", "amount_paise", "reference_text", "event_id", "parent", "similarity")


#: Refunds of a list that go in one row to the task that takes turns.
AHEAD = 64


def take_turns(lines: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
    """The lines of an amount by k, each with the first refund of its kind's list that is left; a place of a list is looked at once."""
    left = {kind: itertools.chain.from_iterable(g.sort_values("at").events) for kind, g in lists.groupby("kind")}
    taken, rows = set(), []
    for r in lines.sort_values("k").itertuples():
        event = next((e for e in left.get(r.kind, ()) if e not in taken), None)
        if event is not None:
            taken.add(event)
            rows.append((r.settlement_id, event, r.detail_id))
    return pd.DataFrame(rows, columns=["settlement_id", "event_id", "detail_id"])


def b3_claims(lines: DataFrame, ranks: DataFrame) -> DataFrame:
    """B3: each line in file order takes the most similar refund left; ties go to the larger id.

    lines: b3_lines; ranks: b3_ranks.  Lines that rank the refunds alike are a
    class, and the i-th of a class is at its i-th refund.  Where no two lines of an
    amount are at the same refund, which holds wherever there is one class, that is
    the answer.  The other amounts, whose classes contest refunds, take turns: an
    amount's lines are a sequence, so they meet in one task with its lists, while
    amounts are dealt to tasks.
    """
    kind = ("amount_paise", "class")
    place = W.partitionBy("amount_paise", "reference_text").orderBy(F.desc("similarity"), F.desc("event_id"))
    ranked = ranks.withColumn("pos", F.row_number().over(place))
    alike = [F.bit_xor(F.xxhash64(F.lit(k), "event_id", "pos")).alias(f"sign{k}") for k in (1, 2)]
    signs = ranked.groupBy("amount_paise", "reference_text").agg(F.count("*").cast("int").alias("n"), *alike)
    note = F.struct(F.coalesce("reference_text", F.lit("")).alias("text"), F.col("reference_text").isNull().alias("none"))
    signs = signs.withColumn("class", F.min(note).over(W.partitionBy("amount_paise", "n", "sign1", "sign2"))).withColumn("own", note)
    signs = kept(signs.select("amount_paise", "n", "own", "class"))
    ranked = kept(ranked.withColumn("class", note).join(signs.where("own = class").select(*kind), list(kind)).select(*kind, "pos", "event_id"))
    turn = F.struct("input_order", "settlement_id", "detail_id")
    state = lines.withColumn("own", note).join(signs, ["amount_paise", "own"]).select(*kind, turn.alias("turn"))
    state = kept(state.withColumn("at", F.row_number().over(W.partitionBy(*kind).orderBy("turn"))))
    asked = state.join(ranked.withColumnRenamed("pos", "at"), [*kind, "at"])
    holds = kept(asked.groupBy("event_id").agg(F.min("turn").alias("first")))
    contested = kept(asked.join(holds, "event_id").where(F.col("turn") > F.col("first")).select("amount_paise").distinct())
    claims = asked.join(contested, "amount_paise", "left_anti").select("turn.settlement_id", "event_id", "turn.detail_id")
    if contested.isEmpty():
        return claims
    kind = F.to_json("class").alias("kind")
    place = F.row_number().over(W.partitionBy("amount_paise").orderBy("turn")).alias("k")
    waiting = state.join(contested, "amount_paise", "left_semi").select("amount_paise", kind, place, "turn.settlement_id", "turn.detail_id")
    lists = ranked.join(contested, "amount_paise", "left_semi").repartition("amount_paise").groupBy("amount_paise", kind, F.floor(F.col("pos") / AHEAD).alias("at"))
    lists = lists.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "event_id"))), lambda x: x["event_id"]).alias("events"))
    turns = waiting.groupBy("amount_paise").cogroup(lists.groupBy("amount_paise")).applyInPandas(take_turns, "settlement_id string, event_id string, detail_id string")
    return claims.unionByName(turns)


def b3_choices(batch: Batch) -> DataFrame:
    """(amount_paise, reference_text, parent, n, last, similarity): the free refunds of an amount beside each distinct note on its lines, refunds of equal descriptions as one row with their number and the largest id."""
    notes = b3_lines(batch).select("amount_paise", "reference_text").distinct()
    free = unconsumed_refunds(batch).select("event_id", "txn_id", "amount_paise").join(described(batch), "txn_id", "left")
    kinds = free.groupBy("amount_paise", "parent").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    return alike(notes.join(kinds, "amount_paise"))


def separation(choices: DataFrame, *key: str) -> DataFrame:
    """(key, k, best, second, margin) of every key, by default a line's detail_id, with two candidates or more; n, if there is such a column, is how many candidates a row stands for."""
    key, n = key or ("detail_id",), F.col("n") if "n" in choices.columns else F.lit(1)
    scores = choices.groupBy(*key, "similarity").agg(F.sum(n).alias("n"))
    first = W.partitionBy(*key).orderBy(F.desc("similarity"))
    ranked = scores.withColumn("nth", F.row_number().over(first))
    at = lambda nth, c: F.max(F.when(F.col("nth") == nth, F.col(c)))
    s = ranked.groupBy(*key).agg(F.sum("n").alias("k"), at(1, "similarity").alias("best"), F.when(at(1, "n") > 1, at(1, "similarity")).otherwise(at(2, "similarity")).alias("second"))
    return s.where("k > 1").withColumn("margin", F.col("best") - F.col("second"))


def _beside(lines: DataFrame, found: DataFrame) -> DataFrame:
    """lines joined to what was found for their amount and note, which may be null."""
    same = (F.col("l.amount_paise") == F.col("r.amount_paise")) & F.col("l.reference_text").eqNullSafe(F.col("r.reference_text"))
    own = [f"r.{c}" for c in found.columns if c not in ("amount_paise", "reference_text")]
    return lines.alias("l").join(found.alias("r"), same).select("l.*", *own)


def line_separation(batch: Batch, choices: DataFrame) -> DataFrame:
    """separation of every contested line: lines of one amount and note have the same candidates, so only the answer is made of lines."""
    found = separation(choices, "amount_paise", "reference_text")
    return _beside(b3_lines(batch), found).select("detail_id", "k", "best", "second", "margin")


def b3_verdict_claims(batch: Batch) -> DataFrame:
    return b3_claims(b3_lines(batch), b3_ranks(batch))


def visits(cases: DataFrame) -> DataFrame:
    """(settlement_id, visit): settlements in the order in which cases, by id, name them first."""
    return bridge(cases).groupBy("settlement_id").agg(F.min(F.struct("case_id", "case_pos")).alias("visit"))


def decide(batch: Batch, cases: DataFrame, recovered: DataFrame | None = None, findings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts, claims) of a baseline: all named lines as they stand, and what it recovered of the others.

    A baseline never abstains; a line that it recovered counts as explained,
    rightly or not.  findings: controls.all_findings, where they are at hand.
    """
    spark = batch.detail.sparkSession
    named = b1_claims(batch.detail)
    none = spark.createDataFrame([], "settlement_id string, event_id string, detail_id string")
    found = none if recovered is None else recovered.select(*none.columns)
    accepted = found.select(*none.columns, F.lit("baseline").alias("pass_name"), F.lit("ASSUMED").alias("tier"), F.lit(1.0).alias("confidence"), F.lit(0).cast("long").alias("emit_order"), F.lit(0).alias("rung"))
    held = spark.createDataFrame([], ABSTENTION)
    return verdicts(batch, cases, LadderRun(accepted, accepted.limit(0), held, spark.createDataFrame([], "pass_name string, counter string, n bigint")), findings), named.unionByName(found)


def judged_lax(key: DataFrame, expected: DataFrame, decided: DataFrame, claims: DataFrame) -> DataFrame:
    """A row for each case of the key with `correct`: the outcome is right and no claim is wrong; n_wrong counts every claim, repeats too.

    key: (case_id, scenario, expected_outcome, settlement_ids); expected: (event_id, settlement_id).
    """
    return _judged(key, decided, wrong_claims(key, expected, claims))


def wrong_claims(key: DataFrame, expected: DataFrame, claims: DataFrame) -> DataFrame:
    """(case_id, n_wrong) of the cases with claims that the key does not expect."""
    return bridge(key).join(claims, "settlement_id").join(expected.select("event_id", "settlement_id").distinct(), ["event_id", "settlement_id"], "left_anti").groupBy("case_id").agg(F.count("*").alias("n_wrong"))


def _judged(key: DataFrame, decided: DataFrame, wrong: DataFrame) -> DataFrame:
    rows = key.select("case_id", "scenario", "expected_outcome").join(decided.select("case_id", "outcome"), "case_id", "left").join(wrong, "case_id", "left").fillna(0, ["n_wrong"])
    return rows.withColumn("correct", F.coalesce((F.col("outcome") == F.col("expected_outcome")) & (F.col("n_wrong") == 0), F.lit(False)))


def lax_scores(rows: DataFrame, name: str) -> DataFrame:
    """(matcher, n_cases, n_correct, n_wrong_claims, accuracy, floor): floor is the share of cases that the matcher leaves."""
    s = rows.agg(F.count("*").alias("n_cases"), F.count_if("correct").alias("n_correct"), F.coalesce(F.sum("n_wrong"), F.lit(0)).alias("n_wrong_claims"))
    accuracy = S.ratio(F.col("n_correct"), F.col("n_cases"))
    return s.select(F.lit(name).alias("matcher"), "n_cases", "n_correct", "n_wrong_claims", accuracy.alias("accuracy"), F.when(F.col("n_cases") > 0, 1 - accuracy).otherwise(0.0).alias("floor"))


def compare(batch: Batch, cases: DataFrame, key: DataFrame, expected: DataFrame, agent: tuple[DataFrame, DataFrame] | None = None, findings: DataFrame | None = None) -> DataFrame:
    """lax_scores of the baselines B1, B2 and B3, and of the agent's (verdicts, claims).

    findings: controls.all_findings, where they are at hand.  Findings, and which of
    the named lines' claims are wrong, are the same for all baselines and found once.
    """
    findings = kept(controls.all_findings(batch, bridge(cases))) if findings is None else findings
    named = kept(wrong_claims(key, expected, b1_claims(batch.detail)))
    out = None
    for name, claims in {"B1": None, "B2": b2_claims(batch, visits(cases)), "B3": b3_verdict_claims(batch)}.items():
        wrong = named
        if claims is not None:
            claims = kept(claims.select("settlement_id", "event_id", "detail_id"))
            wrong = named.unionByName(wrong_claims(key, expected, claims)).groupBy("case_id").agg(F.sum("n_wrong").alias("n_wrong"))
        one = lax_scores(_judged(key, decide(batch, cases, claims, findings)[0], wrong), name)
        out = one if out is None else out.unionByName(one)
    return out.unionByName(lax_scores(judged_lax(key, expected, *agent), "agent")) if agent else out


def panel(pairs: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """One row over lines with two candidates or more: (contested_lines, mean_margin, max_margin, max_token_overlap) of their notes and descriptions; zeros where there are none.

    pairs: b3_pairs; or, with lines, b3_choices: then lines are counted by amount
    and note, and never paired.
    """
    key = ("detail_id",) if lines is None else ("amount_paise", "reference_text")
    found = separation(pairs, *key)
    found = found.withColumn("n_lines", F.lit(1)) if lines is None else _beside(lines.groupBy(*key).agg(F.count("*").alias("n_lines")), found)
    margins = found.agg(
        F.coalesce(F.sum("n_lines"), F.lit(0)).alias("contested_lines"), F.coalesce(F.sum(F.col("margin") * F.col("n_lines")) / F.sum("n_lines"), F.lit(0.0)).alias("mean_margin"), F.coalesce(F.max("margin"), F.lit(0.0)).alias("max_margin")
    )
    text = lambda c: S.tokens(F.coalesce(F.col(c), F.lit("")))
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}"))
    shared = pairs.alias("p").join(found.select(*key).alias("c"), same, "left_semi").select("reference_text", "parent").distinct()
    most = shared.agg(F.coalesce(F.max(F.size(F.array_intersect(text("reference_text"), text("parent")))), F.lit(0)).alias("max_token_overlap"))
    one = F.lit(1).alias("one")
    return margins.select("*", one).join(most.select("*", one), "one").drop("one")


def hit_rate(pairs: DataFrame, right: DataFrame) -> DataFrame:
    """(n_lines, n_hits, by_chance, lift): how often the most similar candidate is right, over lines with several candidates of which one is.

    right: (settlement_id, event_id) of the answer key; by chance a line with k
    candidates hits with its right ones' share of k.
    """
    w = W.partitionBy("detail_id").orderBy(F.desc("similarity"), F.desc("event_id"))
    mark = pairs.join(right.select("settlement_id", "event_id").distinct().withColumn("right", F.lit(1)), ["settlement_id", "event_id"], "left").withColumn("nth", F.row_number().over(w))
    return _hits(mark.groupBy("detail_id").agg(F.count("*").alias("k"), F.count("right").alias("n_right"), F.max(F.when(F.col("nth") == 1, F.col("right"))).alias("hit")))


def _hits(lines: DataFrame) -> DataFrame:
    s = lines.where("k > 1 and n_right > 0")
    sums = s.agg(F.count("*").alias("n_lines"), F.count("hit").alias("n_hits"), F.coalesce(F.sum(F.col("n_right") / F.col("k")), F.lit(0.0)).alias("by_chance"))
    return sums.withColumn("lift", S.ratio(F.col("n_hits") - F.col("by_chance"), F.col("n_lines")))


def line_hit_rate(batch: Batch, choices: DataFrame, right: DataFrame) -> DataFrame:
    """hit_rate of all lines, which are joined to the number and the first of their candidates, and to the right ones of their settlement and amount, and never to all candidates."""
    best = choices.groupBy("amount_paise", "reference_text").agg(F.sum("n").alias("k"), F.max_by("last", F.struct("similarity", "last")).alias("top"))
    right = right.select("settlement_id", "event_id").distinct()
    known = right.join(unconsumed_refunds(batch).select("event_id", "amount_paise"), "event_id").groupBy("settlement_id", "amount_paise").agg(F.count("*").alias("n_right"))
    lines = _beside(b3_lines(batch), best).join(known, ["settlement_id", "amount_paise"])
    hit = right.select("settlement_id", F.col("event_id").alias("top"), F.lit(1).alias("hit"))
    return _hits(lines.join(hit, ["settlement_id", "top"], "left"))


def gated_candidates(batch: Batch) -> DataFrame:
    """(detail_id, event_id) after the gates that look at the event alone: unconsumed, within days, of a settled parent."""
    found = gated(batch, None)
    blind = found.classes.where("first_failed is null or first_failed in ('gate_4_currency', 'gate_6_sign', 'gate_7_controls')").where("parent")
    return dataclasses.replace(found, classes=blind.withColumn("first_failed", F.lit(None).cast("string"))).survivors().select("detail_id", "event_id")


def unexplained_deltas(batch: Batch) -> DataFrame:
    """(settlement_id, delta_paise, n_lines, refund_paise, n_refunds): what a settlement's anonymous lines take beside all free refunds of these amounts."""
    lines = batch.detail.where("event_id is null and line_type = 'REFUND'").select("settlement_id", F.abs("gross_effect_paise").alias("amount_paise"))
    sums = lines.groupBy("settlement_id").agg(F.sum("amount_paise").alias("delta_paise"), F.count("*").alias("n_lines"))
    free = unconsumed_refunds(batch).groupBy("amount_paise").agg(F.count("*").alias("n"))
    near = lines.distinct().join(free, "amount_paise").groupBy("settlement_id").agg(F.sum(F.col("amount_paise") * F.col("n")).alias("refund_paise"), F.sum("n").alias("n_refunds"))
    return sums.join(near, "settlement_id", "left").fillna(0, ["refund_paise", "n_refunds"])


def multiplicity_by_amount(batch: Batch, name: str) -> DataFrame:
    """How many lines have how many events of their amount: both are counted by amount."""
    lines, events = amount_sides(batch)
    both = lines.groupBy("amount_paise").agg(F.count("*").alias("n_lines")).join(events, "amount_paise")
    return both.groupBy("n_candidates").agg(F.sum("n_lines").alias("n_lines")).select(F.col("n_candidates").alias("k"), "n_lines", F.lit(name).alias("stage"))


def multiplicity(candidates: DataFrame, name: str) -> DataFrame:
    """How many lines have how many candidates."""
    return candidates.groupBy("detail_id").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("n_lines")).withColumn("stage", F.lit(name))
