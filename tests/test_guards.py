"""What is refused, and filters of the journal."""

import math

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import evidence, journal, ladder
from tallyloom.plans import testbed

ROWS = "action string, stage string, subject array<string>, confidence double, decision_id string"


def test_decisions_are_validated(spark):
    good = [("match", "S1", ["a", "b"], 1.0, "d1"), ("exception", "S5", ["c"], None, "d2")]
    rows = spark.createDataFrame(good, ROWS)
    assert journal.validated(rows).count() == 2
    for bad in (("", "S1", ["a"], 0.5, "x"), ("match", None, ["a"], 0.5, "x"), ("verdict", "S5", ["a"], 0.5, "x"), ("match", "S7", ["a"], 0.5, "x"), ("match", "S1", [], 0.5, "x"), ("match", "S1", [""], 0.5, "x"), ("match", "S1", None, 0.5, "x"), ("match", "S1", ["a"], 1.5, "x"), ("match", "S1", ["a"], math.nan, "x")):
        with pytest.raises(ValueError):
            journal.validated(spark.createDataFrame([*good, bad], ROWS))
    assert [r.decision_id for r in journal.by_subject(rows, "b", "a").collect()] == ["d1"]
    assert [r.decision_id for r in journal.by_stage(rows, "S5").collect()] == ["d2"] and journal.get(rows, "d9").count() == 0


def test_a_decision_twice_is_not_sealed(spark):
    rows = spark.createDataFrame([(1, "d", "{}"), (2, "d", "{}")], "seq long, decision_id string, body string")
    with pytest.raises(ValueError, match="twice"):
        journal.seal(rows)


def test_a_pass_without_a_stage_is_refused(spark):
    batch = testbed.batch(spark, "/root/testdata/sf0.001")
    run = ladder.run_ladder(batch, [("exact_join", ladder.exact_join)])
    other = ladder.LadderRun(run.accepted.withColumn("pass_name", F.lit("unheard of")), run.rejected, run.abstentions, run.counters)
    none = spark.createDataFrame([], "case_id string, outcome string, category string, confidence double, evidence array<string>")
    with pytest.raises(Exception, match="no stage for pass unheard of"):
        journal.build(other, none).collect()


def test_ids_with_quotes_have_ids_of_their_own(spark):
    rows = spark.createDataFrame([(['a","b'],), (["a", "b"],), (["b", "a"],)], "ids array<string>")
    got = [r[0] for r in rows.select(S.decision_id(F.lit("match"), F.lit("S1"), F.col("ids"))).collect()]
    assert got[0] != got[1] == got[2]


def test_amounts_and_tolerances(spark):
    one = spark.range(1)
    amount = lambda x: one.select(S.exact_money(F.lit(x).cast("decimal(20,5)"))).first()[0]
    assert (amount("12.30"), amount("-0.5"), amount(None)) == ("12.30", "-0.50", None)
    with pytest.raises(Exception, match="not exact at two places"):
        amount("1.005")
    with pytest.raises(Exception, match="not exact at two places"):
        one.select(S.exact_money(F.lit("10.0000004").cast("decimal(20,9)"))).first()
    big = 2**60 + 1
    assert one.select(S.allowance("PERCENTAGE", 10_000, F.lit(big))).first()[0] == big
    for kind, value, cap in (("OTHER", 1, None), ("FIXED", -1, None), ("FIXED", 1, 5), ("PERCENTAGE_CAPPED", 1, None)):
        with pytest.raises(ValueError):
            S.allowance(kind, value, F.lit(1), cap)


def test_readers_without_a_sure_answer(spark):
    batch = testbed.batch(spark, "/root/testdata/sf0.001")
    events = [r.event_id for r in batch.ledger.where("event_type = 'REFUND'").orderBy("event_id").limit(2).collect()]
    lines = batch.detail.where("event_id is null").orderBy("detail_id").limit(3).select("settlement_id", "detail_id", F.lit("refund_corroboration").alias("pass_name"), F.array(*map(F.lit, events)).alias("candidate_event_ids"), F.lit("").alias("reason"))
    free = spark.createDataFrame([], "event_id string")
    for said, n in ((math.nan, 0), (math.inf, 0), (2.0, 0), (0.9, 3)):
        rung = evidence.adjudication(lambda asked, said=said: [("a ", said) for _ in asked])
        assert rung(batch, free, lines).claims.count() == n
    assert evidence.adjudication(lambda asked: [("A", 0.9) for _ in asked], most_calls=2)(batch, free, lines).claims.count() == 2


def test_calls_are_priced_by_model(spark):
    calls = spark.createDataFrame([("a", 1_000_000, 0, 500_000), ("a", 0, 200_000, 0), ("b", 5, 5, 5), (None, 7, 7, 7)], "model string, input_tokens long, output_tokens long, cache_read_tokens long")
    prices = spark.createDataFrame([("a", 3, 15), ("a", 2, 99), (None, 9, 9), ("c", 1, 1)], "model string, rate_in int, rate_out int")
    got = {r.model: (r.calls, float(r.usd)) for r in evidence.costs(calls, prices).collect()}
    assert got == {"a": (2, 3 + 0.15 + 3.0), "b": (1, 0.0), None: (1, 0.0)}
    assert evidence.costs(calls.limit(0), prices).collect() == []


def test_explained_lines_meet_findings_and_not_all_lines(spark):
    from tallyloom.operators import controls
    from tallyloom.plans import testbed

    b = testbed.batch(spark, "/root/testdata/sf0.001")
    missing = controls.line_findings(b).where("category = 'UNATTRIBUTED_SETTLEMENT_LINE'").count()
    one = b.detail.where("event_id is null").select("detail_id").limit(1)
    left = controls.line_findings(b, one.union(one)).groupBy("category").count().collect()
    whole = {r.category: r["count"] for r in controls.line_findings(b).groupBy("category").count().collect()}
    assert {r.category: r["count"] for r in left} == whole | {"UNATTRIBUTED_SETTLEMENT_LINE": missing - 1}
    plan = controls.line_findings(b, one)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan and "Join LeftOuter, (detail_id" not in plan
