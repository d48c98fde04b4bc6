"""Records with exact amounts, what a journal's records tell, and journals found in folders."""

import hashlib
import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import codec, journal, ladder, verdicts
from tallyloom.plans import testbed

DATA = "/root/testdata/sf0.001"
NESTED = "id string, a decimal(10,4), list array<decimal(8,2)>, deep struct<x: decimal(6,2), y: struct<z: array<struct<m: decimal(9,3), t: string>>>, n: bigint>, kv map<string,decimal(5,2)>, d double, flag boolean, plain array<string>"
ROWS = [
    ("r1", D("10.5"), [D("1.00"), None, D("-2.5")], (D("3.25"), ([(D("1.1"), "t"), (None, "u")],), 7), {"b": D("1"), "a": D("2.25"), 'q"x': D("0"), "decimal_paths": D("9")}, 0.5, True, ["1.00"]),
    ("r2", None, None, None, None, None, None, None),
    ('"decimal_paths":[["a"]],"', D("0"), [], (None, None, None), {}, -1e300, False, []),
]


@pytest.fixture(scope="module")
def records(spark):
    df = spark.createDataFrame(ROWS, NESTED)
    return df, df.select("id", codec.encoded(df, *df.columns).alias("text")).cache()


def test_nested_amounts_go_there_and_back(records):
    df, texts = records
    back = texts.select(codec.decoded(F.col("text"), df.schema).alias("r")).select("r.*")
    assert back.collect() == df.collect() and back.dtypes == df.dtypes
    first = json.loads(texts.first().text)
    assert first["decimal_paths"] == [["a"], ["deep", "x"], ["deep", "y", "z", 0, "m"], ["kv", "a"], ["kv", "b"], ["kv", "decimal_paths"], ["kv", 'q"x'], ["list", 0], ["list", 2]]
    assert first["a"] == "10.50" and first["list"] == ["1.00", None, "-2.50"] and first["plain"] == ["1.00"] and list(first) == sorted(first)


def test_bad_records_are_refused(spark, records):
    df, texts = records
    good = texts.first().text
    read = lambda text: spark.createDataFrame([(text,)], "t string").select(codec.decoded(F.col("t"), df.schema).alias("r")).collect()
    assert read(good)[0].r.id == "r1"
    for old, new, why in (
        ('"id":"r1"', '"it":"r1"', "other fields"),
        ('"id":"r1"', '"id":"r1","more":1', "other fields"),
        ('[["a"],', "[", "paths"),
        ('[["a"],', '[["a"],["a"],', "paths"),
        ('[["a"],', '[["a"],["d"],', "paths"),
        ('["list",0]', '["list",1]', "paths"),
        ('"a":"10.50"', '"a":"10.5"', "two places"),
        ('"a":"10.50"', '"a":"010.50"', "two places"),
        ('"a":"10.50"', '"a":"x"', "two places"),
        ('"d":0.5', '"d":', "record|MALFORMED"),
    ):
        assert old in good
        with pytest.raises(Exception, match=why):
            read(good.replace(old, new, 1))
    with pytest.raises(Exception, match="bad record|MALFORMED"):
        read("not json")


def test_foreign_values_are_refused(spark):
    one = spark.range(1)
    for value in ("cast('x' as binary)", "date '2024-01-01'", "timestamp '2024-01-01 00:00:00'", "map(1, 'x')", "interval 1 day", "struct(array(date '2024-01-01') as x)"):
        df = one.selectExpr(f"{value} as v")
        with pytest.raises(codec.Foreign):
            codec.encoded(df, "v")
    with pytest.raises(codec.Foreign):
        codec.encoded(one.selectExpr("id as decimal_paths"), "decimal_paths")
    for value, why in (("double('nan')", "not finite"), ("double('inf')", "not finite"), ("cast(1.005 as decimal(9,3))", "two places"), ("array(cast(0.0000001 as decimal(20,9)))", "two places")):
        df = one.selectExpr(f"{value} as v")
        with pytest.raises(Exception, match=why):
            df.select(codec.encoded(df, "v")).collect()


@pytest.fixture(scope="module")
def told(spark, tmp_path_factory):
    b, c = testbed.batch(spark, DATA), testbed.cases(spark, DATA)
    run = ladder.run_ladder(b)
    decided = verdicts.verdicts(b, c, run)
    at = str(tmp_path_factory.mktemp("log") / "audit.jsonl")
    return b, c, run, decided, at, journal.record(run, decided, at, b, verdicts.allocations(c, run), "2026-06-01T00:00:00")


def test_records_tell_of_events_and_lines(spark, told):
    b, c, run, decided, at, sealed = told
    read = journal.read(spark, at)
    rows = journal.decisions(read).cache()
    assert rows.count() == sealed.count() and {r.action for r in rows.select("action").distinct().collect()} <= set(journal.ACTIONS)
    event = {r.event_id: r for r in b.ledger.collect()}
    line = {r.detail_id: r for r in b.detail.collect()}
    claims = rows.where("rule like '%/CONFIRMED'").collect()
    assert len(claims) == run.accepted.count()
    for r in claims:
        e, x = event[r.inputs.event_id], line[r.inputs.detail_id]
        assert (r.inputs.event_amount_paise, r.inputs.event_currency, r.inputs.event_type, r.inputs.event_txn_id) == (e.amount_paise, e.currency, e.event_type, e.txn_id)
        assert (r.inputs.line_net_effect_paise, r.inputs.line_type) == (x.net_effect_paise, x.line_type) and r.inputs.line_settled_at == x.settled_at.strftime("%Y-%m-%dT%H:%M:%S")
        assert r.result.event_id == r.inputs.event_id and r.inputs.case_id is None and r.timestamp == "2026-06-01T00:00:00"
    held = {r.inputs.detail_id: r for r in rows.where("rule like '%/abstain'").collect()}
    assert {k: r.inputs.candidate_event_ids for k, r in held.items()} == {r.detail_id: r.candidate_event_ids for r in run.abstentions.collect()}
    assert all(r.inputs.candidate_count == len(r.result.candidates) and r.confidence == 0 for r in held.values())
    final = {r.inputs.case_id: r for r in rows.where("stage = 'S5'").collect()}
    own = {}
    for r in verdicts.allocations(c, run).collect():
        own.setdefault(r.case_id, set()).add((r.event_id, r.settlement_id))
    for r in decided.collect():
        assert final[r.case_id].action == journal.ACTION_BY_OUTCOME[r.outcome] and (final[r.case_id].result.outcome, final[r.case_id].result.category) == (r.outcome, r.category)
        assert [tuple(x) for x in final[r.case_id].inputs.allocations] == sorted(own.get(r.case_id, ())) and final[r.case_id].inputs.allocation_count == len(own.get(r.case_id, ()))


def test_records_leave_out_what_they_do_not_have(told):
    body = json.loads(told[-1].where(F.col("body").contains("exact_join/CONFIRMED")).first().body)
    assert set(body) == {"action", "confidence", "decimal_paths", "decision_id", "inputs", "overridable", "reasoning", "result", "rule", "stage", "subject", "timestamp"}
    assert "case_id" not in body["inputs"] and set(body["result"]) == {"settlement_id", "event_id"}


def test_a_decision_that_cannot_be_audited_stops_the_journal(spark, told):
    _, _, run, decided, *_ = told
    with pytest.raises(Exception, match="no action for outcome MAYBE"):
        journal.build(run, decided.withColumn("outcome", F.lit("MAYBE"))).collect()
    with pytest.raises(Exception, match="confidence out of range"):
        journal.build(run, decided.withColumn("confidence", F.lit(1.5))).collect()
    with pytest.raises(Exception, match="empty subject"):
        journal.build(run, decided.withColumn("case_id", F.lit(""))).collect()


def test_journals_are_found(spark, told, tmp_path):
    for place in ("b/2/audit.jsonl", "a/audit.jsonl"):
        journal.write(told[-1].limit(3), str(tmp_path / place))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "audit.jsonl").write_text("{}\n")
    (tmp_path / "c" / "other.jsonl").write_text("{}\n")
    (tmp_path / "c" / "my-audit.jsonl").write_text("{}\n")
    assert [p.split(tmp_path.name)[1] for p in journal.found(spark, str(tmp_path))] == ["/a/audit.jsonl", "/b/2/audit.jsonl", "/c/audit.jsonl"]


def test_a_chain_of_many_ranges_is_one_chain(spark):
    rows = spark.range(1, 1001).select(F.col("id").alias("seq"), F.concat(F.lit("d"), "id").alias("decision_id"), F.concat(F.lit("körper "), F.col("id") * 7).alias("body")).repartition(5)
    last, want = journal.GENESIS, []
    for n in range(1, 1001):
        before, last = last, hashlib.sha256((last + f"körper {n * 7}").encode()).hexdigest()
        want.append((n, before, last))
    for link in (70, 1000, 250_000):
        sealed = journal.seal(rows, link)
        assert [tuple(r) for r in sealed.orderBy("seq").select("seq", "previous_hash", "record_hash").collect()] == want
        assert journal.breaks(sealed).count() == 0
    assert journal.seal(rows.limit(0)).count() == 0


def test_a_journal_of_many_files_is_written_in_order(spark, tmp_path):
    rows = spark.range(1, 501).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("decision_id"), F.format_string('{"decision_id":"%d"}', "id").alias("body"))
    journal.write(journal.seal(rows, 40), str(tmp_path / "audit.jsonl"))
    lines = [json.loads(line)["seq"] for part in sorted((tmp_path / "audit.jsonl").glob("part-*")) for line in part.read_text().splitlines()]
    assert lines == list(range(1, 501)) and journal.read(spark, str(tmp_path / "audit.jsonl")).count() == 500


def test_each_field_of_a_record_is_written_once(records):
    df, _ = records
    plan = df.select(codec.encoded(df, "id", "flag", "plain", "d").alias("text"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("to_json") == 4
