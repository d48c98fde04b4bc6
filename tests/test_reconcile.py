import pytest
from pyspark.sql import functions as F

from tallyloom.operators import evidence, journal, scoring, verdicts
from tallyloom.operators.ladder import DEFAULT, JOIN_ONLY, run_ladder
from tallyloom.sources import batch as B
from tallyloom.sources import catalogue, generator


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("batch"))
    generator.write(generator.generate(spark, generator.Config(500, 42, "primary")), at)
    return at


def outcomes(spark, at, residual=None):
    r = verdicts.reconcile(spark, at, DEFAULT, residual)
    key, pairs = B.load_answer_key(spark, at)
    want = verdicts.bridge(key).join(pairs, "settlement_id").select("case_id", "event_id", "settlement_id")
    return r, scoring.judged(key, r.verdicts, want, r.allocations).cache()


def test_all_but_described_cases_are_right_without_a_reader(spark, made):
    _, rows = outcomes(spark, made)
    wrong = {(x.scenario, x.outcome, x.category) for x in rows.where("not correct").collect()}
    assert wrong == {("DESCRIBED_REFUND", "ABSTAIN", "AMBIGUOUS_REFUND")}
    assert scoring.allocation_scores(rows).first().fp == 0


def test_reader_resolves_described_cases(spark, made):
    _, rows = outcomes(spark, made, evidence.adjudication(catalogue.by_category))
    assert rows.where("not correct").count() == 0
    assert rows.where("scenario = 'DESCRIBED_REFUND' and confidence < 1").count() == 6


def test_declining_reader_changes_nothing(spark, made):
    _, rows = outcomes(spark, made, evidence.adjudication())
    assert rows.where("not correct").count() == 6


def test_join_only_ladder_leaves_anonymous_lines(spark, made):
    batch = B.load_batch(spark, made)
    run = run_ladder(batch, JOIN_ONLY)
    assert run.abstentions.count() == 0
    assert run.accepted.count() == batch.detail.where("event_id is not null").count()


def test_journal_seals_verifies_and_shows_tampering(spark, made, tmp_path):
    r, _ = outcomes(spark, made)
    rows = journal.numbered(journal.build(r.run, r.verdicts)).cache()
    assert journal.duplicates(rows).count() == 0
    sealed = journal.seal(rows).cache()
    n = sealed.count()
    assert sorted(x.seq for x in sealed.select("seq").collect()) == list(range(1, n + 1))
    journal.write(sealed, str(tmp_path / "audit.jsonl"))
    assert journal.read(spark, str(tmp_path / "audit.jsonl")).count() == n
    bad = sealed.withColumn("body", F.when(F.col("seq") == 3, "{}").otherwise(F.col("body")))
    assert [(x.seq, x.broken) for x in journal.breaks(bad).collect()] == [(3, "record")]
    with pytest.raises(journal.Tampered):
        journal.verify(bad)


def test_queue_is_ranked_and_written_inert(spark, made, tmp_path):
    r, _ = outcomes(spark, made)
    q = verdicts.ranked(verdicts.queue(r.verdicts, r.cases)).collect()
    assert [(-x.exposure_paise, x.case_id) for x in q] == sorted((-x.exposure_paise, x.case_id) for x in q)
    assert {x.outcome for x in q} == {"EXCEPTION", "ABSTAIN"}
    verdicts.write_queue(verdicts.queue(r.verdicts, r.cases), str(tmp_path / "q"))
    assert spark.read.option("header", True).csv(str(tmp_path / "q")).count() == len(q)


@pytest.mark.parametrize("cell", ["1_000", "+500", "1,000", "1e3", "1234.56", "١٢٣", "12\n3"])
def test_bad_money_is_refused(spark, cell):
    from tallyloom.functions import scalars as S

    assert spark.createDataFrame([(cell,)], "c string").select(S.money(F.col("c")).alias("m")).first().m is None


@pytest.mark.parametrize("cell", ["2026-06-05T23:30:00-08:00", "2026-06-05T23:30:00Z", "2026-13-05T23:30:00", "x"])
def test_bad_times_are_refused(spark, cell):
    from tallyloom.functions import scalars as S

    assert spark.createDataFrame([(cell,)], "c string").select(S.timestamp(F.col("c")).alias("t")).first().t is None


def test_missing_column_and_duplicate_key_are_refused(spark, tmp_path):
    (tmp_path / "pricing_rules.csv").write_text("method,fee_rate_bps\nupi,0\n")
    with pytest.raises(B.InvalidInput, match="gst_rate_bps"):
        B.load_pricing(spark, str(tmp_path / "pricing_rules.csv"))
    (tmp_path / "b.csv").write_text("bank_row_id,utr,posted_at,credit_amount_paise,currency\na,u,2026-06-01T10:00:00,5,INR\na,u,2026-06-01T10:00:00,5,INR\n")
    with pytest.raises(B.InvalidInput, match="duplicate"):
        B.load_bank(spark, str(tmp_path / "b.csv"))
