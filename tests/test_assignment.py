"""Gate 8 by counts, claims by turns, the third baseline in rounds and settlement deltas against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ambiguity, baselines, feasibility, ladder
from tallyloom.sources.batch import Batch

PAIRS = "amount_paise long, currency string, settled_on date, created_on date, n_lines long, n_events long"


def day(k):
    return datetime.date(2024, 1, 1) + datetime.timedelta(k)


def largest(edges):
    """The size of a largest matching, by plain augmenting paths."""
    near, mate = {}, {}
    for a, b in edges:
        near.setdefault(a, []).append(b)

    def augment(a, seen):
        for b in near[a]:
            if b not in seen:
                seen.add(b)
                if b not in mate or augment(mate[b], seen):
                    mate[b] = a
                    return True
        return False

    return sum(augment(a, set()) for a in near)


@pytest.mark.parametrize("window", [0, 1, 4])
def test_feasible_days_match_forced_edges(spark, window):
    rng, pairs, want, sizes = random.Random(window), [], {}, {}
    for amount in range(250):
        days = rng.choice((3, 8, 20))
        lines = [(i, rng.randrange(days)) for i in range(rng.randint(1, 9))]
        events = [(-j, rng.randrange(days)) for j in range(1, rng.randint(2, 10))]
        edges = [(a, b) for a in lines for b in events if 0 <= a[1] - b[1] <= window]
        if not edges:
            continue
        currency = rng.choice(("INR", "USD"))
        sizes[amount, currency] = best = largest(edges)
        for s, c in {(a[1], b[1]) for a, b in edges}:
            ends = [{x[k] for x in edges} for k in (0, 1)]
            pairs.append((amount, currency, day(s), day(c), sum(x[1] == s for x in ends[0]), sum(x[1] == c for x in ends[1])))
            a, b = next((a, b) for a, b in edges if (a[1], b[1]) == (s, c))
            want[amount, currency, day(s), day(c)] = largest([(x, y) for x, y in edges if x != a and y != b]) == best - 1
    df = spark.createDataFrame(pairs, PAIRS)
    assert {tuple(r[k] for k in feasibility.PAIR): r.feasible for r in feasibility.feasible(df, window).collect()} == want
    assert {(r.amount_paise, r.currency): r.n_matched for r in feasibility.largest(df, window).collect()} == sizes
    assert feasibility.feasible(df.limit(0), window).collect() == []


def test_an_amount_with_a_million_edges(spark):
    """2,000 lines on one day against 500 older and 100 newer events: all are free to choose; a line two days before can only take the older ones."""
    pairs = [(5, "INR", day(4), day(0), 2000, 500), (5, "INR", day(4), day(3), 2000, 100), (5, "INR", day(2), day(0), 500, 500)]
    got = {(r.settled_on, r.created_on): r.feasible for r in feasibility.feasible(spark.createDataFrame(pairs, PAIRS), 4).collect()}
    assert got == {(day(4), day(0)): True, (day(4), day(3)): True, (day(2), day(0)): True}
    tight = [(5, "INR", day(4), day(0), 100, 500), (5, "INR", day(4), day(3), 100, 100), (5, "INR", day(2), day(0), 500, 500)]
    got = {(r.settled_on, r.created_on): r.feasible for r in feasibility.feasible(spark.createDataFrame(tight, PAIRS), 4).collect()}
    assert got == {(day(4), day(0)): False, (day(4), day(3)): True, (day(2), day(0)): True}


def test_claims_by_turns(spark):
    """Events before lines, each by the order of emission; a line that is held takes no event from others."""
    rows = [("s", "e1", "d1", 0), ("s", "e1", "d2", 1), ("s", "e2", "held", 0), ("s", "e2", "d3", 1), ("s", "gone", "d4", 0), ("s", "e3", "held2", 5), ("s", "e3", "d5", 2)]
    claims = spark.createDataFrame(rows, "settlement_id string, event_id string, detail_id string, emit_order long")
    taken = spark.createDataFrame([("gone", "x"), ("y", "held"), ("z", "held2")], "event_id string, detail_id string")
    got = {r.detail_id: r.reason for r in ladder.first_claims(claims, taken).collect()}
    assert got == {"d1": None, "d2": "event e1 already consumed", "held": "line held already attributed", "d3": None, "d4": "event gone already consumed", "held2": "event e3 already consumed", "d5": None}


@pytest.mark.parametrize("seed", range(3))
def test_third_baseline_in_rounds(spark, seed, monkeypatch):
    monkeypatch.setattr(baselines, "AHEAD", 3)
    rng = random.Random(seed)
    lines, ranks, want = [], [], []
    for amount in range(12):
        notes = [None, "", "a", "b", "c", "d"][: rng.randint(1, 6)]
        events = [f"e{amount}-{j}" for j in range(rng.choice((0, 1, 6, 25)))]
        score = {(n, e): rng.choice((0.0, 0.5, 1.0)) if seed else rng.random() for n in notes for e in events}
        own = [(f"s{i % 3}", f"d{amount}-{i}", rng.randrange(10_000), amount, rng.choice(notes)) for i in range(rng.choice((1, 4, 30)))]
        lines += own
        ranks += [(amount, n, e, "p", x) for (n, e), x in score.items()]
        taken = set()
        for s, d, _, _, n in sorted(own, key=lambda x: (x[2], x[0], x[1])):
            if free := [(score[n, e], e) for e in events if e not in taken]:
                taken.add(max(free)[1])
                want.append((s, max(free)[1], d))
    got = baselines.b3_claims(spark.createDataFrame(lines, "settlement_id string, detail_id string, input_order long, amount_paise long, reference_text string"), spark.createDataFrame(ranks, "amount_paise long, reference_text string, event_id string, parent string, similarity double"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_class_is_settled_in_one_round(spark, monkeypatch):
    """A popular amount whose lines all rank alike needs no further round, however many lines there are."""
    rounds, keep = [], baselines.kept
    monkeypatch.setattr(baselines, "kept", lambda df: rounds.append(1) or keep(df))
    lines = spark.range(3000).select(F.lit("s").alias("settlement_id"), F.format_string("d%05d", "id").alias("detail_id"), F.col("id").alias("input_order"), F.lit(7).cast("long").alias("amount_paise"), F.lit("note").alias("reference_text"))
    ranks = spark.range(2000).select(F.lit(7).cast("long").alias("amount_paise"), F.lit("note").alias("reference_text"), F.format_string("e%05d", "id").alias("event_id"), F.lit("p").alias("parent"), F.lit(0.0).alias("similarity"))
    got = baselines.b3_claims(lines, ranks).collect()
    assert sorted((r.detail_id, r.event_id) for r in got) == [(f"d{i:05d}", f"e{1999 - i:05d}") for i in range(2000)]
    assert len(rounds) == 5


LEDGER = "event_id string, event_type string, txn_id string, amount_paise long, status string, created_at timestamp_ntz"
DETAIL = "detail_id string, settlement_id string, event_id string, line_type string, gross_effect_paise long"


def at(k, hour=10):
    return datetime.datetime(2024, 1, 1, hour) + datetime.timedelta(k)


def test_settlement_deltas(spark):
    ledger = [("p1", "PAYMENT", "t1", 900, "PROCESSED", at(0)), ("p2", "PAYMENT", "t2", 900, "CAPTURED", at(0)), ("p3", "PAYMENT", "t3", 50, "PROCESSED", at(0))]
    ledger += [("r1", "REFUND", "t1", 50, "PROCESSED", at(6)), ("r2", "REFUND", "t1", 50, "PROCESSED", at(10)), ("r3", "REFUND", "t2", 50, "PROCESSED", at(9)), ("r4", "REFUND", "t1", 50, "PROCESSED", at(11, 1)), ("r5", "REFUND", "t1", 50, "PROCESSED", at(9)), ("r6", "REFUND", "t3", 50, "PROCESSED", at(9)), ("r7", "REFUND", "t1", 70, "PROCESSED", at(9)), ("r8", "REFUND", "t1", 50, "PROCESSED", at(5))]
    detail = [("d1", "s1", "p1", "PAYMENT", 900), ("d2", "s1", "r5", "REFUND", -50), ("d3", "s1", None, "REFUND", -50), ("d4", "s2", "p2", "PAYMENT", 900), ("d5", "s3", None, "REFUND", -70), ("d6", "s4", "r7", "REFUND", -70)]
    summary = [("s1", day(10), 100), ("s2", day(10), 0), ("s3", day(30), 70), ("s4", day(10), 60), ("s5", day(10), 999), ("s6", None, 50), ("s7", day(10), None)]
    none = spark.createDataFrame([], "utr string")
    batch = Batch(spark.createDataFrame(ledger, LEDGER), spark.createDataFrame(detail, DETAIL), none, spark.createDataFrame(summary, "settlement_id string, settlement_date date, refund_paise long"), none, none)
    found = ambiguity.candidates(batch).cache()
    # of r1 to r8 at 50: r2 and r1 are free, in time (r1 on the last day) and of a settled payment; r3, r6 are not, r4 is late, r5 is named, r8 is old
    assert {tuple(r) for r in found.collect()} == {("s1", 50, 7, 2), ("s3", 70, 1, 0), ("s5", 999, 0, 0), ("s6", 50, 7, 0)}
    assert {tuple(r) for r in ambiguity.histogram(found).collect()} == {("amount", 7, 2), ("amount", 1, 1), ("amount", 0, 1), ("gates", 2, 1), ("gates", 0, 3)}
    assert tuple(ambiguity.rates(found).first()) == (4, 2, 0.5, 1, 0.25, 13)
    assert tuple(ambiguity.rates(found.limit(0)).first()) == (0, 0, 0.0, 0, 0.0, 0)


def test_raw_scan_for_deltas(spark, tmp_path):
    """Repeats by detail_id go across settlements, and nothing is refused."""
    (tmp_path / "gateway_ledger.csv").write_text("event_id,event_type,txn_id,order_id,amount_paise,currency,status,created_at,method\np1,PAYMENT,t1,o,900,INR,PROCESSED,2024-01-01T10:00:00,upi\nr1,REFUND,t1,o,50,INR,STRANGE,2024-01-09T10:00:00,upi\nr1,REFUND,t1,o,50,INR,PROCESSED,2024-01-09T10:00:00,upi\nbad,REFUND,t1,o,x,INR,PROCESSED,never,upi\n")
    (tmp_path / "settlement_detail.csv").write_text("detail_id,settlement_id,event_id,line_type,gross_effect_paise,fee_paise,tax_paise,net_effect_paise,settled_at,currency,reference_text\nd1,s1,p1,PAYMENT,900,0,0,900,2024-01-02T10:00:00,INR,\nd2,s1,,REFUND,-50,0,0,-50,2024-01-10T10:00:00,INR,\nd2,s2,r9,REFUND,-50,0,0,-50,2024-01-10T10:00:00,INR,\n")
    (tmp_path / "settlement_summary.csv").write_text("settlement_id,utr,settlement_date,gross_payment_paise,refund_paise,fee_paise,tax_paise,net_amount_paise,line_count,currency,status\ns1,u1,2024-01-10,900,50,0,0,850,2,INR,PROCESSED\ns2,u2,2024-01-10,0,50,0,0,-50,1,INR,PROCESSED\n")
    found = ambiguity.candidates(ambiguity.load(spark, str(tmp_path)))
    assert {tuple(r) for r in found.collect()} == {("s1", 50, 2, 2), ("s2", 50, 2, 2)}


def test_lexical_panel_and_hits(spark):
    pairs = [("s1", "d1", 1, 5, "red shoe worn", "e1", "red boot", 0.5), ("s1", "d1", 1, 5, "red shoe worn", "e2", "red shoe", 0.75), ("s1", "d2", 2, 5, None, "e1", "red boot", 0.0), ("s1", "d2", 2, 5, None, "e2", "red shoe", 0.0), ("s2", "d3", 3, 6, "x", "e9", "x", 1.0)]
    df = spark.createDataFrame(pairs, "settlement_id string, detail_id string, input_order long, amount_paise long, reference_text string, event_id string, parent string, similarity double")
    assert tuple(baselines.panel(df).first()) == (2, 0.125, 0.25, 2)
    assert tuple(baselines.panel(df.where("detail_id = 'd3'")).first()) == (0, 0.0, 0.0, 0)
    right = spark.createDataFrame([("s1", "e2"), ("s2", "e9"), ("s9", "e1")], "settlement_id string, event_id string")
    assert tuple(baselines.hit_rate(df, right).first()) == (2, 2, 1.0, 0.5)
    assert tuple(baselines.hit_rate(df, right.limit(0)).first()) == (0, 0, 0.0, 0.0)


def test_a_parent_is_the_first_payment_of_the_ledger(spark):
    rows = [("z", "PAYMENT", "t1", "first", 1), ("a", "PAYMENT", "t1", "second", 2), ("b", "PAYMENT", "t2", None, 3), ("c", "PAYMENT", "t2", "later", 4), ("d", "REFUND", "t3", "none", 5)]
    batch = Batch(spark.createDataFrame(rows, "event_id string, event_type string, txn_id string, description string, input_order long"), *[None] * 5)
    assert {tuple(r) for r in baselines.described(batch).collect()} == {("t1", "first"), ("t2", None)}


def test_contested_lines_are_never_paired(spark):
    """Twenty thousand lines of one amount beside as many refunds: 4e8 pairs, which the answers by note and description do not make."""
    n = 20_000
    detail = spark.range(n).select(F.concat(F.lit("s"), F.col("id")).alias("settlement_id"), F.concat(F.lit("d"), F.col("id")).alias("detail_id"), F.lit(None).cast("string").alias("event_id"), F.lit("REFUND").alias("line_type"), F.lit(-700).cast("long").alias("gross_effect_paise"), F.lit(1).alias("input_order"), F.when(F.col("id") % 2 == 0, "red shoe").alias("reference_text"))
    refunds = spark.range(n).select(F.concat(F.lit("r"), F.col("id")).alias("event_id"), F.lit("REFUND").alias("event_type"), F.concat(F.lit("t"), F.col("id") % 4).alias("txn_id"), F.lit(700).cast("long").alias("amount_paise"), F.lit(None).cast("string").alias("description"))
    paid = spark.createDataFrame([("p0", "PAYMENT", "t0", 9, "red shoe"), ("p1", "PAYMENT", "t1", 9, "blue coat")], "event_id string, event_type string, txn_id string, amount_paise long, description string")
    batch = Batch(refunds.unionByName(paid), detail, *[None] * 4)
    choices = baselines.b3_choices(batch).cache()
    assert choices.count() == 6
    assert {tuple(r) for r in baselines.line_separation(batch, choices).groupBy("k", "best", "second").count().collect()} == {(n, 1.0, 1.0, n // 2), (n, 0.0, 0.0, n // 2)}
    assert tuple(baselines.panel(choices, baselines.b3_lines(batch)).first()) == (n, 0.0, 0.0, 2)
    right = spark.range(n).select(F.concat(F.lit("s"), F.col("id")).alias("settlement_id"), F.concat(F.lit("r"), F.col("id")).alias("event_id"))
    # the most similar refund of a line with a note is r9996, the last of those whose parent has its text; of one without, r9999
    assert tuple(baselines.line_hit_rate(batch, choices, right).select("n_lines", "n_hits").first()) == (n, 2)
    assert {tuple(r) for r in ladder.n_candidates(batch).groupBy("n_candidates").count().collect()} == {(n, n)}
    assert [tuple(r) for r in baselines.multiplicity_by_amount(batch, "x").collect()] == [(n, n, "x")]


def test_choices_answer_as_pairs_do(spark):
    from tallyloom.plans import testbed

    batch = testbed.batch(spark, "/root/testdata/sf0.001")
    choices, pairs = baselines.b3_choices(batch), baselines.b3_pairs(batch).cache()
    assert sorted(map(tuple, baselines.line_separation(batch, choices).collect())) == sorted(map(tuple, baselines.separation(pairs).collect()))
    assert tuple(baselines.panel(choices, baselines.b3_lines(batch)).first()) == pytest.approx(tuple(baselines.panel(pairs).first()))
    own = batch.detail.where("event_id is null and line_type = 'REFUND'").select("settlement_id", F.concat(F.lit("R"), "detail_id").alias("event_id"))
    assert tuple(baselines.line_hit_rate(batch, choices, own).first()) == pytest.approx(tuple(baselines.hit_rate(pairs, own).first()))


def test_contested_amounts_take_turns_in_one_round(spark, monkeypatch):
    """Two classes that chase each other down their lists, some twenty thousand places, are settled without further rounds."""
    rounds, keep = [], baselines.kept
    monkeypatch.setattr(baselines, "kept", lambda df: rounds.append(1) or keep(df))
    n = 5000
    lines = spark.range(n).select(F.lit("s").alias("settlement_id"), F.format_string("d%05d", "id").alias("detail_id"), F.col("id").alias("input_order"), F.lit(7).cast("long").alias("amount_paise"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("reference_text"))
    rank = lambda note, score: spark.range(n).select(F.lit(7).cast("long").alias("amount_paise"), F.lit(note).alias("reference_text"), F.format_string("e%05d", "id").alias("event_id"), F.lit("p").alias("parent"), score.cast("double").alias("similarity"))
    ranks = rank("a", F.lit(0.0)).unionByName(rank("b", F.when(F.col("id") == 0, 1.0).otherwise(0.0)))
    got = {r.detail_id: r.event_id for r in baselines.b3_claims(lines, ranks).collect()}
    want = ["e04999", "e00000", *(f"e{i:05d}" for i in range(n - 2, 0, -1))]
    assert got == {f"d{i:05d}": e for i, e in enumerate(want)}
    assert len(rounds) == 5
