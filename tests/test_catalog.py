"""Every query with SQL against DuckDB on the smallest tables, the others against plain Python."""

import math
import os

import duckdb
import pytest

from tallyloom.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool | str):
        return x
    return round(float(x), 9)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(plain, r)) for r in df[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(catalog.ORACLE_SQL[name]).df())


def got(spark, name):
    return catalog.QUERIES[name](spark, DATA).collect()


def largest(edges):
    """The size of a largest matching, by plain augmenting paths."""
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    mate = {}

    def augment(a, seen):
        for b in near[a]:
            if b not in seen:
                seen.add(b)
                if b not in mate or augment(mate[b], seen):
                    mate[b] = a
                    return True
        return False

    return sum(augment(a, set()) for a in near)


@pytest.fixture(scope="module")
def refund_edges(duck):
    """(detail_id, event_id, feasible): an edge is feasible if the rest without its ends still matches one less than all."""
    by_amount, out = {}, []
    for r in duck.sql(catalog.ORACLE_SQL["local_survivors"]).fetchall():
        by_amount.setdefault(r[2], []).append(r[:2])
    for edges in by_amount.values():
        most = largest(edges)
        out += [(a, b, largest([(x, y) for x, y in edges if x != a and y != b]) == most - 1) for a, b in edges]
    return out


def test_refund_rung_against_brute_force(spark, duck, refund_edges):
    assert sorted((r.detail_id, r.event_id, r.feasible) for r in got(spark, "global_feasibility")) == sorted(refund_edges)
    allowed = {}
    for a, b, ok in refund_edges:
        allowed.setdefault(a, []).extend([b] * ok)
    claims = got(spark, "ladder_claims")
    assert sorted((r.detail_id, r.event_id) for r in claims if r.pass_name == "refund_corroboration") == sorted((a, b[0]) for a, b in allowed.items() if len(b) == 1)
    exact = duck.sql(catalog.ORACLE_SQL["exact_join_claims"]).df()
    assert sorted(r.detail_id for r in claims if r.pass_name == "exact_join") == sorted(exact.detail_id)
    assert sorted((r.detail_id, r.candidates) for r in got(spark, "ladder_abstentions")) == sorted((a, "|".join(sorted(b))) for a, b in allowed.items() if len(b) != 1)
    counters = {(r.pass_name, r.counter): r.n for r in got(spark, "ladder_counters")}
    gates = dict(duck.sql(catalog.ORACLE_SQL["first_failed_gates"]).fetchall())
    assert {g: n for (p, g), n in counters.items() if g.startswith("gate_") and g < "gate_8" and n} == {g: n for g, n in gates.items() if g != "none"}
    assert counters["refund_corroboration", "candidates_by_amount"] == sum(gates.values())
    assert counters["refund_corroboration", "gate_8_feasibility"] == sum(not ok for *_, ok in refund_edges)
    assert counters["refund_corroboration", "resolved"] == sum(len(b) == 1 for b in allowed.values())


def test_default_queue_ranks_the_default_verdicts(spark):
    rank = [(-r.exposure_paise, r.case_id, r.outcome, r.category) for r in got(spark, "default_verdicts") if r.outcome in ("EXCEPTION", "ABSTAIN")]
    assert [(-r.exposure_paise, r.case_id, r.outcome, r.category) for r in got(spark, "default_queue")] == sorted(rank)
    join_only = {r.case_id: r.exposure_paise for r in got(spark, "case_verdicts")}
    assert all(-x <= join_only[c] for x, c, outcome, _ in rank if outcome == "EXCEPTION")


def test_default_journal_holds_each_decision_once(spark):
    ids = [r.decision_id for r in got(spark, "default_journal")]
    assert len(ids) == len(set(ids)) == len(got(spark, "ladder_claims")) + len(got(spark, "ladder_abstentions")) + len(got(spark, "default_verdicts"))


def test_text_similarity_against_difflib(spark, duck):
    import difflib

    text = dict(duck.sql("select item_id, text from benchmark").fetchall())
    token = {r[0]: r[1] for r in duck.sql(catalog.ORACLE_SQL["jaccard_tokens"]).df()[["item_id", "jaccard"]].itertuples(index=False)}
    for r in got(spark, "lexical_similarity"):
        a, b = text[r.item_id] or "", text[r.item_id + 1] or ""
        want = max(token.get(r.item_id, 0.0), difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()) if a and b else 0.0
        assert math.isclose(r.similarity, want, abs_tol=1e-8)


def test_greedy_and_margins_against_plain_python(spark):
    from tallyloom.operators import baselines
    from tallyloom.plans import testbed

    pairs = baselines.b3_pairs(testbed.batch(spark, DATA)).collect()
    lines = {}
    for r in pairs:
        lines.setdefault((r.input_order, r.settlement_id, r.detail_id), []).append((r.similarity, r.event_id))
    taken, want = set(), []
    for key in sorted(lines):
        if free := [x for x in lines[key] if x[1] not in taken]:
            best = max(free)[1]
            taken.add(best)
            want.append((key[1], best, key[2]))
    assert sorted(tuple(r) for r in got(spark, "b3_greedy")) == sorted(want)
    margins = {}
    for (*_, detail), some in lines.items():
        if len(some) > 1:
            best, second = sorted((x for x, _ in some), reverse=True)[:2]
            margins[detail] = (len(some), best, second)
    assert {r.detail_id: (r.k, r.best, r.second) for r in got(spark, "best_second_margin")} == margins


def test_baselines_on_a_generated_batch(spark):
    s = {r.matcher: r for r in got(spark, "generated_comparison")}
    assert set(s) == {"B1", "B2", "B3", "agent"} and {r.n_cases for r in s.values()} == {300}
    assert s["B1"].n_wrong_claims == s["agent"].n_wrong_claims == 0 and s["B2"].n_wrong_claims > 0
    assert s["B1"].n_correct < s["B2"].n_correct <= s["agent"].n_correct and all(abs(r.accuracy + r.floor - 1) < 1e-12 for r in s.values())


def test_recovered_lines_are_explained(spark):
    plain_ = {r.case_id: r for r in got(spark, "baseline_verdicts")}
    for r in got(spark, "recovered_verdicts"):
        assert r.exposure_paise <= plain_[r.case_id].exposure_paise


def test_apportion_takes_largest_remainders():
    from tallyloom.sources.generator import SHARES, apportion

    assert apportion(10, (1, 1, 1)) == [4, 3, 3]
    assert all(sum(apportion(n, tuple(x for _, x in s))) == n for n in (1, 7, 100, 333) for s in SHARES.values())


def test_scores_of_hand_made_cases(spark):
    from tallyloom.operators import scoring

    key = spark.createDataFrame([("a", "s", "RECONCILED", None), ("b", "s", "NO_ACTION", None), ("c", "t", "EXCEPTION", "X")], "case_id string, scenario string, expected_outcome string, expected_category string")
    decided = spark.createDataFrame([("a", "RECONCILED", None, 0.9), ("c", "EXCEPTION", "Y", 0.6)], "case_id string, outcome string, category string, confidence double")
    pairs = "case_id string, event_id string, settlement_id string"
    want = spark.createDataFrame([("a", str(i), "s") for i in range(8)], pairs)
    have = spark.createDataFrame([("a", str(i), "s") for i in range(7)] + [("a", "wrong", "s")], pairs)
    got = scoring.judged(key, decided, want, have).cache()
    s = scoring.allocation_scores(got).first()
    assert (s.tp, s.fp, s.fn, s.precision, s.recall, s.false_match) == (7, 1, 1, 7 / 8, 7 / 8, 1 / 8)
    a = scoring.abstentions(got).first()
    assert (a.n_abstained, a.n_right, a.n_missed) == (1, 0, 1)
    assert {(r.expected, r.reported, r.n) for r in scoring.confusion(got).collect()} == {("X", "Y", 1)}
    assert [(r.threshold, r.n_kept) for r in scoring.curve(got, [0.0, 0.8, 1.0]).orderBy("threshold").collect()] == [(0.0, 2), (0.8, 1), (1.0, 0)]


def test_overrides_are_checked(spark):
    from tallyloom.operators import journal

    d = spark.createDataFrame([("a", "match", True), ("b", "match", False)], "decision_id string, action string, overridable boolean")
    o = spark.createDataFrame([("a", "abstain", "r"), ("b", "abstain", "r"), ("c", "abstain", "r")], "decision_id string, action string, reason string")
    assert {(r.decision_id, r.why) for r in journal.refused_overrides(d, o).collect()} == {("b", "not overridable"), ("c", "unknown decision")}
    assert {(r.decision_id, r.effective_action) for r in journal.effective(d, o).collect()} == {("a", "abstain"), ("b", "match")}
