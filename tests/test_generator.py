"""The generator's draws, plan and proofs, the catalogue, and orders of whole tables."""

import collections
import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ladder
from tallyloom.plans import holdout
from tallyloom.sources import batch as B
from tallyloom.sources import catalogue, generator, ordering, proof


@pytest.fixture(scope="module")
def data(spark):
    return generator.generate(spark, generator.Config(500, 7, "development"))


def test_draws_follow_their_weights(spark):
    d, n = generator.Draws(5), 200_000
    names, weights = tuple(m[0] for m in generator.METHODS), tuple(m[2] for m in generator.METHODS)
    rows = spark.range(n).select(d.weighted(names, weights, "method", "id").alias("method"), d.amount(0.45, "id").alias("paise"), d.amount(0.0, "id").alias("drawn"), d.uniform("u", "id").alias("u")).cache()
    shares = {r.method: r["count"] / n for r in rows.groupBy("method").count().collect()}
    assert all(abs(shares[m] - w) < 0.006 for m, w in zip(names, weights, strict=True))
    points = [p * 100 for p in generator.PRICE_POINTS]
    assert 0.45 <= rows.where(F.col("paise").isin(points)).count() / n < 0.47
    for low, high, weight in generator.BANDS:
        assert abs(rows.where(F.col("drawn").between(low * 100, high * 100 - 1)).count() / n - weight) < 0.006
    assert abs(rows.where("drawn % 100 = 0").count() / n - (0.6 + 0.4 / 100)) < 0.006
    s = rows.agg(F.min("u"), F.max("u"), F.avg("u"), F.countDistinct("u")).first()
    assert 0 <= s[0] < 0.001 and 0.999 < s[1] < 1 and abs(s[2] - 0.5) < 0.003 and s[3] == n
    hot = rows.groupBy("paise").count().agg(F.max("count")).first()[0]
    assert hot > n * 0.45 / 33 * 0.9


def test_draws_depend_on_seed_and_salt_alone(spark):
    row = lambda seed, salt: [r[0] for r in spark.range(50).repartition(7).select(generator.Draws(seed).below(1000, salt, "id").alias("x"), "id").orderBy("id").collect()]
    assert row(1, "a") == row(1, "a") and row(1, "a") != row(2, "a") != row(2, "b")


@pytest.mark.parametrize("records", [3, 4, 6, 7, 30, 61, 333, 1000])
@pytest.mark.parametrize("family", ["primary", "stress"])
def test_sizes_add_up(spark, records, family):
    config = generator.Config(records, records, family)
    try:
        rows = generator.plan(spark, config).collect()
    except ValueError as e:
        assert "do not fit" in str(e) and records < 60
        return
    assert sum(r["size"] for r in rows) == records and len(rows) == config.cases
    least = {"CONTESTED_REFUND": 5, "DESCRIBED_REFUND": 4}
    assert all(least.get(r.scenario, 3) <= r["size"] <= 7 for r in rows)
    counts = generator.scenario_counts(config)
    assert collections.Counter(r.scenario for r in rows) == {k: n for k, n in counts.items() if n}
    for name, n in counts.items():
        assert sorted(r.ordinal for r in rows if r.scenario == name) == list(range(n))
    groups = collections.Counter(r.grp for r in rows if r.scenario == "AMBIGUOUS_REFUND")
    assert all(n in (2, 3) or len(groups) == 1 for n in groups.values())
    assert all(r["size"] >= 4 for r in rows if r.scenario == "AMBIGUOUS_REFUND" and r.single)


def test_seeds_give_permutations(spark):
    places = lambda seed: [r.place for r in ordering.permuted(spark.range(500).repartition(6), seed, "id").orderBy("id").collect()]
    one, again, other = places(1), places(1), places(2)
    assert one == again != other and sorted(one) == sorted(other) == list(range(500)) and one != sorted(one)


def test_places_with_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(3, "c"), (None, "d"), (1, "a"), (2, "b")], "a int, b string")
    assert {r.b: r.place for r in ordering.placed(df, F.asc_nulls_last("a")).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert ordering.placed(df.limit(0), "a").collect() == []


def test_units_go_to_the_largest_remainders(spark):
    some = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", None), ("e", 0)], "k string, n long")
    got = lambda df, total: {r.k: r.units for r in ordering.apportioned(df, total, "n", "k").collect()}
    assert got(some, 10) == {"a": 4, "b": 3, "c": 3, "d": 0, "e": 0} and sum(got(some, 0).values()) == 0
    assert got(some.where("k in ('d', 'e')"), 10) == {"d": 0, "e": 0} and got(some.limit(0), 10) == {}
    for family, shares in generator.SHARES.items():
        table = spark.createDataFrame([(f"{i:02d}", n) for i, (_, n) in enumerate(shares)], "k string, n long")
        for total in (7, 33, 101):
            assert [u for _, u in sorted(got(table, total).items())] == generator.apportion(total, tuple(n for _, n in shares)), family


def test_bounds_are_refused():
    for wrong in ({"records": 2}, {"family": "other"}, {"horizon_days": 0}, {"lag_days": -1}, {"window_days": -1}, {"price_point_share": 1.5}):
        with pytest.raises(ValueError, match="out of bounds"):
            generator.Config(**wrong)


def test_a_batch_bears_out_its_key(spark, data):
    assert data.batch.ledger.count() == data.batch.ledger.select("event_id").distinct().count() == 500
    proof.proven(data.batch, data.key_cases, data.key_allocations)
    run = ladder.run_ladder(data.batch)
    of = data.key_cases.select("scenario", F.explode("settlement_ids").alias("settlement_id"))
    held = {r.scenario for r in run.abstentions.join(of, "settlement_id").select("scenario").distinct().collect()}
    assert held == {"AMBIGUOUS_REFUND", "DESCRIBED_REFUND"}
    right = data.key_allocations.select("event_id", "settlement_id").distinct()
    assert run.accepted.join(right, ["event_id", "settlement_id"], "left_anti").count() == 0


def test_files_are_read_back(spark, data, tmp_path):
    generator.write(data, str(tmp_path))
    read = B.load_batch(spark, str(tmp_path))
    assert read.ledger.count() == 500 and read.detail.count() == data.batch.detail.count() and read.duplicates.agg(F.sum("n_duplicates")).first()[0] == 18
    (line,) = spark.read.text(f"{tmp_path}/dataset_meta.json").collect()
    meta = json.loads(line.value)
    assert meta["rows.gateway_events"] == "500" and meta["scenario.CONTESTED_REFUND"] == "14" and meta["outcome.ABSTAIN"] == "8"
    (config,) = spark.read.option("header", True).csv(f"{tmp_path}/batch_config.csv").collect()
    assert (config.batch_id, config.n_gateway_events, config.n_cases) == ("batch_development_7", "500", "100")
    ids = [r.event_id for r in read.ledger.orderBy("input_order").collect()]
    cases = {e: r.case_id for r in data.cases.collect() for e in r.event_ids}
    assert sum(cases[a] == cases[b] for a, b in zip(ids, ids[1:], strict=False)) < 60, "cases lie together in the file"


def changed(data, **tables):
    return dataclasses.replace(data.batch, **tables)


def rules(batch, data, key=None, pairs=None):
    found = proof.violations(batch, data.key_cases if key is None else key, data.key_allocations if pairs is None else pairs).collect()
    return collections.Counter(r.rule for r in found)


def test_planted_violations_are_found(spark, data):
    scenario = {s: r.scenario for r in data.key_cases.collect() for s in r.settlement_ids}
    pick = lambda name: data.batch.detail.where("event_id is null").where(F.col("settlement_id").isin([s for s, n in scenario.items() if n == name])).orderBy("detail_id").first()
    contested, ambiguous, described = pick("CONTESTED_REFUND"), pick("AMBIGUOUS_REFUND"), pick("DESCRIBED_REFUND")
    lines, ledger = data.batch.detail, data.batch.ledger
    note = lambda line, text: changed(data, detail=lines.withColumn("reference_text", F.when(F.col("detail_id") == line.detail_id, text).otherwise(F.col("reference_text"))))
    assert rules(note(ambiguous, "nothing of note"), data) == {"an ambiguous or described line's note is about a kind of goods": 1, "an ambiguous line's note names all refunds left": 1}
    assert rules(note(described, "nothing of note"), data) == {"an ambiguous or described line's note is about a kind of goods": 1, "a described line's note names one refund left": 1}
    gone = changed(data, detail=lines.where(F.col("detail_id") != contested.detail_id))
    assert rules(gone, data) == {"a case has its number of anonymous lines": 1}
    # the contested line's refund is made too old, so none is left
    amount = -contested.gross_effect_paise
    old = changed(data, ledger=ledger.withColumn("created_at", F.when(F.col("amount_paise") == amount, F.col("created_at") - F.expr("interval 90 days")).otherwise(F.col("created_at"))))
    assert rules(old, data)["a contested line has one refund left"] == 1
    # a second refund of that amount, free and in time
    twin = ledger.where((F.col("amount_paise") == amount) & (F.col("event_type") == "REFUND")).join(data.key_allocations.where(F.col("settlement_id") == contested.settlement_id).select("event_id").distinct(), "event_id").withColumn("event_id", F.lit("evt_twin")).select(ledger.columns)
    assert rules(changed(data, ledger=ledger.unionByName(twin)), data)["a contested line has one refund left"] == 1
    # answers moved elsewhere
    moved = data.key_allocations.where(F.col("settlement_id") != contested.settlement_id)
    assert rules(data.batch, data, pairs=moved) == {"a contested line's refund is allocated to its settlement alone": 1}
    wide = data.key_allocations.select("event_id", "settlement_id").unionByName(data.key_allocations.where(F.col("settlement_id") == contested.settlement_id).select("event_id", F.lit("setl_other").alias("settlement_id")))
    assert rules(data.batch, data, pairs=wide)["a contested line's refund is allocated to its settlement alone"] == 1
    # a contested case called ambiguous: amounts of two kinds meet nowhere, but its line has one refund left
    case = next(r.case_id for r in data.key_cases.collect() if contested.settlement_id in r.settlement_ids)
    renamed = data.key_cases.withColumn("scenario", F.when(F.col("case_id") == case, "AMBIGUOUS_REFUND").otherwise(F.col("scenario")))
    assert rules(data.batch, data, key=renamed)["an ambiguous or described line has two refunds left or more"] == 1
    # one of an ambiguous pair called described: the amount is of two kinds
    case = next(r.case_id for r in data.key_cases.collect() if ambiguous.settlement_id in r.settlement_ids)
    renamed = data.key_cases.withColumn("scenario", F.when(F.col("case_id") == case, "DESCRIBED_REFUND").otherwise(F.col("scenario")))
    assert rules(data.batch, data, key=renamed)["amounts of contested, ambiguous and described cases are apart"] == 2
    with pytest.raises(proof.Unproven, match="number of anonymous lines"):
        proof.proven(gone, data.key_cases, data.key_allocations)


def test_the_two_vocabularies_share_no_word(spark):
    products, notes = (catalogue.frame(spark, t) for t in (catalogue.PRODUCTS, catalogue.NOTES))
    assert {c: len(t) for c, t in catalogue.PRODUCTS.items()} == dict.fromkeys(catalogue.CATEGORIES, 4) and {c: len(t) for c, t in catalogue.NOTES.items()} == dict.fromkeys(catalogue.CATEGORIES, 3)
    catalogue.proven(products, notes)
    assert catalogue.silent(notes, products).count() == 24
    planted = notes.unionByName(spark.createDataFrame([("FOOD", "refund against tea, spilled")], "category string, text string"))
    assert [tuple(r) for r in catalogue.leaks(products, planted).collect()] == [("tea", "FOOD", "refund against tea, spilled", 1, "Redleaf assam tea")]
    with pytest.raises(catalogue.Leak, match="'tea'"):
        catalogue.proven(products, planted)
    with pytest.raises(catalogue.Leak, match="TOYS"):
        catalogue.proven(products, notes.unionByName(spark.createDataFrame([("TOYS", "zzz qqq")], "category string, text string")))
    texts = spark.createDataFrame([("Redleaf assam tea",), ("redleaf assam tea",), (None,)], "t string")
    assert [r.category for r in catalogue.categorised(texts, "t").collect()] == ["FOOD", None, None]


def test_held_out_seeds(spark):
    rows = holdout.by_seed(spark, (70_001, 70_002), generator.Config(150, family="primary")).cache()
    got = {r.seed: r for r in rows.collect()}
    assert set(got) == {70_001, 70_002} and all(r.n_cases == 30 and r.fp == 0 and r.precision == 1.0 for r in got.values())
    spread = {r.measure: r for r in holdout.spread(rows).collect()}
    assert spread["n_correct"].least == min(r.n_correct for r in got.values()) and spread["recall"].mean == pytest.approx(sum(r.recall for r in got.values()) / 2)
    with pytest.raises(ValueError, match="no seeds"):
        holdout.by_seed(spark, ())
