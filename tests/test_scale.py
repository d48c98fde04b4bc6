"""Steps that must not grow faster than their input."""

from tallyloom.sources import catalogue


def test_words_are_counted_without_their_texts(spark):
    """A text goes through a shuffle once, to be told from its copies, and not with each of its words."""
    long = " ".join(f"w{i}" for i in range(300))
    notes = spark.createDataFrame([("en", long), ("en", long), ("en", "w1 other"), ("de", "w1 w1"), (None, "w2"), ("de", None)], "category string, text string")
    products = spark.createDataFrame([("b", "w1 w2"), ("c", "w2 w2"), ("b", None)], "category string, text string")
    counted = catalogue.leak_counts(products, notes)
    assert {tuple(r) for r in counted.collect()} == {("w1", "en", 2, 1, "w1 w2"), ("w1", "de", 1, 1, "w1 w2"), ("w2", "en", 1, 2, "w1 w2"), ("w2", None, 1, 2, "w1 w2")}
    plan = notes.sparkSession._jvm.PythonSQLUtils.explainString(catalogue.index(notes)._jdf.queryExecution(), "simple")
    exchanges = [i for i, line in enumerate(plan.splitlines()) if "Exchange" in line]
    generates = [i for i, line in enumerate(plan.splitlines()) if "Generate" in line]
    assert generates and exchanges and max(generates) < min(exchanges)


def test_lines_are_shuffled_once(spark):
    from tallyloom.plans import testbed as T

    T.views(spark, "/root/testdata/sf0.001", "words_t")
    for name in ("first_t", "duplicates_t"):
        plain, quick = (spark.sql(T.with_views(f"select * from {name}", name, views=v)) for v in (T.VIEWS, T.SPARK_VIEWS))
        assert quick.exceptAll(plain).count() == plain.exceptAll(quick).count() == 0
    first = spark.sql(T.with_views("select * from first_t", "first_t", views=T.SPARK_VIEWS))
    plan = spark._jvm.PythonSQLUtils.explainString(first._jdf.queryExecution(), "simple")
    assert sum("Exchange" in line for line in plan.splitlines()) == 2


def test_candidates_are_not_kept_with_each_line(spark, monkeypatch):
    """Lines of an amount and day share their candidates, which are kept once and joined last."""
    from tallyloom.operators import ladder
    from tallyloom.plans import testbed as T

    seen, keep = [], ladder.kept
    monkeypatch.setattr(ladder, "kept", lambda df: seen.append(df.schema) or keep(df))
    ladder.run_ladder(T.batch(spark, "/root/testdata/sf0.001"))
    lists = [s.names for s in seen if any("array" in f.dataType.simpleString() for f in s.fields)]
    assert lists and not any("detail_id" in names for names in lists)


def test_days_out_of_the_window_are_counted_and_not_paired(spark):
    """An amount with 300 days of lines and 300 of events makes pairs of days within the window only; null days are judged by the other gates."""
    from tallyloom.operators import ladder
    from tallyloom.plans import testbed as T

    days = "timestamp'2020-01-01' + make_interval(0, 0, 0, cast(id as int))"
    batch = T.batch(spark, "/root/testdata/sf0.001")
    line = spark.range(301).selectExpr("concat('d', id) as detail_id", "'s' as settlement_id", "cast(null as string) as event_id", "'REFUND' as line_type", "-5L as gross_effect_paise", f"case when id < 300 then {days} end as settled_at", "'INR' as currency", "0L as fee_paise", "0L as tax_paise", "-5L as net_effect_paise", "1 as input_order")
    event = spark.range(301).selectExpr("concat('r', id) as event_id", "'REFUND' as event_type", "'t' as txn_id", "5L as amount_paise", "'INR' as currency", f"case when id < 300 then {days} end as created_at", "'PROCESSED' as status", "'m' as method")
    import dataclasses

    found = ladder.gated(dataclasses.replace(batch, ledger=event, detail=line), None)
    near = sum(min(i, 4) + 1 for i in range(300))
    assert found.classes.count() == near + 601
    assert {tuple(r) for r in found.counts().collect()} == {("gate_3_window", 300 * 300 - near), ("gate_5_lineage", near + 601)}


def test_lines_are_dealt_by_their_number(spark):
    """A task numbers so many lines at most, whatever the session's partitions; an order's lines stay together."""
    from tallyloom.plans import testbed as T

    lines = spark.range(4000).selectExpr("id div 4 as l_orderkey", "id")
    assert T.spread(lines, 100).rdd.getNumPartitions() == 40
    assert T.spread(lines, 10_000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert T.spread(lines, 100).selectExpr("l_orderkey", "spark_partition_id() as task").distinct().count() == 1000


def test_ranks_ask_for_ledger_and_lines_alone(spark):
    """The second baseline neither makes totals and bank rows nor joins settlements to themselves, with equal claims."""
    from pyspark.sql import functions as F

    from tallyloom.operators import baselines
    from tallyloom.plans import testbed as T

    batch = T.sides(spark, "/root/testdata/sf0.001")
    assert batch.summary is batch.bank is None
    batch = type(batch)(batch.ledger, batch.detail.withColumn("settlement_id", F.when(F.col("input_order") > 1, F.col("settlement_id"))), None, None, None, None)
    order = batch.detail.select("settlement_id").distinct().withColumn("visit", F.col("settlement_id"))
    plain, quick = baselines.b2_claims(batch, order), baselines.b2_claims(batch)
    assert quick.count() and quick.exceptAll(plain).count() == plain.exceptAll(quick).count() == 0


def test_permutation_is_the_order_of_its_hash(spark, monkeypatch):
    """Places follow the hash and the key; the rows are computed once and not sampled before."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window as W

    from tallyloom.sources import ordering

    seen = []
    monkeypatch.setattr(ordering, "placed", lambda *a, **k: seen.append(a))
    df = spark.range(10_000).selectExpr("id as a", "id % 7 as b")
    got = ordering.permuted(df, 5, "a", "b", name="turn")
    want = df.withColumn("turn", (F.row_number().over(W.orderBy(F.xxhash64(F.lit(5), "a", "b"), "a", "b")) - 1).cast("long"))
    assert not seen and got.columns == want.columns
    assert got.count() == 10_000 and want.exceptAll(got).isEmpty()


def test_findings_and_named_claims_are_found_once(spark, monkeypatch):
    """Four matchers share the findings of a batch and the wrong claims of its named lines, with the scores that each has by itself; lines are told from their copies once."""
    from tallyloom.operators import baselines, controls
    from tallyloom.sources import batch as sources
    from tallyloom.sources import generator

    data = generator.generate(spark, generator.Config(400, 7, "primary"))
    first, again = sources.keep_first(data.raw_detail)
    assert data.batch.detail.exceptAll(first).isEmpty() and first.exceptAll(data.batch.detail).isEmpty()
    assert {tuple(r) for r in data.batch.duplicates.collect()} == {tuple(r) for r in again.collect()} != set()
    assert "Window" not in data.batch.detail._jdf.queryExecution().optimizedPlan().toString()
    b, calls, lines = data.batch, [], controls.line_findings
    monkeypatch.setattr(controls, "line_findings", lambda *a, **k: calls.append(1) or lines(*a, **k))
    got = {tuple(r) for r in baselines.compare(b, data.cases, data.key_cases, data.key_allocations).collect()}
    assert len(calls) == 1
    want = set()
    for name, claims in {"B1": None, "B2": baselines.b2_claims(b, baselines.visits(data.cases)), "B3": baselines.b3_verdict_claims(b)}.items():
        rows = baselines.judged_lax(data.key_cases, data.key_allocations, *baselines.decide(b, data.cases, claims))
        want |= {tuple(r) for r in baselines.lax_scores(rows, name).collect()}
    assert got == want and len(calls) == 4
    whole = controls.all_findings(b, baselines.bridge(data.cases))
    plain = controls.settlement_findings(b, baselines.bridge(data.cases))
    shared = controls.unexplained(whole, None).select(plain.columns)
    assert plain.count() and shared.exceptAll(plain).isEmpty() and plain.exceptAll(shared).isEmpty()
