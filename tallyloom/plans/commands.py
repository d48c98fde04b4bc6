"""Commands around a batch: generate and prove one, measure its ambiguity, try held-out seeds, draw a dashboard.

    python -m tallyloom.plans.commands generate DIR --records 500 --seed 42 --family primary
    python -m tallyloom.plans.commands ambiguity DIR
    python -m tallyloom.plans.commands holdout --seeds 70001 70002 --records 500
    python -m tallyloom.plans.commands dashboard DIR --html FILE
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import ambiguity, baselines, verdicts
from tallyloom.plans import holdout
from tallyloom.plans.report import Table, as_html, as_text, panel, table
from tallyloom.sources import generator, proof
from tallyloom.sources.batch import load_answer_key, load_raw


def ambiguity_tables(spark: SparkSession, directory: str) -> list[Table]:
    counted = ambiguity.candidates(ambiguity.load(spark, directory)).cache()
    return [table("Refund deltas", ambiguity.rates(counted)), table("Candidates of a delta", ambiguity.histogram(counted).orderBy("stage", "k"))]


def lexical_tables(spark: SparkSession, directory: str) -> list[Table]:
    """How far text similarity separates candidates, and how often it hits, by the answer key."""
    raw = load_raw(spark, directory)
    pairs = baselines.b3_pairs(raw).cache()
    return [table("Text similarity of contested lines", baselines.panel(pairs)), table("Hits of the most similar refund", baselines.hit_rate(pairs, load_answer_key(spark, directory)[1]))]


def dashboard(spark: SparkSession, directory: str) -> list[Table]:
    """Scoreboard of the baselines and the ladder first, then the report's tables, the lexical panel and the ambiguity of the batch."""
    key, pairs = load_answer_key(spark, directory)
    r = verdicts.reconcile(spark, directory)
    agent = (r.verdicts, r.run.accepted.select("settlement_id", "event_id", "detail_id"))
    board = table("Scoreboard", baselines.compare(load_raw(spark, directory), r.cases, key, pairs, agent).orderBy("matcher"))
    count = lambda name, df: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
    totals = count("events", r.batch.ledger).unionByName(count("lines", r.batch.detail)).unionByName(count("settlements", r.batch.summary)).unionByName(count("cases", r.cases))
    return [board, table("Size", totals), *panel(r, (key, pairs)), *lexical_tables(spark, directory), *ambiguity_tables(spark, directory)]


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("generate", "ambiguity", "dashboard"):
        sub.add_parser(name).add_argument("directory")
    sub.choices["dashboard"].add_argument("--html", help="write the page to this file")
    sub.add_parser("holdout").add_argument("--seeds", type=int, nargs="+", default=[70001, 70002, 70003, 70004, 70005])
    sub.choices["generate"].add_argument("--seed", type=int, default=42)
    for name in ("generate", "holdout"):
        sub.choices[name].add_argument("--records", type=int, default=500)
        sub.choices[name].add_argument("--family", default="primary", choices=sorted(generator.SHARES))
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "generate":
        data = generator.generate(spark, generator.Config(a.records, a.seed, a.family))
        proof.proven(data.batch, data.key_cases, data.key_allocations)
        generator.write(data, a.directory)
        tables = [table("Dataset", generator.metadata(data).orderBy("key"), 100)]
    elif a.command == "holdout":
        rows = holdout.by_seed(spark, a.seeds, generator.Config(a.records, family=a.family)).cache()
        tables = [table("By seed", rows.orderBy("seed")), table("Spread", holdout.spread(rows).orderBy("measure"))]
    elif a.command == "ambiguity":
        tables = ambiguity_tables(spark, a.directory)
    else:
        tables = dashboard(spark, a.directory)
        if a.html:
            with open(a.html, "w", encoding="utf-8") as f:
                f.write(as_html("Dashboard", tables))
    print(as_text(tables))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
