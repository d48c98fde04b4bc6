"""Seeds that nothing was tuned on: each generated, proven, reconciled and scored, and how far the scores spread."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import baselines, ladder, scoring, verdicts
from tallyloom.sources import generator, proof
from tallyloom.sources.kept import kept

MEASURES = ("n_cases", "n_correct", "tp", "fp", "fn", "precision", "recall", "false_match", "floor")


def by_seed(spark: SparkSession, seeds: Iterable[int], config: generator.Config = generator.Config()) -> DataFrame:  # noqa: B008
    """(seed, MEASURES): a row for each seed; floor is the share of cases that the second baseline leaves.

    A batch that does not bear out its answer key is refused.
    """
    out = None
    for seed in seeds:
        data = generator.generate(spark, dataclasses.replace(config, seed=seed))
        proof.proven(data.batch, data.key_cases, data.key_allocations, config.window_days)
        run = ladder.run_ladder(data.batch)
        decided, claimed = verdicts.verdicts(data.batch, data.cases, run), verdicts.allocations(data.cases, run)
        want = verdicts.bridge(data.key_cases).join(data.key_allocations.select("event_id", "settlement_id").distinct(), "settlement_id").select("case_id", "event_id", "settlement_id")
        rows = kept(scoring.judged(data.key_cases, decided, want, claimed))
        second = baselines.decide(data.batch, data.cases, baselines.b2_claims(data.batch, baselines.visits(data.cases)))
        lax = baselines.lax_scores(baselines.judged_lax(data.key_cases, data.key_allocations, *second), "B2").select("floor", F.lit(seed).alias("seed"))
        one = rows.agg(F.count("*").alias("n_cases"), F.count_if("correct").alias("n_correct")).select(F.lit(seed).alias("seed"), "n_cases", "n_correct")
        one = one.join(scoring.allocation_scores(rows).withColumn("seed", F.lit(seed)), "seed").join(lax, "seed").select("seed", *MEASURES)
        out = kept(one) if out is None else out.unionByName(kept(one))
    if out is None:
        raise ValueError("no seeds")
    return out


def spread(rows: DataFrame) -> DataFrame:
    """(measure, mean, least, most) over the seeds."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in MEASURES)))
    return rows.select(each.alias("x")).groupBy("x.measure").agg(F.avg("x.value").alias("mean"), F.min("x.value").alias("least"), F.max("x.value").alias("most"))
