"""Places in an order of a whole table, found by ranges: no task sees more than its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyloom.sources.kept import kept

#: Ranges of a hash by its upper bits.
RANGE_BITS = 12


def placed(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """df with its place from 0 in an order, which should be total.

    Rows are dealt to tasks by ranges and counted there; the sizes of the ranges,
    one row each, give every range its first place.  The dealt rows are written
    before they are counted, as ranges are sampled and could fall otherwise again.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = kept(dealt.select("*", F.monotonically_increasing_id().alias("_at"), F.spark_partition_id().alias("_task")))
    sizes = dealt.groupBy("_task").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    before = sizes.select("_task", (F.coalesce(F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("_from")).alias("_shift"))
    return dealt.join(F.broadcast(before), "_task").withColumn(name, F.col("_at") + F.col("_shift")).drop("_task", "_at", "_shift")


def permuted(df: DataFrame, seed: int, *key: str, name: str = "place") -> DataFrame:
    """df with its place from 0 in a permutation drawn by the seed: rows are ordered by a hash of it and their key, which should be unique.

    The upper bits of the hash are even ranges, so that none need be found by
    sampling, for which df would be computed twice.
    """
    drawn = df.withColumn("_draw", F.xxhash64(F.lit(seed), *key)).withColumn("_range", F.shiftright("_draw", 64 - RANGE_BITS))
    dealt = kept(drawn.withColumn("_at", F.row_number().over(W.partitionBy("_range").orderBy("_draw", *key))).drop("_draw"))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - 1).alias("_shift"))
    return dealt.join(F.broadcast(before), "_range").withColumn(name, F.col("_at") + F.col("_shift")).drop("_range", "_at", "_shift")


def apportioned(shares: DataFrame, total: int, by: str, order: str, name: str = "units") -> DataFrame:
    """shares with whole units of a total in proportion to the column `by`: the parts rounded down, and what is left to the largest remainders, equal ones in order.

    Shares are whole and not negative, null is none; order should be total.  With
    no share above zero nobody gets a unit.
    """
    share = F.coalesce(F.col(by).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    whole = shares.agg(F.sum(share)).first()[0] or 0
    if not whole:
        return shares.withColumn(name, F.lit(0).cast("long"))
    scaled = share * F.lit(total)
    parts = kept(shares.withColumn(name, F.floor(scaled / F.lit(int(whole))).cast("long")).withColumn("_rest", (scaled - F.col(name) * F.lit(int(whole))).cast("decimal(38,0)")))
    left = total - (parts.agg(F.sum(name)).first()[0] or 0)
    ranked = placed(parts, F.desc("_rest"), F.col(order), name="_turn")
    return ranked.withColumn(name, F.col(name) + (F.col("_turn") < left).cast("long")).drop("_rest", "_turn")
