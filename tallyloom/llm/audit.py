"""How filters interact: what each removes under every order in which they may be applied.

Which of five filters a document fails is a set of five bits, and its fate in
any order follows from that set.  Documents are counted by class (part, bits,
good, toxic); each class contributes to the 80 edges (subset already applied,
next filter) of the lattice of subsets, and the aggregated edges are joined to
the 600 steps of the 120 orders, each a path through the lattice.

Filters: A fewer than 200 words; B distinct words under half of the words; C
more than 3 % of the code points in A-Z; D any of # $ % & * |; E a text that a
smaller doc_id has too, removed or not.

A null text is empty, so null and empty texts are equal.  A null doc_id is
neither smaller nor larger than another: its row never fails E and lets none
fail.  Rows that repeat one doc_id are rows of their own, of which none fails E
by another.  A doc_id with several labels is good (toxic) if one of them says
so; without a label it is neither.  A null part is the empty string.  An empty
table gives an empty table, as there are no parts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyloom.llm.store import written

FILTERS = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """The bits of filters A to D that a text fails."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    few = F.size(words) < 200
    repeats = 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)
    capitals = 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))) > 3 * F.length(text)
    return sum(F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate((few, repeats, capitals, text.rlike("[#$%&*|]"))))


def classes(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, bits, good, toxic, n): how many documents of each kind there are.

    Copies of a text meet as counts by text, kind and least doc_id, summed before
    they are shuffled, so that a group of any size is a row for each task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), failures(text).cast("int").alias("bits"))
    rows = written(rows.groupBy("doc_id", "part", "same", "bits").agg(F.count("*").alias("n")), "failures")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = rows.where("doc_id is not null").join(marks, "doc_id", "left").unionByName(rows.where("doc_id is null"), allowMissingColumns=True).fillna(0, ["good", "toxic"])
    kinds = ("part", "bits", "good", "toxic")
    by_text = marked.groupBy("same", *kinds).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    least = F.min("least").over(W.partitionBy("same"))
    kept_first = F.when(F.col("least") == least, F.col("first")["n"]).otherwise(0)
    split = by_text.select(*kinds, "n", (F.coalesce(kept_first, F.lit(0)) + F.col("n_null")).alias("own"))
    both = split.select("*", F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("own").alias("m")), F.struct(F.lit(16).alias("e"), (F.col("n") - F.col("own")).alias("m")))).alias("x"))
    return both.where("x.m > 0").groupBy("part", (F.col("bits") + F.col("x.e")).alias("bits"), "good", "toxic").agg(F.sum("x.m").alias("n"))


def edges(counted: DataFrame) -> DataFrame:
    """(part, done, next) with counts: done, the bits of the filters applied, and next, the bit of the one to come; 80 for each part, zeros included."""
    each = counted.select("*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("done")).select("*", F.explode(F.array(*(F.lit(1 << k) for k in range(5)))).alias("next"))
    each = each.where(F.col("done").bitwiseAND(F.col("next")) == 0)
    fails = F.col("bits").bitwiseAND(F.col("next")) != 0
    there = F.col("bits").bitwiseAND(F.col("done")) == 0
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("part", "done", "next").agg(
        total(there & ~fails).alias("kept"),
        total(there & fails).alias("removed"),
        total(~there & fails).alias("redundant"),
        total(F.col("bits") == F.col("next")).alias("unique_fails"),
        total(there & fails & (F.col("good") == 1)).alias("good_lost"),
        total(there & fails & (F.col("toxic") == 1)).alias("toxic_lost"),
    )


def interactions(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step; shapley sums what the step's filter removes over all orders."""
    paths = [("".join(o), k + 1, sum(1 << FILTERS.index(f) for f in o[:k]), 1 << FILTERS.index(o[k])) for o in permutations(FILTERS) for k in range(5)]
    steps = docs.sparkSession.createDataFrame(paths, "filter_order string, step int, done int, next int")
    along = edges(classes(docs, labels, part)).join(F.broadcast(steps), ["done", "next"])
    shapley = F.sum("removed").over(W.partitionBy("part", "next"))
    return along.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))
