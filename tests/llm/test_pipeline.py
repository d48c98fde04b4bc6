"""The pipeline's stages, each held against plain Python on its own input."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as P

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """A folder of documents and benchmark with planted copies, leaks and junk."""
    rng = random.Random(9)
    en = [a + b for a in ("th", "re", "on", "st", "wh", "er") for b in ("e", "ing", "at", "ion", "er", "ou", "ly")]
    text = lambda n: " ".join(rng.choice(en) for _ in range(n))
    docs = [(i, text(rng.randint(40, 200)), "en", "hot" if i % 3 else "s1") for i in range(120)]
    items = [(i, text(30)) for i in range(10)]
    for k in range(6):
        w = docs[k][1].split()
        docs.append((200 + k, " ".join(w[:-1] + ["changed"]), "en", "s1"))
        docs.append((220 + k, docs[20 + k][1], "en", "s1"))
        docs.append((240 + k, text(50) + " " + items[k][1].upper() + " " + text(50), "en", "s1"))
    docs += [(300, None, None, None), (301, "", "en", "s1"), (302, "1234 5678 !!", "en", "s1"), (303, "same words again and again " * 30, "en", "s1"), (304, "too short", None, "s1")]
    at = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_each_stage_on_its_own_input(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    have = ids(docs)

    docs = P.written(P.language(spark, docs, table), "t")
    assert have - ids(docs) == {300, 301, 302} and docs.where("lang is null").count() == 0

    before = ids(docs)
    docs = P.written(P.quality_rules(spark, docs, table), "t")
    gone = before - ids(docs)
    assert {303, 304} <= gone and len(gone) <= 5

    rows = {r.doc_id: r.text for r in docs.collect()}
    sets = {}
    for d, t in rows.items():
        w = re.findall(SPACE, t.lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {d: d for d in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(rows, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    docs = P.written(P.near_duplicates(spark, docs, table), "t")
    assert ids(docs) == {d for d in rows if find(d) == d} and len(ids(docs)) < len(rows)

    items = [" ".join(re.findall(ALNUM, r.text.lower())) for r in spark.read.parquet(f"{table}/benchmark.parquet").collect()]
    rows = {r.doc_id: " ".join(re.findall(ALNUM, r.text.lower())) for r in docs.collect()}
    docs = P.written(P.decontamination(spark, docs, table), "t")
    assert ids(docs) == {d for d, t in rows.items() if not any(f" {i} " in f" {t} " for i in items)}
    assert set(docs.columns) == set(P.COLUMNS)

    packed = P.packed(spark, docs, table)
    assert ids(packed) == ids(docs)
    sums = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert sums <= 4096


def test_result_holds_the_packed_ids(spark, table):
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: len(r.ids) // 4 == r.length > 0 for r in P.packed(spark, docs, table).collect()} == {1: True, 2: True}


def test_run_and_registration(spark, table):
    assert {n.split("_")[0] for n in __spark_entry__.queries() if re.match(r"op\d+_", n)} == {f"op{n}" for n in range(1, 14)}
    out = __spark_entry__.queries()["pipeline"](spark, table)
    assert out.count() > 100 and "pipeline" not in __spark_entry__.oracle_sql()


def test_empty_table_passes_through(spark, table, tmp_path):
    spark.read.parquet(f"{table}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{table}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
