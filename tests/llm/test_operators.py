"""Each operator against plain Python, and on odd tables: nulls, empty and long texts, repeats, clashing columns, no rows."""

import itertools
import math
import random
import re
import textwrap
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import decontam, graph, hpylm, langid, licenses, ngram_join, packing, quality, rollup, sharding, toxicity
from tallyloom.llm import textops as X
from tallyloom.llm.queries import op1_reshard, remainder
from tallyloom.llm.store import new_path, shared_dir

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, token long, block int, shard int, hash long, n int, c int, part int"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Rows with every oddity, as (doc_id, text, lang, source)."""
    rng = random.Random(4)
    en = [a + b for a in ("th", "re", "on", "st", "wh") for b in ("e", "ing", "at", "ion", "er", "ou")] + ["the", "of", "and"]
    fr = [a + b for a in ("qu", "le", "au", "ch", "é") for b in ("e", "eux", "ment", "ai", "oi")] + ["le", "de", "et"]
    rows = [(i, sentence(rng, en if i % 3 else fr, rng.choice((3, 8, 40, 120))), "en" if i % 3 else "fr", "hot" if i % 2 else f"s{i % 5}") for i in range(60)]
    base = sentence(rng, en, 200)
    words = base.split()
    rows += [(100 + i, " ".join(w if k != 20 * i + 3 else "changed" for k, w in enumerate(words)), "en", "hot") for i in range(8)]
    rows += [(120 + i, base, "en", "hot") for i in range(6)]
    rows += [(200, None, None, None), (201, "", "en", "s1"), (202, " \n\t ", None, "s1"), (203, "x" * 30_000, "en", "s1"), (204, sentence(rng, en, 9000), "en", "s1"), (205, "a b", "en", "s1"), (206, "Word", "en", None), (207, "12 34 !!", "en", "s1"), (208, "line one two\nline one two\n\n \nline one two x", "en", "s1"), (209, "the of and on " * 40, "en", "s1")]
    rows += [(300, "Released under the MIT License. This is the mit license; Apache-License too", "en", "s2"), (301, "Intro.\nLicensed under CC BY-NC 4.0.\nMore", "en", "s2"), (302, sentence(rng, en, 150) + " licensed under the Apache License, version 2.0 " + sentence(rng, en, 90), "en", "s2")]
    rows += [(None, base, "en", "s3"), (None, None, None, None), (1, "another text under an id that is taken", "en", "s3"), (120, base, "en", "hot")]
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 3, 4, 5, 6, 7, 8) for r in odd_rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_match_regex(odd_rows):
    texts = [r[1] for r in odd_rows]
    for table, pattern in ((X.NOT_SPACE, SPACE), (X.ALNUM, ALNUM)):
        w = X.words(pa.array(texts), table, lower=True)
        for i, t in enumerate(texts):
            got = [bytes(w.buf[a:b]).decode() for a, b in zip(w.start[w.of(i)], w.end[w.of(i)], strict=True)]
            assert got == re.findall(pattern, low(t))
            assert [int(h) for h in w.hash[w.of(i)]] == [int(X.hash_of(x)) for x in got]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5060)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


# 1


def test_flow_is_cheapest():
    rng = random.Random(1)
    for _ in range(60):
        sizes, caps = [rng.randrange(6) for _ in range(2)], [rng.randrange(6) for _ in range(3)]
        if sum(sizes) > sum(caps):
            continue
        cost = [[rng.randrange(4) for _ in caps] for _ in sizes]
        flow = sharding.min_cost_flow(sizes, caps, cost)
        assert [sum(f) for f in flow] == sizes and all(sum(f[d] for f in flow) <= caps[d] for d in range(3))
        splits = [[s for s in itertools.product(range(n + 1), repeat=3) if sum(s) == n] for n in sizes]
        best = min(sum(c * x for row, own in zip(cost, pick, strict=True) for c, x in zip(row, own, strict=True)) for pick in itertools.product(*splits) if all(sum(p[d] for p in pick) <= caps[d] for d in range(3)))
        assert sum(c * x for row, own in zip(cost, flow, strict=True) for c, x in zip(row, own, strict=True)) == best


def test_reshard_evens_bytes_and_numbers_slots(spark, odd, none):
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size")
    rows = odd.where("doc_id is null or doc_id not in (203, 204)").select("doc_id", size, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)).cast("int").alias("old"))
    got = sharding.slots(sharding.reshard(rows, 4, 3)).collect()
    assert len(got) == rows.count()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    sums = [sum(r["size"] for r in g) for g in by.values()]
    assert len(by) == 4 and max(sums) - min(sums) <= 0.02 * sum(sums)
    assert all(sorted(r.slot for r in g) == list(range(len(g))) for g in by.values())
    assert sharding.slots(sharding.reshard(none.select("doc_id", F.lit(1).cast("long").alias("size"), F.lit(0).alias("old")), 4, 3)).count() == 0


def test_reshard_moves_about_the_least(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(200)) + 1).cast("long").alias("size"), F.pmod(F.xxhash64("id"), F.lit(3)).cast("int").alias("old"))
    got = sharding.reshard(rows, 4, 3).cache()
    total = got.agg(F.sum("size")).first()[0]
    moved = got.where("old <> shard").agg(F.sum("size")).first()[0]
    assert moved <= 0.25 * total * 1.1


def test_rewrite_touches_only_affected_shards(spark, tmp_path):
    docs = spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("shard"))
    docs.write.partitionBy("shard").parquet(str(tmp_path / "v0"))
    manifest = spark.createDataFrame([(s, str(tmp_path / f"v0/shard={s}")) for s in range(3)], "shard int, path string")
    assigned = docs.select("doc_id", F.col("shard").alias("old"), F.when(F.col("doc_id") < 6, F.when(F.col("shard") == 0, 1).otherwise(F.col("shard"))).otherwise(F.col("shard")).cast("int").alias("shard"))
    new = {r.shard: r.path for r in sharding.rewrite(spark, manifest, assigned, str(tmp_path / "v1")).collect()}
    assert "v0" in new[2] and "v1" in new[0] and "v1" in new[1]
    held = {s: {r.doc_id for r in spark.read.parquet(p).select("doc_id").collect()} for s, p in new.items()}
    assert held == {s: {r.doc_id for r in assigned.collect() if r.shard == s} for s in range(3)}


def test_shards_are_rewritten_without_losing_null_or_repeated_ids(spark, odd, odd_rows, none, tmp_path):
    docs = odd.select("doc_id", "text")
    olds = sharding.write_shards(docs, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)).cast("int"), str(tmp_path / "v0"))
    schema = docs.withColumn("row", F.lit(0).cast("long")).schema
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size")
    planned = sharding.reshard(sharding.read_shards(spark, olds, schema).select("row", "doc_id", size, F.col("shard").alias("old")), 4, 3)
    news = sharding.rewrite(spark, olds, planned, str(tmp_path / "v1"), key="row")
    held = sharding.read_shards(spark, news, schema).collect()
    assert Counter((r.doc_id, r.text) for r in held) == Counter((r[0], r[1]) for r in odd_rows)
    assert Counter((r.row, r.shard) for r in held) == Counter((r.row, r.shard) for r in planned.collect())
    with pytest.raises(ValueError, match="repeats"):
        sharding.rewrite(spark, olds, planned, str(tmp_path / "v2"))
    folder = tmp_path / "in"
    docs.write.parquet(f"{folder}/documents.parquet")
    got = op1_reshard(spark, str(folder)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    newest = max((p for p in Path(shared_dir(spark).removeprefix("file:")).glob("tallyloom/new-shards-*")), key=lambda p: p.stat().st_mtime)
    moved = spark.read.parquet(str(newest))
    in_files = Counter((r.doc_id, r.shard, r.text or "") for r in moved.collect())
    assert in_files and all(shard in {r.shard for r in got if r.doc_id == d} for d, shard, _ in in_files)
    none.select("doc_id", "text").write.parquet(f"{folder}/none/documents.parquet")
    assert op1_reshard(spark, f"{folder}/none").count() == 0


# 2


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_best_stretch_is_exact():
    rng = random.Random(3)
    for _ in range(300):
        item, text = [rng.randrange(4) for _ in range(rng.randint(1, 9))], [rng.randrange(4) for _ in range(rng.randint(0, 14))]
        want = min(edit_distance(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        assert decontam.best_stretch(item, text)[0] == want


def test_leaks_are_found_with_edits_and_clean_documents_left(spark, odd, none):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(400)]
    items = [(i, sentence(rng, words, rng.randint(16, 60))) for i in range(25)] + [(90, None), (91, ""), (92, "exact pair")]
    docs, want = [], set()
    for d in range(200):
        body = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        if d % 2:
            k, text = rng.choice(items[:25])
            w = text.split()
            for _ in range(len(w) // 5):  # the most edits allowed
                i, kind = rng.randrange(1, len(w) - 1), rng.randrange(3)
                w[i : i + int(kind != 1)] = ["new"] * int(kind != 2)
            at = rng.randint(0, len(body))
            body[at:at] = [x.upper() + "," for x in w]
            want.add((1000 + d, k))
        docs.append((1000 + d, " ".join(body)))
    table = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd.select("doc_id", "text")).repartition(4)
    got = decontam.leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(want & found) >= 0.98 * len(want)
    text, held = dict(docs), dict(items)
    for r in got:
        a, w = re.findall(ALNUM, low(held[r.item_id])), re.findall(ALNUM, low(text[r.doc_id]))
        assert edit_distance(a, w[r.first_word : r.first_word + r.n_words]) == r.distance <= len(a) // 5
    split = decontam.leaks(table, spark.createDataFrame(items, "item_id long, text string"), item_words=300)
    assert len(want & {(r.doc_id, r.item_id) for r in split.collect()}) >= 0.98 * len(want)
    # exhaustive search: no leak is missed, whatever its edits
    plain = [(k, re.findall(ALNUM, low(t))) for k, t in items[:25]]
    truth = {(d, k) for d, t in docs[:60] for k, a in plain if decontam.best_stretch(list(map(hash, a)), list(map(hash, re.findall(ALNUM, low(t)))))[0] <= len(a) // 5}
    assert {x for x in found if x[0] < 1060 and x[1] < 25} == truth
    assert decontam.leaks(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontam.leaks(table, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_recall_at_the_limit_by_kind_and_size():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    for size in (20, 60, 400):
        items = [(i, sentence(rng, words, size)) for i in range(6)]
        index = decontam.Index(items, 20, 2, 0.95)
        assert (size == 400) == (index.walks[size] == 0)
        hits = tries = 0
        for (i, text), kind in itertools.product(items, range(3)):
            w = text.split()
            for at in sorted(rng.sample(range(1, size - 1), size // 5), reverse=True):
                w[at : at + int(kind != 1)] = ["new"] * int(kind != 2)
            tries += 1
            hits += any(f[1] == i for f in index.scan(pa.array([f"{sentence(rng, words, 50)} {' '.join(w)} {sentence(rng, words, 50)}"])))
        assert hits >= 0.95 * tries


def test_clean_judges_rows_by_their_own_text(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(None, f"a {item} b", 1), (None, "quite another text", 2), (7, item, 3), (7, "clean under the same id", 4), (8, None, 5), (9, "", 6)]
    got = decontam.clean(spark.createDataFrame(rows, "doc_id long, text string, item_id int"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.item_id for r in got.collect()) == [2, 4, 5, 6] and got.columns == ["doc_id", "text", "item_id"]
    # items without an id, and a column with the name that the hash would have
    found = spark.createDataFrame(rows, "doc_id long, text string, text_hash_0 int")
    items = spark.createDataFrame([(None, item), (None, item), (None, None), (4, "eleven twelve thirteen fourteen fifteen")], "item_id long, text string")
    got = decontam.clean(found, items)
    assert sorted(r.text_hash_0 for r in got.collect()) == [2, 4, 5, 6] and got.columns == ["doc_id", "text", "text_hash_0"]
    assert Counter((r.doc_id, r.item_id, r.distance) for r in decontam.leaks(found, items).collect()) == {(None, None, 0): 1, (7, None, 0): 1}


# 3


def sets_of(rows, size):
    out = []
    for doc, text, *_ in rows:
        w = re.findall(SPACE, low(text))
        k = min(size, len(w))
        out.append((doc, frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()))
    return out


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 90, 1000), (5, 80, 4), (2, 80, 1000)])
def test_components_match_all_pairs(spark, odd, odd_rows, size, percent, block):
    assert Counter(map(tuple, ngram_join.jaccard_components(odd, size, percent, block).collect())) == own_components(odd_rows, size, percent)


def own_components(rows, size, percent):
    """(doc_id, n_shingles, component_id) of each row by all pairs of rows; the least id reached, whatever the rows between have for one."""
    sets = sets_of(rows, size)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, (_, s)), (j, (_, t)) in itertools.combinations(enumerate(sets), 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            root[find(i)] = find(j)
    ids = {}
    for i, (d, s) in enumerate(sets):
        ids.setdefault(find(i), []).extend([d] if s and d is not None else [])
    return Counter((d, len(s), (min(ids[find(i)], default=None) if s else d)) for i, (d, s) in enumerate(sets))


def test_rows_without_an_id_link_others(spark):
    """1 and 3 meet only through a row without an id; copies of texts without an id, and ids that repeat, change nothing."""
    words = [f"w{i}" for i in range(60)]
    with_changed = lambda *at: " ".join(f"x{i}" if i in at else w for i, w in enumerate(words))
    rows = [(3, with_changed(0)), (None, with_changed()), (None, with_changed()), (1, with_changed(59)), (None, with_changed(0)), (None, "only rows without an id say this here"), (None, "only rows without an id say this here"), (None, None), (None, ""), (4, with_changed()), (4, "the same id with another text"), (5, None), (5, "the same id with another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = own_components(rows, 3, 90)
    assert Counter(map(tuple, ngram_join.jaccard_components(df, 3, 90).collect())) == want and want[3, 58, 1] == 1 and want[None, 58, 1] == 3
    kept = {r.doc_id for r in ngram_join.one_of_each(df, 3, 90).collect()}
    assert kept == {None, 1, 5} or kept == {None, 1}, "rows without an id stay; 3 and 4 are copies of 1"


def test_random_near_copies_match_all_pairs(spark):
    rng = random.Random(12)
    words = ["w%d" % i for i in range(60)]
    rows = []
    for _ in range(12):
        body = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        for _ in range(rng.randint(1, 9)):
            own = list(body)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    sets = sets_of(rows, 3)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 5).collect()}
    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if 100 * len(s & t) >= 80 * len(s | t):
            assert got[a] == got[b]
    assert all(c <= d for d, c in got.items())


def test_a_large_group_of_near_copies(spark):
    """Stars settle it: far fewer sets are compared in tiles than there are members."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, sentence(rng, [f"v{k}" for k in range(900)], 60)) for i in range(50)]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, block=20).collect()}
    assert got == {d: 0 if d < 1000 else d for d, _ in rows}


def test_join_of_no_rows_and_one_of_each(spark, odd, none):
    assert ngram_join.jaccard_components(none).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns[0] == "doc_id" and set(kept.columns) == set(odd.columns)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 100 in ids and not {101, 102, 120, 125} & set(ids) and ids.count(None) == 2


# 4


def test_automaton_knows_exactly_the_substrings():
    s = np.array([1, 2, 1, 1, 3, 2, 1], np.uint8)
    table = langid.automaton(s)
    subs = {tuple(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)}
    for n in range(1, 5):
        for word in itertools.product((1, 2, 3), repeat=n):
            state = 0
            for c in word:
                state = table[state, c] if state >= 0 else -1
            assert (state >= 0) == (word in subs)


def test_phrases_match_a_plain_parser():
    rng = random.Random(2)
    sample = np.array([rng.randrange(1, 5) for _ in range(300)], np.uint8)
    texts = [np.array([rng.randrange(1, 6) for _ in range(n)], np.uint8) for n in (0, 1, 7, 400, 1023, 1024, 1025, 2500)]
    known = {bytes(sample[i:j]) for i in range(len(sample)) for j in range(i + 1, min(len(sample), i + 30) + 1)}

    def plain(s):
        count = 0
        for lo in range(0, len(s), langid.BLOCK):
            block, at = bytes(s[lo : lo + langid.BLOCK]), 0
            while at < len(block):
                n = 1
                while at + n < len(block) and block[at : at + n + 1] in known:
                    n += 1
                at += n
                count += 1
        return count

    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = langid.Parser({"x": sample}).phrases(np.concatenate(texts), offsets)[0]
    for t, n in zip(texts, got, strict=True):
        # a symbol that the sample lacks stands as a phrase of its own, or ends one
        assert abs(n - plain(t)) <= (t == 5).sum()
        if not (t == 5).any():
            assert n == plain(t)


def test_language_learns_from_whole_rows_within_bounds(spark):
    rows = [(1, "ab " * 5000, "xx"), (2, "cd " * 30, "xx"), (2, "cd " * 30, "xx"), (3, "ef " * 30, "yy"), (4, "gh " * 9000, "yy"), (5, None, "yy"), (6, "12", "zz")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = langid.train(table, F.lit(True), 10, 200, 10_000)
    assert known.langs == ["xx", "yy"] and [round(2**b) for b in known.bits] == [90, 90]
    lone = langid.train(table.where("doc_id in (1, 4)"), F.lit(True), 10, 200, 10_000)
    assert [round(2**b) for b in lone.bits] == [15000, 27000]


def test_language_of_held_out_documents(spark, odd, none):
    got = langid.identify(odd, remainder(4) != 2)
    assert got.count() == odd.count()
    rows = {r.doc_id: r for r in got.collect() if r.doc_id is not None and r.doc_id >= 2}
    assert all(rows[d].lang_pred == "und" and rows[d].score == 0 for d in (200, 201, 202, 207))
    assert all(0 <= r.score <= 1 for r in rows.values())
    right = [rows[r.doc_id].lang_pred == r.lang for r in odd.where("doc_id between 2 and 59").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and len(r.text) > 40]
    assert len(right) >= 5 and sum(right) >= 0.95 * len(right)
    assert langid.identify(none, remainder(4) != 2).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, F.lit(False)).collect()} == {"und"}


# 5


def test_ids_equal_whole_text_encoding(odd_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r[1] for r in odd_rows] + ["A.. b,. c., d.", "It's I'll WE'VE", "x<|endoftext|>y <|ENDOFTEXT|>", "ÀÉ ΑΣ İx. 각\x85a\x1cb", "“q.” …e. \r\nf\tb\v\f."]
    for got, text in zip(packing.Ids("word_bpe_49k.json").of(*X.bytes_of(pa.array(texts))), texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_best_fit_and_bound_on_small_bins():
    rng = random.Random(6)
    for _ in range(200):
        lengths = np.array([rng.randint(1, 12) for _ in range(rng.randint(1, 7))])
        to, at = packing.best_fit(lengths, 12)
        for b in set(to):
            own = sorted((at[i], lengths[i]) for i in np.flatnonzero(to == b))
            assert own[0][0] == 0 and all(a + n == c for (a, n), (c, _) in itertools.pairwise(own)) and sum(n for _, n in own) <= 12
        best = min(len(set(p)) for p in itertools.product(range(len(lengths)), repeat=len(lengths)) if all(lengths[[i for i, q in enumerate(p) if q == b]].sum() <= 12 for b in set(p))) if len(lengths) < 6 else None
        bound = packing.lower_bound(np.bincount(lengths, minlength=13), 12)
        assert bound <= len(set(to)) and (best is None or bound <= best <= len(set(to)))


def test_pack_keeps_every_piece_and_fills_from_zero(odd, none):
    got = packing.pack(odd, size=256, part_rows=20).collect()
    whole = {}
    for r in got:
        whole.setdefault((r.doc_id, r.piece, r.start, r.ids_crc32), []).append(r)
    assert sum(r.piece == 0 for r in got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for g in by.values():
        g.sort(key=lambda r: r.offset)
        assert g[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in itertools.pairwise(g)) and g[-1].offset + g[-1].length <= 256
    bound = packing.lower_bound(np.bincount([r.length for r in got], minlength=257), 256)
    assert len(by) <= bound + 1
    assert packing.pack(none).count() == 0


def test_sequences_hold_the_ids_of_whole_documents(odd, odd_rows):
    got = packing.pack(odd, size=256, part_rows=20).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    texts = [r[1] for r in odd_rows]
    want = Counter()
    for (doc, *_), ids in zip(odd_rows, packing.Ids("word_bpe_49k.json").of(*X.bytes_of(pa.array(texts))), strict=True):
        ids += np.array([1], "<u4").tobytes()
        want.update((doc, k, ids[i : i + 1024]) for k, i in enumerate(range(0, len(ids), 1024)))
    assert Counter((r.doc_id, r.piece, bytes(r.ids)) for r in got) == want
    for some in ([], [0, 65535], [0, 65536, 2**32 - 1]):
        ids = np.array(some, "<u4").tobytes()
        assert packing.unfolded(packing.folded(ids), len(some)) == ids


# 6


def test_rollup_is_signed_and_idempotent(spark, odd, none):
    counts = rollup.counted(odd, {"b": rollup.bytes_counter}).cache()
    table = rollup.Rollup(spark, new_path(spark, "rollup"))
    table.commit("a", rollup.changes(counts, "b", None, F.col("n0")))
    full = {(r.source, r.lang): (r.documents, r.tokens) for r in table.totals().collect()}
    want = {}
    for r in odd.collect():
        n, b = want.get((r.source, r.lang), (0, 0))
        want[r.source, r.lang] = (n + 1, b + len((r.text or "").encode()))
    assert full == {k: v for k, v in want.items()}
    hot = counts.where("source = 'hot'")
    for _ in range(2):
        table.commit("b", rollup.changes(hot, "b", F.col("n0"), F.col("n0") + 2))
    table.commit("c", rollup.changes(counts.where("source = 's1'"), "b", F.col("n0"), None))
    table.commit("d", rollup.changes(rollup.counted(none, {"b": rollup.bytes_counter}), "b", None, F.col("n0")))
    after = {(r.source, r.lang): (r.documents, r.tokens) for r in table.totals().collect()}
    assert after == {k: (n, b + 2 * n) if k[0] == "hot" else (n, b) for k, (n, b) in want.items() if k[0] != "s1"}
    totals = lambda t: {(r.source, r.lang): (r.documents, r.tokens) for r in t.totals().collect()}
    table.compact("all")
    assert totals(table) == after and table.deltas().select("batch_id").distinct().count() == 1
    table.commit("a", rollup.changes(counts, "b", None, F.col("n0")))  # merged, so it changes nothing
    assert totals(table) == after
    table.commit("e", rollup.changes(hot, "b", F.col("n0") + 2, F.col("n0")))
    table.compact("all again")
    table.commit("b", rollup.changes(hot, "b", F.col("n0"), F.col("n0") + 2))
    assert totals(table) == {k: v for k, v in want.items() if k[0] != "s1"}
    # a compaction that stopped half way leaves the old generation in force
    table._write(counts.limit(0).select("source", "lang", F.lit("b").alias("tokenizer"), F.lit(0).cast("long").alias("documents"), F.lit(0).cast("long").alias("tokens"), F.lit("x").alias("batch_id")), 3)
    assert totals(table) == {k: v for k, v in want.items() if k[0] != "s1"}
    assert rollup.Rollup(spark, new_path(spark, "rollup")).totals().count() == 0


# 7


def test_base_counts_match_plain_python(odd_rows):
    texts = [r[1] for r in odd_rows]
    got = list(zip(*(c.tolist() for c in quality.base_counts(pa.array(texts))), strict=True))
    for t, have in zip(texts, got, strict=True):
        t = t or ""
        w, lines = re.findall(SPACE, t), [x for x in t.split("\n") if re.search(SPACE, x)]
        g = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(g)
        assert have == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len({i + k for i, x in enumerate(g) if n[x] > 1 for k in range(8)}))


def test_quality_keeps_plain_text_and_handles_odd_rows(odd, none):
    got = quality.judge(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 1, 120)}
    assert by[200].base_failed and by[201].base_failed and by[209].base_failed and not by[209].kept
    long = [r for r in got if r.doc_id is not None and 2 <= r.doc_id < 60 and r.n_words >= 40]
    assert sum(r.kept for r in long) >= 0.9 * len(long)
    assert quality.judge(none).count() == 0


# 8


def test_licenses_match_all_windows(odd, odd_rows, none):
    got = {(r.doc_id, r.n_words): r for r in licenses.scan(odd).collect()}
    for doc, text, *_ in odd_rows:
        w = re.findall(ALNUM, low(text))
        at = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        labels = {label for _, label in at}
        for line in (text or "").split("\n"):
            for label, template in licenses.TEMPLATES:
                t = re.findall(ALNUM, low(template))
                s, wide = set(t), 64
                while wide < 2 * len(t):
                    wide *= 2
                for words in (re.findall(ALNUM, low(line)), w):
                    for a in range(0, max(1, len(words) - wide + wide // 2), wide // 2):
                        if 100 * len(s & set(words[a : a + wide])) >= 90 * len(s):
                            labels.add(label)
        r = got[doc, len(w)]
        assert (r.n_base, r.first_word, r.last_word) == (len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert r.labels == ",".join(sorted(labels)) and r.base_labels == ",".join(sorted({x for _, x in at})) and 0 <= r.score <= 1
    assert got[301, 9].labels == "cc-by-nc" and licenses.scan(none).count() == 0


def test_license_filters_lose_nothing_and_each_drops_candidates():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    templates = tuple((f"t{i}", sentence(rng, words, rng.randint(4, 14))) for i in range(40)) + (("none", "!!"), ("long", sentence(rng, words, 90)))
    vocabulary = np.unique(np.concatenate(licenses._sets(templates)))
    m = licenses.Matcher(templates, licenses.PHRASES, 70, 64, vocabulary, np.array([rng.randrange(50) for _ in vocabulary]))
    for _ in range(300):
        block = set(rng.sample(words, rng.randint(1, 20)))
        places = np.sort(m.place[np.searchsorted(vocabulary, np.sort([X.hash_of(x) for x in block if X.hash_of(x) in vocabulary]))])
        got = sorted(x for prefix in m.classes.values() for x in m._met(places, prefix))
        sets = [set(t.split()) if t != "!!" else set() for _, t in templates]
        assert got == [(i, len(s & block)) for i, s in enumerate(sets) if s and 100 * len(s & block) >= 70 * len(s)]
    assert m.pruned > 0


def test_wrapped_notices_are_met(spark):
    rng = random.Random(8)
    filler = lambda n: "\n".join(sentence(rng, ["alpha", "beta", "gamma"], 7) for _ in range(n))
    long = [(label, t) for label, t in licenses.TEMPLATES if len(t) > 60]
    docs = [(i, f"{filler(before)}\n{textwrap.fill(t, 50)}\n{filler(5)}") for i, ((_, t), before) in enumerate(itertools.product(long, range(12)))]
    docs += [(1000 + i, t.replace(" ", "\n")) for i, (_, t) in enumerate(long)]
    truth = {i: label for i, ((label, _), _) in enumerate(itertools.product(long, range(12)))} | {1000 + i: label for i, (label, _) in enumerate(long)}
    docs.append((2000, filler(40)))
    for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        if r.doc_id == 2000:
            assert r.labels == "" and r.score == 0 and not r.spans
            continue
        assert truth[r.doc_id] in r.labels.split(",") and r.score >= 0.9
        assert any(s.label == truth[r.doc_id] and s.containment == 1 for s in r.spans)
        assert len(set(map(tuple, r.spans))) == len(r.spans)


# 9


def test_gradients_match_differences():
    w = toxicity.Words(pa.array(["one two three four", "two five"]))
    net = toxicity.Network(np.sort(w.hash))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, some, y = net.word_ids(w.hash), np.array([0, 1]), np.array([1.0, 0.0])
    args = toxicity._subset(w, ids, some)
    grads = net.gradients(*args, y)

    def loss():
        z = net.logits(net.inputs(*args[:3]), args[3], args[4])
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))

    rng = np.random.default_rng(0)
    for k in ("uf", "ub", "xf", "at", "pick", "out", "bias", "word"):
        flat = net.p[k].reshape(-1)
        i = int(np.argmax(np.abs(grads[k]))) if k == "word" else int(rng.integers(len(flat)))
        keep, h = flat[i], 1e-2
        flat[i] = keep + h
        up = loss()
        flat[i] = keep - h
        down = loss()
        flat[i] = keep
        assert abs((up - down) / (2 * h) - grads[k].reshape(-1)[i]) < 2e-3


def test_windows_cover_and_overlap():
    for n in (0, 1, 31, 32, 33, 56, 57, 200):
        text, start = toxicity.window_starts(np.array([n]))
        covered = {i for s in start for i in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and len(text) == len(start)


def test_toxicity_learns_from_labels(spark, odd, none):
    rng = random.Random(5)
    plain = ["w%d" % i for i in range(300)]
    docs, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        w = [rng.choice(plain) for _ in range(rng.randint(10, 120))]
        for _ in range(4 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(("vile", "rotten", "foul")))
        docs.append((1000 + i, " ".join(w)))
        labels.append((1000 + i, int(toxic)))
    table = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    known = spark.createDataFrame([*labels, (5, None), (None, 1), (6, 7)], "doc_id long, toxic int")
    got = toxicity.score(table, known, remainder(5) != 0).collect()
    assert len(got) == table.count() and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [(r.score >= 0.5) == truth[r.doc_id] for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(held) >= 0.95 * len(held)
    assert toxicity.score(none, known, remainder(5) != 0).count() == 0
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(odd, empty, remainder(5) != 0).count() == odd.count()


# 10


def test_seating_bounds_and_mean():
    c = np.array([0, 1, 2, 5, 64, 1000, 10**6])
    rng = np.random.default_rng(1)
    t = hpylm.seat(c, np.full(len(c), 50.0), 0.5, lambda _, some: rng.random(len(some)))
    assert (t <= c).all() and (t[c > 0] >= 1).all() and t[0] == 0
    many = np.full(20_000, 3)
    t = hpylm.seat(many, np.full(len(many), 1.0), 0.5, lambda _, some: rng.random(len(some)))
    second, third = 1 / 1.5, lambda k: 1 / (1 + 2 - 0.5 * k)
    assert abs(t.mean() - (1 + second + second * third(2) + (1 - second) * third(1))) < 0.02


def test_scores_against_plain_python(odd, odd_rows, none):
    got = hpylm.score(odd, remainder(10) == 0, block_bytes=20_000, groups=3).collect()
    assert len(got) == odd.count()
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 == 0
    c, tokens = Counter(), []
    for doc, text, *_ in odd_rows:
        w = [*re.findall(SPACE, low(text)), "\n"]
        tokens.append((doc, w))
        if not held(doc):
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = Counter((d, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 3)) for d, w in tokens)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    assert all(r.score < 0 for r in got)
    copies = [r.score for r in got if r.doc_id is not None and 100 <= r.doc_id < 130]
    assert np.mean(copies) > np.mean([r.base_score for r in got if r.doc_id is not None and 100 <= r.doc_id < 130])
    assert hpylm.score(none, remainder(10) == 0).count() == 0


def test_context_probabilities_sum_to_one_over_the_vocabulary(spark):
    """Every pair of a tiny vocabulary: scores of two-word texts show each context's shares; with unseen spellings they stay below one."""
    words = ["aa", "ab", "ba", "bb"]
    rng = random.Random(3)
    train = [(i, sentence(rng, words, 6)) for i in range(1, 40)]
    probe = [(10_000 + i, f"{a} {b}") for i, (a, b) in enumerate(itertools.product(words, repeat=2))]
    alone = [(20_000 + i, a) for i, a in enumerate(words)]
    table = spark.createDataFrame([*train, *probe, *alone], "doc_id long, text string")
    got = {r.doc_id: r.score for r in hpylm.score(table, F.col("doc_id") >= 10_000).collect()}
    total = sum(10 ** got[d] for d, _ in [*probe, *alone])
    assert 0 < total < 1


def test_ids_of_words_found_by_kind(spark, monkeypatch):
    """Equal words are encoded once and all ids gathered at once: as the tokenizer gives them, with words of one hash too."""
    import numpy as np
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    from tallyloom.llm import packing, textops

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["The cat, the Cat. the cat", None, "", " \n\t ", "a" * 63 + " " + "a" * 64 + " " + "a" * 65 + " " + "a" * 64 + "b " + "a" * 300, "straße STRASSE  x\x0by Ünï 日本語 日本 <|x|> a.b a. b", "abcdefgh1 abcdefgh2 abcdefgh1", "one"]
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    array = pa.array(texts, pa.string())
    assert list(packing.Ids("word_bpe_49k.json").of(*textops.bytes_of(array))) == want
    assert list(packing.Ids("word_bpe_49k.json").of(*textops.bytes_of(array[1:4]))) == want[1:4]
    assert list(packing.Ids("word_bpe_49k.json").of(*textops.bytes_of(array[:0]))) == []
    buf = np.frombuffer(b"one two one", np.uint8)
    which, one = packing._kinds(buf, np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert which[0] == which[2] != which[1] and len(one) == 2
    for size in (5, 20):  # words of one hash that differ are kinds of their own
        buf = np.frombuffer(b"x" * 20 + b"y" * 20, np.uint8)
        monkeypatch.setattr(textops, "word_hashes", lambda b, s, e: np.zeros(len(s), np.uint64))
        which, one = packing._kinds(buf, np.array([0, 20]), np.array([20, 20 + size]))
        assert which.tolist() == one.tolist() == [0, 1]
