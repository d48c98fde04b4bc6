"""The prefix trie, byte-level BPE and the filter audit against plain Python, on odd rows and no rows."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyloom.llm import audit, bpe, trie
from tallyloom.llm import queries as Q
from tallyloom.llm.store import written

RANKS = "byte_bpe_multi_50k.tiktoken"
SPACE = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids int, block int, part string, same long, bits int, decoded string, code int"
TURNS = "conv_id long, turn long, role string, text string, pos long, digest string, depth int, name string"


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    words = ["the", "Of", "été", "don't", "x1", "12", "#tag", "naïve", "Straße", "AND", "日本", "á", "ᄀ"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [(i, text(rng.choice((3, 50, 300))), rng.choice(("en", "de", None, ""))) for i in range(60)]
    out += [(100 + i, out[2][1], "en") for i in range(5)] + [(200, None, "de"), (201, "", "en"), (202, "  \n\n \t x  \n", None), (203, "z" * 40_000, "en"), (204, text(60_000), "en")]
    out += [(205, "՘ ࢏1\U00011de0 ὠ0 \x1c\x85   ok 'll 's'd", "en"), (206, "ABC DEF & more", "en")]
    out += [(None, out[2][1], "en"), (None, None, None), (7, "a repeated id", "en"), (7, "a repeated id", "en"), (7, out[2][1], "de")]
    return out


@pytest.fixture(scope="module")
def marks():
    return [(i, i % 2, int(i % 3 == 0)) for i in range(0, 110, 3)] + [(9, 0, 0), (9, 1, 1), (None, 1, 1), (2, None, None), (7, 1, 0)]


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(8)
    say = lambda: (rng.choice(("user", "bot")), rng.choice(("hi", "yes", "no", "áé")))
    out = []
    for c in [*range(0, 40), *range(100, 130), 205, 206, 310, 499, -3, -150]:
        out += [(c, t, *say()) for t in range(rng.choice((1, 2, 4, 9)))]
    long = [say() for _ in range(700)]
    for c, n in ((1000, 700), (1001, 700), (1002, 620), (1003, 256), (1004, 512)):
        out += [(c, t, *long[t]) for t in range(n)]
    out += [(1004, 512, "user", "another way")]
    out += [(50, None, "user", "first"), (50, 3, "user", "b"), (50, 3, "bot", "b"), (50, 3, "bot", "a"), (50, 3, "bot", "a"), (51, 0, None, None), (51, 1, "", ""), (None, 0, "user", "nobody's")]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def folder(spark, docs, marks, turns, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("shared"))
    spark.createDataFrame([(*d[:3], "s", len(d[1] or ""), 1, 2, "p", 3, 4, "d", 5) for d in docs], DOCS).repartition(5).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(*t, 1, "d", 2, "n") for t in turns], TURNS).repartition(4).write.parquet(f"{at}/conversations.parquet")
    return at


def own_trie(turns, sha):
    """Nodes by plain prefixes."""
    own = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", sha((r or "", x or "")), x or ""))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return Counter((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in m if len(made[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def test_op11(spark, folder, turns):
    got = Q.op11_prefix_trie(spark, folder)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest().encode()
    assert Counter(map(tuple, got.collect())) == own_trie(turns, lambda t: hashlib.sha256(hexed(t[0]) + hexed(t[1])).digest())


def test_trie_of_no_turns(spark):
    none = spark.createDataFrame([(None, 1, "user", "nobody's")], "conv_id long, turn long, role string, text string")
    turns = written(trie.numbered(none), "none")
    found = trie.nodes(*trie.rebuilt(turns, head=F.lit(2), other=F.col("conv_id"), most=5))
    assert found.collect() == []


def test_prefixes_over_three_levels(spark):
    n, fork = 66_000, 65_800
    turns = spark.range(n).select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("conv_id"), (F.col("id") + 1).alias("pos"))
    turns = turns.withColumn("digest", F.when((F.col("conv_id") == 2) & (F.col("pos") > fork), F.lit("other")).otherwise((F.col("pos") % 7).cast("string")).cast("binary")).withColumn("chars", F.lit(1).cast("long"))
    found = trie.prefixes(turns, n).groupBy("pos").agg(F.countDistinct("prefix").alias("k"), F.min("prefix").alias("p"), F.max("chars").alias("chars"))
    assert found.where(F.col("k") != F.when(F.col("pos") > fork, 2).otherwise(1)).count() == 0
    assert found.where(F.col("pos") <= fork).select("p").distinct().count() == fork


def test_chains_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 3)
    nodes = spark.range(100).select((F.col("id") % 3).alias("conv_id"), F.floor(F.col("id") / 3).cast("long").alias("depth"), F.lit(1).cast("long").alias("a"), F.col("id").alias("b"))
    got = {(r.conv_id, r.depth): (r.a, r.b) for r in trie.below(nodes, ("a", "b")).collect()}
    ids = {(i % 3, i // 3): i for i in range(100)}
    assert got == {(c, d): (sum(1 for x, y in ids if x == c and y >= d), sum(i for (x, y), i in ids.items() if x == c and y >= d)) for c, d in ids}
    members = [5, 70, 7, 8, 9, 100, 64, -3, -20, 2**60 + 1, 2**60]
    ends = spark.createDataFrame([(1, 2, m) for m in members] + [(1, 3, 9)], "conv_id long, depth long, member long")
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    assert {tuple(r) for r in trie.end_digests(ends).collect()} == {(1, 2, digest(members)), (1, 3, digest([9]))}


def test_op12(spark, folder, docs):
    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = Counter()
    for d, t, *_ in docs:
        ids = np.array(encode(t or ""), "<u4")
        want[d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = Q.op12_byte_bpe(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, got.collect())) == want


def test_bpe_blocks_and_columns(spark, folder, docs, monkeypatch):
    small = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60 or doc_id is null")
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 500)
    found = bpe.encode(small, RANKS, keep=("doc_id", "lang", "decoded", "block"))
    assert found.columns == ["doc_id", "lang", "decoded", "block", "ids"]
    texts = Counter(bytes(r.decoded) for r in bpe.decode(found.drop("decoded"), RANKS).collect())
    assert texts == Counter((r.text or "").encode() for r in small.collect())
    with pytest.raises(ValueError):
        bpe.encode(small, RANKS, keep=("ids",))
    with pytest.raises(ValueError):
        bpe.decode(found, RANKS)


def test_bpe_of_no_rows_and_strange_ids(spark):
    none = bpe.decode(bpe.encode(spark.createDataFrame([], DOCS), RANKS), RANKS)
    assert none.collect() == [] and none.columns == ["doc_id", "ids", "decoded"]
    null = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bpe.decode(null, RANKS).first().decoded is None
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, np.array([70_000], "<u4").tobytes())], "doc_id long, ids binary"), RANKS).collect()


def test_stand_ins_follow_the_library():
    split = bpe.Splitter(public_tokenizers.PATTERN)
    one = {bytes([i]): i for i in range(256)}
    letters = tiktoken.Encoding("letters", pat_str=r"\p{L}", mergeable_ranks=one, special_tokens={})
    for c in ("՘", "࢏", "Ᲊ", "\U00011de0", "é", "日"):
        assert split(f"x{c}y") == ([f"x{c}y"] if letters.encode_ordinary(c) else ["x", c, "y"])


def own_audit(docs, marks, part=lambda d: d[2] or ""):
    good, toxic = ({i for i, *m in marks if m[k] == 1} for k in (0, 1))
    least = {}
    for d, t, *_ in docs:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    kinds = Counter()
    for doc in docs:
        d, t = doc[0], doc[1] or ""
        w = re.findall(SPACE, t)
        failed = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t]}
        kinds[part(doc), frozenset(k for k, v in failed.items() if v), d is not None and d in good, d is not None and d in toxic] += 1
    out, removed_in_all = {}, Counter()
    for p in {k[0] for k in kinds}:
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                done, row = set(order[:k]), Counter()
                for (q, failed, g, x), n in kinds.items():
                    if q == p:
                        there = not failed & done
                        row["kept"] += n * (there and f not in failed)
                        row["removed"] += n * (there and f in failed)
                        row["redundant"] += n * (not there and f in failed)
                        row["unique"] += n * (failed == {f})
                        row["good"] += n * (there and f in failed and g)
                        row["toxic"] += n * (there and f in failed and x)
                out[p, "".join(order), k + 1] = row
                removed_in_all[p, f] += row["removed"]
    return {(*k, *(r[c] for c in ("kept", "removed", "redundant", "unique", "good", "toxic")), removed_in_all[k[0], k[1][k[2] - 1]]) for k, r in out.items()}


def test_op13(spark, folder, docs, marks):
    got = Q.op13_filter_audit(spark, folder)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == own_audit(docs, marks)


def test_audit_of_other_parts_and_no_rows(spark, folder, docs, marks):
    d, m = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    assert {tuple(r) for r in audit.interactions(d, m, part="source").collect()} == own_audit(docs, marks, lambda _: "s")
    assert audit.edges(audit.classes(d, m)).count() == 80 * len({x[2] or "" for x in docs})
    assert audit.interactions(d.limit(0), m).collect() == []
    assert {r.good_lost + r.toxic_lost for r in audit.interactions(d, m.limit(0)).collect()} == {0}
