"""The prefix trie of conversations: shared beginnings, and what sharing them saves.

A conversation is a sequence of turns (role, text).  Each turn is known by a
cryptographic digest, and each prefix by the digest of the prefix before it and
its last turn: the prefixes of all conversations, one row each, grouped by
(depth, digest), are the nodes.  Digests are chained in blocks of BLOCK turns
and the blocks by the same rule, so that a conversation of any length is spread
over tasks.

A node is named by its least member.  Going down from a node, its least member
stays the least for as long as it lasts, so the nodes of one name are a chain,
and (name, depth) is a node.  Sums over subtrees come by exploding each chain to
all chains above it, as its member's own prefixes name them: a chain has at most
as many ancestors as its member has turns, so these rows are never more than the
prefixes, however long or deep the conversations are.

Turns are in order of turn, null first; ties by role, then by the text's digest.
A null role or text is empty.  Rows without a conv_id belong to no conversation.
Equal rows are turns of their own.  An empty table has no conversations, and so
no node at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyloom.llm import textops as X
from tallyloom.llm.store import partitions, written

#: Turns of a conversation that are chained in one row.
BLOCK = 1 << 8
#: Turns whose sums are taken in one window, and ids whose decimals are joined in one row: 1 << STRETCH.
STRETCH = 12
#: What is added up over subtrees.
SUMS = ("n_leaves", "saved_tokens")


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _seed() -> Column:
    return F.unhex(F.sha2(F.lit("").cast("binary"), 256))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars) of (conv_id, turn, role, text): pos counts a conversation's turns from 1.

    Turns are sorted over the whole table by range, so that a conversation may
    lie in many tasks; what each of these holds of it gives the others' offsets.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), _sha(F.sha2(role, 256).cast("binary"), F.sha2(text, 256).cast("binary")).alias("digest"), F.length(text).cast("long").alias("chars"))
    order = ("conv_id", F.asc_nulls_first("turn"), "role", "digest")
    rows = rows.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    rows = written(rows.select("conv_id", "digest", "chars", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("task")), "turns")
    own = rows.groupBy("conv_id", "task").agg(F.min("at").alias("from"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = own.select("conv_id", "task", (before - F.col("from") + 1).alias("shift"))
    return rows.join(own, ["conv_id", "task"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "digest", "chars")


def prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """(conv_id, pos, chars, before, prefix) of (conv_id, pos, digest, chars): the digests of the prefixes that end before and with each turn.

    longest: the most turns of a conversation.
    """
    block = F.shiftright(F.col("pos") - 1, 8)
    rows = turns.groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("turns"))
    chain = F.aggregate("turns", F.array(_seed()), lambda done, t: F.concat(done, F.array(_sha(F.element_at(done, -1), t["digest"]))))
    rows = rows.select("conv_id", "block", F.transform("turns", lambda t: F.struct(t["pos"].alias("pos"), t["chars"].alias("chars"))).alias("turns"), chain.alias("chain"))
    if longest <= BLOCK:
        base, whole = None, None
    else:
        rows = written(rows, "blocks")
        above = rows.select("conv_id", (F.col("block") + 1).alias("pos"), F.element_at("chain", -1).alias("digest"), F.lit(0).cast("long").alias("chars"))
        above = prefixes(above, -(-longest // BLOCK)).select("conv_id", (F.col("pos") - 1).alias("block"), F.col("before").alias("base"), F.col("prefix").alias("whole"))
        rows = rows.join(above, ["conv_id", "block"])
        base, whole = F.col("base"), F.col("whole")
    # the chain has one element more than the turns: the one before the first
    out = rows.select("*", F.posexplode("turns").alias("i", "t"))
    ends, begins = F.col("chain")[F.col("i") + 1], F.col("chain")[F.col("i")]
    if base is not None:
        ends = F.when(F.col("t.pos") % BLOCK == 0, whole).otherwise(_sha(base, ends))
        begins = F.when(F.col("i") == 0, base).otherwise(_sha(base, begins))
    return out.select("conv_id", F.col("t.pos").alias("pos"), F.col("t.chars").alias("chars"), begins.alias("before"), ends.alias("prefix"))


def rebuilt(turns: DataFrame, head: Column, other: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """((conv_id, n), (conv_id, pos, digest, chars)) of conversations that each begin with the first turns of another.

    head: of conv_id, how many turns, at most `most`; other: of conv_id, whose.
    A conversation's own turns follow after its first `head` ones.  turns: as
    numbered() gives them, written.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n_own")).select("conv_id", "n_own", head.cast("long").alias("head"), other.cast("long").alias("other"))
    first = turns.where(F.col("pos") <= most).groupBy(F.col("conv_id").alias("other")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("first"))
    own = own.join(first, "other", "left").select("conv_id", "n_own", "head", F.slice(F.coalesce("first", F.array().cast(first.schema["first"].dataType)), 1, F.col("head").cast("int")).alias("first"))
    own = written(own.withColumn("n", F.size("first") + F.greatest(F.col("n_own") - F.col("head"), F.lit(0))), "conversations")
    begin = own.select("conv_id", F.explode("first").alias("t")).select("conv_id", "t.*")
    rest = turns.join(own.select("conv_id", "head", F.size("first").alias("k")), "conv_id").where("pos > head").select("conv_id", (F.col("pos") - F.col("head") + F.col("k")).alias("pos"), "digest", "chars")
    return own.select("conv_id", "n"), begin.unionByName(rest)


def below(nodes: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """nodes with each of sums added up over the nodes of its chain from its depth on, a chain in stretches that go to tasks of their own."""
    stretch = F.shiftright("depth", STRETCH)
    w = W.partitionBy("conv_id", "stretch").orderBy(F.desc("depth"))
    nodes = written(nodes.withColumn("stretch", stretch), "own-sums")
    long = nodes.groupBy("conv_id", "stretch").agg(*(F.sum(c).alias(c) for c in sums))
    after = W.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(W.unboundedPreceding, -1)
    later = long.select("conv_id", "stretch", *(F.sum(c).over(after).alias(f"later_{c}") for c in sums)).where(F.col(f"later_{sums[0]}").isNotNull())
    own = nodes.select(*(c for c in nodes.columns if c not in sums), *(F.sum(c).over(w).alias(c) for c in sums))
    added = own.join(later, ["conv_id", "stretch"], "left")
    return added.select(*(c for c in nodes.columns if c not in (*sums, "stretch")), *((F.col(c) + F.coalesce(f"later_{c}", F.lit(0))).alias(c) for c in sums))


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of (conv_id, depth, member): the digest of each node's members in decimal, ascending, joined by commas.

    Decimals of members close to each other are joined first; one pass over
    these strings in order holds no more than one of them and a state of the hash.
    """
    near = F.shiftright("member", STRETCH)
    parts = ends.groupBy("conv_id", "depth", near.alias("near")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda m: m.cast("string")), ",").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for conv, depth, part in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (conv, depth) == node:
                    state.update(b"," + part.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (conv, depth), hashlib.sha256(part.encode())
            if len(out) >= 10_000:
                yield _ends(out)
                out = []
        if node is not None:
            out.append((*node, state.hexdigest()))
        yield _ends(out)

    dealt = parts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "near")
    return dealt.select("conv_id", "depth", "part").mapInArrow(X.tidied(run), "conv_id long, depth long, ends_sha256 string")


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    conv, depth, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest, pa.string())], names=["conv_id", "depth", "ends_sha256"])


def nodes(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each node of the trie of (conv_id, pos, digest, chars), its conversations listed in (conv_id, n) with their turns.

    conv_id: the least member; depth; parent_conv_id; n_convs; n_children;
    n_leaves, childless nodes of the subtree; saved_tokens, over the subtree, the
    code points of each node's last text for each member but one; ends_sha256.
    """
    spark = conversations.sparkSession
    longest, least, members = conversations.agg(F.max("n"), F.min("conv_id"), F.count("*")).first()
    first = F.lit(least).cast("long")
    each = written(prefixes(turns, longest or 0).select("conv_id", F.col("pos").alias("depth"), "prefix", "chars"), "prefixes")
    found = each.groupBy("depth", "prefix").agg(F.min("conv_id").alias("name"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    # which node each prefix is: the hottest keys are the shortest prefixes, whose rows Spark splits as skewed, as both sides come from files
    found = written(found, "found")
    node = F.when(F.col("conv_id") == F.col("name"), F.struct("n_convs", "chars"))
    named = written(each.select("conv_id", "depth", "prefix").join(found, ["depth", "prefix"]).select("conv_id", "depth", "name", node.alias("node")), "named")
    above = named.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    own = named.where("node is not null").select("conv_id", "depth", "node.*").join(above, ["conv_id", "depth"], "left")
    own = own.select("conv_id", "depth", F.coalesce("parent", first).alias("parent_conv_id"), "n_convs", "chars")
    root = spark.createDataFrame([(least, 0, None, members, 0)] if members else [], "conv_id long, depth long, parent_conv_id long, n_convs long, chars long")
    own = written(own.unionByName(root), "nodes")
    children = own.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    own = own.join(children, ["conv_id", "depth"], "left").fillna(0, ["n_children"])
    own = own.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    own = written(own, "own")
    chains = own.groupBy("conv_id").agg(*(F.sum(c).alias(f"more_{c}") for c in SUMS))
    # the chains that a chain's member passes on its way down, and how far; all but the root's own have the root above them
    passed = named.where("conv_id <> name").select("conv_id", "name", "depth").unionByName(chains.where(F.col("conv_id") != first).select("conv_id", first.alias("name"), F.lit(0).cast("long").alias("depth")))
    passed = passed.groupBy("conv_id", "name").agg(F.max("depth").alias("depth"))
    given = passed.join(chains, "conv_id").groupBy(F.col("name").alias("conv_id"), "depth").agg(*(F.sum(f"more_{c}").alias(f"more_{c}") for c in SUMS))
    own = own.join(given, ["conv_id", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in SUMS))
    last = conversations.select("conv_id", F.col("n").alias("depth"))
    ends = last.join(named.select("conv_id", "depth", "name"), ["conv_id", "depth"], "left")
    digests = end_digests(ends.select(F.coalesce("name", first).alias("conv_id"), "depth", F.col("conv_id").alias("member")))
    out = below(own, SUMS).join(digests, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *SUMS, F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
