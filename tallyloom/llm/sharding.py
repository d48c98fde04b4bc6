"""Resharding by minimum-cost flow: the block transfers that move the fewest bytes.

Old shard sizes feed the flow, new capacities drain it, and a byte costs 0 where
it stays and 1 (or a given price) where it moves.  Each old shard's rows lie on
a line of bytes, in blocks; the flow cuts the line into one interval for each
new shard, the shard's own first.  A block inside one interval moves or stays
whole; only blocks that a cut crosses are split by row, each row going where its
middle lies.  Cuts fall between rows, so shards then differ by a few rows'
sizes; further flows over lines that end in the smallest rows even that out.

The driver sees sizes by shard and block only: shards * MOST_BLOCKS rows at most
in the first flow, shards * 64 size classes * SIZED_BLOCKS in the further ones.

Rows are known by a key given when they are first written to shards; the shards
that gain or lose rows are then rewritten, whole rows with all their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tallyloom.llm.store import written

#: Rows that a block should hold, the most blocks in a shard, and in a size class of a shard.
BLOCK_ROWS, MOST_BLOCKS, SIZED_BLOCKS = 20_000, 4096, 32


def min_cost_flow(sizes: list[int], capacities: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[s][d] in bytes: all of sizes placed within capacities at the least cost.

    Successive cheapest augmenting paths; the graph has a node for each shard.
    """
    if sum(sizes) > sum(capacities):
        raise ValueError("the new capacities hold less than the old shards")
    flow, left, room = [[0] * len(capacities) for _ in sizes], list(sizes), list(capacities)
    while any(left):
        best: dict[tuple[str, int], tuple[int, tuple[str, int] | None]] = {("s", s): (0, None) for s, n in enumerate(left) if n}
        changed = True
        while changed:
            changed = False
            for (side, x), (c, _) in list(best.items()):
                for y in range(len(capacities) if side == "s" else len(sizes)):
                    if side == "d" and not flow[y][x]:
                        continue
                    to, price = (("d", y), c + cost[x][y]) if side == "s" else (("s", y), c - cost[y][x])
                    if to not in best or price < best[to][0]:
                        best[to] = (price, (side, x))
                        changed = True
        end = min((x for x in best if x[0] == "d" and room[x[1]]), key=lambda x: (best[x][0], x[1]))
        path = [end]
        while best[path[-1]][1] is not None:
            path.append(best[path[-1]][1])
        path.reverse()
        amount = min(left[path[0][1]], room[end[1]], *(flow[b[1]][a[1]] for a, b in zip(path, path[1:], strict=False) if a[0] == "d"))
        for a, b in zip(path, path[1:], strict=False):
            if a[0] == "s":
                flow[a[1]][b[1]] += amount
            else:
                flow[b[1]][a[1]] -= amount
        left[path[0][1]] -= amount
        room[end[1]] -= amount
    return flow


def _cuts(flow: list[int], home: int) -> list[tuple[int, int]]:
    """(end, shard) of each interval of an old shard's line, its own shard first."""
    out, at = [], 0
    for d in sorted((d for d, n in enumerate(flow) if n), key=lambda d: (d != home, d)):
        at += flow[d]
        out.append((at, d))
    return out


def _deal(rows: DataFrame, block: Column, targets: list[int], olds: int) -> DataFrame:
    """rows (old, size, tie, ...) with `shard` by one flow; block: the order of the line, ascending."""
    spark = rows.sparkSession
    rows = rows.withColumn("block", block)
    table: dict[int, list[tuple[int, int]]] = {s: [] for s in range(olds)}
    for r in rows.groupBy("old", "block").agg(F.sum("size").alias("size")).orderBy("old", "block").toLocalIterator():
        table[r.old].append((r.block, r.size))
    sizes = [sum(n for _, n in table[s]) for s in range(olds)]
    flow = min_cost_flow(sizes, targets, [[int(s != d) for d in range(len(targets))] for s in range(olds)])
    whole, split = [], []
    for s, blocks in table.items():
        cuts, at = _cuts(flow[s], s), 0
        for b, n in blocks:
            inside = [(end, d) for end, d in cuts if end > at]
            last = next((k for k, (end, _) in enumerate(inside) if end >= at + n), len(inside) - 1)
            if last <= 0:
                whole.append((s, b, inside[0][1] if inside else s))
            else:
                split.append((s, b, at, [c[0] for c in inside[:last]], [c[1] for c in inside[: last + 1]]))
            at += n
    key = [T.StructField("old", T.IntegerType()), T.StructField("block", T.LongType())]
    whole_df = spark.createDataFrame(whole, T.StructType([*key, T.StructField("shard", T.IntegerType())]))
    split_df = spark.createDataFrame(split, T.StructType([*key, T.StructField("at", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("to", T.ArrayType(T.IntegerType()))]))
    line = W.partitionBy("old", "block").orderBy("tie", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = rows.join(F.broadcast(split_df), ["old", "block"]).withColumn("middle", F.col("at") + F.sum("size").over(line) - F.expr("size div 2"))
    cut = cut.withColumn("shard", F.expr("element_at(to, size(filter(ends, e -> e <= middle)) + 1)"))
    return rows.join(F.broadcast(whole_df), ["old", "block"]).drop("block").unionByName(cut.drop("block", "at", "ends", "to", "middle"))


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (d < total % shards) for d in range(shards)]


def reshard(rows: DataFrame, shards: int, olds: int, capacities: list[int] | None = None, tolerance: float = 0.002, rounds: int = 4) -> DataFrame:
    """rows with `shard` beside `old`, capacities met to within a row or tolerance.

    rows: doc_id, old (int from 0), size (long, 1 or more) and any other columns
    (none named shard, tie or block).  Null and repeated doc_ids are rows like
    any other.  An empty table gives an empty table.  Which of several equal
    rows goes where is free, and fixed once written.
    """
    rows = written(rows.withColumn("tie", F.xxhash64(*(c for c in ("row", "doc_id", "size") if c in rows.columns))), "rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = capacities or even(total, shards)
    blocks = max(1, min(MOST_BLOCKS, n // (BLOCK_ROWS * olds) + 16))
    fewer = min(blocks, SIZED_BLOCKS)
    spread = F.pmod(F.col("tie"), F.lit(blocks)).cast("long")
    small_last = F.lit(64) - F.floor(F.log2("size"))
    moved = written(_deal(rows, spread, targets, olds), "dealt")
    off = None
    for _ in range(rounds):
        have = {r.shard: r.size for r in moved.groupBy("shard").agg(F.sum("size").alias("size")).toLocalIterator()}
        worst = max(abs(have.get(d, 0) - t) for d, t in enumerate(targets))
        if off is not None and worst >= off[0]:
            return off[1].drop("tie")
        off = (worst, moved)
        if worst <= tolerance * total / shards:
            break
        room = [max(t, 0) for t in targets]
        again = _deal(moved.withColumnsRenamed({"old": "first", "shard": "old"}), small_last * fewer + F.pmod(F.col("tie"), F.lit(fewer)), room, len(targets))
        moved = written(again.withColumn("old", F.col("first")).drop("first"), "dealt")
    return off[1].drop("tie")


def slots(rows: DataFrame, blocks: int = 256) -> DataFrame:
    """rows with `slot`: gapless from 0 within each shard, by blocks whose counts the driver adds up."""
    spark = rows.sparkSession
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    base, at = [], {}
    for r in rows.groupBy("shard", "block").count().orderBy("shard", "block").toLocalIterator():
        base.append((r.shard, r.block, at.get(r.shard, 0)))
        at[r.shard] = at.get(r.shard, 0) + r["count"]
    base_df = spark.createDataFrame(base, "shard int, block int, base long")
    order = W.partitionBy("shard", "block").orderBy("doc_id")
    return rows.join(F.broadcast(base_df), ["shard", "block"]).withColumn("slot", F.col("base") + F.row_number().over(order) - 1).drop("base", "block")


def write_shards(docs: DataFrame, shard: Column, out: str) -> DataFrame:
    """Writes docs in a Parquet folder for each shard and returns the manifest (shard, path).

    Each row gets a key of its own, `row`, by which it is known from then on.
    docs must not have columns named row or shard.
    """
    spark = docs.sparkSession
    docs.withColumns({"row": F.monotonically_increasing_id(), "shard": shard}).write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(out)
    schema = T.StructType([*docs.schema.fields, T.StructField("row", T.LongType()), T.StructField("shard", T.IntegerType())])
    shards = spark.read.schema(schema).parquet(out).select("shard").distinct()
    return spark.createDataFrame(sorted((r.shard, f"{out}/shard={r.shard}") for r in shards.toLocalIterator()), "shard int, path string")


def read_shards(spark: SparkSession, manifest: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of all shards, with `shard`.  schema: that of the rows in the files."""
    roots: dict[str, list[str]] = {}
    for r in manifest.orderBy("shard").toLocalIterator():
        roots.setdefault(r.path.rsplit("/", 1)[0], []).append(r.path)
    out = spark.createDataFrame([], whole := T.StructType([*schema.fields, T.StructField("shard", T.IntegerType())]))
    for root, paths in roots.items():
        out = out.unionByName(spark.read.schema(whole).option("basePath", root).parquet(*paths))
    return out


def rewrite(spark: SparkSession, manifest: DataFrame, assigned: DataFrame, out: str, key: str = "doc_id") -> DataFrame:
    """Writes the shards that gain or lose rows, in a folder of their own each; the others' folders stay as they are.

    manifest: (shard, path) of each old shard's Parquet folder.  assigned:
    (key, old, shard), a row for each row of the shards.  key: the column that
    tells rows apart, `row` where write_shards wrote them; a key that repeats is
    refused, as its rows could be lost or doubled.  Returns the new manifest, of
    the shards that hold rows.  A rerun writes the same folders again.
    """
    if key != "row" and assigned.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} repeats: rows need a key of their own")
    moved = assigned.where("old <> shard")
    touched = {r[0] for r in moved.select("old").union(moved.select("shard")).distinct().toLocalIterator()}
    paths = {r.shard: r.path for r in manifest.toLocalIterator()}
    old = [paths[s] for s in sorted(touched) if s in paths]
    if old:
        rows, goal = spark.read.parquet(*old), assigned.where(F.col("old").isin(*touched)).select(F.col(key).alias("goal_key"), "shard")
        # only the ids are held by the join, texts stream past; they are shuffled once
        placed = rows.join(goal.hint("shuffle_hash"), rows[key].eqNullSafe(goal["goal_key"])).drop("goal_key")
        placed.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(out)
    held = {r.shard for r in assigned.select("shard").distinct().toLocalIterator()}
    new = {s: p for s, p in paths.items() if s not in touched} | {s: f"{out}/shard={s}" for s in touched & held}
    return spark.createDataFrame(sorted(new.items()), "shard int, path string")
