"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmap signatures, sorted-array intersection.

Two documents link when the Jaccard similarity of their sets of word n-grams
reaches percent/100.  Sets are arrays of 64-bit n-gram hashes.

1. Equal sets become one node, known by a hash of the set.
2. Let c be the least overlap that a set of n n-grams needs to link, and l(n) a
   small share of n.  Of two sets that link, the first n - c + l(n) n-grams in
   the order of hashes have l of the smaller in common.  So a node stays only if
   so many of these n-grams occur in other nodes' too.
3. The n-grams of the nodes that stay are ordered by how many of these nodes
   hold them, rarest first.  Two sets that link share one of their first
   n - c + 1.  What many documents share (a passage, a frequent n-gram) stands
   last and draws in only nodes that consist of it.
4. Nodes that share such an n-gram form a star around the least one.  Each node
   goes once to one of its stars, in blocks that all hold the centre, and what
   links there is joined.  N-grams whose holders are joined by now are done:
   that is how large groups of near copies are settled, in rows linear in them.
5. Nodes that share any other n-gram are candidates still; components of these
   hold all links that are left.  Each component is cut into tiles of neighbouring
   size bands, outside of which no two sizes can link, and tiles over `block`
   nodes into pairs of blocks, so a task holds 2 * block sets.  In a tile, the
   bits set in one bitmap only bound the overlap from above; where that bound
   leaves a link possible and the two are not yet connected, the sorted arrays
   are intersected.  The links found span what all links span, and their
   components are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyloom.llm import textops as X
from tallyloom.llm.graph import components
from tallyloom.llm.store import few, without, written

#: Nodes of a block of a tile, and of a star, whose blocks all hold the centre.
BLOCK, STAR_BLOCK = 1000, 200
#: Nodes that a task remembers having sent; it then starts afresh.
SENT = 1_000_000


def least_overlap(n: int, percent: int) -> int:
    """The n-grams that a set of n has in common with any set it links with, at least."""
    return -(-percent * n // 100)


def spare(n: int) -> int:
    """l(n): n-grams that a first prefix has beyond what one common n-gram needs; grows with n."""
    return -(-n // 10)


def shingles(w: X.Words, i: int, size: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of row i; with fewer words the whole sequence is one, without words none."""
    h = w.hash[w.of(i)]
    if not len(h):
        return h
    k = min(size, len(h))
    out = X.mix(h[: len(h) - k + 1] + np.uint64(k))
    for j in range(1, k):
        out = X.mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return X.runs(out)[0]


def set_key(s: np.ndarray) -> int:
    return int(np.add.reduce(X.mix(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)) if len(s) else 0


def _each_set(docs: DataFrame, size: int, row, schema: str, columns: tuple[str, ...] = (), limit: int = X.PIECE_BYTES) -> DataFrame:
    """row(values of columns, set) as rows of schema, for each row of docs and its set; None: no row."""
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[x.split(" ")[1]] for x in schema.split(", ")]

    @X.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for part in X.pieces(batch, limit=limit):
                w = X.words(part.column("text"), X.NOT_SPACE, lower=True)
                values = zip(*(part.column(c).to_pylist() for c in columns), strict=True) if columns else [()] * part.num_rows
                out = [x for i, v in enumerate(values) for x in row(v, shingles(w, i, size), sent)]
                if len(sent) > SENT:
                    sent.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)], names)

    return docs.select(*columns, "text").mapInArrow(run, schema)


def _first_prefix(percent: int):
    """(node, its first n-grams by hash), once a task."""

    def row(_: tuple, s: np.ndarray, sent: set[int]) -> list[tuple]:
        node = set_key(s)
        if not len(s) or node in sent:
            return []
        sent.add(node)
        return [(node, s[: len(s) - least_overlap(len(s), percent) + spare(len(s))].view(np.int64))]

    return row


def _shared(rows: DataFrame, name: str, by: str = "node") -> DataFrame:
    """rows (node, token, ...) whose token has two values of `by` or more, with `least` of these, `centre`, the least node, and `holders`.

    A token's holders are aggregated before they are shuffled; rows are made
    again for the join, where Spark splits a token with many holders.
    """
    held = rows.groupBy("token").agg(F.min(by).alias("least"), F.max(by).alias("most"), F.min("node").alias("centre"), F.count("*").alias("holders")).where("least <> most").drop("most")
    return rows.join(written(held, name, release=True), "token")


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words for each set; at least 4 bits for each member of the median set."""
    bits = 256
    while bits < min(8192, 4 * int(np.median([len(s) for s in sets]))):
        bits *= 2
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for i, s in enumerate(sets):
        b = (s >> np.uint64(7)) % np.uint64(bits)
        np.bitwise_or.at(out[i], (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
    return out


def tile_links(nodes: np.ndarray, sets: list[np.ndarray], percent: int, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a tile that span the components of all its links; joined: equal for nodes that are connected already."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), nodes[i]))
    nodes, sets = nodes[order], [sets[i] for i in order]
    size, maps = np.array([len(s) for s in sets]), _bitmaps(sets)
    root, links = np.arange(len(sets)) if joined is None else np.unique(joined[order], return_inverse=True)[1], []
    for i in range(1, len(sets)):
        lo = int(np.searchsorted(size[:i], -(-percent * size[i] // 100)))
        if lo == i:
            continue
        most = np.minimum(size[lo:i] - np.bitwise_count(maps[lo:i] & ~maps[i]).sum(1, np.int64), size[i] - np.bitwise_count(maps[i] & ~maps[lo:i]).sum(1, np.int64))
        left = lo + np.flatnonzero(100 * most >= percent * (size[lo:i] + size[i] - most))
        left = left[np.argsort(-most[left - lo], kind="stable")]
        while len(left := left[root[left] != root[i]]):
            j = left[0]
            both = np.searchsorted(sets[i], sets[j])
            common = int((sets[i][np.minimum(both, size[i] - 1)] == sets[j]).sum())
            if 100 * common >= percent * (size[i] + size[j] - common):
                links.append((int(nodes[i]), int(nodes[j])))
                root[root == root[i]] = root[j]
            else:
                left = left[1:]
    return links


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of docs.

    component_id is the least doc_id that links reach.  Rows with a null or
    empty text, or without words, have no shingles and link with nothing, not
    even with each other.  A row with a null doc_id links like any other and
    lends its id to none; its component is null only if no row that it reaches
    has an id.  Rows that repeat a doc_id are compared each by its own text.
    Other columns are not read.  An empty table gives no rows.
    """
    # rows without an id are known by a hash of their text; each such text is read once
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    own = F.coalesce("doc_id", F.xxhash64("text"))
    rows = written(_each_set(docs.select(own.alias("key"), F.col("doc_id"), "text"), size, lambda v, s, _: [(*v, len(s), set_key(s))], "key long, doc_id long, n long, node long", ("key", "doc_id")), "sets")
    lone = docs.where("doc_id is null and text is not null").select(F.xxhash64("text").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    docs = docs.where("doc_id is not null").unionByName(lone)
    node = rows.where("n > 0").groupBy("node").agg(F.min("key").alias("doc_id"), F.min("n").alias("n"))
    first = _each_set(docs, size, _first_prefix(percent), "node long, tokens array<long>").select("node", F.explode("tokens").alias("token"))
    partner = F.ceil(F.col("n") * percent / 100)
    enough = F.ceil(partner / 10)
    stay = _shared(first, "first").groupBy("node").count().join(node, "node").where(F.col("count") >= enough).select("doc_id", F.col("node").alias("expected"))
    stay = written(stay, "stay", release=True)
    texts = docs.join(F.broadcast(stay) if few(stay) else stay.hint("shuffle_hash"), "doc_id")
    tokens = _each_set(texts, size, lambda v, s, _: [(v[0], len(s), s.view(np.int64))] if set_key(s) == v[0] else [], "node long, n long, tokens array<long>", ("expected",))
    tokens = _shared(tokens.select("node", "n", F.explode("tokens").alias("token")), "tokens")
    # n-grams of one holder come before all others in the order, so those of two or more begin after them;
    # ranks are dense, as rows that repeat a doc_id repeat its n-grams
    nth = tokens.withColumn("nth", F.dense_rank().over(W.partitionBy("node").orderBy("holders", "token")))
    place = F.col("nth") + F.col("n") - F.max("nth").over(W.partitionBy("node"))
    prefix = written(nth.withColumn("place", place).where(F.col("place") <= F.col("n") - partner + 1).select("node", "token"), "prefix", release=True)
    stars = _shared(prefix, "stars").where("node <> least").groupBy("node").agg(F.min("least").alias("hub"))
    stars = written(stars, "hubs")
    first_links = written(_linked(docs, _star_places(stars, node, min(block, STAR_BLOCK)), size, percent), "star_links")
    joined = written(components(first_links, "a", "b"), "joined")
    still = prefix.join(joined, "node", "left").select("node", "token", F.coalesce("root", "node").alias("joined"))
    open_ = _shared(written(still, "still"), "open", by="joined").select("node", "token", "joined", "centre")
    open_ = written(open_, "candidates")
    tile = components(open_.select("node", "centre"), "node", "centre")
    tile = written(tile.join(open_.select("node", "joined").distinct(), "node"), "tiles", release=True)
    linked = _linked(docs, _tile_places(tile, node, percent, block), size, percent).unionByName(first_links)
    comp = components(linked, "a", "b")
    labelled = rows.where("n > 0").select("doc_id", "n", "node").join(comp, "node", "left").select("doc_id", "n", F.coalesce("root", "node").alias("root"))
    labelled = written(labelled, "labelled", release=True)
    # most roots are of one row, which is its own component
    least = written(labelled.groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("root", "least"), "least")
    labelled = labelled.join(F.broadcast(least) if few(least) else least, "root", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    return (
        labelled.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        .unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    )


def _star_places(stars: DataFrame, node: DataFrame, block: int) -> DataFrame:
    """(doc_id, expected, joined, places) of stars (node, hub): a node in one block of its star, the centre in all."""
    sizes = stars.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    some = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    rays = stars.join(sizes, "hub").select("node", "hub", some.alias("i"))
    hubs = sizes.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    place = F.struct(F.col("hub").alias("root"), F.lit(0).cast("long").alias("tile"), "i", F.col("i").alias("j"))
    at = rays.unionByName(hubs).groupBy("node").agg(F.collect_list(place).alias("places"))
    return at.join(node, "node").select("doc_id", F.col("node").alias("expected"), F.col("node").alias("joined"), "places")


def _tile_places(tile: DataFrame, node: DataFrame, percent: int, block: int) -> DataFrame:
    """(doc_id, expected, joined, places) of nodes with a root each: the tiles and pairs of blocks that each takes part in."""
    at = tile.join(node, "node").withColumn("band", F.floor(F.ln("n") / np.log(100 / percent) + 1e-9))
    both = at.select("root", "doc_id", "joined", "node", F.explode(F.array(F.col("band") - 1, F.col("band"))).alias("tile"))
    sizes = both.groupBy("root", "tile").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    each = both.join(sizes, ["root", "tile"]).select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k"))
    place = F.struct("root", "tile", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"))
    return each.groupBy("doc_id", F.col("node").alias("expected"), "joined").agg(F.collect_list(place).alias("places"))


def _linked(docs: DataFrame, places: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links found where nodes are placed together, spanning all that are there."""
    member = places.select("doc_id", "expected", "joined", *(F.col(f"places.{c}").alias(c) for c in ("root", "tile", "i", "j")))
    member = written(member, "members")
    texts = docs.join(F.broadcast(member) if few(member) else member.hint("shuffle_hash"), "doc_id")
    placed = _each_set(texts, size, _placed, "root long, tile long, i int, j int, node long, joined long, grams binary", ("expected", "joined", "root", "tile", "i", "j"), X.PIECE_BYTES // 4)
    return placed.groupBy("root", "tile", "i", "j").applyInPandas(lambda p: _solve(p, percent), "a long, b long")


def _placed(values: tuple, s: np.ndarray, _: set[int]) -> list[tuple]:
    """A row for each place of the set; none for another text under the same doc_id."""
    expected, joined, *places = values
    if set_key(s) != expected:
        return []
    grams = s.tobytes()
    return [(*at, expected, joined, grams) for at in zip(*places, strict=True)]


def _solve(p: pd.DataFrame, percent: int) -> pd.DataFrame:
    p = p.drop_duplicates("node")
    links = tile_links(p.node.to_numpy(np.int64), [np.frombuffer(b, np.uint64) for b in p.grams], percent, p.joined.to_numpy(np.int64))
    return pd.DataFrame({"a": [a for a, _ in links], "b": [b for _, b in links]}, dtype="int64")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """The rows of docs whose doc_id is the least of its component; of rows that repeat such an id all stay, rows without an id stay too."""
    return without(docs, jaccard_components(docs, size, percent, block).where("doc_id <> component_id"), "doc_id")
