"""Language-model scores by a hierarchical Pitman-Yor model of words after words, over their spelling.

Each word is a restaurant for the words that follow it; all of these share one
parent, the word restaurant, whose tables order from a spelling model.  That is
a hierarchy of its own: a restaurant for each context of up to three preceding
character classes, each sharing the parent of the next shorter context, down to
a uniform base.  So a word never seen still has the probability of its spelling,
and all probabilities sum to one.  The end of a text is a word, and stands before
its first one.

Customers of the context restaurants are the training tokens, those of a parent
the tables of its children.  Gibbs sweeps go down and up again: the spelling is
seated given the words' tables; the words' tables are drawn given the spelling,
then each context's given the words' probabilities; the sums of tables go back
up as the customers of the next sweep.  A dish's number of tables comes from its
full conditional given all other tables (generalised Stirling numbers), up to
EXACT customers; beyond, its customers are seated in turn.  All restaurants of a
level are drawn side by side, given the totals of the sweep before.  Predictive
probabilities are averaged over the samples after burn-in.

Three kinds of groups send each other packed arrays, in an order that both ends
know: blocks hold texts, parts hold words (the word restaurant), buckets hold
pairs (the context restaurants).  A context with over 1/5000 of all tokens lies
in many buckets; its sums are added up by Spark.  Draws are keyed by hashes of
words, so that no result depends on how many groups there are.  Nothing is
broadcast but the spelling (32**4 rows at most) and up to 5000 sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import textops as X
from tallyloom.llm.store import MOST_FILES, clustered, new_path, partitions, released

SAMPLES, BURN_IN, STRENGTH = 2, 1, 1.0
#: Discount of the context restaurants.
CONTEXT_DISCOUNT = 0.75
#: Customers up to which a dish's tables are drawn from their full conditional.
EXACT = 32
BLOCK_BYTES, LEAST_BYTES, BUCKET_TOKENS, MOST_HOT = 12 << 20, 1 << 20, 1_500_000, 5000
#: The probability that a new table of the word restaurant serves the end of a text, and the end's hash.
END_BASE = 1e-6
END = np.uint64(0x5EED0F7E47E4D001)

BASE, ORDER = 32, 4
_CLASS = np.full(256, 29, np.uint8)  # punctuation and control
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = np.arange(1, 27)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x30:0x3A] = 27
_CLASS[[*b"#*$%&|<>"]] = 28
_CLASS[0x80:0xC0] = 30
_CLASS[0xC0:] = 31


def codes(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 4-gram of classes that ends at each byte, as a number below 32**4; before a word stand three blanks."""
    s = _CLASS[buf].astype(np.int32)
    size = np.diff(offsets)
    padded = np.zeros(len(s) + 3 * len(size), np.int32)
    at = np.arange(len(s)) + 3 * (np.repeat(np.arange(len(size)), size) + 1)
    padded[at] = s
    return ((padded[at - 3] * BASE + padded[at - 2]) * BASE + padded[at - 1]) * BASE + s


# seating


@cache
def _log_stirling(d: float) -> np.ndarray:
    """[c, t]: logarithm of the weight of all ways to seat c customers at t tables."""
    s = np.full((EXACT + 1, EXACT + 2), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, EXACT):
        t = np.arange(1, c + 1)
        s[c + 1, 1 : c + 1] = s[c, 1 : c + 1] + np.log(c - d * t)
        s[c + 1, 1 : c + 2] = np.logaddexp(s[c + 1, 1 : c + 2], s[c, : c + 1])
    return s


def seat(c: np.ndarray, new: np.ndarray, d: float, uniform: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Tables that c customers of each dish take in turn: the i-th opens one with chance new / (new + i - d * tables).

    The first 64 customers are seated one by one, later ones by doubling runs in
    which the expected number of new tables is rounded at random.
    """
    t = (c > 0).astype(np.float64)
    some = np.flatnonzero(c > 1)
    for i in range(1, 64):
        some = some[c[some] > i]
        if not len(some):
            return t
        t[some] += uniform(i, some) < new[some] / (new[some] + i - d * t[some])
    lo = 64
    while len(some := some[c[some] > lo]):
        hi = np.minimum(c[some], 2 * lo)
        t[some] += np.minimum(hi - lo, np.floor(new[some] * np.log(hi / lo) + uniform(lo, some)))
        lo *= 2
    return t


def draw(c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, uniform: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Tables of each dish with c customers, given the other dishes' tables in its restaurant and the parent's probability p."""
    t = (c > 0).astype(np.float64)
    weight = _log_stirling(d)
    order = np.argsort(c, kind="stable")
    edges = np.searchsorted(c[order], np.arange(2, EXACT + 2))
    for k, lo, hi in zip(range(2, EXACT + 1), edges[:-1], edges[1:], strict=True):
        if lo == hi:
            continue
        some = order[lo:hi]
        mass = np.cumsum(np.log((STRENGTH + d * (others[some, None] + np.arange(k))) * np.maximum(p[some, None], 1e-300)), 1) + weight[k, 1 : k + 1]
        mass = np.cumsum(np.exp(mass - mass.max(1, keepdims=True)), 1)
        t[some] = 1 + (mass[:, :-1] < (uniform(0, some) * mass[:, -1])[:, None]).sum(1)
    if edges[-1] < len(order):
        many = order[edges[-1] :]
        t[many] = seat(c[many], (STRENGTH + d * others[many]) * p[many], d, lambda i, x: uniform(i, many[x]))
    return t


def _uniform(key: np.ndarray, sweep: int) -> Callable[[int, np.ndarray], np.ndarray]:
    return lambda i, some: X.mix(key[some] + np.uint64((sweep + 1) << 32 | i)) / 2.0**64


def discount(c: np.ndarray) -> float:
    return _discount(int((c == 1).sum()), int((c == 2).sum()))


def _discount(n1: float, n2: float) -> float:
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


class Spelling:
    """Restaurants of spelling contexts; codes are 4-grams of classes, a word ending in class 0.

    sweep(n) reseats them all, n being how many tables of words order each code;
    probabilities are those of the last sweep.
    """

    def __init__(self, code: np.ndarray, of_byte: np.ndarray, seed: int = 3):
        self.rng = np.random.default_rng(seed)
        sizes = np.bincount(_CLASS[X.NOT_SPACE.nonzero()[0]], minlength=BASE)
        total = np.bincount(_CLASS, of_byte * X.NOT_SPACE, BASE)
        self.byte_log = np.where(X.NOT_SPACE, np.log((of_byte + 1.0) / (total[_CLASS] + np.maximum(1, sizes[_CLASS]))), 0.0)
        grams = [code]
        for order in range(ORDER - 1, 0, -1):
            grams.append(np.unique(grams[-1] % BASE**order))
        self.grams = grams[::-1]
        self.up = [np.searchsorted(self.grams[k - 1], self.grams[k] % BASE**k) for k in range(1, ORDER)]
        contexts = [np.unique(g // BASE, return_inverse=True) for g in self.grams]
        self.contexts, self.inside = [c for c, _ in contexts], [i for _, i in contexts]
        self.tables = [np.ones(len(g)) for g in self.grams]
        self.own, self.left = [np.zeros(len(g)) for g in self.grams], [np.ones(len(c)) for c in self.contexts]

    def sweep(self, n: np.ndarray) -> Spelling:
        counts = self._counts(n)
        p = np.full(len(self.grams[0]), 1.0 / BASE)
        for k in range(ORDER):
            base, inside = p if k == 0 else p[self.up[k - 1]], self.inside[k]
            d, m = discount(counts[k]), len(self.contexts[k])
            t = np.minimum(self.tables[k], counts[k])
            served, guests = np.bincount(inside, t, m), np.bincount(inside, counts[k], m)
            t = draw(counts[k], served[inside] - t, base, d, lambda _, some: self.rng.random(len(some)))
            served = np.bincount(inside, t, m)
            self.left[k] = (STRENGTH + d * served) / (STRENGTH + guests)
            self.own[k] = (counts[k] - d * t) / (STRENGTH + guests)[inside]
            p = self.own[k] + self.left[k][inside] * base
            self.tables[k] = t
        return self

    def _counts(self, n: np.ndarray) -> list[np.ndarray]:
        """Customers by order: those of a shorter context are the tables of the longer ones."""
        out = [n.astype(np.float64)]
        for k in range(ORDER - 1, 0, -1):
            out.insert(0, np.bincount(self.up[k - 1], np.minimum(self.tables[k], out[0]), len(self.grams[k - 1])))
        return out

    def probabilities(self, wanted: np.ndarray) -> np.ndarray:
        """Of the last class of each 4-gram after its first three."""
        p = np.full(len(wanted), 1.0 / BASE)
        for k in range(ORDER):
            own = wanted % BASE ** (k + 1)
            p = _looked_up(self.contexts[k], self.left[k], own // BASE, 1.0) * p + _looked_up(self.grams[k], self.own[k], own, 0.0)
        return p

    def log_words(self, words: pa.Array) -> np.ndarray:
        """Natural logarithm of the probability of each word's spelling, its end included."""
        if not len(words):
            return np.zeros(0)
        buf, offsets = X.bytes_of(_ended(words))
        distinct, inverse = np.unique(codes(buf, offsets), return_inverse=True)
        return np.add.reduceat(np.log(self.probabilities(distinct))[inverse] + self.byte_log[buf], offsets[:-1])


def _looked_up(known: np.ndarray, values: np.ndarray, want: np.ndarray, default: float) -> np.ndarray:
    if not len(known):
        return np.full(len(want), default)
    at = np.minimum(np.searchsorted(known, want), len(known) - 1)
    return np.where(known[at] == want, values[at], default)


def _ended(words: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(words.cast(pa.large_binary()), pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary()))


# messages

MESSAGE = "at int, sender int, kind string, data array<binary>, stats array<double>"
_KINDS = pa.schema([("at", pa.int32()), ("sender", pa.int32()), ("kind", pa.string()), ("data", pa.list_(pa.binary())), ("stats", pa.list_(pa.float64()))])
_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(a: np.ndarray) -> bytes:
    """An array with its type and length, compressed; whole numbers in as few bytes as the largest needs."""
    if a.dtype.kind in "iu":
        a = a.astype(np.min_scalar_type(int(a.max())) if len(a) else np.uint8)
    return a.dtype.str.encode() + len(a).to_bytes(8, "little") + _ZSTD.compress(a.tobytes(), asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    kind, n = np.dtype(b[:3].decode()), int.from_bytes(b[3:11], "little")
    return np.frombuffer(_ZSTD.decompress(b[11:], n * kind.itemsize, asbytes=True), kind)


def _steps(at: np.ndarray) -> np.ndarray:
    """Ascending places as what each adds to the one before."""
    return np.diff(at, prepend=0)


def _places(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.int64)


def split(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, places in it, ascending) of each group that occurs."""
    order = np.argsort(of, kind="stable")
    sorted_ = of[order]
    for at in np.split(order, np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1):
        if len(at):
            yield int(of[at[0]]), at


class Mail:
    """Rows of one group by kind, in the order of senders, and rows to send."""

    def __init__(self, table: pa.Table | None = None):
        self.rows: dict[str, list[tuple[int, list[bytes]]]] = {}
        self.out: list[tuple] = []
        if table is not None:
            self.own = table["at"][0].as_py()
            for r in sorted(zip(table["kind"].to_pylist(), table["sender"].to_pylist(), table["data"].to_pylist(), strict=True), key=lambda r: r[:2]):
                self.rows.setdefault(r[0], []).append(r[1:])

    def of(self, kind: str) -> list[tuple[int, list[bytes]]]:
        return self.rows.get(kind, [])

    def one(self, kind: str) -> list[np.ndarray]:
        """The arrays of the only row of a kind."""
        return [unpack(b) for b in self.rows[kind][0][1]]

    def send(self, at: int, sender: int, kind: str, *data: np.ndarray, stats: tuple[float, ...] = ()) -> None:
        self.out.append((at, sender, kind, [x if isinstance(x, bytes) else pack(x) for x in data], [float(x) for x in stats]))

    def table(self) -> pa.Table:
        out = pa.table([pa.array([r[i] for r in self.out], f.type) for i, f in enumerate(_KINDS)], schema=_KINDS)
        self.out, self.rows = [], {}
        X.give_back()
        return out


def _stored(df: DataFrame, name: str, release: bool = True) -> DataFrame:
    """df written with a folder for each kind, after which finished shuffles may go."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.partitionBy("kind").parquet(path)
    del df
    if release:
        released(spark)
    return spark.read.schema(MESSAGE).parquet(path)


def _grouped(groups: int, run: Callable[[pa.Table], pa.Table], *rows: DataFrame) -> DataFrame:
    out = rows[0]
    for df in rows[1:]:
        out = out.unionByName(df)
    return out.select("at", "sender", "kind", "data").repartitionById(groups, "at").groupBy("at").applyInArrow(run, MESSAGE)


def _kind(df: DataFrame, *kinds: str) -> DataFrame:
    return df.where(F.col("kind").isin(*kinds))


def _added(df: DataFrame, kind: str, n: int) -> list[float]:
    """Sums of the first n stats over rows of a kind."""
    return list(_kind(df, kind).agg(*(F.coalesce(F.sum(F.col("stats")[i]), F.lit(0.0)) for i in range(n))).first())


def _sums(df: DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(key, sum) over rows of a kind that hold keys and numbers, in the order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                key, n = unpack(data[0]), unpack(data[1])
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    table = _kind(df, kind).select("data").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = table["key"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


# blocks: texts


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, the word before each (the end before the first), and the text of each."""
    w = X.words(texts, X.NOT_SPACE, lower=True)
    rows = len(w.offsets) - 1
    at = np.arange(len(w.hash)) + w.row
    token = np.full(len(w.hash) + rows, END)
    token[at] = w.hash
    row = np.empty(len(token), np.int64)
    row[at], row[w.first[1:] + np.arange(rows)] = w.row, np.arange(rows)
    before = np.concatenate([[END], token[:-1]])
    return token, before, row


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (X.mix(h ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(parts)).astype(np.int64)


def send_words(parts: int) -> Callable[[pa.Table], pa.Table]:
    """From a block: its distinct words, their counts in training and their bytes, to the parts that hold them."""

    def run(table: pa.Table) -> pa.Table:
        mail, block, ends = Mail(), table["block"][0].as_py(), 0
        hashes, counts, spelled = [], [], []
        for batch in table.combine_chunks().to_batches():
            for part in X.pieces(batch, limit=2 * X.PIECE_BYTES):
                w = X.words(part.column("text"), X.NOT_SPACE, lower=True)
                train = ~np.array(part.column("held_out").to_pylist(), bool)
                ends += int(train.sum())
                h, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
                size = w.end[first] - w.start[first]
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(w.start[first], size)
                hashes.append(h)
                counts.append(np.bincount(inverse, train[w.row], minlength=len(h)).astype(np.int64))
                spelled.append(_binary(size, w.buf[at]))
        hashes, counts = [*hashes, np.array([END])], [*counts, np.array([ends])]
        spelled.append(pa.array([b""], pa.large_binary()))
        h, first, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        c = np.bincount(inverse, np.concatenate(counts), len(h)).astype(np.int64)
        word = pa.concat_arrays(spelled).take(pa.array(first))
        for part, at in split(_part_of(h, parts)):
            buf, offsets = X.bytes_of(word.take(pa.array(at)))
            mail.send(part, block, "words", h[at], c[at], np.diff(offsets), buf)
        return mail.table()

    return run


def _binary(size: np.ndarray, buf: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])


class Pairs:
    """The distinct pairs of a block: keys, contexts, words and counts in training, and the order by bucket, context and key."""

    def __init__(self, table: pa.Table, buckets: int, hot: np.ndarray, keep: bool = False):
        """keep: `parts`, each piece of the table with the text and the pair of each token."""
        u, w, c, held, parts, sent = [], [], [], [], [], 0
        for batch in table.combine_chunks().to_batches():
            for part in X.pieces(batch):
                token, before, row = _tokens(part.column("text"))
                train = ~np.array(part.column("held_out").to_pylist(), bool)[row]
                key, first, inverse = np.unique(self.key(before, token), return_index=True, return_inverse=True)
                u.append(before[first])
                w.append(token[first])
                c.append(np.bincount(inverse, train, len(key)))
                held.append(key)
                if keep:
                    parts.append((part.select(["doc_id", "held_out"]), row, (inverse + sent).astype(np.int32)))
                    sent += len(key)
        self.keys, first, inverse = np.unique(np.concatenate(held), return_index=True, return_inverse=True)
        self.u, self.w = (np.concatenate(x)[first] for x in (u, w))
        self.c = np.bincount(inverse, np.concatenate(c), len(self.keys)).astype(np.int64)
        self.parts = [(part, row, inverse[at].astype(np.int32)) for part, row, at in parts]
        bucket = (np.where(np.isin(self.u, hot), self.keys, X.mix(self.u)) % np.uint64(buckets)).astype(np.int64)
        self.order = np.lexsort((self.u, bucket))
        bucket = bucket[self.order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        self.runs = [(int(bucket[a]), self.order[a:z]) for a, z in zip(cut, [*cut[1:], len(bucket)], strict=True)]

    @staticmethod
    def key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
        return X.mix(X.mix(u) + w)


def send_pairs(buckets: int, hot: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """From a block: its pairs and their counts, to the buckets that hold them."""

    def run(table: pa.Table) -> pa.Table:
        mail, block, pairs = Mail(), table["block"][0].as_py(), Pairs(table, buckets, hot)
        for bucket, at in pairs.runs:
            u, k = X.runs(pairs.u[at])
            mail.send(bucket, block, "pairs", u, k, pairs.w[at], pairs.c[at])
        return mail.table()

    return run


# parts: words


def learn_words(table: pa.Table) -> pa.Table:
    """A part's words from all blocks: what they are, their most frequent, codes and bytes of their spelling, and the places of what each block asked for."""
    mail = Mail(table)
    sent = [(block, *map(unpack, data)) for block, data in mail.of("words")]
    h, first, inverse = np.unique(np.concatenate([s[1] for s in sent]), return_index=True, return_inverse=True)
    c = np.bincount(inverse, np.concatenate([s[2] for s in sent]), len(h)).astype(np.int64)
    word = pa.concat_arrays([_binary(s[3], s[4]) for s in sent]).take(pa.array(first))
    at = 0
    for s in sent:
        mail.send(mail.own, s[0], "asked", _steps(inverse[at : at + len(s[1])]))
        at += len(s[1])
    buf, offsets = X.bytes_of(word)
    real = h != END
    mail.send(mail.own, 0, "word", h, c, np.diff(offsets), buf, stats=(c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum()))
    top = np.argsort(-c, kind="stable")[:MOST_HOT]
    mail.send(mail.own, 0, "top", h[top], c[top])
    seen = word.filter(pa.array((c > 0) & real))
    buf, offsets = X.bytes_of(_ended(seen))
    mail.send(mail.own, 0, "codes", *X.runs(codes(buf, offsets)))
    mail.send(mail.own, 0, "bytes", *X.runs(buf))
    return mail.table()


def link(table: pa.Table) -> pa.Table:
    """A part's places of the words and contexts of each bucket, and the tables that never change: those of pairs seen once."""
    mail = Mail(table)
    h, c, *_ = mail.one("word")
    fixed = np.zeros(len(h), np.int64)
    contexts = {bucket: np.searchsorted(h, unpack(data[0])) for bucket, data in mail.of("contexts")}
    for bucket, data in mail.of("dishes"):
        own, once, again = map(unpack, data)
        at = np.searchsorted(h, own)
        fixed[at] += once
        mail.send(mail.own, bucket, "links", _steps(at[again > 0]), _steps(contexts.pop(bucket, np.zeros(0, np.int64))))
        mail.send(mail.own, bucket, "tables", again[again > 0])
    for bucket, at in contexts.items():
        mail.send(mail.own, bucket, "links", np.zeros(0, np.int64), _steps(at))
    mail.send(mail.own, 0, "fixed", fixed)
    mail.send(mail.own, 0, "seats", (c > 0).astype(np.int64))
    return mail.table()


def reseat_words(spelling: Broadcast, d: float, served: float, sweep: int, keep: bool) -> Callable[[pa.Table], pa.Table]:
    """A part's sweep: its words' tables given their spelling, told to the buckets."""

    def run(table: pa.Table) -> pa.Table:
        mail = Mail(table)
        h, _, size, buf = mail.one("word")
        c, seats = mail.one("fixed")[0].astype(np.int64), mail.one("seats")[0].astype(np.float64)
        places = {bucket: _places(data[0]) for bucket, data in mail.of("links")}
        for bucket, data in mail.of("tables"):
            np.add.at(c, places[bucket], unpack(data[0]).astype(np.int64))
        words = _binary(size, buf)
        base = np.where(h == END, np.log(END_BASE), spelling.value.log_words(words) + np.log1p(-END_BASE))
        t = draw(c, served - seats, np.exp(base), d, _uniform(h, sweep))
        own = (c - d * t).astype("<f4")
        mail.send(mail.own, 0, "seats", t.astype(np.int64), stats=(t.sum(), c.sum()))
        for bucket, at in places.items():
            mail.send(bucket, mail.own, "reply", own[at], np.exp(base[at]).astype("<f4"))
        if keep:
            mail.send(mail.own, sweep, "sample", own, base.astype("<f4"))
        real = np.flatnonzero((t > 0) & (h != END))
        buf, offsets = X.bytes_of(_ended(words.take(pa.array(real))))
        code = codes(buf, offsets)
        distinct, inverse = np.unique(code, return_inverse=True)
        mail.send(mail.own, 0, "codes", distinct, np.bincount(inverse, np.repeat(t[real], np.diff(offsets)), len(distinct)).astype(np.int64))
        return mail.table()

    return run


def answer_words(d: float, totals: dict[int, tuple[float, float]]) -> Callable[[pa.Table], pa.Table]:
    """From a part to each block: count, and by sample the log probability and what the word's own restaurant leaves to its parent."""

    def run(table: pa.Table) -> pa.Table:
        mail = Mail(table)
        h, c, *_ = mail.one("word")
        places = {bucket: _places(data[1]) for bucket, data in mail.of("links")}
        inside = {s: np.zeros(len(h)) for s in totals}
        for s in totals:
            for bucket, data in mail.of(f"inside{s}"):
                np.add.at(inside[s], places[bucket], unpack(data[0]))
        told = []
        for s, data in mail.of("sample"):
            own, base = map(unpack, data)
            served, guests = totals[s]
            with np.errstate(divide="ignore"):
                p = np.logaddexp(np.log(own), base + np.log(STRENGTH + d * served)) - np.log(STRENGTH + guests)
            told += [p.astype("<f4"), np.log((STRENGTH + CONTEXT_DISCOUNT * inside[s]) / (c + STRENGTH)).astype("<f4")]
        for block, data in mail.of("asked"):
            at = _places(data[0])
            mail.send(block, mail.own, "of_words", c[at], *(x[at] for x in told))
        return mail.table()

    return run


# buckets: pairs


def learn_pairs(parts: int, hot: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    """A bucket's pairs from all blocks; what its contexts and words are, to the parts."""

    def run(table: pa.Table) -> pa.Table:
        mail = Mail(table)
        sent = [(block, *map(unpack, data)) for block, data in mail.of("pairs")]
        u, w = np.concatenate([np.repeat(s[1], s[2]) for s in sent]), np.concatenate([s[3] for s in sent])
        keys, first, inverse = np.unique(Pairs.key(u, w), return_index=True, return_inverse=True)
        c = np.bincount(inverse, np.concatenate([s[4] for s in sent]), len(keys)).astype(np.int64)
        u, w = u[first], w[first]
        order = np.argsort(u, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        u, w, c, keys, inverse = u[order], w[order], c[order], keys[order], place[inverse]
        at = 0
        for s in sent:
            mail.send(mail.own, s[0], "asked", _steps(inverse[at : at + len(s[3])]))
            at += len(s[3])
        once, more = c == 1, np.flatnonzero(c > 1)
        contexts, of_u = np.unique(u[c > 0], return_inverse=True)
        inside = np.zeros(len(u), np.int64)
        inside[c > 0] = of_u
        words, of_w = np.unique(w[c > 0], return_inverse=True)
        dish = np.zeros(len(w), np.int64)
        dish[c > 0] = of_w
        again = np.bincount(dish[more], minlength=len(words))
        number = np.cumsum(again > 0) - 1
        mail.send(mail.own, 0, "pair", c, _steps(more), keys[more], inside[more], number[dish[more]])
        mail.send(mail.own, 0, "names", contexts, np.bincount(inside[once], minlength=len(contexts)), words[again > 0])
        mail.send(mail.own, 0, "seats", np.ones(len(more), np.uint8), np.zeros(len(more), np.uint8))
        seen = np.bincount(of_w[once[c > 0]], minlength=len(words))
        for part, at in split(_part_of(words, parts)):
            mail.send(part, mail.own, "dishes", words[at], seen[at], again[at])
        for part, at in split(_part_of(contexts, parts)):
            mail.send(part, mail.own, "contexts", contexts[at])
        some = np.flatnonzero(np.isin(contexts, hot))
        mail.send(mail.own, 0, "hot", np.searchsorted(hot, contexts[some]), np.bincount(of_u, minlength=len(contexts))[some])
        return mail.table()

    return run


def reseat_pairs(parts: int, hot: np.ndarray, tables: np.ndarray, d: float, served: float, guests: float, sweep: int, keep: bool) -> Callable[[pa.Table], pa.Table]:
    """A bucket's sweep: its contexts' tables given their words' probabilities; the sums by word go to the parts."""

    def run(table: pa.Table) -> pa.Table:
        mail = Mail(table)
        c, steps, keys, inside, dish = mail.one("pair")
        contexts, once, words = mail.one("names")
        before, total = (x.astype(np.int64) for x in mail.one("seats"))
        more = np.cumsum(steps, dtype=np.int64)
        p, of_part = np.zeros(len(words)), list(split(_part_of(words, parts)))
        told = {part: [unpack(b) for b in data] for part, data in mail.of("reply")}
        for part, at in of_part:
            own, base = told[part]
            p[at] = (own + (STRENGTH + d * served) * base.astype(np.float64)) / (STRENGTH + guests)
        now = once + np.bincount(inside, before, len(contexts))
        some = np.flatnonzero(np.isin(contexts, hot))
        now[some] = tables[np.searchsorted(hot, contexts[some])]
        t = draw(c[more].astype(np.int64), now[inside] - before, p[dish], CONTEXT_DISCOUNT, _uniform(keys, sweep)).astype(np.int64)
        mail.send(mail.own, 0, "seats", t, total + t if keep else total)
        sums = np.bincount(dish, t, len(words)).astype(np.int64)
        for part, at in of_part:
            mail.send(part, mail.own, "tables", sums[at])
        now = (once + np.bincount(inside, t, len(contexts))).astype(np.int64)
        mail.send(mail.own, 0, "hot", np.searchsorted(hot, contexts[some]), now[some])
        if keep:
            for part, at in split(_part_of(contexts, parts)):
                mail.send(part, mail.own, "inside", now[at])
        return mail.table()

    return run


def answer_pairs(table: pa.Table) -> pa.Table:
    """From a bucket to each block: customers less discounts of its pairs, the samples' mean."""
    mail = Mail(table)
    c, steps, *_ = mail.one("pair")
    seen = c - CONTEXT_DISCOUNT * (c > 0)
    more = np.cumsum(steps, dtype=np.int64)
    seen[more] = c[more] - CONTEXT_DISCOUNT / SAMPLES * mail.one("seats")[1]
    seen = seen.astype("<f4")
    for block, data in mail.of("asked"):
        mail.send(block, mail.own, "of_pairs", seen[_places(data[0])])
    return mail.table()


# scores

SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(known: int, vocab: int, parts: int, buckets: int, hot: np.ndarray) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = [x.split(" ")[0] for x in SCORED.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = {(r["kind"], r["sender"]): r["data"] for r in right.to_pylist()}
        pairs = Pairs(left, buckets, hot, keep=True)
        h = np.unique(np.append(pairs.w, END))  # every word follows another or the end
        c, p, back = np.zeros(len(h)), np.zeros((SAMPLES, len(h))), np.zeros((SAMPLES, len(h)))
        for part, at in split(_part_of(h, parts)):
            data = [unpack(b) for b in told["of_words", part]]
            c[at] = data[0]
            p[:, at], back[:, at] = data[1::2], data[2::2]
        seen = np.zeros(len(pairs.keys))
        for bucket, at in pairs.runs:
            seen[at] = unpack(told["of_pairs", bucket][0])
        del told
        of_u, of_w = np.searchsorted(h, pairs.u), np.searchsorted(h, pairs.w)
        parent = np.full(len(seen), -np.inf)
        for s in range(SAMPLES):
            parent = np.logaddexp(parent, back[s][of_u] + p[s][of_w])
        with np.errstate(divide="ignore"):
            logp = np.logaddexp(np.log(seen / (c[of_u] + STRENGTH)), parent - math.log(SAMPLES)) / math.log(10)
        base = np.log10((c + 0.1) / (known + 0.1 * (vocab + 1)))
        known_token, base = (c[of_w] > 0).astype(np.float64), base[of_w]
        out = []
        for part, row, pair in pairs.parts:
            sums = [np.bincount(row, x[pair], part.num_rows) for x in (known_token, base, logp)]
            n = np.bincount(row, minlength=part.num_rows)
            out.append(pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(n, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(n), known, np.int64)), pa.array(sums[1]), pa.array(sums[2])], names))
        X.give_back()
        return pa.Table.from_batches(out)

    return run


def score(docs: DataFrame, held_out: Column, block_bytes: int = BLOCK_BYTES, bucket_tokens: int = BUCKET_TOKENS, groups: int | None = None) -> DataFrame:
    """A row for each row of docs: tokens, known ones, the add-0.1 unigram score and the model's log10 probability of the whole text.

    The model learns from rows that held_out does not mark.  A null or empty
    text is its end alone.  With nothing to learn from, words have the
    probability of uniform spelling.  doc_id may be null or repeat; columns but
    doc_id and text are not read; an empty table gives no rows.  block_bytes,
    bucket_tokens and groups (the least number of groups of each kind; by
    default that of shuffle partitions, as far as there is text for it) set
    sizes of tasks and change no score.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = groups or max(1, min(partitions(spark), -(-size // LEAST_BYTES)))
    blocks, parts = max(groups, -(-size // block_bytes)), max(groups, -(-size // (8 * block_bytes)))
    # a block is a run of rows by their place in the input, mixed, so that equal rows spread
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    files = min(blocks, MOST_FILES)
    texts = clustered(rows.withColumn("block", block), "block", files, "texts")
    words = _stored(_grouped(parts, learn_words, texts.groupBy("block").applyInArrow(send_words(parts), MESSAGE)), "words")
    known, vocab, n1, n2 = _added(words, "word", 4)
    d, buckets = _discount(n1, n2), max(groups, -(-int(known) // bucket_tokens))
    hot_words, c = _sums(_kind(words, "top"), "top")
    hot = np.sort(hot_words[c * MOST_HOT > max(1, known)].view(np.uint64))
    spelling = Spelling(_sums(words, "codes")[0], _by_byte(words))
    pairs = _stored(_grouped(buckets, learn_pairs(parts, hot), texts.groupBy("block").applyInArrow(send_pairs(buckets, hot), MESSAGE)), "pairs")
    links = _stored(_grouped(parts, link, _kind(words, "word"), _kind(pairs, "dishes", "contexts")), "links", release=False)
    seats, tables, told, seated = _kind(links, "seats"), _kind(links, "tables"), words, pairs
    served, totals, samples = vocab, {}, []
    for sweep in range(BURN_IN + SAMPLES):
        keep = sweep >= BURN_IN
        shared = spark.sparkContext.broadcast(spelling.sweep(_sums(told, "codes")[1]))
        run = reseat_words(shared, d, served, sweep, keep)
        told = _stored(_grouped(parts, run, _kind(words, "word"), _kind(links, "links", "fixed"), seats, tables), "restaurant", release=False)
        served, guests = _added(told, "seats", 2)
        inside = np.zeros(len(hot), np.int64)
        at, n = _sums(seated, "hot")
        inside[at] = n
        run = reseat_pairs(parts, hot, inside, d, served, guests, sweep, keep)
        seated = _stored(_grouped(buckets, run, _kind(pairs, "pair", "names"), _kind(seated, "seats"), _kind(told, "reply")), "contexts")
        seats, tables = _kind(told, "seats"), _kind(seated, "tables")
        if keep:
            totals[sweep] = (served, guests)
            samples += [_kind(told, "sample"), _kind(seated, "inside").withColumn("kind", F.lit(f"inside{sweep}"))]
    of_words = _grouped(parts, answer_words(d, totals), _kind(words, "word", "asked"), _kind(links, "links"), *samples)
    of_pairs = _grouped(buckets, answer_pairs, _kind(pairs, "pair", "asked"), _kind(seated, "seats"))
    answers = of_words.unionByName(of_pairs).select(F.col("at").alias("block"), "sender", "kind", "data").repartition(files, "block")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scorer(int(known), int(vocab), parts, buckets, hot), SCORED)


def _by_byte(words: DataFrame) -> np.ndarray:
    out = np.zeros(256)
    at, n = _sums(words, "bytes")
    out[at] = n
    return out
