"""Quality rules: counts over each text, and perplexity bands under a Kneser-Ney model.

For each language Spark counts the 4-grams of characters: in how many documents
each occurs.  A document is judged by the others, so one is taken off each
count, and what only one document holds counts as unseen.  From these counts
follow the continuation counts of the shorter orders, modified Kneser-Ney
discounts, and for each seen n-gram its discounted probability, for each context
what is left to the shorter order.  The model is kept as arrays sorted by the
hash of language and n-gram, which are searched; where it has over `most`
n-grams and contexts it stays a table and is joined.

A document's log perplexity is the mean over all its characters.  For each
language the bands lie `width` quartile distances below and above the quartiles
of all documents that pass the counts; short documents, whose means vary more,
get wider ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import textops as X
from tallyloom.llm.store import few, written

ORDER = 4
#: N-grams and contexts that are broadcast (12 bytes each); a larger model is joined.
MOST_SHIPPED = 5_000_000
#: Distinct n-grams that a counting task holds before it sends them on, and slots of a scoring task's memory.
HELD, SLOTS = 3_000_000, 1 << 20

# A character is its 16-bit code: A-Z as a-z, white space as a blank, and characters
# beyond 16 bits by a hash among the 2048 codes that no character has.
_CODE = np.arange(1 << 16, dtype=np.uint64)
_CODE[0x41:0x5B] += np.uint64(0x20)
_CODE[[*range(0x09, 0x0E)]] = 0x20
_KEEP = [np.uint64((1 << (16 * k)) - 1) for k in range(ORDER)] + [np.uint64(0xFFFFFFFFFFFFFFFF)]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def codes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each character, 16 bits for each of its characters, and where each text's begin; before a text stand three blanks."""
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]
    s = np.where(points < 1 << 16, _CODE[np.minimum(points, 0xFFFF)], np.uint64(0xD800) + X.mix(points.astype(np.uint64)) % np.uint64(2048))
    size = np.diff(at)
    padded = np.full(len(s) + 3 * len(size), 0x20, np.uint64)
    place = np.arange(len(s)) + 3 * (np.repeat(np.arange(len(size)), size) + 1)
    padded[place] = s
    return padded[place - 3] << np.uint64(48) | padded[place - 2] << np.uint64(32) | padded[place - 1] << np.uint64(16) | s, at


def _merged(codes: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(inverse, np.concatenate(n), len(code)).astype(np.int64)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n): documents that hold each 4-gram, by a hash of their language; a task sends what it has seen of a language together."""

    @X.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in X.pieces(batch):
                code, at = codes(*X.bytes_of(part.column("text")))
                fresh: dict[int, list[np.ndarray]] = {}
                for i, lang in enumerate(part.column("lang").to_pylist()):
                    if at[i] < at[i + 1]:
                        fresh.setdefault(lang, []).append(X.runs(code[at[i] : at[i + 1]])[0])
                for lang, some in fresh.items():
                    old = seen.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                    u, n = X.runs(np.concatenate(some))
                    seen[lang] = _merged([old[0], u], [old[1], n])
                if sum(len(c) for c, _ in seen.values()) > HELD:
                    yield from _sent(seen)
                    seen.clear()
        yield from _sent(seen)

    return docs.select(F.xxhash64("lang").alias("lang"), "text").mapInArrow(run, "lang long, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _sent(seen: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for lang, (code, n) in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), lang, np.int64)), pa.array(code.view(np.int64)), pa.array(n)], ["lang", "code", "n"])


def _discounts() -> list[Column]:
    """D1, D2 and D3 of modified Kneser-Ney from the counts of counts n1 to n4; where those are empty, 0.5."""
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    of = lambda k: F.when(F.col(f"n{k}") > 0, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(0.5)
    return [F.greatest(F.lit(0.0), F.least(F.lit(k * 0.95), of(k))).alias(f"d{k}") for k in (1, 2, 3)]


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, k, kind, key, value): by order k, each seen n-gram's discounted probability (kind 0) and what each context leaves to the shorter order (1)."""
    grams = counts.where("n > 1").select("lang", F.col("code").alias("gram"), (F.col("n") - 1).alias("c"), F.lit(ORDER).alias("k"))
    rows = grams
    for k in range(ORDER - 1, 0, -1):
        short = F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1))
        grams = grams.groupBy("lang", short.alias("gram")).agg(F.count("*").alias("c")).select("lang", "gram", "c", F.lit(k).alias("k"))
        rows = rows.unionByName(grams)
    rows = written(rows, "grams")
    d = written(rows.groupBy("lang", "k").agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4))).select("lang", "k", *_discounts()), "discounts")
    d = F.broadcast(d) if few(d, 10_000) else d
    rows = rows.join(d, ["lang", "k"]).withColumns({"d": F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")), "context": F.shiftrightunsigned("gram", 16)})
    contexts = rows.groupBy("lang", "k", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
    own = rows.join(contexts, ["lang", "k", "context"]).select("lang", "k", F.lit(0).alias("kind"), F.col("gram").alias("key"), ((F.col("c") - F.col("d")) / F.col("total")).alias("value"))
    return written(own.unionByName(contexts.select("lang", "k", F.lit(1).alias("kind"), F.col("context").alias("key"), (F.col("left") / F.col("total")).alias("value"))).withColumn("value", F.col("value").cast("float")), "model")


class KneserNey:
    """The model as arrays sorted by hash, one pair of arrays for each order's n-grams and one for its contexts."""

    def __init__(self, lang: np.ndarray, k: np.ndarray, kind: np.ndarray, key: np.ndarray, value: np.ndarray):
        self.arrays = {}
        h = self._hash(lang, key.view(np.uint64))
        for order in range(1, ORDER + 1):
            for which in (0, 1):
                some = np.flatnonzero((k == order) & (kind == which))
                some = some[np.argsort(h[some])]
                self.arrays[order, which] = (h[some], value[some].astype(np.float32))

    @staticmethod
    def _hash(lang: np.ndarray, key: np.ndarray) -> np.ndarray:
        return X.mix(X.mix(lang.view(np.uint64)) + key)

    def _find(self, order: int, which: int, lang: np.ndarray, key: np.ndarray, default: float) -> np.ndarray:
        h, values = self.arrays[order, which]
        if not len(h):
            return np.full(len(key), default)
        want = self._hash(lang, key)
        at = np.minimum(np.searchsorted(h, want), len(h) - 1)
        return np.where(h[at] == want, values[at].astype(np.float64), default)

    def log_probability(self, lang: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each 4-gram's last character after its first three."""
        p = np.full(len(code), 2.0**-16)
        for k in range(1, ORDER + 1):
            own = code & _KEEP[k]
            p = self._find(k, 0, lang, own, 0.0) + self._find(k, 1, lang, own >> np.uint64(16), 1.0) * p
        return np.log(np.maximum(p, 1e-300))


class Remembered:
    """A task's memory of log probabilities: a slot for each hash, taken by the last n-gram that asked."""

    def __init__(self, model: KneserNey):
        self.model, self.key, self.value = model, np.zeros(SLOTS, np.uint64), np.zeros(SLOTS)

    def __call__(self, lang: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = KneserNey._hash(lang, code)
        slot = (h >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        out, hit = self.value[slot], self.key[slot] == h
        if len(miss := np.flatnonzero(~hit)):
            _, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            asked = miss[first]
            p = self.model.log_probability(lang[asked], code[asked])
            out[miss] = p[inverse]
            self.key[slot[asked]], self.value[slot[asked]] = h[asked], p
        return out


def _log_probabilities(asked: DataFrame, model: DataFrame) -> DataFrame:
    """asked (lang, code) with log_p, by joins with the model's table."""
    asked = asked.withColumn("p", F.lit(2.0**-16))
    for k in range(1, ORDER + 1):
        own = F.col("code").bitwiseAND(F.lit((1 << (16 * k)) - 1)) if k < ORDER else F.col("code")
        for kind, key, name in ((0, own, "own"), (1, F.shiftrightunsigned(own, 16), "left")):
            found = model.where((F.col("k") == k) & (F.col("kind") == kind)).select("lang", F.col("key").alias("key_"), F.col("value").alias(name))
            asked = asked.withColumn("key_", key).join(found, ["lang", "key_"], "left").drop("key_")
        asked = asked.withColumn("p", F.coalesce("own", F.lit(0.0)) + F.coalesce("left", F.lit(1.0)) * F.col("p")).drop("own", "left")
    return asked.select("lang", "code", F.log(F.greatest("p", F.lit(1e-300))).alias("log_p"))


def base_counts(texts: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    w, lines = X.words(texts), X.words(texts, _LINE)
    rows = len(w.offsets) - 1
    inside = np.concatenate([[0], np.cumsum(X.NOT_SPACE[w.buf])])
    points = np.concatenate([[0], np.cumsum(X.NOT_SPACE[w.buf] & ((w.buf & 0xC0) != 0x80))])
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[w.buf])])
    full = inside[lines.end] > inside[lines.start]
    dup_lines = np.bincount(lines.row[full][_repeats(lines.row[full], lines.hash[full])[0]], minlength=rows)
    k = 8
    repeat = np.zeros(rows, np.int64)
    if len(w.hash) >= k:
        m = len(w.hash) - k + 1
        acc = w.hash[:m].copy()
        for j in range(1, k):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + w.hash[j : m + j]
        whole = np.flatnonzero(w.row[:m] == w.row[k - 1 :])
        twice = whole[_repeats(w.row[whole], X.mix(acc[whole]))[1]]
        edge = np.bincount(twice, minlength=len(w.hash) + 1) - np.bincount(twice + k, minlength=len(w.hash) + 1)
        repeat = np.bincount(w.row[np.cumsum(edge[:-1]) > 0], minlength=rows)
    at = w.offsets
    return [np.diff(w.first), points[at[1:]] - points[at[:-1]], symbol[at[1:]] - symbol[at[:-1]], dup_lines, repeat]


def _repeats(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a value equals an earlier one of its row, and where it equals any other of its row."""
    key = X.mix(h ^ X.mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, either = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    either[order[1:]] |= same
    either[order[:-1]] |= same
    return later, either



COUNTED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_characters long, log_perplexity double"


def judge(docs: DataFrame, width: tuple[float, float] = (3.0, 4.5), short: int = 300, keep: tuple[str, ...] = (), most: int = MOST_SHIPPED) -> DataFrame:
    """docs' doc_id and `keep` columns with the counts, base_failed, log_perplexity, its band (low, high) and kept.

    base_failed: under 20 words, or over 30 % of words in repeated 8-word
    windows.  A null or empty text has no words and fails.  A null lang is a
    language of its own.  doc_id may be null or repeat; columns not named are
    not read; an empty table gives no rows.  most: rows of the model up to which
    it is broadcast; the verdicts do not depend on it.
    """
    model = kneser_ney(ngram_counts(docs))
    carried = list(dict.fromkeys(["doc_id", "lang", *keep]))
    rows = docs.select(*carried, *([] if "text" in carried else [F.col("text").alias("text_")]), F.xxhash64("lang").alias("lang_"))
    if few(model, most):
        table = model.toArrow()
        arrays = KneserNey(*(table[c].to_numpy() for c in ("lang", "k", "kind", "key", "value")))
        del table
        scored = _scored(rows, carried, docs.sparkSession.sparkContext.broadcast(arrays))
        rows = scored if "text" in carried else written(scored, "quality")  # texts are scored twice rather than written once more
    else:
        rows = _joined(rows, carried, model)
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    quarter = rows.where("not base_failed").groupBy("lang").agg(F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000).alias("q"))
    band = written(quarter.select(F.col("lang").alias("lang_"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")), "bands")
    band = F.broadcast(band) if few(band, 10_000) else band
    away = (F.col("q3") - F.col("q1") + 0.01) * F.sqrt(1 + F.lit(short) / F.greatest(F.lit(1), F.col("n_characters")))
    out = rows.join(band, F.col("lang").eqNullSafe(F.col("lang_")), "left").withColumns({"low": F.col("q1") - width[0] * away, "high": F.col("q3") + width[1] * away})
    verdict = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return out.withColumn("kept", verdict).drop("lang_", "q1", "q3")


def _scored(rows: DataFrame, carried: list[str], shared=None) -> DataFrame:
    """rows' carried columns and the counts; shared: the broadcast model.  Without it, log_perplexity is null and lang_, codes and ns (a text's 4-grams and how often each occurs) follow."""
    text = "text" if "text" in carried else "text_"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carried).schema) + ", " + COUNTED
    if shared is None:
        schema += ", lang_ long, codes array<long>, ns array<long>"
    names = [*carried, *(x.split(" ")[0] for x in COUNTED.split(", ")), *([] if shared else ["lang_", "codes", "ns"])]

    @X.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(shared.value) if shared else None
        for batch in batches:
            for part in X.pieces(batch, text, X.PIECE_BYTES // 2):
                texts = part.column(text)
                code, at = codes(*X.bytes_of(texts))
                size, lang = np.diff(at), part.column("lang_").to_numpy()
                cols = [pa.array(c) for c in (*base_counts(texts), size)]
                if known:
                    total = np.concatenate([[0.0], np.cumsum(known(np.repeat(lang, size), code))])
                    cols.append(pa.array(-(total[at[1:]] - total[at[:-1]]) / np.maximum(1, size)))
                else:
                    runs = [X.runs(code[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]
                    cols += [pa.nulls(len(size), pa.float64()), part.column("lang_"), *(pa.array([r[i].astype(np.int64) for r in runs], pa.list_(pa.int64())) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *cols], names)

    return rows.mapInArrow(run, schema)


def _joined(rows: DataFrame, carried: list[str], model: DataFrame) -> DataFrame:
    """What _scored gives, by joins in place of a broadcast."""
    counted = written(_scored(rows, carried).withColumn("row_", F.monotonically_increasing_id()), "counted")
    each = counted.select("row_", F.col("lang_").alias("lang"), F.arrays_zip("codes", "ns").alias("x")).select("row_", "lang", F.explode("x").alias("x")).select("row_", "lang", F.col("x.codes").alias("code"), F.col("x.ns").alias("n"))
    log_p = _log_probabilities(each.select("lang", "code").distinct(), model)
    total = each.join(log_p, ["lang", "code"]).groupBy("row_").agg(F.sum(F.col("n") * F.col("log_p")).alias("total_"))
    out = counted.drop("lang_", "codes", "ns").join(total, "row_", "left")
    return written(out.withColumn("log_perplexity", -F.coalesce("total_", F.lit(0.0)) / F.greatest(F.lit(1), F.col("n_characters"))).drop("row_", "total_"), "quality")
