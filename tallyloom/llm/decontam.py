"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are words without case.  A document leaks an item of n words
when some stretch of it lies within an edit distance, in words, of
allowed(n) = n * percent // 100.

1. A window of n words that starts where such a stretch starts shares at least
   n - allowed(n) words with the item, each counted as often as the item has it.
   Only windows that share so many with items of n words are looked at; the
   condition is necessary, so it loses nothing.
2. The CGK embedding walks over a window, writing the word under it at each
   step and stepping on by a random bit of (step, word), the same for windows
   and items.  Few edits leave few steps that differ, so `bits` sampled steps
   agree often.  For each size of item, walks are repeated until copies of its
   items, changed by the most edits allowed, are met at the target recall, the
   hardest of them too; a size for which MOST_WALKS do not do verifies every
   window that step 1 leaves.
3. Where all sampled steps of a repetition agree, the edit distance decides.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import textops as X
from tallyloom.llm.store import without

#: Words of items that one pass holds; more items take more passes.
ITEM_WORDS = 1_000_000
PIECE_BYTES = 4 << 20
#: Walks that a size of item may take, and window words that are held at once.
MOST_WALKS, HELD_WORDS = 256, 1 << 15


def allowed(n: int, percent: int) -> int:
    return n * percent // 100


def best_stretch(item: list[int], text: list[int]) -> tuple[int, int]:
    """(distance, end) of the stretch of text nearest to item; the earliest end of equal ones.

    Bit-parallel dynamic programming: one integer holds a column's differences.
    """
    n = len(item)
    at: dict[int, int] = {}
    for i, x in enumerate(item):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, (n, 0)
    for j, x in enumerate(text, 1):
        eq = at.get(x, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(d0 | up), up & d0
        score += 1 if right & top else -1 if left & top else 0
        right, left = (right << 1) & full, (left << 1) & full
        up, down = (left | ~(d0 | right)) & full, right & d0 & full
        if score < best[0]:
            best = (score, j)
    return best


class Index:
    """Items ready to be met: their words, walks and sampled keys."""

    def __init__(self, items: list[tuple[int, str]], percent: int, bits: int, target: float, seed: int = 7):
        w = X.words(pa.array([t for _, t in items], pa.string()), X.ALNUM, lower=True)
        self.vocabulary = np.unique(w.hash)
        ids = np.searchsorted(self.vocabulary, w.hash) + 1  # 0: any other word; V + 1: past the end
        self.pad = len(self.vocabulary) + 1
        self.percent, self.bits = percent, bits
        self.by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, (item, _) in enumerate(items):
            if (own := ids[w.of(i)]).size:
                self.by_size.setdefault(len(own), []).append((item, own))
        self.most = {n: _most(some) for n, some in self.by_size.items()}
        rng = np.random.default_rng(seed)
        self.seed = np.uint64(seed)
        self.sample = {n: np.sort(rng.integers(0, 2 * n, (MOST_WALKS, bits)), 1) for n in self.by_size}
        self.walks = {n: self._walks(rng, n, some, target) for n, some in self.by_size.items()}
        self.lookup: dict[tuple[int, int], dict[int, list[np.ndarray]]] = {}
        self.keys: dict[tuple[int, int], np.ndarray] = {}
        for n, some in self.by_size.items():
            for own, keys in self._each(np.array([x for _, x in some]), np.full(len(some), n)):
                for r in range(self.walks[n]):
                    for x, key in zip(own.tolist(), keys[r].tolist(), strict=True):
                        self.lookup.setdefault((n, r), {}).setdefault(key, []).append(some[x][1])
            for r in range(self.walks[n]):
                self.keys[n, r] = np.sort(np.array(list(self.lookup[n, r]), np.uint64))
        self.item_of: dict[bytes, list[int]] = {}
        for some in self.by_size.values():
            for i, x in some:
                self.item_of.setdefault(x.tobytes(), []).append(i)

    def _each(self, windows: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, keys) of windows by portions."""
        lanes = max(1, HELD_WORDS // windows.shape[1])
        for lo in range(0, len(windows), lanes):
            own = np.arange(lo, min(lo + lanes, len(windows)))
            yield own, self._keys(windows[own], n[own], max(self.walks[x] for x in np.unique(n[own]).tolist()))

    def _keys(self, windows: np.ndarray, n: np.ndarray, walks: int) -> np.ndarray:
        """[repetition, window]: the sampled steps' words, hashed.  windows: ids, padded; n: each one's size.

        Whether a walk steps on is a bit of the hash of (repetition, step, word).
        """
        lanes, steps = len(windows), int(2 * n.max())
        at, lane = np.zeros((walks, lanes), np.int64), np.arange(lanes)
        inside = np.concatenate([windows, np.full((lanes, 1), self.pad)], 1).astype(np.uint64)
        salt = X.mix(np.arange(steps, dtype=np.uint64)[:, None] | np.arange(walks, dtype=np.uint64) << np.uint64(32) | self.seed << np.uint64(48))
        wrote = np.empty((steps, walks, lanes), np.uint32)
        for j in range(steps):
            word = inside[lane, np.minimum(at, n)]
            wrote[j] = word
            at += (((word * np.uint64(0x9E3779B97F4A7C15)) ^ salt[j][:, None]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)).astype(np.int64)
        out, rep = np.empty((walks, lanes), np.uint64), np.arange(walks)[:, None]
        for size in np.unique(n).tolist():
            own = np.flatnonzero(n == size)
            h = np.zeros((walks, len(own)), np.uint64)
            for b in range(self.bits):
                h = X.mix(h + wrote[self.sample[size][:walks, b][:, None], rep, own].astype(np.uint64) + np.uint64(1))
            out[:, own] = h
        return out

    def _walks(self, rng: np.random.Generator, n: int, some: list[tuple[int, np.ndarray]], target: float) -> int:
        """So many walks that copies of these items with the most edits allowed are met at the target recall; 0: more than MOST_WALKS.

        Up to 16 items are tried, drawn from all of the size, with copies in which
        words are replaced, inserted, deleted or any of these; for each kind the
        walks of the lower quarter must suffice.
        """
        k = allowed(n, self.percent)
        if not k:
            return 1
        kinds = np.repeat([0, 1, 2, 3], 3)  # replaced, inserted, deleted, any of these
        met = []
        for i in rng.choice(len(some), min(16, len(some)), replace=False):
            own, copies = some[i][1], []
            for kind in kinds:
                x = own.tolist()
                for _ in range(k):
                    do, at = rng.integers(3) if kind == 3 else kind, int(rng.integers(len(x)))
                    x[at : at + int(do != 1)] = [0] * int(do != 2)
                copies.append((x + [0] * n)[:n])
            h = self._keys(np.array([own, *copies]), np.full(len(copies) + 1, n), MOST_WALKS)
            met.append(h[:, 1:] == h[:, :1])
        need = 4
        for kind in range(4):
            own = np.concatenate([m[:, kinds == kind] for m in met], 1)  # [walk, copy]
            rate = max(1e-9, float(np.quantile(own.mean(0), 0.25)))
            first = np.where(own.any(0), own.argmax(0), MOST_WALKS)
            need = max(need, math.ceil(math.log(1 - target) / math.log(1 - min(0.999, rate))), int(np.quantile(first, target)) + 1)
        return need if need <= MOST_WALKS else 0

    def scan(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, words, distance): the nearest stretch for each row and item leaked."""
        w = X.words(texts, X.ALNUM, lower=True)
        at = np.minimum(np.searchsorted(self.vocabulary, w.hash), len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[at] == w.hash, at + 1, 0).astype(np.int32)
        ends = w.first[1:][w.row]
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        starts, sizes = [], []
        for n in sorted(self.by_size):
            least, member = n - allowed(n, self.percent), np.zeros(self.pad + 1, bool)
            member[self.most[n][0]] = True
            seen = np.concatenate([[0], np.cumsum(member[ids], dtype=np.int32)])
            if seen[-1] < least:
                continue
            stop = np.minimum(np.arange(len(ids)) + n, ends)
            s = self._shared(ids, ends, np.flatnonzero(seen[stop] - seen[:-1] >= least), n, least)
            if self.walks[n]:
                starts.append(s)
                sizes.append(np.full(len(s), n))
                continue
            distinct = {own.tobytes(): (own, Counter(own.tolist())) for _, own in self.by_size[n]}
            for x in s.tolist():
                window = Counter(ids[x : min(x + n, int(ends[x]))].tolist())
                for own, count in distinct.values():
                    if (window & count).total() >= least:
                        self._verify(w, ids, x, own, found)
        starts, sizes = np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.int64), *sizes])
        at = 0
        while at < len(starts):  # of like size side by side, so many that their words stay within bounds
            wide = np.maximum.accumulate(sizes[at : at + HELD_WORDS])
            to = at + max(1, int(np.searchsorted(wide * np.arange(1, len(wide) + 1), HELD_WORDS, "right")))
            s, n = starts[at:to], sizes[at:to]
            place = s[:, None] + np.arange(n[-1])
            windows = np.where((np.arange(n[-1]) < n[:, None]) & (place < ends[s][:, None]), ids[np.minimum(place, len(ids) - 1)], self.pad)
            for own, keys in self._each(windows, n):
                for size in np.unique(n[own]).tolist():
                    some = np.flatnonzero(n[own] == size)
                    for r in range(self.walks[size]):
                        known = self.keys[size, r]
                        p = np.minimum(np.searchsorted(known, keys[r, some]), len(known) - 1)
                        for x in some[known[p] == keys[r, some]].tolist():
                            for item in self.lookup[size, r][int(keys[r, x])]:
                                self._verify(w, ids, int(s[own[x]]), item, found)
            at = to
        return [(row, item, first, words, distance) for (row, item), (distance, first, words) in sorted(found.items())]

    def _shared(self, ids: np.ndarray, ends: np.ndarray, s: np.ndarray, n: int, least: int) -> np.ndarray:
        """Those starts whose windows hold `least` words of items of n words, each as often as in one item at most."""
        kept = []
        lanes = max(1, HELD_WORDS // n)
        for lo in range(0, len(s), lanes):
            own = s[lo : lo + lanes]
            place = own[:, None] + np.arange(n)
            x = np.sort(np.where(place < ends[own][:, None], ids[np.minimum(place, len(ids) - 1)], 0), 1)
            new = np.ones(x.shape, bool)
            new[:, 1:] = x[:, 1:] != x[:, :-1]
            nth = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0), 1)
            kept.append(own[(nth < _looked_up(self.most[n], x)).sum(1) >= least])
        return np.concatenate(kept) if kept else s

    def _verify(self, w: X.Words, ids: np.ndarray, start: int, item: np.ndarray, found: dict) -> None:
        row, n = int(w.row[start]), len(item)
        names, k = self.item_of[item.tobytes()], allowed(n, self.percent)
        seen = found.get((row, names[0]))
        base = int(w.first[row])
        if seen and (seen[0] == 0 or abs(seen[1] + base - start) <= k):
            return
        lo, hi = max(base, start - k), min(int(w.first[row + 1]), start + n + k)
        text = ids[lo:hi].tolist()
        distance, end = best_stretch(item.tolist(), text)
        if distance > k:
            return
        back, length = best_stretch(item[::-1].tolist(), text[:end][::-1])
        first = lo + end - (length if back == distance else min(n, end))
        if not seen or distance < seen[0]:
            for name in names:
                found[row, name] = (distance, first - base, lo + end - first)


def _most(items: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of items of one size, sorted, and how often one item has each at most."""
    runs = [X.runs(x) for _, x in items]
    word, n = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
    order = np.lexsort((-n, word))
    word, n = word[order], n[order]
    first = np.concatenate([[True], word[1:] != word[:-1]])
    return word[first], n[first]


def _looked_up(most: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(most[0], x), len(most[0]) - 1)
    return np.where(most[0][at] == x, most[1][at], 0)


LEAK = "doc_id long, item_id long, first_word long, n_words long, distance long"


def leaks(docs: DataFrame, items: DataFrame, percent: int = 20, bits: int = 2, target: float = 0.99, item_words: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance): the nearest stretch for each row of docs and each item it leaks.

    items: item_id and text.  Items without an id are items like any other, and
    are reported by a null one.  Items without words are leaked by nothing; items
    of under 100 / percent words only by their exact words.  Items over
    item_words words in all are taken in several passes, so what is shipped to
    the tasks stays bounded.  Null and empty texts leak nothing; doc_id may be
    null or repeat, each row being judged by its own text; other columns are not
    read; empty tables give no rows.
    """
    out = None
    for index in _indexes(items, percent, bits, target, item_words):
        found = _pass(docs, index)
        out = found if out is None else out.unionByName(found)
    return out


def _indexes(items: DataFrame, percent: int, bits: int, target: float, item_words: int) -> Iterator[Index]:
    """An index for each pass."""
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    total = items.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0]
    passes = max(1, -(-total // item_words))
    for k in range(passes):
        some = items.where(F.pmod(F.xxhash64(F.coalesce(F.col("item_id").cast("long"), F.xxhash64("text"))), F.lit(passes)) == k).select(F.col("item_id").cast("long"), "text")
        rows = sorted({(r.item_id, r.text or "") for r in some.toLocalIterator()}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield Index(rows, percent, bits, target)


def clean(docs: DataFrame, items: DataFrame, percent: int = 20, bits: int = 2, target: float = 0.99, item_words: int = ITEM_WORDS) -> DataFrame:
    """The rows of docs that leak no item, all columns as they are; each row is judged by its own text, whatever its doc_id.

    Rows are known by a 64-bit hash of their text, so equal texts share a fate.
    """
    known = next(c for c in (f"text_hash_{i}" for i in itertools.count()) if c not in docs.columns)
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    return without(docs.withColumn(known, F.xxhash64("text")), leaks(texts, items, percent, bits, target, item_words).select(F.col("doc_id").alias(known)), known).select(*docs.columns)


def _pass(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @X.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in X.pieces(batch, limit=PIECE_BYTES):
                if not known.by_size:
                    continue
                found = known.scan(part.column("text"))
                rows = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), *(pa.array([f[c] for f in found], pa.int64()) for c in range(1, 5))], [x.split(" ")[0] for x in LEAK.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, LEAK)
