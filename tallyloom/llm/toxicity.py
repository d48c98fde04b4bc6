"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own vector, if the training sample's vocabulary has it,
beside the mean of vectors of its character trigrams.  The network reads
overlapping windows of WINDOW words, every STRIDE words, over the whole text;
attention pools the states of both directions to one logit.  A document's score
is a logistic curve, fitted on the sample, of its highest window.

Labels are of documents, so training takes from each toxic document one window,
first the one whose words are most typical of toxic documents, then again and
again the one the network rates highest; other documents give random windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import textops as X

WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 8, 8, 8, 8
TRIGRAMS = 1 << 12
#: Words of the training sample with vectors of their own, the most frequent ones; others have their trigrams'.
MOST_WORDS = 20_000
#: Labelled rows of each class that training may take.
SAMPLE = 1500


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def trigrams(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of all words end to end, and how many each word has (one for each byte)."""
    size = end - start
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    edge = np.concatenate([buf, np.zeros(1, np.uint8)]).astype(np.uint64)
    before = np.where(at == np.repeat(start, size), 0, edge[at - 1])
    after = np.where(at + 1 == np.repeat(end, size), 0, edge[at + 1])
    return (X.mix(before << np.uint64(16) | edge[at] << np.uint64(8) | after) % np.uint64(TRIGRAMS)).astype(np.int64), size


def window_starts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word in the text) of every window; a text without words has none."""
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    return text, STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))


class Words:
    """Distinct words of some texts, the windows over them and what the network needs of each."""

    def __init__(self, texts: pa.Array):
        w = X.words(texts, X.ALNUM, lower=True)
        self.hash, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        self.grams, self.sizes = trigrams(w.buf, w.start[first], w.end[first])
        self.first, self.row, self.inverse = w.first, w.row, inverse
        self.text, start = window_starts(np.diff(w.first))
        at = (w.first[self.text] + start)[:, None] + np.arange(WINDOW)
        self.valid = at < w.first[self.text + 1][:, None]
        self.windows = np.where(self.valid, inverse[np.minimum(at, max(0, len(inverse) - 1))] if len(inverse) else 0, len(self.hash))


class Network:
    """Parameters, forward pass and gradients; float32 throughout."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        r = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.vocabulary = vocabulary
        self.p = {"word": r(len(vocabulary) + 1, WORD_DIM, k=0.1), "char": r(TRIGRAMS, CHAR_DIM, k=0.3), "at": r(2 * h, ATTEND), "pick": r(ATTEND, 1), "out": r(2 * h, 1), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": r(d, 3 * h), f"c{side}": np.zeros(3 * h, np.float32), f"u{side}": r(h, 3 * h)}
        self.p["word"][-1] = 0
        self.scale = (1.0, 0.0)

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the word table; the last for words that it lacks."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary))

    def inputs(self, ids: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A row for each word and one of zeros for places past a text's end."""
        out = np.zeros((len(ids) + 1, WORD_DIM + CHAR_DIM), np.float32)
        out[:-1, :WORD_DIM] = self.p["word"][ids]
        if len(ids):
            out[:-1, WORD_DIM:] = np.add.reduceat(self.p["char"][grams], np.cumsum(sizes) - sizes, 0) / sizes[:, None]
        return out

    def _run(self, side: str, gates: np.ndarray, windows: np.ndarray, tape: list | None) -> np.ndarray:
        h, k, u = np.zeros((len(windows), HIDDEN), np.float32), HIDDEN, self.p[f"u{side}"]
        out = np.empty((WINDOW, len(windows), HIDDEN), np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            x, hu = gates[windows[:, t]], h @ u
            zr = sigmoid(x[:, : 2 * k] + hu[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(x[:, 2 * k :] + r * hu[:, 2 * k :])
            if tape is not None:
                tape.append((t, h, z, r, n, hu[:, 2 * k :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def logits(self, x: np.ndarray, windows: np.ndarray, valid: np.ndarray, tape: dict | None = None) -> np.ndarray:
        states = []
        for side in "fb":
            steps = None if tape is None else tape.setdefault(side, [])
            states.append(self._run(side, x @ self.p[f"x{side}"] + self.p[f"c{side}"], windows, steps))
        h = np.concatenate(states, 2)
        a = np.tanh(h @ self.p["at"])
        e = np.where(valid.T, (a @ self.p["pick"])[..., 0], -1e9)
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        pooled = (e[..., None] * h).sum(0)
        if tape is not None:
            tape |= {"h": h, "a": a, "e": e, "pooled": pooled}
        return (pooled @ self.p["out"])[:, 0] + self.p["bias"][0]

    def gradients(self, ids: np.ndarray, grams: np.ndarray, sizes: np.ndarray, windows: np.ndarray, valid: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over the windows."""
        p, tape, k = self.p, {}, HIDDEN
        x = self.inputs(ids, grams, sizes)
        d = ((sigmoid(self.logits(x, windows, valid, tape)) - y) / len(y)).astype(np.float32)[:, None]
        h, a, e = tape["h"], tape["a"], tape["e"]
        g = {"out": tape["pooled"].T @ d, "bias": d.sum(0)}
        pooled = d @ p["out"].T
        de = (h * pooled).sum(2)
        de = e * (de - (e * de).sum(0))
        da = de[..., None] * p["pick"][:, 0] * (1 - a * a)
        g["pick"] = np.einsum("tba,tb->a", a, de)[:, None]
        g["at"] = np.einsum("tbh,tba->ha", h, da)
        dh = e[..., None] * pooled + da @ p["at"].T
        dx = np.zeros_like(x)
        for side, own in (("f", dh[..., :k]), ("b", dh[..., k:])):
            gates, back, du = np.zeros((len(x), 3 * k), np.float32), np.zeros((len(y), k), np.float32), np.zeros_like(p[f"u{side}"])
            for t, before, z, r, n, hn in reversed(tape[side]):
                back = back + own[t]
                dn = back * (1 - z) * (1 - n * n)
                dg = np.concatenate([back * (before - n) * z * (1 - z), dn * hn * r * (1 - r), dn], 1)
                np.add.at(gates, windows[:, t], dg)
                dg[:, 2 * k :] *= r
                du += before.T @ dg
                back = back * z + dg @ p[f"u{side}"].T
            g |= {f"u{side}": du, f"x{side}": x.T @ gates, f"c{side}": gates.sum(0)}
            dx += gates @ p[f"x{side}"].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], ids, dx[:-1, :WORD_DIM])
        np.add.at(g["char"], grams, np.repeat(dx[:-1, WORD_DIM:] / sizes[:, None], sizes, 0))
        g["word"][-1] = 0
        return g

    def highest(self, w: Words) -> np.ndarray:
        """Each text's highest window logit; -inf without words."""
        out = np.full(len(w.first) - 1, -np.inf)
        x = self.inputs(self.word_ids(w.hash), w.grams, w.sizes)
        for lo in range(0, len(w.windows), 8192):
            part = slice(lo, lo + 8192)
            np.maximum.at(out, w.text[part], self.logits(x, w.windows[part], w.valid[part]))
        return out

    def score(self, highest: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale[0] * np.maximum(highest, -30.0) + self.scale[1])


def _subset(w: Words, ids: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, ...]:
    """ids, trigrams, sizes, windows and valid of some windows, with only the words they hold."""
    used, inverse = np.unique(w.windows[some], return_inverse=True)
    real = used[used < len(w.hash)]
    windows = np.where(w.valid[some], inverse.reshape(len(some), WINDOW), len(real))
    ends = np.cumsum(w.sizes)
    at = np.arange(w.sizes[real].sum()) - np.repeat(np.cumsum(w.sizes[real]) - w.sizes[real], w.sizes[real]) + np.repeat((ends - w.sizes)[real], w.sizes[real])
    return ids[real], w.grams[at], w.sizes[real], windows, w.valid[some]


def fit(texts: list[str], toxic: np.ndarray, share: float, epochs: int = 10, batch: int = 128, seed: int = 5) -> Network:
    """A network from documents and their labels; share: of toxic ones among all labelled, to which scores are set."""
    rng, w = np.random.default_rng(seed), Words(pa.array(texts, pa.string()))
    seen = np.unique(np.stack([w.row, w.inverse], 1), axis=0) if len(w.inverse) else np.zeros((0, 2), np.int64)
    of = np.bincount(seen[:, 1], minlength=len(w.hash))
    pos = np.bincount(seen[:, 1], toxic[seen[:, 0]], minlength=len(w.hash))
    common = np.argsort(-of, kind="stable")[:MOST_WORDS]
    net = Network(np.sort(w.hash[common[of[common] >= 3]]))
    if not len(w.windows) or toxic.min() == toxic.max():
        net.scale = (0.0, float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))))
        return net
    n1, n0 = max(1, toxic.sum()), max(1, (1 - toxic).sum())
    typical = np.append(np.log((pos + 0.5) / (n1 + 1)) - np.log((of - pos + 0.5) / (n0 + 1)), -9)
    rate = typical[w.windows].max(1)
    ids, state, step = net.word_ids(w.hash), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}, 0
    for epoch in range(epochs):
        if epoch and epoch % 3 == 0:
            x = net.inputs(ids, w.grams, w.sizes)
            rate = np.concatenate([net.logits(x, w.windows[i : i + 8192], w.valid[i : i + 8192]) for i in range(0, len(w.windows), 8192)])
        order = np.lexsort((-rate, w.text))
        top = order[np.concatenate([[True], w.text[order][1:] != w.text[order][:-1]])]
        chosen = np.concatenate([top[toxic[w.text[top]] == 1], top[toxic[w.text[top]] == 0], rng.permutation(np.flatnonzero(toxic[w.text] == 0))[: 2 * len(top)]])
        chosen = rng.permutation(chosen)
        for lo in range(0, len(chosen), batch):
            some = chosen[lo : lo + batch]
            step += 1
            for k, g in net.gradients(*_subset(w, ids, some), toxic[w.text[some]].astype(np.float32)).items():
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.p[k] -= (0.02 * 0.85**epoch * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    net.scale = _curve(net.highest(w), toxic, share)
    return net


def _curve(highest: np.ndarray, toxic: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve, classes weighted to the given share."""
    x = np.maximum(highest, -30.0)
    weight = np.where(toxic == 1, share / max(1, toxic.sum()), (1 - share) / max(1, (1 - toxic).sum()))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * x + b)
        s = np.maximum(weight * p * (1 - p), 1e-9)
        g = np.array([(weight * (p - toxic) * x).sum() + 1e-4 * a, (weight * (p - toxic)).sum()])
        h = np.array([[(s * x * x).sum() + 1e-4, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -1, 1)
    return float(a), float(b)


def sample(docs: DataFrame, labels: DataFrame, usable: Column, rows: int) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of up to `rows` labelled documents of each class, in the order of a hash, and the toxic share of all."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(usable)
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    each = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    label = {r.doc_id: r.toxic for r in each[0].unionByName(each[1]).toLocalIterator()}
    held = docs.where(F.col("doc_id").isin(list(label))).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    found = sorted((r.doc_id, r.text) for r in held.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).toLocalIterator())
    return [t for _, t in found], np.array([label[d] for d, _ in found], np.int64), toxic / max(1, total)


def score(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, score): how likely each row's text is labelled toxic, from labels of rows that `usable` (over doc_id) admits.

    A text without words gets the score of the lowest window.  Labels other
    than 0 and 1 are left out; of several labels of a doc_id the highest counts,
    of several texts one, chosen by a hash.
    Without labels of both classes all scores are the share.  doc_id may be null
    or repeat; other columns are not read; an empty table gives no rows.
    """
    texts, toxic, share = sample(docs, labels, usable, rows)
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts, toxic, share) if texts else fit([""], np.array([0]), share))

    @X.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for part in X.pieces(batch):
                s = net.score(net.highest(Words(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s.astype(np.float64))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
