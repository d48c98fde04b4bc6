"""Language identification by cross-parsing: the language whose suffix automaton needs fewest normalised phrases.

Texts become symbols: letters a-z without case, UTF-8 bytes of other letters,
and one symbol for each run of anything else.  For each language the suffix
automaton of a bounded sample of labelled text knows all its substrings.  A
text is parsed greedily into the longest phrases that the automaton knows, in
blocks of `BLOCK` symbols side by side; phrases times log2 of the sample's
length estimate the bits of the text in that language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyloom.llm import textops as X

BLOCK = 1024
ALPHABET = 64

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[0x41:0x5B] = _SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0x80:0xC0] = 27 + np.arange(64) % 32
_SYMBOL[0xC0:] = 59 + np.arange(64) % 5


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts and where each text's begin, with the end."""
    buf, offsets = X.bytes_of(texts)
    s = _SYMBOL[buf]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    return s[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def automaton(s: np.ndarray) -> np.ndarray:
    """Transitions [state, symbol] of the suffix automaton of s; -1: none; state 0 is the start."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in s.tolist():
        cur = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = cur
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    table = np.full((len(following), ALPHABET), -1, np.int32)
    for state, to in enumerate(following):
        table[state, list(to)] = list(to.values())
    return table


class Parser:
    """The automata of all languages in one table, each state an offset into it."""

    def __init__(self, samples: dict[str, np.ndarray]):
        self.langs = sorted(samples)
        tables, self.roots, at = [], [], 0
        for lang in self.langs:
            t = automaton(samples[lang])
            tables.append(np.where(t >= 0, (t + at) * ALPHABET, -1).astype(np.int32))
            self.roots.append(at * ALPHABET)
            at += len(t)
        self.table = np.concatenate([np.zeros(0, np.int32), *(t.ravel() for t in tables)])
        self.roots = np.array(self.roots, np.int32)[:, None]
        self.bits = np.log2([max(2, len(samples[x])) for x in self.langs])

    def phrases(self, s: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[language, text]: phrases of each text, added over its blocks."""
        blocks = -(-np.diff(offsets) // BLOCK)
        text = np.repeat(np.arange(len(blocks)), blocks)
        start = offsets[text] + BLOCK * (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        size = np.minimum(BLOCK, offsets[text + 1] - start)
        order = np.argsort(-size, kind="stable")
        start, size, text = start[order], size[order], text[order]
        state = np.repeat(self.roots, len(start), 1)
        count = np.ones(state.shape, np.int64)
        active = np.searchsorted(-size, -np.arange(BLOCK), "left")
        for t in range(int(size[0]) if len(size) else 0):
            n = int(active[t])
            c = s[start[:n] + t].astype(np.int32)
            to = self.table[state[:, :n] + c]
            if (lost := to < 0).any():
                count[:, :n] += lost
                again = self.table[self.roots + c]
                to = np.where(lost, np.where(again < 0, self.roots, again), to)
            state[:, :n] = to
        out = np.zeros((len(self.langs), len(blocks)))
        for k in range(len(self.langs)):
            out[k] = np.bincount(text, count[k], minlength=len(blocks))
        return out


def train(docs: DataFrame, usable: Column, sample_rows: int, sample_bytes: int, all_bytes: int) -> Parser:
    """The parser from rows with a language that `usable` admits.

    Bounds, and the only limits to what is learned: for each language whole texts
    among the first sample_rows rows in the order of a hash, up to sample_bytes
    together (all_bytes over all languages), texts of an eighth of that and less
    first; the shortest text, if none is so short.
    """
    at = F.xxhash64("doc_id", "text")
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.octet_length("text").alias("size"), at.alias("at"))
    first = rows.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("at"))).where(F.col("k") <= sample_rows)
    sizes: dict[str, dict[int, int]] = {}
    for r in first.toLocalIterator():
        sizes.setdefault(r.lang, {})[r["at"]] = r["size"]
    most, chosen = min(sample_bytes, all_bytes // max(1, len(sizes))), set()
    for lang, some in sizes.items():
        left = most
        for h, size in sorted(some.items(), key=lambda x: (x[1] if min(some.values()) > most else 8 * x[1] > most, x[0])):
            if size <= left or left == most:
                chosen.add((lang, h))
                left -= size
    texts: dict[str, list[tuple]] = {}
    wanted = docs.where(at.isin(sorted({h for _, h in chosen})) & usable & F.col("lang").isNotNull()).select("lang", at.alias("at"), "text").dropDuplicates(["lang", "at"])
    for r in wanted.toLocalIterator():
        if (r.lang, r["at"]) in chosen:
            texts.setdefault(r.lang, []).append((r["at"], r.text))
    return Parser({lang: symbols(pa.array([" ".join(t for _, t in sorted(rows))]))[0] for lang, rows in texts.items()})


def identify(docs: DataFrame, usable: Column, sample_rows: int = 200, sample_bytes: int = 30_000, all_bytes: int = 400_000, sharpness: float = 6.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, `keep` columns, lang_pred, score, phrases): the language of each row's whole text.

    lang_pred is `und`, score 0, where the text is null or has no letter, and
    everywhere if no row can be learned from.  score is a softmax of the
    normalised phrases.  phrases: language to normalised phrases per symbol.
    A tie goes to the language that sorts first.  doc_id may be null or repeat;
    columns but doc_id, text and lang are not read; an empty table gives no rows.
    """
    known = train(docs, usable, sample_rows, sample_bytes, all_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    carried = list(dict.fromkeys(["doc_id", *keep]))
    text = "text" if "text" in carried else "text_"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carried).schema) + ", lang_pred string, score double, phrases map<string,double>"

    @X.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = shared.value
        for batch in batches:
            for part in X.pieces(batch, text):
                s, offsets = symbols(part.column(text))
                letters = np.array(part.column("letters_").to_pylist(), bool) & bool(parser.langs)
                rate = parser.phrases(s, offsets) * parser.bits[:, None] / np.maximum(1, np.diff(offsets)) if parser.langs else np.zeros((1, part.num_rows))
                best = rate.argmin(0)
                odds = np.exp(-sharpness * (rate - rate.min(0)))
                score = np.where(letters, odds.max(0) / odds.sum(0), 0.0)
                pred = [parser.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                rates = [list(zip(parser.langs, rate[:, i].tolist(), strict=True)) if ok else [] for i, ok in enumerate(letters)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(pred), pa.array(score), pa.array(rates, pa.map_(pa.string(), pa.float64()))], [*carried, "lang_pred", "score", "phrases"])

    return docs.select(*carried, *([] if text in carried else [F.col("text").alias(text)]), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters_")).mapInArrow(run, schema)
