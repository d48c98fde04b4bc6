"""Byte-level BPE over a whole corpus: each distinct pre-token is encoded once.

Pre-tokens are the matches of the vocabulary's pattern.  Documents are taken in
blocks of some megabytes; a block numbers its distinct pre-tokens, the most
frequent first, and each document's positions hold these numbers.  The blocks'
pre-tokens are shuffled by themselves, so that those alike meet and are merged
once in the corpus; their ids go back to the blocks' numbers and are laid out by
position.  What is shuffled is a row for each pre-token of a block, never one for
each position: the positions stay in files, dealt by block where they are
written.  A pre-token that every block holds is one row a block, so no key is hot.

Decoding looks each id up in the table of token bytes, which has as many rows as
the vocabulary has tokens.

A null text is empty and has no ids.  Rows are independent of each other: null
or repeated keys, repeated rows and ties stay as they are.  An empty table gives
an empty table.  Only the columns in `keep` are carried, so that no other column
can clash; keeping a column called `ids` is refused.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyloom.llm import textops as X
from tallyloom.llm.store import bucketed, partitions

#: Bytes of text in a block; a longer document makes a block of its own.
BLOCK_BYTES = 32 << 20
#: Pre-tokens of a task whose ids are sent back at once.
FOLDED = 500_000
#: Positions laid out at once.
AT_ONCE = 1 << 20
#: The name under which workers remember vocabularies.
KEPT = "bpe"
_known: dict[tuple[str, str], Vocabulary] = {}


class Splitter:
    """The matches of a pattern, as the library behind the vocabulary finds them.

    That library and this one follow different editions of Unicode, so a
    character that they take for different kinds is matched by a stand-in of the
    kind that the library takes it for, and cut from the text as it is.
    """

    KINDS = ((r"\p{L}", "a"), (r"\p{N}", "0"), (r"\s", "\t"))
    OTHER = "§"

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)
        one = {bytes([i]): i for i in range(256)}
        self.kinds = [(tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=one, special_tokens={}), regex.compile(kind), stand_in) for kind, stand_in in self.KINDS]
        self.seen: set[str] = set()
        self.stand_ins: dict[int, str] = {}

    def _look(self, chars: set[str]) -> None:
        for c in chars:
            theirs = [bool(kind.encode_ordinary(c)) for kind, _, _ in self.kinds]
            if theirs != [bool(own.match(c)) for _, own, _ in self.kinds]:
                self.stand_ins[ord(c)] = next((s for (_, _, s), is_it in zip(self.kinds, theirs, strict=True) if is_it), self.OTHER)
        self.seen |= chars

    def __call__(self, text: str) -> list[str]:
        if not text.isascii():
            new = set(text) - self.seen
            if new:
                self._look(new)
            if self.stand_ins and any(chr(c) in text for c in self.stand_ins):
                return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand_ins))]
        return self.pattern.findall(text)


class Vocabulary:
    """A rank file of public_tokenizers: split gives pre-tokens, merged the ids of one, and starts, sizes and flat the bytes of each id."""

    def __init__(self, name: str, pattern: str):
        import public_tokenizers

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = Splitter(pattern)
        self.merged = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.sizes = np.full(max(ranks.values()) + 1, -1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        self.starts = np.cumsum(np.maximum(self.sizes, 0)) - np.maximum(self.sizes, 0)
        self.width = "<u2" if len(self.sizes) <= 1 << 16 else "<u4"
        self.flat = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)


def vocabulary(name: str, pattern: str | None = None) -> Vocabulary:
    """The worker's own copy of a vocabulary; pattern: that of public_tokenizers where None."""
    import public_tokenizers

    key = (name, pattern or public_tokenizers.PATTERN)
    if key not in _known:
        _known[key] = Vocabulary(*key)
    X.remember(KEPT, _known.clear)
    return _known[key]


def laid_out(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> bytes:
    """flat[starts[p] : starts[p] + sizes[p]] of each pick p, one after another."""
    out = []
    for at in range(0, len(picks), AT_ONCE):
        own = picks[at : at + AT_ONCE]
        size = sizes[own]
        ends = np.cumsum(size)
        out.append(flat[np.repeat(starts[own] - (ends - size), size) + np.arange(ends[-1])].tobytes())
    return b"".join(out)


def _planes(codes: np.ndarray) -> bytes:
    """32-bit numbers by place of their bytes, so that files compress the high ones away."""
    return np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T).tobytes()


def _codes(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def positions(docs: DataFrame, keep: tuple[str, ...], name: str, pattern: str | None = None) -> DataFrame:
    """Rows of two kinds, by block: (kept, codes) for each document, its pre-tokens' numbers in order; (word, code) for each number of the block."""
    kept = T.StructType([docs.schema[c] for c in keep])
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("kept", kept), T.StructField("codes", T.BinaryType()), T.StructField("word", T.StringType()), T.StructField("code", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, task, n = vocabulary(name, pattern).split, TaskContext.get().partitionId(), 0
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        rows: list[pa.Array] = []
        codes: list[np.ndarray] = []
        size = 0

        def block() -> Iterator[pa.RecordBatch]:
            of = (task << 24) + n
            words = list(numbers)
            often = np.bincount(np.concatenate([np.zeros(0, "<u4"), *codes]), minlength=len(words))
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(words), "<u4")
            rank[order] = np.arange(len(words), dtype="<u4")
            for part in rows:
                own = [_planes(rank[c]) for c in codes[: len(part)]]
                del codes[: len(part)]
                yield _filled(arrow, len(part), block=pa.array([of] * len(part), pa.int64()), kept=part, codes=pa.array(own, pa.binary()))
            names = sorted(range(len(words)), key=words.__getitem__)  # alike words side by side take less of a file
            for at in range(0, len(names), 10_000):
                own = names[at : at + 10_000]
                yield _filled(arrow, len(own), block=pa.array([of] * len(own), pa.int64()), word=pa.array([words[i] for i in own], pa.string()), code=pa.array(rank[own].astype(np.int32), pa.int32()))
            numbers.clear()
            rows.clear()

        for batch in batches:
            for part in X.pieces(batch):
                rows.append(part.column(part.schema.get_field_index("kept")))
                for text in part.column(part.schema.get_field_index("text")).to_pylist():
                    words = split(text) if text else []
                    codes.append(np.fromiter(map(numbers.__getitem__, words), "<u4", len(words)))
                    size += len(text or "")
                if size >= BLOCK_BYTES:
                    yield from block()
                    n, size = n + 1, 0
        if rows:
            yield from block()

    return docs.select(F.struct(*keep).alias("kept"), "text").mapInArrow(X.tidied(run, KEPT), schema)


def _filled(schema: pa.Schema, n: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of n rows: the columns given, in the types of the schema, and nulls."""
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


_ZSTD = pa.Codec("zstd", compression_level=1)


def _folded(codes: np.ndarray, ids: list[bytes]) -> bytes:
    """Numbers and the ids of each for the way through a shuffle: in order of number, as steps, sizes and ids."""
    order = np.argsort(codes)
    ids = [ids[i] for i in order.tolist()]
    sizes = np.fromiter(map(len, ids), "<u4", len(ids))
    return _ZSTD.compress(_planes(np.diff(codes[order], prepend=0).astype("<u4")) + _planes(sizes) + b"".join(ids), asbytes=True)


def _unfolded(n: int, length: int, data: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """The numbers, the bytes of each one's ids, and these, of what was length bytes before."""
    whole = _ZSTD.decompress(data, length, asbytes=True)
    return np.cumsum(_codes(whole[: 4 * n]), dtype=np.int64), _codes(whole[4 * n : 8 * n]).astype(np.int64), whole[8 * n :]


def numbered_ids(words: DataFrame, name: str, pattern: str | None = None) -> DataFrame:
    """(of, n, length, data): the ids, by the ranks, of the words of a block in (of, word, code), some of them a row.

    Equal words meet and are merged once.  Ids take two bytes where the
    vocabulary allows it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name, pattern)
        last: tuple[str | None, bytes] = (None, b"")
        of: list[np.ndarray] = []
        codes: list[np.ndarray] = []
        ids: list[bytes] = []

        def folded() -> pa.RecordBatch:
            own, code = np.concatenate([np.zeros(0, np.int64), *of]), np.concatenate([np.zeros(0, np.int64), *codes])
            order = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.diff(own[order])) + 1
            rows = []
            for part in np.split(order, cuts) if len(order) else []:
                some = [ids[i] for i in part.tolist()]
                rows.append((int(own[part[0]]), len(part), 8 * len(part) + sum(map(len, some)), _folded(code[part], some)))
            of.clear()
            codes.clear()
            ids.clear()
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["of", "n", "length", "data"])

        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            own = [last[1] if w == last[0] else np.array(v.merged(w.encode()), v.width).tobytes() for w in coded.dictionary.to_pylist()]
            last = (coded.dictionary[-1].as_py(), own[-1]) if own else last
            of.append(batch.column(0).to_numpy())
            codes.append(batch.column(2).to_numpy().astype(np.int64))
            ids += map(own.__getitem__, coded.indices.to_pylist())
            if len(ids) >= FOLDED:
                yield folded()
        yield folded()

    together = words.repartition("word").sortWithinPartitions("word")
    return together.select("of", "word", "code").mapInArrow(X.tidied(run, KEPT), "of long, n int, length long, data binary")


def encode(docs: DataFrame, name: str, keep: tuple[str, ...] = ("doc_id",), pattern: str | None = None) -> DataFrame:
    """The columns in keep and `ids` of each document's whole text, as little-endian 32-bit numbers in a binary."""
    if "ids" in keep:
        raise ValueError("ids is the name of the result")
    spark = docs.sparkSession
    held = bucketed(positions(docs, keep, name, pattern), "block", partitions(spark), "positions")
    numbered = numbered_ids(held.where("word is not null").select(F.col("block").alias("of"), "word", "code"), name, pattern)
    width = vocabulary(name, pattern).width
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.BinaryType())])

    def assembled(block: pa.Table, numbers: pa.Table) -> pa.Table:
        parts = [_unfolded(*x) for x in zip(*(numbers.column(c).to_pylist() for c in ("n", "length", "data")), strict=True)]
        code = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
        size = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)]) // int(width[2])
        flat = np.frombuffer(b"".join(p[2] for p in parts), width).astype("<u4")
        starts, sizes = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        starts[code], sizes[code] = np.cumsum(size) - size, size
        out = [laid_out(flat, starts, sizes, _codes(c)) for c in block.column("codes").to_pylist()]
        kept = block.column("kept").combine_chunks()
        return pa.Table.from_arrays([*kept.flatten(), pa.array(out, pa.binary())], names=[*keep, "ids"])

    both = held.where("codes is not null").select("block", "kept", "codes").groupBy("block").cogroup(numbered.groupBy("of"))
    return both.applyInArrow(assembled, schema)


def decode(encoded: DataFrame, name: str, pattern: str | None = None) -> DataFrame:
    """encoded with `decoded`, the bytes of its `ids` (null: null) joined from the table of token bytes; an id that the vocabulary lacks is an error."""
    if "decoded" in encoded.columns:
        raise ValueError("decoded is the name of the result")
    at = encoded.columns.index("ids")
    schema = T.StructType([*encoded.schema, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name, pattern)
        for batch in batches:
            out = []
            for data in batch.column(at).to_pylist():
                ids = None if data is None else np.frombuffer(data, "<u4")
                if ids is not None and len(ids) and (ids.max() >= len(v.sizes) or v.sizes[ids].min() < 0):
                    raise ValueError("an id outside the vocabulary")
                out.append(None if ids is None else laid_out(v.flat, v.starts, v.sizes, ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(X.tidied(run, KEPT), schema)
