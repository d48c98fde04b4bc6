"""Packing documents into sequences: best-fit decreasing, certified by dual feasible functions.

Pieces are dealt to parts by hash; each part is packed by best-fit decreasing,
and dual feasible functions bound from below the bins that its lengths need.  A
part that meets its bound is done but for its emptiest bin.  Parts with a gap
give up their bins with room, all parts their emptiest one; those documents are
dealt anew to fewer parts and packed again, as long as that saves bins and the
bound for all lengths together is not met.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import textops as X
from tallyloom.llm.store import MOST_FILES, clustered, partitions, written

PART_ROWS = 20_000
#: Bytes of text whose pieces make one file.
FILE_BYTES = 32 << 20
#: Words that a worker remembers in each of two generations, and the longest such word.
REMEMBERED, LONGEST = 350_000, 48

_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[0x09, 0x0A]] = 0x20
_LOWER = _BLANK.copy()
_LOWER[0x41:0x5B] += 0x20
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


#: Bytes of words that are compared with each other; a longer one is a kind of its own.
COMPARED = 64


def _kinds(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each word, and a word of each kind.  Words of one kind are equal: hashes find kinds, and then all their bytes are compared."""
    size = end - start
    short, long = np.flatnonzero(size <= COMPARED), np.flatnonzero(size > COMPARED)
    _, one, kind = np.unique(X.word_hashes(buf, start[short], end[short]), return_index=True, return_inverse=True)
    of = short[one][kind]
    same = bool((size[short] == size[of]).all())
    more = np.flatnonzero(same & (size[short] > 8))  # up to 8 bytes, equal length and hash are equal words
    a, b, n = start[short[more]], start[of[more]], size[short[more]]
    for k in range(0, COMPARED, 8) if len(more) else ():
        left = n > k
        a, b, n = a[left], b[left], n[left]
        same = same and bool((X.eight(buf, a + k, n - k) == X.eight(buf, b + k, n - k)).all())
    if not same:
        return np.arange(len(start)), np.arange(len(start))
    which = np.empty(len(start), np.int64)
    which[short], which[long] = kind, len(one) + np.arange(len(long))
    return which, np.concatenate([short[one], long])


class Ids:
    """Token ids of texts by a vocabulary whose words never span white space.

    Texts are split at blanks and before a full stop or comma that ends a word,
    where the vocabulary's own pattern splits too; each part is encoded once and
    remembered.  When the young generation is full it becomes the old one, from
    which words still in use are taken over.
    """

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.long: list[bytes] = []

    def _encode(self, texts: list[str]) -> Iterator[list[int]]:
        return (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        plain, other, out = [], [], {}
        for w in map(bytes.decode, words):
            (plain if w.isalpha() and (w.isascii() or max(w) < "\u0250") else other).append(w)
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups]), strict=True):
            ids = np.array(ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(group):
                out.update((w.encode(), ids[a:b].tobytes()) for w, a, b in zip(group, [0, *cut[:-1].tolist()], cut.tolist(), strict=True))
            else:
                other += group
        out.update((w.encode(), struct.pack(f"<{len(ids)}I", *ids)) for w, ids in zip(other, self._encode(other), strict=True))
        return out

    def of(self, buf: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        s = (_BLANK if b"<|" in buf.tobytes() else _LOWER)[buf]
        stop = np.flatnonzero(_LETTER[s[:-2]] & ((s[1:-1] == 0x2E) | (s[1:-1] == 0x2C)) & (s[2:] == 0x20)) + 1 if len(s) > 2 else np.zeros(0, np.int64)
        offsets = offsets + np.searchsorted(stop, offsets)
        s = np.insert(s, stop, 0x20)
        inside = np.zeros(len(s) + 2, bool)
        inside[1:-1] = s != 0x20
        edge = np.zeros(len(s) + 1, bool)
        edge[offsets] = True
        start, end = np.flatnonzero(inside[1:] & (~inside[:-1] | edge)), np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        which, one = _kinds(s, start, end)
        raw = s.tobytes()
        words = [raw[i:j] for i, j in zip(start[one].tolist(), end[one].tolist(), strict=True)]
        known = list(map(self._ids(set(words)).__getitem__, words))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat, begin = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        own = sizes[which]
        upto = np.concatenate([[0], np.cumsum(own)])
        kind = np.int32 if upto[-1] < 1 << 31 else np.int64
        ids = flat[np.repeat((begin[which] - upto[:-1]).astype(kind), own) + np.arange(upto[-1], dtype=kind)]
        cuts = upto[np.searchsorted(start, offsets)].tolist()
        for i, j in itertools.pairwise(cuts):
            yield ids[i:j].tobytes()

    def rest(self) -> None:
        """Forgets the old generation, so that a worker between tasks holds one."""
        self.old = {}

    def _ids(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The young generation, once it has all these words, remembered or learned at once."""
        for w in self.long:
            self.young.pop(w, None)
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        missing = words - self.young.keys()
        kept = missing & self.old.keys()
        self.young.update(zip(kept, map(self.old.__getitem__, kept), strict=True))
        found = self._learn(missing - kept)
        self.young.update(found)
        self.long = [w for w in found if len(w) > LONGEST]
        return self.young


_known: dict[str, Ids] = {}
#: The name under which workers remember ids.
IDS = "ids"


def ids_by(name: str) -> Ids:
    """The worker's own Ids for a vocabulary."""
    if name not in _known:
        _known[name] = Ids(name)
    X.remember(IDS, _known.clear)
    return _known[name]


_ZSTD = pa.Codec("zstd", compression_level=1)


def folded(ids: bytes) -> bytes:
    """32-bit ids for the way through shuffles and files: their width, and 2 or 4 bytes each, compressed."""
    own = np.frombuffer(ids, "<u4")
    width = 2 if not len(own) or own.max() < 1 << 16 else 4
    return bytes([width]) + _ZSTD.compress(own.astype(f"<u{width}").tobytes(), asbytes=True)


def unfolded(data: bytes, length: int) -> bytes:
    return np.frombuffer(_ZSTD.decompress(data[1:], length * data[0], asbytes=True), f"<u{data[0]}").astype("<u4").tobytes()


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Sequences lie in runs of 1 << RUN, each run whole in one file.
RUN = 8


def pieces(docs: DataFrame, name: str, limit: int, end: int) -> DataFrame:
    """Each document's ids and the end id, cut only where they exceed limit."""

    @partial(X.tidied, keeps=IDS)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.pieces(batch):
                out: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), ids_by(name).of(*X.bytes_of(part.column("text"))), strict=True):
                    ids = memoryview(ids + np.array([end], "<u4").tobytes())
                    for k, at in enumerate(range(0, len(ids) // 4, limit)):
                        piece = ids[4 * at : 4 * (at + limit)]
                        out.append((doc, k, at, len(piece) // 4, zlib.crc32(piece), folded(piece)))
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        ids_by(name).rest()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE + ", ids binary")


def lower_bound(counts: np.ndarray, size: int) -> int:
    """The bins of that size that counts[length] items need at least, by two families of dual feasible functions."""
    if not counts.any():
        return 0
    x = np.arange(size + 1)
    total = int((counts * x).sum())
    best = -(-total // size)
    mass, number = np.cumsum(counts * x), np.cumsum(counts)
    k = np.arange(1, size // 2 + 1)  # items over size - k count whole, those under k not
    best = max(best, int((-(-(((number[-1] - number[size - k]) * size) + (mass[size - k] - mass[k - 1])) // size)).max()))
    for p in range(1, 31):
        u = np.where((p + 1) * x % size == 0, p * x, (p + 1) * x // size * size)
        best = max(best, -(-int((counts * u).sum()) // (p * size)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, by best-fit decreasing; a bit set of the free spaces in use finds the tightest."""
    free: list[list[int]] = [[] for _ in range(size + 1)]
    spaces, bins = 0, 0
    to, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fits = spaces >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                spaces ^= 1 << room
        else:
            room, b, bins = size, bins, bins + 1
        to[i], at[i] = b, size - room
        if room > n:
            if not free[room - n]:
                spaces |= 1 << (room - n)
            free[room - n].append(b)
    return to, at


SEQUENCES = PIECE + ", sequence_id long, offset long"
PACKED = PIECE + ", key long, part long, sequence_id long, offset long, opened boolean"


def _pack(df: DataFrame, parts: int, size: int, turn: int) -> DataFrame:
    """One round: parts by hash, each packed; opened: the piece is to be exchanged."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        length = p.length.to_numpy()
        to, at = best_fit(length, size)
        fill = np.bincount(to, length)
        gap = len(fill) > lower_bound(np.bincount(length, minlength=size + 1), size)
        least = fill == fill.min()
        least[np.flatnonzero(least)[:-1]] = False
        opened = (least & (fill < size)) | (gap & (fill < size - size // 64))
        return p.assign(sequence_id=((turn << 36) + p.part) * (1 << 20) + to, offset=at, opened=opened[to])

    dealt = df.select("doc_id", "piece", "start", "length", "ids_crc32", "key", F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(parts)).alias("part"))
    return written(dealt.groupBy("part").applyInPandas(run, PACKED), "packed")


def pack(docs: DataFrame, name: str = "word_bpe_49k.json", size: int = 4096, end: int = 1, part_rows: int = PART_ROWS, turns: int = 4, digests: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids): a row for each piece, as the written sequences hold it.

    ids: little-endian 32-bit integers; those of a sequence are its pieces' by
    offset.  A sequence's pieces lie in one file, one after another.  digests: all
    columns but ids, still of the ids in the files.

    A null or empty text is its end id alone.  Only documents over size ids are
    cut, into whole sequences and a rest.  Rows with a null or repeated doc_id
    are packed like any other.  An empty table gives no rows; other columns are
    not read.
    """
    length = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    files = min(MOST_FILES, max(partitions(docs.sparkSession), -(-length // FILE_BYTES)))
    cut = clustered(pieces(docs, name, size, end).withColumn("key", F.monotonically_increasing_id()), "key", files, "pieces")
    counts = np.zeros(size + 1, np.int64)
    for r in cut.groupBy("length").count().toLocalIterator():
        counts[r.length] = r["count"]
    bound, left = lower_bound(counts, size), int(counts.sum())
    kept, last, todo, now = [], None, cut, 0
    for turn in range(turns):
        packed = _pack(todo, max(1, -(-left // part_rows)), size, turn)
        bins = packed.select("sequence_id").distinct().count()
        if last is not None and bins >= last[0]:
            kept.append(last[1])
            break
        now = bins + (now - last[0] if last else 0)
        opened = packed.where("opened")
        left, open_bins = opened.agg(F.count("*"), F.countDistinct("sequence_id")).first()
        kept.append(packed.where("not opened"))
        last = (open_bins, opened)
        if now <= bound or open_bins < 2 or turn == turns - 1:
            kept.append(opened)
            break
        todo = opened
    out = kept[0]
    for df in kept[1:]:
        out = out.unionByName(df)
    return _sequences(cut, files, out, digests)


def _sequences(cut: DataFrame, files: int, placed: DataFrame, digests: bool) -> DataFrame:
    """The pieces' ids brought to their sequences, written, and what the files hold."""
    places = placed.select("key", "sequence_id", "offset").repartition(files, "key").hint("shuffle_hash")  # ids stay where they are and stream past the places
    rows = cut.select("key", "doc_id", "piece", "start", "length", "ids").join(places, "key").drop("key")
    held = written(rows.repartition(F.shiftright("sequence_id", RUN)).sortWithinPartitions("sequence_id", "offset"), "sequences")

    @X.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                doc, piece, start, length, data, sequence, offset = part.columns
                ids = [unfolded(x, n) for x, n in zip(data.to_pylist(), length.to_pylist(), strict=True)]
                sizes, sums = pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())
                cols = [doc, piece, start, sizes, sums, sequence, offset, *([] if digests else [pa.array(ids, pa.binary())])]
                yield pa.RecordBatch.from_arrays(cols, [x.split(" ")[0] for x in kinds.split(", ")])

    kinds = SEQUENCES if digests else SEQUENCES + ", ids binary"
    return held.select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset").mapInArrow(run, kinds)
