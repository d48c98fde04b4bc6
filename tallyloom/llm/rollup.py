"""Token-count rollups kept by signed deltas.

A change row has the state of one document under one tokenizer version before
and after: an insert has no before, a delete no after, a revised count both.  A
batch of changes becomes one signed row for each source, language and tokenizer
version it touches, and is written under its batch id.  Writing a batch again
replaces its rows by the same ones, so a rerun or a retry counts once.  Totals
are sums over batches; no state by document is kept or read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import textops as X
from tallyloom.llm.packing import IDS

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, documents long, tokens long, batch_id string"


def changes(df: DataFrame, tokenizer: str, before: Column | None, after: Column | None) -> DataFrame:
    """Change rows from documents: before and after are token counts, None where the document is absent."""
    null = F.lit(None).cast("long")
    return df.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), (null if before is None else before.cast("long")).alias("before"), (null if after is None else after.cast("long")).alias("after"))


class Rollup:
    """Totals by source, language and tokenizer version in a folder of Parquet files.

    The folder holds generations and, in `versions`, which of them is complete;
    the last complete one counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, folder: str, schema: str) -> DataFrame:
        """A folder's rows; none where nothing has been written."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _generation(self) -> int:
        return self._read("versions", "n long").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]

    def merged(self) -> DataFrame:
        """(batch_id) of batches that compact has merged: sent again they change nothing."""
        return self._read(f"merged-{self._generation()}", "batch_id string")

    def commit(self, batch_id: str, rows: DataFrame) -> None:
        """Adds a batch of changes; the same batch_id again replaces it, or does nothing once it has been merged.

        Null sources and languages are keys of their own.  A row with neither
        before nor after, and an empty batch, change nothing.
        """
        if self.merged().where(F.col("batch_id") == batch_id).limit(1).count():
            return
        one = lambda c: F.col(c).isNotNull().cast("long")
        signed = rows.groupBy(*KEYS).agg(F.sum(one("after") - one("before")).alias("documents"), F.sum(F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("tokens"))
        out = signed.select(*KEYS, "documents", "tokens", F.lit(batch_id).alias("batch_id"))
        self._write(out, self._generation())

    def _write(self, out: DataFrame, generation: int) -> None:
        out.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{self.path}/deltas-{generation}")

    def deltas(self) -> DataFrame:
        return self._read(f"deltas-{self._generation()}", DELTA)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) with at least one document left."""
        return self.deltas().groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")

    def compact(self, into: str) -> None:
        """Merges all batches into one, in a new generation that counts once it is complete; until then the old one does.

        The merged batches' ids are kept, so that none counts twice when it is
        sent again.  Batches committed meanwhile would be lost: compact between
        loads.  A rerun after a crash writes the same generation anew.
        """
        new = self._generation() + 1
        self._write(self.totals().select(*KEYS, "documents", "tokens", F.lit(into).alias("batch_id")), new)
        ids = self.deltas().select("batch_id").union(self.merged()).distinct()
        ids.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/merged-{new}")
        self.spark.range(new, new + 1).select(F.col("id").alias("n")).coalesce(1).write.mode("append").parquet(f"{self.path}/versions")


def counted(docs: DataFrame, counters: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """docs' doc_id, source, lang with a hash of the text and, for each counter, its count of the whole text.

    A counter takes the bytes of many texts and where each begins, and gives a
    number for each.  A null text counts as empty.
    """
    names = [f"n{i}" for i in range(len(counters))]
    schema = "doc_id long, source string, lang string, copy long, " + ", ".join(f"{n} long" for n in names)

    @partial(X.tidied, keeps=IDS)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.pieces(batch):
                buf, offsets = X.bytes_of(part.column("text"))
                cols = [pa.array(f(buf, offsets), pa.int64()) for f in counters.values()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "source", "lang", "copy")), *cols], ["doc_id", "source", "lang", "copy", *names])

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), "source", "lang", F.xxhash64(text).alias("copy"), text.alias("text")).mapInArrow(run, schema)


def bytes_counter(_: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of a byte-level tokenizer: one for each UTF-8 byte."""
    return np.diff(offsets)


def vocabulary_counter(name: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Tokens by one of the public vocabularies."""

    def count(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        from tallyloom.llm.packing import ids_by

        return np.array([len(x) // 4 for x in ids_by(name).of(buf, offsets)], np.int64)

    return count
