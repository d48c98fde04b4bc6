"""The evidence rung: a reader chooses among the candidates of open abstentions from their descriptions alone.

A reader is any callable from a list of requests (note, labelled descriptions)
to a list of (label or None, confidence).  It never sees amounts, dates or ids.
An answer outside the labels, or below the floor, leaves the abstention as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators.baselines import described
from tallyloom.operators.ladder import PassResult
from tallyloom.sources.batch import Batch

FLOOR = 0.70
# Spellings of no answer.
NO_ANSWER = ("", "null", "none", "nil", "n/a", "abstain")

Request = tuple[str, list[tuple[str, str]]]
Reader = Callable[[Sequence[Request]], Sequence[tuple[str | None, float]]]


def declining(requests: Sequence[Request]) -> list[tuple[str | None, float]]:
    return [(None, 0.0) for _ in requests]


def scripted(answers: dict[str, tuple[str | None, float]]) -> Reader:
    """Answers by note, for tests."""
    return lambda requests: [answers.get(note, (None, 0.0)) for note, _ in requests]


def by_words(requests: Sequence[Request]) -> list[tuple[str | None, float]]:
    """The one description that shares words with the note, if only one does."""
    out: list[tuple[str | None, float]] = []
    for note, choices in requests:
        words = set(note.lower().split())
        hits = [label for label, text in choices if words & set(text.lower().split())]
        out.append((hits[0], 0.9) if len(hits) == 1 else (None, 0.0))
    return out


def requests(batch: Batch, open_lines: DataFrame, consumed: DataFrame) -> DataFrame:
    """(detail_id, settlement_id, note, choices): candidates still free, sorted by id and lettered; two at least."""
    pairs = open_lines.select("detail_id", "settlement_id", F.explode("candidate_event_ids").alias("event_id")).join(consumed, "event_id", "left_anti")
    pairs = pairs.join(batch.ledger.select("event_id", "txn_id"), "event_id").join(described(batch), "txn_id", "left")
    grouped = pairs.groupBy("detail_id", "settlement_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.coalesce("parent", F.lit("")).alias("text")))).alias("c"))
    lettered = F.transform("c", lambda x, i: F.struct(S.letter(i).alias("label"), x["event_id"].alias("event_id"), x["text"].alias("text")))
    notes = batch.detail.select("detail_id", F.col("reference_text").alias("note"))
    return grouped.where(F.size("c") > 1).join(notes, "detail_id").where("note is not null").select("detail_id", "settlement_id", "note", lettered.alias("choices"))


def usage(calls: DataFrame, *by: str) -> DataFrame:
    """Sums of input, output and cached input tokens and the number of calls, over all rows or by columns."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return calls.groupBy(*by).agg(total("input_tokens"), total("output_tokens"), total("cache_read_tokens"), F.count("*").alias("calls"))


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, calls, input_tokens, output_tokens, cache_read_tokens, usd) of calls by model, at prices (model, rate_in, rate_out) a million tokens.

    A model without a price, or without a name, costs nothing; of several prices
    of a model the dearest holds.  Dollars are of the summed tokens.
    """
    rates = prices.where("model is not null").groupBy("model").agg(F.max_by("rate_in", F.struct("rate_in", "rate_out")).alias("rate_in"), F.max_by("rate_out", F.struct("rate_in", "rate_out")).alias("rate_out"))
    sums = usage(calls, "model").join(rates, "model", "left")
    usd = S.cost_usd(F.col("input_tokens"), F.col("cache_read_tokens"), F.col("output_tokens"), F.col("rate_in"), F.col("rate_out"))
    return sums.select("model", "calls", "input_tokens", "output_tokens", "cache_read_tokens", usd.alias("usd"))


def adjudication(reader: Reader = declining, floor: float = FLOOR, most_calls: int | None = None) -> Callable[[Batch, DataFrame, DataFrame], PassResult]:
    """A residual rung for run_ladder; its claims are SUGGESTED.

    most_calls: lines that the reader is asked about, the first by id; the
    others stay open.  An answer whose confidence is no number from 0 to 1 counts
    as none.
    """

    def rung(batch: Batch, consumed: DataFrame, open_lines: DataFrame) -> PassResult:
        asked = requests(batch, open_lines, consumed)
        asked = asked if most_calls is None else asked.orderBy("detail_id").limit(most_calls)

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                answers = reader([(r.note, [(c["label"], c["text"]) for c in r.choices]) for r in p.itertuples()])
                rows = []
                for r, (label, confidence) in zip(p.itertuples(), answers, strict=True):
                    said = (label or "").strip().upper()
                    event = None if said.lower() in NO_ANSWER else next((c["event_id"] for c in r.choices if c["label"] == said), None)
                    confidence = float(confidence)
                    sure = confidence if 0.0 <= confidence <= 1.0 else 0.0  # not a number fails both
                    rows.append((r.detail_id, r.settlement_id, event if sure >= floor else None, sure))
                yield pd.DataFrame(rows, columns=["detail_id", "settlement_id", "event_id", "confidence"])

        got = asked.mapInPandas(ask, "detail_id string, settlement_id string, event_id string, confidence double").withColumn("pass_name", F.lit("adjudication"))
        claims = got.where("event_id is not null").select("settlement_id", "event_id", "detail_id", "pass_name", F.lit("SUGGESTED").alias("tier"), "confidence", F.lit(0).cast("long").alias("emit_order"))
        count = got.agg(F.count("*").alias("read"), F.count("event_id").alias("accepted"))
        counters = count.select(F.explode(F.array(*(F.struct(F.lit("adjudication").alias("pass_name"), F.lit(c).alias("counter"), F.col(c).alias("n")) for c in ("read", "accepted")))).alias("x")).select("x.*")
        none = open_lines.limit(0)
        return PassResult(claims, none, counters)

    return rung
