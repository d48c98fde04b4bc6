"""The decision journal: one record for each claim, abstention, rejection and verdict, chained by hashes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tallyloom.functions import scalars as S
from tallyloom.operators import codec
from tallyloom.operators.ladder import LadderRun
from tallyloom.sources.batch import Batch
from tallyloom.sources.kept import kept

# The stage of each pass, the stages and actions there are, the action of each outcome, and the hash before the first record.
STAGE_BY_PASS = {"exact_join": "S1", "refund_corroboration": "S2", "adjudication": "S4"}
DISPOSITION = "S5"
STAGES = tuple(f"S{n}" for n in range(7))
ACTIONS = ("match", "exception", "abstain", "no_action")
ACTION_BY_OUTCOME = {"RECONCILED": "match", "EXCEPTION": "exception", "NO_ACTION": "no_action", "ABSTAIN": "abstain"}
GENESIS = "0" * 64
#: Records of a range of the chain, which one task sorts and hashes.
LINK = 250_000

INPUTS = "settlement_id string, event_id string, detail_id string, event_amount_paise bigint, event_currency string, event_type string, event_txn_id string, line_net_effect_paise bigint, line_type string, line_settled_at string, candidate_event_ids array<string>, candidate_count bigint, proposed_by string, case_id string, allocations array<array<string>>, allocation_count bigint"
RESULT = "settlement_id string, event_id string, candidates array<string>, outcome string, category string"
#: A record's fields; those of inputs and result that a kind of decision does not have are left out.
RECORD = f"action string, confidence double, decision_id string, inputs struct<{INPUTS.replace(' ', ':').replace(',:', ',')}>, overridable boolean, reasoning string, result struct<{RESULT.replace(' ', ':').replace(',:', ',')}>, rule string, stage string, subject array<string>, timestamp string"


class Tampered(ValueError):
    """The journal's hashes do not follow from its records."""


def _struct(schema: str, **fields: Column) -> Column:
    """A struct of that schema with the fields given, the others null."""
    whole = T.StructType.fromDDL(schema)
    return F.struct(*(fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in whole.fields))


def _record(action: Column, stage: Column, ids: Column, rule: Column, confidence: Column, overridable: bool, reasoning: Column, inputs: Column, result: Column, *order: Column, spoken: Column | None = None) -> list[Column]:
    """spoken: whether there is a reasoning, where that follows from less than all of it."""
    spoken = F.trim(reasoning) != "" if spoken is None else spoken
    return [action.alias("action"), stage.alias("stage"), S.subject(ids).alias("subject"), rule.alias("rule"), confidence.cast("double").alias("confidence"), F.lit(overridable).alias("overridable"), reasoning.alias("reasoning"), inputs.alias("inputs"), result.alias("result"), F.struct(*order).alias("place"), spoken.alias("spoken")]


def build(run: LadderRun, decided: DataFrame, batch: Batch | None = None, allocations: DataFrame | None = None, timestamp: str | None = None) -> DataFrame:
    """Records with their place: by rung claims, then abstentions; then rejections; then verdicts.

    batch: whose events and lines the claims' records tell of; allocations:
    (case_id, event_id, settlement_id), told by the verdicts' records.  A record
    that could not be audited is an error when it is read.
    """
    unknown = F.raise_error(F.concat(F.lit("no stage for pass "), F.coalesce(F.col("pass_name"), F.lit("null"))))
    stage = F.coalesce(S.lookup(F.col("pass_name"), STAGE_BY_PASS, None), unknown)
    ids = F.array("event_id", "detail_id", "settlement_id")
    place = lambda kind, a, b: (F.lit(kind).alias("kind"), a.cast("string").alias("a"), b.alias("b"))
    note = F.format_string("%s attributed to %s", F.col("detail_id"), F.col("event_id"))
    pair = {c: F.col(c) for c in ("settlement_id", "event_id", "detail_id")}
    facts, accepted = {}, run.accepted
    if batch is not None:
        about = enriched(run, batch)
        told = ("event_amount_paise", "event_currency", "event_type", "event_txn_id", "line_net_effect_paise", "line_type", "line_settled_at")
        accepted = about.select(*run.accepted.columns, F.col("amount_paise").alias(told[0]), F.col("currency").alias(told[1]), "event_type", F.col("txn_id").alias(told[3]), F.col("net_effect_paise").alias(told[4]), "line_type", F.date_format("settled_at", "yyyy-MM-dd'T'HH:mm:ss").alias(told[6]))
        facts = {c: F.col(c) for c in told}
    claims = accepted.select(*_record(F.lit("match"), stage, ids, F.concat_ws("/", "pass_name", "tier"), F.col("confidence"), True, note, _struct(INPUTS, **pair, **facts), _struct(RESULT, settlement_id=pair["settlement_id"], event_id=pair["event_id"]), *place(0, stage, F.concat(F.lit("0"), F.col("detail_id")))))
    some = F.col("candidate_event_ids")
    held = run.abstentions.select(*_record(F.lit("abstain"), stage, F.array("detail_id", "settlement_id"), F.concat(F.col("pass_name"), F.lit("/abstain")), F.lit(0.0), True, F.col("reason"), _struct(INPUTS, settlement_id=pair["settlement_id"], detail_id=pair["detail_id"], candidate_event_ids=some, candidate_count=F.size(some)), _struct(RESULT, candidates=some), *place(0, stage, F.concat(F.lit("1"), F.col("detail_id")))))
    refused = F.concat(F.lit("claim refused by the runner: "), F.col("reason"))
    rejected = run.rejected.select(*_record(F.lit("no_action"), stage, ids, F.lit("runner/consumption"), F.lit(None), False, refused, _struct(INPUTS, **pair, proposed_by=F.col("pass_name")), F.lit(None).cast(T.StructType.fromDDL(RESULT)), *place(1, F.lit(""), F.concat_ws(" ", "event_id", "detail_id"))))
    given: dict[str, Column] = {"case_id": F.col("case_id")}
    if allocations is not None:
        own = allocations.groupBy("case_id").agg(F.array_sort(F.collect_set(F.array("event_id", "settlement_id"))).alias("own"))
        decided = decided.join(own, "case_id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<array<string>>")))
        given |= {"allocations": F.col("own"), "allocation_count": F.size("own")}
    unheard = F.raise_error(F.concat(F.lit("no action for outcome "), F.coalesce(F.col("outcome"), F.lit("null"))))
    action = F.coalesce(S.lookup(F.col("outcome"), ACTION_BY_OUTCOME, None), unheard)
    why = F.concat_ws("; ", F.col("outcome"), F.array_join("evidence", "; "))
    final = decided.select(*_record(action, F.lit(DISPOSITION), F.array("case_id"), F.lit("controller/disposition"), F.col("confidence"), True, why, _struct(INPUTS, **given), _struct(RESULT, outcome=F.col("outcome"), category=F.col("category")), *place(2, F.lit(""), F.col("case_id")), spoken=F.trim("outcome") != ""))
    rows = claims.unionByName(held).unionByName(rejected).unionByName(final)
    rows = rows.withColumn("decision_id", S.decision_id(F.col("action"), F.col("stage"), F.col("subject"))).withColumn("timestamp", F.lit(timestamp).cast("string"))
    wrong = _invalid(rows)
    rows = rows.withColumn("decision_id", F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(": "), F.coalesce("decision_id", F.lit("null"))))).otherwise(F.col("decision_id")))
    return rows.withColumn("body", codec.encoded(rows, *T.StructType.fromDDL(RECORD).names)).drop("spoken")


def decisions(sealed: DataFrame) -> DataFrame:
    """The typed fields of each record of a journal, beside its seq."""
    return sealed.select("seq", codec.decoded(F.col("body"), RECORD).alias("x")).select("seq", "x.*")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with seq from 1 by place; the sort is by ranges, and only the ranges' sizes meet in one place."""
    # computed once, as ranges are sampled and could fall otherwise when computed again
    dealt = kept(rows.repartitionByRange("place", "decision_id").withColumn("part", F.spark_partition_id()))
    dealt = dealt.withColumn("nth", F.row_number().over(W.partitionBy("part").orderBy("place", "decision_id")))
    sizes = dealt.groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("before"))
    return dealt.join(F.broadcast(before), "part").withColumn("seq", F.col("nth") + F.col("before")).drop("part", "nth", "before", "place")


def _invalid(rows: DataFrame) -> Column:
    """What is wrong with a decision, null where nothing is."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    subject = F.coalesce((F.size("subject") > 0) & F.forall("subject", lambda x: F.coalesce(x != "", F.lit(False))), F.lit(False))
    sure = F.col("confidence").isNull() | (F.col("confidence").between(0.0, 1.0) & ~F.isnan("confidence"))
    known = lambda c, some: F.coalesce(F.col(c).isin(*some), F.lit(False))
    why = F.when(~known("stage", STAGES), "no such stage").when(~known("action", ACTIONS), "no such action").when(~subject, "empty subject").when(~sure, "confidence out of range")
    for text in (c for c in ("rule", "reasoning") if c in rows.columns):
        some = F.coalesce("spoken", F.lit(False)) if text == "reasoning" and "spoken" in rows.columns else filled(text)
        why = why.when(~some, f"no {text}")
    return why.when(F.col("overridable").isNull(), "neither overridable nor not") if "overridable" in rows.columns else why


def validated(rows: DataFrame) -> DataFrame:
    """rows, once each has a known stage and action, a subject without empty ids, a confidence that is null or within 0 to 1, and, where rows have them, a rule, a reasoning and whether it is overridable."""
    if bad := rows.select(F.to_json(F.struct("action", "stage", "subject")).alias("row"), _invalid(rows).alias("why")).where("why is not null").limit(5).collect():
        raise ValueError("; ".join(f"{r.why}: {r.row}" for r in bad))
    return rows


def by_stage(rows: DataFrame, stage: str) -> DataFrame:
    return rows.where(F.col("stage") == stage)


def by_subject(rows: DataFrame, *ids: str) -> DataFrame:
    """Decisions on exactly these ids, in any order."""
    return rows.where(F.col("subject") == S.subject(F.array(*map(F.lit, ids))))


def get(rows: DataFrame, decision_id: str) -> DataFrame:
    return rows.where(F.col("decision_id") == decision_id)


def enriched(run: LadderRun, batch: Batch) -> DataFrame:
    """Accepted claims beside what they join: the event's amount, currency, kind, transaction, status and day, the line's kind, gross and net effect and time, and the days between."""
    events = batch.ledger.select("event_id", "event_type", "txn_id", "amount_paise", "currency", "status", F.to_date("created_at").alias("created_on"))
    lines = batch.detail.select("detail_id", "line_type", "gross_effect_paise", "net_effect_paise", "settled_at", F.to_date("settled_at").alias("settled_on"))
    both = run.accepted.join(events, "event_id", "left").join(lines, "detail_id", "left")
    return both.withColumn("days", F.datediff("settled_on", "created_on"))


def seal(rows: DataFrame, link: int = LINK) -> DataFrame:
    """(seq, decision_id, body, previous_hash, record_hash), written: each hash takes in the one before.

    A chain is a sequence by nature.  Ranges of seq of about `link` records each are
    hashed one after another, each by a task that sorts its own range and gives its
    last hash only; then all ranges are hashed again side by side, each from the last
    hash before it.  A decision_id that repeats is refused.
    """
    rows = kept(rows.select(F.col("seq").cast("long"), "decision_id", "body"))
    if twice := duplicates(rows).limit(5).collect():
        raise ValueError("decisions recorded twice: " + ", ".join(r.decision_id for r in twice))
    # written, as ranges are sampled and could fall otherwise when computed again
    ranges = max(1, -(-rows.count() // link))
    dealt = kept(rows.repartitionByRange(ranges, "seq").withColumn("link", F.spark_partition_id()), "link")
    links = [r.link for r in dealt.select("link").distinct().orderBy("link").collect()]
    order, heads, last = ("seq", "decision_id"), {}, GENESIS
    for n in links:
        heads[n] = last
        if n != links[-1]:
            own = dealt.where(F.col("link") == n).select(*order, "body").coalesce(1).sortWithinPartitions(*order)
            last = own.select("body").mapInArrow(_last_hash(last), "last string").first()["last"]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, GENESIS
        for batch in batches:
            before, after = [], []
            for n, body in zip(batch.column("link").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if n != at:
                    at, last = n, heads[n]
                before.append(last)
                last = hashlib.sha256((last + body).encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("seq", "decision_id", "body")), pa.array(before, pa.string()), pa.array(after, pa.string())], ["seq", "decision_id", "body", "previous_hash", "record_hash"])

    sorted_ = dealt.repartition(max(1, len(links)), "link").sortWithinPartitions("link", *order)
    return kept(sorted_.mapInArrow(chain, "seq bigint, decision_id string, body string, previous_hash string, record_hash string"))


def _last_hash(last: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The hash after all bodies of a task, from the hash before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = last
        for batch in batches:
            for body in batch.column("body").to_pylist():
                at = hashlib.sha256((at + body).encode()).hexdigest()
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.string())], ["last"])

    return run


def breaks(sealed: DataFrame) -> DataFrame:
    """Records whose hash, or whose link to the record before, is wrong; each is judged apart."""
    before = sealed.select((F.col("seq") + 1).alias("seq"), F.col("record_hash").alias("expected"))
    rows = sealed.join(before, "seq", "left").withColumn("expected", F.coalesce("expected", F.when(F.col("seq") == 1, F.lit(GENESIS))))
    resealed = F.sha2(F.concat("previous_hash", "body"), 256)
    return rows.select("seq", "decision_id", F.when(~F.col("expected").eqNullSafe(F.col("previous_hash")), "link").when(resealed != F.col("record_hash"), "record").alias("broken")).where("broken is not null")


def verify(sealed: DataFrame) -> DataFrame:
    if bad := breaks(sealed).orderBy("seq").limit(5).collect():
        raise Tampered(", ".join(f"{r.seq} ({r.broken})" for r in bad))
    return sealed


def duplicates(rows: DataFrame) -> DataFrame:
    """decision_ids that occur twice or more, which a journal may not hold."""
    return rows.groupBy("decision_id").count().where("count > 1")


def write(sealed: DataFrame, path: str) -> None:
    """JSON lines in order, in parts that follow one another by their names."""
    sealed.orderBy("seq").select(F.to_json(F.struct("body", "previous_hash", "record_hash", "seq"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(seq, decision_id, body, previous_hash, record_hash) of a journal's files, once their hashes follow; decisions() gives the typed fields."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.from_json("value", "body string, previous_hash string, record_hash string, seq bigint").alias("x")).select("x.*")
    return verify(lines.withColumn("decision_id", F.get_json_object("body", "$.decision_id")))


def found(spark: SparkSession, root: str, name: str = "audit.jsonl") -> list[str]:
    """The journals of that name in a folder and those below it, in order: files, or folders of parts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    at = F.regexp_extract("path", rf"^(.*/{re.escape(name)})(/[^/]*)?$", 1)
    return [r.at for r in files.select(at.alias("at")).where("at <> ''").distinct().orderBy("at").collect()]


def record(run: LadderRun, decided: DataFrame, path: str, batch: Batch | None = None, allocations: DataFrame | None = None, timestamp: str | None = None) -> DataFrame:
    """Builds, numbers, seals and writes the journal of a run in one call; returns it as it was sealed."""
    sealed = seal(numbered(build(run, decided, batch, allocations, timestamp)))
    write(sealed, path)
    return sealed


def effective(decisions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Decisions with the overrides laid over: (decision_id, action, reason) replaces the action where allowed."""
    laid = overrides.select("decision_id", F.col("action").alias("new_action"), F.col("reason").alias("override_reason"))
    return decisions.join(laid, "decision_id", "left").withColumn("effective_action", F.when(F.col("overridable"), F.coalesce("new_action", "action")).otherwise(F.col("action")))


def refused_overrides(decisions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides of unknown or fixed decisions, and second ones of a decision, with why."""
    known = decisions.select("decision_id", "overridable")
    n = overrides.groupBy("decision_id").agg(F.count("*").alias("n"))
    why = F.when(F.col("overridable").isNull(), "unknown decision").when(~F.col("overridable"), "not overridable").when(F.col("n") > 1, "duplicate")
    return n.join(known, "decision_id", "left").select("decision_id", why.alias("why")).where("why is not null")


def summary(decisions: DataFrame) -> DataFrame:
    """Counts by stage, by action and by confidence band."""
    rows = decisions.withColumn("band", S.confidence_band(F.col("confidence")))
    parts = [rows.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("label")).agg(F.count("*").alias("n")) for kind, c in (("stage", "stage"), ("action", "action"), ("band", "band"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
