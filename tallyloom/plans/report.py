"""Reports of a reconciled directory: text for a console, a static HTML page, and the command line.

Only counts, sums and the head of the queue reach the driver.
"""

from __future__ import annotations

import argparse
import html
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import baselines, journal, scoring, verdicts
from tallyloom.operators.ladder import DEFAULT, JOIN_ONLY
from tallyloom.sources.batch import load_answer_key, load_raw

THRESHOLDS = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
Table = tuple[str, list[str], list[list[str]]]


def table(title: str, df: DataFrame, most: int = 50) -> Table:
    """A small DataFrame's head as text."""
    return title, df.columns, [["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in df.limit(most).collect()]


def panel(r: verdicts.Reconciliation, key: tuple[DataFrame, DataFrame] | None = None, head: int = 10) -> list[Table]:
    """The tables of a report; with an answer key, its scores too."""
    q = verdicts.queue(r.verdicts, r.cases)
    out = [
        table("Outcomes", r.verdicts.groupBy("outcome").agg(F.count("*").alias("cases"), F.sum("exposure_paise").alias("exposure_paise")).orderBy("outcome")),
        table("Passes", r.run.counters.orderBy("pass_name", "counter")),
        table("Queue by category", verdicts.by_category(q).orderBy(F.desc("exposure_paise"), "category")),
        table("Head of the queue", verdicts.top(q, head).select("case_id", "outcome", "category", "exposure_rupees", "action"), head),
    ]
    if key:
        cases, pairs = key
        want = verdicts.bridge(cases).join(pairs, "settlement_id").select("case_id", "event_id", "settlement_id")
        rows = scoring.judged(cases, r.verdicts, want, r.allocations).cache()
        out += [table("By scenario", scoring.by_scenario(rows).orderBy("scenario")), table("Allocations", scoring.allocation_scores(rows)), table("Categories", scoring.one_vs_rest(rows).orderBy("label")), table("Confusion", scoring.confusion(rows).orderBy("expected", "reported")), table("Abstentions", scoring.abstentions(rows)), table("Idle cases", scoring.idle_false_positives(rows)), table("Curve", scoring.curve(rows, THRESHOLDS).orderBy("threshold"))]
    return out


def as_text(tables: Sequence[Table]) -> str:
    lines = []
    for title, columns, rows in tables:
        width = [max(len(x) for x in col) for col in zip(columns, *rows, strict=True)]
        lines += ["", title, *("  ".join(v.ljust(n) for v, n in zip(r, width, strict=True)).rstrip() for r in (columns, *rows))]
    return "\n".join(lines[1:])


def as_html(title: str, tables: Sequence[Table]) -> str:
    cell = lambda tag, v: f"<{tag}>{html.escape(v)}</{tag}>"
    body = "".join(f"{cell('h2', name)}<table><tr>{''.join(cell('th', c) for c in columns)}</tr>{''.join('<tr>' + ''.join(cell('td', v) for v in r) + '</tr>' for r in rows)}</table>" for name, columns, rows in tables)
    return f'<!doctype html><html><head><meta charset="utf-8">{cell("title", title)}<style>td,th{{padding:2px 8px;text-align:left}}</style></head><body>{cell("h1", title)}{body}</body></html>'


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("directory")
    p.add_argument("--score", action="store_true", help="score against the directory's answer key")
    p.add_argument("--join-only", action="store_true", help="run the exact join alone")
    p.add_argument("--queue", help="write the queue as CSV to this folder")
    p.add_argument("--html", help="write the report to this file")
    p.add_argument("--compare", action="store_true", help="set the result beside the baselines, by the directory's answer key")
    p.add_argument("--verify", action="store_true", help="the directory is a journal: check its hashes and print its summary")
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.verify:
        try:
            records = journal.read(spark, a.directory)
        except journal.Tampered as e:
            print(f"broken: {e}")
            return 1
        body = F.from_json("body", "stage string, action string, confidence double")
        print(as_text([table("Journal", journal.summary(records.select(body.alias("x")).select("x.*")).orderBy("kind", "label"))]))
        return 0
    began = time.monotonic()
    r = verdicts.reconcile(spark, a.directory, JOIN_ONLY if a.join_only else DEFAULT)
    tables = panel(r, load_answer_key(spark, a.directory) if a.score else None)
    took, records = time.monotonic() - began, verdicts.record_count(r.batch)
    tables.insert(0, ("Run", ["records", "seconds", "records_a_second"], [[str(records), f"{took:.1f}", f"{records / took:.0f}"]]))
    if a.compare:
        key, pairs = load_answer_key(spark, a.directory)
        agent = (r.verdicts, r.run.accepted.select("settlement_id", "event_id", "detail_id"))
        tables.append(table("Comparison", baselines.compare(load_raw(spark, a.directory), r.cases, key, pairs, agent)))
    print(as_text(tables))
    if a.queue:
        verdicts.write_queue(verdicts.queue(r.verdicts, r.cases), a.queue)
    if a.html:
        with open(a.html, "w", encoding="utf-8") as f:
            f.write(as_html("Reconciliation", tables))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
