"""An audit as HTML: an index, and a page per test class with its tests, findings and statements in order.

Pages are made where their rows are and written by the executors, so the folder must be one
that all of them reach. What a page lists is bounded; the index lists the classes with most findings.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlscope.engine import AuditResult
from sqlscope.operators import order, reports
from sqlscope.schema import TEST

STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .5em;text-align:left;vertical-align:top}.ERROR{color:#b00}.WARNING{color:#a60}"
BUCKETS = ("confirmed", "info", "acknowledged")


def merged(results: list[AuditResult]) -> AuditResult:
    """Several audits as one, for a report over all of them; their run_id tells them apart."""
    def every(name: str) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), [getattr(r, name) for r in results])

    return replace(results[0], issues=every("issues"), summary=every("summary"), counts=every("counts"), log=every("log"), held=tuple(x for r in results for x in r.held))


def _safe(c: str | Column) -> Column:
    c = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def _row(*cells: str | Column) -> Column:
    return F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td>"), _safe(c), F.lit("</td>"))], F.lit("</tr>"))


def _table(rows: Column, *heads: str) -> Column:
    head = "<table><tr>" + "".join(f"<th>{h}</th>" for h in heads) + "</tr>"
    return F.when(F.size(rows) > 0, F.concat(F.lit(head), F.array_join(rows, ""), F.lit("</table>"))).otherwise("<p>none</p>")


def file_of(test_class: str | Column) -> Column:
    """The page of a class: its name in plain characters, and a checksum that tells like names apart."""
    c = F.coalesce(F.col(test_class) if isinstance(test_class, str) else test_class, F.lit(""))
    return F.concat(F.substring(F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_"), 1, 80), F.lit("-"), F.lower(F.hex(F.crc32(c.cast("binary")))), F.lit(".html"))


def _gathered(rows: DataFrame, sort: tuple, most: int, name: str) -> DataFrame:
    """(test_class, name): up to ``most`` rows of each class in order."""
    nth = F.row_number().over(Window.partitionBy("test_class").orderBy(*sort))
    kept = rows.withColumn("nth", nth).filter(F.col("nth") <= most)
    return kept.groupBy("test_class").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "row"))), lambda x: x["row"]).alias(name))


def class_pages(result: AuditResult, full: int = 200, findings: int = 500, statements: int = 500) -> DataFrame:
    """(test_class, file, confirmed, info, acknowledged, tests, html) of each class. Statements are listed on the ``full`` pages with most findings."""
    name = F.concat_ws(" ", "run_id", "test_name")
    tests = result.summary.withColumn("row", _row("run_id", "test_name", "unique_patterns", "total_queries", (F.col("total_nanos") / 1_000_000).cast("decimal(20,1)")))
    tests = _gathered(tests, ("run_id", "test_name"), findings, "tests_rows")
    rank = reports.severity_rank(F.col("severity"))
    found = result.issues.withColumn("row", _row(name, "severity", "code", F.concat_ws(".", "table_name", "column_name"), "query", "detail", "bucket"))
    listed = _gathered(found, (F.col("bucket") != "confirmed", rank, "code", "run_id", "test_name", "query"), findings, "found_rows")
    counts = result.issues.groupBy("test_class").agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])
    pages = result.summary.groupBy("test_class").agg(F.count(F.lit(1)).alias("tests"))
    for other in (counts, tests, listed):
        pages = order.meet(pages, other, ("test_class",), "left_outer")
    pages = pages.na.fill(0, list(BUCKETS))
    first = pages.orderBy(F.desc("confirmed"), F.desc("info"), F.col("test_class").asc_nulls_first()).limit(full).select("test_class", F.lit(True).alias("full"))
    log = order.meet(result.log, first, ("test_class",))
    run = reports.timeline(log).filter(F.col("position") <= statements)
    run = run.withColumn("row", _row(name, "position", "nsql", "pattern_count"))
    pages = order.meet(order.meet(pages, first, ("test_class",), "left_outer"), _gathered(run, ("run_id", "test_name", "position"), statements, "run_rows"), ("test_class",), "left_outer")
    none = F.array().cast("array<string>")
    body = F.concat(
        F.lit(f"<!doctype html><meta charset=utf-8><style>{STYLE}</style><title>"), _safe("test_class"), F.lit("</title><p><a href=index.html>all classes</a></p><h1>"), _safe("test_class"), F.lit("</h1><h2>Tests</h2>"),
        _table(F.coalesce("tests_rows", none), "run", "test", "patterns", "statements", "ms"), F.lit("<h2>Findings</h2>"),
        _table(F.coalesce("found_rows", none), "test", "severity", "finding", "where", "statement", "detail", "bucket"), F.lit("<h2>Statements</h2>"),
        F.when(F.coalesce("full", F.lit(False)), _table(F.coalesce("run_rows", none), "test", "nr", "pattern", "times")).otherwise("<p>left out: other classes have more findings</p>"),
    )
    return pages.select("test_class", file_of("test_class").alias("file"), *BUCKETS, "tests", body.alias("html"))


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _writer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(path)
        for b in batches:
            for file, text in zip(b["file"], b["html"], strict=True):
                with system.open_output_stream(f"{folder}/{file}") as out:
                    out.write(text.as_py().encode())
            yield b.select([n for n in b.schema.names if n != "html"])

    return run


def _listed(title: str, heads: str, rows: list) -> str:
    cell = lambda v: f"<td>{html.escape('' if v is None else str(v))}</td>"
    return f"<h2>{title}</h2><table><tr>" + "".join(f"<th>{h}</th>" for h in heads.split()) + "</tr>" + "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows) + "</table>"


@dataclass(frozen=True)
class HtmlReporter:
    """Writes index.html and the pages of classes to a folder. ``top``: rows of each table of the index."""

    top: int = 50
    classes: int = 1000
    full: int = 200

    def write(self, result: AuditResult, path: str) -> None:
        system, folder = _open(path)
        system.create_dir(folder, recursive=True)
        result = replace(result, issues=result.issues.persist(), log=result.log.persist())  # read several times
        pages = class_pages(result, self.full)
        written = pages.mapInArrow(_writer(path), "test_class string, file string, confirmed long, info long, acknowledged long, tests long").persist()
        totals = written.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in (*BUCKETS, "tests")]).first()
        rows = written.orderBy(F.desc("confirmed"), F.desc("info"), F.col("test_class").asc_nulls_first()).limit(self.classes).collect()
        links = "".join(f'<tr><td><a href="{html.escape(r.file)}">{html.escape(r.test_class or "")}</a></td><td>{r.tests}</td><td>{r.confirmed}</td><td>{r.info}</td><td>{r.acknowledged}</td></tr>' for r in rows)
        ranking = reports.top(result.issues, self.top).select("rank", "code", "severity", "table_name", "column_name", "frequency", "score").collect()
        often = reports.pattern_frequency(result.log).orderBy(F.desc("executions"), "nsql").limit(self.top).collect()
        tables = reports.table_frequency(result.log).orderBy(F.desc("accesses"), "table_name").limit(self.top).collect()
        text = f"<!doctype html><meta charset=utf-8><style>{STYLE}</style><title>SQL audit</title><h1>SQL audit</h1>"
        text += _listed("Summary", "classes tests confirmed info acknowledged", [(totals.n, totals.tests or 0, *[totals[b] or 0 for b in BUCKETS])])
        text += _listed("Findings", "rank finding severity table column count score", ranking)
        text += f"<h2>Classes</h2><table><tr><th>class</th><th>tests</th><th>confirmed</th><th>info</th><th>acknowledged</th></tr>{links}</table>"
        text += _listed("Patterns", "pattern executions", often) + _listed("Tables", "table accesses", tables)
        with system.open_output_stream(f"{folder}/index.html") as out:
            out.write(text.encode())
        for x in (written, result.issues, result.log):
            x.unpersist()
