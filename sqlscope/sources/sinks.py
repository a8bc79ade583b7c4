"""Writers of findings: JSON, baselines, and text for consoles and CI annotations. HTML is in html_report.py.

Texts are made from the top of a ranking, never from all findings.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlscope.engine import AuditResult
from sqlscope.operators import reports


class Reporter(Protocol):
    def write(self, result: AuditResult, path: str) -> None: ...


def json_lines(issues: DataFrame) -> DataFrame:
    """One JSON text per finding."""
    return issues.select(F.to_json(F.struct(*issues.columns), {"ignoreNullFields": "false"}).alias("value"))


def report_json(result: AuditResult) -> DataFrame:
    """One JSON text per test: its summary and its findings by bucket."""
    keys = ["run_id", "test_class", "test_name"]
    fields = ["code", "severity", "query", "table_name", "column_name", "detail"]
    per = result.issues.groupBy(*keys).agg(*[F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.struct(*fields)))).alias(b) for b in ("confirmed", "info", "acknowledged")])
    j = result.summary.join(per, keys, "left_outer")
    return j.select(F.to_json(F.struct(*j.columns)).alias("value"))


def write_json(result: AuditResult, path: str) -> None:
    json_lines(result.issues).write.mode("overwrite").text(path)


def baseline_lines(issues: DataFrame, by: str = "", reason: str = "") -> DataFrame:
    text = [F.coalesce(c, F.lit("")) for c in ("code", "table_name", "column_name")]
    return issues.select(*[c.alias(n) for c, n in zip(text, "abc", strict=True)]).distinct().orderBy("a", "b", "c").select(F.concat_ws("|", "a", "b", "c", F.lit(by), F.lit(reason)).alias("value"))


def count_lines(counts: DataFrame) -> DataFrame:
    names = ["test_class", "test_name", "selects", "inserts", "updates", "deletes", "total"]
    return counts.orderBy("test_class", "test_name").select(F.concat_ws("|", *[F.col(n).cast("string") for n in names]).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """A baseline file: one part, as people edit it."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def _clean(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def annotations(issues: DataFrame) -> DataFrame:
    """CI annotation lines, one per finding."""
    level = F.when(F.col("severity") == "ERROR", "error").when(F.col("severity") == "WARNING", "warning").otherwise("notice")
    place = F.concat_ws(".", "table_name", "column_name")
    return issues.select(F.concat(F.lit("::"), level, F.lit(" title="), "code", F.lit("::"), _clean(F.concat_ws(" ", place, "query"))).alias("value"))


def step_summary(result: AuditResult, k: int = 5) -> str:
    rows = reports.top(result.issues, k).collect()  # k rows
    lines = ["| rank | finding | where | count | score |", "|-|-|-|-|-|"]
    lines += [f"| {r['rank']} | {r.code} | {r.table_name or ''}.{r.column_name or ''} | {r.frequency} | {r.score} |" for r in rows]
    return "\n".join(lines)


def console(result: AuditResult, per_code: int = 3, k: int = 5) -> str:
    """Text for a terminal: the top of the ranking, with up to ``per_code`` statements each."""
    top = reports.top(result.issues, k)
    shown = result.issues.join(F.broadcast(top.select("code", "rank").groupBy("code").agg(F.min("rank").alias("rank"))), "code")
    some = shown.groupBy("rank", "code", "severity").agg(F.slice(F.array_sort(F.collect_set(F.substring(F.coalesce("query", F.lit("")), 1, 120))), 1, per_code).alias("examples"), F.count(F.lit(1)).alias("n"))
    out = []
    for r in some.orderBy("rank", "severity").limit(3 * k).collect():  # k codes of three severities at most
        out.append(f"{r.severity:8}{r.code}  x{r.n}")
        out += [f"        {q}" for q in r.examples]
    return "\n".join(out)


class JsonReporter:
    """One JSON text per test."""

    def write(self, result: AuditResult, path: str) -> None:
        report_json(result).write.mode("overwrite").text(path)


class ConsoleReporter:
    """The console's text, to the terminal or (where a path is given) to a file that the driver writes."""

    def write(self, result: AuditResult, path: str = "") -> None:
        text = console(result)
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text)


class AnnotationReporter:
    """CI annotation lines of confirmed findings."""

    def write(self, result: AuditResult, path: str) -> None:
        annotations(result.issues.filter("bucket = 'confirmed'")).write.mode("overwrite").text(path)
