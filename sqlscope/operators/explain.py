"""Findings from query plans: distinct SELECT patterns whose tables are registered, planned by Catalyst."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlscope.schema import TEST

_SCHEMA = "nsql string, query string, code string, severity string, table_name string, detail string"


def facts(plan: str) -> list[tuple[str, str, str | None]]:
    """(code, severity, table) told by a physical plan's text."""
    out: list[tuple[str, str, str | None]] = []
    scans = re.findall(r"FileScan \w+ (\S*?)\[.*?PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)
    if any(not parts and not pushed for _, parts, pushed in scans):
        out.append(("full-scan", "WARNING", next((t.rsplit(".", 1)[-1] or None for t, parts, pushed in scans if not parts and not pushed), None)))
    if re.search(r"\bSort \[|TakeOrderedAndProject", plan):
        out.append(("filesort", "INFO", None))
    if re.search(r"\bExchange\b|HashAggregate|BroadcastExchange", plan):
        out.append(("temporary-table", "INFO", None))
    return out


def explain(spark: SparkSession, log: DataFrame) -> DataFrame:
    """``log``: rows (seq, sql, op, nsql). Plans the first statement of each SELECT pattern; placeholders become 1,
    statements that Spark can't plan are left out. Planning runs on the driver, partition by partition of the patterns."""
    found = []
    firsts = log.filter("op = 'SELECT'").groupBy("nsql").agg(F.min(F.struct("seq", "sql")).alias("first")).select("nsql", "first.sql").orderBy("nsql")
    for r in firsts.toLocalIterator():
        try:
            plan = spark.sql(re.sub(r"\?", "1", r.sql))._jdf.queryExecution().sparkPlan().toString()
        except PySparkException:
            continue
        found += [(r.nsql, r.sql, code, severity, table, code) for code, severity, table in facts(plan)]
    return spark.createDataFrame(found, _SCHEMA)


def findings(f: DataFrame, plans: DataFrame) -> DataFrame:
    """``plans`` (rows of explain(): nsql, code, severity, table_name, detail) as findings of each test that runs their pattern. From one row per pattern."""
    none = F.lit(None).cast("string")
    got = f.filter("op = 'SELECT'").select(*TEST, "nsql", F.col("sql").alias("query")).join(plans.select("nsql", "code", "severity", "table_name", "detail"), "nsql")
    return got.select(*TEST, "code", "severity", "query", "table_name", none.alias("column_name"), "detail", none.alias("source_location"))
