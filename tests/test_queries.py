"""The driver's queries against their DuckDB SQL on the smallest tables, a sample of each kind; sinks and streams."""

import inspect
from functools import partial

import duckdb
import pytest

import __spark_entry__ as entry
from sqlscope.plans import queries as audit

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(cursor_rows):
    return sorted((tuple(r) for r in cursor_rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def same(spark, name, query, sql):
    df = query(spark, SF)
    names = sorted(df.columns)
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = c.sql(f"SELECT {', '.join(names)} FROM ({sql}) q").fetchall()
    assert rows(df.select(*names).collect()) == rows(wanted), name


@pytest.fixture(scope="module")
def shared(spark):
    """The features of the log, and the findings of all rules, computed once for the queries that start from them."""
    features = audit._features(spark, SF).persist()
    told = audit._told(spark, SF).persist()
    yield features, told
    told.unpersist()
    features.unpersist()


@pytest.mark.parametrize("name", sorted(k for k in audit.oracle_sql() if not k.startswith("text_")))
def test_audit_queries(spark, shared, monkeypatch, name):
    monkeypatch.setattr(audit, "_features", lambda *_: shared[0])
    monkeypatch.setattr(audit, "_told", lambda *_: shared[1])
    query = audit.queries()[name]
    if "found" in inspect.signature(query).parameters:
        query = partial(query, found=lambda *_: shared[1])
    same(spark, name, query, audit.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(k for k in audit.oracle_sql() if k.startswith("text_")))
def test_text_queries(spark, name):
    same(spark, name, audit.queries()[name], audit.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_rule_has_findings(spark):
    codes = {r.code for r in audit.full_audit(spark, "/root/testdata/sf0.01").collect()}
    expected = {k.removeprefix("rule_").replace("_", "-") for k in audit.queries() if k.startswith("rule_")}
    assert expected <= codes


def test_sinks(spark, tmp_path):
    import json

    from sqlscope import engine
    from sqlscope.plans import workload
    from sqlscope.sources import files, sinks

    result = engine.audit(workload.query_log(spark, SF), workload.index_catalog(spark))
    sinks.write_json(result, str(tmp_path / "json"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert lines and all("code" in json.loads(x) for x in lines)
    sinks.write_lines(sinks.baseline_lines(result.issues, "x", "y"), str(tmp_path / "base"))
    base = files.read_issue_baseline(spark, str(tmp_path / "base"))
    again = engine.audit(workload.query_log(spark, SF), workload.index_catalog(spark), baseline=base)
    assert again.issues.filter("bucket <> 'acknowledged'").count() == 0
    assert sinks.console(result) and "rank" in sinks.step_summary(result)


def test_stream(spark, tmp_path):
    from sqlscope.plans import workload
    from sqlscope.schema import QUERY_LOG, conform
    from sqlscope.streaming import audit as stream

    conform(workload.query_log(spark, SF), QUERY_LOG).write.parquet(str(tmp_path / "log"))
    s = stream.read_stream(spark, str(tmp_path / "log"))
    q = stream.findings(s, workload.index_catalog(spark)).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select count(distinct code) n from found").first().n > 20
    q = stream.repeated_patterns(s, window="40 days").writeStream.format("memory").queryName("often").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select max(n) n from often").first().n >= 3
