"""Reports, gates and captures on small logs."""

import datetime
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sqlscope import engine
from sqlscope.config import AuditConfig
from sqlscope.operators import reports
from sqlscope.schema import QUERY_LOG
from sqlscope.sources import files, html_report, sinks

from test_rules import empty_catalog, log_of

STATEMENTS = ["SELECT * FROM users WHERE id = 1"] * 4 + ["SELECT <b>x FROM t ORDER BY RAND()", "DELETE FROM t"]


@pytest.fixture(scope="module")
def result(spark):
    log = log_of(spark, STATEMENTS).withColumns({"test_name": F.lit("t"), "test_class": F.when(F.col("seq") < 4, "a/B").otherwise("C")})
    found = engine.audit(log, empty_catalog(spark))
    issues = spark.createDataFrame(found.issues.collect(), found.issues.schema)  # the audit runs once for all tests
    found.release()
    return replace(found, issues=issues)


def test_html_pages_and_merge(result, tmp_path):
    other = replace(result, **{n: getattr(result, n).withColumn("run_id", F.lit("s")) for n in ("issues", "summary", "counts", "log")})
    result = html_report.merged([result, other])
    html_report.HtmlReporter(full=1).write(result, str(tmp_path / "out"))
    files_ = {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}
    index = files_.pop("index.html")
    assert len(files_) == 2 and all(f'href="{n}"' in index for n in files_)
    assert "order-by-rand" in index and "select-all" in index and "users" in index
    c = next(t for n, t in files_.items() if n.startswith("C-"))
    b = next(t for n, t in files_.items() if n.startswith("a_B-"))
    assert "&lt;b&gt;x" in c and "<b>x" not in c and "update-without-where" in c
    assert ("left out" in b) != ("left out" in c) and "r t" in c and "s t" in c


def test_reporters_write(spark, result, tmp_path, capsys):
    sinks.JsonReporter().write(result, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).count() == 2
    sinks.AnnotationReporter().write(result, str(tmp_path / "a"))
    assert spark.read.text(str(tmp_path / "a")).filter("value like '::error%order-by-rand%'").count() == 1
    sinks.ConsoleReporter().write(result, str(tmp_path / "c"))
    sinks.ConsoleReporter().write(result)
    assert "order-by-rand" in (tmp_path / "c").read_text() and "order-by-rand" in capsys.readouterr().out
    assert "| 1 |" in sinks.step_summary(result)


def test_gates(result):
    ask = lambda config=AuditConfig(), **more: {(r.test_class, r.gate, r.subject, r.value, r.limit) for r in reports.gates(result.issues, result.log, config, **more).collect()}  # noqa: E731, B008
    every = ask(budget=3, n_plus_one=4)
    assert ("a/B", "budget", "statements", 4, 3) in every and ("a/B", "n-plus-one", "1 patterns", 4, 4) in every
    assert ("C", "finding", "order-by-rand", 1, None) in every and not any(r[0] == "C" and r[1] != "finding" for r in every)
    assert ask(AuditConfig(fail_on=frozenset({"order-by-rand"}))) == {("C", "finding", "order-by-rand", 1, None)}
    # the nearest setting decides whether findings fail a test
    assert ask(fail=(None, False, True)) == set() and ask(fail=(None, None)) and ask(fail=(True, False))
    assert ask(fail=(False,), budget=100) == set()


def test_dedup_keeps_ten_of_many_tests(spark):
    rows = [("r", f"C{k:03d}", "t", "select-all", "ERROR" if k == 77 else "INFO", "select 1", "T", None, "x", None) for k in range(200)] * 2
    names = "run_id test_class test_name code severity query table_name column_name detail source_location".split()
    got = reports.deduplicate(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))).collect()
    assert len(got) == 1 and got[0].occurrences == 400 and got[0].severity == "ERROR"
    assert got[0].affected_tests == [f"C{k:03d}.t" for k in range(10)]


def test_capture_numbers_statements(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [("r", "C", "t", seq, sql, 0, at + datetime.timedelta(seconds=s), None, "odd") for seq, sql, s in ((4, "a", 0), (None, "late", 200), (None, "b", 5), (None, "a", 5), (2, "first", 9), (None, " ", 1))]
    rows += [("r", "D", "t", None, "only", 0, None, None, "setup")]
    got = files.capture(spark.createDataFrame(rows, QUERY_LOG))
    assert [r.sql for r in got.filter("test_class = 'C'").orderBy("seq").collect()] == ["first", "a", "a", "b", "late"]
    assert got.filter("test_class = 'D'").first().seq == 0 and {r.phase for r in got.collect()} == {"TEST", "SETUP"}
    kept = files.capture(spark.createDataFrame(rows, QUERY_LOG), max_queries=2)
    assert sorted(r.sql for r in kept.collect()) == ["a", "first", "only"]


def test_entity_events(spark):
    stack = lambda *frames: "\n".join(frames)
    rows = [
        ("collection", "a.Team.members", "a.Team", 1, None),
        ("load", None, "a.User$HibernateProxy$x1", 2, stack("org.hibernate.proxy.pojo.bytebuddy.ByteBuddyInterceptor.intercept:9", "a.S.run:1")),
        ("load", None, "a.User", 3, stack("java.util.X.y:1", "org.springframework.data.R.findById:5", "a.S.run:1")),
        ("load", None, "a.User", 4, stack("a.Repo.findByIdAndName:2")),
        ("load", None, "a.User", None, stack("a.X$ByteBuddy$Z.get:1", "a.R.findById:5")),
    ]
    raw = spark.createDataFrame([("r", "C", "t", *r) for r in rows], "run_id string, test_class string, test_name string, event string, role string, entity string, entity_id long, stack_trace string").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    lazy, explicit = files.entity_events(raw)
    assert {(r.role, r.owner_entity, r.owner_id) for r in lazy.collect()} == {("a.Team.members", "a.Team", "1"), ("proxy:a.User", "a.User", "2"), ("proxy:a.User", "a.User", "null")}
    assert [(r.entity, r.entity_id, r.stack_trace) for r in explicit.collect()] == [("a.User", "3", "a.S.run:1")]
