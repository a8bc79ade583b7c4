"""Plan findings: one plan per SELECT pattern, whatever the number of its texts."""

from pyspark.sql import functions as F

from sqlscope.operators import explain, features
from sqlscope.plans import queries as audit

SF = "/root/testdata/sf0.001"


def log_of(spark, statements):
    return features.normalized(spark.createDataFrame(list(enumerate(statements)), "seq bigint, sql string"))


def test_every_pattern_is_planned_once(spark, tmp_path):
    spark.range(5).selectExpr("id as a", "id as b").write.parquet(str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("planned")
    many = [f"SELECT a FROM planned WHERE a = {k}" for k in range(1100)]
    grouped = "SELECT b, count(*) FROM planned GROUP BY b"
    log = log_of(spark, [*many, grouped, "SELECT b FROM planned WHERE b = ? ORDER BY b", "SELECT nothing FROM planned", "DELETE FROM planned"])
    found = {(r.query, r.code) for r in explain.explain(spark, log).collect()}
    # the texts of the first pattern sort before the others and outnumber any fixed number of plans
    assert found == {(grouped, "full-scan"), (grouped, "temporary-table"), ("SELECT b FROM planned WHERE b = ? ORDER BY b", "filesort")}


def test_query_reads_the_whole_log(spark, tmp_path):
    for name in ("orders", "customer", "part", "lineitem"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.read.parquet(f"{SF}/events.parquet").filter(F.col("event_id") > 300).write.parquet(str(tmp_path / "events.parquet"))
    rows = audit.explain_plans(spark, str(tmp_path)).collect()
    assert {r.code for r in rows} == {"full-scan", "filesort", "temporary-table"}
    patterns = spark.createDataFrame([(r.query, r.code) for r in rows], "sql string, code string")
    assert features.normalized(patterns).groupBy("nsql", "code").count().filter("count > 1").count() == 0


def test_plan_findings_pass_suppression_and_baseline(spark):
    import datetime

    from sqlscope import engine
    from sqlscope.config import AuditConfig
    from sqlscope.schema import INDEX_CATALOG, ISSUE_BASELINE, QUERY_LOG

    at = datetime.datetime(2024, 1, 1)
    sql = [("t1", "SELECT a FROM t WHERE a = 1 ORDER BY b"), ("t2", "SELECT a FROM t WHERE a = 2 ORDER BY b"), ("t2", "SELECT a FROM u")]
    log = spark.createDataFrame([("r", "C", t, k, s, 0, at, None, "TEST") for k, (t, s) in enumerate(sql)], QUERY_LOG)
    plans = [("select a from t where a = ? order by b", "filesort", "INFO", None, "x"), ("select a from u", "full-scan", "WARNING", "u", "x"), ("select a from u", "temporary-table", "INFO", None, "x")]
    plans = spark.createDataFrame(plans, "nsql string, code string, severity string, table_name string, detail string")
    baseline = spark.createDataFrame([("full-scan", "U", None, "ann", "x")], ISSUE_BASELINE)
    config = AuditConfig(suppress_issues=("temporary-table",), severity={"filesort": "ERROR"})
    issues = engine.audit(log, spark.createDataFrame([], INDEX_CATALOG), config, baseline, plans=plans).issues
    got = {(r.test_name, r.code, r.severity, r.query, r.bucket) for r in issues.filter("code in ('full-scan', 'filesort', 'temporary-table')").collect()}
    assert got == {("t1", "filesort", "ERROR", sql[0][1], "confirmed"), ("t2", "filesort", "ERROR", sql[1][1], "confirmed"), ("t2", "full-scan", "WARNING", sql[2][1], "acknowledged")}


def test_audits_hold_plan_findings(spark):
    assert {"full-scan", "filesort", "temporary-table"} <= {r.code for r in audit.flagship(spark, SF).collect()}
