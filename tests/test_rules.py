"""Rules on single statements: which codes a statement gets, and which it must not get."""

import datetime

import pytest

from sqlscope import engine
from sqlscope.config import AuditConfig
from sqlscope.schema import ISSUE, QUERY_LOG
from sqlscope.sources import catalog as C

CATALOG = [
    ("users", "PRIMARY", "id", 1, False, 1000), ("users", "uk_email", "email", 1, False, 1000), ("users", "ix_status_created", "status", 1, True, 3), ("users", "ix_status_created", "created_at", 2, True, 900),
    ("orders", "PRIMARY", "id", 1, False, 5000), ("orders", "ix_user", "user_id", 1, True, 1000),
]

CASES = [
    ("SELECT * FROM users WHERE id = 1", {"select-all"}),
    ("SELECT id FROM users WHERE id = 1", set()),
    ("SELECT id FROM users WHERE email = 'a' ", set()),
    ("SELECT id FROM users WHERE nick = 'a'", {"missing-where-index", "unbounded-result-set"}),
    ("SELECT id FROM users WHERE created_at > 5 AND id = 3", {"composite-index-leading"}),
    ("SELECT u.id FROM users u JOIN orders o ON o.buyer = u.id WHERE u.id = 1", {"missing-join-index"}),
    ("SELECT id FROM orders WHERE LOWER(note) = 'x' AND id = 1", {"where-function"}),
    ("UPDATE users SET nick = 'x'", {"update-without-where"}),
    ("DELETE FROM users WHERE nick = 'x'", {"dml-without-index"}),
    ("SELECT id FROM users WHERE id NOT IN (SELECT user_id FROM orders WHERE id = 4)", {"not-in-subquery"}),
    ("SELECT id FROM users WHERE id = 5 FOR UPDATE", {"for-update-no-timeout"}),
    ("SELECT id FROM orders WHERE user_id = 5 FOR UPDATE NOWAIT", {"for-update-non-unique"}),
    ("INSERT INTO orders (id) VALUES (1)", set()),
    ("INSERT INTO orders VALUES (1)", {"implicit-columns-insert"}),
    ("SELECT id FROM users WHERE id = 1 AND name = 'SELECT * FROM x'", set()),
    ("SELECT COUNT(*) FROM users", {"count-star-no-where"}),
    ("SELECT id FROM users WHERE deleted_at = NULL AND id = 2", {"null-comparison"}),
    ("SELECT id FROM users, orders", {"cartesian-join", "implicit-join", "unbounded-result-set"}),
]


def log_of(spark, statements, ms=1, phase="TEST"):
    at = datetime.datetime(2024, 1, 1)
    rows = [("r", "C", f"t{k}", k, s, ms * 1_000_000, at, None, phase) for k, s in enumerate(statements)]
    return spark.createDataFrame(rows, QUERY_LOG)


@pytest.fixture(scope="module")
def found(spark):
    catalog = C.load(spark.createDataFrame(CATALOG, "table_name string, index_name string, column_name string, seq_in_index int, non_unique boolean, cardinality bigint"))
    rows = engine.audit(log_of(spark, [s for s, _ in CASES]), catalog).issues.collect()
    by: dict[str, set] = {}
    for r in rows:
        by.setdefault(r.test_name, set()).add(r.code)
    return by


@pytest.mark.parametrize("k", range(len(CASES)))
def test_codes(found, k):
    sql, expected = CASES[k]
    quiet = {"covering-index-opportunity"}
    assert found.get(f"t{k}", set()) - quiet == expected, sql


def empty_catalog(spark):
    return spark.createDataFrame([], "table_name string, index_name string, column_name string, seq_in_index int, non_unique boolean, cardinality bigint")


def test_empty_log_and_catalog(spark):
    result = engine.audit(spark.createDataFrame([], QUERY_LOG), empty_catalog(spark))
    assert result.issues.count() == 0 and result.summary.count() == 0
    assert set(ISSUE) <= set(result.issues.columns)


def test_catalog_rules_are_silent_without_a_catalog(spark):
    issues = engine.audit(log_of(spark, ["SELECT id FROM users WHERE nick = 'a' LIMIT 1"]), empty_catalog(spark)).issues
    assert issues.filter("code like 'missing%'").count() == 0


def test_setup_statements_count_in_the_summary_only(spark):
    log = log_of(spark, ["SELECT * FROM users WHERE id = 1"], phase="SETUP")
    result = engine.audit(log, empty_catalog(spark))
    assert result.issues.count() == 0 and result.summary.first().total_queries == 1
    issues = engine.audit(log, empty_catalog(spark), AuditConfig(include_setup=True)).issues.collect()
    assert {r.code for r in issues} == {"select-all", "unbounded-result-set"}


def test_rules_of_users(spark):
    from sqlscope.operators.catalog_rules import issue

    engine.add_rule("short", lambda c: issue(c.features.filter("length(sql) < 10"), "short-statement", "INFO", table="t", column=None))
    try:
        got = engine.audit(log_of(spark, ["SELECT 1"]), empty_catalog(spark)).issues
        assert [r.code for r in got.collect()] == ["short-statement"]
    finally:
        engine.EXTRA.clear()


def test_order_of_the_log_does_not_matter(spark):
    statements = [s for s, _ in CASES] * 4
    log = log_of(spark, statements)
    a = engine.audit(log, empty_catalog(spark)).issues.select("code", "query", "test_name").collect()
    b = engine.audit(log.orderBy("sql", "seq"), empty_catalog(spark)).issues.select("code", "query", "test_name").collect()
    assert sorted(a) == sorted(b)


def test_return_types(spark):
    at = datetime.datetime(2024, 1, 1)
    stack = "jdk.proxy2.$Proxy77.{}:12\napp.Service.run:3"
    sql = ["SELECT a FROM t WHERE b > 1", "SELECT a FROM t WHERE c > 1", "SELECT a FROM u WHERE c > 1"]
    rows = [("r", "C", "t", k, s, 0, at, stack.format(m), "TEST") for k, (s, m) in enumerate(zip(sql, ["findOne", "findAll", "other"], strict=True))]
    types = spark.createDataFrame([("findOne", "OPTIONAL"), ("findAll", "COLLECTION")], "method string, return_type string")
    issues = engine.audit(spark.createDataFrame(rows, QUERY_LOG), empty_catalog(spark), return_types=types).issues
    got = {(r.query.split()[3], r.severity) for r in issues.filter("code = 'unbounded-result-set'").collect()}
    assert got == {("t", "INFO"), ("u", "WARNING")}
