"""Mergeable queries on SELECTs with joins, subqueries and unions, against groups told by hand."""

from sqlscope.plans import queries as audit
from sqlscope.plans import workload
from sqlscope.schema import QUERY_LOG

#: (group, statement): statements of one group are alike in table, select list and joins.
STATEMENTS = [
    ("join", "SELECT o.id FROM orders o JOIN customer c ON o.c = c.id WHERE o.id = 1"),
    ("join", "SELECT o.id FROM orders o JOIN customer c ON o.c = c.id WHERE o.day = 1"),
    ("join", "SELECT o.id FROM orders o JOIN customer c ON o.c = c.id WHERE c.id = 1"),
    ("other condition", "SELECT o.id FROM orders o JOIN customer c ON o.payer = c.id WHERE o.id = 1"),
    ("other kind", "SELECT o.id FROM orders o LEFT JOIN customer c ON o.c = c.id WHERE o.id = 1"),
    ("other table", "SELECT o.id FROM orders o JOIN nation c ON o.c = c.id WHERE o.id = 1"),
    ("no join", "SELECT o.id FROM orders o WHERE o.id = 1"),
    ("no join", "SELECT o.id FROM orders o WHERE o.day = 1"),
    ("no join", "SELECT o.id FROM orders o WHERE o.id IN (SELECT id FROM part WHERE size = 1)"),
    ("subquery", "SELECT name, (SELECT max(size) FROM part) AS n FROM customer WHERE id = 1"),
    ("subquery", "SELECT name, (SELECT max(size) FROM part) AS n FROM customer WHERE phone = 1"),
    ("subquery", "SELECT name, (SELECT max(size) FROM part) AS n FROM customer WHERE mail = 1"),
    ("union", "SELECT id FROM part WHERE a = 1 UNION SELECT id FROM nation"),
    ("union", "SELECT id FROM part WHERE b = 1"),
    ("union", "SELECT id FROM part WHERE c = 1 UNION ALL SELECT id FROM nation"),
    ("one pattern", "SELECT id FROM region WHERE id = 1"),
    ("one pattern", "SELECT id FROM region WHERE id = 2"),
    ("one pattern", "SELECT id FROM region WHERE id = 3"),
]


def test_whole_mergeable(spark, monkeypatch):
    log = spark.createDataFrame([("r", "C", "t", k, s, 0, None, None, "TEST") for k, (_, s) in enumerate(STATEMENTS)], QUERY_LOG)
    monkeypatch.setattr(workload, "query_log", lambda spark, sf: log)
    got = {(r.query, r.table_name, r.detail) for r in audit.queries()["whole_mergeable"](spark, "").collect()}
    first = {g: s.lower().replace("= 1", "= ?") for g, s in reversed(STATEMENTS)}
    tables = {"join": "orders", "no join": "orders", "subquery": "customer", "union": "part"}
    assert got == {(first[g], t, "3 patterns") for g, t in tables.items()}
