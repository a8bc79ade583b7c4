"""Sequence rules over long tests: any range size gives the same findings, and time follows the length."""

import time

from pyspark.sql import functions as F

from sqlscope.config import AuditConfig
from sqlscope.operators import features, group_rules, order, reports
from sqlscope.schema import TEST

LOG = "run_id string, test_class string, test_name string, seq bigint, sql string, exec_nanos bigint, ts timestamp_ntz, stack_trace string, phase string"


def log_of(spark, statements, test="t"):
    rows = [("r", "C", test, k, sql, 0, None, None, "TEST") for k, sql in enumerate(statements)]
    return features.normalized(spark.createDataFrame(rows, LOG))


def script(n):
    """Blocks of a reading followed by deletes, and of a delete followed by inserts, over a few tables."""
    out = []
    for k in range(n):
        t = f"t{k % 4}"
        out += [f"select * from {t} where a = {k}", "select 1", f"delete from {t} where id = 1", "select 2 from x where y = 1", *[f"delete from {t} where id = {j}" for j in range(k % 5)]]
        out += [f"delete from l{k % 3} where owner_id = {k}", *[f"insert into l{k % 3} (owner_id, v) values ({k}, {j})" for j in range(k % 4)], "update z set a = 1"]
    return out


def found(df):
    return sorted(tuple(r[c] for c in (*TEST, "query", "table_name", "detail")) for r in df.collect())


def test_ranges_do_not_matter(spark, monkeypatch):
    config = AuditConfig()
    log = log_of(spark, script(25)).unionByName(log_of(spark, script(7), "u"))
    want = [found(rule(log, config)) for rule in (group_rules.derived_delete, group_rules.collection_reinsert)]
    assert all(want) and any("4 deletes" in r[-1] or "5 deletes" in r[-1] for r in want[0])
    for size in (1, 2, 7):
        monkeypatch.setattr(order, "RANGE", size)
        assert [found(rule(log, config)) for rule in (group_rules.derived_delete, group_rules.collection_reinsert)] == want


def test_one_long_test(spark):
    """A single test of 50,000 statements."""
    block = script(20)
    statements = (block * (50_000 // len(block) + 1))[:50_000]
    log = log_of(spark, statements).repartition(8).cache()
    log.count()
    start = time.time()
    assert found(group_rules.derived_delete(log, AuditConfig())) and found(group_rules.collection_reinsert(log, AuditConfig()))
    assert time.time() - start < 120
    log.unpersist()


def test_find_by_id_by_last_write(spark):
    loads = spark.createDataFrame([("r", "C", "t", "a.b.OrderItem", "1", 10), ("r", "C", "t", "a.b.Team", "2", 30), ("r", "C", "u", "a.b.Team", "2", 0), ("r", "C", "t", "a.b.Lazy", "3", 0)], "run_id string, test_class string, test_name string, entity string, entity_id string, s long")
    loads = loads.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    lazy = spark.createDataFrame([("r", "C", "t", "proxy:a.b.Lazy", "3")], "run_id string, test_class string, test_name string, role string, owner_id string")
    writes = [("r", "C", "t", 20, "insert into x (order_item_id, team_id, lazy_id) values (1, 2, 3)"), ("r", "C", "u", 5, "update x set steamId = 1"), ("r", "C", "u", 6, "select team_id from x")]
    log = spark.createDataFrame(writes, "run_id string, test_class string, test_name string, s long, sql string").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = group_rules.find_by_id(loads, lazy, features.normalized(log)).collect()
    assert [r.query for r in got] == ["findById: a.b.OrderItem#1"]


def test_closure_follows_long_chains(spark):
    from sqlscope.operators import catalog_rules
    from sqlscope.sources import catalog as C

    joins = " ".join(f"join t{k + 1} on t{k}.x = t{k + 1}.x" for k in range(8))
    rows = [(f"t{k}", "i", c, p + 1, True, 100) for k in range(9) for p, c in enumerate(("a", "x"))]
    catalog = C.load(spark.createDataFrame(rows, "table_name string, index_name string, column_name string, seq_in_index int, non_unique boolean, cardinality long"))
    log = log_of(spark, [f"select t0.y from t0 {joins} where t0.x = 5"])
    got = catalog_rules.composite_leading(features.build(log, catalog, AuditConfig()), catalog).collect()
    assert sorted(r.table_name for r in got) == [f"t{k}" for k in range(9)]


def test_statements_without_a_number_are_seen(spark):
    log = log_of(spark, ["select * from t"]).withColumn("seq", F.lit(None).cast("bigint"))
    row = features.representatives(log).first()
    assert row.sql == "select * from t" and row.op == "SELECT"
