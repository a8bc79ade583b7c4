"""find_by_id leaves out what was loaded lazily too, and the full audit's count baseline is not drawn from the log."""

from sqlscope.plans import queries as audit
from sqlscope.plans import workload

SF = "/root/testdata/sf0.001"


def test_find_by_id_reads_lazy_loads(spark, monkeypatch):
    every = audit.find_by_id(spark, SF).collect()
    first = every[0]
    key = first.query.rsplit("#", 1)[1]
    lazy = spark.createDataFrame([("r", "byid", first.test_name, "proxy:shop.Customer", "Customer", key)], "run_id string, test_class string, test_name string, role string, owner_entity string, owner_id string")
    monkeypatch.setattr(workload, "lazy_loads", lambda spark, sf: lazy)
    assert sorted(audit.find_by_id(spark, SF).collect()) == sorted(every[1:])


def test_full_audit_has_its_own_baseline(spark, monkeypatch):
    monkeypatch.setattr(audit, "_halves", None)
    monkeypatch.setattr(audit.engine, "audit", lambda *_, count_baseline, **__: count_baseline)
    assert audit._audit(spark, SF).count() == 10
