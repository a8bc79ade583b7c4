"""The report queries over findings of every code: the registered ones read all findings, and their code agrees with brute force."""

from collections import Counter

import pytest

from sqlscope.plans import queries as audit
from sqlscope.schema import IMPACT_POINTS, ISSUE, SEVERITY_POINTS, SEVERITY_RANK

CODES = [("cartesian-join", "ERROR"), ("where-function", "ERROR"), ("full-scan", "WARNING"), ("filesort", "INFO"), ("select-all", "INFO"), ("order-by-rand", "ERROR"), ("slow-query", "WARNING"), ("slow-query", "ERROR")]


@pytest.fixture(scope="module")
def fixture(spark):
    rows = [("r", f"C{k % 3}", "t", code, severity, f"select {k % 5} from t{k % 4}", f"T{k % 4}" if k % 7 else None, "c" if k % 2 else None, "x", None) for k in range(60) for code, severity in CODES[k % 5 :]]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ISSUE))


def run(name, df):
    """The code of a registered query on the findings ``df``."""
    return audit.queries()[f"whole_{name}"].func(df.sparkSession, "", found=lambda spark, sf: df).collect()


@pytest.fixture
def taken(monkeypatch, fixture):
    """The findings of the audit are the fixture's."""
    monkeypatch.setattr(audit, "_audit", lambda spark, sf: type("Result", (), {"issues": fixture}))


@pytest.mark.parametrize("name", [f.__name__ for f in audit.WHOLE if f.__name__ not in ("failable", "top_k", "issue_suppression")] + ["issue_json"])
def test_all_codes_are_read(spark, taken, name):
    query = audit.queries()[name if name == "issue_json" else f"whole_{name}"]
    text = " ".join(str(r) for r in query(spark, "").collect())
    assert all(code in text for code, _ in CODES)


def test_breakdown_and_top(fixture):
    rows = fixture.collect()
    n = Counter((r.code, r.severity) for r in rows)
    got = {(r.code, r.errors, r.warnings, r.infos) for r in run("issue_breakdown", fixture)}
    assert got == {(c, n[c, "ERROR"], n[c, "WARNING"], n[c, "INFO"]) for c, _ in CODES}
    groups = {}
    for r in rows:
        groups.setdefault((r.code, r.table_name, r.column_name), []).append(r.severity)
    ranked = []
    for (code, table, column), severities in groups.items():
        best = min(severities, key=SEVERITY_RANK.get)
        score = 15 * len(severities) + SEVERITY_POINTS[best] + IMPACT_POINTS.get(code, 5)
        ranked.append((-score, code, table or "", column or "", len(severities), best))
    wanted = [(c, t or None, k or None, n, s, -score) for score, c, t, k, n, s in sorted(ranked)[:5]]
    assert [tuple(r)[:-1] for r in run("top_k", fixture)] == wanted


def test_dedup(fixture):
    wanted = {}
    for r in fixture.collect():
        key = f"{r.code}|{(r.table_name or '').lower()}|{r.column_name or ''}|select ? from {r.query.split()[-1]}"
        wanted.setdefault(key, []).append(r)
    got = {r.fingerprint: (r.code, r.occurrences, r.affected_tests, r.severity) for r in run("issue_dedup", fixture)}
    assert got == {k: (v[0].code, len(v), ",".join(sorted({f"{r.test_class}.t" for r in v})), min((r.severity for r in v), key=SEVERITY_RANK.get)) for k, v in wanted.items()}


def test_suppression_overrides_and_gates(fixture):
    rows = fixture.collect()
    assert Counter(r.code for r in run("issue_suppression", fixture)) == Counter(r.code for r in rows if r.code != "order-by-rand")
    changed = {"select-all": "ERROR", "order-by-rand": "INFO"}
    assert Counter((r.code, r.severity) for r in run("severity_override", fixture)) == Counter((r.code, changed.get(r.code, r.severity)) for r in rows)
    buckets = Counter((r.code, r.bucket) for r in run("baseline_classify", fixture))
    assert buckets == Counter((r.code, "info" if r.severity == "INFO" else "confirmed") for r in rows)
    assert Counter(r.code for r in run("failable", fixture)) == Counter(r.code for r in rows if r.code == "order-by-rand")
    lines = {f"{r.code}|{r.table_name or ''}|{r.column_name or ''}|ann|known" for r in rows}
    assert sorted(r.value for r in run("baseline_lines", fixture)) == sorted(lines)
