"""One query per operator of the audit, over the synthetic log, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlscope import engine
from sqlscope.config import AuditConfig
from sqlscope.functions import text as T
from sqlscope.operators import catalog_rules, explain, features, group_rules, predicate_rules, reports
from sqlscope.plans import oracle as O
from sqlscope.plans import workload as W
from sqlscope.schema import IMPACT_POINTS, ISSUE
from sqlscope.sources import catalog as C
from sqlscope.sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = AuditConfig()
SHOWN = ("test_class", "code", "severity", "query", "table_name", "column_name")


def _log(spark: SparkSession, sf: str, tested: bool = True) -> DataFrame:
    log = W.query_log(spark, sf)
    return features.normalized(features.tested(log, CONFIG) if tested else log)


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return features.build(W.query_log(spark, sf), W.index_catalog(spark), CONFIG)


def _rule(code: str, spark: SparkSession, sf: str) -> DataFrame:
    f, catalog = _features(spark, sf), W.index_catalog(spark)
    by_code: dict[str, Callable[[], DataFrame]] = {
        "implicit-type-conversion": lambda: predicate_rules.conversions(f),
        "n-plus-one-suspect": lambda: group_rules.n_plus_one_suspect(f, CONFIG),
        "repeated-single-insert": lambda: group_rules.repeated_insert(f, CONFIG),
        "slow-query": lambda: group_rules.slow_query(f, CONFIG),
        "missing-where-index": lambda: catalog_rules.missing_where(catalog_rules.known_where(f, catalog)),
        "missing-join-index": lambda: catalog_rules.missing_join(f, catalog),
        "missing-order-by-index": lambda: catalog_rules.missing_order(f, catalog_rules.known_where(f, catalog), catalog),
        "missing-group-by-index": lambda: catalog_rules.missing_group(f, catalog_rules.known_where(f, catalog), catalog),
        "composite-index-leading": lambda: catalog_rules.composite_leading(f, catalog),
        "covering-index-opportunity": lambda: catalog_rules.covering(f, catalog, CONFIG),
        "order-by-limit-no-index": lambda: catalog_rules.order_limit(f, catalog),
        "redundant-index": lambda: catalog_rules.redundant(f, catalog),
        "write-amplification": lambda: catalog_rules.write_amplification(f, catalog, CONFIG),
        "dml-without-index": lambda: catalog_rules.dml_without_index(catalog_rules.known_where(f, catalog)),
        "non-deterministic-pagination": lambda: catalog_rules.unstable_pages(f, catalog),
    }
    if code in ("for-update-no-index", "for-update-non-unique", "range-lock-risk"):
        found = catalog_rules.locking(f, catalog_rules.known_where(f, catalog)).filter(F.col("code") == code)
    elif code in by_code:
        found = by_code[code]()
    else:
        found = predicate_rules.evaluate(f, CONFIG, frozenset({code}))
    return found.select(*SHOWN)


# --- text functions over the distinct statements of the log -------------------------------------------------

def _pairs(c: Column, *fields: str) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat_ws(".", *[x[f] for f in fields])), ",")


def _text(expression: Callable[[], Column], spark: SparkSession, sf: str) -> DataFrame:
    s = W.query_log(spark, sf).filter("phase = 'TEST'").select("seq", T.strip_comments(F.col("sql")).alias("s"))
    s = s.withColumns({"o": T.mask(T.remove_subqueries(F.col("s")))}).withColumn("w", T.where_body(F.col("o")))
    return s.select("seq", expression().cast("string").alias("value"))


_O, _WB = (lambda: F.col("o")), (lambda: F.coalesce(F.col("w"), F.lit("")))
TEXT: dict[str, tuple[Callable[[], Column], str | None]] = {
    "normalize": (lambda: T.normalize(F.col("s")), "nsql"),
    "strip_comments": (lambda: F.trim(F.col("s")), r"trim(regexp_replace(regexp_replace(sql, '/\*.*?\*/', ' ', 'gs'), '--[^\n]*', ' ', 'g'))"),
    "strip_cte": (lambda: F.trim(T.strip_cte(F.col("s"))), r"trim(regexp_replace(s, '(?is)^\s*with\s+\w+\s+as\s*\([^()]*\)\s*', ''))"),
    "remove_subqueries": (lambda: F.trim(T.remove_subqueries(F.col("s"))), "trim(regexp_replace(s, '(?is)" + O._SUB + "', '(?)', 'g'))"),
    "statement_type": (lambda: T.op(F.col("s")), "op"),
    "dml_table": (lambda: T.dml_table(F.col("s")), "nullif(lower(regexp_extract(s, '(?i)^\\s*(?:update|delete\\s+from|(?:insert|replace)\\s+into)\\s+(\\w+)', 1)), '')"),
    "has_where": (lambda: T.has_where(_O()), "CASE WHEN regexp_matches(o, '(?i)\\bwhere\\b') THEN 'true' ELSE 'false' END"),
    "has_select_all": (lambda: T.has_select_all(F.col("s")), "CASE WHEN regexp_matches(s, '(?is)select\\s+(?:distinct\\s+)?(?:\\w+\\.)?\\*') THEN 'true' ELSE 'false' END"),
    "where_body": (lambda: F.trim(_WB()), "trim(w)"),
    "having_body": (lambda: F.trim(T.having_body(_O())), r"nullif(trim(regexp_extract(o, '(?is)\bhaving\b(.*?)(?:\border\s+by\b|\blimit\b|\bunion\b|$)', 1)), '')"),
    "select_list": (lambda: F.trim(T.select_list(_O())), r"nullif(trim(regexp_extract(o, '(?is)^\s*select\s+(.*?)\bfrom\b', 1)), '')"),
    "table_names": (
        lambda: F.array_join(T.tables(_O()), ","),
        r"array_to_string(list_transform(list_concat(regexp_extract_all(o, '(?i)\bfrom\s+([A-Za-z]\w*)', 1), regexp_extract_all(o, '(?i)\bjoin\s+([A-Za-z]\w*)', 1)), lambda x: lower(x)), ',')",
    ),
    "join_columns": (lambda: _pairs(T.join_pairs(_O()), "lq", "lc", "rq", "rc"), r"coalesce(array_to_string(list_transform(regexp_extract_all(o, '(?i)\w+\.\w+\s*=\s*\w+\.\w+(?:\s+(?:join|where|and)\b|$)', 0), lambda x: CASE WHEN regexp_matches(o, '(?i)\bjoin\b.*\bon\b') THEN lower(regexp_replace(regexp_extract(x, '(\w+\.\w+\s*=\s*\w+\.\w+)', 1), '\s*=\s*', '.')) END), ','), '')"),
    "order_by_columns": (lambda: _pairs(T.order_columns(_O()), "qualifier", "column"), r"coalesce(CASE WHEN NOT regexp_matches(o, '(?i)over\s*\(') THEN lower(regexp_extract(o, '(?i)\border\s+by\s+(\w+)(?:\s|$)', 1)) END, '')"),
    "group_by_columns": (lambda: _pairs(T.group_columns(_O()), "qualifier", "column"), r"lower(regexp_extract(o, '(?i)\bgroup\s+by\s+(\w+)(?:\s+having|\s*$)', 1))"),
    "where_columns": (
        lambda: _pairs(F.filter(T.where_refs(_WB()), lambda r: r["op"] == "="), "column"),
        r"array_to_string(list_filter(list_concat(list_transform(regexp_extract_all(w, '(?i)\b([a-z_]\w*)\s*=', 1), lambda x: lower(x)), list_transform(regexp_extract_all(w, '=\s*[A-Za-z_]\w*\.(\w+)', 1), lambda x: lower(x))), lambda x: x <> 'end'), ',')",
    ),
    "where_functions": (lambda: _pairs(T.where_functions(_WB()), "function", "column"), r"coalesce(CASE WHEN regexp_matches(w, '(?i)^\s*(year|coalesce)\s*\(') THEN upper(regexp_extract(w, '(?i)^\s*(\w+)\s*\(', 1)) || '.' || lower(regexp_extract(w, '\(\s*(\w+)', 1)) END, '')"),
    "join_functions": (lambda: _pairs(T.join_functions(_O()), "function", "column"), r"coalesce(CASE WHEN regexp_matches(o, '(?i)\bon\s+lower\s*\(') THEN 'LOWER.' || lower(regexp_extract(o, '(?i)lower\(\w+\.(\w+)', 1)) END, '')"),
    "having_functions": (lambda: _pairs(T.having_functions(T.having_body(_O())), "function", "column"), r"coalesce(upper(nullif(regexp_extract(o, '(?i)\bhaving\s+(?:\w+\s*=\s*\S+\s+and\s+)?(lower|year)\(\w+\)', 1), '')) || '.' || lower(regexp_extract(o, '(?i)\bhaving\s+(?:\w+\s*=\s*\S+\s+and\s+)?(?:lower|year)\((\w+)\)', 1)), '')"),
    "on_bodies": (
        lambda: F.array_join(F.transform(T.on_bodies(_O()), lambda x: F.trim(x)), "|"),
        r"array_to_string(list_transform(regexp_extract_all(regexp_replace(o, '(?i)\s+(left |inner |cross )?join\b|\s+where\b|\s+limit\b|\s+group by\b', chr(1), 'g'), '(?i)\bon\b([^\x01]*)', 1), lambda x: trim(x)), '|')",
    ),
    "or_count": (lambda: T.or_count(_WB()), r"CAST(len(regexp_extract_all(w, '(?i)\bor\b')) AS VARCHAR)"),
    "effective_or_count": (lambda: T.effective_or_count(_WB()), r"CAST(len(regexp_extract_all(w, '(?i)\bor\b')) - len(regexp_extract_all(w, '(?i)\(\s*\?\s+is\s+null\s+or\b')) AS VARCHAR)"),
    "or_columns": (lambda: F.array_join(T.or_columns(F.when(T.or_count(_WB()) > 0, _WB())), ","), r"CASE WHEN regexp_matches(w, '(?i)\bor\b') AND NOT regexp_matches(w, '(?i)\?\s+is\s+null\s+or\b') THEN array_to_string(list_transform(regexp_extract_all(w, '(\w+)\s*=', 1), lambda x: lower(x)), ',') ELSE '' END"),
    "same_or_column": (lambda: T.same_or_column(F.when(T.or_count(_WB()) > 0, _WB())), r"CASE WHEN regexp_matches(w, '(?i)\bor\b') AND len(list_distinct(regexp_extract_all(w, '(\w+)\s*=', 1))) = 1 THEN 'true' ELSE 'false' END"),
    "offset_value": (lambda: T.offset_value(F.col("s")), r"CAST(TRY_CAST(regexp_extract(s, '(?i)\boffset\s+([0-9]+)', 1) AS BIGINT) AS VARCHAR)"),
    "has_offset": (lambda: T.has_offset(F.col("s")), r"CASE WHEN regexp_matches(s, '(?i)\boffset\s') THEN 'true' ELSE 'false' END"),
    "split_top_level": (
        lambda: F.array_join(F.transform(T.split_top_level(T.select_list(_O())), lambda x: F.trim(x)), "|"),
        r"CASE WHEN regexp_matches(o, '(?is)^\s*select.*\bfrom\b') THEN array_to_string(list_transform(string_split(regexp_replace(regexp_extract(o, '(?is)^\s*select\s+(.*?)\bfrom\b', 1), '(\([^(),]*),([^()]*\))', '\1' || chr(1) || '\2', 'g'), ','), lambda x: replace(trim(x), chr(1), ',')), '|') END",
    ),
    "aliases": (
        lambda: F.array_join(F.array_sort(F.transform(T.aliases(_O()), lambda a: F.concat_ws("=", a["alias"], a["table"]))), ","),
        rf"(SELECT coalesce(string_agg(DISTINCT a, ',' ORDER BY a), '') FROM (SELECT unnest([tab || '=' || tab, CASE WHEN al = '' OR al IN {O.NOT_ALIAS} THEN tab ELSE al END || '=' || tab]) AS a FROM "
        r"(SELECT tab, lower(regexp_extract(o, '(?i)(?:\b(?:from|join|update)\s+|,\s*)' || tab || '\s+(?:as\s+)?(\w+)', 1)) AS al FROM (SELECT unnest(list_transform(list_concat(regexp_extract_all(o, '(?i)(?:\b(?:from|join)|^\s*update)\s+(\w+)', 1), "
        r"regexp_extract_all(o, '(?i)\bfrom\s+\w+\s*,\s*(\w+)', 1)), lambda x: lower(x))) AS tab))))",
    ),
}


def _text_sql(value: str) -> str:
    masked = "regexp_replace(regexp_replace(s, '(?is)" + O._SUB + "', '(?)', 'g'), '''(?:[^'']|'''')*''', '?', 'g')"
    return (
        f"WITH {O.LOG}, x AS (SELECT seq, sql, nsql, op, regexp_replace(regexp_replace(sql, '/\\*.*?\\*/', ' ', 'gs'), '--[^\\n]*', ' ', 'g') AS s FROM tested), y AS (SELECT *, {masked} AS o FROM x), "
        f"z AS (SELECT *, regexp_extract(o, '(?is)\\bwhere\\b(.*?){O._END}', 1) AS w FROM y) SELECT seq, CAST({value} AS VARCHAR) AS value FROM z"
    )


# --- events, sequences, baselines -----------------------------------------------------------------------

_SCRIPT = """
lines AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
script AS (
  SELECT k, 0 AS seq, CASE WHEN k % 2 = 0 THEN 'SELECT' ELSE 'SELECT' END AS op, CASE WHEN k % 2 = 0 THEN 'orders' ELSE 'lineitem' END AS tab, CASE WHEN k % 2 = 0 THEN 'SELECT o_orderkey FROM orders WHERE o_orderkey = ' || k ELSE 'SELECT l_linenumber FROM lineitem WHERE l_orderkey = ' || k END AS sql FROM lines
  UNION ALL SELECT k, 1, 'DELETE', 'lineitem', 'DELETE FROM lineitem WHERE l_orderkey = ' || k FROM lines WHERE k % 2 = 0
  UNION ALL SELECT k, i + 1, 'INSERT', 'lineitem', 'x' FROM lines, unnest(range(1, n + 1)) AS r(i) WHERE k % 2 = 0
  UNION ALL SELECT k, i, 'DELETE', 'lineitem', 'x' FROM lines, unnest(range(1, n + 1)) AS r(i) WHERE k % 2 = 1)
"""


def collection_reinsert(spark: SparkSession, sf: str) -> DataFrame:
    found = group_rules.collection_reinsert(features.normalized(W.order_script(spark, sf)), CONFIG)
    return found.select("test_name", "severity", "query", "table_name", "detail")


COLLECTION_SQL = f"""WITH {_SCRIPT} SELECT CAST(d.k AS VARCHAR) AS test_name, 'WARNING' AS severity, d.sql AS query, d.tab AS table_name, count(*) || ' inserts' AS detail
 FROM script d JOIN script i ON i.k = d.k AND i.op = 'INSERT' AND i.tab = d.tab AND i.seq > d.seq
 WHERE d.op = 'DELETE' AND d.k % 2 = 0 AND NOT EXISTS (SELECT 1 FROM script x WHERE x.k = d.k AND x.seq > d.seq AND x.seq < i.seq AND x.op <> 'INSERT') GROUP BY d.k, d.sql, d.tab HAVING count(*) >= 2"""


def derived_delete(spark: SparkSession, sf: str) -> DataFrame:
    found = group_rules.derived_delete(features.normalized(W.order_script(spark, sf)), CONFIG)
    return found.select("test_name", "severity", "query", "table_name", "detail")


DERIVED_SQL = f"""WITH {_SCRIPT} SELECT CAST(s.k AS VARCHAR) AS test_name, 'WARNING' AS severity, s.sql AS query, s.tab AS table_name, count(*) || ' deletes' AS detail
 FROM script s JOIN script d ON d.k = s.k AND d.op = 'DELETE' AND d.tab = s.tab AND d.seq > s.seq WHERE s.op = 'SELECT' AND s.k % 2 = 1 GROUP BY s.k, s.sql, s.tab HAVING count(*) >= 3"""


def lazy_n_plus_one(spark: SparkSession, sf: str) -> DataFrame:
    return group_rules.lazy_n_plus_one(W.lazy_loads(spark, sf), CONFIG).select("test_name", "code", "severity", "query", "table_name", "detail")


LAZY_SQL = """SELECT CAST(o_custkey AS VARCHAR) AS test_name, 'n-plus-one' AS code, 'ERROR' AS severity, 'Lazy load: ' || CASE WHEN o_custkey % 3 = 0 THEN 'proxy:shop.Order' ELSE 'shop.Order.lines' END AS query, 'Order' AS table_name,
 CASE WHEN o_custkey % 3 = 0 THEN 'proxy' ELSE 'collection' END || ' of ' || count(DISTINCT o_orderkey) || ' owners' AS detail FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) >= 3"""


def find_by_id(spark: SparkSession, sf: str) -> DataFrame:
    found = group_rules.find_by_id(W.explicit_loads(spark, sf), W.lazy_loads(spark, sf), features.normalized(W.writes_log(spark, sf)))
    return found.select("test_name", "code", "severity", "query", "table_name")


FIND_SQL = """SELECT CAST(c_nationkey AS VARCHAR) AS test_name, 'find-by-id-for-association' AS code, 'INFO' AS severity, 'findById: shop.Customer#' || c_custkey AS query, 'shop.Customer' AS table_name
 FROM customer WHERE c_custkey % 60 < 30 AND c_nationkey % 2 = 0 AND c_nationkey IN (SELECT n_nationkey FROM nation)"""


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Counts per service of a tenth of the events, and of all."""
    log = _log(spark, sf)
    return group_rules.statement_counts(log.filter("seq % 10 = 3")).drop("run_id"), group_rules.statement_counts(log)


def count_regression(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _halves(spark, sf)
    return group_rules.count_regression(new, old).select("test_class", "code", "severity", "detail")


_COUNTS = """counts AS (SELECT test_class, count(*) FILTER (op = 'SELECT') AS selects, count(*) FILTER (op = 'INSERT') AS inserts, count(*) FILTER (op = 'UPDATE') AS updates, count(*) FILTER (op = 'DELETE') AS deletes, count(*) FILTER (op <> 'OTHER') AS total FROM tested GROUP BY 1),
old AS (SELECT test_class, count(*) FILTER (op = 'SELECT') AS selects, count(*) FILTER (op = 'INSERT') AS inserts, count(*) FILTER (op = 'UPDATE') AS updates, count(*) FILTER (op = 'DELETE') AS deletes, count(*) FILTER (op <> 'OTHER') AS total FROM tested WHERE seq % 10 = 3 GROUP BY 1)"""
REGRESSION_SQL = f"""WITH {O.LOG}, {_COUNTS} SELECT c.test_class, 'query-count-regression' AS code, CASE WHEN c.total >= 1.5 * o.total AND c.total - o.total >= 5 AND c.total >= 3 * o.total THEN 'ERROR' ELSE 'WARNING' END AS severity,
 o.total || ' -> ' || c.total AS detail FROM counts c JOIN old o USING (test_class) WHERE o.total > 0 AND ((c.total >= 1.5 * o.total AND c.total - o.total >= 5) OR (o.selects > 0 AND c.selects >= 2 * o.selects AND c.selects - o.selects >= 5))"""


def duplicate_query(spark: SparkSession, sf: str) -> DataFrame:
    """The log cut into small tests with all numbers alike, so that exact repeats occur below the N+1 threshold."""
    log = W.query_log(spark, sf).withColumn("test_name", (F.col("seq") % 97).cast("string")).withColumn("sql", F.regexp_replace("sql", r"\d+", "7"))
    return group_rules.duplicate_query(features.normalized(features.tested(log, CONFIG)), CONFIG).select("test_class", "test_name", "query", "table_name", "detail")


DUPLICATE_SQL = f"""WITH {O.LOG}, d AS (SELECT test_class, CAST(seq % 97 AS VARCHAR) AS test_name, regexp_replace(sql, '[0-9]+', '7', 'g') AS q FROM tested WHERE op = 'SELECT'),
 e AS (SELECT *, {O.norm("q")} AS p FROM d), often AS (SELECT test_class, test_name, p FROM e GROUP BY ALL HAVING count(*) >= 3)
 SELECT test_class, test_name, q AS query, coalesce(nullif(lower(regexp_extract(q, '(?i)\\bfrom\\s+([A-Za-z]\\w*)', 1)), ''), NULL) AS table_name, CAST(count(*) AS VARCHAR) AS detail FROM e
 WHERE (test_class, test_name, p) NOT IN (SELECT test_class, test_name, p FROM often) GROUP BY test_class, test_name, q, p HAVING count(*) > 1"""


def mergeable(spark: SparkSession, sf: str) -> DataFrame:
    """On single-table SELECTs without subqueries, where SQL can tell the select list."""
    log = _log(spark, sf).filter(~F.col("sql").rlike(r"(?is)join|\(\s*select|^\s*with|union"))
    return group_rules.mergeable(features.representatives(log), CONFIG).select("test_class", "query", "table_name", "detail")


def whole_mergeable(spark: SparkSession, sf: str) -> DataFrame:
    """On all SELECTs; SQL can't tell the select list of each."""
    return group_rules.mergeable(features.representatives(_log(spark, sf)), CONFIG).select("test_class", "query", "table_name", "detail")


MERGEABLE_SQL = rf"""WITH {O.LOG}, s AS (SELECT test_class, seq, nsql, regexp_extract(nsql, '\bfrom\s+(\w+)', 1) AS tab, trim(regexp_extract(nsql, '^select\s+(.*?)\bfrom\b', 1)) AS cols FROM tested
 WHERE op = 'SELECT' AND NOT regexp_matches(sql, '(?is)join|\(\s*select|^\s*with|union')) SELECT test_class, arg_min(nsql, seq) AS query, tab AS table_name, count(DISTINCT nsql) || ' patterns' AS detail FROM s GROUP BY test_class, tab, cols HAVING count(*) >= 3 AND count(DISTINCT nsql) > 1"""


# --- report operators -----------------------------------------------------------------------------------

def _told(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of all rules that SQL can tell over the log: those of the queries rule_*."""
    c = engine.context(W.query_log(spark, sf), W.index_catalog(spark))
    f = c.features.persist()
    c = replace(c, features=f, where=catalog_rules.known_where(f, c.catalog).persist())
    return engine.run_rules(c).filter(F.col("code").isin(*O.rule_sql()))


def all_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The union of the rules, as the engine runs them together."""
    return _told(spark, sf).select(*SHOWN)


def _whole(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of all rules, in the columns of ISSUE."""
    return _audit(spark, sf).issues.select(*ISSUE)


def _some_sql() -> str:
    return O.union_sql()


def report_summary(spark: SparkSession, sf: str) -> DataFrame:
    log = features.normalized(features.suppressed(W.query_log(spark, sf), AuditConfig(suppress_queries=("Order By Rand",))))
    return reports.summary(log).select("test_class", "unique_patterns", "total_queries", "total_nanos")


SUMMARY_SQL = f"WITH {O.LOG} SELECT test_class, count(DISTINCT nsql) AS unique_patterns, count(*) AS total_queries, CAST(sum(ms) * 1000000 AS BIGINT) AS total_nanos FROM norm WHERE NOT contains(lower(sql), 'order by rand') GROUP BY 1"


def statement_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.statement_counts(_log(spark, sf)).drop("run_id", "test_name")


def query_suppression(spark: SparkSession, sf: str) -> DataFrame:
    kept = features.suppressed(W.query_log(spark, sf), AuditConfig(suppress_queries=(" FROM Part ", "nation")))
    return kept.groupBy("test_class").agg(F.count(F.lit(1)).alias("kept"))


def phase_filter(spark: SparkSession, sf: str) -> DataFrame:
    return features.tested(W.query_log(spark, sf), CONFIG).groupBy("test_class").agg(F.count(F.lit(1)).alias("kept"), F.min("seq").alias("first_seq"))


def issue_suppression(spark: SparkSession, sf: str, found: Query = _told) -> DataFrame:
    config = AuditConfig(suppress_issues=("order-by-rand", "null-comparison:orders.o_clerk"))
    return reports.suppress(found(spark, sf), config).select(*SHOWN)


def severity_override(spark: SparkSession, sf: str, found: Query = _told) -> DataFrame:
    return reports.override(found(spark, sf), AuditConfig(severity={"select-all": "ERROR", "order-by-rand": "INFO"})).select(*SHOWN)


def _baseline(spark: SparkSession) -> DataFrame:
    lines = ["# kept on purpose", "select-all|customer||ann|wide reads", "null-comparison|ORDERS|O_CLERK|bob|legacy", "order-by-rand|nation||c|x", "broken|line"]
    return files.parse_issue_baseline(spark.createDataFrame([(x,) for x in lines], "value string"))


def baseline_classify(spark: SparkSession, sf: str, found: Query = _told) -> DataFrame:
    return reports.classify(reports.acknowledge(found(spark, sf), _baseline(spark))).select(*SHOWN, "bucket")


def impact_rank(spark: SparkSession, sf: str) -> DataFrame:
    return reports.impact_rank(_told(spark, sf)).select("code", "table_name", "column_name", "frequency", "severity", "score", "rank")


_RANK_SQL = """SELECT code, table_name, column_name, count(*) AS frequency, CASE min(CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END) WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS severity,
 CAST(count(*) * 15 + CASE min(CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END) WHEN 0 THEN 100 WHEN 1 THEN 30 ELSE 5 END + CASE code """ + " ".join(f"WHEN '{c}' THEN {n}" for c, n in IMPACT_POINTS.items()) + " ELSE 5 END AS BIGINT) AS score FROM sm GROUP BY ALL"


def _ranked(limit: str = "") -> str:
    return f"{_some_sql()}, r AS ({_RANK_SQL.replace('GROUP BY ALL', 'GROUP BY code, table_name, column_name')}) SELECT *, CAST(row_number() OVER (ORDER BY score DESC, code, table_name NULLS FIRST, column_name NULLS FIRST) AS INTEGER) AS rank FROM r {limit}"


def issue_dedup(spark: SparkSession, sf: str, found: Query = _told) -> DataFrame:
    d = reports.deduplicate(found(spark, sf))
    return d.select("fingerprint", "code", "occurrences", F.array_join("affected_tests", ",").alias("affected_tests"), "severity")


DEDUP_TAIL = f""" SELECT code || '|' || coalesce(lower(table_name), '') || '|' || coalesce(lower(column_name), '') || '|' || substr({O.norm("coalesce(query, '')")}, 1, 200) AS fingerprint, code, count(*) AS occurrences,
 array_to_string(list_sort(list(DISTINCT test_class || '.t'))[1:10], ',') AS affected_tests, arg_min(severity, CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END) AS severity FROM sm GROUP BY 1, 2"""


def pattern_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return reports.pattern_frequency(_log(spark, sf, tested=False))


def table_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return reports.table_frequency(_log(spark, sf, tested=False))


TABLES_SQL = rf"WITH {O.LOG}, n AS (SELECT nsql, count(*) AS n FROM norm GROUP BY 1), t AS (SELECT nsql, n, unnest(list_distinct(list_concat(regexp_extract_all(nsql, '\b(?:from|join)\s+([a-z]\w*)', 1), regexp_extract_all(nsql, '^(?:update|(?:insert|replace)\s+into)\s+(\w+)', 1)))) AS table_name FROM n) SELECT table_name, CAST(sum(n) AS BIGINT) AS accesses FROM t GROUP BY 1"


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    return reports.timeline(_log(spark, sf)).select("test_class", "position", "seq", "nsql", "pattern_count")


def issue_breakdown(spark: SparkSession, sf: str, found: Query = _told) -> DataFrame:
    return reports.breakdown(found(spark, sf))


def top_k(spark: SparkSession, sf: str, found: Query = _told) -> DataFrame:
    return reports.top(found(spark, sf), 5).select("code", "table_name", "column_name", "frequency", "severity", "score", "rank")


def failable(spark: SparkSession, sf: str, found: Query = _told) -> DataFrame:
    issues = reports.classify(reports.acknowledge(found(spark, sf), _baseline(spark)))
    return reports.failures(issues, AuditConfig(fail_on=frozenset({"null-comparison", "order-by-rand"}))).select(*SHOWN)


def budget_violations(spark: SparkSession, sf: str) -> DataFrame:
    return reports.over_budget(_log(spark, sf), 800).select("test_class", "queries")


def n_plus_one_gate(spark: SparkSession, sf: str) -> DataFrame:
    return reports.n_plus_one_gate(_log(spark, sf), 10).select("test_class", "worst", "patterns")


def count_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _halves(spark, sf)
    return reports.upsert_counts(old.filter("test_class <> 'svc_1'"), new.filter("test_class <> 'svc_2'")).drop("test_name")


UPSERT_SQL = f"WITH {O.LOG}, {_COUNTS} SELECT * FROM counts WHERE test_class <> 'svc_2' UNION ALL SELECT * FROM old WHERE test_class = 'svc_2'"


# --- sources, catalogue operators, sinks -----------------------------------------------------------------

def log_capture(spark: SparkSession, sf: str) -> DataFrame:
    """The first 700 statements of each test, as a capture buffer keeps them."""
    kept = files.capture(W.query_log(spark, sf), max_queries=700)
    return kept.groupBy("test_class", "phase").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


CAPTURE_SQL = f"WITH {O.LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY test_class ORDER BY seq) AS k FROM norm) SELECT test_class, phase, count(*) AS n, max(seq) AS last_seq FROM r WHERE k <= 700 GROUP BY 1, 2"


def stack_frames(spark: SparkSession, sf: str) -> DataFrame:
    return W.query_log(spark, sf).filter("stack_trace is not null").select("seq", files.clean_stack(F.concat(F.lit("java.lang.Thread.run:1\n"), "stack_trace", F.lit("\norg.hibernate.X.y:2"))).alias("frames"))


def index_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return C.load(W.index_catalog(spark))


def _entities(spark: SparkSession) -> DataFrame:
    rows = [("LineItem", "idx_l_1", "lShipdate DESC", False), ("LineItem", "ix_comment", "lComment, lTax", False), ("Customer", "UK_C_EMAIL", "c_email", True), ("ShipMode", "uk_mode", "modeName ASC", True)]
    return spark.createDataFrame(rows, "entity string, index_name string, column_list string, is_unique boolean")


def catalog_from_entities(spark: SparkSession, sf: str) -> DataFrame:
    return C.from_entities(_entities(spark))


_ENTITY_SQL = "SELECT * FROM (VALUES ('line_item', 'idx_l_1', 'l_shipdate', 1, TRUE, 0), ('line_item', 'ix_comment', 'l_comment', 1, TRUE, 0), ('line_item', 'ix_comment', 'l_tax', 2, TRUE, 0), ('customer', 'UK_C_EMAIL', 'c_email', 1, FALSE, 0), ('ship_mode', 'uk_mode', 'mode_name', 1, FALSE, 0)) v(table_name, index_name, column_name, seq_in_index, non_unique, cardinality)"


def catalog_merge(spark: SparkSession, sf: str) -> DataFrame:
    return C.merge(C.load(W.index_catalog(spark)), C.from_entities(_entities(spark)))


def catalog_prefer(spark: SparkSession, sf: str) -> DataFrame:
    return C.prefer(C.load(W.index_catalog(spark)).filter("false"), C.from_entities(_entities(spark)))


def index_shape(spark: SparkSession, sf: str) -> DataFrame:
    return C.index_shape(W.index_catalog(spark)).select("table_name", "index_name", F.array_join("cols", ",").alias("cols"), "is_unique")


def _where_tables(spark: SparkSession, sf: str) -> DataFrame:
    return features.where_columns(_features(spark, sf)).select("test_class", "nsql", "column_name", "table_name").distinct()


def column_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return _where_tables(spark, sf)


def has_table(spark: SparkSession, sf: str) -> DataFrame:
    return C.has_table(_where_tables(spark, sf), W.index_catalog(spark)).select("test_class", "nsql", "column_name", "table_name")


def has_index_on(spark: SparkSession, sf: str) -> DataFrame:
    return C.lookup(_where_tables(spark, sf), W.index_catalog(spark)).filter("leading is not null").select("test_class", "nsql", "column_name", "table_name")


def unique_covered(spark: SparkSession, sf: str) -> DataFrame:
    w = features.where_columns(_features(spark, sf)).filter("cmp = '=' and table_name is not null")
    sets = w.groupBy("test_class", "nsql", "table_name").agg(F.collect_set("column_name").alias("cols"))
    return C.covers_unique(sets, W.index_catalog(spark)).select("test_class", "nsql", "table_name")


UNIQUE_SQL = f"WITH {O.LOG}, {O.COLUMNS} SELECT DISTINCT k.test_class, k.nsql, k.tab AS table_name FROM (SELECT test_class, nsql, tab, list(DISTINCT col) AS cols FROM cmp WHERE cmp = '=' AND tab IS NOT NULL GROUP BY ALL) k JOIN shape s ON s.table_name = k.tab AND s.uniq WHERE list_has_all(k.cols, s.cols)"


def baseline_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _baseline(spark)


def count_baseline_parse(spark: SparkSession, sf: str) -> DataFrame:
    lines = ["# class|method|...", "a.B|x|1|2|3|4|10", "a.B|y|1|2|oops|4|10", "short|1", "a.C|z|0|0|0|0|0"]
    return files.parse_count_baseline(spark.createDataFrame([(x,) for x in lines], "value string"))


def baseline_lines(spark: SparkSession, sf: str, found: Query = _told) -> DataFrame:
    return sinks.baseline_lines(found(spark, sf), "ann", "known")


def count_lines(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.count_lines(reports.statement_counts(_log(spark, sf)))


def ci_annotations(spark: SparkSession, sf: str, found: Query = _told) -> DataFrame:
    return sinks.annotations(found(spark, sf))


def issue_json(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.json_lines(_whole(spark, sf))


def _plans(spark: SparkSession, sf: str, tested: bool = True) -> DataFrame:
    for name in ("orders", "customer", "part", "lineitem"):
        spark.read.parquet(f"{sf}/{name}.parquet").createOrReplaceTempView(name)
    return explain.explain(spark, _log(spark, sf, tested))


def report_json(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.report_json(engine.audit(W.query_log(spark, sf), W.index_catalog(spark), plans=_plans(spark, sf)))


def explain_plans(spark: SparkSession, sf: str) -> DataFrame:
    return _plans(spark, sf, tested=False)


def _audit(spark: SparkSession, sf: str) -> engine.AuditResult:
    """Every rule of the catalogue in one run, over the log with lazy loads, query plans and a count baseline of fixed lines."""
    lines = [(f"svc_{k}|t|5|1|1|1|8",) for k in range(10)]
    old = files.parse_count_baseline(spark.createDataFrame(lines, "value string"))
    return engine.audit(W.query_log(spark, sf), W.index_catalog(spark), lazy=W.lazy_loads(spark, sf), explicit=W.explicit_loads(spark, sf), count_baseline=old, plans=_plans(spark, sf))


def full_audit(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf).issues.groupBy("code", "severity", "bucket").agg(F.count(F.lit(1)).alias("findings"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Which findings matter most: the impact ranking of a full audit."""
    return reports.impact_rank(engine.audit(W.query_log(spark, sf), W.index_catalog(spark), plans=_plans(spark, sf)).issues)


def _tail(sql: str) -> str:
    return f"{_some_sql()} {sql}"


_ISSUE_COLUMNS = "test_class, code, severity, query, table_name, column_name"
_ACK = "((code = 'select-all' AND table_name = 'customer') OR (code = 'null-comparison' AND table_name = 'orders' AND column_name = 'o_clerk') OR (code = 'order-by-rand' AND table_name = 'nation'))"
OTHERS: list[tuple[Query, str | None]] = [
    (collection_reinsert, COLLECTION_SQL),
    (derived_delete, DERIVED_SQL),
    (lazy_n_plus_one, LAZY_SQL),
    (find_by_id, FIND_SQL),
    (count_regression, REGRESSION_SQL),
    (duplicate_query, DUPLICATE_SQL),
    (mergeable, MERGEABLE_SQL),
    (whole_mergeable, None),
    (report_summary, SUMMARY_SQL),
    (statement_counts, f"WITH {O.LOG}, {_COUNTS} SELECT * FROM counts"),
    (query_suppression, f"WITH {O.LOG} SELECT test_class, count(*) AS kept FROM log WHERE NOT contains(lower(sql), 'from part') AND NOT contains(lower(sql), 'nation') GROUP BY 1"),
    (phase_filter, f"WITH {O.LOG} SELECT test_class, count(*) AS kept, min(seq) AS first_seq FROM tested GROUP BY 1"),
    (issue_suppression, _tail(f"SELECT {_ISSUE_COLUMNS} FROM sm WHERE code <> 'order-by-rand' AND NOT (code = 'null-comparison' AND table_name = 'orders' AND column_name = 'o_clerk')")),
    (severity_override, _tail("SELECT test_class, code, CASE code WHEN 'select-all' THEN 'ERROR' WHEN 'order-by-rand' THEN 'INFO' ELSE severity END AS severity, query, table_name, column_name FROM sm")),
    (baseline_classify, _tail(f"SELECT {_ISSUE_COLUMNS}, CASE WHEN coalesce({_ACK}, FALSE) THEN 'acknowledged' WHEN severity = 'INFO' THEN 'info' ELSE 'confirmed' END AS bucket FROM sm")),
    (all_rules, _tail(f"SELECT {_ISSUE_COLUMNS} FROM sm")),
    (impact_rank, _ranked()),
    (issue_dedup, _tail(DEDUP_TAIL)),
    (pattern_frequency, f"WITH {O.LOG} SELECT nsql, count(*) AS executions FROM norm GROUP BY 1"),
    (table_frequency, TABLES_SQL),
    (timeline, f"WITH {O.LOG} SELECT test_class, CAST(row_number() OVER (PARTITION BY test_class ORDER BY seq) AS INTEGER) AS position, seq, nsql, count(*) OVER (PARTITION BY test_class, nsql) AS pattern_count FROM tested"),
    (issue_breakdown, _tail("SELECT code, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings, count(*) FILTER (severity = 'INFO') AS infos FROM sm GROUP BY 1")),
    (top_k, _ranked("ORDER BY rank LIMIT 5")),
    (failable, _tail(f"SELECT {_ISSUE_COLUMNS} FROM sm WHERE NOT coalesce({_ACK}, FALSE) AND severity <> 'INFO' AND code IN ('null-comparison', 'order-by-rand')")),
    (budget_violations, f"WITH {O.LOG} SELECT test_class, count(*) AS queries FROM tested GROUP BY 1 HAVING count(*) > 800"),
    (n_plus_one_gate, f"WITH {O.LOG} SELECT test_class, max(n) AS worst, count(*) AS patterns FROM (SELECT test_class, nsql, count(*) AS n FROM tested WHERE op = 'SELECT' GROUP BY ALL) WHERE n >= 10 GROUP BY 1"),
    (count_upsert, UPSERT_SQL),
    (log_capture, CAPTURE_SQL),
    (stack_frames, f"WITH {O.LOG} SELECT seq, stack_trace AS frames FROM log WHERE stack_trace IS NOT NULL"),
    (index_catalog, f"WITH {O.LOG} SELECT * FROM cat"),
    (catalog_from_entities, _ENTITY_SQL),
    (catalog_merge, f"WITH {O.LOG}, e AS ({_ENTITY_SQL}) SELECT * FROM cat UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM cat WHERE cat.table_name = e.table_name AND lower(cat.index_name) = lower(e.index_name))"),
    (catalog_prefer, _ENTITY_SQL),
    (index_shape, f"WITH {O.LOG} SELECT table_name, index_name, string_agg(column_name, ',' ORDER BY seq_in_index) AS cols, bool_and(NOT non_unique) AS is_unique FROM cat GROUP BY 1, 2"),
    (column_resolution, f"WITH {O.LOG}, {O.COLUMNS} SELECT DISTINCT test_class, nsql, col AS column_name, tab AS table_name FROM cmp"),
    (has_table, f"WITH {O.LOG}, {O.COLUMNS} SELECT DISTINCT test_class, nsql, col AS column_name, tab AS table_name FROM cmp WHERE tab IN (SELECT table_name FROM cat)"),
    (has_index_on, f"WITH {O.LOG}, {O.COLUMNS} SELECT DISTINCT test_class, nsql, col AS column_name, tab AS table_name FROM known WHERE indexed"),
    (unique_covered, UNIQUE_SQL),
    (baseline_parse, "SELECT * FROM (VALUES ('select-all', 'customer', NULL, 'ann', 'wide reads'), ('null-comparison', 'ORDERS', 'O_CLERK', 'bob', 'legacy'), ('order-by-rand', 'nation', NULL, 'c', 'x')) v(code, table_name, column_name, acknowledged_by, reason)"),
    (count_baseline_parse, "SELECT * FROM (VALUES ('a.B', 'x', 1, 2, 3, 4, 10), ('a.C', 'z', 0, 0, 0, 0, 0)) v(test_class, test_name, selects, inserts, updates, deletes, total)"),
    (baseline_lines, _tail("SELECT DISTINCT code || '|' || coalesce(table_name, '') || '|' || coalesce(column_name, '') || '|ann|known' AS value FROM sm")),
    (count_lines, f"WITH {O.LOG}, {_COUNTS} SELECT concat_ws('|', test_class, 't', selects, inserts, updates, deletes, total) AS value FROM counts"),
    (ci_annotations, _tail("SELECT '::' || CASE severity WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'notice' END || ' title=' || code || '::' || replace(replace(concat_ws(' ', concat_ws('.', table_name, column_name), query), '%', '%25'), chr(10), '%0A') AS value FROM sm")),
    (issue_json, None),
    (report_json, None),
    (explain_plans, None),
    (full_audit, None),
    (flagship, None),
]


#: Over the findings of all rules, those on sequences, events and plans too; the queries of these names hold the same code to SQL on the others.
WHOLE = (issue_suppression, severity_override, baseline_classify, issue_dedup, issue_breakdown, top_k, failable, baseline_lines, ci_annotations)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f"rule_{code.replace('-', '_')}": partial(_rule, code) for code in O.rule_sql()}
    out |= {f"text_{name}": partial(_text, e) for name, (e, _) in TEXT.items()}
    out |= {f"whole_{f.__name__}": partial(f, found=_whole) for f in WHOLE}
    return out | {f.__name__: f for f, _ in OTHERS}


def oracle_sql() -> dict[str, str]:
    out = {f"rule_{code.replace('-', '_')}": sql for code, sql in O.rule_sql().items()}
    out |= {f"text_{name}": _text_sql(sql) for name, (_, sql) in TEXT.items() if sql}
    return out | {f.__name__: sql for f, sql in OTHERS if sql}
