"""Schemas of the tables that an audit reads and writes, and the catalogue of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERY_LOG = "run_id string, test_class string, test_name string, seq bigint, sql string, exec_nanos bigint, ts timestamp_ntz, stack_trace string, phase string"
INDEX_CATALOG = "table_name string, index_name string, column_name string, seq_in_index int, non_unique boolean, cardinality bigint"
LAZY_LOADS = "run_id string, test_class string, test_name string, role string, owner_entity string, owner_id string, ts timestamp_ntz"
EXPLICIT_LOADS = "run_id string, test_class string, test_name string, entity string, entity_id string, ts timestamp_ntz, stack_trace string"
ISSUE_BASELINE = "code string, table_name string, column_name string, acknowledged_by string, reason string"
COUNT_BASELINE = "test_class string, test_name string, selects bigint, inserts bigint, updates bigint, deletes bigint, total bigint"

#: One test of one run.
TEST = ("run_id", "test_class", "test_name")
ISSUE = (*TEST, "code", "severity", "query", "table_name", "column_name", "detail", "source_location")

SEVERITY_RANK = {"ERROR": 0, "WARNING": 1, "INFO": 2}
PHASES = ("SETUP", "TEST", "TEARDOWN")

# The finding codes with their default severities.
DEFAULT_SEVERITY = {
    "ERROR": "n-plus-one where-function missing-join-index cartesian-join non-sargable null-comparison update-without-where order-by-rand not-in-subquery for-update-no-index missing-where-index",
    "WARNING": "duplicate-query or-abuse offset-pagination missing-order-by-index missing-group-by-index composite-index-leading like-leading-wildcard redundant-index write-amplification "
    "correlated-subquery large-in-list distinct-misuse having-misuse implicit-type-conversion insert-select-all too-many-joins implicit-join string-concat-where unbounded-result-set "
    "repeated-single-insert slow-query collection-delete-reinsert derived-delete-loads-entities query-count-regression order-by-limit-no-index dml-without-index for-update-non-unique "
    "range-lock-risk for-update-no-timeout insert-on-duplicate-key group-by-function subquery-in-dml implicit-columns-insert regexp-usage find-in-set unused-join limit-without-order-by "
    "window-no-partition case-in-where full-scan",
    "INFO": "n-plus-one-suspect select-all redundant-filter count-instead-of-exists union-without-all mergeable-queries find-by-id-for-association covering-index-opportunity "
    "non-deterministic-pagination insert-select-locks-source count-star-no-where excessive-column-fetch force-index-hint filesort temporary-table",
}

# Points of a finding in the impact score; all others have 5.
IMPACT_POINTS = {
    "cartesian-join": 100, "n-plus-one": 50, "n-plus-one-suspect": 50, "missing-join-index": 40, "for-update-no-index": 40, "missing-where-index": 30, "correlated-subquery": 30,
    "where-function": 25, "non-sargable": 25, "offset-pagination": 20, "redundant-index": 15, "or-abuse": 15, "redundant-filter": 10, "select-all": 10,
}
SEVERITY_POINTS = {"ERROR": 100, "WARNING": 30, "INFO": 5}


def issue_types(spark: SparkSession) -> DataFrame:
    """code, default_severity, points: the dimension of findings."""
    rows = [(code, severity, IMPACT_POINTS.get(code, 5)) for severity, codes in DEFAULT_SEVERITY.items() for code in codes.split()]
    return spark.createDataFrame(rows, "code string, default_severity string, points int")


def conform(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the columns of ``schema`` in order and type; missing ones are null, others dropped."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    have = set(df.columns)
    wanted = StructType.fromDDL(schema)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
