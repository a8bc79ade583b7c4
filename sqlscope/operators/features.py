"""From a log to one feature row per statement pattern of a test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlscope.config import AuditConfig
from sqlscope.functions import text as T
from sqlscope.schema import TEST
from sqlscope.sources import catalog as C


def suppressed(log: DataFrame, config: AuditConfig) -> DataFrame:
    """Without statements that hold a suppressed text (any case)."""
    for p in config.suppress_queries:
        if p.strip():
            log = log.filter(~F.lower("sql").contains(p.strip().lower()))
    return log


def tested(log: DataFrame, config: AuditConfig) -> DataFrame:
    return log if config.include_setup else log.filter(F.col("phase") == "TEST")


def normalized(log: DataFrame) -> DataFrame:
    return log.withColumn("nsql", T.normalize(F.col("sql"))).withColumn("op", T.op(F.col("sql")))


def representatives(log: DataFrame) -> DataFrame:
    """First statement of each pattern of a test, with the pattern's counts: the one wide shuffle of most rules."""
    ms = F.floor(F.col("exec_nanos") / 1_000_000)
    order = F.struct(F.coalesce("seq", F.lit((1 << 63) - 1)), "ts", "sql")  # statements without a number come last
    return log.groupBy(*TEST, "nsql").agg(
        F.min_by(F.struct("seq", "sql", "op", "stack_trace"), order).alias("first"),
        F.count(F.lit(1)).alias("n"),
        F.floor(F.median(F.when(ms > 0, ms))).cast("bigint").alias("median_ms"),
        F.count_if(ms > 0).alias("timed"),
    ).select(*TEST, "nsql", "first.*", "n", "median_ms", "timed")


def texts(reps: DataFrame) -> DataFrame:
    """Text features of a representative: s without comments, o without subqueries, m and om masked, w the WHERE body."""
    f = reps.withColumn("s", T.strip_cte(T.strip_comments(F.col("sql"))))
    f = f.withColumns({"m": T.mask(F.col("s")), "o": T.remove_subqueries(F.col("s"))})
    f = f.withColumn("om", T.mask(F.col("o")))
    f = f.withColumns(
        {
            "w": F.coalesce(T.where_body(F.col("om")), F.lit("")),
            "wm": F.coalesce(T.where_body(F.col("m")), F.lit("")),
            "wl": F.coalesce(T.where_body(F.col("o")), F.lit("")),
            "tables": T.tables(F.col("om")),
            "aliases": T.aliases(F.col("om")),
            "dml": T.dml_table(F.col("m")),
            "ons": T.on_bodies(F.col("om")),
        }
    )
    return f.withColumns({"t": F.coalesce(F.get("tables", F.lit(0)), F.col("dml")), "refs": T.where_refs(F.col("w")), "pairs": T.join_pairs(F.col("om"))})


def with_catalog(f: DataFrame, catalog: DataFrame) -> DataFrame:
    """Facts of the first table beside the features. Spark broadcasts the catalogue if its size allows."""
    facts = C.table_facts(catalog)
    facts = facts.select(F.col("table_name").alias("t"), F.lit(True).alias("known"), "indexed", "pk", "uniques")
    return f.join(facts, "t", "left_outer")


def where_columns(f: DataFrame) -> DataFrame:
    """A row per WHERE column: pos, qualifier, column_name, cmp, table_name."""
    e = f.select(*TEST, "nsql", "sql", "op", "t", "aliases", F.posexplode("refs").alias("pos", "ref"))
    e = e.select(*TEST, "nsql", "sql", "op", "t", "pos", F.col("ref.qualifier").alias("qualifier"), F.col("ref.column").alias("column_name"), F.col("ref.op").alias("cmp"), "aliases")
    return C.resolve_column(e).drop("aliases")


def listed(f: DataFrame, columns) -> DataFrame:
    """A row per column of a list feature: pos, column_name, table_name."""
    e = f.select(*TEST, "nsql", "sql", "t", "aliases", F.posexplode(columns).alias("pos", "ref"))
    e = e.select(*TEST, "nsql", "sql", "t", "pos", F.col("ref.qualifier").alias("qualifier"), F.col("ref.column").alias("column_name"), "aliases")
    return C.resolve_column(e).drop("aliases")


def build(log: DataFrame, catalog: DataFrame, config: AuditConfig) -> DataFrame:
    """Features of all patterns that rules look at."""
    reps = representatives(normalized(tested(suppressed(log, config), config)))
    return with_catalog(texts(reps), catalog)
