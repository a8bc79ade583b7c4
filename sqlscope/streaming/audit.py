"""The audit on a stream of statements: pattern counts per time window, first sightings, and the declared rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlscope.config import AuditConfig
from sqlscope.operators import features, predicate_rules
from sqlscope.schema import QUERY_LOG, TEST


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of log files in Parquet with the columns of QUERY_LOG."""
    return spark.readStream.schema(QUERY_LOG).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(log: DataFrame, delay: str) -> DataFrame:
    return features.normalized(log).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)


def repeated_patterns(log: DataFrame, config: AuditConfig | None = None, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """SELECT patterns of a test that repeat within a window; late statements count up to ``delay``."""
    config = config or AuditConfig()
    g = _timed(log, delay).filter("op = 'SELECT'").groupBy(F.window("at", window), *TEST, "nsql").agg(F.count(F.lit(1)).alias("n"))
    return g.filter(F.col("n") >= config.n_plus_one).select(F.col("window.start").alias("from_time"), *TEST, "nsql", "n")


def first_sightings(log: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each pattern of a test once within the watermark."""
    return _timed(log, delay).dropDuplicatesWithinWatermark([*TEST, "nsql"])


def findings(log: DataFrame, catalog: DataFrame, config: AuditConfig | None = None, delay: str = "10 minutes") -> DataFrame:
    """The declared rules on first sightings; the catalogue is static."""
    config = config or AuditConfig()
    first = first_sightings(log, delay).withColumns({"n": F.lit(1).cast("bigint"), "median_ms": F.lit(None).cast("bigint"), "timed": F.lit(0).cast("bigint")})
    reps = first.select(*TEST, "nsql", "seq", "sql", "op", "stack_trace", "n", "median_ms", "timed")
    return predicate_rules.evaluate(features.with_catalog(features.texts(reps), catalog), config)
