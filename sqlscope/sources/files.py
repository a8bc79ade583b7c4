"""Log, event and baseline files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlscope.operators import order
from sqlscope.schema import COUNT_BASELINE, EXPLICIT_LOADS, LAZY_LOADS, PHASES, QUERY_LOG, TEST, conform

# Frames that begin so are not the application's.
FRAMEWORK = "java.lang.Thread sun. jdk.internal. org.springframework. org.hibernate. org.junit. org.gradle. net.ttddyy. com.zaxxer. org.apache. net.bytebuddy. com.github.gavlyukovskiy."
# The same for the stacks of entities loaded by id, and what marks the class of a proxy.
ORM_FRAMEWORK = "java. javax. jdk. org.hibernate. org.springframework. sun. com.sun."
PROXY = r"\$HibernateProxy\$|\$ByteBuddy\$|\$\$EnhancerByCGLIB\$\$|\$\$_jvst"


def read_log(spark: SparkSession, path: str, fmt: str = "parquet", max_queries: int | None = None) -> DataFrame:
    reader = spark.read.schema(QUERY_LOG) if fmt in ("json", "csv") else spark.read
    return capture(reader.format(fmt).load(path), max_queries)


def capture(log: DataFrame, max_queries: int | None = None) -> DataFrame:
    """A log in canonical form: blank statements go, unknown phases become TEST, seq is filled by time where null.

    ``max_queries`` keeps the first so many statements of each test, as a capture buffer does (AuditConfig.max_queries).
    """
    out = conform(log, QUERY_LOG).filter(F.trim("sql") != "")
    out = number_statements(out.withColumn("phase", F.when(F.upper("phase").isin(*PHASES), F.upper("phase")).otherwise("TEST")))
    if max_queries is not None:
        out = order.positions(out, order=("seq", "ts", "sql")).filter(F.col("position") <= max_queries).drop("position")
    return out


def number_statements(log: DataFrame) -> DataFrame:
    """Statements without seq follow those of their test that have one, by time; those of one instant by their text."""
    last = log.groupBy(*TEST).agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last_"), F.count_if(F.col("seq").isNull()).alias("without_")).filter("without_ > 0").drop("without_")
    minute = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60)
    nth = order.positions(log.filter("seq is null"), minute, ("ts", "sql"))
    filled = order.meet(nth, last, TEST).withColumn("seq", F.col("last_") + F.col("position")).drop("last_", "position")
    return log.filter("seq is not null").unionByName(filled.select(*log.columns))


def clean_stack(stack: F.Column | str, frames: int = 10, prefixes: str = FRAMEWORK):
    """The first ``frames`` lines of a stack trace that are the application's."""
    lines = F.split(stack, "\n")
    pattern = "^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes.split()) + ")"
    return F.array_join(F.slice(F.filter(lines, lambda x: ~x.rlike(pattern)), 1, frames), "\n")


def entity_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lazy loads, explicit loads) from rows (run_id, test_class, test_name, event, role, entity, entity_id, ts, stack_trace).

    ``event`` "collection": a collection of ``entity`` under ``role`` was initialised. "load": an entity was loaded;
    through a proxy, which its stack tells, it counts as a lazy load, else as an explicit one if findById is in the
    stack; any other load counts as none. Ids that are null are the text "null".
    """
    frames = F.split(F.coalesce("stack_trace", F.lit("")), "\n")
    proxy = F.exists(frames, lambda x: x.rlike(PROXY) | x.rlike(r"ByteBuddyInterceptor[^.(]*\.intercept\b") | x.rlike(r"AbstractLazyInitializer[^.(]*\.initialize\b"))
    by_id = F.exists(frames, lambda x: x.rlike(r"\.findById(?![\w$])"))
    x = raw.withColumns({"entity": F.regexp_replace("entity", rf"(?:{PROXY}).*$", ""), "entity_id": F.coalesce(F.col("entity_id").cast("string"), F.lit("null"))})
    collection, loaded = F.col("event") == "collection", F.col("event") == "load"
    lazy = x.filter(collection | (loaded & proxy))
    role = F.when(collection, F.coalesce("role", F.lit("unknown"))).otherwise(F.concat(F.lit("proxy:"), "entity"))
    lazy = conform(lazy.withColumn("role", role).withColumns({"owner_entity": F.col("entity"), "owner_id": F.col("entity_id")}), LAZY_LOADS)
    own = clean_stack(F.array_join(F.filter(frames, lambda f: ~f.rlike(PROXY)), "\n"), prefixes=ORM_FRAMEWORK)
    return lazy, conform(x.filter(loaded & ~proxy & by_id).withColumn("stack_trace", own), EXPLICIT_LOADS)


def return_type_of(stack: F.Column | str):
    """Repository method of a stack trace ("Class.method"), from the proxy's frame."""
    return F.nullif(F.regexp_extract(stack, r"(?m)^(?:jdk\.proxy\d+\.)?\$Proxy\d+\.(\w+):", 1), F.lit(""))


def read_lazy_loads(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), LAZY_LOADS)


def read_explicit_loads(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), EXPLICIT_LOADS)


def parse_issue_baseline(lines: DataFrame) -> DataFrame:
    """Lines ``code|table|column|by|reason``; comments and lines with fewer fields are skipped, empty table or column match any."""
    parts = F.split("value", r"\|", 5)
    kept = lines.filter(~F.trim("value").startswith("#") & (F.size(parts) == 5))
    field = lambda k: F.nullif(F.trim(parts[k]), F.lit(""))
    return kept.select(field(0).alias("code"), field(1).alias("table_name"), field(2).alias("column_name"), field(3).alias("acknowledged_by"), field(4).alias("reason")).filter("code is not null")


def parse_count_baseline(lines: DataFrame) -> DataFrame:
    """Lines ``class|method|select|insert|update|delete|total``; malformed ones are skipped."""
    parts = F.split("value", r"\|")
    kept = lines.filter(~F.trim("value").startswith("#") & (F.size(parts) == 7))
    names = [f.split()[0] for f in COUNT_BASELINE.split(", ")]
    cols = [F.trim(parts[k]).alias(n) if k < 2 else F.trim(parts[k]).try_cast("bigint").alias(n) for k, n in enumerate(names)]
    return kept.select(*cols).na.drop()


def read_issue_baseline(spark: SparkSession, path: str) -> DataFrame:
    return parse_issue_baseline(spark.read.text(path))


def read_count_baseline(spark: SparkSession, path: str) -> DataFrame:
    return parse_count_baseline(spark.read.text(path))
