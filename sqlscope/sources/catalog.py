"""Index catalogues: loaders, merge, and the facts that rules look up. All names are lower-cased on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlscope.functions import text as T
from sqlscope.schema import INDEX_CATALOG, conform

# One statement instead of one per table.
MYSQL_STATISTICS = (
    "(SELECT table_name, index_name, column_name, seq_in_index, non_unique = 1 AS non_unique, cardinality FROM information_schema.statistics WHERE table_schema = DATABASE()) s"
)
POSTGRES_INDEXES = """(SELECT t.relname AS table_name, i.relname AS index_name, a.attname AS column_name, k.ord AS seq_in_index,
 NOT x.indisunique AS non_unique, CAST(t.reltuples AS bigint) AS cardinality
 FROM pg_index x JOIN pg_class t ON t.oid = x.indrelid JOIN pg_class i ON i.oid = x.indexrelid JOIN pg_namespace n ON n.oid = t.relnamespace
 CROSS JOIN LATERAL unnest(x.indkey) WITH ORDINALITY AS k(num, ord) LEFT JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = k.num
 WHERE n.nspname = current_schema()) s"""


def load(df: DataFrame) -> DataFrame:
    """A catalogue in canonical form; rows without a table are dropped."""
    c = conform(df, INDEX_CATALOG)
    low = {n: F.lower(n) for n in ("table_name", "column_name")}
    return c.withColumns(low).filter("table_name is not null")


def from_jdbc(spark: SparkSession, url: str, dialect: str, properties: dict[str, str] | None = None) -> DataFrame:
    query = {"mysql": MYSQL_STATISTICS, "postgresql": POSTGRES_INDEXES}[dialect]
    return load(spark.read.jdbc(url, query, properties=properties or {}))


def from_entities(entities: DataFrame) -> DataFrame:
    """From rows (entity, index_name, column_list, is_unique): names in CamelCase become snake_case, sort directions go."""
    cols = F.posexplode(F.split("column_list", r"\s*,\s*")).alias("pos", "c")
    e = entities.select("entity", "index_name", "is_unique", cols)
    snake = lambda c: F.lower(F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", "_"))
    column = F.regexp_replace(F.trim("c"), r"(?i)\s+(?:ASC|DESC)$", "")
    return load(e.select(snake(F.col("entity")).alias("table_name"), "index_name", snake(column).alias("column_name"), (F.col("pos") + 1).alias("seq_in_index"), (~F.col("is_unique")).alias("non_unique"), F.lit(0).alias("cardinality")))


def merge(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """The primary's rows, and the secondary's indexes whose name (any case) the primary's table lacks."""
    names = primary.select(F.col("table_name").alias("t"), F.lower("index_name").alias("i")).distinct()
    more = secondary.join(names, (F.col("table_name") == F.col("t")) & F.lower("index_name").eqNullSafe(F.col("i")), "left_anti")
    return primary.unionByName(more)


def prefer(database: DataFrame, annotations: DataFrame) -> DataFrame:
    """The database's catalogue if it has any row, else the annotations'."""
    any_row = database.select(F.lit(True).alias("any")).limit(1)
    return database.unionByName(annotations.join(any_row, F.lit(True), "left_anti"))


def index_shape(catalog: DataFrame) -> DataFrame:
    """(table_name, index_name, cols in order, is_unique) of each named index."""
    c = catalog.filter("index_name is not null and column_name is not null")
    ordered = F.array_sort(F.collect_list(F.struct("seq_in_index", "column_name")))
    return c.groupBy("table_name", "index_name").agg(F.transform(ordered, lambda s: s["column_name"]).alias("cols"), (~F.max("non_unique")).alias("is_unique"))


def column_facts(catalog: DataFrame) -> DataFrame:
    """(table_name, column_name, leading, in_composite, in_unique, all_non_unique, few) of each indexed column."""
    c = catalog.filter("column_name is not null")
    shape = index_shape(catalog).select(F.col("table_name").alias("t"), F.col("index_name").alias("i"), (F.size("cols") > 1).alias("composite"))
    c = c.join(shape, (F.col("table_name") == F.col("t")) & (F.col("index_name") == F.col("i")), "left_outer")
    return c.groupBy("table_name", "column_name").agg(
        F.max(F.col("seq_in_index") == 1).alias("leading"),
        F.coalesce(F.max("composite"), F.lit(False)).alias("in_composite"),
        F.max(~F.col("non_unique")).alias("in_unique"),
        F.min("non_unique").alias("all_non_unique"),
        F.max((F.col("cardinality") > 0) & (F.col("cardinality") <= 10)).alias("few"),
    )


def table_facts(catalog: DataFrame) -> DataFrame:
    """(table_name, indexed columns, primary key columns, column sets of unique indexes): one row per table."""
    cols = catalog.groupBy("table_name").agg(
        F.collect_set("column_name").alias("indexed"), F.collect_set(F.when(F.col("index_name") == "PRIMARY", F.col("column_name"))).alias("pk"), F.collect_set(F.when(~F.col("non_unique"), F.col("column_name"))).alias("unique_cols")
    )
    sets = index_shape(catalog).filter("is_unique").groupBy(F.col("table_name").alias("t")).agg(F.collect_list("cols").alias("uniques"))
    out = cols.join(sets, F.col("table_name") == F.col("t"), "left_outer").drop("t")
    return out.withColumn("uniques", F.coalesce("uniques", F.array().cast("array<array<string>>")))


def lookup(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Columns (table_name, column_name) with what the catalogue has: left join, facts null where unindexed."""
    return refs.join(column_facts(catalog), ["table_name", "column_name"], "left_outer")


def has_table(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    return refs.join(catalog.select("table_name").distinct(), "table_name", "left_semi")


def covers_unique(equal: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows (table_name, cols) of which some unique index has no other column."""
    shape = index_shape(catalog).filter("is_unique").select("table_name", F.col("cols").alias("index_cols"))
    joined = equal.join(shape, "table_name").filter(F.size(F.array_except("index_cols", "cols")) == 0)
    return joined.drop("index_cols").distinct()


def resolve_column(refs: DataFrame) -> DataFrame:
    """Rows with qualifier and aliases get table_name."""
    return refs.withColumn("table_name", T.resolve(F.col("qualifier"), F.col("aliases")))
