"""Rules that look columns up in the index catalogue. Tables the catalogue doesn't know stay silent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlscope.config import AuditConfig
from sqlscope.functions import text as T
from sqlscope.functions.text import has
from sqlscope.operators import features
from sqlscope.schema import TEST
from sqlscope.sources import catalog as C

# Column names of few values, and of soft deletes.
LOW_CARDINALITY = "type status role gender category level kind state enabled active visible locked verified approved published archived".split()
SOFT_DELETE = "deleted_at deleted is_deleted removed_at deactivated_at discarded_at unsuspended_at".split()

KEY = (*TEST, "nsql")


def issue(df: DataFrame, code: str, severity: str | Column, query: str | None = "nsql", table: str | None = "table_name", column: str | None = "column_name", detail: Column | None = None) -> DataFrame:
    text = lambda c: F.col(c) if c else F.lit(None).cast("string")
    return df.select(
        *TEST,
        F.lit(code).alias("code"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        text(query).alias("query"),
        text(table).alias("table_name"),
        text(column).alias("column_name"),
        (F.lit(code) if detail is None else detail).alias("detail"),
        F.lit(None).cast("string").alias("source_location"),
    )


def _true(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def known_where(f: DataFrame, catalog: DataFrame) -> DataFrame:
    """WHERE columns on known tables, with facts, and what else the pattern compares on the table."""
    w = C.lookup(C.has_table(features.where_columns(f).filter("table_name is not null"), catalog), catalog)
    w = w.withColumn("is_indexed", F.col("leading").isNotNull()).withColumn("equal", F.col("cmp").isin("=", "IS", "IS NOT"))
    on_table = Window.partitionBy(*KEY, "table_name")
    return w.withColumns(
        {
            "unique_equal": F.max(_true("in_unique") & F.col("equal")).over(on_table),
            "indexed_others": F.max(F.col("is_indexed")).over(on_table),
            "columns_on_table": F.size(F.collect_set("column_name").over(on_table)),
        }
    )


def missing_where(w: DataFrame) -> DataFrame:
    """The ladder of skips and severities for an unindexed WHERE column."""
    name = F.col("column_name")
    null_check = F.col("cmp").isin("IS", "IS NOT")
    soft = name.isin(*SOFT_DELETE)
    few = name.isin(*LOW_CARDINALITY) | name.rlike("^(?:is_|has_|flag)") | name.rlike("^.+(?:_type|_status)$") | _true("few")
    leading_like = F.col("cmp").isin("LIKE", "NOT LIKE", "ILIKE", "NOT ILIKE") & F.expr(r"sql rlike concat('(?i)\\b', column_name, '\\s+(?:NOT\\s+)?I?LIKE\\s+''%')")
    severity = (
        F.when(F.col("is_indexed") | F.col("unique_equal") | leading_like, None)
        .when(null_check & ~soft, None)
        .when(soft & F.col("cmp").isin("IS", "="), F.when(F.col("columns_on_table") == 1, "INFO"))
        .when(few, F.when(~F.col("indexed_others"), "INFO"))
        .when(F.col("indexed_others"), "WARNING")
        .otherwise("ERROR")
    )
    first = w.filter("op = 'SELECT'").withColumn("sev", severity).filter("sev is not null")
    first = first.groupBy(*KEY, "table_name", "column_name").agg(F.min_by("sev", "pos").alias("sev"))
    return issue(first, "missing-where-index", F.col("sev"))


def missing_join(f: DataFrame, catalog: DataFrame) -> DataFrame:
    p = f.filter(F.size("pairs") > 0).select(*KEY, "aliases", F.explode("pairs").alias("p"))
    sides = p.select(*KEY, "aliases", F.explode(F.array(F.struct(F.col("p.lq").alias("qualifier"), F.col("p.lc").alias("column_name")), F.struct(F.col("p.rq").alias("qualifier"), F.col("p.rc").alias("column_name")))).alias("x"))
    sides = C.resolve_column(sides.select(*KEY, "aliases", "x.qualifier", "x.column_name")).drop("aliases", "qualifier").filter("table_name is not null").distinct()
    got = C.lookup(C.has_table(sides, catalog), catalog).filter("leading is null")
    return issue(got, "missing-join-index", "ERROR")


def _per_table(w: DataFrame) -> DataFrame:
    return w.groupBy(*KEY, "table_name").agg(F.max("unique_equal").alias("unique_equal"), F.max("indexed_others").alias("indexed_others"))


def missing_order(f: DataFrame, w: DataFrame, catalog: DataFrame) -> DataFrame:
    o = features.listed(f.filter("op = 'SELECT'"), _order()).filter("table_name is not null")
    o = C.lookup(C.has_table(o, catalog), catalog).filter("leading is null")
    o = o.join(_per_table(w), [*KEY, "table_name"], "left_outer").filter(~_true("unique_equal"))
    o = o.groupBy(*KEY, "table_name", "column_name").agg(F.max(_true("indexed_others")).alias("some"))
    return issue(o, "missing-order-by-index", F.when(F.col("some"), "INFO").otherwise("WARNING"))


def _order() -> Column:
    from sqlscope.functions import text as T

    return T.order_columns(F.col("om"))


def _group() -> Column:
    from sqlscope.functions import text as T

    return T.group_columns(F.col("om"))


def missing_group(f: DataFrame, w: DataFrame, catalog: DataFrame) -> DataFrame:
    g = features.listed(f.filter("op = 'SELECT'"), _group()).filter("table_name is not null")
    pk = C.table_facts(catalog).select("table_name", "pk")
    g = C.has_table(g, catalog).join(pk, "table_name")
    listed = F.collect_set("column_name").over(Window.partitionBy(*KEY, "table_name"))
    g = g.withColumn("all_pk", (F.size("pk") > 0) & (F.size(F.array_except("pk", listed)) == 0)).filter(~F.col("all_pk"))
    g = C.lookup(g, catalog).filter("leading is null").join(_per_table(w), [*KEY, "table_name"], "left_outer").filter(~_true("indexed_others"))
    return issue(g.select(*KEY, "table_name", "column_name").distinct(), "missing-group-by-index", "WARNING")


def composite_leading(f: DataFrame, catalog: DataFrame) -> DataFrame:
    """A composite index whose first column is not compared while a later one is, WHERE columns closed over join equalities."""
    kind = "array<struct<t:string,c:string>>"
    aliases = F.col("aliases")
    named = lambda qualifier, column: F.struct(T.resolve(qualifier, aliases).alias("t"), column.alias("c"))
    used = F.array_distinct(F.filter(F.transform("refs", lambda r: named(r["qualifier"], r["column"])), lambda x: x["t"].isNotNull()))
    pairs = F.transform("pairs", lambda p: F.struct(named(p["lq"], p["lc"]).alias("l"), named(p["rq"], p["rc"]).alias("r")))
    x = f.filter("op in ('SELECT', 'UPDATE', 'DELETE')").filter(F.size("refs") > 0).select(*KEY, used.cast(kind).alias("used"), F.filter(pairs, lambda p: p["l"]["t"].isNotNull() & p["r"]["t"].isNotNull()).alias("pairs"))

    def step(acc: Column, _: Column) -> Column:
        reached = lambda a, b: F.transform(F.filter("pairs", lambda p: F.array_contains(acc, p[a])), lambda p: p[b])
        return F.array_union(F.array_union(acc, reached("l", "r")), reached("r", "l")).cast(kind)

    # as many steps as there are equalities reach the end of every chain
    closed = F.when(F.size("pairs") == 0, F.col("used")).otherwise(F.aggregate("pairs", F.col("used"), step))
    cols = x.select(*KEY, F.explode(closed).alias("x")).groupBy(*KEY, F.col("x.t").alias("table_name")).agg(F.collect_set("x.c").alias("used"))
    shape = C.index_shape(catalog).filter(F.size("cols") > 1)
    lead = C.index_shape(catalog).groupBy("table_name").agg(F.collect_set(F.get("cols", F.lit(0))).alias("leads"))
    j = cols.join(shape, "table_name").join(lead, "table_name")
    later = F.filter("cols", lambda c, i: (i > 0) & F.array_contains(F.col("used"), c) & ~F.array_contains(F.col("leads"), c))
    j = j.filter(~F.array_contains(F.col("used"), F.get("cols", F.lit(0)))).withColumn("later", later).filter(F.size("later") > 0)
    return issue(j.withColumn("column_name", F.get("cols", F.lit(0))), "composite-index-leading", "WARNING", detail=F.col("index_name"))


def covering(f: DataFrame, catalog: DataFrame, config: AuditConfig) -> DataFrame:
    """The first index (by name) with a WHERE column that lacks one to three of the selected plain columns."""
    from sqlscope.functions import text as T

    plain = F.filter(F.split(F.coalesce(T.select_list(F.col("om")), F.lit("")), ","), lambda x: x.rlike(r"^\s*(?:\w+\.)?\w+\s*$"))
    chosen = F.transform(plain, lambda x: T.plain(F.trim(x)))
    s = f.filter("op = 'SELECT'").filter(~T.has_select_all(F.col("m"))).select(*KEY, chosen.alias("chosen"), F.transform("refs", lambda r: r["column"]).alias("compared"), F.explode("tables").alias("table_name"), "t", F.size("tables").alias("many"))
    s = s.filter("many = 1 and size(compared) > 0 and size(chosen) > 0")
    pk = C.table_facts(catalog).select("table_name", "pk")
    j = s.join(C.index_shape(catalog).filter("index_name <> 'PRIMARY'"), "table_name").join(pk, "table_name")
    j = j.filter(F.size(F.array_intersect("cols", "compared")) > 0).withColumn("missing", F.array_except(F.array_except("chosen", "cols"), "pk"))
    j = j.filter((F.size("missing") > 0) & (F.size("missing") <= config.covering_extra))
    one = j.groupBy(*KEY, "table_name").agg(F.min_by("missing", "index_name").alias("missing"), F.min("index_name").alias("index_name"))
    return issue(one.withColumn("column_name", F.array_join(F.array_sort("missing"), ",")), "covering-index-opportunity", "INFO", detail=F.col("index_name"))


def order_limit(f: DataFrame, catalog: DataFrame) -> DataFrame:
    o = features.listed(f.filter("op = 'SELECT'").filter(has(F.col("om"), r"\bLIMIT\b")), _order()).filter("table_name is not null")
    o = C.lookup(C.has_table(o, catalog), catalog).filter(~_true("leading"))
    one = o.groupBy(*KEY).agg(F.min_by(F.struct("table_name", "column_name"), "pos").alias("x")).select(*KEY, "x.*")
    return issue(one, "order-by-limit-no-index", "WARNING")


def redundant(f: DataFrame, catalog: DataFrame) -> DataFrame:
    touched = f.select(*TEST, F.explode("tables").alias("table_name")).distinct()
    a, b = (C.index_shape(catalog).select("table_name", F.col("index_name").alias(f"{x}_name"), F.col("cols").alias(f"{x}_cols"), F.col("is_unique").alias(f"{x}_unique")) for x in "ab")
    pairs = a.filter("a_name <> 'PRIMARY'").join(b, "table_name").filter((F.size("a_cols") < F.size("b_cols")) & (F.slice("b_cols", 1, F.size("a_cols")) == F.col("a_cols")) & ~(F.col("a_unique") & ~F.col("b_unique")))
    got = touched.join(pairs.select("table_name", F.col("a_name").alias("column_name"), "b_name").distinct(), "table_name")
    return issue(got, "redundant-index", "WARNING", query=None, detail=F.concat_ws(" covers ", "b_name", "column_name"))


def write_amplification(f: DataFrame, catalog: DataFrame, config: AuditConfig) -> DataFrame:
    names = catalog.filter("index_name is not null").filter(~F.upper("index_name").rlike("^(?:FK_|CONSTRAINT_|SYS_|FKIDX_)"))
    many = names.groupBy("table_name").agg(F.count_distinct(F.lower("index_name")).alias("k")).filter(F.col("k") > config.write_amplification)
    touched = f.select(*TEST, F.explode(F.array_union("tables", F.array_compact(F.array("dml")))).alias("table_name")).distinct()
    return issue(touched.join(many, "table_name"), "write-amplification", "WARNING", query=None, column=None, detail=F.col("k").cast("string"))


def dml_without_index(w: DataFrame) -> DataFrame:
    d = w.filter("op in ('UPDATE', 'DELETE')").groupBy(*KEY, "table_name").agg(F.max(_true("leading")).alias("some")).filter("not some")
    return issue(d, "dml-without-index", "WARNING", column=None)


def unstable_pages(f: DataFrame, catalog: DataFrame) -> DataFrame:
    o = features.listed(f.filter("op = 'SELECT'").filter(has(F.col("om"), r"\bLIMIT\b")), _order())
    known = C.table_facts(catalog).select("table_name", F.lit(True).alias("known"), "unique_cols")
    o = o.join(known, "table_name", "left_outer")
    stable = ~_true("known") | _true(F.array_contains("unique_cols", F.col("column_name")))
    one = o.groupBy(*KEY).agg(F.max(stable).alias("stable"), F.min_by("table_name", "pos").alias("table_name")).filter("not stable")
    return issue(one, "non-deterministic-pagination", "INFO", column=None)


def locking(f: DataFrame, w: DataFrame) -> DataFrame:
    lock = r"(?is)\bFOR\s+(?:UPDATE|SHARE)\b"
    locked = w.filter(F.col("sql").rlike(lock))
    no_where = f.filter(F.col("m").rlike(lock) & (F.col("w") == "") & F.coalesce("known", F.lit(False))).select(*KEY, F.col("t").alias("table_name"), F.lit(None).cast("string").alias("column_name"))
    unindexed = locked.filter("not is_indexed").select(*KEY, "table_name", "column_name").distinct()
    shared = locked.filter("is_indexed and all_non_unique").select(*KEY, "table_name", "column_name").distinct()
    ranges = locked.filter("not is_indexed").filter(F.col("cmp").isin(">", "<", ">=", "<=", "BETWEEN")).select(*KEY, "table_name", "column_name").distinct()
    out = issue(no_where.unionByName(unindexed), "for-update-no-index", "ERROR")
    return out.unionByName(issue(shared, "for-update-non-unique", "WARNING")).unionByName(issue(ranges, "range-lock-risk", "WARNING"))


def evaluate(f: DataFrame, catalog: DataFrame, config: AuditConfig, w: DataFrame | None = None) -> list[DataFrame]:
    """``w``: known_where(), if it is at hand."""
    w = known_where(f, catalog) if w is None else w
    return [
        missing_where(w), missing_join(f, catalog), missing_order(f, w, catalog), missing_group(f, w, catalog), composite_leading(f, catalog), covering(f, catalog, config),
        order_limit(f, catalog), redundant(f, catalog), write_amplification(f, catalog, config), dml_without_index(w), unstable_pages(f, catalog), locking(f, w),
    ]
