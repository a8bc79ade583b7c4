"""What follows the rules: suppression, overrides, baselines, buckets, summaries, ranking, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlscope.config import AuditConfig
from sqlscope.functions import text as T
from sqlscope.operators import group_rules, order
from sqlscope.schema import IMPACT_POINTS, SEVERITY_POINTS, SEVERITY_RANK, TEST
from sqlscope.sources import files


def severity_rank(severity: Column) -> Column:
    out = F.lit(len(SEVERITY_RANK))
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def _mapped(values: dict, key: Column, default: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default) if pairs else default


def suppress(issues: DataFrame, config: AuditConfig) -> DataFrame:
    """Without codes, or code:table.column, that the settings suppress or whose rule they disable."""
    names = [x for x in {*config.suppress_issues, *config.disabled} if x]
    place = F.concat(F.col("code"), F.lit(":"), F.coalesce("table_name", F.lit("")), F.lit("."), F.coalesce("column_name", F.lit("")))
    return issues.filter(~F.col("code").isin(*names) & ~place.isin(*names)) if names else issues


def override(issues: DataFrame, config: AuditConfig) -> DataFrame:
    return issues.withColumn("severity", _mapped(config.severity, F.col("code"), F.col("severity")))


def by_return_type(issues: DataFrame, types: DataFrame | None) -> DataFrame:
    """Unbounded results by what the calling repository method returns, from rows (method, return_type):
    one entity, an optional or a page is no finding; a collection with a WHERE is worth a hint only."""
    if types is None:
        return issues
    known = types.select(F.col("method").alias("r_method"), F.upper("return_type").alias("r_type")).dropDuplicates(["r_method"])
    j = issues.join(known, files.return_type_of(F.col("source_location")) == F.col("r_method"), "left_outer")  # a row per repository method
    unbounded = F.col("code") == "unbounded-result-set"
    j = j.filter(~(unbounded & F.coalesce(F.col("r_type").isin("OPTIONAL", "SINGLE_ENTITY", "PAGE_OR_SLICE"), F.lit(False))))
    hint = unbounded & (F.col("r_type") == "COLLECTION") & T.has_where(F.col("query"))
    return j.withColumn("severity", F.when(F.coalesce(hint, F.lit(False)), "INFO").otherwise(F.col("severity"))).drop("r_method", "r_type")


def acknowledge(issues: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """Adds acknowledged: an entry with the code, and its table and column where it names them (any case)."""
    if baseline is None:
        return issues.withColumn("acknowledged", F.lit(False))
    b = baseline.select(F.col("code").alias("b_code"), F.lower("table_name").alias("b_table"), F.lower("column_name").alias("b_column")).distinct()
    per_code = b.groupBy("b_code").agg(F.collect_list(F.struct("b_table", "b_column")).alias("entries"))
    j = issues.join(per_code, F.col("code") == F.col("b_code"), "left_outer")  # a hand-written file
    fits = F.exists("entries", lambda e: (e["b_table"].isNull() | F.coalesce(e["b_table"] == F.lower("table_name"), F.lit(False))) & (e["b_column"].isNull() | F.coalesce(e["b_column"] == F.lower("column_name"), F.lit(False))))
    return j.withColumn("acknowledged", F.coalesce(fits, F.lit(False))).drop("b_code", "entries")


def classify(issues: DataFrame) -> DataFrame:
    """Adds bucket: acknowledged, else info, else confirmed."""
    bucket = F.when(F.col("acknowledged"), "acknowledged").when(F.col("severity") == "INFO", "info").otherwise("confirmed")
    return issues.withColumn("bucket", bucket)


def summary(log: DataFrame) -> DataFrame:
    """Per test: patterns, statements, time; setup and teardown count. From a normalized log without suppressed statements."""
    return log.groupBy(*TEST).agg(
        F.count_distinct("nsql").alias("unique_patterns"), F.count(F.lit(1)).alias("total_queries"), F.coalesce(F.sum("exec_nanos"), F.lit(0)).alias("total_nanos")
    )


def impact_rank(issues: DataFrame) -> DataFrame:
    """Findings of one code, table and column together, ranked by frequency, severity and kind."""
    g = issues.groupBy("code", "table_name", "column_name").agg(F.count(F.lit(1)).alias("frequency"), F.min(severity_rank(F.col("severity"))).alias("r"))
    best = F.element_at(F.array(*[F.lit(s) for s in SEVERITY_RANK]), F.col("r") + 1)
    score = F.col("frequency") * 15 + _mapped(SEVERITY_POINTS, best, F.lit(0)) + _mapped(IMPACT_POINTS, F.col("code"), F.lit(5))
    g = g.withColumn("severity", best).withColumn("score", score.cast("bigint")).drop("r")
    order = Window.orderBy(F.desc("score"), "code", F.col("table_name").asc_nulls_first(), F.col("column_name").asc_nulls_first())
    return g.withColumn("rank", F.row_number().over(order))  # one row per kind of finding: few, whatever the log


def deduplicate(issues: DataFrame) -> DataFrame:
    """One row per fingerprint across tests: count, up to ten tests, highest severity."""
    head = F.substring(T.normalize(F.coalesce("query", F.lit(""))), 1, 200)
    fp = F.concat_ws("|", "code", F.coalesce(F.lower("table_name"), F.lit("")), F.coalesce(F.lower("column_name"), F.lit("")), head)
    test = F.concat_ws(".", "test_class", "test_name")
    keys = ("fingerprint", "code")
    per = issues.withColumns({"fingerprint": fp, "test": test}).groupBy(*keys, "test").agg(F.count(F.lit(1)).alias("n"), F.min(severity_rank(F.col("severity"))).alias("r"))
    # ten tests of each are gathered, however many there are
    first = per.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("test"))).filter("nth <= 10")
    first = first.groupBy(*keys).agg(F.array_sort(F.collect_list("test")).alias("affected_tests"))
    g = per.groupBy(*keys).agg(F.sum("n").alias("occurrences"), F.min("r").alias("r"))
    g = order.meet(g, first, keys).select(*keys, "occurrences", "affected_tests", "r")
    return g.withColumn("severity", F.element_at(F.array(*[F.lit(s) for s in SEVERITY_RANK]), F.col("r") + 1)).drop("r")


def pattern_frequency(log: DataFrame) -> DataFrame:
    return log.groupBy("nsql").agg(F.count(F.lit(1)).alias("executions"))


def table_frequency(log: DataFrame) -> DataFrame:
    names = F.array_union(T.tables(F.col("nsql")), F.array_compact(F.array(T.dml_table(F.col("nsql")))))
    return log.groupBy("nsql").agg(F.count(F.lit(1)).alias("n")).select(F.explode(names).alias("table_name"), "n").groupBy("table_name").agg(F.sum("n").alias("accesses"))


def timeline(log: DataFrame) -> DataFrame:
    """Executions of each test in order, with how often their pattern runs there."""
    counts = log.groupBy(*TEST, "nsql").agg(F.count(F.lit(1)).alias("pattern_count"))
    return order.meet(order.positions(log), counts, (*TEST, "nsql")).select(*TEST, F.col("position").cast("int").alias("position"), "seq", "nsql", "pattern_count")


def breakdown(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code").pivot("severity", list(SEVERITY_RANK)).count().na.fill(0).withColumnsRenamed({s: s.lower() + "s" for s in SEVERITY_RANK})


def top(issues: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` of the impact ranking: TakeOrderedAndProject."""
    return impact_rank(issues).orderBy("rank").limit(k)


def failures(issues: DataFrame, config: AuditConfig) -> DataFrame:
    """Confirmed findings that fail a test: of the chosen codes, or all if none is chosen."""
    confirmed = issues.filter("bucket = 'confirmed'")
    return confirmed.filter(F.col("code").isin(*config.fail_on)) if config.fail_on else confirmed


def over_budget(log: DataFrame, limit: int) -> DataFrame:
    """Tests with more than ``limit`` statements."""
    return log.groupBy(*TEST).agg(F.count(F.lit(1)).alias("queries")).filter(F.col("queries") > limit)


def upsert_counts(baseline: DataFrame, counts: DataFrame) -> DataFrame:
    """The count baseline with this run's tests put over the old ones."""
    names = ["selects", "inserts", "updates", "deletes", "total"]
    new = counts.select("test_class", "test_name", *[F.col(n).alias(f"new_{n}") for n in names])
    j = baseline.join(new, ["test_class", "test_name"], "full_outer")
    return j.select("test_class", "test_name", *[F.coalesce(f"new_{n}", n).alias(n) for n in names])


def n_plus_one_gate(log: DataFrame, limit: int) -> DataFrame:
    """Tests that must not repeat a SELECT pattern ``limit`` times, with their worst pattern."""
    g = log.filter("op = 'SELECT'").groupBy(*TEST, "nsql").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit)
    return g.groupBy(*TEST).agg(F.max("n").alias("worst"), F.count(F.lit(1)).alias("patterns"))


statement_counts = group_rules.statement_counts


def settled(*settings: bool | None, default: bool = True) -> bool:
    """The first setting that is not None (of a test, its class, the whole run), else the default."""
    return next((x for x in settings if x is not None), default)


def gates(issues: DataFrame, log: DataFrame, config: AuditConfig, budget: int | None = None, n_plus_one: int | None = None, fail: tuple[bool | None, ...] = ()) -> DataFrame:
    """What fails a test: rows (test, gate, subject, value, limit) of the gates "finding", "budget" and "n-plus-one".

    From classified issues and a normalized log of tested statements. ``fail``: settings of whether findings
    fail a test, the nearest first (None: not set).
    """
    none = F.lit(None).cast("bigint")
    found = failures(issues, config).groupBy(*TEST, "code").agg(F.count(F.lit(1)).alias("value"))
    parts = [found.select(*TEST, F.lit("finding").alias("gate"), F.col("code").alias("subject"), "value", none.alias("limit"))]
    if not settled(*fail):
        parts[0] = parts[0].limit(0)
    if budget is not None:
        parts.append(over_budget(log, budget).select(*TEST, F.lit("budget"), F.lit("statements"), "queries", F.lit(budget).cast("bigint")))
    if n_plus_one is not None:
        parts.append(n_plus_one_gate(log, n_plus_one).select(*TEST, F.lit("n-plus-one"), F.concat(F.col("patterns").cast("string"), F.lit(" patterns")), "worst", F.lit(n_plus_one).cast("bigint")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
