"""Rules over groups of statements, ordered statements, ORM events and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlscope.config import AuditConfig
from sqlscope.functions import text as T
from sqlscope.operators import order
from sqlscope.operators.catalog_rules import issue
from sqlscope.operators.order import meet
from sqlscope.schema import TEST


def n_plus_one_suspect(f: DataFrame, config: AuditConfig) -> DataFrame:
    got = f.filter((F.col("op") == "SELECT") & (F.col("n") >= config.n_plus_one))
    return issue(got, "n-plus-one-suspect", "INFO", query="sql", table="t", column=None, detail=F.concat(F.col("n").cast("string"), F.lit(" executions")))


def duplicate_query(log: DataFrame, config: AuditConfig) -> DataFrame:
    """Exact repeats, without patterns that repeat often enough to be N+1 suspects. From a normalized log."""
    patterns = log.filter("op = 'SELECT'").groupBy(*TEST, "nsql").count().filter(F.col("count") >= config.n_plus_one).drop("count")
    same = log.filter("op = 'SELECT'").groupBy(*TEST, "nsql", "sql").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(patterns, [*TEST, "nsql"], "left_anti")
    same = same.withColumn("table_name", F.get(T.tables(F.col("sql")), F.lit(0)))
    return issue(same, "duplicate-query", "WARNING", query="sql", column=None, detail=F.col("n").cast("string"))


def repeated_insert(f: DataFrame, config: AuditConfig) -> DataFrame:
    multi = T.has(F.col("m"), r"\bVALUES\s*\([^)]*\)\s*,\s*\(")
    return issue(f.filter((F.col("op") == "INSERT") & ~multi & (F.col("n") >= config.repeated_insert)), "repeated-single-insert", "WARNING", table="dml", column=None)


def mergeable(reps: DataFrame, config: AuditConfig) -> DataFrame:
    """SELECTs of one test alike in table, select list and joins (with their conditions) but not in pattern. From one row per pattern."""
    s = reps.filter("op = 'SELECT'")
    shape = T.remove_subqueries(F.col("nsql"))
    joined = F.array_join(F.array_sort(F.transform(T.joins(shape), lambda j: F.concat_ws(" ", j["kind"], j["table"], F.trim(j["body"])))), ",")
    s = s.select(*TEST, "seq", "nsql", "n", F.get(T.tables(shape), F.lit(0)).alias("table_name"), F.regexp_replace(F.trim(T.select_list(shape)), r"\s+", " ").alias("cols"), joined.alias("joined"))
    g = s.filter("table_name is not null and cols is not null").groupBy(*TEST, "table_name", "cols", "joined").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("patterns"), F.min_by("nsql", "seq").alias("nsql"))
    return issue(g.filter((F.col("n") >= config.mergeable) & (F.col("patterns") > 1)), "mergeable-queries", "INFO", column=None, detail=F.concat(F.col("patterns").cast("string"), F.lit(" patterns")))


def slow_query(f: DataFrame, config: AuditConfig) -> DataFrame:
    got = f.filter((F.col("timed") > 0) & (F.col("median_ms") > config.slow_warn_ms))
    return issue(got, "slow-query", F.when(F.col("median_ms") > config.slow_error_ms, "ERROR").otherwise("WARNING"), table="t", column=None, detail=F.concat(F.col("median_ms").cast("string"), F.lit(" ms")))


def _source(sql: Column) -> Column:
    """The first FROM table."""
    return T.plain(T.first(sql, rf"\bFROM\s+({T.NAME})"))


def _runs(log: DataFrame, kind: Column) -> DataFrame:
    """``log`` with the number of its run: statements of a test in a row that agree in ``kind``.

    A test is ordered range by range of seq; only borders of ranges meet across a test.
    """
    at = (*TEST, "range_")
    x = log.withColumns({"range_": F.floor(F.col("seq") / order.RANGE), "kind_": kind})
    w = Window.partitionBy(*at).orderBy("seq")
    x = x.withColumn("before_", F.lag("kind_").over(w))
    x = x.withColumn("change_", (F.col("before_").isNotNull() & (F.col("before_") != F.col("kind_"))).cast("int"))
    x = x.withColumn("run", F.sum("change_").over(w))
    borders = x.groupBy(*at).agg(F.min_by("kind_", "seq").alias("first_"), F.max_by("kind_", "seq").alias("last_"), F.sum("change_").alias("changes_"))
    across = Window.partitionBy(*TEST).orderBy("range_")
    borders = borders.withColumn("new_", F.coalesce(F.lag("last_").over(across) != F.col("first_"), F.lit(True)).cast("int"))
    borders = borders.withColumn("base_", F.sum(F.col("changes_") + F.col("new_")).over(across) - F.col("changes_"))
    joined = meet(x, borders.select(*at, "base_"), at)
    return joined.withColumn("run", F.col("run") + F.col("base_")).drop("range_", "kind_", "before_", "change_", "base_")


def collection_reinsert(log: DataFrame, config: AuditConfig) -> DataFrame:
    """A DELETE by one to four columns followed at once by INSERTs into its table; with several columns all inserted values must agree with the deleted ones."""
    table = F.when(F.col("op") == "SELECT", _source(F.col("sql"))).otherwise(T.dml_table(F.col("sql")))
    x = _runs(log.select(*TEST, "seq", "sql", "op", table.alias("target")), F.struct("op", "target"))
    # the DELETE is the last of its run; the INSERT run follows it
    last = x.filter("op = 'DELETE'").groupBy(*TEST, "run", "target").agg(F.max_by("sql", "seq").alias("sql"), F.max("seq").alias("seq"))
    w = F.coalesce(T.where_body(F.col("sql")), F.lit(""))
    pairs = F.arrays_zip(T.every(w, r"(?:\w+\.)?(\w+)\s*=\s*(?:\?|\d+|'[^']*')", 1), T.every(w, r"(?:\w+\.)?\w+\s*=\s*(\?|\d+|'[^']*')", 1))
    last = last.withColumn("refs", T.where_refs(w)).withColumn("eq", pairs)
    last = last.filter((F.size("refs") >= 1) & (F.size("refs") <= config.collection_max_where) & ((F.size("refs") == 1) | ((F.size("eq") == F.size("refs")))))
    last = last.select(*TEST, (F.col("run") + 1).alias("run"), "target", "seq", F.col("sql").alias("deleted"), "refs", "eq")
    cols = F.array_distinct(F.transform(F.split(T.first(F.col("sql"), r"\bINTO\s+[\w`\".]+\s*\(([^)]*)\)"), ","), lambda c: T.plain(F.trim(c))))
    vals = F.transform(F.split(T.first(F.col("sql"), r"\bVALUES\s*\(([^)]*)\)"), ","), F.trim)
    inserts = x.filter("op = 'INSERT' and target is not null").select(*TEST, "run", "target", F.map_from_arrays(cols, F.slice(vals, 1, F.size(cols))).alias("given"))
    j = meet(inserts, last, (*TEST, "run", "target"))
    agree = (F.size("refs") == 1) | F.forall("eq", lambda e: F.coalesce((F.try_element_at("given", F.lower(e["0"])) == e["1"]) | (e["1"] == "?") | (F.try_element_at("given", F.lower(e["0"])) == "?"), F.lit(False)))
    runs = j.groupBy(*TEST, "seq", F.col("deleted").alias("sql"), "target").agg(F.count(F.lit(1)).alias("k"), F.min(agree).alias("all_agree")).filter((F.col("k") >= config.collection_min_inserts) & F.col("all_agree"))
    once = runs.groupBy(*TEST, "target").agg(F.min_by(F.struct("sql", "k"), "seq").alias("x")).select(*TEST, F.col("target").alias("table_name"), "x.*")
    return issue(once, "collection-delete-reinsert", "WARNING", query="sql", column=None, detail=F.concat(F.col("k").cast("string"), F.lit(" inserts")))


def derived_delete(log: DataFrame, config: AuditConfig) -> DataFrame:
    """A SELECT with WHERE on a table, then (SELECTs may lie between) DELETEs from it by one equality each."""
    refs = T.where_refs(F.coalesce(F.when(F.col("op") == "DELETE", T.where_body(F.col("sql"))), F.lit("")))
    single = F.coalesce((F.size(refs) == 1) & (F.get(refs, F.lit(0))["op"] == "="), F.lit(False))
    x = log.filter("op <> 'SELECT'").select(*TEST, "seq", T.dml_table(F.col("sql")).alias("target"), ((F.col("op") == "DELETE") & single).alias("ok"), "op")
    x = _runs(x, F.struct("op", "target", "ok")).filter("ok and target is not null")
    # how many DELETEs of a run there are from each on
    run = x.groupBy(*TEST, "run").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") >= config.derived_delete)
    deletes = meet(x, run.select(*TEST, "run", "many"), (*TEST, "run"))
    deletes = deletes.withColumn("range_", F.floor(F.col("seq") / order.RANGE))
    within = deletes.groupBy(*TEST, "run", "range_").agg(F.count(F.lit(1)).alias("here"))
    across = Window.partitionBy(*TEST, "run").orderBy("range_")
    within = within.withColumn("earlier", F.sum("here").over(across) - F.col("here"))
    at = (*TEST, "run", "range_")
    deletes = meet(deletes, within.select(*at, "earlier"), at)
    nth = F.row_number().over(Window.partitionBy(*at).orderBy("seq"))
    deletes = deletes.select(*TEST, "seq", "target", (F.col("many") - F.col("earlier") - nth + 1).alias("k"))

    s = log.filter("op = 'SELECT'").filter(T.has_where(F.col("sql"))).select(*TEST, "seq", "sql", _source(F.col("sql")).alias("target"), F.lit(True).alias("is_select"), F.lit(None).cast("struct<t:string,k:bigint>").alias("dml"))
    other = meet(log.filter("op <> 'SELECT'").select(*TEST, "seq"), deletes, (*TEST, "seq"), "left_outer")
    other = other.select(*TEST, "seq", F.lit(None).cast("string").alias("sql"), F.lit(None).cast("string").alias("target"), F.lit(False).alias("is_select"), F.struct(F.col("target").alias("t"), F.col("k").cast("bigint").alias("k")).alias("dml"))
    both = s.unionByName(other).withColumn("range_", F.floor(F.col("seq") / order.RANGE))
    # the next statement that is no SELECT: in its range of seq, or the first of a later one
    ahead = Window.partitionBy(*TEST, "range_").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("next_dml", F.last("dml", ignorenulls=True).over(ahead))
    firsts = both.groupBy(*TEST, "range_").agg(F.min_by("dml", F.when(~F.col("is_select"), F.col("seq"))).alias("first_"))
    later = Window.partitionBy(*TEST).orderBy(F.desc("range_")).rowsBetween(Window.unboundedPreceding, -1)
    at = (*TEST, "range_")
    firsts = firsts.select(*at, F.last("first_", ignorenulls=True).over(later).alias("far"))
    both = meet(both.filter("is_select"), firsts, at).withColumn("next_dml", F.coalesce("next_dml", "far"))
    got = both.filter((F.col("next_dml.t") == F.col("target")) & (F.col("next_dml.k") >= config.derived_delete))
    once = got.groupBy(*TEST, "target").agg(F.min_by(F.struct("sql", "next_dml"), "seq").alias("x"))
    once = once.select(*TEST, F.col("target").alias("table_name"), F.col("x.sql").alias("sql"), F.col("x.next_dml.k").alias("k"))
    return issue(once, "derived-delete-loads-entities", "WARNING", query="sql", column=None, detail=F.concat(F.col("k").cast("string"), F.lit(" deletes")))


def lazy_n_plus_one(lazy: DataFrame, config: AuditConfig, approximate: bool = False) -> DataFrame:
    """Roles loaded lazily for several owners in one test."""
    owners = F.approx_count_distinct("owner_id") if approximate else F.count_distinct("owner_id")
    g = lazy.groupBy(*TEST, "role").agg(owners.alias("owners"), F.max("owner_entity").alias("owner_entity")).filter(F.col("owners") >= config.n_plus_one)
    kind = F.when(F.col("role").startswith("proxy:"), "proxy").otherwise("collection")
    g = g.withColumn("nsql", F.concat(F.lit("Lazy load: "), F.col("role"))).withColumn("table_name", F.col("owner_entity"))
    return issue(g, "n-plus-one", "ERROR", column=None, detail=F.concat(kind, F.lit(" of "), F.col("owners").cast("string"), F.lit(" owners")))


def find_by_id(explicit: DataFrame, lazy: DataFrame, log: DataFrame) -> DataFrame:
    """Entities loaded by id, never lazily, whose key a later INSERT or UPDATE names."""
    simple = F.regexp_replace("entity", r"^.*\.", "")
    firsts = explicit.groupBy(*TEST, "entity", "entity_id").agg(F.min("ts").alias("loaded"))
    owner = lazy.select(*TEST, F.regexp_replace(F.regexp_replace("role", "^proxy:", ""), r"^.*\.", "").alias("simple"), F.col("owner_id").alias("entity_id")).distinct()
    firsts = firsts.withColumn("simple", simple).join(owner, [*TEST, "simple", "entity_id"], "left_anti")
    camel = F.concat(F.lower(F.substring("simple", 1, 1)), F.expr("substring(simple, 2)"))
    snake = F.lower(F.regexp_replace("simple", "(?<=[a-z0-9])(?=[A-Z])", "_"))
    names = firsts.withColumn("word", F.explode(F.array_distinct(F.array(F.concat(snake, F.lit("_id")), F.lower(F.concat(camel, F.lit("Id")))))))
    # the last write that names a key tells whether any came after the load
    word = F.explode(F.array_distinct(F.transform(T.every(F.col("sql"), r"\b\w+id\b", 0), F.lower))).alias("word")
    writes = log.filter("op in ('INSERT', 'UPDATE')").select(*TEST, "ts", word).groupBy(*TEST, "word").agg(F.max("ts").alias("written"))
    got = names.join(writes, [*TEST, "word"]).filter(F.col("written") > F.col("loaded"))
    got = got.select(*TEST, "entity", "entity_id").distinct().withColumn("nsql", F.concat(F.lit("findById: "), F.col("entity"), F.lit("#"), F.col("entity_id")))
    return issue(got.withColumn("table_name", F.col("entity")), "find-by-id-for-association", "INFO", column=None)


def statement_counts(log: DataFrame) -> DataFrame:
    """Statements of each test by operation; total is the sum of the four."""
    named = (("selects", "SELECT"), ("inserts", "INSERT"), ("updates", "UPDATE"), ("deletes", "DELETE"))
    g = log.groupBy(*TEST).agg(*[F.count_if(F.col("op") == o).cast("bigint").alias(n) for n, o in named])
    return g.withColumn("total", F.col("selects") + F.col("inserts") + F.col("updates") + F.col("deletes"))


def count_regression(counts: DataFrame, baseline: DataFrame) -> DataFrame:
    """Tests that run many more statements than their baseline: in all, or SELECTs alone."""
    b = baseline.select("test_class", "test_name", F.col("selects").alias("b_selects"), F.col("total").alias("b_total"))
    j = counts.join(b, ["test_class", "test_name"])
    grown = (F.col("b_total") > 0) & (F.col("total") * 2 >= F.col("b_total") * 3) & (F.col("total") - F.col("b_total") >= 5)
    reads = (F.col("b_selects") > 0) & (F.col("selects") >= 2 * F.col("b_selects")) & (F.col("selects") - F.col("b_selects") >= 5)
    severity = F.when(grown, F.when(F.col("total") >= 3 * F.col("b_total"), "ERROR").otherwise("WARNING")).when(reads, "WARNING")
    got = j.withColumn("sev", severity).filter("sev is not null")
    return issue(got, "query-count-regression", F.col("sev"), query=None, table=None, column=None, detail=F.concat_ws(" -> ", F.col("b_total").cast("string"), F.col("total").cast("string")))
