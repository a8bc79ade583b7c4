"""Rules that need one pattern only: declared as expressions, evaluated in one pass over the features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlscope.config import AuditConfig
from sqlscope.functions import text as T
from sqlscope.functions.text import IDENT, NAME, has
from sqlscope.schema import TEST

# Word lists of single rules.
STRING_TOKENS = "name email phone code token key slug handle address title url path type description desc note comment text content message label tag remark".split()
NUMERIC_TOKENS = "id count num no seq order size length".split()
WINDOW_FUNCTIONS = "ROW_NUMBER|RANK|DENSE_RANK|NTILE|LAG|LEAD|FIRST_VALUE|LAST_VALUE|NTH_VALUE|SUM|COUNT|AVG|MIN|MAX"
NUMBERING = ("ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE")
GROUP_EXEMPT = "COUNT SUM AVG MIN MAX GROUP_CONCAT ROLLUP CUBE GROUPING".split()
FUNCTION_EXEMPT = ("COALESCE", "IFNULL", "IF", "NULLIF")
MIGRATION = r"migration|flyway|liquibase"

FOUND = "struct<code:string,severity:string,table_name:string,column_name:string,detail:string>"


def found(code: str, severity: str | Column, table: Column | None = None, column: Column | None = None, detail: Column | None = None) -> Column:
    text = F.lit(None).cast("string")
    return F.struct(
        F.lit(code).alias("code"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        (text if table is None else table).alias("table_name"),
        (text if column is None else column).alias("column_name"),
        (F.lit(code) if detail is None else detail).alias("detail"),
    )


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def single_rules(config: AuditConfig, only: frozenset[str] | None = None) -> list[Column]:
    """One finding or null each; of the codes in ``only``, if given."""
    q, s, m, o, om, w, wm, wl, op, t, dml = (F.col(c) for c in ("sql", "s", "m", "o", "om", "w", "wm", "wl", "op", "t", "dml"))
    select, ons = op == "SELECT", F.array_join("ons", " ")
    lock = has(m, r"\bFOR\s+(?:UPDATE|SHARE)\b")
    group_by, order_by, limit = has(om, r"\bGROUP\s+BY\b"), has(om, r"\bORDER\s+BY\b"), has(om, r"\bLIMIT\b|\bFETCH\s+FIRST\b")
    aggregate = has(om, r"\b(?:COUNT|SUM|AVG|MIN|MAX)\s*\(")
    join = has(om, r"\bJOIN\b")
    rules: list[Column] = []

    def rule(code: str, severity: str | Column, when: Column, table: Column | None = t, column: Column | None = None, detail: Column | None = None) -> None:
        if only is None or code in only:
            rules.append(F.when(_false(when), found(code, severity, table, column, detail)))

    rule("select-all", "INFO", T.has_select_all(m))
    or_cols = T.or_columns(w)
    index_merge = _false(F.col("known")) & (F.size(or_cols) > 0) & (F.size(F.array_except(or_cols, F.coalesce("indexed", F.array().cast("array<string>")))) == 0)
    rule("or-abuse", "WARNING", (T.effective_or_count(w) >= config.or_clause) & ~T.same_or_column(w) & ~index_merge)
    offset = T.offset_value(s)
    rule("offset-pagination", F.when(offset.isNotNull(), "WARNING").otherwise("INFO"), (offset >= config.offset_pagination) | (offset.isNull() & T.has_offset(m)), detail=F.concat(F.lit("OFFSET "), F.coalesce(offset.cast("string"), F.lit("?"))))
    wild = has(s, r"\b(?:NOT\s+)?I?LIKE\s+'%")
    rule("like-leading-wildcard", F.when(wild, "WARNING").otherwise("INFO"), wild | has(s, r"\b(?:NOT\s+)?I?LIKE\s+\?"))
    bare_join = has(om, rf"(?<!\bCROSS\s)(?<!\bNATURAL\s)\bJOIN\s+{NAME}(?:\s+(?:AS\s+)?(?!(?:ON|USING|JOIN|LEFT|RIGHT|INNER|CROSS|WHERE|ORDER|GROUP|LIMIT|HAVING|NATURAL|FULL)\b){IDENT})?\s*(?:$|(?=\b(?:JOIN|LEFT|RIGHT|INNER|CROSS|WHERE|ORDER|GROUP|LIMIT|HAVING)\b))")
    comma = has(om, rf"\bFROM\s+{NAME}(?:\s+(?:AS\s+)?(?!WHERE\b){IDENT})?\s*,\s*(?:{IDENT}|\(\?)")
    rule("cartesian-join", "ERROR", (bare_join & ~has(om, r"\bJOIN\s+LATERAL\b")) | (comma & ~T.has_where(om)))
    rule("implicit-join", "WARNING", comma & ~has(om, rf"\bFROM\s+{IDENT}\s*\((?!\?)"))
    rule(
        "count-instead-of-exists", "INFO",
        has(s, rf"\bSELECT\s+COUNT\s*\(\s*(?:\*|(?:{IDENT}\.)?{IDENT})\s*\)") & T.has_where(s) & ~has(s, r"COUNT\s*\(\s*DISTINCT\b") & ~has(s, r"\(\s*SELECT\s+COUNT\s*\(") & ~has(s, r"COUNT\s*\([^)]*\)\s*>=?\s*\d") & ~has(s, r"\bGROUP\s+BY\b") & ~has(s, r"\bHAVING\b"),
    )
    rule("union-without-all", "INFO", has(m, r"\bUNION\b(?!\s+ALL\b)") & ~has(m, r"\bSELECT\s+DISTINCT\b"), table=None)
    chosen = T.select_list(om)
    items = F.transform(T.split_top_level(F.coalesce(chosen, F.lit(""))), lambda x: T.plain(F.trim(F.regexp_replace(x, r"(?i)^\s*(?:DISTINCT|ALL)\s+", ""))))
    pk_chosen = _false(F.size(F.array_intersect(items, F.coalesce("pk", F.array().cast("array<string>")))) > 0)
    why = F.when(group_by, "GROUP BY").when(pk_chosen, "primary key").when(join, "JOIN")
    rule("distinct-misuse", "WARNING", select & has(om, r"\bSELECT\s+DISTINCT\b") & why.isNotNull(), detail=why)
    equal_null = T.first(w, rf"(?<!IS\s)(?:{IDENT}\.)?\b({IDENT})\s*=\s*NULL\b")
    other_null = T.first(w, rf"(?:{IDENT}\.)?\b({IDENT})\s*(?:!=|<>)\s*NULL\b")
    rule("null-comparison", "ERROR", equal_null.isNotNull() | other_null.isNotNull(), column=T.plain(F.coalesce(equal_null, other_null)))
    concat = T.first(w, rf"\b({IDENT})\s*\|\|")
    rule("string-concat-where", "WARNING", concat.isNotNull() & ~F.lower(concat).isin(*T.KEYWORDS, *T.MORE_KEYWORDS), column=T.plain(concat))
    case_left = F.regexp_replace(F.regexp_replace(wm, T.rx(r"(?:[=<>]|!=)\s*\(?\s*CASE\b"), " "), T.rx(r"\bIN\s*\(\s*CASE\b"), " ")
    rule("case-in-where", "WARNING", has(wm, r"\bCASE\b") & has(case_left, r"\bCASE\b"))
    rule("regexp-usage", "WARNING", has(wm, r"\b(?:REGEXP|RLIKE)\b") | has(ons, r"\b(?:REGEXP|RLIKE)\b"))
    rule("find-in-set", "WARNING", has(wm, r"\bFIND_IN_SET\s*\(") | has(ons, r"\bFIND_IN_SET\s*\("))
    grouped = T.first(om, r"\bGROUP\s+BY\b(.*?)(?=\bHAVING\b|\bORDER\s+BY\b|\bLIMIT\b|\bUNION\b|$)")
    call = rf"\b(?!(?:{'|'.join(GROUP_EXEMPT)})\b)(\w+)\s*\(\s*(?:\w+\.)?(?!(?:{'|'.join(T.KEYWORDS)})\b)([A-Za-z_]\w*)"
    rule("group-by-function", "WARNING", T.first(grouped, call, 2).isNotNull(), column=T.plain(T.first(grouped, call, 2)))
    in_list = T.first(s, r"\bIN\s*\(((?!\s*SELECT\b)[^)]+)\)")
    values = F.regexp_count(in_list, F.lit(",")) + 1
    # the first list that is not only placeholders
    rule("large-in-list", F.when(values > 10 * config.large_in_list, "ERROR").otherwise("WARNING"), ~in_list.rlike(r"^[\s?,]*$") & (values > config.large_in_list), detail=F.concat(values.cast("string"), F.lit(" values")))
    rule("too-many-joins", "WARNING", F.regexp_count("om", F.lit(T.rx(r"\bJOIN\b"))) > config.too_many_joins)
    rule("not-in-subquery", "ERROR", has(m, r"\bNOT\s+IN\s*\(\s*SELECT\b"))
    rule("order-by-rand", "ERROR", has(m, r"\bORDER\s+BY\s+(?:RAND|RANDOM|NEWID|DBMS_RANDOM)\s*\("))
    rule("count-star-no-where", "INFO", select & has(om, r"\bCOUNT\s*\(\s*(?:\*|1)\s*\)") & ~T.has_where(om) & ~group_by)
    one = has(om, r"\bLIMIT\s+(?:1|\?)\s*;?\s*$|\bFETCH\s+FIRST\s+(?:1|\?)\s+ROWS?\s+ONLY")
    rule("limit-without-order-by", "WARNING", select & limit & ~order_by & ~lock & ~aggregate & ~one & ~_false(F.col("stack_trace").rlike(r"\.existsBy\w*:")))
    over = rf"\b({WINDOW_FUNCTIONS})\s*\([^()]*\)\s*OVER\s*\(({T.balanced(3)})\)"
    calls = F.arrays_zip(T.every(m, over, 1), T.every(m, over, 2))
    whole = F.exists(calls, lambda c: ~has(c["1"], r"\bPARTITION\s+BY\b") & ~(F.upper(c["0"]).isin(*NUMBERING) & has(c["1"], r"\bORDER\s+BY\b")))
    rule("window-no-partition", "WARNING", select & whole)
    listed = F.filter(T.split_top_level(F.coalesce(chosen, F.lit(""))), lambda x: F.regexp_replace(x, r"(?i)^\s*(?:DISTINCT|ALL)\s+", "").rlike(r"^\s*(?:`?\w+`?\.)?`?\w+`?\s*$"))
    rule("excessive-column-fetch", "INFO", select & ~T.has_select_all(m) & ~group_by & ~has(chosen, r"\b(?:COUNT|SUM|AVG|MIN|MAX|GROUP_CONCAT|STRING_AGG)\s*\(") & (F.size(listed) > config.excessive_columns))
    scalar = T.every(T.select_list(m), rf"\(\s*SELECT\b({T.balanced()})\)")
    outer = F.transform("aliases", lambda a: a["alias"])
    correlated = F.exists(
        F.coalesce(scalar, F.array().cast("array<string>")),
        lambda x: F.size(F.array_intersect(F.array_except(F.transform(T.every(T.where_body(x), r"\b(\w+)\.\w+"), F.lower), F.transform(T.aliases(x), lambda a: a["alias"])), outer)) > 0,
    )
    rule("correlated-subquery", "WARNING", select & correlated)
    pk_like = has(s, r"\bWHERE\s+(?:\w+\.)?(?:id|\w+_id|email|uuid|username)\s*=\s*\?\s*$")
    no_or = ~has(wm, r"\bOR\b")
    equal = F.transform(F.filter("refs", lambda r: r["op"] == "="), lambda r: r["column"])
    at_most_one = no_or & _false(F.exists("uniques", lambda u: F.size(F.array_except(u, equal)) == 0))
    rule(
        "unbounded-result-set", "WARNING",
        select & has(s, r"\bFROM\b") & ~has(m, r"\b(?:COUNT|SUM|AVG|MIN|MAX)\s*\(") & ~has(m, r"\bSELECT\b.*\bINTO\b") & ~has(m, r"\bLIMIT\b|\bFETCH\s+FIRST\b") & ~lock & ~pk_like & ~has(m, r"\bIN\s*\(\s*SELECT\b") & ~has(m, r"\bEXISTS\s*\(\s*SELECT\b") & ~at_most_one,
    )
    rule("for-update-no-timeout", "WARNING", lock & ~has(m, r"\bNOWAIT\b|\bSKIP\s+LOCKED\b|\bWAIT\s+\d+"))
    hint = T.first(m, r"\b(FORCE|USE|IGNORE)\s+INDEX\s*\(")
    rule("force-index-hint", "INFO", hint.isNotNull() & ~_false(has(F.col("stack_trace"), MIGRATION)), detail=F.upper(hint))
    no_filter = ~T.has_where(om) & ~join
    rule("update-without-where", "ERROR", ((op == "UPDATE") & no_filter) | ((op == "DELETE") & no_filter & ~has(om, r"\bUSING\b")), table=dml)
    rule("subquery-in-dml", "WARNING", op.isin("UPDATE", "DELETE") & has(wm, r"\bIN\s*\(\s*SELECT\b"))
    rule("insert-select-all", "WARNING", (op == "INSERT") & has(om, rf"^\s*INSERT\b.*\bSELECT\s+(?:ALL\s+|DISTINCT\s+)?(?:{IDENT}\.)?\*"), table=dml)
    source = T.plain(T.first(m, rf"\bSELECT\b.*?\bFROM\s+({NAME})"))
    rule("insert-select-locks-source", "INFO", (op == "INSERT") & has(m, r"^\s*INSERT\b.*\bSELECT\b"), table=source)
    rule("insert-on-duplicate-key", "WARNING", has(m, r"^\s*INSERT\b.*\bON\s+DUPLICATE\s+KEY\s+UPDATE\b|^\s*REPLACE\s+INTO\b"), table=F.coalesce(dml, t))
    rule("implicit-columns-insert", "WARNING", has(m, rf"^\s*INSERT\s+INTO\s+{NAME}\s+VALUES\b"), table=dml)
    return rules


def many_rules(config: AuditConfig, only: frozenset[str] | None = None) -> list[Column]:
    """An array of findings each; of the codes in ``only``, if given."""
    om, w, wl, t, op = (F.col(c) for c in ("om", "w", "wl", "t", "op"))
    rules: list[tuple[str, Column]] = []

    def usage(severity: str):
        return lambda f: found("where-function", severity, t, f["column"], f["function"])

    for severity, calls in (("ERROR", T.where_functions(w)), ("WARNING", T.join_functions(om))):
        kept = F.filter(calls, lambda f: ~f["function"].isin(*FUNCTION_EXEMPT))
        rules.append(("where-function", F.transform(kept, usage(severity))))
    number = r"(?:\d+(?:\.\d+)?|\?)"
    left = T.every(w, rf"\b(?:{IDENT}\.)?({IDENT})\s*[-+*/]\s*{number}\s*(?:=|!=|<>|<=|>=|<|>)")
    right = T.every(w, rf"(?:=|!=|<>|<=|>=|<|>)\s*{number}\s*[-+*/]\s*(?:{IDENT}\.)?({IDENT})\b")
    names = F.array_distinct(F.filter(F.transform(F.concat(left, right), T.plain), lambda c: ~c.isin(*T.KEYWORDS, *T.MORE_KEYWORDS)))
    rules.append(("non-sargable", F.transform(names, lambda c: found("non-sargable", "ERROR", t, c))))
    # HAVING conditions without an aggregate or the alias of one
    conditions = F.split(F.coalesce(T.having_body(om), F.lit("")), T.rx(r"\s+(?:AND|OR)\s+"))
    called = F.transform(T.every(T.select_list(om), r"\b(?:COUNT|SUM|AVG|MAX|MIN)\s*\([^)]*\)\s+(?:AS\s+)?(\w+)"), F.lower)
    column = lambda c: T.plain(F.regexp_extract(c, T.rx(rf"^\s*(?:{IDENT}\.)?({IDENT})\s*(?:[=<>!]|LIKE\b|IN\b|IS\b|BETWEEN\b|NOT\b)"), 1))
    wrong = F.filter(conditions, lambda c: (F.trim(c) != "") & ~has(c, r"\b(?:COUNT|SUM|AVG|MAX|MIN)\s*\(") & ~_false(F.array_contains(F.coalesce(called, F.array().cast("array<string>")), column(c))))
    rules.append(("having-misuse", F.when(op == "SELECT", F.transform(wrong, lambda c: found("having-misuse", "WARNING", t, F.nullif(column(c), F.lit("")))))))
    # columns compared more than once: in one OR branch, or in several with the same literal
    branches = F.split(wl, T.rx(r"\bOR\b"))
    compared = rf"((?:{IDENT}\.)?{IDENT})\s*({T.COMPARE})\s*('[^']*'|[^\s()]+)?"
    refs = F.flatten(
        F.transform(
            branches,
            lambda b, i: F.transform(
                F.arrays_zip(*[T.every(b, compared, k) for k in (1, 2, 3)]),
                lambda z: F.struct(F.lower(z["0"]).alias("c"), F.upper(F.regexp_replace(z["1"], r"\s+", " ")).alias("o"), z["2"].alias("v"), i.alias("b")),
            ),
        )
    )
    refs = F.filter(refs, lambda r: ~T.plain(r["c"]).isin(*T.KEYWORDS, *T.MORE_KEYWORDS))
    twice = F.filter(
        refs,
        lambda r, i: F.exists(F.slice(refs, 1, i), lambda p: (p["c"] == r["c"]) & (p["o"] == r["o"]) & ((p["b"] == r["b"]) | ((p["v"] == r["v"]) & (r["v"] != "?")))),
    )
    rules.append(("redundant-filter", F.transform(F.array_distinct(F.transform(twice, lambda r: T.plain(r["c"]))), lambda c: found("redundant-filter", "INFO", t, c))))
    # LEFT JOINs whose alias appears nowhere outside joins
    rest = F.regexp_replace(om, T.rx(r"\bJOIN\b.*?(?=\b(?:LEFT|RIGHT|INNER|CROSS|FULL|NATURAL)\b|\bJOIN\b|\bWHERE\b|\bGROUP\s+BY\b|\bORDER\s+BY\b|\bLIMIT\b|\bHAVING\b|$)"), " ")
    used = F.transform(T.every(rest, r"\b(\w+)`?\s*\."), F.lower)
    idle = F.filter(T.joins(om), lambda j: (j["kind"] == "LEFT") & ~F.array_contains(used, j["alias"]) & ~F.array_contains(used, j["table"]))
    rules.append(("unused-join", F.when((op == "SELECT") & ~has(om, r"\bSELECT\s+\*\s+FROM\b"), F.transform(idle, lambda j: found("unused-join", "WARNING", t, None, j["alias"])))))
    return [rule for code, rule in rules if only is None or code in only]


def conversions(f: DataFrame) -> DataFrame:
    """implicit-type-conversion: textual columns compared with numbers; one finding per column=literal of a test."""
    p = r"\b(\w+)\s*=\s*(\d+)\b"
    e = f.select(*TEST, "nsql", "seq", "stack_trace", F.posexplode(F.arrays_zip(T.every(F.col("wl"), p, 1), T.every(F.col("wl"), p, 2))).alias("pos", "z"))
    e = e.select("*", F.col("z.0").alias("column_name"), F.col("z.1").alias("value")).withColumn("parts", F.split(F.lower("column_name"), "_"))
    e = e.filter(~F.element_at("parts", -1).isin(*NUMERIC_TOKENS) & F.exists("parts", lambda x: x.isin(*STRING_TOKENS)))
    firsts = e.groupBy(*TEST, "column_name", "value").agg(F.min_by(F.struct("nsql", "stack_trace"), F.struct("seq", "pos")).alias("x"))
    return firsts.select(*TEST, F.lit("implicit-type-conversion").alias("code"), F.lit("WARNING").alias("severity"), F.col("x.nsql").alias("query"), F.lit(None).cast("string").alias("table_name"), "column_name", F.concat_ws("=", "column_name", "value").alias("detail"), F.col("x.stack_trace").alias("source_location"))


def evaluate(f: DataFrame, config: AuditConfig, only: frozenset[str] | None = None) -> DataFrame:
    """All declared rules (or those of ``only``) in one pass: the features are read once, whatever the number of rules."""
    none = F.array().cast(f"array<{FOUND}>")
    single = F.array_compact(F.array(F.lit(None).cast(FOUND), *single_rules(config, only)))
    many = [F.coalesce(x, none) for x in many_rules(config, only)]
    rows = f.select(*TEST, "nsql", "sql", "stack_trace", F.explode(F.concat(single, *many)).alias("x"))
    query = F.when(F.col("x.code") == "excessive-column-fetch", F.col("sql")).otherwise(F.col("nsql"))
    return rows.select(*TEST, "x.code", "x.severity", query.alias("query"), "x.table_name", "x.column_name", "x.detail", F.col("stack_trace").alias("source_location"))
