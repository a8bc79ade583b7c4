"""SQL text functions on single statements, and properties on generated ones."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sqlscope.functions import text as T


def value(spark, sql, f):
    return spark.createDataFrame([(sql,)], "q string").select(f(F.col("q")).alias("v")).first().v


NORMALIZE = [
    ("SELECT  a\nFROM t WHERE x = 'it''s' AND y = 12.5", "select a from t where x = ? and y = ?"),
    ("select * from t where id in (1, 2,3)", "select * from t where id in (?)"),
    ("select 1 /* a /* nested */ b */ + 2 -- end", "select ? + ?"),
    ("select '-- no comment' from t", "select ? from t"),
    ("select \"Col\" from t where a = 0xFF and b = 1e-5", 'select "col" from t where a = ? and b = ?'),
    ("select 'a\\'b' from t", "select ? from t"),
    ("select 'open", "select ?"),
    ("", ""),
]


@pytest.mark.parametrize(("sql", "expected"), NORMALIZE)
def test_normalize(spark, sql, expected):
    assert value(spark, sql, T.normalize) == expected


@pytest.mark.parametrize(
    ("sql", "expected"),
    [
        ("select a from t where x in (select y from u where z in (select 1))", "select a from t where x in (?)"),
        ("select (select count(*) from u where f(u.x) = 1) from t", "select (?) from t"),
        ("select f(a, (b)) from t", "select f(a, (b)) from t"),
        ("select a from t where x = '(select' and y = (select ')' from u)", "select a from t where x = '(select' and y = (?)"),
    ],
)
def test_remove_subqueries(spark, sql, expected):
    assert value(spark, sql, T.remove_subqueries) == expected


def test_strip_cte(spark):
    assert value(spark, "WITH a AS (SELECT f(1)), b (x) AS (SELECT ')') SELECT * FROM a", T.strip_cte) == "SELECT * FROM a"


@pytest.mark.parametrize(
    ("sql", "expected"),
    [("select 1", "SELECT"), (" UPDATE t set a = 1", "UPDATE"), ("selected x", "OTHER"), ("with a as (select 1) select 2", "OTHER"), ("delete from t", "DELETE"), ("", "OTHER")],
)
def test_op(spark, sql, expected):
    assert value(spark, sql, T.op) == expected


def test_tables_and_aliases(spark):
    sql = "select * from shop.Orders o left join `Items` as i on o.id = i.order_id, extra e where 1 = 1"
    assert value(spark, sql, T.tables) == ["orders", "items"]
    got = {(a.alias, a.table) for a in value(spark, sql, T.aliases)}
    assert got >= {("o", "orders"), ("i", "items")}


def test_where_refs(spark):
    w = " a.x = ? and y not like ? or z is not null and b.c > 3 and q between 1 and 2 and a.x = b.k"
    got = [(r.qualifier, r.column, r.op) for r in value(spark, w, T.where_refs)]
    assert got == [("a", "x", "="), (None, "y", "NOT LIKE"), (None, "z", "IS NOT"), ("b", "c", ">"), (None, "q", "BETWEEN"), ("a", "x", "="), ("b", "k", "=")]


def test_lists_and_offsets(spark):
    sql = "select a, b from t group by t.a, f(b) order by a desc, t.b limit 10, 20"
    assert [(c.qualifier, c.column) for c in value(spark, sql, T.order_columns)] == [(None, "a"), ("t", "b")]
    assert [(c.qualifier, c.column) for c in value(spark, sql, T.group_columns)] == [("t", "a")]
    assert value(spark, sql, T.offset_value) == 10
    assert value(spark, "select 1 limit 5 offset 99999999999999999999", T.offset_value) is None
    assert value(spark, "a, f(b, c), d", T.split_top_level) == ["a", " f(b, c)", " d"]
    assert value(spark, "a, 'x, (' , (select f(1, 2), g((((((((3, 4)))))))) from t), d", T.split_top_level) == ["a", " 'x, (' ", " (select f(1, 2), g((((((((3, 4)))))))) from t)", " d"]


def test_any_depth_and_length(spark):
    """Ten and fifty levels of parentheses, statements of a megabyte, literals with parentheses."""
    for levels in (3, 10, 50):
        inner = "(select 1 from u where (v = " * levels + "'b)('" + "))" * levels
        sql = f"select a, {inner} x from t where k = {inner} and z = ')'"
        assert value(spark, sql, T.remove_subqueries) == "select a, (?) x from t where k = (?) and z = ')'"
        assert value(spark, f"with c as {inner}, d (e) as (select 2) {sql}", T.strip_cte) == sql
        assert value(spark, sql, T.select_list).strip() == f"a, {inner} x"
        assert value(spark, f"a, {inner}, b", T.split_top_level) == ["a", f" {inner}", " b"]
    assert value(spark, "select a from t where x = (select 1" + "(" * 20, T.remove_subqueries) == "select a from t where x = (select 1" + "(" * 20
    assert value(spark, "a /* 1 /* 2 /* 3 /* 4 */ */ */ */ b", T.strip_comments).split() == ["a", "b"]
    values = ",".join(f"'v{k}'" for k in range(100_000))
    long = f"select a from t where x in ({values}) and y = (select max(z) from u where k in ({values}))"
    assert value(spark, long, T.remove_subqueries) == f"select a from t where x in ({values}) and y = (?)"
    assert value(spark, long, T.normalize) == "select a from t where x in (?) and y = (select max(z) from u where k in (?))"


def test_or_conditions(spark):
    assert value(spark, "a = 1 or a = 2 or a in (3, 4)", T.or_count) == 2
    assert value(spark, "a = 1 or a = 2", T.same_or_column) is True
    assert value(spark, "a = 1 or f(b)", T.or_columns) == []
    assert value(spark, "(? is null or a = ?) and (? is null or b = ?)", T.effective_or_count) == 0


def test_functions(spark):
    got = [(f.function, f.column) for f in value(spark, "year(t.d) = ? and x = lower(?) and coalesce(y, 0) > 1", T.where_functions)]
    assert got == [("YEAR", "d"), ("COALESCE", "y")]
    joined = "select * from a left join b on lower(a.x) = b.y join c on upper(a.z) = c.z"
    assert [(f.function, f.column) for f in value(spark, joined, T.join_functions)] == [("UPPER", "z")]


sql_text = st.text(alphabet=st.sampled_from(list("abSELECTfromWHERE 0123456789'\"()*,.=<>-/\n;?%|")), max_size=120)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(sql_text, min_size=1, max_size=40))
def test_no_statement_fails_and_normalize_is_idempotent(spark, texts):
    df = spark.createDataFrame([(x,) for x in texts], "q string")
    once = df.select(T.normalize(F.col("q")).alias("n"), T.remove_subqueries(F.col("q")), T.strip_cte(F.col("q")), T.where_refs(F.col("q")), T.aliases(F.col("q")), T.select_list(F.col("q")), T.join_pairs(F.col("q")))
    rows = once.select("n", T.normalize(F.col("n")).alias("again")).collect()
    quotes_left = [r for r in rows if "'" not in r.n and "/*" not in r.n and "--" not in r.n]
    assert all(r.n == r.again for r in quotes_left)


def test_long_statements_take_little_time(spark):
    import time

    long = "select a from t where x in (" + ",".join(f"'v{k}'" for k in range(20_000)) + ") or " + " or ".join(f"a{k} = {k}" for k in range(1000)) + " and ((((((((1))))))))"
    start = time.time()
    n = value(spark, long, T.normalize)
    assert n.startswith("select a from t where x in (?) or a0 = ?")
    value(spark, long, T.remove_subqueries)
    value(spark, n, T.where_refs)
    assert time.time() - start < 20
