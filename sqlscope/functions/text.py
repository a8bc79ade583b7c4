"""SQL text functions: Column in, Column out, all of them JVM regular expressions.

Parentheses are balanced by a nested pattern with possessive quantifiers, so no
Python runs and matching does not backtrack. A statement whose parentheses nest
deeper than DEPTH, which few do, is folded token by token instead (fold()), to any
depth. Block comments may nest COMMENTS deep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH, COMMENTS = 6, 24
LITERAL = r"'(?:[^'\\]++|''|\\.)*+(?:'|$)"
IDENT = r"(?:`[^`]+`|\"[^\"]+\"|[A-Za-z_][A-Za-z0-9_$]*)"
NAME = rf"(?:{IDENT}\.)?{IDENT}"
COMPARE = r"(?:=|!=|<>|<=|>=|<|>|(?:NOT\s+)?I?LIKE\b|(?:NOT\s+)?IN\b|IS\b(?:\s+NOT\b)?|BETWEEN\b)"

# Words that are no column or alias.
KEYWORDS = (
    "select from where and or not in is null between like join inner left right outer on order by group having limit offset as asc desc insert update delete set into values create drop alter "
    "table index exists case when then else end union all distinct count sum avg min max"
).split()
MORE_KEYWORDS = "cross natural using full for fetch true false lateral ilike with recursive interval force use ignore".split()
# Functions that keep an index from being used.
FUNCTIONS = "DATE|LOWER|UPPER|YEAR|MONTH|DAY|TRIM|SUBSTRING|CAST|LENGTH|COALESCE|IFNULL|CONCAT|ABS|ROUND|CEIL|FLOOR|EXTRACT|MD5|SHA1|SHA2|UNIX_TIMESTAMP|STR_TO_DATE|TO_CHAR|TO_DATE|JSON_EXTRACT|JSON_VALUE"

_NOT_ALIAS = "(?!(?:" + "|".join(sorted({*KEYWORDS, *MORE_KEYWORDS})) + r")\b)"


def balanced(depth: int = DEPTH) -> str:
    """A pattern for text whose parentheses close, literals skipped."""
    inner = rf"(?:[^()']++|{LITERAL})*+"
    for _ in range(depth):
        inner = rf"(?:[^()']++|{LITERAL}|\({inner}\))*+"
    return inner


def _nested_comment(depth: int = COMMENTS) -> str:
    inner = r"(?:[^*/]++|\*(?!/)|/(?!\*))*+"
    for _ in range(depth):
        inner = rf"(?:[^*/]++|\*(?!/)|/(?!\*)|/\*{inner}\*/)*+"
    return rf"/\*{inner}(?:\*/|$)"


def rx(pattern: str) -> str:
    return "(?is)" + pattern


def has(c: Column, pattern: str) -> Column:
    return c.rlike(rx(pattern))


def first(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    found = F.regexp_extract(c, rx(pattern), group)
    return F.when(found != "", found)


def every(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(rx(pattern)), F.lit(group))


def plain(name: Column) -> Column:
    """An identifier without quotes and schema, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, '[`"]', ""), r"^.*\.", ""))


def strip_comments(q: Column) -> Column:
    """Comments become a blank; literals and quoted names keep theirs. Block comments may nest."""
    comment = rf"(?:{_nested_comment()}|--[^\n]*)"
    before = rf"\G((?:[^'\"/-]++|{LITERAL}|\"[^\"]*+(?:\"|$)|/(?!\*)|-(?!-))*+){comment}"
    return F.when(q.contains("--") | q.contains("/*"), F.regexp_replace(q, "(?s)" + before, "$1 ")).otherwise(q)


def mask(q: Column) -> Column:
    """String literals as ?."""
    return F.regexp_replace(q, "(?s)" + LITERAL, "?")


def normalize(q: Column) -> Column:
    """The pattern of a statement: no comments, literals and numbers as ?, IN lists as one ?, single blanks, lower case."""
    n = mask(strip_comments(q))
    n = F.regexp_replace(n, r"(?i)\b(?:0x[0-9a-f]+|\d+(?:\.\d+)?(?:e[+-]?\d+)?)\b", "?")
    n = F.regexp_replace(n, r"(?i)\bIN\s*\(\s*\?(?:\s*,\s*\?)*+\s*\)", "IN (?)")
    return F.lower(F.trim(F.regexp_replace(n, r"\s+", " ")))


def is_deep(q: Column) -> Column:
    """Whether parentheses nest deeper than the patterns reach."""
    many = F.length(q) - F.length(F.replace(q, F.lit("("), F.lit(""))) > DEPTH
    return F.coalesce(many & has(F.regexp_replace(mask(q), rf"\({balanced()}\)", ""), r"\("), F.lit(False))


def fold(q: Column, opening: str, put: Callable[[Column], Column]) -> Column:
    """``q`` with each outermost parenthesis that ``opening`` starts as put(its text); one that never closes stays."""
    tokens = F.regexp_extract_all(q, F.lit(rx(rf"{LITERAL}|{opening}|\(|\)|[^'()]+")), F.lit(0))
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("held"), F.lit(0).alias("depth"))

    def step(acc: Column, t: Column) -> Column:
        inside, opens, held = acc["depth"] > 0, t.rlike(rx(rf"^{opening}$")), F.concat(acc["held"], t)
        depth = F.when(inside, acc["depth"] + F.when(t.startswith("("), 1).when(t == ")", -1).otherwise(0)).when(opens, 1).otherwise(0)
        closes = inside & (depth == 0)
        out = F.when(closes, F.concat(acc["out"], put(held))).when(inside | opens, acc["out"]).otherwise(F.concat(acc["out"], t))
        return F.struct(out.alias("out"), F.when(depth > 0, held).otherwise("").alias("held"), depth.alias("depth"))

    return F.aggregate(tokens, start, step, lambda acc: F.concat(acc["out"], acc["held"]))


def _blank(inner: Column) -> Column:
    """As long as it was, so places stay."""
    return F.concat(F.lit("("), F.repeat(F.lit("x"), F.length(inner) - 2), F.lit(")"))


def strip_cte(q: Column) -> Column:
    """Without a leading WITH list."""

    def head(b: str) -> str:
        return rf"^\s*WITH\s+(?:RECURSIVE\s+)?{IDENT}\s*(?:\([^()]*\)\s*)?AS\s*\({b}\)(?:\s*,\s*{IDENT}\s*(?:\([^()]*\)\s*)?AS\s*\({b}\))*+\s*"

    far = F.substr(q, F.length(F.regexp_extract(fold(q, r"\(", _blank), rx(head("[^()]*")), 0)) + 1)
    return F.when(has(q, r"^\s*WITH\b"), F.when(is_deep(q), far).otherwise(F.regexp_replace(q, rx(head(balanced())), ""))).otherwise(q)


def remove_subqueries(q: Column) -> Column:
    """Each (SELECT ...) as (?)."""
    before = rf"\G((?:[^'(]++|{LITERAL}|\((?!\s*SELECT\b))*+)"
    near = F.regexp_replace(q, rx(rf"{before}\(\s*SELECT\b{balanced()}\)"), "$1(?)")
    return F.when(has(q, r"\(\s*SELECT\b"), F.when(is_deep(q), fold(q, r"\(\s*SELECT\b", lambda _: F.lit("(?)"))).otherwise(near)).otherwise(q)


def op(q: Column) -> Column:
    """SELECT, INSERT, UPDATE, DELETE or OTHER."""
    word = F.upper(F.regexp_extract(q, r"^\s*([A-Za-z]+)(?![A-Za-z0-9_])", 1))
    return F.when(word.isin("SELECT", "INSERT", "UPDATE", "DELETE"), word).otherwise("OTHER")


def dml_table(q: Column) -> Column:
    """Target of an UPDATE, DELETE or INSERT, or null."""
    return plain(first(q, rf"^\s*(?:UPDATE|DELETE\s+FROM|(?:INSERT|REPLACE)\s+(?:IGNORE\s+)?INTO)\s+({NAME})"))


_CLAUSE_END = r"(?=\bGROUP\s+BY\b|\bORDER\s+BY\b|\bLIMIT\b|\bHAVING\b|\bUNION\b|\bFETCH\b|\bFOR\s+(?:UPDATE|SHARE)\b|$)"


def where_body(q: Column) -> Column:
    return first(q, rf"\bWHERE\b(.*?){_CLAUSE_END}")


def having_body(q: Column) -> Column:
    return first(q, r"\bHAVING\b(.*?)(?=\bORDER\s+BY\b|\bLIMIT\b|\bUNION\b|$)")


def order_body(q: Column) -> Column:
    return first(q, r"\bORDER\s+BY\b(.*?)(?=\bLIMIT\b|\bOFFSET\b|\bFETCH\b|\bFOR\s+(?:UPDATE|SHARE)\b|\bUNION\b|$)")


def group_body(q: Column) -> Column:
    return first(q, r"\bGROUP\s+BY\b(.*?)(?=\bHAVING\b|\bORDER\s+BY\b|\bLIMIT\b|\bUNION\b|$)")


def select_list(q: Column) -> Column:
    """Text between SELECT and its FROM, subqueries included."""
    plain_run = r"[^()'Ff]++|[Ff](?!ROM\b)|(?<=\w)[Ff]"
    shape = lambda b: rf"^\s*SELECT\s+((?:{plain_run}|{LITERAL}|\({b}\))*?)\bFROM\b"
    blank = fold(q, r"\(", _blank)
    begin = F.length(F.regexp_extract(blank, rx(r"^\s*SELECT\s+"), 0)) + 1
    found = F.regexp_extract(blank, rx(shape("[^()]*")), 1)
    return F.when(is_deep(q), F.when(found != "", F.substr(q, begin, F.length(found)))).otherwise(first(q, shape(balanced())))


def on_bodies(q: Column) -> Column:
    return every(q, r"\bON\b(.*?)(?=\b(?:LEFT|RIGHT|INNER|CROSS|FULL|NATURAL)?\s*(?:OUTER\s+)?JOIN\b|\bWHERE\b|\bGROUP\s+BY\b|\bORDER\s+BY\b|\bLIMIT\b|\bHAVING\b|$)")


def _refs(qualifiers: Column, columns: Column, ops: Column | None = None) -> Column:
    zipped = F.arrays_zip(qualifiers.alias("a"), columns.alias("b"), (ops if ops is not None else columns).alias("c"))
    named = F.transform(
        zipped, lambda z: F.struct(F.nullif(plain(z["a"]), F.lit("")).alias("qualifier"), plain(z["b"]).alias("column"), F.upper(F.regexp_replace(z["c"], r"\s+", " ")).alias("op"))
    )
    return F.filter(named, lambda r: ~r["column"].isin(*KEYWORDS, *MORE_KEYWORDS))


def where_refs(w: Column) -> Column:
    """Array of (qualifier, column, op): columns left of a comparison, and qualified ones right of it."""
    left = rf"(?:({IDENT})\.)?({IDENT})\s*({COMPARE})"
    right = rf"(=|!=|<>|<=|>=|<|>)\s*({IDENT})\.({IDENT})(?![\w.]|\s*\()"
    w = F.coalesce(w, F.lit(""))
    return F.concat(_refs(every(w, left, 1), every(w, left, 2), every(w, left, 3)), _refs(every(w, right, 2), every(w, right, 3), every(w, right, 1)))


def join_pairs(q: Column) -> Column:
    """Array of (lq, lc, rq, rc): column equalities of all ON conditions."""
    ons = F.array_join(on_bodies(q), " AND ")
    p = rf"({IDENT})\.({IDENT})\s*=\s*({IDENT})\.({IDENT})"
    zipped = F.arrays_zip(*[every(ons, p, k) for k in (1, 2, 3, 4)])
    return F.transform(zipped, lambda z: F.struct(plain(z["0"]).alias("lq"), plain(z["1"]).alias("lc"), plain(z["2"]).alias("rq"), plain(z["3"]).alias("rc")))


def listed_columns(body: Column) -> Column:
    """Array of (qualifier, column) of a comma list; expressions are left out."""
    parts = F.split(F.coalesce(body, F.lit("")), ",")
    bare = rf"^\s*(?:({IDENT})\.)?({IDENT})(?:\s+(?:ASC|DESC))?(?:\s+NULLS\s+(?:FIRST|LAST))?\s*;?\s*$"
    kept = F.filter(parts, lambda p: p.rlike(rx(bare)))
    return F.transform(kept, lambda p: F.struct(F.nullif(plain(F.regexp_extract(p, rx(bare), 1)), F.lit("")).alias("qualifier"), plain(F.regexp_extract(p, rx(bare), 2)).alias("column")))


def order_columns(q: Column) -> Column:
    return listed_columns(order_body(q))


def group_columns(q: Column) -> Column:
    return listed_columns(group_body(q))


def tables(q: Column) -> Column:
    """FROM tables, then JOIN tables, each once."""
    names = F.concat(every(q, rf"\bFROM\s+({NAME})"), every(q, rf"\bJOIN\s+(?!LATERAL\b)({NAME})"))
    return F.array_distinct(F.filter(F.transform(names, plain), lambda t: ~t.isin(*KEYWORDS)))


def aliases(q: Column) -> Column:
    """Array of (alias, table): each FROM, JOIN and UPDATE table, commas included, under its alias and its own name."""
    named = rf"({NAME})(?:\s+(?:AS\s+)?({_NOT_ALIAS}{IDENT}))?"
    p = rf"(?:\b(?:FROM|JOIN)|^\s*UPDATE)\s+{named}"
    source = first(q, r"\bFROM\b(.*?)(?=\bWHERE\b|\bGROUP\b|\bORDER\b|\bLIMIT\b|\bHAVING\b|\bUNION\b|\bJOIN\b|\bFOR\b|$)")
    every_item = F.split(F.coalesce(source, F.lit("")), ",")
    listed = F.slice(every_item, 2, F.size(every_item))
    item = rf"^\s*{named}"
    more = F.transform(listed, lambda x: F.struct(F.regexp_extract(x, rx(item), 1).alias("0"), F.regexp_extract(x, rx(item), 2).alias("1")))
    zipped = F.concat(F.arrays_zip(every(q, p, 1), every(q, p, 2)), more)
    kept = F.filter(zipped, lambda z: ~plain(z["0"]).isin("", *KEYWORDS, *MORE_KEYWORDS))
    both = F.transform(kept, lambda z: F.array(F.struct(plain(z["0"]).alias("alias"), plain(z["0"]).alias("table")), F.struct(F.coalesce(F.nullif(plain(z["1"]), F.lit("")), plain(z["0"])).alias("alias"), plain(z["0"]).alias("table"))))
    return F.array_distinct(F.flatten(both))


def resolve(qualifier: Column, alias_list: Column) -> Column:
    """Table of a column: by alias; a generated alias that is unknown gives null; unqualified only if one table is there."""
    by_alias = F.element_at(F.filter(alias_list, lambda a: a["alias"] == qualifier), 1)["table"]
    only = F.array_distinct(F.transform(alias_list, lambda a: a["table"]))
    known = F.size(F.filter(alias_list, lambda a: a["alias"] == qualifier)) > 0
    return F.when(qualifier.isNull(), F.when(F.size(only) == 1, F.get(only, F.lit(0)))).when(known, by_alias).when(qualifier.rlike(r"^[a-z]{1,3}\d+_\d+$"), None).otherwise(qualifier)


def has_where(q: Column) -> Column:
    return has(q, r"\bWHERE\b")


def has_select_all(q: Column) -> Column:
    q = F.regexp_replace(q, rx(r"EXISTS\s*\(\s*SELECT\s+\*"), "EXISTS (SELECT 1")
    return has(q, rf"\bSELECT\s+(?:ALL\s+|DISTINCT\s+)?(?:{IDENT}\.)?\*")


def where_functions(w: Column) -> Column:
    """Array of (function, qualifier, column): functions around a column left of a comparison, condition by condition."""
    conditions = F.split(F.coalesce(w, F.lit("")), rx(r"\s+(?:AND|OR)\s+"))
    left = F.transform(conditions, lambda c: F.regexp_extract(c, rx(r"^(.*?)(?:[=<>!]|\b(?:NOT\s+)?I?LIKE\b|\b(?:NOT\s+)?IN\b|\bBETWEEN\b|\bIS\b|$)"), 1))
    call = rf"\b({FUNCTIONS})\s*\(\s*(?:DISTINCT\s+)?(?:({IDENT})\.)?({IDENT})"
    calls = F.filter(left, lambda c: c.rlike(rx(call)))
    named = F.transform(
        calls,
        lambda c: F.struct(
            F.upper(F.regexp_extract(c, rx(call), 1)).alias("function"), F.nullif(plain(F.regexp_extract(c, rx(call), 2)), F.lit("")).alias("qualifier"), plain(F.regexp_extract(c, rx(call), 3)).alias("column")
        ),
    )
    return F.filter(named, lambda f: ~f["column"].isin(*KEYWORDS))


def joins(q: Column) -> Column:
    """Array of (kind, table, alias, body): each JOIN with the text of its ON condition."""
    p = rf"\b((?:LEFT|RIGHT|FULL|INNER|CROSS|NATURAL)?)\s*(?:OUTER\s+)?JOIN\s+({NAME})(?:\s+(?:AS\s+)?({_NOT_ALIAS}{IDENT}))?(?:\s+ON\b(.*?)(?=\b(?:LEFT|RIGHT|INNER|CROSS|FULL|NATURAL)\b|\bJOIN\b|\bWHERE\b|\bGROUP\s+BY\b|\bORDER\s+BY\b|\bLIMIT\b|\bHAVING\b|$))?"
    zipped = F.arrays_zip(*[every(q, p, k) for k in (1, 2, 3, 4)])
    return F.transform(zipped, lambda z: F.struct(F.upper(z["0"]).alias("kind"), plain(z["1"]).alias("table"), F.coalesce(F.nullif(plain(z["2"]), F.lit("")), plain(z["1"])).alias("alias"), z["3"].alias("body")))


def join_functions(q: Column) -> Column:
    """Array of (function, qualifier, column) in ON conditions: outer joins count on the joined side only."""
    call = rf"\b({FUNCTIONS})\s*\(\s*(?:({IDENT})\.)?({IDENT})"

    def of(j: Column) -> Column:
        body = F.coalesce(j["body"], F.lit(""))
        zipped = F.arrays_zip(*[every(body, call, k) for k in (1, 2, 3)])
        named = F.transform(zipped, lambda z: F.struct(F.upper(z["0"]).alias("function"), F.nullif(plain(z["1"]), F.lit("")).alias("qualifier"), plain(z["2"]).alias("column")))
        return F.filter(named, lambda f: ~j["kind"].isin("LEFT", "RIGHT") | (f["qualifier"] == j["alias"]) | (f["qualifier"] == j["table"]))

    return F.flatten(F.transform(joins(q), of))


def having_functions(h: Column) -> Column:
    """Array of (function, qualifier, column) in a HAVING body."""
    return where_functions(h)


def _or_text(w: Column) -> Column:
    w = F.regexp_replace(F.coalesce(w, F.lit("")), rx(r"\bIN\s*\([^)]*\)"), "IN (?)")
    return w


def or_count(w: Column) -> Column:
    return F.regexp_count(_or_text(w), F.lit(rx(r"\bOR\b")))


def effective_or_count(w: Column) -> Column:
    """OR conditions without those of optional parameters (? IS NULL OR ...)."""
    return F.regexp_count(F.regexp_replace(_or_text(w), rx(r"\(\s*\?\s+IS\s+NULL\s+OR\b"), "("), F.lit(rx(r"\bOR\b")))


def or_columns(w: Column) -> Column:
    """First column of each OR branch; empty if one has none."""
    p = rf"(?:({IDENT})\.)?({IDENT})\s*{COMPARE}"
    branches = F.split(_or_text(w), rx(r"\bOR\b"))
    names = F.transform(branches, lambda b: plain(F.regexp_extract(b, rx(p), 2)))
    return F.when(F.exists(names, lambda n: n == ""), F.array().cast("array<string>")).otherwise(names)


def same_or_column(w: Column) -> Column:
    names = or_columns(w)
    return (F.size(names) > 0) & (F.size(F.array_distinct(names)) == 1)


def offset_value(q: Column) -> Column:
    found = F.coalesce(first(q, r"\bLIMIT\s+(\d+)\s*,\s*(?:\d+|\?)"), first(q, r"\bOFFSET\s+(\d+)"))
    return found.try_cast("bigint")


def has_offset(q: Column) -> Column:
    return has(q, r"\bOFFSET\s+(?:\?|\d|:\w)|\bLIMIT\s+(?:\d+|\?)\s*,\s*(?:\d+|\?)")


def split_top_level(body: Column) -> Column:
    """Items of a comma list as they are written; commas in parentheses and literals don't part them."""
    hidden = lambda x: F.translate(x, ",", "\uFFFD")
    base = F.when(is_deep(body), fold(body, r"\(", hidden)).otherwise(body)
    marked = F.split(F.regexp_replace(base, "(?s)" + rf"\({balanced()}\)|{LITERAL}", "\uFFFE$0\uFFFE"), "\uFFFE")
    joined = F.array_join(F.transform(marked, lambda x, i: F.when(i % 2 == 1, hidden(x)).otherwise(x)), "")
    return F.transform(F.split(joined, ","), lambda x: F.translate(x, "\uFFFD", ","))
