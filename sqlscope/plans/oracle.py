"""DuckDB SQL with the rows of the audit's queries, written apart from the Spark plans: RE2 patterns
without look-around, correlated and anti-join forms, and a catalogue given as VALUES."""

from __future__ import annotations

from sqlscope.plans.workload import CATALOG, TEMPLATES, parts


def _q(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({k}, {t.count('{}')}, {', '.join(_q(p) for p in parts(t))}, {_q(s)})" for k, (t, s) in enumerate(TEMPLATES))
_CATALOG = ", ".join(f"({_q(t)}, {_q(i)}, {_q(c)}, {n}, {str(u).upper()}, {k})" for t, i, c, n, u, k in CATALOG)
_SUB = r"\(\s*select[^()]*(?:\([^()]*\)[^()]*)*\)"
_END = r"(?:\bgroup\s+by\b|\border\s+by\b|\blimit\b|\bhaving\b|\bunion\b|\bfetch\b|\bfor\s+(?:update|share)\b|$)"


def norm(sql: str) -> str:
    no_comments = rf"regexp_replace(regexp_replace({sql}, '/\*.*?\*/', ' ', 'gs'), '--[^\n]*', ' ', 'g')"
    literals = rf"regexp_replace({no_comments}, '''(?:[^'']|'''')*''', '?', 'g')"
    numbers = rf"regexp_replace({literals}, '\b[0-9]+(?:\.[0-9]+)?\b', '?', 'g')"
    lists = rf"regexp_replace({numbers}, '(?i)\bin\s*\(\s*\?(?:\s*,\s*\?)*\s*\)', 'IN (?)', 'g')"
    return rf"lower(trim(regexp_replace({lists}, '\s+', ' ', 'g')))"


LOG = f"""
tmpl(id, k, a, b, c, stack_trace) AS (VALUES {_TEMPLATES}),
cat(table_name, index_name, column_name, seq_in_index, non_unique, cardinality) AS (VALUES {_CATALOG}),
log AS (SELECT 'svc_' || (user_id % 10) AS test_class, event_id AS seq, CASE k WHEN 0 THEN a WHEN 1 THEN a || event_id || c ELSE a || event_id || b || event_id || c END AS sql,
        CAST(floor(value * 10) AS BIGINT) AS ms, stack_trace, CASE event_id % 10 WHEN 0 THEN 'SETUP' WHEN 9 THEN 'TEARDOWN' ELSE 'TEST' END AS phase
        FROM events JOIN tmpl ON event_id % {len(TEMPLATES)} = id),
norm AS (SELECT *, {norm("sql")} AS nsql, CASE WHEN upper(regexp_extract(sql, '^\\s*([A-Za-z]+)', 1)) IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE') THEN upper(regexp_extract(sql, '^\\s*([A-Za-z]+)', 1)) ELSE 'OTHER' END AS op FROM log),
tested AS (SELECT * FROM norm WHERE phase = 'TEST'),
rep0 AS (SELECT test_class, nsql, arg_min(sql, seq) AS sql, arg_min(op, seq) AS op, arg_min(coalesce(stack_trace, ''), seq) AS stack, min(seq) AS seq, count(*) AS n, count(*) FILTER (ms > 0) AS timed,
         CAST(floor(median(ms) FILTER (ms > 0)) AS BIGINT) AS median_ms FROM tested GROUP BY test_class, nsql),
rep1 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(sql, '/\\*.*?\\*/', ' ', 'gs'), '--[^\\n]*', ' ', 'g'), '(?is)^\\s*with\\s+\\w+\\s+as\\s*\\([^()]*\\)\\s*', '') AS s FROM rep0),
rep2 AS (SELECT *, regexp_replace(s, '(?is){_SUB}', '(?)', 'g') AS sq FROM rep1),
rep3 AS (SELECT *, regexp_extract(sq, '(?is)\\bwhere\\b(.*?){_END}', 1) AS w, nullif(lower(regexp_extract(s, '(?i)^\\s*(?:update|delete\\s+from|(?:insert|replace)\\s+into)\\s+(\\w+)', 1)), '') AS dml FROM rep2),
rep AS (SELECT *, coalesce(nullif(lower(regexp_extract(sq, '(?i)\\bfrom\\s+(\\w+)', 1)), ''), nullif(lower(regexp_extract(sq, '(?i)\\bjoin\\s+(\\w+)', 1)), ''), dml) AS t FROM rep3)
"""

_KEYWORDS = "('and', 'or', 'not', 'null', 'where', 'on', 'in', 'is', 'like', 'between', 'case', 'when', 'then', 'else', 'end', 'select', 'from', 'exists')"
NOT_ALIAS = "('where', 'on', 'set', 'join', 'left', 'cross', 'inner', 'order', 'group', 'limit', 'union', 'for', 'force', 'use', 'having', 'values', 'as', 'select')"
#: Aliases, WHERE columns with their tables, indexed columns, index shapes.
COLUMNS = rf"""
named AS (SELECT test_class, nsql, sq, lower(unnest(regexp_extract_all(sq, '(?i)(?:\b(?:from|join)|^\s*update)\s+(\w+)', 1))) AS tab FROM rep
          UNION ALL SELECT test_class, nsql, sq, lower(regexp_extract(sq, '(?i)\bfrom\s+\w+\s*,\s*(\w+)', 1)) FROM rep WHERE regexp_matches(sq, '(?i)\bfrom\s+\w+\s*,\s*\w+')),
aliased AS (SELECT test_class, nsql, tab, lower(regexp_extract(sq, '(?i)\b' || tab || '\s+(?:as\s+)?(\w+)', 1)) AS al FROM named),
alias AS (SELECT DISTINCT test_class, nsql, tab, tab AS al FROM named UNION SELECT DISTINCT test_class, nsql, tab, al FROM aliased
          WHERE al <> '' AND al NOT IN ('where', 'on', 'set', 'join', 'left', 'cross', 'inner', 'order', 'group', 'limit', 'union', 'for', 'force', 'use', 'having')),
tabs AS (SELECT test_class, nsql, count(DISTINCT tab) AS many, min(tab) AS only_tab FROM alias GROUP BY test_class, nsql),
raw AS (SELECT test_class, nsql, op, sql, unnest(regexp_extract_all(regexp_replace(w, '''(?:[^'']|'''')*''', '?', 'g'), '(?i)(?:\w+\.)?\b[a-z_]\w*\s*(?:=|!=|<>|<=|>=|<|>|(?:not\s+)?i?like\b|(?:not\s+)?in\b|is\s+not\b|is\b|between\b)', 0)) AS x FROM rep),
cmp0 AS (SELECT test_class, nsql, op, sql, lower(regexp_extract(x, '^(\w+)\.', 1)) AS q, lower(regexp_extract(x, '^(?:\w+\.)?(\w+)', 1)) AS col, upper(regexp_replace(regexp_extract(x, '^(?:\w+\.)?\w+\s*(.*)$', 1), '\s+', ' ', 'g')) AS cmp FROM raw
         UNION ALL SELECT test_class, nsql, op, sql, lower(regexp_extract(y, '(\w+)\.', 1)), lower(regexp_extract(y, '\.(\w+)', 1)), '=' FROM (SELECT test_class, nsql, op, sql, unnest(regexp_extract_all(w, '=\s*[A-Za-z_]\w*\.\w+', 0)) AS y FROM rep)),
cmp AS (SELECT c.test_class, c.nsql, c.op, c.sql, c.col, c.cmp, CASE WHEN c.q = '' THEN CASE WHEN many = 1 THEN only_tab END ELSE coalesce(a.tab, CASE WHEN NOT regexp_matches(c.q, '^[a-z]{{1,3}}[0-9]+_[0-9]+$') THEN c.q END) END AS tab
        FROM cmp0 c LEFT JOIN tabs USING (test_class, nsql) LEFT JOIN alias a ON a.test_class = c.test_class AND a.nsql = c.nsql AND a.al = c.q AND c.q <> '' WHERE c.col NOT IN {_KEYWORDS}),
known AS (SELECT c.*, f.column_name IS NOT NULL AS indexed, coalesce(f.is_lead, FALSE) AS is_lead, coalesce(f.uniq, FALSE) AS uniq, coalesce(f.all_non, FALSE) AS all_non, coalesce(f.few, FALSE) AS few
          FROM cmp c LEFT JOIN (SELECT table_name, column_name, bool_or(seq_in_index = 1) AS is_lead, bool_or(NOT non_unique) AS uniq, bool_and(non_unique) AS all_non, bool_or(cardinality BETWEEN 1 AND 10) AS few FROM cat GROUP BY ALL) f
            ON f.table_name = c.tab AND f.column_name = c.col WHERE c.tab IN (SELECT table_name FROM cat)),
shape AS (SELECT table_name, index_name, list(column_name ORDER BY seq_in_index) AS cols, bool_and(NOT non_unique) AS uniq FROM cat GROUP BY ALL)
"""


def issues(code: str, body: str, columns: bool = False, recursive: bool = False) -> str:
    """SQL whose body selects test_class, severity, query, table_name, column_name."""
    with_ = "WITH RECURSIVE" if recursive else "WITH"
    return f"{with_} {LOG}{',' + COLUMNS if columns else ''}, found AS ({body}) SELECT test_class, '{code}' AS code, severity, query, table_name, column_name FROM found"


def where(severity: str, condition: str, table: str = "t", column: str = "NULL", query: str = "nsql") -> str:
    sev = severity if severity.startswith("CASE") else f"'{severity}'"
    return f"SELECT test_class, {sev} AS severity, {query} AS query, {table} AS table_name, CAST({column} AS VARCHAR) AS column_name FROM rep WHERE {condition}"


def m(pattern: str, of: str = "s") -> str:
    return f"regexp_matches({of}, '(?is){pattern}')"


_LOCK = m(r"\bfor\s+(?:update|share)\b")
_AGG = r"\b(?:count|sum|avg|min|max)\s*\("
_WM = "regexp_replace(regexp_extract(s, '(?is)\\bwhere\\b(.*?)" + _END + "', 1), '''(?:[^'']|'''')*''', '?', 'g')"
_ORS = rf"(len(regexp_extract_all(w, '(?i)\bor\b')) - len(regexp_extract_all(w, '(?i)\(\s*\?\s+is\s+null\s+or\b')))"

PREDICATES: dict[str, str] = {
    "select-all": where("INFO", m(r"\bselect\s+(?:all\s+|distinct\s+)?(?:\w+\.)?\*") + " AND NOT " + m(r"\bexists\s*\(\s*select\s+\*")),
    "or-abuse": where(
        "WARNING", rf"{_ORS} >= 3 AND (SELECT count(DISTINCT c) FROM (SELECT unnest(regexp_extract_all(w, '(\w+)\s*=', 1)) AS c)) > 1 "
        r"AND EXISTS (SELECT 1 FROM (SELECT unnest(regexp_extract_all(w, '(\w+)\s*=', 1)) AS c) WHERE c NOT IN (SELECT column_name FROM cat WHERE table_name = t))",
    ),
    "offset-pagination": where(
        r"CASE WHEN regexp_extract(s, '(?i)\boffset\s+([0-9]+)', 1) <> '' THEN 'WARNING' ELSE 'INFO' END", r"TRY_CAST(regexp_extract(s, '(?i)\boffset\s+([0-9]+)', 1) AS BIGINT) >= 1000 OR " + m(r"\boffset\s+\?"),
    ),
    "like-leading-wildcard": where("CASE WHEN " + m(r"\blike\s+''%") + " THEN 'WARNING' ELSE 'INFO' END", m(r"\blike\s+(?:''%|\?)")),
    "cartesian-join": where("ERROR", "(" + m(r"\bjoin\s+\w+\s*(?:where|order|group|limit|$)", "sq") + " AND NOT " + m(r"\bcross\s+join", "sq") + ") OR (" + m(r"\bfrom\s+\w+\s*,\s*\w+", "sq") + " AND NOT " + m(r"\bwhere\b", "sq") + ")"),
    "implicit-join": where("WARNING", m(r"\bfrom\s+\w+\s*,\s*\w+", "sq")),
    "count-instead-of-exists": where("INFO", m(r"\bselect\s+count\s*\(\s*(?:\*|\w+)\s*\)") + " AND " + m(r"\bwhere\b") + " AND NOT " + m(r"\(\s*select\s+count\s*\(|\bgroup\s+by\b|\bhaving\b|count\s*\(\s*distinct\b")),
    "union-without-all": where("INFO", m(r"\bunion\s") + " AND NOT " + m(r"\bunion\s+all\b") + " AND NOT " + m(r"\bselect\s+distinct\b"), table="NULL"),
    "distinct-misuse": where("WARNING", m(r"^\s*select\s+distinct\b", "sq") + " AND (" + m(r"\bgroup\s+by\b", "sq") + " OR " + m(r"\bjoin\b", "sq") + r" OR EXISTS (SELECT 1 FROM cat WHERE table_name = t AND index_name = 'PRIMARY' AND regexp_matches(lower(regexp_extract(sq, '(?is)^\s*select(.*?)\bfrom\b', 1)), '\b' || column_name || '\b')))"),
    "null-comparison": where("ERROR", m(r"\w+\s*(?:=|!=|<>)\s*null\b", "w"), column=r"lower(regexp_extract(w, '(?i)(\w+)\s*(?:=|!=|<>)\s*null\b', 1))"),
    "string-concat-where": where("WARNING", m(r"\w+\s*\|\|", "w"), column=r"lower(regexp_extract(w, '(\w+)\s*\|\|', 1))"),
    "case-in-where": where("WARNING", m(r"\bcase\b", "w") + " AND NOT " + m(r"=\s*case\b", "w")),
    "regexp-usage": where("WARNING", m(r"\b(?:regexp|rlike)\b", "w")),
    "find-in-set": where("WARNING", m(r"\bfind_in_set\s*\(", "w")),
    "group-by-function": where("WARNING", m(r"\bgroup\s+by\s.*?\b\w+\s*\(\s*\w+", r"regexp_replace(sq, '(?is)\bhaving\b.*$', '')"), column=r"lower(regexp_extract(sq, '(?i)\bgroup\s+by\s.*?\w+\s*\(\s*(\w+)', 1))"),
    "large-in-list": where(r"CASE WHEN len(string_split(regexp_extract(s, '(?i)\bin\s*\(([^)]+)\)', 1), ',')) > 1000 THEN 'ERROR' ELSE 'WARNING' END", r"len(string_split(regexp_extract(s, '(?i)\bin\s*\(([^)]+)\)', 1), ',')) > 100"),
    "too-many-joins": where("WARNING", r"len(regexp_extract_all(sq, '(?i)\bjoin\b')) > 5"),
    "not-in-subquery": where("ERROR", m(r"\bnot\s+in\s*\(\s*select\b")),
    "order-by-rand": where("ERROR", m(r"\border\s+by\s+(?:rand|random|newid|dbms_random)\s*\(")),
    "count-star-no-where": where("INFO", "op = 'SELECT' AND " + m(r"\bcount\s*\(\s*(?:\*|1)\s*\)", "sq") + " AND NOT " + m(r"\bwhere\b|\bgroup\s+by\b", "sq")),
    "limit-without-order-by": where("WARNING", "op = 'SELECT' AND " + m(r"\blimit\b", "sq") + " AND NOT " + m(r"\border\s+by\b", "sq") + f" AND NOT {_LOCK} AND NOT " + m(_AGG, "sq") + " AND NOT " + m(r"\blimit\s+(?:1|\?)\s*$", "sq") + r" AND NOT coalesce(regexp_matches(stack, '\.existsBy\w*:'), FALSE)"),
    "window-no-partition": where("WARNING", m(r"\bover\s*\(") + " AND NOT " + m(r"\bpartition\s+by\b") + " AND NOT (" + m(r"\b(?:row_number|rank|dense_rank|ntile)\s*\(") + " AND " + m(r"over\s*\(\s*order\s+by") + ")"),
    "excessive-column-fetch": where("INFO", r"op = 'SELECT' AND len(list_filter(string_split(regexp_extract(sq, '(?is)^\s*select\s+(.*?)\bfrom\b', 1), ','), lambda x: regexp_matches(x, '^\s*(?:\w+\.)?\w+\s*$'))) > 15", query="sql"),
    "unbounded-result-set": where(
        "WARNING", "op IN ('SELECT', 'OTHER') AND " + m(r"^\s*select\b") + " AND " + m(r"\bfrom\b") + " AND NOT " + m(_AGG + r"|\blimit\b|\bfetch\s+first\b|\bin\s*\(\s*select\b|\bexists\s*\(\s*select\b") + f" AND NOT {_LOCK} AND op = 'SELECT' "
        rf"AND (regexp_matches(w, '(?i)\bor\b') OR NOT EXISTS (SELECT 1 FROM (SELECT index_name, list(column_name) AS cols FROM cat WHERE table_name = t AND NOT non_unique GROUP BY index_name) WHERE list_has_all(regexp_extract_all(lower(regexp_replace(w, '''(?:[^'']|'''')*''', '?', 'g')), '(\w+)\s*=', 1), cols)))",
    ),
    "for-update-no-timeout": where("WARNING", _LOCK + " AND NOT " + m(r"\bnowait\b|\bskip\s+locked\b|\bwait\s+[0-9]")),
    "force-index-hint": where("INFO", m(r"\b(?:force|use|ignore)\s+index\s*\(") + " AND NOT coalesce(regexp_matches(stack, '(?i)migration|flyway|liquibase'), FALSE)"),
    "update-without-where": where("ERROR", "op IN ('UPDATE', 'DELETE') AND NOT " + m(r"\bwhere\b|\bjoin\b", "sq") + " AND NOT (op = 'DELETE' AND " + m(r"\busing\b", "sq") + ")", table="dml"),
    "subquery-in-dml": where("WARNING", "op IN ('UPDATE', 'DELETE') AND " + m(r"\bin\s*\(\s*select\b")),
    "insert-select-all": where("WARNING", "op = 'INSERT' AND " + m(r"\bselect\s+\*", "sq"), table="dml"),
    "insert-select-locks-source": where("INFO", "op = 'INSERT' AND " + m(r"\bselect\b"), table=r"lower(regexp_extract(s, '(?is)\bselect\b.*?\bfrom\s+(\w+)', 1))"),
    "insert-on-duplicate-key": where("WARNING", m(r"\bon\s+duplicate\s+key\s+update\b") + " OR " + m(r"^\s*replace\s+into\b"), table="dml"),
    "implicit-columns-insert": where("WARNING", m(r"^\s*insert\s+into\s+\w+\s+values\b"), table="dml"),
    "where-function": where("ERROR", m(r"\b(?:year|lower|upper|date|trim)\s*\(\s*\w+\s*\)\s*[=<>]", "w"), column=r"lower(regexp_extract(w, '(?i)\b(?:year|lower|upper|date|trim)\s*\(\s*(\w+)', 1))")
    + " UNION ALL " + where("WARNING", m(r"\bon\s+(?:year|lower|upper|date|trim)\s*\(", "sq"), column=r"lower(regexp_extract(sq, '(?i)\bon\s+\w+\s*\(\s*\w+\.(\w+)', 1))"),
    "non-sargable": where("ERROR", m(r"\w+\s*[-+*/]\s*[0-9]+\s*[=<>]", "w") + " OR " + m(r"[=<>]\s*[0-9]+\s*[-+*/]\s*[a-z]\w*", "w"), column=r"lower(regexp_extract(w, '(?i)([a-z]\w*)\s*[-+*/]\s*[0-9]', 1))"),
    "having-misuse": rf"""SELECT test_class, 'WARNING' AS severity, nsql AS query, t AS table_name, nullif(lower(regexp_extract(c, '^\s*(\w+)\s*[=<>!]', 1)), '') AS column_name
      FROM (SELECT test_class, nsql, t, sq, unnest(string_split(regexp_replace(regexp_extract(sq, '(?is)\bhaving\b(.*)$', 1), '(?i)\s+(?:and|or)\s+', chr(1), 'g'), chr(1))) AS c FROM rep WHERE op = 'SELECT')
      WHERE trim(c) <> '' AND NOT {m(_AGG, "c")} AND NOT list_contains(regexp_extract_all(lower(sq), '(?:count|sum|avg|min|max)\([^()]*\)\s+as\s+(\w+)', 1), lower(regexp_extract(c, '^\s*(\w+)\s*[=<>!]', 1)))""",
    "redundant-filter": where("INFO", r"len(regexp_extract_all(w, '(\w+)\s*=', 1)) > len(list_distinct(regexp_extract_all(w, '(\w+)\s*=', 1))) AND NOT regexp_matches(w, '(?i)\bor\b')", column=r"regexp_extract(w, '(\w+)\s*=', 1)"),
    "unused-join": where("WARNING", "op = 'SELECT' AND " + m(r"\bleft\s+join\s+\w+\s+\w+\s+on\b", "sq") + r" AND NOT contains(lower(regexp_extract(sq, '(?is)^\s*select(.*?)\bfrom\b', 1)) || lower(w), lower(regexp_extract(sq, '(?i)\bleft\s+join\s+\w+\s+(\w+)', 1)) || '.')"),
    "correlated-subquery": where("WARNING", m(r"^\s*select\b.*?\(\s*select\b[^()]*(?:\([^()]*\))?[^()]*\bwhere\b[^()]*=\s*c\.\w+[^()]*\).*\bfrom\s+customer\s+c\b")),
    "n-plus-one-suspect": where("INFO", "op = 'SELECT' AND n >= 3", query="sql"),
    "repeated-single-insert": where("WARNING", "op = 'INSERT' AND n >= 3 AND NOT " + m(r"values\s*\([^)]*\)\s*,\s*\("), table="dml"),
    "slow-query": where("CASE WHEN median_ms > 3000 THEN 'ERROR' ELSE 'WARNING' END", "timed > 0 AND median_ms > 500"),
}

_LISTED = r"""SELECT rep.test_class, rep.nsql, rep.op, rep.sql, pos, lower(regexp_extract(item, '^\s*(?:\w+\.)?(\w+)', 1)) AS col, lower(regexp_extract(item, '^\s*(\w+)\.', 1)) AS q, many, only_tab, rep.sq
 FROM rep JOIN tabs USING (test_class, nsql), (SELECT unnest(range(1, 1 + len(string_split(regexp_extract(rep.sq, '{clause}', 1), ',')))) AS pos, unnest(string_split(regexp_extract(rep.sq, '{clause}', 1), ',')) AS item)
 WHERE rep.op = 'SELECT' AND regexp_matches(item, '(?i)^\s*(?:\w+\.)?[a-z_]\w*(?:\s+(?:asc|desc))?\s*$')"""
_ORDER = _LISTED.replace("{clause}", r"(?is)\border\s+by\b(.*?)(?:\blimit\b|\boffset\b|\bfor\b|\bunion\b|$)")
_GROUP = _LISTED.replace("{clause}", r"(?is)\bgroup\s+by\b(.*?)(?:\bhaving\b|\border\s+by\b|\blimit\b|\bunion\b|$)")


def _resolved(listed: str) -> str:
    return f"SELECT l.*, CASE WHEN l.q = '' THEN CASE WHEN many = 1 THEN only_tab END ELSE a.tab END AS tab FROM ({listed}) l LEFT JOIN alias a ON a.test_class = l.test_class AND a.nsql = l.nsql AND a.al = l.q AND l.q <> ''"


_JOINED = r"""SELECT rep.test_class, rep.nsql, lower(regexp_extract(x, '^(\w+)\.', 1)) AS lq, lower(regexp_extract(x, '^\w+\.(\w+)', 1)) AS lc, lower(regexp_extract(x, '=\s*(\w+)\.', 1)) AS rq, lower(regexp_extract(x, '=\s*\w+\.(\w+)', 1)) AS rc
 FROM rep, (SELECT unnest(regexp_extract_all(array_to_string(regexp_extract_all(rep.sq, '(?is)\bon\b(.*?)(?:\bjoin\b|\bwhere\b|$)', 1), ' and '), '\w+\.\w+\s*=\s*\w+\.\w+', 0)) AS x)"""
_TWO = f"(SELECT j.test_class, j.nsql, l.tab AS lt, lc, r.tab AS rt, rc FROM ({_JOINED}) j JOIN alias l ON l.test_class = j.test_class AND l.nsql = j.nsql AND l.al = lq JOIN alias r ON r.test_class = j.test_class AND r.nsql = j.nsql AND r.al = rq)"

LOW = "('type','status','role','gender','category','level','kind','state','enabled','active','visible','locked','verified','approved','published','archived')"
SOFT = "('deleted_at','deleted','is_deleted','removed_at','deactivated_at','discarded_at','unsuspended_at')"

CATALOG_RULES: dict[str, str] = {
    "missing-where-index": rf"""SELECT test_class, arg_min(sev, ord) AS severity, nsql AS query, tab AS table_name, col AS column_name FROM (
      SELECT k.*, row_number() OVER () AS ord, CASE
        WHEN indexed OR EXISTS (SELECT 1 FROM known u WHERE u.test_class = k.test_class AND u.nsql = k.nsql AND u.tab = k.tab AND u.uniq AND u.cmp IN ('=', 'IS', 'IS NOT')) THEN NULL
        WHEN cmp IN ('LIKE', 'NOT LIKE') AND regexp_matches(sql, '(?i)\b' || col || '\s+(?:not\s+)?like\s+''%') THEN NULL
        WHEN cmp IN ('IS', 'IS NOT') AND col NOT IN {SOFT} THEN NULL
        WHEN col IN {SOFT} AND cmp IN ('IS', '=') THEN CASE WHEN (SELECT count(DISTINCT u.col) FROM known u WHERE u.test_class = k.test_class AND u.nsql = k.nsql AND u.tab = k.tab) = 1 THEN 'INFO' END
        WHEN col IN {LOW} OR regexp_matches(col, '^(is_|has_|flag)') OR regexp_matches(col, '.(_type|_status)$') OR few THEN CASE WHEN NOT EXISTS (SELECT 1 FROM known u WHERE u.test_class = k.test_class AND u.nsql = k.nsql AND u.tab = k.tab AND u.indexed) THEN 'INFO' END
        WHEN EXISTS (SELECT 1 FROM known u WHERE u.test_class = k.test_class AND u.nsql = k.nsql AND u.tab = k.tab AND u.indexed) THEN 'WARNING' ELSE 'ERROR' END AS sev
      FROM known k WHERE op = 'SELECT') WHERE sev IS NOT NULL GROUP BY test_class, nsql, tab, col""",
    "missing-join-index": f"""SELECT DISTINCT test_class, 'ERROR' AS severity, nsql AS query, tab AS table_name, col AS column_name FROM (SELECT test_class, nsql, lt AS tab, lc AS col FROM {_TWO} UNION SELECT test_class, nsql, rt, rc FROM {_TWO})
      WHERE tab IN (SELECT table_name FROM cat) AND NOT EXISTS (SELECT 1 FROM cat WHERE table_name = tab AND column_name = col)""",
    "missing-order-by-index": f"""SELECT DISTINCT o.test_class, CASE WHEN EXISTS (SELECT 1 FROM known u WHERE u.test_class = o.test_class AND u.nsql = o.nsql AND u.tab = o.tab AND u.indexed) THEN 'INFO' ELSE 'WARNING' END AS severity, o.nsql AS query, tab AS table_name, col AS column_name
      FROM ({_resolved(_ORDER)}) o WHERE tab IN (SELECT table_name FROM cat) AND NOT EXISTS (SELECT 1 FROM cat WHERE table_name = tab AND column_name = col)
      AND NOT EXISTS (SELECT 1 FROM known u WHERE u.test_class = o.test_class AND u.nsql = o.nsql AND u.tab = o.tab AND u.uniq AND u.cmp IN ('=', 'IS', 'IS NOT'))""",
    "missing-group-by-index": f"""SELECT DISTINCT g.test_class, 'WARNING' AS severity, g.nsql AS query, tab AS table_name, col AS column_name FROM ({_resolved(_GROUP)}) g
      WHERE tab IN (SELECT table_name FROM cat) AND NOT EXISTS (SELECT 1 FROM cat WHERE table_name = tab AND column_name = col) AND NOT EXISTS (SELECT 1 FROM known u WHERE u.test_class = g.test_class AND u.nsql = g.nsql AND u.tab = g.tab AND u.indexed)""",
    "composite-index-leading": """SELECT DISTINCT c.test_class, 'WARNING' AS severity, c.nsql AS query, s.table_name, s.cols[1] AS column_name FROM shape s JOIN closed c ON c.tab = s.table_name AND list_contains(s.cols[2:], c.col)
      WHERE len(s.cols) > 1 AND NOT EXISTS (SELECT 1 FROM closed l WHERE l.test_class = c.test_class AND l.nsql = c.nsql AND l.tab = c.tab AND l.col = s.cols[1])
      AND NOT EXISTS (SELECT 1 FROM cat WHERE cat.table_name = c.tab AND cat.column_name = c.col AND cat.seq_in_index = 1)""",
    "covering-index-opportunity": r"""SELECT test_class, 'INFO' AS severity, nsql AS query, table_name, arg_min(missing, index_name) AS column_name FROM (
      SELECT r.test_class, r.nsql, s.table_name, s.index_name, string_agg(DISTINCT r.x, ',' ORDER BY r.x) AS missing, count(DISTINCT r.x) AS k
      FROM (SELECT rep.test_class, rep.nsql, t, lower(regexp_extract(unnest(string_split(regexp_extract(sq, '(?is)^\s*select\s+(.*?)\bfrom\b', 1), ',')), '^\s*(?:\w+\.)?(\w+)\s*$', 1)) AS x
            FROM rep WHERE op = 'SELECT' AND len(list_distinct(regexp_extract_all(sq, '(?i)\b(?:from|join)\s+(\w+)', 1))) = 1) r
      JOIN shape s ON s.table_name = r.t AND s.index_name <> 'PRIMARY' AND NOT list_contains(s.cols, r.x)
      WHERE r.x <> '' AND NOT EXISTS (SELECT 1 FROM cat WHERE cat.table_name = s.table_name AND cat.index_name = 'PRIMARY' AND cat.column_name = r.x)
      AND EXISTS (SELECT 1 FROM cmp0 c WHERE c.test_class = r.test_class AND c.nsql = r.nsql AND list_contains(s.cols, c.col)) GROUP BY ALL)
      WHERE k BETWEEN 1 AND 3 GROUP BY test_class, nsql, table_name""",
    "order-by-limit-no-index": f"""SELECT test_class, 'WARNING' AS severity, nsql AS query, arg_min(tab, pos) AS table_name, arg_min(col, pos) AS column_name FROM ({_resolved(_ORDER)}) o
      WHERE regexp_matches(sq, '(?i)\\blimit\\b') AND tab IN (SELECT table_name FROM cat) AND NOT EXISTS (SELECT 1 FROM cat WHERE table_name = tab AND column_name = col AND seq_in_index = 1) GROUP BY test_class, nsql""",
    "redundant-index": """SELECT DISTINCT x.test_class, 'WARNING' AS severity, NULL AS query, a.table_name, a.index_name AS column_name FROM shape a JOIN shape b ON a.table_name = b.table_name AND len(a.cols) < len(b.cols) AND b.cols[1:len(a.cols)] = a.cols
      JOIN (SELECT DISTINCT test_class, unnest(regexp_extract_all(lower(sq), '\\b(?:from|join)\\s+(\\w+)', 1)) AS tab FROM rep) x ON x.tab = a.table_name WHERE a.index_name <> 'PRIMARY' AND NOT (a.uniq AND NOT b.uniq)""",
    "write-amplification": """SELECT DISTINCT x.test_class, 'WARNING' AS severity, NULL AS query, x.tab AS table_name, NULL AS column_name FROM (SELECT test_class, unnest(regexp_extract_all(lower(sq), '\\b(?:from|join)\\s+(\\w+)', 1)) AS tab FROM rep UNION SELECT test_class, dml FROM rep) x
      WHERE (SELECT count(DISTINCT index_name) FROM cat WHERE table_name = x.tab) > 6""",
    "dml-without-index": """SELECT test_class, 'WARNING' AS severity, nsql AS query, tab AS table_name, NULL AS column_name FROM known WHERE op IN ('UPDATE', 'DELETE') GROUP BY test_class, nsql, tab HAVING NOT bool_or(is_lead)""",
    "non-deterministic-pagination": f"""SELECT test_class, 'INFO' AS severity, nsql AS query, arg_min(tab, pos) AS table_name, NULL AS column_name FROM ({_resolved(_ORDER)}) o WHERE regexp_matches(sq, '(?i)\\blimit\\b') GROUP BY test_class, nsql
      HAVING NOT bool_or(tab IS NULL OR tab NOT IN (SELECT table_name FROM cat) OR EXISTS (SELECT 1 FROM cat WHERE table_name = tab AND column_name = col AND NOT non_unique))""",
    "for-update-no-index": f"""SELECT DISTINCT test_class, 'ERROR' AS severity, nsql AS query, tab AS table_name, col AS column_name FROM known WHERE NOT indexed AND regexp_matches(sql, '(?i)\\bfor\\s+(?:update|share)\\b')
      UNION ALL SELECT test_class, 'ERROR', nsql, t, NULL FROM rep WHERE {_LOCK} AND NOT {m(r"\bwhere\b", "sq")} AND t IN (SELECT table_name FROM cat)""",
    "for-update-non-unique": """SELECT DISTINCT test_class, 'WARNING' AS severity, nsql AS query, tab AS table_name, col AS column_name FROM known WHERE indexed AND all_non AND regexp_matches(sql, '(?i)\\bfor\\s+(?:update|share)\\b')""",
    "range-lock-risk": """SELECT DISTINCT test_class, 'WARNING' AS severity, nsql AS query, tab AS table_name, col AS column_name FROM known WHERE NOT indexed AND cmp IN ('<', '>', '<=', '>=', 'BETWEEN') AND regexp_matches(sql, '(?i)\\bfor\\s+(?:update|share)\\b')""",
}
_CLOSED = f""", pairs AS (SELECT * FROM {_TWO} UNION SELECT test_class, nsql, rt, rc, lt, lc FROM {_TWO}),
closed(test_class, nsql, tab, col) AS (SELECT DISTINCT test_class, nsql, tab, col FROM cmp WHERE tab IS NOT NULL
  UNION SELECT closed.test_class, closed.nsql, pairs.rt, pairs.rc FROM closed JOIN pairs ON pairs.test_class = closed.test_class AND pairs.nsql = closed.nsql AND pairs.lt = closed.tab AND pairs.lc = closed.col)"""


_CONVERSION = r"""SELECT test_class, 'WARNING' AS severity, arg_min(nsql, seq) AS query, NULL AS table_name, col AS column_name FROM (SELECT test_class, nsql, seq, regexp_extract(x, '^(\w+)', 1) AS col, regexp_extract(x, '([0-9]+)$', 1) AS v
        FROM (SELECT test_class, nsql, seq, unnest(regexp_extract_all(w, '\b\w+\s*=\s*[0-9]+\b', 0)) AS x FROM rep)) WHERE NOT regexp_matches(col, '(^|_)(id|count|num|no|seq|order|size|length)$')
        AND regexp_matches(col, '(^|_)(name|email|phone|code|token|key|slug|handle|address|title|url|path|type|description|desc|note|comment|text|content|message|label|tag|remark)(_|$)') GROUP BY test_class, col, v"""


def rule_sql() -> dict[str, str]:
    """By code: DuckDB SQL of the rule's findings over the synthetic log."""
    out = {code: issues(code, body) for code, body in PREDICATES.items()}
    for code, body in CATALOG_RULES.items():
        sql = issues(code, body, columns=True, recursive=code == "composite-index-leading")
        out[code] = sql.replace(", found AS (", _CLOSED + ", found AS (", 1) if code == "composite-index-leading" else sql
    out["implicit-type-conversion"] = issues("implicit-type-conversion", _CONVERSION)
    return out


def union_sql() -> str:
    """A WITH clause whose table sm has the findings of all these rules."""
    bodies = PREDICATES | CATALOG_RULES | {"implicit-type-conversion": _CONVERSION}
    every = " UNION ALL ".join(f"SELECT test_class, '{code}' AS code, severity, query, table_name, column_name FROM ({body})" for code, body in bodies.items())
    return f"WITH RECURSIVE {LOG}, {COLUMNS}{_CLOSED}, sm AS MATERIALIZED ({every})"
