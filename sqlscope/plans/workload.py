"""A synthetic statement log over the star-schema tables: events give the order and times, templates the texts.

``{}`` stands for the event's number. The number of templates has no factor in
common with 10, so every template meets every service and phase.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATES: list[tuple[str, str | None]] = [
    ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = {}", "app.Orders.find:10"),
    ("SELECT * FROM customer WHERE c_custkey = {}", "app.Customers.load:22"),
    ("SELECT c.* FROM customer c WHERE c.c_nationkey = {} LIMIT 10", None),
    ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderkey = {}", None),
    ("SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_clerk = c.c_name WHERE o.o_custkey = {} LIMIT 5", None),
    ("SELECT o_orderkey FROM orders, customer WHERE orders.o_custkey = customer.c_custkey AND o_orderkey = {}", None),
    ("SELECT o_orderkey FROM orders, customer LIMIT {}", None),
    ("SELECT o_orderkey FROM orders JOIN customer WHERE o_orderkey = {}", None),
    ("SELECT o_orderkey FROM orders CROSS JOIN nation WHERE o_orderkey = {}", None),
    ("SELECT o_orderkey FROM orders WHERE YEAR(o_orderdate) = {}", None),
    ("SELECT o_orderkey FROM orders WHERE COALESCE(o_comment, o_clerk) = 'x' AND o_orderkey = {}", None),
    ("SELECT o.o_orderkey FROM orders o JOIN customer c ON LOWER(o.o_clerk) = c.c_name WHERE o.o_orderkey = {}", None),
    ("SELECT o.o_orderkey FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderkey = {}", None),
    ("SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderkey = {}", None),
    ("SELECT p_name FROM part WHERE p_brand = 'a' OR p_size = {} OR p_type = 'b' OR p_name = 'c'", None),
    ("SELECT p_name FROM part WHERE p_brand = 'a' OR p_brand = 'b' OR p_brand = 'c' OR p_brand = 'd{}'", None),
    ("SELECT p_name FROM part WHERE p_brand = 'a' OR p_partkey = 1 OR p_partkey = {} OR p_brand = 'z'", None),
    ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 50{}", None),
    ("SELECT o_orderkey FROM orders WHERE o_custkey = {} ORDER BY o_orderkey LIMIT 20 OFFSET 40", None),
    ("SELECT o_orderkey FROM orders WHERE o_custkey = {} ORDER BY o_orderkey LIMIT 20 OFFSET ?", None),
    ("SELECT c_name FROM customer WHERE c_name LIKE '%smith{}'", None),
    ("SELECT c_name FROM customer WHERE c_name LIKE 'smith%' AND c_custkey = {}", None),
    ("SELECT c_name FROM customer WHERE c_phone LIKE ? AND c_custkey = {}", None),
    ("SELECT c_name, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c WHERE c.c_custkey = {}", None),
    ("SELECT c_name, (SELECT MAX(p.p_size) FROM part p WHERE p.p_size > 3) AS n FROM customer c WHERE c.c_custkey = {}", None),
    ("SELECT o_orderkey FROM orders WHERE o_custkey = {} AND o_custkey = {}", None),
    ("SELECT o_orderkey FROM orders WHERE o_totalprice + 10 > {}", None),
    ("SELECT o_orderkey FROM orders WHERE o_totalprice > {} + 10", None),
    ("SELECT COUNT(*) FROM orders WHERE o_custkey = {}", None),
    ("SELECT COUNT(DISTINCT o_custkey) FROM orders WHERE o_totalprice > {}", None),
    ("SELECT COUNT(*) FROM orders /* whole table {} */", None),
    ("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_custkey = {} GROUP BY o_orderstatus", None),
    ("SELECT c_name FROM customer WHERE c_phone = {}", None),
    ("SELECT c_name FROM customer WHERE c_phone_id = {}", None),
    ("SELECT o_orderkey FROM orders WHERE o_custkey = {} UNION SELECT l_orderkey FROM lineitem WHERE l_partkey = {}", None),
    ("SELECT o_orderkey FROM orders WHERE o_custkey = {} UNION ALL SELECT l_orderkey FROM lineitem WHERE l_partkey = {}", None),
    ("SELECT o_orderkey FROM orders WHERE o_custkey IN (" + ",".join(str(x) for x in range(120)) + ",{})", None),
    ("SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, {})", None),
    ("SELECT DISTINCT o_orderstatus FROM orders WHERE o_custkey = {} GROUP BY o_orderstatus", None),
    ("SELECT DISTINCT o_orderkey, o_clerk FROM orders WHERE o_custkey = {}", None),
    ("SELECT DISTINCT c.c_name FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_custkey = {}", None),
    ("SELECT o_orderkey FROM orders WHERE o_clerk = NULL AND o_orderkey = {}", None),
    ("SELECT o_orderkey FROM orders WHERE o_clerk <> NULL AND o_orderkey = {}", None),
    ("SELECT o_orderkey FROM orders WHERE o_clerk IS NULL AND o_orderkey = {}", None),
    ("SELECT o_orderstatus, SUM(o_totalprice) AS total FROM orders GROUP BY o_orderstatus HAVING o_orderstatus = 'F' AND total > {}", None),
    ("UPDATE orders SET o_comment = 'x{}'", None),
    ("UPDATE orders SET o_comment = 'x' WHERE o_orderkey = {}", None),
    ("UPDATE orders SET o_comment = 'x' WHERE o_clerk = 'c{}'", None),
    ("DELETE FROM events", None),
    ("DELETE FROM lineitem WHERE l_comment = 'c{}'", None),
    ("DELETE FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = {})", None),
    ("INSERT INTO orders_copy SELECT * FROM orders WHERE o_custkey = {}", None),
    ("INSERT INTO orders_copy (o_orderkey) SELECT o_orderkey FROM orders WHERE o_custkey = {}", None),
    ("INSERT INTO nation VALUES ({}, 'x', 1)", None),
    ("INSERT INTO nation (n_nationkey, n_name) VALUES ({}, 'x')", None),
    ("INSERT INTO nation (n_nationkey) VALUES ({}), (2)", None),
    ("INSERT INTO nation (n_nationkey) VALUES ({}) ON DUPLICATE KEY UPDATE n_name = 'x'", None),
    ("REPLACE INTO nation (n_nationkey) VALUES ({})", None),
    ("SELECT p_name FROM part ORDER BY RAND() LIMIT {}", None),
    ("SELECT p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = {})", None),
    ("SELECT p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = {})", None),
    ("SELECT a.x FROM a JOIN b ON a.k = b.k JOIN c ON b.k = c.k JOIN d ON c.k = d.k JOIN e ON d.k = e.k JOIN f ON e.k = f.k JOIN g ON f.k = g.k WHERE a.k = {}", None),
    ("SELECT c_name FROM customer WHERE c_first || c_last = 'ab{}'", None),
    ("SELECT YEAR(o_orderdate), COUNT(*) FROM orders WHERE o_custkey = {} GROUP BY YEAR(o_orderdate)", None),
    ("SELECT c1, c2, c3, c4, c5, c6, c7, c8, c9, c10, c11, c12, c13, c14, c15, c16 FROM wide WHERE k = {} LIMIT 1", None),
    ("SELECT p_name FROM part WHERE p_name REGEXP '^a' AND p_partkey = {}", None),
    ("SELECT p_name FROM part WHERE FIND_IN_SET('a', p_tags) > 0 AND p_partkey = {}", None),
    ("SELECT p_name FROM part WHERE p_brand = 'a{}' LIMIT 10", None),
    ("SELECT p_name FROM part WHERE p_brand = 'a{}' LIMIT 1", None),
    ("SELECT p_name FROM part WHERE p_brand = 'q{}' LIMIT 7", "app.Parts$Proxy.existsByName:3"),
    ("SELECT p_name, SUM(p_size) OVER () AS s FROM part WHERE p_partkey = {}", None),
    ("SELECT p_name, ROW_NUMBER() OVER (ORDER BY p_size) AS r FROM part WHERE p_partkey = {}", None),
    ("SELECT p_name, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part WHERE p_partkey = {}", None),
    ("SELECT p_name FROM part WHERE CASE WHEN p_size > 1 THEN 1 ELSE 0 END = 1 AND p_partkey = {}", None),
    ("SELECT p_name FROM part WHERE p_size = CASE WHEN 1 = 1 THEN 2 ELSE {} END AND p_partkey = 4", None),
    ("SELECT p_name FROM part FORCE INDEX (idx_p_brand) WHERE p_brand = 'a{}'", None),
    ("SELECT p_name FROM part USE INDEX (idx_p_brand) WHERE p_brand = 'b{}'", "app.db.Migration.run:5"),
    ("SELECT o_orderkey FROM orders WHERE o_orderkey = {} FOR UPDATE", None),
    ("SELECT o_orderkey FROM orders WHERE o_orderkey = {} FOR UPDATE NOWAIT", None),
    ("SELECT o_orderkey FROM orders WHERE o_clerk = 'c{}' FOR UPDATE", None),
    ("SELECT o_orderkey FROM orders WHERE o_custkey = {} FOR UPDATE SKIP LOCKED", None),
    ("SELECT o_orderkey FROM orders WHERE o_totalprice > {} FOR SHARE NOWAIT", None),
    ("SELECT o_orderkey FROM orders FOR UPDATE NOWAIT -- lock {}", None),
    ("SELECT o_orderkey FROM orders WHERE o_clerk = 'a{}' AND o_totalprice > 5", None),
    ("SELECT o_orderkey FROM orders WHERE o_custkey = {} AND o_clerk = 'b'", None),
    ("SELECT o_orderkey FROM orders WHERE o_custkey = {} AND deleted_at IS NULL", None),
    ("SELECT c_name FROM customer WHERE deleted_at IS NULL LIMIT {}", None),
    ("SELECT c_name FROM customer WHERE c_type = 'a{}'", None),
    ("SELECT c_name FROM customer WHERE c_email = 'a{}'", None),
    ("SELECT o_orderkey FROM orders WHERE o_orderdate > {}", None),
    ("SELECT o_totalprice FROM orders WHERE o_custkey = {} ORDER BY o_totalprice LIMIT 5", None),
    ("SELECT c_name FROM customer WHERE c_nationkey = {} ORDER BY c_name LIMIT 5", None),
    ("SELECT c_name FROM customer ORDER BY c_acctbal LIMIT {}", None),
    ("SELECT c_mktsegment, COUNT(*) FROM customer WHERE c_acctbal > {} GROUP BY c_mktsegment", None),
    ("SELECT l_quantity FROM lineitem WHERE l_suppkey = {}", None),
    ("SELECT o_clerk, o_totalprice FROM orders WHERE o_custkey = {}", None),
    ("SELECT o_clerk, o_totalprice FROM orders WHERE o_custkey = {} AND o_orderstatus = 'F'", None),
    ("SELECT o.o_clerk FROM orders o JOIN lineitem l ON l.l_suppkey = o.o_suppkey WHERE o.o_suppkey = {} LIMIT 1", None),
    ("SELECT u1_0.c_name FROM customer u1_0 WHERE u1_0.c_phone = 'p{}' LIMIT 1", None),
    ("WITH big AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 5) SELECT o_orderkey FROM big WHERE o_orderkey = {}", None),
    ("SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand HAVING p_brand = 'b{}' AND LOWER(p_brand) = 'x'", None),
    ("SELECT p_name FROM part WHERE (? IS NULL OR p_brand = ?) AND (? IS NULL OR p_type = ?) AND (? IS NULL OR p_size = ?) AND p_partkey = {}", None),
    ("  select  c_name\n from customer\twhere c_custkey={} -- by key", None),
]

CATALOG: list[tuple[str, str, str, int, bool, int]] = [
    ("orders", "PRIMARY", "o_orderkey", 1, False, 15000),
    ("orders", "idx_o_custkey", "o_custkey", 1, True, 1500),
    ("orders", "idx_o_custkey_date", "o_custkey", 1, True, 1500),
    ("orders", "idx_o_custkey_date", "o_orderdate", 2, True, 9000),
    ("lineitem", "PRIMARY", "l_orderkey", 1, False, 15000),
    ("lineitem", "PRIMARY", "l_linenumber", 2, False, 60000),
    ("lineitem", "idx_l_part_supp", "l_partkey", 1, True, 2000),
    ("lineitem", "idx_l_part_supp", "l_suppkey", 2, True, 9000),
    ("lineitem", "idx_l_1", "l_shipdate", 1, True, 2500),
    ("lineitem", "idx_l_2", "l_quantity", 1, True, 50),
    ("lineitem", "idx_l_3", "l_tax", 1, True, 9),
    ("lineitem", "idx_l_4", "l_discount", 1, True, 11),
    ("lineitem", "idx_l_5", "l_returnflag", 1, True, 3),
    ("customer", "PRIMARY", "c_custkey", 1, False, 1500),
    ("customer", "uk_c_email", "c_email", 1, False, 1500),
    ("customer", "idx_c_nation", "c_nationkey", 1, True, 25),
    ("part", "PRIMARY", "p_partkey", 1, False, 2000),
    ("part", "idx_p_brand", "p_brand", 1, True, 25),
]

assert len(TEMPLATES) % 2 and len(TEMPLATES) % 5, len(TEMPLATES)


def parts(template: str) -> tuple[str, str, str]:
    """Text before, between and after the number."""
    head, *rest = template.split("{}")
    return head, rest[0] if len(rest) == 2 else "", rest[-1] if rest else ""


def _template_rows() -> list[tuple]:
    return [(k, t.count("{}"), *parts(t), stack) for k, (t, stack) in enumerate(TEMPLATES)]


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame(_template_rows(), "id int, k int, a string, b string, c string, stack_trace string")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    j = e.join(F.broadcast(t), (F.col("event_id") % len(TEMPLATES)) == F.col("id"))  # fixed number of templates
    n = F.col("event_id").cast("string")
    sql = F.when(F.col("k") == 0, F.col("a")).when(F.col("k") == 1, F.concat("a", n, "c")).otherwise(F.concat("a", n, "b", n, "c"))
    tenth = F.col("event_id") % 10
    return j.select(
        F.lit("r").alias("run_id"), F.concat(F.lit("svc_"), (F.col("user_id") % 10).cast("string")).alias("test_class"), F.lit("t").alias("test_name"), F.col("event_id").alias("seq"), sql.alias("sql"),
        (F.floor(F.col("value") * 10) * 1_000_000).cast("bigint").alias("exec_nanos"), "ts", "stack_trace", F.when(tenth == 0, "SETUP").when(tenth == 9, "TEARDOWN").otherwise("TEST").alias("phase"),
    )


def index_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, "table_name string, index_name string, column_name string, seq_in_index int, non_unique boolean, cardinality bigint")


def order_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test per order. Even orders: SELECT, DELETE, then an INSERT per line. Odd ones: SELECT of the lines, then a DELETE per line."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"))
    one = lambda seq, sql: F.struct(F.lit(seq).cast("bigint").alias("seq"), sql.alias("sql"))
    key = F.col("l_orderkey").cast("string")
    number = F.sequence(F.lit(1).cast("bigint"), F.col("k"))
    even = F.concat(
        F.array(one(0, F.concat(F.lit("SELECT o_orderkey FROM orders WHERE o_orderkey = "), key)), one(1, F.concat(F.lit("DELETE FROM lineitem WHERE l_orderkey = "), key))),
        F.transform(number, lambda i: F.struct((i + 1).alias("seq"), F.concat(F.lit("INSERT INTO lineitem (l_orderkey, l_linenumber) VALUES ("), key, F.lit(", "), i.cast("string"), F.lit(")")).alias("sql"))),
    )
    odd = F.concat(
        F.array(one(0, F.concat(F.lit("SELECT l_linenumber FROM lineitem WHERE l_orderkey = "), key))),
        F.transform(number, lambda i: F.struct(i.alias("seq"), F.concat(F.lit("DELETE FROM lineitem WHERE l_id = "), (F.col("l_orderkey") * 100 + i).cast("string")).alias("sql"))),
    )
    x = lines.select("l_orderkey", F.explode(F.when(F.col("l_orderkey") % 2 == 0, even).otherwise(odd)).alias("x"))
    return x.select(
        F.lit("r").alias("run_id"), F.lit("orders").alias("test_class"), key.alias("test_name"), "x.seq", "x.sql", F.lit(1_000_000).cast("bigint").alias("exec_nanos"),
        F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("stack_trace"), F.lit("TEST").alias("phase"),
    )


def lazy_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines loaded through their orders, a test per customer; every third customer's are proxies."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    role = F.when(F.col("o_custkey") % 3 == 0, "proxy:shop.Order").otherwise("shop.Order.lines")
    return o.select(F.lit("r").alias("run_id"), F.lit("lazy").alias("test_class"), F.col("o_custkey").cast("string").alias("test_name"), role.alias("role"), F.lit("Order").alias("owner_entity"), F.col("o_orderkey").cast("string").alias("owner_id"), F.col("o_orderdate").alias("ts"))


def explicit_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer loaded by id in the test of its nation."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.lit("r").alias("run_id"), F.lit("byid").alias("test_class"), F.col("c_nationkey").cast("string").alias("test_name"), F.lit("shop.Customer").alias("entity"), F.col("c_custkey").cast("string").alias("entity_id"), F.expr("make_timestamp_ntz(2024, 1, 1, 0, 0, cast(c_custkey % 60 as decimal(16, 6)))").alias("ts"), F.lit(None).cast("string").alias("stack_trace"))


def writes_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One write in each nation's test, half a minute in: even nations name customer_id."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    sql = F.when(F.col("n_nationkey") % 2 == 0, "INSERT INTO orders (o_id, customer_id) VALUES (1, 2)").otherwise("UPDATE orders SET o_comment = 'x' WHERE o_id = 1")
    return n.select(F.lit("r").alias("run_id"), F.lit("byid").alias("test_class"), F.col("n_nationkey").cast("string").alias("test_name"), F.lit(1).cast("bigint").alias("seq"), sql.alias("sql"), F.lit(0).cast("bigint").alias("exec_nanos"), F.expr("timestamp_ntz'2024-01-01 00:00:30'").alias("ts"), F.lit(None).cast("string").alias("stack_trace"), F.lit("TEST").alias("phase"))
