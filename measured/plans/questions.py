"""The question set over customers, orders, lines, parts and suppliers: each
as a DataFrame, and as SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, words
from ..operators.recursion import walk
from ..sources.tables import Tables

Question = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Question] = {}
SQL: dict[str, str] = {}


def question(sql: str):
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        SQL[f.__name__] = sql
        return f

    return add


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def between(c: str, low: str, high: str) -> Column:
    return (F.col(c) >= at(low)) & (F.col(c) < at(high))


def down(*names: str) -> list[Column]:
    return [F.col(n).desc_nulls_first() for n in names]


def up(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


#: Where customers live: made up from their keys, exact in hundredths of a degree.
LAT, LON = "((c_custkey * 37) % 12000 - 6000) / 100.0", "((c_custkey * 91) % 36000 - 18000) / 100.0"
CENTRE = (20.0, 10.0)


def placed(t: Tables) -> DataFrame:
    lat = ((F.col("c_custkey") * 37) % 12000 - 6000) / 100.0
    lon = ((F.col("c_custkey") * 91) % 36000 - 18000) / 100.0
    x, y, z = geo.xyz(lat, lon)
    return t.customer.withColumns({"x": x, "y": y, "z": z})


def here() -> tuple[Column, Column, Column]:
    return F.col("x"), F.col("y"), F.col("z")


def _placed_sql() -> str:
    r = geo.RADIUS
    return f"(SELECT *, {r} * cos(radians({LAT})) * cos(radians({LON})) AS x, {r} * cos(radians({LAT})) * sin(radians({LON})) AS y, {r} * sin(radians({LAT})) AS z FROM customer)"


def _box_sql(metres: float) -> str:
    half = geo.chord(metres)
    return " AND ".join(f"{c} BETWEEN {p - half!r} AND {p + half!r}" for c, p in zip("xyz", geo.point(*CENTRE), strict=True))


def _near_sql(metres: float) -> str:
    return " + ".join(f"({c} - ({p!r})) * ({c} - ({p!r}))" for c, p in zip("xyz", geo.point(*CENTRE), strict=True)) + f" < {geo.chord(metres) ** 2!r}"


def _word_sql(column: str, w: str) -> str:
    return f"list_contains(regexp_split_to_array(lower({column}), '[^a-z0-9]+'), '{w}')"


def has_word(column: str, q: str) -> Column:
    return words.matches(words.tokens(F.col(column)), words.parse(q))


def nodes(t: Tables) -> DataFrame:
    """Customers as a tree: the parent of k is k div 2; 1 is the root, 0 is
    under no one."""
    k = F.col("c_custkey")
    return t.customer.select(k.alias("id"), F.col("c_name").alias("name"), F.when(k > 1, F.floor(k / 2)).alias("parent_id"))


def subtree(t: Tables, root: int) -> DataFrame:
    n = nodes(t)
    return walk(n, n.where(F.col("id") == root).select("id"))


NODES = "(SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent_id FROM customer)"
TREE = "WITH RECURSIVE sub (id) AS (SELECT id FROM " + NODES + " WHERE id = {root} UNION ALL SELECT n.id FROM " + NODES + " n JOIN sub ON n.parent_id = sub.id)"

DECEMBERS = "month(o_orderdate) = 12 AND o_orderdate >= TIMESTAMP '1996-12-01' AND o_orderdate < TIMESTAMP '2001-01-01'"


def year() -> Column:
    return F.year("o_orderdate").cast("bigint").alias("year")


def decembers() -> Column:
    return (F.month("o_orderdate") == 12) & between("o_orderdate", "1996-12-01", "2001-01-01")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


@question("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders_n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-12-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1 ORDER BY 1")
def q01_orders_per_day(t: Tables) -> DataFrame:
    return t.orders.where(between("o_orderdate", "1997-12-01", "1998-01-01")).groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("orders_n")).orderBy("day")


@question("SELECT o_orderkey, o_custkey, l_linenumber, p_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderdate >= TIMESTAMP '1997-12-01' AND o_orderdate < TIMESTAMP '1997-12-03' ORDER BY 1, 3, 4")
def q02_two_days_with_their_parts(t: Tables) -> DataFrame:
    o = t.orders.where(between("o_orderdate", "1997-12-01", "1997-12-03"))
    return o.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("o_orderkey", "o_custkey", "l_linenumber", "p_name").orderBy("o_orderkey", "l_linenumber", "p_name")


@question("SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS orders_n FROM orders WHERE month(o_orderdate) = 12 GROUP BY 1 ORDER BY 1")
def q03_december_per_year(t: Tables) -> DataFrame:
    return t.orders.where(F.month("o_orderdate") == 12).groupBy(year()).agg(F.count("*").alias("orders_n")).orderBy("year")


@question(f"SELECT n_name AS nation, count(*) AS customers FROM {_placed_sql()} c JOIN nation ON n_nationkey = c_nationkey WHERE {_box_sql(4e6)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def q04_box_by_nation(t: Tables) -> DataFrame:
    c = placed(t).where(geo.in_box(here(), *CENTRE, 4e6))
    return c.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("customers")).orderBy(*down("customers"), "nation").limit(20)


@question(f"SELECT n_name AS nation, count(*) AS customers FROM {_placed_sql()} c JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE {_box_sql(5e6)} AND {_near_sql(5e6)} GROUP BY 1 ORDER BY 2 DESC, 1")
def q05_near_by_nation(t: Tables) -> DataFrame:
    c = placed(t).where(geo.in_box(here(), *CENTRE, 5e6) & geo.within(here(), *CENTRE, 5e6))
    return c.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("customers")).orderBy(*down("customers"), "nation")


@question(f"SELECT p_brand AS brand, count(*) AS parts FROM part WHERE {_word_sql('p_name', 'ring')} GROUP BY 1 ORDER BY 2 DESC, 1")
def q06_word_parts_by_brand(t: Tables) -> DataFrame:
    return t.part.where(has_word("p_name", "ring")).groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("parts")).orderBy(*down("parts"), "brand")


@question("SELECT DISTINCT p_partkey, p_name, p_size FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_name ILIKE '%GIZ%' ORDER BY p_size DESC, p_partkey")
def q07_substring_parts(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").ilike("%GIZ%")).join(t.lineitem, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("p_partkey", "p_name", "p_size").orderBy(*down("p_size"), "p_partkey")


@question("SELECT p_size, count(*) AS parts FROM part WHERE p_type = (SELECT min(p_type) FROM part) GROUP BY 1 ORDER BY 1")
def q08_one_type_per_size(t: Tables) -> DataFrame:
    least = t.part.agg(F.min("p_type").alias("p_type"))
    return t.part.join(F.broadcast(least), "p_type", "left_semi").groupBy("p_size").agg(F.count("*").alias("parts")).orderBy("p_size")


@question("SELECT s_suppkey, count(l_orderkey) AS lines FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey WHERE s_nationkey = 7 GROUP BY 1 ORDER BY 2 DESC, 1")
def q09_suppliers_lines(t: Tables) -> DataFrame:
    s = t.supplier.where("s_nationkey = 7")
    n = t.lineitem.join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").groupBy("l_suppkey").agg(F.count("l_orderkey").alias("n"))
    return s.join(n, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("lines")).orderBy(*down("lines"), "s_suppkey")


@question("SELECT p_partkey, p_name FROM part WHERE p_brand = (SELECT max(p_brand) FROM part) ORDER BY p_name, p_partkey")
def q10_one_brand(t: Tables) -> DataFrame:
    most = t.part.agg(F.max("p_brand").alias("p_brand"))
    return t.part.join(F.broadcast(most), "p_brand", "left_semi").select("p_partkey", "p_name").orderBy("p_name", "p_partkey")


@question(TREE.format(root=5) + " SELECT sub.id, count(*) AS orders_n FROM sub JOIN orders ON o_custkey = sub.id GROUP BY 1 ORDER BY 2 DESC, 1")
def q11_subtree_orders(t: Tables) -> DataFrame:
    return subtree(t, 5).join(t.orders, F.col("o_custkey") == F.col("id")).groupBy("id").agg(F.count("*").alias("orders_n")).orderBy(*down("orders_n"), "id")


SIZES = (1, 4, 9, 16, 25, 36, 49)


@question(f"SELECT p_size, count(*) AS parts FROM part WHERE p_size IN {SIZES} GROUP BY 1 ORDER BY 1")
def q12_listed_sizes(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_size").isin(*SIZES)).groupBy("p_size").agg(F.count("*").alias("parts")).orderBy("p_size")


@question(f"SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS orders_n, count(DISTINCT o_custkey) AS customers FROM orders WHERE {DECEMBERS} GROUP BY 1 ORDER BY 1")
def q13_decembers_with_customers(t: Tables) -> DataFrame:
    return t.orders.where(decembers()).groupBy(year()).agg(F.count("*").alias("orders_n"), F.count_distinct("o_custkey").alias("customers")).orderBy("year")


@question(f"SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders_n FROM orders JOIN {_placed_sql()} c ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '1997-12-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND {_box_sql(6e6)} AND {_near_sql(6e6)} GROUP BY 1 ORDER BY 1")
def q14_near_orders_per_day(t: Tables) -> DataFrame:
    c = placed(t).where(geo.in_box(here(), *CENTRE, 6e6) & geo.within(here(), *CENTRE, 6e6)).select("c_custkey")
    o = t.orders.where(between("o_orderdate", "1997-12-01", "1998-01-01"))
    return o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("orders_n")).orderBy("day")


@question(f"SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#11' AND {_word_sql('p_name', 'bolt')} ORDER BY p_name, p_partkey")
def q15_brand_and_word(t: Tables) -> DataFrame:
    return t.part.where((F.col("p_brand") == "Brand#11") & has_word("p_name", "bolt")).select("p_partkey", "p_name").orderBy("p_name", "p_partkey")


@question(TREE.format(root=3) + ", named AS (SELECT n.id, n.name FROM " + NODES + " n JOIN sub ON sub.id = n.id) SELECT named.id, named.name, count(*) AS orders_n FROM named JOIN orders ON o_custkey = named.id WHERE year(o_orderdate) >= 1996 AND year(o_orderdate) < 1998 GROUP BY 1, 2 ORDER BY 3 DESC, 1")
def q16_subtree_years(t: Tables) -> DataFrame:
    n = nodes(t)
    named = walk(n, n.where("id = 3").select("id")).join(n.select("id", "name"), "id")
    o = t.orders.where(between("o_orderdate", "1996-01-01", "1998-01-01"))
    return named.join(o, F.col("o_custkey") == F.col("id")).groupBy("id", "name").agg(F.count("*").alias("orders_n")).orderBy(*down("orders_n"), "id")


@question(TREE.format(root=2) + " SELECT c_custkey, c_name, c_mktsegment FROM sub JOIN customer ON c_custkey = sub.id WHERE c_mktsegment ILIKE '%mach%' ORDER BY c_custkey DESC LIMIT 20")
def q17_newest_in_subtree(t: Tables) -> DataFrame:
    return subtree(t, 2).join(t.customer.where(F.col("c_mktsegment").ilike("%mach%")), F.col("c_custkey") == F.col("id")).select("c_custkey", "c_name", "c_mktsegment").orderBy(*down("c_custkey")).limit(20)


@question(f"SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE {DECEMBERS} AND p_size IN {SIZES} GROUP BY 1 ORDER BY 1")
def q18_listed_decembers(t: Tables) -> DataFrame:
    o = t.orders.where(decembers())
    p = t.part.where(F.col("p_size").isin(*SIZES))
    return o.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey"), "left_semi").groupBy(year()).agg(F.count("*").alias("lines")).orderBy("year")


def wheel(brand: Column) -> Column:
    """A place on a wheel of 12, from the number in a brand: 0, 4 and 8 are
    primary. The definition is this library's own."""
    return F.regexp_extract(brand, "([0-9]+)", 1).cast("bigint") % 12


WHEEL = "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) % 12"


@question(TREE.format(root=5) + f" SELECT {WHEEL} AS wheel, count(DISTINCT o_orderkey) AS orders_n FROM sub JOIN orders ON o_custkey = sub.id JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE {WHEEL} IN (0, 1, 4, 8) GROUP BY 1 ORDER BY 2 DESC, 1")
def q19_subtree_wheel(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", wheel(F.col("p_brand")).alias("wheel")).where("wheel in (0, 1, 4, 8)")
    o = t.orders.join(subtree(t, 5), F.col("o_custkey") == F.col("id"), "left_semi").select("o_orderkey")
    return o.join(t.lineitem.select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey")).groupBy("wheel").agg(F.count_distinct("o_orderkey").alias("orders_n")).orderBy(*down("orders_n"), "wheel")


@question("SELECT n_name AS nation, count(*) AS orders_n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderdate >= TIMESTAMP '1997-12-08' AND o_orderdate < TIMESTAMP '1997-12-22' AND r_regionkey = 1 GROUP BY 1 ORDER BY 2 DESC, 1")
def q20_two_weeks_per_nation(t: Tables) -> DataFrame:
    n = t.nation.join(t.region.where("r_regionkey = 1"), F.col("r_regionkey") == F.col("n_regionkey"))
    o = t.orders.where(between("o_orderdate", "1997-12-08", "1997-12-22"))
    return o.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("orders_n")).orderBy(*down("orders_n"), "nation")


@question(f"SELECT o_orderkey, o_orderdate, l_linenumber, p_name, p_partkey FROM orders JOIN {_placed_sql()} c ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_name ILIKE '%rod%' AND {_box_sql(4e6)} ORDER BY o_orderdate DESC, o_orderkey, l_linenumber, p_partkey LIMIT 20")
def q21_newest_in_box(t: Tables) -> DataFrame:
    c = placed(t).where(geo.in_box(here(), *CENTRE, 4e6)).select("c_custkey")
    p = t.part.where(F.col("p_name").ilike("%rod%"))
    o = t.orders.join(c, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return o.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey")).select("o_orderkey", "o_orderdate", "l_linenumber", "p_name", "p_partkey").orderBy(*down("o_orderdate"), "o_orderkey", "l_linenumber", "p_partkey").limit(20)


FOREST = "(SELECT c_custkey AS id, CASE WHEN c_custkey >= 10 THEN c_custkey // 2 END AS parent_id FROM customer WHERE c_custkey >= 5)"


@question(
    f"WITH RECURSIVE root (id, root_id) AS (SELECT id, id FROM {FOREST} WHERE parent_id IS NULL UNION ALL SELECT n.id, r.root_id FROM {FOREST} n JOIN root r ON n.parent_id = r.id) "
    "SELECT r.root_id, c2.c_name AS root, count(*) AS orders_n FROM orders LEFT JOIN root r ON r.id = o_custkey LEFT JOIN customer c2 ON c2.c_custkey = r.root_id "
    "WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND (r.root_id IS NULL OR r.root_id NOT IN (6, 8)) GROUP BY 1, 2 ORDER BY 3 DESC, 1"
)
def q22_own_roots(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    n = t.customer.where("c_custkey >= 5").select(k.alias("id"), F.when(k >= 10, F.floor(k / 2)).alias("parent_id"))
    roots = walk(n, n.where("parent_id is null").select("id", F.col("id").alias("root_id")))
    o = t.orders.where(between("o_orderdate", "1996-01-01", "1998-01-01")).join(roots, F.col("id") == F.col("o_custkey"), "left")
    named = o.join(t.customer.select("c_custkey", F.col("c_name").alias("root")), F.col("c_custkey") == F.col("root_id"), "left")
    return named.where(F.col("root_id").isNull() | ~F.col("root_id").isin(6, 8)).groupBy("root_id", "root").agg(F.count("*").alias("orders_n")).orderBy(*down("orders_n"), *up("root_id"))


@question("SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS orders_n, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON c_custkey = o_custkey WHERE month(o_orderdate) = 12 AND c_name LIKE 'Customer#0000001%' GROUP BY 1 ORDER BY 1")
def q23_prefix_decembers(t: Tables) -> DataFrame:
    c = t.customer.where(F.col("c_name").startswith("Customer#0000001")).select("c_custkey")
    return t.orders.where(F.month("o_orderdate") == 12).join(c, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy(year()).agg(F.count("*").alias("orders_n"), F.count_distinct("o_custkey").alias("customers")).orderBy("year")


@question(TREE.format(root=5) + f" SELECT sub.id FROM sub WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey = sub.id AND p_size = 7 AND {_word_sql('p_name', 'anvil')}) ORDER BY 1")
def q24_subtree_with_word(t: Tables) -> DataFrame:
    p = t.part.where((F.col("p_size") == 7) & has_word("p_name", "anvil")).select("p_partkey")
    l = t.lineitem.join(p, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("l_orderkey")
    o = t.orders.join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_custkey")
    return subtree(t, 5).join(o, F.col("o_custkey") == F.col("id"), "left_semi").orderBy("id")


@question(
    "WITH RECURSIVE sub (id, name) AS (SELECT id, name FROM " + NODES + " WHERE id = 1 UNION ALL SELECT n.id, sub.name FROM " + NODES + " n JOIN sub ON n.parent_id = sub.id) "
    f"SELECT n_name AS nation, count(*) AS orders_n, count(DISTINCT o_custkey) AS customers, max(o_orderdate) AS newest FROM orders JOIN {_placed_sql()} c ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN sub ON sub.id = c_custkey "
    f"WHERE month(o_orderdate) >= 11 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2001-01-01' AND {_box_sql(9e6)} AND {_near_sql(9e6)} AND c_mktsegment ILIKE '%u%' "
    f"AND EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND p_size < 40 AND ({_word_sql('p_name', 'ring')} OR {_word_sql('p_name', 'gear')})) "
    "GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10"
)
def q25_everything(t: Tables) -> DataFrame:
    c = placed(t).where(geo.in_box(here(), *CENTRE, 9e6) & geo.within(here(), *CENTRE, 9e6) & F.col("c_mktsegment").ilike("%u%")).select("c_custkey", "c_nationkey")
    n = nodes(t)
    c = c.join(walk(n, n.where("id = 1").select("id", "name")), F.col("id") == F.col("c_custkey"), "left_semi")
    p = t.part.where((F.col("p_size") < 40) & has_word("p_name", "ring | gear")).select("p_partkey")
    l = t.lineitem.join(p, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("l_orderkey")
    o = t.orders.where((F.month("o_orderdate") >= 11) & between("o_orderdate", "1996-01-01", "2001-01-01"))
    o = o.join(c, F.col("c_custkey") == F.col("o_custkey")).join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return o.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("orders_n"), F.count_distinct("o_custkey").alias("customers"), F.max("o_orderdate").alias("newest")).orderBy(*down("orders_n", "customers"), "nation").limit(10)
