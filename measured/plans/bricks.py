"""Questions over a two-armed union of what orders bring: plain lines once,
and the lines of some parts several times; both sides of the join grouped first
where that is proved to give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rewrites import Agg, TwoSided, union_join
from ..operators.recursion import walk
from ..sources.tables import Tables
from . import questions as q

QUERIES: dict = {}
SQL: dict[str, str] = {}


def question(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        SQL[f.__name__] = sql
        return f

    return add


def arms(t: Tables) -> list[DataFrame]:
    """Lines not returned, once; returned lines of parts, p_size % 3 + 1 times."""
    l = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.col("l_quantity").cast("bigint").alias("quantity"), "l_returnflag")
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 3 + 1).cast("bigint").alias("copies"))
    one = l.where("l_returnflag <> 'R'").withColumn("copies", F.lit(1).cast("bigint"))
    more = l.where("l_returnflag = 'R'").join(p, "l_partkey")
    names = ["o_orderkey", "l_partkey", "quantity", "copies"]
    return [one.select(*names), more.select(*names)]


def lines(t: Tables) -> DataFrame:
    a, b = arms(t)
    return a.unionByName(b).withColumn("bricks", F.col("quantity") * F.col("copies"))


UNION = "(SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS quantity, 1 AS copies FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT), p_size % 3 + 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R')"
SUMS = "count(DISTINCT o_orderkey) AS orders_n, CAST(sum(quantity * copies) AS BIGINT) AS bricks"


def bought(t: Tables, orders: DataFrame, by: list[str]) -> DataFrame:
    """Orders and bricks per group of orders: each order key lies under itself,
    so both sides can be grouped by it first."""
    two = TwoSided(orders, lines(t).select("o_orderkey", "bricks"), ["o_orderkey"], by, [], [Agg("count_distinct", "orders_n", "a", "o_orderkey"), Agg("sum", "bricks", "b", "bricks")], {"o_orderkey"})
    return two.best().withColumn("bricks", F.col("bricks").cast("bigint"))


@question(f"SELECT CAST(o_orderdate AS DATE) AS day, {SUMS} FROM orders JOIN {q._placed_sql()} c ON c_custkey = o_custkey JOIN {UNION} u ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1997-12-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND {q._box_sql(6e6)} AND {q._near_sql(6e6)} GROUP BY 1 ORDER BY 1")
def b14_near_orders_bricks(t: Tables) -> DataFrame:
    c = q.placed(t).where(q.geo.in_box(q.here(), *q.CENTRE, 6e6) & q.geo.within(q.here(), *q.CENTRE, 6e6)).select("c_custkey")
    o = t.orders.where(q.between("o_orderdate", "1997-12-01", "1998-01-01")).join(c, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return bought(t, o.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day")), ["day"]).orderBy("day")


@question(f"SELECT CAST(year(o_orderdate) AS BIGINT) AS year, {SUMS} FROM orders JOIN {UNION} u ON l_orderkey = o_orderkey WHERE {q.DECEMBERS} GROUP BY 1 ORDER BY 1")
def b18_decembers_bricks(t: Tables) -> DataFrame:
    return bought(t, t.orders.where(q.decembers()).select("o_orderkey", q.year()), ["year"]).orderBy("year")


@question(q.TREE.format(root=5) + f" SELECT {q.WHEEL} AS wheel, {SUMS} FROM sub JOIN orders ON o_custkey = sub.id JOIN {UNION} u ON l_orderkey = o_orderkey JOIN part ON p_partkey = u.l_partkey WHERE {q.WHEEL} IN (0, 1, 4, 8) GROUP BY 1 ORDER BY 2 DESC, 1")
def b19_subtree_wheel_bricks(t: Tables) -> DataFrame:
    o = t.orders.join(q.subtree(t, 5), F.col("o_custkey") == F.col("id"), "left_semi").select("o_orderkey")
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), q.wheel(F.col("p_brand")).alias("wheel")).where("wheel in (0, 1, 4, 8)")
    return union_join(o, arms(t), ["o_orderkey"]).join(p, "l_partkey").groupBy("wheel").agg(F.count_distinct("o_orderkey").alias("orders_n"), F.sum(F.col("quantity") * F.col("copies")).cast("bigint").alias("bricks")).orderBy(*q.down("orders_n"), "wheel")


@question(
    f"WITH RECURSIVE root (id, root_id) AS (SELECT id, id FROM {q.FOREST} WHERE parent_id IS NULL UNION ALL SELECT n.id, r.root_id FROM {q.FOREST} n JOIN root r ON n.parent_id = r.id) "
    f"SELECT c_mktsegment AS segment, root_id, p_brand AS brand, p_size AS size, {SUMS} FROM orders JOIN customer ON c_custkey = o_custkey JOIN root ON root.id = c_custkey JOIN {UNION} u ON l_orderkey = o_orderkey JOIN part ON p_partkey = u.l_partkey WHERE {q.DECEMBERS} GROUP BY 1, 2, 3, 4 ORDER BY 6 DESC, 1, 2, 3, 4 LIMIT 20"
)
def bp_decembers_bricks(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    n = t.customer.where("c_custkey >= 5").select(k.alias("id"), F.when(k >= 10, F.floor(k / 2)).alias("parent_id"))
    roots = walk(n, n.where("parent_id is null").select("id", F.col("id").alias("root_id")))
    o = t.orders.where(q.decembers()).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(roots, F.col("id") == F.col("c_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("segment"), "root_id")
    b = lines(t).join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size")), "l_partkey").select("o_orderkey", "brand", "size", "bricks")
    two = TwoSided(o, b, ["o_orderkey"], ["segment", "root_id"], ["brand", "size"], [Agg("count_distinct", "orders_n", "a", "o_orderkey"), Agg("sum", "bricks", "b", "bricks")], {"o_orderkey"})
    return two.best().withColumn("bricks", F.col("bricks").cast("bigint")).orderBy(*q.down("bricks"), "segment", "root_id", "brand", "size").limit(20)
