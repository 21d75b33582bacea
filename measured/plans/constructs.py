"""Constructs of queries that the questions don't use, one query each, with SQL
for an independent engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, words
from ..operators.recursion import counting, reached
from ..sources.tables import Tables, parent, sampled
from . import questions as q
from .compose import answered

QUERIES: dict = {}
SQL: dict[str, str] = {}


def construct(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        SQL[f.__name__] = sql
        return f

    return add


@construct("SELECT c_custkey, x.orders_n, x.newest FROM customer CROSS JOIN LATERAL (SELECT count(*) AS orders_n, max(o_orderdate) AS newest FROM orders WHERE o_custkey = c_custkey) x WHERE c_nationkey = 7")
def c01_lateral_aggregate(t: Tables) -> DataFrame:
    """One aggregate an outer row: grouped once by the key, joined from the left."""
    c = t.customer.where("c_nationkey = 7").select("c_custkey")
    o = t.orders.join(F.broadcast(c), F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("newest"))
    return c.join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders_n"), "newest")


@construct("WITH RECURSIVE sub (id) AS (SELECT 1 UNION ALL SELECT id + 1 FROM sub WHERE id + 1 < 10000) SELECT CAST(id % 7 AS BIGINT) AS rest, count(*) AS n, CAST(sum(id) AS BIGINT) AS total FROM sub GROUP BY 1")
def c02_arithmetic_recursion(t: Tables) -> DataFrame:
    return counting(t.spark, 1, 10_000, 1).groupBy((F.col("id") % 7).alias("rest")).agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@construct("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def c03_having(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@construct("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderdate, o_orderkey, o_orderpriority FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def c04_first_row_of_each_key(t: Tables) -> DataFrame:
    """A maximum of rows, combined before the shuffle; no sort of each key's rows."""
    best = F.max_by(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"), F.struct("o_orderdate", -F.col("o_orderkey")))
    return t.orders.groupBy("o_custkey").agg(best.alias("x")).select("o_custkey", "x.*")


@construct("SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY 1")
def c05_distinct_texts_joined(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@construct("SELECT word, CAST(place AS BIGINT) AS place, count(*) AS n FROM (SELECT unnest(regexp_extract_all(p_name, '[a-z]+')) AS word, generate_subscripts(regexp_extract_all(p_name, '[a-z]+'), 1) AS place FROM part) x GROUP BY 1, 2")
def c06_matches_with_their_places(t: Tables) -> DataFrame:
    found = F.posexplode(F.regexp_extract_all("p_name", F.lit("([a-z]+)"), 1)).alias("at", "word")
    return t.part.select(found).groupBy("word", (F.col("at") + 1).cast("bigint").alias("place")).agg(F.count("*").alias("n"))


@construct("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def c07_numbered_in_order(t: Tables) -> DataFrame:
    """A number in one order of all rows, without one task for all: counted by
    month first, then numbered inside each month from what came before."""
    month = F.trunc("o_orderdate", "month")
    o = t.orders.select("o_orderkey", "o_orderdate", month.alias("month"))
    counts = o.groupBy("month").agg(F.count("*").alias("n"))
    before = counts.select("month", (F.sum("n").over(Window.orderBy("month")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("month").orderBy("o_orderdate", "o_orderkey"))
    return o.withColumn("own", own).join(F.broadcast(before), "month").select("o_orderkey", (F.col("before") + F.col("own")).alias("number"))


@construct("SELECT count(*) AS n, min(k) AS least, max(k) AS most, count(DISTINCT k) AS different FROM (SELECT row_number() OVER () AS k FROM lineitem) x")
def c08_numbered_in_any_order(t: Tables) -> DataFrame:
    """Numbers without gaps: those Spark deals by partition, less the gap
    before each partition."""
    id_ = F.monotonically_increasing_id()
    rows = t.lineitem.select(F.shiftright(id_, 33).alias("part"), id_.bitwiseAND((1 << 33) - 1).alias("own"))
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    k = rows.join(F.broadcast(before), "part").select((F.col("before") + F.col("own") + 1).alias("k"))
    return k.agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"), F.count_distinct("k").alias("different"))


@construct("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01')")
def c09_not_exists(t: Tables) -> DataFrame:
    o = t.orders.where(F.col("o_orderdate") >= q.at("1998-01-01"))
    return t.customer.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


RING = "(SELECT c_custkey AS id, (c_custkey * 7 + 3) % 1000 AS parent_id FROM customer)"


@construct(f"WITH RECURSIVE sub (id) AS (SELECT 5 UNION SELECT n.id FROM {RING} n JOIN sub ON n.parent_id = sub.id) SELECT CAST(id AS BIGINT) AS id FROM sub")
def c10_distinct_closure(t: Tables) -> DataFrame:
    """Links with cycles: UNION, not UNION ALL, ends."""
    k = F.col("c_custkey")
    n = t.customer.select(k.alias("id"), ((k * 7 + 3) % 1000).alias("parent_id"))
    return reached(n, t.spark.range(5, 6))


@construct("SELECT CAST(d AS DATE) AS day, count(o_orderkey) AS orders_n FROM generate_series(TIMESTAMP '1997-12-01', TIMESTAMP '1998-01-31', INTERVAL 1 DAY) s(d) LEFT JOIN orders ON o_orderdate = d AND o_orderpriority = '1-URGENT' GROUP BY 1")
def c11_series_of_days(t: Tables) -> DataFrame:
    days = t.spark.range(1).select(F.explode(F.sequence(F.lit("1997-12-01").cast("date"), F.lit("1998-01-31").cast("date"))).alias("day"))
    o = t.orders.where((F.col("o_orderpriority") == "1-URGENT") & q.between("o_orderdate", "1997-12-01", "1998-02-01")).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return days.join(o.groupBy("day").agg(F.count("*").alias("n")), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("orders_n"))


@construct("SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, o_orderdate + INTERVAL 36 HOUR AS later FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 20 DAY")
def c12_epoch_and_intervals(t: Tables) -> DataFrame:
    """A bound reckoned from the newest row: a scalar subquery, so that the scan
    of the outer table is filtered by its value."""
    seconds = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(1_000_000)
    newest = t.orders.agg(F.max("o_orderdate").alias("at"))
    o = t.spark.sql("SELECT * FROM {o} WHERE o_orderdate >= (SELECT at FROM {m}) - INTERVAL 20 DAY", o=t.orders, m=newest)
    return o.select("o_orderkey", seconds.cast("bigint").alias("seconds"), (F.col("o_orderdate") + F.expr("INTERVAL 36 HOUR")).alias("later"))


@construct("SELECT p_brand, count(*) AS parts FROM part WHERE p_size > (SELECT avg(p_size) FROM part) GROUP BY 1")
def c13_scalar_subquery(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT p_brand, count(*) AS parts FROM {p} WHERE p_size > (SELECT avg(p_size) FROM {p}) GROUP BY 1", p=t.part.select("p_brand", "p_size"))


@construct("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey BETWEEN 10 AND 60 AND o_orderpriority = '2-HIGH' GROUP BY 1")
def c14_question_with_parameters(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("c14_orders")
    return answered(t.spark, "SELECT o_orderstatus, count(*) AS n FROM c14_orders WHERE o_custkey BETWEEN :low AND :high AND o_orderpriority = :kind GROUP BY 1", low=10, high=60, kind="2-HIGH")


@construct("SELECT 'all' AS read, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders UNION ALL SELECT 'only', 0, 0 UNION ALL SELECT 'one', count(*), count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F'")
def c15_parent_and_members(t: Tables) -> DataFrame:
    """A parent read with its members, alone, and pruned to one of them."""
    p = parent(t.orders, "o_orderstatus", ["F", "O", "P"])
    read = lambda name, df: df.agg(F.lit(name).alias("read"), F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))
    return read("all", p.all()).unionByName(read("only", p.only())).unionByName(read("one", p.all().where("o_orderstatus = 'F'")))


@construct("SELECT c_nationkey, count(*) AS n FROM customer WHERE CAST('0x' || substr(md5('7:' || c_custkey), 1, 8) AS BIGINT) % 10000 < 2500 GROUP BY 1")
def c16_sample(t: Tables) -> DataFrame:
    """A quarter of the rows, the same ones whenever and wherever it is read."""
    return sampled(t.customer, "c_custkey", 25, seed=7).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@construct("SELECT p_brand, count(*) AS sizes, CAST(sum(p_size) AS BIGINT) AS total FROM (SELECT DISTINCT p_brand, p_size FROM part) x GROUP BY 1")
def c17_distinct_under_a_group(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_size").distinct().groupBy("p_brand").agg(F.count("*").alias("sizes"), F.sum("p_size").alias("total"))


@construct("SELECT c_custkey, c_name, count(o_orderkey) AS orders_n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def c18_grouped_by_a_unique_key(t: Tables) -> DataFrame:
    """Grouped by the key alone, before the join: the rest depends on it."""
    n = t.orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return t.customer.join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("orders_n"))


@construct("SELECT c_custkey, md5(c_name) AS digest, lpad(to_hex(c_custkey), 6, '0') AS hexadecimal, repeat('ab', CAST(c_nationkey % 4 AS BIGINT)) AS again, concat_ws('/', c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS path, substr(c_name, 10, 4) AS part, upper(c_mktsegment) || '!' AS loud FROM customer")
def c19_text_functions(t: Tables) -> DataFrame:
    """hex() of Spark is to_hex() in capitals."""
    hexadecimal = F.lpad(F.hex("c_custkey"), 6, "0")
    return t.customer.select("c_custkey", F.md5("c_name").alias("digest"), hexadecimal.alias("hexadecimal"), F.expr("repeat('ab', cast(c_nationkey % 4 as int))").alias("again"), F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("path"), F.substring("c_name", 10, 4).alias("part"), F.concat(F.upper("c_mktsegment"), F.lit("!")).alias("loud"))


@construct("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middling' ELSE 'large' END AS kind, nullif(p_brand, 'Brand#2') AS brand, format('{} of {}', p_size, p_name) AS said, coalesce(nullif(p_size, 7), -1) AS size FROM part")
def c20_cases_and_formats(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middling").otherwise("large")
    return t.part.select("p_partkey", kind.alias("kind"), F.nullif("p_brand", F.lit("Brand#2")).alias("brand"), F.format_string("%d of %s", "p_size", "p_name").alias("said"), F.coalesce(F.nullif("p_size", F.lit(7)), F.lit(-1)).alias("size"))


SEEN = "['BUILDING', 'MACHINERY', 'HOUSEHOLD', 'AUTOMOBILE', 'FURNITURE']"


@construct(f"SELECT CAST(coalesce(array_position({SEEN}, c_mktsegment), 0) AS BIGINT) AS place, k, count(*) AS n FROM (SELECT c_mktsegment, unnest([c_nationkey, c_nationkey + 1]) AS k FROM customer) x GROUP BY 1, 2")
def c21_positions_and_unnesting(t: Tables) -> DataFrame:
    seen = F.array(*[F.lit(x) for x in ("BUILDING", "MACHINERY", "HOUSEHOLD", "AUTOMOBILE", "FURNITURE")])
    rows = t.customer.select("c_mktsegment", F.explode(F.array("c_nationkey", F.col("c_nationkey") + 1)).alias("k"))
    return rows.groupBy(F.array_position(seen, F.col("c_mktsegment")).alias("place"), "k").agg(F.count("*").alias("n"))


def _side(i: int) -> str:
    return f"CAST(embedding[{i}] AS DOUBLE)"


@construct(
    "SELECT vec_id, a0 - 0.1 <= 0.15 AND a0 + 0.1 >= -0.05 AND a1 - 0.1 <= 0.2 AND a1 + 0.1 >= 0.0 AS overlaps, a0 - 0.1 <= -0.05 AND a0 + 0.1 >= 0.0 AND a1 - 0.1 <= 0.0 AND a1 + 0.1 >= 0.05 AS contains, "
    "a0 BETWEEN -0.05 AND 0.15 AND a1 BETWEEN 0.0 AND 0.2 AS inside, FALSE AS same "
    f"FROM (SELECT vec_id, {_side(1)} AS a0, {_side(2)} AS a1 FROM embeddings) e"
)
def c22_boxes(t: Tables) -> DataFrame:
    """Boxes around two coordinates of each vector against constant ones: overlap,
    containment either way, and being the same, missing sides counting as 0."""
    a = [F.col("embedding")[i].cast("double") for i in range(2)]
    own = geo.box(F.array(*[x - 0.1 for x in a]), F.array(*[x + 0.1 for x in a]))
    point = geo.box(F.array(*a), F.array(*a))
    of = lambda low, high: geo.box(F.array(*map(F.lit, low)), F.array(*map(F.lit, high)))
    wide, small = of([-0.05, 0.0], [0.15, 0.2]), of([-0.05, 0.0, 0.0], [0.0, 0.05, 0.0])
    return t.embeddings.select("vec_id", geo.overlap(own, wide).alias("overlaps"), geo.contains(own, small).alias("contains"), geo.contains(wide, point).alias("inside"), geo.same(own, wide).alias("same"))


@construct(
    f"SELECT c_custkey, CAST(round(sqrt(power(x - {geo.point(*q.CENTRE)[0]!r}, 2) + power(y - {geo.point(*q.CENTRE)[1]!r}, 2) + power(z - {geo.point(*q.CENTRE)[2]!r}, 2)) / 1000) AS BIGINT) AS straight_km, "
    f"CAST(round(2 * {geo.RADIUS} * asin(least(1.0, sqrt(power(x - {geo.point(*q.CENTRE)[0]!r}, 2) + power(y - {geo.point(*q.CENTRE)[1]!r}, 2) + power(z - {geo.point(*q.CENTRE)[2]!r}, 2)) / (2 * {geo.RADIUS}))) / 1000) AS BIGINT) AS along_km FROM {q._placed_sql()} c"
)
def c23_distances(t: Tables) -> DataFrame:
    """Straight through the sphere, and along it."""
    here, there = F.array("x", "y", "z"), F.array(*map(F.lit, geo.point(*q.CENTRE)))
    straight = geo.straight(here, there)
    km = lambda c: F.round(c / 1000).cast("bigint")
    return q.placed(t).select("c_custkey", km(straight).alias("straight_km"), km(geo.along(straight)).alias("along_km"))


def _has(column: str, w: str) -> str:
    return q._word_sql(column, w)


@construct(
    f"SELECT p_partkey, {_has('p_name', 'ring')} AS plural, {_has('p_name', 'gear')} AND NOT {_has('p_name', 'red')} AS but, {_has('p_name', 'bolt')} OR {_has('p_name', 'rod')} AND {_has('p_name', 'hot')} AS either, "
    "p_name LIKE '%old anvil%' AND NOT p_name LIKE '%cold anvil%' AS adjacent, FALSE AS stopped FROM part"
)
def c24_word_queries(t: Tables) -> DataFrame:
    """English words: inflected ones are found by their stem, stop words never."""
    has = lambda x: words.matches(F.col("stems"), words.parse(x, stem=True))
    return t.part.select("p_partkey", words.english(F.col("p_name")).alias("stems")).select("p_partkey", has("rings").alias("plural"), has("gears & !red").alias("but"), has("bolted | rod & hot").alias("either"), has("old <-> anvils").alias("adjacent"), has("the").alias("stopped"))


@construct(
    "SELECT gram, count(*) AS n FROM (SELECT DISTINCT p_partkey, substr('  ' || w || ' ', CAST(i AS BIGINT), 3) AS gram FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) x, range(1, 40) r(i) WHERE i <= length(w) + 1) y GROUP BY 1"
)
def c25_trigrams(t: Tables) -> DataFrame:
    return t.part.select(F.explode(words.trigrams(F.col("p_name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@construct("SELECT n_name, r_name, p_brand, count(*) AS lines FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = s_nationkey GROUP BY 1, 2, 3")
def c26_eight_relations(t: Tables) -> DataFrame:
    s = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    l = t.lineitem.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    o = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return l.join(o, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).groupBy("n_name", "r_name", "p_brand").agg(F.count("*").alias("lines"))


@construct("SELECT a.l_orderkey, a.l_linenumber, count(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_returnflag = 'R' AND b.l_returnflag <> 'R' GROUP BY 1, 2")
def c27_join_on_two_keys(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    return t.lineitem.where("l_returnflag = 'R'").select(*keys).join(t.lineitem.where("l_returnflag <> 'R'").select(*keys), keys).groupBy(*keys).agg(F.count("*").alias("pairs"))
