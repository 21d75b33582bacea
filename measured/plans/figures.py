"""Measures, statistics and reports as tables, with SQL that counts the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import reports, runner
from ..functions import geo, region, words
from ..functions.digest import digest
from ..operators import footers, measure, overlap, statistics
from ..operators.recursion import closure_size, walk
from ..sources.tables import Tables
from . import questions as q

QUERIES: dict = {}
SQL: dict[str, str] = {}


def figure(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def watched(t: Tables, name: str) -> measure.Watched:
    return measure.Watched(name, getattr(t, name))


def table(t: Tables, rows: list[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


PREDICATES = {
    "orders": ["o_custkey < 50 AND o_orderstatus = 'F'", "12 = month(o_orderdate) AND o_orderdate >= TIMESTAMP_NTZ'1996-12-01'", "o_custkey IN (1, 2, 3 + 4) AND o_orderpriority IS NOT NULL", "o_totalprice IS NULL"],
    "part": ["p_size BETWEEN 10 AND 20 AND p_brand = 'Brand#3'", "p_name LIKE 'old%' OR p_size = 7"],
}


def _counts() -> str:
    plain = lambda p: p.replace("TIMESTAMP_NTZ'", "TIMESTAMP '")
    return " UNION ALL ".join(f"SELECT '{n}' AS relation, {i} AS predicate, count(*) FILTER (WHERE {plain(p)}) AS selected, count(*) AS of_rows FROM {n}" for n, ps in PREDICATES.items() for i, p in enumerate(ps))


@figure(_counts())
def f01_rows_of_predicates(t: Tables) -> DataFrame:
    """Each predicate with all its conjuncts, measured in one pass within a
    budget of each table's bytes once a predicate."""
    rows = []
    for name, texts in PREDICATES.items():
        w = watched(t, name)
        with measure.planning(len(texts) * w.size):
            rows += [(name, i, m.rows, m.of) for i, p in enumerate(texts) if (m := w.rows(p))]
    return table(t, rows, "relation string, predicate int, selected bigint, of_rows bigint")


@figure("SELECT 'o_custkey < 50' AS conjunct, count(*) FILTER (WHERE o_custkey < 50) AS selected FROM orders UNION ALL SELECT 'o_orderstatus = F', count(*) FILTER (WHERE o_orderstatus = 'F') FROM orders UNION ALL SELECT 'o_totalprice > 1000', count(*) FILTER (WHERE o_totalprice > 1000) FROM orders")
def f02_rows_of_conjuncts(t: Tables) -> DataFrame:
    w = watched(t, "orders")
    with measure.planning(w.size):
        m = w.rows("50 > o_custkey AND 'F' = o_orderstatus AND o_totalprice > 1000")
    names = ["o_custkey < 50", "o_orderstatus = F", "o_totalprice > 1000"]
    return table(t, [(a, n) for a, (_, n) in zip(names, m.alone, strict=True)], "conjunct string, selected bigint")


TOUCHED = ["l_orderkey < 100", "l_shipdate >= TIMESTAMP_NTZ'2050-01-01'", "l_linenumber >= 0 AND l_orderkey >= 0", "l_returnflag IS NULL"]


@figure(" UNION ALL ".join(f"SELECT {i} AS predicate, count(*) FILTER (WHERE {p.replace('TIMESTAMP_NTZ', 'TIMESTAMP ')}) AS selected, TRUE AS held, count(*) AS of_rows FROM lineitem" for i, p in enumerate(TOUCHED)))
def f03_bounds_from_footers(t: Tables) -> DataFrame:
    """Footers bound the rows without reading one: held says that the count lies
    between, and that an estimate of all rows is clamped to the bound."""
    all_ = footers.groups(t.lineitem)
    n = t.lineitem.agg(*[F.count_if(F.expr(p)) for p in TOUCHED]).first()
    rows = []
    for i, p in enumerate(TOUCHED):
        low, high, _ = footers.bracket(t.lineitem, p, all_)
        of = sum(g.rows for g in all_)
        rows.append((i, n[i], low <= n[i] <= high and footers.clamped(of, t.lineitem, p) == high, of))
    return table(t, rows, "predicate int, selected bigint, held boolean, of_rows bigint")


@figure("SELECT 'o_orderkey' AS name, CAST(min(o_orderkey) AS VARCHAR) AS least, CAST(max(o_orderkey) AS VARCHAR) AS most FROM orders UNION ALL SELECT 'o_orderstatus', min(o_orderstatus), max(o_orderstatus) FROM orders UNION ALL SELECT 'o_orderdate', CAST(min(o_orderdate) AS VARCHAR), CAST(max(o_orderdate) AS VARCHAR) FROM orders")
def f04_ends_of_columns(t: Tables) -> DataFrame:
    """First and last value of columns, by footers alone."""
    all_ = footers.groups(t.orders)
    return table(t, [(c, *map(str, footers.ends(all_, c))) for c in ("o_orderkey", "o_orderstatus", "o_orderdate")], "name string, least string, most string")


@figure("SELECT o_orderstatus AS block, count(DISTINCT o_custkey) AS steps, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def f05_steps_inside_blocks(t: Tables) -> DataFrame:
    """Places of the next column inside each block of a list."""
    return t.orders.where("o_orderstatus in ('F', 'O')").groupBy(F.col("o_orderstatus").alias("block")).agg(F.count_distinct("o_custkey").alias("steps"), F.count("*").alias("n"))


ALL_OF = "o_custkey < 300 AND o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')"


@figure(f"SELECT 'entries' AS how, count(*) AS n FROM orders WHERE {ALL_OF} UNION ALL SELECT 'addresses', count(*) FROM orders WHERE {ALL_OF} UNION ALL SELECT 'computed', -1")
def f06_rows_in_all_conditions(t: Tables) -> DataFrame:
    """By one pass over stored columns, by meeting addresses, and refused where
    a condition is of something computed."""
    w = watched(t, "orders")
    stored = {"o_custkey", "o_orderstatus", "o_orderpriority"}
    refused = overlap.on_entries(w, "month(o_orderdate) = 12", stored)
    return table(t, [("entries", overlap.on_entries(w, ALL_OF, stored)), ("addresses", overlap.by_addresses(w, ALL_OF, 1 << 30)), ("computed", -1 if refused is None else refused)], "how string, n bigint")


WORDS = ["ring", "old", "anvil"]


@figure(
    "WITH w AS (SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {q._word_sql('p_name', w)}) AS {w}" for w in WORDS) + " FROM part) "
    "SELECT 'ring' AS query, CAST(ring AS BIGINT) AS n FROM w UNION ALL SELECT 'old & ring', CAST(round(n * (1.0::DOUBLE * old / n) * (1.0::DOUBLE * ring / n)) AS BIGINT) FROM w "
    "UNION ALL SELECT 'old | anvil', CAST(round(n * ((1.0::DOUBLE * old / n) + (1.0::DOUBLE * anvil / n) - (1.0::DOUBLE * old / n) * (1.0::DOUBLE * anvil / n))) AS BIGINT) FROM w UNION ALL SELECT '!ring', CAST(round(n * (1.0::DOUBLE - 1.0::DOUBLE * ring / n)) AS BIGINT) FROM w"
)
def f07_rows_of_words(t: Tables) -> DataFrame:
    """Each word's rows are counted, and combined as if words were independent."""
    w = watched(t, "part")
    with measure.planning(10 * w.size):
        rows = [(x, round(w.word_rows("p_name", words.parse(x)))) for x in ("ring", "old & ring", "old | anvil", "!ring")]
    return table(t, rows, "query string, n bigint")


@figure("SELECT '%GIZ%' AS pattern, count(*) FILTER (WHERE p_name LIKE '%giz%') AS bound FROM part UNION ALL SELECT '%a%', -1 UNION ALL SELECT 'cased %gear%', -1")
def f08_rows_of_patterns(t: Tables) -> DataFrame:
    """At most as many rows match as hold the rarest trigram a pattern needs;
    one that needs none, or is cased, isn't measured."""
    w = watched(t, "part")
    with measure.planning(10 * w.size):
        got = [("%GIZ%", w.pattern_rows("p_name", "%GIZ%")), ("%a%", w.pattern_rows("p_name", "%a%")), ("cased %gear%", w.pattern_rows("p_name", "%gear%", cased=True))]
    return table(t, [(p, -1 if n is None else n) for p, n in got], "pattern string, bound bigint")


SIDE = 2_000_000.0


@figure(f"SELECT CAST(floor(x / {SIDE}) AS BIGINT) AS cell0, CAST(floor(y / {SIDE}) AS BIGINT) AS cell1, CAST(floor(z / {SIDE}) AS BIGINT) AS cell2, count(*) AS n FROM {q._placed_sql()} c GROUP BY 1, 2, 3")
def f09_cells_of_places(t: Tables) -> DataFrame:
    return measure.cell_table(q.placed(t), ["x", "y", "z"], SIDE)


@figure(f"SELECT 'ball' AS shape, count(*) FILTER (WHERE {q._near_sql(5e6)}) AS counted, TRUE AS close FROM {q._placed_sql()} c UNION ALL SELECT 'box', count(*) FILTER (WHERE {q._box_sql(5e6)}), TRUE FROM {q._placed_sql()} c")
def f10_rows_of_regions(t: Tables) -> DataFrame:
    """Estimates by cells beside exact counts: close if within a tenth of all rows."""
    c = q.placed(t).persist()
    cells = measure.cell_table(c, ["x", "y", "z"], SIDE)
    centre, radius = list(geo.point(*q.CENTRE)), geo.chord(5e6)
    of = c.count()
    shapes = {"ball": geo.within(q.here(), *q.CENTRE, 5e6), "box": geo.in_box(q.here(), *q.CENTRE, 5e6)}
    rows = []
    for name, holds in shapes.items():
        n = c.where(holds).count()
        guess = measure.region_rows(cells, SIDE, centre, radius, box=name == "box", sphere=geo.RADIUS)
        rows.append((name, n, abs(guess - n) <= 0.1 * of))
    c.unpersist()
    return table(t, rows, "shape string, counted bigint, close boolean")


@figure(
    "SELECT 'o_orderstatus' AS name, count(DISTINCT o_orderstatus) AS different, CAST(round(10000.0 * (count(*) - count(o_orderstatus)) / count(*)) AS BIGINT) AS nulls FROM orders "
    "UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), 0 FROM orders UNION ALL SELECT 'o_orderkey', max(o_orderkey) - min(o_orderkey) + 1, 0 FROM orders"
)
def f11_column_statistics(t: Tables) -> DataFrame:
    """Nulls in ten-thousandths and different values; of whole numbers those
    between the ends, if there are no more than rows."""
    w = watched(t, "orders")
    rows = []
    for c in ("o_orderstatus", "o_orderpriority", "o_orderkey"):
        with measure.planning(100 * w.size):
            s = w.stats(c)
        rows.append((c, s.distinct, round(10_000 * s.nulls)))
    return table(t, rows, "name string, different bigint, nulls bigint")


@figure("SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1")
def f12_most_common_values(t: Tables) -> DataFrame:
    w = watched(t, "orders")
    with measure.planning(100 * w.size):
        s = w.stats("o_orderstatus")
    of = sum(g.rows for g in footers.groups(t.orders))
    return table(t, [(v, round(x * of)) for v, x in s.values.items()], "value string, n bigint")


@figure("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def f13_statistics_of_members(t: Tables) -> DataFrame:
    """A parent's shares from its members', each weighted by its rows."""
    all_ = []
    for s in ("F", "O", "P"):
        m = t.orders.where(F.col("o_orderstatus") == s)
        w = measure.Watched(f"orders {s}", m)
        with measure.planning(100 * w.size):
            all_.append((m.count(), w.stats("o_orderpriority")))
    s = measure.members(all_)
    of = sum(n for n, _ in all_)
    return table(t, [(v, round(x * of)) for v, x in s.values.items()], "value string, n bigint")


@figure("SELECT 'p_brand' AS name, count(DISTINCT p_brand) AS different FROM part UNION ALL SELECT 'alone', -1 UNION ALL SELECT 'other', -1")
def f14_distinct_of_grouped_subquery(t: Tables) -> DataFrame:
    got = [("p_brand", statistics.grouped_distinct(t.part, "p_brand", ["p_brand", "p_size"])), ("alone", statistics.grouped_distinct(t.part, "p_brand", ["p_brand"])), ("other", statistics.grouped_distinct(t.part, "p_type", ["p_brand", "p_size"]))]
    return table(t, [(a, -1 if n is None else n) for a, n in got], "name string, different bigint")


@figure(q.TREE.format(root=300) + " SELECT o_custkey AS value, count(*) AS n FROM orders WHERE o_custkey IN (SELECT id FROM sub) GROUP BY 1")
def f15_shares_of_walked_values(t: Tables) -> DataFrame:
    """Rows of each value that a recursion reaches, merged into a column's statistics."""
    n = q.nodes(t)
    values = walk(n, n.where("id = 300").select("id")).select(F.col("id").alias("o_custkey"))
    s = statistics.with_walked_values(t.orders, "o_custkey", measure.Stats(0.0, 0, {}), values)
    of = t.orders.count()
    return table(t, [(v, round(x * of)) for v, x in s.values.items()], "value bigint, n bigint")


@figure(q.TREE.format(root=9) + " SELECT count(*) AS n, count(DISTINCT id) AS different, TRUE AS whole FROM sub")
def f16_size_of_closure(t: Tables) -> DataFrame:
    n = q.nodes(t)
    c = closure_size(n, n.where("id = 9").select("id"), 1_000_000, tally=1_000_000)
    return table(t, [(int(c.rows), len(c.tallies), c.whole)], "n bigint, different bigint, whole boolean")


#: Runs made up from orders: a question a priority, a target a status, repeated
#: by key, some wrong or late.
RUNS = (
    "SELECT o_orderpriority AS question, o_orderstatus AS target, CASE WHEN o_custkey % 3 = 0 THEN 'cold' ELSE 'warm' END AS phase, o_orderkey AS rep, "
    "CASE WHEN o_custkey % 700 = 1 AND o_orderstatus = 'P' THEN 'WRONG' WHEN o_custkey % 500 = 2 AND o_orderpriority LIKE '2%' THEN 'TIMEOUT' ELSE 'RIGHT' END AS verdict, o_totalprice AS ms FROM orders"
)
LADDER = "['WRONG', 'TIMEOUT', 'CANCELLED', 'ERROR', 'NOT RUN', 'EXPLAIN FAILED', 'RIGHT']"


def _runs(t: Tables) -> DataFrame:
    k = F.col("o_custkey")
    verdict = F.when((k % 700 == 1) & (F.col("o_orderstatus") == "P"), "WRONG").when((k % 500 == 2) & F.col("o_orderpriority").startswith("2"), "TIMEOUT").otherwise("RIGHT")
    return t.orders.select(F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("target"), F.when(k % 3 == 0, "cold").otherwise("warm").alias("phase"), F.col("o_orderkey").alias("rep"), verdict.alias("verdict"), F.col("o_totalprice").alias("ms"))


@figure(
    f"SELECT question, target, phase, count(*) AS reps, count(*) FILTER (WHERE verdict = 'RIGHT') AS right_ones, {LADDER}[min(list_position({LADDER}, verdict))] AS verdict, "
    f"CASE WHEN count(*) = count(*) FILTER (WHERE verdict = 'RIGHT') THEN CAST(round(100 * median(ms)) AS BIGINT) END AS ms FROM ({RUNS}) r GROUP BY 1, 2, 3"
)
def f17_summary_of_runs(t: Tables) -> DataFrame:
    """Worst verdict and, if all were right, the middle time, in hundredths."""
    s = runner.summarise(_runs(t))
    return s.select("question", "target", "phase", "reps", F.col("right").alias("right_ones"), "verdict", F.round(F.col("ms") * 100).cast("bigint").alias("ms"))


@figure(
    f"WITH s AS (SELECT question, target, CASE WHEN count(*) = count(*) FILTER (WHERE verdict = 'RIGHT') THEN CAST(round(100 * median(ms)) AS BIGINT) END AS ms FROM ({RUNS}) r WHERE phase = 'warm' GROUP BY 1, 2) "
    "SELECT question, max(ms) FILTER (WHERE target = 'F') AS \"F\", max(ms) FILTER (WHERE target = 'O') AS \"O\", max(ms) FILTER (WHERE target = 'P') AS \"P\" FROM s GROUP BY 1"
)
def f18_grid_of_runs(t: Tables) -> DataFrame:
    g = runner.grid(runner.summarise(_runs(t)))
    return g.select("question", *[F.round(F.col(c) * 100).cast("bigint").alias(c) for c in "FOP"])


#: Scans made up from parts: a relation a brand, a target a type.
SCANS = (
    "SELECT p_type AS question, CASE WHEN p_partkey % 2 = 0 THEN 'on' ELSE 'off' END AS target, p_brand AS relation, CASE WHEN p_size % 4 > 0 THEN 'size ' || (p_size % 4) END AS filter, "
    "CAST(p_size AS DOUBLE) AS estimated, CAST(p_partkey % 40 AS DOUBLE) AS actual, CAST(1 + p_size % 3 AS BIGINT) AS loops, CAST(p_partkey % 40 AS BIGINT) AS read, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_size AS BIGINT) END AS witnessed FROM part"
)


def _scans(t: Tables) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return t.part.select(
        F.col("p_type").alias("question"), F.when(k % 2 == 0, "on").otherwise("off").alias("target"), F.col("p_brand").alias("relation"), F.when(s % 4 > 0, F.concat(F.lit("size "), (s % 4).cast("string"))).alias("filter"),
        s.cast("double").alias("estimated"), (k % 40).cast("double").alias("actual"), (1 + s % 3).cast("bigint").alias("loops"), (k % 40).alias("read"), F.when(k % 5 > 0, s.cast("bigint")).alias("witnessed"),
    )


@figure(f"WITH s AS (SELECT question, target, sum(estimated * loops) AS estimated, CAST(sum(read) AS BIGINT) AS read FROM ({SCANS}) x GROUP BY 1, 2), a AS (SELECT p_type AS question, count(*) AS n FROM part GROUP BY 1) SELECT s.question, target, n AS answered, estimated, read, CASE WHEN n > 0 THEN round(CAST(read AS DOUBLE) / n, 2) END AS read_per_answer FROM s JOIN a ON a.question = s.question")
def f19_rows_answered_and_read(t: Tables) -> DataFrame:
    return reports.rows_report(_scans(t), t.part.groupBy(F.col("p_type").alias("question")).agg(F.count("*").alias("rows")))


@figure(f"SELECT question, target, relation, filter, estimated, actual, round(greatest(greatest(estimated, 1.0::DOUBLE) / greatest(actual, 1.0::DOUBLE), greatest(actual, 1.0::DOUBLE) / greatest(estimated, 1.0::DOUBLE)), 3) AS off FROM ({SCANS}) x")
def f20_scans_by_how_far_off(t: Tables) -> DataFrame:
    return reports.scans_report(_scans(t))


@figure(f"SELECT question, relation, filter, min(actual) AS least, max(actual) AS most, count(*) AS targets FROM ({SCANS}) x GROUP BY 1, 2, 3 HAVING max(actual) - min(actual) > greatest(0.5::DOUBLE, max(actual) / 1000)")
def f21_scans_that_disagree(t: Tables) -> DataFrame:
    return reports.disagreements(_scans(t))


@figure(f"WITH x AS ({SCANS}) SELECT a.question, a.relation, a.filter, a.estimated AS was, b.estimated AS is_now FROM x a JOIN x b ON a.question = b.question AND a.relation = b.relation AND a.filter = b.filter WHERE a.target = 'off' AND b.target = 'on' AND a.estimated IS DISTINCT FROM b.estimated")
def f22_scans_that_moved(t: Tables) -> DataFrame:
    return reports.moved(_scans(t), "off", "on").withColumnRenamed("is", "is_now")


@figure(f"SELECT question, target, relation, filter FROM ({SCANS}) x WHERE filter IS NOT NULL AND witnessed IS NULL")
def f23_scans_unwitnessed(t: Tables) -> DataFrame:
    return reports.unwitnessed(_scans(t))


KEYS = {"orders": [("o_orderkey",), ("o_orderkey", "o_custkey")], "lineitem": [("l_orderkey", "l_linenumber")], "customer": [("c_name",), ("c_custkey",)], "part": [("p_partkey", "p_name"), ("p_partkey",)], "supplier": [("s_phone",)]}
_unique = lambda name, key: f"SELECT '{name}' AS relation, CASE WHEN count(*) = count(DISTINCT ({key})) THEN '{key.replace(' ', '')}' END AS key, CASE WHEN count(*) <> count(DISTINCT ({key})) THEN 'repeated keys' END AS refused FROM {name}"


@figure(" UNION ALL ".join([_unique("orders", "o_orderkey"), _unique("lineitem", "l_orderkey, l_linenumber"), _unique("customer", "c_custkey"), _unique("part", "p_partkey"), "SELECT 'supplier', NULL, 'no column s_phone'", "SELECT 'nation', NULL, 'no key'"]))
def f24_keys_of_all_tables(t: Tables) -> DataFrame:
    names = [*KEYS, "nation"]
    return table(t, [(r.table, r.key, r.refused) for r in reports.register_all({n: getattr(t, n) for n in names}, KEYS)], "relation string, key string, refused string")


@figure("SELECT 'nation' AS relation, count(*) AS n, TRUE AS steady FROM nation UNION ALL SELECT 'customer', count(*), TRUE FROM customer UNION ALL SELECT 'orders', count(*), TRUE FROM orders")
def f25_digests(t: Tables) -> DataFrame:
    """Digests of tables: alike in any order, other if a row is missing."""
    rows = []
    for n in ("nation", "customer", "orders"):
        df = getattr(t, n)
        k = df.columns[0]
        one, two, less = digest(df), digest(df.repartition(3, k)), digest(df.where(F.col(k) != 1))
        rows.append((n, one[0], one == two and one[1] != less[1] and less[0] == one[0] - 1))
    return table(t, rows, "relation string, n bigint, steady boolean")


@figure("SELECT k AS place, CAST(round(v * 1000) AS BIGINT) AS thousandths FROM (VALUES ('whole ball', 1.0), ('ball in its cube', 0.5235988), ('disc in its square', 0.7853982), ('cap of a sphere', 0.16), ('half a box', 0.5), ('apart', 0.0)) x(k, v)")
def f26_shares_of_regions(t: Tables) -> DataFrame:
    cube = lambda n, r=1.0: region.Cube((-r,) * n, (r,) * n)
    got = {
        "whole ball": region.ball_share(cube(3), (0, 0, 0), 2.0),
        "ball in its cube": region.ball_share(cube(3), (0, 0, 0), 1.0),
        "disc in its square": region.ball_share(cube(2), (0, 0), 1.0),
        "cap of a sphere": region.sphere_share(cube(3, 10.0), (0, 0, 10), 8.0, 10.0),
        "half a box": region.box_share(cube(2), region.Cube((-1.0, -1.0), (0.0, 1.0))),
        "apart": region.ball_share(cube(2), (9.0, 9.0), 1.0),
    }
    return table(t, [(k, round(1000 * v)) for k, v in got.items()], "place string, thousandths bigint")
