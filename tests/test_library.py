"""Rewrites, measures, digests, typed tables, walks and the runner."""

import math
import random

import pytest
from pyspark.sql import functions as F

from measured import runner
from measured.functions import digest, region, stats, words
from measured.operators import measure
from measured.operators.recursion import closure_size, reached, walk
from measured.operators.rewrites import Agg, Refused, TwoSided, union_join
from measured.session import settings
from measured.sources import tables


def same(a, b):
    assert a.columns == b.columns
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def sides(spark):
    a = spark.createDataFrame([(k, k % 3, k * 10 + i) for k in range(20) for i in range(k % 4)] + [(None, 1, 5)], "k long, ga long, x long")
    b = spark.createDataFrame([(k % 15, k % 2, None if k % 7 == 0 else k, float(k)) for k in range(60)] + [(None, 1, 5, 1.0)], "k long, gb long, y long, z double")
    return a, b


def test_two_sided(sides):
    aggs = [Agg("count_rows", "n"), Agg("count_distinct", "d", "a", "x"), Agg("sum", "s", "b", "y"), Agg("sum", "sa", "a", "x"), Agg("min", "lo", "b", "y"), Agg("max", "hi", "a", "x")]
    two = TwoSided(*sides, ["k"], ["ga"], ["gb"], aggs, {"x"})
    assert same(two.regrouped(), two.written())
    assert "LeftSemi" in two.regrouped()._jdf.queryExecution().optimizedPlan().toString()


def test_two_sided_refusals(sides):
    for agg, unique in ((Agg("count_distinct", "d", "a", "x"), set()), (Agg("sum", "s", "b", "z"), set()), (Agg("avg", "s", "b", "y"), set()), (Agg("count_distinct", "d", "b", "y"), {"y"})):
        two = TwoSided(*sides, ["k"], ["ga"], ["gb"], [agg], unique)
        with pytest.raises(Refused):
            two.regrouped()
    two = TwoSided(*sides, ["k"], ["ga"], ["gb"], [Agg("count_distinct", "d", "a", "x")])
    assert same(two.best(), two.written())


def test_union_join(sides):
    a, b = sides
    arms = [b.where("gb = 0"), b.where("gb = 1")]
    assert same(union_join(a, arms, ["k"]), a.join(arms[0], "k").unionByName(a.join(arms[1], "k")))
    with pytest.raises(Refused):
        union_join(a, [b, b.drop("z")], ["k"])


def test_walks(spark):
    tree = spark.createDataFrame([(i, i // 2 if i > 1 else None) for i in range(1, 41)], "id long, parent_id long")
    start = tree.where("id = 3").select("id")
    want = {i for i in range(1, 41) if any(i >> k == 3 for k in range(6))}
    assert {r.id for r in walk(tree, start).collect()} == want == {r.id for r in reached(tree, start).collect()}
    c = closure_size(tree, start, 1000)
    assert (c.rows, c.whole, set(c.tallies)) == (len(want), True, want)
    assert not closure_size(tree, start, 3).whole
    cycle = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id long, parent_id long")
    assert reached(cycle, cycle.where("id = 1").select("id")).count() == 3
    assert not closure_size(cycle, cycle.where("id = 1").select("id"), 50).whole


def test_digest(spark):
    df = spark.createDataFrame([("1", "48379c01", "72", "f", None), ("2", "3001", "0", "t", "")], "a string, b string, c string, d string, e string")
    assert digest.digest(df) == (2, "a902184c0b59ad4e6b0e923d7126800a") == digest.digest(df.orderBy(F.desc("a")))
    assert digest.digest(df.limit(0)) == (0, "0" * 32)
    assert digest.digest(df.unionByName(df.limit(1))) != digest.digest(df)


def test_canonical(spark):
    df = spark.sql("SELECT true a, 1.50BD b, 2.0BD c, 100BD d, -2.5e-07D e, 1e21D f, float(0.1) g, timestamp_ntz'2020-01-02 03:04:05.1' h, timestamp'2020-01-02 03:04:05Z' i, double('NaN') j, double('-Infinity') k, cast(null as double) l, date'2020-01-02' m, 7L n")
    row = df.select(*[digest.canonical(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first()
    assert tuple(row) == ("t", "1.5", "2", "100", "-0.00000025", "1000000000000000000000", "0.1", "2020-01-02 03:04:05.1", "2020-01-02 03:04:05+00", "NaN", "-inf", None, "2020-01-02", "7")


def test_stats():
    assert stats.median([3, 1, 2, 10]) == 2.5 and stats.spread([1, 4]) == 3 and stats.deviation([1, 2, 9]) == 1 and stats.constant([2, 2])
    for bad in ([], [math.nan], [1, math.inf]):
        with pytest.raises(ValueError):
            stats.median(bad)


def test_regions():
    whole, half = region.Cube((0.0, 0.0), (2.0, 2.0)), region.Cube((0.0, 0.0), (1.0, 2.0))
    assert region.box_share(whole, half) == 0.5 and region.box_share(half, whole) == 1.0
    assert region.box_share(whole, region.Cube((3.0, 0.0), (4.0, 1.0))) == 0.0
    assert region.ball_share(region.Cube((-1.0, -1.0), (1.0, 1.0)), (0.0, 0.0), 1.0) == pytest.approx(math.pi / 4, abs=0.01)
    assert region.ball_share(whole, (1.0, 1.0), 9.0) == 1.0 and region.ball_share(whole, (9.0, 9.0), 1.0) == 0.0
    assert region.nearest(whole, (3.0, 1.0)) == 1.0 and region.contains(whole, half) and region.meet(whole, half) == half


def test_words():
    q = words.parse("ring & !(red | old) | big <-> plate")
    assert words.share(words.parse("a & b"), lambda w: 0.5) == 0.25 and words.share(words.parse("a | !b"), lambda w: 0.5) == 0.75
    assert q.op == "or" and words.caseless("%1_2%") and not words.caseless("a%")
    assert words.required("%giz%") == ["giz"] and words.required("ab%") == ["  a", " ab"]
    for bad in ("a:*", "a:B", "(a", "a b"):
        with pytest.raises((ValueError, IndexError)):
            words.parse(bad)


def test_word_queries(spark):
    df = spark.createDataFrame([("Red Ring",), ("big plate ring",), ("plate big",), ("",), (None,)], "t string")
    hit = lambda q: [r[0] for r in df.where(words.matches(words.tokens(F.col("t")), words.parse(q))).collect()]
    assert hit("ring & !red") == ["big plate ring"] and hit("big <-> plate") == ["big plate ring"] and hit("red | plate") == ["Red Ring", "big plate ring", "plate big"]


def test_measures(spark, small):
    o, p = tables.Tables(spark, small).orders, tables.Tables(spark, small).part
    text = "month(o_orderdate) = 12 AND o_custkey < 50"
    s = measure.Watched("orders", o)
    assert s.rows(text) is None
    with measure.planning(10 * s.size) as r:
        assert s.rows(text).rows == o.where(text).count() and s.rows(text) is s.rows(text)
        used = r.budget.used
        assert s.stats("o_orderstatus").distinct == o.select("o_orderstatus").distinct().count() and r.budget.used == used + s.size
        with pytest.raises(RuntimeError), measure.planning(0):
            s.rows("o_custkey = 1")
            raise RuntimeError
        assert r.budget.used == used + s.size
        parts = measure.Watched("part", p)
        true = p.where("p_name ilike '%giz%'").count()
        assert true <= parts.pattern_rows("p_name", "%giz%") and parts.pattern_rows("p_name", "%Giz%", cased=True) is None
        assert parts.word_rows("p_name", words.parse("ring")) == p.where(words.matches(words.tokens(F.col("p_name")), words.parse("ring"))).count()
    with measure.planning(0):
        assert s.rows(text) is None
    with measure.planning(3 * s.size):
        assert s.stats("o_orderstatus") is not None and s.stats("o_orderpriority") is None


def test_conditions(spark):
    kinds = [c.kind for c in measure.conditions(spark, "month(d) = 12 and 5 < k and s in ('a', 'b') and k = j and z is null and y is not null and (a = 1 or b = 2)")]
    assert kinds == ["equal", "range", "list", "other", "null", "notnull", "other"]
    df = spark.createDataFrame([(1, 2)], "k long, j long")
    assert measure.at_most_one(df, ["k"], "k = 1 and j > 2") and not measure.at_most_one(df, ["k", "j"], "k = 1")
    partial = measure.Watched("t", df, where="k > 0", size=1)
    assert partial.covers("k > 0 and j = 1") and not partial.covers("j = 1")


def test_shares():
    assert sum(measure.whole({"a": 0.5, "b": 1.0}, 0.25).values()) == pytest.approx(0.75)
    assert measure.fit({"a": 0.2}, 0.1) == {"a": 0.2} and sum(measure.fit({"a": 2.0}, 0.1).values()) == pytest.approx(0.9)
    got = measure.members([(10, measure.Stats(0.0, 1, {"a": 1.0})), (30, measure.Stats(0.5, 1, {"b": 0.5}))])
    assert (got.nulls, got.distinct) == (0.375, 2) and got.values == {"a": 0.25, "b": 0.375}


def test_sized_join(spark, small):
    t = tables.Tables(spark, small)
    c = measure.Watched("customer", t.customer)
    with measure.planning(10 * c.size):
        df = measure.sized(t.orders, c, "c_custkey < 50", F.col("o_custkey") == F.col("c_custkey"), most_bytes=10 * c.size)
        assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == t.orders.join(t.customer.where("c_custkey < 50"), F.col("o_custkey") == F.col("c_custkey")).count()


def test_typed_tables(spark, tmp_path):
    schema = tables.declared(name="Text", n="Int", x="Float", ok="Bool")
    df = spark.createDataFrame([("a\tb\\t\n", 1, 0.5, True), (None, None, None, None), ("\\\\", -2, 1e300, False)], schema)
    tables.write_typed(df, schema, f"{tmp_path}/t")
    assert same(tables.read_typed(spark, schema, f"{tmp_path}/t"), df)
    with pytest.raises(ValueError):
        tables.read_typed(spark, tables.declared(name="Text"), f"{tmp_path}/t")
    with pytest.raises(ValueError):
        tables.write_typed(df.drop("n"), schema, f"{tmp_path}/u")
    tables.export_tsv(df, ["n"], f"{tmp_path}/tsv")
    assert same(tables.import_tsv(spark, schema, f"{tmp_path}/tsv"), df)
    with pytest.raises(ValueError):
        tables.export_tsv(spark.createDataFrame([("",)], "a string"), ["a"], f"{tmp_path}/v")


def test_settings(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(KeyError), settings(spark, spark__sql__shuffle__partitions="7"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "7"
        raise KeyError
    assert spark.conf.get("spark.sql.shuffle.partitions") == was


def test_runner(spark, small):
    own = {"q": lambda s, d: tables.Tables(s, d).nation.select("n_name"), "e": lambda s, d: tables.Tables(s, d).region}
    expected = runner.truth(spark, small, own)
    bad = {"q": lambda s, d: own["q"](s, d).limit(3), "e": lambda s, d: 1 / 0}
    found = runner.run(spark, small, {"own": own, "bad": bad}, expected, cold=1, warm=2)
    s = {(r.question, r.target, r.phase): r for r in runner.summarise(found).collect()}
    assert s["q", "own", "warm"].verdict == "RIGHT" and s["q", "own", "warm"].ms > 0 and s["q", "own", "warm"].reps == 2
    assert s["q", "bad", "warm"].verdict == "WRONG" and s["q", "bad", "warm"].ms is None and s["e", "bad", "cold"].verdict == "ERROR"
    assert runner.status(runner.summarise(found)) == runner.STATUS["WRONG"]
    assert {r.verdict for r in runner.check(spark, small, own, expected).collect()} == {"RIGHT"}
    r = random.Random(1)
    flaky = {"q": lambda s, d: s.range(1 + r.randrange(10**9), 2 + 10**9).limit(1)}
    with pytest.raises(runner.Unsteady):
        runner.truth(spark, small, flaky)


def test_walks_of_any_depth_and_beyond_the_driver(spark, monkeypatch):
    from measured.operators import recursion

    chain = spark.createDataFrame([(i, i - 1 if i > 1 else None) for i in range(1, 141)], "id long, parent_id long")
    odd = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), (None, "d"), ("x", None)], "`the id` string, `of` string")
    roots = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "`the id` string, `a b` int")
    cycle = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id long, parent_id long")
    want = sorted([("a", 1), ("b", 1), ("c", 1), ("d", 1), (None, 1), ("a", 2), ("b", 2), ("c", 2), ("d", 2), (None, 2), ("b", 3), ("d", 3), (None, 3), (None, 4)], key=str)
    for small in (10**6, 2):
        monkeypatch.setattr(recursion, "SMALL", small)
        assert sorted(map(tuple, walk(odd, roots, "the id", "of").collect()), key=str) == want
        assert {r[0] for r in reached(odd, roots.where("`a b` = 3"), "the id", "of").collect()} == {"b", "d", None}
        assert walk(cycle, cycle.limit(0).select("id")).count() == 0 == reached(cycle, cycle.limit(0).select("id")).count()
        with pytest.raises(RecursionError):
            walk(cycle, cycle.where("id = 1").select("id"))
        with pytest.raises(RecursionError):
            walk(chain, chain.where("id = 1").select("id"), levels=9)
    monkeypatch.undo()
    assert walk(chain, chain.where("id = 1").select("id")).count() == 140
    assert spark.conf.get("spark.sql.cteRecursionRowLimit", "1000000") != "-1"


def test_closures_that_stand_alone(spark):
    from measured.operators.recursion import self_contained

    assert self_contained(spark, "WITH RECURSIVE s AS (SELECT 1 AS id UNION ALL SELECT id + 1 FROM s WHERE id < 9) SELECT * FROM s")
    for x in ("SELECT * FROM not_there", "SELECT rand() AS r", "SELECT 1 AS one WHERE 1 = :p", "SELECT outer_column FROM range(3)"):
        assert not self_contained(spark, x)
