"""Feature sets, regions, words, footers, statistics, pressure and reports."""

import math

import pytest
from pyspark.sql import functions as F

from measured import __main__ as cli
from measured import features, reports, runner
from measured.functions import geo, region, spellings, stems, words
from measured.operators import footers, measure, overlap, pressure, statistics
from measured.operators.recursion import closure_size
from measured.operators.rewrites import Agg, TwoSided, union_join
from measured.sources import tables


@pytest.fixture(scope="module")
def t(spark, small):
    return tables.Tables(spark, small)


def test_features_switch_rewrites_and_measures(spark, t):
    o, l = t.orders.select("o_orderkey", "o_orderstatus"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("x"))
    two = TwoSided(o, l, ["o_orderkey"], ["o_orderstatus"], [], [Agg("sum", "s", "b", "x")])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(two.written())
    assert "LeftSemi" in plan(two.best()) and rows(two.best()) == want
    with features.using("without:key_limited"):
        assert "LeftSemi" not in plan(two.best()) and rows(two.best()) == want
    with features.using("none"):
        assert "_n_a" not in plan(two.best()) and rows(two.best()) == want
        assert closure_size(o, o, 1) is None
        arms = [l.where("x = 1"), l.where("x > 1")]
        assert plan(union_join(o, arms, ["o_orderkey"])).count("Join") == 2
        with measure.planning(1 << 40):
            assert measure.Watched("orders", t.orders).rows("o_custkey = 1") is None
    with pytest.raises(KeyError), features.using("only:union_join"):
        assert features.on("union_join") and not features.on("two_sided")
        raise KeyError
    assert features.on("two_sided")
    with pytest.raises(ValueError):
        features.on("nothing")


def test_best_is_chosen_by_counts(spark):
    far = spark.range(4000).select(F.col("id").alias("k"), F.col("id").alias("a"))
    near = spark.range(4000).select((F.col("id") % 40).alias("k"), F.col("id").alias("b"))
    for b, regrouped in ((near, True), (near.withColumn("k", F.col("b")), False)):
        two = TwoSided(far, b, ["k"], ["a"], [], [Agg("sum", "s", "b", "b")])
        with measure.planning(1 << 40):
            text = two.best()._jdf.queryExecution().optimizedPlan().toString()
        assert ("_n_a" in text) == regrouped


def test_balls_and_spheres():
    cube = lambda n, r=1.0: region.Cube((-r,) * n, (r,) * n)
    assert region.ball_share(cube(3), (0, 0, 0), 1.0) == pytest.approx(math.pi / 6, abs=0.002)
    assert region.ball_share(cube(1), (0,), 0.25) == pytest.approx(0.25)
    assert region.ball_share(region.Cube((0, 0, 1), (2, 2, 1)), (0, 0, 0), math.sqrt(2)) == pytest.approx(math.pi / 16, abs=0.003)
    for centre in ((10, 0, 0), (0, 0, 10), (0, -10, 0), (6, 0, -8)):
        assert region.sphere_share(cube(3, 10.0), centre, 8.0, 10.0) == pytest.approx(0.16, abs=0.002)
    half = region.Cube((0.0, -10.0, -10.0), (10.0, 10.0, 10.0))
    assert region.sphere_share(half, (0, 0, 10), 8.0, 10.0) == pytest.approx(0.16, abs=0.002)
    assert region.sphere_box((10, 0, 0), 3.0, half, 10.0) == pytest.approx(2 * 9 / 400, abs=0.003)


def test_spellings_of_a_region():
    want = spellings.Region("ball", "place", 55.5, -3.0, 1000.0)
    for x in ("earth_distance(place, ll_to_earth(55.5, -3)) < 1e3", "earth_distance(ll_to_earth(55.5,-3), place) < 1000", "1000 > earth_distance(place, ll_to_earth(55.5, -3.0))"):
        assert spellings.read(x) == want
    assert spellings.read("place <-> ll_to_earth(1, 2) <= 5") == spellings.Region("ball", "place", 1, 2, 5, False, True) == spellings.read("5 >= cube_distance(ll_to_earth(1,2), place)")
    assert spellings.read("place <@ earth_box(ll_to_earth(1, 2), 5)") == spellings.read("earth_box(ll_to_earth(1,2),5) @> place")
    found, rest = spellings.regions("earth_box(ll_to_earth(55.5, -3), 1000) @> place AND earth_distance(place, ll_to_earth(55.5, -3)) < 1000 AND k = 3")
    assert found == [want] and rest == ["k = 3"]
    assert spellings.read("k < 3") is None and spellings.read("earth_distance(a, b) < 3") is None


def test_words_of_any_script_and_stems(spark):
    df = spark.createDataFrame([("Ünïcode straße №5 日本",), ("The running of castles",), ("a castle",), ("old and cold rings",), (None,)], "t string")
    assert df.select(words.tokens(F.col("t"))).first()[0] == ["ünïcode", "straße", "5", "日本"]
    hit = lambda q: [r[0] for r in df.where(words.matches(words.english(F.col("t")), words.parse(q, stem=True))).collect()]
    assert hit("castle") == ["The running of castles", "a castle"] and hit("run & castled") == ["The running of castles"]
    assert hit("the") == [] and hit("the & ring") == ["old and cold rings"] == hit("old <-> and <-> cold") and hit("old <-> cold") == []
    assert hit("running <-> of <-> castle") == ["The running of castles"] and hit("!the") == []
    for w, s in {"relational": "relat", "hopping": "hop", "hoping": "hope", "flies": "fli", "ties": "tie", "agreed": "agre", "electricity": "electr", "generously": "generous", "skies": "sky", "boyish": "boyish", "controlling": "control", "sky": "sky", "yes": "yes"}.items():
        assert stems.stem(w) == s


def test_boxes_and_distances(spark):
    row = spark.range(1).select(F.array(F.lit(0.0), F.lit(0.0)).alias("a"), F.array(F.lit(3.0), F.lit(4.0), F.lit(0.0)).alias("b"))
    one, two = geo.box(F.col("a"), F.col("b")), geo.box(F.col("a"), F.array(F.lit(3.0), F.lit(4.0)))
    got = row.select(geo.straight(F.col("a"), F.col("b")), geo.same(one, two), geo.contains(one, two), geo.overlap(one, geo.box(F.array(F.lit(4.0)), F.array(F.lit(5.0)))), geo.along(F.lit(geo.chord(1e6))), geo.through(F.lit(1e6))).first()
    assert got[0] == 5.0 and tuple(got[1:4]) == (True, True, False) and got[4] == pytest.approx(1e6) and got[5] == pytest.approx(geo.chord(1e6))


def test_footers(spark, t, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id as string) as s", "if(id < 500, null, id) as n", "timestamp_ntz'2020-01-01' + make_interval(0,0,0,cast(id as int)) as at").repartitionByRange(4, "id").write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    all_ = footers.groups(df)
    assert sum(g.rows for g in all_) == 1000 and footers.ends(all_, "id") == (0, 999) and footers.order(all_, "id") == 1.0
    for text in ("id < 100", "id >= 250 and id < 600", "id = 3 + 4", "id in (1, 990)", "n is null", "n > 700", "at < timestamp_ntz'2020-03-01'", "id % 2 = 0", "id < 0", "s = 'x'", "not id < 5"):
        n, (low, high, touched) = df.where(text).count(), footers.bracket(df, text)
        assert low <= n <= high and (n == 0 or touched), text
    assert footers.bracket(df, "id < 250")[1] < 600 and footers.bracket(df, "id < 0")[:2] == (0, 0) and footers.bracket(df, "id >= 0")[:2] == (1000, 1000)
    assert footers.clamped(5000, df, "id < 250") == footers.bracket(df, "id < 250")[1]
    assert footers.groups(spark.range(3)) is None and statistics.every_row_analyzed(df, 1000) and not statistics.every_row_analyzed(df, 999) and not statistics.every_row_analyzed(df, None)


def test_rows_in_all_conditions(t):
    w = measure.Watched("orders", t.orders)
    text = "o_custkey < 60 and o_orderstatus = 'F' and o_totalprice is not null"
    n = t.orders.where(text).count()
    assert overlap.by_addresses(w, text, 1 << 30) == n == overlap.on_entries(w, text, {"o_custkey", "o_orderstatus", "o_totalprice"})
    assert overlap.by_addresses(w, text, 64) is None and overlap.on_entries(w, text, {"o_custkey"}) is None
    with measure.planning(10 * w.size):
        assert w.estimated("o_custkey < 60", [0.5, 0.5]) == t.orders.where("o_custkey < 60").count() / 4


def test_derived_statistics(spark):
    assert statistics.spans_distinct([(1, 5), (4, 9), (20, 20)], {5, 30}) == 11
    df = spark.createDataFrame([(i % 4,) for i in range(100)], "v long")
    s = statistics.with_walked_values(df, "v", measure.Stats(0.0, 2, {9: 0.9, 1: 0.1}), spark.createDataFrame([(0,), (1,), (77,)], "v long"))
    assert s.values[0] == s.values[1] == 0.25 and s.values[9] == pytest.approx(0.5) and sum(s.values.values()) <= 1.0001


def test_two_tables_of_one_name(spark):
    one, two = measure.Watched("t", spark.range(5), size=1), measure.Watched("t", spark.range(50), size=1)
    with measure.planning(10):
        assert one.rows("id >= 0").rows == 5 and two.rows("id >= 0").rows == 50


def test_pressure(spark, tmp_path):
    assert pressure.weight(0.5) == 2 and pressure.weight(1.0) == pytest.approx(100)
    (tmp_path / "d").write_text("   8 0 sda 1 2 3 4 5 6 7 8 9 25000 11\n")
    (tmp_path / "u").write_text("100.0 90.0\n")
    busy = pressure.busy_share("sda", str(tmp_path / "d"), str(tmp_path / "u"))
    assert busy is not None and pressure.busy_share("sdb", str(tmp_path / "d"), str(tmp_path / "u")) is None
    key = "spark.sql.files.openCostInBytes"
    was = spark.conf.get(key)
    with pytest.raises(KeyError), pressure.weighted(spark, 0.5, None):
        assert pressure._bytes(spark.conf.get(key)) == 2 * pressure._bytes(was)
        raise KeyError
    assert spark.conf.get(key) == was
    with pressure.clamped(spark) as most:
        assert 0 < most <= 10 << 20 and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == str(most)


def test_samples_targets_and_keys(spark, t, tmp_path):
    (tmp_path / "s.json").write_text('{"samples": {"quick": {"questions": ["q01"], "folder": "x"}}}')
    assert reports.samples(tmp_path / "s.json")["quick"]["folder"] == "x"
    (tmp_path / "bad.json").write_text('{"samples": {"quick": {"questions": []}}}')
    with pytest.raises(ValueError):
        reports.samples(tmp_path / "bad.json")
    (tmp_path / "s2.json").write_text('{"samples": {"quick": {"questions": ["q12_listed_sizes"], "folder": "%s"}}}' % t.folder)
    assert cli.main(["sample", str(tmp_path / "s2.json"), "quick", "--lock", str(tmp_path / "lock2")]) == 0
    with reports.alone(tmp_path / "lock"), pytest.raises(RuntimeError), reports.alone(tmp_path / "lock"):
        pass
    one = reports.target(spark, {"nation": t.nation})
    assert one == reports.target(spark, {"nation": t.nation}) and one["fingerprint"] != reports.target(spark, {"region": t.region})["fingerprint"]
    done = []
    parts = {"nation": t.nation, "nation_1": t.nation.where("n_nationkey < 5"), "lineitem": t.lineitem, "region": t.region}
    got = reports.register_all(parts, {"nation": [("n_nationkey", "n_name"), ("n_nationkey",)], "lineitem": [("l_orderkey",)]}, root_of={"nation_1": "nation"}, apply=lambda n, k: done.append((n, k)))
    assert [(r.table, r.key, r.refused) for r in got] == [("nation", "n_nationkey", None), ("nation_1", "n_nationkey", None), ("lineitem", None, "repeated keys"), ("region", None, "no key")]
    assert done == [("nation", ("n_nationkey",)), ("nation_1", ("n_nationkey",))]


def test_texts_that_hold_any_character(spark, tmp_path):
    schema = tables.declared(a="Text")
    df = spark.createDataFrame([("x\0y",), ("\\t",), ("\\\\n\t\\",), ("a\\\nb\r",), (None,), ("\\0",)], schema)
    tables.export_tsv(df, [], f"{tmp_path}/t")
    assert sorted(map(repr, tables.import_tsv(spark, schema, f"{tmp_path}/t").collect())) == sorted(map(repr, df.collect()))


def test_a_table_is_replaced_whole(spark, tmp_path):
    schema = tables.declared(n="Int")
    for n in (3, 5):
        tables.write_typed(spark.range(n).toDF("n"), schema, f"{tmp_path}/t")
        assert tables.read_typed(spark, schema, f"{tmp_path}/t").count() == n
    with pytest.raises(Exception):
        tables.write_typed(spark.sql("select 'x' as n"), schema, f"{tmp_path}/t")
    assert tables.read_typed(spark, schema, f"{tmp_path}/t").count() == 5


def test_runs_that_take_too_long(spark, small):
    slow = {"q": lambda s, d: s.range(10**10).selectExpr("sum(hash(id) * 1.0) as x")}
    expected = spark.createDataFrame([("q", 1, "0")], runner.EXPECTED)
    got = runner.run(spark, small, {"slow": slow}, expected, cold=0, warm=1, seconds=1.0).collect()
    assert [r.verdict for r in got] == ["TIMEOUT"]


def test_spellings_that_answer_alike(spark, small):
    q = lambda s, d: tables.Tables(s, d).nation.select("n_name")
    got = runner.derived(spark, small, q, {"same": lambda s, d: q(s, d).orderBy("n_name"), "less": lambda s, d: q(s, d).limit(2), "broken": lambda s, d: 1 / 0})
    assert got == {"same": "RIGHT", "less": "WRONG", "broken": "ERROR"}
