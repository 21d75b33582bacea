"""Templates, plans, feature sets, region counts and the command line."""

import math

import pytest
from pyspark.sql import functions as F

from measured import __main__ as cli
from measured import features
from measured.operators import measure
from measured.plans import compose, explain


def test_compose(tmp_path):
    (tmp_path / "shared").mkdir()
    (tmp_path / "q.sqlc").write_text("# a note\nSELECT * FROM (\n:compose(shared/both.sqlc, @one = shared/a.sqlc)\n) x;\n")
    (tmp_path / "shared/both.sqlc").write_text("SELECT * FROM (:compose(@one)) UNION ALL SELECT * FROM (:compose(@one))")
    (tmp_path / "shared/a.sqlc").write_text("# other note\nSELECT id FROM range(3);")
    text = compose.compose(tmp_path / "q.sqlc", [tmp_path])
    assert "#" not in text and ":compose" not in text and text.count("range(3)") == 2
    for bad in (":compose(@open)", ":compose(none.sqlc)", ":bind(x)", ":compose(bad.sqlc)"):
        (tmp_path / "bad.sqlc").write_text(bad)
        with pytest.raises(compose.Open):
            compose.compose(tmp_path / "bad.sqlc", [tmp_path])
    (tmp_path / "bad.sqlc").unlink()
    (tmp_path / "shared/both.sqlc").unlink()
    (tmp_path / "q.sqlc").write_text("SELECT 1 AS a")
    assert compose.load(tmp_path) == {"q": "SELECT 1 AS a", "shared/a": "SELECT id FROM range(3)"} and len(compose.named(compose.load(tmp_path))) == 16


def test_answered(spark):
    assert [r.a for r in compose.answered(spark, "SELECT id + :k AS a FROM range(2)", k=5).collect()] == [5, 6]
    for bad in ("CREATE TABLE t (a INT)", "SET x = 1", "DROP TABLE t"):
        with pytest.raises(ValueError):
            compose.answered(spark, bad)


def test_plans(spark, small):
    o = spark.read.parquet(f"{small}/orders.parquet")
    one = o.where("o_custkey < 10").groupBy("o_orderstatus").count()
    two = o.where("o_custkey < 10").groupBy("o_orderstatus").count()
    assert explain.parting(one, two) is None
    assert explain.parting(one, o.where("o_custkey < 11").groupBy("o_orderstatus").count()) is not None
    (leaf,) = explain.leaves(o.where("o_custkey < 10"))
    assert leaf.figures["numOutputRows"] == o.count()
    assert explain.agreement(100.4, 100) and not explain.agreement(102, 100)
    df, seen = explain.counted(o)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == o.count()


def test_features(spark, tmp_path):
    assert features.resolved("all") - features.resolved("without:closures") == {"closures"} and not features.resolved("none")
    (tmp_path / "s.json").write_text('{"sets": {"few": ["closures"]}}')
    assert features.resolved("few", features.read_sets(tmp_path / "s.json")) == {"closures"}
    for bad in ('{"sets": {"x": ["y"]}}', '{"other": 1}'):
        (tmp_path / "s.json").write_text(bad)
        with pytest.raises(ValueError):
            features.read_sets(tmp_path / "s.json")
    with pytest.raises(ValueError):
        features.resolved("without:nothing")


def test_watch(spark):
    with features.watched(spark, 60):
        assert spark.range(5).count() == 5
    slow = F.pandas_udf(lambda x: __import__("time").sleep(30) or x, "bigint")
    with pytest.raises(features.TimedOut), features.watched(spark, 1):
        spark.range(4).select(slow("id")).collect()


def test_region_rows(spark):
    n = 60
    df = spark.range(n * n).select((F.col("id") % n / n * 4 - 2).alias("x"), (F.floor(F.col("id") / n) / n * 4 - 2).alias("y"))
    cells = measure.cell_table(df, ["x", "y"], 0.25)
    true = df.where("x * x + y * y < 1.44").count()
    assert measure.region_rows(cells, 0.25, [0.0, 0.0], 1.2) == pytest.approx(true, rel=0.05)
    assert measure.region_rows(cells, 0.25, [0.0, 0.0], 1.0, box=True) == pytest.approx(n * n / 4, rel=0.02)
    assert measure.region_rows(cells, 0.25, [0.0, 0.0], 1.2, most=3) is None and math.pi > 3


def test_one_value(spark):
    assert measure.one_value(spark, "a = 1 and b > 2", ["c"], [("a", "c")]) and not measure.one_value(spark, "a = 1 and b > 2", ["b"])


def test_command_line(spark, small, tmp_path, capsys):
    only = ["--only", "q01_orders_per_day"]
    assert cli.main(["truth", small, f"{tmp_path}/e", *only]) == 0
    assert cli.main(["check", small, f"{tmp_path}/c", "--expected", f"{tmp_path}/e", *only]) == 0
    assert cli.main(["summarize", f"{tmp_path}/c"]) == 0 and "RIGHT" in capsys.readouterr().out
    assert cli.main(["export", f"{tmp_path}/e", f"{tmp_path}/t", "--kind", "expected"]) == 0
    assert cli.main(["import", f"{tmp_path}/t", f"{tmp_path}/f", "--kind", "expected"]) == 0
    assert spark.read.parquet(f"{tmp_path}/f").collect() == spark.read.parquet(f"{tmp_path}/e").collect()
