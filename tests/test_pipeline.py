import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.dataset import LABEL, TIME, Dataset
from tidewatch.plans.pipeline import Alternative, Config, Incremental, Param, ParamCycle, ParamList, Pipeline, Stage, run_grid
from tidewatch.sources import readers
from tidewatch.streaming import windows as streams


@pytest.fixture
def data(spark):
    rows = [("a", dt.date(2020, 1, k + 1), float(k)) for k in range(3)]
    return Dataset.of(spark.createDataFrame(rows, f"{LABEL} string, {TIME} date, v double"), ["v"])


def scaled(d, k):
    return d.with_df(d.df.withColumn("v", F.col("v") * k))


def added(d, k):
    return d.with_df(d.df.withColumn("v", F.col("v") + k))


def test_cycle_runs_and_history(spark, data):
    p = Pipeline(lambda run_id: data, [Stage("scale", scaled, ParamCycle([1, 10, 100]))]).run(3)
    assert [r.v for r in p.data().where("v > 0").orderBy("run_id", TIME).collect()] == [1, 2, 10, 20, 100, 200]
    assert [r.description for r in p.history(spark).where("stage_no = 1").orderBy("run_id").collect()] == ["scale[1]", "scale[10]", "scale[100]"]
    p.reset()
    assert p.runs == [] and p.metadata() == ["scale[1]"]


def test_alternative_and_incremental(data):
    alt = Alternative([Stage("one", scaled, Param(1)), Stage("two", scaled, Param(2, choices=[2, 3]))])
    assert alt.metadata() == "one[1]"
    inc = Incremental([Stage("s", scaled, Param(2)), Stage("t", added, Param(1))])
    p = Pipeline(lambda run_id: data, [inc]).run(2)
    assert [r.v for r in p.data().orderBy("run_id", TIME).collect()] == [0, 2, 4, 1, 3, 5]
    assert "#INCA(s)" in p.dot() and "#SC(" not in p.dot()
    assert p.nested_types() == "#INCA(#SC(s)#SC(t))"
    made = []
    count = Incremental([Stage("s", lambda d: made.append("s") or d), Stage("t", lambda d: made.append("t") or d)], cache=True)
    Pipeline(lambda run_id: data, [count]).run(3)
    assert made == ["s", "t"]  # a shared step is made once
    both = Pipeline(lambda run_id: data, [alt]).run(4)
    assert len(both.runs) == 4
    both.reset()
    assert alt.at == 0


def test_missing_result_is_found_when_building(data):
    with pytest.raises(KeyError, match="needs results"):
        Pipeline(lambda run_id: data, [Stage("x", lambda d: d, needs=("pca",))]).run()
    named = Pipeline(lambda run_id: data, [Stage("snap", lambda d: readers.snapshot(d, "pca")), Stage("x", lambda d: d, needs=("pca",))]).run()
    assert named.results("pca").count() == 3


def test_grid_and_parameters(spark):
    out = run_grid(lambda k: spark.range(k), [{"k": 1}, {"k": 2}])
    assert sorted(r.run_id for r in out.collect()) == [0, 1, 1]
    assert ParamList([Param(1), Param(2)])() == [1, 2]
    with pytest.raises(ValueError):
        Pipeline(lambda run_id: None, []).run(perturb="x")


def test_config(tmp_path, spark):
    c = Config(str(tmp_path / "c.json"), spark)
    c.set("cluster", "name", "x")
    assert c.get("cluster", "name") == "x"
    assert c.get("cluster", "none", "1") == "1"


def test_gap_sessions(spark, tmp_path):
    rows = [("a", dt.datetime(2020, 1, 1, 0, m)) for m in (0, 5, 40, 45)]
    spark.createDataFrame(rows, "label string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("label string, ts timestamp").parquet(str(tmp_path / "in"))
    q = streams.gap_sessions(stream, "ts", "label").writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("sessions").collect()) == [2, 2]
