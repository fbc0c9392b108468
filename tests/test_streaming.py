import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import camera, pathtrace
from fieldloom.operators.scene import Actor, Light, Scene
from fieldloom.streaming import stepping


def test_iterate_cuts_lineage(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(4)], "idx long, val double")
    out = stepping.iterate(df, lambda d: d.withColumn("val", F.col("val") * 2), 7, every=3)
    assert [r["val"] for r in out.orderBy("idx").collect()] == [128.0 * k for k in range(4)]


def test_until(spark):
    df = spark.createDataFrame([(0, 1.0)], "idx long, val double")
    out, steps = stepping.until(df, lambda d: d.withColumn("val", F.col("val") + 1), lambda d: d.first()["val"] >= 3)
    assert steps == 2 and out.first()["val"] == 3.0


def test_nbody_keeps_momentum(spark):
    rng = np.random.default_rng(0)
    b = spark.createDataFrame([(k, *map(float, rng.normal(size=3)), 0.0, 0.0, 0.0, 1.0 + k) for k in range(6)], "id long, x double, y double, z double, vx double, vy double, vz double, m double")
    out = stepping.nbody(b, 0.01, 2)
    assert out.agg(F.sum(F.col("m") * F.col("vx"))).first()[0] == pytest.approx(0, abs=1e-9)


def test_boxes_propagate(spark):
    nodes = spark.createDataFrame([(0, 1, 2), (1, 3, 4)], "node long, left long, right long")
    leaves = spark.createDataFrame([(2, 5.0, 6.0), (3, 0.0, 1.0), (4, 2.0, 9.0)], "node long, lo double, hi double")
    got = {r["node"]: (r["lo"], r["hi"]) for r in stepping.propagate_boxes(nodes, leaves).collect()}
    assert got[1] == (0.0, 9.0) and got[0] == (0.0, 9.0)


def test_in_situ(spark, tmp_path):
    spark.range(20).selectExpr("id as idx", "cast(id % 3 as double) as val").write.parquet(str(tmp_path / "in"))
    seen = {}
    stream = spark.readStream.schema("idx long, val double").parquet(str(tmp_path / "in"))
    q = stepping.in_situ(stream, lambda d: d.where("val > 1"), lambda d, k: seen.__setitem__(k, d.count()), str(tmp_path / "check"))
    q.awaitTermination()
    assert sum(seen.values()) == 6


def test_windowed(spark, tmp_path):
    spark.range(10).selectExpr("timestamp_seconds(id * 30) as ts", "1.0 as v").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "ev"))
    q = stepping.windowed(stream, "ts", "v", "1 minute", "1 minute").writeStream.outputMode("complete").format("memory").queryName("wins").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["n"] for r in spark.table("wins").collect()} == {2}


def test_trace_misses_see_the_background_and_hits_are_lit(spark):
    pts = spark.createDataFrame([(0, -1.0, -1.0, 0.0), (1, 1.0, -1.0, 0.0), (2, 0.0, 1.0, 0.0)], "pt_id long, x double, y double, z double")
    tri = spark.createDataFrame([(0, 0, 1, 2)], "tri_id long, v0 long, v1 long, v2 long")
    cam = camera.orthographic((0, 0, 5), (0, 0, 0), view_height=6.0, width=6, height=6)
    scene = Scene([Actor(pts, tri, (0.5, 0.5, 0.5))], [Light((0.0, 0.0, 1.0), 1.0, directional=True)], (0.0, 0.0, 0.25))
    got = {r["pid"]: r for r in pathtrace.trace(scene, cam, spark, 1, 0, cells=2).collect()}
    assert len(got) == 36
    assert got[0]["depth"] == -1 and got[0]["b"] == 0.25
    hits = [r for r in got.values() if r["depth"] > 0]
    assert hits and all(r["depth"] == pytest.approx(5) and r["r"] == pytest.approx(0.5) for r in hits)
