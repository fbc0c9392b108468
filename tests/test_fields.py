import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import bits, ieee
from fieldloom.functions import types as ty
from fieldloom.operators import joins, scan, stats
from fieldloom.sources import field as fl


def test_promotion():
    assert ty.promote(ty.u8, ty.i8) == ty.i16
    assert ty.promote(ty.u32, ty.i32) == ty.i64
    assert ty.promote(ty.u64, ty.i64) == ty.i64
    assert ty.promote(ty.i64, ty.f32) == ty.f32
    assert ty.promote(ty.u16, ty.i8) == ty.u16
    with pytest.raises(TypeError):
        ty.of_numpy(np.complex64)


def test_constructors_and_reductions(spark):
    f = fl.field_like(spark, np.array([[1, 2], [3, 4]], np.float32))
    assert f.shape == (2, 2) and f.sum() == 10 and f.mean() == 2.5 and f.min() == 1 and f.max() == 4
    assert f.reshape(4).to_numpy().tolist() == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        f.reshape(3)
    assert fl.arange(spark, 4).to_numpy().tolist() == [0, 1, 2, 3]
    assert fl.full(spark, ty.u8, 2, 300).to_numpy().tolist() == [44, 44]
    assert f.astype(ty.i32).to_numpy().dtype == np.int32
    assert fl.concat([fl.ones(spark, ty.i32, 2), fl.zeros(spark, ty.i32, 1)]).to_numpy().tolist() == [1, 1, 0]
    with pytest.raises(TypeError):
        fl.concat([fl.ones(spark, ty.i32, 2), fl.ones(spark, ty.f32, 1)])
    with pytest.raises(ValueError):
        fl.concat([])
    held = fl.from_dlpack(spark, np.arange(3.0))
    with pytest.raises(ValueError):
        held.fill(1)
    assert math.isnan(fl.field_like(spark, np.array([1.0, np.nan])).min())


def test_wrapping_casts(spark):
    df = spark.createDataFrame([(300.7,), (-1.5,), (70000.0,)], "x double")
    got = df.select(*[ty.cast(F.col("x"), t, ty.f64).alias(t.name) for t in (ty.i8, ty.u8, ty.i16, ty.u16)]).collect()
    assert [tuple(r) for r in got] == [(44, 44, 300, 300), (-1, 255, -1, 65535), (112, 112, 4464, 4464)]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_ieee(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        r = spark.range(1).select(ieee.fdiv(1.0, 0.0), ieee.fdiv(-1.0, 0.0), ieee.log(0.0), ieee.log(-1.0), ieee.fmax(F.lit(math.nan), F.lit(1.0)), ieee.idiv(F.lit(-7), F.lit(2)), ieee.compare("!=", F.lit(math.nan), F.lit(1.0))).first()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
    assert r[0] == math.inf and r[1] == -math.inf and r[2] == -math.inf and math.isnan(r[3]) and r[4] == 1.0 and r[5] == -3 and r[6] is False


def test_statistics(spark):
    df = fl.field_like(spark, np.array([1, -2, 3, -4], np.float32)).df
    assert stats.var(df) == pytest.approx(np.var([1, -2, 3, -4]))
    assert stats.norm(df, order=1) == 10 and stats.norm(df) == pytest.approx(math.sqrt(30)) and stats.norm(df, order=math.inf) == 4
    with pytest.raises(ValueError):
        stats.norm(df, order=3)
    assert stats.absmax(df) == 4 and stats.count_nonzero(df) == 4 and stats.dot(df, df) == 30
    h = stats.histogram(fl.full(spark, ty.f64, 100, 0.5).df, bins=10, range_=(0.0, 1.0)).orderBy("bin").collect()
    assert [r["cnt"] for r in h] == [0] * 5 + [100] + [0] * 4
    same = stats.histogram(fl.full(spark, ty.f64, 3, 2.0).df, bins=2).orderBy("bin").collect()
    assert [(r["lo"], r["cnt"]) for r in same] == [(2.0, 3), (2.5, 0)]


@pytest.mark.parametrize("n", [0, 1, 7, 64, 100])
def test_scans(spark, n):
    a = np.arange(n) % 5
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(a)], "idx long, val int")
    got = sorted((r["idx"], r["scan"]) for r in scan.exclusive_scan(df, block=8).collect())
    assert [v for _, v in got] == [int(x) for x in np.cumsum(a) - a]
    assert scan.total(df) == int(a.sum())


def test_dense_index_over_several_ranges(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(int(x), k) for k, x in enumerate(rng.integers(0, 50, 500))], "a int, b int").repartition(5)
    got = scan.dense_index(df.repartition(5), ["a", "b"], "at").orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(500)) and [(r["a"], r["b"]) for r in got] == sorted((r["a"], r["b"]) for r in got)


def test_scatter_takes_the_last_writer(spark):
    base = fl.zeros(spark, ty.i32, 3).df
    w = spark.createDataFrame([(1, 10, 0), (1, 20, 5), (2, 7, 1)], "k long, v int, o int")
    assert [r["val"] for r in joins.scatter(base, w, "k", "v", "o").orderBy("idx").collect()] == [0, 20, 7]


def test_bits(spark):
    r = spark.range(1).select(bits.clz32(F.lit(1)), bits.clz32(F.lit(0)), bits.morton(F.lit(1.0), F.lit(0.0), F.lit(0.0)), bits.halton(F.lit(0), 2), bits.halton(F.lit(1), 3)).first()
    assert tuple(r) == (31, 32, int("100" * 10, 2), 0.5, pytest.approx(2 / 3))


def test_copies_of_parts(spark):
    a, b = fl.arange(spark, 5, ty.i32), fl.full(spark, ty.f64, 4, 9.5)
    assert a.copy(3).to_numpy().tolist() == [0, 1, 2] and a.copy(3).shape == (3,)
    assert b.with_copied(a, 2, 1).to_numpy().tolist() == [9.5, 0.0, 1.0, 9.5]
    assert b.with_copied(a, offset=2).to_numpy().tolist() == [9.5, 9.5, 0.0, 1.0]
    with pytest.raises(ValueError):
        a.copy(6)


def test_dlpack_flags(spark):
    f = fl.arange(spark, 4, ty.f64)
    assert np.from_dlpack(f).tolist() == [0, 1, 2, 3]
    locked = fl.from_dlpack(spark, np.arange(3.0))
    assert not locked.writable and fl.from_dlpack(spark, np.arange(3.0), copy=True).writable
    assert not np.from_dlpack(locked).flags.writeable
    with pytest.raises(BufferError):
        f.__dlpack__(copy=False)
    with pytest.raises(BufferError):
        f.__dlpack__(dl_device=(2, 0))


def test_tuples_and_their_errors(spark):
    f = fl.arange(spark, 6, ty.f64)
    rows = fl.tuples_of(f, 3, "p").orderBy("idx").collect()
    assert [r["p"] for r in rows] == [[0, 1, 2], [3, 4, 5]]
    assert fl.field_of_tuples(fl.tuples_of(f.reshape(2, 3)), ty.f64).shape == (2, 3)
    assert fl.field_of_tuples(fl.tuples_of(f, 3), ty.f64, flatten=True).to_numpy().tolist() == list(range(6))
    for bad, n in ((f, 4), (f, 0), (f.reshape(2, 3), 2), (f.reshape(1, 2, 3), None)):
        with pytest.raises(ValueError):
            fl.tuples_of(bad, n)


def test_lines_step_as_bresenham(spark):
    from fieldloom.operators import camera, raster

    cam = camera.orthographic((0, 0, 5), (0, 0, 0), view_height=2.0, width=64, height=64)
    rng = np.random.default_rng(5)
    pts = spark.createDataFrame([(k, *map(float, rng.uniform(-0.9, 0.9, 3))) for k in range(9)], "pt_id long, x double, y double, z double")
    tris = spark.createDataFrame([(0, 0, 1, 2), (1, 3, 4, 5), (2, 6, 7, 8)], "tri_id long, v0 long, v1 long, v2 long")
    at = {r["pt_id"]: (int(r["sx"]), int(r["sy"])) for r in cam.project(pts).collect()}
    want = set()
    for t in tris.collect():
        for p, q in ((t["v0"], t["v1"]), (t["v1"], t["v2"]), (t["v2"], t["v0"])):
            (x, y), (x1, y1) = at[p], at[q]
            dx, dy = abs(x1 - x), -abs(y1 - y)
            err = dx + dy
            while True:
                want.add((t["tri_id"], y * 64 + x))
                if (x, y) == (x1, y1):
                    break
                e2 = 2 * err
                if e2 > dy:
                    err, x = err + dy, x + (1 if x1 > x else -1)
                if e2 < dx:
                    err, y = err + dx, y + (1 if y1 > y else -1)
    got = {(r["id"], r["pid"]) for r in raster.wire_fragments(pts, tris, cam).collect()}
    assert got == want


def test_asof_takes_the_last_cell_before(spark):
    axis = np.array([0.0, 1e-3, 2e-3, 5.0, 5.0, 1e6])
    at = [-1.0, 0.0, 1e-3, 1.5e-3, 4.9, 5.0, 7.0, 1e6, 2e6, None] * 3
    cells = spark.createDataFrame([(k, float(c)) for k, c in enumerate(axis)], "cell long, coord double")
    pts = spark.createDataFrame(list(enumerate(at)), "id long, x double").repartition(4)
    got = {r["id"]: r["cell"] for r in joins.asof_cell(pts, "x", cells).collect()}
    assert got == {k: 0 if x is None else int(np.clip(np.searchsorted(axis, x, "right") - 1, 0, 4)) for k, x in enumerate(at)}


def test_nearest_takes_the_least_sum(spark):
    rng = np.random.default_rng(11)
    coord = np.concatenate([rng.integers(-50, 50, 60) / 4, rng.normal(0, 1, 20), [500.0, -800.0]])
    cost = np.concatenate([rng.uniform(0, 3, 60), np.zeros(20), [0.0, 450.0]])
    at = [*map(float, rng.uniform(-900, 900, 100)), *map(float, coord[::5]), *[3.0] * 200, None]
    sites = spark.createDataFrame([(k, float(c), float(w)) for k, (c, w) in enumerate(zip(coord, cost, strict=True))] + [(99, None, 0.0)], "site long, y double, w double")
    pts = spark.createDataFrame(list(enumerate(at)), "id long, x double").repartition(3)
    got = {r["id"]: r["nearest"] for r in joins.nearest(pts, "x", sites, "site", "y", "w").collect()}
    assert len(got) == len(at)
    for k, x in enumerate(at):
        if x is None:
            assert got[k] is None
        else:
            sums = np.abs(x - coord) + cost
            assert got[k]["total"] == sums.min() and sums[got[k]["site"]] == sums.min()


def test_closest_compares_few_pairs_and_keeps_parts_without_a_price(spark, tmp_path):
    """As many suppliers in one cent as parts: no join of the two grows with both."""
    from fieldloom.queries import QUERIES

    n = 3000
    parts = [(k, 900.0 + k % 7 / 100) for k in range(n)] + [(n, None)]
    spark.createDataFrame(parts, "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, 900.0 + k % 2 / 100) for k in range(n)] + [(n, None)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    df = QUERIES["closest"](spark, str(tmp_path))
    assert {r["p_partkey"]: r["s_suppkey"] for r in df.collect()} == {k: None if x is None else 0 if x == 900.0 else 1 for k, x in parts}
    joined = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert joined and all("__part" in line for line in joined)


def test_forces_of_all_pairs_meet_in_blocks_without_a_row_a_pair(spark):
    from fieldloom.operators import stencil

    rng = np.random.default_rng(7)
    n = 150
    at, m = rng.normal(0, 1, (n, 3)), rng.uniform(1, 9, n)
    at[9] = at[4]  # a copy, elsewhere
    rows = [(k % 140, *map(float, at[k]), float(m[k])) for k in range(n)]  # ten ids repeat
    rows += [(500, None, 0.0, 0.0, 1.0), (501, 0.0, 0.0, 0.0, None), (3, 0.0, 0.0, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, m double").repartition(3)
    want = np.zeros((n, 3))
    for k in range(n):
        d = at - at[k]
        want[k] = (m[k] * m / ((d * d).sum(1) + 0.01) ** 1.5) @ d
    for size, tile in ((16384, 64), (7, 2), (40, 3)):
        out = stencil.nbody_forces(df, size=size, tile=tile)
        got = {r["id"]: (r["fx"], r["fy"], r["fz"]) for r in out.collect()}
        assert set(got) == {*range(140), 500, 501} and got[500] == got[501] == (None, None, None)
        for k in range(140):
            assert got[k] == pytest.approx(want[k] + (want[k + 140] if k < 10 else 0), rel=1e-9, abs=1e-9)
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert stencil.nbody_forces(df.limit(0)).count() == 0
    one = stencil.nbody_forces(df.where("id = 20"), softening=0.0).first()
    assert (one["fx"], one["fy"], one["fz"]) == (0.0, 0.0, 0.0)
