import numpy as np
import pytest

from fieldloom.functions import types as ty
from fieldloom.plans.kernel import KernelError, func, inspect, kernel
from fieldloom.sources import field as fl


@func
def clamp(v, lo, hi):
    if v < lo:
        return lo
    if v > hi:
        return hi
    return v


@kernel
def clamped(x, out, n):
    for i in range(n):
        out[i] = clamp(x[i], -1.0, 2.0)


@kernel
def strided(out):
    for i in range(1, 8, 3):
        out[i] = i * 10


@kernel
def mirrored(x, out, n):
    for i in range(n):
        out[i] = x[n - 1 - i]


@kernel
def bad(out, n):
    for i in range(n):
        out[i] = {1: 2}


def values(df):
    return [r["val"] for r in df.orderBy("idx").collect()]


def test_early_return(spark):
    x = fl.field_like(spark, np.array([-3, 0.5, 9], np.float64))
    assert values(clamped(x, None, 3)["out"]) == [-1.0, 0.5, 2.0]


def test_domain_and_base_values(spark):
    assert values(strided(fl.zeros(spark, ty.i32, 9))["out"]) == [0, 10, 0, 0, 40, 0, 0, 70, 0]


def test_gather(spark):
    assert values(mirrored(fl.arange(spark, 5), None, 5)["out"]) == [4, 3, 2, 1, 0]


def test_errors(spark):
    with pytest.raises(KernelError):
        bad(None, 2)
    with pytest.raises(TypeError):
        strided()
    with pytest.raises(RuntimeError):
        clamp(1, 2, 3)
    assert "FunctionDef" in inspect(strided, None)


@kernel
def bumped(x, out, n):
    for i in range(n):
        out[i] = x[i]
        out[i] += 1
        x[i] = out[i] * 2


@kernel
def endless(out, n):
    for i in range(n):
        c = 0
        while c >= 0:
            c += 1
        out[i] = c


@kernel
def counted(out, n):
    for i in range(n):
        c = 0
        while c < 1000 + i:
            c += 1
        out[i] = c


@kernel
def smoothed(x, at, out, n, m):
    for i in range(n):
        acc = 0.0
        for k in range(at[i], at[i + 1]):
            j = m - 1 - k
            if x[j] > 90:
                break
            acc = acc * 0.5 + x[j]
        out[i] = acc


@func
def half_way(v):
    if v > 0:
        return v


@kernel
def unreturned(x, out, n):
    for i in range(n):
        out[i] = half_way(x[i])


@kernel
def by_slots(x, out, n):
    for i in range(n):
        slots = local_array(i32, 3)  # noqa: F821
        more = local_array_like(x, 2)  # noqa: F821
        slots[i % 3] = 7 // 2
        more[0] = x[i]
        out[i] = slots[0] * 100 + slots[1] * 10 + slots[2] + more[0] + more[1]


def test_a_load_sees_what_its_iteration_stored(spark):
    got = bumped(fl.field_like(spark, np.array([5, 7], np.int64)), None, 2)
    assert values(got["out"]) == [6, 8] and values(got["x"]) == [12, 16]


def test_while_loops_end_or_fail(spark):
    assert values(counted(None, 3)["out"]) == [1000, 1001, 1002]
    with pytest.raises(Exception, match="goes on after"):
        endless(None, 1)["out"].collect()


def test_long_loops_of_loads_run_in_order(spark):
    x = np.arange(100.0)
    at = np.array([0, 9, 9, 30, 100])
    got = smoothed(fl.field_like(spark, x), fl.field_like(spark, at), None, 4, 100)["out"]
    want = []
    for i in range(4):
        acc = 0.0
        for k in range(at[i], at[i + 1]):
            if x[99 - k] > 90:
                break
            acc = acc * 0.5 + x[99 - k]
        want.append(acc)
    assert values(got) == pytest.approx(want)


def test_equal_loads_share_a_join(spark):
    @kernel
    def squares(x, out, n):
        for i in range(n):
            out[i] = x[i] * x[i]

    plan = inspect(squares, fl.arange(spark, 4), None, 4, mode="source")
    assert plan.count("Join") == 1


def test_helpers_return_on_every_path(spark):
    with pytest.raises(KernelError):
        unreturned(fl.arange(spark, 2), None, 2)


def test_local_arrays(spark):
    assert values(by_slots(fl.arange(spark, 3), None, 3)["out"]) == [300, 31, 5]


@kernel
def subtracted(x, y, out, trips, n):
    for i in range(n):
        u = x[i]
        w = y[i]
        c = 0
        while u != w and w > 0:
            if u > w:
                u = u - w
            else:
                w -= u
            c += 1
        out[i] = u
        trips[i] = c


@kernel
def tangled(x, out, n):
    for i in range(n):
        a = x[i]
        b = 3
        c = 0
        k = 0
        while k <= 400 and not a == 57:
            if a < 100 or c >= 90:
                a, b = a + 2 * b - 1, b
                if b * 2 > c - 7:
                    c += b
            else:
                a = a - b * c
                b = -b + k
                c = -1
            k += 1
        out[i] = a * 1000003 + b * 1009 + c * 31 + k


@kernel
def overflowing(x, out, n):
    for i in range(n):
        a = x[i]
        k = 0
        while a * 4 > 0 and k < 10:
            a += 2305843009213693000
            k += 1
        out[i] = k


def test_while_loops_leap_over_trips_that_repeat(spark):
    x, y = [10**15 + 1, 900_000, 7, 600, 5], [3, 6, 7, 10**12, 0]
    got = subtracted(fl.field_like(spark, np.array(x)), fl.field_like(spark, np.array(y)), None, None, 5)
    trips = lambda u, w: 0 if w == 0 else u // w + trips(w, u % w)
    assert values(got["out"]) == [1, 6, 7, 200, 5]
    assert values(got["trips"]) == [trips(u, w) - 1 if w else 0 for u, w in zip(x, y, strict=True)]


def test_leaps_equal_single_trips(spark):
    x = list(range(-60, 180, 7)) + [57]
    want = []
    for a in x:
        b, c, k = 3, 0, 0
        while k <= 400 and a != 57:
            if a < 100 or c >= 90:
                a = a + 2 * b - 1
                if b * 2 > c - 7:
                    c += b
            else:
                a, b, c = a - b * c, -b + k, -1
            k += 1
        want.append(a * 1000003 + b * 1009 + c * 31 + k)
    assert values(tangled(fl.field_like(spark, np.array(x)), None, len(x))["out"]) == want


def test_leaps_keep_overflows(spark):
    x = fl.field_like(spark, np.array([1, 2]))
    with pytest.raises(Exception, match="OVERFLOW"):
        overflowing(x, None, 2)["out"].collect()
