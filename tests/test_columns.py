import numpy as np
import pytest
from pyspark.sql import functions as F

from braidflow.functions import columns as k


def values(spark, rows, schema, **cols):
    return [r.asDict() for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()]


def test_clean_and_ratio(spark):
    got = values(spark, [(1.0, 2.0), (float("nan"), 1.0), (float("inf"), 1.0), (None, 1.0), (1.0, 0.0)], "a double, b double", a=k.clean("a"), r=k.ratio(k.clean("a"), "b"), ok=k.finite_all("a", "b"))
    assert [g["a"] for g in got] == [1.0, None, None, None, 1.0]
    assert [g["r"] for g in got] == [0.5, None, None, None, None]
    assert [g["ok"] for g in got] == [True, False, False, False, True]


def test_rotation_and_back_is_identity(spark):
    rows = [(float(u), float(v), float(d)) for u, v, d in np.random.default_rng(1).normal(size=(50, 3)) * 40]
    ru, rv = k.rotated("u", "v", F.col("d"))
    df = spark.createDataFrame(rows, "u double, v double, d double").withColumns({"x": ru, "y": rv})
    bu, bv = k.rotated("x", "y", -F.col("d"))
    for r in df.select("u", "v", bu.alias("bu"), bv.alias("bv")).collect():
        assert r["bu"] == pytest.approx(r["u"]) and r["bv"] == pytest.approx(r["v"])


def test_affine_round_trip(spark):
    a = (0.01, 0.002, -60.0, 0.001, -0.01, -5.0)
    df = spark.createDataFrame([(float(c), float(r)) for c in range(7) for r in range(5)], "c double, r double")
    x, y = k.to_map("c", "r", *a)
    df = df.withColumns({"x": x, "y": y})
    pc, pr = k.to_pixel("x", "y", *a)
    assert all(r["pc"] == r["c"] and r["pr"] == r["r"] for r in df.select("c", "r", pc.alias("pc"), pr.alias("pr")).collect())


def test_every_surface_code(spark):
    codes = [int("".join(str(b >> i & 1) for i in range(4, -1, -1))) for b in range(32)]
    got = {r["code"]: (r["strict"], r["loose"]) for r in spark.createDataFrame([(c,) for c in codes], "code int").select("code", k.surface_class("code").alias("strict"), k.surface_class("code", False).alias("loose")).collect()}
    assert got[11011] == (0, 1) and got[11111] == (1, 1) and got[11000] == (3, 3) and got[0] == (0, 0)
    assert sum(a == 1 for a, _ in got.values()) == 5 and sum(a == 2 for a, _ in got.values()) == 10 and sum(a == 4 for a, _ in got.values()) == 10


def test_nice_numbers_and_wrap(spark):
    got = values(spark, [(0.0013, 0.1), (37.0, 4.0), (-1.0, -3.5), (50.0, 9.6), (None, 0.0)], "x double, d double", n=k.nice_number("x"), w=k.wrapped_degrees("d"))
    assert [pytest.approx(g["n"]) for g in got] == [0.002, 50.0, 1.0, 50.0, 1.0]
    for g, d in zip(got, [0.1, 4.0, -3.5, 9.6, 0.0], strict=True):
        assert g["w"] == pytest.approx(np.degrees((d + np.pi) % (2 * np.pi) - np.pi))


def test_boxes(spark):
    low, high = k.clamped("a", "b", 0.0, 10.0)
    off, n = k.pixel_window("a", "b", 0.0, 2.0, 5)
    got = values(spark, [(-3.0, 1.0), (8.0, 13.0), (-5.0, 20.0), (4.0, 4.0), (2.0, 6.0)], "a double, b double", low=low, high=high, off=off, n=n)
    assert [(g["low"], g["high"]) for g in got] == [(0, 4), (5, 10), (0, 10), (4, 4), (2, 6)]
    assert got[4]["off"] == 1 and got[4]["n"] == 2 and got[3]["n"] is None


def test_names(spark):
    got = values(spark, [("A_1999_01-01_mask.tif", "YR-A"), ("1987.tif", "Jurua"), ("x_12345_.tif", "Else")], "f string, s string", t=k.year_of_tokens("f"), r=k.year_between_underscores("f"), s=k.site_name("s"), sensor=k.sensor(F.lit(2000)))
    assert [g["t"] for g in got] == [1999, 1987, None] and [g["r"] for g in got] == [1999, None, None]
    assert [g["s"] for g in got] == ["HuangHe-A", "Jurua-A", "Else"] and got[0]["sensor"] == "L7"


def test_metres_per_degree_on_the_equator(spark):
    lon, lat = k.metres_per_degree(F.lit(0.0))
    r = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert r["lon"] == pytest.approx(111319.458) and r["lat"] == pytest.approx(110574.2727)
