import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidflow.operators import curves, displacement, ensemble, grids, network, regression
from braidflow.operators.nearest import nearest


def test_vector_stats_of_degenerate_cells(spark):
    rows = [("none", None, None), ("none", float("nan"), 1.0), ("one", 1.0, 0.0), ("same", 3.0, 4.0), ("same", 3.0, 4.0), ("apart", 1.0, 0.0), ("apart", -1.0, 0.0)]
    got = {r["cell"]: r for r in ensemble.vector_stats(spark.createDataFrame(rows, "cell string, u double, v double"), ["cell"]).collect()}
    assert got["none"]["n"] == 0 and got["none"]["u_mean"] is None and got["none"]["bad_mask"]
    assert got["one"]["n"] == 1 and got["one"]["bad_mask"]
    assert got["same"]["n_mean"] == 5 and got["same"]["n_std"] == 0 and not got["same"]["bad_mask"] and got["same"]["theta_std"] == pytest.approx(0, abs=1e-6)
    assert got["apart"]["theta_std"] == pytest.approx(math.sqrt(-2 * math.log(1e-8))) and got["apart"]["bad_mask"]


def circle(n=64, r=100.0):
    t = np.linspace(0, 2 * np.pi, n, endpoint=False)
    return [("c", i + 1, float(r * a), float(r * math.cos(b)), float(r * math.sin(b))) for i, (a, b) in enumerate(zip(t, t, strict=True))]


def test_curvature_and_normals_of_a_circle(spark):
    df = spark.createDataFrame(circle(), "link string, i int, s double, x double, y double")
    inner = [r for r in curves.curvature(curves.tangents(df, ["link"]), ["link"]).orderBy("i").collect()][3:-3]
    assert all(r["c"] == pytest.approx(0.01, rel=1e-3) for r in inner)
    assert all(abs(r["nx"] * r["x"] + r["ny"] * r["y"]) == pytest.approx(100, rel=1e-6) for r in inner)


def test_fill_and_smoothing_equal_numpy(spark):
    v = [None, 2.0, None, None, 8.0, 1.0, None]
    rows = [("a", i + 1, x) for i, x in enumerate(v)] + [("b", 1, None), ("b", 2, None), ("c", 1, 3.0), ("c", 2, None)]
    got = curves.filled(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], "v")
    a = [r["v"] for r in got.filter("k = 'a'").orderBy("i").collect()]
    assert a == [2, 2, 4, 6, 8, 1, 1]
    assert {r["v"] for r in got.filter("k = 'b'").collect()} == {0.0} and {r["v"] for r in got.filter("k = 'c'").collect()} == {3.0}
    for w in (3, 4, 5):
        m = [r["m"] for r in got.filter("k = 'a'").select("i", curves.moving_average("v", ["k"], w).alias("m")).orderBy("i").collect()]
        assert m == pytest.approx(np.convolve(a, np.ones(w) / w, "same").tolist())


def test_densify(spark):
    df = spark.createDataFrame([("l", 1, 0.0, 0.0), ("l", 2, 3.0, 0.0), ("l", 3, 3.0, 4.0)], "link string, i int, x double, y double")
    got = curves.densified(df, ["link"], 1.0).orderBy("k").collect()
    assert [r["s"] for r in got] == [0, 1, 2, 3, 4, 5, 6, 7]
    assert [(r["x"], r["y"]) for r in got] == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (3, 2), (3, 3), (3, 4)]
    with pytest.raises(ValueError):
        curves.densified(df, ["link"], 0)


def test_longest_run_takes_the_first_of_equals(spark):
    flags = [0, 1, 1, 0, 1, 1, 0, 1]
    df = spark.createDataFrame([("t", i, float(i * i), bool(f)) for i, f in enumerate(flags)] + [("dry", 0, 0.0, False)], "k string, i int, u double, f boolean")
    assert [tuple(r) for r in curves.longest_run(df, ["k"], "f", "u").collect()] == [("t", 3.0)]


def sine(n=256, period=32, shift=5):
    return [("s", i + 1, math.sin(2 * math.pi * i / period), math.sin(2 * math.pi * (i + shift) / period)) for i in range(n)]


def test_spectrum_and_lag_of_sines(spark):
    df = spark.createDataFrame([*sine(), ("few", 1, 1.0, 2.0)], "line string, i int, x double, y double")
    got = curves.spectrum(df, "line", "x")
    assert curves.dominant(got, ["line"]).first()["wavelength"] == 32 and got.count() == 128
    assert max(r["share"] for r in got.collect()) == 1.0
    x, y = (np.array([r[k] for r in sine()]) for k in (2, 3))
    best = curves.best_lag(curves.lag_correlation(df, "line", "x", "y"), ["line"]).first()
    full = np.correlate(x - x.mean(), y - y.mean(), "full")
    assert best["lag"] == int(full.argmax()) - 255
    z = x - x.mean()
    acf = np.correlate(z, z, "full")[len(z) - 1 :] / (z @ z)
    got = {r["lag"]: r["r"] for r in curves.lag_correlation(df, "line", "x", "x").collect()}
    assert [got[j] for j in range(256)] == pytest.approx(acf.tolist(), abs=1e-9) and len(got) == 511
    assert set(curves.lag_correlation(df, "line", "x", "x", most=12).toPandas()["lag"]) == set(range(-12, 13))
    lengths = curves.correlation_lengths(spark.createDataFrame([("s", j, float(v)) for j, v in enumerate(acf)], "line string, lag int, r double"), ["line"]).first()
    assert lengths["folding"] == int(np.argmax(acf <= math.exp(-1))) and lengths["integral"] == pytest.approx(acf[1 : int(np.argmax(acf < 0))].sum())
    flat = spark.createDataFrame([("f", i, 1.0, float(i)) for i in range(6)], "line string, i int, x double, y double")
    assert {r["r"] for r in curves.lag_correlation(flat, "line", "x", "y").collect()} == {None}


def test_criterion_of_sines(spark):
    rows = [("s", i + 1, x, y, y) for _, i, x, y in ((a, b - 1, c, d) for a, b, c, d in sine())]
    got = curves.criterion(spark.createDataFrame(rows, "t string, i int, b double, c double, m double"), "t").first()
    assert got["wavelength_b"] == got["wavelength_c"] == 32 and got["phase"] == pytest.approx(-360 * 5 / 32, abs=1e-3)
    assert got["lag_c"] == 0 and got["r_c"] == 1.0 and got["lag_b"] == 5


def test_shifted_image_is_recovered(spark):
    """A frame rolled by 5 columns and -3 rows: every window gives that displacement."""
    a = np.random.default_rng(42).integers(0, 255, (128, 128)).astype(float)
    b = np.roll(a, (-3, 5), (0, 1))
    grid = displacement.window_grid(spark, 128, 128, 32, 16).collect()
    assert len(grid) == 49
    rows = []
    for g in grid:
        y, x = int(g["y"] - 15.5), int(g["x"] - 15.5)
        rows.append((g["gy"], g["gx"], a[y : y + 32, x : x + 32].ravel().tolist(), b[y : y + 32, x : x + 32].ravel().tolist()))
    field = displacement.validated(displacement.displacement_of(spark.createDataFrame(rows, "gy int, gx int, a array<double>, b array<double>"), ["gy", "gx"], 32, 16)).collect()
    assert all(r["signal"] > 1.3 and abs(r["dx"] - 5) < 0.5 and abs(r["dy"] + 3) < 0.5 for r in field)
    pixels = [("p", r, c, float(a[r, c]), float(b[r, c])) for r in range(128) for c in range(128)]
    made = displacement.windows(spark.createDataFrame(pixels, "k string, r int, c int, a double, b double"), ["k"], 128, 128, 32, 16)
    assert sorted((r["gy"], r["gx"], r["a"], r["b"]) for r in made.collect()) == sorted(rows)
    chain = displacement.displacement_of(made, ["k"], 32, 16).collect()
    assert {(r["px"], r["py"]) for r in chain} == {(5, -3)}
    small = [(0, r, c, float(a[r, c]), float(np.roll(a[:8, :8], (1, -2), (0, 1))[r, c])) for r in range(8) for c in range(8)]
    peak = displacement.peaks(displacement.correlation(spark.createDataFrame(small, "k int, r int, c int, a double, b double"), "k", 8), "k", 8).first()
    assert (peak["dx"], peak["dy"]) == (-2, 1)


def test_repair(spark):
    df = spark.createDataFrame([(y, x, None if (y, x) == (1, 1) else float(y + x)) for y in range(3) for x in range(3)], "gy int, gx int, dx double")
    assert displacement.repaired(df, [], ["dx"]).filter("gy = 1 AND gx = 1").first()["dx"] == pytest.approx(2.0)


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    grid = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((60, 2)).round(1))]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((40, 2)))] + [(99, 30.0, -20.0)]
    got = nearest(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(grid, "gid long, gx double, gy double"), ["id"], "gid").collect()
    want = {i: min(((x - gx) ** 2 + (y - gy) ** 2, g) for g, gx, gy in grid)[1] for i, x, y in points}
    assert {r["id"]: r["gid"] for r in got} == want


def test_morphology_and_outline(spark):
    cells = {(r, c) for r in range(3, 8) for c in range(2, 9)} - {(5, 5)}
    df = spark.createDataFrame([("a", r, c) for r, c in cells], "k string, r int, c int")
    near = lambda r, c: [(r, c), (r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    assert {(r["r"], r["c"]) for r in grids.dilate(df, ["k"]).collect()} == {p for x in cells for p in near(*x)}
    assert {(r["r"], r["c"]) for r in grids.erode(df, ["k"]).collect()} == {x for x in cells if set(near(*x)) <= cells}
    square = spark.createDataFrame([("s", r, c) for r in range(4) for c in range(4)], "k string, r int, c int")
    assert grids.outline_length(square, ["k"]).first()["length"] == pytest.approx(12 + 4 * math.sqrt(0.5))


def test_rotation(spark):
    df = spark.createDataFrame([(r, c, r * 10 + c) for r in range(3) for c in range(4)], "r int, c int, v int")
    same = grids.rotated(df, 3, 4, 0, "v").collect()
    assert {(r["r"], r["c"]): r["v"] for r in same} == {(r, c): r * 10 + c for r in range(3) for c in range(4)}
    turned = {(r["r"], r["c"]): r["v"] for r in grids.rotated(df, 3, 4, 90, "v").collect()}
    assert sorted(turned.values()) == sorted(r * 10 + c for r in range(3) for c in range(4)) and max(turned) == (3, 2)


def test_regression_guards(spark):
    rows = [("line", float(x), 2.0 * x + 1) for x in range(5)] + [("flat", float(x), 3.0) for x in range(4)] + [("wall", 2.0, y) for y in (1.0, 3.0)] + [("one", 1.0, 1.0), ("one", None, 2.0)]
    got = {r["g"]: r for r in regression.linear(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert (got["line"]["slope"], got["line"]["intercept"], got["line"]["r2"]) == pytest.approx((2, 1, 1))
    assert got["flat"]["r2"] is None and got["one"]["slope"] is None
    w = np.linalg.lstsq(np.array([[2.0, 1], [2.0, 1]]), np.array([1.0, 3.0]), rcond=None)[0]
    assert (got["wall"]["slope"], got["wall"]["intercept"]) == pytest.approx(tuple(w))


def test_curvature_fit_recovers_its_parameters(spark):
    x = np.linspace(0.1, 5, 60)
    y = 7 * (x / 1.3) * np.exp(1 - x / 1.3)
    df = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y, strict=True)] + [("few", 1.0, 1.0)], "g string, x double, y double")
    got = {r["g"]: r for r in regression.curvature_fit(df, "g", "x", "y").collect()}
    assert (got["a"]["peak"], got["a"]["critical"]) == pytest.approx((7, 1.3), rel=1e-5) and got["few"]["peak"] is None


def test_binned_closes_the_last_bin(spark):
    df = spark.createDataFrame([("g", float(x), float(x)) for x in range(11)], "g string, x double, y double")
    got = {r["bin"]: r for r in regression.binned(df, ["g"], "x", "y", 2, least=6).collect()}
    assert got[0]["n"] == 5 and got[0]["mean"] is None and got[1]["n"] == 6 and got[1]["mean"] == 7.5


def test_clusters_chain_and_tolerance(spark):
    pts = spark.createDataFrame([(i, i * 1.0, 0.0) for i in range(30)] + [(100, 50.0, 0.0), (101, 50.0, 1.0), (102, None, None)], "id long, x double, y double")
    got = {r["id"]: r["root"] for r in network.clusters(pts, 1.0).collect()}
    assert {got[i] for i in range(30)} == {0} and got[101] == 100 and got[102] == 102
    assert all(r["id"] == r["root"] for r in network.clusters(pts, 0.0).collect())


def test_longest_path_prefers_targets():
    nodes = {i: float(i) for i in range(6)}
    edges = [(0, 1, 1.0, "a"), (1, 5, 1.0, "b"), (0, 2, 3.0, "c"), (2, 5, 3.0, "d"), (1, 2, 1.0, "e"), (2, 4, 9.0, "f")]
    assert [e[3] for e in network.longest_path(edges, nodes, {0}, {5})] == ["c", "d"]
    assert [e[3] for e in network.longest_path(edges, nodes, {0}, {3})] == ["c", "f"]
    assert network.longest_path(edges, nodes, {5}, {0}) == []


def test_points_that_steps_join():
    rng = np.random.default_rng(8)
    for tolerance in (0.0, 0.02, 0.07):
        x, y = rng.random((2, 120))
        got = network.joined(x, y, tolerance)
        near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= tolerance * tolerance if tolerance else np.eye(120, dtype=bool)
        while ((after := near @ near) != near).any():
            near = after
        assert (got[:, None] == got).tolist() == near.tolist()


def test_trunks_of_two_chains(spark):
    """Two chains, one link digitised backwards, ends apart by less than the tolerance; a stub and a loop stay out."""
    links = [("s", "a", 0.0, 0.0, 10.0, 0.1, 10.0), ("s", "b", 20.0, 0.0, 10.1, 0.0, 11.0), ("s", "c", 0.1, 0.0, 10.0, 0.0, 5.0), ("s", "d", 10.0, 0.0, 20.1, 0.1, 5.5), ("s", "loop", 10.0, 0.0, 10.0, 0.05, 99.0), ("s", "stub", 10.0, 0.0, 12.0, 3.0, 1.0), ("t", "z", 0.0, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(links, "site string, link string, x0 double, y0 double, x1 double, y1 double, w double")
    rows = sorted((r["site"], r["trunk"], r["pos"], r["link"], r["reversed"]) for r in network.paths(df, "site", 0.5, 3).collect() if r["site"] == "s")
    assert rows[:4] == [("s", 1, 1, "a", False), ("s", 1, 2, "b", True), ("s", 2, 1, "c", False), ("s", 2, 2, "d", False)]
    kept = {r["trunk"] for r in network.paths(df, "site", 0.5, 3, least=15.0).collect()}
    assert kept == {1}
    d = {r["site"]: r for r in network.diagnostics(df, "site", 0.5, 3).collect()}["s"]
    assert (d["n_links"], d["n_nodes"], d["n_edges"], d["n_sources"]) == (6, 4, 5, 1) and d["axis_x"] > 0.99


def test_concatenation(spark):
    samples = spark.createDataFrame([("a", i, float(i), 1.0, 0.5, 2.0) for i in range(3)] + [("b", i, 10.0 + i, 2.0, 0.5, 2.0) for i in range(3)], "link string, i int, s double, b double, c double, m double")
    path = spark.createDataFrame([("t", 1, "a", False), ("t", 2, "b", True)], "trunk string, pos int, link string, reversed boolean")
    rows = network.concatenated(path, samples, ["trunk"]).orderBy("j").collect()
    assert [r["j"] for r in rows] == [1, 2, 3, 4, 5] and [r["s"] for r in rows] == [0, 1, 2, 3, 4]
    assert [r["m"] for r in rows] == [2, 2, 2, -2, -2] and [r["c"] for r in rows] == [0.5, 0.5, 0.5, -0.5, -0.5]
    got = network.criterion(spark.createDataFrame([("g", float(w)) for w in (3, 1, 1)], "g string, w double"), ["g"], "w").first()
    assert (got["trunks"], got["top1"], got["top2"], got["top3"]) == (3, 0.6, 0.8, 1.0) and got["n_eff"] == pytest.approx(1 / 0.44)


def test_equal_trunks_count_as_many(spark):
    got = network.shares(spark.createDataFrame([(f"t{i}", 2.0) for i in range(4)], "t string, w double"), "t", "w").collect()
    assert all(r["n_eff"] == pytest.approx(4) for r in got) and max(r["top"] for r in got) == pytest.approx(1)


def test_sparse_years():
    assert curves.sparse_years([1990, 1991, 1995], 5) == [1990, 1991, 1995]
    got = curves.sparse_years(list(range(1986, 2025)), 10)
    assert got[0] == 1986 and got[-1] == 2024 and len(got) == 10 and min(b - a for a, b in zip(got, got[1:], strict=False)) >= 3


def test_axis_points_right(spark):
    pts = spark.createDataFrame([(i, float(i), -2.0 * i) for i in range(9)], "id long, x double, y double")
    p = [r["p"] for r in network.main_axis(pts).orderBy("id").collect()]
    assert p == sorted(p) and p[-1] - p[0] == pytest.approx(8 * math.sqrt(5))


def test_window_read_beyond_the_raster(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, float("nan")), (1, 0, 5.0)], "r int, c int, v double")
    got = {(r["r"], r["c"]): r["v"] for r in grids.window_read(df, [], -1, 2, -1, 2, "v").collect()}
    assert len(got) == 9 and got[0, 0] == 1 and got[1, 0] == 1 and got[0, 1] == 0 and got[-1, -1] == 0


def test_functions_stay_in_generated_code(spark):
    df = ensemble.vector_stats(spark.range(10).select((F.col("id") % 2).alias("cell"), F.col("id").cast("double").alias("u"), F.lit(1.0).alias("v")), ["cell"])
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_moderated_drops_extreme_windows_and_marks_down_fast_ones(spark):
    windows = spark.createDataFrame([(0, 0, 8, 8.0), (0, 2, 8, 8.0), (2, 0, 8, 8.0), (2, 2, 8, 8.0)], "r0 long, c0 long, changed long, score double")
    vectors = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (0, 2, 1.5), (2, 0, 100.0), (1, 1, None), (1, 3, float("nan"))], "r long, c long, m double")
    whole = 1.5 + 0.6 * 98.5  # 90th percentile of five lengths
    got = {(w["r0"], w["c0"]): (w["ratio"], w["score"]) for w in grids.moderated(windows, vectors, 2, 2, 2, 2).collect()}
    assert got.keys() == {(0, 0), (0, 2), (2, 0), (2, 2)} and got[2, 2] == (None, 8.0)
    assert got[0, 0] == (pytest.approx(1 / whole), 8.0)
    assert got[2, 0][1] == pytest.approx(8.0 / (1 + 0.8 * (100 / whole - 1)))
    assert (2, 0) not in {(w["r0"], w["c0"]) for w in grids.moderated(windows, vectors, 2, 2, 2, 2, most=1.5).collect()}


def test_clipped_bins_of_one_value_are_one_bin(spark):
    rows = spark.createDataFrame([("a", 3.0, float(i)) for i in range(6)], "g string, x double, y double")
    got = regression.binned(rows, ["g"], "x", "y", 4, log=True, clip=(0.02, 0.98), pooled=True).collect()
    assert [(r["bin"], r["n"], r["mean"]) for r in got] == [(0, 6, 2.5)]
    assert regression.binned(rows.limit(0), ["g"], "x", "y", 4, clip=(0.1, 0.9)).count() == 0


def test_clusters_link_squares_not_points(spark, monkeypatch):
    """2,000 points in one spot, a chain beside them, one alone and one without a place: links are of squares, not of points."""
    rows = [(i, 0.1 + i * 1e-7, 0.1) for i in range(2000)] + [(3000 - k, 0.1 + 0.0049 * k, 0.1) for k in range(1, 8)] + [(4000, 0.9, 0.9), (4001, None, 0.1)]
    sizes = []
    kept = network.saved
    monkeypatch.setattr(network, "saved", lambda df: sizes.append((df.columns, (out := kept(df)).count())) or out)
    got = dict(network.clusters(spark.createDataFrame(rows, "id long, x double, y double"), 0.005).collect())
    assert got == {i: 0 if i < 3000 else i for i, _, _ in rows}
    assert all(n < 200 for names, n in sizes if names == ["a", "b"])
    assert all(n < 200 for names, n in sizes if "before" in names)
