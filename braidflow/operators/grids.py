"""Operators on rasters as long tables (keys, r, c, value): set algebra, morphology, outlines, windows and rotation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidflow.functions.columns import water

FOUR = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


def overlay(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Two rasters by pixel (r, c, a, b); a pixel that one lacks is land in it."""
    left, right = a.select("r", "c", F.col(value).alias("a")), b.select("r", "c", F.col(value).alias("b"))
    return left.join(right, ["r", "c"], "full_outer").select("r", "c", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))


def change(both: DataFrame) -> DataFrame:
    a, b = F.col("a") > 0, F.col("b") > 0
    return both.withColumns({"either": a | b, "gained": ~a & b, "lost": a & ~b, "changed": a != b})


def dilate(pixels: DataFrame, keys: list[str], times: int = 1) -> DataFrame:
    """Set pixels (keys, r, c) and their four neighbours, so many times over. One pass: the diamond of that radius."""
    offsets = [(i, j) for i in range(-times, times + 1) for j in range(-times, times + 1) if abs(i) + abs(j) <= times]
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])).alias("d")
    out = pixels.select(*keys, "r", "c", shifts)
    return out.select(*keys, (F.col("r") + F.col("d.i")).alias("r"), (F.col("c") + F.col("d.j")).alias("c")).distinct()


def erode(pixels: DataFrame, keys: list[str], times: int = 1) -> DataFrame:
    """Set pixels all of whose diamond is set; outside a raster is land."""
    size = sum(1 for i in range(-times, times + 1) for j in range(-times, times + 1) if abs(i) + abs(j) <= times)
    reached = pixels.distinct()
    offsets = [(i, j) for i in range(-times, times + 1) for j in range(-times, times + 1) if abs(i) + abs(j) <= times]
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])).alias("d")
    votes = reached.select(*keys, "r", "c", shifts).select(*keys, (F.col("r") + F.col("d.i")).alias("r"), (F.col("c") + F.col("d.j")).alias("c"))
    return votes.groupBy(*keys, "r", "c").agg(F.count("*").alias("n")).filter(F.col("n") == size).drop("n")


def outline_length(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Length in pixels of the contour at half height around set pixels: each square of four pixels that isn't all of one
    kind adds a piece by which of them are set: a corner half the root of 2, a side 1, two opposite corners the root of 2."""
    corner = F.explode(F.array(*[F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j"), F.lit(1 << k).alias("bit")) for k, (i, j) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)])])).alias("d")
    squares = pixels.distinct().select(*keys, "r", "c", corner).select(*keys, (F.col("r") + F.col("d.i")).alias("r"), (F.col("c") + F.col("d.j")).alias("c"), F.col("d.bit"))
    case = squares.groupBy(*keys, "r", "c").agg(F.sum("bit").alias("case"))
    piece = F.when(F.col("case").isin(1, 2, 4, 8, 7, 11, 13, 14), math.sqrt(0.5)).when(F.col("case").isin(6, 9), math.sqrt(2.0)).when(F.col("case") == 15, 0.0).otherwise(1.0)
    return case.groupBy(*keys).agg(F.sum(piece).alias("length"))


def extent(pixels: DataFrame, keys: list[str], margin: int, height: int, width: int) -> DataFrame:
    """Box of the set pixels with a margin, within the raster."""
    return pixels.groupBy(*keys).agg(
        F.greatest(F.min("r") - margin, F.lit(0)).alias("r0"), F.least(F.max("r") + margin, F.lit(height - 1)).alias("r1"),
        F.greatest(F.min("c") - margin, F.lit(0)).alias("c0"), F.least(F.max("c") + margin, F.lit(width - 1)).alias("c1"),
    )


def window_read(raster: DataFrame, keys: list[str], r0: int, r1: int, c0: int, c1: int, value: str) -> DataFrame:
    """The pixels of a window, also where it reaches beyond the raster: those are 0. The range is pushed to the scan."""
    spark = raster.sparkSession
    grid = spark.range(r0, r1).select(F.col("id").cast("int").alias("r")).crossJoin(spark.range(c0, c1).select(F.col("id").cast("int").alias("c")))
    inside = raster.filter(F.col("r").between(r0, r1 - 1) & F.col("c").between(c0, c1 - 1))
    if not keys:
        return grid.join(inside, ["r", "c"], "left").select("r", "c", F.coalesce(water(value), F.lit(0)).alias(value))
    layers = raster.select(*keys).distinct()
    return layers.crossJoin(F.broadcast(grid)).join(inside, [*keys, "r", "c"], "left").select(*keys, "r", "c", F.coalesce(water(value), F.lit(0)).alias(value))


def turned(height: int, width: int, degrees: int) -> tuple[int, int, float, float]:
    """Height and width of the grid that holds a rotated raster, and the turn's cosine and sine."""
    t = math.radians(-degrees)
    cos, sin = math.cos(t), math.sin(t)
    return int(round(abs(height * cos) + abs(width * sin), 6) + 0.5), int(round(abs(width * cos) + abs(height * sin), 6) + 0.5), cos, sin


def rotated(raster: DataFrame, height: int, width: int, degrees: int, value: str, keys: list[str] | None = None) -> DataFrame:
    """Rotation of each raster about its centre onto a grid that holds all of it: each pixel takes the nearest source, outside is 0."""
    keys = keys or []
    new_h, new_w, cos, sin = turned(height, width, degrees)
    spark = raster.sparkSession
    grid = spark.range(new_h * new_w).select((F.col("id") / new_w).cast("int").alias("r"), (F.col("id") % new_w).cast("int").alias("c"))
    y, x = F.col("r") - (new_h - 1) / 2, F.col("c") - (new_w - 1) / 2
    source = grid.select("r", "c", F.floor(F.round(y * cos + x * sin + (height - 1) / 2, 9) + 0.5).cast("int").alias("sr"), F.floor(F.round(x * cos - y * sin + (width - 1) / 2, 9) + 0.5).cast("int").alias("sc"))
    if keys:
        source = raster.select(*keys).distinct().crossJoin(F.broadcast(source))  # one raster's grid
    found = raster.select(*keys, F.col("r").alias("sr"), F.col("c").alias("sc"), value)
    return source.join(found, [*keys, "sr", "sc"], "left").select(*keys, "r", "c", F.coalesce(value, F.lit(0)).alias(value))


def percentile_stretch(rows: DataFrame, keys: list[str], value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values between two quantiles of their group as 0 to 1, clipped."""
    q = rows.groupBy(*keys).agg(F.expr(f"percentile({value}, {low})").alias("lo"), F.expr(f"percentile({value}, {high})").alias("hi"))
    scaled = (F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return rows.join(q, keys).withColumn("stretched", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("lo", "hi")


def downsample(raster: DataFrame, keys: list[str], step: int, value: str, nearest: bool) -> DataFrame:
    """Every step-th pixel, or the mean of each square of that side."""
    r, c = F.floor(F.col("r") / step).cast("int"), F.floor(F.col("c") / step).cast("int")
    if nearest:
        return raster.filter((F.col("r") % step == 0) & (F.col("c") % step == 0)).select(*keys, r.alias("r"), c.alias("c"), value)
    return raster.groupBy(*keys, r.alias("r"), c.alias("c")).agg(F.avg(value).alias(value))


def in_windows(rows: DataFrame, size_r: int, size_c: int, step_r: int, step_c: int) -> DataFrame:
    """Rows at (r, c) once for each sliding window (wr, wc) that holds them."""
    low = lambda x, size, step: F.greatest(F.lit(0), F.ceil((F.col(x) - size + 1) / step))
    rows = rows.withColumn("wr", F.explode(F.sequence(low("r", size_r, step_r), F.floor(F.col("r") / step_r))))
    return rows.withColumn("wc", F.explode(F.sequence(low("c", size_c, step_c), F.floor(F.col("c") / step_c))))


def change_windows(both: DataFrame, size_r: int, size_c: int, step_r: int, step_c: int, valid_share: float, least: int) -> DataFrame:
    """Sliding windows of an overlay with their changed and valid pixels: each pixel goes to the windows that hold it."""
    rows = in_windows(both, size_r, size_c, step_r, step_c)
    out = rows.groupBy("wr", "wc").agg(F.count("*").alias("valid"), F.count_if(F.col("a") != F.col("b")).alias("changed"))
    out = out.withColumn("score", F.col("changed").cast("double"))
    return out.filter((F.col("valid") >= valid_share * size_r * size_c) & (F.col("changed") >= least)).select((F.col("wr") * step_r).alias("r0"), (F.col("wc") * step_c).alias("c0"), "valid", "changed", "score")


def moderated(windows: DataFrame, vectors: DataFrame, size_r: int, size_c: int, step_r: int, step_c: int, most: float = 1.9, weight: float = 0.8) -> DataFrame:
    """Windows whose displacements aren't extreme: ratio is the 90th percentile of the lengths m of a window's vectors (r, c,
    m) to that of all. Above `most` a window goes; above 1 its score falls by `weight`. Without vectors, or where either
    percentile isn't positive, it stays as it is, its ratio NULL."""
    rows = vectors.filter(F.col("m").isNotNull() & ~F.isnan("m"))
    whole = rows.agg(F.expr("percentile(m, 0.9)").alias("whole"))
    at = in_windows(rows, size_r, size_c, step_r, step_c).groupBy("wr", "wc").agg(F.expr("percentile(m, 0.9)").alias("p90"))
    at = at.select((F.col("wr") * step_r).alias("r0"), (F.col("wc") * step_c).alias("c0"), "p90")
    ratio = F.when((F.col("p90") > 0) & (F.col("whole") > 0), F.col("p90") / F.col("whole"))
    out = windows.join(at, ["r0", "c0"], "left").crossJoin(F.broadcast(whole)).withColumn("ratio", ratio).drop("p90", "whole")  # one row
    out = out.filter(F.col("ratio").isNull() | (F.col("ratio") <= most))
    return out.withColumn("score", F.col("score") / (1 + weight * F.greatest(F.coalesce("ratio", F.lit(1.0)) - 1, F.lit(0.0))))


def separated_top(windows: DataFrame, n: int, apart: float) -> list[dict]:
    """Greedy choice of the n best windows at least `apart` pixels from each other: each is the best of those that the ones
    before leave."""
    chosen: list[dict] = []
    for _ in range(n):
        best = windows.orderBy(F.desc("score"), "r0", "c0").first()
        if best is None:
            break
        chosen.append(best.asDict())
        dr, dc = F.col("r0") - best["r0"], F.col("c0") - best["c0"]
        windows = windows.filter(dr * dr + dc * dc >= apart * apart)
    return chosen


def median_composite(rows: DataFrame, keys: list[str], bands: list[str], ok: Column) -> DataFrame:
    """Median of each band over the clear observations of a pixel."""
    return rows.filter(ok).groupBy(*keys).agg(*[F.expr(f"percentile({b}, 0.5)").alias(b) for b in bands])


def first_wins(rows: DataFrame, keys: list[str], by: Column, *ties: str) -> DataFrame:
    """The row of the largest value, the first of equals."""
    w = Window.partitionBy(*keys).orderBy(by.desc(), *ties)
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
