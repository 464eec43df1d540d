"""Ensemble statistics of vectors, fusion of realizations and uncertainty over masks: group aggregates, map-side first."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidflow.functions.columns import clean, direction, finite_all, magnitude, ratio, rotated


def vector_stats(obs: DataFrame, keys: list[str], u: str = "u", v: str = "v", spread_factor: float = 2.0, spread_degrees: float = 120.0, least: int = 2, still: float = 1e-3) -> DataFrame:
    """Per cell: mean vector, mean and population deviation of its length, circular mean and deviation of its direction,
    the number of finite samples n, and whether the cell is unreliable. A cell without samples has NULLs and n = 0."""
    x, y = clean(u), clean(v)
    both = finite_all(u, v)
    x, y = F.when(both, x), F.when(both, y)
    m, t = magnitude(x, y), direction(x, y)
    out = obs.groupBy(*keys).agg(
        F.avg(x).alias("u_mean"), F.avg(y).alias("v_mean"), F.avg(m).alias("n_mean"), F.stddev_pop(m).alias("n_std"),
        F.sum(F.sin(t)).alias("s"), F.sum(F.cos(t)).alias("k"), F.count(x).alias("n"),
    )
    resultant = F.least(F.lit(1.0), F.greatest(F.lit(1e-8), F.sqrt(F.col("s") * F.col("s") + F.col("k") * F.col("k")) / F.greatest("n", F.lit(1))))
    out = out.withColumn("theta_mean", F.atan2("s", "k")).withColumn("theta_std", F.sqrt(F.greatest(F.lit(0.0), -2 * F.log(resultant))))
    unsteady = (F.col("n_mean") > still) & (F.col("n_std") >= spread_factor * F.col("n_mean"))
    bad = F.coalesce(unsteady, F.lit(False)) | F.coalesce(F.col("theta_std") >= math.radians(spread_degrees), F.lit(False)) | (F.col("n") < least)
    return out.withColumn("bad_mask", bad).drop("s", "k")


def fused_tilts(obs: DataFrame, cell: list[str], tilt: str, degrees: str) -> DataFrame:
    """Statistics over time for each tilt, each tilt's mean turned back, and statistics over the tilts."""
    by_tilt = vector_stats(obs, [*cell, tilt, degrees])
    x, y = rotated("u_mean", "v_mean", -F.col(degrees))
    return vector_stats(by_tilt.select(*cell, x.alias("u"), y.alias("v")), cell)


def centre_crop(grid: DataFrame, keys: list[str], height: int, width: int, r: str = "gy", c: str = "gx") -> DataFrame:
    """The middle height x width cells of each grid, numbered from 0; a smaller grid gives nothing."""
    size = grid.groupBy(*keys).agg((F.max(r) + 1).alias("ny"), (F.max(c) + 1).alias("nx")).filter((F.col("ny") >= height) & (F.col("nx") >= width))
    top, left = F.floor((F.col("ny") - height) / 2), F.floor((F.col("nx") - width) / 2)
    out = grid.join(size, keys).withColumn(r, (F.col(r) - top).cast("int")).withColumn(c, (F.col(c) - left).cast("int"))
    return out.filter(F.col(r).between(0, height - 1) & F.col(c).between(0, width - 1)).drop("ny", "nx")


def mask_uncertainty(rows: DataFrame, key: str, value: str, thresholds: list[float]) -> DataFrame:
    """Over masks: mean, population deviation, their ratio, share of the prevailing sign, and how often |value| exceeds
    each threshold."""
    x = clean(value)
    n = F.count(x)
    sign = F.greatest(F.count_if(x > 0), F.count_if(x < 0))
    out = rows.groupBy(key).agg(n.alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), ratio(sign, n).alias("consistency"), *[ratio(F.count_if(F.abs(x) > t), n).alias(f"exceed_{k}") for k, t in enumerate(thresholds)])
    return out.withColumn("cv", ratio("std", F.abs(F.col("mean"))))


def ablation(stats: DataFrame) -> DataFrame:
    """One row: cells, kept cells and their share, median length of the mean vectors, mean samples, and over kept cells
    the mean ratio of deviation to length and the mean direction deviation."""
    kept = ~F.col("bad_mask")
    return stats.filter(F.col("u_mean").isNotNull()).agg(
        F.count("*").alias("raw"), F.count_if(kept).alias("kept"), (100 * F.count_if(kept) / F.count("*")).alias("keep_percent"),
        F.expr("percentile(sqrt(u_mean * u_mean + v_mean * v_mean), 0.5)").alias("median_length"), F.avg("n").alias("mean_n"),
        F.avg(F.when(kept, ratio("n_std", "n_mean"))).alias("precision_cv"), F.avg(F.when(kept, F.degrees("theta_std"))).alias("direction_std"),
    )


def resultant(u: str, v: str) -> Column:
    """Length of the mean of unit vectors: an aggregate."""
    m = F.nullif(magnitude(u, v), F.lit(0.0))
    return magnitude(F.avg(F.col(u) / m), F.avg(F.col(v) / m))


def thinned(rows: DataFrame, x: str, y: str, u: str, v: str, across: int, down: int, most: int) -> DataFrame:
    """Mean vector of each bucket of a grid over the points' extent, and of more than `most` buckets evenly spaced ones."""
    box = rows.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))

    def bucket(a: str, lo: str, hi: str, n: int) -> Column:
        return F.least(F.lit(n - 1), F.floor(ratio(F.col(a) - F.col(lo), F.col(hi) - F.col(lo)) * n)).cast("int")

    cells = rows.crossJoin(F.broadcast(box)).groupBy(bucket(y, "y0", "y1", down).alias("by"), bucket(x, "x0", "x1", across).alias("bx"))
    cells = cells.agg(*[F.avg(n).alias(n) for n in (x, y, u, v)], F.count("*").alias("n"))
    # At most across * down rows.
    ranked = cells.withColumn("k", F.row_number().over(Window.orderBy("by", "bx")) - 1).withColumn("total", F.count("*").over(Window.partitionBy()))
    step = F.greatest(F.lit(1.0), F.col("total") / F.lit(float(most)))
    return ranked.filter(F.floor(F.col("k") / step) != F.floor((F.col("k") - 1) / step)).drop("k", "total")


def clipped_lengths(rows: DataFrame, u: str, v: str, q: float, cap: float) -> DataFrame:
    """Vectors no longer than the q-quantile of lengths and than `cap`."""
    m = rows.withColumn("length", magnitude(u, v))
    edge = m.agg(F.expr(f"percentile(length, {q})").alias("edge"))
    return m.crossJoin(F.broadcast(edge)).filter((F.col("length") <= F.col("edge")) & (F.col("length") <= cap)).drop("edge")
