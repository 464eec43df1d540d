"""Nearest-neighbour join of points, by buckets: no pair of far points is ever formed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grid points in a bucket on average.
PER_BUCKET = 4


def nearest(samples: DataFrame, grid: DataFrame, keys: list[str], gid: str) -> DataFrame:
    """samples (x, y) with the id and squared distance d2 of the nearest of grid (gx, gy), ties to the smaller id.

    The grid is hashed into square buckets. Rounds look at the buckets around a sample, with a radius that doubles: a
    sample is done once its best is within the distance that the buckets looked at cover.
    """
    box = grid.agg(F.min("gx"), F.max("gx"), F.min("gy"), F.max("gy"), F.count("*")).first()
    if not box[4]:
        return samples.select(*samples.columns, F.lit(None).cast("long").alias(gid), F.lit(None).cast("double").alias("d2")).filter(F.lit(False))
    width, height = box[1] - box[0], box[3] - box[2]
    side = math.sqrt(max(width * height, 1e-12) * PER_BUCKET / box[4]) or 1.0
    far = grid.select(F.floor(F.col("gx") / side).alias("bx"), F.floor(F.col("gy") / side).alias("by"), gid, "gx", "gy")
    reach = samples.agg(F.max(F.greatest(F.abs(F.col("x") - box[0]), F.abs(F.col("x") - box[1]), F.abs(F.col("y") - box[2]), F.abs(F.col("y") - box[3])))).first()[0] or 0.0
    left, done, radius = samples, None, 1
    while True:
        steps = F.sequence(F.lit(-radius), F.lit(radius))
        probes = left.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
        probes = probes.withColumn("bx", F.floor(F.col("x") / side) + F.col("i")).withColumn("by", F.floor(F.col("y") / side) + F.col("j")).drop("i", "j")
        d2 = (F.col("x") - F.col("gx")) * (F.col("x") - F.col("gx")) + (F.col("y") - F.col("gy")) * (F.col("y") - F.col("gy"))
        best = probes.join(far, ["bx", "by"]).groupBy(*keys).agg(F.min(F.struct(d2.alias("d2"), F.col(gid))).alias("best"))
        cover = (radius * side) ** 2
        last = radius * side > reach
        found = left.join(best.filter(F.lit(True) if last else F.col("best.d2") <= cover), keys).select(*samples.columns, F.col(f"best.{gid}").alias(gid), F.col("best.d2").alias("d2"))
        done = found if done is None else done.unionByName(found)
        if last:
            return done
        rest = left.join(best.filter(F.col("best.d2") <= cover), keys, "left_anti").persist()
        n = rest.count()
        if not n:
            return done
        # Few are far from the grid: those go on with all that there is once a grid is small.
        left, radius = rest, radius * 2 if radius < 8 else math.ceil(reach / side) + 1
