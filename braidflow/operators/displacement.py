"""Displacement of image windows by cross-correlation, with validation and repair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def frame_pairs(frames: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each frame with the next one of its series."""
    w = Window.partitionBy(*keys).orderBy(order)
    return frames.select(*keys, F.col(order).alias("first"), F.lead(order).over(w).alias("second")).filter("second IS NOT NULL")


def window_grid(spark, height: int, width: int, size: int, overlap: int) -> DataFrame:
    """Centres of the correlation windows of a frame: (gy, gx, y, x)."""
    step = size - overlap
    ny, nx = (height - size) // step + 1, (width - size) // step + 1
    rows = spark.range(ny * nx).select((F.col("id") / nx).cast("int").alias("gy"), (F.col("id") % nx).cast("int").alias("gx"))
    return rows.withColumn("y", F.col("gy") * step + (size - 1) / 2).withColumn("x", F.col("gx") * step + (size - 1) / 2)


def windows(frames: DataFrame, keys: list[str], height: int, width: int, size: int, overlap: int) -> DataFrame:
    """(keys, gy, gx, a, b): the windows of pairs of frames (keys, r, c, a, b) as flat arrays, row by row. Each pixel goes to the
    windows that hold it; windows that aren't whole are left out."""
    step = size - overlap
    ny, nx = (height - size) // step + 1, (width - size) // step + 1
    reach = lambda x, n: F.sequence(F.greatest(F.lit(0), F.ceil((F.col(x) - size + 1) / step).cast("int")), F.least(F.lit(n - 1), F.floor(F.col(x) / step).cast("int")))
    some = lambda x, n: F.col(x).between(0, (n - 1) * step + size - 1)
    rows = frames.filter(some("r", ny) & some("c", nx)).withColumn("gy", F.explode(reach("r", ny))).withColumn("gx", F.explode(reach("c", nx)))
    rows = rows.filter((F.col("r") < F.col("gy") * step + size) & (F.col("c") < F.col("gx") * step + size))
    place = (F.col("r") - F.col("gy") * step) * size + F.col("c") - F.col("gx") * step
    out = rows.groupBy(*keys, "gy", "gx").agg(F.sort_array(F.collect_list(F.struct(place.alias("at"), "a", "b"))).alias("p"))
    return out.filter(F.size("p") == size * size).select(*keys, "gy", "gx", F.col("p.a").alias("a"), F.col("p.b").alias("b"))


def correlation(pairs: DataFrame, key: str, size: int) -> DataFrame:
    """Circular cross-correlation of two square patches (key, r, c, a, b): (key, dy, dx, score) for every shift.

    A shift's score is the sum of the products of one patch's deviations and the other's, shifted."""
    mean = pairs.groupBy(key).agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    rows = pairs.join(mean, key).select(key, "r", "c", (F.col("a") - F.col("ma")).alias("a"), (F.col("b") - F.col("mb")).alias("b"))
    left = rows.select(key, F.col("r").alias("r1"), F.col("c").alias("c1"), "a")
    right = rows.select(F.col(key).alias("k2"), F.col("r").alias("r2"), F.col("c").alias("c2"), "b")
    both = left.join(right, F.col(key) == F.col("k2"))
    dy, dx = F.pmod(F.col("r2") - F.col("r1"), F.lit(size)), F.pmod(F.col("c2") - F.col("c1"), F.lit(size))
    return both.groupBy(key, dy.alias("dy"), dx.alias("dx")).agg(F.sum(F.col("a") * F.col("b")).alias("score"))


def peaks(scores: DataFrame, key: str, size: int, apart: int = 1) -> DataFrame:
    """Highest shift of each patch, first of equals, as a signed displacement, and its ratio to the highest one elsewhere."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "dy", "dx")
    top = scores.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(key, F.col("dy").alias("py"), F.col("dx").alias("px"), F.col("score").alias("peak"))
    rows = scores.join(top, key)

    def gap(a: str, b: str):
        d = F.abs(F.col(a) - F.col(b))
        return F.least(d, size - d)

    far = (gap("dy", "py") > apart) | (gap("dx", "px") > apart)
    second = rows.groupBy(key).agg(F.first("py").alias("py"), F.first("px").alias("px"), F.first("peak").alias("peak"), F.max(F.when(far, F.col("score"))).alias("second"))
    signed = lambda x: F.when(F.col(x) > size // 2, F.col(x) - size).otherwise(F.col(x))
    return second.select(key, signed("px").alias("dx"), signed("py").alias("dy"), "peak", F.when(F.col("second") > 0, F.col("peak") / F.col("second")).alias("signal"))


def validated(field: DataFrame, least: float = 1.3) -> DataFrame:
    """Displacements whose peak doesn't stand out become missing."""
    ok = F.coalesce(F.col("signal") >= least, F.lit(False))
    return field.withColumns({c: F.when(ok, F.col(c).cast("double")) for c in ("dx", "dy")})


def repaired(field: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Missing vectors take the mean of those of the eight neighbours that there are."""
    gone = field.filter(F.col(values[0]).isNull()).select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])).alias("d"), "gy", "gx")
    gone = gone.select(*keys, F.col("gy").alias("hy"), F.col("gx").alias("hx"), (F.col("gy") + F.col("d.i")).alias("gy"), (F.col("gx") + F.col("d.j")).alias("gx"))
    means = gone.join(field, [*keys, "gy", "gx"]).groupBy(*keys, F.col("hy").alias("gy"), F.col("hx").alias("gx")).agg(*[F.avg(v).alias(f"{v}_near") for v in values])
    out = field.join(means, [*keys, "gy", "gx"], "left")
    return out.withColumns({v: F.coalesce(v, f"{v}_near") for v in values}).drop(*[f"{v}_near" for v in values])


def subpixel(left, peak, right):
    """Offset of a Gaussian through three scores; 0 where one isn't positive."""
    a, b, c = (F.log(F.when(x > 0, x)) for x in (left, peak, right))
    return F.coalesce((a - c) / F.nullif(2 * a - 4 * b + 2 * c, F.lit(0.0)), F.lit(0.0))


def displacement_of(frames: DataFrame, keys: list[str], size: int, overlap: int) -> DataFrame:
    """Displacement of every window of frame pairs (keys, gy, gx, a, b; patches as flat arrays of doubles), by the Fourier
    transform, one Arrow batch of windows at a time: dx and dy within a pixel, px and py whole, and the peak's ratio to the
    highest one elsewhere."""
    schema = ", ".join(f"{c} {t}" for c, t in frames.dtypes if c not in ("a", "b")) + ", dx double, dy double, px int, py int, signal double"

    def one(a: np.ndarray, b: np.ndarray) -> tuple[float, float, int, int, float]:
        a, b = a.reshape(size, size) - a.mean(), b.reshape(size, size) - b.mean()
        score = np.fft.irfft2(np.conj(np.fft.rfft2(a)) * np.fft.rfft2(b), (size, size))
        y, x = divmod(int(score.argmax()), size)
        top = score[y, x]
        fit = []
        for lo, hi in ((score[y - 1, x], score[(y + 1) % size, x]), (score[y, x - 1], score[y, (x + 1) % size])):
            if min(lo, top, hi) > 0 and 2 * np.log(lo) - 4 * np.log(top) + 2 * np.log(hi):
                fit.append((np.log(lo) - np.log(hi)) / (2 * np.log(lo) - 4 * np.log(top) + 2 * np.log(hi)))
            else:
                fit.append(0.0)
        rows, cols = np.ogrid[:size, :size]
        gy, gx = np.abs(rows - y), np.abs(cols - x)
        far = (np.minimum(gy, size - gy) > 2) | (np.minimum(gx, size - gx) > 2)
        second = score[far].max() if far.any() else 0.0
        signed = [v - size if v > size // 2 else v for v in (y, x)]
        return signed[1] + fit[1], signed[0] + fit[0], signed[1], signed[0], float(top / second) if second > 0 else np.inf

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [one(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(p["a"], p["b"], strict=True)]
            yield p.drop(columns=["a", "b"]).assign(dx=[f[0] for f in found], dy=[f[1] for f in found], px=[f[2] for f in found], py=[f[3] for f in found], signal=[f[4] for f in found])

    return frames.mapInPandas(run, schema)
