"""Operators on samples ordered along a curve: windows by curve, and spectra and lag correlations by curve."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidflow.functions.columns import clean, magnitude, ratio


def ordered(keys: list[str], i: str = "i") -> Window:
    return Window.partitionBy(*keys).orderBy(i)


def gradient(x: str, w) -> Column:
    """Half the difference of the neighbours, one-sided at the ends; 0 for a single sample."""
    before, after, here = F.lag(x).over(w), F.lead(x).over(w), F.col(x)
    return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - here).when(after.isNull(), here - before).otherwise((after - before) / 2)


def tangents(rows: DataFrame, keys: list[str], x: str = "x", y: str = "y", i: str = "i") -> DataFrame:
    """rows with unit tangent (tx, ty) and normal (nx, ny), a quarter turn clockwise."""
    w = ordered(keys, i)
    rows = rows.withColumns({"_gx": gradient(x, w), "_gy": gradient(y, w)})
    n = F.coalesce(F.nullif(magnitude("_gx", "_gy"), F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumns({"tx": F.col("_gx") / n, "ty": F.col("_gy") / n}).drop("_gx", "_gy")
    return rows.withColumns({"nx": F.col("ty"), "ny": -F.col("tx")})


def curvature(rows: DataFrame, keys: list[str], s: str = "s", x: str = "x", y: str = "y", i: str = "i") -> DataFrame:
    """rows with c, the derivative by arc length of the unwrapped direction, on uneven steps."""
    w = ordered(keys, i)
    rows = rows.withColumn("_t", F.atan2(gradient(y, w), gradient(x, w)))
    turn = F.col("_t") - F.lag("_t").over(w)
    rows = rows.withColumn("_jump", F.coalesce(-2 * math.pi * F.rint(turn / (2 * math.pi)), F.lit(0.0)))
    rows = rows.withColumn("_u", F.col("_t") + F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    f0, f1, f2 = F.lag("_u").over(w), F.col("_u"), F.lead("_u").over(w)
    hs, hd = F.col(s) - F.lag(s).over(w), F.lead(s).over(w) - F.col(s)
    inner = ratio(hs * hs * f2 + (hd * hd - hs * hs) * f1 - hd * hd * f0, hs * hd * (hs + hd))
    return rows.withColumn("c", F.when(f0.isNull(), ratio(f2 - f1, hd)).when(f2.isNull(), ratio(f1 - f0, hs)).otherwise(inner)).drop("_t", "_jump", "_u")


def without_duplicates(rows: DataFrame, keys: list[str], x: str = "x", y: str = "y", i: str = "i", least: float = 0.0) -> DataFrame:
    """Vertices that lie farther than `least` from the one before."""
    w = ordered(keys, i)
    d = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    return rows.withColumn("_d", d).filter(F.col("_d").isNull() | (F.col("_d") > least)).drop("_d")


def arc_length(rows: DataFrame, keys: list[str], x: str = "x", y: str = "y", i: str = "i") -> DataFrame:
    w = ordered(keys, i)
    d = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    rows = rows.withColumn("_d", F.coalesce(d, F.lit(0.0)))
    return rows.withColumn("s", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def densified(rows: DataFrame, keys: list[str], step: float, least: int = 2) -> DataFrame:
    """Points (keys, k, s, x, y) at even arc length on polylines (keys, i, x, y): as many intervals as steps of that length
    need, `least` at the fewest. Each segment makes the points that it holds, so that no point meets all segments."""
    if step <= 0:
        raise ValueError("the step must be positive")
    w = ordered(keys)
    rows = arc_length(rows, keys)
    seg = rows.select(*keys, F.col("s").alias("s0"), F.lead("s").over(w).alias("s1"), F.col("x").alias("x0"), F.lead("x").over(w).alias("x1"), F.col("y").alias("y0"), F.lead("y").over(w).alias("y1"))
    seg = seg.withColumn("total", F.max("s1").over(Window.partitionBy(*keys))).filter("s1 > s0")
    n = F.greatest(F.ceil(F.col("total") / step), F.lit(least))
    seg = seg.withColumn("n", n).withColumn("d", F.col("total") / F.col("n"))
    first = F.ceil(F.round(F.col("s0") / F.col("d"), 9))
    last = F.when(F.col("s1") == F.col("total"), F.col("n")).otherwise(F.ceil(F.round(F.col("s1") / F.col("d"), 9)) - 1)
    seg = seg.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    s = F.col("k") * F.col("d")
    f = F.least(F.greatest((s - F.col("s0")) / (F.col("s1") - F.col("s0")), F.lit(0.0)), F.lit(1.0))
    return seg.select(*keys, "k", s.alias("s"), (F.col("x0") + f * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + f * (F.col("y1") - F.col("y0"))).alias("y"))


def filled(rows: DataFrame, keys: list[str], value: str, i: str = "i") -> DataFrame:
    """Missing values by linear interpolation on the index, flat at the ends; 0 without any value."""
    w = ordered(keys, i)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(i))
    v0, v1, i0, i1 = F.last(value, True).over(back), F.first(value, True).over(ahead), F.last(at, True).over(back), F.first(at, True).over(ahead)
    between = v0 + (v1 - v0) * ratio((F.col(i) - i0).cast("double"), (i1 - i0).cast("double"))
    return rows.withColumn(value, F.coalesce(F.col(value), between, v0, v1, F.lit(0.0)))


def moving_average(x: Column | str, keys: list[str], width: int, i: str = "i") -> Column:
    """Sum over a window of that width, beyond the ends zeros, by the width; even ones reach one farther back."""
    before, after = width // 2, width - width // 2 - 1
    return F.sum(x).over(ordered(keys, i).rowsBetween(-before, after)) / width


def step_estimate(rows: DataFrame, keys: list[str], s: str = "s", i: str = "i") -> DataFrame:
    d = rows.withColumn("_d", F.col(s) - F.lag(s).over(ordered(keys, i)))
    return d.groupBy(*keys).agg(F.expr("percentile(_d, 0.5)").alias("step"))


def longest_run(rows: DataFrame, keys: list[str], flag: str, at: str, i: str = "i") -> DataFrame:
    """(keys, width): from first to last position of the longest run of set flags, the first of equals; NULL for none or
    a run of one."""
    w = ordered(keys, i)
    groups = rows.withColumn("_g", F.row_number().over(w) - F.sum(F.col(flag).cast("int")).over(w)).filter(F.col(flag))
    runs = groups.groupBy(*keys, "_g").agg(F.count("*").alias("n"), F.min(i).alias("start"), (F.max(at) - F.min(at)).alias("width"))
    best = runs.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("start")).alias("start"), "width")).alias("best"))
    return best.select(*keys, F.nullif(F.col("best.width").cast("double"), F.lit(0.0)).alias("width"))


def link_summary(rows: DataFrame, key: str, s: str = "s", b: str = "b", m: str = "m", c: str = "c") -> DataFrame:
    """Per link: arc length, samples, shares of valid samples, mean, median and population deviation of width and
    migration, mean and largest |migration|, share of positive migration, mean and median |curvature|."""
    w, v, k = clean(b), clean(m), clean(c)
    n = F.count("*")
    share = lambda x: F.count(x) / n
    rows = rows.select(key, clean(s).alias("_s"), w.alias("_b"), v.alias("_m"), F.abs(k).alias("_c"))
    return rows.groupBy(key).agg(
        (F.max("_s") - F.min("_s")).alias("arc_length"), n.alias("n_samples"), share("_b").alias("valid_b"), share("_m").alias("valid_m"), share("_c").alias("valid_c"),
        F.avg("_b").alias("mean_b"), F.expr("percentile(_b, 0.5)").alias("median_b"), F.stddev_pop("_b").alias("std_b"),
        F.avg("_m").alias("mean_m"), F.expr("percentile(_m, 0.5)").alias("median_m"), F.stddev_pop("_m").alias("std_m"),
        F.avg(F.abs("_m")).alias("mean_abs_m"), F.max(F.abs("_m")).alias("max_abs_m"), ratio(F.count_if(F.col("_m") > 0), F.count("_m").cast("double")).alias("pos_m"),
        F.avg("_c").alias("mean_abs_c"), F.expr("percentile(_c, 0.5)").alias("median_abs_c"),
    )


# Spectra and correlations. A curve is one task's, whole: its transform and all its lags, without pairs of samples.


def by_curve(rows: DataFrame, key: str, values: list[str], i: str, made: dict[str, str], one) -> DataFrame:
    """one(arrays of the values, in order, where all are present) gives a column for each of `made`, or None for a curve of
    fewer than four."""
    for v in values:
        rows = rows.filter(clean(v).isNotNull())
    schema = ", ".join([f"{key} {dict(rows.dtypes)[key]}", *(f"{c} {t}" for c, t in made.items())])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(i)
        out = one(*(p[v].to_numpy(float) for v in values)) if len(p) >= 4 else None
        table = pd.DataFrame({c: [] for c in made} if out is None else out)
        table.insert(0, key, pd.Series([p[key].iloc[0]] * len(table), dtype=object))
        return table

    return rows.select(key, i, *values).groupBy(key).applyInPandas(run, schema)


def spectrum(rows: DataFrame, key: str, value: str, i: str = "i") -> DataFrame:
    """(key, n, k, re, im, amp, phase, share) of the whole discrete Fourier transform of the values less their mean, from
    one wave along the curve to half the number of samples; share is the amplitude by the largest one."""

    def one(v: np.ndarray) -> dict:
        f = np.fft.rfft(v - v.mean())[1:]
        amp = np.abs(f)
        # What is left of rounding has no phase.
        f = np.where(np.abs(f.real) > 1e-9 * amp.max(), f.real, 0.0) + 1j * np.where(np.abs(f.imag) > 1e-9 * amp.max(), f.imag, 0.0)
        share = amp / amp.max() if amp.max() > 0 else np.full(len(f), None)
        return {"n": np.full(len(f), len(v)), "k": np.arange(1, len(f) + 1), "re": f.real, "im": f.imag, "amp": amp, "phase": np.angle(f), "share": share}

    return by_curve(rows, key, [value], i, {"n": "long", "k": "long"} | {c: "double" for c in ("re", "im", "amp", "phase", "share")}, one)


def lags(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlation of x at a sample and y at one `lag` before it, for all lags from 1 - n to n - 1."""
    n = len(x)
    size = 1 << (2 * n - 1).bit_length()
    x, y = x - x.mean(), y - y.mean()
    full = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)
    norm = np.sqrt((x * x).sum() * (y * y).sum())
    return np.concatenate([full[size - n + 1 :], full[:n]]) / norm if norm > 0 else np.full(2 * n - 1, np.nan)


def lag_correlation(rows: DataFrame, key: str, x: str, y: str, i: str = "i", most: int | None = None) -> DataFrame:
    """(key, lag, r): correlation of x at a sample and y `lag` samples before it, over samples that have both, for all lags
    or those up to `most` either way; NULL where either is constant."""

    def one(a: np.ndarray, b: np.ndarray) -> dict:
        n = len(a)
        reach = n - 1 if most is None else min(n - 1, most)
        r = lags(a, b)[n - 1 - reach : n + reach]
        return {"lag": np.arange(-reach, reach + 1), "r": [None if np.isnan(v) else v for v in r.tolist()]}

    return by_curve(rows, key, [x, y] if x != y else [x], i, {"lag": "long", "r": "double"}, one if x != y else lambda a: one(a, a))


def dominant(spectra: DataFrame, keys: list[str], step: Column | float = 1.0, longest: Column | None = None) -> DataFrame:
    """(keys, k, wavelength): of the highest amplitude, the first of equals, of wavelengths no longer than `longest`."""
    length = F.col("n") * (F.lit(step) if not isinstance(step, Column) else step) / F.col("k")
    rows = spectra.withColumn("wavelength", length)
    if longest is not None:
        rows = rows.filter(F.col("wavelength") <= longest)
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.round("amp", 9).alias("a"), (-F.col("k")).alias("k"), "wavelength")).alias("b"))
    return best.select(*keys, (-F.col("b.k")).alias("k"), F.col("b.wavelength").alias("wavelength"))


def best_lag(curves: DataFrame, keys: list[str]) -> DataFrame:
    """The lag of the highest signed correlation, the first of equals."""
    best = curves.groupBy(*keys).agg(F.max(F.struct(F.round("r", 9).alias("r"), (-F.col("lag")).alias("lag"))).alias("b"))
    return best.select(*keys, (-F.col("b.lag")).alias("lag"), F.col("b.r").alias("r"))


def correlation_lengths(acf: DataFrame, keys: list[str]) -> DataFrame:
    """From autocorrelations at lags from 0 on: the first lag at or below 1/e, and their sum over lags from 1 to before
    the first negative one; NULL where there is none."""
    pos = acf.filter("lag >= 0")
    marks = pos.groupBy(*keys).agg(F.min(F.when(F.col("r") <= math.exp(-1), F.col("lag"))).alias("folding"), F.min(F.when(F.col("r") < 0, F.col("lag"))).alias("zero"), F.max("lag").alias("last"))
    rows = pos.join(marks, keys)
    end = F.coalesce("zero", F.col("last") + 1)
    return rows.groupBy(*keys).agg(F.first("folding").alias("folding"), F.sum(F.when((F.col("lag") >= 1) & (F.col("lag") < end), F.col("r"))).alias("integral"))


def criterion(rows: DataFrame, key: str, i: str = "i") -> DataFrame:
    """Per curve of width b, curvature c and migration m: dominant wavelengths of b and c and the phase of b after c at that
    of c, the lags of the highest correlation of either with m, and their first lag at or below 1/e and the integral to before
    their first negative one; in samples and degrees."""

    def scales(v: np.ndarray) -> tuple:
        r = lags(v, v)[len(v) - 1 :]
        low, below = np.flatnonzero(r <= np.exp(-1)), np.flatnonzero(r < 0)
        end = below[0] if len(below) else len(r)
        return int(low[0]) if len(low) else None, float(r[1:end].sum()) if end > 1 else None

    def one(b: np.ndarray, c: np.ndarray, m: np.ndarray) -> dict:
        n = len(b)
        fb, fc = (np.fft.rfft(v - v.mean()) for v in (b, c))
        kb, kc = (1 + int(np.round(np.abs(f[1:]), 9).argmax()) for f in (fb, fc))
        turn = np.angle(fb[kc]) - np.angle(fc[kc])
        out = {"wavelength_b": n / kb, "wavelength_c": n / kc, "phase": round(float(np.degrees((turn + np.pi) % (2 * np.pi) - np.pi)), 3)}
        for name, v in (("b", b), ("c", c)):
            r = lags(v, m)
            at = int(np.nan_to_num(np.round(r, 9), nan=-2).argmax())
            folding, integral = scales(v)
            out |= {f"lag_{name}": at - n + 1, f"r_{name}": round(float(r[at]), 6), f"folding_{name}": folding, f"integral_{name}": None if integral is None else round(integral, 5)}
        return {k: [round(v, 6) if k.startswith("wave") else v] for k, v in out.items()}

    made = {c: "double" for c in ("wavelength_b", "wavelength_c", "phase")} | {f"{c}_{x}": t for x in "bc" for c, t in (("lag", "long"), ("r", "double"), ("folding", "long"), ("integral", "double"))}
    return by_curve(rows, key, ["b", "c", "m"], i, made, one)


def sparse_by(rows: DataFrame, key: str, year: str, target: int, least: int = 3) -> DataFrame:
    """(key, year): the sparse years of each series."""
    schema = f"{key} {dict(rows.dtypes)[key]}, {year} {dict(rows.dtypes)[year]}"

    def one(p: pd.DataFrame) -> pd.DataFrame:
        years = sparse_years(sorted(set(p[year].tolist())), target, least)
        return pd.DataFrame({key: [p[key].iloc[0]] * len(years), year: years})

    return rows.select(key, year).distinct().groupBy(key).applyInPandas(one, schema)


def sparse_years(years: list[int], target: int, least: int = 3) -> list[int]:
    """At most `target` years about evenly apart, with the first and the last: from each the year nearest to the next
    step, the earlier of equals. So many or fewer years stay as they are."""
    if len(years) <= target:
        return years
    years = sorted(set(years))
    step = max((years[-1] - years[0]) / (target - 1) if target > 1 else years[-1] - years[0], least)
    chosen = [years[0]]
    while len(chosen) < target - 1 and chosen[-1] < years[-1]:
        chosen.append(min((y for y in years if y > chosen[-1]), key=lambda y: (abs(y - chosen[-1] - step), y)))
    return sorted({*chosen, years[-1]})

