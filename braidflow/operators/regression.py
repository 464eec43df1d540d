"""Regressions and binned statistics as aggregates, with guards for degenerate input."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidflow.functions.columns import clean


def linear(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least squares y = slope * x + intercept by group over finite pairs. With fewer than two pairs nothing is fitted; a
    constant x takes the solution of least norm, a constant y has no r2."""
    both = clean(x).isNotNull() & clean(y).isNotNull()
    rows = rows.filter(both)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("xy"))
    flat = F.col("vx") == 0
    slope = F.when(flat, F.col("mx") * F.col("my") / (1 + F.col("mx") * F.col("mx"))).otherwise(F.col("xy") / F.nullif(F.col("vx"), F.lit(0.0)))
    intercept = F.when(flat, F.col("my") / (1 + F.col("mx") * F.col("mx"))).otherwise(F.col("my") - slope * F.col("mx"))
    r2 = F.when(F.col("vy") > 0, F.when(flat, 0.0).otherwise(F.col("xy") * F.col("xy") / F.nullif(F.col("vx") * F.col("vy"), F.lit(0.0))))
    ok = F.col("n") >= 2
    return out.select(*keys, "n", F.when(ok, slope).alias("slope"), F.when(ok, intercept).alias("intercept"), F.when(ok, r2).alias("r2"))


def through_origin(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    xy, xx, yy = F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x)), F.sum(F.col(y) * F.col(y))
    out = rows.filter(clean(x).isNotNull() & clean(y).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), xy.alias("xy"), xx.alias("xx"), yy.alias("yy"), (F.var_pop(y) * F.count("*")).alias("tot"))
    slope = F.col("xy") / F.nullif(F.col("xx"), F.lit(0.0))
    rest = F.col("yy") - 2 * slope * F.col("xy") + slope * slope * F.col("xx")
    return out.select(*keys, "n", slope.alias("slope"), (1 - rest / F.nullif(F.col("tot"), F.lit(0.0))).alias("r2"))


def power_law(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """y = a * x ** b by least squares of logarithms over positive pairs; r2 is that of the curve itself."""
    rows = rows.filter((clean(x) > 0) & (clean(y) > 0)).withColumns({"_lx": F.log(x), "_ly": F.log(y)})
    fit = linear(rows, keys, "_lx", "_ly").select(*keys, "n", F.exp("intercept").alias("a"), F.col("slope").alias("b"))
    mean = rows.groupBy(*keys).agg(F.avg(y).alias("_my"))
    both = rows.join(fit.join(mean, keys), keys)
    rest = F.col(y) - F.col("a") * F.pow(F.col(x), F.col("b"))
    r2 = both.groupBy(*keys).agg((1 - F.sum(rest * rest) / F.nullif(F.sum((F.col(y) - F.col("_my")) * (F.col(y) - F.col("_my"))), F.lit(0.0))).alias("r2"))
    return fit.join(r2, keys, "left")


def binned(rows: DataFrame, keys: list[str], x: str, y: str, bins: int, least: int = 5, log: bool = False, clip: tuple[float, float] | None = None, pooled: bool = False) -> DataFrame:
    """Count, and from `least` on mean and quartiles, of y in `bins` even bins of x over its group's range, by its logarithm
    if asked; bins are half-open, the last is closed.

    With clip the range lies between those quantiles of x (the first at most, the second at least the median), up to the
    largest x where they are equal, a hundredth wide where that is too; x outside are in no bin. With pooled all groups
    share one range.
    """
    rows = rows.filter(clean(x).isNotNull() & clean(y).isNotNull())
    if log:
        rows = rows.filter(F.col(x) > 0)
    v = (lambda c: F.log10(c)) if log else (lambda c: c)
    box_keys = [] if pooled else keys
    if clip:
        low, high = min(max(clip[0], 0.0), 0.5), max(min(clip[1], 1.0), 0.5)
        box = rows.groupBy(*box_keys).agg(F.expr(f"percentile({x}, {low})").alias("_lo"), F.expr(f"percentile({x}, {high})").alias("_hi"), F.max(x).alias("_top"))
        hi = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi")).when(F.col("_top") > F.col("_lo"), F.col("_top")).otherwise(F.col("_lo") + F.abs("_lo") * 0.01)
        box = box.select(*box_keys, "_lo", hi.alias("_hi"))
    else:
        box = rows.groupBy(*box_keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    rows = rows.join(box, box_keys) if box_keys else rows.crossJoin(F.broadcast(box))  # one row
    rows = rows.filter(F.col(x).between(F.col("_lo"), F.col("_hi")))
    lo, hi = v(F.col("_lo")), v(F.col("_hi"))
    at = F.floor(F.round((v(F.col(x)) - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins, 9))
    rows = rows.withColumn("bin", F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int"))
    out = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.expr(f"percentile({y}, 0.25)").alias("p25"), F.expr(f"percentile({y}, 0.75)").alias("p75"))
    return out.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in ("mean", "p25", "p75")})


def curvature_fit(rows: DataFrame, key: str, x: str, y: str, rounds: int = 60) -> DataFrame:
    """Peak and critical value of y = peak * (x / critical) * exp(1 - x / critical) by damped Gauss-Newton steps for each
    group over positive pairs, from the 95th percentile of y and the 75th of x; fewer than five pairs or no convergence
    give NULLs. Pairs are first summed in bins of x, so that a group's size doesn't matter: a round needs sums alone."""
    rows = rows.filter((clean(x) > 0) & (clean(y) > 0))
    start = rows.groupBy(key).agg(F.expr(f"percentile({y}, 0.95)").alias("p"), F.expr(f"percentile({x}, 0.75)").alias("k"), F.count("*").alias("n"), F.avg(y).alias("my"), (F.var_pop(y) * F.count("*")).alias("tot"))
    # Equal x share one residual sum: n, sum of y and sum of squares by distinct x carry all that least squares needs.
    sums = rows.groupBy(key, x).agg(F.count("*").alias("c"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy"))
    schema = f"{key} {dict(rows.dtypes)[key]}, n long, peak double, critical double, r2 double"

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        x_, c, sy, syy = (p[n].to_numpy(float) for n in (x, "c", "sy", "syy"))
        a, k, n = float(p["p"].iloc[0]), max(float(p["k"].iloc[0]), 1e-12), int(p["n"].iloc[0])
        tot = float(p["tot"].iloc[0])
        if n < 5:
            return pd.DataFrame({key: [p[key].iloc[0]], "n": [n], "peak": [None], "critical": [None], "r2": [None]})

        def loss(a: float, k: float) -> float:
            f = a * (x_ / k) * np.exp(1 - x_ / k)
            return float((syy - 2 * f * sy + c * f * f).sum())

        damp, now = 1e-3, loss(a, k)
        for _ in range(rounds):
            g = (x_ / k) * np.exp(1 - x_ / k)
            j = np.stack([g, a * g * (x_ / k - 1) / k])
            grad = j @ (sy - c * a * g)
            hess = (j * c) @ j.T
            try:
                step = np.linalg.solve(hess + damp * np.diag(np.diag(hess) + 1e-30), grad)
            except np.linalg.LinAlgError:
                break
            if k + step[1] > 0 and (after := loss(a + step[0], k + step[1])) < now:
                done = now - after < 1e-12 * max(now, 1e-30)
                a, k, now, damp = a + step[0], k + step[1], after, damp / 3
                if done:
                    break
            else:
                damp *= 4
        return pd.DataFrame({key: [p[key].iloc[0]], "n": [n], "peak": [a], "critical": [k], "r2": [1 - now / tot if tot > 0 else None]})

    return sums.join(start, key).groupBy(key).applyInPandas(fit, schema)
