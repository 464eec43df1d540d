"""Queries on realization stacks, tilts and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidflow.functions.columns import along, capped, direction, magnitude, rotated, wrapped_degrees
from braidflow.operators import ensemble, grids
from braidflow.sources.standins import MASK_PROFILE, VECTOR_OBS, mask_profile, vector_obs

from .registry import query

STATS = """stats AS (SELECT cell, avg(u) AS u_mean, avg(v) AS v_mean, avg(sqrt(u*u+v*v)) AS n_mean, stddev_pop(sqrt(u*u+v*v)) AS n_std,
  atan2(sum(sin(atan2(v,u))), sum(cos(atan2(v,u)))) AS theta_mean,
  sqrt(greatest(0, -2*ln(least(1, greatest(1e-8, sqrt(pow(sum(sin(atan2(v,u))),2)+pow(sum(cos(atan2(v,u))),2))/greatest(count(u),1)))))) AS theta_std,
  count(u) AS n FROM obs GROUP BY cell),
flagged AS (SELECT *, (coalesce(n_mean > 1e-3 AND n_std >= 2*n_mean, false) OR coalesce(theta_std >= radians(120), false) OR n < 2) AS bad_mask FROM stats)"""


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"WITH {VECTOR_OBS}, {STATS} SELECT cell, n, bad_mask, round(u_mean,6) u_mean, round(v_mean,6) v_mean, round(n_mean,6) n_mean, round(n_std,6) n_std, round(theta_mean,6) theta_mean, round(theta_std,6) theta_std FROM flagged")
def a01_ensemble_stats(spark, sf_dir):
    return rounded(ensemble.vector_stats(vector_obs(spark, sf_dir), ["cell"]), "u_mean", "v_mean", "n_mean", "n_std", "theta_mean", "theta_std")


@query(f"""WITH {VECTOR_OBS}, t AS (SELECT cell, realization % 4 AS tilt, avg(u) AS u, avg(v) AS v FROM obs WHERE u IS NOT NULL GROUP BY ALL),
r AS (SELECT cell, sqrt(u*u+v*v)*cos(atan2(v,u)-radians(tilt*15)) AS u, sqrt(u*u+v*v)*sin(atan2(v,u)-radians(tilt*15)) AS v FROM t)
SELECT cell, count(*) AS n, round(avg(u),6) u_mean, round(avg(v),6) v_mean, round(stddev_pop(sqrt(u*u+v*v)),6) n_std FROM r GROUP BY cell""")
def a02_tilt_fusion(spark, sf_dir):
    obs = vector_obs(spark, sf_dir).withColumn("tilt", F.col("realization") % 4).withColumn("degrees", F.col("tilt") * 15)
    return rounded(ensemble.fused_tilts(obs, ["cell"], "tilt", "degrees"), "u_mean", "v_mean", "n_std").select("cell", "n", "u_mean", "v_mean", "n_std")


@query(f"""WITH {MASK_PROFILE} SELECT pos, count(mn) AS n, round(avg(mn),6) mean, round(stddev_pop(mn),6) std, round(stddev_pop(mn)/nullif(abs(avg(mn)),0),6) cv,
round(greatest(count(*) FILTER (mn>0), count(*) FILTER (mn<0))/nullif(count(mn),0)::DOUBLE,6) consistency,
round(count(*) FILTER (abs(mn)>2)/nullif(count(mn),0)::DOUBLE,6) exceed_0, round(count(*) FILTER (abs(mn)>5)/nullif(count(mn),0)::DOUBLE,6) exceed_1 FROM mp GROUP BY pos""")
def a03_a06_mask_uncertainty(spark, sf_dir):
    out = ensemble.mask_uncertainty(mask_profile(spark, sf_dir), "pos", "mn", [2.0, 5.0])
    return rounded(out, "mean", "std", "cv", "consistency", "exceed_0", "exceed_1")


@query(f"WITH {MASK_PROFILE} SELECT mask, quantile_cont(mn, 0.5) AS median, min(mn) AS low, max(mn) AS high, count(mn) AS n FROM mp GROUP BY mask".replace("quantile_cont(mn, 0.5)", "round(quantile_cont(mn, 0.5),6)").replace("min(mn)", "round(min(mn),6)").replace("max(mn)", "round(max(mn),6)"))
def a28_range_summary(spark, sf_dir):
    out = mask_profile(spark, sf_dir).groupBy("mask").agg(F.expr("percentile(mn, 0.5)").alias("median"), F.min("mn").alias("low"), F.max("mn").alias("high"), F.count("mn").alias("n"))
    return rounded(out, "median", "low", "high")


@query(f"WITH {MASK_PROFILE} SELECT pos, mask, round(CASE WHEN abs(m) < 0.5 THEN NULL ELSE s / abs(m) END, 6) AS shown FROM (SELECT *, avg(mn) OVER (PARTITION BY pos) AS m, stddev_pop(mn) OVER (PARTITION BY pos) AS s FROM mp)")
def f14_j05_aligned_masks(spark, sf_dir):
    """Masks joined by position; the ratio of deviation to mean is hidden where the mean is small."""
    rows = mask_profile(spark, sf_dir)
    stats = ensemble.mask_uncertainty(rows, "pos", "mn", []).select(F.col("pos").alias("p"), "mean", "cv")
    out = rows.join(stats, F.col("pos") == F.col("p"))
    return out.select("pos", "mask", F.round(F.when(F.abs("mean") >= 0.5, F.col("cv")), 6).alias("shown"))


@query(f"""WITH {VECTOR_OBS}, {STATS} SELECT count(*) AS raw, count(*) FILTER (NOT bad_mask) AS kept, round(100.0*count(*) FILTER (NOT bad_mask)/count(*),6) keep_percent,
round(quantile_cont(sqrt(u_mean*u_mean+v_mean*v_mean),0.5),6) median_length, round(avg(n),6) mean_n, round(avg(n_std/nullif(n_mean,0)) FILTER (NOT bad_mask),6) precision_cv,
round(avg(degrees(theta_std)) FILTER (NOT bad_mask),6) direction_std FROM flagged WHERE u_mean IS NOT NULL""")
def a13_f07_ablation(spark, sf_dir):
    out = ensemble.ablation(ensemble.vector_stats(vector_obs(spark, sf_dir), ["cell"]))
    return rounded(out, "keep_percent", "median_length", "mean_n", "precision_cv", "direction_std")


@query(f"""WITH {VECTOR_OBS} SELECT realization, round(sqrt(pow(avg(u/nullif(sqrt(u*u+v*v),0)),2)+pow(avg(v/nullif(sqrt(u*u+v*v),0)),2)),6) AS r FROM obs GROUP BY realization""")
def a26_direction_resultant(spark, sf_dir):
    return vector_obs(spark, sf_dir).groupBy("realization").agg(F.round(ensemble.resultant("u", "v"), 6).alias("r"))


@query(f"""WITH {VECTOR_OBS}, g AS (SELECT *, cell//40 AS gy, cell%40 AS gx FROM obs WHERE u IS NOT NULL), b AS (SELECT min(gx) x0,max(gx) x1,min(gy) y0,max(gy) y1 FROM g),
k AS (SELECT least(4, floor((gy-y0)/nullif(y1-y0,0)::DOUBLE*5))::INTEGER AS "by", least(7, floor((gx-x0)/nullif(x1-x0,0)::DOUBLE*8))::INTEGER AS bx, avg(gx) gx, avg(gy) gy, avg(u) u, avg(v) v, count(*) n FROM g,b GROUP BY 1,2),
o AS (SELECT *, row_number() OVER (ORDER BY "by", bx)-1 AS k, greatest(1.0, count(*) OVER ()/10.0) AS st FROM k)
SELECT "by", bx, round(gx,6) gx, round(gy,6) gy, round(u,6) u, round(v,6) v, n FROM o WHERE floor(k/st) <> floor((k-1)/st)""")
def a27_thinned_vectors(spark, sf_dir):
    rows = vector_obs(spark, sf_dir).filter("u IS NOT NULL").select("u", "v", F.floor(F.col("cell") / 40).alias("gy"), (F.col("cell") % 40).alias("gx"))
    return rounded(ensemble.thinned(rows, "gx", "gy", "u", "v", 8, 5, 10), "gx", "gy", "u", "v")


@query(f"WITH {VECTOR_OBS}, m AS (SELECT *, sqrt(u*u+v*v) AS length FROM obs WHERE u IS NOT NULL) SELECT cell, realization, round(length,6) AS length FROM m WHERE length <= (SELECT quantile_cont(length, 0.9) FROM m) AND length <= 0.4")
def f09_length_clip(spark, sf_dir):
    out = ensemble.clipped_lengths(vector_obs(spark, sf_dir).filter("u IS NOT NULL"), "u", "v", 0.9, 0.4)
    return out.select("cell", "realization", F.round("length", 6).alias("length"))


@query(f"""WITH {VECTOR_OBS} SELECT cell, realization, round(sqrt(u*u+v*v),6) m, round(atan2(v,u),6) t, round(sqrt(u*u+v*v)*cos(atan2(v,u)+radians(30)),6) ru, round(sqrt(u*u+v*v)*sin(atan2(v,u)+radians(30)),6) rv,
round(u*0.6+v*0.8,6) mn, round(u*CASE WHEN sqrt(u*u+v*v)>0 THEN least(1.0,0.1/sqrt(u*u+v*v)) ELSE 1 END,6) cu, round(v*CASE WHEN sqrt(u*u+v*v)>0 THEN least(1.0,0.1/sqrt(u*u+v*v)) ELSE 1 END,6) cv,
round(degrees(((2*atan2(v,u)+pi()) - 2*pi()*floor((2*atan2(v,u)+pi())/(2*pi()))) - pi()),6) wrapped, round(abs(u),6) abs_u, sign(v)::INTEGER AS sign_v FROM obs""")
def p03_p05_p21_p22_p31_vectors(spark, sf_dir):
    """Length, direction, rotation, component along a normal, shortening, wrapped angle, magnitude and sign."""
    ru, rv = rotated("u", "v", 30)
    cu, cv = capped("u", "v", 0.1)
    cols = {"m": magnitude("u", "v"), "t": direction("u", "v"), "ru": ru, "rv": rv, "mn": along("u", "v", 0.6, 0.8), "cu": cu, "cv": cv, "wrapped": wrapped_degrees(2 * direction("u", "v")), "abs_u": F.abs("u")}
    return vector_obs(spark, sf_dir).select("cell", "realization", *[F.round(x, 6).alias(n) for n, x in cols.items()], F.signum("v").cast("int").alias("sign_v"))


@query(f"""WITH {VECTOR_OBS}, g AS (SELECT realization % 2 AS tilt, (cell//20)::INTEGER AS gy, (cell%20)::INTEGER AS gx, u, v FROM obs), s AS (SELECT tilt, max(gy)+1 ny, max(gx)+1 nx FROM g GROUP BY tilt),
k AS (SELECT tilt, gy - (ny-6)//2 AS gy, gx - (nx-12)//2 AS gx, u, v FROM g JOIN s USING (tilt))
SELECT gy::INTEGER AS gy, gx::INTEGER AS gx, count(*) AS n, round(avg(u),6) u_mean FROM k WHERE gy BETWEEN 0 AND 5 AND gx BETWEEN 0 AND 11 GROUP BY gy, gx""")
def j04_i07_aligned_tilts(spark, sf_dir):
    """Grids of two tilts, cropped to their middle and joined by position."""
    rows = vector_obs(spark, sf_dir).select((F.col("realization") % 2).alias("tilt"), F.floor(F.col("cell") / 20).cast("int").alias("gy"), (F.col("cell") % 20).cast("int").alias("gx"), "u", "v")
    return ensemble.centre_crop(rows, ["tilt"], 6, 12).groupBy("gy", "gx").agg(F.count("*").alias("n"), F.round(F.avg("u"), 6).alias("u_mean"))


@query(f"WITH {VECTOR_OBS} SELECT cell, realization, round(l,6) AS length FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY l DESC, realization) AS k FROM (SELECT cell, realization, round(sqrt(u*u+v*v),9) AS l FROM obs WHERE u IS NOT NULL AND v IS NOT NULL)) WHERE k=1")
def t07_longest_vector(spark, sf_dir):
    """Of each cell the realization of the longest vector, the first of equals."""
    rows = vector_obs(spark, sf_dir).filter("u IS NOT NULL AND v IS NOT NULL").select("cell", "realization", F.round(magnitude("u", "v"), 9).alias("length"))
    return grids.first_wins(rows, ["cell"], F.col("length"), "realization").withColumn("length", F.round("length", 6))
