"""Queries on samples along curves: geometry, gaps, widths, spectra, correlations, link summaries and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidflow.operators import curves, regression
from braidflow.sources.standins import PROFILE, RASTER, XY, profile, raster, table, xy

from .registry import query

R6 = lambda *names: {n: F.round(n, 6) for n in names}
GRAD = "CASE WHEN {0} IS NULL THEN 0 END"


def grad(v: str) -> str:
    return f"CASE WHEN lag({v}) OVER v IS NULL AND lead({v}) OVER v IS NULL THEN 0 WHEN lag({v}) OVER v IS NULL THEN lead({v}) OVER v - {v} WHEN lead({v}) OVER v IS NULL THEN {v} - lag({v}) OVER v ELSE (lead({v}) OVER v - lag({v}) OVER v)/2 END"


OVER = "WINDOW v AS (PARTITION BY link ORDER BY i)"


@query(f"WITH {PROFILE}, g AS (SELECT *, {grad('x')} AS gx, {grad('y')} AS gy FROM prof {OVER}) SELECT link, i, round(s,6) s, round(gx/coalesce(nullif(sqrt(gx*gx+gy*gy),0),1),6) tx, round(gy/coalesce(nullif(sqrt(gx*gx+gy*gy),0),1),6) ty, round(-gx/coalesce(nullif(sqrt(gx*gx+gy*gy),0),1),6) ny FROM g")
def w02_w03_tangents(spark, sf_dir):
    rows = curves.tangents(profile(spark, sf_dir), ["link"])
    return rows.withColumns(R6("s", "tx", "ty", "ny")).select("link", "i", "s", "tx", "ty", "ny")


CURV = f"""g AS (SELECT *, {grad('x')} AS gx, {grad('y')} AS gy FROM prof {OVER}), t AS (SELECT *, atan2(gy,gx) AS t FROM g),
j AS (SELECT *, coalesce(-2*pi()*round_even((t-lag(t) OVER v)/(2*pi()),0),0) AS jump FROM t {OVER}), u AS (SELECT *, t + sum(jump) OVER (PARTITION BY link ORDER BY i ROWS UNBOUNDED PRECEDING) AS u FROM j),
h AS (SELECT *, lag(u) OVER v AS f0, lead(u) OVER v AS f2, s-lag(s) OVER v AS hs, lead(s) OVER v - s AS hd FROM u {OVER}),
curv AS (SELECT link, i, s, b, m, CASE WHEN f0 IS NULL THEN (f2-u)/nullif(hd,0) WHEN f2 IS NULL THEN (u-f0)/nullif(hs,0) ELSE (hs*hs*f2+(hd*hd-hs*hs)*u-hd*hd*f0)/nullif(hs*hd*(hs+hd),0) END AS c FROM h)"""


@query(f"WITH {PROFILE}, {CURV} SELECT link, i, round(c,5)+0.0 c FROM curv")
def w04_curvature(spark, sf_dir):
    return curves.curvature(profile(spark, sf_dir), ["link"]).select("link", "i", (F.round("c", 5) + 0.0).alias("c"))


@query(f"""WITH {PROFILE}, z AS (SELECT *, last_value(b IGNORE NULLS) OVER (PARTITION BY link ORDER BY i ROWS UNBOUNDED PRECEDING) v0, first_value(b IGNORE NULLS) OVER (PARTITION BY link ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) v1,
last_value(CASE WHEN b IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY link ORDER BY i ROWS UNBOUNDED PRECEDING) i0, first_value(CASE WHEN b IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY link ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) i1 FROM prof),
f AS (SELECT link, i, coalesce(b, v0+(v1-v0)*(i-i0)/nullif(i1-i0,0)::DOUBLE, v0, v1, 0) AS b FROM z)
SELECT link, i, round(b,6) b, round(sum(b) OVER (PARTITION BY link ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)/5,6) AS odd, round(sum(b) OVER (PARTITION BY link ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)/4,6) AS even FROM f""")
def w06_w07_fill_and_smooth(spark, sf_dir):
    rows = curves.filled(profile(spark, sf_dir), ["link"], "b")
    return rows.select("link", "i", F.round("b", 6).alias("b"), F.round(curves.moving_average("b", ["link"], 5), 6).alias("odd"), F.round(curves.moving_average("b", ["link"], 4), 6).alias("even"))


@query(f"WITH {PROFILE}, d AS (SELECT link, s - lag(s) OVER v AS d FROM prof {OVER}) SELECT link, round(quantile_cont(d,0.5),6) AS step FROM d GROUP BY link")
def w08_step_estimate(spark, sf_dir):
    return curves.step_estimate(profile(spark, sf_dir), ["link"]).withColumns(R6("step"))


@query(f"""WITH {PROFILE}, q AS (SELECT *, s AS s0, lead(s) OVER v AS s1, lead(x) OVER v AS x1, lead(y) OVER v AS y1 FROM prof {OVER}), t AS (SELECT *, max(s) OVER (PARTITION BY link) AS total FROM q),
n AS (SELECT *, greatest(ceil(total/40.0), 2) AS n FROM t), g AS (SELECT *, unnest(range(0, n::BIGINT+1)) AS k FROM n),
f AS (SELECT link, k, k*total/n AS s, s0, s1, x, x1, y, y1, n, row_number() OVER (PARTITION BY link, k ORDER BY s0 DESC) AS o FROM g WHERE s1 > s0 AND round(k*total/n,7) >= round(s0,7) AND (round(k*total/n,7) < round(s1,7) OR k = n))
SELECT link, k, round(s,5) s, round(x+least(greatest((s-s0)/(s1-s0),0),1)*(x1-x),5) x, round(y+least(greatest((s-s0)/(s1-s0),0),1)*(y1-y),5) y FROM f WHERE o = 1""")
def w01_f17_densify(spark, sf_dir):
    rows = profile(spark, sf_dir).select("link", "i", "x", "y")
    rows = curves.densified(curves.without_duplicates(rows, ["link"]), ["link"], 40.0)
    return rows.select("link", "k", F.round("s", 5).alias("s"), F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(f"""WITH {RASTER}, z AS (SELECT *, row_number() OVER (PARTITION BY layer, r ORDER BY c) - sum(water) OVER (PARTITION BY layer, r ORDER BY c) AS g FROM ras), runs AS (SELECT layer, r, g, count(*) n, min(c) st, max(c)-min(c) width FROM z WHERE water=1 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY layer, r ORDER BY n DESC, st) AS k FROM runs) SELECT layer, r, nullif(width::DOUBLE,0) AS width FROM b WHERE k=1""")
def w05_longest_water_run(spark, sf_dir):
    rows = raster(spark, sf_dir).withColumn("flag", F.col("water") == 1)
    return curves.longest_run(rows, ["layer", "r"], "flag", "c", "c")


@query(f"""WITH {RASTER}, t AS (SELECT l.layer, p.id, unnest(range(-6,7)) AS o FROM (SELECT DISTINCT layer FROM ras) l, (SELECT unnest(range(2,28,5)) AS id) p), s AS (SELECT t.layer, t.id, t.o, coalesce(ras.water,0) AS water FROM t LEFT JOIN ras ON ras.layer=t.layer AND ras.r=floor(t.id+0.5*t.o) AND ras.c=floor(12+0.8*t.o)),
q AS (SELECT layer, id, avg(water) AS frac FROM s GROUP BY ALL HAVING avg(water) >= 0.05) SELECT layer, id, round(frac,6) AS frac FROM q""")
def j02_f08_transect_lookup(spark, sf_dir):
    """Water along transects of a mask, outside of which is land; transects with little water are left out."""
    water = raster(spark, sf_dir)
    rows = water.select("layer").distinct().crossJoin(spark.range(2, 28, 5)).withColumn("o", F.explode(F.sequence(F.lit(-6), F.lit(6))))
    rows = rows.withColumn("r", F.floor(F.col("id") + 0.5 * F.col("o")).cast("int")).withColumn("c", F.floor(12 + 0.8 * F.col("o")).cast("int"))
    rows = rows.join(water, ["layer", "r", "c"], "left").groupBy("layer", "id").agg(F.avg(F.coalesce("water", F.lit(0))).alias("frac"))
    return rows.filter("frac >= 0.05").select("layer", "id", F.round("frac", 6).alias("frac"))


SUMMARY = """SELECT link, round(max(s)-min(s),5) arc_length, count(*) n_samples, round(count(b)/count(*)::DOUBLE,6) valid_b, round(count(m)/count(*)::DOUBLE,6) valid_m, round(count(c)/count(*)::DOUBLE,6) valid_c, round(avg(b),6) mean_b, round(quantile_cont(b,0.5),6) median_b, round(stddev_pop(b),6) std_b,
round(avg(m),6) mean_m, round(quantile_cont(m,0.5),6) median_m, round(stddev_pop(m),6) std_m, round(avg(abs(m)),6) mean_abs_m, round(max(abs(m)),6) max_abs_m, round(count(*) FILTER (m>0)/nullif(count(m),0)::DOUBLE,6) pos_m, round(avg(abs(c)),5) mean_abs_c, round(quantile_cont(abs(c),0.5),5) median_abs_c FROM curv GROUP BY link"""
NAMES = ["valid_b", "valid_m", "valid_c", "mean_b", "median_b", "std_b", "mean_m", "median_m", "std_m", "mean_abs_m", "max_abs_m", "pos_m"]


@query(f"WITH {PROFILE}, {CURV} {SUMMARY}")
def a07_a08_link_summary(spark, sf_dir):
    rows = curves.link_summary(curves.curvature(profile(spark, sf_dir), ["link"]), "link")
    return rows.withColumns(R6(*NAMES) | {n: F.round(n, 5) for n in ("arc_length", "mean_abs_c", "median_abs_c")})


@query(f"WITH {PROFILE}, s AS (SELECT link, max(s)-min(s) AS arc, count(*) AS n FROM prof GROUP BY link HAVING count(*) >= 20 AND max(s)-min(s) >= 200) SELECT c_custkey, round(arc,5) AS arc, n FROM customer LEFT JOIN s ON link = c_custkey")
def j08_f04_f05_stats_to_links(spark, sf_dir):
    """A left join of link statistics to the link table, after the least samples and length."""
    stats = profile(spark, sf_dir).groupBy("link").agg((F.max("s") - F.min("s")).alias("arc"), F.count("*").alias("n")).filter("n >= 20 AND arc >= 200")
    links = table(spark, sf_dir, "customer").select("c_custkey")
    return links.join(stats, F.col("c_custkey").cast("string") == F.col("link").cast("string"), "left").select("c_custkey", F.round("arc", 5).alias("arc"), "n")


Z = "z AS (SELECT link, row_number() OVER (PARTITION BY link ORDER BY i)-1 AS j, count(*) OVER (PARTITION BY link) AS n, b-avg(b) OVER (PARTITION BY link) AS v FROM prof WHERE b IS NOT NULL)"
DFT = f"{Z}, k AS (SELECT *, unnest(range(1, n//2+1)) AS k FROM z WHERE n >= 4), sp0 AS (SELECT link, n, k, sum(v*cos(2*pi()*k*j/n)) re, -sum(v*sin(2*pi()*k*j/n)) im FROM k GROUP BY ALL), sp AS (SELECT *, sqrt(re*re+im*im) AS amp, max(sqrt(re*re+im*im)) OVER (PARTITION BY link) AS top FROM sp0)"


@query(f"WITH {PROFILE}, {DFT} SELECT link, k, round(amp,4) AS amp, round(atan2(CASE WHEN abs(im)>1e-9*top THEN im ELSE 0 END, CASE WHEN abs(re)>1e-9*top THEN re ELSE 0 END),3)+0.0 AS phase, round(amp/nullif(top,0),6) AS share FROM sp")
def q01_spectrum(spark, sf_dir):
    return curves.spectrum(profile(spark, sf_dir), "link", "b").select("link", "k", F.round("amp", 4).alias("amp"), (F.round("phase", 3) + 0.0).alias("phase"), F.round("share", 6).alias("share"))


@query(f"""WITH {PROFILE}, {DFT}, t AS (SELECT link, k, n/k::DOUBLE AS wavelength, amp/nullif(top,0) AS share, row_number() OVER (PARTITION BY link ORDER BY round(amp,9) DESC, k) AS o FROM sp WHERE n/k::DOUBLE <= 0.9*n)
SELECT link, k, round(wavelength,6) wavelength FROM t WHERE o=1""")
def q02_q03_f12_dominant_wavelength(spark, sf_dir):
    """Of wavelengths up to nine tenths of the curve."""
    sp = curves.spectrum(profile(spark, sf_dir), "link", "b")
    return curves.dominant(sp, ["link"], 1.0, 0.9 * F.col("n")).select("link", F.col("k").cast("long").alias("k"), F.round("wavelength", 6).alias("wavelength"))


LAG = "y AS (SELECT link, row_number() OVER (PARTITION BY link ORDER BY i) AS j, count(*) OVER (PARTITION BY link) AS n, b-avg(b) OVER (PARTITION BY link) AS x, m-avg(m) OVER (PARTITION BY link) AS y FROM prof WHERE b IS NOT NULL AND m IS NOT NULL), nn AS (SELECT link, sqrt(sum(x*x)*sum(y*y)) AS norm FROM y GROUP BY link), ccf AS (SELECT a.link, a.j-c.j AS lag, sum(a.x*c.y)/nullif(any_value(norm),0) AS r FROM y a JOIN y c ON a.link=c.link JOIN nn ON nn.link=a.link WHERE a.n >= 4 GROUP BY ALL)"


@query(f"WITH {PROFILE}, {LAG} SELECT link, lag, round(r,6) AS r FROM ccf")
def q07_f13_correlation_curves(spark, sf_dir):
    return curves.lag_correlation(profile(spark, sf_dir), "link", "b", "m").select("link", "lag", F.round("r", 6).alias("r"))


@query(f"WITH {PROFILE}, {LAG}, o AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY round(r,9) DESC, lag) AS k FROM ccf WHERE r IS NOT NULL) SELECT link, lag, round(r,6) AS r FROM o WHERE k=1")
def q05_best_lag(spark, sf_dir):
    rows = curves.lag_correlation(profile(spark, sf_dir), "link", "b", "m").filter("r IS NOT NULL")
    return curves.best_lag(rows, ["link"]).select("link", F.col("lag").cast("long").alias("lag"), F.round("r", 6).alias("r"))


@query(f"""WITH {PROFILE}, y AS (SELECT link, row_number() OVER (PARTITION BY link ORDER BY i) AS j, count(*) OVER (PARTITION BY link) AS n, m-avg(m) OVER (PARTITION BY link) AS x FROM prof), nn AS (SELECT link, sum(x*x) AS norm FROM y GROUP BY link),
acf AS (SELECT a.link, a.j-c.j AS lag, sum(a.x*c.x)/nullif(any_value(norm),0) AS r FROM y a JOIN y c ON a.link=c.link AND a.j >= c.j JOIN nn ON nn.link=a.link WHERE a.n >= 4 GROUP BY ALL),
k AS (SELECT link, min(lag) FILTER (r <= exp(-1)) AS folding, min(lag) FILTER (r < 0) AS zero, max(lag) AS l FROM acf GROUP BY link)
SELECT link, any_value(folding) AS folding, round(sum(r) FILTER (lag >= 1 AND lag < coalesce(zero, l+1)),6) AS integral FROM acf JOIN k USING (link) GROUP BY link""")
def q06_correlation_lengths(spark, sf_dir):
    acf = curves.lag_correlation(profile(spark, sf_dir), "link", "m", "m")
    return curves.correlation_lengths(acf, ["link"]).select("link", F.col("folding").cast("long").alias("folding"), F.round("integral", 6).alias("integral"))


@query(f"WITH {XY} SELECT g, round(quantile_cont(x,0),6) q0, round(quantile_cont(x,0.05),6) q5, round(quantile_cont(y,0.25),6) q25, round(quantile_cont(y,0.5),6) q50, round(quantile_cont(y,0.95),6) q95 FROM xy GROUP BY g")
def a14_percentiles(spark, sf_dir):
    q = lambda c, p: F.round(F.expr(f"percentile({c}, {p})"), 6)
    return xy(spark, sf_dir).groupBy("g").agg(q("x", 0).alias("q0"), q("x", 0.05).alias("q5"), q("y", 0.25).alias("q25"), q("y", 0.5).alias("q50"), q("y", 0.95).alias("q95"))


def binned_sql(v: str) -> str:
    return f"""WITH {XY}, b AS (SELECT g, min({v}) lo, max({v}) hi FROM xy GROUP BY g), k AS (SELECT g, least(coalesce(floor(round(({v}-lo)/nullif(hi-lo,0)*12,9)),0),11)::INTEGER AS bin, y FROM xy JOIN b USING (g))
SELECT g, bin, count(*) AS n, round(CASE WHEN count(*)>=5 THEN avg(y) END,4) AS mean, round(CASE WHEN count(*)>=5 THEN quantile_cont(y,0.25) END,4) AS p25, round(CASE WHEN count(*)>=5 THEN quantile_cont(y,0.75) END,4) AS p75 FROM k GROUP BY g, bin"""


@query(binned_sql("x::DOUBLE"))
def a15_binned_statistics(spark, sf_dir):
    return regression.binned(xy(spark, sf_dir), ["g"], "x", "y", 12).withColumns({c: F.round(c, 4) for c in ("mean", "p25", "p75")})


@query(binned_sql("log10(x)"))
def a16_log_bins(spark, sf_dir):
    return regression.binned(xy(spark, sf_dir), ["g"], "x", "y", 12, log=True).withColumns({c: F.round(c, 4) for c in ("mean", "p25", "p75")})


@query(f"""WITH {XY}, q AS (SELECT quantile_cont(x,0.02)::DOUBLE AS lo, quantile_cont(x,0.98)::DOUBLE AS hi, max(x)::DOUBLE AS top FROM xy), b AS (SELECT lo, CASE WHEN hi>lo THEN hi WHEN top>lo THEN top ELSE lo*1.01 END AS hi FROM q),
k AS (SELECT g, least(coalesce(floor(round((log10(x)-log10(lo))/nullif(log10(hi)-log10(lo),0)*12,9)),0),11)::INTEGER AS bin, y FROM xy, b WHERE x BETWEEN lo AND hi)
SELECT g, bin, count(*) AS n, round(CASE WHEN count(*)>=5 THEN avg(y) END,4) AS mean, round(CASE WHEN count(*)>=5 THEN quantile_cont(y,0.25) END,4) AS p25, round(CASE WHEN count(*)>=5 THEN quantile_cont(y,0.75) END,4) AS p75 FROM k GROUP BY g, bin""")
def a16_u03_pooled_clipped_bins(spark, sf_dir):
    """Bins by logarithm between the 2nd and the 98th percentile of x over all groups together."""
    return regression.binned(xy(spark, sf_dir), ["g"], "x", "y", 12, log=True, clip=(0.02, 0.98), pooled=True).withColumns({c: F.round(c, 4) for c in ("mean", "p25", "p75")})


@query(f"WITH {XY} SELECT g, count(*) AS n, round(regr_slope(y,x),4) AS slope, round(regr_intercept(y,x),4) AS intercept, round(regr_r2(y,x),6) AS r2 FROM xy GROUP BY g")
def a17_a20_linear_fit(spark, sf_dir):
    return regression.linear(xy(spark, sf_dir), ["g"], "x", "y").select("g", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query(f"WITH {XY} SELECT g, count(*) AS n, round(sum(x*y)/sum(x*x),4) AS slope, round(1-(sum(y*y)-2*sum(x*y)/sum(x*x)*sum(x*y)+pow(sum(x*y)/sum(x*x),2)*sum(x*x))/(var_pop(y)*count(*)),6) AS r2 FROM xy GROUP BY g")
def a17_through_origin(spark, sf_dir):
    return regression.through_origin(xy(spark, sf_dir), ["g"], "x", "y").select("g", "n", F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2"))


@query(f"WITH {XY}, f AS (SELECT g, count(*) n, exp(regr_intercept(ln(y),ln(x))) a, regr_slope(ln(y),ln(x)) b, avg(y) my FROM xy WHERE x>0 AND y>0 GROUP BY g) SELECT g, any_value(n) AS n, round(any_value(a),4) a, round(any_value(b),6) b, round(1-sum(pow(y-a*pow(x,b),2))/sum(pow(y-my,2)),6) AS r2 FROM xy JOIN f USING (g) WHERE x>0 AND y>0 GROUP BY g")
def a18_f03_power_law(spark, sf_dir):
    return regression.power_law(xy(spark, sf_dir), ["g"], "x", "y").select("g", "n", F.round("a", 4).alias("a"), F.round("b", 6).alias("b"), F.round("r2", 6).alias("r2"))


@query()
def a19_a21_curvature_fit(spark, sf_dir):
    return regression.curvature_fit(xy(spark, sf_dir), "g", "x", "y")


LEVEL = """l AS (SELECT link, avg(abs(m)) AS am, avg(b) AS mb, avg(abs(c)) AS ac FROM curv GROUP BY link),
pw AS (SELECT count(*) AS n, exp(regr_intercept(ln(am),ln(ac))) AS a, regr_slope(ln(am),ln(ac)) AS e, avg(am) AS my FROM l WHERE ac>0 AND am>0)"""


@query(f"""WITH {PROFILE}, {CURV}, {LEVEL} SELECT 'B linear' AS model, regr_count(am,mb) AS n, round(regr_slope(am,mb),6) AS a, round(regr_intercept(am,mb),5) AS b, round(regr_r2(am,mb),6) AS r2 FROM l
UNION ALL SELECT 'C linear', regr_count(am,ac), round(regr_slope(am,ac),5), round(regr_intercept(am,ac),5), round(regr_r2(am,ac),6) FROM l
UNION ALL SELECT 'C power', any_value(n), round(any_value(a),5), round(any_value(e),6), round(1-sum(pow(am-a*pow(ac,e),2))/sum(pow(am-my,2)),6) FROM l, pw WHERE ac>0 AND am>0""")
def a22_a23_link_level_fit(spark, sf_dir):
    """Links' mean migration by width and by curvature, by lines, and by a power of curvature."""
    rows = curves.link_summary(curves.curvature(profile(spark, sf_dir), ["link"]), "link").withColumn("all", F.lit(1))
    line = lambda x, model, d: regression.linear(rows, ["all"], x, "mean_abs_m").select(F.lit(model).alias("model"), "n", F.round("slope", d).alias("a"), F.round("intercept", 5).alias("b"), F.round("r2", 6).alias("r2"))
    power = regression.power_law(rows, ["all"], "mean_abs_c", "mean_abs_m").select(F.lit("C power").alias("model"), "n", F.round("a", 5).alias("a"), F.round("b", 6).alias("b"), F.round("r2", 6).alias("r2"))
    return line("mean_b", "B linear", 6).unionByName(line("mean_abs_c", "C linear", 5)).unionByName(power)


@query(f"""WITH {PROFILE}, {CURV}, v AS (SELECT abs(c) AS c, abs(m) AS m FROM curv WHERE c IS NOT NULL AND m IS NOT NULL), pw AS (SELECT count(*) AS n, exp(regr_intercept(ln(m),ln(c))) AS a, regr_slope(ln(m),ln(c)) AS e, avg(m) AS my FROM v WHERE c>0 AND m>0)
SELECT (SELECT count(*) FROM curv) AS n_total, count(*) AS n_valid, count(*) FILTER (c>0 AND m>0) AS n_power, count(*) FILTER (c>0) AS n_c, count(*) FILTER (m>0) AS n_m, round(regr_slope(m,c),5) AS slope, round(regr_intercept(m,c),5) AS intercept, round(regr_r2(m,c),6) AS r2,
round((SELECT a FROM pw),5) AS power_a, round((SELECT e FROM pw),6) AS power_b, round((SELECT 1-sum(pow(m-a*pow(c,e),2))/sum(pow(m-my,2)) FROM v, pw WHERE c>0 AND m>0),6) AS power_r2, round(quantile_cont(c,0.05),5) AS c5, round(quantile_cont(c,0.5),5) AS c50, round(quantile_cont(c,0.95),5) AS c95, round(quantile_cont(m,0.5),5) AS m50, round(max(m),5) AS m100 FROM v""")
def a21_global_relationships(spark, sf_dir):
    """All samples together: migration by curvature, by a line and a power, how many samples either uses, and percentiles."""
    every = curves.curvature(profile(spark, sf_dir), ["link"]).select(F.abs("c").alias("c"), F.abs("m").alias("m"), F.lit(1).alias("all"))
    rows = every.filter("c IS NOT NULL AND m IS NOT NULL")
    q = lambda c, p: F.round(F.expr(f"percentile({c}, {p})"), 5)
    counts = every.groupBy("all").agg(F.count("*").alias("n_total"))
    some = rows.groupBy("all").agg(F.count("*").alias("n_valid"), F.count_if((F.col("c") > 0) & (F.col("m") > 0)).alias("n_power"), F.count_if(F.col("c") > 0).alias("n_c"), F.count_if(F.col("m") > 0).alias("n_m"), q("c", 0.05).alias("c5"), q("c", 0.5).alias("c50"), q("c", 0.95).alias("c95"), q("m", 0.5).alias("m50"), F.round(F.max("m"), 5).alias("m100"))
    line = regression.linear(rows, ["all"], "c", "m").select("all", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("r2", 6).alias("r2"))
    power = regression.power_law(rows, ["all"], "c", "m").select("all", F.round("a", 5).alias("power_a"), F.round("b", 6).alias("power_b"), F.round("r2", 6).alias("power_r2"))
    return counts.join(some, "all").join(line, "all").join(power, "all").drop("all")


@query(f"WITH {XY} SELECT g, round(avg(30*(x/25)*exp(1-x/25)),6) AS curve, round(avg(abs(x/1e3)*y),4) AS dimless, round_even(avg(y), 2) AS report FROM xy GROUP BY g")
def p23_p25_p32_curve_and_report(spark, sf_dir):
    from braidflow.functions.columns import hickin_nanson, rounded

    return xy(spark, sf_dir).groupBy("g").agg(F.round(F.avg(hickin_nanson("x", 30.0, 25.0)), 6).alias("curve"), F.round(F.avg(F.abs(F.col("x") / 1e3) * F.col("y")), 4).alias("dimless"), rounded(F.avg("y"), 2).alias("report"))
