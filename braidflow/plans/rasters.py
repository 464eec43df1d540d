"""Queries on rasters, bands and change."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidflow.functions import columns as k
from braidflow.operators import grids
from braidflow.sources.standins import BANDS, RASTER, bands, raster

from .registry import query

IDX = """idx AS (SELECT *, (green-swir1)/nullif(green+swir1,0) AS mndwi, (nir-red)/nullif(nir+red,0) AS ndvi, green+red AS mbsrv, nir+swir1 AS mbsrn, blue+2.5*green-1.5*(nir+swir1)-0.25*swir2 AS awesh FROM bands),
tests AS (SELECT *, (CASE WHEN mndwi > 0.124 THEN 1 ELSE 0 END) + 10*(CASE WHEN mbsrv > mbsrn THEN 1 ELSE 0 END) + 100*(CASE WHEN awesh > 0 THEN 1 ELSE 0 END)
 + 1000*(CASE WHEN mndwi > -0.44 AND swir1 < 0.09 AND nir < 0.15 AND ndvi < 0.7 THEN 1 ELSE 0 END) + 10000*(CASE WHEN mndwi > -0.5 AND blue < 0.1 AND swir1 < 0.3 AND swir2 < 0.1 AND nir < 0.25 THEN 1 ELSE 0 END) AS code FROM idx),
classed AS (SELECT *, CASE WHEN code IN (1111,10111,11101,11110,11111) THEN 1 WHEN code IN (111,1011,1101,1110,10011,10101,10110,11001,11010,11100) THEN 2 WHEN code = 11000 THEN 3 WHEN code IN (11,101,110,1001,1010,1100,10000,10001,10010,10100) THEN 4 ELSE 0 END AS cls FROM tests)"""


@query(f"WITH {BANDS}, {IDX} SELECT px, year, round(mndwi,6) mndwi, round(ndvi,6) ndvi, round(mbsrv,6) mbsrv, round(mbsrn,6) mbsrn, round(awesh,6) awesh, code::INTEGER code, cls::INTEGER cls, (cls BETWEEN 1 AND 2)::INTEGER water2, (cls BETWEEN 1 AND 4)::INTEGER water4 FROM classed")
def p17_p20_surface_water(spark, sf_dir):
    b = ["blue", "green", "red", "nir", "swir1", "swir2"]
    rows = bands(spark, sf_dir).withColumn("code", k.surface_code(k.surface_tests(*b)))
    rows = rows.withColumn("cls", k.surface_class("code"))
    return rows.select("px", "year", *[F.round(x, 6).alias(n) for n, x in k.indices(*b).items()], "code", "cls", k.water_at("cls", 2).alias("water2"), k.water_at("cls", 4).alias("water4"))


@query(f"SELECT vec_id, {', '.join(f'round(20000*abs(embedding[{i}])::DOUBLE*0.0000275-0.2,6) AS {n}' for i, n in enumerate(('SR_B2', 'SR_B3', 'SR_B4', 'SR_B5', 'SR_B6', 'SR_B7'), 1))}, ((vec_id*7%32) & 24) = 0 AS clear, CASE WHEN 1980+vec_id%46 <= 1984 THEN 'L4' WHEN 1980+vec_id%46 <= 1999 THEN 'L5' WHEN 1980+vec_id%46 <= 2012 THEN 'L7' WHEN 1980+vec_id%46 <= 2021 THEN 'L8' ELSE 'L9' END AS sensor, CASE WHEN embedding[2]>0.1 THEN 255 ELSE 0 END AS mask, CASE WHEN embedding[3]>0 THEN 1 ELSE 0 END AS water FROM embeddings")
def p12_p16_scaling_and_masks(spark, sf_dir):
    """Reflectance, cloud bits, sensor by year, thresholds; older sensors' bands are renamed on the way."""
    e = F.col("embedding")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", *[(20000 * F.abs(e[i]).cast("double")).alias(n) for i, n in enumerate(k.OLDER_BANDS)], (F.col("vec_id") * 7 % 32).alias("qa"), (1980 + F.col("vec_id") % 46).alias("year"), e[1].cast("double").alias("x"), e[2].alias("w"))
    # All at once: new names are old ones of other bands.
    rows = rows.select(*[F.col(n).alias(k.OLDER_BANDS.get(n, n)) for n in rows.columns])
    return rows.select("vec_id", *[F.round(k.reflectance(n), 6).alias(n) for n in k.OLDER_BANDS.values()], k.clear_sky("qa").alias("clear"), k.sensor("year").alias("sensor"), k.threshold_mask("x", 0.1).alias("mask"), k.water("w").alias("water"))


@query(f"WITH {BANDS} SELECT px, year, round(quantile_cont(blue,0.5),6) blue, round(quantile_cont(nir,0.5),6) nir FROM bands WHERE (qa & 24) = 0 GROUP BY px, year")
def a24_s10_annual_composite(spark, sf_dir):
    out = grids.median_composite(bands(spark, sf_dir), ["px", "year"], ["blue", "nir"], k.clear_sky("qa"))
    return out.select("px", "year", F.round("blue", 6).alias("blue"), F.round("nir", 6).alias("nir"))


TWO = "a AS (SELECT r, c, water FROM ras WHERE layer='click'), b AS (SELECT r, c, water FROM ras WHERE layer='view'), o AS (SELECT coalesce(a.r,b.r) AS r, coalesce(a.c,b.c) AS c, coalesce(a.water,0) AS a, coalesce(b.water,0) AS b FROM a FULL JOIN b ON a.r=b.r AND a.c=b.c)"


def two_dates(spark, sf_dir):
    rows = raster(spark, sf_dir)
    return grids.overlay(rows.filter("layer = 'click'"), rows.filter("layer = 'view'"), "water")


@query(f"WITH {RASTER}, {TWO} SELECT r, c, (a>0 OR b>0) AS either, (a=0 AND b>0) AS gained, (a>0 AND b=0) AS lost, a<>b AS changed FROM o")
def j06_u01_overlay(spark, sf_dir):
    return grids.change(two_dates(spark, sf_dir)).select("r", "c", "either", "gained", "lost", "changed")


WET = "wet AS (SELECT layer, r, c FROM ras WHERE water = 1), d AS (SELECT unnest([0,1,-1,0,0]) AS i, unnest([0,0,0,1,-1]) AS j)"
OUTLINE = "q AS (SELECT layer, r-i AS r, c-j AS c, sum(b) AS k FROM wet, (SELECT unnest([0,0,1,1]) AS i, unnest([0,1,0,1]) AS j, unnest([1,2,4,8]) AS b) GROUP BY layer, r-i, c-j), ol AS (SELECT layer, sum(CASE WHEN k IN (1,2,4,8,7,11,13,14) THEN sqrt(0.5) WHEN k IN (6,9) THEN sqrt(2.0) WHEN k=15 THEN 0 ELSE 1 END) AS length FROM q GROUP BY layer)"


@query(f"WITH {RASTER}, {TWO}, {WET}, {OUTLINE} SELECT count(*) AS valid, count(*) FILTER (a=0 AND b>0) AS gained, count(*) FILTER (a>0 AND b=0) AS lost, round(count(*) FILTER (a<>b)*900/1e6,6) AS changed_km2, round(count(*) FILTER (a<>b)/count(*)::DOUBLE,6) AS changed_share, round(count(*) FILTER (a<>b)*900/((SELECT length FROM ol WHERE layer='click')*30),5) AS displacement FROM o")
def a25_change_statistics(spark, sf_dir):
    """Changed area, and as a displacement: by the length of the first date's banks."""
    rows = grids.change(two_dates(spark, sf_dir))
    bank = grids.outline_length(raster(spark, sf_dir).filter("layer = 'click' AND water = 1").select("layer", "r", "c"), ["layer"])
    out = rows.agg(F.count("*").alias("valid"), F.count_if("gained").alias("gained"), F.count_if("lost").alias("lost"), F.round(F.count_if("changed") * 900 / 1e6, 6).alias("changed_km2"), F.round(F.count_if("changed") / F.count("*"), 6).alias("changed_share"), F.count_if("changed").alias("changed"))
    return out.crossJoin(F.broadcast(bank.agg(F.sum("length").alias("bank")))).withColumn("displacement", F.round(F.col("changed") * 900 / F.nullif(F.col("bank") * 30, F.lit(0.0)), 5)).drop("changed", "bank")


@query(f"""WITH {RASTER}, {WET}, big AS (SELECT DISTINCT layer, r+i AS r, c+j AS c FROM wet, d), small AS (SELECT layer, r+i AS r, c+j AS c FROM wet, d GROUP BY ALL HAVING count(*)=5)
SELECT layer, r::INTEGER r, c::INTEGER c, s.r IS NULL AS edge FROM big LEFT JOIN small s USING (layer, r, c)""".replace("s.r IS NULL", "s.hit IS NULL").replace("FROM wet, d GROUP BY ALL HAVING count(*)=5)", "FROM wet, d GROUP BY layer, r+i, c+j HAVING count(*)=5), small2 AS (SELECT *, true AS hit FROM small)").replace("LEFT JOIN small s", "LEFT JOIN small2 s"))
def i08_dilate_erode_edge(spark, sf_dir):
    """Dilated water; the band between it and the eroded water is the edge."""
    wet = raster(spark, sf_dir).filter("water = 1").select("layer", "r", "c")
    core = grids.erode(wet, ["layer"]).withColumn("hit", F.lit(True))
    return grids.dilate(wet, ["layer"]).join(core, ["layer", "r", "c"], "left").select("layer", "r", "c", F.col("hit").isNull().alias("edge"))


@query(f"""WITH {RASTER}, {WET}, q AS (SELECT layer, r-i AS r, c-j AS c, sum(b) AS k FROM wet, (SELECT unnest([0,0,1,1]) AS i, unnest([0,1,0,1]) AS j, unnest([1,2,4,8]) AS b) GROUP BY layer, r-i, c-j)
SELECT layer, round(sum(CASE WHEN k IN (1,2,4,8,7,11,13,14) THEN sqrt(0.5) WHEN k IN (6,9) THEN sqrt(2.0) WHEN k=15 THEN 0 ELSE 1 END),6) AS length FROM q GROUP BY layer""")
def i09_outline_length(spark, sf_dir):
    wet = raster(spark, sf_dir).filter("water = 1").select("layer", "r", "c")
    return grids.outline_length(wet, ["layer"]).withColumn("length", F.round("length", 6))


@query(f"WITH {RASTER} SELECT layer, greatest(min(r)-2,0)::INTEGER r0, least(max(r)+2,30)::INTEGER r1, greatest(min(c)-2,0)::INTEGER c0, least(max(c)+2,23)::INTEGER c1 FROM ras WHERE water=1 GROUP BY layer")
def a32_i11_water_extent(spark, sf_dir):
    return grids.extent(raster(spark, sf_dir).filter("water = 1"), ["layer"], 2, 31, 24)


@query(f"WITH {RASTER}, g AS (SELECT r, c FROM (SELECT unnest(range(-2,6)) AS r), (SELECT unnest(range(20,27)) AS c)), l AS (SELECT DISTINCT layer FROM ras) SELECT layer, g.r::INTEGER AS r, g.c::INTEGER AS c, coalesce(water,0)::INTEGER AS water FROM l CROSS JOIN g LEFT JOIN ras USING (layer, r, c)")
def s02_window_read(spark, sf_dir):
    return grids.window_read(raster(spark, sf_dir), ["layer"], -2, 6, 20, 27, "water")


@query(f"WITH {RASTER} SELECT layer, round(avg(water),6) AS share FROM ras WHERE r BETWEEN 3 AND 20 AND c BETWEEN 4 AND 18 GROUP BY layer")
def a31_f10_water_fraction(spark, sf_dir):
    rows = raster(spark, sf_dir).filter(k.inside("c", "r", 4, 18, 3, 20))
    return rows.groupBy("layer").agg(F.round(F.avg("water"), 6).alias("share"))


@query(f"WITH {BANDS}, q AS (SELECT year, quantile_cont(red,0.02) lo, quantile_cont(red,0.98) hi FROM bands GROUP BY year) SELECT px, year, round(least(greatest((red-lo)/nullif(hi-lo,0),0),1),6) AS stretched, round(0.2126*red+0.7152*green+0.0722*blue,6) AS gray, round(0.4*red+0.6*(0.2126*red+0.7152*green+0.0722*blue),6) AS muted, (red+green+blue)/3 > 0.05 AS bright FROM bands JOIN q USING (year)")
def s03_p27_stretch_and_style(spark, sf_dir):
    rows = grids.percentile_stretch(bands(spark, sf_dir), ["year"], "red")
    gray = k.luma("red", "green", "blue")
    return rows.select("px", "year", F.round("stretched", 6).alias("stretched"), F.round(gray, 6).alias("gray"), F.round(k.desaturated("red", gray, 0.4), 6).alias("muted"), k.bright("red", "green", "blue", 0.05).alias("bright"))


@query(f"WITH {RASTER} SELECT 'nearest' AS how, layer, (r//4)::INTEGER r, (c//4)::INTEGER c, water::DOUBLE AS v FROM ras WHERE r%4=0 AND c%4=0 UNION ALL SELECT 'mean', layer, (r//4)::INTEGER, (c//4)::INTEGER, round(avg(water),6) FROM ras GROUP BY layer, r//4, c//4")
def s04_t08_downsample(spark, sf_dir):
    rows = raster(spark, sf_dir)
    one = grids.downsample(rows, ["layer"], 4, "water", True).select(F.lit("nearest").alias("how"), "layer", "r", "c", F.col("water").cast("double").alias("v"))
    return one.unionByName(grids.downsample(rows, ["layer"], 4, "water", False).select(F.lit("mean").alias("how"), "layer", "r", "c", F.round("water", 6).alias("v")))


def rotated_sql() -> str:
    parts = []
    for tilt in (0, 15, 30, 45):
        h, w, cos, sin = grids.turned(31, 24, tilt)
        y, x = f"(r-{(h - 1) / 2!r})", f"(c-{(w - 1) / 2!r})"
        parts.append(f"SELECT l.layer, {tilt} AS tilt, g.r, g.c, coalesce(CASE WHEN ras.water>0 THEN 255 ELSE 0 END,0)::INTEGER AS v FROM l CROSS JOIN (SELECT r::INTEGER AS r, c::INTEGER AS c, floor(round({y}*({cos!r})+{x}*({sin!r})+15.0,9)+0.5) AS sr, floor(round({x}*({cos!r})-{y}*({sin!r})+11.5,9)+0.5) AS sc FROM (SELECT unnest(range({h})) AS r), (SELECT unnest(range({w})) AS c)) g LEFT JOIN ras ON ras.layer=l.layer AND ras.r=g.sr AND ras.c=g.sc")
    return f"WITH {RASTER}, l AS (SELECT DISTINCT layer FROM ras) {' UNION ALL '.join(parts)}"


@query(rotated_sql())
def i01_i02_rotated_masks(spark, sf_dir):
    """Every mask at the tilts 0, 15, 30 and 45 degrees."""
    rows = raster(spark, sf_dir).select("layer", "r", "c", k.threshold_mask("water").alias("v"))
    out = None
    for tilt in (0, 15, 30, 45):
        turned = grids.rotated(rows, 31, 24, tilt, "v", ["layer"]).withColumn("tilt", F.lit(tilt))
        out = turned if out is None else out.unionByName(turned)
    return out


@query(f"""WITH {RASTER}, {TWO}, w AS (SELECT wr, wc FROM (SELECT unnest(range(0,7)) AS wr), (SELECT unnest(range(0,6)) AS wc)),
s AS (SELECT wr*5 AS r0, wc*4 AS c0, count(*) AS valid, count(*) FILTER (a<>b) AS changed FROM o JOIN w ON r BETWEEN wr*5 AND wr*5+9 AND c BETWEEN wc*4 AND wc*4+7 GROUP BY wr, wc)
SELECT r0, c0, valid, changed, changed::DOUBLE AS score FROM s WHERE valid >= 0.5*80 AND changed >= 3""")
def i10_f15_roi_candidates(spark, sf_dir):
    return grids.change_windows(two_dates(spark, sf_dir), 10, 8, 5, 4, 0.5, 3)


@query(f"""WITH {RASTER}, {TWO}, w AS (SELECT wr, wc FROM (SELECT unnest(range(0,7)) AS wr), (SELECT unnest(range(0,6)) AS wc)),
s AS (SELECT wr*5 AS r0, wc*4 AS c0, count(*) AS valid, count(*) FILTER (a<>b) AS changed FROM o JOIN w ON r BETWEEN wr*5 AND wr*5+9 AND c BETWEEN wc*4 AND wc*4+7 GROUP BY wr, wc),
v AS (SELECT vec_id%31 AS r, vec_id//31%24 AS c, sqrt(embedding[1]::DOUBLE*embedding[1]::DOUBLE+embedding[2]::DOUBLE*embedding[2]::DOUBLE) AS m FROM embeddings),
p AS (SELECT wr*5 AS r0, wc*4 AS c0, quantile_cont(m,0.9) AS p90 FROM v JOIN w ON r BETWEEN wr*5 AND wr*5+9 AND c BETWEEN wc*4 AND wc*4+7 GROUP BY wr, wc),
t AS (SELECT s.*, p90/(SELECT quantile_cont(m,0.9) FROM v) AS ratio FROM s LEFT JOIN p USING (r0, c0) WHERE valid >= 40 AND changed >= 3)
SELECT r0, c0, valid, changed, round(changed/(1+0.8*greatest(coalesce(ratio,1)-1,0)),6) AS score, round(ratio,6) AS ratio FROM t WHERE ratio IS NULL OR ratio <= 1.9""")
def i10_f15_moderated_candidates(spark, sf_dir):
    """Windows of change, those of extreme displacement left out or marked down."""
    e = F.col("embedding")
    x, y = e[0].cast("double"), e[1].cast("double")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("vec_id") % 31).alias("r"), (F.floor(F.col("vec_id") / 31) % 24).alias("c"), F.sqrt(x * x + y * y).alias("m"))
    out = grids.moderated(grids.change_windows(two_dates(spark, sf_dir), 10, 8, 5, 4, 0.5, 3), vectors, 10, 8, 5, 4)
    return out.select("r0", "c0", "valid", "changed", F.round("score", 6).alias("score"), F.round("ratio", 6).alias("ratio"))


@query(f"""WITH RECURSIVE {RASTER}, {TWO}, w AS (SELECT wr, wc FROM (SELECT unnest(range(0,7)) AS wr), (SELECT unnest(range(0,6)) AS wc)),
s AS (SELECT wr*5 AS r0, wc*4 AS c0, count(*) AS valid, count(*) FILTER (a<>b) AS changed FROM o JOIN w ON r BETWEEN wr*5 AND wr*5+9 AND c BETWEEN wc*4 AND wc*4+7 GROUP BY wr, wc), v AS (SELECT * FROM s WHERE valid >= 40 AND changed >= 1),
g AS (SELECT 0 AS k, NULL::BIGINT AS r0, NULL::BIGINT AS c0, NULL::BIGINT AS changed, []::BIGINT[] AS rs, []::BIGINT[] AS cs
 UNION ALL SELECT k, r0, c0, changed, rs, cs FROM (SELECT g.k+1 AS k, v.r0, v.c0, v.changed, list_append(g.rs, v.r0) AS rs, list_append(g.cs, v.c0) AS cs, row_number() OVER (ORDER BY v.changed DESC, v.r0, v.c0) AS n
   FROM g, v WHERE g.k < 3 AND len(list_filter(list_zip(g.rs, g.cs), lambda z: (z[1]-v.r0)*(z[1]-v.r0)+(z[2]-v.c0)*(z[2]-v.c0) < 64)) = 0) WHERE n=1)
SELECT r0, c0, changed FROM g WHERE k > 0""")
def t05_separated_rois(spark, sf_dir):
    """The three best windows at least eight pixels apart."""
    rows = grids.separated_top(grids.change_windows(two_dates(spark, sf_dir), 10, 8, 5, 4, 0.5, 1), 3, 8.0)
    return spark.createDataFrame([(w["r0"], w["c0"], w["changed"]) for w in rows], "r0 long, c0 long, changed long")
