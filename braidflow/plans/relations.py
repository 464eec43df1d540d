"""Queries on names, catalogues and sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from braidflow.functions import columns as k
from braidflow.operators.curves import sparse_by
from braidflow.sources import catalogue
from braidflow.sources.standins import POINTS, RASTER, points, raster, table

from .registry import query

FILES = "files AS (SELECT s_nationkey AS site, 'site' || s_nationkey || '_' || (1985+s_suppkey%40) || '_01-01_12-31_mask' || (1+s_suppkey%4) || '.tif' AS file, 1985+s_suppkey%40 AS year FROM supplier)"


def files(spark, sf_dir):
    year = F.col("s_suppkey") % 40 + 1985
    name = F.concat(F.lit("site"), "s_nationkey", F.lit("_"), year, F.lit("_01-01_12-31_mask"), F.col("s_suppkey") % 4 + 1, F.lit(".tif"))
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("site"), name.alias("file"), year.alias("year"))


@query(f"WITH {FILES} SELECT site, file, year::INTEGER AS token_year, year::INTEGER AS regex_year FROM files")
def p11_years_of_names(spark, sf_dir):
    return files(spark, sf_dir).select("site", "file", k.year_of_tokens("file").alias("token_year"), k.year_between_underscores("file").alias("regex_year"))


@query(f"WITH {FILES} SELECT site, count(DISTINCT year) AS years, min(year) AS \"first\", max(year) AS \"last\", array_to_string(list_sort(list(DISTINCT year)), ',') AS list FROM files GROUP BY site")
def s05_a30_u02_metadata(spark, sf_dir):
    """Years of each site's files, without repeats."""
    return files(spark, sf_dir).groupBy("site").agg(F.countDistinct("year").alias("years"), F.min("year").alias("first"), F.max("year").alias("last"), F.array_join(F.sort_array(F.collect_set("year")), ",").alias("list"))


@query(f"WITH {FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY CASE WHEN year=2000 THEN 0 ELSE 1 END, CASE WHEN file LIKE '%mask.tif' THEN 0 WHEN file LIKE '%mask2.tif' THEN 1 ELSE 2 END, file) AS k FROM files) SELECT site, file FROM r WHERE k=1")
def s13_t01_reference_raster(spark, sf_dir):
    return catalogue.reference_raster(files(spark, sf_dir), "site", "file", "year", 2000, 2)


@query(f"WITH {FILES}, y AS (SELECT site, year, lag(year) OVER (PARTITION BY site ORDER BY year) AS p FROM files) SELECT site, round(coalesce(avg(year-p),1.0),6) AS dt FROM y GROUP BY site")
def p10_mean_step_of_pairs(spark, sf_dir):
    return catalogue.mean_step(files(spark, sf_dir), "site", "file").withColumn("dt", F.round("dt", 6))


@query(f"WITH {FILES} SELECT f.site, f.file, n.n_name IS NOT NULL AS known FROM files f LEFT JOIN nation n ON n.n_nationkey = f.site AND n.n_regionkey < 3")
def j14_availability(spark, sf_dir):
    """What is wanted and there, and what is wanted and missing: a semi and an anti join."""
    wanted = files(spark, sf_dir)
    there = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("site"))
    one = wanted.join(there, "site", "left_semi").withColumn("known", F.lit(True))
    return one.unionByName(wanted.join(there, "site", "left_anti").withColumn("known", F.lit(False))).select("site", "file", "known")


@query("SELECT CASE n WHEN 'YR-A' THEN 'HuangHe-A' WHEN 'YR-B' THEN 'HuangHe-B' WHEN 'Jurua' THEN 'Jurua-A' ELSE n END AS site, count(*) AS n FROM (SELECT CASE s_suppkey%4 WHEN 0 THEN 'YR-A' WHEN 1 THEN 'YR-B' WHEN 2 THEN 'Jurua' ELSE 'Other' END AS n FROM supplier) GROUP BY 1")
def s12_site_aliases(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("YR-A", "YR-B", "Jurua", "Other"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").groupBy(k.site_name(name).alias("site")).agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {FILES}, y AS (SELECT DISTINCT site, year FROM files), b AS (SELECT site, min(year) AS lo, max(year) AS hi, count(*) AS n, greatest((max(year)-min(year))/2.0, 3) AS st FROM y GROUP BY site),
c AS (SELECT site, lo AS year, 1 AS k FROM b WHERE n > 3 UNION ALL SELECT site, year, k FROM (SELECT c.site, y.year, c.k+1 AS k, row_number() OVER (PARTITION BY c.site ORDER BY abs(y.year-c.year-b.st), y.year) AS o FROM c JOIN b ON b.site=c.site JOIN y ON y.site=c.site AND y.year>c.year WHERE c.k < 2 AND c.year < b.hi) WHERE o=1)
SELECT site, year FROM c UNION SELECT site, hi FROM b UNION SELECT site, year FROM y JOIN b USING (site) WHERE n <= 3""")
def w10_j13_sparse_years(spark, sf_dir):
    """At most three years of each site, about evenly apart."""
    return sparse_by(files(spark, sf_dir).withColumn("year", F.col("year").cast("long")), "site", "year", 3)


@query("WITH l AS (SELECT vec_id, unnest([embedding[1:8], embedding[9:16]]) AS part, unnest([0,1]) AS p FROM embeddings) SELECT CASE WHEN p=0 THEN vec_id::VARCHAR ELSE vec_id || '_' || p END AS link, (i-1)::INTEGER AS seq, round(part[i*2-1]::DOUBLE,6) AS x, round(part[i*2]::DOUBLE,6) AS y FROM l, (SELECT unnest(range(1,5)) AS i)")
def s06_multi_lines(spark, sf_dir):
    """Lines of several parts as links of their own, the later ones with their number."""
    e = F.col("embedding")
    pair = lambda a, i: F.struct(e[a + 2 * i].cast("double").alias("x"), e[a + 2 * i + 1].cast("double").alias("y"))
    parts = F.array(*[F.array(*[pair(a, i) for i in range(4)]) for a in (0, 8)])
    rows = catalogue.exploded_lines(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), parts.alias("parts")), "id", "parts")
    return rows.select("link", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {POINTS}, r AS (SELECT id%7 AS poly, id, x, y FROM pts) SELECT poly, count(*) AS n, round(min(x),6) AS xmin, round(max(x),6) AS xmax, round(min(y),6) AS ymin, round(max(y),6) AS ymax FROM r GROUP BY poly HAVING count(*)>=3 AND min(x) <= 0.2 AND max(x) >= -0.2 AND min(y) <= 0.2 AND max(y) >= -0.2")
def s07_f10_polygon_boxes(spark, sf_dir):
    """Boxes of polygon rings of three vertices or more that meet a view."""
    return catalogue.polygon_boxes(points(spark, sf_dir).select((F.col("id") % 7).alias("poly"), "x", "y"), "poly", (-0.2, 0.2, -0.2, 0.2)).withColumns({c: F.round(c, 6) for c in ("xmin", "xmax", "ymin", "ymax")})


@query(f"WITH {POINTS}, s AS (SELECT id%9 AS line, sqrt(pow(x-lag(x) OVER w,2)+pow(y-lag(y) OVER w,2)) AS d FROM pts WINDOW w AS (PARTITION BY id%9 ORDER BY id)), l AS (SELECT line, sum(d) AS length FROM s GROUP BY line) SELECT line, round(length,5) AS length FROM l ORDER BY length DESC, line LIMIT 1")
def s08_t03_longest_line(spark, sf_dir):
    w = Window.partitionBy("line").orderBy("id")
    rows = points(spark, sf_dir).withColumn("line", F.col("id") % 9)
    d = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    sums = rows.withColumn("d", d).groupBy("line").agg(F.sum("d").alias("length"))
    return sums.orderBy(F.desc("length"), "line").limit(1).select("line", F.round("length", 5).alias("length"))


@query("SELECT trunk, number, rank, link_index FROM (SELECT trunk, number, row_number() OVER (ORDER BY number, trunk)::INTEGER AS rank, row_number() OVER (ORDER BY trunk)::INTEGER-1 AS link_index FROM (SELECT DISTINCT 'trunk_' || (l_linenumber*3) AS trunk, l_linenumber*3 AS number FROM lineitem)) WHERE rank <= 5")
def w12_t02_numeric_order(spark, sf_dir):
    """The first five trunks by the number in their name; link_index is their place among all by its letters."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("trunk_"), F.col("l_linenumber") * 3).alias("trunk")).distinct()
    rows = rows.withColumn("number", F.regexp_extract("trunk", r"(\d+)$", 1).cast("int"))
    # One row a name.
    rows = rows.withColumn("link_index", F.row_number().over(Window.orderBy("trunk")) - 1)
    return rows.orderBy("number", "trunk").limit(5).withColumn("rank", F.row_number().over(Window.orderBy("number", "trunk")))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT vec_id%40 AS r, vec_id%24 AS c FROM embeddings) v WHERE EXISTS (SELECT 1 FROM (SELECT (day(ts)-1) AS r, hour(ts) AS c FROM events GROUP BY ALL HAVING count(*)>=3) w WHERE w.r=v.r AND w.c=v.c)")
def j09_vectors_on_water(spark, sf_dir):
    water = table(spark, sf_dir, "events").groupBy((F.dayofmonth("ts") - 1).alias("r"), F.hour("ts").alias("c")).agg(F.count("*").alias("k")).filter("k >= 3")
    vectors = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 40).alias("r"), (F.col("vec_id") % 24).alias("c")).distinct()
    return vectors.join(water, ["r", "c"], "left_semi").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS site, to_json({'n': count(*), 'largest': max(l_linenumber)}) AS summary FROM lineitem GROUP BY l_returnflag")
def d16_json_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("site")).agg(F.count("*").alias("n"), F.max("l_linenumber").alias("largest"))
    return rows.select("site", F.to_json(F.struct("n", "largest")).alias("summary"))


@query(f"WITH {RASTER} SELECT year, count(*) AS pixels, sum(water)::BIGINT AS water FROM (SELECT (2000 + ascii(layer) % 3)::INTEGER AS year, * FROM ras) WHERE year <> 2001 GROUP BY year")
def s01_s09_raster_scan(spark, sf_dir):
    """Masks written as a table of the data model and read with its declared schema, years not wanted left out by partition."""
    rows = raster(spark, sf_dir).select(F.lit("site").alias("site"), F.lit(1).alias("mask_level"), (F.ascii("layer") % 3 + 2000).alias("year"), "r", "c", F.col("water").cast("short").alias("val"))
    path = catalogue.shared_folder(spark, "rasters")
    catalogue.write_table(rows, path, ["site", "mask_level", "year"])
    return catalogue.read_table(spark, path, catalogue.RASTER).filter("year <> 2001").groupBy("year").agg(F.count("*").alias("pixels"), F.sum("val").alias("water"))


@query(f"WITH {RASTER} SELECT layer, (max(r)+1)::INTEGER AS height, (max(c)+1)::INTEGER AS width, count(*) AS pixels, 30.0::DOUBLE AS resolution, 'EPSG:32618' AS crs, round((max(r)+1)*(max(c)+1)*900/1e6,6) AS area_km2 FROM ras GROUP BY layer")
def s05_raster_sizes(spark, sf_dir):
    return catalogue.raster_sizes(raster(spark, sf_dir), ["layer"], 30.0, "EPSG:32618")
