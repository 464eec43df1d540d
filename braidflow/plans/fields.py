"""Queries on displacement fields, georeferencing and nearest-neighbour sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidflow.functions import columns as k
from braidflow.operators import displacement
from braidflow.operators.nearest import nearest
from braidflow.sources.standins import POINTS, points, table

from .registry import query

PATCH = "patch AS (SELECT vec_id AS k, i//8 AS r, i%8 AS c, a[i+1]::DOUBLE AS a, b[i+1]::DOUBLE AS b FROM (SELECT x.vec_id, x.embedding AS a, y.embedding AS b, unnest(range(64)) AS i FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1))"
SCORES = "m AS (SELECT k, avg(a) ma, avg(b) mb FROM patch GROUP BY k), z AS (SELECT k, r, c, a-ma AS a, b-mb AS b FROM patch JOIN m USING (k)), sc AS (SELECT x.k, (y.r-x.r+8)%8 AS dy, (y.c-x.c+8)%8 AS dx, sum(x.a*y.b) AS score FROM z x JOIN z y ON x.k=y.k GROUP BY ALL)"


def patches(spark, sf_dir):
    """(k, r, c, a, b): a vector and the next one as patches of 8 x 8."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), "embedding")
    after = rows.select((F.col("k") - 1).alias("k"), F.col("embedding").alias("other"))
    both = rows.join(after, "k").select("k", F.posexplode(F.arrays_zip("embedding", "other")).alias("i", "p"))
    return both.select("k", F.floor(F.col("i") / 8).cast("int").alias("r"), (F.col("i") % 8).alias("c"), F.col("p.embedding").cast("double").alias("a"), F.col("p.other").cast("double").alias("b"))


@query(f"""WITH {PATCH}, {SCORES}, t AS (SELECT k, dy, dx, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, dy, dx) AS n FROM sc), p AS (SELECT k, dy py, dx px, score peak FROM t WHERE n=1),
s AS (SELECT k, any_value(px) px, any_value(py) py, any_value(peak) peak, max(score) FILTER (least(abs(dy-py),8-abs(dy-py))>1 OR least(abs(dx-px),8-abs(dx-px))>1) AS next_peak FROM sc JOIN p USING (k) GROUP BY k)
SELECT k, CASE WHEN peak/next_peak>=1.3 AND next_peak>0 THEN (CASE WHEN px>4 THEN px-8 ELSE px END)::INTEGER END dx, CASE WHEN peak/next_peak>=1.3 AND next_peak>0 THEN (CASE WHEN py>4 THEN py-8 ELSE py END)::INTEGER END dy, round(peak,5) peak, round(CASE WHEN next_peak>0 THEN peak/next_peak END,4) signal FROM s""")
def i03_i05_displacement(spark, sf_dir):
    """Displacements whose peak is 1.3 times the next one or more; others are missing."""
    out = displacement.validated(displacement.peaks(displacement.correlation(patches(spark, sf_dir), "k", 8), "k", 8))
    return out.select("k", F.col("dx").cast("int").alias("dx"), F.col("dy").cast("int").alias("dy"), F.round("peak", 5).alias("peak"), F.round("signal", 4).alias("signal"))


def offset_sql(lo: str, hi: str) -> str:
    d = f"(2*ln({lo})-4*ln(peak)+2*ln({hi}))"
    return f"CASE WHEN least({lo},peak,{hi})>0 THEN CASE WHEN {d}<>0 THEN (ln({lo})-ln({hi}))/{d} ELSE 0 END ELSE 0 END"


@query(f"""WITH {PATCH}, {SCORES}, t AS (SELECT k, dy, dx, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, dy, dx) AS n FROM sc), p AS (SELECT k, dy py, dx px, score peak FROM t WHERE n=1),
s AS (SELECT k, any_value(px) px, any_value(py) py, any_value(peak) peak, max(score) FILTER (least(abs(dy-py),8-abs(dy-py))>2 OR least(abs(dx-px),8-abs(dx-px))>2) AS other,
any_value(score) FILTER (dy=(py+7)%8 AND dx=px) AS y0, any_value(score) FILTER (dy=(py+1)%8 AND dx=px) AS y1, any_value(score) FILTER (dx=(px+7)%8 AND dy=py) AS x0, any_value(score) FILTER (dx=(px+1)%8 AND dy=py) AS x1 FROM sc JOIN p USING (k) GROUP BY k),
f AS (SELECT *, CASE WHEN px>4 THEN px-8 ELSE px END AS sx, CASE WHEN py>4 THEN py-8 ELSE py END AS sy FROM s)
SELECT k, round(sx+{offset_sql('x0', 'x1')},3) AS dx, round(sy+{offset_sql('y0', 'y1')},3) AS dy, sx::INTEGER AS px, sy::INTEGER AS py, round(CASE WHEN other>0 THEN peak/other END,4) AS signal FROM f""".replace("ln(y0)", "ln(CASE WHEN y0>0 THEN y0 END)").replace("ln(y1)", "ln(CASE WHEN y1>0 THEN y1 END)").replace("ln(x0)", "ln(CASE WHEN x0>0 THEN x0 END)").replace("ln(x1)", "ln(CASE WHEN x1>0 THEN x1 END)"))
def i03_displacement_fourier(spark, sf_dir):
    """The same with a sub-pixel peak, by Fourier transforms over Arrow batches: the form for large windows."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("a"))
    after = rows.select((F.col("k") - 1).alias("k"), F.col("a").alias("b"))
    out = displacement.displacement_of(rows.join(after, "k"), ["k"], 8, 0)
    return out.select("k", F.round("dx", 3).alias("dx"), F.round("dy", 3).alias("dy"), "px", "py", F.when(F.col("signal") < float("inf"), F.round("signal", 4)).alias("signal"))


FRAMES = """fv AS (SELECT vec_id//64 AS scene, vec_id%64 AS r, embedding AS e, count(*) OVER (PARTITION BY vec_id//64) AS k FROM embeddings),
px AS (SELECT f.scene, f.r, c, f.e[c+1]::DOUBLE AS a, CASE WHEN f.scene%3=1 AND c>=36 OR f.scene%3=2 THEN f.e[(c*7+5)%64+1] ELSE g.e[(c+59)%64+1] END::DOUBLE AS b FROM fv f JOIN fv g ON g.scene=f.scene AND g.r=(f.r+3)%64, (SELECT unnest(range(64)) AS c) WHERE f.k=64)"""


def frames(spark, sf_dir):
    """(scene, r, c, a, b): 64 vectors as a frame, and it rolled by 5 columns and -3 rows; noise in a part of the second one."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("scene"), (F.col("vec_id") % 64).alias("r"), F.col("embedding").alias("e"))
    whole = rows.groupBy("scene").agg(F.count("*").alias("k")).filter("k = 64").select("scene")
    rows = rows.join(whole, "scene")
    after = rows.select("scene", ((F.col("r") + 61) % 64).alias("r"), F.col("e").alias("g"))
    rows = rows.join(after, ["scene", "r"]).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(63))))
    noise = (F.col("scene") % 3 == 2) | (F.col("scene") % 3 == 1) & (F.col("c") >= 36)
    b = F.when(noise, F.get("e", (F.col("c") * 7 + 5) % 64)).otherwise(F.get("g", (F.col("c") + 59) % 64))
    return rows.select("scene", F.col("r").cast("int").alias("r"), "c", F.get("e", F.col("c")).cast("double").alias("a"), b.cast("double").alias("b"))


@query(f"""WITH {FRAMES}, wn AS (SELECT gy, gx FROM (SELECT unnest(range(3)) AS gy), (SELECT unnest(range(3)) AS gx)),
pw AS (SELECT scene, gy, gx, r-gy*16 AS r, c-gx*16 AS c, a-avg(a) OVER q AS a, b-avg(b) OVER q AS b FROM px JOIN wn ON r BETWEEN gy*16 AND gy*16+31 AND c BETWEEN gx*16 AND gx*16+31 WINDOW q AS (PARTITION BY scene, gy, gx)),
sc AS (SELECT x.scene, x.gy, x.gx, (y.r-x.r+32)%32 AS dy, (y.c-x.c+32)%32 AS dx, sum(x.a*y.b) AS score FROM pw x JOIN pw y ON y.scene=x.scene AND y.gy=x.gy AND y.gx=x.gx GROUP BY ALL),
tp AS (SELECT scene, gy, gx, dy AS py, dx AS px, score AS peak FROM (SELECT *, row_number() OVER (PARTITION BY scene, gy, gx ORDER BY score DESC, dy, dx) AS n FROM sc) WHERE n=1),
sg AS (SELECT scene, gy, gx, any_value(px) AS px, any_value(py) AS py, any_value(peak) / max(score) FILTER (least(abs(dy-py),32-abs(dy-py))>2 OR least(abs(dx-px),32-abs(dx-px))>2) AS signal FROM sc JOIN tp USING (scene, gy, gx) GROUP BY scene, gy, gx),
fd AS (SELECT scene, gy, gx, round(signal,3) AS signal, CASE WHEN signal>=1.3 THEN (CASE WHEN px>16 THEN px-32 ELSE px END)::DOUBLE END AS dx, CASE WHEN signal>=1.3 THEN (CASE WHEN py>16 THEN py-32 ELSE py END)::DOUBLE END AS dy FROM sg),
nb AS (SELECT f.scene, f.gy, f.gx, avg(o.dx) AS ax, avg(o.dy) AS ay FROM fd f JOIN fd o ON o.scene=f.scene AND abs(o.gy-f.gy)<=1 AND abs(o.gx-f.gx)<=1 AND (o.gy<>f.gy OR o.gx<>f.gx) WHERE f.dx IS NULL GROUP BY ALL)
SELECT scene, gy::INTEGER AS gy, gx::INTEGER AS gx, gy*16+15.5 AS y, gx*16+15.5 AS x, signal, dx IS NOT NULL AS valid, round(coalesce(dx,ax),6) AS dx, round(coalesce(dy,ay),6) AS dy FROM fd LEFT JOIN nb USING (scene, gy, gx)""")
def i03_i06_window_chain(spark, sf_dir):
    """Frames to windows of 32 with an overlap of 16, each one's displacement, those that don't stand out repaired from
    their neighbours."""
    found = displacement.displacement_of(displacement.windows(frames(spark, sf_dir), ["scene"], 64, 64, 32, 16), ["scene"], 32, 16)
    field = displacement.validated(found.select("scene", "gy", "gx", "signal", F.col("px").alias("dx"), F.col("py").alias("dy")))
    field = field.withColumn("valid", F.col("dx").isNotNull())
    out = displacement.repaired(field, ["scene"], ["dx", "dy"])
    return out.select("scene", "gy", "gx", (F.col("gy") * 16 + 15.5).alias("y"), (F.col("gx") * 16 + 15.5).alias("x"), F.round("signal", 3).alias("signal"), "valid", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


@query("WITH f AS (SELECT vec_id//25 AS gy, vec_id%25 AS gx, CASE WHEN vec_id%6<>0 THEN embedding[1]::DOUBLE END AS dx, CASE WHEN vec_id%6<>0 THEN embedding[2]::DOUBLE END AS dy FROM embeddings), n AS (SELECT f.gy, f.gx, avg(o.dx) ax, avg(o.dy) ay FROM f JOIN f o ON abs(f.gy-o.gy)<=1 AND abs(f.gx-o.gx)<=1 AND (f.gy<>o.gy OR f.gx<>o.gx) WHERE f.dx IS NULL GROUP BY ALL) SELECT gy, gx, round(coalesce(dx,ax),6) dx, round(coalesce(dy,ay),6) dy FROM f LEFT JOIN n USING (gy, gx)")
def i06_repaired_field(spark, sf_dir):
    e = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 25).alias("gy"), (F.col("vec_id") % 25).alias("gx"), *[F.when(F.col("vec_id") % 6 != 0, e[i].cast("double")).alias(n) for i, n in enumerate(("dx", "dy"))])
    out = displacement.repaired(rows, [], ["dx", "dy"])
    return out.select("gy", "gx", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


@query("SELECT gy::INTEGER AS gy, gx::INTEGER AS gx, gy*32+31.5 AS y, gx*32+31.5 AS x FROM (SELECT unnest(range(0,7)) AS gy), (SELECT unnest(range(0,9)) AS gx)")
def i04_window_grid(spark, sf_dir):
    return displacement.window_grid(spark, 256, 320, 64, 32)


@query("SELECT site, \"first\", second FROM (SELECT s_nationkey AS site, s_suppkey AS \"first\", lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS second FROM supplier) WHERE second IS NOT NULL")
def j03_frame_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("site"), F.col("s_suppkey").alias("year"))
    return displacement.frame_pairs(rows, ["site"], "year")


@query(f"""WITH {POINTS}, b AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1, max(abs(x))<=180 AND max(abs(y))<=90 AS deg FROM pts),
g AS (SELECT id, (x-x0)/nullif(x1-x0,0)*99 AS col, (y-y0)/nullif(y1-y0,0)*49 AS r, deg FROM pts, b),
m AS (SELECT *, 0.01*col+0.002*r-60 AS mx, 0.001*col-0.01*r-5 AS my FROM g),
v AS (SELECT *, 2*0.5*0.01+3*0.25*0.002 AS vx, 2*0.5*0.001-3*0.25*0.01 AS vy FROM m)
SELECT id, deg, round(mx,6) mx, round(my,6) my,
round(vx*(111412.84*cos(radians(-5))-93.5*cos(3*radians(-5))+0.118*cos(5*radians(-5)))/1.5,4) AS vx, round(vy*(111132.92-559.82*cos(2*radians(-5))+1.175*cos(4*radians(-5))-0.0023*cos(6*radians(-5)))/1.5,4) AS vy,
round_even((-0.01*(mx+60)-0.002*(my+5))/(0.01*-0.01-0.002*0.001),0)::INTEGER AS pc, round_even((0.01*(my+5)-0.001*(mx+60))/(0.01*-0.01-0.002*0.001),0)::INTEGER AS pr FROM v""")
def p01_p09_georeferencing(spark, sf_dir):
    """Grid to raster, raster to map and back, displacement to velocity in metres a year."""
    pts = points(spark, sf_dir)
    box = pts.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), k.looks_like_degrees("x", "y").alias("deg"))
    rows = pts.crossJoin(F.broadcast(box)).select("id", "deg", k.stretched("x", "x0", "x1", 100).alias("col"), k.stretched("y", "y0", "y1", 50).alias("row"))
    affine = (0.01, 0.002, -60.0, 0.001, -0.01, -5.0)
    mx, my = k.to_map("col", "row", *affine)
    rows = rows.withColumns({"mx": mx, "my": my})
    vx, vy = k.to_velocity(2, 3, 0.5, 0.25, 0.01, 0.002, 0.001, -0.01, 1.5, "deg", -5.0)
    pc, pr = k.to_pixel("mx", "my", *affine)
    return rows.select("id", "deg", F.round("mx", 6).alias("mx"), F.round("my", 6).alias("my"), F.round(vx, 4).alias("vx"), F.round(vy, 4).alias("vy"), pc.alias("pc"), pr.alias("pr"))


@query(f"""WITH {POINTS}, s AS (SELECT * FROM pts WHERE id%2=1), g AS (SELECT id AS gid, x AS gx, y AS gy FROM pts WHERE id%2=0), d AS (SELECT id, gid, (x-gx)*(x-gx)+(y-gy)*(y-gy) AS d2 FROM s, g),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, gid) AS k FROM d) SELECT id, gid, round(sqrt(d2),6) AS distance FROM n WHERE k=1""")
def j01_nearest_grid_point(spark, sf_dir):
    pts = points(spark, sf_dir)
    out = nearest(pts.filter("id % 2 = 1"), pts.filter("id % 2 = 0").select(F.col("id").alias("gid"), F.col("x").alias("gx"), F.col("y").alias("gy")), ["id"], "gid")
    return out.select("id", "gid", F.round(F.sqrt("d2"), 6).alias("distance"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(-50.0, least(l_quantity*10-100, 300-200.0)) AS low, greatest(-50.0, least(l_quantity*10-100, 300-200.0))+200 AS high, (abs(l_quantity) BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.05) AS inbox,
CASE WHEN p < 1 OR p IS NULL THEN 1 ELSE p END AS nice FROM (SELECT *, CASE WHEN l_extendedprice/pow(10,floor(log10(l_extendedprice))) <= 1 THEN 1 WHEN l_extendedprice/pow(10,floor(log10(l_extendedprice))) <= 2 THEN 2 WHEN l_extendedprice/pow(10,floor(log10(l_extendedprice))) <= 5 THEN 5 ELSE 10 END*pow(10,floor(log10(l_extendedprice))) AS p FROM lineitem)""")
def p26_p28_f10_boxes(spark, sf_dir):
    """Boxes moved into limits, containment, and the nice number above a value."""
    low, high = k.clamped(F.col("l_quantity") * 10 - 100, F.col("l_quantity") * 10 + 100, -50.0, 300.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", low.alias("low"), high.alias("high"), k.inside(F.abs("l_quantity"), "l_discount", 10, 20, 0.02, 0.05).alias("inbox"), k.nice_number("l_extendedprice").alias("nice"))


@query("WITH w AS (SELECT s_suppkey, round_even((s_acctbal-(-1000))/30.0,0) AS a, round_even((s_acctbal-(-1000))/30.0,0)+round_even(600/30.0,0) AS b FROM supplier) SELECT s_suppkey, CASE WHEN least(300.0,b)-greatest(0.0,a)>1 THEN greatest(0.0,a)::INTEGER END AS off, CASE WHEN least(300.0,b)-greatest(0.0,a)>1 THEN (least(300.0,b)-greatest(0.0,a))::INTEGER END AS len FROM w")
def p29_p30_pixel_windows(spark, sf_dir):
    """A region of interest of a fixed size around each supplier's balance as a window of pixels."""
    off, length = k.pixel_window("s_acctbal", F.col("s_acctbal") + 600, -1000.0, 30.0, 300)
    return table(spark, sf_dir, "supplier").select("s_suppkey", off.alias("off"), length.alias("len"))


@query("""WITH b AS (SELECT s_nationkey, min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier GROUP BY s_nationkey),
r AS (SELECT s_suppkey, lo+0.25*(hi-lo) AS part_low, lo+0.6*(hi-lo) AS part_high, s_acctbal-500 AS a, s_acctbal+500 AS z, lo, hi FROM supplier JOIN b USING (s_nationkey))
SELECT s_suppkey, round(part_low,6) AS part_low, round(part_high,6) AS part_high, round(a,6) AS low, round(z,6) AS high,
round(CASE WHEN 1000.0>=hi-lo THEN lo ELSE least(greatest(a+750,lo),hi-1000) END,6) AS moved_low, round(CASE WHEN 1000.0>=hi-lo THEN hi ELSE least(greatest(a+750,lo),hi-1000)+1000 END,6) AS moved_high FROM r""")
def p30_regions(spark, sf_dir):
    """Regions by fractions of a nation's range, about a centre by size, and shifted into that range."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    rows = rows.join(rows.groupBy("s_nationkey").agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi")), "s_nationkey")
    part, box = k.part_of("lo", "hi", F.lit(0.25), F.lit(0.6)), k.around("s_acctbal", F.lit(1000.0))
    moved = k.shifted(*box, F.lit(750.0), "lo", "hi")
    names = ("part_low", "part_high", "low", "high", "moved_low", "moved_high")
    return rows.select("s_suppkey", *[F.round(x, 6).alias(n) for n, x in zip(names, (*part, *box, *moved), strict=True)])
