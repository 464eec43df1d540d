"""Queries on river networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidflow.functions.columns import link_weight
from braidflow.operators import network
from braidflow.sources.standins import EDGES, POINTS, PROFILE, edges, points, profile

from .registry import query

NEAR = "e AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.id <> b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 0.005*0.005)"


@query(f"WITH {POINTS}, {NEAR} SELECT a, b FROM e WHERE a < b")
def j07_within_tolerance(spark, sf_dir):
    return network.within(points(spark, sf_dir), 0.005)


@query(f"WITH RECURSIVE {POINTS}, {NEAR}, r AS (SELECT id, id AS root FROM pts UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.root), c AS (SELECT id, min(root) AS root FROM r GROUP BY id) SELECT c.root, count(*) AS n, round(avg(x),6) AS x, round(avg(y),6) AS y FROM c JOIN pts USING (id) GROUP BY c.root")
def g01_a11_clusters(spark, sf_dir):
    """Endpoints within tolerance of each other as nodes, with the nodes' centroids."""
    pts = points(spark, sf_dir)
    return network.clusters(pts, 0.005).join(pts, "id").groupBy("root").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


AXIS = "ax AS (SELECT avg(x) mx, avg(y) my, 0.5*atan2(2*covar_samp(x,y), var_samp(x)-var_samp(y)) AS t FROM pts), nodes AS (SELECT id, CASE WHEN cos(t) < 0 THEN -1 ELSE 1 END*((x-mx)*cos(t)+(y-my)*sin(t)) AS p FROM pts, ax)"


@query(f"WITH {POINTS}, {AXIS} SELECT id, round(p,6) AS p FROM nodes")
def g02_main_axis(spark, sf_dir):
    return network.main_axis(points(spark, sf_dir)).select("id", F.round("p", 6).alias("p"))


LINKS = "links AS (SELECT id AS u, (id*7+3) % (SELECT count(*) FROM pts) AS v, 1.0+id%5 AS w, 'link_' || id AS link FROM pts), d AS (SELECT CASE WHEN a.p>b.p THEN v ELSE u END AS u, CASE WHEN a.p>b.p THEN u ELSE v END AS v, w, link, a.p>b.p AS reversed FROM links JOIN nodes a ON a.id=u JOIN nodes b ON b.id=v WHERE abs(a.p-b.p) >= 1e-9)"


def network_of(spark, sf_dir):
    pts = points(spark, sf_dir)
    n = pts.count()
    nodes = network.main_axis(pts)
    links = pts.select(F.col("id").alias("u"), ((F.col("id") * 7 + 3) % n).alias("v"), (1.0 + F.col("id") % 5).alias("w"), F.concat(F.lit("link_"), "id").alias("link"))
    return network.oriented(links, nodes), nodes


@query(f"WITH {POINTS}, {AXIS}, {LINKS} SELECT u, v, w::DOUBLE AS w, link, reversed FROM d")
def g03_f11_oriented_edges(spark, sf_dir):
    return network_of(spark, sf_dir)[0].select("u", "v", F.col("w").cast("double").alias("w"), "link", "reversed")


@query(f"""WITH {POINTS}, {AXIS}, {LINKS}, s AS (SELECT * FROM nodes WHERE id IN (SELECT u FROM d)), t AS (SELECT * FROM nodes WHERE id IN (SELECT v FROM d)),
x AS (SELECT id FROM s WHERE p <= (SELECT quantile_cont(p,0.05) FROM s)), y AS (SELECT id FROM t WHERE p >= (SELECT quantile_cont(p,0.95) FROM t))
SELECT coalesce(x.id, y.id) AS id, x.id IS NOT NULL AS source, y.id IS NOT NULL AS target FROM x FULL JOIN y ON x.id=y.id""")
def g04_sources_and_targets(spark, sf_dir):
    return network.ends(*network_of(spark, sf_dir))


@query(f"WITH {EDGES}, p AS (SELECT u, sum(w) AS w FROM edges GROUP BY u), s AS (SELECT u, w/sum(w) OVER () AS p FROM p) SELECT u, round(p,6) AS p, row_number() OVER (ORDER BY p DESC, u) AS rank, round(sum(p) OVER (ORDER BY p DESC, u ROWS UNBOUNDED PRECEDING),6) AS top, round(1/sum(p*p) OVER (),6) AS n_eff FROM s".replace("row_number() OVER (ORDER BY p DESC, u)", "(row_number() OVER (ORDER BY p DESC, u))::INTEGER"))
def a12_t06_shares(spark, sf_dir):
    rows = edges(spark, sf_dir).groupBy("u").agg(F.sum("w").alias("w"))
    return network.shares(rows, "u", "w").select("u", F.round("p", 6).alias("p"), "rank", F.round("top", 6).alias("top"), F.round("n_eff", 6).alias("n_eff"))


@query(f"""WITH {PROFILE}, e AS (SELECT link, arg_min(x,i) x0, arg_min(y,i) y0, arg_max(x,i) x1, arg_max(y,i) y1, max(s)-min(s) AS length, avg(b) AS mean_b FROM prof GROUP BY link)
SELECT link, round(x0,6) x0, round(y0,6) y0, round(x1,6) x1, round(y1,6) y1, round(length,5) AS length, round(length*coalesce(mean_b,0),3) AS weight FROM e""")
def a10_p24_j12_link_ends(spark, sf_dir):
    rows = profile(spark, sf_dir).groupBy("link").agg(F.min_by("x", "i").alias("x0"), F.min_by("y", "i").alias("y0"), F.max_by("x", "i").alias("x1"), F.max_by("y", "i").alias("y1"), (F.max("s") - F.min("s")).alias("length"), F.avg("b").alias("mean_b"))
    return rows.select("link", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")], F.round("length", 5).alias("length"), F.round(link_weight("length", "mean_b", "length_B"), 3).alias("weight"))
