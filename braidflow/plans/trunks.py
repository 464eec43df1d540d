"""Queries on whole networks: from links' ends to nodes, trunks, their samples, metrics, shares, fits and spectra.

The network of a site is made of its links' ends; a site is eight users, whose curves are links between five places, some
digitised against the others' direction.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from braidflow.operators import curves, network, regression
from braidflow.sources.standins import PROFILE, profile

from .along_curves import CURV
from .registry import query

TOLERANCE, TRUNKS = 5.0, 3


def links_of(samples):
    """(site, link, x0, y0, x1, y1, w) of the links: ends, and arc length as weight."""
    j = F.floor((F.col("link") % 8) / 2)
    ends = samples.groupBy("link").agg((F.min_by("m", "i") / 100).alias("y0"), (F.max_by("m", "i") / 100).alias("y1"), (F.max("s") - F.min("s")).alias("w"))
    back = F.col("link") % 3 == 0
    near, far = j * 100, (j + 1) * 100
    return ends.select(F.floor(F.col("link") / 8).alias("site"), "link", (F.when(back, far).otherwise(near) + F.col("y0")).alias("x0"), "y0", (F.when(back, near).otherwise(far) + F.col("y1")).alias("x1"), "y1", "w")


def network_sql(tolerance: float = TOLERANCE, rounds: int = TRUNKS, least: float = 0.0, tag: str = "") -> str:
    """Nodes, oriented edges and the trunks of all sites: each trunk the heaviest of all paths from a source to a target."""
    parts = [f"""le{tag} AS (SELECT link, link//8 AS site, (link%8)//2 AS j, arg_min(m,i)/100 AS y0, arg_max(m,i)/100 AS y1, max(s)-min(s) AS w FROM prof GROUP BY link),
en{tag} AS (SELECT site, link, link*2 AS id, CASE WHEN link%3=0 THEN (j+1)*100 ELSE j*100 END + y0 AS x, y0 AS y FROM le{tag} UNION ALL SELECT site, link, link*2+1, CASE WHEN link%3=0 THEN j*100 ELSE (j+1)*100 END + y1, y1 FROM le{tag}),
nr{tag} AS (SELECT a.id AS a, b.id AS b FROM en{tag} a JOIN en{tag} b ON a.site=b.site AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= {tolerance}*{tolerance}),
rc{tag} AS (SELECT id AS a, id AS b FROM en{tag} UNION SELECT rc{tag}.a, nr{tag}.b FROM rc{tag} JOIN nr{tag} ON nr{tag}.a=rc{tag}.b),
cl{tag} AS (SELECT a AS id, min(b) AS node FROM rc{tag} GROUP BY a),
nd{tag} AS (SELECT site, node, avg(x) AS x, avg(y) AS y FROM en{tag} JOIN cl{tag} USING (id) GROUP BY site, node),
ax{tag} AS (SELECT site, avg(x) AS mx, avg(y) AS my, count(*) AS n, 0.5*atan2(2*covar_samp(x,y), var_samp(x)-var_samp(y)) AS t FROM nd{tag} GROUP BY site),
np{tag} AS (SELECT site, node, CASE WHEN n>=2 THEN CASE WHEN cos(t)<0 THEN -1 ELSE 1 END*((x-mx)*cos(t)+(y-my)*sin(t)) ELSE x END AS p FROM nd{tag} JOIN ax{tag} USING (site)),
d{tag}1 AS (SELECT le{tag}.site, link, w, CASE WHEN a.p<=b.p THEN a.node ELSE b.node END AS u, CASE WHEN a.p<=b.p THEN b.node ELSE a.node END AS v, a.p>b.p AS rev
  FROM le{tag} JOIN cl{tag} c ON c.id=link*2 JOIN cl{tag} e ON e.id=link*2+1 JOIN np{tag} a ON a.node=c.node JOIN np{tag} b ON b.node=e.node WHERE abs(a.p-b.p)>=1e-9),
so{tag} AS (SELECT site, node FROM (SELECT site, node, p, quantile_cont(p,0.05) OVER (PARTITION BY site) AS q FROM np{tag} WHERE node IN (SELECT u FROM d{tag}1)) WHERE p<=q),
ta{tag} AS (SELECT site, node FROM (SELECT site, node, p, quantile_cont(p,0.95) OVER (PARTITION BY site) AS q FROM np{tag} WHERE node IN (SELECT v FROM d{tag}1)) WHERE p>=q)"""]
    for k in range(1, rounds + 1):
        parts.append(f"""wk{tag}{k} AS (SELECT site, node, 0::DOUBLE AS w, []::BIGINT[] AS links FROM so{tag} UNION ALL SELECT d.site, d.v, wk{tag}{k}.w+d.w, list_append(links, d.link) FROM wk{tag}{k} JOIN d{tag}{k} d ON d.site=wk{tag}{k}.site AND d.u=wk{tag}{k}.node),
be{tag}{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY CASE WHEN node IN (SELECT node FROM ta{tag}) THEN 0 ELSE 1 END, w DESC, node) AS o FROM wk{tag}{k} WHERE len(links)>0) WHERE o=1)""")
        if k < rounds:
            parts.append(f"d{tag}{k + 1} AS (SELECT d.* FROM d{tag}{k} d JOIN be{tag}{k} b USING (site) WHERE NOT list_contains(b.links, d.link))")
    union = " UNION ALL ".join(f"SELECT site, {k} AS trunk, w, links FROM be{tag}{k}" for k in range(1, rounds + 1))
    parts.append(f"tr{tag} AS (SELECT * FROM ({union}) WHERE w >= {least}), me{tag} AS (SELECT t.site, t.trunk, t.pos, t.link, d.rev FROM (SELECT site, trunk, unnest(range(1,len(links)+1)) AS pos, unnest(links) AS link FROM tr{tag}) t JOIN d{tag}1 d USING (link))")
    return ", ".join(parts)


NETWORK = network_sql()
#: Samples along trunks.
ALONG = """sp AS (SELECT link, min(s) s0, max(s) s1 FROM curv GROUP BY link),
ofs AS (SELECT me.*, s0, s1, coalesce(sum(s1-s0) OVER (PARTITION BY me.site, trunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS o FROM me JOIN sp USING (link)),
al0 AS (SELECT ofs.site, trunk, pos, row_number() OVER (PARTITION BY ofs.site, trunk, pos ORDER BY CASE WHEN rev THEN -i ELSE i END) AS k, o + CASE WHEN rev THEN s1-s ELSE s-s0 END AS s, b, CASE WHEN rev THEN -c ELSE c END AS c, CASE WHEN rev THEN -m ELSE m END AS m FROM ofs JOIN curv USING (link)),
al AS (SELECT *, site*10+trunk AS tid, row_number() OVER (PARTITION BY site, trunk ORDER BY pos, k) AS j FROM al0 WHERE pos=1 OR k>1)"""


def solved(spark, sf_dir, tolerance: float = TOLERANCE):
    return network.paths(links_of(profile(spark, sf_dir)), "site", tolerance, TRUNKS)


def along(spark, sf_dir):
    """(site, trunk, tid, j, s, b, c, m) along all trunks."""
    samples = curves.curvature(profile(spark, sf_dir), ["link"]).select("link", "i", "s", "b", "c", "m")
    path = network.paths(links_of(samples), "site", TOLERANCE, TRUNKS)
    return network.concatenated(path, samples, ["site", "trunk"]).withColumn("tid", F.col("site") * 10 + F.col("trunk"))


@query(f"WITH RECURSIVE {PROFILE}, {NETWORK} SELECT site, trunk::INTEGER AS trunk, pos::INTEGER AS pos, link, rev AS reversed FROM me")
def g05_g06_t04_j10_trunks(spark, sf_dir):
    """Which links make up each site's trunks, in order, by removal of the heaviest path each time."""
    return solved(spark, sf_dir).select("site", "trunk", "pos", "link", "reversed")


@query(f"""WITH RECURSIVE {PROFILE}, {NETWORK}, a AS (SELECT site, CASE WHEN cos(t)<0 THEN -cos(t) ELSE cos(t) END AS px, CASE WHEN cos(t)<0 THEN -sin(t) ELSE sin(t) END AS py FROM ax)
SELECT site, (SELECT count(*) FROM le WHERE le.site=a.site) AS n_links, (SELECT count(*) FROM nd WHERE nd.site=a.site) AS n_nodes, (SELECT count(*) FROM d1 WHERE d1.site=a.site) AS n_edges, (SELECT count(*) FROM tr WHERE tr.site=a.site) AS n_trunks,
(SELECT count(*) FROM so WHERE so.site=a.site) AS n_sources, (SELECT count(*) FROM ta WHERE ta.site=a.site) AS n_targets, round(px,6) AS axis_x, round(py,6) AS axis_y FROM a""")
def g07_j12_diagnostics(spark, sf_dir):
    """Each site's network in numbers."""
    out = network.diagnostics(links_of(profile(spark, sf_dir)), "site", TOLERANCE, TRUNKS)
    return out.withColumns({c: F.round(c, 6) for c in ("axis_x", "axis_y")})


def sweep_sql() -> str:
    parts, unions = [PROFILE], []
    for n, tolerance in enumerate((0.2, 5.0)):
        parts.append(network_sql(tolerance, TRUNKS, 0.0, f"_{n}_"))
        for least in (0.0, 2000.0, 4000.0):
            unions.append(f"SELECT site, {tolerance}::DOUBLE AS tolerance, {least}::DOUBLE AS least, count(*) AS trunks, round(1/sum(p*p),6) AS n_eff, round(max(p),6) AS top1, CASE WHEN count(*)>1 THEN round(sum(p) FILTER (k<=2),6) END AS top2 FROM (SELECT site, w/sum(w) OVER (PARTITION BY site) AS p, row_number() OVER (PARTITION BY site ORDER BY w DESC) AS k FROM tr_{n}_ WHERE w >= {least}) GROUP BY site")
    return f"WITH RECURSIVE {', '.join(parts)} {' UNION ALL '.join(unions)}"


@query(sweep_sql())
def a29_sensitivity(spark, sf_dir):
    """Trunks, their effective number and top shares by tolerance and least length."""
    links, out = links_of(profile(spark, sf_dir)), None
    for tolerance in (0.2, 5.0):
        found = network.paths(links, "site", tolerance, TRUNKS).groupBy("site", "trunk").agg(F.sum("w").alias("w"))
        for least in (0.0, 2000.0, 4000.0):
            part = network.criterion(found.filter(F.col("w") >= least), ["site"], "w")
            part = part.select("site", F.lit(tolerance).alias("tolerance"), F.lit(least).alias("least"), "trunks", *[F.round(c, 6).alias(c) for c in ("n_eff", "top1", "top2")])
            out = part if out is None else out.unionByName(part)
    return out


METRICS = "mt AS (SELECT site, trunk, count(s) AS n_samples, max(s)-min(s) AS arc_length, avg(b) AS mean_b, avg(abs(c)) AS mean_abs_c, avg(abs(m)) AS mean_abs_m, sum(c) AS sum_c, count(*) FILTER (s IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND m IS NOT NULL)/count(*)::DOUBLE AS valid FROM al GROUP BY site, trunk)"


def trunk_metrics(rows):
    whole = F.col("s").isNotNull() & F.col("b").isNotNull() & F.col("c").isNotNull() & F.col("m").isNotNull()
    return rows.groupBy("site", "trunk").agg(F.count("s").alias("n_samples"), (F.max("s") - F.min("s")).alias("arc_length"), F.avg("b").alias("mean_b"), F.avg(F.abs("c")).alias("mean_abs_c"), F.avg(F.abs("m")).alias("mean_abs_m"), F.sum("c").alias("sum_c"), (F.count_if(whole) / F.count("*")).alias("valid"))


@query(f"WITH RECURSIVE {PROFILE}, {CURV}, {NETWORK}, {ALONG}, {METRICS} SELECT site, trunk::INTEGER AS trunk, n_samples, round(arc_length,4) AS arc_length, round(mean_b,6) AS mean_b, round(mean_abs_c,5) AS mean_abs_c, round(mean_abs_m,6) AS mean_abs_m, round(sum_c,4)+0.0 AS sum_c, round(valid,6) AS valid FROM mt")
def w11_a09_j11_trunk_samples(spark, sf_dir):
    """Samples of the links joined along each trunk, some against their direction, and the trunks' metrics."""
    out = trunk_metrics(along(spark, sf_dir))
    digits = {"arc_length": 4, "mean_b": 6, "mean_abs_c": 5, "mean_abs_m": 6, "valid": 6}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()} | {"sum_c": F.round("sum_c", 4) + 0.0})


@query(f"""WITH RECURSIVE {PROFILE}, {CURV}, {NETWORK}, {ALONG}, {METRICS}, p AS (SELECT site, arc_length/sum(arc_length) OVER (PARTITION BY site) AS p, row_number() OVER (PARTITION BY site ORDER BY arc_length DESC) AS k FROM mt)
SELECT site, count(*) AS trunks, round(1/sum(p*p),6) AS n_eff, round(max(p),6) AS top1, CASE WHEN count(*)>1 THEN round(sum(p) FILTER (k<=2),6) END AS top2, CASE WHEN count(*)>2 THEN round(sum(p) FILTER (k<=3),6) END AS top3 FROM p GROUP BY site""")
def a12_t06_criterion_a(spark, sf_dir):
    """The trunks' shares of a site's length: their effective number and the largest ones."""
    out = network.criterion(trunk_metrics(along(spark, sf_dir)), ["site"], "arc_length")
    return out.withColumns({c: F.round(c, 6) for c in ("n_eff", "top1", "top2", "top3")})


FITS = """SELECT {keys}, 'C linear' AS model, regr_count(am,ac) AS n, round(regr_slope(am,ac),4) AS a, round(regr_intercept(am,ac),4) AS b, round(regr_r2(am,ac),5) AS r2 FROM {rows} GROUP BY {by}
UNION ALL SELECT {keys}, 'B linear', regr_count(am,w), round(regr_slope(am,w),4), round(regr_intercept(am,w),4), round(regr_r2(am,w),5) FROM {rows} GROUP BY {by}"""


@query(f"WITH RECURSIVE {PROFILE}, {CURV}, {NETWORK}, {ALONG}, f AS (SELECT site, trunk::INTEGER AS trunk, abs(c) AS ac, abs(m) AS am, b AS w FROM al) " + FITS.format(keys="site, trunk", rows="f", by="site, trunk"))
def a23_trunk_fits(spark, sf_dir):
    """Migration by curvature and by width along each trunk."""
    rows = along(spark, sf_dir).select("site", "trunk", F.abs("c").alias("ac"), F.abs("m").alias("am"), F.col("b").alias("w"))
    out = None
    for model, x in (("C linear", "ac"), ("B linear", "w")):
        fit = regression.linear(rows, ["site", "trunk"], x, "am")
        part = fit.select("site", "trunk", F.lit(model).alias("model"), "n", F.round("slope", 4).alias("a"), F.round("intercept", 4).alias("b"), F.round("r2", 5).alias("r2"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH RECURSIVE {PROFILE}, {CURV}, {NETWORK}, {ALONG}, {METRICS}, f AS (SELECT *, count(*) OVER (PARTITION BY trunk) AS k, exp(regr_intercept(ln(mean_abs_m),ln(mean_abs_c)) OVER w) AS a, regr_slope(ln(mean_abs_m),ln(mean_abs_c)) OVER w AS e, avg(mean_abs_m) OVER w AS my FROM mt WHERE mean_abs_c IS NOT NULL AND mean_abs_m IS NOT NULL WINDOW w AS (PARTITION BY trunk))
SELECT trunk::INTEGER AS trunk, 'linear' AS model, count(*) AS n, CASE WHEN count(*)>=3 THEN round(regr_slope(mean_abs_m,mean_abs_c),4) END AS a, CASE WHEN count(*)>=3 THEN round(regr_intercept(mean_abs_m,mean_abs_c),4) END AS b, CASE WHEN count(*)>=3 THEN round(regr_r2(mean_abs_m,mean_abs_c),5) END AS r2 FROM f GROUP BY trunk
UNION ALL SELECT trunk::INTEGER, 'power', count(*), CASE WHEN count(*)>=3 THEN round(any_value(a),4) END, CASE WHEN count(*)>=3 THEN round(any_value(e),4) END, CASE WHEN count(*)>=3 THEN round(1-sum(pow(mean_abs_m-a*pow(mean_abs_c,e),2))/sum(pow(mean_abs_m-my,2)),5) END FROM f WHERE mean_abs_c>0 AND mean_abs_m>0 GROUP BY trunk""")
def a23_across_trunks(spark, sf_dir):
    """Mean migration by mean curvature over the trunks of one rank, by a line and by a power, from three trunks on."""
    rows = trunk_metrics(along(spark, sf_dir))
    line = regression.linear(rows, ["trunk"], "mean_abs_c", "mean_abs_m").select("trunk", F.lit("linear").alias("model"), "n", F.col("slope").alias("a"), F.col("intercept").alias("b"), "r2")
    power = regression.power_law(rows, ["trunk"], "mean_abs_c", "mean_abs_m").select("trunk", F.lit("power").alias("model"), "n", "a", "b", "r2")
    out = line.unionByName(power)
    digits = {"a": 4, "b": 4, "r2": 5}
    return out.withColumns({c: F.when(F.col("n") >= 3, F.round(c, d)) for c, d in digits.items()})


#: Whole transforms and correlations of curves (tid, j, fb, fc, fm): filled width, |curvature| and |migration|.
B_SQL = """fl AS (SELECT tid, j, v, x, last_value(x IGNORE NULLS) OVER w0 AS v0, first_value(x IGNORE NULLS) OVER w1 AS v1, last_value(CASE WHEN x IS NOT NULL THEN j END IGNORE NULLS) OVER w0 AS i0, first_value(CASE WHEN x IS NOT NULL THEN j END IGNORE NULLS) OVER w1 AS i1
  FROM (SELECT tid, j, 'b' AS v, b AS x FROM al UNION ALL SELECT tid, j, 'c', abs(c) FROM al UNION ALL SELECT tid, j, 'm', abs(m) FROM al)
  WINDOW w0 AS (PARTITION BY tid, v ORDER BY j ROWS UNBOUNDED PRECEDING), w1 AS (PARTITION BY tid, v ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
ff AS (SELECT tid, v, j-1 AS j, count(*) OVER (PARTITION BY tid, v) AS n, coalesce(x, v0+(v1-v0)*(j-i0)/nullif(i1-i0,0)::DOUBLE, v0, v1, 0) AS x FROM fl),
zz AS (SELECT *, x-avg(x) OVER (PARTITION BY tid, v) AS z FROM ff),
kk AS (SELECT *, unnest(range(1, n//2+1)) AS k FROM zz WHERE n>=4 AND v IN ('b','c')),
ft AS (SELECT tid, v, n, k, sum(z*cos(2*pi()*k*j/n)) AS re, -sum(z*sin(2*pi()*k*j/n)) AS im FROM kk GROUP BY ALL),
dm AS (SELECT tid, v, n, k, re, im FROM (SELECT *, row_number() OVER (PARTITION BY tid, v ORDER BY round(sqrt(re*re+im*im),9) DESC, k) AS o FROM ft) WHERE o=1),
ph AS (SELECT c.tid, atan2(b.im,b.re)-atan2(c.im,c.re) AS d FROM dm c JOIN ft b ON b.tid=c.tid AND b.k=c.k AND b.v='b' WHERE c.v='c'),
nz AS (SELECT tid, v, sum(z*z) AS q FROM zz GROUP BY tid, v),
cc AS (SELECT a.tid, a.v, a.j-m.j AS lag, sum(a.z*m.z)/nullif(sqrt(any_value(na.q)*any_value(nm.q)),0) AS r FROM zz a JOIN zz m ON m.tid=a.tid AND m.v='m' JOIN nz na ON na.tid=a.tid AND na.v=a.v JOIN nz nm ON nm.tid=a.tid AND nm.v='m' WHERE a.v IN ('b','c') AND a.n>=4 GROUP BY a.tid, a.v, a.j-m.j),
lg AS (SELECT tid, v, lag, r FROM (SELECT *, row_number() OVER (PARTITION BY tid, v ORDER BY round(r,9) DESC, lag) AS o FROM cc) WHERE o=1),
ac AS (SELECT a.tid, a.v, a.j-m.j AS lag, sum(a.z*m.z)/nullif(any_value(q),0) AS r FROM zz a JOIN zz m ON m.tid=a.tid AND m.v=a.v AND a.j>=m.j JOIN nz ON nz.tid=a.tid AND nz.v=a.v WHERE a.v IN ('b','c') AND a.n>=4 GROUP BY a.tid, a.v, a.j-m.j),
mk AS (SELECT tid, v, min(lag) FILTER (r<=exp(-1)) AS folding, min(lag) FILTER (r<0) AS zero, max(lag) AS l FROM ac GROUP BY tid, v),
ig AS (SELECT ac.tid, ac.v, any_value(folding) AS folding, sum(r) FILTER (lag>=1 AND lag<coalesce(zero,l+1)) AS integral FROM ac JOIN mk ON mk.tid=ac.tid AND mk.v=ac.v GROUP BY ac.tid, ac.v)"""


@query(f"""WITH RECURSIVE {PROFILE}, {CURV}, {NETWORK}, {ALONG}, {B_SQL}
SELECT b.tid, round(b.n/b.k::DOUBLE,6) AS wavelength_b, round(c.n/c.k::DOUBLE,6) AS wavelength_c, round(degrees((d+pi())-2*pi()*floor((d+pi())/(2*pi()))-pi()),3) AS phase, lb.lag AS lag_b, round(lb.r,6) AS r_b, lc.lag AS lag_c, round(lc.r,6) AS r_c, ib.folding AS folding_b, round(ib.integral,5) AS integral_b, ic.folding AS folding_c, round(ic.integral,5) AS integral_c
FROM dm b JOIN dm c ON c.tid=b.tid AND c.v='c' JOIN ph ON ph.tid=b.tid JOIN lg lb ON lb.tid=b.tid AND lb.v='b' JOIN lg lc ON lc.tid=b.tid AND lc.v='c' JOIN ig ib ON ib.tid=b.tid AND ib.v='b' JOIN ig ic ON ic.tid=b.tid AND ic.v='c' WHERE b.v='b'""")
def q04_q08_q09_spectra(spark, sf_dir):
    """Along each trunk, whole: dominant wavelengths of width and |curvature| and the phase between them there, the lags
    at which either goes best with |migration|, and their correlation lengths; in samples and degrees."""
    rows = along(spark, sf_dir).select("tid", F.col("j").alias("i"), "b", F.abs("c").alias("c"), F.abs("m").alias("m"))
    for name in ("b", "c", "m"):
        rows = curves.filled(rows, ["tid"], name)
    return curves.criterion(rows, "tid")
