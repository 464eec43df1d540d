"""River networks: endpoint clustering, orientation along the main axis, longest paths and trunks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def within(points: DataFrame, tolerance: float) -> DataFrame:
    """(a, b), a < b, of points (id, x, y) no farther apart than the tolerance: an equi-join on grid cells and those around."""
    cell = points.select("id", "x", "y", F.floor(F.col("x") / tolerance).alias("i"), F.floor(F.col("y") / tolerance).alias("j")).filter("x IS NOT NULL AND y IS NOT NULL")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    probes = cell.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "i", "j", F.explode(around).alias("d"))
    probes = probes.select("a", "ax", "ay", (F.col("i") + F.col("d.i")).alias("i"), (F.col("j") + F.col("d.j")).alias("j"))
    d2 = (F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")) + (F.col("ay") - F.col("y")) * (F.col("ay") - F.col("y"))
    return probes.join(cell.withColumnRenamed("id", "b"), ["i", "j"]).filter((F.col("a") < F.col("b")) & (d2 <= tolerance * tolerance)).select("a", "b")


#: Squares a tolerance: so many that all points of one square are within it, rounding included.
FINE = 1.5


def clusters(points: DataFrame, tolerance: float) -> DataFrame:
    """(id, root): the smallest id that steps of at most the tolerance reach. Without a positive tolerance each point is
    its own. Points are put in squares so small that all of one square are joined, and two squares are linked once, however
    many of their points are near each other. Labels go over the links of squares and jump to their labels' labels each
    round, until none changes; each round's table is written, which outlives lost executors."""
    points = points.select("id", "x", "y")
    if not tolerance > 0:
        return points.select("id", F.col("id").alias("root"))
    side = tolerance / FINE
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    placed = saved(points.select("id", "x", "y", F.when(known, F.floor(F.col("x") / side)).alias("i"), F.when(known, F.floor(F.col("y") / side)).alias("j")))
    squares = saved(placed.filter(known).groupBy("i", "j").agg(F.min("id").alias("square")))
    held = placed.join(squares, ["i", "j"]).select("x", "y", "i", "j", "square")
    links = saved(adjacent(held, tolerance))
    links = links.union(links.select("b", "a")).toDF("a", "b")
    labels = squares.select(F.col("square").alias("id"), F.col("square").alias("root"))
    while True:
        near = links.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        moved = labels.join(near, "id", "left").select("id", F.least("root", F.coalesce("near", "root")).alias("root"), F.col("root").alias("before"))
        jumps = moved.select(F.col("id").alias("root"), F.col("root").alias("further"))
        after = saved(moved.join(jumps, "root", "left").select("id", F.least("root", F.coalesce("further", "root")).alias("root"), "before"))
        changed = after.filter("root <> before").limit(1).count()
        labels = after.select("id", "root")
        if not changed:
            break
    named = squares.join(labels.withColumnRenamed("id", "square"), "square").select("i", "j", "root")
    return placed.join(named, ["i", "j"], "left").select("id", F.coalesce("root", "id").alias("root"))


def adjacent(held: DataFrame, tolerance: float) -> DataFrame:
    """(a, b) of squares that have points (x, y, i, j, square) within the tolerance of each other, each pair once."""
    steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    around = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in steps])
    probes = held.select(F.col("square").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "i", "j", F.explode(around).alias("d"))
    probes = probes.select("a", "ax", "ay", (F.col("i") + F.col("d.di")).alias("i"), (F.col("j") + F.col("d.dj")).alias("j"))
    d2 = (F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")) + (F.col("ay") - F.col("y")) * (F.col("ay") - F.col("y"))
    return probes.join(held.withColumnRenamed("square", "b"), ["i", "j"]).filter(d2 <= tolerance * tolerance).select("a", "b").distinct()


def saved(df: DataFrame) -> DataFrame:
    """df written as Parquet in the folder that spark.checkpoint.dir names and read back. A checkpoint keeps its plan's estimate of
    its size, which joins multiply each round until the number itself fills the driver."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp()}"
    path = f"{folder.rstrip('/')}/clusters-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def main_axis(nodes: DataFrame) -> DataFrame:
    """nodes (id, x, y) with p, the coordinate along the first principal axis, which points to greater x; with fewer than
    two nodes x itself."""
    axis = nodes.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_samp("x", "y").alias("xy"), F.var_samp("x").alias("xx"), F.var_samp("y").alias("yy"), F.count("x").alias("n"))
    angle = 0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))
    axis = axis.withColumn("angle", angle)
    cos, sin = F.cos("angle"), F.sin("angle")
    p = (F.col("x") - F.col("mx")) * cos + (F.col("y") - F.col("my")) * sin
    return nodes.crossJoin(F.broadcast(axis)).select("id", "x", "y", F.when(F.col("n") >= 2, F.when(cos < 0, -p).otherwise(p)).otherwise(F.col("x")).alias("p"))


def oriented(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (u, v, w, link) from the lower p to the higher; those without a difference or a p go."""
    a, b = nodes.select(F.col("id").alias("u"), F.col("p").alias("pu")), nodes.select(F.col("id").alias("v"), F.col("p").alias("pv"))
    rows = edges.join(a, "u").join(b, "v").filter((F.abs(F.col("pu") - F.col("pv")) >= 1e-9) & F.col("pu").isNotNull() & F.col("pv").isNotNull())
    back = F.col("pu") > F.col("pv")
    return rows.select(F.when(back, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(back, F.col("u")).otherwise(F.col("v")).alias("v"), "w", "link", back.alias("reversed"))


def ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, source, target): nodes with an outgoing edge up to their 5th percentile of p, with an incoming one from their
    95th on."""
    out, into = edges.select(F.col("u").alias("id")).distinct(), edges.select(F.col("v").alias("id")).distinct()
    start = nodes.join(out, "id", "left_semi")
    stop = nodes.join(into, "id", "left_semi")
    low, high = start.agg(F.expr("percentile(p, 0.05)").alias("t")), stop.agg(F.expr("percentile(p, 0.95)").alias("t"))
    sources = start.crossJoin(F.broadcast(low)).filter("p <= t").select("id", F.lit(True).alias("source"))
    targets = stop.crossJoin(F.broadcast(high)).filter("p >= t").select("id", F.lit(True).alias("target"))
    return sources.join(targets, "id", "full_outer").select("id", F.coalesce("source", F.lit(False)).alias("source"), F.coalesce("target", F.lit(False)).alias("target"))


def longest_path(edges: list[tuple], order: dict, sources: set, targets: set) -> list[tuple]:
    """The heaviest path of edges (u, v, w, link) by nodes in order from a source to a target, or to any node that is
    reached if no target is; an edge replaces another only if it is better, so that the first of equals stays."""
    best, came = {n: 0.0 for n in sources}, {}
    leaving: dict = {}
    for e in edges:
        leaving.setdefault(e[0], []).append(e)
    for n in sorted(order, key=lambda n: (order[n], n)):
        if n in best:
            for e in leaving.get(n, ()):
                if best[n] + e[2] > best.get(e[1], float("-inf")):
                    best[e[1]], came[e[1]] = best[n] + e[2], e
    reached = [n for n in best if n in targets and n in came] or [n for n in best if n in came]
    if not reached:
        return []
    at, path = min(reached, key=lambda n: (-best[n], n)), []
    while at in came and len(path) <= len(came):
        path.append(came[at])
        at = came[at][0]
    return path[::-1]


class Network:
    """One site's network: nodes that its links' ends make, edges along its main axis, and where its trunks start and end."""

    def __init__(self, links: pd.DataFrame, tolerance: float) -> None:
        links = links.sort_values("link")
        self.links, n = links["link"].tolist(), len(links)
        x, y = (np.concatenate([links[c + "0"].to_numpy(float), links[c + "1"].to_numpy(float)]) for c in "xy")
        node = joined(x, y, tolerance)
        self.size = int(node.max()) + 1 if n else 0
        count = np.maximum(np.bincount(node, minlength=self.size), 1)
        at = np.stack([np.bincount(node, v, self.size) / count for v in (x, y)])
        known = np.isfinite(at).all(0)
        self.axis = np.array([1.0, 0.0])
        self.p = at[0]
        if known.sum() >= 2:
            middle = at[:, known].mean(1, keepdims=True)
            (xx, xy), (_, yy) = np.cov(at[:, known])
            angle = 0.5 * np.arctan2(2 * xy, xx - yy)
            self.axis = np.array([np.cos(angle), np.sin(angle)]) * (-1 if np.cos(angle) < 0 else 1)
            self.p = self.axis @ (at - middle)
        #: (from, to, weight, link, against its direction), from the lower to the higher place along the axis.
        self.edges = []
        for link, a, b, w in zip(self.links, node[:n].tolist(), node[n:].tolist(), links["w"].tolist(), strict=True):
            if abs(self.p[a] - self.p[b]) >= 1e-9:  # false if either is unknown
                back = bool(self.p[a] > self.p[b])
                self.edges.append((b, a, w, link, back) if back else (a, b, w, link, back))
        self.sources = self._edge_of({e[0] for e in self.edges}, 5, False)
        self.targets = self._edge_of({e[1] for e in self.edges}, 95, True)

    def _edge_of(self, nodes: set[int], percent: float, high: bool) -> set[int]:
        """Of the nodes those beyond a percentile of their places; without any, all nodes."""
        nodes = sorted(nodes)
        if not nodes:
            return set(range(self.size))
        p = self.p[nodes]
        limit = np.percentile(p, percent)
        return {n for n, v in zip(nodes, p.tolist(), strict=True) if (v >= limit if high else v <= limit)}

    def trunks(self, count: int) -> list[list[tuple]]:
        """Up to `count` paths, each the heaviest of the edges that those before left."""
        left, out = self.edges, []
        while len(out) < count and (path := longest_path(left, dict(enumerate(self.p.tolist())), self.sources, self.targets)):
            used = {e[3] for e in path}
            left = [e for e in left if e[3] not in used]
            out.append(path)
        return out


def joined(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """A number for each point: the same for those that steps of at most the tolerance join, by first appearance.

    Points are put in squares so small that all of one square are joined; only the first point of each run meets others."""
    n = len(x)
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    if tolerance > 0:
        side = tolerance / np.sqrt(2)
        squares: dict[tuple, list[int]] = {}
        for i in np.flatnonzero(np.isfinite(x) & np.isfinite(y)).tolist():
            squares.setdefault((int(x[i] // side), int(y[i] // side)), []).append(i)
        for (cx, cy), mine in squares.items():
            for i in mine[1:]:
                up[root(i)] = root(mine[0])
            for dx, dy in ((a, b) for a in range(-2, 3) for b in range(-2, 3) if (a, b) > (0, 0)):
                other = squares.get((cx + dx, cy + dy))
                if other and root(other[0]) != root(mine[0]):
                    d2 = (x[mine][:, None] - x[other]) ** 2 + (y[mine][:, None] - y[other]) ** 2
                    if (d2 <= tolerance * tolerance).any():
                        up[root(other[0])] = root(mine[0])
    roots: dict[int, int] = {}
    return np.array([roots.setdefault(root(i), len(roots)) for i in range(n)], int)


def paths(links: DataFrame, site: str, tolerance: float, count: int, least: float = 0.0) -> DataFrame:
    """(site, trunk, pos, link, reversed, w) of up to `count` trunks of each site's links (link, x0, y0, x1, y1, w): which links
    a trunk passes, in order, and which against their direction. One shorter than `least` is left out after its edges are
    gone, so that numbers keep gaps. A network is one task's: it has hundreds of links, however many sites there are."""
    types = dict(links.dtypes)
    schema = f"{site} {types[site]}, trunk int, pos int, link {types['link']}, reversed boolean, w double"

    def one(p: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for k, path in enumerate(Network(p, tolerance).trunks(count), 1):
            if sum(e[2] for e in path) >= least:
                rows += [(p[site].iloc[0], k, pos, e[3], e[4], e[2]) for pos, e in enumerate(path, 1)]
        return pd.DataFrame(rows, columns=[site, "trunk", "pos", "link", "reversed", "w"])

    return links.groupBy(site).applyInPandas(one, schema)


def diagnostics(links: DataFrame, site: str, tolerance: float, count: int) -> DataFrame:
    """A row a site: its links, nodes, edges, trunks, sources and targets, and the direction of its main axis."""
    names = ["n_links", "n_nodes", "n_edges", "n_trunks", "n_sources", "n_targets"]
    schema = f"{site} {dict(links.dtypes)[site]}, {', '.join(f'{c} long' for c in names)}, axis_x double, axis_y double"

    def one(p: pd.DataFrame) -> pd.DataFrame:
        n = Network(p, tolerance)
        counts = (len(n.links), n.size, len(n.edges), len(n.trunks(count)), len(n.sources), len(n.targets))
        return pd.DataFrame([(p[site].iloc[0], *counts, *n.axis.tolist())], columns=[site, *names, "axis_x", "axis_y"])

    return links.groupBy(site).applyInPandas(one, schema)


def criterion(trunks: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """By group: trunks, their effective number, and the shares of the largest one, two and three; NULL where there are fewer."""
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(0.0)
    total = F.sum(w).over(Window.partitionBy(*keys))
    rows = trunks.withColumn("_p", w / F.nullif(total, F.lit(0.0))).filter("_p IS NOT NULL")
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_p"))))
    top = lambda k: F.when(F.count("*") >= k, F.sum(F.when(F.col("_k") <= k, F.col("_p"))))
    return rows.groupBy(*keys).agg(F.count("*").alias("trunks"), (1 / F.sum(F.col("_p") * F.col("_p"))).alias("n_eff"), *[top(k).alias(f"top{k}") for k in (1, 2, 3)])


def concatenated(path: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples (link, i, s, b, c, m) along trunks (keys, pos, link, reversed), numbered by j: arc length goes on from link to
    link, a link passed against its direction is mirrored with c and m negated, and the first sample of every later link goes."""
    span = samples.groupBy("link").agg(F.min("s").alias("s0"), F.max("s").alias("s1"))
    links = path.select(*keys, "pos", "link", "reversed").join(span, "link").withColumn("length", F.col("s1") - F.col("s0"))
    w = Window.partitionBy(*keys).orderBy("pos")
    links = links.withColumn("offset", F.sum("length").over(w) - F.col("length"))
    rows = links.join(samples, "link")
    back = F.col("reversed")
    at = F.when(back, F.col("s1") - F.col("s")).otherwise(F.col("s") - F.col("s0"))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "pos").orderBy(F.when(back, -F.col("i")).otherwise(F.col("i"))))).filter((F.col("pos") == 1) | (F.col("_k") > 1))
    rows = rows.withColumn("j", F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "_k")))
    sign = F.when(back, -1.0).otherwise(1.0)
    return rows.select(*keys, "pos", "link", "j", (F.col("offset") + at).alias("s"), "b", (sign * F.col("c")).alias("c"), (sign * F.col("m")).alias("m"))


def shares(rows: DataFrame, name: str, weight: str) -> DataFrame:
    """Weights as shares in descending order, their running sum, and the effective number 1 / sum of squared shares."""
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(0.0)
    total = rows.agg(F.sum(w).alias("total"))
    p = rows.crossJoin(F.broadcast(total)).filter("total > 0").select(name, (w / F.col("total")).alias("p"))
    # One row a trunk: a handful.
    order = Window.orderBy(F.desc("p"), name)
    return p.select(name, "p", F.row_number().over(order).alias("rank"), F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("top"), (1 / F.sum(F.col("p") * F.col("p")).over(Window.partitionBy())).alias("n_eff"))
