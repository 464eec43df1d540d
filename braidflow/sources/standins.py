"""Relations of the data model, derived from the driver's tables.

Every one is a projection that pushes its columns to the scan; nulls are put in by rule, as the tables have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacements (cell, realization, u, v): pairs of a vector's components, every eleventh missing."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("realization"))
    gone = (F.col("cell") * 31 + F.col("realization")) % 11 == 0
    u, v = (F.element_at("embedding", F.col("realization") * 2 + k).cast("double") for k in (1, 2))
    return rows.select("cell", "realization", F.when(~gone, u).alias("u"), F.when(~gone, v).alias("v"))


VECTOR_OBS = """obs AS (SELECT cell, realization, CASE WHEN (cell * 31 + realization) % 11 <> 0 THEN e[realization * 2 + 1]::DOUBLE END AS u,
  CASE WHEN (cell * 31 + realization) % 11 <> 0 THEN e[realization * 2 + 2]::DOUBLE END AS v
  FROM (SELECT vec_id AS cell, embedding AS e, unnest(range(32)) AS realization FROM embeddings))"""


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples along a curve (link, i, s, x, y, b, m): a user's events in order; b is missing in every seventh.

    x is hours since the first event, y the running sum of values, s the arc length, m the centred value.
    """
    w = Window.partitionBy("link").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("link"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    rows = rows.select("link", "event_id", "value", F.row_number().over(w).alias("i"), ((F.unix_micros("ts") - F.first(F.unix_micros("ts")).over(w)) / 3.6e9).alias("x"), F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("y"))
    v = Window.partitionBy("link").orderBy("i")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(v), 2) + F.pow(F.col("y") - F.lag("y").over(v), 2))
    rows = rows.withColumn("step", F.coalesce(step, F.lit(0.0)))
    return rows.select("link", "i", F.sum("step").over(v.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), "x", "y", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("b"), (F.col("value") - 50).alias("m"))


PROFILE = """base AS (SELECT user_id AS link, event_id, value, row_number() OVER w AS i,
  (epoch_us(ts) - first_value(epoch_us(ts)) OVER w) / 3.6e9 AS x,
  sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS y
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
stepped AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER v, 2) + pow(y - lag(y) OVER v, 2)), 0) AS step FROM base WINDOW v AS (PARTITION BY link ORDER BY i)),
prof AS (SELECT link, i, sum(step) OVER (PARTITION BY link ORDER BY i ROWS UNBOUNDED PRECEDING) AS s, x, y,
  CASE WHEN event_id % 7 <> 0 THEN value END AS b, value - 50 AS m FROM stepped)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"))


POINTS = "pts AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def mask_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Migration (pos, mask, mn) at positions along a curve for each mask: a user's mean of an event type, less 50."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("pos"), F.col("event_type").alias("mask")).agg((F.avg("value") - 50).alias("mn"))


MASK_PROFILE = "mp AS (SELECT user_id AS pos, event_type AS mask, avg(value) - 50 AS mn FROM events GROUP BY ALL)"


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water pixels (layer, r, c, water): days and hours with three events of a type or more."""
    ts = F.col("ts")
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("layer"), (F.dayofmonth(ts) - 1).alias("r"), F.hour(ts).alias("c")).agg(F.count("*").alias("k"))
    return rows.select("layer", "r", "c", F.when(F.col("k") >= 3, 1).otherwise(0).alias("water"))


RASTER = "ras AS (SELECT event_type AS layer, (day(ts) - 1)::INTEGER AS r, hour(ts)::INTEGER AS c, CASE WHEN count(*) >= 3 THEN 1 ELSE 0 END AS water FROM events GROUP BY ALL)"


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflectances (px, year, blue, green, red, nir, swir1, swir2, qa)."""
    e = F.col("embedding")
    names = ["blue", "green", "red", "nir", "swir1", "swir2"]
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 100).alias("px"), (F.col("vec_id") % 3 + 2000).alias("year"), *[F.abs(e[i]).cast("double").alias(n) for i, n in enumerate(names)], (F.col("vec_id") * 7 % 32).alias("qa"))


BANDS = "bands AS (SELECT vec_id % 100 AS px, vec_id % 3 + 2000 AS year, abs(embedding[1])::DOUBLE AS blue, abs(embedding[2])::DOUBLE AS green, abs(embedding[3])::DOUBLE AS red, abs(embedding[4])::DOUBLE AS nir, abs(embedding[5])::DOUBLE AS swir1, abs(embedding[6])::DOUBLE AS swir2, vec_id * 7 % 32 AS qa FROM embeddings)"


def xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_returnflag").alias("g"))


XY = "xy AS (SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS g FROM lineitem)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between months (u, v, w, link): orders to shipments, forward ones only."""
    m = lambda d: F.year(d) * 12 + F.month(d) - 1 - 1992 * 12
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(m("o_orderdate").alias("u"), m("l_shipdate").alias("v"), F.col("l_quantity").alias("w")).filter("u < v")
    return rows.groupBy("u", "v").agg(F.sum("w").alias("w"))


EDGES = "edges AS (SELECT u, v, sum(w) AS w FROM (SELECT (year(o_orderdate) * 12 + month(o_orderdate) - 1 - 1992 * 12)::INTEGER AS u, (year(l_shipdate) * 12 + month(l_shipdate) - 1 - 1992 * 12)::INTEGER AS v, l_quantity AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE u < v GROUP BY u, v)"
