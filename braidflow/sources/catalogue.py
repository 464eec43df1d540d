"""Files, vector layers and sinks of the data model."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from braidflow.functions.columns import overlaps, year_of_tokens

LINK_SAMPLES = T.StructType([T.StructField(n, t) for n, t in [("site", T.StringType()), ("mask_level", T.IntegerType()), ("step_m", T.DoubleType()), ("link_id", T.StringType()), ("sample_in_link", T.IntegerType()), *[(c, T.DoubleType()) for c in ("s", "x", "y", "B", "C", "Mn")]]])
RASTER = T.StructType([T.StructField("site", T.StringType()), T.StructField("mask_level", T.IntegerType()), T.StructField("year", T.IntegerType()), T.StructField("r", T.IntegerType()), T.StructField("c", T.IntegerType()), T.StructField("val", T.ShortType())])


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of the data model with its declared schema; partitions by site, mask_level and year are pruned."""
    return spark.read.schema(schema).parquet(path)


def write_table(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; on one machine alone, where that is unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def raster_sizes(raster: DataFrame, keys: list[str], resolution: float, crs: str) -> DataFrame:
    """Rows, columns, pixels, resolution, reference system and area of each raster."""
    out = raster.groupBy(*keys).agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"), F.count("*").alias("pixels"))
    area = F.round(F.col("height") * F.col("width") * (resolution * resolution) / 1e6, 6)
    return out.select(*keys, "height", "width", "pixels", F.lit(resolution).alias("resolution"), F.lit(crs).alias("crs"), area.alias("area_km2"))


def write_csv(df: DataFrame, path: str) -> None:
    """A report with a header: one file, as reports are small."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Names and sizes of the files of a pattern, without their content, and the year in the name."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(name.alias("file"), "length", year_of_tokens(name).alias("year"))


def reference_raster(files: DataFrame, site: str, file: str, year: str, wanted: int, level: int) -> DataFrame:
    """A site's mask of the year wanted, without a level first, then of the level; else its first file by name."""
    suffix = F.when(F.col(file).endswith("mask.tif"), 0).when(F.col(file).endswith(f"mask{level}.tif"), 1).otherwise(2)
    w = Window.partitionBy(site).orderBy(F.when(F.col(year) == wanted, 0).otherwise(1), suffix, file)
    return files.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(site, file)


def mean_step(files: DataFrame, site: str, file: str) -> DataFrame:
    """Mean years between consecutive files; names without a year are skipped, and 1 if there is no pair."""
    year = F.try_element_at(F.split(F.col(file), "_"), F.lit(2)).try_cast("int")
    rows = files.select(site, year.alias("_y"))
    rows = rows.withColumn("_p", F.lag("_y").over(Window.partitionBy(site).orderBy("_y")))
    return rows.groupBy(site).agg(F.coalesce(F.avg(F.col("_y") - F.col("_p")), F.lit(1.0)).alias("dt"))


def exploded_lines(lines: DataFrame, key: str, parts: str) -> DataFrame:
    """(link, seq, x, y) of lines of one or more parts; parts after the first have their number at the link's name, and
    lines without geometry are skipped."""
    rows = lines.select(F.col(key).cast("string").alias("_id"), F.posexplode(parts).alias("_p", "_line")).filter("_line IS NOT NULL")
    link = F.when(F.col("_p") == 0, F.col("_id")).otherwise(F.concat_ws("_", "_id", F.col("_p").cast("string")))
    rows = rows.select(link.alias("link"), F.posexplode("_line").alias("seq", "_v"))
    return rows.select("link", "seq", F.col("_v.x").alias("x"), F.col("_v.y").alias("y"))


def polygon_boxes(rings: DataFrame, key: str, view: tuple[float, float, float, float], least: int = 3) -> DataFrame:
    boxes = rings.groupBy(key).agg(F.count("*").alias("n"), F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))
    return boxes.filter((F.col("n") >= least) & overlaps("xmin", "xmax", "ymin", "ymax", *view))
