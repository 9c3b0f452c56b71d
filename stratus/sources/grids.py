"""ESRI ASCII grids as rows (grid, i, j, x, y, value); j = 0 is the southern row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_arc(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    raw = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("grid"), "value")
    head = lambda key: F.regexp_extract("value", rf"(?i){key}\s+(\S+)", 1).cast("double").alias(key)
    body = F.filter(F.split("value", r"\r?\n"), lambda l: l.rlike(r"^\s*[-+0-9.]"))
    lines = raw.select("grid", *(head(k) for k in ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")), F.posexplode(body).alias("row", "line"))
    cells = lines.select("*", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("i", "v"))
    j = (F.col("nrows") - 1 - F.col("row")).cast("int")
    value = F.col("v").cast("double")
    return cells.select("grid", "i", j.alias("j"), (F.col("xllcorner") + F.col("i") * F.col("cellsize")).alias("x"), (F.col("yllcorner") + j * F.col("cellsize")).alias("y"), F.when(value != F.coalesce("nodata_value", F.lit(-9999.0)), value).alias("value"))


def write_arc(cells: DataFrame, path: str, size: float, nodata: float = -9999.0) -> None:
    """One folder of text a grid: header, then a line for each row of cells, the northern one first. Missing cells are nodata."""
    edge = cells.groupBy("grid").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))
    have = cells.groupBy("grid", "j").agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("have"))
    rows = edge.withColumn("j", F.explode(F.sequence("j0", "j1"))).join(have, ["grid", "j"], "left")
    one = lambda i: F.coalesce(F.try_element_at("have", i), F.lit(nodata)).cast("string")
    body = rows.select("grid", (-F.col("j")).cast("long").alias("place"), F.array_join(F.transform(F.sequence("i0", "i1"), one), " ").alias("value"), F.lit(1).alias("part"))
    parts = [F.lit("ncols "), F.col("i1") - F.col("i0") + 1, F.lit("\nnrows "), F.col("j1") - F.col("j0") + 1, F.lit("\nxllcorner "), F.col("x0"), F.lit("\nyllcorner "), F.col("y0"), F.lit(f"\ncellsize {size:g}\nNODATA_value {nodata:g}")]
    head = edge.select("grid", F.lit(0).cast("long").alias("place"), F.concat(*(p.cast("string") for p in parts)).alias("value"), F.lit(0).alias("part"))
    both = head.unionByName(body).repartition("grid").sortWithinPartitions("grid", "part", "place")
    both.select("grid", "value").write.partitionBy("grid").text(path)
