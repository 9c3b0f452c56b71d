"""Tables between the rounds of an iteration."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame

#: Bytes of tables that are worth a collection of the driver's garbage.
LARGE = 4_000_000


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as Parquet in the folder of ``spark.checkpoint.dir``, read back: lineage ends there. Only a local session without one gets a folder of its own."""
    spark, schema = df.sparkSession, df.schema
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-stratus-")
    path = f"{folder.rstrip('/')}/stratus-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.saved_at = path
    return out


def over(*tables: DataFrame | None) -> None:
    """Deletes tables of :func:`saved` that no later step reads; if they are large, lets Spark delete its shuffle files too, which it keeps while the driver holds their plans."""
    size = 0
    for df in tables:
        if path := getattr(df, "saved_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            files = at.getFileSystem(spark._jsc.hadoopConfiguration())
            size += files.getContentSummary(at).getLength()
            files.delete(at, True)
    if size > LARGE:
        gc.collect()
        spark._jvm.System.gc()
