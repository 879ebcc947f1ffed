"""Written intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(frame: DataFrame) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset and driver and executors are one process, a temporary one."""
    spark = frame.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        root = f"file://{tempfile.gettempdir()}/lectern-work"
    return root.rstrip("/")


def keep(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written and read back, so that its lineage ends; the table goes when the application ends."""
    spark, path = frame.sparkSession, f"{shared_folder(frame)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(frame.schema).parquet(path)
