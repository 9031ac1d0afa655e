"""Results that several later steps read, written once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the folder of ``spark.checkpoint.dir`` and read
    again, so that later steps read only their columns and a lost executor costs
    one task. Where it is unset, in local mode, a temporary folder is used.

    Joins with the table are merges: Spark takes the bytes of its files for its size,
    and rows that repeat from document to document shrink to a hundredth there, so
    that tables which grow with the corpus would be gathered in the driver for a broadcast."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="foliant-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/foliant/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")
