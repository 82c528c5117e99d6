"""Writing an intermediate table once, in the folder shared by the cluster."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset: a temporary folder in local mode (tests), an error on a
    cluster, whose machines do not share one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("claimloom.test.folder", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("claimloom.test.folder", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: a cut in lineage that survives lost executors.

    For tables that several later branches read, where computing them again would cost
    more than one write.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
