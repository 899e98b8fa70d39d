"""Checkpoints and tables in the folder that the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset one in the warehouse, which must then be one that executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = sc.getConf().get("spark.checkpoint.dir")
        if not place:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            if not sc.master.startswith("local") and (warehouse.startswith("file:") or "://" not in warehouse):
                raise ValueError("spark.checkpoint.dir is not set, and the warehouse is a folder of one machine")
            place = f"{warehouse}/_checkpoints"
        sc.setCheckpointDir(place)
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df, computed once, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def replace(spark: SparkSession, old: str, new: str) -> None:
    """The folder new takes the place of old."""
    remove(spark, old)
    path = spark._jvm.org.apache.hadoop.fs.Path
    path(new).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(new), path(old))
