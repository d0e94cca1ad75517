"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; one of our own only in local mode where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Tables:
    """Tables that cut lineage and survive lost executors; what isn't released goes when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self.release(*[t for t, _ in self.paths])

    def stored(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def kept(self, df: DataFrame) -> DataFrame:
        """``df`` written and read back; it stays when the block ends, for results that are read later."""
        out = self.stored(df)
        self.paths.pop()
        return out

    def release(self, *tables: DataFrame) -> None:
        gone = [path for t, path in self.paths if any(t is x for x in tables)]
        self.paths = [(t, path) for t, path in self.paths if path not in gone]
        for path in gone:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
