"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the ASCII controls \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode where the session names none."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


#: Spark drops a query's shuffle files when it ends, where this is set; nothing that is written here is read again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: it cuts lineage and survives lost executors."""
    return _written(df)[0]


class Scratch:
    """Tables in the shared folder that are deleted when they have served, at the latest when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.forget(*[t for t, _ in self.tables])

    def stored(self, df: DataFrame) -> DataFrame:
        """``df`` written and read back, until it is forgotten."""
        self.tables.append(_written(df))
        return self.tables[-1][0]

    def forget(self, *tables: DataFrame | None) -> None:
        """Delete the files of tables that this object stored; others, and None, are passed over."""
        gone = [path for t, path in self.tables if any(t is x for x in tables)]
        self.tables = [(t, path) for t, path in self.tables if path not in gone]
        for path in gone:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """``mapInArrow`` of a function of one batch; a batch without rows, or a ``None`` result, is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


#: Values of a range that is searched at once, about.
RANGE = 1 << 18


def range_bits(values: int) -> int:
    """Bits of a hash whose ranges get about RANGE of so many values each."""
    return min(max(values // RANGE, 1).bit_length(), 16)


def in_ranges(hashes: np.ndarray, bits: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A row for each ``range`` (the upper ``bits`` of the values' hashes), with the lists of its values in each column.

    So a value takes the bytes that it has and no row of its own, in a shuffle that brings ranges together.
    """
    own = (hashes >> np.uint64(64 - bits)).astype(np.uint16)
    order, counts = pa.array(np.argsort(own, kind="stable")), np.bincount(own)
    at = np.flatnonzero(counts)
    ends = pa.array(np.r_[0, np.cumsum(counts[at])].astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.ListArray.from_arrays(ends, x.take(order)) for x in columns.values())], ["range", *columns])


def in_a_row(lists: pa.ChunkedArray) -> pa.Array:
    """The values of a column of lists."""
    return lists.combine_chunks().flatten()


#: Bits of the map that ``perhaps_in`` sends to every task, 4 MB; Spark's bitmaps have BITMAP bits a row.
MAP_BITS, BITMAP = 1 << 25, 1 << 15


def perhaps_in(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` without most of those whose ``column`` isn't in ``keys``, and with all that are.

    A bitmap of hashes, of fixed size, is broadcast, so that a join that follows doesn't shuffle rows that meet nothing.
    """
    bit = F.pmod(F.xxhash64(column), F.lit(MAP_BITS)) + 1
    maps = keys.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_map"))
    at = F.bitmap_bit_position(F.col("_bit")).cast("int")
    byte = F.conv(F.hex(F.substring("_map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("_bit", bit).withColumn("_bucket", F.bitmap_bucket_number("_bit")).join(F.broadcast(maps), "_bucket")
    return marked.filter(F.getbit(byte, at % 8) == 1).select(*rows.columns)


def text_or_empty(column: str):
    return F.coalesce(F.col(column), F.lit(""))
