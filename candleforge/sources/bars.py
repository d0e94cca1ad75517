"""Candles from ticks: an aggregation by symbol and bar start, in whole epoch units, so it needs no time zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECONDS = {"15m": 900, "1H": 3_600, "4H": 14_400, "1D": 86_400}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, us (epoch microseconds), seq, price and size; one event is one tick of its type's symbol."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("size"),
    )


def resample(tick_rows: DataFrame, seconds: int, offset: int = 0) -> DataFrame:
    """Bars of ``seconds``, whose starts are ``offset`` seconds after multiples of it; bars without ticks don't exist.

    First and last price go by (time, arrival). The aggregation is partial before its one shuffle.
    """
    start = F.floor((F.col("us") - offset * 1_000_000) / (seconds * 1_000_000)).cast("long") * seconds + offset
    order = F.struct("us", "seq")
    return (
        tick_rows.withColumn("t", start)
        .groupBy("symbol", "t")
        .agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", order).alias("close"), F.sum("size").alias("volume"),
        )
    )


def bars(spark: SparkSession, sf_dir: str, timeframe: str = "1H") -> DataFrame:
    return resample(ticks(spark, sf_dir), SECONDS[timeframe])


def bars_sql(timeframe: str = "1H", offset: int = 0) -> str:
    """DuckDB text of the same bars, a parenthesised subquery."""
    s = SECONDS[timeframe]
    start = f"((epoch_us(ts) - {offset * 1_000_000}) // {s * 1_000_000}) * {s} + {offset}"
    return (
        f"(SELECT symbol, t, arg_min(price, (us, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (us, seq)) AS close, "
        f"CAST(count(*) AS DOUBLE) AS volume FROM (SELECT event_type AS symbol, CAST({start} AS BIGINT) AS t, epoch_us(ts) AS us, event_id AS seq, "
        f"value AS price FROM events) GROUP BY symbol, t)"
    )
