"""Live operators on Structured Streaming: closed bars and position monitoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Ticks that are walked, and whose positions are handed on, at a time.
SLICE = 10_000


def tick_stream(spark: SparkSession, folder: str, files: str) -> DataFrame:
    """Ticks from the event files of a folder as they arrive; they have no other schema than their own."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)
    return rows.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"))


def closed_bars(ticks: DataFrame, width: str, delay: str) -> DataFrame:
    """Bars that the watermark has passed; later ticks of theirs are dropped."""
    order = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "symbol")
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("n"))
        .select("symbol", F.unix_timestamp("window.start").alias("t"), "open", "high", "low", "close", "n")
    )


def _joined(pieces: list[np.ndarray]) -> np.ndarray:
    """The pieces as one array; they go."""
    out = np.concatenate(pieces)
    pieces.clear()
    return out


def positions(symbol: str, batches: Iterator[pd.DataFrame], state: GroupState, tp: float, sl: float, most_ticks: int) -> Iterator[pd.DataFrame]:
    """Positions of a symbol's new ticks. Of these only time, number and price are held, 24 bytes a tick, as they come in no
    order; their positions leave by slices."""
    entry, held = state.get if state.exists else (0.0, 0)
    ts, seq, price = [], [], []
    for rows in batches:
        for pieces, name in ((ts, "ts"), (seq, "seq"), (price, "price")):
            pieces.append(np.array(rows[name]))
    ts, seq, price = _joined(ts), _joined(seq), _joined(price)
    order = np.lexsort((seq, ts))
    del seq
    for start in range(0, len(order), SLICE):
        own, out = order[start : start + SLICE], []
        for i, now in zip(own.tolist(), price[own].tolist(), strict=True):
            if entry <= 0:
                entry, held = float(now), 0
                continue
            held += 1
            move = (now / entry - 1) * 100
            reason = "TP" if move >= tp else "SL" if move <= -sl else "TIMEOUT" if held >= most_ticks else None
            if reason:
                out.append((symbol, entry, float(now), reason, held, i))
                entry, held = 0.0, 0
        found = pd.DataFrame(out, columns=["symbol", "entry", "exit", "reason", "held", "ts"])
        yield found.assign(ts=ts[found["ts"].to_numpy(dtype=np.int64)])
    state.update((entry, held))


def monitor(ticks: DataFrame, tp: float, sl: float, most_ticks: int) -> DataFrame:
    """Simulated positions: one a symbol, opened at its first free tick and closed by target, stop or count, in this order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from positions(key[0], batches, state, tp, sl, most_ticks)

    return ticks.groupBy("symbol").applyInPandasWithState(
        step, "symbol string, entry double, exit double, reason string, held long, ts timestamp", "entry double, held long", "append", GroupStateTimeout.NoTimeout
    )


def drain(stream: DataFrame, name: str, path: str, mode: str = "append") -> DataFrame:
    """All that the stream gives for the files that are there now, written by its own sink and read back."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{name}")
