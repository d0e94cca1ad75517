"""One-to-one matches in time order."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_to_one(later: DataFrame, earlier: DataFrame, interval: int, key: str = "key", at: str = "at", name: str = "id") -> DataFrame:
    """(later_id, earlier_id): each of ``later``, by time and id, takes the first of ``earlier`` that is still free.

    Both have key, at (whole units of time) and id; a match is at most ``interval`` before its taker, or at the same time.
    Rows without a match, or with a null key or time, are left out. A key is cut where no event falls into a whole
    bucket of ``interval``, as nothing is matched across: a bucket a row decides that, not the events. Tasks read runs in
    order and hold only what is still free and not yet too old, however many events a run has.
    """
    side = lambda rows, kind: rows.select(F.col(key).alias("key"), F.col(at).cast("long").alias("at"), F.lit(kind).alias("kind"), F.col(name).cast("long").alias("id"))
    events = side(earlier, 0).unionByName(side(later, 1)).filter("key IS NOT NULL AND at IS NOT NULL")
    events = events.withColumn("bucket", F.floor(F.col("at") / max(interval, 1)))
    buckets = events.select("key", "bucket").distinct()
    order = Window.partitionBy("key").orderBy("bucket")
    starts = F.coalesce(F.col("bucket") - F.lag("bucket").over(order) > 1, F.lit(True)).cast("int")
    runs = buckets.withColumn("starts", starts).withColumn("run", F.sum("starts").over(order)).select("key", "bucket", "run")
    ordered = events.join(runs, ["key", "bucket"]).repartition("key", "run").sortWithinPartitions("key", "run", "at", "kind", "id")

    def matched(batches):
        free, now = deque(), None
        for batch in batches:
            takers, taken = [], []
            for k, run, t, kind, i in zip(*[batch.column(c).to_pylist() for c in ("key", "run", "at", "kind", "id")], strict=True):
                if (k, run) != now:
                    free, now = deque(), (k, run)
                if kind == 0:
                    free.append((t, i))
                    continue
                while free and free[0][0] < t - interval:
                    free.popleft()
                if free:
                    takers.append(i)
                    taken.append(free.popleft()[1])
            yield pa.RecordBatch.from_arrays([pa.array(takers, pa.int64()), pa.array(taken, pa.int64())], ["later_id", "earlier_id"])

    return ordered.select("key", "run", "at", "kind", "id").mapInArrow(matched, "later_id long, earlier_id long")
