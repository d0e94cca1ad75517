"""Packing of documents into sequences of fixed length by minimum bin slack.

One pass encodes each text, closes it with an end token and cuts what is longer than a sequence into pieces, of which the
first takes the remainder. What packing needs to know of the pieces is how many there are of each length, a table of at
most ``capacity`` rows whatever the corpus. Over it, bins are filled one after the other: a bin takes the longest piece
left and then, by subset sums in a bitset over the available lengths, the fullest feasible combination, of equally full
ones that with the longest pieces. A combination is used as often as the counts allow, as it stays the fullest while it
is feasible, so there are a few thousand combinations at most. Pieces are numbered within their length, by each task as
it writes them and by a sum of the tasks before it, so that a length that a third of all pieces have is no single group.
A piece's length and number give its sequence and its place there.

Defined results: null and empty texts are the end token alone; ids may be null or repeat, as each row is packed by itself;
texts of any length are encoded whole; pieces of equal length are taken in the order of tasks and rows; an empty table
gives an empty result; columns besides id and text are left out, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candleforge.llm.common import Scratch, map_arrow, stored, table, text_or_empty
from candleforge.llm.vocabularies import byte_vocabulary

VOCABULARY = "byte_bpe_50k.json"
CAPACITY, END_ID = 2048, 0

#: Of a combination: its lengths with their numbers, longest first, and how often it is used.
Combination = tuple[list[tuple[int, int]], int]


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens; the first takes the remainder."""
    first = n % capacity or capacity
    return [(0, first)] + [(start, capacity) for start in range(first, n, capacity)]


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The combination of pieces of most total length within ``room``; of equals, that with the longest pieces."""
    lengths = sorted(x for x in counts if x <= room)
    mask, reach, sums = (1 << (room + 1)) - 1, [1], 1
    for x in lengths:
        left, step = min(counts[x], room // x), 1
        while left:
            step = min(step, left)
            sums |= sums << (x * step) & mask
            left, step = left - step, 2 * step
        reach.append(sums)
    total, out = sums.bit_length() - 1, []
    for i in range(len(lengths) - 1, -1, -1):
        x = lengths[i]
        n = next(n for n in range(min(counts[x], total // x), -1, -1) if reach[i] >> (total - n * x) & 1)
        if n:
            out.append((x, n))
            total -= n * x
    return out


def combinations(counts: dict[int, int], capacity: int = CAPACITY) -> list[Combination]:
    """Combinations that use up all pieces, each bin the fullest with the longest piece left."""
    left, out = {x: n for x, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        uses = Counter({longest: 1}) + Counter(dict(fullest({x: n for x, n in rest.items() if n}, capacity - longest)))
        times = min(left[x] // n for x, n in uses.items())
        for x, n in uses.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((sorted(uses.items(), reverse=True), times))
    return out


def _encoded(df: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int) -> DataFrame:
    """A row a piece, with the task that made it and its number among the task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, met = byte_vocabulary(vocabulary).encode, Counter()
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        for batch in batches:
            of, rows = [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.array([*encode(text.as_py()), END_ID], "<u4")
                for piece, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    of.append(i)
                    rows.append((piece, start, length, zlib.crc32(ids[start : start + length]), task, met[length]))
                    met[length] += 1
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of)), *columns], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def _placed(pieces: DataFrame, plan: list[Combination]) -> DataFrame:
    """``pieces`` with the sequence and the offset that their length and number give."""
    spans: dict[int, list[tuple[int, int, int, int]]] = {}
    used, sequence = Counter(), 0
    for uses, times in plan:
        offset = 0
        for length, n in uses:
            spans.setdefault(length, []).append((used[length], sequence, n, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    # A row for each length of each combination: some thousands, bounded by the capacity.
    known = {length: np.array(rows, np.int64).T for length, rows in spans.items()}

    def batch_places(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, nth = (batch.column(c).to_numpy() for c in ("length", "nth"))
        sequences, offsets = np.empty(len(nth), np.int64), np.empty(len(nth), np.int64)
        for x in np.unique(length):
            of = np.flatnonzero(length == x)
            begin, first, n, offset = known[x][:, np.searchsorted(known[x][0], nth[of], "right") - 1]
            turn, slot = np.divmod(nth[of] - begin, n)
            sequences[of], offsets[of] = first + turn, offset + slot * x
        kept = [c for c in batch.schema.names if c != "nth"]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequences), pa.array(offsets)], [*kept, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name != "nth")
    return map_arrow(pieces, batch_places, f"{fields}, sequence_id long, offset long")


def pack_documents(df: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    # Its rows are read again when the result is, so this table stays in the shared folder.
    pieces = stored(_encoded(df, id_col, text_col, vocabulary, capacity))
    with Scratch(df.sparkSession) as own:
        per_task = own.stored(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
        before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
        starts = stored(per_task.select("length", "task", before.alias("before")))
        # As many rows as there are lengths.
        counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    numbered = pieces.join(starts, ["length", "task"]).withColumn("nth", F.col("nth") + F.col("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return _placed(numbered.select(*columns, "nth"), combinations(counts, capacity))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
