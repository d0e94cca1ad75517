"""Fuzzy line deduplication.

Lines of the whole corpus are compared, and of each group of equal or similar lines the first, by document and line
number, stays. Equal lines meet in one aggregation of their 128-bit hashes. Each line's character shingles, the same
that are compared in the end, are hashed and sorted: the least of them are a MinHash signature, and runs of neighbouring
values in it are the bands. A run is in both lines if all of its values are in both sets. Lines of up to SHORT shingles
use all runs of four on the circle of their values; as sets of Jaccard similarity 0.8 or more differ in at most a fifth
of their union, and one element breaks at most four of the runs of four, a fifth of these is whole in both, and no such
pair is missed. Longer lines use runs of RUN among their SIGNATURE least values, one of PICK of them by the run's first
value, or all where the line has no more values than that: about 18, of which a pair at similarity 0.8 shares four or
five, and none with a probability of about 0.015. Lines that share a band are proposed, and confirmed if their sets have
a Jaccard similarity of 0.8 or more; with a lower ``percent`` fewer of the pairs are proposed. Components of confirmed
links are found by a distributed union-find.

Signatures, bands and sets are worked out by numpy on Arrow batches; all joins and groupings are DataFrame operations.
The form in DataFrame functions alone took 896 CPU seconds a GB and more, of a budget of 400 (see README).

Defined results: null and empty texts have no lines; lines without a word stay and are compared with nothing; lines of
any length are compared whole; a text of which no line stays becomes empty, and its row stays; rows that share an id
count as one document, so a line in both isn't removed from either for the other's sake; rows with a null id keep their
text; of different lines with one 64-bit hash, one takes part in the search for similar ones; an empty table gives an
empty result; columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.llm.common import Scratch, in_a_row, in_ranges, map_arrow, range_bits, stored, table
from candleforge.llm.graph import linked_components
from candleforge.llm.shingles import BASE, mixed, slices

SPACES = " \t\n\x0b\x0c\r"
#: Characters (UTF-16 units) of the shingles.
SHINGLE = 5
PERCENT = 80
#: Lines of up to this many shingles use all of their runs of four; those of up to a quarter more use both kinds.
SHORT = 28
#: Of longer lines: values of a run, runs looked at, and one of how many of these is used.
RUN, SIGNATURE, PICK = 6, 72, 4
#: Bands of a line, about.
BANDS = 21
#: Bytes of lines that are hashed at once, so that work arrays stay near the processor; longer lines go alone.
SLICE = 1 << 20
#: Stands after the last value of a row; no shingle has it as its hash.
END = np.uint64(0xFFFFFFFFFFFFFFFF)


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, pos, line and its hashes, of each line that has a word."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line")).filter(F.col("doc_id").isNotNull())
    rows = rows.filter(F.btrim("line", F.lit(SPACES)) != "")
    return rows.withColumns({"h": F.xxhash64("line"), "h2": F.xxhash64(F.lit("line"), "line")})


def shingle_hashes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each of the lines' character shingles, repeated ones included, and the offset at which each line's begin.

    A shorter line is its own shingle. Lines hold no \\n.
    """
    data = b"".join(x + b"\n" for x in lines.cast(pa.large_binary()).to_pylist())
    units = np.frombuffer(data.decode("utf-8", "replace").encode("utf-16-le"), np.uint16)
    ends = np.flatnonzero(units == 10)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])[: len(ends)]
    n = ends - starts
    counts = np.maximum(n - SHINGLE + 1, 1)
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    padded = np.concatenate([units, np.zeros(SHINGLE, np.uint16)]).astype(np.uint64)
    sums = padded[: len(units)].copy()
    for k in range(1, SHINGLE):
        sums *= np.uint64(BASE)
        sums += padded[k : len(units) + k]
    out = sums[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], counts)]
    short = np.flatnonzero(n < SHINGLE)
    own = np.zeros(len(short), np.uint64)
    for k in range(SHINGLE):
        # No unit has this value, so a shorter line equals no shingle.
        own = own * np.uint64(BASE) + np.where(k < n[short], padded[starts[short] + k], np.uint64(1 << 16))
    out[offsets[short]] = own
    return np.minimum(mixed(out), END - np.uint64(1)), offsets


def alike(widths: np.ndarray, cells: int = 1 << 18) -> Iterator[tuple[np.ndarray, int]]:
    """Places of rows of about the same width, about ``cells`` values at once, and the greatest width."""
    order = np.argsort(widths, kind="stable")
    ordered = widths[order]
    at = 0
    while at < len(order):
        end = int(np.searchsorted(ordered, ordered[at] * 5 // 4 + 8, side="right"))
        end = min(end, at + max(1, cells // max(int(ordered[end - 1]), 1)))
        yield order[at:end], int(ordered[end - 1])
        at = end


def matrix_of(hashes: np.ndarray, offsets: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """The sorted hashes of each of ``rows``, followed by END."""
    at = np.arange(width)
    out = hashes[np.minimum(offsets[rows][:, None] + at, len(hashes) - 1)]
    out[at >= (offsets[rows + 1] - offsets[rows])[:, None]] = END
    out.sort(axis=1)
    return out


def without_repeats(rows: np.ndarray) -> np.ndarray:
    """Sorted rows with one of each value."""
    again = np.zeros(rows.shape, bool)
    again[:, 1:] = (rows[:, 1:] == rows[:, :-1]) & (rows[:, 1:] != END)
    out = np.where(again, END, rows)
    some = again.any(axis=1)
    out[some] = np.sort(out[some], axis=1)
    return out


def least_hashes(hashes: np.ndarray, offsets: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """The least distinct hashes of each of ``rows``, as many as bands use, followed by END."""
    most = SIGNATURE + RUN - 1
    values = matrix_of(hashes, offsets, rows, width)
    out = without_repeats(values[:, : 2 * most])
    if width > 2 * most:
        few = (out[:, most - 1] == END) & (values[:, 2 * most] != END)
        for i in np.flatnonzero(few):
            own = np.unique(values[i])[:most]
            out[i] = END
            out[i, : len(own)] = own
    return out[:, :most]


def bands_of(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands of lines, and the line of each."""
    keys, lines = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for rows, width in alike(np.diff(offsets)):
        least = least_hashes(hashes, offsets, rows, width)
        n = (least != END).sum(axis=1)
        at = np.arange(least.shape[1])

        def add(used: np.ndarray, size: int, circle: bool) -> None:
            i, first = np.nonzero(used)
            key = np.full(len(i), size, np.uint64)
            for k in range(size):
                place = (first + k) % n[i] if circle else first + k
                key = mixed(key * np.uint64(BASE) + least[i, place])
            keys.append(key)
            lines.append(rows[i])

        inside = at < n[:, None]
        add(inside & (4 * n <= 5 * SHORT)[:, None], 4, True)
        picked = (n < SIGNATURE)[:, None] | (least % np.uint64(PICK) == 0)
        add(inside & (at + RUN <= n[:, None]) & (n > SHORT)[:, None] & picked, RUN, False)
    return np.concatenate(keys), np.concatenate(lines)


def own_bands(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of a batch's lines (h, line): their h, the keys of their bands, and the place of each key's line in the run.

    A hash that the batch repeats is taken once.
    """
    h = batch.column("h").to_numpy()
    new = np.sort(np.unique(h, return_index=True)[1])
    texts, done = batch.column("line").take(pa.array(new)), 0
    for run in slices(texts, SLICE):
        yield h[new[done : done + len(run)]], *bands_of(*shingle_hashes(run))
        done += len(run)


def with_bands(lines: DataFrame) -> DataFrame:
    """h and the keys of its ``bands`` of each line (h, line); a hash that a batch repeats is taken once."""

    def batch_bands(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for h, keys, of in own_bands(batch):
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(len(h) + 1)).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[order].view(np.int64)))
            out.append(pa.RecordBatch.from_arrays([pa.array(h), bands], ["h", "bands"]))
        return pa.Table.from_batches(out)

    return map_arrow(lines.select("h", "line"), batch_bands, "h long, bands array<long>")


def shared_bands(lines: DataFrame, n: int) -> DataFrame:
    """node and key, once each, of the bands that two or more different h of ``lines`` (h, line; about ``n`` of them) have.

    Nearly all bands have one line. So they go to ranges of keys as lists, and only those that meet another become rows.
    """
    bits = range_bits(n * BANDS)

    def ranges(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs = [(keys, h[of]) for h, keys, of in own_bands(batch)]
        keys, nodes = (np.concatenate(x) for x in zip(*runs, strict=True))
        return in_ranges(keys, bits, {"keys": pa.array(keys.view(np.int64)), "nodes": pa.array(nodes)})

    def meeting(rows: pa.Table) -> pa.Table:
        keys, nodes = (in_a_row(rows.column(c)).to_numpy() for c in ("keys", "nodes"))
        order = np.argsort(keys)
        keys, nodes = keys[order], nodes[order]
        for _ in range(2):
            met = np.zeros(len(keys), bool)
            met[1:] = keys[1:] == keys[:-1]
            met[:-1] |= met[1:]
            keys, nodes = keys[met], nodes[met]
            # The same line from several batches is one, and may then be alone.
            order = np.lexsort((nodes, keys))
            keys, nodes = keys[order], nodes[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
            keys, nodes = keys[new], nodes[new]
        return pa.table({"node": nodes, "key": keys})

    packed = map_arrow(lines.select("h", "line"), ranges, "range int, keys array<long>, nodes array<long>")
    return packed.groupBy("range").applyInArrow(meeting, "node long, key long")


def common_sizes(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the sets of hashes of each pair, and of what they share, in three columns."""
    out = np.zeros((len(one[1]) - 1, 3), np.int64)
    for rows, width in alike(np.maximum(np.diff(one[1]), np.diff(two[1]))):
        x, y = (without_repeats(matrix_of(*side, rows, width)) for side in (one, two))
        both = np.sort(np.concatenate([x, y], axis=1), axis=1)
        shared = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != END)).sum(axis=1)
        out[rows] = np.stack([(x != END).sum(axis=1), (y != END).sum(axis=1), shared], axis=1)
    return out


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of lines whose full sets have 100 * intersection >= percent * union."""
    a = texts.select(F.col("h").alias("a"), F.col("line").alias("line_a"))
    b = texts.select(F.col("h").alias("b"), F.col("line").alias("line_b"))

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        done, keep = 0, [np.zeros(0, np.int64)]
        for run in slices(batch.column("line_a"), SLICE):
            other = batch.column("line_b").slice(done, len(run))
            n, m, shared = common_sizes(shingle_hashes(run), shingle_hashes(other)).T
            keep.append(done + np.flatnonzero(100 * shared >= percent * (n + m - shared)))
            done += len(run)
        return batch.select(["a", "b"]).take(pa.array(np.concatenate(keep)))

    rows = pairs.join(a, "a").join(b, "b").select("a", "b", "line_a", "line_b")
    return map_arrow(rows, verify, "a long, b long")


def sets_of(members: DataFrame, texts: DataFrame) -> DataFrame:
    """node, part and the set of the node's shingle hashes."""

    def batch_sets(batch: pa.RecordBatch) -> pa.Table:
        done, out = 0, []
        for run in slices(batch.column("line"), SLICE):
            hashes, offsets = shingle_hashes(run)
            for rows, width in alike(np.diff(offsets)):
                sets = without_repeats(matrix_of(hashes, offsets, rows, width))
                inside = sets != END
                ends = np.r_[0, np.cumsum(inside.sum(axis=1))].astype(np.int32)
                own = batch.select(["node", "part"]).take(pa.array(done + rows))
                out.append(pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(sets[inside].view(np.int64)))], ["node", "part", "set"]))
            done += len(run)
        return pa.Table.from_batches(out)

    own = texts.withColumnRenamed("h", "node").join(members, "node").select("node", "part", "line")
    return map_arrow(own, batch_sets, "node long, part long, set array<long>")


def firsts(df: DataFrame, id_col: str, text_col: str, percent: int, scratch: Scratch) -> DataFrame:
    """h, h2 and the first (doc_id, pos) of the group of equal and similar lines, of each distinct line that isn't alone."""
    lines = lines_of(df, id_col, text_col)
    place = F.struct("doc_id", "pos")
    distinct = scratch.stored(lines.groupBy("h", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    repeated = distinct.filter("n > 1").select("h", "h2", "first")
    met = scratch.stored(shared_bands(lines, distinct.count()))
    if met.isEmpty():
        return repeated
    nodes = scratch.stored(met.select(F.col("node").alias("h")).distinct())
    texts = lines.join(nodes, "h", "left_semi").groupBy("h").agg(F.min_by(F.struct("h2", "line"), "h2").alias("x"))
    texts = scratch.stored(texts.select("h", "x.h2", "x.line"))
    scratch.forget(nodes)
    parts = linked_components(met, lambda pairs: confirmed(pairs, texts, percent), lambda members: sets_of(members, texts), scratch, percent)
    if parts is None:
        return repeated
    parts = parts.withColumnRenamed("node", "h").join(texts.select("h", "h2"), "h")
    grouped = scratch.stored(distinct.join(parts, ["h", "h2"], "left").filter("n > 1 OR component IS NOT NULL"))
    least = scratch.stored(grouped.filter("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("least")))
    return grouped.join(least, "component", "left").select("h", "h2", F.coalesce("least", "first").alias("first"))


def removed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id and removed (line numbers from 0, sorted) of each document that loses lines."""
    with Scratch(df.sparkSession) as scratch:
        first = firsts(df, id_col, text_col, percent, scratch)
        places = lines_of(df, id_col, text_col).select("doc_id", "pos", "h", "h2")
        gone = places.join(first, ["h", "h2"]).filter(F.struct("doc_id", "pos") != F.col("first"))
        return stored(gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("removed")))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``df`` with the removed lines cut from its texts."""
    gone = removed_lines(df, id_col, text_col, percent).select(F.col("doc_id").alias("_gone_id"), F.col("removed").alias("_gone"))
    lines = F.split(F.col(text_col), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    text = F.array_join(F.transform(F.array(lines), lambda a: F.transform(left, lambda i: F.get(a, i)))[0], "\n")
    joined = df.join(gone, F.col(id_col) == F.col("_gone_id"), "left")
    return joined.withColumn(text_col, F.when(F.col("_gone").isNotNull(), text).otherwise(F.col(text_col))).select(*df.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: doc_id, lines with a word, how many of these go, and their numbers from 0, comma-joined."""
    docs = table(spark, sf_dir, "documents")
    n_lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    counted = docs.select("doc_id", F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    return counted.join(removed_lines(docs), "doc_id", "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join(F.coalesce("removed", none).cast("array<string>"), ",").alias("removed_lines"),
    )
