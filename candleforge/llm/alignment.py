"""Alignment of two tokenizers over the same bytes, and counts of the id pairs that end together.

A worker encodes a few megabytes of texts with both tokenizers into Arrow lists, and all else is Arrow kernels: lists are
flattened with their parents' indices, token lengths are taken from a table of the vocabulary, and their cumulative sum,
less that at the document's start, gives each token's end. One Acero hash join on document and end gives the links,
``Table.group_by`` each document's distinct id pairs with their numbers. Those are written, a row a document, so that
nothing is encoded twice. A second pass sums pairs by ``Table.group_by`` within each task, and Spark merges these partial
counts. A third looks the counts up: up to ``broadcast_pairs`` distinct pairs go to the workers as one sorted table;
beyond that the documents' pairs are shuffled to the counts, where AQE splits frequent pairs, and summed by row again.

A text is aligned if the joined bytes of either side are a space and the text; where the two differ, in null and in
empty texts, there are no tokens: all numbers are 0 and the digest is ''.

Defined results: texts of any length are encoded whole, in memory that grows with the longest; ids may be null or repeat,
as each row is counted by itself; ties of counts are all best; an empty table gives an empty result; columns besides id
and text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.llm.common import Scratch, stored, table
from candleforge.llm.vocabularies import byte_vocabulary, piece_vocabulary

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of texts that are aligned at once; a longer text goes alone.
SLICE = 1 << 20
#: Distinct pairs, of 17 bytes each, that are broadcast at most.
BROADCAST_PAIRS = 3_000_000
#: Distinct pairs that a task sums before it hands them on.
FLUSH = 1_000_000
#: Bits of the second id in a pair's code, and of an end in a token's key.
ID_BITS, END_BITS = 32, 36


@lru_cache(maxsize=2)
def _tables(a_name: str, b_name: str) -> tuple:
    """Of both vocabularies: encoder, byte strings and lengths of ids, and decimal ids."""
    a, b = byte_vocabulary(a_name), piece_vocabulary(b_name)
    sides = []
    for v in (a, b):
        data = pa.array(v.bytes, pa.large_binary())
        sides.append((data, pc.binary_length(data).cast(pa.int64()), pa.array([str(i) for i in range(len(v.bytes))])))
    return a, b, sides


def _lists(ids: list[list[int]]) -> pa.LargeListArray:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.empty(offsets[-1], np.int32)
    for x, at in zip(ids, offsets[:-1], strict=True):
        flat[at : at + len(x)] = x
    return pa.LargeListArray.from_arrays(offsets, flat)


def _joined(ids: pa.LargeListArray, data: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all tokens in order, and where each document's begin."""
    taken = data.take(ids.values)
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset)
    return memoryview(taken.buffers()[2] or b"").cast("B"), ends[ids.offsets.to_numpy()]


def _ends(ids: pa.LargeListArray, lengths: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each token's key: its document's number and its end within the document."""
    flat, parents = pc.list_flatten(ids), pc.list_parent_indices(ids)
    running = pc.cumulative_sum(lengths.take(flat))
    before = np.concatenate([[0], running.to_numpy()])[ids.offsets.to_numpy()[:-1]]
    own = pc.subtract(running, pa.array(before).take(parents))
    return flat, pc.bit_wise_or(pc.shift_left(parents, END_BITS), own)


def _grouped(strings: pa.Array, ids: pa.Array, cuts: np.ndarray, sign: str) -> pa.Array:
    """Decimal ids joined within the stretches that end at ``cuts``."""
    return pc.binary_join(pa.ListArray.from_arrays(np.concatenate([[0], cuts]).astype(np.int32), strings.take(ids)), sign)


def align(texts: list[str | None], a_name: str = A_VOCABULARY, b_name: str = B_VOCABULARY) -> dict[str, pa.Array]:
    """Per text: numbers of tokens, groups and links, digest of the groups, and its distinct pairs with their numbers."""
    a, b, ((a_bytes, a_lengths, a_text), (b_bytes, b_lengths, b_text)) = _tables(a_name, b_name)
    whole = [" " + t if t else "" for t in texts]
    a_ids = [a.encode_plain(t) if t else [] for t in whole]
    b_ids = b.encode([t or "" for t in texts])
    sides = [_lists(a_ids), _lists(b_ids)]
    data = [t.encode() for t in whole]
    ends = np.cumsum([0, *map(len, data)])
    joined = b"".join(data)
    found = [_joined(ids, of) for ids, of in zip(sides, (a_bytes, b_bytes), strict=True)]
    if not all(len(x) == len(joined) and x == joined and np.array_equal(at, ends) for x, at in found):
        same = [bool(d) and all(x[at[i] : at[i + 1]] == d for x, at in found) for i, d in enumerate(data)]
        sides = [_lists([x if ok else [] for x, ok in zip(ids, same, strict=True)]) for ids in (a_ids, b_ids)]
    (a_flat, a_key), (b_flat, b_key) = _ends(sides[0], a_lengths), _ends(sides[1], b_lengths)
    left = pa.table({"key": a_key, "a": a_flat, "at": np.arange(len(a_flat))})
    right = pa.table({"key": b_key, "b": b_flat, "bt": np.arange(len(b_flat))})
    links = left.join(right, "key", join_type="inner", use_threads=False)
    doc = pc.shift_right(links["key"], END_BITS)
    pair = pc.bit_wise_or(pc.shift_left(links["a"].cast(pa.int64()), ID_BITS), links["b"].cast(pa.int64()))
    n = len(texts)
    n_links = np.bincount(doc.to_numpy(), minlength=n)
    # An end that both sides have closes a group; tokens without bytes could share it.
    keys, at, bt = (links[c].to_numpy() for c in ("key", "at", "bt"))
    order = np.lexsort((bt, at)) if len(at) and np.any(at[1:] < at[:-1]) else np.arange(len(at))
    keys, at, bt = keys[order], at[order], bt[order]
    last = np.append(keys[1:] != keys[:-1], True)[: len(keys)]
    strings = pc.binary_join_element_wise(_grouped(a_text, a_flat, at[last] + 1, ","), _grouped(b_text, b_flat, bt[last] + 1, ","), "|")
    n_groups = np.bincount(keys[last] >> END_BITS, minlength=n)
    groups = pc.binary_join(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n_groups)]).astype(np.int32), strings), ";")
    digests = [hashlib.sha256(g.as_buffer()).hexdigest() if k else "" for g, k in zip(groups.cast(pa.binary()), n_groups, strict=True)]
    counts = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
    offsets = np.searchsorted(counts["doc"].to_numpy(), np.arange(n + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(offsets, counts[c].combine_chunks().cast(k)) for c, k in (("pair", pa.int64()), ("count_all", pa.int32()))]
    sizes = [pc.list_value_length(s).cast(pa.int64()) for s in sides]
    return {"n_a": sizes[0], "n_b": sizes[1], "n_groups": pa.array(n_groups), "n_links": pa.array(n_links), "groups_sha256": pa.array(digests, pa.string()), "pairs": lists[0], "times": lists[1]}


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about SLICE bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        end = min(int(np.searchsorted(ends, before + SLICE)) + 1, len(ends))
        yield begin, end
        begin = end


def aligned_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_name: str = A_VOCABULARY, b_name: str = B_VOCABULARY) -> DataFrame:
    """Per row: a number of its own, its id, what ``align`` gives, with the row's pairs and how often it holds each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 33
        for batch in batches:
            for begin, end in _slices(batch.column("text")):
                found = align(batch.column("text").slice(begin, end - begin).to_pylist(), a_name, b_name)
                rows = pa.array(np.arange(row, row + end - begin))
                row += end - begin
                yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id").slice(begin, end - begin), *found.values()], ["row", "doc_id", *found])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (its links over all rows) and best (whether no pair of its second id has more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(parts).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])

        parts: list[pa.Table] = []
        for batch in batches:
            # Flattened by list_flatten, as an array's values may reach beyond its slice.
            own = pa.table({"pair": pc.list_flatten(batch.column("pairs")), "n": pc.list_flatten(batch.column("times")).cast(pa.int64())})
            parts = [summed([*parts, own])]
            if parts[0].num_rows >= FLUSH:
                yield from parts.pop().combine_chunks().to_batches()
        if parts:
            yield from parts[0].combine_chunks().to_batches()

    counts = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return counts.withColumn("b", F.col("pair").bitwiseAND((1 << ID_BITS) - 1))


def with_best(counts: DataFrame) -> DataFrame:
    """``counts`` (pair, n, b) with ``best``; the highest counts are one row for each id of the second vocabulary."""
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """n_best and count_sum of each row by one sorted table of pairs that all workers get."""
    known = counts.toArrow().sort_by("pair")
    shared = aligned.sparkSession.sparkContext.broadcast([known[c].to_numpy() for c in ("pair", "n", "best")])

    def batch_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), pc.list_flatten(batch.column("times")).to_numpy().astype(np.int64)
            at = np.searchsorted(pair, pc.list_flatten(pairs).to_numpy())
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(pairs).to_numpy())])
            sums = [pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[ends])) for x in (times * best[at], times * n[at])]
            keep = [c for c in batch.schema.names if c not in ("row", "pairs", "times")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *sums], [*keep, "n_best", "count_sum"])

    kept = [f for f in aligned.schema.fields if f.name not in ("row", "pairs", "times")]
    return aligned.drop("row").mapInArrow(batch_sums, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", n_best long, count_sum long")


def _joined_up(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by shuffles of the rows' pairs."""
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    sums = each.join(counts, F.col("pairs") == F.col("pair")).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = F.lit(0).cast("long")
    joined = aligned.drop("pairs", "times").join(sums, "row", "left").drop("row")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("long"), zero) for c in ("n_best", "count_sum")})


def align_tokenizers(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_name: str = A_VOCABULARY, b_name: str = B_VOCABULARY, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum."""
    with Scratch(df.sparkSession) as own:
        # Its rows are read again when the result is, so this table stays in the shared folder.
        aligned = stored(aligned_documents(df, id_col, text_col, a_name, b_name))
        counts = own.stored(pair_counts(aligned))
        few = counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs
        if few:
            return _looked_up(aligned, with_best(counts))
        return _joined_up(aligned, stored(with_best(counts)))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))
