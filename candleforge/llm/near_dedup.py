"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

Sets of word shingles are sketched by rounds of hashed bin placement: in round i < t every element goes to one bin by
a hash, in round t + j every element goes to bin j, and a bin keeps the least hash of the first round that reaches it.
After 2t rounds every bin of a set that isn't empty is filled; nearly always a few rounds do. The share of equal bins
estimates the Jaccard similarity with concentration bounds like those of t independent permutations.

Documents with the same set form one class, represented by its least id, so copies meet only in that aggregation.
Classes are banded. A bucket proposes links to one pivot, not all its pairs; a proposal is confirmed on the full sets.
Confirmed links make components; a bucket whose members are all in one component is settled, as more links in it change
nothing. What is left then is compared across components by a prefix filter over the full sets, so no link between
different sets that share a bucket is lost and no bucket's pairs are all made.

Defined results: null and empty texts and texts without words have no shingles and are linked with nothing; texts with
fewer words than a shingle have their whole sequence as one; texts of any length are taken whole. Rows that share an id
are one document: its set is that of its largest digest, every row takes that document's component, and n_shingles is
the row's own. Rows with a null id have a null component and are kept. An empty table gives an empty result; columns
besides id and text are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.llm.common import Scratch, map_arrow, perhaps_in, stored, table, text_or_empty
from candleforge.llm.graph import linked_components
from candleforge.llm.shingles import BASE, mixed, shingle_sets

#: Bands of BAND_ROWS bins each: a pair at similarity 0.8 shares no band with probability 3e-7, at 0.5 it does with 0.47.
BANDS, BAND_ROWS = 38, 5


def sketches(hashes: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """The t bins of each set; sets are sorted runs of ``hashes``, and empty ones get zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, t), np.uint64)
    filled = np.zeros((n, t), bool)
    sizes = np.diff(offsets)
    filled[sizes == 0] = True
    of = np.repeat(np.arange(n), sizes)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for i in range(2 * t):
        open_sets = ~filled.all(axis=1)
        if not open_sets.any():
            break
        keep = open_sets[of]
        hashes, of = hashes[keep], of[keep]
        h = mixed(hashes + np.uint64((i + 1) * BASE & (1 << 64) - 1))
        bins = (h >> np.uint64(33)) % np.uint64(t) if i < t else np.full(len(h), i - t, np.uint64)
        at = of * t + bins.astype(np.int64)
        fresh = ~filled.ravel()[at]
        least = np.full(n * t, top, np.uint64)
        np.minimum.at(least, at[fresh], h[fresh])
        won = least.reshape(n, t) != top
        out[won] = least.reshape(n, t)[won]
        filled |= won
    return out


def band_keys(bins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.tile(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(bins), 1))
    for k in range(rows):
        keys = mixed(keys * np.uint64(BASE) + bins.reshape(-1, bands, rows)[:, :, k])
    return keys


def set_digests(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    data = hashes.tobytes()
    return [hashlib.blake2b(data[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def sketched(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """Per document: set size, digest of the set and its band keys."""

    def batch_keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, offsets = shingle_sets(batch.column("text"), size)
        n = np.diff(offsets)
        keys = np.concatenate(
            [
                band_keys(sketches(hashes[offsets[a] : offsets[min(a + 512, len(n))]], offsets[a : min(a + 512, len(n)) + 1] - offsets[a], bands * rows), bands, rows)
                for a in range(0, len(n), 512)
            ]
        )
        lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(set_digests(hashes, offsets), pa.binary()), lists], ["doc_id", "n_shingles", "digest", "keys"]
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, batch_keys, f"doc_id {kind}, n_shingles long, digest binary, keys array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, one_at = shingle_sets(batch.column("text_a"), size)
        two, two_at = shingle_sets(batch.column("text_b"), size)
        keep = []
        for i in range(batch.num_rows):
            x, y = one[one_at[i] : one_at[i + 1]], two[two_at[i] : two_at[i + 1]]
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            common = len(x) + len(y) - len(np.union1d(x, y))
            if 100 * common >= percent * (len(x) + len(y) - common):
                keep.append(i)
        return pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64()))], ["a", "b"])

    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    kind = pairs.schema["a"].dataType.simpleString()
    return map_arrow(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b"), verify, f"a {kind}, b {kind}")


def texts_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """One text of each of ``nodes`` (doc_id, digest), of the digest's set."""
    own = perhaps_in(docs, nodes, "doc_id").join(nodes, "doc_id")

    def same(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests = set_digests(*shingle_sets(batch.column("text"), size))
        keep = [i for i, (x, y) in enumerate(zip(digests, batch.column("digest").to_pylist(), strict=True)) if x == y]
        return batch.select(["doc_id", "text"]).take(pa.array(keep, pa.int64()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(own.select("doc_id", "text", "digest"), same, f"doc_id {kind}, text string").dropDuplicates(["doc_id"])


def sets_of(members: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """node, part and the set of the node's shingle hashes."""

    def batch_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, offsets = shingle_sets(batch.column("text"), size)
        sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("node"), batch.column("part"), sets], ["node", "part", "set"])

    own = texts.withColumnRenamed("doc_id", "node").join(members, "node").select("node", "part", "text")
    kind = own.schema["node"].dataType.simpleString()
    return map_arrow(own, batch_sets, f"node {kind}, part {kind}, set array<long>")


def near_duplicates(
    df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = BAND_ROWS
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept."""
    docs = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    with Scratch(df.sparkSession) as scratch:
        marks = scratch.stored(sketched(docs, size, bands, rows))
        # One set for each document, and classes of equal sets by their least document.
        digests = marks.filter("digest is not null AND doc_id is not null").groupBy("doc_id").agg(F.max("digest").alias("digest"))
        digests = scratch.stored(digests)
        classes = scratch.stored(digests.groupBy("digest").agg(F.min("doc_id").alias("class")))
        class_of = digests.join(classes, "digest").select("doc_id", "class")
        heads = marks.join(classes.withColumnRenamed("class", "doc_id"), ["doc_id", "digest"], "left_semi")
        slots = scratch.stored(heads.select(F.col("doc_id").alias("node"), F.explode("keys").alias("key")))
        # Buckets of one propose nothing.
        shared = scratch.stored(slots.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key"))
        met = scratch.stored(slots.join(shared, "key").distinct())
        scratch.forget(slots, shared)
        if not met.isEmpty():
            nodes = scratch.stored(met.select(F.col("node").alias("doc_id")).distinct().join(digests, "doc_id"))
            texts = scratch.stored(texts_of(docs, nodes, size))
            parts = linked_components(met, lambda pairs: confirmed(pairs, texts, size, percent), lambda n: sets_of(n, texts, size), scratch, percent)
            if parts is not None:
                found = parts.withColumnsRenamed({"node": "class", "component": "found"})
                class_of = class_of.join(found, "class", "left").select("doc_id", F.coalesce("found", "class").alias("class"))
        of_doc = class_of.withColumnRenamed("class", "component_id")
        out = marks.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
        return stored(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


def first_of_each(df: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` whose document is the first of its group of near duplicates; rows with a null id stay."""
    gone = near_duplicates(df, size, percent).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return df.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
