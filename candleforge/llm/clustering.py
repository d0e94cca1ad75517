"""Exact k-means over integer vectors through dictionaries of subvectors.

Each vector is cut into blocks of neighbouring dimensions, and each block is encoded without loss by a dictionary of the
distinct subvectors that occur there. In a round the squared distances of dictionary entries to the centroids' blocks are
worked out once per entry, by Spark over the dictionary; a vector's distance to a centroid is then the sum, by its codes,
of one number a block. Vectors and codes are stored once; a round reads them and keeps a count and componentwise sums a
cluster, added up in each task before they are shuffled.

A block's width is chosen by the work of a round: narrow blocks have few distinct subvectors and many additions, wide
ones the reverse. Numbers of distinct subvectors are estimated for the choice, which changes no result. Partial distances
of up to ``broadcast_bytes`` go to all workers; beyond that a vector's subvectors are shuffled to their entries and their
partial distances back to it, both in rows that Spark can split.

A vector is kept if it has ``dims`` components, none of them null, non-finite, or of 2**19 or more in size, as squared
distances of such vectors needn't fit a long. Rows with a null id are clustered but start no centroid; ids may repeat:
each row is clustered by itself, and of equal hashes the smaller vector comes first. With fewer vectors than centroids
each starts one; ties go to the smaller number; a centroid without vectors stays. Without kept vectors the result is
empty; columns besides id and vector are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.llm.common import Scratch, map_arrow, stored, table

DIMS, CLUSTERS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: Components are less than this in size; two of them, shifted to be positive, share a long.
BITS = 28
LARGEST = 1 << (BITS - 1)
WIDTHS = (1, 2)
#: Bytes of partial distances that are broadcast at most.
BROADCAST_BYTES = 64 << 20


def integers(df: DataFrame, id_col: str, vector_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the kept vectors' components as integers."""
    x = F.transform(F.col(vector_col), lambda c: scale * c.cast("double"))
    fits = (F.size(x) == dims) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (c >= -LARGEST) & (c < LARGEST), F.lit(False)))
    return df.filter(fits).select(F.col(id_col).alias("vec_id"), F.transform(x, lambda c: F.floor(c)).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the smallest hashes, in rising order: ``clusters`` rows at most."""
    named = vectors.filter(F.col("vec_id").isNotNull()).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return np.array([r.v for r in named.orderBy("h", "v").select("v").limit(clusters).collect()], np.int64)


def subvectors(dims: int, width: int) -> Column:
    """The blocks of ``v``, each packed into one long."""

    def packed(b: Column) -> Column:
        out = F.lit(0).cast("long")
        for i in range(width):
            out = out * (1 << BITS) + F.get("v", b * width + i) + LARGEST
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(dims // width - 1)), packed)


def unpacked(keys: np.ndarray, width: int) -> np.ndarray:
    return np.stack([(keys >> (BITS * (width - 1 - i)) & ((1 << BITS) - 1)) - LARGEST for i in range(width)], axis=1)


def best_width(vectors: DataFrame, n: int, dims: int, widths: tuple[int, ...], entries: int) -> int:
    """The width with the least work a round: entries times their width, and a sum of blocks for each vector.

    Widths of more than about ``entries`` distinct subvectors are left out; where all are, it is the narrowest.
    """

    def cells_of(w: int) -> Column:
        return F.transform(subvectors(dims, w), lambda k, b: F.struct(F.lit(w).alias("w"), b.alias("block"), k.alias("k")))

    cells = [cells_of(w) for w in widths if dims % w == 0]
    found = vectors.select(F.explode(F.concat(*cells)).alias("c")).groupBy("c.w", "c.block").agg(F.approx_count_distinct("c.k").alias("n")).groupBy("w").agg(F.sum("n").alias("n"))
    found = found.collect()
    small = [r for r in found if r.n <= 0.9 * entries] or [min(found, key=lambda r: r.w)]
    return min(small, key=lambda r: (r.n * r.w + n * dims // r.w, r.w)).w


def partial_distances(dictionary: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """``dictionary`` (block, k) with each entry's squared distances to the centroids' blocks."""

    def batch_parts(batch: pa.RecordBatch) -> pa.RecordBatch:
        block, sub = batch.column("block").to_numpy(), unpacked(batch.column("k").to_numpy(), width)
        own = centroids.reshape(len(centroids), -1, width)[:, block]
        parts = np.ascontiguousarray(((own - sub) ** 2).sum(axis=2).T)
        offsets = np.arange(len(block) + 1, dtype=np.int32) * len(centroids)
        return pa.RecordBatch.from_arrays([batch.column("block"), batch.column("k"), pa.ListArray.from_arrays(offsets, parts.ravel())], ["block", "k", "parts"])

    return map_arrow(dictionary.select("block", "k"), batch_parts, "block int, k long, parts array<long>")


def _by_codes(vectors: DataFrame, dictionary: DataFrame, width: int, scratch: Scratch) -> Callable[[np.ndarray], DataFrame]:
    """Assignment through codes: all workers hold the dictionary, and in each round its partial distances."""
    spark, (kind, dims) = vectors.sparkSession, (vectors.schema["vec_id"].dataType.simpleString(), vectors.select(F.size("v")).first()[0])
    known = dictionary.toArrow().sort_by([("block", "ascending"), ("k", "ascending")])
    keys, starts = known["k"].to_numpy(), np.searchsorted(known["block"].to_numpy(), np.arange(dims // width + 1))
    entries = spark.sparkContext.broadcast((keys, starts))

    def batch_codes(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, starts = entries.value
        own = batch.column("keys").flatten().to_numpy().reshape(len(batch), -1)
        codes = np.stack([at + np.searchsorted(keys[at:end], own[:, b]) for b, (at, end) in enumerate(zip(starts, starts[1:], strict=False))], axis=1)
        offsets = np.arange(len(batch) + 1, dtype=np.int32) * codes.shape[1]
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(offsets, codes.astype(np.int32).ravel())], ["vec_id", "v", "codes"])

    coded = map_arrow(vectors.select("vec_id", "v", subvectors(dims, width).alias("keys")), batch_codes, f"vec_id {kind}, v array<long>, codes array<int>")
    coded = scratch.stored(coded)

    def assign(centroids: np.ndarray) -> DataFrame:
        parts = partial_distances(dictionary, centroids, width).toArrow().sort_by([("block", "ascending"), ("k", "ascending")])
        shared = spark.sparkContext.broadcast(parts["parts"].combine_chunks().flatten().to_numpy().reshape(-1, len(centroids)))

        def batch_nearest(batch: pa.RecordBatch) -> pa.RecordBatch:
            codes = batch.column("codes").flatten().to_numpy().reshape(len(batch), -1)
            distance = np.zeros((len(batch), len(centroids)), np.int64)
            for b in range(codes.shape[1]):
                distance += shared.value[codes[:, b]]
            nearest = distance.argmin(axis=1)
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(nearest.astype(np.int32)), pa.array(distance[np.arange(len(batch)), nearest])]
            return pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "cluster", "distance"])

        return map_arrow(coded, batch_nearest, f"vec_id {kind}, v array<long>, cluster int, distance long")

    return assign


def _by_shuffles(vectors: DataFrame, dictionary: DataFrame, width: int, scratch: Scratch) -> Callable[[np.ndarray], DataFrame]:
    """Assignment where the dictionary is too large for that."""
    dims = vectors.select(F.size("v")).first()[0]
    numbered = scratch.stored(vectors.withColumn("row", F.monotonically_increasing_id()))
    cells = numbered.select("row", F.posexplode(subvectors(dims, width)).alias("block", "k"))

    def assign(centroids: np.ndarray) -> DataFrame:
        sums = [F.sum(F.get("parts", F.lit(i))).alias(f"d{i}") for i in range(len(centroids))]
        found = cells.join(partial_distances(dictionary, centroids, width), ["block", "k"]).groupBy("row").agg(*sums)
        found = found.select("row", F.array(*[f"d{i}" for i in range(len(centroids))]).alias("d")).withColumn("distance", F.array_min("d"))
        found = found.withColumn("cluster", (F.array_position("d", F.col("distance")) - 1).cast("int"))
        return numbered.join(found, "row").select("vec_id", "v", "cluster", "distance")

    return assign


def moved(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid that has vectors at the floors of their componentwise means; a row a cluster comes to the driver."""
    sums = assigned.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(d))).alias(f"s{d}") for d in range(centroids.shape[1])])
    out = centroids.copy()
    for row in sums.collect():
        out[row.cluster] = [row[f"s{d}"] // row.n for d in range(centroids.shape[1])]
    return out


def cluster_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = DIMS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    scale: int = SCALE,
    widths: tuple[int, ...] = WIDTHS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    with Scratch(df.sparkSession) as own:
        vectors = own.stored(integers(df, id_col, vector_col, dims, scale))
        n, centroids = vectors.count(), first_centroids(vectors, clusters, seed)
        if len(centroids):
            most = broadcast_bytes // (8 * clusters)
            width = best_width(vectors, n, dims, widths, most)
            each = vectors.select(F.posexplode(subvectors(dims, width)).alias("block", "k"))
            dictionary = own.stored(each.distinct())
            assign = (_by_codes if dictionary.limit(most + 1).count() <= most else _by_shuffles)(vectors, dictionary, width, own)
            for _ in range(rounds):
                centroids = moved(assign(centroids), centroids)
            assigned = assign(centroids).drop("v")
        else:
            # Only rows without an id, if any: there is no centroid to assign them to.
            assigned = vectors.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        # Its rows are read again when the result is, so this table stays in the shared folder.
        assigned = stored(assigned)
    inertias = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    facts = [(i, inertias.get(i, 0), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    # A row a cluster.
    facts = df.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string")
    inertia = F.lit(sum(inertias.values())).cast("long").alias("inertia")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", inertia, "centroid_sha256")


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))
