"""Connected components of an edge table by alternating stars, a distributed union-find."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleforge.llm.common import Scratch, in_a_row, in_ranges, map_arrow, range_bits
from candleforge.llm.shingles import BASE, mixed

#: Hash slots whose counts order the elements of sets, and words of a set's bitmap.
SLOTS, WORDS = 1 << 18, 8
#: Values of a list that goes to a range of elements, about.
LIST = 1 << 10
#: Elements of a set for each of which it has to meet a close one once more among their first ones.
DEPTH = 50
#: Nodes of a bucket that meet in one place, and pairs up to which a bucket's nodes are compared with each other.
BLOCK, MOST_PAIRS = 1 << 12, 1 << 32
BITS = [f"bits{k}" for k in range(WORDS)]


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lists' values in a row, and their sizes."""
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def slots_of(elements: np.ndarray) -> np.ndarray:
    return (mixed(elements.view(np.uint64)) % np.uint64(SLOTS)).astype(np.int64)


def _with_least(edges: DataFrame, own: bool, scratch: Scratch) -> DataFrame:
    """Each edge with the least neighbour ``m`` of its ``a`` (``a`` itself included if ``own``)."""
    least = F.least(F.col("a"), F.min("b")) if own else F.min("b")
    # Written first, so that both sides of the join are plain exchanges and a hub's edges can be split.
    return edges.join(scratch.stored(edges.groupBy("a").agg(least.alias("m"))), "a")


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node that isn't a root has one edge, to a root."""
    n, nodes = edges.agg(F.count("*"), F.countDistinct("a")).first()
    return n == nodes and edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``component`` (the least node reachable) of every node of ``edges`` (a, b); self-loops are allowed.

    Large and small stars alternate until all edges are stars, in a number of rounds that grows with the logarithm of
    the edges; each round is a few aggregations and joins, written to the shared folder. No edges give no rows.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = scratch.stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_stars(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        with Scratch(scratch.spark) as own:
            large = _with_least(both, True, own).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = own.stored(large.filter("a != b").distinct())
            small = _with_least(large, False, own)
            small = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
            after = scratch.stored(small.filter("a != b").distinct())
        scratch.forget(now)
        now = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))


def slot_counts(sets: DataFrame) -> np.ndarray:
    """For each of SLOTS hash slots, the nodes with an element in it, repeats included; 0 where all are of one part."""

    def batch_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        elements, sizes = flat_lists(batch.column("set"))
        slots, part = slots_of(elements), np.repeat(batch.column("p").to_numpy(), sizes)
        order = np.argsort(slots, kind="stable")
        slots, part = slots[order], part[order]
        at = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]][: len(slots)])
        low, high = (f.reduceat(part, at) if len(at) else part for f in (np.minimum, np.maximum))
        counts = np.diff(np.r_[at, len(slots)])
        return pa.RecordBatch.from_arrays([pa.array(slots[at].astype(np.int32)), pa.array(counts, pa.int64()), pa.array(low), pa.array(high)], ["slot", "often", "low", "high"])

    rows = map_arrow(sets.select(F.xxhash64("part").alias("p"), "set"), batch_counts, "slot int, often long, low long, high long")
    found = rows.groupBy("slot").agg(F.sum("often").alias("often"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = found.filter("low != high").select("slot", F.least("often", F.lit((1 << 31) - 1)).cast("int").alias("often")).toPandas()
    out = np.zeros(SLOTS, np.int32)
    out[found["slot"].to_numpy()] = found["often"].to_numpy()
    return out


def prefixes(sets: DataFrame, often: np.ndarray, percent: int) -> DataFrame:
    """node, part, n, element and most, for those first elements of each node under which another node fits."""
    shared = sets.sparkSession.sparkContext.broadcast(often)
    # A prefix is about a quarter of its set.
    bits = range_bits(int(often.sum(dtype=np.int64)) // 4)
    names = ["node", "part", "n", "element", "most"]

    def batch_prefixes(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for begin in range(0, batch.num_rows, 256):
            rows = batch.slice(begin, 256)
            elements, n = flat_lists(rows.column("set"))
            of, slots = np.repeat(np.arange(len(n)), n), slots_of(elements)
            order = np.lexsort((elements, shared.value[slots], of))
            elements, count = elements[order], shared.value[slots][order]
            left = n[of] - (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
            left = np.minimum(left + n[of] // DEPTH, n[of])
            # The largest partner of which the elements from here on can be enough.
            most = (100 + percent) * left // percent - n[of]
            keep = np.flatnonzero((100 * most >= percent * n[of]) & (count > 0))
            own = rows.select(["node", "part"]).take(pa.array(of[keep]))
            columns = [pa.array(n[of][keep].astype(np.int32)), pa.array(elements[keep]), pa.array(most[keep].astype(np.int32))]
            out.append(pa.RecordBatch.from_arrays([*own.columns, *columns], names))
        return pa.Table.from_batches(out)

    def batch_ranges(batch: pa.RecordBatch) -> pa.Table | None:
        found, out = batch_prefixes(batch), []
        # Lists of about LIST values, as rows of megabytes strain the JVM's heap.
        for begin in range(0, found.num_rows, LIST << bits):
            piece = found.slice(begin, LIST << bits).combine_chunks().to_batches()[0]
            out.append(in_ranges(mixed(piece.column("element").to_numpy().view(np.uint64)), bits, dict(zip(names, piece.columns, strict=True))))
        return pa.Table.from_batches(out) if out else None

    def fitting(rows: pa.Table) -> pa.Table:
        columns = {c: in_a_row(rows.column(c)) for c in names}
        n, element, most = (columns[c].to_numpy() for c in names[2:])
        part = columns["part"].dictionary_encode().indices.to_numpy()
        at = np.argsort(element, kind="stable")
        for _ in range(2):
            begins = np.flatnonzero(np.diff(element[at], prepend=~element[at[:1]]))
            if not len(begins):
                break
            run = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(at)))
            low, least_n = (np.minimum.reduceat(x[at], begins)[run] for x in (part, n))
            high, largest = (np.maximum.reduceat(x[at], begins)[run] for x in (part, most))
            at = at[(low != high) & (most[at] >= least_n) & (largest >= n[at])]
        return pa.table(columns).take(pa.array(at))

    kinds = [*(sets.schema[c].dataType.simpleString() for c in ("node", "part")), "int", "long", "int"]
    lists = ", ".join(f"{c} array<{k}>" for c, k in zip(names, kinds, strict=True))
    packed = map_arrow(sets.select("node", "part", "set"), batch_ranges, f"range int, {lists}")
    return packed.groupBy("range").applyInArrow(fitting, ", ".join(f"{c} {k}" for c, k in zip(names, kinds, strict=True)))


def with_bitmaps(sets: DataFrame) -> DataFrame:
    """node, the size n of its set, and the words of its bitmap."""

    def batch_maps(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for begin in range(0, batch.num_rows, 256):
            rows = batch.slice(begin, 256)
            elements, n = flat_lists(rows.column("set"))
            bits = np.zeros((len(n), 64 * WORDS), np.uint8)
            places = (mixed(elements.view(np.uint64) ^ np.uint64(BASE)) % np.uint64(64 * WORDS)).astype(np.int64)
            np.bitwise_xor.at(bits, (np.repeat(np.arange(len(n)), n), places), 1)
            words = np.packbits(bits, axis=1).view(np.int64)
            out.append(pa.RecordBatch.from_arrays([rows.column("node"), pa.array(n.astype(np.int32)), *[pa.array(words[:, k]) for k in range(WORDS)]], ["node", "n", *BITS]))
        return pa.Table.from_batches(out)

    return map_arrow(sets.select("node", "set"), batch_maps, f"node {sets.schema['node'].dataType.simpleString()}, n int, " + ", ".join(f"{b} long" for b in BITS))


def pairs_inside(cell: np.ndarray, part: np.ndarray, n: np.ndarray, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of rows of one cell and different parts of which size and bitmap allow the similarity."""
    order = np.lexsort((n, cell))
    cell, part, n, bits = cell[order], part[order], n[order].astype(np.int64), bits[order].view(np.uint64)
    ends = np.searchsorted(cell, cell, side="right")
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, away = np.arange(len(cell)), 1
    while len(at):
        # Sizes rise in a cell, so a row that has met too large a set has met all that can be close.
        at = at[at + away < ends[at]]
        at = at[100 * n[at] >= percent * n[at + away]]
        for run in np.array_split(at, len(at) // BLOCK + 1):
            run = run[part[run] != part[run + away]]
            differ = np.bitwise_count(bits[run] ^ bits[run + away]).sum(axis=1, dtype=np.int64)
            run = run[(100 + percent) * differ <= (100 - percent) * (n[run] + n[run + away])]
            one.append(order[run])
            two.append(order[run + away])
        away += 1
    return np.concatenate(one), np.concatenate(two)


def bucket_pairs(left: DataFrame, keys: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different parts that share a bucket and may have Jaccard similarity ``percent`` or more.

    ``left`` has node, key and part, ``keys`` the buckets of ``left`` that are compared, with their number of nodes
    ``size``, their part ``main`` of most nodes and the number ``most`` of these, ``bitmaps`` those of ``with_bitmaps``.
    A bucket of up to BLOCK nodes meets in one cell; a larger one is cut into blocks, apart for the main part, and each
    two blocks meet in a cell, except two of the main part. Cells go to ranges by their hash, where sizes and bitmaps
    are compared by numpy, so that only pairs that may be similar become rows. No similar pair is lost.
    """
    whole = F.col("size") <= BLOCK
    rest = F.when(whole, 1).otherwise(F.ceil((F.col("size") - F.col("most")) / BLOCK)).cast("int")
    mains = F.when(whole, 0).otherwise(F.ceil(F.col("most") / BLOCK)).cast("int")
    cut = keys.withColumn("rest", rest).withColumn("blocks", F.col("rest") + mains)
    rows = cut.agg(F.sum(F.col("most") * F.col("rest") + (F.col("size") - F.col("most")) * F.col("blocks"))).first()[0] or 0
    bits = range_bits(8 * rows)
    inside = ~whole & (F.col("part") == F.col("main"))
    hashed = F.xxhash64("node")
    own = F.when(inside, F.col("rest") + F.pmod(hashed, F.col("blocks") - F.col("rest"))).otherwise(F.pmod(hashed, "rest")).cast("int")
    met = F.sequence(F.lit(0), F.when(inside, F.col("rest")).otherwise(F.col("blocks")) - 1)
    dealt = left.join(cut, "key").withColumn("own", own).select("node", "part", "key", "own", F.explode(met).alias("other"))
    dealt = dealt.select("node", "part", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell")).join(bitmaps, "node")
    kind = left.schema["node"].dataType.simpleString()

    def pairs(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        cell, n = (rows.column(c).to_numpy() for c in ("cell", "n"))
        part = rows.column("part").combine_chunks().dictionary_encode().indices.to_numpy()
        a, b = pairs_inside(cell, part, n, np.stack([rows.column(c).to_numpy() for c in BITS], axis=1), percent)
        node = rows.column("node")
        return pa.table({"a": node.take(pa.array(a)), "b": node.take(pa.array(b))})

    found = dealt.withColumn("range", F.shiftrightunsigned("cell", 64 - bits)).groupBy("range").applyInArrow(pairs, f"a {kind}, b {kind}")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def close_pairs(elements: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``close_sets`` of ``elements`` (node, part, n, element), a row for each element of the nodes' sets of size n."""
    return close_sets(elements.groupBy("node", "part").agg(F.collect_set("element").alias("set")), percent, scratch)


def close_sets(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes of different parts that may have Jaccard similarity ``percent`` or more.

    A prefix filter: the elements of each node (node, part, set) are put in one order, first those in hash slots that
    only one part has, then by rising count of their slot. At the first element i of n that a similar pair has in
    common, each has 1 + n - i elements left that may be shared, which bounds the sizes that its partner can have. So
    only a node's first elements leave its task, in lists by range of their hash, and of these only those under which
    another node fits the bound become rows and are joined. What holds of the first common element holds of the k-th
    with k - 1 more on either side, so large sets have to meet in as many first elements as 1 and one for each DEPTH of
    theirs, and those that meet by chance don't. Any order that all nodes share will do, so counts of slots, of fixed
    number, serve as well as exact ones.
    Each node has a bitmap in which an element turns over one bit; as many bits as differ in two of them, so many
    elements at least do, and pairs with too many aren't made. No similar pair is lost.
    """
    rows = scratch.stored(sets)
    fits = scratch.stored(prefixes(rows, slot_counts(rows), percent))
    # Bitmaps come last, as most elements meet no other node.
    placed = scratch.stored(fits.join(scratch.stored(with_bitmaps(rows).drop("n")), "node"))
    scratch.forget(rows, fits)
    other = placed.withColumnsRenamed({c: f"{c}_b" for c in placed.columns if c not in ("element", "node")} | {"node": "b"})
    differ = " + ".join(f"bit_count({b} ^ {b}_b)" for b in BITS)
    pairs = placed.join(other, "element").filter(f"part < part_b AND n <= most_b AND n_b <= most AND {100 + percent} * ({differ}) <= {100 - percent} * (n + n_b)")
    pairs = pairs.groupBy("node", "b").agg(F.count("*").alias("common"), F.min("n").alias("n"), F.min("n_b").alias("n_b"))
    pairs = pairs.filter(f"common >= least(1 + n div {DEPTH}, 1 + n_b div {DEPTH}, ceil({percent} * (n + n_b) / {100 + percent}))")
    return pairs.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b"))


def open_keys(left: DataFrame) -> DataFrame:
    """Of the buckets of ``left`` (node, key, part) with several parts what ``bucket_pairs`` needs, and whether it has too many pairs."""
    keys = left.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key")
    keys = keys.agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("part", F.struct("n", "part")).alias("main"))
    return keys.filter("size > most").withColumn("large", F.col("size") * (F.col("size") - F.col("most")) > MOST_PAIRS)


def linked_components(
    slots: DataFrame,
    confirm: Callable[[DataFrame], DataFrame],
    sets: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    percent: int = 80,
) -> DataFrame | None:
    """Components (``node``, ``component``) of the links that ``confirm`` finds among nodes that share a ``key``.

    ``slots`` (node, key), stored, has the buckets of two nodes or more. A bucket proposes its nodes' pairs with one
    pivot, not all pairs: the node with the most company in its buckets, which the text that others were made from has.
    A pivot has met its whole bucket and leaves it. A bucket whose other nodes are all in one component is settled, as
    more links inside it change nothing. Then the nodes of each bucket that isn't settled are compared across
    components by ``bucket_pairs``, or, where more than MOST_PAIRS are to be compared, by ``close_sets`` (``sets`` makes
    node, part, set of a table of node, part), so no link between nodes that share a bucket is lost. ``confirm`` gets
    distinct pairs (a > b) and returns the true ones. Without a link the result is None.
    """
    sizes = scratch.stored(slots.groupBy("key").agg(F.count("*").alias("n")))
    company = scratch.stored(slots.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("company")))
    state = scratch.stored(slots.join(company, "node"))
    scratch.forget(sizes, company)
    best = F.min_by("node", F.struct(-F.col("company"), F.col("node")))
    pivots = scratch.stored(state.groupBy("key").agg(best.alias("pivot")))
    met = state.join(pivots, "key").filter("node != pivot")
    tried = scratch.stored(met.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct())
    links = scratch.stored(confirm(tried))
    parts = None if links.isEmpty() else scratch.stored(components(links, scratch))
    left = state.select("node", "key").join(pivots.withColumnRenamed("pivot", "node"), ["key", "node"], "left_anti")
    left = left.withColumn("part", F.col("node")) if parts is None else left.join(parts, "node", "left").select("node", "key", F.coalesce("component", "node").alias("part"))
    left = scratch.stored(left)
    scratch.forget(state, pivots)
    keys = scratch.stored(open_keys(left))
    if keys.isEmpty():
        return parts
    members = lambda of: scratch.stored(left.join(of, "key", "left_semi").select("node", "part").distinct())
    few, many = keys.filter("NOT large"), keys.filter("large")
    with Scratch(scratch.spark) as own:
        bitmaps = own.stored(with_bitmaps(sets(members(few))))
        pairs = bucket_pairs(left, few, bitmaps, percent)
        if not many.isEmpty():
            pairs = pairs.union(close_sets(sets(members(many)), percent, own)).distinct()
        pairs = scratch.stored(pairs.join(tried, ["a", "b"], "left_anti"))
    scratch.forget(left, keys)
    more = scratch.stored(confirm(pairs))
    scratch.forget(tried, pairs)
    if more.isEmpty():
        return parts
    return scratch.stored(components(links.union(more), scratch))
