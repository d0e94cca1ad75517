"""Rules from whole grids: every instance, threshold and comparison of every indicator, and their conjunctions.

Conditions become 64-bit words of bars, packed where the indicator's windows leave the rows, so a bar's hits are never
rows of their own. A row of the word table has the words of all conditions of 64 bars. Conjunctions of the next depth are
matrix products of unpacked words: the left rules, in blocks, against all conditions, which gives events and summed
returns of a whole block at once; a task adds its products up and hands on one row a left rule. Rules are numbered by a
closed form, so no list of them is made or broadcast; the table of conditions has the size of the grids.

Defined results: a missing value meets no condition; the first bar of a symbol has no events; bars without a return have
none either; rules without events are there with 0 and a null mean; an empty table gives rules without events.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.functions.rolling import SparkOps
from candleforge.functions.stretches import LENGTH, in_order, stretched
from candleforge.operators.indicators import LOOKBACK, REGISTRY
from candleforge.sources.shared import Tables

#: Thresholds of each indicator, for both comparisons and all points of its grid. Fixed values.
THRESHOLDS = {
    "rsi": (30, 40, 60, 70),
    "adx": (10, 20, 30),
    "ma_dist": (-1.0, -0.6, -0.3, 0.0, 0.3, 0.6, 1.0),
    "momentum": (-1.0, -0.6, -0.3, 0.0, 0.3, 0.6, 1.0),
    "atr_regime": (0.5, 0.7, 1.0, 1.4, 2.0),
    "histvol_regime": (0.5, 0.7, 1.0, 1.4, 2.0),
    "bb_pctb": (0.2, 0.4, 0.6, 0.7, 0.8, 0.9),
    "donchian_pos": (0.2, 0.4, 0.6, 0.8, 0.9),
    "close_pct_rank": (20.0, 50.0, 80.0),
    "pivot_dist": (-1.0, -0.3, 0.3, 1.0),
    "vortex": (-0.5, -0.3, 0.3, 0.5),
    "hurst": (0.4, 0.5, 0.6),
    "ichimoku_tenkan_K": (-0.5, 0.5),
    "ichimoku_cloud_thickness": (0.2, 0.4, 0.6, 0.8, 1.0),
    "ichimoku_price_vs_cloud": (-1.0, -0.5, 0.5, 1.0),
    "trend_intensity_index": (30.0, 50.0, 70.0),
    "macd_hist": (-0.4, -0.2, 0.2, 0.4),
    "roc_spread": (-0.8, -0.6, -0.4, 0.4, 0.6, 0.8),
    "tsi": (-40.0, -20.0, 20.0, 40.0),
    "acceleration": (-1.0, -0.8, -0.6, -0.4, 0.4, 0.6, 0.8, 1.0),
    "ppo": (-1.0, -0.3, 0.3, 1.0),
    "rvi": (-0.3, -0.1, 0.1, 0.3),
    "bb_bandwidth": (0.01, 0.02, 0.03, 0.04),
    "choppiness": (38.0, 62.0),
    "parkinson_ratio": (0.8, 1.2),
    "vol_of_vol": (0.3, 0.4, 0.5, 0.6),
    "ret_skew": (-1.0, -0.5, 0.5, 1.0),
    "donchian_width": (0.01, 0.02, 0.03, 0.04, 0.05),
    "ulcer_index": (1.0, 2.0, 3.0, 4.0),
    "bb_pctb_slope": (-0.2, -0.05, 0.05, 0.2),
    "close_pos_in_bar": (0.1, 0.2, 0.8, 0.9),
    "range_expansion": (0.5, 0.75, 1.5, 2.0),
    "inside_outside_ratio": (10.0, 25.0, 40.0),
    "open_close_momentum": (-0.5, -0.2, 0.2, 0.5),
    "return_entropy": (1.55, 1.75, 1.9, 2.05),
    "kalman_slope": (-0.3, -0.1, 0.1, 0.3),
    "tpo_density": (0.05, 0.15, 0.3),
}
#: Bars of a word, indicators of one plan, plans at once, left rules of a block, words that are unpacked at once.
WORD, TOGETHER, AT_ONCE, BLOCK, STEP = 64, 2, 8, 1024, 32


@dataclass(frozen=True)
class Spec:
    """A condition: its number, the place of its indicator, and what is compared."""

    spec_id: int
    place: int
    name: str
    instance: str
    params: dict[str, int]
    op: str
    threshold: float

    @property
    def label(self) -> str:
        return f"{self.instance}{self.op}{self.threshold:g}"


def expansion(names: Iterable[str] = tuple(REGISTRY)) -> list[Spec]:
    """All conditions of the named indicators: grid points, then thresholds, then > before <."""
    points = [
        (place, name, key, params, op, float(cut))
        for place, name in enumerate(names)
        for key, params in REGISTRY[name].instances()
        for cut in THRESHOLDS[name]
        for op in "><"
    ]
    return [Spec(i, *p) for i, p in enumerate(points)]


def spec_table(spark: SparkSession, specs: list[Spec]) -> DataFrame:
    """The conditions with what numbering rules needs: place in the indicator, its size and start, and sums up to it."""
    sizes: dict[int, int] = {}
    for s in specs:
        sizes[s.place] = sizes.get(s.place, 0) + 1
    start, after, pairs_before, triples_before, facts = 0, len(specs), 0, 0, {}
    pairs = sum(a * b for a, b in zip(sizes.values(), _later(sizes), strict=True))
    for place, size in sizes.items():
        after -= size
        facts[place] = (start, size, after, pairs_before, triples_before)
        later_pairs = pairs - pairs_before - size * after
        start, pairs_before, triples_before = start + size, pairs_before + size * after, triples_before + size * later_pairs
    rows = [(s.spec_id, s.place, s.label, s.spec_id - facts[s.place][0], *facts[s.place]) for s in specs]
    return spark.createDataFrame(rows, "spec_id long, place long, label string, at long, start long, size long, after long, pairs_before long, triples_before long")


def _later(sizes: dict[int, int]) -> list[int]:
    values = list(sizes.values())
    return [sum(values[i + 1 :]) for i in range(len(values))]


def rule_count(specs: list[Spec], depth: int) -> int:
    """How many sets of up to ``depth`` conditions of distinct indicators there are: elementary symmetric sums of sizes."""
    sums = [1] + [0] * depth
    sizes: dict[int, int] = {}
    for s in specs:
        sizes[s.place] = sizes.get(s.place, 0) + 1
    for size in sizes.values():
        for d in range(depth, 0, -1):
            sums[d] += sums[d - 1] * size
    return sum(sums[1:])


def signal_words(bars: DataFrame, specs: list[Spec], length: int = LENGTH) -> DataFrame:
    """(symbol, word, bits by condition, returns by bar): signals act on the bar after the one that meets the condition.

    Stretches hold whole words, so words are made where the windows are, without another shuffle of bars.
    """
    length = -(-max(length, LOOKBACK + 1) // WORD) * WORD
    names = list(dict.fromkeys(s.name for s in specs))
    with Tables(bars.sparkSession) as tables:
        base = tables.stored(stretched(bars, LOOKBACK + 1, length=length))
        # Plans of many windows take the driver longer than their tasks take small data, so they are made side by side.
        with ThreadPoolExecutor(AT_ONCE) as pool:
            groups = [(at, [s for s in specs if s.name in names[at : at + TOGETHER]]) for at in range(0, len(names), TOGETHER)]
            parts = list(pool.map(lambda g: tables.stored(_packed(base, g[1]).withColumn("part", F.lit(g[0]))), groups))
        bits = reduce(DataFrame.unionByName, parts).groupBy("symbol", "word").agg(F.array_sort(F.collect_list(F.struct("part", "bits"))).alias("parts"))
        bits = bits.select("symbol", "word", F.flatten(F.transform("parts", lambda p: p["bits"])).alias("bits"))
        gain = F.when(F.col("open") > 0, (F.col("close") / F.col("open") - 1) * 100.0).cast("double")
        own = base.filter("_own").select("symbol", _word(), F.struct(F.pmod("_bar", F.lit(WORD)).alias("at"), gain.alias("y")).alias("x"))
        found = F.map_from_entries(F.collect_list("x"))
        returns = own.groupBy("symbol", "word").agg(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(WORD - 1).cast("long")), lambda i: F.get(F.array(found), F.lit(0))[i]).alias("returns"))
        return tables.kept(bits.join(returns, ["symbol", "word"]))


def _word() -> Column:
    return F.floor(F.col("_bar") / WORD).cast("long").alias("word")


def _packed(base: DataFrame, specs: list[Spec]) -> DataFrame:
    """(symbol, word, bits) of some conditions; each indicator value is computed once."""
    ops, values = SparkOps(base), {}
    for s in specs:
        if s.instance not in values:
            values[s.instance] = ops.keep(F.lag(ops.keep(REGISTRY[s.name].formula(ops, **s.params))).over(in_order()))
    bit = F.expr(f"shiftleft(1L, CAST(pmod(_bar, {WORD}) AS INT))")
    rows = ops.df.filter("_own").select("symbol", "_stretch", _word(), bit.alias("_bit"), *values.values())
    met = [values[s.instance] > s.threshold if s.op == ">" else values[s.instance] < s.threshold for s in specs]
    packed = [F.coalesce(F.bit_or(F.when(m, F.col("_bit"))), F.lit(0).cast("long")) for m in met]
    return rows.groupBy("symbol", "_stretch", "word").agg(F.array(*packed).alias("bits")).drop("_stretch")


def _unpacked(bits: np.ndarray) -> np.ndarray:
    """0 and 1 by bar and condition, from words by row and condition."""
    n, width = bits.shape
    as_bytes = np.ascontiguousarray(bits.astype("<i8")).view(np.uint8).reshape(n, width, 8)
    return np.unpackbits(as_bytes, axis=2, bitorder="little").transpose(0, 2, 1).reshape(n * WORD, width)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events and summed returns of each left rule with each condition, one row a left rule and block of this task."""
    block, ids, counts, sums = None, None, None, None

    def listed(rows: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.reshape(-1))

    def finished() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([listed(ids), listed(counts), listed(sums)], ["left", "n", "total"])

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if begin == end:
                continue
            rows = batch.slice(begin, end - begin)
            bits = rows.column("bits").flatten().to_numpy().reshape(len(rows), -1)
            returns = rows.column("returns").flatten().to_numpy(zero_copy_only=False).reshape(-1)
            if blocks[begin] != block:
                if block is not None:
                    yield finished()
                block = blocks[begin]
                lefts = rows.column("lefts")[0].as_py()
                ids = np.array(lefts, dtype=np.int64).reshape(len(lefts), -1)
                counts, sums = np.zeros((len(ids), bits.shape[1]), np.int64), np.zeros((len(ids), bits.shape[1]))
            for at in range(0, len(rows), STEP):
                y = returns[at * WORD : (at + STEP) * WORD].astype(float)
                there = ~np.isnan(y)
                met = _unpacked(bits[at : at + STEP])[there].astype(np.float32)
                left = np.ones((len(met), len(ids)), np.float32)
                for column in ids.T:
                    left *= met[:, column]
                counts += (left.T @ met).astype(np.int64)
                sums += (left.T.astype(float) * y[there]) @ met
    if block is not None:
        yield finished()


def grown(words: DataFrame, specs: DataFrame, lefts: DataFrame, later: bool = True) -> DataFrame:
    """(spec_ids, n_events, total) of each left rule (spec_ids, of one size) joined by one more condition.

    With ``later`` the condition's indicator comes after those of the left rule, which gives each set once; else any other
    indicator does, and sets that several left rules lead to are told once.
    """
    spread = F.pmod(F.hash("spec_ids"), F.lit(max(1, -(-lefts.count() // BLOCK))))
    blocks = lefts.groupBy(spread.cast("long").alias("block")).agg(F.sort_array(F.collect_list("spec_ids")).alias("lefts"))
    # The stated left rules against all words, in blocks: each row meets each block of rules.
    dealt = words.crossJoin(blocks).repartition("block", "symbol", "word").sortWithinPartitions("block")
    found = dealt.select("block", "lefts", "bits", "returns").mapInArrow(_products, "left array<long>, n array<long>, total array<double>")
    cells = found.select("left", F.posexplode(F.arrays_zip("n", "total")).alias("spec_id", "x")).groupBy("left", "spec_id").agg(F.sum("x.n").alias("n_events"), F.sum("x.total").alias("total"))
    facts = F.broadcast(specs.select("spec_id", "place"))
    places = lefts.withColumn("id", F.explode_outer("spec_ids")).join(facts.withColumnRenamed("spec_id", "id"), "id", "left").groupBy(F.col("spec_ids").alias("left")).agg(F.collect_set("place").alias("places"))
    pairs = places.crossJoin(facts)
    pairs = pairs.filter(F.col("place") > F.coalesce(F.array_max("places"), F.lit(-1))) if later else pairs.filter(~F.array_contains("places", F.col("place")))
    rows = pairs.join(cells.withColumn("spec_id", F.col("spec_id").cast("long")), ["left", "spec_id"], "left")
    out = rows.select(F.array_sort(F.concat("left", F.array("spec_id"))).alias("spec_ids"), F.coalesce("n_events", F.lit(0).cast("long")).alias("n_events"), F.coalesce("total", F.lit(0.0)).alias("total"))
    return out if later else out.dropDuplicates(["spec_ids"])


def singles(words: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_ids, n_events, total) of each condition alone: the rule of no conditions, grown by one."""
    return grown(words, specs, words.sparkSession.createDataFrame([([],)], "spec_ids array<long>"))


def place_of_rule(specs: list[Spec], spec_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (spec_ids of one to three conditions, rising) with ``rule_no``, the place in the order by depth, indicators
    and points of their grids. It comes from sums over sizes, so rules needn't be listed."""
    facts = F.broadcast(spec_rows.select("spec_id", F.struct("at", "start", "size", "after", "pairs_before", "triples_before").alias("f")))
    for i in range(3):
        rows = rows.withColumn("_id", F.get("spec_ids", F.lit(i))).join(facts.withColumnsRenamed({"spec_id": "_id", "f": f"_{i}"}), "_id", "left").drop("_id")
    a, b, c = F.col("_0"), F.col("_1"), F.col("_2")
    between = b["start"] - a["start"] - a["size"]
    two = F.lit(rule_count(specs, 1)) + a["pairs_before"] + a["size"] * between + a["at"] * b["size"] + b["at"]
    three = (
        F.lit(rule_count(specs, 2)) + a["triples_before"] + a["size"] * (b["pairs_before"] - a["pairs_before"] - a["size"] * a["after"])
        + a["size"] * b["size"] * (c["start"] - b["start"] - b["size"]) + (a["at"] * b["size"] + b["at"]) * c["size"] + c["at"]
    )
    number = F.when(F.size("spec_ids") == 1, a["start"] + a["at"]).when(F.size("spec_ids") == 2, two).otherwise(three)
    return rows.withColumn("rule_no", number.cast("long")).drop("_0", "_1", "_2")


def on_both_sides(rows: DataFrame, rules: int) -> DataFrame:
    """(rule_id, side, spec_ids, n_events, mean_return): all long rules, then all short ones, which gain what longs lose."""
    mean = F.when(F.col("n_events") > 0, F.col("total") / F.col("n_events"))
    sides = F.inline(F.array(F.struct(F.col("rule_no").alias("rule_id"), F.lit("LONG").alias("side"), mean.alias("mean_return")), F.struct((F.col("rule_no") + rules).alias("rule_id"), F.lit("SHORT").alias("side"), (-mean).alias("mean_return"))))
    return rows.select("spec_ids", "n_events", sides).select("rule_id", "side", "spec_ids", "n_events", "mean_return")


def best_of_indicators(rules: DataFrame, specs: DataFrame, least: int) -> DataFrame:
    """Of each set of indicators the rule of the largest mean return with ``least`` events or more, the first on ties."""
    ids = rules.filter(F.col("n_events") >= least).withColumn("spec_id", F.explode("spec_ids"))
    places = ids.join(F.broadcast(specs.select("spec_id", "place")), "spec_id").groupBy("rule_id", "side", "spec_ids", "n_events", "mean_return").agg(F.array_sort(F.collect_list("place")).alias("places"))
    best = places.groupBy("places").agg(F.max_by(F.struct("rule_id", "side", "spec_ids", "n_events", "mean_return"), F.struct("mean_return", -F.col("rule_id"))).alias("b"))
    return best.select("b.*")


def event_words(words: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, symbol, word, bits) of the rules (rule_id, spec_ids): words of their conditions ANDed, where any bit is
    left. The stated rules meet all words in blocks; nothing is shuffled but the rules."""
    spread = F.pmod(F.hash("rule_id"), F.lit(max(1, -(-rules.count() // BLOCK))))
    blocks = rules.groupBy(spread.alias("block")).agg(F.collect_list(F.struct("rule_id", "spec_ids")).alias("rules"))
    every = F.transform("rules", lambda x: F.struct(x["rule_id"].alias("rule_id"), F.aggregate(x["spec_ids"], F.col("there"), lambda s, i: s.bitwiseAND(F.get("bits", i.cast("int")))).alias("bits")))
    there = F.expr(f"aggregate(sequence(0, {WORD - 1}), 0L, (s, i) -> IF(returns[i] IS NULL, s, s | shiftleft(1L, i)))")
    return words.withColumn("there", there).crossJoin(blocks.select("rules")).select("symbol", "word", F.inline(every)).filter("bits != 0").select("rule_id", "symbol", "word", "bits")


def event_bars(rows: DataFrame) -> DataFrame:
    """(rule_id, symbol, bar), bars from 0, of words of events."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(F.col("bits"), i) == 1)
    return rows.select("rule_id", "symbol", F.explode(F.transform(bits, lambda i: F.col("word") * WORD + i)).alias("bar"))
