"""Screening of indicator segments against markets without memory.

Alone: on synthetic paths the log returns of each bar keep their size and get a sign that all symbols share at one time.
Pilot paths give mean and spread of every combination's edge, main paths the largest z that noise reaches, and a real z
counts if it is over a percentile of these, the floor. In pairs: one indicator is shifted around the circle of bars
against the other and the results, so that both keep their own memory and lose what binds them.

Signs and shifts are bits of MD5 of seed, path and time, so a path needs no table of random numbers, is the same on any
engine, and pilots and main paths are disjoint by their numbers. A path is one more key of the bars: windows go over
stretches of it, and edges come from histograms, of which there are as many rows as bins, before anything is compared.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candleforge.functions.stretches import LENGTH, numbered
from candleforge.operators.exits import grid_targets
from candleforge.operators.indicators import REGISTRY, grid_values
from candleforge.operators.screening import bin_of
from candleforge.sources.shared import Tables

#: Least bars inside and outside of a segment, least pilot values, numbers of pilots and of main paths.
LEAST, LEAST_PILOTS, PILOTS, PATHS = 30, 30, 50, 500
SEED_PILOT, SEED_NULL = 20_000, 10_000

#: Thresholds by indicator, in rising order.
Cuts = dict[str, list[float]]


def sign(seed: Column, t: Column) -> Column:
    """1 or -1 by a bit of the hash of seed and time."""
    return F.when(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), t.cast("string"))), 1, 1) < "8", 1.0).otherwise(-1.0)


def running(rows: DataFrame, value: Column, name: str, keys: list[str]) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows of ``keys`` up to each, by _bar, from sums of stretches."""
    inside = Window.partitionBy(*keys, "_stretch").orderBy("_bar").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_value", value)
    totals = rows.groupBy(*keys, "_stretch").agg(F.sum("_value").alias("_total"))
    before = F.sum("_total").over(Window.partitionBy(*keys).orderBy("_stretch")) - F.col("_total")
    joined = rows.withColumn(name, F.sum("_value").over(inside)).join(totals.select(*keys, "_stretch", before.alias("_before")), [*keys, "_stretch"])
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop("_value", "_before")


def synthetic(bars: DataFrame, seeds: DataFrame, decimals: DataFrame | None = None, length: int = LENGTH) -> DataFrame:
    """A path of ``bars`` for each ``seed``: (seed, symbol, t, open, high, low, close, volume, high_time, low_time).

    Where the sign is -1, returns from the close before turn round and high and low change places, with their times. Prices
    are rounded to the ``decimals`` (symbol, decimals) of their symbol; bars with a price that isn't above 0 are left out.
    """
    prices = ("open", "high", "low", "close")
    rows = numbered(bars.filter(" AND ".join(f"{p} > 0" for p in prices)))
    rows = rows.withColumn("_stretch", F.floor(F.col("_bar") / length))
    # The close before: inside a stretch by a window, at its start from the stretch before.
    lasts = rows.groupBy("symbol", (F.col("_stretch") + 1).alias("_stretch")).agg(F.max_by("close", "_bar").alias("_last"))
    rows = rows.join(lasts, ["symbol", "_stretch"], "left")
    rows = rows.withColumn("_pc", F.coalesce(F.lag("close").over(Window.partitionBy("symbol", "_stretch").orderBy("_bar")), "_last", "open"))
    starts = rows.filter("_bar = 0").select("symbol", F.ln("open").alias("_first"))
    rows = rows.withColumns({f"_{p}": F.ln(F.col(p) / F.col("_pc")) for p in prices}).join(starts, "symbol")
    if decimals is not None:
        rows = rows.join(decimals.select("symbol", "decimals"), "symbol", "left")
    else:
        rows = rows.withColumn("decimals", F.lit(None).cast("long"))
    rows = rows.crossJoin(F.broadcast(seeds.select("seed"))).withColumn("_s", sign(F.col("seed"), F.col("t")))
    flip = F.col("_s") < 0
    rows = running(rows, F.col("_s") * F.col("_close"), "_sum", ["seed", "symbol"])
    base = F.exp(F.col("_first") + F.col("_sum") - F.col("_s") * F.col("_close"))
    scale = F.pow(F.lit(10.0), F.col("decimals"))
    price = lambda log: F.when(F.col("decimals").isNull(), base * F.exp(log)).otherwise(F.rint(base * F.exp(log) * scale) / scale)
    out = rows.select(
        "seed", "symbol", "t", "volume", price(F.col("_s") * F.col("_open")).alias("open"), price(F.col("_s") * F.col("_close")).alias("close"),
        price(F.when(flip, -F.col("_low")).otherwise(F.col("_high"))).alias("h"), price(F.when(flip, -F.col("_high")).otherwise(F.col("_low"))).alias("l"),
        F.when(flip, F.col("low_time")).otherwise(F.col("high_time")).alias("high_time"), F.when(flip, F.col("high_time")).otherwise(F.col("low_time")).alias("low_time"),
    )
    return out.select("seed", "symbol", "t", "open", F.greatest("h", "open", "close").alias("high"), F.least("l", "open", "close").alias("low"), "close", "volume", "high_time", "low_time")


def instances(cuts: Cuts) -> list[tuple[str, str]]:
    """Indicator and key of every grid point, in order; a number in a table of codes is a place here."""
    return [(name, key) for name in cuts for key, _ in REGISTRY[name].instances()]


def codes(bars: DataFrame, cuts: Cuts) -> DataFrame:
    """(symbol, t, instance, bin) of every grid point of the indicators, where it has a value."""
    found = None
    for name, ths in cuts.items():
        own = grid_values(bars, name).select("symbol", "t", "instance", bin_of(F.col("value"), ths).alias("bin")).filter("bin IS NOT NULL")
        found = own if found is None else found.unionByName(own)
    return found


def _edge(n: Column, s: Column, q: Column, an: Column, as_: Column, aq: Column) -> tuple[Column, Column]:
    """Edge of a segment, null where it doesn't count, and the excess of its sum."""
    mean, every = s / n, as_ / an
    sd = lambda q, m, n: F.sqrt(F.greatest(q / n - m * m, F.lit(0.0)))
    spread = sd(aq, every, an)
    valid = (n >= LEAST) & (an - n >= LEAST) & (spread > 0)
    return F.when(valid, (mean - every) / (F.greatest(sd(q, mean, n), spread) / F.sqrt(n))), s - n * every


def edges(bars: DataFrame, cuts: Cuts, configs: list[tuple[float, float, int]], commission: float) -> DataFrame:
    """(symbol, indicator, instance, target, cut, side, n, edge, excess) of every combination, with edges that count."""
    rows = codes(bars, cuts).join(grid_targets(bars, configs, commission), ["symbol", "t"])
    keys = ["symbol", "instance", "target"]
    bins = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    names = F.create_map(*[F.lit(x) for name, key in instances(cuts) for x in (key, name)])
    sizes = F.create_map(*[F.lit(x) for name, ths in cuts.items() for x in (name, len(ths))])
    bins = bins.withColumn("indicator", names[F.col("instance")])
    segments = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), sizes[F.col("indicator")] - 1), lambda c: F.array(F.struct(c.alias("cut"), F.lit("<").alias("side")), F.struct(c.alias("cut"), F.lit(">").alias("side"))))))
    each = bins.withColumn("g", segments)
    inside = F.when(F.col("g.side") == "<", F.col("bin") < 2 * F.col("g.cut") + 1).otherwise(F.col("bin") > 2 * F.col("g.cut") + 1)
    sums = each.groupBy("symbol", "indicator", "instance", "target", "g.cut", "g.side").agg(
        *[F.sum(F.when(inside, F.col(c)).otherwise(0)).alias(c) for c in "nsq"], *[F.sum(c).alias(f"a{c}") for c in "nsq"]
    )
    edge, excess = _edge(*[F.col(c) for c in ("n", "s", "q", "an", "as", "aq")])
    return sums.select("symbol", "indicator", "instance", "target", "cut", "side", "n", edge.alias("edge"), excess.alias("excess")).filter("edge IS NOT NULL")


COMBINATION = ["symbol", "indicator", "instance", "target", "cut", "side"]


def moments(found: DataFrame, keys: list[str], least: int = LEAST_PILOTS) -> DataFrame:
    """Mean and spread of each combination's edge over pilots; of those with at least ``least`` values and a spread."""
    out = found.groupBy(*keys).agg(F.avg("edge").alias("mu"), F.stddev_samp("edge").alias("sd"), F.count("*").alias("_n"))
    return out.filter((F.col("_n") >= least) & (F.col("sd") > 1e-12)).drop("_n")


def floors(tops: DataFrame, keys: list[str], percentile: float) -> DataFrame:
    """Of the paths' largest z: the floor, the median and the 84th percentile."""
    at = lambda p: F.percentile("top", F.lit(p))
    return tops.groupBy(*keys).agg(at(percentile / 100.0).alias("floor"), at(0.5).alias("med"), at(0.84).alias("p84"))


def picked(rows: DataFrame, floor: DataFrame, keys: list[str], combination: list[str]) -> DataFrame:
    """Per ``keys``: T, the score, whether T is over the floor, and of combinations over it the one of largest excess.

    ``rows`` have z and excess; the first combination in order comes first of equals.
    """
    own = [c for c in combination if c not in keys]
    best = F.min_by(F.struct(*own, "z", "excess"), F.when(F.col("z") > F.col("floor"), F.struct(-F.col("excess"), *own)))
    out = rows.join(floor, keys).groupBy(*keys).agg(F.max("z").alias("T"), *[F.first(c).alias(c) for c in ("floor", "med", "p84")], best.alias("x"))
    score = F.when(F.col("p84") > F.col("med"), (F.col("T") - F.col("med")) / (F.col("p84") - F.col("med")))
    return out.select(*keys, "T", "floor", score.alias("score"), (F.col("T") > F.col("floor")).alias("passed"), *[F.col(f"x.{c}").alias(c) for c in own], "x.z", "x.excess")


def _on_paths(tables: Tables, bars: DataFrame, first: int, n: int, cuts: Cuts, configs, commission: float, decimals: DataFrame | None) -> DataFrame:
    """Edges on paths, with their seed. The paths are written once, as every indicator and target reads them."""
    seeds = bars.sparkSession.range(first, first + n).withColumnRenamed("id", "seed")
    paths = tables.stored(synthetic(bars, seeds, decimals).withColumn("symbol", F.concat_ws("|", "seed", "symbol")).drop("seed"))
    part = F.split("symbol", r"\|", 2)
    found = tables.stored(edges(paths, cuts, configs, commission).withColumns({"seed": F.get(part, 0).cast("long"), "symbol": F.get(part, 1)}))
    tables.release(paths)
    return found


def screen(
    bars: DataFrame, cuts: Cuts, configs: list[tuple[float, float, int]], percentile: float = 95.0, commission: float = 0.005, pilots: int = PILOTS, paths: int = PATHS,
    decimals: DataFrame | None = None,
) -> DataFrame:
    """Per symbol and indicator: T, floor, score, passed, and the combination picked with its z and excess.

    ``bars`` have high_time and low_time. A path on which no combination has a positive excess counts as a z of -1e9.
    """
    with Tables(bars.sparkSession) as tables:
        bars = tables.stored(bars)
        known = tables.stored(moments(_on_paths(tables, bars, SEED_PILOT, pilots, cuts, configs, commission, decimals), COMBINATION))
        z = ((F.col("edge") - F.col("mu")) / F.col("sd")).alias("z")
        null = _on_paths(tables, bars, SEED_NULL, paths, cuts, configs, commission, decimals).filter("excess > 0").join(known, COMBINATION)
        tops = null.select("seed", "symbol", "indicator", z).groupBy("seed", "symbol", "indicator").agg(F.max("z").alias("top"))
        keys = ["symbol", "indicator"]
        every = known.select(*keys).distinct().withColumn("seed", F.explode(F.sequence(F.lit(SEED_NULL).cast("long"), F.lit(SEED_NULL + paths - 1).cast("long"))))
        tops = every.join(tops, [*keys, "seed"], "left").withColumn("top", F.coalesce("top", F.lit(-1e9)))
        real = edges(bars.filter("open > 0 AND high > 0 AND low > 0 AND close > 0"), cuts, configs, commission).filter("excess > 0").join(known, COMBINATION)
        return tables.kept(picked(real.select(*COMBINATION, "excess", z), floors(tops, keys, percentile), keys, COMBINATION))


# Pairs.
def drawn_shifts(sizes: DataFrame, least: int, pilots: int, paths: int) -> DataFrame:
    """(symbol, n, shift, kind, draw): ``paths`` null shifts by hash, which may repeat, and as many other pilot shifts.

    ``sizes`` has symbol and n, the bars of its circle; shifts are between ``least`` and n - ``least``.
    """
    hashed = lambda seed, x: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), x.cast("string"))), 1, 8), 16, 10).cast("long")
    own = sizes.filter(F.col("n") > 2 * least)
    null = own.select("symbol", "n", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))).alias("draw"))
    null = null.withColumn("shift", least + hashed(SEED_NULL, F.col("draw")) % (F.col("n") - 2 * least + 1))
    free = own.select("symbol", "n", F.explode(F.sequence(F.lit(least).cast("long"), F.col("n") - least)).alias("shift")).join(null.select("symbol", "shift").distinct(), ["symbol", "shift"], "left_anti")
    first = Window.partitionBy("symbol").orderBy(hashed(SEED_PILOT, F.col("shift")), "shift")
    free = free.withColumn("draw", F.row_number().over(first) - 1).filter(F.col("draw") < pilots)
    real = own.select("symbol", "n", F.lit(0).cast("long").alias("shift"), F.lit(0).alias("draw"))
    return null.withColumn("kind", F.lit("null")).unionByName(free.withColumn("kind", F.lit("pilot"))).unionByName(real.withColumn("kind", F.lit("real")))


def instance_pairs(order: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """Places of every two instances of different indicators."""
    return [(a, b) for a, b in product(range(len(order)), repeat=2) if a < b and order[a][0] != order[b][0]]


def shifted_histograms(rows: DataFrame, shifts: DataFrame, of: list[tuple[int, int]]) -> DataFrame:
    """(symbol, kind, draw, a, b, moved, target, i, j, n, s, q): joint histograms of bins i of a and j of b.

    ``rows`` has symbol, bar (0 to n - 1), bins (of every instance; -1 without a value) and y (an array by target). Of a
    pair in ``of`` the moved one is read ``shift`` bars on, around the circle. All pairs of all shifts come from one join of the bars
    with themselves, whose rows are counted before they are shuffled.
    """
    here = rows.join(shifts, "symbol").withColumn("there", F.pmod(F.col("bar") + F.col("shift"), F.col("n")))
    there = rows.select("symbol", F.col("bar").alias("there"), F.col("bins").alias("other"))
    met = here.join(there, ["symbol", "there"])
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(m).alias("moved"), i.alias("i"), j.alias("j"))
             for a, b in of
             for m, i, j in (("b", F.get("bins", F.lit(a)), F.get("other", F.lit(b))), ("a", F.get("other", F.lit(a)), F.get("bins", F.lit(b))))]
    each = met.select("symbol", "kind", "draw", "y", F.explode(F.array(*pairs)).alias("p")).filter("p.i >= 0 AND p.j >= 0")
    long = each.select("symbol", "kind", "draw", "p.*", F.posexplode("y").alias("target", "v")).filter("v IS NOT NULL")
    return long.groupBy("symbol", "kind", "draw", "a", "b", "moved", "target", "i", "j").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))


PAIR = ["symbol", "a", "b", "target", "cut_a", "side_a", "cut_b", "side_b"]


def rectangle_edges(histograms: DataFrame, n_cuts: list[int]) -> DataFrame:
    """Edge, excess and validity of each rectangle of two segments, by 2-D prefix sums of each histogram.

    ``n_cuts`` has the number of thresholds of each instance. A rectangle is valid if either segment holds LEAST bars or
    more that the other leaves out.
    """
    keys = ["symbol", "kind", "draw", "a", "b", "moved", "target"]
    cells = histograms.groupBy(*keys).agg(F.collect_list(F.struct("i", "j", "n", "s", "q")).alias("cells"))

    def run(batches):
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False):
                wa, wb = 2 * n_cuts[row.a] + 1, 2 * n_cuts[row.b] + 1
                table = np.zeros((3, wa + 1, wb + 1))
                for c in row.cells:
                    table[:, c["i"] + 1, c["j"] + 1] = c["n"], c["s"], c["q"]
                table = table.cumsum(axis=1).cumsum(axis=2)
                an, as_, aq = table[:, -1, -1]
                mean = as_ / an
                sd = np.sqrt(max(aq / an - mean * mean, 0.0))
                if not sd > 0:
                    continue
                for ca, sa, cb, sb in product(range(n_cuts[row.a]), "<>", range(n_cuts[row.b]), "<>"):
                    a0, a1 = (0, 2 * ca + 1) if sa == "<" else (2 * ca + 2, wa)
                    b0, b1 = (0, 2 * cb + 1) if sb == "<" else (2 * cb + 2, wb)
                    n, s, q = table[:, a1, b1] - table[:, a0, b1] - table[:, a1, b0] + table[:, a0, b0]
                    if n < LEAST or an - n < LEAST:
                        continue
                    m = s / n
                    edge = (m - mean) / (max(np.sqrt(max(q / n - m * m, 0.0)), sd) / np.sqrt(n))
                    in_a, in_b = table[0, a1, -1] - table[0, a0, -1], table[0, -1, b1] - table[0, -1, b0]
                    out.append((row.symbol, row.kind, row.draw, row.a, row.b, row.moved, row.target, ca, sa, cb, sb, int(n), edge, s - n * mean, bool(in_a - n >= LEAST and in_b - n >= LEAST)))
            yield pd.DataFrame(out, columns=[*keys, *PAIR[4:], "n", "edge", "excess", "valid"])

    return cells.mapInPandas(
        run, "symbol string, kind string, draw int, a int, b int, moved string, target int, cut_a int, side_a string, cut_b int, side_b string, n long, edge double, excess double, valid boolean"
    )


def coded_bars(bars: DataFrame, cuts: Cuts, configs, commission: float) -> DataFrame:
    """(symbol, bar, bins, y) of every bar: bins by instance, -1 without a value, and results by target."""
    order = instances(cuts)
    bins = codes(bars, cuts).groupBy("symbol", "t").agg(F.map_from_entries(F.collect_list(F.struct("instance", "bin"))).alias("_bins"))
    ys = grid_targets(bars, configs, commission).groupBy("symbol", "t").agg(F.map_from_entries(F.collect_list(F.struct("target", "y"))).alias("_ys"))
    rows = numbered(bars.select("symbol", "t")).join(bins, ["symbol", "t"], "left").join(ys, ["symbol", "t"], "left")
    bin_at = [F.coalesce(F.try_element_at("_bins", F.lit(key)), F.lit(-1).cast("long")).cast("int") for _, key in order]
    y_at = [F.try_element_at("_ys", F.lit(i)) for i in range(2 * len(configs))]
    return rows.select("symbol", F.col("_bar").alias("bar"), F.array(*bin_at).alias("bins"), F.array(*y_at).alias("y"))


def screen_pairs(
    bars: DataFrame, cuts: Cuts, configs: list[tuple[float, float, int]], percentile: float = 95.0, commission: float = 0.005, pilots: int = PILOTS, paths: int = PATHS, least_shift: int = 110
) -> DataFrame:
    """Per symbol and pair of indicators: T, floor, score, passed, and the combination picked with its z and excess.

    A combination's z is the smaller of those against pilots that move its first and its second indicator. T has to pass
    the floors of both nulls, of which the higher is given; the score is the lower of the two.
    """
    tables = Tables(bars.sparkSession)
    with tables:
        return tables.kept(_screened_pairs(tables, tables.stored(bars), cuts, configs, percentile, commission, pilots, paths, least_shift))


def _screened_pairs(tables: Tables, bars: DataFrame, cuts: Cuts, configs, percentile: float, commission: float, pilots: int, paths: int, least_shift: int) -> DataFrame:
    order = instances(cuts)
    rows = tables.stored(coded_bars(bars, cuts, configs, commission))
    sizes = rows.groupBy("symbol").agg(F.count("*").alias("n"))
    shifts = tables.stored(drawn_shifts(sizes, least_shift, pilots, paths))
    found = tables.stored(rectangle_edges(shifted_histograms(rows, shifts, instance_pairs(order)), [len(cuts[name]) for name, _ in order]))
    known = moments(found.filter("kind = 'pilot'"), [*PAIR, "moved"])
    both = known.filter("moved = 'a'").drop("moved").withColumnsRenamed({"mu": "mu_a", "sd": "sd_a"}).join(known.filter("moved = 'b'").drop("moved").withColumnsRenamed({"mu": "mu_b", "sd": "sd_b"}), PAIR)
    z = F.least((F.col("edge") - F.col("mu_a")) / F.col("sd_a"), (F.col("edge") - F.col("mu_b")) / F.col("sd_b"))
    name_of = F.array(*[F.lit(name) for name, _ in order])
    scored = found.filter("excess > 0").join(both, PAIR).withColumns({"z": z, "name_a": F.get(name_of, F.col("a")), "name_b": F.get(name_of, F.col("b"))})
    scored = tables.stored(scored)
    keys = ["symbol", "name_a", "name_b"]
    tops = scored.filter("kind = 'null'").groupBy(*keys, "moved", "draw").agg(F.max("z").alias("top"))
    spine = scored.select(*keys).distinct().select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("moved")).select("*", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))).alias("draw"))
    tops = spine.join(tops, [*keys, "moved", "draw"], "left").withColumn("top", F.coalesce("top", F.lit(-1e9)))
    nulls = floors(tops, [*keys, "moved"], percentile)
    sides = [nulls.filter(F.col("moved") == m).drop("moved").withColumnsRenamed({c: f"{c}_{m}" for c in ("floor", "med", "p84")}) for m in "ab"]
    floor = sides[0].join(sides[1], keys)
    # Real edges don't depend on which is moved: shift 0.
    real = scored.filter("kind = 'real' AND moved = 'b' AND valid").join(floor, keys)
    own = PAIR[1:]
    over = (F.col("z") > F.col("floor_a")) & (F.col("z") > F.col("floor_b"))
    best = F.min_by(F.struct(*own, "z", "excess"), F.when(over, F.struct(-F.col("excess"), *own)))
    limits = [f"{c}_{m}" for c in ("floor", "med", "p84") for m in "ab"]
    out = real.groupBy(*keys).agg(F.max("z").alias("T"), *[F.first(c).alias(c) for c in limits], best.alias("x"))
    score = lambda m: F.when(F.col(f"p84_{m}") > F.col(f"med_{m}"), (F.col("T") - F.col(f"med_{m}")) / (F.col(f"p84_{m}") - F.col(f"med_{m}")))
    passed = (F.col("T") > F.col("floor_a")) & (F.col("T") > F.col("floor_b"))
    return out.select(*keys, "T", F.greatest("floor_a", "floor_b").alias("floor"), F.least(score("a"), score("b")).alias("score"), passed.alias("passed"), *[F.col(f"x.{c}").alias(c) for c in own], "x.z", "x.excess")
