"""Windowed indicators of candles, each a formula over ``functions.rolling`` operations.

A value uses at most LOOKBACK candles, its own included; exponential averages are cut to fit and renormalised.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleforge.functions.rolling import SparkOps, SqlOps
from candleforge.functions.stretches import stretched

#: Fixed values.
LOOKBACK, ATR_N, BANDS, ENTROPY_BINS = 100, 14, 2.0, 10
KALMAN_PROCESS, KALMAN_MEASURE = 1e-5, 1e-2


def decay(alpha: float, n: int) -> list[float]:
    """Weights (1 - alpha)**k, newest first, that sum to 1."""
    raw = [(1.0 - alpha) ** k for k in range(n)]
    total = sum(raw)
    return [w / total for w in raw]


def slope_weights(process: float, measure: float, n: int) -> list[float]:
    """Weights, newest first, by which a level-and-slope Kalman filter of n values gives its last slope.

    The gains don't depend on the data, so the last slope is linear in it: the weights come from running the state's
    response to each value on through the later steps.
    """
    p = [[1.0, 0.0], [0.0, 1.0]]
    gains = []
    for _ in range(n):
        p = [[p[0][0] + p[1][0] + p[0][1] + p[1][1] + process, p[0][1] + p[1][1]], [p[1][0] + p[1][1], p[1][1] + process]]
        s = p[0][0] + measure
        k = (p[0][0] / s, p[1][0] / s)
        gains.append(k)
        p = [[(1 - k[0]) * p[0][0], (1 - k[0]) * p[0][1]], [p[1][0] - k[1] * p[0][0], p[1][1] - k[1] * p[0][1]]]
    out = []
    for at in range(n):
        # The first value starts the level as well.
        level, slope = (1.0, 0.0) if at == 0 else (0.0, 0.0)
        for i in range(at, n):
            level += slope
            error = (1.0 if i == at else 0.0) - level
            level, slope = level + gains[i][0] * error, slope + gains[i][1] * error
        out.append(slope)
    return out[::-1]


def _ema(o, x, n: int, win: int):
    return o.fir(x, decay(2.0 / (n + 1.0), win))


def _change(o, x):
    return o.keep(x - o.lag(x))


def _returns(o):
    return o.keep(o.ln(o.div(o.col("close"), o.lag(o.col("close")))))


def _ratio(o, n: int):
    """Relative change over n candles."""
    return o.div(o.col("close"), o.lag(o.col("close"), n)) - 1.0


def true_range(o, first: bool):
    """The first candle, which has none before it, has its own range if ``first``, else nothing."""
    high, low, before = o.col("high"), o.col("low"), o.lag(o.col("close"))
    full = o.greatest(high - low, o.abs(high - before), o.abs(low - before))
    return o.keep(o.where(o.present(before), full, high - low) if first else o.where(o.present(before), full))


def atr(o, n: int = ATR_N, win: int = LOOKBACK - 1):
    return o.fir(true_range(o, False), decay(1.0 / n, win))


def atr_share(o, horizon: float):
    """Average true range over the close, scaled to a horizon of candles."""
    return o.div(atr(o), o.col("close")) * math.sqrt(horizon)


def _middle(o, n: int):
    return (o.max(o.col("high"), n) + o.min(o.col("low"), n)) / 2.0


def _volatility(o, n: int):
    return o.std(_returns(o), n)


def _band_place(o, n: int):
    close = o.col("close")
    mid, sd = o.avg(close, n), o.std(close, n)
    return o.div(close - (mid - BANDS * sd), 2.0 * BANDS * sd)


def rsi(o, period):
    d = _change(o, o.col("close"))
    up, down = o.keep(o.where(o.present(d), o.greatest(d, o.lit(0)))), o.keep(o.where(o.present(d), o.greatest(0.0 - d, o.lit(0))))
    rise, fall = o.fir(up, decay(1.0 / period, LOOKBACK - 1)), o.fir(down, decay(1.0 / period, LOOKBACK - 1))
    return o.where(fall == 0.0, o.where(o.present(rise), 100.0), 100.0 - 100.0 / (1.0 + o.div(rise, fall)))


def adx(o, period):
    high, low = o.col("high"), o.col("low")
    before_close, before_high, before_low = o.lag(o.col("close")), o.lag(high), o.lag(low)
    up, down = high - before_high, before_low - low
    spread = o.keep(o.where(o.present(before_close), o.greatest(high, before_close) - o.least(low, before_close)))
    plus = o.keep(o.where(o.present(before_high), o.where((up > down) & (up > 0.0), up, 0.0)))
    minus = o.keep(o.where(o.present(before_low), o.where((down > up) & (down > 0.0), down, 0.0)))
    weights = decay(1.0 / period, LOOKBACK // 2)
    tr, p, m = o.fir(spread, weights), o.fir(plus, weights), o.fir(minus, weights)
    di_p = o.keep(o.where(o.present(tr), o.where(tr != 0.0, 100.0 * p / tr, 0.0)))
    di_m = o.keep(o.where(o.present(tr), o.where(tr != 0.0, 100.0 * m / tr, 0.0)))
    total = di_p + di_m
    dx = o.keep(o.where(o.present(total), o.where(total != 0.0, 100.0 * o.abs(di_p - di_m) / total, 0.0)))
    out = o.fir(dx, weights)
    return o.where(out != 0.0, out)


def ma_dist(o, period):
    return o.div(o.div(o.col("close"), o.avg(o.col("close"), period)) - 1.0, atr_share(o, period / 3.0))


def momentum(o, period):
    return o.div(_ratio(o, period), atr_share(o, period))


def atr_regime(o, period, sma_period):
    a = atr(o, period, LOOKBACK - sma_period)
    return o.div(a, o.avg_present(a, sma_period))


def histvol_regime(o, period, sma_period):
    hv = _volatility(o, period)
    return o.div(hv, o.avg_present(hv, sma_period))


def donchian_pos(o, period):
    high, low = o.max(o.col("high"), period), o.min(o.col("low"), period)
    return o.div(o.col("close") - low, high - low)


def close_pct_rank(o, period):
    return o.rank_share(o.col("close"), period) * 100.0


def pivot_dist(o, period):
    c = o.col("close")
    return o.div(c - (o.max(o.col("high"), period) + o.min(o.col("low"), period) + c) / 3.0, atr(o))


def vortex(o, period):
    high, low = o.col("high"), o.col("low")
    up, down = o.keep(o.abs(high - o.lag(low))), o.keep(o.abs(low - o.lag(high)))
    return o.div(o.sum(up, period) - o.sum(down, period), o.sum(true_range(o, True), period))


def hurst(o, period):
    r = _returns(o)
    two = o.keep(r + o.lag(r))
    s1, s2 = o.std(r, period), o.std(two, period)
    return 0.5 * o.log2(o.div(s2 * s2, s1 * s1))


def tenkan_kijun(o, tenkan, kijun):
    return o.div(_middle(o, tenkan) - _middle(o, kijun), atr(o))


def cloud_thickness(o, tenkan, kijun, senkou_b):
    return o.div(o.abs((_middle(o, tenkan) + _middle(o, kijun)) / 2.0 - _middle(o, senkou_b)), atr(o))


def price_vs_cloud(o, tenkan, kijun, senkou_b):
    return o.div(o.col("close") - ((_middle(o, tenkan) + _middle(o, kijun)) / 2.0 + _middle(o, senkou_b)) / 2.0, atr(o))


def trend_intensity(o, period):
    mean = o.avg(o.col("close"), period)
    above = o.keep(o.where(o.present(mean), o.where(o.col("close") > mean, 1.0, 0.0)))
    return o.avg(above, period) * 100.0


def macd_hist(o, fast, slow, signal):
    macd = o.keep(_ema(o, o.col("close"), fast, 70) - _ema(o, o.col("close"), slow, 70))
    return o.div(macd - _ema(o, macd, signal, LOOKBACK + 1 - 70), atr(o))


def roc_spread(o, fast, slow):
    return o.div(_ratio(o, fast) - _ratio(o, slow), atr_share(o, slow))


def tsi(o, long, short):
    d = _change(o, o.col("close"))
    size = o.keep(o.abs(d))
    num, den = (_ema(o, _ema(o, x, long, 65), short, LOOKBACK - 65) for x in (d, size))
    return o.where(o.index() >= long + short, 100.0 * o.div(num, den))


def acceleration(o):
    c = o.col("close")
    return o.div(c - 2.0 * o.lag(c) + o.lag(c, 2), atr(o))


def ppo(o, fast, slow):
    a, b = _ema(o, o.col("close"), fast, LOOKBACK), _ema(o, o.col("close"), slow, LOOKBACK)
    return 100.0 * o.div(a - b, b)


def rvi(o, period):
    return o.div(o.avg(o.col("close") - o.col("open"), period), o.avg(o.col("high") - o.col("low"), period))


def bb_bandwidth(o, period):
    return o.div(2.0 * BANDS * o.std(o.col("close"), period), o.avg(o.col("close"), period))


def choppiness(o, period):
    ratio = o.div(o.sum(true_range(o, True), period), o.max(o.col("high"), period) - o.min(o.col("low"), period))
    return 100.0 * o.log10(ratio) / math.log10(period)


def parkinson_ratio(o, period):
    span = o.keep(o.ln(o.div(o.col("high"), o.col("low"))))
    return o.div(o.sqrt(o.avg(span * span, period) / (4.0 * math.log(2.0))), o.std(_returns(o), period))


def vol_of_vol(o, period, sma_period):
    hv = _volatility(o, period)
    return o.div(o.std(hv, sma_period), o.avg_present(hv, sma_period))


def ret_skew(o, period):
    return o.skew(_returns(o), period) * (math.sqrt(period * (period - 1)) / (period - 2))


def donchian_width(o, period):
    return o.div(o.max(o.col("high"), period) - o.min(o.col("low"), period), o.col("close"))


def ulcer_index(o, period):
    top = o.max(o.col("close"), period)
    fall = o.keep(100.0 * o.div(o.col("close") - top, top))
    return o.sqrt(o.avg(fall * fall, period))


def bb_pctb_slope(o, period):
    place = o.keep(_band_place(o, 20))
    return place - o.lag(place, period)


def close_pos_in_bar(o):
    return o.div(o.col("close") - o.col("low"), o.col("high") - o.col("low"))


def range_expansion(o, period):
    span = o.keep(o.col("high") - o.col("low"))
    return o.div(span, o.avg(span, period))


def inside_ratio(o, period):
    before_high, before_low = o.lag(o.col("high")), o.lag(o.col("low"))
    # The first candle has none to lie inside of, and counts as not inside.
    inside = o.keep(o.where((o.col("high") <= before_high) & (o.col("low") >= before_low), 1.0, 0.0))
    return o.avg(inside, period) * 100.0


def open_close_momentum(o):
    return o.div(o.col("close") - o.col("open"), atr(o))


def return_entropy(o, period):
    return o.entropy(_returns(o), period, ENTROPY_BINS)


def kalman_slope(o):
    return o.div(o.fir(o.col("close"), slope_weights(KALMAN_PROCESS, KALMAN_MEASURE, LOOKBACK)), atr(o))


def tpo_density(o, period):
    return o.inside_share(o.col("low"), o.col("high"), o.col("close"), period)


@dataclass(frozen=True)
class Indicator:
    name: str
    formula: Callable
    grid: dict[str, tuple[int, ...]]

    def instances(self) -> list[tuple[str, dict[str, int]]]:
        """Key and parameters of each point of the grid; keys list parameters by name."""
        points = [dict(zip(self.grid, values, strict=True)) for values in product(*self.grid.values())]
        return [(instance_key(self.name, p), p) for p in points]


def instance_key(name: str, params: dict[str, int]) -> str:
    return name + ("__" + "_".join(f"{k}{v}" for k, v in sorted(params.items())) if params else "")


#: Names and grids are fixed values.
_P = (7, 14, 21)
_T = (10, 20, 40)
REGISTRY = {
    i.name: i
    for i in (
        Indicator("rsi", rsi, {"period": _P}),
        Indicator("adx", adx, {"period": _P}),
        Indicator("ma_dist", ma_dist, {"period": (20, 50, 100)}),
        Indicator("momentum", momentum, {"period": (10, 20, 30)}),
        Indicator("atr_regime", atr_regime, {"period": _P, "sma_period": (30, 60)}),
        Indicator("histvol_regime", histvol_regime, {"period": (20, 30), "sma_period": (40, 60)}),
        Indicator("bb_pctb", _band_place, {"n": _T}),
        Indicator("donchian_pos", donchian_pos, {"period": _P}),
        Indicator("close_pct_rank", close_pct_rank, {"period": (100,)}),
        Indicator("pivot_dist", pivot_dist, {"period": _T}),
        Indicator("vortex", vortex, {"period": _P}),
        Indicator("hurst", hurst, {"period": (30, 60)}),
        Indicator("ichimoku_tenkan_K", tenkan_kijun, {"tenkan": (9,), "kijun": (26,)}),
        Indicator("ichimoku_cloud_thickness", cloud_thickness, {"tenkan": (9,), "kijun": (26,), "senkou_b": (52,)}),
        Indicator("ichimoku_price_vs_cloud", price_vs_cloud, {"tenkan": (9,), "kijun": (26,), "senkou_b": (52,)}),
        Indicator("trend_intensity_index", trend_intensity, {"period": (15, 30, 50)}),
        Indicator("macd_hist", macd_hist, {"fast": (6, 12), "slow": (26, 52), "signal": (9,)}),
        Indicator("roc_spread", roc_spread, {"fast": (5, 10), "slow": (20, 40)}),
        Indicator("tsi", tsi, {"long": (25, 50), "short": (13, 26)}),
        Indicator("acceleration", acceleration, {}),
        Indicator("ppo", ppo, {"fast": (6, 12), "slow": (26, 52)}),
        Indicator("rvi", rvi, {"period": _T}),
        Indicator("bb_bandwidth", bb_bandwidth, {"period": (15, 30, 60)}),
        Indicator("choppiness", choppiness, {"period": _P}),
        Indicator("parkinson_ratio", parkinson_ratio, {"period": _T}),
        Indicator("vol_of_vol", vol_of_vol, {"period": (10, 20), "sma_period": (30, 60)}),
        Indicator("ret_skew", ret_skew, {"period": (30, 60)}),
        Indicator("donchian_width", donchian_width, {"period": _T}),
        Indicator("ulcer_index", ulcer_index, {"period": _P}),
        Indicator("bb_pctb_slope", bb_pctb_slope, {"period": (5,)}),
        Indicator("close_pos_in_bar", close_pos_in_bar, {}),
        Indicator("range_expansion", range_expansion, {"period": _T}),
        Indicator("inside_outside_ratio", inside_ratio, {"period": (20, 40)}),
        Indicator("open_close_momentum", open_close_momentum, {}),
        Indicator("return_entropy", return_entropy, {"period": (30, 60)}),
        Indicator("kalman_slope", kalman_slope, {}),
        Indicator("tpo_density", tpo_density, {"period": (50, 75, 99)}),
    )
}


def with_indicator(bars: DataFrame, name: str, params: dict[str, int], out: str = "value", length: int | None = None) -> DataFrame:
    """``bars`` with an indicator's value; intermediate columns are dropped."""
    ops = SparkOps(stretched(bars, LOOKBACK, length=length))
    value = REGISTRY[name].formula(ops, **params)
    return ops.df.select(*bars.columns, value.alias(out), "_own").filter("_own").drop("_own")


def grid_values(bars: DataFrame, name: str) -> DataFrame:
    """(instance, symbol, t, value) for each point of an indicator's grid, from one table of stretches."""
    ops = SparkOps(stretched(bars, LOOKBACK))
    columns = [(key, ops.keep(REGISTRY[name].formula(ops, **params))) for key, params in REGISTRY[name].instances()]
    points = F.explode(F.array(*[F.struct(F.lit(key).alias("instance"), c.cast("double").alias("value")) for key, c in columns]))
    return ops.df.filter("_own").select("symbol", "t", points.alias("p")).select("p.instance", "symbol", "t", "p.value")


def indicator_sql(source: str, name: str, params: dict[str, int], out: str = "value") -> str:
    """DuckDB text of the same, a parenthesised subquery."""
    ops = SqlOps(source)
    value = REGISTRY[name].formula(ops, **params)
    return f"(SELECT symbol, t, open, high, low, close, volume, {value} AS {out} FROM {ops.source})"
