"""What becomes of an entry: first touch of a target or a stop, time exits, walks without overlap, and simulators."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candleforge.functions.stretches import in_order, stretched

COMMISSION = 0.005


def _outcome(ahead: Column, horizon: int, tp: float, sl: float, commission: float, side: str) -> tuple[Column, Column, Column]:
    """Kind, exit bar and result of an entry at ``close`` with the bars ``ahead`` of it."""
    sign = 1 if side == "LONG" else -1
    good, bad = F.col("close") * (1 + sign * tp / 100.0), F.col("close") * (1 - sign * sl / 100.0)

    def wins(b: Column) -> Column:
        return F.lit(False) if not tp else b["high"] >= good if sign > 0 else b["low"] <= good

    def loses(b: Column) -> Column:
        return F.lit(False) if not sl else b["low"] <= bad if sign > 0 else b["high"] >= bad

    first = F.get(F.filter(ahead, lambda b: wins(b) | loses(b)), F.lit(0))
    earlier = first["high_time"] < first["low_time"] if sign > 0 else first["low_time"] < first["high_time"]
    win = wins(first) & (~loses(first) | F.coalesce(earlier, F.lit(False)))
    last = F.get(ahead, F.lit(horizon - 1))
    drift = F.when(F.col("close") != 0, sign * (last["close"] / F.col("close") - 1) * 100.0)
    gross = F.when(first.isNull(), drift).when(win, F.lit(float(tp))).otherwise(F.lit(-float(sl)))
    kind = F.when(first.isNull(), "TIME").when(win, "TP").otherwise("SL")
    return kind, F.coalesce(first["bar"], last["bar"]), gross - commission * (2 + sign * gross / 100.0)


def _looking_ahead(bars: DataFrame, horizon: int) -> DataFrame:
    """Bars with the next ``horizon`` as they are in ``_next``; each entry's own levels are applied to them."""
    rows = stretched(bars, ahead=horizon).withColumn("bar", F.col("_bar"))
    next_ = F.collect_list(F.struct("bar", "high", "low", "close", "high_time", "low_time")).over(in_order().rowsBetween(1, horizon))
    return rows.withColumn("_next", next_).filter("close > 0 AND _own")


def targets(bars: DataFrame, horizon: int, tp: float, sl: float, commission: float = COMMISSION, side: str = "LONG") -> DataFrame:
    """Screening result of an entry at each close: tp, sl or the close ``horizon`` bars on, in percent after costs.

    The next ``horizon`` bars are scanned; a level of 0 is off. Where both levels are touched in one bar the target counts
    only if its extreme is known to come first, else the stop. A short's target is below and its stop above. The last
    ``horizon`` bars of a symbol have no result. ``exit_bar`` is the bar of the exit.
    """
    kind, exit_bar, y = _outcome(F.col("_next"), horizon, tp, sl, commission, side)
    rows = _looking_ahead(bars, horizon).filter(F.size("_next") == horizon)
    return rows.select("symbol", "t", "bar", kind.alias("kind"), exit_bar.alias("exit_bar"), y.alias("y"))


def grid_targets(bars: DataFrame, configs: list[tuple[float, float, int]], commission: float = COMMISSION) -> DataFrame:
    """(symbol, t, target, y) of each (tp, sl, horizon), its long result numbered evenly and its short one oddly, in one pass."""
    found = []
    for i, (tp, sl, horizon) in enumerate(configs):
        ahead = F.slice("_next", 1, horizon)
        for j, side in enumerate(("LONG", "SHORT")):
            y = F.when(F.size("_next") >= horizon, _outcome(ahead, horizon, tp, sl, commission, side)[2])
            found.append(F.struct(F.lit(2 * i + j).alias("target"), y.alias("y")))
    rows = _looking_ahead(bars, max(h for _, _, h in configs))
    return rows.select("symbol", "t", F.explode(F.array(*found)).alias("x")).select("symbol", "t", "x.target", "x.y").filter("y IS NOT NULL")


def walk(target_rows: DataFrame) -> DataFrame:
    """By symbol the sum and number of results that are taken if an entry waits until after the last exit.

    A fold over the symbol's ordered entries: (next free bar, sum, number).
    """
    ordered = F.array_sort(F.collect_list(F.struct("bar", "exit_bar", "y")))
    start = F.struct(F.lit(-1).cast("long").alias("free"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n"))

    def step(s, e):
        taken = F.struct((e["exit_bar"] + 1).alias("free"), (s["total"] + e["y"]).alias("total"), (s["n"] + 1).alias("n"))
        return F.when(e["bar"] >= s["free"], taken).otherwise(s)

    done = target_rows.groupBy("symbol").agg(F.aggregate(ordered, start, step).alias("w"))
    return done.select("symbol", F.col("w.total").alias("total"), F.col("w.n").alias("n"))


def entries(bars: DataFrame, hold: int, tp: float, sl: float) -> DataFrame:
    """Simulator exit of a long entry at each bar's open, shared by all rules that enter there.

    The entry bar itself is scanned, up to the bar before the time exit at the open ``hold`` bars on; a tie goes to
    the target if its extreme isn't later. Where the data ends first, its last bar is scanned too and its close is the
    exit.
    """
    row = F.struct("t", "open", "high", "low", "close", "high_time", "low_time")
    rows = stretched(bars, ahead=hold).withColumn("_rows", F.collect_list(row).over(in_order().rowsBetween(0, hold))).filter("_own")
    up, down = F.col("open") * (1 + tp / 100.0), F.col("open") * (1 - sl / 100.0)
    rows = rows.withColumn("_hit", F.get(F.filter(F.slice("_rows", 1, hold), lambda b: (b["high"] >= up) | (b["low"] <= down)), F.lit(0)))
    hit, last = F.col("_hit"), F.element_at("_rows", -1)
    win = (hit["high"] >= up) & (~(hit["low"] <= down) | F.coalesce(hit["high_time"] <= hit["low_time"], F.lit(False)))
    timed = F.size("_rows") == hold + 1
    reason = F.when(hit.isNotNull(), F.when(win, "TP").otherwise("SL")).when(timed, "SELL_AFTER").otherwise("END_OF_DATA")
    sell_t = F.when(hit.isNotNull(), F.coalesce(F.when(win, hit["high_time"]).otherwise(hit["low_time"]), hit["t"])).otherwise(last["t"])
    sell_price = F.when(hit.isNotNull(), F.when(win, up).otherwise(down)).when(timed, last["open"]).otherwise(last["close"])
    return rows.filter("open > 0").select("symbol", "t", F.col("open").alias("buy_price"), sell_t.alias("sell_t"), sell_price.alias("sell_price"), reason.alias("exit_reason"))


LOG = "rule_id long, symbol string, buy_t long, buy_price double, sell_t long, sell_price double, qty double, profit double, exit_reason string"


def simulate(
    events: DataFrame, exits: DataFrame, pyramid: bool, capital: float = 1000.0, order: float = 1000.0, leverage: float = 10.0, commission: float = COMMISSION
) -> DataFrame:
    """Trade log of each rule over all symbols with shared capital.

    Exits don't depend on the rule, so they are joined first; a group then holds a rule's own events only. At each
    time entries open in symbol order while free cash covers margin and fee; the first that doesn't ends the batch.
    Without ``pyramid`` a batch opens only when nothing is open, and at the time of the last exit only if that was by
    time.
    """
    fee = commission / 100.0

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        log, held, cash, last = [], [], capital, (-1, False)
        for t, batch in own.sort_values(["t", "symbol"]).groupby("t", sort=True):
            while held and held[0][0] <= t:
                at, _, back, touched = heapq.heappop(held)
                cash += back
                last = (at, touched or (at == last[0] and last[1]))
            if not pyramid and (held or (last[0] == t and last[1])):
                continue
            for e in batch.itertuples():
                if cash < order / leverage + order * fee:
                    break
                qty = order / e.buy_price
                profit = (e.sell_price - e.buy_price) * qty - order * fee - qty * e.sell_price * fee
                cash -= order / leverage + order * fee
                heapq.heappush(held, (e.sell_t, len(log), order / leverage + order * fee + profit, e.exit_reason in ("TP", "SL")))
                log.append((key[0], e.symbol, int(t), e.buy_price, int(e.sell_t), e.sell_price, qty, profit, e.exit_reason))
        return pd.DataFrame(log, columns=[c.split()[0] for c in LOG.split(", ")])

    return events.join(exits, ["symbol", "t"]).groupBy("rule_id").applyInPandas(run, LOG)
