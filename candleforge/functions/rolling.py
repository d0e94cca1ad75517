"""Row expressions over ordered series, for Spark and as SQL text.

A formula is written once against the methods of an ``Ops`` object. ``SparkOps`` turns it into staged window columns of
a DataFrame; ``SqlOps`` into nested SELECTs that another engine runs, for oracles. Missing values are NULL, never NaN:
a rolling value exists only where all its rows do.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candleforge.functions.stretches import in_order

#: Denominators up to this size give no quotient.
TINY = 1e-15


class SparkOps:
    """``df`` is a table of stretches (``functions.stretches``); of its rows only the stretch's own ones count."""

    def __init__(self, df: DataFrame, key: str = "symbol", order: str = "t"):
        self.df, self.order = df, in_order(key, order)
        self._names = (f"_s{i}" for i in count())

    def frame(self, n: int, before: int = 0):
        return self.order.rowsBetween(-(n - 1) - before, -before)

    def keep(self, x: Column) -> Column:
        """``x`` as a column of its own, which later window functions can read."""
        name = next(self._names)
        self.df = self.df.withColumn(name, x)
        return F.col(name)

    def col(self, name: str) -> Column:
        return F.col(name)

    def lit(self, x: float) -> Column:
        return F.lit(float(x))

    def lag(self, x: Column, n: int = 1) -> Column:
        return self.keep(F.lag(x, n).over(self.order))

    def _full(self, x: Column, n: int, value: Column, before: int = 0) -> Column:
        return self.keep(F.when(F.count(x).over(self.frame(n, before)) == n, value))

    def avg(self, x: Column, n: int) -> Column:
        return self._full(x, n, F.avg(x).over(self.frame(n)))

    def sum(self, x: Column, n: int) -> Column:
        return self._full(x, n, F.sum(x).over(self.frame(n)))

    def max(self, x: Column, n: int) -> Column:
        return self._full(x, n, F.max(x).over(self.frame(n)))

    def min(self, x: Column, n: int) -> Column:
        return self._full(x, n, F.min(x).over(self.frame(n)))

    def std(self, x: Column, n: int) -> Column:
        return self._full(x, n, F.stddev_pop(x).over(self.frame(n)))

    def skew(self, x: Column, n: int) -> Column:
        """Population skewness; null where the spread is 0."""
        return self._full(x, n, F.when(F.stddev_pop(x).over(self.frame(n)) > 0, F.skewness(x).over(self.frame(n))))

    def avg_present(self, x: Column, n: int) -> Column:
        """Mean of the values present in the last n rows, from the n-th row on."""
        return self.keep(F.when(F.col("_bar") + 1 >= n, F.avg(x).over(self.frame(n))))

    def fir(self, x: Column, weights: Sequence[float]) -> Column:
        """Weighted sum of the last values, newest first."""
        n = len(weights)
        oldest_first = F.array(*[F.lit(float(w)) for w in reversed(weights)])
        values = F.collect_list(x).over(self.frame(n))
        total = F.aggregate(F.zip_with(values, oldest_first, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return self._full(x, n, total)

    def rank_share(self, x: Column, n: int) -> Column:
        """Average rank of the last of n values, over n."""
        values = self.keep(F.collect_list(x).over(self.frame(n)))
        less, equal = (F.size(F.filter(values, f)) for f in (lambda v: v < x, lambda v: v == x))
        return self._full(x, n, (less + (equal + 1) / F.lit(2.0)) / F.lit(float(n)))

    def inside_share(self, low: Column, high: Column, x: Column, n: int) -> Column:
        """Share of the n rows before this one whose [low, high] holds x."""
        rows = self.keep(F.collect_list(F.struct(low.alias("l"), high.alias("h"))).over(self.frame(n, 1)))
        hits = F.size(F.filter(rows, lambda r: (r["l"] <= x) & (x <= r["h"])))
        return self._full(low, n, hits / F.lit(float(n)), 1)

    def entropy(self, x: Column, n: int, bins: int) -> Column:
        """Entropy of a histogram of the last n values over equal bins between their extremes."""
        values = self.keep(F.collect_list(x).over(self.frame(n)))
        low, high = self.min(x, n), self.max(x, n)
        width = (high - low) / F.lit(float(bins))
        codes = F.transform(values, lambda v: F.least(F.floor((v - low) / width), F.lit(bins - 1)))
        shares = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(codes, lambda c: c == b)) / F.size(codes))
        total = F.aggregate(shares, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.ln(p)).otherwise(0.0))
        return self.keep(F.when(high > low, total))

    def div(self, a: Column, b: Column) -> Column:
        return F.when(F.abs(b) > TINY, a / b)

    def where(self, cond: Column, a, b=None) -> Column:
        out = F.when(cond, a)
        return out if b is None else out.otherwise(b)

    def present(self, x: Column) -> Column:
        return x.isNotNull()

    def ln(self, x: Column) -> Column:
        return F.when(x > 0, F.ln(x))

    def log2(self, x: Column) -> Column:
        return F.when(x > 0, F.log2(x))

    def log10(self, x: Column) -> Column:
        return F.when(x > 0, F.log10(x))

    def sqrt(self, x: Column) -> Column:
        return F.sqrt(x)

    def abs(self, x: Column) -> Column:
        return F.abs(x)

    def greatest(self, *xs: Column) -> Column:
        return F.greatest(*xs)

    def least(self, *xs: Column) -> Column:
        return F.least(*xs)

    def index(self) -> Column:
        """Rows before this one."""
        return F.col("_bar")


class Sql:
    """An SQL expression with Python's operators."""

    def __init__(self, text: str):
        self.text = text

    def __str__(self) -> str:
        return self.text

    def _two(self, op: str, other) -> Sql:
        return Sql(f"({self.text} {op} {_sql(other)})")

    def __add__(self, other):
        return self._two("+", other)

    def __sub__(self, other):
        return self._two("-", other)

    def __mul__(self, other):
        return self._two("*", other)

    def __truediv__(self, other):
        return self._two("/", other)

    def __gt__(self, other):
        return self._two(">", other)

    def __lt__(self, other):
        return self._two("<", other)

    def __ge__(self, other):
        return self._two(">=", other)

    def __le__(self, other):
        return self._two("<=", other)

    def __ne__(self, other):
        return self._two("<>", other)

    def __eq__(self, other):
        return self._two("=", other)

    def __and__(self, other):
        return self._two("AND", other)

    def __rmul__(self, other):
        return Sql(f"({_sql(other)} * {self.text})")

    def __rsub__(self, other):
        return Sql(f"({_sql(other)} - {self.text})")

    def __radd__(self, other):
        return Sql(f"({_sql(other)} + {self.text})")

    def __rtruediv__(self, other):
        return Sql(f"({_sql(other)} / {self.text})")

    __hash__ = None


def _sql(x) -> str:
    return f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else str(x)


class SqlOps:
    """The same methods for DuckDB; ``source`` grows by a SELECT with each staged column."""

    def __init__(self, source: str, key: str = "symbol", order: str = "t"):
        self.source, self._over = source, f"PARTITION BY {key} ORDER BY {order}"
        self._names = (f"s{i}_" for i in count())

    def frame(self, n: int, before: int = 0) -> str:
        return f"OVER ({self._over} ROWS BETWEEN {n - 1 + before} PRECEDING AND {f'{before} PRECEDING' if before else 'CURRENT ROW'})"

    def keep(self, x) -> Sql:
        name = next(self._names)
        self.source = f"(SELECT *, {x} AS {name} FROM {self.source})"
        return Sql(name)

    def col(self, name: str) -> Sql:
        return Sql(name)

    def lit(self, x: float) -> Sql:
        return Sql(_sql(float(x)))

    def lag(self, x, n: int = 1) -> Sql:
        return self.keep(f"lag({x}, {n}) OVER ({self._over})")

    def _full(self, x, n: int, value, before: int = 0) -> Sql:
        return self.keep(f"CASE WHEN count({x}) {self.frame(n, before)} = {n} THEN {value} END")

    def avg(self, x, n: int) -> Sql:
        return self._full(x, n, f"avg({x}) {self.frame(n)}")

    def sum(self, x, n: int) -> Sql:
        return self._full(x, n, f"sum({x}) {self.frame(n)}")

    def max(self, x, n: int) -> Sql:
        return self._full(x, n, f"max({x}) {self.frame(n)}")

    def min(self, x, n: int) -> Sql:
        return self._full(x, n, f"min({x}) {self.frame(n)}")

    def std(self, x, n: int) -> Sql:
        return self._full(x, n, f"stddev_pop({x}) {self.frame(n)}")

    def skew(self, x, n: int) -> Sql:
        # From power sums about the window's mean, as the engine's own skewness is another estimator.
        values = self.keep(f"list({x}) {self.frame(n)}")
        mean, std = self.avg(x, n), self.std(x, n)
        third = f"list_sum(list_transform({values}, lambda v: pow(v - {mean}, 3))) / {n}"
        return self.keep(f"CASE WHEN {std} > 0 THEN {third} / pow({std}, 3) END")

    def avg_present(self, x, n: int) -> Sql:
        return self.keep(f"CASE WHEN row_number() OVER ({self._over}) >= {n} THEN avg({x}) {self.frame(n)} END")

    def fir(self, x, weights: Sequence[float]) -> Sql:
        n = len(weights)
        values = self._full(x, n, f"list(coalesce({x}, 0)) {self.frame(n)}")
        listed = ", ".join(repr(float(w)) for w in reversed(weights))
        return self.keep(f"list_sum(list_transform(range(1, {n + 1}), lambda k: {values}[k] * CAST([{listed}] AS DOUBLE[])[k]))")

    def rank_share(self, x, n: int) -> Sql:
        values = self.keep(f"list({x}) {self.frame(n)}")
        less, equal = (f"len(list_filter({values}, lambda v: v {op} {x}))" for op in ("<", "="))
        return self._full(x, n, f"({less} + ({equal} + 1) / 2.0) / {float(n)}")

    def inside_share(self, low, high, x, n: int) -> Sql:
        lows, highs = self.keep(f"list({low}) {self.frame(n, 1)}"), self.keep(f"list({high}) {self.frame(n, 1)}")
        hits = f"len(list_filter(list_zip({lows}, {highs}), lambda r: r[1] <= {x} AND {x} <= r[2]))"
        return self._full(low, n, f"{hits} / {float(n)}", 1)

    def entropy(self, x, n: int, bins: int) -> Sql:
        values = self.keep(f"list({x}) {self.frame(n)}")
        low, high = self.min(x, n), self.max(x, n)
        codes = self.keep(f"CASE WHEN {high} > {low} THEN list_transform({values}, lambda v: least(floor((v - {low}) / (({high} - {low}) / {float(bins)})), {bins - 1})) END")
        shares = f"list_transform(range({bins}), lambda b: len(list_filter({codes}, lambda c: c = b)) / {float(n)})"
        return self.keep(f"CASE WHEN {codes} IS NOT NULL THEN -list_sum(list_transform({shares}, lambda p: CASE WHEN p > 0 THEN p * ln(p) ELSE 0.0 END)) END")

    def div(self, a, b) -> Sql:
        return Sql(f"(CASE WHEN abs({b}) > {TINY!r} THEN {a} / {b} END)")

    def where(self, cond, a, b=None) -> Sql:
        return Sql(f"(CASE WHEN {cond} THEN {_sql(a)}" + ("" if b is None else f" ELSE {_sql(b)}") + " END)")

    def present(self, x) -> Sql:
        return Sql(f"({x} IS NOT NULL)")

    def ln(self, x) -> Sql:
        return Sql(f"(CASE WHEN {x} > 0 THEN ln({x}) END)")

    def log2(self, x) -> Sql:
        return Sql(f"(CASE WHEN {x} > 0 THEN log2({x}) END)")

    def log10(self, x) -> Sql:
        return Sql(f"(CASE WHEN {x} > 0 THEN log10({x}) END)")

    def sqrt(self, x) -> Sql:
        return Sql(f"sqrt({x})")

    def abs(self, x) -> Sql:
        return Sql(f"abs({x})")

    def greatest(self, *xs) -> Sql:
        return Sql(f"greatest({', '.join(map(str, xs))})")

    def least(self, *xs) -> Sql:
        return Sql(f"least({', '.join(map(str, xs))})")

    def index(self) -> Sql:
        return self.keep(f"row_number() OVER ({self._over}) - 1")
