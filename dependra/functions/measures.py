"""Association measures over the columns o11, r1, c1, n of a contingency table.

All logarithms are to base 2. Where a measure is undefined (a division by zero, the logarithm of zero, a negative cell) it
is NULL. Zero cells add nothing to log-likelihood.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Table:
    """Observed and expected frequencies of the four cells, with row and column sums, as expressions."""

    def __init__(self, o11: str | Column = "o11", r1: str | Column = "r1", c1: str | Column = "c1", n: str | Column = "n"):
        d = lambda x: (F.col(x) if isinstance(x, str) else x).cast("double")
        self.o11, self.r1, self.c1, self.n = d(o11), d(r1), d(c1), d(n)
        self.r2, self.c2 = self.n - self.r1, self.n - self.c1
        self.o12, self.o21 = self.r1 - self.o11, self.c1 - self.o11
        self.o22 = self.r2 - self.o21
        self.e11, self.e12, self.e21, self.e22 = (ratio(r * c, self.n) for r in (self.r1, self.r2) for c in (self.c1, self.c2))

    def cells(self) -> dict[str, Column]:
        names = ("o11", "o12", "o21", "o22", "r1", "r2", "c1", "c2", "n", "e11", "e12", "e21", "e22")
        return {x: getattr(self, x) for x in names}


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def _signed(t: Table, x: Column) -> Column:
    return F.when(t.o11 < t.e11, -x).otherwise(x)


def _log_likelihood(t: Table) -> Column:
    def part(o: Column, e: Column) -> Column:
        return F.when(o == 0, 0.0).otherwise(o * log2(ratio(o, e)))

    return 2 * (part(t.o11, t.e11) + part(t.o12, t.e12) + part(t.o21, t.e21) + part(t.o22, t.e22))


def _delta(t: Table, a: Column, b: Column) -> Column:
    return ratio(t.o11 * t.o22 - t.o12 * t.o21, a * b)


MEASURES: dict[str, Callable[[Table], Column]] = {
    "poisson_stirling_log": lambda t: t.o11 * (log2(t.o11) - log2(t.e11) - 1),
    "z_score": lambda t: ratio(t.o11 - t.e11, root(t.e11)),
    "t_score": lambda t: ratio(t.o11 - t.e11, root(t.o11)),
    "chi_squared": lambda t: ratio((t.o11 + t.o12 + t.o21 + t.o22) * (t.o11 - t.e11) * (t.o11 - t.e11), t.e11 * t.e22),
    "one_sided_chi_squared": lambda t: _signed(t, MEASURES["chi_squared"](t)),
    "log_likelihood": _log_likelihood,
    "one_sided_log_likelihood": lambda t: _signed(t, _log_likelihood(t)),
    "mutual_information": lambda t: log2(ratio(t.o11, t.e11)),
    "local_mi": lambda t: t.o11 * log2(ratio(t.o11, t.e11)),
    "average_mi": _log_likelihood,
    "mi2": lambda t: log2(ratio(t.o11 * t.o11, t.e11)),
    "mi3": lambda t: log2(ratio(t.o11 * t.o11 * t.o11, t.e11)),
    "odds_ratio_disc": lambda t: log2(ratio((t.o11 + 0.5) * (t.o22 + 0.5), (t.o12 + 0.5) * (t.o21 + 0.5))),
    "relative_risk": lambda t: log2(ratio(t.o11 * (t.o12 + t.o22), t.o12 * (t.o11 + t.o21))),
    "liddell": lambda t: _delta(t, t.c1, t.c2),
    "minimum_sensitivity": lambda t: F.when((t.r1 != 0) & (t.c1 != 0), F.least(ratio(t.o11, t.r1), ratio(t.o11, t.c1))),
    "geometric_mean": lambda t: ratio(t.o11, root(t.r1 * t.c1)),
    "dice": lambda t: ratio(2 * t.o11, t.r1 + t.c1),
    "jaccard": lambda t: ratio(t.o11, t.o11 + t.o12 + t.o21),
    "cooccurrence_frequency": lambda t: t.o11,
    "delta_p_column": lambda t: _delta(t, t.c1, t.c2),
    "delta_p_row": lambda t: _delta(t, t.r1, t.r2),
    "max_delta_p": lambda t: F.when((t.c1 * t.c2 != 0) & (t.r1 * t.r2 != 0), F.greatest(_delta(t, t.c1, t.c2), _delta(t, t.r1, t.r2))),
}


def measure(name: str, table: Table | None = None) -> Column:
    return MEASURES[name](table or Table()).alias(name)


def rounded(x: Column, digits: int) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def with_measures(df, names=("one_sided_log_likelihood", "t_score", "dice"), digits: int | None = None, short: bool = True):
    """df with the measures of its columns o11, r1, c1, n; short: one_sided_log_likelihood is named log_likelihood."""
    t = Table()
    for name in names:
        x = MEASURES[name](t)
        df = df.withColumn("log_likelihood" if short and name == "one_sided_log_likelihood" else name, x if digits is None else rounded(x, digits))
    return df
