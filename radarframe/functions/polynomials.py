"""Series of one and two variables over arrays of coefficients, with their derivatives, as folds.

Chebyshev and Legendre series are summed by Clenshaw's recurrence from the highest term down, so a term costs a few products and sums don't cancel; the
derivative is carried along by the same recurrence, differentiated. Coefficients may differ by row, in number too; none of them gives 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("standard", "chebyshev", "legendre")


def series(kind: str, coefficients: Column, x: Column) -> Column:
    """A struct (value, slope) of the series with ascending ``coefficients`` (array<double>) at ``x``."""
    if kind not in KINDS:
        raise ValueError(f"the kind is one of {', '.join(KINDS)}")
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("b", "b2", "d", "d2")))
    if kind == "standard":
        step = lambda s, t: F.struct((s["b"] * x + t["c"]).alias("b"), s["b2"].alias("b2"), (s["d"] * x + s["b"]).alias("d"), s["d2"].alias("d2"))
        done = lambda s: F.struct(s["b"].alias("value"), s["d"].alias("slope"))
    elif kind == "chebyshev":
        # the last step counts x where the others count 2 x
        step = lambda s, t: F.struct((t["c"] + 2 * x * s["b"] - s["b2"]).alias("b"), s["b"].alias("b2"), (2 * s["b"] + 2 * x * s["d"] - s["d2"]).alias("d"), s["d"].alias("d2"))
        done = lambda s: F.struct((s["b"] - x * s["b2"]).alias("value"), (s["d"] - s["b2"] - x * s["d2"]).alias("slope"))
    else:
        a, b = (lambda k: (2 * k + 1) / (k + 1)), (lambda k: (k + 1) / (k + 2))
        step = lambda s, t: F.struct(
            (t["c"] + a(t["k"]) * x * s["b"] - b(t["k"]) * s["b2"]).alias("b"), s["b"].alias("b2"), (a(t["k"]) * (s["b"] + x * s["d"]) - b(t["k"]) * s["d2"]).alias("d"), s["d"].alias("d2"),
        )
        done = lambda s: F.struct(s["b"].alias("value"), s["d"].alias("slope"))
    terms = F.reverse(F.transform(coefficients, lambda c, k: F.struct(c.cast("double").alias("c"), k.cast("double").alias("k"))))
    return F.aggregate(terms, zero, step, done)


def surface(kind: str, coefficients: Column, x: Column, y: Column, y_kind: str | None = None) -> Column:
    """A struct (value, dx, dy) of the double series: ``coefficients`` (array<array<double>>) ascend in ``x`` by rows and in ``y`` along them."""
    rows = F.transform(coefficients, lambda row: series(y_kind or kind, row, y))
    outer = lambda part: series(kind, F.transform(rows, lambda r: r[part]), x)
    return F.struct(outer("value")["value"].alias("value"), outer("value")["slope"].alias("dx"), outer("slope")["value"].alias("dy"))


def scaled(v: Column, low: Column | float, high: Column | float) -> Column:
    """``v`` between two bounds as -1 to 1, where Chebyshev and Legendre series live."""
    return (2 * v - (low + high)) / (high - low)
