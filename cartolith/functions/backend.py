"""One arithmetic for two engines: formulas are written once, against Spark Columns or numpy arrays.

A point that a formula rejects is NULL among Columns and NaN among arrays; both carry on through arithmetic.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Arrays:
    """numpy's side."""

    none = np.nan
    sin, cos, tan, asin, atan, atan2 = np.sin, np.cos, np.tan, np.arcsin, np.arctan, np.arctan2
    sinh, cosh, atanh, exp, log, sqrt, hypot, floor, abs = np.sinh, np.cosh, np.arctanh, np.exp, np.log, np.sqrt, np.hypot, np.floor, np.abs
    pow, low, high = np.power, np.minimum, np.maximum

    @staticmethod
    def lit(v):
        return np.float64(v)

    @staticmethod
    def where(condition, a, b):
        return np.where(condition, a, b)

    @staticmethod
    def both(*conditions):
        return np.logical_and.reduce(np.broadcast_arrays(*conditions))

    @staticmethod
    def iterate(first, step, n: int):
        for _ in range(n):
            first = step(first)
        return first

    @staticmethod
    def once(make, *values):
        """What ``make`` gives for values, each of which it may use many times."""
        return make(*values)


class Columns:
    """Spark's side: everything stays an expression that Catalyst can fold and compile."""

    none = None
    sin, cos, tan, asin, atan, atan2 = F.sin, F.cos, F.tan, F.asin, F.atan, F.atan2
    sinh, cosh, atanh, exp, log, sqrt, hypot, abs = F.sinh, F.cosh, F.atanh, F.exp, F.ln, F.sqrt, F.hypot, F.abs

    @staticmethod
    def lit(v):
        return v if isinstance(v, Column) else F.lit(None if v is None else float(v)).cast("double")

    @staticmethod
    def once(make, *values):
        """What ``make`` gives for values, which are computed once: as a lambda's argument, not copied into each use."""
        row = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
        made = lambda r: F.struct(*(c.alias(f"c{i}") for i, c in enumerate(make(*(r[f"v{i}"] for i in range(len(values)))))))
        out = F.transform(F.array(row), made)
        return tuple(out[0][f"c{i}"] for i in range(2))

    @staticmethod
    def floor(x):
        return F.floor(x).cast("double")

    @staticmethod
    def pow(a, b):
        return F.pow(Columns.lit(a), Columns.lit(b))

    @staticmethod
    def low(a, b):
        return F.least(Columns.lit(a), Columns.lit(b))

    @staticmethod
    def high(a, b):
        return F.greatest(Columns.lit(a), Columns.lit(b))

    @staticmethod
    def where(condition, a, b):
        return F.when(condition, Columns.lit(a)).otherwise(Columns.lit(b))

    @staticmethod
    def both(*conditions):
        out = conditions[0]
        for c in conditions[1:]:
            out = out & c
        return out

    @staticmethod
    def iterate(first, step, n: int):
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), Columns.lit(first), lambda acc, _: step(acc))


def backend(x):
    """The side that a value belongs to."""
    return Columns if isinstance(x, Column) else Arrays
