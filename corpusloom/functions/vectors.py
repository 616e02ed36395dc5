"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length, which counts as 1e-9 at least."""
    # a variable of a lambda is found once; an expression in the inner one is found again for each component
    n = F.array(F.greatest(norm(a), F.lit(1e-9)))
    return F.get(F.transform(n, lambda n: F.transform(a, lambda x: x.cast("double") / n)), F.lit(0))


def vector_sum(a: Column, size: int) -> Column:
    """Aggregate: element-wise sum of arrays of one length; sums combine on the map side, so a large group is one row."""
    return F.array(*[F.sum(F.get(a, F.lit(i))) for i in range(size)])


def mulaw(a: Column, bits: int = 8, mu: float = 255.0) -> Column:
    """Samples through mu-law companding and back."""
    steps = float(2 ** (bits - 1) - 1)

    def one(v: Column) -> Column:
        x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.cast("double")))
        y = F.rint(F.signum(x) * F.log1p(mu * F.abs(x)) / F.log1p(F.lit(mu)) * steps) / steps
        return F.signum(y) * (F.pow(F.lit(1.0 + mu), F.abs(y)) - 1) / mu

    return F.transform(a, one)
