"""Statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms summed beyond this many standard deviations (and a few hundred) from the first are below a double's precision.
_SPREAD, _EXTRA = 40, 200


def ln_factorial(n: Column) -> Column:
    """ln n!, exact to 20 and by Stirling's series beyond."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) of a binomial (n, p): 1 for k <= 0, 0 for p <= 0 or k > n, 1 for p >= 1.

    The first term is worked out in logarithms and the others from it by their ratio, upwards from k where k lies
    above the mean, else downwards from k - 1 as the complement; the number of terms grows with the square root of n.
    """
    k, n = k.cast("bigint"), n.cast("bigint")
    upper = k >= n * p
    start = F.when(upper, k).otherwise(k - 1)
    lead = F.exp(ln_factorial(n) - ln_factorial(start) - ln_factorial(n - start) + start * F.log(p) + (n - start) * F.log(1 - p))
    width = F.ceil(_SPREAD * F.sqrt(n * p * (1 - p)) + _EXTRA).cast("bigint")
    begin = F.struct(lead.alias("term"), F.lit(0.0).alias("total"))
    up = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.least(n - k, width)), begin, lambda a, j: F.struct((a["term"] * (n - k - j) / (k + j + 1) * p / (1 - p)).alias("term"), (a["total"] + a["term"]).alias("total")), lambda a: a["total"])
    down = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.least(k - 1, width)), begin, lambda a, j: F.struct((a["term"] * (k - 1 - j) / (n - k + 2 + j) * (1 - p) / p).alias("term"), (a["total"] + a["term"]).alias("total")), lambda a: 1 - a["total"])
    tail = F.when(upper, up).otherwise(down)
    return F.when(k <= 0, 1.0).when(p <= 0, 0.0).when(p >= 1, 1.0).when(k > n, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))
