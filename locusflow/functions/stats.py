"""Statistics as Column expressions, so that they stay inside generated code."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for an infinite phred value, or one that isn't defined.
CEILING = 10000.0

# The rational approximation of the normal integral (Hart et al. 1968, 5666).
P = (220.2068679123761, 221.2135961699311, 112.0792914978709, 33.912866078383, 6.37396220353165, 0.7003830644436881, 0.03526249659989109)
Q = (440.4137358247522, 793.8265125199484, 637.3336333788311, 296.5642487796737, 86.78073220294608, 16.06417757920695, 1.755667163182642, 0.08838834764831844)


def _poly(z: Column, c: tuple) -> Column:
    return reduce(lambda acc, x: acc * z + F.lit(x), reversed(c[:-1]), F.lit(c[-1]))


def normal_tail(x: Column) -> Column:
    """The chance that a standard normal variable exceeds x."""
    z = F.abs(x)
    e = F.exp(z * z * -0.5)
    far = e / 2.506628274631001 / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65)))))
    p = F.when(z > 37, 0.0).when(z < 10 / math.sqrt(2), e * _poly(z, P) / _poly(z, Q)).otherwise(far)
    return F.when(x > 0, p).otherwise(1 - p)


def erfc(x: Column) -> Column:
    return 2 * normal_tail(x * math.sqrt(2))


def chi2_tail(x: Column) -> Column:
    """Survival of chi-squared with one degree of freedom; null and negative x count as p = 1."""
    return F.when((x > 0) & ~F.isnan(x), erfc(F.sqrt(x / 2))).otherwise(1.0)


def error_of(quality: Column) -> Column:
    return F.exp(quality * (-math.log(10) / 10))


def phred(p: Column) -> Column:
    """-10 log10 p; CEILING for p of 0 or null, and never a negative zero."""
    return F.when(p.isNull() | (p <= 0), CEILING).otherwise(-10 * F.log10(p) + 0.0)


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of the 2 x 2 table: the tables as rare as this one or rarer, within 1e-8.

    Chances are taken relative to that of the likeliest table and follow from each other by one product, from there up
    and down, so that no factorial is computed; what underflows is too rare to count. The margins are bound once.
    """
    margins = F.struct(a.cast("double").alias("a"), (a + b).cast("double").alias("r"), (a + c).cast("double").alias("c"), (a + b + c + d).cast("double").alias("n"))

    def tested(m: Column) -> Column:
        r, k1, n, own = m["r"], m["c"], m["n"], m["a"]
        lo, hi = F.greatest(F.lit(0.0), r + k1 - n), F.least(r, k1)
        top = F.least(hi, F.greatest(lo, F.floor((r + 1) * (k1 + 1) / (n + 2)))).cast("bigint")
        more = lambda k: (r - k) * (k1 - k) / ((k + 1) * (n - r - k1 + k + 1))
        up, down = F.sequence(top, hi.cast("bigint")), F.filter(F.sequence(top, lo.cast("bigint"), F.lit(-1).cast("bigint")), lambda k: k < top)

        def summed(kept) -> Column:
            """The sum of what is kept of the relative chance of every table."""
            rise = F.aggregate(up, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("x")), lambda s, k: F.struct((s["w"] * more(k)).alias("w"), (s["x"] + kept(k, s["w"])).alias("x")), lambda s: s["x"])
            step = lambda s, k: s["w"] / more(k)
            fall = F.aggregate(down, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("x")), lambda s, k: F.struct(step(s, k).alias("w"), (s["x"] + kept(k, step(s, k))).alias("x")), lambda s: s["x"])
            return rise + fall

        own_chance = summed(lambda k, w: F.when(k == own, w).otherwise(0.0))
        total = summed(lambda k, w: w)
        rare = F.get(F.transform(F.array(own_chance * (1 + 1e-8)), lambda most: summed(lambda k, w: F.when(w <= most, w).otherwise(0.0))), F.lit(0))
        return F.least(F.lit(1.0), rare / total)

    return F.get(F.transform(F.array(margins), tested), F.lit(0))


def fisher_phred(a: Column, b: Column, c: Column, d: Column) -> Column:
    return phred(fisher(a, b, c, d))


def odds_ratio(ref_fwd: Column, ref_rev: Column, alt_fwd: Column, alt_rev: Column) -> Column:
    """The strand odds ratio; CEILING where the denominator is 0."""
    return F.when(ref_rev * alt_fwd > 0, (ref_fwd * alt_rev) / (ref_rev * alt_fwd)).otherwise(CEILING)


def trend(counts: list[Column], totals: list[Column]) -> Column:
    """Chi-squared of the trend in proportions with scores 1, 2, ..."""
    x, n = sum(counts), sum(totals)
    p = x / n
    scores = range(1, len(counts) + 1)
    t = sum((c - m * p) * s for s, c, m in zip(scores, counts, totals))
    mean = sum(m * s for s, m in zip(scores, totals)) / n
    v = p * (1 - p) * (sum(m * s * s for s, m in zip(scores, totals)) - n * mean * mean)
    return F.when(v > 0, t * t / v)


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0, by Stirling's series from z + 9 on."""
    x = z + 9
    series = (x - 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return series - F.log(reduce(lambda a, b: a * b, [z + k for k in range(9)]))


def gamma_lower(s: Column, z: Column) -> Column:
    """The regularised lower incomplete gamma function: its power series, or 1 less the upper one's continued fraction where z exceeds s + 1."""
    return F.when(z <= 0, 0.0).when(z <= s + 1, _gamma_series(s, z)).otherwise(1 - _gamma_fraction(s, z))


def gamma_upper(s: Column, z: Column) -> Column:
    return F.when(z <= 0, 1.0).when(z <= s + 1, 1 - _gamma_series(s, z)).otherwise(_gamma_fraction(s, z))


def chi_squared_tail(x: Column, degrees: Column) -> Column:
    """The chance that a chi-squared value of any number of degrees of freedom exceeds x."""
    return gamma_upper(degrees / 2.0, x / 2.0)


def _gamma_series(s: Column, z: Column) -> Column:
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    step = lambda a, k: F.struct((a["term"] * z / (s + k)).alias("term"), (a["sum"] + a["term"] * z / (s + k)).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, step, lambda a: a["sum"])
    return F.exp(s * F.log(z) - z - log_gamma(s + 1) + F.log(total))


def _gamma_fraction(s: Column, z: Column) -> Column:
    # The fraction is evaluated from its far end, so that no term has to be guarded against 0.
    tail = F.aggregate(F.sequence(F.lit(150), F.lit(1), F.lit(-1)), F.lit(0.0), lambda a, k: k * (s - k) / (z + 2 * k + 1 - s + a))
    return F.exp(s * F.log(z) - z - log_gamma(s)) / (z + 1 - s + tail)


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    low = x < (a + 1) / (a + b + 2)
    p, q, y = F.when(low, a).otherwise(b), F.when(low, b).otherwise(a), F.when(low, x).otherwise(1 - x)

    def term(m: Column) -> tuple[Column, Column]:
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        return even, odd

    tail = F.aggregate(F.sequence(F.lit(100), F.lit(1), F.lit(-1)), F.lit(0.0), lambda s, m: term(m)[0] / (1 + term(m)[1] / (1 + s)))
    first = -(p + q) * y / (p + 1)
    value = F.exp(p * F.log(y) + q * F.log(1 - y) + log_gamma(p + q) - log_gamma(p) - log_gamma(q)) / p / (1 + first / (1 + tail))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(low, value).otherwise(1 - value)


def fisher_2x3(x: list[Column], n: list[Column]) -> Column:
    """Fisher's exact p of two rows x and n - x over three columns: the tables with the same margins that are as rare or rarer, within 1e-7."""
    given = F.struct(*[c.cast("bigint").alias(k) for k, c in zip(("a", "b", "c", "n1", "n2", "n3"), [*x, *n])])

    def tested(m: Column) -> Column:
        row = m["a"] + m["b"] + m["c"]
        ways = lambda k, total: log_gamma(total + 1.0) - log_gamma(k + 1.0) - log_gamma(total - k + 1.0)
        weight = lambda i, j: ways(i, m["n1"]) + ways(j, m["n2"]) + ways(row - i - j, m["n3"])
        span = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
        zero = F.lit(0).cast("bigint")
        start = F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("rare"))
        add = lambda s, w: F.struct((s["all"] + w).alias("all"), (s["rare"] + F.when(w <= 1 + 1e-7, w).otherwise(0.0)).alias("rare"))
        # One fold inside the other: what is held is a row of places, never all tables.
        others = lambda i: span(F.greatest(zero, row - i - m["n3"]), F.least(m["n2"], row - i))
        sums = F.aggregate(span(zero, F.least(m["n1"], row)), start, lambda s, i: F.aggregate(others(i), s, lambda t, j: add(t, F.exp(weight(i, j) - weight(m["a"], m["b"])))))
        return sums["rare"] / sums["all"]

    return F.get(F.transform(F.array(given), tested), F.lit(0))
