"""Column functions: numbers, angles, strings, digests, times. Undefined results are NULL, never zero."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero or either is NULL."""
    return F.try_divide(a, b)


def correlation(a: str, b: str) -> Column:
    """Pearson's coefficient as an aggregate; NULL without variance, where the built-in raises."""
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series eight places further on, less the factors in between."""
    y = x + F.lit(8.0)
    between = x
    for k in range(1, 8):
        between = between * (x + F.lit(float(k)))
    series = F.lit(1 / 12) / y - F.lit(1 / 360) / F.pow(y, F.lit(3)) + F.lit(1 / 1260) / F.pow(y, F.lit(5)) - F.lit(1 / 1680) / F.pow(y, F.lit(7))
    return (y - 0.5) * F.ln(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.ln(between)


def entropy_bits(p: Column) -> Column:
    """Entropy of a coin, 0 at p = 0 and p = 1."""
    part = lambda q: F.when(q > 0, -q * F.log2(q)).otherwise(0.0)
    return part(p) + part(1 - p)


def radical_inverse(n: Column, base: int, digits: int = 12) -> Column:
    """The digits of n in a base mirrored at the point; exact below base ** digits."""
    terms = [((F.floor(n / base**k)) % base) / float(base ** (k + 1)) for k in range(digits)]
    return sum(terms[1:], terms[0])


def angle_distance(a: Column, b: Column, period: float = 360.0) -> Column:
    """The shorter way round between two angles; with period 180 between two axes."""
    d = F.pmod(a - b, F.lit(period))
    return F.least(d, period - d)


def wrapped(a: Column, period: float = 2 * math.pi) -> Column:
    """An angle difference brought to [-period/2, period/2)."""
    return F.pmod(a + period / 2, F.lit(period)) - period / 2


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: list[Column]) -> Column:
    return F.sqrt(sum((x * x for x in a[1:]), a[0] * a[0]))


def dot(a: list[Column], b: list[Column]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def angle_degrees(cosine: Column) -> Column:
    return F.degrees(F.acos(clamp(cosine, -1.0, 1.0)))


def is_sha256(s: Column) -> Column:
    return F.coalesce(s.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_public_url(s: Column) -> Column:
    return F.coalesce(s.rlike("^https?://[^\\s/]+"), F.lit(False))


def is_relative_path(s: Column) -> Column:
    return F.coalesce((F.length(s) > 0) & ~s.startswith("/") & ~s.contains("..") & ~s.contains("\\"), F.lit(False))


def hash_draw(*parts: Column | str) -> Column:
    """A number in [0, 2^32) from the SHA-256 of the parts joined by '|': the same in every engine."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


def strict_utc(s: Column) -> Column:
    """A timestamp from text that ends in Z; anything else is NULL."""
    return F.when(s.rlike("^\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?Z$"), F.try_to_timestamp(s))


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 3.6e9
