"""Small scalar functions: categories, ids, JSON, money, time of day."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Product id prefixes and their categories.
CATEGORIES = {"ELEC": "Electronics", "CLTH": "Clothing", "HOME": "Home & Garden", "SPRT": "Sports"}
OTHER_CATEGORY = "Books"


def category(product_id: Column) -> Column:
    out = F.lit(OTHER_CATEGORY)
    for prefix, name in CATEGORIES.items():
        out = F.when(product_id.startswith(prefix), name).otherwise(out)
    return out


def padded(prefix: str, number: Column, width: int) -> Column:
    """prefix and the number with leading zeros; longer numbers are kept whole."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def has_field(json: Column, field: str, value: str) -> Column:
    """Whether the text has "field":value just so; false for null."""
    return F.coalesce(json.contains(f'"{field}":{value}'), F.lit(False))


def cents(x: Column) -> Column:
    """An amount of money as exact decimal, for sums that don't depend on their order."""
    return x.cast("decimal(18,2)")


def round_cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def at_least_zero(x: Column) -> Column:
    return F.greatest(x, F.lit(0).cast("decimal(18,2)"))


def ten_two(x: Column) -> Column:
    """An amount as DECIMAL(10,2), half a cent away from zero; null beyond its range."""
    return x.try_cast("decimal(10,2)")


def mean_ten_two(total: Column, n: Column) -> Column:
    """The mean of n amounts of that exact total as DECIMAL(10,2), rounded once: half a cent goes away from zero."""
    cents, n = (total * 100).cast("long"), n.cast("long")
    whole = F.call_function("div", 2 * F.abs(cents) + n, 2 * n)
    return ten_two((F.signum(cents.cast("double")).cast("long") * whole).cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)"))


def rate_of_day(hour: Column) -> Column:
    """Factor on an order rate by the hour of day: 0.3 at night, with peaks of 1.3 at 9 and 19. Fixed values."""

    def half_wave(lo: int, hi: int) -> Column:
        return F.when(hour.between(lo, hi), F.sin(F.lit(math.pi) * (hour - lo) / 10)).otherwise(0.0)

    return F.lit(0.3) + F.greatest(half_wave(4, 14), half_wave(14, 24), F.lit(0.0))


def burst_factor(second: Column, factor: float = 3.0, lasts: int = 30, every: int = 600, jitter: Column | None = None) -> Column:
    """Bursts on a beat: factor for ``lasts`` seconds, once in every ``every``. With jitter, a number in [0, 1) that is the
    same for all seconds of a beat, a burst begins up to a fifth of the beat late; without, at its start."""
    begin = F.lit(0.0) if jitter is None else jitter * (0.2 * every)
    place = F.pmod(second, F.lit(every))
    return F.when((place >= begin) & (place < begin + lasts), factor).otherwise(1.0)


def weighted(u: Column, weights: dict[str, float]) -> Column:
    """The choice that a number in [0, 1) falls on."""
    total, names = 0.0, list(weights)
    out = F.lit(names[-1])
    edges = []
    for name in names[:-1]:
        total += weights[name]
        edges.append((total, name))
    for edge, name in reversed(edges):
        out = F.when(u < edge, name).otherwise(out)
    return out
