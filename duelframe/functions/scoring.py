"""Column expressions: win probabilities, series formats, prices, scores, ages and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rating scale and of the scores.
SCALE = 400.0
LOG_CLIP = 1e-9
MAP_CLIP = 1e-12
CAP = 1e-6


def _col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def win_prob(a: Column | str, b: Column | str) -> Column:
    """P(a beats b) of two ratings."""
    return 1 / (1 + F.pow(F.lit(10.0), (_col(b) - _col(a)) / SCALE))


def logit_gap(p: Column | str) -> Column:
    """The rating gap at which a side wins with probability p."""
    p = _col(p)
    return SCALE * F.log10(p / (1 - p))


def devig(odds_a: Column | str, odds_b: Column | str) -> Column:
    """P(a) of two decimal odds, in proportion."""
    a, b = 1 / _col(odds_a), 1 / _col(odds_b)
    return a / (a + b)


def normalized(prices: Column | str) -> Column:
    """Prices divided by their sum; null where that is not positive."""
    prices = _col(prices)
    total = F.aggregate(prices, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform(prices, lambda x: x / total))


def brier(p: Column | str, y: Column | str) -> Column:
    d = _col(p) - _col(y)
    return d * d


def log_loss(p: Column | str, y: Column | str) -> Column:
    p, y = F.greatest(F.least(_col(p), F.lit(1 - LOG_CLIP)), F.lit(LOG_CLIP)), _col(y)
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))


def map_prob(p3: Column | str) -> Column:
    """The single-map probability q with q*q*(3 - 2q) = p3.

    The cubic's middle root in closed form: with q = 1/2 + sin(x)/1, sin(3x) = 2*p3 - 1.
    """
    p = F.greatest(F.least(_col(p3), F.lit(1 - MAP_CLIP)), F.lit(MAP_CLIP))
    return 0.5 + F.sin(F.asin(2 * p - 1) / 3)


def bo5(p3: Column | str) -> Column:
    """A best-of-three probability as one of a best-of-five."""
    q = map_prob(p3)
    r = 1 - q
    return q * q * q * (1 + 3 * r + 6 * r * r)


def age_days(then: Column | str, now: Column | str) -> Column:
    return (F.unix_micros(_col(now).cast("timestamp")) - F.unix_micros(_col(then).cast("timestamp"))) / 86_400e6


def match_weight(age: Column, bo_type: Column | str, half_life: float | None = None, bo1: float = 1.0) -> Column:
    """Halves every half_life days; best-of-one counts bo1 times."""
    fresh = F.lit(1.0) if half_life is None else F.pow(F.lit(0.5), age / half_life)
    return fresh * F.when(_col(bo_type) == 1, F.lit(float(bo1))).otherwise(F.lit(1.0))


def stale_sigma(sigma: float, per_year: float, idle_days: Column) -> Column:
    """sigma grown with idle years of 365 days; unknown idleness keeps sigma."""
    return F.coalesce(sigma + per_year * idle_days / 365.0, F.lit(float(sigma)))


def sharpened(weight: Column | str, scale: float) -> Column:
    """A weight moved towards 1 (scale below 1) or away from it, kept positive."""
    return F.greatest(F.lit(CAP), 1 - scale * (1 - _col(weight)))


def utc(iso: Column | str) -> Column:
    """A timestamp of an ISO text with any offset; without one it is UTC. Needs a UTC session."""
    return F.try_to_timestamp(_col(iso))


def months_before(day: Column | str, months: int) -> Column:
    """The date so many calendar months earlier, the day clamped to the month."""
    return F.add_months(_col(day).cast("date"), -months)


def team_alias(label: Column | str, aliases: dict[str, str]) -> Column:
    """The canonical name of a label, by trimmed lower case; null if unknown."""
    if not aliases:
        return F.lit(None).cast("string")
    pairs = F.create_map(*(F.lit(x) for k, v in aliases.items() for x in (k.strip().lower(), v)))
    return F.try_element_at(pairs, F.lower(F.trim(_col(label))))


def string_array(text: Column | str) -> Column:
    """A JSON array of strings held as text."""
    return F.from_json(_col(text), "array<string>")


def interval_text(point: Column | str, low: Column | str, high: Column | str) -> Column:
    """As text with two decimals; what lies half-way in decimal is rounded up."""
    return F.format_string("%.2f [%.2f-%.2f]", _col(point), _col(low), _col(high))


def short_sha(data: Column | str) -> Column:
    return F.substring(F.sha1(_col(data)), 1, 12)


def unordered(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """The smaller and the larger side; both null where either is, unlike least() and greatest()."""
    a, b = _col(a), _col(b)
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.least(a, b)), F.when(both, F.greatest(a, b))


def envelope(point: Column | str, low: Column | str, high: Column | str, floor: float = 0.003) -> tuple[Column, Column]:
    """An interval with a least half-width around the point, within 0 and 1."""
    point, low, high = _col(point), _col(low), _col(high)
    return F.greatest(F.lit(0.0), F.least(low, point - floor)), F.least(F.lit(1.0), F.greatest(high, point + floor))
