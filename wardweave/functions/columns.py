"""Column helpers: guarded division, compactness, schedules, opportunity scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, NaN where b is not above zero."""
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(NAN))


def compactness(area: Column, perimeter: Column) -> Column:
    """Area against that of a circle with the same perimeter; NaN without a perimeter."""
    return F.when(perimeter != 0, F.lit(4 * math.pi) * area / (perimeter * perimeter)).otherwise(F.lit(NAN))


def _phase(step: Column, period: int) -> Column:
    return F.pmod(step, F.lit(period)).cast("double")


def jump_cycle(step: Column, hot: int, cold: int) -> Column:
    return F.when(_phase(step, hot + cold) < hot, 0.0).otherwise(1.0)


def linear_cycle(step: Column, hot: int, cool: int, cold: int, down: bool = True) -> Column:
    """0, then up to 1 in `cool` steps, 1, and down again if `down`."""
    t = _phase(step, hot + cool * (2 if down else 1) + cold)
    up = (t - hot) / float(cool)
    out = F.when(t < hot, 0.0).when(t < hot + cool, up)
    return out.when(t < hot + cool + cold, 1.0).otherwise(1 - (t - hot - cool - cold) / float(cool)) if down else out.otherwise(1.0)


def logit_cycle(step: Column, hot: int, cool: int, cold: int, down: bool = True) -> Column:
    """As linear_cycle with a logistic ramp, held within 0 and 1."""
    t = _phase(step, hot + cool * (2 if down else 1) + cold)
    ramp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.ln(x / (1 - x)) + 5) / 10.0))
    up = F.when((t > hot) & (t < hot + cool), (t - hot) / float(cool))
    out = F.when(t <= hot, 0.0).when(t < hot + cool, ramp(up))
    if not down:
        return out.otherwise(1.0)
    back = F.when(t > hot + cool + cold, 1 - (t - hot - cool - cold) / float(cool))
    return out.when(t <= hot + cool + cold, 1.0).otherwise(ramp(back))


def opportunity(share: Column, threshold: float) -> dict[str, Column]:
    """Five aggregates over a plan's districts of a group's share."""
    t = F.lit(float(threshold))
    n = F.count_if(share >= t)
    below = F.max(F.when(share < t, share))
    above, mean = F.max(F.when(share >= t, share)), F.avg(F.when(share >= t, share))
    return {
        "n_districts": n,
        "partial_district": n + below,
        "next_highest_close": F.when(below < t - 0.1, n.cast("double")).otherwise(n + 10 * (below - t + 0.1)),
        "maximum_over": F.when(n == 0, F.lit(0.0)).otherwise(n + (1 - above) / (1 - t)),
        "average_over": F.when(n == 0, F.lit(0.0)).otherwise(n + (1 - mean) / (1 - t)),
    }
