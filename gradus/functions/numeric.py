"""Pay, score and layout expressions. Rounding is half to even throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradus import fixed


def to_double(col: Column) -> Column:
    """Numeric text to double; markers, blanks and NaN become NULL."""
    value = col.try_cast("double")
    return F.when(~F.isnan(value), value)


def tier(wage: Column, tiers: list[tuple[float | None, str]] = fixed.TIERS) -> Column:
    """Pay tier by strict ceilings; a missing wage falls through to the last tier."""
    *bounded, (_, last) = tiers
    out = F
    for ceiling, label in bounded:
        out = out.when(wage < ceiling, F.lit(label))
    return out.otherwise(F.lit(last))


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of a small fixed table."""
    if not table:
        return F.lit(default)
    out = F
    for k, v in table.items():
        out = out.when(key == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def bubble_size(wage: Column, low=40_000, high=150_000, smallest=12, largest=40) -> Column:
    """Marker size, linear in the clamped wage."""
    clamped = F.least(F.greatest(wage, F.lit(float(low))), F.lit(float(high)))
    return F.bround(smallest + (clamped - low) / (high - low) * (largest - smallest)).cast("int")


def effective_wage(user_wage: Column, otherwise: Column) -> Column:
    """The reported wage unless it is absent or zero."""
    return F.coalesce(F.nullif(user_wage, F.lit(0.0)), otherwise)


def wage_label(user_wage: Column, otherwise: str) -> Column:
    return F.when(F.nullif(user_wage, F.lit(0.0)).isNotNull(), "user-reported").otherwise(otherwise)


def roi(current: Column, target: Column, cost: float = fixed.TRAINING_COST) -> Column:
    """Return-on-training figures as a struct."""
    annual = target - current
    monthly = annual / 12
    return F.struct(
        F.bround(current, 0).alias("wage_used_for_roi"),
        F.bround(annual, 0).alias("annual_salary_uplift"),
        F.bround(monthly, 0).alias("monthly_uplift"),
        F.lit(float(cost)).alias("training_cost_estimate"),
        F.when(monthly > 0, F.bround(F.lit(float(cost)) / F.nullif(monthly, F.lit(0.0)), 1)).alias("breakeven_months"),
        F.bround(annual * 5 - cost, 0).alias("five_year_net_gain"),
    )


def gap_pct(similarity: Column) -> Column:
    return F.bround((1 - similarity) * 100, 1)


def uplift_pct(current: Column, target: Column) -> Column:
    return F.round((target - current) / current * 100)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scale to 0..1; a constant column scales to 0."""
    return F.when(high == low, F.lit(0.0)).otherwise((value - low) / (high - low))


def polar_position(index: Column, count: Column, wage: Column) -> list[Column]:
    """Ring layout: the angle follows the index, the radius and marker follow pay."""
    angle = index / count * (2 * math.pi)
    radius = 2 + wage / 120_000 * 3
    return [
        F.round(F.cos(angle) * radius, 2).alias("x"),
        F.round(F.sin(angle) * radius, 2).alias("y"),
        (8 + wage / 120_000 * 8).alias("r"),
    ]
