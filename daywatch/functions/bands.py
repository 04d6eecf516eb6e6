"""Risk bands and score fusion as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from daywatch import fixed


def band_floors(thresholds: dict[str, float] | None = None) -> dict[str, float]:
    """Lower bounds per band. A dictionary with "LOW" gives upper bounds and is shifted up one band."""
    if thresholds is None:
        return dict(fixed.PERCENTILE_FLOORS)
    source = fixed.BANDS[:3] if "LOW" in thresholds else fixed.BANDS[1:]
    return {band: float(thresholds[name]) for band, name in zip(fixed.BANDS[1:], source)}


def band_of_percentile(percentile: Column, thresholds: dict[str, float] | None = None) -> Column:
    """A percentile equal to a bound belongs to the higher band; missing values are LOW."""
    band = F.lit("LOW")
    for name, floor in band_floors(thresholds).items():
        band = F.when(percentile >= floor, name).otherwise(band)
    return F.when(percentile.isNull() | F.isnan(percentile), "LOW").otherwise(band)


def band_of_score(score: Column, ceilings: dict[str, float | Column | None]) -> Column:
    """A score equal to a band's ceiling stays in it; above every ceiling is the last band.

    Numbers are taken in ascending order whatever the dictionary order; columns
    (thresholds from a table) must already ascend.
    """
    items = [(name, math.inf if c is None else c) for name, c in ceilings.items()]
    if not any(isinstance(c, Column) for _, c in items):
        items.sort(key=lambda item: item[1])
    band = F.lit(items[-1][0])
    for name, ceiling in reversed(items):
        unbounded = not isinstance(ceiling, Column) and math.isinf(ceiling)
        band = F.lit(name) if unbounded else F.when(score <= ceiling, name).otherwise(band)
    return band


def severity(band: Column) -> Column:
    """0 for LOW to 3 for CRITICAL."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(fixed.BANDS):
        rank = F.when(band == name, i).otherwise(rank)
    return rank


def check_weights(w1: float, w2: float) -> None:
    if abs(w1 + w2 - 1.0) > 1e-9:
        raise ValueError(f"the weights must add up to 1, not {w1 + w2}")


def composite(first: Column, second: Column, w1: float = 0.5, w2: float = 0.5) -> Column:
    check_weights(w1, w2)
    return first * w1 + second * w2


def both_high(first: Column, second: Column) -> Column:
    return first.isin("HIGH", "CRITICAL") & second.isin("HIGH", "CRITICAL")


def demote_cold_start(band: Column, gate: Column) -> Column:
    """CRITICAL becomes HIGH without a complete baseline."""
    return F.when((band == "CRITICAL") & ~F.coalesce(gate, F.lit(False)), "HIGH").otherwise(band)


def quadrant(ae: Column, iforest: Column, threshold: float = 95.0) -> Column:
    def side(value: Column, name: str) -> Column:
        return F.when(value >= threshold, f"High {name}").otherwise(f"Low {name}")

    return F.concat_ws(" / ", side(ae, "AE"), side(iforest, "IF"))
