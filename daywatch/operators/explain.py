"""Reconstruction errors split by feature, family and channel. All row-local expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daywatch import fixed

NO_ERROR = 1e-8


def feature_errors(original: Column, rebuilt: Column) -> Column:
    """Squared difference per feature of two arrays."""
    return F.zip_with(original, rebuilt, lambda a, b: (a - b) * (a - b))


def total_error(errors: Column) -> Column:
    return F.aggregate(errors, F.lit(0.0), lambda acc, e: acc + e)


def mean_error(errors: Column) -> Column:
    return F.try_divide(total_error(errors), F.size(errors))


def contribution_ratios(errors: Column, total: Column) -> Column:
    """Share of each feature; a zero total counts as a tiny positive one."""
    safe = F.when(total == 0, F.lit(NO_ERROR)).otherwise(total)
    return F.transform(errors, lambda e: e / safe)


def as_map(features: list[str], values: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(f) for f in features]), values)


def _channel_name(feature: str) -> str:
    for name, prefixes in fixed.CHANNEL_PREFIXES.items():
        if feature.startswith(tuple(prefixes)) or feature in fixed.CHANNEL_FLAGS.get(name, []):
            return name
    return "other"


def _family_name(feature: str) -> str:
    return re.sub("(" + "|".join(fixed.FAMILY_SUFFIXES) + ")$", "", feature)


def feature_groups(features: list[str]) -> dict[str, list[str]]:
    """Features per behaviour channel, each in exactly one."""
    groups: dict[str, list[str]] = {}
    for f in features:
        groups.setdefault(_channel_name(f), []).append(f)
    return groups


def group_errors(errors: str, features: list[str], groups: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """Per group the mean of its family means over the error array column; an empty group is 0.

    Feature positions are known when the plan is built, so no rows are exploded.
    """
    at = {f: i for i, f in enumerate(features)}
    out = {}
    for group, members in (groups or feature_groups(features)).items():
        families: dict[str, list[int]] = {}
        for f in members:
            if f in at:
                families.setdefault(_family_name(f), []).append(at[f])
        means = [f"({' + '.join(f'{errors}[{i}]' for i in where)}) / {len(where)}D" for where in families.values()]
        out[group] = F.expr(f"({' + '.join(means)}) / {len(means)}D") if means else F.lit(0.0)
    return out


def channel_errors(df: DataFrame, errors: str, features: list[str]) -> DataFrame:
    """Mean squared error per report channel for normal and labelled rows, and their ratio."""
    channels: dict[str, list[int]] = {}
    for i, f in enumerate(features):
        name = next((n for n, p in fixed.ERROR_CHANNEL_PATTERNS if re.search(p, f)), "Other")
        channels.setdefault(name, []).append(i)
    aggs = []
    for name, where in channels.items():
        row_mean = f"({' + '.join(f'{errors}[{i}]' for i in where)}) / {len(where)}D"
        for label in (0, 1):
            aggs.append(F.expr(f"avg(CASE WHEN label = {label} THEN {row_mean} END)").alias(f"{name}|{label}"))
    row = df.agg(*aggs)
    cells = [
        F.struct(
            F.lit(name).alias("channel"),
            F.col(f"`{name}|0`").alias("normal_mse"),
            F.col(f"`{name}|1`").alias("labelled_mse"),
            F.try_divide(F.col(f"`{name}|1`"), F.col(f"`{name}|0`")).alias("ratio"),
        )
        for name in channels
    ]
    return row.select(F.inline(F.array(*cells)))
