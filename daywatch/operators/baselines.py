"""Causal per-user baselines and peer comparison on user-day tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from daywatch import fixed
from daywatch.operators.profiles import with_profiles

CLIP = 10.0


@dataclass(frozen=True)
class BaselineWindows:
    """Window sizes in rows (days with activity), all ending before the current row."""

    delta: int = 5
    z: int = 30
    z_min: int = 14
    z_long: int = 90
    z_long_min: int = 30
    short_sum: int = 7
    long_sum: int = 30


WHOLE_TYPES = ("byte", "short", "integer", "long")


def with_history(
    df: DataFrame, features: list[str], windows: BaselineWindows = BaselineWindows()
) -> DataFrame:
    """Adds what the causal statistics are computed from, as arrays with one element per feature.

    Everything is on one sort by (user, day). Of whole numbers, totals of values, squares and counts
    run along exactly in Arrow batches, and a window is the difference of two totals: a row costs the same
    for 5 or 90 rows of history, and a large value leaves nothing behind when it leaves the window.
    Scores are differences of doubles, which are right for values of up to fifteen digits. Fractions are aggregated over bounded frames, so that a constant series has a deviation of exactly
    zero. A user has one row per day, which bounds each window partition by the calendar. Nulls count as absent.
    """
    whole = [f for f in features if df.schema[f].dataType.typeName() in WHOLE_TYPES]
    statistics = [
        ("_delta_mean", "mean", windows.delta),
        ("_short_sum", "sum", windows.short_sum),
        ("_long_sum", "sum", windows.long_sum),
        *[(f"_{n}_{part}", part, d) for n, d in (("z", windows.z), ("z90", windows.z_long)) for part in ("n", "mean", "sd")],
    ]
    in_frames = {"sum": "sum", "mean": "avg", "n": "count", "sd": "stddev_samp"}
    frames = [f for f in features if f not in whole]
    columns: list[Column | str] = ["*"]
    if not whole:
        columns.append((F.row_number().over(Window.partitionBy("user").orderBy("day")) - 1).alias("_prior"))
    for name, part, depth in statistics if frames else []:
        over = f"OVER (PARTITION BY `user` ORDER BY day ROWS BETWEEN {depth} PRECEDING AND 1 PRECEDING)"
        values = ", ".join(f"{in_frames[part]}(CAST(`{f}` AS DOUBLE)) {over}" for f in frames)
        columns.append(F.expr(f"array({values})").alias(f"_f{name}"))
    rows = df.select(*columns)
    if whole:
        rows = _with_whole_history(rows, whole, [(f"_w{name}", part, depth) for name, part, depth in statistics])
    if not frames or not whole:
        kept = "_w" if whole else "_f"
        return rows.select(*df.columns, "_prior", *[F.col(f"{kept}{name}").alias(name) for name, _, _ in statistics])
    place = [f"_w%s[{whole.index(f)}]" if f in whole else f"_f%s[{frames.index(f)}]" for f in features]
    merged = [F.expr(f"array({', '.join(p % name for p in place)})").alias(name) for name, _, _ in statistics]
    return rows.select(*df.columns, "_prior", *merged)


#: Rows that a task works on at once, which bounds its arrays of rows x features.
SLICE_ROWS = 2048
#: Products up to here fit 64 bits; above it they are taken of Python's whole numbers.
FITS = 2**63 - 1


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(begin, SLICE_ROWS)


def _whole_numbers(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Values, features x rows with 0 for null, and which are known."""
    x = np.zeros((len(names), batch.num_rows), np.int64)
    known = np.ones(x.shape, bool)
    for i, name in enumerate(names):
        column = batch.column(batch.schema.get_field_index(name))
        if column.null_count:
            known[i] = column.is_valid().to_numpy(zero_copy_only=False)
            column = column.fill_null(0)
        x[i] = column.to_numpy(zero_copy_only=False)
    return x, known


def _largest(x: np.ndarray) -> np.ndarray:
    """The largest magnitude per feature, a little above it for the sake of rounding."""
    return np.abs(x.astype(float)).max(axis=1, initial=0.0) * (1 + 1e-12)


def _lists(values: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    """Features x rows as one list a row."""
    size, rows = values.shape
    flat = pa.array(values.T.ravel(), mask=None if known is None else ~known.T.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * size), flat)


def _with_whole_history(df: DataFrame, features: list[str], statistics: list[tuple[str, str, int]]) -> DataFrame:
    """Adds ``_prior`` and per statistic (name, part, depth) an array over the last ``depth`` rows of a user before.

    Running totals of 64 bits may wrap: their differences don't, as long as a window's own totals fit.
    Features whose values are too large for that are totalled in Python's whole numbers.
    """
    kinds = {name: "array<bigint>" if part == "n" else "array<double>" for name, part, _ in statistics}
    schema = StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"{n} {k}" for n, k in {"_prior": "int", **kinds}.items())).fields])
    depths = sorted({depth for _, _, depth in statistics})
    deepest = depths[-1]

    def windows(x: np.ndarray, known: np.ndarray, low: dict[int, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
        def running(v: np.ndarray) -> np.ndarray:
            return np.concatenate([np.zeros((len(v), 1), v.dtype), np.cumsum(v, axis=1, dtype=v.dtype)], axis=1)

        totals, squares, counts = running(x), running(x * x), running(known.astype(np.int64))
        out = {}
        for depth in depths:
            n, total, square = (r[:, at] - r[:, low[depth]] for r in (counts, totals, squares))
            some = np.maximum(n, 1)
            spread = (n.astype(x.dtype) * square - total * total).astype(float)
            for name, part, d in statistics:
                if d != depth:
                    continue
                out[name] = {
                    "n": lambda: n,
                    "sum": lambda: total.astype(float),
                    "mean": lambda: total.astype(float) / some,
                    "sd": lambda: np.sqrt(spread / (some.astype(float) * np.maximum(n - 1, 1))),
                }[part]()
                out[f"{name}?"] = n > (1 if part == "sd" else 0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows_before, x_before, known_before = None, 0, None, None
        for batch in _slices(batches):
            users = batch.column(batch.schema.get_field_index("user"))
            codes = pc.dictionary_encode(users, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            x, known = _whole_numbers(batch, features)
            held = 0
            if last is not None and users[0].equals(last):
                held = x_before.shape[1]
                x, known = np.hstack([x_before, x]), np.hstack([known_before, known])
            codes = np.concatenate([np.full(held, codes[0]), codes])
            at = np.arange(len(codes))
            first = np.maximum.accumulate(np.where(np.diff(codes, prepend=-1) != 0, at, 0))
            own = at[held:]
            low = {depth: np.maximum(own - depth, first[held:]) for depth in depths}
            prior = own - first[held:]
            if held:
                prior = np.where(first[held:] == 0, prior + rows_before - held, prior)
            large = _largest(x) * deepest >= FITS**0.5
            if large.any():
                parts = [(~large, np.int64), (large, object)]
                found = {}
                for which, dtype in parts:
                    for name, values in windows(x[which].astype(dtype), known[which], low, own).items():
                        whole = found.setdefault(name, np.zeros((len(features), len(own)), values.dtype))
                        whole[which] = values
            else:
                found = windows(x, known, low, own)
            last, rows_before = users[-1], int(prior[-1]) + 1
            tail = max(first[-1], len(codes) - deepest)
            x_before, known_before = x[:, tail:].copy(), known[:, tail:].copy()
            added = [
                _lists(found[name].astype(np.int64) if part == "n" else found[name], None if part == "n" else found[f"{name}?"])
                for name, part, _ in statistics
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prior, pa.int32()), *added], names=schema.names)

    return df.repartition("user").sortWithinPartitions("user", "day").mapInArrow(run, schema)


def statistic_columns(features: list[str], windows: BaselineWindows = BaselineWindows()) -> list[str]:
    """SQL expressions for the statistics of every feature and the gate, on the output of ``with_history``."""

    def z(x: str, i: int, name: str, minimum: int) -> str:
        usable = f"{x} IS NOT NULL AND _{name}_n[{i}] >= {max(minimum, 2)} AND _{name}_sd[{i}] > 0D"
        return f"CASE WHEN {usable} THEN {clipped(f'({x} - _{name}_mean[{i}]) / _{name}_sd[{i}]')} ELSE 0D END"

    out = []
    for i, f in enumerate(features):
        x = f"CAST(`{f}` AS DOUBLE)"
        ratio = f"{x} / (_long_sum[{i}] / {windows.long_sum}D + 0.5D)"
        known = f"{x} IS NOT NULL AND _long_sum[{i}] IS NOT NULL"
        out += [
            f"_short_sum[{i}] AS `{f}_7d_sum`",
            f"_long_sum[{i}] AS `{f}_30d_sum`",
            f"CASE WHEN {known} THEN greatest(0D, least(50D, {ratio})) END AS `{f}_1d_over_30d_ratio`",
            f"{z(x, i, 'z', windows.z_min)} AS `{f}_zscore`",
            f"{z(x, i, 'z90', windows.z_long_min)} AS `{f}_zscore_90d`",
            f"coalesce({x} - _delta_mean[{i}], 0D) AS `{f}_rolling_delta`",
        ]
    return [*out, f"_prior >= {windows.z_min} AS baseline_complete"]


def clipped(z: str) -> str:
    return f"greatest(-{CLIP}D, least({CLIP}D, {z}))"


def user_baselines(
    df: DataFrame, features: list[str], windows: BaselineWindows = BaselineWindows()
) -> DataFrame:
    """Adds per feature ``_7d_sum``, ``_30d_sum``, ``_1d_over_30d_ratio``, ``_zscore``,
    ``_zscore_90d`` and ``_rolling_delta``, and the history gate ``baseline_complete``."""
    kept = [f"`{c}`" for c in df.columns]
    return with_history(df, features, windows).selectExpr(*kept, *statistic_columns(features, windows))


def _array(parts: list[str]) -> Column:
    return F.expr(f"array({', '.join(parts)})")


def _extremes(member: DataFrame, values: list[str]) -> DataFrame:
    """Per (peer, day) and value: count, least, greatest and, of these two, the one further from the mean;
    also a centre, near the mean of the values but one of the further ones."""
    keys = ["_peer", "day"]
    found = member.groupBy(*keys).agg(
        _array([f"count({x})" for x in values]).alias("_dn"),
        _array([f"min({x})" for x in values]).alias("_least"),
        _array([f"max({x})" for x in values]).alias("_most"),
        _array([f"avg({x})" for x in values]).alias("_mean"),
    )
    far = [f"IF(_most[{i}] - _mean[{i}] >= _mean[{i}] - _least[{i}], _most[{i}], _least[{i}])" for i in range(len(values))]
    found = found.withColumn("_far", _array(far))
    centre = [f"_mean[{i}] + (_mean[{i}] - _far[{i}]) / greatest(_dn[{i}] - 1, 1)" for i in range(len(values))]
    return found.withColumn("_centre", _array(centre)).drop("_mean")


def _centred_sums(member: DataFrame, values: list[str]) -> DataFrame:
    """``_extremes`` with the counts of least, greatest and further value and the sums over the others.

    The sums are of distances from the centre and of their squares. One large value, that is the
    further one, is in neither, so leaving a member out never takes away most of a sum.
    """
    keys = ["_peer", "day"]
    extremes = _extremes(member, values)
    near = [f"CASE WHEN {x} <> _far[{i}] THEN {x} - _centre[{i}] END" for i, x in enumerate(values)]
    sums = (
        member.join(extremes, keys)
        .groupBy(*keys)
        .agg(
            _array([f"count_if({x} = _least[{i}])" for i, x in enumerate(values)]).alias("_n_least"),
            _array([f"count_if({x} = _most[{i}])" for i, x in enumerate(values)]).alias("_n_most"),
            _array([f"count_if({x} = _far[{i}])" for i, x in enumerate(values)]).alias("_n_far"),
            _array([f"coalesce(sum({d}), 0D)" for d in near]).alias("_d"),
            _array([f"coalesce(sum(({d}) * ({d})), 0D)" for d in near]).alias("_dd"),
        )
    )
    return extremes.join(sums, keys)


def _centred_scores(values: list[str]) -> str:
    """Scores of all doubles, on member rows joined with ``_centred_sums``: one expression over arrays,
    however many they are."""
    x, times = "v[i]", "(_n_far[i] - IF(v[i] = _far[i], 1, 0))"
    others, reach = "(_dn[i] - 1)", "(_far[i] - _centre[i])"
    own = "IF(v[i] = _far[i], 0D, v[i] - _centre[i])"
    total = f"(_d[i] - {own} + {times} * {reach})"
    squares = f"(_dd[i] - {own} * {own} + {times} * {reach} * {reach})"
    # The others are all equal where all values are, or where this one is the only one of its
    # kind and the rest are at the other end: counts say so exactly.
    alone = (
        f"{x} = _least[i] AND _n_least[i] = 1 AND _n_most[i] = {others}"
        f" OR {x} = _most[i] AND _n_most[i] = 1 AND _n_least[i] = {others}"
    )
    scored = f"{x} IS NOT NULL AND {others} >= 2 AND NOT (_least[i] = _most[i] OR {alone})"
    spread = f"({squares} - {total} * {total} / {others}) / ({others} - 1)"
    z = clipped(f"({x} - _centre[i] - {total} / {others}) / sqrt({spread})")
    each = f"v -> transform(sequence(0, {len(values) - 1}), i -> CASE WHEN {scored} THEN {z} ELSE 0D END)"
    return f"transform(array(array({', '.join(values)})), {each})[0]"


def _whole_sums(member: DataFrame, features: list[str]) -> DataFrame:
    """Per (peer, day): counts, totals and totals of squares of whole numbers, as exact decimals.

    A task adds up its rows first, a batch at a time; only sums are shuffled.
    """
    keys = ["_peer", "day"]
    sums = "_n array<bigint>, _t array<decimal(38,0)>, _q array<decimal(38,0)>"
    schema = StructType([*[member.schema[k] for k in keys], *StructType.fromDDL(sums).fields])
    exact = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [pc.dictionary_encode(batch.column(i), null_encoding="encode").indices.to_numpy(zero_copy_only=False) for i in (0, 1)]
            code = codes[0].astype(np.int64) * (int(codes[1].max()) + 1) + codes[1]
            order = np.argsort(code, kind="stable")
            begins = np.flatnonzero(np.diff(code[order], prepend=-1))
            x, known = _whole_numbers(batch, features)
            x, known = x[:, order], known[:, order].astype(np.int64)
            if (_largest(x) ** 2 * batch.num_rows >= FITS).any():
                x = x.astype(object)
            totals = []
            for v in (x, x * x):
                values = np.add.reduceat(v, begins, axis=1).T.ravel()
                flat = pa.array(values).cast(exact) if v.dtype == np.int64 else pa.array([Decimal(int(n)) for n in values], exact)
                totals.append(pa.ListArray.from_arrays(pa.array(np.arange(len(begins) + 1, dtype=np.int32) * len(features)), flat))
            first = pa.array(order[begins])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(first) for i in (0, 1)], _lists(np.add.reduceat(known, begins, axis=1)), *totals],
                names=schema.names,
            )

    partial = member.select(*keys, *[f"`{f}`" for f in features]).mapInArrow(run, schema)
    places = range(len(features))
    return partial.groupBy(*keys).agg(*[_array([f"sum({c}[{i}])" for i in places]).alias(c) for c in ("_n", "_t", "_q")])


def _with_whole_scores(member: DataFrame, sums: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``_whole_z``, the scores of whole numbers, to member rows that have a group among ``sums``.

    Sums travel as 64 bits where all products of the group's sums fit, else as text, which costs
    Python's whole numbers.
    """
    fits = f"forall(sequence(0, {len(features) - 1}), i -> CAST(_n[i] AS DOUBLE) * CAST(_q[i] AS DOUBLE) < {float(2**62)!r}D)"
    sized = sums.withColumn("_fits", F.expr(fits))
    groups = sized.select(
        "_peer", "day", "_n",
        *[F.expr(f"IF(_fits, CAST({c} AS ARRAY<BIGINT>), NULL)").alias(c) for c in ("_t", "_q")],
        *[F.expr(f"IF(_fits, NULL, CAST({c} AS ARRAY<STRING>))").alias(f"{c}_text") for c in ("_t", "_q")],
    )
    joined = member.join(groups, ["_peer", "day"])
    held = ["_n", "_t", "_q", "_t_text", "_q_text"]
    kept = [c for c in joined.columns if c not in held]
    schema = StructType([*joined.select(*kept).schema.fields, *StructType.fromDDL("_whole_z array<double>").fields])
    size = len(features)

    def scores(x: np.ndarray, known: np.ndarray, count: np.ndarray, total: np.ndarray, square: np.ndarray) -> np.ndarray:
        n = count - 1
        t, q = total - x, square - x * x
        spread = n * q - t * t
        usable = known & (n >= 2).astype(bool) & (spread > 0).astype(bool)
        n, spread, off = (np.where(usable, v, 2).astype(float) for v in (n, spread, x * n - t))
        z = off / n / np.sqrt(spread / n / (n - 1))
        return np.where(usable, np.clip(z, -CLIP, CLIP), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            columns = dict(zip(batch.schema.names, batch.columns))
            x, known = _whole_numbers(batch, features)
            fit = columns["_t"].is_valid().to_numpy(zero_copy_only=False)
            z = np.zeros(x.shape)
            for which, suffix, dtype in ((fit, "", np.int64), (~fit, "_text", object)):
                if not which.any():
                    continue
                sums = []
                for c in ("_n", f"_t{suffix}", f"_q{suffix}"):
                    flat = columns[c].filter(pa.array(which)).flatten()
                    if pa.types.is_string(flat.type) or pa.types.is_large_string(flat.type):
                        values = np.array([int(v) for v in flat.to_pylist()], object)
                    else:
                        values = flat.to_numpy(zero_copy_only=False).astype(dtype)
                    sums.append(values.reshape(-1, size).T)
                z[:, which] = scores(x[:, which].astype(dtype), known[:, which], *sums)
            yield pa.RecordBatch.from_arrays([*[columns[c] for c in kept], _lists(z)], names=schema.names)

    return joined.select(*kept, *held).mapInArrow(run, schema)


def with_peer_scores(
    df: DataFrame,
    features: list[str],
    peers: DataFrame,
    peer_col: str = "role",
    user_profiles: DataFrame | None = None,
) -> DataFrame:
    """Adds ``_peer_z``: per feature the z-score against the other members of the peer group that day.

    ``peers`` has one row per user with ``peer_col``; other users form the group
    "Unknown". Group sums come from a partial aggregation and are joined back, so
    a dominant peer group is never gathered into one task. Profile columns can be
    joined in the same step.

    Sums of whole-number features are exact. Of others a first pass finds the extremes of
    the group, and a second sums distances from a centre, leaving the value furthest out aside;
    whether the others differ at all is told from counts of the extremes, without rounding. A
    member whose others are all equal, or fewer than two, scores zero.
    """
    whole = [f for f in features if df.schema[f].dataType.typeName() in WHOLE_TYPES]
    doubles = [f for f in features if f not in whole]
    group = peers.select("user", F.col(peer_col).alias("_peer"))
    member = df.join(group, "user", "left").withColumn("_peer", F.coalesce("_peer", F.lit("Unknown")))
    value = {f: f"CAST(`{f}` AS DOUBLE)" for f in doubles}

    keys = ["_peer", "day"]
    whole_sums = _whole_sums(member, whole) if whole else None
    double_sums = _centred_sums(member.select(*keys, *[f"`{f}`" for f in doubles]), list(value.values())) if doubles else None

    added: list[str] = []
    if user_profiles is not None:
        member, added = with_profiles(member, user_profiles), fixed.PROFILE_COLUMNS
    if doubles:
        member = member.join(double_sums, keys).withColumn("_double_z", F.expr(_centred_scores(list(value.values()))))
    if whole:
        scored = ["_double_z"] if doubles else []
        member = _with_whole_scores(member.select(*keys, *df.drop("day").columns, *added, *scored), whole_sums, whole)
    z = [f"_double_z[{doubles.index(f)}]" if f in doubles else f"_whole_z[{whole.index(f)}]" for f in features]
    return member.select(*df.columns, *added, _array(z).alias("_peer_z") if doubles else F.col("_whole_z").alias("_peer_z"))


def peer_columns(features: list[str]) -> list[str]:
    return [f"_peer_z[{i}] AS `{f}_peer_zscore`" for i, f in enumerate(features)]


def peer_zscores(
    df: DataFrame, features: list[str], peers: DataFrame, peer_col: str = "role"
) -> DataFrame:
    """Adds ``<feature>_peer_zscore`` columns."""
    kept = [f"`{c}`" for c in df.columns]
    return with_peer_scores(df, features, peers, peer_col).selectExpr(*kept, *peer_columns(features))
