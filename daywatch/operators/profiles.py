"""Directory snapshots, user profiles and role sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daywatch import fixed
from daywatch.functions.cleaning import WHITESPACE, tidy


def clean_directory(raw: DataFrame) -> DataFrame:
    """Tidy user and supervisor ids; empty supervisors become null, other gaps "Unknown"."""
    supervisor = tidy(F.col("supervisor"))

    def text(name: str) -> Column:
        return F.btrim(F.coalesce(name, F.lit("Unknown")), F.lit(WHITESPACE)).alias(name)

    return raw.select(
        tidy(F.col("user_id")).alias("user"),
        *[text(n) for n in ("employee_name", "role", "department", "team", "functional_unit")],
        F.when(~supervisor.isin("", "nan", "none"), supervisor).alias("supervisor"),
        "snapshot",
    )


def latest_profiles(directory: DataFrame) -> DataFrame:
    """Per user and column the latest non-null value; ``is_active`` when listed in the newest snapshot."""
    newest = directory.agg(F.max("snapshot")).scalar()
    columns = ["employee_name", "role", "department", "functional_unit", "supervisor"]
    return directory.groupBy("user").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("snapshot"))).alias(c) for c in columns],
        F.max("snapshot").alias("_last"),
    ).withColumn("is_active", F.col("_last") == newest).drop("_last")


def peer_assignment(directory: DataFrame, peer_col: str = "role") -> DataFrame:
    """Per user the peer value of the latest snapshot row, null included."""
    return directory.groupBy("user").agg(
        F.max(F.struct("snapshot", F.col(peer_col).alias("peer"))).alias("_last")
    ).select("user", F.col("_last.peer").alias(peer_col))


def role_sensitivity(
    role: Column,
    department: Column,
    weights: dict[str, float] = fixed.ROLE_SENSITIVITY,
    finance: list[str] = fixed.FINANCE_DEPARTMENTS,
) -> Column:
    """Weight of the role; finance departments lift a known role to the floor; unknown roles get the default."""
    pairs = [part for name, weight in weights.items() for part in (F.lit(name), F.lit(weight))]
    known = F.create_map(*pairs)[role]
    lifted = F.when(department.isin(finance) & known.isNotNull(), F.greatest(known, F.lit(fixed.FINANCE_FLOOR)))
    return F.coalesce(lifted, known, F.lit(fixed.DEFAULT_SENSITIVITY))


def sensitivity_band(value: Column) -> Column:
    band = F.when(value.isNotNull(), F.lit("LOW"))
    for name, floor in reversed(fixed.SENSITIVITY_FLOORS.items()):
        band = F.when(value >= floor, name).otherwise(band)
    return band


def with_profiles(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Left join of the profile columns with defaults for unlisted users."""
    weighted = profiles.select(
        "user", "employee_name", "department", "role", "supervisor", "functional_unit", "is_active",
        role_sensitivity(F.col("role"), F.col("department")).alias("role_sensitivity"),
    )
    joined = df.join(weighted, "user", "left")
    unknown = {c: F.coalesce(c, F.lit("Unknown")) for c in ("department", "role", "functional_unit")}
    return joined.withColumns(
        {
            "employee_name": F.coalesce("employee_name", "user"),
            **unknown,
            "role_sensitivity": F.coalesce("role_sensitivity", F.lit(fixed.DEFAULT_SENSITIVITY)),
            "is_active": F.coalesce("is_active", F.lit(False)),
        }
    )


def supervisor_names(profiles: DataFrame) -> DataFrame:
    """Each user's supervisor by name; the id stands in for a supervisor without a profile."""
    people = profiles.select(F.col("user").alias("supervisor"), F.col("employee_name").alias("_name"))
    return (
        profiles.select("user", "supervisor")
        .join(people, "supervisor", "left")
        .select("user", "supervisor", F.coalesce("_name", "supervisor").alias("supervisor_name"))
    )
