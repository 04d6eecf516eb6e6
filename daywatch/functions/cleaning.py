"""Column expressions that clean raw log fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daywatch import fixed

WHITESPACE = " \t\r\n\f\x0b"


def tidy(col: Column) -> Column:
    """Trim all surrounding white space and lower-case."""
    return F.lower(F.btrim(col, F.lit(WHITESPACE)))


def parse_log_time(col: Column) -> Column:
    """``month/day/year hour:minute:second`` text to a zone-free timestamp; bad text is null."""
    pattern = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}:\d{1,2}:\d{1,2})$"
    iso = F.regexp_replace(col, pattern, "$3-$1-$2 $4")
    return F.when(col.rlike(pattern), iso.try_cast("timestamp_ntz"))


def normalise_log(log: DataFrame, drop: tuple[str, ...] = ("id",)) -> DataFrame:
    """Tidy column names and identifiers, parse the time, add ``day``; rows with a bad time go."""
    renamed = log.toDF(*[name.strip().lower() for name in log.columns])
    if "date" in renamed.columns:
        renamed = renamed.withColumnRenamed("date", "timestamp")
    if "timestamp" not in renamed.columns:
        raise KeyError("a log needs a 'date' or 'timestamp' column")
    kind = dict(renamed.dtypes)["timestamp"]
    if kind == "string":
        renamed = renamed.withColumn("timestamp", parse_log_time(F.col("timestamp")))
    elif kind != "timestamp_ntz":
        renamed = renamed.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    ids = {name: tidy(F.col(name).cast("string")) for name in ("user", "pc") if name in renamed.columns}
    return (
        renamed.where(F.col("timestamp").isNotNull())
        .withColumns({"day": F.to_date("timestamp"), **ids})
        .drop(*[name.strip().lower() for name in drop])
    )


def require_columns(df: DataFrame, columns: list[str], what: str = "table") -> None:
    """Schema contract: named columns exist and ``day`` is a date. Reads no data."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing column(s): {missing}")
    if "day" in columns:
        kind = dict(df.dtypes)["day"]
        if kind != "date":
            raise TypeError(f"{what} has an invalid 'day' type: {kind}")


def micros_of_day(ts: Column) -> Column:
    """Microseconds since midnight. Works on zone-free timestamps, so no session zone is involved."""
    whole_minutes = F.hour(ts) * 60 + F.minute(ts)
    seconds = F.date_part(F.lit("SECOND"), ts)
    return (whole_minutes.cast("long") * 60_000_000 + (seconds * 1_000_000).cast("long")).cast("long")


def outside_hours(hour: Column, start: Column, end: Column) -> Column:
    """Both bounds belong to the working day."""
    return (hour < start) | (hour > end)


def late_night(hour: Column) -> Column:
    begins, ends = fixed.LATE_NIGHT
    return (hour >= begins) | (hour < ends)


def external_recipient(to: Column, internal_domain: str = fixed.INTERNAL_EMAIL_DOMAIN) -> Column:
    """True unless the whole recipient text matches the domain pattern anywhere.

    The domain is a regular expression (its dot matches any character) and a
    missing recipient counts as external.
    """
    return ~F.coalesce(to.rlike(internal_domain), F.lit(False))


def clean_url(url: Column) -> Column:
    return tidy(F.coalesce(url.cast("string"), F.lit("")))


def is_long_url(url: Column, length: int = fixed.LONG_URL_LENGTH) -> Column:
    return F.length(url) >= length


def host_before_slash(url: Column) -> Column:
    """Scheme removed, text before the first slash; ports and queries stay."""
    return F.split_part(F.regexp_replace(url, "^https?://", ""), F.lit("/"), F.lit(1))


def network_location(url: Column) -> Column:
    """The authority part of a URL with an assumed http scheme; empty for null or malformed brackets."""
    cleaned = clean_url(url)
    with_scheme = F.when(cleaned.rlike("^https?://"), cleaned).otherwise(
        F.concat(F.lit("http://"), cleaned)
    )
    location = F.regexp_extract(with_scheme, "^https?://([^/?#]*)", 1)
    unbalanced = location.contains("[") != location.contains("]")
    return F.when((cleaned == "") | unbalanced, "").otherwise(location)


def listed(host: Column, domains: list[str]) -> Column:
    return host.isin(domains)


def narrow_types(df: DataFrame) -> DataFrame:
    """double becomes float and bigint becomes int, column order kept."""
    smaller = {"double": "float", "bigint": "int"}
    return df.select(
        *[
            F.col(name).cast(smaller[kind]).alias(name) if kind in smaller else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def feature_columns(df: DataFrame, exclude: list[str] = fixed.NON_FEATURE_COLUMNS) -> list[str]:
    """Model features in column order; any other non-numeric column is an error."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    kept = [(name, kind) for name, kind in df.dtypes if name not in exclude]
    leaked = [name for name, kind in kept if kind not in numeric]
    if leaked:
        raise ValueError(f"non-numeric columns in the model matrix: {leaked}")
    return [name for name, _ in kept]
