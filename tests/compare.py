"""Compare a registered query with its SQL on the same parquet tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime().isoformat()
    if hasattr(value, "isoformat"):
        text = value.isoformat()
        return text if "T" in text else text + "T00:00:00"
    if hasattr(value, "tolist"):
        return _plain(value.tolist())
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    columns = sorted(pdf.columns)
    rows = [tuple(_plain(v) for v in row) for row in pdf[columns].itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def difference(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} != {sorted(sql_pdf.columns)}"
    if len(spark_pdf) != len(sql_pdf):
        return f"rows {len(spark_pdf)} != {len(sql_pdf)}"
    left, right = rows_of(spark_pdf), rows_of(sql_pdf)
    wrong = [(a, b) for a, b in zip(left, right) if repr(a) != repr(b)]
    if wrong:
        return f"{len(wrong)} rows differ, columns {sorted(spark_pdf.columns)}: spark {wrong[0][0]} sql {wrong[0][1]}"
    return None
