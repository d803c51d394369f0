"""Schemas of the tables that operators take and give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
VALUES = (*PRICES, "volume")
BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType()), *(T.StructField(c, T.DoubleType()) for c in VALUES)])


def number(value: Column | str) -> Column:
    """A double, null where the text is none; NaN becomes null, as comparisons with NaN are true in Spark."""
    x = F.col(value) if isinstance(value, str) else value
    x = x.try_cast("double")
    return F.when(~F.isnan(x), x)


def cleaned(df: DataFrame, columns: tuple[str, ...] = VALUES) -> DataFrame:
    """df with these columns as numbers and NaN as null."""
    return df.withColumns({c: number(c) for c in columns if c in df.columns})


def require(df: DataFrame, columns: tuple[str, ...] = VALUES) -> None:
    """Raise ValueError if a column is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
