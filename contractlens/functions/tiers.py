"""The example transformation: a squared value and its tier, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lower bounds of the tiers, highest first; below the last one a value is low.
TIERS = (("high", 75), ("medium", 25))


def tier(value: Column) -> Column:
    out = F.when(value >= TIERS[0][1], TIERS[0][0])
    for name, bound in TIERS[1:]:
        out = out.when(value >= bound, name)
    return out.otherwise("low")


def with_tiers(df: DataFrame, value: str = "value") -> DataFrame:
    """df with value_squared and value_tier; raises ValueError if the column is missing. Rows without a value are left out."""
    if value not in df.columns:
        raise ValueError(f"no column {value}; there are {', '.join(df.columns)}")
    v = F.col(f"`{value}`")
    return df.where(v.isNotNull()).withColumn("value_squared", v * v).withColumn("value_tier", tier(v))
