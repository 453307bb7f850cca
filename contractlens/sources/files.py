"""Readers and writers by contract format. Connectors that are not installed are reported, not guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..contract import Dataset

#: Formats that Spark reads and writes itself.
BUILT_IN = ("parquet", "orc", "csv", "json", "text")
#: Formats that need a connector on the class path.
CONNECTORS = {"avro": "avro", "delta": "delta", "iceberg": "iceberg", "hudi": "hudi", "kafka": "kafka", "bigquery": "bigquery", "jdbc": "jdbc", "hive": "hive", "table": None}


class NoConnector(Exception):
    """The format's connector is not installed."""


def read(spark: SparkSession, d: Dataset) -> DataFrame:
    """The declared dataset, only the declared columns, CSV laid out as declared."""
    f = d.format or "parquet"
    if f in ("table", "hive"):
        df = spark.table(d.location)
    elif f in ("excel", "feather"):
        df = _by_pandas(spark, d.location, f)
    else:
        reader = spark.read.format(f)
        for k, v in d.csv.items():
            reader = reader.option({"delimiter": "sep"}.get(k, k), str(v).lower() if isinstance(v, bool) else v)
        if f in ("csv", "json") and d.schema:
            reader = reader.schema(", ".join(f"`{x.name}` {_ddl(x.type)}" for x in d.schema))
        try:
            df = reader.load(d.location)
        except Exception as x:
            if f not in BUILT_IN:
                raise NoConnector(f"{f}: {str(x).splitlines()[0]}") from x
            raise
    have = {c.lower() for c in df.columns}
    return df.select(*[f"`{x.name}`" for x in d.schema if x.name.lower() in have]) if d.schema else df


def _ddl(kind: str) -> str:
    return {"integer": "int", "long": "bigint", "short": "smallint", "byte": "tinyint"}.get(kind.lower(), kind)


def _by_pandas(spark: SparkSession, location: str, f: str) -> DataFrame:
    """Single small files of desktop formats, through pandas on the driver."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(location) if f == "excel" else pd.read_feather(location))


def write(df: DataFrame, d: Dataset, location: str | None = None, mode: str | None = None) -> None:
    """df in the declared format, layout, partitioning and mode."""
    f = d.format or "parquet"
    if f == "feather":
        return _feather(df, location or d.location, mode or d.save_mode or "error")
    w = df.write.format(f).mode(mode or d.save_mode or "error")
    for k, v in d.csv.items():
        w = w.option({"delimiter": "sep"}.get(k, k), str(v).lower() if isinstance(v, bool) else v)
    if d.overwrite:
        w = w.option("partitionOverwriteMode", d.overwrite)
    keys = d.partition_keys
    w = w.partitionBy(*keys) if keys else w
    w.saveAsTable(location or d.location) if f in ("table", "hive") else w.save(location or d.location)


def _feather(df: DataFrame, location: str, mode: str) -> None:
    """One file of a desktop format, by way of the driver: for results that fit there."""
    import os

    import pyarrow.feather as feather

    path = location.removeprefix("file:")
    if mode == "append":
        raise NoConnector("a feather file cannot be appended to")
    if os.path.exists(path) and mode in ("error", "ignore"):
        if mode == "error":
            raise FileExistsError(path)
        return
    feather.write_feather(df.toArrow(), path)
