"""Value checks on rows: every check of a frame in one aggregation, whatever their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import Constraint, Field


def _number(kind) -> bool:
    return isinstance(kind, T.NumericType)


def _same(col: Column, kind, value) -> Column:
    """Equal by value across numeric types; text, booleans and numbers never equal each other."""
    if isinstance(value, bool):
        return col == F.lit(value) if isinstance(kind, T.BooleanType) else F.lit(False)
    if isinstance(value, (int, float)):
        return col == F.lit(value) if _number(kind) else F.lit(False)
    return col == F.lit(value) if isinstance(kind, T.StringType) else F.lit(False)


def failing(df: DataFrame, name: str, c: Constraint) -> Column:
    """True where a row fails the check; never null, and a null value never fails."""
    col, kind, s = F.col(f"`{name}`"), df.schema[name].dataType, c.spec
    if c.kind == "equals":
        bad = ~_same(col, kind, s["value"])
    elif c.kind == "oneOf":
        ok = F.lit(False)
        for v in s["value"]:
            ok = ok | _same(col, kind, v)
        bad = ~ok
    elif c.kind in ("range", "fieldRange"):
        if not _number(kind):
            bad = F.lit(c.kind == "range")
        else:
            bad = F.isnan(col.cast("double")) if c.kind == "range" else F.lit(False)
            for op, out in (("gte", lambda a, b: a < b), ("gt", lambda a, b: a <= b), ("lte", lambda a, b: a > b), ("lt", lambda a, b: a >= b)):
                if op not in s:
                    continue
                if c.kind == "range":
                    bad = bad | out(col, F.lit(s[op]))
                elif s[op] in df.columns and _number(df.schema[s[op]].dataType):
                    other = F.col(f"`{s[op]}`")
                    bad = bad | F.coalesce(out(col, other) & ~F.isnan(other.cast("double")), F.lit(False))
    else:
        n = F.char_length(col) if isinstance(kind, T.StringType) else F.size(col) if isinstance(kind, T.ArrayType) else None
        if n is None:
            bad = F.lit(True)
        else:
            lo, hi = s.get("exact", s.get("min")), s.get("exact", s.get("max"))
            bad = (n < lo if lo is not None else F.lit(False)) | (n > hi if hi is not None else F.lit(False))
    return col.isNotNull() & F.coalesce(bad, F.lit(False))


def null_counts(df: DataFrame) -> DataFrame:
    """column, nulls: one aggregation over all columns, then unfolded."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in df.columns])).alias("x")).select("x.*")


def report(df: DataFrame, fields: list[Field], examples: int = 5) -> DataFrame:
    """column, check, failed, total, examples (the smallest distinct failing values, as text), in one pass over df.

    A row is counted by check and failing value before anything is shuffled; numbers are ordered as numbers, all else as text.
    """
    checks = [(f.name, c) for f in fields for c in f.constraints if f.name in df.columns]
    checks = [(n, c.kind, failing(df, n, c)) for n, c in checks] + [(f.name, "notNull", F.col(f"`{f.name}`").isNull()) for f in fields if not f.nullable and f.name in df.columns]
    if not checks:
        return df.sparkSession.createDataFrame([], "column string, check string, failed long, total long, examples array<string>")
    item = lambda k, number, text: F.struct(F.lit(k).alias("k"), number.cast("double").alias("number"), text.cast("string").alias("text"))
    items = [item(-1, F.lit(None), F.lit(None))]  # each row once, for the total
    for k, (n, _, bad) in enumerate(checks):
        col = F.col(f"`{n}`")
        items.append(F.when(bad, item(k, col if _number(df.schema[n].dataType) else F.lit(None), col)))
    values = df.select(F.explode(F.array_compact(F.array(*items))).alias("x")).groupBy("x.k", "x.number", "x.text").agg(F.count("*").alias("c"))
    sums = values.groupBy("k").agg(F.sum("c").alias("failed"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.col("number").asc_nulls_last(), F.col("text").asc_nulls_last()))
    least = values.withColumn("rank", rank).where(F.col("rank") <= examples).groupBy("k").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("rank", "text")))).alias("least"))
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("column"), F.lit(kind).alias("check")) for k, (n, kind, _) in enumerate(checks)])).alias("r")).select("r.*")
    total = sums.agg(F.coalesce(F.sum(F.when(F.col("k") == -1, F.col("failed"))), F.lit(0)).alias("total"))
    out = names.join(F.broadcast(sums), "k", "left").join(F.broadcast(least), "k", "left").crossJoin(F.broadcast(total)).orderBy("k")
    return out.select("column", "check", F.coalesce("failed", F.lit(0)).cast("long").alias("failed"), F.col("total").cast("long").alias("total"), F.coalesce(F.col("least.text"), F.array().cast("array<string>")).alias("examples"))


def failing_examples(df: DataFrame, name: str, c: Constraint, most: int = 5) -> DataFrame:
    """value: the smallest distinct failing values of one check, at most so many (a top-k: partial per task)."""
    return df.where(failing(df, name, c)).select(F.col(f"`{name}`").alias("value")).distinct().orderBy("value").limit(most)


def conform(df: DataFrame, fields: list[Field]) -> DataFrame:
    """df with each declared column in its declared type wherever that changes no value, found by one aggregation over all of them."""
    from ..sources.files import _ddl

    kinds = {f.name: _ddl(f.type) for f in fields if f.name in df.columns and f.type}
    kinds = {n: k for n, k in kinds.items() if df.schema[n].dataType.simpleString() != k}
    if not kinds:
        return df
    back = lambda n, k: F.col(f"`{n}`").try_cast(k).try_cast(df.schema[n].dataType)
    lost = df.agg(*[F.count_if(~F.col(f"`{n}`").eqNullSafe(back(n, k))).alias(n) for n, k in kinds.items()]).first()
    return df.withColumns({n: F.col(f"`{n}`").cast(k) for n, k in kinds.items() if not lost[n]})
