"""Mixing sources to target weights with DataFrame functions only.

Tokens are aggregated by source, targets and repetition rates derived, and each document emitted floor(rate) times plus one
Bernoulli copy whose hash-seeded draw falls below the fraction.

Rules for odd input: a null text has size 0; a null source is a source of its own, ordered last; a source without words gets
target 0 and rate 0; rows with equal ids (null ones too) draw alike, so a source's taken words are near its target only as far as no
id holds a large share of them; an empty table gives an empty result. Other columns are carried, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, table, written

#: Weights dealt to the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT, MAX_REPEATS = 150, 2
#: Sources up to which one task orders them all; columns that mix() adds.
ONE_TASK, ADDED = 100_000, ["mix_size", "mix_source_size", "mix_target", "mix_copies"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, percent: int = SHARE_PERCENT, most: int = MAX_REPEATS, one_task: int = ONE_TASK) -> DataFrame:
    """source, source_size, target, rate. One row per source.

    Every source gets its weight's share of what is left, but for those whose share would lie above their cap: these get their cap, and the
    rest is shared anew. Up to one_task sources are ordered and filled in one task; beyond, they never meet in one.
    """
    by = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    few = by.limit(one_task + 1).count() <= one_task
    out = _filled_at_once(_weighed(by, weights), percent, most) if few else _filled_in_rounds(_weighed_by_ranges(by, weights), percent, most)
    return out.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def _weight(place: Column, weights) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in weights]), (place % len(weights) + 1).cast("int")).cast("long")


def _weighed(by: DataFrame, weights) -> DataFrame:
    return by.withColumn("w", _weight(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, weights))


def _weighed_by_ranges(by: DataFrame, weights) -> DataFrame:
    """A source's place in the order: how many stand in earlier ranges, and its place in its own."""
    order = F.col("source").asc_nulls_last()
    parts = int(by.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(by.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("n", F.monotonically_increasing_id()), "mix-order")
    part, here = F.shiftright("n", 33), F.col("n").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("c"))
    before = counts.select(F.col("part").alias("p"), F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return dealt.join(F.broadcast(before), part == F.col("p")).select("source", "source_size", _weight(F.col("before") + here, weights).alias("w"))


def _filled_at_once(w: DataFrame, percent: int, most: int) -> DataFrame:
    """In order of cap by weight, sources are capped as long as the level that the rest would get lies above."""
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    c = w.withColumn("all_size", F.sum("source_size").over(every)).withColumn("w_here", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))).withColumn("s_before", F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # times 100, in whole numbers: what is left for this source and those after it
    c = c.withColumn("left", percent * F.col("all_size") - 100 * most * F.col("s_before"))
    c = c.withColumn("over", F.col("left") * F.col("w") > 100 * most * F.col("source_size") * F.col("w_here"))
    level = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = c.withColumn("l0", F.first(F.when(~F.col("over"), F.col("left")), ignorenulls=True).over(level)).withColumn("w0", F.first(F.when(~F.col("over"), F.col("w_here")), ignorenulls=True).over(level))
    target = F.when(F.col("over"), (most * F.col("source_size")).cast("double")).otherwise((F.col("l0") * F.col("w")).cast("double") / (100 * F.col("w0")).cast("double"))
    return c.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _filled_in_rounds(w: DataFrame, percent: int, most: int) -> DataFrame:
    """The same by rounds: cap what lies above its share and share again; a round is one aggregation, and few are needed.

    Once a source is capped the others' share only grows, so a capped one stays so. Whole numbers of 38 digits, exactly.
    """
    w = written(w, "mix-weighed")
    whole = lambda x: F.col(x).cast("decimal(38,0)") if isinstance(x, str) else F.lit(x).cast("decimal(38,0)")
    total = w.agg(F.sum(whole("source_size"))).first()[0] or 0
    share, weight = percent * int(total), int(w.agg(F.sum("w")).first()[0] or 0)
    while weight:
        over = whole("w") * whole(share) > whole(100 * most * weight) * whole("source_size")
        capped, free = w.agg(F.sum(F.when(over, whole("source_size"))), F.sum(F.when(~over, F.col("w")))).first()
        left = percent * int(total) - 100 * most * int(capped or 0)
        if (left, int(free or 0)) == (share, weight):
            break
        share, weight = left, int(free or 0)
    if not weight:
        return w.select("source", "source_size", (most * F.col("source_size")).cast("double").alias("target"))
    over = whole("w") * whole(share) > whole(100 * most * weight) * whole("source_size")
    target = F.when(over, (most * F.col("source_size")).cast("double")).otherwise((whole(share) * whole("w")).cast("double") / F.lit(float(100 * weight)))
    return w.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by id and seed."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed))), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def mix(docs: DataFrame, seed: str = ":mix", weights=WEIGHTS, percent: int = SHARE_PERCENT, most: int = MAX_REPEATS, one_task: int = ONE_TASK) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies added (columns of the caller that are called so give way).

    One scan sums sizes by source (partial sums before the shuffle). The rates, one row a source, are broadcast when counted small;
    else the join shuffles and a hot source can be split by adaptive execution.
    """
    mark = uuid.uuid4().hex
    carried = [c for c in docs.columns if c not in ADDED]
    size, rate, source = (f"{x}_{mark}" for x in ("size", "rate", "source"))
    kept = docs.select(*[F.col(f"`{c}`") for c in carried])
    rates = written(targets(kept.select("source", word_count(F.col("text")).alias("size")), weights, percent, most, one_task), "mix-rates")
    rates = small(rates).select(F.col("source").alias(source), F.col("source_size").alias(f"s_{mark}"), F.col("target").alias(f"t_{mark}"), F.col("rate").alias(rate))
    joined = kept.withColumn(size, word_count(F.col("text"))).join(rates, kept["source"].eqNullSafe(rates[source]))
    whole = F.floor(rate)
    copies = (whole + (draw(kept["doc_id"], seed) < F.col(rate) - whole).cast("long")).cast("long")
    added = [F.col(size), F.col(f"s_{mark}"), F.col(f"t_{mark}"), copies]
    return joined.select(*[F.col(f"`{c}`") for c in carried], *[x.alias(n) for x, n in zip(added, ADDED, strict=True)])


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of docs, each row as often as the mix takes it. Clashing columns come through as they were."""
    mark = uuid.uuid4().hex
    inner = {c: f"{c}_{mark}" for c in docs.columns if c in ADDED}
    out = mix(docs.withColumnsRenamed(inner), **options).where("mix_copies > 0")
    out = out.withColumn(f"copy_{mark}", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return out.select(*[F.col(f"`{inner.get(c, c)}`").alias(c) for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s
), c AS (
  SELECT *, sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS w_here,
    150 * (sum(source_size) OVER ())::BIGINT - 200 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest
  FROM w
), o AS (SELECT *, rest * w > 200 * source_size * w_here AS over_cap FROM c),
f AS (SELECT rest AS l0, w_here AS w0 FROM o WHERE NOT over_cap ORDER BY source_size / w, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, coalesce(CASE WHEN over_cap THEN (2 * source_size)::DOUBLE ELSE (l0 * w)::DOUBLE / (100 * w0)::DOUBLE END, 0) AS target
  FROM o LEFT JOIN f ON true
), r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target,
  (d.size * (floor(r.rate)::BIGINT + CASE WHEN ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT / 4503599627370496.0 < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
ORACLES = {"op10_mixing": ORACLE_SQL}
