"""Sharding by extendible hashing, with DataFrame functions only.

The directory is indexed by leading bits of a document's hash; only buckets over the byte limit split on another bit. Sizes are summed once
by the finest prefix; everything else is worked out from these sums. A bucket's sum at every depth comes from one aggregation over
(depth, prefix): down to a middle depth from the sums there, and beyond it for cells that are still over the limit alone. A bucket is a
shard where its sum fits and its parent's does not.

A document is looked up in a directory with one slot for each prefix of the middle depth; a slot whose bucket went on splitting points to
a second directory of the finest prefixes in it.

Rules for odd input: a null text has 0 bytes; a null id hashes like an empty string; documents that no bit can part (more than a
limit's bytes under one finest prefix: repeated ids or null ones) are split in the same way on a salt of their rows, into numbered pieces
that fit; a single document above the limit is a shard of its own size; repeated rows may lie in different pieces; an empty table gives an
empty result; columns of the caller that are called like the four added ones give way to them, all others are carried whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, written

#: Bytes a shard may hold, and the most bits that a directory may use.
LIMIT, MAX_BITS = 16 << 20, 30
ADDED = ["shard_bits", "shard_prefix", "shard_bytes", "shard_piece"]


def _hash(col):
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _above(cell: str, bits: str) -> F.Column:
    """The leading part of a cell number without so many bits."""
    return F.expr(f"shiftright({cell}, cast({bits} as int))")


class Directory:
    """Shards of cells (g, h, b): bytes b under the max_bits-bit prefix h, in groups g that are split apart from each other."""

    def __init__(self, cells: DataFrame, limit: int, max_bits: int = MAX_BITS):
        self.max_bits, self.limit = max_bits, limit
        most = cells.groupBy("g").agg(F.sum("b").alias("b")).agg(F.max("b")).first()[0] or 0
        # about eight cells a shard: beyond this depth only uneven buckets go on
        self.middle = min(max_bits, max(1, (8 * most // limit + 1).bit_length()))
        slot = _above("h", str(max_bits - self.middle)).alias("p")
        at = written(cells.groupBy("g", slot).agg(F.sum("b").alias("b")), "shard-middle")
        full = small(written(at.where(F.col("b") > limit).select(F.col("g").alias("fg"), F.col("p").alias("fp")), "shard-full"))
        deep = cells.join(full, (F.col("g") == F.col("fg")) & (_above("h", str(max_bits - self.middle)) == F.col("fp"))).select("g", "h", "b")
        upper = at.select("g", F.explode(F.sequence(F.lit(0), F.lit(self.middle))).alias("d"), "p", "b").select("g", "d", _above("p", f"{self.middle} - d").alias("prefix"), "b")
        self.deep = None
        if self.middle < max_bits:
            self.deep = deep.withColumn("d", F.explode(F.sequence(F.lit(self.middle + 1), F.lit(max_bits)))).select("g", "h", "d", _above("h", f"{max_bits} - d").alias("prefix"), "b")
            upper = upper.unionByName(self.deep.select("g", "d", "prefix", "b"))
        sums = written(upper.groupBy("g", "d", "prefix").agg(F.sum("b").alias("b")), "shard-sums")
        over = small(written(sums.where(F.col("b") > limit).select(F.col("g").alias("og"), (F.col("d") + 1).alias("od"), F.col("prefix").alias("up")), "shard-over"))
        parted = sums.where(F.col("b") <= limit).join(over, (F.col("g") == F.col("og")) & (F.col("d") == F.col("od")) & (_above("prefix", "1") == F.col("up")), "left_semi")
        whole = sums.where(((F.col("d") == 0) & (F.col("b") <= limit)) | ((F.col("d") == max_bits) & (F.col("b") > limit)))
        self.shards = written(parted.unionByName(whole), "shard-directory")

    def look_up(self, docs: DataFrame, g, h, names: dict[str, str]) -> DataFrame:
        """docs with bits, prefix and bytes (under the names given) of the shard that each row's group and cell lie in."""
        spread = F.sequence(F.expr(f"shiftleft(prefix, {self.middle} - d)"), F.expr(f"shiftleft(prefix + 1, {self.middle} - d) - 1"))
        as_ = lambda d: d.select("g", "k", F.col("d").alias("s_d"), F.col("prefix").alias("s_p"), F.col("b").alias("s_b"))
        slots = as_(self.shards.where(F.col("d") <= self.middle).withColumn("k", F.explode(spread)))
        below = self.shards.where(F.col("d") > self.middle)
        parts = [(written(slots, "shard-slots"), _shift(h, self.max_bits - self.middle))]
        if self.deep is not None and below.limit(1).count():
            cells = self.deep.drop("b").distinct().join(below, ["g", "d", "prefix"]).withColumnRenamed("h", "k")
            parts.append((written(as_(cells), "shard-cells"), h))
        out, found = docs, []
        for i, (slots, key) in enumerate(parts):
            mine = {c: f"{c}_{i}_{uuid.uuid4().hex}" for c in ("g", "k", "s_d", "s_p", "s_b")}
            side = small(slots).select(*[F.col(c).alias(n) for c, n in mine.items()])
            out = out.join(side, (g == F.col(mine["g"])) & (key == F.col(mine["k"])), "left")
            found.append(mine)
        for what, name in (("s_d", names["bits"]), ("s_p", names["prefix"]), ("s_b", names["bytes"])):
            out = out.withColumn(name, F.coalesce(*[F.col(m[what]) for m in found]))
        return out.drop(*[n for m in found for n in m.values()])


def _shift(column, bits: int):
    return F.shiftright(column, bits)


def shard(docs: DataFrame, limit: int = LIMIT, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with shard_bits, shard_prefix, shard_piece and shard_bytes (of the piece) added.

    The directories are broadcast when counted small; else rows move once, to where their slot is. shard_piece is 0 but for buckets that no
    bit can part: there it numbers the pieces.
    """
    mark = uuid.uuid4().hex
    own = {c: f"{c}_{mark}" for c in ("h", "b", "salt", "bits", "prefix", "bytes", "piece")}
    carried = [c for c in docs.columns if c not in ADDED]
    cell = F.shiftright(_hash(F.col("doc_id")), 60 - max_bits)
    sized = docs.select(*[F.col(f"`{c}`") for c in carried], cell.alias(own["h"]), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias(own["b"]))
    cells = written(sized.groupBy(F.lit(0).cast("long").alias("g"), F.col(own["h"]).alias("h")).agg(F.sum(own["b"]).alias("b")), "shard-cells-by-hash")
    top = Directory(cells, limit, max_bits)
    placed = top.look_up(sized, F.lit(0).cast("long"), F.col(own["h"]), own)
    result = lambda d, piece: d.select(*[F.col(f"`{c}`") for c in carried], F.col(own["bits"]).cast("int").alias("shard_bits"), F.col(own["prefix"]).alias("shard_prefix"), F.col(own["bytes"]).alias("shard_bytes"), piece.cast("long").alias("shard_piece"))
    if not top.shards.where(F.col("b") > limit).limit(1).count():
        return result(placed, F.lit(0))
    # buckets that the hash cannot part: their rows are written with a salt, so that sums and places see the same one
    stuck = F.col(own["bytes"]) > limit
    rows = written(placed.where(stuck).withColumn(own["salt"], _shift(F.xxhash64(F.monotonically_increasing_id(), F.lit(17)), 64 - max_bits).bitwiseAND(F.lit((1 << max_bits) - 1))), "shard-stuck")
    salted = written(rows.groupBy(F.col(own["h"]).alias("g"), F.col(own["salt"]).alias("h")).agg(F.sum(own["b"]).alias("b")), "shard-cells-by-salt")
    pieces = Directory(salted, limit, max_bits)
    inner = {k: f"{k}_piece_{mark}" for k in ("bits", "prefix", "bytes")}
    parted = pieces.look_up(rows, F.col(own["h"]), F.col(own["salt"]), inner)
    number = F.expr(f"shiftleft(1L, cast(`{inner['bits']}` as int))") + F.col(inner["prefix"])
    parted = parted.withColumn(own["bytes"], F.col(inner["bytes"]))
    return result(placed.where(~stuck), F.lit(0)).unionByName(result(parted, number))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, shard_bits, shard_prefix, shard_bytes, shard_piece: the shard of every document at 16 MiB."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select("doc_id", *ADDED)


def sharding_small_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at 256 KiB, so that buckets split on small tables too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs, SMALL_LIMIT).select("doc_id", *ADDED)


def oracle(limit: int = LIMIT, depth: int = 16) -> str:
    sums = ", ".join(f"sum(b) OVER (PARTITION BY h >> {60 - d}) AS s{d}" for d in range(depth + 1))
    pick = lambda what: " ".join(f"WHEN s{d} <= {limit} THEN {what(d)}" for d in range(depth + 1))
    return f"""
WITH d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS b FROM documents),
s AS (SELECT *, {sums} FROM d)
SELECT doc_id, (CASE {pick(lambda d: d)} END)::INT AS shard_bits, (h >> (60 - CASE {pick(lambda d: d)} END))::BIGINT AS shard_prefix,
  (CASE {pick(lambda d: f"s{d}")} END)::BIGINT AS shard_bytes, 0::BIGINT AS shard_piece FROM s
"""


#: Bytes a shard may hold in sharding_small_limit; no document of the test tables is longer.
SMALL_LIMIT = 256 << 10
ORACLES = {"op4_sharding": oracle(), "sharding_small_limit": oracle(SMALL_LIMIT)}
