"""What several operators share: work tables in the shared folder, row keys, bounded joins, components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a table up to which a join may broadcast it; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 32 << 20
#: Bytes of texts handed to Python at once, and nodes that one union-find holds (twice the edges that may meet in one).
BATCH_BYTES, NODES = 4 << 20, 2 * BROADCAST_ROWS


class NoSharedFolder(RuntimeError):
    """Intermediate tables need a folder that the driver and all executors share."""


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only where all runs in one process (master local, as in tests) may it be unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.partition("[")[0] != "local":
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or "file:///tmp/contractlens-work").rstrip("/")


@contextmanager
def batches(spark: SparkSession, size: int = BATCH_BYTES):
    """Within it, what runs hands Python so many bytes at a time at most (one row at least); the session's own setting comes back after."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, f"{size}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(cycles: bool = True) -> None:
    """Give freed memory back to the system: a worker lives on after its task, and its memory counts beside the next one's.

    cycles: look for what only refers to itself as well, which takes longer.
    """
    import ctypes
    import gc

    import pyarrow as pa

    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What the functions of a module keep from task to task in a worker, by module: it goes when a task of another module begins.
KEPT: dict[str, dict] = {}


def forget_others(module: str) -> None:
    for other in [m for m in KEPT if m != module]:
        del KEPT[other]


def tidied(f, **given):
    """f over the batches of a task, with what others kept gone and its memory released when the task ends."""

    def run(batches):
        forget_others(f.__module__)
        try:
            yield from f(batches, **given)
        finally:
            release()

    return run


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back. Python gets BATCH_BYTES at a time at most.

    The table is deleted by drop(), or else when the driver ends, as a result may be read until then.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with batches(spark):
        df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete work tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.work_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast only if it has at most so many rows, and so many bytes in strings, arrays and fixed columns."""
    if df.limit(rows + 1).count() > rows:
        return df
    kinds = dict(df.dtypes)
    wide = [c for c, k in kinds.items() if k in ("string", "binary")], [c for c, k in kinds.items() if k.startswith("array")]
    if any(wide):
        each = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c in wide[0]] + [F.coalesce(F.octet_length(F.to_json(f"`{c}`")), F.lit(0)) for c in wide[1]]
        if (df.agg(F.sum(sum(each, F.lit(8 * len(kinds))).cast("long"))).first()[0] or 0) > size:
            return df
    return F.broadcast(df)


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two longs that name a row by id and text; repeated rows share them, nulls included."""
    return [F.xxhash64(doc_id, F.lit(1)).alias("k1"), F.xxhash64(text, doc_id).alias("k2")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _forest(batches):
    """Union-find within a partition: edges in, star edges (node, root) out; at NODES nodes it hands on what it has and starts anew."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def stars():
        nodes = [x for x in parent if find(x) != x]
        for i in range(0, len(nodes), 50_000):
            part = nodes[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["u", "v"])
        parent.clear()

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
        if len(parent) > NODES:
            yield from stars()
    yield from stars()


def components(edges: DataFrame, name: str, one_task: int = BROADCAST_ROWS) -> DataFrame:
    """Connected components of edges (u long, v long): rows (node, comp) with comp the smallest node.

    Union-find inside each partition first. Up to one_task edges after that are joined by one union-find; beyond, they never meet in one
    place: large-star and small-star rounds alternate over written tables until nothing changes. The per-node minimum is a partial aggregation and the join on a hot node can be split, so no group meets in one task.
    """
    cur = written(edges.where("u <> v").mapInArrow(tidied(_forest), "u long, v long").distinct(), name)
    total = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    state = total(cur)
    if 0 < state[0] <= one_task:
        new = written(cur.coalesce(1).mapInArrow(tidied(_forest), "u long, v long"), name)
        drop(cur)
        cur, state = new, (0,)
    while state[0]:
        sym = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        star = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(star.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        got = total(new)
        drop(cur)
        cur = new
        if got == state:
            break
        state = got
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.unionByName(nodes.select(F.col("comp").alias("node"), "comp")).distinct()
