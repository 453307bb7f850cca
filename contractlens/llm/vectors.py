"""Embedding near-duplicates by a robust-pruned flat graph.

Centroids are fitted on a bounded sample; every vector goes to its OVERLAP nearest cells. The number of cells grows with the vectors: up to
CELLS a cell is a centroid; beyond, it is a pair of one near the vector and one near what is left of it, from two lists of CELLS at most. Each cell (in pieces of at most PIECE vectors)
gets a pruned neighbour graph; adjacency lists that a vector got in different cells are united; then every vector searches its cells'
graphs greedily from their medoids and expands through all nodes in range. Links are confirmed by cosine in double precision, and recall
is audited against brute force on a bounded set of queries.

Equal vectors are one node, so copies are counted, never paired. A cell above PIECE is split into pieces and its vectors search all of them
in blocks. Results are counts and, for each vector, links to a spanning forest of its cell; only pairs that share several cells are named
(two longs each), so that the union of what these cells find is counted.

Rules for odd input: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different lengths
never link; rows with equal ids are vectors of their own, with a row each; a null id links with nothing (component null, kept true); an
empty table gives an empty result; labels and other columns are ignored.
"""

from __future__ import annotations

import logging
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, components, drop, small, table, tidied, written

#: Rows that centroids are fitted on, vectors aimed at in a cell, most in a piece, most centroids in one of the two lists.
SAMPLE, CELL, PIECE, CELLS = 8_000, 1_000, 2_000, 1_024
OVERLAP, DEGREE, ALPHA, BEAM, SLACK, THRESHOLD = 2, 24, 1.2, 16, 0.1, 0.95
#: The least recall that an audit accepts, and the (overlap, beam) tried in turn.
RECALL, WIDTHS = 0.9, ((OVERLAP, BEAM), (2 * OVERLAP, 4 * BEAM), (4 * OVERLAP, 16 * BEAM))

log = logging.getLogger(__name__)


def unit(x):
    """Rows scaled to length 1 in double precision."""
    import numpy as np

    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(x, k: int, rounds: int = 8):
    """Spherical k-means from a fixed seed."""
    import numpy as np

    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def pruned_graph(x, degree: int = DEGREE, alpha: float = ALPHA, pool: int = 3 * DEGREE):
    """Out-neighbours (-1 where fewer) of each row: robust pruning of its nearest rows, then reverse edges where there is room."""
    import numpy as np

    n = len(x)
    if n < 2:
        return np.full((n, degree), -1)
    sims = x @ x.T
    np.fill_diagonal(sims, -9)
    pool = min(pool, n - 1)
    cand = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
    cand = np.take_along_axis(cand, np.argsort(-np.take_along_axis(sims, cand, 1), axis=1, kind="stable"), 1)
    dist = np.maximum(0, 2 - 2 * np.take_along_axis(sims, cand, 1))
    alive = np.ones(cand.shape, bool)
    out = np.full((n, degree), -1)
    rows = np.arange(n)
    for slot in range(degree // 2):
        first = alive.argmax(1)
        some = alive[rows, first]
        pick = np.where(some, cand[rows, first], -1)
        out[:, slot] = pick
        if not some.any():
            break
        between = np.maximum(0, 2 - 2 * sims[pick[:, None], cand])
        alive &= ~(some[:, None] & (alpha * alpha * between <= dist))
        alive[rows, first] = False
    src, dst = np.nonzero(out >= 0)[0], out[out >= 0]
    used = (out >= 0).sum(1)
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    rank = np.arange(len(dst)) - np.searchsorted(dst, dst, side="left")
    fits = used[dst] + rank < degree
    out[dst[fits], (used[dst] + rank)[fits]] = src[fits]
    return out


def _fresh(seen, graph, r, node):
    """(query, neighbour) pairs of the given nodes that their queries have not seen, now marked as seen."""
    import numpy as np

    near = graph[node]
    r, m = np.repeat(r, near.shape[1]), near.ravel()
    ok = m >= 0
    r, m = r[ok], m[ok]
    new = ~seen[r, m]
    # two nodes of a query may share a neighbour, and a node may name one twice
    code = np.unique(r[new] * seen.shape[1] + m[new])
    r, m = code // seen.shape[1], code % seen.shape[1]
    seen[r, m] = True
    return r, m


def search(x, graph, medoids, queries, threshold: float = THRESHOLD, beam: int = BEAM, slack: float = SLACK):
    """(query row, node) pairs with cosine >= threshold that greedy search and range expansion reach, both int arrays.

    Greedy: each query keeps the beam nearest nodes it has seen, opens the nearest unopened one of them and looks at its neighbours, until
    all of its beam are open. Range expansion: from all it has seen within the threshold's reach, through neighbours within reach.
    """
    import numpy as np

    n, q = len(x), len(queries)
    beam = min(beam, n)
    seen = np.zeros((q, n), bool)
    seen[:, medoids] = True
    first = queries @ x[medoids].T
    # the beam of each query: node, similarity (-9 where there is none yet), opened
    node = np.full((q, beam), -1)
    sim = np.full((q, beam), -9.0, np.float32)
    done = np.zeros((q, beam), bool)
    order = np.argsort(-first, axis=1, kind="stable")[:, :beam]
    k = order.shape[1]
    node[:, :k] = np.asarray(medoids)[order]
    sim[:, :k] = np.take_along_axis(first, order, 1)
    r, c = np.nonzero(first >= threshold - slack)
    reach = [(r, np.asarray(medoids)[c], first[r, c])]
    active = np.arange(q)
    while len(active):
        open_ = np.where(done[active], -9.0, sim[active])
        at = open_.argmax(1)
        go = open_[np.arange(len(active)), at] > -5
        active, at = active[go], at[go]
        if not len(active):
            break
        done[active, at] = True
        r, m = _fresh(seen, graph, active, node[active, at])
        if not len(r):
            continue
        s = np.einsum("ij,ij->i", queries[r], x[m])
        near = s >= threshold - slack
        reach.append((r[near], m[near], s[near]))
        # merge each query's new neighbours into its beam, those better than its worst
        better = s > sim[r].min(1)
        r, m, s = r[better], m[better], s[better]
        rows, start, count = np.unique(r, return_index=True, return_counts=True)
        if not len(rows):
            continue
        wide = count.max()
        place = np.arange(len(r)) - np.repeat(start, count)
        line = np.repeat(np.arange(len(rows)), count)
        more_s, more_m = np.full((len(rows), wide), -9.0, np.float32), np.full((len(rows), wide), -1)
        more_s[line, place], more_m[line, place] = s, m
        all_s = np.concatenate([sim[rows], more_s], 1)
        best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sim[rows] = np.take_along_axis(all_s, best, 1)
        node[rows] = np.take_along_axis(np.concatenate([node[rows], more_m], 1), best, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros((len(rows), wide), bool)], 1), best, 1)
    # range expansion
    todo = reach
    found = list(reach)
    while todo:
        r, m = np.concatenate([t[0] for t in todo]), np.concatenate([t[1] for t in todo])
        todo = []
        for i in range(0, len(r), 40_000):
            a, b = _fresh(seen, graph, r[i : i + 40_000], m[i : i + 40_000])
            s = np.einsum("ij,ij->i", queries[a], x[b])
            near = s >= threshold - slack
            if near.any():
                todo.append((a[near], b[near], s[near]))
        found += todo
    r, m, s = (np.concatenate([t[i] for t in found]) for i in range(3))
    good = s >= threshold - 1e-5
    return r[good], m[good]


def _usable(column):
    """For each length of vectors in a list column: rows, and their vectors scaled by their largest part, as doubles."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.values.cast("double").to_numpy(zero_copy_only=False)  # null parts become nan
    start = column.offsets.to_numpy()[:-1]
    for dim in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == dim)
        a = flat[start[rows][:, None] + np.arange(dim)] + 0.0
        ok = np.isfinite(a).all(1) & a.any(1)
        a = a[ok]
        yield rows[ok], a / np.abs(a).max(1, keepdims=True)


def _nodes(batches):
    """Every row's id and its vector as the bytes of its doubles; null where a vector (or its id) links with nothing."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        column = b.column(1)
        if not b.num_rows:
            continue
        rows, raw = [np.zeros(0, np.int64)], []
        for at, a in _usable(column):
            rows.append(at)
            raw += np.frombuffer(a.tobytes(), f"V{8 * a.shape[1]}").tolist() if len(at) else []
        named = np.concatenate(rows)
        out = np.full(b.num_rows, None, object)
        out[named] = np.array([*raw, None], object)[:-1]
        ids = b.column(0)
        lost = ids.is_null().to_numpy(zero_copy_only=False)
        out[lost] = None
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(out, pa.binary())], ["vec_id", "v"])


def fit(x, cells: int, most: int):
    """Centroids for so many cells: one list up to most; beyond, a list for the vectors and one for what they differ from theirs by."""
    import numpy as np

    if cells <= most:
        return centroids(x, cells), None
    outer = centroids(x, min(most, int(np.ceil(np.sqrt(cells)))))
    left = x - outer[np.argmax(x @ outer.T, axis=1)]
    long = np.linalg.norm(left, axis=1) > 1e-9
    inner = centroids(unit(left[long]), min(most, -(-cells // len(outer)))) if long.any() else np.eye(1, x.shape[1])
    return outer, inner


def nearest_cells(x, lists, overlap: int):
    """For each row the numbers of its overlap nearest cells, nearest first."""
    import numpy as np

    outer, inner = lists
    near = np.argsort(-(x @ outer.T), axis=1, kind="stable")[:, :overlap]
    if inner is None:
        return near
    every, score = [], []
    for j in range(near.shape[1]):
        left = x - outer[near[:, j]]
        size = np.linalg.norm(left, axis=1, keepdims=True)
        dots = (left / np.maximum(size, 1e-12)) @ inner.T
        best = np.argsort(-dots, axis=1, kind="stable")[:, :overlap]
        every.append(near[:, [j]] * len(inner) + best)
        # a cell is as near as the vector is to its outer centroid plus the part of the rest that points its way
        score.append(-size * np.sqrt(np.maximum(0, 1 - np.take_along_axis(dots, best, 1).clip(0, 1) ** 2)))
    every, score = np.concatenate(every, 1), np.concatenate(score, 1)
    return np.take_along_axis(every, np.argsort(-score, axis=1, kind="stable")[:, :overlap], 1)


def _cells(batches, centers, overlap):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        size = b.column(1)
        length = pc.binary_length(size).to_numpy(zero_copy_only=False)
        out_i, out_c, out_s = [], [], []
        for dim, lists in centers.items():
            at = np.flatnonzero(length == 8 * dim)
            if len(at):
                x = _vectors(size.take(pa.array(at)))
                near = nearest_cells(x, lists, overlap) + (dim << 24)
                out_i.append(np.repeat(at, near.shape[1]))
                out_c.append(near.ravel())
                out_s += np.repeat(np.sort(near, axis=1), near.shape[1], axis=0).tolist()
        picked = b.take(pa.array(np.concatenate(out_i) if out_i else np.zeros(0, np.int64)))
        cells = np.concatenate(out_c) if out_c else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *picked.columns, pa.array(out_s, pa.list_(pa.int64()))], ["cell", "node", "v", "weight", "cells"])


def _vectors(column):
    import numpy as np

    rows = column.to_pylist()
    return unit(np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1))


def _other_cells(side):
    """The cells of each row besides the one that the side is grouped by, -1 where there are fewer."""
    import numpy as np

    here = side.column("cell").to_numpy()
    lists = [[c for c in cs if c != cell] for cs, cell in zip(side.column("cells").to_pylist(), here.tolist(), strict=True)]
    out = np.full((len(lists), max(1, max(map(len, lists)))), -1)
    for i, cs in enumerate(lists):
        out[i, : len(cs)] = cs
    return out


def _build(group):
    """One piece of a cell: its graph as (node, neighbour ids)."""
    import pyarrow as pa

    ids = group.column("node").to_numpy()
    graph = pruned_graph(_vectors(group.column("v")))
    lists = [ids[g[g >= 0]].tolist() for g in graph]
    return pa.table({"node": pa.array(ids, pa.int64()), "adj": pa.array(lists, pa.list_(pa.int64()))})


def _merge(root, a, b):
    """Roots (smallest of a group) after linking a[i] with b[i]."""
    import numpy as np

    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        new = np.minimum(new, new[root])
        if (new == root).all():
            return root
        root = new


def _search(left, right, threshold, beam=BEAM):
    """One block of queries (left) against one piece of its cell (right), with the united adjacency lists of the piece's nodes."""
    import numpy as np
    import pyarrow as pa

    kind = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("others", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64()))])
    if not left.num_rows or not right.num_rows:
        return kind.empty_table()
    right = right.take(pa.array(np.argsort(right.column("node").to_numpy(), kind="stable")))
    ids, x = right.column("node").to_numpy(), _vectors(right.column("v"))
    weight = right.column("weight").to_numpy()
    lists = right.column("adj").to_pylist()
    place = {v: i for i, v in enumerate(ids.tolist())}
    local = [[place[v] for v in (a or []) if v in place] for a in lists]
    graph = np.full((len(ids), max(1, max(map(len, local)))), -1)
    for i, a in enumerate(local):
        graph[i, : len(a)] = a
    mean = x.mean(0)
    medoids = [int(np.argmax(x @ mean)), *range(0, len(ids), max(1, len(ids) // 4))]
    qid, q = left.column("node").to_numpy(), _vectors(left.column("v"))
    # a pair that shares this cell alone is counted here; what shares more is named, and counted once whichever cells find it
    cell_q, cell_x = (_other_cells(side) for side in (left, right))
    named_q, named_x = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    links = np.zeros(len(q), np.int64)
    every = np.concatenate([qid, ids])
    nodes = np.unique(every)
    root = np.arange(len(nodes))
    at_q, at_x = np.searchsorted(nodes, qid), np.searchsorted(nodes, ids)
    for i in range(0, len(q), 500):
        r, m = search(x.astype(np.float32), graph, sorted(set(medoids)), q[i : i + 500].astype(np.float32), threshold, beam)
        for j in range(0, len(r), 100_000):
            a, b = r[j : j + 100_000] + i, m[j : j + 100_000]
            good = (np.einsum("ij,ij->i", q[a], x[b]) >= threshold) & (qid[a] != ids[b])
            a, b = a[good], b[good]
            more = np.zeros(len(a), bool)
            for k in range(cell_q.shape[1]):
                for c in range(cell_x.shape[1]):
                    more |= (cell_q[a, k] == cell_x[b, c]) & (cell_q[a, k] >= 0)
            links += np.bincount(a[~more], weight[b[~more]], len(q)).astype(np.int64)
            named_q.append(a[more])
            named_x.append(b[more])
            root = _merge(root, at_q[a], at_x[b])
    n = np.zeros(len(nodes), np.int64)
    n[at_q] = links
    by, to = at_q[np.concatenate(named_q)], np.concatenate(named_x)
    order = np.argsort(by, kind="stable")
    count = np.bincount(by, minlength=len(nodes))
    some = (n > 0) | (root != np.arange(len(nodes))) | (count > 0)
    ends = pa.array(np.concatenate([[0], np.cumsum(count[some])]), pa.int32())
    named = [pa.ListArray.from_arrays(ends, pa.array(col[to[order]], pa.int64())) for col in (ids, weight)]
    return pa.table([pa.array(nodes[some], pa.int64()), pa.array(nodes[root[some]], pa.int64()), pa.array(n[some], pa.int64()), *named], schema=kind)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, piece: int = PIECE, overlap: int = OVERLAP, beam: int = BEAM, cells: int = CELLS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    import numpy as np

    spark = vectors.sparkSession
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = written(src.mapInArrow(tidied(_nodes), "vec_id long, v binary"), "vec-rows")
    # equal directions are one node, named by a number of its own: equal ids need not be equal vectors
    nodes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "v", "weight", "least"), "vec-nodes")
    total = nodes.count()
    wanted = max(1, total // cell)
    share = min(1.0, 2 * SAMPLE / max(1, total))
    drawn = F.xxhash64("v", F.lit(3))
    sample = nodes.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select(drawn.alias("o"), "v").orderBy("o", "v").limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r.v) // 8, []).append(np.frombuffer(bytes(r.v), np.float64))
    centers = {d: fit(unit(np.stack(v)), wanted, cells) for d, v in by_dim.items()}
    for (d,) in nodes.select((F.octet_length("v") / 8).cast("int")).distinct().collect():
        centers.setdefault(d, (np.eye(1, d), None))
    placed = written(nodes.select("node", "v", "weight").mapInArrow(tidied(_cells, centers=centers, overlap=overlap), "cell long, node long, v binary, weight long, cells array<long>"), "vec-cells")
    sizes = written(placed.groupBy("cell").agg(F.count("*").alias("c")), "vec-sizes")
    count = F.ceil(F.col("c") / piece)
    placed = placed.join(small(sizes), "cell").select("cell", F.pmod(F.xxhash64("node", "cell"), count).alias("piece"), count.alias("pieces"), "node", "v", "weight", "cells")
    graphs = placed.select("cell", "piece", "node", "v").groupBy("cell", "piece").applyInArrow(_build, "node long, adj array<long>")
    united = graphs.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("adj"))).alias("adj"))  # at most overlap lists a node
    ready = written(placed.join(united, "node"), "vec-graph")
    # a block is one piece's queries; it searches every piece of its cell
    queries = ready.select("cell", F.col("piece").alias("block"), "node", "v", "cells", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    bases = ready.select("cell", "piece", "node", "v", "weight", "adj", "cells", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("block"))
    pairs = queries.groupBy("cell", "block", "piece").cogroup(bases.groupBy("cell", "block", "piece")).applyInArrow(partial(_search, threshold=threshold, beam=beam), "node long, root long, n long, others array<long>, weights array<long>")
    found = written(pairs, "vec-found")
    # a named pair may come from each cell that its vectors share, and counts once
    named = found.select("node", F.explode(F.arrays_zip("others", "weights")).alias("x")).select("node", F.col("x.others").alias("other"), F.col("x.weights").alias("n"))
    once = named.groupBy("node", "other").agg(F.max("n").alias("n"))
    sums = found.select("node", "n").unionByName(once.select("node", "n")).groupBy("node").agg(F.sum("n").alias("n"))
    comp = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), "vec-cc", BROADCAST_ROWS)
    named = nodes.select("node", "v", "weight", "least").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("least").alias("c"))
    per = named.join(least, "comp").join(sums, "node", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), "c")
    lone = rows.where("v is null").select("vec_id", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("c"))  # kept out of the join, where they would meet
    out = rows.where("v is not null").join(per, "v").select("vec_id", "n", "c").unionByName(lone)
    cid = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), F.coalesce(cid == F.col("vec_id"), F.lit(True)).alias("kept"))


def audit(vectors: DataFrame, result: DataFrame, threshold: float = THRESHOLD, queries: int = 200) -> float:
    """Share of the true links of at most so many hash-chosen vectors that the result counts, by brute force in blocks."""
    import numpy as np

    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(tidied(_nodes), "vec_id long, v binary").where("v is not null")
    picked = good.orderBy(F.xxhash64("vec_id")).limit(queries).collect()
    dims = {len(r.v) for r in picked}
    if not picked:
        return 1.0
    qs = {d: ([r.vec_id for r in picked if len(r.v) == d], unit(np.stack([np.frombuffer(bytes(r.v)) for r in picked if len(r.v) == d]))) for d in dims}

    def count(batches):
        import pyarrow as pa

        for b in batches:
            for d, (ids, q) in qs.items():
                at = [i for i, x in enumerate(b.column(1).to_pylist()) if len(x) == d]
                if at:
                    x = _vectors(b.column(1).take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array((q @ x.T >= threshold).sum(1), pa.int64())], ["vec_id", "t"])

    true = good.mapInArrow(count, "vec_id long, t long").groupBy("vec_id").agg((F.sum("t") - 1).alias("t"))
    # an id that several rows have cannot be told apart in the result
    once = result.groupBy("vec_id").agg(F.first("n_links").alias("n_links"), F.count("*").alias("c")).where("c = 1")
    row = true.join(once, "vec_id").agg(F.sum("t").alias("t"), F.sum(F.least("t", "n_links")).alias("n")).first()
    return 1.0 if not row.t else row.n / row.t


def audited(vectors: DataFrame, threshold: float = THRESHOLD, least: float = RECALL) -> DataFrame:
    """near_vectors with its recall measured by audit(), logged and kept as .recall: overlap and beam are widened while it is under least."""
    for overlap, beam in WIDTHS:
        out = written(near_vectors(vectors, threshold, overlap=overlap, beam=beam), "vec-out")
        out.recall = audit(vectors, out, threshold)
        log.info("recall %.4f of audited links with overlap %d, beam %d", out.recall, overlap, beam)
        if out.recall >= least:
            return out
        log.warning("recall %.4f is under %.2f with overlap %d, beam %d", out.recall, least, overlap, beam)
        drop(out)
    raise RuntimeError(f"recall of near vectors stays under {least} with overlap {overlap}, beam {beam}")


def op1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
