import numpy as np
import pytest

from contractlens.llm import vectors


def brute(rows, threshold=0.95):
    ids = [i for i, _ in rows]
    x = vectors.unit(np.array([v for _, v in rows], float))
    link = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    comp = np.array(ids)
    for _ in range(len(ids)):
        new = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(ids))])
        if (new == comp).all():
            break
        comp = new
    return {i: (int(link[k].sum()), int(comp[k])) for k, i in enumerate(ids)}


def test_recall_and_precision(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    x = np.vstack([base, base[:30] + rng.normal(size=(30, 16)) * 0.1, base[:1] + rng.normal(size=(80, 16)) * 0.12, base[5:6], base[5:6], rng.normal(size=(200, 16))]).astype(np.float32)
    rows = [(i * 7 % 1009, [float(a) for a in v]) for i, v in enumerate(x)]
    want = brute(rows)
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (5004, [1.0, 0.0]), (5005, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, label int").repartition(3)
    out = vectors.near_vectors(df, cell=60, piece=40)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    assert all(got[i] == (0, i) for i, _ in odd)
    assert all(got[i][0] <= n for i, (n, _) in want.items())
    assert sum(got[i][0] for i in want) >= 0.9 * sum(n for n, _ in want.values())
    assert np.mean([got[i][1] == c for i, (_, c) in want.items()]) >= 0.97
    assert vectors.audit(df, out) >= 0.9
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_rows_with_equal_ids_are_vectors_of_their_own(spark):
    rows = [(7, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [1.0, 0.01]), (9, [0.0, 1.0]), (10, [0.01, 1.0]), (None, [1.0, 0.0]), (3, None), (3, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], "vec_id int, embedding array<double>, node int, cell string, v string").repartition(3)
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect())
    assert got == [("10", 2, 7, False), ("3", 0, 3, True), ("3", 0, 3, True), ("7", 1, 7, True), ("7", 2, 7, True), ("8", 1, 7, False), ("9", 2, 7, False), ("None", 0, None, True)]


def test_ties_at_the_threshold(spark):
    at = np.sqrt(1 - 0.95**2)
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.95, at, 0.0]), (3, [0.95 - 1e-9, np.sqrt(1 - (0.95 - 1e-9) ** 2), 0.0])]
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")).collect()}
    assert got == want


def test_cells_of_two_lists(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(150, 12))
    x = np.vstack([base, base + rng.normal(size=base.shape) * 0.08, base[:50] + rng.normal(size=(50, 12)) * 0.08]).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    want = brute(rows)
    out = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), cell=12, cells=6)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    assert all(got[i][0] <= n for i, (n, _) in want.items())
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())


def test_greedy_search_reaches_what_brute_force_finds():
    rng = np.random.default_rng(5)
    x = vectors.unit(np.vstack([rng.normal(size=(400, 24)), rng.normal(size=(1, 24)) + rng.normal(size=(60, 24)) * 0.1])).astype(np.float32)
    graph = vectors.pruned_graph(x)
    r, m = vectors.search(x, graph, [0, 100, 200, 300, 430], x[:461], 0.95)
    true = set(zip(*np.nonzero(x @ x.T >= 0.95), strict=True))
    got = set(zip(r.tolist(), m.tolist(), strict=True))
    assert got <= {(int(a), int(b)) for a, b in zip(*np.nonzero(x @ x.T >= 0.95 - 2e-5), strict=True)} and len(got) >= 0.95 * len(true) and len(got) == len(r)


def test_a_link_found_in_the_second_shared_cell_alone_counts(spark, monkeypatch):
    import pyarrow as pa

    v = np.array([[1.0, 0.0], [1.0, 0.01]])
    side = lambda cell: pa.table({"cell": [cell] * 2, "node": [1, 2], "v": [x.tobytes() for x in v], "weight": [1, 3], "adj": [[2], [1]], "cells": [[5, 9]] * 2})
    right = vectors._search(side(9), side(9), 0.95)
    monkeypatch.setattr(vectors, "search", lambda *a, **k: (np.zeros(0, int), np.zeros(0, int)))
    left = vectors._search(side(5), side(5), 0.95)
    assert left.num_rows == 0
    assert {r["node"]: (r["n"], r["others"], r["weights"]) for r in right.to_pylist()} == {1: (0, [2], [3]), 2: (0, [1], [1])}


def test_counts_hold_wherever_components_do(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(size=(1, 16)) + rng.normal(size=(300, 16)) * 0.1, rng.normal(size=(100, 16))]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    want = brute([(i, [float(a) for a in v]) for i, v in enumerate(x)])
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df, cell=80, piece=60).collect()}
    assert all(got[i][0] <= n for i, (n, _) in want.items())
    assert not [i for i, (n, c) in got.items() if n == 0 and c != i]
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())


def test_recall_is_audited_and_widens_the_search(spark, monkeypatch):
    df = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(6)], "vec_id long, embedding array<float>")
    widths, recalls = [], [0.5, 0.95]
    near = vectors.near_vectors
    monkeypatch.setattr(vectors, "near_vectors", lambda *a, overlap, beam, **k: widths.append((overlap, beam)) or near(*a, overlap=overlap, beam=beam, **k))
    monkeypatch.setattr(vectors, "audit", lambda *a: recalls.pop(0))
    assert vectors.audited(df).recall == 0.95 and widths == list(vectors.WIDTHS[:2])
    monkeypatch.setattr(vectors, "audit", lambda *a: 0.1)
    with pytest.raises(RuntimeError):
        vectors.audited(df)
