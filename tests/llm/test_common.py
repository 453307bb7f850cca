import random

import pyarrow as pa

from contractlens.llm import common
from contractlens.llm.common import components, tidied


def test_components_by_either_way(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000 + rnd.randrange(300), 1000 + rnd.randrange(300)) for _ in range(180)] + [(7777, 5000 + i) for i in range(50)] + [(3, 3)]
    comp = {x: x for e in edges for x in e}
    for _ in range(80):
        for u, v in edges:
            comp[u] = comp[v] = min(comp[u], comp[v])
    linked = {x for u, v in edges if u != v for x in (u, v)}
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    for bound in (0, 10**6):
        rows = components(df, "t", bound).collect()
        assert {r.node: r.comp for r in rows} == {x: c for x, c in comp.items() if x in linked} and len(rows) == len(linked)
    assert components(df.limit(0), "t").count() == 0


def _counting(batches):
    kept = common.KEPT.setdefault(__name__, {"n": 0})
    for b in batches:
        kept["n"] += b.num_rows
        yield pa.RecordBatch.from_pydict({"modules": [",".join(sorted(common.KEPT))]})


def test_a_task_of_another_module_clears_what_was_kept():
    common.KEPT["elsewhere"] = {"much": 1}
    assert [b.to_pydict() for b in tidied(_counting)([pa.RecordBatch.from_pydict({"x": [1, 2]})])] == [{"modules": [__name__]}]
    assert common.KEPT[__name__]["n"] == 2
    common.KEPT.clear()
