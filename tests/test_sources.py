"""Formats, layouts and row mutations."""

import pytest

from contractlens import contract
from contractlens.plans import mutations
from contractlens.sources import files

FIELDS = "schema: [{name: n_nationkey, type: integer}, {name: n_name, type: string}, {name: n_regionkey, type: integer, partitioned: PART}]"


@pytest.mark.parametrize(("fmt", "extra", "part"), [("parquet", "", True), ("orc", "", False), ("json", "", False), ("csv", "csv: {delimiter: ';', header: true, quote: \"'\"},", False)])
def test_round_trip(spark, tmp_path, fmt, extra, part):
    c = contract.parse(f"id: x\noutputs: [{{name: o, location: '{tmp_path}/o', format: {fmt}, {extra} {FIELDS.replace('PART', str(part).lower())}}}]")
    src = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    files.write(src.select("n_nationkey", "n_name", "n_regionkey"), c.outputs[0])
    got = files.read(spark, c.outputs[0])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, src.select("n_nationkey", "n_name", "n_regionkey").collect()))


def test_missing_connector(spark):
    with pytest.raises(files.NoConnector):
        files.read(spark, contract.Dataset("d", "/nowhere", "delta"))


@pytest.mark.parametrize(
    ("sql", "kind", "scope", "updated"),
    [("DELETE FROM t", "delete", "Unconditional", ()), ("DELETE FROM t WHERE true", "delete", "Unconditional", ()), ("DELETE FROM t WHERE id = 3", "delete", "Conditional", ()), ("UPDATE t SET v = 1, w = w WHERE id = 3", "update", "NotApplicable", ("v",)), ("MERGE INTO t USING s ON t.id = s.id WHEN MATCHED THEN UPDATE SET v = s.v", "merge", "NotApplicable", ("v",))],
)
def test_mutations(spark, sql, kind, scope, updated):
    m = mutations.classify(mutations.parse(spark, sql))
    assert m["kind"] == kind and mutations.scope(m) == scope and m["understood"] and tuple(m["updated"]) == updated
    assert mutations.classify(mutations.parse(spark, "SELECT 1")) is None


def test_destructive_commands():
    v = mutations.destructive_verdict
    assert v("DropTable", "a.t", {}, False) and v("DropTable", "a.t", {"a.t": "append"}, False) and v("DropNamespace", "a", {}, False)
    assert v("TruncateTable", "a.t", {"a.t": "overwrite"}, False) is None and v("TruncateTable", "a.t", {"a.t": "overwrite"}, True)
    assert v("TruncatePartition", "a.t", {"a.t": "overwrite"}, True) is None
