"""Plans, contracts and enforcement."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from contractlens import contract, enforce
from contractlens.checks import Write, csv_options, judge, verify
from contractlens.contract import Constraint
from contractlens.plans import catalyst
from contractlens.plans.analysis import Facts, fingerprint, lineage, properties
from contractlens.plans.model import nodes, render

SF = "/root/testdata/sf0.001"


def test_translator_never_raises_on_random_chains(spark):
    rnd = random.Random(1)
    base = spark.read.parquet(f"{SF}/orders.parquet")
    steps = [
        lambda d: d.withColumn("x", F.col("o_totalprice") + rnd.random()),
        lambda d: d.where(F.col("o_orderkey") % 2 == 0),
        lambda d: d.distinct(),
        lambda d: d.limit(50).offset(2),
        lambda d: d.orderBy(F.desc("o_orderkey")),
        lambda d: d.union(d),
        lambda d: d.intersect(d),
        lambda d: d.exceptAll(d.limit(1)),
        lambda d: d.repartition(3),
        lambda d: d.sample(0.5, 3),
        lambda d: d.alias("a").join(base.select(F.col("o_orderkey").alias("k")), F.col("k") == F.col("o_orderkey"), rnd.choice(["inner", "left", "full"])).drop("k"),
        lambda d: d.withColumn("e", F.explode(F.array(F.lit(1), F.lit(2)))).drop("e"),
        lambda d: d.withColumn("r", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("o_custkey").orderBy("o_orderkey"))).drop("r"),
    ]
    for _ in range(40):
        df = base
        for _ in range(rnd.randrange(1, 6)):
            df = rnd.choice(steps)(df)
        plan, said = catalyst.translate(df)
        assert any(p.kind == "read" for p in nodes(plan)), (render(plan), said)
        assert [c.output for c in lineage(plan)] == df.columns
        assert set(properties(plan)) == set(df.columns)
        assert fingerprint(plan).overall == fingerprint(catalyst.translate(df)[0]).overall


def test_nodes_and_diagnostics(spark):
    base = spark.read.parquet(f"{SF}/orders.parquet")
    kinds = lambda df: [p.kind for p in nodes(catalyst.translate(df)[0])]
    assert kinds(base.select("o_orderkey").where("o_orderkey > 1")) == ["filter", "project", "read"]
    assert kinds(base.groupBy("o_custkey").count().orderBy("count").limit(3))[:3] == ["limit", "sort", "aggregate"]
    assert "expand" in kinds(base.cube("o_custkey").count())
    assert "generate" in kinds(base.select(F.explode(F.array("o_custkey"))))
    assert "window" in kinds(base.select(F.sum("o_custkey").over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("o_orderstatus"))))
    plan, said = catalyst.translate(spark.range(3).toDF("i"))
    assert plan.kind in ("unknown", "project") and said


def test_long_chains_are_linear(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey")
    for _ in range(15):
        df = df.withColumn("o_orderkey", F.col("o_orderkey") + F.col("o_orderkey"))
    plan, _ = catalyst.translate(df)
    assert lineage(plan)[0].derivation == "Computed" and len(fingerprint(plan).overall) == 64


def test_sql_command_is_analyzed_without_running(spark, tmp_path):
    spark.read.parquet(f"{SF}/nation.parquet").createOrReplaceTempView("nat")
    plan = catalyst.analyze_sql(spark, f"INSERT OVERWRITE DIRECTORY '{tmp_path}/o' USING parquet SELECT n_name FROM nat")
    assert "Insert" in plan.getClass().getSimpleName() and not os.path.exists(f"{tmp_path}/o")


@pytest.mark.parametrize(
    ("declared", "actual", "ok"),
    [("long", "bigint", True), ("BIGINT", "bigint", True), ("int", "int", True), ("string", "bigint", False), ("array", "array<int>", True), ("array<long>", "array<bigint>", True), ("array<long>", "array<int>", False), ("decimal", "decimal(10,2)", False), ("decimal(10,2)", "decimal(10,2)", True), ("numeric(10,2)", "decimal(10,2)", True), ("struct<a:int,b:string>", "struct<a:int,b:string>", True), ("struct<b:string,a:int>", "struct<a:int,b:string>", False), ("map<string,long>", "map<string,bigint>", True), ("json", "string", False), ("timestamp_ltz", "timestamp", True)],
)
def test_types(declared, actual, ok):
    assert contract.type_matches(declared, actual) is ok


def test_locations():
    n = contract.normal_location
    assert n("S3A://b//x/./y/") == "s3://b/x/y" and n("file:///a/b") == "/a/b" and n("a\\b") == "a/b"
    assert contract.same_location("out/x", "file:/data/out/x") and not contract.same_location("ut/x", "/data/out/x")
    assert contract.same_location("orders", "gold.orders") and not contract.same_location("ders", "gold.orders")


def test_contract_round_trip_and_versions():
    text = "id: c\nversion: 1.0.0\ninputs: [{name: a, location: l, schema: [{name: x, type: long}]}]\noutputs: [{name: o, location: m, schema: [{name: y, type: string, nullable: false, constraints: {length: {min: 1}}}]}]\n"
    c = contract.parse(text)
    assert contract.parse(contract.to_yaml(c)) == c and not [m for k, m in contract.validate(c) if k == "ERROR"]
    new = contract.parse(text.replace("type: string", "type: long").replace("1.0.0", "1.1.0"))
    assert not contract.bump_ok(c, new) and contract.bump_ok(c, contract.parse(text.replace("type: string", "type: long").replace("1.0.0", "2.0.0")))
    with pytest.raises(ValueError):
        contract.parse("- 1")


@pytest.mark.parametrize(
    ("facts", "kind", "spec", "want"),
    [(Facts(False, frozenset([1])), "equals", {"value": 1.0}, "Guaranteed"), (Facts(False, frozenset(["1"])), "equals", {"value": 1}, "Violated"), (Facts(None, frozenset([5])), "oneOf", {"value": [1]}, "NotGuaranteed"), (Facts(False, low=3, high=4), "range", {"gte": 3, "lt": 5}, "Guaranteed"), (Facts(False, low=6), "range", {"lte": 5}, "Violated"), (Facts(), "range", {"gte": 0}, "NotGuaranteed"), (Facts(unsupported=True), "range", {"gte": 0}, "NotStaticallyVerifiable"), (Facts(False, min_len=2, max_len=3), "length", {"exact": 4}, "Violated")],
)
def test_judgement(facts, kind, spec, want):
    assert judge(facts, Constraint(kind, spec)) == want


def test_value_semantics(spark):
    from contractlens.contract import Field
    from contractlens.operators import quality

    df = spark.createDataFrame([(1, "1", 1.0, True), (2, "é2", float("nan"), False), (None, None, None, None)], "i long, s string, f double, b boolean")
    def failed(col, kind, spec):
        return quality.report(df, [Field(col, constraints=(Constraint(kind, spec),))]).first().failed
    assert failed("i", "equals", {"value": 1.0}) == 1
    assert failed("s", "equals", {"value": 1}) == 2
    assert failed("b", "equals", {"value": 1}) == 2
    assert failed("f", "range", {"gte": 0}) == 1
    assert failed("s", "range", {"gte": 0}) == 2
    assert failed("s", "length", {"exact": 2}) == 1
    assert failed("i", "fieldRange", {"lte": "f"}) == 0
    assert failed("i", "fieldRange", {"lt": "f"}) == 1
    assert failed("i", "fieldRange", {"lt": "absent"}) == 0


CONTRACT = """
id: job
inputs: [{name: nation, location: SF/nation.parquet, schema: [{name: n_name, type: string}, {name: n_regionkey, type: integer}]}]
outputs:
  - {name: a, location: OUT/a, format: parquet, saveMode: MODE, schema: [{name: n_name, type: string, constraints: {length: {min: LEN}}}]}
"""


def text(tmp_path, mode="overwrite", least=1):
    return CONTRACT.replace("SF", SF).replace("OUT", str(tmp_path)).replace("MODE", mode).replace("LEN", str(least))


def test_run_publishes_all_or_nothing(spark, tmp_path):
    events = []
    with enforce.Run(spark, text(tmp_path), sinks=[events.append]) as run:
        df = run.read("nation")
        assert df.columns == ["n_name", "n_regionkey"]
        run.write(df.select("n_name"), "a")
        assert not os.path.exists(tmp_path / "a")
    assert spark.read.parquet(str(tmp_path / "a")).count() == 25
    assert [e["type"] for e in events] == ["CONTRACT_VALIDATION", "WRITE"]
    with pytest.raises(enforce.ContractViolation) as bad, enforce.Run(spark, text(tmp_path, least=99), runtime=True) as run:
        run.write(run.read("nation").select("n_name").limit(1), "a")
    assert bad.value.findings[0].type == "RUNTIME_DATA_QUALITY_VIOLATION"
    assert spark.read.parquet(str(tmp_path / "a")).count() == 25
    with pytest.raises(enforce.ContractViolation), enforce.Run(spark, text(tmp_path)):
        pass
    with enforce.Run(spark, text(tmp_path, "append")) as run:
        run.write(run.read("nation").select("n_name"), "a")
    assert spark.read.parquet(str(tmp_path / "a")).count() == 50
    assert [n for n in os.listdir(tmp_path) if "__" in n] == []


def test_job_and_guard(spark, tmp_path):
    @enforce.job(text(tmp_path), spark)
    def make(run):
        run.write(run.read("nation").select("n_name"), "a")
        return 7

    assert make() == 7
    with pytest.raises(enforce.ContractViolation):
        enforce.guard(spark.read.parquet(f"{SF}/region.parquet"), text(tmp_path), "a", str(tmp_path / "b"))
    assert not os.path.exists(tmp_path / "b")


def test_streaming_batches_are_refused(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/nation.parquet")
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "nation.parquet").parquet(SF).select("n_name")
    bad = text(tmp_path, "append", least=99).replace("inputs: [", "inputs: [] #[")
    q = stream.writeStream.foreachBatch(enforce.guarded_batches(bad, "a", str(tmp_path / "a"))).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="FOREACH_BATCH_USER_FUNCTION_ERROR"):
        q.awaitTermination()
    said = str(q.exception())
    assert "fail length" in said, [x for x in said.splitlines() if "rror" in x or "iolation" in x][:8]
    assert not os.path.exists(tmp_path / "a")


def test_sinks(tmp_path):
    f = enforce.file_sink(str(tmp_path / "e.jsonl"))
    enforce.fan_out(f, enforce.failures_only(f))({"status": "PASSED"})
    enforce.failures_only(f)({"status": "FAILED"})
    assert [json.loads(x)["status"] for x in open(tmp_path / "e.jsonl")] == ["PASSED", "FAILED"]
    tries = []

    def flaky(event):
        tries.append(event)
        if len(tries) < 3:
            raise OSError

    enforce.retrying(flaky, wait=0.001)({})
    assert len(tries) == 3


def test_csv_defaults_and_merge_rule(spark):
    assert csv_options({"sep": ";", "charset": "x"})["delimiter"] == ";" and csv_options({})["header"] == "false"
    c = contract.parse("id: m\noutputs: [{name: o, location: o}]\nrules: [{type: mergeCondition, columns: [id]}, {type: allowedUpdateColumns, columns: [v]}]")
    plan, _ = catalyst.translate(spark.read.parquet(f"{SF}/nation.parquet"))
    got = verify(Write(plan, [], "o", mutation={"kind": "merge", "condition": None, "updated": ["v", "w"]}), c)
    assert [v.type for v in got] == ["RULE_MERGE_CONDITION_VIOLATION", "RULE_DISALLOWED_UPDATE_COLUMN"]


@pytest.mark.parametrize("sql", ["SELECT c_custkey FROM sq_c WHERE c_acctbal > (SELECT avg(o_totalprice) FROM sq_o)", "SELECT c_custkey FROM sq_c WHERE c_custkey IN (SELECT o_custkey FROM sq_o)", "SELECT c_custkey FROM sq_c WHERE EXISTS (SELECT 1 FROM sq_o WHERE o_custkey = c_custkey)", "WITH w AS (SELECT o_custkey FROM sq_o) SELECT c_custkey FROM sq_c WHERE c_custkey IN (SELECT o_custkey FROM w)"])
def test_reads_inside_subqueries_count(spark, sql):
    spark.read.parquet(f"{SF}/customer.parquet").createOrReplaceTempView("sq_c")
    spark.read.parquet(f"{SF}/orders.parquet").createOrReplaceTempView("sq_o")
    plan, said = catalyst.translate(spark.sql(sql))
    assert {p.info["location"].rpartition("/")[2] for p in nodes(plan) if p.kind == "read"} == {"customer.parquet", "orders.parquet"}, said
    assert [(c.output, c.derivation) for c in lineage(plan)] == [("c_custkey", "Direct")]
