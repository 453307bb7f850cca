"""Runs, streamed batches, events and documents of policies."""

import json
import os
import threading
from datetime import date
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from contractlens import capabilities, contract, enforce, plugins, policy, services
from contractlens.operators import quality

SF = "/root/testdata/sf0.001"
PARTED = """
id: parted
inputs: [{name: nation, location: SF/nation.parquet, schema: [{name: n_name, type: string}, {name: n_regionkey, type: integer}]}]
outputs:
  - {name: a, location: OUT/a, format: parquet, saveMode: overwrite, partitionOverwriteMode: dynamic, schema: {fields: [{name: n_name, type: string}, {name: n_regionkey, type: integer, partitioned: true}]}}
"""


def parted(tmp_path, **swap):
    out = PARTED
    for k, v in swap.items():
        out = out.replace(f": {k}", f": {v}")
    return out.replace("SF", SF).replace("OUT", str(tmp_path))


def regions(spark, tmp_path, name="a"):
    return {r.n_regionkey: r["count"] for r in spark.read.parquet(str(tmp_path / name)).groupBy("n_regionkey").count().collect()}


def test_dynamic_overwrite_keeps_other_partitions(spark, tmp_path):
    events = []
    with enforce.Run(spark, parted(tmp_path), sinks=[events.append]) as run:
        run.write(run.read("nation"), "a")
    assert regions(spark, tmp_path) == {k: 5 for k in range(5)}
    with enforce.Run(spark, parted(tmp_path)) as run:
        run.write(run.read("nation").where("n_regionkey = 2").limit(2), "a")
    assert regions(spark, tmp_path) == {0: 5, 1: 5, 2: 2, 3: 5, 4: 5}
    with enforce.Run(spark, parted(tmp_path, dynamic="static")) as run:
        run.write(run.read("nation").where("n_regionkey = 3"), "a")
    assert regions(spark, tmp_path) == {3: 5}
    assert not [n for n in os.listdir(tmp_path) if "__" in n]
    done = next(e for e in events if e["type"] == "WRITE")
    assert done["rows"] == 25 and done["files"] >= 5 and done["bytes"] > 0 and done["job"] == "parted"


@pytest.mark.parametrize("mode", ["append", "overwrite"])
@pytest.mark.parametrize("dynamic", ["static", "dynamic"])
def test_a_failed_move_takes_everything_back(spark, tmp_path, monkeypatch, mode, dynamic):
    text = parted(tmp_path, overwrite=mode, dynamic=dynamic)
    with enforce.Run(spark, parted(tmp_path)) as run:
        run.write(run.read("nation"), "a")
    before = sorted(str(p) for p in (tmp_path / "a").rglob("*.parquet"))
    put, calls = enforce.Files.put, []

    def broken(self, source, target):
        calls.append(target)
        if len(calls) == (1 if mode == "overwrite" and dynamic == "static" else 3):
            raise enforce.CheckNotRun("the file system gave up")
        put(self, source, target)

    monkeypatch.setattr(enforce.Files, "put", broken)
    with pytest.raises(enforce.CheckNotRun), enforce.Run(spark, text) as run:
        run.write(run.read("nation"), "a", mode=mode)
    assert sorted(str(p) for p in (tmp_path / "a").rglob("*.parquet")) == before
    assert not [n for n in os.listdir(tmp_path) if "staged" in n]


def test_a_rename_that_says_no_is_an_error(spark, tmp_path):
    files = enforce.Files(spark)
    (tmp_path / "x").mkdir()
    with pytest.raises(enforce.CheckNotRun):
        files.put(str(tmp_path / "nothing"), str(tmp_path / "y"))
    with pytest.raises(enforce.CheckNotRun):
        files.put(str(tmp_path / "x"), str(tmp_path))


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    text = f"id: s\noutputs: [{{name: a, location: '{tmp_path}/a', schema: [{{name: id, type: long}}]}}]\n"
    put = enforce.guarded_batches(text, "a", str(tmp_path / "a"))
    put(spark.range(10), 0)
    put(spark.range(10, 15), 1)
    put(spark.range(10, 15).repartition(3), 1)  # as after a failure between write and commit
    put(spark.range(20, 21), 2)
    got = sorted(r.id for r in spark.read.parquet(str(tmp_path / "a")).collect())
    assert got == [*range(15), 20]
    assert sorted(os.listdir(tmp_path / "a" / "_batches"))[-1].endswith("2") and len([x for x in os.listdir(tmp_path / "a" / "_batches") if not x.startswith(".")]) == 2


def test_reading_and_decorators(spark, tmp_path):
    @enforce.job(parted(tmp_path, dynamic="static"), spark, name="nightly")
    def make(run):
        load(run)
        return run.name

    @enforce.writes("a")
    @enforce.reads(nations="nation")
    def load(run, nations):
        assert [len(x) for x in run.chunks("nation", 10)] == [10, 10, 5]
        assert list(run.read("nation", "pandas").columns) == ["n_name", "n_regionkey"] and run.read("nation", "arrow").num_rows == 25
        with pytest.raises(enforce.CheckNotRun):
            run.read("nation", "polars")
        return nations

    assert make() == "nightly" and regions(spark, tmp_path) == {k: 5 for k in range(5)}


def test_events_over_http_with_dead_letter(tmp_path):
    got = []

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            got.append((json.loads(self.rfile.read(int(self.headers["Content-Length"]))), self.headers.get("Authorization")))
            self.send_response(200 if len(got) != 1 else 503)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    total, dead = enforce.Summary(), []
    sink = enforce.fan_out(enforce.http_sink(f"http://127.0.0.1:{server.server_port}/", "secret", wait=0.001), total, enforce.log_sink())
    sink({"type": "WRITE", "status": "PASSED", "rows": 4})
    sink({"type": "CONTRACT_VALIDATION", "status": "FAILED", "violations": [{"type": "MISSING_INPUT"}]})
    server.shutdown()
    server.server_close()
    assert [g[0]["type"] for g in got] == ["WRITE", "WRITE", "CONTRACT_VALIDATION"] and got[0][1] == "Bearer secret"
    assert total.event() == {"type": "SUMMARY", "status": "FAILED", "events": 2, "failed": 1, "findings": {"MISSING_INPUT": 1}, "rows": 4}
    enforce.http_sink(f"http://127.0.0.1:{server.server_port}/", wait=0.001, dead_letter=dead.append)({"type": "WRITE", "status": "PASSED"})
    assert len(dead) == 1 and dead[0]["undelivered"]


def test_events_in_a_shared_folder(spark, tmp_path):
    enforce.shared_sink(spark, str(tmp_path / "events"))({"type": "WRITE"})
    (name,) = [x for x in os.listdir(tmp_path / "events") if x.endswith(".json")]
    assert json.loads((tmp_path / "events" / name).read_text()) == {"type": "WRITE"}


def test_types_are_taken_over_only_without_loss(spark):
    df = spark.createDataFrame([(1.0, "7", "x", 3), (2.0, "8", "9", None), (None, None, None, 4)], "a double, b string, c string, d int")
    fields = [contract.Field("a", "long"), contract.Field("b", "integer"), contract.Field("c", "integer"), contract.Field("d", "string"), contract.Field("e", "long")]
    assert [f.dataType.simpleString() for f in quality.conform(df, fields).schema] == ["bigint", "int", "string", "string"]
    with_half = df.withColumn("a", F.col("a") + 0.5)
    assert quality.conform(with_half, fields).schema["a"].dataType.simpleString() == "double"


class LowerCase:
    def evaluate(self, c, rule):
        return [] if c.id.islower() else [(None, f"{c.id} is not in lower case")]


class Agreed:
    def check(self, contracts):
        return [("here", "Conforms", f"{len(contracts)} contracts")]


def test_policies_of_ones_own_layers_and_guarantees():
    text = f'version: "1"\npolicies: [{{id: a, type: lower_case, mode: warn}}]\ncustomPolicyTypes: {{lower_case: {__name__}.LowerCase}}\n'
    text += f"typeGuarantees: {{enabled: [data_asset_schema_consistency, data_asset_downstream_consumption, agreed], customTypeGuaranteeTypes: {{agreed: {__name__}.Agreed}}}}\n"
    text += 'exemptions: [{contractId: X, policyIds: [a], reason: r, reviewBy: "2026-02-01"}, {contractId: Y, policyIds: [a], reason: r, reviewBy: "2026-01-05"}]\n'
    p = policy.parse_policy(text)
    make = lambda i, kind: contract.parse(f"id: {i}\ninputs: [{{name: i, location: s3://b/{'q' if i == 'a' else 'a'}, type: DATA_ASSET, schema: {{fields: [{{name: k, type: {kind}}}]}}}}]\noutputs: [{{name: o, location: s3://b/{i}, type: DATA_ASSET, schema: {{fields: [{{name: k, type: long, required: true}}]}}}}]\n")
    a, b = make("a", "long"), make("B", "string")
    assert policy.evaluate(a, p) == [] and [(f.mode, f.message) for f in policy.evaluate(b, [p, p])] == [("warn", "B is not in lower case")] * 2
    got = policy.guarantees([a, b], p)
    assert ("data_asset_schema_consistency", "s3://b/a", "Contradicts", "B and a differ in the type of k") in got
    assert [x[2] for x in got if x[0] == "data_asset_downstream_consumption"] == ["Conforms", "CannotDetermine"] and got[-1][0] == "agreed"
    assert [e.contract for e in policy.expiring(p, 30, date(2026, 1, 2))] == ["Y", "X"]
    with pytest.raises(plugins.PluginError):
        plugins.resolve(f"{__name__}.LowerCase", "check")


def test_injected_rules_are_enforced(spark):
    p = policy.parse_policy('version: "1"\ninject: {rules: [{type: forbid_cross_join}], minVerificationOptions: {rejectUndeclaredFields: true}}\n')
    text = f"id: c\ninputs: [{{name: n, location: {SF}/nation.parquet}}]\noutputs: [{{name: o, location: o, schema: {{fields: [{{name: n_name, type: string}}]}}}}]\n"
    n = spark.read.parquet(f"{SF}/nation.parquet")
    df = n.crossJoin(spark.read.parquet(f"{SF}/region.parquet")).select("n_name", "r_name")
    assert enforce.findings(df, text, "o", location="o") == []
    assert {v.type for v in enforce.findings(df, text, "o", location="o", policies=[p])} == {"RULE_CROSS_JOIN_VIOLATION", "UNDECLARED_OUTPUT_COLUMN"}


def test_capabilities():
    assert len(capabilities.matrix()) == 35 and all(level in capabilities.LEVELS for level, _ in capabilities.matrix().values())
    with pytest.raises(ValueError):
        capabilities.matrix({"check.everything": "supported"})


def test_static_field_ranges():
    from contractlens.checks import judge
    from contractlens.contract import Constraint
    from contractlens.plans.analysis import Facts

    low, high, open_ = Facts(False, low=0, high=5), Facts(False, low=5, high=9), Facts(False, low=5, high=9, low_open=True)
    at_most = lambda op, f, other: judge(f, Constraint("fieldRange", {op: "x"}), {"x": other})
    assert at_most("lte", low, high) == "Guaranteed" and at_most("lt", low, high) == "NotGuaranteed" and at_most("lt", low, open_) == "Guaranteed"
    assert at_most("gt", low, high) == "Violated" and at_most("gte", low, high) == "NotGuaranteed" and at_most("gte", low, open_) == "Violated"
    assert at_most("lt", Facts(None, low=9, high=9), low) == "NotGuaranteed" and at_most("lt", low, Facts(unsupported=True)) == "NotStaticallyVerifiable"


def test_the_command_line_lints_policies(tmp_path, capsys):
    (tmp_path / "p.yaml").write_text('version: "1"\npolicies: [{id: a, type: require_dataset_description}]\n')
    (tmp_path / "c.yaml").write_text("id: c\nversion: 1.0.0\noutputs: [{name: o, location: o}]\n")
    assert services.main(["org-policy", "--rules", str(tmp_path / "p.yaml"), str(tmp_path / "c.yaml")]) == 1
    assert "o must have a description" in capsys.readouterr().out
    (tmp_path / "p.yaml").write_text('version: "1"\npolicies: [{id: a, type: require_dataset_description, mode: warn}]\n')
    assert services.main(["org-policy", "--rules", str(tmp_path / "p.yaml"), str(tmp_path / "c.yaml")]) == 0
