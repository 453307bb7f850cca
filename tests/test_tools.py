"""The check by messages, the strict watch, the report page, files of desktop formats, table functions."""

import io
import json
import sqlite3
import subprocess
import sys

import pytest

from contractlens import contract, protocol, report, services, watch
from contractlens.plans.analysis import lineage
from contractlens.plans.catalyst import translate
from contractlens.sources import files

TEXT = """
id: orders
inputs: [{name: orders, location: raw/orders, format: parquet, schema: {fields: [{name: k, type: long}]}}]
outputs: [{name: daily, location: gold/daily, format: parquet, saveMode: overwrite, schema: {fields: [{name: day, type: date, required: true}, {name: lines, type: 'array<struct<sku:string,qty:integer>>'}, {name: total, type: 'decimal(10,2)'}]}}]
"""
FIELDS = [{"name": "day", "type": "date", "nullable": True}, {"name": "lines", "type": "array<struct<sku:string,qty:int>>"}, {"name": "total", "type": "decimal(10,2)"}]


def request(**write):
    w = {"output": "daily", "format": "parquet", "saveMode": "overwrite", "fields": FIELDS, "nulls": {"day": 0}} | write
    return {"contract": TEXT, "write": w, "reads": [{"location": "s3://b/raw/orders", "format": "parquet", "fields": [{"name": "k", "type": "bigint"}]}]}


def test_answers():
    assert protocol.answer(request()) == {"status": "PASSED", "findings": []}
    assert [f["type"] for f in protocol.answer(request(nulls={"day": 3}))["findings"]] == ["OUTPUT_FIELD_NULLABILITY_MISMATCH"]
    got = protocol.answer(request(location="gold/else", format="csv", fields=FIELDS[:1] + [FIELDS[2] | {"type": "double"}]) | {"reads": []})
    assert sorted(f["type"] for f in got["findings"]) == ["MISSING_INPUT", "OUTPUT_FIELD_TYPE_MISMATCH", "OUTPUT_FORMAT_MISMATCH", "OUTPUT_LOCATION_MISMATCH"]
    assert protocol.answer({"contract": "id: x\n"})["status"] == "ERROR"
    assert protocol.answer(request() | {"contract": "id: c\noutputs: 3\n"})["findings"][0]["type"] == "INVALID_CONTRACT"
    out = io.StringIO()
    protocol.serve([json.dumps(request()), "", "{"], out)
    assert [json.loads(x)["status"] for x in out.getvalue().splitlines()] == ["PASSED", "ERROR"]


def test_the_command_line_answers_and_reports(tmp_path, capsys):
    (tmp_path / "r.json").write_text(json.dumps(request()))
    assert services.main(["check", str(tmp_path / "r.json")]) == 0 and json.loads(capsys.readouterr().out)["status"] == "PASSED"
    (tmp_path / "e.jsonl").write_text(json.dumps({"type": "WRITE", "status": "FAILED", "output": "<b>", "violations": [{"type": "X", "message": "a < b"}]}) + "\n")
    assert services.main(["report", str(tmp_path / "e.jsonl")]) == 0
    page = capsys.readouterr().out
    assert "&lt;b&gt;" in page and "a &lt; b" in page and "1 failed" in page and page == report.page(report.events_of([(tmp_path / "e.jsonl").read_text()])) + "\n"


def test_the_watch_sees_what_goes_round(tmp_path):
    (tmp_path / "in.txt").write_text("x")
    with watch.Watch(allow=[tmp_path / "allowed"]) as w:
        (tmp_path / "in.txt").read_text()
        open(tmp_path / "out.txt", "w").close()
        open(tmp_path / "allowed.txt", "w").close()
        sqlite3.connect(str(tmp_path / "x.db")).close()
        subprocess.run([sys.executable, "-c", ""], check=True)
    open(tmp_path / "after.txt", "w").close()
    said = [v.message.partition(": ")[2].split(" of ")[0] for v in w.findings]
    assert said[:3] == ["read", "write", "database"] and "process" in said
    with pytest.raises(watch.Refused), watch.Watch(refuse=True):
        open(tmp_path / "no.txt", "w")
    assert not (tmp_path / "no.txt").exists()


def test_feather(spark, tmp_path):
    d = contract.Dataset("d", str(tmp_path / "x.feather"), "feather")
    files.write(spark.range(3), d)
    assert files.read(spark, d).count() == 3
    with pytest.raises(FileExistsError):
        files.write(spark.range(3), d)


def test_a_table_function_is_opaque(spark):
    from contractlens import queries

    plan, _ = translate(queries.QUERIES["udtf_parts"](spark, "/root/testdata/sf0.001"))
    assert {c.output: c.derivation for c in lineage(plan)}["part"] == "Opaque"
