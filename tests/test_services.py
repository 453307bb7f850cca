"""References, registry, cross-contract checks, policy, code scan, command line."""

import pytest

from contractlens import contract, services

A = "id: a\nversion: 1.0.0\noutputs: [{name: o, location: gold/o, schema: [{name: x, type: long}, {name: y, type: string}]}]\n"
B = "id: b\nversion: 1.0.0\ninputs: [{name: i, location: ref://o, type: SOURCE, schema: [{name: x, type: string}, {name: y, type: string, nullable: false}, {name: z, type: long}]}]\noutputs: [{name: p, location: gold/p}]\n"


def test_references():
    c = services.resolve_locations(contract.parse(B), {"o": "s3://b/gold/o"})
    assert c.inputs[0].location == "s3://b/gold/o"
    with pytest.raises(services.NotResolved):
        services.resolve_locations(contract.parse(B), {})
    assert services.load("registry://a@1.0.0", {"a@1.0.0": A}).id == "a"
    with pytest.raises(services.NotResolved):
        services.load("registry://a@2.0.0", {"a@1.0.0": A})


def test_cross_contract():
    b = services.resolve_locations(contract.parse(B), {"o": "s3://b/gold/o"})
    got = [x[2] for x in services.cross_contract([contract.parse(A), b])]
    assert got == ["is an output of a but declared as a source", "type of x differs from a", "y may be null in a", "a does not provide z"]


@pytest.mark.parametrize("kind", sorted(contract.POLICIES))
def test_each_policy_has_a_pass_and_a_fail(kind):
    c = contract.parse("id: team.c\nstatus: active\noutputs: [{name: o, location: s3://b/o, format: csv, saveMode: append, schema: [{name: email, type: string, sensitivityTags: [pii]}]}]")
    good = {"requireDescriptionOfStatus": {"allowed": ["active"]}, "allowedFormats": {"formats": ["csv"]}, "forbiddenFormats": {"formats": ["orc"]}, "allowedLocations": {"prefixes": ["s3://b/"]}, "requiredFields": {"fields": ["email"]}, "requireNonNullable": {"fields": ["id"]}, "requiredTags": {"pattern": "mail", "tags": ["pii"]}, "forbiddenTags": {"tags": ["x"]}, "requiredRules": {"rules": []}, "requireSaveMode": {"modes": ["append"]}, "requireCatalog": None, "namePattern": {"pattern": r"team\..*"}}[kind]
    bad = {"requireDescriptionOfStatus": {"allowed": ["draft"]}, "allowedFormats": {"formats": ["orc"]}, "forbiddenFormats": {"formats": ["csv"]}, "allowedLocations": {"prefixes": ["hdfs://"]}, "requiredFields": {"fields": ["id"]}, "requireNonNullable": {"fields": ["email"]}, "requiredTags": {"pattern": "mail", "tags": ["gdpr"]}, "forbiddenTags": {"tags": ["pii"]}, "requiredRules": {"rules": ["forbidCrossJoin"]}, "requireSaveMode": {"modes": ["error"]}, "requireCatalog": {}, "namePattern": {"pattern": "x"}}[kind]
    rule = lambda p: [{"id": "r", "type": kind} | p]
    assert contract.policy_findings(c, rule(bad))
    assert good is None or not contract.policy_findings(c, rule(good))
    assert not contract.policy_findings(c, rule(bad | {"exemptions": [{"contract": "team.c", "reviewBy": "2030-01-01"}]}), "2029-01-01")
    assert contract.policy_findings(c, rule(bad | {"exemptions": [{"contract": "team.c", "reviewBy": "2030-01-01"}]}), "2031-01-01")
    assert not contract.policy_findings(c, rule(bad | {"scope": "other"}))


def test_scan_and_command_line(tmp_path, capsys):
    assert services.scan_code("import pandas as pd\nx = pd.read_csv('a')\nopen('b', 'w')\nopen('c')\nos.system('ls')\neval('1')") == [(2, "CL001 read", "read_csv"), (3, "CL002 write", "open"), (4, "CL001 read", "open"), (5, "CL005 process", "system"), (6, "CL006 dynamic", "eval")]
    for n, t in (("a", A), ("bad", A.replace("1.0.0", "x"))):
        (tmp_path / f"{n}.yaml").write_text(t)
    assert services.main(["lint", str(tmp_path / "a.yaml")]) == 0 and services.main(["lint", str(tmp_path / "bad.yaml")]) == 1
    capsys.readouterr()
    assert services.main(["merge", str(tmp_path / "a.yaml")]) == 0
    assert contract.parse(capsys.readouterr().out).outputs[0].location == "gold/o"


def test_settings_and_capabilities(spark):
    assert services.setting(spark, "dryRun", {"CONTRACTLENS_DRY_RUN": "true"}) == "true"
    spark.conf.set("spark.contractlens.dryRun", "false")
    assert services.setting(spark, "dryRun", {"CONTRACTLENS_DRY_RUN": "true"}) == "false"
    spark.conf.unset("spark.contractlens.dryRun")
    assert services.unsupported(contract.parse(A)) == [] and services.unsupported(contract.parse(A + "rules: [{type: mergeCondition, columns: [x]}]"))


def test_the_scan_follows_names():
    code = """
import pandas
from pyarrow import parquet as pq
import subprocess as sp
from sqlite3 import connect as join
load = pandas.read_csv
load('a')
pq.write_table(t, 'b')
sp.run(['ls'])
join('c.db').execute('select 1')
self.read_csv('d')
read_csv('e')
import pathlib
pathlib.Path('f').write_text('g')
df.to_parquet('h')
client.connect('i')
open('j', mode='a')
"""
    assert [(line, kind.partition(" ")[2]) for line, kind, _ in services.scan_code(code)] == [(7, "read"), (8, "write"), (9, "process"), (10, "connect"), (10, "sql"), (14, "write"), (15, "write"), (17, "write")]
    assert [v.type for v in services.ungoverned("open('a')\nopen('b')  # contractlens: allow a log\n", "x.py")] == ["UNGOVERNED_DATA_ACCESS"]
