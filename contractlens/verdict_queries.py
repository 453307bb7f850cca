"""Queries of the checks themselves: contract documents, statements, rules, policies, kinds of findings and the rest of the scenarios."""

from __future__ import annotations

import json
import threading
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from . import checks, contract, policy, services
from .checks import Violation, Write, columns_of, verify
from .enforce import findings
from .plans import boundaries
from .plans.analysis import fingerprint, lineage, sensitivity
from .plans.catalyst import analyze_sql, translate
from .plans.commands import judge_command
from .queries import t
from .session import missing_outputs
from .streaming.drain import checkpoints, folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(columns: str, expected: list[tuple]):
    """Register a query of text columns with its expected rows as SQL."""
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"

    def add(f):
        def run(spark, d):
            return spark.createDataFrame([tuple(r) for r in f(spark, d)], ", ".join(f"{c} string" for c in columns.split(", ")))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        ORACLES[f.__name__] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in expected)}) v({columns})"
        return f

    return add


def kinds(found: list[Violation]) -> str:
    return ",".join(sorted({v.type for v in found})) or "pass"


# --- contract documents

ORDERS = """
inputs:
  - name: orders
    location: raw.orders
    format: table
    schema:
      fields:
        - {name: order_id, type: string, required: true, nullable: false}
        - {name: amount, type: decimal, required: true, nullable: false}
"""
DAILY = """
outputs:
  - name: daily
    location: gold.daily
    format: table
    saveMode: overwrite
    schema:
      fields:
        - {name: customer_id, type: string, required: true, nullable: false}
        - {name: total, type: decimal, required: true, nullable: false}
"""
HEAD = 'id: daily_totals\nversion: "1.0.0"\nstatus: active\n'
DOCUMENTS = {
    "whole": HEAD + ORDERS + DAILY + "rules:\n  - type: compatibility\n    mode: backward\nextensions:\n  owner: data-platform\n",
    "derived": HEAD + ORDERS + DAILY.replace("saveMode: overwrite", "derivedFrom: [orders]"),
    "derived_from_nothing": HEAD + ORDERS + DAILY.replace("saveMode: overwrite", "derivedFrom: [order]"),
    "catalog": HEAD + DAILY.replace("saveMode: overwrite", "catalog: {required: true, technology: hive, catalogName: spark_catalog, namespace: [default], table: daily}"),
    "catalog_without_required": HEAD + DAILY.replace("saveMode: overwrite", "catalog: {technology: hive}"),
    "custom_rule": HEAD + DAILY + "rules:\n  - type: forbid_full_scan\ncustomRuleTypes:\n  forbid_full_scan: acme.rules.ForbidFullScan\n",
    "no_id": 'version: "1.0.0"\n' + DAILY,
    "no_outputs": HEAD + ORDERS,
    "constraints": HEAD + DAILY.replace("nullable: false}\n        - {name: total", "nullable: false, constraints: [{type: oneOf, values: [a, b]}, {type: length, min: 1, max: 9}]}\n        - {name: total"),
    "constraint_without_bounds": HEAD + DAILY.replace("type: decimal, required", "constraints: [{type: range}], type: decimal, required"),
    "rules": HEAD + DAILY + "rules:\n  - {type: merge_condition, columns: [customer_id]}\n  - {type: forbid_cross_join}\n  - {type: required_group_by, columns: [customer_id]}\n",
    "rule_without_columns": HEAD + DAILY + "rules:\n  - {type: merge_condition, on: [customer_id]}\n",
    "field_twice": HEAD + DAILY.replace("name: total", "name: customer_id"),
    "unknown_type": HEAD + DAILY.replace("type: decimal", "type: variant"),
    "slips": (HEAD + DAILY).replace("saveMode", "savemode").replace("nullable: false}\n        - {name: total", "nulable: false}\n        - {name: total"),
    "unknown_format": HEAD + DAILY.replace("format: table", "format: parqet"),
    "csv": HEAD + DAILY.replace("format: table", "format: csv\n    csv: {sep: ';', header: true}"),
    "csv_unknown_option": HEAD + DAILY.replace("format: table", "format: csv\n    csv: {seperator: ';'}"),
    "not_yaml": "id: [",
    "a_list": "- 1",
    "fields_not_a_list": HEAD + "outputs:\n  - {name: o, location: l, schema: {fields: x}}\n",
}


@query(
    "document, verdict, said",
    [
        ("whole", "valid", ""),
        ("derived", "valid", ""),
        ("derived_from_nothing", "INVALID_CONTRACT", "output daily: derivedFrom order is no input"),
        ("catalog", "valid", ""),
        ("catalog_without_required", "INVALID_CONTRACT", "outputs[0].catalog: required is missing"),
        ("custom_rule", "valid", ""),
        ("no_id", "INVALID_CONTRACT", "contract: id is missing"),
        ("no_outputs", "INVALID_CONTRACT", "a contract needs an output"),
        ("constraints", "valid", ""),
        ("constraint_without_bounds", "INVALID_CONTRACT", "output daily: total: constraint range has missing or wrong bounds"),
        ("rules", "valid", ""),
        ("rule_without_columns", "INVALID_CONTRACT", "rule merge_condition needs a list of columns"),
        ("field_twice", "INVALID_CONTRACT", "output daily: field customer_id is declared twice"),
        ("unknown_type", "valid", "output daily: total: unknown type variant"),
        ("slips", "valid", "outputs[0].savemode: unknown key is ignored; did you mean saveMode?; outputs[0].schema.fields[0].nulable: unknown key is ignored; did you mean nullable?"),
        ("unknown_format", "valid", "output daily: format parqet is none of " + ", ".join(contract.FORMATS) + ", so it may not match on another engine; did you mean parquet?"),
        ("csv", "valid", ""),
        ("csv_unknown_option", "INVALID_CONTRACT", "outputs[0].csv: unknown option seperator"),
        ("not_yaml", "INVALID_CONTRACT", "not valid YAML"),
        ("a_list", "INVALID_CONTRACT", "contract: a mapping is expected, it is [1]"),
        ("fields_not_a_list", "INVALID_CONTRACT", "outputs[0].schema.fields: a list is expected, it is 'x'"),
    ],
)
def contract_documents(spark, d):
    """Documents of every shape: valid or not, with the first error, or all warnings; each valid one is written and read back."""
    for name, text in DOCUMENTS.items():
        try:
            c = contract.parse(text)
        except contract.ContractError as x:
            yield name, "INVALID_CONTRACT", str(x).partition(": while")[0]
            continue
        said = contract.validate(c)
        if bad := [m for level, m in said if level == "ERROR"]:
            yield name, "INVALID_CONTRACT", bad[0]
        else:
            same = contract.parse(contract.to_yaml(c)) == c
            yield name, "valid" if same else "changed by writing", "; ".join(m for _, m in [*said, *contract.unknown_keys(text)])


# --- statements

STATEMENTS = """
id: statements
version: 1.0.0
outputs:
  - name: kept
    location: default/KEPT
    saveMode: overwrite
    schema: {fields: [{name: id, type: long, required: true, nullable: true}, {name: v, type: string}]}
  - name: grown
    location: default/GROWN
    saveMode: append
  - {name: folder, location: '@/folder', format: csv, csv: {delimiter: ';', header: true}}
"""
VERDICTS = [
    ("SELECT * FROM KEPT", "pass"),
    ("INSERT OVERWRITE KEPT SELECT * FROM ROWS", "pass"),
    ("INSERT INTO KEPT SELECT * FROM ROWS", "OUTPUT_SAVE_MODE_MISMATCH"),
    ("INSERT INTO GROWN SELECT * FROM ROWS", "pass"),
    ("INSERT INTO OTHER SELECT * FROM ROWS", "OUTPUT_LOCATION_MISMATCH"),
    ("CREATE TABLE NEW USING parquet AS SELECT * FROM ROWS", "OUTPUT_LOCATION_MISMATCH"),
    ("INSERT OVERWRITE DIRECTORY '@/folder' USING csv OPTIONS (sep ';', header 'true') SELECT * FROM ROWS", "pass"),
    ("INSERT OVERWRITE DIRECTORY '@/folder' USING csv SELECT * FROM ROWS", "OUTPUT_CSV_OPTIONS_MISMATCH"),
    ("INSERT OVERWRITE DIRECTORY '@/else' USING csv SELECT * FROM ROWS", "OUTPUT_LOCATION_MISMATCH"),
    ("DELETE FROM OTHER WHERE id = 1", "OUTPUT_LOCATION_MISMATCH"),
    ("DELETE FROM KEPT WHERE id = 1", "pass"),
    ("UPDATE KEPT SET v = 'x'", "pass"),
    ("MERGE INTO OTHER USING ROWS ON OTHER.id = ROWS.id WHEN MATCHED THEN DELETE", "OUTPUT_LOCATION_MISMATCH"),
    ("LOAD DATA LOCAL INPATH '/nowhere' INTO TABLE KEPT", "UNVERIFIABLE_WRITE"),
    ("DROP TABLE KEPT", "pass"),
    ("DROP TABLE GROWN", "OUTPUT_SAVE_MODE_MISMATCH"),
    ("DROP TABLE OTHER", "UNVERIFIABLE_WRITE"),
    ("TRUNCATE TABLE KEPT", "pass"),
    ("TRUNCATE TABLE OTHER", "UNVERIFIABLE_WRITE"),
    ("ALTER TABLE PARTED DROP PARTITION (p = 'x')", "UNVERIFIABLE_WRITE"),
    ("ALTER TABLE PARTED ADD PARTITION (p = 'x')", "pass"),
    ("ALTER TABLE KEPT SET LOCATION '@/moved'", "UNVERIFIABLE_WRITE"),
    ("ALTER TABLE OTHER SET LOCATION '@/moved'", "pass"),
    ("ALTER TABLE KEPT RENAME TO NEW", "UNVERIFIABLE_WRITE"),
    ("ALTER TABLE OTHER RENAME TO NEW", "pass"),
    ("ALTER TABLE KEPT ADD COLUMNS (z INT)", "pass"),
    ("ALTER TABLE KEPT ADD COLUMNS (z INT) --strict", "UNDECLARED_OUTPUT_COLUMN"),
    ("ALTER TABLE KEPT CHANGE COLUMN v COMMENT 'x'", "pass"),
    ("DROP DATABASE default CASCADE", "UNVERIFIABLE_WRITE"),
    ("DROP VIEW ROWS", "pass"),
    ("CREATE OR REPLACE TEMP VIEW MORE AS SELECT 1 AS a", "pass"),
    ("CACHE TABLE NEW AS SELECT * FROM ROWS", "pass"),
    ("ANALYZE TABLE KEPT COMPUTE STATISTICS", "pass"),
    ("SHOW TABLES", "pass"),
    ("SET a.b = c", "pass"),
]


@query("statement, verdict", VERDICTS)
def command_verdicts(spark, d):
    """What a guarded session says to each statement: analyzed as it would be, judged, not run."""
    base = folder(spark, "statements")
    tag = base.rpartition("-")[2][:12]
    names = {x: f"{x.lower()}_{tag}" for x in ("KEPT", "GROWN", "OTHER", "PARTED", "ROWS", "NEW", "MORE")}

    def named(text: str) -> str:
        for k, v in names.items():
            text = text.replace(k, v)
        return text.replace("@", base.removeprefix("file://"))

    tables = [x for x in names if x in ("KEPT", "GROWN", "OTHER", "PARTED")]
    c = contract.parse(named(STATEMENTS))
    try:
        for x in tables:
            shape = "(id BIGINT, p STRING) USING parquet PARTITIONED BY (p)" if x == "PARTED" else "(id BIGINT, v STRING) USING parquet"
            spark.sql(f"CREATE TABLE {names[x]} {shape} LOCATION '{base}/{names[x]}'")
        spark.range(2).selectExpr("id", "'a' AS v").createOrReplaceTempView(names["ROWS"])
        return [(said, kinds(judge_command(analyze_sql(spark, named(said.removesuffix(" --strict"))), c, {"rejectUndeclaredFields": said.endswith("--strict")}))) for said, _ in VERDICTS]
    finally:
        spark.catalog.dropTempView(names["ROWS"])
        for x in tables:
            spark.sql(f"DROP TABLE IF EXISTS {names[x]}")


# --- rules

BASE = """
id: rules
version: 1.0.0
inputs:
  - {name: orders, location: DIR/orders.parquet, format: parquet}
outputs:
  - {name: out, location: out/orders, format: parquet, schema: {fields: [{name: o_orderkey, type: long, required: true, nullable: true}]}}
"""


def _with_rule(d: str, kind: str, columns: str = "") -> contract.Contract:
    return contract.parse(BASE.replace("DIR", d) + f"rules: [{{type: {kind}{', columns: [' + columns + ']' if columns else ''}}}]\n")


@query(
    "rule, job, verdict",
    [
        ("required_group_by", "by key", "pass"),
        ("required_group_by", "by another", "RULE_REQUIRED_GROUP_BY_VIOLATION"),
        ("required_group_by", "not grouped", "RULE_REQUIRED_GROUP_BY_VIOLATION"),
        ("forbid_cross_join", "keyed", "pass"),
        ("forbid_cross_join", "crossed", "RULE_CROSS_JOIN_VIOLATION"),
        ("forbid_cross_join", "theta", "pass"),
        ("required_join_columns", "keyed", "pass"),
        ("required_join_columns", "either key", "RULE_REQUIRED_JOIN_COLUMNS_VIOLATION"),
        ("required_join_columns", "theta", "RULE_REQUIRED_JOIN_COLUMNS_VIOLATION"),
        ("required_filter_columns", "filtered", "pass"),
        ("required_filter_columns", "filtered before a join", "pass"),
        ("required_filter_columns", "not filtered", "RULE_REQUIRED_FILTER_COLUMNS_VIOLATION"),
    ],
)
def plan_rule_verdicts(spark, d):
    """The four rules on a plan's shape, each met and broken."""
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    key, cust = F.col("o_custkey") == F.col("c_custkey"), F.col("c_custkey") > F.col("o_orderkey")
    grouped = lambda k: o.groupBy(k).agg(F.max("o_orderkey").alias("o_orderkey"))
    pick = lambda df: df.select("o_orderkey")
    cases = [
        ("required_group_by", "o_custkey", [("by key", grouped("o_custkey")), ("by another", grouped("o_orderstatus")), ("not grouped", pick(o))]),
        ("forbid_cross_join", "", [("keyed", pick(o.join(c, key))), ("crossed", pick(o.crossJoin(c))), ("theta", pick(o.join(c, cust)))]),
        ("required_join_columns", "o_custkey, c_custkey", [("keyed", pick(o.join(c, key & cust))), ("either key", pick(o.join(c, key | cust))), ("theta", pick(o.join(c, cust)))]),
        ("required_filter_columns", "o_orderstatus", [("filtered", pick(o.where("o_orderstatus = 'F'"))), ("filtered before a join", pick(o.where("o_orderstatus <> 'F'").join(c, key))), ("not filtered", pick(o))]),
    ]
    for kind, columns, jobs in cases:
        rule = _with_rule(d, kind, columns)
        for job, df in jobs:
            yield kind, job, kinds(findings(df, rule, "out", location="out/orders"))


class KeepsRecent:
    """An example of a rule of one's own: a delete must say which days it removes."""

    def applies_to(self, kind: str) -> bool:
        return kind == "delete"

    def verify(self, rule: dict, mutation: dict) -> list[Violation]:
        columns = [x.name for x in mutation["condition"].columns()] if mutation["condition"] else []
        return [] if rule["column"] in columns else [Violation("RULE_UNCONDITIONAL_DELETE", f"the delete does not filter by {rule['column']}", rule["column"])]


MUTATIONS = [
    ("merge_condition", "id", "MERGE INTO TARGET USING ORIGIN ON TARGET.id = ORIGIN.id WHEN MATCHED THEN UPDATE SET v = ORIGIN.v", "pass"),
    ("merge_condition", "id", "MERGE INTO TARGET USING ORIGIN ON TARGET.v = ORIGIN.v WHEN MATCHED THEN UPDATE SET v = ORIGIN.v", "RULE_MERGE_CONDITION_VIOLATION"),
    ("merge_condition", "id", "DELETE FROM TARGET", "pass"),
    ("forbid_unconditional_delete", "", "DELETE FROM TARGET", "RULE_UNCONDITIONAL_DELETE"),
    ("forbid_unconditional_delete", "", "DELETE FROM TARGET WHERE true", "RULE_UNCONDITIONAL_DELETE"),
    ("forbid_unconditional_delete", "", "DELETE FROM TARGET WHERE id > 5", "pass"),
    ("allowed_update_columns", "v", "UPDATE TARGET SET v = 'x' WHERE id = 1", "pass"),
    ("allowed_update_columns", "v", "UPDATE TARGET SET id = 2", "RULE_DISALLOWED_UPDATE_COLUMN"),
    ("allowed_update_columns", "v", "MERGE INTO TARGET USING ORIGIN ON TARGET.id = ORIGIN.id WHEN MATCHED THEN UPDATE SET id = ORIGIN.id", "RULE_DISALLOWED_UPDATE_COLUMN"),
    ("keeps_recent", "", "DELETE FROM TARGET WHERE v = 'x'", "RULE_UNCONDITIONAL_DELETE"),
    ("keeps_recent", "", "DELETE FROM TARGET WHERE id > 5", "pass"),
    ("keeps_recent", "", "UPDATE TARGET SET v = 'x'", "pass"),
]


@query("rule, statement, verdict", [(r, s, v) for r, _, s, v in MUTATIONS])
def dml_rule_verdicts(spark, d):
    """The three rules on row mutations and one of the job's own, on analyzed statements."""
    base = folder(spark, "mutations")
    tag = base.rpartition("-")[2][:12]
    try:
        for x in ("T", "S"):
            spark.sql(f"CREATE TABLE {x.lower()}_{tag} (id BIGINT, v STRING) USING parquet LOCATION '{base}/{x}'")
        out = []
        for kind, columns, said, _ in MUTATIONS:
            more = ", column: id" if kind == "keeps_recent" else f", columns: [{columns}]" if columns else ""
            text = f"id: m\noutputs: [{{name: t, location: 'default/t_{tag}'}}]\nrules: [{{type: {kind}{more}}}]\ncustomRuleTypes: {{keeps_recent: {__name__}.KeepsRecent}}\n"
            sql = said.replace("TARGET", f"t_{tag}").replace("ORIGIN", f"s_{tag}")
            out.append((kind, said, kinds(judge_command(analyze_sql(spark, sql), contract.parse(text)))))
        return out
    finally:
        for x in ("t", "s"):
            spark.sql(f"DROP TABLE IF EXISTS {x}_{tag}")


# --- policies

GOVERNED = """
id: sales
version: 1.0.0
inputs:
  - {name: raw, location: orders, type: SOURCE, schema: {fields: [{name: order_id, type: string}, {name: Email, type: string, sensitivityTags: [pii]}]}}
  - {name: marks, location: /ops/marks, type: CONTROL, schema: {fields: [{name: run_id, type: string}, {name: who, type: string, sensitivityTags: [PII]}]}}
outputs:
  - {name: daily, location: /gold/daily, format: csv, description: totals by day, type: DATA_ASSET, catalog: {required: true, technology: hive}, schema: {fields: [{name: day, type: date}]}}
  - {name: calendar, location: /ops/calendar, format: delta, schema: {fields: [{name: day, type: date}]}}
extensions: {owner: finance, status: deprecated}
"""
POLICY = """
version: "1.0"
policies:
  - {id: p01, type: require_catalog, scope: outputs, technology: hive}
  - {id: p02, type: require_field, name: day, fieldType: date, scope: outputs}
  - {id: p03, type: require_field, name: loaded_at}
  - {id: p04, type: field_naming_convention, pattern: "[a-z_]+"}
  - {id: p05, type: require_extension, key: owner}
  - {id: p06, type: require_extension, key: owner, value: sales}
  - {id: p07, type: require_format, formats: [delta, iceberg], scope: outputs}
  - {id: p08, type: require_dataset_description, scope: outputs, mode: warn}
  - {id: p09, type: require_extension_if, ifKey: status, ifValue: deprecated, thenKey: sunset}
  - {id: p10, type: require_extension_if, ifKey: status, ifValue: active, thenKey: sunset}
  - {id: p11, type: require_dataset_type}
  - {id: p12, type: require_dataset_type, types: [DATA_ASSET, CONTROL], scope: inputs}
  - {id: p13, type: forbid_control_sensitivity_tags}
  - {id: p14, type: require_control_registration}
  - {id: p15, type: require_registered_control_type}
  - {id: p16, type: require_absolute_location}
  - {id: p17, type: require_catalog, when: {sensitivityTag: pii}}
  - {id: p18, type: require_format, formats: [parquet], scope: inputs}
exemptions:
  - {contractId: sales, policyIds: [p17], reason: moving, reviewBy: "2030-01-01"}
  - {contractId: sales, policyIds: [p03], reason: late, reviewBy: "2020-01-01"}
  - {contractId: other, policyIds: [p06], reason: another contract}
controlTables:
  - {location: /ops/marks, owner: platform, requiredFields: [run_id, watermark]}
  - {location: /ops/calendar, owner: platform}
inject:
  rules: [{type: forbid_cross_join}]
  minVerificationOptions: {rejectUndeclaredFields: true}
"""


@query(
    "policy, type, mode, dataset",
    [
        ("p01", "require_catalog", "enforce", "calendar"),
        ("p03", "require_field", "enforce", "raw"),
        ("p03", "require_field", "enforce", "marks"),
        ("p03", "require_field", "enforce", "daily"),
        ("p03", "require_field", "enforce", "calendar"),
        ("p04", "field_naming_convention", "enforce", "raw"),
        ("p06", "require_extension", "enforce", None),
        ("p07", "require_format", "enforce", "daily"),
        ("p08", "require_dataset_description", "warn", "calendar"),
        ("p09", "require_extension_if", "enforce", None),
        ("p11", "require_dataset_type", "enforce", "calendar"),
        ("p12", "require_dataset_type", "enforce", "raw"),
        ("p13", "forbid_control_sensitivity_tags", "enforce", "marks"),
        ("p14", "require_control_registration", "enforce", "marks"),
        ("p15", "require_registered_control_type", "enforce", "calendar"),
        ("p16", "require_absolute_location", "enforce", "raw"),
        ("p18", "require_format", "enforce", "raw"),
        ("p18", "require_format", "enforce", "marks"),
    ],
)
def org_policy_types(spark, d):
    """Every type of policy on one contract: conditions, exemptions with and without their date past, control tables."""
    found = policy.evaluate(contract.parse(GOVERNED), policy.parse_policy(POLICY), date(2026, 1, 1))
    return [(f.rule, f.type, f.mode, f.dataset) for f in found]


POLICY_DOCUMENTS = {
    "sound": POLICY,
    "pattern": 'version: "1.0"\npolicies: [{id: a, type: field_naming_convention, pattern: "[a-z"}]',
    "same id": 'version: "1.0"\npolicies: [{id: a, type: require_catalog}, {id: a, type: require_dataset_type}]',
    "bad date": 'version: "1.0"\nexemptions: [{contractId: c, policyIds: [x], reason: r, reviewBy: soon}]',
    "exempt from nothing": 'version: "1.0"\npolicies: [{id: a, type: require_catalog}]\nexemptions: [{contractId: c, policyIds: [b], reason: r}]',
    "no field name": 'version: "1.0"\npolicies: [{id: a, type: require_field}]',
    "no version": "policies: [{id: a, type: require_catalog}]",
    "no id": 'version: "1.0"\npolicies: [{type: require_catalog}]',
    "no type": 'version: "1.0"\npolicies: [{id: a}]',
    "custom": 'version: "1.0"\npolicies: [{id: a, type: lower_case}]\ncustomPolicyTypes: {lower_case: acme.LowerCase}',
    "unknown type": 'version: "1.0"\npolicies: [{id: a, type: lower_case}]',
    "scope": 'version: "1.0"\npolicies: [{id: a, type: require_catalog, scope: everywhere}]',
}


@query(
    "document, said",
    [
        ("sound", ""),
        ("pattern", "ERROR policy a: field_naming_convention has missing or wrong properties"),
        ("same id", "ERROR policy a is declared twice"),
        ("bad date", "exemptions[0].reviewBy: 'soon' is no date of the form 2030-12-31"),
        ("exempt from nothing", "ERROR exemption of c: no policy b"),
        ("no field name", "ERROR policy a: require_field has missing or wrong properties"),
        ("no version", "policy: version is missing"),
        ("no id", "policies[0]: id is missing"),
        ("no type", "policies[0]: type is missing"),
        ("custom", ""),
        ("unknown type", "WARNING policy a: nothing checks type lower_case"),
        ("scope", "policies[0].scope: 'everywhere' is none of inputs, outputs, all"),
    ],
)
def org_policy_documents(spark, d):
    """Policy documents: what is wrong with the document itself."""
    for name, text in POLICY_DOCUMENTS.items():
        try:
            yield name, "; ".join(f"{level} {m}" for level, m in policy.validate_policy(policy.parse_policy(text)))
        except policy.PolicyError as x:
            yield name, str(x).removeprefix("policy.")


# --- kinds of findings that need a job of their own


@query(
    "finding, verdict",
    [
        ("INPUT_CATALOG_MISMATCH", "INPUT_CATALOG_MISMATCH"),
        ("INPUT_FIELD_NULLABILITY_MISMATCH", "INPUT_FIELD_NULLABILITY_MISMATCH"),
        ("INPUT_FIELD_TYPE_MISMATCH", "INPUT_FIELD_TYPE_MISMATCH"),
        ("MISSING_INPUT_CATALOG_REGISTRATION", "MISSING_INPUT_CATALOG_REGISTRATION"),
        ("MISSING_INPUT_FIELD", "MISSING_INPUT_FIELD"),
        ("MISSING_OUTPUT", "MISSING_OUTPUT"),
        ("ORG_POLICY_VIOLATION", "ORG_POLICY_VIOLATION"),
        ("RULE_UNVERIFIABLE_DML", "RULE_UNVERIFIABLE_DML"),
        ("UNDECLARED_INPUT_COLUMN", "UNDECLARED_INPUT_COLUMN"),
        ("UNGOVERNED_DATA_ACCESS", "UNGOVERNED_DATA_ACCESS"),
        ("UNSUPPORTED_CONTRACT_FEATURE", "UNSUPPORTED_CONTRACT_FEATURE"),
    ],
)
def finding_kinds(spark, d):
    """Findings that the scenarios do not raise, each by a job that is right but for one thing."""
    o = t(spark, d, "orders").select("o_orderkey")
    text = BASE.replace("DIR", d)
    reads = lambda fields: text.replace("format: parquet}\n", f"format: parquet, schema: {{fields: [{fields}]}}}}\n", 1)
    registered = text.replace("format: parquet}\n", "format: parquet, catalog: {required: true, table: orders}}\n", 1)
    plan = translate(o)[0]
    listed_ = Write(plan, columns_of(o.schema), "out/orders")
    found = lambda c, **how: kinds(findings(o, c, "out", location="out/orders", **how))
    read = next(p for p in checks.facts(plan)["read"])
    read.info["catalog"] = {"table": "other"}
    yield "INPUT_CATALOG_MISMATCH", kinds(verify(listed_, contract.parse(registered)))
    read.info["catalog"] = None
    yield "INPUT_FIELD_NULLABILITY_MISMATCH", found(reads("{name: o_orderkey, type: long, nullable: false}"))
    yield "INPUT_FIELD_TYPE_MISMATCH", found(reads("{name: o_orderkey, type: string}"))
    yield "MISSING_INPUT_CATALOG_REGISTRATION", found(registered)
    yield "MISSING_INPUT_FIELD", found(reads("{name: o_key, type: long, required: true, nullable: true}"))
    yield "MISSING_OUTPUT", kinds(missing_outputs(contract.parse(text), ["out/else"]))
    yield "ORG_POLICY_VIOLATION", found(text, policies=policy.parse_policy('version: "1"\npolicies: [{id: a, type: require_catalog, scope: outputs}]'))
    blind = {"kind": "merge", "condition": None, "updated": (), "understood": False}
    yield "RULE_UNVERIFIABLE_DML", found(_with_rule(d, "merge_condition", "o_orderkey"), mutation=blind)
    yield "UNDECLARED_INPUT_COLUMN", found(reads("{name: o_orderkey, type: long}"), rejectUndeclaredFields=True)
    yield "UNGOVERNED_DATA_ACCESS", kinds(services.ungoverned("import pandas as pd\nx = pd.read_csv('a.csv')\n", "job.py"))
    yield "UNSUPPORTED_CONTRACT_FEATURE", found(text, capabilities={"check.format": ("unsupported", "not built")})


# --- lineage across points that cut it


@query(
    "frame, output, source",
    [
        ("cached", "key", "orders.parquet.o_orderkey"),
        ("checkpointed", "key", "orders.parquet.o_orderkey"),
        ("checkpointed twice", "name", "customer.parquet.c_name"),
        ("made by hand", "key", ""),
    ],
)
def lineage_boundaries(spark, d):
    """A cached or checkpointed frame still says where its columns come from; one made by hand comes from nowhere known."""
    checkpoints(spark)
    o = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"), "o_custkey")
    cached = o.persist()
    cut = boundaries.checkpoint(o)
    twice = boundaries.checkpoint(cut.join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")))
    frames = {"cached": cached.select("key"), "checkpointed": cut.select("key"), "checkpointed twice": twice.select(F.col("c_name").alias("name")), "made by hand": spark.createDataFrame([(1,)], "key long")}
    out = [(name, c.output, ",".join(s.rpartition("/")[2] for s in sorted(c.sources))) for name, df in frames.items() for c in lineage(translate(df)[0])]
    cached.unpersist()
    return out


# --- the scenarios that engine_queries does not run

SCENARIO = """
id: scenario
version: 1.0.0
inputs:
  - {name: orders, location: DIR/orders.parquet, format: parquet, schema: {fields: [{name: o_orderkey, type: long, sensitivityTags: [key]}, {name: o_totalprice, type: double, sensitivityTags: [financial]}]}}
outputs:
  - {name: out, location: out/report, format: parquet, saveMode: overwrite, schema: {fields: [{name: id, type: long, required: true, nullable: true}, {name: total, type: double, required: true, nullable: true}]}}
"""
CUSTOMERS = "  - {name: customers, location: DIR/customer.parquet, format: parquet}\n"
TWO = SCENARIO.replace("outputs:", CUSTOMERS + "outputs:").replace("saveMode: overwrite", "saveMode: overwrite, derivedFrom: [FROM]")
TWO += "  - {name: audit, location: out/audit, format: parquet, derivedFrom: [customers]}\n"
MORE = [
    ("extended-type-not-produced", "OUTPUT_FIELD_TYPE_MISMATCH"),
    ("row-level-delete-checked-as-write", "OUTPUT_LOCATION_MISMATCH"),
    ("row-level-delete-own-table-is-not-an-input", "pass"),
    ("filtered-delete-allowed", "pass"),
    ("derived-from-rejects-a-read-of-another-outputs-source", "UNDECLARED_INPUT"),
    ("an-undeclared-second-write-is-blocked", "pass pass MISSING_INPUT,OUTPUT_LOCATION_MISMATCH"),
    ("declared-output-never-written", "MISSING_OUTPUT"),
    ("unrecognized-step-keeps-the-reads-beneath-it-visible", "pass"),
    ("unrecognized-step-does-not-hide-an-undeclared-read", "UNDECLARED_INPUT"),
    ("rejoining-branches-keep-the-read-beneath-them-visible", "pass"),
    ("rejoining-branches-do-not-hide-an-undeclared-read", "UNDECLARED_INPUT"),
    ("output-format-matches", "pass"),
    ("output-save-mode-matches", "pass"),
    ("csv-input-options-mismatch", "INPUT_CSV_OPTIONS_MISMATCH"),
    ("fingerprint-flags-nothing-for-a-deterministic-job", "pass flagged:"),
    ("fingerprint-flags-a-generated-id", "pass flagged:token"),
    ("static-data-quality-cannot-prove-a-passthrough", "pass id:NotGuaranteed total:Guaranteed"),
    ("role-source-contributing-conforms", "pass"),
    ("lineage-passthrough-cast-and-constant", "pass id<-o_orderkey price<-o_totalprice total<-"),
    ("lineage-through-join-and-filter", "pass id<-o_orderkey segment<-c_mktsegment total<-"),
    ("sensitivity-follows-a-cast", "pass id:key text:financial total:"),
    ("boundary-filter-is-seen-through", "pass"),
    ("boundary-does-not-excuse-a-missing-input", "MISSING_INPUT"),
    ("streaming-write-is-checked-like-a-batch-write", "pass"),
    ("streaming-write-to-the-wrong-location", "OUTPUT_LOCATION_MISMATCH"),
    ("untranslatable-write-fails-closed", "UNVERIFIABLE_WRITE"),
    ("input-format-matches", "pass"),
    ("contract-from-registry", "pass"),
    ("contract-from-registry-enforced", "OUTPUT_LOCATION_MISMATCH"),
    ("contract-not-in-registry", "stopped"),
    ("locations-from-map", "pass"),
    ("locations-from-map-enforced", "OUTPUT_LOCATION_MISMATCH"),
    ("locations-from-service", "pass"),
    ("location-not-in-service", "stopped"),
]


class _Service:
    """A service on this machine that answers GET from a dict of paths, for as long as a block lasts."""

    def __init__(self, answers: dict[str, str]):
        class Answer(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                body = answers.get(self.path)
                self.send_response(404 if body is None else 200)
                self.end_headers()
                self.wfile.write((body or "").encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)

    def __enter__(self) -> str:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return f"http://127.0.0.1:{self.server.server_port}"

    def __exit__(self, *_):
        self.server.shutdown()
        self.server.server_close()


def _governance(d, judged) -> dict[str, str]:
    """Scenarios on where the contract and its locations come from."""
    text, out = SCENARIO.replace("DIR", d), {}

    def stopped(f):
        try:
            return f()
        except services.NotResolved:
            return "stopped"

    with _Service({"/contracts/scenario/versions/1.0.0": text}) as url:
        got = services.load("registry://scenario@1.0.0", url)
        out["contract-from-registry"] = judged(got)
        out["contract-from-registry-enforced"] = judged(got, location="out/else")
        out["contract-not-in-registry"] = stopped(lambda: judged(services.load("registry://scenario@9.0.0", url)))
    refs = contract.parse(text.replace("location: out/report", "location: 'ref://report'"))
    mapped = services.resolve_locations(refs, {"report": "/data/out/report"})
    out["locations-from-map"] = judged(mapped, location="/data/out/report")
    out["locations-from-map-enforced"] = judged(mapped, location="/data/out/else")
    with _Service({"/report": json.dumps({"location": "/data/out/report"})}) as url:
        out["locations-from-service"] = judged(services.resolve_locations(refs, url), location="/data/out/report")
        other = contract.parse(text.replace("location: out/report", "location: 'ref://unknown'"))
        out["location-not-in-service"] = stopped(lambda: judged(services.resolve_locations(other, url)))
    return out


@query("scenario, verdict", MORE)
def scenario_verdicts_more(spark, d):
    """The other 34 scenarios; where one asserts an analysis, its result follows the verdict."""
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    text = SCENARIO.replace("DIR", d)
    job = o.select(F.col("o_orderkey").alias("id"), F.lit(1.0).alias("total"))
    how = dict(location="out/report", format="parquet", mode="overwrite")
    key = F.col("o_custkey") == F.col("c_custkey")
    joined = o.join(c, key).select(F.col("o_orderkey").alias("id"), F.lit(1.0).alias("total"))
    judged = lambda contract_, df=job, **more: kinds(findings(df, contract_, "out", **how | more))
    strict = {"rejectUndeclaredInputs": True}
    out = _governance(d, judged)
    field = lambda extra: text.replace("{name: total, type: double, required: true, nullable: true}", extra)
    out["extended-type-not-produced"] = judged(field("{name: total, type: interval, required: true, nullable: true}"))
    delete = lambda where, contract_, **more: kinds(judge_command(analyze_sql(spark, f"DELETE FROM parquet.`{d}/orders.parquet` WHERE {where}"), contract.parse(contract_), more))
    own = f"id: own\noutputs: [{{name: o, location: {d}/orders.parquet}}]\n"
    guarded = own + "rules: [{type: forbid_unconditional_delete}]\n"
    out["row-level-delete-checked-as-write"] = delete("o_orderkey = 1", own.replace("orders.parquet", "declared"))
    out["row-level-delete-own-table-is-not-an-input"] = delete("o_orderkey = 1", own, **strict)
    out["filtered-delete-allowed"] = delete("o_orderkey = 1", guarded)
    two = TWO.replace("DIR", d)
    out["derived-from-rejects-a-read-of-another-outputs-source"] = judged(two.replace("FROM", "orders"), joined, **strict)
    stray = findings(c.select("c_custkey"), two.replace("FROM", "orders"), "stray", location="out/stray")
    audit = findings(c.select("c_custkey"), two.replace("FROM", "orders"), "audit", location="out/audit", format="parquet")
    out["an-undeclared-second-write-is-blocked"] = f"{judged(two.replace('FROM', 'orders'))} {kinds(audit)} {kinds(stray)}"
    out["declared-output-never-written"] = kinds(missing_outputs(contract.parse(two.replace("FROM", "orders")), ["/x/out/report"]))
    opaque = lambda df: df.mapInPandas(lambda it: it, df.schema)
    out["unrecognized-step-keeps-the-reads-beneath-it-visible"] = judged(text, opaque(job))
    out["unrecognized-step-does-not-hide-an-undeclared-read"] = judged(text, opaque(joined), **strict)

    def rejoined(df):
        for _ in range(6):
            df = df.where("id > 0").unionAll(df.where("id <= 0"))
        return df

    out["rejoining-branches-keep-the-read-beneath-them-visible"] = judged(text, rejoined(job))
    out["rejoining-branches-do-not-hide-an-undeclared-read"] = judged(text, rejoined(joined), **strict)
    out["output-format-matches"] = out["output-save-mode-matches"] = out["input-format-matches"] = judged(text)
    place = folder(spark, "layout")
    o.limit(3).write.option("header", "true").csv(place)
    laid = text.replace(f"{d}/orders.parquet, format: parquet", f"'{place}', format: csv, csv: {{delimiter: ';', header: true}}")
    laid = laid.replace("name: o_totalprice, type: double", "name: o_totalprice, type: string").replace("name: o_orderkey, type: long", "name: o_orderkey, type: string")
    read = spark.read.option("header", "true").csv(place).select(F.col("o_orderkey").cast("long").alias("id"), F.lit(1.0).alias("total"))
    out["csv-input-options-mismatch"] = judged(laid, read)
    wild = lambda df: ",".join(sorted(k for k, v in fingerprint(translate(df)[0]).nondeterministic.items() if v))
    token = job.withColumn("token", F.uuid())
    out["fingerprint-flags-nothing-for-a-deterministic-job"] = f"{judged(text, computeFingerprint=True)} flagged:{wild(job)}"
    out["fingerprint-flags-a-generated-id"] = f"{judged(text, token, computeFingerprint=True)} flagged:{wild(token)}"
    quality = text.replace("{name: id, type: long, required: true, nullable: true}", "{name: id, type: long, required: true, nullable: true, constraints: [{type: range, gte: 0}]}")
    quality = quality.replace("{name: total, type: double, required: true, nullable: true}", "{name: total, type: double, required: true}")
    parsed = contract.parse(quality)
    said = checks.static_quality(translate(job)[0], parsed.outputs[0], parsed)
    out["static-data-quality-cannot-prove-a-passthrough"] = f"{judged(quality, staticDataQuality=True)} " + " ".join(f"{n}:{v}" for n, _, v in said)
    out["role-source-contributing-conforms"] = judged(text.replace("format: parquet, schema", "format: parquet, type: SOURCE, schema", 1), roleConsistency=True)
    from_ = lambda df: " ".join(f"{x.output}<-{','.join(s.rpartition('.')[2] for s in sorted(x.sources))}" for x in lineage(translate(df)[0]))
    cast = o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("string").alias("price"), F.lit(1.0).alias("total"))
    segment = o.where("o_totalprice > 0").join(c, key).select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.lit(1.0).alias("total"))
    out["lineage-passthrough-cast-and-constant"] = f"{judged(text, cast)} {from_(cast)}"
    out["lineage-through-join-and-filter"] = f"{judged(TWO.replace('DIR', d).replace('FROM', 'orders, customers'), segment)} {from_(segment)}"
    texted = o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("string").alias("text"), F.lit(1.0).alias("total"))
    tags = checks.tags_of(translate(texted)[0], contract.parse(text))
    got = sensitivity(translate(texted)[0], tags)
    out["sensitivity-follows-a-cast"] = f"{judged(text, texted)} " + " ".join(f"{k}:{','.join(sorted(v))}" for k, v in got.items())
    checkpoints(spark)
    filtered = o.where("o_totalprice > 10").select(F.col("o_orderkey").alias("id"), F.lit(1.0).alias("total"))
    cut = boundaries.checkpoint(filtered)
    out["boundary-filter-is-seen-through"] = judged(text + "rules: [{type: required_filter_columns, columns: [o_totalprice]}]\n", cut, **strict)
    out["boundary-does-not-excuse-a-missing-input"] = judged(text.replace("outputs:", CUSTOMERS.replace("DIR", d) + "outputs:"), cut)
    stream = spark.readStream.schema(o.schema).option("pathGlobFilter", "orders.parquet").parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.lit(1.0).alias("total"))
    at = lambda where: kinds(verify(Write(translate(stream)[0], columns_of(stream.schema), where, "parquet"), contract.parse(text)))
    out["streaming-write-is-checked-like-a-batch-write"], out["streaming-write-to-the-wrong-location"] = at("out/report"), at("out/else")
    out["untranslatable-write-fails-closed"] = kinds(judge_command(analyze_sql(spark, "DROP DATABASE default CASCADE"), contract.parse(text)))
    return [(name, out[name]) for name, _ in MORE]
