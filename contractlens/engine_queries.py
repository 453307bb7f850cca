"""Queries of the engine's own subjects: data checks, plan analyses, verdicts, governance, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import checks, contract
from .contract import Constraint, Field
from .enforce import findings, guarded_batches, infer
from .operators import quality
from .plans.analysis import fingerprint, lineage, properties, sensitivity
from .plans.catalyst import translate
from .queries import t
from .streaming.drain import drain, folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(columns: str, rows: list[tuple]) -> str:
    """An oracle worked out by hand: a VALUES list."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({columns})"


def frame(spark, columns: str, rows: list[tuple]):
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} string" for c in columns.split(", ")))


# --- data checks


@query("SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS \"column\", unnest([count(*) FILTER (o_orderkey IS NULL), count(*) FILTER (o_custkey IS NULL), count(*) FILTER (o_orderstatus IS NULL), count(*) FILTER (o_totalprice IS NULL), count(*) FILTER (o_orderdate IS NULL), count(*) FILTER (o_orderpriority IS NULL)]) AS nulls FROM orders")
def dq_null_counts(spark, d):
    return quality.null_counts(t(spark, d, "orders"))


def _one(name, table, column, kind, spec, where):
    QUERIES[name] = lambda spark, d: quality.report(t(spark, d, table), [Field(column, constraints=(Constraint(kind, spec),))]).select("column", "check", "failed", "total")
    ORACLES[name] = f"SELECT '{column}' AS \"column\", '{kind}' AS \"check\", count(*) FILTER ({column} IS NOT NULL AND {where}) AS failed, count(*) AS total FROM {table}"


_one("dq_equals", "orders", "o_orderstatus", "equals", {"value": "F"}, "o_orderstatus <> 'F'")
_one("dq_one_of", "customer", "c_mktsegment", "oneOf", {"value": ["BUILDING", "MACHINERY"]}, "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
_one("dq_range", "lineitem", "l_discount", "range", {"gte": 0.01, "lt": 0.08}, "(l_discount < 0.01 OR l_discount >= 0.08)")
_one("dq_length", "nation", "n_name", "length", {"min": 5, "max": 8}, "length(n_name) NOT BETWEEN 5 AND 8")
_one("dq_field_range", "lineitem", "l_tax", "fieldRange", {"lte": "l_discount"}, "l_tax > l_discount")
_one("dq_equals_other_kind", "orders", "o_custkey", "equals", {"value": "1"}, "true")


@query("""SELECT 'l_discount' AS "column", 'range' AS "check", count(*) FILTER (l_discount > 0.05) AS failed, count(*) AS total FROM lineitem
  UNION ALL SELECT 'l_tax', 'fieldRange', count(*) FILTER (l_tax > l_discount), count(*) FROM lineitem
  UNION ALL SELECT 'l_returnflag', 'oneOf', count(*) FILTER (l_returnflag NOT IN ('A', 'N')), count(*) FROM lineitem
  UNION ALL SELECT 'l_returnflag', 'notNull', count(*) FILTER (l_returnflag IS NULL), count(*) FROM lineitem""")
def dq_report_all(spark, d):
    fields = [Field("l_discount", constraints=(Constraint("range", {"lte": 0.05}),)), Field("l_tax", constraints=(Constraint("fieldRange", {"lte": "l_discount"}),)), Field("l_returnflag", nullable=False, constraints=(Constraint("oneOf", {"value": ["A", "N"]}),))]
    return quality.report(t(spark, d, "lineitem"), fields).select("column", "check", "failed", "total")


@query("SELECT DISTINCT l_quantity AS value FROM lineitem WHERE l_quantity > 40 ORDER BY 1 LIMIT 5")
def dq_examples(spark, d):
    return quality.failing_examples(t(spark, d, "lineitem"), "l_quantity", Constraint("range", {"lte": 40}))


# --- plan analyses


def _revenue(spark, d):
    j = t(spark, d, "orders").where(F.col("o_orderstatus") == "F").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("revenue"), F.max(F.lit(1)).alias("one"))


def _tail(s: str) -> str:
    return ".".join(s.rpartition("/")[2].split(".")[::2]) if ".parquet." in s else s


def _lineage(spark, df):
    rows = [(c.output, ",".join(sorted(_tail(s) for s in c.sources)), c.derivation, ",".join(sorted(c.aggregations))) for c in lineage(translate(df)[0])]
    return frame(spark, "output, sources, derivation, aggregations", rows)


@query(values("output, sources, derivation, aggregations", [("key", "orders.o_orderkey", "Direct", ""), ("price", "orders.o_totalprice", "Computed", ""), ("tag", "", "Constant", "")]))
def lineage_report(spark, d):
    return _lineage(spark, t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_totalprice") * 2).alias("price"), F.lit("x").alias("tag")))


@query(values("output, sources, derivation, aggregations", [("c_nationkey", "customer.c_nationkey", "Direct", ""), ("revenue", "orders.o_totalprice", "Computed", "SUM"), ("one", "", "Computed", "MAX")]))
def lineage_join(spark, d):
    return _lineage(spark, _revenue(spark, d))


@query(values("output, tags", [("name", "pii"), ("bal", ""), ("both", "pii,secret")]))
def sensitivity_report(spark, d):
    c = t(spark, d, "customer")
    df = c.select(F.upper("c_name").alias("name"), F.col("c_acctbal").cast("string").alias("bal"), F.concat("c_name", "c_mktsegment").alias("both"))
    plan, _ = translate(df)
    where = next(iter(lineage(plan)[1].sources)).rpartition(".")[0]
    got = sensitivity(plan, {f"{where}.c_name": {"pii"}, f"{where}.c_mktsegment": {"secret"}})
    return frame(spark, "output, tags", [(k, ",".join(sorted(v))) for k, v in got.items()])


CONTROL = """
id: roles
inputs:
  - {name: orders, location: DIR/orders.parquet, type: SOURCE}
  - {name: customer, location: DIR/customer.parquet, type: CONTROL}
outputs: [{name: out, location: out/x}]
"""


@query(values("case_id, input, verdict", [("filter_only", "customer", "Conforms"), ("copied", "customer", "Contradicts")]))
def role_report(spark, d):
    c = contract.parse(CONTROL.replace("DIR", d))
    o, cu = t(spark, d, "orders"), t(spark, d, "customer")
    cond = F.col("o_custkey") == F.col("c_custkey")
    cases = {"filter_only": o.join(cu, cond, "left_semi").select("o_orderkey"), "copied": o.join(cu, cond).select("o_orderkey", "c_name")}
    return frame(spark, "case_id, input, verdict", [(k, n, v) for k, df in cases.items() for n, v, _ in checks.roles(translate(df)[0], c)])


@query(values("output, low, high, nullable", [("a", "0", "10", "False"), ("b", "5", "15", "False"), ("c", "0", None, "None"), ("tier", None, None, "False")]))
def property_report(spark, d):
    v = F.col("value")
    df = t(spark, d, "events").where((v >= 0) & (v <= 10)).select(v.alias("a"), (v + 5).alias("b"), F.abs(F.col("user_id")).alias("c"), F.when(v > 5, "high").otherwise("low").alias("tier"))
    got = properties(translate(df)[0])
    num = lambda x: None if x is None else f"{x:g}"
    return frame(spark, "output, low, high, nullable", [(k, num(f.low), num(f.high), str(f.nullable)) for k, f in got.items()])


@query(values("case_id, same", [("again", "yes"), ("inner_alias", "yes"), ("group_order", "yes"), ("other_literal", "no"), ("other_join", "no")]))
def fingerprint_locality(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    make = lambda lit, how="inner": o.where(F.col("o_totalprice") > lit).join(c, F.col("o_custkey") == F.col("c_custkey"), how).select("o_orderkey", "c_name")
    same = lambda a, b: "yes" if fingerprint(translate(a)[0]).overall == fingerprint(translate(b)[0]).overall else "no"
    alias = lambda n: o.select((F.col("o_totalprice") * 2).alias(n)).select(F.col(n).alias("x"))
    keys = lambda *k: o.groupBy(*k).agg(F.count("*").alias("n")).select("n")
    rows = [("again", same(make(5), make(5))), ("inner_alias", same(alias("p"), alias("q"))), ("group_order", same(keys("o_custkey", "o_orderstatus"), keys("o_orderstatus", "o_custkey"))), ("other_literal", same(make(5), make(6))), ("other_join", same(make(5), make(5, "left")))]
    return frame(spark, "case_id, same", rows)


@query(values("output, verdict", [("a", "False"), ("b", "True"), ("c", "True"), ("d", "None")]))
def nondeterminism_report(spark, d):
    df = t(spark, d, "nation").select(F.upper("n_name").alias("a"), F.rand(3).alias("b"), F.concat(F.uuid(), F.col("n_name")).alias("c"), F.udf(lambda x: x)("n_name").alias("d"))
    return frame(spark, "output, verdict", [(k, str(v)) for k, v in fingerprint(translate(df)[0]).nondeterministic.items()])


# --- verdicts


@query("SELECT column_name AS \"column\", CASE column_name WHEN 'o_orderkey' THEN 'ok' WHEN 'o_custkey' THEN 'OUTPUT_FIELD_TYPE_MISMATCH' ELSE 'UNDECLARED_OUTPUT_COLUMN' END AS finding FROM (DESCRIBE orders) UNION ALL SELECT 'missing', 'MISSING_OUTPUT_FIELD'")
def schema_findings(spark, d):
    df = t(spark, d, "orders")
    fields = (Field("o_orderkey", "long"), Field("o_custkey", "string"), Field("missing", "string"))
    got = {v.column: v.type for v in checks.schema_findings(fields, checks.columns_of(df.schema), "OUTPUT", "x", True)}
    return frame(spark, "column, finding", [(c, got.get(c, "ok")) for c in [*df.columns, *(set(got) - set(df.columns))]])


BASE = """
id: scenario
version: 1.0.0
inputs:
  - {name: orders, location: DIR/orders.parquet, format: parquet, schema: [{name: o_orderkey, type: long}]}
outputs:
  - {name: out, location: out/orders, format: parquet, saveMode: overwrite, schema: [{name: o_orderkey, type: long}, {name: o_totalprice, type: double}]}
"""
OUT = dict(location="out/orders", format="parquet", mode="overwrite")


def _scenarios(spark, d):
    """(id, expected finding or pass, frame, contract text, how it is written)."""
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    base = BASE.replace("DIR", d)
    ok = o.select("o_orderkey", "o_totalprice")
    rule = lambda s: base + f"rules: [{s}]\n"
    join = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice")
    field = lambda extra: base.replace("{name: o_totalprice, type: double}", "{name: o_totalprice, type: double, " + extra + "}")
    two = base.replace("outputs:", "  - {name: customer, location: " + d + "/customer.parquet}\noutputs:")
    return [
        ("conforming-write", "pass", ok, base, OUT),
        ("wrong-output-location", "OUTPUT_LOCATION_MISMATCH", ok, base, OUT | {"location": "out/else"}),
        ("missing-output-field", "MISSING_OUTPUT_FIELD", o.select("o_orderkey"), base, OUT),
        ("output-type-mismatch", "OUTPUT_FIELD_TYPE_MISMATCH", o.select("o_orderkey", F.col("o_totalprice").cast("string")), base, OUT),
        ("output-nullability-mismatch", "OUTPUT_FIELD_NULLABILITY_MISMATCH", ok, field("nullable: false"), OUT),
        ("undeclared-output-column-allowed-by-default", "pass", o, base, OUT),
        # the input declares no fields here: with rejectUndeclaredFields its own undeclared columns would be findings too
        ("undeclared-output-column-rejected", "UNDECLARED_OUTPUT_COLUMN", o.select("o_orderkey", "o_totalprice", "o_custkey"), base.replace(", schema: [{name: o_orderkey, type: long}]}", "}", 1), OUT | {"rejectUndeclaredFields": True}),
        ("declared-input-not-read", "MISSING_INPUT", c.select(F.col("c_custkey").alias("o_orderkey"), F.col("c_acctbal").alias("o_totalprice")), base, OUT),
        ("undeclared-input-rejected", "UNDECLARED_INPUT", join, base, OUT | {"rejectUndeclaredInputs": True}),
        ("derived-from-excuses-an-input-the-output-is-not-built-from", "pass", ok, two.replace("saveMode", "derivedFrom: [orders], saveMode"), OUT),
        ("derived-from-requires-every-source-of-the-output", "MISSING_INPUT", ok, two.replace("saveMode", "derivedFrom: [orders, customer], saveMode"), OUT),
        ("output-format-mismatch", "OUTPUT_FORMAT_MISMATCH", ok, base, OUT | {"format": "orc"}),
        ("output-save-mode-mismatch", "OUTPUT_SAVE_MODE_MISMATCH", ok, base, OUT | {"mode": "append"}),
        ("partitioned-output-matches", "pass", ok, field("partitioned: true"), OUT | {"partition_by": ("o_totalprice",)}),
        ("partitioned-output-written-unpartitioned", "OUTPUT_PARTITIONING_MISMATCH", ok, field("partitioned: true"), OUT),
        ("partition-overwrite-mode-mismatch", "OUTPUT_PARTITIONING_MISMATCH", ok, base.replace("saveMode", "partitionOverwriteMode: dynamic, saveMode"), OUT | {"overwrite": "static"}),
        ("csv-output-options-mismatch", "OUTPUT_CSV_OPTIONS_MISMATCH", ok, base.replace("format: parquet, saveMode", "format: csv, csv: {delimiter: ';'}, saveMode"), OUT | {"format": "csv", "csv": {"sep": ","}}),
        ("csv-options-match", "pass", ok, base.replace("format: parquet, saveMode", "format: csv, csv: {delimiter: ';', header: true}, saveMode"), OUT | {"format": "csv", "csv": {"sep": ";", "header": "true"}}),
        ("nested-type-matches", "pass", ok.withColumn("tags", F.array(F.lit(1).cast("long"))), base.replace("type: double}]", "type: double}, {name: tags, type: array<long>}]"), OUT),
        ("nested-type-mismatch", "OUTPUT_FIELD_TYPE_MISMATCH", ok.withColumn("tags", F.array(F.lit("x"))), base.replace("type: double}]", "type: double}, {name: tags, type: array<long>}]"), OUT),
        ("required-filter-column-present", "pass", ok.where("o_orderkey > 1"), rule("{type: requiredFilterColumns, columns: [o_orderkey]}"), OUT),
        ("required-filter-column-missing", "RULE_REQUIRED_FILTER_COLUMNS_VIOLATION", ok, rule("{type: requiredFilterColumns, columns: [o_orderkey]}"), OUT),
        ("forbid-cross-join-allows-a-keyed-join", "pass", join, rule("{type: forbidCrossJoin}"), OUT),
        ("forbid-cross-join-blocks-a-cartesian-product", "RULE_CROSS_JOIN_VIOLATION", o.crossJoin(c).select("o_orderkey", "o_totalprice"), rule("{type: forbidCrossJoin}"), OUT),
        ("required-join-columns-present", "pass", join, rule("{type: requiredJoinColumns, columns: [o_custkey, c_custkey]}"), OUT),
        ("required-join-columns-missing", "RULE_REQUIRED_JOIN_COLUMNS_VIOLATION", ok, rule("{type: requiredJoinColumns, columns: [o_custkey]}"), OUT),
        ("required-group-by-present", "pass", o.groupBy("o_orderkey").agg(F.sum("o_totalprice").alias("o_totalprice")), rule("{type: requiredGroupBy, columns: [o_orderkey]}"), OUT),
        ("required-group-by-wrong-keys", "RULE_REQUIRED_GROUP_BY_VIOLATION", o.groupBy("o_orderkey").agg(F.sum("o_totalprice").alias("o_totalprice")), rule("{type: requiredGroupBy, columns: [o_custkey]}"), OUT),
        ("static-data-quality-proves-a-constant", "pass", o.select("o_orderkey", F.lit(5.0).alias("o_totalprice")), field("constraints: {range: {gte: 0}}"), OUT | {"staticDataQuality": True}),
        ("static-data-quality-violation-blocks", "DATA_QUALITY_VIOLATION", o.select("o_orderkey", F.lit(5.0).alias("o_totalprice")), field("constraints: {range: {gte: 9}}"), OUT | {"staticDataQuality": True}),
        ("runtime-data-quality-passes", "pass", ok, field("constraints: {range: {gte: 0}}"), OUT | {"runtime": True}),
        ("runtime-data-quality-violation-blocks", "RUNTIME_DATA_QUALITY_VIOLATION", ok, field("constraints: {range: {lt: 0}}"), OUT | {"runtime": True}),
        ("role-control-contributing-contradicts", "ROLE_CONSISTENCY_VIOLATION", ok, base.replace("format: parquet, schema: [{name: o_orderkey, type: long}]}", "type: CONTROL}", 1), OUT | {"roleConsistency": True}),
        ("invalid-contract", "INVALID_CONTRACT", ok, base.replace("1.0.0", "one"), OUT),
        ("input-format-mismatch", "INPUT_FORMAT_MISMATCH", ok, base.replace("format: parquet, schema", "format: csv, schema", 1), OUT),
        ("unconditional-delete-forbidden", "RULE_UNCONDITIONAL_DELETE", ok, rule("{type: forbidUnconditionalDelete}"), OUT | {"mutation": {"kind": "delete", "condition": None}}),
        ("catalog-required-output-unregistered", "MISSING_OUTPUT_CATALOG_REGISTRATION", ok, base.replace("saveMode", "catalog: {required: true}, saveMode"), OUT),
        ("catalog-required-output-registered", "pass", ok, base.replace("saveMode", "catalog: {required: true, table: t}, saveMode"), OUT | {"catalog": {"table": "t"}}),
    ]


EXPECTED = "conforming-write=pass wrong-output-location=OUTPUT_LOCATION_MISMATCH missing-output-field=MISSING_OUTPUT_FIELD output-type-mismatch=OUTPUT_FIELD_TYPE_MISMATCH output-nullability-mismatch=OUTPUT_FIELD_NULLABILITY_MISMATCH undeclared-output-column-allowed-by-default=pass undeclared-output-column-rejected=UNDECLARED_OUTPUT_COLUMN declared-input-not-read=MISSING_INPUT undeclared-input-rejected=UNDECLARED_INPUT derived-from-excuses-an-input-the-output-is-not-built-from=pass derived-from-requires-every-source-of-the-output=MISSING_INPUT output-format-mismatch=OUTPUT_FORMAT_MISMATCH output-save-mode-mismatch=OUTPUT_SAVE_MODE_MISMATCH partitioned-output-matches=pass partitioned-output-written-unpartitioned=OUTPUT_PARTITIONING_MISMATCH partition-overwrite-mode-mismatch=OUTPUT_PARTITIONING_MISMATCH csv-output-options-mismatch=OUTPUT_CSV_OPTIONS_MISMATCH csv-options-match=pass nested-type-matches=pass nested-type-mismatch=OUTPUT_FIELD_TYPE_MISMATCH required-filter-column-present=pass required-filter-column-missing=RULE_REQUIRED_FILTER_COLUMNS_VIOLATION forbid-cross-join-allows-a-keyed-join=pass forbid-cross-join-blocks-a-cartesian-product=RULE_CROSS_JOIN_VIOLATION required-join-columns-present=pass required-join-columns-missing=RULE_REQUIRED_JOIN_COLUMNS_VIOLATION required-group-by-present=pass required-group-by-wrong-keys=RULE_REQUIRED_GROUP_BY_VIOLATION static-data-quality-proves-a-constant=pass static-data-quality-violation-blocks=DATA_QUALITY_VIOLATION runtime-data-quality-passes=pass runtime-data-quality-violation-blocks=RUNTIME_DATA_QUALITY_VIOLATION role-control-contributing-contradicts=ROLE_CONSISTENCY_VIOLATION invalid-contract=INVALID_CONTRACT input-format-mismatch=INPUT_FORMAT_MISMATCH unconditional-delete-forbidden=RULE_UNCONDITIONAL_DELETE catalog-required-output-unregistered=MISSING_OUTPUT_CATALOG_REGISTRATION catalog-required-output-registered=pass"


@query(values("scenario, verdict", [tuple(x.split("=")) for x in EXPECTED.split()]))
def scenario_verdicts(spark, d):
    rows = []
    for name, _, df, text, how in _scenarios(spark, d):
        got = findings(df, text, "out", **how)
        rows.append((name, ",".join(sorted({v.type for v in got})) or "pass"))
    return frame(spark, "scenario, verdict", rows)


# --- governance


@query(values("kind, change", [("BREAKING", "output out: field o_totalprice removed"), ("MINOR", "output out: field note added"), ("BREAKING", "output out: save_mode changed")]))
def compatibility_changes(spark, d):
    old = contract.parse(BASE.replace("DIR", d))
    new = contract.parse(BASE.replace("DIR", d).replace("o_totalprice, type: double", "note, type: string, required: false").replace("overwrite", "append"))
    return frame(spark, "kind, change", contract.changes(old, new))


@query(values("rule, severity, finding", [("f1", "ERROR", "orders: format parquet"), ("f1", "ERROR", "out: format parquet"), ("m1", "WARNING", "out: save mode overwrite")]))
def org_policy_findings(spark, d):
    rules = [{"id": "f1", "type": "allowedFormats", "formats": ["delta"]}, {"id": "m1", "type": "requireSaveMode", "modes": ["append"], "severity": "WARNING"}, {"id": "x1", "type": "requireCatalog", "exemptions": [{"contract": "scenario"}]}]
    return frame(spark, "rule, severity, finding", contract.policy_findings(contract.parse(BASE.replace("DIR", d)), rules))


@query(values("side, name", [("input", "orders"), ("input", "customer"), ("output", "a"), ("output", "b")]))
def draft_merge(spark, d):
    a = infer(t(spark, d, "orders").select("o_orderkey"), "out/a")
    b = infer(t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_name"), "out/b")
    m = contract.merge_drafts([a, b])
    return frame(spark, "side, name", [("input", x.name) for x in m.inputs] + [("output", x.name) for x in m.outputs])


@query("SELECT column_name AS field, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'INTEGER' THEN 'int' ELSE 'timestamp_ntz' END AS type FROM (DESCRIBE lineitem)")
def infer_contract(spark, d):
    draft = infer(t(spark, d, "lineitem"), "out/x")
    return frame(spark, "field, type", [(f.name, f.type) for f in draft.inputs[0].schema])


# --- streaming


def _stream(spark, d):
    src = t(spark, d, "events")
    return spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, event_type, value FROM events WHERE value > 50")
def stream_append_available_now(spark, d):
    return drain(_stream(spark, d).where("value > 50").select("event_id", "event_type", "value"), "append")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_window_tumbling(spark, d):
    g = _stream(spark, d).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return drain(g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"), "complete")


@query("SELECT CAST(date_trunc('hour', ts) - to_hours(unnest([0, 1])) AS TIMESTAMP) AS start, count(*) AS n FROM events GROUP BY 1".replace("SELECT CAST", "SELECT start, count(*) AS n FROM (SELECT CAST").replace(", count(*) AS n FROM events GROUP BY 1", " FROM events) GROUP BY start"))
def stream_window_sliding(spark, d):
    g = _stream(spark, d).withWatermark("ts", "1 day").groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n"))
    return drain(g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), "complete")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (
  SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def stream_window_session(spark, d):
    g = _stream(spark, d).withWatermark("ts", "1 day").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return drain(g.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n"), "complete")


@query("""SELECT CAST(s AS TIMESTAMP) AS start, count(*) AS n FROM (SELECT date_trunc('day', ts) AS s FROM events)
  WHERE s + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY s""")
def stream_window_append(spark, d):
    """Append mode: a day's count comes out once, when the watermark, two days behind the latest event, has passed its end."""
    g = _stream(spark, d).withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return drain(g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), "append")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    """The first event of each user and type; state is bounded by the keys."""
    return drain(_stream(spark, d).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "append")


@query("""SELECT c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click'
  AND p.event_type = 'purchase' AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOUR""")
def stream_stream_join(spark, d):
    """Purchases within six hours after a click of the same user: two streams, state on both sides bounded by watermarks and the range."""
    clicks = _stream(spark, d).where("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("user_id").alias("cu"), F.col("ts").alias("ct")).withWatermark("ct", "1 day")
    buys = _stream(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), F.col("user_id").alias("pu"), F.col("ts").alias("pt")).withWatermark("pt", "1 day")
    on = (F.col("cu") == F.col("pu")) & (F.col("pt") >= F.col("ct")) & (F.col("pt") <= F.col("ct") + F.expr("INTERVAL 6 HOURS"))
    return drain(clicks.join(buys, on).select("click", "purchase"), "append")


STREAM = """
id: clicks
inputs: []
outputs: [{name: clicks, location: clicks, schema: [{name: event_id, type: long}, {name: value, type: double, constraints: {range: {gte: -1000000}}}]}]
"""


@query("SELECT event_id, value FROM events WHERE event_type = 'click'")
def stream_foreach_batch(spark, d):
    """Each micro-batch is checked against the contract, rows included, before it is written."""
    base = folder(spark, "clicks")
    out = _stream(spark, d).where("event_type = 'click'").select("event_id", "value")
    text = STREAM.replace("location: clicks", f"location: '{base}/out'")
    out.writeStream.foreachBatch(guarded_batches(text, "clicks", base + "/out")).option("checkpointLocation", base + "/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(base + "/out")



