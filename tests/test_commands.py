"""Statements on tables of another catalog, reads and writes through JDBC, streams, and a session that enforces and one that only looks."""

import os
import subprocess
import sys

import pytest

from contractlens import contract
from contractlens.checks import columns_of, verify
from contractlens.plans import boundaries
from contractlens.plans.analysis import fingerprint
from contractlens.plans.catalyst import analyze_sql, translate
from contractlens.plans.commands import judge_command
from contractlens.plans.model import nodes

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

OTHER_CATALOG = r'''
import sys
from pyspark.sql import SparkSession
from contractlens import contract
from contractlens.plans.catalyst import analyze_sql, translate
from contractlens.plans.commands import judge_command, write_of
url = "jdbc:derby:memory:probe;create=true"
driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
s = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", sys.argv[1])
     .config("spark.sql.catalog.db", "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog").config("spark.sql.catalog.db.url", url).config("spark.sql.catalog.db.driver", driver).getOrCreate())
s.sql("CREATE TABLE db.app.vt (id BIGINT, v STRING)")
s.range(1).selectExpr("id", "'a' AS v").createOrReplaceTempView("tv")
c = contract.parse("""
id: c
outputs:
  - {name: vt, location: db/app/vt, saveMode: append, catalog: {required: true, catalogName: db, namespace: [app], table: vt}, schema: {fields: [{name: id, type: long, required: true, nullable: true}, {name: v, type: string}]}}
  - {name: made, location: db.app.made, catalog: {required: true, catalogName: elsewhere}}
""")
for sql in ["INSERT INTO db.app.vt SELECT * FROM tv", "INSERT INTO db.app.vt SELECT id, 1 FROM tv", "CREATE TABLE db.app.nt AS SELECT * FROM tv", "CREATE TABLE db.app.made AS SELECT * FROM tv",
            "ALTER TABLE db.app.vt ADD COLUMNS (z INT)", "ALTER TABLE db.app.vt DROP COLUMN id", "ALTER TABLE db.app.vt RENAME COLUMN id TO key", "ALTER TABLE db.app.vt RENAME TO app.vu",
            "DROP TABLE db.app.vt", "TRUNCATE TABLE db.app.vt", "DELETE FROM db.app.vt WHERE id = 1", "UPDATE db.app.vt SET v = 'x'"]:
    try:
        print("V", sql, "|", ",".join(sorted({v.type for v in judge_command(analyze_sql(s, sql), c)})) or "pass")
    except Exception as x:
        print("V", sql, "| error", str(x)[:150].replace(chr(10), " "))
plan, said = translate(s.table("db.app.vt"))
print("R", plan.kind, plan.info["location"], plan.info["catalog"], len(said))
reader = s.read.format("jdbc").option("url", url).option("driver", driver).option("dbtable", '"app"."vt"')
plan, said = translate(reader.load())
print("J", plan.kind, plan.info["location"], plan.info["format"])
'''


def _run(code, *args):
    env = os.environ | {"PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", code, *args], env=env, capture_output=True, text=True, timeout=300)
    return done.stdout.splitlines(), done.stderr[-1500:]


def test_tables_of_another_catalog(tmp_path):
    lines, err = _run(OTHER_CATALOG, str(tmp_path / "wh"))
    got = {x[2:].partition(" | ")[0]: x.partition(" | ")[2] for x in lines if x.startswith("V ")}
    assert got["INSERT INTO db.app.vt SELECT * FROM tv"] == "pass", (got, err)
    assert got["CREATE TABLE db.app.nt AS SELECT * FROM tv"] == "OUTPUT_LOCATION_MISMATCH"
    assert got["CREATE TABLE db.app.made AS SELECT * FROM tv"] == "OUTPUT_CATALOG_MISMATCH"
    assert got["ALTER TABLE db.app.vt ADD COLUMNS (z INT)"] == "pass"
    assert got["ALTER TABLE db.app.vt DROP COLUMN id"] == "MISSING_OUTPUT_FIELD"
    assert got["ALTER TABLE db.app.vt RENAME COLUMN id TO key"] == "MISSING_OUTPUT_FIELD"
    assert got["ALTER TABLE db.app.vt RENAME TO app.vu"] == "UNVERIFIABLE_WRITE"
    assert got["DROP TABLE db.app.vt"] == got["TRUNCATE TABLE db.app.vt"] == "OUTPUT_SAVE_MODE_MISMATCH"
    assert got["DELETE FROM db.app.vt WHERE id = 1"] == "pass"
    assert "R read db.app.vt {'catalogName': 'db', 'namespace': ['app'], 'table': 'vt'} 1" in lines
    assert 'J read jdbc:jdbc:derby:memory:probe;create=true/"app"."vt" jdbc' in lines


GUARDED = '''
import os, sys
from pyspark.sql import functions as F
from contractlens.session import guarded_session
out = sys.argv[1]
text = f"""
id: s
inputs: [{{name: nation, location: /root/testdata/sf0.001/nation.parquet}}]
outputs:
  - {{name: a, location: '{out}/a', format: csv, saveMode: overwrite, csv: {{delimiter: ';', header: true}}, schema: {{fields: [{{name: n_name, type: string, required: true, nullable: true}}]}}}}
  - {{name: p, location: '{out}/p', format: parquet, schema: {{fields: [{{name: n_name, type: string}}, {{name: n_regionkey, type: integer, partitioned: true}}]}}}}
  - {{name: t, location: spark_catalog/default/t, format: parquet, catalog: {{required: true, table: t}}}}
"""
text = text.replace("spark_catalog/default/t", out + "/wh/t")
events = []
conf = {"spark.master": "local[1]", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": out + "/wh", "spark.sql.shuffle.partitions": "1"}
if sys.argv[2] == "dry":
    spark = guarded_session(None, conf, [events.append], dryRun=True)
elif sys.argv[2] == "conf":
    open(out + "/c.yaml", "w").write(text.replace(out + "/a", "ref://a"))
    open(out + "/m.properties", "w").write(f"# places\\na = {out}/a\\n")
    spark = guarded_session(None, conf | {"spark.contractlens.contract": out + "/c.yaml", "spark.contractlens.locationMap": out + "/m.properties", "spark.contractlens.rejectUndeclaredFields": "true"})
else:
    spark = guarded_session(text, conf, [events.append])
n = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
def said(f):
    try:
        f()
    except Exception as x:
        from contractlens.checks import VIOLATIONS
        return ",".join(sorted(k for k in VIOLATIONS if k + ":" in str(x))) or "other " + str(x)[:200]
    return "allowed"
names = n.select("n_name")
print("CSV", said(lambda: names.write.mode("overwrite").option("sep", ";").option("header", "true").csv(out + "/a")))
print("BARE", said(lambda: names.write.mode("overwrite").csv(out + "/a")))
print("MORE", said(lambda: n.select("n_name", "n_regionkey").write.mode("overwrite").option("sep", ";").option("header", "true").csv(out + "/a")))
print("PARTS", said(lambda: n.select("n_name", "n_regionkey").write.mode("overwrite").partitionBy("n_regionkey").parquet(out + "/p")))
print("FLAT", said(lambda: n.select("n_name", "n_regionkey").write.mode("overwrite").parquet(out + "/p")))
print("TABLE", said(lambda: names.write.mode("overwrite").saveAsTable("t")))
print("LOOSE", said(lambda: names.write.mode("overwrite").parquet(out + "/wh/t")))
print("JDBC", said(lambda: names.write.format("jdbc").option("url", "jdbc:derby:memory:x").option("dbtable", "app.x").save()))
print("NOOP", said(lambda: names.write.format("noop").mode("overwrite").save()))
print("CREATE", said(lambda: spark.sql("CREATE TABLE u (a INT) USING parquet")))
print("DROP", said(lambda: spark.sql("DROP TABLE u")))
print("CACHE", said(lambda: spark.sql("CACHE TABLE v AS SELECT 1 AS a")))
src = spark.readStream.schema(n.schema).option("pathGlobFilter", "nation.parquet").parquet("/root/testdata/sf0.001").select("n_name", "n_regionkey")
def stream(where, *keys):
    w = src.writeStream.format("parquet").option("path", where).option("checkpointLocation", where + "_state").trigger(availableNow=True)
    (w.partitionBy(*keys) if keys else w).start().awaitTermination()
print("STREAM", said(lambda: stream(out + "/p", "n_regionkey")))
print("STREAMFLAT", said(lambda: stream(out + "/p")))
print("STREAMELSE", said(lambda: stream(out + "/q", "n_regionkey")))
print("WRITTEN", sorted(x.rpartition("/")[2] for x in set(spark.guard.written)), [v.message for v in spark.guard.missing()] if spark.guard.contract else "")
print("EVENTS", len(events) > 5, {e["type"] for e in events})
if spark.guard.dry:
    from contractlens.contract import merge_drafts
    d = merge_drafts([x for x in spark.guard.drafts if x.outputs[0].name in "apt" and len(x.outputs[0].schema) == (2 if x.outputs[0].name == "p" else 1)][:3])
    print("DRAFT", [x.name for x in d.inputs], [(x.name, x.format, [f.name for f in x.schema], x.partition_keys) for x in d.outputs][:2])
'''


def _said(tmp_path, how):
    lines, err = _run(GUARDED, str(tmp_path), how)
    return {x.partition(" ")[0]: x.partition(" ")[2] for x in lines}, err


def test_a_guarded_session_fails_closed(tmp_path):
    got, err = _said(tmp_path, "code")
    want = {"CSV": "allowed", "MORE": "allowed", "PARTS": "allowed", "FLAT": "OUTPUT_PARTITIONING_MISMATCH", "TABLE": "allowed", "JDBC": "OUTPUT_LOCATION_MISMATCH", "NOOP": "allowed"}
    want |= {"BARE": "OUTPUT_CSV_OPTIONS_MISMATCH", "LOOSE": "MISSING_OUTPUT_CATALOG_REGISTRATION", "CREATE": "allowed", "DROP": "UNVERIFIABLE_WRITE", "CACHE": "allowed"}
    assert {k: got.get(k) for k in want} == want, (got, err)
    assert got["STREAMFLAT"] == "OUTPUT_PARTITIONING_MISMATCH" and got["STREAMELSE"].startswith("MISSING_INPUT,OUTPUT_LOCATION_MISMATCH") or "OUTPUT_LOCATION_MISMATCH" in got["STREAMELSE"]
    assert got["WRITTEN"] == "['a', 'p', 't'] []" and got["EVENTS"].startswith("True")


def test_a_session_named_by_settings(tmp_path):
    got, err = _said(tmp_path, "conf")
    assert got.get("CSV") == "allowed" and got["MORE"] == "UNDECLARED_OUTPUT_COLUMN", (got, err)


def test_a_dry_run_refuses_nothing_and_drafts(tmp_path):
    got, err = _said(tmp_path, "dry")
    assert all(got.get(k) == "allowed" for k in ("CSV", "BARE", "PARTS", "FLAT", "TABLE", "NOOP", "CREATE", "DROP")), (got, err)
    assert "('a', 'csv', ['n_name'], [])" in got["DRAFT"] and got["DRAFT"].startswith("['nation'")


SF = "/root/testdata/sf0.001"


def test_fingerprints_tell_apart(spark):
    a, b = spark.range(5).selectExpr("id", "id % 2 AS k"), spark.range(3).selectExpr("id", "id % 2 AS k")
    n, r = spark.read.parquet(f"{SF}/nation.parquet").select("n_regionkey"), spark.read.parquet(f"{SF}/region.parquet").select("r_regionkey")
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy("n_regionkey").orderBy("n_regionkey")
    frames = [
        n.exceptAll(r), n.subtract(r), n.intersect(r), n.intersectAll(r), n.distinct(), n, n.dropDuplicates(["n_regionkey"]).where("true"),
        n.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))).drop("x"), n.withColumn("x", F.explode(F.array(F.lit(1)))).drop("x"), n.withColumn("x", F.explode_outer(F.array(F.lit(1)))).drop("x"),
        n.select(F.sum("n_regionkey").over(w.rowsBetween(-1, 0)).alias("n_regionkey")), n.select(F.sum("n_regionkey").over(w.rowsBetween(-2, 0)).alias("n_regionkey")), n.select(F.sum("n_regionkey").over(w.rangeBetween(-1, 0)).alias("n_regionkey")),
    ]
    marks = [fingerprint(translate(f)[0]).overall for f in frames]
    assert len(set(marks)) == len(marks)
    assert a is not b


def test_partition_folders_belong_to_their_dataset(spark, tmp_path):
    spark.read.parquet(f"{SF}/nation.parquet").write.partitionBy("n_regionkey").parquet(str(tmp_path / "nations"))
    c = contract.parse("id: c\ninputs: [{name: n, location: nations}]\noutputs: [{name: o, location: o}]\n")
    for path in (tmp_path / "nations", tmp_path / "nations" / "n_regionkey=1"):
        df = spark.read.parquet(str(path))
        from contractlens.checks import Write

        assert verify(Write(translate(df)[0], columns_of(df.schema), "x/o"), c, rejectUndeclaredInputs=True) == []
    from contractlens.enforce import infer

    assert infer(spark.read.parquet(str(tmp_path / "nations" / "n_regionkey=1")), "x/o").inputs[0].location.endswith("/nations")


def test_checkpoints_are_seen_through(spark):
    df = spark.read.parquet(f"{SF}/nation.parquet").where("n_regionkey = 1").select("n_name")
    cut = boundaries.checkpoint(df)
    assert any(p.kind == "filter" for p in nodes(translate(cut.select("n_name"))[0]))
    boundaries.clear()
    assert translate(cut)[0].kind == "unknown"


def test_an_unknown_command_is_refused(spark):
    c = contract.parse("id: c\noutputs: [{name: o, location: o}]\n")
    assert [v.type for v in judge_command(analyze_sql(spark, "DROP DATABASE default CASCADE"), c)] == ["UNVERIFIABLE_WRITE"]
    assert judge_command(analyze_sql(spark, "SHOW TABLES"), c) == []


def test_matching_many_locations_is_not_quadratic(spark):
    import time

    from contractlens.checks import Write
    from contractlens.plans.model import Plan

    n = 3000
    c = contract.Contract("c", inputs=tuple(contract.Dataset(f"i{k}", f"lake/area{k % 40}/t{k}") for k in range(n)), outputs=(contract.Dataset("o", "lake/out"),))
    plan = Plan("union", tuple(Plan("read", output=(("a", k),), info={"location": f"s3a://bucket/lake/area{k % 40}/t{k}"}) for k in range(n)), output=(("a", 0),))
    began = time.time()
    assert verify(Write(plan, [], "s3://bucket/lake/out"), c, rejectUndeclaredInputs=True) == []
    assert time.time() - began < 1.0
    lost = Plan("union", plan.inputs[1:], output=plan.output)
    assert [v.type for v in verify(Write(lost, [], "s3://bucket/lake/out"), c)] == ["MISSING_INPUT"]


@pytest.mark.parametrize(("declared", "actual", "same"), [("orders", "/a/b/orders", True), ("b/orders", "s3://a/b/orders", True), ("orders", "gold.orders", True), ("ders", "/a/orders", False), ("/orders", "/a/orders", False), ("gold.orders", "spark_catalog.gold.orders", True), ("orders", "/a/x.orders", False), ("s3a://a/b", "s3://a/b", True)])
def test_index_and_comparison_agree(declared, actual, same):
    items = contract.Locations([declared, "other"], lambda x: x)
    assert contract.same_location(declared, actual) is same and (declared in items.actual(actual)) is same
    assert bool(contract.Locations([actual], lambda x: x).declared(declared)) is same
