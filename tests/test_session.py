"""The analyzer's check rule, in a process of its own: the session cannot be shared."""

import os
import subprocess
import sys

CODE = '''
import os, sys
from contractlens.session import guarded_session
out = sys.argv[1]
text = f"""
id: s
inputs: [{{name: nation, location: /root/testdata/sf0.001/nation.parquet}}]
outputs: [{{name: a, location: '{out}/a', format: parquet, schema: [{{name: n_name, type: string}}]}}]
"""
spark = guarded_session(text, {"spark.master": "local[1]", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": out + "/wh"})
n = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
n.select("n_name").write.parquet(out + "/a")
print("WROTE", spark.read.parquet(out + "/a").count())
def refused(f):
    try:
        f()
    except Exception as x:
        return next((k for k in ("MISSING_OUTPUT_FIELD", "OUTPUT_LOCATION_MISMATCH", "UNVERIFIABLE_WRITE") if k in str(x)), "other " + str(x)[:300])
    return "allowed"
print("FIELD", refused(lambda: n.select("n_nationkey").write.mode("append").parquet(out + "/a")))
print("PLACE", refused(lambda: n.select("n_name").write.parquet(out + "/b")), os.path.exists(out + "/b"))
n.createOrReplaceTempView("nat")
print("DIR", refused(lambda: spark.sql(f"INSERT OVERWRITE DIRECTORY '{out}/c' USING parquet SELECT n_name FROM nat")), os.path.exists(out + "/c"))
print("VIEW", refused(lambda: spark.sql("DROP VIEW nat")))
'''


def test_violating_writes_are_refused(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=200)
    lines = [x for x in run.stdout.splitlines() if x.split()[:1] and x.split()[0] in ("WROTE", "FIELD", "PLACE", "DIR", "VIEW")]
    assert lines == ["WROTE 25", "FIELD MISSING_OUTPUT_FIELD", "PLACE OUTPUT_LOCATION_MISMATCH False", "DIR OUTPUT_LOCATION_MISMATCH False", "VIEW allowed"], (lines, run.stderr[-1500:])
