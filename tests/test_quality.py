from contractlens.contract import Constraint, Field
from contractlens.operators import quality


def test_report_gives_the_smallest_distinct_failing_values(spark):
    df = spark.createDataFrame([(v, s) for v, s in zip([10, 9, 9, 200, 30, 1, 40, 50, None], "bbaacdefg", strict=True)], "n long, s string").repartition(3)
    fields = [Field("n", nullable=False, constraints=(Constraint("range", {"lte": 5}), Constraint("range", {"lte": 500}))), Field("s", constraints=(Constraint("oneOf", {"value": ["d"]}),))]
    got = [(r.column, r.check, r.failed, r.total, r.examples) for r in quality.report(df, fields).collect()]
    assert got == [("n", "range", 7, 9, ["9", "10", "30", "40", "50"]), ("n", "range", 0, 9, []), ("s", "oneOf", 8, 9, ["a", "b", "c", "e", "f"]), ("n", "notNull", 1, 9, [])]
    assert quality.report(df, fields, 2).first().examples == ["9", "10"]
    assert [(r.failed, r.total) for r in quality.report(df.limit(0), fields).collect()] == [(0, 0)] * 4
