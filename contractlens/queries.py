"""Registered queries over the given tables with their SQL: relational operators, data checks, streaming, plan analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.tiers import with_tiers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def net():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


# --- scans, projections, predicates, expressions


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_nation(spark, d):
    return t(spark, d, "nation")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def project_lineitem_net(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(net(), 4).alias("net"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT DISTINCT FROM '1-URGENT' OR
  (o_orderstatus IN ('O', 'P') AND o_totalprice BETWEEN 1000 AND 50000 AND o_orderpriority LIKE '2%') OR o_custkey IS NULL
  OR (NOT (o_orderstatus = 'F') AND o_totalprice >= 400000)""")
def filter_predicates_orders(spark, d):
    s, p, v = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
    keep = ((s == "F") & p.eqNullSafe("1-URGENT")) | (s.isin("O", "P") & v.between(1000, 50000) & p.like("2%")) | F.col("o_custkey").isNull() | (~(s == "F") & (v >= 400000))
    return t(spark, d, "orders").where(keep).select("o_orderkey")


@query("""SELECT event_id, round(value * value, 4) AS value_squared, CASE WHEN value >= 75 THEN 'high' WHEN value >= 25 THEN 'medium' ELSE 'low' END AS value_tier
  FROM events WHERE value IS NOT NULL""")
def case_value_tier(spark, d):
    return with_tiers(t(spark, d, "events")).select("event_id", F.round("value_squared", 4).alias("value_squared"), "value_tier")


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key_text, CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(o_orderdate AS DATE) AS day FROM orders")
def casts_orders(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("key_text"), F.floor("o_totalprice").cast("long").alias("whole"), F.col("o_orderdate").cast("date").alias("day"))


@query("SELECT p_partkey, p_brand AS brand, p_size AS size FROM part")
def struct_part(spark, d):
    s = t(spark, d, "part").select("p_partkey", F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("s"))
    return s.select("p_partkey", "s.brand", F.col("s").getField("size").alias("size"))


@query("SELECT event_id, round(value + 1, 4) AS plus, round(value - 1, 4) AS minus, round(value * 2, 4) AS twice, round(value / 2, 4) AS half, user_id % 7 AS rest, -user_id AS neg, round(abs(value - 50), 4) AS dist FROM events")
def arithmetic_events(spark, d):
    v, u = F.col("value"), F.col("user_id")
    return t(spark, d, "events").select("event_id", F.round(v + 1, 4).alias("plus"), F.round(v - 1, 4).alias("minus"), F.round(v * 2, 4).alias("twice"), F.round(v / 2, 4).alias("half"), (u % 7).alias("rest"), (-u).alias("neg"), F.round(F.abs(v - 50), 4).alias("dist"))


@query("SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, length(c_name)::INT AS len, trim(c_name) AS trimmed, c_name || '-' || c_mktsegment AS both, substr(c_name, 1, 4) AS head, coalesce(c_mktsegment, 'none') AS seg FROM customer")
def scalar_strings_customer(spark, d):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return t(spark, d, "customer").select("c_custkey", F.upper(n).alias("up"), F.lower(m).alias("low"), F.length(n).alias("len"), F.trim(n).alias("trimmed"), F.concat(n, F.lit("-"), m).alias("both"), F.substring(n, 1, 4).alias("head"), F.coalesce(m, F.lit("none")).alias("seg"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS dd, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(o_orderdate AS DATE) + 30 AS due FROM orders")
def scalar_dates_orders(spark, d):
    o = F.col("o_orderdate")
    return t(spark, d, "orders").select("o_orderkey", F.year(o).alias("y"), F.month(o).alias("m"), F.dayofmonth(o).alias("dd"), F.trunc(o.cast("date"), "month").alias("month_start"), F.date_add(o.cast("date"), 30).alias("due"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props_events(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT vec_id, len(embedding)::INT AS dims, round(embedding[1]::DOUBLE, 5) AS first, len([x for x in embedding if x > 0])::INT AS positive FROM embeddings")
def array_map_embeddings(spark, d):
    e = F.col("embedding")
    return t(spark, d, "embeddings").select("vec_id", F.size(e).alias("dims"), F.round(e[0].cast("double"), 5).alias("first"), F.size(F.filter(e, lambda x: x > 0)).alias("positive"))


# --- joins and subqueries


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


def _outer(spark, d, how):
    """Whole tables; the condition itself leaves rows of both sides without a partner."""
    a = t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    b = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    on = (a.c_custkey == b.o_custkey) & (a.c_mktsegment == "BUILDING") & (b.o_orderstatus == "F")
    return a.join(b, on, how).select("c_custkey", "c_nationkey", "o_orderkey", "o_custkey")


OUTER = "SELECT c_custkey, c_nationkey, o_orderkey, o_custkey FROM customer {} JOIN orders ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'"
for _name, _how, _sql in (("join_left", "left", "LEFT"), ("join_right", "right", "RIGHT"), ("join_full", "full", "FULL")):
    QUERIES[_name] = lambda spark, d, how=_how: _outer(spark, d, how)
    ORACLES[_name] = OUTER.format(_sql)
for _name, _how, _sql in (("join_semi", "left_semi", ""), ("join_anti", "left_anti", "NOT")):
    QUERIES[_name] = lambda spark, d, how=_how: t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), how).select("c_custkey")
    ORACLES[_name] = f"SELECT c_custkey FROM customer WHERE {_sql} EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross_small(spark, d):
    return t(spark, d, "nation").crossJoin(t(spark, d, "region")).select("n_name", "r_name")


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self_nation(spark, d):
    n = t(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a_name"), F.col("b.n_name").alias("b_name"))


@query("SELECT p_brand, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0 GROUP BY p_brand")
def join_multi_key(spark, d):
    j = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(t(spark, d, "supplier").where("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum(net()), 2).alias("revenue"))


@query("""SELECT a.l_partkey, a.l_suppkey, a.n AS shipped, b.n AS returned FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) a
  JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey""")
def join_composite_key(spark, d):
    """Both sides are grouped by the two keys that they are joined on, so the join needs no shuffle of its own."""
    li, keys = t(spark, d, "lineitem"), ["l_partkey", "l_suppkey"]
    a = li.groupBy(*keys).agg(F.count("*").alias("shipped"))
    b = li.where("l_returnflag = 'R'").groupBy(*keys).agg(F.count("*").alias("returned"))
    return a.join(b, keys).select(*keys, "shipped", "returned")


@query("SELECT n_nationkey, count(*) AS n FROM nation JOIN supplier ON s_acctbal BETWEEN n_nationkey * 300 AND n_nationkey * 300 + 300 GROUP BY n_nationkey")
def join_theta_range(spark, d):
    # a range join as an equality on 300-wide bands; the upper bound also belongs to the band below
    s = t(spark, d, "supplier").withColumn("band", F.floor(F.col("s_acctbal") / 300))
    s = s.withColumn("band", F.explode(F.when(F.col("s_acctbal") % 300 == 0, F.array("band", F.col("band") - 1)).otherwise(F.array("band"))))
    return t(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("band")).groupBy("n_nationkey").agg(F.count("*").alias("n"))


@query("""SELECT e.event_id, l.event_id AS last_click FROM (SELECT * FROM events WHERE event_type = 'purchase') e
  ASOF LEFT JOIN (SELECT max(event_id) AS event_id, user_id, ts FROM events WHERE event_type = 'click' GROUP BY user_id, ts) l ON e.user_id = l.user_id AND e.ts >= l.ts""")
def asof_events(spark, d):
    """As-of join with one shuffle: both sides unioned, the last click carried forward within a user."""
    e = t(spark, d, "events").where(F.col("event_type").isin("purchase", "click"))
    click = F.col("event_type") == "click"
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(click, F.struct("ts", "event_id"))).over(w)
    return e.withColumn("last", last).where(~click).select("event_id", F.col("last.event_id").alias("last_click"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def subquery_scalar(spark, d):
    t(spark, d, "customer").createOrReplaceTempView("v_customer")
    return spark.sql("SELECT c_custkey FROM v_customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM v_customer)")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def subquery_in(spark, d):
    t(spark, d, "customer").createOrReplaceTempView("v_customer")
    t(spark, d, "orders").createOrReplaceTempView("v_orders")
    return spark.sql("SELECT o_orderkey FROM v_orders WHERE o_custkey IN (SELECT c_custkey FROM v_customer WHERE c_mktsegment = 'BUILDING')")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 45)")
def subquery_exists(spark, d):
    t(spark, d, "supplier").createOrReplaceTempView("v_supplier")
    t(spark, d, "lineitem").createOrReplaceTempView("v_lineitem")
    return spark.sql("SELECT s_suppkey FROM v_supplier WHERE EXISTS (SELECT 1 FROM v_lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 45)")


CTE = "WITH s AS (SELECT o_custkey, sum(o_totalprice) AS v FROM {} GROUP BY o_custkey) SELECT a.o_custkey, round(a.v, 2) AS v FROM s a WHERE a.v > (SELECT avg(v) FROM s)"


@query(CTE.format("orders"))
def cte_reused(spark, d):
    t(spark, d, "orders").createOrReplaceTempView("v_orders")
    return spark.sql(CTE.format("v_orders"))


@query("SELECT n_name FROM nation WHERE n_regionkey = 1")
def temp_view_chain(spark, d):
    t(spark, d, "nation").createOrReplaceTempView("v_n1")
    spark.sql("SELECT n_name, n_regionkey FROM v_n1 WHERE n_regionkey = 1").createOrReplaceTempView("v_n2")
    return spark.sql("SELECT n_name FROM v_n2")


# --- aggregates, windows, sorting, sets


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc,
  min(l_tax) AS min_tax, max(l_tax) AS max_tax, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def agg_basic(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net()), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.min("l_tax").alias("min_tax"), F.max("l_tax").alias("max_tax"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1")
def agg_distinct(spark, d):
    return t(spark, d, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderpriority").alias("priorities"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY 1")
def agg_corr(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("c"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
def agg_having(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 15")


GROUPS = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY "


@query(GROUPS + "CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, d):
    return t(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query(GROUPS + "ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, d):
    return t(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query(GROUPS + "GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def agg_grouping_sets(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t(spark, d, "orders").groupingSets([[s], [p]], s, p).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS open_qty, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS done_qty FROM lineitem GROUP BY 1")
def agg_pivot(spark, d):
    p = t(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.sum("l_quantity"))
    return p.select("l_returnflag", F.round("O", 2).alias("open_qty"), F.round("F", 2).alias("done_qty"))


@query("""SELECT o_orderkey, row_number() OVER w::INT AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)::INT AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)::INT AS dr,
  ntile(3) OVER w::INT AS third FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""".replace("OVER w::INT", "OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT").replace(" WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", ""))
def win_rank(spark, d):
    w, p = Window.partitionBy("o_custkey").orderBy("o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t(spark, d, "orders").select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(p).alias("rk"), F.dense_rank().over(p).alias("dr"), F.ntile(3).over(w).alias("third"))


@query("SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after2 FROM events")
def win_lag_lead(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id", 2).over(w).alias("after2"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def win_running_sum(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return t(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS peak FROM events")
def win_frame_rows(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 1)
    return t(spark, d, "events").select("event_id", F.max("value").over(w).alias("peak"))


@query("SELECT n_name, round(s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS share, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def win_partition_share(spark, d):
    s = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("n_name", F.round(F.col("s_acctbal") / F.sum("s_acctbal").over(Window.partitionBy("s_nationkey")), 6).alias("share"), "s_suppkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_orders(spark, d):
    return t(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("SELECT n_name FROM nation ORDER BY n_name LIMIT 5 OFFSET 3")
def limit_offset(spark, d):
    return t(spark, d, "nation").orderBy("n_name").offset(3).limit(5).select("n_name")


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(t(spark, d, "supplier").select("s_nationkey"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, d):
    return t(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_keys(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(t(spark, d, "orders").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_keys(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(t(spark, d, "orders").select("o_custkey")).distinct()


@query("SELECT vec_id, (unnest(range(1, len(embedding) + 1)) - 1)::INT AS pos, round(unnest(embedding)::DOUBLE, 5) + 0 AS x FROM embeddings")
def explode_array(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "pos", (F.round(F.col("x").cast("double"), 5) + 0.0).alias("x"))


@query("SELECT event_id, CASE WHEN value >= 75 THEN 'high' ELSE 'low' END AS tier FROM events")
def udf_tier(spark, d):
    """A Python function as an opaque operator, batched by Arrow."""

    import numpy as np
    import pandas as pd

    def tier(v):
        return pd.Series(np.where(v >= 75, "high", "low"))

    tier.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return t(spark, d, "events").select("event_id", F.pandas_udf(tier, "string")("value").alias("tier"))


@query("SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS part FROM nation")
def udtf_parts(spark, d):
    """A Python table function as an opaque generator, one call a row."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="part string")
    class Parts:
        def eval(self, text: str):
            for x in (text or "").split(" "):
                yield (x,)

    return t(spark, d, "nation").lateralJoin(Parts(F.col("n_name").outer())).select("n_nationkey", "part")


@query("""SELECT 'orders read' AS step, count(*) AS rows FROM orders UNION ALL SELECT 'orders kept', count(*) FILTER (o_orderstatus = 'F') FROM orders
  UNION ALL SELECT 'customers read', count(*) FROM customer UNION ALL SELECT 'regions written', count(DISTINCT n_name) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'""")
def job_audit(spark, d):
    """What the flagship job would note of a run: rows read, kept and written, by one aggregation of each table."""
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    step = lambda name, df, what: df.agg(what.alias("rows")).select(F.lit(name).alias("step"), "rows")
    out = step("orders read", o, F.count("*")).unionByName(step("orders kept", o, F.count_if(F.col("o_orderstatus") == "F")))
    return out.unionByName(step("customers read", c, F.count("*"))).unionByName(step("regions written", flagship_revenue_by_nation(spark, d), F.count("*")))


@query("SELECT event_type, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def pandas_udf_agg(spark, d):
    import pandas as pd

    def mean(v):
        return float(v.mean())

    mean.__annotations__ = {"v": pd.Series, "return": float}
    return t(spark, d, "events").groupBy("event_type").agg(F.round(F.pandas_udf(mean, "double")("value"), 4).alias("mean"))


FLAGSHIP = """SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderstatus = 'F' GROUP BY n_name"""


@query(FLAGSHIP)
def flagship_revenue_by_nation(spark, d):
    """Paid orders by nation, checked against its contract before the frame is handed out."""
    j = t(spark, d, "orders").where(F.col("o_orderstatus") == "F").select("o_custkey", "o_totalprice").join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = j.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    from .enforce import checked

    return checked(out, FLAGSHIP_CONTRACT.replace("DIR", d), "revenue")


FLAGSHIP_CONTRACT = """
id: revenue-by-nation
version: 1.0.0
status: active
inputs:
  - {name: orders, location: DIR/orders.parquet, format: parquet, schema: [{name: o_custkey, type: long}, {name: o_totalprice, type: double}, {name: o_orderstatus, type: string}]}
  - {name: customer, location: DIR/customer.parquet, format: parquet, schema: [{name: c_custkey, type: long}, {name: c_nationkey, type: integer}]}
  - {name: nation, location: DIR/nation.parquet, format: parquet}
outputs:
  - {name: revenue, location: out/revenue, derivedFrom: [orders, customer, nation], schema: [{name: n_name, type: string}, {name: n_orders, type: long}, {name: revenue, type: double}]}
"""


def queries() -> dict:
    from . import engine_queries, verdict_queries

    return QUERIES | engine_queries.QUERIES | verdict_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import engine_queries, verdict_queries

    return ORACLES | engine_queries.ORACLES | verdict_queries.ORACLES
