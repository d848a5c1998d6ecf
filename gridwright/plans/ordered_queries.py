"""Queries of the operators over an order of all rows: as-of and interval joins, selection by digits, scans in parts; with SQL for each.

Part sizes and the size of a large group are set so that the small tables are cut as large ones are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linalg, ordered, selection

QUERIES, SQL = {}, {}
ROWS = 2000


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def build() -> tuple[dict, dict]:
    return QUERIES, SQL


@query("""WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)
SELECT event_id, o_orderdate, o_orderkey FROM events ASOF LEFT JOIN o ON user_id = o_custkey AND ts >= o_orderdate""")
def asof_join_orders(spark, sf):
    orders = _t(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderkey")
    return ordered.asof_join(_t(spark, sf, "events").select("event_id", "user_id", "ts"), orders, ["user_id"], "ts", "o_orderdate", ["o_orderdate", "o_orderkey"], part_rows=ROWS).drop("user_id", "ts")


@query("""WITH e AS (SELECT user_id, ts AS next_ts, max(event_id) AS next_id FROM events WHERE event_type = 'error' GROUP BY 1, 2)
SELECT event_id, coalesce(next_id, -1) AS next_id FROM (SELECT * FROM events WHERE event_type <> 'error') c ASOF LEFT JOIN e ON c.user_id = e.user_id AND c.ts <= e.next_ts""")
def asof_join_forward(spark, sf):
    rows = _t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    errors = rows.where("event_type = 'error'").select("user_id", F.col("ts").alias("next_ts"), F.col("event_id").alias("next_id"))
    return ordered.asof_join(rows.where("event_type <> 'error'"), errors, ["user_id"], "ts", "next_ts", ["next_id"], True, ROWS).select("event_id", F.coalesce("next_id", F.lit(-1)).alias("next_id"))


@query("""WITH l AS (SELECT l_suppkey, l_orderkey, epoch(l_shipdate)::BIGINT // 3600 AS s, epoch(l_shipdate)::BIGINT // 3600 + CAST(l_quantity * l_quantity / 8 AS BIGINT) AS e FROM lineitem)
SELECT a.l_suppkey, count(*) AS pairs, CAST(sum(a.l_orderkey * b.l_orderkey % 1009) AS BIGINT) AS keys FROM l a JOIN l b ON a.l_suppkey = b.l_suppkey AND a.s <= b.e AND b.s <= a.e GROUP BY 1""")
def interval_join(spark, sf):
    start = F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 3600).cast("long")
    rows = _t(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", start.alias("s"), (start + F.round(F.col("l_quantity") * F.col("l_quantity") / 8).cast("long")).alias("e"))
    pairs = ordered.interval_join(rows, rows, ["l_suppkey"], ("s", "e"), ("s", "e"))
    return pairs.groupBy(F.col("left.l_suppkey").alias("l_suppkey")).agg(F.count("*").alias("pairs"), F.sum(F.col("left.l_orderkey") * F.col("right.l_orderkey") % 1009).alias("keys"))


@query("""SELECT l_returnflag, l_extendedprice, l_orderkey FROM lineitem QUALIFY
row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey) = (count(*) OVER (PARTITION BY l_returnflag) * 9) // 10""")
def kthvalue_by_digits(spark, sf):
    rows = _t(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_orderkey")
    return selection.select(rows, ["l_returnflag"], "l_extendedprice", "l_orderkey", lambda n, nan: F.floor(n * 9 / 10), ROWS)


@query("""SELECT event_type, CASE WHEN nans > 0 THEN 'NaN'::DOUBLE ELSE v END AS v FROM (SELECT event_type, count(*) FILTER (WHERE value < 1) AS nans,
quantile_disc(value, 0.5) FILTER (WHERE value >= 1) AS v FROM events GROUP BY 1)""")
def median_by_digits(spark, sf):
    rows = _t(spark, sf, "events").select("event_type", "event_id", F.when(F.col("value") < 1, float("nan")).otherwise(F.col("value")).alias("v"))
    return selection.select(rows, ["event_type"], "v", "event_id", lambda n, nan: F.when(nan > 0, n - nan + 1).otherwise(F.floor((n + 1) / 2)), ROWS // 2).drop("event_id")


@query("""SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS total, max(value) OVER w AS top, min(event_type) OVER w AS low FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY user_id, event_id ROWS UNBOUNDED PRECEDING)""")
def scan_in_parts(spark, sf):
    rows = _t(spark, sf, "events").select("event_type", "user_id", "event_id", "value")
    cents = F.round(F.col("value") * 100).cast("long")
    out = ordered.scan(rows, ["event_type"], ["user_id", "event_id"], ROWS, total=("sum", cents), top=("max", F.col("value")), low=("min", F.col("event_type")))
    return out.select("event_id", "total", "top", "low")


@query("""WITH m AS (SELECT l_suppkey AS i, CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE l_partkey END AS k, CAST(sum(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)
SELECT a.i, b.i AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM m a JOIN m b USING (k) GROUP BY 1, 2""")
def sparse_matmul_skewed(spark, sf):
    """Entries by supplier and part, times their transpose; a fifth of the parts are one inner index."""
    k = F.when(F.col("l_partkey") % 5 == 0, 0).otherwise(F.col("l_partkey")).alias("j")
    m = _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("i"), k).agg(F.sum("l_linenumber").alias("v"))
    return linalg.skewed_bmm(m, linalg.transposed(m), heavy=500, side=8)
