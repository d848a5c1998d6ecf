"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relational as r
from . import elementwise_queries, factor_queries, foreach_queries, ordered_queries, spatial_queries, tensor_queries

QUERIES, SQL = {}, {}


def _t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def cents(c: str):
    """Money as whole cents: sums are then exact in any order."""
    return F.round(F.col(c) * 100).cast("long")


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum_cents, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def scatter_reduce_flagship(spark, sf):
    rows = _t(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), F.sum(cents("l_extendedprice")).alias("sum_cents"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_discount > 0.05 AND l_shipdate < TIMESTAMP '1995-01-01'")
def masked_select(spark, sf):
    return _t(spark, sf, "lineitem").where((F.col("l_discount") > 0.05) & (F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp"))).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("""SELECT o_custkey, max(c) AS amax, min(c) AS amin, CAST(sum(c) AS BIGINT) AS total, count(*) FILTER (WHERE c <> 0) AS nonzero, bool_or(c <> 0) AS any_v, bool_and(c <> 0) AS all_v,
  arg_max(o_orderkey, (c, -o_orderkey)) AS argmax, arg_min(o_orderkey, (c, o_orderkey)) AS argmin
FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) GROUP BY 1""")
def reductions(spark, sf):
    c = cents("o_totalprice")
    return _t(spark, sf, "orders").groupBy("o_custkey").agg(
        r.amax(c).alias("amax"), F.min(c).alias("amin"), r.total(c).alias("total"), r.count_nonzero(c).alias("nonzero"), r.any_(c).alias("any_v"), r.all_(c).alias("all_v"),
        r.argmax(c, F.col("o_orderkey")).alias("argmax"), r.argmin(c, F.col("o_orderkey")).alias("argmin"),
    )


@query("""SELECT l_suppkey, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS var1, round(var_pop(l_quantity), 6) AS var0, round(stddev_samp(l_quantity), 6) AS std1,
  count(*) FILTER (WHERE l_discount <> 0)::DOUBLE AS norm0, round(sum(abs(l_quantity)), 6) AS norm1, round(sqrt(sum(l_quantity * l_quantity)), 6) AS norm2, max(abs(l_quantity)) AS norminf FROM lineitem GROUP BY 1""")
def moments_and_norms(spark, sf):
    q = F.col("l_quantity")
    return _t(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.round(r.mean(q), 6).alias("mean"), F.round(r.var(q), 6).alias("var1"), F.round(r.var(q, 0), 6).alias("var0"), F.round(r.std(q), 6).alias("std1"),
        r.norm(F.col("l_discount"), 0).alias("norm0"), F.round(r.norm(q, 1), 6).alias("norm1"), F.round(r.norm(q), 6).alias("norm2"), r.norm(q, float("inf")).alias("norminf"),
    )


@query("SELECT o_custkey, round(product(1 + o_orderkey % 3), 6) AS prod FROM orders GROUP BY 1")
def prod(spark, sf):
    return _t(spark, sf, "orders").groupBy("o_custkey").agg(F.round(r.prod((1 + F.col("o_orderkey") % 3).cast("double")), 6).alias("prod"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 3")
def kthvalue(spark, sf):
    return r.kth(_t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey", 3)


@query("SELECT o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = (count(*) OVER (PARTITION BY o_custkey) + 1) // 2")
def median(spark, sf):
    return r.median(_t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_totalprice")


@query("""SELECT o_custkey, arg_min(o_orderpriority, (-c, o_orderpriority)) AS mode FROM (SELECT o_custkey, o_orderpriority, count(*) AS c FROM orders GROUP BY 1, 2) GROUP BY 1""")
def mode(spark, sf):
    return r.mode(_t(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 3")
def topk(spark, sf):
    return r.topk(_t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey", 3).drop("o_totalprice")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS rank FROM events")
def sort(spark, sf):
    return r.sort_rank(_t(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "value", "event_id").drop("value")


@query("""SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS cumsum, round(product(1 + (event_id % 2)) OVER w, 6) AS cumprod FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def cumsum_cumprod(spark, sf):
    rows = _t(spark, sf, "events").select("user_id", "event_id", "value")
    out = r.scan(rows, ["user_id"], "event_id", cumsum=("sum", cents("value")), cumprod=("product", (1 + F.col("event_id") % 2).cast("double")))
    return out.select("event_id", "cumsum", F.round("cumprod", 6).alias("cumprod"))


@query("SELECT event_id, max(value) OVER w AS cummax, min(value) OVER w AS cummin FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def cummax_cummin(spark, sf):
    rows = _t(spark, sf, "events").select("user_id", "event_id", "value")
    high = r.cummax(rows, ["user_id"], "event_id", "value").drop("at")
    return r.cummin(high, ["user_id"], "event_id", "value").select("event_id", "cummax", "cummin")


@query("""SELECT event_id, round(ln(sum(exp(v)) OVER w), 6) AS logcumsumexp FROM (SELECT *, value / 2 AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def logcumsumexp(spark, sf):
    rows = _t(spark, sf, "events").select("user_id", "event_id", (F.col("value") / 2).alias("v"))
    return r.logcumsumexp(rows, ["user_id"], "event_id", "v").select("event_id", F.round("logcumsumexp", 6).alias("logcumsumexp"))


@query("SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumsum FROM events")
def global_cumsum(spark, sf):
    return r.global_cumsum(_t(spark, sf, "events").select("event_id", cents("value").alias("c")), "event_id", "c").select("event_id", "cumsum")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT a.event_id, b.value AS rolled FROM r a JOIN r b ON a.user_id = b.user_id AND a.i = (b.i + 2) % b.n""")
def roll(spark, sf):
    return r.roll(_t(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 2).select("event_id", "rolled")


@query("""SELECT user_id, i // 2 AS window_no, s FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER w AS n, CAST(sum(event_id) OVER w AS BIGINT) AS s FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE n = 4 AND i % 2 = 0""")
def unfold(spark, sf):
    out = r.unfold(_t(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id", "event_id", 4, 2)
    return out.select("user_id", "window_no", F.aggregate("window", F.lit(0).cast("long"), lambda s, x: s + x).alias("s"))


@query("SELECT l_shipdate, count(*) AS counts FROM lineitem GROUP BY 1")
def unique_counts(spark, sf):
    return r.unique_counts(_t(spark, sf, "lineitem"), "l_shipdate")


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS inverse FROM orders")
def unique_inverse(spark, sf):
    return r.unique_inverse(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "inverse")


@query("""SELECT user_id, min(event_type) AS event_type, count(*) AS counts, min(event_id) AS start FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, run""")
def unique_consecutive(spark, sf):
    return r.unique_consecutive(_t(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type").drop("run")


@query("SELECT i AS q, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, (SELECT max(CAST(l_quantity AS BIGINT)) FROM lineitem) + 1)) AS i) LEFT JOIN (SELECT CAST(l_quantity AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY 1) ON q = i")
def bincount(spark, sf):
    return r.bincount(_t(spark, sf, "lineitem").select(F.col("l_quantity").cast("long").alias("q")), "q")


@query("""SELECT i AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 20)) AS i) LEFT JOIN (SELECT CAST(least(floor(p_size * 20 / 50.0::DOUBLE), 19) AS BIGINT) AS b, count(*) AS n FROM part WHERE p_size BETWEEN 0 AND 50 GROUP BY 1) ON b = i""")
def histc(spark, sf):
    return r.histc(_t(spark, sf, "part").select(F.col("p_size").cast("double").alias("s")), "s", 20, 0.0, 50.0)


@query("SELECT o_orderkey, (o_totalprice > 1000)::BIGINT + (o_totalprice > 50000)::BIGINT + (o_totalprice > 150000)::BIGINT AS bucket FROM orders")
def bucketize(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", r.bucketize(F.col("o_totalprice"), [1000, 50000, 150000]).alias("bucket"))


@query("SELECT p_partkey, (SELECT count(*) FROM supplier WHERE CAST(round(s_acctbal) AS BIGINT) < CAST(round(p_retailprice) AS BIGINT)) AS place FROM part")
def searchsorted(spark, sf):
    bounds = _t(spark, sf, "supplier").select(F.round("s_acctbal").cast("long").alias("v"))
    return r.searchsorted(bounds, _t(spark, sf, "part").select("p_partkey", F.round("p_retailprice").cast("long").alias("v")), "v").select("p_partkey", "place")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_size FROM lineitem JOIN part ON l_partkey = p_partkey")
def gather(spark, sf):
    part = _t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return r.gather(part, _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "l_partkey")


def _scatter(how: str, sql: str):
    def run(spark, sf):
        target = _t(spark, sf, "supplier").select("s_suppkey", cents("s_acctbal").alias("v"))
        source = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_quantity").cast("long").alias("q"))
        out = r.scatter_reduce(target, source, "s_suppkey", "q", how)
        return out.select("s_suppkey", F.round(F.col("v").cast("double"), 6).alias("v"))

    run.__name__ = f"scatter_reduce_{how}"
    query(f"""SELECT s_suppkey, round(CAST({sql} AS DOUBLE), 6) AS v FROM (SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) AS o FROM supplier)
LEFT JOIN (SELECT l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS s, max(CAST(l_quantity AS BIGINT)) AS hi, min(CAST(l_quantity AS BIGINT)) AS lo, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")(run)


_scatter("sum", "o + coalesce(s, 0)")
_scatter("mean", "(o + coalesce(s, 0)) / (1 + coalesce(n, 0))")
_scatter("amax", "greatest(o, coalesce(hi, o))")
_scatter("amin", "least(o, coalesce(lo, o))")


@query("SELECT o_orderkey, CAST(coalesce(q, 0) AS BIGINT) AS v FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def index_add(spark, sf):
    target = _t(spark, sf, "orders").select("o_orderkey", F.lit(0).cast("long").alias("v"))
    source = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("long").alias("q"))
    return r.scatter_reduce(target, source, "o_orderkey", "q", "sum").select("o_orderkey", "v")


@query("SELECT l_orderkey, CAST(sum(p_size) AS DOUBLE) AS s, round(avg(p_size), 6) AS m, max(p_size) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def embedding_bag(spark, sf):
    part = _t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    bags = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    return bags.join(part, "l_partkey").groupBy("l_orderkey").agg(F.sum("p_size").cast("double").alias("s"), F.round(F.avg("p_size"), 6).alias("m"), F.max("p_size").alias("x"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def isin(spark, sf):
    return _t(spark, sf, "documents").select("doc_id").join(_t(spark, sf, "labels"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def isin_invert(spark, sf):
    return _t(spark, sf, "documents").select("doc_id").join(_t(spark, sf, "labels"), "doc_id", "left_anti")


@query("SELECT c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey + (SELECT max(c_custkey) + 1 FROM customer), s_acctbal FROM supplier")
def cat(spark, sf):
    first = _t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    offset = first.agg(F.max("k") + 1).first()[0]
    return first.unionByName(_t(spark, sf, "supplier").select((F.col("s_suppkey") + offset).alias("k"), F.col("s_acctbal").alias("v")))


@query("SELECT p_partkey, CAST(copy AS INTEGER) AS copy FROM (SELECT p_partkey, unnest(range(0, p_size)) AS copy FROM part)")
def repeat_interleave(spark, sf):
    return r.repeat_interleave(_t(spark, sf, "part").select("p_partkey", "p_size"), "p_size").drop("p_size")


@query("""SELECT o_orderkey, round(exp(v - m) / sum(exp(v - m)) OVER w, 6) AS softmax, round(v - m - ln(sum(exp(v - m)) OVER w), 6) AS log_softmax
FROM (SELECT *, o_totalprice / 100000 AS v, max(o_totalprice / 100000) OVER (PARTITION BY o_custkey) AS m FROM orders) WINDOW w AS (PARTITION BY o_custkey)""")
def softmax(spark, sf):
    rows = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 100000).alias("v"))
    return r.softmax(rows, ["o_custkey"], "v").select("o_orderkey", F.round("softmax", 6).alias("softmax"), F.round("log_softmax", 6).alias("log_softmax"))


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / sqrt(var_pop(o_totalprice) OVER w + 1e-5), 5) + 0.0 AS normed FROM orders WINDOW w AS (PARTITION BY o_orderpriority)")
def layer_norm(spark, sf):
    out = r.layer_norm(_t(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderkey", (F.round("normed", 5) + 0.0).alias("normed"))


@query("SELECT i AS c, round(avg(x), 6) + 0.0 AS mean, round(1 / sqrt(var_pop(x) + 1e-5), 6) AS invstd FROM (SELECT i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, (SELECT CAST(unnest(range(64)) AS INTEGER) AS i)) GROUP BY 1")
def batch_norm_stats(spark, sf):
    rows = _t(spark, sf, "embeddings").select(F.posexplode("embedding").alias("c", "x")).withColumn("x", F.col("x").cast("double"))
    return r.batch_norm_stats(rows, ["c"], "x").select("c", (F.round("mean", 6) + 0.0).alias("mean"), F.round("invstd", 6).alias("invstd"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS dot, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings")
def dot(spark, sf):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return _t(spark, sf, "embeddings").select("vec_id", F.round(r.dot(e, e), 6).alias("dot"), F.round(F.sqrt(r.dot(e, e)), 6).alias("norm"))


@query("""WITH c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2)
SELECT vec_id, c.label AS centre, round(sqrt(sum(pow(CAST(embedding[i] AS DOUBLE) - v, 2))), 5) AS d2, round(sum(abs(CAST(embedding[i] AS DOUBLE) - v)), 5) AS d1, round(max(abs(CAST(embedding[i] AS DOUBLE) - v)), 5) AS dinf FROM embeddings, c GROUP BY 1, 2""")
def cdist_to_centres(spark, sf):
    rows = _t(spark, sf, "embeddings")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    centres = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("c")).select(F.col("label").alias("centre"), "c")
    both = r.cdist(rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")), centres)
    d = lambda p: F.round(r.distance(F.col("e"), F.col("c"), p), 5)
    return both.select("vec_id", "centre", d(2.0).alias("d2"), d(1.0).alias("d1"), d(float("inf")).alias("dinf"))


_COO = "SELECT l_suppkey AS i, l_linenumber AS j, CAST(l_quantity AS BIGINT) AS v FROM lineitem"


def _coo(spark, sf):
    return _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("long").alias("j"), F.col("l_quantity").cast("long").alias("v"))


@query(f"SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM ({_COO}) GROUP BY 1, 2")
def sparse_coalesce(spark, sf):
    return r.coalesce(_coo(spark, sf))


@query(f"WITH m AS (SELECT i, j, sum(v) AS v FROM ({_COO}) GROUP BY 1, 2) SELECT a.j AS i, b.j AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY 1, 2")
def sparse_matmul(spark, sf):
    m = r.coalesce(_coo(spark, sf))
    return r.matmul(m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), m)


@query(f"WITH m AS (SELECT DISTINCT i, j FROM ({_COO})), n AS (SELECT unnest(range(0, (SELECT max(i) + 2 FROM m))) AS i) SELECT n.i, (SELECT count(*) FROM m WHERE m.i < n.i) AS ptr FROM n")
def crow_indices(spark, sf):
    m = r.coalesce(_coo(spark, sf))
    return r.row_pointers(m, m.agg(F.max("i")).first()[0] + 1)


@query("SELECT l_suppkey AS i, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1")
def sparse_sum(spark, sf):
    return _coo(spark, sf).groupBy("i").agg(F.sum("v").alias("v"))


@query("SELECT conv_id, list_resize(list(length(text) ORDER BY turn), (SELECT max(n) FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)), 0)::VARCHAR AS padded FROM conversations GROUP BY 1")
def to_padded_tensor(spark, sf):
    rows = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda s: s["n"]).alias("a"))
    width = rows.agg(F.max(F.size("a")).alias("_w"))
    padded = F.concat("a", F.array_repeat(F.lit(0), F.col("_w") - F.size("a")))
    return rows.join(F.broadcast(width)).select("conv_id", F.concat(F.lit("["), F.array_join(padded.cast("array<string>"), ", "), F.lit("]")).alias("padded"))


@query("SELECT c_custkey, CAST(least(greatest(round_even(c_acctbal / 50, 0) + 3, -128), 127) AS INTEGER) AS q, round((least(greatest(round_even(c_acctbal / 50, 0) + 3, -128), 127) - 3) * 50, 6) + 0.0 AS fake FROM customer")
def quantize_per_tensor(spark, sf):
    x = F.col("c_acctbal")
    return _t(spark, sf, "customer").select("c_custkey", r.quantize(x, 50.0, 3).alias("q"), (F.round(r.fake_quantize(x, 50.0, 3), 6) + 0.0).alias("fake"))


@query("""SELECT l_returnflag, round(avg(pow(q - t, 2)), 5) AS mse, round(avg(CASE WHEN abs(q - t) < 1 THEN 0.5 * pow(q - t, 2) ELSE abs(q - t) - 0.5 END), 5) AS smooth, round(avg(CASE WHEN abs(q - t) <= 3 THEN 0.5 * pow(q - t, 2) ELSE 3 * (abs(q - t) - 1.5) END), 5) AS huber,
 round(avg(-(y * greatest(ln(p), -100) + (1 - y) * greatest(ln(1 - p), -100))), 5) AS bce, round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 5) AS bcel
FROM (SELECT l_returnflag, l_quantity / 10 AS q, l_linenumber AS t, 0.1 + l_tax * 5 AS p, CAST(l_linestatus = 'F' AS INTEGER) AS y, l_quantity / 10 - 2 AS z FROM lineitem) GROUP BY 1""")
def losses(spark, sf):
    q, t, p, z = F.col("l_quantity") / 10, F.col("l_linenumber"), 0.1 + F.col("l_tax") * 5, F.col("l_quantity") / 10 - 2
    y = (F.col("l_linestatus") == "F").cast("int")
    mean = lambda c, n: F.round(F.avg(c), 5).alias(n)
    return _t(spark, sf, "lineitem").groupBy("l_returnflag").agg(mean(r.mse(q, t), "mse"), mean(r.smooth_l1(q, t), "smooth"), mean(r.huber(q, t, 3.0), "huber"), mean(r.bce(p, y), "bce"), mean(r.bce_with_logits(z, y), "bcel"))


for _module in (elementwise_queries, factor_queries, foreach_queries, ordered_queries, spatial_queries, tensor_queries):
    _queries, _sql = _module.build()
    QUERIES |= _queries
    SQL |= _sql
