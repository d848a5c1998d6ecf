"""Queries of the creation, view, indexing, sparse, norm, loss, matrix, ragged, quantised and recurrent operators, with SQL for each.

Matrices: embeddings in coordinate form (n = vec_id, c = place, x). Groups: a customer's orders, a user's events. Numbers are rounded, for sums of
floating-point numbers depend on their order."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import elementwise as e
from ..operators import factor, indexing, linalg, more, nested, norms, random, sparse, views
from ..operators import relational as r
from ..sources import creation

QUERIES, SQL = {}, {}


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def add(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def build() -> tuple[dict, dict]:
    return QUERIES, SQL


def R(c, d=5):
    return F.round(c, d) + 0.0


def emb(spark, sf):
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), "label", F.posexplode("embedding").alias("c", "x")).select("n", "label", F.col("c").cast("long").alias("c"), F.col("x").cast("double").alias("x"))


EMB = "(SELECT vec_id AS n, label, c, CAST(embedding[c + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(64)) AS c))"

# creation
add("arange", "SELECT i, 3 + i * 7 AS v FROM (SELECT unnest(range(12)) AS i)")(lambda spark, sf: creation.arange(spark, 3, 85, 7).withColumn("v", F.col("v").cast("long")))
add("range", "SELECT i, 1 + i * 0.5::DOUBLE AS v FROM (SELECT unnest(range(9)) AS i)")(lambda spark, sf: creation.range_(spark, 1.0, 5.0, 0.5))
add("linspace", "SELECT i, round(-2 + i * 7 / 10.0::DOUBLE, 9) + 0.0 AS v FROM (SELECT unnest(range(11)) AS i)")(lambda spark, sf: creation.linspace(spark, -2, 5, 11).withColumn("v", R(F.col("v"), 9)))
add("logspace", "SELECT i, round(pow(10, i / 4.0::DOUBLE), 6) AS v FROM (SELECT unnest(range(9)) AS i)")(lambda spark, sf: creation.logspace(spark, 0, 2, 9).withColumn("v", R(F.col("v"), 6)))
add("eye", "SELECT i, j, (i = j)::INTEGER::DOUBLE AS v FROM (SELECT unnest(range(7)) AS i), (SELECT unnest(range(5)) AS j)")(lambda spark, sf: creation.eye(spark, 7, 5))
for _name, _up, _k, _sql in (("tril_indices", False, 1, "j <= i + 1"), ("tril_indices_below", False, -2, "j <= i - 2"), ("triu_indices", True, -1, "j >= i - 1"), ("triu_indices_above", True, 2, "j >= i + 2")):
    add(_name, f"SELECT row_number() OVER (ORDER BY i, j) - 1 AS n, i, j FROM (SELECT unnest(range(9)) AS i), (SELECT unnest(range(6)) AS j) WHERE {_sql}")(lambda spark, sf, up=_up, k=_k: creation.triangle_indices(spark, 9, 6, k, up))
for _name, _v in (("zeros", 0.0), ("ones", 1.0), ("full", 2.5), ("empty", 0.0), ("_efficientzerotensor", 0.0)):
    add(_name.strip("_"), f"SELECT i, j, {_v}::DOUBLE AS v FROM (SELECT unnest(range(4)) AS i), (SELECT unnest(range(6)) AS j)")(lambda spark, sf, v=_v: creation.full(spark, {"i": 4, "j": 6}, v))
for _name, _v in (("zeros_like", 0.0), ("ones_like", 1.0), ("empty_like", 0.0), ("fill", 7.25), ("zero", 0.0)):
    add(_name, f"SELECT c_custkey, {_v}::DOUBLE AS c_acctbal FROM customer")(lambda spark, sf, v=_v: creation.full_like(_t(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", v))
add("randperm", "SELECT v, 1::BIGINT AS times FROM (SELECT unnest(range(500)) AS v)")(lambda spark, sf: creation.randperm(spark, 500, 3).groupBy("v").agg(F.countDistinct("i").alias("times")))
add("copy", "SELECT c_custkey, c_acctbal FROM customer")(lambda spark, sf: views.alias(_t(spark, sf, "customer").select("c_custkey", "c_acctbal")))
for _name in ("clone", "alias", "alias_copy", "detach", "detach_copy"):
    add(_name, SQL["copy"])(QUERIES["copy"])
for _name in ("to", "_to_copy"):
    add(_name.strip("_"), "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS c_acctbal FROM customer")(lambda spark, sf: views.to(_t(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "bigint"))

# views
add("narrow", f"SELECT n, c - 5 AS c, x FROM {EMB} WHERE c BETWEEN 5 AND 14")(lambda spark, sf: more.narrow(emb(spark, sf).drop("label"), "c", 5, 10))
add("select", f"SELECT n, x FROM {EMB} WHERE c = 9")(lambda spark, sf: more.select(emb(spark, sf).drop("label"), "c", 9))
add("flip", f"SELECT n, 63 - c AS c, x FROM {EMB}")(lambda spark, sf: more.flip(emb(spark, sf).drop("label"), "c", 64).withColumn("c", F.col("c").cast("long")))
add("transpose", f"SELECT c AS n, n AS c, x FROM {EMB}")(lambda spark, sf: more.transpose(emb(spark, sf).drop("label"), "n", "c"))
add("view", f"SELECT n, c // 16 AS i, c % 16 AS j, x FROM {EMB}")(lambda spark, sf: more.view(emb(spark, sf).drop("label"), {"c": 64}, {"i": 4, "j": 16}))
for _name in ("view_copy", "_reshape_alias", "_reshape_alias_copy"):
    add(_name.strip("_"), SQL["view"])(QUERIES["view"])
for _name, _base in (("narrow_copy", "narrow"), ("select_copy", "select"), ("transpose_copy", "transpose")):
    add(_name, SQL[_base])(QUERIES[_base])
_SQ = f"(SELECT n, c // 8 AS i, c % 8 AS j, x AS v FROM {EMB})"


def square(spark, sf):
    return more.view(emb(spark, sf).select("n", "c", F.col("x").alias("v")), {"c": 64}, {"i": 8, "j": 8})


add("tril", f"SELECT n, i, j, v FROM {_SQ} WHERE j <= i + 1")(lambda spark, sf: more.tril(square(spark, sf), 1))
add("triu", f"SELECT n, i, j, v FROM {_SQ} WHERE j >= i")(lambda spark, sf: more.triu(square(spark, sf)))
add("trace", f"SELECT n, round(sum(v), 5) + 0.0 AS trace FROM {_SQ} WHERE i = j GROUP BY 1")(lambda spark, sf: views.diagonal(square(spark, sf)).groupBy("n").agg(R(F.sum("v")).alias("trace")))
add("channel_shuffle", f"SELECT n, (c % 16) * 4 + c // 16 AS c, x FROM {EMB}")(lambda spark, sf: emb(spark, sf).select("n", more.channel_shuffle(F.col("c"), 64, 4).alias("c"), "x"))
for _name in ("permute", "permute_copy"):
    add(_name, f"SELECT j AS n, n AS i, i AS j, v FROM {_SQ}")(lambda spark, sf: views.permute(square(spark, sf), ["n", "i", "j"], ["j", "n", "i"]))
for _name in ("unsqueeze", "unsqueeze_copy"):
    add(_name, "SELECT c_custkey, c_acctbal, 0::BIGINT AS d FROM customer")(lambda spark, sf: views.unsqueeze(_t(spark, sf, "customer").select("c_custkey", "c_acctbal"), "d"))
for _name in ("squeeze", "squeeze_copy"):
    add(_name, "SELECT c_custkey, c_acctbal FROM customer")(lambda spark, sf: views.squeeze(views.unsqueeze(_t(spark, sf, "customer").select("c_custkey", "c_acctbal"), "d"), {"c_custkey": 10, "d": 1}))
add("repeat", f"SELECT n, i + 8 * a AS i, j + 8 * b AS j, v FROM {_SQ}, (SELECT unnest(range(2)) AS a), (SELECT unnest(range(3)) AS b)")(lambda spark, sf: views.repeat(square(spark, sf), {"i": 8, "j": 8}, {"i": 2, "j": 3}))
add("expand", "SELECT c_custkey, c_acctbal, d FROM customer, (SELECT unnest(range(3)) AS d)")(lambda spark, sf: views.expand(views.unsqueeze(_t(spark, sf, "customer").select("c_custkey", "c_acctbal"), "d"), {"d": 3}))
_SPLIT = f"SELECT n, CASE WHEN c < 10 THEN c WHEN c < 34 THEN c - 10 ELSE c - 34 END AS c, x, CASE WHEN c < 10 THEN 0 WHEN c < 34 THEN 1 ELSE 2 END::BIGINT AS part FROM {EMB}"


def _parts(frames):
    out = None
    for k, f in enumerate(frames):
        f = f.withColumn("part", F.lit(k).cast("long"))
        out = f if out is None else out.unionByName(f)
    return out


for _name in ("split_with_sizes", "split_with_sizes_copy"):
    add(_name, _SPLIT)(lambda spark, sf: _parts(views.split(emb(spark, sf).drop("label"), "c", [10, 24, 30])))
add("split_ids", _SPLIT)(lambda spark, sf: views.split_ids(emb(spark, sf).drop("label"), "c", [10, 24, 30]))
add("chunk", f"SELECT n, c % 13 AS c, x, c // 13 AS part FROM {EMB}")(lambda spark, sf: _parts(views.chunk(emb(spark, sf).drop("label"), "c", 64, 5)))
for _name in ("unbind", "unbind_copy"):
    add(_name, f"SELECT n, x, c AS part FROM {EMB} WHERE c < 4")(lambda spark, sf: _parts(views.unbind(emb(spark, sf).drop("label"), "c", 4)))
_STRIDED = "SELECT i, j, c_acctbal AS v FROM customer, (SELECT unnest(range(10)) AS i), (SELECT unnest(range(4)) AS j) WHERE c_custkey = 5 + i * 3 + j * 2"
for _name in ("as_strided", "as_strided_copy"):
    add(_name, _STRIDED)(lambda spark, sf: views.as_strided(_t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), "k", {"i": 10, "j": 4}, {"i": 3, "j": 2}, 5))
add("chunk_cat", f"SELECT n, c // 22 AS chunk, c % 22 AS c, x FROM {EMB} UNION ALL SELECT n, c // 10 AS chunk, c % 10 + 22 AS c, x FROM {EMB} WHERE c < 30")(
    lambda spark, sf: views.chunk_cat([emb(spark, sf).drop("label"), emb(spark, sf).drop("label").where("c < 30")], "c", [64, 30], 3)
)

# indexing
_IMAGE = ["n", "c"]
add("index", f"SELECT i.k, i.n, i.c, x FROM (SELECT event_id AS k, event_id % 50 AS n, user_id % 64 AS c FROM events) i JOIN {EMB} m ON m.n = i.n AND m.c = i.c")(
    lambda spark, sf: indexing.index(emb(spark, sf).drop("label"), _t(spark, sf, "events").select(F.col("event_id").alias("k"), (F.col("event_id") % 50).alias("n"), (F.col("user_id") % 64).alias("c")), _IMAGE)
)
add("take", f"SELECT i.k, i.p, x FROM (SELECT event_id AS k, event_id % 900 - 400 AS p FROM events) i JOIN {EMB} m ON m.n < 20 AND m.n * 64 + m.c = CASE WHEN p < 0 THEN p + 1280 ELSE p END")(
    lambda spark, sf: indexing.take(emb(spark, sf).drop("label").where("n < 20"), _t(spark, sf, "events").select(F.col("event_id").alias("k"), (F.col("event_id") % 900 - 400).alias("p")), {"n": 20, "c": 64}, "p")
)


def _writes(spark, sf):
    return _t(spark, sf, "events").select((F.col("user_id") % 40).alias("n"), (F.col("event_id") % 64).alias("c"), F.round("value", 2).alias("s"), F.col("event_id").alias("ordinal"))


_WRITES = "(SELECT user_id % 40 AS n, event_id % 64 AS c, round(value, 2) AS s, event_id AS ordinal FROM events)"
_PUT = f"SELECT m.n, m.c, coalesce(w.s, m.x) AS x FROM {EMB} m LEFT JOIN (SELECT n, c, arg_max(s, ordinal) AS s FROM {_WRITES} GROUP BY 1, 2) w ON w.n = m.n AND w.c = m.c"
_ACC = f"SELECT m.n, m.c, round(m.x + coalesce(w.s, 0), 4) + 0.0 AS x FROM {EMB} m LEFT JOIN (SELECT n, c, sum(s) AS s FROM {_WRITES} GROUP BY 1, 2) w ON w.n = m.n AND w.c = m.c"
for _name in ("index_put", "put", "scatter"):
    add(_name, _PUT)(lambda spark, sf: indexing.put(emb(spark, sf).drop("label"), _writes(spark, sf), _IMAGE, "x"))
add("index_put_accumulate", _ACC)(lambda spark, sf: indexing.put(emb(spark, sf).drop("label"), _writes(spark, sf), _IMAGE, "x", True).withColumn("x", R(F.col("x"), 4)))
add("index_copy", f"SELECT m.n, m.c, coalesce(w.s, m.x) AS x FROM {EMB} m LEFT JOIN (SELECT n, arg_max(s, ordinal) AS s FROM {_WRITES} GROUP BY 1) w ON w.n = m.n")(lambda spark, sf: indexing.put(emb(spark, sf).drop("label"), _writes(spark, sf), ["n"], "x"))
add("index_fill", f"SELECT n, c, CASE WHEN n IN (SELECT user_id % 40 FROM events) THEN 9.5 ELSE x END AS x FROM {EMB}")(lambda spark, sf: indexing.fill(emb(spark, sf).drop("label"), _writes(spark, sf), ["n"], "x", 9.5))
add("scatter_reduce_prod", "SELECT s_suppkey, round(10 * coalesce(p, 1), 6) AS v FROM supplier LEFT JOIN (SELECT l_suppkey, product(1 + l_linenumber % 2) AS p FROM lineitem WHERE l_quantity < 5 GROUP BY 1) ON l_suppkey = s_suppkey")(
    lambda spark, sf: r.scatter_reduce(
        _t(spark, sf, "supplier").select("s_suppkey", F.lit(10.0).alias("v")), _t(spark, sf, "lineitem").where("l_quantity < 5").select(F.col("l_suppkey").alias("s_suppkey"), (1 + F.col("l_linenumber") % 2).alias("q")), "s_suppkey", "q", "prod"
    ).withColumn("v", F.round("v", 6))
)
add("index_reduce_mean", "SELECT s_suppkey, CAST(floor((7 + coalesce(s, 0)) / (1 + coalesce(n, 0))::DOUBLE) AS BIGINT) AS v FROM supplier LEFT JOIN (SELECT l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS s, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")(
    lambda spark, sf: r.scatter_reduce(
        _t(spark, sf, "supplier").select("s_suppkey", F.lit(7).cast("long").alias("v")), _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_quantity").cast("long").alias("q")), "s_suppkey", "q", "mean", whole=True
    ).withColumn("v", F.col("v").cast("long"))
)
_GRADS = "(SELECT l_partkey AS k, l_quantity AS g FROM lineitem)"


def _grads(spark, sf):
    return _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("g"))


for _name in ("gather_backward", "index_select_backward"):
    add(_name, f"SELECT k, round(sum(g), 4) AS g FROM {_GRADS} GROUP BY 1")(lambda spark, sf: indexing.lookup_backward(_grads(spark, sf), ["k"], "g").withColumn("g", F.round("g", 4)))
add("embedding_dense_backward", f"SELECT k, round(sum(g) / count(*), 4) AS g FROM {_GRADS} WHERE k <> 7 GROUP BY 1")(lambda spark, sf: indexing.lookup_backward(_grads(spark, sf), ["k"], "g", F.col("k") == 7, True).withColumn("g", F.round("g", 4)))
_BAG = "SELECT l_partkey AS k, round(sum(o_totalprice / 1000 {w}), 4) AS g FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1"


def _bags(spark, sf):
    bags = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("bag"), F.col("l_partkey").alias("k"), F.col("l_tax").alias("w"), "l_linenumber", "l_suppkey")
    return bags, _t(spark, sf, "orders").select(F.col("o_orderkey").alias("bag"), (F.col("o_totalprice") / 1000).alias("g"))


for _name, _mode, _weight, _w in (("_embedding_bag_backward", "mean", None, "/ m"), ("_embedding_bag_dense_backward", "sum", "w", "* l_tax")):
    add(_name.strip("_"), _BAG.format(w=_w))(lambda spark, sf, mode=_mode, weight=_weight: indexing.bag_backward(*_bags(spark, sf), "bag", ["k"], mode, weight).withColumn("g", F.round("g", 4)))
add("embedding_bag_per_sample_weights_backward", f"SELECT o_orderkey AS entry, round(sum(x * (c + 1)), 4) + 0.0 AS g FROM orders JOIN {EMB} m ON m.n = o_custkey % 50 GROUP BY 1")(
    lambda spark, sf: indexing.bag_weights_backward(
        _t(spark, sf, "orders").select(F.col("o_orderkey").alias("entry"), (F.col("o_custkey") % 50).alias("k"), (F.col("o_custkey") % 3).alias("bag")),
        spark.range(3).select(F.col("id").alias("bag"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("d")).withColumn("g", (F.col("d") + 1).cast("double")),
        emb(spark, sf).select(F.col("n").alias("k"), F.col("c").alias("d"), F.col("x").alias("v")), "bag", "k", "entry",
    ).withColumn("g", R(F.col("g"), 4))
)
add("masked_scatter", """WITH m AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer WHERE c_acctbal < 0), s AS (SELECT s_acctbal, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier)
SELECT c.c_custkey, coalesce(s.s_acctbal, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN m ON m.c_custkey = c.c_custkey LEFT JOIN s ON s.k = m.k""")(
    lambda spark, sf: indexing.masked_scatter(_t(spark, sf, "customer").select("c_custkey", "c_acctbal").withColumn("m", F.col("c_acctbal") < 0), "c_custkey", "m", "c_acctbal", _t(spark, sf, "supplier"), "s_suppkey", "s_acctbal").drop("m")
)
add("nonzero", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_discount <> 0")(lambda spark, sf: indexing.nonzero(_t(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "l_discount"))
add("nonzero_static", "SELECT i AS n, coalesce(c_custkey, -1) AS k FROM (SELECT unnest(range(2000)) AS i) LEFT JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer WHERE c_nationkey <> 0) ON n = i")(
    lambda spark, sf: indexing.nonzero_static(_t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey"), "k", "c_nationkey", 2000)
)
add("local_scalar_dense", "SELECT max(o_totalprice) AS v FROM orders")(lambda spark, sf: spark.range(1).select(F.lit(indexing.item(_t(spark, sf, "orders").agg(F.max("o_totalprice").alias("v")), "v")).alias("v")))
add("equal", "SELECT true AS same, false AS other")(
    lambda spark, sf: indexing.equal(_t(spark, sf, "orders"), _t(spark, sf, "orders").where("o_custkey % 2 = 1").unionByName(_t(spark, sf, "orders").where("o_custkey % 2 = 0")), ["o_orderkey"], "o_totalprice").select(F.col("equal").alias("same")).crossJoin(
        indexing.equal(_t(spark, sf, "orders"), _t(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice") + (F.col("o_orderkey") == 1).cast("int")), ["o_orderkey"], "o_totalprice").select(F.col("equal").alias("other"))
    )
)
add("is_same_size", "SELECT max(vec_id) = 49 AS same FROM embeddings")(lambda spark, sf: indexing.same_size(emb(spark, sf), creation.full(spark, {"n": 50, "c": 64}, 0.0), ["n", "c"]))
add("assert_async", "SELECT o_orderkey FROM orders")(lambda spark, sf: indexing.checked(_t(spark, sf, "orders"), F.col("o_totalprice") > -1e12, "price").select("o_orderkey"))
add("unique_dim", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS counts FROM lineitem GROUP BY ALL")(lambda spark, sf: indexing.unique_rows(_t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]))
add("unique_dim_consecutive", """SELECT user_id, run, min(a) AS a, min(b) AS b, count(*) AS counts, min(event_id) AS start FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (
SELECT *, CASE WHEN lag((a, b)) OVER (PARTITION BY user_id ORDER BY event_id) = (a, b) THEN 0 ELSE 1 END AS f FROM (SELECT user_id, event_id, event_id // 3 % 2 AS a, event_id // 4 % 3 AS b FROM events))) GROUP BY user_id, run""")(
    lambda spark, sf: indexing.unique_rows_consecutive(_t(spark, sf, "events").select("user_id", "event_id", (F.floor(F.col("event_id") / 3) % 2).alias("a"), (F.floor(F.col("event_id") / 4) % 3).alias("b")), ["user_id"], "event_id", ["a", "b"])
)
for _how, _agg in (("sum", "round(sum(c_acctbal), 2) + 0.0"), ("mean", "round(avg(c_acctbal), 4) + 0.0"), ("max", "max(c_acctbal)"), ("min", "min(c_acctbal)")):
    add(f"segment_reduce_{_how}", f"SELECT segment, {_agg} AS v FROM (SELECT c_acctbal, (SELECT min(s) FROM (SELECT unnest(range(0, 400)) AS s) WHERE c_custkey < (s + 1) * (s + 2) // 2) AS segment FROM customer WHERE c_custkey < 120) GROUP BY 1")(
        lambda spark, sf, how=_how: indexing.segment_reduce(_t(spark, sf, "customer").select("c_custkey", "c_acctbal"), spark.range(15).select(F.col("id").alias("segment"), (F.col("id") + 1).alias("n")), "c_custkey", "c_acctbal", how).withColumn("v", R(F.col("v"), 2 if how == "sum" else 4))
    )


def _segments(spark, sf):
    rows = _t(spark, sf, "orders").select(F.col("o_custkey").alias("segment"), F.col("o_orderkey").alias("at"), F.round(F.col("o_totalprice") / 1000).alias("v"))
    return rows, _t(spark, sf, "customer").select(F.col("c_custkey").alias("segment"), (F.col("c_nationkey") + 1).alias("g"))


_SEG = "(SELECT o_custkey AS segment, o_orderkey AS \"at\", round(o_totalprice / 1000) AS v, c_nationkey + 1 AS g FROM orders JOIN customer ON o_custkey = c_custkey)"
for _how, _d in (("sum", "g"), ("mean", "g / count(*) OVER w"), ("max", "CASE WHEN v = max(v) OVER w THEN g / count(*) OVER (PARTITION BY segment, v) ELSE 0 END"), ("min", "CASE WHEN v = min(v) OVER w THEN g / count(*) OVER (PARTITION BY segment, v) ELSE 0 END")):
    add(f"segment_reduce_backward_{_how}", f'SELECT segment, "at", v, round(CAST({_d} AS DOUBLE), 6) AS d FROM {_SEG} WINDOW w AS (PARTITION BY segment)')(
        lambda spark, sf, how=_how: indexing.segment_reduce_backward(*_segments(spark, sf), "v", how).withColumn("d", F.round("d", 6))
    )
add("cummaxmin_backward", """SELECT user_id, "at" AS event_id, sum(event_id % 7) AS g FROM (SELECT user_id, event_id, arg_max(event_id, (value, event_id)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS "at" FROM events) GROUP BY 1, 2""")(
    lambda spark, sf: indexing.scatter_by_place(
        r.cummax(_t(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value").select("user_id", "at", (F.col("event_id") % 7).alias("g")), ["user_id"], "at", "event_id", "g"
    ).withColumn("g", F.col("g").cast("decimal(38,0)").cast("long"))
)
SQL["cummaxmin_backward"] = SQL["cummaxmin_backward"].replace("sum(event_id % 7)", "CAST(sum(event_id % 7) AS BIGINT)")
add("cumprod_backward", """WITH p AS (SELECT user_id, event_id, 1 + event_id % 3 AS x, product(1 + event_id % 3) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS y FROM events WHERE event_id < 400)
SELECT user_id, event_id, round(sum(y) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) / x, 4) AS d FROM p""")(
    lambda spark, sf: indexing.cumprod_backward(_t(spark, sf, "events").where("event_id < 400").select("user_id", "event_id", (1.0 + F.col("event_id") % 3).alias("x"), F.lit(1.0).alias("g")), ["user_id"], "event_id", "x", "g").select("user_id", "event_id", F.round("d", 4).alias("d"))
)
SQL["cumprod_backward"] = SQL["cumprod_backward"].replace("FROM events WHERE event_id < 400", "FROM events")
QUERIES["cumprod_backward"] = lambda spark, sf: indexing.cumprod_backward(
    _t(spark, sf, "events").select("user_id", "event_id", (1.0 + (F.col("event_id") % 3) / 100).alias("x"), F.lit(1.0).alias("g")), ["user_id"], "event_id", "x", "g"
).select("user_id", "event_id", F.round("d", 4).alias("d"))
SQL["cumprod_backward"] = SQL["cumprod_backward"].replace("1 + event_id % 3", "1 + (event_id % 3) / 100.0::DOUBLE")
add("unfold_backward", "SELECT user_id, i, CAST(sum(w + 1) AS BIGINT) AS g FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1), (SELECT unnest(range(0, 400)) AS w), (SELECT unnest(range(4)) AS k), LATERAL (SELECT w * 2 + k AS i) WHERE w * 2 + 4 <= n GROUP BY 1, 2")(
    lambda spark, sf: indexing.scatter_by_place(
        _t(spark, sf, "events").groupBy("user_id").count().where("count >= 4").select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 4) / 2))).alias("w")).select("user_id", "w", F.explode(F.sequence(F.col("w") * 2, F.col("w") * 2 + 3)).alias("p")).withColumn("g", F.col("w") + 1),
        ["user_id"], "p", "i", "g",
    )
)
add("nansum", "SELECT c_nationkey, round(sum(CASE WHEN c_acctbal < 0 THEN 0 ELSE sqrt(c_acctbal) END), 4) AS v FROM customer GROUP BY 1")(lambda spark, sf: _t(spark, sf, "customer").groupBy("c_nationkey").agg(F.round(r.nansum(F.sqrt("c_acctbal")), 4).alias("v")))
add("nanmedian", "SELECT c_nationkey, quantile_disc(c_acctbal, 0.5) AS v FROM customer WHERE c_acctbal >= 0 GROUP BY 1")(
    lambda spark, sf: r.median(_t(spark, sf, "customer").withColumn("v", F.when(F.col("c_acctbal") < 0, float("nan")).otherwise(F.col("c_acctbal"))).where("not isnan(v)").select("c_nationkey", "c_custkey", "v"), ["c_nationkey"], "v", "c_custkey").select("c_nationkey", "v")
)
add("renorm", f"SELECT n, c, round(CASE WHEN s > 1.0 THEN x * 1.0 / (s + 1e-7) ELSE x END, 5) + 0.0 AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY n)) AS s FROM {EMB})")(lambda spark, sf: norms.renorm(emb(spark, sf).drop("label"), ["n"], "x", 2.0, 1.0).withColumn("x", R(F.col("x"))))
add("embedding_renorm", f"SELECT n, c, round(CASE WHEN s > 5.0 AND n IN (SELECT user_id % 40 FROM events) THEN x * 5.0 / (s + 1e-7) ELSE x END, 5) + 0.0 AS x FROM (SELECT *, sum(abs(x)) OVER (PARTITION BY n) AS s FROM {EMB})")(
    lambda spark, sf: norms.renorm(emb(spark, sf).drop("label").join(_writes(spark, sf).select("n").distinct(), "n", "left_semi"), ["n"], "x", 1.0, 5.0)
    .unionByName(emb(spark, sf).drop("label").join(_writes(spark, sf).select("n").distinct(), "n", "left_anti")).withColumn("x", R(F.col("x")))
)
add("histogram", "SELECT k AS p_size, count(p_partkey) AS n FROM (SELECT unnest(range(4)) AS k) LEFT JOIN part ON k = CASE WHEN p_size < 1 OR p_size > 50 THEN -1 WHEN p_size < 5 THEN 0 WHEN p_size < 11 THEN 1 WHEN p_size < 30 THEN 2 ELSE 3 END GROUP BY 1")(
    lambda spark, sf: r.histogram(_t(spark, sf, "part"), {"p_size": [1, 5, 11, 30, 50]})
)
add("histogram_of_bins", "WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT k AS p_retailprice, count(p_partkey) AS n FROM (SELECT unnest(range(7)) AS k) LEFT JOIN (SELECT p_partkey, least(CAST(floor((p_retailprice - lo) / ((hi - lo) / 7)) AS BIGINT), 6) AS b FROM part, e) ON b = k GROUP BY 1")(
    lambda spark, sf: r.histogram_of_bins(_t(spark, sf, "part"), {"p_retailprice": 7})
)
add("histogramdd_of_bins", "SELECT a AS p_size, b AS p_retailprice, count(p_partkey) AS n FROM (SELECT unnest(range(5)) AS a), (SELECT unnest(range(4)) AS b) LEFT JOIN part ON p_size BETWEEN 1 AND 51 AND p_retailprice BETWEEN 900 AND 1700 AND a = least((p_size - 1) // 10, 4) AND b = least(CAST(floor((p_retailprice - 900) / 200) AS BIGINT), 3) GROUP BY 1, 2")(
    lambda spark, sf: r.histogram_of_bins(_t(spark, sf, "part"), {"p_size": 5, "p_retailprice": 4}, {"p_size": (1, 51), "p_retailprice": (900, 1700)})
)
add("histogramdd", """SELECT a AS p_size, b AS p_retailprice, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS n FROM (SELECT unnest(range(2)) AS a), (SELECT unnest(range(3)) AS b) LEFT JOIN part ON a = CASE WHEN p_size < 0 OR p_size > 40 THEN -1 WHEN p_size < 20 THEN 0 ELSE 1 END
AND b = CASE WHEN p_retailprice < 900 OR p_retailprice > 1500 THEN -1 WHEN p_retailprice < 1000 THEN 0 WHEN p_retailprice < 1200 THEN 1 ELSE 2 END GROUP BY 1, 2""")(lambda spark, sf: r.histogram(_t(spark, sf, "part").withColumn("w", F.col("p_size")), {"p_size": [0, 20, 40], "p_retailprice": [900, 1000, 1200, 1500]}, "w"))

# sparse matrices: lineitem's quantities by supplier and line number
_COO = "(SELECT l_suppkey AS i, l_linenumber::BIGINT AS j, CAST(l_quantity AS BIGINT) AS v FROM lineitem)"
_M = f"(SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM {_COO} WHERE j <> i % 3 GROUP BY 1, 2)"
_ROWS = "(SELECT unnest(range(0, 12)) AS i)"


def coo(spark, sf):
    return _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("long").alias("j"), F.col("l_quantity").cast("long").alias("v"))


def m(spark, sf):
    return r.coalesce(coo(spark, sf).where("j <> i % 3"))


def _shape(spark, sf):
    return _t(spark, sf, "supplier").agg(F.max("s_suppkey")).first()[0] + 1  # rows of the matrix


_N = "(SELECT max(s_suppkey) + 1 AS n FROM supplier)"
_GRID = f"(SELECT i, j FROM (SELECT unnest(range(0, (SELECT n FROM {_N}))) AS i), (SELECT unnest(range(8)) AS j))"
for _name in ("to_dense", "_to_dense"):
    add(_name.strip("_") if _name == "to_dense" else "to_dense_kernel", f"SELECT g.i, g.j, CAST(coalesce(m.v, 0) AS BIGINT) AS v FROM {_GRID} g LEFT JOIN {_M} m ON m.i = g.i AND m.j = g.j")(lambda spark, sf: sparse.to_dense(m(spark, sf), _shape(spark, sf), 8))
add("to_sparse", f"SELECT i, j, v FROM {_M}")(lambda spark, sf: sparse.to_sparse(sparse.to_dense(m(spark, sf), _shape(spark, sf), 8)))
_MASK = "(SELECT DISTINCT user_id % 10 AS i, event_id % 8 AS j FROM events WHERE event_id < 60)"


def _mask(spark, sf):
    return _t(spark, sf, "events").where("event_id < 60").select((F.col("user_id") % 10).alias("i"), (F.col("event_id") % 8).alias("j"))


for _name in ("sparse_mask", "to_dense_backward"):
    add(_name, f"SELECT k.i, k.j, CAST(coalesce(m.v, 0) AS BIGINT) AS v FROM {_MASK} k LEFT JOIN {_M} m ON m.i = k.i AND m.j = k.j")(lambda spark, sf: sparse.sparse_mask(m(spark, sf), _mask(spark, sf)))
add("sparse_mask_projection", f"SELECT k.i, k.j, CAST(coalesce(sum(m.v), 0) AS BIGINT) AS v FROM {_MASK} k LEFT JOIN {_COO} m ON m.i = k.i AND m.j = k.j GROUP BY 1, 2")(lambda spark, sf: sparse.mask_projection(coo(spark, sf), _mask(spark, sf)))
add("is_coalesced", f"SELECT (SELECT count(*) = count(DISTINCT (i, j)) FROM {_COO}) AS raw, true AS summed")(
    lambda spark, sf: sparse.is_coalesced(coo(spark, sf)).select(F.col("coalesced").alias("raw")).crossJoin(sparse.is_coalesced(m(spark, sf)).select(F.col("coalesced").alias("summed")))
)
add("nnz", f"SELECT count(*) AS nnz FROM {_M}")(lambda spark, sf: sparse.nnz(m(spark, sf)))
add("sparse_dims", "SELECT 2::BIGINT AS sparse_dim, 1::BIGINT AS dense_dim")(
    lambda spark, sf: spark.range(1).select(*[F.lit(d).cast("long").alias(n) for d, n in zip(sparse.dims(m(spark, sf).withColumn("v", F.array("v"))), ("sparse_dim", "dense_dim"), strict=True)])
)
for _name in ("indices", "indices_copy"):
    add(f"sparse_{_name}", f"SELECT i, j FROM {_M}")(lambda spark, sf: sparse.indices(m(spark, sf)))
for _name in ("values", "values_copy"):
    add(f"sparse_{_name}", f"SELECT v FROM {_M}")(lambda spark, sf: sparse.values(m(spark, sf)))
add("copy_sparse_to_sparse", f"SELECT i, j, v FROM {_M}")(lambda spark, sf: views.alias(m(spark, sf)))
add("sparse_coo_tensor", f"SELECT i, j, v FROM {_COO}")(lambda spark, sf: sparse.empty_coo(spark).selectExpr("i", "j", "cast(v as long) v").unionByName(coo(spark, sf)))
add("sparse_resize", f"SELECT i, j, v FROM {_M} WHERE i < 6 AND j < 4")(lambda spark, sf: sparse.resize(m(spark, sf), 6, 4))
add("sparse_resize_and_clear", f"SELECT i, j, v::DOUBLE AS v FROM {_M} WHERE false")(lambda spark, sf: sparse.empty_coo(spark))
add("sparse_broadcast_to", f"SELECT b, i, j, v FROM {_M}, (SELECT unnest(range(3)) AS b)")(lambda spark, sf: sparse.broadcast_to(m(spark, sf), "b", 3))
for _name in ("crow_indices_copy", "coo_to_csr"):
    add(_name, f"SELECT n.i, (SELECT count(*) FROM {_M} m WHERE m.i < n.i) AS ptr FROM (SELECT unnest(range(0, (SELECT n + 1 FROM {_N}))) AS i) n")(lambda spark, sf: sparse.pointers(m(spark, sf), "i", _shape(spark, sf)))
for _name in ("ccol_indices", "ccol_indices_copy"):
    add(_name, f"SELECT n.j, (SELECT count(*) FROM {_M} m WHERE m.j < n.j) AS ptr FROM (SELECT unnest(range(0, 9)) AS j) n")(lambda spark, sf: sparse.pointers(m(spark, sf), "j", 8))
for _name in ("to_sparse_csr", "col_indices", "col_indices_copy"):
    add(_name, f"SELECT row_number() OVER (ORDER BY i, j) - 1 AS n, j, v FROM {_M}")(lambda spark, sf: sparse.to_csr(m(spark, sf), _shape(spark, sf))[1])
for _name in ("to_sparse_csc", "row_indices", "row_indices_copy"):
    add(_name, f"SELECT row_number() OVER (ORDER BY j, i) - 1 AS n, i, v FROM {_M}")(lambda spark, sf: sparse.to_csc(m(spark, sf), 8)[1])
add("csr_to_coo", f"SELECT i, j, v FROM {_M}")(lambda spark, sf: sparse.from_compressed(*sparse.to_csr(m(spark, sf), _shape(spark, sf)), "i"))
_BLOCK = f"(SELECT i // 2 AS bi, j // 2 AS bj, '[' || coalesce(sum(v) FILTER (WHERE i % 2 = 0 AND j % 2 = 0), 0)::VARCHAR || ', ' || coalesce(sum(v) FILTER (WHERE i % 2 = 0 AND j % 2 = 1), 0)::VARCHAR || ', ' || coalesce(sum(v) FILTER (WHERE i % 2 = 1 AND j % 2 = 0), 0)::VARCHAR || ', ' || coalesce(sum(v) FILTER (WHERE i % 2 = 1 AND j % 2 = 1), 0)::VARCHAR || ']' AS v FROM {_M} GROUP BY 1, 2)"


def _said(df):
    return df.withColumn("v", F.concat(F.lit("["), F.array_join(F.col("v").cast("array<string>"), ", "), F.lit("]")))


add("to_sparse_bsr", f"SELECT row_number() OVER (ORDER BY bi, bj) - 1 AS n, bj AS j, v FROM {_BLOCK}")(lambda spark, sf: _said(sparse.to_bsr(m(spark, sf), 2, 2, _shape(spark, sf))[1]))
add("to_sparse_bsc", f"SELECT row_number() OVER (ORDER BY bj, bi) - 1 AS n, bi AS i, v FROM {_BLOCK}")(lambda spark, sf: _said(sparse.to_bsc(m(spark, sf), 2, 2, 8)[1]))
add("flatten_indices", f"SELECT i * 8 + j AS flat, v FROM {_M}")(lambda spark, sf: m(spark, sf).select((F.col("i") * 8 + F.col("j")).alias("flat"), "v"))
add("sparse_csr_sum", f"SELECT i, CAST(sum(v) AS BIGINT) AS v FROM {_M} GROUP BY 1")(lambda spark, sf: sparse.row_sums(m(spark, sf)))
add("sparse_csr_prod", f"SELECT i, round(product(1 + v % 3), 4) AS v FROM {_M} GROUP BY 1")(lambda spark, sf: sparse.row_products(m(spark, sf).withColumn("v", 1 + F.col("v") % 3)).withColumn("v", F.round("v", 4)))
add("sparse_sum_backward", f"SELECT i, j, i + 1 AS v FROM {_M}")(lambda spark, sf: sparse.sum_backward(spark.range(_shape(spark, sf)).select(F.col("id").alias("i"), (F.col("id") + 1).alias("v")), m(spark, sf)).select("i", "j", "v"))
_SOFT = f"(SELECT i, j, exp(w - max(w) OVER r) / sum(exp(w - t)) OVER r AS y, w - t - ln(sum(exp(w - t)) OVER r) AS ly FROM (SELECT i, j, v / 100.0::DOUBLE AS w, max(v / 100.0::DOUBLE) OVER (PARTITION BY i) AS t FROM {_M}) WINDOW r AS (PARTITION BY i))"


def _soft(spark, sf):
    return sparse.softmax(m(spark, sf).withColumn("v", F.col("v") / 100.0))


add("sparse_softmax", f"SELECT i, j, round(y, 6) AS y FROM {_SOFT}")(lambda spark, sf: _soft(spark, sf).select("i", "j", F.round("softmax", 6).alias("y")))
add("sparse_log_softmax", f"SELECT i, j, round(ly, 6) + 0.0 AS y FROM {_SOFT}")(lambda spark, sf: _soft(spark, sf).select("i", "j", R(F.col("log_softmax"), 6).alias("y")))
add("sparse_softmax_backward_data", f"SELECT i, j, round(y * (j + 1 - sum((j + 1) * y) OVER (PARTITION BY i)), 6) + 0.0 AS v FROM {_SOFT}")(
    lambda spark, sf: sparse.softmax_backward(m(spark, sf).select("i", "j", (F.col("j") + 1.0).alias("g")), _soft(spark, sf).select("i", "j", F.col("softmax").alias("y"))).withColumn("v", R(F.col("v"), 6))
)
add("sparse_log_softmax_backward_data", f"SELECT i, j, round(j + 1 - y * sum(j + 1) OVER (PARTITION BY i), 6) + 0.0 AS v FROM {_SOFT}")(
    lambda spark, sf: sparse.softmax_backward(m(spark, sf).select("i", "j", (F.col("j") + 1.0).alias("g")), _soft(spark, sf).select("i", "j", F.col("log_softmax").alias("y")), log=True).withColumn("v", R(F.col("v"), 6))
)

# softmax and norms
_GROUPS = "(SELECT o_orderkey, o_custkey, o_totalprice / 100000 AS v, o_orderkey % 3 = 0 OR o_custkey % 5 = 0 AS hide FROM orders)"


def groups(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 100000).alias("v"), ((F.col("o_orderkey") % 3 == 0) | (F.col("o_custkey") % 5 == 0)).alias("hide"))


add("safe_softmax", f"SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE round(exp(v) / sum(exp(v)) OVER (PARTITION BY o_custkey), 6) END AS softmax FROM {_GROUPS}")(
    lambda spark, sf: norms.safe_softmax(groups(spark, sf).withColumn("v", F.when(F.col("o_custkey") % 5 == 0, float("-inf")).otherwise(F.col("v"))), ["o_custkey"], "v").select("o_orderkey", F.round("softmax", 6).alias("softmax"))
)
add("masked_softmax", f"SELECT o_orderkey, CASE WHEN hide THEN 0 ELSE round(exp(v) / sum(CASE WHEN hide THEN 0 ELSE exp(v) END) OVER (PARTITION BY o_custkey), 6) END AS softmax FROM {_GROUPS}")(
    lambda spark, sf: norms.masked_softmax(groups(spark, sf), ["o_custkey"], "v", "hide").select("o_orderkey", F.round("softmax", 6).alias("softmax"))
)
_Y = f"(SELECT *, exp(v) / sum(exp(v)) OVER (PARTITION BY o_custkey) AS y, v - ln(sum(exp(v)) OVER (PARTITION BY o_custkey)) AS ly, o_orderkey % 7 AS g FROM {_GROUPS})"


def _soft_rows(spark, sf):
    return r.softmax(groups(spark, sf), ["o_custkey"], "v").withColumn("g", (F.col("o_orderkey") % 7).cast("double"))


add("softmax_backward_data", f"SELECT o_orderkey, round(y * (g - sum(g * y) OVER (PARTITION BY o_custkey)), 6) + 0.0 AS v FROM {_Y}")(lambda spark, sf: norms.softmax_backward(_soft_rows(spark, sf), ["o_custkey"], "g", "softmax").select("o_orderkey", R(F.col("v"), 6).alias("v")))
add("log_softmax_backward_data", f"SELECT o_orderkey, round(g - y * sum(g) OVER (PARTITION BY o_custkey), 6) + 0.0 AS v FROM {_Y}")(lambda spark, sf: norms.softmax_backward(_soft_rows(spark, sf), ["o_custkey"], "g", "log_softmax", True).select("o_orderkey", R(F.col("v"), 6).alias("v")))
add("masked_softmax_backward", f"SELECT o_orderkey, CASE WHEN hide THEN 0 ELSE round(y * (g - sum(g * y) OVER (PARTITION BY o_custkey)), 6) + 0.0 END AS v FROM (SELECT *, CASE WHEN hide THEN 0 ELSE exp(v) / sum(CASE WHEN hide THEN 0 ELSE exp(v) END) OVER (PARTITION BY o_custkey) END AS y, o_orderkey % 7 AS g FROM {_GROUPS})")(
    lambda spark, sf: norms.softmax_backward(norms.masked_softmax(groups(spark, sf), ["o_custkey"], "v", "hide").drop("v").withColumn("g", (F.col("o_orderkey") % 7).cast("double")), ["o_custkey"], "g", "softmax").select("o_orderkey", R(F.col("v"), 6).alias("v"))
)
_LN = "(x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5)"
add("native_layer_norm", f"SELECT n, c, round({_LN} * (1 + c / 64.0::DOUBLE) + c / 10.0::DOUBLE, 5) + 0.0 AS v FROM {EMB} WINDOW w AS (PARTITION BY n)")(
    lambda spark, sf: norms.normalised(emb(spark, sf), ["n"], "x", weight=1 + F.col("c") / 64, bias=F.col("c") / 10).select("n", "c", R(F.col("normed")).alias("v"))
)
_NORM_GRAD = """WITH a AS (SELECT *, {k} AS k, (c + 1) / 64.0::DOUBLE * {w} AS g FROM {e}), b AS (SELECT *, (x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5) AS h, 1 / sqrt(var_pop(x) OVER w + 1e-5) AS s FROM a WINDOW w AS (PARTITION BY k))
SELECT n, c, round(s * (g - avg(g) OVER w - h * avg(g * h) OVER w), 4) + 0.0 AS v FROM b WINDOW w AS (PARTITION BY k)"""


def _norm_grad(key, weight=None):
    return lambda spark, sf: norms.normalised_backward(emb(spark, sf).withColumn("k", key()).withColumn("g", (F.col("c") + 1) / 64), ["k"], "x", "g", weight=weight() if weight else None).select("n", "c", R(F.col("v"), 4).alias("v"))


add("native_layer_norm_backward", _NORM_GRAD.format(k="n", w="(1 + c % 3)", e=EMB))(_norm_grad(lambda: F.col("n"), lambda: (1 + F.col("c") % 3).cast("double")))
for _name in ("group_norm", "native_group_norm"):
    add(_name, f"SELECT n, c, round((x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5) * (1 + c % 2), 5) + 0.0 AS v FROM {EMB} WINDOW w AS (PARTITION BY n, c // 16)")(
        lambda spark, sf: norms.normalised(emb(spark, sf).withColumn("g", F.floor(F.col("c") / 16)), ["n", "g"], "x", weight=1 + F.col("c") % 2).select("n", "c", R(F.col("normed")).alias("v"))
    )
add("native_group_norm_backward", _NORM_GRAD.format(k="n * 4 + c // 16", w="1", e=EMB))(_norm_grad(lambda: F.col("n") * 4 + F.floor(F.col("c") / 16)))
for _name in ("native_batch_norm", "native_batch_norm_legit", "batch_norm_with_update"):
    add(_name, f"SELECT n, c, round((x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5), 5) + 0.0 AS v FROM {EMB} WINDOW w AS (PARTITION BY c)")(lambda spark, sf: norms.normalised(emb(spark, sf), ["c"], "x").select("n", "c", R(F.col("normed")).alias("v")))
for _name in ("native_batch_norm_backward", "batch_norm_backward"):
    add(_name, _NORM_GRAD.format(k="c", w="(n % 4)", e=EMB))(
        lambda spark, sf: norms.normalised_backward(emb(spark, sf).withColumn("g", (F.col("c") + 1) / 64 * (F.col("n") % 4)), ["c"], "x", "g").select("n", "c", R(F.col("v"), 4).alias("v"))
    )
add("batch_norm_update_stats", f"SELECT c, round(0.9 * c / 64.0::DOUBLE + 0.1 * avg(x), 6) + 0.0 AS mean, round(0.9 + 0.1 * var_samp(x), 6) AS var FROM {EMB} GROUP BY c")(
    lambda spark, sf: norms.update_stats(norms.channel_stats(emb(spark, sf), "c", "x"), spark.range(64).select(F.col("id").alias("c"), (F.col("id") / 64).alias("mean"), F.lit(1.0).alias("var")), "c", 0.1).select("c", R(F.col("mean"), 6).alias("mean"), F.round("var", 6).alias("var"))
)
for _name in ("batch_norm_gather_stats", "batch_norm_gather_stats_with_counts"):
    add(_name, f"SELECT c, round(avg(x), 6) + 0.0 AS mean, round(1 / sqrt(var_pop(x) + 1e-5), 5) AS invstd FROM {EMB} GROUP BY c")(
        lambda spark, sf: norms.gather_stats(
            emb(spark, sf).groupBy("c", (F.col("n") % 3).alias("p")).agg(F.avg("x").alias("mean"), (1 / F.sqrt(F.var_pop("x") + 1e-5)).alias("invstd"), F.count("*").alias("n")), "c"
        ).select("c", R(F.col("mean"), 6).alias("mean"), F.round("invstd", 5).alias("invstd"))
    )


def _stats(spark, sf):
    return r.batch_norm_stats(emb(spark, sf), ["c"], "x")


def _affine(spark):
    """A weight and a bias for each channel."""
    return spark.range(64).select(F.col("id").alias("c"), (1 + F.col("id") / 64).alias("weight"), (F.col("id") % 3).cast("double").alias("bias"))


def _dy(spark, sf):
    return emb(spark, sf).withColumn("g", (F.col("n") % 5).cast("double"))


add("batch_norm_elemt", f"SELECT n, c, round((x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5) * (1 + c / 64.0::DOUBLE) + c % 3, 5) + 0.0 AS v FROM {EMB} WINDOW w AS (PARTITION BY c)")(lambda spark, sf: norms.elemt(emb(spark, sf), _stats(spark, sf), "c", "x", _affine(spark)).select("n", "c", R(F.col("normed")).alias("v")))
add("batch_norm_backward_reduce", f"SELECT c, sum(g)::DOUBLE AS sum_dy, round(sum(g * (x - u)), 4) + 0.0 AS sum_dy_xmu, round(sum(g * (x - u) * s), 4) + 0.0 AS dweight, sum(g)::DOUBLE AS dbias FROM (SELECT *, n % 5 AS g, avg(x) OVER w AS u, 1 / sqrt(var_pop(x) OVER w + 1e-5) AS s FROM {EMB} WINDOW w AS (PARTITION BY c)) GROUP BY c")(
    lambda spark, sf: norms.backward_reduce(_dy(spark, sf), _stats(spark, sf), "c", "x", "g").select("c", "sum_dy", R(F.col("sum_dy_xmu"), 4).alias("sum_dy_xmu"), R(F.col("dweight"), 4).alias("dweight"), "dbias")
)
add("batch_norm_backward_elemt", _NORM_GRAD.format(k="c", w="1", e=EMB).replace("(c + 1) / 64.0::DOUBLE * 1 AS g", "n % 5 AS g").replace("round(s *", "round((1 + c / 64.0::DOUBLE) * s *"))(
    lambda spark, sf: norms.backward_elemt(
        _dy(spark, sf), _stats(spark, sf), norms.backward_reduce(_dy(spark, sf), _stats(spark, sf), "c", "x", "g"), "c", "x", "g", _t(spark, sf, "embeddings").count(), _affine(spark)
    ).select("n", "c", R(F.col("v"), 4).alias("v"))
)
add("rms_norm", f"SELECT n, c, round(x / sqrt(avg(x * x) OVER w + 1e-6) * (1 + c % 2), 5) + 0.0 AS v FROM {EMB} WINDOW w AS (PARTITION BY n)")(lambda spark, sf: norms.rms_norm(emb(spark, sf), ["n"], "x", weight=1 + F.col("c") % 2).select("n", "c", R(F.col("normed")).alias("v")))
add("rms_norm_backward", f"SELECT n, c, round(s * (g - x * s * avg(g * x * s) OVER w), 4) + 0.0 AS v FROM (SELECT *, (c + 1) / 64.0::DOUBLE AS g, 1 / sqrt(avg(x * x) OVER (PARTITION BY n) + 1e-6) AS s FROM {EMB}) WINDOW w AS (PARTITION BY n)")(
    lambda spark, sf: norms.rms_norm_backward(emb(spark, sf).withColumn("g", (F.col("c") + 1) / 64), ["n"], "x", "g").select("n", "c", R(F.col("v"), 4).alias("v"))
)
for _name in ("weight_norm", "weight_norm_interface"):
    add(_name, f"SELECT n, c, round(x * (n % 3 + 1) / sqrt(sum(x * x) OVER (PARTITION BY n)), 5) + 0.0 AS w FROM {EMB}")(lambda spark, sf: norms.weight_norm(emb(spark, sf).withColumn("g", F.col("n") % 3 + 1), "n", "x", "g").select("n", "c", R(F.col("w")).alias("w")))
for _name in ("weight_norm_interface_backward", "weight_norm_differentiable_backward"):
    add(_name, f"SELECT n, c, round(z / s * (d - x * p / (s * s)), 5) + 0.0 AS dv, round(p / s, 5) + 0.0 AS dg FROM (SELECT *, n % 3 + 1 AS z, c + 1 AS d, sqrt(sum(x * x) OVER w) AS s, sum((c + 1) * x) OVER w AS p FROM {EMB} WINDOW w AS (PARTITION BY n))")(
        lambda spark, sf: norms.weight_norm_backward(emb(spark, sf).withColumn("g", F.col("n") % 3 + 1).withColumn("d", F.col("c") + 1), "n", "x", "g", "d").select("n", "c", R(F.col("dv")).alias("dv"), R(F.col("dg")).alias("dg"))
    )

# losses of classes: the first eight places of an embedding are classes' scores
_CLS = f"(SELECT n, c::INTEGER AS class, x, (n % 8)::INTEGER AS target, x - ln(sum(exp(x)) OVER (PARTITION BY n)) AS v FROM {EMB} WHERE c < 8)"


def classes(spark, sf):
    rows = emb(spark, sf).where("c < 8").select("n", F.col("c").cast("int").alias("class"), "x", (F.col("n") % 8).cast("int").alias("target"))
    return r.softmax(rows, ["n"], "x").withColumnRenamed("log_softmax", "v").drop("softmax")


_CW = "(CASE target WHEN 1 THEN 2.0 ELSE 1.0 END)"
_W8 = {k: 2.0 if k == 1 else 1.0 for k in range(8)}
for _name in ("nll_loss_forward", "nll_loss2d", "nll_loss2d_forward"):
    add(_name, f"SELECT n, round(-v * {_CW}, 6) + 0.0 AS loss, {_CW}::DOUBLE AS weight FROM {_CLS} WHERE class = target AND target <> 3")(lambda spark, sf: norms.nll(classes(spark, sf), ["n"], "target", _W8, 3).withColumn("loss", R(F.col("loss"), 6)))
for _name in ("nll_loss_backward", "nll_loss2d_backward"):
    add(_name, f"SELECT n, class, CASE WHEN class = target AND target <> 3 THEN -(n + 1) * {_CW} ELSE 0 END::DOUBLE AS v FROM {_CLS}")(lambda spark, sf: norms.nll_backward(classes(spark, sf).withColumn("g", F.col("n") + 1.0), "target", "g", _W8, 3).select("n", "class", "v"))
_MM = f"(SELECT *, max(x) FILTER (WHERE class = target) OVER (PARTITION BY n) AS o FROM {_CLS})"
add("multi_margin_loss", f"SELECT n, round(sum(pow(greatest(1 - o + x, 0), 2)) / 8, 5) AS loss FROM {_MM} WHERE class <> target GROUP BY 1")(
    lambda spark, sf: norms.multi_margin(classes(spark, sf).drop("v").withColumnRenamed("x", "v"), ["n"], "target", 8, 2).withColumn("loss", F.round("loss", 5))
)
add("multi_margin_loss_backward", f"SELECT n, class, round(CASE WHEN class = target THEN -sum(d) OVER (PARTITION BY n) ELSE d END, 5) + 0.0 AS dv FROM (SELECT *, CASE WHEN class <> target AND 1 - o + x > 0 THEN 2 * (1 - o + x) / 8 * (n + 1) ELSE 0 END AS d FROM {_MM})")(
    lambda spark, sf: norms.multi_margin_backward(classes(spark, sf).drop("v").withColumnRenamed("x", "v").withColumn("g", F.col("n") + 1.0), ["n"], "target", "g", 8, 2).select("n", "class", R(F.col("dv")).alias("dv"))
)
_ML = f"(SELECT n, class, x, (class + n) % 3 = 0 AS t FROM {_CLS})"


def multi(spark, sf):
    return classes(spark, sf).select("n", "class", F.col("x").alias("v"), ((F.col("class") + F.col("n")) % 3 == 0).alias("t"))


add("multilabel_margin_loss_forward", f"SELECT a.n, round(sum(greatest(1 - a.x + b.x, 0)) / 8, 5) AS loss FROM {_ML} a JOIN {_ML} b ON a.n = b.n AND a.t AND NOT b.t GROUP BY 1")(lambda spark, sf: norms.multilabel_margin(multi(spark, sf), ["n"], "t", 8).withColumn("loss", F.round("loss", 5)))
add("multilabel_margin_loss_backward", f"SELECT a.n, a.class, CASE WHEN a.t THEN -1 ELSE 1 END * count(*) FILTER (WHERE CASE WHEN a.t THEN 1 - a.x + b.x ELSE 1 - b.x + a.x END > 0) / 8.0::DOUBLE + 0.0 AS dv FROM {_ML} a JOIN {_ML} b ON a.n = b.n AND a.t <> b.t GROUP BY a.n, a.class, a.t")(
    lambda spark, sf: norms.multilabel_margin_backward(multi(spark, sf).withColumn("g", F.lit(1.0)), ["n"], "t", "g", 8).select("n", "class", (F.col("dv") + 0.0).alias("dv"))
)


@add("ctc_loss", """WITH f AS (SELECT vec_id AS n, t, [CAST(embedding[t * 3 + 1] AS DOUBLE), CAST(embedding[t * 3 + 2] AS DOUBLE), CAST(embedding[t * 3 + 3] AS DOUBLE)] AS x FROM embeddings, (SELECT unnest(range(3)) AS t)),
p AS (SELECT n, t, list_transform(x, lambda a: exp(a) / (exp(x[1]) + exp(x[2]) + exp(x[3]))) AS p FROM f),
w AS (SELECT a.n, a.p AS a, b.p AS b, c.p AS c FROM p a JOIN p b ON a.n = b.n AND a.t = 0 AND b.t = 1 JOIN p c ON c.n = a.n AND c.t = 2)
SELECT n, round(-ln(a[2] * b[3] * c[1] + a[2] * b[1] * c[3] + a[1] * b[2] * c[3] + a[2] * b[2] * c[3] + a[2] * b[3] * c[3]), 5) AS loss FROM w""")
def ctc_loss(spark, sf):
    """Labels 1, 2 over three frames of three classes: the SQL adds up the five paths."""
    frame = lambda t: F.transform(F.slice("embedding", t * 3 + 1, 3), lambda x: x.cast("double"))

    def log_shares(x):
        total = F.log(F.aggregate(x, F.lit(0.0), lambda s, y: s + F.exp(y)))
        return F.transform(x, lambda y: y - total)

    logs = F.array(*[log_shares(frame(t)) for t in range(3)])
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), F.round(norms.ctc(logs, F.array(F.lit(1), F.lit(2))), 5).alias("loss"))

# products: W is 64 x 8, from the first eight embeddings
_WT = f"(SELECT c AS i, n AS j, x AS v FROM {EMB} WHERE n < 8)"
_X = f"(SELECT n AS i, c AS j, x AS v FROM {EMB})"


def x_(spark, sf):
    return emb(spark, sf).select(F.col("n").alias("i"), F.col("c").alias("j"), F.col("x").alias("v"))


def w_(spark, sf):
    return emb(spark, sf).where("n < 8").select(F.col("c").alias("i"), F.col("n").alias("j"), F.col("x").alias("v"))


def shown(df, d=4):
    return df.withColumn("v", R(F.col("v"), d))


_MM_SQL = f"SELECT a.i, b.j, round(sum(a.v * b.v){{more}}, 4) + 0.0 AS v FROM {_X} a JOIN {_WT} b ON a.j = b.i GROUP BY 1, 2"
for _name in ("mm", "hspmm"):
    add(_name, _MM_SQL.format(more=""))(lambda spark, sf: shown(linalg.bmm(x_(spark, sf), w_(spark, sf))))
add("addmm", _MM_SQL.format(more=" * 2 + 0.5 * (a.i + b.j)"))(
    lambda spark, sf: shown(linalg.added(x_(spark, sf).select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("j")).distinct().withColumn("v", F.col("i") + F.col("j")), linalg.bmm(x_(spark, sf), w_(spark, sf)), ["i", "j"], 0.5, 2.0))
)
_B = f"(SELECT n AS b, c // 8 AS i, c % 8 AS j, x AS v FROM {EMB})"


def b_(spark, sf):
    return square(spark, sf).withColumnRenamed("n", "b")


add("bmm", f"SELECT x.b, x.i, y.j, round(sum(x.v * y.v), 4) + 0.0 AS v FROM {_B} x JOIN {_B} y ON x.b = y.b AND x.j = y.i GROUP BY 1, 2, 3")(lambda spark, sf: shown(linalg.bmm(b_(spark, sf), b_(spark, sf), ["b"])))
add("baddbmm", f"SELECT x.b, x.i, y.j, round(sum(x.v * y.v) + 3 * any_value(z.v), 4) + 0.0 AS v FROM {_B} x JOIN {_B} y ON x.b = y.b AND x.j = y.i JOIN {_B} z ON z.b = x.b AND z.i = x.i AND z.j = y.j GROUP BY 1, 2, 3")(
    lambda spark, sf: shown(linalg.added(b_(spark, sf), linalg.bmm(b_(spark, sf), b_(spark, sf), ["b"]), ["b", "i", "j"], 3.0))
)
add("mv", f"SELECT i, round(sum(v * (j + 1)), 4) + 0.0 AS v FROM {_X} GROUP BY 1")(lambda spark, sf: shown(linalg.mv(x_(spark, sf), spark.range(64).select(F.col("id").alias("j"), (F.col("id") + 1).alias("v")))))
add("addmv", f"SELECT i, round(2 * sum(v * (j + 1)) + i, 4) + 0.0 AS v FROM {_X} GROUP BY 1")(
    lambda spark, sf: shown(linalg.added(x_(spark, sf).select("i").distinct().withColumn("v", F.col("i").cast("double")), linalg.mv(x_(spark, sf), spark.range(64).select(F.col("id").alias("j"), (F.col("id") + 1).alias("v"))), ["i"], 1.0, 2.0))
)
add("addr", "SELECT i, j, round(3 * (i + 1) * (s_acctbal / 100) + i + j, 4) + 0.0 AS v FROM (SELECT unnest(range(6)) AS i), (SELECT s_suppkey AS j, s_acctbal FROM supplier)")(
    lambda spark, sf: shown(linalg.added(
        linalg.outer(spark.range(6).select(F.col("id").alias("i"), F.lit(1.0).alias("v")), _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("j"), F.lit(1.0).alias("v"))).withColumn("v", (F.col("i") + F.col("j")).cast("double")),
        linalg.outer(spark.range(6).select(F.col("id").alias("i"), (F.col("id") + 1).alias("v")), _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("j"), (F.col("s_acctbal") / 100).alias("v"))), ["i", "j"], 1.0, 3.0,
    ))
)
add("linear", _MM_SQL.format(more=" + any_value(b.j)"))(lambda spark, sf: shown(linalg.linear(x_(spark, sf), linalg.transposed(w_(spark, sf)), spark.range(8).select(F.col("id").alias("j"), F.col("id").alias("v")))))
SQL["linear"] = SQL["linear"].replace(" + any_value(b.j)", " + b.j")


def g_(spark, sf):
    """A gradient for the product: i + j."""
    return x_(spark, sf).select("i").distinct().select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("j")).withColumn("v", (F.col("i") % 5 + F.col("j")).cast("double"))


_DX = f"SELECT g.i, w.i AS j, round(sum((g.i % 5 + w.j) * w.v), 4) + 0.0 AS v FROM (SELECT vec_id AS i FROM embeddings) g, {_WT} w GROUP BY 1, 2"
_DW = f"SELECT x.j AS i, o AS j, round(sum((x.i % 5 + o) * x.v), 4) + 0.0 AS v FROM {_X} x, (SELECT unnest(range(8)) AS o) GROUP BY 1, 2"
add("matmul_backward", _DX)(lambda spark, sf: shown(linalg.matmul_backward(g_(spark, sf), x_(spark, sf), w_(spark, sf))[0]))
add("matmul_backward_right", _DW)(lambda spark, sf: shown(linalg.matmul_backward(g_(spark, sf), x_(spark, sf), w_(spark, sf))[1]))
add("linear_backward", _DX)(lambda spark, sf: shown(linalg.linear_backward(g_(spark, sf), x_(spark, sf), linalg.transposed(w_(spark, sf)))[0]))
add("linear_backward_bias", "SELECT o AS j, CAST(sum(vec_id % 5 + o) AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(8)) AS o) GROUP BY 1")(lambda spark, sf: shown(linalg.linear_backward(g_(spark, sf), x_(spark, sf), linalg.transposed(w_(spark, sf)))[2]))


def vecs(spark, sf):
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), F.transform("embedding", lambda x: x.cast("double")).alias("a"))


def _some(spark, sf):
    """A query set of rows: those of the first label."""
    return _t(spark, sf, "embeddings").where("label = 0").select(F.col("vec_id").alias("q"), F.transform("embedding", lambda x: x.cast("double")).alias("b"))


_PAIR = "(SELECT a.vec_id AS n, b.vec_id AS q, c, CAST(a.embedding[c + 1] AS DOUBLE) AS x, CAST(b.embedding[c + 1] AS DOUBLE) AS y FROM embeddings a, embeddings b, (SELECT unnest(range(64)) AS c) WHERE b.label = 0)"
for _name in ("cdist", "cdist_forward"):
    add(_name, f"SELECT n, q, round(sqrt(sum(pow(x - y, 2))), 4) AS d FROM {_PAIR} GROUP BY 1, 2")(lambda spark, sf: linalg.cdist(vecs(spark, sf), _some(spark, sf), "n", "a", "q", "b").withColumn("d", F.round("d", 4)))


add("cdist_backward", f"SELECT n, c, round(sum(CASE WHEN d = 0 THEN 0 ELSE (x - y) / d END), 4) + 0.0 AS v FROM (SELECT *, sqrt(sum(pow(x - y, 2)) OVER (PARTITION BY n, q)) AS d FROM {_PAIR}) GROUP BY 1, 2")(
    lambda spark, sf: shown(linalg.cdist_backward(vecs(spark, sf), _some(spark, sf), "n", "a", "q", "b"))
)
_PD = "(SELECT a.vec_id AS a, b.vec_id AS b, c, CAST(a.embedding[c + 1] AS DOUBLE) AS x, CAST(b.embedding[c + 1] AS DOUBLE) AS y FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = 1 AND b.label = 1, (SELECT unnest(range(64)) AS c))"


def _ones(spark, sf):
    return _t(spark, sf, "embeddings").where("label = 1").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


for _name in ("pdist", "pdist_forward"):
    add(_name, f"SELECT a, b, round(sum(abs(x - y)), 4) AS d FROM {_PD} GROUP BY 1, 2")(lambda spark, sf: linalg.pdist(_ones(spark, sf), "vec_id", "e", 1.0).withColumn("d", F.round("d", 4)))
add("pdist_backward", f"SELECT n, c, CAST(sum(v) AS DOUBLE) + 0.0 AS v FROM (SELECT a AS n, c, sign(x - y) AS v FROM {_PD} UNION ALL SELECT b AS n, c, sign(y - x) AS v FROM {_PD}) GROUP BY 1, 2")(
    lambda spark, sf: shown(linalg.pdist_backward(_ones(spark, sf), "vec_id", "e", 1.0)).withColumnRenamed("vec_id", "n")
)
_A3 = "SELECT vec_id AS n, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d, CAST(embedding[5] AS DOUBLE) AS e, CAST(embedding[6] AS DOUBLE) AS f, CAST(embedding[7] AS DOUBLE) AS g, CAST(embedding[8] AS DOUBLE) AS h, CAST(embedding[9] AS DOUBLE) + 2 AS i, CAST(embedding[10] AS DOUBLE) AS p, CAST(embedding[11] AS DOUBLE) AS q, CAST(embedding[12] AS DOUBLE) AS r FROM embeddings"
_DET = "(a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g))"


def matrices(spark, sf):
    """A 3 x 3 matrix and a right side of each embedding."""
    at = lambda k: F.col("a")[k]
    rows = F.array(F.array(at(0), at(1), at(2)), F.array(at(3), at(4), at(5)), F.array(at(6), at(7), at(8) + 2))
    return factor.held(vecs(spark, sf), m=rows, b=F.slice("a", 10, 3)).drop("a")


def three(spark, sf):
    """With the matrix's factors."""
    return factor.held(matrices(spark, sf), f=linalg.lu(F.col("m")))


for _name in ("det", "linalg_det", "_linalg_det"):
    add(_name if _name[0] != "_" else "linalg_det_kernel", f"SELECT n, round({_DET}, 6) + 0.0 AS v FROM ({_A3})")(lambda spark, sf: three(spark, sf).select("n", R(linalg.det(F.col("f")), 6).alias("v")))
for _name in ("slogdet", "linalg_slogdet", "linalg_slogdet_kernel"):
    add(_name, f"SELECT n, sign({_DET})::DOUBLE AS s, round(ln(abs({_DET})), 5) + 0.0 AS v FROM ({_A3})")(lambda spark, sf: three(spark, sf).withColumn("s", linalg.slogdet(F.col("f"))).select("n", F.col("s.sign").alias("s"), R(F.col("s.logabsdet"), 5).alias("v")))
_TRI = f"SELECT n, round(p / (a + 3), 5) + 0.0 AS x, round((q - d * p / (a + 3)) / (e + 3), 5) + 0.0 AS y FROM ({_A3})"
for _name in ("linalg_solve_triangular", "triangular_solve"):
    add(_name, _TRI)(
        lambda spark, sf: three(spark, sf).withColumn("t", F.transform("m", lambda row, i: F.transform(row, lambda v, j: F.when(i == j, v + (F.when(i < 2, 3.0).otherwise(1.0))).otherwise(v))))
        .withColumn("s", linalg.solve_triangular(F.col("t"), F.col("b"), False)).select("n", R(F.col("s")[0]).alias("x"), R(F.col("s")[1]).alias("y"))
    )
add("linalg_cross", f"SELECT n, round(b * f - c * e, 5) + 0.0 AS x, round(c * d - a * f, 5) + 0.0 AS y, round(a * e - b * d, 5) + 0.0 AS z FROM ({_A3})")(
    lambda spark, sf: vecs(spark, sf).withColumn("s", linalg.cross(F.slice("a", 1, 3), F.slice("a", 4, 3))).select("n", *[R(F.col("s")[k]).alias(c) for k, c in enumerate("xyz")])
)
add("compute_linear_combination", f"SELECT n, round(2 * a - 3 * d, 5) + 0.0 AS x, round(2 * c - 3 * f, 5) + 0.0 AS z FROM ({_A3})")(
    lambda spark, sf: vecs(spark, sf).withColumn("s", linalg.linear_combination([F.slice("a", 1, 3), F.slice("a", 4, 3)], [2.0, -3.0])).select("n", R(F.col("s")[0]).alias("x"), R(F.col("s")[2]).alias("z"))
)
# ragged arrays: the lengths of a conversation's texts
_CONV = "(SELECT conv_id, list(length(text)::DOUBLE ORDER BY turn) AS a FROM conversations GROUP BY 1)"


def ragged(spark, sf):
    return _t(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.length("text").cast("double").alias("n")))), lambda s: s["n"]).alias("a"))


def items(df, *more):
    return df.select("conv_id", F.posexplode("a").alias("k", "v"), *more).withColumn("k", F.col("k").cast("long"))


_ITEMS = "SELECT conv_id, unnest(range(len(a))) AS k, unnest(a) AS v FROM ({})"
for _name in ("nested_to_padded_tensor", "jagged_to_padded_dense_forward"):
    add(_name, _ITEMS.format(f"SELECT conv_id, list_resize(a, 4, -1.0::DOUBLE) AS a FROM {_CONV}"))(lambda spark, sf: items(ragged(spark, sf).withColumn("a", nested.to_padded(F.col("a"), 4, -1.0))))
for _name in ("nested_from_padded", "padded_dense_to_jagged_forward", "nested_from_padded_and_nested_example"):
    add(_name, _ITEMS.format(f"SELECT conv_id, a[1:3] AS a FROM {_CONV}"))(
        lambda spark, sf: items(ragged(spark, sf).select("conv_id", nested.from_padded(nested.to_padded(F.col("a"), 9, 0.0), F.least(F.size("a"), F.lit(3))).alias("a")))
    )
add("nested_tensor_size", f"SELECT conv_id, len(a) AS size FROM {_CONV}")(lambda spark, sf: nested.sizes(ragged(spark, sf), "a").drop("a"))
for _name in ("nested_tensor_storage_offsets", "nested_compute_contiguous_strides_offsets"):
    add(_name, f'SELECT conv_id, CAST(sum(len(a)) OVER (ORDER BY conv_id) - len(a) AS BIGINT) AS "offset" FROM {_CONV}')(lambda spark, sf: nested.offsets(ragged(spark, sf), "conv_id", "a").select("conv_id", "offset"))
for _name in ("nested_view_from_buffer", "nested_view_from_buffer_copy"):
    add(_name, _ITEMS.format(_CONV[1:-1]))(
        lambda spark, sf: items(nested.view_from_buffer(
            nested.offsets(ragged(spark, sf), "conv_id", "a").select("offset", F.posexplode("a").alias("k", "v")).select((F.col("offset") + F.col("k")).alias("at"), "v"), "at",
            nested.sizes(nested.offsets(ragged(spark, sf), "conv_id", "a"), "a").drop("a"), "conv_id",
        ))
    )
add("nested_tensor_from_mask", _ITEMS.format(f"SELECT conv_id, list_filter(a, lambda x: x > 100) AS a FROM {_CONV}"))(lambda spark, sf: items(ragged(spark, sf).select("conv_id", nested.from_mask(F.col("a"), F.transform("a", lambda x: x > 100)).alias("a"))))
add("nested_tensor_from_mask_left_aligned", f"SELECT conv_id, NOT list_contains(list_transform(range(1, len(a)), lambda k: a[k] <= 100 AND a[k + 1] > 100), true) AS aligned FROM {_CONV}")(
    lambda spark, sf: ragged(spark, sf).select("conv_id", nested.left_aligned(F.transform("a", lambda x: x > 100)).alias("aligned"))
)
add("nested_tensor_softmax_with_shape", f"SELECT conv_id, k, round(v, 6) AS v FROM ({_ITEMS.format(f'SELECT conv_id, list_transform(a, lambda x: exp((x - list_max(a)) / 100) / list_sum(list_transform(a, lambda y: exp((y - list_max(a)) / 100)))) AS a FROM {_CONV}')})")(
    lambda spark, sf: items(ragged(spark, sf).select("conv_id", nested.softmax(F.transform("a", lambda x: x / 100)).alias("a"))).withColumn("v", F.round("v", 6))
)
add("nested_select_backward", _ITEMS.format(f"SELECT conv_id, list_transform(range(len(a)), lambda k: CASE WHEN k = 1 THEN conv_id ELSE 0 END::DOUBLE) AS a FROM {_CONV}"))(
    lambda spark, sf: items(ragged(spark, sf).select("conv_id", nested.select_backward(F.col("conv_id").cast("double"), F.size("a"), 1).alias("a")))
)
add("nested_dense_mul", _ITEMS.format(f"SELECT conv_id, list_transform(a, lambda x: x * conv_id) AS a FROM {_CONV}"))(lambda spark, sf: items(ragged(spark, sf).select("conv_id", nested.with_dense(F.col("a"), F.col("conv_id"), lambda v, x: v * x).alias("a"))))

# quantised columns
_BAL = "SELECT c_custkey, c_nationkey, c_acctbal AS x FROM customer"


def bal(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("x"))


_Q = "least(greatest(round_even(x / s, 0) + z, -128), 127)"
add("quantize_per_tensor_dynamic", f"WITH e AS (SELECT (greatest(max(c_acctbal), 0) - least(min(c_acctbal), 0)) / 255 AS s, least(min(c_acctbal), 0) AS lo FROM customer), p AS (SELECT s, least(greatest(-128 - round_even(lo / s, 0), -128), 127) AS z FROM e) SELECT c_custkey, CAST({_Q} AS INTEGER) AS q FROM ({_BAL}), p")(
    lambda spark, sf: nested.quantize_dynamic(bal(spark, sf), "x").select("c_custkey", "q")
)


def _params(spark):
    return spark.range(25).select(F.col("id").cast("int").alias("c_nationkey"), (F.col("id") * 4.0 + 10).alias("scale"), (F.col("id") % 5 - 2).cast("int").alias("zero"))


_PC = f"(SELECT *, c_nationkey * 4.0::DOUBLE + 10 AS s, c_nationkey % 5 - 2 AS z FROM ({_BAL}))"
add("quantize_per_channel", f"SELECT c_custkey, CAST({_Q} AS INTEGER) AS q FROM {_PC}")(lambda spark, sf: nested.quantize_per_channel(bal(spark, sf), _params(spark), "c_nationkey", "x").select("c_custkey", "q"))
for _name in ("make_per_channel_quantized_tensor", "dequantize"):
    add(_name, f"SELECT c_custkey, round(({_Q} - z) * s, 6) + 0.0 AS v FROM {_PC}")(lambda spark, sf: nested.quantize_per_channel(bal(spark, sf), _params(spark), "c_nationkey", "x").select("c_custkey", R(nested.made(F.col("q"), F.col("scale"), F.col("zero")), 6).alias("v")))
_FQ = "round_even(x / s, 0) + z"
for _name in ("fake_quantize_per_tensor_affine_cachemask", "fake_quantize_per_tensor_affine_cachemask_tensor_qparams", "fake_quantize_learnable_per_tensor_affine"):
    add(_name, f"SELECT c_custkey, round(({_Q} - z) * s, 6) + 0.0 AS v, {_FQ} BETWEEN -128 AND 127 AS mask FROM (SELECT *, 20.0::DOUBLE AS s, 3 AS z FROM ({_BAL}))")(
        lambda spark, sf: bal(spark, sf).withColumn("f", nested.fake_quantize(F.col("x"), F.lit(20.0), F.lit(3))).select("c_custkey", R(F.col("f.v"), 6).alias("v"), "f.mask")
    )
add("make_per_tensor_quantized_tensor", "SELECT c_custkey, round((c_custkey % 256 - 131) * 0.037::DOUBLE, 9) + 0.0 AS v FROM customer")(
    lambda spark, sf: _t(spark, sf, "customer").select("c_custkey", R(nested.made((F.col("c_custkey") % 256 - 128).cast("int"), F.lit(0.037), F.lit(3)), 9).alias("v"))
)
add("quantize_float_qparams", "SELECT c_custkey, CAST(least(greatest(round_even(c_acctbal * (1 / 40.0::DOUBLE) + c_nationkey / 4.0::DOUBLE, 0), 0), 255) AS INTEGER) AS q FROM customer")(
    lambda spark, sf: _t(spark, sf, "customer").select("c_custkey", nested.quantize_float_qparams(F.col("c_acctbal"), F.lit(40.0), F.col("c_nationkey") / 4).alias("q"))
)
for _name in ("fake_quantize_per_channel_affine_cachemask", "fake_quantize_learnable_per_channel_affine"):
    add(_name, f"SELECT c_custkey, round(({_Q} - z) * s, 6) + 0.0 AS v, {_FQ} BETWEEN -128 AND 127 AS mask FROM {_PC}")(
        lambda spark, sf: bal(spark, sf).join(_params(spark), "c_nationkey").withColumn("f", nested.fake_quantize(F.col("x"), F.col("scale"), F.col("zero"))).select("c_custkey", R(F.col("f.v"), 6).alias("v"), "f.mask")
    )
_LB = f"SELECT {{k}}, CAST(sum(CASE WHEN {_FQ} BETWEEN -128 AND 127 THEN 1 ELSE 0 END) AS DOUBLE) AS dx, round(sum(CASE WHEN {_FQ} BETWEEN -128 AND 127 THEN round_even(x / s, 0) - x / s WHEN {_FQ} < -128 THEN -128 - z ELSE 127 - z END), 4) + 0.0 AS dscale, round(sum(CASE WHEN {_FQ} BETWEEN -128 AND 127 THEN 0 ELSE -s END), 4) + 0.0 AS dzero FROM {{f}} GROUP BY 1"


def _learned(df, key):
    each = df.withColumn("b", nested.learnable_backward(F.col("x"), F.lit(1.0), F.col("scale"), F.col("zero")))
    return each.groupBy(key).agg(*[R(F.sum(f"b.{c}"), 4).alias(c) for c in ("dx", "dscale", "dzero")])


add("fake_quantize_learnable_per_tensor_affine_backward", _LB.format(k="1 AS one", f=f"(SELECT *, 20.0::DOUBLE AS s, 3 AS z FROM ({_BAL}))"))(lambda spark, sf: _learned(bal(spark, sf).withColumns({"scale": F.lit(20.0), "zero": F.lit(3), "one": F.lit(1)}), "one"))
add("fake_quantize_learnable_per_channel_affine_backward", _LB.format(k="c_nationkey", f=_PC))(lambda spark, sf: _learned(bal(spark, sf).join(_params(spark), "c_nationkey"), "c_nationkey"))
add("fused_moving_avg_obs_fq_helper", "SELECT round(-100 + 0.01 * (min(c_acctbal) + 100), 6) AS lo, round(5000 + 0.01 * (max(c_acctbal) - 5000), 6) AS hi FROM customer")(
    lambda spark, sf: nested.moving_range(bal(spark, sf).agg(F.min("x").alias("lo"), F.max("x").alias("hi")), spark.range(1).select(F.lit(-100.0).alias("lo"), F.lit(5000.0).alias("hi")), 0.01).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))
)


def _four(spark, sf):
    return vecs(spark, sf).select("n", "a", nested.pack_int4(F.transform("a", lambda x: F.pmod(F.floor(x * 100).cast("int"), F.lit(16)))).alias("p"))


_NIB = "((floor(x * 100)::BIGINT % 16 + 16) % 16)"
add("convert_weight_to_int4pack", f"SELECT n, k, CAST(sum({_NIB} * CASE c % 2 WHEN 0 THEN 16 ELSE 1 END) AS INTEGER) AS v FROM (SELECT *, c // 2 AS k FROM {EMB}) GROUP BY 1, 2")(lambda spark, sf: _four(spark, sf).select("n", F.posexplode("p").alias("k", "v")).withColumn("k", F.col("k").cast("long")))
add("weight_int4pack_mm", f"SELECT n, round(sum(x * ({_NIB} - 8) * 0.5 + x * 0.25), 4) + 0.0 AS v FROM {EMB} GROUP BY 1")(lambda spark, sf: _four(spark, sf).select("n", R(nested.int4_mm(F.col("a"), F.col("p"), F.lit(0.5), F.lit(0.25)), 4).alias("v")))

# recurrent cells, attention, optimiser steps, loss scaling: gates are places of an embedding
_S = "(1 / (1 + exp(-({}))))".format
_T = "(1 - 2 / (exp(2 * ({})) + 1))".format
_CELL = f"({_S('b')} * e + {_S('a')} * {_T('c')})"
_g = lambda *ks: [F.col("a")[k] for k in ks]
for _name in ("lstm_cell", "thnn_fused_lstm_cell"):
    add(_name, f"SELECT n, round({_S('d')} * {_T(_CELL)}, 5) + 0.0 AS h, round({_CELL}, 5) + 0.0 AS c FROM ({_A3})")(lambda spark, sf: vecs(spark, sf).withColumn("s", nested.lstm_cell(*_g(0, 1, 2, 3, 4))).select("n", R(F.col("s.h")).alias("h"), R(F.col("s.c")).alias("c")))
add("thnn_fused_lstm_cell_backward", f"""SELECT n, round(dc * gt * it * (1 - it), 5) + 0.0 AS di, round(dc * e * ft * (1 - ft), 5) + 0.0 AS df, round(dc * it * (1 - gt * gt), 5) + 0.0 AS dg, round(f * t * ot * (1 - ot), 5) + 0.0 AS "do", round(dc * ft, 5) + 0.0 AS dc
FROM (SELECT *, g + f * ot * (1 - t * t) AS dc FROM (SELECT *, {_S('a')} AS it, {_S('b')} AS ft, {_T('c')} AS gt, {_S('d')} AS ot, {_T(_CELL)} AS t FROM ({_A3})))""")(
    lambda spark, sf: vecs(spark, sf).withColumn("s", nested.lstm_cell_backward(*_g(0, 1, 2, 3, 4, 5, 6))).select("n", *[R(F.col("s").getField(c)).alias(c) for c in ("di", "df", "dg", "do", "dc")])
)
_RZ = f"(SELECT *, {_S('a + b')} AS rt, {_S('c + d')} AS zt FROM ({_A3}))"
for _name in ("gru_cell", "thnn_fused_gru_cell"):
    add(_name, f"SELECT n, round((1 - zt) * {_T('e + rt * f')} + zt * g, 5) + 0.0 AS h FROM {_RZ}")(lambda spark, sf: vecs(spark, sf).select("n", R(nested.gru_cell(_g(0, 1), _g(2, 3), _g(4, 5), _g(6)[0])).alias("h")))
add("thnn_fused_gru_cell_backward", f"""SELECT n, round(dn * f * rt * (1 - rt), 5) + 0.0 AS dr, round(h * (g - nt) * zt * (1 - zt), 5) + 0.0 AS dz, round(dn, 5) + 0.0 AS dn_in, round(dn * rt, 5) + 0.0 AS dn_hidden, round(h * zt, 5) + 0.0 AS dh
FROM (SELECT *, h * (1 - zt) * (1 - nt * nt) AS dn FROM (SELECT *, {_T('e + rt * f')} AS nt FROM {_RZ}))""")(
    lambda spark, sf: vecs(spark, sf).withColumn("s", nested.gru_cell_backward(_g(0, 1), _g(2, 3), _g(4, 5), _g(6)[0], _g(7)[0])).select("n", *[R(F.col("s").getField(c)).alias(c) for c in ("dr", "dz", "dn_in", "dn_hidden", "dh")])
)


def _heads(spark, sf):
    part = lambda k, n=8: F.transform(F.slice("embedding", k, n), lambda x: x.cast("double"))
    rows = _t(spark, sf, "embeddings").select(F.col("label").alias("head"), F.col("vec_id").alias("i"), part(1).alias("q"), part(9).alias("k"), part(17, 2).alias("v"))
    return rows.select("head", "i", "q"), rows.select("head", F.col("i").alias("j"), "k", "v")


_ATT = """WITH s AS (SELECT a.label AS head, a.vec_id AS i, exp(list_dot_product(a.embedding[1:8]::DOUBLE[], b.embedding[9:16]::DOUBLE[]) * 0.5) AS w, CAST(b.embedding[17] AS DOUBLE) AS v FROM embeddings a JOIN embeddings b ON a.label = b.label {c})
SELECT head, i, round(sum(w * v) / sum(w), 5) + 0.0 AS v FROM s GROUP BY 1, 2"""
for _name, _causal in (("scaled_dot_product_efficient_attention", False), ("flash_attention", False), ("flash_attention_causal", True)):
    add(_name, _ATT.format(c="AND b.vec_id <= a.vec_id" if _causal else ""))(lambda spark, sf, causal=_causal: more.attention(*_heads(spark, sf), 0.5, causal).select("head", "i", R(F.col("out")[0]).alias("v")))
_OPT = "(SELECT c_custkey, c_acctbal / 1000 AS p, c_nationkey - 12.5::DOUBLE AS g FROM customer)"


def steps(spark, sf):
    rows = _t(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("p"), (F.col("c_nationkey") - 12.5).alias("g"))
    return rows.withColumns({"m": F.lit(0.5), "s": F.lit(2.0), "buf": F.lit(1.0)})


add("fused_sgd", f"SELECT c_custkey, round(p - 0.1 * (0.9 + g + 0.01 * p), 6) + 0.0 AS p FROM {_OPT}")(lambda spark, sf: more.sgd(steps(spark, sf), 0.1, 0.9, decay=0.01).select("c_custkey", R(F.col("p"), 6).alias("p")))
_ADAM = "SELECT c_custkey, round({p} - 0.1 * ((0.45 + 0.1 * {g}) / (1 - pow(0.9, 3))) / (sqrt((1.998 + 0.001 * {g} * {g}) / (1 - pow(0.999, 3))) + 1e-8), 6) + 0.0 AS p FROM " + _OPT
add("fused_adam", _ADAM.format(p="p", g="(g + 0.01 * p)"))(lambda spark, sf: more.adam(steps(spark, sf), 3, 0.1, decay=0.01).select("c_custkey", R(F.col("p"), 6).alias("p")))
add("fused_adamw", _ADAM.format(p="p * (1 - 0.001)", g="g"))(lambda spark, sf: more.adam(steps(spark, sf), 3, 0.1, decay=0.01, decoupled=True).select("c_custkey", R(F.col("p"), 6).alias("p")))
add("amp_foreach_non_finite_check_and_unscale", "SELECT c_custkey, c_acctbal / 8 AS x, 1.0::DOUBLE AS found_inf FROM customer")(
    lambda spark, sf: nested.unscale(_t(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("x")), "x", 8.0).crossJoin(
        F.broadcast(nested.found_inf(_t(spark, sf, "customer").select(F.when(F.col("c_custkey") == 1, float("inf")).otherwise(F.col("c_acctbal")).alias("x")), "x"))
    )
)
SQL["amp_foreach_non_finite_check_and_unscale"] = "SELECT c_custkey, c_acctbal / 8 AS x, (SELECT max(c_custkey = 1)::INTEGER::DOUBLE FROM customer) AS found_inf FROM customer"
add("amp_update_scale", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 32.0 WHEN c_custkey % 7 = 6 THEN 128.0 ELSE 64.0 END::DOUBLE AS scale, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 6 THEN 0 ELSE c_custkey % 7 + 1 END AS good_steps FROM customer")(
    lambda spark, sf: _t(spark, sf, "customer").withColumn("s", nested.update_scale(F.lit(64.0), F.col("c_custkey") % 7, (F.col("c_custkey") % 5 == 0).cast("int"), interval=7)).select("c_custkey", "s.scale", "s.good_steps")
)
_QKV = f"SELECT n, c // 16 AS head, c % 16 AS d, round((x + c / 10.0::DOUBLE) / 4, 6) + 0.0 AS q FROM {EMB}"
add("transform_bias_rescale_qkv", _QKV)(lambda spark, sf: more.view(emb(spark, sf).select("n", "c", (F.col("x") + F.col("c") / 10).alias("x")), {"c": 64}, {"head": 4, "d": 16}).select("n", "head", "d", R(F.col("x") / math.sqrt(16), 6).alias("q")))

# random columns: what holds for every seed
_DRAWS = {
    "uniform": (lambda: random.uniform(2, 5, 1), "v >= 2 AND v < 5", 3.5, 0.9), "random": (lambda: random.random_integer(3, 9, 2), "v >= 3 AND v < 9 AND v = floor(v)", 5.5, 1.8), "normal": (lambda: random.normal(1, 2, 3), "NOT isnan(v)", 1.0, 2.0),
    "normal_functional": (lambda: random.normal(1, 2, 3), "NOT isnan(v)", 1.0, 2.0), "bernoulli": (lambda: random.bernoulli(0.3, 4), "v IN (0, 1)", 0.3, 0.46), "log_normal": (lambda: random.log_normal(0, 0.5, 5), "v > 0", 1.133, 0.604), "exponential": (lambda: random.exponential(2.0, 6), "v >= 0", 0.5, 0.5),
    "geometric": (lambda: random.geometric(0.25, 7), "v >= 1 AND v = floor(v)", 4.0, 3.46), "poisson": (lambda: random.poisson(F.lit(4.0), 8), "v >= 0 AND v = floor(v)", 4.0, 2.0), "poisson_40": (lambda: random.poisson(F.lit(40.0), 18), "v >= 0 AND v = floor(v)", 40.0, 6.3246),
    "poisson_million": (lambda: random.poisson(F.lit(1e6), 28), "v >= 0 AND v = floor(v)", 1e6, 1000.0), "binomial_million": (lambda: random.binomial(1_000_000, F.lit(0.9), 19), "v BETWEEN 0 AND 1000000 AND v = floor(v)", 900000.0, 300.0), "binomial": (lambda: random.binomial(20, F.lit(0.4), 9), "v BETWEEN 0 AND 20 AND v = floor(v)", 8.0, 2.19),
    "standard_gamma": (lambda: random.standard_gamma(F.lit(2.5), 10), "v > 0", 2.5, 1.58), "cauchy": (lambda: F.atan(random.cauchy(0, 1, 11)), "abs(v) < 1.5708", 0.0, 0.907), "native_dropout": (lambda: random.dropout(F.lit(3.0), 0.4, 12)["v"], "v IN (0, 5)", 3.0, 2.45),
    "fused_dropout": (lambda: random.dropout(F.lit(3.0), 0.4, 12)["v"], "v IN (0, 5)", 3.0, 2.45), "fill_mem_eff_dropout_mask": (lambda: random.uniform(0, 1, 13), "v >= 0 AND v < 1", 0.5, 0.29),
}


def _draw(make, rule, mean, std):
    """Whether all draws of a row for each event obey the rule, their mean lies within five standard errors and their deviation within a fifth."""

    def run(spark, sf):
        rows = _t(spark, sf, "events").select(make().cast("double").alias("v"))
        near = F.abs(F.avg("v") - mean) < 5 * std / F.sqrt(F.count("*").cast("double"))
        spread = F.abs(F.stddev("v") / std - 1) < 0.2
        return rows.agg(F.count("*").alias("n"), F.bool_and(F.expr(rule)).alias("inside"), near.alias("near"), spread.alias("spread"))

    return run


for _name, _spec in _DRAWS.items():
    add(f"random_{_name}", "SELECT count(*) AS n, true AS inside, true AS near, true AS spread FROM events")(_draw(*_spec))
add("sample_dirichlet", "SELECT user_id, 1.0::DOUBLE AS total FROM events GROUP BY 1")(lambda spark, sf: random.dirichlet(_t(spark, sf, "events").select("user_id", F.lit(1.5).alias("a")), ["user_id"], "a", 1).groupBy("user_id").agg(F.round(F.sum("v"), 6).alias("total")))
add("multinomial", "SELECT user_id, least(count(*), 3) AS n FROM events WHERE value > 0 GROUP BY 1")(lambda spark, sf: random.multinomial(_t(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "value", 3).groupBy("user_id").agg(F.countDistinct("event_id").alias("n")))
_BELOW = "pow(x, {a}) * exp(-x) * list_sum(list_transform(range(0, 60), lambda n: pow(x, n) / gamma({a} + n + 1)))"
add("standard_gamma_grad", f"SELECT c_custkey, round(-({_BELOW.format(a='1.5001')} - {_BELOW.format(a='1.4999')}) / 0.0002 / (sqrt(x) * exp(-x) / gamma(1.5)), 3) + 0.0 AS v FROM (SELECT c_custkey, (c_custkey % 97 + 1) / 40.0::DOUBLE AS x FROM customer)")(
    lambda spark, sf: _t(spark, sf, "customer").withColumn("x", (F.col("c_custkey") % 97 + 1) / 40.0).select("c_custkey", R(random.standard_gamma_grad(F.lit(1.5), F.col("x")), 3).alias("v"))
)


def _weighted_items(spark, sf):
    """Three items of the weights 1, 2 and 5 for each event."""
    return _t(spark, sf, "events").select("event_id", F.explode(F.array(*[F.lit(w) for w in (1.0, 2.0, 5.0)])).alias("w"))


def _near(df, seen, mean, spread):
    """Whether a mean over all events lies within five standard errors, for each weight."""
    n = F.count("*").cast("double")
    return df.groupBy("w").agg((F.abs(F.avg(seen) - mean) < 5 * spread / F.sqrt(n)).alias("near"))


add("multinomial_rates", "SELECT w, true AS near FROM (SELECT unnest([1.0, 2.0, 5.0]::DOUBLE[]) AS w) WHERE (SELECT count(*) FROM events) > 0")(
    lambda spark, sf: _near(
        _weighted_items(spark, sf).join(random.multinomial(_weighted_items(spark, sf), ["event_id"], "w", 1, 5).withColumn("hit", F.lit(1.0)), ["event_id", "w"], "left").fillna(0.0, ["hit"]),
        "hit", F.first("w") / 8, F.sqrt(F.first("w") / 8 * (1 - F.first("w") / 8)),
    )
)
add("sample_dirichlet_moments", "SELECT w, true AS near FROM (SELECT unnest([1.0, 2.0, 5.0]::DOUBLE[]) AS w) WHERE (SELECT count(*) FROM events) > 0")(
    lambda spark, sf: _near(random.dirichlet(_weighted_items(spark, sf), ["event_id"], "w", 7), "v", F.first("w") / 8, F.sqrt(F.first("w") * (8 - F.first("w")) / (64 * 9)))
)


# what has several parts
_PATHS = "(SELECT n, a, b, c, a[2] * b[3] * c[1] AS p1, a[2] * b[1] * c[3] AS p2, a[1] * b[2] * c[3] AS p3, a[2] * b[2] * c[3] AS p4, a[2] * b[3] * c[3] AS p5 FROM w)"


def _frames():
    def log_shares(t):
        x = F.transform(F.slice("embedding", t * 3 + 1, 3), lambda v: v.cast("double"))
        total = F.log(F.aggregate(x, F.lit(0.0), lambda s, y: s + F.exp(y)))
        return F.transform(x, lambda y: y - total)

    return F.array(*[log_shares(t) for t in range(3)])


add("ctc_loss_backward", SQL["ctc_loss"][: SQL["ctc_loss"].index("SELECT n, round(-ln(")] + f"SELECT n, round(-p3 / (p1 + p2 + p3 + p4 + p5), 5) + 0.0 AS blank, round(-(p1 + p2 + p4 + p5) / (p1 + p2 + p3 + p4 + p5), 5) + 0.0 AS one, round(-(p1 + p5) / (p1 + p2 + p3 + p4 + p5), 5) + 0.0 AS mid FROM {_PATHS}")(
    lambda spark, sf: _t(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), norms.ctc_backward(_frames(), F.array(F.lit(1), F.lit(2))).alias("g"))
    .select("n", R(F.col("g")[0][0]).alias("blank"), R(F.col("g")[0][1]).alias("one"), R(F.col("g")[1][2]).alias("mid"))
)
_PAIRS = """WITH s AS (SELECT a.label AS head, a.vec_id AS i, b.vec_id AS j, exp(list_dot_product(a.embedding[1:8]::DOUBLE[], b.embedding[9:16]::DOUBLE[]) * 0.5) AS w, (a.vec_id % 3) * CAST(b.embedding[17] AS DOUBLE) + CAST(b.embedding[18] AS DOUBLE) AS d
FROM embeddings a JOIN embeddings b ON a.label = b.label), p AS (SELECT *, w / sum(w) OVER (PARTITION BY i) AS p FROM s), g AS (SELECT *, p * (d - sum(p * d) OVER (PARTITION BY i)) * 0.5 AS ds FROM p)
"""


def _attention_grads(spark, sf):
    q, kv = _heads(spark, sf)
    grad = q.select("head", "i", F.array((F.col("i") % 3).cast("double"), F.lit(1.0)).alias("g"))
    return more.attention_backward(q, kv, grad, 0.5)


for _name, _part, _sql in (
    ("scaled_dot_product_efficient_attention_backward", 0, "SELECT g.head, g.i, round(sum(ds * CAST(e.embedding[9] AS DOUBLE)), 4) + 0.0 AS v FROM g JOIN embeddings e ON e.vec_id = g.j GROUP BY 1, 2"),
    ("flash_attention_backward_k", 1, "SELECT g.head, g.j, round(sum(ds * CAST(e.embedding[1] AS DOUBLE)), 4) + 0.0 AS v FROM g JOIN embeddings e ON e.vec_id = g.i GROUP BY 1, 2"),
    ("flash_attention_backward_v", 2, "SELECT head, j, round(sum(p * (i % 3)), 4) + 0.0 AS v FROM g GROUP BY 1, 2"),
):
    add(_name, _PAIRS + _sql)(lambda spark, sf, part=_part: shown(_attention_grads(spark, sf)[part].where("c = 0").drop("c")))


def _tokens(spark, sf):
    """Four tokens of eight numbers in each sequence: half of an embedding."""
    return emb(spark, sf).where("c < 32").select(F.col("n").alias("seq"), F.floor(F.col("c") / 8).alias("t"), (F.col("c") % 8).alias("j"), F.col("x").alias("v"))


def _weights(spark, rows: int, cols: int, k: int):
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("i"), (F.col("id") % cols).alias("j"), ((F.col("id") * k % 11 - 5) / 10).alias("v"))


_w = lambda rows, cols, k: f"(SELECT id // {cols} AS i, id % {cols} AS j, (id * {k} % 11 - 5) / 10.0::DOUBLE AS v FROM (SELECT unnest(range({rows * cols})) AS id))"
_TOK = f"tok AS (SELECT n AS seq, c // 8 AS t, c % 8 AS j, x AS v FROM {EMB} WHERE c < 32)"
_MHA = f"""{_TOK}, pr AS (SELECT seq, t, w.i AS o, sum(tok.v * w.v) AS v FROM tok JOIN {_w(24, 8, 3)} w ON w.j = tok.j GROUP BY ALL),
sc AS (SELECT q.seq, q.t, k.t AS u, (q.o % 8) // 4 AS h, exp(sum(q.v * k.v) / 2) AS w FROM pr q JOIN pr k ON q.seq = k.seq AND q.o < 8 AND k.o = q.o + 8 GROUP BY ALL),
at AS (SELECT sc.seq, sc.t, v.o - 16 AS j, sum(sc.w * v.v) / sum(sc.w) AS v FROM sc JOIN pr v ON v.seq = sc.seq AND v.t = sc.u AND v.o >= 16 AND (v.o - 16) // 4 = sc.h GROUP BY ALL),
mh AS (SELECT "at".seq, "at".t, w.i AS j, sum("at".v * w.v) AS v FROM "at" JOIN {_w(8, 8, 5)} w ON w.j = "at".j GROUP BY ALL)""".replace("\nat AS", '\n"at" AS')
add("native_multi_head_attention", f"WITH {_MHA} SELECT seq, t, j, round(v, 4) + 0.0 AS v FROM mh")(lambda spark, sf: shown(more.multi_head_attention(_tokens(spark, sf), _weights(spark, 24, 8, 3), 2, 8, _weights(spark, 8, 8, 5))))
_LNORM = "(v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5)"
add("transformer_encoder_layer_fwd", f"""WITH {_MHA}, m1 AS (SELECT seq, t, j, {_LNORM} AS v FROM (SELECT tok.seq, tok.t, tok.j, tok.v + mh.v AS v FROM tok JOIN mh USING (seq, t, j)) WINDOW w AS (PARTITION BY seq, t)),
hid AS (SELECT seq, t, w.i AS j, greatest(sum(m1.v * w.v), 0) AS v FROM m1 JOIN {_w(16, 8, 7)} w ON w.j = m1.j GROUP BY ALL), ff AS (SELECT seq, t, w.i AS j, sum(hid.v * w.v) AS v FROM hid JOIN {_w(8, 16, 2)} w ON w.j = hid.j GROUP BY ALL)
SELECT seq, t, j, round({_LNORM}, 3) + 0.0 AS v FROM (SELECT m1.seq, m1.t, m1.j, m1.v + ff.v AS v FROM m1 JOIN ff USING (seq, t, j)) WINDOW w AS (PARTITION BY seq, t)""")(
    lambda spark, sf: shown(more.encoder_layer(_tokens(spark, sf), _weights(spark, 24, 8, 3), _weights(spark, 8, 8, 5), _weights(spark, 16, 8, 7), _weights(spark, 8, 16, 2), 2, 8), 3)
)
# a beta number's slope at shapes 1 and 1: its distribution function is x, and the slope in the shape -(1 - x) ... in closed form: x (log x) / -1
add("dirichlet_grad", "SELECT c_custkey, round(-x * ln(x) + 0.0, 4) + 0.0 AS v FROM (SELECT c_custkey, (c_custkey % 97 + 1) / 99.0::DOUBLE AS x FROM customer)")(
    lambda spark, sf: _t(spark, sf, "customer").select("c_custkey", ((F.col("c_custkey") % 97 + 1) / 99.0).alias("x")).select("c_custkey", R(random.dirichlet_grad(F.col("x"), F.lit(1.0), F.lit(2.0)), 4).alias("v"))
)
