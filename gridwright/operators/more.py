"""Views by coordinates, optimiser steps and attention."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grid
from .factor import apply, dot, held, let


# views: new coordinates for the same values
def narrow(df: DataFrame, at: str, start: int, length: int) -> DataFrame:
    return df.where(F.col(at).between(start, start + length - 1)).withColumn(at, F.col(at) - start)


def select(df: DataFrame, at: str, index: int) -> DataFrame:
    return df.where(F.col(at) == index).drop(at)


def transpose(df: DataFrame, a: str = "i", b: str = "j") -> DataFrame:
    return df.withColumns({a: F.col(b), b: F.col(a)})


def flip(df: DataFrame, at: str, size: int) -> DataFrame:
    return df.withColumn(at, size - 1 - F.col(at))


def view(df: DataFrame, old: dict[str, int], new: dict[str, int]) -> DataFrame:
    """Coordinates of another shape with as many cells: old and new name the dimensions and their sizes, outermost first."""
    flat = F.lit(0).cast("long")
    for c, n in old.items():
        flat = flat * n + F.col(c)
    out, stride = {}, 1
    for c, n in reversed(new.items()):
        out[c] = F.pmod(F.floor(flat / stride), F.lit(n)).cast("long")
        stride *= n
    return df.select(*[v.alias(c) for c, v in out.items()], *[c for c in df.columns if c not in old])


def tril(df: DataFrame, k: int = 0) -> DataFrame:
    return df.where(F.col("j") <= F.col("i") + k)


def triu(df: DataFrame, k: int = 0) -> DataFrame:
    return df.where(F.col("j") >= F.col("i") + k)


def channel_shuffle(c: Column, channels: int, groups: int) -> Column:
    each = channels // groups
    return (F.pmod(c, F.lit(each)) * groups + F.floor(c / each)).cast("long")


# optimiser steps, over columns p (parameter), g (gradient) and state
def sgd(df: DataFrame, lr: float, momentum: float = 0.0, nesterov: bool = False, decay: float = 0.0) -> DataFrame:
    out = df.withColumn("_g", F.col("g") + decay * F.col("p"))
    if momentum:
        out = out.withColumn("buf", momentum * F.col("buf") + F.col("_g")).withColumn("_g", F.col("_g") + momentum * F.col("buf") if nesterov else F.col("buf"))
    return out.withColumn("p", F.col("p") - lr * F.col("_g")).drop("_g")


def adam(df: DataFrame, step: int, lr: float = 1e-3, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, decay: float = 0.0, decoupled: bool = False) -> DataFrame:
    g = F.col("g") if decoupled else F.col("g") + decay * F.col("p")
    out = df.withColumn("_g", g).withColumns({"m": b1 * F.col("m") + (1 - b1) * F.col("_g"), "s": b2 * F.col("s") + (1 - b2) * F.col("_g") * F.col("_g")})
    shrink = F.col("p") * (1 - lr * decay) if decoupled else F.col("p")
    return out.withColumn("p", shrink - lr * (F.col("m") / (1 - b1**step)) / (F.sqrt(F.col("s") / (1 - b2**step)) + eps)).drop("_g")


#: Rows of a block that attention holds as one array.
BLOCK = 4096
#: Heads of up to so many rows are worked on as expressions of a row, for a task of their own each would cost more than the work.
FEW = 64


def _softmaxed(q: np.ndarray, k: np.ndarray, scale: float, hidden: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Each query's largest score, and its scores' exponentials below that."""
    score = q @ k.T * scale
    if hidden is not None:
        score[hidden] = -np.inf
    most = score.max(1)
    return most, np.exp(score - np.where(most == -np.inf, 0.0, most)[:, None])


def _shares(scale: float, causal: bool):
    """A block of queries against one of keys: head, i, _m (largest score), s and x (sums of exponentials below it, alone and of v by them)."""

    def work(a: pa.Table, b: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        (q, _), (k, _) = grid.both(a["q"], b["k"])
        v, _ = grid.matrix(b["v"])
        i, j = (t[c].to_numpy() for t, c in ((a, "i"), (b, "j"))) if causal else (None, None)
        for at in grid.strips(len(a), len(b)):
            m, e = _softmaxed(q[at], k, scale, j > i[at][:, None] if causal else None)
            seen = pa.array(m != -np.inf)
            rows = a.slice(at.start, len(m))
            yield grid.batch(["head", "i", "_m", "s", "x"], rows["head"], rows["i"], pa.array(m), pa.array(e.sum(1)), grid.vectors(e @ v)).filter(seen)

    return work


def _kinds(df: DataFrame, names: list[str], **more: str) -> T.StructType:
    extra = {"d": T.DoubleType(), "v": T.ArrayType(T.DoubleType())}
    return T.StructType([T.StructField(n, df.schema[n].dataType) for n in names] + [T.StructField(n, extra[k]) for n, k in more.items()])


def attention(q: DataFrame, kv: DataFrame, scale: float, causal: bool = False) -> DataFrame:
    """q: head, i, q (array); kv: head, j, k, v (arrays). Softmax of scaled dot products within the head, then the weighted sum of v.

    Queries and keys come in blocks. A pair of blocks gives each query its largest score there, the sum of its exponentials and of v by
    them; what the blocks give a query is then merged. So each side is shuffled once for each block of the other, and pairs never are."""
    q, kv = q.select("head", "i", "q").where("q IS NOT NULL"), kv.select("head", "j", "k", "v").where("k IS NOT NULL")
    if grid.largest(kv, ["head"]) <= min(FEW, BLOCK):
        return _small(q, kv, scale, causal)
    part = grid.meet(q, kv, ["head"], _shares(scale, causal), _kinds(q, ["head", "i"], _m="d", s="d", x="v"), BLOCK)
    part = part.select("head", "i", F.struct("_m", "s", "x").alias("_p"))
    merged = held(part.groupBy("head", "i").agg(F.collect_list("_p").alias("_p")), _most=F.array_max(F.transform("_p", lambda p: p["_m"])))
    merged = held(merged, _w=F.transform("_p", lambda p: F.exp(p["_m"] - F.col("_most"))))
    total = F.aggregate(F.zip_with("_w", "_p", lambda w, p: w * p["s"]), F.lit(0.0), lambda s, x: s + x)
    merged = held(merged, _sum=total, _x=_weighted(F.col("_w"), F.transform("_p", lambda p: p["x"])))
    return merged.select("head", "i", F.transform("_x", lambda x: x / F.col("_sum")).alias("out"))


def _weighted(weights: Column, vectors: Column) -> Column:
    """Sum of vectors by weights."""
    zero = F.transform(F.get(vectors, 0), lambda x: F.lit(0.0))
    return F.aggregate(F.zip_with(weights, vectors, lambda w, v: F.transform(v, lambda x: w * x)), zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))


def _small(q: DataFrame, kv: DataFrame, scale: float, causal: bool) -> DataFrame:
    """Attention where a head's keys and values are one short array beside each query."""
    met = q.join(kv.groupBy("head").agg(F.collect_list(F.struct("j", "k", "v")).alias("_block")), "head")
    score = F.transform("_block", lambda b: dot(F.col("q"), b["k"]) * scale)
    if causal:
        score = F.zip_with(score, "_block", lambda s, b: F.when(b["j"] <= F.col("i"), s).otherwise(float("-inf")))
    met = held(met, _score=score)
    met = held(met, _m=F.array_max("_score")).where(F.col("_m") > float("-inf"))
    met = held(met, _e=F.transform("_score", lambda s: F.exp(s - F.col("_m"))))
    met = held(met, _s=F.aggregate("_e", F.lit(0.0), lambda s, x: s + x), _x=_weighted(F.col("_e"), F.transform("_block", lambda b: b["v"])))
    return met.select("head", "i", F.transform("_x", lambda x: x / F.col("_s")).alias("out"))


def _means(scale: float):
    """As _shares, with d: the sum of g . v by the exponentials."""

    def work(a: pa.Table, b: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        (q, _), (k, _) = grid.both(a["q"], b["k"])
        (g, _), (v, _) = grid.both(a["g"], b["v"])
        for at in grid.strips(len(a), len(b)):
            m, e = _softmaxed(q[at], k, scale, None)
            rows = a.slice(at.start, len(m))
            yield grid.batch(["head", "i", "_m", "s", "d"], rows["head"], rows["i"], pa.array(m), pa.array(e.sum(1)), pa.array((e * (g[at] @ v.T)).sum(1)))

    return work


def _row_sums(q: DataFrame, kv: DataFrame, scale: float) -> DataFrame:
    """q (head, i, q, g) with the largest score, the sum of exponentials above it, and the mean of g . v by the shares: merged from blocks."""
    part = grid.meet(q, kv, ["head"], _means(scale), _kinds(q, ["head", "i"], _m="d", s="d", d="d"), BLOCK).select("head", "i", F.struct("_m", "s", "d").alias("_p"))
    merged = held(part.groupBy("head", "i").agg(F.collect_list("_p").alias("_p")), _m=F.array_max(F.transform(F.col("_p"), lambda p: p["_m"])))
    add = lambda name: F.aggregate("_p", F.lit(0.0), lambda s, p: s + F.exp(p["_m"] - F.col("_m")) * p[name])
    merged = held(merged, _s=add("s"), _t=add("d"))
    return q.join(merged.select("head", "i", "_m", "_s", (F.col("_t") / F.col("_s")).alias("_mean")), ["head", "i"])


def _gradients(scale: float, of: str):
    """A block of queries against one of keys: the block's shares in the gradient of q, k or v, an array for each of its rows."""

    def work(a: pa.Table, b: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        (q, _), (k, _) = grid.both(a["q"], b["k"])
        (g, _), (v, _) = grid.both(a["g"], b["v"])
        m, s, mean = (a[c].to_numpy()[:, None] for c in ("_m", "_s", "_mean"))
        total = np.zeros(k.shape if of == "k" else v.shape)
        for at in grid.strips(len(a), len(b)):
            p = np.exp(q[at] @ k.T * scale - m[at]) / s[at]
            if of == "v":
                total += p.T @ g[at]
                continue
            ds = p * (g[at] @ v.T - mean[at]) * scale
            if of == "k":
                total += ds.T @ q[at]
            else:
                rows = a.slice(at.start, len(ds))
                yield grid.batch(["head", "i", "_g"], rows["head"], rows["i"], grid.vectors(ds @ k))
        if of != "q":
            yield grid.batch(["head", "j", "_g"], b["head"], b["j"], grid.vectors(total))

    return work


def attention_backward(q: DataFrame, kv: DataFrame, grad: DataFrame, scale: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gradients of q (head, i, c, v), k and v (head, j, c, v). grad: head, i, g (array).

    Row maxima and sums are merged from blocks as in the forward pass; then each pair of blocks gives its queries (or keys) their shares, an array
    each, which are summed. Nothing is shuffled by pair: rows times blocks at most."""
    q, kv = q.select("head", "i", "q").where("q IS NOT NULL"), kv.select("head", "j", "k", "v").where("k IS NOT NULL")
    rows = _row_sums(q.join(grad.select("head", "i", "g"), ["head", "i"]), kv, scale)

    def summed(of: str) -> DataFrame:
        source, at = (rows, "i") if of == "q" else (kv, "j")
        part = grid.meet(rows, kv, ["head"], _gradients(scale, of), _kinds(source, ["head", at], _g="v"), BLOCK)
        return part.select("head", at, F.posexplode("_g").alias("c", "v")).groupBy("head", at, "c").agg(F.sum("v").alias("v"))

    return summed("q"), summed("k"), summed("v")


def _tokens(x: DataFrame) -> DataFrame:
    """seq, t, x: a token's vector as an array."""
    return x.groupBy("seq", "t").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda s: s["v"].cast("double")).alias("x"))


def _with_weights(df: DataFrame, **weights: DataFrame) -> DataFrame:
    """df with a model's matrices (i, j, v) as arrays of rows in columns: one row of as many numbers as the model has."""
    for name, w in weights.items():
        rows = w.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda s: s["v"].cast("double")).alias("_r"))
        one = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "_r"))), lambda s: s["_r"]).alias(name))
        df = df.join(F.broadcast(one), F.lit(True))
    return df


def _attended(tokens: DataFrame, qkv: DataFrame, heads: int, width: int, out: DataFrame | None) -> DataFrame:
    """seq, t, y: what attention gives for each token (seq, t, x)."""
    each = width // heads
    made = held(_with_weights(tokens, _w=qkv), _p=apply(F.col("_w"), F.col("x"))).select("seq", "t", "_p")
    cut = lambda part: F.slice("_p", part * width + F.col("_h") * each + 1, each)
    made = made.withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(heads - 1))))
    made = made.select(F.struct("seq", "_h").alias("head"), F.col("t").alias("i"), cut(0).alias("q"), F.col("t").alias("j"), cut(1).alias("k"), cut(2).alias("v"))
    got = attention(made.select("head", "i", "q"), made.select("head", "j", "k", "v"), each**-0.5)
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("head._h", "out"))), lambda s: s["out"]))
    rows = got.groupBy(F.col("head.seq").alias("seq"), F.col("i").alias("t")).agg(whole.alias("y"))
    return rows if out is None else held(_with_weights(rows, _w=out), _z=apply(F.col("_w"), F.col("y"))).select("seq", "t", F.col("_z").alias("y"))


def _cells(df: DataFrame, vector: str) -> DataFrame:
    return df.select("seq", "t", F.posexplode(vector).alias("j", "v")).select("seq", "t", F.col("j").cast("long").alias("j"), "v")


def multi_head_attention(x: DataFrame, qkv: DataFrame, heads: int, width: int, out: DataFrame | None = None) -> DataFrame:
    """x: seq, t, j, v (a token's vector, in coordinates); qkv: i (3 * width rows), j, v; out: i, j, v. Projection, scaled products within each sequence and head,
    and the output's projection: seq, t, j, v. Tokens are arrays in between, and projections are expressions of a row."""
    return _cells(_attended(_tokens(x), qkv, heads, width, out), "y")


def _normed(v: Column, eps: float = 1e-5) -> Column:
    """An array less its mean, over its deviation."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    centred = let(mean(v), lambda m: F.transform(v, lambda x: x - m))
    return let(centred, lambda c: let(F.sqrt(mean(F.transform(c, lambda x: x * x)) + eps), lambda d: F.transform(c, lambda x: x / d)))


def encoder_layer(x: DataFrame, qkv: DataFrame, out: DataFrame, first: DataFrame, second: DataFrame, heads: int, width: int) -> DataFrame:
    """Attention and a two-layer net with relu, each added to its input and normalised over the token's vector. Only attention moves tokens."""
    tokens = _tokens(x)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    both = tokens.join(_attended(tokens, qkv, heads, width, out), ["seq", "t"])
    mid = held(held(both, _a=plus("x", "y")), _mid=_normed(F.col("_a"))).select("seq", "t", "_mid")
    mid = held(_with_weights(mid, _f=first), _hidden=F.transform(apply(F.col("_f"), F.col("_mid")), lambda v: F.greatest(v, F.lit(0.0)))).drop("_f")
    mid = held(held(_with_weights(mid, _g=second), _b=plus("_mid", apply(F.col("_g"), F.col("_hidden")))).drop("_g"), _out=_normed(F.col("_b")))
    return _cells(mid, "_out")
