"""Queries of the spatial operators. Images are the embeddings: 64 numbers as a line, as 8 x 8 or as 4 x 4 x 4 cells.

The SQL side takes its weights from plain loops over the output places (`_loop`), written as VALUES, so the two sides share no formula."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import spatial as s

SHAPES = {1: {"i": 64}, 2: {"i": 8, "j": 8}, 3: {"i": 4, "j": 4, "k": 4}}


# SQL side
def _clip(x, n):
    return min(max(x, 0), n - 1)


def _loop(kind: str, size: int, a: dict) -> list[tuple[int, int, float, int]]:
    """(o, i, w, k) for a kind of axis."""
    rows = []

    def put(o, taps):
        total = {}
        for i, w in taps:
            total[i] = total.get(i, 0.0) + w
        rows.extend((o, i, w, k) for k, (i, w) in enumerate(sorted(total.items())))

    out = a.get("out", 0)
    if kind in ("nearest", "exact"):
        for o in range(out):
            put(o, [(min(int((o + (0.5 if kind == "exact" else 0)) * size / out), size - 1), 1.0)])
    elif kind in ("linear", "corners"):
        for o in range(out):
            x = o * (size - 1) / (out - 1) if kind == "corners" else max((o + 0.5) * size / out - 0.5, 0)
            i = min(int(x), size - 1)
            put(o, [(i, 1 - (x - i)), (min(i + 1, size - 1), x - i)])
    elif kind == "cubic":
        for o in range(out):
            x = (o + 0.5) * size / out - 0.5
            i, t = math.floor(x), x - math.floor(x)
            b = -0.75
            outer = lambda u: b * u**3 - 5 * b * u**2 + 8 * b * u - 4 * b  # noqa: B023, E731
            inner = lambda u: (b + 2) * u**3 - (b + 3) * u**2 + 1  # noqa: B023, E731
            put(o, [(_clip(i - 1, size), outer(t + 1)), (_clip(i, size), inner(t)), (_clip(i + 1, size), inner(1 - t)), (_clip(i + 2, size), outer(2 - t))])
    elif kind in ("linear_aa", "cubic_aa"):
        scale = size / out
        for o in range(out):
            centre, reach = scale * (o + 0.5), (1 if kind == "linear_aa" else 2) * max(scale, 1)
            taps = []
            for i in range(max(int(centre - reach + 0.5), 0), min(int(centre + reach + 0.5), size)):
                x = abs((i - centre + 0.5) / max(scale, 1))
                if kind == "linear_aa":
                    w = max(1 - x, 0)
                else:
                    w = 1.5 * x**3 - 2.5 * x**2 + 1 if x <= 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0
                taps.append((i, w))
            total = sum(w for _, w in taps)
            put(o, [(i, w / total) for i, w in taps])
    elif kind == "window":
        window, stride, pad, dilation = a["window"], a["stride"], a.get("pad", 0), a.get("dilation", 1)
        o = 0
        while o * stride - pad + dilation * (window - 1) < size + pad:
            for k in range(window):
                i = o * stride - pad + k * dilation
                if 0 <= i < size:
                    rows.append((o, i, 1 / window, k))
            o += 1
    elif kind == "adaptive":
        for o in range(out):
            cells = range(o * size // out, -(-(o + 1) * size // out))
            put(o, [(i, 1 / len(cells)) for i in cells])
    elif kind == "fractional":
        step = (size - a["window"]) / (out - 1)
        for o in range(out):
            first = size - a["window"] if o == out - 1 else int((o + a["sample"]) * step) - int(a["sample"] * step)
            put(o, [(first + k, 1.0) for k in range(a["window"])])
    elif kind in ("reflect", "replicate"):
        line = list(range(size))
        left, right = (line[1 : a["before"] + 1][::-1], line[-a["after"] - 1 : -1][::-1]) if kind == "reflect" else ([0] * a["before"], [size - 1] * a["after"])
        for o, i in enumerate(left + line + right):
            put(o, [(i, 1.0)])
    return rows


def _values(kind, size, a):
    return "(SELECT CAST(o AS BIGINT) AS o, CAST(i AS BIGINT) AS i, w, CAST(k AS BIGINT) AS k FROM (VALUES " + ", ".join(f"({o}, {i}, {w!r}::DOUBLE, {k})" for o, i, w, k in _loop(kind, size, a)) + ") t(o, i, w, k))"


def _image_sql(dims: int) -> str:
    sizes = list(SHAPES[dims].items())
    coords, stride = [], 64
    for c, n in sizes:
        stride //= n
        coords.append(f"((p - 1) // {stride}) % {n} AS {c}")
    return f"(SELECT vec_id AS n, {', '.join(coords)}, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS p))"


def _sql(dims, kind, a, backward=False, source=None):
    sizes = SHAPES[dims]
    side, other = ("o", "i") if backward else ("i", "o")
    joins = "".join(f" JOIN {_values(kind, n, a)} {c}{c}(o, i, w, k) ON {c}{c}.{side} = x.{c}" for c, n in sizes.items())
    return f"SELECT x.n, {', '.join(f'{c}{c}.{other} AS {c}' for c in sizes)}, round(sum(x.v * {' * '.join(f'{c}{c}.w' for c in sizes)}), 4) + 0.0 AS v FROM {source or _image_sql(dims)} x{joins} GROUP BY ALL"


# Spark side
def _image(spark, sf, dims: int):
    stride, out = 64, {}
    for c, n in SHAPES[dims].items():
        stride //= n
        out[c] = F.pmod(F.floor(F.col("p") / stride), F.lit(n)).cast("long")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("n"), F.posexplode("embedding").alias("p", "x"))
    return rows.select("n", *[e.alias(c) for c, e in out.items()], F.col("x").cast("double").alias("v"))


def _axis(spark, kind, size, a):
    makes = {
        "nearest": lambda: s.nearest(spark, size, a["out"]), "exact": lambda: s.nearest(spark, size, a["out"], True), "linear": lambda: s.linear(spark, size, a["out"]),
        "corners": lambda: s.linear(spark, size, a["out"], True), "cubic": lambda: s.cubic(spark, size, a["out"]), "linear_aa": lambda: s.antialiased(spark, size, a["out"], "linear"),
        "cubic_aa": lambda: s.antialiased(spark, size, a["out"], "cubic"), "window": lambda: s.windows(spark, size, a["window"], a["stride"], a.get("pad", 0), a.get("dilation", 1)),
        "adaptive": lambda: s.adaptive(spark, size, a["out"]), "fractional": lambda: s.fractional(spark, size, a["out"], a["window"], a["sample"]),
        "reflect": lambda: s.padded(spark, size, a["before"], a["after"], "reflect"), "replicate": lambda: s.padded(spark, size, a["before"], a["after"], "replicate"),
    }
    return makes[kind]()


def _axes(spark, dims, kind, a):
    return {c: _axis(spark, kind, n, a) for c, n in SHAPES[dims].items()}


def _shown(df):
    return df.withColumn("v", F.round("v", 4) + 0.0)


PAD = {"before": 2, "after": 1}
#: operator: dimensions, kind of axis, its parameters
LINEAR = {
    "upsample_nearest1d": (1, "nearest", {"out": 100}), "_upsample_nearest_exact1d": (1, "exact", {"out": 40}), "upsample_nearest2d": (2, "nearest", {"out": 13}), "_upsample_nearest_exact2d": (2, "exact", {"out": 5}),
    "upsample_nearest3d": (3, "nearest", {"out": 6}), "_upsample_nearest_exact3d": (3, "exact", {"out": 7}), "upsample_linear1d": (1, "linear", {"out": 90}), "upsample_bilinear2d": (2, "corners", {"out": 11}),
    "_upsample_bilinear2d_aa": (2, "linear_aa", {"out": 5}), "upsample_bicubic2d": (2, "cubic", {"out": 12}), "_upsample_bicubic2d_aa": (2, "cubic_aa", {"out": 3}), "upsample_trilinear3d": (3, "linear", {"out": 7}),
    "avg_pool2d": (2, "window", {"window": 3, "stride": 2, "pad": 1}), "avg_pool3d": (3, "window", {"window": 2, "stride": 2}), "adaptive_avg_pool2d": (2, "adaptive", {"out": 3}), "adaptive_avg_pool3d": (3, "adaptive", {"out": 3}),
    "reflection_pad1d": (1, "reflect", PAD), "reflection_pad2d": (2, "reflect", PAD), "reflection_pad3d": (3, "reflect", PAD), "replication_pad1d": (1, "replicate", PAD), "replication_pad2d": (2, "replicate", PAD), "replication_pad3d": (3, "replicate", PAD),
}
MAXES = {
    "max_pool2d_with_indices": (2, "window", {"window": 3, "stride": 2, "pad": 1, "dilation": 2}), "max_pool3d_with_indices": (3, "window", {"window": 2, "stride": 1}), "adaptive_max_pool1d": (1, "adaptive", {"out": 10}), "adaptive_max_pool2d": (2, "adaptive", {"out": 3}),
    "adaptive_max_pool3d": (3, "adaptive", {"out": 3}), "fractional_max_pool2d": (2, "fractional", {"out": 5, "window": 2, "sample": 0.4}), "fractional_max_pool3d": (3, "fractional", {"out": 3, "window": 2, "sample": 0.7}),
}


def _linear(dims, kind, a):
    return lambda spark, sf: _shown(s.resample(_image(spark, sf, dims), _axes(spark, dims, kind, a), ["n"]))


def _linear_backward(dims, kind, a):
    def run(spark, sf):
        axes = _axes(spark, dims, kind, a)
        grad = s.resample(_image(spark, sf, dims), axes, ["n"]).withColumn("v", F.col("v") * (F.col("n") % 3 + 1))
        return _shown(s.resample_backward(grad, axes, ["n"]))

    inner = _sql(dims, kind, a).replace("round(sum", "(sum").replace(", 4) + 0.0 AS v", ") * any_value(x.n % 3 + 1) AS v")
    return run, _sql(dims, kind, a, True, f"({inner})")


def _flat(dims):
    text = "0"
    for c, n in SHAPES[dims].items():
        text = f"({text} * {n} + x.{c})"
    return text


def _max_sql(dims, kind, a):
    sizes = SHAPES[dims]
    joins = "".join(f" JOIN {_values(kind, n, a)} {c}{c}(o, i, w, k) ON {c}{c}.i = x.{c}" for c, n in sizes.items())
    return f"SELECT x.n, {', '.join(f'{c}{c}.o AS {c}' for c in sizes)}, max(x.v) AS v, CAST(arg_max({_flat(dims)}, (x.v, -{_flat(dims)})) AS BIGINT) AS \"at\" FROM {_image_sql(dims)} x{joins} GROUP BY ALL"


def _max(dims, kind, a):
    return lambda spark, sf: s.max_pool(_image(spark, sf, dims), _axes(spark, dims, kind, a), SHAPES[dims], ["n"])


def _max_backward(dims, kind, a):
    def run(spark, sf):
        pooled = s.max_pool(_image(spark, sf, dims), _axes(spark, dims, kind, a), SHAPES[dims], ["n"])
        grad = pooled.select("n", *SHAPES[dims], (F.col("v") * 2 + 1).alias("v"))
        return _shown(s.max_pool_backward(grad, pooled, SHAPES[dims], ["n"]))

    coords, stride = [], 64
    for c, n in SHAPES[dims].items():
        stride //= n
        coords.append(f"(\"at\" // {stride}) % {n} AS {c}")
    return run, f"SELECT n, {', '.join(coords)}, round(sum(v * 2 + 1), 4) + 0.0 AS v FROM ({_max_sql(dims, kind, a)}) GROUP BY n, \"at\""


def _unpool(dims):
    name = "fractional_max_pool3d" if dims == 3 else "adaptive_max_pool2d"
    sizes = SHAPES[dims]
    run = lambda spark, sf: s.max_unpool(_max(*MAXES[name])(spark, sf), sizes, ["n"])
    coords, stride = [], 64
    for c, n in sizes.items():
        stride //= n
        coords.append(f"(p // {stride}) % {n} AS {c}")
    return run, f"""SELECT g.n, {', '.join(coords)}, coalesce(m.v, 0) AS v FROM (SELECT vec_id AS n, p FROM embeddings, (SELECT unnest(range(64)) AS p)) g
LEFT JOIN (SELECT n, "at", max(v) AS v FROM ({_max_sql(*MAXES[name])}) GROUP BY 1, 2) m ON m.n = g.n AND m."at" = g.p"""


def _col_axes(spark):
    return {c: (s.windows(spark, 8, 3, 2, 1), 3, 4) for c in "ij"}


_W = _values("window", 8, {"window": 3, "stride": 2, "pad": 1})
_IM2COL = f"SELECT x.n, a.k * 3 + b.k AS k, a.o * 4 + b.o AS l, x.v FROM {_image_sql(2)} x JOIN {_W} a(o, i, w, k) ON a.i = x.i JOIN {_W} b(o, i, w, k) ON b.i = x.j"
#: a grid of 3 x 3 places in each image, some outside it
_AT = {"oi": "oi * 0.8 - 0.9 + (n % 7) * 0.02", "oj": "oj * 0.7 - 0.6 - (n % 5) * 0.03"}


def _grid(spark, sf, dims=2):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("n"))
    names = ["oi", "oj", "ok"][:dims]
    for o in names:
        rows = rows.withColumn(o, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    at = [F.col("oi") * 0.8 - 0.9 + (F.col("n") % 7) * 0.02, F.col("oj") * 0.7 - 0.6 - (F.col("n") % 5) * 0.03]
    if dims == 3:
        at.append(F.col("ok") * 0.5 - 0.55)
    return rows.select("n", *names, *[a.alias(f"at_{c}") for a, c in zip(at, "ijk", strict=False)])


def _grid_sql(dims, kind="zeros"):
    sizes, size = SHAPES[dims], 8 if dims == 2 else 4
    names = ["oi", "oj", "ok"][:dims]
    at = ["oi * 0.8::DOUBLE - 0.9 + (n % 7) * 0.02::DOUBLE", "oj * 0.7::DOUBLE - 0.6 - (n % 5) * 0.03::DOUBLE", "ok * 0.5::DOUBLE - 0.55"][:dims]
    x = [f"((({a}) + 1) * {size} - 1) / 2" if kind != "border" else f"least(greatest((({a}) + 1) * {size} - 1, 0) / 2, {size - 1})" for a in at]
    grid = f"SELECT vec_id AS n, {', '.join(names)} FROM embeddings" + "".join(f", (SELECT unnest(range(3)) AS {o})" for o in names)
    places = f"SELECT n, {', '.join(names)}, {', '.join(f'{e} AS x{c}' for e, c in zip(x, sizes, strict=True))} FROM ({grid})"
    near = " AND ".join(f"abs(g.x{c} - m.{c}) < 1" for c in sizes)
    weight = " * ".join(f"(1 - abs(g.x{c} - m.{c}))" for c in sizes)
    return places, near, weight, names


def _sample_sql(dims, kind="zeros"):
    places, near, weight, names = _grid_sql(dims, kind)
    return f"SELECT g.n, {', '.join(f'g.{o}' for o in names)}, round(coalesce(sum(m.v * {weight}), 0), 4) + 0.0 AS v FROM ({places}) g LEFT JOIN {_image_sql(dims)} m ON m.n = g.n AND {near} GROUP BY ALL"


def _sample(dims, border="zeros"):
    return lambda spark, sf: _shown(s.grid_sample(_image(spark, sf, dims), _grid(spark, sf, dims), SHAPES[dims], ["n"], ["oi", "oj", "ok"][:dims], border=border))


def _sample_backward(dims):
    names = ["oi", "oj", "ok"][:dims]

    def run(spark, sf):
        grid = _grid(spark, sf, dims)
        grad = grid.select("n", *names, (F.col("oi") + 1.0 + F.col("n") % 3).alias("v"))
        return _shown(s.grid_sample_backward(grad, grid, SHAPES[dims], ["n"], names)).where("v <> 0")

    places, near, weight, _ = _grid_sql(dims)
    c = ", ".join(f"m.{x}" for x in SHAPES[dims])
    return run, f"SELECT * FROM (SELECT m.n, {c}, round(sum((g.oi + 1 + g.n % 3) * {weight}), 4) + 0.0 AS v FROM ({places}) g JOIN {_image_sql(dims)} m ON m.n = g.n AND {near} GROUP BY ALL) WHERE v <> 0"


def _grid_backward(spark, sf):
    grid = _grid(spark, sf)
    grad = grid.select("n", "oi", "oj", (F.col("oi") + 1.0).alias("v"))
    out = s.grid_sample_backward_grid(grad, _image(spark, sf, 2), grid, SHAPES[2], ["n"], ["oi", "oj"])
    return out.select("n", "oi", "oj", *[(F.round(f"at_{c}", 4) + 0.0).alias(f"at_{c}") for c in "ij"])


def _grid_backward_sql():
    places, near, _, _ = _grid_sql(2)
    slope = lambda c, d: f"round(4 * sum((g.oi + 1) * m.v * CASE WHEN m.{c} <= g.x{c} THEN -1 ELSE 1 END * (1 - abs(g.x{d} - m.{d}))), 4) + 0.0"
    return f"SELECT g.n, g.oi, g.oj, {slope('i', 'j')} AS at_i, {slope('j', 'i')} AS at_j FROM ({places}) g JOIN {_image_sql(2)} m ON m.n = g.n AND {near} GROUP BY ALL"


def _rois(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("roi"), F.col("vec_id").alias("n"))
    m = F.col("n") % 5
    return rows.select("roi", "n", (m * 0.5).alias("x1"), (m * 0.25).alias("y1"), (m * 0.5 + 4.2).alias("x2"), (m * 0.25 + 5.1).alias("y2"))


_ROI = "(SELECT vec_id AS roi, vec_id AS n, (vec_id % 5) * 0.5::DOUBLE AS x1, (vec_id % 5) * 0.25::DOUBLE AS y1, (vec_id % 5) * 0.5::DOUBLE + 4.2 AS x2, (vec_id % 5) * 0.25::DOUBLE + 5.1 AS y2 FROM embeddings)"
_ROI_ALIGN = f"""WITH s AS (SELECT r.roi, r.n, oi, oj, y1 - 0.5 + (oi + (a + 0.5) / 2) * (y2 - y1) / 3 AS y, x1 - 0.5 + (oj + (b + 0.5) / 2) * (x2 - x1) / 3 AS x
FROM {_ROI} r, (SELECT unnest(range(3)) AS oi), (SELECT unnest(range(3)) AS oj), (SELECT unnest(range(2)) AS a), (SELECT unnest(range(2)) AS b)),
t AS (SELECT roi, n, oi, oj, least(greatest(y, 0), 7) AS y, least(greatest(x, 0), 7) AS x FROM s WHERE y BETWEEN -1 AND 8 AND x BETWEEN -1 AND 8)
SELECT roi, oi, oj, round(sum(m.v * (1 - abs(y - m.i)) * (1 - abs(x - m.j))) / 4, 4) + 0.0 AS v FROM t JOIN {_image_sql(2)} m ON m.n = t.n AND abs(y - m.i) < 1 AND abs(x - m.j) < 1 GROUP BY ALL"""
_ROI_POOL = f"""WITH r AS (SELECT roi, n, round(x1) AS a, round(y1) AS b, greatest(round(x2) - round(x1) + 1, 1) / 2 AS w, greatest(round(y2) - round(y1) + 1, 1) / 2 AS h FROM {_ROI})
SELECT roi, oi, oj, max(m.v) AS v FROM r, (SELECT unnest(range(2)) AS oi), (SELECT unnest(range(2)) AS oj), {_image_sql(2)} m
WHERE m.n = r.n AND m.i >= floor(oi * h) + b AND m.i < ceil((oi + 1) * h) + b AND m.j >= floor(oj * w) + a AND m.j < ceil((oj + 1) * w) + a GROUP BY ALL"""


def _kernel(spark):
    return spark.range(18).select((F.col("id") % 2).alias("c"), F.floor(F.col("id") / 6).cast("long").alias("i"), (F.floor(F.col("id") / 2) % 3).cast("long").alias("j"), (F.col("id") * 0.1 - 0.6).alias("w"))


def _conv(backward):
    def run(spark, sf):
        rows = _image(spark, sf, 2).withColumn("c", F.col("n") % 2)
        axes = {c: s.windows(spark, 8, 3, 1, 1) for c in "ij"}
        return _shown((s.depthwise_conv_backward if backward else s.depthwise_conv)(rows, _kernel(spark), axes, ["n"], "c"))

    w = _values("window", 8, {"window": 3, "stride": 1, "pad": 1})
    side, other = ("o", "i") if backward else ("i", "o")
    return run, f"""SELECT x.n, x.n % 2 AS c, a.{other} AS i, b.{other} AS j, round(sum(x.v * q.w), 4) + 0.0 AS v FROM {_image_sql(2)} x JOIN {w} a(o, i, w, k) ON a.{side} = x.i JOIN {w} b(o, i, w, k) ON b.{side} = x.j
JOIN (SELECT id % 2 AS c, id // 6 AS i, (id // 2) % 3 AS j, id * 0.1::DOUBLE - 0.6 AS w FROM (SELECT unnest(range(18)) AS id)) q ON q.c = x.n % 2 AND q.i = a.k AND q.j = b.k GROUP BY ALL"""


def _conv3d(spark, sf):
    rows = _image(spark, sf, 3).withColumn("c", F.lit(0).cast("long"))
    kernel = spark.range(8).select(F.lit(0).cast("long").alias("c"), *[(F.floor(F.col("id") / d) % 2).cast("long").alias(c) for c, d in (("i", 4), ("j", 2), ("k", 1))], (F.col("id") - 3.5).alias("w"))
    return _shown(s.depthwise_conv(rows, kernel, {c: s.windows(spark, 4, 2, 1) for c in "ijk"}, ["n"], "c").drop("c"))


def _conv_weights(dims, shape, window, stride, pad):
    """The kernels' gradient for an output gradient of o + 1 along the first dimension."""
    names = "ijk"[:dims]

    def run(spark, sf):
        rows = _image(spark, sf, dims).withColumn("c", F.col("n") % 2)
        axes = {c: s.windows(spark, shape, window, stride, pad) for c in names}
        first = {c: a.select("o").distinct() for c, a in axes.items()}
        grad = rows.select("n", "c").distinct()
        for c in names:
            grad = grad.join(F.broadcast(first[c].select(F.col("o").alias(c))), F.lit(True))  # a few places
        grad = grad.withColumn("v", (F.col("i") + 1).cast("double"))
        return s.depthwise_conv_weight_backward(rows, grad, axes, ["n"], "c").withColumn("w", F.round("w", 3) + 0.0)

    w = _values("window", shape, {"window": window, "stride": stride, "pad": pad})
    joins = " ".join(f"JOIN {w} a{c}(o, i, w, k) ON a{c}.i = x.{c}" for c in names)
    taps = ", ".join(f"a{c}.k AS {c}" for c in names)
    return run, f"SELECT x.n % 2 AS c, {taps}, round(sum(x.v * (ai.o + 1)), 3) + 0.0 AS w FROM {_image_sql(dims)} x {joins} GROUP BY ALL"


def _conv3d_backward():
    """The input's gradient in three dimensions, for an output gradient that is the image's own first places."""

    def run(spark, sf):
        grad = _image(spark, sf, 3).where("i < 3 AND j < 3 AND k < 3").withColumn("c", F.lit(0).cast("long"))
        kernel = spark.range(8).select(F.lit(0).cast("long").alias("c"), *[(F.floor(F.col("id") / d) % 2).cast("long").alias(c) for c, d in (("i", 4), ("j", 2), ("k", 1))], (F.col("id") - 3.5).alias("w"))
        return _shown(s.depthwise_conv_backward(grad, kernel, {c: s.windows(spark, 4, 2, 1) for c in "ijk"}, ["n"], "c").drop("c"))

    return run, f"""SELECT x.n, a.i, b.i AS j, d.i AS k, round(sum(x.v * (a.k * 4 + b.k * 2 + d.k - 3.5)), 4) + 0.0 AS v FROM {_image_sql(3)} x
JOIN {_V3} a(o, i, w, k) ON a.o = x.i JOIN {_V3} b(o, i, w, k) ON b.o = x.j JOIN {_V3} d(o, i, w, k) ON d.o = x.k GROUP BY ALL"""


_V3 = _values("window", 4, {"window": 2, "stride": 1})
_CONV3D = f"""SELECT x.n, a.o AS i, b.o AS j, d.o AS k, round(sum(x.v * (a.k * 4 + b.k * 2 + d.k - 3.5)), 4) + 0.0 AS v FROM {_image_sql(3)} x
JOIN {_V3} a(o, i, w, k) ON a.i = x.i JOIN {_V3} b(o, i, w, k) ON b.i = x.j JOIN {_V3} d(o, i, w, k) ON d.i = x.k GROUP BY ALL"""


def _boxes(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    x, y = F.col("event_id") % 17, F.floor(F.col("event_id") / 17) % 13
    return rows.select(F.col("user_id"), F.col("event_id").alias("id"), x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 4.0).alias("x2"), (y + 5.0).alias("y2"), F.col("value").alias("score"))


_ROI_CELLS = _ROI_ALIGN[: _ROI_ALIGN.index("SELECT roi, oi, oj, round")]
_ALIGN_BACK = f"""{_ROI_CELLS}SELECT t.n, m.i, m.j, round(sum((oi + oj + 1) * (1 - abs(y - m.i)) * (1 - abs(x - m.j))) / 4, 4) + 0.0 AS v FROM t JOIN {_image_sql(2)} m ON m.n = t.n AND abs(y - m.i) < 1 AND abs(x - m.j) < 1 GROUP BY ALL"""
_PS = f"(SELECT n, b.c, a.i, a.j, a.v * (b.c + 1) AS v FROM {_image_sql(2)} a, (SELECT unnest(range(18)) AS c) b)"
_PS_ALIGN = f"""{_ROI_CELLS}SELECT roi, m.c // 9 AS c, oi, oj, round(sum(m.v * (1 - abs(y - m.i)) * (1 - abs(x - m.j))) / 4, 3) + 0.0 AS v FROM t JOIN {_PS} m ON m.n = t.n AND m.c // 3 % 3 = oi AND m.c % 3 = oj AND abs(y - m.i) < 1 AND abs(x - m.j) < 1 GROUP BY ALL"""
_PS_BACK = f"""{_ROI_CELLS}SELECT t.n, (k * 3 + oi) * 3 + oj AS c, m.i, m.j, round(sum((k + oi + oj + 1) * 0.73105857::DOUBLE * (1 - abs(y - m.i)) * (1 - abs(x - m.j))) / 4, 4) + 0.0 AS v FROM t JOIN {_image_sql(2)} m ON m.n = t.n AND abs(y - m.i) < 1 AND abs(x - m.j) < 1, (SELECT unnest(range(2)) AS k) GROUP BY ALL"""
_POOL_BACK = f"""WITH r AS (SELECT roi, n, round(x1) AS a, round(y1) AS b, greatest(round(x2) - round(x1) + 1, 1) / 2 AS w, greatest(round(y2) - round(y1) + 1, 1) / 2 AS h FROM {_ROI}),
p AS (SELECT roi, m.n, oi, oj, arg_max(m.i * 8 + m.j, (m.v, -(m.i * 8 + m.j))) AS p FROM r, (SELECT unnest(range(2)) AS oi), (SELECT unnest(range(2)) AS oj), {_image_sql(2)} m
WHERE m.n = r.n AND m.i >= floor(oi * h) + b AND m.i < ceil((oi + 1) * h) + b AND m.j >= floor(oj * w) + a AND m.j < ceil((oj + 1) * w) + a GROUP BY ALL)
SELECT n, p // 8 AS i, p % 8 AS j, CAST(sum(oi + oj + 1) AS DOUBLE) AS v FROM p GROUP BY ALL"""
_PS_POOL = f"""WITH r AS (SELECT roi, n, round(x1) AS a, round(y1) AS b, greatest(round(x2) - round(x1), 0.1) / 3 AS w, greatest(round(y2) - round(y1), 0.1) / 3 AS h FROM {_ROI})
SELECT roi, m.c // 9 AS c, oi, oj, round(avg(m.v), 4) + 0.0 AS v FROM r, (SELECT unnest(range(3)) AS oi), (SELECT unnest(range(3)) AS oj), {_PS} m
WHERE m.n = r.n AND m.c // 3 % 3 = oi AND m.c % 3 = oj AND m.i >= floor(oi * h) + b AND m.i < ceil((oi + 1) * h) + b AND m.j >= floor(oj * w) + a AND m.j < ceil((oj + 1) * w) + a GROUP BY ALL"""


def _channels(spark, sf):
    c = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(17).cast("long")))
    return _image(spark, sf, 2).withColumn("c", c).withColumn("v", F.col("v") * (F.col("c") + 1))


def _bins(spark, sf, out, *more):
    rows = _rois(spark, sf).select("roi")
    for o in ("oi", "oj"):
        rows = rows.withColumn(o, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(out - 1).cast("long"))))
    for c, n in more:
        rows = rows.withColumn(c, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return rows.withColumn("v", (F.col("oi") + F.col("oj") + 1 + (F.col(more[0][0]) if more else 0)) * (0.73105857 if more else 1.0))


def _moved(spark, sf):
    """Two taps for each of 3 x 3 output places, each moved a little by the image's number."""
    rows = _grid(spark, sf).select("n", "oi", "oj").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    return rows.select("n", "oi", "oj", "k", (F.col("oi") * 2 + F.col("k") + (F.col("n") % 7) * 0.1 - 0.25).alias("y"), (F.col("oj") * 2 + F.col("k") - (F.col("n") % 5) * 0.1 + 0.15).alias("x"), (1 - F.col("k") * 0.5).alias("mask"))


def _taps(spark):
    return spark.range(4).select(F.floor(F.col("id") / 2).alias("o"), F.lit(0).cast("long").alias("c"), (F.col("id") % 2).alias("k"), (F.col("id") + 0.5).alias("w"))


_MOVED = "(SELECT vec_id AS n, oi, oj, k, oi * 2 + k + (vec_id % 7) * 0.1::DOUBLE - 0.25 AS y, oj * 2 + k - (vec_id % 5) * 0.1::DOUBLE + 0.15 AS x, 1 - k * 0.5::DOUBLE AS mask FROM embeddings, (SELECT unnest(range(3)) AS oi), (SELECT unnest(range(3)) AS oj), (SELECT unnest(range(2)) AS k))"
_NEAR = f"{_MOVED} g JOIN {_image_sql(2)} m ON m.n = g.n AND abs(g.y - m.i) < 1 AND abs(g.x - m.j) < 1, (SELECT unnest(range(2)) AS o)"
_DEFORM = f"SELECT g.n, o, oi, oj, round(sum((1 - abs(g.y - m.i)) * (1 - abs(g.x - m.j)) * mask * m.v * (o * 2 + k + 0.5)), 4) + 0.0 AS v FROM {_NEAR} GROUP BY ALL"
_DEFORM_BACK = f"SELECT g.n, m.i, m.j, round(sum((1 - abs(g.y - m.i)) * (1 - abs(g.x - m.j)) * mask * (o * 2 + k + 0.5) * (oi + 1) * 0.73105857::DOUBLE), 4) + 0.0 AS v FROM {_NEAR} GROUP BY ALL"


_PULL = "(oi + 1) * 0.73105857::DOUBLE"
_DEFORM_WEIGHT = f"SELECT o, k, round(sum((1 - abs(g.y - m.i)) * (1 - abs(g.x - m.j)) * mask * m.v * {_PULL}), 3) + 0.0 AS w FROM {_NEAR} GROUP BY ALL"
_SIGN = "CASE WHEN m.{d} = floor(g.{x}) THEN -1 ELSE 1 END"
_DEFORM_TAP = f"""SELECT g.n, oi, oj, k, round(sum({_SIGN.format(d="i", x="y")} * (1 - abs(g.x - m.j)) * mask * m.v * {_PULL} * (o * 2 + k + 0.5)), 4) + 0.0 AS y,
round(sum({_SIGN.format(d="j", x="x")} * (1 - abs(g.y - m.i)) * mask * m.v * {_PULL} * (o * 2 + k + 0.5)), 4) + 0.0 AS x,
round(sum((1 - abs(g.y - m.i)) * (1 - abs(g.x - m.j)) * m.v * {_PULL} * (o * 2 + k + 0.5)), 4) + 0.0 AS mask FROM {_NEAR} GROUP BY ALL"""
_PS_POOL_BACK = f"""WITH r AS (SELECT roi, n, round(x1) AS a, round(y1) AS b, greatest(round(x2) - round(x1), 0.1) / 3 AS w, greatest(round(y2) - round(y1), 0.1) / 3 AS h FROM {_ROI}),
p AS (SELECT roi, r.n, oi, oj, i, j, count(*) OVER (PARTITION BY roi, oi, oj) AS k FROM r, (SELECT unnest(range(3)) AS oi), (SELECT unnest(range(3)) AS oj), (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j)
WHERE i >= floor(oi * h) + b AND i < ceil((oi + 1) * h) + b AND j >= floor(oj * w) + a AND j < ceil((oj + 1) * w) + a)
SELECT n, (c * 3 + oi) * 3 + oj AS c, i, j, round(sum((oi + oj + 1 + c) * 0.73105857::DOUBLE / k), 4) + 0.0 AS v FROM p, (SELECT unnest(range(2)) AS c) GROUP BY ALL"""


def build() -> tuple[dict, dict]:
    q, sql = {}, {}

    def add(name, pair):
        q[name], sql[name] = pair

    for name, spec in LINEAR.items():
        add(name.strip("_"), (_linear(*spec), _sql(*spec)))
        add(f"{name.strip('_')}_backward", _linear_backward(*spec))
    for name, spec in MAXES.items():
        add(name, (_max(*spec), _max_sql(*spec)))
        add(f"{name}_backward", _max_backward(*spec))
    add("max_unpool2d", _unpool(2))
    add("max_unpool3d", _unpool(3))
    add("im2col", (lambda spark, sf: s.im2col(_image(spark, sf, 2), _col_axes(spark), ["n"]), _IM2COL))
    add("col2im", (
        lambda spark, sf: _shown(s.col2im(s.im2col(_image(spark, sf, 2), _col_axes(spark), ["n"]), _col_axes(spark), ["n"])),
        f"SELECT x.n, x.i, x.j, round(x.v * p.c * r.c, 4) + 0.0 AS v FROM {_image_sql(2)} x JOIN (SELECT i, count(*) AS c FROM {_W} a(o, i, w, k) GROUP BY 1) p ON p.i = x.i JOIN (SELECT i, count(*) AS c FROM {_W} a(o, i, w, k) GROUP BY 1) r ON r.i = x.j",
    ))
    add("grid_sampler_2d", (_sample(2), _sample_sql(2)))
    add("grid_sampler_2d_border", (_sample(2, "border"), _sample_sql(2, "border")))
    add("grid_sampler_3d", (_sample(3), _sample_sql(3)))
    add("grid_sampler_2d_backward", _sample_backward(2))
    add("grid_sampler_3d_backward", _sample_backward(3))
    add("grid_sampler_2d_backward_grid", (_grid_backward, _grid_backward_sql()))
    add("roi_align", (lambda spark, sf: _shown(s.roi_align(_image(spark, sf, 2), _rois(spark, sf), 8, 8, 3, 2)), _ROI_ALIGN))
    add("roi_pool", (lambda spark, sf: s.roi_pool(_image(spark, sf, 2), _rois(spark, sf), 8, 8, 2), _ROI_POOL))
    add("depthwise_conv2d", _conv(False))
    add("depthwise_conv2d_backward", _conv(True))
    add("depthwise_conv3d", (_conv3d, _CONV3D))
    region = (8, 8, 3, 2)
    add("depthwise_conv2d_weight_backward", _conv_weights(2, 8, 3, 1, 1))
    add("depthwise_conv3d_weight_backward", _conv_weights(3, 4, 2, 1, 0))
    add("depthwise_conv3d_backward", _conv3d_backward())
    add("roi_align_backward", (lambda spark, sf: _shown(s.roi_align_backward(_bins(spark, sf, 3), _rois(spark, sf), *region)), _ALIGN_BACK))
    add("ps_roi_align", (lambda spark, sf: s.ps_roi_align(_channels(spark, sf), _rois(spark, sf), *region).withColumn("v", F.round("v", 3) + 0.0), _PS_ALIGN))
    add("ps_roi_align_backward", (lambda spark, sf: _shown(s.ps_roi_align_backward(_bins(spark, sf, 3, ("c", 2)), _rois(spark, sf), *region)), _PS_BACK))
    add("roi_pool_backward", (lambda spark, sf: s.roi_pool_backward(_bins(spark, sf, 2), _image(spark, sf, 2), _rois(spark, sf), 8, 8, 2), _POOL_BACK))
    add("ps_roi_pool", (lambda spark, sf: _shown(s.ps_roi_pool(_channels(spark, sf), _rois(spark, sf), 8, 8, 3)), _PS_POOL))
    image = lambda spark, sf: _image(spark, sf, 2).withColumn("c", F.lit(0).cast("long"))
    add("deform_conv2d", (lambda spark, sf: _shown(s.deform_conv(image(spark, sf), _moved(spark, sf), _taps(spark), SHAPES[2], ["n"])), _DEFORM))
    grads = lambda spark, sf: _moved(spark, sf).select("n", "oi", "oj").distinct().withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long")))).withColumn("v", (F.col("oi") + 1.0) * 0.73105857)
    add("deform_conv2d_backward", (lambda spark, sf: _shown(s.deform_conv_backward(grads(spark, sf), _moved(spark, sf), _taps(spark), SHAPES[2], ["n"])).drop("c"), _DEFORM_BACK))
    places = lambda df, *names: df.select("n", "oi", "oj", "k", *[(F.round(c, 4) + 0.0).alias(c) for c in names])
    add("deform_conv2d_weight_backward", (lambda spark, sf: s.deform_conv_weight_backward(grads(spark, sf), image(spark, sf), _moved(spark, sf), SHAPES[2], ["n"]).select("o", "k", (F.round("w", 3) + 0.0).alias("w")), _DEFORM_WEIGHT))
    add("deform_conv2d_tap_backward", (lambda spark, sf: places(s.deform_conv_tap_backward(grads(spark, sf), image(spark, sf), _moved(spark, sf), _taps(spark), SHAPES[2], ["n"]), "y", "x", "mask"), _DEFORM_TAP))
    add("ps_roi_pool_backward", (lambda spark, sf: _shown(s.ps_roi_pool_backward(_bins(spark, sf, 3, ("c", 2)), _rois(spark, sf), 8, 8, 3)), _PS_POOL_BACK))
    whole = lambda spark, sf: _image(spark, sf, 2).withColumn("v", F.rint(F.col("v") * 20).cast("int"))
    add("quantized_max_pool2d", (
        lambda spark, sf: s.max_pool(whole(spark, sf), _axes(spark, *MAXES["adaptive_max_pool2d"]), SHAPES[2], ["n"]).drop("at"),
        f"SELECT n, i, j, CAST(round_even(v * 20, 0) AS INTEGER) AS v FROM ({_max_sql(*MAXES['adaptive_max_pool2d'])})",
    ))
    q["nms"] = lambda spark, sf: s.nms(_boxes(spark, sf), ["user_id"], 0.3).select("user_id", "id")
    return q, sql
