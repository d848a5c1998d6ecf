"""Queries of factors, eigenvalues and transforms, with SQL by closed forms of 3 x 3 matrices, products and plain sums.

Matrices of a row: M from an embedding's first nine numbers (2 more in the last place), b the next three, and S = M M^T + 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import factor, fourier, linalg, sparse, tall
from .tensor_queries import _A3, _DET, EMB, R, emb, matrices, three, vecs

QUERIES, SQL = {}, {}


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str, *names: str):
    def put(f):
        for n in names or (f.__name__,):
            QUERIES[n], SQL[n] = f, sql
        return f

    return put


def build() -> tuple[dict, dict]:
    return QUERIES, SQL


def rows_of(spark, sf):
    """n, m, b, s."""
    df = matrices(spark, sf)
    df = factor.held(df, _p=factor.product(F.col("m"), factor.transpose(F.col("m"))))
    return factor.held(df, s=F.transform("_p", lambda r, i: F.transform(r, lambda x, j: x + F.when(i == j, 1.0).otherwise(0.0)))).drop("_p")


def cells(df, column, digits=5):
    """n, i, j, v of the matrices in a column."""
    out = df.select("n", F.posexplode(column).alias("i", "_r")).select("n", "i", F.posexplode("_r").alias("j", "v"))
    return out.select("n", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), R(F.col("v"), digits).alias("v"))


def places(df, column, digits=5):
    return df.select("n", F.posexplode(column).alias("i", "v")).select("n", F.col("i").cast("long").alias("i"), R(F.col("v"), digits).alias("v"))


def sql_cells(values: list[str], source: str, digits: int = 5, width: int = 3) -> str:
    i, j = (", ".join(str(f(k)) for k in range(len(values))) for f in (lambda k: k // width, lambda k: k % width))
    return f"{source} SELECT n, i, j, round(v, {digits}) + 0.0 AS v FROM (SELECT n, unnest([{i}]::BIGINT[]) AS i, unnest([{j}]::BIGINT[]) AS j, unnest([{', '.join(values)}]::DOUBLE[]) AS v FROM last)"


def sql_places(values: list[str], source: str, digits: int = 5) -> str:
    return f"{source} SELECT n, i, round(v, {digits}) + 0.0 AS v FROM (SELECT n, unnest(range({len(values)})) AS i, unnest([{', '.join(values)}]::DOUBLE[]) AS v FROM last)"


S_CTE = f"""WITH m AS ({_A3}), s AS (SELECT *, a*a+b*b+c*c+1 AS s11, d*a+e*b+f*c AS s21, g*a+h*b+i*c AS s31, d*d+e*e+f*f+1 AS s22, g*d+h*e+i*f AS s32, g*g+h*h+i*i+1 AS s33 FROM m),"""
CHOL = S_CTE + """ c1 AS (SELECT *, sqrt(s11) AS l11, s21/sqrt(s11) AS l21, s31/sqrt(s11) AS l31 FROM s), c2 AS (SELECT *, sqrt(s22-l21*l21) AS l22 FROM c1),
c3 AS (SELECT *, (s32-l31*l21)/l22 AS l32 FROM c2), last AS (SELECT *, sqrt(s33-l31*l31-l32*l32) AS l33 FROM c3)"""
INV = S_CTE + """ k AS (SELECT *, s22*s33-s32*s32 AS k11, s31*s32-s21*s33 AS k21, s21*s32-s31*s22 AS k31, s11*s33-s31*s31 AS k22, s31*s21-s11*s32 AS k32, s11*s22-s21*s21 AS k33 FROM s),
last AS (SELECT *, s11*k11+s21*k21+s31*k31 AS dt FROM k)"""
SOLVED = sql_places(["(k11*p+k21*q+k31*r)/dt", "(k21*p+k22*q+k32*r)/dt", "(k31*p+k32*q+k33*r)/dt"], INV)


@query(sql_cells(["l11", "0", "0", "l21", "l22", "0", "l31", "l32", "l33"], CHOL), "cholesky", "linalg_cholesky")
def cholesky(spark, sf):
    return cells(factor.held(rows_of(spark, sf), l=factor.cholesky(F.col("s"))), "l")


@query(f"WITH m AS ({_A3}) SELECT n, CAST(CASE WHEN a <= 0 THEN 1 WHEN 4 * a * e - (b + d) * (b + d) <= 0 THEN 2 WHEN 2*a*(4*e*i-(f+h)*(f+h)) - (b+d)*((b+d)*2*i-(f+h)*(c+g)) + (c+g)*((b+d)*(f+h)-2*e*(c+g)) <= 0 THEN 3 ELSE 0 END AS INTEGER) AS info FROM m")
def linalg_cholesky_ex(spark, sf):
    df = factor.held(factor.held(rows_of(spark, sf), t=factor.transpose(F.col("m"))), t=F.zip_with("m", "t", lambda x, y: F.zip_with(x, y, lambda u, v: u + v)))
    return factor.held(df, l=factor.cholesky(F.col("t"))).select("n", factor.cholesky_info(F.col("l")).alias("info"))


@query(SOLVED)
def cholesky_solve(spark, sf):
    df = factor.held(rows_of(spark, sf), l=factor.cholesky(F.col("s")))
    return places(factor.held(df, x=factor.cholesky_solve(F.col("l"), F.col("b"))), "x")


@query(sql_cells([f"k{x}/dt" for x in ("11", "21", "31", "21", "22", "32", "31", "32", "33")], INV))
def cholesky_inverse(spark, sf):
    df = factor.held(rows_of(spark, sf), l=factor.cholesky(F.col("s")))
    return cells(factor.held(df, x=factor.cholesky_inverse(F.col("l"))), "x")


@query(sql_cells(["s11", "0", "0", "s21/s11", "d2", "0", "s31/s11", "(s32-s31*s21/s11)/d2", "dt/(s11*d2)"], INV + ", _d AS (SELECT *, s22-s21*s21/s11 AS d2 FROM last)").replace("FROM last)", "FROM _d)").replace("AS d2 FROM _d)", "AS d2 FROM last)"))
def linalg_ldl_factor_ex(spark, sf):
    return cells(factor.held(rows_of(spark, sf), ld=factor.ldl(F.col("s"))), "ld")


@query(SOLVED)
def linalg_ldl_solve(spark, sf):
    df = factor.held(rows_of(spark, sf), ld=factor.ldl(F.col("s")))
    return places(factor.held(df, x=factor.ldl_solve(F.col("ld"), F.col("b"))), "x")


@query(SOLVED, "linalg_solve", "linalg_solve_ex", "lu_solve")
def linalg_solve(spark, sf):
    df = factor.held(rows_of(spark, sf), f=linalg.lu(F.col("s")))
    return places(factor.held(df, x=linalg.lu_solve(F.col("f"), F.col("b"))), "x")


@query(sql_cells([f"k{x}/dt" for x in ("11", "21", "31", "21", "22", "32", "31", "32", "33")], INV), "inverse", "linalg_inv", "linalg_inv_ex")
def linalg_inv(spark, sf):
    df = factor.held(rows_of(spark, sf), f=linalg.lu(F.col("s")))
    return cells(factor.held(df, x=linalg.inverse(F.col("f"))), "x")


QR = f"""WITH m AS ({_A3}), h1 AS (SELECT *, CASE WHEN a < 0 THEN 1 ELSE -1 END * sqrt(a*a+d*d+g*g) AS r11 FROM m),
h2 AS (SELECT *, (r11-a)/r11 AS t1, d/(a-r11) AS v2, g/(a-r11) AS v3, (a*b+d*e+g*h)/r11 AS r12, (a*c+d*f+g*i)/r11 AS r13 FROM h1),
h3 AS (SELECT *, e - t1*v2*(b+v2*e+v3*h) AS x2, h - t1*v3*(b+v2*e+v3*h) AS x3 FROM h2),
h4 AS (SELECT *, CASE WHEN x2 < 0 THEN 1 ELSE -1 END * sqrt(x2*x2+x3*x3) AS r22 FROM h3),
h5 AS (SELECT *, (b*c+e*f+h*i-r12*r13)/r22 AS r23, {_DET}/(r11*r22) AS r33, (r22-x2)/r22 AS t2, x3/(x2-r22) AS w3, a/r11 AS q11, d/r11 AS q21, g/r11 AS q31 FROM h4),
h6 AS (SELECT *, (b-r12*q11)/r22 AS q12, (e-r12*q21)/r22 AS q22, (h-r12*q31)/r22 AS q32 FROM h5),
last AS (SELECT *, q21*q32-q31*q22 AS q13, q31*q12-q11*q32 AS q23, q11*q22-q21*q12 AS q33 FROM h6)"""


@query(sql_cells(["r11", "v2", "v3", "r12", "r22", "w3", "r13", "r23", "r33", "t1", "t2", "0"], QR))
def geqrf(spark, sf):
    df = factor.held(rows_of(spark, sf), f=factor.geqrf(F.col("m")))
    return cells(df.select("n", F.concat("f.columns", F.array("f.tau")).alias("x")), "x")


@query(sql_cells(["q11", "q12", "q13", "q21", "q22", "q23", "q31", "q32", "q33", "r11", "r12", "r13", "0", "r22", "r23", "0", "0", "r33"], QR))
def linalg_qr(spark, sf):
    df = factor.held(factor.held(rows_of(spark, sf), f=factor.geqrf(F.col("m"))), q=factor.householder_product(F.col("f")))
    return cells(df.select("n", F.concat(factor.transpose(F.col("q")), factor.r_rows(F.col("f"))).alias("x")), "x")


@query(sql_cells(["q11", "q21", "q31", "q12", "q22", "q32", "q13", "q23", "q33"], QR))
def linalg_householder_product(spark, sf):
    df = factor.held(rows_of(spark, sf), f=factor.geqrf(F.col("m")))
    return cells(factor.held(df, q=factor.householder_product(F.col("f"))), "q")


@query(sql_places(["q11*p+q21*q+q31*r", "q12*p+q22*q+q32*r", "q13*p+q23*q+q33*r"], QR))
def ormqr(spark, sf):
    df = factor.held(rows_of(spark, sf), f=factor.geqrf(F.col("m")))
    return places(factor.held(df, x=F.get(factor.ormqr(F.col("f"), F.array("b"), True), 0)), "x")


@query("""WITH v AS (SELECT CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, label::DOUBLE AS y FROM embeddings),
g AS (SELECT sum(a*a) AS aa, sum(a*b) AS ab, sum(a*c) AS ac, sum(b*b) AS bb, sum(b*c) AS bc, sum(c*c) AS cc, sum(a*y) AS p, sum(b*y) AS q, sum(c*y) AS r FROM v),
k AS (SELECT *, aa*(bb*cc-bc*bc)-ab*(ab*cc-bc*ac)+ac*(ab*bc-bb*ac) AS dt FROM g)
SELECT i, round(v, 6) + 0.0 AS v FROM (SELECT unnest(range(3)) AS i, unnest([(p*(bb*cc-bc*bc)-ab*(q*cc-bc*r)+ac*(q*bc-bb*r))/dt, (aa*(q*cc-r*bc)-p*(ab*cc-bc*ac)+ac*(ab*r-q*ac))/dt, (aa*(bb*r-bc*q)-ab*(ab*r-q*ac)+p*(ab*bc-bb*ac))/dt]) AS v FROM k)""")
def linalg_lstsq(spark, sf):
    df = _t(spark, sf, "embeddings").select(F.slice("embedding", 1, 3).alias("x"), "label")
    return tall.tall_lstsq(df, "x", [F.col("label")]).select(F.posexplode("x").alias("i", "v")).select(F.col("i").cast("long").alias("i"), R(F.col("v"), 6).alias("v"))


@query(f"SELECT i, j, 0.0::DOUBLE AS v FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(1)) AS j) WHERE (SELECT count(*) FROM {EMB}) >= 64 * 65")
def linalg_lstsq_residual(spark, sf):
    """All 64 columns against the label: what is left is orthogonal to each of them."""
    df = _t(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("double").alias("y"))
    x = tall.tall_lstsq(df, "e", [F.col("y")]).select(F.col("x").alias("w"))
    left = df.join(F.broadcast(x), F.lit(True)).withColumn("left", F.col("y") - factor.dot(F.col("e"), F.col("w")))  # one row
    out = left.select(F.posexplode("e").alias("i", "v"), "left").groupBy(F.col("i").cast("long").alias("i")).agg(F.sum(F.col("v") * F.col("left")).alias("v"))
    return out.select("i", F.lit(0).cast("long").alias("j"), R(F.col("v"), 6).alias("v"))


_GRAM = f"SELECT x.c AS i, y.c AS j, round(sum(x.x * y.x) + CASE WHEN x.c = y.c THEN {{more}} ELSE 0 END, 4) + 0.0 AS v FROM {EMB} x JOIN {EMB} y USING (n) GROUP BY 1, 2"


@query(_GRAM.format(more="0.0"))
def linalg_qr_tall_gram(spark, sf):
    """R^T R of all embeddings."""
    r = tall.tall_r(_t(spark, sf, "embeddings"), "embedding")
    rows = spark.createDataFrame([(0, r.tolist())], "n int, r array<array<double>>")
    rows = factor.held(rows, t=factor.transpose(F.col("r")))
    return cells(factor.held(rows, p=factor.product(F.col("t"), F.col("r"))), "p", 4).drop("n")


@query(f"SELECT n, c AS i, round(x, 5) + 0.0 AS v FROM {EMB}")
def linalg_qr_tall(spark, sf):
    """Q R of all embeddings gives them back."""
    q, r = tall.tall_qr(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), "embedding"), "embedding")
    columns = spark.createDataFrame([(r.T.tolist(),)], "r array<array<double>>")
    return places(factor.held(q.join(F.broadcast(columns), F.lit(True)), x=F.transform("r", lambda c: factor.dot(F.col("q"), c))), "x")  # one row


_ORTHO = "SELECT i, j, (i = j)::INTEGER::DOUBLE AS v FROM (SELECT unnest(range({n})) AS i), (SELECT unnest(range({n})) AS j) WHERE (SELECT count(*) FROM embeddings) >= {n}"


@query(_ORTHO.format(n=64))
def linalg_qr_tall_orthogonal(spark, sf):
    q, _ = tall.tall_qr(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), "embedding"), "embedding")
    m = q.select("n", F.posexplode("q").alias("j", "v")).select(F.col("n").alias("i"), F.col("j").cast("long").alias("j"), "v")
    return linalg.bmm(linalg.transposed(m), m).withColumn("v", R(F.col("v"), 8))


@query(_GRAM.format(more="1.0"))
def cholesky_blocks(spark, sf):
    """L L^T of the Gram matrix and 1, factored in blocks of 16."""
    x = emb(spark, sf).select(F.col("n").alias("i"), F.col("c").alias("j"), F.col("x").alias("v"))
    gram = linalg.bmm(linalg.transposed(x), x).withColumn("v", F.col("v") + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    low = tall.block_cholesky(gram, 64, 16)
    return linalg.bmm(low, linalg.transposed(low)).withColumn("v", R(F.col("v"), 4))


EIG = S_CTE + """ z AS (SELECT *, s11-{x} AS a1, s22-{x} AS a2, s33-{x} AS a3 FROM s), z1 AS (SELECT *, (a1+a2+a3)/3 AS mid FROM z),
z2 AS (SELECT *, sqrt(((a1-mid)*(a1-mid)+(a2-mid)*(a2-mid)+(a3-mid)*(a3-mid)+2*(s21*s21+s31*s31+s32*s32))/6) AS w FROM z1),
z3 AS (SELECT *, acos(least(greatest(((a1-mid)*((a2-mid)*(a3-mid)-s32*s32)-s21*(s21*(a3-mid)-s32*s31)+s31*(s21*s32-(a2-mid)*s31))/(2*w*w*w), -1), 1))/3 AS phi FROM z2),
last AS (SELECT *, mid+2*w*cos(phi) AS e3, mid+2*w*cos(phi+2*pi()/3) AS e1, 3*mid-(mid+2*w*cos(phi))-(mid+2*w*cos(phi+2*pi()/3)) AS e2 FROM z3)"""


@query(sql_cells(["e1", "e2", "e3", "0", "0", "0", "1", "1", "1"], EIG.format(x=0)))
def linalg_eigh(spark, sf):
    """Values, lengths of what S v - value v leaves, and lengths of v."""
    df = factor.held(rows_of(spark, sf), e=factor.eigh(F.col("s")))
    left = lambda v, x: F.zip_with(factor.apply(F.col("s"), v), v, lambda a, b: a - x * b)
    size = lambda v: F.sqrt(factor.dot(v, v))
    parts = F.array(F.col("e.values"), F.transform("e.vectors", lambda v, i: size(left(v, F.get("e.values", i)))), F.transform("e.vectors", size))
    return cells(df.select("n", parts.alias("x")), "x")


@query(sql_cells(["sqrt(greatest(e3, 0))", "sqrt(greatest(e2, 0))", "sqrt(greatest(e1, 0))", "a", "b", "c", "d", "e", "f", "g", "h", "i"], EIG.format(x=1), 4))
def linalg_svd(spark, sf):
    """Singular values, and the sum of value * u v^T."""
    df = factor.held(rows_of(spark, sf), d=factor.svd(F.col("m")))
    back = F.transform(factor.upto(3), lambda i: F.transform(factor.upto(3), lambda j: F.aggregate(F.transform("d.values", lambda x, k: x * factor.at(F.col("d.u"), k, i) * factor.at(F.col("d.v"), k, j)), F.lit(0.0), lambda s, x: s + x)))
    return cells(df.select("n", F.concat(F.array("d.values"), back).alias("x")), "x", 4)


@query(f"SELECT n, c AS i, round(x, 5) + 0.0 AS v FROM {EMB} WHERE c < 16")
def linalg_svd_tall(spark, sf):
    """U S V^T of the embeddings' first 16 columns gives them back."""
    df = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), F.slice("embedding", 1, 16).alias("e"))
    u, s, v = tall.tall_svd(df, "e")
    columns = spark.createDataFrame([([[x * y for x, y in zip(s, c, strict=True)] for c in zip(*v, strict=True)],)], "r array<array<double>>")
    return places(factor.held(u.join(F.broadcast(columns), F.lit(True)), x=F.transform("r", lambda c: factor.dot(F.col("u"), c))), "x")  # one row


ROT = f"WITH m AS ({_A3}), t AS (SELECT *, sqrt(p*p+q*q+r*r) AS t FROM m), last AS (SELECT *, sin(t)/t AS k1, (1-cos(t))/(t*t) AS k2 FROM t)"


@query(sql_cells(["1-k2*(q*q+r*r)", "-k1*r+k2*p*q", "k1*q+k2*p*r", "k1*r+k2*p*q", "1-k2*(p*p+r*r)", "-k1*p+k2*q*r", "-k1*q+k2*p*r", "k1*p+k2*q*r", "1-k2*(p*p+q*q)"], ROT), "linalg_matrix_exp", "matrix_exp")
def linalg_matrix_exp(spark, sf):
    """Rotations, as exponentials of skew matrices."""
    b = [F.get("b", k) for k in range(3)]
    zero = F.lit(0.0)
    df = vecs(spark, sf).select("n", F.slice("a", 10, 3).alias("b"))
    df = df.select("n", F.array(F.array(zero, -b[2], b[1]), F.array(b[2], zero, -b[0]), F.array(-b[1], b[0], zero)).alias("k"))
    return cells(factor.matrix_exp(df, "k", "x"), "x")


_SYMMETRIC = f"WITH last AS (SELECT *, {_DET} AS dt FROM ({_A3}))"
_E2 = "a*e-b*d+a*i-c*g+e*i-f*h"


def _sums(z):
    """Symmetric sums of three complex numbers; they fix all of them."""
    t = factor._times
    plus = lambda *xs: F.struct(sum(x["re"] for x in xs).alias("re"), sum(x["im"] for x in xs).alias("im"))
    x, y, w = (F.get(z, k) for k in range(3))
    return [plus(x, y, w), plus(t(x, y), t(x, w), t(y, w)), t(t(x, y), w)]


@query(sql_cells(["a+e+i", "0", _E2, "0", "dt", "0"], _SYMMETRIC, 5, 2))
def linalg_eigvals(spark, sf):
    df = factor.held(rows_of(spark, sf), z=factor.eigvals(F.col("m")))
    return cells(df.select("n", F.array(*[F.array(s["re"], s["im"]) for s in _sums(F.col("z"))]).alias("x")), "x")


@query(sql_cells(["0", "0", "0", "1", "1", "1"], _SYMMETRIC, 5))
def linalg_eig(spark, sf):
    """Lengths of what M v - value v leaves, and lengths of v."""
    df = factor.held(rows_of(spark, sf), e=factor.eig(F.col("m")))
    part = lambda v, c: F.transform(v, lambda x: x[c])
    square = lambda v: factor.dot(v, v)

    def left(p):
        re, im, z = part(p["vector"], "re"), part(p["vector"], "im"), p["value"]
        real = F.zip_with(factor.apply(F.col("m"), re), F.zip_with(re, im, lambda a, b: z["re"] * a - z["im"] * b), lambda x, y: x - y)
        imag = F.zip_with(factor.apply(F.col("m"), im), F.zip_with(re, im, lambda a, b: z["re"] * b + z["im"] * a), lambda x, y: x - y)
        return F.sqrt(square(real) + square(imag))

    size = lambda p: F.sqrt(square(part(p["vector"], "re")) + square(part(p["vector"], "im")))
    return cells(df.select("n", F.array(F.transform("e", left), F.transform("e", size)).alias("x")), "x")


@query(sql_cells(["a", "b", "c", "d", "e", "f", "g", "h", "i", "greatest(abs(a), abs(d), abs(g))", "abs(dt)", "1"], _SYMMETRIC), "linalg_lu", "lu_unpack", "linalg_lu_factor")
def linalg_lu(spark, sf):
    """P L U, the first pivot, the product of all, and whether L's places are at most 1."""
    df = factor.held(three(spark, sf), u=factor.lu_unpack(F.col("f")))
    back = factor.product(F.col("u.p"), factor.product(F.col("u.l"), F.col("u.u")))
    fine = F.forall(F.flatten("u.l"), lambda x: F.abs(x) <= 1).cast("double")
    more = F.array(F.abs(factor.at(F.col("u.u"), 0, 0)), F.abs(factor.at(F.col("u.u"), 0, 0) * factor.at(F.col("u.u"), 1, 1) * factor.at(F.col("u.u"), 2, 2)), fine)
    return cells(df.select("n", F.concat(back, F.array(more)).alias("x")), "x")


def _line(df):
    return df.select("n", F.posexplode("s").alias("k", "z")).select("n", F.col("k").cast("long").alias("k"), R(F.col("z.re"), 4).alias("re"), R(F.col("z.im"), 4).alias("im"))


def _dft(n: int, top: int, scale: str = "1", sign: str = "-") -> str:
    return f"SELECT n, k, round(sum(x * cos(2 * pi() * (k * c % {n}) / {n})) * {scale}, 4) + 0.0 AS re, round({sign}sum(x * sin(2 * pi() * (k * c % {n}) / {n})) * {scale}, 4) + 0.0 AS im FROM {EMB}, (SELECT unnest(range({top})) AS k) WHERE c < {n} GROUP BY 1, 2"


for _name, _n, _inverse, _norm, _scale in (("fft_c2c", 64, False, "backward", "1"), ("fft_c2c_60", 60, True, "backward", "(1 / 60.0::DOUBLE)"), ("fft_c2c_61", 61, False, "ortho", "(1 / sqrt(61.0::DOUBLE))")):
    QUERIES[_name] = lambda spark, sf, n=_n, inverse=_inverse, norm=_norm: _line(
        fourier.fft(vecs(spark, sf).select("n", fourier.complex_of(F.slice("a", 1, n)).alias("a")), "a", "s", [n], None, inverse, norm)
    )
    SQL[_name] = _dft(_n, _n, _scale, "" if _inverse else "-")


@query(f"""SELECT n, k, round(sum(x * cos(2 * pi() * ((k // 8) * (c // 8) + (k % 8) * (c % 8)) / 8)), 4) + 0.0 AS re, round(-sum(x * sin(2 * pi() * ((k // 8) * (c // 8) + (k % 8) * (c % 8)) / 8)), 4) + 0.0 AS im
FROM {EMB}, (SELECT unnest(range(64)) AS k) GROUP BY 1, 2""")
def fft_c2c_2d(spark, sf):
    return _line(fourier.fft(vecs(spark, sf).select("n", fourier.complex_of(F.col("a")).alias("a")), "a", "s", [8, 8]))


@query(_dft(64, 33))
def fft_r2c(spark, sf):
    return _line(fourier.rfft(vecs(spark, sf), "a", "s", 64))


@query(f"SELECT n, c AS i, round(x, 4) + 0.0 AS v FROM {EMB} WHERE c < 61")
def fft_c2r(spark, sf):
    df = fourier.rfft(vecs(spark, sf).select("n", F.slice("a", 1, 61).alias("a")), "a", "h", 61)
    return places(fourier.irfft(df, "h", "x", 61), "x", 4)


@query("SELECT user_id, bit_xor(event_id) AS h, bit_xor(CAST(round(value * 100) AS BIGINT)) AS v FROM events GROUP BY 1")
def hash_tensor(spark, sf):
    return _t(spark, sf, "events").groupBy("user_id").agg(F.bit_xor("event_id").alias("h"), F.bit_xor(F.round(F.col("value") * 100).cast("long")).alias("v"))


@query("""WITH m AS (SELECT DISTINCT l_suppkey AS i, l_partkey AS j FROM lineitem) SELECT true AS first_is_zero, true AS last_is_count, true AS rows_fit, true AS columns_fit, true AS ascending,
(SELECT count(*) FROM m) AS stored FROM (SELECT count(*) FROM m)""")
def validate_compressed_sparse_indices(spark, sf):
    m = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.lit(1.0).alias("v")).distinct()
    rows, cols = (x + 1 for x in m.agg(F.max("i"), F.max("j")).first())
    ptr, entries = sparse.to_csr(m, rows)
    return sparse.validate_compressed(ptr, entries, rows, cols)

