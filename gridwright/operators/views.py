"""Views of tables in coordinate form: new coordinates for the same values. A copying form is the same table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alias(df: DataFrame) -> DataFrame:
    """The same rows: alias, detach, clone and their copies."""
    return df.select("*")


def to(df: DataFrame, value: str, kind: str) -> DataFrame:
    """Values of another type. Numbers out of a whole type's range are null, not an error."""
    return df.withColumn(value, F.col(value).try_cast(kind))


def permute(df: DataFrame, dims: list[str], order: list[str]) -> DataFrame:
    """Dimension number k of the result is order[k]."""
    return df.select(*[F.col(o).alias(d) for d, o in zip(dims, order, strict=True)], *[c for c in df.columns if c not in dims])


def unsqueeze(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.lit(0).cast("long"))


def squeeze(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Without the dimensions of size 1."""
    return df.drop(*[c for c, n in sizes.items() if n == 1])


def repeat(df: DataFrame, sizes: dict[str, int], times: dict[str, int]) -> DataFrame:
    """The whole table `times` over in each dimension."""
    for c, n in times.items():
        df = df.withColumn(c, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col(c) + k * sizes[c])))  # noqa: B023
    return df


def expand(df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Dimensions of size 1, or new ones, become longer by repeating their one place."""
    for c, n in sizes.items():
        df = df.withColumn(c, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return df


def split(df: DataFrame, at: str, sizes: list[int]) -> list[DataFrame]:
    """Consecutive parts of given sizes, each counted from 0."""
    out, start = [], 0
    for n in sizes:
        out.append(df.where(F.col(at).between(start, start + n - 1)).withColumn(at, F.col(at) - start))
        start += n
    return out


def split_ids(df: DataFrame, at: str, sizes: list[int]) -> DataFrame:
    """As split, in one table: part is the part's number."""
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    part = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col(at)))
    first = F.element_at(F.array(*[F.lit(e - n) for e, n in zip(ends, sizes, strict=True)]), part + 1)
    return df.where(F.col(at) < ends[-1]).withColumn("part", part.cast("long")).withColumn(at, (F.col(at) - first).cast("long"))


def chunk(df: DataFrame, at: str, size: int, chunks: int) -> list[DataFrame]:
    """At most `chunks` parts of equal size; the last may be shorter."""
    each = -(-size // chunks)
    return split(df, at, [min(each, size - a) for a in range(0, size, each)])


def chunk_cat(frames: list[DataFrame], at: str, sizes: list[int], chunks: int) -> DataFrame:
    """Each table's parts beside the other tables' parts of the same number: chunk, and a flat place in it. Tables are padded to whole parts with zeros,
    which have no row."""
    out, before = [], 0
    for df, n in zip(frames, sizes, strict=True):
        each = -(-n // chunks)
        out.append(df.withColumn("chunk", F.floor(F.col(at) / each).cast("long")).withColumn(at, (F.col(at) % each + before).cast("long")))
        before += each
    return reduce(DataFrame.unionByName, out)


def unbind(df: DataFrame, at: str, size: int) -> list[DataFrame]:
    return [df.where(F.col(at) == i).drop(at) for i in range(size)]


def as_strided(df: DataFrame, at: str, sizes: dict[str, int], strides: dict[str, int], offset: int = 0) -> DataFrame:
    """A shape whose cell (a, b, ...) reads the flat place offset + a * stride + b * stride ...: places may be read several times, or never."""
    from ..sources.creation import grid

    flat = reduce(lambda x, c: x + F.col(c) * strides[c], sizes, F.lit(offset).cast("long"))
    return grid(df.sparkSession, sizes).withColumn(at, flat).join(df, at).drop(at)


def diagonal(df: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    return df.where(F.col(i) == F.col(j)).drop(j)
