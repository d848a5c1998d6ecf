"""Operators over an order of all rows: running aggregates, as-of joins and interval joins, none of which puts a group into one task.

Rows are dealt into parts, ranges of (keys, order, hash of the row) of some PART_ROWS rows each, cut at a sample. A key or a value that a third of the rows
have is cut as well, by the columns behind it. Within a part a window runs; a table of part totals, a row for each part and key, is scanned by itself and
carries on from part to part. As parts are ranges of the keys first, only the first key of a part can have begun before it, so what is carried is a row a
part at most, and that is broadcast.

The cuts decide balance alone: they are literals of the plan, so a task that runs again deals its rows alike. Rows equal in every column stay together.
Nulls are a key like others and come first in an order; NaN comes last.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import factor

PART_ROWS = 1 << 20
MOST_PARTS = 4096
#: Rows of the sample for each part.
SAMPLE = 60


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left and the columns that right has besides the keys, where keys are equal; nulls equal nulls."""
    names = {k: f"_key{i}_{k}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return left.join(right, on, how).drop(*names.values())


def _literal(row, types: list) -> Column:
    return F.struct(*[F.lit(v).cast(t).alias(f"c{i}") for i, (v, t) in enumerate(zip(row, types, strict=True))])


def _cuts(df: DataFrame, order: list[Column], part_rows: int, n_rows: int | None) -> list[Column]:
    """Literals that cut the rows into ranges of about part_rows in this order; none for a table of one part."""
    total = df.count() if n_rows is None else n_rows
    parts = min(math.ceil(total / part_rows), MOST_PARTS)
    if parts < 2:
        return []
    places = df.select(*[c.alias(f"c{i}") for i, c in enumerate(order)])
    names = places.columns
    sample = places.sample(min(1.0, SAMPLE * parts / total), seed=1).orderBy(*names).collect()
    types = [f.dataType for f in places.schema.fields]
    chosen = {i * len(sample) // parts: None for i in range(1, parts)} if sample else {}
    return [_literal(sample[i], types) for i in chosen]


def _part(cuts: list[Column], at: Column) -> Column:
    """How many cuts aren't above a row's place, by halving."""
    table, steps = F.array(*cuts), F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(table, n + step - 1) <= at, n + step).otherwise(n))


def dealt(df: DataFrame, order: list[str], part_rows: int = PART_ROWS, n_rows: int | None = None) -> tuple[DataFrame, list[str]]:
    """df with _part, ranges of `order` that follow each other, and the columns to sort by within one. n_rows: how many rows there are, if known."""
    tie = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields])
    rows = df.withColumn("_tie", tie)
    columns = [F.col(c) for c in (*order, "_tie")]
    cuts = _cuts(rows, columns, part_rows, n_rows)
    if not cuts:
        return rows.withColumn("_part", F.lit(0)), [*order, "_tie"]
    at = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    return factor.held(rows, _place=at).withColumn("_part", _part(cuts, F.col("_place"))).drop("_place"), [*order, "_tie"]


#: Aggregate and the way in which two of its results merge.
MONOIDS = {
    "sum": (F.sum, lambda a, b: a + b),
    "product": (F.product, lambda a, b: a * b),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def scan(df: DataFrame, keys: list[str], order: list[str], part_rows: int = PART_ROWS, n_rows: int | None = None, **values: tuple[str, Column]) -> DataFrame:
    """df with running aggregates up to each row in `order` within the keys. values: name=(monoid, column); nulls don't count."""
    held = {f"_v_{n}": c for n, (_, c) in values.items()}
    rows, by = dealt(df.withColumns(held), [*keys, *[o for o in order if o not in keys]], part_rows, n_rows)
    by = by[len(keys) :]
    near = Window.partitionBy(*keys, "_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_part").agg(*[MONOIDS[m][0](f"_v_{n}").alias(f"_t_{n}") for n, (m, _) in values.items()])
    carry = totals.select(*keys, "_part", F.count("*").over(past).alias("_earlier"), *[MONOIDS[m][0](f"_t_{n}").over(past).alias(f"_c_{n}") for n, (m, _) in values.items()])
    carry = carry.where("_earlier > 0").drop("_earlier")
    out = rows.select("*", *[MONOIDS[m][0](f"_v_{n}").over(near).alias(f"_o_{n}") for n, (m, _) in values.items()])
    out = match(out, F.broadcast(carry), [*keys, "_part"])  # a row a part at most
    merged = [
        F.when(F.col(f"_c_{n}").isNull(), F.col(f"_o_{n}")).when(F.col(f"_o_{n}").isNull(), F.col(f"_c_{n}")).otherwise(MONOIDS[m][1](F.col(f"_c_{n}"), F.col(f"_o_{n}"))).alias(n)
        for n, (m, _) in values.items()
    ]
    return out.select(*[c for c in df.columns if c not in values], *merged)


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, part_rows: int = PART_ROWS) -> DataFrame:
    """df with _previous, a struct of the value of the row before within the keys; null for the first row."""
    rows, by = dealt(df, [*keys, *[o for o in order if o not in keys]], part_rows)
    by = by[len(keys) :]
    held = F.struct(F.col(value).alias("v"))
    own = F.lag(held).over(Window.partitionBy(*keys, "_part").orderBy(*by))
    ends = rows.groupBy(*keys, "_part").agg(F.max_by(held, F.struct(*by)).alias("_end"))
    past = F.lag("_end").over(Window.partitionBy(*keys).orderBy("_part"))
    carry = ends.select(*keys, "_part", past.alias("_end")).where(F.col("_end").isNotNull())
    out = match(rows.withColumn("_own", own), F.broadcast(carry), [*keys, "_part"])  # a row a part at most
    return out.select(*df.columns, F.coalesce("_own", "_end").alias("_previous"))


def numbered(df: DataFrame, order: list[str], name: str = "n", keys: list[str] | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Each row's number from 0 in the order, within its keys."""
    return scan(df, keys or [], order, part_rows, **{name: ("sum", F.lit(1).cast("long"))}).withColumn(name, F.col(name) - 1)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, columns: list[str], forward: bool = False, part_rows: int = PART_ROWS) -> DataFrame:
    """left with the columns of the last row of right at or before `at` (forward: the first at or after), within the keys; null where there is none.

    Both sides go into one order of (keys, time), right rows before left rows of the same time, and a running maximum of (time, columns) carries the last
    one on. Of right rows of the same time that with the greatest columns is taken; rows of a null time match nothing."""
    left_time, right_time = F.col(at), F.col(right_at)
    if forward:
        left_time, right_time = (F.negative(_ticks(c, dict(df.dtypes)[n])) for c, df, n in ((left_time, left, at), (right_time, right, right_at)))
    asked = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], left_time.alias("_at"), F.lit(1).alias("_side"), F.struct("*").alias("_left"))
    told = right.where(F.col(right_at).isNotNull()).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], right_time.alias("_at"), F.lit(0).alias("_side"), F.struct(*columns).alias("_told")
    )
    both = asked.unionByName(told, allowMissingColumns=True)
    last = F.when(F.col("_side") == 0, F.struct("_at", "_told"))
    kept = [f"_k{i}" for i in range(len(keys))]
    out = scan(both, kept, ["_at", "_side"], part_rows, _last=("max", last)).where("_side = 1")
    found = F.when(F.col("_at").isNotNull(), F.col("_last._told"))
    return out.select("_left.*", *[found[c].alias(c) for c in columns])


def _ticks(c: Column, kind: str) -> Column:
    return F.unix_micros(c.cast("timestamp")) if kind.startswith(("timestamp", "date")) else c


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of rows (structs left, right) with equal keys whose closed intervals of whole numbers (start, end) meet.

    An interval has the level of its length's power of four, rounded up, and meets at most two buckets of that width. A pair is looked for at the greater of both
    levels: each interval stands in the buckets of its own level and of those above it that the other side uses, some two for each level, whatever its
    length. The pair's owner is the bucket in which the later of both begins, so each is found once, by an equi-join on (keys, level, bucket) that
    adaptive execution splits where a bucket is skewed. Rows with a null or an end before the start meet nothing."""

    def levelled(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        """The row's columns stay apart until pairs are made, so that those that nobody reads aren't shuffled."""
        start, end = (F.col(s).cast("long") for s in span)
        held = [F.col(c).alias(f"_{name}_{i}") for i, c in enumerate(df.columns)]
        rows = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], start.alias(f"_{name}_s"), end.alias(f"_{name}_e"), *held)
        rows = rows.where(F.col(f"_{name}_e") >= F.col(f"_{name}_s"))
        bits = F.length(F.bin(F.col(f"_{name}_e") - F.col(f"_{name}_s")))
        return rows.withColumn(f"_{name}_l", bits + bits % 2)

    a, b = levelled(left, left_span, "left"), levelled(right, right_span, "right")
    used = sorted({r[0] for r in a.select("_left_l").unionByName(b.select(F.col("_right_l").alias("_left_l"))).distinct().collect()})  # 32 at most

    def spread(df: DataFrame, name: str) -> DataFrame:
        above = F.filter(F.array(*[F.lit(x) for x in used]), lambda x: x >= F.col(f"_{name}_l"))
        rows = df.withColumn("_level", F.explode(above))
        shifted = lambda c: F.call_function("shiftright", F.col(c), F.col("_level"))
        return rows.withColumn("_bucket", F.explode(F.sequence(shifted(f"_{name}_s"), shifted(f"_{name}_e"))))

    kept = [f"_k{i}" for i in range(len(keys))]
    pairs = spread(a, "left").join(spread(b, "right"), [*kept, "_level", "_bucket"])
    owner = F.call_function("shiftright", F.greatest("_left_s", "_right_s"), F.col("_level"))
    meets = (F.col("_left_s") <= F.col("_right_e")) & (F.col("_right_s") <= F.col("_left_e"))
    found = pairs.where(meets & (F.col("_level") == F.greatest("_left_l", "_right_l")) & (F.col("_bucket") == owner))
    row = lambda df, name: F.struct(*[F.col(f"_{name}_{i}").alias(c) for i, c in enumerate(df.columns)]).alias(name)
    return found.select(row(left, "left"), row(right, "right"))
