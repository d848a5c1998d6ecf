"""Shared tables that survive a lost executor, and joins that survive a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, shared_folder

__all__ = ["Scratch", "hot_limit", "shared_folder", "split_join"]

HOT_SHARE, LEAST_HOT, MOST_HOT, HOT_KEYS = 1000, 10_000, 4_000_000, 1_000_000


def hot_limit(total: int, least: int = LEAST_HOT) -> int:
    """A key with more rows than this, of `total`, is hot: a thousandth of all, within bounds on the rows that a cool key may bring to one
    task. However large the table, fewer than HOT_KEYS keys are hot, so a table of them may be broadcast."""
    return max(min(max(total // HOT_SHARE, least), MOST_HOT), total // HOT_KEYS)


def split_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """left joined with right, whose `weight` says how many rows of left have its key at most.

    right has one row for each key. Hot keys (hot_limit) are few, so that side is broadcast and its rows of left don't move;
    the rest is an ordinary shuffled join. how: inner or left_semi.
    """
    limit = hot_limit(right.agg(F.sum(weight)).first()[0] or 0)
    hot, cool = right.where(F.col(weight) > limit), right.where(F.col(weight) <= limit)
    hot_rows = left.join(F.broadcast(hot), keys, how)
    cool_rows = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cool, keys, how)
    return hot_rows.unionByName(cool_rows)
