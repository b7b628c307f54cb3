"""First rows, reading order, and modes of one-dimensional clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in a total order."""
    rank = "__rank"
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n).drop(rank)


def first_claim(pairs: DataFrame, group: Sequence[str], label_rank: Sequence[str | Column]) -> DataFrame:
    """Of label-value pairs, those of the earliest label of each group that has a value at all."""
    return first_by(pairs, group, label_rank)


def reading_order(items: DataFrame, page: str, y: str, x: str, ord_: str, line: float = 20.0, out: str = "reading") -> DataFrame:
    """Numbers the items of a page by line (y rounded to `line`), then x, then input order."""
    w = Window.partitionBy(page).orderBy(F.round(F.col(y) / line) * line, x, ord_)
    return items.withColumn(out, F.row_number().over(w))


def cluster_mode(points: DataFrame, group: Sequence[str], at: str, ord_: str, reach: float) -> DataFrame:
    """Per group, the first point with the most points within reach of it: `centre` and `members`.

    Counts come from a range window frame, so there is no self-join.
    """
    near = Window.partitionBy(*group).orderBy(at).rangeBetween(-reach, reach)
    counted = points.withColumn("members", F.count("*").over(near))
    return first_by(counted, group, [F.desc("members"), ord_]).select(*group, F.col(at).alias("centre"), "members")
