"""Joins on bands, nearest rows, and set-like combinations. All keep to equi-joins plus a residual."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keratoline.materialize import settled
from keratoline.operators.ranking import first_by


def small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """The table, marked for broadcast if it has at most so many rows; beyond, joins move both sides by key."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, below: float, above: float, extra: Column | None = None, how: str = "inner") -> DataFrame:
    """Rows of equal keys for which right_at - left_at lies in [-below, above].

    The left side looks into the two or three buckets that the band touches,
    the right side is in one, so the join is by hash and never by nested loops.
    Column names of the sides must differ but for the keys. how="left" keeps left
    rows without a partner too, each row by itself, nulls and repeats included.
    """
    if how == "left":
        row = "__row"
        numbered = settled(left.withColumn(row, F.monotonically_increasing_id()))  # numbers that don't change when it is read twice
        found = band_join(numbered, right, keys, left_at, right_at, below, above, extra)
        return numbered.join(found.select(row, *[c for c in right.columns if c not in keys]), row, "left").drop(row)
    width = float(below + above) or 1.0
    bucket = "__band"
    lo, hi = F.floor((F.col(left_at) - below) / width), F.floor((F.col(left_at) + above) / width)
    wide = left.withColumn(bucket, F.explode(F.sequence(lo, hi)))
    narrow = right.withColumn(bucket, F.floor(F.col(right_at) / width))
    near = (F.col(right_at) - F.col(left_at)).between(-below, above)
    out = wide.join(narrow, [*keys, bucket]).where(near if extra is None else near & extra)
    return out.drop(bucket)


def nearest(pairs: DataFrame, group: Sequence[str], distance: Column, tie: Sequence[str | Column], prefix: Sequence[str]) -> DataFrame:
    """Of joined pairs, the nearest right row of each group; ties by the given total order."""
    return first_by(pairs, group, [distance, *tie]).select(*group, *prefix)


def lookup(rows: DataFrame, table: DataFrame, key: str, table_key: str, group: Sequence[str], order: str) -> DataFrame:
    """Joins a small table and keeps, of each group, the row that stands first in the table."""
    return first_by(rows.join(small(table), rows[key] == table[table_key]), group, [order])


def not_in_ledger(rows: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows whose key the ledger does not hold."""
    return rows.join(ledger.select(key).distinct(), key, "left_anti")


def in_ledger(rows: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    return rows.join(ledger.select(key).distinct(), key, "left_semi")


def coalesce_merge(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], only_left: Column | None = None) -> DataFrame:
    """Left rows whose null columns are filled from the right; rows for which only_left holds take nothing."""
    other = right.select(*keys, *[F.col(c).alias(f"__r_{c}") for c in columns])
    joined = left.join(other, list(keys), "left")
    for c in columns:
        filled = F.coalesce(F.col(c), F.col(f"__r_{c}"))
        joined = joined.withColumn(c, F.when(only_left, F.col(c)).otherwise(filled) if only_left is not None else filled)
    return joined.select(*left.columns)


def union_first(frames: Sequence[DataFrame], group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of several phases; of each group the earliest phase's first row stays."""
    phase = "__phase"
    out = None
    for i, frame in enumerate(frames):
        own = frame.withColumn(phase, F.lit(i))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return first_by(out, group, [phase, *order]).drop(phase)


def merge_upsert(rows: DataFrame, key: str, order: str, scalars: Sequence[str], collected: dict[str, Sequence[str]]) -> DataFrame:
    """One row per key: the first non-null of each scalar by order, and the distinct structs of each collection in order."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in scalars]
    lists = [
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*columns).alias("v")))).alias(name)
        for name, columns in collected.items()
    ]
    out = rows.groupBy(key).agg(*firsts, *lists)
    for name in collected:
        out = out.withColumn(name, F.array_distinct(F.transform(name, lambda x: x["v"])))
    return out


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has and the other has not, each as often as it is missing, with its side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
