"""Row filters and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keratoline.operators.joins import small


def within_ranges(rows: DataFrame, ranges: DataFrame, field: str = "field", value: str = "value") -> DataFrame:
    """Rows whose field has no range, or whose value lies in it (both ends count)."""
    joined = rows.join(small(ranges.withColumnRenamed("field", "__field")), F.col(field) == F.col("__field"), "left")
    return joined.where(F.col("__field").isNull() | F.col(value).between(F.col("lo"), F.col("hi"))).select(*rows.columns)


def outside_ranges(rows: DataFrame, ranges: DataFrame, field: str = "field", value: str = "value") -> DataFrame:
    """Rows whose field has a range and whose value lies outside it."""
    joined = rows.join(small(ranges.withColumnRenamed("field", "__field")), F.col(field) == F.col("__field"))
    return joined.where((F.col(value) < F.col("lo")) | (F.col(value) > F.col("hi"))).select(*rows.columns)


def qa_status(n: Column, least: Column | int) -> Column:
    """`ok`, or how many fields there are of the least number."""
    least = least if isinstance(least, Column) else F.lit(least)
    return F.when(n >= least, F.lit("ok")).otherwise(F.concat(F.lit("incomplete: too few fields: "), n.cast("string"), F.lit("/"), least.cast("string")))


def mutually_exclusive(rows: DataFrame, group: Sequence[str], wins: str, loses: str, field: str = "field") -> DataFrame:
    """Without the losing field's rows in groups that have the winning one. Rows without a field stay."""
    is_ = lambda name: F.coalesce(F.col(field) == name, F.lit(False))
    has = F.max(is_(wins)).over(Window.partitionBy(*group))
    return rows.withColumn("__has", has).where(~(F.col("__has") & is_(loses))).drop("__has")


def classify(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = None
    for rule, name in rules:
        out = F.when(rule, F.lit(name)) if out is None else out.when(rule, F.lit(name))
    return out.otherwise(F.lit(default))


def has_all(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out
