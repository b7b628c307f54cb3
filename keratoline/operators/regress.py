"""Least squares lines, plain and robust, for all groups at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keratoline.operators.median import exact_median


def line(y: str | Column, x: str | Column, flat: Column | None = None) -> tuple[Column, Column]:
    """(slope, intercept) aggregates. Where x does not vary: slope 1, intercept 0 or `flat`."""
    slope = F.regr_slope(y, x)
    return F.coalesce(slope, F.lit(1.0)), F.when(slope.isNull(), F.lit(0.0) if flat is None else flat).otherwise(F.regr_intercept(y, x))


def affine_fit(pairs: DataFrame, group: Sequence[str], y: str, y_ref: str, x: str | None = None, x_ref: str | None = None, limit: float = 40.0, least: int = 5) -> DataFrame:
    """Per group: alpha and beta with y = alpha * y_ref + beta, robustly, and the same of x.

    Under `least` pairs give the identity with 0 inliers. Pairs off the first
    line by `limit` or more are left out of a second fit if `least` remain.
    resid_std is the population deviation of the inliers' residuals, delta_x
    the median shift in x, by operators.median, so groups may be of any size; of
    shifts, NaN is the largest. Two aggregations besides, whatever the number of groups.
    """
    axes = [("y", y, y_ref)] + ([("x", x, x_ref)] if x else [])
    aggs = [F.count("*").alias("n_pairs")]
    for name, at, ref in axes:
        slope, start = line(at, ref)
        aggs += [slope.alias(f"a0_{name}"), start.alias(f"b0_{name}")]
    if x:
        shift = (F.col(x) - F.col(x_ref)).cast("double")
        aggs += [F.count(shift).alias("n_shift"), F.count_if(F.isnan(shift)).alias("n_nan")]
    first = pairs.groupBy(*group).agg(*aggs)
    if x:
        # NaN takes no part in exact_median: it goes there as infinite, and is put back where a middle rank falls on it.
        shifts = pairs.select(*group, F.when(F.isnan(shift), F.lit(float("inf"))).otherwise(shift).alias("__shift"))
        medians = exact_median(shifts, list(group), "__shift").withColumnRenamed("median", "shift")
        upper = F.floor(F.col("n_shift") / 2) + 1
        first = first.join(medians, list(group), "left").withColumn("shift", F.when(upper > F.col("n_shift") - F.col("n_nan"), F.when(F.col("n_shift") > 0, F.lit(float("nan")))).otherwise(F.col("shift"))).drop("n_shift", "n_nan")
    marked = pairs.join(first, list(group))
    again = []
    for name, at, ref in axes:
        off = F.abs(F.col(at) - (F.col(f"a0_{name}") * F.col(ref) + F.col(f"b0_{name}")))
        marked = marked.withColumn(f"in_{name}", off < limit)
        yi, ri = F.when(F.col(f"in_{name}"), F.col(at)), F.when(F.col(f"in_{name}"), F.col(ref))
        ei = yi - (F.col(f"a0_{name}") * ri + F.col(f"b0_{name}"))  # off the first line, so that the spread is not a small difference of large numbers
        slope, start = line(yi, ri)
        again += [F.count_if(f"in_{name}").alias(f"n_{name}"), slope.alias(f"a1_{name}"), start.alias(f"b1_{name}")]
        again += [F.var_pop(ei).alias(f"ve_{name}"), F.var_pop(ri).alias(f"vr_{name}"), F.covar_pop(ei, ri).alias(f"c_{name}")]
    kept = [c for c in first.columns if c not in group]
    out = marked.groupBy(*group).agg(*[F.first(c).alias(c) for c in kept], *again)
    enough = F.col("n_pairs") >= least

    def fitted(name: str) -> tuple[Column, Column]:
        more = F.col(f"n_{name}") >= least
        return tuple(F.when(enough, F.when(more, F.col(f"{p}1_{name}")).otherwise(F.col(f"{p}0_{name}"))) for p in "ab")

    a, b = fitted("y")
    turn = a - F.col("a0_y")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("ve_y") + turn * turn * F.col("vr_y") - 2 * turn * F.col("c_y")))
    zero = F.lit(0.0)
    columns = [
        *group, F.coalesce(a, F.lit(1.0)).alias("alpha"), F.coalesce(b, zero).alias("beta"),
        F.when(enough, spread).otherwise(zero).alias("resid_std"), F.when(enough, F.col("n_y")).otherwise(0).alias("n_inliers"), "n_pairs",
    ]
    if x:
        a, b = fitted("x")
        columns += [F.when(enough, F.col("shift")).otherwise(zero).alias("delta_x"), F.coalesce(a, F.lit(1.0)).alias("alpha_x"), F.coalesce(b, zero).alias("beta_x")]
    return out.select(*columns)
