"""Exact medians of groups of any size: sketches say where to look, counts make sure, and only a narrow range is sorted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keratoline.materialize import settled
from keratoline.operators.joins import small

ACCURACY = 10_000  # of the sketches: ranks are off by so small a part of the rows
HELD = 1_000_000  # rows of a group that one task may sort


def exact_median(rows: DataFrame, group: Sequence[str], value: str, held: int = HELD, accuracy: int = ACCURACY) -> DataFrame:
    """(group columns, median) over all groups at once; of an even number of values the mean of the middle two.

    A group is never brought to one task. Each round a mergeable sketch gives two
    values around the middle, all rows are counted against them where they lie,
    and only those in between go on, a few ten-thousandths of a large group.
    Ranges of `held` rows or less, and of a single value, are settled exactly.
    Should a sketch miss the middle, its group goes on with half of its range.
    Null and NaN take no part, a group of nothing else has no row; groups may be null.
    """
    keys = [f"__g{i}" for i in range(len(group))]
    numbers = rows.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    # Nulls are groups too, so keys are joined as structs, which are never null.
    left = settled(numbers.select(F.struct(*keys).alias("k"), "v"))
    size = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    state = settled(size.select("k", "n", F.floor((F.col("n") + 1) / 2).alias("r1"), (F.floor(F.col("n") / 2) + 1).alias("r2")))
    done: list[DataFrame] = []
    while True:
        ready = state.where(F.col("n") <= held)
        done.append(_settle(left.join(small(ready), "k")))
        state = settled(state.where(F.col("n") > held))
        if state.isEmpty():
            break
        left, state, known = _narrowed(left, state, accuracy)
        done.append(known)
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.select(*[F.col(f"k.{k}").alias(g) for g, k in zip(group, keys, strict=True)], "median")


def _narrowed(left: DataFrame, state: DataFrame, accuracy: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows between two values around the middle, their state, medians that are known)."""
    mine = left.join(small(state), "k")
    share = lambda r, off: F.least(F.greatest((F.col(r) + off * F.col("n") * 2 / accuracy) / F.col("n"), F.lit(0.0)), F.lit(1.0))
    # Sketches take constant shares only, so a fixed ladder is asked for and each group takes the two rungs around its ranks.
    rungs = [i / 64 for i in range(65)]
    near = sorted({0.5 + s * d for s in (-1, 1) for d in (2 / accuracy, 8 / accuracy, 1 / 256)} | set(rungs))
    sketch = mine.groupBy("k", "n", "r1", "r2").agg(F.percentile_approx("v", near, accuracy).alias("at"), F.min("v").alias("least"), F.max("v").alias("most"))
    rung = lambda share_, up: F.get("at", _rung(near, share_, up))
    bounds = settled(sketch.select("k", "n", "r1", "r2", F.coalesce(rung(share("r1", -1), False), "least").alias("lo"), F.coalesce(rung(share("r2", 1), True), "most").alias("hi"), "least", "most"))
    counted = left.join(small(bounds), "k").groupBy("k", "n", "r1", "r2", "lo", "hi", "least", "most").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count_if(F.col("v").between(F.col("lo"), F.col("hi"))).alias("inside"))
    hit = (F.col("r1") > F.col("below")) & (F.col("r2") <= F.col("below") + F.col("inside"))
    narrower = F.col("inside") < F.col("n")
    # A sketch that missed, or did not narrow: the half in which the middle is, by count.
    middle = F.col("least") + (F.col("most") - F.col("least")) / 2
    told = settled(counted.withColumns({"hit": hit & (narrower | (F.col("lo") == F.col("hi"))), "middle": middle}))
    known = told.where("hit and lo = hi").select("k", F.col("lo").alias("median"))
    found = told.where("hit and lo < hi").select("k", F.col("inside").alias("n"), (F.col("r1") - F.col("below")).alias("r1"), (F.col("r2") - F.col("below")).alias("r2"), "lo", "hi")
    lost = told.where("not hit").select("k", "n", "r1", "r2", "least", "middle", "most")
    halves = left.join(small(lost), "k").groupBy("k", "n", "r1", "r2", "least", "middle", "most").agg(F.count_if(F.col("v") <= F.col("middle")).alias("lower"))
    lower, upper = F.col("r2") <= F.col("lower"), F.col("r1") > F.col("lower")
    after = lambda c: F.when(upper, F.col(c) - F.col("lower")).otherwise(F.col(c))
    halved = halves.select("k", F.when(lower, F.col("lower")).when(upper, F.col("n") - F.col("lower")).otherwise(F.col("n")).alias("n"), after("r1").alias("r1"), after("r2").alias("r2"), "least", "middle", "most", lower.alias("low"), upper.alias("up"), "lower")
    # Where the middle two lie on both sides, they are the largest below and the smallest above.
    astride = left.join(small(halved.where("not low and not up")), "k").groupBy("k").agg(((F.max(F.when(F.col("v") <= F.col("middle"), F.col("v"))) + F.min(F.when(F.col("v") > F.col("middle"), F.col("v")))) / 2).alias("median"))
    part = halved.where("low or up").select("k", "n", "r1", "r2", F.when(F.col("low"), F.col("least")).otherwise(F.col("middle")).alias("lo"), F.when(F.col("low"), F.col("middle")).otherwise(F.col("most")).alias("hi"), "up")
    ranges = settled(found.withColumn("up", F.lit(False)).unionByName(part))
    inside = (F.col("v") <= F.col("hi")) & F.when(F.col("up"), F.col("v") > F.col("lo")).otherwise(F.col("v") >= F.col("lo"))
    rows = settled(left.join(small(ranges.select("k", "lo", "hi", "up")), "k").where(inside).select("k", "v"))
    return rows, ranges.select("k", "n", "r1", "r2"), known.union(astride)


def _rung(ladder: list[float], share: Column, up: bool) -> Column:
    """The place in the ladder of the highest rung at or below a share, or of the lowest at or above it."""
    fit = F.filter(F.sequence(F.lit(0), F.lit(len(ladder) - 1)), lambda i: (F.get(F.lit(ladder), i) >= share) if up else (F.get(F.lit(ladder), i) <= share))
    return F.array_min(fit) if up else F.array_max(fit)


def _settle(rows: DataFrame) -> DataFrame:
    """(k, median) of groups of few rows: values are counted, and the counts summed up in order."""
    counts = rows.groupBy("k", "r1", "r2", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda r: F.min(F.when(F.col("upto") >= F.col(r), F.col("v")))
    return upto.groupBy("k").agg(((at("r1") + at("r2")) / 2).alias("median"))
