"""From raw extraction rows to one row per visit: resolved values, in a compact and a detailed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keratoline import dims, schemas
from keratoline.functions.dates import calendar_epoch, right_eye, test_time
from keratoline.materialize import settled
from keratoline.operators.resolve import best_values, first_attributes, pivot_fields, to_long


def measurements(raw: DataFrame, ord_: str = "ord") -> DataFrame:
    """The wide raw rows of visits that have a key, in long form."""
    keyed = raw.where(F.coalesce(F.col("imagedir"), F.lit("")) != "")
    return to_long(keyed.select(F.col(ord_).alias("ord"), F.col("imagedir").alias("visit_id"), F.col("printout_type").alias("source_type"), *[c for c in raw.columns if c in dims.FIELDS or c.endswith(schemas.CONF_SUFFIX)]), ["ord", "visit_id", "source_type"], dims.FIELDS, schemas.CONF_SUFFIX)


def unkeyed(raw: DataFrame) -> int:
    """How many raw rows no summary can take, for lack of a visit key."""
    return raw.where(F.coalesce(F.col("imagedir"), F.lit("")) == "").count()


def visits(raw: DataFrame, ord_: str = "ord") -> DataFrame:
    """Attributes of each visit's first raw row, with derived times."""
    keyed = raw.where(F.coalesce(F.col("imagedir"), F.lit("")) != "").withColumn("visit_id", F.col("imagedir"))
    columns = [c for c in (*schemas.IDENTITY, "device_serial", "software_version") if c in raw.columns]
    first = first_attributes(keyed, ["visit_id"], columns, ord_, "printout_type")
    date, clock = F.coalesce("exam_date", F.lit("")), F.coalesce("exam_time", F.lit(""))
    return first.withColumns({"righteye": right_eye(F.col("eye")), "timeoftest": test_time(date, clock), "timeoftestEpoch": calendar_epoch(date, clock)})


def summaries(raw: DataFrame, names: bool = True, ord_: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(compact, detailed), a row per visit with at least one value. Their order is left to what writes them."""
    best = settled(best_values(measurements(raw, ord_)))
    about = settled(visits(raw, ord_))
    who = [c for c in ("id", *(schemas.NAMES if names else ()), "birthdate") if c in about.columns]
    times = ["righteye", "timeoftest", "timeoftestEpoch"]
    compact = about.join(pivot_fields(best, ["visit_id"], dims.FIELDS, {"value": ""}), "visit_id")
    parts = {"value": "", "source": "_source", "confidence": "_conf", "reliability": "_reliability", "flag": "_flag"}
    detailed = about.join(pivot_fields(best, ["visit_id"], dims.FIELDS, parts), "visit_id")
    imagedir = F.col("visit_id").alias("imagedir")
    more = ["exam_date", "exam_time", "device_serial", "software_version", "n_source_rows", "source_types"]
    return (
        compact.select(*who, *times, imagedir, *dims.FIELDS),
        detailed.select(*who, *times, imagedir, *more, *[f"{f}{s}" for f in dims.FIELDS for s in parts.values()]),
    )
