"""One best value per visit and field, by source priority, confidence and cross-checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keratoline import dims

REPORT, RECORD = "SR", "SPR"


def best_values(
    measurements: DataFrame, group: Sequence[str] = ("visit_id",), field: str = "field", source: str = "source_type", value: str = "value", conf: str = "conf", ord_: str = "ord",
    record_first: Column | None = None, threshold: Column | None = None, reliability: Column | None = None,
) -> DataFrame:
    """Per group and field: value, source, confidence, reliability and flag, in one shuffle.

    The first report row goes before the first record row, and that before the
    page reading of the highest confidence (the last of equals; a NaN counts
    as none); where record_first holds, the record goes first. The flag is
    SR_OCR_MISMATCH if report and page differ by more than the threshold,
    whichever was chosen; else REVIEW below the reliability limit; else
    LOW_CONF for a confidence above 0 and below its limit; else empty.
    """
    f = F.col(field)
    record_first = (f == "HWTW") if record_first is None else record_first
    threshold = dims.threshold_of(f) if threshold is None else threshold
    reliability = dims.reliability_of(f) if reliability is None else reliability
    row = F.struct(F.col(value).alias("value"), F.col(source).alias("source"), F.col(conf).alias("conf"))
    sure = F.when(~F.isnan(F.col(conf).cast("double")), F.col(conf))
    from_page = ~F.col(source).isin(REPORT, RECORD)
    # Dealt by group alone, rows need not move again for the field, nor for a pivot of the result.
    found = measurements.where(F.col(value).isNotNull()).repartition(*group).groupBy(*group, field).agg(
        F.min_by(row, F.when(F.col(source) == REPORT, F.col(ord_))).alias("sr"),
        F.min_by(row, F.when(F.col(source) == RECORD, F.col(ord_))).alias("spr"),
        F.max_by(row, F.when(from_page, F.struct(sure, F.col(ord_)))).alias("ocr"),
    )
    best = F.when(record_first, F.coalesce("spr", "sr", "ocr")).otherwise(F.coalesce("sr", "spr", "ocr"))
    out = found.select(*group, field, best.alias("best"), "sr", "ocr", reliability.alias("reliability"), threshold.alias("threshold"))
    mismatch = F.abs(F.col("sr.value") - F.col("ocr.value")) > F.col("threshold")
    low = (F.col("best.conf") > 0) & (F.col("best.conf") < F.lit(dims.LOW_CONF_BELOW).cast("float"))
    flag = F.when(mismatch, F.lit("SR_OCR_MISMATCH")).when(F.col("reliability") < F.lit(dims.REVIEW_BELOW).cast("float"), F.lit("REVIEW")).when(low, F.lit("LOW_CONF")).otherwise(F.lit(""))
    return out.select(*group, field, F.col("best.value").alias("value"), F.col("best.source").alias("source"), F.col("best.conf").alias("confidence"), "reliability", flag.alias("flag"))


def first_attributes(rows: DataFrame, group: Sequence[str], columns: Sequence[str], ord_: str, source: str | None = None) -> DataFrame:
    """The first row's attributes of each group, with its number of rows and its distinct source types, sorted."""
    aggs = [F.min_by(F.struct(*columns), F.col(ord_)).alias("first"), F.count("*").alias("n_source_rows")]
    if source:
        aggs.append(F.array_join(F.array_sort(F.collect_set(source)), "|").alias("source_types"))
    out = rows.groupBy(*group).agg(*aggs)
    return out.select(*group, "first.*", *out.columns[len(group) + 1 :])


def pivot_fields(best: DataFrame, group: Sequence[str], names: Sequence[str], parts: dict[str, str], field: str = "field") -> DataFrame:
    """One row per group with each field's parts in columns of their own; `parts` maps a column to its suffix.

    A group's fields meet in one typed map, whatever their number, and are cut
    into columns after that: one shuffle, one aggregate, no job to find the
    names. A group has a field once at most. Groups without any of the fields
    give a row of nulls.
    """
    entry = f"struct(`{field}`, struct({', '.join(f'`{c}`' for c in parts)}))"
    held = f"map_from_entries(collect_list({entry}) FILTER (WHERE `{field}` IN ({', '.join(map(_quoted, names))})))"
    cut = [f"__of[{_quoted(name)}].`{column}` AS `{name}{suffix}`" for name in names for column, suffix in parts.items()]
    return best.groupBy(*group).agg(F.expr(held).alias("__of")).selectExpr(*[f"`{g}`" for g in group], *cut)


def _quoted(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def to_long(wide: DataFrame, keys: Sequence[str], names: Sequence[str], conf_suffix: str = "_Paddle_conf") -> DataFrame:
    """Key columns, field, value, conf: a row per field that is a finite number, or a text that parses as one. A confidence that is none is 0."""
    from keratoline.functions.numbers import number

    there, kinds = set(wide.columns), {f.name: f.dataType for f in wide.schema.fields}

    def read(name: str) -> Column:
        c = F.col(f"`{name}`")
        if not isinstance(kinds[name], T.NumericType):
            return number(c.cast("string"))
        d = c.cast("double")
        return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)

    sure = lambda n: F.coalesce(read(f"{n}{conf_suffix}"), F.lit(0.0)) if f"{n}{conf_suffix}" in there else F.lit(0.0)
    pairs = [F.struct(F.lit(n).alias("field"), read(n).alias("value"), sure(n).cast("float").alias("conf")) for n in names if n in there]
    return wide.select(*keys, F.explode(F.array(*pairs)).alias("m")).where("m.value is not null").select(*keys, "m.*")


def map_codes(codes: DataFrame, group: Sequence[str], code: str = "code", value: str = "value") -> DataFrame:
    """Report codes as fields: of each group and field, the code that stands first in the map; a radius becomes a power."""
    from keratoline.operators.joins import lookup

    table = dims.sr_map(codes.sparkSession).withColumnRenamed("code", "__code")
    rows = lookup(codes, table, code, "__code", [*group, "field"], "map_ord")
    power = F.when((F.col(code) == dims.RADIUS_CODE) & (F.col(value) > 0), F.lit(dims.RADIUS_TO_POWER) / F.col(value)).otherwise(F.col(value))
    return rows.select(*group, "field", power.alias("value"), F.lit(1.0).cast("float").alias("conf"))


def accuracy(pairs: DataFrame, field: str, read: str, truth: str, whole: Sequence[str] = ()) -> DataFrame:
    """Right and all readings of each field and in total (field null): within 0.5 for whole-number fields, else 0.05."""
    near = F.abs(F.col(read) - F.col(truth)) <= F.when(F.col(field).isin(list(whole)), 0.5).otherwise(0.05) if whole else F.abs(F.col(read) - F.col(truth)) <= 0.05
    out = pairs.withColumn("__right", F.coalesce(near, F.lit(False)).cast("bigint"))
    return out.rollup(field).agg(F.sum("__right").alias("correct"), F.count("*").alias("total"))


# Columns of a truth table that are no measurements.
TRUTH_META = ("dcm_path", "filename", "page", "printout_type", "dataset", "confirmed_gt")


def truth(wide: DataFrame) -> DataFrame:
    """file_key, field, value of a wide truth table: a row per cell that is a number. Of a file that stands twice the rows add up."""
    fields = [c for c in wide.columns if c not in TRUTH_META and not c.endswith(("_conf", "_src"))]
    key = F.replace(F.regexp_replace("filename", r"(\.dcm)+\z", ""), F.lit("."), F.lit("_"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.trim(F.col(f"`{c}`").cast("string")).try_cast("double").alias("value")) for c in fields]))
    return wide.select(key.alias("file_key"), cells.alias("c")).select("file_key", "c.*").where("value is not null")


def crop_name(name: Column) -> tuple[Column, Column]:
    """(file key, field) of a crop's file name, <file>_dcm_p<page>_<field>; nulls if it is none."""
    file, rest = F.substring_index(name, "_dcm_p", 1), F.substr(name, F.instr(name, F.lit("_dcm_p")) + 6)
    fits = F.contains(name, F.lit("_dcm_p")) & F.contains(rest, F.lit("_"))
    return F.when(fits, file), F.when(fits, F.substr(rest, F.instr(rest, F.lit("_")) + 1))


def chosen_reading(plain: Column, point: Column, cleaned: Column) -> Column:
    """Of a crop's readings, as it is and cleaned: the plain one if it surely has a decimal point or alone has a fraction, else the cleaned one."""
    fraction = lambda c: F.abs(c - F.round(c)) > 0.001
    keep = plain.isNotNull() & (F.coalesce(point, F.lit(False)) | cleaned.isNull() | (fraction(plain) & ~fraction(cleaned)))
    return F.when(keep, plain).otherwise(cleaned)
