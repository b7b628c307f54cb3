"""Writers: long Parquet as the record, CSV as export, rejects and source lists beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV = {"header": True, "escape": '"', "emptyValue": "", "nullValue": "", "quoteAll": False}


def plain_number(c: Column, places: int | None = None) -> Column:
    """A double as text without exponent or trailing zeros, or with fixed places; null stays null."""
    if places is not None:
        return F.when(c.isNotNull(), F.format_string(f"%.{places}f", c))
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    text = c.cast("string")
    exact = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")
    return F.when(whole, F.format_string("%.0f", c)).when(F.contains(text, F.lit("E")), exact).otherwise(text)


def as_text(df: DataFrame) -> DataFrame:
    """Doubles in plain notation, confidences (floats) with four and reliabilities with three places, nulls empty."""
    def shown(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.FloatType):
            c = plain_number(c, 3 if f.name.endswith("_reliability") else 4)
        elif isinstance(f.dataType, T.DoubleType):
            c = plain_number(c)
        return F.coalesce(c.cast("string"), F.lit("")).alias(f.name)

    return df.select(*[shown(f) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, single: bool = False, mode: str = "overwrite") -> None:
    out = as_text(df)
    (out.coalesce(1) if single else out).write.mode(mode).options(**CSV).csv(path)


def read_csv(spark, path: str) -> DataFrame:
    """Reads a CSV of ours: all strings, quoted line feeds and quotes kept."""
    return spark.read.options(header=True, multiLine=True, escape='"').csv(path)


def append_raw(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def visit_sources(rows: DataFrame) -> DataFrame:
    """filename, page, printout_type and data_source of each raw row, by visit."""
    kind = F.when(F.col("printout_type") == "SR", "DICOM_SR").when(F.col("printout_type") == "SPR", "SPR_blob").otherwise("OCR")
    return rows.where(F.coalesce("imagedir", F.lit("")) != "").select(F.col("imagedir").alias("visit_id"), F.col("source_file").alias("filename"), F.col("page_number").alias("page"), "printout_type", kind.alias("data_source"))


def first_written(new: DataFrame, old: DataFrame | None, key: str = "visit_id") -> DataFrame:
    """Rows of keys that are not written yet: the first run wins."""
    return new if old is None else new.join(old.select(key).distinct(), key, "left_anti")


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def reject_lines(rejects: DataFrame) -> DataFrame:
    return rejects.select(F.concat(F.lit("["), "category", F.lit("] "), "file", F.lit(" — "), "detail").alias("value"))


def short_type(kind: Column) -> Column:
    """The page type in file names: fixed replacements, in order, then lower case."""
    out = kind
    for old, new in (('Other("', ""), ('")', ""), (" ", "_"), ("(", ""), (")", "")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.lower(out)


def flat_codes(codes: DataFrame, group: str = "path") -> DataFrame:
    """All report codes of a file in one text, `code=value;code=value` by code."""
    pair = F.concat("code", F.lit("="), plain_number(F.col("value")))
    return codes.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", pair.alias("p")))), lambda x: x["p"]), ";").alias("codes"))
