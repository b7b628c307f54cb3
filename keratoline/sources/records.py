"""The private fixed-layout record: little-endian numbers at known offsets."""

from __future__ import annotations

import pandas as pd
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size, offsets and limits of the record.
SIZE = 38_400
FILE_AT, FILE_SIZE, EYE_AT, DIAMETER_AT, FORMAT_AT = 0x420, 12, 0x500, 0x5BA, 0x690
ARRAY_AT, ROW, SHIFTED_FORMAT = 0x80C, 48, 6


def trimmed_record(content: Column) -> Column:
    """The record's bytes; longer ones are cut, shorter ones are none."""
    return F.when(F.octet_length(content) >= SIZE, F.substring(content, 1, SIZE))


def u16(content: Column, at: int) -> Column:
    """An unsigned 16-bit number, low byte first, without Python."""
    return F.conv(F.concat(F.hex(F.substring(content, at + 2, 1)), F.hex(F.substring(content, at + 1, 1))), 16, 10).cast("int")


def _depth(row: pd.Series, shifted: pd.Series) -> pd.Series:
    def one(data: bytes, shift: bool) -> float | None:
        numbers = np.frombuffer(data, "<f8", count=ROW // 8)
        value = float(numbers[0 if shift else 1] - numbers[4])
        return None if np.isnan(value) else value

    return pd.Series([None if d is None else one(d, bool(s)) for d, s in zip(row, shifted, strict=True)], dtype="object")


def decode(rows: DataFrame, content: str = "blob") -> DataFrame:
    """Adds `exact`: eye, cornea_dia_mm, acd_mm, exam_file, blob_format; null if the size or the eye code is wrong.

    The corneal diameter counts from 9 up to but not including 15 mm, a depth
    unless it is NaN. Integers and text are read by the engine; only the
    double-precision depth needs Python, in Arrow batches.
    """
    data = F.col(content)
    eye = F.when(u16(data, EYE_AT) == 1, "OD").when(u16(data, EYE_AT) == 0, "OS")
    diameter = u16(data, DIAMETER_AT) / 100
    name = F.decode(F.substring(data, FILE_AT + 1, FILE_SIZE), "ISO-8859-1")
    row = F.when(F.octet_length(data) == SIZE, F.substring(data, ARRAY_AT + 1, ROW))  # a batch to Python holds rows of 48 bytes, not records
    depth = F.pandas_udf(_depth, "double")(row, u16(data, FORMAT_AT) == SHIFTED_FORMAT)
    exact = F.struct(
        eye.alias("eye"), F.when((diameter >= 9) & (diameter < 15), diameter).alias("cornea_dia_mm"), depth.alias("acd_mm"),
        F.substring_index(name, "\0", 1).alias("exam_file"), u16(data, FORMAT_AT).alias("blob_format"),
    )
    return rows.withColumn("exact", F.when((F.octet_length(data) == SIZE) & eye.isNotNull(), exact))


def record_values(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, field, value, conf of decoded records: HWTW and AC_depth where they are there."""
    pairs = F.array(F.struct(F.lit("HWTW").alias("field"), F.col("exact.cornea_dia_mm").alias("value")), F.struct(F.lit("AC_depth").alias("field"), F.col("exact.acd_mm").alias("value")))
    out = rows.where("exact is not null").select(*keys, F.explode(pairs).alias("m"))
    return out.where("m.value is not null").select(*keys, "m.field", "m.value", F.lit(1.0).cast("float").alias("conf"))
