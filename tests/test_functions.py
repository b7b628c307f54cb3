"""Table-driven tests of the column functions, one case per rule branch."""

import hashlib

import pytest
from pyspark.sql import functions as F

from keratoline import dims
from keratoline.functions import dates, keys, numbers


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def test_dates(spark):
    cases = {" 2024-02-30\t": "20240230", "1/2/2024": "20240102", "1/2/24": "1/2/24", "20240102": "20240102", "soon": "soon", "": "", None: None, "2024-1-2": "2024-1-2"}
    assert apply(spark, dates.manifest_date, list(cases)) == list(cases.values())
    cases = {"01.02.2024": "20240102", "2024.03.04": "20240304", "1/2/2024": "20240102", "2024-05-06": "20240506", "20240506": "20240506", "1.2.24": "1.2.24", None: None}
    assert apply(spark, dates.header_date, list(cases)) == list(cases.values())
    assert apply(spark, dates.manifest_time, ["123456", "12:34:56", " 9.30 ", None]) == ["123456", "123456", "930", None]


def test_epochs(spark):
    df = spark.createDataFrame([("20240131", "010203"), ("20240201", "010203"), ("2024", "01"), ("20240230", ""), ("2024xx01", "0a"), (None, None)], "d string, t string")
    rows = df.select(dates.approximate_epoch(F.col("d"), F.col("t")).alias("a"), dates.calendar_epoch(F.col("d"), F.col("t")).alias("c"), dates.test_time(F.col("d"), F.col("t")).alias("s")).collect()
    day = lambda y, m, d: ((y - 1970) * 365 + (m - 1) * 30 + d) * 86400
    assert [r.a for r in rows] == [day(2024, 1, 31) + 3723, day(2024, 2, 1) + 3723, 0, day(2024, 2, 30), day(2024, 1, 1), 0]
    assert rows[0].a == rows[1].a and rows[0].c == 1706662923 and rows[3].c is None and rows[2].c is None
    assert [r.s for r in rows[:4]] == ["240131010203", "240201010203", "", "240230000000"]


def test_sides(spark):
    assert apply(spark, dates.laterality, ["R", " l ", "OD", "os", "X", "", None]) == ["OD", "OS", "OD", "OS", None, None, None]
    assert apply(spark, dates.eye_phrase, ["Right Eye", "left", "OD", "r", "L", "both"]) == ["OD", "OS", "OD", "OD", "OS", None]


@pytest.mark.parametrize(("text", "value"), [
    ("38 .1", 38.1), ("1,23", 1.23), ("o.5", 0.5), ("Z.5", 7.5), ("AZ5", 5.0), ("~3.2", -3.2), ("~-3", -3.0), ("4..5", 4.5), ("540 µm", 540.0), ("540pm", 540.0),
    ("61.2 mm³", 61.2), ("43.1 D", 43.1), (".7", 0.7), ("(09", 0.9), ("[07", 0.7), ("7 of 8.5", 8.5), ("x 12 y", 12.0), ("-0.3", -0.3), ("nil", None), ("none", 0.0), ("", None), (None, None), ("12.", 12.0),
])
def test_extract_numeric(spark, text, value):
    assert apply(spark, numbers.extract_numeric, [text]) == [value]


def test_signed_number_and_quality(spark):
    assert apply(spark, numbers.signed_number, ["−1,5 D", "+3 µm", "12.4 mm", "90°", "D: 2", "nil"]) == [-1.5, 3.0, 12.4, 90.0, 2.0, None]
    assert apply(spark, numbers.quality_code, [" ok", "Suspect", "A", "abnormal", "B", None]) == [0.0, 1.0, 1.0, 2.0, None, None]


@pytest.mark.parametrize(("field", "value", "raw", "wanted"), [
    ("Kmax_x", 1.0, "1+0.52", -0.52), ("Kmax_x", 10.25, "10.25", -0.25), ("Kmax_x", 25.3, "(25.3)", -2.53), ("Thinnest_y", 45.0, "+45", 4.5), ("Thinnest_y", 45.0, "45 x", -4.5),
    ("PupilCenter_x", 2.9, "29", 2.9), ("Kmax_y", 99.0, "99", 99.0), ("Kmax_y", 123.4, "+123.4", 1.234),
    ("K1_back", 16.1, "16.1 D", -6.1), ("K2_back", 62.0, "62", -6.2), ("Km_back", 162.0, "162D", -6.2), ("K1_back", 6.1, "6.1", -6.1), ("K1_back", -6.1, "-6.1", -6.1),
    ("K1_front", 143.2, "143.2D", 43.2), ("Kmax", 4321.0, "4321", 43.21), ("Km_front", 999.0, "999", 99.9), ("Km_front", 999.0, "x", 999.0),
    ("Astig_front", 10.7, "10.7", 0.7), ("Astig_front", 12.3, "12.3D", 2.3), ("Astig_back", 13.0, "13", 1.3), ("Astig_front", 105.0, "105", 0.5), ("Astig_back", -0.4, "1-0.4", 0.4), ("Astig_back", -0.4, "-0.4", -0.4),
    ("Qval_front", 10.32, "10.32", -0.32), ("Qval_back", 16.0, "16", -6.0), ("Qval_back", 0.3, "0.3", 0.3),
    ("Rm_front", 17.8, "17.8mm", 7.8), ("Rm_front", 12.0, "17.8", 12.0), ("Rf_back", 13.2, "13.2", 13.2), ("PupilDia", 13.4, "13.4mm", 3.4), ("AC_depth", 12.9, "12.9 mm", 2.9),
    ("PachyVertex", 1540.0, "1540", 540.0), ("PachyVertex", 1900.0, "1900", 1900.0), ("HWTW", 112.0, "112", 112.0),
])
def test_repairs(spark, field, value, raw, wanted):
    df = spark.createDataFrame([(field, value, raw)], "field string, value double, raw_text string")
    assert numbers.repair(df).first().value == pytest.approx(wanted)


def test_keys(spark):
    df = spark.createDataFrame([("p", "OS", 5), (None, None, 5)], "p string, e string, t long")
    got = [r.k for r in df.select(keys.visit_id(F.col("p"), F.col("e"), F.col("t")).alias("k")).collect()]
    assert got == [hashlib.sha256(x.encode()).hexdigest()[:16] for x in ("p|OS|5", "|OD|5")]
    salted = df.select(keys.visit_id(F.col("p"), F.col("e"), F.col("t"), "salt").alias("k")).first().k
    assert salted == hashlib.sha256(b"saltp|OS|5").hexdigest()[:16]
    assert df.select(keys.visit_id_blake3(F.col("p"), F.col("e"), F.col("t")).alias("k")).first().k == keys.blake3_hex(b"p|OS|5")[:16]
    # public test vectors of the hash: inputs of 0, 1, 1023, 1024, 1025 and 2049 bytes counting up modulo 251
    data = bytes(i % 251 for i in range(2049))
    for n, head in ((0, "af1349b9f5f9a1a6"), (1, "2d3adedff11b61f1"), (1024, "42214739f095a406"), (1025, "d00278ae47eb27b3"), (2049, "5f4d72f40d7a5f82")):
        assert keys.blake3_hex(data[:n])[:16] == head


def test_tables():
    assert len(dims.FIELDS) == len(set(dims.FIELDS)) == 66 and len(dims.SR_MAP) == 21 and len(dims.LABELS) == 40
    known = {*dims.FIELDS}
    assert set(dims.THRESHOLDS) <= known and set(dims.RELIABILITY) == known
    assert {f for f, _, _ in dims.RANGES + dims.SUSPICIOUS} <= known and set(dims.SIGN_FIELDS) <= known
