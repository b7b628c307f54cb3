"""Readers and writers on self-made files: DICOM bytes, records, manifests, images, CSV, ledgers."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from keratoline import schemas
from keratoline.plans import ingest
from keratoline.sinks import tables
from keratoline.sources import dicom, engines, files, images, records
from keratoline.streaming import incremental


def element(tag, vr, value, implicit=False):
    head = struct.pack("<HH", tag >> 16, tag & 0xFFFF)
    value += (b"\0" if vr in (b"UI", b"OB") else b" ") * (len(value) % 2)
    if implicit:
        return head + struct.pack("<I", len(value)) + value
    return head + (vr + b"\0\0" + struct.pack("<I", len(value)) if vr in dicom.LONG else vr + struct.pack("<H", len(value))) + value


def item(body, open_end=False):
    if open_end:
        return b"\xfe\xff\x00\xe0\xff\xff\xff\xff" + body + b"\xfe\xff\x0d\xe0\0\0\0\0"
    return b"\xfe\xff\x00\xe0" + struct.pack("<I", len(body)) + body


def report_item(kind, code, value, children=b"", implicit=False):
    e = lambda *a: element(*a, implicit=implicit)
    body = e(dicom.VALUE_TYPE, b"CS", kind) + (e(dicom.CONCEPT, b"SQ", item(e(dicom.CODE, b"SH", code))) if code else b"")
    body += e(dicom.MEASURED, b"SQ", item(e(dicom.NUMERIC, b"DS", value))) if value else b""
    return body + (e(dicom.CONTENT, b"SQ", item(children)) if children else b"")


def make_dicom(implicit=False, blob=None, extra=b"", document=b"%PDF"):
    e = lambda *a: element(*a, implicit=implicit)
    meta = element(dicom.SYNTAX, b"UI", b"1.2.840.10008.1.2" if implicit else b"1.2.840.10008.1.2.1")
    inner = report_item(b"NUM", b"BAMD", b"1.5", implicit=implicit)
    tree = item(report_item(b"CONTAINER", b"", b"", inner, implicit)) + item(report_item(b"NUM", b"BAMD", b"1.75", implicit=implicit), True) + item(report_item(b"NUM", b"", b"3", implicit=implicit)) + item(report_item(b"NUM", b"RSAGMIN", b"7.5", implicit=implicit)) + item(report_item(b"NUM", b"ACD", b"x", implicit=implicit))
    body = e(0x00080020, b"DA", b"20240131") + e(0x00080030, b"TM", b"101112") + e(0x00100010, b"PN", b"Doe^Ann^M") + e(0x00100020, b"LO", b" P1 ") + e(0x00200060, b"CS", b"l ") + extra
    body += e(dicom.CONTENT, b"SQ", tree) + e(dicom.DOCUMENT, b"OB", document) + (e(dicom.RECORD, b"OB", blob) if blob else b"")
    return b"\0" * 128 + b"DICM" + meta + body


def make_record(eye=0, diameter=1180, fmt=6, first=3.5, second=9.0, base=0.5, name=b"E1\0junk"):
    data = bytearray(records.SIZE)
    struct.pack_into("<H", data, records.EYE_AT, eye)
    struct.pack_into("<H", data, records.DIAMETER_AT, diameter)
    struct.pack_into("<H", data, records.FORMAT_AT, fmt)
    data[records.FILE_AT : records.FILE_AT + len(name)] = name
    for i, v in ((0, first), (1, second), (4, base)):
        struct.pack_into("<d", data, records.ARRAY_AT + 8 * i, v)
    return bytes(data)


@pytest.mark.parametrize("implicit", [False, True])
def test_dicom(spark, implicit):
    df = spark.createDataFrame([("d/a.dcm", make_dicom(implicit, make_record() + b"tail")), ("d/b.dcm", b"no dicom at all"), ("d/c.dcm", make_dicom(implicit)[:-3])], "path string, content binary")
    decoded = dicom.read(df).cache()
    assert {r.file for r in dicom.rejects(decoded).collect()} == {"d/b.dcm", "d/c.dcm"}
    m = dicom.metadata(decoded).first()
    assert (m.patient_id, m.patient_name, m.exam_date, m.exam_time, m.eye, m.sex) == ("P1", "Doe^Ann^M", "20240131", "101112", "OS", None)
    assert {r.code: r.value for r in dicom.report_codes(decoded).collect()} == {"DICOM_BAMD": 1.75, "DICOM_RSAGMIN": 7.5}
    row = decoded.where("path = 'd/a.dcm'").first()
    assert bytes(row.pdf) == b"%PDF" and len(row.blob) == records.SIZE and [x.depth for x in row.sr] == [1, 2, 1, 1, 1, 1]
    base = ingest.base_rows(dicom.metadata(decoded))
    rows = ingest.raw_rows([ingest.report_rows(decoded, base), ingest.record_rows(decoded, base)]).orderBy("event").collect()
    assert [(r.printout_type, r.n_fields, r.Kmax, r.Belin_D_final, r.HWTW, r.AC_depth) for r in rows] == [("SR", 2, 45.0, 1.75, None, None), ("SPR", 2, None, None, 11.8, 3.0)]
    assert rows[0].FamilyName == "Doe" and rows[0].GivenName == "Ann" and rows[0].imagedir == rows[1].imagedir != ""
    assert "FamilyName" not in ingest.raw_rows([ingest.report_rows(decoded, ingest.base_rows(dicom.metadata(decoded), names=False))], names=False).columns


def test_records(spark):
    cases = [make_record(), make_record()[:-1], make_record() + b"x", make_record(eye=2), make_record(1, 898), make_record(1, 900), make_record(1, 1499), make_record(1, 1500), make_record(fmt=5), make_record(first=float("nan")), make_record(first=float("inf"))]
    got = [r.exact for r in records.decode(spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, blob binary")).orderBy("i").collect()]
    assert got[0].asDict() == {"eye": "OS", "cornea_dia_mm": 11.8, "acd_mm": 3.0, "exam_file": "E1", "blob_format": 6}
    assert got[1] is None and got[2] is None and got[3] is None
    assert [g.cornea_dia_mm for g in got[4:8]] == [None, 9.0, 14.99, None] and got[4].eye == "OD"
    assert got[8].acd_mm == 8.5 and got[9].acd_mm is None and got[10].acd_mm == float("inf")
    cut = spark.createDataFrame([(cases[2],), (cases[1],)], "b binary").select(F.octet_length(records.trimmed_record(F.col("b"))).alias("n"))
    assert [r.n for r in cut.collect()] == [records.SIZE, None]


def test_manifest_and_paths(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('laterality,filename,familyname,dob,printouttype\nOD," a.dcm ",Doe,1/2/1980,4 Maps Refractive\n,b.pdf,"O""Hara, X",,\nOS,,gone,,\nL,~/c.png,,1980-03-04,Fourier\n')
    rows, bad = files.manifest(spark, str(path))
    got = {r.filename: r for r in rows.collect()}
    assert set(got) == {"a.dcm", "b.pdf", "~/c.png"} and bad.count() == 1
    assert (got["a.dcm"].dob, got["a.dcm"].family_name, got["a.dcm"].examdate, got["b.pdf"].family_name) == ("19800102", "Doe", None, 'O"Hara, X')
    assert {r.filename for r in rows.where(files.wanted_type(F.col("printouttype"))).collect()} == {"a.dcm", "b.pdf"}
    listing = spark.createDataFrame([("a.dcm",), ("a.dcm_1",), ("/home/u/c.png_1",)], "path string")
    assert {(r.filename, r.path) for r in files.resolve_paths(rows, listing, home="/home/u").collect()} == {("a.dcm", "a.dcm"), ("~/c.png", "/home/u/c.png_1")}
    (tmp_path / "l.txt").write_text(" x/y.DCM \n\nz\n")
    assert {(r.path, r.ext, r.folder) for r in files.path_list(spark, str(tmp_path / "l.txt")).collect()} == {("x/y.DCM", "dcm", "x"), ("z", "", "")}
    done = spark.createDataFrame([("z",)], "path string")
    assert [r.path for r in files.open_input(spark, str(tmp_path / "l.txt"), done).collect()] == ["x/y.DCM"]
    kinds = spark.createDataFrame([("dcm", b""), ("", bytes.fromhex("89504E470D0A1A0A00")), ("jpeg", b""), ("", b"x")], "e string, c binary").select(files.file_kind(F.col("e"), F.col("c")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["dcm", "image", "image", None]


def test_folder_scan_and_restart(spark, tmp_path):
    root = tmp_path / "in" / "sub"
    root.mkdir(parents=True)
    (root / f"{files.VENDOR_ROOT}1.dcm").write_bytes(make_dicom())
    (root / "other.dcm").write_bytes(b"x")
    found = files.folder_files(spark, str(tmp_path / "in"))
    process = lambda new: ingest.raw_rows([ingest.report_rows(dicom.read(new), ingest.base_rows(dicom.metadata(dicom.read(new))))])
    table, done = str(tmp_path / "raw"), str(tmp_path / "done")
    assert [incremental.run_once(spark, found, process, table, done) for _ in range(2)] == [1, 0]
    assert incremental.rows_once(spark, table).count() == 1
    for n in (1, 1, 2):
        if n == 2:
            (root / f"{files.VENDOR_ROOT}2.dcm").write_bytes(make_dicom(True))
        incremental.ingest_stream(spark, str(tmp_path / "in"), process, str(tmp_path / "s"), str(tmp_path / "ckpt"), f"{files.VENDOR_ROOT}*.dcm").awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "s")).count() == n


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"\nline', 500.0, 0.12345, None), ("", "plain", 1e-7, 1.0, 2.5)], "k string, t string, v double, c float, w double")
    tables.write_csv(df, str(tmp_path / "o"), single=True)
    text = next((tmp_path / "o").glob("part-*")).read_text()
    assert text.splitlines()[0] == "k,t,v,c,w" and "500,0.1235," in text and "0.0000001,1.0000,2.5" in text
    back = {r.t: r for r in tables.read_csv(spark, str(tmp_path / "o")).collect()}
    assert set(back) == {'say "x"\nline', "plain"} and back['say "x"\nline'].k == "a,b" and back["plain"].k is None


def test_small_tables(spark):
    rows = spark.createDataFrame([("v", "f1", 0, "SR"), ("v", "f2", 3, "FourMapsRefractive"), ("", "f3", 1, "SPR")], "imagedir string, source_file string, page_number int, printout_type string")
    found = tables.visit_sources(rows)
    assert sorted(r.data_source for r in found.collect()) == ["DICOM_SR", "OCR"]
    assert tables.first_written(found, found).count() == 0 and tables.first_written(found, None).count() == 2
    rejects = spark.createDataFrame([("A", "f", "d"), ("B", "f", "d"), ("B", "g", "e")], schemas.REJECTS)
    assert [tuple(r) for r in tables.reject_counts(rejects).collect()] == [("B", 2), ("A", 1)]
    assert tables.reject_lines(rejects).first().value == "[A] f — d"
    kinds = spark.createDataFrame([('Other("Refractive (gen1)")',)], "t string").select(tables.short_type(F.col("t")).alias("s"))
    assert kinds.first().s == "refractive_gen1"


def test_image_identity_tiers(spark):
    pages = spark.createDataFrame([("p1", "a"), ("p2", "b"), ("p3", "c"), ("p4", "d")], "page_id string, path string")
    seen = spark.createDataFrame([(p, "Oc^Ular", "ocr", "19700101", "20200101", "101010", "OS") for p in ("p1", "p2", "p3")], "page_id string, patient_name string, patient_id string, date_of_birth string, exam_date string, exam_time string, eye string")
    manifest = spark.createDataFrame([("a", "m", None, None, "19800101", "OD", "20240101", "111111"), ("b", "m", "Fam", None, None, None, None, None)], "path string, id string, family_name string, given_name string, dob string, laterality string, examdate string, examtime string")
    got = {r.page_id: r for r in ingest.image_identity(pages, seen, manifest).collect()}
    assert (got["p1"].id, got["p1"].FamilyName, got["p1"].eye) == ("m", "", "OD")
    assert (got["p2"].id, got["p2"].FamilyName, got["p2"].GivenName, got["p2"].eye) == ("m", "Fam", "Ular", "OS")
    assert (got["p3"].id, got["p3"].FamilyName, got["p4"].imagedir, got["p4"].id) == ("ocr", "Oc", "", "")


class FakeReader:
    fail = 1

    def read(self, image):
        if FakeReader.fail:
            FakeReader.fail -= 1
            raise RuntimeError("broken session")
        return [(" 43.1 ", 0.9, [(0, 0), (10, 0), (10, 4), (0, 4)])]


def test_images_and_engine(spark):
    rng = np.random.default_rng(0)
    im = rng.integers(0, 256, (20, 28, 3)).astype(np.uint8)
    assert (images.resample(im, 20, 28) == im).all()
    flat = np.full((100, 2799, 3), 200, np.uint8)
    big, height = images.upscaled(flat)
    assert big.shape[1] == 3500 and height == 125 and (big == 200).all()
    assert images.upscaled(np.zeros((4, 2800, 3), np.uint8))[1] is None
    ring = np.full((30, 30, 3), 255, np.uint8)
    ring[10, 10:14] = ring[13, 10:14] = 0
    assert (images.clean_crop(ring) < 80).mean() >= (images.resample(ring, 90, 90) < 80).mean()
    assert images.region(im, 5, 5, 6, 2) is None and images.region(im, 10, 10, 6, 2).shape == (4, 12, 3)
    paper = np.full((3, 9, 3), 255, np.uint8)
    paper[1, 4:6] = 0
    assert images.ink_span(paper, 1, 0, 9) == (4, 5) and images.ink_span(paper, 0, 0, 9) is None
    rows = engines.items_of(FakeReader().read(im) if not FakeReader.fail else [(" a ", 0.5, [(0, 0), (2, 4)])], "p", None)
    assert rows[0][2] in ("a", "43.1") and rows[0][4:6] == (1.0, 2.0)


def test_records_are_laid_out_once_a_user(spark, data):
    """Nothing of a record is computed below the exchange that makes users distinct, and Python gets the row of the depth alone."""
    from keratoline import catalog_pages

    plan = catalog_pages.record_fields(spark, data)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange", 1)
    assert "octet_length" not in below and "conv(" not in below and "octet_length" in above
    assert "substring(blob#" in above.split("ArrowEvalPython", 1)[1].split("]", 1)[0]
