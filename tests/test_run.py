"""The whole ingestion over folders, path lists and manifests, with engines that are fakes, and its restart."""

import glob
import io
import os
import struct
import textwrap
import zlib

import numpy as np
import pytest
from test_pages import layout, make
from test_sources import make_dicom, make_record

from keratoline import __main__ as command
from keratoline.plans import flat, pages, run
from keratoline.sinks import tables
from keratoline.sinks.images import put_file
from keratoline.sources import decode, dicom, engines, files, images
from keratoline.streaming import incremental


def fakes():
    """(renderer, reader), made here so that workers get them by value."""
    regions = [(text, confidence, [(cx, cy)]) for _, _, text, confidence, cx, cy, *_ in make("p")[0]]

    class Renderer:
        def page_count(self, pdf):
            return 2

        def render(self, pdf, page, dpi):
            if page == 2:
                raise RuntimeError("torn page")
            return np.zeros((40, 2800, 3), np.uint8)

    class Reader:
        def read(self, image):
            return regions

    return Renderer, Reader


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / f"{files.VENDOR_ROOT}2.dcm").write_bytes(make_dicom())
    (root / f"{files.VENDOR_ROOT}1.dcm").write_bytes(make_dicom(True))
    (root / f"{files.VENDOR_ROOT}3.dcm").write_bytes(b"no dicom")
    return root


def test_folder_is_taken_once(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    counts = command.main([str(folder), out, "--csv", "--no-names"], spark)
    assert counts["files"] == 3 and counts["rejected"] == 1 and counts["visits"] == 1
    assert "FamilyName" not in spark.read.parquet(f"{out}/compact").columns and spark.read.parquet(f"{out}/compact").count() == 1
    again = command.main([str(folder), out, "--csv", "--no-names"], spark)
    assert again["files"] == 0 and (again["rows"], again["visits"]) == (counts["rows"], 1)
    assert spark.read.parquet(f"{out}/done").count() == 3 and spark.read.parquet(f"{out}/sources").count() == counts["rows"]


def test_order_of_a_path_list_decides(spark, folder, tmp_path):
    """The first row of a visit is that of the file listed first, in either order of two files of one visit."""
    both = [str(folder / f"{files.VENDOR_ROOT}1.dcm"), str(folder / "sub" / f"{files.VENDOR_ROOT}2.dcm")]
    for i, order in enumerate((both, both[::-1])):
        (tmp_path / f"l{i}.txt").write_text("\n".join(order) + "\n")
        out = str(tmp_path / f"out{i}")
        run.run(spark, str(tmp_path / f"l{i}.txt"), out)
        rows = spark.read.parquet(f"{out}/raw").orderBy("ord").collect()
        assert list(dict.fromkeys(r.path for r in rows)) == order and [r.event for r in rows] == sorted(r.event for r in rows if r.path == order[0]) * 2


def test_manifest_closes_what_it_skips(spark, folder, tmp_path):
    name = str(folder / f"{files.VENDOR_ROOT}1.dcm")
    (tmp_path / "m.csv").write_text(f"filename,printouttype\n{name},4 Maps Refractive\ngone.dcm,\nother.dcm,Fourier\n,Fourier\n")
    listing = files.folder_files(spark, str(folder), content=False).selectExpr("regexp_replace(path, '^file:/+', '/') AS path")
    out = str(tmp_path / "out")
    counts = run.run(spark, str(tmp_path / "m.csv"), out, listing)
    assert (counts["files"], counts["closed"], counts["rejected"]) == (1, 2, 2)
    assert {r.category for r in spark.read.parquet(f"{out}/rejects").collect()} == {"MANIFEST_ROW", "MISSING_FILE"}
    assert {r.path for r in spark.read.parquet(f"{out}/done").collect()} == {name, "gone.dcm", "other.dcm"}
    again = run.run(spark, str(tmp_path / "m.csv"), out, listing)
    assert (again["files"], again["closed"]) == (0, 0)


def test_pages_are_rendered_and_read(spark, folder, tmp_path):
    out, (renderer, reader) = str(tmp_path / "out"), fakes()
    counts = run.run(spark, str(folder / "sub"), out, renderer=renderer, reader=reader, layouts=pages.layout_frame(spark, layout()))
    kinds = {r.printout_type: r for r in spark.read.parquet(f"{out}/raw").collect()}
    assert "FourMapsRefractive" in kinds and kinds["FourMapsRefractive"].Rf_front == 7.8 and kinds["FourMapsRefractive"].page_number == 1
    assert [(r.category, r.detail) for r in spark.read.parquet(f"{out}/rejects").collect()] == [("RENDER_ERROR", "torn page")] and counts["rejected"] == 1


def page_bytes(tag, width=2800, height=40):
    """An image file whose first pixel tells the fake reader what stands on it."""
    pixels = np.full((height, width, 3), 255, np.uint8)
    pixels[0, 0] = tag
    return images.png(pixels)


def tagged_fakes(texts, crops=None):
    """Engines whose pages are told apart by their first pixel; crops are what the second look at a page's regions shows."""
    shown = {tag: [(text, confidence, [(cx, cy)]) for _, _, text, confidence, cx, cy, *_ in items] for tag, items in texts.items()}

    class Renderer:
        def page_count(self, pdf):
            return len(pdf) - 4

        def render(self, pdf, page, dpi):
            pixels = np.full((2700, 2800, 3), 255, np.uint8)
            pixels[0, 0] = pdf[3 + page]
            pixels[:, -1] = pdf[3 + page]  # so regions are not all alike
            return pixels

    class Reader:
        def read(self, image):
            if image.shape[1] >= 2800:
                return shown[int(image[0, 0, 0])]
            return crops or []

    return Renderer, Reader


def test_files_go_their_way_by_kind(spark, folder, tmp_path):
    """A path list of a DICOM file, a document, images and others: rows of each, and rejects that say why."""
    header = [("h", 900 + i, t, 0.9, x, y, 0, 0, 0, 0, None) for i, (t, x, y) in enumerate([("Last Name:", 100, 30), ("Roe", 200, 30), ("ID:", 100, 80), ("P9", 200, 80), ("Eye:", 100, 110), ("Left", 200, 110), ("Exam Date:", 100, 140), ("02/01/2024", 260, 140)])]
    renderer, reader = tagged_fakes({7: make("p")[0], 8: make("p")[0] + header, 9: [("x", 0, "nothing known", 0.9, 10.0, 10.0, 0, 0, 0, 0, None)]})
    at = {n: str(tmp_path / n) for n in ("a.pdf", "b.png", "c.JPG_1", "d.txt.gz", "e.jpg", "f.pdf", "gone.png", "g.bmp")}
    for n, data in (("a.pdf", b"%PDF\x07\x09"), ("b.png", page_bytes(8)), ("c.JPG_1", page_bytes(7)), ("d.txt.gz", b"text"), ("e.jpg", b"\xff\xd8\xffbroken"), ("f.pdf", b"%PDF")):
        (tmp_path / n).write_bytes(data)
    flat = np.full((3, 2801, 3), 9, np.uint8)
    rows = np.zeros((3, (2801 * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : 2801 * 3] = flat.reshape(3, -1)
    (tmp_path / "g.bmp").write_bytes(b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2801, 3, 1, 24, 0, 0, 0, 0, 0, 0) + rows.tobytes())
    dcm = str(folder / f"{files.VENDOR_ROOT}1.dcm")
    (tmp_path / "l.txt").write_text("\n".join([dcm, *at.values()]) + "\n")
    out, places = str(tmp_path / "out"), pages.layout_frame(spark, layout())
    counts = run.run(spark, str(tmp_path / "l.txt"), out, renderer=renderer, reader=reader, layouts=places, save_maps=False)
    rows = {(r.source_file, r.page_number): r for r in spark.read.parquet(f"{out}/raw").collect()}
    assert set(rows) == {(f"{files.VENDOR_ROOT}1.dcm", 0), ("a.pdf", 1), ("b.png", 1), ("c.JPG_1", 1)}
    assert rows["a.pdf", 1].Rf_front == rows["c.JPG_1", 1].Rf_front == 7.8 and rows["a.pdf", 1].imagedir == rows["a.pdf", 1].id == ""
    seen = rows["b.png", 1]
    assert (seen.id, seen.FamilyName, seen.eye) == ("P9", "Roe", "OS") and seen.imagedir and counts["unkeyed"] == 2
    why = {(r.category, r.file.rsplit("/", 1)[-1]) for r in spark.read.parquet(f"{out}/rejects").collect()}
    assert why == {("UNKNOWN_PAGE", "a.pdf#2"), ("UNKNOWN_PAGE", "g.bmp#1"), ("UNSUPPORTED_FILE", "d.txt.gz"), ("IMAGE_ERROR", "e.jpg#1"), ("MISSING_FILE", "gone.png")}
    done = {r.path for r in spark.read.parquet(f"{out}/done").collect()}
    assert done == {dcm, *at.values()} - {at["gone.png"]} and counts["files"] == len(done)

    # Without engines documents and images are not read, and so not done.
    bare = str(tmp_path / "bare")
    counts = run.run(spark, str(tmp_path / "l.txt"), bare)
    assert {r.path for r in spark.read.parquet(f"{bare}/done").collect()} == {dcm, at["d.txt.gz"]} and counts["files"] == 2
    again = run.run(spark, str(tmp_path / "l.txt"), bare, renderer=renderer, reader=reader, layouts=places, save_maps=False)
    assert again["files"] == 6 and spark.read.parquet(f"{bare}/raw").count() == 4


def test_manifest_names_images(spark, tmp_path):
    """Identity from the manifest alone, from both, and the file found under its name with _1 after it."""
    header = [("h", 900 + i, t, 0.9, x, y, 0, 0, 0, 0, None) for i, (t, x, y) in enumerate([("ID:", 100, 80), ("P9", 200, 80), ("Eye:", 100, 110), ("Left", 200, 110)])]
    _, reader = tagged_fakes({8: make("p")[0] + header})
    (tmp_path / "a.png").write_bytes(page_bytes(8))
    (tmp_path / "b.png_1").write_bytes(page_bytes(8))
    a, b, c = (str(tmp_path / n) for n in ("a.png", "b.png", "c.png"))
    (tmp_path / "m.csv").write_text(f"filename,id,dob,laterality,examdate,examtime\n{a},M1,19800101,OD,20240101,101112\n{b},M2,,,,\n{c},M3,,,,\n")
    out = str(tmp_path / "out")
    counts = run.run(spark, str(tmp_path / "m.csv"), out, reader=reader, layouts=pages.layout_frame(spark, layout()), save_maps=False)
    rows = {r.id: r for r in spark.read.parquet(f"{out}/raw").collect()}
    assert {i: (r.eye, r.source_file) for i, r in rows.items()} == {"M1": ("OD", a), "M2": ("OS", b)}
    assert (counts["files"], counts["closed"], counts["rejected"], counts["visits"]) == (2, 1, 1, 2)
    assert run.run(spark, str(tmp_path / "m.csv"), out)["files"] == 0


def test_second_looks_and_images(spark, tmp_path):
    """A value that lost its sign gets it back from a crop, maps and pages become files, and no image is in a checkpoint."""
    items = make("p", tweak={"Qval_front": "0.3"})[0]
    anchors = [("m", 800 + i, t, 0.9, x, y, 0, 0, 0, 0, None) for i, (t, x, y) in enumerate([("Axial Curvature (Front)", 1500.0, 300.0), ("Corneal Thickness", 1500.0, 1400.0)])]
    renderer, reader = tagged_fakes({7: items + anchors}, [("-0.3", 0.9, [(0, 0)])])
    source = tmp_path / "pages"
    source.mkdir()
    (source / f"{files.VENDOR_ROOT}5.dcm").write_bytes(make_dicom(document=b"%PDF\x07\x07"))
    out = str(tmp_path / "out")
    held = lambda: {p for p in glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/**/part-*", recursive=True)}
    before = held()
    counts = run.run(spark, str(source), out, renderer=renderer, reader=reader, layouts=pages.layout_frame(spark, layout()), save_pages=True)
    page = next(r for r in spark.read.parquet(f"{out}/raw").collect() if r.printout_type == "FourMapsRefractive" and r.page_number == 1)
    assert page.Qval_front == -0.3
    names = {p.rsplit("/", 1)[-1] for p in glob.glob(f"{out}/images/*/*")}
    assert names == {"page1_4maps_refr.png", "page2_4maps_refr.png", "map_4mr_all.png"} and counts["images"] == 3
    whole = images.Decoder().decode(open(next(iter(glob.glob(f"{out}/images/*/page1_4maps_refr.png"))), "rb").read())
    assert whole.shape == (2700, 2800, 3) and (whole[0, 0] == 7).all()
    after = held() - before
    assert after and max(map(os.path.getsize, after)) < 300_000  # a page has 22 MB of pixels
    folder_ = f"{out}/images/v"
    assert put_file(folder_, "x.png", b"1") and not put_file(folder_, "x.png", b"2") and os.listdir(folder_) == ["x.png"]


def test_a_run_that_fails_keeps_the_batches_before(spark, tmp_path):
    """Files in five batches, of which the third can't be read: two are committed, and the next run takes the rest."""
    root = tmp_path / "in"
    root.mkdir()
    for i in range(12):
        (root / f"{files.VENDOR_ROOT}{i}.dcm").write_bytes(make_dicom(extra=b"").replace(b" P1 ", b"%03d " % i))
    size = len(make_dicom())
    out, paths = str(tmp_path / "out"), files.folder_files(spark, str(root), content=False)
    dealt, n = incremental.batched(paths, size * 12 // 5 + 1)
    of = {r.path: r.batch for r in dealt.collect()}
    assert n == 5 and len(set(of.values())) == 5
    bad = {p for p, b in of.items() if b == 2}
    state = tmp_path / "broken"
    state.write_text("")

    def opener(path):
        if state.exists() and path in bad:
            raise RuntimeError("the store is down")
        return files.open_file(path)

    with pytest.raises(Exception, match="the store is down"):
        run.run(spark, str(root), out, opener=opener, batch_bytes=size * 12 // 5 + 1)
    done = {r.path for r in spark.read.parquet(f"{out}/done").collect()}
    assert done == {p for p, b in of.items() if b < 2} and spark.read.parquet(f"{out}/done").select("commit").distinct().count() == 2
    state.unlink()
    counts = run.run(spark, str(root), out, opener=opener, batch_bytes=size * 12 // 5 + 1)
    assert counts["files"] == 12 - len(done) and counts["visits"] == counts["rows"] == 12
    assert spark.read.parquet(f"{out}/compact").count() == spark.read.parquet(f"{out}/detailed").count() == spark.read.parquet(f"{out}/sources").count() == 12


def test_flat_table_of_pages(spark, tmp_path):
    """A row per page of any kind of file with what the file says, by extension whatever its case, and nothing of others."""
    renderer, reader = tagged_fakes({7: make("p")[0], 9: [("x", 0, "nothing known", 0.9, 10.0, 10.0, 0, 0, 0, 0, None)]})
    source = tmp_path / "in"
    (source / "deep").mkdir(parents=True)
    named = make_dicom(document=b"%PDF\x07\x09", blob=make_record()).replace(b"Doe^Ann^M", b"Doe,Ann\"M")
    for name, data in (("any.DCM", named), ("deep/b.pdf", b"%PDF\x07\x07"), ("c.Png", page_bytes(7)), ("d.bmp", page_bytes(7)), ("e.txt", b"x"), ("none.dcm", make_dicom(document=b"")), ("bad.dcm", b"no dicom")):
        (source / name).write_bytes(data)
    out, by = str(tmp_path / "out"), engines.Engines(renderer, reader, images.Decoder, files.open_file)
    for again in range(2):
        assert flat.export(spark, str(source), out, pages.layout_frame(spark, layout()), by) == {"pages": 4, "rejected": 3}
    table = spark.read.options(header=True, escape='"').csv(f"{out}/pages")
    assert table.columns == flat.COLUMNS and len(flat.COLUMNS) == 17 + 2 * 66
    rows = {(r.filename, int(r.page)): r for r in table.collect()}
    assert set(rows) == {("any.DCM", 1), ("b.pdf", 1), ("b.pdf", 2), ("c.Png", 1)}
    seen = rows["any.DCM", 1]
    assert (seen.patient_id, seen.patient_name, seen.laterality, seen.exam_time) == ("P1", 'Doe,Ann"M', "OS", "101112")
    assert (seen.sr_values, seen.blob_HWTW, seen.blob_ACD) == ("DICOM_BAMD=1.75;DICOM_RSAGMIN=7.5", "11.80", "3.00")
    assert seen.printout_type == "FourMapsRefractive" and seen.Rf_front == rows["c.Png", 1].Rf_front == "7.8" and len(seen.Rf_front_conf.split(".")[1]) == 4
    assert rows["b.pdf", 2].patient_id is None and rows["b.pdf", 2].sr_values is None and seen.Belin_Df is None and seen.Belin_Df_conf is None
    assert int(seen.n_fields) == sum(seen[f] is not None for f in flat.dims.FIELDS)
    why = {(r.category, r.file.rsplit("/", 1)[-1]) for r in spark.read.parquet(f"{out}/rejects").collect()}
    assert why == {("UNKNOWN_PAGE", "any.DCM#2"), (flat.NO_DOCUMENT, "none.dcm"), ("DICOM_ERROR", "bad.dcm")}

    # A path list keeps what is there, whatever it is called, once; one file stands for itself.
    (tmp_path / "l.txt").write_text(f"{source}/d.bmp\n\n {source}/gone.pdf\n{source}/d.bmp\n")
    layouts = pages.layout_frame(spark, layout())
    rows, rejects = flat.flat_pages(spark, str(tmp_path / "l.txt"), layouts, by)
    assert rejects.count() == 0 and [(r.path, r.page) for r in rows.collect()] == [(f"{source}/d.bmp", 1)]
    assert [r.filename for r in flat.flat_pages(spark, str(source / "c.Png"), layouts, by)[0].collect()] == ["c.Png"]
    with pytest.raises(SystemExit, match="needs"):
        command.main([str(source), out, "--flat"], spark)


def test_blank_numbers_stay_blank(spark, tmp_path):
    """A null confidence or reliability is an empty cell, not the word null."""
    tables.write_csv(spark.createDataFrame([(1, 0.5, None, None), (2, None, 0.25, 3.0)], "n int, a_conf float, a_reliability float, v double").orderBy("n"), str(tmp_path / "t"))
    assert [x for p in sorted(glob.glob(f"{tmp_path}/t/part-*")) for x in open(p).read().splitlines() if x[0] != "n"] == ["1,0.5000,,", "2,,0.250,3"]


def test_summaries_follow_what_is_new(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    put = lambda i, patient, tree=b"": (root / f"{files.VENDOR_ROOT}{i}.dcm").write_bytes(make_dicom(bool(i % 2)).replace(b" P1 ", patient))
    for i in range(4):
        put(i, b"%03d " % i)
    out = str(tmp_path / "out")
    first = run.run(spark, str(root), out, csv=True)
    put(4, b"001 ")  # one more file of a visit
    put(5, b"009 ")
    second = run.run(spark, str(root), out, csv=True)
    assert (first["visits"], second["visits"], second["files"], second["rows"]) == (4, 5, 2, 6)
    rows = {r.id: r for r in spark.read.parquet(f"{out}/detailed").collect()}
    assert rows["001"].n_source_rows == 2 and rows["000"].n_source_rows == 1 and set(rows) == {"000", "001", "002", "003", "009"}
    shown = {n: sorted(map(tuple, spark.read.parquet(f"{out}/{n}").drop("bucket").select("*").collect()), key=str) for n in ("compact", "detailed", "sources")}
    whole = command.main([str(root), out, "--rebuild", "--no-names"], spark)
    assert (whole["rows"], whole["visits"]) == (6, 5) and "FamilyName" not in spark.read.parquet(f"{out}/compact").columns
    run.rebuild(spark, out)
    assert shown == {n: sorted(map(tuple, spark.read.parquet(f"{out}/{n}").drop("bucket").select("*").collect()), key=str) for n in shown}
    lines = [line for p in sorted(glob.glob(f"{out}/compact_csv/part-*.csv")) for line in open(p).read().splitlines()[1:]]
    assert len(lines) == 5 and [x.split(",")[0] for x in lines] != [] and glob.glob(f"{out}/compact.previous")

    # Rows that a failed run wrote are not seen.
    spark.read.parquet(f"{out}/raw").limit(1).drop("commit").selectExpr("*", "'cdead' AS commit").write.mode("append").partitionBy("bucket", "commit").parquet(f"{out}/raw")
    assert run.rebuild(spark, out)["rows"] == 6


def test_engines_by_name_and_backup(spark, tmp_path, monkeypatch):
    (tmp_path / "my_engines.py").write_text(textwrap.dedent("""
        class reader:
            def read(self, image):
                return []
        """))
    monkeypatch.syspath_prepend(str(tmp_path))
    by = engines.named("my_engines")
    assert by.reader.__name__ == "reader" and by.renderer is None and by.decoder is images.Decoder and by.opener is files.open_file
    out = str(tmp_path / "out")
    spark.range(1).write.parquet(f"{out}/raw")
    counts = command.main(["nowhere", out, "--backup-only", "--backup", str(tmp_path / "safe")], spark)
    assert counts == {"copied": 1} and spark.read.parquet(str(tmp_path / "safe" / "raw")).count() == 1


def test_dicom_source_reads_what_is_asked_for(spark, tmp_path):
    blob = b"b" * 38_400
    for i in range(3):
        (tmp_path / f"{i}.dcm").write_bytes(make_dicom(i == 1, blob, b""))
    (tmp_path / "x.dcm").write_bytes(b"no dicom at all")
    (tmp_path / "y.txt").write_bytes(b"")
    spark.dataSource.register(dicom.Dicom)
    full = spark.read.format("dicom").option("partitionBytes", 1).load(str(tmp_path))
    assert full.rdd.getNumPartitions() == 4
    rows = {r.path.rsplit("/", 1)[-1]: r for r in full.collect()}
    assert set(rows) == {"0.dcm", "1.dcm", "2.dcm", "x.dcm"} and rows["x.dcm"].error == "not a DICOM file" and rows["1.dcm"].patient_id == "P1"
    assert bytes(rows["0.dcm"].blob) == blob and bytes(rows["0.dcm"].pdf) == b"%PDF" and len(rows["0.dcm"].sr) == 6
    some = spark.read.format("dicom").schema("path string, patient_id string, length long").load(str(tmp_path))
    assert some.columns == ["path", "patient_id", "length"] and {r.patient_id for r in some.collect()} == {"P1", None}
    with pytest.raises(Exception, match="has no nonsense"):
        spark.read.format("dicom").schema("path string, nonsense string").load(str(tmp_path)).collect()
    # What is not asked for is stepped over.
    large = make_dicom(extra=b"", blob=b"b" * 5_000_000)
    window = dicom.Window(io.BytesIO(large))
    assert dicom.file_values(window, ("patient_id",)) == {"patient_id": "P1"} and window.read < 300_000
    with pytest.raises(ValueError):
        dicom.file_values(b"\0" * 128 + b"DICM" + b"\x08\x00\x20\x00OB\0\0", ("patient_id",))


def test_images_are_decoded():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (9, 7, 3)).astype(np.uint8)
    assert (images.Decoder().decode(images.png(pixels)) == pixels).all()

    def file(rows, colour, bits=8, palette=b""):
        part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 7, 9, bits, colour, 0, 0, 0)) + (part(b"PLTE", palette) if palette else b"") + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")

    def filtered(kind, lines, step):
        """Each line by a filter, as an encoder has it."""
        out, above = b"", np.zeros(lines.shape[1], int)
        for line in lines.astype(int):
            left, corner = np.concatenate([np.zeros(step, int), line[:-step]]), np.concatenate([np.zeros(step, int), above[:-step]])
            p = left + above - corner
            near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
            out += bytes([kind]) + ((line - [0, left, above, (left + above) // 2, near][kind]) % 256).astype(np.uint8).tobytes()
            above = line
        return out

    for kind in range(5):
        assert (images.Decoder().decode(file(filtered(kind, pixels.reshape(9, -1), 3), 2)) == pixels).all()
    grey = pixels[..., 0]
    assert (images.Decoder().decode(file(filtered(4, grey, 1), 0)) == grey[..., None]).all()
    deep = np.stack([grey, pixels[..., 1]], -1).reshape(9, -1)
    assert (images.Decoder().decode(file(filtered(2, deep, 2), 0, 16)) == grey[..., None]).all()
    assert (images.Decoder().decode(file(filtered(1, grey % 4, 1), 3, palette=bytes(range(12)))) == np.arange(12, dtype=np.uint8).reshape(4, 3)[grey % 4]).all()
    for bad in (b"GIF89a", b"\x89PNG\r\n\x1a\n"):
        with pytest.raises(ValueError):
            images.Decoder().decode(bad)


def test_kinds_of_files():
    assert [files.kind_of(p, h) for p, h in (("a/b.DCM", b""), ("x.pdf", b""), ("x.jpeg", b""), ("a.b/c", b"BM"), ("x.JPG_1", b"\xff\xd8\xff\xe0"), ("x.txt", b"II*\0"), ("x", b"%PDF"), ("x", b""))] == ["dcm", "pdf", "image", "image", "image", "image", None, None]
    assert decode.AGAIN == ("MISSING_FILE", "UNREADABLE_FILE", "NO_ENGINE")
