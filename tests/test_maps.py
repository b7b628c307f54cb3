"""Boxes of colour maps on pages made for the purpose."""

import numpy as np

from keratoline import schemas
from keratoline.plans import maps
from keratoline.sinks import images as saved
from keratoline.sources.images import png


def items(spark, rows):
    return spark.createDataFrame([(p, i, t, 0.9, float(x), float(y), 0.0, 0.0, 0.0, 0.0, None) for i, (p, t, x, y) in enumerate(rows)], schemas.ITEMS)


def test_boxes(spark):
    rows = [
        ("m", "Axial / Sagittal Curvature (Front)", 900, 300), ("m", "Elevation (Front)", 1900, 310), ("m", "Corneal Thickness", 900, 1100), ("m", "Curvature", 250, 400),
        ("b", "Elevation (Front)", 500, 200), ("b", "Elevation (Back)", 1100, 205), ("b", "Fixed", 500, 2000), ("b", "OCULUS", 100, 2040),
        ("b", "Corneal", 2400, 210), ("b", "Thickness", 2500, 212), ("b", "Abs.", 2900, 900), ("b", "CTSP", 2000, 1200), ("b", "PTI", 2000, 1600), ("b", "400", 1700, 1300), ("b", "Diameter", 2950, 1205),
        ("x", "Elevation (Front)", 500, 200),
    ]
    pages = spark.createDataFrame([("m", "FourMapsRefractive", 3500, 2500), ("b", "BelinAmbrosio", 3500, 2500), ("x", "FourMapsSelectable", 3500, 2500)], "page_id string, printout_type string, width int, height int")
    found = maps.anchors(items(spark, rows), pages)
    requests = maps.scan_rows(found)
    asked = {(r.page_id, r.scan): (r.row, r.start, r.stop) for r in requests.collect()}
    assert asked == {("m", "maps_right"): (620, 1750, 3500), ("b", "belin_left"): (500, 0, 1750), ("b", "thick_right"): (562, 1750, 3500)}
    paper = np.full((2500, 3500, 3), 255, np.uint8)
    paper[620, 3300] = paper[500, 40] = paper[562, 3000] = 10
    images = spark.createDataFrame([(p, (2500, 3500, bytearray(paper.tobytes()))) for p in ("m", "b")], "page_id string, image struct<height:int,width:int,data:binary>")
    edges = maps.scan_edges(requests, images)
    got = {r.name: (r.page_id, r.x, r.y, r.width, r.height) for r in maps.regions(found, edges).collect()}
    assert got["4mr_all"] == ("m", 160, 285, 3315 - 160, 1870 - 285)
    assert got["belin_left"] == ("b", 35, 175, 1400 - 35, 2030 - 175)
    half = (3015 - 2450) - 2 * (3015 - 2900)
    assert got["belin_thickness"] == ("b", 2450 - half, 185, 3015 - (2450 - half), 940 - 185)
    assert got["belin_charts"] == ("b", 1640, 1185, 3030 - 1640, 2030 - 1185)
    bare = maps.regions(found, edges.limit(0))
    assert {r.name for r in bare.collect()} >= {"4mr_all", "belin_left"}


def unpacked(data: bytes) -> np.ndarray:
    """The pixels of a PNG of ours."""
    import struct
    import zlib

    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts = 8, {}
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        assert struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + body)
        parts[kind], at = body, at + 12 + size
    w, h = struct.unpack(">II", parts[b"IHDR"][:8])
    return np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, 1 + 3 * w)[:, 1:].reshape(h, w, 3)


def test_images_of_visits(spark, tmp_path):
    rng = np.random.default_rng(0)
    pixels = {p: rng.integers(0, 256, (30, 40, 3)).astype(np.uint8) for p in ("p1", "p2", "p3")}
    assert (unpacked(png(pixels["p1"])) == pixels["p1"]).all()
    images = spark.createDataFrame([(p, (30, 40, bytearray(x.tobytes()))) for p, x in pixels.items()], "page_id string, image struct<height:int,width:int,data:binary>")
    told = spark.createDataFrame([("p1", "v", "FourMapsRefractive", 1), ("p2", "v", "FourMapsRefractive", 1), ("p3", "", "BelinAmbrosio", 2)], "page_id string, visit_id string, printout_type string, page_number int")
    pages = saved.page_images(images, told).collect()
    assert [(r.visit_id, r.name) for r in pages] == [("v", "page1_4maps_refr.png")] and (unpacked(bytes(pages[0].png)) == pixels["p1"]).all()
    boxes = spark.createDataFrame([("p1", "4mr_all", 5, 6, 10, 12), ("p2", "4mr_all", 0, 0, 4, 4), ("p2", "belin_left", 1, 2, 3, 4)], "page_id string, name string, x int, y int, width int, height int")
    cut = {r.name: unpacked(bytes(r.png)) for r in saved.map_images(images, told, boxes).collect()}
    assert set(cut) == {"map_4mr_all.png", "map_belin_left.png"} and (cut["map_4mr_all.png"] == pixels["p1"][6:18, 5:15]).all() and (cut["map_belin_left.png"] == pixels["p2"][2:6, 1:4]).all()
    have = spark.createDataFrame([("v", "map_4mr_all.png")], "visit_id string, name string")
    assert [r.name for r in saved.not_saved(saved.map_images(images, told, boxes), have).collect()] == ["map_belin_left.png"]


def test_copies_of_output(spark, tmp_path):
    out, backup = tmp_path / "out", tmp_path / "backup"
    for n in ("a", "b"):
        (out / "images" / n).mkdir(parents=True)
        (out / "images" / n / "f").write_text(n)
    (out / "raw").mkdir()
    (out / "raw" / "part").write_text("1")
    assert saved.back_up(spark, str(out), str(backup)) == ["images/a", "images/b", "raw"]
    (out / "images" / "c").mkdir()
    (out / "images" / "a" / "f").write_text("changed")
    (out / "raw" / "part").write_text("2")
    assert saved.back_up(spark, str(out), str(backup)) == ["images/c", "raw"]
    assert (backup / "images" / "a" / "f").read_text() == "a" and (backup / "raw" / "part").read_text() == "2"
    assert saved.keep_previous(spark, str(out / "raw")) and (out / "raw.previous" / "part").read_text() == "2" and not saved.keep_previous(spark, str(out / "none"))
