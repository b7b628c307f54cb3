"""Page and map images of visits, as rows of (visit_id, name, png) or as files, and copies of output folders."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keratoline.operators.ranking import first_by
from keratoline.sources.decode import look_again
from keratoline.sources.engines import Engines
from keratoline.sources.files import file_system
from keratoline.sources.images import png

# What stands for the page types in file names, replaced in this order.
SHORT = [
    ("FourMaps", "4maps_"),
    ("Refractive", "refr"),
    ("Selectable", "sel"),
    ("TopometricKcStaging", "topo"),
    ("BelinAmbrosio", "belin"),
    ("BelinAbcdProgression", "belin_abcd"),
    (" ", "_"),
]
SCHEMA = "visit_id string, name string, png binary"


def page_name(kind: Column, page: Column) -> Column:
    for old, new in SHORT:
        kind = F.replace(kind, F.lit(old), F.lit(new))
    return F.concat(F.lit("page"), page.cast("string"), F.lit("_"), F.lower(kind), F.lit(".png"))


def _cut(rows: DataFrame) -> DataFrame:
    """rows: visit_id, page_id, image, files (name and box; a null box is the whole page)."""
    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            for visit, im, files in zip(b["visit_id"], b["image"], b["files"], strict=True):
                pixels = np.frombuffer(im["data"], np.uint8).reshape(im["height"], im["width"], 3)
                out = []
                for f in files:
                    box = f["box"]
                    part = pixels if box is None else pixels[box["y"] : box["y"] + box["height"], box["x"] : box["x"] + box["width"]]
                    if part.size:
                        out.append((visit, f["name"], png(part)))
                yield pd.DataFrame(out, columns=["visit_id", "name", "png"])

    return rows.where("visit_id <> '' and image is not null").select("visit_id", "image", "files").mapInPandas(run, SCHEMA)


def page_images(images: DataFrame, told: DataFrame) -> DataFrame:
    """Whole pages. images has page_id and image; told has page_id, visit_id, printout_type, page_number.

    Of two files of one name the one of the smaller page_id stays; pages without
    a visit key or a type give none.
    """
    named = told.where("printout_type is not null").select("page_id", "visit_id", page_name(F.col("printout_type"), F.col("page_number")).alias("name"))
    first = first_by(named, ["visit_id", "name"], ["page_id"])
    box = F.lit(None).cast("struct<x: int, y: int, width: int, height: int>")
    return _cut(first.withColumn("files", F.array(F.struct("name", box.alias("box")))).join(images.select("page_id", "image"), "page_id"))


def map_images(images: DataFrame, told: DataFrame, regions: DataFrame) -> DataFrame:
    """The boxes of plans.maps.regions; of two of one name in a visit the one of the smaller page_id stays. A page's image moves once."""
    named = regions.join(told.select("page_id", "visit_id"), "page_id").withColumn("name", F.concat(F.lit("map_"), "name", F.lit(".png")))
    first = first_by(named, ["visit_id", "name"], ["page_id"])
    files = first.groupBy("visit_id", "page_id").agg(F.collect_list(F.struct("name", F.struct("x", "y", "width", "height").alias("box"))).alias("files"))
    return _cut(files.join(images.select("page_id", "image"), "page_id"))


def wanted_pages(told: DataFrame) -> DataFrame:
    """(page_id, visit_id, name, box) of whole pages, chosen as page_images() does; a null box is the whole page."""
    named = told.where("printout_type is not null and visit_id <> ''").select("page_id", "visit_id", page_name(F.col("printout_type"), F.col("page_number")).alias("name"))
    return first_by(named, ["visit_id", "name"], ["page_id"]).withColumn("box", F.lit(None).cast("struct<x: int, y: int, width: int, height: int>"))


def wanted_maps(told: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, visit_id, name, box) of the maps on pages, chosen as map_images() does."""
    named = regions.join(told.where("visit_id <> ''").select("page_id", "visit_id"), "page_id").withColumn("name", F.concat(F.lit("map_"), "name", F.lit(".png")))
    return first_by(named, ["visit_id", "name"], ["page_id"]).select("page_id", "visit_id", "name", F.struct(*[F.col(c).cast("int").alias(c) for c in ("x", "y", "width", "height")]).alias("box"))


def put_file(folder: str, name: str, data: bytes) -> bool:
    """Writes a file unless there is one; False if there is. It stands under its name only when it is whole."""
    from pyarrow import fs

    system, at = file_system(folder)
    if system.get_file_info(f"{at}/{name}").type == fs.FileType.File:
        return False
    system.create_dir(at, recursive=True)
    part = f"{at}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as file:
        file.write(data)
    system.move(part, f"{at}/{name}")
    return True


def save(wanted: DataFrame, pages: DataFrame, engines: Engines, folder: str) -> DataFrame:
    """Writes the wanted images as <folder>/<visit>/<name>, from the tasks that render their pages; (page_id, visit_id, name, new).

    What is there already stays. Nothing is written before the rows are asked
    for, and a task that is run again writes the same files.
    """
    def each(pixels: np.ndarray, ask: dict) -> list[tuple]:
        box = ask["box"]
        part = pixels if box is None else pixels[max(box["y"], 0) : box["y"] + box["height"], max(box["x"], 0) : box["x"] + box["width"]]
        return [(ask["visit_id"], ask["name"], put_file(f"{folder}/{ask['visit_id']}", ask["name"], png(part)))] if part.size else []

    return look_again(wanted, pages, engines, each, "page_id string, visit_id string, name string, new boolean")


def not_saved(new: DataFrame, saved: DataFrame) -> DataFrame:
    """Images whose name the visit does not have yet."""
    return new.join(saved.select("visit_id", "name").distinct(), ["visit_id", "name"], "left_anti")


def keep_previous(spark: SparkSession, path: str) -> bool:
    """Copies a file or folder to its name with .previous, in place of an older one; False if there is nothing."""
    return _copied(spark, path, f"{path}.previous")


def copy_new(spark: SparkSession, source: str, backup: str) -> list[str]:
    """Copies those folders directly below source that backup does not have yet; their names."""
    fs, at = _at(spark, source)
    if not fs.exists(at):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory())
    to, there = _at(spark, backup)
    have = {f.getPath().getName() for f in to.listStatus(there)} if to.exists(there) else set()
    return [n for n in names if n not in have and _copied(spark, f"{source}/{n}", f"{backup}/{n}")]


def back_up(spark: SparkSession, out: str, backup: str, tables: tuple[str, ...] = ("raw", "compact", "detailed", "sources", "done", "rejects")) -> list[str]:
    """Copies new image folders and all tables of an output folder; the names of what was copied."""
    return [f"images/{n}" for n in copy_new(spark, f"{out}/images", f"{backup}/images")] + [t for t in tables if _copied(spark, f"{out}/{t}", f"{backup}/{t}")]


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _copied(spark: SparkSession, source: str, to: str) -> bool:
    fs, at = _at(spark, source)
    other, there = _at(spark, to)
    if not fs.exists(at):
        return False
    other.delete(there, True)
    other.mkdirs(there.getParent())
    return spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, other, there, False, spark._jsc.hadoopConfiguration())
