"""Where files come from: folders, path lists and manifests, all as (path, name, folder, ext, ord)."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keratoline import schemas
from keratoline.functions.dates import blank_to_null, manifest_date, manifest_time, trimmed
from keratoline.operators.joins import not_in_ledger
from keratoline.operators.ranking import first_by

VENDOR_ROOT = "1.3.6.1.4.1.34714."  # fixed value: the maker's registered root, with which its file names start
IMAGES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")
# Leading bytes of image formats.
MAGIC = [("89504E470D0A1A0A", "png"), ("FFD8FF", "jpg"), ("424D", "bmp"), ("49492A00", "tif"), ("4D4D002A", "tif"), ("47494638", "gif")]


def described(paths: DataFrame, path: str = "path") -> DataFrame:
    p = F.col(path)
    return paths.withColumns({"name": F.regexp_extract(p, r"([^/]*)\z", 1), "folder": F.regexp_extract(p, r"^(.*)/[^/]*\z", 1), "ext": F.lower(F.regexp_extract(p, r"\.([^./]*)\z", 1))})


def folder_files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """The vendor's DICOM files below a folder. The name test is in the listing, so others are never opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{VENDOR_ROOT}*.dcm").load(root)
    return described(found.select("path", "length", *(["content"] if content else [])))


def path_list(spark: SparkSession, file: str) -> DataFrame:
    """One path a line, trimmed, without blank lines."""
    lines = spark.read.text(file).select(trimmed(F.col("value")).alias("path")).where("path <> ''")
    return described(lines.withColumn("ord", F.monotonically_increasing_id()))


def manifest(spark: SparkSession, file: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a CSV whose columns stand in any order and may be missing but for filename.

    familyname and givenname are taken as family_name and given_name. Blank
    cells are null, dates and times normalised, rows without a file name go.
    """
    header = spark.read.option("header", True).option("inferSchema", False).csv(file).columns
    ddl = ", ".join(f"`{c}` string" for c in header)
    table = spark.read.options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", multiLine=True, escape='"').schema(f"{ddl}, _bad string").csv(file)
    names = {c.strip().lower(): c for c in header}
    names = {"family_name": names.get("familyname"), "given_name": names.get("givenname")} | names
    if not names.get("filename"):
        raise ValueError("the manifest has no column filename")
    cell = lambda n: blank_to_null(F.col(f"`{names[n]}`")) if names.get(n) else F.lit(None).cast("string")
    rows = table.select(*[cell(n).alias(n) for n in schemas.MANIFEST], "_bad")
    rows = rows.withColumns({"dob": manifest_date(F.col("dob")), "examdate": manifest_date(F.col("examdate")), "examtime": manifest_time(F.col("examtime"))})
    good = rows.where("filename is not null").drop("_bad").withColumn("ord", F.monotonically_increasing_id())
    bad = rows.where("filename is null").select(F.lit("MANIFEST_ROW").alias("category"), F.lit(file).alias("file"), F.coalesce("_bad", F.lit("no file name")).alias("detail"))
    return good, bad


def wanted_type(hint: Column) -> Column:
    """Whether a manifest's type hint names a page that is extracted; none leaves it to the page."""
    blank = F.coalesce(hint, F.lit("")) == ""
    starts = F.lit(False)
    for prefix in ("4 Maps Refr", "4 Maps Select", "Topometric", "4 Maps Topo"):  # fixed values
        starts = starts | F.startswith(hint, F.lit(prefix))
    return blank | F.coalesce(starts | F.contains(hint, F.lit("Enhanced Ectasia")), F.lit(False))


def home_path(path: Column, home: str | None = None) -> Column:
    home = home or os.environ.get("HOME") or os.environ.get("USERPROFILE") or "~"
    return F.when(F.startswith(path, F.lit("~/")), F.concat(F.lit(home), F.substring(path, 2, 1 << 30))).otherwise(path)


def resolve_paths(rows: DataFrame, listing: DataFrame, path: str = "filename", home: str | None = None) -> DataFrame:
    """Rows whose file is listed, under its name or else with `_1` after it, as `path`."""
    tried = rows.withColumn("__tries", F.array(home_path(F.col(path), home), F.concat(home_path(F.col(path), home), F.lit("_1"))))
    tried = tried.select(*rows.columns, F.posexplode("__tries").alias("__at", "__try"))
    found = tried.join(listing.select(F.col("path").alias("__path")).distinct(), F.col("__try") == F.col("__path"))
    return first_by(found, [path, "ord"], ["__at"]).withColumn("path", F.col("__path")).drop("__at", "__try", "__path")


def kind_of(path: str, head: bytes) -> str | None:
    """As file_kind(), of one file whose first bytes are known."""
    name = path.rsplit("/", 1)[-1]
    ext = name.rsplit(".", 1)[1].lower() if "." in name else ""
    if ext in ("dcm", "pdf"):
        return ext
    return "image" if ext in IMAGES or any(head.hex().upper().startswith(magic) for magic, _ in MAGIC) else None


def file_kind(ext: Column, content: Column | None = None) -> Column:
    """dcm, pdf, image or null: by extension, else by the first bytes."""
    out = F.when(ext == "dcm", "dcm").when(ext == "pdf", "pdf").when(ext.isin(*IMAGES), "image")
    if content is not None:
        head = F.hex(F.substring(content, 1, 8))
        sniffed = F.lit(False)
        for magic, _ in MAGIC:
            sniffed = sniffed | F.startswith(head, F.lit(magic))
        out = out.when(F.coalesce(sniffed, F.lit(False)), "image")
    return out


def open_input(spark: SparkSession, path: str, ledger: DataFrame | None = None) -> DataFrame:
    """Files to be processed, by the kind of input: a folder, a manifest (.csv), a path list (.txt), or one file."""
    if path.endswith(".csv"):
        rows, _ = manifest(spark, path)
        out = described(rows.where(wanted_type(F.col("printouttype"))).withColumn("path", home_path(F.col("filename"))))
    elif path.endswith(".txt"):
        out = path_list(spark, path)
    elif "." in os.path.basename(path) and not path.endswith("/"):
        out = described(spark.createDataFrame([(path,)], "path string"))
    else:
        out = folder_files(spark, path, content=False)
    return out if ledger is None else not_in_ledger(out, ledger, "path")


class Planned(NamedTuple):
    """files: what is to be read, with `key` for the ledger; closed: keys that are done without being read; rejects: why, where that is an error."""

    files: DataFrame
    closed: DataFrame
    rejects: DataFrame


def plan_input(spark: SparkSession, path: str, listing: DataFrame | None = None, ledger: DataFrame | None = None, home: str | None = None) -> Planned:
    """The input of any kind, settled against the ledger and, for a manifest, against the files that are there (listing).

    Of a manifest, rows whose type hint is not extracted and rows whose file is
    not listed are closed, so a restart does not look at them again; the latter
    and rows that can't be read are rejects. Without a listing, sized() finds out
    which files are there. A manifest's ledger keys are the file names as
    written, others' are paths.
    """
    none = spark.createDataFrame([], schemas.LEDGER)
    if not path.endswith(".csv"):
        return Planned(open_input(spark, path, ledger).withColumn("key", F.col("path")), none, spark.createDataFrame([], schemas.REJECTS))
    rows, bad = manifest(spark, path)
    if ledger is not None:
        rows = not_in_ledger(rows, ledger.select(F.col("path").alias("filename")), "filename")
    wanted = rows.where(wanted_type(F.col("printouttype")))
    if listing is None:
        found, missing = wanted.withColumn("path", home_path(F.col("filename"), home)), wanted.limit(0)
    else:
        found = resolve_paths(wanted, listing, home=home)
        missing = wanted.join(found.select("filename").distinct(), "filename", "left_anti")
    skipped = rows.where(~wanted_type(F.col("printouttype")))
    closed = skipped.select(F.col("filename").alias("path")).union(missing.select("filename")).distinct()
    lost = missing.select(F.lit("MISSING_FILE").alias("category"), F.col("filename").alias("file"), F.lit("neither under its name nor with _1 after it").alias("detail"))
    return Planned(described(found).withColumn("key", F.col("filename")), closed, bad.select("category", "file", "detail").union(lost))


def file_system(path: str):
    """(file system, path in it) by the path's scheme; a path without one is local."""
    from pyarrow import fs

    bare = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(bare) if "://" in bare else (fs.LocalFileSystem(), bare)


def open_file(path: str):
    """A file handle that reads and seeks, of any file system that the path's scheme tells."""
    system, at = file_system(path)
    return system.open_input_file(at)


TASK_BYTES = 128 << 20  # of files that one task opens, where there are so many


def spread(rows: DataFrame, size: int = 0) -> DataFrame:
    """Rows with a path over as many tasks as opening files of `size` bytes wants, four a core at least.

    The rows are small whatever the files are, so left alone a few tasks would get them all.
    """
    return rows.repartition(max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), "path")


def sized(paths: DataFrame, other: str | None = None) -> DataFrame:
    """The rows with `length`, looked up by the tasks; null where no file is. With `other`, a file is looked for under its path with that after it too."""
    kept = [c for c in paths.columns if c != "length"]
    at = kept.index("path")

    def run(batches: Iterator[pa.RecordBatch]):
        from pyarrow import fs

        for batch in batches:
            found, lengths = [], []
            for path in batch.column(at).to_pylist():
                for tried in (path, path + other) if other else (path,):
                    system, inner = file_system(tried)
                    info = system.get_file_info(inner)
                    if info.type == fs.FileType.File:
                        break
                there = info.type == fs.FileType.File
                found.append(tried if there else path)
                lengths.append(info.size if there else None)
            columns = [pa.array(found, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lengths, pa.int64())], names=[*kept, "length"])

    src = paths.select(*kept)
    return spread(src).mapInArrow(run, T.StructType([*src.schema.fields, T.StructField("length", T.LongType())]))
