"""A flat table of pages: one row per page of any file, with what the file says of itself beside all fields; no keys, no summaries, no ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keratoline import dims
from keratoline.materialize import settled
from keratoline.operators.resolve import pivot_fields
from keratoline.plans import pages
from keratoline.sinks import tables
from keratoline.sources import decode, dicom, engines, files, records

EXTENSIONS = ("dcm", "pdf", "png", "jpg", "jpeg")
SAID = ["patient_id", "patient_name", "dob", "sex", "exam_date", "exam_time", "laterality", "software_version", "device_serial"]
COLUMNS = ["filename", "page", "printout_type", "n_fields", "qa_status", *SAID, "sr_values", "blob_HWTW", "blob_ACD", *dims.FIELDS, *(f"{f}_conf" for f in dims.FIELDS)]
NO_DOCUMENT = "NO_DOCUMENT"


def found(spark: SparkSession, source: str) -> DataFrame:
    """(path, length) of a path list's files (.txt) that are there, of one file, or of all below a folder that end in EXTENSIONS, in either case."""
    if source.endswith(".txt"):
        return files.sized(files.path_list(spark, source).select("path").distinct()).where("length is not null")
    if files.file_system(source)[0].get_file_info(files.file_system(source)[1]).is_file:
        return files.sized(spark.createDataFrame([(source,)], "path string"))
    below = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select("path", "length")
    return files.described(below).where(F.col("ext").isin(*EXTENSIONS)).select("path", "length")


def of_file(decoded: DataFrame) -> DataFrame:
    """path, the metadata in SAID, sr_values (`code=value;...` by code) and the record's two measures with two places; blank where there is none."""
    own = decoded.where("kind = 'dcm' and category is null")
    meta = dicom.metadata(own).withColumnsRenamed({"date_of_birth": "dob", "eye": "laterality"}).select("path", *SAID)
    codes = tables.flat_codes(dicom.report_codes(own).where("value is not null"), "path").withColumnRenamed("codes", "sr_values")
    exact = records.decode(own.where("blob is not null").select("path", "blob")).select("path", F.col("exact.cornea_dia_mm").alias("hwtw"), F.col("exact.acd_mm").alias("acd"))
    exact = exact.select("path", tables.plain_number(F.col("hwtw"), 2).alias("blob_HWTW"), tables.plain_number(F.col("acd"), 2).alias("blob_ACD"))
    return meta.join(codes, "path", "left").join(exact, "path", "left")


def flat_rows(placed: DataFrame, of_files: DataFrame, told: DataFrame, located: DataFrame) -> DataFrame:
    """A row per page of a known type, in COLUMNS, after `path`.

    placed has page_id, path and page, of_files what of_file() gives, told and
    located are those of plans.pages.extract(). Pages of all known types are
    taken, supported or not; files that say nothing of themselves have nulls.
    Page ids must be unique; other columns are not read.
    """
    wide = pivot_fields(located.where(F.col("field").isin(dims.FIELDS)), ["page_id"], dims.FIELDS, {"value": "", "conf": "_conf"})
    known = told.where("printout_type is not null").select("page_id", "printout_type", "n_fields", "qa_status")
    out = known.join(placed.select("page_id", "path", "page"), "page_id").join(wide, "page_id", "left").join(of_files, "path", "left")
    return out.withColumn("filename", F.regexp_extract("path", r"([^/]*)\z", 1)).select("path", *COLUMNS)


def flat_pages(spark: SparkSession, source: str, layouts: DataFrame, by: engines.Engines) -> tuple[DataFrame, DataFrame]:
    """(rows as of flat_rows(), rejects) of all files that found() finds.

    A DICOM file without a document is a reject, since it has no page; so are
    files and pages that can't be read, and pages of no known type.
    """
    given = settled(found(spark, source))
    size = given.agg(F.sum("length")).first()[0] or 0
    decoded = settled(decode.decode(given.select("path").distinct(), by, True, size))
    placed = settled(decode.pages_of(decoded))
    items = settled(decode.items_of_pages(decoded))
    told, located = pages.extract(items, layouts, lambda asked: engines.best_reading(decode.read_crops(asked, placed, by), ["page_id", "field", "kind"]))
    empty = decoded.where("kind = 'dcm' and category is null and pages is null").select(F.lit(NO_DOCUMENT).alias("category"), F.col("path").alias("file"), F.lit("no embedded document").alias("detail"))
    return flat_rows(placed, of_file(decoded), told, located), decode.rejects(decoded).union(empty).union(pages.unrecognised(items))


def export(spark: SparkSession, source: str, out: str, layouts: DataFrame, by: engines.Engines) -> dict[str, int]:
    """Writes `out`/pages, a folder of CSV parts ordered by path and page, and `out`/rejects; returns counts of both.

    Both are made anew each time. Texts are quoted where they need it, so a name
    with a comma stays one cell.
    """
    rows, rejects = flat_pages(spark, source, layouts, by)
    rows, rejects = settled(rows), settled(rejects)
    tables.write_csv(rows.orderBy("path", "page").drop("path"), f"{out}/pages")
    rejects.write.mode("overwrite").parquet(f"{out}/rejects")
    return {"pages": rows.count(), "rejected": rejects.count()}
