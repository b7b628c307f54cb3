"""From decoded files and page items to wide raw rows: report rows, record rows and page rows of each file.

A file gives at most one report row and one record row and a row per supported
page; all share the file's identity. Page readings come from an engine (see
sources.engines) as items, so everything here is relational.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keratoline import dims, schemas
from keratoline.functions import dates, keys
from keratoline.operators.filters import has_all
from keratoline.operators.resolve import map_codes, pivot_fields
from keratoline.sources import dicom, records

REPORT_ORD, RECORD_ORD, PAGE_ORD = 0, 1, 1  # a page's own number is added to the last


def split_name(name: Column) -> tuple[Column, Column]:
    parts = F.split(F.coalesce(name, F.lit("")), r"\^")
    return F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def key_columns(patient: Column, eye: Column, date: Column, time: Column, exact: bool = True, salt: str = "") -> Column:
    """The visit key; by the true calendar where the date is one, unless exact=False asks for keys as older exports have them."""
    approximate = dates.approximate_epoch(F.coalesce(date, F.lit("")), F.coalesce(time, F.lit("")))
    if not exact:
        return keys.visit_id_blake3(patient, eye, approximate)
    true = dates.calendar_epoch(F.coalesce(date, F.lit("")), F.coalesce(time, F.lit("")))
    return keys.visit_id(patient, eye, F.coalesce(true, approximate), salt)


def base_rows(meta: DataFrame, names: bool = True, exact_keys: bool = True) -> DataFrame:
    """Identity of each file, nulls as empty strings. A missing eye counts as OD in the key only."""
    family, given = split_name(F.col("patient_name"))
    e = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    out = meta.select(
        "path", F.coalesce("patient_id", F.lit("")).alias("id"), family.alias("FamilyName"), given.alias("GivenName"), F.coalesce("date_of_birth", F.lit("")).alias("birthdate"),
        e("eye"), e("exam_date"), e("exam_time"), e("device_serial"), e("software_version"),
        F.regexp_extract("path", r"^(.*)/[^/]*\z", 1).alias("source_folder"), F.regexp_extract("path", r"([^/]*)\z", 1).alias("source_file"),
        key_columns(F.col("patient_id"), F.col("eye"), F.col("exam_date"), F.col("exam_time"), exact_keys).alias("imagedir"),
    )
    return out if names else out.drop(*schemas.NAMES)


def bare_rows(paths: DataFrame, names: bool = True) -> DataFrame:
    """As base_rows(), of files (path) that say nothing of a patient."""
    blank = [F.lit("").alias(c) for c in ("id", "FamilyName", "GivenName", "birthdate", "eye", "exam_date", "exam_time", "device_serial", "software_version")]
    out = paths.select("path", *blank, F.regexp_extract("path", r"^(.*)/[^/]*\z", 1).alias("source_folder"), F.regexp_extract("path", r"([^/]*)\z", 1).alias("source_file"), F.lit("").alias("imagedir"))
    return out if names else out.drop(*schemas.NAMES)


def image_rows(identity: DataFrame, written: DataFrame, names: bool = True) -> DataFrame:
    """As base_rows(), of image files by image_identity(); written is (path, filename) of those that a manifest names, by which they are called."""
    place = bare_rows(identity.select("path"), names).select("path", "source_folder", "source_file", "device_serial", "software_version")
    out = identity.drop("page_id").join(place, "path").join(written.groupBy("path").agg(F.min("filename").alias("filename")), "path", "left")
    out = out.withColumn("source_file", F.coalesce("filename", "source_file")).drop("filename")
    return out if names else out.drop(*schemas.NAMES)


def _wide(base: DataFrame, values: DataFrame, by: list[str], extra: dict[str, Column]) -> DataFrame:
    """Values in long form as one wide row per file (and page), with confidences beside them."""
    wide = pivot_fields(values, by, dims.FIELDS, {"value": "", "conf": schemas.CONF_SUFFIX})
    counts = values.groupBy(*by).agg(F.count("*").cast("int").alias("n_fields"))
    return base.join(counts, "path").join(wide, by).withColumns(extra)


def report_rows(decoded: DataFrame, base: DataFrame) -> DataFrame:
    values = map_codes(dicom.report_codes(decoded), ["path"])
    return _wide(base, values, ["path"], {"printout_type": F.lit("SR"), "qa_status": F.lit("ok"), "page_number": F.lit(0), "event": F.lit(REPORT_ORD)})


def record_rows(decoded: DataFrame, base: DataFrame) -> DataFrame:
    values = records.record_values(records.decode(decoded.where("blob is not null").select("path", "blob")), ["path"])
    return _wide(base, values, ["path"], {"printout_type": F.lit("SPR"), "qa_status": F.lit("ok"), "page_number": F.lit(0), "event": F.lit(RECORD_ORD)})


def page_rows(base: DataFrame, pages: DataFrame, located: DataFrame, names: DataFrame, supported_only: bool | Column = True) -> DataFrame:
    """Page rows. names maps page_id to (path, page_number); types that are not supported go where supported_only (a column of names, if it differs) holds."""
    told = pages.join(names, "page_id")
    if supported_only is not False:
        told = told.where(F.col("printout_type").isin(dims.SUPPORTED_TYPES) | ~F.lit(supported_only))
    wide = pivot_fields(located.where(F.col("field").isin(dims.FIELDS)), ["page_id"], dims.FIELDS, {"value": "", "conf": schemas.CONF_SUFFIX})
    out = base.join(told.select("page_id", "path", "page_number", "printout_type", "qa_status", "n_fields"), "path").join(wide, "page_id", "left")
    return out.withColumn("event", F.col("page_number") + PAGE_ORD).drop("page_id")


def raw_rows(parts: list[DataFrame], names: bool = True, listing: DataFrame | None = None) -> DataFrame:
    """All rows of all files, with `ord`: the file's place in the listing, its path, and the row's place in it.

    listing is (path, ord) of inputs that have an order of their own, such as
    path lists and manifests; else files go by path. `ord` compares as a whole,
    so nothing has to be numbered over all files.
    """
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    if listing is not None:
        out = out.join(listing.groupBy("path").agg(F.min("ord").alias("at")), "path", "left")
    there = set(out.columns)
    place = F.col("at").cast("long") if listing is not None else F.lit(0).cast("long")
    at = F.struct(place.alias("at"), F.col("path"), F.col("event").cast("int").alias("event")).alias("ord")
    return out.withColumn("ord", at).selectExpr(*[f"`{c}`" if c in there else f"CAST(NULL AS DOUBLE) AS `{c}`" for c in schemas.raw_columns(names)], "path", "event", "ord")


def image_identity(pages: DataFrame, found: DataFrame, manifest: DataFrame, exact_keys: bool = True) -> DataFrame:
    """Identity of image pages in three tiers: a manifest row with core identity alone, a partial one filled from the page, else the page.

    pages has page_id and path, found is plans.pages.demographics, manifest has path.
    """
    family, given = split_name(F.col("patient_name"))
    seen = found.select("page_id", F.col("patient_id").alias("o_id"), family.alias("o_family"), given.alias("o_given"), F.col("date_of_birth").alias("o_dob"), F.col("eye").alias("o_eye"), F.col("exam_date").alias("o_date"), F.col("exam_time").alias("o_time"))
    core = has_all(["id", "dob", "laterality", "examdate", "examtime"]).alias("core")
    given_rows = manifest.select("path", "id", "family_name", "given_name", "dob", "laterality", "examdate", "examtime", core)
    joined = pages.select("page_id", "path").join(given_rows, "path", "left").join(seen, "page_id", "left")
    core = F.coalesce("core", F.lit(False))
    pick = lambda m, o, name: F.coalesce(F.col(m), F.when(~core, F.col(o)), F.lit("")).alias(name)
    out = joined.select("page_id", "path", pick("id", "o_id", "id"), pick("family_name", "o_family", "FamilyName"), pick("given_name", "o_given", "GivenName"), pick("dob", "o_dob", "birthdate"), pick("laterality", "o_eye", "eye"), pick("examdate", "o_date", "exam_date"), pick("examtime", "o_time", "exam_time"))
    side = F.coalesce(dates.laterality(F.col("eye")), F.col("eye"))
    keyed = (F.col("id") != "") & (F.col("eye") != "")
    return out.withColumn("imagedir", F.when(keyed, key_columns(F.col("id"), side, F.col("exam_date"), F.col("exam_time"), exact_keys)).otherwise(F.lit("")))
