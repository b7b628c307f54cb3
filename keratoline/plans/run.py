"""The whole ingestion: from a folder, path list or manifest to raw rows, images, summaries, sources and rejects, restartable."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keratoline import schemas
from keratoline.materialize import settled
from keratoline.plans import ingest, maps, pages, visits
from keratoline.sinks import images, tables
from keratoline.sources import decode, dicom, engines, files
from keratoline.streaming import incremental

BUCKETS = 64  # folders by visit below each table: what a change rebuilds is chosen by them
BATCH = 64 << 30  # bytes of files that are committed together


class Found(NamedTuple):
    """What files give: raw rows, rejects, images to be written, and pages, whose pixels those are."""

    rows: DataFrame
    rejects: DataFrame
    images: DataFrame | None
    pages: DataFrame


def file_rows(
    decoded: DataFrame, manifest: DataFrame | None, names: bool, exact_keys: bool, listing: DataFrame | None, by: engines.Engines, layouts: DataFrame | None, save_pages: bool = False, save_maps: bool = False,
) -> Found:
    """Of decode.decode()'s files. A DICOM file gives a report, a record and page rows, a document and an image page rows.

    Pages of documents that stand alone have no identity, those of images one in
    three tiers (manifest, manifest filled from the page, page). Of documents
    that stand alone all known page types are taken, else those supported.
    """
    own = decoded.where("kind = 'dcm' and category is null")
    base = settled(ingest.base_rows(dicom.metadata(own), names, exact_keys))
    parts, rejects, wanted = [ingest.report_rows(own, base), ingest.record_rows(own, base)], decode.rejects(decoded), None
    there = settled(decode.pages_of(decoded))
    if layouts is not None:
        items = settled(decode.items_of_pages(decoded))
        again = lambda asked: engines.best_reading(decode.read_crops(asked, there, by), ["page_id", "field", "kind"])
        told, located = pages.extract(items, layouts, again)
        of_images = there.where("kind = 'image'").select("page_id", "path")
        if manifest is None:
            manifest = decoded.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in ("path", *schemas.MANIFEST)))
        who = ingest.image_identity(of_images, pages.demographics(items.join(of_images.select("page_id"), "page_id")), manifest, exact_keys)
        alone = ingest.bare_rows(decoded.where("kind = 'pdf' and category is null"), names)
        every = settled(base.unionByName(alone).unionByName(ingest.image_rows(who, manifest.select("path", "filename"), names)))
        numbered = there.select("page_id", "path", F.col("page").alias("page_number"), (F.col("kind") != "pdf").alias("supported_only"))
        parts.append(ingest.page_rows(every, told, located, numbered, F.col("supported_only")))
        rejects = rejects.union(pages.unrecognised(items))
        if save_pages or save_maps:
            visit = told.select("page_id", "printout_type").join(there, "page_id").join(every.select("path", F.col("imagedir").alias("visit_id")), "path")
            visit = settled(visit.select("page_id", "visit_id", "printout_type", F.col("page").alias("page_number"), "width", "height", "kind"))
            if save_maps:
                marked = settled(maps.anchors(items, visit))
                edges = decode.look_again(maps.scan_rows(marked), there, by, maps.ink_of, maps.EDGES)
                wanted = images.wanted_maps(visit, maps.regions(marked, edges))
            if save_pages:
                whole = images.wanted_pages(visit.where("kind = 'dcm'"))
                wanted = whole if wanted is None else wanted.unionByName(whole)
    return Found(ingest.raw_rows(parts, names, listing), rejects, wanted, there)


def bucket_of(visit: Column, path: Column | None = None) -> Column:
    """The folder of a visit; rows without a visit are spread by their file."""
    key = visit if path is None else F.when(F.coalesce(visit, F.lit("")) == "", path).otherwise(visit)
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _by_bucket(rows: DataFrame) -> DataFrame:
    """Rows of a bucket together, for few files, but in as many tasks as their size asks for."""
    return rows.hint("rebalance", F.col("bucket"))


def run(
    spark: SparkSession, source: str, out: str, listing: DataFrame | None = None, names: bool = True, exact_keys: bool = True,
    renderer: Callable | None = None, reader: Callable | None = None, layouts: DataFrame | None = None, csv: bool = False,
    decoder: Callable | None = engines.Decoder, opener: Callable = files.open_file, save_pages: bool = False, save_maps: bool = True, batch_bytes: int = BATCH, skip: tuple[str, ...] = (),
) -> dict[str, int]:
    """Ingests what the ledger below `out` lacks and rebuilds the summaries of the visits it touches; returns counts.

    Files go in batches of about `batch_bytes`, each with a commit of its own: a
    run that fails keeps the batches before, and rows of a batch that is not
    committed are not read. A batch's files are opened by the tasks, once for all
    that is read of them; second looks, map edges and images open them again.

    Below `out`: raw and rejects (appended), images (files by visit), done (the
    ledger), compact, detailed and sources, and with csv=True those as CSV
    folders too. Files that can't be opened, and those for which there is no
    engine, are rejects but not done. A second run with the same input adds nothing.
    """
    by = engines.Engines(renderer, reader, decoder, opener)
    raw, done, rejected = f"{out}/raw", f"{out}/done", f"{out}/rejects"
    planned = files.plan_input(spark, source, listing, incremental.ledger(spark, done))
    given = settled(planned.files if "length" in planned.files.columns else files.sized(planned.files, "_1" if source.endswith(".csv") and listing is None else None))
    order = given.select("path", "ord") if "ord" in given.columns else None
    lost = given.where("length is null").select("key", "path", "length")
    closed = planned.closed.select("path")
    if source.endswith(".csv"):
        closed = closed.union(lost.select("key"))
    closed = settled(closed.distinct())
    missing = lost.select(F.lit(decode.MISSING).alias("category"), F.col("key").alias("file"), F.lit("no such file").alias("detail"))
    counts = {"files": 0, "rejected": _written(planned.rejects.union(missing), rejected, None), "closed": closed.count(), "unkeyed": 0, "images": 0}
    if counts["closed"]:
        incremental.commit(closed, done, None)
    dealt, n = incremental.batched(given.where("length is not null"), batch_bytes)
    commits = []
    for i in range(n):
        name, batch = incremental.new_commit(), dealt.where(F.col("batch") == i)
        size = batch.agg(F.sum("length")).first()[0] or 0
        decoded = settled(decode.decode(batch.select("path").distinct(), by, layouts is not None, size))
        found = file_rows(decoded, batch if "filename" in batch.columns else None, names, exact_keys, order, by, layouts, save_pages, save_maps)
        if found.images is not None:
            counts["images"] += images.save(found.images, found.pages, by, f"{out}/images").where("new").count()
        seen = Observation()
        keyless = F.count_if(F.coalesce("imagedir", F.lit("")) == "").alias("unkeyed")
        rows = found.rows.observe(seen, keyless).withColumns({"bucket": bucket_of(F.col("imagedir"), F.col("path")), "commit": F.lit(name)})
        _by_bucket(rows).write.mode("append").partitionBy("bucket", "commit").parquet(raw)
        counts["unkeyed"] += seen.get["unkeyed"]
        counts["rejected"] += _written(found.rejects, rejected, name)
        looked_at = decoded.where(~F.coalesce(F.col("category").isin(*decode.AGAIN), F.lit(False))).select("path")
        keys = settled(batch.join(looked_at, "path").select(F.col("key").alias("path")).distinct())
        counts["files"] += keys.count()
        incremental.commit(keys, done, name)
        commits.append(name)
    counts |= rebuild(spark, out, names, commits, csv, skip)
    return counts


def _written(rejects: DataFrame, at: str, commit: str | None) -> int:
    """Appends rejects and returns how many; they are counted as they are written."""
    seen = Observation()
    rejects.withColumn("commit", F.lit(commit).cast("string")).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(at)
    return seen.get["n"]


def rebuild(spark: SparkSession, out: str, names: bool = True, commits: list[str] | None = None, csv: bool = False, skip: tuple[str, ...] = ()) -> dict[str, int]:
    """Makes the summaries of the visits that the commits touch anew, or of all visits; returns counts of all rows and visits.

    Only folders of raw rows and summaries in which a touched visit lies are read
    and overwritten; what they hold of other visits is kept as it is. So are the
    summaries of a run that stopped before it came to them made by the next
    rebuild without commits.
    """
    raw = f"{out}/raw"
    if not incremental.exists(spark, raw) or spark.read.parquet(raw).isEmpty():
        return {"rows": 0, "visits": 0}
    rows = incremental.committed(spark, raw, f"{out}/done")
    behind = incremental.ledger(spark, f"{out}/summarised").select(F.col("path").alias("commit"))
    new = rows.select("commit", "bucket", "imagedir").distinct()
    touched = new if commits is None else new.join(behind, "commit", "left_anti")  # also those of a run that stopped before its summaries
    touched = settled(touched.where("imagedir <> ''").select("bucket", "imagedir").distinct())
    folders = [r.bucket for r in touched.select("bucket").distinct().collect()]  # BUCKETS at most
    if folders:
        mine = rows.where(F.col("bucket").isin(folders)).join(touched.select("imagedir"), "imagedir", "left_semi")
        compact, detailed = visits.summaries(settled(mine.drop("bucket", "commit")), names)
        made = {"compact": (compact, "imagedir"), "detailed": (detailed, "imagedir"), "sources": (tables.visit_sources(mine), "visit_id")}
        for name, (table, key) in made.items():
            if name in skip:
                continue
            at = f"{out}/{name}"
            table = table.withColumn("bucket", bucket_of(F.col(key)))
            if commits is not None and incremental.exists(spark, at):
                kept = spark.read.parquet(at).where(F.col("bucket").isin(folders)).join(touched.select(F.col("imagedir").alias(key)), key, "left_anti")
                table = table.unionByName(kept, allowMissingColumns=True)
            _by_bucket(settled(table)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(at)
            if csv:
                tables.write_csv(spark.read.parquet(at).drop("bucket").orderBy(key), f"{out}/{name}_csv")
    incremental.commit(rows.select(F.col("commit").alias("path")).distinct().join(behind.withColumnRenamed("commit", "path"), "path", "left_anti"), f"{out}/summarised", None)
    done = "compact" if "compact" not in skip else "detailed"
    return {"rows": rows.count(), "visits": spark.read.parquet(f"{out}/{done}").count() if incremental.exists(spark, f"{out}/{done}") else 0}
