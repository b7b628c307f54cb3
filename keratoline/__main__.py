"""python -m keratoline SOURCE OUT: ingests a folder, path list (.txt), manifest (.csv) or file into tables below OUT."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from keratoline.plans import flat, pages
from keratoline.plans.run import BATCH, rebuild, run
from keratoline.sinks.images import back_up, keep_previous
from keratoline.sources import engines
from keratoline.sources.files import folder_files


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keratoline", description=__doc__)
    p.add_argument("source", help="folder, path list (.txt), manifest (.csv) or file")
    p.add_argument("out", help="folder of the tables; what is done is noted there, so a run can be repeated")
    p.add_argument("--files", metavar="FOLDER", help="folder in which a manifest's files are looked up, if not under their names")
    p.add_argument("-x", "--no-names", action="store_true", help="leave patients' names out of all tables")
    p.add_argument("--old-keys", action="store_true", help="visit keys as older exports have them")
    p.add_argument("--csv", action="store_true", help="write the summaries as CSV too")
    p.add_argument("--engines", metavar="MODULE", help="module with `renderer`, `reader` and perhaps `decoder` and `opener`, by which pages are read")
    p.add_argument("--layouts", metavar="CSV", help="places of fields on pages: layout, field, cy_ref, cx_ref")
    p.add_argument("--save-pages", action="store_true", help="write pages as images, which show patients' names")
    p.add_argument("--no-images", action="store_true", help="write no maps as images")
    p.add_argument("--no-compact", action="store_true", help="leave out the compact table")
    p.add_argument("--no-detailed", action="store_true", help="leave out the detailed table")
    p.add_argument("--flat", action="store_true", help="only write one row per page with all it and its file say (OUT/pages, CSV); needs --engines and --layouts")
    p.add_argument("--batch-gb", type=float, default=BATCH / (1 << 30), help="files that are committed together (%(default)s)")
    p.add_argument("--rebuild", action="store_true", help="read no files, make all summaries anew from the raw rows")
    p.add_argument("--backup", metavar="FOLDER", help="copy new images and all tables there afterwards")
    p.add_argument("--backup-only", action="store_true", help="do nothing but that")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, int]:
    o = options().parse_args(args)
    spark = spark or SparkSession.builder.appName("keratoline").getOrCreate()
    counts: dict[str, int] = {}
    skip = tuple(n for n, out in (("compact", o.no_compact), ("detailed", o.no_detailed)) if out)
    if o.flat:
        if not (o.engines and o.layouts):
            raise SystemExit("--flat needs --engines and --layouts")
        counts = flat.export(spark, o.source, o.out, pages.layout_frame(spark, o.layouts), engines.named(o.engines))
    elif not o.backup_only:
        for name in ("compact", "detailed"):
            keep_previous(spark, f"{o.out}/{name}")
        if o.rebuild:
            counts = rebuild(spark, o.out, not o.no_names, None, o.csv, skip)
        else:
            by = engines.named(o.engines) if o.engines else engines.Engines()
            counts = run(
                spark, o.source, o.out, folder_files(spark, o.files, content=False) if o.files else None, names=not o.no_names, exact_keys=not o.old_keys, csv=o.csv,
                renderer=by.renderer, reader=by.reader, decoder=by.decoder, opener=by.opener, layouts=pages.layout_frame(spark, o.layouts) if o.layouts else None,
                save_pages=o.save_pages, save_maps=not o.no_images, batch_bytes=int(o.batch_gb * (1 << 30)), skip=skip,
            )
    if o.backup:
        counts["copied"] = len(back_up(spark, o.out, o.backup))
    print(", ".join(f"{n} {k}" for k, n in counts.items()))
    return counts


if __name__ == "__main__":
    main()
