"""Files of every kind, opened by the tasks that read them: one row a file with what it says.

Neither a file's content nor a page's pixels leave the task. A page is rendered
and read in one go; whatever needs its pixels again (second looks at single
fields, edges of maps, saved images) opens the file again where it is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keratoline.sources import dicom, images
from keratoline.sources.engines import DPI, Engines, items_of, tried_twice
from keratoline.sources.files import kind_of, spread

ITEM = ["ord", "text", "confidence", "cx", "cy", "x0", "y0", "x1", "y1"]
PAGE = "struct<page:int,width:int,height:int,page_height:int,category:string,error:string,items:array<struct<ord:int,text:string,confidence:float,cx:float,cy:float,x0:float,y0:float,x1:float,y1:float>>>"
SCHEMA = "path string, kind string, category string, error string, " + ", ".join(f"{t} string" for t in dicom.TAGS) + f", sr {dicom.REPORT}, blob binary, pages array<{PAGE}>"
# Why a file gave nothing. After those of AGAIN a later run looks at it once more.
MISSING, UNREADABLE, UNSUPPORTED, NO_ENGINE, DICOM, RENDER, READ, IMAGE = "MISSING_FILE", "UNREADABLE_FILE", "UNSUPPORTED_FILE", "NO_ENGINE", "DICOM_ERROR", "RENDER_ERROR", "READ_ERROR", "IMAGE_ERROR"
AGAIN = (MISSING, UNREADABLE, NO_ENGINE)
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "boolean": pa.bool_()}
LIKE_A_NUMBER = re.compile(r"\s*[(\[]*[+-]?[0-9]")


class Document:
    """The pages of a file: an image has one, others those of the document they are or hold."""

    def __init__(self, kind: str, data: bytes, engines: Engines):
        self.kind, self.data, self.engines = kind, data, engines

    def count(self) -> tuple[int | None, str | None]:
        if self.kind == "image":
            return 1, None
        return tried_twice(self.engines.renderer, lambda e: int(e.page_count(self.data)))

    def pixels(self, page: int) -> tuple[tuple[np.ndarray, int | None] | None, str | None]:
        """((image, its height if it was enlarged), error). Image files that are small are enlarged, rendered pages are as asked for."""
        if self.kind == "image":
            return tried_twice(self.engines.decoder, lambda e: images.upscaled(np.ascontiguousarray(e.decode(self.data), np.uint8)))
        return tried_twice(self.engines.renderer, lambda e: (np.ascontiguousarray(e.render(self.data, page, DPI), np.uint8), None))


def _page(document: Document, page: int) -> dict:
    row = dict.fromkeys(("page", "width", "height", "page_height", "category", "error", "items")) | {"page": page}
    made, error = document.pixels(page)
    if made is None:
        return row | {"category": IMAGE if document.kind == "image" else RENDER, "error": error}
    pixels, row["page_height"] = made
    row["height"], row["width"] = pixels.shape[:2]
    read, error = tried_twice(document.engines.reader, lambda e: items_of(e.read(pixels), "", None))
    if read is None:
        return row | {"category": READ, "error": error}
    return row | {"items": [dict(zip(ITEM, i[1:10], strict=True)) for i in read]}


def _pages(kind: str, data: bytes, engines: Engines) -> list[dict]:
    document = Document(kind, data, engines)
    n, error = document.count()
    if n is None:
        return [dict.fromkeys(("width", "height", "page_height", "items")) | {"page": 1, "category": RENDER, "error": error}]
    return [_page(document, page) for page in range(1, n + 1)]


def _lacking(kind: str, engines: Engines) -> str | None:
    need = ("reader", "decoder") if kind == "image" else ("renderer", "reader")
    gone = [n for n in need if getattr(engines, n) is None]
    return f"no {' and no '.join(gone)}" if gone else None


def _file(path: str, engines: Engines, look: bool) -> dict:
    """The row of one file."""
    row: dict = {"path": path}
    try:
        file = engines.opener(path)
    except FileNotFoundError:
        return row | {"category": MISSING, "error": "no such file"}
    except OSError as e:
        return row | {"category": UNREADABLE, "error": str(e)}
    with file:
        try:
            kind = row["kind"] = kind_of(path, file.read(8))
            file.seek(0)
            if kind is None:
                return row | {"category": UNSUPPORTED, "error": "neither DICOM nor a document nor an image"}
            lacking = _lacking(kind, engines)
            if kind == "dcm":
                pages = look and lacking is None
                try:
                    row |= dicom.file_values(dicom.Window(file), (*dicom.TAGS, "sr", "blob", *(["pdf"] if pages else ())))
                except dicom.FAULTS as e:
                    return row | {"category": DICOM, "error": str(e) or type(e).__name__}
                pdf = row.pop("pdf", None)
                return row | {"pages": _pages("pdf", pdf, engines) if pdf else None}
            if lacking or not look:
                return row | {"category": NO_ENGINE, "error": lacking or "no layouts of pages"}
            return row | {"pages": _pages(kind, file.read(), engines)}
        except OSError as e:
            return row | {"category": UNREADABLE, "error": str(e)}


def decode(paths: DataFrame, engines: Engines, look: bool = True, size: int = 0) -> DataFrame:
    """A row per path: kind, metadata tags, report items and record of a DICOM file, and for all kinds the pages with their text items.

    Pages are looked at where `look` and the engines allow; a DICOM file without
    still gives the rest, other files can then not be read. `category` and
    `error` say why a file, or one of its pages, gave nothing. `size`: bytes of
    all files, by which they are spread over tasks.
    """
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            for path in b["path"]:  # one at a time, as pages may hold many items
                yield pd.DataFrame([dict.fromkeys(columns) | _file(path, engines, look)], columns=columns)

    return spread(paths.select("path"), size).mapInPandas(run, SCHEMA)


def pages_of(decoded: DataFrame) -> DataFrame:
    """A row per page: page_id, path, kind, page, width, height, page_height, category, error."""
    flat = decoded.where("pages is not null").select("path", "kind", F.explode("pages").alias("p"))
    return flat.select(page_id(F.col("path"), F.col("p.page")).alias("page_id"), "path", "kind", *[f"p.{n}" for n in ("page", "width", "height", "page_height", "category", "error")])


def items_of_pages(decoded: DataFrame) -> DataFrame:
    """The text items of all pages, as plans.pages takes them."""
    flat = decoded.where("pages is not null").select("path", F.explode("pages").alias("p")).where("p.items is not null")
    return flat.select(page_id(F.col("path"), F.col("p.page")).alias("page_id"), F.explode("p.items").alias("i"), F.col("p.page_height").alias("page_height")).select("page_id", "i.*", "page_height")


def page_id(path: Column, page: Column) -> Column:
    return F.concat(path, F.lit("#"), page.cast("string"))


def rejects(decoded: DataFrame) -> DataFrame:
    """Files and pages that gave nothing, with the reason."""
    whole = decoded.where("category is not null").select("category", F.col("path").alias("file"), F.col("error").alias("detail"))
    pages = pages_of(decoded).where("category is not null").select("category", F.col("page_id").alias("file"), F.col("error").alias("detail"))
    return whole.union(pages)


def look_again(asked: DataFrame, pages: DataFrame, engines: Engines, each: Callable[[np.ndarray, dict], list[tuple]], schema: str) -> DataFrame:
    """Rows that `each` makes of a page's pixels and of what is asked of it.

    asked has page_id, pages page_id, path, kind and page. What is asked of a
    file travels to one task, which opens it once and renders only the pages
    asked for. A page that can't be rendered any more gives nothing. schema
    names page_id and what `each` makes, of the types in ARROW.
    """
    what = [c for c in asked.columns if c != "page_id"]
    fields = [(n, ARROW[kind]) for n, kind in (f.split() for f in schema.split(", "))]
    by_page = asked.groupBy("page_id").agg(F.collect_list(F.struct(*what)).alias("asked"))
    by_file = by_page.join(pages.select("page_id", "path", "kind", "page"), "page_id").groupBy("path", "kind").agg(F.collect_list(F.struct("page_id", "page", "asked")).alias("pages"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for file_ in batch.to_pylist():
                with engines.opener(file_["path"]) as file:
                    data = dicom.file_values(dicom.Window(file), ("pdf",))["pdf"] if file_["kind"] == "dcm" else file.read()
                document = Document("image" if file_["kind"] == "image" else "pdf", data, engines)
                for page in file_["pages"]:
                    made, _ = document.pixels(page["page"])
                    rows = [(page["page_id"], *r) for ask in page["asked"] for r in each(made[0], ask)] if made else []
                    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    return spread(by_file).mapInArrow(run, schema)


def read_crops(requests: DataFrame, pages: DataFrame, engines: Engines) -> DataFrame:
    """(page_id, field, kind, ord, text, confidence): what the reader sees in the regions of plans.pages.crop_requests().

    A region is cleaned first; of a missing field whose cleaned region shows no
    number, the region as it is. One that would leave the page is not read.
    """
    def each(pixels: np.ndarray, ask: dict) -> list[tuple]:
        crop = images.region(pixels, int(ask["x"]), int(ask["y"]), int(ask["half_w"]), int(ask["half_h"]))
        if crop is None:
            return []
        for ready in (images.clean_crop, np.ascontiguousarray)[: 2 if ask["kind"] == "missing" else 1]:
            found, _ = tried_twice(engines.reader, lambda e, part=ready(crop): items_of(e.read(part), "", None))
            if found and any(LIKE_A_NUMBER.match(i[2]) for i in found):
                break
        return [(ask["field"], ask["kind"], *i[1:4]) for i in found or ()]

    return look_again(requests.select("page_id", "field", "kind", "x", "y", "half_w", "half_h"), pages, engines, each, "page_id string, field string, kind string, ord int, text string, confidence float")
