"""DICOM files: a parser of the public file format (PS3.5, PS3.10), and frames of what is in them.

Reads explicit and implicit little-endian transfer syntaxes, sequences of known
and unknown length, and skips pixel fragments and all that is not asked for. Only
this step needs Python; it runs once a file and all else works on its columns.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from keratoline.functions.dates import blank_to_null, laterality
from keratoline.sources.files import file_system, open_file
from keratoline.sources.records import SIZE

LONG = {b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"}  # value representations with 32-bit lengths
UNKNOWN = 0xFFFFFFFF
# Tags of the metadata, the report tree, the embedded document and the private record.
TAGS = {
    "patient_id": 0x00100020, "patient_name": 0x00100010, "date_of_birth": 0x00100030, "sex": 0x00100040,
    "content_date": 0x00080023, "study_date": 0x00080020, "content_time": 0x00080033, "study_time": 0x00080030,
    "image_laterality": 0x00200062, "laterality": 0x00200060, "series_number": 0x00200011, "instance_number": 0x00200013,
    "software_version": 0x00181020, "device_serial": 0x00181000,
}
CONTENT, VALUE_TYPE, CONCEPT, CODE, MEASURED, NUMERIC = 0x0040A730, 0x0040A040, 0x0040A043, 0x00080100, 0x0040A300, 0x0040A30A
DOCUMENT, RECORD = 0x00420011, 0x00291010
SYNTAX, IMPLICIT = 0x00020010, "1.2.840.10008.1.2"
ITEM, ITEM_END, SEQUENCE_END = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
NUMBER = re.compile(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\Z")


class Window:
    """A file's bytes by slices. It is read in blocks as slices are asked for; what is stepped over is not read."""

    def __init__(self, file, block: int = 1 << 16):
        self.file, self.block, self.at, self.held, self.read = file, block, 0, b"", 0
        self.size = file.seek(0, 2)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        if start < self.at or stop > self.at + len(self.held):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(max(stop - start, self.block))
            self.read += len(self.held)
        return self.held[start - self.at : max(start, stop) - self.at]


def _number(data, at: int, size: int) -> int:
    found = data[at : at + size]
    if len(found) < size:
        raise ValueError("an element's head is cut off")
    return int.from_bytes(found, "little")


def _element(data, at: int, implicit: bool) -> tuple[int, bytes, int, int]:
    tag = _number(data, at, 2) << 16 | _number(data, at + 2, 2)
    if tag >> 16 == 0xFFFE or implicit:
        return tag, b"", _number(data, at + 4, 4), at + 8
    vr = data[at + 4 : at + 6]
    if vr in LONG:
        return tag, vr, _number(data, at + 8, 4), at + 12
    return tag, vr, _number(data, at + 6, 2), at + 8


def _dataset(data, at: int, end: int, implicit: bool, wanted: frozenset[int] | None = None) -> tuple[dict, int]:
    """({tag: bytes, or list of datasets}, where it ends); values of tags that are not wanted are stepped over."""
    out: dict = {}
    while at + 8 <= end:
        tag, vr, size, body = _element(data, at, implicit)
        if tag in (ITEM_END, SEQUENCE_END):
            return out, body
        skip = wanted is not None and tag not in wanted
        if skip and size != UNKNOWN:
            if body + size > end:
                raise ValueError("an element runs past the end")
            at = body + size
            continue
        if size == UNKNOWN or vr == b"SQ" or (implicit and data[body : body + 4] == b"\xfe\xff\x00\xe0" and size):
            value, at = _sequence(data, body, end if size == UNKNOWN else body + size, implicit)
        else:
            if body + size > end:
                raise ValueError("an element runs past the end")
            value, at = data[body : body + size], body + size
        if not skip:
            out.setdefault(tag, value)
    return out, at


def _sequence(data, at: int, end: int, implicit: bool) -> tuple[list, int]:
    items: list = []
    while at + 8 <= end:
        tag, _, size, body = _element(data, at, implicit)
        if tag == SEQUENCE_END:
            return items, body
        if tag != ITEM:
            raise ValueError("a sequence holds something other than items")
        if size == UNKNOWN:
            item, at = _dataset(data, body, end, implicit)
        else:
            item, _ = _dataset(data, body, body + size, implicit)
            at = body + size
        items.append(item)
    return items, at


def parse(data, wanted: frozenset[int] | None = None) -> dict:
    """The dataset of a DICOM file (bytes or a Window), or of it the wanted tags. ValueError if it is none."""
    at, implicit = 0, True
    if data[128:132] == b"DICM":
        at, meta = 132, {}
        while at + 8 <= len(data) and data[at : at + 2] == b"\x02\x00":
            tag, _, size, body = _element(data, at, False)
            meta[tag], at = data[body : body + size], body + size
        implicit = _text(meta.get(SYNTAX, b"")) == IMPLICIT
    elif len(data) < 8 or data[:2] not in (b"\x08\x00", b"\x02\x00"):
        raise ValueError("not a DICOM file")
    return _dataset(data, at, len(data), implicit, wanted)[0]


def _text(value) -> str:
    return value.decode("utf-8", "replace").strip("\0 \t\r\n") if isinstance(value, bytes) else ""


def report_values(data: dict) -> Iterator[tuple[int, str, str, str]]:
    """(depth, value type, code, value) of the report tree's items, depth first."""

    def walk(items, depth: int):
        for item in items if isinstance(items, list) else ():
            kind = _text(item.get(VALUE_TYPE))
            concept, measured = item.get(CONCEPT), item.get(MEASURED)
            code = _text(concept[0].get(CODE)) if isinstance(concept, list) and concept else ""
            value = _text(measured[0].get(NUMERIC)) if isinstance(measured, list) and measured else ""
            yield depth, kind, code, value.split("\\")[0].strip()
            yield from walk(item.get(CONTENT), depth + 1)

    yield from walk(data.get(CONTENT), 1)


REPORT = "array<struct<seq:int,depth:int,value_type:string,code:string,value:string>>"
SCHEMA = "path string, error string, " + ", ".join(f"{t} string" for t in TAGS) + f", sr {REPORT}, pdf binary, blob binary"
FAULTS = (ValueError, struct.error, RecursionError)


def wanted_tags(columns) -> frozenset[int]:
    """The tags from which these columns of SCHEMA come."""
    own = TAGS | {"sr": CONTENT, "pdf": DOCUMENT, "blob": RECORD}
    return frozenset(own[c] for c in columns if c in own)


def file_values(data, columns) -> dict:
    """The columns of SCHEMA that are asked for, of one file; one of FAULTS if it can't be read."""
    found = parse(data, wanted_tags(columns))
    row = {t: _text(found[TAGS[t]]) if TAGS[t] in found else None for t in TAGS if t in columns}
    if "sr" in columns:
        row["sr"] = [dict(zip(("seq", "depth", "value_type", "code", "value"), (i, *x), strict=True)) for i, x in enumerate(report_values(found))]
    if "pdf" in columns:
        row["pdf"] = found.get(DOCUMENT) if isinstance(found.get(DOCUMENT), bytes) else None
    if "blob" in columns:
        blob = found.get(RECORD)
        row["blob"] = blob[:SIZE] if isinstance(blob, bytes) and len(blob) >= SIZE else None
    return row


def read(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row per file with its metadata tags, report items, embedded document and private record; `error` if it can't be read."""
    columns = ["path", "error", *TAGS, "sr", "pdf", "blob"]

    def run(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch[path], batch[content], strict=True):
                row = dict.fromkeys(columns) | {"path": name}
                try:
                    row |= file_values(bytes(data), columns)
                except FAULTS as e:
                    row["error"] = str(e) or type(e).__name__
                rows.append(row)
            yield pd.DataFrame(rows, columns=columns)

    return files.select(path, content).mapInPandas(run, SCHEMA)


class Files(InputPartition):
    """The files that one task reads."""

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class DicomReader(DataSourceReader):
    """Lists a folder and deals its files out by size; reads of each file what the schema asks for."""

    def __init__(self, options: dict, schema: T.StructType):
        self.root, self.pattern = options["path"], options.get("pathglobfilter", "*.dcm")
        self.most, self.columns = int(options.get("partitionbytes", 128 << 20)), schema.names
        unknown = set(self.columns) - {"path", "length", "error", *TAGS, "sr", "pdf", "blob"}
        if unknown:
            raise ValueError(f"a DICOM file has no {', '.join(sorted(unknown))}")

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, at = file_system(self.root)
        scheme = re.match(r"[a-z0-9+.-]+://", self.root)
        found = [i for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File and fnmatch(i.base_name, self.pattern)]
        out, held, size = [], [], 0
        for info in sorted(found, key=lambda i: i.path):
            held.append((scheme[0] if scheme else "") + info.path)
            size += info.size + (1 << 20)  # opening a file takes about as long as reading so much
            if size >= self.most:
                out.append(Files(held))
                held, size = [], 0
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files):
        for path in partition.paths:
            row = dict.fromkeys(self.columns) | {"path": path}
            with open_file(path) as file:
                window = Window(file)
                row["length"] = len(window)
                try:
                    row |= file_values(window, self.columns)
                except FAULTS as e:
                    row["error"] = str(e) or type(e).__name__
            yield tuple([{**x} for x in v] if n == "sr" and (v := row[n]) else row[n] for n in self.columns)


class Dicom(DataSource):
    """spark.read.format("dicom").load(folder), once registered by spark.dataSource.register(Dicom).

    A row a file, as read() gives it, with its length. Columns are chosen by
    .schema(...): what is left out is stepped over in the file, so metadata of
    files costs no reading of documents, records and pixels. Options:
    pathGlobFilter (*.dcm), partitionBytes (128 MB).
    """

    @classmethod
    def name(cls) -> str:
        return "dicom"

    def schema(self) -> str:
        return SCHEMA.replace("path string", "path string, length long", 1)

    def reader(self, schema: T.StructType) -> DicomReader:
        return DicomReader(self.options, schema)


def metadata(decoded: DataFrame) -> DataFrame:
    """Trimmed metadata: content date and time before those of the study, the image's side before the series'."""
    c = lambda n: blank_to_null(F.col(n))
    return decoded.where("error is null").select(
        "path", c("patient_id").alias("patient_id"), c("patient_name").alias("patient_name"), c("date_of_birth").alias("date_of_birth"), c("sex").alias("sex"),
        F.coalesce(c("content_date"), c("study_date")).alias("exam_date"), F.coalesce(c("content_time"), c("study_time")).alias("exam_time"),
        F.coalesce(laterality(F.col("image_laterality")), laterality(F.col("laterality"))).alias("eye"),
        *[c(n).alias(n) for n in ("series_number", "instance_number", "software_version", "device_serial")],
    )


def report_codes(decoded: DataFrame) -> DataFrame:
    """path, code, value of numeric report items; of a repeated code the last."""
    items = decoded.where("error is null").select("path", F.explode("sr").alias("i")).select("path", "i.*")
    items = items.where((F.col("value_type") == "NUM") & (F.col("code") != "") & F.col("value").rlike(NUMBER.pattern.replace(r"\Z", r"\z").replace("[-+]?(", "^[-+]?(", 1)))
    return items.groupBy("path", F.concat(F.lit("DICOM_"), "code").alias("code")).agg(F.max_by(F.col("value").try_cast("double"), F.col("seq")).alias("value"))


def rejects(decoded: DataFrame) -> DataFrame:
    return decoded.where("error is not null").select(F.lit("DICOM_ERROR").alias("category"), F.col("path").alias("file"), F.col("error").alias("detail"))
