"""Engines that turn pages into images and images into text items. They are plugged in; none but a plain image decoder ships with the package.

A renderer has page_count(pdf) and render(pdf, page, dpi) -> RGB array; a reader
has read(image) -> [(text, confidence, polygon)]; a decoder has decode(bytes) ->
RGB array of an image file. Each is built once a Python worker by a factory, and
retried once with a fresh engine after a failure.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import Any, NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keratoline.functions.numbers import extract_numeric
from keratoline.sources.files import open_file
from keratoline.sources.images import Decoder

DPI = 300
_built: dict = {}


class Engines(NamedTuple):
    """Factories of engines, and what opens a path. Pages are read only with a reader, those of documents only with a renderer too."""

    renderer: Callable | None = None
    reader: Callable | None = None
    decoder: Callable | None = Decoder
    opener: Callable = open_file


def named(module: str) -> Engines:
    """The engines of a module: its `renderer`, `reader`, `decoder` and `opener`, as far as it has them."""
    found = importlib.import_module(module)
    return Engines(**{n: getattr(found, n) for n in Engines._fields if hasattr(found, n)})


def once(factory: Callable):
    """The factory's engine, built once a worker."""
    if factory not in _built:
        _built[factory] = factory()
    return _built[factory]


def tried_twice(factory: Callable, work: Callable[[Any], Any]) -> tuple[Any, str | None]:
    """(what work makes with the factory's engine, None), the second time with a fresh engine; (None, error) if both fail."""
    for last in (False, True):
        try:
            return work(once(factory)), None
        except Exception as e:  # noqa: BLE001  engines raise what they like
            _built.pop(factory, None)
            if last:
                return None, str(e) or type(e).__name__
    raise AssertionError


def items_of(text_regions: list, page_id: str, height: int | None) -> list[tuple]:
    """Items of one page: centre is the mean of a region's corners, the box their extent."""
    rows = []
    for i, (text, confidence, polygon) in enumerate(text_regions):
        p = np.asarray(polygon, np.float32)
        rows.append((page_id, i, str(text).strip(), float(confidence), *map(float, p.mean(0)), *map(float, p.min(0)), *map(float, p.max(0)), height))
    return rows


def best_reading(items: DataFrame, by: list[str], power: int = 1) -> DataFrame:
    """The most credible number of each crop: confidence times length (at least 3 bytes), among texts that start like a number."""
    bare = F.regexp_replace(F.trim("text"), r"^[(\[]+", "")
    value = extract_numeric(F.col("text"))
    score = F.col("confidence").cast("double") * F.pow(F.greatest(F.octet_length(bare), F.lit(3)), F.lit(power))
    fit = items.where(bare.rlike(r"^[0-9+-]") & ~F.endswith(bare, F.lit(":"))).withColumn("value", value).where("value is not null")
    return fit.groupBy(*by).agg(F.max_by(F.struct("value", F.col("confidence").alias("conf"), "text"), F.struct(score, -F.col("ord"))).alias("b")).select(*by, "b.*")
