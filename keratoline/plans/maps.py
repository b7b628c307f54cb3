"""Where the colour maps are on a page: boxes from anchor texts, with edges found in the pixels of single rows.

Two passes: anchors() finds the anchor texts of every page in one aggregation and
says which pixel rows to scan; regions() turns anchors and scanned edges into
boxes. Pixels are touched only by scan_edges().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keratoline.functions.dates import trimmed
from keratoline.sources.images import ink_span

# Anchor texts, and how far from the edges boxes stand (pixels at the reading resolution).
ANCHORS = {
    "curv": r"(?i)(Axial|Sagittal|Tangential)\s*Curvature.*Front", "elev_f": r"(?i)Elevation.*Front", "thick": r"(?i)Corneal\s*Thickness", "elev_b": r"(?i)Elevation.*Back", "curv_word": r"(?i)^Curvature\z",
    "ef": r"(?i)^Elevation\s*[(\[]?\s*Front\s*[)\]]?", "eb": r"(?i)^Elevation\s*[(\[]?\s*Back\s*[)\]]?", "fixed": r"(?i)^Fixed\z", "ref": r"(?i)^Reference\s*Database",
    "mean": r"(?i)Mean corneal", "pachy": r"(?i)^Pachy\.?\z", "abs": r"(?i)^Abs\.?\z", "ctsp": r"(?i)Corneal Thickness Spatial Profile|\bCTSP\b", "pti": r"(?i)Percentage Thickness Increase|\bPTI\b",
    "corneal": r"(?i)^Corneal\z", "thickness": r"(?i)^Thickness\z", "diameter": r"(?i)^Diameter\z",
}
FOOTER, AXIS_MARK = r"(?i)Oculus|Münch|Arlington", r"(?i)^\d{2,3}\z|^[µμu]m\z|^%\z"
LEFT_PAD, RIGHT_PAD = 5, 15


def map_set(kind: Column) -> Column:
    """`maps` for refractive pages but those of the old layout, `belin` for the ectasia page, else null."""
    k = F.lower(kind)
    has = lambda w: F.contains(k, F.lit(w))
    return F.when(has("refractive") & ~has("old layout"), "maps").when(has("belin") & (has("ectasia") | has("ambrosio")), "belin")


def anchors(items: DataFrame, pages: DataFrame) -> DataFrame:
    """A row per page of pages (page_id, printout_type, width, height): its map set and the first place of each anchor."""
    sized = pages.select("page_id", map_set(F.col("printout_type")).alias("set"), F.col("width").alias("w"), F.col("height").alias("h")).where("set is not null")
    t = trimmed(F.col("text"))
    rows = items.select("page_id", "ord", t.alias("t"), F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy")).join(sized, "page_id")
    cx, cy, w, h = F.col("cx"), F.col("cy"), F.col("w"), F.col("h")
    where = {
        **dict.fromkeys(("curv", "elev_f", "thick", "elev_b", "curv_word"), cy <= 0.7 * h), "ef": cy <= 0.25 * h, "eb": cy <= 0.25 * h, "fixed": cy > 0.7 * h, "ref": cy > 0.85 * h,
        "mean": cy <= 0.55 * h, "pachy": cx > 0.8 * w, "abs": cx > 0.8 * w, "ctsp": cy <= 0.6 * h, "pti": cy <= 0.8 * h, "corneal": (cx > 0.6 * w) & (cy < 0.25 * h),
    }
    first = lambda rule: F.min_by(F.struct("cx", "cy"), F.when(rule, F.col("ord")))
    aggs = [first(F.col("t").rlike(p) & where.get(n, F.lit(True))).alias(n) for n, p in ANCHORS.items() if n not in ("thickness", "diameter")]
    aggs.append(first(F.col("t").rlike(ANCHORS["thick"]) & (cx > 0.6 * w) & (cy < 0.25 * h)).alias("ct"))
    mark = F.struct("ord", "t", "cx", "cy")
    some = F.col("t").rlike("|".join(f"(?:{p})" for p in (ANCHORS["thickness"], ANCHORS["diameter"], FOOTER, AXIS_MARK)))
    aggs.append(F.array_sort(F.collect_list(F.when(some, mark))).alias("marks"))
    out = rows.groupBy("page_id", "set", "w", "h").agg(*aggs)
    of = lambda pattern, rule: F.filter("marks", lambda m: m["t"].rlike(pattern) & rule(m))
    split = F.get(of(ANCHORS["thickness"], lambda m: (F.abs(m["cy"] - F.col("corneal.cy")) < 15) & (F.abs(m["cx"] - F.col("corneal.cx")) < 300)), F.lit(0))
    joined = F.when(F.col("corneal").isNotNull() & split.isNotNull(), F.struct(((F.col("corneal.cx") + split["cx"]) / 2).alias("cx"), F.col("corneal.cy").alias("cy")))
    footer = lambda after: F.array_min(F.transform(of(FOOTER, lambda m: m["cy"] > after), lambda m: m["cy"]))
    panel = F.col("pti.cy") - F.col("ctsp.cy")
    axis = of(AXIS_MARK, lambda m: (m["cy"] > F.col("ctsp.cy")) & (m["cy"] < F.col("ctsp.cy") + panel) & (m["cx"] < F.col("ctsp.cx")) & (m["cx"] > F.col("ctsp.cx") - 400))
    width = F.get(of(ANCHORS["diameter"], lambda m: (F.abs(m["cy"] - F.col("ctsp.cy")) < 20) | (F.abs(m["cy"] - F.col("pti.cy")) < 20)), F.lit(0))
    return out.select(
        "*", F.coalesce("ct", joined).alias("head"), footer(F.col("fixed.cy")).alias("foot_fixed"), footer(F.col("pti.cy")).alias("foot_pti"),
        F.array_min(F.transform(axis, lambda m: m["cx"])).alias("axis_cx"), width["cx"].alias("diameter_cx"),
    ).withColumns({
        "top_cy": F.least("curv.cy", "elev_f.cy"), "low_cy": F.least("thick.cy", "elev_b.cy"), "first_cy": F.coalesce("ef.cy", "eb.cy"),
    }).drop("marks")


def _grid() -> tuple[Column, Column, Column]:
    top = F.coalesce("top_cy", F.lit(3.4028234663852886e38))
    low = F.coalesce("low_cy", top + F.col("h") * 0.4)
    return top, low, low - top


def _thickness_rows() -> tuple[Column, Column]:
    top = F.floor(F.greatest(F.lit(0.0), F.coalesce("head.cy", "first_cy") - 25))
    low = F.floor(F.coalesce(F.least(F.col("abs.cy") + 40, F.col("h") - 10), F.least(F.col("pachy.cy") + 100, F.col("h") - 10), F.col("first_cy") + 830))
    return top, low


def scan_rows(found: DataFrame) -> DataFrame:
    """(page_id, scan, row, start, stop): the pixel rows whose ink gives an edge."""
    top, _, gap = _grid()
    t0, t1 = _thickness_rows()
    w = F.col("w")
    request = lambda rule, name, row, a, b: F.when(rule, F.struct(F.lit(name).alias("scan"), row.cast("bigint").alias("row"), a.cast("int").alias("start"), b.cast("int").alias("stop")))
    maps, belin = F.col("set") == "maps", (F.col("set") == "belin") & F.col("first_cy").isNotNull()
    rows = F.array(
        request(maps & F.col("top_cy").isNotNull(), "maps_right", F.floor(top + gap * 0.4), F.floor(w / 2), w),
        request(belin, "belin_left", F.floor(F.col("first_cy") + 300), F.lit(0), F.floor(w / 2)),
        request(belin, "thick_right", F.floor((t0 + t1) / 2), F.floor(w / 2), w),
    )
    out = found.select("page_id", "h", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("page_id", "h", "r.*")
    return out.where((F.col("row") >= 0) & (F.col("row") < F.col("h"))).drop("h")


def ink_of(pixels: np.ndarray, ask: dict) -> list[tuple]:
    """(scan, first, last) of one requested row, if there is ink in it."""
    span = ink_span(pixels, int(ask["row"]), int(ask["start"]), int(ask["stop"]))
    return [(ask["scan"], *span)] if span else []


EDGES = "page_id string, scan string, first int, last int"  # what decode.look_again() makes by ink_of()


def scan_edges(requests: DataFrame, images: DataFrame) -> DataFrame:
    """(page_id, scan, first, last): first and last ink in each requested row; images has page_id and image (height, width, RGB data).

    A page's requests go together, so its image moves once.
    """
    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            rows = []
            for page, asked, im in zip(b["page_id"], b["asked"], b["image"], strict=True):
                pixels = np.frombuffer(im["data"], np.uint8).reshape(im["height"], im["width"], 3)
                rows += [(page, *found) for r in asked for found in ink_of(pixels, r)]
            yield pd.DataFrame(rows, columns=["page_id", "scan", "first", "last"])

    kind = requests.schema["page_id"].dataType.simpleString()
    asked = requests.groupBy("page_id").agg(F.collect_list(F.struct("scan", "row", "start", "stop")).alias("asked"))
    return asked.join(images.select("page_id", "image"), "page_id").mapInPandas(run, f"page_id {kind}, scan string, first int, last int")


def regions(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(page_id, name, x, y, width, height) of the map boxes; an edge without ink is the page's."""
    at = lambda scan, c: F.max(F.when(F.col("scan") == scan, F.col(c)))
    seen = edges.groupBy("page_id").agg(at("maps_right", "last").alias("m_last"), at("belin_left", "first").alias("l_first"), at("thick_right", "last").alias("t_last"))
    d = found.join(seen, "page_id", "left")
    w, h, zero = F.col("w"), F.col("h"), F.lit(0.0)
    whole = lambda c: F.floor(F.greatest(zero, c)).cast("int")
    box = lambda rule, name, x0, y0, x1, y1: F.when(rule, F.struct(F.lit(name).alias("name"), whole(x0).alias("x"), whole(y0).alias("y"), (whole(x1) - whole(x0)).alias("width"), (whole(y1) - whole(y0)).alias("height")))
    right = lambda c: F.coalesce(F.least(F.col(c) + RIGHT_PAD, w), w)

    top, low, gap = _grid()
    left = F.coalesce(F.col("curv_word.cx") - 90, F.least("curv.cx", "elev_f.cx", "thick.cx", "elev_b.cx") - 680)
    maps = box((F.col("set") == "maps") & F.coalesce("top_cy", "low_cy").isNotNull(), "4mr_all", left, top - 15, right("m_last"), F.least(low + gap - 30, h - 10))

    belin = (F.col("set") == "belin") & F.col("first_cy").isNotNull()
    l_left = F.coalesce(F.greatest(F.col("l_first") - LEFT_PAD, F.lit(0)), F.lit(0))
    l_right = F.coalesce(F.col("eb.cx") + (F.col("eb.cx") - F.col("ef.cx")) / 2, F.col("eb.cx") + 400, F.col("ef.cx") + 1200, w * 0.52)
    fixed = F.least(F.col("fixed.cy") + 70, h - 10)
    l_low = F.coalesce(F.when(F.col("fixed").isNotNull(), F.least(fixed, F.coalesce(F.col("foot_fixed") - 10, fixed))), F.least(h * 0.96, h - 10))
    elevation = box(belin, "belin_left", l_left, F.col("first_cy") - 25, l_right, l_low)

    t_top, t_low = _thickness_rows()
    t_right = right("t_last")
    half = (t_right - F.col("head.cx")) - 2 * (t_right - F.col("abs.cx"))
    t_left = F.greatest(zero, F.coalesce(F.col("head.cx") - half, 2 * F.col("head.cx") - t_right, F.col("pachy.cx") - 550, w * 0.7))
    thickness = box(belin, "belin_thickness", t_left, t_top, t_right, t_low)

    both = F.col("ctsp").isNotNull() & F.col("pti").isNotNull()
    panel = F.col("pti.cy") - F.col("ctsp.cy")
    c_top = F.when(both, F.coalesce(F.when(F.col("mean.cy") < F.col("ctsp.cy"), F.col("mean.cy") - 10), F.col("ctsp.cy") - 15)).otherwise(t_low + 10)
    base = F.coalesce(F.least(F.col("ref.cy") + 60, h - 10), F.least(F.col("pti.cy") + panel + 60, h - 10))
    c_low = F.when(both, F.least(base, F.coalesce(F.col("foot_pti") - 10, base))).otherwise(F.coalesce(F.least(F.col("ref.cy") + 60, h - 10), h * 0.95))
    c_left = F.when(both, F.coalesce(F.col("axis_cx") - 60, F.least("ctsp.cx", "pti.cx") - 400)).otherwise(t_left)
    c_right = F.when(both, F.coalesce(F.least(F.col("diameter_cx") + 80, w), t_right)).otherwise(t_right)
    charts = box(belin, "belin_charts", c_left, c_top, c_right, c_low)

    out = d.select("page_id", F.explode(F.filter(F.array(maps, elevation, thickness, charts), lambda b: b.isNotNull())).alias("b")).select("page_id", "b.*")
    return out.where((F.col("width") > 0) & (F.col("height") > 0))
