"""From the text items of printed pages to located measurements.

Items are (page_id, ord, text, confidence, cx, cy, ..., page_height), layouts
are (layout, field, cy_ref, cx_ref) and are input data: positions of the fields
on a reference page. Everything is keyed by page, so a page's items meet in one
partition and nothing else is shuffled.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keratoline import dims
from keratoline.functions.dates import eye_phrase, header_date, header_time, trimmed
from keratoline.functions.numbers import extract_numeric, quality_code, repair, signed_number
from keratoline.materialize import settled
from keratoline.operators.filters import classify, mutually_exclusive, qa_status, within_ranges
from keratoline.operators.joins import band_join, small, union_first
from keratoline.operators.ranking import cluster_mode, first_by, first_claim, reading_order
from keratoline.operators.regress import affine_fit

LOCATED = ["page_id", "field", "value", "conf", "cx", "cy", "raw_text"]
GEN1 = 'Other("Refractive (gen1)")'
TOPO, BELIN = "TopometricKcStaging", "BelinAmbrosio"
# Names of the layouts, and page heights (after upscaling) that tell them.
MAPS, TALL, GEN1_930, GEN1_992, TOPO_LAYOUT, BELIN_LAYOUT = "4MAPS", "4MAPS_TALL", "GEN1_930", "GEN1_992", "TOPO", "BELIN"
TALL_HEIGHTS, GEN1_930_HEIGHTS, GEN1_992_HEIGHTS = (2620, 2650), (2530, 2560), (2700, 2730)


def layout_frame(spark: SparkSession, source: str | list[tuple]) -> DataFrame:
    """Layouts from rows of (layout, field, cy_ref, cx_ref) or a CSV file with that header."""
    ddl = "layout string, field string, cy_ref double, cx_ref double"
    return spark.createDataFrame(source, ddl) if isinstance(source, list) else spark.read.csv(source, schema=ddl, header=True)


def page_rules(text: Column, title: Column) -> list[tuple[Column, str]]:
    """Words that tell the page types, in order."""
    has = lambda *words: [F.contains(text, F.lit(w)) for w in words]
    titled = F.contains(title, F.lit("REFRACTIVE"))
    both = lambda *words: has(*words)[0] & has(*words)[1]
    one = lambda word: has(word)[0]
    return [
        (both("CATARACT", "PRE"), 'Other("Cataract Pre-OP")'), (both("4 MAPS", "REFRACTIVE"), "FourMapsRefractive"),
        (titled & one("CTSP"), 'Other("Refractive (old layout)")'), (titled & both("SAGITTAL", "ELEVATION"), GEN1),
        (one("SELECTABLE"), "FourMapsSelectable"), (one("TOPOMETRIC") | one("KC-STAGING") | one("KC STAGING"), TOPO),
        (both("BELIN", "ECTASIA"), BELIN), (both("BELIN", "ABCD"), "BelinAbcdProgression"), (one("FOURIER"), "Fourier"),
        (one("DENSITOMETRY"), "Densitometry"), (one("HOLLADAY"), "Holladay"), (both("COMPARE", "EXAM"), 'Other("Compare 4 Exams")'),
        (one("SCHEIMPFLUG"), 'Other("Scheimpflug Images")'), (one("OVERVIEW"), 'Other("General Overview")'),
    ]


def page_types(items: DataFrame) -> DataFrame:
    """page_id, printout_type (null if none fits) and height. The title is what stands in the top tenth of the page."""
    pages = items.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", F.upper("text").alias("t"), "cy"))).alias("all"), F.max("cy").alias("low"), F.max("page_height").alias("height")
    )
    limit = F.greatest(F.col("low"), F.lit(0.0).cast("float")) * F.lit(0.1).cast("float")
    words = lambda c: F.array_join(F.transform(c, lambda x: x["t"]), " ")
    told = pages.select("page_id", "height", words(F.col("all")).alias("text"), words(F.filter("all", lambda x: x["cy"] < limit)).alias("title"))
    return told.select("page_id", classify(page_rules(F.col("text"), F.col("title"))).alias("printout_type"), "height")


def is_tall(height: Column) -> Column:
    return F.coalesce(height.between(*TALL_HEIGHTS), F.lit(False))


def layout_of(kind: Column, height: Column, tall: Column) -> Column:
    return (
        F.when(kind == TOPO, F.lit(TOPO_LAYOUT)).when(kind == BELIN, F.lit(BELIN_LAYOUT))
        .when(kind == GEN1, F.when(height.between(*GEN1_992_HEIGHTS), F.lit(GEN1_992)).otherwise(F.lit(GEN1_930)))
        .otherwise(F.when(tall, F.lit(TALL)).otherwise(F.lit(MAPS)))
    )


def zones(reading: DataFrame, pages: DataFrame) -> DataFrame:
    """front_lo, front_hi, back_lo, back_hi of each page: defaults by layout, moved by the section headers found."""
    t = F.lower("text")
    low = F.col("cy") > 400
    front = F.contains(t, F.lit("cornea front")) & low
    back = F.contains(t, F.lit("cornea back")) & low & ~front
    power = F.contains(t, F.lit("true net power")) & low & ~front & ~back
    last = lambda c, name: F.max_by("cy", F.when(c, F.col("reading"))).alias(name)
    heads = reading.groupBy("page_id").agg(last(front, "fh"), last(back, "bh"), last(power, "ph"))
    tall = is_tall(F.col("height"))
    z = heads.join(pages.select("page_id", "height"), "page_id").select(
        "page_id", "fh", "bh", "ph",
        *[F.when(tall, F.lit(a)).otherwise(F.lit(b)).cast("float").alias(n) for n, a, b in (("f0", 860, 700), ("f1", 1350, 1180), ("b0", 1380, 1200), ("b1", 1900, 1720))],
    )
    moved = F.coalesce((F.col("bh") > F.col("fh")) & (F.col("bh") < F.col("b1")), F.lit(False))
    z = z.select(
        "page_id", "ph",
        F.when(moved, F.greatest(F.col("fh") - 100, F.lit(200.0).cast("float"))).otherwise(F.col("f0")).alias("front_lo"),
        F.when(moved, F.col("bh") - 5).otherwise(F.col("f1")).alias("front_hi"),
        F.when(moved, F.col("bh") + 5).otherwise(F.col("b0")).alias("back_lo"), F.col("b1").alias("back_hi"),
    )
    capped = F.coalesce((F.col("back_lo") < F.col("ph")) & (F.col("ph") < F.col("back_hi")), F.lit(False))
    return z.select("page_id", "front_lo", "front_hi", "back_lo", F.when(capped, F.col("ph") - 10).otherwise(F.col("back_hi")).alias("back_hi"))


def _label_key() -> Column:
    return trimmed(F.regexp_replace(F.lower("text"), r":+\z", ""))


def _matched_field() -> Column:
    """The field that an item's text labels in its zone: an equal label before a longer text that starts with one."""
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(z).alias("z"), F.lit(f).alias("f")) for t, z, f in dims.LABELS])
    key, cy = F.col("key"), F.col("cy")
    here = lambda x: (
        ((x["z"] == "front") & cy.between(F.col("front_lo"), F.col("front_hi")))
        | ((x["z"] == "back") & cy.between(F.col("back_lo"), F.col("back_hi"))) | ((x["z"] == "bottom") & cy.between(1500, 2700))
    )
    equal = F.filter(table, lambda x: (key == x["t"]) & here(x))
    longer = F.filter(table, lambda x: F.startswith(key, x["t"]) & here(x))
    return F.coalesce(F.get(equal, F.lit(0)), F.get(longer, F.lit(0)))["f"]


def _values(reading: DataFrame) -> DataFrame:
    return reading.select("page_id", F.col("reading").alias("v_reading"), F.col("text").alias("v_text"), F.col("confidence").alias("v_conf"), F.col("cx").alias("v_cx"), F.col("cy").alias("v_cy"))


def claim_labels(reading: DataFrame, zoned: DataFrame) -> DataFrame:
    """Values beside labels; for each field the first label in reading order that has one."""
    labels = reading.join(zoned, "page_id").withColumn("key", _label_key()).withColumn("field", _matched_field())
    labels = labels.where(F.col("field").isNotNull() & ~F.col("field").isin(dims.AMBIGUOUS)).select("page_id", "field", "reading", "cx", "cy")
    triple = F.col("field").isin(dims.TRIPLES)
    cap = F.when((F.col("cy") > 1490) & (F.col("cy") <= 2000) & F.col("field").isin(dims.BOTTOM_PANEL), 700).otherwise(1100)
    reach = F.col("v_cx") - F.col("cx")
    beside = (F.abs(F.col("v_cy") - F.col("cy")) < 25) & (reach > 0) & (reach < F.when(triple, 800).otherwise(500)) & (F.col("v_cx") < F.when(triple, 1100).otherwise(cap))
    pairs = band_join(labels, _values(reading), ["page_id"], "cy", "v_cy", 25, 25, beside)
    pairs = pairs.withColumn("value", extract_numeric(F.col("v_text"))).where("value is not null")
    row = pairs.groupBy("page_id", "field", "reading", cap.alias("cap"), triple.alias("triple")).agg(
        F.array_sort(F.collect_list(F.struct("v_cx", "v_reading", "value", "v_conf", "v_cy", "v_text"))).alias("vs")
    )
    main = F.array_position(F.transform("vs", lambda v: (v["v_cx"] < F.col("cap")) & ~(F.col("triple") & (v["value"] == 0))), F.lit(True))
    claimed = first_claim(row.withColumn("at", main).where("at > 0"), ["page_id", "field"], ["reading"])
    taken = F.slice("vs", F.col("at").cast("int"), F.when(F.col("triple"), 3).otherwise(1))
    out = claimed.select("page_id", "field", F.posexplode(taken).alias("i", "v"))
    name = F.concat("field", F.element_at(F.array(F.lit(""), F.lit("_x"), F.lit("_y")), F.col("i") + 1))
    return out.select("page_id", name.alias("field"), "v.value", F.col("v.v_conf").alias("conf"), F.col("v.v_cx").alias("cx"), F.col("v.v_cy").alias("cy"), F.col("v.v_text").alias("raw_text"))


def fit_pages(located: DataFrame, pages: DataFrame, layouts: DataFrame) -> DataFrame:
    """The affine fit of each page's located fields to its layout (pages has `layout`), the identity where nothing is located."""
    refs = pages.select("page_id", "layout").join(small(layouts), "layout")
    pairs = located.join(refs, ["page_id", "field"]).select("page_id", *[F.col(c).cast("double").alias(c) for c in ("cx", "cy", "cx_ref", "cy_ref")])
    fit = affine_fit(pairs, ["page_id"], "cy", "cy_ref", "cx", "cx_ref")
    out = pages.select("page_id", "layout").join(fit, "page_id", "left")
    return out.na.fill({"alpha": 1.0, "beta": 0.0, "alpha_x": 1.0, "beta_x": 0.0, "delta_x": 0.0, "resid_std": 0.0, "n_inliers": 0, "n_pairs": 0})


def predicted(fits: DataFrame, layouts: DataFrame) -> DataFrame:
    """Where each field of a page's layout should stand on the page."""
    return fits.join(small(layouts), "layout").select(
        "page_id", "field", (F.col("alpha_x") * F.col("cx_ref") + F.col("beta_x")).cast("float").alias("px"), (F.col("alpha") * F.col("cy_ref") + F.col("beta")).alias("py"), "n_inliers"
    )


def claim_ambiguous(reading: DataFrame, zoned: DataFrame, places: DataFrame, located: DataFrame) -> DataFrame:
    """Back-surface fields whose labels stand in two sections: the label nearest to where the field should be."""
    table = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(t).alias("t")) for f, t in dims.AMBIGUOUS_LABELS])
    key = F.col("key")
    labels = reading.join(zoned, "page_id").where((F.col("cx") <= 500) & F.col("cy").between(F.col("back_lo"), F.col("back_hi"))).withColumn("key", _label_key())
    hits = F.array_distinct(F.transform(F.filter(table, lambda x: F.startswith(key, x["t"])), lambda x: x["f"]))
    labels = labels.select("page_id", "reading", "cx", "cy", F.explode(hits).alias("field"))
    labels = labels.join(places.select("page_id", "field", "py"), ["page_id", "field"]).join(located.select("page_id", "field"), ["page_id", "field"], "left_anti")
    reach = F.col("v_cx") - F.col("cx")
    beside = (F.abs(F.col("v_cy") - F.col("cy")) < 25) & (reach > 0) & (reach < 500) & (F.col("v_cx") < 1100)
    pairs = band_join(labels, _values(reading), ["page_id"], "cy", "v_cy", 25, 25, beside)
    pairs = pairs.withColumn("value", extract_numeric(F.col("v_text"))).where("value is not null")
    best = first_by(pairs, ["page_id", "field"], [F.abs(F.col("cy").cast("double") - F.col("py")), "reading", "v_reading"])
    return best.select("page_id", "field", "value", F.col("v_conf").alias("conf"), F.col("v_cx").alias("cx"), "cy", F.col("v_text").alias("raw_text"))


def read_places(reading: DataFrame, places: DataFrame, located: DataFrame) -> DataFrame:
    """Fields still missing: the tokens around their place, joined from left to right."""
    missing = places.join(located.select("page_id", "field"), ["page_id", "field"], "left_anti").withColumn("py", F.col("py").cast("float"))
    around = F.abs(F.col("v_cx") - F.col("px")) <= 65
    pairs = band_join(missing, _values(reading), ["page_id"], "py", "v_cy", 35, 35, around)
    row = pairs.groupBy("page_id", "field").agg(F.array_sort(F.collect_list(F.struct("v_cx", "v_reading", "v_text", "v_cy"))).alias("vs"), F.max("v_conf").alias("conf"))
    text = F.array_join(F.transform("vs", lambda v: v["v_text"]), " ")
    out = row.select("page_id", "field", extract_numeric(text).alias("value"), F.greatest("conf", F.lit(0.0).cast("float")).alias("conf"), F.col("vs")[0]["v_cx"].alias("cx"), F.col("vs")[0]["v_cy"].alias("cy"), text.alias("raw_text"))
    return out.where("value is not null")


def read_axes(reading: DataFrame, zoned: DataFrame, located: DataFrame) -> DataFrame:
    """Axes from tokens that say steep or flat, with the number inside or to the right."""
    zone = F.when(F.col("cy").between(F.col("front_lo"), F.col("front_hi")), F.lit("Axis_front")).when(F.col("cy").between(F.col("back_lo"), F.col("back_hi")), F.lit("Axis_back"))
    inside = r"(?i)(?:steep|flat)[^0-9-]*(-?[0-9]+\.?[0-9]*)"
    said = reading.join(zoned, "page_id").where(F.lower("text").rlike("steep|flat")).select("page_id", "reading", "text", "confidence", "cx", "cy", zone.alias("field"), F.regexp_extract("text", inside, 1).alias("num"))
    said = said.where("field is not null")
    near = (F.abs(F.col("v_cy") - F.col("cy")) < 40) & (F.col("v_cx") > F.col("cx")) & (F.col("v_cx") - F.col("cx") < 300)
    right = band_join(said, _values(reading), ["page_id"], "cy", "v_cy", 40, 40, near)
    close = (F.abs(F.col("v_cy") - F.col("cy")) < 25) & (F.col("v_cx") - F.col("cx") < 150)
    digits = first_by(right.where(F.endswith("num", F.lit(".")) & close), ["page_id", "reading"], ["v_cx", "v_reading"]).select("page_id", "reading", F.regexp_extract(trimmed(F.col("v_text")), "^([0-9]+)", 1).alias("more"))
    own = said.where("num <> ''").join(digits, ["page_id", "reading"], "left").select(
        "page_id", "field", "reading", F.concat("num", F.coalesce("more", F.lit(""))).try_cast("double").alias("value"), F.col("confidence").alias("conf"), "cx", "cy", F.col("text").alias("raw_text")
    )
    apart = right.where("num = ''").withColumn("value", extract_numeric(F.col("v_text"))).where((F.col("value") > 0) & (F.col("value") < 180))
    apart = first_by(apart, ["page_id", "reading"], ["v_cx", "v_reading"]).select(
        "page_id", "field", "reading", "value", F.col("v_conf").alias("conf"), F.col("v_cx").alias("cx"), F.col("v_cy").alias("cy"), F.concat_ws(" ", trimmed(F.col("text")), "v_text").alias("raw_text")
    )
    both = own.where("value is not null").unionByName(apart).join(located.select("page_id", "field"), ["page_id", "field"], "left_anti")
    return first_by(both, ["page_id", "field"], ["reading"]).select(*LOCATED)


def locate_on_maps(items: DataFrame, pages: DataFrame, layouts: DataFrame) -> DataFrame:
    """Labels, then ambiguous labels, then places, then axis tokens; earlier phases win."""
    reading = settled(reading_order(items.join(pages.select("page_id"), "page_id"), "page_id", "cy", "cx", "ord"))
    zoned = settled(zones(reading, pages))
    claimed = settled(claim_labels(reading, zoned))
    tall = is_tall(F.col("height"))
    fitted = fit_pages(claimed, pages.withColumn("layout", F.when(F.col("printout_type") == TOPO, F.lit(TOPO_LAYOUT)).when(tall, F.lit(TALL)).otherwise(F.lit(MAPS))), layouts)
    places = settled(predicted(fitted, layouts))
    second = settled(union_first([claimed, claim_ambiguous(reading, zoned, places, claimed)], ["page_id", "field"], ["cy"]))
    third = settled(union_first([second, read_places(reading, places, second)], ["page_id", "field"], ["cy"]))
    return union_first([third, read_axes(reading, zoned, third)], ["page_id", "field"], ["cy"]).select(*LOCATED)


def _is_belin_label(text: Column) -> Column:
    out = F.lit(False)
    for pattern, _, _ in dims.BELIN_LABELS:
        out = out | text.rlike(pattern)
    return out


def claim_belin(items: DataFrame) -> DataFrame:
    """The nearest value right of the first label of each field of the ectasia page."""
    text = trimmed(F.col("text"))
    hits = F.filter(F.array(*[F.when(text.rlike(p), F.struct(F.lit(f).alias("field"), F.lit(d).alias("reach"))) for p, f, d in dims.BELIN_LABELS]), lambda x: x.isNotNull())
    labels = items.where(F.col("cy").between(250, 1200)).select("page_id", "ord", "cx", "cy", F.explode(hits).alias("h")).select("page_id", "ord", "cx", "cy", "h.*")
    labels = first_by(labels, ["page_id", "field"], ["ord"])
    values = items.where(~_is_belin_label(text)).select("page_id", F.col("ord").alias("v_ord"), F.col("text").alias("v_text"), F.col("confidence").alias("v_conf"), F.col("cx").alias("v_cx"), F.col("cy").alias("v_cy"))
    dx = F.col("v_cx") - F.col("cx")
    pairs = band_join(labels, values, ["page_id"], "cy", "v_cy", 20, 20, (dx > 0) & (dx <= F.col("reach")))
    pairs = pairs.withColumn("value", F.when(F.col("field") == "Belin_QS", quality_code(F.col("v_text"))).otherwise(signed_number(F.col("v_text")))).where("value is not null")
    best = first_by(pairs, ["page_id", "field"], [dx, "v_ord"])
    return best.select("page_id", "field", "value", F.col("v_conf").alias("conf"), F.col("v_cx").alias("cx"), F.col("v_cy").alias("cy"), F.col("v_text").alias("raw_text"))


SCORE_LABEL = r"(?i)^D[a-z]?\s*:"
SLOTS, LEAST, LOST, OFF = 6, 4, 200.0, 35.0  # of a template; that must be taken; what a slot left out costs; how far a label may be off
SCALES = (0.85, 1.15)
HELD = 200_000  # choices that are looked at together


def _line(ts: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scale, offset, residuals) of the least-squares line of each row of xs over ts."""
    mt, mx = ts.mean(), xs.mean(1, keepdims=True)
    scale = ((xs - mx) @ (ts - mt)) / ((ts - mt) ** 2).sum()
    offset = mx[:, 0] - scale * mt
    return scale, offset, xs - (scale[:, None] * ts + offset[:, None])


def _guess(at: np.ndarray, ts: np.ndarray) -> float:
    """The squares' sum of a good choice for these slots, or infinity: of lines through two labels with the nearest label for each other slot."""
    i, j = np.triu_indices(len(at), 1)
    scale = (at[j] - at[i]) / (ts[-1] - ts[0])
    fit = (scale >= SCALES[0]) & (scale <= SCALES[1])
    i, j, scale = i[fit], j[fit], scale[fit]
    if not len(i):
        return np.inf
    wanted = at[i][:, None] + scale[:, None] * (ts - ts[0])
    right = np.clip(np.searchsorted(at, wanted), 1, len(at) - 1)
    near = right - (wanted - at[right - 1] < at[right] - wanted)
    near[:, 0], near[:, -1] = i, j
    near = near[(np.diff(near, axis=1) > 0).all(1)]
    scale, _, off = _line(ts, at[near]) if len(near) else (np.empty(0),) * 3
    sound = (scale >= SCALES[0]) & (scale <= SCALES[1]) & (np.abs(off).max(1) <= OFF) if len(near) else np.empty(0, bool)
    return (off[sound] ** 2).sum(1).min() if sound.any() else np.inf


def _best_choice(at: np.ndarray, ts: np.ndarray, most: float) -> tuple[float, float, float] | None:
    """(squares' sum, scale, offset) of the best choice of labels for these slots, if its squares' sum is below `most`.

    Slots are filled from left to right. The next label lies where scale and
    residuals can still be sound, and a choice so far whose own line leaves more
    than `most` goes, as more labels never leave less.
    """
    best: tuple[float, float, float] | None = None
    stack = [np.arange(len(at))[:, None]]
    while stack:
        chosen = stack.pop()
        n = chosen.shape[1]
        if n == len(ts):
            scale, offset, off = _line(ts, at[chosen])
            left = (off**2).sum(1)
            left[(scale < SCALES[0]) | (scale > SCALES[1]) | (np.abs(off).max(1) > OFF)] = np.inf
            i = left.argmin()
            if left[i] < most:
                most = left[i]
                best = (float(left[i]), float(scale[i]), float(offset[i]))
            continue
        apart, last = ts[n] - ts[n - 1], at[chosen[:, -1]]
        begin = np.maximum(np.searchsorted(at, last + SCALES[0] * apart - 2 * OFF), chosen[:, -1] + 1)
        count = np.maximum(np.searchsorted(at, last + SCALES[1] * apart + 2 * OFF, "right") - begin, 0)
        if count.sum() > HELD and len(chosen) > 1:
            stack += [chosen[len(chosen) // 2 :], chosen[: len(chosen) // 2]]
            continue
        own = np.repeat(np.arange(len(chosen)), count)
        label = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + begin[own]
        longer = np.concatenate([chosen[own], label[:, None]], 1)
        if n >= 2 and len(longer):
            longer = longer[(_line(ts[: n + 1], at[longer])[2] ** 2).sum(1) < most]
        if len(longer):
            stack.append(longer)
    return best


def assign_scores(at: np.ndarray) -> tuple[float, float, tuple[float, ...]] | None:
    """(scale, offset, template) of the best fit of label positions, ascending, to a spacing template.

    The choice of at least four labels and as many slots that has the smallest
    mean square with 200 for each missing slot; the same as by trying all. Whole
    rows come first, and no choice with a slot less can beat one below its cost.
    Time grows with the square of the number of labels, not with all choices.
    """
    best, found = np.inf, None
    for k in range(min(len(at), SLOTS), LEAST - 1, -1):
        lost = (SLOTS - k) * LOST
        for template in dims.SCORE_TEMPLATES:
            for slots in combinations(template, k):
                if best <= lost:
                    return found
                ts = np.array(slots)
                most = min((best - lost) * k, k * OFF**2 * (1 + 1e-9))
                guess = _guess(at, ts)
                choice = _best_choice(at, ts, min(most, guess * (1 + 1e-9) + 1e-9))
                if choice and choice[0] / k + lost < best:
                    best, found = choice[0] / k + lost, (choice[1], choice[2], template)
    return found


def claim_scores(items: DataFrame) -> DataFrame:
    """The six scores in the bottom row of the ectasia page, by the spacing of their labels.

    The row is the band with the most score labels.
    """
    text = trimmed(F.col("text"))
    labels = items.where(text.rlike(SCORE_LABEL)).select("page_id", "ord", F.col("cy").cast("double").alias("cy"), (F.col("cx") - F.when(text.rlike(r"^D[a-z]?\s*:\s*-?[0-9]"), 45).otherwise(0)).cast("double").alias("x"))
    row = cluster_mode(labels, ["page_id"], "cy", "ord", 25).where("members >= 4").withColumnRenamed("centre", "row_cy")
    inside = labels.join(row, "page_id").where(F.abs(F.col("cy") - F.col("row_cy")) <= 25)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < 4:
            return pd.DataFrame(columns=["page_id", "row_cy", "field", "x"])
        found = assign_scores(np.sort(rows["x"].to_numpy()))
        if found is None:
            return pd.DataFrame(columns=["page_id", "row_cy", "field", "x"])
        scale, offset, template = found
        return pd.DataFrame({"page_id": key[0], "row_cy": rows["row_cy"].iloc[0], "field": dims.SCORE_FIELDS, "x": [scale * t + offset for t in template]})

    slots = inside.groupBy("page_id").applyInPandas(fit, f"page_id {items.schema['page_id'].dataType.simpleString()}, row_cy double, field string, x double")
    values = items.where(~text.rlike(SCORE_LABEL)).select("page_id", F.col("ord").alias("v_ord"), F.col("text").alias("v_text"), F.col("confidence").alias("v_conf"), F.col("cx").alias("v_cx"), F.col("cy").alias("v_cy"), signed_number(F.col("text")).alias("value"))
    dx = F.col("v_cx") - F.col("x")
    pairs = band_join(slots, values.where(F.abs("value") <= 25), ["page_id"], "row_cy", "v_cy", 20, 20, dx.between(-20, 200))
    best = first_by(pairs, ["page_id", "field"], [F.abs(dx), "v_ord"])
    return best.select("page_id", "field", "value", F.col("v_conf").alias("conf"), F.col("v_cx").alias("cx"), F.col("v_cy").alias("cy"), F.col("v_text").alias("raw_text"))


def locate_on_belin(items: DataFrame, pages: DataFrame, layouts: DataFrame) -> DataFrame:
    own = items.join(pages.select("page_id"), "page_id")
    claimed = settled(union_first([claim_belin(own), claim_scores(own)], ["page_id", "field"], ["cy"]))
    places = predicted(fit_pages(claimed, pages.withColumn("layout", F.lit(BELIN_LAYOUT)), layouts), layouts).where("field <> 'Belin_QS'")
    missing = places.join(claimed.select("page_id", "field"), ["page_id", "field"], "left_anti").withColumn("py", F.col("py").cast("float"))
    values = own.select("page_id", F.col("ord").alias("v_ord"), F.col("text").alias("v_text"), F.col("confidence").alias("v_conf"), F.col("cx").alias("v_cx"), F.col("cy").alias("v_cy"), signed_number(F.col("text")).alias("value")).where("value is not null")
    pairs = band_join(missing, values, ["page_id"], "py", "v_cy", 35, 35, F.abs(F.col("v_cx") - F.col("px")) <= 65)
    far = F.sqrt(F.pow(F.col("v_cy") - F.col("py"), 2) + F.pow(F.col("v_cx") - F.col("px"), 2))
    best = first_by(pairs, ["page_id", "field"], [far, "v_ord"]).select("page_id", "field", "value", F.col("v_conf").alias("conf"), F.col("v_cx").alias("cx"), F.col("v_cy").alias("cy"), F.col("v_text").alias("raw_text"))
    return union_first([claimed, best], ["page_id", "field"], ["cy"]).select(*LOCATED)


def shift_gen1(located: DataFrame, pages: DataFrame) -> DataFrame:
    """On first-generation pages, values that slipped one column to the right go back."""
    from pyspark.sql import Window

    out = located.join(pages.select("page_id", (F.col("printout_type") == GEN1).alias("gen1")), "page_id")
    page = Window.partitionBy("page_id")
    for main, wrong, lo, hi in (("Kmax", 4.0, 30.0, 100.0), ("PachyVertex", 2.0, 300.0, 700.0)):
        of = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c))).over(page)
        slipped = F.coalesce(F.col("gen1") & (of(main, "value") == wrong) & (of(main, "conf") < F.lit(0.7).cast("float")) & of(f"{main}_x", "value").between(lo, hi), F.lit(False))
        out = out.withColumn("slipped", slipped).where(~(F.col("slipped") & (F.col("field") == main)))
        out = out.withColumn("field", F.when(F.col("slipped") & (F.col("field") == f"{main}_x"), F.lit(main)).when(F.col("slipped") & (F.col("field") == f"{main}_y"), F.lit(f"{main}_x")).otherwise(F.col("field"))).drop("slipped")
    return out.select(*LOCATED)


def choose_layout(located: DataFrame, pages: DataFrame, layouts: DataFrame) -> DataFrame:
    """pages with `layout`: by type and height; without a height, a low corneal-volume row lets two fits decide for the tall one."""
    volume = located.where("field = 'CorneaVol'").select("page_id", F.col("cy").alias("vol_cy"))
    usual, tall = (fit_pages(located, pages.withColumn("layout", F.lit(n)), layouts).select("page_id", F.col("resid_std").alias(f"std_{n}")) for n in (MAPS, TALL))
    out = pages.join(volume, "page_id", "left").join(usual, "page_id").join(tall, "page_id")
    tall_by_fit = F.col("height").isNull() & F.coalesce(F.col("vol_cy") > 2200, F.lit(False)) & (F.col(f"std_{TALL}") < F.col(f"std_{MAPS}"))
    return out.select(*pages.columns, layout_of(F.col("printout_type"), F.col("height"), is_tall(F.col("height")) | tall_by_fit).alias("layout"))


def crop_requests(located: DataFrame, fits: DataFrame, layouts: DataFrame, kind: str) -> DataFrame:
    """(page_id, field, kind, x, y, half_w, half_h): regions to be read again.

    `missing`: where absent fields should be, on pages with at least 5 inliers;
    `suspicious`: located values outside their plausible ranges or after a lone
    `D.`; `sign`: positive values of fields whose sign is often lost.
    """
    if kind == "missing":
        places = predicted(fits.where("n_inliers >= 5"), layouts)
        has_kpd = located.where("field = 'KPD'").select("page_id").withColumn("kpd", F.lit(True))
        gone = places.join(located.select("page_id", "field"), ["page_id", "field"], "left_anti").join(has_kpd, "page_id", "left")
        gone = gone.where(~(F.coalesce("kpd", F.lit(False)) & (F.col("field") == "HWTW")))
        axis = F.startswith("field", F.lit("Axis"))
        return gone.select("page_id", "field", F.lit(kind).alias("kind"), F.col("px").cast("int").alias("x"), F.col("py").cast("int").alias("y"), F.when(axis, 180).otherwise(100).alias("half_w"), F.when(axis, 40).otherwise(30).alias("half_h"))
    if kind == "suspicious":
        ranged = located.join(F.broadcast(dims.ranges(located.sparkSession, dims.SUSPICIOUS)), "field", "left")
        odd = ranged.where((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")) | F.col("raw_text").rlike(r"D\.[0-9]"))
        return odd.select("page_id", "field", F.lit(kind).alias("kind"), F.col("cx").cast("int").alias("x"), F.col("cy").cast("int").alias("y"), F.lit(100).alias("half_w"), F.lit(30).alias("half_h"))
    signed = located.where(F.col("field").isin(dims.SIGN_FIELDS) & (F.col("value") > 0))
    return signed.select("page_id", "field", F.lit(kind).alias("kind"), F.greatest(F.col("cx").cast("int") - 30, F.lit(100)).alias("x"), F.col("cy").cast("int").alias("y"), F.lit(100).alias("half_w"), F.lit(25).alias("half_h"))


def apply_crops(located: DataFrame, requests: DataFrame, read: DataFrame) -> DataFrame:
    """Takes (page_id, field, kind, value, conf, text) read from crops into the located values.

    Missing fields are added at their places, suspicious values are replaced, and
    a value changes its sign where the crop says its negative within 0.5.
    """
    got = requests.join(read, ["page_id", "field", "kind"])
    note = lambda k: F.concat(F.lit(f"[{k}-rescue] "), "text")
    added = got.where("kind = 'missing'").select("page_id", "field", "value", F.col("conf").cast("float").alias("conf"), F.col("x").cast("float").alias("cx"), F.col("y").cast("float").alias("cy"), note("crop").alias("raw_text"))
    other = got.where("kind <> 'missing'").select("page_id", "field", "kind", F.col("value").alias("c_value"), F.col("conf").alias("c_conf"), "text")
    turned = (F.col("kind") == "sign") & (F.col("c_value") < 0) & (F.col("value") > 0) & (F.abs(F.abs("c_value") - F.col("value")) < 0.5)
    again = F.col("kind") == "suspicious"
    changed = located.join(other, ["page_id", "field"], "left").select(
        "page_id", "field",
        F.when(again, F.col("c_value")).when(turned, -F.col("value")).otherwise(F.col("value")).alias("value"),
        F.when(again, F.col("c_conf").cast("float")).otherwise(F.col("conf")).alias("conf"), "cx", "cy",
        F.when(again, note("suspicious")).when(turned, note("sign")).otherwise(F.col("raw_text")).alias("raw_text"),
    )
    return union_first([changed, added], ["page_id", "field"], ["cy"]).select(*LOCATED)


def demographics(items: DataFrame) -> DataFrame:
    """What the labels of a page's header say of the patient and examination: the nearest text to the right of each."""
    names = {"last name:": "last", "first name:": "first", "id:": "id", "pat-id:": "id", "date of birth:": "dob", "dob:": "dob", "exam date:": "date", "exam:": "date", "eye:": "eye", "time:": "time"}  # fixed values
    label = F.lower(trimmed(F.col("text")))
    what = F.coalesce(*[F.when(label == k, F.lit(v)) for k, v in names.items()])
    labels = items.select("page_id", "ord", "cx", "cy", what.alias("what")).where("what is not null")
    values = items.where(trimmed(F.col("text")) != "").select("page_id", F.col("ord").alias("v_ord"), trimmed(F.col("text")).alias("v"), F.col("cx").alias("v_cx"), F.col("cy").alias("v_cy"))
    dx = F.col("v_cx") - F.col("cx")
    pairs = band_join(labels, values, ["page_id"], "cy", "v_cy", 20, 20, (F.abs(F.col("v_cy") - F.col("cy")) < 20) & (dx > 50) & (dx < 500))
    near = first_by(pairs, ["page_id", "ord", "what"], [dx, "v_ord"])
    last = lambda w: F.max_by("v", F.when(F.col("what") == w, F.col("ord")))
    at = lambda w: F.max(F.when(F.col("what") == w, F.col("ord")))
    page = near.groupBy("page_id").agg(*[last(w).alias(w) for w in ("last", "first", "id", "dob", "date", "eye", "time")], at("last").alias("l_at"), at("first").alias("f_at"))
    alone = F.col("last").isNotNull() & (F.col("first").isNull() | (F.col("l_at") > F.col("f_at")))
    name = F.when(alone, F.col("last")).when(F.col("first").isNotNull(), F.concat(F.coalesce("last", F.lit("")), F.lit("^"), "first"))
    return page.select("page_id", name.alias("patient_name"), F.col("id").alias("patient_id"), header_date(F.col("dob")).alias("date_of_birth"), header_date(F.col("date")).alias("exam_date"), header_time(F.col("time")).alias("exam_time"), eye_phrase(F.col("eye")).alias("eye"))


def extract(items: DataFrame, layouts: DataFrame, read_crops=None) -> tuple[DataFrame, DataFrame]:
    """(pages, located): pages with type, n_fields, qa_status; rows of located fields.

    read_crops(requests) -> (page_id, field, kind, value, conf, text) is the
    reading engine's second look; without one, nothing is read again.
    """
    pages = settled(page_types(items))
    known = pages.where("printout_type is not null")
    belin, maps = known.where(F.col("printout_type") == BELIN), known.where(F.col("printout_type") != BELIN)
    located = locate_on_maps(items, maps, layouts).unionByName(locate_on_belin(items, belin, layouts))
    located = settled(shift_gen1(repair(located), known))
    chosen = settled(choose_layout(located, known, layouts))
    located = mutually_exclusive(located, ["page_id"], "KPD", "HWTW")
    if read_crops is not None:
        for kind in ("missing", "suspicious", "sign"):
            requests = crop_requests(located, fit_pages(located, chosen, layouts), layouts, kind)
            located = settled(apply_crops(located, requests, read_crops(requests)))
    located = settled(within_ranges(repair(located), dims.ranges(items.sparkSession)))
    counts = located.groupBy("page_id").agg(F.count("*").cast("int").alias("n_fields"))
    told = chosen.join(counts, "page_id", "left").na.fill({"n_fields": 0})
    least = F.when(F.col("printout_type") == BELIN, 8).otherwise(25)
    return told.withColumn("qa_status", qa_status(F.col("n_fields"), least)), located


def unrecognised(items: DataFrame) -> DataFrame:
    """Pages of no known type, as rejects."""
    return page_types(items).where("printout_type is null").select(F.lit("UNKNOWN_PAGE").alias("category"), F.col("page_id").cast("string").alias("file"), F.lit("no page type fits").alias("detail"))
