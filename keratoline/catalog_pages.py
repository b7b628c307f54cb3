"""Queries of the page plan, of images and of the ledger side, with the SQL that must give the same rows.

The event stream stands for the items of printed pages: a page is a user, or a
fortieth of a user's events; texts and positions follow from the event's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keratoline import dims
from keratoline.catalog import ORACLE, query, table
from keratoline.operators import ranking, regress, resolve
from keratoline.plans import flat, ingest, maps, pages, visits
from keratoline.sinks import tables
from keratoline.sources import dicom, engines, files, records

WIDE_PAGE = "CAST(user_id AS VARCHAR)"
PAGE = "CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 40 AS VARCHAR)"
NUMBER = "CAST(event_id % 30 + 10 AS VARCHAR) || '.' || CAST(event_id * 7 % 9 + 1 AS VARCHAR)"


def _items(text: str, cx: str, cy: str, more: str = "", where: str = "TRUE", page: str = PAGE) -> str:
    return f"""(SELECT {page} AS page_id, CAST(event_id AS INT) AS ord, {text} AS text, CAST(0.5 + event_id % 50 / 100.0 AS FLOAT) AS confidence,
  CAST({cx} AS FLOAT) AS cx, CAST({cy} AS FLOAT) AS cy{more} FROM events WHERE {where})"""


def _frame(spark, sf_dir: str, sql: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("keratoline_events")
    return spark.sql("SELECT * FROM " + sql.replace("AS VARCHAR", "AS STRING").replace("FROM events", "FROM keratoline_events"))


# --- page types and layouts

_TITLES = _items("CASE event_id * 13 % 11 WHEN 0 THEN '4 Maps' WHEN 1 THEN 'refractive' WHEN 2 THEN 'Topometric' WHEN 3 THEN 'Belin' WHEN 4 THEN 'ectasia' WHEN 5 THEN 'sagittal' WHEN 6 THEN 'Elevation' WHEN 7 THEN 'Fourier' WHEN 8 THEN 'abcd' WHEN 9 THEN 'exam' ELSE 'compare' END",
                 "event_id % 700", "event_id * 37 % 1000", ", CASE user_id % 5 WHEN 0 THEN 2630 WHEN 1 THEN 2710 WHEN 2 THEN 2540 END AS page_height")
_HAS = lambda *words: " AND ".join(f"t LIKE '%{w}%'" for w in words)
_KINDS = f"""SELECT page_id, height, CASE WHEN {_HAS('CATARACT', 'PRE')} THEN 'Other("Cataract Pre-OP")' WHEN {_HAS('4 MAPS', 'REFRACTIVE')} THEN 'FourMapsRefractive'
 WHEN title LIKE '%REFRACTIVE%' AND {_HAS('SAGITTAL', 'ELEVATION')} THEN 'Other("Refractive (gen1)")' WHEN {_HAS('TOPOMETRIC')} THEN 'TopometricKcStaging' WHEN {_HAS('BELIN', 'ECTASIA')} THEN 'BelinAmbrosio'
 WHEN {_HAS('BELIN', 'ABCD')} THEN 'BelinAbcdProgression' WHEN {_HAS('FOURIER')} THEN 'Fourier' WHEN {_HAS('COMPARE', 'EXAM')} THEN 'Other("Compare 4 Exams")' END AS printout_type
 FROM (SELECT page_id, max(page_height) AS height, string_agg(upper(text), ' ' ORDER BY ord) AS t, coalesce(string_agg(upper(text), ' ' ORDER BY ord) FILTER (cy < top), '') AS title
  FROM (SELECT *, CAST(max(cy) OVER (PARTITION BY page_id) * CAST(0.1 AS FLOAT) AS FLOAT) AS top FROM {_TITLES}) GROUP BY page_id)"""


@query(_KINDS)
def page_types(spark, sf_dir):
    return pages.page_types(_frame(spark, sf_dir, _TITLES))


@query(f"SELECT 'UNKNOWN_PAGE' AS category, page_id AS file, 'no page type fits' AS detail FROM ({_KINDS}) WHERE printout_type IS NULL")
def unknown_pages(spark, sf_dir):
    return pages.unrecognised(_frame(spark, sf_dir, _TITLES))


_BY_HEIGHT = """CASE WHEN printout_type = 'TopometricKcStaging' THEN 'TOPO' WHEN printout_type = 'BelinAmbrosio' THEN 'BELIN'
 WHEN printout_type = 'Other("Refractive (gen1)")' THEN CASE WHEN height BETWEEN 2700 AND 2730 THEN 'GEN1_992' ELSE 'GEN1_930' END WHEN {tall} THEN '4MAPS_TALL' ELSE '4MAPS' END"""


@query(f"SELECT page_id, {_BY_HEIGHT.format(tall='height BETWEEN 2620 AND 2650')} AS layout FROM ({_KINDS})")
def page_layouts(spark, sf_dir):
    told = page_types(spark, sf_dir)
    return told.select("page_id", pages.layout_of(F.col("printout_type"), F.col("height"), pages.is_tall(F.col("height"))).alias("layout"))


# --- zones, labels and values on map pages

_MAP = _items(f"CASE event_id * 13 % 7 WHEN 0 THEN 'Cornea Front' WHEN 1 THEN 'CORNEA BACK' WHEN 2 THEN 'True Net Power' WHEN 3 THEN 'Rf:' WHEN 4 THEN 'Pupil Center ::' WHEN 5 THEN 'Astig' ELSE {NUMBER} END",
              "event_id * 211 % 1000", "350 + event_id * 7 % 13 * 120 + event_id % 9", page=WIDE_PAGE)
_READING = f"(SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY round(CAST(cy AS DOUBLE) / 20) * 20, cx, ord) AS reading FROM {_MAP})"
_PAGES = f"(SELECT page_id, CASE WHEN length(page_id) % 2 = 0 THEN 2630 END AS height, 'FourMapsRefractive' AS printout_type FROM (SELECT DISTINCT page_id FROM {_MAP}))"
_HEADS = f"""(SELECT page_id, arg_max(cy, reading) FILTER (f) AS fh, arg_max(cy, reading) FILTER (b AND NOT f) AS bh, arg_max(cy, reading) FILTER (p AND NOT f AND NOT b) AS ph
 FROM (SELECT *, lower(text) LIKE '%cornea front%' AND cy > 400 AS f, lower(text) LIKE '%cornea back%' AND cy > 400 AS b, lower(text) LIKE '%true net power%' AND cy > 400 AS p FROM {_READING}) GROUP BY page_id)"""
_ZONES = f"""(SELECT page_id, front_lo, front_hi, back_lo, CASE WHEN back_lo < ph AND ph < back_hi THEN ph - 10 ELSE back_hi END AS back_hi FROM
 (SELECT page_id, ph, CASE WHEN moved THEN greatest(fh - 100, 200) ELSE f0 END AS front_lo, CASE WHEN moved THEN bh - 5 ELSE f1 END AS front_hi, CASE WHEN moved THEN bh + 5 ELSE b0 END AS back_lo, b1 AS back_hi FROM
 (SELECT *, coalesce(bh > fh AND bh < b1, false) AS moved FROM (SELECT h.*, CASE WHEN tall THEN 860 ELSE 700 END AS f0, CASE WHEN tall THEN 1350 ELSE 1180 END AS f1, CASE WHEN tall THEN 1380 ELSE 1200 END AS b0, CASE WHEN tall THEN 1900 ELSE 1720 END AS b1
  FROM {_HEADS} h JOIN (SELECT page_id, coalesce(height BETWEEN 2620 AND 2650, false) AS tall FROM {_PAGES}) USING (page_id)))))"""


def _reading(spark, sf_dir) -> DataFrame:
    return ranking.reading_order(_frame(spark, sf_dir, _MAP), "page_id", "cy", "cx", "ord")


def _map_pages(spark, sf_dir) -> DataFrame:
    return _frame(spark, sf_dir, _PAGES)


@query(f"SELECT page_id, CAST(front_lo AS FLOAT) AS front_lo, CAST(front_hi AS FLOAT) AS front_hi, CAST(back_lo AS FLOAT) AS back_lo, CAST(back_hi AS FLOAT) AS back_hi FROM {_ZONES}")
def page_zones(spark, sf_dir):
    return pages.zones(_reading(spark, sf_dir), _map_pages(spark, sf_dir))


_LABELS = f"""(SELECT * FROM (SELECT r.*, CASE WHEN k = 'rf' AND cy BETWEEN front_lo AND front_hi THEN 'Rf_front' WHEN k = 'rf' AND cy BETWEEN back_lo AND back_hi THEN 'Rf_back'
  WHEN k = 'astig' AND cy BETWEEN front_lo AND front_hi THEN 'Astig_front' WHEN k = 'pupil center' AND cy BETWEEN 1500 AND 2700 THEN 'PupilCenter' END AS field
  FROM (SELECT *, trim(regexp_replace(lower(text), ':+$', '')) AS k FROM {_READING}) r JOIN {_ZONES} USING (page_id)) WHERE field IS NOT NULL)"""
_CLAIMS = f"""WITH p AS (SELECT l.page_id, l.field, l.reading, l.field = 'PupilCenter' AS triple, CASE WHEN l.field = 'PupilCenter' AND l.cy > 1490 AND l.cy <= 2000 THEN 700 ELSE 1100 END AS cap,
  CASE WHEN regexp_matches(v.text, '[oO]') THEN 0.0 ELSE CAST(v.text AS DOUBLE) END AS value, v.confidence AS conf, v.cx, v.cy, v.text AS raw_text, v.reading AS v_reading
  FROM {_LABELS} l JOIN {_READING} v ON v.page_id = l.page_id AND regexp_matches(v.text, '^[0-9.]+$|[oO]') AND abs(v.cy - l.cy) < 25 AND v.cx > l.cx AND v.cx - l.cx < CASE WHEN l.field = 'PupilCenter' THEN 800 ELSE 500 END
  AND v.cx < CASE WHEN l.field = 'PupilCenter' THEN 1100 ELSE 1100 END),
 k AS (SELECT *, row_number() OVER (PARTITION BY page_id, field, reading ORDER BY cx, v_reading) AS i FROM p),
 m AS (SELECT page_id, field, reading, min(i) AS pos, row_number() OVER (PARTITION BY page_id, field ORDER BY reading) AS nth FROM k WHERE cx < cap AND NOT (triple AND value = 0) GROUP BY 1, 2, 3)
 SELECT page_id, field || CASE i - pos WHEN 0 THEN '' WHEN 1 THEN '_x' ELSE '_y' END AS field, value, conf, cx, cy, raw_text
 FROM k JOIN m USING (page_id, field, reading) WHERE nth = 1 AND i >= pos AND i <= pos + CASE WHEN triple THEN 2 ELSE 0 END"""


@query(_CLAIMS)
def label_claims(spark, sf_dir):
    """A letter o is read as a nought, so words with one are values too, as the rules for misreadings have it."""
    reading = _reading(spark, sf_dir)
    return pages.claim_labels(reading, pages.zones(reading, _map_pages(spark, sf_dir)))


_LAYOUT = [("4MAPS", "Rf_front", 760.0, 300.0), ("4MAPS", "Km_back", 1400.0, 420.0), ("4MAPS", "AC_depth", 1860.0, 640.0)]
_FITS = f"(SELECT DISTINCT page_id, '4MAPS' AS layout, 1 + CAST(length(page_id) AS DOUBLE) / 128 AS alpha, 12.0 AS beta, 1.0 AS alpha_x, CAST(length(page_id) AS DOUBLE) AS beta_x, length(page_id) AS n_inliers FROM {_MAP})"
_PLACES = f"""(SELECT page_id, field, CAST(alpha_x * cx_ref + beta_x AS FLOAT) AS px, alpha * cy_ref + beta AS py, n_inliers
 FROM {_FITS} JOIN (VALUES {', '.join(map(str, _LAYOUT))}) l(layout, field, cy_ref, cx_ref) USING (layout))"""


def _fits(spark, sf_dir) -> DataFrame:
    f = _frame(spark, sf_dir, _FITS)
    return f.select("page_id", "layout", *[F.col(c).cast("double").alias(c) for c in ("alpha", "beta", "alpha_x", "beta_x")], "n_inliers")


@query(f"SELECT page_id, field, px, CAST(py AS DOUBLE) AS py FROM {_PLACES}")
def places_predicted(spark, sf_dir):
    return pages.predicted(_fits(spark, sf_dir), pages.layout_frame(spark, _LAYOUT)).select("page_id", "field", "px", "py")


@query(f"""WITH n AS (SELECT p.page_id, p.field, r.cx, r.cy, r.text, r.reading, r.confidence, CAST(r.text AS DOUBLE) AS value, count(*) OVER (PARTITION BY p.page_id, p.field) AS n
  FROM {_PLACES} p JOIN {_READING} r ON r.page_id = p.page_id AND regexp_matches(r.text, '^[0-9.]+$') AND abs(r.cx - p.px) <= 65 AND r.cy - CAST(p.py AS FLOAT) BETWEEN -35 AND 35 WHERE p.field <> 'Rf_front')
 SELECT page_id, field, arg_min(value, struct_pack(cx, reading)) AS value, max(confidence) AS conf, arg_min(cx, struct_pack(cx, reading)) AS cx, arg_min(cy, struct_pack(cx, reading)) AS cy, string_agg(text, ' ' ORDER BY cx, reading) AS raw_text FROM n GROUP BY 1, 2""")
def values_at_places(spark, sf_dir):
    reading = _reading(spark, sf_dir).where(F.col("text").rlike(r"^[0-9.]+$"))
    places = pages.predicted(_fits(spark, sf_dir), pages.layout_frame(spark, _LAYOUT))
    have = places.where("field = 'Rf_front'").select("page_id", "field")
    return pages.read_places(reading, places, have)


_BACK = _items(f"CASE event_id % 3 WHEN 0 THEN 'Astig:' WHEN 1 THEN 'Km' ELSE '-' || {NUMBER} END", "event_id * 11 % 600", "1250 + event_id * 53 % 400")
_BACK_READING = f"(SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY round(CAST(cy AS DOUBLE) / 20) * 20, cx, ord) AS reading FROM {_BACK})"


@query(f"""WITH l AS (SELECT page_id, reading, cx, cy, CASE WHEN text LIKE 'Astig%' THEN 'Astig_back' ELSE 'Km_back' END AS field FROM {_BACK_READING} WHERE cx <= 500 AND cy BETWEEN 1200 AND 1720 AND text NOT LIKE '-%'),
 p AS (SELECT l.page_id, l.field, CAST(v.text AS DOUBLE) AS value, v.confidence AS conf, v.cx, l.cy, v.text AS raw_text,
  row_number() OVER (PARTITION BY l.page_id, l.field ORDER BY abs(CAST(l.cy AS DOUBLE) - CASE l.field WHEN 'Astig_back' THEN 1300 ELSE 1500 END), l.reading, v.reading) AS rn
  FROM l JOIN {_BACK_READING} v ON v.page_id = l.page_id AND v.text LIKE '-%' AND abs(v.cy - l.cy) < 25 AND v.cx > l.cx AND v.cx - l.cx < 500)
 SELECT page_id, field, value, conf, cx, cy, raw_text FROM p WHERE rn = 1""")
def ambiguous_claims(spark, sf_dir):
    reading = ranking.reading_order(_frame(spark, sf_dir, _BACK), "page_id", "cy", "cx", "ord")
    one = reading.select("page_id").distinct()
    zoned = one.select("page_id", *[F.lit(v).cast("float").alias(n) for n, v in (("front_lo", 700), ("front_hi", 1180), ("back_lo", 1200), ("back_hi", 1720))])
    places = one.select("page_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(y).alias("py")) for f, y in (("Astig_back", 1300.0), ("Km_back", 1500.0))])).alias("p")).select("page_id", "p.*")
    return pages.claim_ambiguous(reading, zoned, places, places.where("false"))


_AXES = _items("CASE event_id % 4 WHEN 0 THEN '(steep) ' || CAST(event_id % 180 AS VARCHAR) WHEN 1 THEN 'Flat:' ELSE CAST(event_id % 200 + 1 AS VARCHAR) || '.5' END", "event_id * 11 % 900", "700 + event_id * 53 % 900")
_AXES_READING = f"(SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY round(CAST(cy AS DOUBLE) / 20) * 20, cx, ord) AS reading FROM {_AXES})"


@query(f"""WITH s AS (SELECT *, CASE WHEN cy BETWEEN 700 AND 1180 THEN 'Axis_front' WHEN cy BETWEEN 1200 AND 1720 THEN 'Axis_back' END AS field, regexp_extract(text, '([0-9]+)$', 1) AS num FROM {_AXES_READING} WHERE regexp_matches(lower(text), 'steep|flat')),
 a AS (SELECT s.page_id, s.field, s.reading, CAST(v.text AS DOUBLE) AS value, v.confidence AS conf, v.cx, v.cy, s.text || ' ' || v.text AS raw_text, row_number() OVER (PARTITION BY s.page_id, s.reading ORDER BY v.cx, v.reading) AS rn
  FROM s JOIN {_AXES_READING} v ON v.page_id = s.page_id AND regexp_matches(v.text, '^[0-9.]+$') AND abs(v.cy - s.cy) < 40 AND v.cx > s.cx AND v.cx - s.cx < 300 WHERE s.num = '' AND s.field IS NOT NULL AND CAST(v.text AS DOUBLE) > 0 AND CAST(v.text AS DOUBLE) < 180),
 b AS (SELECT page_id, field, reading, CAST(num AS DOUBLE) AS value, confidence AS conf, cx, cy, text AS raw_text FROM s WHERE num <> '' AND field IS NOT NULL UNION ALL SELECT page_id, field, reading, value, conf, cx, cy, raw_text FROM a WHERE rn = 1)
 SELECT page_id, field, value, conf, cx, cy, raw_text FROM (SELECT *, row_number() OVER (PARTITION BY page_id, field ORDER BY reading) AS rn FROM b) WHERE rn = 1""")
def axis_tokens(spark, sf_dir):
    reading = ranking.reading_order(_frame(spark, sf_dir, _AXES), "page_id", "cy", "cx", "ord")
    zoned = reading.select("page_id").distinct().select("page_id", *[F.lit(v).cast("float").alias(n) for n, v in (("front_lo", 700), ("front_hi", 1180), ("back_lo", 1200), ("back_hi", 1720))])
    return pages.read_axes(reading, zoned, zoned.select("page_id", F.lit("none").alias("field")))


# --- the ectasia page

_BELIN = _items(f"CASE event_id % 5 WHEN 0 THEN 'K1:' WHEN 1 THEN 'Pachy Thin.' WHEN 2 THEN 'QS' WHEN 3 THEN '-' || {NUMBER} || ' D' ELSE CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'Suspect' ELSE '+' || {NUMBER} END END", "event_id * 211 % 1000", "200 + event_id * 7 % 13 * 80 + event_id % 9", page=WIDE_PAGE)


@query(f"""WITH i AS (SELECT *, CASE WHEN text = 'K1:' THEN 'Belin_K1' WHEN text LIKE 'Pachy%' THEN 'Belin_PachyThin' WHEN text = 'QS' THEN 'Belin_QS' END AS field, CASE WHEN text = 'K1:' THEN 250 WHEN text = 'QS' THEN 250 ELSE 700 END AS reach FROM {_BELIN}),
 l AS (SELECT *, row_number() OVER (PARTITION BY page_id, field ORDER BY ord) AS first FROM i WHERE field IS NOT NULL AND cy BETWEEN 250 AND 1200),
 v AS (SELECT *, CASE lower(text) WHEN 'ok' THEN 0.0 WHEN 'suspect' THEN 1.0 END AS code, try_cast(regexp_extract(text, '[-+]?[0-9]+\\.?[0-9]*') AS DOUBLE) AS num FROM i WHERE field IS NULL),
 p AS (SELECT l.page_id, l.field, CASE WHEN l.field = 'Belin_QS' THEN v.code ELSE v.num END AS value, v.confidence AS conf, v.cx, v.cy, v.text AS raw_text, v.ord, v.cx - l.cx AS dx
  FROM l JOIN v ON v.page_id = l.page_id AND v.cy - l.cy BETWEEN -20 AND 20 AND v.cx > l.cx AND v.cx - l.cx <= l.reach WHERE l.first = 1)
 SELECT page_id, field, CAST(value AS DOUBLE) AS value, conf, cx, cy, raw_text FROM (SELECT *, row_number() OVER (PARTITION BY page_id, field ORDER BY dx, ord) AS rn FROM p WHERE value IS NOT NULL) WHERE rn = 1""")
def ectasia_claims(spark, sf_dir):
    return pages.claim_belin(_frame(spark, sf_dir, _BELIN))


# --- after the values are located

_LOCATED = f"""(SELECT page_id, field, value, conf, CAST(300 + o % 500 AS FLOAT) AS cx, CAST(400 + o % 900 AS FLOAT) AS cy, CASE WHEN o % 7 = 0 THEN 'D.' || CAST(o % 9 AS VARCHAR) ELSE 'v' END AS raw_text FROM
 (SELECT *, row_number() OVER (PARTITION BY page_id, field ORDER BY o) AS rn FROM
  (SELECT {PAGE} AS page_id, event_id AS o, CASE event_id * 13 % 8 WHEN 0 THEN 'Kmax' WHEN 1 THEN 'Kmax_x' WHEN 2 THEN 'Kmax_y' WHEN 3 THEN 'PachyVertex' WHEN 4 THEN 'PachyVertex_x' WHEN 5 THEN 'Belin_K1' WHEN 6 THEN 'KPD' ELSE 'Belin_ARTmax' END AS field,
   CASE event_id * 13 % 8 WHEN 0 THEN 4.0 WHEN 1 THEN 45.0 WHEN 2 THEN CAST(event_id % 5 - 2 AS DOUBLE) WHEN 3 THEN 2.0 WHEN 4 THEN 540.0 WHEN 5 THEN CAST(event_id % 90 AS DOUBLE) WHEN 6 THEN 1.0 ELSE CAST(event_id % 1200 AS DOUBLE) END AS value,
   CAST(event_id % 10 / 10.0 AS FLOAT) AS conf FROM events)) WHERE rn = 1)"""
_TOLD = f"(SELECT DISTINCT page_id, CASE WHEN length(page_id) % 2 = 0 THEN 'Other(\"Refractive (gen1)\")' ELSE 'FourMapsRefractive' END AS printout_type FROM {_LOCATED})"


def _located(spark, sf_dir) -> DataFrame:
    return _frame(spark, sf_dir, _LOCATED).select("page_id", "field", F.col("value").cast("double").alias("value"), "conf", "cx", "cy", "raw_text")


@query(f"""WITH w AS (SELECT l.*, printout_type LIKE '%gen1%' AND max(value) FILTER (field = 'Kmax') OVER p = 4.0 AND max(conf) FILTER (field = 'Kmax') OVER p < CAST(0.7 AS FLOAT) AND max(value) FILTER (field = 'Kmax_x') OVER p BETWEEN 30 AND 100 AS k,
  printout_type LIKE '%gen1%' AND max(value) FILTER (field = 'PachyVertex') OVER p = 2.0 AND max(conf) FILTER (field = 'PachyVertex') OVER p < CAST(0.7 AS FLOAT) AND max(value) FILTER (field = 'PachyVertex_x') OVER p BETWEEN 300 AND 700 AS v
  FROM {_LOCATED} l JOIN {_TOLD} USING (page_id) WINDOW p AS (PARTITION BY page_id))
 SELECT page_id, CASE WHEN coalesce(k, false) AND field = 'Kmax_x' THEN 'Kmax' WHEN coalesce(k, false) AND field = 'Kmax_y' THEN 'Kmax_x' WHEN coalesce(v, false) AND field = 'PachyVertex_x' THEN 'PachyVertex' ELSE field END AS field,
  CAST(value AS DOUBLE) AS value, conf, cx, cy, raw_text FROM w WHERE NOT (coalesce(k, false) AND field = 'Kmax') AND NOT (coalesce(v, false) AND field = 'PachyVertex')""")
def generation_shift(spark, sf_dir):
    return pages.shift_gen1(_located(spark, sf_dir), _frame(spark, sf_dir, _TOLD))


_LOCATED_FITS = f"(SELECT DISTINCT page_id, '4MAPS' AS layout, 1.0 AS alpha, 12.0 AS beta, 1.0 AS alpha_x, 3.0 AS beta_x, length(page_id) AS n_inliers FROM {_LOCATED})"
_ABSENT = [("4MAPS", "Kmax", 1800.0, 450.0), ("4MAPS", "HWTW", 1900.0, 640.0), ("4MAPS", "Axis_front", 1000.0, 250.0)]
_LOOKS = f"""(SELECT page_id, field, 'missing' AS kind, CAST(cx_ref + 3 AS INT) AS x, CAST(cy_ref + 12 AS INT) AS y, CASE WHEN field LIKE 'Axis%' THEN 180 ELSE 100 END AS half_w, CASE WHEN field LIKE 'Axis%' THEN 40 ELSE 30 END AS half_h
  FROM (SELECT * FROM {_LOCATED_FITS} WHERE n_inliers >= 5) JOIN (VALUES {', '.join(map(str, _ABSENT))}) l(layout, field, cy_ref, cx_ref) USING (layout) WHERE (page_id, field) NOT IN (SELECT (page_id, field) FROM {_LOCATED})
  AND NOT (field = 'HWTW' AND page_id IN (SELECT page_id FROM {_LOCATED} WHERE field = 'KPD'))
 UNION ALL SELECT page_id, field, 'suspicious', CAST(cx AS INT), CAST(cy AS INT), 100, 30 FROM {_LOCATED} WHERE field = 'Belin_K1' AND (value < 30 OR value > 70) OR field = 'Belin_ARTmax' AND (value < 0 OR value > 900) OR regexp_matches(raw_text, 'D\\.[0-9]')
 UNION ALL SELECT page_id, field, 'sign', greatest(CAST(cx AS INT) - 30, 100), CAST(cy AS INT), 100, 25 FROM {_LOCATED} WHERE field IN ('Kmax_x', 'Kmax_y', 'PachyVertex_x') AND value > 0)"""


def _looks(spark, sf_dir) -> DataFrame:
    located, fits, layout = _located(spark, sf_dir), _frame(spark, sf_dir, _LOCATED_FITS), pages.layout_frame(spark, _ABSENT)
    fits = fits.select("page_id", "layout", *[F.col(c).cast("double").alias(c) for c in ("alpha", "beta", "alpha_x", "beta_x")], "n_inliers")
    kinds = [pages.crop_requests(located, fits, layout, kind) for kind in ("missing", "suspicious", "sign")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query(f"SELECT * FROM {_LOOKS}")
def second_looks(spark, sf_dir):
    return _looks(spark, sf_dir)


@query(f"""WITH g AS (SELECT l.*, CASE kind WHEN 'sign' THEN -2.0 ELSE 55.5 END AS c FROM {_LOOKS} l WHERE field <> 'Belin_ARTmax')
 SELECT l.page_id, l.field, CASE WHEN s.c IS NOT NULL THEN s.c WHEN n.c IS NOT NULL AND value > 0 AND abs(abs(n.c) - value) < 0.5 THEN -value ELSE value END AS value FROM {_LOCATED} l
 LEFT JOIN g s ON s.page_id = l.page_id AND s.field = l.field AND s.kind = 'suspicious' LEFT JOIN g n ON n.page_id = l.page_id AND n.field = l.field AND n.kind = 'sign'
 UNION ALL SELECT page_id, field, c FROM g WHERE kind = 'missing'""")
def second_looks_applied(spark, sf_dir):
    """Suspicious values before signs, as extraction does."""
    located, looks = _located(spark, sf_dir), _looks(spark, sf_dir)
    read = looks.where("field <> 'Belin_ARTmax'").select("page_id", "field", "kind", F.when(F.col("kind") == "sign", -2.0).otherwise(55.5).alias("value"), F.lit(0.8).alias("conf"), F.lit("t").alias("text"))
    for kind in ("missing", "sign", "suspicious"):
        located = pages.apply_crops(located, looks.where(F.col("kind") == kind), read)
    return located.select("page_id", "field", "value")


_CROPS = f"(SELECT {PAGE} AS crop, CAST(event_id AS INT) AS ord, CASE event_id % 4 WHEN 0 THEN 'Km:' WHEN 1 THEN {NUMBER} WHEN 2 THEN '(' || {NUMBER} || '5' ELSE CAST(event_id % 90 + 10 AS VARCHAR) END AS text, CAST(event_id % 64 / 64.0 AS FLOAT) AS confidence FROM events)"


@query(f"""SELECT crop, value, conf, text FROM (SELECT crop, text, confidence AS conf, CAST(b AS DOUBLE) AS value, row_number() OVER (PARTITION BY crop ORDER BY CAST(confidence AS DOUBLE) * greatest(strlen(b), 3) DESC, ord) AS rn
 FROM (SELECT *, ltrim(text, '([') AS b FROM {_CROPS}) WHERE regexp_matches(b, '^[0-9+-]')) WHERE rn = 1""")
def best_crop_reading(spark, sf_dir):
    return engines.best_reading(_frame(spark, sf_dir, _CROPS), ["crop"])


_HEADER = _items("CASE event_id % 7 WHEN 0 THEN 'Last Name:' WHEN 1 THEN 'First Name:' WHEN 2 THEN ' ID: ' WHEN 3 THEN 'DOB:' WHEN 4 THEN 'Eye:' ELSE 'w' || CAST(event_id % 97 AS VARCHAR) END", "event_id * 11 % 900", "60 + event_id * 53 % 300")


@query(f"""WITH i AS (SELECT *, trim(text) AS v, CASE lower(trim(text)) WHEN 'last name:' THEN 'last' WHEN 'first name:' THEN 'first' WHEN 'id:' THEN 'id' WHEN 'dob:' THEN 'dob' WHEN 'eye:' THEN 'eye' END AS what FROM {_HEADER}),
 n AS (SELECT l.page_id, l.ord, l.what, v.v, row_number() OVER (PARTITION BY l.page_id, l.ord ORDER BY v.cx - l.cx, v.ord) AS rn FROM i l JOIN i v ON v.page_id = l.page_id AND abs(v.cy - l.cy) < 20 AND v.cx - l.cx > 50 AND v.cx - l.cx < 500 WHERE l.what IS NOT NULL),
 p AS (SELECT page_id, arg_max(v, ord) FILTER (what = 'last') AS l, arg_max(v, ord) FILTER (what = 'first') AS f, arg_max(v, ord) FILTER (what = 'id') AS id, max(ord) FILTER (what = 'last') AS la, max(ord) FILTER (what = 'first') AS fa FROM n WHERE rn = 1 GROUP BY 1)
 SELECT page_id, id AS patient_id, CASE WHEN l IS NOT NULL AND (f IS NULL OR la > fa) THEN l WHEN f IS NOT NULL THEN coalesce(l, '') || '^' || f END AS patient_name FROM p""")
def header_demographics(spark, sf_dir):
    return pages.demographics(_frame(spark, sf_dir, _HEADER)).select("page_id", "patient_id", "patient_name")


# --- inputs, identity and sources

_ROWS = "(SELECT '~/in/' || CAST(event_id AS VARCHAR) || '.png' AS filename, event_id AS ord FROM events)"
_LISTED = "(SELECT '/home/u/in/' || CAST(event_id AS VARCHAR) || '.png' || CASE WHEN event_id % 3 = 0 THEN '_1' ELSE '' END AS path FROM events WHERE event_id % 5 <> 0)"


@query(f"SELECT filename, coalesce(a.path, b.path) AS path FROM {_ROWS} r LEFT JOIN {_LISTED} a ON a.path = '/home/u' || substr(filename, 2) LEFT JOIN {_LISTED} b ON b.path = '/home/u' || substr(filename, 2) || '_1' WHERE a.path IS NOT NULL OR b.path IS NOT NULL")
def paths_resolved(spark, sf_dir):
    return files.resolve_paths(_frame(spark, sf_dir, _ROWS), _frame(spark, sf_dir, _LISTED), home="/home/u").select("filename", "path")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'dcm' WHEN 1 THEN 'pdf' WHEN 2 THEN 'image' WHEN 3 THEN 'image' END AS kind, CASE event_id % 6 WHEN 3 THEN 'photo_1' ELSE '' END || CAST(event_id AS VARCHAR) AS stem, 'x/' || event_type AS folder FROM events")
def file_kinds(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, (".DCM", ".pdf", ".Jpeg", "", ".txt", ""))), (F.col("event_id") % 6 + 1).cast("int"))
    stem = F.concat(F.when(F.col("event_id") % 6 == 3, "photo_1").otherwise(""), F.col("event_id").cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", stem.alias("stem"), F.concat(F.lit("x/"), "event_type", F.lit("/"), stem, ext).alias("path"), F.when(F.col("event_id") % 6 == 3, F.unhex(F.lit("FFD8FF00"))).otherwise(F.unhex(F.lit("00"))).alias("head"))
    return files.described(rows).select("event_id", files.file_kind(F.col("ext"), F.col("head")).alias("kind"), "stem", "folder")


@query("""WITH m AS (SELECT *, event_id % 4 AS tier, CAST(event_id AS VARCHAR) AS p FROM events)
 SELECT p AS page_id, CASE WHEN tier < 2 THEN 'm' WHEN tier = 2 THEN 'seen' ELSE '' END AS id, CASE tier WHEN 0 THEN 'Fam' WHEN 1 THEN 'Oc' WHEN 2 THEN 'Oc' ELSE '' END AS FamilyName, CASE WHEN tier IN (1, 2) THEN 'Ular' ELSE '' END AS GivenName,
  CASE WHEN tier = 0 THEN 'OD' WHEN tier = 3 THEN '' ELSE 'OS' END AS eye FROM m""")
def image_tiers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("page_id"), F.concat(F.lit("f"), "event_id").alias("path"), (F.col("event_id") % 4).alias("tier"))
    seen = e.where("tier < 3").select("page_id", *[F.lit(v).alias(n) for n, v in (("patient_name", "Oc^Ular"), ("patient_id", "seen"), ("date_of_birth", "19700101"), ("exam_date", "20200101"), ("exam_time", "101010"), ("eye", "OS"))])
    whole = F.col("tier") == 0
    manifest = e.where("tier < 2").select("path", F.lit("m").alias("id"), *[F.when(whole, F.lit(v)).alias(n) for n, v in (("family_name", "Fam"), ("given_name", None), ("dob", "19800101"), ("laterality", "OD"), ("examdate", "20240101"), ("examtime", "111111"))])
    return ingest.image_identity(e.select("page_id", "path"), seen, manifest).select("page_id", "id", "FamilyName", "GivenName", "eye")


@query("""SELECT CAST(user_id AS VARCHAR) AS visit_id, CAST(event_id AS VARCHAR) AS filename, CAST(event_id % 3 AS INTEGER) AS page, event_type AS printout_type,
 CASE event_type WHEN 'SR' THEN 'DICOM_SR' WHEN 'SPR' THEN 'SPR_blob' ELSE 'OCR' END AS data_source FROM (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'SR' WHEN 'purchase' THEN 'SPR' ELSE event_type END AS event_type FROM events) WHERE user_id % 5 <> 0""")
def sources_of_visits(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "SR").when(F.col("event_type") == "purchase", "SPR").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 5 == 0, "").otherwise(F.col("user_id").cast("string")).alias("imagedir"), F.col("event_id").cast("string").alias("source_file"), (F.col("event_id") % 3).cast("int").alias("page_number"), kind.alias("printout_type"))
    return tables.visit_sources(rows)


@query("SELECT CAST(o_custkey AS VARCHAR) AS visit_id, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def first_run_wins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("visit_id", F.col("o_custkey").cast("string"))
    return tables.first_written(orders, orders.where("o_orderpriority = '1-URGENT'")).groupBy("visit_id").agg(F.count("*").alias("n"))


@query("SELECT '[' || event_type || '] ' || user_id || ' — ' || event_id AS value FROM events")
def reject_log(spark, sf_dir):
    return tables.reject_lines(table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.col("user_id").cast("string").alias("file"), F.col("event_id").cast("string").alias("detail")))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'f_' || user_id WHEN 1 THEN 'g' END AS file_key, CASE event_id % 3 WHEN 0 THEN 'Rf_front.png' WHEN 1 THEN 'a_dcm_p2_b' END AS field FROM events")
def crop_names(spark, sf_dir):
    user = F.col("user_id").cast("string")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("f_"), user, F.lit("_dcm_p1_Rf_front.png"))).when(F.col("event_id") % 3 == 1, F.lit("g_dcm_p3_a_dcm_p2_b")).otherwise(F.lit("no_dcm_p1"))
    file_key, field = resolve.crop_name(name)
    return table(spark, sf_dir, "events").select("event_id", file_key.alias("file_key"), field.alias("field"))


@query("""SELECT 'a_' || l_orderkey || '_x' AS file_key, field, round(value, 2) AS value FROM (SELECT l_orderkey, 'l_quantity' AS field, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, 'l_tax', l_tax FROM lineitem)""")
def truth_rows(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("a."), "l_orderkey", F.lit(".x.dcm")).alias("filename"), F.lit(1).alias("page"), "l_quantity", "l_tax", F.lit("0.9").alias("l_tax_conf"), F.lit("ocr").alias("l_tax_src"), F.lit("n/a").alias("l_note"))
    return resolve.truth(wide).withColumn("value", F.round("value", 2))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 40 / 4.0 END AS plain, event_id % 7 = 0 AS point, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 24 / 2.0 END AS cleaned FROM events)
 SELECT event_id, CAST(CASE WHEN plain IS NULL THEN cleaned WHEN point OR cleaned IS NULL THEN plain WHEN plain <> floor(plain) AND cleaned = floor(cleaned) THEN plain ELSE cleaned END AS DOUBLE) AS value FROM r""")
def readings_chosen(spark, sf_dir):
    i = F.col("event_id")
    value = resolve.chosen_reading(F.when(i % 5 != 0, i % 40 / 4), i % 7 == 0, F.when(i % 3 != 0, i % 24 / 2))
    return table(spark, sf_dir, "events").select("event_id", value.alias("value"))


@query("""SELECT CAST(user_id AS VARCHAR) AS path, string_agg(code || '=' || n, ';' ORDER BY code) AS codes FROM (SELECT user_id, event_type AS code, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id""")
def codes_in_one_text(spark, sf_dir):
    codes = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("code")).agg(F.count("*").cast("double").alias("value"))
    return tables.flat_codes(codes)


# --- fits, layouts and the ectasia page as a whole

_SHAPES = [(n, f, y, 100.0) for n, ys in (("4MAPS", (800, 1000, 1200, 1400, 1600, 2250)), ("4MAPS_TALL", (800, 1012, 1190, 1420, 1588, 2240))) for f, y in zip(("Rf_front", "Rs_front", "K1_front", "K2_front", "Km_front", "CorneaVol"), map(float, ys), strict=True)]
_SHAPED = f"""(SELECT DISTINCT CAST(user_id AS VARCHAR) AS page_id, CASE WHEN user_id % 5 = 0 THEN 2630 END AS height, field, CAST(cy_ref + (user_id * 7 + event_id % 6 * 3) % 5 AS FLOAT) AS cy FROM events
  JOIN (VALUES {', '.join(str((n, i % 6, f, y)) for i, (n, f, y, _) in enumerate(_SHAPES))}) s(layout, slot, field, cy_ref) ON slot = event_id % 6 AND layout = CASE WHEN user_id % 2 = 0 THEN '4MAPS' ELSE '4MAPS_TALL' END)"""


@query(f"""WITH p AS (SELECT s.page_id, s.height, l.layout, s.field, CAST(s.cy AS DOUBLE) AS y, l.cy_ref AS x FROM {_SHAPED} s JOIN (VALUES {', '.join(map(str, _SHAPES))}) l(layout, field, cy_ref, cx_ref) USING (field)),
 f AS (SELECT page_id, layout, var_pop(y) - pow(covar_pop(y, x), 2) / var_pop(x) AS off FROM p GROUP BY 1, 2), v AS (SELECT page_id, max(height) AS height, max(y) FILTER (field = 'CorneaVol') AS vol FROM p GROUP BY 1)
 SELECT page_id, CASE WHEN height BETWEEN 2620 AND 2650 OR height IS NULL AND vol > 2200 AND t.off < m.off THEN '4MAPS_TALL' ELSE '4MAPS' END AS layout FROM v JOIN f t USING (page_id) JOIN f m USING (page_id) WHERE t.layout = '4MAPS_TALL' AND m.layout = '4MAPS'""")
def layouts_by_fit(spark, sf_dir):
    shaped = _frame(spark, sf_dir, _SHAPED)
    located = shaped.select("page_id", "field", "cy", F.lit(100.0).cast("float").alias("cx"))
    told = shaped.select("page_id", F.lit("FourMapsRefractive").alias("printout_type"), "height").distinct()
    return pages.choose_layout(located, told, pages.layout_frame(spark, _SHAPES)).select("page_id", "layout")


_BELIN_LAYOUT = [("BELIN", "Belin_K2", 360.0, 300.0), ("BELIN", "Belin_Axis", 600.0, 640.0), ("BELIN", "Belin_K1", 840.0, 200.0)]


@query(f"""WITH c AS ({ORACLE['ectasia_claims']}),
 n AS (SELECT i.*, try_cast(regexp_extract(text, '[-+]?[0-9]+\\.?[0-9]*') AS DOUBLE) AS value FROM {_BELIN} i),
 p AS (SELECT n.page_id, f.field, value, confidence AS conf, cx, cy, text AS raw_text, row_number() OVER (PARTITION BY n.page_id, f.field ORDER BY sqrt(pow(cy - cy_ref, 2) + pow(cx - cx_ref, 2)), ord) AS rn
  FROM n JOIN (VALUES {', '.join(map(str, _BELIN_LAYOUT))}) f(layout, field, cy_ref, cx_ref) ON cy - cy_ref BETWEEN -35 AND 35 AND abs(cx - cx_ref) <= 65 WHERE value IS NOT NULL AND (n.page_id, f.field) NOT IN (SELECT (page_id, field) FROM c))
 SELECT page_id, field, value, conf, cx, cy, raw_text FROM c UNION ALL SELECT page_id, field, CAST(value AS DOUBLE), conf, cx, cy, raw_text FROM p WHERE rn = 1""")
def ectasia_page(spark, sf_dir):
    """Labels, then places: fewer than five pairs leave the layout where it is."""
    items = _frame(spark, sf_dir, _BELIN)
    return pages.locate_on_belin(items, items.select("page_id").distinct(), pages.layout_frame(spark, _BELIN_LAYOUT))


_SLOT_X = "CASE CAST(floor(event_id / 3) AS BIGINT) % 6 " + " ".join(f"WHEN {i} THEN CASE WHEN user_id % 2 = 0 THEN {a} ELSE {b} END" for i, (a, b) in enumerate(zip(*(map(int, t) for t in dims.SCORE_TEMPLATES), strict=True))) + " END"
_SCORES = _items(f"CASE WHEN event_id % 3 = 0 THEN 'D' || substr('fbpta', CAST(event_id % 5 + 1 AS INT), 1) || ':' ELSE CAST(event_id % 7 AS VARCHAR) || '.5' END", f"100 + {_SLOT_X} + CASE WHEN event_id % 3 = 0 THEN 0 ELSE 25 + event_id % 120 END", "2400 + event_id % 4", page=WIDE_PAGE)


@query(f"""WITH i AS {_SCORES}, l AS (SELECT page_id FROM i WHERE text LIKE 'D%' GROUP BY 1 HAVING count(DISTINCT cx) = 6),
 s AS (SELECT page_id, field, 100.0 + CASE WHEN CAST(page_id AS BIGINT) % 2 = 0 THEN a ELSE b END AS x FROM l, (VALUES {', '.join(str(x) for x in zip(dims.SCORE_FIELDS, *dims.SCORE_TEMPLATES, strict=True))}) t(field, a, b)),
 p AS (SELECT s.page_id, field, CAST(text AS DOUBLE) AS value, confidence AS conf, cx, cy, text AS raw_text, row_number() OVER (PARTITION BY s.page_id, field ORDER BY abs(CAST(cx AS DOUBLE) - x), ord) AS rn FROM s JOIN i ON i.page_id = s.page_id AND text NOT LIKE 'D%' AND cx - x BETWEEN -20 AND 200)
 SELECT page_id, field, value, conf, cx, cy, raw_text FROM p WHERE rn = 1""")
def score_row(spark, sf_dir):
    """Pages on which all six labels stand, exactly spaced; several stand on one another."""
    items = _frame(spark, sf_dir, _SCORES)
    whole = items.where("text LIKE 'D%'").groupBy("page_id").agg(F.count_distinct("cx").alias("n")).where("n = 6").select("page_id")
    return pages.claim_scores(items.join(whole, "page_id"))


# --- where maps are

_KIND = "CASE user_id % 3 WHEN 0 THEN 'FourMapsRefractive' WHEN 1 THEN 'BelinAmbrosio' ELSE CASE user_id % 2 WHEN 0 THEN 'Other(\"Refractive (old layout)\")' ELSE 'TopometricKcStaging' END END"
_MARKED = _items("CASE event_id * 13 % 11 WHEN 0 THEN 'Axial Curvature (Front)' WHEN 1 THEN 'Elevation (Front)' WHEN 2 THEN 'Corneal Thickness' WHEN 3 THEN 'Elevation (Back)' WHEN 4 THEN 'Curvature' WHEN 5 THEN 'Fixed' ELSE 'x' END",
                 "event_id * 211 % 2400", "event_id * 7 % 100 * 24", where="event_id % 4 <> 1", page=WIDE_PAGE)
_SHEETS = f"(SELECT DISTINCT CAST(user_id AS VARCHAR) AS page_id, {_KIND} AS printout_type, 3000 AS width, 2400 AS height FROM events)"
_first_at = lambda text, rule: f"arg_min(CAST(cx AS DOUBLE), ord) FILTER (text = '{text}' AND {rule}) AS {{0}}_x, arg_min(CAST(cy AS DOUBLE), ord) FILTER (text = '{text}' AND {rule}) AS {{0}}_y"
_PLACED = ", ".join(_first_at(t, r).format(n) for n, t, r in (
    ("curv", "Axial Curvature (Front)", "cy <= 1680"), ("elev_f", "Elevation (Front)", "cy <= 1680"), ("thick", "Corneal Thickness", "cy <= 1680"), ("elev_b", "Elevation (Back)", "cy <= 1680"),
    ("word", "Curvature", "cy <= 1680"), ("ef", "Elevation (Front)", "cy <= 600"), ("eb", "Elevation (Back)", "cy <= 600"), ("fixed", "Fixed", "cy > 1680")))
_ANCHORS = f"""(SELECT page_id, kind, {_PLACED} FROM {_MARKED} JOIN (SELECT page_id, CASE WHEN printout_type = 'FourMapsRefractive' THEN 'maps' WHEN printout_type = 'BelinAmbrosio' THEN 'belin' END AS kind FROM {_SHEETS}) USING (page_id) WHERE kind IS NOT NULL GROUP BY 1, 2)"""


@query(f"SELECT page_id, kind, curv_x, curv_y, thick_x, least(curv_y, elev_f_y) AS top_cy, least(thick_y, elev_b_y) AS low_cy, coalesce(ef_y, eb_y) AS first_cy, word_x, fixed_y FROM {_ANCHORS}")
def map_anchors(spark, sf_dir):
    found = maps.anchors(_frame(spark, sf_dir, _MARKED), _frame(spark, sf_dir, _SHEETS))
    return found.select("page_id", F.col("set").alias("kind"), F.col("curv.cx").alias("curv_x"), F.col("curv.cy").alias("curv_y"), F.col("thick.cx").alias("thick_x"), "top_cy", "low_cy", "first_cy", F.col("curv_word.cx").alias("word_x"), F.col("fixed.cy").alias("fixed_y"))


_EDGES = "(SELECT DISTINCT CAST(user_id AS VARCHAR) AS page_id, CASE WHEN user_id % 2 = 0 THEN 'maps_right' ELSE 'belin_left' END AS scan, CAST(user_id % 50 AS INT) AS \"first\", CAST(2500 + user_id % 400 AS INT) AS \"last\" FROM events WHERE user_id % 7 <> 0)"


@query(f"""WITH a AS (SELECT n.*, e.first AS ink, e.last AS ends, e.scan, least(curv_y, elev_f_y) AS top0, least(thick_y, elev_b_y) AS low0, coalesce(ef_y, eb_y) AS f0 FROM {_ANCHORS} n LEFT JOIN {_EDGES} e USING (page_id)),
 b AS (SELECT page_id, '4mr_all' AS name, coalesce(word_x - 90, least(curv_x, elev_f_x, thick_x, elev_b_x) - 680) AS x0, top0 - 15 AS y0, CASE WHEN scan = 'maps_right' THEN least(ends + 15, 3000) ELSE 3000 END AS x1, least(2 * coalesce(low0, top0 + 960.0) - top0 - 30, 2390.0) AS y1 FROM a WHERE kind = 'maps' AND top0 IS NOT NULL
  UNION ALL SELECT page_id, 'belin_left', CASE WHEN scan = 'belin_left' THEN greatest(ink - 5, 0) ELSE 0 END, f0 - 25, coalesce(eb_x + (eb_x - ef_x) / 2, eb_x + 400, ef_x + 1200), CASE WHEN fixed_y IS NULL THEN 2304.0 ELSE least(fixed_y + 70, 2390.0) END FROM a WHERE kind = 'belin' AND f0 IS NOT NULL),
 r AS (SELECT page_id, name, CAST(floor(greatest(0, x0)) AS INT) AS x, CAST(floor(greatest(0, y0)) AS INT) AS y, CAST(floor(greatest(0, x1)) AS INT) AS x1, CAST(floor(greatest(0, y1)) AS INT) AS y1 FROM b)
 SELECT page_id, name, x, y, x1 - x AS width, y1 - y AS height FROM r WHERE x1 > x AND y1 > y""")
def map_regions(spark, sf_dir):
    """Boxes of the four maps, where a top anchor stands, and of the elevation maps."""
    found = maps.anchors(_frame(spark, sf_dir, _MARKED), _frame(spark, sf_dir, _SHEETS)).where("top_cy IS NOT NULL OR `set` = 'belin'")
    edges = table(spark, sf_dir, "events").where("user_id % 7 <> 0").select(
        F.col("user_id").cast("string").alias("page_id"), F.when(F.col("user_id") % 2 == 0, "maps_right").otherwise("belin_left").alias("scan"), (F.col("user_id") % 50).cast("int").alias("first"), (F.col("user_id") % 400 + 2500).cast("int").alias("last")
    ).distinct()
    return maps.regions(found, edges).where("name IN ('4mr_all', 'belin_left')")


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'maps' WHEN 1 THEN 'maps' WHEN 2 THEN NULL WHEN 3 THEN 'belin' WHEN 4 THEN 'belin' END AS kind FROM events""")
def map_sets(spark, sf_dir):
    kinds = ("FourMapsRefractive", 'Other("Refractive (gen1)")', 'Other("Refractive (old layout)")', "BelinAmbrosio", "Belin Enhanced Ectasia", "BelinAbcdProgression", "Fourier")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", maps.map_set(kind).alias("kind"))


# --- rows by kind of file, thresholds by field, both axes of a fit

@query("""WITH e AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'dcm' WHEN 1 THEN 'pdf' ELSE 'image' END AS kind, CASE event_id % 5 WHEN 0 THEN 'Fourier' WHEN 1 THEN 'BelinAmbrosio' WHEN 2 THEN 'Holladay' ELSE 'FourMapsRefractive' END AS printout_type FROM events)
 SELECT CAST(event_id AS VARCHAR) AS path, CAST(event_id % 2 + 1 AS INT) AS page_number, printout_type, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 50 AS DOUBLE) END AS "Kmax", CASE kind WHEN 'dcm' THEN 'known' ELSE '' END AS id, CAST(event_id % 2 + 2 AS INT) AS event
 FROM e WHERE kind = 'pdf' OR printout_type IN ('BelinAmbrosio', 'FourMapsRefractive')""")
def page_rows_by_kind(spark, sf_dir):
    """Documents that stand alone give rows of all page types and no identity, other files rows of supported types."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        i, i.cast("string").alias("path"), i.cast("string").alias("page_id"), (i % 2 + 1).cast("int").alias("page_number"), F.element_at(F.array(*map(F.lit, ("dcm", "pdf", "image"))), (i % 3 + 1).cast("int")).alias("kind"),
        F.element_at(F.array(*map(F.lit, ("Fourier", "BelinAmbrosio", "Holladay", "FourMapsRefractive", "FourMapsRefractive"))), (i % 5 + 1).cast("int")).alias("printout_type"),
    )
    bare = ingest.bare_rows(e)
    base = bare.join(e.select("path", "kind"), "path").withColumn("id", F.when(F.col("kind") == "dcm", "known").otherwise(F.col("id"))).drop("kind")
    told = e.select("page_id", "printout_type", F.lit("ok").alias("qa_status"), F.lit(1).alias("n_fields"))
    located = e.where("event_id % 4 <> 0").select("page_id", F.lit("Kmax").alias("field"), (i % 50).cast("double").alias("value"), F.lit(0.9).cast("float").alias("conf"))
    numbered = e.select("page_id", "path", "page_number", (F.col("kind") != "pdf").alias("supported_only"))
    return ingest.page_rows(base, told, located, numbered, F.col("supported_only")).select("path", "page_number", "printout_type", "Kmax", "id", "event")


_FLAGGED = """(SELECT user_id AS visit_id, event_id AS ord, CASE event_id % 3 WHEN 0 THEN 'Belin_Df' WHEN 1 THEN 'Kmax' ELSE 'PachyVertex' END AS field, CASE WHEN CAST(floor(event_id / 3) AS BIGINT) % 2 = 0 THEN 'SR' ELSE 'FourMapsRefractive' END AS source_type,
 10.0 + CAST(floor(event_id / 3) AS BIGINT) % 7 * CASE event_id % 3 WHEN 2 THEN 0.9 ELSE 0.03 END AS value FROM events)"""


@query(f"""SELECT visit_id, field, coalesce(abs(arg_min(value, ord) FILTER (source_type = 'SR') - arg_max(value, ord) FILTER (source_type <> 'SR')) > CASE field WHEN 'Belin_Df' THEN 0.02 WHEN 'PachyVertex' THEN 2.0 ELSE 0.1 END, false) AS mismatch FROM {_FLAGGED} GROUP BY 1, 2""")
def mismatch_by_field(spark, sf_dir):
    rows = _frame(spark, sf_dir, _FLAGGED).select("visit_id", "ord", "field", "source_type", F.col("value").cast("double").alias("value"), F.lit(0.9).cast("float").alias("conf"))
    return resolve.best_values(rows).select("visit_id", "field", (F.col("flag") == "SR_OCR_MISMATCH").alias("mismatch"))


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice / 100, l_quantity), 4) AS alpha_x, round(regr_intercept(l_extendedprice / 100, l_quantity), 4) AS beta_x, round(median(l_extendedprice / 100 - l_quantity), 4) AS delta_x, round(regr_slope(l_tax, l_discount), 6) AS alpha, count(*) AS n_inliers FROM lineitem GROUP BY 1""")
def affine_fit_two_axes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("x", F.col("l_extendedprice") / 100)
    out = regress.affine_fit(rows, ["l_returnflag"], "l_tax", "l_discount", "x", "l_quantity", limit=10000.0)
    return out.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("alpha_x", "beta_x", "delta_x")], F.round("alpha", 6).alias("alpha"), "n_inliers")


_WHOLE_HEADER = _items("CASE event_id * 5 % 9 WHEN 0 THEN 'Last Name:' WHEN 1 THEN 'First Name:' WHEN 2 THEN 'PAT-ID:' WHEN 3 THEN 'Date of Birth:' WHEN 4 THEN 'Exam Date:' WHEN 5 THEN 'Time:' WHEN 6 THEN 'Eye:' WHEN 7 THEN CAST(event_id % 12 + 1 AS VARCHAR) || '/' || CAST(event_id % 28 + 1 AS VARCHAR) || '/' || CAST(event_id % 70 + 1930 AS VARCHAR) ELSE CASE event_id % 2 WHEN 0 THEN 'Left eye' ELSE 'RIGHT' END END",
                       "event_id * 211 % 1000", "60 + event_id * 7 % 13 * 30 + event_id % 9", page=WIDE_PAGE)
_DATE_OF = "CASE WHEN {0} LIKE '%/%/%' THEN split_part({0}, '/', 3) || lpad(split_part({0}, '/', 1), 2, '0') || lpad(split_part({0}, '/', 2), 2, '0') ELSE {0} END"


@query(f"""WITH i AS (SELECT *, CASE lower(text) WHEN 'last name:' THEN 'last' WHEN 'first name:' THEN 'first' WHEN 'pat-id:' THEN 'id' WHEN 'date of birth:' THEN 'dob' WHEN 'exam date:' THEN 'date' WHEN 'time:' THEN 'time' WHEN 'eye:' THEN 'eye' END AS what FROM {_WHOLE_HEADER}),
 n AS (SELECT l.page_id, l.ord, l.what, v.text AS v, row_number() OVER (PARTITION BY l.page_id, l.ord ORDER BY v.cx - l.cx, v.ord) AS rn FROM i l JOIN i v ON v.page_id = l.page_id AND abs(v.cy - l.cy) < 20 AND v.cx - l.cx > 50 AND v.cx - l.cx < 500 WHERE l.what IS NOT NULL),
 p AS (SELECT page_id, {', '.join(f"arg_max(v, ord) FILTER (what = '{w}') AS {w}_" for w in ('last', 'first', 'id', 'dob', 'date', 'time', 'eye'))}, max(ord) FILTER (what = 'last') AS la, max(ord) FILTER (what = 'first') AS fa FROM n WHERE rn = 1 GROUP BY 1)
 SELECT page_id, CASE WHEN last_ IS NOT NULL AND (first_ IS NULL OR la > fa) THEN last_ WHEN first_ IS NOT NULL THEN coalesce(last_, '') || '^' || first_ END AS patient_name, id_ AS patient_id, {_DATE_OF.format('dob_')} AS date_of_birth, {_DATE_OF.format('date_')} AS exam_date,
  regexp_replace(time_, '[:.]', '', 'g') AS exam_time, CASE WHEN upper(eye_) LIKE '%RIGHT%' THEN 'OD' WHEN upper(eye_) LIKE '%LEFT%' THEN 'OS' END AS eye FROM p""")
def header_of_pages(spark, sf_dir):
    return pages.demographics(_frame(spark, sf_dir, _WHOLE_HEADER))


# --- crops read twice, private records, raw rows and the visits they make

@query(f"""SELECT crop, value, conf, text FROM (SELECT crop, text, confidence AS conf, CAST(b AS DOUBLE) AS value, row_number() OVER (PARTITION BY crop ORDER BY CAST(confidence AS DOUBLE) * greatest(strlen(b), 3) * greatest(strlen(b), 3) DESC, ord) AS rn
 FROM (SELECT *, ltrim(text, '([') AS b FROM {_CROPS}) WHERE regexp_matches(b, '^[0-9+-]')) WHERE rn = 1""")
def best_crop_reading_by_length(spark, sf_dir):
    """Length counts twice."""
    return engines.best_reading(_frame(spark, sf_dir, _CROPS), ["crop"], power=2)


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'OS' WHEN 1 THEN 'OD' END AS eye, (800 + user_id * 13 % 900) / 100.0 AS hwtw, user_id % 4 AS d, user_id % 2 = 0 AS shifted FROM u WHERE user_id % 11 <> 0)
 SELECT user_id, 'HWTW' AS field, CAST(hwtw AS DOUBLE) AS value FROM r WHERE eye IS NOT NULL AND hwtw >= 9 AND hwtw < 15
 UNION ALL SELECT user_id, 'AC_depth', CASE WHEN shifted THEN 3.5 ELSE 9.25 END - CASE d WHEN 0 THEN 0.5 WHEN 1 THEN -1.25 ELSE 0.25 END FROM r WHERE eye IS NOT NULL AND d <> 3""")
def record_fields(spark, sf_dir):
    """Records of the fixed layout, laid out by Spark from the users; those of every eleventh are a byte short."""
    import struct

    u = F.col("user_id")
    number = lambda v: struct.pack("<d", v).hex()
    short = lambda c: F.unhex(F.concat(F.lpad(F.lower(F.hex(c % 256)), 2, "0"), F.lpad(F.lower(F.hex(F.floor(c / 256))), 2, "0")))
    base = F.element_at(F.array(*[F.lit(struct.pack("<d", v)) for v in (0.5, -1.25, 0.25, float("nan"))]), (u % 4 + 1).cast("int"))
    parts = [(records.EYE_AT, short(u % 3), 2), (records.DIAMETER_AT, short(u * 13 % 900 + 800), 2), (records.FORMAT_AT, short(F.when(u % 2 == 0, records.SHIFTED_FORMAT).otherwise(5)), 2), (records.ARRAY_AT, F.unhex(F.lit(number(3.5) + number(9.25))), 16), (records.ARRAY_AT + 32, base, 8)]
    data, at = [], 0
    for place, bytes_, size in parts:
        data += [F.lit(bytes(place - at)), bytes_]
        at = place + size
    data.append(F.when(u % 11 == 0, F.lit(bytes(records.SIZE - at - 1))).otherwise(F.lit(bytes(records.SIZE - at))))
    # explode: else decode()'s conditions move below the distinct and lay a record out several times for each event.
    rows = table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.explode(F.array(F.concat(*data))).alias("blob"))
    return records.record_values(records.decode(rows), ["user_id"]).select("user_id", "field", "value")


_RAW = """(SELECT event_id, user_id, CASE WHEN user_id % 9 = 0 THEN '' ELSE 'v' || CAST(user_id AS VARCHAR) || CASE event_id % 2 WHEN 0 THEN 'R' ELSE 'L' END END AS imagedir, CASE event_id % 2 WHEN 0 THEN 'OD' ELSE 'OS' END AS eye,
 CASE event_id * 7 % 4 WHEN 0 THEN 'SR' WHEN 1 THEN 'SPR' ELSE 'FourMapsRefractive' END AS printout_type, '2024010' || CAST(user_id % 9 + 1 AS VARCHAR) AS exam_date, '10' || CAST(user_id % 50 + 10 AS VARCHAR) || '00' AS exam_time,
 CASE WHEN event_id % 5 <> 0 THEN 40.0 + event_id % 13 * 0.25 END AS kmax, CASE WHEN event_id % 3 = 0 THEN 11.0 + event_id % 8 * 0.125 END AS hwtw, event_id % 40 / 40.0 AS conf FROM events)"""
_BEST_OF = "coalesce(arg_min({0}, event_id) FILTER (printout_type = '{1}' AND {0} IS NOT NULL), arg_min({0}, event_id) FILTER (printout_type = '{2}' AND {0} IS NOT NULL), arg_max({0}, struct_pack(c := CAST(conf AS FLOAT), e := event_id)) FILTER (printout_type NOT IN ('SR', 'SPR') AND {0} IS NOT NULL))"


@query(f"""SELECT imagedir, min(user_id) AS id, CASE min(eye) WHEN 'OD' THEN 1 ELSE 0 END AS righteye, substr(min(exam_date), 3) || min(exam_time) AS timeoftest, CAST(epoch(strptime(min(exam_date) || min(exam_time), '%Y%m%d%H%M%S')) AS BIGINT) AS "timeoftestEpoch",
  CAST({_BEST_OF.format('kmax', 'SR', 'SPR')} AS DOUBLE) AS "Kmax", CAST({_BEST_OF.format('hwtw', 'SPR', 'SR')} AS DOUBLE) AS "HWTW", count(*) AS n_source_rows, string_agg(DISTINCT printout_type, '|' ORDER BY printout_type) AS source_types
 FROM {_RAW} WHERE imagedir <> '' GROUP BY imagedir HAVING count(kmax) + count(hwtw) > 0""")
def visit_tables(spark, sf_dir):
    """The compact and the detailed table of visits, of raw rows as the ingestion writes them."""
    rows = _frame(spark, sf_dir, _RAW)
    raw = rows.select(
        F.col("event_id").alias("ord"), "imagedir", F.col("user_id").cast("string").alias("id"), F.lit("19800101").alias("birthdate"), "eye", "exam_date", "exam_time", "printout_type", F.lit("d").alias("device_serial"), F.lit("s").alias("software_version"),
        F.col("kmax").cast("double").alias("Kmax"), F.col("hwtw").cast("double").alias("HWTW"), *[F.col("conf").cast("double").alias(f"{f}_Paddle_conf") for f in ("Kmax", "HWTW")],
    )
    compact, detailed = visits.summaries(raw, names=False)
    about = detailed.select("imagedir", "n_source_rows", "source_types")
    return compact.join(about, "imagedir").select("imagedir", F.col("id").cast("bigint").alias("id"), "righteye", "timeoftest", "timeoftestEpoch", "Kmax", "HWTW", "n_source_rows", "source_types")


@query("""WITH p AS (SELECT '/in/' || CAST(event_id AS VARCHAR) AS path, event_id * 13 % 1000 AS nth, unnest([0, 1, 2]) AS event, event_id % 50 AS v FROM events WHERE event_id % 2 = 0)
 SELECT path, CAST(event AS INT) AS event, nth AS place, CASE event WHEN 0 THEN 'SR' WHEN 1 THEN 'SPR' ELSE 'FourMapsRefractive' END AS printout_type, CASE event WHEN 0 THEN CAST(v AS DOUBLE) END AS "Kmax", CASE event WHEN 1 THEN CAST(v AS DOUBLE) END AS "HWTW" FROM p""")
def raw_row_order(spark, sf_dir):
    """Rows of all parts under one set of columns, with each file's place in the listing."""
    e = table(spark, sf_dir, "events").where("event_id % 2 = 0").select(F.concat(F.lit("/in/"), F.col("event_id").cast("string")).alias("path"), (F.col("event_id") * 13 % 1000).alias("ord"), (F.col("event_id") % 50).cast("double").alias("v"))
    base = ingest.bare_rows(e)
    part = lambda kind, event, **fields: base.join(e, "path").select(base["*"], F.lit(kind).alias("printout_type"), F.lit("ok").alias("qa_status"), F.lit(event).alias("page_number"), F.lit(1).alias("n_fields"), F.lit(event).alias("event"), *[c.alias(n) for n, c in fields.items()])
    parts = [part("SR", 0, Kmax=F.col("v")), part("SPR", 1, HWTW=F.col("v")), part("FourMapsRefractive", 2)]
    return ingest.raw_rows(parts, listing=e.select("path", "ord")).select("path", F.col("ord.event").alias("event"), F.col("ord.at").alias("place"), "printout_type", "Kmax", "HWTW")


@query("""WITH e AS (SELECT *, event_id % 3 = 0 AS dcm, CASE event_id % 5 WHEN 0 THEN 'Fourier' WHEN 1 THEN 'BelinAmbrosio' WHEN 2 THEN NULL ELSE 'FourMapsRefractive' END AS printout_type FROM events)
 SELECT CAST(event_id AS VARCHAR) || CASE WHEN dcm THEN '.dcm' ELSE '.pdf' END AS filename, CAST(event_id % 2 + 1 AS INT) AS page, printout_type, 'ok' AS qa_status, CASE WHEN dcm THEN CAST(user_id AS VARCHAR) END AS patient_id,
  CASE WHEN dcm AND event_id % 2 = 0 THEN 'OD' WHEN dcm THEN 'OS' END AS laterality, CASE WHEN dcm THEN '20240131' END AS exam_date,
  CASE WHEN dcm THEN 'DICOM_A=' || CASE event_id % 4 WHEN 0 THEN '2' WHEN 1 THEN '2.25' WHEN 2 THEN '2.5' ELSE '2.75' END || ';DICOM_B=7' END AS sr_values,
  CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 50 AS DOUBLE) END AS "Kmax", CASE WHEN event_id % 4 <> 0 THEN CAST(0.5 AS FLOAT) END AS "Kmax_conf", CAST(NULL AS DOUBLE) AS "HWTW"
 FROM e WHERE printout_type IS NOT NULL""")
def flat_page_rows(spark, sf_dir):
    """Pages of all known types beside what a DICOM file says of itself; documents that stand alone say nothing."""
    i = F.col("event_id")
    dcm = i % 3 == 0
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("/in/"), F.col("user_id").cast("string"), F.lit("/"), i.cast("string"), F.when(dcm, ".dcm").otherwise(".pdf")).alias("path"), i.cast("string").alias("page_id"), i, "user_id", (i % 2 + 1).cast("int").alias("page"), F.when(dcm, "dcm").otherwise("pdf").alias("kind"),
    )
    said = {"patient_id": F.col("user_id").cast("string"), "laterality": F.when(i % 2 == 0, "R").otherwise("L"), "content_date": F.lit("20240131")}
    measured = lambda code, value: F.struct(F.lit(1).alias("seq"), F.lit(1).alias("depth"), F.lit("NUM").alias("value_type"), F.lit(code).alias("code"), value.alias("value"))
    codes = F.array(measured("B", F.lit("7.00")), measured("A", F.format_string("%.4f", 2 + i % 4 / 4)))
    decoded = e.select("path", "kind", F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("error"), *[said.get(t, F.lit(None).cast("string")).alias(t) for t in dicom.TAGS], codes.alias("sr"), F.lit(None).cast("binary").alias("blob"))
    told = e.select("page_id", F.element_at(F.array(*map(F.lit, ("Fourier", "BelinAmbrosio", None, "FourMapsRefractive", "FourMapsRefractive"))), (i % 5 + 1).cast("int")).alias("printout_type"), F.lit(1).alias("n_fields"), F.lit("ok").alias("qa_status"))
    located = e.where("event_id % 4 <> 0").select("page_id", F.lit("Kmax").alias("field"), (i % 50).cast("double").alias("value"), F.lit(0.5).cast("float").alias("conf"))
    rows = flat.flat_rows(e, flat.of_file(decoded), told, located)
    return rows.select("filename", "page", "printout_type", "qa_status", "patient_id", "laterality", "exam_date", "sr_values", "Kmax", "Kmax_conf", "HWTW")
