"""The queries over the driver's tables, each with the SQL that must give the same rows.

Measurement queries read the event stream as extraction rows: a visit is a user
and a third of a month, a field is the event's k modulo 4, sign-ups are report
rows, purchases record rows, all else page readings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keratoline import dims
from keratoline.functions import dates, keys, numbers
from keratoline.operators import filters, joins, median, ranking, regress, resolve
from keratoline.plans import ingest
from keratoline.sources import dicom, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    source = F.when(F.col("event_type") == "signup", "SR").when(F.col("event_type") == "purchase", "SPR").otherwise(F.concat(F.lit("OCR_"), "event_type"))
    return e.select(
        F.col("event_id").alias("ord"), F.concat(F.col("user_id").cast("string"), F.lit("|"), F.floor((F.day("ts") - 1) / 10).cast("string")).alias("visit"),
        (F.get_json_object("props", "$.k").cast("bigint") % 4).alias("f"), source.alias("source"),
        F.when(F.col("event_type").isin("signup", "purchase"), F.lit(100).cast("bigint")).otherwise(F.col("event_id") * 37 % 100).alias("conf"), "value", "user_id", "ts",
    )


M = """WITH m AS (SELECT event_id AS ord, CAST(user_id AS VARCHAR) || '|' || CAST((day(ts) - 1) // 10 AS VARCHAR) AS visit,
  CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS f,
  CASE event_type WHEN 'signup' THEN 'SR' WHEN 'purchase' THEN 'SPR' ELSE 'OCR_' || event_type END AS source,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 100 ELSE event_id * 37 % 100 END AS conf, value, user_id, ts FROM events)"""
RANKED = M + """, r AS (SELECT *, CASE WHEN source IN ('SR', 'SPR') THEN source ELSE 'OCR' END AS cls,
  row_number() OVER (PARTITION BY visit, f, CASE WHEN source IN ('SR', 'SPR') THEN source ELSE 'OCR' END
    ORDER BY CASE WHEN source IN ('SR', 'SPR') THEN 0 ELSE -conf END, CASE WHEN source IN ('SR', 'SPR') THEN ord ELSE -ord END) AS rn FROM m),
 p AS (SELECT visit, f, max(CASE WHEN cls = 'SR' THEN value END) AS sr, max(CASE WHEN cls = 'SPR' THEN value END) AS spr, max(CASE WHEN cls = 'OCR' THEN value END) AS ocr,
  max(CASE WHEN cls = 'OCR' THEN conf END) AS ocr_conf, max(CASE WHEN cls = 'OCR' THEN source END) AS ocr_source FROM r WHERE rn = 1 GROUP BY 1, 2)"""


def _best(spark: SparkSession, sf_dir: str, record_first) -> DataFrame:
    """Fields stand for measurements: 3 puts the record first, 1 is unreliable; whole percentages are confidences."""
    m = measured(spark, sf_dir).withColumn("c", (F.col("conf") / 100).cast("float"))
    reliability = F.when(F.col("f") == 1, 0.95).otherwise(0.99).cast("float")
    out = resolve.best_values(m, ["visit"], "f", "source", "value", "c", "ord", record_first, F.lit(20.0), reliability)
    return out.select("visit", "f", F.round("value", 4).alias("value"), "source", F.round(F.col("confidence").cast("double") * 100).cast("bigint").alias("conf"), "flag")


_BEST_SQL = RANKED + """ SELECT visit, f, round({pick}, 4) AS value, {source} AS source, CASE WHEN {given} THEN 100 ELSE ocr_conf END AS conf,
 CASE WHEN abs(sr - ocr) > 20.0 THEN 'SR_OCR_MISMATCH' WHEN f = 1 THEN 'REVIEW' WHEN NOT ({given}) AND ocr_conf > 0 AND ocr_conf < 85 THEN 'LOW_CONF' ELSE '' END AS flag FROM p"""
_GIVEN = "sr IS NOT NULL OR spr IS NOT NULL"


@query(_BEST_SQL.format(pick="CASE WHEN f = 3 THEN coalesce(spr, sr, ocr) ELSE coalesce(sr, spr, ocr) END", given=_GIVEN,
       source="CASE WHEN f = 3 AND spr IS NOT NULL THEN 'SPR' WHEN sr IS NOT NULL THEN 'SR' WHEN spr IS NOT NULL THEN 'SPR' ELSE ocr_source END"))
def best_value(spark, sf_dir):
    return _best(spark, sf_dir, F.col("f") == 3)


@query(_BEST_SQL.format(pick="coalesce(spr, sr, ocr)", given=_GIVEN, source="CASE WHEN spr IS NOT NULL THEN 'SPR' WHEN sr IS NOT NULL THEN 'SR' ELSE ocr_source END"))
def best_value_hwtw_rule(spark, sf_dir):
    return _best(spark, sf_dir, F.lit(True))


@query(M + """ SELECT visit, arg_min(source, ord) AS source, round(arg_min(value, ord), 4) AS value, count(*) AS n_source_rows,
 string_agg(DISTINCT source, '|' ORDER BY source) AS source_types FROM m GROUP BY visit""")
def visit_summary(spark, sf_dir):
    out = resolve.first_attributes(measured(spark, sf_dir), ["visit"], ["source", "value"], "ord", "source")
    return out.withColumn("value", F.round("value", 4))


@query(RANKED + """ SELECT visit, round(max(CASE WHEN f = 0 THEN coalesce(sr, spr, ocr) END), 4) AS f0, round(max(CASE WHEN f = 1 THEN coalesce(sr, spr, ocr) END), 4) AS f1,
 round(max(CASE WHEN f = 2 THEN coalesce(sr, spr, ocr) END), 4) AS f2, round(max(CASE WHEN f = 3 THEN coalesce(spr, sr, ocr) END), 4) AS f3 FROM p GROUP BY visit""")
def compact_pivot(spark, sf_dir):
    best = best_value(spark, sf_dir).withColumn("name", F.concat(F.lit("f"), "f"))
    return resolve.pivot_fields(best, ["visit"], ["f0", "f1", "f2", "f3"], {"value": ""}, "name")


@query("WITH b AS (" + ORACLE["best_value"] + ") SELECT visit, " + ", ".join(f"max(CASE WHEN f = {i} THEN {c} END) AS f{i}_{c}" for i in range(4) for c in ("value", "source", "conf", "flag")) + " FROM b GROUP BY visit")
def detailed_pivot(spark, sf_dir):
    best = best_value(spark, sf_dir).withColumn("name", F.concat(F.lit("f"), "f"))
    return resolve.pivot_fields(best, ["visit"], ["f0", "f1", "f2", "f3"], {c: f"_{c}" for c in ("value", "source", "conf", "flag")}, "name")


_LONG = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("SELECT field, l_returnflag, count(*) AS n, round(sum(value), 2) AS total FROM (" + " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS field, {c} AS value FROM lineitem" for c in _LONG) + ") GROUP BY 1, 2")
def wide_to_long(spark, sf_dir):
    rows = resolve.to_long(table(spark, sf_dir, "lineitem").select("l_returnflag", *_LONG), ["l_returnflag"], _LONG)
    return rows.groupBy("field", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


_CODES = [("view", "DICOM_RSAGMIN"), ("click", "DICOM_ACD"), ("error", "DICOM_BAHD"), ("signup", "DICOM_BAMD"), ("purchase", "DICOM_OTHER")]


@query("WITH c AS (SELECT user_id, m.code, max(value) AS v FROM events JOIN (VALUES " + ", ".join(f"('{e}', '{c}')" for e, c in _CODES) + """) m(e, code) ON event_type = m.e GROUP BY 1, 2),
 t AS (SELECT user_id, m.field, m.code, v, row_number() OVER (PARTITION BY user_id, m.field ORDER BY m.o) AS rn
  FROM c JOIN (VALUES ('DICOM_BAMD', 'Belin_D_final', 0), ('DICOM_BAHD', 'Belin_D_final', 6), ('DICOM_ACD', 'AC_depth', 18), ('DICOM_RSAGMIN', 'Kmax', 20)) m(code, field, o) ON c.code = m.code)
 SELECT user_id, field, round(CASE WHEN code = 'DICOM_RSAGMIN' AND v > 0 THEN 337.5 / v ELSE v END, 6) AS value FROM t WHERE rn = 1""")
def sr_map_join(spark, sf_dir):
    code = F.element_at(F.create_map(*[F.lit(x) for row in _CODES for x in row]), F.col("event_type"))
    rows = table(spark, sf_dir, "events").withColumn("code", code).where("code is not null").groupBy("user_id", "code").agg(F.max("value").alias("value"))
    return resolve.map_codes(rows, ["user_id"]).select("user_id", "field", F.round("value", 6).alias("value"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def ledger_anti(spark, sf_dir):
    done = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.not_in_ledger(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def ledger_semi(spark, sf_dir):
    done = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.in_ledger(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, "o_custkey").select("o_orderkey", "o_custkey")


@query("""WITH s AS (SELECT s_nationkey AS k, min(s_name) AS sname, round(max(s_acctbal), 2) AS sbal FROM supplier GROUP BY 1)
 SELECT c_custkey, c_nationkey, coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END, CASE WHEN c_mktsegment <> 'BUILDING' THEN sname END) AS who,
 coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE round(c_acctbal, 2) END, CASE WHEN c_mktsegment <> 'BUILDING' THEN sbal END) AS balance FROM customer LEFT JOIN s ON c_nationkey = k""")
def coalesce_merge(spark, sf_dir):
    gone = F.col("c_acctbal") < 0
    left = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(~gone, F.col("c_name")).alias("who"), F.when(~gone, F.round("c_acctbal", 2)).alias("balance"), (F.col("c_mktsegment") == "BUILDING").alias("core"))
    right = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_name").alias("who"), F.round(F.max("s_acctbal"), 2).alias("balance"))
    return joins.coalesce_merge(left, right, ["c_nationkey"], ["who", "balance"], F.col("core")).drop("core")


_SECONDS = "epoch(CAST(ts AS TIMESTAMP))"


@query("SELECT a.user_id, count(*) AS pairs FROM events a JOIN events b ON a.user_id = b.user_id AND epoch_us(b.ts) > epoch_us(a.ts) AND epoch_us(b.ts) - epoch_us(a.ts) < 3600000000 GROUP BY 1")
def band_join_count(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    later = e.select("user_id", F.col("t").alias("t2"))
    strict = (F.col("t2") > F.col("t")) & (F.col("t2") - F.col("t") < 3_600_000_000)
    return joins.band_join(e, later, ["user_id"], "t", "t2", 0, 3_600_000_000, strict).groupBy("user_id").agg(F.count("*").alias("pairs"))


@query("""WITH p AS (SELECT a.event_id, b.event_id AS next_id, row_number() OVER (PARTITION BY a.event_id ORDER BY epoch_us(b.ts) - epoch_us(a.ts), b.event_id) AS rn
 FROM events a JOIN events b ON a.user_id = b.user_id AND epoch_us(b.ts) > epoch_us(a.ts) AND epoch_us(b.ts) - epoch_us(a.ts) <= 21600000000) SELECT event_id, next_id FROM p WHERE rn = 1""")
def nearest_right(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    other = e.select("user_id", F.col("event_id").alias("next_id"), F.col("t").alias("t2"))
    pairs = joins.band_join(e, other, ["user_id"], "t", "t2", 0, 21_600_000_000, F.col("t2") > F.col("t"))
    return joins.nearest(pairs, ["event_id"], F.col("t2") - F.col("t"), ["next_id"], ["next_id"])


_CENTRES = "SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS px, round(avg(CAST(embedding[2] AS DOUBLE)), 6) AS py FROM embeddings GROUP BY 1"


@query(f"""WITH c AS ({_CENTRES}), p AS (SELECT c.label, e.vec_id, row_number() OVER (PARTITION BY c.label ORDER BY
 round(sqrt(pow(CAST(embedding[1] AS DOUBLE) - px, 2) + pow(CAST(embedding[2] AS DOUBLE) - py, 2)), 9), e.vec_id) AS rn, count(*) OVER (PARTITION BY c.label) AS n
 FROM c JOIN embeddings e ON abs(CAST(embedding[1] AS DOUBLE) - px) <= 0.05 AND abs(CAST(embedding[2] AS DOUBLE) - py) <= 0.05) SELECT label, vec_id, n FROM p WHERE rn = 1""")
def window_2d_match(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    centres = e.groupBy("label").agg(F.round(F.avg("x"), 6).alias("px"), F.round(F.avg("y"), 6).alias("py"))
    centres = centres.withColumn("column", F.explode(F.sequence(F.floor((F.col("px") - 0.05) / 0.1), F.floor((F.col("px") + 0.05) / 0.1))))  # bands on both axes
    points = e.select("vec_id", "x", "y", F.floor(F.col("x") / 0.1).alias("column"))
    pairs = joins.band_join(centres, points, ["column"], "py", "y", 0.05, 0.05, F.abs(F.col("x") - F.col("px")) <= 0.05)
    far = F.round(F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2)), 9)
    counted = pairs.withColumn("n", F.count("*").over(Window.partitionBy("label")))
    return ranking.first_by(counted, ["label"], [far, "vec_id"]).select("label", "vec_id", "n")


@query("""WITH v AS (SELECT user_id, event_type, event_id, round(value, 4) AS value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events WHERE value > 50)
 SELECT user_id, event_type, event_id, value FROM v WHERE rn = 1""")
def first_claim(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value > 50").select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))
    return ranking.first_claim(rows, ["user_id", "event_type"], ["event_id"])


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY round(CAST(event_id * 5 % 400 - 200 AS DOUBLE) / 20), epoch_us(ts), event_id) AS reading FROM events")
def reading_order(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") * 5 % 400 - 200).alias("y"), F.unix_micros(F.col("ts").cast("timestamp")).alias("x"))
    return ranking.reading_order(rows, "user_id", "y", "x", "event_id").select("event_id", "user_id", F.col("reading").cast("bigint").alias("reading"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, count(*) AS n FROM lineitem GROUP BY 1")
def affine_fit(spark, sf_dir):
    slope, start = regress.line("l_extendedprice", "l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(slope, 4).alias("slope"), F.round(start, 2).alias("intercept"), F.count("*").alias("n"))


@query("""WITH a AS (SELECT l_returnflag AS g, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i, count(*) AS n FROM lineitem GROUP BY 1),
 k AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity AS x, n FROM lineitem JOIN a ON g = l_returnflag WHERE abs(l_extendedprice - (s * l_quantity + i)) < 10000)
 SELECT l_returnflag, round(regr_slope(y, x), 4) AS alpha, round(regr_intercept(y, x), 2) AS beta, count(*) AS n_inliers, max(n) AS n_pairs,
 round(sqrt(var_pop(y) + pow(regr_slope(y, x), 2) * var_pop(x) - 2 * regr_slope(y, x) * covar_pop(y, x)), 2) AS resid_std FROM k GROUP BY 1""")
def affine_fit_robust(spark, sf_dir):
    out = regress.affine_fit(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", limit=10000.0)
    return out.select("l_returnflag", F.round("alpha", 4).alias("alpha"), F.round("beta", 2).alias("beta"), "n_inliers", "n_pairs", F.round("resid_std", 2).alias("resid_std"))


@query("SELECT o_orderpriority, round(median(o_totalprice), 2) AS mid FROM orders GROUP BY 1")
def median_by_group(spark, sf_dir):
    found = median.exact_median(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return found.select("o_orderpriority", F.round("median", 2).alias("mid"))


@query("""WITH c AS (SELECT user_id, event_id, CAST(day(ts) AS BIGINT) AS d, count(*) OVER (PARTITION BY user_id ORDER BY CAST(day(ts) AS BIGINT) RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS members FROM events)
 SELECT user_id, centre, members FROM (SELECT user_id, d AS centre, members, row_number() OVER (PARTITION BY user_id ORDER BY members DESC, event_id) AS rn FROM c) WHERE rn = 1""")
def cluster_mode(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.day("ts").cast("bigint").alias("d"))
    return ranking.cluster_mode(rows, ["user_id"], "d", "event_id", 2)


_LIMITS = [("A", 5.0, 45.0), ("N", 10.0, 30.0)]


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE (l_returnflag = 'A' AND l_quantity BETWEEN 5 AND 45) OR (l_returnflag = 'N' AND l_quantity BETWEEN 10 AND 30) OR l_returnflag NOT IN ('A', 'N') GROUP BY 1")
def range_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    kept = filters.within_ranges(rows, dims.ranges(spark, _LIMITS), "l_returnflag", "l_quantity")
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("""SELECT o_custkey, count(*) AS n, CASE WHEN count(*) >= CASE WHEN o_custkey % 7 = 0 THEN 8 ELSE 12 END THEN 'ok'
 ELSE 'incomplete: too few fields: ' || count(*) || '/' || CASE WHEN o_custkey % 7 = 0 THEN 8 ELSE 12 END END AS status FROM orders GROUP BY o_custkey""")
def qa_gate(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.withColumn("status", filters.qa_status(F.col("n"), F.when(F.col("o_custkey") % 7 == 0, 8).otherwise(12)))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders o WHERE NOT (o_orderpriority = '5-LOW' AND EXISTS (SELECT 1 FROM orders u WHERE u.o_custkey = o.o_custkey AND u.o_orderpriority = '1-URGENT'))")
def mutual_exclusion(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return filters.mutually_exclusive(rows, ["o_custkey"], "1-URGENT", "5-LOW", "o_orderpriority")


_WORDS = [("THE", "english"), ("DER", "german"), ("QUE", "romance")]


@query("""SELECT doc_id, CASE WHEN upper(text) LIKE '%IDIOT%' THEN 'rude' WHEN upper(text) LIKE '%HTTP%' AND upper(text) LIKE '%LICENSE%' THEN 'legal'
 WHEN upper(text) LIKE '%UNGH%' THEN 'german' WHEN upper(text) LIKE '%THE%' THEN 'english' WHEN upper(text) LIKE '%QUE%' THEN 'romance' END AS kind FROM documents""")
def doc_classify(spark, sf_dir):
    t = F.upper("text")
    has = lambda w: F.contains(t, F.lit(w))
    rules = [(has("IDIOT"), "rude"), (has("HTTP") & has("LICENSE"), "legal"), (has("UNGH"), "german"), (has("THE"), "english"), (has("QUE"), "romance")]
    return table(spark, sf_dir, "documents").select("doc_id", filters.classify(rules).alias("kind"))


@query("SELECT p_partkey, p_type FROM part WHERE p_type IS NULL OR p_type = '' OR p_type LIKE 'STANDARD%' OR p_type LIKE 'SMALL%' OR p_type LIKE '%BRASS%'")
def hint_filter(spark, sf_dir):
    hint = F.col("p_type")
    for word, named in (("STANDARD", "4 Maps Refractive"), ("SMALL", "Topometric"), ("BRASS", "Enhanced Ectasia")):
        hint = F.replace(hint, F.lit(word), F.lit(named))
    return table(spark, sf_dir, "part").where(files.wanted_type(hint)).select("p_partkey", "p_type")


_TOKENS = """CASE event_id % 12 WHEN 0 THEN '(' || a || ',' || b || ' mm' WHEN 1 THEN a || ' .' || b || ' D' WHEN 2 THEN '.' || b WHEN 3 THEN '0' || a || b
 WHEN 4 THEN '~' || a || '..' || b WHEN 5 THEN a || b || ' µm' WHEN 6 THEN 'x' WHEN 7 THEN '-' || a || '.' || b || '°' WHEN 8 THEN a || 'mm³'
 WHEN 9 THEN 'K1: ' || a || '.' || b WHEN 10 THEN a || 'o.' || b ELSE 'Z' || a || '.' || b END"""
_TOKEN_ROWS = f"(SELECT event_id, a, b, {_TOKENS} AS tok FROM (SELECT event_id, CAST(event_id % 90 + 10 AS VARCHAR) AS a, CAST(event_id * 7 % 90 + 10 AS VARCHAR) AS b FROM events))"


def _tokens(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("keratoline_events")
    sql = _TOKEN_ROWS.replace("VARCHAR", "STRING").replace("FROM events", "FROM keratoline_events")
    return spark.sql(f"SELECT * FROM {sql}")


@query(f"""SELECT event_id, tok, CASE event_id % 12 WHEN 0 THEN CAST(a || '.' || b AS DOUBLE) WHEN 1 THEN CAST(a || '.' || b AS DOUBLE) WHEN 2 THEN CAST('0.' || b AS DOUBLE)
 WHEN 3 THEN CAST('0.' || a || b AS DOUBLE) WHEN 4 THEN -CAST(a || '.' || b AS DOUBLE) WHEN 5 THEN CAST(a || b AS DOUBLE) WHEN 6 THEN NULL WHEN 7 THEN -CAST(a || '.' || b AS DOUBLE)
 WHEN 8 THEN CAST(a AS DOUBLE) WHEN 9 THEN CAST(a || '.' || b AS DOUBLE) WHEN 10 THEN CAST(a || '0.' || b AS DOUBLE) ELSE CAST('7' || a || '.' || b AS DOUBLE) END AS value FROM {_TOKEN_ROWS}""")
def numeric_parse(spark, sf_dir):
    return _tokens(spark, sf_dir).select("event_id", "tok", numbers.extract_numeric(F.col("tok")).alias("value"))


@query(f"""SELECT event_id, try_cast(nullif(regexp_extract(replace(tok, ',', '.'), '[-+]?[0-9]+\\.?[0-9]*'), '') AS DOUBLE) AS value FROM {_TOKEN_ROWS}""")
def signed_parse(spark, sf_dir):
    return _tokens(spark, sf_dir).select("event_id", numbers.signed_number(F.col("tok")).alias("value"))


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y%m%d') AS iso, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y%m%d') AS slashed, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y%m%d') AS dotted, 'n/a' AS other FROM orders")
def date_normalize(spark, sf_dir):
    d = F.col("o_orderdate")
    mdy = lambda s: F.concat_ws(s, F.month(d).cast("string"), F.day(d).cast("string"), F.year(d).cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.manifest_date(F.concat(F.lit(" "), F.date_format(d, "yyyy-MM-dd"), F.lit("\t"))).alias("iso"), dates.manifest_date(mdy("/")).alias("slashed"),
        dates.header_date(mdy(".")).alias("dotted"), dates.manifest_date(F.lit(" n/a ")).alias("other"),
    )


@query("SELECT event_id, strftime(CAST(ts AS TIMESTAMP), '%H%M%S') AS clock, strftime(CAST(ts AS TIMESTAMP), '%H%M%S') AS bare FROM events")
def time_normalize(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.manifest_time(F.date_format("ts", "HH:mm:ss")).alias("clock"), dates.header_time(F.date_format("ts", "HH.mm.ss")).alias("bare"))


@query("SELECT event_id, CAST(((year(ts) - 1970) * 365 + (month(ts) - 1) * 30 + day(ts)) AS BIGINT) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS epoch FROM events")
def epoch_approx(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.approximate_epoch(F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "HHmmss")).alias("epoch"))


@query("SELECT event_id, strftime(CAST(ts AS TIMESTAMP), '%y%m%d%H%M%S') AS timeoftest, CAST(floor(epoch(CAST(ts AS TIMESTAMP))) AS BIGINT) AS epoch FROM events")
def timeoftest(spark, sf_dir):
    d, t = F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "HHmmss")
    return table(spark, sf_dir, "events").select("event_id", dates.test_time(d, t).alias("timeoftest"), dates.calendar_epoch(d, t).alias("epoch"))


@query("SELECT user_id, substr(sha256(CAST(user_id AS VARCHAR) || '|' || CASE WHEN user_id % 2 = 0 THEN 'OS' ELSE 'OD' END || '|' || CAST(min(event_id) AS VARCHAR)), 1, 16) AS visit_id FROM events GROUP BY user_id")
def visit_key_hash(spark, sf_dir):
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("first"))
    eye = F.when(F.col("user_id") % 2 == 0, F.lit("OS"))
    return first.select("user_id", keys.visit_id(F.col("user_id").cast("string"), eye, F.col("first")).alias("visit_id"))


@query()
def visit_key_compat(spark, sf_dir):
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("first"))
    return first.select("user_id", keys.visit_id_blake3(F.col("user_id").cast("string"), F.lit("OD"), F.col("first")).alias("visit_id"))


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS family, split_part(c_name, '#', 2) AS given FROM customer")
def name_split(spark, sf_dir):
    family, given = ingest.split_name(F.replace("c_name", F.lit("#"), F.lit("^")))
    return table(spark, sf_dir, "customer").select("c_custkey", family.alias("family"), given.alias("given"))


@query("""WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS id, CASE event_id % 3 WHEN 0 THEN 'OD' WHEN 1 THEN 'OS' END AS eye, strftime(CAST(ts AS TIMESTAMP), '%Y%m%d') AS d,
  strftime(CAST(ts AS TIMESTAMP), '%H%M%S') AS t, CAST(floor(epoch(CAST(ts AS TIMESTAMP))) AS BIGINT) AS s FROM events)
 SELECT 'in/' || event_type_folder || '/' || event_id || '.dcm' AS path, id, '' AS birthdate, coalesce(eye, '') AS eye, d AS exam_date, t AS exam_time, 'SN' AS device_serial, '' AS software_version,
  'in/' || event_type_folder AS source_folder, event_id || '.dcm' AS source_file, substr(sha256(id || '|' || coalesce(eye, 'OD') || '|' || s), 1, 16) AS imagedir
 FROM (SELECT *, CAST(event_id % 7 AS VARCHAR) AS event_type_folder FROM e)""")
def pii_drop(spark, sf_dir):
    e, none = table(spark, sf_dir, "events"), F.lit(None).cast("string")
    meta = e.select(
        F.concat(F.lit("in/"), (F.col("event_id") % 7).cast("string"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".dcm")).alias("path"),
        F.col("user_id").cast("string").alias("patient_id"), F.concat(F.lit("Doe^"), "event_type").alias("patient_name"), none.alias("date_of_birth"),
        F.when(F.col("event_id") % 3 == 0, "OD").when(F.col("event_id") % 3 == 1, "OS").alias("eye"), F.date_format("ts", "yyyyMMdd").alias("exam_date"), F.date_format("ts", "HHmmss").alias("exam_time"),
        F.lit("SN").alias("device_serial"), none.alias("software_version"),
    )
    return ingest.base_rows(meta, names=False)


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'OD' WHEN 1 THEN 'OS' WHEN 2 THEN 'OD' WHEN 3 THEN 'OS' END AS side, CASE WHEN event_id % 2 = 0 THEN 'OD' ELSE 'OS' END AS phrase, CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS righteye FROM events")
def laterality(spark, sf_dir):
    given = F.element_at(F.array(*map(F.lit, (" r", "OS\t", "od", "l ", "both"))), (F.col("event_id") % 5 + 1).cast("int"))
    said = F.when(F.col("event_id") % 2 == 0, F.lit("Right eye")).otherwise(F.lit("left (OS)"))
    return table(spark, sf_dir, "events").select("event_id", dates.laterality(given).alias("side"), dates.eye_phrase(said).alias("phrase"), dates.right_eye(F.trim(F.regexp_replace(given, "\t", ""))).alias("righteye"))


# One query per repair rule: values and tokens are made from the event number on both sides.
_REPAIRS = {
    "coordinate": ("Kmax_x", ["'1+0.' || b", "'1' || d || '.' || b", "'0.' || b", "'+' || d || b", "'-' || c || d || '.' || b"], ["0.5", "10 + d + b / 100.0", "b / 100.0", "d * 100.0 + b", "-(c * 10.0 + d + b / 100.0)"],
        ["-(b / 100.0)", "CASE WHEN d + b / 100.0 <= 5 THEN -(d + b / 100.0) ELSE {all1} END", "b / 100.0", "CASE WHEN abs(d * 100.0 + b) <= 3 THEN d * 100.0 + b WHEN CAST(d || '.' || b AS DOUBLE) <= 5 THEN CAST(d || '.' || b AS DOUBLE) ELSE d * 100.0 + b END", "{neg}"]),
    "back_power": ("K1_back", ["'16.' || b || 'D'", "c || d", "'1' || c || d", "'-6.' || b", "d || '.' || b"], ["16 + b / 100.0", "c * 10.0 + d", "100 + c * 10.0 + d", "-(6 + b / 100.0)", "d + b / 100.0 + 0.001"],
        ["-(6 + b / 100.0)", "-(c + d / 10.0)", "-(c + d / 10.0)", "-(6 + b / 100.0)", "-(d + b / 100.0 + 0.001)"]),
    "front_power": ("Km_front", ["'14' || d || '.' || b || 'd'", "'4' || d || b", "'43.' || b", "'999.' || b", "'4' || d || d"], ["140 + d + b / 100.0", "4000 + d * 100.0 + b", "43 + b / 100.0", "999 + b / 100.0", "400 + d * 11.0"],
        ["40 + d + b / 100.0", "40 + d + b / 100.0", "43 + b / 100.0", "999 + b / 100.0", "40 + d + d / 10.0"]),
    "astigmatism": ("Astig_front", ["'10.' || b", "'1' || d || '.' || b", "'10' || d", "'1-0.' || b", "'1.' || b"], ["10.5", "12.5", "100.0 + d", "-0.75", "1 + b / 100.0"],
        ["0.5", "d + b / 100.0", "d / 10.0", "0.75", "1 + b / 100.0"]),
    "asphericity": ("Qval_back", ["'x'"] * 5, ["10 + b / 100.0", "10 + d + b / 100.0", "5.0", "-0.3", "26.0"],
        ["-(b / 100.0)", "CASE WHEN d + b / 100.0 <= 2.5 THEN -(d + b / 100.0) ELSE -(d + b / 100.0) END", "5.0", "-0.3", "-16.0"]),
    "radius": ("Rf_front", ["'17.' || b || 'mm'", "'27.' || b", "'7.' || b", "'13.' || b", "'x'"], ["17 + b / 100.0", "27 + b / 100.0", "7 + b / 100.0", "13 + b / 100.0", "50.0"],
        ["7 + b / 100.0", "7 + b / 100.0", "7 + b / 100.0", "13 + b / 100.0", "50.0"]),
    "pupil": ("PupilDia", ["'13.' || b || 'mm'", "'3.' || b", "'23.' || b", "'x'", "'10.' || b || 'd'"], ["13 + b / 100.0", "3 + b / 100.0", "23 + b / 100.0", "11.0", "10.5"],
        ["3 + b / 100.0", "3 + b / 100.0", "23 + b / 100.0", "11.0", "b / 100.0"]),
    "depth": ("AC_depth", ["'13.' || b || 'mm'", "'3.' || b", "'23.' || b", "'x'", "'12.' || b"], ["13 + b / 100.0", "3 + b / 100.0", "23 + b / 100.0", "11.0", "12.5"],
        ["3 + b / 100.0", "3 + b / 100.0", "23 + b / 100.0", "11.0", "2 + b / 100.0"]),
    "thickness": ("Thinnest", ["'x'"] * 5, ["1500.0 + b", "1900.0 + b", "540.0", "9500.4", "9999.8"], ["500.0 + b", "1900.0 + b", "540.0", "500.0", "9999.8"]),
}
_PARTS = "(SELECT event_id, event_id % 5 AS r, event_id * 7 % 9 + 1 AS d, event_id * 3 % 9 + 1 AS c, event_id * 11 % 90 + 10 AS b FROM events)"


def _by_case(parts: list[str]) -> str:
    return "CASE r " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(parts)) + " END"


def _repair_query(name: str, field: str, tokens: list[str], values: list[str], wanted: list[str]) -> None:
    all1 = "CASE WHEN d + b / 100.0 <= 5 THEN -(d + b / 100.0) ELSE -CAST('1.' || d || b AS DOUBLE) END"
    neg = "CASE WHEN CAST(c || '.' || d || b AS DOUBLE) <= 5 THEN -CAST(c || '.' || d || b AS DOUBLE) ELSE -(c * 10.0 + d + b / 100.0) END"
    wanted = [w.format(all1=all1, neg=neg) for w in wanted]

    def run(spark, sf_dir):
        table(spark, sf_dir, "events").createOrReplaceTempView("keratoline_events")
        rows = spark.sql(f"SELECT event_id, CAST({_by_case(values)} AS DOUBLE) AS v, {_by_case(tokens)} AS tok FROM {_PARTS.replace('FROM events', 'FROM keratoline_events')}")
        return numbers.repair(rows.withColumn("field", F.lit(field)), "field", "v", "tok").select("event_id", F.round("v", 6).alias("value"))

    QUERIES[f"repair_{name}"] = run
    ORACLE[f"repair_{name}"] = f"SELECT event_id, round(CAST({_by_case(wanted)} AS DOUBLE), 6) AS value FROM {_PARTS}"


for _name, _rule in _REPAIRS.items():
    _repair_query(_name, *_rule)


@query("SELECT event_id, 'DICOM_k' AS code, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_flatten(spark, sf_dir):
    item = lambda i, kind, code, value: F.struct(F.lit(i).alias("seq"), F.lit(1).alias("depth"), F.lit(kind).alias("value_type"), F.lit(code).alias("code"), value.alias("value"))
    k = F.get_json_object("props", "$.k")
    tree = F.array(item(0, "NUM", "k", F.lit("7")), item(1, "NUM", "k", F.coalesce(k, F.lit("none"))), item(2, "TEXT", "t", k), item(3, "NUM", "", k), item(4, "NUM", "k", F.lit("n/a")))
    decoded = table(spark, sf_dir, "events").where(k.isNotNull()).select(F.col("event_id").cast("string").alias("path"), F.lit(None).cast("string").alias("error"), tree.alias("sr"))
    return dicom.report_codes(decoded).select(F.col("path").cast("bigint").alias("event_id"), "code", "value")


@query("""WITH u AS (SELECT doc_id, 0 AS phase, lang AS v FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1, source FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 2, 'rest' FROM documents)
 SELECT doc_id, v FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY phase, v) AS rn FROM u) WHERE rn = 1""")
def manifest_union_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    phases = [d.where("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("v")), d.where("doc_id % 3 = 0").select("doc_id", F.col("source").alias("v")), d.select("doc_id", F.lit("rest").alias("v"))]
    return joins.union_first(phases, ["doc_id"], ["v"]).select("doc_id", "v")


@query("SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1")
def reject_counts(spark, sf_dir):
    from keratoline.sinks.tables import reject_counts as counted

    return counted(table(spark, sf_dir, "events").select(F.col("event_type").alias("category")))


@query("""WITH j AS (SELECT lang, CASE WHEN (n_chars > 1500 AND quality = 1) OR (n_chars <= 1500 AND quality = 0) THEN 1 ELSE 0 END AS ok FROM documents JOIN labels USING (doc_id))
 SELECT lang, CAST(sum(ok) AS BIGINT) AS correct, count(*) AS total FROM j GROUP BY ROLLUP (lang)""")
def accuracy_report(spark, sf_dir):
    pairs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("n_chars") > 1500).cast("int").cast("double").alias("read"), F.col("quality").cast("double").alias("truth"))
    return resolve.accuracy(pairs, "lang", "read", "truth")


@query("""WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
 SELECT o_custkey, n, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT o_custkey, n, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def result_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    count = lambda o: o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return joins.differences(count(orders), count(orders.where("o_orderstatus <> 'P'")))


@query("""SELECT user_id, round(arg_min(value, event_id), 4) AS first_value, arg_min(event_type, event_id) AS first_type, count(DISTINCT event_type) AS n_types FROM events GROUP BY 1""")
def keyed_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.round("value", 4).alias("first_value"), F.col("event_type").alias("first_type"), "event_type")
    out = joins.merge_upsert(rows, "user_id", "event_id", ["first_value", "first_type"], {"types": ["event_type"]})
    return out.select("user_id", "first_value", "first_type", F.size("types").cast("bigint").alias("n_types"))
