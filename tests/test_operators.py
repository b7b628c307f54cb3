"""Resolution, joins, regression and filters on literal frames."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from keratoline import dims
from keratoline.operators import filters, joins, median, ranking, regress, resolve

M = "ord long, visit_id string, source_type string, field string, value double, conf float"


def best(spark, rows):
    return {(r.visit_id, r.field): r for r in resolve.best_values(spark.createDataFrame(rows, M)).collect()}


def test_resolution_order_ties_and_flags(spark):
    rows = [
        (1, "a", "OCR", "K1_front", 43.0, 0.9), (2, "a", "SR", "K1_front", 43.05, 1.0), (3, "a", "SR", "K1_front", 50.0, 1.0), (4, "a", "SPR", "K1_front", 44.0, 1.0),
        (1, "a", "SR", "HWTW", 11.0, 1.0), (2, "a", "SPR", "HWTW", 11.04, 1.0), (3, "a", "OCR", "HWTW", 11.2, 0.9),
        (5, "b", "X", "K2_front", 1.0, 0.7), (6, "b", "Y", "K2_front", 2.0, 0.7), (7, "b", "Z", "K2_front", 3.0, float("nan")),
        (1, "b", "OCR", "Belin_Qval", -0.3, 0.99), (1, "b", "OCR", "Km_front", 40.0, 0.0), (1, "b", "OCR", "Rf_front", 7.7, 0.85), (1, "b", "OCR", "Kmax", None, 0.9),
        (1, "c", "OCR", "K1_front", 43.0, 0.9), (2, "c", "SR", "K1_front", 43.1, 1.0),
    ]
    got = best(spark, rows)
    assert (got["a", "K1_front"].value, got["a", "K1_front"].source, got["a", "K1_front"].flag) == (43.05, "SR", "")
    assert (got["a", "HWTW"].value, got["a", "HWTW"].flag) == (11.04, "SR_OCR_MISMATCH")
    assert (got["b", "K2_front"].value, got["b", "K2_front"].flag) == (2.0, "LOW_CONF")
    assert got["b", "Belin_Qval"].flag == "REVIEW" and got["b", "Km_front"].flag == "" and got["b", "Rf_front"].flag == ""
    assert ("b", "Kmax") not in got
    assert got["c", "K1_front"].flag == ("SR_OCR_MISMATCH" if abs(43.1 - 43.0) > 0.1 else "")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 1000), st.integers(1, 7))
def test_resolution_does_not_depend_on_partitioning(spark, seed, parts):
    rng = random.Random(seed)
    rows = [(i, rng.choice("ab"), rng.choice(["SR", "SPR", "OCR", "PAGE"]), rng.choice(["HWTW", "Kmax"]), float(rng.randint(0, 5)), rng.choice([0.5, 0.9])) for i in range(40)]
    one = best(spark, rows)
    rng.shuffle(rows)
    df = resolve.best_values(spark.createDataFrame(rows, M).repartition(parts))
    assert {(r.visit_id, r.field): r for r in df.collect()} == one


def test_codes_map_first_and_radius(spark):
    rows = [("f", "DICOM_BAHD", 2.0), ("f", "DICOM_BAMD", 1.0), ("f", "DICOM_RSAGMIN", 7.5), ("g", "DICOM_RSAGMIN", 0.0), ("g", "DICOM_BAHD", 3.0), ("g", "OTHER", 3.0)]
    got = {(r.path, r.field): r.value for r in resolve.map_codes(spark.createDataFrame(rows, "path string, code string, value double"), ["path"]).collect()}
    assert got == {("f", "Belin_D_final"): 1.0, ("f", "Kmax"): 45.0, ("g", "Kmax"): 0.0, ("g", "Belin_D_final"): 3.0}


def test_wide_to_long_guards_numbers(spark):
    df = spark.createDataFrame([(1, "4.5d", "0.9", " 7", "x")], "ord int, Kmax string, Kmax_Paddle_conf string, HWTW string, HWTW_Paddle_conf string")
    assert resolve.to_long(df, ["ord"], dims.FIELDS).collect() == []
    df = spark.createDataFrame([(1, "4.5", "bad", "7", "0.5")], df.schema)
    assert sorted((r.field, r.value, round(r.conf, 3)) for r in resolve.to_long(df, ["ord"], dims.FIELDS).collect()) == [("HWTW", 7.0, 0.5), ("Kmax", 4.5, 0.0)]


def test_band_join_equals_brute_force(spark):
    rng = random.Random(0)
    left = [(i % 3, rng.uniform(-50, 50)) for i in range(60)]
    right = [(i % 3, rng.uniform(-50, 50)) for i in range(60)] + [(0, left[0][1] + 7.0)]
    for below, above in ((5.0, 7.0), (0.0, 7.0), (3.0, 0.0)):
        out = joins.band_join(spark.createDataFrame(left, "k int, a double"), spark.createDataFrame(right, "k int, b double"), ["k"], "a", "b", below, above)
        want = sorted((k, a, b) for k, a in left for k2, b in right if k == k2 and -below <= b - a <= above)
        assert sorted((r.k, r.a, r.b) for r in out.collect()) == want
    outer = joins.band_join(spark.createDataFrame([(9, 0.0)], "k int, a double"), spark.createDataFrame(right, "k int, b double"), ["k"], "a", "b", 1, 1, how="left")
    assert [tuple(r) for r in outer.collect()] == [(9, 0.0, None)]


def test_unions_merges_and_differences(spark):
    a, b = spark.createDataFrame([("x", 1)], "k string, v int"), spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int")
    assert sorted(map(tuple, joins.union_first([a, b], ["k"], ["v"]).collect())) == [("x", 1), ("y", 3)]
    rows = spark.createDataFrame([("k", 2, "b", "s2", 1), ("k", 1, None, "s1", 1), ("k", 3, "c", "s1", 1)], "k string, o int, name string, file string, page int")
    got = joins.merge_upsert(rows, "k", "o", ["name"], {"files": ["file"], "pages": ["file", "page"]}).first()
    assert got.name == "b" and [f.file for f in got.files] == ["s1", "s2"] and len(got.pages) == 2
    assert sorted(map(tuple, joins.differences(a, b).collect())) == [("x", 1, "left"), ("x", 2, "right"), ("y", 3, "right")]


def fit(pairs):
    """An independent robust fit."""
    p = np.array(pairs)
    slope, start = np.polyfit(p[:, 0], p[:, 1], 1)
    keep = np.abs(p[:, 1] - slope * p[:, 0] - start) < 40
    if keep.sum() >= 5:
        slope, start = np.polyfit(p[keep, 0], p[keep, 1], 1)
    return slope, start, int(keep.sum()), (p[keep, 1] - slope * p[keep, 0] - start).std()


def test_affine_fit(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for g in range(5):
        a, b = rng.uniform(0.95, 1.05), rng.uniform(-30, 30)
        pairs = [(x, a * x + b + (rng.uniform(-3, 3) if g else 0)) for x in (rng.uniform(100, 2500) for _ in range(20))]
        pairs += [(500.0, 900.0)] * (g > 2)
        want[g] = fit(pairs)
        rows += [(g, x, y, x / 2, y / 2 + 7) for x, y in pairs]
    rows += [(9, float(i), 5.0 * i, 1.0, 2.0) for i in range(4)] + [(8, 3.0, float(i), 3.0, 3.0) for i in range(6)]
    got = {r.g: r for r in regress.affine_fit(spark.createDataFrame(rows, "g int, r double, y double, xr double, x double"), ["g"], "y", "r", "x", "xr").collect()}
    for g, (slope, start, n, spread) in want.items():
        assert (got[g].alpha, got[g].beta, got[g].resid_std) == pytest.approx((slope, start, spread), abs=1e-6) and got[g].n_inliers == n
    assert (got[9].alpha, got[9].beta, got[9].n_inliers, got[9].n_pairs, got[9].delta_x) == (1.0, 0.0, 0, 4, 0.0)
    assert (got[8].alpha, got[8].beta) == (1.0, 0.0)


def test_ranking_and_filters(spark):
    items = spark.createDataFrame([("p", 0, 100.0, 9.0), ("p", 1, 109.0, 1.0), ("p", 2, 131.0, 0.0), ("p", 3, 91.0, 9.0)], "page string, ord int, y double, x double")
    assert [r.ord for r in ranking.reading_order(items, "page", "y", "x", "ord").orderBy("reading").collect()] == [1, 0, 3, 2]
    assert [tuple(r) for r in ranking.cluster_mode(items, ["page"], "y", "ord", 10).collect()] == [("p", 100.0, 3)]
    rows = spark.createDataFrame([("a", "KPD", 1.0), ("a", "HWTW", 11.0), ("b", "HWTW", 15.0), ("b", "AC_depth", 7.1), ("b", "free", 1e9)], "page string, field string, value double")
    kept = filters.mutually_exclusive(rows, ["page"], "KPD", "HWTW")
    assert sorted((r.page, r.field) for r in kept.collect()) == [("a", "KPD"), ("b", "AC_depth"), ("b", "HWTW"), ("b", "free")]
    assert sorted(r.field for r in filters.within_ranges(rows, dims.ranges(spark)).collect()) == ["HWTW", "HWTW", "KPD", "free"]
    assert [r.field for r in filters.outside_ranges(rows, dims.ranges(spark)).collect()] == ["AC_depth"]


def test_exclusion_keeps_rows_without_a_field(spark):
    rows = spark.createDataFrame([("a", "KPD"), ("a", "HWTW"), ("a", None), ("b", "HWTW"), ("b", None)], "page string, field string")
    assert sorted(map(str, filters.mutually_exclusive(rows, ["page"], "KPD", "HWTW").collect())) == sorted(map(str, [r for r in rows.collect() if tuple(r) != ("a", "HWTW")]))


def test_best_values_and_pivot_share_one_shuffle(spark):
    rows = spark.createDataFrame([(1, "v", "Kmax", "SR", 45.0, 1.0), (2, "v", "Kmax", "OCR", 45.01, 0.9), (3, "w", "HWTW", "SPR", 11.0, 1.0)], "ord long, visit_id string, field string, source_type string, value double, conf float")
    out = resolve.pivot_fields(resolve.best_values(rows), ["visit_id"], ["Kmax", "HWTW"], {"value": ""})
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in out.collect()} == {("v", 45.0, None), ("w", None, 11.0)}


def test_left_band_join_keeps_nulls_and_repeats(spark):
    left = [(1, 0.0, None), (1, 0.0, None), (1, 9.0, "far"), (None, 0.0, "no key"), (2, None, "no place")]
    right = [(1, 0.5, "a"), (1, -0.5, None), (2, 0.0, "b")]
    out = joins.band_join(spark.createDataFrame(left, "k int, a double, note string"), spark.createDataFrame(right, "k int, b double, say string"), ["k"], "a", "b", 1, 1, how="left")
    want = [(1, 0.0, None, 0.5, "a"), (1, 0.0, None, -0.5, None)] * 2 + [(*r, None, None) for r in left[2:]]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_spread_of_an_exact_line_is_nothing(spark):
    rows = [("g", 1000.0 + 0.963 * x + 437.2, float(x)) for x in range(100, 2000, 37)] + [("g", 1826.1, 300.0)]
    r = regress.affine_fit(spark.createDataFrame(rows, "k string, y double, ref double"), ["k"], "y", "ref").first()
    assert r.n_inliers == len(rows) - 1 and r.alpha == pytest.approx(0.963) and r.resid_std < 1e-6


def test_long_form_takes_numbers_as_they_are(spark):
    df = spark.createDataFrame([("k", 1e-7, "2.5", float("nan"), 0.5), ("l", 1e12, "x", 3.0, None)], "k string, a double, b string, c double, a_Paddle_conf double")
    got = {(r.k, r.field): (r.value, round(r.conf, 3)) for r in resolve.to_long(df, ["k"], ["a", "b", "c"]).collect()}
    assert got == {("k", "a"): (1e-7, 0.5), ("k", "b"): (2.5, 0.0), ("l", "a"): (1e12, 0.0), ("l", "c"): (3.0, 0.0)}


def test_median_of_groups_of_any_size(spark):
    """A hot group, ties, even and odd sizes, values far apart, nulls; with little held, so several rounds are needed."""
    rng = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in rng.normal(0, 1, 3001)] + [("even", float(v)) for v in rng.uniform(0, 9, 500)] + [("same", 4.0)] * 700 + [("two", 1.0)] * 300 + [("two", 2.0)] * 300
    rows += [("far", float(10.0 ** e)) for e in range(-150, 150)] + [(None, 1.0), (None, 5.0), ("none", None), ("odd", float("nan")), ("odd", 3.0)] + [("few", 1.0), ("few", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    want = {r.g: r.m for r in df.where("not isnan(v)").groupBy("g").agg(F.median("v").alias("m")).collect()}
    for held, accuracy in ((10**6, 10_000), (50, 200), (20, 10_000)):
        got = {r.g: r.median for r in median.exact_median(df, ["g"], "v", held, accuracy).collect()}
        assert got == pytest.approx({g: m for g, m in want.items() if m is not None})
    assert median.exact_median(df.limit(0), ["g"], "v").count() == 0


def test_affine_fit_holds_no_group_in_one_task(spark):
    """The median shift has no aggregate that keeps a group's values; nulls, NaN, even and odd sizes are as F.median has them."""
    nan = float("nan")
    rows = [("a", float(i), float(i * i)) for i in range(7)] + [("b", float(i), float(-i)) for i in range(8)] + [("n", 1.0, x) for x in (1.0, 2.0, 3.0, 4.0, nan, None)]
    rows += [("m", 1.0, x) for x in (1.0, 2.0, 3.0, nan, nan, nan)] + [("z", 1.0, None)] * 6
    df = spark.createDataFrame(rows, "g string, r double, x double")
    out = regress.affine_fit(df, ["g"], "r", "r", "x", "r")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan
    want = {r.g: str(r.m) for r in df.groupBy("g").agg(F.median(F.col("x") - F.col("r")).alias("m")).collect()}
    assert {r.g: str(r.delta_x) for r in out.collect()} == want
