"""Queries whose sizes come from the table, on one that is larger than the tests' usual one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom import catalog
from terraloom.plans.base import grid, pairs

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("name", "shift"), [
    ("dt1_datum_conversion", lambda r, c: r / 8 * 0.4 + c / 8 * 0.55),
    ("sk15_surface_to_egm2008_dt4", lambda r, c: 0.4 - 0.001 * r),
])
def test_every_pixel_is_converted(spark, name, shift):
    want = {(r["row"], r["col"]): r["v"] for r in grid(spark, SF).select("row", "col", "v").collect()}
    got = {(r["row"], r["col"]): r["h"] for r in catalog.queries()[name](spark, SF).collect()}
    assert got.keys() == want.keys() and max(r for r, _ in got) > 600
    assert all((v is None) == (want[k] is None) and (v is None or abs(v - want[k] - shift(*k)) < 2e-5) for k, v in got.items())


def test_resize_reaches_the_last_rows(spark):
    from terraloom.plans.joins import coarse

    k = {(r["row"], r["col"]): r["v"] for r in coarse(spark, SF).collect()}
    got = {(r["row"], r["col"]): r["v"] for r in catalog.queries()["rs1_bilinear_resize"](spark, SF).collect()}
    rows, cols = (max(p[i] for p in grid(spark, SF).select("row", "col").collect()) + 1 for i in (0, 1))
    assert len(got) == 800
    for (y, x), v in got.items():
        fr, fc = (y + 0.5) * (rows // 8) / 40 - 0.5, (x + 0.5) * (cols // 8) / 20 - 0.5
        r0, c0 = int(fr // 1), int(fc // 1)
        near = [(k.get((r, c)), (1 - abs(fr - r)) * (1 - abs(fc - c))) for r in (r0, r0 + 1) for c in (c0, c0 + 1)]
        near = [(m, w) for m, w in near if m is not None and w > 0]
        assert v is not None and abs(v - sum(m * w for m, w in near) / sum(w for _, w in near)) < 2e-6, (y, x)


def test_seams_of_a_thousand_edges(spark):
    from terraloom.operators import tiles

    at = list(range(150, 150_150, 150))
    step = lambda r: float((r * 7919) % 1009)
    profile = spark.range(150_150).select(F.col("id").alias("row"), ((F.col("id") * 7919) % 1009).cast("double").alias("step"))
    s = tiles.seam_stats(profile, at, 4, 6)
    # one filter an edge made a plan of a thousand levels
    assert len(s._jdf.queryExecution().analyzed().toString()) < 20_000
    got = {r["edge"]: (r["peak"], r["control_p95"]) for r in s.collect()}
    far = [step(r) for r in range(150_150) if 10 < r % 150 < 140 or r < 140]
    control = pytest.approx(float(np.quantile(far, 0.95)))
    assert got == {e: (max(step(r) for r in range(e - 6, min(e + 7, 150_150))), control) for e in at}


def test_sun_is_found_once_a_place(spark, tmp_path):
    # 40 customers at each of 1440 places: all get a row, the sun's minutes stay those of the places
    path = f"file://{tmp_path}"
    spark.range(1, 57_601).select(F.col("id").alias("c_custkey")).write.parquet(f"{path}/customer.parquet")
    df = catalog.queries()["tk3_time_for_azimuth"](spark, path)
    got = {r["id"]: r["t"] for r in df.collect()}
    want = [k for k in range(1, 57_601) if abs(k * 53 % 160 - 80 + 0.375) < 55]
    assert sorted(got) == want and all(got[k] == got[(k - 1) % 1440 + 1] for k in want)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ASIN") <= 2


def test_histogram_limits_without_a_group_in_memory(spark, monkeypatch):
    small = "/root/testdata/sf0.001"
    e = [abs(r["p"] - r["q"]) for r in pairs(spark, small).collect()]
    monkeypatch.setattr(F, "percentile", None)
    got = catalog.queries()["sk9_fit_plot_histogram"](spark, small).collect()
    assert sum(r["n"] for r in got) == sum(x <= np.quantile(e, 0.99) for x in e) and all(0 <= r["bin"] < 60 for r in got)
