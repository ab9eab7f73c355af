"""Geodesics against a numerical integration, lattices and grids over tasks."""

import math

import pytest
from pyspark.sql import functions as F

from terrapane.dims import zone_table
from terrapane.functions import geodesic, projection
from terrapane.operators import grid

A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)


def plain_direct(lon, lat, azimuth, metres, n=4_000):
    """Runge-Kutta over the equations of a geodesic."""

    def slope(s):
        phi, _, az = s
        w = 1 - E2 * math.sin(phi) ** 2
        return math.cos(az) * w**1.5 / (A * (1 - E2)), math.sin(az) * w**0.5 / (A * math.cos(phi)), math.sin(az) * math.tan(phi) * w**0.5 / A

    state, h = (math.radians(lat), math.radians(lon), math.radians(azimuth)), metres / n
    for _ in range(n):
        k1 = slope(state)
        k2 = slope([a + h / 2 * b for a, b in zip(state, k1, strict=True)])
        k3 = slope([a + h / 2 * b for a, b in zip(state, k2, strict=True)])
        k4 = slope([a + h * b for a, b in zip(state, k3, strict=True)])
        state = tuple(a + h / 6 * (p + 2 * q + 2 * r + s) for a, p, q, r, s in zip(state, k1, k2, k3, k4, strict=True))
    return math.degrees(state[1]), math.degrees(state[0])


def apart(a, b):
    """Metres between two near points (lon, lat)."""
    return math.hypot((a[0] - b[0]) * math.cos(math.radians(a[1])), a[1] - b[1]) * 111_320


def test_direct_is_within_a_millimetre(spark):
    cases = [(lon, lat, az, d) for lon, lat in ((0.0, 0.0), (5.0, 51.0), (-120.0, -33.3), (30.0, 70.0)) for az in (0.0, 17.0, 90.0, 180.0, 211.5) for d in (1.0, 1_000.0, 100_000.0, 1_500_000.0)]
    df = spark.createDataFrame(cases, "lon double, lat double, azimuth double, metres double")
    rows = projection.apply(df, geodesic.direct()).collect()
    assert max(apart((r.to_lon, r.to_lat), plain_direct(r.lon, r.lat, r.azimuth, r.metres)) for r in rows if abs(r.to_lat) < 85) < 1e-3


def test_meridian_series_agree_with_the_direct_problem(spark):
    df = spark.createDataFrame([(lat,) for lat in (-80.0, -45.0, 0.0, 10.0, 45.0, 79.0)], "lat double")
    there = projection.apply(df, geodesic.meridian_forward())
    back = projection.apply(there.withColumnRenamed("lat", "was"), geodesic.meridian_inverse()).collect()
    assert all(abs(r.lat - r.was) < 1e-9 for r in back)
    ends = [(0.0, 0.0, 0.0 if r.metres >= 0 else 180.0, abs(r.metres), r.was) for r in back]
    df = spark.createDataFrame(ends, "lon double, lat double, azimuth double, metres double, was double")
    assert all(abs(r.to_lat - r.was) * 111_320 < 1e-3 for r in projection.apply(df, geodesic.direct()).collect())


def test_lattice_points_are_a_step_apart(spark):
    bounds = spark.createDataFrame([("a", 5.0, 50.0, 9.0, 53.0), ("s", -1.0, -41.0, 1.0, -39.5), ("one", 1.0, 1.0, 1.0, 1.0)], "k string, west double, south double, east double, north double")
    points = {(r.k, r.row, r.col): (r.lon, r.lat) for r in grid.ellipsoid_lattice(bounds, 50_000.0).collect()}
    assert points["one", 0, 0] == pytest.approx((1.0, 1.0)) and sum(k[0] == "one" for k in points) == 1
    for (k, r, c), p in points.items():
        if (k, r + 1, 0) in points and c == 0:
            assert apart(plain_direct(*p, 0.0, 50_000.0, 400), points[k, r + 1, 0]) < 1e-3
        if (k, r, c + 1) in points:  # the row's step ends on the geodesic's longitude
            assert abs(plain_direct(*p, 90.0, 50_000.0, 400)[0] - points[k, r, c + 1][0]) * 111_320 < 1e-3


def test_one_region_or_pole_fills_many_tasks(spark):
    poles = spark.createDataFrame([("NP",), ("SP",)], "zone string")
    few, many = grid.polar_grid(poles, 120_000), grid.polar_grid(poles, 2_400)
    assert few.rdd.getNumPartitions() <= 2 < 6 <= many.rdd.getNumPartitions()
    bounds = spark.createDataFrame([(0.0, 0.0, 5.0, 5.0)], "west double, south double, east double, north double")
    for made in (grid.ellipsoid_lattice(bounds, 20_000.0), grid.geodesic_lattice(bounds, 20_000.0)):
        used = made.groupBy(F.spark_partition_id()).count().count()
        assert used >= 4


def test_border_tiles_come_from_one_pass(spark):
    zones = zone_table(spark).where("zone IN ('31N', '60S')")
    made = grid.utm_grid(zones, 120_000)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and made.count() == made.dropDuplicates(["zone", "x_idx", "y_idx"]).count() > grid.utm_grid(zones, 120_000, border=False).count()
