"""WGS84 to UTM (Krueger series, order 6) and polar stereographic, as steps of SQL arithmetic.

A step is (column, expression); each expression refers to earlier columns, so that no expression is repeated in full.
`apply` adds the steps to a DataFrame; Spark keeps them as projections in one stage.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Steps = list[tuple[str, str]]

A, FLAT, K0 = 6378137.0, 1 / 298.257223563, 0.9996
ECC = math.sqrt(FLAT * (2 - FLAT))
_n = FLAT / (2 - FLAT)
RADIUS = A / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64 + _n**6 / 256)
#: Series of Karney (2011), to order 6 of the third flattening.
ALPHA = (
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180 - 127 * _n**5 / 288 + 7891 * _n**6 / 37800,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440 + 281 * _n**5 / 630 - 1983433 * _n**6 / 1935360,
    61 * _n**3 / 240 - 103 * _n**4 / 140 + 15061 * _n**5 / 26880 + 167603 * _n**6 / 181440,
    49561 * _n**4 / 161280 - 179 * _n**5 / 168 + 6601661 * _n**6 / 7257600,
    34729 * _n**5 / 80640 - 3418889 * _n**6 / 1995840,
    212378941 * _n**6 / 319334400,
)
BETA = (
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360 - 81 * _n**5 / 512 + 96199 * _n**6 / 604800,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440 + 46 * _n**5 / 105 - 1118711 * _n**6 / 3870720,
    17 * _n**3 / 480 - 37 * _n**4 / 840 - 209 * _n**5 / 4480 + 5569 * _n**6 / 90720,
    4397 * _n**4 / 161280 - 11 * _n**5 / 504 - 830251 * _n**6 / 7257600,
    4583 * _n**5 / 161280 - 108847 * _n**6 / 3991680,
    20648693 * _n**6 / 638668800,
)
DELTA = (
    2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45 + 26 * _n**5 / 45 - 2854 * _n**6 / 675,
    7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45 + 2704 * _n**5 / 315 + 2323 * _n**6 / 945,
    56 * _n**3 / 15 - 136 * _n**4 / 35 - 1262 * _n**5 / 105 + 73814 * _n**6 / 2835,
    4279 * _n**4 / 630 - 332 * _n**5 / 35 - 399572 * _n**6 / 14175,
    4174 * _n**5 / 315 - 144838 * _n**6 / 6237,
    601676 * _n**6 / 22275,
)


def _num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)" if "e" not in repr(x) else f"CAST('{x!r}' AS DOUBLE)"


def _series(terms, form: str) -> str:
    return " + ".join(form.format(c=_num(c), j=_num(2.0 * (i + 1))) for i, c in enumerate(terms))


def utm_forward(lon: str = "lon", lat: str = "lat", zone_num: str = "zone_num", south: str = "south", east: str = "easting", north: str = "northing") -> Steps:
    """east and north, in metres, in the given zone."""
    return [
        ("p_phi", f"radians({lat})"),
        ("p_lam", f"radians({lon} - (6 * {zone_num} - 183))"),
        ("p_t", f"sinh(atanh(sin(p_phi)) - {_num(ECC)} * atanh({_num(ECC)} * sin(p_phi)))"),
        ("p_xi", "atan2(p_t, cos(p_lam))"),
        ("p_eta", "atanh(sin(p_lam) / sqrt(1 + p_t * p_t))"),
        (east, f"500000 + {_num(K0 * RADIUS)} * (p_eta + {_series(ALPHA, '{c} * cos({j} * p_xi) * sinh({j} * p_eta)')})"),
        (north, f"CASE WHEN {south} THEN 10000000 ELSE 0 END + {_num(K0 * RADIUS)} * (p_xi + {_series(ALPHA, '{c} * sin({j} * p_xi) * cosh({j} * p_eta)')})"),
    ]


def _latitude(chi: str) -> str:
    return f"degrees({chi} + {_series(DELTA, '{c} * sin({j} * ' + chi + ')')})"


def utm_inverse(east: str = "easting", north: str = "northing", zone_num: str = "zone_num", south: str = "south", lon: str = "lon", lat: str = "lat") -> Steps:
    return [
        ("q_xi", f"({north} - CASE WHEN {south} THEN 10000000 ELSE 0 END) / {_num(K0 * RADIUS)}"),
        ("q_eta", f"({east} - 500000) / {_num(K0 * RADIUS)}"),
        ("q_x", f"q_xi - ({_series(BETA, '{c} * sin({j} * q_xi) * cosh({j} * q_eta)')})"),
        ("q_e", f"q_eta - ({_series(BETA, '{c} * cos({j} * q_xi) * sinh({j} * q_eta)')})"),
        ("q_chi", "asin(sin(q_x) / cosh(q_e))"),
        (lon, f"(6 * {zone_num} - 183) + degrees(atan2(sinh(q_e), cos(q_x)))"),
        (lat, _latitude("q_chi")),
    ]


def _polar(pole: str) -> tuple[float, float, float, float]:
    """sign, standard parallel's scale, its t, central meridian"""
    lat_ts, lon0 = (70.0, -45.0) if pole == "NP" else (71.0, 0.0)
    phi = math.radians(lat_ts)
    t = math.tan(math.pi / 4 - phi / 2) / ((1 - ECC * math.sin(phi)) / (1 + ECC * math.sin(phi))) ** (ECC / 2)
    m = math.cos(phi) / math.sqrt(1 - (ECC * math.sin(phi)) ** 2)
    return (1.0 if pole == "NP" else -1.0), A * m / t, t, lon0


def polar_forward(pole: str, lon: str = "lon", lat: str = "lat", east: str = "easting", north: str = "northing") -> Steps:
    """EPSG:3413 (NP) or EPSG:3031 (SP)."""
    sign, scale, _, lon0 = _polar(pole)
    return [
        ("p_phi", f"radians({_num(sign)} * {lat})"),
        ("p_rho", f"{_num(scale)} * tan({_num(math.pi / 4)} - p_phi / 2) / pow((1 - {_num(ECC)} * sin(p_phi)) / (1 + {_num(ECC)} * sin(p_phi)), {_num(ECC / 2)})"),
        ("p_lam", f"radians({lon} - {_num(lon0)})"),
        (east, "p_rho * sin(p_lam)"),
        (north, f"{_num(-sign)} * p_rho * cos(p_lam)"),
    ]


def polar_inverse(pole: str, east: str = "easting", north: str = "northing", lon: str = "lon", lat: str = "lat") -> Steps:
    sign, scale, _, lon0 = _polar(pole)
    return [
        ("q_chi", f"{_num(math.pi / 2)} - 2 * atan(sqrt({east} * {east} + {north} * {north}) / {_num(scale)})"),
        ("q_lon", f"{_num(lon0)} + degrees(atan2({east}, {_num(-sign)} * {north}))"),
        (lon, "CASE WHEN q_lon > 180 THEN q_lon - 360 WHEN q_lon < -180 THEN q_lon + 360 ELSE q_lon END"),
        (lat, f"{_num(sign)} * ({_latitude('q_chi')})"),
    ]


_E2 = ECC * ECC
EASE_K = math.cos(math.radians(30)) / math.sqrt(1 - _E2 * math.sin(math.radians(30)) ** 2)
_Q_POLE = (1 - _E2) * (1 / (1 - _E2) - math.log((1 - ECC) / (1 + ECC)) / (2 * ECC))
#: From authalic to geodetic latitude.
AUTHALIC = (_E2 / 3 + 31 * _E2**2 / 180 + 517 * _E2**3 / 5040, 23 * _E2**2 / 360 + 251 * _E2**3 / 3780, 761 * _E2**3 / 45360)


def ease_forward(lon: str = "lon", lat: str = "lat", east: str = "easting", north: str = "northing") -> Steps:
    """EPSG:6933, cylindrical equal-area with its true scale at 30 degrees."""
    return [
        ("p_s", f"sin(radians({lat}))"),
        ("p_q", f"{_num(1 - _E2)} * (p_s / (1 - {_num(_E2)} * p_s * p_s) - ln((1 - {_num(ECC)} * p_s) / (1 + {_num(ECC)} * p_s)) / {_num(2 * ECC)})"),
        (east, f"{_num(A * EASE_K)} * radians({lon})"),
        (north, f"{_num(A / (2 * EASE_K))} * p_q"),
    ]


def ease_inverse(east: str = "easting", north: str = "northing", lon: str = "lon", lat: str = "lat") -> Steps:
    return [
        ("q_b", f"asin(greatest({_num(-1.0)}, least({_num(1.0)}, {_num(2 * EASE_K / (A * _Q_POLE))} * {north})))"),
        (lon, f"degrees({east} / {_num(A * EASE_K)})"),
        (lat, f"degrees(q_b + {_series(AUTHALIC, '{c} * sin({j} * q_b)')})"),
    ]


def apply(df: DataFrame, steps: Steps, results: tuple[str, ...] = ()) -> DataFrame:
    """df with the steps' last results; helper columns p_ and q_ are dropped.

    Results named here leave through a generator of one row: a filter on them then stays above it, where it reads two
    numbers, and is not pushed below with the whole chain of arithmetic written out in it many times over.
    """
    for name, text in steps:
        df = df.withColumn(name, F.expr(text))
    df = df.drop(*(name for name, _ in steps if name[:2] in ("p_", "q_")))
    if not results:
        return df
    return df.select(*(c for c in df.columns if c not in results), F.inline(F.array(F.struct(*results))))
