"""Steps over the ellipsoid as SQL arithmetic: the direct geodesic problem and distances along a meridian.

Steps are as in `projection`: (column, expression), each of which may use those before it.
"""

from __future__ import annotations

from terrapane.functions.projection import FLAT, RADIUS, A, Steps, _n, _num, _series

B = A * (1 - FLAT)
ROUNDS = 6  # of the arc's correction; each gains about three digits, also for half around the earth
#: Series in the third flattening: from latitude to the meridian's angle, and back.
TO_ARC = (-3 * _n / 2 + 9 * _n**3 / 16, 15 * _n**2 / 16 - 15 * _n**4 / 32, -35 * _n**3 / 48, 315 * _n**4 / 512)
FROM_ARC = (3 * _n / 2 - 27 * _n**3 / 32, 21 * _n**2 / 16 - 55 * _n**4 / 32, 151 * _n**3 / 96, 1097 * _n**4 / 512)


def meridian_forward(lat: str = "lat", metres: str = "metres") -> Steps:
    """Metres along the meridian from the equator."""
    arc = f"p_{metres}"
    return [(arc, f"radians({lat})"), (metres, f"{_num(RADIUS)} * ({arc} + {_series(TO_ARC, '{c} * sin({j} * ' + arc + ')')})")]


def meridian_inverse(metres: str = "metres", lat: str = "lat") -> Steps:
    return [("q_m", f"{metres} / {_num(RADIUS)}"), (lat, f"degrees(q_m + {_series(FROM_ARC, '{c} * sin({j} * q_m)')})")]


def direct(lon: str = "lon", lat: str = "lat", azimuth: str = "azimuth", metres: str = "metres", to_lon: str = "to_lon", to_lat: str = "to_lat") -> Steps:
    """Where a geodesic of so many metres ends (Vincenty's series, with a fixed number of rounds). to_lon goes on beyond 180."""
    one_f, squeeze = _num(1 - FLAT), _num((A * A - B * B) / (B * B))
    steps = [
        ("p_azi", f"radians({azimuth})"),
        ("p_u", f"atan({one_f} * tan(radians({lat})))"),
        ("p_s1", "atan2(tan(p_u), cos(p_azi))"),
        ("p_sa", "cos(p_u) * sin(p_azi)"),
        ("p_ca", "1 - p_sa * p_sa"),
        ("p_sq", f"p_ca * {squeeze}"),
        ("p_a", "1 + p_sq / 16384 * (4096 + p_sq * (-768 + p_sq * (320 - 175 * p_sq)))"),
        ("p_b", "p_sq / 1024 * (256 + p_sq * (-128 + p_sq * (74 - 47 * p_sq)))"),
        ("p_arc", f"{metres} / ({_num(B)} * p_a)"),
        ("p_r0", "p_arc"),
    ]
    for i in range(1, ROUNDS + 1):
        r, m = f"p_r{i - 1}", f"p_m{i}"
        steps.append((m, f"cos(2 * p_s1 + {r})"))
        steps.append((f"p_r{i}", f"p_arc + p_b * sin({r}) * ({m} + p_b / 4 * (cos({r}) * (2 * {m} * {m} - 1) - p_b / 6 * {m} * (4 * sin({r}) * sin({r}) - 3) * (4 * {m} * {m} - 3)))"))
    r = f"p_r{ROUNDS}"
    return [
        *steps,
        ("p_mid", f"cos(2 * p_s1 + {r})"),
        ("p_x", f"sin(p_u) * sin({r}) - cos(p_u) * cos({r}) * cos(p_azi)"),
        ("p_lam", f"atan2(sin({r}) * sin(p_azi), cos(p_u) * cos({r}) - sin(p_u) * sin({r}) * cos(p_azi))"),
        ("p_c", f"{_num(FLAT / 16)} * p_ca * (4 + {_num(FLAT)} * (4 - 3 * p_ca))"),
        (to_lat, f"degrees(atan2(sin(p_u) * cos({r}) + cos(p_u) * sin({r}) * cos(p_azi), {one_f} * sqrt(p_sa * p_sa + p_x * p_x)))"),
        (to_lon, f"{lon} + degrees(p_lam - (1 - p_c) * {_num(FLAT)} * p_sa * ({r} + p_c * sin({r}) * (p_mid + p_c * cos({r}) * (2 * p_mid * p_mid - 1))))"),
    ]
