"""Coverings of boxes of degrees by spherical cells: six faces of a cube, quartered level by level along a Hilbert curve.

A cell is (face, i, j) at a level, and its id holds the face and the curve's position. A covering descends from the faces:
each level explodes the cells that meet the box to their quarters and keeps those that do, so the work follows the
covering and not the sphere. The test is exact: a cell and a box meet if a corner of one is in the other, or an edge of the
cell (an arc of a great circle) crosses a meridian or a parallel of the box. Its arithmetic is some 300 steps, too long for
one compiled method of Spark, so `cover` does the same steps on arrays of cells, in tasks; `meets_box` is them as SQL text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapane.functions import projection

#: The place (2 i + j) of each position of the curve in each orientation, and how a position turns it.
PLACES = (0, 1, 3, 2, 0, 2, 3, 1, 3, 2, 0, 1, 3, 1, 0, 2)
TURNS = (1, 0, 0, 3)
FINEST = 30
CUT = 6  # levels of a descent in one task, after which the cells are spread over tasks anew
CHUNK = 16_384  # cells tested at once
SLACK = 1e-6  # radians by which a cap of a cell may miss one of a box and is still tested
#: X, y, z of (u, v) on each face, and u, v, depth of (x, y, z) as seen from it.
TO_XYZ = (("1", "u", "v"), ("-u", "1", "v"), ("-u", "-v", "1"), ("-1", "-v", "-u"), ("v", "-1", "-u"), ("v", "u", "-1"))
TO_UV = (("y", "z", "x"), ("-x", "z", "y"), ("-x", "-y", "z"), ("-z", "-y", "-x"), ("-z", "x", "-y"), ("y", "x", "-z"))


def _by_face(values) -> str:
    return "CASE face " + " ".join(f"WHEN {f} THEN {v}" for f, v in enumerate(values)) + " END"


def _uv(s: str) -> str:
    """The cube's coordinate of a place from 0 to 1 on a face, which makes cells nearly equal in area."""
    return f"(CASE WHEN {s} >= 0.5 THEN (4 * {s} * {s} - 1) / 3 ELSE (1 - 4 * (1 - {s}) * (1 - {s})) / 3 END)"


def _in_longitudes(x: str) -> str:
    return f"(CASE WHEN west <= east THEN {x} >= west AND {x} <= east ELSE {x} >= west OR {x} <= east END)"


def _within(x: str, low: str, high: str) -> str:
    return f"({x} >= {low} AND {x} <= {high})"


def meets_box(level: str = "level", hit: str = "hit") -> projection.Steps:
    """hit: does the cell (face, i, j, level) meet the closed box (west, south, east, north; over 180 degrees if west > east)?"""
    one = f"pow(CAST(2 AS DOUBLE), {level})"
    steps = [(f"p_s{n}", f"({c} + {k}) / {one}") for n, c, k in (("i0", "i", 0), ("i1", "i", 1), ("j0", "j", 0), ("j1", "j", 1))]
    steps += [(f"p_{n}", _uv(f"p_s{n}")) for n in ("i0", "i1", "j0", "j1")]
    corners = (("i0", "j0"), ("i1", "j0"), ("i1", "j1"), ("i0", "j1"))
    for k, (u, v) in enumerate(corners):
        for axis, c in enumerate("xyz"):
            named = [xyz[axis].replace("u", f"p_{u}").replace("v", f"p_{v}") for xyz in TO_XYZ]
            steps.append((f"p_{c}{k}", f"CAST({_by_face(named)} AS DOUBLE)"))
    tests = []
    for k in range(4):  # a corner of the cell in the box
        steps += [(f"p_lon{k}", f"degrees(atan2(p_y{k}, p_x{k}))"), (f"p_lat{k}", f"degrees(atan2(p_z{k}, sqrt(p_x{k} * p_x{k} + p_y{k} * p_y{k})))")]
        tests.append(f"({_within(f'p_lat{k}', 'south', 'north')} AND {_in_longitudes(f'p_lon{k}')})")
    for k, (lon, lat) in enumerate((("west", "south"), ("west", "north"), ("east", "south"), ("east", "north"))):  # a corner of the box in the cell
        steps += [(f"p_bx{k}", f"cos(radians({lat})) * cos(radians({lon}))"), (f"p_by{k}", f"cos(radians({lat})) * sin(radians({lon}))"), (f"p_bz{k}", f"sin(radians({lat}))")]
        for axis, name in enumerate(("bu", "bv", "bw")):
            named = [uv[axis].replace("x", f"p_bx{k}").replace("y", f"p_by{k}").replace("z", f"p_bz{k}") for uv in TO_UV]
            steps.append((f"p_{name}{k}", _by_face(named)))
        inner = [_within(f"p_{b}{k}", f"p_{c}0 * p_bw{k}", f"p_{c}1 * p_bw{k}") for b, c in (("bu", "i"), ("bv", "j"))]
        tests.append(f"(p_bw{k} > 0 AND {' AND '.join(inner)})")
    for k in range(4):  # an edge of the cell, as p + t * d
        n = (k + 1) % 4
        p, d = [f"p_{c}{k}" for c in "xyz"], [f"p_d{c}{k}" for c in "xyz"]
        steps += [(f"p_d{c}{k}", f"p_{c}{n} - p_{c}{k}") for c in "xyz"]
        dot = lambda a, b: "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"
        for side, lon in (("w", "west"), ("e", "east")):  # a meridian's plane is met once
            t = f"p_t{side}{k}"
            away = lambda q: f"(cos(radians({lon})) * {q[1]} - sin(radians({lon})) * {q[0]})"  # noqa: B023, E731
            steps += [(f"{t}a", away(p)), (f"{t}b", away(d)), (t, f"CASE WHEN {t}b <> 0 THEN - {t}a / {t}b END")]
            steps += [(f"{t}{c}", f"{a} + {t} * {b}") for c, a, b in zip("xyz", p, d, strict=True)]
            steps.append((f"{t}l", f"degrees(atan2({t}z, sqrt({t}x * {t}x + {t}y * {t}y)))"))
            tests.append(f"coalesce({_within(t, '0', '1')} AND cos(radians({lon})) * {t}x + sin(radians({lon})) * {t}y > 0 AND {_within(f'{t}l', 'south', 'north')}, false)")
        for side, lat in (("s", "south"), ("n", "north")):  # a parallel's cone is met twice at most
            a, b, c, e = (f"p_{x}{side}{k}" for x in ("qa", "qb", "qc", "qe"))
            square = f"(sin(radians({lat})) * sin(radians({lat})))"
            steps += [(a, f"{d[2]} * {d[2]} - {square} * {dot(d, d)}"), (b, f"2 * ({p[2]} * {d[2]} - {square} * {dot(p, d)})"), (c, f"{p[2]} * {p[2]} - {square} * {dot(p, p)}"), (e, f"{b} * {b} - 4 * {a} * {c}")]
            for sign in "+-":
                t = f"p_t{side}{k}{'p' if sign == '+' else 'm'}"
                steps.append((t, f"CASE WHEN {e} >= 0 THEN CASE WHEN {a} = 0 THEN CASE WHEN {b} <> 0 THEN - {c} / {b} END ELSE (- {b} {sign} sqrt({e})) / (2 * {a}) END END"))
                x, y, z = (f"({q} + {t} * {r})" for q, r in zip(p, d, strict=True))
                steps.append((f"{t}l", f"degrees(atan2({y}, {x}))"))
                tests.append(f"coalesce({_within(t, '0', '1')} AND {z} * {lat} >= 0 AND {_in_longitudes(f'{t}l')}, false)")
    return [*steps, (hit, " OR ".join(tests))]


def layers(steps: projection.Steps) -> list[projection.Steps]:
    """Steps in as few layers as their uses of each other allow; those of a layer are one projection."""
    place: dict[str, int] = {}
    for name, text in steps:
        place[name] = 1 + max((place[w] for w in re.findall(r"\w+", text) if w in place), default=-1)
    return [[x for x in steps if place[x[0]] == i] for i in range(max(place.values()) + 1)]


def cell_id(face: Column, place: Column, level: Column) -> Column:
    """64 bits: face, two for each level's position, a one, zeros."""
    shifted = F.call_function("shiftleft", place, (2 * (FINEST - level) + 1).cast("int"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (2 * (FINEST - level)).cast("int"))
    return F.shiftleft(face.cast("long"), 61).bitwiseOR(shifted).bitwiseOR(one)


def _signed(texts: tuple[tuple[str, ...], ...], names: str) -> tuple[np.ndarray, np.ndarray]:
    """Texts such as -u by face, as places in names and signs."""
    return np.array([[names.index(t[-1]) for t in each] for each in texts]), np.array([[-1.0 if t[0] == "-" else 1.0 for t in each] for each in texts])


XYZ_AT, XYZ_SIGN = _signed(TO_XYZ, "1uv")
UV_AT, UV_SIGN = _signed(TO_UV, "xyz")
BOUNDS = ("west", "south", "east", "north")


class Boxes:
    """Boxes of degrees with what the tests need of each: sines and cosines of the bounds, and a cap around the box."""

    def __init__(self, bounds: np.ndarray):
        self.bounds, (west, south, east, north) = bounds, bounds
        self.sin, self.cos = np.sin(np.radians(bounds)), np.cos(np.radians(bounds))
        across, up = np.where(west <= east, east - west, east - west + 360) / 2, (north - south) / 2
        lon, lat = np.radians(west + across), np.radians(south + up)
        self.centre = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
        # from the centre any point is reached along the meridian and then a parallel
        widest = np.where((south <= 0) & (north >= 0), 1.0, np.maximum(self.cos[1], self.cos[3]))
        self.radius = np.radians(up + np.maximum(across, 0) * widest)

    def take(self, at: np.ndarray) -> Boxes:
        out = object.__new__(Boxes)
        out.__dict__ = {name: value[..., at] for name, value in self.__dict__.items()}
        return out


def _spot(face: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    uv = np.stack([np.ones_like(u), u, v])
    return uv[XYZ_AT[face].T, np.arange(len(face))] * XYZ_SIGN[face].T


def _curved(s: np.ndarray) -> np.ndarray:
    return np.where(s >= 0.5, (4 * s * s - 1) / 3, (1 - 4 * (1 - s) * (1 - s)) / 3)


def _near(face: np.ndarray, i: np.ndarray, j: np.ndarray, level: int, boxes: Boxes) -> np.ndarray:
    """False only for cells that lie apart from the box: the caps around both do not touch. A cap of less than half the sphere that holds a cell's corners holds the cell."""
    one = 2.0**level
    unit = lambda a, b: (lambda p: p / np.sqrt((p * p).sum(0)))(_spot(face, _curved((i + a) / one), _curved((j + b) / one)))
    middle = unit(0.5, 0.5)
    angle = lambda p, q: 2 * np.arcsin(np.minimum(1.0, np.sqrt(((p - q) ** 2).sum(0)) / 2))
    radius = np.max([angle(middle, unit(a, b)) for a in (0, 1) for b in (0, 1)], axis=0)
    return angle(middle, boxes.centre) <= radius + boxes.radius + SLACK


def _meets(face: np.ndarray, i: np.ndarray, j: np.ndarray, level: int, boxes: Boxes) -> np.ndarray:
    """The steps of meets_box on arrays."""
    one, (west, south, east, north) = 2.0**level, boxes.bounds
    plain = west <= east
    in_lons = lambda x: np.where(plain, (x >= west) & (x <= east), (x >= west) | (x <= east))
    in_lats = lambda x: (x >= south) & (x <= north)
    latitude = lambda p: np.degrees(np.arctan2(p[2], np.sqrt(p[0] * p[0] + p[1] * p[1])))
    us, vs = ([_curved((c + k) / one) for k in (0, 1)] for c in (i, j))
    longitude = lambda p: np.degrees(np.arctan2(p[1] + 0.0, p[0] + 0.0))  # as Spark's atan2: -0.0 is 0.0
    corners = [_spot(face, us[a], vs[b]) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
    hit = np.zeros(len(face), bool)
    for p in corners:  # a corner of the cell in the box
        hit |= in_lats(latitude(p)) & in_lons(longitude(p))
    for lon, lat in ((0, 1), (0, 3), (2, 1), (2, 3)):  # a corner of the box in the cell
        b = np.stack([boxes.cos[lat] * boxes.cos[lon], boxes.cos[lat] * boxes.sin[lon], boxes.sin[lat]])
        bu, bv, bw = b[UV_AT[face].T, np.arange(len(face))] * UV_SIGN[face].T
        hit |= (bw > 0) & (bu >= us[0] * bw) & (bu <= us[1] * bw) & (bv >= vs[0] * bw) & (bv <= vs[1] * bw)
    for k, p in enumerate(corners):  # an edge of the cell, as p + t * d
        d = corners[(k + 1) % 4] - p
        for m in (0, 2):  # a meridian's plane is met once
            cos, sin = boxes.cos[m], boxes.sin[m]
            away = cos * d[1] - sin * d[0]
            t = np.where(away != 0, -(cos * p[1] - sin * p[0]) / away, np.nan)
            q = p + t * d
            hit |= (t >= 0) & (t <= 1) & (cos * q[0] + sin * q[1] > 0) & in_lats(latitude(q))
        dots = [x[0] * y[0] + x[1] * y[1] + x[2] * y[2] for x, y in ((d, d), (p, d), (p, p))]
        for m in (1, 3):  # a parallel's cone is met twice at most
            square = boxes.sin[m] * boxes.sin[m]
            a, b, c = d[2] * d[2] - square * dots[0], 2 * (p[2] * d[2] - square * dots[1]), p[2] * p[2] - square * dots[2]
            e = b * b - 4 * a * c
            for sign in (1.0, -1.0):
                t = np.where(a == 0, np.where(b != 0, -c / b, np.nan), (-b + sign * np.sqrt(e)) / (2 * a))
                q = p + t * d
                hit |= (e >= 0) & (t >= 0) & (t <= 1) & (q[2] * boxes.bounds[m] >= 0) & in_lons(longitude(q))
    return hit


def _descend(boxes: Boxes, state: tuple[np.ndarray, ...], first: int, last: int) -> Iterator[tuple[np.ndarray, ...]]:
    """state (box, face, i, j, turn, place) of candidates at a level to those of the last level that meet their boxes, in pieces. Depth first, so that what is held is a few pieces for each level."""
    waiting = [(first, state)]
    places, turns = np.array(PLACES), np.array(TURNS)
    while waiting:
        depth, state = waiting.pop()
        if len(state[0]) > CHUNK:
            waiting += [(depth, tuple(c[at : at + CHUNK] for c in state)) for at in range(0, len(state[0]), CHUNK)]
            continue
        for test in (_near, _meets):
            box, face, i, j, _, _ = state
            found = test(face, i, j, depth, boxes.take(box))
            state = tuple(c[found] for c in state)
        if depth == last:
            if len(state[0]):
                yield state
        elif len(state[0]):
            box, face, i, j, turn, place = (np.repeat(c, 4) for c in state)
            p = np.tile(np.arange(4), len(state[0]))
            at = places[turn * 4 + p]
            waiting.append((depth + 1, (box, face, i * 2 + (at >> 1), j * 2 + (at & 1), turn ^ turns[p], place * 4 + p)))


def cover(boxes: DataFrame, level: int, keys: tuple[str, ...] = ("box_id",)) -> DataFrame:
    """boxes (keys, west, south, east, north) to the cells of the level that meet them: keys, face, i, j, level, cell_id. Boxes with null or NaN bounds, or south > north, have none."""
    state = ("face", "i", "j", "turn", "place")
    known = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in BOUNDS)
    rows = boxes.select(*keys, *(F.col(c).cast("double").alias(c) for c in BOUNDS)).where(f"{known} AND south <= north")
    held = [*keys, *BOUNDS]
    cells = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in state)])

    def descent(first: int, last: int):
        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, column = batch.num_rows, lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023
                if first:
                    at = (np.arange(n), *(column(c) for c in state))
                else:
                    face = np.tile(np.arange(6), n)
                    at = (np.repeat(np.arange(n), 6), face, np.zeros(6 * n, np.int64), np.zeros(6 * n, np.int64), face & 1, np.zeros(6 * n, np.int64))
                with np.errstate(all="ignore"):
                    for box, *found in _descend(Boxes(np.stack([column(c) for c in BOUNDS])), at, first, last):
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(box)) for c in held), *map(pa.array, found)], [*held, *state])

        return descend

    for first in range(0, level + 1, CUT):
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = rows.repartition(n, *BOUNDS, *(("face", "i", "j") if first else keys))
        rows = spread.mapInArrow(descent(first, min(first + CUT - 1, level)), cells)
        # after a cut the candidates are quarters of what was found
        if first + CUT <= level:
            quarters = rows.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
            at = F.element_at(F.array(*map(F.lit, PLACES)), (F.col("turn") * 4 + F.col("p") + 1).cast("int"))
            turn = F.element_at(F.array(*map(F.lit, TURNS)), (F.col("p") + 1).cast("int"))
            rows = quarters.withColumn("at", at).select(*held, "face", (F.col("i") * 2 + F.shiftright("at", 1)).alias("i"), (F.col("j") * 2 + F.col("at").bitwiseAND(F.lit(1))).alias("j"), F.col("turn").bitwiseXOR(turn).alias("turn"), (F.col("place") * 4 + F.col("p")).alias("place"))
    return rows.select(*keys, F.col("face").cast("int").alias("face"), "i", "j", F.lit(level).alias("level"), cell_id(F.col("face"), F.col("place"), F.lit(level)).alias("cell_id"))
