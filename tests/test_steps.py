"""Resumed selections, size-bounded areas."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapane.operators import grid, select
from terrapane.scratch import StepLog


def mixes(spark, n=900, seed=3):
    shares = np.random.default_rng(seed).dirichlet(np.full(len(select.CLASSES), 0.3), n)
    rows = [(f"G1200m_31N_X{i:06d}_Y000001", *map(float, s), float(i % 17)) for i, s in enumerate(shares)]
    return spark.createDataFrame(rows, "tile_id string, " + ", ".join(f"{c} double" for c in select.CLASSES) + ", entropy double").repartition(3)


class Killed(Exception):
    pass


def test_a_killed_selection_goes_on_to_the_same_picks(spark, tmp_path, monkeypatch):
    tiles, n = mixes(spark), len(select.CLASSES)
    targets, sizes = {"small": [1 / n] * n, "large": [2 / n] * 3 + [(1 - 6 / n) / (n - 3)] * (n - 3)}, {"small": 90, "large": 240}
    of = lambda log: sorted(tuple(r) for r in select.select_subsets(tiles, targets, sizes, 5, 100, 7, log).collect())
    want = of(str(tmp_path / "whole"))
    assert len(want) == len(set(want)) and Counter(r[1] for r in want)["large"] >= 0.9 * 240 - 12
    step, log = StepLog.step, str(tmp_path / "killed")
    for alive in (2, 3, 5, 7):  # steps of each attempt that end before it is killed; the first is the parameters
        made = Counter()

        def dying(self, name, make):
            def counted():
                if made["n"] >= alive:  # noqa: B023
                    raise Killed(name)
                made["n"] += 1  # noqa: B023
                return make()

            return step(self, name, counted)

        monkeypatch.setattr(StepLog, "step", dying)
        try:
            of(log)
        except Killed:
            continue
        break
    monkeypatch.setattr(StepLog, "step", step)
    assert of(log) == want
    monkeypatch.setattr(select, "phase_three", None)  # a complete log makes nothing anew
    assert of(log) == want
    with pytest.raises(ValueError, match="other parameters"):
        select.select_subsets(tiles, targets, sizes, 6, 100, 7, log)


def test_no_area_is_above_the_bound(spark):
    rng = np.random.default_rng(9)
    dense = [("31N", 300, int(x), int(y)) for x, y in rng.normal(2_000, 15, (1_500, 2))]
    wide = [("31N", 300, int(x), int(y)) for x, y in rng.integers(0, 2_600, (400, 2))]
    south = [("5S", 300, int(x), -int(y) - 1) for x, y in rng.integers(0, 2_600, (300, 2))]
    same = [("9N", 300, 5, 5)] * 130 + [("9N", 1200, 1, 1)]
    rows = dense + wide + south + same
    tiles = spark.createDataFrame(rows, "zone string, level int, x_idx long, y_idx long")
    got = grid.bounded_parts(tiles, 50).collect()
    assert sorted((r.zone, r.level, r.x_idx, r.y_idx) for r in got) == sorted(rows)
    n = Counter((r.zone, r.level, r.part) for r in got)
    assert max(n.values()) <= 50 and n["9N", 1200, "0:0"] == 1
    assert sum(k[0] == "9N" and k[1] == 300 for k in n) == 3  # 130 equal tiles: 50 + 50 + 30
    boxes = {}
    for r in got:
        a = boxes.setdefault((r.zone, r.level, r.part.split(":")[0], r.part.split(":")[1]), [r.x_idx, r.x_idx, r.y_idx, r.y_idx])
        boxes[r.zone, r.level, r.part.split(":")[0], r.part.split(":")[1]] = [min(a[0], r.x_idx), max(a[1], r.x_idx), min(a[2], r.y_idx), max(a[3], r.y_idx)]
    for (_, _, depth, _), (x0, x1, y0, y1) in boxes.items():  # an area is within its square
        side = 1 << (grid.PART_BITS - int(depth))
        assert x0 // side == x1 // side and y0 // side == y1 // side
    assert grid.bounded_parts(tiles.limit(0), 50).count() == 0
    few = grid.bounded_parts(tiles.where(F.col("zone") == "5S"), 1_000).select("part").distinct().collect()
    assert [r.part for r in few] == ["0:0"]
