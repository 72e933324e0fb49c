"""Seats from motion against a plain version: sums over all lags and cells, breadth-first labelling."""

import math

import numpy as np
import pytest

from seatwatch.config import DEFAULTS as P
from seatwatch.operators import motion_seats
from seatwatch.plans.queries import QUERIES
from seatwatch.plans.views import Views


def plain_pitch(x):
    h, w = len(x), len(x[0])
    mean = sum(map(sum, x)) / (h * w)
    c = [[v - mean for v in r] for r in x]
    whole = sum(v * v for r in c for v in r)
    if whole == 0:
        return 4.0, 4.0
    down = [round(sum(c[i][j] * c[i + d][j] for i in range(h - d) for j in range(w)) / whole, 9) for d in range(h)]
    across = [round(sum(c[i][j] * c[i][j + d] for i in range(h) for j in range(w - d)) / whole, 9) for d in range(w)]

    def first(a):
        for lag in range(3, min(len(a), 40) - 1):
            if a[lag] > a[lag - 1] and a[lag] >= a[lag + 1]:
                return float(lag)
        return 4.0

    return first(down), first(across)


def plain_seats(x):
    h, w = len(x), len(x[0])
    py, px = plain_pitch(x)
    sigma = max(0.6, min(py, px) / 3)
    reach = int(4 * sigma + 0.5)
    bell = {d: math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)}
    total = sum(bell.values())

    def mirror(i, n):
        i %= 2 * n
        return i if i < n else 2 * n - 1 - i

    s = [[round(sum(bell[a] * bell[b] * x[mirror(i + a, h)][mirror(j + b, w)] for a in bell for b in bell) / total**2, 9) for j in range(w)] for i in range(h)]
    flat = sorted(v for r in s for v in r)
    k = 0.7 * (len(flat) - 1)
    bar = flat[int(k)] + (k - int(k)) * (flat[min(int(k) + 1, len(flat) - 1)] - flat[int(k)])
    oy, ox = max(3, round(py) | 1) // 2, max(3, round(px) | 1) // 2
    peak = {(i, j) for i in range(h) for j in range(w) if s[i][j] > bar and all(s[i][j] >= s[min(max(i + a, 0), h - 1)][min(max(j + b, 0), w - 1)] for a in range(-oy, oy + 1) for b in range(-ox, ox + 1))}
    part, n = {}, 0
    for c in sorted(peak):
        if c not in part:
            n += 1
            todo = [c]
            while todo:
                y, z = todo.pop()
                if (y, z) in peak and (y, z) not in part:
                    part[y, z] = n
                    todo += [(y + a, z + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    cells = {}
    for i in range(h):
        for j in range(w):
            if s[i][j] > bar and part:
                near = min(sorted(part), key=lambda c: (c[0] - i) ** 2 + (c[1] - j) ** 2)
                cells.setdefault(part[near], []).append((i, j))
    raw = [c for _, c in sorted(cells.items()) if len(c) >= 2]
    raw = sorted(({"cy": sum(y for y, _ in c) / len(c), "cx": sum(z for _, z in c) / len(c), "energy": sum(x[y][z] for y, z in c) / len(c), "cells": c} for c in raw), key=lambda r: (r["cy"], r["cx"]))
    rows = []
    for r in raw:
        if rows and r["cy"] - rows[-1][-1]["cy"] <= py * 0.6:
            rows[-1].append(r)
        else:
            rows.append([r])
    out, number = [], 0
    for i, row in enumerate(rows):
        for j, r in enumerate(sorted(row, key=lambda r: (r["cx"], r["cy"]))):
            number += 1
            ys, xs = [y for y, _ in r["cells"]], [z for _, z in r["cells"]]
            out.append((number, i, j, min(xs) * 16, min(ys) * 16, (max(xs) + 1) * 16, (max(ys) + 1) * 16, round(r["cy"], 6), round(r["cx"], 6), round(r["energy"], 4), len(r["cells"])))
    return out


COLUMNS = ("seat_number", "row", "col", "x0", "y0", "x1", "y1", "cy", "cx")


def told(rows):
    return sorted((*(round(r[c], 6) for c in COLUMNS), round(r["energy"], 4), len(r["cells"])) for r in rows)


@pytest.mark.parametrize("shape", [(12, 16), (9, 9), (3, 20), (1, 1)])
def test_seats_equal_a_plain_version(spark, shape):
    rng = np.random.default_rng(sum(shape))
    maps = {"a": rng.random(shape), "b": np.zeros(shape), "c": 1 + 5.0 * ((np.arange(shape[0])[:, None] % 4 == 1) & (np.arange(shape[1]) % 5 == 2)), "d": np.round(rng.random(shape), 1)}
    rows = [(v, b, y, x, float(m[y, x] * (1 if b < 120 else 50))) for v, m in maps.items() for b in (0, 119, 120) for y in range(shape[0]) for x in range(shape[1])]
    cube = spark.createDataFrame(rows, "video string, bin int, cy int, cx int, activity double")
    got = motion_seats.seats_from_motion(cube, *shape, keys=["video"]).collect()
    for v, m in maps.items():
        assert told(r for r in got if r["video"] == v) == sorted(plain_seats(m.tolist())), v
    one = motion_seats.seats_from_motion(cube.where("video = 'c'").drop("video"), *shape).collect()
    assert told(one) == sorted(plain_seats(maps["c"].tolist()))


def test_registered_query_equals_a_plain_version(spark, folder):
    cube = Views(spark, folder).seat_motion().where(f"bin < {P.calibration_s}").toPandas()
    want = []
    for v, own in cube.groupby("video"):
        energy = own.groupby(["cy", "cx"])["activity"].mean().unstack().to_numpy()
        want += [(v, *r) for r in plain_seats(energy.tolist())]
    got = [(r["video"], *(round(r[c], 6) for c in COLUMNS), round(r["energy"], 4), r["n_cells"]) for r in QUERIES["motion_seats"](spark, folder).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_no_cube_no_seats(spark):
    assert motion_seats.seats_from_motion(spark.createDataFrame([], "bin int, cy int, cx int, activity double"), 4, 4).count() == 0
