"""Order-free comparison of a Spark result with the checking SQL."""

from __future__ import annotations

import datetime
import math


def _cell(v):
    if v is None:
        return (0, "null")
    if isinstance(v, float) and math.isnan(v):
        return (0, "nan")
    if isinstance(v, bool):
        return (1, float(v))
    if isinstance(v, datetime.datetime):
        return (2, v.date().isoformat() if v.time() == datetime.time() else v.isoformat())
    if isinstance(v, datetime.date):
        return (2, v.isoformat())
    if isinstance(v, (list, tuple)):
        return (3, tuple(_cell(x) for x in v))
    if isinstance(v, str):
        return (4, v)
    return (1, float(v))


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [tuple(_cell(r[k]) for k in order) for r in data]


def sort_key(row):
    # floats a rounding step apart must sort alike, so coarse keys come first
    return tuple((k, round(v, 4) if isinstance(v, float) and math.isfinite(v) else str(v)) for k, v in row)


def assert_same(names_a, data_a, names_b, data_b, tol=2e-6):
    assert sorted(names_a) == sorted(names_b)
    a, b = sorted(rows(names_a, data_a), key=sort_key), sorted(rows(names_b, data_b), key=sort_key)
    assert len(a) == len(b), (len(a), len(b))
    exact = 0
    for x, y in zip(a, b):
        exact += x == y
        for (kx, vx), (ky, vy) in zip(x, y):
            assert kx == ky, (x, y)
            if isinstance(vx, float):
                assert vx == vy or abs(vx - vy) <= tol * max(1.0, abs(vx)), (x, y)
                # a negative zero prints differently and would break a comparison of text
                assert vx != 0 or vy != 0 or math.copysign(1, vx) == math.copysign(1, vy), ("sign of zero", x, y)
            else:
                assert vx == vy, (x, y)
    return exact, len(a)
