"""A space-filling curve over the globe: keys of places and cells, and boxes as few ranges of keys.

Latitude and longitude are cut into 2**24 steps each, and the bits of the two steps alternate (Z
order). The upper bits of a key are those of every cell around it: a cell of level `l`, one of 4**l,
is a run of keys.
"""

import functools
import heapq
import math
import operator

from pyspark.sql import Column, functions as F

LEVELS = 24

# Masks that move the lower 24 bits of a number apart, to every second place.
_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def curve_key(lat: Column, lon: Column) -> Column:
    """The place of a point on the curve; null without both coordinates. Values off the map count as its edge."""
    row, column = _step(lat, 180.0, 90.0), _step(lon, 360.0, 180.0)
    return _apart(column).bitwiseOR(F.shiftleft(_apart(row), 1))


def _step(value: Column, extent: float, shift: float) -> Column:
    steps = 1 << LEVELS
    at = F.floor((value + shift) / extent * steps)
    return F.greatest(F.lit(0), F.least(F.lit(steps - 1), at)).cast("bigint") + F.when(value.isNull(), None).otherwise(0)


def _apart(number: Column) -> Column:
    return _fold(number, "shiftleft", _SPREAD)


def _fold(number: Column, shift: str, steps: list[tuple[int, int]]) -> Column:
    """Move bits step by step. A fold names the number once a step; nested expressions would double it each time."""
    table = F.array(*[F.struct(F.lit(by).alias("by"), F.lit(mask).cast("bigint").alias("mask")) for by, mask in steps])
    return F.aggregate(
        table, number, lambda n, step: n.bitwiseOR(F.call_function(shift, n, step["by"])).bitwiseAND(step["mask"])
    )


def cell_at(key: Column, level: int) -> Column:
    """The cell of a level that a key lies in."""
    return F.shiftright(key, 2 * (LEVELS - level))


def cell_corner(cell: Column, level: int) -> tuple[Column, Column, float, float]:
    """South and west of a level's cells, and their height and width in degrees."""
    height, width = 180.0 / (1 << level), 360.0 / (1 << level)
    return _together(F.shiftright(cell, 1)) * height - 90.0, _together(cell) * width - 180.0, height, width


def _together(number: Column) -> Column:
    """Every second bit, moved together: the other way round than `_apart`."""
    back = [(by, mask) for (by, _), (_, mask) in zip(_SPREAD[::-1], [*_SPREAD[-2::-1], (0, 0x00000000FFFFFFFF)])]
    return _fold(number.bitwiseAND(F.lit(_SPREAD[-1][1]).cast("bigint")), "shiftright", back)


def _number(value: float, extent: float, shift: float) -> int:
    steps = 1 << LEVELS
    return max(0, min(steps - 1, math.floor((value + shift) / extent * steps)))


def box_ranges(south: float, west: float, north: float, east: float, most: int = 16) -> list[tuple[int, int]]:
    """At most `most` ranges of keys, ends included, that hold every point of a box; `west > east` crosses the 180th meridian.

    The map is cut into quarters, always the one with the most area outside the box next, until
    more cuts would take too many ranges; neighbours on the curve are one range.
    """
    rows = _number(south, 180.0, 90.0), _number(north, 180.0, 90.0)
    edges = [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]
    spans = [(_number(w, 360.0, 180.0), _number(e, 360.0, 180.0)) for w, e in edges]
    if south > north:
        return []

    def inside(row: int, column: int, side: int) -> int:
        high = min(rows[1], row + side - 1) - max(rows[0], row) + 1
        wide = sum(max(0, min(b, column + side - 1) - max(a, column) + 1) for a, b in spans)
        return max(0, high) * wide

    def entry(key: int, row: int, column: int, level: int):
        side = 1 << (LEVELS - level)
        return inside(row, column, side) - side * side, key, row, column, level

    heap = [entry(0, 0, 0, 0)]
    for _ in range(4 * most):
        waste, key, row, column, level = heap[0]
        if waste == 0 or level == LEVELS:
            break
        heapq.heappop(heap)
        half = 1 << (LEVELS - level - 1)
        for part in range(4):
            at = row + half * (part >> 1), column + half * (part & 1)
            if inside(*at, half):
                heapq.heappush(heap, entry(key + part * half * half, *at, level + 1))
    runs = []
    for _, key, _, _, level in sorted(heap, key=lambda h: h[1]):
        end = key + (1 << 2 * (LEVELS - level)) - 1
        if runs and runs[-1][1] + 1 == key:
            runs[-1][1] = end
        else:
            runs.append([key, end])
    while len(runs) > most:
        near = min(range(len(runs) - 1), key=lambda i: runs[i + 1][0] - runs[i][1])
        runs[near][1] = runs.pop(near + 1)[1]
    return [tuple(r) for r in runs]


def in_ranges(key: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a key lies in one of the ranges; a plain test on a stored column, so it prunes row groups."""
    tests = [key.between(a, b) for a, b in ranges]
    return functools.reduce(operator.or_, tests) if tests else F.lit(False)
