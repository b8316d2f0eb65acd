"""Expressions of the pitch: areas, distances, zones and the threat grid.

Both axes run from 0 to 100; teams attack towards x = 100. The texts are SQL that any engine evaluates alike. Distances
whose means are asked for are rounded to millionths, as integers, so sums don't depend on the order of rows.
"""

from __future__ import annotations

IN_BOX = "(location_x >= 83 and location_y between 21 and 79)"
END_IN_BOX = "(pass_end_x >= 83 and pass_end_y between 21 and 79)"


def goal_distance(x: str, y: str) -> str:
    """To the middle of the goal, in percent units."""
    return f"sqrt((100 - {x}) * (100 - {x}) + (50 - {y}) * (50 - {y}))"


def metres(x0: str, y0: str, x1: str, y1: str) -> str:
    """Between two points, on a pitch of 105 by 68 metres."""
    return f"sqrt((({x1}) - ({x0})) * 1.05e0 * ((({x1}) - ({x0})) * 1.05e0) + (({y1}) - ({y0})) * 0.68e0 * ((({y1}) - ({y0})) * 0.68e0))"


def micro(x: str) -> str:
    return f"cast(floor(({x}) * 1000000 + 0.5e0) as bigint)"


CONTACT_ZONE = (
    "case when location_x is null or location_y is null then 'Unknown' when location_x >= 94 and location_y between 36 and 64 then '6Y Box' "
    "when location_x >= 88 and location_x < 94 and location_y between 36 and 64 then 'Front Area' "
    "when location_x >= 90 and (location_y >= 21 and location_y < 36 or location_y > 64 and location_y <= 79) then 'Near Post' "
    "when location_x >= 83 and location_x < 90 and (location_y >= 21 and location_y < 36 or location_y > 64 and location_y <= 79) then 'Far Post' "
    "when location_x >= 83 and location_x < 88 and location_y between 36 and 64 then 'Middle Area' else 'Back Area' end"
)
#: Where a corner goes, seen from its side; thirds of the goal area, as thousandths.
TARGET_ZONE = (
    "case when pass_end_x is null or pass_end_y is null then 'Other' when pass_end_x < 83 or length_m < 20 then 'Short' "
    "when pass_end_y * 3 < 136 then case when location_y < 50 then 'Near Post' else 'Far Post' end "
    "when pass_end_y * 3 > 164 then case when location_y < 50 then 'Far Post' else 'Near Post' end else 'Middle' end"
)
#: The threat of each cell, in hundredths; 8 rows over y, 12 columns over x.
THREAT = (
    (1, 1, 1, 1, 1, 1, 2, 2, 3, 3, 4, 4),
    (1, 1, 1, 1, 1, 2, 2, 2, 3, 4, 5, 5),
    (1, 1, 1, 1, 1, 2, 2, 2, 3, 5, 6, 6),
    (1, 1, 1, 1, 1, 2, 2, 2, 4, 11, 26, 26),
    (1, 1, 1, 1, 1, 2, 2, 2, 4, 11, 26, 26),
    (1, 1, 1, 1, 1, 2, 2, 2, 3, 5, 6, 6),
    (1, 1, 1, 1, 1, 2, 2, 2, 3, 4, 5, 5),
    (1, 1, 1, 1, 1, 1, 2, 2, 3, 3, 4, 4),
)


def threat(x: str, y: str, array: str, at: str) -> str:
    """Hundredths of threat at a point; `array` builds an array, `at` looks one up from 1, in the engine's own words."""
    cells = array.format(", ".join(str(v) for row in THREAT for v in row))
    cell = f"cast(least(floor({y} / 100 * 8), 7) * 12 + least(floor({x} / 100 * 12), 11) + 1 as int)"
    return f"case when {x} is null or {y} is null then 0 else {at.format(cells, cell)} end"
