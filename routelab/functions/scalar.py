"""Scalar functions of the route-choice domain as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
WALK = "walk"
TRANSFER, TRANSIT = "transfer", "transit"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def gtfs_seconds(time: Column | str) -> Column:
    """Seconds of an HH:MM:SS string whose hours may pass 24; null unless it is three whole numbers."""
    parts = F.split(F.trim(_column(time)), ":")
    h, m, s = (F.get(parts, k).try_cast("bigint") for k in range(3))
    return F.when(F.size(parts) == 3, h * 3600 + m * 60 + s)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def without_platform(name: Column | str) -> Column:
    return F.trim(F.regexp_replace(_column(name), r",\s*Platform\s*\d+$", ""))


def single_spaced(name: Column | str) -> Column:
    return F.trim(F.regexp_replace(_column(name), r"\s+", " "))


def ridership_count(value: Column | str) -> Column:
    """Number with thousands commas; "Less than 50" counts as 25; anything else is null."""
    text = F.trim(_column(value))
    return F.when(text == "Less than 50", F.lit(25.0)).otherwise(F.replace(text, F.lit(","), F.lit("")).try_cast("double"))


def pair_ends(a: str, b: str) -> tuple[Column, Column]:
    """The two ends of an unordered pair, in string order."""
    return F.least(a, b), F.greatest(a, b)


def prefixed(prefix: str, id_: Column | str) -> Column:
    return F.concat(F.lit(prefix), _column(id_))


def path_text(path: Column | str) -> Column:
    return F.array_join(_column(path), "|")


def path_nodes(path: Column | str) -> Column:
    return F.split(_column(path), r"\|")


def node_id(value: Column | str) -> Column:
    """Ids are strings throughout; integral floats lose their fraction."""
    text = _column(value).cast("string")
    return F.when(text.rlike(r"^-?[0-9]+\.0+$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)


def walk_seconds(metres: Column, speed: float) -> Column:
    return metres / F.lit(speed)


def trips_to_draw(total: Column, scale: Column | float, least: int) -> Column:
    """Half-to-even rounding of total * scale, with a floor."""
    return F.greatest(F.lit(least).cast("bigint"), F.rint(total * scale).cast("bigint"))


def impedance(minutes: Column, beta: float, same: Column) -> Column:
    return F.when(same, F.lit(0.0)).otherwise(F.coalesce(F.exp(F.lit(-beta) * minutes), F.lit(0.0)))


def nest_scale(s: Column | float) -> Column:
    s = F.lit(s) if isinstance(s, (int, float)) else s
    return F.greatest(F.lit(1e-4), F.least(F.lit(1.0), 1 / (1 + F.exp(-s))))


def kumaraswamy_weight(x: Column, a: float = 2.0, b: float = 2.0) -> Column:
    """Kumaraswamy's distribution function, floored at 1e-12."""
    return F.greatest(F.lit(1e-12), 1 - F.pow(1 - F.pow(x, a), b))


def generalized_time(ivt: Column, wait: Column, walk: Column) -> Column:
    return ivt + 2 * wait + 2 * walk


def hashed_uniform(*parts: Column | str) -> Column:
    """A uniform in (0, 1) from the md5 of the parts joined by ':'. The same in every engine that has md5."""
    key = F.concat_ws(":", *[_column(p).cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint") + 0.5) / F.lit(4294967296.0)


def gumbel(u: Column) -> Column:
    return -F.ln(-F.ln(u))


def two_sided_p(z: float) -> float:
    """2 (1 - Phi(|z|)), on the driver."""
    return math.erfc(abs(z) / math.sqrt(2.0))
