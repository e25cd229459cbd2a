"""Geometry as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
M_PER_NM = 1852.0
KT_PER_MPS = 1.943844
MPS_PER_KT = 0.514444


def seconds(c: Column) -> Column:
    """A timestamp as exact epoch seconds."""
    return F.unix_micros(c) / 1e6


def elapsed(start: Column, end: Column) -> Column:
    """Seconds between two timestamps; the difference is taken in whole microseconds."""
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(p)))


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) / M_PER_NM


def heading_delta(before: Column, after: Column) -> Column:
    """Signed, from -180 up to but not 180."""
    return F.pmod(after - before + 180.0, F.lit(360.0)) - 180.0


def local_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of a reference, equirectangular."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * EARTH_M, F.radians(lat - lat0) * EARTH_M


def velocity_xy(speed_kt: Column, track_deg: Column) -> tuple[Column, Column]:
    v = speed_kt * MPS_PER_KT
    return v * F.sin(F.radians(track_deg)), v * F.cos(F.radians(track_deg))


def time_to_cpa(rx: Column, ry: Column, vx: Column, vy: Column, dz_ft: Column, rate_fpm: Column) -> Column:
    """Seconds to the closest point of approach; of the vertical motion alone if there is no horizontal one; null if neither."""
    v2 = vx * vx + vy * vy
    vertical = F.when(F.abs(rate_fpm) >= 1e-9, -dz_ft / (rate_fpm / 60))
    return F.when(v2 >= 1e-18, -(rx * vx + ry * vy) / v2).otherwise(vertical)


def separation_at(rx: Column, ry: Column, vx: Column, vy: Column, t: Column, dz_ft: Column, rate_fpm: Column) -> tuple[Column, Column]:
    """Nautical miles and feet apart after t seconds."""
    return F.hypot(rx + vx * t, ry + vy * t) / M_PER_NM, F.abs(dz_ft + rate_fpm * t / 60)


def lerp(a: Column, b: Column, f: Column) -> Column:
    return a + (b - a) * f


def lerp_angle(a: Column, b: Column, f: Column) -> Column:
    return F.pmod(a + heading_delta(a, b) * f, F.lit(360.0))


def cell(degrees: Column, size: float) -> Column:
    return F.floor(degrees / size).cast("long")


def edges(rings: Column) -> Column:
    """Rings to an array of segments x1, y1, x2, y2, each ring closed."""

    def of_ring(ring: Column) -> Column:
        n = F.size(ring)
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(
                F.get(F.get(ring, i), F.lit(0)).alias("x1"),
                F.get(F.get(ring, i), F.lit(1)).alias("y1"),
                F.get(F.get(ring, (i + 1) % n), F.lit(0)).alias("x2"),
                F.get(F.get(ring, (i + 1) % n), F.lit(1)).alias("y2"),
            ),
        )

    return F.flatten(F.transform(rings, of_ring))


def contains(segments: Column, lat: Column, lon: Column) -> Column:
    """Even-odd rule over edges; the boundary is left to the distance."""

    def crosses(e: Column) -> Column:
        return ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])

    return F.size(F.filter(segments, crosses)) % 2 == 1


def boundary_nm(segments: Column, lat: Column, lon: Column) -> Column:
    """Least distance to an edge, in nautical miles on a plane touching at the point."""
    k = F.cos(F.radians(lat)) * 60.0

    def to(e: Column) -> Column:
        ax, ay, bx, by = (e["x1"] - lon) * k, (e["y1"] - lat) * 60.0, (e["x2"] - lon) * k, (e["y2"] - lat) * 60.0
        dx, dy = bx - ax, by - ay
        d2 = dx * dx + dy * dy
        t = F.when(d2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / d2))).otherwise(0.0)
        return F.hypot(ax + t * dx, ay + t * dy)

    return F.array_min(F.transform(segments, to))


def bilinear(grid: Column, lat: Column, lon: Column) -> Column:
    """Elevation from a grid struct (lat_min, lon_min, lat_step, lon_step, elevations_ft); null off the grid or next to a null."""
    y, x = (lat - grid["lat_min"]) / grid["lat_step"], (lon - grid["lon_min"]) / grid["lon_step"]
    rows, cols = F.size(grid["elevations_ft"]), F.size(F.get(grid["elevations_ft"], F.lit(0)))
    i, j = F.least(F.floor(y).cast("int"), rows - 2), F.least(F.floor(x).cast("int"), cols - 2)
    fy, fx = y - i, x - j

    def at(r: Column, c: Column) -> Column:
        return F.get(F.get(grid["elevations_ft"], r), c)

    low, high = at(i, j) * (1 - fx) + at(i, j + 1) * fx, at(i + 1, j) * (1 - fx) + at(i + 1, j + 1) * fx
    return F.when((y >= 0) & (x >= 0) & (y <= rows - 1) & (x <= cols - 1), low * (1 - fy) + high * fy)


def destination(lat: Column, lon: Column, bearing_deg: Column, distance_m: Column) -> tuple[Column, Column]:
    """Great-circle destination, degrees."""
    d, p, b = distance_m / EARTH_M, F.radians(lat), F.radians(bearing_deg)
    lat2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    return F.degrees(lat2), lon + F.degrees(F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(lat2)))
