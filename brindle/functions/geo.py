"""Geo distance, boxes, polygons and grids as columns over struct<lat, lon>."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6_371_008.8
_UNITS = {"m": 1, "km": 1000, "mi": 1609.344, "yd": 0.9144, "ft": 0.3048, "in": 0.0254, "cm": 0.01, "mm": 0.001, "nmi": 1852, "nm": 1852}
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def meters(text: str | float) -> float:
    if isinstance(text, (int, float)):
        return float(text)
    m = re.fullmatch(r"\s*([\d.]+)\s*([a-z]*)\s*", text)
    return float(m[1]) * _UNITS[m[2] or "m"]


def point(p) -> tuple[float, float]:
    """(lat, lon) of an object, [lon, lat], "lat,lon", WKT point or geohash."""
    if isinstance(p, dict):
        return float(p["lat"]), float(p["lon"])
    if isinstance(p, (list, tuple)):
        return float(p[1]), float(p[0])
    m = re.fullmatch(r"(?i)point\s*\(\s*(\S+)\s+(\S+)\s*\)", p)
    if m:
        return float(m[2]), float(m[1])
    if "," in p:
        a, b = p.split(",")
        return float(a), float(b)
    lo, hi = [-90.0, -180.0], [90.0, 180.0]
    even = True
    for c in p:
        v = _BASE32.index(c)
        for bit in (16, 8, 4, 2, 1):
            k = 1 if even else 0
            mid = (lo[k] + hi[k]) / 2
            if v & bit:
                lo[k] = mid
            else:
                hi[k] = mid
            even = not even
    return (lo[0] + hi[0]) / 2, (lo[1] + hi[1]) / 2


def haversine(c: Column, lat: float, lon: float, radius: float = RADIUS) -> Column:
    a, b = F.radians(c["lat"]), F.radians(F.lit(lat))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(F.lit(lon) - c["lon"]) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def box(c: Column, spec: dict) -> Column:
    if "top_left" in spec:
        (top, left), (bottom, right) = point(spec["top_left"]), point(spec["bottom_right"])
    elif "top" in spec:
        top, left, bottom, right = (float(spec[k]) for k in ("top", "left", "bottom", "right"))
    else:
        (top, right), (bottom, left) = point(spec["top_right"]), point(spec["bottom_left"])
    lon = c["lon"].between(left, right) if left <= right else (c["lon"] >= left) | (c["lon"] <= right)
    return c["lat"].between(bottom, top) & lon


def polygon(c: Column, points: list) -> Column:
    """Ray casting over the ring's edges."""
    ring = [point(p) for p in points]
    inside = F.lit(0)
    for (a, b), (x, y) in zip(ring, ring[1:] + ring[:1], strict=True):
        if a == x:
            continue
        crosses = (F.lit(a) > c["lat"]) != (F.lit(x) > c["lat"])
        inside = inside + F.when(crosses & (c["lon"] < (y - b) * (c["lat"] - a) / (x - a) + b), 1).otherwise(0)
    return inside % 2 == 1


def shape(c: Column, spec: dict | str, relation: str = "intersects") -> Column:
    """Points against a GeoJSON or WKT point, envelope, circle or polygon."""
    if isinstance(spec, str):
        m = re.fullmatch(r"(?is)\s*(\w+)\s*\((.*)\)\s*", spec)
        kind, rest = m[1].lower(), m[2]
        if kind == "polygon":
            spec = {"type": "polygon", "coordinates": [[list(map(float, p.split())) for p in rest.strip("() ").split(",")]]}
        elif kind in ("envelope", "bbox"):
            left, right, top, bottom = map(float, rest.split(","))
            spec = {"type": "envelope", "coordinates": [[left, top], [right, bottom]]}
        else:
            spec = {"type": "point", "coordinates": list(map(float, rest.split()))}
    kind, at = spec["type"].lower(), spec["coordinates"]
    if kind == "envelope":
        hit = box(c, {"top_left": at[0], "bottom_right": at[1]})
    elif kind == "circle":
        hit = haversine(c, at[1], at[0]) <= meters(spec["radius"])
    elif kind == "polygon":
        hit = polygon(c, at[0])
        for hole in at[1:]:
            hit = hit & ~polygon(c, hole)
    elif kind == "multipolygon":
        hit = F.lit(False)
        for part in at:
            hit = hit | shape(c, {"type": "polygon", "coordinates": part})
    else:
        hit = (c["lat"] == float(at[1])) & (c["lon"] == float(at[0]))
    return ~hit if relation == "disjoint" else hit


def geotile(c: Column, zoom: int) -> Column:
    n = 1 << zoom
    lat = F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), c["lat"])))
    x = F.floor((c["lon"] + 180) / 360 * n)
    y = F.floor((1 - F.ln(F.tan(lat) + 1 / F.cos(lat)) / math.pi) / 2 * n)
    clip = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("string")
    return F.concat_ws("/", F.lit(str(zoom)), clip(x), clip(y))


def geohash(c: Column, precision: int) -> Column:
    """Interleaved bits of both coordinates, five to a character."""
    lon_bits, lat_bits = (5 * precision + 1) // 2, 5 * precision // 2
    x = F.least(F.floor((c["lon"] + 180) / 360 * (1 << lon_bits)), F.lit((1 << lon_bits) - 1)).cast("long")
    y = F.least(F.floor((c["lat"] + 90) / 180 * (1 << lat_bits)), F.lit((1 << lat_bits) - 1)).cast("long")
    bits = []
    for i in range(5 * precision):
        k = i // 2
        bits.append(F.shiftright(x, lon_bits - 1 - k).bitwiseAND(F.lit(1)) if i % 2 == 0 else F.shiftright(y, lat_bits - 1 - k).bitwiseAND(F.lit(1)))
    chars = []
    for p in range(precision):
        v = F.lit(0).cast("long")
        for b in bits[5 * p : 5 * p + 5]:
            v = v * 2 + b
        chars.append(F.substring(F.lit(_BASE32), (v + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)
