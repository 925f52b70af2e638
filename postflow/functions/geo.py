"""Coordinates, boxes, distances and grid cells."""

import math

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0088


def lat_lon(coordinates: Column, order: str = "lat,lon") -> tuple[Column, Column]:
    """Latitude and longitude out of a two-number array; null where a number is missing."""
    if order not in ("lat,lon", "lon,lat"):
        raise ValueError(f"order must be 'lat,lon' or 'lon,lat', got {order!r}")
    first, second = F.get(coordinates, F.lit(0)), F.get(coordinates, F.lit(1))
    return (first, second) if order == "lat,lon" else (second, first)


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inside the box, edges included; `west > east` means it crosses the 180th meridian."""
    inside = lat.between(south, north)
    if west <= east:
        return inside & lon.between(west, east)
    return inside & ((lon >= west) | (lon <= east))


def distance_km(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Great-circle distance to a fixed point."""
    half_lat = F.sin(F.radians(lat - lat0) / 2)
    half_lon = F.sin(F.radians(lon - lon0) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat)) * math.cos(math.radians(lat0)) * half_lon * half_lon
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def distance_between(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Great-circle distance between two points."""
    half_lat, half_lon = F.sin(F.radians(lat - lat0) / 2), F.sin(F.radians(lon - lon0) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat)) * F.cos(F.radians(lat0)) * half_lon * half_lon
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def box_around(lat0: float, lon0: float, km: float) -> tuple[float, float, float, float]:
    """South, west, north, east of a box that holds every point within `km`."""
    slack = 1e-9
    angle = km / EARTH_KM + slack
    south, north = lat0 - math.degrees(angle), lat0 + math.degrees(angle)
    if south <= -90 or north >= 90:  # a pole is inside, so every meridian is
        return max(south, -90.0), -180.0, min(north, 90.0), 180.0
    reach = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat0))))) + slack
    west, east = lon0 - reach, lon0 + reach
    return south, west + 360 if west < -180 else west, north, east - 360 if east > 180 else east


def cell(lat: Column, lon: Column, degrees: float) -> tuple[Column, Column]:
    """Row and column of the grid cell of `degrees` per side."""
    return F.floor(lat / degrees).alias("cell_lat"), F.floor(lon / degrees).alias("cell_lon")
