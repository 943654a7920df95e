"""Predicates and distances on coordinates, in single precision where results depend on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edges of the New York bounding box.
WEST, EAST, SOUTH, NORTH = -74.05, -73.7, 40.5, 41.0


def f32(x: float | Column) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def in_nyc(lon: Column, lat: Column) -> Column:
    """Strictly inside the box."""
    return (lon > f32(WEST)) & (lon < f32(EAST)) & (lat > f32(SOUTH)) & (lat < f32(NORTH))


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Euclidean distance in degrees: differences in single precision, the rest in double."""
    x, y = f32(lon1 - lon2).cast("double"), f32(lat1 - lat2).cast("double")
    return F.sqrt(x * x + y * y)


def grid_cell(lon: Column, lat: Column, size: int) -> Column:
    """Number of the cell of 1/size degrees, row by row from the box's south-west corner. Every step is in single
    precision: in double precision, rows would have another length."""
    n = f32(float(size))
    x = F.floor(f32(f32(lon - f32(WEST)) * n)).cast("int")
    y = F.floor(f32(f32(lat - f32(SOUTH)) * n)).cast("int")
    row = F.ceil(f32(f32(f32(EAST) - f32(WEST)) * n)).cast("int")
    return x + y * row


def location(lon: Column, lat: Column) -> Column:
    return F.format_string("(%.5f, %.5f)", lon.cast("double"), lat.cast("double"))
