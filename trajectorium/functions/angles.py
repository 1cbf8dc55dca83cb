"""Angles in degrees: 0 is up, clockwise, image y grows downwards. All are column expressions inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(a: Column) -> Column:
    """Into [0, 360)."""
    return F.pmod(a, F.lit(360.0))


def class_to_degrees(c: Column) -> Column:
    """The middle of one of the eight compass classes."""
    return wrap(c.cast("double") * 45.0)


def unit_x(a: Column) -> Column:
    return F.sin(F.radians(a))


def unit_y(a: Column) -> Column:
    return -F.cos(F.radians(a))


def from_vector(x: Column, y: Column) -> Column:
    """The angle of a vector; null if it is shorter than 1e-6."""
    return F.when(F.hypot(x, y) > 1e-6, wrap(F.degrees(F.atan2(x, -y))))


def distance(a: Column, b: Column) -> Column:
    """In [0, 180]; 0 where either is missing."""
    return F.coalesce(F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0), F.lit(0.0))


def axis_distance(a: Column, b: Column) -> Column:
    """Between undirected axes, in [0, 90]."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, 180.0 - d)


def class_distance(a: Column, b: Column, classes: int = 8) -> Column:
    d = F.abs(a - b) % classes
    return F.least(d, F.lit(classes) - d)


def vector_to_class(x: Column, y: Column) -> Column:
    """One of eight half-open bins of 45 degrees around the compass points."""
    return F.floor(F.pmod(from_vector(x, y) + 22.5, F.lit(360.0)) / 45.0).cast("long")


def interpolate(a: Column, b: Column, alpha: Column) -> Column:
    """Along the shorter arc; the step lies in [-180, 180)."""
    return wrap(a + alpha * (F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0))


def near(a: Column, reference: Column, period: float) -> Column:
    """a moved by whole periods next to the reference; halves go to the even side."""
    return a - F.bround((a - reference) / period) * period


def class_or_degrees(a: Column) -> Column:
    """Degrees of a value that is a class, if it lies within 1e-6 of 0 to 7, else an angle."""
    k = F.round(a)
    return F.when((F.abs(a - k) <= 1e-6) & k.between(0, 7), class_to_degrees(k)).otherwise(wrap(a))
