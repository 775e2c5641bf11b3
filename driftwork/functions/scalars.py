"""Scalar expressions, all in the JVM but for the colour of an id."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def distance32(dx: Column, dy: Column) -> Column:
    """Euclidean length in single precision at every step."""
    dx, dy = dx.cast("float"), dy.cast("float")
    return F.sqrt((dx * dx + dy * dy).cast("float")).cast("float")


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    return F.greatest(F.lit(low) if isinstance(low, (int, float)) else low, F.least(value, F.lit(high) if isinstance(high, (int, float)) else high))


def cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax * bx + ay * by) / (distance(ax, ay) * distance(bx, by))


def direction_cost(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """1 - cosine, or 0 where either vector is shorter than 1."""
    return F.when((distance(ax, ay) < 1) | (distance(bx, by) < 1), F.lit(0.0)).otherwise(1 - cosine(ax, ay, bx, by))


def damped_steps(misses: Column, damping: float = 0.9) -> Column:
    """Geometric sum of misses + 1 damped steps."""
    return (1 - F.pow(F.lit(damping), misses + 1)) / F.lit(1 - damping)


def gate(speed: Column, base: float = 130.0, per_speed: float = 2.0, low: float = 50.0, high: float = 600.0) -> Column:
    return clamp(F.lit(base) + F.lit(per_speed) * speed, low, high)


def whole(value: Column) -> Column:
    """Towards zero; NaN and overflow are errors."""
    return value.cast("int")


def frames_per_second(fps: Column) -> Column:
    return F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(30.0))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, (done / total * 100).cast("int")).otherwise(F.lit(0))


def colour_of(number: int) -> tuple[int, int, int]:
    """A stable (blue, green, red) from the low 32 bits of an id. The generator, its seed and the range 50..255."""
    rng = random.Random(number & 0xFFFFFFFF)
    return tuple(rng.randint(50, 255) for _ in range(3))
