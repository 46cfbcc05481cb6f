"""Expressions on ARRAY<DOUBLE> vectors: all JVM-side, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def once(value: Column, body) -> Column:
    """body of a value that is worked out once. What a lambda names from outside is else worked out anew for every element."""
    return F.transform(F.array(value), body)[0]


def rounded(x: Column, digits: int) -> Column:
    """round that keeps the sign of what becomes zero, as SQL engines that round in binary do: -0.0 is another value than 0.0 inside an array."""
    r = F.round(x, digits)
    return F.when(r == 0, F.signum(x) * 0.0).otherwise(r)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def scaled(a: Column, k: Column | float) -> Column:
    return once(k, lambda k: F.transform(a, lambda x: x * k)) if isinstance(k, Column) else F.transform(a, lambda x: x * k)


def _divided(a: Column, by) -> Column:
    return once(a, lambda v: once(F.struct(v.alias("v"), by(v).alias("n")), lambda s: F.transform(s["v"], lambda x: x / s["n"])))


def unit(a: Column, eps: float = EPS) -> Column:
    return _divided(a, lambda v: norm(v) + eps)


def unit_clamped(a: Column, least: float = 1e-12) -> Column:
    return _divided(a, lambda v: F.greatest(norm(v), F.lit(least)))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def fuse(*blocks: Column, weights: tuple[float, ...] | None = None) -> Column:
    """Unit blocks side by side (each times its weight), then unit again."""
    parts = [unit(b) if w is None else scaled(unit(b), F.lit(w)) for b, w in zip(blocks, weights or [None] * len(blocks), strict=True)]
    return unit(F.concat(*parts))


def fourier(coords: Column, n: int) -> Column:
    """sin and cos of 2^f * pi * x for every coordinate and f = 0..n-1."""
    freq = F.array(*[F.lit(float(2**f) * 3.141592653589793) for f in range(n)])
    return F.flatten(F.transform(coords, lambda x: F.concat(F.transform(freq, lambda f: F.sin(f * x)), F.transform(freq, lambda f: F.cos(f * x)))))


def project(vector: Column, rows: Column) -> Column:
    """Linear map with a given weight table (array of rows)."""
    return once(vector, lambda v: F.transform(rows, lambda w: dot(v, w)))


def md5_uniform(*key: Column) -> Column:
    """A number in (0, 1) from a key: the same in any engine with md5."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def jitter(x: Column, u1: Column, u2: Column, spread: float, low: float, high: float, phase: int = 0) -> Column:
    """Box-Muller noise from two uniforms, clipped to the frame."""
    z = F.sqrt(-2 * F.log(u1)) * (F.cos(2 * F.pi() * u2) if phase == 0 else F.sin(2 * F.pi() * u2))
    return F.greatest(F.lit(low), F.least(F.lit(high), x + spread * z))


def rescale(x: Column, from_size: Column, to_size: Column) -> Column:
    """Half-even rounding, as an integer point in another frame."""
    return F.bround(x * (to_size / from_size)).cast("int")


def affine(x: Column, y: Column, m: tuple[float, float, float, float, float, float], w: Column, h: Column) -> Column:
    """(a b c; d e f) applied to a point and clipped to the frame."""
    a, b, c, d, e, f = m
    return F.struct(F.greatest(F.lit(0.0), F.least(w - 1.0, a * x + b * y + c)).alias("x"), F.greatest(F.lit(0.0), F.least(h - 1.0, d * x + e * y + f)).alias("y"))


def rectangle_to_pixels(rect: Column, place: tuple[float, float, float, float], w: Column, h: Column) -> Column:
    """A rectangle (x, y, w, h) in page points as a box (x0, y0, x1, y1) of whole pixels of an image of w x h that is drawn at `place`; cut towards zero."""
    left, top, wide, high = place
    box = {"x0": (rect["x"] - left) / wide * w, "y0": (rect["y"] - top) / high * h, "x1": (rect["x"] + rect["w"] - left) / wide * w, "y1": (rect["y"] + rect["h"] - top) / high * h}
    return F.struct(*[v.cast("int").alias(k) for k, v in box.items()])
