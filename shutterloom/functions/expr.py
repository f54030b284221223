"""Column expressions over frames: similarity, clocks, geometry, sharpness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def exact_double(x: Column) -> Column:
    """A float's shortest decimal as a double, so that 0.12f is not less than 0.12."""
    return x.cast("string").cast("double")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes in hex."""
    bits = lambda h: F.conv(h, 16, -10).cast("bigint")
    return F.bit_count(bits(a).bitwiseXOR(bits(b)))


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length; null if either is null."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 1e-12, x / norm).otherwise(x))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a zone-less timestamp, as if it were UTC."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def captured_ms(text: Column, sub_sec_ms: Column) -> Column:
    """Strict yyyy-MM-ddTHH:mm:ss plus the sub-second part; null if it does not parse."""
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$")
    return F.when(shape, epoch_ms(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss"))) + F.coalesce(sub_sec_ms, F.lit(0)))


def sub_sec_ms(digits: Column) -> Column:
    """The first three digits as milliseconds, trailing spaces aside; null for anything but digits."""
    d = F.rtrim(digits)
    return F.when(d.rlike(r"^\d+$"), F.rpad(F.substring(d, 1, 3), 3, "0").cast("int"))


def normalised_datetime(text: Column) -> Column:
    """2024:01:02 03:04:05 as 2024-01-02T03:04:05; other shapes pass."""
    return F.regexp_replace(text, r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}:\d{2}:\d{2})$", r"$1-$2-$3T$4")


def gps_degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    value = d + m / 60.0 + s / 3600.0
    return F.when(F.upper(F.substring(ref, 1, 1)).isin("S", "W"), -value).otherwise(value)


def oriented_point(orientation: Column, x: Column, y: Column) -> Column:
    """struct<x, y>: a sensor point as displayed; orientations 3, 6 and 8 turn it."""
    nx = F.when(orientation == 3, 1 - x).when(orientation == 6, 1 - y).when(orientation == 8, y).otherwise(x)
    ny = F.when(orientation == 3, 1 - y).when(orientation == 6, x).when(orientation == 8, 1 - x).otherwise(y)
    return F.struct(nx.alias("x"), ny.alias("y"))


def display_dims(orientation: Column, width: Column, height: Column) -> Column:
    turned = orientation.isin(6, 8)
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def mid_dims(width: Column, height: Column, long_edge: int = 2560) -> Column:
    """Size with that long edge, rounded half up; null if the source is no larger."""
    edge = F.greatest(width, height)
    scaled = lambda side: F.greatest(F.lit(1), F.floor((side * long_edge * 2 + edge) / (edge * 2))).cast("int")
    return F.when(edge > long_edge, F.struct(scaled(width).alias("width"), scaled(height).alias("height")))


def normalised_sharpness(variance: Column, noise: Column) -> Column:
    return clamp01(F.log1p(variance / F.greatest(noise, F.lit(1e-3))) / 12.0)


def motion_blur(shutter_seconds: Column, focal_mm: Column, sharpness: Column) -> Column:
    known = (shutter_seconds > 0) & (focal_mm > 0)
    return F.when(known, clamp01(shutter_seconds * focal_mm) * (1 - sharpness)).otherwise(F.lit(0.0))


def backoff_ms(attempts: Column) -> Column:
    """1 s doubled for each failed attempt, 30 s at most; null from the fourth on, which is terminal."""
    return F.when(attempts < 4, F.least(F.lit(30_000), (F.lit(1000) * F.pow(F.lit(2), attempts - 1)).cast("int")))


def iou(a: Column, b: Column) -> Column:
    """Of boxes struct<x, y, w, h>; 0 where the union is empty."""
    side = lambda p, q: F.greatest(F.lit(0.0), F.least(a[p] + a[q], b[p] + b[q]) - F.greatest(a[p], b[p]))
    both = side("x", "w") * side("y", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def padded(n: Column, step: int = 32) -> Column:
    return (F.ceil(n / step) * step).cast("int")


def primary_face(faces: Column) -> Column:
    """The face of the largest box; the first of equal ones; null where none has an area."""
    area = lambda f: F.get(f["bbox"], F.lit(2)) * F.get(f["bbox"], F.lit(3))
    real = F.filter(faces, lambda f: area(f) > 0)
    best = F.array_max(F.transform(real, lambda f, i: F.struct(area(f).alias("a"), (-i).alias("i"))))
    return F.when(F.size(real) > 0, F.get(real, -best["i"]))
