"""Pixel statistics, perceptual hash and masks of RGB images, in numpy, and their use over a DataFrame of images."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
FOCUS_SHARE, EYE_SHARE, EYE_SIZE, EYE_LEAST = 0.2, 0.55, (40, 24), 10
BLOWN, CRUSHED, TILE, TILES, PEAKING = 250, 5, 128, 16, 60
BLOWN_RGBA, CRUSHED_RGBA, PEAK_RGBA = (255, 64, 64, 255), (64, 128, 255, 255), (64, 255, 64, 255)


def luma(rgb: np.ndarray) -> np.ndarray:
    """h x w bytes from h x w x 3, by integer weights 77, 150, 29."""
    c = rgb.astype(np.uint32)
    return ((77 * c[..., 0] + 150 * c[..., 1] + 29 * c[..., 2]) >> 8).astype(np.uint8)


def laplacian_variance(y: np.ndarray) -> float:
    """Population variance of the four-neighbour Laplacian over the inner pixels."""
    f = y.astype(np.float64)
    if min(f.shape) < 3:
        return 0.0
    v = f[:-2, 1:-1] + f[2:, 1:-1] + f[1:-1, :-2] + f[1:-1, 2:] - 4 * f[1:-1, 1:-1]
    return float(v.var()) if v.size > 1 else 0.0


def tenengrad(y: np.ndarray) -> float:
    """Mean squared Sobel magnitude."""
    f = y.astype(np.float64)
    if min(f.shape) < 3:
        return 0.0
    smooth_x, smooth_y = f[:-2] + 2 * f[1:-1] + f[2:], f[:, :-2] + 2 * f[:, 1:-1] + f[:, 2:]
    gx, gy = smooth_x[:, 2:] - smooth_x[:, :-2], smooth_y[2:] - smooth_y[:-2]
    return float((gx**2 + gy**2).mean())


def noise_floor(y: np.ndarray) -> float:
    """Lower median of the smallest Laplacian variances of whole tiles; of the frame where there is no whole tile."""
    h, w = y.shape
    found = sorted(laplacian_variance(y[i : i + TILE, j : j + TILE]) for i in range(0, h - TILE + 1, TILE) for j in range(0, w - TILE + 1, TILE))[:TILES]
    return found[(len(found) - 1) // 2] if found else laplacian_variance(y)


def texture_spread(y: np.ndarray) -> float:
    """Between the first levels whose cumulative counts reach a twentieth, and all but a twentieth, of the pixels."""
    n = y.size
    if not n:
        return 0.0
    cum = np.cumsum(np.bincount(y.ravel(), minlength=256))
    low, high = np.searchsorted(cum, -(-n // 20)), np.searchsorted(cum, n - n // 20)
    return float(high - low) / 255.0


def exposure_score(y: np.ndarray) -> float:
    bins = np.bincount(y.ravel() >> 2, minlength=64)
    mean = float((bins * (np.arange(64) * 4 + 2)).sum()) / max(1, y.size)
    return float(np.clip(1 - abs(mean - 118.0) / 137.0, 0, 1))


def clipped(rgb: np.ndarray) -> tuple[float, float]:
    """Shares of blown pixels and of others that are crushed: all channels at the end of the range."""
    blown = (rgb >= BLOWN).all(axis=-1)
    n = max(1, blown.size)
    return float(blown.sum()) / n, float(((rgb <= CRUSHED).all(axis=-1) & ~blown).sum()) / n


def histogram(rgb: np.ndarray) -> tuple[np.ndarray, int]:
    bins = np.stack([np.bincount(rgb[..., c].ravel(), minlength=256) for c in range(3)])
    return bins, max(1, int(bins.max()))


def _box(y: np.ndarray, side: int = 32) -> np.ndarray:
    h, w = y.shape
    cut = lambda n: [(i * n // side, max(i * n // side + 1, (i + 1) * n // side)) for i in range(side)]
    return np.array([[y[a:b, c:d].mean(dtype=np.float64) for c, d in cut(w)] for a, b in cut(h)], dtype=np.float32)


_I = np.arange(32)
_DCT = np.cos(np.pi * (2 * _I[None, :] + 1) * _I[:, None] / 64).astype(np.float32)


def phash(y: np.ndarray) -> str:
    """64 bits in hex: the low 8 x 8 DCT coefficients of a 32 x 32 reduction against the middle of the 63 AC ones.

    The middle is the mean of the 32nd and 33rd smallest; bit 0 is the DC term. An image without pixels gives zeros.
    """
    if not y.size:
        return "0" * 16
    block = (_DCT @ _box(y) @ _DCT.T)[:8, :8].ravel()
    ac = np.sort(block[1:])
    bits = block > (ac[31] + ac[32]) / 2
    return f"{sum(1 << int(i) for i in np.flatnonzero(bits)):016x}"


def is_blank(rgba: np.ndarray) -> bool:
    """Whether a sample has nothing to show: no pixel is opaque to any degree."""
    return not rgba[..., 3].any()


def clip_mask(rgb: np.ndarray) -> np.ndarray:
    """RGBA stripes over blown and crushed pixels, slanting either way."""
    h, w, _ = rgb.shape
    y, x = np.mgrid[:h, :w]
    blown, out = (rgb >= BLOWN).all(axis=-1), np.zeros((h, w, 4), dtype=np.uint8)
    out[blown & ((x + y) % 8 < 3)] = BLOWN_RGBA
    out[(rgb <= CRUSHED).all(axis=-1) & ~blown & ((x - y + h) % 8 < 3)] = CRUSHED_RGBA
    return out


def peaking_mask(rgb: np.ndarray) -> np.ndarray:
    c = rgb.astype(np.int32)
    y = (c[..., 0] + 2 * c[..., 1] + c[..., 2]) >> 2
    out = np.zeros((*y.shape, 4), dtype=np.uint8)
    edge = np.abs(y[1:-1, 2:] - y[1:-1, :-2]) + np.abs(y[2:, 1:-1] - y[:-2, 1:-1]) > PEAKING
    out[1:-1, 1:-1][edge] = PEAK_RGBA
    return out


def bilinear(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = rgb.shape[:2]
    at = lambda n, m: np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    y, x = at(h, height), at(w, width)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx, f = (y - y0)[:, None, None], (x - x0)[None, :, None], rgb.astype(np.float64)
    top, bottom = f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx, f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx
    return np.floor(top * (1 - fy) + bottom * fy + 0.5).astype(np.uint8)


def suppressed(boxes: np.ndarray, most: float = 0.3, cap: int = 32) -> np.ndarray:
    """Indices of boxes (x, y, w, h, score) kept by greedy suppression, best first."""
    kept: list[int] = []
    for i in np.argsort(-boxes[:, 4], kind="stable").tolist():
        x, y, w, h = boxes[i, :4]
        for j in kept:
            X, Y, W, H = boxes[j, :4]
            both = max(0.0, min(x + w, X + W) - max(x, X)) * max(0.0, min(y + h, Y + H) - max(y, Y))
            union = w * h + W * H - both
            if union > 0 and both / union > most:
                break
        else:
            kept.append(i)
            if len(kept) == cap:
                break
    return np.array(kept, dtype=int)


def decoded_heads(cls: np.ndarray, obj: np.ndarray, box: np.ndarray, points: np.ndarray, stride: int, width: int, least: float = 0.7) -> np.ndarray:
    """Rows x, y, w, h, score, then five points, of the cells whose sqrt(cls * obj) reaches ``least``."""
    score = np.sqrt(np.clip(cls, 0, 1) * np.clip(obj, 0, 1))
    i = np.flatnonzero(score >= least)
    col, row = i % width, i // width
    cx, cy = (col + box[i, 0]) * stride, (row + box[i, 1]) * stride
    w, h = np.exp(box[i, 2]) * stride, np.exp(box[i, 3]) * stride
    marks = (points[i].reshape(-1, 5, 2) + np.stack([col, row], axis=1)[:, None, :]) * stride
    return np.column_stack((cx - w / 2, cy - h / 2, w, h, score[i], marks.reshape(-1, 10)))


def focus_crop(orientation: int, x_pct: float | None, y_pct: float | None, width: int, height: int) -> tuple[tuple[slice, slice], bool]:
    """Rows and columns of the square around the focus point, which is given as displayed, and whether there is one.

    Without a point the square is in the middle. Pixels are as on the sensor, so a turned picture's point turns back.
    """
    short = min(width, height)
    side = min(short, max(1, int(np.float32(FOCUS_SHARE) * np.float32(short))))
    valid = x_pct is not None and y_pct is not None
    if valid:
        x, y = (min(1.0, max(0.0, v / 100)) for v in (x_pct, y_pct))
        x, y = {3: (1 - x, 1 - y), 6: (y, 1 - x), 8: (1 - y, x)}.get(orientation, (x, y))
    else:
        x = y = 0.5
    corner = lambda at, size: min(size - side, int(max(0.0, math.floor(at * size - side / 2 + 0.5))))
    left, top = corner(x, width), corner(y, height)
    return (slice(top, top + side), slice(left, left + side)), valid


def eye_box(x: float, y: float, between: float, width: int, height: int) -> tuple[int, int, int, int] | None:
    """x, y, w, h of an eye's crop, sized by the distance between the eyes and inside the image; None where it is too small."""
    if not all(map(math.isfinite, (x, y, between))) or between <= 0:
        return None
    w = int(between * EYE_SHARE)
    h = w * EYE_SIZE[1] // EYE_SIZE[0]
    if w < EYE_LEAST or not h or w > width or h > height:
        return None
    return min(width - w, max(0, int(x) - w // 2)), min(height - h, max(0, int(y) - h // 2)), w, h


def cropped(rgb: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    x, y, w, h = box
    return rgb[y : y + h, x : x + w]


def planes(rgb: np.ndarray) -> np.ndarray:
    """3 x h x w in red, green, blue, from 0 to 1."""
    return (rgb.astype(np.float32) / np.float32(255)).transpose(2, 0, 1)


def padded_planes(rgb: np.ndarray, step: int = 32) -> np.ndarray:
    """3 x h x w in blue, green, red, as they are, with zeros to the right and below up to multiples of ``step``."""
    h, w = rgb.shape[:2]
    out = np.zeros((3, -(-h // step) * step, -(-w // step) * step), dtype=np.float32)
    out[:, :h, :w] = rgb[..., ::-1].transpose(2, 0, 1)
    return out


def normalised(value: float, noise: float) -> float:
    return float(min(1.0, max(0.0, math.log1p(value / max(noise, 1e-3)) / 12.0)))


def motion_blur(shutter_seconds: float | None, focal_mm: float | None, sharpness: float) -> float:
    """How far the exposure is over what can be held by hand, less for a sharp frame."""
    if not shutter_seconds or not focal_mm or shutter_seconds <= 0 or focal_mm <= 0:
        return 0.0
    return min(1.0, shutter_seconds * focal_mm) * (1 - min(1.0, max(0.0, sharpness)))


FEATURES = (
    "path string, decode_ok boolean, width int, height int, af double, af_valid boolean, af_texture double, global_sharpness double, global_texture double, noise_floor double, "
    "tenengrad double, exposure_score double, motion_blur_likelihood double, blown_pct double, crushed_pct double, phash string"
)
#: What the scores take from the metadata, null where images do not have it.
_OF_METADATA = {"orientation": "int", "af_x_pct": "double", "af_y_pct": "double", "shutter_seconds": "double", "focal_mm": "double"}


def scores(rgb: np.ndarray, orientation: int | None, af_x_pct: float | None, af_y_pct: float | None, shutter_seconds: float | None, focal_mm: float | None) -> tuple:
    """The values of FEATURES after height, of one image."""
    y = luma(rgb)
    noise = noise_floor(y)
    where, valid = focus_crop(orientation or 1, af_x_pct, af_y_pct, y.shape[1], y.shape[0])
    focus, (blown, crushed) = y[where], clipped(rgb)
    sharp = normalised(laplacian_variance(y), noise)
    return (
        normalised(laplacian_variance(focus), noise), valid, texture_spread(focus), sharp, texture_spread(y), noise, normalised(tenengrad(focus), max(noise, 1.0)),
        exposure_score(y), motion_blur(shutter_seconds, focal_mm, sharp), blown, crushed, phash(y),
    )


def features(images: DataFrame) -> DataFrame:
    """FEATURES of each (path, width, height, rgb packed h x w x 3, and what _OF_METADATA names); pixels stay in the task that has them.

    A buffer of the wrong length or size has decode_ok false and nulls: a bad file is data, not an error.
    """
    names = [c.split()[0] for c in FEATURES.split(", ")]
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, w, h, raw, *known in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if raw is None or w is None or h is None or w <= 0 or h <= 0 or len(raw) != w * h * 3:
                    rows.append((path, False, *[None] * (len(names) - 2)))
                    continue
                rows.append((path, True, w, h, *scores(np.frombuffer(raw, dtype=np.uint8).reshape(h, w, 3), *known)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(columns, FEATURES.split(", "), strict=True)], names)

    more = [F.col(c).cast(t).alias(c) if c in images.columns else F.lit(None).cast(t).alias(c) for c, t in _OF_METADATA.items()]
    return images.select("path", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "rgb", *more).mapInArrow(run, FEATURES)
