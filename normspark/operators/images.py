"""Image kernels over arrays of grey or colour values, vectorised in numpy behind Arrow functions.

Borders are mirrored without repeating the edge pixel, as is usual for these filters. Decoding is injected: a
``decode(bytes) -> H x W x 3 uint8`` callable; the kernels only see arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Weights of red, green and blue in grey.
GREY = np.array([0.299, 0.587, 0.114])
METRICS = ["brightness", "contrast", "sharpness", "noise", "clipping", "blockiness", "edge_centroid_x", "edge_centroid_y", "log_focus_ratio", "log_flat_noise"]


def convolve(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation of a 2-D array with a small odd kernel, mirrored at the border."""
    ky, kx = kernel.shape
    padded = np.pad(image, ((ky // 2, ky // 2), (kx // 2, kx // 2)), mode="reflect")
    views = np.lib.stride_tricks.sliding_window_view(padded, kernel.shape)
    return np.einsum("ijkl,kl->ij", views, kernel)


def gaussian(image: np.ndarray, sigma: float, reach: float = 4.0) -> np.ndarray:
    """Separable Gaussian blur over ``reach`` deviations to either side (3 is usual for 8-bit images, 4 for others)."""
    r = min((round(2 * reach * sigma + 1) | 1) // 2, min(image.shape) - 1)
    line = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    line /= line.sum()
    return convolve(convolve(image, line[None, :]), line[:, None])


# Derivative filters.
SOBEL = np.array([[-1.0, 0, 1], [-2, 0, 2], [-1, 0, 1]])
LAPLACE = np.array([[2.0, 0, 2], [0, -8, 0], [2, 0, 2]])


def capture_metrics(grey: np.ndarray) -> dict[str, float]:
    """The capture measurements of a grey image in 0..1: exposure, focus, noise, compression and framing."""
    grey = grey.astype(np.float64)
    laplace, dx, dy = convolve(grey, LAPLACE), convolve(grey, SOBEL), convolve(grey, SOBEL.T)
    size = np.hypot(dx, dy)
    weight = size.sum()
    ys, xs = (np.linspace(-1, 1, n) for n in grey.shape)
    steps = [np.abs(np.diff(grey, axis=1)), np.abs(np.diff(grey, axis=0)).T]
    edge = [np.arange(s.shape[1]) % 8 == 7 for s in steps]
    at = np.concatenate([s[:, e].ravel() for s, e in zip(steps, edge, strict=True)])
    off = np.concatenate([s[:, ~e].ravel() for s, e in zip(steps, edge, strict=True)])
    smooth = gaussian(grey, 2.0)
    structure = (convolve(smooth, SOBEL) ** 2 + convolve(smooth, SOBEL.T) ** 2)[1:-1, 1:-1]
    cross = (grey[:-1, :-1] - grey[:-1, 1:] - grey[1:, :-1] + grey[1:, 1:])[: structure.shape[0], : structure.shape[1]] / 2
    flat = structure <= np.quantile(structure, 0.25)
    noise = np.median(np.abs(cross[flat])) / 0.67449
    values = (
        grey.mean(),
        grey.std(),
        np.log1p(laplace.var()),
        np.median(np.abs(grey - gaussian(grey, 1.0))),
        ((grey <= 0.02) | (grey >= 0.98)).mean(),
        (at.mean() if len(at) else 0.0) / max(off.mean() if len(off) else 0.0, 1 / 255),
        (size * xs[None, :]).sum() / weight if weight > 1e-7 else 0.0,
        (size * ys[:, None]).sum() / weight if weight > 1e-7 else 0.0,
        np.log((laplace**2).mean() / max((dx**2 + dy**2).mean(), 1e-8) + 1e-8),
        np.log(noise / max(grey.std(), 1e-4) + 1e-6),
    )
    return dict(zip(METRICS, map(float, values), strict=True))


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resize to a smaller frame: each pixel is the mean of the area that it covers."""

    def axis(n: int, m: int) -> np.ndarray:
        low = np.arange(m)[:, None] * n / m
        return np.clip(np.minimum(low + n / m, np.arange(n)[None, :] + 1) - np.maximum(low, np.arange(n)[None, :]), 0, None) * m / n

    return np.moveaxis(np.tensordot(axis(image.shape[1], width), np.tensordot(axis(image.shape[0], height), image, (1, 0)), (1, 1)), 0, 1)


def resize_linear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize with pixel centres aligned."""

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(image.shape[0], height)
    x0, x1, fx = axis(image.shape[1], width)
    shape = (-1,) + (1,) * (image.ndim - 1)
    fy, fx = fy.reshape(shape), fx.reshape((1, -1) + (1,) * (image.ndim - 2))
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def difference_hash(grey: np.ndarray) -> int:
    """64-bit difference hash of a grey image: a 9 x 8 thumbnail, a bit where a pixel is brighter than its left one, first bit highest."""
    small = np.rint(resize_linear(grey.astype(np.float64), 8, 9))
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def handcrafted(rgb: np.ndarray) -> np.ndarray:
    """Colour statistics and histograms (RGB and HSV), a local binary pattern and a gradient histogram as one vector."""
    x = rgb.astype(np.float64) / 255
    high, low = x.max(2), x.min(2)
    span = high - low
    safe = np.where(span > 0, span, 1)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    turn = np.select([high == r, high == g], [(g - b) / safe % 6, (b - r) / safe + 2], (r - g) / safe + 4) * (span > 0)
    # an 8-bit hue counts half degrees, so it ends at 179
    hue = np.rint(turn * 30) % 180 / 255
    hsv = np.stack([hue, np.rint(255 * np.where(high > 0, span / np.where(high > 0, high, 1), 0)) / 255, high], 2)
    parts = []
    for space in (x, hsv):
        for c in range(3):
            v = space[..., c]
            parts += [[v.mean(), v.std(), *np.quantile(v, [0.1, 0.5, 0.9])], np.histogram(v, 16, (0, 1))[0] / v.size]
    grey = np.rint(rgb @ GREY)
    inner = grey[1:-1, 1:-1]
    around = [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]
    h, w = inner.shape
    codes = sum((grey[y : y + h, z : z + w] >= inner).astype(int) << i for i, (y, z) in enumerate(around))
    parts.append(np.bincount(codes.ravel(), minlength=256) / max(1, codes.size))
    dx, dy = convolve(grey / 255, SOBEL), convolve(grey / 255, SOBEL.T)
    angles = np.histogram(np.degrees(np.arctan2(dy, dx)) % 360, 18, (0, 360), weights=np.hypot(dx, dy))[0]
    parts.append(angles / max(angles.sum(), 1.0))
    return np.concatenate(parts).astype(np.float32)


def rotation(height: int, width: int, angle_degrees: float, translate_x: float, translate_y: float) -> np.ndarray:
    """The 2 x 3 matrix that turns (x, y) about the frame's centre, counterclockwise in the picture, and moves it."""
    c, s = np.cos(np.deg2rad(angle_degrees)), np.sin(np.deg2rad(angle_degrees))
    x, y = (width - 1) / 2, (height - 1) / 2
    return np.array([[c, s, (1 - c) * x - s * y + translate_x], [-s, c, s * x + (1 - c) * y + translate_y]])


def inverse_affine(matrix: np.ndarray) -> np.ndarray:
    turn = np.linalg.inv(matrix[:, :2])
    return np.concatenate([turn, -turn @ matrix[:, 2:]], 1)


def warp(image: np.ndarray, matrix: np.ndarray, border: str, nearest: bool = False) -> np.ndarray:
    """``image`` moved by ``matrix``: bilinear or nearest; outside it is mirrored (``reflect``, edge pixel once) or 0 (``zero``)."""
    h, w = image.shape[:2]
    back = inverse_affine(matrix)
    y, x = np.mgrid[:h, :w]
    sx, sy = back[0, 0] * x + back[0, 1] * y + back[0, 2], back[1, 0] * x + back[1, 1] * y + back[1, 2]

    def at(yy: np.ndarray, xx: np.ndarray) -> np.ndarray:
        def mirrored(v: np.ndarray, n: int) -> np.ndarray:
            v = np.mod(v, max(1, 2 * (n - 1)))
            return np.where(v >= n, 2 * (n - 1) - v, v) if n > 1 else np.zeros_like(v)

        if border == "reflect":
            return image[mirrored(yy, h), mirrored(xx, w)]
        inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
        values = image[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)]
        return values * inside.reshape(inside.shape + (1,) * (image.ndim - 2))

    if nearest:
        return at(np.rint(sy).astype(int), np.rint(sx).astype(int))
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    shape = (h, w) + (1,) * (image.ndim - 2)
    fy, fx = (sy - y0).reshape(shape), (sx - x0).reshape(shape)
    return (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy


def aligned_map(scores: np.ndarray, matrix: np.ndarray | None) -> np.ndarray:
    """A score map of a shifted image in the coordinates of the clean one; ``matrix`` is what moved it, None if nothing did. Outside is 0."""
    return scores.copy() if matrix is None else warp(scores.astype(np.float64), inverse_affine(matrix), "zero")


def shift(image: np.ndarray, mask: np.ndarray, family: str, parameters: dict[str, float], seed: int, key: str, condition: str) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """A shifted copy of an 8-bit image, its mask, and the matrix that moved both (None but for ``geometric``).

    Noise depends only on seed, key and condition. JPEG needs a codec and isn't offered.
    """
    x, moved, matrix = image.astype(np.float64), mask.astype(bool), None
    if family == "clean":
        return image.copy(), moved, None
    if family == "noise":
        digest = hashlib.sha256(f"{seed}:{key}:{condition}".encode()).digest()
        x = x + np.random.default_rng(int.from_bytes(digest[:8], "big")).normal(0.0, 255 * parameters["standard_deviation"], x.shape)
    elif family == "blur":
        planes = x[..., None] if x.ndim == 2 else x
        x = np.rint(np.stack([gaussian(planes[..., c], parameters["sigma"], 3.0) for c in range(planes.shape[2])], 2).reshape(x.shape))
    elif family == "resize":
        h, w = x.shape[:2]
        small = np.rint(resize_area(x, max(1, round(h * parameters["scale"])), max(1, round(w * parameters["scale"]))))
        x = np.rint(resize_linear(small, h, w))
    elif family == "photometric":
        mean = x.mean((0, 1), keepdims=True)
        x = ((x - mean) * parameters["contrast"] + mean) * parameters["brightness"]
    elif family == "geometric":
        matrix = rotation(*x.shape[:2], parameters["angle_degrees"], parameters["translate_x"], parameters["translate_y"])
        x, moved = np.rint(warp(x, matrix, "reflect")), warp(moved.astype(np.uint8), matrix, "zero", nearest=True).astype(bool)
    else:
        raise ValueError(f"unknown shift family {family}")
    return np.clip(x, 0, 255).astype(np.uint8), moved, matrix


def light_and_edges(grey: np.ndarray) -> tuple[float, float]:
    """Mean of a grey image in 0..1, and of its gradient's length."""
    g = grey.astype(np.float64)
    return float(g.mean()), float(np.hypot(convolve(g, SOBEL), convolve(g, SOBEL.T)).mean())


def map_images(df: DataFrame, key: list[str], pixels: str, side: int, kernel: Callable[..., dict], schema: str) -> DataFrame:
    """``key`` and the kernel's values (``kernel(image, *key)``) for every square grey image given as an array of ``side * side`` values; others are left out."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [kernel(np.asarray(v).reshape(side, side), *k) for v, k in zip(pdf[pixels], pdf[key].itertuples(index=False), strict=True)]
            yield pd.concat([pdf[key].reset_index(drop=True), pd.DataFrame(rows, columns=columns)], axis=1)

    columns = [c.strip().split()[0] for c in schema.split(",")]
    usable = df.where((F.size(pixels) == side * side) & ~F.exists(pixels, lambda v: v.isNull())).select(*key, pixels)
    return usable.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in key) + f", {schema}")


def centred_errors(a: str, b: str):
    """Mean absolute difference of two arrays of grey values of one length, lowered by the whole part of their means (``whole``), by their
    means (``mean``), or standardised, a deviation under 1 counting as 1 (``standard``); null for nulls and other lengths. A struct column.
    """

    @F.pandas_udf("whole double, mean double, standard double")
    def errors(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(left, right, strict=True):
            if x is None or y is None or len(x) != len(y) or not len(x):
                rows.append((None, None, None))
                continue
            pair = np.stack([x, y]).astype(np.float64)
            centre, spread = pair.mean(1, keepdims=True), np.maximum(pair.std(1, keepdims=True), 1.0)
            rows.append(tuple(float(np.abs(v[0] - v[1]).mean()) for v in (pair - np.trunc(centre), pair - centre, (pair - centre) / spread)))
        return pd.DataFrame(rows, columns=["whole", "mean", "standard"])

    return errors(F.col(a), F.col(b))
