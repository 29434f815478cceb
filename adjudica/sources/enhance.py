"""Page pictures made easier to read for OCR, in plain numpy: grey levels, smoothing that keeps edges, local contrast,
a threshold by neighbourhood, sharpening and quarter turns. A picture is an array of rows of pixels, grey or with
colours last, 0 to 255; opening and writing picture files is the adapters' part."""

from __future__ import annotations

import numpy as np

# Shares of red, green and blue in a grey level.
GREY = (0.299, 0.587, 0.114)


def grey(picture: np.ndarray) -> np.ndarray:
    if picture.ndim == 2:
        return picture.astype(np.uint8)
    return np.rint(picture[..., :3].astype(np.float64) @ np.array(GREY)).clip(0, 255).astype(np.uint8)


def shifted(picture: np.ndarray, reach: int):
    """(dy, dx, the picture moved by them) for every step up to ``reach``, its border repeated."""
    padded = np.pad(picture, reach, mode="edge")
    h, w = picture.shape
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            yield dy, dx, padded[reach + dy : reach + dy + h, reach + dx : reach + dx + w]


def smooth(picture: np.ndarray, reach: int = 4, level: float = 75.0, space: float = 75.0) -> np.ndarray:
    """A mean of the neighbours, weighted by how near they are in place and in grey level."""
    own, total, weight = picture.astype(np.float64), 0.0, 0.0
    for dy, dx, other in shifted(own, reach):
        if dy * dy + dx * dx <= reach * reach:
            share = np.exp(-(dy * dy + dx * dx) / (2 * space**2) - (other - own) ** 2 / (2 * level**2))
            total, weight = total + share * other, weight + share
    return np.rint(total / weight).clip(0, 255).astype(np.uint8)


def contrast(picture: np.ndarray, tiles: int = 8, limit: float = 2.0) -> np.ndarray:
    """Equalised by tile, no level counting more than ``limit`` times its even share, and blended between tiles."""
    h, w = picture.shape
    rows, columns = (np.linspace(0, n, min(tiles, n) + 1).astype(int) for n in (h, w))
    maps = np.empty((len(rows) - 1, len(columns) - 1, 256))
    for i in range(len(rows) - 1):
        for j in range(len(columns) - 1):
            tile = picture[rows[i] : rows[i + 1], columns[j] : columns[j + 1]]
            counts = np.bincount(tile.ravel(), minlength=256).astype(np.float64)
            most = max(1.0, limit * tile.size / 256)
            counts = np.minimum(counts, most) + np.maximum(counts - most, 0).sum() / 256
            maps[i, j] = np.cumsum(counts) * 255 / tile.size

    def between(edges: np.ndarray, n: int):
        middles = (edges[:-1] + edges[1:] - 1) / 2
        at = np.interp(np.arange(n), middles, np.arange(len(middles)))
        low = np.minimum(at.astype(int), len(middles) - 1)
        return low, np.minimum(low + 1, len(middles) - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = between(rows, h), between(columns, w)
    fy, fx = fy[:, None], fx[None, :]
    level = lambda y, x: maps[y[:, None], x[None, :], picture]
    out = (1 - fy) * ((1 - fx) * level(y0, x0) + fx * level(y0, x1)) + fy * ((1 - fx) * level(y1, x0) + fx * level(y1, x1))
    return np.rint(out).clip(0, 255).astype(np.uint8)


def threshold(picture: np.ndarray, block: int = 31, less: float = 10.0) -> np.ndarray:
    """White where a pixel is above the mean of its block less a constant, else black."""
    reach = block // 2
    padded = np.pad(picture.astype(np.float64), reach, mode="edge")
    sums = np.pad(padded.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    size = 2 * reach + 1
    mean = (sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]) / size**2
    return np.where(picture > mean - less, 255, 0).astype(np.uint8)


def sharpen(picture: np.ndarray) -> np.ndarray:
    """Five times the pixel less its four neighbours."""
    own = picture.astype(np.int64)
    around = sum(other for dy, dx, other in shifted(own, 1) if abs(dy) + abs(dx) == 1)
    return (5 * own - around).clip(0, 255).astype(np.uint8)


def page(picture: np.ndarray) -> np.ndarray:
    """What a page goes through before OCR: grey, smoothed, contrast, threshold."""
    return threshold(contrast(smooth(grey(picture))))


def variants(picture: np.ndarray) -> dict[str, np.ndarray]:
    """The pictures of which OCR's best result is kept, by name."""
    own = grey(picture)
    return {"grey": own, "denoise": smooth(own), "contrast": contrast(own), "sharpen": sharpen(own), "adaptive": threshold(own), "rotate": np.rot90(own).copy()}
