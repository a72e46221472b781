"""Page kernels: numpy functions on one dense raster, for use inside Arrow batches.

A gray page is a 2-D uint8 array, a mask a 2-D bool array (true: black ink). Sums are 64-bit
integers, so results don't depend on the order in which pixels are visited.
"""

from __future__ import annotations

import numpy as np


def box_sums(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of pixels in the square window of each pixel, clipped at the borders."""
    h, w = values.shape
    table = np.zeros((h + 1, w + 1), np.int64)
    table[1:, 1:] = values.astype(np.int64).cumsum(0).cumsum(1)
    y, x = np.arange(h), np.arange(w)
    top, bottom = np.maximum(y - radius, 0), np.minimum(y + radius, h - 1) + 1
    left, right = np.maximum(x - radius, 0), np.minimum(x + radius, w - 1) + 1
    rows = table[bottom] - table[top]
    return rows[:, right] - rows[:, left], np.outer(bottom - top, right - left)


def contrast(page: np.ndarray, amount: float) -> np.ndarray:
    """Stretch about 128 in single precision; halves round away from zero."""
    if amount == 0:
        return page
    factor = np.float32(1.0) + np.float32(amount)
    moved = factor * (page.astype(np.float32) - np.float32(128)) + np.float32(128)
    return np.clip(np.trunc(moved + np.copysign(np.float32(0.5), moved)), 0, 255).astype(np.uint8)


def box_mean(page: np.ndarray, radius: int) -> np.ndarray:
    sums, counts = box_sums(page, radius)
    return (sums // counts).astype(np.uint8)


def flatten_background(page: np.ndarray, radius: int) -> np.ndarray:
    """Subtract the local mean and lift back to white."""
    if radius == 0:
        return page
    return np.clip(page.astype(np.int16) - box_mean(page, radius) + 255, 0, 255).astype(np.uint8)


def median3(page: np.ndarray) -> np.ndarray:
    """3 x 3 median; the border and pages under three pixels stay."""
    h, w = page.shape
    if h < 3 or w < 3:
        return page
    out = page.copy()
    around = np.stack([page[dy : h - 2 + dy, dx : w - 2 + dx] for dy in range(3) for dx in range(3)])
    out[1:-1, 1:-1] = np.partition(around, 4, axis=0)[4]
    return out


def histogram(page: np.ndarray) -> np.ndarray:
    return np.bincount(page.ravel(), minlength=256).astype(np.int64)


def otsu(counts: np.ndarray) -> int:
    """Threshold of the largest between-class variance; the lowest of equals, 0 if there is none."""
    total, grand = int(counts.sum()), int((counts * np.arange(256)).sum())
    back, back_sum = counts.cumsum(), (counts * np.arange(256)).cumsum()
    ok = (back > 0) & (back < total)
    if not ok.any():
        return 0
    b, bs = back[ok].astype(float), back_sum[ok]
    f = (total - back[ok]).astype(float)
    gap = bs / b - (grand - bs) / f
    variance = b * f * gap * gap
    return int(np.flatnonzero(ok)[variance.argmax()]) if variance.max() > 0 else 0


def sauvola(page: np.ndarray, window: int = 33, k: float = 0.2, dynamic_range: float = 128.0) -> np.ndarray:
    """Local threshold; ``k`` and the range are single-precision parameters."""
    sums, counts = box_sums(page, window // 2)
    squares, _ = box_sums(page.astype(np.int64) ** 2, window // 2)
    mean = sums / counts
    deviation = np.sqrt(np.maximum(squares / counts - mean * mean, 0.0))
    threshold = mean * (1.0 + float(np.float32(k)) * (deviation / float(np.float32(dynamic_range)) - 1.0))
    return page <= threshold


def small_components(mask: np.ndarray, most: int) -> np.ndarray:
    """Black pixels of 4-connected components of at most ``most`` pixels.

    Labels spread as minima for ``most`` rounds; a component that is small enough has settled by
    then. A group of equal labels is whole if no neighbour carries another label.
    """
    h, w = mask.shape
    if most <= 0 or not mask.any():
        return np.zeros_like(mask)
    far = h * w
    labels = np.full((h + 2, w + 2), far, np.int64)
    labels[1:-1, 1:-1] = np.where(mask, np.arange(far).reshape(h, w), far)
    inner = labels[1:-1, 1:-1]
    sides = (labels[:-2, 1:-1], labels[2:, 1:-1], labels[1:-1, :-2], labels[1:-1, 2:])
    for _ in range(most):
        low = np.minimum.reduce([inner, *sides])
        inner[:] = np.where(mask, low, far)
    open_at = np.zeros_like(mask)
    for s in sides:
        open_at |= mask & (s != far) & (s != inner)
    own = inner[mask]
    size = np.bincount(own, minlength=far)
    leaks = np.bincount(inner[open_at], minlength=far) if open_at.any() else np.zeros(far, np.int64)
    small = (size > 0) & (size <= most) & (leaks == 0)
    out = np.zeros_like(mask)
    out[mask] = small[own]
    return out


def despeckle(mask: np.ndarray, most: int) -> np.ndarray:
    return mask & ~small_components(mask, most)


def confusion(out: np.ndarray, truth: np.ndarray) -> tuple[int, int, int, int]:
    """True and false positives, false and true negatives; black is positive."""
    if out.shape != truth.shape:
        raise ValueError(f"masks differ in size: {out.shape} and {truth.shape}")
    tp, fp, fn = int((out & truth).sum()), int((out & ~truth).sum()), int((~out & truth).sum())
    return tp, fp, fn, out.size - tp - fp - fn


def nonuniform_blocks(mask: np.ndarray, side: int = 8) -> int:
    """Blocks, partial ones at the edges included, that hold both colours."""
    h, w = mask.shape
    rows = np.add.reduceat(mask.astype(np.int64), np.arange(0, h, side), axis=0)
    ink = np.add.reduceat(rows, np.arange(0, w, side), axis=1)
    hs, ws = np.minimum(side, h - np.arange(0, h, side)), np.minimum(side, w - np.arange(0, w, side))
    return int(((ink > 0) & (ink < np.outer(hs, ws))).sum())


#: Squared distances of the 24 neighbours in a 5 x 5 window.
DISTANCES = (1, 2, 4, 5, 8)


def drd_counts(out: np.ndarray, truth: np.ndarray) -> list[int]:
    """For each distance class: neighbours of flipped pixels that differ from the output pixel.

    Neighbours outside the page are white. Counting whole numbers makes the later dot product with
    the weights independent of order.
    """
    h, w = truth.shape
    framed = np.zeros((h + 4, w + 4), bool)
    framed[2:-2, 2:-2] = truth
    flipped = out != truth
    counts = dict.fromkeys(DISTANCES, 0)
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            if dy or dx:
                differs = framed[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w] != out
                counts[dy * dy + dx * dx] += int((differs & flipped).sum())
    return [counts[d] for d in DISTANCES]


def pack_bits(mask: np.ndarray) -> bytes:
    """Rows of bytes, most significant bit first, padded with zeros."""
    return np.packbits(mask, axis=1).tobytes()


def unpack_bits(data: bytes, width: int, height: int) -> np.ndarray:
    stride = -(-width // 8)
    return np.unpackbits(np.frombuffer(data, np.uint8).reshape(height, stride), axis=1)[:, :width].astype(bool)
