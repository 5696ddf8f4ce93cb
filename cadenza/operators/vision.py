"""Pixel kernels on raw frames (height x width x 3 bytes, blue first), in numpy
behind pandas functions. Estimators with random samples use a fixed seed and
agree with other implementations within tolerances, not bit by bit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def to_array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def gray(image: np.ndarray) -> np.ndarray:
    return image @ np.array([0.114, 0.587, 0.299])


def hsv(image: np.ndarray) -> np.ndarray:
    """Hue 0..180, saturation and value 0..255."""
    b, g, r = (image[..., i].astype(np.float64) for i in range(3))
    v = np.maximum(np.maximum(b, g), r)
    d = v - np.minimum(np.minimum(b, g), r)
    s = np.where(v > 0, d / np.maximum(v, 1) * 255, 0)
    safe = np.where(d > 0, d, 1)
    h = np.select([d == 0, v == r, v == g], [0.0, 60 * (g - b) / safe, 120 + 60 * (b - r) / safe], 240 + 60 * (r - g) / safe)
    return np.stack(((h % 360) / 2, s, v), axis=-1)


def _slide(mask: np.ndarray, size: int, pick) -> np.ndarray:
    r = size // 2
    fill = pick is np.minimum
    out = mask
    for axis in (0, 1):
        wide = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        pad = np.pad(out, wide, constant_values=fill)
        parts = [np.take(pad, range(k, k + out.shape[axis]), axis=axis) for k in range(size)]
        out = pick.reduce(parts)
    return out


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    return _slide(mask, size, np.maximum)


def erode(mask: np.ndarray, size: int) -> np.ndarray:
    return _slide(mask, size, np.minimum)


def close(mask: np.ndarray, size: int, times: int = 1) -> np.ndarray:
    for f in (dilate, erode):
        for _ in range(times):
            mask = f(mask, size)
    return mask


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The greatest 4-connected component, by spreading of least labels."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        low = np.where(label > 0, label, big)
        for axis in (0, 1):
            for way in (1, -1):
                moved = np.roll(low, way, axis)
                edge = [slice(None)] * 2
                edge[axis] = 0 if way == 1 else -1
                moved[tuple(edge)] = big
                low = np.where(mask, np.minimum(low, moved), big)
        flat = low.reshape(-1)
        jump = np.where(mask, np.append(flat, big)[np.clip(low - 1, 0, mask.size)], big)
        new = np.where(mask, np.minimum(low, jump), 0)
        if (new == label).all():
            break
        label = new
    values, count = np.unique(label[label > 0], return_counts=True)
    return label == values[count.argmax()] if len(values) else np.zeros_like(mask)


def hull(mask: np.ndarray) -> np.ndarray:
    """The convex hull of a mask's pixels, clockwise as seen."""
    rows = np.flatnonzero(mask.any(1))
    ends = [(int(c), int(r)) for r in rows for c in (mask[r].argmax(), mask.shape[1] - 1 - mask[r, ::-1].argmax())]

    def half(points):
        out: list[tuple[int, int]] = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ends = sorted(set(ends))
    return np.array(half(ends) + half(ends[::-1]) if len(ends) > 2 else ends, np.float64)


def simplified(polygon: np.ndarray, most: float) -> np.ndarray:
    """A closed polygon without the points that lie within `most` of what is
    left (Douglas and Peucker, from the two points furthest apart)."""
    n = len(polygon)
    if n < 3:
        return polygon
    far = np.hypot(*(polygon[:, None] - polygon[None]).transpose(2, 0, 1))
    a, b = sorted(np.unravel_index(far.argmax(), far.shape))
    keep, todo = {int(a), int(b)}, [(int(a), int(b)), (int(b), int(a) + n)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        p, q, between = polygon[i % n], polygon[j % n], polygon[np.arange(i + 1, j) % n]
        d = np.abs((q[0] - p[0]) * (between[:, 1] - p[1]) - (q[1] - p[1]) * (between[:, 0] - p[0])) / max(1e-9, np.hypot(*(q - p)))
        k = int(d.argmax())
        if d[k] > most:
            keep.add((i + 1 + k) % n)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return polygon[sorted(keep)]


def opened(mask: np.ndarray, size: int) -> np.ndarray:
    return dilate(erode(mask, size), size)


# Shares of the perimeter within which a region's outline is simplified.
OUTLINES = (0.010, 0.012, 0.015, 0.018, 0.020, 0.025, 0.030, 0.040)


def detect_screen(image: np.ndarray, low=(85, 20, 50), high=(130, 255, 255), least_share: float = 0.20) -> np.ndarray | None:
    """Corners (TL, TR, BR, BL) of the greatest region in a colour range: its
    gaps closed, specks opened away, the outline simplified until it has four
    corners that are a valid screen; None if that fails or it is too small."""
    colour = hsv(image)
    mask = np.all((colour >= low) & (colour <= high), axis=-1)
    size = max(3, min(25, min(mask.shape) // 8) | 1)
    mask = largest_component(opened(close(mask, size, 2), 5))
    if mask.sum() < least_share * mask.size:
        return None
    outline = hull(mask)
    around = np.hypot(*(outline - np.roll(outline, 1, axis=0)).T).sum()
    for share in OUTLINES:
        four = simplified(outline, share * around)
        if len(four) == 4:
            s, d = four.sum(1), four[:, 1] - four[:, 0]
            quad = four[[s.argmin(), d.argmin(), s.argmax(), d.argmax()]]
            if screen_like(quad, mask.shape[1], mask.shape[0]):
                return quad
    return None


def screen_like(quad: np.ndarray, width: int, height: int) -> bool:
    """Area share and form of a screen, corners in order."""
    side = np.hypot(*(np.roll(quad, -1, axis=0) - quad).T)
    x, y = quad.T
    area = abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2
    tall = (side[1] + side[3]) / 2
    return bool(0.20 <= area / (width * height) <= 0.85 and tall > 0 and 1.25 <= (side[0] + side[2]) / 2 / tall <= 2.35)


def convex_mask(quad: np.ndarray, shape: tuple[int, int], margin: float = 0.0) -> np.ndarray:
    """Pixels inside a clockwise quad, at least `margin` from its edges."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    inside = np.ones(shape, bool)
    for k in range(4):
        (x0, y0), (x1, y1) = quad[k], quad[(k + 1) % 4]
        length = max(1e-9, np.hypot(x1 - x0, y1 - y0))
        inside &= ((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / length >= margin
    return inside


def _box(a: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    c = np.pad(a, r + 1, mode="edge").cumsum(0).cumsum(1)
    n = 2 * r + 1
    return (c[n:, n:] - c[:-n, n:] - c[n:, :-n] + c[:-n, :-n])[: a.shape[0], : a.shape[1]]


def corner_points(image: np.ndarray, mask: np.ndarray | None = None, most: int = 900, quality: float = 0.005, distance: float = 8.0, block: int = 7) -> np.ndarray:
    """Corners by the structure tensor's lesser eigenvalue, best first, none
    nearer than `distance` to a better one."""
    gy, gx = np.gradient(image)
    a, b, c = _box(gx * gx, block), _box(gx * gy, block), _box(gy * gy, block)
    score = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b**2)
    if mask is not None:
        score = np.where(mask, score, 0)
    top = score.max(initial=0)
    y, x = np.nonzero((score > 0) & (score >= quality * top))
    order = np.argsort(-score[y, x], kind="stable")
    cells: dict[tuple[int, int], list[tuple[int, int]]] = {}
    out = []
    for px, py in zip(x[order].tolist(), y[order].tolist(), strict=True):
        cx, cy = int(px // distance), int(py // distance)
        near = (p for i in (-1, 0, 1) for j in (-1, 0, 1) for p in cells.get((cx + i, cy + j), ()))
        if all((px - qx) ** 2 + (py - qy) ** 2 >= distance**2 for qx, qy in near):
            cells.setdefault((cx, cy), []).append((px, py))
            out.append((px, py))
            if len(out) == most:
                break
    return np.array(out, np.float64).reshape(-1, 2)


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear, the border repeated."""
    h, w = image.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    if image.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    return (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy


def track(before: np.ndarray, after: np.ndarray, points: np.ndarray, window: int = 31, levels: int = 3, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Pyramidal Lucas-Kanade: new places and whether they were found."""
    pyramid = [(before, after)]
    for _ in range(levels):
        a, b = pyramid[-1]
        if min(a.shape) < 2 * window:
            break
        pyramid.append((_box(a, 3)[::2, ::2] / 9, _box(b, 3)[::2, ::2] / 9))
    r = window // 2
    dy, dx = np.mgrid[-r : r + 1, -r : r + 1]
    flow, ok = np.zeros_like(points), np.ones(len(points), bool)
    for level in range(len(pyramid) - 1, -1, -1):
        a, b = pyramid[level]
        at = points / 2**level
        flow = flow * 2 if level < len(pyramid) - 1 else flow
        gy, gx = np.gradient(a)
        x, y = at[:, 0, None, None] + dx, at[:, 1, None, None] + dy
        patch, px, py = sample(a, x, y), sample(gx, x, y), sample(gy, x, y)
        sxx, sxy, syy = (px * px).sum((1, 2)), (px * py).sum((1, 2)), (py * py).sum((1, 2))
        det = sxx * syy - sxy**2
        ok &= det > 1e-6
        safe = np.where(det > 1e-6, det, 1)
        for _ in range(rounds):
            error = patch - sample(b, x + flow[:, 0, None, None], y + flow[:, 1, None, None])
            ex, ey = (error * px).sum((1, 2)), (error * py).sum((1, 2))
            step = np.stack(((syy * ex - sxy * ey) / safe, (sxx * ey - sxy * ex) / safe), axis=1)
            flow = flow + np.where(ok[:, None], step, 0)
            if np.abs(step[ok]).max(initial=0) < 0.01:
                break
    out = points + flow
    h, w = before.shape
    ok &= (out[:, 0] >= 0) & (out[:, 1] >= 0) & (out[:, 0] < w) & (out[:, 1] < h)
    return out, ok


def fit_similarity(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Least squares, as 3 x 3."""
    cp, cq = p.mean(0), q.mean(0)
    a, b = p - cp, q - cq
    n = max((a**2).sum(), 1e-12)
    c, s = (a * b).sum() / n, (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum() / n
    m = np.array([[c, -s], [s, c]])
    return np.vstack((np.column_stack((m, cq - m @ cp)), [0, 0, 1]))


def fit_homography(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Normalised direct linear transform."""

    def norm(x):
        c = x.mean(0)
        s = np.sqrt(2) / max(np.hypot(*(x - c).T).mean(), 1e-12)
        return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    tp, tq = norm(p), norm(q)
    (x, y), (u, v) = (p @ tp[:2, :2].T + tp[:2, 2]).T, (q @ tq[:2, :2].T + tq[:2, 2]).T
    zero, one = np.zeros_like(x), np.ones_like(x)
    rows = np.vstack((np.stack((-x, -y, -one, zero, zero, zero, u * x, u * y, u), 1), np.stack((zero, zero, zero, -x, -y, -one, v * x, v * y, v), 1)))
    h = np.linalg.inv(tq) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ tp
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h


def apply(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    z = np.column_stack((points, np.ones(len(points)))) @ h.T
    return z[:, :2] / np.where(np.abs(z[:, 2:]) < 1e-12, 1e-12, z[:, 2:])


def ransac(p: np.ndarray, q: np.ndarray, fit, size: int, most_error: float, rounds: int = 500, seed: int = 7) -> tuple[np.ndarray | None, np.ndarray]:
    """A transform and its inliers by seeded samples, refitted to the best."""
    if len(p) < size:
        return None, np.zeros(len(p), bool)
    rng = np.random.default_rng(seed)
    best = np.zeros(len(p), bool)
    for _ in range(rounds):
        pick = rng.choice(len(p), size, replace=False)
        inside = np.hypot(*(apply(fit(p[pick], q[pick]), p) - q).T) <= most_error
        if inside.sum() > best.sum():
            best = inside
    if best.sum() < size:
        return None, best
    return fit(p[best], q[best]), best


def pair_motion(before: np.ndarray, after: np.ndarray, least: int = 30, most_error: float = 2.0) -> dict:
    """Motion of two gray frames, as the stability table has it."""
    nothing = {"ok": False, "tracked_count": 0, "inlier_count": 0, "inlier_ratio": None, "translation_x_px": None, "translation_y_px": None, "translation_px": None, "rotation_deg": None, "scale": None, "scale_delta": None}
    points = corner_points(before, most=800, quality=0.01, distance=10)
    out = nothing | {"feature_count": len(points)}
    if len(points) < least:
        return out | {"reason": "not_enough_features"}
    to, ok = track(before, after, points)
    if not ok.any():
        return out | {"reason": "flow_failed"}
    out["tracked_count"] = int(ok.sum())
    if ok.sum() < least:
        return out | {"reason": "not_enough_tracked_points"}
    m, inside = ransac(points[ok], to[ok], fit_similarity, 2, most_error)
    if m is None:
        return out | {"reason": "affine_failed"}
    scale = float(np.hypot(m[0, 0], m[1, 0]))
    tx, ty = float(m[0, 2]), float(m[1, 2])
    return out | {
        "ok": True, "reason": "ok", "inlier_count": int(inside.sum()), "inlier_ratio": float(inside.sum() / max(1, ok.sum())), "translation_x_px": tx, "translation_y_px": ty,
        "translation_px": float(np.hypot(tx, ty)), "rotation_deg": float(np.degrees(np.arctan2(m[1, 0], m[0, 0]))), "scale": scale, "scale_delta": scale - 1,
    }


def sample_cubic(image: np.ndarray, x: np.ndarray, y: np.ndarray, a: float = -0.75) -> np.ndarray:
    """Bicubic, the border repeated."""
    h, w = image.shape[:2]
    x0, y0 = np.floor(x), np.floor(y)

    def weights(t):
        d = np.stack((1 + t, t, 1 - t, 2 - t))
        near = ((a + 2) * d - (a + 3)) * d * d + 1
        return np.where(d <= 1, near, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a)

    wx, wy = weights(x - x0), weights(y - y0)
    out = 0.0
    for j in range(4):
        row = np.clip(y0 + j - 1, 0, h - 1).astype(int)
        for i in range(4):
            part = image[row, np.clip(x0 + i - 1, 0, w - 1).astype(int)]
            share = wx[i] * wy[j]
            out = out + part * (share[..., None] if image.ndim == 3 else share)
    return out


def crop_transform(width: int, height: int, left: float, top: float, right: float, bottom: float) -> np.ndarray:
    """Shares cut from each side of a canvas and the rest stretched over it."""
    x0, x1, y0, y1 = round(width * left), round(width * (1 - right)), round(height * top), round(height * (1 - bottom))
    if x0 >= x1 or y0 >= y1:
        raise ValueError("the crop is empty")
    sx, sy = width / (x1 - x0), height / (y1 - y0)
    return np.array([[sx, 0, sx * (0.5 - x0) - 0.5], [0, sy, sy * (0.5 - y0) - 0.5], [0, 0, 1]])


def warp(image: np.ndarray, h: np.ndarray, width: int, height: int, cubic: bool = False) -> np.ndarray:
    """The frame seen through transform h (frame to output)."""
    y, x = np.mgrid[:height, :width]
    at = apply(np.linalg.inv(h), np.column_stack((x.reshape(-1), y.reshape(-1))).astype(float))
    look = sample_cubic if cubic else sample
    flat = look(image.astype(np.float64), at[:, 0].reshape(height, width), at[:, 1].reshape(height, width))
    return np.clip(np.rint(flat), 0, 255).astype(np.uint8)


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """About the middle pixel."""
    h, w = image.shape[:2]
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    cx, cy = (w - 1) / 2, (h - 1) / 2
    return warp(image, np.array([[c, s, cx - c * cx - s * cy], [-s, c, cy + s * cx - c * cy], [0, 0, 1]]), w, h)


def line_roll_mask(height: int, width: int, top: float = 0.2, side: float = 0.2, bottom: float = 0.2, ignore_top: float = 0.0) -> np.ndarray:
    """Top, right and bottom bands, without an ignored strip at the top."""
    y, x = np.mgrid[:height, :width]
    return ((y < top * height) | (x >= (1 - side) * width) | (y >= (1 - bottom) * height)) & (y >= ignore_top * height)


def foreground(image: np.ndarray, mask: np.ndarray, white: float = 200.0, percentile: float = 50.0, saturation: float = 60.0, colour: float = 220.0) -> np.ndarray:
    """Dark, or saturated and below the colour threshold, within the mask; dark
    is below the background level min(white, percentile of the masked gray)."""
    level = gray(image)
    back = min(white, float(np.percentile(level[mask], percentile))) if mask.any() else white
    return mask & ((level < back) | ((hsv(image)[..., 1] > saturation) & (level < colour)))


def adjacent_motion(frames: DataFrame) -> DataFrame:
    """Stability rows of each frame and its predecessor. Frames are streamed in
    order; a task holds two of them."""
    columns = "video string, frame int, ok boolean, reason string, feature_count int, tracked_count int, inlier_count int, inlier_ratio double, translation_x_px double, translation_y_px double, translation_px double, rotation_deg double, scale double, scale_delta double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, before = None, None
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                now = gray(to_array(r.data, r.height, r.width, r.channels))
                if r.video == name:
                    rows.append({"video": r.video, "frame": r.frame} | pair_motion(before, now))
                name, before = r.video, now
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])

    return frames.repartition("video").sortWithinPartitions("video", "frame").mapInPandas(run, columns)


def warp_frames(frames: DataFrame, width: int, height: int, crop: tuple[float, float, float, float] = (0, 0, 0, 0), cubic: bool = True) -> DataFrame:
    """frames(video, frame, height, width, channels, data, transform array of 9)
    seen through their transforms, shares (left, top, right, bottom) cut off, in
    the frame layout."""
    cut = crop_transform(width, height, *crop)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                out = warp(to_array(r.data, r.height, r.width, r.channels), cut @ np.array(r.transform, float).reshape(3, 3), width, height, cubic)
                yield pd.DataFrame({"video": [r.video], "frame": [r.frame], "height": [height], "width": [width], "channels": [r.channels], "data": [out.tobytes()]})

    return frames.mapInPandas(run, "video string, frame int, height int, width int, channels int, data binary")


def screen_corners(frames: DataFrame) -> DataFrame:
    """(video, frame, corners array<double> of eight, null if none)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [detect_screen(to_array(r.data, r.height, r.width, r.channels)) for r in b.itertuples(index=False)]
            yield pd.DataFrame({"video": b["video"], "frame": b["frame"], "corners": [None if q is None else q.reshape(-1) for q in found]})

    return frames.mapInPandas(run, "video string, frame int, corners array<double>")
