"""Pixel kernels in NumPy, one page or region at a time. Arrays are uint8, HxW gray or HxWx3 BGR.

They run inside Arrow batches (``mapInPandas``) where no built-in expression can say the same.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def to_gray(img: np.ndarray) -> np.ndarray:
    if img.ndim == 2:
        return img
    b, g, r = (img[..., i].astype(np.uint32) for i in range(3))
    # .114, .587, .299 as 14-bit fractions
    return ((b * 1868 + g * 9617 + r * 4899 + 8192) >> 14).astype(np.uint8)


def to_bgr(img: np.ndarray) -> np.ndarray:
    return np.repeat(img[..., None], 3, 2) if img.ndim == 2 else img[..., :3]


def pad101(a: np.ndarray, n: int) -> np.ndarray:
    """Mirrored border without repeating the edge; sides of one pixel repeat it."""
    if min(a.shape[:2]) > n:
        return np.pad(a, ((n, n), (n, n)), mode="reflect")
    for axis in (0, 1):
        size = a.shape[axis]
        at = np.abs(np.arange(-n, size + n))
        period = max(1, 2 * (size - 1))
        at %= period
        at = np.where(at >= size, period - at, at)
        a = np.take(a, at, axis=axis)
    return a


def laplacian(gray: np.ndarray) -> np.ndarray:
    p = pad101(gray.astype(np.int64), 1)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def moments(a: np.ndarray) -> tuple[int, int, int]:
    """Count, sum and sum of squares, exact."""
    v = a.astype(np.int64).ravel()
    return v.size, int(v.sum()), int((v * v).sum())


def variance(n: int, s1: int, s2: int) -> float:
    return (n * s2 - s1 * s1) / (n * n) if n else 0.0


def blur_score(gray: np.ndarray) -> float:
    return variance(*moments(laplacian(gray)))


def contrast_score(gray: np.ndarray) -> float:
    return variance(*moments(gray)) ** 0.5


def gauss5(gray: np.ndarray) -> np.ndarray:
    """5x5 binomial smoothing, rounded to the nearest integer."""
    p = pad101(gray.astype(np.int32), 2)
    h = p[:, :-4] + 4 * p[:, 1:-3] + 6 * p[:, 2:-2] + 4 * p[:, 3:-1] + p[:, 4:]
    v = h[:-4] + 4 * h[1:-3] + 6 * h[2:-2] + 4 * h[3:-1] + h[4:]
    return ((v + 128) >> 8).astype(np.uint8)


def noise_sum(gray: np.ndarray) -> int:
    return int(np.abs(gray.astype(np.int64) - gauss5(gray)).sum())


def noise_score(gray: np.ndarray) -> float:
    return noise_sum(gray) / (255.0 * gray.size) if gray.size else 0.0


def histogram(gray: np.ndarray, bins: int = 256) -> np.ndarray:
    h = np.bincount(gray.ravel().astype(np.int64) * bins // 256, minlength=bins).astype(np.float64)
    return h / h.sum() if h.sum() else h


def otsu(gray: np.ndarray) -> int:
    """Threshold that parts the values best (v <= t against v > t); the lowest of equals, 0 for one value.
    Scores are exact fractions of integers, compared as doubles."""
    n = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    return otsu_from_counts(n)


def otsu_from_counts(n: np.ndarray) -> int:
    v = np.arange(n.size)
    w0, s0 = np.cumsum(n), np.cumsum(n * v)
    total, whole = w0[-1], s0[-1]
    w1 = total - w0
    d = s0 * total - whole * w0
    score = np.where((w0 > 0) & (w1 > 0), d * d / np.where((w0 > 0) & (w1 > 0), w0 * w1, 1), -1.0)
    best = int(score.argmax())
    return best if score[best] > 0 else 0


def gaussian(img: np.ndarray, sigma: float, size: int | None = None) -> np.ndarray:
    """Separable Gaussian in float64, mirrored border."""
    r = (size or int(round(sigma * 8 + 1)) | 1) // 2
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    planes = [img] if img.ndim == 2 else [img[..., i] for i in range(img.shape[2])]
    out = []
    for p in planes:
        q = pad101(p.astype(np.float64), r)
        q = sliding_window_view(q, 2 * r + 1, axis=1) @ k
        out.append(sliding_window_view(q, 2 * r + 1, axis=0) @ k)
    return out[0] if img.ndim == 2 else np.stack(out, -1)


def adaptive_dark(gray: np.ndarray, size: int = 21, c: float = 10) -> np.ndarray:
    """True where the pixel is at least c darker than its Gaussian surroundings."""
    return gray <= np.floor(gaussian(gray, 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size) + 0.5) - c


def _running(mask: np.ndarray, k: int, axis: int, need: int, back: int) -> np.ndarray:
    """Whether at least ``need`` of the k pixels that begin ``back`` before the pixel are set."""
    pad = [(0, 0), (0, 0)]
    pad[axis] = (back + 1, k)
    c = np.cumsum(np.pad(mask, pad).astype(np.int32), axis=axis)
    n = mask.shape[axis]
    lo, hi = np.take(c, range(0, n), axis=axis), np.take(c, range(k, n + k), axis=axis)
    return hi - lo >= need


def dilate(mask: np.ndarray, kw: int, kh: int, times: int = 1) -> np.ndarray:
    """Maximum over a kw x kh rectangle anchored at its middle (size // 2)."""
    for _ in range(times):
        mask = _running(_running(mask, kw, 1, 1, kw - 1 - kw // 2), kh, 0, 1, kh - 1 - kh // 2)
    return mask


def erode(mask: np.ndarray, kw: int, kh: int, times: int = 1) -> np.ndarray:
    """Minimum over the rectangle; pixels beyond the border do not count against it."""
    for _ in range(times):
        mask = ~_running(_running(~mask, kw, 1, 1, kw // 2), kh, 0, 1, kh // 2)
    return mask


def opening(mask: np.ndarray, kw: int, kh: int) -> np.ndarray:
    return dilate(erode(mask, kw, kh), kw, kh)


def closing(mask: np.ndarray, kw: int, kh: int) -> np.ndarray:
    return erode(dilate(mask, kw, kh), kw, kh)


def boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Bounding boxes (x, y, width, height) of the 8-connected components, by y, then x. Runs of a row are joined to
    the runs they touch in the row above."""
    parent: list[int] = []
    box: list[list[int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    m = np.pad(mask.astype(np.int8), ((0, 0), (1, 1)))
    edge = np.diff(m, axis=1)
    for y in range(mask.shape[0]):
        starts, stops = np.flatnonzero(edge[y] == 1), np.flatnonzero(edge[y] == -1)
        row, j = [], 0
        for a, b in zip(starts.tolist(), stops.tolist()):
            i = len(parent)
            parent.append(i)
            box.append([a, y, b, y + 1])
            while j < len(above) and above[j][1] < a:
                j += 1
            k = j
            while k < len(above) and above[k][0] <= b:
                r, s = root(above[k][2]), root(i)
                if r != s:
                    r, s = min(r, s), max(r, s)
                    parent[s] = r
                    p, q = box[r], box[s]
                    box[r] = [min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])]
                k += 1
            row.append((a, b, i))
        above = row
    out = [(x0, y0, x1 - x0, y1 - y0) for i, (x0, y0, x1, y1) in enumerate(box) if parent[i] == i]
    return sorted(out, key=lambda r: (r[1], r[0], r[3], r[2]))


def edges(gray: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Thin edges: local maxima of the gradient along its direction, weak ones kept if joined to strong ones."""
    p = pad101(gray.astype(np.int32), 1)
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    mag = np.abs(gx) + np.abs(gy)
    q = np.pad(mag, 1)
    sector = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    thin = np.zeros(mag.shape, bool)
    for s, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        a = q[1 + dy : q.shape[0] - 1 + dy, 1 + dx : q.shape[1] - 1 + dx]
        b = q[1 - dy : q.shape[0] - 1 - dy, 1 - dx : q.shape[1] - 1 - dx]
        thin |= (sector == s) & (mag > b) & (mag >= a)
    strong, weak = thin & (mag > high), thin & (mag > low)
    while True:
        grown = weak & dilate(strong, 3, 3)
        if (grown == strong).all():
            return strong
        strong = grown


def skew_angle(gray: np.ndarray, votes: int = 100, top: int = 50) -> float:
    """Median tilt in degrees of the strongest straight lines within 45 degrees of the horizontal, 0.0 for none."""
    e = edges(np.where(gray <= otsu(gray), 255, 0).astype(np.uint8))
    y, x = np.nonzero(e)
    if not y.size:
        return 0.0
    theta = np.deg2rad(np.arange(180))
    reach = int(np.ceil(np.hypot(*gray.shape)))
    acc = np.stack([np.bincount(np.rint(x * np.cos(t) + y * np.sin(t)).astype(np.int64) + reach, minlength=2 * reach + 1) for t in theta])
    q = np.pad(acc, 1)
    peak = (acc > votes) & (acc > q[:-2, 1:-1]) & (acc >= q[2:, 1:-1]) & (acc > q[1:-1, :-2]) & (acc >= q[1:-1, 2:])
    t, r = np.nonzero(peak)
    order = np.lexsort((r, t, -acc[t, r]))[:top]
    angle = t[order] - 90.0
    angle = angle[np.abs(angle) < 45]
    return float(np.median(angle)) if angle.size else 0.0


def rotate(img: np.ndarray, degrees: float) -> np.ndarray:
    """Turn counter-clockwise about the middle, bilinear, white outside, same size."""
    h, w = img.shape[:2]
    cx, cy, a = w // 2, h // 2, np.deg2rad(degrees)
    yy, xx = np.mgrid[0:h, 0:w].astype(np.float64)
    dx, dy = xx - cx, yy - cy
    sx, sy = np.cos(a) * dx - np.sin(a) * dy + cx, np.sin(a) * dx + np.cos(a) * dy + cy
    src = np.pad(img.astype(np.float64), [(1, 1), (1, 1)] + [(0, 0)] * (img.ndim - 2), constant_values=255)
    sx, sy = np.clip(sx + 1, 0, w + 0.999), np.clip(sy + 1, 0, h + 0.999)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    if img.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    out = (src[y0, x0] * (1 - fx) + src[y0, x0 + 1] * fx) * (1 - fy) + (src[y0 + 1, x0] * (1 - fx) + src[y0 + 1, x0 + 1] * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def deskew(img: np.ndarray, angle: float, compat_sign: bool = False) -> np.ndarray:
    """Turn the page so that a tilt of ``angle`` becomes 0. compat_sign turns the other way."""
    return rotate(img, -angle if compat_sign else angle)


def denoise(img: np.ndarray, h: float = 10, patch: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: every pixel becomes the mean of the window's pixels, weighted by how alike their patches are."""
    if img.ndim == 3:
        return np.stack([denoise(img[..., i], h, patch, search) for i in range(img.shape[2])], -1)
    r, s = patch // 2, search // 2
    p = pad101(img.astype(np.float64), r + s)
    hh, ww = img.shape
    total, weight = np.zeros((hh, ww)), np.zeros((hh, ww))
    ref = p[s : s + hh + 2 * r, s : s + ww + 2 * r]
    for dy in range(search):
        for dx in range(search):
            d = (p[dy : dy + hh + 2 * r, dx : dx + ww + 2 * r] - ref) ** 2
            c = np.pad(d.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
            mean = (c[patch:, patch:] - c[:-patch, patch:] - c[patch:, :-patch] + c[:-patch, :-patch]) / patch**2
            wgt = np.exp(-np.maximum(mean, 0) / (h * h))
            total += wgt * p[dy + r : dy + r + hh, dx + r : dx + r + ww]
            weight += wgt
    return np.clip(np.rint(total / weight), 0, 255).astype(np.uint8)


def clahe(img: np.ndarray, clip: float = 2.0, tiles: tuple[int, int] = (8, 8)) -> np.ndarray:
    """Histogram equalisation by tile with clipped counts, blended between tiles; of colour pages the luminance."""
    if img.ndim == 3:
        y = to_gray(img).astype(np.float64)
        gain = clahe(to_gray(img), clip, tiles) - y
        return np.clip(np.rint(img + gain[..., None]), 0, 255).astype(np.uint8)
    h, w = img.shape
    ty, tx = min(tiles[1], h), min(tiles[0], w)
    ys, xs = np.linspace(0, h, ty + 1).astype(int), np.linspace(0, w, tx + 1).astype(int)
    lut = np.zeros((ty, tx, 256))
    for i in range(ty):
        for j in range(tx):
            t = img[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            n = np.bincount(t.ravel(), minlength=256).astype(np.float64)
            top = max(1.0, clip * t.size / 256)
            over = np.maximum(n - top, 0).sum()
            lut[i, j] = np.cumsum(np.minimum(n, top) + over / 256) * 255 / max(1, t.size)
    cy, cx = (ys[:-1] + ys[1:] - 1) / 2, (xs[:-1] + xs[1:] - 1) / 2
    fy, fx = np.interp(np.arange(h), cy, np.arange(ty)), np.interp(np.arange(w), cx, np.arange(tx))
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1 = np.minimum(y0 + 1, ty - 1), np.minimum(x0 + 1, tx - 1)
    a, b = (fy - y0)[:, None], (fx - x0)[None, :]
    g = lambda i, j: lut[i[:, None], j[None, :], img]
    out = (g(y0, x0) * (1 - b) + g(y0, x1) * b) * (1 - a) + (g(y1, x0) * (1 - b) + g(y1, x1) * b) * a
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def sharpen(img: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(1.5 * img - 0.5 * gaussian(img, 3.0)), 0, 255).astype(np.uint8)


def enhance_borders(img: np.ndarray, k: int = 3) -> np.ndarray:
    g = to_gray(img)
    return np.where(closing(g <= otsu(g), k, k), 0, 255).astype(np.uint8)


def reconstruct_table_borders(img: np.ndarray, length: int = 40, times: int = 2) -> np.ndarray:
    """Long horizontal and vertical strokes, thickened and drawn in black."""
    g = to_gray(img)
    dark = g <= otsu(g)
    lines = dilate(opening(dark, length, 1), 3, 3, times) | dilate(opening(dark, 1, length), 3, 3, times)
    out = img.copy()
    out[lines] = 0
    return out


def crop(img: np.ndarray, x: int, y: int, w: int, h: int, padding: int = 0) -> np.ndarray:
    x0, y0 = max(0, x - padding), max(0, y - padding)
    return img[y0 : max(y0, min(img.shape[0], y + h + padding)), x0 : max(x0, min(img.shape[1], x + w + padding))].copy()


COLOURS = {"header": (255, 128, 0), "footer": (128, 0, 255), "paragraph": (0, 160, 0), "table": (0, 0, 255), "cell": (0, 165, 255), "image": (255, 0, 255)}


def draw_regions(img: np.ndarray, regions: list[tuple[int, int, int, int, str]], thickness: int = 2) -> np.ndarray:
    out = to_bgr(img).copy()
    for x, y, w, h, kind in regions:
        c = COLOURS.get(kind, (128, 128, 128))
        out[y : y + thickness, x : x + w] = out[y + h - thickness : y + h, x : x + w] = c
        out[y : y + h, x : x + thickness] = out[y : y + h, x + w - thickness : x + w] = c
    return out


# ---- hashes


def shrink(gray: np.ndarray, w: int, h: int) -> np.ndarray:
    """Area average onto w x h."""

    def side(n: int, m: int) -> np.ndarray:
        edges_ = np.linspace(0, n, m + 1)
        at = np.arange(n)
        return np.clip(np.minimum(edges_[1:, None], at + 1) - np.maximum(edges_[:-1, None], at), 0, None) / (n / m)

    return side(gray.shape[0], h) @ gray.astype(np.float64) @ side(gray.shape[1], w).T


def to_hex(bits: np.ndarray) -> str:
    b = bits.ravel().astype(np.uint8)
    return f"{int(''.join(map(str, b)), 2):0{-(-b.size // 4)}x}"


def ahash(gray: np.ndarray, size: int = 16) -> str:
    s = shrink(gray, size, size)
    return to_hex(s > s.mean())


def dhash(gray: np.ndarray, size: int = 16) -> str:
    s = shrink(gray, size + 1, size)
    return to_hex(s[:, 1:] > s[:, :-1])


def phash(gray: np.ndarray, size: int = 16) -> str:
    n = size * 4
    s = shrink(gray, n, n)
    k = np.cos(np.pi * (2 * np.arange(n) + 1)[None, :] * np.arange(size)[:, None] / (2 * n))
    low = k @ s @ k.T
    return to_hex(low > np.median(low))


def all_hashes(gray: np.ndarray) -> tuple[str, str, str]:
    """phash, dhash and ahash of 64 bits, not comparable with those of size 16."""
    return phash(gray, 8), dhash(gray, 8), ahash(gray, 8)


def hash_distance(a: str, b: str) -> int:
    return (int(a, 16) ^ int(b, 16)).bit_count()


# ---- layout of one page


def count_rising(profile: np.ndarray, at_least: float) -> int:
    """Runs of values above the bound; a run that the profile begins with does not count."""
    on = (profile > at_least).astype(np.int8)
    return int((np.diff(on) == 1).sum())


def merge_nearby(places: list[int], gap: int = 5) -> list[int]:
    """One place (floor of the median) per run of places at most ``gap`` apart."""
    out: list[int] = []
    run: list[int] = []
    for p in sorted(places):
        if run and p - run[-1] > gap:
            out.append(int(np.median(run)))
            run = []
        run.append(p)
    return out + ([int(np.median(run))] if run else [])


def detect_tables(gray: np.ndarray, cfg) -> list[tuple[tuple[int, int, int, int], list[tuple[int, int, int, int]]]]:
    """Boxes of ruled tables with the boxes of their cells, clamped to the page."""
    h, w = gray.shape
    dark = adaptive_dark(gray)
    dark[:30], dark[-30:], dark[:, :30], dark[:, -30:] = False, False, False, False
    rows, cols = opening(dark, max(40, w // 60), 1), opening(dark, 1, max(40, h // 60))
    grid = dilate(dilate(rows, max(1, w // 6), 1) | dilate(cols, 1, 20), 20, 5)
    thick_rows, thick_cols = dilate(rows, 5, 5), dilate(cols, 5, 5)
    out = []
    for x, y, bw, bh in boxes(grid):
        cross = thick_rows[y : y + bh, x : x + bw] & thick_cols[y : y + bh, x : x + bw]
        yy, xx = np.nonzero(cross)
        if not yy.size:
            continue
        x0, y0 = max(0, x + int(xx.min()) - 5), max(0, y + int(yy.min()) - 5)
        x1, y1 = min(w, x + int(xx.max()) + 6), min(h, y + int(yy.max()) + 6)
        r, c = rows[y0:y1, x0:x1], cols[y0:y1, x0:x1]
        n_h = count_rising(r.sum(1), (x1 - x0) * cfg.h_line_span)
        n_v = count_rising(c.sum(0), (y1 - y0) * cfg.v_line_span)
        if n_h < cfg.table_min_lines and n_v < cfg.table_min_lines:
            continue
        seps_y = merge_nearby(np.flatnonzero(dilate(r, 1, 3).sum(1) > 0.2 * (x1 - x0)).tolist(), 20)
        seps_x = merge_nearby(np.flatnonzero(dilate(c, 3, 1).sum(0) > 0.1 * (y1 - y0)).tolist(), 20)
        ink = dark[y0:y1, x0 : x + bw]
        seps_x = column_edges(seps_x, x1 - x0, x + bw - x0, ink)
        out.append(((x0, y0, max(x1 - x0, seps_x[-1]), y1 - y0), cells(x0, y0, seps_x, seps_y, cfg.merged_column)))
    return out


def column_edges(seps: list[int], width: int, reach: int, ink: np.ndarray) -> list[int]:
    """Separators with those that an open table lacks: its left edge, its right edge, and the end of its rows at
    ``reach`` where what lies beyond the last one is printed on or wide."""
    seps = [0, *seps] if not seps or seps[0] > 20 else list(seps)
    if width > seps[-1] + 20:
        seps.append(width)
    if reach > seps[-1] + 30:
        beyond = ink[:, seps[-1] : reach]
        if (beyond.size and beyond.mean() > 0.06) or reach - seps[-1] > 150:
            seps.append(reach)
    return seps


def swap_channels(img: np.ndarray) -> np.ndarray:
    """RGB to BGR or back; gray stays."""
    return img if img.ndim == 2 else np.ascontiguousarray(img[..., ::-1])


def cells(x0: int, y0: int, xs: list[int], ys: list[int], merged_column: int | None = None) -> list[tuple[int, int, int, int]]:
    """Cells between neighbouring separators, 2 pixels inside, none smaller than 8; of merged_column all rows but
    the first are one cell, listed with the last row."""
    out = []
    for i, (ya, yb) in enumerate(zip(ys, ys[1:])):
        for j, (xa, xb) in enumerate(zip(xs, xs[1:])):
            a, b = ya, yb
            if merged_column is not None and j == merged_column and i >= 1:
                if i < len(ys) - 2:
                    continue
                a = ys[1]
            if xb - xa >= 8 and b - a >= 8:
                out.append((x0 + xa + 2, y0 + a + 2, max(1, xb - xa - 4), max(1, b - a - 4)))
    return out


def has_content(gray: np.ndarray, dark: int = 180, share: float = 0.002) -> bool:
    return bool(gray.size) and float((gray <= dark).mean()) > share


def block_ok(x: int, y: int, w: int, h: int, page_w: int, page_h: int, min_area: int = 2000, min_dim: int = 20) -> bool:
    """Whether a text block is neither dust, nor the whole page, nor a streak at the page's edge."""
    if w * h < min_area or w < min_dim or h < min_dim or (w > 0.9 * page_w and h > 0.9 * page_h) or w * h > 0.85 * page_w * page_h:
        return False
    side = (x < 20 or x + w > page_w - 20) and w < 60 and h > 0.2 * page_h
    return not side and not ((y < 20 or y + h > page_h - 20) and h < 60 and w > 0.2 * page_w)


def classify_block(x: int, y: int, w: int, h: int, page_w: int, page_h: int, density: float) -> str:
    aspect = w / h if h > 0 else 0.0
    if 0.4 < aspect < 2.5 and density < 0.03:
        return "image"
    if y < 0.15 * page_h and abs(x + w / 2 - page_w / 2) < 0.1 * page_w and h > 20:
        return "title"
    return "paragraph"


def detect_page(img: np.ndarray, cfg) -> list[tuple[str, tuple[int, int, int, int], int]]:
    """Regions of a page: (type, box, number of the parent in the list or -1), tables first, then header, footer and
    text blocks outside all of them."""
    gray = to_gray(img)
    h, w = gray.shape
    out: list[tuple[str, tuple[int, int, int, int], int]] = []
    mask = np.zeros(gray.shape, bool)
    tables = detect_tables(gray, cfg)
    for box, inner in tables:
        at = len(out)
        out.append(("table", box, -1))
        out += [("cell", c, at) for c in inner]
        x, y, bw, bh = box
        mask[y : y + bh, x : x + bw] = True
    top = min((b[1] for b, _ in tables), default=int(h * cfg.header_ratio))
    low = max((b[1] + b[3] for b, _ in tables), default=int(h * (1 - cfg.footer_ratio)))
    if top >= 20 and has_content(gray[:top]):
        out.append(("header", (0, 0, w, top), -1))
        mask[:top] = True
    if low < h - 20 and has_content(gray[low:]):
        out.append(("footer", (0, low, w, h - low), -1))
        mask[low:] = True
    dark = (gray <= otsu(gray)) & ~mask
    for x, y, bw, bh in boxes(dilate(dilate(dark, 20, 3), 5, 15)):
        part = mask[y : y + bh, x : x + bw]
        if not block_ok(x, y, bw, bh, w, h, cfg.min_region_area, cfg.min_region_dim) or part.mean() > 0.5:
            continue
        roi = gray[y : y + bh, x : x + bw]
        out.append((classify_block(x, y, bw, bh, w, h, float((roi <= otsu(roi)).mean())), (x, y, bw, bh), -1))
    return out
