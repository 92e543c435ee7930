"""Preparation of page pictures, the colour check of hits, and phrases of
picture hits: NumPy kernels that run once per page inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from veilwork.operators.pixels import resize

#: Longest side that pages are worked on at; levels of a pyramid and the side
#: under which none is added.
WORK_SIDE, LEVELS, LEAST_SIDE = 1800, 4, 64
#: Share of edges from which a page counts as a photo of a screen.
BUSY = 0.35
#: Distance of ink from its ground over the three channels, pixels it needs,
#: pixels that are compared, and the bars of the check.
INK_DISTANCE, INK_LEAST, INK_SAMPLE, INK_GATE, INK_BAR, INK_SIDE = 90, 30, 700, 0.5, 0.93, 40


def work_size(a: np.ndarray, side: int = WORK_SIDE) -> tuple[np.ndarray, float]:
    scale = min(1.0, side / max(a.shape))
    if scale == 1.0:
        return a, 1.0
    return resize(a, max(1, round(a.shape[1] * scale)), max(1, round(a.shape[0] * scale))), scale


def pyramid(a: np.ndarray) -> list[np.ndarray]:
    """The plane and its halves."""
    out = [a]
    while len(out) < LEVELS and max(out[-1].shape) > LEAST_SIDE:
        h, w = out[-1].shape
        out.append(resize(out[-1], max(1, round(w / 2)), max(1, round(h / 2))))
    return out


def busy(a: np.ndarray) -> float:
    """Share of a grid's places with an edge to the right and below."""
    step = max(2, min(a.shape) // 200)
    grid = a[::step, ::step]
    if min(grid.shape) < 2:
        return 0.0
    core = grid[:-1, :-1]
    return float((np.abs(core - grid[:-1, 1:]) + np.abs(core - grid[1:, :-1]) > 40).mean())


def enhance(a: np.ndarray, cell: int = 64, gain: float = 1.35) -> np.ndarray:
    """Busy pages blurred by three taps; then contrast around each cell's mean."""
    out = a.astype(float)
    if busy(a) > BUSY:
        for axis in (1, 0):
            p = np.pad(out, [(1, 1) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
            n = out.shape[axis]
            out = 0.25 * (np.take(p, range(n), axis) + 2 * out + np.take(p, range(2, n + 2), axis))
    ys, xs = (np.arange(n) // cell for n in out.shape)
    label = ys[:, None] * (xs[-1] + 1) + xs[None, :]
    mean = np.bincount(label.ravel(), out.ravel()) / np.bincount(label.ravel())
    local = mean[label]
    return np.clip(local + (out - local) * gain, 0, 255)


def rotate(a: np.ndarray, degrees: float) -> np.ndarray:
    """About the middle, nearest pixel, white around."""
    if not degrees:
        return a
    h, w = a.shape
    y, x = np.mgrid[0:h, 0:w]
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    dx, dy = x - w / 2, y - h / 2
    sx, sy = np.rint(w / 2 + dx * c + dy * s).astype(int), np.rint(h / 2 - dx * s + dy * c).astype(int)
    inside = (sx >= 0) & (sy >= 0) & (sx < w) & (sy < h)
    out = np.full(a.shape, 255.0)
    out[inside] = a[sy[inside], sx[inside]]
    return out


def skew_angle(a: np.ndarray, dark: float = 128, most: float = 3.0, step: float = 0.5) -> float:
    """Angle in degrees whose row profile of dark pixels varies most; the
    first among equals."""
    y, x = np.nonzero(a < dark)
    best, angle = -1.0, 0.0
    for d in np.arange(-most, most + step / 2, step):
        row = np.rint(y - x * np.tan(np.radians(d))).astype(int)
        power = float((np.bincount(row - row.min()).astype(float) ** 2).sum()) if len(row) else 0.0
        if power > best + 1e-9:
            best, angle = power, float(d)
    return angle


def deskew(a: np.ndarray) -> np.ndarray:
    return rotate(a, -skew_angle(a))


def dark_bands(a: np.ndarray, cell: int = 24, most: int = 6, share: float = 0.06, pad: int = 8) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of light lettering on dark, wide bands; the largest."""
    h, w = a.shape
    rows, cols = -(-h // cell), -(-w // cell)
    hit = np.zeros((rows, cols), bool)
    for r in range(rows):
        for c in range(cols):
            v = a[r * cell : (r + 1) * cell, c * cell : (c + 1) * cell]
            dark, light, paper = (v < 90), (v >= 160) & (v <= 235), (v > 240)
            sign = np.where(dark, -1, np.where(v > 160, 1, 0))
            flips = 0
            for line in sign:
                s = line[line != 0]
                flips += int((s[1:] != s[:-1]).sum())
            glyphs = light.mean() + (paper.mean() if dark.mean() >= 0.3 and flips >= 2 * len(v) else 0)
            hit[r, c] = v.mean() < 115 and 0.05 <= glyphs <= 0.5 and dark.mean() >= 0.3 and paper.mean() < 0.35
    label = np.arange(rows * cols).reshape(rows, cols)
    while True:
        p = np.pad(np.where(hit, label, rows * cols), 1, constant_values=rows * cols)
        low = np.min([p[1 + i : 1 + i + rows, 1 + j : 1 + j + cols] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        new = np.where(hit, low, label)
        if np.array_equal(new, label):
            break
        label = new
    out = []
    for k in np.unique(label[hit]):
        r, c = np.nonzero(hit & (label == k))
        x, y = max(0, c.min() * cell - pad), max(0, r.min() * cell - pad)
        bw, bh = min(w, (c.max() + 1) * cell + pad) - x, min(h, (r.max() + 1) * cell + pad) - y
        if bw >= 72 and 14 <= bh <= 80 and bw >= 2.2 * bh and 72 * 16 <= bw * bh <= share * w * h:
            out.append((int(x), int(y), int(bw), int(bh)))
    return sorted(out, key=lambda b: (-b[2] * b[3], b[1], b[0]))[:most]


def ink(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(places (y, x), colours) of the inner ink of a picked picture: pixels
    that with their four neighbours are far from the commonest colour of its
    edge. None for too few."""
    edge = np.concatenate([rgb[0], rgb[-1], rgb[:, 0], rgb[:, -1]]).astype(int) >> 4
    keys = edge[:, 0] * 256 + edge[:, 1] * 16 + edge[:, 2]
    names, first, n = np.unique(keys, return_index=True, return_counts=True)
    top = names[np.lexsort((first, -n))[0]]
    ground = np.array([top >> 8, top >> 4 & 15, top & 15]) * 16 + 8
    far = np.abs(rgb.astype(int) - ground).sum(axis=2) > INK_DISTANCE
    inner = np.zeros_like(far)
    inner[1:-1, 1:-1] = far[1:-1, 1:-1] & far[:-2, 1:-1] & far[2:, 1:-1] & far[1:-1, :-2] & far[1:-1, 2:]
    y, x = np.nonzero(inner)
    if len(y) < INK_LEAST:
        return None
    step = max(1, len(y) // INK_SAMPLE)
    at = np.stack([y[::step], x[::step]], axis=1)
    return at, rgb[at[:, 0], at[:, 1]].astype(float)


def ink_score(page: np.ndarray, picked: tuple[np.ndarray, np.ndarray], size: tuple[int, int], hit: dict) -> float:
    """Best correlation of the ink's colours around a hit, at its scale and 3 % off."""
    at, colours = picked
    t = colours - colours.mean()
    norm = float(np.sqrt((t * t).sum()))
    if not norm:
        return 0.0
    base, best = hit["w"] / size[1], 0.0
    reach = max(2, round(min(hit["w"], hit["h"]) * 0.06))
    for scale in (base * 0.97, base, base * 1.03):
        places = at * scale
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                y, x = np.rint(hit["y"] + dy + places[:, 0]).astype(int), np.rint(hit["x"] + dx + places[:, 1]).astype(int)
                if y.min() < 0 or x.min() < 0 or y.max() >= page.shape[0] or x.max() >= page.shape[1]:
                    continue
                v = page[y, x].astype(float)
                v = v - v.mean()
                var = float((v * v).sum())
                if var > 1:
                    best = max(best, float((v * t).sum()) / (np.sqrt(var) * norm))
    return best


def ink_confirms(score: float, hit: dict, grey_score: float, bar: float) -> bool:
    """A hit under its bar is kept if it is large and its colours fit."""
    return INK_GATE <= grey_score < bar and min(hit["w"], hit["h"]) >= INK_SIDE and score >= max(INK_BAR, bar)


def prepare_pages(pages: DataFrame, key: str = "page") -> DataFrame:
    """(key, scale, angle, busy, bands): measures of each page (key, w, h, px:
    bytes of doubles), taken on its working size."""
    kind = dict(pages.dtypes)[key]

    def run(batches):
        for pdf in batches:
            rows = []
            for k, w, h, px in zip(pdf[key], pdf["w"], pdf["h"], pdf["px"]):
                a, scale = work_size(np.frombuffer(px, np.float64).reshape(int(h), int(w)))
                rows.append((k, scale, skew_angle(a), busy(a), len(dark_bands(a))))
            yield pd.DataFrame(rows, columns=[key, "scale", "angle", "busy", "bands"])

    return pages.select(key, "w", "h", "px").mapInPandas(run, f"{key} {kind}, scale double, angle double, busy double, bands long")


def chain_phrases(hits: DataFrame, page: str, parts: int) -> DataFrame:
    """(page, x, y, w, h, score): phrases of `parts` picture hits (page, part,
    seq, x, y, w, h, score) in order: the next part is the nearest one beside
    the last on its line, or if there is none under it; a hit is used once."""

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pools = [pdf[pdf["part"] == k].sort_values("seq").to_dict("records") for k in range(parts)]
        out = []
        for first in pools[0]:
            row = [first]
            for pool in pools[1:]:
                a, best = row[-1], None
                for stacked in (False, True):
                    for b in pool:
                        h, w = max(a["h"], b["h"]), max(a["w"], b["w"])
                        if stacked:
                            gap = b["y"] - a["y"] - a["h"]
                            shift = min(abs(b["x"] - a["x"]), abs(b["x"] + b["w"] / 2 - a["x"] - a["w"] / 2))
                            fits = -0.35 * h <= gap <= 1.2 * h and shift <= 0.45 * w
                        else:
                            gap = b["x"] - a["x"] - a["w"]
                            fits = -0.25 * w <= gap <= 2.2 * w and abs(a["y"] + a["h"] / 2 - b["y"] - b["h"] / 2) <= 0.8 * h
                        if fits and (best is None or gap < best[0]):
                            best = (gap, b)
                    if best:
                        break
                if best is None:
                    break
                row.append(best[1])
                pool.remove(best[1])
            if len(row) == parts:
                x, y = min(r["x"] for r in row), min(r["y"] for r in row)
                out.append((first[page], x, y, max(r["x"] + r["w"] for r in row) - x, max(r["y"] + r["h"] for r in row) - y, min(r["score"] for r in row)))
        return pd.DataFrame(out, columns=[page, "x", "y", "w", "h", "score"])

    kind = dict(hits.dtypes)[page]
    return hits.groupBy(page).applyInPandas(chain, f"{page} {kind}, x double, y double, w double, h double, score double")
