"""Several marks of different quality on one page."""

import numpy as np

from veilwork.operators.pixels import find_template, ladder


def test_all_marks():
    # a smooth mark: places beside the best one score more than weaker marks
    rng = np.random.default_rng(1)
    yy, xx = np.mgrid[0:48, 0:60]
    mark = np.sin(xx / 60 * np.pi * 2) * np.cos(yy / 48 * np.pi * 2) * 80 + xx * 0.8 + 60
    page = np.full((300, 340), 120.0) + rng.normal(0, 2, (300, 340))
    places = [(20, 20, 0), (150, 30, 15), (40, 110, 20), (230, 120, 25), (30, 220, 28), (180, 220, 30)]
    for x, y, noise in places:
        page[y : y + 48, x : x + 60] = mark + rng.normal(0, noise, mark.shape)
    hits = find_template(page, mark, ladder(0.7, 1.6))
    for x, y, _ in places:
        assert any(abs(h["x"] - x) <= 3 and abs(h["y"] - y) <= 3 for h in hits), (x, y)
