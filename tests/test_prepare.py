import numpy as np
import pytest

from veilwork.operators import prepare as pre


def test_pyramid_and_size():
    a = np.random.default_rng(0).random((300, 520)) * 255
    assert [p.shape for p in pre.pyramid(a)] == [(300, 520), (150, 260), (75, 130), (38, 65)]
    small, scale = pre.work_size(np.zeros((3600, 100)))
    assert small.shape == (1800, 50) and scale == 0.5


def test_enhance_keeps_flat_and_stretches():
    flat = np.full((100, 130), 90.0)
    assert np.allclose(pre.enhance(flat), flat)
    a = np.tile(np.r_[np.full(32, 80.0), np.full(32, 120.0)], (64, 2))
    assert pre.enhance(a)[0, 0] == pytest.approx(100 - 20 * 1.35)
    noise = np.random.default_rng(1).random((400, 400)) * 255
    assert pre.busy(noise) > pre.BUSY and pre.enhance(noise).std() < noise.std()


@pytest.mark.parametrize("angle", [-2.0, 0.0, 1.5])
def test_deskew(angle):
    page = np.full((240, 400), 255.0)
    page[20:220:20, 20:380] = 0
    page[21:221:20, 20:380] = 0
    turned = pre.rotate(page, -angle)
    assert abs(abs(pre.skew_angle(turned)) - abs(angle)) <= 0.5
    assert abs(pre.skew_angle(pre.deskew(turned))) <= 0.5


def test_dark_bands():
    page = np.full((600, 800), 250.0)
    page[96:144, 96:480] = 30
    page[106:134:4, 100:476] = 200
    got = pre.dark_bands(page)
    assert len(got) == 1
    x, y, w, h = got[0]
    assert x <= 96 and y <= 96 and x + w >= 480 and y + h >= 144


def test_ink_check():
    rng = np.random.default_rng(2)
    mark = np.full((50, 60, 3), 240, np.uint8)
    mark[10:40, 10:50] = rng.integers(0, 120, (30, 40, 3))
    picked = pre.ink(mark)
    page = np.full((200, 260, 3), 20, np.uint8)
    page[70:100, 90:130] = mark[10:40, 10:50]
    hit = {"x": 81, "y": 59, "w": 60, "h": 50}
    assert pre.ink_score(page, picked, (50, 60), hit) > 0.95
    assert pre.ink_score(page, picked, (50, 60), {"x": 20, "y": 120, "w": 60, "h": 50}) < 0.5
    assert pre.ink(np.full((50, 60, 3), 240, np.uint8)) is None
    assert pre.ink_confirms(0.95, hit, 0.6, 0.75) and not pre.ink_confirms(0.95, hit, 0.8, 0.75)


def test_pages_and_phrases(spark):
    page = np.full((60, 80), 255.0)
    df = spark.createDataFrame([(1, 80, 60, bytearray(page.tobytes()))], "page long, w int, h int, px binary")
    assert pre.prepare_pages(df).first()["bands"] == 0
    hits = [(1, 0, 1, 0.0, 0.0, 50.0, 10.0, 0.9), (1, 1, 2, 60.0, 0.0, 50.0, 10.0, 0.8), (1, 1, 3, 0.0, 12.0, 50.0, 10.0, 0.95), (1, 0, 4, 0.0, 100.0, 50.0, 10.0, 0.9), (2, 0, 5, 0.0, 0.0, 50.0, 10.0, 0.9), (2, 1, 6, 0.0, 12.0, 50.0, 10.0, 0.7)]
    got = pre.chain_phrases(spark.createDataFrame(hits, "page long, part int, seq long, x double, y double, w double, h double, score double"), "page", 2)
    assert sorted(map(tuple, got.collect())) == [(1, 0.0, 0.0, 110.0, 10.0, 0.8), (2, 0.0, 0.0, 50.0, 22.0, 0.7)]
