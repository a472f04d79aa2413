"""JPEG files: coefficients there and back, and the same bytes again."""

import numpy as np
import pytest

from tessera.functions import jpeg
from tessera.sources import jpeg as source


def made(rng, width, height, sampling, restart=0):
    parts = [jpeg.Component(k + 1, a, b, 0) for k, (a, b) in enumerate(sampling)]
    list(jpeg._walk(jpeg.Jpeg(height, width, components=parts)))  # shapes the blocks
    for c in parts:
        c.blocks[:] = np.where(rng.random(c.blocks.shape) < 0.1, rng.integers(-300, 300, c.blocks.shape), 0)
        c.blocks[:, :, 0] = rng.integers(-900, 900, c.blocks.shape[:2])
    return jpeg.build(width, height, parts, {0: [1 + k for k in range(64)]}, restart)


def test_scan_order():
    assert jpeg.ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG[-3:] == [55, 62, 63] and sorted(jpeg.ZIGZAG) == list(range(64))


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("restart", [0, 3])
def test_files_there_and_back(sampling, restart):
    rng = np.random.default_rng(len(sampling) + restart)
    for _ in range(4):
        width, height = int(rng.integers(1, 60)), int(rng.integers(1, 50))
        given = made(rng, width, height, sampling, restart)
        raw = jpeg.write(given)
        read = jpeg.parse(raw)
        assert (read.width, read.height, read.restart) == (width, height, restart)
        assert all((a.blocks == b.blocks).all() for a, b in zip(read.components, given.components, strict=True))
        assert jpeg.write(read) == raw


def test_damaged_files_are_refused():
    raw = jpeg.write(made(np.random.default_rng(1), 20, 20, [(1, 1)]))
    for bad in (b"", b"\xff\xd8", raw[: len(raw) // 2], b"\xff\xd8\xff\xc2\0\x0b\x08\0\x08\0\x08\x01\x01\x11\0"):
        with pytest.raises((ValueError, IndexError)):
            jpeg.parse(bad)


def test_segments_and_profiles(spark):
    given = made(np.random.default_rng(2), 16, 8, [(1, 1)])
    profile = bytes(range(200))
    parts = [(0xE2, b"ICC_PROFILE\0" + bytes([k + 1, 2]) + profile[100 * k : 100 * k + 100]) for k in (1, 0)]
    given.segments[1:1] = [(0xE1, b"Exif\0\0II*\0"), (0xE1, b"http://ns.adobe.com/xap/1.0/\0<x/>"), (0xFE, b"made by hand"), *parts]
    raw = jpeg.write(given)
    files = spark.createDataFrame([(1, raw)], "file long, data binary")
    found = source.segments(files)
    assert [r.kind for r in found.orderBy("no").collect()][:6] == ["jfif", "exif", "xmp", "comment", "icc", "icc"]
    assert bytes(source.profiles(found).first().profile) == profile
    assert source.profiles(found.where("no <> 4")).first().profile is None
    assert source.rewritten(files).first().same
    assert source.coefficients(files).count() == 2
