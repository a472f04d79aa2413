"""The edge-preserving filter by brute force, blend flags by hand, boxes and image files there and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import compose, edges
from tessera.sources import container, netpbm


def mirrored(i, n):
    i = -i - 1 if i < 0 else i
    i = 2 * n - 1 - i if i >= n else i
    return min(max(i, 0), n - 1)


def slow_pass(planes, stage, sigma):
    _, h, w = planes.shape
    at = lambda c, y, x: planes[c, mirrored(y, h), mirrored(x, w)]
    out = planes.copy()
    for y in range(h):
        for x in range(w):
            s = sigma[y // 8][x // 8]
            if s < -3.90524291751269967:
                continue
            near_edge = x % 8 in (0, 7) or y % 8 in (0, 7)
            slope = s * 1.65 * {0: 0.9, 1: 1.0, 2: 6.5}[stage] * (2 / 3 if near_edge else 1)
            total, weight = planes[:, y, x].copy(), 1.0
            for dy in (-2, -1, 0, 1, 2):
                for dx in (-2, -1, 0, 1, 2):
                    if not 0 < abs(dy) + abs(dx) <= (2 if stage == 0 else 1):
                        continue
                    taps = [(0, 0)] if stage == 2 else [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]
                    apart = sum(k * abs(at(c, y + a, x + b) - at(c, y + dy + a, x + dx + b)) for c, k in enumerate((40.0, 5.0, 3.5)) for a, b in taps)
                    weighed = max(0.0, 1 + apart * slope)
                    total = total + weighed * np.array([at(c, y + dy, x + dx) for c in range(3)])
                    weight += weighed
            out[:, y, x] = total / weight
    return out


@pytest.mark.parametrize("stage", [0, 1, 2])
def test_edge_passes_match_brute_force(spark, stage):
    rng = np.random.default_rng(stage)
    given = {1: rng.random((3, 11, 10)) / 90, 2: rng.random((3, 2, 9)) / 90}
    sigma = {1: [[-0.9, -4.2], [-1.5, -0.3]], 2: [[-1.1, -0.7]]}
    rows = [(img, c, y, [float(v) for v in planes[c, y]], sigma[img][y // 8]) for img, planes in given.items() for c in range(3) for y in range(planes.shape[1])]
    frame = spark.createDataFrame(rows, "img int, c int, y int, row array<double>, s array<double>")
    got = {(r.img, r.c, r.y): r.row for r in edges.edge_pass(frame, stage, F.col("s")).collect()}
    for img, planes in given.items():
        want = slow_pass(planes, stage, sigma[img])
        for c in range(3):
            for y in range(planes.shape[1]):
                assert np.allclose(got[img, c, y], want[c, y], atol=1e-12)


def test_restoring_flat_planes_changes_nothing(spark):
    rows = [(0, c, y, [3.0] * 9) for c in range(3) for y in range(9)]
    got = edges.restore(spark.createDataFrame(rows, "img int, c int, y int, row array<double>"), 3).collect()
    assert len(got) == 27 and all(r.row == [3.0] * 9 for r in got)


@pytest.mark.parametrize(
    ("mode", "clamp", "premultiplied", "colour"),
    [("replace", False, False, 0.8), ("add", False, False, 1.2), ("blend", False, True, 0.8 + 0.4 * (1 - 1.5)), ("blend", True, True, 0.8), ("blend", True, False, 0.8), ("weighted_add", False, False, 0.4 + 0.8 * 1.5), ("weighted_add", True, False, 1.2), ("mul", False, False, 0.32)],
)
def test_blends_by_hand(spark, mode, clamp, premultiplied, colour):
    """Below 0.4 with alpha 0.5, above 0.8 with alpha 1.5."""
    row = spark.sql("select 0.4d as b, 0.5d as ba, 0.8d as f, 1.5d as fa")
    assert row.select(F.expr(compose.blending(mode, clamp, premultiplied)[0])).first()[0] == pytest.approx(colour)


def test_stored_brotli_and_boxes(spark):
    for n in (0, 1, 70_000, 1 << 16, 131_073):
        data = bytes(k * 7 % 251 for k in range(n))
        assert container.brotli_unstored(container.brotli_stored(data)) == data
    assert container.brotli_stored(b"") == b"\x06" and container.brotli_stored(b"ab")[-3:] == b"ab\x03"
    with pytest.raises(ValueError):
        container.brotli_unstored(b"\x0b\x00\x80")
    boxes = spark.createDataFrame(
        [("f", 0, "jxlc", b"c"), ("f", 1, "brob", b"xml " + container.brotli_stored(b"<x/>")), ("g", 0, "Exif", b"\0\0\0\x02abII*")], "path string, ord int, type string, payload binary"
    )
    assert [(r.path, r.xmp) for r in container.xmp(boxes).collect()] == [("f", "<x/>")]
    assert [bytes(r.tiff) for r in container.exif(boxes).collect()] == [b"II*"]
    assert container.exif_box(b"II*")[8:] == b"\0\0\0\0II*" and container.brob_box(b"xml ", b"q")[4:12] == b"brobxml "


def test_image_files_there_and_back(spark, tmp_path):
    netpbm.register(spark)
    rng = np.random.default_rng(4)
    rows = []
    for name, channels, top in (("a.pgm", 1, 255), ("b.ppm", 3, 1023), ("c.pam", 4, 255), ("d.pfm", 1, 0)):
        v = rng.integers(0, (top or 8) + 1, (channels, 5, 7))
        rows += [(name, c, y, top, [float(x) for x in v[c, y]]) for c in range(channels) for y in range(5)]
    made = netpbm.images(spark.createDataFrame(rows, netpbm.ROWS).repartition(3))
    made.write.format("netpbm").option("path", str(tmp_path)).mode("append").save()
    want = sorted((p, c, y, r) for p, c, y, _, r in rows)
    for read in (netpbm.rows_of_files(spark, str(tmp_path)), spark.read.format("netpbm").option("path", str(tmp_path)).load()):
        got = sorted((r.path.rsplit("/", 1)[-1], r.c, r.y, [float(v) for v in r.row]) for r in read.collect())
        assert got == want
