"""Operators with several images in one table give each image what it gets alone."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import compose, lossless, rate, statistics

PLAIN_PATCHES = "img int, n int, sx0 int, sy0 int, w int, h int, x int, y int"


def _pixels(spark, img, h=6, w=5):
    rows = [(img, y, x, (y * 7 + x * 3 + img * 5) % 9, (y + x * img) % 7, (y * x + img) % 5) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "img int, y long, x long, c0 int, c1 int, c2 int")


def _both(spark):
    return _pixels(spark, 1).unionByName(_pixels(spark, 2, 7, 4))


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _composite(px):
    unit = px.selectExpr("img", "y", "x", "c0 / 9d as b", "c1 / 9d as ba"), px.selectExpr("img", "y", "x", "c2 / 9d as f", "c1 / 9d as fa")
    return compose.composite(*unit, "blend", 1, 2)


def _blit(px):
    patches = px.sparkSession.createDataFrame([(1, 0, 0, 0, 3, 2, 1, 1), (1, 1, 1, 1, 2, 2, 2, 1), (2, 0, 0, 1, 2, 2, 0, 0)], PLAIN_PATCHES)
    return compose.blit(px.selectExpr("img", "y", "x", "c0 as b"), px.selectExpr("img", "y as sy", "x as sx", "c1 as f"), patches)


def _nonzeros(px):
    return rate.expected_nonzeros(px.selectExpr("img", "c2 as c", "y as brow", "x as bcol", "c0 as nz").dropDuplicates(["img", "c", "brow", "bcol"]))


EACH = {
    "composite": _composite,
    "blit": _blit,
    "spot": lambda px: compose.spot(px.selectExpr("img", "y", "x", "c0 / 9d as v"), px.selectExpr("img", "y", "x", "c1 / 9d as s"), 0.25, 0.8),
    "orient": lambda px: compose.orient(px.selectExpr("img", "y", "x", "c0 as v"), 6, 5, 6),
    "distortion": lambda px: statistics.distortion(px.selectExpr("img", "y", "x", "c0 as v"), px.selectExpr("img", "y", "x", "c1 as v")),
    "colour_search": lambda px: lossless.colour_search(px, [0, 6, 13]),
    "palette": lambda px: lossless.palette(px, ["c0", "c1"]),
    "nonzeros": _nonzeros,
}


@pytest.mark.parametrize("name", sorted(EACH))
def test_images_dont_mix(spark, name):
    both, alone = EACH[name](_both(spark)), [EACH[name](_both(spark).where(F.col("img") == k)) for k in (1, 2)]
    assert _rows(both) == sorted(_rows(alone[0]) + _rows(alone[1]), key=repr)


def test_images_with_too_many_colours_have_no_palette(spark):
    got = lossless.palette(_both(spark).where("img = 1 or c0 < 2"), ["c0"], most=2)
    assert {r.img for r in got.collect()} == {2} and sorted(r.idx for r in got.collect()) == [0, 1]


def test_blit_draws_the_last_patch_that_has_a_source(spark):
    canvas = spark.createDataFrame([(1, y, x, 0) for y in range(3) for x in range(3)], "img int, y long, x long, b int")
    source = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 1, 6)], "img int, sy long, sx long, f int")
    patches = spark.createDataFrame([(1, 0, 0, 0, 2, 1, 0, 0), (1, 1, 1, 0, 2, 1, 0, 0)], PLAIN_PATCHES)
    got = {(r.y, r.x): r.v for r in compose.blit(canvas, source, patches).collect()}
    assert got[0, 0] == 6 and got[0, 1] == 6 and sum(got.values()) == 12
