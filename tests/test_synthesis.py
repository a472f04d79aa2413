"""Matrices against published ones, approximations against the functions, noise, kernels, trees and reports by hand."""

import math

import numpy as np
import pytest

from tessera.functions import matrices
from tessera.functions.dialect import PLAIN
from tessera.operators import lossless, statistics, synthesis, trees


def test_published_matrices():
    srgb = matrices.rgb_to_xyz(matrices.PRIMARIES[1], matrices.WHITES[1])
    assert np.allclose(srgb, [[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]], atol=3e-4)
    to_d50 = matrices.adaptation(matrices.WHITES[1], (0.34567, 0.35850))
    assert np.allclose(to_d50, [[1.0478, 0.0229, -0.0501], [0.0295, 0.9905, -0.0171], [-0.0092, 0.0150, 0.7521]], atol=4e-4)
    wide = matrices.between((matrices.PRIMARIES[1], matrices.WHITES[1]), (matrices.PRIMARIES[9], matrices.WHITES[1]))
    assert np.allclose(wide, [[0.6274, 0.3293, 0.0433], [0.0691, 0.9195, 0.0114], [0.0164, 0.0880, 0.8956]], atol=4e-4)
    assert np.allclose(np.array(wide).sum(1), 1)


def test_approximations():
    x = np.linspace(0.001, 40, 5000, dtype=np.float32)
    assert np.abs(matrices.fast_log2(x) - np.log2(x)).max() < 3e-6
    assert np.abs(matrices.fast_pow2(x / 4) / np.exp2(x / 4) - 1).max() < 1e-6
    assert np.abs(matrices.fast_pow(x, 0.45) / x**0.45 - 1).max() < 1e-4
    unit = np.linspace(-1, 1, 2001, dtype=np.float32)
    exact = np.sign(unit) * np.where(np.abs(unit) <= 0.0031308, 12.92 * np.abs(unit), 1.055 * np.abs(unit) ** (1 / 2.4) - 0.055)
    assert np.abs(matrices.fast_srgb(unit) - exact).max() < 2e-6
    assert np.abs(matrices.fast_cos(unit * 30) - np.cos(unit * 30)).max() < 2e-4
    assert np.abs(matrices.fast_erf(unit * 3) - [math.erf(float(v) * 3) for v in unit]).max() < 1e-3
    assert matrices.fast_709(np.float32([0.01]))[0] == pytest.approx(0.045)


def test_noise_generator_by_hand():
    mask = (1 << 64) - 1

    def split(z):
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & mask
        return z ^ (z >> 31)

    golden = 0x9E3779B97F4A7C15
    a, b = split((3 << 32) + 1 + golden & mask), split((64 << 32) + 128 + golden & mask)
    first = matrices.Noise(3, 1, 64, 128).batch()
    assert int(first[0]) == (a + b & mask) & 0xFFFFFFFF and int(first[1]) == (a + b & mask) >> 32
    tile = matrices.Noise(3, 1, 64, 128).tile(3, 32)
    assert tile.shape == (3, 32) and (tile >= 1).all() and (tile < 2).all()
    other = matrices.Noise(3, 1, 64, 128)
    assert (tile[1] == other.tile(2, 17)[1][0]).sum() <= 1  # a row of 17 takes two batches, as one of 32 does


def test_kernels_mirror_and_keep_flat_planes():
    bank = synthesis.kernels(synthesis.DOUBLE, 2)
    assert np.allclose(bank.sum((2, 3)), 1, atol=1e-6)
    assert (bank[0, 0] == bank[0, 0].T).all() and (bank[1, 0] == bank[0, 0][::-1]).all() and (bank[0, 1] == bank[0, 0][:, ::-1]).all()
    weights = tuple(np.random.default_rng(1).random(55))
    four = synthesis.kernels(weights, 4)
    assert four[0, 1, 0, 0] == weights[5] and (four[2, 3] == four[1, 0][::-1, ::-1]).all()


def test_upsampling_of_a_single_row(spark):
    rows = spark.createDataFrame([(0, 0, 0, [5, 5, 5]), (1, 0, 0, [1])], "img int, c int, y int, row array<int>")
    got = {(r.img, r.y): r.row for r in synthesis.upsample(rows).collect()}
    assert got == {(0, 0): [5.0] * 6, (0, 1): [5.0] * 6, (1, 0): [1.0] * 2, (1, 1): [1.0] * 2}


def test_even_points_and_their_rest(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 2, 3.0, 6.5), (2, 0, 1.0, 1.0)], "curve long, k int, x double, y double")
    got = sorted((r.curve, r.i, round(r.x, 6), round(r.y, 6), round(r.d, 6)) for r in synthesis.evenly_spaced(points, 2.0).collect())
    assert got == [(1, 0, 0.0, 0.0, 2.0), (1, 1, 1.2, 1.6, 2.0), (1, 2, 2.4, 3.2, 2.0), (1, 3, 3.0, 5.0, 2.0), (1, 4, 3.0, 6.5, 1.5), (2, 0, 1.0, 1.0, 2.0)]


@pytest.mark.parametrize(("left", "k", "ctx"), [(1, 1, 0), (2, 16, 92), (4, 40, 174), (33, 63, 472), (64, 15, 440)])
def test_coefficient_contexts_by_hand(left, k, ctx):
    """Twice the sum of the two tables' entries."""
    import duckdb

    sql = matrices.coefficient_context(str(left), str(k), 1, "0", PLAIN.div, PLAIN.shr)
    assert duckdb.sql(f"select {sql}").fetchall()[0][0] == ctx


def test_learned_tree_finds_the_property_that_matters(spark):
    """Samples above 100 are noisy, the others flat; the tree parts by the neighbours' size."""
    rng = np.random.default_rng(2)
    rows = [(0, 0, y, [int(v) for v in (np.full(64, 20) if y < 48 else rng.integers(100, 255, 64))]) for y in range(96)]
    plane = spark.createDataFrame(rows, "img int, c int, y int, row array<int>")
    tree = trees.learn_tree(plane, {"p4": [60, 300], "p12": [-9, 9]}, leaves=4, least=64, gain=64)
    assert tree[:2] == ("p4", 60)
    assert trees.learn_tree(plane.where("y < 40"), {"p4": [60]}, least=64) == (0, 5, 0, 1)


def test_transform_choice_of_equal_channels(spark):
    """Three equal noisy channels: a difference of channels is 0, so a transform with two differences wins."""
    rng = np.random.default_rng(3)
    rows = []
    for y in range(24):
        line = [int(v) for v in rng.integers(0, 256, 24)]
        rows += [(1, c, y, line) for c in range(3)] + [(2, c, y, [7] * 24) for c in range(3)]
    best = {r.img: r.type for r in lossless.best_transform(spark.createDataFrame(rows, "img long, c int, y int, row array<int>")).collect()}
    assert best[1] % 7 in (3, 6) and best[2] == 6


def test_quality_ratio_by_hand(spark):
    theirs = spark.createDataFrame([("a", 100, 10.0), ("a", 400, 20.0)], "img string, size long, quality double")
    ours = spark.createDataFrame([("a", 400, 15.0), ("a", 90, 5.0)], "img string, size long, quality double")
    got = {r.quality: r.ratio for r in statistics.quality_ratio(ours, theirs).collect()}
    assert got[15.0] == pytest.approx(2.0) and got[5.0] is None
