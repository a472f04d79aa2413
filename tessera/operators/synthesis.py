"""What a decoder adds or rebuilds on planes: upsampling, block transforms, splines, noise, and the inverse of the smoothing filter."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matrices
from . import filters, planes

# The usual weights for doubling, the upper triangle of a symmetric 5 x 5 kernel.
DOUBLE = (-0.01716200, -0.03452303, -0.04022174, -0.02921014, -0.00624645, 0.14111091, 0.28896755, 0.00278718, -0.01610267, 0.56661550, 0.03777607, -0.01986694, -0.03144731, -0.01185068, -0.00213539)


def kernels(weights: tuple[float, ...], factor: int) -> np.ndarray:
    """(factor, factor, 5, 5): the kernel of each sample out of one, by row and column.

    The weights are the upper triangle of a symmetric matrix with 5 * factor / 2 rows; its 5 x 5 blocks are the kernels of
    one quarter, and the other quarters mirror them.
    """
    half = factor // 2
    n = 5 * half
    whole = np.zeros((n, n))
    whole[np.triu_indices(n)] = weights
    whole += np.triu(whole, 1).T
    out = np.zeros((factor, factor, 5, 5))
    for a in range(factor):
        for b in range(factor):
            i, j = min(a, factor - 1 - a), min(b, factor - 1 - b)
            k = whole[5 * i : 5 * i + 5, 5 * j : 5 * j + 5]
            out[a, b] = k[:: 1 if a < half else -1, :: 1 if b < half else -1]
    return out


def upsample(rows: DataFrame, factor: int = 2, weights: tuple[float, ...] = DOUBLE) -> DataFrame:
    """rows (img, c, y, row) at factor times the size, as (img, c, y, row of doubles); edges mirrored.

    A result stays between the least and the greatest of the 25 samples that it comes from. Each row meets the two above
    and below; a task works on its rows alone.
    """
    bank = kernels(weights, factor)
    sent = rows.select("img", "c", "row", F.explode(F.array(*map(F.lit, range(-2, 3)))).alias("d"), "y").select("img", "c", (F.col("y") + F.col("d")).alias("y"), "d", F.col("row").cast("array<double>").alias("row"))
    held = [F.first(F.when(F.col("d") == d, F.col("row")), ignorenulls=True).alias(f"r{-d + 2}") for d in range(-2, 3)]
    met = sent.groupBy("img", "c", "y").agg(*held).where("r2 is not null")

    @F.pandas_udf("array<array<double>>")
    def grown(r0: pd.Series, r1: pd.Series, r2: pd.Series, r3: pd.Series, r4: pd.Series) -> pd.Series:
        out = []
        for far_up, up, mid, down, far_down in zip(r0, r1, r2, r3, r4, strict=True):
            first, last = up is None, down is None
            up, down = mid if first else up, mid if last else down
            far_up = (down if first else up) if far_up is None else far_up
            far_down = (up if last else down) if far_down is None else far_down
            five = np.stack([far_up, up, mid, down, far_down])
            width = five.shape[1]
            at = np.arange(-2, width + 2)
            at = np.clip(np.where(at < 0, -at - 1, np.where(at >= width, 2 * width - 1 - at, at)), 0, width - 1)
            near = np.lib.stride_tricks.sliding_window_view(five[:, at], 5, axis=1)  # (5, width, 5)
            low, high = near.min((0, 2)), near.max((0, 2))
            made = np.einsum("abij,iwj->awb", bank, near)
            out.append(np.clip(made, low[None, :, None], high[None, :, None]).reshape(factor, -1).tolist())
        return pd.Series(out)

    both = met.select("img", "c", "y", F.posexplode(grown(*(f"r{k}" for k in range(5)))).alias("k", "row"))
    return both.select("img", "c", (F.col("y") * factor + F.col("k")).alias("y"), "row")


def sharpened(rows: DataFrame, rounds: int = 5, w1: float = filters.GABORISH_1, w2: float = filters.GABORISH_2) -> DataFrame:
    """rows whose smoothing gives about the given ones: what the smoothing misses is added back, round by round."""
    given = rows.select("img", "c", "y", F.col("row").cast("array<double>").alias("row"))
    now = given
    for _ in range(rounds):
        smooth = planes.rows_of(filters.gaborish(now, w1, w2)).withColumnRenamed("row", "s")
        met = now.join(smooth, ["img", "c", "y"]).join(given.withColumnRenamed("row", "g"), ["img", "c", "y"])
        now = met.select("img", "c", "y", F.expr("zip_with(zip_with(row, g, (a, b) -> a + b), s, (a, b) -> a - b)").alias("row"))
    return now


def smoothing_residual(given: DataFrame, made: DataFrame) -> DataFrame:
    """img, c and the mean square of what smoothing `made` misses of `given`."""
    smooth = planes.rows_of(filters.gaborish(made)).withColumnRenamed("row", "s")
    off = given.join(smooth, ["img", "c", "y"]).select("img", "c", F.explode(F.expr("zip_with(row, s, (a, b) -> (a - b) * (a - b))")).alias("e"))
    return off.groupBy("img", "c").agg(F.avg("e").alias("residual"))


def block_transform(rows: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """n x n blocks by the cosine transform whose first coefficient is the mean, or back: img, c, brow, bcol, m (n rows).

    rows: planes (forward), or blocks as given out (inverse). Two matrix products for each batch of blocks.
    """
    forward = np.array(filters.basis(n))
    backward = np.linalg.inv(forward)
    m = backward if inverse else forward

    @F.pandas_udf("array<array<double>>")
    def turned(blocks: pd.Series) -> pd.Series:
        stacked = np.array([[list(r) for r in b] for b in blocks], float).reshape(-1, n, n)
        return pd.Series([x.tolist() for x in m @ stacked @ m.T])

    cut = rows if inverse else filters.blocks(rows, n)
    return cut.withColumn("m", turned(F.col("m").cast("array<array<double>>")))


def continuous(coefficients: Column, t: Column) -> Column:
    """32 cosine coefficients read at any place from 0 to 31."""
    each = F.transform(coefficients, lambda c, k: c.cast("double") * F.cos(k * F.lit(math.pi / 32) * (t + 0.5)) * F.lit(math.sqrt(2)))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)


def evenly_spaced(points: DataFrame, step: float = 1.0) -> DataFrame:
    """points (curve, k, x, y) to curve, i, x, y, d: points at equal distance along the line through them; d is shorter at the end."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        long = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))])
        at = np.arange(0, long[-1], step) if long[-1] else np.zeros(1)
        at = np.append(at, long[-1]) if long[-1] > at[-1] else at
        return pd.DataFrame({"curve": pdf["curve"].iloc[0], "i": np.arange(len(at)), "x": np.interp(at, long, x), "y": np.interp(at, long, y), "d": np.concatenate([[step], np.diff(at)])})

    return points.select("curve", "k", "x", "y").groupBy("curve").applyInPandas(walk, "curve long, i long, x double, y double, d double")


SPLAT = {
    "reach": "sqrt(-2 * sigma * sigma * (ln(cast(0.1 as double)) * 5 - ln(greatest(cast(0.01 as double), abs(colour * intensity)))))",
    "share": f"({matrices.erf_sql('((r * 0.5 + cast(0.353553391 as double)) / sigma)')} - {matrices.erf_sql('((r * 0.5 - cast(0.353553391 as double)) / sigma)')})",
}


def splats(segments: DataFrame, height: int, width: int) -> DataFrame:
    """segments (img, cx, cy, sigma, intensity, colour) to img, y, x, v: the sum of their blurred points.

    An interval join by expansion, over rows and then columns within reach; sums are partial before the shuffle.
    """
    near = segments.withColumn("reach", F.expr(SPLAT["reach"])).where("reach is not null and not isnan(reach)")
    spans = lambda c, n: F.expr(f"sequence(greatest(0, cast(round({c} - reach) as int)), least({n - 1}, cast(round({c} + reach) as int)))")
    meets = "round({0} + reach) >= 0 and round({0} - reach) <= {1}"
    on = near.where(meets.format("cy", height - 1)).withColumn("y", F.explode(spans("cy", height)))
    on = on.where(meets.format("cx", width - 1)).withColumn("x", F.explode(spans("cx", width)))
    on = on.withColumn("r", F.expr("sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))")).withColumn("share", F.expr(SPLAT["share"]))
    return on.groupBy("img", "y", "x").agg(F.sum(F.expr("colour * 0.25 * sigma * intensity * share * share")).alias("v"))


def noise_planes(tiles: DataFrame) -> DataFrame:
    """tiles (img, visible, invisible, x0, y0, height, width) to img, c, y, row: three planes from 1 to 2 for each tile."""

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t in pdf.itertuples(index=False):
            source = matrices.Noise(int(t.visible), int(t.invisible), int(t.x0), int(t.y0))
            for c in range(3):
                for k, row in enumerate(source.tile(int(t.height), int(t.width))):
                    out.append((t.img, c, t.y0 + k, t.x0, row.astype(float)))
        return pd.DataFrame(out, columns=["img", "c", "y", "x0", "row"])

    found = tiles.groupBy("img", "x0", "y0").applyInPandas(made, "img long, c int, y long, x0 long, row array<double>")
    met = found.groupBy("img", "c", "y").agg(F.array_sort(F.collect_list(F.struct("x0", "row"))).alias("of"))
    return met.select("img", "c", "y", F.flatten(F.transform("of", lambda p: p["row"])).alias("row"))
