"""The three passes of the edge-preserving filter over planes of three channels.

A sample is averaged with its neighbours, each counting the less the more its surroundings differ in all channels. Rows
are sent to the rows that need them (three above, three below), one shuffle for a pass, and a task works on row windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the channels, the numerator of sigma, what the filter leaves alone, and factors of the differences.
CHANNELS = (40.0, 5.0, 3.5)
SIGMA_NUMERATOR, LEAST, QUANT_FACTOR = -1.1715728752538099024, -3.90524291751269967, 0.46
FACTOR, BORDER = 1.65, 2.0 / 3.0
PASSES = {0: 0.9, 1: 1.0, 2: 6.5}
PLUS = ((0, 0), (0, -1), (0, 1), (-1, 0), (1, 0))
REACH = 3


def inverse_sigma(quant: str, sharpness: str, scale: str) -> str:
    """1 / sigma of a block from its quantiser and its sharpness (0 to 7), as SQL text."""
    sigma = f"cast('{QUANT_FACTOR!r}' as double) / ({scale} * {quant} * cast('{SIGMA_NUMERATOR!r}' as double)) * ({sharpness} / cast(7.0 as double))"
    return f"1 / least(cast(-0.0001 as double), {sigma})"


def offsets(stage: int) -> list[tuple[int, int]]:
    """(dy, dx) of the neighbours: twelve in the first pass, four in the others."""
    reach = 2 if stage == 0 else 1
    return [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if 0 < abs(dy) + abs(dx) <= reach]


def filtered_row(window: np.ndarray, y: int, sigma: np.ndarray, stage: int) -> np.ndarray:
    """window: (3, 7, width), mirrored above and below; sigma: 1 / sigma of each sample. The middle row of all channels."""
    width = window.shape[2]
    at = np.arange(-REACH, width + REACH)
    at = np.clip(np.where(at < 0, -at - 1, np.where(at >= width, 2 * width - 1 - at, at)), 0, width - 1)
    p = window[:, :, at]
    part = lambda dy, dx: p[:, REACH + dy, REACH + dx : REACH + dx + width]
    x = np.arange(width)
    edge = (x % 8 == 0) | (x % 8 == 7) | (y % 8 in (0, 7))
    slope = sigma * FACTOR * PASSES[stage] * np.where(edge, BORDER, 1.0)
    scale = np.array(CHANNELS)[:, None]
    total, weight = part(0, 0).copy(), np.ones(width)
    for dy, dx in offsets(stage):
        taps = PLUS[:1] if stage == 2 else PLUS
        apart = sum((np.abs(part(a, b) - part(a + dy, b + dx)) * scale).sum(0) for a, b in taps)
        w = np.maximum(0.0, 1 + apart * slope)
        total, weight = total + w * part(dy, dx), weight + w
    return np.where(sigma < LEAST, part(0, 0), total / weight)


def edge_pass(rows: DataFrame, stage: int, sigma: float | Column = SIGMA_NUMERATOR) -> DataFrame:
    """rows (img, c from 0 to 2, y, row, anything that `sigma` needs) after one pass: img, c, y, row.

    sigma: 1 / sigma of the whole plane, or a column with the array of 1 / sigma of the 8-sample blocks of the row.
    """
    own = sigma if isinstance(sigma, Column) else F.array(F.lit(float(sigma)))
    sent = rows.select("img", "c", "y", F.col("row").cast("array<double>").alias("row"), own.cast("array<double>").alias("s"))
    sent = sent.select("img", "c", "row", "s", F.explode(F.array(*map(F.lit, range(-REACH, REACH + 1)))).alias("d"), "y").select("img", "c", "d", "row", "s", (F.col("y") + F.col("d")).alias("y"))
    met = sent.groupBy("img", "y").agg(F.collect_list(F.struct("c", (-F.col("d")).alias("d"), "row", "s")).alias("near"))  # 21 rows at most
    met = met.where(F.exists("near", lambda x: x["d"] == 0))

    @F.pandas_udf("array<array<double>>")
    def one(ys: pd.Series, near: pd.Series) -> pd.Series:
        out = []
        for y, found in zip(ys, near, strict=True):
            held = {(x["c"], x["d"]): x for x in found}
            low, high = min(d for _, d in held), max(d for _, d in held)

            def place(d: int, low: int = low, high: int = high) -> int:
                """The row that stands for the one at d: itself, or its mirror image."""
                d = 2 * low - 1 - d if d < low else 2 * high + 1 - d if d > high else d
                return min(max(d, low), high)

            window = np.array([[held[c, place(d)]["row"] for d in range(-REACH, REACH + 1)] for c in range(3)])
            blocks = np.asarray(held[0, 0]["s"], float)
            width = window.shape[2]
            each = np.full(width, blocks[0]) if len(blocks) == 1 else np.repeat(blocks, 8)[:width]
            out.append(filtered_row(window, int(y), each, stage).tolist())
        return pd.Series(out)

    return met.select("img", "y", F.posexplode(one("y", "near")).alias("c", "row")).select("img", "c", "y", "row")


def restore(rows: DataFrame, passes: int, sigma: float | Column = SIGMA_NUMERATOR) -> DataFrame:
    """The passes that a frame asks for: the second from one on, the last from two on, the first with three."""
    now = rows
    for stage in [0] * (passes >= 3) + [1] * (passes >= 1) + [2] * (passes >= 2):
        now = edge_pass(now, stage, sigma)
    return now
