"""Rate-distortion choices, context models and edge-preserving filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colour import num
from . import planes
from .filters import QUANT_BIAS, QUANT_NUMERATOR


def reconstructed(q: str, bias: float = QUANT_BIAS[1]) -> str:
    """What a decoder makes of a quantised coefficient, in steps: 0, +-bias, or q - numerator / q."""
    return f"case when {q} = 0 then cast(0 as double) when {q} = 1 then {num(bias)} when {q} = -1 then {num(-bias)} else {q} - {num(QUANT_NUMERATOR)} / {q} end"


def dead_zone(c: str, step: str, q: str, weight: float, nonzero_bits: float) -> str:
    """Of q, q one step towards zero, and zero: the cheapest by squared error + weight * step^2 * bits, q on ties."""
    nearer = f"({q} - cast(sign({q}) as int))"

    def cost(k: str) -> str:
        bits = f"case when {k} = 0 then cast(0 as double) else {num(nonzero_bits)} + log2(cast(greatest(abs({k}), 1) as double)) end"
        return f"(({c} - ({reconstructed(k)}) * {step}) * ({c} - ({reconstructed(k)}) * {step}) + {num(weight)} * {step} * {step} * ({bits}))"

    at, near, none = cost(q), cost(nearer), cost("0")
    return f"case when {q} = 0 then 0 when {near} < {at} and {near} <= {none} then {nearer} when {none} < {at} then 0 else {q} end"


def edge_preserving(rows: DataFrame, inverse_sigma: float, border: float = 2.0 / 3.0) -> DataFrame:
    """One pass over the four nearest samples: weights fall with the difference and more so at 8 x 8 block edges.

    inverse_sigma is negative; a neighbour counts max(0, 1 + |difference| * inverse_sigma).
    """
    px = planes.stencil(rows, 1, 1, (-1, 1))
    edge = (F.col("x") % 8).isin(0, 7) | (F.col("y") % 8).isin(0, 7)
    slope = F.lit(inverse_sigma) * F.when(edge, F.lit(border)).otherwise(F.lit(1.0))
    top = weight = F.lit(0.0)
    for dy, dx in ((-1, 0), (0, -1), (0, 1), (1, 0)):
        t = planes.clamped(px, dy, dx).cast("double")
        w = F.greatest(F.lit(0.0), 1 + F.abs(t - F.col("v")) * slope)
        top, weight = top + w * t, weight + w
    return px.select("img", "c", "y", "x", ((F.col("v") + top) / (1 + weight)).alias("v"))


def expected_nonzeros(blocks: DataFrame) -> DataFrame:
    """blocks (img, c, brow, bcol, nz) with pred: mean of the left and upper counts, or the one there is, or 32."""
    left = F.lag("nz").over(Window.partitionBy("img", "c", "brow").orderBy("bcol"))
    above = blocks.select("img", "c", (F.col("brow") + 1).alias("brow"), "bcol", F.col("nz").alias("above"))
    met = blocks.withColumn("left", left).join(above, ["img", "c", "brow", "bcol"], "left")
    return met.withColumn("pred", F.expr("coalesce((above + left + 1) div 2, left, above, 32)")).drop("left", "above")


def natural_order(n: int = 8) -> list[tuple[int, int]]:
    """(u, k) of the coefficients of an n x n block by anti-diagonals, turning at each."""
    spots = [(u, k) for u in range(n) for k in range(n)]
    return sorted(spots, key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))


def nearest_repeat(symbols: DataFrame, least: int = 4) -> DataFrame:
    """symbols (doc_id, i, b) with dist: how far back the same run of `least` symbols last began, or null."""
    order = Window.partitionBy("doc_id").orderBy("i")
    grams = [F.lead("b", k).over(order).alias(f"g{k}") for k in range(1, least)]
    runs = symbols.select("doc_id", "i", "b", *grams).where(f"g{least - 1} is not null")
    same = Window.partitionBy("doc_id", "b", *(f"g{k}" for k in range(1, least))).orderBy("i")
    return runs.select("doc_id", "i", (F.col("i") - F.lag("i").over(same)).alias("dist"))


def linear_prediction(p1: str, p2: str, p3: str, order: int) -> str:
    """A byte from the three before it at a stride: constant, linear or quadratic, modulo 256."""
    made = {0: p1, 1: f"2 * {p1} - {p2}", 2: f"3 * {p1} - 3 * {p2} + {p3}"}[order]
    return f"(({made}) & 255)"


def equal_size_difference(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """ours (img, size, quality) with delta: quality less that of their frontier at the same size, linear in log2
    size; null outside their sizes. theirs must be a frontier."""
    curve = theirs.select("img", F.log2(F.col("size").cast("double")).alias("x0"), F.col("quality").alias("y0"))
    order = Window.partitionBy("img").orderBy("x0")
    pieces = curve.withColumns({"x1": F.lead("x0").over(order), "y1": F.lead("y0").over(order)}).where("x1 is not null")
    at = ours.withColumn("x", F.log2(F.col("size").cast("double")))
    met = at.join(pieces, "img").where("x between x0 and x1")
    there = met.groupBy("img", "size", "quality").agg(F.min(F.expr("y0 + (x - x0) / (x1 - x0) * (y1 - y0)")).alias("there"))
    return ours.join(there, ["img", "size", "quality"], "left").select("img", "size", "quality", (F.col("quality") - F.col("there")).alias("delta"))
