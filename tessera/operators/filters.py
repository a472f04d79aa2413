"""Neighbourhood filters and block transforms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import planes

# The format's default weights of its 3x3 smoothing filter.
GABORISH_1, GABORISH_2 = 1.1 * 0.104699568, 1.1 * 0.055680538
# Bias of +-1 for the three channels, and the numerator for larger coefficients.
QUANT_BIAS = (1.0 - 0.05465007330715401, 1.0 - 0.07005449891748593, 1.0 - 0.049935103337343655)
QUANT_NUMERATOR = 0.145


def gaborish(rows: DataFrame, w1: float = GABORISH_1, w2: float = GABORISH_2) -> DataFrame:
    """img, c, y, x, v: the normalised 3x3 filter; samples outside repeat the edge."""
    px = planes.stencil(rows, 1, 1, (-1, 1))
    at = lambda dy, dx: planes.clamped(px, dy, dx).cast("double")
    side = at(0, -1) + at(0, 1) + at(-1, 0) + at(1, 0)
    corner = at(-1, -1) + at(-1, 1) + at(1, -1) + at(1, 1)
    total = 1.0 + 4.0 * (w1 + w2)
    return px.select("img", "c", "y", "x", ((F.col("v") + side * w1 + corner * w2) / total).alias("v"))


def mirrored_index(i: str, n: str) -> str:
    """An index outside 0..n-1 by at most n, mirrored with the edge sample repeated."""
    return f"case when {i} < 0 then -({i}) - 1 when {i} >= {n} then 2 * {n} - 1 - ({i}) else {i} end"


def zero_sum_5x5(rows: DataFrame, height: int) -> DataFrame:
    """img, c, y, x, v: four times the difference of a sample and the mean of its 5x5 neighbourhood, edges mirrored.

    Each row goes to the rows whose neighbourhood has it, as often as mirroring puts it there.
    """
    to = F.explode(F.expr(f"filter(transform(sequence(y - 2, y + 2), t -> t), t -> t >= 0 and t < {height})"))
    near = rows.select("img", "c", "y", "row", to.alias("to"))
    # Row s stands for offset o of row t when mirroring t + o gives s.
    times = " + ".join(f"case when {mirrored_index(f'(to + {o})', str(height))} = y then 1 else 0 end" for o in range(-2, 3))
    weighted = near.withColumn("times", F.expr(times)).where("times > 0")
    summed = weighted.groupBy("img", "c", F.col("to").alias("y")).agg(
        F.collect_list(F.struct("times", "row")).alias("rows"), F.first(F.when(F.col("y") == F.col("to"), F.col("row")), ignorenulls=True).alias("row")
    )  # five rows at most
    column = "transform(row, (v, x) -> aggregate(rows, 0L, (a, r) -> a + r.times * r.row[x]))"
    held = summed.select("img", "c", "y", "row", F.expr(column).alias("down"), F.size("row").alias("w"))
    px = held.select("img", "c", "y", "w", "down", F.posexplode("row").alias("x", "v"))
    box = " + ".join(f"down[{mirrored_index(f'(x + {o})', 'w')}]" for o in range(-2, 3))
    return px.select("img", "c", "y", "x", F.expr(f"({box} - v) * 0.16d - v * 3.84d").alias("v"))


def upsample_rows(rows: DataFrame) -> DataFrame:
    """Doubles the width with the triangle filter (3/4, 1/4): img, c, y, x, v."""
    px = rows.select("img", "c", "y", "row", F.posexplode("row").alias("k", "m"))
    at = lambda d: F.coalesce(F.get("row", F.col("k") + d), "m").cast("double")
    both = F.posexplode(F.array(0.25 * at(-1) + 0.75 * F.col("m"), 0.75 * F.col("m") + 0.25 * at(1)))
    return px.select("img", "c", "y", "k", both.alias("o", "v")).select("img", "c", "y", (2 * F.col("k") + F.col("o")).alias("x"), "v")


def smooth_dc(rows: DataFrame, step: float, w1: float = 0.20345139757231578, w2: float = 0.0334829185968739) -> DataFrame:
    """Adaptive smoothing of a DC plane: inner samples move towards a 3x3 mean unless that is far from them."""
    px = planes.stencil(rows, 1, 1, (-1, 1))
    near = [f"n_{a}_{b}" for a, b in (("0", "m1"), ("0", "1"), ("m1", "0"), ("1", "0"), ("m1", "m1"), ("m1", "1"), ("1", "m1"), ("1", "1"))]
    side, corner = (" + ".join(g) for g in (near[:4], near[4:]))
    smooth = f"(({corner}) * cast({w2!r} as double) + ({side}) * cast({w1!r} as double) + v * cast({1 - 4 * (w1 + w2)!r} as double))"
    found = px.withColumn("s", F.expr(smooth))
    gap = F.greatest(F.lit(0.5), F.abs((F.col("v") - F.col("s")) / F.lit(step)))
    factor = F.greatest(F.lit(0.0), 3.0 - 4.0 * gap)
    return found.select("img", "c", "y", "x", F.coalesce((F.col("s") - F.col("v")) * factor + F.col("v"), F.col("v").cast("double")).alias("v"))


def basis(n: int) -> list[list[float]]:
    """Row u of the forward cosine transform whose first coefficient is the mean."""
    return [[(1.0 if u == 0 else math.sqrt(2.0)) * math.cos(math.pi * u * (2 * x + 1) / (2 * n)) / n for x in range(n)] for u in range(n)]


def blocks(rows: DataFrame, n: int = 8) -> DataFrame:
    """Whole n x n blocks: img, c, brow, bcol, m (rows of the block, in order)."""
    cut = F.expr(f"transform(sequence(0, size(row) div {n} - 1), k -> struct(k as bcol, slice(row, k * {n} + 1, {n}) as part))")
    parts = rows.where(f"size(row) >= {n}").select("img", "c", F.expr(f"y div {n}").alias("brow"), "y", F.explode(cut).alias("p"))
    gathered = parts.groupBy("img", "c", "brow", "p.bcol").agg(F.array_sort(F.collect_list(F.struct("y", "p.part"))).alias("m"))
    return gathered.where(F.size("m") == n).select("img", "c", "brow", "bcol", F.transform("m", lambda r: r["part"]).alias("m"))


def _product(weights: list[list[float]], vector) -> F.Column:
    rows = [F.aggregate(F.zip_with(vector, F.array(*map(F.lit, w)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, t: s + t) for w in weights]
    return F.array(*rows)


def forward_dct(rows: DataFrame, n: int = 8) -> DataFrame:
    """img, c, brow, bcol, u, k, f: coefficient (vertical u, horizontal k) of each block, as two matrix products."""
    m = basis(n)
    across = blocks(rows, n).withColumn("m", F.transform("m", lambda r: _product(m, r)))
    turned = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.transform("m", lambda r: F.get(r, k)))
    both = across.withColumn("m", turned).withColumn("m", F.transform("m", lambda r: _product(m, r)))
    return both.select("img", "c", "brow", "bcol", F.posexplode("m").alias("k", "col")).select("img", "c", "brow", "bcol", "k", F.posexplode("col").alias("u", "f"))


def block_means(rows: DataFrame, n: int = 8) -> DataFrame:
    """The preview at 1/n: img, c, brow, bcol, mean, low and high."""
    px = rows.select("img", "c", F.expr(f"y div {n}").alias("brow"), F.posexplode("row").alias("x", "v")).withColumn("bcol", F.expr(f"x div {n}"))
    return px.groupBy("img", "c", "brow", "bcol").agg(F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
