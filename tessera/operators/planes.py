"""Planes as rows of samples, and stencils over them.

A plane is a table (img, c, y, row ARRAY). A stencil sends each row to the rows that need it and gathers them
by (img, c, y), one shuffle whose keys are as many as there are rows, so a tall image spreads like many small
ones; neighbours along x are then read from the arrays without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.integer import CAUSAL


def stencil(rows: DataFrame, up: int, down: int, dx: tuple[int, int]) -> DataFrame:
    """img, c, y, x, v and the neighbours n_DY_DX (m for minus); null outside the plane.

    up, down: how many rows above and below; dx: the first and last column offset.
    """
    sent = rows.select("img", "c", "row", F.explode(F.array(*map(F.lit, range(-down, up + 1)))).alias("d"), "y")
    sent = sent.select("img", "c", (F.col("y") + F.col("d")).alias("y"), "d", "row")
    held = [F.first(F.when(F.col("d") == d, F.col("row")), ignorenulls=True).alias(f"r_{_name(-d)}") for d in range(-down, up + 1)]
    met = sent.groupBy("img", "c", "y").agg(*held).where("r_0 is not null")
    px = met.select("*", F.posexplode("r_0").alias("x", "v"))
    near = [F.get(f"r_{_name(dy)}", F.col("x") + dx_).alias(f"n_{_name(dy)}_{_name(dx_)}") for dy in range(-up, down + 1) for dx_ in range(dx[0], dx[1] + 1)]
    return px.select("img", "c", "y", "x", "v", *near)


def _name(k: int) -> str:
    return f"m{-k}" if k < 0 else str(k)


def causal(rows: DataFrame) -> DataFrame:
    """img, c, y, x, v and the neighbours that a decoder knows already, with the format's rules at the edges."""
    px = stencil(rows, 2, 0, (-2, 2))
    left = F.coalesce("n_0_m1", "n_m1_0", F.lit(0))
    top = F.coalesce(F.col("n_m1_0"), left)
    topright = F.coalesce(F.col("n_m1_1"), top)
    named = {
        "left_": left,
        "top_": top,
        "topleft": F.coalesce(F.col("n_m1_m1"), left),
        "topright": topright,
        "leftleft": F.coalesce(F.col("n_0_m2"), left),
        "toptop": F.coalesce(F.col("n_m2_0"), top),
        "toprightright": F.coalesce(F.col("n_m1_2"), topright),
    }
    return px.select("img", "c", "y", "x", "v", *(named[k].cast("long").alias(k) for k in CAUSAL))


def clamped(px: DataFrame, dy: int, dx: int) -> Column:
    """A neighbour at distance one, or the nearest sample inside the plane."""
    inner = [(dy, dx), (dy, 0), (0, dx), (0, 0)]
    return F.coalesce(*(F.col(f"n_{_name(a)}_{_name(b)}") for a, b in inner))


def rows_of(px: DataFrame, value: str = "v") -> DataFrame:
    """Samples (img, c, y, x, value) back to rows."""
    pairs = F.array_sort(F.collect_list(F.struct("x", F.col(value).alias("v"))))
    return px.groupBy("img", "c", "y").agg(F.transform(pairs, lambda p: p["v"]).alias("row"))


def regroup(rows: DataFrame, size: int = 256) -> DataFrame:
    """Rows cut at group borders: img, c, gy, gx, y, x0, row. Groups decode without each other."""
    cut = F.expr(f"transform(sequence(0, (size(row) - 1) div {size}), k -> struct(k as gx, slice(row, k * {size} + 1, {size}) as row))")
    parts = rows.where("size(row) > 0").select("img", "c", "y", F.explode(cut).alias("p"))
    return parts.select("img", "c", F.expr(f"y div {size}").alias("gy"), "p.gx", "y", (F.col("p.gx") * size).alias("x0"), "p.row")
