"""Curves, patch blending by mode, header arithmetic, and planes put together again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .compose import BLEND

STEPS = 16

#: Blend modes of patches over b, ba (the canvas) and f, fa (the patch).
PATCH = {
    "none": "b",
    "replace": "f",
    "add": BLEND["add"],
    "mul": BLEND["mul"],
    "blend_above": BLEND["blend"],
    "blend_below": "case when 1 - (1 - fa) * (1 - ba) > 0 then (b * ba + f * fa * (1 - ba)) / (1 - (1 - fa) * (1 - ba)) else cast(0 as double) end",
    "weighted_add_above": "b + f * fa",
    "weighted_add_below": "f + b * ba",
}


def curve_point(i: str, axis: str, steps: int = STEPS) -> str:
    """Point i of a centripetal curve piece from (x1, y1) to (x2, y2), by linear interpolation thrice, as SQL text.

    Names: x0..x3, y0..y3 and the knots t1, t2, t3 (t0 is 0).
    """
    t = f"(t1 + {i} / cast({steps}.0 as double) * (t2 - t1))"
    p = [f"{axis}{k}" for k in range(4)]
    knot = ["0", "t1", "t2", "t3"]

    def mix(a: str, b: str, lo: str, hi: str) -> str:
        return f"({a} + ({t} - {lo}) / ({hi} - {lo}) * ({b} - {a}))"

    first = [mix(p[k], p[k + 1], knot[k], knot[k + 1]) for k in range(3)]
    second = [mix(first[k], first[k + 1], knot[k], knot[k + 2]) for k in range(2)]
    return f"case when {i} = 0 then {p[1]} else {mix(second[0], second[1], 't1', 't2')} end"


def knots() -> dict[str, str]:
    """Knot distances are square roots of the distances of the points."""
    root = lambda k: f"pow((x{k + 1} - x{k}) * (x{k + 1} - x{k}) + (y{k + 1} - y{k}) * (y{k + 1} - y{k}), 0.25e0)"
    return {"t1": root(0), "t2": f"{root(0)} + {root(1)}", "t3": f"{root(0)} + {root(1)} + {root(2)}"}


def smooth_curve(points: DataFrame, steps: int = STEPS) -> DataFrame:
    """points (curve, k, x, y; neighbours differ) to curve, k, i, px, py: `steps` points from each to the next.

    Beyond its ends a curve goes on as far as it came.
    """
    order = Window.partitionBy("curve").orderBy("k")
    near = {f"{a}{n}": F.lag(a).over(order) if d < 0 else F.lead(a, d).over(order) for a in "xy" for n, d in ((0, -1), (2, 1), (3, 2))}
    met = points.withColumns(near).withColumns({"x1": F.col("x"), "y1": F.col("y")}).where("x2 is not null")
    ends = {f"{a}0": F.coalesce(f"{a}0", 2 * F.col(f"{a}1") - F.col(f"{a}2")) for a in "xy"} | {f"{a}3": F.coalesce(f"{a}3", 2 * F.col(f"{a}2") - F.col(f"{a}1")) for a in "xy"}
    knotted = met.withColumns(ends).withColumns({k: F.expr(v) for k, v in knots().items()})
    at = knotted.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return at.select("curve", "k", "i", F.expr(curve_point("i", "x", steps)).alias("px"), F.expr(curve_point("i", "y", steps)).alias("py"))


def rows_covered(segments: DataFrame, height: int) -> DataFrame:
    """segments (id, cy, radius) to one row for each plane row within the radius: an interval join by expansion."""
    spans = segments.select("id", F.expr(f"cast(greatest(0, ceil(cy - radius)) as bigint) as lo"), F.expr(f"cast(least({height - 1}, floor(cy + radius)) as bigint) as hi")).where("lo <= hi")
    return spans.select("id", F.explode(F.sequence("lo", "hi")).alias("y"))


def width_of(ratio: str, height: str, div) -> str:
    """Width from the seven aspect-ratio codes of a size header."""
    shares = ((1, 1, 1), (2, 12, 10), (3, 4, 3), (4, 3, 2), (5, 16, 9), (6, 5, 4), (7, 2, 1))
    return "case " + " ".join(f"when {ratio} = {k} then {div(f'{height} * {a}', str(b))}" for k, a, b in shares) + " end"


def strength(table: list[float], v: str) -> str:
    """Interpolated noise strength at v * 6 in a table of eight, as SQL text; flat beyond the last."""
    at = f"greatest({v} * 6, cast(0 as double))"
    pick = lambda shift: "case cast(floor(" + at + f") as int) + {shift} " + " ".join(f"when {k} then cast('{t!r}' as double)" for k, t in enumerate(table)) + " end"
    last = f"cast('{table[-1]!r}' as double)"
    return f"least(greatest(case when {at} >= {len(table) - 1} then {last} else {pick(0)} + ({at} - floor({at})) * ({pick(1)} - {pick(0)}) end, cast(0 as double)), cast(1 as double))"


def unsqueezed(avg: np.ndarray, res: np.ndarray) -> np.ndarray:
    """A row from its averages and residuals; each pair's expected difference depends on the pair before."""
    out: list[int] = []
    for k, a in enumerate(avg.tolist()):
        if k == len(res):
            out.append(a)
            break
        before, following = out[-1] if out else a, int(avg[k + 1]) if k + 1 < len(avg) else a
        half = _expected(before, a, following) + int(res[k])
        first = a + int(half / 2)
        out += [first, first - half]
    return np.array(out, np.int64)


def _expected(b: int, a: int, n: int) -> int:
    """The same rule as functions.integer.smooth_tendency, for values in hand."""
    if (b - a) * (a - n) < 0:
        return 0
    before, after = abs(b - a), abs(a - n)
    size = min((4 * before + 3 * after + 6) // 12, 2 * before + 1, 2 * after)
    return size if b > a or a > n else -size


def unsqueeze_rows(parts: DataFrame) -> DataFrame:
    """img, c, y, k, avg, res (as lossless.squeeze_rows makes them) back to rows."""
    listed = F.array_sort(F.collect_list(F.struct("k", "avg", "res")))
    whole = parts.groupBy("img", "c", "y").agg(listed.alias("p"))
    whole = whole.select("img", "c", "y", F.transform("p", lambda p: p["avg"]).alias("avg"), F.transform(F.filter("p", lambda p: p["res"].isNotNull()), lambda p: p["res"]).alias("res"))

    def back(avg: pd.Series, res: pd.Series) -> pd.Series:
        return pd.Series([unsqueezed(np.asarray(a), np.asarray(r)) for a, r in zip(avg, res, strict=True)])

    return whole.select("img", "c", "y", F.pandas_udf(back, "array<long>")("avg", "res").alias("row"))
