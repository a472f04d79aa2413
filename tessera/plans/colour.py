"""Queries of colour, filters and block transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour
from ..operators import filters
from . import base

UNIT = [f"(c{k} / cast(255.0 as double)) as s{k}" for k in range(3)]
LONGX = "cast(x as bigint) as x"


def _rounded(named: dict[str, str], digits: int = 6) -> list[str]:
    return [f"round({e}, {digits}) as {k}" for k, e in named.items()]


def _unit(spark: SparkSession, d: str) -> DataFrame:
    return base.rgb(spark, d).selectExpr("y", "x", *UNIT)


UNIT_SQL = f"with {base.RGB}, unit as (select y, x, {', '.join(UNIT)} from rgb)"


def _three(made: tuple[str, ...], names: str = "abc") -> list[str]:
    return _rounded(dict(zip(names, made, strict=True)))


def _per_pixel(exprs: list[str]):
    return lambda spark, d: _unit(spark, d).selectExpr("y", "x", *exprs)


def _per_pixel_sql(exprs: list[str]) -> str:
    return f"{UNIT_SQL} select y, x, {', '.join(exprs)} from unit"


PIXEL: dict[str, list[str]] = {
    **{f"{k}_encode": _three(tuple(f(f"s{c}") for c in range(3))) for k, f in colour.ENCODE.items() if k != "linear"},
    **{f"{k}_decode": _three(tuple(f(f"s{c}") for c in range(3))) for k, f in colour.DECODE.items() if k != "linear"},
    "rgb_to_xyb": _three(colour.to_xyb("s0", "s1", "s2")),
    "xyb_to_linear": _three(colour.from_xyb("(s0 - 0.5) * 0.02", "s1 * 0.8", "s2 * 0.8")),
    "ycbcr_to_rgb": _three(colour.ycbcr_to_rgb("s0", "(s1 - 0.5)", "(s2 - 0.5)")),
    "extended_encode": _three(tuple(colour.extended("dci", f"(s{c} - 0.5)") for c in range(3))),
    "quantise8_clamp": [f"{colour.quantise(f's{c} * 3 - 1')} as {n}" for c, n in enumerate("abc")],
    "quantise16_clamp": [f"{colour.quantise(f's{c} * 1.5 - 0.25', 65535)} as {n}" for c, n in enumerate("abc")],
}


def gaborish_3x3(spark: SparkSession, d: str) -> DataFrame:
    return filters.gaborish(base.plane(spark, d)).select("y", F.expr(LONGX), F.round("v", 6).alias("v"))


def noise_conv_5x5(spark: SparkSession, d: str) -> DataFrame:
    rows = base.plane(spark, d)
    height = rows.count()
    return filters.zero_sum_5x5(rows, height).select("y", F.expr(LONGX), F.round("v", 6).alias("v"))


def _noise_sql() -> str:
    near = ", ".join(f"({o})" for o in range(-2, 3))
    return f"""with {base.PX}, dims as (select max(y) + 1 as h, max(x) + 1 as w from px),
spots as (select p.y, p.x, p.v, {filters.mirrored_index("(p.y + dy)", "h")} as sy, {filters.mirrored_index("(p.x + dx)", "w")} as sx from px p, dims, (values {near}) a(dy), (values {near}) b(dx))
select s.y, s.x, round((sum(q.v) - max(s.v)) * cast(0.16 as double) - max(s.v) * cast(3.84 as double), 6) as v from spots s join px q on q.y = s.sy and q.x = s.sx group by s.y, s.x"""


def chroma_upsample_2x(spark: SparkSession, d: str) -> DataFrame:
    return filters.upsample_rows(base.plane(spark, d)).select("y", F.expr(LONGX), "v")


def dc_smoothing(spark: SparkSession, d: str) -> DataFrame:
    return filters.smooth_dc(base.plane(spark, d), 64.0).select("y", F.expr(LONGX), F.round("v", 6).alias("v"))


W1, W2 = 0.20345139757231578, 0.0334829185968739


def block_mean_dc(spark: SparkSession, d: str) -> DataFrame:
    return filters.block_means(base.plane(spark, d)).select("brow", F.col("bcol").cast("long").alias("bcol"), "mean", "low", "high", "n")


def dct8_forward(spark: SparkSession, d: str) -> DataFrame:
    made = filters.forward_dct(base.plane(spark, d))
    return made.select("brow", *(F.col(c).cast("long").alias(c) for c in ("bcol", "u", "k")), (F.round(F.col("f") + F.lit(3e-7), 5) + F.lit(0.0)).alias("f"))


def _dct_sql() -> str:
    m = filters.basis(8)
    values = ", ".join(f"({u}, {x}, cast('{m[u][x]!r}' as double))" for u in range(8) for x in range(8))
    return f"""with {base.PX}, b as (select * from (values {values}) t(u, i, w)), whole as (select y // 8 as wy from px group by y // 8 having count(*) = 512),
across as (select p.y, p.x // 8 as bcol, b.u as k, sum(p.v * b.w) as t from px p join b on b.i = p.x % 8 group by p.y, p.x // 8, b.u)
select y // 8 as brow, bcol, cast(b.u as bigint) as u, cast(k as bigint) as k, round(sum(t * b.w) + 0.0000003, 5) + 0.0 as f from across join b on b.i = y % 8 where y // 8 in (select wy from whole) group by y // 8, bcol, b.u, k"""


def quant_bias(spark: SparkSession, d: str) -> DataFrame:
    q = base.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_quantity as int) - 25 as q").distinct()
    return q.selectExpr("q", f"round({_bias('q')}, 9) as v").distinct()


def _bias(q: str) -> str:
    b = colour.num(filters.QUANT_BIAS[2])
    return f"case when {q} = 0 then cast(0 as double) when {q} = 1 then {b} when {q} = -1 then -{b} else {q} - {colour.num(filters.QUANT_NUMERATOR)} / {q} end"


def adaptive_quant(spark: SparkSession, d: str) -> DataFrame:
    """Quantiser of each block from the energy of its AC coefficients."""
    coeff = filters.forward_dct(base.plane(spark, d)).where("u > 0 or k > 0")
    busy = coeff.groupBy("brow", F.col("bcol").cast("long").alias("bcol")).agg(F.sqrt(F.sum(F.pow(F.col("f") / 255, F.lit(2))) / 63).alias("act"))
    return busy.selectExpr("brow", "bcol", f"{AQ} as q")


AQ = "cast(least(greatest(round(32 * (0.5 + 0.5 / (1 + act / 0.008))), 1), 256) as bigint)"


def quality_quantiser(spark: SparkSession, d: str) -> DataFrame:
    return base.table(spark, d, "part").selectExpr("p_partkey % 101 as quality").distinct().selectExpr("quality", f"{QUALITY} as global_scale")


QUALITY = "cast(least(greatest(round(2048.0 / (0.8 * pow(cast(1.07 as double), 90 - least(100, greatest(1, quality))))), 1), 73728) as bigint)"


QUERIES = {
    **{k: _per_pixel(e) for k, e in PIXEL.items()},
    "gaborish_3x3": gaborish_3x3,
    "noise_conv_5x5": noise_conv_5x5,
    "chroma_upsample_2x": chroma_upsample_2x,
    "dc_smoothing": dc_smoothing,
    "block_mean_dc": block_mean_dc,
    "dct8_forward": dct8_forward,
    "adaptive_quant": adaptive_quant,
    "quant_bias": quant_bias,
    "quality_quantiser": quality_quantiser,
}

_G = [colour.num(x) for x in (filters.GABORISH_1, filters.GABORISH_2, 1.0 + 4.0 * (filters.GABORISH_1 + filters.GABORISH_2))]
_S = f"((ul + ur + dl + dr) * cast({W2!r} as double) + (l + rr + up + dn) * cast({W1!r} as double) + v * cast({1 - 4 * (W1 + W2)!r} as double))"
ORACLE_SQL = {
    **{k: _per_pixel_sql(e) for k, e in PIXEL.items()},
    "gaborish_3x3": f"with {base.STENCIL} select y, x, round((v + (l + rr + up + dn) * {_G[0]} + (ul + ur + dl + dr) * {_G[1]}) / {_G[2]}, 6) as v from st",
    "noise_conv_5x5": _noise_sql(),
    "chroma_upsample_2x": f"with {base.STENCIL} select y, 2 * x as x, 0.25 * cast(l as double) + 0.75 * cast(v as double) as v from st union all select y, 2 * x + 1, 0.75 * cast(v as double) + 0.25 * cast(rr as double) from st",
    "dc_smoothing": f"with {base.STENCIL}, dims as (select max(y) as h, max(x) as w from px), s as (select *, {_S} as s from st, dims) select y, x, round(case when y in (0, h) or x in (0, w) then cast(v as double) else (s - v) * greatest(0.0, 3.0 - 4.0 * greatest(0.5, abs((v - s) / 64.0))) + v end, 6) as v from s",
    "block_mean_dc": f"with {base.PX} select y // 8 as brow, x // 8 as bcol, avg(v) as mean, min(v) as low, max(v) as high, count(*) as n from px group by y // 8, x // 8",
    "dct8_forward": _dct_sql(),
    "adaptive_quant": f"with f as ({_dct_sql().replace('round(sum(t * b.w) + 0.0000003, 5) + 0.0', 'sum(t * b.w)')}), a as (select brow, bcol, sqrt(sum((f / 255) * (f / 255)) / 63) as act from f where u > 0 or k > 0 group by brow, bcol) select brow, bcol, {AQ} as q from a",
    "quant_bias": f"with q as (select distinct cast(l_quantity as int) - 25 as q from lineitem) select q, round({_bias('q')}, 9) as v from q",
    "quality_quantiser": f"with q as (select distinct p_partkey % 101 as quality from part) select quality, {QUALITY} as global_scale from q",
}
