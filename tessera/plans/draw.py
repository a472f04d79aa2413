"""Queries of curves, patch modes, header arithmetic and round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import PLAIN, SPARK
from ..operators import codec, draw, lossless
from . import base
from .compose import CANVAS, OVER

LUT = [0.0, 0.05, 0.11, 0.2, 0.34, 0.5, 0.7, 0.95]
POINT = "c_nationkey as curve, c_custkey as k, cast(c_custkey as double) as x, c_acctbal / 100 as y"


def catmull_rom(spark: SparkSession, d: str) -> DataFrame:
    points = base.table(spark, d, "customer").selectExpr(*POINT.split(", "))
    made = draw.smooth_curve(points)
    return made.select("curve", "k", F.col("i").cast("long").alias("i"), F.round("px", 5).alias("px"), F.round("py", 5).alias("py"))


SEGMENT = "p_partkey as id, p_retailprice * 13 % 300 as cy, 1 + p_size / cast(8.0 as double) as radius"


def segment_rows(spark: SparkSession, d: str) -> DataFrame:
    covered = draw.rows_covered(base.table(spark, d, "part").selectExpr(*SEGMENT.split(", ")), 256)
    return covered.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def _patch(mode: str):
    return lambda spark, d: base.rgb(spark, d).selectExpr("y", "x", *CANVAS.split(", "), *OVER.split(", ")).selectExpr("y", "x", f"round({draw.PATCH[mode]}, 6) as v")


def size_from_ratio(spark: SparkSession, d: str) -> DataFrame:
    sizes = base.table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey % 7 + 1 as ratio", "cast(o_totalprice as bigint) % 4096 + 1 as height")
    return sizes.selectExpr("o_orderkey", "ratio", "height", f"{draw.width_of('ratio', 'height', SPARK.div)} as width")


def noise_strength(spark: SparkSession, d: str) -> DataFrame:
    return base.rgb(spark, d).selectExpr("y", "x", "(c0 + c1) / cast(400.0 as double) as v").selectExpr("y", "x", f"round({draw.strength(LUT, 'v')}, 6) as s")


def unsqueeze(spark: SparkSession, d: str) -> DataFrame:
    """The plane after a squeeze and back, sample by sample."""
    rows = draw.unsqueeze_rows(lossless.squeeze_rows(base.plane(spark, d)))
    return rows.select("y", F.posexplode("row").alias("x", "v")).select("y", F.col("x").cast("long").alias("x"), "v")


def codec_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Strips of 64 rows coded to bytes and decoded, sample by sample."""
    strips = base.plane(spark, d).selectExpr("y div 64 as img", "c", "y % 64 as y", "row")
    rows = codec.decode(codec.encode(strips))
    return rows.select((F.col("img") * 64 + F.col("y")).alias("y"), F.posexplode("row").alias("x", "v")).select("y", F.col("x").cast("long").alias("x"), "v")


QUERIES = {
    "catmull_rom": catmull_rom,
    "segment_rows": segment_rows,
    **{f"patch_{m}": _patch(m) for m in draw.PATCH},
    "size_from_ratio": size_from_ratio,
    "noise_strength": noise_strength,
    "unsqueeze": unsqueeze,
    "codec_round_trip": codec_round_trip,
}

_KNOT = ", ".join(f"{v} as {k}" for k, v in draw.knots().items())
_ENDS = ", ".join(f"coalesce({a}0, 2 * {a}1 - {a}2) as {a}0, {a}1, {a}2, coalesce({a}3, 2 * {a}2 - {a}1) as {a}3" for a in "xy")
_NEAR = ", ".join(f"lag({a}) over o as {a}0, {a} as {a}1, lead({a}) over o as {a}2, lead({a}, 2) over o as {a}3" for a in "xy")
ORACLE_SQL = {
    "catmull_rom": f"with p as (select {POINT} from customer), n as (select curve, k, {_NEAR} from p window o as (partition by curve order by k)), e as (select curve, k, {_ENDS} from n where x2 is not null), t as (select *, {_KNOT} from e) select curve, k, i, round({draw.curve_point('i', 'x')}, 5) as px, round({draw.curve_point('i', 'y')}, 5) as py from t, (select unnest(range({draw.STEPS})) as i)",
    "segment_rows": f"with s as (select {SEGMENT} from part) select y, count(*) as n, cast(sum(id) as bigint) as ids from s join (select unnest(range(256)) as y) on y >= cy - radius and y <= cy + radius group by y",
    **{f"patch_{m}": f"with {base.RGB}, s as (select y, x, {CANVAS}, {OVER} from rgb) select y, x, round({e}, 6) as v from s" for m, e in draw.PATCH.items()},
    "size_from_ratio": f"with s as (select o_orderkey, o_custkey % 7 + 1 as ratio, cast(floor(o_totalprice) as bigint) % 4096 + 1 as height from orders) select *, {draw.width_of('ratio', 'height', PLAIN.div)} as width from s",
    "noise_strength": f"with {base.RGB}, s as (select y, x, (c0 + c1) / cast(400.0 as double) as v from rgb) select y, x, round({draw.strength(LUT, 'v')}, 6) as s from s",
    "unsqueeze": f"with {base.PX} select y, x, cast(v as bigint) as v from px",
    "codec_round_trip": f"with {base.PX} select y, x, v from px",
}
