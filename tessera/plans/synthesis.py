"""Queries of what a decoder adds or rebuilds: upsampling, block transforms, splines, noise, matrices, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrices
from ..functions.dialect import PLAIN, SPARK
from ..operators import edges, filters, synthesis
from . import base


def _transform(n: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        made = synthesis.block_transform(base.plane(spark, d), n)
        px = made.select("brow", F.col("bcol").cast("long").alias("bcol"), F.posexplode("m").alias("u", "r")).select("brow", "bcol", "u", F.posexplode("r").alias("k", "f"))
        return px.groupBy("u", "k").agg(F.round(F.avg(F.abs("f")), 4).alias("size"))

    return run


def _transform_sql(n: int) -> str:
    b = ", ".join(f"({u}, {x}, cast('{w!r}' as double))" for u, row in enumerate(filters.basis(n)) for x, w in enumerate(row))
    return f"""with {base.PX}, b as (select * from (values {b}) as t(u, x, w)), whole as (select y // {n} as brow from px group by y // {n} having count(distinct y) = {n}),
p as (select y // {n} as brow, x // {n} as bcol, y % {n} as i, x % {n} as j, v from px where y // {n} in (select brow from whole)),
a as (select brow, bcol, i, b.u as k, sum(v * w) as t from p join b on b.x = j group by brow, bcol, i, b.u),
f as (select brow, bcol, b.u as u, k, sum(t * w) as f from a join b on b.x = i group by brow, bcol, b.u, k)
select cast(u as int) as u, cast(k as int) as k, round(avg(abs(f)), 4) as size from f group by u, k"""


def inverse_transform(spark: SparkSession, d: str) -> DataFrame:
    """Blocks forward and back: samples that come out as they went in, and their sum."""
    back = synthesis.block_transform(synthesis.block_transform(base.plane(spark, d), 16), 16, inverse=True)
    px = back.select(F.explode("m").alias("r")).select(F.explode("r").alias("v"))
    return px.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("v").cast("long")).alias("total"), F.max(F.round(F.abs(F.col("v") - F.round("v")), 6)).alias("off"))


def upsample_2x(spark: SparkSession, d: str) -> DataFrame:
    grown = synthesis.upsample(base.plane(spark, d))
    px = grown.select("y", F.posexplode("row").alias("x", "v"))
    return px.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 3).alias("total"), F.round(F.max("v"), 3).alias("high"))


def _upsample_sql() -> str:
    """Every sample out from its 25 samples in, with the kernel as a table."""
    bank = synthesis.kernels(synthesis.DOUBLE, 2)
    k = ", ".join(f"({a}, {b}, {i - 2}, {j - 2}, cast('{float(bank[a, b, i, j])!r}' as double))" for a in range(2) for b in range(2) for i in range(5) for j in range(5))
    edge = lambda i, n: f"case when {i} < 0 then -({i}) - 1 when {i} >= {n} then 2 * {n} - 1 - ({i}) else {i} end"
    return f"""with {base.PX}, k as (select * from (values {k}) as t(a, b, dy, dx, w)), h as (select max(y) + 1 as h from px),
o as (select distinct dy, dx from k), near as (select c.y, c.x, dy, dx, s.v from px c cross join o cross join h join px s on s.y = {edge("c.y + dy", "h")} and s.x = {edge("c.x + dx", "64")}),
ends as (select y, x, min(v) as low, max(v) as high from near group by y, x),
made as (select n.y * 2 + a as y, n.x * 2 + b as x, least(greatest(sum(n.v * w), max(low)), max(high)) as v from near n join k using (dy, dx) join ends e on e.y = n.y and e.x = n.x group by n.y, n.x, a, b)
select y, count(*) as n, round(sum(v), 3) as total, round(max(v), 3) as high from made group by y"""


def smoothing_inverse(spark: SparkSession, d: str) -> DataFrame:
    """How far smoothing the sharpened plane is from the plane, against smoothing the plane itself."""
    given = base.plane(spark, d).withColumn("row", F.col("row").cast("array<double>"))
    before = synthesis.smoothing_residual(given, given).withColumnRenamed("residual", "before")
    after = synthesis.smoothing_residual(given, synthesis.sharpened(given))
    return before.join(after, ["img", "c"]).select((F.col("residual") < 0.25 * F.col("before")).alias("closer"))


SEGMENTS = (
    "0 as img, cast(p_partkey % 97 as double) + 0.25 as cx, cast(p_partkey % 61 as double) + 0.5 as cy, 0.5 + p_size / cast(25.0 as double) as sigma, "
    "cast(1.5 as double) as intensity, (p_partkey % 7 - 3) / cast(8.0 as double) as colour"
)


def spline_splats(spark: SparkSession, d: str) -> DataFrame:
    segments = base.table(spark, d, "part").where("p_partkey < 500").selectExpr(*SEGMENTS.split(", "))
    return synthesis.splats(segments, 64, 100).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 5).alias("v"))


def continuous_cosine(spark: SparkSession, d: str) -> DataFrame:
    part = base.table(spark, d, "part")
    coefficients = F.expr("transform(sequence(0, 31), k -> cast((p_partkey * (k + 3)) % 17 - 8 as double))")
    return part.select("p_partkey", F.round(synthesis.continuous(coefficients, (F.col("p_size") % 32).cast("double")), 6).alias("v"))


def arc_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of the customers' curves at even distance: how many, and how long the curves are."""
    points = base.table(spark, d, "customer").selectExpr("c_nationkey as curve", "c_custkey as k", "cast(c_custkey % 50 as double) as x", "c_acctbal / 100 as y")
    made = synthesis.evenly_spaced(points, 10.0).where("i > 0")
    return made.groupBy("curve").agg(F.round(F.sum("d") / 10, 3).alias("tens"), F.count(F.lit(1)).alias("n")).selectExpr("curve", "n - cast(ceil(tens - 0.001) as bigint) as off")


def xyz_white(spark: SparkSession, d: str) -> DataFrame:
    """The colour plane in XYZ under the D50 white, by matrices made from chromaticities."""
    d65, d50 = matrices.WHITES[1], (0.34567, 0.35850)
    m = matrices.product(matrices.adaptation(d65, d50), matrices.rgb_to_xyz(matrices.PRIMARIES[1], d65))
    rgb = base.rgb(spark, d)
    return rgb.agg(*(F.round(F.avg(sum((F.col(f"c{j}") / 255.0 * m[i][j] for j in range(3)), F.lit(0.0))), 2).alias(n) for i, n in enumerate("xyz")))


CONTEXT = "l_linenumber % 7 * 9 + 1 as nz, 1 + l_partkey % 63 as k, cast(l_suppkey % 2 as int) as before"


def coefficient_contexts(spark: SparkSession, d: str) -> DataFrame:
    rows = base.table(spark, d, "lineitem").selectExpr(*CONTEXT.split(", "))
    made = rows.selectExpr(f"cast({matrices.coefficient_context('nz', 'k', 1, 'before', SPARK.div, SPARK.shr)} as bigint) as ctx")
    return made.groupBy("ctx").agg(F.count(F.lit(1)).alias("n"))


DITHER = "(cast((x + 23) % 32 * 7 + (y + 13) % 32 * 11 as bigint) % 32 - 15) / cast(32.0 as double)"


def dithered_quantise(spark: SparkSession, d: str) -> DataFrame:
    """With an ordered table in the place of the format's; halves go to even."""
    return base.rgb(spark, d).select("y", "x", F.expr(f"cast(rint({matrices.dithered('(c0 / cast(255.0 as double))', DITHER)}) as int)").alias("q"))


def depth_rescale(spark: SparkSession, d: str) -> DataFrame:
    return base.rgb(spark, d).selectExpr("y", "x", "cast(round(c0 % 64 * 65535 / cast(63.0 as double)) as int) as wide", "cast(round(c1 % 16 * 255 / cast(15.0 as double)) as int) as byte")


def noise_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Random planes in tiles of 64: each sample from 1 to 2, their mean near the middle, and no two planes alike."""
    tiles = base.table(spark, d, "nation").selectExpr("n_nationkey as img", "n_nationkey as visible", "1 as invisible", "0 as x0", "0 as y0", "64 as height", "64 as width")
    px = synthesis.noise_planes(tiles).select("img", "c", F.explode("row").alias("v"))
    by = px.groupBy("img", "c").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"))
    return by.select("img", "c", "n", ((F.col("low") >= 1) & (F.col("high") < 2) & (F.abs(F.col("mean") - 1.5) < 0.03)).alias("fair"))


BLOCKS = "l_orderkey as o, l_linenumber as i, cast(1 + l_partkey % 256 as int) as quant, cast(l_suppkey % 8 as int) as sharp"


def block_sigma(spark: SparkSession, d: str) -> DataFrame:
    rows = base.table(spark, d, "lineitem").selectExpr(*BLOCKS.split(", ")).selectExpr("sharp", f"{edges.inverse_sigma('quant', 'sharp', 'cast(0.0009765625 as double)')} as s")
    return rows.groupBy("sharp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 4).alias("s"))


def edge_filter(spark: SparkSession, d: str) -> DataFrame:
    """All three passes over images of 96 rows and three channels: rows, and that no sample leaves the range of its image."""
    rows = base.plane(spark, d).selectExpr("y div 288 as img", "cast(y % 3 as int) as c", "y div 3 % 96 as y", "transform(row, v -> v / 2550d) as row")
    whole = rows.groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.min(F.array_min("row")).alias("low"), F.max(F.array_max("row")).alias("high")).where("n % 3 = 0")
    made = edges.restore(rows.join(whole, "img", "left_semi"), 3, -0.5).join(whole, "img")
    inside = F.forall("row", lambda v: (v >= F.col("low") - 1e-9) & (v <= F.col("high") + 1e-9))
    return made.groupBy("img", "c").agg(F.count(F.lit(1)).alias("n"), F.min(inside).alias("inside"))


QUERIES = {
    "block_sigma": block_sigma,
    "edge_filter": edge_filter,
    "dct16_forward": _transform(16),
    "dct32_forward": _transform(32),
    "inverse_transform": inverse_transform,
    "upsample_2x": upsample_2x,
    "smoothing_inverse": smoothing_inverse,
    "spline_splats": spline_splats,
    "continuous_cosine": continuous_cosine,
    "arc_points": arc_points,
    "xyz_white": xyz_white,
    "coefficient_contexts": coefficient_contexts,
    "dithered_quantise": dithered_quantise,
    "depth_rescale": depth_rescale,
    "noise_statistics": noise_statistics,
}

#: Linear sRGB to XYZ under D50, as it is published (to seven digits), for a check that doesn't use the code above.
_D50 = ((0.4360747, 0.3850649, 0.1430804), (0.2225045, 0.7168786, 0.0606169), (0.0139322, 0.0971045, 0.7141733))
_SUMS = ", ".join(f"round(avg(c0 / 255.0 * {a} + c1 / 255.0 * {b} + c2 / 255.0 * {c}), 2) as {n}" for n, (a, b, c) in zip("xyz", _D50, strict=True))
ORACLE_SQL = {
    "block_sigma": f"with b as (select {BLOCKS} from lineitem), s as (select sharp, {edges.inverse_sigma('quant', 'sharp', 'cast(0.0009765625 as double)')} as s from b) select sharp, count(*) as n, round(avg(s), 4) as s from s group by sharp",
    "edge_filter": "with r as (select vec_id // 288 as img, vec_id % 3 as c from embeddings), w as (select img from r group by img having count(*) % 3 = 0) select img, cast(c as int) as c, count(*) as n, true as inside from r join w using (img) group by img, c",
    "dct16_forward": _transform_sql(16),
    "dct32_forward": _transform_sql(32),
    "inverse_transform": f"with {base.PX}, w as (select y // 16 as b from px group by y // 16 having count(distinct y) = 16) select count(*) as n, cast(sum(v) as bigint) as total, cast(0 as double) as off from px where y // 16 in (select b from w)",
    "upsample_2x": _upsample_sql(),
    "smoothing_inverse": "select true as closer",
    "spline_splats": f"""with s as (select {SEGMENTS} from part where p_partkey < 500), n as (select *, {synthesis.SPLAT["reach"]} as reach from s), px as (select * from (select unnest(range(64)) as y) cross join (select unnest(range(100)) as x)),
m as (select p.y, p.x, n.*, sqrt((p.x - cx) * (p.x - cx) + (p.y - cy) * (p.y - cy)) as r from n join px p on p.y between round(cy - reach) and round(cy + reach) and p.x between round(cx - reach) and round(cx + reach)),
e as (select *, {synthesis.SPLAT["share"]} as share from m), v as (select y, x, sum(colour * 0.25 * sigma * intensity * share * share) as v from e group by y, x) select cast(y as int) as y, count(*) as n, round(sum(v), 5) as v from v group by y""",
    "continuous_cosine": "with c as (select p_partkey, p_size % 32 as t, unnest(range(32)) as k from part) select p_partkey, round(sum(((p_partkey * (k + 3)) % 17 - 8) * cos(k * pi() / 32 * (t + 0.5)) * sqrt(2.0::double)), 6) as v from c group by p_partkey",
    "arc_points": "select c_nationkey as curve, cast(0 as bigint) as off from customer group by c_nationkey having count(*) > 1",
    "xyz_white": f"with {base.RGB} select {_SUMS} from rgb",
    "coefficient_contexts": f"with r as (select {CONTEXT} from lineitem), c as (select cast({matrices.coefficient_context('nz', 'k', 1, 'before', PLAIN.div, PLAIN.shr)} as bigint) as ctx from r) select ctx, count(*) as n from c group by ctx",
    "dithered_quantise": f"with {base.RGB} select y, x, cast(round_even({matrices.dithered('(c0 / cast(255.0 as double))', DITHER)}, 0) as int) as q from rgb",
    "depth_rescale": f"with {base.RGB} select y, x, cast(round(c0 % 64 * 65535 / cast(63.0 as double)) as int) as wide, cast(round(c1 % 16 * 255 / cast(15.0 as double)) as int) as byte from rgb",
    "noise_statistics": "select n_nationkey as img, cast(c as int) as c, cast(4096 as bigint) as n, true as fair from nation cross join (select unnest(range(3)) as c)",
}
