"""Queries of rate-distortion choices, contexts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, lossless, rate, statistics
from . import base, colour
from . import lossless as lossless_plans
from .colour import LONGX
from .statistics import BYTES, POINTS

COEFF = "cast(l_quantity - 25 as double) * 0.37e0 as c, cast(0.8 as double) as step, cast(round((l_quantity - 25) * 0.37e0 / 0.8e0) as int) as q"
CHOICE = rate.dead_zone("c", "step", "q", 0.12, 2.5)


def rd_quantise(spark: SparkSession, d: str) -> DataFrame:
    c = base.table(spark, d, "lineitem").selectExpr(*COEFF.split(", ")).distinct()
    return c.selectExpr("q", f"cast({CHOICE} as int) as chosen").distinct()


def edge_preserving(spark: SparkSession, d: str) -> DataFrame:
    return rate.edge_preserving(base.plane(spark, d), -0.05).select("y", F.expr(LONGX), F.round("v", 6).alias("v"))


def nonzero_prediction(spark: SparkSession, d: str) -> DataFrame:
    coeff = filters.forward_dct(base.plane(spark, d))
    counted = coeff.groupBy("img", "c", "brow", F.col("bcol").cast("long").alias("bcol")).agg(F.sum((F.abs("f") > 4.00001).cast("long")).alias("nz"))
    return rate.expected_nonzeros(counted).select("brow", "bcol", "nz", "pred")


def coefficient_scan(spark: SparkSession, d: str) -> DataFrame:
    """Mean size of the coefficients in scan order."""
    order = spark.createDataFrame([(u, k, i) for i, (u, k) in enumerate(rate.natural_order())], "u int, k int, place int")
    met = filters.forward_dct(base.plane(spark, d)).join(F.broadcast(order), ["u", "k"])  # 64 rows
    return met.groupBy("place").agg(F.round(F.avg(F.abs("f")), 5).alias("size"), F.count(F.lit(1)).alias("n"))


def nearest_repeats(spark: SparkSession, d: str) -> DataFrame:
    bytes_ = statistics.text_bytes(base.table(spark, d, "benchmark").selectExpr("item_id as doc_id", "text"))
    return rate.nearest_repeat(bytes_).select("doc_id", F.col("i").cast("long").alias("i"), F.col("dist").cast("long").alias("dist"))


def byte_prediction(spark: SparkSession, d: str) -> DataFrame:
    """Bytes that each order of prediction at stride 2 gets right."""
    bytes_ = statistics.text_bytes(base.table(spark, d, "benchmark").selectExpr("item_id as doc_id", "text"))
    near = bytes_.selectExpr("b", *(f"lag(b, {2 * k}) over (partition by doc_id order by i) as p{k}" for k in (1, 2, 3))).where("p3 is not null")
    return near.selectExpr("count(*) as n", *(f"sum(cast(b = {rate.linear_prediction('p1', 'p2', 'p3', k)} as bigint)) as right_{k}" for k in range(3)))


def equal_size_delta(spark: SparkSession, d: str) -> DataFrame:
    points = base.table(spark, d, "orders").selectExpr(*POINTS.split(", "), "o_orderstatus = 'F' as ours")
    ours = points.where("ours").drop("ours").distinct()
    made = rate.equal_size_difference(ours, statistics.frontier(points.where("not ours")))
    return made.select("img", "size", "quality", F.round("delta", 6).alias("delta"))


def class_medians(spark: SparkSession, d: str) -> DataFrame:
    return base.table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.median("o_totalprice"), 4).alias("median"), F.count(F.lit(1)).alias("n"))


def cluster_costs(spark: SparkSession, d: str) -> DataFrame:
    """Bits of each return flag's quantities under the distribution of all, and under its own."""
    lines = base.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("ctx"), F.col("l_quantity").cast("int").alias("sym"))
    own = lines.groupBy("ctx", "sym").agg(F.count(F.lit(1)).alias("n"))
    every = own.groupBy("sym").agg(F.sum("n").alias("m"))
    total = own.agg(F.sum("n").alias("mm"))  # one row
    met = own.join(every, "sym").crossJoin(F.broadcast(total))
    cross = F.sum(F.col("n") * F.log2(F.col("mm") / F.col("m")))
    return met.groupBy("ctx").agg(F.round(cross, 3).alias("shared_bits"), F.round(F.sum("n") * F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))), 3).alias("own_bits"))


def frame_score(spark: SparkSession, d: str) -> DataFrame:
    """Squared error and coded bits of the three RCT-coded planes together: sse + lambda * step^2 * bytes."""
    bits = lossless.entropy(lossless.token_histogram(lossless.tokens(lossless.residuals(base.plane(spark, d)), "res")))
    rgb = base.rgb(spark, d)
    sse = statistics.distortion(rgb.select("img", "y", "x", F.col("c0").alias("v")), rgb.select("img", "y", "x", F.col("c2").alias("v"))).select("sse")
    met = sse.crossJoin(F.broadcast(bits))  # one row each
    return met.select(F.round(F.col("sse") + 0.1 * 0.25 * (F.col("entropy_bits") + F.col("extra_bits")) / 8, 4).alias("score"))


QUERIES = {
    "rd_quantise": rd_quantise,
    "edge_preserving": edge_preserving,
    "nonzero_prediction": nonzero_prediction,
    "coefficient_scan": coefficient_scan,
    "nearest_repeats": nearest_repeats,
    "byte_prediction": byte_prediction,
    "equal_size_delta": equal_size_delta,
    "class_medians": class_medians,
    "cluster_costs": cluster_costs,
    "frame_score": frame_score,
}

_DCT = colour._dct_sql().replace("round(sum(t * b.w) + 0.0000003, 5) + 0.0", "sum(t * b.w)")
_W = "greatest(0.0, 1 + abs({0} - v) * s)"
_TAPS = ["up", "l", "rr", "dn"]
_ORDER = ", ".join(f"({u}, {k}, {i})" for i, (u, k) in enumerate(rate.natural_order()))
_FRONT = "b as (select img, size, max(quality) as quality from p where not ours group by img, size), front as (select * from b where not exists (select 1 from b o where o.img = b.img and o.size < b.size and o.quality >= b.quality))"
ORACLE_SQL = {
    "rd_quantise": f"with c as (select distinct {COEFF} from lineitem) select distinct q, cast({CHOICE} as int) as chosen from c",
    "edge_preserving": f"with {base.STENCIL}, s as (select *, cast(-0.05 as double) * case when x % 8 in (0, 7) or y % 8 in (0, 7) then cast({2.0 / 3.0!r} as double) else cast(1 as double) end as s from st) select y, x, round((v + {' + '.join(_W.format(t) + ' * ' + t for t in _TAPS)}) / (1 + {' + '.join(_W.format(t) for t in _TAPS)}), 6) as v from s",
    "nonzero_prediction": f"with f as ({_DCT}), nz as (select brow, bcol, cast(sum(case when abs(f) > 4.00001 then 1 else 0 end) as bigint) as nz from f group by brow, bcol), n as (select *, lag(nz) over (partition by brow order by bcol) as l, lag(nz) over (partition by bcol order by brow) as t from nz) select brow, bcol, nz, coalesce((l + t + 1) // 2, l, t, 32) as pred from n",
    "coefficient_scan": f"with f as ({_DCT}), o as (select * from (values {_ORDER}) t(u, k, place)) select place, round(avg(abs(f)), 5) as size, count(*) as n from f join o on f.u = o.u and f.k = o.k group by place",
    "nearest_repeats": f"with {BYTES}, g as (select doc_id, i, b, lead(b) over w as g1, lead(b, 2) over w as g2, lead(b, 3) over w as g3 from bytes window w as (partition by doc_id order by i)) select doc_id, i, i - lag(i) over (partition by doc_id, b, g1, g2, g3 order by i) as dist from g where g3 is not null",
    "byte_prediction": f"with {BYTES}, n as (select b, lag(b, 2) over w as p1, lag(b, 4) over w as p2, lag(b, 6) over w as p3 from bytes window w as (partition by doc_id order by i)) select count(*) as n, " + ", ".join(f"cast(sum(case when b = {rate.linear_prediction('p1', 'p2', 'p3', k)} then 1 else 0 end) as bigint) as right_{k}" for k in range(3)) + " from n where p3 is not null",
    "equal_size_delta": f"""with p as (select {POINTS}, o_orderstatus = 'F' as ours from orders), ours as (select distinct img, size, quality from p where ours), {_FRONT},
piece as (select img, log2(cast(size as double)) as x0, quality as y0, lead(log2(cast(size as double))) over (partition by img order by size) as x1, lead(quality) over (partition by img order by size) as y1 from front)
select o.img, o.size, o.quality, round(o.quality - min(y0 + (log2(cast(o.size as double)) - x0) / (x1 - x0) * (y1 - y0)), 6) as delta from ours o left join piece on piece.img = o.img and x1 is not null and log2(cast(o.size as double)) between x0 and x1 group by o.img, o.size, o.quality""",
    "class_medians": "select o_orderpriority, round(median(o_totalprice), 4) as median, count(*) as n from orders group by o_orderpriority",
    "cluster_costs": "with own as (select l_returnflag as ctx, cast(l_quantity as int) as sym, count(*) as n from lineitem group by 1, 2), every as (select sym, sum(n) as m from own group by sym), t as (select sum(n) as mm from own) select ctx, round(sum(n * log2(cast(mm as double) / cast(m as double))), 3) as shared_bits, round(sum(n) * log2(cast(sum(n) as double)) - sum(n * log2(cast(n as double))), 3) as own_bits from own join every using (sym), t group by ctx",
    "frame_score": f"with e as ({lossless_plans.ORACLE_SQL['token_entropy']}), r as (with {base.RGB} select round(sum((c0 - c2) / cast(255.0 as double) * ((c0 - c2) / cast(255.0 as double))), 6) as sse from rgb) select round(sse + cast(0.1 as double) * 0.25 * (entropy_bits + extra_bits) / 8, 4) as score from e, r",
}
