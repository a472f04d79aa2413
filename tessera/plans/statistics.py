"""Queries of the encoder's statistics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import PLAIN, SPARK
from ..operators import lossless, statistics
from . import base


def psnr(spark: SparkSession, d: str) -> DataFrame:
    rgb = base.rgb(spark, d)
    return statistics.distortion(rgb.select("img", "y", "x", F.col("c0").alias("v")), rgb.select("img", "y", "x", F.col("c1").alias("v"))).drop("img")


POINTS = "o_orderpriority as img, 1 + o_custkey * 37 % 4001 as size, cast(round(o_totalprice) as bigint) % 1000 / cast(10.0 as double) as quality"


def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    return statistics.frontier(base.table(spark, d, "orders").selectExpr(*POINTS.split(", ")))


CURVE = "p_brand as img, cast(20 + p_partkey % 40 as double) as q, {0} as r"
OURS, THEIRS = "10 + (p_partkey % 40) * cast(0.11 as double)", "cast(10.3 as double) + (p_partkey % 40) * cast(0.1 as double) + (p_partkey % 3) * cast(0.05 as double)"


def bd_rate(spark: SparkSession, d: str) -> DataFrame:
    part = base.table(spark, d, "part")
    curve = lambda r: part.selectExpr(*CURVE.format(r).split(", ")).groupBy("img", "q").agg(F.avg("r").alias("r"))
    return statistics.rate_difference(curve(OURS), curve(THEIRS))


def canonical_codes(spark: SparkSession, d: str) -> DataFrame:
    """Code lengths that fit: symbol k of a book has length k + 1, the last two share one."""
    books = base.table(spark, d, "nation").selectExpr("n_nationkey as book", "explode(sequence(0, 3 + n_nationkey % 9)) as sym").selectExpr("book", "sym", "least(sym + 1, 3 + book % 9) as len")
    return statistics.canonical_codes(books).select("book", "sym", "len", "code")


def ans_normalised(spark: SparkSession, d: str) -> DataFrame:
    hist = base.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("book"), F.col("l_quantity").cast("int").alias("sym")).agg(F.count(F.lit(1)).alias("n"))
    return statistics.normalised_counts(hist).select("book", "sym", "n", "c")


def stat_bins(spark: SparkSession, d: str) -> DataFrame:
    cents = base.table(spark, d, "lineitem").selectExpr("cast(round(l_extendedprice * 100) as bigint) % 100003 as u")
    return cents.select(F.expr(statistics.value_bin("u", SPARK.floor_log2("u"), SPARK.shr)).cast("long").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def leaf_gcd(spark: SparkSession, d: str) -> DataFrame:
    lines = base.table(spark, d, "lineitem").selectExpr("cast(l_quantity as int) as leaf", "(l_partkey % 50 + 1) * (l_linenumber * 6) as res")
    return statistics.gcd(lines, ["leaf"], "res")


def byte_contexts(spark: SparkSession, d: str) -> DataFrame:
    docs = base.table(spark, d, "benchmark").selectExpr("item_id as doc_id", "text")
    bytes_ = statistics.text_bytes(docs)
    order = "over (partition by doc_id order by i)"
    near = bytes_.selectExpr("i", f"coalesce(lag(b) {order}, 0) as b1", f"coalesce(lag(b, 2) {order}, 0) as b2")
    return near.selectExpr(f"{statistics.byte_context('i', 'b1', 'b2')} as ctx").groupBy("ctx").agg(F.count(F.lit(1)).alias("n"))


def byte_shuffle(spark: SparkSession, d: str) -> DataFrame:
    docs = base.table(spark, d, "benchmark").selectExpr("item_id as doc_id", "text")
    return statistics.transposed(statistics.text_bytes(docs), 4).select("doc_id", F.col("j").cast("long").alias("j"), "b")


BYTES = "raw as (select item_id as doc_id, hex(encode(text)) as h from benchmark), bytes as (select doc_id, i, cast(('0x' || substr(h, cast(2 * i + 1 as int), 2)) as int) as b, length(h) // 2 as size from (select doc_id, h, unnest(range(length(h) // 2)) as i from raw))"


def plane_statistics(spark: SparkSession, d: str) -> DataFrame:
    px = base.pixels(base.plane(spark, d))
    return px.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg("v"), 6).alias("mean"), F.count("v").alias("n"), F.count_distinct("v").cast("long").alias("levels"))


TILE = "y // 8 as ty, x // 8 as tx, c0 / cast(255.0 as double) as s, c1 / cast(255.0 as double) as t"
SCALE = 1 / 84.0
FIT = f"cast(least(greatest(round((case when syy > 1e-9 then sty / syy else cast(0 as double) end) / cast({SCALE!r} as double)), -128), 127) as bigint)"
WINS = f"case when syy > 1e-9 and -2 * (fit * cast({SCALE!r} as double)) * sty + (fit * cast({SCALE!r} as double)) * (fit * cast({SCALE!r} as double)) * syy < 0 then fit else 0 end"


def cfl_slope_fit(spark: SparkSession, d: str) -> DataFrame:
    """Slope of chroma on luma for each tile in steps, kept only where it lowers the residual energy."""
    tiles = base.rgb(spark, d).selectExpr(*TILE.replace("//", "div").split(", "))
    sums = tiles.groupBy("ty", "tx").agg(F.sum(F.col("s") * F.col("t")).alias("sty"), F.sum(F.col("s") * F.col("s")).alias("syy"))
    return sums.withColumn("fit", F.expr(FIT)).selectExpr("ty", "tx", f"{WINS} as slope")


def cell_quant(spark: SparkSession, d: str) -> DataFrame:
    """Rounded mean of the quantisers that a 2 x 2 cell covers, within 1 to 256."""
    q = base.rgb(spark, d)
    return q.groupBy(F.expr("y div 2").alias("cy"), F.expr("x div 2").alias("cx")).agg(F.expr("least(256, greatest(1, (sum(c0) + count(*) div 2) div count(*)))").alias("q"))


def split_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Evenly ranked values of the residuals, without repeats and without the greatest."""
    res = lossless.residuals(base.plane(spark, d)).select("res")
    counted = res.groupBy("res").agg(F.count(F.lit(1)).alias("n"))  # as many rows as there are residual values
    ends = counted.selectExpr("res", "n", "sum(n) over (order by res) as upto", "sum(n) over () as total", "max(res) over () as top")
    hit = ends.select("res", "top", F.explode(F.expr("filter(transform(sequence(1, 15), q -> total * q div 16), r -> r >= upto - n and r < upto)")).alias("r"))
    return hit.where("res < top").select(F.col("res").alias("boundary")).distinct()


QUERIES = {
    "psnr": psnr,
    "pareto_frontier": pareto_frontier,
    "bd_rate": bd_rate,
    "canonical_codes": canonical_codes,
    "ans_normalised": ans_normalised,
    "stat_bins": stat_bins,
    "leaf_gcd": leaf_gcd,
    "byte_contexts": byte_contexts,
    "byte_shuffle": byte_shuffle,
    "plane_statistics": plane_statistics,
    "cfl_slope_fit": cfl_slope_fit,
    "cell_quant": cell_quant,
    "split_boundaries": split_boundaries,
}

_D = "(c0 / cast(255.0 as double) - c1 / cast(255.0 as double))"
_PRED = "with " + base.CAUSAL


def _curve(r: str, name: str) -> str:
    return f"{name} as (select img, q, avg(r) as r from (select {CURVE.format(r)} from part) group by img, q), {name}p as (select * from (select img, q as q0, r as r0, lead(q) over (partition by img order by q) as q1, lead(r) over (partition by img order by q) as r1 from {name}) where q1 is not null)"


ORACLE_SQL = {
    "psnr": f"with {base.RGB}, d as (select {_D} as d from rgb) select count(*) as n, round(sum(d * d), 6) as sse, round(-10 * log10(avg(d * d)), 6) as psnr, round(sqrt(avg(d * d)), 6) as rms, round(max(abs(d)), 6) as peak from d",
    "pareto_frontier": f"with p as (select {POINTS} from orders), b as (select img, size, max(quality) as quality from p group by img, size) select * from b where not exists (select 1 from b o where o.img = b.img and o.size < b.size and o.quality >= b.quality)",
    "bd_rate": f"""with {_curve(OURS, "a")}, {_curve(THEIRS, "b")}, span as (select a.img, greatest(min(a.q), min(b.q)) as lo, least(max(a.q), max(b.q)) as hi from a join b using (img) group by a.img having count(distinct a.q) > 1 and count(distinct b.q) > 1),
grid as (select img, lo, hi, i, lo + i * (hi - lo) / 200 as q from span, (select unnest(range(201)) as i) where hi > lo),
ra as (select grid.img, i, min(r0 + (grid.q - q0) / (q1 - q0) * (r1 - r0)) as r from grid join ap on ap.img = grid.img and grid.q between q0 and q1 group by grid.img, i),
rb as (select grid.img, i, min(r0 + (grid.q - q0) / (q1 - q0) * (r1 - r0)) as r from grid join bp on bp.img = grid.img and grid.q between q0 and q1 group by grid.img, i)
select ra.img, round((pow(2.0, sum(case when ra.i in (0, 200) then 0.5 else 1.0 end * (ra.r - rb.r)) / 200) - 1) * 100, 4) as percent from ra join rb on ra.img = rb.img and ra.i = rb.i group by ra.img""",
    "canonical_codes": "with b as (select n_nationkey as book, unnest(range(4 + n_nationkey % 9)) as sym from nation), l as (select book, cast(sym as int) as sym, cast(least(sym + 1, 3 + book % 9) as int) as len from b) select book, sym, len, cast(coalesce(sum(cast(1 as bigint) << (32 - len)) over (partition by book order by len, sym rows between unbounded preceding and 1 preceding), 0) as bigint) >> (32 - len) as code from l",
    "ans_normalised": "with h as (select l_returnflag as book, cast(l_quantity as int) as sym, count(*) as n from lineitem group by 1, 2), s as (select *, cast(greatest(1, round(n * 4096.0 / sum(n) over (partition by book))) as bigint) as c, row_number() over (partition by book order by n desc, sym) as r from h), t as (select *, 4096 - sum(c) over (partition by book) as rest from s) select book, sym, n, cast(greatest(1, c + case when r = 1 then rest else 0 end) as bigint) as c from t",
    "stat_bins": f"with u as (select cast(round(l_extendedprice * 100) as bigint) % 100003 as u from lineitem) select cast({statistics.value_bin('u', PLAIN.floor_log2('u'), PLAIN.shr)} as bigint) as bin, count(*) as n from u group by 1",
    "leaf_gcd": "with recursive v as (select distinct cast(l_quantity as int) as leaf, abs((l_partkey % 50 + 1) * (l_linenumber * 6)) as a from lineitem), k as (select leaf, a, row_number() over (partition by leaf order by a) as r from v), g as (select leaf, r, a as gcd from k where r = 1 union all select k.leaf, k.r, gcd(g.gcd, k.a) from g join k on k.leaf = g.leaf and k.r = g.r + 1) select leaf, cast(min(gcd) as bigint) as gcd from g where gcd > 0 group by leaf",
    "byte_contexts": f"with {BYTES}, near as (select i, coalesce(lag(b) over (partition by doc_id order by i), 0) as b1, coalesce(lag(b, 2) over (partition by doc_id order by i), 0) as b2 from bytes) select {statistics.byte_context('i', 'b1', 'b2')} as ctx, count(*) as n from near group by 1",
    "byte_shuffle": f"with {BYTES}, g as (select *, (size + 3) // 4 as high from bytes) select doc_id, row_number() over (partition by doc_id order by i % high, i // high) - 1 as j, b from g",
    "plane_statistics": f"with {base.PX} select min(v) as low, max(v) as high, round(avg(v), 6) as mean, count(v) as n, count(distinct v) as levels from px",
    "cfl_slope_fit": f"with {base.RGB}, t as (select {TILE} from rgb), s as (select ty, tx, sum(s * t) as sty, sum(s * s) as syy from t group by ty, tx), f as (select *, {FIT} as fit from s) select ty, tx, {WINS} as slope from f",
    "cell_quant": f"with {base.RGB} select y // 2 as cy, x // 2 as cx, cast(least(256, greatest(1, (sum(c0) + count(*) // 2) // count(*))) as bigint) as q from rgb group by y // 2, x // 2",
    "split_boundaries": f"{_PRED}, res as (select v - ({lossless.integer.predictors(PLAIN)[5]}) as res from causal), k as (select res, row_number() over (order by res) - 1 as r, count(*) over () as total, max(res) over () as top from res) select distinct res as boundary from k join (select unnest(range(1, 16)) as q) on r = total * q // 16 where res < top",
}
