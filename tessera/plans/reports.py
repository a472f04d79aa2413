"""Queries of encoder choices and reports: configurations, transforms, trees, rate comparisons, timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import integer
from ..functions.dialect import PLAIN
from ..operators import lossless, statistics, trees
from . import base
from . import rate as rate_plans
from . import statistics as statistics_plans

LOW, HIGH = 30.0, 48.0


def bd_rate_clipped(spark: SparkSession, d: str) -> DataFrame:
    part = base.table(spark, d, "part")
    curve = lambda r: part.selectExpr(*statistics_plans.CURVE.format(r).split(", ")).groupBy("img", "q").agg(F.avg("r").alias("r"))
    return statistics.rate_difference(curve(statistics_plans.OURS), curve(statistics_plans.THEIRS), low=LOW, high=HIGH)


def equal_quality_ratio(spark: SparkSession, d: str) -> DataFrame:
    points = base.table(spark, d, "orders").selectExpr(*statistics_plans.POINTS.split(", "), "o_orderstatus = 'F' as ours")
    made = statistics.quality_ratio(points.where("ours").drop("ours").distinct(), statistics.frontier(points.where("not ours")))
    return made.select("img", "size", "quality", F.round("ratio", 6).alias("ratio"))


def timing_report(spark: SparkSession, d: str) -> DataFrame:
    runs = base.table(spark, d, "events").selectExpr("event_type as name", "0.001 + value / cast(100.0 as double) as seconds", "cast(6000000 as bigint) as pixels")
    made = statistics.timing_report(runs)
    return made.select("name", "runs", *(F.round(c, 6).alias(c) for c in ("best", "mean", "mp_s")))


def block_report(spark: SparkSession, d: str) -> DataFrame:
    blocks = base.table(spark, d, "lineitem").selectExpr("cast(l_partkey % 27 as int) as strategy", "cast(l_quantity as int) as quant")
    return statistics.block_report(blocks).select("strategy", "n", "low", "high", F.round("share", 6).alias("share"))


def coefficient_report(spark: SparkSession, d: str) -> DataFrame:
    rows = base.table(spark, d, "lineitem").selectExpr("cast(l_partkey % 5 as int) as strategy", "cast(l_suppkey % 64 as int) as k", "cast(l_quantity as int) % 5 - 2 as v")
    return statistics.coefficient_report(rows).select("strategy", "k", "n", "nonzero", F.round("size", 6).alias("size"))


CENTS = "l_returnflag as ctx, cast(round(l_extendedprice) as bigint) % 4001 as u"
TRIED = ((4, 2, 0), (4, 1, 0), (5, 1, 1), (0, 0, 0), (7, 0, 0))


def configuration_search(spark: SparkSession, d: str) -> DataFrame:
    values = base.table(spark, d, "lineitem").selectExpr(*CENTS.split(", "))
    return lossless.best_configuration(values, "ctx", "u", TRIED).select("ctx", "split", "msb", "lsb", "cost")


def context_bits(spark: SparkSession, d: str) -> DataFrame:
    values = base.table(spark, d, "lineitem").selectExpr("l_returnflag as ctx", "cast(l_partkey % 301 as bigint) - 150 as s")
    return lossless.context_bits(lossless.tokens(values, "s"), "ctx")


def leaf_division(spark: SparkSession, d: str) -> DataFrame:
    lines = base.table(spark, d, "lineitem").selectExpr("cast(l_quantity as int) as leaf", "(l_partkey % 50 + 1) * (l_linenumber * 6) as res")
    by = statistics.gcd(lines, ["leaf"], "res").withColumnRenamed("gcd", "g")
    return lossless.divided(lines, "leaf", "res", by).groupBy("leaf").agg(F.sum("res").cast("long").alias("total"))


def band_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the bands with about 4096 samples of the plane."""
    return lossless.bands(base.plane(spark, d), target=4096).select("y").distinct()


def transform_choice(spark: SparkSession, d: str) -> DataFrame:
    """The colour transform of images of 96 rows, three channels each, with its cost."""
    rows = base.plane(spark, d).selectExpr("y div 288 as img", "cast(y % 3 as int) as c", "y div 3 % 96 as y", "row")
    return lossless.best_transform(rows).select("img", "type", F.round("cost", 2).alias("cost"))


def _choice_sql() -> str:
    kinds = {kind: integer.rct_forward(PLAIN, kind) for kind in range(42)}
    different = sorted({e for made in kinds.values() for e in made})
    named = ", ".join(f"{e} as p{no}" for no, e in enumerate(different))
    made = " union all ".join(f"select img, y, x, {no} as plane, p{no} as v from t" for no in range(len(different)))
    uses = ", ".join(f"({kind}, {different.index(e)})" for kind, planes in kinds.items() for e in planes)
    grad = integer.clamped_gradient("l", "u", "c")
    return f"""with {base.PX}, ch as (select y // 288 as img, y % 3 as c, y // 3 % 96 as y, x, v from px),
rgb as (select img, y, x, max(case when c = 0 then v end) as c0, max(case when c = 1 then v end) as c1, max(case when c = 2 then v end) as c2 from ch group by img, y, x having count(*) = 3),
t as (select img, y, x, {named} from rgb), p as ({made}),
n as (select p.img, p.plane, p.v, w.v as wv, u.v as uv, q.v as qv from p left join p w on w.img = p.img and w.plane = p.plane and w.y = p.y and w.x = p.x - 1 left join p u on u.img = p.img and u.plane = p.plane and u.y = p.y - 1 and u.x = p.x left join p q on q.img = p.img and q.plane = p.plane and q.y = p.y - 1 and q.x = p.x - 1),
g as (select img, plane, v, coalesce(wv, uv, 0) as l, coalesce(uv, wv, 0) as u, coalesce(qv, wv, uv, 0) as c from n),
r as (select img, plane, v - ({grad}) as res, count(*) as n from g group by img, plane, v - ({grad})),
b as (select img, plane, sum(n) * log2(cast(sum(n) as double)) - sum(n * log2(cast(n as double))) as bits from r group by img, plane),
k as (select img, t.type, round(sum(bits), 3) as cost from b join (values {uses}) as t(type, plane) using (plane) group by img, t.type),
m as (select img, type, cost, row_number() over (partition by img order by cost, type) as place, max(case when type = 6 then cost end) over (partition by img) as usual from k)
select img, cast(case when cost < usual * cast({1 - 0.002!r} as double) then type else 6 end as int) as type, round(case when cost < usual * cast({1 - 0.002!r} as double) then cost else usual end, 2) as cost from m where place = 1"""


def learned_tree(spark: SparkSession, d: str) -> DataFrame:
    """Bits of the plane's residuals under a learned tree, as good as the best single split or better."""
    plane = base.plane(spark, d)
    cuts = {"p9": [-60, 0, 60, 128, 190], "p10": [-20, -8, 0, 8, 20], "p5": [60, 120, 180]}
    tree = trees.learn_tree(plane, cuts, leaves=8, least=64, gain=16.0)
    tokened = lossless.tokens(trees.tree_residuals(plane, tree), "res")
    own = lossless.entropy(lossless.token_histogram(tokened, "ctx"), "ctx").agg(F.sum("entropy_bits").alias("bits"))
    one = trees.split_costs(plane, "p10", cuts["p10"]).agg(F.min("cost").alias("split"))
    return own.crossJoin(F.broadcast(one)).select((F.col("bits") <= F.col("split") + 16).alias("better"))  # one row each


QUERIES = {
    "bd_rate_clipped": bd_rate_clipped,
    "equal_quality_ratio": equal_quality_ratio,
    "timing_report": timing_report,
    "block_report": block_report,
    "coefficient_report": coefficient_report,
    "configuration_search": configuration_search,
    "context_bits": context_bits,
    "leaf_division": leaf_division,
    "band_rows": band_rows,
    "transform_choice": transform_choice,
    "learned_tree": learned_tree,
}

_TOKENS = " union all ".join(f"select ctx, {k} as k, {integer.hybrid_token(PLAIN, 'u', *h)} as token, {integer.hybrid_bits(PLAIN, 'u', *h)} as raw from v" for k, h in enumerate(TRIED))
_TABLE = ", ".join(f"({k}, {a}, {b}, {c})" for k, (a, b, c) in enumerate(TRIED))
ORACLE_SQL = {
    "bd_rate_clipped": statistics_plans.ORACLE_SQL["bd_rate"].replace("greatest(min(a.q), min(b.q))", f"greatest(min(a.q), min(b.q), cast({LOW} as double))").replace("least(max(a.q), max(b.q))", f"least(max(a.q), max(b.q), cast({HIGH} as double))"),
    "equal_quality_ratio": f"""with p as (select {statistics_plans.POINTS}, o_orderstatus = 'F' as ours from orders), ours as (select distinct img, size, quality from p where ours), {rate_plans._FRONT},
piece as (select img, quality as x0, log2(cast(size as double)) as y0, lead(quality) over (partition by img order by quality) as x1, lead(log2(cast(size as double))) over (partition by img order by quality) as y1 from front)
select o.img, o.size, o.quality, round(o.size / pow(2.0, min(y0 + (o.quality - x0) / (x1 - x0) * (y1 - y0))), 6) as ratio from ours o left join piece on piece.img = o.img and x1 is not null and o.quality between x0 and x1 group by o.img, o.size, o.quality""",
    "timing_report": "with r as (select event_type as name, 0.001 + value / cast(100.0 as double) as seconds from events) select name, count(*) as runs, round(min(seconds), 6) as best, round(avg(seconds), 6) as mean, round(6000000 / min(seconds) / 1e6, 6) as mp_s from r group by name",
    "block_report": "select cast(l_partkey % 27 as int) as strategy, count(*) as n, cast(min(l_quantity) as int) as low, cast(max(l_quantity) as int) as high, round(count(*) / cast((select count(*) from lineitem) as double), 6) as share from lineitem group by l_partkey % 27",
    "coefficient_report": "with c as (select cast(l_partkey % 5 as int) as strategy, cast(l_suppkey % 64 as int) as k, cast(l_quantity as int) % 5 - 2 as v from lineitem) select strategy, k, count(*) as n, cast(count(*) filter (v <> 0) as bigint) as nonzero, round(avg(cast(abs(v) as double)), 6) as size from c group by strategy, k",
    "configuration_search": f"""with v as (select {CENTS} from lineitem), t as ({_TOKENS}), h as (select ctx, k, token, count(*) as n, sum(raw) as bits from t group by ctx, k, token),
e as (select ctx, k, round(round(sum(n) * log2(cast(sum(n) as double)) - sum(n * log2(cast(n as double))), 4) + sum(bits), 2) as cost from h group by ctx, k),
b as (select *, row_number() over (partition by ctx order by cost, k) as place from e) select ctx, split, msb, lsb, cost from b join (values {_TABLE}) as t(k, split, msb, lsb) using (k) where place = 1""",
    "context_bits": f"""with v as (select l_returnflag as ctx, cast(l_partkey % 301 as bigint) - 150 as s from lineitem), p as (select ctx, {integer.zigzag("s")} as u from v), t as (select ctx, {integer.hybrid_token(PLAIN, "u")} as token, {integer.hybrid_bits(PLAIN, "u")} as bits from p),
h as (select ctx, token, count(*) as n, sum(bits) as bits from t group by ctx, token) select ctx, cast(sum(n) as bigint) as n, round((round(sum(n) * log2(cast(sum(n) as double)) - sum(n * log2(cast(n as double))), 4) + sum(bits)) / sum(n), 6) as bits from h group by ctx""",
    "leaf_division": f"with g as ({statistics_plans.ORACLE_SQL['leaf_gcd']}), l as (select cast(l_quantity as int) as leaf, (l_partkey % 50 + 1) * (l_linenumber * 6) as res from lineitem) select l.leaf, cast(sum(case when gcd > 1 then res // gcd else res end) as bigint) as total from l join g on g.leaf = l.leaf group by l.leaf",
    "band_rows": "with s as (select max(vec_id) + 1 as h from embeddings), n as (select h, greatest(4, least(4096 // 512, h // 8)) as n from s), b as (select h, n, unnest(range(n)) as b from n), r as (select distinct (h - 8) * b // (n - 1) + o as y from b cross join (select unnest(range(8)) as o) where h * 64 > 4096) select y from r",
    "transform_choice": _choice_sql(),
    "learned_tree": "select true as better",
}
