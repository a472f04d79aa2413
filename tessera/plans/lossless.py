"""Queries of the lossless path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import integer
from ..functions.dialect import PLAIN, SPARK
from ..operators import lossless, planes
from . import base

PRED = integer.predictors(PLAIN)
RES = f"{base.CAUSAL}, res as (select y, x, v - ({PRED[5]}) as res from causal)"
PACKED = f"packed as (select {integer.zigzag('res')} as u from res)"
TOKENED = f"tokened as (select u, {integer.hybrid_token(PLAIN, 'u')} as token, {integer.hybrid_bits(PLAIN, 'u')} as bits from packed)"
HIST = "hist as (select token, count(*) as n, sum(bits) as bits from tokened group by token)"
ENTROPY = "select cast(sum(n) as bigint) as n, count(*) as kinds, round(sum(n) * log2(cast(sum(n) as double)) - sum(n * log2(cast(n as double))), 4) as entropy_bits, cast(sum(bits) as bigint) as extra_bits from hist"
CENTS = "cast(round(l_extendedprice * 100) as bigint)"
MIXES = [0, 1, 2, 3, 4, 5, 6, 13, 20, 27, 34, 41]


def token_entropy(spark: SparkSession, d: str) -> DataFrame:
    return lossless.entropy(lossless.token_histogram(lossless.tokens(lossless.residuals(base.plane(spark, d)), "res")))


def gradient_residual(spark: SparkSession, d: str) -> DataFrame:
    return lossless.residuals(base.plane(spark, d)).select("y", F.col("x").cast("long").alias("x"), "res")


def _predicted(k: int):
    return lambda spark, d: lossless.residuals(base.plane(spark, d), k).select("y", F.col("x").cast("long").alias("x"), F.col("pred").cast("long").alias("pred"))


def predictor_costs(spark: SparkSession, d: str) -> DataFrame:
    return lossless.predictor_costs(base.plane(spark, d))


def ma_properties(spark: SparkSession, d: str) -> DataFrame:
    return lossless.properties(base.plane(spark, d)).drop("img", "c").withColumn("x", F.col("x").cast("long"))


def zigzag_pack(spark: SparkSession, d: str) -> DataFrame:
    values = base.table(spark, d, "events").select("event_id", F.expr("cast(floor(value) as bigint) - 40").alias("s"))
    packed = values.withColumn("u", F.expr(integer.zigzag("s")))
    return packed.withColumn("back", F.expr(integer.unzigzag(SPARK, "u")))


def hybrid_uint_tokens(spark: SparkSession, d: str) -> DataFrame:
    cents = base.table(spark, d, "lineitem").select(F.expr(CENTS).alias("u"))
    made = cents.select(F.expr(integer.hybrid_token(SPARK, "u", 5, 1, 1)).alias("token"), F.expr(integer.hybrid_bits(SPARK, "u", 5, 1, 1)).alias("bits"))
    return made.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.max("bits").cast("long").alias("bits"))


def _colour(kind: int, inverse: bool):
    return lambda spark, d: lossless.colour_transform(base.rgb(spark, d), kind, inverse).drop("img")


def _colour_sql(kind: int, inverse: bool) -> str:
    made = (integer.rct_inverse if inverse else integer.rct_forward)(PLAIN, kind)
    return f"with {base.RGB} select y, x, " + ", ".join(f"{e} as c{k}" for k, e in enumerate(made)) + " from rgb"


def rct_round_trips(spark: SparkSession, d: str) -> DataFrame:
    """Every transform, forward and back: rows that changed, and a checksum of the forward planes."""
    there = [F.struct(F.lit(kind).alias("kind"), *(F.expr(e).alias(f"c{k}") for k, e in enumerate(integer.rct_forward(SPARK, kind)))) for kind in range(42)]
    made = base.rgb(spark, d).select(F.struct(*(F.col(f"c{k}").cast("long").alias(f"o{k}") for k in range(3))).alias("o"), F.explode(F.array(*there)).alias("t")).select("o", "t.*")
    back = [F.struct(*(F.expr(e).alias(f"o{k}") for k, e in enumerate(integer.rct_inverse(SPARK, kind)))) for kind in range(42)]
    changed = F.coalesce(*(F.when(F.col("kind") == kind, one != F.col("o")) for kind, one in enumerate(back)))
    return made.groupBy("kind").agg(F.sum(changed.cast("long")).alias("changed"), F.sum(F.col("c0") + 3 * F.col("c1") + 7 * F.col("c2")).alias("checksum"))


def _round_trip_sql() -> str:
    parts = []
    for kind in range(42):
        sums = integer.rct_forward(PLAIN, kind)
        parts.append(f"select {kind} as kind, cast(0 as bigint) as changed, cast(sum(({sums[0]}) + 3 * ({sums[1]}) + 7 * ({sums[2]})) as bigint) as checksum from rgb")
    return f"with {base.RGB} " + " union all ".join(parts)


def rct_type_search(spark: SparkSession, d: str) -> DataFrame:
    return lossless.colour_search(base.rgb(spark, d), MIXES).drop("img")


def _search_sql() -> str:
    planes_ = " union all ".join(f"select y, x, {kind} as kind, {k} as plane, {e} as v from rgb" for kind in MIXES for k, e in enumerate(integer.rct_forward(PLAIN, kind)))
    return f"""with {base.RGB}, each as ({planes_}), res as (select kind, plane, v - coalesce(lag(v) over (partition by y, kind, plane order by x), 0) as res from each),
packed as (select kind, plane, {integer.zigzag("res")} as u from res), tokened as (select kind, plane, {integer.hybrid_token(PLAIN, "u")} as token, {integer.hybrid_bits(PLAIN, "u")} as bits from packed),
hist as (select kind, plane, token, count(*) as n, sum(bits) as bits from tokened group by kind, plane, token),
cost as (select kind, plane, round(sum(n) * log2(cast(sum(n) as double)) - sum(n * log2(cast(n as double))), 4) + sum(bits) as cost from hist group by kind, plane)
select kind, round(sum(cost), 2) as cost from cost group by kind"""


COARSE = [f"shiftright(c{k}, 5) as q{k}" for k in range(3)]


def palette_distinct(spark: SparkSession, d: str) -> DataFrame:
    coarse = base.rgb(spark, d).selectExpr("img", *COARSE)
    return lossless.palette(coarse, ["q0", "q1", "q2"], 512).drop("img").withColumn("idx", F.col("idx").cast("long"))


def palette_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The index plane joined back with its palette: pixels for each colour that come out as they went in."""
    coarse = base.rgb(spark, d).selectExpr("img", "y", "x", *COARSE)
    table = lossless.palette(coarse, ["q0", "q1", "q2"], 512).select("img", "idx", "q0", "q1", "q2")
    indexed = coarse.join(table, ["img", "q0", "q1", "q2"]).select("img", "y", "x", "idx")
    return indexed.join(table, ["img", "idx"]).groupBy("q0", "q1", "q2").agg(F.count(F.lit(1)).alias("n"))


def palette_lookup_implicit(spark: SparkSession, d: str) -> DataFrame:
    index = base.table(spark, d, "part").select("p_partkey", F.expr("16 + p_partkey % 189").alias("i"))
    return index.select("p_partkey", *(F.expr(integer.palette_implicit(SPARK, "i", 16, k)).cast("long").alias(f"v{k}") for k in range(3)))


def squeeze_h_forward(spark: SparkSession, d: str) -> DataFrame:
    return lossless.squeeze_rows(base.plane(spark, d)).select("y", F.col("k").cast("long").alias("k"), "avg", "res")


def squeeze_v_forward(spark: SparkSession, d: str) -> DataFrame:
    return lossless.squeeze_columns(base.plane(spark, d)).select(F.col("k").cast("long").alias("k"), F.col("x").cast("long").alias("x"), "avg", "res")


def _squeeze_sql(along: str, across: str, out: str) -> str:
    return f"""with {base.PX}, pairs as (select {along} // 2 as k, {across} as t, max(case when {along} % 2 = 0 then cast(v as bigint) end) as a, max(case when {along} % 2 = 1 then cast(v as bigint) end) as b from px group by {along} // 2, {across}),
means as (select *, case when b is null then a else {integer.squeeze_average(PLAIN, "a", "b")} end as avg from pairs),
near as (select *, coalesce(lag(b) over o, avg) as prv, coalesce(lead(avg) over o, avg) as nxt from means window o as (partition by t order by k))
select k, t as {out}, avg, a - b - ({integer.smooth_tendency(PLAIN, "prv", "avg", "nxt")}) as res from near"""


def smooth_tendency(spark: SparkSession, d: str) -> DataFrame:
    trio = base.table(spark, d, "part").selectExpr("p_partkey", "p_size * 7 % 101 as b", "p_partkey * 13 % 97 as a", "(p_partkey + p_size) % 89 as n")
    return trio.select("p_partkey", F.expr(integer.smooth_tendency(SPARK, "b", "a", "n")).cast("long").alias("tendency"))


def group_tiling(spark: SparkSession, d: str) -> DataFrame:
    parts = planes.regroup(base.plane(spark, d), 16)
    return parts.groupBy(F.expr("y div 16").alias("gy"), F.col("gx").cast("long").alias("gx")).agg(F.sum(F.size("row")).alias("n"), F.sum(F.expr("aggregate(row, 0L, (a, v) -> a + v)")).alias("total"))


QUERIES = {
    "token_entropy": token_entropy,
    "gradient_residual": gradient_residual,
    "select_predictor": _predicted(4),
    "average4_predictor": _predicted(13),
    "predictor_costs": predictor_costs,
    "ma_properties": ma_properties,
    "zigzag_pack": zigzag_pack,
    "hybrid_uint_tokens": hybrid_uint_tokens,
    "rct_forward_ycocg": _colour(6, False),
    "rct_inverse_ycocg": _colour(6, True),
    "rct_round_trips": rct_round_trips,
    "rct_type_search": rct_type_search,
    "palette_distinct": palette_distinct,
    "palette_round_trip": palette_round_trip,
    "palette_lookup_implicit": palette_lookup_implicit,
    "squeeze_h_forward": squeeze_h_forward,
    "squeeze_v_forward": squeeze_v_forward,
    "smooth_tendency": smooth_tendency,
    "group_tiling": group_tiling,
}

_COARSE = "coarse as (select y, x, c0 >> 5 as q0, c1 >> 5 as q1, c2 >> 5 as q2 from rgb)"
ORACLE_SQL = {
    "token_entropy": f"with {RES}, {PACKED}, {TOKENED}, {HIST} {ENTROPY}",
    "gradient_residual": f"with {RES} select y, x, res from res",
    "select_predictor": f"with {base.CAUSAL} select y, x, cast({PRED[4]} as bigint) as pred from causal",
    "average4_predictor": f"with {base.CAUSAL} select y, x, cast({PRED[13]} as bigint) as pred from causal",
    "predictor_costs": f"with {base.CAUSAL}, each as (" + " union all ".join(f"select {k} as predictor, abs(v - ({p})) as cost from causal" for k, p in PRED.items()) + ") select predictor, cast(sum(cost) as bigint) as cost, cast(sum(case when cost = 0 then 1 else 0 end) as bigint) as exact from each group by predictor",
    "ma_properties": f"with {base.CAUSAL}, props as (select y, x, left_, " + ", ".join(f"{v} as {k}" for k, v in integer.PROPERTIES.items()) + " from causal) select * exclude (left_), left_ - coalesce(lag(p9) over (partition by y order by x), 0) as p8 from props",
    "zigzag_pack": f"with s as (select event_id, cast(floor(value) as bigint) - 40 as s from events), u as (select *, {integer.zigzag('s')} as u from s) select *, {integer.unzigzag(PLAIN, 'u')} as back from u",
    "hybrid_uint_tokens": f"with u as (select {CENTS} as u from lineitem), t as (select {integer.hybrid_token(PLAIN, 'u', 5, 1, 1)} as token, {integer.hybrid_bits(PLAIN, 'u', 5, 1, 1)} as bits from u) select token, count(*) as n, cast(max(bits) as bigint) as bits from t group by token",
    "rct_forward_ycocg": _colour_sql(6, False),
    "rct_inverse_ycocg": _colour_sql(6, True),
    "rct_round_trips": _round_trip_sql(),
    "rct_type_search": _search_sql(),
    "palette_distinct": f"with {base.RGB}, {_COARSE} select q0, q1, q2, count(*) as n, row_number() over (order by q0, q1, q2) - 1 as idx from coarse group by q0, q1, q2",
    "palette_round_trip": f"with {base.RGB}, {_COARSE} select q0, q1, q2, count(*) as n from coarse group by q0, q1, q2",
    "palette_lookup_implicit": "with i as (select p_partkey, 16 + p_partkey % 189 as i from part) select p_partkey, " + ", ".join(f"cast({integer.palette_implicit(PLAIN, 'i', 16, k)} as bigint) as v{k}" for k in range(3)) + " from i",
    "squeeze_h_forward": _squeeze_sql("x", "y", "y"),
    "squeeze_v_forward": _squeeze_sql("y", "x", "x"),
    "smooth_tendency": f"with t as (select p_partkey, p_size * 7 % 101 as b, p_partkey * 13 % 97 as a, (p_partkey + p_size) % 89 as n from part) select p_partkey, cast({integer.smooth_tendency(PLAIN, 'b', 'a', 'n')} as bigint) as tendency from t",
    "group_tiling": f"with {base.PX} select y // 16 as gy, x // 16 as gx, count(*) as n, cast(sum(v) as bigint) as total from px group by y // 16, x // 16",
}
