"""Planes and relations made from the tables, in Spark and in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as one plane of 8-bit samples, 64 wide: img, c, y, row."""
    sample = F.transform("embedding", lambda e: F.round((e.cast("double") + 1) * 127.5).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.lit(0).alias("img"), F.lit(0).alias("c"), F.col("vec_id").alias("y"), sample.alias("row"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three rows of the plane as the three channels of one row: img, y, x, c0, c1, c2."""
    rows = plane(spark, sf_dir).select("img", F.expr("y div 3").alias("y"), (F.col("y") % 3).alias("c"), "row")
    held = [F.first(F.when(F.col("c") == k, F.col("row")), ignorenulls=True).alias(f"r{k}") for k in range(3)]
    full = rows.groupBy("img", "y").agg(*held).where("r0 is not null and r1 is not null and r2 is not null")
    return full.select("img", "y", F.posexplode(F.arrays_zip("r0", "r1", "r2")).alias("x", "s")).select("img", "y", F.col("x").cast("long").alias("x"), *(F.col(f"s.r{k}").alias(f"c{k}") for k in range(3)))


def pixels(rows: DataFrame) -> DataFrame:
    return rows.select("y", F.posexplode("row").alias("x", "v"))


PX = "px as (select vec_id as y, generate_subscripts(embedding, 1) - 1 as x, cast(round((cast(unnest(embedding) as double) + 1) * 127.5) as int) as v from embeddings)"
RGB = (
    PX
    + ", rgb as (select y // 3 as y, x, max(case when y % 3 = 0 then v end) as c0, max(case when y % 3 = 1 then v end) as c1, max(case when y % 3 = 2 then v end) as c2 from px group by y // 3, x having count(*) = 3)"
)
CAUSAL = (
    PX
    + """, near as (select *, lag(v) over r as w1, lag(v, 2) over r as w2, lag(v) over c as n1, lag(v, 2) over c as n2 from px window r as (partition by y order by x), c as (partition by x order by y)),
far as (select *, lag(n1) over r as nw, lead(n1) over r as ne, lead(n1, 2) over r as nee from near window r as (partition by y order by x)),
sides as (select *, cast(coalesce(w1, n1, 0) as bigint) as left_, cast(coalesce(n1, w1, 0) as bigint) as top_ from far),
causal as (select y, x, cast(v as bigint) as v, left_, top_, coalesce(nw, left_) as topleft, coalesce(ne, top_) as topright, coalesce(w2, left_) as leftleft, coalesce(n2, top_) as toptop, coalesce(nee, coalesce(ne, top_)) as toprightright from sides)"""
)
STENCIL = (
    PX
    + """, ns as (select *, coalesce(lag(v) over c, v) as up, coalesce(lead(v) over c, v) as dn from px window c as (partition by x order by y)),
st as (select *, coalesce(lag(v) over r, v) as l, coalesce(lead(v) over r, v) as rr, coalesce(lag(up) over r, up) as ul, coalesce(lead(up) over r, up) as ur, coalesce(lag(dn) over r, dn) as dl, coalesce(lead(dn) over r, dn) as dr from ns window r as (partition by y order by x))"""
)
