"""Queries of frames, canvases and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour
from ..operators import compose
from . import base

#: Frames out of the events of a user: the order is time, the kind comes from the event type.
FRAME = "user_id as file, event_id as n, event_type = 'click' as is_reference, cast(event_id % 4 as int) as save_as, event_type <> 'click' as presented, 1 + cast(floor(value) as bigint) % 10 as duration"


def frames(spark: SparkSession, d: str) -> DataFrame:
    return base.table(spark, d, "events").selectExpr(*_split(FRAME))


def _split(text: str) -> list[str]:
    return text.split(", ")


def reference_slot_asof(spark: SparkSession, d: str) -> DataFrame:
    return compose.reference_slots(frames(spark, d)).select("file", "n", *(f"ref_{k}" for k in range(4)))


def frame_counters(spark: SparkSession, d: str) -> DataFrame:
    return compose.frame_counters(frames(spark, d)).select("file", "n", "visible", F.col("invisible").cast("long").alias("invisible"))


def animation_timeline(spark: SparkSession, d: str) -> DataFrame:
    return compose.timeline(frames(spark, d), 24000, 1001).select("file", "n", "start_tick", "end_tick", F.round("seconds", 6).alias("seconds"))


def double_prefix_sum(spark: SparkSession, d: str) -> DataFrame:
    deltas = base.table(spark, d, "events").selectExpr("user_id as file", "event_id as n", "cast(floor(value) as bigint) % 7 - 3 as delta")
    return compose.prefix_twice(deltas, "file", "n", "delta").select("file", "n", "step", "position")


CANVAS = "c0 / cast(255.0 as double) as b, c1 / cast(255.0 as double) as ba"
OVER = "c2 / cast(255.0 as double) as f, (255 - c1) / cast(255.0 as double) as fa"


def _composite(mode: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rgb = base.rgb(spark, d)
        made = compose.composite(rgb.selectExpr("img", "y", "x", *_split(CANVAS)), rgb.selectExpr("img", "y", "x", *_split(OVER)), mode, 16, 5)
        return made.select("y", "x", F.round("v", 6).alias("v"), F.round("a", 6).alias("a"))

    return run


def _composite_sql(mode: str) -> str:
    alpha = {"blend": compose.BLEND_ALPHA, "replace": "fa"}.get(mode, "ba")
    return f"""with {base.RGB}, canvas as (select y, x, {CANVAS} from rgb), over as (select y + 5 as y, x + 16 as x, {OVER} from rgb)
select c.y, c.x, round(case when f is not null then {compose.BLEND[mode]} else b end, 6) as v, round(case when f is not null then {alpha} else ba end, 6) as a from canvas c left join over o on o.y = c.y and o.x = c.x"""


PATCHES = "p_partkey as n, p_partkey % 5 as sx0, p_partkey % 7 as sy0, 3 + p_partkey % 6 as w, 2 + p_partkey % 4 as h, p_partkey * 7 % 60 as x, p_partkey * 11 % 150 as y"


def patch_blit(spark: SparkSession, d: str) -> DataFrame:
    px = base.rgb(spark, d)
    patches = base.table(spark, d, "part").selectExpr("0 as img", *_split(PATCHES))
    made = compose.blit(px.select("img", "y", "x", F.col("c0").alias("b")), px.select("img", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("c1").alias("f")), patches)
    return made.select("y", "x", "v")


def spot_render(spark: SparkSession, d: str) -> DataFrame:
    rgb = base.rgb(spark, d)
    made = compose.spot(rgb.selectExpr("img", "y", "x", "c0 / cast(255.0 as double) as v"), rgb.selectExpr("img", "y", "x", "c1 / cast(255.0 as double) as s"), 0.25, 0.8)
    return made.select("y", "x", F.round("v", 6).alias("v"))


def orientation_remap(spark: SparkSession, d: str) -> DataFrame:
    px = base.rgb(spark, d).select("img", "y", "x", F.col("c0").alias("v"))
    height = base.table(spark, d, "embeddings").agg(F.expr("count(*) div 3").alias("h"))
    return compose.orientations(px.crossJoin(F.broadcast(height)), "64", "h").select("orientation", "y", "x", "v")  # one row of heights


def canvas_quantise(spark: SparkSession, d: str) -> DataFrame:
    return base.rgb(spark, d).select("y", "x", compose.quantised(F.col("c0") / 100.0 - 0.5).alias("q"))


def toc_offsets(spark: SparkSession, d: str) -> DataFrame:
    sections = base.table(spark, d, "documents").selectExpr("source as file", "doc_id as idx", "n_chars as size")
    return compose.section_offsets(sections).select("file", "idx", "size", "offset")


ROLE = compose.section_role("idx", 200, 8, 1)


def section_role_bytes(spark: SparkSession, d: str) -> DataFrame:
    sections = base.table(spark, d, "documents").selectExpr("doc_id as idx", "n_chars as size").selectExpr(f"{ROLE} as role", "size")
    by = sections.groupBy("role").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    total = sections.agg(F.sum("size").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("role", "bytes", "n", F.round(F.col("bytes") / F.col("total"), 6).alias("share"))  # one row of totals


MODE = "case n % 5 when 0 then 'replace' when 1 then 'blend' when 2 then 'add' when 3 then 'weighted_add' else 'mul' end as mode"


def layered_still(spark: SparkSession, d: str) -> DataFrame:
    """Five layers, the later ones smaller, as one image."""
    each = base.rgb(spark, d).select("*", F.explode(F.array(*map(F.lit, range(5)))).alias("n")).drop("img").where("x >= 3 * n and y % 7 >= n")
    made = compose.layered(each.selectExpr("0 as img", "n", MODE, "y", "x", "c0 * (n + 1) % 256 / cast(255.0 as double) as f", "(c1 + 40 * n) % 256 / cast(255.0 as double) as fa"))
    return made.select("y", "x", F.round("v", 6).alias("v"), F.round("a", 6).alias("a"))


def _layered_sql() -> str:
    """The fold written out, layer by layer."""
    steps = ["l0 as (select y, x, c0, c1, c0 % 256 / cast(255.0 as double) as b, c1 % 256 / cast(255.0 as double) as ba from rgb)"]
    colours = {1: "case when 1 - (1 - fa) * (1 - ba) > 0 then (f * fa + b * ba * (1 - fa)) / (1 - (1 - fa) * (1 - ba)) else cast(0 as double) end", 2: "b + f", 3: "b + f * fa", 4: "b * f"}
    for n in range(1, 5):
        on = f"x >= {3 * n} and y % 7 >= {n}"
        alpha = "1 - (1 - fa) * (1 - ba)" if n == 1 else "ba"
        steps.append(f"s{n} as (select *, c0 * {n + 1} % 256 / cast(255.0 as double) as f, (c1 + {40 * n}) % 256 / cast(255.0 as double) as fa from l{n - 1}), l{n} as (select y, x, c0, c1, case when {on} then {colours[n]} else b end as b, case when {on} then {alpha} else ba end as ba from s{n})")
    return f"with {base.RGB}, " + ", ".join(steps) + " select y, x, round(b, 6) as v, round(ba, 6) as a from l4"


MODES = list(compose.BLEND)
QUERIES = {
    "reference_slot_asof": reference_slot_asof,
    "frame_counters": frame_counters,
    "animation_timeline": animation_timeline,
    "double_prefix_sum": double_prefix_sum,
    **{f"canvas_{m}": _composite(m) for m in MODES},
    "patch_blit": patch_blit,
    "layered_still": layered_still,
    "spot_render": spot_render,
    "orientation_remap": orientation_remap,
    "canvas_quantise": canvas_quantise,
    "toc_offsets": toc_offsets,
    "section_role_bytes": section_role_bytes,
}

_F = f"f as (select {FRAME} from events)"
_ORIENT = " union all ".join(f"select {k} as orientation, {to[1]} as y, {to[0]} as x, c0 as v from rgb" for k, to in compose.destinations("(64 - 1 - x)", "((select count(*) // 3 from embeddings) - 1 - y)").items())
ORACLE_SQL = {
    "layered_still": _layered_sql(),
    "reference_slot_asof": f"with {_F} select file, n, " + ", ".join(f"max(case when is_reference and save_as = {k} then n end) over (partition by file order by n rows between unbounded preceding and 1 preceding) as ref_{k}" for k in range(4)) + " from f",
    "frame_counters": f"with {_F}, v as (select *, cast(sum(case when presented then 1 else 0 end) over (partition by file order by n) as bigint) as visible from f) select file, n, visible, cast(row_number() over (partition by file, visible order by n) - case when visible > 0 then 1 else 0 end as bigint) as invisible from v",
    "animation_timeline": f"with {_F}, t as (select file, n, duration, cast(sum(duration) over (partition by file order by n) as bigint) as end_tick from f) select file, n, end_tick - duration as start_tick, end_tick, round((end_tick - duration) * cast(1001 as double) / cast(24000 as double), 6) as seconds from t",
    "double_prefix_sum": "with e as (select user_id as file, event_id as n, cast(floor(value) as bigint) % 7 - 3 as delta from events), s as (select file, n, cast(sum(delta) over (partition by file order by n) as bigint) as step from e) select file, n, step, cast(sum(step) over (partition by file order by n) as bigint) as position from s",
    **{f"canvas_{m}": _composite_sql(m) for m in MODES},
    "patch_blit": f"""with {base.RGB}, p as (select {PATCHES} from part), drawn as (select c.y, c.x, s.c1 as f, row_number() over (partition by c.y, c.x order by p.n desc) as r
from rgb c join p on c.x >= p.x and c.x < p.x + p.w and c.y >= p.y and c.y < p.y + p.h join rgb s on s.y = p.sy0 + c.y - p.y and s.x = p.sx0 + c.x - p.x) select c.y, c.x, coalesce(d.f, c.c0) as v from rgb c left join drawn d on d.y = c.y and d.x = c.x and d.r = 1""",
    "spot_render": f"with {base.RGB} select y, x, round(c1 / cast(255.0 as double) * cast(0.8 as double) * cast(0.25 as double) + (1 - c1 / cast(255.0 as double) * cast(0.8 as double)) * (c0 / cast(255.0 as double)), 6) as v from rgb",
    "orientation_remap": f"with {base.RGB} {_ORIENT}",
    "canvas_quantise": f"with {base.RGB} select y, x, {colour.quantise('(c0 / cast(100.0 as double) - cast(0.5 as double))')} as q from rgb",
    "toc_offsets": "select source as file, doc_id as idx, n_chars as size, cast(coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from documents",
    "section_role_bytes": f"with s as (select doc_id as idx, n_chars as size from documents), r as (select {ROLE} as role, size from s) select role, cast(sum(size) as bigint) as bytes, count(*) as n, round(sum(size) / cast((select sum(size) from r) as double), 6) as share from r group by role",
}
