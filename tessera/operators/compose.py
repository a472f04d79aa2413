"""Operators with several inputs: reference slots, frames on canvases, patches, orientation, spot colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reference_slots(frames: DataFrame, slots: int = 4) -> DataFrame:
    """frames (file, n, is_reference, save_as) with ref_K: the last frame before each that was saved in slot K.

    An as-of join: one window over each file for all slots, no join.
    """
    before = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    saved = {f"ref_{k}": F.last(F.when(F.col("is_reference") & (F.col("save_as") == k), F.col("n")), ignorenulls=True).over(before) for k in range(slots)}
    return frames.withColumns(saved)


def frame_counters(frames: DataFrame) -> DataFrame:
    """frames with visible (presented so far) and invisible (others since the last presented one)."""
    upto = Window.partitionBy("file").orderBy("n")
    shown = frames.withColumn("visible", F.sum(F.col("presented").cast("long")).over(upto))
    since = Window.partitionBy("file", "visible").orderBy("n")
    return shown.withColumn("invisible", F.row_number().over(since) - F.when(F.col("visible") > 0, 1).otherwise(0))


def timeline(frames: DataFrame, ticks: int, per: int) -> DataFrame:
    """frames with start and end in ticks, and seconds at `ticks` ticks per `per` seconds."""
    upto = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    timed = frames.withColumn("end_tick", F.sum("duration").over(upto))
    return timed.withColumn("start_tick", F.col("end_tick") - F.col("duration")).withColumn("seconds", F.col("start_tick") * F.lit(float(per)) / F.lit(float(ticks)))


#: Blend modes of frames over the names b, ba (below) and f, fa (above), all doubles.
BLEND = {
    "replace": "f",
    "add": "b + f",
    "blend": "case when 1 - (1 - fa) * (1 - ba) > 0 then (f * fa + b * ba * (1 - fa)) / (1 - (1 - fa) * (1 - ba)) else cast(0 as double) end",
    "weighted_add": "b + f * least(greatest(fa, cast(0 as double)), cast(1 as double))",
    "mul": "b * least(greatest(f, cast(0 as double)), cast(1 as double))",
}
BLEND_ALPHA = "1 - (1 - fa) * (1 - ba)"


def blending(mode: str, clamp: bool = False, premultiplied: bool = False) -> tuple[str, str]:
    """Colour and alpha of a frame over a canvas, as SQL text over b, ba, f and fa.

    clamp: the frame's alpha (with mul, its colour) is taken within 0 and 1. premultiplied: colours hold their alpha already.
    """
    within = lambda v: f"least(greatest({v}, cast(0 as double)), cast(1 as double))" if clamp else v
    fa = within("fa")
    alpha = f"1 - (1 - {fa}) * (1 - ba)"
    if mode == "blend":
        colour = f"f + b * (1 - {fa})" if premultiplied else f"case when {alpha} > 0 then (f * {fa} + b * ba * (1 - {fa})) / ({alpha}) else cast(0 as double) end"
        return colour, alpha
    colours = {"replace": "f", "add": "b + f", "weighted_add": f"b + f * {fa}", "mul": f"b * {within('f')}"}
    return colours[mode], {"replace": "fa"}.get(mode, "ba")


def composite(canvas: DataFrame, frame: DataFrame, mode: str, x0: int, y0: int) -> DataFrame:
    """canvas (img, y, x, b, ba) under frame (img, y, x, f, fa) placed at (x0, y0): img, y, x, v, a. Uncovered samples stay."""
    over = frame.select("img", (F.col("y") + y0).alias("y"), (F.col("x") + x0).alias("x"), "f", "fa")
    met = canvas.join(over, ["img", "y", "x"], "left")
    covered = F.col("f").isNotNull()
    alpha = F.expr(BLEND_ALPHA) if mode == "blend" else F.col("fa") if mode == "replace" else F.col("ba")
    return met.select("img", "y", "x", F.when(covered, F.expr(BLEND[mode])).otherwise(F.col("b")).alias("v"), F.when(covered, alpha).otherwise(F.col("ba")).alias("a"))


def layered(frames: DataFrame) -> DataFrame:
    """Frames of still images put over each other in order: frames (img, n, mode, y, x, f, fa) to img, y, x, v, a.

    A sample is a fold over the frames that cover it, of which the format has 256 at most, from an empty canvas.
    """
    def laid(acc: Column, s: Column) -> Column:
        b, ba, f, fa = acc["b"], acc["ba"], s["f"], s["fa"]
        seen = 1 - (1 - fa) * (1 - ba)
        colour = F.when(s["mode"] == "replace", f).when(s["mode"] == "add", b + f).when(s["mode"] == "weighted_add", b + f * fa).when(s["mode"] == "mul", b * f)
        colour = colour.otherwise(F.when(seen > 0, (f * fa + b * ba * (1 - fa)) / seen).otherwise(0.0))
        alpha = F.when(s["mode"] == "replace", fa).when(s["mode"] == "blend", seen).otherwise(ba)
        return F.struct(colour.alias("b"), alpha.alias("ba"))

    known = frames.where(F.col("mode").isin(list(BLEND)))
    at = known.groupBy("img", "y", "x").agg(F.array_sort(F.collect_list(F.struct("n", "mode", F.col("f").cast("double").alias("f"), F.col("fa").cast("double").alias("fa")))).alias("of"))
    empty = F.struct(F.lit(0.0).alias("b"), F.lit(0.0).alias("ba"))
    return at.select("img", "y", "x", F.aggregate("of", empty, laid).alias("r")).select("img", "y", "x", F.col("r.b").alias("v"), F.col("r.ba").alias("a"))


def blit(canvas: DataFrame, source: DataFrame, patches: DataFrame) -> DataFrame:
    """Draws rectangles of source (img, sy, sx, f) on canvas (img, y, x, b): the last patch in dictionary order wins.

    patches: img, n, sx0, sy0, w, h, x, y. A rectangle is opened into its samples, so the range join becomes an equality
    join. Samples that draw one source on one place are summed up first, inside each task, so patches that cover each
    other don't multiply what is shuffled. The opened side is never broadcast: its size isn't that of the table of patches.
    """
    spots = patches.select("img", "n", "sx0", "sy0", "x", "y", F.explode(F.expr("sequence(0, h - 1)")).alias("dy"), "w").select("*", F.explode(F.expr("sequence(0, w - 1)")).alias("dx"))
    spots = spots.select("img", "n", (F.col("sy0") + F.col("dy")).alias("sy"), (F.col("sx0") + F.col("dx")).alias("sx"), (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    spots = spots.groupBy("img", "sy", "sx", "y", "x").agg(F.max("n").alias("n"))
    drawn = spots.hint("merge").join(source, ["img", "sy", "sx"])
    last = drawn.groupBy("img", "y", "x").agg(F.max_by("f", "n").alias("f"))
    return canvas.hint("merge").join(last, ["img", "y", "x"], "left").select("img", "y", "x", F.coalesce("f", "b").alias("v"))


def orient(px: DataFrame, orientation: int, width: int | str, height: int | str) -> DataFrame:
    """px (img, y, x, v) as displayed under one of the eight orientations."""
    right, low = f"({width} - 1 - x)", f"({height} - 1 - y)"
    to = destinations(right, low)[orientation]
    return px.select("img", F.expr(to[1]).alias("y"), F.expr(to[0]).alias("x"), "v")


def orientations(px: DataFrame, width: str, height: str) -> DataFrame:
    """px as displayed under each of the eight orientations, in one pass: orientation, img, y, x, v."""
    to = destinations(f"({width} - 1 - x)", f"({height} - 1 - y)")
    each = F.array(*(F.struct(F.lit(k).alias("orientation"), F.expr(row).cast("long").alias("y"), F.expr(column).cast("long").alias("x")) for k, (column, row) in to.items()))
    return px.select("img", "v", F.explode(each).alias("at")).select("at.orientation", "img", "at.y", "at.x", "v")


def destinations(right: str, low: str) -> dict[int, tuple[str, str]]:
    """Where a sample (x, y) goes: its new x and y."""
    return {1: ("x", "y"), 2: (right, "y"), 3: (right, low), 4: ("x", low), 5: ("y", "x"), 6: (low, "x"), 7: (low, right), 8: ("y", right)}


def spot(colours: DataFrame, ink: DataFrame, value: float, scale: float) -> DataFrame:
    """colours (img, y, x, v) under an ink plane (img, y, x, s) of one colour: mix * value + (1 - mix) * v."""
    mix = F.col("s") * F.lit(scale)
    return colours.join(ink, ["img", "y", "x"]).select("img", "y", "x", (mix * F.lit(value) + (1 - mix) * F.col("v")).alias("v"))


def prefix_twice(deltas: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Sums of sums: deltas of deltas back to positions."""
    upto = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("step", F.sum(value).over(upto)).withColumn("position", F.sum("step").over(upto))


def section_offsets(sections: DataFrame) -> DataFrame:
    """sections (file, idx, size) with offset, the sizes before each."""
    before = Window.partitionBy("file").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return sections.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))


def section_role(index: str, groups: int, dc_groups: int, passes: int) -> str:
    """The role of a section by its place, as SQL text: one section has all; else DC global, DC groups, AC global, then passes."""
    if groups == 1 and passes == 1:
        return "'all'"
    return f"case when {index} = 0 then 'dc_global' when {index} <= {dc_groups} then 'dc_group' when {index} = {dc_groups + 1} then 'ac_global' else 'ac_group' end"


def quantised(v: Column) -> Column:
    """To 8 bits, halves away from zero; what isn't a number is 0."""
    return F.when(F.isnan(v), F.lit(0)).otherwise(F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255).cast("int"))
