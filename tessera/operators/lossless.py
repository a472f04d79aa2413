"""Operators of the lossless path: residuals, tokens, colour transforms, palettes, squeeze."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import integer
from ..functions.dialect import SPARK
from . import planes


def residuals(rows: DataFrame, predictor: int = 5) -> DataFrame:
    """img, c, y, x, v, pred and res for a fixed predictor."""
    px = planes.causal(rows).withColumn("pred", F.expr(integer.predictors(SPARK)[predictor]))
    return px.select("img", "c", "y", "x", "v", "pred", (F.col("v") - F.col("pred")).alias("res"))


def predictor_costs(rows: DataFrame) -> DataFrame:
    """predictor, total |residual| and how many residuals are zero, for every fixed predictor in one pass."""
    tried = integer.predictors(SPARK)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("predictor"), F.abs(F.col("v") - F.expr(p)).alias("cost")) for k, p in tried.items())))
    return planes.causal(rows).select(each.alias("t")).groupBy("t.predictor").agg(F.sum("t.cost").alias("cost"), F.sum((F.col("t.cost") == 0).cast("long")).alias("exact"))


def properties(rows: DataFrame) -> DataFrame:
    """y, x and the properties that a context tree tests; p8 compares with the pixel before in its row."""
    px = planes.causal(rows).withColumns({k: F.expr(v) for k, v in integer.PROPERTIES.items()})
    before = F.lag("p9", 1, 0).over(Window.partitionBy("img", "c", "y").orderBy("x"))
    return px.withColumn("p8", F.col("left_") - before).select("img", "c", "y", "x", *sorted([*integer.PROPERTIES, "p8"]))


def tokens(values: DataFrame, column: str, split: int = 4, msb: int = 2, lsb: int = 0) -> DataFrame:
    """Adds u (zig-zag), token and bits of a signed column."""
    packed = values.withColumn("u", F.expr(integer.zigzag(f"cast({column} as bigint)")))
    return packed.withColumns({"token": F.expr(integer.hybrid_token(SPARK, "u", split, msb, lsb)), "bits": F.expr(integer.hybrid_bits(SPARK, "u", split, msb, lsb))})


def entropy(counted: DataFrame, *keys: str) -> DataFrame:
    """n, kinds, entropy_bits (n log2 n - sum c log2 c) and extra bits. counted: keys, token, n, bits."""
    share = F.sum(F.col("n") * F.log2(F.col("n").cast("double")))
    return counted.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("kinds"),
        F.round(F.sum("n") * F.log2(F.sum("n").cast("double")) - share, 4).alias("entropy_bits"),
        F.sum("bits").cast("long").alias("extra_bits"),
    )


def token_histogram(tokened: DataFrame, *keys: str) -> DataFrame:
    return tokened.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"), F.sum("bits").alias("bits"))


def colour_transform(rgb: DataFrame, kind: int, inverse: bool = False) -> DataFrame:
    """img, y, x and the three transformed planes."""
    made = (integer.rct_inverse if inverse else integer.rct_forward)(SPARK, kind)
    return rgb.select("img", "y", "x", *(F.expr(e).alias(f"c{k}") for k, e in enumerate(made)))


def colour_search(rgb: DataFrame, kinds: list[int]) -> DataFrame:
    """img, kind and cost (bits of the zig-zagged horizontal differences) of each transform; the least cost wins.

    The transforms become columns of one pass over rows of samples, and the cost table has a row for each kind.
    """
    made = []
    for kind in kinds:
        made += [F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("plane"), F.expr(e).alias("v")) for k, e in enumerate(integer.rct_forward(SPARK, kind))]
    each = rgb.select("img", "y", "x", F.explode(F.array(*made)).alias("t")).select("img", "y", "x", "t.*")
    before = F.lag("v", 1, 0).over(Window.partitionBy("img", "y", "kind", "plane").orderBy("x"))
    tokened = tokens(each.withColumn("d", F.col("v") - before), "d")
    return entropy(token_histogram(tokened, "img", "kind", "plane"), "img", "kind", "plane").groupBy("img", "kind").agg(F.round(F.sum(F.col("entropy_bits") + F.col("extra_bits")), 2).alias("cost"))


def palette(rgb: DataFrame, colours: list[str], most: int = 256) -> DataFrame:
    """img and its different colours with their index in lexicographic order, of the images that have up to `most` of them.

    An image with more has no palette and no rows; its colours are left out before any is sorted, so a window holds
    `most` rows at most.
    """
    different = rgb.groupBy("img", *colours).agg(F.count(F.lit(1)).alias("n"))
    few = different.groupBy("img").agg(F.count(F.lit(1)).alias("__kinds")).where(F.col("__kinds") <= most).select("img")
    return different.join(few, "img", "left_semi").withColumn("idx", F.row_number().over(Window.partitionBy("img").orderBy(*colours)) - 1)


def squeeze_rows(rows: DataFrame) -> DataFrame:
    """Forward squeeze along x: img, c, y, k, avg, res (null for the odd last column)."""
    px = rows.select("img", "c", "y", F.size("row").alias("w"), F.posexplode(F.sequence(F.lit(0), F.expr("(size(row) - 1) div 2"))).alias("k", "k_"), "row")
    pair = px.select("img", "c", "y", "k", "w", *(F.get("row", 2 * F.col("k") + o).cast("long").alias(n) for o, n in ((0, "a"), (1, "b"), (-1, "before"), (2, "a2"), (3, "b2"))))
    avg = F.expr(f"case when b is null then a else {integer.squeeze_average(SPARK, 'a', 'b')} end")
    following = F.expr(f"case when a2 is null then null when b2 is null then a2 else {integer.squeeze_average(SPARK, 'a2', 'b2')} end")
    found = pair.withColumn("avg", avg).withColumn("nxt", F.coalesce(following, "avg")).withColumn("prv", F.coalesce("before", "avg"))
    return found.select("img", "c", "y", "k", "avg", F.expr(f"a - b - ({integer.smooth_tendency(SPARK, 'prv', 'avg', 'nxt')})").alias("res"))


def squeeze_columns(rows: DataFrame) -> DataFrame:
    """Forward squeeze along y: img, c, k, x, avg, res. Rows are met by pair, with the row before and the pair after."""
    need = F.array(*(F.struct(F.expr(f"(y div 2) + {dk}").alias("k"), F.lit(s).alias("s")) for dk, s in ((0, "p"), (1, "q"), (-1, "r"))))
    sent = rows.select("img", "c", "y", "row", F.explode(need).alias("t")).select("img", "c", "y", "row", "t.*").where("s <> 'q' or y % 2 = 1")
    slot = F.when(F.col("s") == "p", F.when(F.col("y") % 2 == 0, "a").otherwise("b")).when(F.col("s") == "q", "before").otherwise(F.when(F.col("y") % 2 == 0, "a2").otherwise("b2"))
    names = ("a", "b", "before", "a2", "b2")
    met = sent.withColumn("slot", slot).groupBy("img", "c", "k").agg(*(F.first(F.when(F.col("slot") == n, F.col("row")), ignorenulls=True).alias(n) for n in names)).where("a is not null")
    px = met.select("img", "c", "k", F.posexplode("a").alias("x", "a_"), *(F.col(n).alias(f"{n}_row") for n in names[1:]))
    px = px.select("img", "c", "k", "x", F.col("a_").cast("long").alias("a"), *(F.get(f"{n}_row", F.col("x")).cast("long").alias(n) for n in names[1:]))
    avg = F.expr(f"case when b is null then a else {integer.squeeze_average(SPARK, 'a', 'b')} end")
    following = F.expr(f"case when a2 is null then null when b2 is null then a2 else {integer.squeeze_average(SPARK, 'a2', 'b2')} end")
    found = px.withColumn("avg", avg).withColumn("nxt", F.coalesce(following, "avg")).withColumn("prv", F.coalesce("before", "avg"))
    return found.select("img", "c", "k", "x", "avg", F.expr(f"a - b - ({integer.smooth_tendency(SPARK, 'prv', 'avg', 'nxt')})").alias("res"))


def context_bits(tokened: DataFrame, context: str) -> DataFrame:
    """What a number costs on average in each context: entropy of its token and raw bits. tokened: as tokens() gives it."""
    costs = entropy(token_histogram(tokened, context), context)
    return costs.select(context, "n", F.round((F.col("entropy_bits") + F.col("extra_bits")) / F.col("n"), 6).alias("bits"))


def best_configuration(values: DataFrame, group: str, column: str, tried: tuple[tuple[int, int, int], ...]) -> DataFrame:
    """For each group the (split, msb, lsb) by which its unsigned numbers cost least; of equal ones the first tried.

    All are tried in one pass over counts of the different numbers.
    """
    counted = values.groupBy(group, F.col(column).alias("u")).agg(F.count(F.lit(1)).alias("times"))
    each = []
    for k, (split, msb, lsb) in enumerate(tried):
        token, bits = integer.hybrid_token(SPARK, "u", split, msb, lsb), integer.hybrid_bits(SPARK, "u", split, msb, lsb)
        each.append(F.struct(F.lit(k).alias("k"), F.expr(token).cast("long").alias("token"), F.expr(bits).cast("long").alias("raw")))
    rows = counted.select(group, "times", F.explode(F.array(*each)).alias("t")).select(group, "times", "t.*")
    hist = rows.groupBy(group, "k", "token").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("raw")).alias("bits"))
    costs = entropy(hist, group, "k").select(group, F.struct(F.round(F.col("entropy_bits") + F.col("extra_bits"), 2).alias("cost"), "k").alias("c"))
    best = costs.groupBy(group).agg(F.min("c").alias("c"))
    names = F.array(*(F.struct(F.lit(a).alias("split"), F.lit(b).alias("msb"), F.lit(c).alias("lsb")) for a, b, c in tried))
    return best.select(group, F.col("c.cost").alias("cost"), F.element_at(names, F.col("c.k") + 1).alias("h")).select(group, "cost", "h.*")


def divided(residuals_: DataFrame, leaf: str, column: str, divisors: DataFrame) -> DataFrame:
    """residuals divided by their leaf's divisor (leaf, g); a leaf of zeros has divisor 0 and stays."""
    met = residuals_.join(divisors, leaf)
    return met.withColumn(column, F.expr(f"case when g > 1 then {column} div g else {column} end")).drop("g")


def bands(rows: DataFrame, target: int = 160_000, band: int = 8) -> DataFrame:
    """rows (img, c, y, row) of the bands of `band` rows, evenly spread, that have about `target` samples; small images whole."""
    sizes = rows.groupBy("img").agg((F.max("y") + 1).alias("h"), F.max(F.size("row")).alias("w"))
    sizes = sizes.withColumn("n", F.expr(f"greatest(4, least({target} div (w * {band}), h div {band}))"))
    starts = sizes.withColumn("start", F.expr(f"case when w * h <= {target} or h < {2 * band} then array(-1L) else transform(sequence(0L, n - 1), b -> (h - {band}) * b div (n - 1)) end"))
    taken = starts.select("img", F.explode("start").alias("start"), "h").select("img", F.explode(F.expr(f"case when start < 0 then sequence(0L, h - 1) else sequence(start, start + {band - 1}) end")).alias("y")).distinct()
    return rows.join(taken, ["img", "y"]).select("img", "c", "y", "row")


def best_transform(rows: DataFrame, margin: float = 0.002) -> DataFrame:
    """rows (img, c, y, row; c from 0 to 2) to img, type, cost: of the 42 colour transforms the one with the least entropy of
    gradient residuals, or type 6 where no other gains more than the margin.

    The transforms share planes, so each different plane is priced once: samples and their neighbours are transformed
    in their row, residuals are counted inside the task, and a table of (img, plane, residual) is what is shuffled.
    """
    px = planes.causal(rows).select("img", "c", "y", "x", "v", "left_", "top_", "topleft")
    wide = px.groupBy("img", "y", "x").pivot("c", [0, 1, 2]).agg(F.first(F.struct(F.col("v").cast("long").alias("v"), "left_", "top_", "topleft")).alias("s"))
    wide = wide.where("`0` is not null and `1` is not null and `2` is not null")
    kinds = {kind: integer.rct_forward(SPARK, kind) for kind in range(42)}
    different = sorted({e for made in kinds.values() for e in made})
    each = []
    for no, e in enumerate(different):
        fields = []
        for name in ("v", "left_", "top_", "topleft"):
            text = e
            for k in range(3):
                text = text.replace(f"c{k}", f"`{k}`.{name}")
            fields.append(F.expr(text).cast("long").alias(name))
        each.append(F.struct(F.lit(no).alias("plane"), *fields))
    opened = wide.select("img", F.explode(F.array(*each)).alias("t")).select("img", "t.*")
    res = F.expr(f"v - ({integer.clamped_gradient('left_', 'top_', 'topleft')})")
    counted = opened.groupBy("img", "plane", res.alias("res")).agg(F.count(F.lit(1)).alias("n"))
    bits = F.sum("n") * F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double")))
    priced = counted.groupBy("img", "plane").agg(bits.alias("bits"))
    uses = F.array(*(F.struct(F.lit(kind).alias("type"), F.lit(different.index(e)).alias("plane"), F.lit(k).alias("k")) for kind, made in kinds.items() for k, e in enumerate(made)))
    table = rows.sparkSession.range(1).select(F.explode(uses).alias("u")).select("u.*")  # 126 rows
    costs = priced.join(F.broadcast(table), "plane").groupBy("img", "type").agg(F.round(F.sum("bits"), 3).alias("cost"))
    best = costs.groupBy("img").agg(F.min(F.struct("cost", "type")).alias("best"), F.max(F.when(F.col("type") == 6, F.col("cost"))).alias("usual"))
    gains = F.col("best.cost") < F.col("usual") * F.lit(1 - margin)
    return best.select("img", F.when(gains, F.col("best.type")).otherwise(6).alias("type"), F.when(gains, F.col("best.cost")).otherwise(F.col("usual")).alias("cost"))
