"""Context trees over the properties of a pixel: evaluation, and the search for a split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import integer
from ..functions.dialect import SPARK, Dialect
from . import lossless, planes

#: (property, value, above, upto): pixels whose property is greater go to `above`. A leaf: (context, predictor, offset, multiplier).
Tree = tuple


def depth_first(tree: Tree, leaf) -> str:
    """The tree as nested CASE, with `leaf` giving the SQL of a leaf."""
    if not isinstance(tree[0], str):
        return leaf(tree)
    prop, value, above, upto = tree
    return f"case when {prop} > {value} then {depth_first(above, leaf)} else {depth_first(upto, leaf)} end"


def tree_columns(d: Dialect, tree: Tree) -> dict[str, str]:
    """ctx, and res: the residual to the leaf's predictor and offset, divided by its multiplier."""
    made = integer.predictors(d)
    return {"ctx": depth_first(tree, lambda t: str(t[0])), "res": depth_first(tree, lambda t: d.div(f"v - ({made[t[1]]}) - {t[2]}", str(t[3])))}


def tree_residuals(rows: DataFrame, tree: Tree) -> DataFrame:
    """img, c, y, x, ctx and res of every pixel. Encoding knows all neighbours, so this is a projection."""
    px = planes.causal(rows).withColumns({k: F.expr(v) for k, v in integer.PROPERTIES.items()})
    return px.withColumns({k: F.expr(v) for k, v in tree_columns(SPARK, tree).items()}).select("img", "c", "y", "x", "ctx", "res")


def split_costs(rows: DataFrame, prop: str, boundaries: list[int]) -> DataFrame:
    """boundary, cost: bits of the gradient residuals' tokens when pixels are parted at property > boundary.

    The pixels are counted once by (interval of the property, token); the candidates share those counts, so
    their number doesn't multiply the pixels.
    """
    px = planes.causal(rows).withColumn("p", F.expr(integer.PROPERTIES[prop])).withColumn("res", F.col("v") - F.expr(integer.predictors(SPARK)[5]))
    interval = sum((F.when(F.col("p") > b, 1).otherwise(0) for b in boundaries), F.lit(0))
    hist = lossless.tokens(px.withColumn("interval", interval), "res").groupBy("interval", "token").agg(F.count(F.lit(1)).alias("n"))
    tried = F.explode(F.array(*(F.struct(F.lit(b).alias("boundary"), (F.col("interval") > k).alias("above")) for k, b in enumerate(boundaries))))
    sides = hist.select("token", "n", tried.alias("t")).groupBy("t.boundary", "t.above", "token").agg(F.sum("n").alias("n"))
    total, share = F.sum("n"), F.sum(F.col("n") * F.log2(F.col("n").cast("double")))
    each = sides.groupBy("boundary", "above").agg((total * F.log2(total.cast("double")) - share).alias("bits"))
    return each.groupBy("boundary").agg(F.round(F.sum("bits"), 3).alias("cost"))


def learn_tree(rows: DataFrame, boundaries: dict[str, list[int]], leaves: int = 48, least: int = 256, gain: float = 64.0) -> Tree:
    """A tree that parts pixels where that saves most bits of gradient residuals' tokens.

    Level by level: pixels are counted by (leaf, property, interval, token), every boundary of every property is priced
    from those counts, and each leaf is parted at its best one if that saves `gain` bits and leaves `least` pixels on
    both sides; the best savings first, up to `leaves`. The driver sees one row for each leaf.
    """
    names = sorted(boundaries)
    px = planes.causal(rows).withColumns({k: F.expr(integer.PROPERTIES[k]) for k in names}).withColumn("res", F.col("v") - F.expr(integer.predictors(SPARK)[5]))
    px = lossless.tokens(px, "res").select("token", *names)
    spans = [F.struct(F.lit(k).alias("prop"), sum((F.when(F.col(name) > b, 1).otherwise(0) for b in boundaries[name]), F.lit(0)).alias("interval")) for k, name in enumerate(names)]
    tried = px.sparkSession.createDataFrame([(k, j) for k, name in enumerate(names) for j in range(len(boundaries[name]))], "prop int, cut int")
    nodes: list = [(0, 5, 0, 1)]
    open_leaves, n_leaves = [0], 1
    bits = lambda n: F.sum(n) * F.log2(F.sum(n).cast("double")) - F.sum(F.col(n) * F.log2(F.col(n).cast("double")))

    def built(at: int):
        node = nodes[at]
        return (node[0], node[1], built(node[2]), built(node[3])) if isinstance(node[0], str) else (at, *node[1:])

    while open_leaves and n_leaves < leaves:
        leaf = F.expr(depth_first(built(0), lambda t: str(t[0])))
        hist = px.withColumn("leaf", leaf).where(F.col("leaf").isin(open_leaves)).select("leaf", "token", F.explode(F.array(*spans)).alias("s"))
        hist = hist.groupBy("leaf", "s.prop", "s.interval", "token").agg(F.count(F.lit(1)).alias("n"))
        sides = hist.join(F.broadcast(tried), "prop").groupBy("leaf", "prop", "cut", (F.col("interval") > F.col("cut")).alias("above"), "token").agg(F.sum("n").alias("n"))
        whole = sides.groupBy("leaf", "prop", "cut", "token").agg(F.sum("n").alias("n")).groupBy("leaf", "prop", "cut").agg(bits("n").alias("base"))
        parts = sides.groupBy("leaf", "prop", "cut", "above").agg(bits("n").alias("bits"), F.sum("n").alias("n"))
        cuts = parts.groupBy("leaf", "prop", "cut").agg(F.sum("bits").alias("bits"), F.min("n").alias("few"), F.count(F.lit(1)).alias("sides")).where((F.col("sides") == 2) & (F.col("few") >= least))
        saved = cuts.join(whole, ["leaf", "prop", "cut"]).select("leaf", F.struct(F.round(F.col("base") - F.col("bits"), 6).alias("saved"), (-F.col("prop")).alias("p"), (-F.col("cut")).alias("c")).alias("s"))
        best = saved.groupBy("leaf").agg(F.max("s").alias("s")).where(F.col("s.saved") >= gain).collect()  # one row for each leaf
        open_leaves = []
        for r in sorted(best, key=lambda r: (-r["s"]["saved"], r["leaf"]))[: leaves - n_leaves]:
            name = names[-r["s"]["p"]]
            nodes += [(0, 5, 0, 1), (0, 5, 0, 1)]
            above, upto = len(nodes) - 2, len(nodes) - 1
            nodes[r["leaf"]] = (name, boundaries[name][-r["s"]["c"]], above, upto)
            open_leaves += [above, upto]
            n_leaves += 1
    order = iter(range(n_leaves))

    def final(at: int):
        node = nodes[at]
        return (node[0], node[1], final(node[2]), final(node[3])) if isinstance(node[0], str) else (next(order), *node[1:])

    return final(0)
