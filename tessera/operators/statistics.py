"""Aggregates of the encoder and its reports: distortion, frontiers, rate curves, code tables, byte contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distortion(a: DataFrame, b: DataFrame, top: float = 255.0) -> DataFrame:
    """img, n, sse, psnr (null for equal planes), rms and peak of the planes (img, y, x, v) of each image."""
    d = (F.col("v").cast("double") - F.col("w").cast("double")) / F.lit(top)
    met = a.join(b.withColumnRenamed("v", "w"), ["img", "y", "x"]).select("img", d.alias("d"))
    mean = F.avg(F.col("d") * F.col("d"))
    return met.groupBy("img").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.col("d") * F.col("d")), 6).alias("sse"),
        F.round(F.when(mean > 0, -10 * F.log10(mean)), 6).alias("psnr"),
        F.round(F.sqrt(mean), 6).alias("rms"),
        F.round(F.max(F.abs("d")), 6).alias("peak"),
    )


def frontier(points: DataFrame) -> DataFrame:
    """points (img, size, quality) that no smaller or equal one matches or beats. Ties in size keep the best."""
    best = points.groupBy("img", "size").agg(F.max("quality").alias("quality"))
    before = F.max("quality").over(Window.partitionBy("img").orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("before", before).where("before is null or quality > before").drop("before")


def curve_pieces(points: DataFrame) -> DataFrame:
    """Neighbouring points of each curve (img, q, r): img, q0, r0, q1, r1."""
    order = Window.partitionBy("img").orderBy("q")
    ends = points.withColumns({"q1": F.lead("q").over(order), "r1": F.lead("r").over(order)})
    return ends.where("q1 is not null").select("img", F.col("q").alias("q0"), F.col("r").alias("r0"), "q1", "r1")


def rate_difference(ours: DataFrame, theirs: DataFrame, steps: int = 200, low: float | None = None, high: float | None = None) -> DataFrame:
    """img and percent: the mean difference of log2 size over the quality that both curves cover, as a rate.

    ours, theirs: curves (img, q, r) with r = log2 size; trapezoids over `steps` equal steps, linear between points.
    low, high: the least and the greatest quality that counts.
    """
    span = lambda c, p: c.groupBy("img").agg(F.min("q").alias(f"{p}lo"), F.max("q").alias(f"{p}hi"), F.count(F.lit(1)).alias(f"{p}n"))
    both = span(ours, "a").join(span(theirs, "b"), "img").where("an > 1 and bn > 1").select("img", F.greatest("alo", "blo", *([F.lit(low)] if low is not None else [])).alias("lo"), F.least("ahi", "bhi", *([F.lit(high)] if high is not None else [])).alias("hi")).where("hi > lo")
    at = both.select("img", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i")).withColumn("q", F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / steps)
    read = at
    for name, curve in (("ra", ours), ("rb", theirs)):
        p = curve_pieces(curve)
        met = read.join(p, "img").where("q between q0 and q1")
        y = F.col("r0") + (F.col("q") - F.col("q0")) / (F.col("q1") - F.col("q0")) * (F.col("r1") - F.col("r0"))
        read = met.groupBy(*read.columns).agg(F.min(y).alias(name))  # a point where pieces meet has one value
    weight = F.when(F.col("i").isin(0, steps), 0.5).otherwise(1.0)
    mean = F.sum(weight * (F.col("ra") - F.col("rb"))) / steps
    return read.groupBy("img").agg(F.round((F.pow(F.lit(2.0), mean) - 1) * 100, 4).alias("percent"))


def canonical_codes(lengths: DataFrame) -> DataFrame:
    """lengths (book, sym, len > 0) with code: canonical order by length, then symbol. Lengths must form a prefix code.

    A code of length L is the sum of 2^(L - len) over the symbols before, so a running sum gives all at once.
    """
    before = Window.partitionBy("book").orderBy("len", "sym").rowsBetween(Window.unboundedPreceding, -1)
    top = 32
    filled = F.coalesce(F.sum(F.expr(f"shiftleft(1L, {top} - len)")).over(before), F.lit(0))
    return lengths.withColumn("filled", filled).withColumn("code", F.expr(f"shiftright(filled, {top} - len)")).drop("filled")


def normalised_counts(hist: DataFrame, total: int = 4096) -> DataFrame:
    """hist (book, sym, n > 0) with c: counts that sum to `total`, each at least 1; the most frequent symbol takes the rounding.

    Where that would leave it nothing, which needs more than `total` / 2 rare symbols, the row is left at 1 and
    the sum is over by the rest; callers with such books merge symbols first.
    """
    book = Window.partitionBy("book")
    scaled = hist.withColumn("c", F.greatest(F.lit(1), F.round(F.col("n") * F.lit(float(total)) / F.sum("n").over(book))).cast("long"))
    first = F.row_number().over(book.orderBy(F.desc("n"), "sym")) == 1
    return scaled.withColumn("rest", F.lit(total) - F.sum("c").over(book)).withColumn("c", F.greatest(F.lit(1), F.col("c") + F.when(first, F.col("rest")).otherwise(0))).drop("rest")


def gcd(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The greatest common divisor of |value| in each group, folded over its different values by Euclid's steps.

    In two levels, so that a row holds the values of one bucket of a group, and then one for each bucket.
    """
    different = values.select(*keys, F.abs(F.col(value)).cast("long").alias("a")).where("a > 0").distinct()
    # Pairs of (a, b) -> (b, a % b) end within 92 steps for 64-bit numbers.
    euclid = "aggregate(sequence(1, 92), struct(g as a, x as b), (p, i) -> if(p.b = 0, p, struct(p.b as a, p.a % p.b as b)), p -> p.a)"
    folded = F.expr(f"aggregate(all, 0L, (g, x) -> {euclid})")
    part = different.groupBy(*keys, F.pmod(F.xxhash64("a"), F.lit(256)).alias("__bucket")).agg(F.collect_set("a").alias("all")).select(*keys, folded.alias("a"))
    return part.groupBy(*keys).agg(F.collect_set("a").alias("all")).select(*keys, folded.alias("gcd"))


def value_bin(u: str, log2: str, shr) -> str:
    """Bin of an unsigned value: itself below 64, else exponent, its two next bits and its last bit. 272 bins."""
    return f"case when {u} < 64 then {u} else 64 + ({log2} - 6) * 8 + ({shr(u, f'{log2} - 2')} & 3) * 2 + ({u} & 1) end"


def byte_context(i: str, b1: str, b2: str) -> str:
    """Context of the byte at `i` from the two before it: 0 for the header, else 1 + kind(b1) + 8 * kind(b2)."""
    common = lambda b: f"when {b} between 97 and 122 or {b} between 65 and 90 then 0 when {b} between 48 and 57 or {b} in (44, 46) then 1"
    near = f"case {common(b1)} when {b1} = 0 then 2 when {b1} = 1 then 3 when {b1} < 16 then 4 when {b1} = 255 then 6 when {b1} > 240 then 5 else 7 end"
    far = f"case {common(b2)} when {b2} < 16 then 2 when {b2} > 240 then 3 else 4 end"
    return f"case when {i} <= 128 then 0 else 1 + {near} + 8 * ({far}) end"


def text_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, i, b, size: the UTF-8 bytes of each text."""
    hexed = F.hex(F.encode("text", "UTF-8"))
    out = docs.select("doc_id", hexed.alias("h")).withColumn("size", F.expr("length(h) div 2")).where("size > 0")
    spots = out.select("doc_id", "size", F.posexplode(F.expr("transform(sequence(1, size), k -> substr(h, 2 * k - 1, 2))")).alias("i", "x"))
    return spots.select("doc_id", "i", F.conv("x", 16, 10).cast("int").alias("b"), "size")


def transposed(data: DataFrame, width: int) -> DataFrame:
    """data (doc_id, i, b, size) with j, the place of each byte once a matrix of `width` columns is read by columns."""
    high = F.expr(f"(size + {width - 1}) div {width}")
    # Column r (= i % high) holds the places r, r + high, ...; columns before it have one row more while they last.
    col, row = F.expr("i % high"), F.expr("i div high")
    rows_full = F.expr("size div high")
    extra = F.expr("size % high")
    start = F.col("col") * F.col("rows_full") + F.least(F.col("col"), F.col("extra"))
    return data.withColumn("high", high).withColumns({"col": col, "row": row, "rows_full": rows_full, "extra": extra}).withColumn("j", start + F.col("row")).select("doc_id", "i", "b", "j")


def quality_ratio(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """ours (img, size, quality) with ratio: their size at the same quality goes into ours; null outside their qualities.

    theirs must be a frontier; log2 size is linear between its points.
    """
    pieces = curve_pieces(theirs.select("img", F.col("quality").alias("q"), F.log2(F.col("size").cast("double")).alias("r")))
    met = ours.join(pieces, "img").where("quality between q0 and q1")
    there = met.groupBy("img", "size", "quality").agg(F.min(F.expr("r0 + (quality - q0) / (q1 - q0) * (r1 - r0)")).alias("there"))
    joined = ours.join(there, ["img", "size", "quality"], "left")
    return joined.select("img", "size", "quality", (F.col("size") / F.pow(F.lit(2.0), F.col("there"))).alias("ratio"))


def timing_report(runs: DataFrame) -> DataFrame:
    """runs (name, seconds, pixels): runs, best and mean seconds, and million pixels a second at best."""
    best = F.min("seconds")
    return runs.groupBy("name").agg(F.count(F.lit(1)).alias("runs"), best.alias("best"), F.avg("seconds").alias("mean"), (F.max("pixels") / best / 1e6).alias("mp_s"))


def block_report(blocks: DataFrame) -> DataFrame:
    """blocks (strategy, quant): how many of each strategy, their share, and the range of their quantisers."""
    by = blocks.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.min("quant").alias("low"), F.max("quant").alias("high"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("total")))).select("strategy", "n", "low", "high", (F.col("n") / F.col("total")).alias("share"))  # one row of totals


def coefficient_report(coefficients: DataFrame) -> DataFrame:
    """coefficients (strategy, k, v): of each strategy and place, how many aren't zero, and their mean size."""
    size = F.abs(F.col("v").cast("double"))
    return coefficients.groupBy("strategy", "k").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("v") != 0).cast("long")).alias("nonzero"), F.avg(size).alias("size"))
