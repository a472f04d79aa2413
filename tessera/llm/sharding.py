"""Shards of equal row counts along a Hilbert curve through the metadata of the documents.

Language, source and size are quantised to 4 bits each by their rank in sorted order: a value's level is where the
middle of its rows lies among all rows, so frequent values get levels of their own and neighbours on the curve are
neighbours in value. A cell of that grid has a place on a three-dimensional Hilbert curve, so a run of the order
covers a short range of each dimension. The order is cut into runs of rows at most one apart (law `rows`), and files
of a shard can be skipped by their bounds on any of the dimensions.

Inside a cell the order is by text, so documents of one text, language and source lie next to each other and only a
group that meets the end of a shard is in two. Copies of a text under other languages or sources stay in the cells of
those: moved to one cell, they would widen the bounds of their shard to all values that any copy has.

Everything is DataFrame and SQL functions. The curve is a table of 4,096 rows, built by SQL and small enough to
broadcast by construction. Ranks of values come from a distributed sort of the different values, places within a cell
from bucket counts, so no task sorts a whole cell, nor all copies of a text.

Null text: no bytes, CRC of the empty text; one group with empty texts. Null language or source is a value of its
own, before all others. Texts of any length are measured whole. Repeated rows get a place each. Columns besides those
read never meet the operator's own. An empty table gives no rows; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, documents_only, materialise, ranks

BITS, DIMS, SHARDS = 4, ("lang", "source", "size"), 8


def curve(spark: SparkSession, dims: int = len(DIMS), bits: int = BITS) -> DataFrame:
    """cell (coordinates of `bits` bits each, the first dimension highest) and h, its place on the Hilbert curve.

    The steps are those of the transpose form of the curve: undo excess work from the highest bit down, then
    Gray-code, then interleave the bits. A fold over (bit, dimension) keeps the coordinates in an array.
    """
    coords = f"transform(sequence(0, {dims - 1}), d -> cast(shiftright(id, {bits} * ({dims - 1} - d)) & {(1 << bits) - 1} as int))"
    flip = "case when k = 0 or k = s.d then v ^ ((acc[0] ^ acc[s.d]) & (s.q - 1)) else v end"
    step = f"transform(acc, (v, k) -> case when acc[s.d] & s.q > 0 then case when k = 0 then v ^ (s.q - 1) else v end else {flip} end)"
    steps = ", ".join(f"struct({1 << b} as q, {d} as d)" for b in range(bits - 1, 0, -1) for d in range(dims))
    gray = f"aggregate(sequence(1, {dims - 1}), x, (acc, i) -> transform(acc, (v, k) -> case when k = i then v ^ acc[i - 1] else v end))"
    twist = f"aggregate(transform(sequence(1, {bits - 1}), b -> shiftleft(1, b)), 0, (t, q) -> case when g[{dims - 1}] & q > 0 then t ^ (q - 1) else t end)"
    h = f"aggregate(flatten(transform(sequence({bits - 1}, 0), b -> transform(y, v -> shiftright(v, b) & 1))), 0L, (n, bit) -> n * 2 + bit)"
    cells = spark.range(1 << (dims * bits)).select("id", F.expr(coords).alias("x"))
    cells = cells.select("id", F.expr(f"aggregate(array({steps}), x, (acc, s) -> {step})").alias("x"))
    cells = cells.select("id", F.expr(gray).alias("g"))
    cells = cells.select("id", "g", F.expr(twist).alias("t"))
    return cells.select("id", F.expr("transform(g, v -> v ^ t)").alias("y")).select(F.col("id").alias("cell"), F.expr(h).alias("h"))


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, lang, source, and `same`, a number of the text."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents_only(docs, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return rows.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), "lang", "source", F.xxhash64(raw).alias("same"))


def levels_of(rows: DataFrame, column: str, n: int, levels: int) -> DataFrame:
    """The different values of a column as `value`, each with `level`, from the place of the middle of its rows."""
    counted = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    sorted_ = materialise(counted.orderBy("value").withColumn("part", F.spark_partition_id()), "values")
    parts = sorted_.groupBy("part").agg(F.sum("n").alias("m"))  # one row for each partition of the sort
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("m").over(before(Window.orderBy("part"))), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("n").over(before(Window.partitionBy("part").orderBy("value"))), F.lit(0))
    placed = sorted_.withColumn("inside", inside).join(starts, "part")
    return placed.select("value", F.expr(f"cast((2 * (start + inside) + n) * {levels} div (2 * {max(n, 1)}) as int)").alias("level"))


def with_place(rows: DataFrame, n: int, bits: int = BITS) -> DataFrame:
    """rows (a fixed table of metadata) with h, the place of their cell on the curve, and copies, the rows of their text if those are more than a bucket, else 1."""
    levels = 1 << bits
    cuts = rows.agg(F.percentile_approx("size", [k / levels for k in range(1, levels)], 10000)).first()[0] or []  # levels - 1 numbers
    sized = sum((F.when(F.col("size") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    # Only texts that fill more than a bucket need their number; written first, so that the join knows its size.
    groups = materialise(rows.groupBy("same", "size").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > BUCKET_ROWS), "groups")
    met = rows.join(groups, ["same", "size"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    for c in ("lang", "source"):
        named = levels_of(rows, c, n, levels).select(F.col("value").alias("__value"), F.col("level").alias(f"__{c}"))
        met = met.join(named, F.col(c).eqNullSafe(F.col("__value"))).drop("__value")
    cell = ((F.col("__lang") * levels + F.col("__source")) * levels + sized).cast("long")
    return met.withColumn("cell", cell).join(F.broadcast(curve(rows.sparkSession, 3, bits)), "cell").drop("cell", "__lang", "__source")


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, lang, source, h, shard and slot (gapless from 0 in each shard)."""
    found = materialise(metadata(docs).withColumn("row", F.monotonically_increasing_id()), "metadata")
    n = found.count()
    rows = materialise(with_place(found, n, bits), "placed")
    cells = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))  # at most 2^(3 * bits)
    upto = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("h", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__first"))
    placed = ranks(rows, "h", ["same", "size", "doc_id", "row"], n, together="same", copies="copies")
    at = placed.join(F.broadcast(starts), "h").withColumn("__at", F.col("__first") + F.col("__rank"))
    shard = F.expr(f"cast(__at * {shards} div {max(n, 1)} as int)")
    # Shard s begins at the least place p with p * shards >= s * n.
    slot = F.expr(f"__at - (shard * {n}L + {shards - 1}) div {shards}")
    return at.withColumn("shard", shard).withColumn("slot", slot).drop("__first", "__rank", "__at", "same", "row", "copies")


def bounds(sharded: DataFrame) -> DataFrame:
    """What a reader needs to skip shards: rows, bytes, and the bounds of each dimension."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in DIMS for f in (F.min, F.max)]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *ends)


def write_shards(docs: DataFrame, sharded: DataFrame, path: str) -> None:
    """Writes the documents under path/__shard=S, each file sorted along the curve. doc_id must be unique here."""
    places = sharded.select(F.col("doc_id").alias("__id"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    whole = docs.join(places, F.col("doc_id").eqNullSafe(F.col("__id"))).drop("__id")
    sorted_ = whole.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    sorted_.drop("__slot").write.partitionBy("__shard").parquet(path)
