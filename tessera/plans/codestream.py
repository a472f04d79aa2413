"""Queries of codestreams: headers, sections, entropy codes and lossless images, written and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codestream, entropy, headers, histograms
from ..sources import codestream as source
from ..sources import jpeg as jpegs
from . import base

#: Header fields out of orders; the same text is SQL in both engines.
HEADS = (
    "o_orderkey as file, cast(1 + o_custkey * 37 % 4001 as int) as width, cast(1 + o_orderkey * 13 % 3001 as int) as height, "
    "cast(8 + o_orderkey % 9 as int) as bits, cast(1 + o_custkey % 8 as int) as orientation, cast(case when o_orderkey % 3 = 0 then 1 else 0 end as int) as space, "
    "cast(case when o_orderkey % 2 = 0 then 13 else 16 end as int) as transfer, cast(o_custkey % 4 as int) as intent, cast(o_orderkey % 3 as int) as extra, cast(1 + o_custkey % 999 as bigint) as tps_num"
)


def _split(text: str) -> list[str]:
    """At the commas outside parentheses; no field here has one inside."""
    return text.split(", ")


def header_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Image headers written from fields and read back."""

    @F.pandas_udf("binary")
    def written(width: pd.Series, height: pd.Series, bits: pd.Series, orientation: pd.Series, space: pd.Series, transfer: pd.Series, intent: pd.Series, extra: pd.Series, tps: pd.Series) -> pd.Series:
        out = []
        for w, h, b, o, s, t, i, n, tick in zip(width, height, bits, orientation, space, transfer, intent, extra, tps, strict=True):
            image = codestream.lossless_header(w, h, 3, b, orientation=o, animation={"tps_num": tick, "tps_den": 1, "loops": 0, "timecodes": False})
            image["meta"]["colour"] |= {"space": s, "transfer": t, "intent": i}
            image["meta"]["extra"] = [{"type": k, "depth": {"exp_bits": 0, "bits": 8}, "dim_shift": 3, "name": f"n{k}", "associated": False} for k in range(n)]
            stream = entropy.BitWriter()
            headers.codestream_header(headers.Write(stream), image)
            out.append(stream.bytes())
        return pd.Series(out)

    given = base.table(spark, d, "orders").selectExpr(*_split(HEADS))
    fields = ("width", "height", "bits", "orientation", "space", "transfer", "intent", "extra", "tps_num")
    read = source.image_info(given.select("file", written(*fields).alias("data")))
    return read.select("file", *(F.size("extra").alias("extra") if c == "extra" else c for c in fields))


NUMBERS = "l_orderkey % 16 as book, l_orderkey * 8 + l_linenumber as i, cast(l_linenumber % 3 as int) as ctx, cast(round(l_extendedprice) as bigint) % 5000 as v"


def _through_code(prefix: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Numbers of each book under three contexts, coded with their header and read back."""

        def there_and_back(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["i", "ctx", "v"])
            numbers = list(zip(pdf["ctx"].tolist(), pdf["v"].tolist(), strict=True))
            w = entropy.BitWriter()
            histograms.write_numbers(w, numbers, 3, prefix)
            r = entropy.BitReader(w.bytes())
            reader = histograms.NumberReader(histograms.read_code(r, 3), r)
            got = [reader.read(c) for c, _ in numbers]
            reader.check()
            return pdf.assign(v=got)[["book", "i", "ctx", "v"]]

        rows = base.table(spark, d, "lineitem").selectExpr(*_split(NUMBERS))
        found = rows.groupBy("book").applyInPandas(there_and_back, "book long, i long, ctx int, v long")
        return found.groupBy("book", "ctx").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.sum(F.expr("v * (i % 101)")).alias("checksum"))

    return run


def alias_slots(spark: SparkSession, d: str) -> DataFrame:
    """How many of the 4096 values an alias table gives each symbol: its normalised count, by looking up every value."""

    def looked_up(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = [0] * 64
        for sym, n in zip(pdf["sym"], pdf["n"], strict=True):
            counts[sym] = int(n)
        table = histograms.Alias.of(entropy.normalised(counts), 6)
        got = pd.Series([table.lookup(v)[0] for v in range(histograms.TOTAL)]).value_counts()
        return pd.DataFrame({"book": pdf["book"].iloc[0], "sym": got.index, "c": got.to_numpy()})

    hist = base.table(spark, d, "lineitem").groupBy(F.expr("l_orderkey % 4").alias("book"), F.expr("cast(l_linenumber as int)").alias("sym")).agg(F.count(F.lit(1)).alias("n"))
    found = hist.groupBy("book").applyInPandas(looked_up, "book long, sym int, c long")
    return found.groupBy("book").agg(F.sum("c").alias("values"), F.count(F.lit(1)).alias("symbols"))


def special_distances(spark: SparkSession, d: str) -> DataFrame:
    """Short copy distances in rows of every part's size, by index."""
    table = spark.createDataFrame([(k, dx, dy) for k, (dx, dy) in enumerate(histograms.SPECIAL)], "k int, dx int, dy int")  # 120 rows
    parts = base.table(spark, d, "part").selectExpr("p_partkey", "cast(p_partkey % 120 as int) as k", "p_size as width")
    return parts.join(F.broadcast(table), "k").select("p_partkey", F.expr("cast(greatest(1, dx + dy * width) as bigint)").alias("distance"))


def flat_histogram(spark: SparkSession, d: str) -> DataFrame:
    books = base.table(spark, d, "nation").selectExpr("n_nationkey as book", "3 + n_nationkey * 7 % 61 as n")
    return books.select("book", "n", F.posexplode(F.expr("transform(sequence(0, n - 1), k -> 4096 div n + case when k < 4096 % n then 1 else 0 end)")).alias("sym", "c")).selectExpr("book", "cast(sym as bigint) as sym", "cast(c as bigint) as c")


def _tall(spark: SparkSession, d: str, side: int = 300) -> DataFrame:
    """The embedding plane as gray images of `side` rows, whose last may be lower."""
    return base.plane(spark, d).selectExpr(f"y div {side} as img", "c", f"y % {side} as y", "row")


def lossless_image_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Gray images in groups of 128 written as codestreams and read back, sample by sample."""
    rows = source.decode(source.encode(_tall(spark, d), group_shift=0))
    return rows.select((F.col("img") * 300 + F.col("y")).alias("y"), F.posexplode("row").alias("x", "v")).select("y", F.col("x").cast("long").alias("x"), "v")


def lossless_colour_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Three channels in one file each 96 rows: colour transform or palette, one section."""
    rows = base.plane(spark, d).selectExpr("y div 288 as img", "cast(y % 3 as int) as c", "y div 3 % 96 as y", "row")
    whole = rows.groupBy("img").agg(F.count(F.lit(1)).alias("n")).where("n % 3 = 0").select("img")
    got = source.decode(source.encode(rows.join(whole, "img", "left_semi")))
    sums = got.select("img", "c", F.posexplode("row").alias("x", "v"))
    return sums.groupBy("img", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.sum(F.expr("v * (x % 7)")).alias("checksum"))


def section_table(spark: SparkSession, d: str) -> DataFrame:
    """Sections by role of the images above."""
    return source.frame_rows(source.encode(_tall(spark, d), group_shift=0)).select(F.explode("sections").alias("s")).groupBy("s.role").agg(F.count(F.lit(1)).alias("n"))


BLOCK = "transform(sequence(0, 63), k -> cast(case when k = 0 then vec_id * 7 % 1801 - 900 when (vec_id + k) % 5 = 0 then (vec_id * k) % 41 - 20 else 0 end as int))"


def jpeg_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Blocks written as files of 256 and read back, coefficient by coefficient."""
    blocks = base.table(spark, d, "embeddings").selectExpr("vec_id div 256 as file", "cast(vec_id % 256 div 16 as int) as brow", "cast(vec_id % 16 as int) as bcol", f"{BLOCK} as block")
    read = jpegs.coefficients(jpegs.build(blocks, [1 + k for k in range(64)]))
    return read.select("file", F.posexplode("block").alias("k", "v")).groupBy("file", "k").agg(F.sum("v").alias("total"), F.sum((F.col("v") != 0).cast("long")).alias("nonzero"))


QUERIES = {
    "jpeg_coefficients": jpeg_coefficients,
    "header_round_trip": header_round_trip,
    "ans_numbers": _through_code(False),
    "prefix_numbers": _through_code(True),
    "alias_slots": alias_slots,
    "special_distances": special_distances,
    "flat_histogram": flat_histogram,
    "lossless_image_round_trip": lossless_image_round_trip,
    "lossless_colour_round_trip": lossless_colour_round_trip,
    "section_table": section_table,
}

_NUMBERS = f"with n as (select {NUMBERS} from lineitem) select book, ctx, count(*) as n, cast(sum(v) as bigint) as total, cast(sum(v * (i % 101)) as bigint) as checksum from n group by book, ctx"
_TALL = "with r as (select vec_id // 300 as img, max(vec_id % 300) + 1 as h from embeddings group by vec_id // 300)"
ORACLE_SQL = {
    "jpeg_coefficients": "with c as (select vec_id // 256 as file, vec_id, unnest(range(64)) as k from embeddings), v as (select file, k, case when k = 0 then vec_id * 7 % 1801 - 900 when (vec_id + k) % 5 = 0 then (vec_id * k) % 41 - 20 else 0 end as v from c) select file, cast(k as int) as k, cast(sum(v) as bigint) as total, cast(count(*) filter (v <> 0) as bigint) as nonzero from v group by file, k",
    "header_round_trip": f"select {HEADS} from orders",
    "ans_numbers": _NUMBERS,
    "prefix_numbers": _NUMBERS,
    "alias_slots": "select l_orderkey % 4 as book, cast(4096 as bigint) as values, count(distinct l_linenumber) as symbols from lineitem group by l_orderkey % 4",
    "special_distances": """with near as (select dx, dy from (select unnest(range(-7, 9)) as dx) cross join (select unnest(range(8)) as dy) where dy > 0 or dx > 0),
t as (select dx, dy, row_number() over (order by dx * dx + dy * dy, abs(dx), dx < 0) - 1 as k from near) select p_partkey, cast(greatest(1, dx + dy * p_size) as bigint) as distance from part join t on k = p_partkey % 120""",
    "flat_histogram": "with b as (select n_nationkey as book, 3 + n_nationkey * 7 % 61 as n from nation), s as (select book, n, unnest(range(n)) as sym from b) select book, sym, cast(4096 // n + case when sym < 4096 % n then 1 else 0 end as bigint) as c from s",
    "lossless_image_round_trip": f"with {base.PX} select y, x, v from px",
    "lossless_colour_round_trip": f"""with {base.PX}, m as (select y // 288 as img, y % 3 as c, x, v from px), w as (select img from m group by img having count(*) % 192 = 0)
select img, cast(c as int) as c, count(*) as n, cast(sum(v) as bigint) as total, cast(sum(v * (x % 7)) as bigint) as checksum from m join w using (img) group by img, c""",
    "section_table": f"""{_TALL}, s as (select case when h <= 128 then 1 else 0 end as lone, (h + 127) // 128 as groups, 1 as dc from r),
e as (select 'all' as role, sum(lone) as n from s union all select 'dc_global', sum(1 - lone) from s union all select 'dc_group', sum((1 - lone) * dc) from s union all select 'ac_global', sum(1 - lone) from s union all select 'ac_group', sum((1 - lone) * groups) from s)
select role, cast(n as bigint) as n from e where n > 0""",
}
