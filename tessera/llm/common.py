"""What several text operators share: word and hold-out conventions, scratch tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a longest run of characters outside ASCII white space; bytes.split() finds the same runs in UTF-8.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"

#: A run of letters: characters of the Unicode categories L*. Digits, fractions and signs that look like letters aren't.
LETTERS = regex.compile(r"\p{L}+")

_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id, written as text, leaves `fold` modulo `folds`. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds) == F.lit(fold), F.lit(False))


def text_of(value) -> str:
    """A text cell as str: null is empty, and bytes that aren't UTF-8 become U+FFFD."""
    if value is None:
        return ""
    return value.decode("utf-8", "replace") if isinstance(value, bytes | bytearray | memoryview) else value


def letter_words(text: str | None) -> list[str]:
    """The runs of letters, in lower case. They are found before the case changes, so there is one for each span of it."""
    found = LETTERS.findall(text_of(text))
    return "\n".join(found).lower().split("\n") if found else []


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir.

    Where that is unset, a session in one process (local mode, as in tests) gets a local folder; on a cluster that is
    an error, since executors don't see each other's folders.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="tessera-")
        _roots[app] = f"{base.rstrip('/')}/tessera-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_clear, spark, _roots[app])
    return _roots[app]


def _clear(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder belongs to this application alone
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared scratch folder and read it back.

    This cuts lineage: a lost executor costs the reading of a file, never a second pass over the corpus, and
    what follows sees one fixed set of rows however often it is planned.
    """
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents_only(docs: DataFrame, *more: str) -> DataFrame:
    """The columns that an operator reads, so that other columns, whatever their names, never meet its own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


#: Rows in a bucket of ranks(), about.
BUCKET_ROWS = 4000


def ranks(df: DataFrame, group: str, order: list[str], n_rows: int, bucket_rows: int = BUCKET_ROWS, together: str | None = None, copies: str | None = None) -> DataFrame:
    """df with __rank, the place (from 0) of each row within its `group`, however many rows a group has.

    Rows are dealt into buckets of about `bucket_rows` of the largest group by a hash of `order`; the counts of
    the buckets, summed in two levels, give where each bucket starts, and rows are numbered inside a bucket. df must be
    a fixed table, and `order` tell its rows apart, so that repeated rows are dealt too.

    together: rows alike in this column get places next to each other; they share a bucket, or, where `copies` (their
    number) is more than bucket_rows, a run of buckets.
    """
    buckets = max(1, n_rows // bucket_rows)
    wide = max(1, int(buckets**0.5))
    if together:
        part = F.pmod(F.xxhash64(*order), F.expr(f"1 + {copies} div {bucket_rows}"))
        keyed = df.withColumn("__bucket", F.pmod(F.xxhash64(together), F.lit(buckets)) * F.lit(buckets + 1) + part)
    else:
        keyed = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = keyed.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn("__span", F.expr(f"__bucket div {wide}"))
    spans = counts.groupBy(group, "__span").agg(F.sum("__n").alias("__m"))

    def before(total: str, *keys: str) -> Column:
        over = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(total).over(over), F.lit(0))

    spans = spans.select(group, "__span", before("__m", group, "__span").alias("__first"))
    starts = counts.withColumn("__inside", before("__n", group, "__span", "__bucket")).join(spans, [group, "__span"])
    starts = starts.select(group, "__bucket", (F.col("__first") + F.col("__inside")).alias("__start"))
    local = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(*order)) - 1
    placed = keyed.withColumn("__local", local).join(starts, [group, "__bucket"])
    return placed.withColumn("__rank", F.col("__start") + F.col("__local")).drop("__bucket", "__local", "__start")


def thinned(rows: DataFrame, per_class: int, by: tuple[str, ...] = ("doc_id",), most_classes: int = 256) -> tuple[DataFrame, dict]:
    """At most `per_class` rows of each `label`, drawn by a hash of the columns `by`, and the rows of each label in all.

    A class is thinned by the share that leaves per_class of it, then rows alike in `by` are taken once and the first
    per_class by the hash are kept, so the size doesn't grow with the table, however many rows share an id or a text.
    The `most_classes` most frequent labels take part; the others teach nothing.
    """
    counted = rows.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["label"]: r["n"] for r in counted.orderBy(F.desc("n"), "label").limit(most_classes).collect()}
    if not counts:
        return rows.where("false"), {}
    scale = 1 << 40
    shares = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(scale, scale * per_class * 5 // (4 * n)))))
    drawn = rows.withColumn("__draw", F.xxhash64(*by, F.lit("sample"))).where(F.pmod("__draw", F.lit(scale)) < shares[F.col("label")])
    return first_drawn(drawn, "__draw", per_class), counts


def first_drawn(rows: DataFrame, draw: str, per_class: int) -> DataFrame:
    """The per_class rows of each label with the smallest values of the column `draw`, which goes; equal values count once."""
    once = rows.dropDuplicates(["label", draw])
    place = F.row_number().over(Window.partitionBy("label").orderBy(draw))
    return once.withColumn("__place", place).where(F.col("__place") <= per_class).drop("__place", draw)
