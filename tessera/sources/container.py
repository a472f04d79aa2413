"""Box containers: demultiplexing, reassembly of split codestreams, and writing."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the file format: the signature box, the bare start, and the type box.
SIGNATURE = bytes.fromhex("0000000c4a584c200d0a870a")
BARE = bytes.fromhex("ff0a")
FTYP = b"ftyp", b"jxl \x00\x00\x00\x00jxl "


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def kind(content: str = "content") -> Column:
    """bare, container or unknown, from the first bytes."""
    head = lambda n: F.expr(f"substring({content}, 1, {n})")
    return F.when(head(2) == F.lit(bytearray(BARE)), "bare").when(head(12) == F.lit(bytearray(SIGNATURE)), "container").otherwise("unknown")


def parse_boxes(data: bytes) -> list[tuple[int, str, int, int, int]]:
    """(ordinal, type, start, end, header size) of each top-level box; start and end bound the payload."""
    out, at = [], 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("truncated box header")
        size, head = struct.unpack_from(">I", data, at)[0], 8
        if size == 1:
            if at + 16 > len(data):
                raise ValueError("truncated box header")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = len(data) - at
        if size < head or at + size > len(data):
            raise ValueError("box runs past the end")
        out.append((len(out), data[at + 4 : at + 8].decode("latin-1"), at + head, at + size, head))
        at += size
    return out


def boxes(content: DataFrame) -> DataFrame:
    """path, ord, type, start, end, header_size, payload and status. A broken file gives the one row of its error."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "ord", "type", "start", "end", "header_size", "payload", "status"]
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                data = bytes(data)
                try:
                    rows += [(path, k, t, a, b, h, data[a:b], "ok") for k, t, a, b, h in parse_boxes(data)]
                except ValueError as e:
                    rows.append((path, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=columns)

    return content.select("path", "content").mapInPandas(parsed, "path string, ord int, type string, start long, end long, header_size int, payload binary, status string")


def codestreams(boxes_: DataFrame) -> DataFrame:
    """path, codestream and status: the one jxlc box, or the jxlp parts in the order of their numbers.

    Parts must be numbered from 0 without gaps or repeats, and the last flag must stand on the highest alone.
    """
    parts = boxes_.where("type in ('jxlc', 'jxlp')")
    number = F.conv(F.hex(F.expr("substring(payload, 1, 4)")), 16, 10).cast("long")
    marked = parts.withColumn("head", F.when(F.col("type") == "jxlp", number))
    marked = marked.withColumns({"no": F.col("head").bitwiseAND(0x7FFFFFFF), "last": F.col("head") >= (1 << 31)})
    body = F.when(F.col("type") == "jxlp", F.expr("substring(payload, 5)")).otherwise(F.col("payload"))
    grouped = marked.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("no", F.lit(-1)).alias("no"), "last", F.hex(body).alias("body")))).alias("p"),
        F.count(F.when(F.col("type") == "jxlc", 1)).alias("whole"),
    )
    right = F.expr("forall(transform(p, (x, k) -> x.no = k and x.last = (k = size(p) - 1)), ok -> ok)")
    joined = F.unhex(F.array_join(F.transform("p", lambda x: x["body"]), ""))
    single = F.unhex(F.element_at(F.filter("p", lambda x: x["no"] == -1), 1)["body"])
    ok = F.when(F.col("whole") > 0, F.lit("ok")).when(right, "ok").otherwise("parts don't fit")
    return grouped.select("path", F.when(F.col("whole") > 0, single).when(right, joined).alias("codestream"), ok.alias("status"))


def payload(boxes_: DataFrame, type_: str) -> DataFrame:
    """path and payload of the first top-level box of a type in each file; `brob` boxes of stored blocks are opened."""
    inner = F.when(F.col("type") == "brob", F.decode(F.substring("payload", 1, 4), "ISO-8859-1")).otherwise(F.col("type"))
    first = boxes_.where(inner == type_).groupBy("path").agg(F.min_by(F.struct("type", "payload"), "ord").alias("b"))

    @F.pandas_udf("binary")
    def opened(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else brotli_unstored(bytes(x)[4:]))

    wrapped = F.when(F.col("b.type") == "brob", F.col("b.payload"))
    return first.select("path", F.coalesce(opened(wrapped), F.col("b.payload")).alias("payload"))


def exif(boxes_: DataFrame) -> DataFrame:
    """The TIFF stream of each file: the payload after its 4-byte offset and the bytes that this skips."""
    skip = F.conv(F.hex(F.expr("substring(payload, 1, 4)")), 16, 10).cast("int")
    return payload(boxes_, "Exif").select("path", F.substring("payload", skip + 5, F.length("payload")).alias("tiff"))


def xmp(boxes_: DataFrame) -> DataFrame:
    return payload(boxes_, "xml ").select("path", F.decode("payload", "UTF-8").alias("xmp"))


def box(type_: bytes, body: bytes) -> bytes:
    size = len(body) + 8
    return struct.pack(">I", size) + type_ + body if size < 1 << 32 else struct.pack(">I4sQ", 1, type_, size + 8) + body


def exif_box(tiff: bytes) -> bytes:
    """A TIFF stream that starts right after its offset field."""
    return box(b"Exif", b"\0\0\0\0" + tiff)


def xmp_box(text: str) -> bytes:
    return box(b"xml ", text.encode())


def brotli_stored(data: bytes) -> bytes:
    """A Brotli stream that holds the data as it is: blocks of up to 64 KiB without compression, then an empty last one."""
    out = bytearray()
    for k in range(0, len(data), 1 << 16):
        part = data[k : k + (1 << 16)]
        # Lowest bit first: a window of 16 bits (in the first block), not the last, four nibbles of length, stored.
        head = (len(part) - 1) << 3 | 1 << 19
        out += (head << 1 if not k else head).to_bytes(3, "little") + part
    return bytes(out) + (b"\x03" if data else b"\x06")


def brotli_unstored(stream: bytes, most: int = 64 << 20) -> bytes:
    """What brotli_stored() was given; compressed blocks are refused."""
    out, at, first = bytearray(), 0, True
    while True:
        head = int.from_bytes(stream[at : at + 3], "little")
        if first:
            if head & 1:
                raise ValueError("only windows of 16 bits are read")
            head, first = head >> 1, False
        if head & 1:
            if not head & 2:
                raise ValueError("compressed blocks aren't read")
            return bytes(out)
        n = (head >> 3 & 0xFFFF) + 1
        if head & 6 or not head >> 19 & 1 or at + 3 + n > len(stream) or len(out) + n > most:
            raise ValueError("compressed blocks aren't read")
        out += stream[at + 3 : at + 3 + n]
        at += 3 + n


def brob_box(type_: bytes, body: bytes) -> bytes:
    return box(b"brob", type_ + brotli_stored(body))


def assemble(codestream: bytes, metadata: list[tuple[bytes, bytes]] = ()) -> bytes:
    return SIGNATURE + box(*FTYP) + b"".join(box(t, b) for t, b in metadata) + box(b"jxlc", codestream)
