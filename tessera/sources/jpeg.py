"""JPEG files as tables: their segments, and the quantised coefficients of their scans. files: file and data (binary)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jpeg


def segments(files: DataFrame) -> DataFrame:
    """file, no, marker, kind (jfif, exif, xmp, icc, adobe, comment or other), size and payload of every segment before the scan."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(file, k, m, jpeg.kind_of(m, body), len(body), body) for file, data in zip(batch["file"], batch["data"], strict=True) for k, (m, body) in enumerate(jpeg.parse(bytes(data)).segments)]
            yield pd.DataFrame(out, columns=["file", "no", "marker", "kind", "size", "payload"])

    return files.select("file", "data").mapInPandas(rows, "file long, no int, marker int, kind string, size long, payload binary")


def profiles(found: DataFrame) -> DataFrame:
    """file and the ICC profile that its segments hold in numbered parts; null where a part is missing. found: segments()."""
    part = found.where("kind = 'icc'").select("file", F.conv(F.hex(F.substring("payload", 13, 1)), 16, 10).cast("int").alias("k"), F.conv(F.hex(F.substring("payload", 14, 1)), 16, 10).cast("int").alias("n"), F.expr("substring(payload, 15, length(payload))").alias("body"))
    met = part.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("k", F.hex("body").alias("body"), "n"))).alias("p"))
    right = F.expr("forall(transform(p, (x, i) -> x.k = i + 1 and x.n = size(p)), ok -> ok)")
    return met.select("file", F.when(right, F.unhex(F.array_join(F.transform("p", lambda x: x["body"]), ""))).alias("profile"))


def coefficients(files: DataFrame) -> DataFrame:
    """file, c, brow, bcol and the 64 coefficients of every block, in natural order."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["file"], batch["data"], strict=True):
                for c, part in enumerate(jpeg.parse(bytes(data)).components):
                    down, across = part.blocks.shape[:2]
                    at = np.indices((down, across)).reshape(2, -1)
                    yield pd.DataFrame({"file": file, "c": c, "brow": at[0], "bcol": at[1], "block": list(part.blocks.reshape(-1, 64))})

    return files.select("file", "data").mapInPandas(rows, "file long, c int, brow int, bcol int, block array<int>")


def rewritten(files: DataFrame) -> DataFrame:
    """file, and whether coding its coefficients again gives the same bytes."""

    @F.pandas_udf("boolean")
    def same(data: pd.Series) -> pd.Series:
        return data.map(lambda x: jpeg.write(jpeg.parse(bytes(x))) == bytes(x)).astype(bool)

    return files.select("file", same("data").alias("same"))


def build(blocks: DataFrame, quant: list[int]) -> DataFrame:
    """blocks (file, brow, bcol, block) of one component each to files: file and data."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        down, across = int(pdf["brow"].max()) + 1, int(pdf["bcol"].max()) + 1
        c = jpeg.Component(1, 1, 1, 0, blocks=np.zeros((down, across, 64), np.int32))
        for row in pdf.itertuples(index=False):
            c.blocks[row.brow, row.bcol] = row.block
        made = jpeg.write(jpeg.build(8 * across, 8 * down, [c], {0: quant}))
        return pd.DataFrame({"file": pdf["file"].iloc[:1], "data": [made]})

    return blocks.select("file", "brow", "bcol", "block").groupBy("file").applyInPandas(one, "file long, data binary")
