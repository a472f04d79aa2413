"""Codestreams as tables: headers, frames and sections of many files, and lossless images written and read by group.

files: file and data (binary). A group's section needs nothing from other groups, so groups are tasks of their own when
images are written and when they are read; a file's headers are read once for its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codestream, entropy, headers
from ..operators import planes

INFO = (
    "width int, height int, bits int, exp_bits int, xyb boolean, orientation int, space int, white int, primaries int, transfer int, gamma int, intent int, want_icc boolean, "
    "extra array<struct<type: int, bits: int, dim_shift: int, name: string, associated: boolean>>, intensity double, tps_num long, tps_den long, loops long"
)
FRAME = "frame int, type int, modular boolean, x0 int, y0 int, width int, height int, duration long, is_last boolean, blend int, source int, save_as int, group_shift int, passes int, upsampling int, name string"


def _info(image: headers.Fields) -> dict:
    meta, colour = image["meta"], image["meta"]["colour"]
    animation = meta.get("animation") or {}
    extra = [{"type": x["type"], "bits": x["depth"]["bits"], "dim_shift": x["dim_shift"], "name": x["name"], "associated": x["associated"]} for x in meta["extra"]]
    return {
        **image["size"],
        **meta["depth"],
        "xyb": meta["xyb"],
        "orientation": meta["orientation"],
        **{k: colour[k] for k in ("space", "white", "primaries", "transfer", "gamma", "intent", "want_icc")},
        "extra": extra,
        "intensity": (meta.get("tone") or {}).get("intensity", 255.0),
        **{k: animation.get(k) for k in ("tps_num", "tps_den", "loops")},
    }


def image_info(files: DataFrame) -> DataFrame:
    """file and the fields of its image header, without touching samples; all null where there is no codestream."""

    @F.pandas_udf(INFO)
    def info(data: pd.Series) -> pd.DataFrame:
        names = [x.strip().split(" ")[0] for x in INFO.split(", ") if ":" not in x or x.startswith("extra")]
        rows = []
        for raw in data:
            try:
                rows.append(_info(headers.codestream_header(headers.Read(entropy.BitReader(raw or b"")))))
            except ValueError:
                rows.append(dict.fromkeys(names))
        return pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("file", info("data").alias("i")).select("file", "i.*")


def frame_rows(files: DataFrame) -> DataFrame:
    """A row for each frame with its header fields, and its sections: role, offset in the codestream, size."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, data in zip(batch["file"], batch["data"], strict=True):
                _, _, frames = codestream.read_heads(bytes(data))
                for k, f in enumerate(frames):
                    h, crop = f.header, f.header["crop"] or {}
                    sections = [{"idx": i, "role": codestream.role_of(i, f.grid), "offset": at, "size": n} for i, (at, n) in enumerate(f.sections)]
                    out.append(
                        (file, k, h["type"], h["modular"], crop.get("x", 0), crop.get("y", 0), f.grid["width"], f.grid["height"], h["duration"], h["is_last"])
                        + (h["blend"]["mode"], h["blend"]["source"], h["save_as"], h["group_shift"], h["passes"]["n"], h["upsampling"], h["name"], sections)
                    )
            yield pd.DataFrame(out, columns=["file", *(x.split(" ")[0] for x in FRAME.split(", ")), "sections"])

    return files.select("file", "data").mapInPandas(rows, f"file long, {FRAME}, sections array<struct<idx: int, role: string, offset: long, size: long>>")


def section_data(files: DataFrame) -> DataFrame:
    """A row for each section with its bytes: file, frame, idx, role, size, data."""
    cut = frame_rows(files).select("file", "frame", F.explode("sections").alias("s")).select("file", "frame", "s.*")
    whole = files.select("file", F.col("data").alias("__data"))
    return cut.join(whole, "file").select("file", "frame", "idx", "role", "size", F.expr("substring(__data, cast(offset + 1 as int), cast(size as int))").alias("data"))


def encode(rows: DataFrame, bits: int = 8, group_shift: int = 1) -> DataFrame:
    """rows (img, c, y, row) as lossless codestreams: file and data. All channels of an image have one shape.

    Groups are written by themselves; the sections of an image meet when its file is put together.
    """
    side = 128 << group_shift
    shapes = rows.groupBy("img").agg((F.max("y") + 1).cast("int").alias("height"), F.max(F.size("row")).alias("width"), (F.max("c") + 1).cast("int").alias("channels"))
    parts = planes.regroup(rows.select("img", "c", "y", "row"), side).join(shapes, "img")

    def section(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        height, width, gy, gx = (int(first[k]) for k in ("height", "width", "gy", "gx"))
        made = [np.array(g.sort_values("y")["row"].to_list()) for _, g in pdf.groupby("c")]
        across, dc = -(-width // side), -(-width // (8 * side)) * -(-height // (8 * side))
        g = gy * across + gx
        if max(width, height) <= side:
            raw = codestream.lone_section(made, bits)
        else:
            raw = codestream.group_bytes(made, 1 + 3 * dc + codestream.QUANT_TABLES + g, bits)
        return pd.DataFrame([(first["img"], height, width, int(first["channels"]), g, raw)], columns=["img", "height", "width", "channels", "g", "data"])

    sections = parts.groupBy("img", "gy", "gx").applyInPandas(section, "img long, height int, width int, channels int, g int, data binary")
    gathered = sections.groupBy("img", "height", "width", "channels").agg(F.array_sort(F.collect_list(F.struct("g", "data"))).alias("of"))

    @F.pandas_udf("binary")
    def file(heights: pd.Series, widths: pd.Series, channels: pd.Series, of: pd.Series) -> pd.Series:
        out = []
        for height, width, n, groups in zip(heights, widths, channels, of, strict=True):
            image, frame = codestream.lossless_header(int(width), int(height), int(n), bits), codestream.lossless_frame(group_shift)
            found = [bytes(x["data"]) for x in groups]
            if max(width, height) > side:
                dc = -(-width // (8 * side)) * -(-height // (8 * side))
                found = [codestream.dc_global_bytes(), *[b""] * (dc + 1), *found]
            out.append(codestream.assemble(image, frame, found))
        return pd.Series(out)

    return gathered.select(F.col("img").alias("file"), file("height", "width", "channels", F.col("of")).alias("data"))


def decode(files: DataFrame) -> DataFrame:
    """The first frame of each file as rows (img, c, y, row); lossless frames only.

    A frame whose own stream has no transforms is read group by group: its sections are dealt over the cluster with the
    file's front, which has the headers and the tree that groups may share. Other frames are read by one call each.
    """

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["file"], batch["data"], strict=True):
                data = bytes(data)
                image, _, frames = codestream.read_heads(data)
                f, out = frames[0], []
                start, size = f.sections[0]
                layout = codestream.empty_layout(image, f)
                r = entropy.BitReader(data[start : start + size])
                alone = f.grid["sections"] == 1 or f.header["passes"]["n"] > 1 or codestream.read_dc_global(r, f, layout)[0]["transforms"] or layout.meta
                alone = alone or any(max(c.shape) <= f.grid["group"] or c.hshift >= 3 for c in layout.channels)
                if alone:
                    out.append((file, -1, data, None))
                else:
                    lying = min(at for at, _ in f.sections)
                    front = data[:lying] + data[start : start + size]
                    for g in range(f.grid["groups"]):
                        at, n = f.sections[2 + f.grid["dc_groups"] + g]
                        out.append((file, g, front, data[at : at + n]))
                for k in range(0, len(out), 64):
                    yield pd.DataFrame(out[k : k + 64], columns=["file", "g", "front", "data"])

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                front = bytes(row.front)
                r = entropy.BitReader(front)
                image = headers.codestream_header(headers.Read(r))
                if image["meta"]["colour"]["want_icc"]:
                    codestream.read_icc(r)
                f = codestream.read_frame_head(r, image)
                if row.g < 0:
                    found = [(c, 0, 0, v) for c, v in enumerate(codestream.read_planes(front, image, f))]
                else:
                    layout = codestream.empty_layout(image, f)
                    _, whole = codestream.read_dc_global(entropy.BitReader(front[r.at // 8 :]), f, layout)
                    found = codestream.read_group(bytes(row.data), layout, f.grid, int(row.g), codestream.group_stream(f.grid, int(row.g)), whole, 0, 2)
                out = [(row.file, c, y + k, x, line.astype(np.int32)) for c, y, x, v in found for k, line in enumerate(v)]
                yield pd.DataFrame(out, columns=["img", "c", "y", "x0", "row"])

    dealt = files.select("file", "data").mapInPandas(tasks, "file long, g int, front binary, data binary").repartition("file", "g")
    pieces = dealt.mapInPandas(parts, "img long, c int, y long, x0 int, row array<int>")
    met = pieces.groupBy("img", "c", "y").agg(F.array_sort(F.collect_list(F.struct("x0", "row"))).alias("of"))
    return met.select("img", "c", "y", F.flatten(F.transform("of", lambda p: p["row"])).alias("row"))
