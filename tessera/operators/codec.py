"""Planes to bytes and back, many at once: each plane is one call, so a job is as parallel as its planes."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import entropy

SPLIT = 16


def encode_plane(v: np.ndarray) -> bytes:
    """Size, histogram and rANS of the tokens of gradient residuals, then their raw bits."""
    h, w = v.shape
    v = v.astype(np.int64)
    left, top, corner = (np.zeros_like(v) for _ in range(3))
    left[:, 1:], top[1:], corner[1:, 1:] = v[:, :-1], v[:-1], v[:-1, :-1]
    left[1:, :1], top[:1], corner[:1], corner[1:, :1] = v[:-1, :1], left[:1], left[:1], v[:-1, :1]
    low, high = np.minimum(left, top), np.maximum(left, top)
    pred = np.where(corner > high, low, np.where(corner < low, high, left + top - corner))
    u = np.where(v >= pred, 2 * (v - pred), 2 * (pred - v) - 1).ravel().tolist()
    tokens, bits = [], entropy.BitWriter()
    for x in u:
        if x < SPLIT:
            tokens.append(x)
        else:
            n = x.bit_length() - 1
            tokens.append(SPLIT + n - 4)
            bits.write(x - (1 << n), n)
    hist = np.bincount(tokens, minlength=1).tolist() if tokens else []
    counts = entropy.normalised(hist) if tokens else []
    coded = entropy.rans_encode(tokens, counts) if tokens else b""
    head = struct.pack("<IIHI", h, w, len(counts), len(coded)) + struct.pack(f"<{len(counts)}H", *counts)
    return head + coded + bits.bytes()


def decode_plane(data: bytes) -> np.ndarray:
    """Undoes encode_plane; the samples are a raster recurrence, each needs those before it."""
    h, w, n_counts, n_coded = struct.unpack_from("<IIHI", data)
    at = 14 + 2 * n_counts
    counts = list(struct.unpack_from(f"<{n_counts}H", data, 14))
    v = np.zeros((h, w), np.int64)
    if not h * w:
        return v
    tokens = entropy.rans_decode(data[at : at + n_coded], h * w, counts)
    bits, k = entropy.BitReader(data[at + n_coded :]), 0
    rows = [[0] * w for _ in range(h)]
    for y in range(h):
        row, above = rows[y], rows[y - 1] if y else None
        for x in range(w):
            t = tokens[k]
            u = t if t < SPLIT else (1 << t - SPLIT + 4) + bits.read(t - SPLIT + 4)
            left = row[x - 1] if x else above[x] if above else 0
            top = above[x] if above else left
            corner = above[x - 1] if above and x else left
            low, high = min(left, top), max(left, top)
            pred = low if corner > high else high if corner < low else left + top - corner
            row[x] = pred + (-(u + 1) // 2 if u & 1 else u // 2)
            k += 1
    return np.array(rows, np.int64)


def encode(rows: DataFrame) -> DataFrame:
    """rows (img, c, y, row) to img, c, data."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(pdf.sort_values("y")["row"].to_list())
        return pd.DataFrame([(pdf["img"].iloc[0], pdf["c"].iloc[0], encode_plane(v))], columns=["img", "c", "data"])

    return rows.select("img", "c", "y", "row").groupBy("img", "c").applyInPandas(one, "img long, c int, data binary")


def decode(coded: DataFrame) -> DataFrame:
    """img, c, data to rows (img, c, y, row)."""

    @F.pandas_udf("array<array<int>>")
    def planes(data: pd.Series) -> pd.Series:
        return data.map(lambda d: [r.tolist() for r in decode_plane(bytes(d)).astype(np.int32)])

    return coded.select("img", "c", F.posexplode(planes("data")).alias("y", "row"))
