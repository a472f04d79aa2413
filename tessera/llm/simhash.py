"""Near-duplicates by SimHash fingerprints, pigeonhole blocks and connected components.

A fingerprint of 64 bits is split into `blocks` parts. Two that differ in at most `radius` bits agree on at
least blocks - radius parts, so every choice of that many parts is a key, and close pairs share one. Work runs
over different fingerprints, never over copies: a copy has its original's fingerprint.

- A key that one fingerprint has links nothing. A key with two gives one pair. A key with up to `crowd`
  fingerprints is joined with itself. Every pair is verified by its Hamming distance.
- A key with more is not joined with itself. Its fingerprints go to the exact way for radius 2: each is
  linked with the 64 words one bit away from it and with itself. Two fingerprints differ in at most two bits
  if and only if these sets meet, and a word is met by at most 65 fingerprints, so the links number 65 for each
  fingerprint however crowded the key is, and components come out as they would from all pairs.

Components come from rounds of large and small stars over the links, each a join and an aggregation, until
nothing changes.

Null and empty texts, and texts without words, have fingerprint zero and are linked like any other. Repeated
rows have the same fingerprint. A null doc_id has a fingerprint but is never the smallest id of a component
unless there is no other; then component_id is null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_only, materialise, text_of

WORDS, SEED, BLOCKS, RADIUS, CROWD = 3, 42, 4, 2, 64


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits; bit k is 1 if it is 1 in more than half of the hashes of the shingles, repeats counted."""
    # bytes.lower() changes A-Z alone, and bytes.split() splits at ASCII white space.
    seq = text_of(text).encode("utf-8", "replace").lower().split()
    if not seq:
        return 0
    n = len(seq)
    joined = b" ".join(seq)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, seq), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - words] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, n - words + 1)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(words: int = WORDS, seed: int = SEED):
    """A column function: text to the fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, words, seed) for x in texts], np.uint64).view(np.int64))

    return of


def _keys(blocks: int, radius: int) -> Column:
    """Each choice of blocks - radius parts: its number, and the fingerprint with all other bits cleared."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    keys = []
    for no, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(parts[k] for k in chosen)
        keys.append(F.struct(F.lit(no).alias("no"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.explode(F.array(*keys))


def close(prints: DataFrame, blocks: int = BLOCKS, radius: int = RADIUS, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different `fp` at `radius` bits or fewer that share a key with a crowd or fewer, and, for those that share
    a crowded key, each word with the fps (65 at most) that are one bit away or fewer. Every pair at `radius` bits is in either.

    prints: a fixed table with a column fp, each value once.
    """
    if not 0 < radius <= 2:
        raise ValueError("the exact way for crowded keys covers a radius of 1 or 2")
    keyed = prints.select("fp", _keys(blocks, radius).alias("key")).select("fp", "key.*")
    sizes = materialise(keyed.groupBy("no", "bits").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "keys")
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= radius
    twos = sizes.where("n = 2").where(near("a", "b")).select("a", "b")
    shared = keyed.join(sizes.where("n > 2").select("no", "bits", "n"), ["no", "bits"])
    shared = materialise(shared, "shared")
    small = shared.where(F.col("n") <= crowd)
    left, right = small.select("no", "bits", F.col("fp").alias("a")), small.select("no", "bits", F.col("fp").alias("b"))
    pairs = left.join(right, ["no", "bits"]).where("a < b").where(near("a", "b")).select("a", "b")
    # Crowded keys: each fingerprint once, whichever keys it crowds. Pairs between words one bit away link at
    # 2 bits; for a radius of 1, a word must be one of the two fingerprints.
    crowded = shared.where(F.col("n") > crowd).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << k) - (1 << 64) if k == 63 else 1 << k) for k in range(64)))
    words = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    met = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.collect_list("fp").alias("fps")).where("n > 1")  # 65 at most
    return twos.unionByName(pairs), met


def links(prints: DataFrame, blocks: int = BLOCKS, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of different `fp` at `radius` bits or fewer.

    prints: a fixed table with a column fp, each value once.
    """
    return linked(*close(prints, blocks, radius, crowd), radius)


def linked(pairs: DataFrame, met: DataFrame, radius: int = RADIUS) -> DataFrame:
    """links() from what close() found."""
    if radius == 1:
        met = met.where(F.array_contains("fps", F.col("word"))).select(F.col("word").alias("a"), F.explode("fps").alias("b"))
    else:
        met = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return pairs.unionByName(met.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Every node of the edges (a, b) with `root`, the smallest node of its component, by alternating stars."""

    def mirrored(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Links every larger (or smaller) neighbour of a node, and the node, to the least of them all."""
        both = mirrored(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a != b").distinct()

    def state(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    seen = state(now)
    while True:
        after = materialise(star(star(now, True), False), "stars")
        then = state(after)
        if then == seen:
            break
        now, seen = after, then
    rooted = after.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return rooted.unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, blocks: int = BLOCKS, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """doc_id, fp (signed) and component_id (the smallest doc_id that links lead to) of every document."""
    printed = materialise(documents_only(docs).select("doc_id", fingerprints(words, seed)("text").alias("fp")), "prints")
    return classed(printed, "doc_id", blocks, radius, crowd)


def classed(printed: DataFrame, least: str, blocks: int = BLOCKS, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """printed (a fixed table with fp) with component_id: the least value of the column `least` in its component."""
    prints = materialise(printed.groupBy("fp").agg(F.min(least).alias("low")), "distinct")
    roots = materialise(components(links(prints.select("fp"), blocks, radius, crowd)), "roots")
    members = prints.join(roots, F.col("fp") == F.col("node"))
    lows = members.groupBy("root").agg(F.min("low").alias("component_id"))
    moved = materialise(members.join(lows, "root").select("fp", "component_id"), "moved")
    joined = prints.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    return printed.join(joined, "fp").select(*printed.columns, "component_id")


def hexadecimal(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def first_of_each(docs: DataFrame, words: int = WORDS, seed: int = SEED, similarity: tuple[int, int] | None = None) -> DataFrame:
    """One document of each component: the one with the smallest doc_id, or one of them where rows repeat.

    Links are fingerprints within the radius, or, with `similarity` (a fraction), sets of shingles whose Jaccard
    similarity is that or more. Then fingerprints within the radius are checked by that similarity, and `nearsets` adds
    the links that lie beyond: sets at 0.8 have fingerprints up to 11 bits and more apart.
    """
    if similarity:
        from . import nearsets

        return nearsets.first_of_each(docs, words, similarity)
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row"))
    whole = materialise(docs.withColumns({"__row": row, "__fp": fingerprints(words, seed)("text")}), "printed")
    groups = classed(whole.select(F.col("__fp").alias("fp"), F.col("__row").alias("row")), "row")
    kept = groups.where("row = component_id").select(F.col("row.row").alias("__kept"))
    return whole.join(kept, F.col("__row.row") == F.col("__kept"), "left_semi").drop("__row", "__fp")
