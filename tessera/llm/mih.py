"""Nearest neighbours by inner product with multi-index hashing over learned binary codes.

Codes: vectors are centred and turned by rotations learned on a bounded sample (iterative quantisation, one
rotation for each 64 bits), and the signs are the bits. A code is split into substrings, each with an index from its
value to the rows that have it, whose vectors lie next to each other there.

A query probes the values whose signs have an inner product of at least `reach` with the query's own turned vector: the
values that it would have if the bits that it is least sure of were flipped. Rows of probed values are the candidates. They
are verified by the inner product of the original vectors: first in single precision, with what that can be wrong by
added, against the k-th best known so far, and those that are left exactly. `reach` is fitted to the table: the true neighbours of up to 256
queries are looked up among all rows, and it is set so that the share `cover` of them is found by a substring. A block
in which the candidates would be as many as the rows is read once instead.

Rows are dealt into index blocks, queries into query blocks, and each pair of blocks is one task with bounded
memory; the best of each are merged. A query that finds fewer than k is searched again with all values probed, so it
gets k rows wherever there are as many.

Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without a vec_id. Rows
with one vec_id are one row: of different vectors the least in array order stands for it. A vector is compared with
those of its own length; lengths other than the sample's most frequent have no codes and are compared in full, and so
are vectors too long or short for single precision. Ties go to the smaller vec_id. A row is no neighbour of itself. Scores
are rounded once from exact sums; beyond the range of doubles they are infinite. An empty table, or one without queries,
gives no rows. Other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BITS, SAMPLE, K = 256, 4096, 20
#: Pairs of a query and a row compared at once, and pairs kept until the best are taken; they bound a task's memory.
AT_ONCE, KEPT = 1 << 20, 1 << 21
#: Substrings of a code that are indexed at most, rows that a value of one has about, and its bits at most.
TABLES, PER_VALUE, WIDEST = 16, 48, 10
#: Queries in a block of them, about; index blocks of a table, and rows in one at most, from where their number grows.
QUERIES, ROW_BLOCKS, BLOCK = 32768, 16, 65536
#: Share of the true neighbours of so many sampled queries, among all rows, that must be found by a substring.
COVER, ASKED = 0.98, 256


@dataclass
class Codes:
    centre: np.ndarray
    turn: np.ndarray  # (dimensions, bits)
    width: int = WIDEST  # bits of a substring
    reach: float = -np.inf

    def bits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.turn > 0

    @property
    def tables(self) -> int:
        return max(1, min(TABLES, self.turn.shape[1] // self.width))

    def values(self, x: np.ndarray) -> np.ndarray:
        """(tables, rows): the substrings as numbers."""
        bits = self.bits(x)[:, : self.tables * self.width].reshape(len(x), self.tables, self.width)
        return (bits @ (1 << np.arange(self.width))).T

    def turned(self, q: np.ndarray) -> np.ndarray:
        """(tables, queries, width): what the signs of a substring count for a query of length 1. It isn't centred, since products aren't."""
        p = q @ self.turn[:, : self.tables * self.width] / np.sqrt((q * q).sum(1))[:, None]
        return p.reshape(len(q), self.tables, self.width).transpose(1, 0, 2)

    def nearness(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For each query, and the row beside it, the greatest reach by which a substring finds the row."""
        signs = np.where(self.bits(x)[:, : self.tables * self.width], 1.0, -1.0).reshape(len(x), self.tables, self.width)
        return (self.turned(q).transpose(1, 0, 2) * signs).sum(2).max(1)


def learn(sample: np.ndarray, bits: int = BITS, seed: int = 5, rounds: int = 25) -> Codes:
    """Rotations by iterative quantisation."""
    rng = np.random.default_rng(seed)
    centre = sample.mean(0)
    v = sample - centre
    _, _, axes = np.linalg.svd(v, full_matrices=False)
    turns = []
    dims = min(64, len(axes))
    z = v @ axes[:dims].T
    while sum(t.shape[1] for t in turns) < bits:
        r = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
            r = (u @ w).T
        turns.append(axes[:dims].T @ r)
    return Codes(centre, np.concatenate(turns, axis=1)[:, :bits])


def reaches(radius: int, parts: int) -> list[int]:
    """How far each substring is probed; -1: not at all."""
    s, a = divmod(radius, parts)
    return [s if k <= a else s - 1 for k in range(parts)]


class Index:
    """All codes within a Hamming distance, for codes whose radius is small: substrings of 16 bits, their values, and the rows of each value.

    By the pigeonhole principle a code within `radius` bits of a query's has, with m substrings and radius = m * s + a, a
    substring within s bits among the first a + 1 or one within s - 1 bits among the others.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        self.tables = []
        for part in words.view("<u2").T:
            values, of, n = np.unique(part, return_inverse=True, return_counts=True)
            self.tables.append((values, of, np.argsort(of, kind="stable"), np.cumsum(n) - n, n))

    def within(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """(queries, rows): whether the code is within `radius` bits, by probing and then verifying what was found."""
        found = np.zeros((len(queries), len(self.words)), bool)
        for (values, of, rows, start, n), asked, reach in zip(self.tables, queries.view("<u2").T, reaches(radius, len(self.tables)), strict=True):
            if reach < 0:
                continue
            if sum(math.comb(16, k) for k in range(reach + 1)) >= len(values):
                # More ways to flip bits than values: the table is read instead of asked.
                found |= (np.bitwise_count(asked[:, None] ^ values[None, :]) <= reach)[:, of]
                continue
            query, value = probed(asked, values, reach)
            row = rows[np.repeat(start[value] - np.cumsum(n[value]) + n[value], n[value]) + np.arange(n[value].sum())]
            found[np.repeat(query, n[value]), row] = True
        query, row = np.nonzero(found)
        far = np.bitwise_count(self.words[row] ^ queries[query]).sum(1) > radius
        found[query[far], row[far]] = False
        return found


def probed(asked: np.ndarray, values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, value): the values of a table within `reach` bits of what each query has there, each way to flip looked up."""
    flips = np.array([sum(1 << b for b in chosen) for k in range(reach + 1) for chosen in combinations(range(16), k)], np.uint16)
    wanted = asked[:, None] ^ flips[None, :]
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    query, flip = np.nonzero(values[at] == wanted)
    return query, at[query, flip]


def exact_product(a: list[float], b: list[float]) -> float:
    """The inner product, rounded once; infinite where it is beyond the range of doubles."""
    products = [x * y for x, y in zip(a, b, strict=True)]
    if all(map(math.isfinite, products)):
        try:
            return math.fsum(products)  # products of two single floats are exact in double
        except OverflowError:
            pass
    total = sum(Fraction(x) * Fraction(y) for x, y in zip(a, b, strict=True))
    try:
        return float(total)
    except OverflowError:
        return math.inf if total > 0 else -math.inf


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """exact_product of each row of a and the row of b beside it, both usual()."""
    p = np.ascontiguousarray((a * b).T)
    total, rest = p[0].copy(), np.zeros(len(a))
    for x in p[1:]:
        new = total + x
        part = new - total
        rest += (total - (new - part)) + (x - part)
        total = new
    out = total + rest
    part = out - total
    left = (total - (out - part)) + (rest - part)
    # Where what is left over is about half of the last place, the sum is made whole.
    off = 4e-32 * p.shape[0] ** 2 * np.abs(p).sum(0) + 1e-9 * np.abs(left) + 1e-290
    for k in np.flatnonzero((np.abs(np.abs(left) - np.spacing(np.abs(out)) / 2) <= off) | (np.abs(np.frexp(out)[0]) == 0.5)):
        out[k] = exact_product(a[k].tolist(), b[k].tolist())
    return out


def search(queries: pd.DataFrame, rows: pd.DataFrame, codes: Codes, k: int) -> pd.DataFrame:
    """query_id, vec_id and score of the k best rows that each query finds. vec_ids are different."""
    out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
    sizes = rows["embedding"].map(len).to_numpy(), queries["embedding"].map(len).to_numpy()
    for width in np.unique(sizes[1]):
        mine = rows[sizes[0] == width].sort_values("vec_id", kind="stable", ignore_index=True)
        asked = queries[sizes[1] == width]
        if len(mine):
            out.append(_search(asked, mine, codes if width == len(codes.centre) else None, k))
    return pd.concat(out, ignore_index=True)


def usual(x: np.ndarray) -> np.ndarray:
    """Whether a vector's length, and products of two such, are well within single precision."""
    with np.errstate(over="ignore"):
        return (np.abs(x).max(1) < 1e14) & (np.abs(x).max(1) > 1e-14)


def _search(queries: pd.DataFrame, rows: pd.DataFrame, codes: Codes | None, k: int) -> pd.DataFrame:
    x, q = (np.stack(f["embedding"].to_list()).astype(np.float64) for f in (rows, queries))
    ids, query_ids = rows["vec_id"].to_numpy(np.int64), queries["vec_id"].to_numpy(np.int64)
    # Of rows with one and the same vector only the first k + 1 ids can be among the best k of any query.
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    keep = pd.Series(same.ravel()).groupby(same.ravel()).cumcount().to_numpy() <= k
    x, ids = x[keep], ids[keep]
    fine, asked = usual(x), usual(q)
    pairs = []
    if fine.any() and asked.any():
        some, those = np.flatnonzero(fine), np.flatnonzero(asked)
        at, row = candidates(q[those], query_ids[those], x[some], ids[some], codes, k)
        at, row = those[at], some[row]
        score = np.concatenate([np.zeros(0), *(exact_products(q[at[n : n + 16384]], x[row[n : n + 16384]]) for n in range(0, len(at), 16384))])
        pairs.append((at, row, score))
    for these, others in ((np.flatnonzero(asked), np.flatnonzero(~fine)), (np.flatnonzero(~asked), np.arange(len(x)))):
        listed = [x[n].tolist() for n in others]
        for n in these if listed else ():
            pairs.append((np.full(len(others), n), others, np.array([exact_product(q[n].tolist(), v) for v in listed])))
    at, row, score = (np.concatenate(c) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 3
    good = ids[row] != query_ids[at]
    found = pd.DataFrame({"query_id": query_ids[at[good]], "vec_id": ids[row[good]], "score": score[good] + 0.0})
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], ignore_index=True)
    return found[found.groupby("query_id").cumcount() < k]


def candidates(q: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, codes: Codes | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row): the rows found by a substring, without those that are surely worse than k others. All rows, where there are no codes."""
    wrong = np.float32((x.shape[1] + 8) * 2.0**-23)  # what a product in single precision is wrong by at most, as a share of both lengths
    lengths, asked = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    # With one more coordinate the product is never less than the true one.
    rows = np.concatenate([x, lengths[:, None]], axis=1).astype(np.float32)
    mine = np.concatenate([q, wrong * asked[:, None]], axis=1).astype(np.float32)
    best = Best(len(q), len(x), query_ids, ids, 2.1 * wrong * asked, lengths, k)
    sample = np.linspace(0, len(x) - 1, min(len(x), max(2 * k + 2, min(1024, len(x) // 16)))).astype(int)
    every = np.arange(len(q))
    step = max(1, AT_ONCE // len(sample))
    for n in range(0, len(q), step):
        part = slice(n, n + step)
        products = mine[part] @ rows[sample].T
        if len(sample) > k:
            least = products - (2.1 * wrong * asked[part, None] * lengths[sample]).astype(np.float32)
            best.least[part] = np.partition(least, len(sample) - k - 1, axis=1)[:, len(sample) - k - 1]  # one may be the query itself
        best.add(every[part], sample, products)
    if codes is None or looked_at(codes, q[:: max(1, len(q) // 256)], x) >= 1:
        for n in range(0, len(x), 4096):
            best.compare(mine, every, rows, np.arange(n, min(len(x), n + 4096)))
        return best.pairs()
    signs = np.where(np.arange(1 << codes.width)[:, None] >> np.arange(codes.width) & 1, 1, -1).astype(np.float32)
    for turned, value in zip(codes.turned(q).astype(np.float32), codes.values(x), strict=True):
        order = np.argsort(value, kind="stable")
        ends = np.searchsorted(value[order], np.arange((1 << codes.width) + 1))
        there, turned = rows[order], np.ascontiguousarray(turned.T)
        for first in range(0, 1 << codes.width, 32):
            probed = signs[first : first + 32] @ turned >= np.float32(codes.reach)
            for v, asks in enumerate(probed, first):
                if ends[v] < ends[v + 1]:
                    best.compare(mine, np.flatnonzero(asks), there[ends[v] : ends[v + 1]], order[ends[v] : ends[v + 1]], True)
    return best.pairs()


def looked_at(codes: Codes, q: np.ndarray, x: np.ndarray) -> float:
    """How many rows a query compares, as a share of all, where a row counts for each of its values that is probed."""
    signs = np.where(np.arange(1 << codes.width)[:, None] >> np.arange(codes.width) & 1, 1, -1)
    share = 0.0
    for turned, value in zip(codes.turned(q), codes.values(x), strict=True):
        share += ((signs @ turned.T >= codes.reach).mean(1) * np.bincount(value, minlength=len(signs))).sum()
    return share / len(x)


class Best:
    """The pairs of a query and a row that can still be among the query's k best. least: what the k best of each have at least."""

    def __init__(self, n_queries: int, n_rows: int, query_ids: np.ndarray, ids: np.ndarray, off: np.ndarray, lengths: np.ndarray, k: int):
        self.least = np.full(n_queries, -np.inf, np.float32)
        self.n_rows, self.query_ids, self.ids, self.off, self.lengths, self.k = n_rows, query_ids, ids, off, lengths, k
        self.keys, self.most, self.waiting, self.kept = [], [], 0, KEPT

    def compare(self, mine: np.ndarray, asks: np.ndarray, rows: np.ndarray, numbers: np.ndarray, own: bool = False) -> None:
        """rows: all, of which `numbers` are compared, or with `own` the rows that have these numbers."""
        them = (rows if own else rows[numbers]).T
        step = max(1, AT_ONCE // len(numbers))
        for n in range(0, len(asks), step):
            self.add(asks[n : n + step], numbers, mine[asks[n : n + step]] @ them)

    def add(self, asks: np.ndarray, numbers: np.ndarray, products: np.ndarray) -> None:
        """products: not less than the true ones, of the queries `asks` and the rows `numbers`."""
        hits = np.flatnonzero(products >= self.least[asks, None])
        if not len(hits):
            return
        query, row = asks[hits // len(numbers)], numbers[hits % len(numbers)]
        self.keys.append(query * self.n_rows + row)
        self.most.append(products.ravel()[hits])
        self.waiting += len(hits)
        if self.waiting > self.kept:
            self.reduce()

    def reduce(self) -> None:
        keys, first = np.unique(np.concatenate([np.zeros(0, np.int64), *self.keys]), return_index=True)
        most = np.concatenate([np.zeros(0, np.float32), *self.most])[first]
        query, row = np.divmod(keys, self.n_rows)
        good = self.ids[row] != self.query_ids[query]
        keys, most, query, row = keys[good], most[good], query[good], row[good]
        sure = most - (self.off[query] * self.lengths[row]).astype(np.float32)
        order = np.lexsort((-sure, query))
        starts = np.searchsorted(query, np.arange(len(self.least) + 1))
        full = np.flatnonzero(np.diff(starts) >= self.k)
        self.least[full] = np.maximum(self.least[full], sure[order[starts[full] + self.k - 1]])
        good = most >= self.least[query]
        self.keys, self.most = [keys[good]], [most[good]]
        self.waiting = int(good.sum())
        self.kept = max(KEPT, 2 * self.waiting)  # very many can be as good as the k-th best, or nearly

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        self.reduce()
        return np.divmod(self.keys[0], self.n_rows)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>, or array<float> where it was) of the rows that take part, each vec_id once."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0")
    v = v.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    fine = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x != 0)"
    return v.where(fine).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def fitted(codes: Codes, fine: DataFrame, asked: DataFrame, k: int, cover: float) -> Codes:
    """codes with the reach by which the share `cover` of the true neighbours of ASKED queries is found by a substring."""
    of_width = F.size("embedding") == len(codes.centre)
    some = asked.where(of_width).orderBy(F.xxhash64("vec_id", F.lit("asked")), "vec_id").limit(ASKED).collect()
    some = [r for r in some if usual(np.array([r["embedding"]], float))[0]]
    if not some:
        return codes
    q, own = np.array([r["embedding"] for r in some], float), np.array([r["vec_id"] for r in some])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[usual(np.stack(batch["embedding"].to_list()))] if len(batch) else batch
            if not len(batch):
                continue
            x, ids = np.stack(batch["embedding"].to_list()).astype(float), batch["vec_id"].to_numpy()
            inner = np.where(own[:, None] == ids, -np.inf, q.astype(np.float32) @ x.T.astype(np.float32))
            near = np.argpartition(-inner, min(k, len(x)) - 1, axis=1)[:, :k]
            query, row = np.repeat(np.arange(len(q)), near.shape[1]), near.ravel()
            other = own[query] != ids[row]
            query, row = query[other], row[other]
            yield pd.DataFrame({"query_id": own[query], "vec_id": ids[row], "inner": inner[query, row].astype(float), "near": codes.nearness(q[query], x[row])})

    found = fine.where(of_width).mapInPandas(best, "query_id long, vec_id long, inner double, near double")
    order = Window.partitionBy("query_id").orderBy(F.desc("inner"), "vec_id")
    near = [r["near"] for r in found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("near").collect()]  # ASKED * k at most
    return replace(codes, reach=float(np.quantile(near, 1 - cover, method="lower")) - 1e-5) if near else codes


def nearest(vectors: DataFrame, query: str, k: int = K, bits: int = BITS, sample: int = SAMPLE, cover: float = COVER) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest of the rows that satisfy the SQL condition `query`, among all rows."""
    fine = materialise(usable(vectors), "vectors")
    spark = fine.sparkSession
    schema = "query_id long, vec_id long, score double"

    def fit(drawn: pd.DataFrame) -> pd.DataFrame:
        width = int(drawn["embedding"].map(len).mode()[0])
        codes = learn(np.stack([x for x in drawn["embedding"] if len(x) == width]).astype(float), bits)
        return pd.DataFrame([(width, codes.centre, codes.turn.ravel())], columns=["width", "centre", "turn"])

    # A task learns the codes, from `sample` rows whatever the table; its linear algebra runs on one thread there.
    drawn = fine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).withColumn("all", F.lit(0))
    learnt = drawn.groupBy("all").applyInPandas(fit, "width int, centre array<double>, turn array<double>").collect()
    if not learnt:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = learnt[0]["width"]
    n = fine.count()
    asked = fine.where(query)
    n_rows, n_queries = max(min(ROW_BLOCKS, -(-n // 64)), -(-n // BLOCK)), max(1, -(-asked.count() // QUERIES))
    part = max(2, min(WIDEST, bits, (n // n_rows // PER_VALUE).bit_length()))
    codes = fitted(Codes(np.array(learnt[0]["centre"]), np.array(learnt[0]["turn"]).reshape(width, -1), part), fine, asked, k, cover)

    def pairs(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
        left = queries.withColumn("qb", deal(n_queries)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
        right = fine.withColumn("rb", deal(n_rows)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
        return left, right

    def run(queries: DataFrame, codes: Codes) -> DataFrame:
        left, right = pairs(queries)
        task = lambda q, r: search(q, r, codes, k) if len(q) and len(r) else pd.DataFrame(columns=["query_id", "vec_id", "score"])
        return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(task, schema)

    found = materialise(run(asked, codes), "found")
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, n - 1))
    short = materialise(asked.join(enough, F.col("vec_id") == F.col("query_id"), "left_anti"), "short")
    if short.limit(1).count():
        again = materialise(run(short, replace(codes, reach=-math.inf)), "again")
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
