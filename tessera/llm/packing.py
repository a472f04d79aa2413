"""Best-fit packing of tokenised documents into sequences, by bin completion.

A packing depends on lengths alone, and a length is an integer from 1 to the capacity. So the corpus is
summed into a histogram of at most `capacity` counts, the packing is planned for that histogram on the driver
(its size doesn't grow with the corpus), and the plan is laid over the documents by their rank within their
length. Ranks come from counts of (length, bucket), so no task ever sees a whole length.

The planner is a depth-first bin completion. A node takes the largest length left and enumerates the
undominated fillings around it: maximal ones in which no length can be swapped for a larger one that is left and
still fits. Fillings are tried from the least waste up; each is used as often as the counts allow, then once.
The first descent, and best-fit decreasing beside it, give incumbents; a branch whose waste leaves no way to
beat the incumbent is pruned, and the search ends when the incumbent meets the lower bound or its limits are reached.

The limits are parameters (Limits): nodes visited, fillings enumerated and tried at a node, and how many smaller
lengths are looked at before only an exact fit is. Within them the plan may keep more sequences than needed, never
fewer documents; excess() says how many more than the lower bound.

Null and empty texts are the end id alone. Documents longer than the capacity are cut into pieces of it, however long.
Repeated rows are packed each. Documents of one length may swap places. Columns besides doc_id and text never meet
the operator's own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordpieces
from .common import documents_only, materialise, ranks

CAPACITY = 4096
END = 1


@dataclass(frozen=True)
class Limits:
    """Of the search. More of any finds more and takes longer; none changes which documents are packed."""

    nodes: int = 4000
    fillings: int = 64
    tried: int = 6
    smaller: int = 24


#: A filling: (length, copies) from the longest down; a plan: (filling, times).
Filling = tuple[tuple[int, int], ...]
Plan = list[tuple[Filling, int]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: by volume, and by lengths above a half with what can't stand beside them.

    For a least length, those that leave less room than it stand alone, those above a half have one each, and
    what is left between it and a half needs their spare room or more sequences.
    """
    if not counts:
        return 0
    best = -(-sum(k * n for k, n in counts.items()) // capacity)
    many = np.zeros(capacity + 1, object)  # exact integers, however many documents
    for size, n in counts.items():
        many[size] = n
    upto, volume = np.cumsum(many), np.cumsum(many * np.arange(capacity + 1))
    half = capacity // 2
    for least in sorted({s for s in counts if 2 * s <= capacity} | {1}):
        alone = upto[capacity] - upto[capacity - least]
        singles = max(0, upto[capacity - least] - upto[half])
        spare = singles * capacity - max(0, volume[capacity - least] - volume[half])
        rest = volume[half] - volume[least - 1]
        best = max(best, alone + singles + max(0, -(-(rest - spare) // capacity)))
    return int(best)


def fillings(counts: dict[int, int], sizes: list[int], capacity: int, most: int, smaller: int = Limits.smaller) -> list[Filling]:
    """Undominated fillings around the largest length left, least waste first; at least the one with the least waste found.

    sizes: lengths left, ascending. The enumeration goes through maximal fillings, larger lengths first, and
    stops once `most` are found, after 8 * most steps, or when one wastes nothing.
    """
    top = sizes[-1]
    found: list[tuple[int, Filling]] = []
    budget = [most * 8]

    def maximal(room: int, chosen: list[tuple[int, int]]) -> bool:
        used = dict(chosen)
        used[top] = used.get(top, 0) + 1
        return all(counts[s] <= used.get(s, 0) for s in sizes[: bisect_right(sizes, room)])

    def grow(room: int, upto: int, chosen: list[tuple[int, int]]) -> bool:
        """True when a filling without waste ends the search. Lengths are tried below index `upto`."""
        budget[0] -= 1
        k = bisect_right(sizes, room, 0, upto) - 1
        if room == 0 or k < 0:
            if maximal(room, chosen):
                found.append((room, tuple(chosen)))
            return room == 0 or len(found) >= most
        if budget[0] < 0:
            fill_greedily(room, upto, chosen)
            return False
        last = k
        while k >= 0:
            size = sizes[k]
            used = 1 if size == top else 0
            can = min(counts[size] - used, room // size)
            if can > 0:
                for copies in range(can, 0, -1):
                    chosen.append((size, copies))
                    if grow(room - size * copies, k, chosen):
                        return True
                    chosen.pop()
                    if budget[0] < 0:
                        return False
            k -= 1
            if k < last - smaller:  # far smaller: only an exact fit can still beat what was found
                exact = room if counts.get(room, 0) - (room == top) > 0 else 0
                if exact and exact <= sizes[k]:
                    found.append((0, (*chosen, (exact, 1))))
                    return True
                return False
        return False

    def fill_greedily(room: int, upto: int, chosen: list[tuple[int, int]]) -> None:
        chosen = list(chosen)
        while room:
            k = bisect_right(sizes, room, 0, upto) - 1
            if k < 0:
                break
            size = sizes[k]
            can = min(counts[size] - (size == top), room // size)
            if can > 0:
                chosen.append((size, can))
                room -= size * can
            upto = k
        found.append((room, tuple(chosen)))

    def dominated(room: int, used: dict[int, int]) -> bool:
        """Whether a length in it can give way to the next larger one that is left."""
        for size in used:
            k = bisect_right(sizes, size)
            while k < len(sizes) and sizes[k] - size <= room:
                if counts[sizes[k]] > used.get(sizes[k], 0):
                    return True
                k += 1
        return False

    grow(capacity - top, len(sizes), [])
    merged: dict[Filling, bool] = {}
    for waste, chosen in sorted(found, key=lambda f: f[0]):
        together: dict[int, int] = {top: 1}
        for size, copies in chosen:
            together[size] = together.get(size, 0) + copies
        merged.setdefault(tuple(sorted(together.items(), reverse=True)), dominated(waste, together))
    return [f for f, beaten in merged.items() if not beaten] or list(merged)[:1]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over a histogram: bins of equal room are filled together."""
    rooms: dict[int, dict[Filling, int]] = {}
    order: list[int] = []  # rooms, ascending

    def put(room: int, filling: Filling, times: int) -> None:
        if room not in rooms:
            rooms[room] = {}
            order.insert(bisect_right(order, room), room)
        rooms[room][filling] = rooms[room].get(filling, 0) + times

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect_right(order, size - 1)
            if k == len(order):
                each = min(left, capacity // size)
                times = left // each
                put(capacity - size * each, ((size, each),), times)
                left -= times * each
                continue
            room = order[k]
            filling, times = next(iter(rooms[room].items()))
            each = min(left, room // size)
            used = min(times, left // each)
            rooms[room][filling] -= used
            if not rooms[room][filling]:
                del rooms[room][filling]
            if not rooms[room]:
                del rooms[room]
                order.pop(k)
            put(room - size * each, (*filling, (size, each)), used)
            left -= used * each
    return [(f, n) for by in rooms.values() for f, n in by.items()]


def excess(packing: Plan, counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences of a plan beyond the lower bound."""
    return sum(n for _, n in packing) - lower_bound(counts, capacity)


def plan(counts: dict[int, int], capacity: int = CAPACITY, limits: Limits = Limits()) -> Plan:  # noqa: B008  frozen
    """The packing with the fewest sequences found. The plan uses every length exactly as often as it is counted."""
    counts = {k: n for k, n in counts.items() if n > 0}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    total = sum(k * n for k, n in counts.items())
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    fewest = sum(n for _, n in best)
    if fewest == bound:
        return best
    visited = 0
    # Each open node: what is left, the sequences so far, the fillings still to try.
    left, sizes = dict(counts), sorted(counts)
    trail: Plan = []
    used = waste = 0
    stack: list[list[tuple[Filling, int]]] = []

    def take(filling: Filling, times: int) -> None:
        nonlocal used, waste
        for size, copies in filling:
            left[size] -= copies * times
            if not left[size]:
                del left[size]
                sizes.pop(bisect_right(sizes, size) - 1)
        trail.append((filling, times))
        used += times
        waste += times * (capacity - sum(s * c for s, c in filling))

    def undo() -> None:
        nonlocal used, waste
        filling, times = trail.pop()
        for size, copies in filling:
            if size not in left:
                left[size] = 0
                sizes.insert(bisect_right(sizes, size), size)
            left[size] += copies * times
        used -= times
        waste -= times * (capacity - sum(s * c for s, c in filling))

    def expand() -> None:
        options = []
        for filling in fillings(left, sizes, capacity, limits.fillings, limits.smaller)[: limits.tried]:
            most = min(left[s] // c for s, c in filling)
            options += [(filling, most)] + [(filling, 1)] * (most > 1)
        stack.append(options[::-1])

    expand()
    while stack:
        if not stack[-1]:
            stack.pop()
            if trail and len(trail) >= len(stack) and stack:
                undo()
            continue
        take(*stack[-1].pop())
        visited += 1
        if not left:
            if used < fewest:
                fewest, best = used, list(trail)
            undo()
            if fewest <= bound:
                break
        elif waste > (fewest - 1) * capacity - total:  # the waste that any better packing can have
            undo()
        else:
            expand()
        if visited > limits.nodes + len(counts):
            break
    return best


def layout(packing: Plan, capacity: int = CAPACITY) -> pd.DataFrame:
    """A plan as ranges of ranks: which sequence and offset the r-th document of a length has.

    Rank r of a length in [first, next first): sequence = base + (r - first) // copies, offset = offset +
    ((r - first) % copies) * length. There are as many rows as the plan has (filling, length) pairs.
    """
    rows, taken, base = [], {}, 0
    for filling, times in packing:
        at = 0
        for size, copies in filling:
            first = taken.get(size, 0)
            rows.append((size, first, base, copies, at))
            taken[size] = first + copies * times
            at += size * copies
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "base", "copies", "at"], dtype="int64")


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = wordpieces.VOCABULARY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, in the order of the documents."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = wordpieces.encoder(vocabulary)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part, rows = batch.iloc[k : k + 256], []
                for doc_id, ids in zip(part["doc_id"], encoder.encode_many(part["text"]), strict=True):
                    ids = np.append(ids, end).astype("<u4")
                    for n, start in enumerate(range(0, len(ids), capacity)):
                        piece = ids[start : start + capacity]
                        rows.append((doc_id, n, start, len(piece), zlib.crc32(piece.tobytes())))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield out.astype({"doc_id": "Int64", "piece": "int32"})

    return documents_only(docs).mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def assign(parts: DataFrame, packing: Plan, n_rows: int, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. parts must be a fixed table, as materialise() gives it, with a number `row` of each row."""
    table = layout(packing, capacity)
    ranked = ranks(parts, "length", ["doc_id", "piece", "row"], n_rows)

    order = table.sort_values(["length", "first"])
    key = (order["length"].to_numpy() << 44) + order["first"].to_numpy()
    columns = {c: order[c].to_numpy() for c in ("first", "base", "copies", "at")}

    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        size, rank = lengths.to_numpy("int64"), ranks.to_numpy("int64")
        row = np.searchsorted(key, (size << 44) + rank, side="right") - 1
        past = rank - columns["first"][row]
        copies = columns["copies"][row]
        return pd.DataFrame({"sequence_id": columns["base"][row] + past // copies, "offset": columns["at"][row] + past % copies * size})

    placed = F.pandas_udf(place, "sequence_id long, offset long")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", placed("length", "__rank").alias("p")).select("doc_id", "piece", "start", "length", "ids_crc32", "p.*")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = wordpieces.VOCABULARY, end: int = END, limits: Limits = Limits()) -> DataFrame:  # noqa: B008  frozen
    """Every piece of every document with its sequence and place."""
    parts = materialise(pieces(docs, capacity, vocabulary, end).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    return assign(parts, plan(counts, capacity, limits), sum(counts.values()), capacity)
