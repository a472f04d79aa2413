"""Lossless streams of integer channels: context trees, the weighted predictor, transforms, and the channels themselves.

A stream has a header with its transforms, a tree that gives each sample a context, a predictor, an offset and a
multiplier from its neighbourhood, a code, and the residuals in raster order. Each sample needs those before it, so a
stream is one call; streams of different groups don't need each other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from . import entropy, headers
from .entropy import BitReader, BitWriter
from .histograms import NumberReader, build_code, read_code, write_code, write_stream

TREE_CONTEXTS = 6
SPLIT, PROPERTY, PREDICTOR, OFFSET, LOG_MULTIPLIER, MULTIPLIER = range(TREE_CONTEXTS)
WEIGHTED, GRADIENT = 6, 5
WEIGHTED_ERROR, FIXED_PROPERTIES = 15, 16
#: Parameters of the weighted predictor where its header gives none.
USUAL_WEIGHTS = {"p1": 16, "p2": 10, "p3": [7, 7, 7, 0, 0], "w": [13, 12, 12, 12]}
COUNT = ((0, 0), (1, 0), (2, 4), (18, 8))
BEGIN = ((0, 3), (8, 6), (72, 10), (1096, 13))


@dataclass
class Channel:
    v: np.ndarray  # (height, width), int64
    hshift: int = 0
    vshift: int = 0

    @property
    def shape(self) -> tuple[int, int]:
        return self.v.shape


@dataclass
class Node:
    """property < 0: a leaf, numbered by `context`. Samples whose property is above `split` go to `above`."""

    property: int = -1
    split: int = 0
    above: int = 0
    below: int = 0
    context: int = 0
    predictor: int = GRADIENT
    offset: int = 0
    multiplier: int = 1


@dataclass
class Layout:
    channels: list[Channel]
    meta: int = 0
    bits: int = 8
    transforms: list[dict] = field(default_factory=list)


def pack(v: int) -> int:
    return 2 * v if v >= 0 else -2 * v - 1


def unpack(u: int) -> int:
    return -(u + 1) // 2 if u & 1 else u // 2


# -- trees -----------------------------------------------------------------------------------------------------


def tree_numbers(tree: list[Node]) -> list[tuple[int, int]]:
    """A tree, breadth first, as numbers under the contexts of its stream."""
    out, queue = [], [0]
    for at in queue:
        n = tree[at]
        out.append((PROPERTY, n.property + 1))
        if n.property >= 0:
            out.append((SPLIT, pack(n.split)))
            queue += [n.above, n.below]
        else:
            twos = (n.multiplier & -n.multiplier).bit_length() - 1
            out += [(PREDICTOR, n.predictor), (OFFSET, pack(n.offset)), (LOG_MULTIPLIER, twos), (MULTIPLIER, (n.multiplier >> twos) - 1)]
    return out


def write_tree(w: BitWriter, tree: list[Node]) -> None:
    numbers = tree_numbers(tree)
    code = build_code(numbers, TREE_CONTEXTS)
    write_code(w, code, TREE_CONTEXTS)
    write_stream(w, numbers, code)


def read_tree(r: BitReader, most: int = 1 << 22) -> list[Node]:
    numbers = NumberReader(read_code(r, TREE_CONTEXTS), r)
    tree, waiting, leaves = [Node()], 1, 0
    at = 0
    while waiting:
        waiting -= 1
        n = tree[at]
        n.property = numbers.read(PROPERTY) - 1
        if n.property >= 0:
            n.split = unpack(numbers.read(SPLIT))
            n.above, n.below = len(tree), len(tree) + 1
            tree += [Node(), Node()]
            waiting += 2
            if len(tree) > most or n.property > 255:
                raise ValueError("a tree beyond its bounds")
        else:
            n.predictor, n.offset = numbers.read(PREDICTOR), unpack(numbers.read(OFFSET))
            twos, odd = numbers.read(LOG_MULTIPLIER), numbers.read(MULTIPLIER)
            if n.predictor > 13 or twos > 30 or odd >= 1 << 31 - twos:
                raise ValueError("a leaf beyond its bounds")
            n.multiplier, n.context = (odd + 1) << twos, leaves
            leaves += 1
        if r.overread:
            raise ValueError("a tree without an end")
        at += 1
    numbers.check()
    return tree


def number_leaves(tree: list[Node]) -> list[Node]:
    """Contexts in the order in which the tree is sent."""
    queue, leaves = [0], 0
    for at in queue:
        if tree[at].property >= 0:
            queue += [tree[at].above, tree[at].below]
        else:
            tree[at].context = leaves
            leaves += 1
    return tree


# -- the weighted predictor ------------------------------------------------------------------------------------


def _share(k: int) -> int:
    """One part in k + 1, in 2^-24."""
    return (1 << 24) // (k + 1)


class Weighted:
    """Four predictions mixed by how well each did nearby. Values carry three more bits."""

    def __init__(self, width: int, given: dict):
        self.p1, self.p2, self.p3, self.w = given["p1"], given["p2"], given["p3"], given["w"]
        self.width = width
        self.misses = [[[0] * (width + 2) for _ in range(2)] for _ in range(4)]
        self.errors = [[0] * (width + 2) for _ in range(2)]
        self.each, self.mixed = [0] * 4, 0

    def predict(self, x: int, y: int, north: int, west: int, northeast: int, northwest: int, far_north: int) -> tuple[int, int]:
        """The prediction of a sample, and the greatest error nearby (a property)."""
        above = 1 - (y & 1)
        errors, now = self.errors[above], self.errors[y & 1]
        at_ne = x + 1 if x + 1 < self.width else x
        at_nw = max(x - 1, 0)
        weights = []
        for misses, most in zip(self.misses, self.w, strict=True):
            row = misses[above]
            n = row[x] + row[at_ne] + row[at_nw]
            shift = max(0, (n + 1).bit_length() - 6)
            weights.append(4 + (most * _share(n >> shift) >> shift))
        north, west, northeast, northwest, far_north = (8 * v for v in (north, west, northeast, northwest, far_north))
        e_w = now[x - 1] if x else 0
        e_n, e_nw, e_ne = errors[x], errors[at_nw], errors[at_ne]
        greatest = e_w
        for e in (e_n, e_nw, e_ne):
            if abs(e) > abs(greatest):
                greatest = e
        p3 = self.p3
        self.each = [
            west + northeast - north,
            north - ((e_w + e_n + e_ne) * self.p1 >> 5),
            west - ((e_w + e_n + e_nw) * self.p2 >> 5),
            north - (e_nw * p3[0] + e_n * p3[1] + e_ne * p3[2] + (far_north - north) * p3[3] + (northwest - west) * p3[4] >> 5),
        ]
        down = sum(weights).bit_length() - 1 - 4
        weights = [v >> down for v in weights]
        total = sum(weights)
        mixed = ((total >> 1) - 1 + sum(p * v for p, v in zip(self.each, weights, strict=True))) * _share(total - 1) >> 24
        if (e_n ^ e_w) | (e_n ^ e_nw) <= 0:  # errors of one sign: stay between the neighbours
            mixed = min(max(mixed, min(west, north, northeast)), max(west, north, northeast))
        self.mixed = mixed
        return mixed + 3 >> 3, greatest

    def learn(self, x: int, y: int, value: int) -> None:
        value *= 8
        self.errors[y & 1][x] = self.mixed - value
        for misses, p in zip(self.misses, self.each, strict=True):
            miss = abs(p - value) + 3 >> 3
            misses[y & 1][x] = miss
            # What was missed here also counts for the sample above on the right, when the next row looks there.
            misses[1 - (y & 1)][x + 1] += miss


def weights_bundle(io: headers.Io, given: dict | None = None) -> dict:
    b = headers.Bundle(io, given)
    if b.all_default(**USUAL_WEIGHTS):
        return b.v
    b.bits("p1", 5, 16)
    b.bits("p2", 5, 10)
    b.v["p3"] = [io.bits(5, x) for x in (b.v.get("p3") or [0] * 5)]
    b.v["w"] = [io.bits(4, x) for x in (b.v.get("w") or [0] * 4)]
    return b.v


# -- headers of streams ----------------------------------------------------------------------------------------


def squeeze_step(io: headers.Io, given: dict | None = None) -> dict:
    b = headers.Bundle(io, given)
    b.flag("horizontal")
    b.flag("in_place")
    b.u32("begin", BEGIN)
    b.u32("n", ((1, 0), (2, 0), (3, 0), (4, 4)), 1)
    return b.v


def transform_bundle(io: headers.Io, given: dict | None = None) -> dict:
    """kind: 0 colour, 1 palette, 2 squeeze."""
    b = headers.Bundle(io, given)
    kind = b.bits("kind", 2)
    if kind > 2:
        raise ValueError("no such transform")
    if kind < 2:
        b.u32("begin", BEGIN)
    if kind == 0:
        b.u32("type", ((6, 0), (0, 2), (2, 4), (10, 6)), 6)
    elif kind == 1:
        b.u32("n", ((1, 0), (3, 0), (4, 0), (1, 13)), 1)
        b.u32("colours", ((0, 8), (256, 10), (1280, 12), (5376, 16)))
        b.u32("deltas", ((0, 0), (1, 8), (257, 10), (1281, 16)))
        b.bits("predictor", 4)
    else:
        steps = b.v.get("steps") or []
        n = io.u32(((0, 0), (1, 4), (9, 6), (41, 8)), len(steps))
        b.v["steps"] = [squeeze_step(io, steps[k] if io.writing else None) for k in range(n)]
    return b.v


def stream_header(io: headers.Io, given: dict | None = None) -> dict:
    b = headers.Bundle(io, given)
    b.flag("global_tree")
    b.part("weights", weights_bundle)
    given_steps = b.v.get("transforms") or []
    n = io.u32(COUNT, len(given_steps))
    b.v["transforms"] = [transform_bundle(io, given_steps[k] if io.writing else None) for k in range(n)]
    return b.v


# -- channels --------------------------------------------------------------------------------------------------


def predict(kind: int, w: int, n: int, nw: int, ne: int, ww: int, nn: int, nee: int, mixed: int) -> int:
    """The fourteen predictors; halves are cut towards zero."""
    half = lambda s: s // 2 if s >= 0 else -(-s // 2)
    if kind == 0:
        return 0
    if kind == 1:
        return w
    if kind == 2:
        return n
    if kind == 3:
        return half(w + n)
    if kind == 4:
        return w if abs(n - nw) < abs(w - nw) else n
    if kind == 5:
        low, high = (w, n) if w < n else (n, w)
        return low if nw > high else high if nw < low else w + n - nw
    if kind == 6:
        return mixed
    if kind == 7:
        return ne
    if kind == 8:
        return nw
    if kind == 9:
        return ww
    if kind == 10:
        return half(w + nw)
    if kind == 11:
        return half(nw + n)
    if kind == 12:
        return half(n + ne)
    total = 6 * n - 2 * nn + 7 * w + ww + nee + 3 * ne + 8
    return total // 16 if total >= 0 else -(-total // 16)


def references(channels: list[Channel], c: int, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Properties of up to n earlier channels of the same shape, the nearest first: |v|, v, |v - g|, v - g with the gradient g."""
    mine, out = channels[c], []
    for other in reversed(channels[:c]):
        if len(out) == n:
            break
        if other.shape != mine.shape or (other.hshift, other.vshift) != (mine.hshift, mine.vshift):
            continue
        v = other.v
        west, north, corner = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
        west[:, 1:], north[1:], corner[1:, 1:] = v[:, :-1], v[:-1], v[:-1, :-1]
        west[1:, 0], north[0], corner[0], corner[1:, 0] = v[:-1, 0], west[0], west[0], v[:-1, 0]
        low, high = np.minimum(west, north), np.maximum(west, north)
        g = np.where(corner > high, low, np.where(corner < low, high, west + north - corner))
        out.append((np.abs(v), v, np.abs(v - g), v - g))
    return out


class Walk:
    """Visits the samples of a channel in raster order with their properties; a visitor turns each prediction into a value."""

    def __init__(self, tree: list[Node], channels: list[Channel], c: int, stream: int, weights: dict):
        self.tree, self.c, self.stream = tree, c, stream
        used = {n.property for n in tree if n.property >= 0}
        self.mixes = WEIGHTED_ERROR in used or any(n.property < 0 and n.predictor == WEIGHTED for n in tree)
        top = max(used, default=0)
        self.more = references(channels, c, -(-(top + 1 - FIXED_PROPERTIES) // 4)) if top >= FIXED_PROPERTIES else []
        self.weights = weights

    def run(self, rows: list[list[int]], height: int, width: int, visit) -> None:
        """rows: filled by visit(leaf, prediction, y, x), which returns the sample."""
        tree, more = self.tree, [[p.tolist() for p in each] for each in self.more]
        mixer = Weighted(width, self.weights) if self.mixes else None
        plain = tree[0] if tree[0].property < 0 else None
        blank = [0] * width
        p = [0] * (FIXED_PROPERTIES + 4 * len(more))
        p[0], p[1] = self.c, self.stream
        for y in range(height):
            row, above, far = rows[y], rows[y - 1] if y else blank, rows[y - 2] if y > 1 else None
            gradient = 0
            for x in range(width):
                w = row[x - 1] if x else above[0] if y else 0
                n = above[x] if y else w
                nw = above[x - 1] if x and y else w
                ne = above[x + 1] if y and x + 1 < width else n
                ww = row[x - 2] if x > 1 else w
                nn = far[x] if far else n
                nee = above[x + 2] if y and x + 2 < width else ne
                mixed = greatest = 0
                if mixer:
                    mixed, greatest = mixer.predict(x, y, n, w, ne, nw, nn)
                leaf = plain
                if leaf is None:
                    p[2:16] = (y, x, abs(n), abs(w), n, w, w - gradient if x else w, w + n - nw, w - nw, nw - n, n - ne, n - nn, w - ww, greatest)
                    for k, each in enumerate(more):
                        p[16 + 4 * k : 20 + 4 * k] = [plane[y][x] for plane in each]
                    leaf = tree[0]
                    while leaf.property >= 0:
                        leaf = tree[leaf.above if (p[leaf.property] if leaf.property < len(p) else 0) > leaf.split else leaf.below]
                gradient = w + n - nw
                value = visit(leaf, predict(leaf.predictor, w, n, nw, ne, ww, nn, nee, mixed) + leaf.offset, y, x)
                row[x] = value
                if mixer:
                    mixer.learn(x, y, value)


def wrapped(v: int) -> int:
    """As a signed 32-bit number."""
    return (v + (1 << 31) & 0xFFFFFFFF) - (1 << 31)


def channel_numbers(tree: list[Node], channels: list[Channel], c: int, stream: int, weights: dict) -> list[tuple[int, int]]:
    """(context, packed residual) of each sample."""
    height, width = channels[c].shape
    given, out = channels[c].v.tolist(), []
    rows = [[0] * width for _ in range(height)]

    def visit(leaf: Node, guess: int, y: int, x: int) -> int:
        off = given[y][x] - guess
        if off % leaf.multiplier:
            raise ValueError("a residual that its multiplier doesn't divide")
        out.append((leaf.context, pack(off // leaf.multiplier)))
        return given[y][x]

    Walk(tree, channels, c, stream, weights).run(rows, height, width, visit)
    return out


def read_channel(numbers: NumberReader, tree: list[Node], channels: list[Channel], c: int, stream: int, weights: dict) -> None:
    height, width = channels[c].shape
    rows = [[0] * width for _ in range(height)]

    def visit(leaf: Node, guess: int, y: int, x: int) -> int:
        return wrapped(unpack(numbers.read(leaf.context)) * leaf.multiplier + guess)

    Walk(tree, channels, c, stream, weights).run(rows, height, width, visit)
    channels[c].v = np.array(rows, np.int64).reshape(height, width)


# -- transforms ------------------------------------------------------------------------------------------------


def colour_forward(c: list[np.ndarray], kind: int) -> list[np.ndarray]:
    """One of the 42 reversible colour transforms: an order of the channels (kind // 7), then differences (kind % 7)."""
    orders = ((0, 1, 2), (1, 2, 0), (2, 0, 1), (0, 2, 1), (1, 0, 2), (2, 1, 0))
    a, b, d = (c[k] for k in orders[kind // 7])
    way = kind % 7
    if way == 6:
        first = a - d
        mid = d + (first >> 1)
        second = b - mid
        return [mid + (second >> 1), first, second]
    third = d - a if way & 1 else d
    if way >> 1 == 1:
        return [a, b - a, third]
    if way >> 1 == 2:
        return [a, b - ((a + d) >> 1), third]
    return [a, b, third]


def colour_inverse(c: list[np.ndarray], kind: int) -> list[np.ndarray]:
    orders = ((0, 1, 2), (1, 2, 0), (2, 0, 1), (0, 2, 1), (1, 0, 2), (2, 1, 0))
    x, y, z = c
    way = kind % 7
    if way == 6:
        mid = x - (z >> 1)
        b = z + mid
        d = mid - (y >> 1)
        got = [y + d, b, d]
    else:
        d = z + x if way & 1 else z
        b = y + x if way >> 1 == 1 else y + ((x + d) >> 1) if way >> 1 == 2 else y
        got = [x, b, d]
    out = [None] * 3
    for k, value in zip(orders[kind // 7], got, strict=True):
        out[k] = value
    return out


def tendency(before: np.ndarray, mean: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far the first of two samples with that mean likely lies above the second.

    Only where the means rise or fall throughout: a third of the step before and a quarter of the step after, to the nearest,
    but no more than keeps the pair between its neighbours.
    """
    rise, fall = np.abs(before - mean), np.abs(mean - after)
    size = np.minimum(np.minimum((4 * rise + 3 * fall + 6) // 12, 2 * rise + 1), 2 * fall)
    turns = (before - mean) * (mean - after) < 0
    return np.where(turns, 0, np.where((before > mean) | (mean > after), size, -size))


def squeeze_forward(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Along x: means of pairs (an odd last sample is its own) and what their differences have beyond the tendency."""
    a, b = v[:, 0::2], v[:, 1::2]
    pairs = b.shape[1]
    mean = a.copy()
    mean[:, :pairs] = (a[:, :pairs] + b + (a[:, :pairs] > b)) >> 1
    m = mean[:, :pairs]
    before = np.concatenate([m[:, :1], b[:, : pairs - 1]], axis=1) if pairs else m
    after = np.concatenate([mean[:, 1:], mean[:, -1:]], axis=1)[:, :pairs]
    return mean, a[:, :pairs] - b - tendency(before, m, after)


def squeeze_inverse(mean: np.ndarray, res: np.ndarray) -> np.ndarray:
    """Along x; a pair needs the second sample of the pair before, so columns go one by one, all rows at once."""
    height, pairs = res.shape
    out = np.zeros((height, mean.shape[1] + pairs), np.int64)
    for k in range(pairs):
        m = mean[:, k]
        before = out[:, 2 * k - 1] if k else m
        after = mean[:, k + 1] if k + 1 < mean.shape[1] else m
        apart = res[:, k] + tendency(before, m, after)
        first = m + (apart - np.sign(apart) * (np.abs(apart) & 1)) // 2
        out[:, 2 * k], out[:, 2 * k + 1] = first, first - apart
    if mean.shape[1] > pairs:
        out[:, -1] = mean[:, -1]
    return out


def usual_steps(layout: Layout) -> list[dict]:
    """Where a squeeze gives no steps: chroma first, then all channels in turns, until both sides are 8 or less."""
    first, n = layout.meta, len(layout.channels) - layout.meta
    height, width = layout.channels[first].shape
    steps = []
    if n > 2 and layout.channels[first + 1].shape == (height, width):
        steps += [{"horizontal": h, "in_place": False, "begin": first + 1, "n": 2} for h in (True, False)]
    both = {"in_place": True, "begin": first, "n": n}
    if height >= width and height > 8:
        steps.append({"horizontal": False, **both})
        height = (height + 1) // 2
    while width > 8 or height > 8:
        if width > 8:
            steps.append({"horizontal": True, **both})
            width = (width + 1) // 2
        if height > 8:
            steps.append({"horizontal": False, **both})
            height = (height + 1) // 2
    return steps


def _residual_place(layout: Layout, step: dict) -> int:
    return step["begin"] + step["n"] if step["in_place"] else len(layout.channels)


def apply_forward(layout: Layout, t: dict) -> None:
    """Changes the channels as the encoder does."""
    ch = layout.channels
    if t["kind"] == 0:
        at = t["begin"]
        for k, v in enumerate(colour_forward([c.v for c in ch[at : at + 3]], t["type"])):
            ch[at + k].v = v
    elif t["kind"] == 1:
        raise ValueError("a palette is made by palette_forward")
    else:
        for step in t["steps"] or usual_steps(layout):
            fresh = []
            for k in range(step["begin"], step["begin"] + step["n"]):
                v = ch[k].v if step["horizontal"] else ch[k].v.T
                mean, res = squeeze_forward(v)
                ch[k].hshift += step["horizontal"]
                ch[k].vshift += not step["horizontal"]
                ch[k].v = mean if step["horizontal"] else mean.T
                fresh.append(Channel(res if step["horizontal"] else res.T, ch[k].hshift, ch[k].vshift))
            at = _residual_place(layout, step)
            ch[at:at] = fresh
            if step["begin"] < layout.meta:
                layout.meta += step["n"]


def palette_forward(layout: Layout, begin: int, n: int, most: int = 256) -> dict | None:
    """Replaces n channels by an index, with the sorted colours as a channel before all; None with more colours than `most`."""
    ch = layout.channels[begin : begin + n]
    stacked = np.stack([c.v.ravel() for c in ch], axis=1)
    colours, index = np.unique(stacked, axis=0, return_inverse=True)
    if len(colours) > most:
        return None
    layout.channels[begin : begin + n] = [Channel(index.reshape(ch[0].shape).astype(np.int64), ch[0].hshift, ch[0].vshift)]
    layout.channels.insert(0, Channel(colours.T.copy(), -1, -1))
    layout.meta += 1 if begin >= layout.meta else 2 - n
    return {"kind": 1, "begin": begin, "n": n, "colours": len(colours), "deltas": 0, "predictor": 0}


def apply_layout(layout: Layout, t: dict) -> None:
    """Changes shapes alone, as a reader must before it reads the channels."""
    ch = layout.channels
    if t["kind"] == 0:
        if t["begin"] + 3 > len(ch) or t["type"] >= 42 or len({c.shape for c in ch[t["begin"] : t["begin"] + 3]}) != 1:
            raise ValueError("a colour transform of channels that aren't alike")
    elif t["kind"] == 1:
        begin, n = t["begin"], t["n"]
        if not n or begin + n > len(ch) or len({c.shape for c in ch[begin : begin + n]}) != 1:
            raise ValueError("a palette of channels that aren't alike")
        ch[begin + 1 : begin + n] = []
        ch.insert(0, Channel(np.zeros((n, t["colours"] + t["deltas"]), np.int64), -1, -1))
        layout.meta += 1 if begin >= layout.meta else 2 - n
    else:
        t["steps"] = t["steps"] or usual_steps(layout)
        for step in t["steps"]:
            if step["begin"] + step["n"] > len(ch):
                raise ValueError("a squeeze beyond the channels")
            fresh = []
            for c in ch[step["begin"] : step["begin"] + step["n"]]:
                height, width = c.shape
                c.hshift += step["horizontal"]
                c.vshift += not step["horizontal"]
                shape, rest = ((height, -(-width // 2)), (height, width // 2)) if step["horizontal"] else ((-(-height // 2), width), (height // 2, width))
                c.v = np.zeros(shape, np.int64)
                fresh.append(Channel(np.zeros(rest, np.int64), c.hshift, c.vshift))
            at = _residual_place(layout, step)
            ch[at:at] = fresh
            if step["begin"] < layout.meta:
                layout.meta += step["n"]


def implicit_colour(index: int, c: int, size: int, bits: int) -> int:
    """A colour beyond a palette of `size`: first a cube of 4 levels, then one of 5."""
    index -= size
    top = (1 << bits) - 1
    if index < 64:
        return (index >> 2 * c & 3) * top // 4 + (1 << max(0, bits - 3))
    return (index - 64) // 5**c % 5 * top // 4


def palette_inverse(layout: Layout, t: dict, weights: dict) -> None:
    """Indexes back to colours. Those below `deltas` are differences from the prediction of what is already there."""
    colours = layout.channels.pop(0).v
    index, size = layout.channels[t["begin"]], t["colours"] + t["deltas"]
    if (index.v < 0).any():
        raise ValueError("indexes below zero stand for fixed differences, which aren't built")
    out = []
    for c in range(t["n"]):
        table = np.concatenate([colours[c][:size], [implicit_colour(k, c, size, layout.bits) if c < 3 else 0 for k in range(size, int(index.v.max(initial=0)) + 1)]]).astype(np.int64)
        v = table[index.v]
        if t["deltas"]:
            rows, given, marks = [[0] * v.shape[1] for _ in range(v.shape[0])], v.tolist(), (index.v < t["deltas"]).tolist()
            leaf = [Node(predictor=t["predictor"])]
            visit = lambda leaf, guess, y, x, given=given, marks=marks: given[y][x] + guess if marks[y][x] else given[y][x]
            Walk(leaf, [], 0, 0, weights).run(rows, *v.shape, visit)
            v = np.array(rows, np.int64).reshape(v.shape)
        out.append(Channel(v, index.hshift, index.vshift))
    layout.channels[t["begin"] : t["begin"] + 1] = out
    layout.meta -= 1 if t["begin"] >= layout.meta - 1 else 2 - t["n"]


def undo(layout: Layout, transforms: list[dict], weights: dict) -> None:
    for t in reversed(transforms):
        ch = layout.channels
        if t["kind"] == 0:
            at = t["begin"]
            for k, v in enumerate(colour_inverse([c.v for c in ch[at : at + 3]], t["type"])):
                ch[at + k].v = (v + (1 << 31) & 0xFFFFFFFF) - (1 << 31)
        elif t["kind"] == 1:
            palette_inverse(layout, t, weights)
        else:
            for step in reversed(t["steps"]):
                n = step["n"]
                at = step["begin"] + n if step["in_place"] else len(ch) - n
                fresh = ch[at : at + n]
                ch[at : at + n] = []
                for c, res in zip(ch[step["begin"] : step["begin"] + n], fresh, strict=True):
                    c.v = squeeze_inverse(c.v, res.v) if step["horizontal"] else squeeze_inverse(c.v.T, res.v.T).T
                    c.hshift -= step["horizontal"]
                    c.vshift -= not step["horizontal"]
                if step["begin"] < layout.meta:
                    layout.meta -= n


# -- streams ---------------------------------------------------------------------------------------------------


def write_channels(w: BitWriter, layout: Layout, stream: int, tree: list[Node], transforms: list[dict], weights: dict | None = None, prefix: bool = False) -> None:
    """A stream of its own: header, tree, code and residuals. The channels are those after the transforms."""
    weights = weights or USUAL_WEIGHTS
    stream_header(headers.Write(w), {"global_tree": False, "weights": weights, "transforms": transforms})
    tree = number_leaves(tree)
    write_tree(w, tree)
    numbers = []
    for c, ch in enumerate(layout.channels):
        if ch.v.size:
            numbers += channel_numbers(tree, layout.channels, c, stream, weights)
    contexts = (len(tree) + 1) // 2
    code = build_code(numbers, contexts, prefix)
    write_code(w, code, contexts)
    if numbers:
        write_stream(w, numbers, code)


def read_channels(r: BitReader, layout: Layout, stream: int, whole: tuple | None = None, largest: int = 1 << 30) -> dict:
    """Fills the layout's channels up to the first one larger than `largest`; whole: tree and code for all streams of a frame."""
    header = stream_header(headers.Read(r))
    for t in header["transforms"]:
        apply_layout(layout, t)
    if header["global_tree"]:
        if not whole:
            raise ValueError("no tree for all streams")
        tree, code = whole
    else:
        tree = read_tree(r)
        code = read_code(r, (len(tree) + 1) // 2)
    todo = []
    for c, ch in enumerate(layout.channels):
        if c >= layout.meta and max(ch.shape) > largest:
            break
        if ch.v.size:
            todo.append(c)
    if todo:
        numbers = NumberReader(code, r, max(layout.channels[c].shape[1] for c in todo))
        for c in todo:
            read_channel(numbers, tree, layout.channels, c, stream, header["weights"])
            if r.overread:
                raise ValueError("the stream ends early")
        numbers.check()
    return header


def gradient_tree(channels: int) -> list[Node]:
    """A small tree: the channel, then how uneven the weighted predictor found the neighbourhood."""
    cuts = (-24, -8, -2, 2, 8, 24)

    def build(low: int, high: int, tree: list[Node]) -> int:
        at = len(tree)
        tree.append(Node(predictor=WEIGHTED))
        if low < high:
            mid = (low + high) // 2
            tree[at].property, tree[at].split = WEIGHTED_ERROR, cuts[mid]
            tree[at].above = build(mid + 1, high, tree)
            tree[at].below = build(low, mid, tree)
        return at

    def by_channel(first: int, tree: list[Node]) -> int:
        if first == channels - 1:
            return build(0, len(cuts), tree)
        at = len(tree)
        tree.append(Node(property=0, split=first))
        tree[at].above = by_channel(first + 1, tree)
        tree[at].below = build(0, len(cuts), tree)
        return at

    out: list[Node] = []
    by_channel(0, out)
    return out
