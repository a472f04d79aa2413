"""Whole codestreams: headers, tables of sections, and lossless frames written and read, group by group."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import entropy, headers, modular
from .entropy import BitReader, BitWriter
from .headers import Fields
from .histograms import NumberReader, build_code, read_code, write_code, write_numbers

PERMUTATION_CONTEXTS, ICC_CONTEXTS, QUANT_TABLES = 8, 41, 17
PATCHES, SPLINES, NOISE = 2, 16, 1


@dataclass
class Frame:
    header: Fields
    grid: Fields
    sections: list[tuple[int, int]]  # where each logical section starts in the codestream, and its size
    end: int


def role_of(index: int, grid: Fields) -> str:
    if grid["sections"] == 1:
        return "all"
    if index == 0:
        return "dc_global"
    if index <= grid["dc_groups"]:
        return "dc_group"
    return "ac_global" if index == grid["dc_groups"] + 1 else "ac_group"


def order_context(value: int) -> int:
    """The context of a number after `value` in a permutation."""
    return min(value.bit_length(), PERMUTATION_CONTEXTS - 1)


def write_permutation(w: BitWriter, order: list[int]) -> None:
    """order: which physical section each logical one is. Sent as ranks among what is left, up to the last that isn't 0."""
    left, ranks = sorted(order), []
    for k in order:
        ranks.append(left.index(k))
        left.pop(ranks[-1])
    while ranks and not ranks[-1]:
        ranks.pop()
    before = [len(order), 0, *ranks[:-1]] if ranks else [len(order)]
    write_numbers(w, list(zip(map(order_context, before), [len(ranks), *ranks], strict=True)), PERMUTATION_CONTEXTS)


def read_permutation(r: BitReader, n: int) -> list[int]:
    numbers = NumberReader(read_code(r, PERMUTATION_CONTEXTS), r)
    sent = numbers.read(order_context(n))
    if sent > n:
        raise ValueError("a permutation longer than what it permutes")
    ranks, last = [0] * n, 0
    for k in range(sent):
        ranks[k] = last = numbers.read(order_context(last))
        if last >= n - k:
            raise ValueError("a rank beyond what is left")
    numbers.check()
    return entropy.lehmer_decode(ranks)


def write_toc(w: BitWriter, sizes: list[int], order: list[int] | None = None) -> None:
    """sizes: of the sections as they lie in the file; order: where each logical one lies."""
    w.write(int(order is not None), 1)
    if order is not None:
        write_permutation(w, order)
    w.align()
    for n in sizes:
        entropy.write_u32(w, n, headers.SECTION)
    w.align()


def read_toc(r: BitReader, n: int) -> list[tuple[int, int]]:
    """Offset after the table, and size, of each logical section."""
    if not 0 < n <= 65536:
        raise ValueError("no table has so many sections")
    order = read_permutation(r, n) if r.read(1) else range(n)
    r.align()
    sizes = [entropy.read_u32(r, headers.SECTION) for _ in range(n)]
    r.align()
    starts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return [(starts[k], sizes[k]) for k in order]


def icc_context(at: int, b1: int, b2: int) -> int:
    """The context of byte `at` of a coded profile, from the two bytes before."""
    if at <= 128:
        return 0

    def kind(b: int, table: tuple) -> int:
        for k, test in enumerate(table):
            if test(b):
                return k
        return len(table)

    letter = lambda b: chr(b).isascii() and chr(b).isalpha()
    number = lambda b: chr(b).isascii() and chr(b).isdigit() or b in (46, 44)
    one = kind(b1, (letter, number, lambda b: b == 0, lambda b: b == 1, lambda b: b < 16, lambda b: 240 < b < 255, lambda b: b == 255))
    two = kind(b2, (letter, number, lambda b: b < 16, lambda b: b > 240))
    return 1 + one + two * 8


def read_icc(r: BitReader) -> bytes:
    """The coded profile's bytes, before prediction is undone."""
    size = entropy.read_u64(r)
    if size > 1 << 28:
        raise ValueError("a profile beyond what is read")
    numbers = NumberReader(read_code(r, ICC_CONTEXTS), r)
    out = bytearray()
    for k in range(size):
        out.append(numbers.read(icc_context(k, out[-1] if k > 0 else 0, out[-2] if k > 1 else 0)) & 255)
        if r.overread:
            raise ValueError("a profile without an end")
    numbers.check()
    return bytes(out)


def write_icc(w: BitWriter, coded: bytes) -> None:
    entropy.write_u64(w, len(coded))
    numbers = [(icc_context(k, coded[k - 1] if k else 0, coded[k - 2] if k > 1 else 0), b) for k, b in enumerate(coded)]
    write_numbers(w, numbers, ICC_CONTEXTS)


def read_frame_head(r: BitReader, image: Fields) -> Frame:
    r.align()
    header = headers.frame_header(headers.Read(r), None, image)
    grid = headers.frame_grid(image, header)
    table = read_toc(r, grid["sections"])
    first = r.at // 8
    sections = [(first + at, n) for at, n in table]
    return Frame(header, grid, sections, first + sum(n for _, n in table))


def read_heads(data: bytes) -> tuple[Fields, bytes | None, list[Frame]]:
    """Image header, coded profile, and all frames without their samples."""
    r = BitReader(data)
    image = headers.codestream_header(headers.Read(r))
    profile = read_icc(r) if image["meta"].get("colour", {}).get("want_icc") else None
    frames = []
    while not frames or not frames[-1].header["is_last"]:
        frame = read_frame_head(r, image)
        if r.overread or frame.end > len(data):
            raise ValueError("the codestream ends inside a frame")
        frames.append(frame)
        r.at = 8 * frame.end
    return image, profile, frames


def n_channels(image: Fields) -> tuple[int, int]:
    """Colour and extra channels of a frame whose colours aren't transformed."""
    return (1 if image["meta"]["colour"]["space"] == headers.GRAY and not image["meta"]["xyb"] else 3), len(image["meta"]["extra"])


def empty_layout(image: Fields, frame: Frame) -> modular.Layout:
    colours, extra = n_channels(image)
    grid = frame.grid
    made = [modular.Channel(np.zeros((grid["height"], grid["width"]), np.int64)) for _ in range(colours)]
    for k in range(extra):
        by = image["meta"]["extra"][k]["dim_shift"]
        shape = (grid["height"] + (1 << by) - 1) >> by, (grid["width"] + (1 << by) - 1) >> by
        made.append(modular.Channel(np.zeros(shape, np.int64), by, by))
    return modular.Layout(made, bits=image["meta"]["depth"]["bits"])


def read_dc_global(r: BitReader, frame: Frame, layout: modular.Layout) -> tuple[dict, tuple | None]:
    """The header of the frame's own stream, with the channels that it carries, and the tree for all groups."""
    if frame.header["flags"] & (PATCHES | SPLINES | NOISE):
        raise ValueError("patches, splines and noise aren't read")
    if not r.read(1):
        r.read(48)
    whole = None
    if r.read(1):
        tree = modular.read_tree(r)
        whole = tree, read_code(r, (len(tree) + 1) // 2)
    grid = frame.grid
    largest = 1 << 30 if grid["sections"] == 1 else grid["group"]
    return modular.read_channels(r, layout, 0, whole, largest), whole


def group_part(layout: modular.Layout, grid: Fields, group: int, low: int, high: int, dc: bool = False) -> tuple[modular.Layout, list[tuple[int, int, int]]]:
    """The channels of a group whose shift lies between low and high, and where each goes: (channel, y, x)."""
    side = grid["group"] * (8 if dc else 1)
    across = -(-grid["width"] // side)
    y0, x0 = group // across * side, group % across * side
    first = layout.meta
    while first < len(layout.channels) and max(layout.channels[first].shape) <= grid["group"]:
        first += 1
    part, places = modular.Layout([], bits=layout.bits), []
    for c in range(first, len(layout.channels)):
        ch = layout.channels[c]
        if min(ch.hshift, ch.vshift) < 0 or not low <= min(ch.hshift, ch.vshift) <= high:
            continue
        y, x = y0 >> ch.vshift, x0 >> ch.hshift
        height, width = min(side >> ch.vshift, ch.shape[0] - y), min(side >> ch.hshift, ch.shape[1] - x)
        if height > 0 and width > 0:
            part.channels.append(modular.Channel(np.zeros((height, width), np.int64), ch.hshift, ch.vshift))
            places.append((c, y, x))
    return part, places


def read_group(data: bytes, layout: modular.Layout, grid: Fields, group: int, stream: int, whole: tuple | None, low: int, high: int, dc: bool = False) -> list[tuple[int, int, int, np.ndarray]]:
    """The samples of one group: (channel, y, x, values)."""
    part, places = group_part(layout, grid, group, low, high, dc)
    if not places:
        return []
    header = modular.read_channels(BitReader(data), part, stream, whole)
    modular.undo(part, header["transforms"], header["weights"])
    return [(c, y, x, ch.v) for (c, y, x), ch in zip(places, part.channels, strict=True)]


def group_stream(grid: Fields, group: int, passed: int = 0) -> int:
    return 1 + 3 * grid["dc_groups"] + QUANT_TABLES + passed * grid["groups"] + group


def read_planes(data: bytes, image: Fields, frame: Frame) -> list[np.ndarray]:
    """All channels of a lossless frame."""
    if not frame.header["modular"]:
        raise ValueError("only lossless frames are read")
    grid = frame.grid
    layout = empty_layout(image, frame)
    cut = lambda k: data[frame.sections[k][0] : sum(frame.sections[k])]
    header, whole = read_dc_global(BitReader(cut(0)), frame, layout)
    if grid["sections"] > 1:
        for g in range(grid["dc_groups"]):
            found = read_group(cut(1 + g), layout, grid, g, 1 + grid["dc_groups"] + g, whole, 3, 1000, True)
            _put(layout, found)
        for k, (low, high) in enumerate(headers.shift_brackets(frame.header["passes"])):
            for g in range(grid["groups"]):
                at = 2 + grid["dc_groups"] + k * grid["groups"] + g
                _put(layout, read_group(cut(at), layout, grid, g, group_stream(grid, g, k), whole, low, high))
    modular.undo(layout, header["transforms"], header["weights"])
    return [c.v for c in layout.channels]


def _put(layout: modular.Layout, found: list[tuple[int, int, int, np.ndarray]]) -> None:
    for c, y, x, v in found:
        layout.channels[c].v[y : y + v.shape[0], x : x + v.shape[1]] = v


# -- writing ---------------------------------------------------------------------------------------------------


def lossless_header(width: int, height: int, channels: int, bits: int, **more) -> Fields:
    """channels: 1 gray, 2 gray and alpha, 3 colour, 4 colour and alpha; more: fields of the metadata."""
    colour = {"space": headers.GRAY} if channels < 3 else {}
    alpha = [{"type": headers.ALPHA, "depth": {"exp_bits": 0, "bits": bits}, "dim_shift": 0, "name": "", "associated": False}]
    plain = {"want_icc": False, "space": headers.RGB, "white": 1, "primaries": 1, "has_gamma": False, "gamma": 0, "transfer": 13, "intent": 1}
    meta = {"depth": {"exp_bits": 0, "bits": bits}, "narrow": bits <= 12, "extra": alpha * (channels % 2 == 0), "xyb": False, "colour": plain | colour}
    return {"size": {"width": width, "height": height}, "meta": meta | more}


def lossless_frame(group_shift: int = 1, **more) -> Fields:
    """Without filters; more: other fields of the frame header."""
    return {"type": headers.REGULAR, "modular": True, "group_shift": group_shift, "filter": {"gaborish": False, "passes": 0}, "is_last": True} | more


def best_colour(planes: list[np.ndarray], least_gain: float = 0.002) -> int:
    """The colour transform with the least entropy of gradient residuals; type 6 unless another gains more than the margin."""
    known: dict[bytes, float] = {}

    def cost(v: np.ndarray) -> float:
        key = v.tobytes()
        if key not in known:
            west, north, corner = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
            west[:, 1:], north[1:], corner[1:, 1:] = v[:, :-1], v[:-1], v[:-1, :-1]
            west[1:, 0], north[0], corner[0], corner[1:, 0] = v[:-1, 0], west[0], west[0], v[:-1, 0]
            low, high = np.minimum(west, north), np.maximum(west, north)
            off = v - np.where(corner > high, low, np.where(corner < low, high, west + north - corner))
            _, n = np.unique(off, return_counts=True)
            known[key] = float((n * np.log2(v.size / n)).sum())
        return known[key]

    costs = [sum(map(cost, modular.colour_forward(planes, k))) for k in range(42)]
    best = int(np.argmin(costs))
    return best if costs[best] < costs[6] * (1 - least_gain) else 6


def group_bytes(planes: list[np.ndarray], stream: int, bits: int = 8, prefix: bool = False) -> bytes:
    """The channels of one group as a stream: a palette, a colour transform or neither, whichever comes out smaller."""
    tried = []
    colours = len(planes) // 3 * 3
    layout = modular.Layout([modular.Channel(v.astype(np.int64)) for v in planes], bits=bits)
    found = modular.palette_forward(layout, 0, max(1, colours))
    if found:
        tried.append((layout, [found]))
    if not found or found["colours"] > 64:
        layout = modular.Layout([modular.Channel(v.astype(np.int64)) for v in planes], bits=bits)
        steps = []
        if colours:
            steps = [{"kind": 0, "begin": 0, "type": best_colour([c.v for c in layout.channels[:3]])}]
            modular.apply_forward(layout, steps[0])
        tried.append((layout, steps))
    out = []
    for layout, steps in tried:
        w = BitWriter()
        modular.write_channels(w, layout, stream, modular.gradient_tree(len(layout.channels)), steps, prefix=prefix)
        out.append(w.bytes())
    return min(out, key=len)


def dc_global_bytes() -> bytes:
    """The first section of several: usual DC factors, and a tree for all groups that none of ours uses."""
    w = BitWriter()
    w.write(1, 1)
    tree = modular.number_leaves([modular.Node()])
    w.write(1, 1)
    modular.write_tree(w, tree)
    write_code(w, build_code([], 1), 1)
    modular.stream_header(headers.Write(w), {"global_tree": True, "weights": modular.USUAL_WEIGHTS, "transforms": []})
    return w.bytes()


def lone_section(planes: list[np.ndarray], bits: int, prefix: bool = False) -> bytes:
    """The only section of an image with one group; its stream follows two flags."""
    body = group_bytes(planes, 0, bits, prefix)
    w = BitWriter()
    w.write(0b01, 2)  # usual DC factors, no tree for all groups
    w.write(int.from_bytes(body, "little"), 8 * len(body))
    return w.bytes()


def assemble(image: Fields, frame: Fields, sections: list[bytes], order: list[int] | None = None, profile: bytes | None = None) -> bytes:
    """A codestream of one frame. sections: logical; order: where in the file each lies."""
    w = BitWriter()
    full = headers.codestream_header(headers.Write(w), image)
    if profile is not None:
        write_icc(w, profile)
    w.align()
    headers.frame_header(headers.Write(w), frame, full)
    lying = list(sections)
    if order is not None:
        for logical, place in enumerate(order):
            lying[place] = sections[logical]
    write_toc(w, [len(x) for x in lying], order)
    return w.bytes() + b"".join(lying)


def write_image(planes: list[np.ndarray], bits: int = 8, group_shift: int = 1, prefix: bool = False) -> bytes:
    """A whole lossless image in one call."""
    height, width = planes[0].shape
    image, frame = lossless_header(width, height, len(planes), bits), lossless_frame(group_shift)
    side = 128 << group_shift
    if max(width, height) <= side:
        return assemble(image, frame, [lone_section(planes, bits, prefix)])
    across, down = -(-width // side), -(-height // side)
    dc = -(-width // (8 * side)) * -(-height // (8 * side))
    sections = [dc_global_bytes(), *[b""] * (dc + 1)]
    for g in range(across * down):
        y, x = g // across * side, g % across * side
        sections.append(group_bytes([v[y : y + side, x : x + side] for v in planes], 1 + 3 * dc + QUANT_TABLES + g, bits, prefix))
    return assemble(image, frame, sections)


def read_image(data: bytes) -> tuple[Fields, list[np.ndarray]]:
    image, _, frames = read_heads(data)
    return image, read_planes(data, image, frames[0])
