"""Headers of a codestream: size, metadata, colour, extra channels, frames, tables of sections.

A bundle is described once, as a function over an `io`, and serves both directions: with Read it takes fields from
the bits, with Write it puts the given ones there. Either way it returns all fields, those that aren't signalled with
the value that the format gives them. Field widths, offsets and codes are fixed by the format.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from . import entropy

Fields = dict[str, Any]


class Read:
    writing = False

    def __init__(self, reader: entropy.BitReader):
        self.stream = reader

    def bits(self, n: int, value: int = 0) -> int:
        return self.stream.read(n)

    def u32(self, choices, value: int = 0) -> int:
        return entropy.read_u32(self.stream, choices)

    def u64(self, value: int = 0) -> int:
        return entropy.read_u64(self.stream)

    def f16(self, value: float = 0.0) -> float:
        return entropy.half_to_float(self.stream.read(16))


class Write:
    writing = True

    def __init__(self, writer: entropy.BitWriter):
        self.stream = writer

    def bits(self, n: int, value: int = 0) -> int:
        self.stream.write(int(value), n)
        return int(value)

    def u32(self, choices, value: int = 0) -> int:
        entropy.write_u32(self.stream, value, choices)
        return value

    def u64(self, value: int = 0) -> int:
        entropy.write_u64(self.stream, value)
        return value

    def f16(self, value: float = 0.0) -> float:
        bits = entropy.float_to_half(value)
        self.stream.write(bits, 16)
        return entropy.half_to_float(bits)


Io = Read | Write
#: How fields choose their widths, as (offset, bits) four times.
ENUM = ((0, 0), (1, 0), (2, 4), (18, 6))
SIDE = ((1, 9), (1, 13), (1, 18), (1, 30))
XY = ((0, 19), (1 << 19, 19), (1 << 20, 20), (1 << 21, 21))
NAME = ((0, 0), (0, 4), (16, 5), (48, 10))
CROP = ((0, 8), (256, 11), (2304, 14), (18688, 30))
SMALL = ((0, 0), (1, 0), (2, 0), (3, 0))
SCALES = ((1, 0), (2, 0), (4, 0), (8, 0))
SECTION = ((0, 10), (1024, 14), (17408, 22), (4211712, 30))
#: Width over height of the ratios 1 to 7.
RATIOS = ((1, 1), (12, 10), (4, 3), (3, 2), (16, 9), (5, 4), (2, 1))
ALPHA, SPOT, FILTER_ARRAY = 0, 2, 5
RGB, GRAY, XYB_SPACE = 0, 1, 2
REGULAR, DC, REFERENCE_ONLY, SKIP = 0, 1, 2, 3
USES_DC = 32


class Bundle:
    """Fields by name; `given` are those to write, or none."""

    def __init__(self, io: Io, given: Fields | None):
        self.io, self.v = io, dict(given or {})

    def bits(self, name: str, n: int, usual: int = 0) -> int:
        self.v[name] = self.io.bits(n, self.v.get(name, usual))
        return self.v[name]

    def flag(self, name: str, usual: bool = False) -> bool:
        self.v[name] = bool(self.io.bits(1, int(self.v.get(name, usual))))
        return self.v[name]

    def u32(self, name: str, choices, usual: int = 0) -> int:
        self.v[name] = self.io.u32(choices, self.v.get(name, usual))
        return self.v[name]

    def f16(self, name: str, usual: float = 0.0) -> float:
        self.v[name] = self.io.f16(self.v.get(name, usual))
        return self.v[name]

    def u64(self, name: str, usual: int = 0) -> int:
        self.v[name] = self.io.u64(self.v.get(name, usual))
        return self.v[name]

    def part(self, name: str, bundle: Callable, *args) -> Fields:
        self.v[name] = bundle(self.io, self.v.get(name), *args)
        return self.v[name]

    def usual(self, **values) -> None:
        for name, value in values.items():
            self.v.setdefault(name, value)

    def all_default(self, **values) -> bool:
        """The first flag of a bundle: whether all fields are the usual ones, which are then filled in."""
        plain = all(self.v.get(k, x) == x for k, x in values.items())
        plain = bool(self.io.bits(1, int(plain)))
        if plain:
            self.v.update(values)
        return plain


def signed(b: Bundle, name: str, choices) -> int:
    value = b.v.get(name, 0)
    packed = b.io.u32(choices, 2 * value if value >= 0 else -2 * value - 1)
    b.v[name] = -(packed + 1) // 2 if packed & 1 else packed // 2
    return b.v[name]


def text(io: Io, given: str | None) -> str:
    raw = (given or "").encode()
    n = io.u32(NAME, len(raw))
    got = bytes(io.bits(8, raw[k] if io.writing else 0) for k in range(n))
    return got.decode("utf-8", "replace")


def extensions(io: Io, given: Fields | None = None) -> Fields:
    """Extensions of unknown content are skipped. Their sizes may point past the end; the reader then stops there."""
    known = io.u64((given or {}).get("extensions", 0))
    if io.writing:
        if known:
            raise ValueError("no extension can be written")
        return {"extensions": 0}
    sizes = [io.u64() for k in range(64) if known >> k & 1]
    io.stream.skip(sum(sizes))
    return {"extensions": known}


def width_of(ratio: int, height: int) -> int:
    over, under = RATIOS[ratio - 1]
    return height * over // under


def size_header(io: Io, given: Fields | None = None) -> Fields:
    b = Bundle(io, given)
    b.usual(width=0, height=0)
    h, w = b.v["height"], b.v["width"]
    ratio = next((k for k in range(1, 8) if io.writing and width_of(k, h) == w), 0)
    small = io.writing and h % 8 == 0 and 8 <= h <= 256 and (ratio or (w % 8 == 0 and 8 <= w <= 256))
    small = io.bits(1, int(bool(small)))
    side = lambda v: 8 * (1 + io.bits(5, v // 8 - 1)) if small else io.u32(SIDE, v)
    h = side(h)
    ratio = io.bits(3, ratio)
    return {"height": h, "width": width_of(ratio, h) if ratio else side(w)}


def preview_header(io: Io, given: Fields | None = None) -> Fields:
    b = Bundle(io, given)
    b.usual(width=8, height=8)
    h, w = b.v["height"], b.v["width"]
    eighths = io.bits(1, int(h % 8 == 0 and w % 8 == 0))
    wide = ((16, 0), (32, 0), (1, 5), (33, 9)), ((1, 6), (65, 8), (321, 10), (1345, 12))
    side = lambda v: 8 * io.u32(wide[0], v // 8) if eighths else io.u32(wide[1], v)
    h = side(h)
    ratio = io.bits(3, next((k for k in range(1, 8) if io.writing and width_of(k, h) == w), 0))
    return {"height": h, "width": width_of(ratio, h) if ratio else side(w)}


def animation_header(io: Io, given: Fields | None = None) -> Fields:
    b = Bundle(io, given)
    b.u32("tps_num", ((100, 0), (1000, 0), (1, 10), (1, 30)), 100)
    b.u32("tps_den", ((1, 0), (1001, 0), (1, 8), (1, 10)), 1)
    b.u32("loops", ((0, 0), (0, 3), (0, 16), (0, 32)))
    b.flag("timecodes")
    return b.v


def bit_depth(io: Io, given: Fields | None = None) -> Fields:
    b = Bundle(io, given)
    b.usual(exp_bits=0)
    if b.io.bits(1, int(b.v["exp_bits"] > 0)):
        b.u32("bits", ((32, 0), (16, 0), (24, 0), (1, 6)), 32)
        b.v["exp_bits"] = 1 + io.bits(4, b.v["exp_bits"] - 1 if io.writing else 0)
    else:
        b.u32("bits", ((8, 0), (10, 0), (12, 0), (1, 6)), 8)
        b.v["exp_bits"] = 0
    return b.v


def extra_channel(io: Io, given: Fields | None = None) -> Fields:
    b = Bundle(io, given)
    usual = {"type": ALPHA, "depth": {"exp_bits": 0, "bits": 8}, "dim_shift": 0, "name": "", "associated": False}
    if b.all_default(**usual):
        return b.v
    b.u32("type", ENUM)
    b.part("depth", bit_depth)
    b.u32("dim_shift", ((0, 0), (3, 0), (4, 0), (1, 3)))
    b.v["name"] = text(io, b.v.get("name"))
    b.usual(associated=False)
    if b.v["type"] == ALPHA:
        b.flag("associated")
    if b.v["type"] == SPOT:
        given_spot = b.v.get("spot") or [0.0] * 4
        b.v["spot"] = [io.f16(x) for x in given_spot]
    if b.v["type"] == FILTER_ARRAY:
        b.u32("filter_array", ((1, 0), (0, 2), (3, 4), (19, 8)), 1)
    return b.v


def chromaticity(io: Io, given: Fields | None = None) -> Fields:
    """In millionths."""
    b = Bundle(io, given)
    signed(b, "x", XY)
    signed(b, "y", XY)
    return b.v


def colour_encoding(io: Io, given: Fields | None = None) -> Fields:
    b = Bundle(io, given)
    usual = {"want_icc": False, "space": RGB, "white": 1, "primaries": 1, "has_gamma": False, "gamma": 0, "transfer": 13, "intent": 1}
    if b.all_default(**usual):
        return b.v
    b.flag("want_icc")
    space = b.u32("space", ENUM)
    if not b.v["want_icc"]:
        if space != XYB_SPACE:
            if b.u32("white", ENUM, 1) == 2:
                b.part("white_xy", chromaticity)
            if space != GRAY and b.u32("primaries", ENUM, 1) == 2:
                given_xy = b.v.get("primaries_xy") or [None] * 3
                b.v["primaries_xy"] = [chromaticity(io, x) for x in given_xy]
            if b.flag("has_gamma"):
                b.bits("gamma", 24)
            else:
                b.u32("transfer", ENUM, 13)
        b.u32("intent", ENUM, 1)
    b.usual(**usual)
    return b.v


def tone_mapping(io: Io, given: Fields | None = None) -> Fields:
    b = Bundle(io, given)
    usual = {"intensity": 255.0, "min_nits": 0.0, "relative": False, "linear_below": 0.0}
    if not b.all_default(**usual):
        b.f16("intensity", 255.0)
        b.f16("min_nits")
        b.flag("relative")
        b.f16("linear_below")
    return b.v


def image_metadata(io: Io, given: Fields | None = None) -> Fields:
    b = Bundle(io, given)
    plain_colour = {"want_icc": False, "space": RGB, "white": 1, "primaries": 1, "has_gamma": False, "gamma": 0, "transfer": 13, "intent": 1}
    plain_tone = {"intensity": 255.0, "min_nits": 0.0, "relative": False, "linear_below": 0.0}
    usual = {"orientation": 1, "depth": {"exp_bits": 0, "bits": 8}, "narrow": True, "extra": [], "xyb": True, "colour": plain_colour, "tone": plain_tone}
    if b.all_default(**usual):
        return b.v
    b.usual(orientation=1, tone=plain_tone)
    options = ("intrinsic", "preview", "animation")
    more = b.v["orientation"] != 1 or any(b.v.get(x) for x in options) or b.v["tone"] != plain_tone
    if io.bits(1, int(more)):
        b.v["orientation"] = 1 + io.bits(3, b.v["orientation"] - 1)
        for name, bundle in zip(options, (size_header, preview_header, animation_header), strict=True):
            if io.bits(1, int(bool(b.v.get(name)))):
                b.part(name, bundle)
        more = True
    b.part("depth", bit_depth)
    b.flag("narrow", True)
    given_extra = b.v.get("extra") or []
    n = io.u32(((0, 0), (1, 0), (2, 4), (1, 12)), len(given_extra))
    b.v["extra"] = [extra_channel(io, given_extra[k] if io.writing else None) for k in range(n)]
    b.flag("xyb", True)
    b.part("colour", colour_encoding)
    if more:
        b.part("tone", tone_mapping)
    extensions(io)
    return b.v


def custom_transforms(io: Io, given: Fields | None, xyb: bool) -> Fields:
    """An own inverse opsin matrix with its biases, and own upsampling weights."""
    b = Bundle(io, given)
    if b.all_default(opsin=None, up2=None, up4=None, up8=None):
        return b.v
    if xyb and not io.bits(1, int(not b.v.get("opsin"))):
        b.v["opsin"] = [io.f16(x) for x in (b.v.get("opsin") or [0.0] * 16)]
    names = ("up2", "up4", "up8")
    mask = io.bits(3, sum(1 << k for k, x in enumerate(names) if b.v.get(x)))
    for k, (name, n) in enumerate(zip(names, (15, 55, 210), strict=True)):
        b.v[name] = [io.f16(x) for x in (b.v.get(name) or [0.0] * n)] if mask >> k & 1 else None
    b.usual(opsin=None)
    return b.v


def codestream_header(io: Io, given: Fields | None = None) -> Fields:
    """Signature, size, metadata and custom transforms; what follows is an ICC profile, if one is wanted, then frames."""
    b = Bundle(io, given)
    if io.bits(16, 0x0AFF) != 0x0AFF:
        raise ValueError("no codestream")
    b.part("size", size_header)
    b.part("meta", image_metadata)
    b.part("custom", custom_transforms, b.v["meta"]["xyb"])
    return b.v


def passes_bundle(io: Io, given: Fields | None = None) -> Fields:
    b = Bundle(io, given)
    n = b.u32("n", ((1, 0), (2, 0), (3, 0), (4, 3)), 1)
    b.usual(shifts=[0] * n, downsample=[], last=[])
    if n != 1:
        m = io.u32(((0, 0), (1, 0), (2, 0), (3, 1)), len(b.v["downsample"]))
        each = lambda name, k: b.v[name][k] if io.writing else 0
        b.v["shifts"] = [*(io.bits(2, each("shifts", k)) for k in range(n - 1)), 0]
        b.v["downsample"] = [io.u32(SCALES, each("downsample", k)) for k in range(m)]
        b.v["last"] = [io.u32(((0, 0), (1, 0), (2, 0), (0, 3)), each("last", k)) for k in range(m)]
    return b.v


def shift_brackets(passes: Fields) -> list[tuple[int, int]]:
    """For each pass the least and greatest squeeze shift of the channels that it carries."""
    out, high = [], 2
    for k in range(passes["n"]):
        low = high
        for scale, last in zip(passes["downsample"], passes["last"], strict=True):
            if last == k:
                low = min(low, scale.bit_length() - 1)
        if k == passes["n"] - 1:
            low = 0
        out.append((low, high))
        high = low - 1
    return out


def blending(io: Io, given: Fields | None, n_extra: int, partial: bool) -> Fields:
    """mode: 0 replace, 1 add, 2 blend, 3 weighted add, 4 multiply."""
    b = Bundle(io, given)
    b.usual(alpha=0, clamp=False, source=0)
    mode = b.u32("mode", ((0, 0), (1, 0), (2, 0), (3, 2)))
    uses_alpha = n_extra > 0 and mode in (2, 3)
    if uses_alpha:
        b.u32("alpha", ((0, 0), (1, 0), (2, 0), (3, 3)))
    if uses_alpha or mode == 4:
        b.flag("clamp")
    if mode or partial:
        b.u32("source", SMALL)
    return b.v


#: The usual weights of the 3 x 3 smoothing (side, corner), for each channel.
GABORISH = [0.115169525, 0.061248592] * 3


def loop_filter(io: Io, given: Fields | None, modular: bool) -> Fields:
    b = Bundle(io, given)
    b.usual(weights=None, sharpness=None, scale=None, sigma=None)
    if b.all_default(gaborish=True, passes=2, weights=None, sharpness=None, scale=None, sigma=None, flat_sigma=1.0):
        return b.v
    halves = lambda name, n: [io.f16(x) for x in (b.v.get(name) or [0.0] * n)] if io.bits(1, int(b.v.get(name) is not None)) else None
    if b.flag("gaborish", True):
        b.v["weights"] = halves("weights", 6)
    b.usual(flat_sigma=1.0)
    if b.bits("passes", 2, 2):
        if not modular:
            b.v["sharpness"] = halves("sharpness", 8)
        b.v["scale"] = halves("scale", 5)
        b.v["sigma"] = halves("sigma", 3 if modular else 4)
        if modular:
            b.f16("flat_sigma", 1.0)
    extensions(io)
    return b.v


def frame_header(io: Io, given: Fields | None, image: Fields) -> Fields:
    """image: the fields of codestream_header. type: 0 regular, 1 DC, 2 reference only, 3 skipped when progressive."""
    meta, size = image["meta"], image["size"]
    n_extra, animated = len(meta["extra"]), meta.get("animation")
    b = Bundle(io, given)
    # No frame that this writes is all default, so the flag is only ever read as such.
    if io.bits(1, 0):
        filters = {"gaborish": True, "passes": 2, "weights": None, "sharpness": None, "scale": None, "sigma": None, "flat_sigma": 1.0}
        flat = {"mode": 0, "alpha": 0, "clamp": False, "source": 0}
        b.usual(type=REGULAR, modular=False, flags=0, ycbcr=False, upsampling=1, ec_upsampling=[1] * n_extra, group_shift=1, x_scale=3, b_scale=2)
        b.usual(passes={"n": 1, "shifts": [0], "downsample": [], "last": []}, crop=None, blend=flat, ec_blend=[flat] * n_extra, duration=0, is_last=True, save_as=0, before_colour=False, name="", filter=filters)
        return b.v
    kind = b.u32("type", SMALL)
    modular = b.flag("modular")
    flags = b.u64("flags")
    scales = [1 << x["dim_shift"] for x in meta["extra"]]
    b.usual(ycbcr=False, upsampling=1, ec_upsampling=scales, group_shift=1, x_scale=3, b_scale=2, passes={"n": 1, "shifts": [0], "downsample": [], "last": []})
    b.usual(crop=None, blend={"mode": 0, "alpha": 0, "clamp": False, "source": 0}, ec_blend=[], duration=0, is_last=kind in (REGULAR, SKIP) if io.writing else False, save_as=0, before_colour=kind == DC)
    if not meta["xyb"]:
        b.flag("ycbcr")
    if b.v["ycbcr"] and not flags & USES_DC:
        given_modes = b.v.get("chroma") or [0, 0, 0]
        b.v["chroma"] = [io.bits(2, x) for x in given_modes]
    if not flags & USES_DC:
        b.u32("upsampling", SCALES, 1)
        given_scales = b.v["ec_upsampling"]
        b.v["ec_upsampling"] = [io.u32(SCALES, given_scales[k] >> x["dim_shift"]) << x["dim_shift"] for k, x in enumerate(meta["extra"])]
    if modular:
        b.bits("group_shift", 2, 1)
    elif meta["xyb"]:
        b.bits("x_scale", 3, 3)
        b.bits("b_scale", 3, 2)
    if kind != REFERENCE_ONLY:
        b.part("passes", passes_bundle)
    if kind == DC:
        b.u32("dc_level", ((1, 0), (2, 0), (3, 0), (4, 0)), 1)
    partial = False
    if kind != DC and io.bits(1, int(bool(b.v["crop"]))):
        crop = Bundle(io, b.v["crop"])
        crop.usual(x=0, y=0)
        if kind != REFERENCE_ONLY:
            signed(crop, "x", CROP)
            signed(crop, "y", CROP)
        crop.u32("width", CROP)
        crop.u32("height", CROP)
        b.v["crop"] = c = crop.v
        partial = kind != REFERENCE_ONLY and (c["x"] > 0 or c["y"] > 0 or c["x"] + c["width"] < size["width"] or c["y"] + c["height"] < size["height"])
    if kind in (REGULAR, SKIP):
        b.part("blend", blending, n_extra, partial)
        given_blend = b.v["ec_blend"] or [None] * n_extra
        b.v["ec_blend"] = [blending(io, given_blend[k], n_extra, partial) for k in range(n_extra)]
        if animated:
            b.u32("duration", ((0, 0), (1, 0), (0, 8), (0, 32)))
            if animated["timecodes"]:
                b.bits("timecode", 32)
        b.flag("is_last", True)
    if kind != DC and not b.v["is_last"]:
        b.u32("save_as", SMALL)
    referable = not b.v["is_last"] and kind != DC and (not b.v["duration"] or b.v["save_as"])
    if kind == REFERENCE_ONLY or (kind in (REGULAR, SKIP) and referable and not partial and b.v["blend"]["mode"] == 0):
        b.flag("before_colour")
    b.v["name"] = text(io, b.v.get("name"))
    b.part("filter", loop_filter, modular)
    extensions(io)
    return b.v


def frame_grid(image: Fields, frame: Fields) -> Fields:
    """Sizes in samples, groups and DC groups of a frame, and how many sections it has."""
    size = frame["crop"] or image["size"]
    w, h = size["width"], size["height"]
    up = lambda v, by: -(-v // by)
    if frame["type"] == DC:
        w, h = (up(v, 8 ** frame["dc_level"]) for v in (w, h))
    w, h = up(w, frame["upsampling"]), up(h, frame["upsampling"])
    if 0 in (w, h) or (up(w, 8) * 8) * (up(h, 8) * 8) >= 1 << 30:
        raise ValueError("more samples than a frame may have")
    group = 128 << frame["group_shift"]
    across, down = up(w, group), up(h, group)
    dc = up(w, 8 * group) * up(h, 8 * group)
    n, passes = across * down, frame["passes"]["n"]
    return {"width": w, "height": h, "group": group, "across": across, "down": down, "groups": n, "dc_groups": dc, "sections": 1 if n == 1 and passes == 1 else 2 + dc + n * passes}
