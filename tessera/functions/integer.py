"""Integer formulas of the lossless path, as SQL text. Arguments are SQL expressions."""

from __future__ import annotations

from .dialect import Dialect


def clamped_gradient(left: str, top: str, topleft: str) -> str:
    low, high = f"least({left}, {top})", f"greatest({left}, {top})"
    return f"case when {topleft} > {high} then {low} when {topleft} < {low} then {high} else {left} + {top} - {topleft} end"


def select_nearer(left: str, top: str, topleft: str) -> str:
    """Whichever of left and top is nearer to left + top - topleft; top when they are equally near."""
    return f"case when abs({top} - {topleft}) < abs({left} - {topleft}) then {left} else {top} end"


#: Names of the causal neighbours that a predictor may use.
CAUSAL = ("left_", "top_", "topleft", "topright", "leftleft", "toptop", "toprightright")


def predictors(d: Dialect) -> dict[int, str]:
    """The fourteen fixed predictors but the weighted one, over the names in CAUSAL."""
    half = lambda a, b: d.div(f"{a} + {b}", "2")
    return {
        0: "0",
        1: "left_",
        2: "top_",
        3: half("left_", "top_"),
        4: select_nearer("left_", "top_", "topleft"),
        5: clamped_gradient("left_", "top_", "topleft"),
        7: "topright",
        8: "topleft",
        9: "leftleft",
        10: half("left_", "topleft"),
        11: half("topleft", "top_"),
        12: half("top_", "topright"),
        13: d.div("6 * top_ - 2 * toptop + 7 * left_ + leftleft + toprightright + 3 * topright + 8", "16"),
    }


#: Properties of a pixel's causal neighbourhood that a context tree may test (numbers as in the format).
PROPERTIES = {
    "p4": "abs(top_)",
    "p5": "abs(left_)",
    "p6": "top_",
    "p7": "left_",
    "p9": "left_ + top_ - topleft",
    "p10": "left_ - topleft",
    "p11": "topleft - top_",
    "p12": "top_ - topright",
    "p13": "top_ - toptop",
    "p14": "left_ - leftleft",
}


def zigzag(v: str) -> str:
    """Signed to unsigned: 0, -1, 1, -2 ... become 0, 1, 2, 3 ..."""
    return f"case when {v} >= 0 then 2 * ({v}) else -2 * ({v}) - 1 end"


def unzigzag(d: Dialect, u: str) -> str:
    return f"case when {u} % 2 = 0 then {d.div(u, '2')} else -{d.div(f'{u} + 1', '2')} end"


def hybrid_token(d: Dialect, u: str, split: int = 4, msb: int = 2, lsb: int = 0) -> str:
    """Token of an unsigned value: itself below 2^split, else its exponent with `msb` leading and `lsb` last bits."""
    n = d.floor_log2(u)
    mantissa = f"({u} - {d.shl('1', n)})"
    top = d.shr(mantissa, f"{n} - {msb}")
    low = f"({u} & {(1 << lsb) - 1})"
    return f"case when {u} < {1 << split} then {u} else {1 << split} + ({n} - {split}) * {1 << (msb + lsb)} + {top} * {1 << lsb} + {low} end"


def hybrid_bits(d: Dialect, u: str, split: int = 4, msb: int = 2, lsb: int = 0) -> str:
    """Raw bits that follow the token."""
    return f"case when {u} < {1 << split} then 0 else {d.floor_log2(u)} - {msb + lsb} end"


def smooth_tendency(d: Dialect, b: str, a: str, n: str) -> str:
    """What the difference of a pair is expected to be, from the pixel before and the averages here and next.

    Where these rise or fall throughout: a third of the step before and a quarter of the step after, but no more than keeps
    the pair between the two, whose first sample takes half of the difference rounded down and the second the rest.
    """
    before, after = f"abs({b} - {a})", f"abs({a} - {n})"
    size = f"least({d.div(f'4 * {before} + 3 * {after} + 6', '12')}, 2 * {before} + 1, 2 * {after})"
    return f"case when ({b} - {a}) * ({a} - {n}) < 0 then 0 when {b} > {a} or {a} > {n} then {size} else -({size}) end"


def squeeze_average(d: Dialect, a: str, b: str) -> str:
    """The mean of a pair, rounded up when the first is the larger."""
    return d.shr(f"{a} + {b} + case when {a} > {b} then 1 else 0 end", "1")


def rct_forward(d: Dialect, kind: int) -> tuple[str, str, str]:
    """Reversible colour transform `kind` (0-41) of planes c0, c1, c2; permutation kind div 7, mix kind mod 7."""
    order, mix = divmod(kind, 7)
    # Where the inverse puts its three results is where the forward direction takes its three inputs.
    source = (order % 3, (order + 1 + order // 3) % 3, (order + 2 - order // 3) % 3)
    a, b, c = (f"cast(c{k} as bigint)" for k in source)
    if mix == 6:
        co = f"({a} - {c})"
        tmp = f"({c} + {d.shr(co, '1')})"
        cg = f"({b} - {tmp})"
        return d.wrap32(f"{tmp} + {d.shr(cg, '1')}"), d.wrap32(co), d.wrap32(cg)
    second, third = mix >> 1, mix & 1
    mid = {0: b, 1: f"{b} - {a}", 2: f"{b} - {d.shr(f'{a} + {c}', '1')}"}.get(second, b)
    last = f"{c} - {a}" if third else c
    return d.wrap32(a), d.wrap32(mid), d.wrap32(last)


def rct_inverse(d: Dialect, kind: int) -> tuple[str, str, str]:
    """Undoes rct_forward."""
    order, mix = divmod(kind, 7)
    a, b, c = "cast(c0 as bigint)", "cast(c1 as bigint)", "cast(c2 as bigint)"
    if mix == 6:
        tmp = f"({a} - {d.shr(c, '1')})"
        blue = f"({tmp} - {d.shr(b, '1')})"
        got = (f"{blue} + {b}", f"{c} + {tmp}", blue)
    else:
        second, third = mix >> 1, mix & 1
        last = f"({c} + {a})" if third else c
        mid = {0: b, 1: f"{b} + {a}", 2: f"{b} + {d.shr(f'{a} + {last}', '1')}"}.get(second, b)
        got = (a, mid, last)
    place = (order % 3, (order + 1 + order // 3) % 3, (order + 2 - order // 3) % 3)
    out = {p: d.wrap32(g) for p, g in zip(place, got, strict=True)}
    return out[0], out[1], out[2]


def palette_implicit(d: Dialect, index: str, size: int, c: int, bits: int = 8) -> str:
    """Values past an explicit palette of `size`: a 4x4x4 cube, then a 5x5x5 cube."""
    top = (1 << bits) - 1
    small = f"({d.shr(f'{index} - {size}', str(2 * c))} % 4)"
    large = f"({d.div(f'{index} - {size + 64}', str(5**c))} % 5)"
    scale = lambda v: d.shr(f"{v} * {top}", "2")
    return f"case when {index} < {size + 64} then {scale(small)} + {1 << max(0, bits - 3)} else {scale(large)} end"
