"""Colour formulas as SQL text, in double precision. Arguments are SQL expressions."""

from __future__ import annotations

import math

# The opsin absorbance bias and inverse matrix of XYB.
OPSIN_BIAS = 0.0037930732552754493
INVERSE_OPSIN = (
    (11.031566901960783, -9.866943921568629, -0.16462299647058826),
    (-3.254147380392157, 4.418770392156863, -0.16462299647058826),
    (-3.6588512862745097, 2.7129230470588235, 1.9459282392156863),
)
# SMPTE ST 2084 (PQ) and ARIB STD-B67 (HLG).
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3 = 2610.0 / 16384, 2523.0 / 4096 * 128, 3424.0 / 4096, 2413.0 / 4096 * 32, 2392.0 / 4096 * 32
HLG_A = 0.17883277
HLG_B = 1.0 - 4.0 * HLG_A
HLG_C = 0.5 - HLG_A * math.log(4.0 * HLG_A)


def num(x: float) -> str:
    return f"cast('{x!r}' as double)"


def clamp(v: str, low: str = "0.0", high: str = "1.0") -> str:
    return f"least(greatest({v}, cast({low} as double)), cast({high} as double))"


def inverse3(m: tuple[tuple[float, ...], ...]) -> tuple[tuple[float, ...], ...]:
    """A 3x3 inverse from cofactors, on the driver."""
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    rows = ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))
    return tuple(tuple(x / det for x in r) for r in rows)


OPSIN = inverse3(INVERSE_OPSIN)

ENCODE = {
    "linear": lambda v: v,
    "srgb": lambda v: f"case when {v} <= 0.0031308 then 12.92 * {v} else 1.055 * pow({v}, {num(1.0 / 2.4)}) - 0.055 end",
    "bt709": lambda v: f"case when {v} < 0.018 then 4.5 * {v} else 1.099 * pow({v}, 0.45) - 0.099 end",
    "dci": lambda v: f"pow({v}, {num(1.0 / 2.6)})",
    "gamma22": lambda v: f"pow({v}, {num(1.0 / 2.2)})",
    "pq": lambda v: f"case when {v} = 0 then 0.0 else pow(({num(PQ_C1)} + {_pq(v)} * {num(PQ_C2)}) / (1.0 + {_pq(v)} * {num(PQ_C3)}), {num(PQ_M2)}) end",
    "hlg": lambda v: f"case when {v} <= {num(1.0 / 12)} then sqrt(3.0 * {v}) else {num(HLG_A)} * ln(12.0 * {v} - {num(HLG_B)}) + {num(HLG_C)} end",
}


def _pq(v: str, target: float = 255.0) -> str:
    return f"pow({v} * {num(target / 10000.0)}, {num(PQ_M1)})"


DECODE = {
    "linear": lambda s: s,
    "srgb": lambda s: f"case when {s} <= {num(0.0031308 * 12.92)} then {s} / 12.92 else pow(({s} + 0.055) / 1.055, 2.4) end",
    "bt709": lambda s: f"case when {s} < 0.081 then {s} / 4.5 else pow(({s} + 0.099) / 1.099, {num(1.0 / 0.45)}) end",
    "dci": lambda s: f"pow({s}, 2.6)",
    "gamma22": lambda s: f"pow({s}, 2.2)",
    "pq": lambda s: (
        f"case when {s} = 0 then 0.0 else pow(greatest(pow({s}, {num(1 / PQ_M2)}) - {num(PQ_C1)}, 0.0) / ({num(PQ_C2)} - {num(PQ_C3)} * pow({s}, {num(1 / PQ_M2)})), {num(1 / PQ_M1)}) * {num(10000.0 / 255.0)} end"
    ),
    "hlg": lambda s: f"case when {s} <= 0.5 then {s} * {s} / 3.0 else (exp(({s} - {num(HLG_C)}) / {num(HLG_A)}) + {num(HLG_B)}) / 12.0 end",
}


def extended(kind: str, v: str) -> str:
    """Sign-preserving encoding without clamping."""
    return f"case when {v} < 0 then -({ENCODE[kind](f'abs({v})')}) else {ENCODE[kind](v)} end"


def to_xyb(r: str, g: str, b: str) -> tuple[str, str, str]:
    """Linear RGB to XYB."""
    root = [f"cbrt(greatest({' + '.join(f'{num(m)} * {v}' for m, v in zip(row, (r, g, b), strict=True))} + {num(OPSIN_BIAS)}, 0.0))" for row in OPSIN]
    bias = num(OPSIN_BIAS ** (1 / 3))
    return f"({root[0]} - {root[1]}) * 0.5", f"({root[0]} + {root[1]}) * 0.5 - {bias}", f"{root[2]} - {bias}"


def from_xyb(x: str, y: str, b: str) -> tuple[str, str, str]:
    """XYB to linear RGB."""
    bias = num(OPSIN_BIAS ** (1 / 3))
    cube = [f"(({v}) * ({v}) * ({v}) - {num(OPSIN_BIAS)})" for v in (f"{y} + {x} + {bias}", f"{y} - {x} + {bias}", f"{b} + {bias}")]
    return tuple(" + ".join(f"{num(m)} * {c}" for m, c in zip(row, cube, strict=True)) for row in INVERSE_OPSIN)


def ycbcr_to_rgb(y: str, cb: str, cr: str) -> tuple[str, str, str]:
    """JFIF 601, components centred on 0 but for y, in 0..1."""
    return (
        f"{y} + 1.402 * {cr}",
        f"{y} - {num(0.114 * 1.772 / 0.587)} * {cb} - {num(0.299 * 1.402 / 0.587)} * {cr}",
        f"{y} + 1.772 * {cb}",
    )


def quantise(v: str, top: int = 255) -> str:
    """Clamped to 0..1, then to 0..top, halves away from zero."""
    return f"cast(round({clamp(v)} * {top}) as int)"
