"""Colour matrices, and the format's approximations of functions, in numpy single precision."""

from __future__ import annotations

import numpy as np

from .colour import inverse3

Matrix = tuple[tuple[float, ...], ...]
#: Chromaticities of white points and primaries by their code in the colour encoding, and the cone matrix of Bradford.
WHITES = {1: (0.3127, 0.3290), 10: (1 / 3, 1 / 3), 11: (0.314, 0.351)}
PRIMARIES = {1: ((0.639998686, 0.330010138), (0.300003784, 0.600003357), (0.150002046, 0.059997204)), 9: ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046)), 11: ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060))}
CONES: Matrix = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(sum(a[i][k] * b[k][j] for k in range(3)) for j in range(len(b[0]))) for i in range(3))


def xyz(xy: tuple[float, float]) -> Matrix:
    """A chromaticity as a column of luminance 1."""
    x, y = xy
    return ((x / y,), (1.0,), ((1 - x - y) / y,))


def rgb_to_xyz(primaries: tuple, white: tuple[float, float]) -> Matrix:
    """The matrix whose columns are the primaries, scaled so that equal parts give the white."""
    columns = tuple(tuple(xyz(p)[i][0] for p in primaries) for i in range(3))
    parts = product(inverse3(columns), xyz(white))
    return tuple(tuple(columns[i][j] * parts[j][0] for j in range(3)) for i in range(3))


def adaptation(source: tuple[float, float], target: tuple[float, float]) -> Matrix:
    """Bradford's change of white point, over XYZ."""
    a, b = product(CONES, xyz(source)), product(CONES, xyz(target))
    scaled = tuple(tuple(b[i][0] / a[i][0] * CONES[i][j] for j in range(3)) for i in range(3))
    return product(inverse3(CONES), scaled)


def between(source: tuple[tuple, tuple[float, float]], target: tuple[tuple, tuple[float, float]]) -> Matrix:
    """Linear RGB of one encoding to that of another: (primaries, white) each."""
    through = product(adaptation(source[1], target[1]), rgb_to_xyz(*source))
    return product(inverse3(rgb_to_xyz(*target)), through)


def _ratio(x: np.ndarray, above: tuple[float, ...], below: tuple[float, ...]) -> np.ndarray:
    """A quotient of polynomials, highest power first."""
    f = np.float32
    top, bottom = (np.full_like(x, f(c[0])) for c in (above, below))
    for c in above[1:]:
        top = top * x + f(c)
    for c in below[1:]:
        bottom = bottom * x + f(c)
    return top / bottom


def fast_log2(x: np.ndarray) -> np.ndarray:
    """Fixed coefficients, over mantissas from 2/3 to 4/3."""
    bits = np.asarray(x, np.float32).view(np.int32)
    exponent = (bits - np.int32(0x3F2AAAAB)) >> 23
    m = (bits - (exponent << 23)).view(np.float32) - np.float32(1)
    return _ratio(m, (7.4245873327820566e-01, 1.4287160470083755, -1.8503833400518310e-06), (1.7409343003366853e-01, 1.0096718572241148, 9.9032814277590719e-01)) + exponent.astype(np.float32)


def fast_pow2(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float32)
    whole = np.floor(x)
    return np.ldexp(_ratio(x - whole, (1.0, 1.01749063e01, 4.88687798e01, 9.85506591e01), (2.10242958e-01, -2.22328856e-02, -1.94414990e01, 9.85506633e01)), whole.astype(np.int32))


def fast_pow(x: np.ndarray, power: float) -> np.ndarray:
    return fast_pow2(fast_log2(x) * np.float32(power))


def fast_srgb(x: np.ndarray) -> np.ndarray:
    """The sRGB curve over linear light, odd about 0."""
    x = np.asarray(x, np.float32)
    size = np.abs(x)
    curve = _ratio(np.sqrt(size), (7.352629620e-01, 1.474205315, 3.903842876e-01, 5.287254571e-03, -5.135152395e-04), (2.424867759e-02, 9.258482155e-01, 1.340816930, 3.036675394e-01, 1.004519624e-02))
    return np.copysign(np.where(size > np.float32(0.0031308), curve, np.float32(12.92) * size), x)


def fast_709(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float32)
    return np.where(x <= np.float32(0.018), np.float32(4.5) * x, np.float32(1.099) * fast_pow(np.maximum(x, np.float32(1e-6)), 0.45) - np.float32(0.099))


def fast_cos(x: np.ndarray) -> np.ndarray:
    """By folding to a quarter turn, a polynomial of a quarter of the angle, and doubling it twice."""
    x = np.asarray(x, np.float32)
    turn = np.float32(2 * np.pi)
    x = x - np.floor(x / turn) * turn
    x = np.minimum(x, turn - x)
    far = x >= turn / 4
    q = np.where(far, turn / 2 - x, x) * np.float32(0.25)
    q2 = q * q
    c = q2 * q2 * np.float32(0.06960438) + (q2 * np.float32(-0.84087373) + np.float32(1.68179268))
    c = c * c - np.float32(1.414213562)
    c = c * c - np.float32(1)
    return np.where(far, -c, c)


#: Coefficients of the approximation of erf, highest power first.
ERF = (7.77394369e-02, 2.05260015e-04, 2.32120216e-01, 2.77820801e-01, 1.0)


def erf_sql(x: str) -> str:
    """erf as SQL text: 1 - 1 / p(|x|)^4 with the sign of x."""
    p = f"cast({ERF[0]!r} as double)"
    for c in ERF[1:]:
        p = f"({p} * abs({x}) + cast({c!r} as double))"
    return f"(case when {x} <= 0 then -1 else 1 end) * (1 - 1 / ({p} * {p} * {p} * {p}))"


def fast_erf(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float32)
    p = np.full_like(x, np.float32(ERF[0]))
    for c in ERF[1:]:
        p = p * np.abs(x) + np.float32(c)
    return np.copysign(1 - 1 / (p * p * p * p), x)


def dithered(v: str, table: str) -> str:
    """A sample from 0 to 1 to 8 bits with an offset from a table, halves to even; as SQL text."""
    return f"least(greatest({v} * 255 + {table}, cast(0 as double)), cast(255 as double))"


def coefficient_context(left: str, k: str, covered: int, before: str, div, shr) -> str:
    """The context of a coefficient's size: from how many that aren't zero are left, its place, and whether the one before is zero."""
    log = covered.bit_length() - 1
    nz, at = shr(f"{left} + {covered - 1}", str(log)), shr(k, str(log))
    steps = ((1, 0), (2, 31), (4, 62), (8, 93), (12, 123), (20, 152), (32, 180))
    count = "case " + " ".join(f"when {nz} <= {n} then {c}" for n, c in steps) + " else 206 end"
    place = f"case when {at} < 16 then {at} - 1 when {at} < 32 then 15 + {div(f'{at} - 16', '2')} else 23 + {div(f'{at} - 32', '4')} end"
    return f"(({count}) + ({place})) * 2 + {before}"


class Noise:
    """Eight generators side by side, seeded by four numbers; the random planes of a frame come from them tile by tile."""

    def __init__(self, a: int, b: int, c: int, d: int):
        mask = (1 << 64) - 1

        def mixed(z: int) -> int:
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
            z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
            return z ^ z >> 31

        lanes = []
        for seed in ((a << 32) + b, (c << 32) + d):
            z = mixed(seed + 0x9E3779B97F4A7C15 & mask)
            lane = [z]
            for _ in range(7):
                lane.append(mixed(lane[-1]))
            lanes.append(np.array(lane, np.uint64))
        self.one, self.two = lanes

    def batch(self) -> np.ndarray:
        """Sixteen 32-bit numbers."""
        s1, s0 = self.one, self.two
        out = s1 + s0
        self.one = s0
        s1 = s1 ^ (s1 << np.uint64(23))
        self.two = s1 ^ s0 ^ (s1 >> np.uint64(18)) ^ (s0 >> np.uint64(5))
        return out.astype("<u8").view("<u4")

    def tile(self, height: int, width: int) -> np.ndarray:
        """Numbers from 1 to 2, row by row. A row starts a batch of its own, also where it has no samples."""
        batches = (width - 1) // 16 + 1 if width else 1
        rows = []
        for _ in range(height):
            bits = np.concatenate([self.batch() for _ in range(batches)])[:width]
            rows.append(((bits >> 9) | np.uint32(0x3F800000)).astype(np.uint32).view(np.float32))
        return np.stack(rows) if rows else np.zeros((0, width), np.float32)
