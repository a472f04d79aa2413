"""Sequential codes of the bitstream: bits, variable integers, half floats, prefix codes, rANS, LZ77, move to front.

These carry state from symbol to symbol, so they run in Python, one section or plane per call; operators.codec
runs many of them at once.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np


class BitWriter:
    """Least significant bit first. Whole bytes are set aside, so writing is linear in the length."""

    def __init__(self):
        self.done, self.rest, self.n_rest = bytearray(), 0, 0

    def write(self, value: int, bits: int) -> None:
        if value >> bits:
            raise ValueError(f"{value} doesn't fit {bits} bits")
        self.rest |= value << self.n_rest
        self.n_rest += bits
        if self.n_rest >= 64:
            whole = self.n_rest >> 3
            self.done += (self.rest & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.rest >>= 8 * whole
            self.n_rest &= 7

    @property
    def size(self) -> int:
        return 8 * len(self.done) + self.n_rest

    def align(self) -> None:
        self.write(0, -self.n_rest % 8)

    def bytes(self) -> bytes:
        return bytes(self.done) + self.rest.to_bytes((self.n_rest + 7) // 8, "little")


class BitReader:
    """Reads past the end give zeros and set `overread`."""

    def __init__(self, data: bytes):
        self.data, self.size, self.at, self.overread = bytes(data), 8 * len(data), 0, False

    def read(self, bits: int) -> int:
        got = self.peek(bits)
        self.at += bits
        self.overread |= self.at > self.size
        return got

    def peek(self, bits: int) -> int:
        first = self.at >> 3
        window = int.from_bytes(self.data[first : first + (bits >> 3) + 2], "little")
        return window >> (self.at & 7) & ((1 << bits) - 1)

    def skip(self, bits: int) -> None:
        """Ahead by any number of bits, but no further than the end."""
        self.overread |= self.at + bits > self.size
        self.at = min(self.at + bits, self.size)

    def align(self) -> None:
        self.read(-self.at % 8)


#: A choice of a four-way field: an offset and how many bits follow.
Choice = tuple[int, int]


def write_u32(w: BitWriter, value: int, choices: tuple[Choice, Choice, Choice, Choice]) -> None:
    """Two bits for the first choice that holds the value, then the rest of it."""
    for k, (offset, bits) in enumerate(choices):
        if 0 <= value - offset < 1 << bits:
            w.write(k, 2)
            w.write(value - offset, bits)
            return
    raise ValueError(f"no choice holds {value}")


def read_u32(r: BitReader, choices: tuple[Choice, Choice, Choice, Choice]) -> int:
    offset, bits = choices[r.read(2)]
    return offset + r.read(bits)


def write_u64(w: BitWriter, value: int) -> None:
    """0, 4 bits from 1, 8 bits from 17, or 12 bits and then groups of 8, the last (from bit 60) of 4."""
    if value == 0:
        w.write(0, 2)
    elif value <= 16:
        w.write(1, 2)
        w.write(value - 1, 4)
    elif value <= 272:
        w.write(2, 2)
        w.write(value - 17, 8)
    else:
        w.write(3, 2)
        w.write(value & 4095, 12)
        value, shift = value >> 12, 12
        while value and shift < 60:
            w.write(1, 1)
            w.write(value & 255, 8)
            value, shift = value >> 8, shift + 8
        if value:
            w.write(1, 1)
            w.write(value & 15, 4)
        else:
            w.write(0, 1)


def read_u64(r: BitReader) -> int:
    kind = r.read(2)
    if kind < 3:
        return (0, lambda: 1 + r.read(4), lambda: 17 + r.read(8))[kind]() if kind else 0
    value, shift = r.read(12), 12
    while r.read(1):
        if shift == 60:
            return value | r.read(4) << 60
        value |= r.read(8) << shift
        shift += 8
    return value


def half_to_float(bits: int) -> float:
    return float(np.uint16(bits).view(np.float16))


def float_to_half(x: float) -> int:
    return int(np.float16(x).view(np.uint16))


def limited_lengths(histogram: list[int], most: int = 15) -> list[int]:
    """Code lengths of at most `most` bits with the least total, by package merge. One symbol alone has length 1."""
    used = [k for k, n in enumerate(histogram) if n > 0]
    lengths = [0] * len(histogram)
    if len(used) == 1:
        lengths[used[0]] = 1
    if len(used) < 2:
        return lengths
    if len(used) > 1 << most:
        raise ValueError("too many symbols for the length limit")
    coins = sorted((histogram[k], (k,)) for k in used)
    row = coins
    for _ in range(most - 1):
        pairs = [(row[k][0] + row[k + 1][0], row[k][1] + row[k + 1][1]) for k in range(0, len(row) - 1, 2)]
        row = list(heapq.merge(coins, pairs, key=lambda c: c[0]))
    for _, symbols in row[: 2 * len(used) - 2]:
        for k in symbols:
            lengths[k] += 1
    return lengths


def prefix_codes(lengths: list[int]) -> list[int]:
    """Canonical codes, most significant bit first."""
    codes, code, before = [0] * len(lengths), 0, 0
    for size, symbol in sorted((n, k) for k, n in enumerate(lengths) if n):
        code <<= size - before
        codes[symbol] = code
        code, before = code + 1, size
    return codes


def prefix_encode(symbols: list[int], lengths: list[int]) -> bytes:
    codes, w = prefix_codes(lengths), BitWriter()
    for s in symbols:
        for bit in range(lengths[s] - 1, -1, -1):
            w.write(codes[s] >> bit & 1, 1)
    return w.bytes()


def prefix_decode(data: bytes, n: int, lengths: list[int]) -> list[int]:
    book = {(size, code): k for k, (size, code) in enumerate(zip(lengths, prefix_codes(lengths), strict=True)) if size}
    r, out = BitReader(data), []
    for _ in range(n):
        size = code = 0
        while (size, code) not in book:
            code, size = code << 1 | r.read(1), size + 1
            if size > 64:
                raise ValueError("no such code")
        out.append(book[size, code])
    return out


RANS_BITS, RANS_LOW = 12, 1 << 16


def rans_encode(symbols: list[int], counts: list[int]) -> bytes:
    """Counts sum to 2^RANS_BITS. The state goes first, then 16-bit words in reading order."""
    starts = np.concatenate([[0], np.cumsum(counts)]).tolist()
    state, words = RANS_LOW, []
    for s in reversed(symbols):
        n = counts[s]
        if state >= (RANS_LOW >> RANS_BITS << 16) * n:
            words.append(state & 0xFFFF)
            state >>= 16
        state = (state // n << RANS_BITS) + state % n + starts[s]
    return struct.pack("<I", state) + b"".join(struct.pack("<H", w) for w in reversed(words))


def rans_decode(data: bytes, n: int, counts: list[int]) -> list[int]:
    starts = np.concatenate([[0], np.cumsum(counts)]).tolist()
    symbol = [k for k, c in enumerate(counts) for _ in range(c)]
    (state,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(n):
        slot = state & ((1 << RANS_BITS) - 1)
        s = symbol[slot]
        out.append(s)
        state = counts[s] * (state >> RANS_BITS) + slot - starts[s]
        if state < RANS_LOW:
            if at + 2 > len(data):
                raise ValueError("truncated")
            state = state << 16 | struct.unpack_from("<H", data, at)[0]
            at += 2
    if state != RANS_LOW:
        raise ValueError("the final state doesn't check")
    return out


def normalised(histogram: list[int], total: int = 1 << RANS_BITS) -> list[int]:
    """Counts that sum to `total`, each symbol that occurs at least 1; the largest take up the rounding."""
    whole = sum(histogram)
    counts = [max(1, int(n * total / whole + 0.5)) if n else 0 for n in histogram]
    rest = total - sum(counts)
    for k in sorted(range(len(counts)), key=lambda k: (-histogram[k], k)):
        step = max(rest, 1 - counts[k]) if counts[k] else 0
        counts[k] += step
        rest -= step
        if not rest:
            return counts
    raise ValueError("more symbols than counts")


def lz77(values: list[int], least: int = 4, window: int = 1 << 20, chain: int = 32) -> list[tuple[int, int]]:
    """Greedy matches: (-1, value) for a literal, (length, distance) for a copy."""
    heads: dict[tuple, list[int]] = {}
    out, at = [], 0

    def add(k: int) -> None:
        if k + least <= len(values):
            heads.setdefault(tuple(values[k : k + least]), []).append(k)

    while at < len(values):
        best, far = 0, 0
        for k in reversed(heads.get(tuple(values[at : at + least]), [])[-chain:]):
            if at - k > window:
                break
            n = 0
            while at + n < len(values) and values[k + n] == values[at + n]:
                n += 1
            if n > best:
                best, far = n, at - k
        if best >= least:
            out.append((best, far))
            for k in range(at, at + best):
                add(k)
            at += best
        else:
            out.append((-1, values[at]))
            add(at)
            at += 1
    return out


def lz77_expand(tokens: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for n, x in tokens:
        if n < 0:
            out.append(x)
        else:
            for _ in range(n):
                out.append(out[-x])
    return out


def move_to_front(values: list[int], size: int = 256) -> list[int]:
    order, out = list(range(size)), []
    for v in values:
        k = order.index(v)
        out.append(k)
        order.insert(0, order.pop(k))
    return out


def move_from_front(ranks: list[int], size: int = 256) -> list[int]:
    order, out = list(range(size)), []
    for k in ranks:
        out.append(order[k])
        order.insert(0, order.pop(k))
    return out


def lehmer_decode(code: list[int]) -> list[int]:
    """A permutation from the rank of each element among those left."""
    free = list(range(len(code)))
    return [free.pop(k) for k in code]
