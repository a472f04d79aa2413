"""Baseline JPEG files without pixels: markers, tables, quantised coefficients, and the same file written again.

A scan is decoded to its coefficients and coded from them with the file's own tables, so a file whose padding is the
usual one (ones before a marker) comes out byte for byte.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from . import entropy

SOI, EOI, SOS, DQT, DHT, DRI, COM = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xFE
BASELINE, EXTENDED = 0xC0, 0xC1


def zigzag() -> list[int]:
    """Place in an 8 x 8 block of each coefficient as sent: along anti-diagonals, turning at each."""
    spots = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else p[0]))
    return [8 * y + x for y, x in spots]


ZIGZAG = zigzag()


@dataclass
class Component:
    id: int
    across: int
    down: int
    quant: int
    dc: int = 0
    ac: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))  # (rows, columns, 64) in natural order


@dataclass
class Table:
    """A Huffman table: how many codes of each length 1 to 16, and their symbols in order."""

    counts: list[int]
    symbols: list[int]

    def codes(self) -> dict[int, tuple[int, int]]:
        """(code, length) of each symbol."""
        out, code, at = {}, 0, 0
        for n, many in enumerate(self.counts, 1):
            for _ in range(many):
                out[self.symbols[at]] = (code, n)
                code, at = code + 1, at + 1
            code <<= 1
        return out


@dataclass
class Jpeg:
    height: int = 0
    width: int = 0
    segments: list[tuple[int, bytes]] = field(default_factory=list)  # all markers in order, with their payload
    components: list[Component] = field(default_factory=list)
    quant: dict[int, list[int]] = field(default_factory=dict)
    tables: dict[tuple[int, int], Table] = field(default_factory=dict)
    restart: int = 0
    tail: bytes = b""


def kind_of(marker: int, payload: bytes) -> str:
    """What an application segment holds."""
    if not 0xE0 <= marker <= 0xEF:
        return "comment" if marker == COM else "other"
    names = ((0xE0, b"JFIF\0", "jfif"), (0xE1, b"Exif\0\0", "exif"), (0xE1, b"http://ns.adobe.com/xap/1.0/\0", "xmp"), (0xE2, b"ICC_PROFILE\0", "icc"), (0xEE, b"Adobe", "adobe"))
    return next((name for m, start, name in names if m == marker and payload.startswith(start)), "other")


def _sizes(j: Jpeg) -> tuple[int, int]:
    """MCUs across and down; fills the shapes of the components' blocks."""
    most_across, most_down = max(c.across for c in j.components), max(c.down for c in j.components)
    mcus = -(-j.width // (8 * most_across)), -(-j.height // (8 * most_down))
    if len(j.components) == 1:
        j.components[0].across = j.components[0].down = 1
        mcus = -(-j.width // 8), -(-j.height // 8)
    return mcus


def parse(data: bytes) -> Jpeg:
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    j, at = Jpeg(), 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise ValueError("a segment ends early")
        j.segments.append((marker, body))
        at += 2 + size
        if marker in (BASELINE, EXTENDED):
            depth, j.height, j.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not j.height or not j.width or len(body) != 6 + 3 * n:
                raise ValueError("only files of 8 bits are read")
            j.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC0 <= marker <= 0xCF and marker not in (DHT, 0xC8, 0xCC):
            raise ValueError("only sequential Huffman files are read")
        elif marker == DQT:
            k = 0
            while k < len(body):
                wide, no = body[k] >> 4, body[k] & 15
                n = 128 if wide else 64
                found = np.frombuffer(body[k + 1 : k + 1 + n], ">u2" if wide else "u1").astype(int).tolist()
                j.quant[no] = found
                k += 1 + n
        elif marker == DHT:
            k = 0
            while k < len(body):
                counts = list(body[k + 1 : k + 17])
                n = sum(counts)
                j.tables[body[k] >> 4, body[k] & 15] = Table(counts, list(body[k + 17 : k + 17 + n]))
                k += 17 + n
        elif marker == DRI:
            (j.restart,) = struct.unpack(">H", body)
        elif marker == SOS:
            if not j.components or body[0] != len(j.components):
                raise ValueError("only one scan of all components is read")
            for k in range(body[0]):
                c = next(c for c in j.components if c.id == body[1 + 2 * k])
                c.dc, c.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
            end = _scan(j, data, at)
            j.tail = data[end:]
            return j


def _entropy_parts(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The scan's bytes between restarts, without stuffing, and where the next marker is."""
    parts, part = [], bytearray()
    while at < len(data):
        if data[at] != 0xFF:
            part.append(data[at])
            at += 1
        elif at + 1 < len(data) and data[at + 1] == 0:
            part.append(0xFF)
            at += 2
        elif at + 1 < len(data) and 0xD0 <= data[at + 1] <= 0xD7:
            parts.append(bytes(part))
            part = bytearray()
            at += 2
        else:
            return [*parts, bytes(part)], at
    raise ValueError("the scan has no end")


def _extended(bits: int, n: int) -> int:
    return bits if n == 0 or bits >> (n - 1) else bits - (1 << n) + 1


def _walk(j: Jpeg):
    """Every block of the scan in order: (whether a restart is before it, component, row, column)."""
    across, down = _sizes(j)
    for c in j.components:
        if c.blocks.shape[:2] != (down * c.down, across * c.across):
            c.blocks = np.zeros((down * c.down, across * c.across, 64), np.int32)
    for mcu in range(across * down):
        fresh = bool(j.restart) and mcu > 0 and mcu % j.restart == 0
        for c in j.components:
            for y in range(c.down):
                for x in range(c.across):
                    yield fresh, c, mcu // across * c.down + y, mcu % across * c.across + x
                    fresh = False


def _scan(j: Jpeg, data: bytes, at: int) -> int:
    parts, end = _entropy_parts(data, at)
    books = {key: {(n, code): s for s, (code, n) in t.codes().items()} for key, t in j.tables.items()}
    streams = iter(parts)
    bits, place = "", 0
    raw = next(streams)
    bits = "".join(f"{b:08b}" for b in raw)
    before = dict.fromkeys((c.id for c in j.components), 0)

    def symbol(book) -> int:
        nonlocal place
        code = 0
        for n in range(1, 17):
            if place >= len(bits):
                raise ValueError("the scan ends early")
            code = code << 1 | (bits[place] == "1")
            place += 1
            if (n, code) in book:
                return book[n, code]
        raise ValueError("no such code")

    def number(n: int) -> int:
        nonlocal place
        got = bits[place : place + n]
        place += n
        return _extended(int(got, 2), n) if n else 0

    for fresh, c, y, x in _walk(j):
        if fresh:
            bits, place = "".join(f"{b:08b}" for b in next(streams)), 0
            before = dict.fromkeys(before, 0)
        before[c.id] += number(symbol(books[0, c.dc]))
        block = c.blocks[y, x]
        block[0] = before[c.id]
        k = 1
        while k < 64:
            s = symbol(books[1, c.ac])
            run, n = s >> 4, s & 15
            if not n:
                if run != 15:
                    break
                k += 16
                continue
            k += run
            if k > 63:
                raise ValueError("a coefficient beyond its block")
            block[ZIGZAG[k]] = number(n)
            k += 1
    return end


def write(j: Jpeg) -> bytes:
    """The file: its segments as they were, the scan coded from the coefficients, and what came after."""
    out = bytearray(b"\xff\xd8")
    for marker, body in j.segments:
        out += struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    codes = {key: t.codes() for key, t in j.tables.items()}
    bits: list[str] = []
    before = dict.fromkeys((c.id for c in j.components), 0)
    restarts = 0

    def flush() -> None:
        text = "".join(bits)
        text += "1" * (-len(text) % 8)
        raw = int(text, 2).to_bytes(len(text) // 8, "big") if text else b""
        out.extend(raw.replace(b"\xff", b"\xff\0"))
        bits.clear()

    def put(key, symbol: int, value: int = 0, n: int = 0) -> None:
        code, size = codes[key][symbol]
        bits.append(f"{code:0{size}b}")
        if n:
            bits.append(f"{value if value > 0 else value + (1 << n) - 1:0{n}b}")

    for fresh, c, y, x in _walk(j):
        if fresh:
            flush()
            out += bytes((0xFF, 0xD0 + restarts % 8))
            restarts += 1
            before = dict.fromkeys(before, 0)
        block = c.blocks[y, x]
        step = int(block[0]) - before[c.id]
        before[c.id] = int(block[0])
        n = abs(step).bit_length()
        put((0, c.dc), n, step, n)
        run = 0
        last = max((k for k in range(1, 64) if block[ZIGZAG[k]]), default=0)
        for k in range(1, last + 1):
            v = int(block[ZIGZAG[k]])
            if not v:
                run += 1
                continue
            while run > 15:
                put((1, c.ac), 0xF0)
                run -= 16
            n = abs(v).bit_length()
            put((1, c.ac), run << 4 | n, v, n)
            run = 0
        if last < 63:
            put((1, c.ac), 0)
    flush()
    return bytes(out) + j.tail


def table_for(symbols: dict[int, int]) -> Table:
    """A table for symbols with their counts; no code is all ones, as the format asks."""
    order = sorted(symbols)
    lengths = entropy.limited_lengths([symbols[s] for s in order] + [0 if not order else 1], 15)  # the last stands for the code of ones
    longest = max(lengths)
    lengths[-1] = longest if lengths[-1] else 0
    counts, made = [0] * 16, []
    for n in range(1, 17):
        same = [s for s, size in zip(order, lengths, strict=False) if size == n]
        counts[n - 1] = len(same)
        made += same
    return Table(counts, made)


def build(width: int, height: int, components: list[Component], quant: dict[int, list[int]], restart: int = 0) -> Jpeg:
    """A file of given coefficients, with tables that fit them."""
    j = Jpeg(height, width, components=components, quant=quant, restart=restart)
    seen: dict[tuple[int, int], dict[int, int]] = {(0, 0): {}, (1, 0): {0: 1, 0xF0: 1}}
    before = dict.fromkeys((c.id for c in components), 0)
    for fresh, c, y, x in _walk(j):
        if fresh:
            before = dict.fromkeys(before, 0)
        step = int(c.blocks[y, x, 0]) - before[c.id]
        before[c.id] = int(c.blocks[y, x, 0])
        n = abs(step).bit_length()
        seen[0, 0][n] = seen[0, 0].get(n, 0) + 1
        run = 0
        for k in range(1, 64):
            v = int(c.blocks[y, x, ZIGZAG[k]])
            if v:
                s = (run & 15) << 4 | abs(v).bit_length()
                seen[1, 0][s] = seen[1, 0].get(s, 0) + 1
                run = 0
            else:
                run += 1
    j.tables = {key: table_for(found) for key, found in seen.items()}
    body = b"".join(bytes([no]) + bytes(q) for no, q in quant.items())
    j.segments.append((0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"))
    j.segments.append((DQT, body))
    j.segments.append((BASELINE, struct.pack(">BHHB", 8, height, width, len(components)) + b"".join(bytes((c.id, c.across << 4 | c.down, c.quant)) for c in components)))
    for (kind, no), t in j.tables.items():
        j.segments.append((DHT, bytes([kind << 4 | no, *t.counts, *t.symbols])))
    if restart:
        j.segments.append((DRI, struct.pack(">H", restart)))
    j.segments.append((SOS, bytes([len(components)]) + b"".join(bytes((c.id, 0)) for c in components) + b"\0\x3f\0"))
    j.tail = b"\xff\xd9"
    return j
