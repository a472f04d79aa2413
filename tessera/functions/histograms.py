"""Entropy codes of the codestream: their headers, and streams of numbers under them.

A code has a histogram for each cluster of contexts, ANS counts or prefix code lengths, with a hybrid configuration
that splits numbers into tokens and raw bits, and optionally copies (LZ77). Headers are read and written here;
NumberReader and write_numbers carry numbers, each under a context.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from . import entropy
from .entropy import BitReader, BitWriter

TOTAL_BITS = 12
TOTAL = 1 << TOTAL_BITS
FINAL_STATE = 0x13 << 16
#: Prefix code (length, bits from the lowest) of the logarithms of counts 0 to 12, and of 13, a repetition.
LOG_LENGTHS = (5, 4, 4, 4, 4, 4, 3, 3, 3, 3, 3, 6, 7, 7)
LOG_CODES = (17, 11, 15, 3, 9, 7, 4, 2, 5, 6, 0, 33, 1, 65)
#: The order in which lengths of code length codes are sent, and their own code (length, bits from the lowest).
LENGTH_ORDER = (1, 2, 3, 4, 0, 5, 17, 6, 16, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_LENGTHS = (2, 4, 3, 2, 2, 4)
LENGTH_CODES = (0, 7, 3, 2, 1, 15)
COPY_START = ((224, 0), (512, 0), (4096, 0), (8, 15))
COPY_LEAST = ((3, 0), (4, 0), (5, 2), (9, 8))


@dataclass(frozen=True)
class Hybrid:
    """Numbers below 2^split are tokens; others have their exponent, `msb` bits after the leading one and `lsb` lowest bits in the token."""

    split: int = 4
    msb: int = 2
    lsb: int = 0

    def encode(self, value: int) -> tuple[int, int, int]:
        """Token, how many raw bits, and the bits."""
        if value < 1 << self.split:
            return value, 0, 0
        n = value.bit_length() - 1
        kept = self.msb + self.lsb
        raw = n - kept
        high = value >> (n - self.msb) & ((1 << self.msb) - 1)
        token = (1 << self.split) + ((n - self.split) << kept) + (high << self.lsb) + (value & ((1 << self.lsb) - 1))
        return token, raw, value >> self.lsb & ((1 << raw) - 1)

    def decode(self, token: int, reader: BitReader) -> int:
        if token < 1 << self.split:
            return token
        kept = self.msb + self.lsb
        over = token - (1 << self.split)
        raw = self.split - kept + (over >> kept)
        high = 1 << self.msb | over >> self.lsb & ((1 << self.msb) - 1)
        return (high << raw | reader.read(min(raw, 32))) << self.lsb | over & ((1 << self.lsb) - 1)


def _width(n: int) -> int:
    """Bits for one of n + 1 numbers."""
    return n.bit_length()


def write_hybrid(w: BitWriter, h: Hybrid, log_alphabet: int) -> None:
    w.write(h.split, _width(log_alphabet))
    if h.split != log_alphabet:
        w.write(h.msb, _width(h.split))
        w.write(h.lsb, _width(h.split - h.msb))


def read_hybrid(r: BitReader, log_alphabet: int) -> Hybrid:
    split = r.read(_width(log_alphabet))
    if split == log_alphabet:
        return Hybrid(split, 0, 0)
    msb = r.read(_width(split))
    lsb = r.read(_width(split - msb)) if msb <= split else split + 1
    if split > log_alphabet or msb + lsb > split:
        raise ValueError("a hybrid configuration that keeps more bits than there are")
    return Hybrid(split, msb, lsb)


def special_distances() -> list[tuple[int, int]]:
    """(dx, dy) of the 120 short distances: the half plane before a sample, by distance, then by |dx|, right before left."""
    near = [(dx, dy) for dy in range(8) for dx in range(-7, 9) if dy or dx > 0]
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


SPECIAL = special_distances()


def copy_distance(value: int, width: int) -> int:
    """How far back a copy starts. width: samples in a row, 0 where there are none."""
    if not width:
        return value + 1
    if value >= len(SPECIAL):
        return value - len(SPECIAL) + 1
    dx, dy = SPECIAL[value]
    return max(1, dx + dy * width)


def flat_counts(n: int, total: int = TOTAL) -> list[int]:
    return [total // n + (k < total % n) for k in range(n)]


@dataclass
class Alias:
    """Slots of equal size; below its cutoff a slot belongs to its own symbol, above to another."""

    log_slot: int
    cutoff: list[int]
    other: list[int]
    shift: list[int]
    counts: list[int]

    @classmethod
    def of(cls, counts: list[int], log_alphabet: int) -> Alias:
        size = 1 << log_alphabet
        slot = TOTAL >> log_alphabet
        counts = (counts + [0] * size)[:size]
        if not any(counts):
            counts[0] = TOTAL
        if TOTAL in counts:
            only = counts.index(TOTAL)
            return cls(TOTAL_BITS - log_alphabet, [0] * size, [only] * size, [slot * k for k in range(size)], counts)
        cutoff, other, shift = list(counts), list(range(size)), [0] * size
        short = [k for k, c in enumerate(counts) if c < slot]
        long = [k for k, c in enumerate(counts) if c > slot]
        while long:
            giver, taker = long[-1], short.pop()
            cutoff[giver] -= slot - cutoff[taker]
            other[taker], shift[taker] = giver, cutoff[giver]
            if cutoff[giver] <= slot:
                long.pop()
                if cutoff[giver] < slot:
                    short.append(giver)
        for k in range(size):
            if cutoff[k] == slot:
                other[k], shift[k], cutoff[k] = k, 0, 0
            else:
                shift[k] -= cutoff[k]
        return cls(TOTAL_BITS - log_alphabet, cutoff, other, shift, counts)

    def lookup(self, value: int) -> tuple[int, int]:
        """Symbol, and place of the value among those of the symbol."""
        k, at = value >> self.log_slot, value & ((1 << self.log_slot) - 1)
        return (self.other[k], self.shift[k] + at) if at >= self.cutoff[k] else (k, at)

    def places(self) -> list[list[int]]:
        """For each symbol the values that it has, in order of their places."""
        out = [[0] * c for c in self.counts]
        for value in range(TOTAL):
            symbol, place = self.lookup(value)
            out[symbol][place] = value
        return out


def _write_u8(w: BitWriter, value: int) -> None:
    w.write(int(value > 0), 1)
    if value:
        n = value.bit_length() - 1
        w.write(n, 3)
        w.write(value - (1 << n), n)


def _read_u8(r: BitReader) -> int:
    if not r.read(1):
        return 0
    n = r.read(3)
    return (1 << n) + r.read(n)


def _kept_bits(log: int, shift: int) -> int:
    """How many bits after the leading one a count with that logarithm keeps."""
    return min(max(0, shift - ((TOTAL_BITS - log) >> 1)), log)


def coded_counts(histogram: list[int], shift: int = 13) -> list[int]:
    """Counts that sum to TOTAL and that the header can hold."""
    return entropy.normalised(histogram) if sum(histogram) else [TOTAL]


def write_counts(w: BitWriter, counts: list[int]) -> None:
    used = [k for k, c in enumerate(counts) if c]
    if len(used) <= 2:
        w.write(1, 1)
        w.write(len(used) - 1, 1)
        for k in used:
            _write_u8(w, k)
        if len(used) == 2:
            w.write(counts[used[0]], TOTAL_BITS)
        return
    counts = counts[: used[-1] + 1]
    w.write(0, 1)
    if counts == flat_counts(len(counts)):
        w.write(1, 1)
        _write_u8(w, len(counts) - 1)
        return
    w.write(0, 1)
    shift = 13  # all bits of every count
    w.write(0b111, 3)
    w.write(shift + 1 - 8, 3)
    _write_u8(w, len(counts) - 3)
    logs = [c.bit_length() for c in counts]
    omitted = logs.index(max(logs))  # its count is what the others leave
    for log in logs:
        w.write(LOG_CODES[log], LOG_LENGTHS[log])
    for k, (c, log) in enumerate(zip(counts, logs, strict=True)):
        if log > 1 and k != omitted:
            n = _kept_bits(log - 1, shift)
            w.write(c - (1 << log - 1) >> (log - 1 - n), n)


_LOGS = {(n, code): k for k, (n, code) in enumerate(zip(LOG_LENGTHS, LOG_CODES, strict=True))}


def read_counts(r: BitReader) -> list[int]:
    if r.read(1):
        n = r.read(1) + 1
        symbols = [_read_u8(r) for _ in range(n)]
        counts = [0] * (max(symbols) + 1)
        if n == 2:
            if symbols[0] == symbols[1]:
                raise ValueError("one symbol twice")
            counts[symbols[0]] = r.read(TOTAL_BITS)
            counts[symbols[1]] = TOTAL - counts[symbols[0]]
        else:
            counts[symbols[0]] = TOTAL
        return counts
    if r.read(1):
        return flat_counts(_read_u8(r) + 1)
    n = 0
    while n < 3 and r.read(1):
        n += 1
    shift = r.read(n) + (1 << n) - 1
    if shift > 13:
        raise ValueError("no such precision")
    size = _read_u8(r) + 3
    logs: list[int] = []
    same = {}
    while len(logs) < size:
        n, code = 0, 0
        while (n, code) not in _LOGS:
            code |= r.read(1) << n
            n += 1
        log = _LOGS[n, code]
        if log == 13:
            times = _read_u8(r) + 4
            same.update(dict.fromkeys(range(len(logs), len(logs) + times)))
            logs += [0] * times
        else:
            logs.append(log)
    if len(logs) > size:
        raise ValueError("a repetition beyond the alphabet")
    free = [k for k in range(size) if k not in same]
    if not free or r.overread:
        raise ValueError("no counts")
    omitted = max(free, key=lambda k: (logs[k], -k))
    if omitted + 1 in same:
        raise ValueError("the omitted count is repeated")
    counts = [0] * size
    before, total = 0, 0
    for k in range(size):
        if k in same:
            counts[k] = before
        elif k != omitted and logs[k]:
            n = _kept_bits(logs[k] - 1, shift)
            counts[k] = (1 << logs[k] - 1) + (r.read(n) << (logs[k] - 1 - n))
        total += counts[k]
        before = counts[k]
    counts[omitted] = TOTAL - total
    if counts[omitted] <= 0:
        raise ValueError("counts beyond their total")
    return counts


# -- prefix codes ----------------------------------------------------------------------------------------------


def reversed_bits(code: int, n: int) -> int:
    return int(f"{code:0{n}b}"[::-1], 2) if n else 0


@dataclass
class Prefix:
    """A canonical prefix code, read from the lowest bit by a table of its longest code."""

    lengths: list[int]
    codes: list[int] = field(default_factory=list)
    longest: int = 0
    table: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self):
        self.codes = [reversed_bits(c, n) for c, n in zip(entropy.prefix_codes(self.lengths), self.lengths, strict=True)]
        used = [k for k, n in enumerate(self.lengths) if n]
        if len(used) <= 1:  # a lone symbol takes no bits
            self.table = [(used[0] if used else 0, 0)]
            return
        self.longest = max(self.lengths)
        if sum(1 << self.longest - n for n in self.lengths if n) != 1 << self.longest:
            raise ValueError("not a complete prefix code")
        self.table = [(0, 0)] * (1 << self.longest)
        for k in used:
            n = self.lengths[k]
            for rest in range(1 << self.longest - n):
                self.table[rest << n | self.codes[k]] = (k, n)

    def read(self, r: BitReader) -> int:
        symbol, n = self.table[r.peek(self.longest)]
        r.read(n)
        return symbol

    def write(self, w: BitWriter, symbol: int) -> None:
        if self.longest:
            w.write(self.codes[symbol], self.lengths[symbol])


def write_prefix(w: BitWriter, lengths: list[int]) -> None:
    """The lengths of an alphabet of two symbols or more."""
    used = [k for k, n in enumerate(lengths) if n]
    wide = (len(lengths) - 1).bit_length()
    if len(used) <= 4:
        w.write(1, 2)
        used = sorted(used or [0], key=lambda k: (lengths[k], k))
        w.write(len(used) - 1, 2)
        for k in used:
            w.write(k, wide)
        if len(used) == 4:
            w.write(int(lengths[used[0]] == 1), 1)
        return
    runs, last, k = [], 8, 0
    while k <= used[-1]:
        n, times = lengths[k], 1
        while k + times <= used[-1] and lengths[k + times] == n:
            times += 1
        k += times
        if n and n != last:
            runs.append((n, 0, 0))
            last, times = n, times - 1
        while times >= 3:
            part = min(times, 10 if not n else 6)
            runs.append((17, part - 3, 3) if not n else (16, part - 3, 2))
            times -= part
            if times >= 3:  # a second repetition in a row would multiply the first
                runs.append((n, 0, 0))
                times -= 1
        runs += [(n, 0, 0)] * times
    hist = [0] * 18
    for symbol, _, _ in runs:
        hist[symbol] += 1
    small = entropy.limited_lengths(hist, 5)
    w.write(0, 2)
    space = 32
    alone = sum(n > 0 for n in small) == 1
    for symbol in LENGTH_ORDER:
        n = small[symbol]
        if alone and n:
            n = 5  # a lone symbol: any length will do, none fills the space
        w.write(LENGTH_CODES[n], LENGTH_LENGTHS[n])
        space -= 32 >> n if n else 0
        if space <= 0:
            break
    code = Prefix(small)
    for symbol, extra, n in runs:
        code.write(w, symbol)
        w.write(extra, n)


_LENGTHS = {(n, code): k for k, (n, code) in enumerate(zip(LENGTH_LENGTHS, LENGTH_CODES, strict=True))}


def read_prefix(r: BitReader, size: int) -> Prefix:
    """The code of an alphabet of `size` symbols."""
    if size == 1:
        return Prefix([1])
    skip, wide = r.read(2), (size - 1).bit_length()
    lengths = [0] * size
    if skip == 1:
        n = r.read(2) + 1
        symbols = [r.read(wide) for _ in range(n)]
        if len(set(symbols)) < n or max(symbols) >= size:
            raise ValueError("symbols of a simple code")
        shapes = {1: (1,), 2: (1, 1), 3: (1, 2, 2), 4: (2, 2, 2, 2)}
        shape = (1, 2, 3, 3) if n == 4 and r.read(1) else shapes[n]
        for k, n_bits in zip(symbols, shape, strict=True):
            lengths[k] = n_bits
        return Prefix(lengths)
    small, space, used = [0] * 18, 32, 0
    for symbol in LENGTH_ORDER[skip:]:
        n = code = 0
        while (n, code) not in _LENGTHS:
            code |= r.read(1) << n
            n += 1
        small[symbol] = _LENGTHS[n, code]
        if small[symbol]:
            used += 1
            space -= 32 >> small[symbol]
            if space <= 0:
                break
    if space < 0 or used != 1 and space:
        raise ValueError("lengths of code lengths don't fill their space")
    code_of = Prefix([min(n, 1) for n in small] if used == 1 else small)
    at, last, space, again = 0, 8, 1 << 15, (0, 0)
    while at < size and space > 0:
        symbol = code_of.read(r)
        if symbol < 16:
            lengths[at] = symbol
            at += 1
            if symbol:
                last = symbol
                space -= 1 << 15 >> symbol
            again = (0, 0)
            continue
        n = last if symbol == 16 else 0
        kind, times = again
        if kind != symbol:
            times = 0
        extra = 2 if symbol == 16 else 3
        total = ((times - 2) << extra if times else 0) + r.read(extra) + 3
        fresh = total - times
        if at + fresh > size or r.overread:
            raise ValueError("a repetition beyond the alphabet")
        lengths[at : at + fresh] = [n] * fresh
        at += fresh
        space -= fresh * (1 << 15 >> n) if n else 0
        again = (symbol, total)
    if space:
        raise ValueError("code lengths don't fill their space")
    return Prefix(lengths)


# -- whole codes -----------------------------------------------------------------------------------------------


@dataclass
class Copies:
    start: int
    least: int
    lengths: Hybrid


@dataclass
class Code:
    """contexts: the cluster of each context (the last is that of distances, with copies)."""

    contexts: list[int]
    hybrids: list[Hybrid]
    log_alphabet: int
    prefixes: list[Prefix] | None = None
    counts: list[list[int]] | None = None
    copies: Copies | None = None
    tables: list[Alias] = field(default_factory=list)

    def __post_init__(self):
        if self.counts is not None and not self.tables:
            self.tables = [Alias.of(c, self.log_alphabet) for c in self.counts]


def write_context_map(w: BitWriter, contexts: list[int]) -> None:
    if len(contexts) == 1:
        return
    most = max(contexts)
    if most < 8:
        wide = most.bit_length()
        w.write(1, 1)
        w.write(wide, 2)
        for c in contexts:
            w.write(c, wide)
        return
    w.write(0, 1)
    w.write(1, 1)
    ranks = entropy.move_to_front(contexts)
    write_numbers(w, [(0, v) for v in ranks], 1)


def read_context_map(r: BitReader, n: int) -> list[int]:
    """The clusters; every one up to the greatest must occur."""
    if n == 1:
        return [0]
    if r.read(1):
        wide = r.read(2)
        got = [r.read(wide) for _ in range(n)]
    else:
        moved = r.read(1)
        numbers = NumberReader(read_code(r, 1, copies=n > 2), r)
        got = [numbers.read(0) for _ in range(n)]
        numbers.check()
        if max(got) > 255:
            raise ValueError("more clusters than there may be")
        if moved:
            got = entropy.move_from_front(got)
    if set(got) != set(range(max(got) + 1)):
        raise ValueError("a cluster without contexts")
    return got


def write_code(w: BitWriter, code: Code, n_contexts: int) -> None:
    w.write(int(code.copies is not None), 1)
    if code.copies:
        entropy.write_u32(w, code.copies.start, COPY_START)
        entropy.write_u32(w, code.copies.least, COPY_LEAST)
        write_hybrid(w, code.copies.lengths, 8)
    write_context_map(w, code.contexts)
    w.write(int(code.prefixes is not None), 1)
    if code.prefixes is None:
        w.write(code.log_alphabet - 5, 2)
    for h in code.hybrids:
        write_hybrid(w, h, code.log_alphabet)
    if code.prefixes is None:
        for counts in code.counts:
            write_counts(w, counts)
        return
    sizes = [max([k + 1 for k, n in enumerate(p.lengths) if n] or [1]) for p in code.prefixes]
    for size in sizes:
        w.write(int(size > 1), 1)
        if size > 1:
            n = (size - 1).bit_length() - 1
            w.write(n, 4)
            w.write(size - 1 - (1 << n), n)
    for size, p in zip(sizes, code.prefixes, strict=True):
        if size > 1:
            write_prefix(w, p.lengths[:size])


def read_code(r: BitReader, n_contexts: int, copies: bool = True) -> Code:
    found = None
    if r.read(1):
        if not copies:
            raise ValueError("copies where there may be none")
        found = Copies(entropy.read_u32(r, COPY_START), entropy.read_u32(r, COPY_LEAST), read_hybrid(r, 8))
        n_contexts += 1
    contexts = read_context_map(r, n_contexts)
    clusters = max(contexts) + 1
    prefixed = r.read(1)
    log_alphabet = 15 if prefixed else 5 + r.read(2)
    hybrids = [read_hybrid(r, log_alphabet) for _ in range(clusters)]
    if not prefixed:
        counts = [read_counts(r) for _ in range(clusters)]
        if max(map(len, counts)) > 1 << log_alphabet:
            raise ValueError("a histogram beyond the alphabet")
        return Code(contexts, hybrids, log_alphabet, counts=counts, copies=found)
    sizes = []
    for _ in range(clusters):
        n = r.read(4) if r.read(1) else None
        sizes.append(1 if n is None else 1 + (1 << n) + r.read(n))
    if max(sizes) > 1 << 15:
        raise ValueError("an alphabet beyond what there may be")
    return Code(contexts, hybrids, log_alphabet, prefixes=[read_prefix(r, n) for n in sizes], copies=found)


class NumberReader:
    """Numbers under contexts from a stream whose code is known. width: for short copy distances."""

    def __init__(self, code: Code, reader: BitReader, width: int = 0):
        self.code, self.r, self.width = code, reader, width
        self.state = reader.read(32) if code.prefixes is None else FINAL_STATE
        self.seen: list[int] = []
        self.left = self.at = 0

    def _symbol(self, cluster: int) -> int:
        if self.code.prefixes is not None:
            return self.code.prefixes[cluster].read(self.r)
        table = self.code.tables[cluster]
        symbol, place = table.lookup(self.state & (TOTAL - 1))
        self.state = table.counts[symbol] * (self.state >> TOTAL_BITS) + place
        if self.state < 1 << 16:
            self.state = self.state << 16 | self.r.read(16)
        return symbol

    def read(self, context: int) -> int:
        copies = self.code.copies
        if copies is None:
            cluster = self.code.contexts[context]
            return self.code.hybrids[cluster].decode(self._symbol(cluster), self.r)
        if not self.left:
            cluster = self.code.contexts[context]
            token = self._symbol(cluster)
            if token < copies.start:
                self.seen.append(self.code.hybrids[cluster].decode(token, self.r))
                return self.seen[-1]
            self.left = copies.lengths.decode(token - copies.start, self.r) + copies.least
            cluster = self.code.contexts[-1]
            far = copy_distance(self.code.hybrids[cluster].decode(self._symbol(cluster), self.r), self.width)
            self.at = len(self.seen) - min(far, len(self.seen), 1 << 20)
        value = self.seen[self.at] if self.at < len(self.seen) else 0
        self.at, self.left = self.at + 1, self.left - 1
        self.seen.append(value)
        return value

    def check(self) -> None:
        """After the last number the state of an ANS stream is a fixed one."""
        if self.state != FINAL_STATE or self.r.overread:
            raise ValueError("the final state doesn't check")


def clustered(histograms: list[list[int]], most: int = 8) -> tuple[list[int], list[list[int]]]:
    """The cluster of each histogram, and the summed ones: greedily, the histogram that costs most with those there opens the next."""
    import math

    size = max(map(len, histograms), default=1)
    padded = [h + [0] * (size - len(h)) for h in histograms]
    bits = lambda h: sum(h) * math.log2(sum(h)) - sum(c * math.log2(c) for c in h if c) if any(h) else 0.0
    extra = lambda a, b: bits([x + y for x, y in zip(a, b, strict=True)]) - bits(a) - bits(b)
    used = [k for k, h in enumerate(padded) if any(h)]
    if not used:
        return [0] * len(padded), [padded[0] if padded else [0]]
    seeds = [max(used, key=lambda k: sum(padded[k]))]
    far = {k: extra(padded[k], padded[seeds[0]]) for k in used}
    while len(seeds) < min(most, len(used)):
        k = max(far, key=far.get)
        if far[k] < 64:  # less than what another histogram costs
            break
        seeds.append(k)
        far = {j: min(d, extra(padded[j], padded[k])) for j, d in far.items()}
    of = [min(range(len(seeds)), key=lambda s, k=k: extra(padded[k], padded[seeds[s]])) if k in far else 0 for k in range(len(padded))]
    kept = sorted(set(of))
    of = [kept.index(c) for c in of]
    return of, [[sum(padded[k][t] for k in range(len(padded)) if of[k] == c) for t in range(size)] for c in range(len(kept))]


def best_hybrid(values: list[int], tried: tuple[Hybrid, ...] = (Hybrid(4, 2, 0), Hybrid(4, 1, 0), Hybrid(5, 1, 1), Hybrid(0, 0, 0), Hybrid(7, 0, 0))) -> Hybrid:
    """The configuration with the fewest bits of tokens and raw bits."""
    import math
    from collections import Counter

    def cost(h: Hybrid) -> float:
        coded = [h.encode(v) for v in values]
        n = Counter(t for t, _, _ in coded)
        return sum(b for _, b, _ in coded) - sum(c * math.log2(c / len(coded)) for c in n.values())

    return min(tried, key=cost) if values else tried[0]


def build_code(numbers: list[tuple[int, int]], n_contexts: int, prefix: bool = False, hybrid: Hybrid | None = None, most: int = 8) -> Code:
    """A code for (context, value) pairs."""
    hybrid = hybrid or best_hybrid([v for _, v in numbers])
    tokens = [(c, hybrid.encode(v)[0]) for c, v in numbers]
    size = max([t for _, t in tokens], default=0) + 1
    histograms = [[0] * size for _ in range(n_contexts)]
    for c, t in tokens:
        histograms[c][t] += 1
    contexts, merged = clustered(histograms, most)
    if prefix or size > 256:
        return Code(contexts, [hybrid] * len(merged), 15, prefixes=[Prefix(entropy.limited_lengths(h, 15)) for h in merged])
    log_alphabet = max(5, hybrid.split, (size - 1).bit_length())
    return Code(contexts, [hybrid] * len(merged), log_alphabet, counts=[coded_counts(h) for h in merged])


def write_numbers(w: BitWriter, numbers: list[tuple[int, int]], n_contexts: int, prefix: bool = False, code: Code | None = None) -> Code:
    """The header of a code for (context, value) pairs, then the pairs."""
    code = code or build_code(numbers, n_contexts, prefix)
    write_code(w, code, n_contexts)
    write_stream(w, numbers, code)
    return code


def write_stream(w: BitWriter, numbers: list[tuple[int, int]], code: Code) -> None:
    coded = []
    for context, value in numbers:
        cluster = code.contexts[context]
        coded.append((cluster, *code.hybrids[cluster].encode(value)))
    if code.prefixes is not None:
        for cluster, token, n, bits in coded:
            code.prefixes[cluster].write(w, token)
            w.write(bits, n)
        return
    # ANS goes backwards: the last number first, from the state that the reader must end with.
    places = [t.places() for t in code.tables]
    state, out = FINAL_STATE, []
    for cluster, token, n, bits in reversed(coded):
        count = code.tables[cluster].counts[token]
        refill = None
        if state >= (count << 20):
            refill, state = state & 0xFFFF, state >> 16
        state = (state // count << TOTAL_BITS) + places[cluster][token][state % count]
        out.append((refill, n, bits))
    w.write(state, 32)
    for refill, n, bits in reversed(out):
        if refill is not None:
            w.write(refill, 16)
        w.write(bits, n)
