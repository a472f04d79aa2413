"""Ids of the word-level BPE vocabulary, by the tokenizers library, with a cache of pieces.

The vocabulary's normaliser and splitter never let a token lie across ASCII white space, so the ids of a text
are those of its runs put together. Runs of printable characters below U+0240 are composed already and have a lower
case of their own, so the splitting pattern is applied to all of them at once, as changes of class between neighbouring
bytes, and the ids of a piece come from the library's BPE model; the library does all of any other run, and of runs
that hold the text of a special token, which has its one id as in the library. Equal pieces and runs of many texts are
found by their bytes, and each is encoded once in a worker.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from .common import text_of

VOCABULARY = "word_bpe_49k.json"
#: The splitting pattern of the vocabulary file is 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+. Here it is read as
#: classes of characters; OTHER are those of runs that are left to the library.
BLANK, LETTER, NUMBER, SIGN, OTHER = range(5)
#: What a sign ' that stands alone takes with it from the letters behind it.
SHORTENED = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: The first byte of U+0240 and all above.
SIMPLE_LEAD = 0xC9
#: Runs and pieces kept by a worker; beyond KEPT the cache goes back to its first CORE entries.
KEPT, CORE = 600_000, 200_000
#: Characters of the texts that are encoded at once, about; a text is never cut.
AT_ONCE = 1 << 21


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def classes() -> tuple[np.ndarray, np.ndarray]:
    """The class and the lower case of each code point below U+0240; OTHER where the latter has another length in UTF-8."""
    kind, lower = np.full(0x240, OTHER, np.uint8), np.arange(0x240, dtype=np.uint16)
    for k in range(0x240):
        c = chr(k)
        if k < 128 and c.encode().isspace():
            kind[k] = BLANK
        elif c.isprintable() and len(c.lower()) == 1 and len(c.lower().encode()) == len(c.encode()) and ord(c.lower()) < 0x240:
            lower[k] = ord(c.lower())
            kind[k] = LETTER if regex.match(r"\p{L}", c.lower()) else NUMBER if regex.match(r"\p{N}", c.lower()) else SIGN
    return kind, lower


class WordEncoder:
    """Encodes whole texts, many at once. Ids don't depend on what is cached."""

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        #: Texts of the vocabulary's own special tokens, which the library finds before anything else. They hold no white space.
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.kind, self.lower = classes()
        self.byte_kind = np.concatenate([self.kind[:128], np.full(128, OTHER, np.uint8)])
        self.byte_lower = np.concatenate([self.lower[:128], np.arange(128, 256)]).astype(np.uint8)
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(1 << 18, np.int64)

    def _new(self, raw: bytes, whole: bool) -> list[int]:
        if whole:
            return self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids
        letters = raw.decode() if raw.isascii() else raw.decode("latin-1").translate(self.letters)
        return [x.id for x in self.tokenizer.model.tokenize(letters)]

    def _learn(self, fresh: list[tuple[bytes, bool]]) -> None:
        found = [self._new(*x) for x in fresh]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        k = len(self.known)
        self.known.update(zip([raw for raw, _ in fresh], range(k, k + len(fresh)), strict=True))
        start, total = int(self.starts[k]), int(sizes.sum())
        while k + len(fresh) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while start + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.starts[k + 1 : k + len(fresh) + 1] = start + np.cumsum(sizes)
        self.ids[start : start + total] = [x for ids in found for x in ids]

    def _cut(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces begin in the text, the bytes of all pieces, where each begins among these (and the end), and whether it is a run
        that is left to the library. Such a run is one piece of its own bytes; it holds a byte or a mixture that no other piece has."""
        raw = np.frombuffer(text, np.uint8)
        kind, low = self.byte_kind[raw], self.byte_lower[raw]
        lead = np.flatnonzero((raw >= 0xC2) & (raw < SIMPLE_LEAD))
        code = ((raw[lead].astype(np.int64) & 0x1F) << 6) | (raw[lead + 1] & 0x3F)
        kind[lead] = kind[lead + 1] = self.kind[code]
        low[lead], low[lead + 1] = 0xC0 | (self.lower[code] >> 6), 0x80 | (self.lower[code] & 0x3F)
        for token in self.special:
            at = text.find(token)
            while at >= 0:
                kind[at] = OTHER
                at = text.find(token, at + 1)
        begins = np.ones(len(raw), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        begins[lead + 1] = False
        # A sign ' alone, with letters behind it, takes some of them.
        sign = np.flatnonzero((raw[:-1] == 0x27) & begins[:-1] & (kind[1:] == LETTER))
        for ending in SHORTENED:
            at = sign[sign + len(ending) < len(raw)]
            for k, c in enumerate(ending, 1):
                at = at[low[at + k] == c]
            begins[at + 1], begins[(at + len(ending) + 1)[at + len(ending) + 1 < len(raw)]] = False, True
        inside = kind != BLANK
        runs = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
        ends = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]])) + 1
        whole = np.zeros(len(raw), bool)
        if (odd := np.flatnonzero(kind == OTHER)).size:
            for k in np.unique(np.searchsorted(runs, odd, side="right") - 1):
                part = slice(runs[k], ends[k])
                low[part], begins[part], whole[runs[k]] = raw[part], False, True
                begins[runs[k]] = True
        first = np.flatnonzero(begins & inside)
        offsets = np.append(np.cumsum(inside)[first] - 1, inside.sum())
        return first, low[inside], offsets, whole[first]

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        joined = b"\n".join(texts) + b"\n"  # a blank at the end, so that no character is the last
        first, data, offsets, whole = self._cut(joined)
        if len(self.known) > KEPT:
            self.known = dict(islice(self.known.items(), CORE))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        which, different = pieces.indices.to_numpy(zero_copy_only=False), pieces.dictionary.to_pylist()
        rows = list(map(self.known.get, different))
        if fresh := [k for k, row in enumerate(rows) if row is None]:
            left = np.zeros(len(different), bool)
            left[which[whole]] = True
            for k, row in zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True):
                rows[k] = row
            self._learn([(different[k], left[k]) for k in fresh])
        at = np.array(rows, np.int64)[which]
        begin = self.starts[at]
        sizes = self.starts[at + 1] - begin
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.repeat(begin - ends[:-1], sizes) + np.arange(ends[-1])]
        cuts = ends[np.searchsorted(first, np.cumsum([0, *(len(x) + 1 for x in texts)]))]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_many(self, texts) -> list[np.ndarray]:
        out, part, size = [], [], 0
        for text in texts:
            part.append(text_of(text).encode("utf-8", "replace"))
            size += len(part[-1])
            if size > AT_ONCE:
                out += self._encode(part)
                part, size = [], 0
        return out + (self._encode(part) if part else [])

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> WordEncoder:
    return WordEncoder(vocabulary)
