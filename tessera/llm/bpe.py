"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut before encoding where no match of the splitting pattern can lie across the cut, so that the
ids are those of the whole text. A cut lies before a lone space between letters, and around a run of white space
longer than RUN: there the pattern's match is known (the run but for its last character, or all of it at the end
of the text), and the library's merges are applied to it directly, since its pattern engine overflows its stack
on very long runs. Both hold for public_tokenizers.PATTERN; with any other pattern texts go to the library whole.

Null and empty texts have no ids and decode to nothing. Texts of any length are taken whole. Repeated rows, ties and
extra columns don't matter, since every row is encoded by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_only, text_of

RANKS = "byte_bpe_50k.tiktoken"
PART, RUN = 1 << 16, 1 << 12
#: The characters that Unicode calls white space, as the pattern's \\s does.
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """Built once in each worker; rank_file is a name in public_tokenizers or a path that every worker can open."""
    path = rank_file if "/" in rank_file else public_tokenizers.path(rank_file)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of about `size` characters.

    A cut lies before a single space between two letters. Letters never match together with a space after
    them, and a lone space before a letter begins the match of that letter, so a match ends at the cut
    whatever stands around. Where no such place is found, the part runs on to the next one, or to the end.
    """
    start, n = 0, len(text)
    while n - start > size:
        at = text.find(" ", start + size)
        while 0 <= at < n - 1 and not (text[at - 1].isalpha() and text[at + 1].isalpha()):
            at = text.find(" ", at + 1)
        if not 0 <= at < n - 1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def long_parts(text: str) -> Iterator[tuple[str, bool]]:
    """The text in order, as parts to be split by the pattern (False) and matches of it that are known already (True)."""
    start = 0
    for run in SPACES.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield from ((part, False) for part in safe_parts(text[start : run.start()]))
        yield text[run.start() : end], True
        start = end
    yield from ((part, False) for part in safe_parts(text[start:]))


def encode(text: str | None, rank_file: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> list[int]:
    enc = encoding(rank_file, pattern)
    text = text_of(text)
    if len(text) <= RUN or pattern != public_tokenizers.PATTERN:
        return enc.encode_ordinary(text)
    return [i for part, known in long_parts(text) for i in (enc._encode_single_piece(part) if known else enc.encode_ordinary(part))]


def decode(ids, rank_file: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> bytes:
    """The bytes of the ids; they need not be UTF-8 when a sequence was cut inside a character."""
    return encoding(rank_file, pattern).decode_bytes(list(ids))


def encoder(rank_file: str = RANKS, pattern: str = public_tokenizers.PATTERN):
    """A column function: text to array<int>."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: np.array(encode(x, rank_file, pattern), np.int32), na_action=None)

    return ids


def decoder(rank_file: str = RANKS, pattern: str = public_tokenizers.PATTERN):
    """A column function: array<int> to binary. Null ids decode to nothing."""

    @F.pandas_udf("binary")
    def raw(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: b"" if x is None else decode([int(i) for i in x], rank_file, pattern), na_action=None)

    return raw


def round_trips(docs: DataFrame, rank_file: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian unsigned 32-bit) and of the bytes decoded from them."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            ids = encode(text, rank_file, pattern)
            raw = decode(ids, rank_file, pattern)
            rows.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return documents_only(docs).select("doc_id", digests("text").alias("d")).select("doc_id", "d.*")
