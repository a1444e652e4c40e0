"""Encoding of texts with a public byte-level BPE vocabulary, through a sentencepiece model made from it.

The vocabulary (token bytes and ranks) is serialised as a sentencepiece BPE model without training: a piece is the token
with each byte mapped to one printable character, its score the negative rank, and the normaliser is the identity. Merging
the pair with the highest score is then merging the pair of lowest rank, which is byte-level BPE. Texts are split into
pre-tokens by the vocabulary's pattern first; the ids of the pre-tokens in order are the ids of the text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import ship

#: The pattern of the vocabulary's pre-tokens; a fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens whose ids a worker remembers; a full memory is emptied. It changes speed only.
REMEMBERED = 200_000


def byte_characters() -> list[str]:
    """One visible character per byte: printable Latin-1 bytes stand for themselves, the others for U+0100 and on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    chars = dict(zip(own, map(chr, own), strict=True)) | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of "base64 rank" lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & 0xFFFFFFFFFFFFFFFF)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; the id after the last is the unknown piece."""
    import struct

    chars, size = byte_characters(), len(ranks)
    if sorted(ranks.values()) != list(range(size)):
        raise ValueError("ranks must run from 0 without gaps")
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2))
    # TrainerSpec: BPE, vocabulary size, ids of unknown, begin, end, padding
    out += _field(2, _field(3, 2) + _field(4, size + 1) + _field(40, size) + _field(41, -1) + _field(42, -1) + _field(43, -1))
    # NormalizerSpec: identity, nothing added, removed or escaped
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Encoder:
    """Encodes and decodes texts; empty and null texts have no ids."""

    def __init__(self, path: str) -> None:
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.split = regex.compile(PATTERN)
        self.table = {b: c for b, c in enumerate(byte_characters())}
        self.known: dict[str, list[int]] = {}
        self.tokens: list[bytes] | None = None

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        known = self.known
        split = [self.split.findall(t) if t else [] for t in texts]
        new = list({w for words in split for w in words if w not in known})
        if new:
            # latin-1 turns each byte of the UTF-8 text into the character with its number, which translate() maps on
            mapped = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for w in new]
            ids = dict(zip(new, self.model.encode(mapped, num_threads=1), strict=True))
            if len(known) + len(ids) > REMEMBERED:
                known = self.known = {w: known[w] for words in split for w in words if w in known}
            known.update(ids)
        return [[i for w in words for i in known[w]] for words in split]

    def decode(self, ids: list[int]) -> str:
        if self.tokens is None:
            self.tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(path)


def encode_column(df: DataFrame, text: str, path: str, ids: str = "ids") -> DataFrame:
    """df with a column `ids` (array of int): the text's token ids, without special tokens, trimming or normalising.

    Whole texts are encoded, whatever their length; strings that look like special tokens are ordinary text. A null or
    empty text gives an empty list, a blank one the ids of its blanks. An empty table stays empty. path: the vocabulary
    file, at the same place on every executor.
    """
    ship(df.sparkSession)

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for b in batches:
            yield pd.Series(e.encode_batch([t if isinstance(t, str) else None for t in b]), index=b.index)

    return df.withColumn(ids, F.pandas_udf(encode, "array<int>")(F.col(text)))
