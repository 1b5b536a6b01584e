"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The model is serialised straight from the vocabulary: each token is the string of its bytes' stand-in
characters, scored by its negative rank, with identity normalisation. Sentencepiece then merges the
best-scored neighbours first, which are those of lowest rank.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import append_columns, values
from tidemark.llm.tokens import PieceEncoder, byte_chars


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank; ranks must go from 0 on without a gap."""
    with open(path, "rb") as f:
        pairs = sorted(((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip())), key=lambda p: p[0])
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks aren't 0 to {len(pairs) - 1}")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: integers as varints, floats as 32 bits, bytes with their length."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_proto(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece i is token i; an unknown piece comes last."""
    chars = byte_chars()
    pieces = [_field(1, "".join(map(chars.__getitem__, t)).encode()) + _field(2, float(-rank)) + _field(3, 1) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces))
    normalizer = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


def rank_encoder(path: str, pattern: str) -> PieceEncoder:
    """Encodes as a rank tokenizer would: each match of pattern by itself; one that is a token is that token."""
    import regex
    import sentencepiece

    tokens = read_ranks(path)
    rank_of = {t: i for i, t in enumerate(tokens)}
    encode = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens)).EncodeAsIds
    mapped, split = str.maketrans(dict(enumerate(byte_chars()))), regex.compile(pattern).findall

    def merge(stretch: str) -> list[int]:
        raw = stretch.encode()
        rank = rank_of.get(raw)
        return [rank] if rank is not None else encode(raw.decode("latin-1").translate(mapped))

    return PieceEncoder(f"rank {path}", lambda text: [i for x in split(text) for i in merge(x)], split, merge)


def bpe_encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with the token ids (array of int) of each whole text; null and empty texts have none.

    All other columns stay as they are, repeated rows and empty tables too; a column named ids_col is replaced.
    """

    def start():
        encoder = rank_encoder(path, pattern)

        def ids(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [encoder.ids(t) if t else b"" for t in values(batch, text_col)]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))]

        return ids

    return append_columns(df, {ids_col: "array<int>"}, start)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the bytes (binary) that each list of ids stands for, by inverse mapping; null lists give no bytes.

    An id outside the vocabulary, negative ones and nulls too, fails the job, as it has no bytes. A column named out_col is replaced.
    """

    def start():
        token = dict(enumerate(read_ranks(path))).__getitem__
        return lambda batch: [pa.array([b"".join(map(token, x or ())) for x in values(batch, ids_col)], pa.binary())]

    return append_columns(df, {out_col: "binary"}, start)
