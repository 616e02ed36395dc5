"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

The rank file and the split pattern are parameters; nothing is downloaded and nothing is trained.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

RANK_FILE = "byte_bpe_50k.tiktoken"
PIECE_CHARS = 65_536

#: A place where every match of the split pattern ends: a letter, digit or sign before a blank or line end.
#: No alternative of the pattern runs from a non-space into a space, and its look-ahead sees only what follows.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}\p{S}])(?=[ \n])")


@lru_cache(maxsize=4)
def encoder(rank_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file, built once per Python worker."""
    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Parts of a text of about ``size`` characters, cut at safe places only.

    A run without a safe place stays whole.
    """
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, enc: tiktoken.Encoding, size: int = PIECE_CHARS) -> list[int]:
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [token for piece in pieces(text, size) for token in enc.encode_ordinary(piece)]


def _names(rank_path: str | None, pattern: str | None) -> tuple[str, str]:
    return rank_path or public_tokenizers.path(RANK_FILE), pattern or public_tokenizers.PATTERN


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id_col`` and ``ids array<int>`` of every whole text.

    A null text counts as empty and gives an empty list; null ids and repeated rows pass through row by row;
    an empty table gives an empty result; other columns, whatever their names, are not looked at.
    """
    rank_path, pattern = _names(rank_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_path, pattern)
        for batch in batches:
            ids = [encode(text or "", enc) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    source = docs.select(id_col, text_col)
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", rank_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id_col`` and ``bytes binary`` of every list of ids; raw bytes, which need not be valid UTF-8.

    A null list decodes to no bytes; an id outside the vocabulary is an error.
    """
    rank_path, pattern = _names(rank_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_path, pattern)
        for batch in batches:
            out = [enc.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    source = encoded.select(id_col, ids_col)
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row: n_tokens, SHA-256 of the decimal ids joined by a blank, SHA-256 of the bytes decoded from the ids.

    Encodes and decodes in one pass over the rows, so that the ids of a corpus are never held or shuffled.
    Nulls, empty texts and repeated rows as in :func:`bpe_encode`.
    """
    rank_path, pattern = _names(rank_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_path, pattern)
        decimal = [str(i) for i in range(enc.n_vocab)]
        for batch in batches:
            counts, ids_hex, bytes_hex = [], [], []
            for text in batch.column(1):
                ids = encode(text.as_py() or "", enc)
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                bytes_hex.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(bytes_hex, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(id_col, F.col(text_col))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
