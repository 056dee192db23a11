"""Encoding of texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tapewell.session import spread

#: Where the vocabulary files lie; the path is a parameter of every function here.
DEFAULT_FOLDER = "/opt/tokenizers"

#: The pattern of the byte-level vocabularies that splits a text before the merges (fixed value).
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts longer than this are cut at safe places and encoded piece by piece.
LONG = 100_000


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tiktoken encoding of a rank file, loaded once per worker process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def common_words(folder: str) -> frozenset[str]:
    """Frequent words: those that a public vocabulary holds whole, after a space and in lower case."""
    out = set()
    with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as lines:
        for line in lines:
            token = base64.b64decode(line.split()[0])
            if token[:1] == b" " and token[1:].isalpha() and token[1:].islower() and len(token) > 3:
                out.add(token[1:].decode())
    return frozenset(out)


#: A letter or number before a sign that is neither one nor white space.
_EDGE = re.compile(r"[^\W_](?=[^\w\s])")


def pieces(text: str, size: int = LONG) -> Iterator[str]:
    """Cut a text at places where the split pattern always begins a new word.

    Such a place is before a single space between two characters that aren't white space: the word before
    ends there in any case, and the space opens the next one. Another is between a letter or number and a sign, which end one
    match and open the next, so texts without spaces are cut as well. Encoding the pieces gives the same ids as
    encoding the text. A stretch without such a place, one run of letters, is a single match and stays whole, however long it is.
    """
    start, n = 0, len(text)
    while n - start > size:
        at = start + size
        edge = _EDGE.search(text, at)
        end = edge.end() if edge else n
        while True:
            at = text.find(" ", at, end)
            if at < 0 or at + 1 >= n:
                at = end
                break
            if not text[at - 1].isspace() and not text[at + 1].isspace():
                break
            at += 1
        yield text[start:at]
        start = at
    if start < n:
        yield text[start:]


def encode(text: str | None, path: str) -> list[int]:
    """Token ids without special tokens; an empty list for an empty and for a null text."""
    if not text:
        return []
    enc = encoding(path)
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    return [i for part in pieces(text) for i in enc.encode_ordinary(part)]


def decode(ids, path: str) -> bytes:
    """The raw UTF-8 bytes of a list of ids. Cut anywhere, ids still decode to bytes, if not to text."""
    return encoding(path).decode_bytes(list(ids))


def encode_table(documents: DataFrame, key: str, text: str, folder: str = DEFAULT_FOLDER, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids): one row for every row of ``documents``; no shuffle, nothing is collected.

    A table too small to be split is spread over the cores. Null and empty texts have the empty list. Texts are encoded whole, whatever their length. Arrow batches
    pass through ``mapInArrow``; ids leave as one flat buffer with offsets instead of Python lists of rows.
    The key may be of any type, may be null or repeat, and may be named like a result column: the order of columns is
    fixed, key first. Files are read by the workers, so the folder must
    exist on them.
    """
    path = f"{folder}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            rows = [encode(t, path) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.fromiter((i for r in rows for i in r), np.int32, int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    shape = f"key {documents.schema[key].dataType.simpleString()}, ids array<int>"
    return spread(documents.select(key, text)).mapInArrow(run, shape).withColumnRenamed("key", key)


def count_table(documents: DataFrame, key: str, text: str, folder: str = DEFAULT_FOLDER, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(key, n_tokens): lengths only, so that ids never leave the worker."""
    path = f"{folder}/{vocabulary}.tiktoken"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lengths = [len(encode(t, path)) for t in frame.iloc[:, 1]]
            yield pd.DataFrame({"key": frame.iloc[:, 0], "n_tokens": pd.array(lengths, "int64")})

    shape = f"key {documents.schema[key].dataType.simpleString()}, n_tokens bigint"
    return spread(documents.select(key, text)).mapInPandas(run, shape).withColumnRenamed("key", key)


def decode_table(encoded: DataFrame, key: str, ids: str, folder: str = DEFAULT_FOLDER, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(key, bytes): the raw bytes of each list of ids; null ids give null."""
    path = f"{folder}/{vocabulary}.tiktoken"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": frame.iloc[:, 0], "bytes": [None if x is None else decode(x, path) for x in frame.iloc[:, 1]]})

    shape = f"key {encoded.schema[key].dataType.simpleString()}, bytes binary"
    return encoded.select(key, ids).mapInPandas(run, shape).withColumnRenamed("key", key)
