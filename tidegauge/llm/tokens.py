"""Texts to token ids of a public byte-level tokenizer, and back to bytes.

The rank file is read from a local folder (a parameter; every executor has it)
once per Python worker.  Texts longer than ``CHUNK`` characters are split where
the tokenizer's own pattern always splits: after an ASCII letter that no letter
follows, and after an ASCII digit that no digit follows (the next character
being ASCII).  The ids of the parts are then those of the whole.  Text moves in
Arrow batches, and ids go out as one flat buffer.

Cases: null and empty texts give an empty list; blank texts have the ids of
their blanks; strings of special tokens are ordinary text; a null key is kept;
repeated rows are encoded each; further columns are ignored.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
CHUNK = 50_000

# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SAFE = re.compile(r"(?<=[A-Za-z])(?=[\x00-@\[-`{-\x7f])|(?<=[0-9])(?=[\x00-/:-\x7f])")


@lru_cache(maxsize=4)
def encoding(name: str = NAME, folder: str = TOKENIZERS):
    import tiktoken

    ranks = {}
    for line in (Path(folder) / f"{name}.tiktoken").read_bytes().splitlines():
        if line:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, chunk: int = CHUNK) -> Iterator[str]:
    """The text in parts of about ``chunk`` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > chunk:
        cut = _SAFE.search(text, at + chunk)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(text: str | None, encode, chunk: int = CHUNK) -> list[int]:
    if not text:
        return []
    if len(text) <= chunk:
        return encode(text)
    return [i for part in parts(text, chunk) for i in encode(part)]


def decode_bytes(ids: list[int], name: str = NAME, folder: str = TOKENIZERS) -> bytes:
    """The exact bytes of the ids; they need not be valid UTF-8 on their own."""
    return encoding(name, folder).decode_bytes(list(ids))


def _encoder(name: str, folder: str, lengths_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(name, folder).encode_ordinary
        for batch in batches:
            sizes = np.empty(batch.num_rows, np.int64)
            flat = array("i")
            texts = batch["text"]
            for i in range(batch.num_rows):
                ids = encode_text(texts[i].as_py(), encode)
                sizes[i] = len(ids)
                if not lengths_only:
                    flat.extend(ids)
            keep = [c for c in batch.schema.names if c != "text"]
            if lengths_only:
                out, name_out = pa.array(sizes), "n_tokens"
            else:
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                out, name_out = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(flat, np.int32) if len(flat) else [], pa.int32())), "ids"
            yield pa.RecordBatch.from_arrays([batch[c] for c in keep] + [out], [*keep, name_out])

    return run


def _run(documents: DataFrame, keys: list[str], name: str, folder: str, lengths_only: bool) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}
    result = "n_tokens bigint" if lengths_only else "ids array<int>"
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), result])
    return documents.select(*keys, F.col("text")).mapInArrow(_encoder(name, folder, lengths_only), schema)


def encode(documents: DataFrame, keys: list[str], name: str = NAME, folder: str = TOKENIZERS) -> DataFrame:
    """(keys, ids) of each document."""
    return _run(documents, keys, name, folder, False)


def count(documents: DataFrame, keys: list[str], name: str = NAME, folder: str = TOKENIZERS) -> DataFrame:
    """(keys, n_tokens) of each document; the ids stay in the Python worker."""
    return _run(documents, keys, name, folder, True)


def decode(encoded: DataFrame, keys: list[str], name: str = NAME, folder: str = TOKENIZERS) -> DataFrame:
    """(keys, bytes) from (keys, ids)."""
    kinds = {f.name: f.dataType.simpleString() for f in encoded.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for batch in batches:
            out = pa.array([enc.decode_bytes(x or []) for x in batch["ids"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), out], [*keys, "bytes"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "bytes binary"])
    return encoded.select(*keys, "ids").mapInArrow(run, schema)
