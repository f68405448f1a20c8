"""Encoding texts with a public byte-level BPE vocabulary, and its exact reversal.

The vocabulary file is a parameter, read once on the driver and sent to the workers. Token ids come from the tokenizers
library over Arrow batches; offsets come from the bytes of the ids, so they hold where a token ends inside a character.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.runtime import spread

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
_LOADED: dict[str, Any] = {}


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where Latin-1 prints it, else from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The bytes of every id of a byte-level BPE file; special tokens stand for their own text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        table = byte_characters()
        self.bytes: dict[int, bytes] = {i: bytes(table[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in table for c in t)}
        for special in spec.get("added_tokens", []):
            self.bytes[special["id"]] = special["content"].encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that are no whole character become U+FFFD."""
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")

    def offsets(self, ids: list[int]) -> list[tuple[int, int]]:
        """Half-open character offsets of each token; a token that holds part of a character spans the whole of it."""
        if not ids:
            return []
        parts = [self.bytes[i] for i in ids]
        data = np.frombuffer(b"".join(parts), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        return list(zip(character[starts].tolist(), (character[ends - 1] + 1).tolist(), strict=True))


def _tokenizer(name: str, text: str):
    """The parsed tokenizer, kept for the life of a worker process."""
    if name not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(text)
        own.encode_special_tokens = True
        _LOADED[name] = own
    return _LOADED[name]


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32()))


def _groups(texts: list[str], characters: int = 1 << 19) -> Iterator[list[str]]:
    """Runs of texts of about ``characters`` together: what is encoded at once, as encodings take far more memory than text."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= characters:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoded(df: DataFrame, id_col: str, text_col: str, path: str = BYTE_BPE, counts_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ids): the token ids of each whole text without special tokens; with ``counts_only`` (id, n) instead.

    Null and empty texts give an empty list (0). Strings of special tokens inside a text are ordinary text. Rows keep
    their number: repeated or null ids stay. Columns named in ``keep`` pass through, others are not read; an empty table
    gives an empty result.
    """
    with open(path, encoding="utf-8") as f:
        text = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(path, text.value)
        encode = getattr(own, "encode_batch_fast", own.encode_batch)
        for batch in batches:
            low = 0
            for some in _groups([t or "" for t in batch.column(1).to_pylist()]):
                got = encode(some, add_special_tokens=False)
                out = pa.array([len(e) for e in got], pa.int32()) if counts_only else _lists([np.array(e.ids, np.int32) for e in got])
                rest = [batch.column(2 + i).slice(low, len(some)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(some)), out, *rest], names=names)
                low += len(some)

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *keep)
    schema = T.StructType([rows.schema["id"], T.StructField("n", T.IntegerType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType())), *(df.schema[c] for c in keep)])
    names = schema.names
    return spread(rows).mapInArrow(run, schema)


def decoded(df: DataFrame, id_col: str, ids_col: str, path: str = BYTE_BPE) -> DataFrame:
    """(id, text, starts, ends): the text of each list of ids and the character offsets of every token.

    The inverse of ``encoded`` for any text; lists cut inside a character end with U+FFFD. A null list gives null.
    """
    with open(path, encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"bytes:{path}"
        if key not in _LOADED:
            _LOADED[key] = Vocabulary(source.value)
        own = _LOADED[key]
        for batch in batches:
            lists = batch.column(1).to_pylist()
            spans = [own.offsets(x or []) for x in lists]
            ends = [_lists([np.array([p[k] for p in s], np.int32) for s in spans]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else own.decode(x) for x in lists], pa.string()), *ends], names=["id", "text", "starts", "ends"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "id bigint, text string, starts array<int>, ends array<int>")
