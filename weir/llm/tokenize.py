"""Encoding of a corpus with a public tokenizer, as columns of a DataFrame."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.bpe import Vocabulary, read_ranks

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
_READY: dict[str, Vocabulary] = {}


def rank_file(path: str | None = None) -> str:
    """The path of a rank file: `path`, or the default vocabulary of the installed public tokenizers."""
    if path:
        return path
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, DEFAULT_RANKS)


def _vocabulary(path: str, data: bytes) -> Vocabulary:
    """One vocabulary for each Python worker, with what it remembers from earlier batches and tasks."""
    if path not in _READY:
        _READY[path] = Vocabulary(read_ranks(data))
    return _READY[path]


def _run(df: DataFrame, text: str, out: str, kind: T.DataType, per_batch, ranks: str | None) -> DataFrame:
    path = rank_file(ranks)
    with open(path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # under 1 MB, whatever the corpus
    keep = [c for c in df.columns if c not in (text, out)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path, shared.value)
        for batch in batches:
            packed = [vocabulary.pack(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), per_batch(packed)], names=[*keep, out])

    schema = df.select(*[F.col(f"`{c}`") for c in keep]).schema.add(out, kind)
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(f"__{len(keep)}_text")).mapInArrow(encode, schema)


def _lists(packed: list[bytes]) -> pa.Array:
    values = pa.array(np.frombuffer(b"".join(packed), np.int32))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, packed)]) // 4, pa.int32()), values)


def _lengths(packed: list[bytes]) -> pa.Array:
    return pa.array([len(p) // 4 for p in packed], pa.int32())


def with_ids(df: DataFrame, text: str = "text", out: str = "ids", ranks: str | None = None) -> DataFrame:
    """df with the text column replaced by the list of its token ids, without special tokens; a column called `out` is replaced.

    A narrow step: nothing is shuffled, and each row costs its own text. An empty or null text gives an empty list, never
    null. Whole texts are encoded, however long; what a worker remembers of earlier words is bounded and changes no result.
    Other columns pass through, whatever their names; repeated rows stay repeated.
    """
    return _run(df, text, out, T.ArrayType(T.IntegerType()), _lists, ranks)


def with_token_count(df: DataFrame, text: str = "text", out: str = "n_tokens", ranks: str | None = None) -> DataFrame:
    """df with the text column replaced by the number of its tokens, 0 for an empty or null text."""
    return _run(df, text, out, T.IntegerType(), _lengths, ranks)


def documents_with_ids(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return with_ids(documents.select("doc_id", "text"))
