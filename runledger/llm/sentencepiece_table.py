"""SentencePiece encoding by a table of distinct chunks.

When no piece of a model holds a whitespace marker after another character, no merge crosses the point
before a marker run. A text then falls into chunks, each a run of markers and the characters up to the next
run, that are segmented on their own. Each task keeps a table of the distinct chunks it has met, has the
library segment each new one once, and joins the ids back by position with array indexing.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty string; a
text of any length is encoded whole; equal rows give equal rows; other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Distinct chunks a task keeps before it starts its table anew.
TABLE_LIMIT = 200_000
MARK = "▁"
_SPACED = re.compile(" +[^ ]*")


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def pieces_stay_within_marks(sp: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether every piece has its markers in front only, which the chunk table needs."""
    return not any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without the one marker that the library puts before any input."""
    text = text.replace(MARK, " ")
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return [c[1:] for c in _SPACED.findall(" " + text)]
    return text.split(" ") if text else []


class ChunkTable:
    """Distinct chunk -> its ids, held as one flat array with a start and a length for each chunk."""

    def __init__(self, model: bytes, limit: int = TABLE_LIMIT) -> None:
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        if not pieces_stay_within_marks(self.sp):
            raise ValueError("pieces of this model cross whitespace markers")
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, new: list[str]) -> None:
        """Segments chunks that the table lacks; the empty chunk is a marker alone."""
        marker = [self.sp.piece_to_id(MARK)]
        ids = [i if c else marker for c, i in zip(new, self.sp.encode(new, num_threads=1), strict=True)]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, np.fromiter((x for i in ids for x in i), np.int32, int(length.sum()))])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.at) > self.limit:
            self.clear()
        cut = [chunks(t) for t in texts]
        self.add(list({c for cs in cut for c in cs} - self.at.keys())) if texts else None
        out = []
        for cs in cut:
            row = np.fromiter(map(self.at.__getitem__, cs), np.int64, len(cs))
            n = self.length[row]
            ends = np.cumsum(n)
            out.append(self.flat[np.repeat(self.start[row] - (ends - n), n) + np.arange(ends[-1] if len(cs) else 0)])
        return out


def encode(text: Column, model: bytes) -> Column:
    """Column of ids, as the library's encode() gives without begin or end ids."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    @shared.lean
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = ChunkTable(model)
        for texts in batches:
            yield pd.Series(known.encode(texts.tolist()), dtype=object)

    return ids(F.coalesce(text, F.lit("")))


def decode(ids: Column, model: bytes) -> Column:
    """Column of texts, by the library's own decode() of each row's ids."""

    @F.pandas_udf(T.StringType())
    @shared.lean
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        for rows in batches:
            yield pd.Series([sp.decode(r.tolist()) for r in rows], dtype=object)

    return text(ids)


def round_trip(text: Column, model: bytes) -> Column:
    """Struct of ids and decoded, as encode() and decode() give them, by one Python worker a task: decode(encode()) takes two where
    the ids are kept as well."""

    @F.pandas_udf("ids array<int>, decoded string")
    @shared.lean
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = ChunkTable(model)
        for texts in batches:
            ids = known.encode(texts.tolist())
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([known.sp.decode(r.tolist()) for r in ids], dtype=object)})

    return both(F.coalesce(text, F.lit("")))


def encode_documents(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of ids."""
    shared.small_batches(docs.sparkSession)
    return docs.withColumn(ids, encode(docs[text], model))


def round_trip_documents(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """doc_id, ids and decoded, the text that the ids decode to."""
    shared.small_batches(docs.sparkSession)
    return docs.select("doc_id", round_trip(docs[text], model).alias("r")).select("doc_id", "r.*")


def digests(encoded: DataFrame, model: bytes | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to; without a model, encoded has that as decoded."""
    out = encoded.withColumn("decoded", decode(F.col("ids"), model)) if model else encoded
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str, model_path: str) -> DataFrame:
    model = read_model(model_path)
    return digests(round_trip_documents(shared.table(spark, sf_dir, "documents"), model))
