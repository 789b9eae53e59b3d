"""BPE encoding and decoding by speculate and verify (see ``vocab``).

Ids travel packed as little-endian unsigned 32-bit integers, four bytes a token. A null text is the
empty one and has no ids. Special strings inside a text become their special id, as the library does
by default; decoding gives them back. Repeated and tied rows are independent, empty tables stay
empty, other columns pass through, and a column that has the name of the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import table, text_of
from tracewell.llm.vocab import splitter

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Characters of text that are cut into words at once; bounds a worker's memory, not a text.
SLICE_CHARS = 1 << 20


def _encode_slice(cut, texts: list[str]) -> list[bytes]:
    merges = cut.merges
    docs = []
    for text in texts:
        if merges.special_pattern.search(text):
            docs.append([(s, p if s else cut.words(p)) for s, p in merges.pieces(text)])
        else:
            docs.append([(False, cut.words(text))])
    merges.learn({w for doc in docs for special, part in doc if not special for w in part})
    known = merges.known
    return [
        b"".join(
            np.uint32(merges.special[part]).tobytes() if special else b"".join([known[w] for w in part])
            for special, part in doc
        )
        for doc in docs
    ]


def _encode_batch(cut, batch: pd.Series) -> list[bytes]:
    out: list[bytes] = []
    waiting, chars = [], 0
    for text in batch:
        waiting.append(text or "")
        chars += len(waiting[-1])
        if chars >= SLICE_CHARS:
            out += _encode_slice(cut, waiting)
            waiting, chars = [], 0
    return out + _encode_slice(cut, waiting)


def _decode_batch(piece, batch) -> list[str]:
    return [
        b"".join(map(piece, np.frombuffer(ids or b"", "<u4").tolist())).decode(errors="replace") for ids in batch
    ]


def encoder(path: str):
    """Pandas UDF: text to packed ids."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cut = splitter(path, "byte")
        for batch in batches:
            yield pd.Series(_encode_batch(cut, batch), dtype=object)

    return encode


def decoder(path: str):
    """Pandas UDF: packed ids to text; bytes that are not UTF-8 become replacement characters."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        piece = splitter(path, "byte").merges.bytes_of.__getitem__
        for batch in batches:
            yield pd.Series(_decode_batch(piece, batch), dtype=object)

    return decode


def coder(path: str):
    """Pandas UDF: text to (packed ids, text decoded from them) in one worker."""

    @F.pandas_udf("ids binary, decoded string")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cut = splitter(path, "byte")
        for batch in batches:
            ids = _encode_batch(cut, batch)
            yield pd.DataFrame({"ids": ids, "decoded": _decode_batch(cut.merges.bytes_of.__getitem__, ids)})

    return code


def encode(docs: DataFrame, path: str = BYTE_BPE, text: str = "text", ids: str = "ids") -> DataFrame:
    return docs.withColumn(ids, encoder(path)(text_of(text)))


def decode(docs: DataFrame, path: str = BYTE_BPE, ids: str = "ids", text: str = "decoded") -> DataFrame:
    return docs.withColumn(text, decoder(path)(F.col(ids)))


def round_trip(docs: DataFrame, path: str = BYTE_BPE, text: str = "text", result: str = "coded") -> DataFrame:
    """Both directions at once: a struct of ids and decoded text."""
    return docs.withColumn(result, coder(path)(text_of(text)))


def n_tokens(ids: str | Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs).select(
        "doc_id",
        n_tokens("coded.ids").alias("n_tokens"),
        F.sha2("coded.ids", 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op1_bpe": op1_bpe}
SQL: dict[str, str] = {}
