"""Token counts: pieces once per distinct pre-token, joined to per-document frequencies, summed.

Documents are read in blocks. A block leaves as one row per part of the pre-tokens, which are dealt
to parts by hash: the pre-tokens, and for each the ordinals and frequencies of its documents. A
frequent pre-token is one entry per block, not one per document. All rows of a part meet in one
group, where every distinct pre-token of the corpus is encoded once, its number of pieces is joined
to the frequencies, and the products are summed per document. Ids are never built for a document.

A null text is the empty one and counts 0. Rows stay rows: null or repeated document ids are told
apart by their place in the block. Empty tables stay empty; columns beyond key and text are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import table, text_of
from tracewell.llm.vocab import splitter

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: A block ends at so many characters of text or documents; ordinals fit into 16 bits.
BLOCK_CHARS, BLOCK_DOCS = 1 << 23, 1 << 16
#: Parts follow the shuffle setting; more of them split a document's sums into more pieces.
PARTS_PER_PARTITION = 1

POSTINGS = """part int, block long, words binary, entries binary, ordinals binary, freqs binary,
keys array<long>, n_bytes array<long>, specials array<long>"""
_SCHEMA = pa.schema(
    [("part", pa.int32()), ("block", pa.int64())]
    + [(c, pa.binary()) for c in ("words", "entries", "ordinals", "freqs")]
    + [(c, pa.list_(pa.int64())) for c in ("keys", "n_bytes", "specials")]
)
_SUMS = "block long, ordinals binary, products binary, keys array<long>, n_bytes array<long>, specials array<long>"


def _batch(columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary array whose element i holds ``values[starts[i]:starts[i + 1]]``."""
    offsets = pa.py_buffer((starts * values.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, offsets, pa.py_buffer(values)])


def _block_rows(cut, parts: int, block: int, keys: list, sizes: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
    merges = cut.merges
    number: dict[str, int] = defaultdict()
    number.default_factory = number.__len__
    codes, specials = [], []
    for text in texts:
        words, n_special = [], 0
        for special, piece in merges.pieces(text) if merges.special_pattern.search(text) else [(False, text)]:
            if special:
                n_special += 1
            else:
                words += cut.words(piece)
        codes.append(np.array([number[w] for w in words], np.int64))
        specials.append(n_special)
    # the block's documents go to a group without pre-tokens
    none = [None]
    yield _batch([[parts + block % parts], [block], none, none, none, none, [keys], [sizes], [specials]])
    if not number:
        return
    words = list(number)
    part = np.fromiter((crc32(w.encode()) % parts for w in words), np.int64, len(words))
    order = np.argsort(part, kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    lengths = np.fromiter(map(len, codes), np.int64, len(codes))
    entry = (place[np.concatenate(codes)] << 16) | np.repeat(np.arange(len(codes)), lengths)
    entry, freq = np.unique(entry, return_counts=True)
    while (over := freq > 65535).any():  # such a frequency takes several entries
        entry = np.append(entry, entry[over])
        freq = np.append(np.where(over, freq - 65535, freq), np.full(over.sum(), 65535))
    sort = np.argsort(entry, kind="stable")
    entry, freq = entry[sort], freq[sort]
    found, first = np.unique(part[order], return_index=True)
    ends = np.append(first, len(words))
    per_word = np.bincount(entry >> 16, minlength=len(words)).astype("<u4")
    starts = np.searchsorted(entry >> 16, ends)
    texts_of = ["\n".join([words[i] for i in order[a:b]]).encode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    n = len(found)
    yield _batch(
        [
            found.astype(np.int32),
            np.full(n, block),
            texts_of,
            _packed(per_word, ends),
            _packed((entry & 65535).astype("<u2"), starts),
            _packed(freq.astype("<u2"), starts),
            *(pa.nulls(n, pa.list_(pa.int64())) for _ in range(3)),
        ]
    )


def postings(
    docs: DataFrame, path: str, key: str, text: str, parts: int, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row per block and part of the pre-tokens, and one row per block with its documents."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = splitter(path, "word")
        block = TaskContext.get().partitionId() << 32
        keys, sizes, texts, chars = [], [], [], 0
        for batch in batches:
            for k, size, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys.append(k)
                sizes.append(size)
                texts.append(t)
                chars += len(t)
                if chars >= block_chars or len(keys) == BLOCK_DOCS:
                    yield from _block_rows(cut, parts, block, keys, sizes, texts)
                    block, keys, sizes, texts, chars = block + 1, [], [], [], 0
        if keys:
            yield from _block_rows(cut, parts, block, keys, sizes, texts)

    whole = text_of(text)
    narrow = docs.select(
        F.col(key).cast("long").alias("key"), F.octet_length(whole).cast("long").alias("size"), whole.alias("text")
    )
    return narrow.mapInArrow(build, POSTINGS)


def _part_sums(path: str):
    """The products of one part, summed per block and document."""

    def join(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        schema = pa.schema([(c, pa.int64() if c == "block" else pa.binary()) for c in ("block", "ordinals", "products")])
        heads = [c for c in ("keys", "n_bytes", "specials")]
        schema = pa.schema([*schema, *(pa.field(c, pa.list_(pa.int64())) for c in heads)])
        if rows[0]["words"] is None:
            out = [{c: r.get(c) for c in schema.names if c != "products"} | {"ordinals": None, "products": None} for r in rows]
            return pa.Table.from_pylist(out, schema=schema)
        words = [r["words"].decode().split("\n") for r in rows]
        distinct = list({w for some in words for w in some})
        pieces = dict(zip(distinct, map(len, splitter(path, "word").merges.encode_words(distinct)), strict=True))
        out = []
        for r, some in zip(rows, words, strict=True):
            n = np.fromiter((pieces[w] for w in some), np.int64, len(some))
            products = np.repeat(n, np.frombuffer(r["entries"], "<u4")) * np.frombuffer(r["freqs"], "<u2")
            total = np.bincount(np.frombuffer(r["ordinals"], "<u2"), products).astype("<u4")
            at = np.flatnonzero(total)
            out.append({"block": r["block"], "ordinals": at.astype("<u2").tobytes(), "products": total[at].tobytes()})
        return pa.Table.from_pylist(out, schema=schema)

    return join


def _finish(block: pa.Table) -> pa.Table:
    """The documents of one block with their totals."""
    rows = block.to_pylist()
    head = next(r for r in rows if r["keys"] is not None)
    total = np.array(head["specials"], np.int64)
    for r in rows:
        if r["ordinals"] is not None:
            np.add.at(total, np.frombuffer(r["ordinals"], "<u2"), np.frombuffer(r["products"], "<u4").astype(np.int64))
    return pa.table(
        [pa.array(head["keys"], pa.int64()), pa.array(head["n_bytes"], pa.int64()), pa.array(total)],
        ["key", "n_bytes", "n_tokens"],
    )


def token_counts(docs: DataFrame, path: str = WORD_BPE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) for each row of ``docs``; the key is a whole number or null."""
    parts = PARTS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = postings(docs, path, key, text, parts).groupBy("part").applyInArrow(_part_sums(path), _SUMS)
    counted = joined.groupBy("block").applyInArrow(_finish, "key long, n_bytes long, n_tokens long")
    return counted.withColumnRenamed("key", key)


def op6_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


QUERIES = {"op6_token_counts": op6_token_counts}
SQL: dict[str, str] = {}
