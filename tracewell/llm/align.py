"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Both tokenizers cut the same bytes, so their token ends are two ascending lists, and merging these
gives everything: between two neighbouring ends lies one pair of overlapping tokens (a *link*), and
an end in both lists closes a *group*. The lists of a block of documents are laid behind each other
and merged by *merge path*: binary searches on evenly spaced diagonals divide the merge into pieces of
equal work, whatever the lengths of the documents. A piece emits its overlaps and the ends that both
sides share; an end shared across the border of two pieces is stitched by looking one place back.

How many documents link a pair of ids needs the whole corpus. A block leaves as *postings*: per part
of the first ids, the distinct pairs with the ordinals of their documents and how often each links
them. Document counts of pairs are summed over all blocks, packed per part with each first id's
highest count, and joined to the postings by part; the sums of a block are added up per document.
No id pair meets its documents in one group, so frequent pairs weigh on no task.

Texts that are null or empty, or whose bytes either tokenizer does not give back (with the leading
space that the second one adds), have no tokens: zeros and an empty digest. Special strings inside
texts are plain text. Rows with null or repeated keys stay rows, empty tables stay empty, other
columns are not read. A block ends at a number of characters or documents; a longer text is a block.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import table
from tracewell.llm.vocab import UNSTABLE, byte_alphabet
from tracewell.session import materialize, small_side

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
BLOCK_CHARS, BLOCK_DOCS = 1 << 22, 1 << 16
#: Ends in a piece of the merge.
WORK = 1 << 12
#: Parts of the first ids; the vocabularies bound the pairs of one part.
PARTS = 256
#: Pairs that a task gathers before it adds up their counts, and blocks whose sums it holds.
GATHERED, HELD = 1 << 22, 64
#: The rank tokenizer backtracks over white space; texts with longer runs go to the library.
_LONG_SPACE = re.compile(r"\s{1000}")


class ByteTokens:
    """Ids of a byte-level file for texts as plain text, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        self.bytes_of = [b""] * self.library.get_vocab_size()
        ranks = {}
        for token, i in model["vocab"].items():
            if all(c in back for c in token):
                self.bytes_of[i] = bytes(back[c] for c in token)
                ranks[self.bytes_of[i]] = i
            else:
                self.bytes_of[i] = token.encode()
        merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
        built = [model["vocab"][m] for m in merged]
        #: Ids in the order of their merges can serve as ranks.
        self.ranked = built == sorted(built)
        self.quick = Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[list[int]]:
        plain = [self.ranked and not UNSTABLE.search(t) and not _LONG_SPACE.search(t) for t in texts]
        odd = iter(self.library.encode_batch([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [self.quick.encode_ordinary(t) if p else next(odd).ids for t, p in zip(texts, plain)]


class PieceTokens:
    """Ids of a sentencepiece model, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            own = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
            self.bytes_of.append(own)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> tuple[ByteTokens, PieceTokens]:
    """One pair per worker process."""
    return ByteTokens(a_path), PieceTokens(b_path)


def diagonals(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two ascending lists stands after each ``work`` steps; ties take ``a`` first.

    On each diagonal of the merge grid a binary search finds the least number of places in ``a`` so
    that the next of ``a`` comes after the last taken of ``b``. All diagonals are searched together.
    """
    step = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, step - len(b)), np.minimum(step, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = np.where(open_, mid, 0)
        other = np.where(open_, step - 1 - mid, 0)
        early = a[at] <= b[other]
        low = np.where(open_ & early, mid + 1, low)
        high = np.where(open_ & ~early, mid, high)
    return low, step - low


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of a, tokens of b) of all links, and for each list which ends are shared.

    ``a`` and ``b`` are token ends of the same bytes; the last ends are equal.
    """
    i, j = diagonals(a, b, work)
    links_a, links_b = [], []
    shared_a, shared_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for i0, i1, j0, j1 in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist(), strict=True):
        mine, theirs = a[i0:i1], b[j0:j1]
        # an end of a closes a link with the token of b that reaches it; that may end in a later piece
        reach = j0 + np.searchsorted(theirs, mine)
        same = b[reach] == mine
        shared_a[i0:i1] = same
        shared_b[reach[same]] = True
        links_a.append(np.arange(i0, i1))
        links_b.append(reach)
        # an end of b closes one too, unless a ends there; ties put that end of a at most one place back
        reach = i0 + np.searchsorted(mine, theirs, side="right")
        fresh = np.ones(len(theirs), bool)
        behind = reach > 0
        fresh[behind] = a[reach[behind] - 1] != theirs[behind]
        links_a.append(reach[fresh])
        links_b.append(np.arange(j0, j1)[fresh])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *links_a]), np.concatenate([none, *links_b]), shared_a, shared_b


class Printer:
    """Groups as text: ids with the separator that follows them."""

    def __init__(self, n_ids: int) -> None:
        self.n_ids = n_ids
        self.words = [f"{i}{sep}" for sep in (",", "|", ";", "") for i in range(n_ids)]

    def __call__(self, ids_a, ids_b, shared_a, shared_b, starts: np.ndarray) -> list[str]:
        """One text per document; ``starts`` are the places of the documents among all tokens."""
        group_a = np.cumsum(shared_a) - shared_a
        group_b = np.cumsum(shared_b) - shared_b
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        code[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)] = ids_a + self.n_ids * shared_a
        code[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")] = ids_b + 2 * self.n_ids * shared_b
        code[starts[1:] - 1] += self.n_ids
        words = self.words
        return ["".join([words[c] for c in code[x:y].tolist()]) for x, y in zip(starts[:-1], starts[1:])]


_HEADS = ("keys", "n_a", "n_b", "n_groups", "n_links")
POSTINGS = """part int, block long, pairs binary, entries binary, ordinals binary, times binary,
keys array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>"""
_SCHEMA = pa.schema(
    [("part", pa.int32()), ("block", pa.int64())]
    + [(c, pa.binary()) for c in ("pairs", "entries", "ordinals", "times")]
    + [(c, pa.list_(pa.int64())) for c in _HEADS]
    + [("digests", pa.list_(pa.string()))]
)


def _flat(lists: list) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.array(x, np.int64) for x in lists)])


class Block:
    """Aligns the documents of one block."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = tokenizers(a_path, b_path)
        self.len_a, self.len_b = (np.fromiter(map(len, t.bytes_of), np.int64) for t in (self.a, self.b))
        self.print = Printer(max(len(self.len_a), len(self.len_b)))

    def tokens(self, texts: list[str | None]) -> tuple[list[int], list[list[int]], list[list[int]]]:
        """The documents with tokens, and their ids of either side."""
        some = [k for k, t in enumerate(texts) if t]
        ids_a, ids_b = self.a([" " + texts[k] for k in some]), self.b([texts[k] for k in some])
        known_a, known_b = self.a.bytes_of.__getitem__, self.b.bytes_of.__getitem__
        kept = []
        for n, k in enumerate(some):
            whole = (" " + texts[k]).encode()
            if b"".join(map(known_b, ids_b[n])) == whole and b"".join(map(known_a, ids_a[n])) == whole:
                kept.append(n)
        return [some[n] for n in kept], [ids_a[n] for n in kept], [ids_b[n] for n in kept]

    def rows(self, block: int, keys: list, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
        docs, lists_a, lists_b = self.tokens(texts)
        ids_a, ids_b = _flat(lists_a), _flat(lists_b)
        size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (lists_a, lists_b))
        link_a, link_b, shared_a, shared_b = overlaps(np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b]))
        doc_a = np.repeat(np.arange(len(docs)), size_a)
        digests = [""] * len(texts)
        starts = np.append(0, np.cumsum(size_a + size_b))
        for k, text in zip(docs, self.print(ids_a, ids_b, shared_a, shared_b, starts)):
            digests[k] = hashlib.sha256(text.encode()).hexdigest()
        counts = np.zeros((4, len(texts)), np.int64)
        per_doc = lambda owner: np.bincount(owner, minlength=len(docs))
        if docs:
            counts[:, docs] = size_a, size_b, per_doc(doc_a[shared_a]), per_doc(doc_a[link_a])
        yield self._batch([[-1], [block], *[[None]] * 4, [keys], *([c] for c in counts.tolist()), [digests]])
        if docs:
            yield self._postings(block, ids_a[link_a], ids_b[link_b], np.array(docs)[doc_a[link_a]])

    @staticmethod
    def _batch(columns: list) -> pa.RecordBatch:
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)

    def _postings(self, block: int, a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        """One row per part: its pairs, how many documents each has, their ordinals and times."""
        n_b = len(self.len_b)
        entry, times = np.unique(((a * n_b + b) << 16) | doc, return_counts=True)
        a, b = np.divmod(entry >> 16, n_b)
        order = np.argsort((a % PARTS).astype(np.uint8 if PARTS <= 256 else np.int64), kind="stable")
        entry, times, a, b = entry[order], times[order], a[order], b[order]
        pair = (a << 32) | b
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        pairs, docs = pair[first], np.diff(np.append(first, len(pair))).astype("<u4")
        part, at = np.unique((pairs >> 32) % PARTS, return_index=True)
        pair_ends, entry_ends = np.append(at, len(pairs)), np.append(first[at], len(pair))
        ordinals, times = (entry & 65535).astype("<u2"), times.astype("<u4")
        cut = lambda values, ends: [values[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:])]
        n = len(part)
        return self._batch(
            [part, np.full(n, block), cut(pairs, pair_ends), cut(docs, pair_ends), cut(ordinals, entry_ends)]
            + [cut(times, entry_ends), *(pa.nulls(n, f.type) for f in list(_SCHEMA)[6:])]
        )


def postings(docs: DataFrame, a_path: str, b_path: str, key: str, text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row per block with the results of its documents (part -1), and a row per block and part."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = Block(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        keys, texts, chars = [], [], 0
        for batch in batches:
            for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys.append(k)
                texts.append(t)
                chars += len(t or "")
                if chars >= block_chars or len(keys) == BLOCK_DOCS:
                    yield from aligned.rows(block, keys, texts)
                    block, keys, texts, chars = block + 1, [], [], 0
        if keys:
            yield from aligned.rows(block, keys, texts)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(build, POSTINGS)


def _added(pairs: list[np.ndarray], docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pair, code = np.unique(np.concatenate(pairs), return_inverse=True)
    return pair, np.bincount(code, np.concatenate(docs)).astype(np.int64)


def _sum_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, docs) of the postings of one task, added up before they leave it."""
    pairs, docs, gathered = [], [], 0
    send = lambda p, d: pa.RecordBatch.from_arrays([pa.array(p), pa.array(d)], ["pair", "docs"])
    for batch in batches:
        for p, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pairs.append(np.frombuffer(p, "<i8"))
            docs.append(np.frombuffer(d, "<u4"))
            gathered += len(pairs[-1])
            if gathered > GATHERED:
                pair, n = _added(pairs, docs)
                if 2 * len(pair) > GATHERED:
                    yield send(pair, n)
                    pairs, docs, gathered = [], [], 0
                else:
                    pairs, docs, gathered = [pair], [n], len(pair)
    if pairs:
        yield send(*_added(pairs, docs))


def _packed(part: pa.Table) -> pa.Table:
    """The pairs of one part in order, with their counts and whether these are their first id's highest."""
    part = part.sort_by("pair")
    pair, docs = part.column("pair").to_numpy(), part.column("docs").to_numpy()
    _, code = np.unique(pair >> 32, return_inverse=True)
    top = np.zeros(code[-1] + 1, np.int64)
    np.maximum.at(top, code, docs)
    packed = [(pair[:1] >> 32) % PARTS, *([x.tobytes()] for x in (pair, docs, docs == top[code]))]
    schema = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("known", "docs", "best"))])
    return pa.table([pa.array(c, f.type) for c, f in zip(packed, schema, strict=True)], schema=schema)


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block the sums of counts and the best links of its documents, over the parts of this task."""
    held: dict[int, np.ndarray] = {}

    def send() -> pa.RecordBatch:
        rows = [(b, *(total[:, : 1 + np.flatnonzero(total[0])[-1]])) for b, total in held.items()]
        columns = [[b for b, _, _ in rows], [c.tobytes() for _, c, _ in rows], [c.tobytes() for _, _, c in rows]]
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["block", "count_sums", "bests"])

    for batch in batches:
        for row in batch.to_pylist():
            at = np.searchsorted(np.frombuffer(row["known"], "<i8"), np.frombuffer(row["pairs"], "<i8"))
            entries = np.frombuffer(row["entries"], "<u4")
            docs = np.repeat(np.frombuffer(row["docs"], "<i8")[at], entries)
            best = np.repeat(np.frombuffer(row["best"], bool)[at], entries)
            ordinals, times = np.frombuffer(row["ordinals"], "<u2"), np.frombuffer(row["times"], "<u4").astype(np.int64)
            if row["block"] not in held:
                if len(held) == HELD:
                    yield send()
                    held.clear()
                held[row["block"]] = np.zeros((2, BLOCK_DOCS), np.int64)
            total = held[row["block"]]
            np.add.at(total[0], ordinals, docs * times)
            np.add.at(total[1], ordinals, best * times)
    if held:
        yield send()


ROWS = "key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _finish(block: pa.Table) -> pa.Table:
    """The documents of one block with their totals."""
    rows = block.to_pylist()
    head = next(r for r in rows if r["keys"] is not None)
    n = len(head["keys"])
    total = np.zeros((2, n), np.int64)
    for r in rows:
        if r["keys"] is None:
            some = np.stack([np.frombuffer(r[c], "<i8") for c in ("bests", "count_sums")])
            total[:, : some.shape[1]] += some
    columns = [pa.array(head[c], pa.int64()) for c in _HEADS] + [pa.array(t) for t in total] + [pa.array(head["digests"], pa.string())]
    return pa.table(columns, [c.split(" ")[0] for c in ROWS.split(", ")])


def align(
    docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Numbers and digests of the alignment for each row of ``docs``; the key is a whole number or null."""
    rows = materialize(postings(docs, a_path, b_path, key, text), "alignment_postings")
    parts = rows.where("part >= 0")
    counts = parts.select("pairs", "entries").mapInArrow(_sum_pairs, "pair long, docs long")
    counts = counts.groupBy("pair").agg(F.sum("docs").alias("docs"))
    part = F.pmod(F.shiftright("pair", 32), F.lit(PARTS))
    packed = counts.groupBy(part.alias("part")).applyInArrow(_packed, "part int, known binary, docs binary, best binary")
    met = parts.select("part", "block", "pairs", "entries", "ordinals", "times").join(small_side(packed), "part")
    sums = met.mapInArrow(_block_sums, "block long, count_sums binary, bests binary")
    heads = rows.where("part < 0").select("block", *_HEADS, "digests")
    found = heads.unionByName(sums, allowMissingColumns=True).groupBy("block").applyInArrow(_finish, ROWS)
    return found.withColumnRenamed("key", key)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


QUERIES = {"op13_token_alignment": op13_token_alignment}
SQL: dict[str, str] = {}
