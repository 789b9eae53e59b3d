from collections import Counter

from tokenizers import Tokenizer

from tracewell.llm import tokencount

TEXTS = [
    "", None, "the the The THE", "a<|endoftext|>b <|startoftext|>", "é É ǅ ՘ 12345 don't", "x" * 3000,
    "wo rd " * 70_000, "\n \t", "日本語 ΣΑΣ",
]


def test_counts_equal_the_library(spark, monkeypatch):
    rows = [(i, t, "n") for i, t in enumerate(TEXTS)] + [(None, "the end", "n"), (3, "the", "n"), (3, "the", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    library = Tokenizer.from_file(tokencount.WORD_BPE)
    want = Counter(
        (k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t, _ in rows
    )
    for parts in (1, 3):
        got = tokencount.token_counts(docs.repartition(parts)).collect()
        assert Counter(map(tuple, got)) == want
    assert tokencount.token_counts(docs.limit(0)).collect() == []


def test_small_blocks_give_the_same(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} common text") for i in range(200)], "doc_id long, text string")
    big = tokencount.postings(docs.coalesce(1), tokencount.WORD_BPE, "doc_id", "text", 8)
    small = tokencount.postings(docs.coalesce(1), tokencount.WORD_BPE, "doc_id", "text", 8, block_chars=100)
    assert big.where("keys is not null").count() == 1
    assert small.where("keys is not null").count() > 20
