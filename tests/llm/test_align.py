import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tracewell.llm import align as al
from tracewell.llm.vocab import byte_alphabet

A = Tokenizer.from_file(al.BYTE_BPE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=al.PIECE_BPE)
BACK = {c: b for b, c in enumerate(byte_alphabet())}


def spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(rows):
    """Every column from its definition: all pairs of tokens are compared."""
    docs = []
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        a = A.encode(" " + text, add_special_tokens=False).ids if text else []
        b = B.encode(text) if text else []
        part_a = [bytes(BACK[c] for c in A.id_to_token(i)) for i in a]
        part_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(part_a) != whole or b"".join(part_b) != whole:
            docs.append(([], [], [], ""))
            continue
        sa, sb = spans(part_a), spans(part_b)
        links = [(i, j) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({y for _, y in sa} & {y for _, y in sb})
        groups, low = [], 0
        for e in ends:
            mine = [[str(i) for i, (x, y) in zip(ids, s) if low <= x and y <= e] for ids, s in ((a, sa), (b, sb))]
            groups.append("|".join(map(",".join, mine)))
            low = e
        docs.append((a, b, links, ";".join(groups)))
    seen = Counter(p for a, b, links, _ in docs for p in {(a[i], b[j]) for i, j in links})
    top = Counter()
    for (i, _), n in seen.items():
        top[i] = max(top[i], n)
    out = []
    for (key, _), (a, b, links, text) in zip(rows, docs):
        counts = [(a[i], seen[a[i], b[j]]) for i, j in links]
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        best = sum(n == top[i] for i, n in counts)
        out.append((key, len(a), len(b), text.count(";") + 1 if a else 0, len(links), best, sum(n for _, n in counts), digest))
    return out


def texts():
    random.seed(3)
    words = ["the", "Übergrößenträger", "naïve", "12345", "\n\n", "<|endoftext|>", "</s>", "日本語のテキスト", "🙂🙃", "don't", "x" * 40, "  ", "<0x41>"]
    out = [" ".join(random.choices(words, k=random.randrange(1, 60))) for _ in range(40)]
    return out + ["", None, " ", "a", "▁ not a space", "tab\tand\x00nul", "ⅷ ² ᾳ", " " * 3000 + "end", *out[:5], "é" * 700]


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block", [1 << 22, 300])
def test_equals_brute_force(spark, monkeypatch, block):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a int, pairs string").repartition(3)
    monkeypatch.setattr(al.postings, "__defaults__", (block,))
    found = al.align(docs)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got(found) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("work", [1, 2, 3, 7, 64])
def test_pieces_give_one_merge(work):
    rng = np.random.default_rng(work)
    for _ in range(60):
        end = int(rng.integers(1, 120))
        a, b = (np.append(np.unique(rng.integers(1, end + 1, rng.integers(0, 60)))[:-1], end) for _ in range(2))
        a, b = np.unique(a), np.unique(b)
        i, j = al.diagonals(a, b, work)
        assert (i + j == np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))).all()
        x, y, shared_a, shared_b = al.overlaps(a, b, work)
        low_a, low_b = np.append(0, a[:-1]), np.append(0, b[:-1])
        want = {(p, q) for p in range(len(a)) for q in range(len(b)) if low_a[p] < b[q] and low_b[q] < a[p]}
        assert sorted(zip(x.tolist(), y.tolist())) == sorted(want)
        assert (shared_a == np.isin(a, b)).all()
        assert (shared_b == np.isin(b, a)).all()


def test_empty_table(spark):
    assert al.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string")
    assert got(al.align(only)) == [(1, 0, 0, 0, 0, 0, 0, "")] * 2
