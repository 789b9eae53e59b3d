import random

import numpy as np
import pytest
import xxhash

from tracewell.llm import simhash as sh


def plain(text, n=4):
    """The fingerprint by its definition, in Python integers."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    w = [x for x in lower.split(" ") if x]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts():
    random.seed(7)
    vocabulary = [f"w{i}É" if i % 5 else f"W{i}" for i in range(400)]
    out = ["", None, " \t", "one", "One two", "a b c", "a b c d", "a\x0bb\x85c d e f", "x " * 5000, "é" * 3000]
    for _ in range(40):
        base = random.choices(vocabulary, k=random.randrange(4, 300))
        out.append(" ".join(base))
        for _ in range(random.randrange(0, 6)):
            copy = list(base)
            copy[random.randrange(len(copy))] = random.choice(vocabulary)
            out.append("\n".join(copy))
    return out + out[20:30] * 3


def brute_groups(prints, radius=4):
    up = list(range(len(prints)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


@pytest.mark.parametrize("slice_bytes", [1, 7, 50, 1 << 20])
def test_fingerprints_equal_the_definition(slice_bytes):
    for text in texts():
        got = sh.fingerprint_of(text or "", slice_bytes=slice_bytes) & (2**64 - 1)
        assert got == plain(text or ""), text


@pytest.mark.parametrize("piece", [1 << 17, 6])
def test_groups_equal_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(sh, "PIECE", piece)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, print string, own int")
    got = {r[0]: (r["print"] & (2**64 - 1), r["least"]) for r in sh.near_groups(docs).collect()}
    prints = [plain(t or "") for _, t in rows]
    least = brute_groups(prints)
    assert len(set(least)) < len(set(prints))
    assert got == {i: (prints[i], least[i]) for i, _ in rows}


def family(n, bits, seed):
    rng = np.random.default_rng(seed)
    flips = (np.uint64(1) << rng.integers(0, 64, (n, bits), dtype=np.uint64)) * rng.integers(0, 2, (n, bits), dtype=np.uint64)
    return np.bitwise_xor.reduce(flips, axis=1) ^ rng.integers(0, 2**63, dtype=np.uint64)


@pytest.mark.parametrize("piece", [1 << 17, 40])
def test_links_in_crowded_keys(spark, monkeypatch, piece):
    """Families of many near fingerprints, cut into pieces, keep every group of brute force."""
    monkeypatch.setattr(sh, "PIECE", piece)
    prints = np.unique(np.concatenate([family(300, 5, 1), family(200, 12, 2), family(100, 30, 3)]))
    signed = prints.view(np.int64).tolist()
    links = sh.near_links(spark.createDataFrame([(p,) for p in signed], "print long"))
    pairs = [(r.source, r.target) for r in links.collect()]
    found = sh.components(spark.createDataFrame(pairs, "source long, target long")).collect()
    mine = {p: p for p in signed} | {r.node: r.component for r in found}
    want = brute_groups([int(p) for p in prints])
    assert len({(mine[p], w) for p, w in zip(signed, want, strict=True)}) == len(set(want)) == len(set(mine.values()))


def test_tree_search_finds_all_neighbours():
    prints = np.unique(family(400, 9, 4))
    keys = np.sort(np.arange(len(prints)) % 3)
    tree = sh.Trees(prints, keys)
    roots = tree.root[keys]
    labels = np.arange(len(prints))
    pairs = {(int(q), int(v)) for a, b in tree.search(prints, roots, labels - len(prints), labels, 4) for q, v in zip(a, b)}
    near = (np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4) & (keys[:, None] == keys[None, :])
    assert pairs == {(int(a), int(b)) for a, b in zip(*np.nonzero(near))}


def test_null_repeated_and_empty(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "A b c d e"), (3, None), (3, ""), (9, " ")], schema)
    got = sorted(((r.doc_id, r.least) for r in sh.near_groups(docs).collect()), key=str)
    assert got == [(3, 3), (3, 3), (9, 3), (None, None), (None, None)]
    assert sh.near_groups(spark.createDataFrame([], schema)).collect() == []
    with pytest.raises(ValueError, match="bands"):
        sh.near_links(docs.selectExpr("doc_id AS print"), radius=5)
