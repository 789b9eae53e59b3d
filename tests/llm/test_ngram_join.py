import random
import re
from collections import Counter

import pytest

from tracewell.llm import ngram_join as nj


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or (both and 10 * len(sets[i] & sets[j]) >= 8 * both):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    return links, [find(i) for i in range(len(rows))]


def corpus():
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    make = lambda n: random.choices(vocabulary, k=n)
    rows = [(i, " ".join(make(random.randrange(3, 120)))) for i in range(150)]
    for base in range(12):
        w = make(150)
        for _ in range(base + 2):
            v = list(w)
            for _ in range(random.randrange(0, 5)):
                v[random.randrange(len(v))] = random.choice(vocabulary)
            rows.append((len(rows), " ".join(v)))
    shared = " ".join(make(60))
    rows += [(len(rows) + k, shared + " " + " ".join(make(60))) for k in range(40)]
    return rows + [(None, None), (None, ""), (5, rows[5][1]), (5, rows[5][1]), (900, "a b"), (901, "a  b"), (902, " ")]


@pytest.mark.parametrize(("bucket", "block"), [(512, 256), (6, 4)])
def test_links_and_groups_equal_brute_force(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(nj, "BUCKET", bucket)
    monkeypatch.setattr(nj, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links, group = brute(rows)
    found = nj.near_duplicates(docs)
    per_text = {bytes(r.cid): r for r in found.collect()}
    import hashlib

    cid = [hashlib.md5((t or "").encode()).digest() for _, t in rows]
    assert set(per_text) == set(cid)
    for i, c in enumerate(cid):
        assert per_text[c].n_links == links[i], (rows[i], per_text[c])
    mine = {i: per_text[c].group for i, c in enumerate(cid)}
    assert len({(mine[i], group[i]) for i in mine}) == len(set(group)) == len(set(map(bytes, mine.values())))
    kept = nj.keep_one(docs).collect()
    assert len(kept) == len(set(group))
    where = {t: mine[i] for i, (_, t) in enumerate(rows)}
    assert len({bytes(where[r.text]) for r in kept}) == len(kept)


def test_components_by_contraction(spark):
    random.seed(6)
    n = 300
    links = [(random.randrange(n), random.randrange(n)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)]
    parent = list(range(500))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = nj.components(spark.createDataFrame(links, "source long, target long")).collect()
    assert {(r.node, r.component) for r in got} == {(i, find(i)) for a, b in links if a != b for i in (a, b)}


def family(m, words, kept, seed):
    """``m`` texts that share a share ``kept`` of their runs of words, two of them near copies of each other."""
    random.seed(seed)
    vocabulary = [f"v{i}" for i in range(20_000)]
    base = [random.choices(vocabulary, k=20) for _ in range(words // 20)]
    texts = []
    for _ in range(m):
        parts = [b if random.random() < kept else random.choices(vocabulary, k=20) for b in base]
        texts.append(" ".join(w for part in parts for w in part))
    return texts


def test_classes_of_a_half_similar_family_get_runs_until_each_meets_the_recall(spark, monkeypatch):
    # one family that every token splits slowly among many texts that depth 1 parts
    monkeypatch.setattr(nj, "BUCKET", 8)
    texts = family(120, 400, 0.65, 7)
    near = [t.rsplit(" ", 12)[0] + " " + " ".join(f"n{i}{k}" for k in range(12)) for i, t in enumerate(texts)]
    rows = list(enumerate(texts + near + family(300, 100, 0.0, 8)))
    runs = []
    plain = nj._runs
    monkeypatch.setattr(nj, "_runs", lambda open_, first, n: runs.append((open_.count(), first, n)) or plain(open_, first, n))
    found = {bytes(r.cid): r for r in nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links, _ = brute(rows)
    import hashlib

    assert [found[hashlib.md5(t.encode()).digest()].n_links for _, t in rows] == [links[i] for i, _ in rows]
    # the first runs hold all texts, later ones the family
    assert runs[0] == (540, 0, 5) and len(runs) > 1 and all(n <= 240 for n, _, _ in runs[1:])


def test_texts_of_classes_are_the_same_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small = sorted(map(tuple, nj.near_duplicates(docs).collect()))
    monkeypatch.setattr(nj, "SENT_CLASSES", 0)
    assert sorted(map(tuple, nj.near_duplicates(docs).collect())) == small


def test_least_row_of_a_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [
        (7, long, "b", 1), (3, long + " x", "a", 2), (3, long, "b", 3), (3, long, "a", 4), (3, long, "a", 4),
        (None, long, "a", 0), (None, "alone", "a", 5), (None, "two", "z", 6), (None, "two", "y", 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, least string, cid int")
    kept = sorted(map(tuple, nj.keep_one(docs).collect()), key=str)
    assert kept == sorted([(3, long, "a", 4), (None, "alone", "a", 5), (None, "two", "y", 7)], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, cid string")
    assert nj.near_duplicates(docs).collect() == []
    assert nj.keep_one(docs).collect() == []


def test_threshold_is_inclusive():
    assert nj.THRESHOLD == 0.8
