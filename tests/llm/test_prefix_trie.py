import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tracewell.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, path string, depth int"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    nodes = defaultdict(list)
    ends = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        family = c - int(np.fmod(c, 20))
        s = tuple(own.get(family, [])[:h] + own[c][h:])
        ends[s].append(c)
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in nodes) for q in below)
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        up = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), up, len(members), len(kids), leaves, saved, digest))
    return sorted(out, key=str)


def conversations(n=160, hot=0.3):
    random.seed(11)
    rows = []
    for c in [*range(n), -1, -20, 5000, 123456789012]:
        same = random.random() < hot
        for t in range(random.randrange(1, 7)):
            text = "hello all  you" if same else random.choice(["a", "b b", "c\tc c", None, ""])
            rows.append((c, t, "user" if t % 2 == 0 else random.choice(["assistant", None]), text))
    rows += [(None, 0, "user", "lost"), (7, None, "system", "first of all"), (7, 0, "user", "tie"), rows[3], rows[3]]
    rows += [(300, t, "user", f"long {t}") for t in range(200)]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize(("turns", "bits"), [(1 << 17, 12), (40, 2), (7, 1)])
def test_equals_brute_force(spark, monkeypatch, turns, bits):
    monkeypatch.setattr(pt, "SHARD_TURNS", turns)
    monkeypatch.setattr(pt, "LISTED_BITS", bits)
    rows = conversations()
    given = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = pt.prefix_trie(pt.rebuilt(pt.sequences(given))).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_double_array_holds_all_sequences():
    rng = np.random.default_rng(5)
    for many in (1, 3, 40, 500):
        seqs = sorted({tuple(rng.integers(1, many + 1, rng.integers(0, 8)).tolist()) for _ in range(400)})
        ids = np.array([c for s in seqs for c in s], np.int64)
        trie = pt.DoubleArray(ids, np.append(0, np.cumsum([len(s) for s in seqs])))
        cell_of = {}
        for depth, at, cells in trie.walk():
            for k, cell in zip(at.tolist(), cells.tolist()):
                assert cell_of.setdefault(seqs[k][:depth], cell) == cell
        assert len(set(cell_of.values())) == len(cell_of) == len({s[:d] for s in seqs for d in range(len(s) + 1)})
        assert len(trie.check) <= 3 * len(cell_of) + many + 2


def test_turnless_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pt.prefix_trie(pt.rebuilt(pt.sequences(empty))).collect() == []
    # the only turn is replaced by those of a first conversation that does not exist
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    rows = [(c, 0, "user", "gone")]
    got = pt.prefix_trie(pt.rebuilt(pt.sequences(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)))).collect()
    assert [tuple(r) for r in got] == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_role_and_text_stay_apart(spark):
    rows = [(1000, 0, "ab", "c"), (1020, 0, "a", "bc"), (1040, 0, "", "abc")]
    got = pt.prefix_trie(pt.sequences(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))).collect()
    assert len(got) == 4
