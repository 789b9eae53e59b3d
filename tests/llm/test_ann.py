from collections import defaultdict

import numpy as np
import pyarrow as pa

from tracewell.llm import ann


def brute(rows, k):
    width = 8
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == width and None not in v and np.isfinite(v).all() and any(v)]
    ids = np.array([i for i, _ in good])
    x = np.array([v for _, v in good])
    out = {}
    for i, v in good:
        if i % 20:
            continue
        score = x @ v
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def check(spark, rows, k=20, least=0.95):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS node", "2 AS block")
    got = defaultdict(list)
    for r in ann.nearest(df, (df.vec_id % 20) == 0, k).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows], k)
    assert set(got) == {q for q, w in want.items() if w}
    hit = total = 0
    for q, w in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, len(w) + 1))
        assert all(a[2] >= b[2] - 1e-12 for a, b in zip(mine, mine[1:], strict=False))
        assert np.allclose([m[2] for m in mine][:1], [w[0][1]]) or least < 1
        hit += len({m[1] for m in mine} & {i for i, _ in w})
        total += len(w)
    assert hit >= least * total


def test_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 64)
    monkeypatch.setattr(ann, "BLOCK", 200)
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).tolist()) for i in range(1200)]
    rows += [(i, [1.0] * 8) for i in range(1200, 1500)]
    rows += [(1500, None), (1501, [0.0] * 8), (1502, [float("nan")] + [1.0] * 7), (1503, [1.0] * 7), (None, [1.0] * 8), (1504, [None] + [1.0] * 7)]
    check(spark, rows)


def test_small_tables_are_exact(spark):
    r = np.random.default_rng(2)
    check(spark, [(i, r.normal(size=8).tolist()) for i in range(15)], least=1)
    check(spark, [(20, [1.0] * 8), (21, [1.0] * 8), (40, [2.0] * 8)], least=1)
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(df, df.vec_id % 20 == 0).collect() == []


def test_small_far_group_is_complete(spark, monkeypatch):
    """A few vectors opposite to all others still get all the neighbours asked for."""
    monkeypatch.setattr(ann, "LEAF", 64)
    monkeypatch.setattr(ann, "BLOCK", 100)
    r = np.random.default_rng(3)
    rows = [(i, ([1.0] + (0.05 * r.normal(size=7)).tolist())) for i in range(1, 700)]
    rows += [(i, ([-1.0] + (0.05 * r.normal(size=7)).tolist())) for i in (0, 1000, 1001)]
    check(spark, rows, least=0.9)


def test_whole_scan_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann.Index, "search", lambda self, starts: starts.select("query", starts.query.alias("node")))
    r = np.random.default_rng(4)
    check(spark, [(i, r.normal(size=8).tolist()) for i in range(330)], least=1)


def test_blocks_follow_the_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 8)) * 5
    rows = [(i, (centres[i % 12] + r.normal(size=8) * 0.1).tolist()) for i in range(1200)]
    index = ann.Index(spark.createDataFrame(rows, "id long, vector array<float>"), 21)
    assert index.nodes.count() == index.nodes.select("node").distinct().count() == 1200
    per_block = index.nodes.selectExpr("shiftright(node, 20) AS block").groupBy("block").count().collect()
    assert max(b["count"] for b in per_block) < 200 and len(per_block) >= 10
    graph = index.graph.selectExpr("shiftright(node, 20) AS a", "explode(nears) AS near").selectExpr("a", "shiftright(near, 20) AS b")
    assert graph.where("abs(a - b) <= 1").count() > 0.5 * graph.count()


def test_offers_of_a_block_are_one_row_per_block_they_go_to():
    """As many rows as blocks however many nodes get offers; each node gets its best unlisted pairs."""
    r = np.random.default_rng(6)
    members = np.array([b << ann.PLACE_BITS | i for b in range(3) for i in range(20)])
    x = r.normal(size=(60, 8)).astype("<f4")
    edges = [(i, c) for i in range(60) for c in ([7, 8] if i % 2 else [8])]
    edges = pa.table({"sender": members[[i for i, _ in edges] * 2], "centre": np.array([c for _, c in edges] * 2)})
    state = pa.table({
        "node": members, "vector": [v.tobytes() for v in x],
        "nodes": [np.append(members[(i + 1) % 60], np.arange(-33, -2)).astype("<i8").tobytes() for i in range(60)],
        "sims": [np.append(np.full(31, 2.0), 0.5).astype("<f4").tobytes() for _ in range(60)],
    })
    block = ann._messages(edges, state)
    assert block.num_rows == 1 and block.column("to").to_pylist() == [0]
    got = ann._local_join(block)
    assert got.num_rows == 3 and got.column("block").to_pylist() == [0, 1, 2]
    pairs = {}
    for row in got.to_pylist():
        owners, nodes, sims = (np.frombuffer(row[c], d) for c, d in (("owners", "<i8"), ("nodes", "<i8"), ("sims", "<f4")))
        assert set(owners >> ann.PLACE_BITS) == {row["block"]}
        for o, n, v in zip(owners.tolist(), nodes.tolist(), sims.tolist(), strict=True):
            assert (o, n) not in pairs
            pairs[o, n] = v
    place = {int(m): i for i, m in enumerate(members)}
    want = set()
    for i in range(60):
        for part in [range(60), range(1, 60, 2)] if i % 2 else [range(60)]:
            fits = [j for j in part if j not in (i, (i + 1) % 60) and x[i] @ x[j] > 0.5]
            want |= {(i, j) for j in sorted(fits, key=lambda j: -(x[i] @ x[j]))[: ann.OFFERS]}
    assert {(place[o], place[n]) for o, n in pairs} == want
    assert all(np.isclose(v, x[place[o]] @ x[place[n]], atol=1e-5) for (o, n), v in pairs.items())


def test_best_orders_and_keeps_the_first_of_a_node():
    owner, node = np.array([1, 0, 1, 1, 0, 1]), np.array([5, 9, 3, 5, 2, 4])
    sim = np.array([-2.0, 0.0, -0.5, -1.0, -0.0, np.inf], np.float32)
    assert ann._best(owner, node, sim, 3).tolist() == [4, 1, 5, 2, 0]
    assert ann._best(owner[:0], node[:0], sim[:0], 3).tolist() == []


def test_ready_beams_go_into_no_later_round(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 64)
    monkeypatch.setattr(ann, "BLOCK", 200)
    monkeypatch.setattr(ann, "BEAM", 24)
    monkeypatch.setattr(ann, "EXPAND", 24)
    sizes, expand = [], ann.Index._expand
    monkeypatch.setattr(ann.Index, "_expand", lambda self, beam, reached: sizes.append(beam.count()) or expand(self, beam, reached))
    r = np.random.default_rng(7)
    check(spark, [(i, r.normal(size=8).tolist()) for i in range(1200)], least=0.8)
    assert sizes[0] == 60 and sizes == sorted(sizes, reverse=True) and sizes[-1] < 60
