import random
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracewell.operators import drain
from tracewell.sources.lines import format_regex, parse_log_format

ERRORS = [
    "error opening file a.txt now",
    "error opening file b.txt now",
    "make failed",
    "make failed",
    "error opening socket 9 later",
]
CHILDREN = ["alpha x y", "beta x y", "gamma x y", "delta x y", "alpha x z"]


def test_fixture_templates_ids_and_parameters(lines):
    df = lines(ERRORS, CHILDREN)
    out = drain.structured(df)
    hot = drain.structured(df, hot_rows=2)
    assert rows(hot) == rows(out)
    out = out.withColumn("p", F.array_join(drain.parameters("Content", "EventTemplate"), "|"))
    got = rows(out.select("source", "LineId", "EventId", "EventTemplate", "p"))
    assert got == [
        ("s0", 1, "429f7652", "error opening file <*> now", "a.txt"),
        ("s0", 2, "429f7652", "error opening file <*> now", "b.txt"),
        ("s0", 3, "0de965bb", "make failed", ""),
        ("s0", 4, "0de965bb", "make failed", ""),
        ("s0", 5, "79489dac", "error opening socket 9 later", ""),
        ("s1", 1, "e07de326", "alpha x <*>", "y"),
        ("s1", 2, "4ce7fee5", "beta x y", ""),
        ("s1", 3, "ed28fea6", "<*> x y", "gamma"),
        ("s1", 4, "ed28fea6", "<*> x y", "delta"),
        ("s1", 5, "e07de326", "alpha x <*>", "z"),
    ]
    summary = drain.template_summary(drain.mine_templates(df), "template", F.col("line_no"))
    counts = {r.EventId: r.Occurrences for r in summary.collect()}
    assert counts == {"429f7652": 2, "0de965bb": 2, "79489dac": 1, "e07de326": 2, "4ce7fee5": 1, "ed28fea6": 2}


def brute(texts, depth, st, cap):
    """Plain list-of-dicts clustering of one source, written from the rules, for small inputs."""
    clusters, nodes = [], {}
    for i, words in enumerate(t.split() for t in texts):
        n = len(words)
        if n < depth - 2:
            clusters.append(dict(key=None, t=list(words), ids=[i]))
            continue
        path, missing = (n,), False
        for w in words[: depth - 3]:
            kids = nodes.get(path, [])
            step = w if w in kids else "<*>" if "<*>" in kids else None
            if step is None:
                missing = True
                break
            path += (step,)
        best = None
        if not missing:
            for c in (c for c in clusters if c["key"] == path):
                same = sum(a == b != "<*>" for a, b in zip(c["t"], words))
                rank = (same / n, c["t"].count("<*>"))
                if best is None or rank > best[0]:
                    best = (rank, c)
        if best and best[0][0] >= st:
            best[1]["ids"].append(i)
            best[1]["t"] = [a if a == b else "<*>" for a, b in zip(words, best[1]["t"])]
            continue
        path = (n,)
        for w in words[: depth - 3]:
            kids = nodes.setdefault(path, [])
            if w not in kids:
                plain = not any(ch.isdigit() for ch in w)
                fits = len(kids) < cap if "<*>" in kids else len(kids) + 1 < cap
                w = w if plain and fits else "<*>"
                if w not in kids:
                    kids.append(w)
            path += (w,)
        clusters.append(dict(key=path, t=list(words), ids=[i]))
    return {i: " ".join(c["t"]) for c in clusters for i in c["ids"]}


@pytest.mark.parametrize("hot_rows", [60, 10**6])
@pytest.mark.parametrize("depth,st,cap", [(5, 0.5, 3), (4, 0.4, 3), (6, 0.7, 5)])
def test_mining_matches_brute_force(lines, hot_rows, depth, st, cap):
    rng = random.Random(depth)
    texts = []
    for i in range(400):
        n = rng.choice([1, 3, 5, 5, 5, 5, 8])
        words = [rng.choice("abcdefgh19") if rng.random() < 0.4 else "abcdefgh"[j % 8] for j in range(n)]
        texts.append(" ".join(words))
    want = brute(texts, depth, st, cap)
    out = drain.mine_templates(lines(texts).repartition(5), depth, st, cap, hot_rows=hot_rows)
    assert dict(rows(out.select("line_no", "template"))) == want
    assert max(Counter(want.values()).values()) > 1


def test_state_round_trip():
    a, b = drain.Tree(5, 0.5, 3), drain.Tree(5, 0.5, 3)
    for t in CHILDREN[:3]:
        a.assign(t.split())
    b = drain.Tree(5, 0.5, 3, a.state())
    assert [a.assign(t.split()) for t in CHILDREN] == [b.assign(t.split()) for t in CHILDREN]
    assert a.templates() == b.templates()


def test_tokens_and_masks(spark):
    df = spark.createDataFrame([(" a  b12\t",), ("   ",), ("",)], "template string")
    got = [list(r.toks) for r in drain.tokenize(df, [r"\d+"]).collect()]
    assert got == [["a", "b<*>"], [], []]


def test_parameters_quote_the_template(spark):
    data = [("a.b (x)  [1] end", "a.b (<*>) [<*>] end"), ("nope", "a <*>"), ("x\\E y", "x\\E <*>"), ("é 5", "é <num>")]
    df = spark.createDataFrame(data, "c string, t string").withColumn("p", drain.parameters("c", "t"))
    assert [list(r.p) for r in df.collect()] == [["x", "1"], [], ["y"], ["5"]]


def test_log_format_drops_other_lines(lines):
    df = lines(["I  web: up", "garbage", "E db: down: now"]).withColumnRenamed("template", "line")
    assert format_regex("<Level> <Part>: <Content>") == (["Level", "Part", "Content"], r"^(.*?)\s+(.*?):\s+(.*?)$")
    out = rows(parse_log_format(df, "<Level> <Part>: <Content>"))
    assert out == [("s0", 1, "I", "web", "up"), ("s0", 2, "E", "db", "down: now")]


def test_consensus_equals_positions_held_against_each_other(spark):
    """Buckets of one line, of many and of lines longer than a word of bits, with and without hot ones."""
    rng = np.random.default_rng(23)
    given = []
    for n in (1, 2, 3, 62, 63, 64, 130):
        for lead in ("a b", "a 7"):
            start = lead.split()[:n]
            for _ in range(12):
                rest = [f"w{rng.integers(0, 2) if rng.random() < 0.1 else 0}" for _ in range(n - len(start))]
                given.append((["s", None, "t"][rng.integers(0, 3)], " ".join(start + rest)))
    given += [("s", "alone in its bucket"), ("s", ""), ("s", None), ("u", "x <*> 5 y"), ("u", "x <*> 5 z")]
    tokenized = drain.tokenize(spark.createDataFrame(given, "source string, template string"))
    buckets = {}
    for source, line in given:
        toks = (line or "").split()
        if toks:
            route = " ".join("<*>" if any(c.isdigit() for c in t) else t for t in toks[:2])
            buckets.setdefault((source, len(toks), route), []).append(tuple(toks))
    want = set()
    for key, held in buckets.items():
        template = " ".join(t[0] if len(set(t)) == 1 else "<*>" for t in zip(*held))
        want.add((*key, template, len(held), len(set(held))))
    for hot_lines in (1, 3, 1000):
        got = [tuple(r) for r in drain.consensus(tokenized, hot_lines=hot_lines).collect()]
        assert len(got) == len(want) and set(got) == want
