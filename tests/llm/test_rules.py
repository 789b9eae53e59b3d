import random
import re

from pyspark.sql import functions as F

from tracewell.llm import rules

TEXTS = [
    "", None, " \t\n", "one", "a b c a b c", "x x x x", "a\xa0b c", "A#*$%&|<>", "line\nline\n \nline\nother", "a b\na b\r\n",
    "p q r s p q r t u v p q r", "w " * 30_000, "é" * 100_000, "a b c d a b c d x a b c",
]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    marked = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_statistics_equal_brute_force(spark):
    random.seed(1)
    made = [" ".join(random.choices("abcd", k=random.randrange(60))) for _ in range(60)]
    rows = [(i, t, 5) for i, t in enumerate(TEXTS + made)] + [(None, "a a", 5), (0, "", 5), (0, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    out = rules.statistics(docs)
    assert out.columns.count("n_words") == 1
    got = sorted(map(repr, out.select("doc_id", *rules.BASE).collect()))
    want = [spark.createDataFrame([(i, *brute(t))], out.select("doc_id", *rules.BASE).schema).first() for i, t, _ in rows[:1]]
    assert repr(want[0]) in got
    values = {(r[0], *r[1:]) for r in out.select("doc_id", *rules.BASE).collect()}
    assert values == {(i, *brute(t)) for i, t, _ in rows}
    assert rules.judge(docs.limit(0), []).collect() == []


def test_learned_list_separates_held_out_rows(spark):
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(3000)]

    def text(bad):
        w = random.choices(vocabulary, k=80)
        if bad == 1:
            w = [x.upper() + "!!" for x in w]
        if bad == 2:
            w = [x + "###" for x in w]
        return " ".join(w)

    kinds = [random.choice([0, 0, 0, 1, 2]) for _ in range(2400)]
    docs = spark.createDataFrame([(i, text(k)) for i, k in enumerate(kinds)], "doc_id long, text string")
    half = [(i, int(k == 0)) for i, k in enumerate(kinds) if i < 1200] + [(None, 0), (5, None)]
    labels = spark.createDataFrame(half, "doc_id long, quality int")
    learned = rules.learn(rules.count(docs), labels)
    assert learned
    out = rules.judge(docs.where("doc_id >= 1200"), learned).select("doc_id", F.col("rejected_by").isNull()).collect()
    wrong = sum(kept != (kinds[i] == 0) for i, kept in out)
    assert wrong <= 12
    assert rules.learn(rules.count(docs), labels.limit(0)) == []
    assert rules.learn(rules.count(docs.limit(0)), labels) == []


def test_a_rare_kind_in_the_tail_is_learned_behind_an_imprecise_one(spark):
    random.seed(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(random.choices(letters, k=5)) for _ in range(3000)]

    def text(kind):
        w = random.choices(vocabulary, k=80)
        for i in random.sample(range(80), 5 if kind else 0):
            w[i] = {"marks": "a=b=c", "symbols": "#a#b#"}[kind]
        return " ".join(w)

    kinds = ["symbols" if i % 50 == 0 else "marks" if i % 3 == 0 else "" for i in range(3000)]
    docs = spark.createDataFrame([(i, text(k)) for i, k in enumerate(kinds)], "doc_id long, text string")
    # marks are bad in six cases of ten, the rare symbols always
    quality = [0 if k == "symbols" or (k == "marks" and random.random() < 0.6) else 1 for k in kinds]
    labels = spark.createDataFrame(list(enumerate(quality)), "doc_id long, quality int").where("doc_id < 2000")
    learned = rules.learn(rules.count(docs), labels)
    out = rules.judge(docs.where("doc_id >= 2000"), learned).select("doc_id", F.col("rejected_by").isNull()).collect()
    assert not [i for i, kept in out if kept and kinds[i] == "symbols"]
    assert sum(not kept for i, kept in out if kinds[i] == "") <= 6
