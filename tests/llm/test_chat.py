from collections import defaultdict

from pyspark.sql import functions as F

from tracewell.llm import chat

TEXTS = [
    "", None, "hello", "</s>[INST] ok [/INST]", "a\\b", "\\", "\\\\", "[\\INST]", "<\\/s>", " [/INST]", "[INST", "]",
    "<<SYS>>x<</SYS>>", "[TURN] a [AS] b [/TURN]", "line\nbreak", "<", "[", "$1 \\1", "é" * 5000, "[[INST]] <<s>>",
]


def test_turns_are_read_back_and_states_follow(spark):
    rows = []
    for i, t in enumerate(TEXTS):
        rows += [(i, 0, "user", t), (i, 1, "assistant", t), (i, 2, "user", t), (i, 3, "assistant", "end")]
        rows += [(100 + i, 0, "assistant", t), (100 + i, None, None, t), (100 + i, 0, "tool[AS]", t)]
    rows += [(None, 0, "system", "x"), (None, 0, "system", "x"), (300, 0, "system", "s"), (300, 1, "user", "u"), (300, 2, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = turns.withColumn("turns", F.lit("clash")).withColumn("formatted", F.lit(1))
    out = chat.format_chats(turns.repartition(3))
    out = out.select("*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss"))
    want = defaultdict(list)
    for c, n, r, t in rows:
        want[c].append((n is not None, n or 0, r or "", t or ""))
    got = {r.conv_id: r for r in out.collect()}
    assert set(got) == set(want)
    for c, turns_of in want.items():
        turns_of.sort()
        assert [tuple(t) for t in got[c].back] == [t[2:] for t in turns_of], c
        assert got[c].loss == "".join(t[3] for t in turns_of if t[2] == "assistant")
        assert got[c].valid == (c is not None and (c < 100 or c == 300))
        assert got[c].formatted == "".join(s.text for s in got[c].segments)
    assert chat.format_chats(turns.limit(0)).collect() == []
