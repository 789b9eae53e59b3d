import json
import random

from conftest import rows
from pyspark.sql import functions as F

from tracewell.operators import adaptive, drain
from tracewell.streaming import ingest, stateful


def write_part(path, n, templates):
    body = {f"g{n}": {"metadata": "m", "group": [{"event_id": f"{n}-{i}", "template": t} for i, t in enumerate(templates)]}}
    (path / f"part_{n}.json").write_text(json.dumps(body))


def test_ingest_resumes_and_keeps_ids(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    write_part(src, 0, ["b", "a"])
    write_part(src, 1, ["a", "c"])
    ingest.ingest_parts(spark, str(src), out).awaitTermination()
    first = rows(spark.read.parquet(f"{out}/dictionary").select("template_id", "template"))
    assert first == [(0, "b"), (1, "a"), (2, "c")]
    write_part(src, 2, ["z", "a"])
    (src / "part_3.json").write_text("{bad")
    ingest.ingest_parts(spark, str(src), out).awaitTermination()
    assert rows(spark.read.parquet(f"{out}/dictionary").select("template_id", "template")) == [*first, (3, "z")]
    events = spark.read.parquet(f"{out}/events")
    assert rows(events.select("event_id")) == [(f"{n}-{i}",) for n in range(3) for i in range(2)]
    bad = spark.read.parquet(f"{out}/quarantine")
    assert rows(bad.select("source_file", "reason", "value")) == [("part_3.json", "malformed JSON", "{bad")]
    sequences = spark.read.parquet(f"{out}/sequences").select("source_file", "group_key", "seg", "line")
    assert rows(sequences) == [("part_0.json", "g0", 0, "0 1"), ("part_1.json", "g1", 0, "1 2"), ("part_2.json", "g2", 0, "3 1")]


def test_ingest_numbers_groups_in_document_order(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    group = lambda *t: {"metadata": "m", "group": [{"template": x} for x in t]}
    (src / "part_0.json").write_text(json.dumps({"z": group("late", ["a", "b"]), "a": group("early", 5, "late")}))
    ingest.ingest_parts(spark, str(src), out).awaitTermination()
    assert rows(spark.read.parquet(f"{out}/dictionary").select("template_id", "template")) == [(0, "late"), (1, "ab"), (2, "early")]
    assert rows(spark.read.parquet(f"{out}/sequences").select("place", "group_key", "line")) == [(0, "z", "0 1"), (1, "a", "2 0")]
    # a repeated batch replaces its earlier attempt
    ingest.ingest_parts(spark, str(src), out).awaitTermination()
    assert spark.read.parquet(f"{out}/sequences").count() == 2


def feed(spark, tmp_path, df, step):
    """The rows of a series as a stream of ordered files."""
    path = str(tmp_path / "feed")
    n = df.agg(F.max("line_no")).first()[0] + 1
    for start in range(0, n, step):
        part = df.filter((F.col("line_no") >= start) & (F.col("line_no") < start + step))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark, stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode)
    q.option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_running_counts_equal_the_batch(spark, lines, tmp_path):
    df = lines(list("abacab"), list("cc"))
    got = drained(spark, ingest.running_counts(feed(spark, tmp_path, df, 2)), tmp_path, "counts", "complete")
    assert rows(got) == [("a", 3), ("b", 2), ("c", 3)]


def test_online_mining_equals_the_batch(spark, lines, tmp_path):
    stateful.use_rocksdb(spark)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc1") if rng.random() < 0.5 else "xyzuv"[j] for j in range(rng.choice([1, 3, 5]))) for _ in range(90)]
    df = lines(texts)
    got = drained(spark, stateful.mine_stream(feed(spark, tmp_path, df, 30)), tmp_path, "mined")
    final = got.groupBy("n_tokens", "cluster").agg(F.max_by("template", "line_no").alias("final"))
    final = final.toDF("n_tokens", "cluster", "final")
    shown = got.join(final, ["n_tokens", "cluster"], "left").select("line_no", F.coalesce("final", "template"))
    online = rows(shown)
    batch = rows(drain.mine_templates(df).select("line_no", "template"))
    assert online == batch


def test_stream_bins_equal_the_batch(spark, lines, tmp_path):
    stateful.use_rocksdb(spark)
    rng = random.Random(5)
    df = lines([rng.choice("abcdef") for _ in range(50)], list("abcabc"))
    got = drained(spark, stateful.bins_stream(feed(spark, tmp_path, df, 20), 3), tmp_path, "bins")
    want = adaptive.bins_adaptive(df, 3)
    key = ["source", "line_no", "bin"]
    assert rows(got.select(*key)) == rows(want.select(*key))
