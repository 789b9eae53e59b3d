import random
from decimal import Decimal

import pytest
from conftest import rows

from tracewell.operators import graph, matrix, reports, windows
from tracewell.plans import discovery
from tracewell.sources import groups, sinks


def test_windowed_dataset_counts_every_window(lines):
    rng = random.Random(6)
    texts = [[rng.choice("aabbcz") for _ in range(60)], [rng.choice("ab") for _ in range(25)]]
    data = discovery.windowed_dataset(lines(*texts), min_freq=5)
    kept = [[t for t in x if x.count(t) >= 5] for x in texts]
    sizes = [max(2, min(30, len(k) - 5 * len(set(k)) + 1)) for k in kept]
    assert data.samples.agg({"weight": "sum"}).first()[0] == sum(len(k) - w + 1 for k, w in zip(kept, sizes))
    assert [r.name for r in data.templates.orderBy("v").collect()] == sorted({t for k in kept for t in k})
    assert [r.window_size for r in data.quality.orderBy("source").collect()] == sizes
    with pytest.raises(ValueError):
        discovery.windowed_dataset(lines(list("abc")))


def test_pc_from_log(lines):
    rng = random.Random(7)
    t = []
    for _ in range(400):
        t += ["cause", "effect", "rest"] if rng.random() < 0.3 else [rng.choice(["n1", "n2", "n3"])] * 2
    edges, report, best = discovery.pc_from_log(lines(t), window_size=2)
    linked = {tuple(sorted((e.source, e.target))) for e in edges.collect()}
    assert ("cause", "effect") in linked
    assert report.first().n_variables == 6 and best.count() > 0


def test_pc_from_baskets(spark):
    rng = random.Random(8)
    data = []
    for i in range(600):
        a, c = rng.random() < 0.5, rng.random() < 0.5
        data.append((i, ", ".join(["always"] + ["a", "b"] * a + ["c"] * c)))
    edges, table = discovery.pc_from_baskets(spark.createDataFrame(data, "id long, line string"), "id")
    assert {(e.source, e.target) for e in edges.collect()} == {("a", "b"), ("b", "a")}
    assert rows(table)[0] == ("a", "NA", "NA")


def test_bins_as_samples(lines):
    rng = random.Random(9)
    t = []
    for _ in range(300):
        t += ["x", "y", "n"] if rng.random() < 0.5 else ["n", "n", "m"]
    binned = windows.bins_open(lines(t), 3)
    samples = discovery.bin_samples(binned, matrix.variables(binned, "template"))
    assert sorted(map(list, (r["items"] for r in samples.collect()))) == [[(0, 1), (1, 2)], [(1, 1), (2, 1), (3, 1)]]
    pair = matrix.listed_variables(samples.sparkSession, ["x", "y"])
    assert {r.test: r.edges for r in discovery.compare_on_bins(binned, pair).collect()} == {"chi2": 1, "gsq": 1}


def test_granger_from_log(lines):
    edges, report = discovery.granger_from_log(lines(["a", "b", "c"] * 40))
    assert report.first().n_variables == 3 and report.first().n_relations == edges.count() > 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, Decimal("1.5"), [f"é{i}"]) for i in range(7)], "g long, d decimal(5,2), t array<string>")
    sinks.write_parts(df, str(tmp_path / "parts"), ["g"], size=3)
    back = spark.read.json(str(tmp_path / "parts"))
    assert rows(back.groupBy("part_id").count()) == [(0, 3), (1, 3), (2, 1)]
    assert dict(back.dtypes)["d"] == "double" and rows(back.select("g", "t"))[1] == (1, ["é1"])
    sinks.write_csv(df.select("t", "g"), str(tmp_path / "csv"), sep="¡")
    assert rows(sinks.read_csv(spark, str(tmp_path / "csv"), "t string, g long", sep="¡"))[0] == ("é0", 0)
    lined = spark.createDataFrame([(2, "b"), (1, ""), (3, "c")], "g long, line string")
    sinks.write_lines(lined, str(tmp_path / "text"), ["g"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "text")).collect()) == ["", "b", "c"]
    sinks.write_dictionary(spark.createDataFrame([(0, "x")], "template_id long, template string"), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first().template == "x"


def test_group_parts_can_be_read_back(spark, tmp_path):
    event = "array<struct<event_id:string,template:string>>"
    data = [(i, f'k"{i}', None if i == 3 else f"m{i}", [(str(j), f"t\n{j}") for j in range(i % 4)]) for i in range(11)]
    given = spark.createDataFrame(data, f"n int, group_key string, metadata string, group {event}")
    sinks.write_group_parts(given, str(tmp_path / "parts"), ["n"], size=4)
    docs = groups.read_parts(spark, str(tmp_path / "parts"))
    assert rows(docs.select("source_file")) == [(f"part_{i}.json",) for i in range(3)]
    assert groups.quarantine(docs).count() == 0
    back = groups.explode_groups(docs).orderBy("source_file", "place").collect()
    assert [(r.group_key, r.metadata) for r in back] == [(k, m) for _, k, m, _ in data]
    assert [[(e.event_id, e.template) for e in r.group] for r in back] == [g for *_, g in data]


def test_report_is_written_in_order(spark, tmp_path):
    events = [(f"part_{f}.json", i) for f, n in ((0, 2), (1, 3), (2, 1)) for i in ("x", "y") for _ in range(n)]
    df = spark.createDataFrame(events, "source_file string, dup_id string")
    sinks.write_report(reports.matching_report(df, ["y", "x", "y"]), str(tmp_path / "r"))
    text = [r.value for r in spark.read.text(str(tmp_path / "r")).coalesce(1).collect()]
    title = "Files by total occurrences of the ids"
    assert text == [title, "File: part_1.json - total 6", "  y: 3", "  x: 3", "File: part_0.json - total 4", "  y: 2", "  x: 2"]
    assert [r.line for r in reports.matching_report(df, ["x", "z"]).collect()] == ["No file holds every id at least 2 times"]


def test_matrix_and_edge_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a b,c.d\n1,0\n1,0\n0,1\n")
    patterns, names = sinks.read_binary_matrix(spark, str(tmp_path / "m.csv"))
    assert rows(names, "v") == [(0, "a b"), (1, "c.d")] and rows(patterns, "weight") == [([(1, 1)], 1), ([(0, 1)], 2)]
    (tmp_path / "e.csv").write_text("source,target,relation\na,b,directed\nb,c,undirected\nc,b,undirected\n")
    edges = sinks.read_csv(spark, str(tmp_path / "e.csv"), "source string, target string, relation string")
    assert rows(graph.edge_report(edges)) == [(3, 1, 0, 2)]


def test_long_groups_give_the_same_rows_whatever_the_segment(spark, monkeypatch):
    from tracewell.plans import ingest
    from tracewell.sources import tables

    sf = "/root/testdata/sf0.001"
    names = ["src_groups", "src_quarantine", "valid_groups", "events_flat", "json_path_templates"]
    whole = {n: sorted(map(repr, ingest.QUERIES[n](spark, sf).collect())) for n in names}
    monkeypatch.setattr(tables, "SEGMENT", 2)
    for n in names:
        assert sorted(map(repr, ingest.QUERIES[n](spark, sf).collect())) == whole[n], n


def test_segments_concatenate_to_the_line(spark, tmp_path):
    from tracewell.operators import cleaning

    events = spark.createDataFrame([("g", i, str(i)) for i in range(5)] + [("h", 0, "9")], "g string, pos long, v string")
    lined = cleaning.sequence_lines(events, ["g"], "pos", "v", " ", segment=2)
    assert rows(lined) == [("g", 0, "0 1"), ("g", 1, " 2 3"), ("g", 2, " 4"), ("h", 0, "9")]
    sinks.write_lines(lined, str(tmp_path / "text"), ["g", "seg"])
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["0 1 2 3 4", "9"]


def test_events_with_a_missing_template_are_encoded(spark):
    from tracewell.operators import cleaning

    events = spark.createDataFrame([(0, "a"), (1, None), (2, "a")], "pos long, template string")
    dictionary = spark.createDataFrame([("a", 0), (None, 1)], "template string, template_id long")
    assert sorted(r.template_id for r in cleaning.encode(events, dictionary).collect()) == [0, 0, 1]
    lacking = dictionary.where("template = 'a'")
    with pytest.raises(Exception, match="no dictionary id"):
        cleaning.encode(events, lacking).collect()


def test_no_samples_give_no_graph(spark):
    from tracewell.operators import pc

    samples = spark.createDataFrame([], "items array<struct<v:int,c:int>>, weight long")
    with pytest.raises(ValueError, match="no samples"):
        pc.discover(samples, matrix.listed_variables(spark, ["a", "b"]), "chi2")
