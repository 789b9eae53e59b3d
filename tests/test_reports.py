import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracewell.operators import cleaning, corpus, reports
from tracewell.sources import groups, jsonwalk, lines as lines_

EVENTS = "source_file string, event_id string, dup_id string, raw string, template string, seq long"


def events(spark, data):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(data)], EVENTS).repartition(3)


def order():
    return F.struct("seq")


@pytest.mark.parametrize(
    "noise_line,drop,keep",
    [("", [""], [""]), ("n1, n2", [], [""]), ("a, n1, a", ["a, a"], ["a, a"]), (" a ,b", ["a, b"], ["a, b"])],
)
def test_noise(spark, noise_line, drop, keep):
    df = spark.createDataFrame([(noise_line,)], "line string")
    assert [r.line for r in cleaning.remove_noise(df, ["n1", "n2"], True).collect()] == drop
    assert [r.line for r in cleaning.remove_noise(df, ["n1", "n2"], False).collect()] == keep


def test_multi_item(spark):
    df = spark.createDataFrame([("a",), ("a,,b",), (" , ",)], "line string")
    assert rows(cleaning.multi_item(df)) == [("a,,b",)]


def test_noise_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, "n"), (3, "a")], "pos long, template string")
    noise = spark.createDataFrame([("n",), ("n",)], "template string")
    assert rows(cleaning.remove_noise_table(df, noise), "pos") == [("a", 1), ("a", 3)]


def test_segments_concatenate_to_the_whole_line(spark):
    df = spark.createDataFrame([("g", i, i * i) for i in range(25)], "g string, pos long, v long").repartition(4)
    whole = cleaning.sequence_lines(df, ["g"], "pos", "v", " ").collect()
    parts = cleaning.sequence_lines(df, ["g"], "pos", "v", " ", segment=10).orderBy("seg").collect()
    assert len(parts) == 3 and "".join(p.line for p in parts) == whole[0].line


def test_part_numbers(spark):
    df = spark.range(1101).withColumnRenamed("id", "g")
    out = cleaning.assign_parts(df, ["g"])
    assert rows(out.groupBy("part_id").count()) == [(0, 500), (1, 500), (2, 101)]
    assert cleaning.cap_parts(out, 1).count() == 1000


def test_template_freq_breaks_ties_by_first_sight(spark):
    df = events(spark, [("f", "1", None, "", t) for t in ["b", "a", "b", "a", "", None, "c"]])
    assert [tuple(r) for r in reports.template_freq(df, order()).collect()] == [("b", 2), ("a", 2), ("c", 1)]


def test_files_with_all_and_any(spark):
    ids = [("one", x) for x in "xxyy"] + [("two", x) for x in "xxxy"] + [("three", "z")]
    df = events(spark, [(f, "e", d, "", "t") for f, d in ids])
    assert rows(reports.files_with_all_ids(df, ["x", "y"])) == [("one", 4)]
    assert rows(reports.files_with_any_id(df, "dup_id", ["y", "z", "q"])) == [
        ("one", "y", 2), ("three", "z", 1), ("two", "y", 1),
    ]


def test_keywords_count_an_event_once(spark):
    df = events(spark, [("f", "1", None, "", "Make ERRORS error"), ("g", "2", None, "", None)])
    assert rows(reports.keyword_counts(df)) == [("f", 1, 0, 0, 1), ("g", 0, 0, 0, 0)]


def test_lookup_keeps_order_duplicates_and_misses(spark):
    df = events(spark, [("f", "1", "x", "r", "first"), ("f", "2", "x", "r", "second"), ("f", "3", "w", "r", None)])
    asked = reports.request_list(spark, ["x", "y", "x", "w"], "dup_id")
    got = rows(reports.lookup(df, asked, "dup_id", order(), ["template"]), "pos")
    assert got == [(0, "x", "first"), (1, "y", "NOT FOUND"), (2, "x", "first"), (3, "w", None)]


def test_template_search_keeps_zero_rows(spark):
    df = events(spark, [("f", "1", None, "", " Disk Full"), ("g", "2", None, "", "disk full"), ("g", "3", None, "", "disk full")])
    asked = reports.request_list(spark, ["DISK FULL ", "absent"], "template")
    assert rows(reports.template_search(df, asked), "pos") == [(0, "DISK FULL ", 3, 2), (1, "absent", 0, 0)]
    assert rows(reports.template_search_files(df, asked)) == [("disk full", "f", 1), ("disk full", "g", 2)]


def test_top_ids(spark):
    df = events(spark, [("f", "1", d, f"r{i}", "t") for i, d in enumerate(["q", "p", "p", "", None, "q", "s"])])
    assert [tuple(r) for r in reports.top_ids(df, order(), 2).collect()] == [("q", 2, "r0", "t"), ("p", 2, "r1", "t")]


def test_next_template_is_a_distribution(spark):
    pairs = [("a", "b")] * 90 + [("a", "c")] * 9 + [("a", "d")] + [("b", "a")]
    df = spark.createDataFrame(pairs, "cur string, next string")
    got = {(r.cur, r.next): r.prob for r in reports.next_template(df, temperature=1.0).collect()}
    assert got == {("a", "b"): pytest.approx(90 / 99), ("a", "c"): pytest.approx(9 / 99), ("b", "a"): 1.0}
    assert reports.next_template(df, top_k=1).count() == 2


def test_kv_values(spark):
    data = ["key: 1, value: [a, value: b]", "x", "value:", "key value: [ ] ", "value: [open"]
    df = spark.createDataFrame(list(enumerate(data)), "line_no long, line string")
    got = [r.value for r in lines_.kv_values(df).orderBy("line_no").collect()]
    assert got == ["a, value: b", "None", "", "", "[open"]
    assert lines_.kv_values(df, head=2).count() == 2


def test_json_head_skips_malformed(spark):
    data = [(0, "{bad"), (1, '{"a":1}'), (2, "[1]"), (3, '{"b":2}'), (-1, '{"a":1} {"b":2}'), (-2, '{"a":1}, 2'), (-3, ""), (-4, None)]
    df = spark.createDataFrame(data, "line_no long, line string")
    assert rows(lines_.valid_json_head(df, 2).select("line_no")) == [(1,), (2,)]


def test_walk_any_depth_in_pre_order(spark):
    deep = {"template": "leaf"}
    for _ in range(12):
        deep = {"k": {"group": [deep]}, "template": "up"}
    doc = {"b": {"group": [{"template": "x\n", "z": {"group": [{"template": 3}, {"q": 1}, 7]}}, {"template": None}]}, "a": {"group": [deep]}}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "{bad"), (3, "7")], "id long, json string")
    got = [r.template for r in jsonwalk.walk_templates(df, ["id"], levels=3).orderBy("path").collect()]
    # the document has "b" before "a"
    assert got == ["x", "None", "3"] + ["up"] * 12 + ["leaf"]


def test_walk_keeps_document_order(spark):
    item = lambda t: {"group": [{"template": t}]}
    doc = {"z": item("1"), "a": [5, item("2"), {"y": item("3"), "b": {"ü": item("4"), "": item("5")}}], "m": '{"group":[{"template":"no"}]}',
           "\U0001F600": item("6"), "\uff5e": item("7"), "A": None, "B": item("8")}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps([doc], ensure_ascii=False))], "id long, json string")
    walked = jsonwalk.walk_templates(df, ["id"], levels=2)
    for i in (1, 2):
        assert [r.template for r in walked.filter(f"id = {i}").orderBy("path").collect()] == list("12345678")


def test_flat_records(spark):
    docs = [(0, '[{"dup_id":"a","template":"t"},5]'), (1, '{"dup_id":"b"}'), (2, "{bad")]
    df = spark.createDataFrame(docs, "id long, json string")
    assert rows(jsonwalk.flat_records(df, ["id"])) == [(0, 0, "a", "t"), (1, 0, "b", None)]


def test_part_files(spark, tmp_path):
    body = {"g1": {"metadata": "m", "group": [{"event_id": "1", "template": "t", "extra": 1}, {"event_id": "2"}]},
            "g2": {"metadata": None, "group": []}, "g3": {"metadata": "m"}}
    (tmp_path / "part_0.json").write_text(json.dumps(body, indent=2))
    (tmp_path / "part_10.json").write_text("{bad")
    (tmp_path / "part_x.json").write_text(json.dumps(body))
    (tmp_path / "notes.txt").write_text("no")
    docs = groups.read_parts(spark, str(tmp_path))
    assert rows(docs.select("source_file")) == [("part_0.json",), ("part_10.json",)]
    assert groups.read_parts(spark, str(tmp_path), strict=False).count() == 3
    assert rows(groups.quarantine(docs)) == [("part_10.json", "malformed JSON", "{bad")]
    valid = groups.valid_groups(groups.explode_groups(docs))
    assert rows(valid.select("group_key")) == [("g1",)]
    flat = groups.flatten_groups(groups.explode_groups(docs))
    assert rows(flat.select("group_key", "pos", "event_id", "template"), "pos") == [("g1", 0, "1", "t"), ("g1", 1, "2", None)]
    assert rows(flat.select("place", "group_key"), "pos") == [(0, "g1"), (0, "g1")]
    assert rows(groups.last_part(docs)) == [(10,)]
    assert rows(groups.last_part(docs.filter("false"))) == [(-1,)]


def test_documents_are_strict_and_templates_typed(spark):
    event = lambda t: {"event_id": 1, "template": t}
    body = {"z": {"metadata": "m", "group": [event("t"), event(["a", "b"]), event(5), event(["a", 5]), event(None), event([])]},
            "a": {"metadata": {"k": 1}, "group": [event(""), {"event_id": "2"}]}}
    text = json.dumps(body)
    docs = [text, text + " x", text + text, text + "," + text, "[]", "{}", "", "7", None, '{"g": {"group": [' ]
    df = spark.createDataFrame([(f"part_{i}.json", t) for i, t in enumerate(docs)], "source_file string, value string")
    bad = sorted(int(r.source_file[5:-5]) for r in groups.quarantine(df).collect())
    assert bad == [1, 2, 3, 4, 6, 7, 8, 9]
    flat = groups.flatten_groups(groups.explode_groups(df))
    got = [tuple(r) for r in flat.orderBy("place", "pos").select("place", "group_key", "pos", "template").collect()]
    assert got == [(0, "z", 0, "t"), (0, "z", 1, "ab"), (0, "z", 2, None), (0, "z", 3, None), (0, "z", 4, None), (0, "z", 5, ""),
                   (1, "a", 0, ""), (1, "a", 1, None)]


def test_text_lines_are_numbered_per_file(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n\n  two \nthree\n")
    (tmp_path / "b.log").write_text("x\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.log").write_text("y\n")
    below = [(s.rsplit("/", 1)[1], n, t) for s, n, t in rows(lines_.read_lines(spark, str(tmp_path / "sub")))]
    assert below == [("a.log", 0, "y")]
    assert len({r[0] for r in rows(lines_.read_lines(spark, [str(tmp_path), str(tmp_path / "sub")]))}) == 3
    got = [(s.rsplit("/", 1)[1], n, t) for s, n, t in rows(lines_.read_lines(spark, f"{tmp_path}/*.log"))]
    assert got == [("a.log", 0, "one"), ("a.log", 1, "two"), ("a.log", 2, "three"), ("b.log", 0, "x")]


def test_csv_with_unusual_separator(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 1), ("é", 2)], "template string, cnt long")
    df.write.option("header", True).option("sep", "¡").csv(str(tmp_path / "m"))
    back = spark.read.option("header", True).option("sep", "¡").schema("template string, cnt long").csv(str(tmp_path / "m"))
    assert rows(back) == [("a, b", 1), ("é", 2)]


def test_phrases_and_fraction(spark):
    df = spark.createDataFrame([(1, "a,, b ,"), (2, "c\nd"), (3, " ")], "id long, text string")
    assert rows(corpus.phrases(df, ["id"])) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (2, 1, "d")]
    assert rows(corpus.head_fraction(df, "id", 0.75)) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]
    assert corpus.head_fraction(df.filter("id = 2"), "id", 0.1).count() == 1
    with pytest.raises(ValueError):
        corpus.head_fraction(df, "id", 0.0)


def test_split_is_stable_and_near_its_share(spark):
    df = spark.range(5000)
    a = rows(corpus.hash_split(df, F.col("id").cast("string")))
    assert a == rows(corpus.hash_split(df.repartition(7), F.col("id").cast("string")))
    assert 0.08 < sum(s == "eval" for _, s in a) / 5000 < 0.12


def test_truncation_counts_all_tokens(spark):
    df = spark.createDataFrame([(" ".join("x" * 200),)], "t string")
    out = corpus.truncate_tokens(df, "t").first()
    assert (out.n_tokens, len(out.t.split())) == (200, 128)


def test_prepared_data_is_reused(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    key, path = F.concat_ws(":", "id", "t"), str(tmp_path / "c")
    assert corpus.write_if_changed(df, key, "v1", path)
    assert not corpus.write_if_changed(df.repartition(3), key, "v1", path)
    assert corpus.write_if_changed(df, key, "v2", path)
    assert corpus.write_if_changed(df.limit(1), key, "v2", path)


def test_long_orders_are_judged_whole(spark, tmp_path, monkeypatch):
    from tracewell.plans import ingest
    from tracewell.sources import tables

    brands = ["Brand#11", "Brand#23", "a", "b", "c"]
    spark.createDataFrame(list(enumerate(brands)), "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    orders = {1: [2, 0, 1, 0, 3, 4, 2], 2: [0, 1, 0, 1, 1], 3: [2], 4: [1], 5: [0, 0, 0, 0, 2, 3]}
    items = [(o, n, p, 0) for o, parts in orders.items() for n, p in enumerate(parts)]
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"
    spark.createDataFrame(items, columns).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    named = {o: [brands[p] for p in parts] for o, parts in orders.items()}
    clean = {o: [b for b in parts if b not in ingest.NOISE] for o, parts in named.items()}
    want = {
        "multi_item_groups": {o: ", ".join(parts) for o, parts in named.items() if len(parts) > 1},
        "noise_clean_drop": {o: ", ".join(parts) for o, parts in clean.items() if parts},
        "noise_clean_keep": {o: ", ".join(parts) for o, parts in clean.items()},
    }
    length = {"multi_item_groups": named, "noise_clean_drop": clean, "noise_clean_keep": clean}
    for hot, segment in ((1_000_000, 10_000), (2, 10_000), (2, 2)):
        monkeypatch.setattr(tables, "HOT_ITEMS", hot)
        monkeypatch.setattr(tables, "SEGMENT", segment)
        for name, lines in want.items():
            found = rows(ingest.QUERIES[name](spark, str(tmp_path)), "group_id", "seg")
            got = {}
            for order_id, _, line in found:
                got[order_id] = got.get(order_id, "") + line
            assert got == lines, (name, hot, segment)
            # segments of one length for every order
            segments = [(o, k) for o in lines for k in range(max(1, -(-len(length[name][o]) // segment)))]
            assert [r[:2] for r in found] == segments, (name, hot, segment)
