import re
from collections import Counter

import corpus_pipeline
from tokenizers import Tokenizer

from tracewell.llm import bpe
from tracewell.llm.common import table

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_every_stage_against_plain_python(spark, tmp_path):
    docs = table(spark, SF, "documents")
    kept = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe_encoding":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()

    good = Counter(kept["quality_rules"])
    assert not good - Counter(kept["documents"])
    for r in kept["quality_rules"]:
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) >= 50
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    names = {r.doc_id for r in kept["quality_rules"]}
    long_enough = {r.doc_id for r in kept["documents"] if len((r.text or "").split()) >= 50}
    lost = [d for d in long_enough - names if labels.get(d) == 1]
    assert len(lost) <= 0.05 * sum(labels.get(d) == 1 for d in long_enough)

    before, after = kept["quality_rules"], kept["near_duplicates"]
    assert not Counter(after) - Counter(before)
    sets = {i: shingles(r.text) for i, r in enumerate(before)}
    near = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    parent = list(range(len(before)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i in sets:
        for j in range(i):
            if near(sets[i], sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(before):
        groups.setdefault(find(i), []).append(r)
    least = {min(g, key=lambda r: r.doc_id).doc_id for g in groups.values()}
    assert sorted(r.doc_id for r in after) == sorted(least)

    clean = {r.doc_id: r for r in kept["personal_data"]}
    assert set(clean) == {r.doc_id for r in after}
    for r in after:
        found = re.search(
            r"@[A-Za-z0-9-]+\.[A-Za-z0-9]|\+[0-9][\x20().0-9-]{7,}[0-9]|(?:[0-9]{1,3}\.){3}[0-9]|[0-9](?:[\x20-]?[0-9]){15}",
            r.text,
        )
        assert found or clean[r.doc_id].text == r.text
        assert not re.search(r"@[A-Za-z0-9-]+\.[A-Za-z0-9]", clean[r.doc_id].text)
        assert clean[r.doc_id].n_chars == len(clean[r.doc_id].text)

    mixed = Counter(r.doc_id for r in kept["mixture"])
    assert max(mixed.values()) <= 2 and set(mixed) <= set(clean)
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)
    longest = max(words([r]) for r in clean.values())
    assert abs(words(kept["mixture"]) - 1.5 * words(clean.values())) <= longest * len({r.source for r in clean.values()})

    library = Tokenizer.from_file(bpe.BYTE_BPE)
    want = Counter((r.doc_id, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in kept["mixture"])
    import numpy as np

    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in kept["bpe_encoding"]) == want


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty, very long, tied and repeated rows, columns called like the operators'."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, base string, terms int, size int, copies string"
    prose = " ".join(f"word{i}" for i in range(60))
    longest = " ".join(f"w{i}" for i in range(30_000)) + " ann@mail.example.com"
    texts = [None, "", " \t", prose, prose, f"{prose} more", f"call +1 (743) 555-3824 {prose[::-1]}", longest]
    rows = [(i if i % 3 else None, t, None, "s" if i % 2 else None, None, "own", 7, i, "c") for i, t in enumerate(texts)]
    rows += [rows[4], (None,) * 9]
    docs = spark.createDataFrame(rows, schema)
    own = lambda df: sorted(map(str, df.select("base", "terms", "size", "copies").collect()))
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality_rules"](spark, docs, SF)
    assert good.columns == docs.columns and not Counter(good.collect()) - Counter(docs.collect())
    assert {r.text for r in good.collect()} <= {t for t in texts if t and len(t.split()) >= 50}
    one = stage["near_duplicates"](spark, docs, SF)
    assert Counter(r.text or "" for r in one.collect()) == Counter(["", " \t", prose, texts[6], longest])
    clean = stage["personal_data"](spark, docs, SF)
    assert clean.columns == docs.columns and own(clean) == own(docs)
    assert Counter(r.text for r in clean.collect())[None] == 2
    assert all("@" not in (r.text or "") and "555-3824" not in (r.text or "") for r in clean.collect())
    mixed = stage["mixture"](spark, docs, SF)
    assert mixed.columns == docs.columns and set(own(mixed)) <= set(own(docs)) and mixed.count() > 0
    coded = stage["bpe_encoding"](spark, docs, SF).collect()
    assert len(coded) == len(rows) and sum(r.n_tokens == 0 for r in coded) == 3
    for name, work in corpus_pipeline.STAGES:
        assert work(spark, docs.limit(0), SF).collect() == [], name
