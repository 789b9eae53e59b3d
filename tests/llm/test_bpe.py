import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracewell.llm import bpe
from tracewell.llm.vocab import _STABLE, splitter

TEXTS = [
    "", " ", "a", "Hello world's  end\n\n", "a<|endoftext|>b<|endoftext|>", "<|startoftext|> x", "aaaaaaa" * 200,
    "'s 'S don't I'LL", "x² ¹½ ª", "日本語テキスト 한국어 ΣΑΣ Ελλάς", "é Ᲊ ՘ \x1c\x1d", "💩💩 ok‍",
    "  x　y", "12345 67", "İstanbul ǅ", "re" * 5000,
]


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_ids_equal_the_library(name, kind):
    path = public_tokenizers.path(name)
    cut = splitter(path, kind)
    library = Tokenizer.from_file(path)
    every = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = TEXTS + ["".join(every[i : i + 97]) for i in range(0, len(every), 97)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for text, ids in zip(texts, want, strict=True):
        got = []
        for special, part in cut.merges.pieces(text):
            words = [] if special else cut.words(part)
            cut.merges.learn(set(words))
            got += [cut.merges.special[part]] if special else []
            got += [i for w in words for i in np.frombuffer(cut.merges.known[w], "<u4").tolist()]
        assert got == ids, text


def test_every_token_is_verified_as_the_library_builds_it():
    path = public_tokenizers.path("byte_bpe_50k.json")
    merges = splitter(path, "byte").merges
    assert merges.ordered
    for s, i in list(merges.proposals.items())[::37]:
        assert merges._exact(s) == [i]


def test_stable_characters_have_the_classes_of_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    cut = splitter(path, "byte")
    inside = re.compile(f"[{_STABLE}]")
    library = cut.library().pre_tokenizer
    for code in range(0x10000):
        if 0xD800 <= code < 0xE000 or not inside.match(chr(code)):
            continue
        if 0x4F00 < code < 0x9F00 or 0xAD00 < code < 0xD700:
            continue
        text = f"a{chr(code)} 1{chr(code)} !{chr(code)}\n"
        want = [cut.merges.plain_word(p) for p, _ in library.pre_tokenize_str(text)]
        assert cut.PATTERN.findall(text) == want, hex(code)


def test_round_trip_and_odd_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, None), (0, TEXTS[3], "x"), (0, TEXTS[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    out = bpe.decode(bpe.encode(docs)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.decoded == (r.text or "")
        assert r.text or not r.ids
    both = bpe.round_trip(docs).collect()
    assert [(r.coded.ids, r.coded.decoded) for r in both] == [(r.ids, r.decoded) for r in out]
    assert bpe.decode(bpe.encode(docs.limit(0))).collect() == []
