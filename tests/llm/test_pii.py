import math
import random
import re

from pyspark.sql import functions as F

from tracewell.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, value):
    digits = [int(c) for c in value if c.isdigit() and c.isascii()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        twice = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if good(k, m[0])] for k, p in PATTERNS.items()}


TEXTS = [
    "", None, "a@b.c_d@e.f", "x@y..z", "é💩 me@mail.example.com, you@m.de.", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.01",
    "4465758382889437", "4465 7583-8288 9437!", "4465758382889437 4465758382889437", "+1 (743) 555-3824 +49", "+1 2 ((((",
    "a" * 50_000, "a." * 30_000 + "@", "1" * 60_000, "1.2.3." * 9_000, "x@y" + ".z" * 20_000, "+1 (555) 010-9999 " * 700,
]


def test_base_spans_equal_the_patterns(spark):
    random.seed(3)
    made = ["".join(random.choices("a.@1+- 23(é\n", k=random.randrange(80))) for _ in range(400)]
    made += ["".join(random.choices("0123456789 -", k=19)) for _ in range(200)]
    rows = list(enumerate(TEXTS + made)) + [(None, "q@w.e"), (0, ""), (0, "")]
    out = pii.find_base(spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1))).collect()
    assert len(out) == len(rows)
    for r in out:
        want = brute(r.text)
        assert {k: [(s.start, s.end) for s in r.base[k]] for k in PATTERNS} == want, r.text
        for k in PATTERNS:
            assert all(r.text[s.start : s.end] == s.value for s in r.base[k])


def test_revealing_terms_are_marked_and_replaced(spark):
    random.seed(4)
    common = [f"wort{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    line = lambda: " ".join(random.choices(common, k=12))
    rows = [(i, "\n".join(line() for _ in range(4))) for i in range(300)]
    for i in range(300, 305):
        rows.append((i, f"{line()}\n{line()} Zebulon wrote from zeb.1@mail.example.com {line()}\n{line()}"))
    rows[-5] = (300, rows[-5][1] + "\nAgain Zebulon.")
    rows += [(i, f"they wrote from {line()}\nonly here today {line()}") for i in range(310, 340)]
    # copies of one line prove nothing about its rare word
    rows += [(i, f"{line()}\nonly Quixotry here 10.1.2.3 today") for i in range(305, 309)]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string").withColumn("terms", F.lit(0))
    marked = pii.mark(docs)
    out = {r.doc_id: r for r in marked.collect()}
    assert len(out) == len(rows) + 1
    for i, r in out.items():
        words = {s.value for s in r.terms}
        assert words == ({"Zebulon"} if i and 300 <= i < 305 else set()), (i, words)
    texts = {r.doc_id: r.text for r in pii.sanitise(marked).collect()}
    assert all(texts[i] == t for i, t in rows if i < 300)
    assert "Again [TERM]." in texts[300] and "from [EMAIL] " in texts[300] and "Zeb" not in texts[300]
    assert "here [IP] today" in texts[306] and texts[None] is None
    assert pii.mark(docs.limit(0)).collect() == []


def test_revealing_terms_go_from_documents_without_the_entity(spark):
    random.seed(7)
    common = [f"wort{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    line = lambda: " ".join(random.choices(common, k=12))
    rows = [(i, "\n".join(line() for _ in range(4))) for i in range(400)]
    rows += [(i, f"{line()} Zebulon Ng K7 wrote from zeb.1@mail.example.com {line()}") for i in range(400, 404)]
    rows += [(404, f"{line()} ZEBULON came {line()}"), (405, f"{line()} Ng and K7 {line()}"), (406, "Zebulons K77 Ngo")]
    rows += [(i, f"they wrote from {line()} and came {line()}") for i in range(410, 440)]
    marked = pii.mark(spark.createDataFrame([*rows, (None, None)], "doc_id long, text string"))
    words = {r.doc_id: {s.value for s in r.terms} for r in marked.collect()}
    assert len(words) == len(rows) + 1
    want = dict.fromkeys(range(400, 404), {"Zebulon", "Ng", "K7"}) | {404: {"ZEBULON"}, 405: {"Ng", "K7"}}
    assert {i: w for i, w in words.items() if w} == want
    texts = {r.doc_id: r.text for r in pii.sanitise(marked).collect()}
    assert "[TERM] came" in texts[404] and "[TERM] and [TERM]" in texts[405] and texts[406] == "Zebulons K77 Ngo"


TERM = re.compile(r"[^\W_]{2,}")
WORDS = re.compile("|".join([*(PATTERNS[k].replace("(", "(?:").replace("\\+(?:", "\\+(") if k != "phone" else PATTERNS[k]
                               for k in ("email", "phone", "ip", "card")), r"\n", TERM.pattern]))


def brute_terms(texts, window=24, bound=0.4, bits=4.0):
    """The disclosure rule by its definition: loops over entities, words and lines."""
    near, holders = {}, {}
    for d, text in enumerate(texts):
        words, line = [], 0
        for m in WORDS.finditer(text):
            if m[0] == "\n":
                line += 1
            else:
                kinds = [k for k in PATTERNS if re.fullmatch(PATTERNS[k], m[0]) and good(k, m[0])]
                words.append((m[0], line, f"{kinds[0]}:{m[0]}" if kinds else None))
        lines = text.split("\n")
        for i, (_, _, entity) in enumerate(words):
            if entity:
                holders.setdefault(entity, set()).add(d)
                for w, at, other in words[max(0, i - window - 1) : i + window + 2]:
                    if not other and TERM.fullmatch(w):
                        near.setdefault((entity, w.lower()), set()).add((d, at, lines[at]))
    holding = {}
    for d, text in enumerate(texts):
        for n, line in enumerate(text.split("\n")):
            for w in set(TERM.findall(line.lower())):
                holding.setdefault(w, set()).add((d, n))
    out = set()
    for (entity, term), places in near.items():
        k, miss = len({x for _, _, x in places}), max(0, len(holding[term]) - len(places))
        n, z = k + miss, 1.645
        low = (k / n + z * z / (2 * n) - z * (k * miss / n**3 + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
        share = len(holders[entity]) / len(texts)
        if low >= bound and math.log2(low / share) >= bits:
            out.add((entity, term))
    return out


def test_disclosure_equals_brute_force(spark):
    random.seed(12)
    common = [f"wort{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    line = lambda n=9: " ".join(random.choices(common, k=n))
    texts = ["\n".join(line() for _ in range(random.randrange(1, 5))) for _ in range(350)]
    people = [("Odalys Vexler", "ody@mail.example.com"), ("Bram Quist", "+49 (743) 555-3824"), ("Ilse Maar", "10.20.30.40")]
    for k, (name, value) in enumerate(people):
        for i in range(3 + k):
            texts.append(f"{line()}\n{line(3)} {name}\n{line(random.randrange(1, 12))}\n{line(4)}: {value} {line()}")
    texts += [f"Vexler alone {line()}", f"{line()} Quist\n\n{line()}", "", "ody@mail.example.com"]
    texts += [f"everywhere {line()} all@mail.example.com Footerword {line()}" for _ in range(60)]
    got = {tuple(r) for r in pii.disclosing_terms(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == brute_terms(texts)
    assert {t for _, t in got} >= {"odalys", "bram"} and "footerword" not in {t for _, t in got}
