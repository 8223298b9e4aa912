"""Normalisation over all code points, and what the filter reports against a full search."""

import random

from tidemark.llm import decontamination
from test_llm import distance_inside


def items_of(spark):
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    return bench, [(r.item_id, r.text) for r in bench.collect()]


def test_signs_between_words(spark):
    """Emoji and other signs beyond U+FFFF count as spaces, alone or among them, in either case."""
    bench, items = items_of(spark)
    ways = [lambda t: t.replace(" ", " \U0001f600 "), lambda t: t.replace(" ", "\U0001f600"), lambda t: t.upper().replace(" ", " \U0001f680️, "), lambda t: t.replace(" ", "\U000e0020")]
    rows = [(c * 10_000 + k, "clean words before it " + f(t) + " and after", i) for c, f in enumerate(ways) for k, (i, t) in enumerate(items)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
    for c in range(len(ways)):
        mine = [(k, i) for k, _, i in rows if k // 10_000 == c]
        assert sum(x in found for x in mine) == len(mine)
    assert decontamination.drop_leaks(docs, bench).count() == 0


def test_scripts_beyond_the_first_plane(spark):
    """An item in a cased script beyond U+FFFF is found in its other case."""
    low = "".join(chr(0x10428 + k) for k in range(30))
    text = " ".join(low[k : k + 7] for k in range(0, 24, 2))
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + text.upper() + " after"), (2, "nothing of it " + low[:4])], "doc_id long, text string")
    got = decontamination.leaks(docs, bench).collect()
    assert [(r.doc_id, r.start, r.end) for r in got] == [(1, 7, 7 + len(text))]


def test_normal_codes():
    codes, places = decontamination.normal_codes("Ab\U0001f600\U0001f600 \U00010400x—9")
    assert "".join(map(chr, codes)) == "ab \U00010428x 9"
    assert places.tolist() == [0, 1, 2, 5, 6, 7, 8]


def test_reports_only_what_a_full_search_finds(spark):
    """Texts of the items' own words in other orders, some with edited quotes: every report is within its budget somewhere."""
    _, items = items_of(spark)
    rng = random.Random(6)
    few = items[:6]
    words = [w for _, t in few for w in t.split(" ")]
    rows = []
    for k in range(16):
        text = " ".join(rng.choice(words) for _ in range(40))
        if k % 2:
            quote = few[k % 6][1]
            at = rng.randrange(max(1, len(quote) - 70))
            part = list(quote[at : at + 70])
            for j in rng.sample(range(len(part)), rng.choice([4, 9, 14])):
                part[j] = "x"
            text = text[:120] + " " + "".join(part) + " " + text[120:]
        rows.append((k, text))
    bench = spark.createDataFrame(few, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    plain = lambda t: decontamination._words(decontamination._trimmed(t))
    want = set()
    for i, item in few:
        codes = decontamination._trimmed(item)
        parts = [decontamination._words(codes[a : a + m]) for a, m in decontamination._segments(codes)]
        for k, text in rows:
            if any(distance_inside(p, plain(text)) <= decontamination.budget(len(p)) for p in parts):
                want.add((k, i))
    assert found <= want and found
    assert len(found) >= 0.9 * len(want)
