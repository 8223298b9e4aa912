"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from test_llm import empty_documents, odd_documents
from tidemark.llm import phrases, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(text, longest=5):
    out = Counter()
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        words = re.findall(r"[^\x20\x09]+", piece)
        out.update(" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    return out


def plain_collocations(rows, least, top):
    """``rows`` of (lang, text): the definition, phrase by phrase."""
    by = {}
    for lang, text in rows:
        by.setdefault("und" if lang is None else lang, Counter()).update(plain_counts(text))
    out = []
    for lang, f in by.items():
        n = sum(c for p, c in f.items() if " " not in p)
        cand = {p: c for p, c in f.items() if " " in p and c >= least}
        inside = lambda p, q: q != p and f" {p} " in f" {q} "
        scored = []
        for p, a in cand.items():
            if any(inside(p, q) and c >= a for q, c in cand.items()):
                continue
            w = p.split(" ")
            cuts = [(" ".join(w[:k]), " ".join(w[k:])) for k in range(1, len(w))]
            score, _, left, right = min((1000 * a * n // (f[x] * f[y]), k, f[x], f[y]) for k, (x, y) in enumerate(cuts))
            scored.append((-score, -a, p.encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def noisy(rng, words, vocabulary):
    return "".join(rng.choice(vocabulary) + rng.choice([" "] * 12 + ["  ", "\t", ". ", ", ", "\n", "; "]) for _ in range(words))


@pytest.mark.parametrize("most", [1 << 20, 90])
def test_like_plain_counting(spark, most):
    """Shards of 90 bytes cut most texts several times."""
    rng = random.Random(5)
    vocabulary = [*"aBcdE", "fé", "ŒÀ", "x\x85y", "z\x1cz", "\xa0"]
    rows = [(rng.choice(["en", None, "und", "fr"]), noisy(rng, rng.choice([0, 3, 40, 200]), vocabulary)) for _ in range(120)]
    rows += [("en", None), (None, ""), ("fr", "a " * 300), ("fr", "new york city " * 40), ("fr", "new york. " * 7)]
    docs = spark.createDataFrame([(k, lang, t, 0, 0) for k, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, n long, f long").repartition(3)
    for least, top in ((6, 2000), (20, 9)):
        got = sorted(tuple(r) for r in phrases.collocations(docs, least, top=top, shard_bytes=most).collect())
        assert got == plain_collocations(rows, least, top)
        assert got


def test_like_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.execute(queries.ORACLE["op13_phrases"]).fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES["op13_phrases"](spark, sf_dir).collect()) == want
    assert want


def test_odd_tables(spark):
    assert phrases.collocations(empty_documents(spark)).collect() == []
    docs = odd_documents(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=2).collect())
    assert got == plain_collocations(rows, 2, 2000)


def test_extensions_in_step():
    """Intervals of both directions against the ids themselves, after extensions to either side."""
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 5, 400)
    ids[0] = ids[-1] = 0
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
    ids = ids[keep]
    shard = phrases.Shard("en", ids.astype(np.int32), np.ones(len(ids), np.int8), [b"a", b"b", b"c", b"d"], np.arange(5, dtype=np.uint64))
    index = phrases.BiIndex(shard, 5)
    text = ids.tolist()
    turned = text[::-1]
    now = index.words()
    for n in range(2, 6):
        now = (index.left if n % 2 else index.right)(now)  # from either side
        assert now.length == n
        seen = set()
        for k in range(len(now.low)):
            at = index.forth.order[now.low[k] : now.low[k] + now.size[k]].tolist()
            phrase = text[at[0] : at[0] + n]
            assert sorted(at) == [i for i in range(len(text)) if text[i : i + n] == phrase] and 0 not in phrase
            back = index.back.order[now.mirror[k] : now.mirror[k] + now.size[k]].tolist()
            assert sorted(back) == [i for i in range(len(text)) if turned[i : i + n] == phrase[::-1]]
            seen.add(tuple(phrase))
        assert seen == {tuple(text[i : i + n]) for i in range(len(text) - n + 1) if 0 not in text[i : i + n]}


def test_stretches_add_up():
    rng = random.Random(9)
    for most in (1, 7, 30, 200):
        text = noisy(rng, 150, ["a", "bb", "c", "d" * 40])
        total = Counter()
        for blob, weight in phrases.stretches(text.encode().translate(phrases.FOLD), most):
            for p, c in plain_counts(blob.decode().replace("\n", ".")).items():
                total[p] += weight * c
        assert {p: c for p, c in total.items() if c} == dict(plain_counts(text))


def test_hashes_like_the_engine(spark):
    words = ["a", "é", "longer word of more than thirty-two bytes", ""]
    rows = spark.createDataFrame([("en", w) for w in words], "lang string, word string").select(F.xxhash64("lang", "word").alias("h")).collect()
    assert [r.h for r in rows] == phrases.hashed_words("en", [w.encode() for w in words])[1:].view(np.int64).tolist()


def test_full_table_only_lets_more_through(spark, monkeypatch):
    rng = random.Random(1)
    rows = [("en", noisy(rng, 300, [f"w{k}" for k in range(30)])) for _ in range(20)]
    docs = spark.createDataFrame([(k, lang, t) for k, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string")
    monkeypatch.setattr(phrases.BitTable, "has", lambda self, hashes: np.ones(len(hashes), bool))
    index = phrases.BiIndex(phrases.shard_of("en", [(t.encode().translate(phrases.FOLD), 1) for _, t in rows]), 5)
    total = Counter()
    for _, t in rows:
        total.update(plain_counts(t))
    found = {p: c for x in phrases.phrases(index, 5, {}) for p, c in zip(index.texts(x), index.counts(x).tolist(), strict=True)}
    assert found == {p: c for p, c in total.items() if " " in p}
    assert docs.count() == 20


def test_extensions_are_sums_across_shards(spark):
    rng = random.Random(4)
    rows = [("en", noisy(rng, 200, [*"abcde"])) for _ in range(12)]
    docs = spark.createDataFrame([(k, lang, t) for k, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string").repartition(3)
    total = Counter()
    for _, t in rows:
        total.update(plain_counts(t))
    _, words, found = phrases.frequent_phrases(docs, 5, shard_bytes=300)
    named = phrases.with_texts(found.join(phrases.extensions(found), "words", "left"), words).collect()
    assert {r.phrase: r.f for r in named} == {p: c for p, c in total.items() if c >= 5}
    for r in named:
        longest = lambda side: max((c for p, c in total.items() if len(p.split(" ")) == len(r.words) + 1 and side(p) == r.phrase and c >= 5), default=None)  # noqa: B023, E731
        assert (r.left_most, r.right_most) == (longest(lambda p: p.split(" ", 1)[-1]), longest(lambda p: p.rsplit(" ", 1)[0])), r.phrase
