"""Vector codes and host rules against SQL, plain arithmetic and odd tables."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidemark.llm import common, host_rules, queries, vector_codes
from test_llm import empty_documents, odd_documents


def duck_rows(sf_dir, table, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return sorted((tuple(r[names.index(n)] for n in sorted(names)) for r in cur.fetchall()), key=repr)


def spark_rows(df):
    return sorted((tuple(r[n] for n in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name, table", [("op11_vector_codes", "embeddings"), ("op12_host_rules", "documents")])
def test_like_sql(spark, sf_dir, name, table):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == duck_rows(sf_dir, table, queries.ORACLE[name])


# 11 vector codes -----------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [3, 1 << 10, 1 << 24, 1 << 26])
def test_exact_products(size):
    rng = np.random.default_rng(size)
    x, y = rng.integers(-size, size + 1, (20, 48)), rng.integers(-size, size + 1, (30, 48))
    x[0], y[0] = size, -size
    assert vector_codes.exact_products(x, y).tolist() == [[sum(map(int.__mul__, a, b)) for b in y.tolist()] for a in x.tolist()]


def test_limbs_add_up():
    x = np.array([0, -1, 1, 5, -(2**40), 2**40 + 3, -(2**61), 2**61 - 1])
    for bits in (4, 11, 24):
        parts = vector_codes.limbs(x, bits)
        assert [sum(int(p[k]) << bits * i for i, p in enumerate(parts)) for k in range(len(x))] == x.tolist()
        assert all(np.abs(p).max() <= 1 << bits for p in parts)


def plain_codes(rows, rounds=4):
    """``rows`` of (id, vector, label) in id order, coded by plain integers."""
    xs = [[int(np.floor(1024 * c)) for c in v] for _, v, _ in rows]
    wide = len(xs[0]) // 4
    cut = lambda x, p: x[p * wide : (p + 1) * wide]
    books = [[cut(x, p) for x in xs[:256]] for p in range(4)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    find = lambda x, p: min((far(cut(x, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        books = [
            [[sum(col) // len(mine) for col in zip(*mine, strict=True)] if (mine := [cut(x, p) for x, (_, f) in zip(xs, found, strict=True) if f == e]) else c for e, c in enumerate(books[p])]
            for p, found in ((p, [find(x, p) for x in xs]) for p in range(4))
        ]
    found = [[find(x, p) for p in range(4)] for x in xs]
    errors = Counter()
    for (_, _, label), f in zip(rows, found, strict=True):
        errors[label] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), errors[label], digest) for (i, _, label), f in zip(rows, found, strict=True))


def test_codes_like_plain_integers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 8) * rng.choice([0.25, 7.5, 0.001])).tolist(), [None, 1, 2][i % 3]) for i in range(400)]
    rows += [(400 + i, rows[i][1], 1) for i in range(50)]  # equal vectors
    broken = [(500, None, 1), (501, [1.0] * 7 + [None], 1), (502, [1.0] * 7 + [float("nan")], 1), (503, [float("-inf")] * 8, None), (504, [], 1), (505, [1.0] * 4, 1)]
    df = spark.createDataFrame([(i, v, c, 0) for i, v, c in rows + broken], "vec_id long, embedding array<double>, label int, code int").repartition(5)
    got = sorted(tuple(r) for r in vector_codes.vector_codes(df).collect())
    assert got == plain_codes(rows)


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int, error string, id int, vec int"
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 2, "", 0, 0)], schema)).collect() == []
    twice = spark.createDataFrame([(7, [1.0, 2.0, 3.0, 4.0], None, "", 0, 0)] * 2 + [(None, [1.0, 2.0, 3.0, 5.0], 4, "", 0, 0)], schema)
    got = vector_codes.vector_codes(twice).collect()
    assert Counter((r.vec_id, r.error, r.label_error) for r in got) == {(7, 0, 0): 2, (None, 0, 0): 1}
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e9] * 4, 1, "", 0, 0)], schema)).collect()


def test_attached_beyond_the_bound(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "a")], "n int, k string")
    table = spark.createDataFrame([("a", 10), (None, 20), ("b", 30)], "k string, v int")
    for most in (0, 10):
        assert sorted((r.n, r.v) for r in common.attached(rows, table, ["k"], most).collect()) == [(1, 10), (2, 20), (3, 30), (4, 10)]


# 12 host rules -------------------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_like_plain_python(spark):
    docs = odd_documents(spark)
    more = ["a a a a", "a b c a b c", "a b a b a b", "x y z\nx y z\n\n \nx y z", "#$%&|<>* é𝔘\x85\xa0 z", "\x0b\x0c\r\t", "one two", "p q r s p q r t p q"]
    docs = docs.unionByName(spark.createDataFrame([(100 + i, t, None, "s", None, 0, 0, 0, 0) for i, t in enumerate(more)], docs.schema))
    want = Counter((r.doc_id, *plain_measures(r.text)) for r in docs.collect())
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in host_rules.rule_verdicts(docs).collect())
    assert got == want
    assert host_rules.rule_verdicts(empty_documents(spark)).collect() == []


def test_host_verdicts(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    noisy = " ".join(f"w{i} #" for i in range(60))  # enough words, too many symbols
    rows = [(f"https://Bad.example/p{i}", noisy if i % 10 else clean) for i in range(200)] + [(f"good{k}.example", clean) for k in range(20) for _ in range(50)] + [("tiny.example", noisy), (None, clean)]
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: r for r in host_rules.rule_verdicts(docs).collect()}
    assert not any(r.kept for r in got.values() if r.host == "bad.example")
    assert sum(r.host == "bad.example" for r in got.values()) == 200
    assert all(r.kept for r in got.values() if r.host != "bad.example")  # one noisy document doesn't condemn a small host
    table = {r.host: r for r in host_rules.host_verdicts(host_rules.failing(host_rules.measures(docs))).collect()}
    m = np.array([r.failures_symbols / r.docs for r in table.values()])
    weight = m.mean() * (1 - m.mean()) / m.var() - 1
    weight = min(host_rules.MOST_PRIOR, max(host_rules.LEAST_PRIOR, weight))
    assert table["tiny.example"].rate_symbols == pytest.approx((1 + m.mean() * weight) / (1 + weight))


def test_native_plan(spark, sf_dir):
    plan = host_rules.rule_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
