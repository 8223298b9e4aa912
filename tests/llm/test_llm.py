"""Training-data operators against brute force, round trips and held-out rows."""

import hashlib
import itertools
import random
import re
import tempfile
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, decontamination, jaccard_join, media, mixing, packing, pii, quality, token_counts, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n long, token long, comp long"


def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    base = " ".join(f"word{i}" for i in range(60))
    near = base.replace("word7 ", "other ")
    texts = [
        (1, None), (2, ""), (3, "  \n\t "), (4, base), (5, base), (6, near), (7, "a b c"), (8, "A  B\nC"), (9, "x " * 40_000), (None, base),
        (10, "unrelated text of some other words that nobody has " * 3), (4, base), (11, "idiot"), (12, "z" * 50_000),
        (13, "<|endoftext|> a<|endoftext|>"), (14, "mail a.b@c.de or 1.2.3.4 or +1 (555) 555-0100 or 4111 1111 1111 1111"),
    ]
    rows = [(i, t, None if k % 3 else "en", [None, "a", "b"][k % 3], None, k, k, k, k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# 1 quality -----------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.col("doc_id") % 4 == 0
    model = quality.train(docs, labels.where(~held))
    graded = docs.join(labels.where(held), "doc_id").select("quality", "toxic", quality.scorer(docs, model)("text")["p_tail"].alias("p")).toPandas()
    good = graded[(graded.quality == 1) & (graded.toxic == 0)]
    bad = graded[(graded.quality == 0) | (graded.toxic == 1)]
    assert (good.p >= quality.KEEP_TAIL).mean() > 0.95
    assert (bad.p >= quality.KEEP_TAIL).mean() < 0.35
    assert model.thresholds[0] < model.thresholds[1]


def test_quality_gradient_like_finite_differences():
    rng = np.random.default_rng(7)
    row, col, shapes = np.repeat(np.arange(30), 3), rng.integers(0, 6, 90), rng.random((30, 4))
    grades, params = rng.integers(0, 3, 30), [rng.normal(size=6), rng.normal(size=4), np.array([-0.4, 0.7])]
    _, grads = quality.likelihood(params, row, col, shapes, grades, 1e-2)
    for p, g in zip(params, grads, strict=True):
        for k in range(len(p)):
            p[k] += 1e-6
            up = quality.likelihood(params, row, col, shapes, grades, 1e-2)[0]
            p[k] -= 2e-6
            down = quality.likelihood(params, row, col, shapes, grades, 1e-2)[0]
            p[k] += 1e-6
            assert abs((up - down) / 2e-6 - g[k]) < 1e-5


def test_quality_tails_like_plain_arithmetic(spark, sf_dir):
    """Grades of every document against the model's formula over plain loops."""
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), least_z=2.0, least_lift=2.0)
    assert model.weights is not None and (model.weights != 0).any()
    got = docs.select("text", quality.scorer(docs, model)("text").alias("g")).collect()
    for r in got:
        words = {w.lower() for w in (r.text or "").split()}
        used = {b for w in words for b in quality.buckets_of(w)}
        score = sum(float(model.weights[b]) for b in used) + float(np.dot(model.shape, quality.features_of(r.text)[1]))
        tails = [1 / (1 + np.exp(-(score - t))) for t in model.thresholds]
        assert abs(sum(tails) - r.g.expected_grade) < 1e-3 and abs(tails[-1] - r.g.p_tail) < 1e-3


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (11, 1, 1), (10, None, 0), (None, 1, 0), (12, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    docs = odd_documents(spark)
    assert quality.classify(docs, labels).count() == docs.count()
    assert quality.classify(empty_documents(spark), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert quality.keep_good(docs, labels).columns == docs.columns


# 2 tokens ------------------------------------------------------------------------------------------


def test_token_counts_like_the_library(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (documents(spark, sf_dir), odd_documents(spark)):
        got = token_counts.count_tokens(docs, "byte_bpe_50k.json").toPandas()
        want = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for (t,) in docs.select("text").collect())
        assert sorted(zip(got.n_bytes, got.n_tokens, strict=True)) == want
        assert (got.over_limit == (got.n_tokens > 1024)).all()
    rng, count = random.Random(3), token_counts.text_counter(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(1500):
        text = "".join(rng.choices(["a", "the", " ", "\n", "\t", "'s", ".", "1", "é", "\xa0", "\x1c", "<|endoftext|>", "漢", "😀"], k=rng.randint(0, 14)))
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    assert token_counts.count_tokens(empty_documents(spark), "byte_bpe_50k.json").count() == 0


# 3 chats -------------------------------------------------------------------------------------------


def insertions(said):
    """Empty turns that make a sequence of output roles legal; None where none can. Written without the module."""
    n, before = 0, ""
    for k, role in enumerate(said):
        if role == "system" and k:
            return None
        if role == "user" and before == "user":
            n += 1  # an answer between two questions
        if role == "assistant" and before != "user":
            n += 1  # a question before an answer
        before = role
    return n + {"assistant": 0, "user": 1, "system": 2}[before]


def cheapest(roles):
    """Least repair cost by enumeration of every output role and of every merge of equal neighbours."""
    wanted = {"user": "user", "assistant": "assistant", "system": "system", "User": "user"}
    best = None
    for out in itertools.product(("system", "user", "assistant"), repeat=len(roles)):
        same = [k for k in range(1, len(out)) if out[k] == out[k - 1]]
        for merged in itertools.product((False, True), repeat=len(same)):
            drop = {k for k, m in zip(same, merged, strict=True) if m}
            added = insertions([q for k, q in enumerate(out) if k not in drop])
            if added is not None:
                cost = len(drop) + 3 * added + 2 * sum(wanted.get(r) != q for r, q in zip(roles, out, strict=True))
                best = cost if best is None else min(best, cost)
    return best


def test_chats_are_legal_cheapest_and_independent_of_ranges(spark):
    rng, rows = random.Random(5), []
    for conv in range(40):
        n = 300 if conv == 7 else rng.randint(1, 7)
        rows += [(conv, t, rng.choice(["user", "assistant", "system", "User", None, "tool"]), rng.choice(["x", "y", None, ""]), "extra", t) for t in range(n)]
    rows += [(None, 0, "user", "lost", "", 0), (3, None, "user", "q", "", 0), (5, 1, "user", "again", "", 0), (5, 1, "user", "again", "", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string, place long")
    results = []
    for ranges in (1, 3, 11):
        out = chat_format.format_chats(turns.repartition(ranges), ranges).toPandas()
        out = out.sort_values(["conv_id", "place"])
        assert all(g.place.tolist() == list(range(len(g))) for _, g in out.groupby("conv_id"))
        results.append({c: (g.cost.sum(), "".join(g.fragment), tuple(g.turn.fillna(-1)), tuple(g.role.fillna(""))) for c, g in out.groupby("conv_id")})
    assert results[0] == results[1] == results[2]
    byconv = defaultdict(list)
    for r in turns.where("conv_id is not null").orderBy("conv_id", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.xxhash64("text")).collect():
        byconv[r.conv_id].append(r.role)
    for conv, (cost, text, _, _) in results[0].items():
        if len(byconv[conv]) < 9:
            assert cost == cheapest(byconv[conv])
        said = re.findall(r"<\|im_start\|>(\w+)\n", text)
        assert text.count("<|im_end|>") == len(said) and said[-1] == "assistant" and "system" not in said[1:]
        assert all(a != b for a, b in zip(said, said[1:], strict=False)) and (said[0] == "user" or said[1] == "user")
    assert chat_format.format_chats(turns.limit(0)).count() == 0


# 4 mixing ------------------------------------------------------------------------------------------


def wanted_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(spark):
    for docs in (documents(spark, "/root/testdata/sf0.01"), odd_documents(spark)):
        out = mixing.mix(docs).toPandas()
        again = mixing.mix(docs.repartition(5)).toPandas()
        assert sorted(map(tuple, out.fillna(-1).to_numpy().tolist())) == sorted(map(tuple, again.fillna(-1).to_numpy().tolist()))
        rows = docs.select("doc_id", "text", "source").collect()
        assert len(out) == len(rows)
        sizes = defaultdict(int)
        for r in rows:
            sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        want = wanted_targets(sizes)
        got = sorted(set(zip(out.source_size, out.target.round(6), strict=True)))
        assert got == sorted({(sizes[s], round(t, 6)) for s, t in want.items()})
        assert (out.taken <= 3 * out["size"]).all() and (out.taken % out["size"].clip(lower=1) == 0).all()
        for _, g in out.groupby("source_size"):
            assert abs(g.taken.sum() - g.target.iloc[0]) <= 1.5 * g["size"].max()
    assert mixing.mix(empty_documents(spark)).count() == 0


def test_mixing_like_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(db.execute(mixing.SQL).fetchall()) == sorted(map(tuple, mixing.mix(documents(spark, sf)).collect()))


def test_mixed_rows_are_the_copies_of_each_row(spark):
    word = "w " * 40
    rows = [(1, word + str(k % 2), "b", k) for k in range(4)] + [(k, word * (k % 3 + 1) + str(k), "a", 0) for k in range(60)] + [(None, word, "a", 7), (None, word + "x", None, 8)]
    rows += [rows[5]] * 3 + [(99, None, "a", 0), (98, "", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long").selectExpr("*", "1 AS __n", "2 AS __copy", "3 AS copy", "map('k', 1) AS h").repartition(3)
    want = defaultdict(int)
    plain = mixing.copies(docs).select("h", "g", "copies").collect()
    for r in plain:
        want[r.h, r.g] += r.copies
    from tidemark.llm.common import identity

    mixed = mixing.mixed_rows(docs)
    assert mixed.schema == docs.schema
    got = defaultdict(int)
    for r in mixed.select(*identity(mixed)).collect():
        got[r.h, r.g] += 1
    assert got == {k: n for k, n in want.items() if n}
    assert any(r.source == "b" for r in mixed.collect())
    for some in (odd_documents(spark), empty_documents(spark)):
        assert mixing.mixed_rows(some).columns == some.columns
    assert mixing.mixed_rows(empty_documents(spark)).count() == 0


# 5 similarity --------------------------------------------------------------------------------------


def brute_components(rows):
    """(id, set size, component) of each row; the component is the least id of the rows it reaches."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    having = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            having[g].append(k)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    several = [ks for ks in having.values() if len(ks) > 1]
    table = np.zeros((len(rows), len(several)), np.float32)
    for c, ks in enumerate(several):
        table[ks, c] = 1
    both, size = table @ table.T, np.array([len(s) for s in sets])
    for k, j in zip(*np.nonzero((both > 0) & (100 * both >= 80 * (size[:, None] + size[None, :] - both))), strict=True):
        root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(rows[k][0], len(sets[k]), least.get(find(k)), find(k)) for k in range(len(rows))]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def near_copies(rng):
    passage = [f"p{i}" for i in range(60)]
    base, rows = [f"b{i}" for i in range(150)], []
    for k in range(220):  # near copies at about the bound, of several lengths
        w = list(base[: rng.choice([150, 150, 120, 110])])
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(50)}"
        rows.append((k, " ".join(w)))
    for k in range(220, 330):  # texts that are mostly the common passage
        rows.append((k, " ".join(passage + [f"u{k}_{i}" for i in range(rng.randint(0, 30))])))
    return rows + [(k, rows[3][1]) for k in range(330, 420)]


def repeated_ids():
    """Ids that occur with several texts, and null ids, some of them in groups."""
    word = [[f"{c}{i}" for i in range(40)] for c in "abcdef"]
    near = lambda w: " ".join(w[:-1] + ["end"])
    full = [" ".join(w) for w in word]
    return [
        (3, full[0]), (3, full[1]), (1, near(word[1])), (4, full[2]), (1, near(word[2])), (2, near(word[0])), (5, full[3]), (5, near(word[3])),
        (None, full[4]), (9, near(word[4])), (None, full[5]), (None, full[5]), (None, near(word[5])), (None, None), (None, ""), (7, "one two"), (8, "One  TWO"),
    ]


def template_group(rng):
    """Many texts of one template with words changed in a few places, most pairs at just under or over the bound."""
    base, rows = [f"t{i}" for i in range(120)], []
    for k in range(2000):
        w = list(base)
        for j in rng.sample(range(0, 120, 6), rng.randint(0, 5)):
            w[j] = f"v{rng.randrange(3)}"
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("case", ["sf0.01", "hot", "odd", "repeated ids", "template"])
def test_similar_documents_like_brute_force(spark, case):
    if case == "sf0.01":
        docs = documents(spark, "/root/testdata/sf0.01")
    elif case == "odd":
        docs = odd_documents(spark)
    else:
        made = {"hot": lambda: near_copies(random.Random(9)), "repeated ids": repeated_ids, "template": lambda: template_group(random.Random(11))}[case]()
        docs = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_components(rows)
    got = jaccard_join.similar_documents(docs)
    assert ordered(map(tuple, got.collect())) == ordered(w[:3] for w in want)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    groups = defaultdict(list)
    for i, n, _, root in want:
        if n:
            groups[root].append(i)
    heads = [min(ids, key=lambda i: (i is None, i or 0)) for ids in groups.values()] + [i for i, n, _, _ in want if not n]
    assert ordered((r.doc_id,) for r in kept.select("doc_id").collect()) == ordered((i,) for i in heads)


def test_keep_one_of_odd_columns(spark):
    schema = "doc_id long, text string, `__row` int, h string, g long, row string, `a.b` map<string,int>, sig long, n int, root long"
    rows = [(i, t, 1, None, 2, "r", {"k": 1}, 3, 4, 5) for i, t in repeated_ids()]
    docs = spark.createDataFrame(rows + rows[:3], schema)
    kept = jaccard_join.keep_one(docs)
    assert kept.schema == docs.schema
    plain = jaccard_join.keep_one(docs.select("doc_id", "text"))
    assert ordered(map(tuple, kept.select("doc_id").collect())) == ordered(map(tuple, plain.select("doc_id").collect()))


def test_similar_documents_empty(spark):
    assert jaccard_join.similar_documents(empty_documents(spark)).count() == 0
    assert jaccard_join.keep_one(empty_documents(spark)).count() == 0


# 6 personal data -----------------------------------------------------------------------------------

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(d) <= 19 and luhn or k == 3 and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_sets_leave_a_worker_in_slices():
    texts = [f"a b c d e f g {k}" for k in range(300)] + [None, ""]
    kinds = pa.schema([("n", pa.int64()), ("sig", pa.int64()), ("low", pa.list_(pa.int64()))])
    out = list(jaccard_join._sliced(kinds, kinds.names, jaccard_join._profile)(iter([pa.RecordBatch.from_pydict({"text": texts})])))
    assert max(b.num_rows for b in out) <= jaccard_join.SLICE and sum(b.num_rows for b in out) == 302
    assert [x for b in out for x in b.column("n").to_pylist()] == [4] * 300 + [0, 0]


def test_personal_data(spark, sf_dir):
    for docs in (documents(spark, sf_dir), odd_documents(spark)):
        rows = docs.select("doc_id", "text").collect()
        want = sorted((str(r.doc_id), hashlib.sha256(pii.joined(brute_spans(r.text or "")).encode()).hexdigest()) for r in rows)
        assert sorted((str(r.doc_id), r.base_sha256) for r in pii.personal_data(docs).collect()) == want
    rng = random.Random(4)
    for _ in range(5000):
        s = "".join(rng.choices("a.@-+1290 ()4", k=rng.randint(0, 40)))
        assert pii.base_spans(s) == brute_spans(s), s
    assert pii.personal_data(empty_documents(spark)).count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("it is john at example dot com", "email", "john at example dot com"),
        ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("see ４１１１ １１１１ １１１１ １１１１ there", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("a​b@c​.de", "email", "a​b@c​.de"),
        ("at 10 dot 0 dot 0 dot 1", "ip", "10 dot 0 dot 0 dot 1"),
    ],
)
def test_disguises(text, kind, source):
    spans = pii.all_spans(text, pii.base_spans(text))
    assert (kind, source) in [(pii.KINDS[k], text[s:e]) for s, k, e in spans]


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("host one nine two dot one six eight dot zero dot one up", "ip", "one nine two dot one six eight dot zero dot one"),
        ("call plus one (five five five) one two three.four five six seven", "phone", "plus one (five five five) one two three.four five six seven"),
        ("write john at example [dot] com", "email", "john at example [dot] com"),
        ("write john at example (dot) com", "email", "john at example (dot) com"),
        ("write john at example.com", "email", "john at example.com"),
        ("to a@mail.example dot com", "email", "a@mail.example dot com"),
    ],
)
def test_mixed_disguises(text, kind, source):
    test_disguises(text, kind, source)
    assert pii.all_spans("see it at www.example.com at 3.30", []) == []


def test_disguises_in_long_texts_take_linear_time():
    import time

    start = time.time()
    for text in ("two dot x" + " " * 1_000_000, "a at b" + " " * 1_000_000 + "[at] c", "one two three four 1.2.3.4 " * 20_000, "a at b dot com " * 20_000, "( at " * 100_000):
        pii.all_spans(text, pii.base_spans(text))
    assert time.time() - start < 30


def test_span_rows(spark):
    docs = spark.createDataFrame([(1, "x a@b.de, 1.2.3.4"), (2, None), (None, "a@b.de"), (None, "a@b.de")], "doc_id long, text string").selectExpr("*", "1 AS kind", "2 AS start", "3 AS s")
    got = ordered(map(tuple, pii.span_rows(docs).collect()))
    assert got == ordered([(1, "email", 2, 8), (1, "ip", 10, 17), (None, "email", 0, 6), (None, "email", 0, 6)])
    assert pii.span_rows(docs.limit(0)).count() == 0


# 7 packing -----------------------------------------------------------------------------------------


def test_packing_round_trip(spark, sf_dir):
    enc = packing._encoder("byte_bpe_50k.tiktoken")
    for docs in (documents(spark, sf_dir), odd_documents(spark)):
        back = defaultdict(list)
        packed = packing.position_resets(packing.pack(docs))
        for r in packed.collect():
            ids = np.frombuffer(r.ids, "<u2")
            assert len(ids) == packing.WIDTH and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == packing.PAD).all()
            places = [j for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False) for j in range(b - a)]
            assert np.frombuffer(r.position_ids, "<u2").tolist() == places + [0] * (packing.WIDTH - r.n_tokens)
            assert r.resets == [k for k, j in enumerate(places) if j == 0]
            for k, d in enumerate(r.doc_ids):
                back[d].append((r.starts[k], ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()))
        want = defaultdict(list)
        for r in docs.collect():
            ids = enc.encode_ordinary(r.text or "")
            want[r.doc_id] += [(s, ids[s : s + packing.WIDTH]) for s in range(0, max(1, len(ids)), packing.WIDTH)]
        assert {k: sorted(v) for k, v in back.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.pack(empty_documents(spark)).count() == 0
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    packing.write_packed(packing.pack(odd_documents(spark)), f"{folder}/odd")
    packing.write_packed(packing.pack(empty_documents(spark)), f"{folder}/none")
    assert {"ids", "position_ids", "cu_seqlens", "resets"} <= set(spark.read.parquet(f"{folder}/odd").columns)
    assert spark.read.parquet(f"{folder}/none").count() == 0


def test_best_fit_like_plain_search():
    rng = random.Random(1)
    for _ in range(200):
        lengths, free = [rng.randint(0, 20) for _ in range(rng.randint(0, 30))], []
        for n in sorted(lengths, reverse=True):
            fit = [f for f in free if f >= n]
            free.append((min(fit) if fit else 20) - n)
            if fit:
                free.remove(min(fit))
        assert sorted(20 - sum(lengths[k] for k in row) for row in packing.best_fit_decreasing(lengths, 20)) == sorted(free)


# 8 decontamination ---------------------------------------------------------------------------------


def test_leaks(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in r.text}
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
    assert want and want <= got
    kept = {r.doc_id for r in decontamination.drop_leaks(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in got}
    rng, clean = random.Random(2), "some clean words before and after it "
    rows = []
    for k, (i, t) in enumerate(items):
        w = t.split(" ")
        w[rng.randrange(len(w))] = "qq"
        rows.append((k, clean + " ".join(w).upper() + " " + clean, i))
    edited = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(edited, bench).collect()}
    assert len(found & {(k, i) for k, _, i in rows}) >= 0.95 * len(rows)
    odd = odd_documents(spark)
    assert decontamination.leaks(odd, bench).count() == 0 and decontamination.drop_leaks(odd, bench).count() == odd.count()
    nulls = spark.createDataFrame([(None, "x" * 50), (1, None), (2, "")], "item_id long, text string")
    assert decontamination.leaks(odd, nulls).count() == 0
    assert decontamination.leaks(empty_documents(spark), bench).count() == 0


def test_leaks_of_edited_and_cut_items(spark):
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    items, rng, clean = [(r.item_id, r.text) for r in bench.collect()], random.Random(3), "some clean words before and after it "

    def replaced(text, n, word):
        w = text.split(" ")
        for j in rng.sample(range(len(w)), n):
            w[j] = word
        return " ".join(w)

    cases = [lambda t, n=n, w=w: replaced(t, n, w) for n, w in ((1, "replacement"), (2, "qq"), (2, "hello"), (2, "replacement"))]
    cases.append(lambda t: t[len(t) // 10 :].split(" ", 1)[1])
    rows = [(c * 1000 + k, clean + f(t) + " " + clean, i) for c, f in enumerate(cases) for k, (i, t) in enumerate(items)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long").repartition(4)
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
    for c, least in enumerate((0.95, 0.95, 0.95, 0.9, 0.95)):
        assert len(found & {(k, i) for k, _, i in rows if k // 1000 == c}) >= least * len(items), c
    part = items[0][1][20:110]
    short = spark.createDataFrame([(1, "abc"), (2, "x-y"), (3, "  ")], "item_id long, text string")
    texts = spark.createDataFrame([(1, "- Abc d"), (2, "abcd xy"), (3, part), (4, "so: X y, x-y")], "doc_id long, text string")
    got = [(r.doc_id, r.item_id, r.start, r.end, r.edits) for r in decontamination.leaks(texts, short).collect()]
    assert sorted(got) == [(1, 1, 2, 5, 0), (4, 2, 4, 7, 0), (4, 2, 9, 12, 0)]
    r = decontamination.leaks(texts, bench).collect()
    assert [(x.doc_id, x.item_id, x.edits, x.item_chars) for x in r] == [(3, items[0][0], 0, decontamination.WINDOW)]
    assert r[0].end - r[0].start >= decontamination.WINDOW


def test_leaks_at_the_whole_edit_budget(spark):
    """Items with as many edited characters as the budget allows, against the distance by a full table."""
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items, rng, rows = [(r.item_id, r.text) for r in bench.collect()], random.Random(12), []
    for k, (i, t) in enumerate(items * 3):
        chars = list(t)
        for j in rng.sample(range(len(chars)), decontamination.budget(len(t))):
            chars[j] = rng.choice(["", "x", chars[j] + "y"])
        rows.append((k, "clean words before it " + "".join(chars) + " and after it", i))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
    within = []
    for k, text, i in rows[:100]:
        item, doc = (decontamination._words(decontamination._trimmed(t)) for t in (dict(items)[i], text))
        if distance_inside(item, doc) <= decontamination.budget(len(item)):
            within.append((k, i))
    assert len(within) > 50 and len(found & set(within)) >= 0.9 * len(within)


def test_items_of_one_stem():
    import time

    rng = random.Random(13)
    stem = "which of the following statements about the text above is the one that is most likely to be true: "
    items = [stem + " ".join(rng.choice("abcdefghijk") + str(rng.randrange(10**6)) for _ in range(25)) for _ in range(1000)]
    index = decontamination.Index(list(range(1000)), items)
    words = " ".join(rng.choice("lmnop") + str(rng.randrange(10**6)) for _ in range(150))
    start = time.time()
    some = decontamination.found_in(words + " which of the following statements is true " + words + " " + items[17] + " " + words, index)
    assert time.time() - start < 30
    assert next(r for r in some if r["item_id"] == 17)["edits"] == 0
    part = " ".join(items[5].split(" ")[8:])[40:]
    assert {r["item_id"] for r in decontamination.found_in(words + " " + part, index)} == {5}


def test_least_edits_like_full_table():
    rng = np.random.default_rng(3)
    sizes = rng.integers(5, 65, 300)
    patterns, regions = rng.integers(97, 100, (300, 64)).astype(np.uint32), rng.integers(97, 100, (300, 80)).astype(np.uint32)
    got = decontamination.least_edits(patterns, sizes, regions)
    want = [distance_inside(p[:n].tolist(), r.tolist()) for p, n, r in zip(patterns, sizes, regions, strict=True)]
    assert got.tolist() == want


def distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment_like_full_table():
    rng = random.Random(8)
    for _ in range(60):
        item = "".join(rng.choices("abcd ", k=rng.randint(60, 90))).strip().replace("  ", "b")
        index = decontamination.Index([0], [item])
        item = "".join(map(chr, index.codes[0].tolist()))
        text = list(item)
        for _ in range(rng.randint(0, 6)):
            text.insert(rng.randrange(len(text)), "z") if rng.random() < 0.5 else text.pop(rng.randrange(len(text)))
        region = "ab" + "".join(text) + "c"
        got = index.align(0, np.array(list(map(ord, region)), np.uint64))
        want = distance_inside(item, region)
        assert (got[2] if got else None) == (want if want <= index.edits[0] else None)


# 9 urls --------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [
        ("http://A.Example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/12?x=1", "example.org", "/en/12", "example.org/en/1", "block"),
        ("x://org/#f", "org", "/", "org/", "allow"), ("http://myorg/", "myorg", "/", None, None), ("http://a.com/de/x://b.org/", "a.com", "/de/x://b.org/", "com/de/", "block"),
        ("http://a.com?/fr/", "a.com", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("http://ÄB.com/fr/é", "Äb.com", "/fr/é", "com/fr/", "allow"),
    ]
    pages = spark.createDataFrame([(k, u[0], "x", "y") for k, u in enumerate(urls)] + [(None, None, "", "")], "page_id long, url string, host string, label string")
    got = {r.page_id: r for r in url_filter.verdicts(pages).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")
    assert url_filter.verdicts(pages.limit(0)).count() == 0


def test_url_trees_held_out(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    seen, held = pages.where("page_id % 3 > 0"), pages.where("page_id % 3 = 0")
    features = url_filter.lexical(seen)
    labelled, shares = features.where("ruled is not null"), url_filter.suffix_shares(features)
    counts = {k: url_filter.block_counts(labelled, k) for k in ("suffix", "section")}
    ready = lambda df, own: url_filter.VectorAssembler(inputCols=list(url_filter.FEATURES), outputCol="lexical_vector").transform(
        url_filter.with_statistics(df.where("ruled is not null"), shares, counts, own).withColumn("label", (F.col("ruled") == "block").cast("double"))
    )
    model = url_filter.fit(ready(features, True))
    right = model.transform(ready(url_filter.lexical(held), False)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.8


def test_url_statistics_leave_a_row_s_own_fold_out(spark):
    urls = [(k, f"http://h{k % 3}.com/{'de' if k % 2 else 'fr'}/{k}") for k in range(60)]
    rows = url_filter.lexical(spark.createDataFrame(urls, "page_id long, url string")).where("ruled is not null")
    counts = {k: url_filter.block_counts(rows, k) for k in ("suffix", "section")}
    out = url_filter.with_statistics(rows, url_filter.suffix_shares(rows), counts, own=True)
    got = {r.page_id: r.section_block for r in out.collect()}
    fold = {r.page_id: r.f for r in rows.select("page_id", url_filter._fold().alias("f")).collect()}
    for k, _ in urls:
        others = [j for j, _ in urls if j % 2 == k % 2 and fold[j] != fold[k]]
        assert abs(got[k] - ((len(others) if k % 2 else 0) + 1) / (len(others) + 2)) < 1e-12
    assert {r.suffix_share for r in out.collect()} == {1.0}


URL_SQL = """WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, regexp_extract(rest, '(?s)^([^/?#]*)', 1) AS raw, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, host, path, r.h || r.p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
    FROM h LEFT JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p))
SELECT page_id, host, path, rule, v FROM m WHERE k = 1"""


def test_url_rules_like_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = db.execute(URL_SQL).fetchall()
    got = {r.page_id: r for r in url_filter.verdicts(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    assert len(got) == len(want)
    for page_id, host, path, rule, verdict in want:
        r = got[page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ({verdict} if verdict else {"allow", "block"})


# 10 media ------------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    docs = odd_documents(spark)
    got = {(r.payload_sha256, r.payload_bytes, r.tail_crc32, r.n_bytes) for r in media.media_digests(docs).collect()}
    want = set()
    for (t,) in docs.select("text").collect():
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want.add((hashlib.sha256(payload).hexdigest(), len(payload), zlib.crc32(payload[-16:]), len(raw)))
    assert got == want
    assert media.media_digests(empty_documents(spark)).count() == 0
    stored = media.to_media(docs)
    tensors = {(r.doc_id, r.n_bytes, r.height, r.width, bytes(r.rgb)) for r in media.rgb_tensors(stored.selectExpr("*", "1 AS width", "2 AS row")).collect()}
    assert tensors == {(r.doc_id, r.n_bytes, r.height, r.width, bytes(r.rgb)) for r in media.media_digests(docs).collect()}
    assert all(len(r[4]) == 3 * r[2] * r[3] for r in tensors)
    assert media.rgb_tensors(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first().rgb is None
    assert media.rgb_tensors(stored.limit(0)).count() == 0
    for payload in (bytes(range(256)) * 3, b"\xff" * 192, b"\x00" * 192):
        assert media.payload_of(media.decode_coefficients(media.encode_payload(payload))) == payload


class BitWriter:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def signed(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)


def progressive(coefs, quant):
    """A grey progressive file with zero runs, end-of-band runs and new coefficients in the refining scan."""
    h, w, _ = coefs.shape
    flat = coefs.reshape(-1, 64)
    table = lambda kind: media._segment(0xC4, bytes([kind << 4, *[0] * 7, 255, *[0] * 8]) + bytes(range(255)))
    put = lambda b, s: b.put(s, 8)  # noqa: E731  symbol s has the code s
    seal = lambda b: media._fill(np.array(b.bits, np.uint8))
    out = [b"\xff\xd8", media._segment(0xDB, bytes([0, *quant])), media._segment(0xC2, bytes([8, 0, 8 * h, 0, 8 * w, 1, 1, 0x11, 0])), table(0), table(1)]
    b, last = BitWriter(), 0
    for c in flat:
        d = (int(c[0]) >> 1) - last
        last += d
        put(b, abs(d).bit_length())
        b.signed(d) if d else None
    out += [media._scan_head([1], 0, 0, 0, 1), seal(b)]
    b = BitWriter()
    for c in flat:
        b.put(int(c[0]) & 1, 1)
    out += [media._scan_head([1], 0, 0, 1, 0), seal(b)]
    b, high = BitWriter(), np.sign(flat) * (np.abs(flat) >> 1)
    for c in high:
        run = 0
        for v in map(int, c[1:]):
            if not v:
                run += 1
                continue
            while run > 15:
                put(b, 0xF0)
                run -= 16
            put(b, run << 4 | abs(v).bit_length())
            b.signed(v)
            run = 0
        if run:
            put(b, 0)
    out += [media._scan_head([1], 1, 63, 0, 1), seal(b)]
    b = BitWriter()
    for c, old in zip(flat, high, strict=True):
        new = [k for k in range(1, 64) if abs(c[k]) == 1]
        k = 1
        for at in new:
            zeros, pending = 0, []
            while k < at or False:
                if old[k]:
                    pending.append(int(abs(c[k]) & 1))
                else:
                    zeros += 1
                    if zeros == 16:
                        put(b, 0xF0)
                        for p in pending:
                            b.put(p, 1)
                        zeros, pending = 0, []
                k += 1
            put(b, zeros << 4 | 1)
            b.put(int(c[at] > 0), 1)
            for p in pending:
                b.put(p, 1)
            k = at + 1
        if k <= 63:
            put(b, 0)
            for j in range(k, 64):
                if old[j]:
                    b.put(int(abs(c[j]) & 1), 1)
    out += [media._scan_head([1], 1, 63, 1, 0), seal(b)]
    return b"".join(out) + b"\xff\xd9"


def test_general_progressive_scans():
    rng = np.random.default_rng(6)
    for _ in range(10):
        coefs = np.where(rng.random((2, 3, 64)) < 0.3, rng.integers(-30, 31, (2, 3, 64)), 0)
        quant = rng.integers(1, 5, 64)
        data = progressive(coefs, quant.tolist())
        image = media.decode_coefficients(data)
        assert (image.components[0].coefs == coefs).all()
        x = np.arange(8)
        basis = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)
        rgb = media.decode_rgb(data)
        block = np.zeros(64)
        block[media.ZIGZAG] = coefs[1, 2] * quant
        want = np.clip(basis @ block.reshape(8, 8) @ basis.T + 128, 0, 255)
        assert np.abs(rgb[8:16, 16:24, 0] - want).max() <= 1


# pipeline ------------------------------------------------------------------------------------------


def tables(spark, docs, bench):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(4, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_stages_keep_what_they_should(spark, sf_dir):
    from tidemark.llm import pipeline

    docs, seen, by_name = documents(spark, sf_dir), [], dict(pipeline.STAGES)
    for name, stage in pipeline.STAGES[:-1]:
        after = pipeline.staged(stage(spark, docs, sf_dir), "test")
        assert after.columns == docs.columns
        seen.append((name, docs, after))
        docs = after
    (_, every, good), (_, _, single), (_, _, clean), (_, _, mixed) = seen
    graded = quality.classify(every, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("keep").select("doc_id")
    assert sorted(graded.collect()) == sorted(good.select("doc_id").collect())
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, n, c, _ in brute_components(rows) if n} | {i for i, n, _, _ in brute_components(rows) if not n})
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = {r.doc_id for r in decontamination.leaks(single, bench).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - bad
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix(clean).collect() if r.taken}
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id] += 1
    assert got == taken
    back, enc = defaultdict(list), packing._encoder("byte_bpe_50k.tiktoken")
    for r in pipeline.pack_tokens(spark, mixed, sf_dir).collect():
        ids = np.frombuffer(r.ids, "<u2")
        for k, d in enumerate(r.doc_ids):
            back[d] += ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert {d: sorted(x) for d, x in back.items()} == {d: sorted(enc.encode_ordinary(text[d]) * n) for d, n in taken.items()}
    assert set(by_name) == {n for n, _ in pipeline.STAGES}


@pytest.mark.parametrize("case", ["odd", "empty", "no benchmark"])
def test_pipeline_of_odd_and_empty_tables(spark, case):
    from tidemark.llm import pipeline

    docs = empty_documents(spark) if case == "empty" else odd_documents(spark)
    bench = spark.createDataFrame([] if case == "no benchmark" else [(1, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11 word12"), (2, None)], "item_id long, text string")
    out = pipeline.run(spark, tables(spark, docs, bench))
    assert "ids" in out.columns and (out.count() == 0) == (case == "empty")
    found = {d for r in out.select("doc_ids").collect() for d in r.doc_ids}
    assert (4 in found) == (case == "no benchmark")
