"""What the join leaves in the shared folder."""

import os
import subprocess
import sys

from tidemark.llm import jaccard_join
from tidemark.llm.common import passing, shared_dir, staged


def test_join_leaves_only_its_result(spark):
    """Its tables go when its result is written; the rows are read after that. The session's settings stay."""
    folder = shared_dir(spark).removeprefix("file://")
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " x"), (4, None), (5, "a b c d e f")], "doc_id long, text string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, batch = set(os.listdir(folder)), spark.conf.get(key)
    kept, similar = jaccard_join.keep_one(docs), jaccard_join.similar_documents(docs)
    left = {x.rpartition("-")[0] for x in set(os.listdir(folder)) - before}
    assert left == {"drops", "repeated", "similar"}
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar.collect()) == [(1, 6, 1), (2, 6, 1), (3, 7, 1), (4, 0, 4), (5, 2, 5)]
    assert spark.conf.get(key) == batch


def test_tables_go_after_an_error(spark):
    folder = shared_dir(spark).removeprefix("file://")
    try:
        with passing(spark):
            staged(spark.range(3), "goes")
            kept = staged(spark.range(4), "kept", stays=True)
            raise ValueError
    except ValueError:
        pass
    assert not [x for x in os.listdir(folder) if x.startswith("goes-")] and kept.count() == 4
    assert staged(spark.range(2), "outside").count() == 2


def test_full_sets_are_never_shuffled(spark):
    """One Python operator a stage, and below the sets the only shuffle of texts; a row repeated as it is counts once."""
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, text + " x"), (5, "a b c d e f")], "doc_id long, text string")
    profile = jaccard_join.profiles(docs)
    classes = jaccard_join._classes(profile)
    survivors = staged(jaccard_join._survivors(profile.where("n > 0").select("sig", "low"), classes), "survivors")
    sets = jaccard_join._full_sets(docs, survivors)
    assert sorted((r.n, len(r.tokens)) for r in sets.collect()) == [(6, 6), (7, 7)]
    plan = sets._jdf.queryExecution().sparkPlan().toString()
    at = [plan.index(x) for x in ("MapInArrow", "Aggregate", "ArrowEvalPython")]
    assert at == sorted(at) and "Aggregate" not in plan[: at[0]]


def test_freed_memory_goes_back():
    """After its last batch a worker holds little more than before its first."""
    code = """
import random, re
import pyarrow as pa
from tidemark.llm import jaccard_join
held = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
rng = random.Random(3)
kinds = pa.schema([("n", pa.int64()), ("sig", pa.int64()), ("low", pa.list_(pa.int64()))])
batch = lambda n: pa.RecordBatch.from_pydict({"text": [" ".join(str(rng.randrange(10**6)) for _ in range(700)) for _ in range(n)]})
run = jaccard_join._sliced(kinds, kinds.names, jaccard_join._profile)
sum(b.num_rows for b in run(iter([batch(10)])))
before = held()
sum(b.num_rows for b in run(batch(8000) for _ in range(1)))
print(held() - before)
"""
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert int(found.stdout.split()[-1]) < 15
