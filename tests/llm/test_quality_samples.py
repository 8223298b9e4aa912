"""The classifier on small samples, and on ids that occur with several texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_llm import documents
from tidemark.llm import quality


@pytest.mark.parametrize("rows, poor, good", [(300, 0.1, 0.93), (3000, 0.1, 0.95)])
def test_held_out_by_sample(spark, rows, poor, good):
    sf = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.col("doc_id") % 4 == 0
    model = quality.train(docs, labels.where(~held), fit_rows=rows)
    graded = docs.join(labels.where(held), "doc_id").select("quality", "toxic", quality.scorer(docs, model)("text")["p_tail"].alias("p")).toPandas()
    kept = lambda d: (d.p >= quality.KEEP_TAIL).mean()
    assert kept(graded[(graded.quality == 1) & (graded.toxic == 0)]) > good
    assert kept(graded[graded.quality == 0]) < poor
    toxic = kept(graded[(graded.quality == 1) & (graded.toxic == 1)])
    assert toxic < (0.8 if rows == 300 else 0.45)


def test_one_text_an_id(spark):
    """An id with many texts is one rated document, the same one in any order of the rows."""
    rows = [(k, " ".join(f"good{(k * 7 + j) % 50}" for j in range(60))) for k in range(40)] + [(k, "idiot bad " * (k % 5 + 1)) for k in range(40, 80)]
    rows += [(3, f"idiot bad number {j}") for j in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k >= 40)) for k in range(80)], "doc_id long, quality int, toxic int")
    one = quality.train(docs.repartition(1), labels)
    two = quality.train(docs.orderBy(F.desc("doc_id"), F.desc("text")).repartition(5), labels)
    assert np.array_equal(one.weights, two.weights) and np.allclose(one.shape, two.shape)
