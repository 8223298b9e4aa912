"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered: 0 (poor text), 1 (well formed but toxic), 2 (good). One weight vector over
hashed text features is shared by all grades; ordered thresholds t1 < t2 cut the score:
``P(grade >= k) = sigmoid(score - t_k)``. The expected grade is the sum of these tails; the last
tail selects documents.

Fitting uses at most ``FIT_ROWS`` labelled rows (those with the smallest hash of their id), whose
hashed features, never texts, come to the driver. Scoring runs in the executors over whole texts.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import give_back, staged

#: Bound on the labelled rows that the fit reads.
FIT_ROWS = 8000
#: Buckets of the hashed words and word stems.
BUCKETS = 1 << 18
#: Letters of a word's stem features.
STEMS = (4, 5)
#: Features that the fit uses, unless told otherwise: all whose share of documents differs between
#: grades with at least this z statistic and one share at least this many times the other. The z
#: statistic is that of a test on some 100,000 buckets, so it does not shrink with the sample; from a
#: few hundred rows on, enough words pass.
LEAST_Z = 4.0
LEAST_LIFT = 8.0
#: Tail probability from which a document is kept.
KEEP_TAIL = 0.5
#: Grades and the tails between them.
GRADES = 3
#: A worker's memory of word buckets is emptied at this many words.
REMEMBER_WORDS = 500_000

SHAPES = ("bias", "upper", "punctuation", "digits", "marks", "word_length", "distinct_words", "distinct_lines", "short")


def buckets_of(word: str) -> tuple[int, ...]:
    """The bucket of a word and those of its stems."""
    raw = word.encode("utf-8", "surrogatepass")
    stems = (zlib.crc32(word[:k].encode("utf-8", "surrogatepass"), k) for k in STEMS)
    return zlib.crc32(raw) % BUCKETS, *(h % BUCKETS for h in stems)


def shape_of(text: str, words: list[str], distinct: int) -> list[float]:
    """Dense features of a text's form, each about 0 to 1."""
    n = max(1, len(text))
    lines = text.split("\n")
    letters = sum(map(len, words))
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    marks = text.count("#") + text.count("$") + text.count("%") + text.count("&") + text.count("*") + text.count("!") + text.count("|")
    return [
        1.0,
        upper / max(1, len(words)),
        min(1.0, (text.count(",") + text.count(".")) / n * 20),
        min(1.0, sum(map(text.count, "0123456789")) / n * 10),
        min(1.0, marks / n * 20),
        min(1.0, letters / max(1, len(words)) / 20),
        distinct / max(1, len(words)),
        len(set(lines)) / len(lines),
        1.0 / (1.0 + len(words)),
    ]


@dataclasses.dataclass
class OrdinalModel:
    """Shared weights, shape weights and ordered thresholds; ``None`` weights keep everything."""

    weights: np.ndarray | None
    shape: np.ndarray | None
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def features_of(text: str | None) -> tuple[list[int], list[float]]:
    """Distinct buckets and shape features of a whole text (null: empty)."""
    text = text or ""
    words = text.split()
    kinds = {w.lower() for w in words}
    found: set[int] = set()
    for w in kinds:
        found.update(buckets_of(w))
    return sorted(found), shape_of(text, words, len(kinds))


def telling(counts: np.ndarray, totals: np.ndarray, least_z: float = LEAST_Z, least_lift: float = LEAST_LIFT) -> np.ndarray:
    """Buckets, in order, whose share of documents differs between those below and above some grade.

    ``counts[b, g]`` is the number of documents of grade g that have bucket b.
    """
    best = np.zeros(len(counts))
    share = counts.sum(axis=1) / max(1, totals.sum())
    for cut in range(1, GRADES):
        above, below = max(1, totals[cut:].sum()), max(1, totals[:cut].sum())
        p, q = counts[:, cut:].sum(axis=1) / above, counts[:, :cut].sum(axis=1) / below
        z = np.abs(p - q) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / above + 1 / below))
        lift = np.maximum((p + 0.5 / above) / (q + 0.5 / below), (q + 0.5 / below) / (p + 0.5 / above))
        best = np.maximum(best, np.where(lift >= least_lift, z, 0))
    return np.flatnonzero(best >= least_z)


def likelihood(params: tuple, row: np.ndarray, col: np.ndarray, shapes: np.ndarray, grades: np.ndarray, decay: float) -> tuple[float, list[np.ndarray]]:
    """Mean log-likelihood of the grades, less ``decay`` / 2 of the squared weights, and its gradient.

    ``params`` are the weights of the used buckets, those of the shapes, and the ordered thresholds;
    document ``row[k]`` has the used bucket ``col[k]``.
    """
    w, s, cuts = params
    n, at = len(grades), np.arange(len(grades))
    score = np.bincount(row, w[col], minlength=n) + shapes @ s
    tail = 1.0 / (1.0 + np.exp(-np.clip(score[:, None] - cuts[None, :], -40, 40)))
    bounds = np.hstack([np.ones((n, 1)), tail, np.zeros((n, 1))])
    slope = bounds * (1 - bounds)
    likely = np.maximum(bounds[at, grades] - bounds[at, grades + 1], 1e-9)
    d_score = (slope[at, grades] - slope[at, grades + 1]) / likely
    share = slope[:, 1:-1] / likely[:, None]
    above = grades[:, None] - np.arange(len(cuts))[None, :]  # 1: the threshold is the grade's lower bound, 0: its upper one
    d_cuts = np.where(above == 0, share, np.where(above == 1, -share, 0.0)).sum(axis=0)
    grads = [np.bincount(col, d_score[row], minlength=len(w)) / n - decay * w, shapes.T @ d_score / n, d_cuts / n]
    return float(np.log(likely).mean() - decay / 2 * (w @ w)), grads


def fit(buckets: list[np.ndarray], used: np.ndarray, shapes: np.ndarray, grades: np.ndarray, rounds: int = 500, rate: float = 0.1, decay: float = 1e-4) -> OrdinalModel:
    """Cumulative-link regression by full-batch adaptive gradient steps.

    ``buckets`` has each document's buckets among ``used``. Fewer than two different grades give a
    model that keeps everything.
    """
    if len(grades) == 0 or len(np.unique(grades)) < 2:
        return OrdinalModel(None, None, np.linspace(-1.0, -0.5, GRADES - 1))
    sizes = np.array([len(b) for b in buckets])
    flat = np.concatenate(buckets) if sizes.sum() else np.zeros(0, np.int64)
    row, col = np.repeat(np.arange(len(grades)), sizes), np.searchsorted(used, flat)
    params = np.zeros(len(used)), np.zeros(shapes.shape[1]), np.linspace(-1.0, 0.0, GRADES - 1)
    cuts = params[2]
    sums, moves = [np.zeros_like(p) + 1e-8 for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        _, grads = likelihood(params, row, col, shapes, grades, decay)
        for p, g, q, m in zip(params, grads, sums, moves, strict=True):
            m *= 0.9
            m += 0.1 * g
            q *= 0.99
            q += 0.01 * g * g
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)
        apart = 1e-3 * np.arange(len(cuts))
        cuts[:] = np.maximum.accumulate(cuts - apart) + apart  # thresholds stay in order
    w, s, _ = params
    full = np.zeros(BUCKETS, np.float32)
    full[used] = w
    return OrdinalModel(full, s, cuts)


def grade_of(quality, toxic):
    """Graded rating from the two labels: null where a label is missing."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 2)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, least_z: float = LEAST_Z, least_lift: float = LEAST_LIFT) -> OrdinalModel:
    """Fit on at most ``fit_rows`` labelled documents and their telling buckets.

    Repeated labels of one id count once, at the lowest grade; of an id that has several texts the one
    with the least hash counts, so reruns agree and no text but one an id is featurised. Rows with a
    null id or label, and labels without a document, are left out. An empty sample gives a model that
    keeps everything.
    """
    sample = (
        labels.select(F.col("doc_id"), grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
        .where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )

    def featurise(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = [features_of(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "grade": pdf["grade"], "buckets": [np.array(b, np.int32) for b, _ in got], "shape": [s for _, s in got]})

    # the sample has at most fit_rows ids, so it is small by construction
    rated = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = staged(rated.mapInPandas(featurise, "doc_id long, grade int, buckets array<int>, shape array<double>"), "features")
    by_grade = [F.count_if(F.col("grade") == g).alias(f"g{g}") for g in range(GRADES)]
    totals = np.array(found.agg(*by_grade).first(), np.int64)
    # at most BUCKETS rows of counts come to the driver
    table = found.select("grade", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(*by_grade).where(" + ".join(f"g{g}" for g in range(GRADES)) + " >= 3").toPandas()
    counts = np.zeros((BUCKETS, GRADES), np.int64)
    counts[table["bucket"].to_numpy(np.int64)] = table[[f"g{g}" for g in range(GRADES)]].to_numpy(np.int64)
    used = telling(counts, totals, least_z, least_lift)

    def restrict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.assign(buckets=[np.intersect1d(b, used).astype(np.int32) for b in pdf["buckets"]])

    rows = found.mapInPandas(restrict, found.schema).toPandas().sort_values("doc_id", kind="stable")
    shapes = np.array(rows["shape"].tolist()).reshape(len(rows), len(SHAPES))
    return fit([np.asarray(b, np.int64) for b in rows["buckets"]], used, shapes, rows["grade"].to_numpy(np.int64))


class _Buckets(dict):
    """Buckets with a weight by word, worked out when first asked for."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBER_WORDS:
            self.clear()
        found = self[word] = tuple(b for b in buckets_of(word) if self.weights[b])
        return found


def scorer(docs: DataFrame, model: OrdinalModel):
    """A Column function text -> struct(expected_grade, p_tail) over whole texts."""
    kind = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("p_tail", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS floats

    @F.pandas_udf(kind)
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        known = None if m.weights is None else _Buckets(m.weights)
        for texts in parts:
            out = np.zeros(len(texts))
            if known is not None:
                for i, text in enumerate(texts):
                    text = text or ""
                    words = text.split()
                    kinds = set(text.lower().split())
                    found = list({b for w in kinds for b in known[w]})
                    form = shape_of(text, words, len(kinds))
                    out[i] = float(m.weights[found].sum()) + float(m.shape @ np.array(form))
            tails = m.tails(out)
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "p_tail": tails[:, -1]})
        known = texts = text = words = kinds = None
        give_back()

    return score


def classify(docs: DataFrame, labels: DataFrame, keep_tail: float = KEEP_TAIL, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Grade every document: ``doc_id, expected_grade, p_tail, keep``.

    One row for each input row. A null text is graded as an empty one; null ids stay null; repeated
    rows get equal grades; an empty table gives an empty one; other columns are ignored.
    """
    score = scorer(docs, train(docs, labels, fit_rows))
    graded = docs.select("doc_id", score(F.coalesce("text", F.lit(""))).alias("graded"))
    return graded.select("doc_id", "graded.expected_grade", "graded.p_tail", (F.col("graded.p_tail") >= keep_tail).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, keep_tail: float = KEEP_TAIL, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose tail probability reaches ``keep_tail``.

    A null text is graded as an empty one; rows with a null id are graded too; repeated rows stay or
    go together; without usable labels all rows stay; an empty table gives an empty one. Column
    names don't matter.
    """
    score = scorer(docs, train(docs, labels, fit_rows))
    return docs.where(score(F.coalesce("text", F.lit("")))["p_tail"] >= keep_tail)
