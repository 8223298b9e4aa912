"""URL verdicts: host and path rules, and gradient-boosted trees where no rule fits.

Everything is DataFrame functions and pyspark.ml, so it stays in the JVM. Labelled URLs are those
that a rule decides; the trees learn from lexical features of at most ``FIT_ROWS`` of them: lengths,
depth, digit ratio, character entropy, parameter counts, and statistics of the host's suffix and of
the first path section. Shares of blocked URLs come from the sample, each row's own from the other
folds, so no label reaches its own features.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attached, staged

#: Rules as host, path prefix, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Bound on the labelled URLs that the trees are fitted on.
FIT_ROWS = 4000
ROUNDS, DEPTH = 12, 4
#: Folds of the labelled URLs; a row's shares of blocked ones leave its own fold out.
FOLDS = 5
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "entropy", "parameters", "query_length", "has_fragment", "is_secure", "suffix_share", "suffix_block", "section_block")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for a null url or one without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; nulls where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # later ones win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Entropy of a text's characters in bits."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    total = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: acc + F.when(F.length(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    return F.when(n > 0, -total).otherwise(0.0)


def lexical(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, ruled, suffix`` and the features that need no statistics."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = host_and_path(url)
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", "")).cast("double")
    query = F.regexp_extract("url", r"(?s)^[^?#]*\?([^#]*)", 1)
    return parts.select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"),
        F.substring_index("host", ".", -1).alias("suffix"),
        F.regexp_extract("path", r"(?s)^/([^/]*)/", 1).alias("section"),
        F.length("url").cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double").alias("depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        (digits(F.col("url")) / F.greatest(F.length("url"), F.lit(1))).alias("digit_ratio"),
        digits(F.col("host")).alias("host_digits"),
        _entropy(F.col("url")).alias("entropy"),
        F.when(F.length(query) > 0, F.size(F.split(query, "&"))).otherwise(0).cast("double").alias("parameters"),
        F.length(query).cast("double").alias("query_length"),
        F.contains("url", F.lit("#")).cast("double").alias("has_fragment"),
        F.startswith("url", F.lit("https:")).cast("double").alias("is_secure"),
    )


def suffix_shares(features: DataFrame) -> DataFrame:
    """``suffix, suffix_share``: each suffix's part of all rows, one added to either count; one row for each suffix."""
    counts = staged(features.groupBy("suffix").agg(F.count(F.lit(1)).alias("rows")), "suffix-counts")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    return counts.select("suffix", ((F.col("rows") + 1) / F.lit(total + 1)).alias("suffix_share"))


def _fold() -> Column:
    return F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(FOLDS))


def block_counts(labelled: DataFrame, key: str) -> DataFrame:
    """``key, fold, n, blocked`` of labelled rows; the fold -1 has the sums of all. At most two rows for each labelled one."""
    each = labelled.select(key, F.explode(F.array(_fold(), F.lit(-1).cast("long"))).alias("fold"), (F.col("ruled") == "block").cast("long").alias("b"))
    return each.groupBy(key, "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("blocked"))


def with_statistics(rows: DataFrame, shares: DataFrame, counts: dict[str, DataFrame], own: bool = False) -> DataFrame:
    """``rows`` with ``suffix_share`` and the smoothed share of blocked URLs by suffix and by section.

    ``own``: the rows are the labelled ones themselves, and what their fold adds is taken off. The
    tables of counts have at most twice ``FIT_ROWS`` rows by construction, so they are broadcast; that
    of shares is when it is small.
    """
    out = attached(rows, shares, ["suffix"])
    for key, table in counts.items():
        whole = table.where("fold = -1").select(key, F.col("n").alias(f"{key}_n"), F.col("blocked").alias(f"{key}_b"))
        out = out.join(F.broadcast(whole), key, "left")
        n, b = F.coalesce(f"{key}_n", F.lit(0)), F.coalesce(f"{key}_b", F.lit(0))
        if own:
            fold = table.where("fold >= 0").select(key, F.col("fold").alias("of"), F.col("n").alias(f"{key}_fn"), F.col("blocked").alias(f"{key}_fb"))
            out = out.withColumn("of", _fold()).join(F.broadcast(fold), [key, "of"], "left").drop("of")
            n, b = n - F.coalesce(f"{key}_fn", F.lit(0)), b - F.coalesce(f"{key}_fb", F.lit(0))
        out = out.withColumn(f"{key}_block", (b + 1) / (n + 2)).drop(f"{key}_n", f"{key}_b", f"{key}_fn", f"{key}_fb")
    return out


def verdicts(pages: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_probability`` for every row.

    The verdict is the rule's, else the trees'. A null url has an empty host and path. Where rules
    label fewer than two kinds of URL the trees can't be fitted and unruled URLs are allowed, with
    a null probability. Null ids stay null, repeated rows are repeated, an empty table gives an
    empty one, other columns are ignored.
    """
    features = staged(lexical(pages), "urls")
    labelled = staged(features.where("ruled IS NOT NULL").orderBy(F.xxhash64("page_id", "host", "path"), "page_id").limit(fit_rows), "labelled-urls")
    shares = staged(suffix_shares(features), "suffix-shares")
    counts = {key: staged(block_counts(labelled, key), f"{key}-counts") for key in ("suffix", "section")}
    sample = staged(with_statistics(labelled, shares, counts, own=True).withColumn("label", (F.col("ruled") == "block").cast("double")), "labelled")
    rows = with_statistics(features, shares, counts)
    decided = F.col("ruled")
    if sample.agg(F.countDistinct("label")).first()[0] < 2:
        return rows.select("page_id", "host", "path", "rule", F.coalesce(decided, F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("block_probability"))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="lexical_vector")
    model = fit(assembler.transform(sample))
    scored = model.transform(assembler.transform(rows)).withColumn("p", vector_to_array("probability")[1])
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce(decided, F.when(F.col("p") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        F.col("p").alias("block_probability"),
    )


def fit(sample: DataFrame) -> GBTClassificationModel:
    """Boosted trees on a labelled sample with ``lexical_vector`` and ``label``."""
    return GBTClassifier(featuresCol="lexical_vector", labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(sample.coalesce(1))
