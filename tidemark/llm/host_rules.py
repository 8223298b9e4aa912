"""Quality rules by host: rule failures counted by domain, shrunk towards an empirical beta prior.

Each document gets its measures and fails some of ``RULES``. Failures are counted by host, one row a
host. For each rule the hosts' rates give a beta prior by the method of moments, and a host's rate is
the posterior mean ``(failures + a) / (documents + a + b)``, so that a host with few documents stays
near the common rate. A host fails when one of its shrunk rates passes ``HOST_LIMIT``; its verdict is
joined back to its documents, which are kept when neither they nor their host fail.

All of it is DataFrame functions, so it stays in the JVM. Texts are never shuffled: what travels is
the measures, combined by host before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attached, staged

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words of a window whose repetition counts.
WINDOW = 3
#: Rules that a document fails, in terms of its measures.
RULES = {
    "short": "n_words < 50",
    "repeated": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
}
#: The rules that reject a document by itself.
OWN_RULES = ("short", "repeated")
#: A host fails when the shrunk rate of one rule is above this.
HOST_LIMIT = 0.5
#: Bounds on a prior's weight in documents, so that few documents alone condemn no host; hosts that all have one rate get the upper one.
LEAST_PRIOR, MOST_PRIOR = 10.0, 1e6


def _covered(starts: Column) -> Column:
    """Words in windows that begin at these ascending places."""
    steps = F.transform(starts, lambda s, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), s - F.get(starts, i - 1))))
    return F.aggregate(steps, F.lit(0), lambda a, b: a + b)


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` of each whole text.

    Windows are compared by 64-bit hashes. ``n_repeat_words`` counts places, each once, that lie in
    some window found twice or more; texts with fewer words than a window have none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    flat = F.translate(F.col("text"), SPACES[1:], " " * (len(SPACES) - 1))
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"))
    parts = parts.select(
        "doc_id", "source",
        F.array_remove(F.split(flat, " ", -1), "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0).alias("lines"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    counted = parts.select(
        "doc_id", "source", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW))))).alias("windows"),
    )
    keep = [c for c in counted.columns if c != "windows"]
    # most texts repeat no window, and only those that do are sorted
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = counted.select(*keep, F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("placed"))
    same = lambda x, i, at: F.coalesce(F.get("placed", at)["h"] == x["h"], F.lit(False))
    starts = placed.select(*keep, F.sort_array(F.transform(F.filter("placed", lambda x, i: same(x, i, i - 1) | same(x, i, i + 1)), lambda x: x["i"])).alias("starts"))
    return starts.select(*keep, F.coalesce(_covered(F.col("starts")), F.lit(0)).cast("long").alias("n_repeat_words"))


def host_of(source: Column) -> Column:
    """A source's host: what follows ``://`` if there is one, up to ``/``, ``?`` or ``#``, in lower case; null stays null."""
    return F.lower(F.regexp_extract(source, r"(?s)^(?:.*?://)?([^/?#]*)", 1))


def failing(rows: DataFrame) -> DataFrame:
    """``rows`` with ``host`` and a column ``fails_<rule>`` for each rule."""
    return rows.withColumns({"host": host_of(F.col("source"))} | {f"fails_{r}": F.expr(c) for r, c in RULES.items()})


def host_verdicts(failed: DataFrame) -> DataFrame:
    """``host, docs, failures_<rule>, rate_<rule>, host_fails``: one row a host, null as one of them.

    ``rate_<rule>`` is the shrunk rate. With m and v the mean and variance of the hosts' own rates,
    the prior weighs ``m (1 - m) / v - 1`` documents, within ``LEAST_PRIOR`` and ``MOST_PRIOR``.
    """
    hosts = failed.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *(F.count_if(f"fails_{r}").alias(f"failures_{r}") for r in RULES))
    hosts = staged(hosts, "hosts")
    own = lambda r: F.col(f"failures_{r}") / F.col("docs")
    moments = hosts.agg(*(f(own(r)).alias(f"{n}_{r}") for r in RULES for n, f in (("mean", F.avg), ("var", F.var_pop)))).first()  # one row
    rates = {}
    for r in RULES:
        m, v = moments[f"mean_{r}"] or 0.0, moments[f"var_{r}"] or 0.0
        weight = min(MOST_PRIOR, max(LEAST_PRIOR, m * (1 - m) / v - 1)) if v > 0 else MOST_PRIOR
        rates[f"rate_{r}"] = (F.col(f"failures_{r}") + F.lit(m * weight)) / (F.col("docs") + F.lit(weight))
    shrunk = hosts.withColumns(rates)
    return shrunk.withColumn("host_fails", F.greatest(*(F.col(f"rate_{r}") for r in RULES)) > HOST_LIMIT)


def rule_verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host, host_fails``.

    One row for each input row. A null text counts as an empty one and fails; null ids stay null;
    null sources are one host; repeated rows are repeated and count as often; an empty table gives
    an empty one; other columns are ignored.
    """
    failed = staged(failing(measures(docs)), "rule-failures")
    out = attached(failed, staged(host_verdicts(failed), "host-verdicts").select("host", "host_fails"), ["host"])
    own = F.expr(" OR ".join(f"fails_{r}" for r in OWN_RULES))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        own.alias("base_failed"), (~own & ~F.col("host_fails")).alias("kept"), "host", "host_fails",
    )


#: ``rule_verdicts`` over ``documents`` as DuckDB SQL; windows are compared as texts.
SQL = r"""WITH w AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
win AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
m AS (SELECT doc_id, lower(regexp_extract(source, '^(?:.*?://)?([^/?#]*)', 1)) AS host, len(words)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (len(text) - len(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
f AS (SELECT *, n_words < 50 AS a, 100 * n_repeat_words > 50 * n_words AS b, 10 * n_symbols > n_words AS c, 100 * n_dup_lines > 30 * n_lines AS d FROM m),
h AS (SELECT host, count(*) AS docs, [count(*) FILTER (a), count(*) FILTER (b), count(*) FILTER (c), count(*) FILTER (d)] AS failures FROM f GROUP BY host),
r AS (SELECT host, docs, unnest([1, 2, 3, 4]) AS rule, unnest(failures) AS failures FROM h),
mo AS (SELECT rule, avg(failures / docs) AS mean, var_pop(failures / docs) AS v FROM r GROUP BY rule),
prior AS (SELECT rule, mean, CASE WHEN v > 0 THEN least(1e6, greatest(10.0, mean * (1 - mean) / v - 1)) ELSE 1e6 END AS weight FROM mo),
verdict AS (SELECT host, max((failures + mean * weight) / (docs + weight)) > 0.5 AS host_fails FROM r JOIN prior USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, a OR b AS base_failed, NOT (a OR b) AND NOT host_fails AS kept, f.host, host_fails
FROM f JOIN verdict v ON f.host IS NOT DISTINCT FROM v.host"""
