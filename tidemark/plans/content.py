"""Queries on content identity, table comparison and evidence packages; their SQL writes the canonical form by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import identity
from tidemark.operators import promotion
from tidemark.plans.registry import query
from tidemark.sources.staging import staged
from tidemark.sources.views import table

_STAR = {
    "region": "r_regionkey i r_name s", "nation": "n_nationkey i n_name s n_regionkey i", "customer": "c_custkey i c_name s c_nationkey i c_acctbal f c_mktsegment s", "supplier": "s_suppkey i s_name s s_nationkey i s_acctbal f",
    "part": "p_partkey i p_name s p_brand s p_type s p_size i p_retailprice f", "orders": "o_orderkey i o_custkey i o_orderstatus s o_totalprice f o_orderdate t o_orderpriority s",
    "lineitem": "l_orderkey i l_partkey i l_suppkey i l_linenumber i l_quantity f l_extendedprice f l_discount f l_tax f l_returnflag s l_linestatus s l_shipdate t", "events": "event_id i ts t user_id i event_type s value f props s",
    "labels": "doc_id i quality i toxic i", "benchmark": "item_id i text s", "conversations": "conv_id i turn i role s text s", "documents": "doc_id i text s lang s source s n_chars i", "pages": "page_id i url s html s",
}


def _kinds(name: str) -> dict[str, str]:
    words = _STAR[name].split()
    return dict(zip(words[::2], words[1::2], strict=True))


def _plain(c: str) -> str:
    return f"regexp_replace(regexp_replace(CAST({c}::VARCHAR AS DECIMAL(30, 12))::VARCHAR, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


_FORM = {"i": "{c}::VARCHAR", "s": "to_json({c})::VARCHAR", "t": "'\"' || strftime({c}, '%Y-%m-%d %H:%M:%S.%f') || '\"'"}


def json_sql(name: str, columns: list[str] | None = None, of: str = "") -> str:
    """The canonical JSON of a table's row as a SQL expression."""
    kinds = _kinds(name)
    form = lambda c, k: f"'\"' || {_plain(of + c)} || '\"'" if k == "f" else _FORM[k].format(c=of + c)
    parts = [f"'\"{c}\":' || coalesce({form(c, kinds[c])}, 'null')" for c in sorted(columns or kinds)]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def digest_sql(hashed: str) -> str:
    lanes = " || ':' || ".join(f"((sum(('0x' || substr({hashed}, {1 + 15 * k}, 15))::BIGINT)) % 2305843009213693951)::VARCHAR" for k in range(4))
    return f"sha256(count(*)::VARCHAR || ':' || {lanes})"


@query("c1_row_hash", f"SELECT o_orderkey, sha256({json_sql('orders')}) AS hash FROM orders UNION ALL SELECT event_id, sha256({json_sql('events')}) FROM events")
def c1(spark, d):
    o, e = table(spark, d, "orders"), table(spark, d, "events")
    return o.select("o_orderkey", identity.row_hash(o).alias("hash")).unionByName(e.select(F.col("event_id").alias("o_orderkey"), identity.row_hash(e).alias("hash")))


@query("c2_set_digest", f"WITH h AS (SELECT l_returnflag, sha256({json_sql('lineitem')}) AS h FROM lineitem) SELECT l_returnflag, count(*) AS rows, {digest_sql('h')} AS digest FROM h GROUP BY 1")
def c2(spark, d):
    li = table(spark, d, "lineitem")
    return identity.set_digest(li.select("l_returnflag", identity.row_hash(li).alias("h")), ["l_returnflag"], "h")


#: Tables against their rows that another table refers to.
_PAIRS = (("orders", "o_orderkey", "lineitem", "l_orderkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("part", "p_partkey", "lineitem", "l_partkey"), ("supplier", "s_suppkey", "lineitem", "l_suppkey"), ("nation", "n_nationkey", "customer", "c_nationkey"), ("documents", "doc_id", "labels", "doc_id"))


def _pair_sql(t: str, k: str, other: str, f: str) -> str:
    kept = f"SELECT * FROM {t} WHERE {k} IN (SELECT {f} FROM {other})"
    return f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS rows_a, (SELECT count(*) FROM ({kept})) AS rows_b, (SELECT count(*) FROM (SELECT * FROM {t} EXCEPT ALL {kept})) AS only_a, (SELECT count(*) FROM ({kept} EXCEPT ALL SELECT * FROM {t})) AS only_b"


@query("s12_compare_tables", f"SELECT *, only_a = 0 AND only_b = 0 AS same FROM ({' UNION ALL '.join(_pair_sql(*p) for p in _PAIRS)})")
def s12(spark, d):
    out = None
    for t, k, other, f in _PAIRS:
        whole = table(spark, d, t)
        referred = whole.join(table(spark, d, other).select(F.col(f).alias(k)).distinct(), k, "left_semi")
        one = identity.compare_tables(whole, referred).withColumn("table_name", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


@query("s13_inspect_source", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows, {digest_sql('h')} AS digest FROM (SELECT sha256({json_sql(t)}) AS h FROM {t})" for t in _STAR) + f" UNION ALL SELECT 'embeddings', count(*), {digest_sql('h')} FROM (SELECT sha256('{{\"label\":' || coalesce(label::VARCHAR, 'null') || ',\"size\":' || coalesce(len(embedding)::VARCHAR, 'null') || ',\"vec_id\":' || coalesce(vec_id::VARCHAR, 'null') || '}}') AS h FROM embeddings)")
def s13(spark, d):
    """All 14 tables; of an embedding its size, as engines print floating numbers apart."""
    out = None
    for t in (*_STAR, "embeddings"):
        df = table(spark, d, t)
        df = df.select("vec_id", F.size("embedding").alias("size"), "label") if t == "embeddings" else df
        one = identity.table_fingerprint(df).select(F.lit(t).alias("table_name"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


# evidence packages: a part's lines are its evidence; lines that share an id are records of one artifact, first and last

_PAYLOAD = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
_KINDS_SQL = "[" + ", ".join(f"'{k}'" for k in promotion.REQUIRED) + "]"
_EVIDENCE = f"""e AS (SELECT l.*, l_orderkey * 8 + l_linenumber AS evidence_id, {_KINDS_SQL}[1 + (l_orderkey + l_linenumber) % 13] AS kind, sha256({json_sql('lineitem', _PAYLOAD)}) AS h FROM lineitem l),
art AS (SELECT evidence_id, kind, arg_min(h, o) AS stored_hash, arg_max(h, o) AS content_hash, arg_max(l_partkey, o) AS l_partkey, arg_max(l_suppkey, o) AS l_suppkey, arg_max(l_quantity, o) AS l_quantity, arg_max(l_shipdate, o) AS evaluated_at, arg_max(l_tax, o) < 0.08 AS passed, arg_max(l_discount, o) < 0.1 AS measures_pass
    FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS o FROM e) GROUP BY 1, 2),
link AS (SELECT l_partkey AS package_id, kind, evidence_id, h AS evidence_hash FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, kind ORDER BY evidence_id, h) AS n FROM e) WHERE n = 1)"""


def _evidence(spark, d):
    li = table(spark, d, "lineitem")
    li = li.withColumn("h", identity.row_hash(li, _PAYLOAD)).withColumn("evidence_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return li.withColumn("kind", F.element_at(F.array(*map(F.lit, promotion.REQUIRED)), ((F.col("l_orderkey") + F.col("l_linenumber")) % 13 + 1).cast("int")))


def _links(evidence):
    return evidence.groupBy(F.col("l_partkey").alias("package_id"), "kind").agg(F.min(F.struct("evidence_id", "h")).alias("m")).select("package_id", "kind", "m.evidence_id", F.col("m.h").alias("evidence_hash"))


def _artifacts(evidence):
    """Artifacts as their last records have them, with the hash of the first."""
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    last = F.max_by(F.struct("l_tax", "l_discount"), order)
    # the order's columns are the payload's, so first and last payload are the least and greatest of them
    a = evidence.groupBy("evidence_id", "kind").agg(F.min(order).alias("first"), F.max(order).alias("x"), last.alias("y"))
    first = a.select("evidence_id", "kind", "x", "y", "first.*")
    a = first.select("evidence_id", "kind", identity.row_hash(first, _PAYLOAD).alias("stored_hash"), "x.*", "y.*")
    return promotion.evidence_integrity(a, _PAYLOAD, "stored_hash")


@query("v17_evidence_completeness", f"WITH {_EVIDENCE}, need AS (SELECT p_partkey AS package_id, unnest({_KINDS_SQL}) AS kind, unnest(range(13)) AS place FROM part) SELECT package_id, coalesce(string_agg(kind, ',' ORDER BY place) FILTER (evidence_id IS NULL), '') AS missing, bool_and(evidence_id IS NOT NULL) AS complete FROM need LEFT JOIN link USING (package_id, kind) GROUP BY 1")
def v17(spark, d):
    packages = table(spark, d, "part").select(F.col("p_partkey").alias("package_id"))
    gaps = promotion.evidence_gaps(packages, _links(_evidence(spark, d)), "package_id")
    return gaps.select("package_id", F.array_join("missing", ",").alias("missing"), "complete")


@query("v18_evidence_integrity", f"WITH {_EVIDENCE} SELECT evidence_id, kind, stored_hash, content_hash FROM art WHERE stored_hash <> content_hash UNION ALL SELECT -1, 'intact', count(*)::VARCHAR, '' FROM art WHERE stored_hash = content_hash")
def v18(spark, d):
    """Artifacts whose last record is not what their first one was, and how many are intact."""
    a = _artifacts(_evidence(spark, d)).select("evidence_id", "kind", "stored_hash", "content_hash", "intact")
    whole = a.agg(F.count_if("intact").cast("string").alias("stored_hash")).select(F.lit(-1).cast("long").alias("evidence_id"), F.lit("intact").alias("kind"), "stored_hash", F.lit("").alias("content_hash"))
    return a.where("NOT intact").drop("intact").unionByName(whole)


_SEALED = "1998-01-01"


@query("v21_package_promotion", f"""WITH {_EVIDENCE},
old AS (SELECT l_partkey AS package_id, kind, evidence_id, h AS evidence_hash FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, kind ORDER BY evidence_id, h) AS n FROM e WHERE l_shipdate < TIMESTAMP '{_SEALED}') WHERE n = 1),
was AS (SELECT package_id, list((kind, evidence_id, evidence_hash) ORDER BY kind) AS members FROM old GROUP BY 1), now AS (SELECT package_id, list((kind, evidence_id, evidence_hash) ORDER BY kind) AS members FROM link GROUP BY 1),
held AS (SELECT l_partkey AS package_id, count(*) AS periods, avg(l_discount) - 0.045 AS gain FROM lineitem GROUP BY 1),
card AS (SELECT p_partkey AS card_id, p_partkey AS package_id, p_partkey % 10 AS strategy, p_size % 2 AS dataset, p_type, p_size, (p_partkey % 97) / 96.0::DOUBLE AS psr, p_partkey % 10 > 0 AS agree, coalesce(periods, 0) AS periods, gain, was.members AS was, now.members AS made FROM part LEFT JOIN held ON held.package_id = p_partkey LEFT JOIN was ON was.package_id = p_partkey LEFT JOIN now ON now.package_id = p_partkey),
need AS (SELECT card_id, package_id, strategy, dataset, unnest({_KINDS_SQL}) AS k, unnest(range(13)) AS place FROM card WHERE was IS NOT NULL),
per AS (SELECT card_id, place, CASE WHEN art.evidence_id IS NULL THEN 'missing_' || k || '_evidence' ELSE concat_ws(',', CASE WHEN art.l_partkey % 10 <> strategy THEN k || '_strategy_mismatch' END, CASE WHEN CASE WHEN art.l_quantity > 40 THEN art.l_quantity::BIGINT % 2 ELSE own.p_size % 2 END <> dataset THEN k || '_dataset_mismatch' END, CASE WHEN art.evaluated_at < TIMESTAMP '1998-08-01' - INTERVAL 2000 DAY THEN k || '_evidence_stale' END,
    CASE WHEN art.content_hash <> art.stored_hash OR art.stored_hash <> evidence_hash THEN k || '_content_hash_mismatch' END, CASE WHEN NOT art.passed THEN k || '_failed' END,
    CASE WHEN NOT art.measures_pass THEN CASE k WHEN 'capacity' THEN 'capacity_liquidity_limit_exceeded' WHEN 'slippage' THEN 'slippage_sensitivity_exceeds_tolerance' WHEN 'latency' THEN 'latency_signal_decay_failed' WHEN 'stress' THEN 'stress_evidence_weak' WHEN 'parameter_stability' THEN 'parameter_stability_narrow_peak' WHEN 'multiple_testing' THEN 'multiple_testing_not_passed' END END) END AS r
    FROM need LEFT JOIN link ON link.package_id = need.package_id AND link.kind = k LEFT JOIN art ON art.evidence_id = link.evidence_id LEFT JOIN part own ON own.p_partkey = art.l_partkey),
kinds AS (SELECT card_id, string_agg(nullif(r, ''), ',' ORDER BY place) AS r FROM per GROUP BY 1),
said AS (SELECT card.card_id, CASE WHEN was IS NULL THEN 'missing_validation_package' ELSE concat_ws(',', CASE WHEN p_size % 11 = 0 THEN 'validation_package_feature_mismatch' END, CASE WHEN length(p_type) % 7 = 0 THEN 'validation_package_cost_model_mismatch' END, CASE WHEN was <> made THEN 'validation_package_content_hash_mismatch' END, r,
    CASE WHEN NOT agree THEN 'cross_engine_reconciliation_failed' END, CASE WHEN psr < 0.5 THEN 'probabilistic_sharpe_below_threshold' END, CASE WHEN periods < 20 THEN 'insufficient_held_out_periods' WHEN gain < 0 THEN 'held_out_return_below_threshold' END) END AS reasons FROM card LEFT JOIN kinds USING (card_id))
SELECT card_id, reasons, CASE WHEN reasons = '' THEN 'REVIEW_REQUIRED' ELSE 'BLOCKED' END AS status FROM said""")
def v21(spark, d):
    """Parts as strategies: each one's package was sealed at a time, and its lines are what the evidence is now."""
    kind = lambda c: F.element_at(F.array(*map(F.lit, promotion.REQUIRED)), c).alias("kind")
    li = table(spark, d, "lineitem").withColumn("evidence_id", F.col("l_orderkey") * 8 + F.col("l_linenumber")).withColumn("place", ((F.col("l_orderkey") + F.col("l_linenumber")) % 13 + 1).cast("int"))
    # lines are dealt by package before they are hashed, as no hash compresses, and so that a package's links lie together; hashes are bytes, not their text
    lines = li.select("evidence_id", "place", *_PAYLOAD).repartition("l_partkey")
    lines = lines.withColumn("h", F.unhex(identity.row_hash(lines, _PAYLOAD)))
    link = F.struct("evidence_id", "h")
    # what a package holds and what it held when it was sealed come from one pass over its lines; the latter is kept where it differs
    both = lines.groupBy(F.col("l_partkey").alias("package_id"), "place").agg(F.min(link).alias("now"), F.min(F.when(F.col("l_shipdate") < F.lit(_SEALED).cast("timestamp_ntz"), link)).alias("was"))
    both = staged(both.select("package_id", "place", "now", F.col("was").isNotNull().alias("sealed"), F.when(~F.col("was").eqNullSafe(F.col("now")), F.col("was")).alias("was")), "links")
    of = lambda df, c: df.select("package_id", kind(F.col("place")), c["evidence_id"].alias("evidence_id"), c["h"].alias("evidence_hash"))
    links = of(both.where("now IS NOT NULL"), F.col("now"))
    sealed = promotion.package_hashes(of(both.where("sealed"), F.coalesce("was", "now")), "package_id")
    part = table(spark, d, "part")
    key = F.col("p_partkey")
    bind = lambda of, cost: [(key % 10).cast("string").alias("strategy"), (F.col("p_size") % 2).cast("string").alias("dataset"), of.alias("features"), cost.alias("cost_model")]
    held = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("held_out_periods"), (F.avg("l_discount") - 0.045).alias("held_out_return"))
    cards = part.join(held, "p_partkey", "left").select(key.alias("card_id"), key.alias("package_id"), *bind(F.lit("f1"), F.lit("c1")), ((key % 97) / 96.0).alias("probabilistic_sharpe"), (key % 10 > 0).alias("engines_agree"), "held_out_periods", "held_out_return")
    packages = part.select(key.alias("package_id"), *bind(F.when(F.col("p_size") % 11 == 0, "f0").otherwise("f1"), F.when(F.length("p_type") % 7 == 0, "c0").otherwise("c1"))).join(sealed, "package_id")
    of_part = part.select(key.alias("l_partkey"), (F.col("p_size") % 2).cast("string").alias("own"))
    asked = li.join(links.select("evidence_id"), "evidence_id", "left_semi")  # all that a link leads to
    own = _artifacts(asked.select("evidence_id", F.col("place").alias("kind"), *_PAYLOAD, "l_tax", "l_discount")).withColumn("kind", kind(F.col("kind"))).join(of_part, "l_partkey", "left")
    # the data set of an artifact is its strategy's unless its quantity is high and says otherwise
    dataset = F.when((F.col("l_quantity") > 40), (F.col("l_quantity").cast("long") % 2).cast("string"))
    artifacts = own.select("evidence_id", "kind", (F.col("l_partkey") % 10).cast("string").alias("strategy"), F.coalesce(dataset, "own").alias("dataset"), F.col("l_shipdate").alias("evaluated_at"), (F.col("l_tax") < 0.08).alias("passed"), (F.col("l_discount") < 0.1).alias("measures_pass"), F.unhex("stored_hash").alias("stored_hash"), F.unhex("content_hash").alias("content_hash"))
    out = promotion.promotion(cards, packages, links, artifacts, F.lit("1998-08-01").cast("timestamp_ntz"), 2000, 0.5, 20, 0.0)
    return out.select("card_id", F.array_join("reasons", ",").alias("reasons"), "status")
