"""N-gram Jaccard join by multiple-global-order filtering.

A document is the set of its distinct 5-word shingles. Documents with equal sets form one class,
named by a 64-bit hash of the set, and count once. Two classes link when their Jaccard similarity
is at least ``SIMILAR`` percent.

Filters, all exact (each is implied by the similarity bound, so no link is lost):

1. *Own shingles.* A class of n shingles shares at least 80 % of them with any partner, so a class
   with more than n/5 shingles that no other class has can't link. Only shingles in the low
   ``SHARE`` of the hash range are compared here (all of them for small sets). Most documents end
   here, before any pair is formed.
2. *Prefixes under three global token orders*: rarest first, ascending hash, descending hash. With
   p = n - ceil(0.8 n) + 1, two linking sets share a token of their p-prefixes under every order.
   The rarest-first order makes the candidates, within bounds on the sizes and on the tokens that
   come before the common one. Those are intersected with the other two orders on 16-bit parts of
   the prefixes' tokens, and only what is left is verified on whole sets.

Large groups don't make all pairs. In each list of classes that share a prefix token, a pivot is
compared with the others, in a few rounds with other pivots; what links is contracted, and lists
whose members have all met in one component are done. Only pairs that still lie in different
components are formed in the end, each with a member outside its list's largest component, so every
link between components is found exactly.

Hot keys (a set or a token in a third of all rows) are combined before the shuffle where they are
counted; where they are joined, both sides are written tables, so that adaptive execution splits
the key's partition.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import BROADCAST_ROWS, batches_of, bit_table, give_back, identified, identity, passing, staged

#: Words in a shingle.
WORDS = 5
#: Percent of the union that the intersection must reach.
SIMILAR = 80
#: Low share of the hash range that the first filter compares, and the set size up to which it
#: compares all shingles. Sets a quarter larger show all of theirs too, as partners of those.
SHARE, SMALL = 0.3, 64
#: Rounds in which each list compares one pivot with its other components.
PIVOT_ROUNDS = 3
_LOW = np.uint64(int(SHARE * 2**64))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct 64-bit shingle hashes, ascending, of a whole text; empty without words.

    Words are runs of anything but ASCII white space, with A-Z lowered, as bytes.lower() and
    bytes.split() define them. A text of fewer than five words is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    coded = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    with np.errstate(over="ignore"):
        width = min(WORDS, len(words))
        h = np.full(len(words) - width + 1, np.uint64(width))
        for k in range(width):
            h = _mix(h * _ODD + coded[k : len(coded) - width + 1 + k])
    return np.unique(h)


def _signature(tokens: np.ndarray) -> int:
    """One 64-bit value for a set: equal sets have equal ones."""
    with np.errstate(over="ignore"):
        folded = _mix(tokens + _ODD).sum(dtype=np.uint64) + np.uint64(len(tokens)) * _ODD
        return int(_mix(np.array([folded]))[0].astype(np.int64))


#: Texts whose sets a Python worker holds together, and those of an Arrow batch.
SLICE, BATCH = 128, 1024
_PROFILE = T.StructType([T.StructField("n", T.LongType()), T.StructField("sig", T.LongType()), T.StructField("low", T.ArrayType(T.LongType()))])
_SETS = T.StructType([T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("lead", T.ArrayType(T.ShortType())), T.StructField("trail", T.ArrayType(T.ShortType()))])


def _sliced(kinds: pa.Schema, made: list[str], columns: Callable[[list[np.ndarray]], list]):
    """Arrow batches with the columns ``made`` of their texts' sets in place of ``text``, ``SLICE`` rows a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = [shingle_set(t) for t in part.column("text").to_pylist()]
                kept = [part.column(n).cast(kinds.field(n).type) for n in part.schema.names if n != "text"]
                new = [pa.array(c, kinds.field(n).type) for n, c in zip(made, columns(sets), strict=True)]
                yield pa.RecordBatch.from_arrays(kept + new, schema=kinds)
        batch = part = sets = kept = new = None
        give_back()

    return run


def _with_sets(df: DataFrame, made: T.StructType, columns: Callable[[list[np.ndarray]], list]) -> DataFrame:
    """``df`` with what ``columns`` makes of its texts' sets in place of ``text``, which comes last."""
    schema = T.StructType([f for f in df.schema.fields if f.name != "text"] + made.fields)
    return df.mapInArrow(_sliced(to_arrow_schema(schema), made.names, columns), schema)


def _profile(sets: list[np.ndarray]) -> list:
    low = [s if len(s) <= SMALL * 5 // 4 else s[: np.searchsorted(s, _LOW)] for s in sets]
    return [[len(s) for s in sets], [_signature(s) for s in sets], [x.astype(np.int64) for x in low]]


def _whole_set(sets: list[np.ndarray]) -> list:
    short = [(s & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16) for s in sets]  # equal for equal tokens
    size = [prefix_length(len(s)) for s in sets]
    return [[s.astype(np.int64) for s in sets], [np.unique(c[:p]) for c, p in zip(short, size, strict=True)], [np.unique(c[-p:]) for c, p in zip(short, size, strict=True)]]


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text, h, g`` of every row; the last two are hashes of the whole row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *identity(docs))


def profiles(docs: DataFrame) -> DataFrame:
    """``doc_id, h, g, n, sig, low`` of every row: the set's size and 64-bit name, and the shingles
    that the first filter compares."""
    return _with_sets(_rows(docs).select("doc_id", "h", "g", "text"), _PROFILE, _profile)


def _classes(profile: DataFrame) -> DataFrame:
    """``sig, n, least, first``: a class for each different set, its least id (null where all are)
    and one of its rows. Copies are combined before the shuffle."""
    each = profile.where("n > 0").groupBy("sig")
    return each.agg(F.max("n").alias("n"), F.min("doc_id").alias("least"), F.min(F.struct("h", "g")).alias("first"))


def _survivors(shown: DataFrame, classes: DataFrame) -> DataFrame:
    """``sig, n, h, g``: the classes that may link with another, and a row of each. ``shown`` has ``sig, low`` of every row."""
    # signed values below _LOW, read as unsigned, are the non-negative ones below it
    low_bound = int(_LOW)
    own = (
        shown.select("sig", F.explode("low").alias("token"))
        .groupBy("token")
        .agg(F.min("sig").alias("sig"), F.max("sig").alias("other"))
        .where(F.col("sig") == F.col("other"))
        .groupBy("sig")
        .agg(F.count(F.lit(1)).alias("own"), F.count_if(F.col("token").between(0, low_bound - 1)).alias("own_low"))
    )
    counted = F.when(F.col("n") <= SMALL, F.col("own")).otherwise(F.col("own_low"))
    may = F.coalesce(counted, F.lit(0)) * 100 <= F.col("n") * (100 - SIMILAR)
    return classes.join(own, "sig", "left").where(may).select("sig", "n", "first.h", "first.g")


def _full_sets(docs: DataFrame, survivors: DataFrame) -> DataFrame:
    """``sig, n, tokens, lead, trail`` of each surviving class.

    ``tokens`` ascend as unsigned values; ``lead`` and ``trail`` are 16-bit parts of the prefixes
    under the ascending and the descending order.
    """
    wanted = survivors.where("n > 0")
    table = bit_table(wanted.select(F.col("h").alias("hash")), wanted.count())

    @F.pandas_udf("boolean")
    def may_survive(h: pd.Series) -> pd.Series:
        return pd.Series(table.value.has(h.to_numpy(np.int64).view(np.uint64)))

    # The table, whose size is bounded, leaves few texts beside those of survivors to be shuffled. A row may be repeated
    # as it is: one stays, before the join. Its key is the join's, so texts are shuffled once and sets never; and as this
    # shuffle always stands between them, no task runs two Python workers.
    found = _rows(docs).where(may_survive("h")).dropDuplicates(["h", "g"]).join(wanted, ["h", "g"]).select("sig", "n", "text")
    return _with_sets(found, _SETS, _whole_set)


def prefix_length(n):
    """n - ceil(SIMILAR/100 n) + 1, for a Column or a number."""
    return (n * (100 - SIMILAR) / 100).cast("long") + 1 if hasattr(n, "cast") else n * (100 - SIMILAR) // 100 + 1


def _rare_prefixes(sets: DataFrame) -> DataFrame:
    """``token, sig, n, pos``: prefixes under the order (classes that have the token, token).

    ``pos`` is the token's place in its set, from 0. Tokens of one class come first in that order
    and match nothing, so they only use up places.
    """
    each = sets.select("sig", "n", F.explode("tokens").alias("token"))
    often = staged(each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "token-counts")
    shared = each.join(often, "token").groupBy("sig", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    own = F.col("n") - F.size("ranked")
    room = prefix_length(F.col("n")) - own
    return (
        shared.where(room > 0)
        .select("sig", "n", own.alias("own"), F.posexplode(F.slice("ranked", F.lit(1), room.cast("int"))).alias("k", "r"))
        .select(F.col("r.token").alias("token"), "sig", "n", (F.col("own") + F.col("k")).alias("pos"))
    )


def _may_link(n_a, n_b, pos_a, pos_b):
    """Bounds on a pair met at its first common token: by size, and by the tokens that came before.

    Linking sets share at least (n_a + n_b) SIMILAR / (100 + SIMILAR) tokens and differ by at most
    (n_a + n_b) (100 - SIMILAR) / (100 + SIMILAR); the tokens before the first common one are in
    the difference, and the common ones are among the others of either set.
    """
    by_size = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * SIMILAR
    common = F.least(n_a - pos_a, n_b - pos_b) * (100 + SIMILAR) >= (n_a + n_b) * SIMILAR
    return by_size & common & ((pos_a + pos_b) * (100 + SIMILAR) <= (n_a + n_b) * (100 - SIMILAR))


def _both_ends(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b) with the given columns of either class, named by ``_a`` and ``_b``."""
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("sig").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
    return pairs


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` of those pairs that link.

    The pairs, which share a token of their rarest-first prefixes, are cut down to those that also
    share one under both hash orders. Only then do whole sets travel, and common tokens are counted.
    """
    pairs = staged(pairs, "candidates")
    ends = _both_ends(pairs, sets, "lead", "trail")
    near = staged(ends.where(F.arrays_overlap("lead_a", "lead_b") & F.arrays_overlap("trail_a", "trail_b")).select("a", "b"), "intersected")
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    if 2 * near.count() <= BROADCAST_ROWS:  # late rounds have few pairs, and then few of the whole sets travel
        ends = near.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        sets = sets.join(F.broadcast(ends), "sig", "left_semi")
    whole = _both_ends(near, sets, "n", "tokens").withColumn("both", both)
    return staged(whole.where(F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * SIMILAR).select("a", "b"), "verified")


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """``sig, comp``: the least vertex that each of ``vertices`` (sig) reaches over ``links`` (a, b).

    Each round hooks every vertex to its least neighbour, follows hooks once, and contracts the
    links to the vertices they lead to; rounds grow with the logarithm of a component's length.
    """
    label = staged(vertices.select("sig", F.col("sig").alias("comp")), "labels")
    live = staged(links.where("a <> b").select("a", "b").distinct(), "links")
    while not live.isEmpty():
        ends = live.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(live.select(F.col("b").alias("v"), F.col("a").alias("w")))
        hook = staged(ends.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("to")), "hooks")
        onward = hook.select(F.col("v").alias("to"), F.col("to").alias("further"))
        jump = staged(hook.join(onward, "to", "left").select("v", F.coalesce("further", "to").alias("to")), "jumps")
        label = staged(label.join(jump, F.col("comp") == F.col("v"), "left").select("sig", F.coalesce("to", "comp").alias("comp")), "labels")
        moved_a = live.join(jump.select(F.col("v").alias("a"), F.col("to").alias("a_to")), "a").select("a_to", "b")
        moved = moved_a.join(jump.select(F.col("v").alias("b"), F.col("to").alias("b_to")), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        live = staged(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return label


def class_components(sets: DataFrame, pivot_rounds: int = PIVOT_ROUNDS) -> DataFrame:
    """``sig, comp`` for every class in ``sets`` (sig, n, tokens, lead, trail)."""
    lists = staged(_rare_prefixes(sets), "prefixes")
    comp = sets.select("sig", F.col("sig").alias("comp"))
    for k in range(pivot_rounds):
        here = staged(lists.join(comp, "sig"), "lists") if k else lists.withColumn("comp", F.col("sig"))
        pivot = here.groupBy("token").agg(
            F.min_by(F.struct("sig", "comp", "n", "pos"), _centrality(k)).alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
        )
        pivot = staged(pivot.where("lo <> hi").select("token", "p"), "pivots")
        if pivot.isEmpty():
            return comp
        lists = staged(here.join(pivot, "token").select("token", "sig", "n", "pos", "comp", "p"), "open-lists")
        met = lists.where("comp <> p.comp").where(_may_link(F.col("n"), F.col("p.n"), F.col("pos"), F.col("p.pos")))
        pairs = met.select(F.least("sig", "p.sig").alias("a"), F.greatest("sig", "p.sig").alias("b")).distinct()
        lists = lists.select("token", "sig", "n", "pos")
        comp = _joined(comp, _verified(pairs, sets))
    return _joined(comp, _verified(_open_pairs(lists, comp), sets))


def _centrality(k: int):
    """What a list's pivot has least of: in the first round the share of its set that came before
    the common token, which few others can share; then a hash of round and token, so that a class
    meets another pivot in each of its lists."""
    if k == 0:
        return F.struct((F.col("pos") / F.col("n")).alias("before"), F.xxhash64("sig").alias("x"), "sig")
    return F.struct(F.xxhash64("sig", "token", F.lit(k)).alias("x"), "sig")


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` after the components at both ends of each link have become one."""
    if links.isEmpty():
        return comp
    ends = links
    for end in ("a", "b"):
        ends = ends.join(comp.select(F.col("sig").alias(end), F.col("comp").alias(f"c{end}")), end)
    ends = staged(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct(), "component-links")
    touched = ends.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    merged = components(touched, ends).select(F.col("sig").alias("comp"), F.col("comp").alias("root"))
    return staged(comp.join(merged, "comp", "left").select("sig", F.coalesce("root", "comp").alias("comp")), "components")


def _open_pairs(lists: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs of one list whose components differ; one of them lies outside the list's largest.

    Sizes of linking sets lie in the same or in neighbouring bands of a factor of 100 / SIMILAR, so
    bands are part of the key, and a list is dealt over as many keys as it has bands.
    """
    here = staged(lists.join(comp, "sig"), "lists")
    parts = here.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = parts.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    main = staged(main.select("token", "main"), "main-components")
    band = F.floor(F.log("n") / math.log(100 / SIMILAR)).cast("int")
    here = staged(here.join(main, "token").select("token", "sig", "comp", "n", "pos", band.alias("band"), (F.col("comp") == F.col("main")).alias("is_main")), "open")
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    minor = here.where("NOT is_main").select("token", F.col("sig").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("pos").alias("px"), near)
    others = here.select("token", F.col("sig").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"), F.col("pos").alias("py"), "is_main", "band")
    may = _may_link(F.col("nx"), F.col("ny"), F.col("px"), F.col("py"))
    found = minor.join(others, ["token", "band"]).where(F.expr("cx <> cy AND (is_main OR x < y)") & may)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _grouped(docs: DataFrame) -> DataFrame:
    """``doc_id, h, g, n, root, component_id`` of every row; rows of one root are one group."""
    # shingles are made once more for the first filter: as a table they would take as much disk as the texts
    profile = staged(profiles(docs).drop("low"), "profiles")
    classes = staged(_classes(profile), "classes")
    survivors = staged(_survivors(profiles(docs).where("n > 0").select("sig", "low"), classes), "survivors")
    sets = staged(_full_sets(docs, survivors), "sets")
    comp = class_components(sets)
    known = classes.select("sig", "least").join(comp, "sig", "left").select("sig", "least", F.coalesce("comp", "sig").alias("root"))
    known = staged(known, "class-roots")
    roots = staged(known.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    labels = staged(known.select("sig", "root").join(roots, "root"), "class-labels")
    return profile.select("doc_id", "h", "g", "n", "sig").join(labels, "sig", "left")


def similar_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    ``component_id`` is the least id that the document reaches over links, itself included. A text
    that is null or has no words has 0 shingles and links with nothing: its component is its own
    id. Rows without an id take part as the others do: theirs is the least id of their group, null
    where no row of it has one. Repeated rows come out repeated; an id that occurs with several
    texts is as many documents, each in its own group. An empty table gives an empty one; other
    columns are ignored, whatever their names.
    """
    with passing(docs.sparkSession), batches_of(docs.sparkSession, BATCH):
        found = _grouped(docs).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        return staged(found, "similar", stays=True)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one row of each group.

    The row with the least id stays (a null id comes last; then the least hash of the row). Rows
    whose text is null or has no words are in no group: all stay. An empty table gives an empty one.
    """
    with passing(docs.sparkSession), batches_of(docs.sparkSession, BATCH):
        found = staged(_grouped(docs).where("n > 0").select("doc_id", "h", "g", "root"), "groups")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h", "g")).alias("w")
        winners = staged(found.groupBy("root").agg(first).select("w.h", "w.g"), "winners")
        drops = staged(found.join(winners, ["h", "g"], "left_anti").select("h", "g").distinct(), "drops", stays=True)
        again = found.join(winners, ["h", "g"], "left_semi").groupBy("h", "g").count().where("count > 1").select("h", "g")
        again = staged(again, "repeated", stays=True)
    kept = identified(docs).join(drops, ["h", "g"], "left_anti")
    if not again.isEmpty():  # rows repeated as they are
        once = kept.join(again, ["h", "g"], "left_semi").dropDuplicates(["h", "g"])
        kept = kept.join(again, ["h", "g"], "left_anti").unionByName(once)
    return kept.select("row.*")
