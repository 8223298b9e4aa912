"""Phrase collocations by an FM-index per shard over word ids.

A shard is a stretch of texts of one language, bounded in bytes. Its words become ids with a 0 at
every break, and two Burrows-Wheeler transforms are made, of the ids and of their reversal, with
suffixes sorted by their first words only (as many as the longest phrase asks for). An interval of
either order stands for a phrase; both are kept in step. Extending intervals to the left and to the
right enumerates the phrases with one word more and their counts, which are then summed across
shards; a phrase's largest left and right extensions come from the sums of the phrases one longer.

Only phrases with ``LEAST`` occurrences matter, and every part of one has as many. So words are
counted first, then pairs, and so on, and each pass leaves a bit table of the hashes of those that are
frequent. The tables only prune: their size is bounded, and a fuller one lets more through, but counts
are exact and the bar is applied to exact counts, so the result is the same. Phrases travel as the
64-bit hashes of their words, and get their texts when the frequent ones are known.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BitTable, attached, bit_table, staged

LEAST = 100
LONGEST = 5
TOP = 2000
NO_LANG = "und"
#: Bytes of text in a shard.
SHARD_BYTES = 6 << 20
#: Upper case to lower case, tabs to spaces, and the characters that end a piece to line breaks.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
SEED = 42  # that of the xxhash64 function of Spark SQL
MIX = np.uint64(0x9E3779B97F4A7C15)


# words of a shard ------------------------------------------------------------------------------------


@dataclasses.dataclass
class Shard:
    """Word ids in order (0: a break), each with the weight of its stretch, and what the ids stand for."""

    lang: str
    ids: np.ndarray
    weight: np.ndarray
    words: list[bytes]  # of id k + 1
    hashes: np.ndarray  # of id k; that of 0 is not used


def tokens(blob: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of folded text, the numbers of their pieces, and the places where they start."""
    buf = np.frombuffer(blob, np.uint8)
    word = (buf != 32) & (buf != 10)
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf[word])])
    return words, np.searchsorted(np.flatnonzero(buf == 10), starts), starts


def hashed_words(lang: str, words: list[bytes]) -> np.ndarray:
    """``xxhash64(lang, word)`` of Spark SQL as unsigned numbers, after one for the id 0."""
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), SEED)
    return np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in words)], np.uint64)


def shard_of(lang: str, blobs: list[tuple[bytes, int]], frequent: BitTable | None = None) -> Shard:
    """A shard of folded texts with weights; words that ``frequent`` lacks become breaks."""
    words, piece, starts = tokens(b"\n".join(b for b, _ in blobs))
    coded = words.dictionary_encode()
    ids, kinds = coded.indices.to_numpy() + np.int32(1), coded.dictionary.to_pylist()
    hashes = hashed_words(lang, kinds)
    if all(w == 1 for _, w in blobs):
        weight = np.ones(len(ids), np.int8)
    else:
        ends = np.cumsum([len(b) + 1 for b, _ in blobs])
        weight = np.array([w for _, w in blobs], np.int8)[np.searchsorted(ends, starts, side="right")]
    if frequent is not None:
        known = frequent.has(hashes)
        known[0] = False
        place = np.cumsum(known, dtype=np.int32)
        kinds, hashes = [w for w, k in zip(kinds, known[1:], strict=True) if k], np.concatenate([hashes[:1], hashes[known]])
        ids = np.where(known[ids], place[ids], np.int32(0))
    return Shard(lang, *with_breaks(ids, weight, piece[1:] != piece[:-1]), kinds, hashes)


def with_breaks(ids: np.ndarray, weight: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and weights with a 0 first, last and wherever neighbours are ``apart``, and with runs of 0 as one."""
    at = np.arange(1, len(ids) + 1)
    at[1:] += np.cumsum(apart)
    size = at[-1] + 2 if len(ids) else 1
    out, w = np.zeros(size, np.int32), np.zeros(size, np.int8)
    out[at], w[at] = ids, weight
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep], w[keep]


def restricted(shard: Shard, pairs: BitTable) -> Shard:
    """The shard with a break between neighbours whose pair is not frequent, without words that then stand alone."""
    ids, h = shard.ids, shard.hashes
    held = (ids[:-1] != 0) & (ids[1:] != 0)
    at = np.flatnonzero(held)
    held[at] = pairs.has(joined(h[ids[at]], h[ids[at + 1]]))
    inside = np.zeros(len(ids), bool)
    inside[:-1] |= held
    inside[1:] |= held
    left = np.flatnonzero(inside)
    apart = (np.diff(left) > 1) | ~held[left[:-1]] if len(left) else np.zeros(0, bool)
    return Shard(shard.lang, *with_breaks(ids[left], shard.weight[left], apart), shard.words, h)


def joined(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word and that of the last word."""
    with np.errstate(over="ignore"):
        mixed = (head ^ (head >> np.uint64(29))) * MIX + word
        return mixed ^ (mixed >> np.uint64(32))


# index -----------------------------------------------------------------------------------------------


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of the (at least) ``depth`` ids that begin there; past the end stand zeros."""
    rank, done = ids, 1
    while True:
        key = rank.astype(np.int64)
        key *= int(rank.max()) + 1
        key[:-done] += rank[done:]
        done *= 2
        if done >= depth or done >= len(ids):
            return np.argsort(key, kind="stable").astype(np.int32)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int32)


class Half:
    """One direction: the transform, and where a row's preceding id leads."""

    def __init__(self, ids: np.ndarray, depth: int):
        self.order = suffix_order(ids, depth)
        before = ids[self.order - 1]  # the id before the first is the last one, a break
        self.rows = np.argsort(before, kind="stable").astype(np.int32)  # row that leads to each row: the inverse of the LF mapping
        self.first = before[self.rows]


@dataclasses.dataclass
class Intervals:
    """Phrases of one length as rows ``low .. low + size`` of the index and the same many from ``mirror`` of the reversed one."""

    length: int
    low: np.ndarray
    mirror: np.ndarray
    size: np.ndarray

    def take(self, which: np.ndarray) -> Intervals:
        return Intervals(self.length, self.low[which], self.mirror[which], self.size[which])


class BiIndex:
    """A bidirectional index of a shard for phrases of up to ``depth`` words."""

    def __init__(self, shard: Shard, depth: int):
        self.shard, self.depth = shard, depth

    @functools.cached_property
    def forth(self) -> Half:
        return Half(self.shard.ids, self.depth)

    @functools.cached_property
    def back(self) -> Half:
        """Made when phrases are first extended to the right."""
        return Half(self.shard.ids[::-1], self.depth)

    @functools.cached_property
    def sums(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.shard.weight[self.forth.order], dtype=np.int64)])

    def words(self) -> Intervals:
        counts = np.bincount(self.shard.ids, minlength=len(self.shard.hashes))
        low = np.cumsum(counts) - counts
        return Intervals(1, low[1:], low[1:], counts[1:]).take(np.flatnonzero(counts[1:]))

    def left(self, parents: Intervals) -> Intervals:
        """All extensions of ``parents`` by one word before, in order of (parent, word)."""
        return self._extended(self.forth, parents)

    def right(self, parents: Intervals) -> Intervals:
        """All extensions by one word after: the same on the reversed index."""
        turned = self._extended(self.back, Intervals(parents.length, parents.mirror, parents.low, parents.size))
        return Intervals(turned.length, turned.mirror, turned.low, turned.size)

    def _extended(self, half: Half, parents: Intervals) -> Intervals:
        label = np.full(len(half.order), -1, np.int32)
        label[_spread(parents.low, parents.size)] = np.repeat(np.arange(len(parents.low), dtype=np.int32), parents.size)
        led = label[half.rows]  # the parent whose row leads here
        fresh = np.ones(len(led), bool)
        fresh[1:] = (led[1:] != led[:-1]) | (half.first[1:] != half.first[:-1])
        low = np.flatnonzero(fresh)
        size = np.diff(np.append(low, len(led)))
        parent, word = led[low], half.first[low]
        mine = np.flatnonzero(parent >= 0)
        mine = mine[np.argsort(parent[mine], kind="stable")]  # by parent, words ascending
        low, size, parent, word = low[mine], size[mine], parent[mine], word[mine]
        # in the other order a parent's rows stand by the id beside it: smaller ids, the break among them, come first
        ahead = np.cumsum(size) - size
        start = np.searchsorted(parent, np.arange(len(parents.low)))
        offset = ahead - ahead[start[parent]] if len(parent) else ahead
        out = Intervals(parents.length + 1, low, parents.mirror[parent] + offset, size)
        return out.take(np.flatnonzero(word != 0))

    def counts(self, of: Intervals) -> np.ndarray:
        return self.sums[of.low + of.size] - self.sums[of.low]

    def places(self, of: Intervals) -> np.ndarray:
        return self.forth.order[of.low]

    def word_hashes(self, of: Intervals) -> list[np.ndarray]:
        """The hashes of the phrases' first, second, ... words."""
        at = self.places(of)
        return [self.shard.hashes[self.shard.ids[at + k]] for k in range(of.length)]

    def texts(self, of: Intervals) -> list[str]:
        at = self.places(of)
        return [b" ".join(self.shard.words[self.shard.ids[p + k] - 1] for k in range(of.length)).decode() for p in at]


def hashed(words: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases from those of their words."""
    return functools.reduce(joined, words)


def _spread(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All rows of intervals, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - size), size)


def phrases(index: BiIndex, longest: int, tables: dict[int, BitTable]) -> Iterator[Intervals]:
    """Intervals of all phrases of 2 to ``longest`` words whose parts are in the tables of their lengths.

    Pairs come by extension to the left, triples to the right, and so on; the part of a phrase that
    was not its parent is looked up.
    """
    now = index.words()
    for n in range(2, longest + 1):
        now = index.left(now) if n % 2 == 0 else index.right(now)
        if n > 2 and n - 1 in tables:
            words = index.word_hashes(now)
            now = now.take(np.flatnonzero(tables[n - 1].has(hashed(words[:-1] if n % 2 == 0 else words[1:]))))
        if not len(now.low):
            return
        yield now
        if n in tables:
            now = now.take(np.flatnonzero(tables[n].has(hashed(index.word_hashes(now)))))


# shards of a table -----------------------------------------------------------------------------------


def stretches(blob: bytes, most: int, reach: int = LONGEST - 1) -> Iterator[tuple[bytes, int]]:
    """A folded text as stretches of about ``most`` bytes with weights.

    A long text is cut between words. What spans a cut is counted in a seam, the ``reach`` words on
    either side; the two halves of a seam, which their stretches have counted already, weigh -1.
    """
    start = 0
    while len(blob) - start > most:
        cuts = [c for c in (blob.find(b" ", start + most), blob.find(b"\n", start + most)) if c >= 0]
        if not cuts:
            break
        cut = min(cuts)
        yield blob[start:cut], 1
        head = blob[start:cut].rsplit(None, reach)
        ahead = blob[start:cut][len(head[0]) if len(head) > reach else 0 :]
        behind = _first_words(blob, cut, reach)
        yield from ((ahead + behind, 1), (ahead, -1), (behind, -1))
        start = cut
    yield blob[start:], 1


def _first_words(blob: bytes, at: int, n: int) -> bytes:
    end, size = at, 1024
    while True:
        some = blob[at : at + size]
        rest = some.split(None, n)
        if len(rest) > n:
            return some[: len(some) - len(rest[n])]
        if at + size >= len(blob):
            return blob[at:]
        end, size = end + size, size * 4


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[tuple[bytes, int]]]]:
    """Languages and folded texts with weights, about ``most`` bytes at a time."""
    waiting: dict[str, list] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            raw = text.as_buffer()
            if raw is None:
                continue
            for blob, weight in stretches(raw.to_pybytes().translate(FOLD), most):
                waiting.setdefault(lang, []).append((blob, weight))
                sizes[lang] = sizes.get(lang, 0) + len(blob) + 1
                if sizes[lang] >= most:
                    yield lang, waiting.pop(lang)
                    del sizes[lang]
        if sum(sizes.values()) >= 4 * most:  # many languages: none of them alone fills a shard
            yield from waiting.items()
            waiting, sizes = {}, {}
    yield from waiting.items()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_counts(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang, phrase, f``: occurrences of every word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, blobs in shards(batches, shard_bytes):
            coded = tokens(b"\n".join(b for b, w in blobs if w == 1))[0].dictionary_encode()
            total = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            for half in (b for b, w in blobs if w == -1):  # their words are in a stretch and in a seam
                for word in half.split():
                    total[coded.dictionary.index(word).as_py()] -= 1
            words = coded.dictionary
            words = pa.Array.from_buffers(pa.string(), len(words), words.buffers(), offset=words.offset)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(words)), words, pa.array(total)], ["lang", "phrase", "f"])

    return _rows(docs).mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _columns(length: int) -> list[str]:
    return [f"w{k}" for k in range(length)]


def phrase_counts(docs: DataFrame, length: int, tables: dict, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``w0 .. , f``: occurrences of the phrases of ``length`` words, as hashes, whose parts are in the tables."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {n: t.value for n, t in tables.items()}
        for index in indexes(batches, length, known, shard_bytes):
            for found in phrases(index, length, known):
                if found.length == length:
                    words = [pa.array(w.view(np.int64)) for w in index.word_hashes(found)]
                    yield pa.RecordBatch.from_arrays([*words, pa.array(index.counts(found))], [*_columns(length), "f"])

    kinds = ", ".join(f"{c} long" for c in _columns(length))
    return _rows(docs).mapInArrow(count, f"{kinds}, f long").groupBy(*_columns(length)).agg(F.sum("f").alias("f"))


def indexes(batches: Iterator[pa.RecordBatch], depth: int, known: dict[int, BitTable], shard_bytes: int) -> Iterator[BiIndex]:
    for lang, blobs in shards(batches, shard_bytes):
        shard = shard_of(lang, blobs, known.get(1))
        if 2 in known:
            shard = restricted(shard, known[2])
        if len(shard.ids) > 2:
            yield BiIndex(shard, depth)


def phrase_table(phrases: DataFrame, length: int, rows: int):
    """Broadcast table of the hashes of phrases ``w0 ..``."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [batch.column(c).to_numpy().view(np.uint64) for c in _columns(length)]
            yield pa.RecordBatch.from_arrays([pa.array(hashed(words).view(np.int64))], ["hash"])

    return bit_table(phrases.select(*_columns(length)).mapInArrow(hashes, "hash long"), rows)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``lang, n`` (all words); ``h, lang, word`` and ``words (array of h), f`` of the words and phrases of up to ``longest`` words with ``f >= least``."""
    all_words = staged(word_counts(docs, shard_bytes), "word-counts")
    totals = staged(all_words.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
    words = staged(all_words.where(F.col("f") >= least).select(F.xxhash64("lang", "phrase").alias("w0"), "lang", "phrase", "f"), "words")
    found, tables = words.select(F.array("w0").alias("words"), "f"), {1: phrase_table(words, 1, words.count())}
    for length in range(2, longest + 1):
        level = staged(phrase_counts(docs, length, tables, shard_bytes).where(F.col("f") >= least), f"phrases-{length}")
        found = found.unionByName(level.select(F.array(*_columns(length)).alias("words"), "f"))
        rows = level.count() if length < longest else 0
        if not rows:
            break
        tables[length] = phrase_table(level, length, rows)
    return totals, words.select(F.col("w0").alias("h"), "lang", F.col("phrase").alias("word")), found


# collocations ----------------------------------------------------------------------------------------


def extensions(found: DataFrame) -> DataFrame:
    """``words, left_most, right_most``: the most occurrences of a phrase with one certain word before it, and after it."""
    n = F.size("words")
    longer = found.where(n > 1).select("f", F.explode(F.array(F.struct(F.slice("words", F.lit(2), n - 1).alias("words"), F.lit(True).alias("before")), F.struct(F.slice("words", F.lit(1), n - 1).alias("words"), F.lit(False).alias("before")))).alias("x"))
    return longer.groupBy("x.words").agg(F.max(F.when(F.col("x.before"), F.col("f"))).alias("left_most"), F.max(F.when(~F.col("x.before"), F.col("f"))).alias("right_most"))


def with_texts(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``phrases`` (words, distinct) with ``lang`` and ``phrase``, the words' texts joined by spaces."""
    each = phrases.select("words", F.posexplode("words").alias("k", "h")).join(words, "h")
    texts = each.groupBy("words").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return phrases.join(texts, "words")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases.

    A phrase that a longer candidate with as many occurrences contains is dropped; as counts never
    grow with length, one longer by one word shows it. Products are decimals of 38 digits, so they
    are exact. A null language is ``und``, null texts are empty; repeated rows and rows without an id
    count like others; an empty table gives an empty one; other columns are ignored.
    """
    totals, words, found = frequent_phrases(docs, least, longest, shard_bytes)
    kept = found.where(F.size("words") > 1).join(extensions(found.where(F.size("words") > 2)), "words", "left")
    kept = kept.where(F.greatest(F.coalesce("left_most", F.lit(0)), F.coalesce("right_most", F.lit(0))) < F.col("f"))
    kept = staged(with_texts(kept.select("words", F.col("f").alias("a")), words), "candidates")
    size = F.size("words")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("rest"))
    counts = lambda part, name: found.select(F.col("words").alias(part), F.col("f").alias(name))
    cuts = attached(cuts.join(counts("first", "l"), "first").join(counts("rest", "r"), "rest"), totals, ["lang"])
    score = F.expr("CAST((CAST(1000 AS DECIMAL(6, 0)) * CAST(a AS DECIMAL(16, 0)) * CAST(n AS DECIMAL(16, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0))) AS BIGINT)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # first within parts of a language, so that no task orders all of it
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return some.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: ``collocations`` over ``documents`` as DuckDB SQL: every phrase of up to five words, counted plainly.
SQL = rf"""WITH pieces AS (SELECT row_number() OVER () AS pid, lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, '{NO_LANG}') AS lang, text FROM documents)),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS f FROM starts, range(1, {LONGEST + 1}) AS t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, phrase, k, f FROM grams WHERE f >= {LEAST}),
cand AS (SELECT * FROM often WHERE k > 1),
kept AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand x WHERE x.lang = c.lang AND x.k > c.k AND x.f >= c.f AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, f AS a, c, array_to_string(string_split(phrase, ' ')[1 : c], ' ') AS head, array_to_string(string_split(phrase, ' ')[c + 1 :], ' ') AS rest FROM kept, range(1, {LONGEST}) AS t(c) WHERE c < k),
scored AS (SELECT lang, cuts.phrase, a, c, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score FROM cuts JOIN often x USING (lang) JOIN often y USING (lang) JOIN total USING (lang) WHERE x.phrase = head AND y.phrase = rest),
best AS (SELECT lang, phrase, a, n, min({{s: score, c: c, l: l, r: r}}) AS m FROM scored GROUP BY ALL),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY m.s DESC, a DESC, encode(phrase)) AS rank, phrase, a, m.l AS l, m.r AS r, n, m.s::BIGINT AS score FROM best)
SELECT * FROM ranked WHERE rank <= {TOP}"""
