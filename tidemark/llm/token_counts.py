"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as one symbol a byte, held in a doubly linked list. A heap holds every adjacent
pair that has a merge rank; the lowest rank (leftmost first) is popped, its two symbols become one,
and the two new neighbour pairs are pushed. Entries whose pair has changed meanwhile are skipped.
The count is initial symbols minus merges; no identifiers are produced.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.chunks import ChunkMemory, Spanning, lines_of_chunks

#: The pre-tokenizer of byte-level vocabularies (a fixed value of the public vocabulary file).
#: ``\s`` is written out because the library's white space leaves out U+001C..U+001F.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+"
)
#: The memory of a Python worker is emptied when it holds this many chunks.
REMEMBER_CHUNKS = 1_000_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class MergeTable:
    """Ranks of mergeable pairs, read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.first = [vocab[c] for c in byte_alphabet()]
        self.rank = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None

    def count(self, word: bytes) -> int:
        n = len(word)
        if n < 2:
            return n
        rank, made = self.rank, self.made
        sym = [self.first[b] for b in word]
        heap = []
        for i in range(n - 1):
            r = rank.get(sym[i] << 20 | sym[i + 1])
            if r is not None:
                heap.append(r << 40 | i)
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 40, top & 0xFFFFFFFFFF
            j = after[i]
            if j >= n or sym[i] < 0 or rank.get(sym[i] << 20 | sym[j]) != r:
                continue
            sym[i], sym[j] = made[r], -1
            left -= 1
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                r = rank.get(sym[i] << 20 | sym[k])
                if r is not None:
                    heapq.heappush(heap, r << 40 | i)
            if h >= 0:
                r = rank.get(sym[h] << 20 | sym[i])
                if r is not None:
                    heapq.heappush(heap, r << 40 | h)
        return left


@functools.lru_cache(maxsize=2)
def text_counter(path: str) -> Callable[[str | None], int]:
    """A function from a whole text to its token count; one for each Python worker and file."""
    table, words = MergeTable(path), regex.compile(PRETOKEN).findall

    def plain(text: str) -> int:
        return sum(table.count(w.encode("utf-8", "surrogatepass")) for w in words(text))

    spaced = ChunkMemory(plain, " ", REMEMBER_CHUNKS)
    first = ChunkMemory(plain, "", REMEMBER_CHUNKS // 10)

    def whole(text: str) -> int:
        if not text:
            return 0
        try:
            lines = lines_of_chunks(text)
            n = len(lines) - 1  # line breaks
            for line in lines:
                n += first[line[0]]
                if len(line) > 1:
                    n += sum(map(spaced.__getitem__, line[1:]))
            return n
        except Spanning:
            return plain(text)

    def count(text: str | None) -> int:
        if not text:
            return 0
        if table.special is None or not any(s in text for s in table.specials):
            return whole(text)
        parts = table.special.split(text)
        return len(parts) - 1 + sum(map(whole, parts))

    return count


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``vocabulary`` is the name of a byte-level file that ``public_tokenizers.path`` finds on each
    executor. One row comes out for each row that goes in: a null text counts as empty (0 bytes, 0
    tokens), a null id stays null, repeated rows are repeated, an empty table gives an empty one.
    Other columns are ignored, whatever their names. Texts of any length are counted whole.
    """

    @F.pandas_udf(T.LongType())
    def tokens(texts: pd.Series) -> pd.Series:
        import public_tokenizers

        return texts.map(text_counter(public_tokenizers.path(vocabulary))).astype("int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        tokens(text).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
