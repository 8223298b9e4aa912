"""Token-id output: best-fit-decreasing packing with a segment tree over free capacity.

Each block of documents (an Arrow batch of a task) is tokenized and packed by itself, so nothing is
shuffled and memory is bounded by a block. A document longer than a row is split, losslessly, into
full rows and a rest. Pieces are placed longest first, each in the open row with the least free
capacity that still holds it; a segment tree over capacities 0..width finds that row in log(width)
steps. A packed row holds its ids, padded to the width, their positions, which are reset to 0 where
a segment starts, cumulative segment lengths, and for each segment its document and the place in
the document where it starts.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import ChunkMemory, Spanning, lines_of_chunks
from tidemark.llm.common import give_back

#: Ids in a packed row.
WIDTH = 2048
#: The free id of the vocabulary, used as padding.
PAD = 50256
#: Texts longer than this are tokenized in pieces cut where a pre-token surely starts.
PIECE_CHARS = 100_000
#: The memory of a Python worker is emptied when it holds this many chunks.
REMEMBER_CHUNKS = 700_000
#: Characters of documents packed together; a block also ends with its Arrow batch.
BLOCK_CHARS = 16_000_000

_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
SCHEMA = "row_id string, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"


class CapacityTree:
    """Counts of open rows by free capacity; leaves are capacities 0..width."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        i = free + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """An open row with the least free capacity of at least ``need``, removed, with that capacity."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        free = i - self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.rows[free].pop(), free


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers; every piece is at most ``width`` long. Ties go in order of number."""
    tree, rows = CapacityTree(width), []
    for piece in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[piece]
        found = tree.take(n)
        if found is None:
            row, free = len(rows), width
            rows.append([])
        else:
            row, free = found
        rows[row].append(piece)
        tree.add(free - n, row)
    return rows


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    """The tokenizer of a .tiktoken file, one for each Python worker."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def _memories(vocabulary: str) -> tuple[ChunkMemory, ChunkMemory]:
    def ids(chunk: str) -> bytes:
        return np.array(_encoder(vocabulary).encode_ordinary(chunk), "<u2").tobytes()

    return ChunkMemory(ids, " ", REMEMBER_CHUNKS), ChunkMemory(ids, "", REMEMBER_CHUNKS // 10)


def encode(text: str, vocabulary: str) -> np.ndarray:
    """Token ids of a whole text."""
    if not text:
        return np.zeros(0, "<u2")
    spaced, first = _memories(vocabulary)
    try:
        parts = []
        for line in lines_of_chunks(text):
            parts.append(first[line[0]] + b"".join(map(spaced.__getitem__, line[1:])))
        return np.frombuffer(_line_break(vocabulary).join(parts), "<u2")
    except Spanning:
        return _encode_whole(text, _encoder(vocabulary))


@functools.lru_cache(maxsize=2)
def _line_break(vocabulary: str) -> bytes:
    return np.array(_encoder(vocabulary).encode_ordinary("\n"), "<u2").tobytes()


def _encode_whole(text: str, enc) -> np.ndarray:
    parts, at = [], 0
    while len(text) - at > PIECE_CHARS:
        cut = _CUT.search(text, at + PIECE_CHARS)
        end = cut.start() if cut else len(text)
        parts.append(np.array(enc.encode_ordinary(text[at:end]), "<u2"))
        at = end
    parts.append(np.array(enc.encode_ordinary(text[at:]), "<u2"))
    return np.concatenate(parts)


def pack_block(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> list[tuple[int, bytes, bytes, list[int], list[int | None], list[int]]]:
    """(n_tokens, padded ids, their positions, cu_seqlens, doc_ids, starts) of each packed row of a block."""
    pieces = [(d, s, x[s : s + width]) for d, x in zip(doc_ids, ids, strict=True) for s in range(0, max(1, len(x)), width)]
    out = []
    for row in best_fit_decreasing([len(p[2]) for p in pieces], width):
        parts = [pieces[k] for k in row]
        sizes = np.array([len(p[2]) for p in parts])
        lengths = np.append(0, np.cumsum(sizes))
        flat = np.full(width, PAD, "<u2")
        flat[: lengths[-1]] = np.concatenate([p[2] for p in parts])
        place = np.zeros(width, "<u2")
        place[: lengths[-1]] = np.arange(lengths[-1]) - np.repeat(lengths[:-1], sizes)
        out.append((int(lengths[-1]), flat.tobytes(), place.tobytes(), lengths.tolist(), [p[0] for p in parts], [p[1] for p in parts]))
    return out


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", width: int = WIDTH) -> DataFrame:
    """Packed rows: ``row_id, n_tokens, ids, position_ids, cu_seqlens, doc_ids, starts``.

    ``ids`` and ``position_ids`` are rows of little-endian 16-bit matrices of ``width`` columns.
    Segment k of a row is ``ids[cu_seqlens[k] : cu_seqlens[k + 1]]`` and stands at token
    ``starts[k]`` of document ``doc_ids[k]``; positions restart at 0 with each segment and are 0 in
    the padding. Which documents share a row depends on how the input is split into tasks. An empty or null
    text has one segment of length 0. Null ids stay null, repeated rows are packed as often as they
    occur, an empty table gives no rows, other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                held, block, names = 0, [], []
                while at < len(texts) and (not block or held < BLOCK_CHARS):
                    text = texts[at].as_py()
                    held += len(text)
                    block.append(encode(text, vocabulary))
                    names.append(ids[at].as_py())
                    at += 1
                rows = pack_block(names, block, width)
                for k in range(0, len(rows), 2000):
                    some = rows[k : k + 2000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([f"{task}-{n + j}" for j in range(len(some))], pa.string()),
                            pa.array([r[0] for r in some], pa.int32()),
                            pa.array([r[1] for r in some], pa.binary()),
                            pa.array([r[2] for r in some], pa.binary()),
                            pa.array([r[3] for r in some], pa.list_(pa.int32())),
                            pa.array([r[4] for r in some], pa.list_(pa.int64())),
                            pa.array([r[5] for r in some], pa.list_(pa.int64())),
                        ],
                        names=["row_id", "n_tokens", "ids", "position_ids", "cu_seqlens", "doc_ids", "starts"],
                    )
                    n += len(some)
                block = names = rows = some = text = None
        batch = ids = texts = None
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(work, SCHEMA)


def position_resets(packed: DataFrame) -> DataFrame:
    """``packed`` with ``resets``: where in each row positions are 0 again, as an ascending array.

    Segments without a token have no place of their own; a row without tokens has no resets.
    """
    starts = F.array_distinct(F.slice("cu_seqlens", F.lit(1), F.size("cu_seqlens") - 1))
    return packed.withColumn("resets", F.filter(starts, lambda x: x < F.col("n_tokens")))


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the id and position matrices' rows with cumulative lengths and resets as Parquet.

    The folder must not exist; an empty table gives an empty one.
    """
    position_resets(packed).write.parquet(path)
