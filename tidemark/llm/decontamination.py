"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased and every run of other than letters and digits becomes one space. What is
looked for are segments of an item: each window of ``WINDOW`` characters that begins at a word or
ends the item. A shorter item is its own segment; one under ``Q`` characters is looked for as whole
words.

Two strings of which one has m characters and that differ by at most e edits share at least
``m - q + 1 - q e`` of its q-grams, and those lie within e diagonals of each other. The filter
counts hits (document position, item position) in a grid of item stretches and diagonals; two by
two cells hold any segment's hits. Where they reach the bound, different item positions are counted
by window on bands of ``FINE`` diagonals, and the segments that reach the bound are aligned. A
region stays when the edit distance is within the budget; it is widened to the whole item where
that is within its budget too, else to all segments found on its diagonals.

The benchmark is the stated query set: it is read in blocks of at most ``BLOCK_CHARS`` characters,
each of which is one pass over the documents.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.block_sieve import Sieve

#: Characters in a q-gram.
Q = 5
#: Edits allowed for each character of an item or of a segment.
EDIT_RATE = 0.15
#: Characters of a segment of a longer item, and those of it that are aligned first, in a machine word.
WINDOW, WORD = 66, 64
#: Diagonals within which regions of one item with the same segments are one place.
SAME_PLACE = 32
#: Strings that are aligned side by side; fewer than ``ONE_BY_ONE`` are not worth it.
SIDE_BY_SIDE, ONE_BY_ONE = 2048, 24
#: Characters of the texts whose results a Python worker remembers.
REMEMBER_CHARS = 16_000_000
#: Characters of the texts that go through the sieve together.
SIEVE_CHARS = 100_000
#: Origins of references that are remembered, 8 bytes each.
ORIGINS = 4_000_000
#: Characters of an item up to which its pieces are aligned before the whole.
PIECEWISE = 2048
#: Item positions of a cell of the grid, at least ``WINDOW``.
STRETCH = 128
#: Diagonals of a cell of the grid, a power of two; two cells hold a segment's hits.
CELL = 16
#: Diagonals of a cell of the bands of single windows; three cells hold a segment's hits.
FINE = 5
#: Characters of benchmark items in one pass; a block's index holds 16 bytes for each.
BLOCK_CHARS = 4_000_000
#: Hits of a cell of the grid that count, of four cells within 16 bits.
FULL = 16_000
#: Cells of the grid, and hits, that are held at once in a task, so few that they stay in a core's
#: cache; longer documents are cut into windows that overlap by the longest item.
GRID = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Lower-case letter or digit for each code point; a space for the rest of them."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(len(out)):
        low = chr(i).lower()
        if len(low) == 1 and low.isalnum():
            out[i] = ord(low)
    return out


def normal_codes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised text, and the place in the text of each."""
    codes = _fold()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = codes == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first of a run of blanks stays
    places = np.flatnonzero(keep)
    return codes[places].astype(np.uint64), places


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the q-gram that starts at each position."""
    h = np.zeros(max(0, len(codes) - Q + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(Q):
            h *= _BASE
            h += codes[k : k + len(h)]
        return h * _BASE


def budget(m: int) -> int:
    """Edits allowed for an item of m characters, such that the lemma's bound is at least 1."""
    return max(0, min(int(m * EDIT_RATE), (m - Q) // Q))


def _trimmed(text: str | None) -> np.ndarray:
    codes, _ = normal_codes(text)
    inner = np.flatnonzero(codes != 32)
    return codes[inner[0] : inner[-1] + 1] if len(inner) else codes[:0]


def _words(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _segments(codes: np.ndarray) -> list[tuple[int, int]]:
    """Start and length of the stretches of an item that are looked for, each once."""
    m = len(codes)
    if m < WINDOW:
        return [(0, m)]
    starts = {0, *(np.flatnonzero(codes[: m - WINDOW] == 32) + 1).tolist(), m - WINDOW}
    return [(p, WINDOW) for p in sorted(starts)]


def _least(pattern: list[int], region: list[int], enough: int = 0) -> int:
    """The edits between the pattern and the nearest part of the region (Myers' bit vectors); the first found of at most ``enough``."""
    m = len(pattern)
    full, top = (1 << m) - 1, m - 1
    where: dict[int, int] = {}
    for k, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << k
    up, down, score = full, 0, m
    best = m
    for c in region:
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        score += (ph >> top & 1) - (mh >> top & 1)
        if score < best:
            best = score
            if score <= enough:
                break
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up, down = mh | (full & ~(xv | ph)), ph & xv
    return best


def least_edits(patterns: np.ndarray, sizes: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """For each row, the edits between its pattern and the nearest part of its region.

    As ``_least``, one column of all regions at a time: patterns (K, 64) and regions (K, n) of code
    points, of which the first ``sizes`` of a pattern count and no pattern has the region's padding.
    """
    one = np.uint64(1)
    inside = np.arange(WORD) < sizes[:, None]
    full = np.packbits(inside, axis=1, bitorder="little").view("<u8").ravel()
    last = (sizes - 1).astype(np.uint64)
    up, down, score, best = full.copy(), np.zeros(len(sizes), np.uint64), sizes.astype(np.int64), sizes.astype(np.int64)
    with np.errstate(over="ignore"):
        for j in range(regions.shape[1]):
            eq = np.packbits((patterns == regions[:, j, None]) & inside, axis=1, bitorder="little").view("<u8").ravel()
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = down | (full & ~(xh | up))
            mh = up & xh
            score += (ph >> last & one).astype(np.int64) - (mh >> last & one).astype(np.int64)
            best = np.minimum(best, score)
            ph, mh = (ph << one) & full, (mh << one) & full
            up, down = mh | (full & ~(xv | ph)), ph & xv
    return best


class Index:
    """The q-grams and segments of some benchmark items."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.codes = ids, [_trimmed(t) for t in texts]
        grams = [_grams(c) for c in self.codes]
        sizes = [len(g) for g in grams]
        keys = np.concatenate([np.zeros(0, np.uint64), *grams])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in sizes)]).astype(np.int64)
        cells = np.array([-(-n // STRETCH) for n in sizes] or [0])
        cell = np.repeat(np.cumsum(cells) - cells, sizes) + place // STRETCH
        self.item_of = np.repeat(np.arange(len(grams)), cells)
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys))
        self.many = np.diff(self.first)
        self.cell, self.place = cell[order].astype(np.int32), place[order].astype(np.int32)
        self.by_width: dict[int, np.ndarray] = {}
        self.bits = max(16, min(24, int(np.ceil(np.log2(max(1, len(self.keys))))) + 4))
        self.prefix = np.searchsorted(self.keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)  # the first key of each
        self.memory: dict[str, list] = {}
        self.remembered = 0
        self.length = np.array([len(c) for c in self.codes] or [0])
        self.edits = np.array([budget(int(m)) for m in self.length])
        self.longest = int(self.length.max())
        self.segments = []
        for c in self.codes:
            start, size = np.array(_segments(c)).T
            edits = np.array([budget(int(m)) for m in size])
            self.segments.append((start, size, edits, np.maximum(1, size - Q + 1 - Q * edits)))
        self.flat = np.concatenate([np.zeros(0, np.uint64), *self.codes]).astype(np.uint32)
        self.offset = np.cumsum(self.length) - self.length
        self.bound = np.array([int(s[3].min()) for s in self.segments] or [1])
        reach = self.bound[self.item_of]
        self.reach = np.minimum(np.minimum(reach, np.append(reach[1:], FULL)), FULL).astype(np.uint16)[:, None]  # of the stretch and the next
        self.short = [(i, " " + _words(c) + " ") for i, c in enumerate(self.codes) if len(c) < Q]
        self.overlap = self.longest + 2 * int(self.edits.max()) + 2 * CELL + 2
        long = [k for k, c in enumerate(self.codes) if len(c) >= Q]
        self.sieve = Sieve([self.codes[k] for k in long], [self.segments[k][:3] for k in long], _fold())

    def origins(self, wide: int) -> np.ndarray:
        """For each reference, where its row of a grid of so many columns begins, less its place: with a position
        added, its cell. Remembered for some widths."""
        if wide not in self.by_width:
            if len(self.by_width) >= max(1, ORIGINS // max(1, len(self.cell))):
                self.by_width.clear()
            self.by_width[wide] = self.cell.astype(np.int64) * (wide * CELL) - self.place
        return self.by_width[wide]

    def lookup(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the grams that are keys, and the place of the key of each."""
        prefix = (grams >> np.uint64(64 - self.bits)).astype(np.int64)
        slot = np.take(self.prefix, prefix, mode="clip")
        keys = np.take(self.prefix, prefix + 1, mode="clip") - slot
        at = np.flatnonzero(keys > 0)
        slot = slot[at]
        crowded = np.flatnonzero(keys[at] > 1)
        if len(crowded):
            slot[crowded] = np.minimum(np.searchsorted(self.keys, grams[at[crowded]]), len(self.keys) - 1)
        real = np.take(self.keys, slot, mode="clip") == grams[at]
        return at[real], slot[real]

    def found(self, texts: list[str]) -> list[list[dict]]:
        """``found_in`` for each text, once for equal ones among these and the last; what the sieve holds back has no regions."""
        got = {t: self.memory.get(t) for t in texts}
        part, held, new = [], 0, [t for t, x in got.items() if x is None]
        for k, text in enumerate(new):
            part.append(text)
            held += len(text)
            if held >= SIEVE_CHARS or k == len(new) - 1:
                for t, may in zip(part, self.sieve.may_hold(part).tolist(), strict=True):
                    got[t] = found_in(t, self, may)
                    self.remember(t, got[t])
                part, held = [], 0
        return [got[t] for t in texts]

    def remember(self, text: str, found: list[dict]) -> None:
        if self.remembered + len(text) > REMEMBER_CHARS:
            self.memory.clear()
            self.remembered = 0
        self.memory[text] = found
        self.remembered += len(text)

    def regions(self, codes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, start, end, edits, item's characters) for each retained and verified region of a normalised text."""
        grams = _grams(codes)
        if not len(grams) or not len(self.keys):
            return []
        at, slot = self.lookup(grams)
        if not len(at):
            return []
        many = self.many[slot]
        total = int(many.sum())
        if total > GRID and len(codes) > 4 * self.overlap:
            mid = len(codes) // 2
            right = [(i, s + mid, e + mid, d, m) for i, s, e, d, m in self.regions(codes[mid:])]
            return sorted({*self.regions(codes[: mid + self.overlap]), *right})
        ref = np.repeat(self.first[slot] - np.cumsum(many) + many, many)
        ref += np.arange(total)
        wide = -(-((len(codes) + self.longest) // CELL + 2) // 16) * 16  # the last column stays empty
        position = np.repeat(at + self.longest, many)
        key = np.take(self.origins(wide), ref, mode="clip")
        key += position
        key >>= CELL.bit_length() - 1
        count = np.bincount(key, minlength=(len(self.item_of) + 1) * wide + 1)  # so does the last row
        if total > 0xFFFF:  # four cells' hits stay within 16 bits
            np.minimum(count, FULL, out=count)
        count = count.astype(np.uint16)
        both = count[:-1] + count[1:]
        both = both[:-wide] + both[wide:]
        near = (both.reshape(-1, wide) >= self.reach).ravel()
        spots = (np.flatnonzero(near.view(np.uint64) > 0)[:, None] * 8 + np.arange(8)).ravel()
        spots = spots[near[spots] & (spots % wide < wide - 1)]
        if not len(spots):
            return []
        marked = np.zeros(len(count), bool)
        for corner in (0, 1, wide, wide + 1):
            marked[spots + corner] = True
        live = np.flatnonzero(np.take(marked, key, mode="clip"))
        ref = ref[live]
        item, place, out = self.item_of[self.cell[ref]], self.place[ref].astype(np.int64), []
        diagonal = position[live] - place
        bands = sorted(self.bands(item, place, diagonal), key=lambda x: x[:2])
        if not bands:
            return []
        span = self.longest + WINDOW
        seen = np.bincount(np.unique(item * span + place) // span, minlength=len(self.codes))  # item positions hit anywhere
        close = self.close_segments(bands, codes)
        whole = self.may_be_whole(bands, close, seen, codes)
        aligned: dict[tuple, tuple[int, int, int] | None] = {}
        for (i, low, _), segments, may in zip(bands, close, whole, strict=True):
            if not len(segments):
                continue
            before = next(((x, held) for x, d, held in reversed(out[-4:]) if x[0] == i and abs(d - low) <= SAME_PLACE), None)
            if before and (before[0][4] == self.length[i] or before[1].issuperset(j for j, _ in segments)):
                continue  # the same place, from a band that overlaps
            if (found := self.verify(i, low - self.longest, segments, codes, may, aligned)) is not None:
                out.append((found, low, {j for j, _ in segments}))
        return sorted(x for x, _, _ in out)

    def close_segments(self, bands: list[tuple[int, int, np.ndarray]], codes: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each band, those segments of its item, with the edits of their first characters, that share enough q-grams there and whose first ``WORD`` characters are within the segment's edits.

        Segments of equal text at one place, as items made from one template have them, are aligned once.
        """
        tried = []
        for b, (i, low, places) in enumerate(bands):
            start, size, edits, bound = self.segments[i]
            hit = np.zeros(int(self.length[i]) + 1, np.int64)
            hit[places + 1] = 1
            upto = np.cumsum(hit)
            j = np.flatnonzero(upto[start + size - Q + 1] - upto[start] >= bound)
            if len(j):
                left = np.maximum(0, start[j] + low - self.longest - edits[j])
                right = np.maximum(0, start[j] + low - self.longest + 3 * FINE + size[j] + edits[j])
                tried.append(np.stack([np.full(len(j), b), j, self.offset[i] + start[j], np.minimum(WORD, size[j]), edits[j], left, right], axis=1))
        out: list[list[tuple[int, int]]] = [[] for _ in bands]
        if tried:
            rows = np.concatenate(tried)
            least = self.nearest(rows[:, 2:4], rows[:, 5:], codes)
            near = least <= rows[:, 4]
            for (b, j), d in zip(rows[near, :2].tolist(), least[near].tolist(), strict=True):
                out[b].append((j, d))
        return out

    def bands(self, item: np.ndarray, place: np.ndarray, diagonal: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(item, first diagonal, item positions) of the bands where a window of item positions reaches the bound."""
        span, column, items = self.longest + WINDOW, diagonal // FINE, len(self.codes)
        wide = int(column.max()) // 3 + 2
        one = np.concatenate([((shift * items + item) * wide + (column + shift) // 3) * span + place for shift in range(3)])
        one.sort()
        one = one[np.append(True, one[1:] != one[:-1])]
        band = one // span
        least = np.arange(len(one)) + self.bound[band // wide % items] - 1  # the hit that makes the bound, if near enough
        enough = np.take(one, least, mode="clip") - one < WINDOW - Q + 1
        enough &= least < len(one)
        for g in sorted(set(band[enough].tolist())):
            a, b = np.searchsorted(one, (g * span, (g + 1) * span))
            shift, i = divmod(g // wide, items)
            yield i, (g % wide * 3 - shift) * FINE, one[a:b] - g * span

    def nearest(self, strings: np.ndarray, spans: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The least edits between strings (offset, size; at most ``WORD`` long) of items and spans (from, to) of a text.

        Strings of equal text that meet the same span are aligned once.
        """
        wide, out = int((spans[:, 1] - spans[:, 0]).max()), np.zeros(len(strings), np.int64)
        padded = np.concatenate([codes.astype(np.uint32), np.full(wide + 1, 0xFFFFFFFF, np.uint32)])
        flat = np.concatenate([self.flat, np.zeros(WORD, np.uint32)])
        for k in range(0, len(strings), SIDE_BY_SIDE):
            here = slice(k, k + SIDE_BY_SIDE)
            size, span = strings[here, 1], spans[here]
            patterns = flat[strings[here, 0, None] + np.arange(WORD)]
            patterns[np.arange(WORD) >= size[:, None]] = 0
            key = np.ascontiguousarray(np.concatenate([patterns, size[:, None], span], axis=1).astype(np.uint32))
            _, first, same = np.unique(key.view(np.dtype((np.void, key.strides[0]))).ravel(), return_index=True, return_inverse=True)
            low, high = span[first, 0], span[first, 1]
            if len(first) < ONE_BY_ONE:
                plain = [_least(patterns[f, :n].tolist(), padded[a:b].tolist()) for f, n, a, b in zip(first, size[first].tolist(), low.tolist(), high.tolist(), strict=True)]
                out[here] = np.array(plain, np.int64)[same.ravel()]
                continue
            regions = padded[np.minimum(low[:, None] + np.arange(wide), len(padded) - 1)]
            regions[np.arange(wide) >= (high - low)[:, None]] = 0xFFFFFFFF
            out[here] = least_edits(patterns[first], size[first], regions)[same.ravel()]
        return out

    def may_be_whole(self, bands: list[tuple[int, int, np.ndarray]], close: list[list[tuple[int, int]]], seen: np.ndarray, codes: np.ndarray) -> list[bool]:
        """Whether a band's whole item can be within its edits: by the lemma over all hits, and as the item's pieces
        of ``WORD`` characters need at least the sum of their own least edits."""
        out, strings, spans, of = [False] * len(bands), [], [], []
        for b, (i, low, _) in enumerate(bands):
            m, e = int(self.length[i]), int(self.edits[i])
            out[b] = len(close[b]) > 0 and bool(seen[i] >= m - Q + 1 - Q * e)
            if out[b] and m <= PIECEWISE:
                at = np.arange(0, m, WORD)
                low -= self.longest
                strings.append(np.stack([self.offset[i] + at, np.minimum(WORD, m - at)], axis=1))
                spans.append(np.broadcast_to([max(0, low - e), max(0, low + 3 * FINE + m + e)], (len(at), 2)))
                of += [b] * len(at)
        if of:
            least = np.bincount(of, self.nearest(np.concatenate(strings), np.concatenate(spans), codes), minlength=len(bands))
            for b in set(of):
                out[b] = bool(least[b] <= self.edits[bands[b][0]])
        return out

    def verify(self, i: int, low: int, segments: list[tuple[int, int]], codes: np.ndarray, whole_may: bool, aligned: dict) -> tuple[int, int, int, int, int] | None:
        """The region of item i on the band of diagonals from low on, given its segments that are close there.

        It is the whole item's, or from the start of the first to the end of the last of those
        segments that is within its edits, with the edits of the nearest one.
        ``aligned`` remembers alignments by text and place, which items of one template share.
        """
        start, size, edits, _ = self.segments[i]
        m, e = int(self.length[i]), int(self.edits[i])
        if whole_may:
            side = max(0, low - e)
            around = codes[side : max(0, low + 3 * FINE + m + e)]
            if _least(self.codes[i].tolist(), around.tolist(), e) <= e and (whole := self.align(i, around)) is not None:
                return i, side + whole[0], side + whole[1], whole[2], m
        ends = []
        for order in (segments, reversed(segments), sorted(segments, key=lambda x: x[1])):
            for j, _ in order:
                p, n, e = int(start[j]), int(size[j]), int(edits[j])
                left, right = max(0, p + low - e), max(0, p + low + 3 * FINE + n + e)
                part = self.codes[i][p : p + n]
                key = part.tobytes(), left, right
                if key not in aligned:
                    aligned[key] = _align(part, e, codes[left:right])
                if (got := aligned[key]) is not None:
                    ends.append((got[2] / n, got[2], n, left + got[0], left + got[1]))
                    break
        if not ends:
            return None
        _, d, n, _, _ = min(ends)
        return i, min(x[3] for x in ends), max(x[4] for x in ends), d, n

    def align(self, i: int, region: np.ndarray) -> tuple[int, int, int] | None:
        """The best place of item i in a region of few diagonals, as (start, end, edits)."""
        return _align(self.codes[i], int(self.edits[i]), region)


def _align(item: np.ndarray, e: int, region: np.ndarray) -> tuple[int, int, int] | None:
    """The best place of a string in a region of few diagonals, as (start, end, edits), within e edits."""
    m, n = len(item), len(region)
    width = n - m + 2 * e + 1  # diagonals -e .. n - m + e
    if width <= 0:
        return None
    for d in range(max(0, n - m + 1)):  # a diagonal without edits needs no further rows
        if region[d] == item[0] and np.array_equal(region[d : d + m], item):
            return d, d + m, 0
    far = m + n
    steps = np.arange(width)
    shift = steps - e
    padded = np.concatenate([np.zeros(e + 1, np.uint64), region, np.zeros(width + m, np.uint64)])
    row = np.where((shift >= 0) & (shift <= n), 0, far)
    origin = np.where(row == 0, shift, 0)
    new, source = np.empty(width, np.int64), np.empty(width, np.int64)
    for k in range(1, m + 1):
        # cell s of row k stands for the region's first shift[s] + k characters
        same = row + (padded[k : k + width] != item[k - 1])
        low, high = max(0, e + 1 - k), min(width, n + e - k + 1)
        same[:low], same[high:] = far, far
        new[:], source[:] = same, origin
        skip = row[1:] + 1
        better = skip < same[:-1]
        new[:-1][better], source[:-1][better] = skip[better], origin[1:][better]
        lead = new - steps
        best = np.minimum.accumulate(lead)
        take = np.maximum.accumulate(np.where(lead == best, steps, 0))
        row, origin = best + steps, source[take]
        row[: max(0, e - k)], row[high:] = far, far
        if row.min() > e:
            return None
    j = int(np.argmin(row))
    if row[j] > e:
        return None
    return int(origin[j]), int(shift[j] + m), int(row[j])


def _windows(codes: np.ndarray, ix: Index) -> Iterator[tuple[int, np.ndarray]]:
    step = max(GRID // max(1, len(ix.item_of)) * CELL, 4 * ix.overlap)
    for at in range(0, max(1, len(codes)), step):
        yield at, codes[at : at + step + ix.overlap]


_REGION = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "start", "end", "edits", "item_chars")])
)


def found_in(text: str, ix: Index, may_hold: bool = True) -> list[dict]:
    """Every verified region of a whole text; those of one item that overlap are one, at its place in the text itself.

    Where ``may_hold`` is false, only items of under ``Q`` characters are looked for.
    """
    if not may_hold and not ix.short:
        return []
    codes, places = normal_codes(text)
    windows = _windows(codes, ix) if may_hold else ()
    found = sorted({(i, at + s, at + e, d, m) for at, window in windows for i, s, e, d, m in ix.regions(window)})
    if ix.short:
        words = " " + _words(codes) + " "
        blank = int(words.startswith("  "))
        words = words[blank:]
        for i, word in ix.short:
            at = words.find(word)
            while at >= 0:
                s = at + blank
                found.append((i, s, s + len(word) - 2, 0, len(word) - 2))
                at = words.find(word, at + 1)
    out: list[list[tuple[int, int]]] = []
    for i, s, e, d, m in found:
        if out and out[-1][0] == i and s < out[-1][2]:
            best = min((-out[-1][4], out[-1][3]), (-m, d))
            out[-1] = [i, out[-1][1], max(e, out[-1][2]), best[1], -best[0]]
        else:
            out.append([i, s, e, d, m])
    return [{"item_id": ix.ids[i], "start": int(places[s]), "end": int(places[e - 1]) + 1, "edits": d, "item_chars": m} for i, s, e, d, m in out]


def _scan(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)  # at most BLOCK_CHARS items' characters

    @F.pandas_udf(_REGION)
    def regions(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.found(texts.tolist()), dtype=object)

    return docs.select("doc_id", F.inline(regions(F.coalesce("text", F.lit("")))))


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the benchmark's items; items without a letter or digit are left out."""
    ids, texts, held = [], [], 0
    for r in benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        if not len(_trimmed(r["text"])):
            continue
        if ids and held + len(r["text"]) > BLOCK_CHARS:
            yield Index(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        held += len(r["text"])
    if ids:
        yield Index(ids, texts)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, end, edits, item_chars`` for each benchmark passage in a document.

    Positions are code points of the text. A document without leaks has no row; a null text is
    empty; a null id stays null; repeated rows give repeated results; an empty benchmark or an
    empty table gives no rows. Regions of one item that overlap are one row. ``item_chars`` are the
    characters of the item that ``edits`` is about: all, or those of the nearest segment where only
    a part of the item is quoted. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for index in _blocks(benchmark):
        part = _scan(rows, index)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start long, end long, edits long, item_chars long")
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no benchmark passage is found.

    A null text has no passage and stays, as do rows with a null id; repeated rows stay or go
    together; an empty benchmark keeps all, an empty table gives an empty one. Column names don't
    matter.
    """
    kept = docs
    for index in _blocks(benchmark):
        kept = kept.where(_clean(docs, index)(F.coalesce("text", F.lit(""))))
    return kept


def _clean(docs: DataFrame, index: Index):
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not x for x in shared.value.found(texts.tolist())], dtype=bool)

    return clean
