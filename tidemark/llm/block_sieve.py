"""Which texts may hold a string within its edits, by blocks of it that stay whole; loses none.

A string of B disjoint blocks of ``BLOCK`` characters with at most e edits has, where 2 (B // 2) > e,
two neighbouring blocks with one edit at most between them, so that one of the two is found as it is
with the other beside it. Blocks at every ``BLOCK``-th position of an item serve all its strings;
where too few of them lie in a string, its own do. What is found that way must also share as many
3-grams as the q-gram lemma asks for, ``n - 2 - 3 e`` of a string of n characters, within e
diagonals. Items for which two neighbours are not sure (some of under 66 characters) are sought by
blocks of ``LESSER`` characters, of which their edits leave one.

Characters count by one byte each here; two that share one can only let more texts through.
"""

from __future__ import annotations

import numpy as np

#: Characters of a block; of those of items that need shorter ones.
BLOCK, LESSER = 6, 5
#: Characters of the strings that are sought, at most, and their edits.
LONGEST, MOST_EDITS = 64, 9
#: Characters of one pass, and those that a pass shares with the next.
PASS, SHARED = 1 << 18, 2 * LONGEST
#: Candidates whose 3-grams are compared together.
TOGETHER = 512
#: Characters before and after a candidate's block in which its string lies.
BEFORE, AFTER = LONGEST - BLOCK, LONGEST
_PAD = 2 * LONGEST
_NONE, _BLANK = 255, 1  # beyond an item's ends, and a space; 0 is a character of no item
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_HIGH, _REST = np.uint64(0x8080808080808080), np.uint64(0x7F7F7F7F7F7F7F7F)


def _first(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


def _padded(letters: np.ndarray, pad: int) -> np.ndarray:
    out = np.full(len(letters) + 2 * _PAD, pad, np.uint8)
    out[_PAD : _PAD + len(letters)] = letters
    return out


def _eights(letters: np.ndarray) -> np.ndarray:
    """The eight letters from each place on, the first in the lowest byte; fewer by seven."""
    return np.ndarray(len(letters) - 7, "<u8", letters, strides=(1,)).astype(np.uint64)


def _threes(letters: np.ndarray) -> np.ndarray:
    """A 16-bit hash of the three letters from each place on; fewer by two."""
    wide = letters.astype(np.uint16)
    return wide[:-2] * np.uint16(40503) + wide[1:-1] * np.uint16(213) + wide[2:]


def within_one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the first ``BLOCK`` letters of a are within one edit of some first letters of b (lowest byte first)."""
    x = (a ^ b) & _first(BLOCK)
    wrong = (((x & _REST) + _REST) | x) & _HIGH  # the high bit of each byte that differs
    after = ~(((wrong & (~wrong + np.uint64(1))) >> np.uint64(7)) - np.uint64(1))  # bytes from the first of them on
    changed = (wrong & (wrong - np.uint64(1))) == 0
    added = ((a ^ (b >> np.uint64(8))) & _first(BLOCK) & after) == 0
    left_out = (((a >> np.uint64(8)) ^ b) & _first(BLOCK - 1) & after) == 0
    return changed | added | left_out


class _Table:
    """Places of blocks by a hash of their letters."""

    def __init__(self, keys: np.ndarray, places: np.ndarray):
        bits = max(12, min(22, int(np.ceil(np.log2(max(1, len(keys))))) + 3))
        self.shift = np.uint64(64 - bits)
        slots = self.slots(keys)
        order = np.argsort(slots, kind="stable")
        self.places = places[order]
        self.many = np.bincount(slots, minlength=1 << bits).astype(np.int32)
        self.begin = (np.cumsum(self.many) - self.many).astype(np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair of a position in ``keys`` and a place that has its hash."""
        slots = self.slots(keys)
        at = np.flatnonzero(np.take(self.many, slots))
        slots = slots[at]
        many = self.many[slots].astype(np.int64)
        place = np.repeat(self.begin[slots] - np.cumsum(many) + many, many)
        place += np.arange(len(place))
        return np.repeat(at, many), self.places[place]


class Sieve:
    """For items (code points) with the strings of each that are sought: (start, size, edits) in arrays,
    of one size and one number of edits an item."""

    def __init__(self, items: list[np.ndarray], strings: list[tuple[np.ndarray, np.ndarray, np.ndarray]], fold: np.ndarray):
        known = np.unique(np.concatenate([np.zeros(0, np.int64), *(c.astype(np.int64) for c in items)]))
        known = known[known != 32]
        letter = np.zeros(len(fold), np.uint8)
        letter[known] = 2 + np.arange(len(known)) % (_NONE - 2)
        letter[32] = _BLANK
        self.letter = letter[fold]
        flat, pairs, singles, size, edits, at = [], [], [], [], [], _PAD
        for codes, (start, long, most) in zip(items, strings, strict=True):
            n, e = min(LONGEST, int(long[0])), int(most[0])
            flat += [letter[codes.astype(np.int64)], np.full(_PAD, _NONE, np.uint8)]
            if 2 * (n // BLOCK // 2) > e and e <= MOST_EDITS:
                starts = set(range(0, len(codes) - BLOCK + 1, BLOCK))
                for s in start.tolist():
                    first = -(-s // BLOCK) * BLOCK
                    if 2 * ((s + n - first) // BLOCK // 2) <= e:
                        starts.update(range(s, s + n - BLOCK + 1, BLOCK))
                pairs.append(at + np.array(sorted(starts), np.int64))
                size.append(np.full(len(starts), n - 2))
                edits.append(np.full(len(starts), e))
            else:
                singles.append(at + np.arange(0, len(codes) - LESSER + 1, LESSER))
            at += len(codes) + _PAD
        joined = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        letters = _padded(np.concatenate([np.zeros(0, np.uint8), *flat]), _NONE)
        eights, pairs, singles = _eights(letters), joined(pairs), joined(singles)
        self.right, self.left = eights[pairs + BLOCK], eights[pairs - 8].byteswap()
        self.place, self.size, self.threes = pairs, joined(size), _threes(letters)
        self.least = self.size - 3 * joined(edits)
        self.pairs = _Table(eights[pairs] & _first(BLOCK), np.arange(len(pairs)))
        self.singles = _Table(eights[singles] & _first(LESSER), singles) if len(singles) else None

    def may_hold(self, texts: list[str]) -> np.ndarray:
        """For each text, whether it may hold a string of an item within its edits."""
        out = np.zeros(len(texts), bool)
        codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.take(self.letter, codes)
        blank = letters == _BLANK
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        places = np.flatnonzero(keep)
        letters = letters[places]
        ends = np.cumsum([len(t) + 1 for t in texts])  # of the texts, in ``codes``
        for at in range(0, len(letters), PASS):
            found = self.candidates(letters[at : at + PASS + SHARED])
            inner = np.minimum(at + found + 1, len(places) - 1)  # the second letter: a space before it may be of the text before
            out[np.minimum(np.searchsorted(ends, places[inner]), len(texts) - 1)] = True
        return out

    def candidates(self, letters: np.ndarray) -> np.ndarray:
        """Positions of blocks near which a string may lie."""
        text, n = _padded(letters, 0), len(letters)
        eights = _eights(text)
        here = eights[_PAD : _PAD + n]
        at, ref = self.pairs.hits(here & _first(BLOCK))
        beside = within_one(np.take(self.right, ref), np.take(eights, at + (_PAD + BLOCK)))
        rest = np.flatnonzero(~beside)
        beside[rest] = within_one(np.take(self.left, ref[rest]), np.take(eights, at[rest] + (_PAD - 8)).byteswap())
        at, ref = at[beside], ref[beside]
        near = self.near(_threes(text), at + _PAD, ref)
        found = at[near]
        if self.singles is not None:
            found = np.concatenate([found, self.singles.hits(here & _first(LESSER))[0]])
        return found

    def near(self, threes: np.ndarray, at: np.ndarray, ref: np.ndarray) -> np.ndarray:
        """Whether enough 3-grams of the item around each block lie on diagonals near it."""
        wide, out = BEFORE + AFTER - 2, np.zeros(len(at), bool)
        of_item = np.lib.stride_tricks.sliding_window_view(self.threes, wide)
        of_text = np.lib.stride_tricks.sliding_window_view(threes, wide + 2 * MOST_EDITS)
        for k in range(0, len(at), TOGETHER):
            here = slice(k, k + TOGETHER)
            item, text = of_item[self.place[ref[here]] - BEFORE], of_text[at[here] - BEFORE - MOST_EDITS]
            hit = np.zeros(item.shape, bool)
            for shift in range(2 * MOST_EDITS + 1):
                hit |= item == text[:, shift : shift + wide]
            upto = np.zeros((len(hit), wide + 1), np.int16)
            np.cumsum(hit, axis=1, out=upto[:, 1:])
            sizes, least = self.size[ref[here]], self.least[ref[here]]
            for size in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == size)
                most = (upto[mine, size:] - upto[mine, :-size]).max(axis=1)
                out[k + mine] = most >= least[mine]
        return out
