"""Chat formatting by minimum-cost role repair.

Legal conversations are an optional system turn, then user and assistant turns in turn, ending with
the assistant. A dynamic programme over that automaton gives each turn an output role: keeping its
role is free, another role costs ``RELABEL``, following a turn of the same output role merges the
two for ``MERGE``, and any other illegal step inserts an empty turn for ``INSERT``. The cheapest
repair is rendered as fragments, one for each turn, in order.

Costs of paths compose, so a conversation may lie in several partitions: rows are dealt by ranges
of (conversation, turn), each range yields the cheapest cost from every state to every state for
the conversations at its ends, those few rows are composed, and each range is then repaired from
its known entry to its known exit state. Ties go to the path whose output roles come first in the
order system, user, assistant, which also composes; so results don't depend on the ranges.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
MERGE, RELABEL, INSERT = 1, 2, 3
FAR = 1 << 60
#: Turns in a range of rows, about; a task holds one range's turns of one conversation at a time.
RANGE_ROWS = 100_000
HEAD, TAIL = "<|im_start|>{}\n", "<|im_end|>\n"
SCHEMA = "conv_id long, turn long, place long, role string, out_role string, action string, fragment string, cost long"


def step(before: int, after: int) -> tuple[int, tuple[int, ...]] | None:
    """Cost of going from one output role to the next, and the roles inserted between; None: never."""
    if before == after:
        return MERGE, ()
    if after == SYSTEM:
        return (0, ()) if before == START else None
    if after == USER:
        return 0, ()
    if before == USER:
        return 0, ()
    return INSERT, (USER,)  # an assistant turn first, or after a system turn


def _final(state: int) -> int:
    """Cost of ending in a state: a conversation ends with the assistant."""
    return {ASSISTANT: 0, USER: INSERT}.get(state, 2 * INSERT if state == SYSTEM else 0)


def _wanted(role: str | None) -> int:
    return {"system": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}.get((role or "").strip().lower(), START)


_STEPS = [[step(p, q) for q in range(4)] for p in range(4)]


class Paths:
    """Cheapest paths from each entry state over the turns read so far.

    For an entry state, ``cost[q]`` is that of ending in q and ``rank[q]`` orders the paths to
    different q by their sequences of output roles; ``back`` has the predecessors, if kept.
    """

    def __init__(self, keep: bool, entries: tuple[int, ...] = (0, 1, 2, 3)):
        self.at = {p: ([0 if q == p else FAR for q in range(4)], [0] * 4) for p in entries}
        self.back: list[tuple[int, ...]] | None = [] if keep else None

    def read(self, role: str | None) -> None:
        wanted = _wanted(role)
        for p, (cost, rank) in self.at.items():
            best = []
            for q in (SYSTEM, USER, ASSISTANT):
                paid = RELABEL * (q != wanted)
                best.append(min((cost[o] + s[0] + paid, rank[o], o) if (s := _STEPS[o][q]) and cost[o] < FAR else (FAR, 4, 0) for o in range(4)))
            order = sorted((best[q - 1][1], q) for q in (SYSTEM, USER, ASSISTANT))
            place = {q: k for k, (_, q) in enumerate(order)}
            self.at[p] = ([FAR, *(b[0] for b in best)], [0, *(place[q] for q in (SYSTEM, USER, ASSISTANT))])
            if self.back is not None:
                self.back.append((0, *(b[2] for b in best)))

    def roles(self, last: int) -> list[int]:
        """Output roles of the turns on the cheapest path that ends in ``last``."""
        out = []
        for back in reversed(self.back):
            out.append(last)
            last = back[last]
        return out[::-1]


def choose_end(cost: list[int], rank: list[int]) -> int:
    return min((cost[q] + _final(q), rank[q], q) for q in range(4) if cost[q] < FAR)[2]


def render(roles: list[tuple[str | None, int]], texts: list[str | None], entry: int, last: bool) -> list[tuple[str, str, str, int]]:
    """(output role, action, fragment, cost) of turns with given roles, from an entry state.

    A fragment closes the turn before it unless it merges with it; the first opens without closing
    and the last closes, after an empty assistant turn where one is missing.
    """
    out, before = [], entry
    for k, ((role, q), text) in enumerate(zip(roles, texts, strict=True)):
        price, inserted = _STEPS[before][q]
        relabelled = q != _wanted(role)
        actions = [a for a, on in (("insert", bool(inserted)), ("merge", before == q), ("relabel", relabelled)) if on]
        piece = ""
        if before == q:
            piece += "\n"
        else:
            if before != START:
                piece += TAIL
            piece += "".join(HEAD.format(ROLES[r - 1]) + TAIL for r in inserted) + HEAD.format(ROLES[q - 1])
        piece += text or ""
        cost = price + RELABEL * relabelled
        if last and k == len(roles) - 1:
            piece += TAIL
            missing = {ASSISTANT: (), USER: (ASSISTANT,), SYSTEM: (USER, ASSISTANT)}[q]
            piece += "".join(HEAD.format(ROLES[r - 1]) + TAIL for r in missing)
            cost += INSERT * len(missing)
            actions += ["append"] * bool(missing)
        out.append((ROLES[q - 1], "+".join(actions) or "keep", piece, cost))
        before = q
    return out


def _runs(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[object, list[tuple]]]:
    """Consecutive rows of one conversation in a sorted partition."""
    current, rows = None, []
    for pdf in parts:
        for r in pdf.itertuples(index=False):
            if rows and r.conv_id != current:
                yield current, rows
                rows = []
            current = r.conv_id
            rows.append(r)
    if rows:
        yield current, rows


def _ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cost and rank tables of a partition's first and last conversation."""
    first, latest, current = None, None, None
    for pdf in parts:
        for r in pdf.itertuples(index=False):
            if r.conv_id != current:
                if latest is not None and first is None:
                    first = latest
                latest, current = [r.conv_id, r.piece, Paths(keep=False), 0], r.conv_id
            latest[2].read(r.role)
            latest[3] += 1
    for conv, piece, paths, turns in ([first] if first else []) + ([latest] if latest else []):
        flat = [x for p in range(4) for t in paths.at[p] for x in t]
        yield pd.DataFrame({"conv_id": [conv], "piece": [piece], "turns": [turns], "table": [flat]})


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry and exit state, and first place, of each piece of one conversation; a row a range, never a row a turn."""
    pdf = pdf.sort_values("piece")
    tables = [[(t[8 * p : 8 * p + 4], t[8 * p + 4 : 8 * p + 8]) for p in range(4)] for t in (list(x) for x in pdf["table"])]
    cost, rank, backs = [0, FAR, FAR, FAR], [0] * 4, []
    for table in tables:
        best = []
        for q in (SYSTEM, USER, ASSISTANT):
            best.append(min((cost[o] + table[o][0][q], rank[o], o) if cost[o] < FAR and table[o][0][q] < FAR else (FAR, 4, 0) for o in range(4)))
        order = sorted((best[q - 1][1], table[best[q - 1][2]][1][q], q) for q in (SYSTEM, USER, ASSISTANT))
        place = {q: k for k, (_, _, q) in enumerate(order)}
        cost, rank = [FAR, *(b[0] for b in best)], [0, *(place[q] for q in (SYSTEM, USER, ASSISTANT))]
        backs.append((0, *(b[2] for b in best)))
    state = choose_end(cost, rank)
    entries, exits = [], []
    for back in reversed(backs):
        exits.append(state)
        state = back[state]
        entries.append(state)
    n = len(pdf)
    start = pdf["turns"].cumsum() - pdf["turns"]
    return pd.DataFrame({"conv_id": pdf["conv_id"], "piece": pdf["piece"], "start": start, "entry": entries[::-1], "exit": exits[::-1], "is_first": [k == 0 for k in range(n)], "is_last": [k == n - 1 for k in range(n)]})


#: Output rows that a task gathers before it hands them on.
HELD = 4096


def _repair(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    out = []
    for conv, rows in _runs(parts):
        known = rows[0].entry == rows[0].entry and rows[0].entry is not None
        entry = int(rows[0].entry) if known else START
        paths = Paths(keep=True, entries=(entry,))
        for r in rows:
            paths.read(r.role)
        end = int(rows[0].exit) if known else choose_end(*paths.at[entry])
        last = bool(rows[0].is_last) if known else True
        roles = paths.roles(end)
        made = render([(r.role, q) for r, q in zip(rows, roles, strict=True)], [r.text for r in rows], entry, last)
        start = int(rows[0].start) if known else 0
        out += [(conv, r.turn, start + k, r.role, *m) for k, (r, m) in enumerate(zip(rows, made, strict=True))]
        if len(out) >= HELD:
            yield pd.DataFrame(out, columns=columns)
            out = []
    yield pd.DataFrame(out, columns=columns)


def format_chats(turns: DataFrame, ranges: int | None = None) -> DataFrame:
    """The repaired conversations, one row a turn: ``conv_id, turn, place, role, out_role, action,
    fragment, cost``.

    ``place`` counts a conversation's turns from 0; its fragments in order of place are its rendered
    text. Turns stand in order of turn number, null first; rows that repeat a number stand in order
    of role and of a hash of the text, so neither the input's files nor ``ranges`` change a result.
    Roles are read without regard to case; an unknown or null role must be relabelled. A null text
    is empty. Rows without a conversation are left out, as they belong to none. An empty table gives
    an empty one; other columns are ignored.

    Rows are dealt by ranges of about ``RANGE_ROWS`` at most, so what a task holds of one
    conversation is bounded however long that is.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.where("conv_id IS NOT NULL").withColumn("hash", F.xxhash64("text"))
    if ranges is None:
        ranges = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns.count() // RANGE_ROWS))
    key = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("hash")]
    # rows equal in the whole key are equal, so which of them comes first makes no difference
    dealt = rows.repartitionByRange(ranges, *key, F.monotonically_increasing_id()).withColumn("piece", F.spark_partition_id())
    return _formatted(staged(dealt, "turns"), key, ranges)


def _formatted(dealt: DataFrame, key: list, ranges: int) -> DataFrame:
    def by_piece(df: DataFrame) -> DataFrame:  # ranges of piece numbers, as hashes of them would collide
        return df.repartitionByRange(ranges, "piece").sortWithinPartitions("piece", *key)

    ends = by_piece(dealt.select("conv_id", "piece", "turn", "role", "hash")).mapInPandas(_by_piece(_ends), "conv_id long, piece int, turns long, table array<long>")
    ends = staged(ends, "ends")  # at most two rows for each range
    several = ends.groupBy("conv_id").agg(F.count_distinct("piece").alias("k")).where("k > 1").select("conv_id")
    bounds = staged(
        ends.join(several, "conv_id").groupBy("conv_id").applyInPandas(_compose, "conv_id long, piece int, start long, entry int, exit int, is_first boolean, is_last boolean"),
        "bounds",
    )
    joined = dealt.join(bounds, ["conv_id", "piece"], "left").select("conv_id", "piece", "turn", "role", "text", "hash", "start", "entry", "exit", "is_last")
    return by_piece(joined).mapInPandas(_by_piece(_repair), SCHEMA)


def _by_piece(work):
    """``work`` run on each piece of a sorted partition by itself, as its rows come."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = ((piece, rows) for pdf in parts for piece, rows in pdf.groupby("piece", sort=True))
        for _, group in itertools.groupby(some, key=operator.itemgetter(0)):
            yield from work(rows for _, rows in group)

    return run
