"""Texts as chunks whose tokens don't depend on their neighbours.

In a byte-level vocabulary's pre-tokenizer a pre-token starts wherever a space stands between two
other characters, and a line break between two such characters is a pre-token by itself. So the
chunks between single spaces and single line breaks can be looked up one by one, with the space
before them. Runs of white space span chunks; texts that have any are left to the caller.
"""

from __future__ import annotations

from collections.abc import Callable


class Spanning(Exception):
    """White space that several chunks share."""


class ChunkMemory(dict):
    """Value by chunk, worked out when first asked for; emptied at a bound."""

    def __init__(self, value: Callable[[str], object], lead: str, most: int, longest: int = 64):
        super().__init__()
        self.value, self.lead, self.most, self.longest = value, lead, most, longest

    def __missing__(self, chunk: str):
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise Spanning
        got = self.value(self.lead + chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = got
        return got


def lines_of_chunks(text: str) -> list[list[str]]:
    return [line.split(" ") for line in text.split("\n")]
