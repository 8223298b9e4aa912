"""Personal data by offset-preserving deobfuscation.

Base identifiers (email, ip, card, phone) are found in the text as it stands. Then transducers
rewrite disguises, keeping for every normalised character the source characters that it stands
for: homoglyphs and full-width forms become ASCII, invisible characters vanish, "[at]", "(dot)" and
"name at host dot tld" become @ and ., and runs of spelled digits become digits. The same patterns
run over the normalised text; a match that covers a rewritten place and is longer than every base
span of its kind that it overlaps is mapped back to source characters and added.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")

# Characters that look like an ASCII one, with that one.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J",
    "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "α": "a", "ο": "o", "ν": "v", "ρ": "p",
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: Spelled digits in a row from which a run is rewritten anywhere; shorter runs are where they touch a sign or digits.
LEAST_RUN = 4


def _lookalikes() -> dict[str, str]:
    """The fixed pairs, full-width ASCII and every decimal digit of another script."""
    out = dict(HOMOGLYPHS)
    out.update({chr(0xFF00 + i): chr(0x20 + i) for i in range(1, 95)})
    out.update({c: str(unicodedata.decimal(c)) for c in map(chr, range(0x80, 0x1FBFA)) if unicodedata.decimal(c, None) is not None and c not in out})
    return out


_LOOKS = _lookalikes()
_ODD_CHARS = frozenset(_LOOKS) | frozenset(INVISIBLE)
_ONE = "|".join(DIGIT_WORDS)
_DOT = r"(?:\s+dot\s+|\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\.)"
_HOST_AHEAD = rf"(?=(?!www\.)[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2}})"
_SIGN = re.compile(
    r"[\[({<]\s*(?P<sign>at|dot|@|\.)\s*[\])}>]\s*"  # white space before it is taken in by walking left
    r"|(?<=[A-Za-z0-9._%+-])(?P<at>\s+at\s+)(?=[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+)+)"
    rf"|(?<=[A-Za-z0-9._%+-])(?P<mixed>\s+at\s+){_HOST_AHEAD}"
    r"|(?<=[A-Za-z0-9-])(?P<dot>\s+dot\s+)(?=[A-Za-z0-9-])"
    rf"|(?<![A-Za-z0-9])(?P<plus>plus[\s-]+)?(?P<run>(?:{_ONE})(?:[\s,-]{{1,2}}(?:{_ONE}))*)(?![A-Za-z0-9])",
    re.IGNORECASE,
)
_BEFORE_RUN = re.compile(r"(?:\bdot|[0-9.+()\[\]-])[\s\])}>(]*\Z", re.IGNORECASE)
_AFTER_RUN = re.compile(r"[\s\[({<)-]*(?:dot\b|[0-9.()\[-])", re.IGNORECASE)
_DIGIT_WORD = re.compile(_ONE, re.IGNORECASE)
_BRACKET = re.compile(r"[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]", re.IGNORECASE)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# a leftmost match can't start inside a run of digits, so the look-behind changes nothing but time
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, in time linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        free = host.end() if host else at + 1
        if host:
            out.append((start, host.end()))
        at = text.find("@", free)
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in ``KINDS``, end) in order."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def normalised(text: str) -> tuple[str, list[int], list[int], list[int]]:
    """The rewritten text, the source start and end of each of its characters, and the places
    (normalised positions) that were rewritten."""
    chars, starts, ends, changed = [], [], [], []
    gap = False
    for i, c in enumerate(text):
        if c in INVISIBLE:
            gap = True
            continue
        new = _LOOKS.get(c, c)
        if new != c or gap:
            changed.append(len(chars))
        gap = False
        chars.append(new)
        starts.append(i)
        ends.append(i + 1)
    flat, at = "".join(chars), 0
    text_out, s_out, e_out, c_out, old = [], [], [], [], iter(changed)
    nxt = next(old, None)

    def copy(upto: int) -> None:
        nonlocal at, nxt
        while nxt is not None and nxt < upto:
            c_out.append(len(s_out) + nxt - at)
            nxt = next(old, None)
        text_out.append(flat[at:upto])
        s_out.extend(starts[at:upto])
        e_out.extend(ends[at:upto])
        at = upto

    for m in _SIGN.finditer(flat):
        if m["run"] and not m["plus"] and len(_DIGIT_WORD.findall(m["run"])) < LEAST_RUN:
            if not _BEFORE_RUN.search(flat, max(0, m.start() - 12), m.start()) and not _AFTER_RUN.match(flat, m.end()):
                continue
        first = m.start()
        while m["sign"] and first > at and flat[first - 1].isspace():
            first -= 1
        copy(first)
        while nxt is not None and nxt < m.end():
            nxt = next(old, None)
        if m["run"]:
            pieces = [("+", m.start(), m.start("run"))] if m["plus"] else []
            pieces += [(DIGIT_WORDS[d[0].lower()], d.start(), d.end()) for d in _DIGIT_WORD.finditer(flat, m.start("run"), m.end("run"))]
        else:
            pieces = [("@" if m["at"] or m["mixed"] or (m["sign"] or "").lower() in ("at", "@") else ".", first, m.end())]
        for c, a, b in pieces:
            c_out.append(len(s_out))
            text_out.append(c)
            s_out.append(starts[a])
            e_out.append(ends[b - 1])
        at = m.end()
    copy(len(flat))
    return "".join(text_out), s_out, e_out, c_out


_HINTS = ("dot", "two", "three", "four", "five", "six", "seven", "eight", "nine", "zero", "one", "oh", " at ")
_HINT_WORD = re.compile(r"(?<![a-z0-9])(?:dot|two|three|four|five|six|seven|eight|nine|zero|one|oh)(?![a-z0-9])|\sat\s+[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2}")


def _disguised(text: str) -> bool:
    """Whether a transducer could rewrite anything; a few quick searches over the whole text."""
    if not text.isascii() and not _ODD_CHARS.isdisjoint(set(text)):
        return True
    low = text.lower()
    return any(w in low for w in _HINTS) and bool(_HINT_WORD.search(low)) or bool(_BRACKET.search(text))


def all_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and those found behind disguises."""
    if not _disguised(text):
        return base
    flat, starts, ends, marks = normalised(text)
    extra, k = [], 0
    kinds = [[(x, y) for x, kind, y in base if kind == j] for j in range(len(KINDS))]  # in order, without overlap
    at = [0] * len(KINDS)
    for s, kind, e in base_spans(flat):
        while k < len(marks) and marks[k] < s:
            k += 1
        if k == len(marks) or marks[k] >= e:
            continue
        a, b = starts[s], ends[e - 1]
        known, j = kinds[kind], at[kind]
        while j < len(known) and known[j][1] <= a:
            j += 1
        at[kind] = j  # spans of a kind come in order too
        longest = 0
        while j < len(known) and known[j][0] < b:
            longest, j = max(longest, known[j][1] - known[j][0]), j + 1
        if longest < b - a:
            extra.append((a, kind, b))
    return sorted({*base, *extra})


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_FOUND = T.StructType([
    T.StructField("base", T.StringType()),
    T.StructField("spans", T.StringType()),
    *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
])


@F.pandas_udf(_FOUND)
def _find(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base = base_spans(text)
        every = all_spans(text, base)
        counts = [0] * len(KINDS)
        for _, k, _ in every:
            counts[k] += 1
        rows.append((hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), *counts))
    return pd.DataFrame(rows, columns=[f.name for f in _FOUND])


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row.

    The counts are of all spans. Texts are read whole, in time linear in their length. A null text is empty: no spans. Null ids stay null, repeated rows
    are repeated, an empty table gives an empty one, other columns are ignored.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _find(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("f"))
    return found.select("doc_id", *(f"f.n_{k}" for k in KINDS), F.col("f.base").alias("base_sha256"), "f.spans")


def span_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, start, end``: one row for each span, in the source's code points.

    Texts without spans, null ones too, have no row; null ids stay null, repeated rows give repeated
    rows, an empty table gives an empty one, other columns are ignored.
    """
    each = personal_data(docs).where("spans <> ''").select("doc_id", F.explode(F.split("spans", ",")).alias("s"))
    part = F.split("s", ":")
    return each.select("doc_id", part[0].alias("kind"), part[1].cast("long").alias("start"), part[2].cast("long").alias("end"))
