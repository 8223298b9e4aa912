"""Identifiers to instruments by a sweep over interval ends, and raw observations to normalised ones."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranges import ordered_fold, running_sums
from tidemark.sources.staging import staged

END, START, DELISTED, REQUEST = 0, 1, 2, 3


def resolve_at(requests: DataFrame, intervals: DataFrame, request_id: str, key: str, at: str, start: str, end: str, target: str) -> DataFrame:
    """``request_id, status, target``: RESOLVED with its one interval's target, NOT_FOUND or AMBIGUOUS, one row a request.

    Ends (exclusive), starts (inclusive) and requests stand in one order by key and time, and running
    sums give the number of open intervals and, where it is one, which it is. Cost is n log n however
    many intervals and requests a key has, and a hot key is split by ranges. An interval without a
    start, or whose end is not after its start, is never open; one without an end stays open; a
    request with a null key or time is NOT_FOUND. ``target`` is a whole number.
    """
    live = intervals.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))) & F.col(key).isNotNull() & F.col(target).isNotNull())
    kind = intervals.schema[target].dataType
    event = lambda df, time, side, n, ident: df.select(F.col(key).alias("k"), F.col(time).cast("timestamp_ntz").alias("t"), F.lit(side).alias("side"), F.lit(n).alias("n"), (F.col(ident).cast("decimal(20,0)") * n).cast("decimal(38,0)").alias("which"), F.col(ident).cast("long").alias("ident"))
    asked = requests.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    events = event(live.where(F.col(end).isNotNull()), end, END, -1, target).unionByName(event(live, start, START, 1, target)).unionByName(event(asked, at, REQUEST, 0, request_id))
    swept = running_sums(events, ["k"], ["t", "side", "ident"], {"open": F.col("n"), "one": F.col("which")}).where(F.col("side") == REQUEST)
    found = swept.select(F.col("ident").alias(request_id), F.col("open"), F.when(F.col("open") == 1, F.col("one")).cast(kind).alias(target))
    lost = requests.where(F.col(key).isNull() | F.col(at).isNull()).select(F.col(request_id).cast("long").alias(request_id), F.lit(0).cast("long").alias("open"), F.lit(None).cast(kind).alias(target))
    status = F.when(F.col("open") == 1, "RESOLVED").when(F.col("open") == 0, "NOT_FOUND").otherwise("AMBIGUOUS")
    return found.unionByName(lost).select(request_id, status.alias("status"), target)


class _Open:
    """What a sweep holds of one identifier: open mappings by the time they became known, and delistings."""

    def __init__(self):
        self.known: list[tuple] = []  # (ingested_at, instrument, start), in order
        self.delisted: dict = {}  # instrument: the earliest time at which a delisting that is in force was known

    def visible(self, known_at) -> set:
        out = set()
        count = 0
        for ingested, instrument, _ in self.known:
            if ingested > known_at:
                break
            if not self.delisted.get(instrument, known_at + 1) <= known_at:
                out.add(instrument)
                count += 1
                if count == 2:
                    return {None, instrument}
        return out


def resolve_point_in_time(requests: DataFrame, mappings: DataFrame, delistings: DataFrame) -> DataFrame:
    """``request_id, status, instrument_id`` for identifiers at (effective, known).

    ``requests``: request_id, namespace, identifier, effective_at, known_at. ``mappings``: namespace,
    identifier, instrument_id, valid_from, valid_until, ingested_at. ``delistings``: instrument_id,
    effective_at, ingested_at. A mapping counts where ``valid_from <= effective < valid_until`` and it
    was known; one of an instrument whose delisting is in force and known does not. Two mappings that
    count are AMBIGUOUS, even of one instrument; ``known_at`` before ``effective_at`` is
    KNOWN_BEFORE_EFFECTIVE; nulls in a request are NOT_FOUND. The sweep is an ordered fold: a task
    holds the mappings that are open at a time, never all of an identifier.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    keys = ["namespace", "identifier"]
    live = mappings.where("valid_from IS NOT NULL AND ingested_at IS NOT NULL AND instrument_id IS NOT NULL AND (valid_until IS NULL OR valid_until > valid_from)")
    live = live.select(*keys, "instrument_id", micros("valid_from").alias("a"), micros("valid_until").alias("b"), micros("ingested_at").alias("known"))
    none = F.lit(None).cast("long")
    shape = lambda df, side, t, known, instrument, ident, other=none: df.select(*keys, F.lit(side).alias("side"), t.alias("t"), known.alias("known"), instrument.alias("instrument_id"), ident.alias("ident"), other.alias("start"))
    kind = mappings.schema["instrument_id"].dataType.simpleString()
    nobody = F.lit(None).cast(kind)
    gone = live.select(*keys, "instrument_id").distinct().join(delistings.select("instrument_id", micros("effective_at").alias("e"), micros("ingested_at").alias("g")), "instrument_id")
    ask = requests.where("namespace IS NOT NULL AND identifier IS NOT NULL AND effective_at IS NOT NULL AND known_at IS NOT NULL")
    events = (
        shape(live.where("b IS NOT NULL"), END, F.col("b"), F.col("known"), F.col("instrument_id"), none, F.col("a"))
        .unionByName(shape(live, START, F.col("a"), F.col("known"), F.col("instrument_id"), none, F.col("a")))
        .unionByName(shape(gone.where("e IS NOT NULL AND g IS NOT NULL"), DELISTED, F.col("e"), F.col("g"), F.col("instrument_id"), none))
        .unionByName(shape(ask.where("known_at >= effective_at"), REQUEST, micros("effective_at"), micros("known_at"), nobody, F.col("request_id").cast("long")))
    )

    def step(state: _Open, row: dict):
        if row["side"] == REQUEST:
            seen = state.visible(row["known"])
            status = ("NOT_FOUND", "RESOLVED", "AMBIGUOUS")[len(seen)]
            yield row["ident"], status, next(iter(seen)) if len(seen) == 1 else None
        elif row["side"] == DELISTED:
            state.delisted[row["instrument_id"]] = min(row["known"], state.delisted.get(row["instrument_id"], row["known"]))
        else:
            entry = (row["known"], row["instrument_id"], row["start"])
            at = bisect.bisect_left(state.known, entry)
            if row["side"] == START:
                state.known.insert(at, entry)
            else:
                state.known.pop(at)

    found = ordered_fold(events, keys, ["t", "side", "ident"], _Open, step, f"request_id long, status string, instrument_id {kind}")
    early = F.coalesce(F.col("known_at") < F.col("effective_at"), F.lit(False))
    lost = requests.where("namespace IS NULL OR identifier IS NULL OR effective_at IS NULL OR known_at IS NULL OR known_at < effective_at")
    return found.unionByName(lost.select(F.col("request_id").cast("long").alias("request_id"), F.when(early, "KNOWN_BEFORE_EFFECTIVE").otherwise("NOT_FOUND").alias("status"), nobody.alias("instrument_id")))


def _number(field: str) -> Column:
    """A payload field as a finite decimal, else null."""
    return F.expr(f"try_cast(payload['{field}'] AS decimal(30,12))")


def _text(field: str) -> Column:
    return F.trim(F.coalesce(F.col("payload")[field], F.lit("")))


#: Numbers that each kind of observation carries.
NUMBERS = {"OHLCV": ("open", "high", "low", "close", "volume"), "DIVIDEND": ("amount",), "SPLIT": ("ratio",), "SYMBOL_CHANGE": (), "DELISTING": ("cash_out_price",)}


def normalize_payload(rows: DataFrame) -> DataFrame:
    """``rows`` (kind, payload map<string,string>) with ``normalized`` and ``payload_issues``, in the fixed order of their kind.

    Numbers become canonical decimal text or null, nothing is repaired. An issue comes once. A
    delisting's cash-out price is checked only where the payload has one; an unknown kind is a
    delisting by another reason, as it has no fields of its own.
    """
    n, t = _number, _text
    bad = lambda f: F.when(n(f).isNull(), f"invalid_{f}")
    whole = n("open").isNotNull() & n("high").isNotNull() & n("low").isNotNull() & n("close").isNotNull()
    priced = F.map_contains_key("payload", "cash_out_price")
    issues = {
        "OHLCV": [
            *(bad(f) for f in NUMBERS["OHLCV"]),
            F.when(t("interval") == "", "invalid_interval"),
            F.when(whole & (F.least(n("open"), n("high"), n("low"), n("close")) <= 0), "non_positive_price"),
            F.when(whole & ((n("high") < F.greatest(n("open"), n("close"))) | (n("low") > F.least(n("open"), n("close")))), "impossible_ohlc"),
            F.when(n("volume") < 0, "negative_volume"),
        ],
        "DIVIDEND": [bad("amount"), F.when(n("amount") < 0, "negative_dividend"), F.when(F.length(F.coalesce(F.col("payload")["currency"], F.lit(""))) != 3, "invalid_currency")],
        "SPLIT": [bad("ratio"), F.when(n("ratio") <= 0, "non_positive_split_ratio")],
        "SYMBOL_CHANGE": [F.when((t("old_symbol") == "") | (t("new_symbol") == "") | (t("old_symbol") == t("new_symbol")), "invalid_symbol_change")],
        "DELISTING": [F.when(t("reason") == "", "invalid_delisting_reason"), F.when(priced & n("cash_out_price").isNull(), "invalid_cash_out_price"), F.when(priced & (n("cash_out_price") < 0), "negative_cash_out_price")],
    }
    plain = {"OHLCV": ("interval",), "DIVIDEND": (), "SPLIT": (), "SYMBOL_CHANGE": ("old_symbol", "new_symbol"), "DELISTING": ("reason",)}
    text = lambda f: F.regexp_replace(F.regexp_replace(n(f).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")

    def value(kind: str) -> Column:
        parts = [x for f in NUMBERS[kind] for x in (F.lit(f), text(f))] + [x for f in plain[kind] for x in (F.lit(f), t(f))]
        if kind == "DIVIDEND":
            parts += [F.lit("currency"), F.upper(F.coalesce(F.col("payload")["currency"], F.lit("")))]
        made = F.create_map(*parts)
        return F.when(priced, made).otherwise(F.map_filter(made, lambda k, _: k != "cash_out_price")) if kind == "DELISTING" else made

    chosen, found = value("DELISTING"), F.array(*issues["DELISTING"])
    for kind in ("OHLCV", "DIVIDEND", "SPLIT", "SYMBOL_CHANGE"):
        chosen, found = F.when(F.col("kind") == kind, value(kind)).otherwise(chosen), F.when(F.col("kind") == kind, F.array(*issues[kind])).otherwise(found)
    return rows.withColumns({"normalized": chosen, "payload_issues": F.array_compact(found)})


def normalize_observations(raw: DataFrame, mappings: DataFrame, delistings: DataFrame, instruments: DataFrame) -> DataFrame:
    """``raw_id, instrument_id, status, issues, normalized``: raw observations resolved at (event, ingestion) and checked.

    ``raw``: raw_id, kind, namespace, identifier, exchange, event_at, ingested_at, payload.
    ``instruments``: instrument_id, asset_class, venue, mic. UNRESOLVED rows say why their identifier
    has no single instrument, OUT_OF_SCOPE ones are of other assets than equities and funds; the rest
    are VALIDATED, or REJECTED with their issues, the exchange's before those of the payload.
    """
    asked = raw.select(F.col("raw_id").alias("request_id"), "namespace", "identifier", F.col("event_at").alias("effective_at"), F.col("ingested_at").alias("known_at"))
    resolved = resolve_point_in_time(asked, mappings, delistings).withColumnsRenamed({"status": "resolution", "request_id": "raw_id"})
    # read once, and narrow: what has no instrument would meet in one task by its null key
    resolved = staged(resolved, "resolved")
    about = resolved.where("instrument_id IS NOT NULL").join(instruments, "instrument_id", "left")
    about = about.unionByName(resolved.where("instrument_id IS NULL"), allowMissingColumns=True)
    rows = normalize_payload(raw).join(about, "raw_id")
    away = F.when(~F.coalesce((F.col("exchange") == F.col("venue")) | (F.col("exchange") == F.col("mic")), F.lit(False)), "exchange_instrument_mismatch")
    issues = F.array_compact(F.concat(F.array(away), "payload_issues"))
    scope = F.coalesce(F.col("asset_class").isin("EQUITY", "ETF"), F.lit(False))
    status = F.when(F.col("resolution") != "RESOLVED", "UNRESOLVED").when(~scope, "OUT_OF_SCOPE").when(F.size(issues) > 0, "REJECTED").otherwise("VALIDATED")
    reasons = F.when(F.col("resolution") != "RESOLVED", F.array(F.lower("resolution"))).when(~scope, F.array(F.lit("historical_source_asset_out_of_scope"))).otherwise(issues)
    return rows.select("raw_id", "instrument_id", status.alias("status"), reasons.alias("issues"), F.when(scope & (F.col("resolution") == "RESOLVED"), F.col("normalized")).alias("normalized"))
