"""Token buckets over a log, in slices: a slice of one key's events is a function of the tokens at its start, so that a busy key is spread over tasks."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, staged

#: A piece (start, value, rises): from ``start`` on the function is ``value``, or rises by one with each step from there.
Piece = tuple[int, int, bool]


def piece_of(start: int, value: int, end: int, rises: bool) -> Piece:
    return start, value, rises and end > start


class Tokens:
    """What a run of events does to a bucket, as a function of what it holds (0 to ``full``) at the first of them.

    Each event refills the bucket up to ``full`` and takes one ``token`` if there is one. The pieces of the function number at most about twice the capacity, however
    many events there are: a refill cuts off the top, which leaves a constant, and a token taken joins what it had parted.
    """

    def __init__(self, full: int, token: int):
        self.full, self.token = full, token
        self.pieces: list[Piece] = [(0, 0, True)]

    def event(self, passed: int) -> None:
        """One more event, ``passed`` microseconds after the one before."""
        out: list[Piece] = []
        for i, (start, value, rises) in enumerate(self.pieces):
            end = self.pieces[i + 1][0] - 1 if i + 1 < len(self.pieces) else self.full
            value = min(self.full, value + passed)
            top = start + self.full - value if rises else end + 1  # from here on the bucket is full
            for a, v, b, up in ((start, value, min(end, top), rises), (min(end, top) + 1, self.full, end, False)):
                if a > b:
                    continue
                from_here = a if v >= self.token else min(b + 1, a + self.token - v) if up else b + 1  # from here on there is a token
                if from_here > a:
                    self._add(out, piece_of(a, v, from_here - 1, up), from_here - 1)
                if from_here <= b:
                    self._add(out, piece_of(from_here, v + (from_here - a if up else 0) - self.token, b, up), b)
        self.pieces = out

    @staticmethod
    def _add(out: list[Piece], piece: Piece, end: int) -> None:
        """Append a piece, joined to the one before where that goes on into it."""
        start, value, rises = piece
        if out:
            s, v, up = out[-1]
            last = v + (start - 1 - s if up else 0)
            single, alone = s == start - 1, start == end
            if value == last and (not up or single) and not rises:
                out[-1] = (s, v, False)
                return
            if value == last + 1 and (up or single) and (rises or alone):
                out[-1] = (s, v, True)
                return
        out.append(piece)

    @property
    def constant(self) -> bool:
        return len(self.pieces) == 1 and not self.pieces[0][2]

    def fix(self, value: int) -> None:
        self.pieces = [(0, value, False)]


def value_at(pieces: list, x: int) -> int:
    start, value, rises = pieces[bisect_right([p[0] for p in pieces], x) - 1]
    return value + (x - start if rises else 0)


PIECES = "array<struct<start:bigint,value:bigint,rises:boolean>>"


def token_bucket(events: DataFrame, key: str, at: str, order: str, capacity: float, per_second: float, slices: int | None = None) -> DataFrame:
    """``key``, ``order``, ``allowed``, ``remaining``: a bucket for each key that refills steadily; an event takes one token or is refused.

    A bucket is counted in the microseconds that fill it, in whole numbers, so that results don't hang on rounding. Events are dealt to ``slices`` by ranges of key, time and order (by
    default as many as the session's shuffle partitions), so a busy key lies in many of them. Only a slice's first key may have begun in an earlier one: all other keys are decided at
    once, and the first key's events are summed up as a function. The functions (at most two for each slice) are applied in order, and then the events still open are walked from
    their slice's start. One bucket is held at a time. An event without a key or a time has no bucket; events of one key, time and order are taken as equal.
    """
    token = round(1e6 / per_second)
    full = round(capacity * token)
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, order)}
    own = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}"

    def first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun = sole = False  # is there a key, is it the slice's first
        now = slice_no = None
        f, held, first_us, then = Tokens(full, token), full, 0, 0

        def summary() -> pd.DataFrame:
            if not sole:
                f.fix(held)
            return pd.DataFrame({key: [now], order: pd.Series([None], dtype=object), "us": [then], "slice": [slice_no], "allowed": pd.Series([None], dtype=object), "remaining": pd.Series([None], dtype=object), "first_us": [first_us], "pieces": [[{"start": s, "value": v, "rises": r} for s, v, r in f.pieces]]})

        for b in batches:
            allowed, remaining, sums = [], [], []
            for k, us, s in zip(b[key].tolist(), b["us"].tolist(), b["slice"].tolist(), strict=True):
                if not begun or k != now:
                    if begun and sole:
                        sums.append(summary())
                    sole, begun, now, slice_no, held, first_us, then = not begun, True, k, s, full, us, us
                if sole:
                    if f.constant:
                        x = min(full, f.pieces[0][1] + us - then)
                        f.fix(x - token * (x >= token))
                    else:
                        f.event(us - then)
                    allowed.append(None)
                    remaining.append(None)
                else:
                    held = min(full, held + us - then)
                    ok = held >= token
                    held -= token * ok
                    allowed.append(ok)
                    remaining.append(held // token)
                then = us
            yield pd.DataFrame({key: b[key], order: b[order], "us": b["us"], "slice": b["slice"], "allowed": pd.Series(allowed, dtype=object), "remaining": pd.Series(remaining, dtype=object), "first_us": pd.Series([None] * len(b), dtype=object), "pieces": pd.Series([None] * len(b), dtype=object)})
            yield from sums
        if begun:
            yield summary()

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, then, begun = None, full, 0, False
        for b in batches:
            out = []
            for k, first_us, last_us, pieces in zip(b[key].tolist(), b["first_us"].tolist(), b["us"].tolist(), b["pieces"].tolist(), strict=True):
                if not begun or k != now:
                    held, then = full, first_us
                begun, now = True, k
                x = min(full, held + int(first_us) - int(then))
                out.append(x)
                held, then = value_at([(p["start"], p["value"], p["rises"]) for p in pieces], x), last_us
            yield pd.DataFrame({key: b[key], "slice": b["slice"], "held": out})

    def second_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_slice, held, then = None, full, 0
        for b in batches:
            allowed, remaining = [], []
            for s, us, at_start in zip(b["slice"].tolist(), b["us"].tolist(), b["held"].tolist(), strict=True):
                held = at_start if s != own_slice else min(full, held + us - then)
                own_slice, then, ok = s, us, held >= token
                held -= token * ok
                allowed.append(ok)
                remaining.append(held // token)
            yield pd.DataFrame({key: b[key], order: b[order], "allowed": allowed, "remaining": remaining})

    ship(events.sparkSession)
    rows = events.select(key, order, F.unix_micros(F.col(at).cast("timestamp")).alias("us")).where(F.col(key).isNotNull() & F.col("us").isNotNull())
    ranges = rows.repartitionByRange(*([slices] if slices else []), key, "us", order).withColumn("slice", F.spark_partition_id())
    passed = staged(ranges.sortWithinPartitions(key, "us", order).mapInPandas(first_pass, f"{own}, us long, slice int, allowed boolean, remaining int, first_us long, pieces {PIECES}"))
    sums = passed.where("pieces is not null").select(key, "slice", "us", "first_us", "pieces")
    held = staged(sums.repartition(key).sortWithinPartitions(key, "slice").mapInPandas(starts, f"`{key}` {kinds[key]}, slice int, held long"))
    open_ = passed.where("pieces is null and allowed is null").select(key, order, "us", "slice").join(held, [key, "slice"])
    # A slice has one key whose events are open.
    walked = open_.repartition("slice").sortWithinPartitions("slice", "us", order).mapInPandas(second_pass, f"{own}, allowed boolean, remaining int")
    return passed.where("allowed is not null").select(key, order, "allowed", "remaining").unionByName(walked)
