"""Bursts of deltas merged into one event, by one fold for tables and for streams.

The first delta of a burst goes out at once. Those that come within ``window`` milliseconds of what went out last wait, and
go out as one: when the window since the first that waits has passed, when another kind or any other event comes, or when they
have grown to ``most`` bytes. The order of a key's events is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import series

#: Milliseconds between two events that go out, and bytes that one holds.
WINDOW_MS, MOST_BYTES = 16, 16 << 10
LONG_AGO = -(1 << 62)


@dataclass
class Fold:
    """What waits of a key. Events are (ms, kind, text); what goes out is (kind, text, n, first_ms, at_ms, why)."""

    window: int = WINDOW_MS
    most: int = MOST_BYTES
    last: int = LONG_AGO
    kind: str | None = None
    since: int = 0
    texts: list[str] = field(default_factory=list)
    size: int = 0

    def _out(self, at: int, why: str) -> Iterator[tuple]:
        if self.kind is not None:
            yield self.kind, "".join(self.texts), len(self.texts), self.since, at, why
            self.kind, self.texts, self.size, self.last = None, [], 0, at

    def tick(self, now: int) -> Iterator[tuple]:
        """Time has come to ``now``."""
        if self.kind is not None and now >= self.since + self.window:
            yield from self._out(self.since + self.window, "time")

    def push(self, ms: int, kind: str, text: str, delta: bool) -> Iterator[tuple]:
        yield from self.tick(ms)
        if not delta:
            yield from self._out(ms, "barrier")
            yield kind, text, 1, ms, ms, "other"
            return
        if self.kind is not None and self.kind != kind:
            yield from self._out(ms, "kind")
        if self.kind is None and ms - self.last >= self.window:
            self.last = ms
            yield kind, text, 1, ms, ms, "first"
            return
        if self.kind is None:
            self.kind, self.since = kind, ms
        self.texts.append(text)
        self.size += len(text.encode())
        if self.size >= self.most:
            yield from self._out(ms, "size")


OUT = "kind string, text string, n int, first_ms bigint, at_ms bigint, why string"
_NAMES = ["kind", "text", "n", "first_ms", "at_ms", "why"]


def _deltas(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """A delta is an event of one of ``kinds`` that carries text and nothing else; ``other`` says whether there is anything else."""
    return rows.withColumn("delta", F.col("kind").isin(kinds) & (F.coalesce(F.length("text"), F.lit(0)) > 0) & ~F.coalesce("other", F.lit(False))).withColumn("text", F.coalesce("text", F.lit("")))


def coalesce(rows: DataFrame, kinds: list[str], window: int = WINDOW_MS, most: int = MOST_BYTES) -> DataFrame:
    """(key, kind, text, n, first_ms, at_ms, why) of rows (key, seq, ms, kind, text, other), in the order of (ms, seq) within a key.

    A pause of more than two windows leaves nothing waiting and lets the next delta go at once, so the events between two such
    pauses are folded by themselves: a busy key is many tasks' work, and a task streams through its rows. Rows without a
    key or a time go nowhere.
    """
    plain = _deltas(rows, kinds).where("key is not null and ms is not null").select("key", "seq", "ms", "kind", "text", "delta")
    gap = F.col("ms") - F.lag("ms").over(Window.partitionBy("key").orderBy("ms", "seq"))
    parts = series.islands(plain.withColumn("gap", gap), ["key"], ["ms", "seq"], F.coalesce(F.col("gap") > 2 * window, F.lit(True)), "burst")
    schema = f"key {dict(plain.dtypes)['key']}, {OUT}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, at = Fold(window, most), None
        for p in batches:
            out = []
            for key, burst, ms, kind, text, delta in zip(*(p[c].tolist() for c in ("key", "burst", "ms", "kind", "text", "delta")), strict=True):
                if at != (key, burst):
                    out += [(at[0], *o) for o in fold.tick(1 << 62)] if at else []
                    fold, at = Fold(window, most), (key, burst)
                out += [(key, *o) for o in fold.push(ms, kind, text, delta)]
            yield pd.DataFrame(out, columns=["key", *_NAMES])
        if at:
            yield pd.DataFrame([(at[0], *o) for o in fold.tick(1 << 62)], columns=["key", *_NAMES])

    return parts.repartition("key", "burst").sortWithinPartitions("key", "burst", "ms", "seq").mapInPandas(run, schema)


STATE = "last bigint, kind string, since bigint, texts array<string>, waiting array<struct<ms:bigint, seq:bigint, kind:string, text:string, delta:boolean>>"


def coalesce_stream(rows: DataFrame, kinds: list[str], late: str, window: int = WINDOW_MS, most: int = MOST_BYTES) -> DataFrame:
    """The same over a stream whose rows have an event time ``ts`` besides; gives what :func:`coalesce` gives with ``at_ms`` up to the watermark.

    Events wait until the watermark has passed them, so files may bring them in any order within ``late``; then they are folded in the order
    of time. What waits for its window goes out when the watermark passes that, by a timer. Events behind the watermark are dropped.
    """
    kind_of_key = dict(rows.dtypes)["key"]

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, kind, since, texts, waiting = state.get if state.exists else (LONG_AGO, None, 0, [], [])
        own = Fold(window, most, last, kind, since, list(texts), sum(len(t.encode()) for t in texts))
        now = state.getCurrentWatermarkMs()
        waiting = [tuple(w) for w in waiting]
        if not state.hasTimedOut:
            for p in parts:
                waiting += zip(*(p[c].tolist() for c in ("ms", "seq", "kind", "text", "delta")), strict=True)
        waiting.sort()
        out = []
        while waiting and waiting[0][0] <= now:
            ms, _, k, text, delta = waiting.pop(0)
            out += own.push(ms, k, text, delta)
        out += own.tick(now)
        ends = [w[0] for w in waiting[:1]] + ([own.since + window] if own.kind is not None else [])
        if ends:
            state.update((own.last, own.kind, own.since, own.texts, waiting))
            state.setTimeoutTimestamp(max(now + 1, min(ends)))
        elif now - own.last < window:  # the next delta may still be too close to what went out last
            state.update((own.last, None, 0, [], []))
            state.setTimeoutTimestamp(max(now + 1, own.last + window))
        else:
            state.remove()
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["key", *_NAMES])

    marked = _deltas(rows, kinds).where("key is not null and ms is not null").withWatermark("ts", late).select("key", "seq", "ms", "kind", "text", "delta", "ts")
    return marked.groupBy("key").applyInPandasWithState(fold, f"key {kind_of_key}, {OUT}", STATE, "append", "EventTimeTimeout")
