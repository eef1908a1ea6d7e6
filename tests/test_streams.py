"""Streams against plain Python and against their batch forms."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quern.streaming import coalesce, runs

SCHEMA = "key string, seq long, ms long, kind string, text string, other boolean"


def events(seed, n=300):
    rng, out, ms = random.Random(seed), [], 0
    for seq in range(n):
        ms += rng.choice([0, 0, 1, 3, 9, 16, 17, 60])
        kind = rng.choice(["text"] * 6 + ["reasoning"] * 3 + ["tool", "usage"])
        out.append((rng.choice("ab"), seq, ms, kind, rng.choice(["x", "é", "yy" * 9, "", None]) if rng.random() < 0.9 else "z" * 70, rng.random() < 0.05))
    return out + [(None, 1, 5, "text", "lost", False), ("a", 1, None, "text", "lost", False)]


def plain(rows, window, most):
    """As the rules are written: a sink that remembers what waits, with a timer."""
    out = []
    for key in sorted({r[0] for r in rows if r[0]}):
        last, held = None, None  # held: kind, texts, since
        mine = sorted((r[2], r[1], r[3], r[4] or "", r[5]) for r in rows if r[0] == key and r[2] is not None)

        def flush(at, why):
            nonlocal last, held
            if held:
                out.append((key, held[0], "".join(held[1]), len(held[1]), held[2], at, why))
                last, held = at, None

        for ms, _, kind, text, other in mine:
            if held and ms >= held[2] + window:
                flush(held[2] + window, "time")
            if kind not in ("text", "reasoning") or not text or other:
                flush(ms, "barrier")
                out.append((key, kind, text, 1, ms, ms, "other"))
                continue
            if held and held[0] != kind:
                flush(ms, "kind")
            if not held and (last is None or ms - last >= window):
                last = ms
                out.append((key, kind, text, 1, ms, ms, "first"))
                continue
            held = held or (kind, [], ms)
            held[1].append(text)
            if sum(len(t.encode()) for t in held[1]) >= most:
                flush(ms, "size")
        if held:
            flush(held[2] + window, "time")
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_coalesce(spark, seed):
    rows = events(seed)
    got = coalesce.coalesce(spark.createDataFrame(rows, SCHEMA).repartition(3), ["text", "reasoning"], 16, 64)
    want = plain(rows, 16, 64)
    assert sorted(map(tuple, got.collect())) == want and {w[-1] for w in want} == {"first", "other", "time", "kind", "barrier", "size"}
    assert "".join(w[2] for w in sorted(want, key=lambda w: (w[0], w[4]))).count("z") == sum((r[4] or "").count("z") for r in rows if r[0] and r[2] is not None)
    assert coalesce.coalesce(spark.createDataFrame([], SCHEMA), ["text"]).count() == 0


def files(spark, path, rows, schema, n, shuffled=0, seed=1):
    """Rows in ``n`` files, in order but for swaps of neighbours ``shuffled`` apart."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[0] + (rng.randint(0, shuffled) if shuffled else 0))
    step = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_coalesce_stream_is_the_batch_form(spark, tmp_path):
    rows = [r for r in events(7) if r[0] and r[2] is not None]
    base = 1_700_000_000_000
    timed = [(base + r[2], *r[:2], *r[3:]) for r in rows]
    stream = files(spark, str(tmp_path / "in"), timed, "ms long, key string, seq long, kind string, text string, other boolean", 6, shuffled=200)
    late = coalesce.coalesce_stream(stream.withColumn("ts", F.timestamp_millis("ms")), ["text", "reasoning"], "1 second", 16, 64)
    got = sorted(tuple(r)[:7] for r in runs.updates(late, "append").collect())
    upto = max(r[0] for r in timed) - 1000
    want = sorted((k, kind, t, n, first + base, at + base, why) for k, kind, t, n, first, at, why in plain(rows, 16, 64) if at + base <= upto)
    assert got == want and len(got) > 50


CALLS = "ts timestamp, key string, call string, refreshed boolean"
RESULTS = "ts timestamp, key string, call string, ms long"


def call_rows(seed):
    from datetime import datetime, timedelta, timezone

    rng, at = random.Random(seed), lambda m: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=m)
    told, came = [], []
    for c in range(60):
        m = c * 7
        key, call = rng.choice("ab"), f"c{c % 40}"
        if rng.random() < 0.85:
            told.append((at(m), key, call, False))
            told += [(at(m + 2), key, call, False)] * (rng.random() < 0.4)
            told += [(at(m + 3), key, call, True)] * (rng.random() < 0.4)  # refreshed: no new announcement
        if rng.random() < 0.85:
            came.append((at(m + rng.choice([2, 4, 9, 31])), key, call, rng.randint(1, 900)))
    told += [(at(3), "a", None, False)]
    return told, came


def plain_calls(told, came, minutes=30):
    from datetime import timedelta

    told = [t for t in told if not t[3] and t[2]]
    out = []
    for ts, key, call, ms in came:
        mine = [t for t, k, c, _ in told if (k, c) == (key, call) and t <= ts <= t + timedelta(minutes=minutes)]
        out.append((key, call, max(mine, default=None), ts, ms, "answered" if mine else "orphan"))
    for key, call in {t[1:3] for t in told}:
        last = max(t for t, k, c, _ in told if (k, c) == (key, call))
        if not any((k, c) == (key, call) and last <= ts <= last + timedelta(minutes=minutes) for ts, k, c, _ in came):
            out.append((key, call, last, None, None, "open"))
    return sorted(out, key=str)


def test_calls_late_and_refreshed(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    from quern.streaming import calls

    told, came = call_rows(5)
    want = plain_calls(told, came)
    utc = lambda rows: sorted([tuple(x.astimezone(timezone.utc) if isinstance(x, datetime) else x for x in r) for r in rows], key=str)
    batch = calls.settled(calls.joined(spark.createDataFrame(told, CALLS), spark.createDataFrame(came, RESULTS), "10 minutes", "30 MINUTES"))
    assert utc(batch.collect()) == want and {w[-1] for w in want} == {"answered", "orphan", "open"}
    far = max(t[0] for t in told + came) + timedelta(days=1)  # moves the watermark over all that came before
    path = lambda n: str(tmp_path / n)

    def three(rows, schema, name):
        rows = sorted(rows, key=str)
        third = -(-len(rows) // 3)
        late = rows[third - 2]  # comes a file later than its neighbours, within the watermark
        parts = [rows[: third - 2] + rows[third - 1 : third], [late, *rows[third : 2 * third]], [*rows[2 * third :], (far, "end", "end", *([False] if "refreshed" in schema else [1]))]]
        for k, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path(name)}/{k}")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path(name))

    rows = runs.updates(calls.joined(three(told, CALLS, "told"), three(came, RESULTS, "came"), "90 minutes", "30 MINUTES"), "append").drop("batch")
    assert utc(calls.settled(rows.where("key != 'end'")).collect()) == want
    sums = {r.key: r for r in calls.totals(batch).collect()}
    assert sums["a"].orphan_ms == sum(w[4] for w in want if w[0] == "a" and w[-1] == "orphan") and sums["b"].open == sum(w[0] == "b" and w[-1] == "open" for w in want)


def test_fan_out_after_a_failure(spark, tmp_path):
    from quern.operators.versioned import VersionedTable
    from quern.streaming import fanout

    rows = [(i, "xyz"[i % 3]) for i in range(90)]
    stream = lambda: spark.readStream.schema("i long, k string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    files(spark, str(tmp_path / "in"), rows, "i long, k string", 3)
    counts, last = VersionedTable(spark, str(tmp_path / "counts")), VersionedTable(spark, str(tmp_path / "last"))

    class Failing(fanout.Latest):
        left = 1

        def take(self, rows, batch):
            if batch == 1 and Failing.left:
                Failing.left -= 1
                raise RuntimeError("the second sink fails once")
            super().take(rows, batch)

    sinks = lambda: [fanout.Counters(counts, ["k"]), None, Failing(last, ["k"], ["i"]), fanout.Files(str(tmp_path / "log"))]
    with pytest.raises(Exception, match="fails once"):
        fanout.fan_out(stream(), sinks(), str(tmp_path / "run"))
    assert counts.batch() == 1 and last.batch() == 0
    fanout.fan_out(stream(), sinks(), str(tmp_path / "run"))
    assert {r.k: r.n for r in counts.read().collect()} == {"x": 30, "y": 30, "z": 30}
    assert {r.k: r.i for r in last.read().collect()} == {"x": 87, "y": 88, "z": 89}
    assert spark.read.parquet(str(tmp_path / "log")).count() == 90 and counts.batch() == last.batch() == 2
    counted = len(counts.entries())
    fanout.fan_out(stream(), sinks(), str(tmp_path / "run"))  # nothing new
    assert len(counts.entries()) == counted


def plain_replay(records, most_bytes, most_records):
    if sum(r[4] for r in records) > most_bytes:
        return 0, 0, 0, "bytes", records[0][0]
    held, read = [], 0
    for seq, kind, idx, n, size, version, sound in records:
        why = "damaged" if not sound else "unsupported" if version != 1 else "records" if read >= most_records else "damaged" if kind == "append" and idx != sum(h[0] for h in held) else "unsupported" if kind not in ("append", "replace") else None
        if why:
            return read, sum(h[0] for h in held), sum(h[1] for h in held), why, seq
        held = [(n, size)] if kind == "replace" else [*held, (n, size)]
        read += 1
    return read, sum(h[0] for h in held), sum(h[1] for h in held), "end", None


def test_replay_stops(spark):
    from quern.operators.replay import replay

    rng, logs = random.Random(9), {}
    for log in range(120):
        held, records = 0, []
        for seq in range(rng.randint(1, 12)):
            n, kind = rng.randint(0, 3), rng.choice(["append"] * 5 + ["replace"])
            idx = held
            if rng.random() < 0.06:
                idx = rng.choice([held + 1, None])
            held = n if kind == "replace" else held + n
            records.append((seq * 2, "other" if rng.random() < 0.03 else kind, idx, n, rng.choice([5, 5, 60]), 2 if rng.random() < 0.03 else 1, rng.random() > 0.04))
        logs[log] = records
    df = spark.createDataFrame([(log, *r) for log, rs in logs.items() for r in rs], "log long, seq long, kind string, idx long, n long, bytes long, version int, sound boolean")
    want = {log: plain_replay(rs, 250, 6) for log, rs in logs.items()}
    assert {r.log: tuple(r)[1:] for r in replay(df, 250, 6).collect()} == want
    assert {w[3] for w in want.values()} == {"end", "damaged", "unsupported", "records", "bytes"}
