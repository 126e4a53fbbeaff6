"""Structured Streaming forms of the stream policies.

The keyed policies are the folds of the batch forms, run in event-time order:
rows wait until the watermark has passed them, so files that overlap in time
give the batch result, and what a stream has told at its end is the batch
result up to its watermark. Times are milliseconds since 1970, those of the
event-time column. States end by timer as soon as they are due, without a
further row, and leave nothing behind. Start these queries within
inorder.rocksdb_state(spark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.folds import Fold, behind_gate, endpoint_fold, machine_fold, period_step, vote_step, vote_winner
from .inorder import folded_in_order


def sliding_counts(stream: DataFrame, key: str, ts: str, width: str, stride: str, late: str) -> DataFrame:
    """ES1: counts and peaks of sliding windows, final once the watermark has passed."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width, stride).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "top")


def accepted_only(stream: DataFrame, ok: Column) -> DataFrame:
    """ES2: stateless threshold policy."""
    return stream.where(F.coalesce(ok, F.lit(False)))


def _named(stream: DataFrame, key: str) -> str:
    return f"`{key}` {stream.schema[key].dataType.simpleString()}"


def debounced(stream: DataFrame, session: str, at: str, refractory: int, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """ES3: rows (session, t) that fire; emitted if `refractory` has passed since the session's last emission."""

    def step(last, row):
        go = last is None or row[1] - last >= refractory
        return (row[1] if go else last), [(row[0], row[1], go)]

    fold = Fold(lambda: None, step, lambda last: last + refractory, lambda key, last: [])
    return folded_in_order(stream, session, [at], ts, late, f"{_named(stream, session)}, `{at}` bigint, emitted boolean", fold)


def gated(stream: DataFrame, session: str, at: str, score: str, threshold: float, period: int, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """ES4: rows while the gate is open; a detection opens it or restarts its period."""
    seen = Fold(lambda: None, lambda s, row: (s, [(row[0], row[1], row[2])] if row[2] is not None else []), lambda s: None, lambda key, s: [])
    gate = behind_gate(threshold, period, seen)
    fold = gate._replace(due=lambda s: None if s[0] is None else s[0] + period)
    return folded_in_order(stream, session, [at, score], ts, late, f"{_named(stream, session)}, `{at}` bigint, opened_at bigint", fold)


def _firing_first(row: tuple) -> tuple:
    """Order of (t, fires, ...): a row at the time of a detection belongs to the period that it opens."""
    return row[0], not row[1], *[(x is not None, x) if x is not None else (False,) for x in row[2:]]


def mode_periods(stream: DataFrame, session: str, at: str, fires: str, cls: str, confidence: str, length: int, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """ES5: the mode vote of each whole period, at its end; a new detection within it discards it."""
    fold = Fold(lambda: (None, {}), vote_step(length), lambda s: None if s[0] is None else s[0] + length, lambda key, s: vote_winner(key[0], *s), _firing_first)
    return folded_in_order(stream, session, [at, fires, cls, confidence], ts, late, f"{_named(stream, session)}, pid bigint, `{cls}` string, votes bigint, latest bigint, mean double", fold)


def single_periods(stream: DataFrame, session: str, at: str, fires: str, length: int, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """ES6: one request a period, at its end or where a detection restarts it."""
    fold = Fold(lambda: None, period_step(length), lambda start: start + length, lambda key, start: [(key[0], start, False, start + length)], _firing_first)
    return folded_in_order(stream, session, [at, fires], ts, late, f"{_named(stream, session)}, start bigint, restarted boolean, `end` bigint", fold)


def endpointed(stream: DataFrame, session: str, score: str, threshold: float, gate: int, period: int, stable: int, idle: int, least_audio: int = 300, least_speech: int = 200, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """ES7 behind a live gate (ES4): polls with a score, as the batch form has them otherwise. A session without polls for `idle` milliseconds is over: its open period is told as timed out by timer, and it is forgotten."""
    cols = ["t", score, "intent", "slots", "ok", "ended", "fallback_ended", "speech", "fallback"]
    fold = behind_gate(threshold, gate, endpoint_fold(period, stable, least_audio, least_speech, idle))
    return folded_in_order(stream, session, cols, ts, late, f"{_named(stream, session)}, opened_at bigint, t bigint, intent string, slots string, reason string", fold)


def machine(stream: DataFrame, device: str, at: str, order: str, event: str, start: str, table: dict[tuple[str, str], str], idle: int, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """ES14: the state after each event and whether the table lists the move. A device without events for `idle` milliseconds is forgotten and starts anew."""
    return folded_in_order(stream, device, [at, order, event], ts, late, f"{_named(stream, device)}, `{order}` bigint, state string, changed boolean", machine_fold(start, table, idle))


def latest(stream: DataFrame, key: str, at: str, item: str) -> DataFrame:
    """ES15: the latest item of each key, for update or complete mode."""
    return stream.groupBy(key).agg(F.max_by(item, at).alias(item), F.max(at).alias(at))
