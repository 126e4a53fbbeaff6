"""Stream policies in batch form: gates, votes, refractory periods, replay scores. Sessions are partitions; time is an integer."""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import dealt_sorted, endpoint_fold, fold_in_order, fold_sorted


def sliding(df: DataFrame, key: str, ts: str, width: str, stride: str) -> DataFrame:
    """ES1: observations in each sliding window; windows that end after the last event are left out."""
    w = df.groupBy(key, F.window(ts, width, stride).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    end = df.agg(F.max(ts).alias("_end"))
    return w.crossJoin(end).where(F.col("w.end") <= F.col("_end")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "top")


def threshold_policy(df: DataFrame, ok: Column) -> DataFrame:
    """ES2: accepted observations."""
    return df.where(F.coalesce(ok, F.lit(False)))


def debounce(df: DataFrame, session: str, at: str, fire: Column, refractory: int, key: str, stretch: int = 64) -> DataFrame:
    """ES3: a firing row is emitted if `refractory` has passed since the last emission, else suppressed, as is one without a time; of rows at one time the first by key.

    Who follows an emission is known without the past: the first row that is `refractory` later. A stretch of `stretch` refractory periods that comes after a pause begins with its first row. Others are summed up by themselves, as the last emission that every possible first one leads to, and a session's summaries are composed in order. So each stretch's first emission is known, and a session is as many tasks as it has stretches, whose sorted rows stream.
    """
    c, kind = F.col, df.schema[session].dataType.simpleString()
    rows = df.where(fire).select(session, c(at).cast("long").alias("_t"), c(key).cast("long").alias("_k")).withColumn("_c", F.floor(c("_t") / (stretch * max(refractory, 1))))
    if refractory <= 0:
        return rows.select(session, c("_k").alias(key), c("_t").isNotNull().alias("emitted"))

    def sum_up(group: pa.Table) -> pa.Table:
        t = np.sort(group["_t"].to_numpy())
        last = np.searchsorted(t, t + refractory)
        last = np.where(last < len(t), last, np.arange(len(t)))
        while not np.array_equal(last, last[last]):  # leaps double
            last = last[last]
        # an emission before the stretch is less than `refractory` before it: the first one here lies in its first period, or is the first row after that
        many = int(np.searchsorted(t, (group["_c"][0].as_py() * stretch + 1) * refractory)) + 1
        return pa.table({session: group[session].slice(0, 1), "_c": group["_c"].slice(0, 1), "firsts": pa.array([t[:many]], pa.list_(pa.int64())), "lasts": pa.array([t[last][:many]], pa.list_(pa.int64()))})

    def compose(before, row):
        i = 0 if before is None else bisect.bisect_left(row[2], before + refractory)
        return (row[3][i], [(row[0], row[1], row[2][i])]) if i < len(row[2]) else (before, [])

    times = rows.where(c("_t").isNotNull()).groupBy(session, "_c").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"))
    w = Window.partitionBy(session).orderBy("_c")
    tied = F.coalesce(c("lo") - F.lag("hi").over(w) < refractory, F.lit(False)), F.coalesce(F.lead("lo").over(w) - c("hi") < refractory, F.lit(False))
    times = times.withColumns({"tied": tied[0], "_in": F.struct(session, "_c"), "leads": tied[1]})
    chain = rows.select(F.struct(session, "_c").alias("_in"), "_t").distinct().join(times.where("tied OR leads").select("_in"), "_in", "left_semi").select(f"_in.{session}", "_in._c", "_t")
    summaries = chain.groupBy(session, "_c").applyInArrow(sum_up, f"`{session}` {kind}, _c long, firsts array<long>, lasts array<long>")
    composed = fold_sorted(summaries, [session], ["_c"], f"`{session}` {kind}, _c long, first long", lambda: None, compose)
    firsts = times.where("NOT tied AND NOT leads").select("_in", c("lo").alias("first")).unionByName(composed.select(F.struct(session, "_c").alias("_in"), "first"))
    # a stretch's first emission travels ahead of its rows
    none = F.lit(None).cast("long")
    known = rows.select(session, "_c", "_t", "_k", none.alias("first")).unionByName(firsts.select(f"_in.{session}", "_in._c", none.alias("_t"), none.alias("_k"), "first"))
    return dealt_sorted(known, [session, "_c"], [F.col("first").desc_nulls_last(), "_t", "_k"]).mapInArrow(emissions(refractory, session, key), f"`{session}` {kind}, `{key}` long, emitted boolean")


def emissions(refractory: int, session: str, key: str):
    """Rows (session, stretch, t, key, first) by session, stretch and time, a stretch's row with `first` ahead of the others: which of them are emitted. Steps are emissions, not rows."""

    def run(batches):
        now, due = None, None  # the stretch, and the earliest next emission
        for batch in batches:
            if not len(batch):
                continue
            who = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy()
            part, t = batch.column(1).fill_null(-(1 << 62)).to_numpy(), batch.column(2).fill_null(-(1 << 62)).to_numpy()
            edges = [0, *(np.flatnonzero((who[1:] != who[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(t)]
            emitted = np.zeros(len(t), bool)
            for a, z in itertools.pairwise(edges):
                place = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
                if place != now:
                    now, due = place, batch.column(4)[a].as_py()
                while due is not None and (i := a + int(np.searchsorted(t[a:z], due))) < z:
                    emitted[i] = True
                    due = int(t[i]) + refractory
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(emitted)], [session, key, "emitted"])
            yield out.filter(batch.column(4).is_null())

    return run


def gate_open(df: DataFrame, session: str, at: str, score: str, threshold: float, period: int) -> DataFrame:
    """ES4: opened_at: the latest poll at or before with a score at the threshold; open until opened_at + period, exclusive."""
    w = Window.partitionBy(session).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("opened_at", F.last(F.when(F.col(score) >= threshold, F.col(at)), ignorenulls=True).over(w))
    return x.withColumn("open", F.coalesce(F.col(at) < F.col("opened_at") + period, F.lit(False)))


def periods(df: DataFrame, session: str, at: str, fire: Column, length: int) -> DataFrame:
    """ES6: one [start, start + length) request for each firing row; a later one within it restarts the period (the earlier is cut, `restarted`)."""
    w = Window.partitionBy(session).orderBy("start")
    x = df.where(fire).select(session, F.col(at).alias("start"))
    nxt = F.lead("start").over(w)
    return x.withColumn("restarted", F.coalesce(nxt < F.col("start") + length, F.lit(False))).withColumn("end", F.least(F.col("start") + length, F.coalesce(nxt, F.col("start") + length)))


def period_votes(obs: DataFrame, spans: DataFrame, session: str, at: str, cls: str, confidence: str) -> DataFrame:
    """ES5: the mode vote of the observations of each whole period; periods that were restarted decide nothing."""
    from .choose import mode_vote
    from .joins import assign_interval

    whole = spans.where(~F.col("restarted")).withColumn("pid", F.col("start"))
    inside = assign_interval(obs, whole, session, at, "start", "end", ["pid"])
    return mode_vote(inside.where(F.col(cls).isNotNull()), [session, "pid"], at, [cls], confidence)


def endpointed(polls: DataFrame, session: str, period: int, stable: int, least_audio: int = 300, least_speech: int = 200, idle: int | None = None) -> DataFrame:
    """ES7: polls: session, t, open_at (the gate's latest opening, null while closed), intent, slots (array of strings), ok (confident), ended and fallback_ended (quiet for the hold and the longer hold), speech and fallback (what the second scorer says, if it accepts). Times in milliseconds.

    The first opening anchors a period; later ones move only its time-out, which comes `period` after the latest. A poll accepts once a confident intent with the same slots, in any order, has been heard `stable` times running and the speech has ended; one that is not confident asks the second scorer, if the longer hold has passed with enough speech. After closing, the old detection has to stop before a new one counts. A time-out is told at the poll that finds it; with `idle`, a session without a poll for so long is over and a period that is open then timed out, at its own time. Rows: session, opened_at, t, intent, slots (sorted, comma-joined), reason.
    """
    cols = ["t", "open_at", "intent", "slots", "ok", "ended", "fallback_ended", "speech", "fallback"]
    kind = polls.schema[session].dataType.simpleString()
    return fold_in_order(polls.select(session, *cols), session, cols, f"`{session}` {kind}, opened_at long, t long, intent string, slots string, reason string", endpoint_fold(period, stable, least_audio, least_speech, idle))


def fan_out(lines: DataFrame, line: str, lead: int = 3) -> DataFrame:
    """ES8: JSON lines to command events and listening changes lead seconds before and at the trigger; malformed lines and window records are dropped."""
    j = F.from_json(line, "event string, t_seconds double, intent string")
    x = lines.withColumn("_j", j).where(F.col("_j.event") == "trigger")
    t = F.col("_j.t_seconds")
    rows = F.array(
        F.struct(F.lit("command").alias("kind"), t.alias("t"), F.col("_j.intent").alias("state")),
        F.struct(F.lit("listening").alias("kind"), F.greatest(t - lead, F.lit(0.0)).alias("t"), F.lit("active").alias("state")),
        F.struct(F.lit("listening").alias("kind"), t.alias("t"), F.lit("passive").alias("state")),
    )
    return x.select("*", F.inline(rows)).drop("_j", line)


def lifecycle(spans: DataFrame, session: str) -> DataFrame:
    """ES9: opened, reopened and closed events of periods."""
    w = Window.partitionBy(session).orderBy("start")
    x = spans.withColumn("_re", F.coalesce(F.lag("restarted").over(w), F.lit(False)))
    ev = F.array(F.struct(F.when(F.col("_re"), "reopened").otherwise("opened").alias("event"), F.col("start").alias("t")), F.struct(F.when(~F.col("restarted"), "closed").alias("event"), F.col("end").alias("t")))
    return x.select(session, F.inline(ev)).where("event IS NOT NULL")


def run_summary(df: DataFrame, session: str, fire: Column, emitted: Column, index: str) -> DataFrame:
    """ES10, ES11: windows, events, suppressed, and strides dropped between window numbers."""
    w = Window.partitionBy(session).orderBy(index)
    x = df.withColumn("_d", F.greatest(F.col(index) - F.lag(index).over(w) - 1, F.lit(0)))
    return x.groupBy(session).agg(F.count(F.lit(1)).alias("windows"), F.count_if(fire & emitted).alias("events"), F.count_if(fire & ~emitted).alias("suppressed"), F.coalesce(F.sum("_d"), F.lit(0)).cast("long").alias("dropped"))


def replay_score(sessions: DataFrame, triggers: DataFrame, session: str, focus: list[str] = ()) -> DataFrame:
    """ES12: sessions: session, label, speech_end; triggers: session, t, intent. Correct first triggers, wrong intents over all triggers, missed, extra, first triggers before the speech end, latency of the correct ones, and correct of all for each focus label."""
    from .choose import first_event

    first = first_event(triggers, session, "t", ["intent"])
    right = triggers.join(sessions.select(session, "label"), session)
    n = right.groupBy(session).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("intent") != F.col("label")).alias("_w"))
    x = sessions.join(first, session, "left").join(n, session, "left")
    good = F.coalesce(F.col("intent") == F.col("label"), F.lit(False))
    late = F.when(good, F.col("t") - F.col("speech_end"))
    q = lambda p: F.round(F.percentile(late, p), 3)
    per = [F.concat_ws("/", F.count_if(good & (F.col("label") == f)), F.count_if(F.col("label") == f)).alias(f"focus_{f}") for f in focus]
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return x.agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(good).alias("correct"), F.round(F.try_divide(F.count_if(good), F.count(F.lit(1))), 4).alias("correct_rate"), whole("_w").alias("wrong"), F.count_if(F.col("t").isNull()).alias("missed"),
        F.count_if(F.col("t") < F.col("speech_end")).alias("early"), whole(F.greatest(F.col("_n") - 1, F.lit(0))).alias("extra"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.round(F.avg(late), 3).alias("mean"), *per,
    )


def soak_score(units: DataFrame, records: DataFrame, unit: str, stride_s: float = 0.25, after_s: float = 1.5) -> DataFrame:
    """ES13: units: unit, label, slot_value, is_oos, gap_s, speech_end, unit_end; records: unit, event, t, intent, slots, text, decode_ms, gate_ms, the triggers among them. One row: first triggers by intent and slot, wrong ones, misses, accepts out of scope, triggers later than `after_s` past a unit's end (over all triggers), correct and all by gap, the objective, latencies in seconds and compute times in milliseconds with the real-time factor."""
    from .choose import first_event

    c = F.col
    per = records.groupBy(unit).agg(F.count(F.lit(1)).alias("_records"))
    trig = records.where("event = 'trigger'")
    first = first_event(trig, unit, "t", ["intent", "slots", "text"])
    known = trig.join(units.select(unit, "label", "is_oos", "unit_end"), unit)
    n = known.groupBy(unit).agg(F.count(F.lit(1)).alias("_n"), F.count_if(~c("is_oos") & ~c("intent").eqNullSafe(c("label"))).alias("_w"), F.count_if(c("t") > c("unit_end") + after_s).alias("_g"))
    x = units.join(per, unit, "left").join(first, unit, "left").join(n, unit, "left")
    cmd, hit = ~c("is_oos"), c("t").isNotNull()
    slot = (F.coalesce(c("slot_value"), F.lit("")) == "") | F.coalesce(F.exists("slots", lambda s: F.lower(s) == F.lower("slot_value")), F.lit(False))
    good = cmd & hit & F.coalesce(c("intent") == c("label"), F.lit(False)) & slot
    late = c("t") - c("speech_end")
    q = lambda v, p: F.round(F.percentile(v, p), 3)
    whole = lambda v: F.coalesce(F.sum(v), F.lit(0))
    bins = {"00_03": c("gap_s") <= 0.3, "04_06": (c("gap_s") > 0.3) & (c("gap_s") <= 0.6), "07_10": c("gap_s") > 0.6}
    score = x.agg(
        F.count_if(cmd).alias("commands"), F.count_if(good).alias("correct"), F.round(F.try_divide(F.count_if(good), F.count_if(cmd)), 4).alias("correct_rate"), F.count_if(cmd & ~hit).alias("missed"), F.count_if(cmd & c("_records").isNull()).alias("no_period"),
        whole("_w").alias("wrong_intents"), F.count_if(cmd & hit & ~good).alias("wrong_actions"), F.count_if(cmd & (c("t") < c("speech_end"))).alias("early"), F.count_if(good & (c("text") == "[classifier]")).alias("by_classifier"),
        F.count_if(~cmd).alias("oos"), F.count_if(~cmd & hit).alias("oos_accepts"), whole(F.greatest(c("_n") - 1, F.lit(0))).alias("extra"), whole("_g").alias("gap_triggers"),
        *[e.alias(f"gap_{b}_{s}") for b, w in bins.items() for s, e in (("correct", F.count_if(good & w)), ("all", F.count_if(cmd & w)))],
        q(F.when(good, late), 0.5).alias("late_p50"), q(F.when(good, late), 0.95).alias("late_p95"), F.round(F.avg(F.when(good, late)), 3).alias("late_mean"), q(F.when(cmd, late), 0.5).alias("late_all_p50"),
    )
    ms = {"decode": c("decode_ms"), "gate": c("gate_ms"), "both": c("decode_ms") + c("gate_ms")}
    two = lambda v: F.round(v, 2)
    times = records.agg(*[e.alias(f"{k}_ms_{s}") for k, v in ms.items() for s, e in (("n", F.count(v)), ("mean", two(F.avg(v))), ("p50", two(F.percentile(v, 0.5))), ("p95", two(F.percentile(v, 0.95))), ("max", two(F.max(v))))], F.round(F.percentile(ms["both"], 0.95) / (1000 * stride_s), 3).alias("rtf_p95"))
    objective = c("correct") - 2 * (c("wrong_actions") + c("oos_accepts") + c("gap_triggers"))
    return score.withColumn("objective", objective).crossJoin(times)


def state_fold(df: DataFrame, device: str, order: str, event: str, start: str, table: dict[tuple[str, str], str], stretch: int = 4096) -> DataFrame:
    """ES14: last state of each device and the number of changes; pairs outside the table change nothing.

    Each stretch of `stretch` order numbers is folded from every state at once into a map of states; a device's maps are then composed in order, so a device is never one list of events.
    """
    states = sorted({start, *[s for s, _ in table], *table.values()})
    no = {s: i for i, s in enumerate(states)}
    moves = F.create_map(*[x for e in sorted({e for _, e in table}) for x in (F.lit(e), F.array(*[F.lit(no[table[s, e]] if (s, e) in table else -1) for s in states]))])
    cell = lambda s, n: F.struct(s.cast("int").alias("s"), n.cast("long").alias("n"))
    same = F.array(*[cell(F.lit(i), F.lit(0)) for i in range(len(states))])

    def event_step(acc: Column, x: Column) -> Column:
        to = lambda a: F.get(x["to"], a["s"])
        return F.transform(acc, lambda a: F.when(to(a) >= 0, cell(to(a), a["n"] + 1)).otherwise(a))

    listed = df.select(device, F.col(order).alias("_o"), F.try_element_at(moves, F.col(event)).alias("_to"))
    part = listed.where(F.col("_to").isNotNull()).groupBy(device, F.floor(F.col("_o") / stretch).alias("_p")).agg(F.array_sort(F.collect_list(F.struct(F.col("_o").alias("o"), F.col("_to").alias("to")))).alias("_e"))
    part = part.select(device, F.struct(F.col("_p").alias("p"), F.aggregate("_e", same, event_step).alias("m")).alias("_m"))
    whole = part.groupBy(device).agg(F.array_sort(F.collect_list("_m")).alias("_ms"))
    last = F.aggregate("_ms", cell(F.lit(no[start]), F.lit(0)), lambda acc, x: cell(F.get(x["m"], acc["s"])["s"], acc["n"] + F.get(x["m"], acc["s"])["n"]))
    ended = whole.select(device, last.alias("_l"))
    names = F.array(*[F.lit(s) for s in states])
    every = df.select(device).distinct().join(ended, device, "left")
    return every.select(device, F.coalesce(F.get(names, F.col("_l.s")), F.lit(start)).alias("state"), F.coalesce(F.col("_l.n"), F.lit(0)).cast("int").alias("changes"))


def log_latest(df: DataFrame, key: str, at: str, item: str, vocabulary: list[str], n: int) -> DataFrame:
    """ES15: the newest n known items of each key, newest first by place."""
    known = df.where(F.col(item).isin(vocabulary))
    return known.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), item))).where(F.col("place") <= n).select(key, "place", at, item)


def trial_events(events: DataFrame, trials: DataFrame, key: str, at: str, lead: int) -> DataFrame:
    """ES16: events: key, id, t; trials: key, trial, start, end. The first event of each trial with start - lead <= t < end, and its latency from the start; strays have no trial."""
    from .joins import assign_interval

    early = trials.withColumn("_from", F.col("start") - lead)
    inside = assign_interval(events, early, key, at, "_from", "end", ["trial", "start"])
    first = inside.groupBy(key, "trial").agg(F.min(F.struct(F.col(at).alias("t"), "id", "start")).alias("_f"))
    stray = events.join(inside.select("id"), "id", "left_anti").select(key, "id", F.lit(None).cast("long").alias("trial"), F.lit(None).cast("long").alias("latency"))
    return first.select(key, F.col("_f.id").alias("id"), "trial", (F.col("_f.t") - F.col("_f.start")).alias("latency")).unionByName(stray)
