"""Queries of the stream policies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import events as E
from ..streaming import policies as P
from ..streaming.folder import shared_dir
from ..streaming.inorder import rocksdb_state
from .common import SCORES, Book, table

BOOK = Book()
add = BOOK.add
S = f"WITH {SCORES}"
MS = "(epoch_us(ts) // 1000)"


def timed(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("t"))


_ES1 = "WITH e AS (SELECT user_id, value, epoch_us(ts) AS u FROM events), x AS (SELECT user_id, value, unnest(range((u // 21600000000) * 21600000000 - 64800000000, (u // 21600000000) * 21600000000 + 1, 21600000000)) AS s, u FROM e), m AS (SELECT max(u) AS m FROM e) SELECT user_id, make_timestamp(s) AS start, make_timestamp(s + 86400000000) AS \"end\", count(*) AS n, max(value) AS top FROM x, m WHERE u >= s AND u < s + 86400000000 AND s + 86400000000 <= m GROUP BY 1, 2, 3"


@add("es1_sliding_windows", _ES1)
@add("es1_sliding_windows_whole", _ES1)
def es1(spark, d):
    return _es1(table(spark, d, "events"))


def _es1(events):
    out = E.sliding(events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "1 day", "6 hours")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@add("es2_threshold_policy", "SELECT event_id FROM events WHERE value >= 80")
def es2(spark, d):
    return E.threshold_policy(timed(spark, d), F.col("value") >= 80).select("event_id")


_FOLD = f"""f AS (SELECT user_id, event_id, {MS} AS t, row_number() OVER (PARTITION BY user_id ORDER BY {MS}, event_id) AS i FROM events WHERE value > 40),
r AS (SELECT user_id, event_id, t, i, TRUE AS emitted, t AS last FROM f WHERE i = 1 UNION ALL SELECT f.user_id, f.event_id, f.t, f.i, f.t - last >= 86400000, CASE WHEN f.t - last >= 86400000 THEN f.t ELSE last END FROM r JOIN f ON f.user_id = r.user_id AND f.i = r.i + 1)"""


@add("es3_debounce", f"WITH RECURSIVE {_FOLD} SELECT user_id, event_id, emitted FROM r")
def es3(spark, d):
    return E.debounce(timed(spark, d), "user_id", "t", F.col("value") > 40, 86_400_000, "event_id")


_GATE = f"g AS (SELECT event_id, user_id, {MS} AS t, last_value(CASE WHEN value >= 120 THEN {MS} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY {MS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM events)"


@add("es4_gate", f"WITH {_GATE} SELECT event_id, coalesce(t < o + 200000000, FALSE) AS open FROM g")
def es4(spark, d):
    return E.gate_open(timed(spark, d), "user_id", "t", "value", 120, 200_000_000).select("event_id", "open")


_PER = f"p AS (SELECT user_id, {MS} AS start, lead({MS}) OVER (PARTITION BY user_id ORDER BY {MS}) AS nx FROM events WHERE value >= 120), pp AS (SELECT user_id, start, coalesce(nx < start + 200000000, FALSE) AS restarted, least(start + 200000000, coalesce(nx, start + 200000000)) AS fin FROM p)"


def spans(spark, d):
    return E.periods(timed(spark, d), "user_id", "t", F.col("value") >= 120, 200_000_000)


@add(
    "es5_mode_period",
    f"WITH {_PER}, x AS (SELECT e.user_id, start AS pid, event_type, {MS} AS t, value FROM events e JOIN pp ON pp.user_id = e.user_id AND NOT restarted AND {MS} >= start AND {MS} < fin), g AS (SELECT user_id, pid, event_type, count(*) AS votes, round(sum(value), 9) AS s, min(t) AS f, max(t) AS latest, avg(value) AS mean FROM x GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, pid ORDER BY votes DESC, s DESC, f) AS r FROM g) SELECT user_id, pid, event_type, votes, latest, round(mean, 6) AS mean FROM r WHERE r = 1",
)
def es5(spark, d):
    return E.period_votes(timed(spark, d).drop("ts"), spans(spark, d), "user_id", "t", "event_type", "value").withColumn("mean", F.round("mean", 6))


@add("es6_single_period", f'WITH {_PER} SELECT user_id, start, restarted, fin AS "end" FROM pp')
def es6(spark, d):
    return spans(spark, d)


_WAIT, _AUDIO = 1_000_000_000, 1000
_SLOTS = "CASE k % 3 WHEN 0 THEN array('dim', 'on') WHEN 1 THEN array('on', 'dim') ELSE array('off') END"


def _polls_sql(where: str = "", idle: int | None = None) -> str:
    """Polls numbered within stretches of a session without a pause of `idle`."""
    pause = f"CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= {idle} THEN 1 ELSE 0 END" if idle else "0"
    return f"""p AS (SELECT e.user_id, g.t, CASE WHEN g.t < o + 200000000 THEN o END AS open_at, event_type AS intent, CASE WHEN json_extract_string(props, '$.k')::INT % 3 = 2 THEN 'off' ELSE 'dim,on' END AS sl, value > 10 AS ok, value < 60 AS ended, value < 30 AS fbe, json_extract_string(props, '$.k')::INT * 10 AS speech, CASE WHEN json_extract_string(props, '$.k')::INT % 4 = 0 THEN event_type END AS fb FROM g JOIN events e USING (event_id) {where}),
q AS (SELECT *, sum(pause) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS seg FROM (SELECT *, {pause} AS pause FROM p)),
n AS (SELECT *, concat(intent, '|', sl) AS said_now, row_number() OVER (PARTITION BY user_id, seg ORDER BY t, open_at NULLS FIRST, intent, sl, ok, ended, fbe, speech, fb NULLS FIRST) AS i FROM q)"""


_ENDED = f"""r AS (SELECT user_id, seg, 0::BIGINT AS i, NULL::BIGINT AS anchor, 0::BIGINT AS since, -1::BIGINT AS closed, TRUE AS armed, NULL::BIGINT AS lopen, NULL::VARCHAR AS key, 0 AS streak, NULL::BIGINT AS e_open, NULL::BIGINT AS e_t, NULL::VARCHAR AS e_intent, NULL::VARCHAR AS e_slots, NULL::VARCHAR AS reason, NULL::BIGINT AS seen_at FROM (SELECT DISTINCT user_id, seg FROM n)
UNION ALL SELECT user_id, seg, i, CASE WHEN said IS NULL THEN anchor2 END, since2, CASE WHEN said IS NULL THEN closed2 ELSE t END, CASE WHEN said IS NULL THEN armed2 ELSE FALSE END, open_at, CASE WHEN said IS NULL THEN key3 END, CASE WHEN said IS NULL THEN streak3 ELSE 0 END, CASE WHEN said IS NOT NULL THEN anchor2 END, CASE WHEN said IS NOT NULL THEN t END, CASE said WHEN 'accepted' THEN intent WHEN 'fallback' THEN fb END, CASE said WHEN 'accepted' THEN sl END, said, t
FROM (SELECT *, CASE WHEN anchor2 IS NULL THEN NULL WHEN t >= since2 + {_WAIT} THEN 'timeout' WHEN obs AND ok AND streak3 >= 2 AND ended THEN 'accepted' WHEN obs AND NOT ok AND fb IS NOT NULL AND fbe AND speech >= 200 THEN 'fallback' END AS said
FROM (SELECT *, CASE WHEN NOT obs THEN key WHEN ok THEN said_now END AS key3, CASE WHEN NOT obs THEN streak WHEN NOT ok THEN 0 WHEN key = said_now THEN streak + 1 ELSE 1 END AS streak3
FROM (SELECT *, coalesce(anchor2 IS NOT NULL AND t < since2 + {_WAIT} AND t - anchor2 >= {_AUDIO}, FALSE) AS obs
FROM (SELECT *, CASE WHEN anchor IS NOT NULL THEN anchor WHEN hold OR open_at IS NULL OR open_at <= closed THEN NULL ELSE open_at END AS anchor2, CASE WHEN anchor IS NOT NULL THEN CASE WHEN rearmed THEN open_at ELSE since END WHEN hold OR open_at IS NULL OR open_at <= closed THEN since ELSE open_at END AS since2, CASE WHEN hold THEN greatest(closed, open_at) ELSE closed END AS closed2, NOT hold AS armed2
FROM (SELECT *, anchor IS NULL AND NOT armed AND rearmed AS hold FROM (SELECT r.anchor, r.since, r.closed, r.armed, r.lopen, r.key, r.streak, n.*, coalesce(n.open_at IS NOT NULL AND n.open_at IS DISTINCT FROM r.lopen, FALSE) AS rearmed FROM r JOIN n ON n.user_id = r.user_id AND n.seg = r.seg AND n.i = r.i + 1)))))))"""
_TOLD = "SELECT user_id, e_open AS opened_at, e_t AS t, e_intent AS intent, e_slots AS slots, reason FROM r WHERE reason IS NOT NULL"


def polls(e):
    """Polls of ES7 from rows with user_id, t, open_at, event_type, value and props."""
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.col("value")
    return e.select("*", F.col("event_type").alias("intent"), F.expr(_SLOTS.replace("k %", "CAST(get_json_object(props, '$.k') AS INT) %")).alias("slots"), (v > 10).alias("ok"), (v < 60).alias("ended"), (v < 30).alias("fallback_ended"), (k * 10).alias("speech"), F.when(k % 4 == 0, F.col("event_type")).alias("fallback"))


@add("es7_endpointed_period", f"WITH RECURSIVE {_GATE}, {_polls_sql()}, {_ENDED} {_TOLD}")
def es7(spark, d):
    g = E.gate_open(timed(spark, d), "user_id", "t", "value", 120, 200_000_000)
    x = g.join(table(spark, d, "events").select("event_id", "props"), "event_id").withColumn("open_at", F.when(F.col("open"), F.col("opened_at")))
    return E.endpointed(polls(x), "user_id", _WAIT, 2, _AUDIO)


_LINE = "CASE WHEN event_id % 10 = 0 THEN '{broken' WHEN event_id % 3 = 0 THEN concat('{\"event\": \"window\", \"t_seconds\": ', event_id % 50, '}') ELSE concat('{\"event\": \"trigger\", \"t_seconds\": ', event_id % 50, ', \"intent\": \"', event_type, '\"}') END"


@add("es8_fan_out", "WITH x AS (SELECT event_id, (event_id % 50)::DOUBLE AS t, event_type FROM events WHERE event_id % 10 <> 0 AND event_id % 3 <> 0) SELECT event_id, 'command' AS kind, t, event_type AS state FROM x UNION ALL SELECT event_id, 'listening', greatest(t - 3, 0), 'active' FROM x UNION ALL SELECT event_id, 'listening', t, 'passive' FROM x")
def es8(spark, d):
    return E.fan_out(table(spark, d, "events").selectExpr("event_id", f"{_LINE} AS line"), "line")


@add("es9_lifecycle", f"WITH {_PER}, x AS (SELECT *, coalesce(lag(restarted) OVER (PARTITION BY user_id ORDER BY start), FALSE) AS re FROM pp) SELECT user_id, CASE WHEN re THEN 'reopened' ELSE 'opened' END AS event, start AS t FROM x UNION ALL SELECT user_id, 'closed', fin FROM x WHERE NOT restarted")
def es9(spark, d):
    return E.lifecycle(spans(spark, d), "user_id")


@add("es10_run_summary", f"WITH RECURSIVE {_FOLD}, x AS (SELECT e.user_id, e.event_id, value > 40 AS fire, coalesce(r.emitted, FALSE) AS em, event_id - lag(e.event_id) OVER (PARTITION BY e.user_id ORDER BY e.event_id) - 1 AS d FROM events e LEFT JOIN (SELECT event_id AS rid, emitted FROM r) r ON rid = e.event_id) SELECT user_id, count(*) AS windows, count(*) FILTER (fire AND em) AS events, count(*) FILTER (fire AND NOT em) AS suppressed, coalesce(sum(greatest(d, 0)), 0)::BIGINT AS dropped FROM x GROUP BY 1")
def es10(spark, d):
    e = timed(spark, d)
    x = e.join(E.debounce(e, "user_id", "t", F.col("value") > 40, 86_400_000, "event_id").select("event_id", "emitted"), "event_id", "left").na.fill(False, ["emitted"])
    return E.run_summary(x, "user_id", F.col("value") > 40, F.col("emitted"), "event_id")


@add("es11_drop_accounting", "SELECT user_id, coalesce(sum(g), 0)::BIGINT AS dropped, count(*) FILTER (g > 0) AS gaps FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS g FROM events) GROUP BY 1")
def es11(spark, d):
    from pyspark.sql import Window

    g = F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, d, "events").withColumn("g", g).groupBy("user_id").agg(F.coalesce(F.sum("g"), F.lit(0)).alias("dropped"), F.count_if(F.col("g") > 0).alias("gaps"))


_SES = "s AS (SELECT conv_id AS sid, CASE conv_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'error' END AS label, (conv_id % 7 + 3)::DOUBLE AS speech_end FROM (SELECT DISTINCT conv_id FROM conversations)), rc AS (SELECT event_id % 200 AS sid, CASE WHEN value > 90 THEN 'trigger' ELSE 'window' END AS event, (event_id // 200)::DOUBLE AS t, event_type AS intent, CASE WHEN event_id % 4 = 1 THEN ['on'] ELSE ['off', 'dim'] END AS slots, CASE WHEN event_id % 6 = 0 THEN '[classifier]' ELSE 'x' END AS text, value AS decode_ms, CASE WHEN event_id % 3 > 0 THEN (event_id % 7)::DOUBLE / 2 END AS gate_ms FROM events), tr AS (SELECT * FROM rc WHERE event = 'trigger')"


def sessions(spark, d):
    s = table(spark, d, "conversations").select("conv_id").distinct().selectExpr("conv_id AS sid", "CASE conv_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'error' END AS label", "CAST(conv_id % 7 + 3 AS DOUBLE) AS speech_end")
    r = table(spark, d, "events").selectExpr(
        "event_id % 200 AS sid", "CASE WHEN value > 90 THEN 'trigger' ELSE 'window' END AS event", "CAST(event_id div 200 AS DOUBLE) AS t", "event_type AS intent", "CASE WHEN event_id % 4 = 1 THEN array('on') ELSE array('off', 'dim') END AS slots",
        "CASE WHEN event_id % 6 = 0 THEN '[classifier]' ELSE 'x' END AS text", "value AS decode_ms", "CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 7 AS DOUBLE) / 2 END AS gate_ms",
    )
    return s, r


_FOCUS = ["click", "view"]


@add(
    "es12_replay_score",
    f"""WITH {_SES}, f AS (SELECT sid, min(t) AS t, min_by(intent, t) AS intent FROM tr GROUP BY 1), c AS (SELECT sid, count(*) AS n, count(*) FILTER (intent <> label) AS w FROM tr JOIN s USING (sid) GROUP BY 1), x AS (SELECT s.*, t, intent, n, w, coalesce(intent = label, FALSE) AS good FROM s LEFT JOIN f USING (sid) LEFT JOIN c USING (sid))
SELECT count(*) AS sessions, count(*) FILTER (good) AS correct, round(count(*) FILTER (good) / nullif(count(*), 0)::DOUBLE, 4) AS correct_rate, coalesce(sum(w), 0)::BIGINT AS wrong, count(*) FILTER (t IS NULL) AS missed, count(*) FILTER (t < speech_end) AS early, coalesce(sum(greatest(n - 1, 0)), 0)::BIGINT AS extra, round(quantile_cont(t - speech_end, 0.5) FILTER (good), 3) AS p50, round(quantile_cont(t - speech_end, 0.95) FILTER (good), 3) AS p95, round(avg(t - speech_end) FILTER (good), 3) AS mean, {', '.join(f"concat(count(*) FILTER (good AND label = '{x}'), '/', count(*) FILTER (label = '{x}')) AS focus_{x}" for x in _FOCUS)} FROM x""",
)
def es12(spark, d):
    s, r = sessions(spark, d)
    return E.replay_score(s, r.where("event = 'trigger'"), "sid", _FOCUS)


_BINS = {"00_03": "gap_s <= 0.3", "04_06": "gap_s > 0.3 AND gap_s <= 0.6", "07_10": "gap_s > 0.6"}
_MS = {"decode": "decode_ms", "gate": "gate_ms", "both": "decode_ms + gate_ms"}
_UNIT = "CASE WHEN sid % 2 = 1 THEN 'On' END AS slot_value, sid % 5 = 0 AS is_oos, CAST(sid % 11 AS DOUBLE) / 10 AS gap_s, CASE WHEN sid % 9 > 0 THEN speech_end + 1 END AS unit_end"


@add(
    "es13_soak_score",
    f"""WITH {_SES}, u AS (SELECT *, {_UNIT} FROM s), f AS (SELECT sid, min(t) AS t, min_by(intent, t) AS intent, min_by(slots, t) AS slots, min_by(text, t) AS text FROM tr GROUP BY 1), c AS (SELECT sid, count(*) AS n, count(*) FILTER (NOT is_oos AND intent IS DISTINCT FROM label) AS w, count(*) FILTER (t > unit_end + 1.5) AS g FROM tr JOIN u USING (sid) GROUP BY 1), k AS (SELECT sid, count(*) AS records FROM rc GROUP BY 1),
x AS (SELECT u.*, t, text, n, w, g, records, NOT is_oos AND t IS NOT NULL AND coalesce(intent = label, FALSE) AND (coalesce(slot_value, '') = '' OR list_contains(slots, lower(slot_value))) AS good FROM u LEFT JOIN f USING (sid) LEFT JOIN c USING (sid) LEFT JOIN k USING (sid)),
y AS (SELECT count(*) FILTER (NOT is_oos) AS commands, count(*) FILTER (good) AS correct, round(count(*) FILTER (good) / nullif(count(*) FILTER (NOT is_oos), 0)::DOUBLE, 4) AS correct_rate, count(*) FILTER (NOT is_oos AND t IS NULL) AS missed, count(*) FILTER (NOT is_oos AND records IS NULL) AS no_period, coalesce(sum(w), 0)::BIGINT AS wrong_intents, count(*) FILTER (NOT is_oos AND t IS NOT NULL AND NOT good) AS wrong_actions, count(*) FILTER (NOT is_oos AND t < speech_end) AS early, count(*) FILTER (good AND text = '[classifier]') AS by_classifier, count(*) FILTER (is_oos) AS oos, count(*) FILTER (is_oos AND t IS NOT NULL) AS oos_accepts, coalesce(sum(greatest(n - 1, 0)), 0)::BIGINT AS extra, coalesce(sum(g), 0)::BIGINT AS gap_triggers,
{', '.join(f'count(*) FILTER (good AND {w}) AS gap_{b}_correct, count(*) FILTER (NOT is_oos AND {w}) AS gap_{b}_all' for b, w in _BINS.items())}, round(quantile_cont(t - speech_end, 0.5) FILTER (good), 3) AS late_p50, round(quantile_cont(t - speech_end, 0.95) FILTER (good), 3) AS late_p95, round(avg(t - speech_end) FILTER (good), 3) AS late_mean, round(quantile_cont(t - speech_end, 0.5) FILTER (NOT is_oos), 3) AS late_all_p50 FROM x),
z AS (SELECT {', '.join(f'count({v}) AS {k}_ms_n, round(avg({v}), 2) AS {k}_ms_mean, round(quantile_cont({v}, 0.5), 2) AS {k}_ms_p50, round(quantile_cont({v}, 0.95), 2) AS {k}_ms_p95, round(max({v}), 2) AS {k}_ms_max' for k, v in _MS.items())}, round(quantile_cont(decode_ms + gate_ms, 0.95) / 250, 3) AS rtf_p95 FROM rc) SELECT y.*, correct - 2 * (wrong_actions + oos_accepts + gap_triggers) AS objective, z.* FROM y, z""",
)
def es13(spark, d):
    s, r = sessions(spark, d)
    return E.soak_score(s.selectExpr("*", *_UNIT.split(", ")), r, "sid")


TABLE = {("idle", "click"): "armed", ("armed", "purchase"): "on", ("on", "error"): "idle", ("armed", "error"): "idle"}
_MOVE = "CASE " + " ".join(f"WHEN state = '{s}' AND e = '{e}' THEN '{t}'" for (s, e), t in TABLE.items()) + " END"


@add("es14_state_fold", f"WITH RECURSIVE x AS (SELECT user_id, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), f AS (SELECT user_id, 0::BIGINT AS i, 'idle' AS state, 0 AS changes FROM (SELECT DISTINCT user_id FROM x) UNION ALL SELECT f.user_id, x.i, coalesce({_MOVE}, state), changes + CASE WHEN {_MOVE} IS NULL THEN 0 ELSE 1 END FROM f JOIN x ON x.user_id = f.user_id AND x.i = f.i + 1), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS r FROM f) SELECT user_id, state, changes FROM l WHERE r = 1")
def es14(spark, d):
    return E.state_fold(table(spark, d, "events"), "user_id", "event_id", "event_type", "idle", TABLE)


@add("es15_latest_log", "SELECT user_id, r::INT AS place, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type IN ('click', 'purchase')) WHERE r <= 3")
def es15(spark, d):
    return E.log_latest(table(spark, d, "events"), "user_id", "event_id", "event_type", ["click", "purchase"], 3)


@add(
    "es16_trial_assignment",
    f"WITH tl AS (SELECT user_id, event_id AS trial, {MS} AS start, {MS} + 50000000 AS fin FROM events WHERE event_type = 'signup'), x AS (SELECT e.user_id, e.event_id AS id, {MS} AS t, trial, start, fin, row_number() OVER (PARTITION BY e.event_id ORDER BY start DESC) AS n FROM events e JOIN tl ON tl.user_id = e.user_id AND start - 2000000 <= {MS} WHERE e.event_type = 'click'), y AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY t) AS r FROM x WHERE n = 1 AND t < fin) SELECT user_id, id, trial, t - start AS latency FROM y WHERE r = 1 UNION ALL SELECT user_id, event_id, NULL, NULL FROM events WHERE event_type = 'click' AND event_id NOT IN (SELECT id FROM y)",
)
def es16(spark, d):
    e = timed(spark, d)
    trials = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("trial"), F.col("t").alias("start"), (F.col("t") + 50_000_000).alias("end"))
    return E.trial_events(e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("id"), "t"), trials, "user_id", "t", 2_000_000)


def run_stream(spark, d, build, complete=False):
    """Runs a stream over the event files to its end, into Parquet in the shared folder; the rows written."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path if _is_dir(spark, path) else f"{d}/event[s].parquet")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("t", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000))
    out = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    rows = build(stream)
    writer = rows.writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    if complete:
        writer = writer.outputMode("complete").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(out))
    else:
        writer = writer.outputMode("append").format("parquet").option("path", out)
    with rocksdb_state(spark):
        running = writer.start()
    running.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def _is_dir(spark, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


#: The stream's last watermark: rows before it have been told.
_WM = f"wm AS (SELECT max({MS}) - 86400000 AS wm FROM events)"


@add("es3_debounce_stream", f"WITH RECURSIVE {_WM.replace('FROM events', 'FROM events WHERE value > 40')}, f AS (SELECT user_id, {MS} AS t, row_number() OVER (PARTITION BY user_id ORDER BY {MS}) AS i FROM events WHERE value > 40), r AS (SELECT user_id, t, i, TRUE AS emitted, t AS last FROM f WHERE i = 1 UNION ALL SELECT f.user_id, f.t, f.i, f.t - last >= 86400000, CASE WHEN f.t - last >= 86400000 THEN f.t ELSE last END FROM r JOIN f ON f.user_id = r.user_id AND f.i = r.i + 1) SELECT user_id, t, emitted FROM r, wm WHERE t < wm")
def es3_stream(spark, d):
    return run_stream(spark, d, lambda s: P.debounced(s.where("value > 40"), "user_id", "t", 86_400_000))


@add("es4_gate_stream", f"WITH {_GATE}, {_WM} SELECT user_id, t, o AS opened_at FROM g, wm WHERE t < o + 200000000 AND t < wm")
def es4_stream(spark, d):
    return run_stream(spark, d, lambda s: P.gated(s, "user_id", "t", "value", 120, 200_000_000))


@add("es1_sliding_stream", _ES1.replace("s + 86400000000 <= m GROUP", "s + 86400000000 <= m // 1000 * 1000 - 86400000000 GROUP"))
def es1_stream(spark, d):
    out = run_stream(spark, d, lambda s: P.sliding_counts(s, "user_id", "ts", "1 day", "6 hours", "1 day"))
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@add("es2_threshold_stream", "SELECT event_id FROM events WHERE value >= 80")
def es2_stream(spark, d):
    return run_stream(spark, d, lambda s: P.accepted_only(s, F.col("value") >= 80).select("event_id"))


@add(
    "es5_mode_period_stream",
    f"WITH {_PER}, {_WM}, x AS (SELECT e.user_id, start AS pid, event_type, {MS} AS t, value FROM events e JOIN pp ON pp.user_id = e.user_id AND NOT restarted AND {MS} >= start AND {MS} < start + 200000000 JOIN wm ON start + 200000000 <= wm), g AS (SELECT user_id, pid, event_type, count(*) AS votes, round(sum(value), 9) AS s, min(t) AS f, max(t) AS latest, avg(value) AS mean FROM x GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, pid ORDER BY votes DESC, s DESC, f) AS r FROM g) SELECT user_id, pid, event_type, votes, latest, round(mean, 6) AS mean FROM r WHERE r = 1",
)
def es5_stream(spark, d):
    fires = lambda s: s.withColumn("fires", F.col("value") >= 120)
    return run_stream(spark, d, lambda s: P.mode_periods(fires(s), "user_id", "t", "fires", "event_type", "value", 200_000_000)).withColumn("mean", F.round("mean", 6))


@add("es6_single_period_stream", f'WITH {_PER}, {_WM} SELECT user_id, start, restarted, fin AS "end" FROM pp, wm WHERE fin < wm OR NOT restarted AND fin = wm')
def es6_stream(spark, d):
    return run_stream(spark, d, lambda s: P.single_periods(s.withColumn("fires", F.col("value") >= 120), "user_id", "t", "fires", 200_000_000))


_IDLE, _AWAY = _WAIT, 3 * 86_400_000


@add("es7_endpointed_stream", f"WITH RECURSIVE {_GATE}, {_WM}, {_polls_sql('JOIN wm ON g.t < wm', _IDLE)}, {_ENDED} {_TOLD} UNION ALL SELECT user_id, anchor, since + {_WAIT}, NULL, NULL, 'timeout' FROM (SELECT *, row_number() OVER (PARTITION BY user_id, seg ORDER BY i DESC) AS last FROM r) JOIN wm ON last = 1 AND anchor IS NOT NULL AND seen_at + {_IDLE} <= wm")
def es7_stream(spark, d):
    return run_stream(spark, d, lambda s: P.endpointed(polls(s), "user_id", "value", 120, 200_000_000, _WAIT, 2, _IDLE, _AUDIO))


_DEVICE = f"q AS (SELECT user_id, event_type AS e, event_id, {MS} AS t, {MS} - lag({MS}) OVER (PARTITION BY user_id ORDER BY {MS}, event_id) AS away FROM events), x AS (SELECT user_id, e, event_id, coalesce(away >= {_AWAY}, FALSE) AS anew, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM q, wm WHERE t < wm)"
_HELD = "(CASE WHEN x.anew THEN 'idle' ELSE state END)"
_FROM = _MOVE.replace("state =", f"{_HELD} =")


@add("es14_state_stream", f"WITH RECURSIVE {_WM}, {_DEVICE}, f AS (SELECT user_id, 0::BIGINT AS i, 'idle' AS state, FALSE AS changed, NULL::BIGINT AS event_id FROM (SELECT DISTINCT user_id FROM x) UNION ALL SELECT f.user_id, x.i, coalesce({_FROM}, {_HELD}), ({_FROM}) IS NOT NULL, x.event_id FROM f JOIN x ON x.user_id = f.user_id AND x.i = f.i + 1) SELECT user_id, event_id, state, changed FROM f WHERE i > 0")
def es14_stream(spark, d):
    return run_stream(spark, d, lambda s: P.machine(s, "user_id", "t", "event_id", "event_type", "idle", TABLE, _AWAY))


@add("es15_latest_stream", "SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def es15_stream(spark, d):
    return run_stream(spark, d, lambda s: P.latest(s, "user_id", "event_id", "event_type"), True)
