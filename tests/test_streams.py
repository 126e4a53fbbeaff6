"""Streaming forms over files that overlap in time, with a key larger than an Arrow chunk: the batch result up to the watermark."""

from __future__ import annotations

import itertools
import random
import tempfile
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from utterlake.operators import events
from utterlake.operators.folds import Fold
from utterlake.streaming import policies
from utterlake.streaming.inorder import PROVIDER, InOrder, rocksdb_state

KIND = "s string, t long, v double, cls string, fires boolean, slots array<string>, fallback string, ts timestamp"
LATE = "400 seconds"
N = 40_000


@pytest.fixture(scope="module")
def files(spark):
    """Four files whose times overlap by half, none later than the watermark, read one a micro-batch; one key has 40,000 rows. The last one ends every session but one early."""
    rng, where, rows = random.Random(4), tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp"), []
    times = [t * 20 + rng.randint(1, 20) for t in range(N)]  # 800 s, no two rows of a key at one time
    mine = [("big", t, rng.random(), rng.choice("abc"), rng.random() < 0.01, rng.choice([["x", "y"], ["y", "x"], ["z"], None]), rng.choice([None, "q"])) for t in times]
    mine += [(f"k{i % 5}", t, rng.random(), rng.choice("abc"), rng.random() < 0.2, ["x"], None) for i, t in enumerate(rng.sample(range(1, 300_000), 400))]
    files = {i: [] for i in range(4)}
    for r in mine:  # a row lies in the file of its time or in the next one
        files[min(3, int(r[1] // 200_000) + rng.randint(0, 1))].append(r)
    for rows_ in files.values():
        rng.shuffle(rows_)
        spark.createDataFrame(rows_, KIND[: KIND.rindex(",")]).withColumn("ts", F.timestamp_millis("t")).coalesce(1).write.mode("append").parquet(f"{where}/in")
        rows += rows_
    frame = spark.createDataFrame(rows, KIND[: KIND.rindex(",")])
    return SimpleNamespace(path=f"{where}/in", rows=rows, frame=frame, watermark=max(r[1] for r in rows) - 400_000)


def run(spark, path, build):
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)
    out = tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp")
    rows = build(stream)
    with rocksdb_state(spark):
        query = rows.writeStream.option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").format("parquet").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    return spark.read.schema(rows.schema).parquet(f"{out}/rows").collect(), state


def by_key(files):
    keys = {}
    for r in sorted(files.rows, key=lambda r: r[1]):
        keys.setdefault(r[0], []).append(r)
    return keys


def test_debounced(spark, files):
    got, state = run(spark, files.path, lambda s: policies.debounced(s, "s", "t", 700, late=LATE))
    want = {}
    for key, rows in by_key(files).items():
        last = None
        for r in rows:
            go = last is None or r[1] - last >= 700
            last = r[1] if go else last
            if r[1] < files.watermark:
                want[key, r[1]] = go
    assert {(r.s, r.t): r.emitted for r in got} == want and len(got) == len(want) and len(want) > 15_000
    assert sum(x["numRowsDroppedByWatermark"] for x in state) == 0


def test_gated(spark, files):
    got, _ = run(spark, files.path, lambda s: policies.gated(s, "s", "t", "v", 0.995, 3000, late=LATE))
    want = {(r.s, r.t): r.opened_at for r in events.gate_open(files.frame, "s", "t", "v", 0.995, 3000).where(F.col("open") & (F.col("t") < files.watermark)).collect()}
    assert {(r.s, r.t): r.opened_at for r in got} == want and len(got) == len(want) > 100


def test_periods_and_votes(spark, files):
    spans = events.periods(files.frame, "s", "t", F.col("fires"), 5000)
    ends = {(r.s, r.start): (r.restarted, r.end) for r in spans.where(F.expr(f"end < {files.watermark} OR NOT restarted AND end = {files.watermark}")).collect()}
    got, _ = run(spark, files.path, lambda s: policies.single_periods(s, "s", "t", "fires", 5000, late=LATE))
    assert {(r.s, r.start): (r.restarted, r.end) for r in got} == ends and len(got) == len(ends) > 100
    votes = {(r.s, r.pid): (r.cls, r.votes, r.latest) for r in events.period_votes(files.frame, spans, "s", "t", "cls", "v").where(F.col("pid") + 5000 <= files.watermark).collect()}
    seen, _ = run(spark, files.path, lambda s: policies.mode_periods(s, "s", "t", "fires", "cls", "v", 5000, late=LATE))
    assert {(r.s, r.pid): (r.cls, r.votes, r.latest) for r in seen} == votes and len(seen) == len(votes) > 20


def test_machine(spark, files):
    table = {("idle", "a"): "on", ("on", "b"): "off", ("off", "c"): "idle"}
    got, _ = run(spark, files.path, lambda s: policies.machine(s, "s", "t", "t", "cls", "idle", table, 5000, late=LATE))
    want = {}
    for key, rows in by_key(files).items():
        state, last = "idle", None
        for r in rows:
            state = "idle" if last is not None and r[1] - last >= 5000 else state
            to, last = table.get((state, r[3])), r[1]
            state = to or state
            if r[1] < files.watermark:
                want[key, r[1]] = (state, to is not None)
    assert {(r.s, r.t): (r.state, r.changed) for r in got} == want and len(got) == len(want)


def looks(df):
    v = F.col("v")
    return df.select("*", F.col("cls").alias("intent"), (v > 0.3).alias("ok"), (v < 0.6).alias("ended"), (v < 0.2).alias("fallback_ended"), (v * 2000).cast("long").alias("speech"))


def test_endpointed(spark, files):
    score = F.when(F.col("fires"), 1.0).otherwise(0.0)
    stream = lambda s: policies.endpointed(looks(s).withColumn("score", score), "s", "score", 1.0, 900, 2000, 4, 6000, late=LATE)
    got, state = run(spark, files.path, stream)
    gate = events.gate_open(files.frame.withColumn("score", score), "s", "t", "score", 1.0, 900)
    batch = events.endpointed(looks(gate).withColumn("open_at", F.when(F.col("open"), F.col("opened_at"))), "s", 2000, 4, idle=6000).collect()
    last = {k: rows[-1][1] for k, rows in by_key(files).items()}
    assert {r.reason for r in batch} == {"accepted", "fallback", "timeout"}
    row = lambda r: (r.s, r.opened_at, r.t, r.intent, r.slots, r.reason)
    want = {row(r) for r in batch if r.t < files.watermark and (r.t <= last[r.s] or last[r.s] + 6000 <= files.watermark)}
    assert {row(r) for r in got} == want and len(got) == len(want) > 100


def test_sessions_end_by_timer_and_leave_nothing(spark):
    """No further row comes for k; the watermark alone closes its period, and the other key's rows are all told."""
    where = tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp")
    one = [("k", 1000, 1.0), ("k", 1400, 0.0)]  # watermarks begin at 0: a row at 0 would be late
    two = [("z", 100_000 + i, 0.0) for i in range(3)]
    three = [("k", 1500, 1.0), ("z", 200_000, 0.0)]  # k's row is too late
    for rows in (one, two, [("z", 150_000, 0.0)], three):
        df = spark.createDataFrame(rows, "s string, t long, v double").selectExpr("*", "'a' AS cls", "v > 0.5 AS fires", "array('x') AS slots", "CAST(NULL AS STRING) AS fallback", "timestamp_millis(t) AS ts")
        df.coalesce(1).write.mode("append").parquet(where)
    quiet = lambda s: looks(s).withColumn("ended", F.lit(False))
    got, state = run(spark, where, lambda s: policies.endpointed(quiet(s), "s", "v", 1.0, 1000, 2000, 2, 3000, late="1 second"))
    assert [(r.s, r.opened_at, r.t, r.reason) for r in got] == [("k", 1000, 3000, "timeout")]
    assert sum(x["numRowsDroppedByWatermark"] for x in state) == 1
    periods, state = run(spark, where, lambda s: policies.single_periods(s, "s", "t", "fires", 2000, late="1 second"))
    assert [(r.s, r.start, r.restarted, r.end) for r in periods] == [("k", 1000, False, 3000)]
    moves, state = run(spark, where, lambda s: policies.machine(s.where("t < 200000 AND t <> 1500"), "s", "t", "t", "cls", "idle", {("idle", "a"): "on"}, 900, late="0 seconds"))
    assert {(r.s, r.t) for r in moves} == {("k", 1000), ("k", 1400), *(("z", 100_000 + i) for i in range(3))}
    # all that is left is one waiting row of z, its counters and its timer
    assert state[-1]["numRowsTotal"] <= 6


def test_rows_of_one_file_arrive_late(spark):
    """The case of the overlapping files: the second one brings earlier rows that the first one's would otherwise have suppressed."""
    where = tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp")
    for rows in ([110, 111, 130], [100, 105, 120, 141]):
        spark.createDataFrame([("a", 1000 * t) for t in rows], "s string, t long").selectExpr("s", "t", "0.0D AS v", "'a' AS cls", "true AS fires", "array('x') AS slots", "CAST(NULL AS STRING) AS fallback", "timestamp_millis(t) AS ts").coalesce(1).write.mode("append").parquet(where)
    got, _ = run(spark, where, lambda s: policies.debounced(s, "s", "t", 10_000, late="1 day"))
    assert got == []  # nothing is final yet
    spark.createDataFrame([("b", 200_000_000)], "s string, t long").selectExpr("s", "t", "0.0D AS v", "'a' AS cls", "true AS fires", "array('x') AS slots", "CAST(NULL AS STRING) AS fallback", "timestamp_millis(t) AS ts").write.mode("append").parquet(where)
    got, _ = run(spark, where, lambda s: policies.debounced(s, "s", "t", 10_000, late="1 day"))
    assert {r.t // 1000: r.emitted for r in got} == {100: True, 105: False, 110: True, 111: False, 120: True, 130: True, 141: True}


def test_setting_comes_back(spark):
    was = spark.conf.get(PROVIDER, None)
    with rocksdb_state(spark):
        assert "RocksDB" in spark.conf.get(PROVIDER)
    assert spark.conf.get(PROVIDER, None) == was


class Store:
    """A key's state and timers by themselves, with the calls on them counted."""

    def __init__(self):
        self.map, self.value, self.timers, self.calls, self.most = {}, None, set(), 0, 0

    def getMapState(self, *_):
        def call(f):
            def counted(*a):
                self.calls += 1
                return f(*a)

            return counted

        put = lambda k, v: (self.map.update({k: v}), setattr(self, "most", max(self.most, len(self.map))))
        return SimpleNamespace(updateValue=call(put), getValue=call(lambda k: self.map[tuple(k)]), removeKey=call(lambda k: self.map.pop(tuple(k))), keys=call(lambda: iter(list(self.map))))

    def getValueState(self, *_):
        return SimpleNamespace(get=lambda: self.value, exists=lambda: self.value is not None, update=lambda v: setattr(self, "value", v), clear=lambda: setattr(self, "value", None))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


@pytest.mark.parametrize("n, span, most", [(200, 10**9, 0), (2000, 10**9, 20), (50_000, 10**7, 420)])
def test_a_key_costs_calls_by_parts_not_by_rows(n, span, most):
    """Rows come shuffled, in calls of different sizes, and go out in order, each once, as the watermark passes; few calls on the state."""
    rng, store = random.Random(n), Store()
    fold = Fold(lambda: 0, lambda s, row: (s + 1, [(row[0], row[1], row[2], s)]), lambda s: None, lambda key, s: [])
    p = InOrder(fold, ["t", "i"], ["k", "t", "i", "at"], 600_000)
    p.init(store)
    rows = [(rng.randrange(span), i) for i in range(n)]
    kind = Row("k", "t", "i", "ts")
    wait, out, edges = rows[:], [], (0, n // 2, n // 2 + n // 10, n)
    for a, z in itertools.pairwise(edges):
        p.handleInputRows(key=("k",), rows=(kind("k", t, i, None) for t, i in wait[a:z]), timerValues=None)
    for watermark in (span // 3, span // 2, span + 1):
        if due := [at for at in store.timers if at <= watermark]:
            store.timers -= set(due)
            out += [tuple(r) for r in p.handleExpiredTimer(key=("k",), timerValues=SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w), expiredTimerInfo=None)]
            assert len(out) == sum(t < watermark for t, _ in rows)
    assert out == [("k", t, i, at) for at, (t, i) in enumerate(sorted(rows))] and not store.map
    assert store.calls <= 4 * most
