"""Literal cases, properties against plain loops, and independence of partitioning."""

from __future__ import annotations

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from utterlake.functions import arrays, scoring, text
from utterlake.operators import choose, collate, decide, events, frames, joins, metrics, rows, splits
from utterlake.sources import manifest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("said", "want"),
    [("It’s 6:00 AM, #1!", "it's am"), ("  A   b ", "a b"), ("100%", ""), ("", ""), (None, None)],
)
def test_normalize_text(spark, said, want):
    assert one(spark, text.normalize_text(F.lit(said).cast("string"))) == want


@pytest.mark.parametrize(
    ("said", "want"),
    [("set 6:00 to 50%", "set six to fifty%"), ("0 and 100", "zero and one hundred"), ("101", None), ("no number", "no number"), ("21", "twenty one")],
)
def test_spell_numbers(spark, said, want):
    assert one(spark, text.spell_numbers(F.lit(said))) == want


@pytest.mark.parametrize(("said", "want"), [("call me @ 5 & 6", "call me at 5 and 6"), ("room 101", None), ("a # b", None), ("0100", "0100"), ("99999999999999999999", None)])
def test_normalize_unknown(spark, said, want):
    assert one(spark, text.normalize_unknown(F.lit(said))) == want


def test_alias(spark):
    assert one(spark, text.alias_normalize(F.lit("At 6am or 7:00 p.m., 50%"))) == "at 6 am or 7 pm 50 percent"


def test_phrases(spark):
    t = spark.createDataFrame([("LIGHT", "level", "set light to {}"), ("OFF", None, "off")], "intent string, slot string, template string")
    v = spark.createDataFrame([("level", "5", "5"), ("level", "5", "five")], "slot string, value string, said string")
    table = text.phrase_table(t, v)
    assert {r.text for r in table.collect()} == {"set light to 5", "set light to five", "off"}
    assert {r.prefix for r in text.incomplete_prefixes(table).collect()} == {"set", "set light", "set light to"}


def test_largest_remainder(spark):
    df = spark.createDataFrame([("g", k, w) for k, w in [("a", 1), ("b", 1), ("c", 1)]], "g string, k string, w int")
    got = {r.k: r.n for r in splits.largest_remainder(df, ["g"], "k", "w", F.lit(10)).collect()}
    assert got == {"a": 4, "b": 3, "c": 3}
    back = {r.k: r.n for r in splits.largest_remainder(df, ["g"], "k", "w", F.lit(10), tie_desc=True).collect()}
    assert back == {"a": 3, "b": 3, "c": 4}


def test_group_split_equals_loop(spark):
    rng = random.Random(4)
    sizes = [(f"f{f}", f"g{i}", rng.randint(1, 30)) for f in range(3) for i in range(40)]
    df = spark.createDataFrame(sizes, "fam string, grp string, n int")
    got = {(r.fam, r.grp): r.split for r in splits.group_split(df.repartition(7), "fam", "grp", "n", 9, {"train": 8, "val": 1, "test": 1}).collect()}
    want = {}
    for fam in {s[0] for s in sizes}:
        mine = sorted((hashlib.md5(f"9:group:{f}:{g}".encode()).hexdigest(), g, n) for f, g, n in sizes if f == fam)
        total, have = sum(n for _, _, n in mine), {"train": 0, "val": 0, "test": 0}
        for _, g, n in mine:
            to = max(have, key=lambda p: ({"train": 8, "val": 1, "test": 1}[p] * total - 10 * have[p], p))
            have[to] += n
            want[fam, g] = to
    assert got == want


def test_pinned_split_keeps_groups(spark):
    df = spark.createDataFrame([(label, f"g{i}", 10 - i % 3) for label in ("a", "b") for i in range(12)], "label string, grp string, n int")
    got = splits.pinned_split(df, ["a", "b"], [("train", 7), ("val", 2), ("test", 1)]).collect()
    by = {}
    for r in got:
        by.setdefault(r.grp, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    assert {r.split for r in got} == {"train", "val", "test"}


def test_budget_stops_exactly(spark):
    df = spark.createDataFrame([("s", i) for i in range(40)], "s string, i int")
    got = splits.budget(df, "s", "i", F.col("i") % 2 == 0, 25, 1).collect()
    assert sum(2 if r.noisy else 1 for r in got) == 25


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([(i, f"b{i % 3}", f"g{i % 7}") for i in range(200)], "i int, b string, g string")
    for f in (
        lambda x: splits.capped_sample(x, "b", "g", "i", 30, 5),
        lambda x: splits.exact_split(x, "b", "i", 2, [("train", 70), ("val", 20), ("test", 10)]),
        lambda x: splits.family_draw(x, "b", "g", "i", 20, 3),
        lambda x: splits.step_plan(x, "b", "i", {"p": 0.3}, 1, 1),
    ):
        assert sorted(map(tuple, f(df.repartition(1)).collect())) == sorted(map(tuple, f(df.repartition(7)).collect()))


def test_threshold_ties(spark):
    s = spark.createDataFrame([(0.5, 0.2), (0.7, 0.2), (0.6, 0.1)], "threshold double, j double")
    assert choose.best_threshold(s).first().threshold == 0.7


def test_sweep_and_gated_input(spark):
    df = spark.createDataFrame([("a", 0.9, 1.0), ("a", 0.5, None), (None, None, 2.0)], "intent string, confidence double, gap double").withColumn("t", F.col("intent") == "a")
    got = {r.threshold: (r.ta, r.fa) for r in metrics.sweep(df, [0.4, 0.9, 0.95], F.coalesce(F.col("t"), F.lit(False))).collect()}
    assert got == {0.4: (2, 0), 0.9: (1, 0), 0.95: (0, 0)}
    with pytest.raises(ValueError):
        metrics.margin_sweep(df.withColumn("gated", F.lit(True)), 0.5, [1.0], F.lit(True))


def test_wilson_and_sign_test(spark):
    assert one(spark, scoring.wilson(F.lit(0), F.lit(0), True)) is None
    assert one(spark, scoring.wilson(F.lit(0), F.lit(10), False)) == 0.0
    assert one(spark, arrays.sign_test(F.lit(3), F.lit(4))) == pytest.approx(5 / 16)
    assert one(spark, arrays.sign_test(F.lit(0), F.lit(0))) == 1.0


def test_debounce_refractory(spark):
    df = spark.createDataFrame([("s", t, t) for t in (0, 10, 20, 30, 40)], "s string, t long, k long")
    got = [r.emitted for r in events.debounce(df, "s", "t", F.lit(True), 30, "k").orderBy("k").collect()]
    assert got == [True, False, False, True, False]
    assert all(r.emitted for r in events.debounce(df, "s", "t", F.lit(True), 0, "k").collect())


def test_gate_closes_exactly(spark):
    df = spark.createDataFrame([("s", 0, 1.0), ("s", 5, 0.0), ("s", 10, 0.0)], "s string, t long, v double")
    got = [r.open for r in events.gate_open(df, "s", "t", "v", 1.0, 10).orderBy("t").collect()]
    assert got == [True, True, False]


POLLS = "s string, t long, open_at long, intent string, slots array<string>, ok boolean, ended boolean, fallback_ended boolean, speech long, fallback string"


def ends(spark, polls, **options):
    df = spark.createDataFrame([("s", *p) for p in polls], POLLS)
    return [(r.opened_at, r.t, r.intent, r.reason) for r in events.endpointed(df, "s", **({"period": 5000, "stable": 2} | options)).orderBy("t").collect()]


def test_endpointed(spark):
    no = (False, 0, None)
    said = lambda t, at, intent="on", ended=True, slots=None: (t, at, intent, slots, True, ended, *no)
    # two equal confident windows, the second one ended; nothing within the first 300 ms
    assert ends(spark, [said(0, 0), said(200, 0), said(400, 0, ended=False), said(600, 0)]) == [(0, 600, "on", "accepted")]
    assert ends(spark, [said(0, 0), said(400, 0, "on"), said(600, 0, "off"), said(800, 0, "off")]) == [(0, 800, "off", "accepted")]
    # the time-out counts from the latest opening, the period from the first
    quiet = lambda t, at: (t, at, "on", None, False, False, *no)
    assert ends(spark, [quiet(0, 0), quiet(2000, 2000), quiet(5000, 2000), quiet(7000, 2000)]) == [(0, 7000, None, "timeout")]
    # after closing, the old detection must stop before a new one counts
    again = [said(0, 0), said(400, 0), said(600, 0), said(700, 700), said(900, 900), said(1000, None), said(1100, 1100), said(1500, 1100), said(1700, 1100)]
    assert ends(spark, again) == [(0, 600, "on", "accepted"), (1100, 1700, "on", "accepted")]
    # alternating slots are no stable command; the same ones in another order are
    lights = lambda t, *slots: said(t, 0, slots=list(slots))
    assert ends(spark, [lights(0), lights(400, "on"), lights(600, "off"), lights(800, "on"), lights(1000, "off")]) == []
    assert ends(spark, [lights(0), lights(400, "on", "red"), lights(600, "off"), lights(800, "on", "red"), lights(1000, "red", "on")]) == [(0, 1000, "on", "accepted")]
    # a pause ends the session and its open period
    assert ends(spark, [said(0, 0), said(400, 0, ended=False), said(9000, None)], idle=5000) == [(0, 5000, None, "timeout")]
    assert ends(spark, [said(0, 0), said(400, 0, ended=False)], idle=5000) == [(0, 5000, None, "timeout")]


def test_endpointed_fallback(spark):
    ask = lambda t, speech, long, what: (t, 0, "on", None, False, True, long, speech, what)
    assert ends(spark, [ask(0, 300, True, "red"), ask(400, 300, True, "red")]) == [(0, 400, "red", "fallback")]
    assert ends(spark, [ask(0, 0, True, "red"), ask(400, 199, True, "red"), ask(600, 300, False, "red"), ask(800, 300, True, None)]) == []


@pytest.mark.parametrize("stretch", [1, 2, 64])
def test_debounce_equals_one_fold(spark, stretch):
    rng = random.Random(6)
    times = rng.sample(range(0, 4000), 600) + rng.sample(range(9000, 90000), 300) + [rng.randrange(-500, 4000) for _ in range(200)]
    rows_ = [(f"s{i % 3}" if i % 7 else None, t, i) for i, t in enumerate(times)]
    df = spark.createDataFrame([*rows_, ("s1", None, 9999)], "s string, t long, k long").repartition(5)
    got = {r.k: r.emitted for r in events.debounce(df, "s", "t", F.lit(True), 40, "k", stretch).collect()}
    want, last = {9999: False}, {}
    for s, t, k in sorted(rows_, key=lambda r: (r[1], r[2])):
        want[k] = s not in last or t - last[s] >= 40
        last[s] = t if want[k] else last[s]
    assert got == want
    assert {r.emitted for r in events.debounce(df.where("t IS NOT NULL"), "s", "t", F.lit(True), 0, "k").collect()} == {True}


def test_state_fold_composes_stretches(spark):
    table = {("a", "x"): "b", ("b", "x"): "a", ("b", "y"): "c", ("c", "x"): "a", ("a", "y"): "a"}
    rng = random.Random(8)
    rows_ = [(f"d{i % 3}", i, rng.choice("xyz")) for i in range(300)] + [("idle", 7, "z")]
    got = {r.d: (r.state, r.changes) for r in events.state_fold(spark.createDataFrame(rows_, "d string, o long, e string"), "d", "o", "e", "a", table, stretch=16).collect()}
    want = {}
    for d, _, e in rows_:
        state, n = want.get(d, ("a", 0))
        want[d] = (table.get((state, e), state), n + ((state, e) in table))
    assert got == want


def unit(i, label, slot="", oos=False):
    return (i, label, slot, oos, 0.2, 3.0, 4.0)


def trig(i, t, intent, slots=(), text="x"):
    return (i, "trigger", t, intent, list(slots), text, 60.0, 2.0)


UNITS = "u int, label string, slot_value string, is_oos boolean, gap_s double, speech_end double, unit_end double"
RECORDS = "u int, event string, t double, intent string, slots array<string>, text string, decode_ms double, gate_ms double"


def test_soak_score(spark):
    """Correct, wrong slot, missed, correct but early, out of scope, and a second trigger in the gap."""
    units = [unit(0, "STOP"), unit(1, "TIMER", "10 seconds"), unit(2, "PAUSE"), unit(3, "NEXT"), unit(4, "unknown", oos=True), unit(5, "unknown", oos=True), unit(6, "STOP")]
    records = [trig(0, 3.4, "STOP"), trig(1, 3.5, "TIMER", ["1 minute"], "[classifier]"), trig(3, 2.5, "NEXT"), trig(4, 3.0, "WEATHER"), trig(6, 3.2, "STOP"), trig(6, 6.0, "STOP")]
    s = events.soak_score(spark.createDataFrame(units, UNITS), spark.createDataFrame(records, RECORDS), "u").first()
    assert (s.commands, s.correct, s.missed, s.no_period) == (5, 3, 1, 1)
    assert (s.wrong_intents, s.wrong_actions, s.early, s.by_classifier) == (0, 1, 1, 0)
    assert (s.oos, s.oos_accepts, s.gap_triggers, s.extra) == (2, 1, 1, 1)
    assert s.objective == 3 - 2 * (1 + 1 + 1) and (s.gap_00_03_correct, s.gap_00_03_all) == (3, 5)
    assert abs(s.late_p50 - 0.4) < 0.31 and s.decode_ms_mean == 60.0 and s.both_ms_p95 == 62.0 and s.rtf_p95 == 0.248


def test_soak_slots_ignore_case(spark):
    units = [unit(0, "TIMER", "10 seconds"), unit(1, "TIMER", "10 seconds"), unit(2, "TIMER")]
    records = [trig(0, 3.1, "TIMER", ["10 Seconds"]), trig(1, 3.1, "TIMER", ["1 minute"]), trig(2, 3.1, "TIMER")]
    assert events.soak_score(spark.createDataFrame(units, UNITS), spark.createDataFrame(records, RECORDS), "u").first().correct == 2


def test_replay_score(spark):
    s = spark.createDataFrame([(0, "A", 3.0), (1, "A", 3.0), (2, "B", 3.0), (3, "B", 3.0)], "s int, label string, speech_end double")
    t = spark.createDataFrame([(0, 2.0, "A"), (0, 5.0, "B"), (1, 4.0, "B"), (1, 4.5, "A"), (2, 3.5, "B")], "s int, t double, intent string")
    r = events.replay_score(s, t, "s", ["A", "B"]).first()
    assert (r.sessions, r.correct, r.correct_rate, r.wrong, r.missed, r.early, r.extra) == (4, 2, 0.5, 2, 1, 1, 2)
    assert (r.p50, r.mean, r.focus_A, r.focus_B) == (-0.25, -0.25, "1/2", "1/2")


def test_pinned_split_equals_loop(spark):
    rng = random.Random(12)
    sizes = [(label, f"g{g}", rng.randint(1, 40)) for label in ("a", "b", "c") for g in rng.sample(range(60), 40)]
    parts = [("train", 7), ("val", 2), ("test", 1)]
    got = {(r.label, r.grp): r.split for r in splits.pinned_split(spark.createDataFrame(sizes, "label string, grp string, n int").repartition(5), ["a", "b", "c"], parts).collect()}
    want, pins = {}, {}
    for label in ("a", "b", "c"):
        mine = sorted(((g in pins) is False, -n, g) for x, g, n in sizes if x == label)
        total, have = -sum(m for _, m, _ in mine), dict.fromkeys(("train", "val", "test"), 0)
        for _, m, g in mine:
            to = pins.get(g) or max(parts, key=lambda p: (p[1] * total - 10 * have[p[0]], -[q for q, _ in parts].index(p[0])))[0]
            have[to] -= m
            want[label, g] = to
        for (x, g), to in want.items():
            if x == label:
                pins[g] = min(pins.get(g, to), to)
    assert got == want


def test_pinned_split_of_many_labels_plans_at_once(spark):
    rng = random.Random(13)
    labels = [f"l{i:02}" for i in range(93)]
    sizes = [(x, f"g{g}", rng.randint(1, 40)) for x in labels for g in rng.sample(range(3000), 12)]
    df = spark.createDataFrame(sizes, "label string, grp string, n int")
    began = time.perf_counter()
    out = splits.pinned_split(df, labels, [("train", 7), ("val", 2), ("test", 1)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert time.perf_counter() - began < 10 and plan.count("Arrow") <= 4  # one fold, whatever the number of labels
    by = {}
    for r in out.collect():
        by.setdefault(r.grp, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values()) and sum(1 for _ in sizes) == out.count()


def test_ranks_equal_sorting(spark):
    from utterlake.operators import ranks

    rng = random.Random(3)
    rows_ = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1), float("inf"), float("-inf")]) if i % 50 == 0 else rng.gauss(0, 1e6 if i % 2 else 1), i) for i in range(800)]
    df = spark.createDataFrame(rows_, "g string, v double, i int").repartition(6)
    want = {}
    for g in ("a", "b", None):
        for n, r in enumerate(sorted((r for r in rows_ if r[0] == g), key=lambda r: r[1])):
            want[r[2]] = (n, r[1])
    got = {r.i: (r.r, r.v) for r in ranks.ranked_by_number(df, ["g"], "v", "r").collect()}
    assert {i: v for i, (_, v) in got.items()} == {i: v for i, (_, v) in want.items()}
    assert all(got[i] == want[i] for i in want if abs(want[i][1]) < float("inf"))
    top = ranks.ranked(df, ["g"], F.md5(F.col("i").cast("string")), upto=F.lit(10)).where("_r < 10").collect()
    order = {g: sorted((hashlib.md5(str(r[2]).encode()).hexdigest(), r[2]) for r in rows_ if r[0] == g)[:10] for g in ("a", "b", None)}
    assert sorted((str(r.g), r._r, r.i) for r in top) == sorted((str(g), n, i) for g, x in order.items() for n, (_, i) in enumerate(x))


def test_streaks_reset(spark):
    df = spark.createDataFrame([("s", i, v, ok) for i, (v, ok) in enumerate([("a", True), ("a", True), ("b", True), ("b", False), ("b", True)])], "s string, i int, v string, ok boolean")
    assert [r.streak for r in frames.streaks(df, "s", "i", ["v"], F.col("ok")).orderBy("i").collect()] == [1, 2, 1, 0, 1]


def test_guards_raise(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(collate.Violation):
        collate.must_be_empty(collate.duplicate_keys(df, ["k"]), "unique")
    with pytest.raises(joins.MissingRows):
        joins.mandatory(df, spark.createDataFrame([(2,)], "k int"), "k")
    with pytest.raises(manifest.BadTable):
        manifest.check_table(df, ["gone"], 0, 10)
    with pytest.raises(manifest.BadTable):
        manifest.merge_shards([df, df], "k")


def test_paths(spark):
    assert one(spark, rows.normal_path(F.lit("a/./b/../../../c"))) == "../c"
    assert one(spark, rows.contained(F.lit("a/../../b"))) is False


INP = {
    "noisy_b_fa": 10, "noisy_s_fa": 5, "noisy_b_babble_fa": 6, "noisy_s_babble_fa": 5, "removed": 8, "added": 0, "clean_b_fa": 4, "clean_s_fa": 4,
    "clean_b_exact": 1000, "clean_s_exact": 1000, "clean_b_n_targets": 1000, "noisy_b_exact": 1000, "noisy_s_exact": 1000, "noisy_b_n_targets": 1000, "noisy_b_ts_fa": 5, "noisy_s_ts_fa": 5,
}


def rule_row(spark, parity=True, **other):
    """Rows of DR1's counts, one for each combination of the values given."""
    return spark.createDataFrame([tuple((INP | other).values()) + (parity,)], ", ".join(f"{k} long" for k in INP) + ", parity boolean")


def label_row(spark, n=50, clean=50, noisy=None):
    return spark.createDataFrame([("TIME", n, n, clean, n, n if noisy is None else noisy)], "label string, clean_n long, clean_b_exact long, clean_s_exact long, noisy_b_exact long, noisy_s_exact long")


@pytest.mark.parametrize(
    ("other", "rule", "ok"),
    [
        ({"noisy_s_fa": 5}, "r1", True), ({"noisy_s_fa": 6}, "r1", False), ({"noisy_s_babble_fa": 6}, "r2", False),
        ({"removed": 5}, "r3", True), ({"removed": 4}, "r3", False), ({"removed": 0}, "r3", False),
        ({"clean_s_fa": 4}, "r4", True), ({"clean_s_fa": 5}, "r4", False), ({"noisy_s_ts_fa": 5}, "r7", True), ({"noisy_s_ts_fa": 6}, "r7", False),
        ({"clean_s_exact": 995}, "r5", True), ({"clean_s_exact": 994}, "r5", False), ({"noisy_s_exact": 994}, "r5", False),
    ],
)
def test_go_no_go_boundaries(spark, other, rule, ok):
    r = decide.go_no_go(rule_row(spark, **other), label_row(spark)).first()
    assert r[rule] is ok
    assert r.verdict == ("GO" if ok else "NO-GO") and (ok or rule.upper() in r.reason)


def test_go_no_go_labels_parity_and_few(spark):
    say = lambda row, labels: decide.go_no_go(row, labels).first()
    assert say(rule_row(spark), label_row(spark, 100, 97)).r6 and not say(rule_row(spark), label_row(spark, 100, 96)).r6
    assert say(rule_row(spark), label_row(spark, 49, 0)).r6  # below the floor of 50 targets: ignored
    assert not say(rule_row(spark), label_row(spark, 100, 100, 96)).r6
    r = say(rule_row(spark, False), label_row(spark))
    assert (r.verdict, r.reason, r.r1) == ("INVALID", "parity_failed", None)
    r = say(rule_row(spark, noisy_b_fa=3, noisy_s_fa=0), label_row(spark))
    assert (r.verdict, r.reason, r.r1) == ("NO-GO", "baseline_far_already_absorbed_by_margin", None)


def gate_tables(spark, s, c=(0, 0), label=100):
    """Baseline of 1000 exact rows and 4 false accepts in each condition against s: (exact, fa) clean and noisy."""
    (ce, cf), (ne, nf) = s
    row = [("val", 1000, 1000, 4, ce, cf, c[0], 1000, 1000, 4, ne, nf, c[1])]
    cols = ", ".join(f"{k}_{v} long" for k in ("clean", "noisy") for v in ("b_n_targets", "b_exact", "b_fa", "s_exact", "s_fa", "c_fa"))
    return spark.createDataFrame(row, "split string, " + cols), spark.createDataFrame([("val", "X", 100, 100, label, 100, 100)], "split string, label string, clean_n long, clean_b_exact long, clean_s_exact long, noisy_b_exact long, noisy_s_exact long")


def test_gate_boundaries(spark):
    g = lambda *a, **k: decide.gates(*gate_tables(spark, *a, **k), ["split"]).first()
    assert not g(((995, 4), (995, 4)), label=97).g5  # 8 > 0 + 2
    ok = g(((995, 1), (995, 1)), label=97)
    assert all(ok[f"g{i}"] for i in range(1, 6))
    assert not g(((994, 1), (995, 1))).g3
    assert g(((1000, 0), (1000, 0)), label=96).failing == ["X"]
    assert g(((1000, 5), (1000, 0))).g2 is False


def test_hybrid_verdict_paths(spark):
    def say(val, test):
        rows_ = [(name, *[g not in bad for g in ("g1", "g2", "g3", "g4", "g5")], labels) for name, (bad, labels) in (("val", val), ("test", test))]
        return decide.hybrid_verdict(spark.createDataFrame(rows_, "split string, g1 boolean, g2 boolean, g3 boolean, g4 boolean, g5 boolean, failing array<string>")).first().verdict

    ok, g4 = ((), []), (("g4",), ["PAUSE"])
    assert say(ok, ok) == "GO" and say(ok, g4) == "INCONCLUSIVE" and say(g4, ok) == "NO-GO"
    assert say(ok, (("g4",), ["A", "B", "C"])) == "NO-GO" and say(ok, (("g4", "g1"), ["PAUSE"])) == "NO-GO"


def test_calibrate(spark):
    rows_ = [("A", -0.05, -0.05, None), ("A", -0.09, -0.09, None), ("A", -0.5, -0.5, None), ("B", -0.08, -0.08, None), ("B", -0.2, -0.2, None), ("C", -0.6, -0.6, None), (None, None, None, None), ("A", -0.01, -0.01, 1.0)]
    df = spark.createDataFrame(rows_, "intent string, confidence double, d1 double, gap double")
    got = {r["at"]: r.tau for r in decide.calibrate(df, {"d1": "d1"}, -0.1, 4.0).collect()}
    assert got == {"d1|*": -0.09, "d1|A": -0.09, "d1|B": -0.08}  # the third best of all; C has no baseline accept; the small gap is not eligible
    ok = decide.with_thresholds(df, decide.calibrate(df, {"d1": "d1"}, -0.1, 4.0))
    relax, own = (ok.select(decide.config_ok(f"d1-{m}", {"d1": "d1"}, -0.1, 4.0).alias("x")) for m in ("relax", "per_intent"))
    assert [r.x for r in relax.collect()] == [True, True, False, True, False, False, False, False]
    assert [r.x for r in own.collect()] == [True, True, False, True, False, False, False, False]


def test_halves_are_crc_bits(spark):
    import zlib

    got = {r.g: r.h for r in spark.createDataFrame([(f"s{i}",) for i in range(200)], "g string").select("g", decide.half_of(F.col("g")).alias("h")).collect()}
    assert got == {g: zlib.crc32(g.encode()) & 1 for g in got} and 60 < sum(got.values()) < 140


def test_gate_a(spark):
    def say(clean, noisy, babble):
        row = spark.createDataFrame([(980, clean, 1000, 950, noisy, 1000, 0, babble, 47)], "clean_b_exact long, clean_s_exact long, clean_b_n_targets long, noisy_b_exact long, noisy_s_exact long, noisy_b_n_targets long, noisy_b_babble_fa long, noisy_s_babble_fa long, scale long")
        return {r.criterion: (r.bound, r.ok) for r in decide.gate_a(row).collect()}

    assert say(976, 946, 1) == {"clean_exact": (975, True), "noisy_exact": (945, True), "noisy_babble_fa": (1, True)}
    assert say(970, 950, 2) == {"clean_exact": (975, False), "noisy_exact": (945, True), "noisy_babble_fa": (1, False)}


def test_voice_split_brute_force(spark):
    from itertools import combinations

    n = [5, 9, 2, 7, 4, 6]
    got = splits.voice_split(spark.createDataFrame(list(enumerate(n)), "no int, n int"), 2, 1).first()
    total = sum(n)
    best = min((abs(100 * sum(n[i] for i in t) - 30 * total) + abs(100 * n[v[0]] - 8 * total), t, v) for t in combinations(range(6), 2) for v in combinations(range(6), 1) if not set(t) & set(v))
    assert (got.err, got.test_ids, got.val_ids) == (best[0], ",".join(map(str, best[1])), str(best[2][0]))
