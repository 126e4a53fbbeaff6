"""Pre-registered decision rules over counts.

Rows are read twice, whatever the number of scorers, configs and rules. The
first pass counts rows by threshold key and score (`score_counts`), from which
thresholds are selected exactly; the second counts them by split, condition,
bucket, label, intent and the configs that accept them (`decision_cube`), from
which every rule follows. Both tables are written. Rates are compared in
integers, by cross-multiplication.

A score row has bucket (target_commands, babble, silence), label, intent,
gap and a score for each scorer. Configs are named scorer-mode: `fixed` takes
the common base threshold, `global` one calibrated threshold, `per_intent`
own thresholds with the global one where an intent has none, `relax` own
thresholds that are never above the global one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import sign_test
from ..functions.scoring import count_where, margin_ok, ratio0, wilson
from ..sources.kept import keep
from .choose import iso_threshold

#: Fixed values of the registered rules.
TARGET = "target_commands"
REJECT = ("babble", "silence")
CONDITIONS = ("clean", "noisy")
LOSS_PER_MILLE = 5
LABEL_LOSS_PERCENT = 3
LABEL_LEAST = 50
LEAST_BASELINE = 4
ALPHA = 0.05
TOTAL_SLACK = 2
INCONCLUSIVE_LABELS = 2
MOST_GAP = 0.30
ORDER = ("d2-global", "d1-global", "d2-per_intent", "d1-per_intent", "baseline-per_intent")
FOLLOW_UP = ORDER[:4]
ALL = "*"


def criteria(row: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row a rule from a row of metrics; a null outcome is not ok."""
    cells = F.array(*[F.struct(F.lit(n).alias("criterion"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in rules.items()])
    return row.select(F.inline(cells))


def verdict(table: DataFrame, valid: Column | None = None) -> DataFrame:
    """GO if every criterion holds, else NO-GO."""
    return table.agg(F.when(F.bool_and("ok"), "GO").otherwise("NO-GO").alias("verdict"), F.count_if(~F.col("ok")).alias("failed"))


def half_of(group: Column) -> Column:
    """Group-disjoint halves by the lowest bit of the group's CRC-32."""
    return F.crc32(F.encode(group.cast("string"), "UTF-8")).bitwiseAND(1).cast("int")


def calibration_cells(scorers: dict[str, str], base: float, margin: float | None, by: Column | str = "", where: Column | None = None) -> list[Column]:
    """Cells of score_counts for the thresholds of scorers over all intents (scorer|*) and within each intent (scorer|intent); keys begin with `by`."""
    met = F.coalesce(F.col("intent").isNotNull() & margin_ok(F.col("gap"), margin) & (where if where is not None else F.lit(True)), F.lit(False))
    by = F.lit(by) if isinstance(by, str) else by
    base_ok = F.coalesce(F.col("confidence") >= base, F.lit(False))
    return [_cell(F.concat(by, F.lit(f"{s}|"), at), every, F.col(c), base_ok, met) for s, c in scorers.items() for every, at in ((True, F.lit(ALL)), (False, F.col("intent")))]


def _cell(at: Column, every: bool, score: Column, base: Column, where: Column) -> Column:
    return F.when(where, F.struct(at.alias("at"), F.lit(every).alias("every"), score.cast("double").alias("score"), base.alias("base")))


def score_counts(df: DataFrame, cells: list[Column]) -> DataFrame:
    """at, every, score: rows n and those that the baseline accepts (base), in one pass over df. A row meets each cell (at, every, score, base) that isn't null."""
    long = df.select(F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))
    return keep(long.groupBy("at", "every", "score").agg(F.count(F.lit(1)).alias("n"), count_where(F.col("base")).alias("base")), "scores")


def calibrated(counts: DataFrame) -> DataFrame:
    """at, tau: the highest threshold at which as many rows are accepted as the baseline accepts; keys that aren't `every` only if it accepts any."""
    want = counts.groupBy("at", "every").agg(F.sum("base").alias("n")).where("every OR n > 0").select("at", "n")
    return keep(iso_threshold(counts, "at", "score", want, F.col("n")), "thresholds")


def calibrate(df: DataFrame, scorers: dict[str, str], base: float, margin: float | None, by: Column | str = "") -> DataFrame:
    """at, tau: the highest threshold at which a scorer accepts as many rows as the baseline score at `base`, over all intents (scorer|*) and within each intent that the baseline accepts at all (scorer|intent). df: clean validation targets."""
    return calibrated(score_counts(df, calibration_cells(scorers, base, margin, by)))


def with_thresholds(df: DataFrame, taus: DataFrame) -> DataFrame:
    """df with `taus`: every threshold in one map; as many entries as scorers, halves and intents."""
    return df.crossJoin(taus.agg(F.map_from_entries(F.collect_list(F.struct("at", "tau"))).alias("taus")))


def config_ok(config: str, scorers: dict[str, str], base: float, margin: float | None, by: Column | str = "") -> Column:
    """Whether a config accepts a row of `with_thresholds`."""
    scorer, mode = config.split("-")
    score = F.col(scorers[scorer])
    by = F.lit(by) if isinstance(by, str) else by
    at = lambda place: F.try_element_at(F.col("taus"), F.concat(by, F.lit(scorer + "|"), place))
    common = F.coalesce(at(F.lit(ALL)), F.lit(float("inf")))
    own = F.coalesce(at(F.col("intent")), common)
    tau = {"fixed": F.lit(base), "global": common, "per_intent": own, "relax": F.least(common, own)}[mode]
    return F.coalesce(F.col("intent").isNotNull() & margin_ok(F.col("gap"), margin) & (score >= tau), F.lit(False))


def decision_cube(df: DataFrame, keys: list[str], configs: dict[str, Column], marks: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """Keys, bucket, label, intent, marks and the set of configs that accept: rows n, and how many of them meet each of `sums`; in one pass over df. Also what reads a config's acceptance from it. Thresholds nest, so few of the sets occur."""
    ok = F.struct(*[F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, c in enumerate(configs.values())])
    cells = df.select(*keys, "bucket", "label", "intent", *[c.alias(m) for m, c in (marks or {}).items()], ok.alias("ok"), *[F.coalesce(c, F.lit(False)).alias(f"_{m}") for m, c in (sums or {}).items()])
    cube = cells.groupBy(*keys, "bucket", "label", "intent", *(marks or {}), "ok").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"_{m}").alias(m) for m in sums or {}])
    return keep(cube, "cube"), {name: F.col(f"ok.c{i}") for i, name in enumerate(configs)}


def outcomes(cube: DataFrame, keys: list[str], configs: dict[str, Column], base: str) -> DataFrame:
    """Keys, bucket, label, intent, config: rows n, accepted rows ok, rows that only the base config (lost) or only this one (won) accepts."""
    cells = [F.struct(F.lit(c).alias("config"), F.col("rows").alias("n"), F.col(f"ok{i}").alias("ok"), F.col(f"lost{i}").alias("lost"), F.col(f"won{i}").alias("won")) for i, c in enumerate(configs)]
    sums = [x for i, c in enumerate(configs) for x in (_sum("n", configs[c]).alias(f"ok{i}"), _sum("n", configs[base] & ~configs[c]).alias(f"lost{i}"), _sum("n", ~configs[base] & configs[c]).alias(f"won{i}"))]
    wide = cube.groupBy(*keys, "bucket", "label", "intent").agg(F.sum("n").alias("rows"), *sums)
    return wide.select(*keys, "bucket", "label", "intent", F.inline(F.array(*cells)))


def _sum(column: str, where: Column) -> Column:
    return F.coalesce(F.sum(F.when(where, F.col(column))), F.lit(0))


def _right() -> Column:
    return F.coalesce((F.col("bucket") == TARGET) & (F.col("intent") == F.col("label")), F.lit(False))


def config_metrics(out: DataFrame, keys: list[str], time_stop: tuple[str, ...] = ()) -> DataFrame:
    """Keys, config: n_targets, accepted, exact, babble_fa, silence_fa, fa, ts_fa (false accepts of the named intents), lost and won among the rows to reject."""
    target, reject = F.col("bucket") == TARGET, F.col("bucket").isin(*REJECT)
    ts = F.coalesce(F.col("intent").isin(*time_stop), F.lit(False)) if time_stop else F.lit(False)
    return out.groupBy(*keys, "config").agg(
        _sum("n", target).alias("n_targets"), _sum("ok", target).alias("accepted"), _sum("ok", _right()).alias("exact"),
        _sum("ok", F.col("bucket") == "babble").alias("babble_fa"), _sum("ok", F.col("bucket") == "silence").alias("silence_fa"), _sum("ok", reject).alias("fa"),
        _sum("ok", reject & ts).alias("ts_fa"), _sum("lost", reject).alias("lost"), _sum("won", reject).alias("won"),
    )


def label_metrics(out: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, label, config: targets and exact rows."""
    return out.where(F.col("bucket") == TARGET).groupBy(*keys, "label", "config").agg(F.sum("n").alias("n"), _sum("ok", _right()).alias("exact"))


def side_by_side(table: DataFrame, keys: list[str], sides: dict[str, str], values: list[str]) -> DataFrame:
    """One row for the keys: each value of each side's config as side_value, 0 where it has no row."""
    return table.where(F.col("config").isin(*sides.values())).groupBy(*keys).agg(*[_sum(v, F.col("config") == c).alias(f"{s}_{v}") for s, c in sides.items() for v in values])


def by_condition(table: DataFrame, keys: list[str], values: list[str], cond: str = "cond") -> DataFrame:
    """One row for the keys: each value of each condition as condition_value."""
    return table.groupBy(*keys).agg(*[_sum(v, F.col(cond) == c).alias(f"{c}_{v}") for c in CONDITIONS for v in values])


def label_floor(labels: DataFrame, keys: list[str]) -> DataFrame:
    """labels: keys, label, clean_n, clean_b_exact, clean_s_exact and the noisy ones. Labels of 50 clean targets and more, and whether both conditions lose at most 3 points of them."""
    held = lambda c: 100 * (F.col(f"{c}_s_exact") - F.col(f"{c}_b_exact")) >= -LABEL_LOSS_PERCENT * F.col("clean_n")
    return labels.where(F.col("clean_n") >= LABEL_LEAST).select(*keys, "label", (held("clean") & held("noisy")).alias("ok"))


def exact_floor(c: str, n: str | None = None) -> Column:
    """Exact rows of the candidate at most half a point of the targets below the baseline's."""
    return 1000 * (F.col(f"{c}_s_exact") - F.col(f"{c}_b_exact")) >= -LOSS_PER_MILLE * F.col(n or f"{c}_b_n_targets")


VALUES = ["n_targets", "exact", "babble_fa", "fa", "ts_fa"]


def condition_row(out: DataFrame, keys: list[str], sides: dict[str, str], time_stop: tuple[str, ...] = ()) -> DataFrame:
    """One row for the keys: condition_side_value for both conditions and every side."""
    wide = side_by_side(config_metrics(out, [*keys, "cond"], time_stop), [*keys, "cond"], sides, VALUES)
    return by_condition(wide, keys, [f"{s}_{v}" for s in sides for v in VALUES])


def label_rows(out: DataFrame, keys: list[str], sides: dict[str, str]) -> DataFrame:
    """Keys, label: clean_n and condition_side_exact."""
    wide = side_by_side(label_metrics(out, [*keys, "cond"]), [*keys, "cond", "label"], sides, ["n", "exact"])
    return by_condition(wide, [*keys, "label"], ["b_n", *[f"{s}_exact" for s in sides]]).withColumnRenamed("clean_b_n", "clean_n")


def go_no_go(row: DataFrame, labels: DataFrame) -> DataFrame:
    """DR1: row: noisy_{b,s}_fa, noisy_{b,s}_babble_fa, removed, added, clean_{b,s}_fa, {clean,noisy}_{b,s}_exact, {clean,noisy}_b_n_targets, noisy_{b,s}_ts_fa, parity. labels: label, clean_n and the exact counts. verdict, reason and R1 to R7.

    INVALID without parity; NO-GO at once when the baseline has fewer than four noisy false accepts; else GO if all seven hold.
    """
    c = F.col
    floor = label_floor(labels, []).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("labels_ok"))
    p = sign_test(c("removed").cast("long"), (c("removed") + c("added")).cast("long"))
    rules = {
        "R1": 2 * c("noisy_s_fa") <= c("noisy_b_fa"),
        "R2": c("noisy_s_babble_fa") < c("noisy_b_babble_fa"),
        "R3": p <= ALPHA,
        "R4": c("clean_s_fa") <= c("clean_b_fa"),
        "R5": exact_floor("clean") & exact_floor("noisy"),
        "R6": c("labels_ok"),
        "R7": c("noisy_s_ts_fa") <= c("noisy_b_ts_fa"),
    }
    decided = c("parity") & (c("noisy_b_fa") >= LEAST_BASELINE)
    x = row.crossJoin(floor).select("parity", "noisy_b_fa", *[F.when(decided, F.coalesce(r, F.lit(False))).alias(k.lower()) for k, r in rules.items()])
    failed = F.array_join(F.filter(F.array(*[F.when(~c(k.lower()), k) for k in rules]), lambda k: k.isNotNull()), ",")
    few = c("noisy_b_fa") < LEAST_BASELINE
    word = F.when(~c("parity"), "INVALID").when(few, "NO-GO").when(failed == "", "GO").otherwise("NO-GO")
    why = F.when(~c("parity"), "parity_failed").when(few, "baseline_far_already_absorbed_by_margin").when(failed == "", "all_criteria_pass").otherwise(F.concat(F.lit("criteria_failed:"), failed))
    return x.select(word.alias("verdict"), why.alias("reason"), *map(str.lower, rules))


def parity(observed: DataFrame, expected: DataFrame, key: str, near: DataFrame) -> DataFrame:
    """DR2: counts equal, or one apart where some row of the key lies within 1e-4 of the threshold."""
    j = expected.withColumnRenamed("n", "want").join(observed, key, "left").join(near.select(key, F.col("near")), key, "left")
    gap = F.abs(F.coalesce("n", F.lit(0)) - F.col("want"))
    return j.select(key, (gap == 0).alias("exact"), ((gap == 0) | ((gap == 1) & (F.coalesce("near", F.lit(0)) > 0))).alias("ok"))


def cube_parity(cube: DataFrame, key: str = "cond") -> DataFrame:
    """One row, parity: whether in each key the accepted rows (seen) equal those counted from the raw values (raw), or are one apart where a row lies near the threshold (near)."""
    per = cube.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("seen", "raw", "near")])
    gap = F.abs(F.col("seen") - F.col("raw"))
    return per.agg(F.coalesce(F.bool_and((gap == 0) | ((gap == 1) & (F.col("near") > 0))), F.lit(False)).alias("parity"))


def select_config(fa: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """config: the fewest false accepts (config, fa), ties in the order given."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("config"))
    return fa.where(F.col("config").isin(*order)).agg(F.min_by("config", F.struct("fa", place.alias("p"))).alias("config"))


def overlap(cube: DataFrame, keys: list[str], base: Column, margin: Column, others: dict[str, Column]) -> DataFrame:
    """Keys, config: rows to reject that the base accepts, by what removes them: the margin only, the other config only, both, neither."""
    x = cube.where(F.col("bucket").isin(*REJECT) & base)
    kinds = lambda ok: {"margin_only": ~margin & ok, "other_only": margin & ~ok, "both": ~margin & ~ok, "neither": margin & ok}
    wide = x.groupBy(*keys).agg(F.sum("n").alias("rows"), *[_sum("n", w).alias(f"{k}{i}") for i, ok in enumerate(others.values()) for k, w in kinds(ok).items()])
    cells = [F.struct(F.lit(c).alias("config"), F.col("rows").alias("base_fa"), *[F.col(f"{k}{i}").alias(k) for k in ("margin_only", "other_only", "both", "neither")]) for i, c in enumerate(others)]
    return wide.select(*keys, F.inline(F.array(*cells)))


def gates(row: DataFrame, labels: DataFrame, keys: list[str], names: str = "g") -> DataFrame:
    """DR4, DR6: row: keys and condition_side_value; labels: keys, label. Per keys: noisy (1) and clean (2) false accepts no more than the baseline's, exact rows (3) and labels (4) within their floors, with the failing labels; where row has a control side c, total false accepts at most two over the control's (5)."""
    c = F.col
    per = label_floor(labels, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(~c("ok"), c("label")))).alias("failing"))
    x = row.join(per, keys, "left").withColumn("failing", F.coalesce("failing", F.array().cast("array<string>")))
    rules = [c("noisy_s_fa") <= c("noisy_b_fa"), c("clean_s_fa") <= c("clean_b_fa"), exact_floor("clean") & exact_floor("noisy"), F.size("failing") == 0]
    if "clean_c_fa" in row.columns:
        rules.append(c("clean_s_fa") + c("noisy_s_fa") <= c("clean_c_fa") + c("noisy_c_fa") + TOTAL_SLACK)
    return x.select(*keys, *[r.alias(f"{names}{i + 1}") for i, r in enumerate(rules)], "failing")


def hybrid_verdict(table: DataFrame, split: str = "split") -> DataFrame:
    """DR6: GO if every gate holds on val and test; INCONCLUSIVE if val passes and test fails the label gate alone, on at most two labels; else NO-GO."""
    c = F.col
    rest = c("g1") & c("g2") & c("g3") & c("g5")
    val, test = c(split) == "val", c(split) == "test"
    passed = lambda where: F.coalesce(F.bool_and(F.when(where, rest & c("g4"))), F.lit(False))
    label_only = F.coalesce(F.bool_and(F.when(test, rest & ~c("g4") & (F.size("failing") <= INCONCLUSIVE_LABELS))), F.lit(False))
    return table.agg(F.when(passed(val) & passed(test), "GO").when(passed(val) & label_only, "INCONCLUSIVE").otherwise("NO-GO").alias("verdict"))


def pooled(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """DR5: counts of the halves summed, rates from the sums."""
    g = metrics.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in ("n_targets", "accepted", "exact", "fa")])
    return g.select(*keys, "n_targets", "accepted", "exact", "fa", ratio0(F.col("accepted"), F.col("n_targets")).alias("accept_rate"), ratio0(F.col("exact"), F.col("n_targets")).alias("exact_accuracy"))


def gate_a(row: DataFrame) -> DataFrame:
    """DR7: row: {clean,noisy}_{b,s}_exact, {clean,noisy}_b_n_targets, noisy_{b,s}_babble_fa, scale. Exact rows of each condition within half a point (rounded up) of the baseline; noisy babble false accepts at most 3 in 255 of the scale, or the baseline's."""
    c = F.col
    floor = lambda cond: c(f"{cond}_b_exact") - F.ceil(0.005 * c(f"{cond}_b_n_targets"))
    allowed = F.greatest(F.ceil(F.lit(3) / F.lit(255) * c("scale")), c("noisy_b_babble_fa"))
    cells = [
        *[F.struct(F.lit(f"{cond}_exact").alias("criterion"), c(f"{cond}_s_exact").cast("long").alias("value"), floor(cond).cast("long").alias("bound"), (c(f"{cond}_s_exact") >= floor(cond)).alias("ok")) for cond in CONDITIONS],
        F.struct(F.lit("noisy_babble_fa").alias("criterion"), c("noisy_s_babble_fa").cast("long").alias("value"), allowed.cast("long").alias("bound"), (c("noisy_s_babble_fa") <= allowed).alias("ok")),
    ]
    return row.select(F.inline(F.array(*cells)))


def run_thresholds(df: DataFrame, run: str, runs: list[str], budget_run: str, target: Column, first_ok: Column, confidence: str, split: str, cond: str) -> DataFrame:
    """run, strict: each run's classifier threshold on its own clean validation rows: at most the rate of false accepts that the budget run's first scorer has there. Scores must lie above it."""
    val = df.where((F.col(split) == "val") & (F.col(cond) == "clean") & ~target)
    rate = val.where(F.col(run) == budget_run).agg(ratio0(count_where(first_ok), F.count(F.lit(1))).alias("rate"))
    n = val.groupBy(run).agg(F.count(F.lit(1)).alias("n")).crossJoin(rate).select(run, F.floor(F.col("rate") * F.col("n") + 1e-9).alias("n"))
    # the (allowed + 1)-th largest confidence; none that many: 0
    t = iso_threshold(val.where(F.col(confidence).isNotNull()), run, confidence, n.withColumn("n", F.col("n") + 1))
    return t.select(run, F.when(F.col("tau") == float("-inf"), 0.0).otherwise(F.col("tau")).alias("strict"), (F.col("tau") == float("-inf")).alias("every"))


def run_report(df: DataFrame, run: str, cond: str, target: Column, a: str, a_ok: Column, b: str, b_ok: Column, top3: Column, label: str, slot_a: Column, slot_b: Column, source: str, pairs: DataFrame) -> DataFrame:
    """DR8: run, cond, part, key, n: test rows of each run: metrics of both scorers, their agreement on targets, top-1 and top-3 cover, confusable pairs and hits by source."""
    hit = lambda p: F.coalesce(F.col(p) == F.col(label), F.lit(False))
    babble, silence = F.col("bucket") == "babble", F.col("bucket") == "silence"
    a_right, b_right, same = target & a_ok & hit(a), target & b_ok & hit(b), F.coalesce(F.col(a) == F.col(b), F.lit(False))
    parts = {
        ("rows", "targets"): target, ("rows", "babble"): babble, ("rows", "silence"): silence,
        ("first", "intent_ok"): a_right, ("first", "exact_ok"): a_right & slot_a, ("first", "babble_fa"): babble & a_ok, ("first", "silence_fa"): silence & a_ok,
        ("second", "intent_ok"): b_right, ("second", "exact_ok"): b_right & slot_b, ("second", "argmax_intent_ok"): target & hit(b), ("second", "argmax_exact_ok"): target & hit(b) & slot_b,
        ("second", "babble_fa"): babble & b_ok, ("second", "silence_fa"): silence & b_ok,
        ("agreement", "first_accepted"): target & a_ok, ("agreement", "same"): target & a_ok & same, ("agreement", "first_right"): a_right,
        ("agreement", "top1_on_right"): a_right & hit(b), ("agreement", "top3_on_right"): a_right & top3, ("cover", "top1"): target & hit(b), ("cover", "top3"): target & top3,
    }
    unpack = lambda names: F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(k).alias("key"), F.col(f"c{i}").alias("n")) for i, (p, k) in enumerate(names)]))
    totals = df.groupBy(run, cond).agg(*[count_where(c).alias(f"c{i}") for i, c in enumerate(parts.values())]).select(run, cond, unpack(parts))
    hits = {"rows": F.lit(True), "first_intent": a_ok & hit(a), "first_exact": a_ok & hit(a) & slot_a, "second_intent": b_ok & hit(b), "second_exact": b_ok & hit(b) & slot_b}
    per = df.where(target).groupBy(run, cond, source).agg(*[count_where(c).alias(x) for x, c in hits.items()])
    sources = per.select(run, cond, F.inline(F.array(*[F.struct(F.lit("source").alias("part"), F.concat(F.col(source), F.lit(f"|{x}")).alias("key"), F.col(x).alias("n")) for x in hits])))
    told = df.where(target).join(pairs, label)
    said = lambda p: F.when(p.isNull(), "reject").when(p == F.col(label), "own").when(p == F.col("other"), "other").otherwise("else")
    mix = F.inline(F.array(*[F.struct(F.lit(f"pairs_{n}").alias("part"), F.concat(F.col(label), F.lit("|"), said(F.when(ok, F.col(p)))).alias("key")) for n, p, ok in (("first", a, a_ok), ("second", b, b_ok))]))
    confused = told.select(run, cond, mix).groupBy(run, cond, "part", "key").agg(F.count(F.lit(1)).alias("n"))
    return totals.unionByName(sources).unionByName(confused)


def registered_rules(df: DataFrame, model: str, reference: str, out: DataFrame, key: str, tag: str, source: str, own: str, persona: str, target: Column, right: Column, ok: Column, silence: Column | None = None) -> DataFrame:
    """DR9: rules A to D of each model, rows of `out` left out. A: at least 96.5 % of the clean test's own targets right; B: 90 % of the perturbed ones (fail where not scored); C: 93 % of the old test's targets without personas (n/a where not scored, and then no verdict); D: no babble of its own accepted, and no more silence than the reference model does; silence: rows of the sources that hold it, of that bucket if not given. A model without the clean test has no row."""
    x = df.join(out.select(key).distinct(), key, "left_anti").withColumn("_own", F.col(source) == own)
    c, t = F.col, F.col(tag)
    clean, old = t == "clean", t == "old"
    babble, silence = F.col("bucket") == "babble", F.col("bucket") == "silence" if silence is None else F.coalesce(silence, F.lit(False))
    cells = {"a": clean & c("_own") & target, "b": (t == "noisy") & c("_own") & target, "c": old & target & (c(source) != persona)}
    g = x.groupBy(model).agg(
        count_where(clean).alias("scored"), count_where(old).alias("old_rows"), *[e.alias(f"{k}_{s}") for k, w in cells.items() for s, e in (("n", count_where(w)), ("k", count_where(w & right & ok)))],
        count_where(t == "noisy").alias("noisy_rows"), count_where(clean & c("_own") & babble & ok).alias("babble_fa"), count_where(clean & silence & ok).alias("silence_fa"),
    ).where("scored > 0")
    ref = g.agg(F.coalesce(F.max(F.when(c(model) == reference, c("silence_fa"))), F.lit(0)).alias("ref_silence"))
    rules = {"A": 1000 * c("a_k") >= 965 * c("a_n"), "B": (c("noisy_rows") > 0) & (100 * c("b_k") >= 90 * c("b_n")), "C": 100 * c("c_k") >= 93 * c("c_n"), "D": (c("babble_fa") == 0) & (c("silence_fa") <= c("ref_silence"))}
    has_c = c("old_rows") > 0
    say = lambda ok_: F.when(ok_, "PASS").otherwise("FAIL")
    every = rules["A"] & rules["B"] & rules["C"] & rules["D"]
    return g.crossJoin(ref).select(model, *[(F.when(has_c, say(r)).otherwise("n/a") if n == "C" else say(r)).alias(n) for n, r in rules.items()], F.when(has_c, say(every)).otherwise("n/a").alias("verdict"))


def two_conditions(df: DataFrame, threshold: DataFrame, cond: str, target: Column, right: Column) -> DataFrame:
    """DR10: test rows of both conditions at the one threshold."""
    x = df.crossJoin(threshold.select(F.col("threshold").alias("_t")))
    ok = F.coalesce(F.col("intent").isNotNull() & (F.col("confidence") >= F.col("_t")), F.lit(False))
    return x.groupBy(cond).agg(F.max("_t").alias("threshold"), count_where(target).alias("n"), ratio0(count_where(target & ok & right), count_where(target)).alias("accuracy"), ratio0(count_where(~target & ok), count_where(~target)).alias("false_rate"))


def ghost_probe(df: DataFrame, by: str, base_ok: Column, new_ok: Column) -> DataFrame:
    """DR11: false accepts of baseline and candidate by source, upper bounds, and whether the candidate has no more."""
    n, b, w = F.count(F.lit(1)), count_where(base_ok), count_where(new_ok)
    return df.groupBy(by).agg(n.alias("n"), b.alias("base_fa"), w.alias("new_fa"), wilson(w, n, True).alias("upper"), (w <= b).alias("ok"))


def cell_gate(out: DataFrame, base: str, new: str, ghosts: DataFrame) -> DataFrame:
    """DR12: out: outcomes by split and cond; ghosts: b, s. One row: fa_ok (test false accepts no more than the baseline's in both conditions), exact_ok (no cell with fewer exact rows), fails (label@split/cond of 50 targets that lose over 3 points), p1 (all of these) and p2 (no more ghosts accepted)."""
    sides = {"b": base, "s": new}
    cells = side_by_side(config_metrics(out, ["split", "cond"]), ["split", "cond"], sides, ["exact", "fa"]).where("split IN ('val', 'test')")
    c = F.col
    fa_ok = F.coalesce(F.bool_and(F.when(c("split") == "test", c("s_fa") <= c("b_fa"))), F.lit(True))
    p = cells.agg(fa_ok.alias("fa_ok"), F.coalesce(F.bool_and(c("s_exact") >= c("b_exact")), F.lit(True)).alias("exact_ok"))
    labels = side_by_side(label_metrics(out, ["split", "cond"]), ["split", "cond", "label"], sides, ["n", "exact"]).where((c("split").isin("val", "test")) & (c("b_n") >= LABEL_LEAST))
    lost = 100 * (c("s_exact") - c("b_exact")) < -LABEL_LOSS_PERCENT * c("b_n")
    fails = labels.where(lost).agg(F.array_join(F.array_sort(F.collect_list(F.concat("label", F.lit("@"), "split", F.lit("/"), "cond"))), ",").alias("fails"))
    return p.crossJoin(fails).crossJoin(ghosts).select("fa_ok", "exact_ok", "fails", (c("fa_ok") & c("exact_ok") & (c("fails") == "")).alias("p1"), (c("s") <= c("b")).alias("p2"))


def budget_cells(score: str, base_ok: Column, key: Column, where: Column) -> list[Column]:
    """Cells of score_counts for budget_tau: rows to reject by condition, and clean targets; keys end in `key`."""
    reject, target = F.col("bucket").isin(*REJECT), (F.col("bucket") == TARGET) & (F.col("cond") == "clean")
    shown = F.when(F.col("intent").isNotNull(), F.col(score))  # rows without an intent are never accepted, but count in the budget's key
    place = lambda kind, *more: F.concat_ws("|", F.lit(kind), key, *more)
    return [_cell(place("reject", F.col("cond")), False, shown, base_ok, F.coalesce(where & reject, F.lit(False))), _cell(place("target"), False, F.col(score), F.lit(False), F.coalesce(where & target, F.lit(False)))]


def budget_tau(counts: DataFrame) -> DataFrame:
    """key, tau: the smallest score of clean targets at which no condition has more false accepts than the baseline, from counts of budget_cells."""
    c = F.col
    part = counts.select("*", F.split("at", "[|]").alias("_at")).select("*", F.get("_at", F.lit(0)).alias("_kind"), F.get("_at", F.lit(1)).alias("key"))
    reject = part.where(c("_kind") == "reject")
    want = reject.groupBy("at").agg((F.sum("base") + 1).alias("n"))
    # scores above the (budget + 1)-th largest one are within the budget
    edge = iso_threshold(reject, "at", "score", want, c("n")).withColumn("key", F.get(F.split("at", "[|]"), F.lit(1))).groupBy("key").agg(F.max("tau").alias("edge"))
    target = part.where((c("_kind") == "target") & c("score").isNotNull()).join(edge, "key", "left")
    return target.where(c("score") > F.coalesce("edge", F.lit(float("-inf")))).groupBy("key").agg(F.min("score").alias("tau"))


def stability(out: DataFrame, taus: DataFrame) -> DataFrame:
    """DR13: out: outcomes by half and cond, config s applying the other half's threshold and b the baseline; taus: half, tau. tau0, tau1, S1 (gap at most 0.30), S2 (held-out false accepts no more than the baseline's in every half and condition), S3 (pooled exact rows within half a point in both conditions) and the verdict."""
    c = F.col
    cells = side_by_side(config_metrics(out, ["half", "cond"]), ["half", "cond"], {"b": "b", "s": "s"}, ["n_targets", "exact", "fa"])
    s2 = cells.agg(F.coalesce(F.bool_and(c("s_fa") <= c("b_fa")), F.lit(False)).alias("s2"))
    pool = by_condition(cells, [], ["b_n_targets", "b_exact", "s_exact"]).select((exact_floor("clean") & exact_floor("noisy")).alias("s3"))
    t = taus.agg(F.max(F.when(c("half") == 0, c("tau"))).alias("tau0"), F.max(F.when(c("half") == 1, c("tau"))).alias("tau1"))
    x = t.crossJoin(s2).crossJoin(pool).withColumn("s1", F.coalesce(F.abs(c("tau0") - c("tau1")) <= MOST_GAP, F.lit(False)))
    return x.select("tau0", "tau1", "s1", "s2", "s3", F.when(c("s1") & c("s2") & c("s3"), "STABLE").otherwise("UNSTABLE").alias("verdict"))


def curve_taus(low: Column, high: Column, steps: int = 8) -> Column:
    """DR14: `steps` thresholds evenly from low to high - 0.30, then high."""
    return F.concat(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: low + (high - MOST_GAP - low) * i / (steps - 1)), F.array(high))


def loosening(row: DataFrame, labels: DataFrame, ghosts: DataFrame) -> DataFrame:
    """DR14: row: split and condition_side_value; labels: split, label; ghosts: b, s. L1 (test false accepts no more than the baseline's), L2 (ghosts likewise), L3 (no split and condition with fewer exact rows), L4 (labels within 3 points), failing (label@split/cond) and the verdict."""
    c = F.col
    l1 = F.coalesce(F.bool_and(F.when(c("split") == "test", (c("clean_s_fa") <= c("clean_b_fa")) & (c("noisy_s_fa") <= c("noisy_b_fa")))), F.lit(True))
    l3 = F.coalesce(F.bool_and((c("clean_s_exact") >= c("clean_b_exact")) & (c("noisy_s_exact") >= c("noisy_b_exact"))), F.lit(True))
    lost = lambda x: 100 * (c(f"{x}_s_exact") - c(f"{x}_b_exact")) < -LABEL_LOSS_PERCENT * c("clean_n")
    at = F.array(*[F.when(lost(x), F.concat("label", F.lit("@"), "split", F.lit(f"/{x}"))) for x in CONDITIONS])
    places = labels.where(c("clean_n") >= LABEL_LEAST).select(F.explode(at).alias("at")).where(c("at").isNotNull())
    failing = places.agg(F.array_join(F.array_sort(F.collect_list("at")), ",").alias("failing"))
    x = row.agg(l1.alias("l1"), l3.alias("l3")).crossJoin(ghosts.select((c("s") <= c("b")).alias("l2"))).crossJoin(failing)
    l4 = c("failing") == ""
    return x.select("l1", "l2", "l3", l4.alias("l4"), "failing", F.when(c("l1") & c("l2") & c("l3") & l4, "PASS").otherwise("FAIL").alias("verdict"))


def loosening_curve(cube: DataFrame, keys: list[str], taus: Column, met: str, known: Column, ghost: Column, watched: tuple[str, ...] = ()) -> DataFrame:
    """DR14: keys, step, tau, exact and fa of the known rows at each of `taus`, exact rows of the watched labels, and false accepts of the ghost rows, of all keys. cube has, in `met`, which of the thresholds a row's score reaches."""
    c = F.col
    long = cube.select(*keys, "bucket", "label", "intent", "n", known.alias("_known"), ghost.alias("_ghost"), F.posexplode(F.arrays_zip(taus.alias("tau"), c(met).alias("met"))).alias("step", "x"))
    hit = c("x.met")
    per = long.where("_known").groupBy(*keys, "step").agg(F.max("x.tau").alias("tau"), _sum("n", hit & _right()).alias("exact"), _sum("n", hit & c("bucket").isin(*REJECT)).alias("fa"), *[_sum("n", hit & _right() & (c("label") == w)).alias(f"exact_{w}") for w in watched])
    ghosts = long.groupBy("step").agg(_sum("n", hit & c("_ghost")).alias("ghost_fa"))
    return per.join(ghosts, "step")


def promotion(row: DataFrame) -> DataFrame:
    """DR15: triggers no more than baseline, no accepts of negatives, recall within one point, no drops."""
    c = F.col
    return criteria(row, {"triggers": c("triggers") <= c("base_triggers"), "accepts": c("accepts") == 0, "recall": 100 * (c("recall_k") - c("base_k")) >= -c("n"), "drops": c("drops") == 0})
