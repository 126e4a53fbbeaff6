"""Evaluation analytics over score rows: one pass of conditional aggregates, rates last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import accepted, count_where, margin_ok, ratio, ratio0, wilson
from .ranks import at_ranks, running, with_span_slot


def N(name: str) -> Column:
    """Row count under a name."""
    return F.count(F.lit(1)).alias(name)


def counts(df: DataFrame, groupings: list[list[str]]) -> DataFrame:
    """AG1: row counts for several groupings in one pass; `level` numbers them, columns outside a grouping are null."""
    cols = list(dict.fromkeys(c for g in groupings for c in g))
    sets = F.array(*[F.struct(F.lit(n).alias("level"), *[(F.col(c) if c in g else F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in cols]) for n, g in enumerate(groupings)])
    return df.select(F.explode(sets).alias("g")).groupBy("g.level", *[F.col(f"g.{c}").alias(c) for c in cols]).agg(N("n"))


def deficit(df: DataFrame, by: str, have: Column) -> DataFrame:
    """AG2: rows outside the predicate less rows inside, at least 0."""
    return df.groupBy(by).agg(F.greatest(count_where(~have) - count_where(have), F.lit(0)).alias("deficit"))


def share(df: DataFrame, by: str, what: Column) -> DataFrame:
    """AG3, AG4: share of rows with a property, 0 when empty."""
    return df.groupBy(by).agg(N("n"), ratio0(count_where(what), F.count(F.lit(1))).alias("share"))


def projection(df: DataFrame, model: str, seconds: str, ok: Column, deficits: DataFrame, overgen: float, workers: int) -> DataFrame:
    """AG5: mean seconds of ok jobs, jobs to make up a deficit, hours on some workers."""
    mean = df.where(ok).groupBy(model).agg(F.avg(seconds).alias("mean_s"))
    jobs = F.floor(F.col("deficit") * overgen + 0.999)
    return deficits.join(mean, model).select(model, "mean_s", jobs.alias("jobs"), (jobs * F.col("mean_s") / 3600 / workers).alias("hours"))


def confusion(df: DataFrame, label: str, predicted: Column) -> DataFrame:
    """AG6: counts of label and prediction, null predictions as REJECTED."""
    return df.groupBy(F.col(label).alias("label"), F.coalesce(predicted, F.lit("REJECTED")).alias("predicted")).agg(N("n"))


def false_accepts(df: DataFrame, by: str, ok: Column, ok_margin: Column) -> DataFrame:
    """AG7: accepted rows by bucket, with and without the margin; rates null when empty."""
    n = F.count(F.lit(1))
    return df.groupBy(by).agg(N("n"), count_where(ok).alias("accepted"), ratio(count_where(ok), n).alias("rate"), count_where(ok & ok_margin).alias("gated"), ratio(count_where(ok & ok_margin), n).alias("gated_rate"))


def sweep(df: DataFrame, thresholds: list[float], target: Column, intent: str = "intent", confidence: str = "confidence") -> DataFrame:
    """AG8, JN14: accept rates of target and other rows, and Youden J, at each threshold: one count a score bucket, then sums over the grid only."""
    grid = sorted(thresholds)
    step = sum((F.when(F.col(confidence) >= t, 1).otherwise(0) for t in grid), F.lit(0))
    reach = F.when(F.col(intent).isNull() | F.col(confidence).isNull(), 0).otherwise(step)
    per = df.groupBy(reach.alias("reach")).agg(count_where(target).alias("t"), count_where(~target).alias("f"))
    cut = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(grid)], "step int, threshold double")
    both = F.broadcast(cut).crossJoin(per).groupBy("threshold").agg(
        F.sum(F.when(F.col("reach") >= F.col("step"), F.col("t")).otherwise(0)).alias("ta"), F.sum(F.when(F.col("reach") >= F.col("step"), F.col("f")).otherwise(0)).alias("fa"), F.sum("t").alias("nt"), F.sum("f").alias("nf")
    )
    tar, far = ratio0(F.col("ta"), F.col("nt")), ratio0(F.col("fa"), F.col("nf"))
    return both.select("threshold", "ta", "fa", tar.alias("target_rate"), far.alias("false_rate"), (tar - far).alias("j"))


def margin_sweep(df: DataFrame, threshold: float, margins: list[float], target: Column) -> DataFrame:
    """AG9, AG28, AG30: rates under threshold and margin, and the share of confident targets that the margin rejects. Refuses rows gated before."""
    if "gated" in df.columns:
        raise ValueError("rows are gated already")
    grid = df.sparkSession.createDataFrame([(float(m),) for m in margins], "margin double")
    ok = accepted(F.col("intent"), F.col("confidence"), threshold)
    met = margin_ok(F.col("gap"), F.col("margin"))
    small = df.select(target.alias("t"), ok.alias("ok"), "gap").groupBy("t", "ok", "gap").agg(N("n"))  # rows meet the grid as counts
    j = small.crossJoin(F.broadcast(grid))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    t, o = F.col("t"), F.col("ok")
    return j.groupBy("margin").agg(
        ratio0(total(t & o & met), total(t)).alias("target_rate"), ratio0(total(~t & o & met), total(~t)).alias("false_rate"), ratio0(total(t & o & ~met), total(t & o)).alias("margin_rejects")
    )


def exhaustive(df: DataFrame, score: str, target: Column) -> DataFrame:
    """AG10: recall and false accepts at each distinct score. Scores are counted and summed within slots of the score's span; only slot totals are summed across."""
    per = df.where(F.col(score).isNotNull()).groupBy(score).agg(count_where(target).alias("t"), count_where(~target).alias("f"))
    x = running(with_span_slot(per, [], score), [], [F.desc(score)], "_slot", {"bt": F.col("t"), "bf": F.col("f")}, descending=True)
    return x.select(score, (F.col("t") + F.col("bt")).alias("hits"), (F.col("f") + F.col("bf")).alias("false_accepts"))


def breakdown(df: DataFrame, by: str, ok: Column, exact: Column, group: str, train_groups: DataFrame) -> DataFrame:
    """AG11: n, accepted, exact with rate and interval, distinct groups and how many of them train has."""
    known = train_groups.select(group).distinct().withColumn("_t", F.lit(True))
    j = df.join(known, group, "left")
    k, n = count_where(ok & exact), F.count(F.lit(1))
    return j.groupBy(by).agg(
        N("n"), count_where(ok).alias("accepted"), k.alias("exact"), ratio(k, n).alias("rate"), wilson(k, n, False).alias("low"), wilson(k, n, True).alias("high"), F.count_distinct(group).alias("groups"), F.count_distinct(F.when(F.col("_t"), F.col(group))).alias("in_train")
    )


def slot_accuracy(df: DataFrame, ok: Column, truth: str, predicted: str, slot: str) -> DataFrame:
    """AG13: accuracy by slot name given a correct intent; truths that are null count as unparseable."""
    right = F.lower(truth) == F.lower(predicted)
    n = count_where(F.col(truth).isNotNull())
    return df.where(ok).groupBy(slot).agg(n.alias("n"), count_where(right).alias("right"), ratio(count_where(right), n).alias("rate"), count_where(F.col(truth).isNull()).alias("unparseable"))


def headline(df: DataFrame, ok: Column, target: Column, oos: Column, right_intent: Column, right_slot: Column, human: Column) -> DataFrame:
    """AG14: the metric block in one pass."""
    full = ok & right_intent & right_slot
    r = lambda a, b: ratio(count_where(a), count_where(b))
    return df.agg(
        count_where(target).alias("targets"), r(target & ok & right_intent, target).alias("command_accuracy"), r(target & full, target).alias("accuracy"), r(target & full, target & ok & right_intent).alias("slot_accuracy"),
        r(target & ~ok, target).alias("false_reject"), r(oos & ok, oos).alias("oos_accept"), r(~target & ~oos & ok, ~target & ~oos).alias("misfire"), r(target & human & full, target & human).alias("human"), r(target & ~human & full, target & ~human).alias("synthetic"),
    )


def balanced(df: DataFrame, variation: str, right: Column, oos: Column, ok: Column) -> DataFrame:
    """AG15: mean recall over variations, rejection of out-of-scope rows as one more class."""
    cls = F.when(oos, F.lit("oos")).otherwise(F.col(variation).cast("string"))
    per = df.select(cls.alias("cls"), F.when(oos, ~ok).otherwise(right).cast("int").alias("hit"))
    return per.groupBy("cls").agg(F.avg("hit").alias("recall")).agg(N("classes"), F.avg("recall").alias("balanced_accuracy"))


def by_source(df: DataFrame, by: str, scorers: dict[str, Column]) -> DataFrame:
    """AG16: rows and hits of several scorers by source."""
    return df.groupBy(by).agg(N("n"), *[count_where(c).alias(n) for n, c in scorers.items()])


def agreement(df: DataFrame, a: Column, b: Column, a_ok: Column, b_ok: Column, in_top3: Column) -> DataFrame:
    """AG17: how far two scorers agree on accepted rows, and B's top 1 and top 3 on rows that A accepts."""
    both = a_ok & b_ok
    return df.agg(count_where(both).alias("both"), count_where(both & (a == b)).alias("same"), count_where(a_ok).alias("a_rows"), count_where(a_ok & (a == b)).alias("top1"), count_where(a_ok & in_top3).alias("top3"))


def confusable(df: DataFrame, pairs: DataFrame, label: str, predicted: Column) -> DataFrame:
    """AG18: pairs: label, other. Counts of right, other member, anything else and rejected."""
    p = predicted
    kind = F.when(p.isNull(), "reject").when(p == F.col(label), "member").when(p == F.col("other"), "other").otherwise("else")
    return df.join(pairs, label).withColumn("kind_", kind).groupBy(label, "other").agg(*[count_where(F.col("kind_") == k).alias(f"n_{k}") for k in ("member", "other", "else", "reject")])


def complementarity(df: DataFrame, a_right: Column, b_right: Column, who: Column) -> DataFrame:
    """AG19: which of two scorers is right, by who answered."""
    kind = F.when(a_right & b_right, "both").when(a_right, "only_a").when(b_right, "only_b").otherwise("neither")
    return df.groupBy(kind.alias("kind"), F.coalesce(who, F.lit("none")).alias("answered_by")).agg(N("n"))


def precision_recall(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """AG20: precision, recall, F1 and support per class, 0 on empty denominators."""
    cm = df.groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(N("n"))
    both = cm.select(F.explode(F.array(F.struct(F.col("l").alias("cls"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("pred")), F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("pred")))).alias("x"))
    g = both.where("x.cls IS NOT NULL").groupBy("x.cls").agg(F.sum("x.tp").alias("tp"), F.sum("x.sup").alias("support"), F.sum("x.pred").alias("predicted"))
    p, r = ratio0(F.col("tp"), F.col("predicted")), ratio0(F.col("tp"), F.col("support"))
    return g.select("cls", "support", "tp", p.alias("precision"), r.alias("recall"), ratio0(2 * p * r, p + r).alias("f1"))


def recall_by(df: DataFrame, by: str, member: Column, hit: Column) -> DataFrame:
    """AG21, AG24: recall of one class, or reject rate of a phrase set, by subgroup."""
    return df.where(member).groupBy(by).agg(N("n"), F.avg(hit.cast("int")).alias("recall"))


def prefix_far(df: DataFrame, prefix: str, ok: Column, intent: str) -> DataFrame:
    """AG22, AG25: accepted rows by prefix (or competitor), with the distribution of intents as 'intent:n' in order."""
    per = df.groupBy(prefix, F.when(ok, F.col(intent)).alias("_i")).agg(N("_n"))
    return per.groupBy(prefix).agg(
        F.sum("_n").alias("n"), F.coalesce(F.sum(F.when(F.col("_i").isNotNull(), F.col("_n"))), F.lit(0)).alias("accepted"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), F.concat_ws(":", "_i", F.col("_n").cast("string"))))), ",").alias("intents"),
    )


def ordered_rates(df: DataFrame, key: str, ok: Column, order: list[str]) -> DataFrame:
    """AG23: rates by key in display order, unknown keys after the known ones, nulls as <missing>."""
    known = F.array(*[F.lit(o) for o in order])
    place = F.array_position(known, F.col("key"))
    per = df.groupBy(F.coalesce(F.col(key), F.lit("<missing>")).alias("key")).agg(N("n"), F.avg(F.coalesce(ok, F.lit(False)).cast("int")).alias("rate"))
    return per.withColumn("place", F.when(place == 0, len(order) + 1).otherwise(place).cast("int"))


def bucket_of(c: Column, edges: list[float]) -> Column:
    """AG26: '[a,b)' with closed left edges, '>=last', '<first', 'unknown' for null."""
    out = F.when(c.isNull(), "unknown").when(c < edges[0], f"<{edges[0]:g}")
    for a, b in zip(edges, edges[1:], strict=False):
        out = out.when(c < b, f"[{a:g},{b:g})")
    return out.otherwise(f">={edges[-1]:g}")


def merge_blocks(blocks: list[DataFrame], by: list[str], sums: list[str], rates: dict[str, tuple[str, str]]) -> DataFrame:
    """AG31: blocks of counts summed, rates computed from the sums."""
    g = reduce(DataFrame.unionByName, blocks).groupBy(*by).agg(*[F.sum(s).alias(s) for s in sums])
    return g.select(*by, *sums, *[ratio0(F.col(a), F.col(b)).alias(r) for r, (a, b) in rates.items()])


def latency(df: DataFrame, by: str, value: str) -> DataFrame:
    """AG32, AG34: mean, p50 and p95 by linear interpolation, rounded to 3."""
    q = lambda p: F.round(F.percentile(value, p), 3)
    return df.groupBy(by).agg(N("n"), F.round(F.avg(value), 3).alias("mean"), q(0.5).alias("p50"), q(0.95).alias("p95"))


def nearest_rank(df: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """AG33: the value at sorted place round(p * (n - 1)), halves to even; nulls don't count. Found by selection, so no group is gathered or sorted."""
    want = df.where(F.col(value).isNotNull()).groupBy(by).agg(F.bround(p * (F.count(F.lit(1)) - 1)).cast("long").alias("rank"))
    return at_ranks(df, by, value, want).select(by, value)


def concentration(df: DataFrame, by: str, group: str) -> DataFrame:
    """AG35: the largest group's share of each class, noted at 5 percent."""
    per = df.groupBy(by, group).agg(N("_n"))
    top = F.max(F.struct("_n", group))
    return per.groupBy(by).agg(F.sum("_n").alias("n"), top.alias("_m")).select(by, "n", F.col(f"_m.{group}").alias("top_group"), (F.col("_m._n") / F.col("n")).alias("share"), (F.col("_m._n") * 100 >= F.col("n") * 5).alias("noted"))


def imbalance(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """AG36: class counts before and after with the ratio of largest to smallest."""
    a, b = before.groupBy(label).agg(N("before")), after.groupBy(label).agg(N("after"))
    j = a.join(b, label, "full").na.fill(0, ["before", "after"])
    r = j.agg(ratio(F.max("before"), F.min("before")).alias("ratio_before"), ratio(F.max("after"), F.nullif(F.min("after"), F.lit(0))).alias("ratio_after"))
    return j.crossJoin(r)


def plan_audit(df: DataFrame, cls: str, steps: list[str]) -> DataFrame:
    """AG37: rows of a class, rows with each step, rows with none."""
    return df.groupBy(cls).agg(N("n"), *[F.count(s).alias(s) for s in steps], F.count_if(reduce(lambda a, b: a & b, [F.col(s).isNull() for s in steps])).alias("none"))


def joint_exact(df: DataFrame, intent_ok: Column, slot_truth: str, slot_ok: Column) -> DataFrame:
    """AG38: joint, intent and slot accuracy; rows without a slot target are not in the slot denominator."""
    has = F.col(slot_truth).isNotNull()
    n = F.count(F.lit(1))
    return df.agg(N("n"), ratio(count_where(intent_ok), n).alias("intent"), ratio(count_where(has & slot_ok), count_where(has)).alias("slot"), ratio(count_where(intent_ok & (~has | slot_ok)), n).alias("joint"))


def worst(df: DataFrame, by: str, right: Column, k: int) -> DataFrame:
    """AG39: the k classes of lowest accuracy, ties by name."""
    return df.groupBy(by).agg(N("n"), F.avg(F.coalesce(right, F.lit(False)).cast("int")).alias("accuracy")).orderBy("accuracy", by).limit(k)


def score_quantiles(df: DataFrame, cls: str, length: Column, score: str, t: float) -> DataFrame:
    """AG40: quantiles of a score by class and length band, and the share under a threshold."""
    band = F.when(length <= 6, "<=6").when(length <= 10, "7-10").when(length <= 15, "11-15").otherwise("16+")
    q = lambda p: F.round(F.percentile(score, p), 6)
    return df.where(F.col(score).isNotNull()).groupBy(cls, band.alias("band")).agg(N("n"), q(0.05).alias("p05"), q(0.1).alias("p10"), q(0.5).alias("p50"), F.avg((F.col(score) < t).cast("int")).alias("under"))


def overlap_audit(a: DataFrame, b: DataFrame, group: str, split: str) -> DataFrame:
    """AG41: groups of two datasets with the splits that hold them."""
    s = lambda df, n: df.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias(n))
    return s(a, "splits_a").join(s(b, "splits_b"), group)


def loudest_level(df: DataFrame, by: str, power: str, share: float = 0.1) -> DataFrame:
    """AG42: mean power of the loudest share of frames, in dB: the least power among them is selected, larger ones are summed, and it fills up the rest."""
    sizes = df.where(F.col(power).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.greatest(F.floor(F.col("_n") * share), F.lit(1)))
    edge = at_ranks(df, by, power, sizes.select(by, (F.col("_n") - F.col("_k")).alias("rank"))).select(F.struct(by).alias("_in"), F.col(power).alias("_edge"))
    over = df.join(edge, F.struct(by) == F.col("_in")).groupBy(by, "_edge").agg(F.count_if(F.col(power) > F.col("_edge")).alias("_m"), F.coalesce(F.sum(F.when(F.col(power) > F.col("_edge"), F.col(power))), F.lit(0.0)).alias("_s"))
    x = over.join(sizes.select(F.struct(by).alias("_in"), "_k"), F.struct(by) == F.col("_in"))
    return x.select(by, (10 * F.log10((F.col("_s") + (F.col("_k") - F.col("_m")) * F.col("_edge")) / F.col("_k"))).alias("db"))


def log_counts(lines: DataFrame, file: str, line: str, patterns: dict[str, str]) -> DataFrame:
    """AG43: lines of each file that match each pattern."""
    return lines.groupBy(file).agg(N("n_lines"), *[F.count_if(F.col(line).rlike(p)).alias(n) for n, p in patterns.items()])
