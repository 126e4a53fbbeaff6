"""Splits, quotas, samples and plans. Every draw is a hash of seed, purpose and key; ranks come from counted slots, sequential rules fold sorted group sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seeding import draw, number, permuted, uniform
from .folds import fold_sorted
from .ranks import SLOTS, digest_slot, ranked, ranked_by_number, running, with_span_slot


class Shortage(ValueError):
    """A quota cannot be met."""


def largest_remainder(df: DataFrame, by: list[str], key: str, weight: str, total: Column, tie_desc: bool = False) -> DataFrame:
    """SP1: integers `n` that sum exactly to total within each `by`, in proportion to weights; leftovers to the largest remainders, ties by key."""
    part = Window.partitionBy(*by)
    w, t = F.col(weight).cast("long"), total.cast("long")
    s = F.sum(w).over(part)
    x = df.withColumn("_s", s).withColumn("_t", t).withColumn("_m", F.pmod(F.col("_t") * w, F.col("_s")))
    x = x.withColumn("_b", ((F.col("_t") * w - F.col("_m")) / F.col("_s")).cast("long"))
    order = Window.partitionBy(*by).orderBy(F.desc("_m"), F.desc(key) if tie_desc else F.asc(key))
    x = x.withColumn("_r", F.row_number().over(order)).withColumn("_left", F.col("_t") - F.sum("_b").over(part))
    return x.withColumn("n", F.col("_b") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).drop("_s", "_t", "_b", "_m", "_r", "_left")


def allocation(pools: DataFrame, share: float, residual: dict[str, int]) -> DataFrame:
    """SP2: pools: bucket, label, n. Rows a class: the smallest target pool; whole set: targets / share, halves to even; the rest by the residual weights to the other buckets and by pool size to their labels."""
    t = pools.where("bucket = 'target_commands'").agg(F.min("n").alias("each"), F.count(F.lit(1)).alias("classes"))
    target = F.col("each") * F.col("classes")
    whole = t.select("each", (F.bround(target / share) - target).cast("long").alias("rest"))
    names = F.create_map(*[F.lit(x) for kv in residual.items() for x in kv])
    buckets = pools.where(F.col("bucket") != "target_commands").select("bucket").distinct().withColumn("weight", names[F.col("bucket")])
    per = largest_remainder(buckets.crossJoin(whole).withColumn("all", F.lit(1)), ["all"], "bucket", "weight", F.col("rest")).select("bucket", F.col("n").alias("quota"))
    others = largest_remainder(pools.join(per, "bucket").withColumnRenamed("n", "pool"), ["bucket"], "label", "pool", F.col("quota")).select("bucket", "label", "n")
    targets = pools.where("bucket = 'target_commands'").select("bucket", "label").crossJoin(whole).select("bucket", "label", F.col("each").alias("n"))
    return targets.unionByName(others)


def exact_split(df: DataFrame, by: str, key: str, seed: int, parts: list[tuple[str, int]]) -> DataFrame:
    """SP3: rows of a stratum in seeded order, split exactly by largest remainder; ties go to earlier parts."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    dim = df.sparkSession.createDataFrame([(i, n, w) for i, (n, w) in enumerate(parts)], "place int, split string, weight int")
    quota = largest_remainder(sizes.crossJoin(dim), [by], "place", "weight", F.col("total"))
    upto = quota.withColumn("upto", F.sum("n").over(Window.partitionBy(by).orderBy("place"))).select(by, "split", (F.col("upto") - F.col("n")).alias("lo"), F.col("upto").alias("hi"))
    x = ranked(df, [by], draw(seed, "split", F.col(key)))
    return x.join(upto, by).where("_r >= lo AND _r < hi").drop("_r", "lo", "hi")


def group_split(sizes: DataFrame, family: str, group: str, n: str, seed: int, parts: dict[str, int]) -> DataFrame:
    """SP4: groups of a family in seeded order, each to the part that lacks most (parts in tenths), ties to the larger name. A fold over the groups' sizes."""
    names = sorted(parts)
    total = sizes.groupBy(family).agg(F.sum(n).cast("long").alias("_total"))
    x = sizes.join(total, family).select(family, group, F.col(n).cast("long").alias("_n"), "_total", draw(seed, "group", F.col(family), F.col(group)).alias("_h"))

    def step(have, row):
        to = max(names, key=lambda p: (parts[p] * row[3] - 10 * have[p], p))
        return have | {to: have[to] + row[2]}, [(row[0], row[1], to)]

    kinds = [sizes.schema[c].dataType.simpleString() for c in (family, group)]
    return fold_sorted(x, [family], ["_h", group], f"`{family}` {kinds[0]}, `{group}` {kinds[1]}, split string", lambda: dict.fromkeys(names, 0), step)


def pinned_split(sizes: DataFrame, labels: list[str], parts: list[tuple[str, int]]) -> DataFrame:
    """SP5: sizes: label, grp, n, a row for each label and group. Label by label, groups largest first (ties by name) to the part that lacks most, ties to the first part; a group that an earlier label placed stays there and counts before the others. parts in tenths.

    One fold: a group is pinned wherever it has an earlier label, so the order of rows is known beforehand, and the state keeps the part of a group only from its first label to its last. Labels that no chain of shared groups links are folded side by side.
    """
    names = [p for p, _ in parts]
    order = sizes.sparkSession.createDataFrame([(label, i) for i, label in enumerate(labels)], "label string, at int")
    x = sizes.select("label", F.col("grp").cast("string").alias("grp"), F.col("n").cast("long").alias("n")).join(order, "label")
    total = x.groupBy("label").agg(F.sum("n").alias("total"))
    life = x.groupBy("grp").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    x = x.join(life, x["grp"].eqNullSafe(life["grp"])).drop(life["grp"]).join(total, "label")
    chain = list(range(len(labels)))  # of each label the least one linked to it
    for first, at in sorted(map(tuple, x.where("at > first").select("first", "at").distinct().collect())):  # at most labels squared
        low, high = sorted((chain[first], chain[at]))
        chain = [low if c == high else c for c in chain]
    linked = F.get(F.array(*map(F.lit, chain)), F.col("at"))
    x = x.select(linked.alias("chain"), "at", (F.col("at") == F.col("first")).alias("free"), (-F.col("n")).alias("less"), "grp", "label", "total", (F.col("at") < F.col("last")).alias("again"))

    def step(state, row):
        _, at, free, less, grp, label, total, again = row
        now, have, pins = state
        have = have if now == at else [0] * len(parts)
        i = max(range(len(parts)), key=lambda i: (parts[i][1] * total - 10 * have[i], -i)) if free else pins[grp]
        if again:
            pins[grp] = i
        else:
            pins.pop(grp, None)
        have[i] -= less
        return (at, have, pins), [(label, grp, names[i])]

    return fold_sorted(x, ["chain"], ["at", "free", "less", "grp"], "label string, grp string, split string", lambda: (None, [], {}), step)


def majority(df: DataFrame, key: str, split: str, priority: list[str] | None = None) -> DataFrame:
    """SP6: the most frequent split of a key; ties to the larger name, or to the earlier one in priority."""
    n = df.groupBy(key, split).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.col(split) if priority is None else F.lit(len(priority)) - F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(split))
    return n.groupBy(key).agg(F.max_by(split, F.struct("_n", rank.alias("_p"))).alias("majority"))


def repair(df: DataFrame, key: str, split: str, priority: list[str], listed: Column) -> DataFrame:
    """SP7: listed groups that span splits move to their majority split; blank keys stay."""
    m = majority(df.where(listed & F.col(key).isNotNull()), key, split, priority)
    return df.join(m, key, "left").withColumn("fixed", F.when(listed, F.coalesce("majority", F.col(split))).otherwise(F.col(split))).drop("majority")


def hash_split(key: Column, seed: int, tenths: int = 1) -> Column:
    """SP8: val for some tenths of keys, else train."""
    return F.when(number(draw(seed, "hash", key)) % 10 < tenths, "val").otherwise("train")


def rounded_split(df: DataFrame, by: str, key: str, seed: int, parts: list[tuple[str, float]]) -> DataFrame:
    """SP9: shares rounded (halves to even) in each stratum, what is left to the last part."""
    sizes = df.groupBy(F.struct(by).alias("_in")).agg(F.count(F.lit(1)).alias("_n"))
    x = ranked(df, [by], draw(seed, "round", F.col(key))).withColumn("_in", F.struct(by)).join(sizes, "_in").drop("_in")
    out, upto = F.lit(parts[-1][0]), []
    for name, share in parts[:-1]:
        upto.append((name, F.bround(F.col("_n") * share)))
    edge = F.lit(0)
    cases = None
    for name, size in upto:
        edge = edge + size
        cases = F.when(F.col("_r") < edge, name) if cases is None else cases.when(F.col("_r") < edge, name)
    return x.withColumn("split", cases.otherwise(out)).drop("_r", "_n")


def voice_split(ids: DataFrame, n_test: int, n_val: int, test_pct: int = 30, val_pct: int = 8) -> DataFrame:
    """SP10: ids: no, n. The pair of disjoint id sets with the least deviation from the shares; ties to the first in sorted order. The pairs of sets are the planned product; any number of ids."""
    total = ids.agg(F.sum("n").alias("total"))
    one = ids.where(F.col("no").isNotNull())

    def sets(size: int) -> DataFrame:
        """Sets of `size` ids in rising order, with their sum."""
        x = one.select(F.array("no").alias("ids"), F.col("n").alias("s"))
        for _ in range(size - 1):
            more = one.select("no", "n")
            x = x.join(more, F.col("no") > F.element_at("ids", -1)).select(F.array_append("ids", F.col("no")).alias("ids"), (F.col("s") + F.col("n")).alias("s"))
        return x

    test = sets(n_test).select(F.col("s").alias("st"), F.col("ids").alias("test_ids"))
    val = sets(n_val).select(F.col("s").alias("sv"), F.col("ids").alias("val_ids"))
    err = F.abs(100 * F.col("st") - test_pct * F.col("total")) + F.abs(100 * F.col("sv") - val_pct * F.col("total"))
    pairs = test.join(val, ~F.arrays_overlap("test_ids", "val_ids")).crossJoin(total)
    best = pairs.agg(F.min(F.struct(err.alias("err"), "test_ids", "val_ids")).alias("b"))
    return best.select("b.err", F.array_join("b.test_ids", ",").alias("test_ids"), F.array_join("b.val_ids", ",").alias("val_ids"))


def capped_sample(df: DataFrame, by: str, group: str, key: str, n: int, seed: int) -> DataFrame:
    """SP11: n rows a stratum, at most ceil(n / groups) of a group in group order, then one more a group and round."""
    groups = df.groupBy(by).agg(F.count_distinct(group).alias("_g"))
    r = F.row_number().over(Window.partitionBy(by, group).orderBy(draw(seed, "cap", F.col(key))))
    x = df.withColumn("_r", r).where(F.col("_r") <= n).join(groups, by).withColumn("_cap", F.ceil(F.lit(n) / F.col("_g")))
    over = F.col("_r") > F.col("_cap")
    order = Window.partitionBy(by).orderBy(F.when(over, F.col("_r") - F.col("_cap")).otherwise(0), F.col(group), F.col("_r"))
    return x.withColumn("_o", F.row_number().over(order)).where(F.col("_o") <= n).drop("_r", "_g", "_cap", "_o")


def round_robin(df: DataFrame, by: list[str], voice: str, key: str, cap: int, seed: int) -> DataFrame:
    """SP12: up to cap rows a stratum, one voice after another in seeded order, each voice's rows in seeded order. Rows of one turn are slots of the stratum, so neither it nor a voice is sorted whole."""
    x = ranked(df, [*by, voice], draw(seed, "pick", F.col(key)), upto=F.lit(cap))
    x = x.where(F.col("_r") < cap).withColumn("_v", draw(seed, "voice", F.col(voice))).withColumn("_turn", F.col("_r") * SLOTS + digest_slot(F.col("_v")))
    x = running(x, by, [F.col("_v"), F.col(key)], "_turn", {"_o": F.lit(1)}, {"_o": F.lit(cap)})
    return x.where(F.col("_o") < cap).drop("_r", "_v", "_turn", "_o")


def budget(df: DataFrame, by: str, key: str, wants: Column, target: int, seed: int) -> DataFrame:
    """SP13: rows in seeded order, cost 2 if a noisy copy is wanted, else 1, up to the target; the row that would overshoot keeps its clean copy only."""
    x = df.withColumn("_h", draw(seed, "budget", F.col(key))).withColumn("_slot", digest_slot(F.col("_h")))
    x = running(x, [by], [F.col("_h")], "_slot", {"_c": F.when(wants, 2).otherwise(1)}, {"_c": F.lit(target)})
    return x.where(F.col("_c") < target).withColumn("noisy", wants & (F.col("_c") + 2 <= target)).drop("_c", "_h", "_slot")


def family_draw(df: DataFrame, by: str, family: str, key: str, total: int, seed: int) -> DataFrame:
    """SP14: one row of every family first, the rest of each stratum's total in proportion to what the families still hold, by largest remainder."""
    fam = df.groupBy(by, family).agg((F.count(F.lit(1)) - 1).alias("pool"))
    rest = fam.withColumn("_f", F.count(F.lit(1)).over(Window.partitionBy(by))).withColumn("_p", F.sum("pool").over(Window.partitionBy(by)))  # a row a family
    want = F.least(F.greatest(F.lit(total) - F.col("_f"), F.lit(0)), F.col("_p"))
    quota = largest_remainder(rest.where("_p > 0"), [by], family, "pool", want).select(by, family, F.least("n", "pool").alias("q"))
    x = df.join(quota, [by, family], "left").withColumn("q", F.coalesce("q", F.lit(0)) + 1)
    return ranked(x, [by, family, "q"], draw(seed, "family", F.col(key)), upto=F.col("q")).where("_r < q").drop("_r", "q")


def proportional_sample(df: DataFrame, by: str, key: str, total: int, seed: int) -> DataFrame:
    """SP15: total rows in proportion to stratum sizes."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("pool")).withColumn("all", F.lit(1))
    quota = largest_remainder(sizes, ["all"], by, "pool", F.lit(total)).select(by, F.col("n").alias("q"))
    x = df.join(quota, by)
    rest = [c for c in x.columns if c not in (by, "q")]
    return ranked(x, [by, "q"], draw(seed, "prop", F.col(key)), upto=F.col("q")).where("_r < q").select(by, *rest)


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """SP16: n rows without replacement."""
    return df.orderBy(draw(seed, "sample", F.col(key)), F.col(key)).limit(n)


def capped(df: DataFrame, by: list[str], key: str, cap: int, seed: int | str) -> DataFrame:
    """SP17, SP32: up to cap rows of each stratum, seeded by stratum."""
    order = Window.partitionBy(*by).orderBy(draw(seed, "capped", *[F.col(b) for b in by], F.col(key)))
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap).drop("_r")


def first_and_focus(df: DataFrame, by: str, position: str, k: int, focus: list[str]) -> DataFrame:
    """SP18: the first k rows of every label, focus labels in full."""
    whole = F.coalesce(F.col(by).isin(focus), F.lit(False))
    r = F.row_number().over(Window.partitionBy(by).orderBy(position))
    return df.where(~whole).withColumn("_r", r).where(F.col("_r") <= k).drop("_r").unionByName(df.where(whole))


def gap_fill(have: DataFrame, by: str, target: int, overgen: float, voices: int) -> DataFrame:
    """SP19: have: key, n. ceil(shortfall * overgen) jobs a key; the voice is the running job number modulo the voices. Offsets run over the key dimension."""
    jobs = have.withColumn("jobs", F.ceil(F.greatest(F.lit(target) - F.col("n"), F.lit(0)) * overgen).cast("int"))
    w = Window.partitionBy(F.lit(0)).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)  # a row a key: a dimension table
    first = jobs.withColumn("first", F.coalesce(F.sum("jobs").over(w), F.lit(0)))
    return first.where("jobs > 0").select(by, F.explode(F.sequence(F.lit(0), F.col("jobs") - 1)).alias("i"), "first").select(by, "i", F.pmod(F.col("first") + F.col("i"), F.lit(voices)).alias("voice"))


def job_plan(deficits: DataFrame, rows: DataFrame, split: str, key: str, overgen: float, voices: int, p_noisy: float, seed: int) -> DataFrame:
    """SP20: floor(deficit * overgen + 0.999) jobs a split; voices in turn; source rows of the split with replacement; noisy by a coin."""
    numbered = ranked_by_number(rows, [split], key, "pos")
    sizes = rows.groupBy(split).agg(F.count(F.lit(1)).alias("size"))
    jobs = deficits.withColumn("jobs", F.floor(F.col("deficit") * overgen + 0.999).cast("int")).where("jobs > 0").join(sizes, split)
    job = jobs.select(split, "size", F.explode(F.sequence(F.lit(0), F.col("jobs") - 1)).alias("i"))
    job = job.withColumn("pos", F.pmod(number(draw(seed, "row", F.col(split), F.col("i"))), F.col("size")))
    plan = job.join(numbered, [split, "pos"])
    return plan.select(split, "i", key, F.pmod("i", F.lit(voices)).alias("voice"), (uniform(seed, "noisy", F.col(split), F.col("i")) < p_noisy).alias("noisy"))


def voice_pool(voices: DataFrame, splits: DataFrame, mode: str) -> DataFrame:
    """SP21: voices (voice, split, origin) of each split: all of that split, references whatever their split, or the split's own recordings."""
    if mode == "references":
        return splits.crossJoin(voices.where("origin = 'reference'").select("voice"))
    own = voices if mode == "all" else voices.where("origin = 'own'")
    return splits.join(own.select("split", "voice"), "split")


def even_pairs(clips: DataFrame, personas: DataFrame, by: str, clip: str, persona: str, cap: int, seed: int) -> DataFrame:
    """SP22: min(cap, clips * personas) pairs a label, round-robin over its clips in seeded order, each clip meeting personas in its own order. A keyed permutation tells a clip's k-th persona, so only the pairs of the plan are made."""
    sizes = clips.groupBy(F.struct(by).alias("_in")).agg(F.count(F.lit(1)).alias("_c"))
    many = personas.count()  # the length of everyone's order
    first = ranked(clips, [by], draw(seed, "clip", F.col(by), F.col(clip)), upto=F.lit(cap)).where(F.col("_r") < cap)
    x = first.withColumn("_in", F.struct(by)).join(sizes, "_in").drop("_in")
    turns = F.ceil((F.least(F.lit(cap), F.col("_c") * many) - F.col("_r")) / F.col("_c")).cast("long")
    x = x.withColumn("_k", F.explode(F.when(turns > 0, F.sequence(F.lit(0).cast("long"), turns - 1)).otherwise(F.array().cast("array<bigint>"))))
    x = x.withColumn("_p", permuted(F.col("_k"), F.lit(many).cast("long"), seed, "pair", F.col(clip)))
    return x.join(ranked(personas, [], draw(seed, "persona", F.col(persona)), "_p"), "_p").drop("_p", "_r", "_c", "_k")


def mix_plan(df: DataFrame, split: str, key: str, pools: DataFrame, p_mix: float, lo: float, hi: float, seed: int) -> DataFrame:
    """SP23: pools: split, pos, chunk. Chosen rows get two attempts with different chunks of their split and uniform SNR."""
    sizes = pools.groupBy(split).agg(F.count(F.lit(1)).alias("size"))
    k = F.col(key)
    x = df.where(uniform(seed, "mix", k) < p_mix).join(sizes, split)
    one = F.pmod(number(draw(seed, "c1", k)), F.col("size"))
    two = F.pmod(one + 1 + F.pmod(number(draw(seed, "c2", k)), F.col("size") - 1), F.col("size"))
    x = x.withColumn("_a", F.explode(F.array(F.struct(F.lit(1).alias("attempt"), one.alias("pos")), F.struct(F.lit(2).alias("attempt"), two.alias("pos")))))
    x = x.select(split, key, F.col("_a.attempt").alias("attempt"), F.col("_a.pos").cast("int").alias("pos"))
    snr = F.lit(lo) + uniform(seed, "snr", F.col(key), F.col("attempt")) * (hi - lo)
    return x.join(pools, [split, "pos"]).withColumn("snr_db", F.round(snr, 6)).drop("pos")


def step_plan(df: DataFrame, cls: str, key: str, steps: dict[str, float], seed: int, epoch: int, barred: dict[str, Column] | None = None) -> DataFrame:
    """SP24: of each class floor(p * n) rows get a step, one more by a coin with the fraction, on a seeded subset per step; barred rows stay out.

    A step's rows are those whose digest lies below the class's (quota + 1)-th smallest: all steps' slots are counted in one pass, the slot that holds each edge is read in a second, and a row meets one row of edges.
    """
    names = list(steps)
    free = {s: F.coalesce(~barred[s], F.lit(False)) if barred and s in barred else F.lit(True) for s in names}
    digest = {s: draw(seed, "step", F.lit(epoch), F.lit(s), F.col(key)) for s in names}
    cells = F.array(*[F.when(free[s], F.struct(F.lit(i).alias("i"), digest[s].alias("h"))) for i, s in enumerate(names)])
    long = df.select(F.struct(cls).alias("_in"), F.inline(F.filter(cells, lambda c: c.isNotNull()))).withColumn("_slot", digest_slot(F.col("h")))
    slots = long.groupBy("_in", "i", "_slot").agg(F.count(F.lit(1)).alias("_m"))
    n = F.sum("_m").over(Window.partitionBy("_in", "i"))
    p = F.element_at(F.array(*[F.lit(x) for x in steps.values()]), F.col("i") + 1)
    name = F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)
    coin = uniform(seed, "frac", F.lit(epoch), F.col(f"_in.{cls}"), name)
    quota = F.floor(F.col("_n") * p) + F.when(coin < F.col("_n") * p - F.floor(F.col("_n") * p), 1).otherwise(0)
    before = F.coalesce(F.sum("_m").over(Window.partitionBy("_in", "i").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = slots.withColumn("_n", n).withColumn("_b", before).withColumn("_q", quota)
    # no slot holds the edge where every row is taken
    edge = placed.where("_b <= _q AND _q < _b + _m").select(F.struct("_in", "i", "_slot").alias("_place"), "_b", "_q")
    inside = long.withColumn("_place", F.struct("_in", "i", "_slot")).join(edge, "_place")
    r = F.row_number().over(Window.partitionBy("_place").orderBy("h")) - 1 + F.col("_b")
    edges = inside.withColumn("_r", r).where("_r = _q").groupBy("_in").agg(F.map_from_entries(F.collect_list(F.struct("i", "h"))).alias("_edges"))
    x = df.withColumn("_in", F.struct(cls)).join(edges, "_in", "left")
    below = lambda i, s: F.coalesce(digest[s] < F.try_element_at("_edges", F.lit(i)), F.lit(True))
    return x.withColumns({s: free[s] & below(i, s) for i, s in enumerate(names)}).drop("_in", "_edges")


def spread(df: DataFrame, by: str, key: str, lo: float, hi: float, seed: int) -> DataFrame:
    """SP25: one value in each of k equal strata of [lo, hi), in random order."""
    sizes = df.groupBy(F.struct(by).alias("_in")).agg(F.count(F.lit(1)).alias("_n"))
    x = ranked(df, [by], draw(seed, "rank", F.col(key))).withColumn("_in", F.struct(by)).join(sizes, "_in")
    return x.withColumn("value", F.round(F.lit(lo) + (F.col("_r") + uniform(seed, "u", F.col(key))) / F.col("_n") * (hi - lo), 6)).drop("_in", "_r", "_n")


def deal(df: DataFrame, key: str, order_by: str, pool: DataFrame, seed: int, by: str) -> DataFrame:
    """SP26: pool: item. Rows of a stratum take items deck by deck, each deck shuffled anew, so items are used evenly."""
    size = pool.count()  # a dimension
    x = ranked_by_number(df, [by], order_by).withColumn("deck", F.floor(F.col("_r") / size).cast("int")).withColumn("pos", (F.col("_r") % size).cast("int")).drop("_r")
    decks = x.select(by, "deck").distinct().crossJoin(pool)
    ranked = decks.withColumn("pos", F.row_number().over(Window.partitionBy(by, "deck").orderBy(draw(seed, "deck", F.col(by), F.col("deck"), F.col("item")))) - 1)
    return x.join(ranked, [by, "deck", "pos"])


def fixed_spec(key: Column, seed: int, rirs: int, noises: int, lo: float, hi: float) -> list[Column]:
    """SP27: room, noise and SNR of an evaluation row, from its key alone."""
    return [F.pmod(number(draw(seed, "rir", key)), F.lit(rirs)).alias("rir"), F.pmod(number(draw(seed, "noise", key)), F.lit(noises)).alias("noise"), F.round(F.lit(lo) + uniform(seed, "snr", key) * (hi - lo), 6).alias("snr_db")]


def session_plan(df: DataFrame, key: str, seed: int, wakes: int, beds: int) -> DataFrame:
    """SP28: wake clip, bed, lead and gap of a session, and the times that follow; duration in seconds."""
    k = F.col(key)
    x = df.withColumns({"wake": F.pmod(number(draw(seed, "wake", k)), F.lit(wakes)), "bed": F.pmod(number(draw(seed, "bed", k)), F.lit(beds)), "lead_s": F.round(0.5 + uniform(seed, "lead", k), 3), "gap_s": F.round(0.2 + uniform(seed, "gap", k) * 0.8, 3)})
    return x.withColumn("command_start_s", F.round(F.col("lead_s") + 1.0 + F.col("gap_s"), 3)).withColumn("speech_end_s", F.round(F.col("command_start_s") + F.col("duration"), 3))


def timeline(df: DataFrame, by: str, key: str, duration: str, seed: int) -> DataFrame:
    """SP29: units of a recording in seeded order with distances of 1 to 8 s: offset and end of range (next offset, null for the last unit). Running sums over slots; a unit's end is its own offset and step, so no border is looked over."""
    x = df.withColumns({"_h": draw(seed, "order", F.col(key)), "_step": F.col(duration) + F.round(1 + uniform(seed, "dist", F.col(key)) * 7, 3)}).withColumn("_slot", digest_slot(F.col("_h")))
    last = x.groupBy(F.struct(by).alias("_in")).agg(F.max("_h").alias("_last"))
    x = running(x, [by], [F.col("_h")], "_slot", {"_t": F.col("_step")}).withColumn("_in", F.struct(by)).join(last, "_in")
    ends = F.when(F.col("_h") < F.col("_last"), F.round(F.col("_t") + F.col("_step"), 3))
    return x.withColumn("offset_s", F.round("_t", 3)).withColumn("range_end_s", ends).drop("_h", "_step", "_slot", "_t", "_in", "_last")


def prompt_pack(df: DataFrame, speaker: str, kind: str, key: str, ms: str, least: int = 8000, most: int = 12000, gap: int = 150) -> DataFrame:
    """SP30: read speech first, clips added until `least`, one that would pass `most` skipped, gaps counted; speakers short of it are dropped. Milliseconds.

    A clip that fits at any length below `least` is always taken, so nothing after enough of them can count: running sums over slots cut each speaker's clips there before they meet in the fold. Clips longer than `most` never count.
    """
    x = df.select(speaker, F.when(F.col(kind) == "read", 0).otherwise(1).alias("_o"), F.col(key).cast("long").alias("_k"), F.col(ms).cast("int").alias("_ms")).where(F.col("_ms") <= most)
    x = with_span_slot(x, [speaker, "_o"], "_k").withColumn("_slot", F.col("_o") * (SLOTS + 2) + F.col("_slot"))
    sure = F.when((F.col("_ms") >= 0) & (F.col("_ms") <= most - least - gap), F.col("_ms") + gap).otherwise(0)
    x = running(x, [speaker], [F.col("_o"), F.col("_k")], "_slot", {"_sure": sure}, {"_sure": F.lit(least + gap)}).where(F.col("_sure") < least + gap)

    def step(state, row):
        length, taken = state
        longer = length + row[3] + (gap if taken else 0)
        return (longer, [*taken, row[2]]) if length < least and longer <= most else state, []

    def finish(name, state):
        return [(*name, state[0], ",".join(map(str, state[1])))] if state[0] >= least else []

    return fold_sorted(x.select(speaker, "_o", "_k", "_ms"), [speaker], ["_o", "_k"], f"`{speaker}` {df.schema[speaker].dataType.simpleString()}, ms int, clips string", lambda: (0, []), step, finish)


def chunk_plan(colours: DataFrame, bands: DataFrame, total: int, seed: int) -> DataFrame:
    """SP31: chunks dealt equally over colour and band (lo, hi), with uniform duration of 2 to 10 s and level within the band."""
    cells = colours.crossJoin(bands).withColumn("all", F.lit(1)).withColumn("w", F.lit(1)).withColumn("cell", F.concat_ws("/", "colour", "band"))
    per = largest_remainder(cells, ["all"], "cell", "w", F.lit(total)).where("n > 0")
    x = per.select("cell", "lo", "hi", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i"))
    u = lambda p: uniform(seed, p, F.col("cell"), F.col("i"))
    return x.select("cell", "i", F.round(2 + u("dur") * 8, 6).alias("duration"), F.round(F.col("lo") + u("lev") * (F.col("hi") - F.col("lo")), 6).alias("level"))


def apply_split(df: DataFrame, groups: DataFrame, group: str, silence: Column, augmented: Column) -> DataFrame:
    """SP33: the group's split on every row; silence to train; augmented rows outside train dropped (reason); rows without a split marked missing."""
    x = df.join(groups.select(group, F.col("split").alias("_s")), group, "left")
    s = F.when(silence, "train").otherwise(F.col("_s"))
    reason = F.when(s.isNull(), "missing_split").when(augmented & (s != "train"), "augmented_held_out")
    return x.withColumn("new_split", s).withColumn("reason", reason).drop("_s")
