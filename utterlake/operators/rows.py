"""Row predicates, mappings and single-reason selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import accepted, margin_ok


def map_label(c: Column, mapping: dict[str, str]) -> Column:
    """PF1: mapped value, or the value itself where the mapping has none."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def drop_reason(rules: list[tuple[str, Column]]) -> Column:
    """PF2: name of the first rule that holds, in order; null: the row stays."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return out


def convert_row(text: Column, variation: Column) -> tuple[Column, Column]:
    """PF3: (kind, text) of an imported row: no variation: dropped; digits leave out-of-scope text; nothing left: silence."""
    oos = variation == "oos"
    plain = F.trim(F.regexp_replace(F.when(oos, F.regexp_replace(text, "[0-9]", "")).otherwise(F.regexp_replace(text, ":00", "")), " +", " "))
    kind = F.when(variation.isNull(), "dropped").when(plain == "", "silence").when(oos, "oos").otherwise("command")
    return kind, F.when(variation.isNotNull() & (plain != ""), plain)


def dispatch(df: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """PF4: fixed columns by kind, from a small dimension; kinds it lacks keep nulls."""
    return df.join(dim, on, "left")


def already_noised(source: Column, filename: Column) -> Column:
    """PF5: source ends in _noisy or _ambient, or the file stem in _noisy."""
    return source.rlike("_(noisy|ambient)$") | F.regexp_replace(filename, "\\.[^.]*$", "").endswith("_noisy")


def eligible(bucket: Column, transcript: Column, label: Column, labels: list[str] | None) -> Column:
    """PF6: by label set, or by bucket with a transcript."""
    if labels is not None:
        return label.isin(labels)
    return (bucket != "silence") & (F.length(F.trim(F.coalesce(transcript, F.lit("")))) > 0)


def group_class(source: Column, group: Column, fixed: list[str]) -> Column:
    """PF7: A for personas and the fixed ids, B for s<number>, else null; other sources have none."""
    return F.when(source.startswith("persona"), "A").when(~source.startswith("main"), None).when(group.isin(fixed), "A").when(group.rlike("^s[0-9]+$"), "B")


def source_of(name: Column, prefixes: dict[str, str]) -> Column:
    """PF8: by prefix; null rows go to a validator."""
    out = F.lit(None).cast("string")
    for prefix, source in reversed(prefixes.items()):
        out = F.when(name.startswith(prefix), F.lit(source)).otherwise(out)
    return out


def mentions(text: Column, words: list[str], possessive: bool = True) -> Column:
    """PF9, PF10: whole words in any case; with possessive also word's and words."""
    tail = "(?:'s|s)?" if possessive else ""
    return F.coalesce(text, F.lit("")).rlike("(?i)\\b(?:" + "|".join(words) + ")" + tail + "\\b")


def violations(text: Column, component: Column) -> Column:
    """PF11: every violated rule of a text and a path component, as an array of names."""
    rules = [
        ("empty_text", F.coalesce(F.trim(text), F.lit("")) == ""),
        ("dash", F.contains(text, F.lit(" - "))),
        ("slash", text.rlike("[/\\\\]")),
        ("charset", ~component.rlike("^[A-Za-z0-9_.-]+$")),
        ("dots", component.isin(".", "..")),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull())


def normal_path(path: Column) -> Column:
    """A relative path without '.' and with '..' folded; leading '..' stay."""

    def step(acc: Column, part: Column) -> Column:
        up = (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != "..")
        return F.when(part.isin("", "."), acc).when((part == "..") & up, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def rebase(path: Column, old: str, new_depth: int) -> Column:
    """PF12: a path relative to `old`, seen from a folder new_depth levels below the common root; absolute paths stay."""
    return F.when(path.startswith("/"), path).otherwise(normal_path(F.concat(F.lit("../" * new_depth + old + "/"), path)))


def contained(path: Column) -> Column:
    """PF13: relative and never above its root."""
    return ~path.startswith("/") & ~normal_path(path).startswith("..")


def gated(df: DataFrame, threshold: float, margin: float | None, keep: str = "answer") -> DataFrame:
    """PF14, PF15: column ok and the prediction nulled where it is not."""
    ok = accepted(F.col("intent"), F.col("confidence"), threshold) & margin_ok(F.col("gap"), margin)
    return df.withColumn("ok", ok).withColumn(keep, F.when(F.col("ok"), F.col("intent")))


def decision(threshold: float, margin: float) -> Column:
    """PF16: rejection reason in decision order; null when accepted."""
    return (
        F.when(F.col("intent").isNull(), F.when(F.col("gap").isNotNull(), "incomplete_prefix").otherwise("no_command"))
        .when(F.col("gap") < margin, "incomplete_prefix")
        .when(F.col("confidence") < threshold, "threshold")
    )


def per_intent_accept(df: DataFrame, taus: DataFrame, default: float, score: str = "confidence") -> DataFrame:
    """PF17: score reaches the intent's own threshold, or the default."""
    return df.join(taus, "intent", "left").withColumn("ok", F.coalesce(F.col(score) >= F.coalesce("tau", F.lit(default)), F.lit(False))).drop("tau")


def correct(label: Column, intent: Column, slot_truth: Column, slots: Column) -> Column:
    """PF18: same intent and, where there is a slot truth, that value among the predicted ones in any case."""
    hit = F.exists(F.map_values(slots), lambda v: F.lower(v) == F.lower(slot_truth))
    return F.coalesce((label == intent) & (slot_truth.isNull() | hit), F.lit(False))


def class_accept(best: Column, top: Column, threshold: float | None, outside: list[int]) -> Column:
    """PF19: best class is a command, with enough probability; no threshold: plain argmax."""
    inside = ~best.isin(outside)
    return inside if threshold is None else inside & (top >= threshold)


def combine(mode: str, a: Column, a_ok: Column, b: Column, b_ok: Column) -> tuple[Column, Column]:
    """PF20: (answer, source). fallback: A if accepted, else B; agree: B gates, A's answer if they agree."""
    if mode == "fallback":
        return F.when(a_ok, a).when(b_ok, b), F.when(a_ok, "A").when(b_ok, "B")
    both = b_ok & (a == b)
    return F.when(both, a), F.when(both, "A")


def command_status(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """PF21: vocabulary: intent, needs_slot, values. status ok or malformed; changed false for values outside it."""
    v = df.join(vocabulary, "intent", "left")
    known = F.col("needs_slot").isNotNull()
    bad = ~known | (F.col("needs_slot") & F.col("slot").isNull())
    changed = ~bad & (~F.col("needs_slot") | F.array_contains("values", F.col("slot")))
    return v.withColumn("status", F.when(bad, "malformed").otherwise("ok")).withColumn("changed", F.coalesce(changed, F.lit(False))).drop("needs_slot", "values")


def resume(jobs: DataFrame, outcome: DataFrame, key: str) -> DataFrame:
    """PF22: jobs without an ok outcome that has a path."""
    return jobs.join(outcome.where((F.col("status") == "ok") & F.col("path").isNotNull()).select(key), key, "left_anti")


def noise_pools(df: DataFrame, mode: str) -> Column:
    """PF23: pool of a row, noise or babble, null for neither."""
    source = F.col("source_dataset")
    if mode == "manifest":
        return F.when(source == "background_noise", "noise")
    negative = source.startswith("negative_")
    return F.when((F.col("bucket") == "silence") & ~negative, "noise").when((F.col("bucket") == "babble") & (~negative | (source == "negative_babble")), "babble")
