"""Text normalisation, number spelling, phrase tables and slots, as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONES = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen").split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def spell(n: int) -> str:
    """English words of 0 to 100."""
    if n < 20:
        return ONES[n]
    if n == 100:
        return "one hundred"
    return TENS[n // 10 - 2] + (" " + ONES[n % 10] if n % 10 else "")


SPELLED = [spell(n) for n in range(101)]


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " +", " "))


def _plain(c: Column) -> Column:
    return F.translate(F.lower(c), "‘’ʼ", "'''")


def normalize_text(c: Column) -> Column:
    """ST1: lower case, straight apostrophes, anything but letters, apostrophe and space to a space, squeezed."""
    return _squeeze(F.regexp_replace(_plain(c), "[^a-z ']", " "))


def normalize_digits(c: Column) -> Column:
    """ST2: as ST1, digits stay."""
    return _squeeze(F.regexp_replace(_plain(c), "[^a-z0-9' ]", " "))


def alias_normalize(c: Column) -> Column:
    """ST3: percent signs, a.m. and p.m., full hours, joined am and pm, then ST2."""
    t = _plain(c)
    t = F.regexp_replace(t, "%", " percent ")
    t = F.regexp_replace(t, "\\b([ap])\\.m\\.", "$1m")
    t = F.regexp_replace(t, "([0-9]+):00", "$1")
    t = F.regexp_replace(t, "([0-9])([ap]m)\\b", "$1 $2")
    return _squeeze(F.regexp_replace(t, "[^a-z0-9' ]", " "))


def _large(run: Column) -> Column:
    bare = F.regexp_replace(run, "^0+", "")
    return (F.length(bare) > 3) | (F.try_to_number(F.concat(F.lit("0"), F.substring(bare, 1, 3)), F.lit("9999")) > 100)


def normalize_unknown(c: Column) -> Column:
    """ST4: null with a hash sign or a number over 100; at and ampersand signs in words, then ST2."""
    bad = F.contains(c, F.lit("#")) | F.exists(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), _large)
    said = F.regexp_replace(F.regexp_replace(c, "@", " at "), "&", " and ")
    return F.when(~bad, normalize_digits(said))


def spell_numbers(c: Column) -> Column:
    """ST5: every digit run 0 to 100 in words, full hours without minutes; null when a run is larger."""
    t = F.regexp_replace(c, ":00", "")
    runs = F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0))
    both = F.arrays_zip(F.split(t, "[0-9]+", -1).alias("gap"), runs.alias("run"))
    words = F.array(*[F.lit(w) for w in SPELLED])
    said = F.array_join(F.transform(both, lambda x: F.concat(x["gap"], F.coalesce(F.try_element_at(words, x["run"].cast("int") + 1), F.lit("")))), "")
    return F.when(~F.exists(runs, _large), said)


def phrase_key(c: Column) -> Column:
    """ST6: spoken form of a text, the key of phrase tables."""
    return normalize_text(spell_numbers(c))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def derived_name(group: Column, stem: Column, attempt: Column, chunk: Column) -> Column:
    """ST7: <group>__<stem>__amb<attempt>-<chunk>.wav"""
    return F.concat(group, F.lit("__"), stem, F.lit("__amb"), attempt.cast("string"), F.lit("-"), chunk.cast("string"), F.lit(".wav"))


def phrase_table(templates: DataFrame, values: DataFrame) -> DataFrame:
    """ST8: templates (intent, slot, template with {}) times values (slot, value, said): text, intent, slot, value. Templates without a slot stay as they are."""
    filled = templates.where(F.col("slot").isNotNull()).join(values, "slot").select(F.replace("template", F.lit("{}"), "said").alias("text"), "intent", "slot", "value")
    plain = templates.where(F.col("slot").isNull()).select(F.col("template").alias("text"), "intent", "slot", F.lit(None).cast("string").alias("value"))
    return filled.unionByName(plain).distinct()


def word_prefixes(phrases: DataFrame) -> DataFrame:
    """Proper whole-word prefixes of phrases (text): prefix, n_words."""
    w = F.split("text", " ")
    return phrases.where(F.size(w) > 1).select(F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("n_words"), "text").select(F.array_join(F.slice(w, F.lit(1), F.col("n_words")), " ").alias("prefix"), "n_words").distinct()


def incomplete_prefixes(phrases: DataFrame) -> DataFrame:
    """ST9: prefixes that are not phrases themselves."""
    return word_prefixes(phrases).join(phrases.select(F.col("text").alias("prefix")), "prefix", "left_anti")


def phrase_sets(phrases: DataFrame) -> DataFrame:
    """ST10: text with flags single_word and strict_prefix (a proper word prefix of another phrase)."""
    prefix = word_prefixes(phrases).select(F.col("prefix").alias("text"), F.lit(True).alias("hit")).distinct()
    return phrases.select("text").distinct().join(prefix, "text", "left").select("text", (F.size(F.split("text", " ")) == 1).alias("single_word"), F.coalesce("hit", F.lit(False)).alias("strict_prefix"))


def leading_int(c: Column) -> Column:
    """ST12: the leading whole number, null without one."""
    return F.regexp_extract(c, "^\\s*([0-9]{1,9})", 1).try_cast("int")


def seconds(c: Column) -> Column:
    """ST12: '5 minutes', '30 seconds', '2 hours' in seconds."""
    unit = F.regexp_extract(F.lower(c), "(second|minute|hour)", 1)
    factor = F.when(unit == "second", 1).when(unit == "minute", 60).when(unit == "hour", 3600)
    return leading_int(c) * factor


def display_label(intent: Column, slot: Column) -> Column:
    """ST13: title of an intent, with its slot value in brackets."""
    title = F.initcap(F.regexp_replace(F.lower(intent), "_", " "))
    return F.when(slot.isNull(), title).otherwise(F.concat(title, F.lit(" ("), slot, F.lit(")")))


def encodable(c: Column) -> Column:
    """Only letters, space and apostrophe."""
    return c.rlike("^[a-z ']*$")


def adjacent_repeats(c: Column) -> Column:
    return F.regexp_count(c, F.lit("(.)(?=\\1)"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
