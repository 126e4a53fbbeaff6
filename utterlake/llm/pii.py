"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Built-in column functions only, one projection, no shuffle, no user code. All
repeats are possessive or over one character class, so that neither very long
texts nor very long runs of digits cost more than linear time or deep stacks.

Offsets are running sums over blocks of matches and texts are read in pieces of
PIECE code points, so the time is linear in the text and in its matches, however
many they are.

Base kinds (email, ip, card, phone) stay whatever their score; the further
kinds (iban, ssn, secret) count from `min_score` on. Positions are code
points, end exclusive; matches of a kind are leftmost and do not overlap.

Defined cases: a null or empty text has no span; spans of different kinds may
overlap and all are returned; repeated rows give repeated rows; an empty
table gives an empty table; other columns pass through, and a clash with an
output name raises.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
#: Matches of a block, code points of a piece.
BLOCK, PIECE = 256, 1024
ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a character without which no match is possible
    score: float
    context: str
    base: bool = True


KINDS: tuple[Kind, ...] = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, r"mail|contact|write|reach|address"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", ".", 0.6, r"\bip\b|address|host|server|login"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "", 0.7, r"card|visa|credit|payment|carte|karte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.7, r"phone|call|tel|fax|mobile|contact"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", "", 0.7, r"iban|bank|account|konto|compte|cuenta", False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", 0.4, r"ssn|social security|tax id", False),
    Kind("secret", r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\s*+[=:]\s*+\"[^\"\n]{12,}+\"", "\"", 0.8, r"auth|header|config|export", False),
)

IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


def mod97(compact: Column) -> Column:
    """Remainder of an IBAN: first four characters to the end, letters as 10 to 35, folded digit by digit."""
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))

    def step(acc: Column, ch: Column) -> Column:
        v = F.instr(F.lit(ALNUM), ch) - 1
        return (F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v)) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise(step(acc, ch)))


def valid(kind: str, match: Column) -> Column:
    """Checksum or range test of one matched string."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(IP_PARTS)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        compact = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(compact).between(15, 34) & (mod97(compact) == 1)
    return F.lit(True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """array<int>: for each of `values` (not negative) what combine makes of those before it, from 0 on. Blocks first, then across blocks, since appending copies an array."""
    ints, blocks = F.array().cast("array<int>"), F.array().cast("array<array<int>>")

    def within(acc: Column, x: Column) -> Column:
        return F.struct(combine(acc["last"], x).alias("last"), F.concat(acc["before"], F.array(acc["last"])).alias("before"))

    def across(acc: Column, block: Column) -> Column:
        before = F.transform(block["before"], lambda x: combine(acc["last"], x))
        return F.struct(combine(acc["last"], block["last"]).alias("last"), F.concat(acc["before"], F.array(before)).alias("before"))

    cut = let(values, lambda v: F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(BLOCK)), lambda i: F.slice(v, i + 1, F.lit(BLOCK)))).otherwise(blocks))
    each = F.transform(cut, lambda b: F.aggregate(b, F.struct(F.lit(0).alias("last"), ints.alias("before")), within))
    return F.flatten(F.aggregate(each, F.struct(F.lit(0).alias("last"), blocks.alias("before")), across)["before"])


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(cut: Column, lo: Column, hi: Column) -> Column:
    """Code points lo to hi of a text in pieces; only the pieces that hold them are read."""
    first = F.floor(lo / PIECE).cast("int")
    many = F.greatest(F.floor((hi - 1) / PIECE).cast("int") - first + 1, F.lit(0))
    return F.substr(F.array_join(F.slice(cut, first + 1, many), ""), lo - first * PIECE + 1, F.greatest(hi - lo, F.lit(0)))


def spans_of(kind: Kind, text: Column, min_score: float) -> Column:
    """Array of confirmed spans of one kind, in order of start."""
    pattern = kind.pattern
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def placed(matches: Column) -> Column:
        before = running(F.transform(matches, lambda e: F.length(e["gap"]) + F.coalesce(F.length(e["hit"]), F.lit(0))), lambda a, x: a + x)

        def span(e: Column, at: Column) -> Column:
            start = at + F.length(e["gap"])
            return F.struct(start.alias("start"), (start + F.length(e["hit"])).alias("end"), e["hit"].alias("hit"))

        return F.zip_with(matches, before, span)

    confirmed = F.filter(let(both, placed), lambda s: s["hit"].isNotNull() & valid(kind.name, s["hit"]))

    def scored(cut: Column, s: Column) -> Column:
        lo = F.greatest(s["start"] - 40, F.lit(0))
        near = F.concat(between(cut, lo, s["start"]), F.lit(" "), between(cut, s["end"], s["end"] + 40))
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(F.lower(near).rlike(kind.context), 0.2).otherwise(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    none = F.array().cast(SPAN)
    out = let(confirmed, lambda found: F.when(F.size(found) > 0, let(pieces(text), lambda cut: F.transform(found, lambda s: scored(cut, s)))).otherwise(none))
    if not kind.base:
        out = F.filter(out, lambda s: s["score"] >= min_score)
    possible = F.contains(text, F.lit(kind.hint)) if kind.hint else text.rlike("[0-9]")
    return F.when(possible, out).otherwise(none).cast(SPAN)


def find_pii(docs: DataFrame, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """docs with one array column of spans for each kind, named pii_<kind>."""
    names = {f"pii_{k.name}" for k in KINDS}
    if clash := names & set(docs.columns):
        raise ValueError(f"columns already present: {sorted(clash)}")
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({f"pii_{k.name}": spans_of(k, t, min_score) for k in KINDS})


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_pii(docs: DataFrame, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one replacement."""
    found = find_pii(docs, text, min_score)
    spans = F.array_sort(
        F.transform(
            F.concat(*[F.col(f"pii_{k.name}") for k in KINDS]),
            lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("until"), s["kind"].alias("kind")),
        )
    )
    def masked(spans: Column, cut: Column) -> Column:
        # a span within earlier ones adds nothing
        at = running(F.transform(spans, lambda s: -s["until"]), lambda a, x: F.greatest(a, x))
        open_ = F.filter(F.zip_with(spans, at, lambda s, a: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), a.alias("at"))), lambda s: s["start"] >= s["at"])
        shown = F.transform(open_, lambda s: F.concat(between(cut, s["at"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        end = F.array_max(F.transform(spans, lambda s: -s["until"]))
        return F.concat(F.array_join(shown, ""), F.substr(F.col(text), end + 1))

    done = let(spans, lambda s: F.when(F.size(s) > 0, let(pieces(F.col(text)), lambda cut: masked(s, cut))).otherwise(F.col(text)))
    return found.withColumn(text, done).select(*docs.columns)


def op7_pii(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs)
    base = F.concat(*[F.col(f"pii_{k.name}") for k in KINDS if k.base])
    every = F.concat(*[F.col(f"pii_{k.name}") for k in KINDS])
    return found.select(
        "doc_id",
        *[F.size(f"pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in KINDS if k.base],
        F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.transform(every, lambda s: s["score"]).alias("scores"),
    )
