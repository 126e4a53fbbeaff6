"""Queries of splits, quotas, samples and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as S
from .common import CLIPS, Book, clips, draw_sql, number_sql, table, uniform_sql

BOOK = Book()
add = BOOK.add
C = f"WITH {CLIPS}"


def remainder_sql(src: str, by: str, key: str, weight: str, total: str, extra: str = "", desc: bool = False) -> str:
    """Largest remainder over a relation, as SQL."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""(SELECT * EXCLUDE (b_, m_, r_, l_), b_ + CASE WHEN r_ <= l_ THEN 1 ELSE 0 END AS n FROM (SELECT *, row_number() OVER ({part} ORDER BY m_ DESC, {key} {'DESC' if desc else 'ASC'}) AS r_, {total} - sum(b_) OVER ({part}) AS l_
FROM (SELECT *, (({total}) * {weight} // sum({weight}) OVER ({part}))::BIGINT AS b_, (({total}) * {weight} % sum({weight}) OVER ({part}))::BIGINT AS m_ FROM {src})))"""


@add("sp1_largest_remainder", f"SELECT n_regionkey, n_name, n::BIGINT AS n FROM {remainder_sql('(SELECT n_regionkey, n_name, n_nationkey + 1 AS w FROM nation)', 'n_regionkey', 'n_name', 'w', '(100 + n_regionkey)')}")
def sp1(spark, d):
    x = table(spark, d, "nation").select("n_regionkey", "n_name", (F.col("n_nationkey") + 1).alias("w"))
    return S.largest_remainder(x, ["n_regionkey"], "n_name", "w", F.lit(100) + F.col("n_regionkey")).select("n_regionkey", "n_name", "n")


_POOLS = "pools AS (SELECT bucket, label || CASE WHEN bucket = 'target_commands' THEN '' ELSE concat('_', doc_id % 4) END AS label, count(*) AS pool FROM clips GROUP BY 1, 2), t AS (SELECT min(pool) AS each, min(pool) * count(*) AS target FROM pools WHERE bucket = 'target_commands'), w AS (SELECT each, (round_even(target / 0.65, 0) - target)::BIGINT AS rest FROM t)"


@add(
    "sp2_allocation_tree",
    C + f""", {_POOLS}, bq AS {remainder_sql("(SELECT DISTINCT bucket, CASE bucket WHEN 'babble' THEN 25 ELSE 10 END AS weight, rest FROM pools, w WHERE bucket <> 'target_commands')", '', 'bucket', 'weight', 'rest')},
o AS {remainder_sql("(SELECT p.bucket, label, pool, bq.n AS quota FROM pools p JOIN bq ON bq.bucket = p.bucket)", 'bucket', 'label', 'pool', 'quota')}
SELECT bucket, label, n::BIGINT AS n FROM o UNION ALL SELECT bucket, label, each FROM pools, w WHERE bucket = 'target_commands'""",
)
def sp2(spark, d):
    pools = clips(spark, d).withColumn("label", F.when(F.col("bucket") == "target_commands", F.col("label")).otherwise(F.concat("label", F.lit("_"), F.col("doc_id") % 4))).groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    return S.allocation(pools, 0.65, {"babble": 25, "silence": 10})


_PARTS = [("train", 70), ("val", 20), ("test", 10)]
_Q3 = remainder_sql("(SELECT bucket, total, place, split, weight FROM (SELECT bucket, count(*) AS total FROM clips GROUP BY 1), (VALUES (0, 'train', 70), (1, 'val', 20), (2, 'test', 10)) v(place, split, weight))", "bucket", "place", "weight", "total")


@add(
    "sp3_exact_split",
    C + f", q AS (SELECT bucket, split, sum(n) OVER (PARTITION BY bucket ORDER BY place) - n AS lo, sum(n) OVER (PARTITION BY bucket ORDER BY place) AS hi FROM {_Q3}), r AS (SELECT doc_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY {draw_sql(11, 'split', 'doc_id')}) - 1 AS r FROM clips) SELECT doc_id, r.bucket, split FROM r JOIN q ON q.bucket = r.bucket AND r >= lo AND r < hi",
)
def sp3(spark, d):
    return S.exact_split(clips(spark, d).select("doc_id", "bucket"), "bucket", "doc_id", 11, _PARTS)


@add(
    "sp4_greedy_group_split",
    f"""WITH RECURSIVE g AS (SELECT o_orderpriority AS fam, o_custkey AS grp, count(*) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {draw_sql(4, 'group', 'o_orderpriority', 'o_custkey')}) AS i FROM orders GROUP BY 1, 2),
tot AS (SELECT fam, sum(n) AS total FROM g GROUP BY 1),
f AS (SELECT fam, 0::BIGINT AS i, 0::HUGEINT AS te, 0::HUGEINT AS tr, 0::HUGEINT AS va, NULL::BIGINT AS grp, NULL::VARCHAR AS split FROM tot
UNION ALL SELECT fam, i, te + CASE WHEN s = 'test' THEN n ELSE 0 END, tr + CASE WHEN s = 'train' THEN n ELSE 0 END, va + CASE WHEN s = 'val' THEN n ELSE 0 END, grp, s
FROM (SELECT f.fam, g.i, te, tr, va, n, g.grp, CASE WHEN total - 10 * va >= total - 10 * te AND total - 10 * va >= 8 * total - 10 * tr THEN 'val' WHEN 8 * total - 10 * tr >= total - 10 * te THEN 'train' ELSE 'test' END AS s FROM f JOIN g ON g.fam = f.fam AND g.i = f.i + 1 JOIN tot ON tot.fam = f.fam))
SELECT fam, grp, split FROM f WHERE i > 0""",
)
def sp4(spark, d):
    return _sp4(table(spark, d, "orders"))


@add("sp4_greedy_group_split_whole")
def sp4_whole(spark, d):
    return _sp4(table(spark, d, "orders"))


def _sp4(orders):
    sizes = orders.groupBy(F.col("o_orderpriority").alias("fam"), F.col("o_custkey").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return S.group_split(sizes, "fam", "grp", "n", 4, {"train": 8, "val": 1, "test": 1}).select("fam", F.col("grp").cast("long").alias("grp"), "split")


_LABELS = ("en", "fr", "de", "es")
_LACK = "list_transform([7, 2, 1], lambda p, i: p * x.total - 10 * (CASE WHEN x.lno = r.lno THEN r.have ELSE [0, 0, 0] END)[i])"
_TO = f"(CASE WHEN x.free THEN list_position({_LACK}, list_max({_LACK})) ELSE r.pins[x.key] END)"


@add(
    "sp5_pinned_group_split",
    f"""WITH RECURSIVE s AS (SELECT lang AS label, source AS grp, coalesce(source, '?') AS key, list_position({list(_LABELS)}, lang) AS lno, count(*) AS n FROM documents WHERE lang IN {_LABELS} GROUP BY 1, 2),
x AS (SELECT *, lno = first AS free, row_number() OVER (ORDER BY lno, lno = first, -n, grp NULLS FIRST) AS i FROM (SELECT *, sum(n) OVER (PARTITION BY label) AS total, min(lno) OVER (PARTITION BY key) AS first FROM s)),
r AS (SELECT 0::BIGINT AS i, 0 AS lno, [0, 0, 0]::BIGINT[] AS have, MAP {{'': 0}} AS pins, NULL::VARCHAR AS label, NULL::VARCHAR AS grp, 0 AS went
UNION ALL SELECT x.i, x.lno::INT, list_transform(CASE WHEN x.lno = r.lno THEN r.have ELSE [0, 0, 0] END, lambda h, j: h + CASE WHEN j = {_TO} THEN x.n ELSE 0 END)::BIGINT[], map_concat(r.pins, MAP {{x.key: {_TO}::INT}}), x.label, x.grp, {_TO}::INT FROM r JOIN x ON x.i = r.i + 1)
SELECT label, grp, ['train', 'val', 'test'][went] AS split FROM r WHERE i > 0""",
)
def sp5(spark, d):
    sizes = table(spark, d, "documents").groupBy(F.col("lang").alias("label"), F.col("source").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return S.pinned_split(sizes, list(_LABELS), [("train", 7), ("val", 2), ("test", 1)])


@add("sp6_majority_split", "WITH n AS (SELECT o_custkey, o_orderstatus AS split, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, split DESC) AS r FROM n) SELECT o_custkey, split AS majority FROM r WHERE r = 1")
def sp6(spark, d):
    return S.majority(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "split"), "o_custkey", "split")


@add("sp7_leak_repair", C + ", n AS (SELECT group_id, split, count(*) AS n FROM clips WHERE bucket <> 'silence' AND group_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, CASE split WHEN 'val' THEN 1 WHEN 'test' THEN 2 ELSE 3 END) AS r FROM n) SELECT doc_id, CASE WHEN bucket <> 'silence' THEN coalesce(r.split, clips.split) ELSE clips.split END AS fixed FROM clips LEFT JOIN r ON r.group_id = clips.group_id AND r = 1")
def sp7(spark, d):
    return S.repair(clips(spark, d), "group_id", "split", ["val", "test", "train"], F.col("bucket") != "silence").select("doc_id", "fixed")


@add("sp8_hash_split", f"SELECT c_custkey, CASE WHEN {number_sql(draw_sql(2, 'hash', 'c_custkey'))} % 10 < 1 THEN 'val' ELSE 'train' END AS split FROM customer")
def sp8(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.hash_split(F.col("c_custkey"), 2).alias("split"))


@add("sp9_rounded_split", f"WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {draw_sql(7, 'round', 'c_custkey')}) - 1 AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, CASE WHEN r < round_even(n * 0.7, 0) THEN 'train' WHEN r < round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split FROM r")
def sp9(spark, d):
    return S.rounded_split(table(spark, d, "customer"), "c_mktsegment", "c_custkey", 7, [("train", 0.7), ("val", 0.15), ("test", 0.15)]).select("c_custkey", "split")


@add(
    "sp10_voice_split",
    """WITH ids AS (SELECT c_nationkey AS no, count(*) AS n FROM customer GROUP BY 1), a AS (SELECT [x.no, y.no, z.no] AS ids, x.n + y.n + z.n AS s FROM ids x JOIN ids y ON y.no > x.no JOIN ids z ON z.no > y.no), b AS (SELECT [x.no, y.no] AS ids, x.n + y.n AS s FROM ids x JOIN ids y ON y.no > x.no),
p AS (SELECT abs(100 * a.s - 30 * t) + abs(100 * b.s - 8 * t) AS err, a.ids AS ta, b.ids AS vb FROM a, b, (SELECT sum(n) AS t FROM ids) WHERE NOT list_has_any(a.ids, b.ids))
SELECT err::BIGINT AS err, array_to_string(ta, ',') AS test_ids, array_to_string(vb, ',') AS val_ids FROM p ORDER BY p.err, ta, vb LIMIT 1""",
)
def sp10(spark, d):
    return _sp10(table(spark, d, "customer"))


@add("sp10_voice_split_whole")
def sp10_whole(spark, d):
    return _sp10(table(spark, d, "customer"))


def _sp10(customers):
    ids = customers.groupBy(F.col("c_nationkey").alias("no")).agg(F.count(F.lit(1)).alias("n"))
    return S.voice_split(ids, 3, 2)


@add("sp11_capped_sample", C + f", g AS (SELECT bucket, count(DISTINCT source) AS g FROM clips GROUP BY 1), r AS (SELECT doc_id, bucket, source, row_number() OVER (PARTITION BY bucket, source ORDER BY {draw_sql(3, 'cap', 'doc_id')}) AS r FROM clips), o AS (SELECT doc_id, bucket, source, row_number() OVER (PARTITION BY r.bucket ORDER BY CASE WHEN r > ceil(90.0 / g) THEN r - ceil(90.0 / g) ELSE 0 END, source, r) AS o FROM r JOIN g USING (bucket)) SELECT doc_id, bucket, source FROM o WHERE o <= 90")
def sp11(spark, d):
    return S.capped_sample(clips(spark, d).select("doc_id", "bucket", "source"), "bucket", "source", "doc_id", 90, 3)


def _robin(src: str, by: str, voice: str, key: str, cap: int, seed: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY r_, {draw_sql(seed, 'voice', voice)}, {key}) AS o_ FROM (SELECT *, row_number() OVER (PARTITION BY {by}, {voice} ORDER BY {draw_sql(seed, 'pick', key)}) AS r_ FROM {src})) WHERE o_ <= {cap})"


@add("sp12_round_robin", C + f" SELECT doc_id, split, label FROM {_robin('clips', 'split, label', 'source', 'doc_id', 8, 5)}")
def sp12(spark, d):
    return S.round_robin(clips(spark, d).select("doc_id", "split", "label", "source"), ["split", "label"], "source", "doc_id", 8, 5).select("doc_id", "split", "label")


@add("sp13_row_budget", C + f", b AS (SELECT doc_id, split, doc_id % 3 = 0 AS w, coalesce(sum(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY split ORDER BY {draw_sql(6, 'budget', 'doc_id')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM clips) SELECT doc_id, split, w AND c + 2 <= 61 AS noisy FROM b WHERE c < 61")
def sp13(spark, d):
    return S.budget(clips(spark, d).select("doc_id", "split"), "split", "doc_id", F.col("doc_id") % 3 == 0, 61, 6)


_FAM = "fam AS (SELECT bucket, source, count(*) - 1 AS pool FROM clips GROUP BY 1, 2), ff AS (SELECT *, least(greatest(70 - count(*) OVER (PARTITION BY bucket), 0), sum(pool) OVER (PARTITION BY bucket)) AS want, sum(pool) OVER (PARTITION BY bucket) AS pp FROM fam)"


@add("sp14_family_draw", C + f", {_FAM}, q AS {remainder_sql('(SELECT * FROM ff WHERE pp > 0)', 'bucket', 'source', 'pool', 'want')}, r AS (SELECT doc_id, bucket, source, row_number() OVER (PARTITION BY bucket, source ORDER BY {draw_sql(8, 'family', 'doc_id')}) AS r FROM clips) SELECT doc_id, r.bucket, r.source FROM r LEFT JOIN q ON q.bucket = r.bucket AND q.source = r.source WHERE r <= 1 + coalesce(least(n, pool), 0)")
def sp14(spark, d):
    return S.family_draw(clips(spark, d).select("doc_id", "bucket", "source"), "bucket", "source", "doc_id", 70, 8).select("doc_id", "bucket", "source")


@add("sp15_proportional_sample", f"WITH s AS (SELECT c_mktsegment, count(*) AS pool FROM customer GROUP BY 1), q AS {remainder_sql('s', '', 'c_mktsegment', 'pool', '101')}, r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {draw_sql(9, 'prop', 'c_custkey')}) AS r FROM customer) SELECT c_custkey, c_mktsegment FROM r JOIN q USING (c_mktsegment) WHERE r <= n")
def sp15(spark, d):
    return S.proportional_sample(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 101, 9)


@add("sp16_seeded_sample", f"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)clown') ORDER BY {draw_sql(1, 'sample', 'doc_id')}, doc_id LIMIT 50")
def sp16(spark, d):
    return S.sample(table(spark, d, "documents").where(~F.col("text").rlike("(?i)clown")).select("doc_id"), "doc_id", 50, 1)


@add("sp17_prefix_sample", f"WITH r AS (SELECT doc_id, lang, split_part(text, ' ', 1) AS prefix, row_number() OVER (PARTITION BY lang, split_part(text, ' ', 1) ORDER BY {draw_sql('s', 'capped', 'lang', 'split_part(text, chr(32), 1)', 'doc_id')}) AS r FROM documents) SELECT doc_id, lang, prefix FROM r WHERE r <= 3")
def sp17(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", F.split_part("text", F.lit(" "), F.lit(1)).alias("prefix"))
    return S.capped(x, ["lang", "prefix"], "doc_id", 3, "s")


@add("sp18_first_and_focus", C + " SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS r FROM clips) WHERE r <= 30 OR label IN ('INTENT_2', 'INTENT_5')")
def sp18(spark, d):
    return S.first_and_focus(clips(spark, d).select("doc_id", "label"), "label", "doc_id", 30, ["INTENT_2", "INTENT_5"])


@add("sp19_gap_fill", C + ", h AS (SELECT label, count(*) AS n FROM clips GROUP BY 1), j AS (SELECT label, ceil(greatest(120 - n, 0) * 1.2)::INT AS jobs FROM h), f AS (SELECT *, coalesce(sum(jobs) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM j) SELECT label, i::INT AS i, ((first + i) % 7)::BIGINT AS voice FROM (SELECT label, first, unnest(range(0, jobs)) AS i FROM f WHERE jobs > 0)")
def sp19(spark, d):
    have = clips(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return S.gap_fill(have, "label", 120, 1.2, 7)


@add(
    "sp20_job_plan",
    C + f""", dd AS (SELECT split, greatest(count(*) FILTER (bucket <> 'babble') - count(*) FILTER (bucket = 'babble'), 0) AS deficit FROM clips GROUP BY 1), num AS (SELECT split, doc_id, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY split) AS size FROM clips),
j AS (SELECT split, unnest(range(0, floor(deficit * 1.1 + 0.999)::INT)) AS i FROM dd), k AS (SELECT j.split, i, {number_sql(draw_sql(5, 'row', 'j.split', 'i'))} % size AS pos FROM j JOIN (SELECT DISTINCT split, size FROM num) s ON s.split = j.split)
SELECT k.split, i::INT AS i, doc_id, (i % 9)::INT AS voice, {uniform_sql(5, 'noisy', 'k.split', 'i')} < 0.5 AS noisy FROM k JOIN num ON num.split = k.split AND num.pos = k.pos""",
)
def sp20(spark, d):
    from ..operators.metrics import deficit

    c = clips(spark, d)
    return S.job_plan(deficit(c, "split", F.col("bucket") == "babble"), c.select("split", "doc_id"), "split", "doc_id", 1.1, 9, 0.5, 5)


_V = "v AS (SELECT s_suppkey AS voice, CASE WHEN s_suppkey % 3 = 0 THEN 'train' ELSE 'test' END AS split, CASE WHEN s_suppkey % 4 = 0 THEN 'reference' ELSE 'own' END AS origin FROM supplier), sp AS (SELECT DISTINCT split FROM v)"


@add("sp21_voice_pool", f"WITH {_V} SELECT 'all' AS mode, split, voice FROM v UNION ALL SELECT 'references', sp.split, voice FROM sp, v WHERE origin = 'reference' UNION ALL SELECT 'own', split, voice FROM v WHERE origin = 'own'")
def sp21(spark, d):
    v = table(spark, d, "supplier").selectExpr("s_suppkey AS voice", "CASE WHEN s_suppkey % 3 = 0 THEN 'train' ELSE 'test' END AS split", "CASE WHEN s_suppkey % 4 = 0 THEN 'reference' ELSE 'own' END AS origin")
    parts = v.select("split").distinct()
    one = lambda m: S.voice_pool(v, parts, m).select(F.lit(m).alias("mode"), "split", "voice")
    return one("all").unionByName(one("references")).unionByName(one("own"))


def _turned(x: str, i: int) -> str:
    """One round of the permutation in SQL, from columns l, r to l, r."""
    mixed = lambda half: number_sql(draw_sql(2, "pair", "clip", str(i), half))
    return f"(SELECT * EXCLUDE (l, r), {f'(l + {mixed(chr(114))}) % a AS l, r' if i % 2 == 0 else f'l, (r + {mixed(chr(108))}) % b AS r'} FROM {x})"


def _once(x: str) -> str:
    """x: a relation with columns x, a, b, clip and others; x goes once through the permutation."""
    inner = f"(SELECT *, x // b AS l, x % b AS r FROM {x})"
    for i in range(4):
        inner = _turned(inner, i)
    return f"(SELECT * EXCLUDE (l, r) REPLACE (l * b + r AS x) FROM {inner})"


_PAIRS = f"""WITH RECURSIVE sz AS (SELECT *, ceil(np / a::DOUBLE)::BIGINT AS b FROM (SELECT count(*) AS np, ceil(sqrt(count(*)))::BIGINT AS a FROM supplier)),
pn AS (SELECT s_suppkey AS persona, row_number() OVER (ORDER BY {draw_sql(2, 'persona', 's_suppkey')}) - 1 AS x FROM supplier),
c AS (SELECT p_type AS label, p_partkey AS clip, row_number() OVER (PARTITION BY p_type ORDER BY {draw_sql(2, 'clip', 'p_type', 'p_partkey')}) - 1 AS i, count(*) OVER (PARTITION BY p_type) AS nc FROM part),
k AS (SELECT label, clip, unnest(range(ceil((least(25, nc * np) - i) / nc::DOUBLE)::BIGINT)) AS x, a, b, np FROM c, sz WHERE i < least(25, nc * np)),
w AS (SELECT * FROM {_once('k')} UNION ALL SELECT * FROM {_once('(SELECT * FROM w WHERE x >= np)')})
SELECT label, clip, persona FROM w JOIN pn USING (x) WHERE x < np"""


@add("sp22_even_pairs", _PAIRS)
def sp22(spark, d):
    return _sp22(table(spark, d, "part"), table(spark, d, "supplier"))


@add("sp22_even_pairs_whole")
def sp22_whole(spark, d):
    return _sp22(table(spark, d, "part"), table(spark, d, "supplier"))


def _sp22(parts, suppliers):
    c = parts.select(F.col("p_type").alias("label"), F.col("p_partkey").alias("clip"))
    p = suppliers.select(F.col("s_suppkey").alias("persona"))
    return S.even_pairs(c, p, "label", "clip", "persona", 25, 2)


_P23 = "pool AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) - 1 AS pos, s_suppkey AS chunk, count(*) OVER (PARTITION BY s_suppkey % 3) AS size FROM supplier)"


@add(
    "sp23_mix_plan",
    C + f", {_P23}, x AS (SELECT clips.split, doc_id, size, {number_sql(draw_sql(4, 'c1', 'doc_id'))} % size AS one, {number_sql(draw_sql(4, 'c2', 'doc_id'))} % (size - 1) AS h2 FROM clips JOIN (SELECT DISTINCT split, size FROM pool) s ON s.split = clips.split WHERE {uniform_sql(4, 'mix', 'doc_id')} < 0.4), y AS (SELECT split, doc_id, 1 AS attempt, one AS pos FROM x UNION ALL SELECT split, doc_id, 2, (one + 1 + h2) % size FROM x) SELECT y.split, doc_id, attempt, chunk, round(-5 + {uniform_sql(4, 'snr', 'doc_id', 'attempt')} * 20, 6) AS snr_db FROM y JOIN pool ON pool.split = y.split AND pool.pos = y.pos",
)
def sp23(spark, d):
    from pyspark.sql import Window

    pool = table(spark, d, "supplier").selectExpr("CASE s_suppkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split", "s_suppkey AS chunk")
    pool = pool.withColumn("pos", F.row_number().over(Window.partitionBy("split").orderBy("chunk")) - 1)
    return S.mix_plan(clips(spark, d).select("split", "doc_id"), "split", "doc_id", pool, 0.4, -5, 15, 4)


def _step(name: str, p: float, free: str) -> str:
    n = f"count(*) FILTER ({free}) OVER (PARTITION BY bucket)"
    return f"({free}) AND row_number() OVER (PARTITION BY bucket ORDER BY CASE WHEN {free} THEN 0 ELSE 1 END, {draw_sql(6, 'step', '1', chr(39) + name + chr(39), 'doc_id')}) <= floor({n} * {p}) + CASE WHEN {uniform_sql(6, 'frac', '1', 'bucket', chr(39) + name + chr(39))} < {n} * {p} - floor({n} * {p}) THEN 1 ELSE 0 END AS {name}"


@add("sp24_perturbation_plan", C + f" SELECT doc_id, bucket, {_step('stretch', 0.33, 'TRUE')}, {_step('noise', 0.517, 'doc_id % 11 <> 0')} FROM clips")
def sp24(spark, d):
    return S.step_plan(clips(spark, d).select("doc_id", "bucket"), "bucket", "doc_id", {"stretch": 0.33, "noise": 0.517}, 6, 1, {"noise": F.col("doc_id") % 11 == 0})


@add("sp25_latin_spread", C + f" SELECT doc_id, round(-10 + (row_number() OVER (PARTITION BY label ORDER BY {draw_sql(3, 'rank', 'doc_id')}) - 1 + {uniform_sql(3, 'u', 'doc_id')}) / count(*) OVER (PARTITION BY label) * 30, 6) AS value FROM clips")
def sp25(spark, d):
    return S.spread(clips(spark, d), "label", "doc_id", -10, 20, 3).select("doc_id", "value")


@add("sp26_deck_dealing", C + f", r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1 AS r FROM clips), x AS (SELECT doc_id, label, (r // 25)::INT AS deck, r % 25 AS pos FROM r), k AS (SELECT label, deck, n_nationkey AS item, row_number() OVER (PARTITION BY label, deck ORDER BY {draw_sql(9, 'deck', 'label', 'deck', 'n_nationkey')}) - 1 AS pos FROM (SELECT DISTINCT label, deck FROM x), nation) SELECT doc_id, label, deck, item FROM x JOIN k USING (label, deck, pos)")
def sp26(spark, d):
    return S.deal(clips(spark, d).select("doc_id", "label"), "doc_id", "doc_id", table(spark, d, "nation").select(F.col("n_nationkey").alias("item")), 9, "label").drop("pos")


@add("sp27_fixed_spec", f"SELECT doc_id, {number_sql(draw_sql(7, 'rir', 'doc_id'))} % 40 AS rir, {number_sql(draw_sql(7, 'noise', 'doc_id'))} % 90 AS noise, round(0 + {uniform_sql(7, 'snr', 'doc_id')} * 15, 6) AS snr_db FROM documents")
def sp27(spark, d):
    return table(spark, d, "documents").select("doc_id", *S.fixed_spec(F.col("doc_id"), 7, 40, 90, 0, 15))


@add("sp28_session_plan", C + f", x AS (SELECT doc_id, duration, {number_sql(draw_sql(8, 'wake', 'doc_id'))} % 12 AS wake, {number_sql(draw_sql(8, 'bed', 'doc_id'))} % 5 AS bed, round(0.5 + {uniform_sql(8, 'lead', 'doc_id')}, 3) AS lead_s, round(0.2 + {uniform_sql(8, 'gap', 'doc_id')} * 0.8, 3) AS gap_s FROM clips) SELECT doc_id, wake, bed, lead_s, gap_s, round(lead_s + 1.0 + gap_s, 3) AS command_start_s, round(round(lead_s + 1.0 + gap_s, 3) + duration, 3) AS speech_end_s FROM x")
def sp28(spark, d):
    return S.session_plan(clips(spark, d).select("doc_id", "duration"), "doc_id", 8, 12, 5).drop("duration")


@add("sp29_unit_timeline", C + f", x AS (SELECT doc_id, source, {draw_sql(5, 'order', 'doc_id')} AS h, duration + round(1 + {uniform_sql(5, 'dist', 'doc_id')} * 7, 3) AS step FROM clips), o AS (SELECT doc_id, source, h, round(coalesce(sum(step) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS offset_s FROM x) SELECT doc_id, source, offset_s, lead(offset_s) OVER (PARTITION BY source ORDER BY h) AS range_end_s FROM o")
def sp29(spark, d):
    return S.timeline(clips(spark, d).select("doc_id", "source", "duration"), "source", "doc_id", "duration", 5).drop("duration")


@add(
    "sp30_prompt_packing",
    """WITH RECURSIVE x AS (SELECT o_custkey AS spk, o_orderkey AS k, (o_totalprice / 200)::INT AS ms, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey) AS i FROM orders),
f AS (SELECT spk, 0::BIGINT AS i, 0 AS len, ''::VARCHAR AS out FROM (SELECT DISTINCT spk FROM x)
UNION ALL SELECT spk, i, CASE WHEN take THEN longer ELSE len END, CASE WHEN take THEN out || CASE WHEN out = '' THEN '' ELSE ',' END || k ELSE out END FROM (SELECT f.spk, x.i, len, out, k, len + ms + CASE WHEN out = '' THEN 0 ELSE 150 END AS longer, len < 8000 AND len + ms + CASE WHEN out = '' THEN 0 ELSE 150 END <= 12000 AS take FROM f JOIN x ON x.spk = f.spk AND x.i = f.i + 1)),
l AS (SELECT *, row_number() OVER (PARTITION BY spk ORDER BY i DESC) AS r FROM f) SELECT spk, len AS ms, out AS clips FROM l WHERE r = 1 AND len >= 8000""",
)
def sp30(spark, d):
    return _sp30(table(spark, d, "orders"))


@add("sp30_prompt_packing_whole")
def sp30_whole(spark, d):
    return _sp30(table(spark, d, "orders"))


def _sp30(orders):
    x = orders.select(F.col("o_custkey").alias("spk"), F.when(F.col("o_orderstatus") == "F", "read").otherwise("clip").alias("kind"), F.col("o_orderkey").alias("k"), F.bround(F.col("o_totalprice") / 200).cast("int").alias("ms"))
    return S.prompt_pack(x, "spk", "kind", "k", "ms")


@add("sp31_chunk_plan", f"WITH c AS (SELECT DISTINCT p_type AS colour FROM part), b AS (SELECT r_name AS band, r_regionkey * -10.0 AS lo, r_regionkey * -10.0 + 5 AS hi FROM region), q AS {remainder_sql('(SELECT colour || chr(47) || band AS cell, lo, hi, 1 AS w FROM c, b)', '', 'cell', 'w', '100')}, x AS (SELECT cell, lo, hi, unnest(range(0, n::INT)) AS i FROM q) SELECT cell, i::INT AS i, round(2 + {uniform_sql(6, 'dur', 'cell', 'i')} * 8, 6) AS duration, round(lo + {uniform_sql(6, 'lev', 'cell', 'i')} * (hi - lo), 6) AS level FROM x")
def sp31(spark, d):
    bands = table(spark, d, "region").select(F.col("r_name").alias("band"), (F.col("r_regionkey") * -10.0).alias("lo"), (F.col("r_regionkey") * -10.0 + 5).alias("hi"))
    return S.chunk_plan(table(spark, d, "part").select(F.col("p_type").alias("colour")).distinct(), bands, 100, 6)


@add("sp32_small_cut", C + f", x AS (SELECT doc_id, split, bucket, source_dataset LIKE '%ambient' AS noise FROM clips), r AS (SELECT *, row_number() OVER (PARTITION BY split, bucket, noise ORDER BY {draw_sql(4, 'capped', 'split', 'bucket', 'noise', 'doc_id')}) AS r FROM x) SELECT doc_id, split, bucket, noise FROM r WHERE r <= 5")
def sp32(spark, d):
    x = clips(spark, d).select("doc_id", "split", "bucket", F.col("source_dataset").endswith("ambient").alias("noise"))
    return S.capped(x, ["split", "bucket", "noise"], "doc_id", 5, 4)


@add("sp33_split_application", C + ", g AS (SELECT source AS group_id, CASE WHEN max(doc_id) % 4 = 0 THEN 'val' WHEN max(doc_id) % 4 = 1 THEN 'test' ELSE 'train' END AS s FROM documents GROUP BY 1), x AS (SELECT doc_id, bucket, source_dataset LIKE '%ambient' AS aug, CASE WHEN bucket = 'silence' THEN 'train' ELSE s END AS s FROM clips LEFT JOIN g USING (group_id)) SELECT doc_id, s AS new_split, CASE WHEN s IS NULL THEN 'missing_split' WHEN aug AND s <> 'train' THEN 'augmented_held_out' END AS reason FROM x")
def sp33(spark, d):
    g = table(spark, d, "documents").groupBy(F.col("source").alias("group_id")).agg(F.max("doc_id").alias("m")).selectExpr("group_id", "CASE WHEN m % 4 = 0 THEN 'val' WHEN m % 4 = 1 THEN 'test' ELSE 'train' END AS split")
    return S.apply_split(clips(spark, d).drop("split"), g, "group_id", F.col("bucket") == "silence", F.col("source_dataset").endswith("ambient")).select("doc_id", "new_split", "reason")


# the same queries under their second names
for _name in ("sp4_greedy_group_split", "sp10_voice_split", "sp22_even_pairs", "sp30_prompt_packing"):
    BOOK.oracles[f"{_name}_whole"] = BOOK.oracles[_name]
