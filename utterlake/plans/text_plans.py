"""Queries of the text and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from .common import SPELL_LIST, Book, table

BOOK = Book()
add = BOOK.add
LIT = "translate(lower({}), '‘’ʼ', '''''''')"
SQUEEZE = "trim(regexp_replace({}, ' +', ' ', 'g'))"


def _norm(c: str, keep: str = "a-z '''") -> str:
    return SQUEEZE.format(f"regexp_replace({LIT.format(c)}, '[^{keep[:-1]}]', ' ', 'g')")


N1 = SQUEEZE.format("regexp_replace(" + LIT.format("{0}") + ", '[^a-z '']', ' ', 'g')")
N2 = SQUEEZE.format("regexp_replace(" + LIT.format("{0}") + ", '[^a-z0-9'' ]', ' ', 'g')")


@add("st1_normalize_text", f"SELECT doc_id, md5(n) AS norm_md5, length(n) AS norm_len FROM (SELECT doc_id, {N1.format('text')} AS n FROM documents)")
def st1(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("n")).select("doc_id", F.md5("n").alias("norm_md5"), F.length("n").alias("norm_len"))


@add("st2_normalize_digits", f"SELECT doc_id, md5(n) AS norm_md5 FROM (SELECT doc_id, {N2.format('text')} AS n FROM documents)")
def st2(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_digits(F.col("text"))).alias("norm_md5"))


_ALIAS = SQUEEZE.format(
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + LIT.format("t") + r", '%', ' percent ', 'g'), '\b([ap])\.m\.', '\1m', 'g'), '([0-9]+):00', '\1', 'g'), '([0-9])([ap]m)\b', '\1 \2', 'g'), '[^a-z0-9'' ]', ' ', 'g')"
)
_PART_TEXT = "concat(p_name, ' at ', p_size, CASE WHEN p_partkey % 3 = 0 THEN ':00 a.m. 50%' WHEN p_partkey % 3 = 1 THEN 'pm' ELSE ' P.M.' END)"


@add("st3_alias_normalize", f"SELECT p_partkey, {_ALIAS} AS said FROM (SELECT p_partkey, {_PART_TEXT} AS t FROM part)")
def st3(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"{_PART_TEXT} AS t").select("p_partkey", T.alias_normalize(F.col("t")).alias("said"))


_BIG = "list_filter(regexp_extract_all({}, '[0-9]+'), lambda v: length(regexp_replace(v, '^0+', '')) > 3 OR coalesce(try_cast(v AS HUGEINT), 0) > 100)"


@add(
    "st4_normalize_unknown",
    f"SELECT doc_id, md5(CASE WHEN NOT contains(text, '#') AND len({_BIG.format('text')}) = 0 THEN {N2.format(chr(114) + 'egexp_replace(regexp_replace(text, ' + chr(39) + '@' + chr(39) + ', ' + chr(39) + ' at ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + '&' + chr(39) + ', ' + chr(39) + ' and ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} END) AS norm_md5 FROM documents",
)
def st4(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_unknown(F.col("text"))).alias("norm_md5"))


_NUM_TEXT = "concat(p_name, ' ', p_size, ':00 of ', CAST(floor(p_retailprice / 20) AS INT))"
_SPELL = f"CASE WHEN len({_BIG.format('t')}) = 0 THEN array_to_string(list_transform(list_zip(regexp_split_to_array(t, '[0-9]+'), regexp_extract_all(t, '[0-9]+')), lambda z: z[1] || coalesce(({SPELL_LIST})[try_cast(z[2] AS INT) + 1], '')), '') END"


@add("st5_spell_numbers", f"SELECT p_partkey, {_SPELL} AS said FROM (SELECT p_partkey, regexp_replace({_NUM_TEXT}, ':00', '', 'g') AS t FROM part)")
def st5(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"{_NUM_TEXT} AS t").select("p_partkey", T.spell_numbers(F.col("t")).alias("said"))


@add("st6_phrase_key", f"SELECT p_partkey, {N1.format('said')} AS key FROM (SELECT p_partkey, {_SPELL} AS said FROM (SELECT p_partkey, regexp_replace({_NUM_TEXT}, ':00', '', 'g') AS t FROM part))")
def st6(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"{_NUM_TEXT} AS t").select("p_partkey", T.phrase_key(F.col("t")).alias("key"))


_SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@add("st7_derived_names", f"SELECT p_partkey, {_SLUG.format('p_name')} AS slug, {_SLUG.format('p_brand')} || '__' || {_SLUG.format('p_name')} || '__amb' || (p_partkey % 2 + 1) || '-' || p_size || '.wav' AS name FROM part")
def st7(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", T.slug(F.col("p_name")).alias("slug"), T.derived_name(T.slug(F.col("p_brand")), T.slug(F.col("p_name")), F.col("p_partkey") % 2 + 1, F.col("p_size")).alias("name"))


def phrases(spark, d):
    """A phrase dictionary from part types (intents) and sizes (slot values, as digits and in words)."""
    p = table(spark, d, "part")
    kinds = p.select(F.upper("p_type").alias("intent"), F.when(F.length("p_type") > 5, F.lit("level")).alias("slot"), F.concat(F.lit("make it "), F.lower("p_type"), F.when(F.length("p_type") > 5, F.lit(" {}")).otherwise(F.lit(""))).alias("template")).distinct()
    sizes = p.where("p_size <= 20").select(F.col("p_size").cast("string").alias("value")).distinct()
    words = F.array(*[F.lit(w) for w in T.SPELLED])
    said = sizes.select("value", F.explode(F.array(F.col("value"), F.get(words, F.col("value").cast("int")))).alias("said")).withColumn("slot", F.lit("level"))
    return T.phrase_table(kinds, said)


PHRASES = f"""kinds AS (SELECT DISTINCT upper(p_type) AS intent, length(p_type) > 5 AS s, lower(p_type) AS t FROM part),
vals AS (SELECT DISTINCT p_size AS v FROM part WHERE p_size <= 20),
phrases AS (
  SELECT DISTINCT 'make it ' || t || ' ' || said AS text, intent, 'level' AS slot, v::VARCHAR AS value
  FROM kinds, (SELECT v, unnest([v::VARCHAR, ({SPELL_LIST})[v + 1]]) AS said FROM vals) WHERE s
  UNION SELECT 'make it ' || t, intent, NULL, NULL FROM kinds WHERE NOT s)"""
PREFIXES = "prefixes AS (SELECT DISTINCT array_to_string(w[1:n], ' ') AS prefix, n::INT AS n_words FROM (SELECT w, unnest(range(1, len(w))) AS n FROM (SELECT string_split(text, ' ') AS w FROM phrases)))"


@add("st8_phrase_table", f"WITH {PHRASES} SELECT * FROM phrases")
def st8(spark, d):
    return phrases(spark, d)


@add("st9_incomplete_prefixes", f"WITH {PHRASES}, {PREFIXES} SELECT * FROM prefixes WHERE prefix NOT IN (SELECT text FROM phrases)")
def st9(spark, d):
    return T.incomplete_prefixes(phrases(spark, d))


@add("st10_phrase_sets", f"WITH {PHRASES}, {PREFIXES} SELECT DISTINCT text, NOT contains(text, ' ') AS single_word, text IN (SELECT prefix FROM prefixes) AS strict_prefix FROM phrases")
def st10(spark, d):
    return T.phrase_sets(phrases(spark, d))


@add("st12_slot_parsing", "SELECT c_custkey, try_cast(nullif(regexp_extract(t, '^\\s*([0-9]{1,9})', 1), '') AS INT) AS n, try_cast(nullif(regexp_extract(t, '^\\s*([0-9]{1,9})', 1), '') AS INT) * CASE regexp_extract(lower(t), '(second|minute|hour)', 1) WHEN 'second' THEN 1 WHEN 'minute' THEN 60 WHEN 'hour' THEN 3600 END AS secs FROM (SELECT c_custkey, concat(c_nationkey, CASE c_custkey % 4 WHEN 0 THEN ' minutes' WHEN 1 THEN ' Seconds' WHEN 2 THEN ' hours' ELSE ' x' END) AS t FROM customer)")
def st12(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", "concat(c_nationkey, CASE c_custkey % 4 WHEN 0 THEN ' minutes' WHEN 1 THEN ' Seconds' WHEN 2 THEN ' hours' ELSE ' x' END) AS t")
    return c.select("c_custkey", T.leading_int(F.col("t")).alias("n"), T.seconds(F.col("t")).alias("secs"))


@add("st13_display_label", "SELECT l_orderkey, l_linenumber, upper(l_returnflag) || ' Item' || CASE WHEN l_linestatus = 'F' THEN '' ELSE ' (' || l_linestatus || ')' END AS shown FROM lineitem")
def st13(spark, d):
    x = table(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", T.display_label(F.concat("l_returnflag", F.lit("_ITEM")), F.when(F.col("l_linestatus") != "F", F.col("l_linestatus"))).alias("shown"))


def probs(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("p"))


P = "p AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS p FROM embeddings)"


@add("ar1_argmax", f"WITH {P} SELECT vec_id, list_position(p, list_max(p)) - 1 AS best, list_max(p) AS top FROM p")
def ar1(spark, d):
    return probs(spark, d).select("vec_id", A.argmax(F.col("p")).alias("best"), F.array_max("p").alias("top"))


@add("ar2_top_k", f"WITH {P}, x AS (SELECT vec_id, label, unnest(range(0, 10)) AS i, unnest(p) AS v FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS r FROM x) SELECT vec_id, array_to_string(list(i ORDER BY r), ',') AS best, bool_or(i = label) AS hit FROM r WHERE r <= 3 GROUP BY vec_id")
def ar2(spark, d):
    top = A.top_k(F.col("p"), 3)
    return probs(spark, d).select("vec_id", F.array_join(top, ",").alias("best"), F.array_contains(top, F.col("label")).alias("hit"))


@add("ar3_softmax", f"WITH {P}, x AS (SELECT vec_id, unnest(range(0, 10)) AS i, unnest(p) AS v FROM p), s AS (SELECT vec_id, i, v, exp(v - max(v) OVER w) AS e, max(v) OVER w AS m FROM x WINDOW w AS (PARTITION BY vec_id)) SELECT vec_id, i::INT AS i, round(e / sum(e) OVER w, 6) AS p, round(v - m - ln(sum(e) OVER w), 6) AS logp FROM s WINDOW w AS (PARTITION BY vec_id)")
def ar3(spark, d):
    both = probs(spark, d).select("vec_id", F.posexplode(F.arrays_zip(A.softmax(F.col("p")).alias("a"), A.log_softmax(F.col("p")).alias("b"))).alias("i", "x"))
    return both.select("vec_id", "i", F.round("x.a", 6).alias("p"), A.rounded(F.col("x.b"), 6).alias("logp"))


@add(
    "ar4_snr_mix",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a, list_transform(embedding[40:64], lambda x: x::DOUBLE) AS b FROM embeddings),
x AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(a) AS s, b FROM e), y AS (SELECT vec_id, i, s, b[(i + vec_id % 5) % 25 + 1] AS n FROM x),
q AS (SELECT *, sum(s * s) OVER w / 64 AS ps, sum(n * n) OVER w / 64 AS pn FROM y WINDOW w AS (PARTITION BY vec_id))
SELECT vec_id, round(sum(CASE WHEN ps > 0 AND pn > 0 THEN s + n * sqrt(ps / (pn * pow(10.0, (vec_id % 7) / 10.0))) ELSE s END * (i + 1)), 5) AS mixed FROM q GROUP BY vec_id""",
)
def ar4(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"), F.transform(F.slice("embedding", 40, 25), lambda x: x.cast("double")).alias("b"))
    m = e.select("vec_id", A.snr_mix(F.col("a"), F.col("b"), F.col("vec_id") % 7, (F.col("vec_id") % 5).cast("int")).alias("m"))
    return m.select("vec_id", A.rounded(A.total(F.transform("m", lambda x, i: x * (i + 1))), 5).alias("mixed"))


@add("ar5_levels", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / 64), 6) AS rms, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS peak, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) >= 0.999 AS clipped FROM embeddings")
def ar5(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    a = F.col("a")
    return e.select("vec_id", F.round(A.rms(a), 6).alias("rms"), F.round(A.peak(a), 6).alias("peak"), A.clipped(a).alias("clipped"))


@add(
    "ar6_placement",
    """WITH z AS (SELECT vec_id, list_transform(embedding[1:(vec_id % 12 + 1)], lambda x: round(x::DOUBLE, 6)) AS a FROM embeddings),
c AS (SELECT vec_id, CASE WHEN len(a) > 8 THEN a[((len(a) - 8) // 2 + 1):((len(a) - 8) // 2 + 8)] ELSE a END AS a FROM z),
f AS (SELECT vec_id, a, 8 - len(a) AS n FROM c)
SELECT vec_id, a || list_transform(range(0, n), lambda x: 0.0::DOUBLE) AS l, list_transform(range(0, n), lambda x: 0.0::DOUBLE) || a AS r, list_transform(range(0, n // 2), lambda x: 0.0::DOUBLE) || a || list_transform(range(0, n - n // 2), lambda x: 0.0::DOUBLE) AS c FROM f""",
)
def ar6(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", F.lit(1), (F.col("vec_id") % 12 + 1).cast("int")), lambda x: A.rounded(x.cast("double"), 6)).alias("a"))
    return e.select("vec_id", *[A.placed(F.col("a"), 8, w).alias(n) for n, w in (("l", "left"), ("r", "right"), ("c", "centre"))])


@add("ar9_zscore", f"WITH {P}, x AS (SELECT vec_id, unnest(range(0, 10)) AS i, unnest(p) AS v FROM p) SELECT vec_id, i::INT AS i, round((v - avg(v) OVER w) / (stddev_samp(v) OVER w + 1e-5), 5) AS z FROM x WINDOW w AS (PARTITION BY vec_id)")
def ar9(spark, d):
    return probs(spark, d).select("vec_id", F.posexplode(A.zscore(F.col("p"))).alias("i", "z")).select("vec_id", "i", A.rounded(F.col("z"), 5).alias("z"))


@add(
    "ar7_sign_test",
    """WITH w AS (SELECT user_id % 10 AS g, count(*) FILTER (value > 60) AS k, count(*) FILTER (value > 60 OR value < 12) AS n FROM events GROUP BY 1),
t AS (SELECT g, k, n, unnest(range(k, n + 1)) AS i FROM w) SELECT g, k, n, round(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))), 6) AS p FROM t GROUP BY g, k, n""",
)
def ar7(spark, d):
    return _ar7(table(spark, d, "events"))


@add("ar7_sign_test_whole")
def ar7_whole(spark, d):
    return _ar7(table(spark, d, "events"))


def _ar7(events):
    e = events.groupBy((F.col("user_id") % 10).alias("g")).agg(F.count_if(F.col("value") > 60).alias("k"), F.count_if((F.col("value") > 60) | (F.col("value") < 12)).alias("n"))
    return e.select("g", "k", "n", F.round(A.sign_test(F.col("k"), F.col("n")), 6).alias("p"))


BOOK.oracles["ar7_sign_test_whole"] = BOOK.oracles["ar7_sign_test"]
