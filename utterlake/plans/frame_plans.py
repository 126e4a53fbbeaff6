"""Queries of frames, operating points and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import choose as K
from ..operators import frames as W
from ..operators import metrics as M
from .common import SCORES, Book, scores, table
from .metric_plans import GRID, OK_SQL, R_SQL, SWEEP_SQL, T_SQL, TARGET, OK, RIGHT, cells, CONFIG_SQL, GRID_SQL

BOOK = Book()
add = BOOK.add
S = f"WITH {SCORES}"

#: Frames: a customer's orders in order of key; energy is the price.
FR = "fr AS (SELECT o_custkey AS rec, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS frame, (o_totalprice / 1000)::BIGINT AS e, o_orderpriority = '5-LOW' AS blank FROM orders)"


def frames(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("rec"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("frame"), F.bround(F.col("o_totalprice") / 1000).cast("long").alias("e"), (F.col("o_orderpriority") == "5-LOW").alias("blank"))


@add("wn1_section_fill", "WITH x AS (SELECT page_id, unnest(string_split(html, '<')) AS line, generate_subscripts(string_split(html, '<'), 1) - 1 AS pos FROM pages) SELECT page_id, section, count(*) AS n FROM (SELECT page_id, last_value(CASE WHEN regexp_matches(line, '^(article|nav|footer|body)>') THEN split_part(line, '>', 1) END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS section FROM x) GROUP BY 1, 2")
def wn1(spark, d):
    x = table(spark, d, "pages").select("page_id", F.posexplode(F.split("html", "<")).alias("pos", "line"))
    head = F.when(F.col("line").rlike("^(article|nav|footer|body)>"), F.split_part("line", F.lit(">"), F.lit(1)))
    return W.fill_section(x, "page_id", "pos", head).groupBy("page_id", "section").agg(F.count(F.lit(1)).alias("n"))


_TOK = "x AS (SELECT o_custkey AS utt, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS frame, o_orderkey AS k FROM orders), y AS (SELECT utt, frame, unnest([k % 3, (k + 1) % 3]) AS token, unnest([k % 7, k % 5]) AS lp FROM x), b AS (SELECT utt, frame, token, lp, row_number() OVER (PARTITION BY utt, frame ORDER BY lp DESC, token) AS r FROM y), c AS (SELECT *, lag(token) OVER (PARTITION BY utt ORDER BY frame) AS p FROM b WHERE r = 1)"


@add("wn2_run_collapse", f"WITH {_TOK} SELECT utt, coalesce(string_agg(token::VARCHAR, ' ' ORDER BY frame) FILTER (token IS DISTINCT FROM p AND token <> 0), '') AS tokens, avg(lp) AS mean_logp FROM c GROUP BY 1")
def wn2(spark, d):
    from pyspark.sql import Window

    x = table(spark, d, "orders").select(F.col("o_custkey").alias("utt"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("frame"), F.col("o_orderkey").alias("k"))
    y = x.select("utt", "frame", F.explode(F.array(F.struct((F.col("k") % 3).alias("token"), (F.col("k") % 7).alias("lp")), F.struct(((F.col("k") + 1) % 3).alias("token"), (F.col("k") % 5).alias("lp")))).alias("s")).select("utt", "frame", "s.token", "s.lp")
    return W.collapse(y, "utt", "frame", "token", "lp", 0)


@add("wn3_trailing_hold", f"WITH {FR}, r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY frame DESC) AS r FROM fr) SELECT rec, bool_and(e < 200) AND count(*) = 3 AS ended FROM r WHERE r <= 3 GROUP BY 1")
def wn3(spark, d):
    return W.trailing_hold(frames(spark, d), "rec", "frame", F.col("e") < 200, 3)


@add("wn4_active_duration", f"WITH {FR} SELECT rec, count(*) FILTER (NOT blank) * 0.02::DOUBLE AS active_s FROM fr GROUP BY 1")
def wn4(spark, d):
    return W.active_seconds(frames(spark, d), "rec", ~F.col("blank"), 0.02)


@add("wn5_segment_means", f"WITH {FR}, x AS (SELECT *, min(CASE WHEN NOT blank THEN frame END) OVER (PARTITION BY rec) AS a, max(CASE WHEN NOT blank THEN frame END) OVER (PARTITION BY rec) AS b FROM fr) SELECT rec, count(*) AS n, avg(e) AS mean FROM x WHERE frame BETWEEN a AND b GROUP BY 1")
def wn5(spark, d):
    return W.inner_means(frames(spark, d), "rec", "frame", F.col("blank"), "e")


_ST = "x AS (SELECT event_id, user_id, event_type, value > 20 AS ok, lag(event_type) OVER w AS pe, lag(value > 20) OVER w AS po FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), y AS (SELECT *, sum(CASE WHEN event_type = pe AND po AND ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS isle FROM x)"


@add("wn6_stable_streak", f"WITH {_ST} SELECT event_id, CASE WHEN ok THEN row_number() OVER (PARTITION BY user_id, isle ORDER BY event_id) ELSE 0 END::INT AS streak FROM y")
def wn6(spark, d):
    return W.streaks(table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), "user_id", "event_id", ["event_type"], F.col("value") > 20).select("event_id", "streak")


@add("wn7_quiet_window", f"WITH {FR}, x AS (SELECT *, CASE WHEN frame < 5 THEN 'lead' WHEN frame >= 8 THEN 'tail' END AS g FROM fr), w AS (SELECT rec, g, frame, sum(e) OVER v AS s, count(*) OVER v AS n FROM x WHERE g IS NOT NULL WINDOW v AS (PARTITION BY rec, g ORDER BY frame ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)), r AS (SELECT *, row_number() OVER (PARTITION BY rec, g ORDER BY s, frame) AS r FROM w WHERE n = 2) SELECT rec, g AS region, frame AS at, s::BIGINT AS energy FROM r WHERE r = 1")
def wn7(spark, d):
    return W.quietest(frames(spark, d), "rec", "frame", "e", 2, F.when(F.col("frame") < 5, "lead").when(F.col("frame") >= 8, "tail"))


@add("wn8_cut_point", f"WITH {FR}, r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY e, frame) AS r FROM fr WHERE frame BETWEEN 2 AND 6) SELECT rec, frame AS cut FROM r WHERE r = 1")
def wn8(spark, d):
    return W.cut_point(frames(spark, d), "rec", "frame", "e", 2, 6)


@add("wn9_loudest_window", f"WITH {FR}, w AS (SELECT rec, frame, sum(e) OVER v AS s, count(*) OVER v AS n FROM fr WINDOW v AS (PARTITION BY rec ORDER BY frame ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)), r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY s DESC, frame) AS r FROM w WHERE n = 3) SELECT rec, frame AS at FROM r WHERE r = 1")
def wn9(spark, d):
    return W.loudest_window(frames(spark, d), "rec", "frame", "e", 3)


@add("wn10_fixed_windows", "SELECT DISTINCT doc_id, unnest(range(0, n_chars - 400 + 1, 250) || [n_chars - 400]) AS start FROM documents WHERE n_chars >= 400")
def wn10(spark, d):
    return W.fixed_windows(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 400, 250).select("doc_id", "start")


@add("wn11_crop_point", f"WITH {FR}, g AS (SELECT rec, max(CASE WHEN frame * 2 // 3 < rec % 5 + 1 THEN frame END) AS last, min(CASE WHEN frame * 2 // 3 > rec % 5 + 1 THEN frame END) AS nxt FROM fr GROUP BY 1), y AS (SELECT *, CASE WHEN last IS NULL OR nxt IS NULL OR nxt <= last THEN 'no_gap' WHEN least(last + 3, nxt) < 4 THEN 'crop_too_short' END AS why FROM g) SELECT rec, why, CASE WHEN why IS NULL THEN least(last + 3, nxt) END AS crop FROM y")
def wn11(spark, d):
    a = frames(spark, d).withColumn("pos", F.floor(F.col("frame") * 2 / 3)).withColumn("plen", F.col("rec") % 5 + 1)
    return W.crop_point(a, "rec", "frame", "pos", "plen", 2, 4)


@add("wn12_best_lag", "WITH a AS (SELECT p_partkey // 100 AS seg, p_partkey AS f, (p_size * 7 % 11)::DOUBLE AS v FROM part), b AS (SELECT p_partkey + 2 AS f, (p_size * 7 % 11 + p_partkey % 2)::DOUBLE AS v FROM part), c AS (SELECT seg, lag, round(corr(a.v, b.v), 9) AS r FROM a, (SELECT unnest(range(-3, 4)) AS lag) l, b WHERE b.f = a.f + lag GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY r DESC, lag) AS n FROM c WHERE r IS NOT NULL AND NOT isnan(r)) SELECT seg, lag::INT AS lag, r, r > 0.6 AS ok FROM r WHERE n = 1")
def wn12(spark, d):
    p = table(spark, d, "part")
    a = p.select(F.floor(F.col("p_partkey") / 100).alias("seg"), F.col("p_partkey").alias("f"), (F.col("p_size") * 7 % 11).cast("double").alias("v"))
    b = p.select((F.col("p_partkey") + 2).alias("f"), (F.col("p_size") * 7 % 11 + F.col("p_partkey") % 2).cast("double").alias("v"))
    return W.best_lag(a, b, "seg", "f", "v", 3, 0.6)


@add("tk1_operating_threshold", S + f", {SWEEP_SQL} SELECT * FROM sweep ORDER BY j DESC, threshold DESC LIMIT 1")
def tk1(spark, d):
    return K.best_threshold(M.sweep(scores(spark, d).where("split = 'val'"), GRID, TARGET()))


_G2 = f"g AS (SELECT m AS margin, avg(({OK_SQL} AND {R_SQL} AND (gap IS NULL OR gap >= m))::INT) FILTER ({T_SQL}) AS accuracy, avg(({OK_SQL} AND (gap IS NULL OR gap >= m))::INT) FILTER (NOT ({T_SQL})) AS far FROM scores, (SELECT unnest([0.0::DOUBLE, 1.0, 2.0, 4.0]) AS m) GROUP BY 1)"


@add("tk2_margin_selection", S + f", {_G2} SELECT margin, far, accuracy FROM g WHERE accuracy >= (SELECT min_by(accuracy, margin) FROM g) - 0.06 ORDER BY far, margin LIMIT 1")
def tk2(spark, d):
    grid = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (4.0,)], "m double")
    # rows meet the grid as counts
    per = scores(spark, d).groupBy("gap", TARGET().alias("t")).agg(F.count(F.lit(1)).alias("n"), F.count_if(OK() & RIGHT()).alias("right"), F.count_if(OK()).alias("ok")).crossJoin(F.broadcast(grid))
    met, t = F.col("gap").isNull() | (F.col("gap") >= F.col("m")), F.col("t")
    part = lambda c, w: F.coalesce(F.sum(F.when(w & met, F.col(c))), F.lit(0)) / F.sum(F.when(w, F.col("n")))
    g = per.groupBy(F.col("m").alias("margin")).agg(part("right", t).alias("accuracy"), part("ok", ~t).alias("far"))
    return K.choose_margin(g, 0.06)


_W = "want AS (SELECT intent, CASE intent WHEN 'click' THEN 0 WHEN 'signup' THEN 100000000 ELSE count(*) // 3 END AS n FROM scores WHERE intent IS NOT NULL AND split = 'val' GROUP BY 1)"


@add("tk3_iso_threshold", S + f", {_W}, r AS (SELECT intent, confidence, row_number() OVER (PARTITION BY intent ORDER BY confidence DESC) AS r FROM scores WHERE split = 'test' AND confidence IS NOT NULL) SELECT want.intent, CASE WHEN n <= 0 THEN 'Infinity'::DOUBLE ELSE coalesce(max(confidence)::DOUBLE, '-Infinity'::DOUBLE) END AS tau FROM want LEFT JOIN r ON r.intent = want.intent AND r = n GROUP BY want.intent, n")
def tk3(spark, d):
    s = scores(spark, d)
    want = s.where("intent IS NOT NULL AND split = 'val'").groupBy("intent").agg(F.count(F.lit(1)).alias("c")).selectExpr("intent", "CASE intent WHEN 'click' THEN 0 WHEN 'signup' THEN 100000000 ELSE c div 3 END AS n")
    return K.iso_threshold(s.where("split = 'test'"), "intent", "confidence", want)


@add("tk4_budget_threshold", S + f", r AS (SELECT confidence::DOUBLE AS confidence, row_number() OVER (ORDER BY confidence DESC) AS r, count(*) OVER () AS n FROM scores WHERE NOT ({T_SQL}) AND confidence IS NOT NULL) SELECT coalesce(max(confidence) FILTER (r = floor(n * 0.05 + 1e-9) + 1), 0.0) AS strict FROM r")
def tk4(spark, d):
    return K.budget_threshold(scores(spark, d).where(~TARGET() & F.col("confidence").isNotNull()).withColumn("confidence", F.col("confidence").cast("double")), "confidence", 0.05)


@add("tk5_relaxed_thresholds", S + " SELECT intent, least(round(quantile_cont(confidence::DOUBLE, 0.3), 6), 0.92) AS tau FROM scores WHERE intent IS NOT NULL GROUP BY 1")
def tk5(spark, d):
    t = scores(spark, d).where("intent IS NOT NULL").groupBy("intent").agg(F.round(F.percentile(F.col("confidence").cast("double"), 0.3), 6).alias("tau"))
    return K.relax(t, F.lit(0.92))


@add("tk6_config_selection", S + f", {CONFIG_SQL}, {GRID_SQL}, v AS (SELECT config, sum(fa)::BIGINT AS fa FROM cells WHERE split = 'val' GROUP BY 1) SELECT config, fa FROM v ORDER BY fa, CASE config WHEN 'base' THEN 1 WHEN 'tight' THEN 2 ELSE 3 END LIMIT 1")
def tk6(spark, d):
    v = cells(spark, d).where("split = 'val'").groupBy("config").agg(F.sum("fa").alias("fa"))
    return K.choose_config(v, "fa", ["base", "tight", "loose"])


_VOTE = "g AS (SELECT user_id, event_id // 1000 AS period, event_type, count(*) AS votes, round(sum(value), 9) AS s, min(event_id) AS f, max(event_id) AS latest, avg(value) AS mean FROM events GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, period ORDER BY votes DESC, s DESC, f) AS r FROM g)"


@add("tk7_mode_vote", f"WITH {_VOTE} SELECT user_id, period, event_type, votes, latest, round(mean, 6) AS mean FROM r WHERE r = 1")
def tk7(spark, d):
    e = table(spark, d, "events").withColumn("period", F.floor(F.col("event_id") / 1000))
    return K.mode_vote(e, ["user_id", "period"], "event_id", ["event_type"], "value").withColumn("mean", F.round("mean", 6))


@add("tk8_review_sample", S + " SELECT i, source FROM (SELECT i, source, row_number() OVER (PARTITION BY source, confidence >= 0.9 ORDER BY confidence DESC NULLS LAST, i) AS r FROM scores) WHERE r <= 4")
def tk8(spark, d):
    s = scores(spark, d).withColumn("pass", F.col("confidence") >= 0.9)
    return K.review_sample(s, ["source", "pass"], [F.col("confidence").desc_nulls_last(), "i"], 4).select("i", "source")


@add("tk9_first_event", "SELECT user_id, min(event_id) AS event_id, min_by(event_type, event_id) AS event_type FROM events WHERE value > 50 GROUP BY 1")
def tk9(spark, d):
    return K.first_event(table(spark, d, "events").where("value > 50"), "user_id", "event_id", ["event_type"])


@add("tk10_loosest_threshold", S + f", r AS (SELECT confidence, row_number() OVER (PARTITION BY cond ORDER BY confidence DESC) AS r FROM scores WHERE NOT ({T_SQL}) AND confidence IS NOT NULL) SELECT min(confidence) AS tau FROM scores WHERE {T_SQL} AND confidence > (SELECT max(confidence) FROM r WHERE r = 21)")
def tk10(spark, d):
    return K.loosest(scores(spark, d), "confidence", TARGET(), "cond", 20)
