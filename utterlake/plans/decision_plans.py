"""Queries of the decision rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import accepted
from ..operators import choose as K
from ..operators import decide as D
from ..operators import metrics as M
from ..sources.kept import keep
from .common import SCORES, Book, scores, table
from .metric_plans import GRID, OK, OK_SQL, R_SQL, RIGHT, SLOT_OK, SWEEP_SQL, T_SQL, TARGET, wilson_sql

BOOK = Book()
add = BOOK.add
S = f"WITH {SCORES}"
BASE, GATE = 0.9, 4.0
SCORERS = {"baseline": "confidence", "d1": "d1", "d2": "d2"}
MARGINS = {"none": None, "gate": GATE}
TIME_STOP = ("purchase", "signup")
DENSE = {
    "d1": "confidence - CAST(k % 8 AS DOUBLE) / CAST(16 AS DOUBLE)",
    "d2": "confidence + CASE WHEN label = intent THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END - CAST(k % 4 AS DOUBLE) / CAST(32 AS DOUBLE)",
}


def NEW():
    return OK() & (F.col("gap").isNull() | (F.col("gap") >= -1))


NEW_SQL = f"({OK_SQL} AND (gap IS NULL OR gap >= -1))"


def pilot(spark, d):
    """Score rows with two more scorers."""
    return scores(spark, d).selectExpr("*", *[f"{e} AS {n}" for n, e in DENSE.items()])


def clean_targets(p):
    return p.where((F.col("split") == "val") & (F.col("cond") == "clean") & TARGET())


def thresholds(p, names=None):
    """Thresholds of the scorers and margins that the configs use; of all of them without names."""
    used = [(c, m) for c in SCORERS for m in MARGINS if names is None or any(n.startswith(f"{c}-") and n.endswith(f"|{m}") and "-fixed" not in n for n in names)]
    cells = [c for s, m in used for c in D.calibration_cells({s: SCORERS[s]}, BASE, MARGINS[m], f"{m}|")]
    return D.calibrated(D.score_counts(clean_targets(p), cells))


def config(name, margin):
    return D.config_ok(name, SCORERS, BASE, MARGINS[margin], margin + "|")


B, CONFIGS = "baseline-fixed|gate", [f"{c}|{m}" for c in ("baseline-fixed", *D.ORDER) for m in MARGINS]


def raw_sums():
    """Rows accepted by the score table, by the raw values, and close to the threshold."""
    return {"seen": OK(), "raw": (F.col("k") % 10 != 9) & (F.col("value") <= 60), "near": F.abs(F.col("confidence") - BASE) < 0.0001}


def pilot_cube(p, names=CONFIGS, taus=None, marks=None):
    """The cube of configs over all rows, and their acceptances."""
    x = D.with_thresholds(p, thresholds(p, names) if taus is None else taus)
    return D.decision_cube(x, ["split", "cond"], {n: config(*n.split("|")) for n in names}, marks, raw_sums())


def pilot_outcomes(cube, ok):
    """Outcomes of configs on validation and test rows."""
    return D.outcomes(cube.where("split <> 'train'"), ["split", "cond"], ok, B)


# the same in SQL: p (score rows), tau, a (rows by config and margin), m (counts), l (counts of labels)
_P = f"p AS (SELECT *, {DENSE['d1']} AS d1, {DENSE['d2']} AS d2 FROM scores)"
_HALF = """h(grp, s, i, c) AS (SELECT grp, grp::VARCHAR, 0, 4294967295::BIGINT FROM (SELECT DISTINCT grp FROM scores) UNION ALL SELECT grp, s, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, ascii(substr(s, i // 9 + 1, 1))::BIGINT) WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM h WHERE i < 9 * length(s)),
halves AS (SELECT grp, (xor(c, 4294967295::BIGINT) & 1)::INT AS half FROM h WHERE i = 9 * length(s))"""
_SCORE = "CASE {0}.scorer WHEN 'baseline' THEN confidence WHEN 'd1' THEN d1 ELSE d2 END"
_MET = "({0}.margin = 'none' OR gap IS NULL OR gap >= 4)"


def _tau(name, source, key=""):
    k, w = (f"{key}, ", f"w.{key}, ") if key else ("", "")
    on = f"r.{key} = w.{key} AND " if key else ""
    return f"""{name}_k AS (SELECT {k}c.scorer, g.margin, unnest(['*', intent]) AS place, {_SCORE.format('c')} AS sc, confidence FROM {source}, (VALUES ('baseline'), ('d1'), ('d2')) c(scorer), (VALUES ('none'), ('gate')) g(margin) WHERE split = 'val' AND cond = 'clean' AND {T_SQL} AND intent IS NOT NULL AND {_MET.format('g')}),
{name}_w AS (SELECT {k}scorer, margin, place, count(*) FILTER (confidence >= 0.9) AS n FROM {name}_k GROUP BY ALL),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {k}scorer, margin, place ORDER BY sc DESC) AS r FROM {name}_k),
{name} AS (SELECT {w}w.scorer, w.margin, w.place, CASE WHEN n <= 0 THEN 'inf'::DOUBLE ELSE coalesce(r.sc, '-inf'::DOUBLE) END AS tau FROM {name}_w w LEFT JOIN {name}_r r ON {on}r.scorer = w.scorer AND r.margin = w.margin AND r.place = w.place AND r.r = w.n WHERE w.place = '*' OR n > 0)"""


def _acc(name, source, tau, where="split <> 'train'", other=""):
    on = f" AND {{0}}.half = {other}" if other else ""
    return f"""{name} AS (SELECT s.*, f.config, f.margin, coalesce(intent IS NOT NULL AND {_MET.format('f')} AND {_SCORE.format('f')} >= CASE f.mode WHEN 'fixed' THEN 0.9 WHEN 'global' THEN t.tau WHEN 'per_intent' THEN coalesce(o.tau, t.tau) ELSE least(t.tau, coalesce(o.tau, t.tau)) END, FALSE) AS ok FROM {source} s CROSS JOIN cfg f LEFT JOIN {tau} t ON t.scorer = f.scorer AND t.margin = f.margin AND t.place = '*'{on.format('t')} LEFT JOIN {tau} o ON o.scorer = f.scorer AND o.margin = f.margin AND o.place = s.intent{on.format('o')} WHERE {where})"""


def _cfg(names):
    return "cfg AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{n.split('-')[0]}', '{n.split('-')[1]}', '{m}')" for n, m in names) + ") v(config, scorer, mode, margin))"


_REJ = "bucket IN ('babble', 'silence')"
_COUNTS = f"count(*) FILTER ({T_SQL}) AS n_targets, count(*) FILTER ({T_SQL} AND ok) AS accepted, count(*) FILTER ({T_SQL} AND ok AND {R_SQL}) AS exact, count(*) FILTER (bucket = 'babble' AND ok) AS babble_fa, count(*) FILTER ({_REJ} AND ok) AS fa, count(*) FILTER ({_REJ} AND ok AND intent IN ('purchase', 'signup')) AS ts_fa"
_M = f"m AS (SELECT config, margin, split, cond, {_COUNTS} FROM a GROUP BY ALL), l AS (SELECT config, margin, split, cond, label, count(*) AS n, count(*) FILTER (ok AND {R_SQL}) AS exact FROM a WHERE {T_SQL} GROUP BY ALL)"
_ALL_CFG = _cfg([n.split("|") for n in CONFIGS])
_PILOT = f"{_P}, {_tau('tau', 'p')}, {_ALL_CFG}, {_acc('a', 'p', 'tau')}, {_M}"


def _side(name, margin):
    return f"config = {name} AND margin = '{margin}'"


def _wide(name, sides, source="m", labels="l"):
    """name: a row a split of both conditions and all sides; name_l: labels of 50 clean targets and whether they hold."""
    vals = ", ".join(f"coalesce(sum({v}) FILTER (cond = '{c}' AND {w}), 0) AS {c}_{s}_{v}" for c in D.CONDITIONS for s, w in sides.items() for v in D.VALUES)
    held = " AND ".join(f"100 * (coalesce(sum(exact) FILTER (cond = '{c}' AND {sides['s']}), 0) - coalesce(sum(exact) FILTER (cond = '{c}' AND {sides['b']}), 0)) >= -3 * sum(n) FILTER (cond = 'clean' AND {sides['b']})" for c in D.CONDITIONS)
    return f"{name} AS (SELECT split, {vals} FROM {source} GROUP BY 1), {name}_l AS (SELECT split, label, {held} AS ok FROM {labels} GROUP BY 1, 2 HAVING sum(n) FILTER (cond = 'clean' AND {sides['b']}) >= 50)"


def _exact(c):
    return f"1000 * ({c}_s_exact - {c}_b_exact) >= -5 * {c}_b_n_targets"


_B_SIDE = _side("'baseline-fixed'", "gate")
_PARITY_SQL = f"""par AS (SELECT coalesce(bool_and(n = w OR (abs(n - w) = 1 AND near > 0)), FALSE) AS parity FROM (SELECT cond, count(*) FILTER ({OK_SQL}) AS n, count(*) FILTER (k % 10 <> 9 AND value <= 60) AS w, count(*) FILTER (abs(confidence - 0.9) < 0.0001) AS near FROM scores GROUP BY 1))"""


def _go(chosen):
    """g: verdict, reason and R1 to R7 of the config that `chosen` (SQL) names."""
    ids = lambda one, two: f"(SELECT count(*) FROM a x JOIN a y USING (i) WHERE x.split = 'test' AND x.cond = 'noisy' AND x.bucket IN ('babble', 'silence') AND x.margin = 'gate' AND y.margin = 'gate' AND x.config = {one} AND y.config = {two} AND x.ok AND NOT y.ok)"
    r = ["2 * noisy_s_fa <= noisy_b_fa", "noisy_s_babble_fa < noisy_b_babble_fa", "p <= 0.05", "clean_s_fa <= clean_b_fa", f"{_exact('clean')} AND {_exact('noisy')}", "coalesce((SELECT bool_and(ok) FROM w_l WHERE split = 'test'), TRUE)", "noisy_s_ts_fa <= noisy_b_ts_fa"]
    crit = ", ".join(f"CASE WHEN parity AND noisy_b_fa >= 4 THEN coalesce({x}, FALSE) END AS r{i + 1}" for i, x in enumerate(r))
    failed = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT r{i} THEN 'R{i}' END" for i in range(1, 8)) + ")"
    return f"""{_wide('w', {'b': _B_SIDE, 's': _side(chosen, 'gate')})}, {_PARITY_SQL}, ra AS (SELECT {ids("'baseline-fixed'", chosen)} AS removed, {ids(chosen, "'baseline-fixed'")} AS added),
sp AS (SELECT removed, added, CASE WHEN removed + added = 0 THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2.0))) FROM (SELECT removed + added AS n, unnest(range(removed, removed + added + 1)) AS i)) END AS p FROM ra),
cr AS (SELECT w.*, removed, added, parity, {crit} FROM w, sp, par WHERE split = 'test'),
g AS (SELECT *, CASE WHEN NOT parity THEN 'INVALID' WHEN noisy_b_fa < 4 THEN 'NO-GO' WHEN {failed} = '' THEN 'GO' ELSE 'NO-GO' END AS verdict, CASE WHEN NOT parity THEN 'parity_failed' WHEN noisy_b_fa < 4 THEN 'baseline_far_already_absorbed_by_margin' WHEN {failed} = '' THEN 'all_criteria_pass' ELSE 'criteria_failed:' || {failed} END AS reason FROM cr)"""


def decision_row(out, cube, chosen):
    """The counts of DR1: test rows, baseline b against s, removed and added rows, parity."""
    row = D.condition_row(out.where("split = 'test'"), [], {"b": B, "s": chosen}, TIME_STOP)
    moved = D.config_metrics(out.where("split = 'test' AND cond = 'noisy'"), []).where(F.col("config") == chosen).agg(F.coalesce(F.max("lost"), F.lit(0)).alias("removed"), F.coalesce(F.max("won"), F.lit(0)).alias("added"))
    return row.crossJoin(moved).crossJoin(D.cube_parity(cube))


@add("dr1_go_no_go", S + f", {_PILOT}, {_go(chr(39) + 'd2-global' + chr(39))} SELECT verdict, reason, r1, r2, r3, r4, r5, r6, r7 FROM g")
def dr1(spark, d):
    cube, ok = pilot_cube(pilot(spark, d), [B, "d2-global|gate"])
    out = pilot_outcomes(cube, ok)
    return D.go_no_go(decision_row(out, cube, "d2-global|gate"), D.label_rows(out.where("split = 'test'"), [], {"b": B, "s": "d2-global|gate"}))


@add("dr2_parity_block", S + f", o AS (SELECT source, count(*) FILTER ({OK_SQL}) AS n, count(*) FILTER (abs(confidence - 0.9) < 0.0001) AS near FROM scores GROUP BY 1), e AS (SELECT source, n + CASE source WHEN 'src1' THEN 1 WHEN 'src2' THEN 2 ELSE 0 END AS want FROM o) SELECT source, n = want AS exact, n = want OR (abs(n - want) = 1 AND near > 0) AS ok FROM o JOIN e USING (source)")
def dr2(spark, d):
    s = scores(spark, d)
    o = s.groupBy("source").agg(F.count_if(OK()).alias("n"))
    near = s.groupBy("source").agg(F.count_if(F.abs(F.col("confidence") - 0.9) < 0.0001).alias("near"))
    want = o.withColumn("n", F.col("n") + F.expr("CASE source WHEN 'src1' THEN 1 WHEN 'src2' THEN 2 ELSE 0 END"))
    return D.parity(o, want, "source", near)


_ORDER_SQL = "CASE config " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(D.ORDER)) + " END"
_INPUTS = ["noisy_b_fa", "noisy_s_fa", "noisy_b_babble_fa", "noisy_s_babble_fa", "removed", "added", "clean_b_fa", "clean_s_fa", "clean_b_exact", "clean_s_exact", "clean_b_n_targets", "noisy_b_exact", "noisy_s_exact", "noisy_b_n_targets", "noisy_b_ts_fa", "noisy_s_ts_fa"]
_KINDS = {"margin_only": "NOT mok AND dok", "other_only": "mok AND NOT dok", "both": "NOT mok AND NOT dok", "neither": "mok AND dok"}


@add(
    "dr3_pilot_report",
    S + f""", {_PILOT}, vf AS (SELECT config, sum(fa) AS fa FROM m WHERE split = 'val' AND margin = 'gate' AND config <> 'baseline-fixed' GROUP BY 1), sel AS (SELECT config FROM vf ORDER BY fa, {_ORDER_SQL} LIMIT 1), {_go('(SELECT config FROM sel)')},
ov AS (SELECT x.cond, y.ok AS mok, z.ok AS dok FROM a x JOIN a y USING (i) JOIN a z USING (i) WHERE x.split = 'test' AND x.{_REJ} AND x.ok AND x.config = 'baseline-fixed' AND x.margin = 'none' AND y.config = 'baseline-fixed' AND y.margin = 'gate' AND z.config = (SELECT config FROM sel) AND z.margin = 'none')
SELECT 'threshold' AS part, concat(margin, '|', scorer, '|', place) AS key, tau AS value FROM tau
UNION ALL SELECT 'val_fa', config, fa::DOUBLE FROM vf UNION ALL SELECT 'selected', config, 1.0 FROM sel UNION ALL SELECT 'verdict', verdict, 1.0 FROM g UNION ALL SELECT 'reason', reason, 1.0 FROM g
UNION ALL SELECT 'input', unnest([{', '.join(repr(x) for x in _INPUTS)}]), unnest([{', '.join(x + '::DOUBLE' for x in _INPUTS)}]) FROM g
UNION ALL SELECT 'criterion', unnest([{', '.join(f"'R{i}'" for i in range(1, 8))}]), unnest([{', '.join(f'r{i}::INT::DOUBLE' for i in range(1, 8))}]) FROM g
UNION ALL SELECT 'overlap', concat(cond, '|', k), v::DOUBLE FROM (SELECT cond, unnest(['base_fa', {', '.join(f"'{k}'" for k in _KINDS)}]) AS k, unnest([count(*), {', '.join(f'count(*) FILTER ({w})' for w in _KINDS.values())}]) AS v FROM ov GROUP BY cond)
UNION ALL SELECT 'grid', concat(config, '|', margin, '|', split, '|', cond, '|', k), v::DOUBLE FROM (SELECT config, margin, split, cond, unnest(['n_targets', 'accepted', 'exact', 'babble_fa', 'fa']) AS k, unnest([n_targets, accepted, exact, babble_fa, fa]) AS v FROM m)""",
)
def dr3(spark, d):
    p = pilot(spark, d)
    taus = thresholds(p)
    cube, ok = pilot_cube(p, taus=taus)
    out = pilot_outcomes(cube, ok)
    grid = D.config_metrics(out, ["split", "cond"], TIME_STOP)
    gated = F.regexp_extract("config", r"^(.*)\|gate$", 1)
    val_fa = grid.where("split = 'val'").groupBy(gated.alias("config")).agg(F.sum("fa").alias("fa")).where(F.col("config").isin(*D.ORDER))
    sel = D.select_config(val_fa, D.ORDER)
    named = out.crossJoin(sel.select(F.concat("config", F.lit("|gate")).alias("_sel"))).where((F.col("config") == B) | (F.col("config") == F.col("_sel"))).withColumn("config", F.when(F.col("config") == B, B).otherwise("s")).drop("_sel")
    row = decision_row(named, cube, "s")
    word = D.go_no_go(row, D.label_rows(named.where("split = 'test'"), [], {"b": B, "s": "s"}))
    over = D.overlap(cube.where("split = 'test'"), ["cond"], ok["baseline-fixed|none"], ok[B], {c: ok[f"{c}|none"] for c in D.ORDER}).join(sel, "config")

    def told(df, part, key, values):
        one = [F.struct(F.lit(part).alias("part"), F.concat_ws("|", *key, *([F.lit(n)] if n else [])).alias("key"), v.cast("double").alias("value")) for n, v in values.items()]
        return df.select(F.inline(F.array(*one)))

    c = F.col
    parts = [
        told(taus, "threshold", ["at"], {"": c("tau")}), told(val_fa, "val_fa", ["config"], {"": c("fa")}), told(sel, "selected", ["config"], {"": F.lit(1)}),
        told(word, "verdict", ["verdict"], {"": F.lit(1)}), told(word, "reason", ["reason"], {"": F.lit(1)}), told(row, "input", [], {n: c(n) for n in _INPUTS}),
        told(word, "criterion", [], {f"R{i}": c(f"r{i}").cast("int") for i in range(1, 8)}), told(over, "overlap", ["cond"], {k: c(k) for k in ("base_fa", *_KINDS)}),
        told(grid, "grid", ["config", "split", "cond"], {k: c(k) for k in ("n_targets", "accepted", "exact", "babble_fa", "fa")}),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@add(
    "dr4_follow_up_gates",
    S + f""", {_PILOT}, vf AS (SELECT config, sum(fa) AS fa FROM m WHERE split = 'val' AND margin = 'none' AND config LIKE 'd%' GROUP BY 1), sel AS (SELECT config FROM vf ORDER BY fa, {_ORDER_SQL} LIMIT 1), {_wide('w', {'b': _B_SIDE, 's': _side('(SELECT config FROM sel)', 'none')})},
f AS (SELECT w.split, (SELECT config FROM sel) AS selected, noisy_s_fa <= noisy_b_fa AS f1, clean_s_fa <= clean_b_fa AS f2, {_exact('clean')} AND {_exact('noisy')} AS f3, coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM w_l WHERE w_l.split = w.split AND NOT ok), '') AS failing FROM w)
SELECT split, selected, f1, f2, f3, failing = '' AS f4, failing, CASE WHEN (SELECT bool_and(f1 AND f2 AND f3 AND failing = '') FROM f) THEN 'FOLLOWUP-GO' ELSE 'FOLLOWUP-NO-GO' END AS verdict FROM f""",
)
def dr4(spark, d):
    out = pilot_outcomes(*pilot_cube(pilot(spark, d), [B, *[f"{c}|none" for c in D.FOLLOW_UP]]))
    val_fa = D.config_metrics(out.where("split = 'val'"), []).select(F.regexp_extract("config", r"^(.*)\|none$", 1).alias("config"), "fa")
    sel = D.select_config(val_fa, D.FOLLOW_UP)
    named = out.crossJoin(sel.withColumnRenamed("config", "selected")).where((F.col("config") == B) | (F.col("config") == F.concat("selected", F.lit("|none")))).withColumn("config", F.when(F.col("config") == B, "b").otherwise("s"))
    sides = {"b": "b", "s": "s"}
    g = D.gates(D.condition_row(named, ["split"], sides), D.label_rows(named, ["split"], sides), ["split"], "f")
    every = g.agg(F.bool_and(F.col("f1") & F.col("f2") & F.col("f3") & F.col("f4")).alias("_all"))
    word = F.when(F.col("_all"), "FOLLOWUP-GO").otherwise("FOLLOWUP-NO-GO").alias("verdict")
    return g.crossJoin(every).crossJoin(sel.withColumnRenamed("config", "selected")).select("split", "selected", "f1", "f2", "f3", "f4", F.array_join("failing", ",").alias("failing"), word)


def gated_ok():
    return accepted(F.col("intent"), F.col("confidence"), BASE) & (F.col("gap").isNull() | (F.col("gap") >= GATE))


def halved(p):
    return p.withColumn("half", D.half_of(F.col("grp")))


def cross_fit_outcomes(p):
    """Outcomes of the baseline b, the relax-only hybrid s and the global control c: validation rows under thresholds of the other half, test rows under those of all validation rows."""
    h = halved(p)
    cells = [c for by in (F.concat(F.col("half").cast("string"), F.lit("|")), "all|") for c in D.calibration_cells({"d2": "d2"}, BASE, None, by)]
    taus = D.calibrated(D.score_counts(clean_targets(h), cells))
    place = F.when(F.col("split") == "val", F.concat((1 - F.col("half")).cast("string"), F.lit("|"))).otherwise("all|")
    configs = {"b": gated_ok(), "s": D.config_ok("d2-relax", SCORERS, BASE, None, place), "c": D.config_ok("d2-global", SCORERS, BASE, None, place)}
    cube, ok = D.decision_cube(D.with_thresholds(h.where("split <> 'train'"), taus), ["split", "cond", "half"], configs)
    return D.outcomes(cube, ["split", "cond", "half"], ok, "b")


_X_CFG = "cfg AS (SELECT * FROM (VALUES ('b', 'baseline', 'fixed', 'gate'), ('s', 'd2', 'relax', 'none'), ('c', 'd2', 'global', 'none')) v(config, scorer, mode, margin))"
_CROSS = f"""{_P}, {_HALF}, hp AS (SELECT p.*, half FROM p JOIN halves USING (grp)), {_tau('th', 'hp', 'half')}, {_tau('ta', 'hp')}, {_X_CFG},
{_acc('av', 'hp', 'th', "split = 'val'", '1 - s.half')}, {_acc('at_', 'hp', 'ta', "split = 'test'")}, a AS (SELECT * FROM av UNION ALL SELECT * FROM at_), {_M}"""
R = S.replace("WITH ", "WITH RECURSIVE ", 1)


@add(
    "dr5_cross_fit",
    R + f", {_CROSS} SELECT config, cond, n_targets, accepted, exact, fa, coalesce(accepted / nullif(n_targets, 0)::DOUBLE, 0) AS accept_rate, coalesce(exact / nullif(n_targets, 0)::DOUBLE, 0) AS exact_accuracy FROM m WHERE split = 'val' AND config <> 'b'",
)
def dr5(spark, d):
    out = cross_fit_outcomes(pilot(spark, d)).where("split = 'val' AND config <> 'b'")
    return D.pooled(D.config_metrics(out, ["half", "cond"]), ["config", "cond"])


_GATES = f"""{_wide('w', {'b': "config = 'b'", 's': "config = 's'", 'c': "config = 'c'"})},
gt AS (SELECT w.split, noisy_s_fa <= noisy_b_fa AS g1, clean_s_fa <= clean_b_fa AS g2, {_exact('clean')} AND {_exact('noisy')} AS g3, clean_s_fa + noisy_s_fa <= clean_c_fa + noisy_c_fa + 2 AS g5, (SELECT count(*) FROM w_l WHERE w_l.split = w.split AND NOT ok) AS failing FROM w)"""


@add(
    "dr6_gate_verdict",
    R + f""", {_CROSS}, {_GATES}, e AS (SELECT coalesce(bool_and(g1 AND g2 AND g3 AND g5 AND failing = 0) FILTER (split = 'val'), FALSE) AS v, coalesce(bool_and(g1 AND g2 AND g3 AND g5 AND failing = 0) FILTER (split = 'test'), FALSE) AS t, coalesce(bool_and(g1 AND g2 AND g3 AND g5 AND failing BETWEEN 1 AND 2) FILTER (split = 'test'), FALSE) AS o FROM gt)
SELECT split, g1, g2, g3, failing = 0 AS g4, g5, failing, CASE WHEN v AND t THEN 'GO' WHEN v AND o THEN 'INCONCLUSIVE' ELSE 'NO-GO' END AS verdict FROM gt, e""",
)
def dr6(spark, d):
    out = cross_fit_outcomes(pilot(spark, d))
    sides = {"b": "b", "s": "s", "c": "c"}
    g = D.gates(D.condition_row(out, ["split"], sides), D.label_rows(out, ["split"], sides), ["split"])
    return g.crossJoin(D.hybrid_verdict(g)).select("split", "g1", "g2", "g3", "g4", "g5", F.size("failing").cast("long").alias("failing"), "verdict")


_JOINT = f"{_wide('w', {'b': _B_SIDE, 's': _side(chr(39) + 'd2-global' + chr(39), 'gate')})}"


@add(
    "dr7_gate_a",
    S + f""", {_PILOT}, {_JOINT}, x AS (SELECT *, greatest(ceil(3 / 255.0::DOUBLE * (SELECT count(*) FROM scores WHERE split = 'test' AND cond = 'noisy' AND bucket = 'babble'))::BIGINT, noisy_b_babble_fa::BIGINT) AS allowed, clean_b_exact::BIGINT - ceil(0.005::DOUBLE * clean_b_n_targets)::BIGINT AS fc, noisy_b_exact::BIGINT - ceil(0.005::DOUBLE * noisy_b_n_targets)::BIGINT AS fn FROM w WHERE split = 'test')
SELECT unnest(['clean_exact', 'noisy_exact', 'noisy_babble_fa']) AS criterion, unnest([clean_s_exact::BIGINT, noisy_s_exact::BIGINT, noisy_s_babble_fa::BIGINT]) AS value, unnest([fc, fn, allowed]) AS bound, unnest([clean_s_exact >= fc, noisy_s_exact >= fn, noisy_s_babble_fa <= allowed]) AS ok FROM x""",
)
def dr7(spark, d):
    p = pilot(spark, d)
    row = D.condition_row(pilot_outcomes(*pilot_cube(p, [B, "d2-global|gate"])).where("split = 'test'"), [], {"b": B, "s": "d2-global|gate"})
    babble = p.where("split = 'test' AND cond = 'noisy' AND bucket = 'babble'").agg(F.count(F.lit(1)).alias("scale"))
    return D.gate_a(row.crossJoin(babble))


_CLS = "CASE WHEN k % 4 = 0 THEN 'click' ELSE intent END"
_TOP3 = "coalesce((label = cls OR k % 2 = 0), FALSE)"
_SLOT = "coalesce(slot_truth IS NULL OR lower(slot_truth) = lower(slot_pred), FALSE)"
_CLS_SLOT = "coalesce(slot_truth IS NULL OR k % 3 > 0, FALSE)"
_PAIRS = [("click", "purchase"), ("purchase", "click"), ("signup", "click")]
_COK = "coalesce(cls IS NOT NULL AND (every OR d2 > strict), FALSE)"
_PARTS = {
    ("rows", "targets"): T_SQL, ("rows", "babble"): "bucket = 'babble'", ("rows", "silence"): "bucket = 'silence'",
    ("first", "intent_ok"): f"{T_SQL} AND aok AND {R_SQL}", ("first", "exact_ok"): f"{T_SQL} AND aok AND {R_SQL} AND sa", ("first", "babble_fa"): "bucket = 'babble' AND aok", ("first", "silence_fa"): "bucket = 'silence' AND aok",
    ("second", "intent_ok"): f"{T_SQL} AND cok AND ch", ("second", "exact_ok"): f"{T_SQL} AND cok AND ch AND sb", ("second", "argmax_intent_ok"): f"{T_SQL} AND ch", ("second", "argmax_exact_ok"): f"{T_SQL} AND ch AND sb",
    ("second", "babble_fa"): "bucket = 'babble' AND cok", ("second", "silence_fa"): "bucket = 'silence' AND cok",
    ("agreement", "first_accepted"): f"{T_SQL} AND aok", ("agreement", "same"): f"{T_SQL} AND aok AND coalesce(intent = cls, FALSE)", ("agreement", "first_right"): f"{T_SQL} AND aok AND {R_SQL}",
    ("agreement", "top1_on_right"): f"{T_SQL} AND aok AND {R_SQL} AND ch", ("agreement", "top3_on_right"): f"{T_SQL} AND aok AND {R_SQL} AND t3", ("cover", "top1"): f"{T_SQL} AND ch", ("cover", "top3"): f"{T_SQL} AND t3",
}
_SOURCE = {"rows": "TRUE", "first_intent": f"aok AND {R_SQL}", "first_exact": f"aok AND {R_SQL} AND sa", "second_intent": "cok AND ch", "second_exact": "cok AND ch AND sb"}


def _said(ok, p):
    return f"CASE WHEN NOT {ok} OR {p} IS NULL THEN 'reject' WHEN {p} = label THEN 'own' WHEN {p} = other THEN 'other' ELSE 'else' END"


@add(
    "dr8_run_report",
    S + f""", {_P}, x0 AS (SELECT *, concat('run', k % 2) AS run, {_CLS} AS cls, {OK_SQL} AS aok FROM p), nv AS (SELECT run, d2, cls, aok FROM x0 WHERE split = 'val' AND cond = 'clean' AND NOT ({T_SQL})), rate AS (SELECT coalesce(count(*) FILTER (aok) / nullif(count(*), 0)::DOUBLE, 0) AS rate FROM nv WHERE run = 'run0'),
al AS (SELECT run, floor(any_value(rate) * count(*) + 1e-9)::BIGINT + 1 AS n FROM nv, rate GROUP BY 1), rk AS (SELECT run, d2, row_number() OVER (PARTITION BY run ORDER BY d2 DESC) AS r FROM nv WHERE d2 IS NOT NULL), th AS (SELECT al.run, coalesce(d2, 0.0) AS strict, d2 IS NULL AS every FROM al LEFT JOIN rk ON rk.run = al.run AND r = n),
x AS (SELECT x0.*, strict, {_COK} AS cok, coalesce(label = cls, FALSE) AS ch, {_TOP3} AS t3, {_SLOT} AS sa, {_CLS_SLOT} AS sb FROM x0 JOIN th USING (run) WHERE split = 'test'),
pr AS (SELECT * FROM (VALUES {', '.join(map(str, _PAIRS))}) v(label, other))
SELECT run, cond, unnest([{', '.join(f"'{p}'" for p, _ in _PARTS)}]) AS part, unnest([{', '.join(f"'{k}'" for _, k in _PARTS)}]) AS key, unnest([{', '.join(f'count(*) FILTER ({w})' for w in _PARTS.values())}]) AS n FROM x GROUP BY run, cond
UNION ALL SELECT run, cond, 'source', concat(source, '|', k2), n FROM (SELECT run, cond, source, unnest([{', '.join(f"'{k}'" for k in _SOURCE)}]) AS k2, unnest([{', '.join(f'count(*) FILTER ({w})' for w in _SOURCE.values())}]) AS n FROM x WHERE {T_SQL} GROUP BY run, cond, source)
UNION ALL SELECT run, cond, 'pairs_first', concat(label, '|', {_said('aok', 'intent')}), count(*) FROM x JOIN pr USING (label) WHERE {T_SQL} GROUP BY ALL
UNION ALL SELECT run, cond, 'pairs_second', concat(label, '|', {_said('cok', 'cls')}), count(*) FROM x JOIN pr USING (label) WHERE {T_SQL} GROUP BY ALL""",
)
def dr8(spark, d):
    x = pilot(spark, d).withColumn("run", F.concat(F.lit("run"), F.col("k") % 2)).withColumn("cls", F.expr(_CLS))
    t = D.run_thresholds(x, "run", ["run0", "run1"], "run0", TARGET(), OK(), "d2", "split", "cond")
    x = x.where("split = 'test'").join(t, "run")
    pairs = spark.createDataFrame(_PAIRS, "label string, other string")
    c_ok = F.coalesce(F.col("cls").isNotNull() & (F.col("every") | (F.col("d2") > F.col("strict"))), F.lit(False))
    return D.run_report(x, "run", "cond", TARGET(), "intent", OK(), "cls", c_ok, F.expr(_TOP3), "label", SLOT_OK(), F.expr(_CLS_SLOT), "source", pairs)


_TAG = "CASE WHEN k % 3 = 0 THEN 'clean' WHEN k % 3 = 1 AND k % 2 = 0 THEN 'noisy' WHEN k % 6 > 1 THEN 'old' ELSE 'other' END"
_MODEL = "concat('m', grp % 4)"


@add(
    "dr9_registered_rules",
    S + f""", x AS (SELECT *, {_MODEL} AS model, {_TAG} AS tag, {OK_SQL} AND {R_SQL} AS hit, source IN ('src0', 'src1', 'src2') AS own FROM scores WHERE i NOT IN (SELECT event_id FROM events WHERE value > 200) AND NOT ({_MODEL} = 'm3' AND {_TAG} = 'old')),
g AS (SELECT model, count(*) FILTER (tag = 'old') AS old_rows, count(*) FILTER (tag = 'noisy') AS noisy_rows, count(*) FILTER (tag = 'clean' AND own AND {T_SQL}) AS an, count(*) FILTER (tag = 'clean' AND own AND {T_SQL} AND hit) AS ak, count(*) FILTER (tag = 'noisy' AND own AND {T_SQL}) AS bn, count(*) FILTER (tag = 'noisy' AND own AND {T_SQL} AND hit) AS bk, count(*) FILTER (tag = 'old' AND {T_SQL} AND source <> 'src4') AS cn, count(*) FILTER (tag = 'old' AND {T_SQL} AND source <> 'src4' AND hit) AS ck, count(*) FILTER (tag = 'clean' AND own AND bucket = 'babble' AND {OK_SQL}) AS bf, count(*) FILTER (tag = 'clean' AND bucket = 'silence' AND {OK_SQL}) AS sf FROM x GROUP BY 1 HAVING count(*) FILTER (tag = 'clean') > 0),
o AS (SELECT *, 1000 * ak >= 965 * an AS a, noisy_rows > 0 AND 100 * bk >= 90 * bn AS b, 100 * ck >= 93 * cn AS c, bf = 0 AND sf <= coalesce((SELECT sf FROM g WHERE model = 'm0'), 0) AS d FROM g)
SELECT model, CASE WHEN a THEN 'PASS' ELSE 'FAIL' END AS A, CASE WHEN b THEN 'PASS' ELSE 'FAIL' END AS B, CASE WHEN old_rows = 0 THEN 'n/a' WHEN c THEN 'PASS' ELSE 'FAIL' END AS C, CASE WHEN d THEN 'PASS' ELSE 'FAIL' END AS D, CASE WHEN old_rows = 0 THEN 'n/a' WHEN a AND b AND c AND d THEN 'PASS' ELSE 'FAIL' END AS verdict FROM o""",
)
def dr9(spark, d):
    s = scores(spark, d)
    x = s.withColumns({"model": F.expr(_MODEL), "tag": F.expr(_TAG), "own_source": F.when(F.col("source").isin("src0", "src1", "src2"), "own").otherwise(F.col("source"))})
    x = x.where("NOT (model = 'm3' AND tag = 'old')")  # a model that was not scored on the old test
    return D.registered_rules(x, "model", "m0", s.where("value > 200"), "i", "tag", "own_source", "own", "src4", TARGET(), RIGHT(), OK())


@add("dr10_two_conditions", S + f", {SWEEP_SQL}, t AS (SELECT threshold FROM sweep ORDER BY j DESC, threshold DESC LIMIT 1) SELECT cond, max(threshold) AS threshold, count(*) FILTER ({T_SQL}) AS n, count(*) FILTER ({T_SQL} AND confidence >= threshold AND {R_SQL}) / count(*) FILTER ({T_SQL})::DOUBLE AS accuracy, count(*) FILTER (NOT ({T_SQL}) AND confidence >= threshold) / count(*) FILTER (NOT ({T_SQL}))::DOUBLE AS false_rate FROM scores, t WHERE split = 'test' GROUP BY 1")
def dr10(spark, d):
    s = scores(spark, d)
    t = K.best_threshold(M.sweep(s.where("split = 'val'"), GRID, TARGET()))
    return D.two_conditions(s.where("split = 'test'"), t, "cond", TARGET(), RIGHT())


@add("dr11_ghost_probe", S + f", g AS (SELECT source, count(*) AS n, count(*) FILTER ({OK_SQL}) AS base_fa, count(*) FILTER ({NEW_SQL}) AS new_fa FROM scores WHERE NOT ({T_SQL}) GROUP BY 1) SELECT source, n, base_fa, new_fa, round({wilson_sql('new_fa', 'n', True)}, 6) AS upper, new_fa <= base_fa AS ok FROM g")
def dr11(spark, d):
    return D.ghost_probe(scores(spark, d).where(~TARGET()), "source", OK(), NEW()).withColumn("upper", F.round("upper", 6))


_GHOST = "split = 'train' AND bucket = 'silence'"  # rows that stand for the ghost probe


def ghost_counts(cube, base, new):
    return cube.where("ghost").agg(D._sum("n", base).alias("b"), D._sum("n", new).alias("s"))


@add(
    "dr12_cell_gate",
    S + f""", {_PILOT}, {_acc('ag', 'p', 'tau', _GHOST)}, gh AS (SELECT count(*) FILTER (ok AND {_B_SIDE}) AS b, count(*) FILTER (ok AND {_side("'d2-per_intent'", 'none')}) AS s FROM ag), mm AS (SELECT split, cond, coalesce(sum(exact) FILTER ({_B_SIDE}), 0) AS be, coalesce(sum(exact) FILTER ({_side("'d2-per_intent'", 'none')}), 0) AS se, coalesce(sum(fa) FILTER ({_B_SIDE}), 0) AS bf, coalesce(sum(fa) FILTER ({_side("'d2-per_intent'", 'none')}), 0) AS sf FROM m GROUP BY 1, 2),
ll AS (SELECT split, cond, label, sum(n) FILTER ({_B_SIDE}) AS n, sum(exact) FILTER ({_B_SIDE}) AS be, sum(exact) FILTER ({_side("'d2-per_intent'", 'none')}) AS se FROM l GROUP BY 1, 2, 3), f AS (SELECT coalesce(string_agg(concat(label, '@', split, '/', cond), ',' ORDER BY concat(label, '@', split, '/', cond)), '') AS fails FROM ll WHERE n >= 50 AND 100 * (se - be) < -3 * n),
c AS (SELECT coalesce(bool_and(sf <= bf) FILTER (split = 'test'), TRUE) AS fa_ok, coalesce(bool_and(se >= be), TRUE) AS exact_ok FROM mm) SELECT fa_ok, exact_ok, fails, fa_ok AND exact_ok AND fails = '' AS p1, s <= b AS p2 FROM c, f, gh""",
)
def dr12(spark, d):
    new = "d2-per_intent|none"
    cube, ok = pilot_cube(pilot(spark, d), [B, new], marks={"ghost": F.expr(_GHOST)})
    return D.cell_gate(pilot_outcomes(cube, ok), B, new, ghost_counts(cube, ok[B], ok[new]))


def _loosest(source, key=""):
    """lo: the smallest clean validation target score with no more false accepts than the baseline, in each condition."""
    k = f"{key}, " if key else ""
    part = f"PARTITION BY {k}cond"
    join = f"USING ({key})" if key else "ON TRUE"
    return f"""bu AS (SELECT {k}cond, count(*) FILTER ({_REJ} AND {OK_SQL} AND (gap IS NULL OR gap >= 4)) AS budget FROM {source} WHERE split = 'val' GROUP BY ALL), rj AS (SELECT {k}cond, d2, row_number() OVER ({part} ORDER BY d2 DESC) AS r FROM {source} WHERE split = 'val' AND {_REJ} AND intent IS NOT NULL AND d2 IS NOT NULL),
ed AS (SELECT {k}max(coalesce(x, '-inf'::DOUBLE)) AS edge FROM (SELECT {', '.join(f'bu.{c}' for c in ([key] if key else []))}{', ' if key else ''}bu.cond, (SELECT max(d2) FROM rj WHERE rj.cond = bu.cond{f' AND rj.{key} = bu.{key}' if key else ''} AND r = budget + 1) AS x FROM bu) {f'GROUP BY {key}' if key else ''}),
lo AS (SELECT {k}min(d2) AS tau FROM {source} JOIN ed {join} WHERE split = 'val' AND cond = 'clean' AND {T_SQL} AND d2 > edge {f'GROUP BY {key}' if key else ''})"""


@add(
    "dr13_threshold_stability",
    R + f""", {_P}, {_HALF}, hp AS (SELECT p.*, half FROM p JOIN halves USING (grp)), {_loosest('hp', 'half')}, x AS (SELECT v.*, {OK_SQL} AND (gap IS NULL OR gap >= 4) AS bok, coalesce(intent IS NOT NULL AND d2 >= tau, FALSE) AS sok FROM hp v LEFT JOIN lo ON lo.half = 1 - v.half WHERE split = 'val'),
m AS (SELECT half, cond, count(*) FILTER ({T_SQL}) AS n, count(*) FILTER ({T_SQL} AND {R_SQL} AND bok) AS be, count(*) FILTER ({T_SQL} AND {R_SQL} AND sok) AS se, count(*) FILTER ({_REJ} AND bok) AS bf, count(*) FILTER ({_REJ} AND sok) AS sf FROM x GROUP BY ALL), pc AS (SELECT coalesce(bool_and(1000 * (se - be) >= -5 * n), TRUE) AS s3 FROM (SELECT cond, sum(se) AS se, sum(be) AS be, sum(n) AS n FROM m GROUP BY 1)),
t AS (SELECT max(tau) FILTER (half = 0) AS tau0, max(tau) FILTER (half = 1) AS tau1 FROM lo), r AS (SELECT tau0, tau1, coalesce(abs(tau0 - tau1) <= 0.3::DOUBLE, FALSE) AS s1, coalesce((SELECT bool_and(sf <= bf) FROM m), FALSE) AS s2, s3 FROM t, pc) SELECT *, CASE WHEN s1 AND s2 AND s3 THEN 'STABLE' ELSE 'UNSTABLE' END AS verdict FROM r""",
)
def dr13(spark, d):
    v = halved(pilot(spark, d)).where("split = 'val'")
    counts = D.score_counts(v, D.budget_cells("d2", gated_ok(), F.col("half").cast("string"), F.lit(True)))
    taus = keep(D.budget_tau(counts).select(F.col("key").cast("int").alias("half"), "tau"), "thresholds")
    x = v.join(taus.select((1 - F.col("half")).alias("half"), "tau"), "half", "left")
    cube, ok = D.decision_cube(x, ["half", "cond"], {"b": gated_ok(), "s": accepted(F.col("intent"), F.col("d2"), F.col("tau"))})
    return D.stability(D.outcomes(cube, ["half", "cond"], ok, "b"), taus)


@add(
    "dr14_loosening_curve",
    S + f""", {_P}, {_tau('tau', 'p')}, {_loosest('p')}, tt AS (SELECT (SELECT tau FROM lo) AS hi, (SELECT tau FROM tau WHERE scorer = 'd2' AND margin = 'none' AND place = '*') AS iso), st AS (SELECT i AS step, CASE WHEN i = 8 THEN hi ELSE iso + (hi - 0.3::DOUBLE - iso) * i / 7 END AS tau FROM tt, range(9) r(i)),
y AS (SELECT p.*, {OK_SQL} AND (gap IS NULL OR gap >= 4) AS bok, coalesce(intent IS NOT NULL AND d2 >= hi, FALSE) AS sok FROM p, tt), w AS (SELECT split, cond, count(*) FILTER ({T_SQL} AND {R_SQL} AND bok) AS be, count(*) FILTER ({T_SQL} AND {R_SQL} AND sok) AS se, count(*) FILTER ({_REJ} AND bok) AS bf, count(*) FILTER ({_REJ} AND sok) AS sf FROM y WHERE split <> 'train' GROUP BY ALL),
lb AS (SELECT split, label, count(*) FILTER (cond = 'clean') AS n, count(*) FILTER (cond = 'clean' AND {R_SQL} AND bok) AS bc, count(*) FILTER (cond = 'clean' AND {R_SQL} AND sok) AS sc, count(*) FILTER (cond = 'noisy' AND {R_SQL} AND bok) AS bn, count(*) FILTER (cond = 'noisy' AND {R_SQL} AND sok) AS sn FROM y WHERE split <> 'train' AND {T_SQL} GROUP BY ALL),
gh AS (SELECT count(*) FILTER (bok) AS b, count(*) FILTER (sok) AS s FROM y WHERE {_GHOST}), ru AS (SELECT (SELECT coalesce(bool_and(sf <= bf), TRUE) FROM w WHERE split = 'test') AS l1, (SELECT s <= b FROM gh) AS l2, (SELECT coalesce(bool_and(se >= be), TRUE) FROM w) AS l3, coalesce((SELECT string_agg(place, ',' ORDER BY place) FROM (SELECT concat(label, '@', split, '/clean') AS place FROM lb WHERE n >= 50 AND 100 * (sc - bc) < -3 * n UNION ALL SELECT concat(label, '@', split, '/noisy') FROM lb WHERE n >= 50 AND 100 * (sn - bn) < -3 * n)), '') AS failing),
cu AS (SELECT split, cond, step, any_value(st.tau) AS tau, count(*) FILTER ({T_SQL} AND {R_SQL} AND d2 >= st.tau) AS exact, count(*) FILTER ({_REJ} AND intent IS NOT NULL AND d2 >= st.tau) AS fa, {', '.join(f"count(*) FILTER ({T_SQL} AND {R_SQL} AND label = '{w}' AND d2 >= st.tau) AS exact_{w}" for w in TIME_STOP)} FROM p, st WHERE split <> 'train' GROUP BY ALL),
cg AS (SELECT step, count(*) FILTER (intent IS NOT NULL AND d2 >= st.tau AND {_REJ}) AS ghost_fa FROM p, st WHERE {_GHOST} GROUP BY ALL)
SELECT split, cond, step::INT AS step, round(tau, 9) AS tau, exact, fa, {', '.join(f'exact_{w}' for w in TIME_STOP)}, ghost_fa, l1, l2, l3, failing = '' AS l4, failing, CASE WHEN l1 AND l2 AND l3 AND failing = '' THEN 'PASS' ELSE 'FAIL' END AS verdict FROM cu JOIN cg USING (step), ru""",
)
def dr14(spark, d):
    p = pilot(spark, d)
    val = F.col("split") == "val"
    iso = D.calibration_cells({"d2": "d2"}, BASE, None, "iso|", val & (F.col("cond") == "clean") & TARGET())
    counts = D.score_counts(p, [*iso[:1], *D.budget_cells("d2", gated_ok(), F.lit("*"), val)])
    low = D.calibrated(counts.where("every")).agg(F.max("tau").alias("low"))
    ends = keep(D.budget_tau(counts.where("NOT every")).agg(F.max("tau").alias("high")).crossJoin(low), "thresholds")
    x = p.crossJoin(ends).withColumn("taus", D.curve_taus(F.col("low"), F.col("high")))
    scored = F.col("intent").isNotNull() & F.col("d2").isNotNull()
    met = F.transform("taus", lambda t: F.coalesce(scored & (F.col("d2") >= t), F.lit(False)))
    cube, ok = D.decision_cube(x, ["split", "cond"], {"b": gated_ok(), "s": accepted(F.col("intent"), F.col("d2"), F.col("high"))}, {"ghost": F.expr(_GHOST), "met": met, "taus": F.col("taus")})
    known = cube.where("split <> 'train'")
    out = D.outcomes(known, ["split", "cond"], ok, "b")
    sides = {"b": "b", "s": "s"}
    rules = D.loosening(D.condition_row(out, ["split"], sides), D.label_rows(out, ["split"], sides), ghost_counts(cube, ok["b"], ok["s"]))
    curve = D.loosening_curve(cube, ["split", "cond"], F.col("taus"), "met", F.col("split") != "train", F.col("ghost"), TIME_STOP)
    return curve.withColumn("tau", F.round("tau", 9)).crossJoin(rules)


_BASE = f"count(*) FILTER ({T_SQL}) AS n, count(*) FILTER ({T_SQL} AND {OK_SQL} AND {R_SQL}) AS base_exact, count(*) FILTER ({T_SQL} AND {NEW_SQL} AND {R_SQL}) AS new_exact, count(*) FILTER (NOT ({T_SQL}) AND {NEW_SQL}) AS new_fa"


@add("dr15_promotion_bar", S + f", r AS (SELECT {_BASE} FROM scores), e AS (SELECT count(*) FILTER (json_extract_string(props, '$.k') IS NULL) AS drops FROM events) SELECT unnest(['triggers', 'accepts', 'recall', 'drops']) AS criterion, unnest([new_exact <= base_exact, new_fa = 0, 100 * (new_exact - base_exact) >= -n, drops = 0]) AS ok FROM r, e")
def dr15(spark, d):
    s = scores(spark, d)
    n = lambda c, name: F.count_if(c).alias(name)
    hit, new = TARGET() & OK() & RIGHT(), TARGET() & NEW() & RIGHT()
    row = s.agg(n(new, "triggers"), n(hit, "base_triggers"), n(~TARGET() & NEW(), "accepts"), n(new, "recall_k"), n(hit, "base_k"), n(TARGET(), "n"))
    drops = table(spark, d, "events").agg(F.count_if(F.get_json_object("props", "$.k").isNull()).alias("drops"))
    return D.promotion(row.crossJoin(drops))
