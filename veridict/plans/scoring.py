"""Queries of the evaluator on the driver tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridict.operators import evaluation as ev
from veridict.operators import selective as sel
from veridict.plans.adapters import oracle, view

Q, O = {}, {}


def query(name, needs, build, sql=None):
    Q[name] = lambda spark, sf_dir: build(*[view(spark, sf_dir, n) for n in needs])
    if sql:
        O[name] = oracle(sql)


ROWS = "rows_ AS (SELECT g.instance_id, g.verdict AS gold, g.supporting_eids, g.issue_tags AS gold_tags, p.* EXCLUDE (instance_id) FROM [gold] g JOIN [pred] p ON g.instance_id = p.instance_id WHERE NOT coalesce(p.abstain, false))"
V = "(VALUES ('warranted'), ('overclaimed'), ('contradicted'), ('insufficient'))"
PRF = "CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END AS f1"
CLASSES = f"classes AS (SELECT v.c AS class, count(*) FILTER (gold = v.c AND verdict = v.c) AS tp, count(*) FILTER (gold <> v.c AND verdict = v.c) AS fp, count(*) FILTER (gold = v.c AND verdict <> v.c) AS fn FROM {V} v(c) CROSS JOIN rows_ GROUP BY v.c)"
INTER = "len(list_filter(list_distinct({a}), lambda x: list_contains({b}, x)))"
DIFF = "len(list_filter(list_distinct({a}), lambda x: NOT list_contains({b}, x)))"
SETS = lambda g, p: f"CAST(sum({INTER.format(a=g, b=p)}) AS BIGINT) AS tp, CAST(sum({DIFF.format(a=p, b=g)}) AS BIGINT) AS fp, CAST(sum({DIFF.format(a=g, b=p)}) AS BIGINT) AS fn"
TAGS = "tags AS (SELECT tag, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM (SELECT instance_id, tag, bool_or(s = 'g') AS g, bool_or(s = 'p') AS p FROM (SELECT instance_id, unnest(gold_tags) AS tag, 'g' AS s FROM rows_ UNION ALL SELECT instance_id, unnest(issue_tags), 'p' FROM rows_) GROUP BY instance_id, tag) GROUP BY tag)"
BINNED = "bins AS (SELECT CAST(least(9, floor(c * 10)) AS BIGINT) AS bin, count(*) AS n, sum(h) AS hits, avg(c) AS mean FROM (SELECT least(greatest(confidence, 0), 1) AS c, CASE WHEN gold = verdict THEN 1 ELSE 0 END AS h FROM rows_) GROUP BY 1)"
ECE_BINS = "ebins AS (SELECT bin, n, CAST(hits AS DOUBLE) / n AS accuracy, round(mean, 9) AS confidence, round(hits / n - mean, 9) AS gap FROM bins)"
SLICED = "sliced AS (SELECT r.*, CASE WHEN coalesce(s.is_stress_case, false) THEN 'stress' ELSE 'clean' END AS slice, CASE WHEN s.is_stress_case THEN s.stress_type END AS kind FROM rows_ r LEFT JOIN [stress] s ON r.instance_id = s.instance_id)"
_F1 = lambda v: f"CASE WHEN count(*) FILTER (gold = '{v}' OR verdict = '{v}') > 0 THEN CAST(2 * count(*) FILTER (gold = '{v}' AND verdict = '{v}') AS DOUBLE) / (2 * count(*) FILTER (gold = '{v}' AND verdict = '{v}') + count(*) FILTER (gold <> '{v}' AND verdict = '{v}') + count(*) FILTER (gold = '{v}' AND verdict <> '{v}')) ELSE 0 END"
METRICS = f"count(*) AS n, CAST(count(*) FILTER (gold = verdict) AS DOUBLE) / count(*) AS accuracy, round(({' + '.join(_F1(v) for v in ev.VERDICTS)}) / 4, 9) AS macro_f1, CASE WHEN count(*) FILTER (gold <> 'warranted') > 0 THEN CAST(count(*) FILTER (gold <> 'warranted' AND verdict = 'warranted') AS DOUBLE) / count(*) FILTER (gold <> 'warranted') ELSE 0 END AS sfwr"
UNITS = "units AS (SELECT g.instance_id, coalesce(NOT p.abstain, false) AS answered, CASE WHEN coalesce(NOT p.abstain, false) THEN p.confidence ELSE CAST('-infinity' AS DOUBLE) END AS confidence, CASE WHEN coalesce(NOT p.abstain, false) AND g.verdict = p.verdict THEN 0 ELSE 1 END AS error, CASE WHEN coalesce(NOT p.abstain, false) AND g.verdict <> 'warranted' AND p.verdict = 'warranted' THEN 1 ELSE 0 END AS severe, CASE WHEN g.verdict <> 'warranted' THEN 1 ELSE 0 END AS risky FROM [gold] g LEFT JOIN [pred] p ON g.instance_id = p.instance_id)"
POINTS = """ranked AS (SELECT *, row_number() OVER (ORDER BY answered DESC, confidence DESC, instance_id) AS k, row_number() OVER t AS step, count(*) OVER g AS size, sum(error) OVER g AS ge, sum(severe) OVER g AS gs, sum(risky) OVER g AS gr, count(*) OVER () AS total,
  sum(error) OVER r - sum(error) OVER g AS be, sum(severe) OVER r - sum(severe) OVER g AS bs, sum(risky) OVER r - sum(risky) OVER g AS br FROM units
  WINDOW t AS (PARTITION BY answered, confidence ORDER BY instance_id), g AS (PARTITION BY answered, confidence), r AS (ORDER BY answered DESC, confidence DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
points AS (SELECT k, k / total AS coverage, (be + step / size * ge) / k AS risk, (be + step / size * ge) / total AS generalized, CASE WHEN br + step / size * gr > 0 THEN (bs + step / size * gs) / (br + step / size * gr) ELSE 0 END AS sfwr, answered AS voluntary FROM ranked)"""

rows = lambda f: lambda g, p, *more: f(ev.answered(g, p), *more)
points = lambda f: lambda g, p: f(sel.curve(sel.units(g, p)))

query("j1_join", ["gold", "pred"], rows(lambda r: r.select("instance_id", "gold", "verdict", "confidence")), f"WITH {ROWS} SELECT instance_id, gold, verdict, confidence FROM rows_")
query("j2_missing_extra", ["gold", "submitted"], lambda g, p: ev.missing_extra(g.where("instance_id % 1009 <> 1"), p), "WITH g AS (SELECT instance_id FROM [gold] WHERE instance_id % 1009 <> 1) SELECT instance_id, 'missing' AS side FROM g WHERE instance_id NOT IN (SELECT instance_id FROM [submitted]) UNION ALL SELECT instance_id, 'extra' FROM [submitted] WHERE instance_id NOT IN (SELECT instance_id FROM g)")
query("a1_verdict_prf", ["gold", "pred"], rows(ev.verdict_prf), f"WITH {ROWS}, {CLASSES} SELECT class, tp, fp, fn, {PRF} FROM classes")
query("a2_accuracy", ["gold", "pred"], rows(ev.accuracy), f"WITH {ROWS}, {CLASSES} SELECT (SELECT count(*) FROM rows_) AS answered, (SELECT count(*) FROM rows_ WHERE gold = verdict) AS correct, (SELECT CAST(count(*) FILTER (gold = verdict) AS DOUBLE) / count(*) FROM rows_) AS accuracy, (SELECT round(sum(f1) / 4, 9) FROM (SELECT {PRF} FROM classes)) AS macro_f1")
query("a3_set_prf", ["gold", "pred"], rows(lambda r: ev.set_prf(r, "supporting_eids", "predicted_eids")), f"WITH {ROWS}, s AS (SELECT {SETS('supporting_eids', 'predicted_eids')} FROM rows_) SELECT tp, fp, fn, {PRF} FROM s")
query("a4_tag_prf", ["gold", "pred"], rows(ev.tag_prf), f"WITH {ROWS}, {TAGS} SELECT tag, tp, fp, fn, {PRF} FROM tags")
query("o2_most_missed", ["gold", "pred"], rows(ev.most_missed), f"WITH {ROWS}, {TAGS} SELECT tag, fn FROM tags WHERE fn > 0 ORDER BY fn DESC, tag DESC LIMIT 5")
query("a5_confusion", ["gold", "pred"], rows(ev.confusion), f"WITH {ROWS} SELECT v.c AS gold, " + ", ".join(f"count(*) FILTER (gold = v.c AND verdict = '{x}') AS {x}" for x in ev.VERDICTS) + f" FROM {V} v(c) CROSS JOIN rows_ GROUP BY v.c")
query("a6_sfwr", ["gold", "pred"], rows(ev.severe_false_warrants), f"WITH {ROWS}, s AS (SELECT count(*) FILTER (gold <> 'warranted' AND verdict = 'warranted') AS severe, count(*) FILTER (gold <> 'warranted') AS risky FROM rows_) SELECT severe, risky, CAST(severe AS DOUBLE) / risky AS rate FROM s")
query("a7_abstention", ["gold", "submitted"], ev.abstention, "WITH j AS (SELECT g.verdict, p.abstain AS a FROM [gold] g LEFT JOIN [submitted] p ON g.instance_id = p.instance_id) SELECT verdict AS gold, count(*) AS total, count(*) FILTER (a) AS abstained, count(*) FILTER (a IS NULL) AS missing, CAST(count(*) FILTER (a) AS DOUBLE) / count(*) AS rate FROM j GROUP BY verdict")
query("a8_coverage", ["gold", "pred"], ev.coverage, "WITH j AS (SELECT p.instance_id AS p FROM [gold] g LEFT JOIN (SELECT * FROM [pred] WHERE NOT abstain) p ON g.instance_id = p.instance_id) SELECT count(*) AS total, count(p) AS answered, CAST(count(p) AS DOUBLE) / count(*) AS coverage FROM j")
query("a9_brier", ["gold", "pred"], rows(ev.brier), f"WITH {ROWS} SELECT round(avg(pow(least(greatest(confidence, 0), 1) - CASE WHEN gold = verdict THEN 1 ELSE 0 END, 2)), 9) AS brier FROM rows_")
query("a10_ece_bins", ["gold", "pred"], rows(ev.ece_bins), f"WITH {ROWS}, {BINNED}, {ECE_BINS} SELECT * FROM ebins")
query("a10_ece", ["gold", "pred"], rows(ev.ece), f"WITH {ROWS}, {BINNED}, {ECE_BINS} SELECT round(sum(n * abs(gap)) / sum(n), 6) AS ece FROM ebins")
query("a11_slices", ["gold", "pred", "stress"], rows(ev.slices), f"WITH {ROWS}, {SLICED} SELECT slice, 'all' AS kind, {METRICS} FROM sliced GROUP BY slice UNION ALL SELECT slice, kind, {METRICS} FROM sliced WHERE kind IS NOT NULL GROUP BY slice, kind")
query("a11_degradation", ["gold", "pred", "stress"], rows(ev.degradation), f"WITH {ROWS}, {SLICED}, m AS (SELECT slice, {METRICS} FROM sliced GROUP BY slice) SELECT c.accuracy - s.accuracy AS accuracy, round(c.macro_f1 - s.macro_f1, 9) AS macro_f1, s.sfwr - c.sfwr AS sfwr FROM m c, m s WHERE c.slice = 'clean' AND s.slice = 'stress'")
query("a12_abstention_by_stress", ["gold", "pred", "stress"], ev.abstention_by_stress, "SELECT CASE WHEN s.is_stress_case THEN s.stress_type ELSE 'clean' END AS kind, count(*) AS total, count(*) FILTER (p.abstain) AS abstained, CAST(count(*) FILTER (p.abstain) AS DOUBLE) / count(*) AS rate FROM [stress] s JOIN [gold] g ON s.instance_id = g.instance_id JOIN [pred] p ON s.instance_id = p.instance_id GROUP BY 1")
COST = "cost AS (SELECT round(sum(coalesce(runtime_seconds, 0)), 6) AS runtime_seconds, round(sum(coalesce(gpu_seconds, 0)), 6) AS gpu_seconds, round(sum(coalesce(api_cost_usd, 0)), 6) AS api_cost_usd FROM [pred])"
query("a13_cost", ["pred"], lambda p: ev.cost(p, 10_000.0), f"WITH {COST} SELECT *, least(greatest(api_cost_usd / CAST(10000 AS DOUBLE), 0), 1) AS cost_norm FROM cost")
query(
    "a14_composite", ["gold", "pred"], lambda g, p: ev.composite(ev.answered(g, p), p),
    f"""WITH {ROWS}, {CLASSES}, {TAGS}, {BINNED}, {ECE_BINS}, e AS (SELECT {SETS('supporting_eids', 'predicted_eids')} FROM rows_), t AS (SELECT
      (SELECT round(sum(f1) / 4, 9) FROM (SELECT {PRF} FROM classes)) AS verdict_f1, (SELECT f1 FROM (SELECT {PRF} FROM e)) AS evidence_f1, (SELECT avg(f1) FROM (SELECT {PRF} FROM tags)) AS issue_f1,
      1 - (SELECT CAST(count(*) FILTER (verdict = 'warranted') AS DOUBLE) / count(*) FROM rows_ WHERE gold <> 'warranted') AS safety, 1 - (SELECT round(sum(n * abs(gap)) / sum(n), 6) FROM ebins) AS calibration)
    SELECT round(verdict_f1, 6) AS verdict_f1, round(evidence_f1, 6) AS evidence_f1, round(issue_f1, 6) AS issue_f1, round(safety, 6) AS safety, round(calibration, 6) AS calibration, CAST(NULL AS DOUBLE) AS cost,
      round((CAST(0.3 AS DOUBLE) * verdict_f1 + CAST(0.2 AS DOUBLE) * evidence_f1 + CAST(0.15 AS DOUBLE) * issue_f1 + CAST(0.15 AS DOUBLE) * safety + CAST(0.1 AS DOUBLE) * calibration) / CAST(0.9 AS DOUBLE), 6) AS composite FROM t""",
)
query("a15_systems", ["pred"], ev.systems, "SELECT DISTINCT model FROM [pred]")
query("a16_dedupe", ["lineitem"], lambda x: ev.keep_one(x.selectExpr("l_orderkey AS instance_id", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")), "SELECT l_orderkey AS instance_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, count(*) OVER (PARTITION BY l_orderkey) AS copies FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1")
query("a17_gate", ["gold", "submitted"], ev.gate, "WITH m AS (SELECT count(*) AS missing FROM [gold] g WHERE g.instance_id NOT IN (SELECT instance_id FROM [submitted])) SELECT missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS invalid, missing = 0 AS scoreable FROM m")
query("w1_rank", ["gold", "pred"], lambda g, p: sel.rank(sel.units(g, p)), f"WITH {UNITS} SELECT instance_id, answered, error, severe, row_number() OVER (ORDER BY answered DESC, confidence DESC, instance_id) AS place FROM units")
query("w2_ties", ["gold", "pred"], lambda g, p: sel.groups(sel.units(g, p)).where("answered").select("confidence", "size", "before_size"), f"WITH {UNITS}, t AS (SELECT confidence, count(*) AS size FROM units WHERE answered GROUP BY confidence) SELECT confidence, size, CAST(coalesce(sum(size) OVER (ORDER BY confidence DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_size FROM t")
query("w3_curve", ["gold", "pred"], points(lambda c: c.selectExpr("k", "round(coverage, 9) AS coverage", "round(risk, 9) AS risk", "round(generalized, 9) AS generalized", "round(sfwr, 9) AS sfwr", "voluntary")), f"WITH {UNITS}, {POINTS} SELECT k, round(coverage, 9) AS coverage, round(risk, 9) AS risk, round(generalized, 9) AS generalized, round(sfwr, 9) AS sfwr, voluntary FROM points")
query("w4_aurc", ["gold", "pred"], lambda g, p: sel.areas(sel.units(g, p)), f"WITH {UNITS}, {POINTS} SELECT count(*) AS points, round(avg(risk), 9) AS aurc, round(avg(generalized), 9) AS augrc, round(avg(risk) FILTER (voluntary), 9) AS aurc_voluntary FROM points")
query("w5_fixed_coverage", ["gold", "pred"], points(sel.risk_at), f"WITH {UNITS}, {POINTS}, n AS (SELECT count(*) AS n FROM points), l AS (SELECT CAST(x AS DOUBLE) AS level, least(n, greatest(1, CAST(ceil(CAST(x AS DOUBLE) * n) AS BIGINT))) AS k FROM (VALUES (0.1), (0.2), (0.3), (0.4), (0.5), (0.6), (0.7), (0.8), (0.9), (1.0)) v(x), n) SELECT level, l.k, round(risk, 9) AS risk, round(sfwr, 9) AS sfwr FROM l JOIN points p ON l.k = p.k")
query("w6_coverage_at_sfwr", ["gold", "pred"], points(sel.coverage_at), f"WITH {UNITS}, {POINTS} SELECT CAST(t AS DOUBLE) AS target, round(coalesce(max(coverage) FILTER (voluntary AND sfwr <= CAST(t AS DOUBLE)), 0), 9) AS coverage FROM (VALUES (0.0), (0.05), (0.1), (0.2)) v(t) CROSS JOIN points GROUP BY t")
