"""Queries of retrieval, prediction, ensembles and run comparison on the driver tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridict.functions import text as tx
from veridict.operators import ensemble, prediction, retrieval
from veridict.plans.adapters import oracle, view
from veridict.sources.tables import spread


Q, O = {}, {}


def query(name, needs, build, sql=None):
    Q[name] = lambda spark, sf_dir: build(*[view(spark, sf_dir, n) for n in needs])
    if sql:
        O[name] = oracle(sql)


# --- text ---
DOC = "SELECT doc_id, text FROM documents"
query("p13_ascii_tokens", ["benchmark"], lambda b: b.select("item_id", F.posexplode(tx.ascii_tokens(F.col("text")))).select("item_id", "pos", F.col("col").alias("token")), "SELECT item_id, CAST(i - 1 AS INTEGER) AS pos, list_extract(t, i) AS token FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-zA-Z0-9_]+') AS t FROM benchmark), unnest(range(1, len(t) + 1)) AS u(i)")
query("p14_mixed_tokens", ["documents"], lambda d: d.select("doc_id", F.size(tx.mixed_tokens(F.col("text"))).cast("long").alias("tokens")), "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-zа-яё0-9]+')) AS tokens FROM documents")
query("p15_normal_text", ["documents"], lambda d: d.select("doc_id", F.md5(tx.normal(F.col("text"))).alias("digest")), "SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS digest FROM documents")
query("p5_text_fallback", ["orders"], lambda o: o.select("o_orderkey", tx.first_filled(F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderpriority")), F.when(F.col("o_orderkey") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderstatus"))).alias("text")), "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS text FROM orders")
PARTS = ", ".join(f"'{p}'" for p in tx.FORBIDDEN_ID_PARTS)
IDS = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('sas_', lpad(CAST(event_id AS STRING), 8, 'a')) WHEN 1 THEN concat('sas_seed_', CAST(event_id AS STRING)) WHEN 2 THEN concat('sas_', CAST(event_id AS STRING)) WHEN 3 THEN concat('sas_', lpad(CAST(event_id AS STRING), 8, '0')) ELSE concat('SAS_gold', CAST(event_id AS STRING)) END AS id FROM {events}"
query("p17_id_shape", ["events"], lambda e: e.sparkSession.sql(IDS, events=e).select("event_id", "id", F.array_join(tx.id_problems(F.col("id")), ",").alias("problems")),
      f"WITH ids AS ({IDS.format(events='events')}) SELECT event_id, id, concat_ws(',', CASE WHEN NOT regexp_matches(id, '^sas_[a-z0-9]{{8}}$') THEN 'shape' END, CASE WHEN list_bool_or(list_transform([{PARTS}], lambda p: contains(lower(id), p))) THEN 'word' END, CASE WHEN regexp_matches(id, '_[0-9]{{2,}}$') THEN 'counter' END) AS problems FROM ids")
# --- predictions ---
REPLY = "SELECT event_id AS instance_id, concat(CASE WHEN event_id % 3 = 0 THEN 'Here: ' ELSE '' END, CASE WHEN event_id % 7 = 0 THEN 'no object' ELSE props END, CASE WHEN event_id % 3 = 0 THEN ' as asked.' ELSE '' END) AS reply FROM {events}"
query("p8_json_recover", ["events"], lambda e: e.sparkSession.sql(REPLY, events=e).select("instance_id", F.coalesce(F.try_variant_get(prediction.recover_json(F.col("reply")), "$.k", "bigint"), F.lit(-1)).alias("k")), f"WITH r AS ({REPLY.format(events='events')}) SELECT instance_id, coalesce(TRY_CAST(nullif(regexp_extract(reply, '\"k\": *([0-9]+)', 1), '') AS BIGINT), -1) AS k FROM r")
RAW = """SELECT event_id AS instance_id, concat('{{"instance_id": "', CAST(event_id AS STRING), '", "verdict": "', CASE WHEN event_id % 4 = 0 THEN 'maybe' ELSE 'contradicted' END, '", "confidence": ', CASE event_id % 5 WHEN 0 THEN '"high"' WHEN 1 THEN 'true' WHEN 2 THEN '1.5' ELSE '0.25' END,
  ', "predicted_eids": ', CASE WHEN event_id % 6 = 0 THEN '"e1"' ELSE '["e2", "zz", "e2", "e1"]' END, ', "issue_tags": ["ablation", "unsupported_generalization"], "abstain": ', CASE WHEN event_id % 7 = 0 THEN '"yes"' ELSE 'true' END, ', "rationale_short": "', CASE WHEN event_id % 2 = 0 THEN ' ' ELSE 'ok ' END, '"}}') AS raw FROM {events}"""
raw = lambda e: e.sparkSession.sql(RAW, events=e).withColumn("parsed", F.try_parse_json("raw"))
query("p6_validity", ["events"], lambda e: raw(e).select("instance_id", F.array_join(prediction.problems(F.col("parsed")), ",").alias("problems")), "SELECT event_id AS instance_id, concat_ws(',', CASE WHEN event_id % 4 = 0 THEN 'verdict' END, CASE WHEN event_id % 5 IN (0, 2) THEN 'confidence' END, CASE WHEN event_id % 6 = 0 THEN 'predicted_eids' END, CASE WHEN event_id % 7 = 0 THEN 'abstain' END) AS problems FROM events")
query("p7_normalise", ["events"], lambda e: prediction.normalise(raw(e).select("instance_id", "parsed", F.array(F.lit("e1"), F.lit("e2")).alias("allowed"))).select("instance_id", "verdict", "confidence", F.array_join("predicted_eids", ",").alias("eids"), F.array_join("issue_tags", ",").alias("tags"), "abstain", "rationale_short"),
      "SELECT event_id AS instance_id, CASE WHEN event_id % 4 = 0 THEN 'insufficient' ELSE 'contradicted' END AS verdict, CAST(CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 0.25 END AS DOUBLE) AS confidence, CASE WHEN event_id % 6 = 0 THEN '' ELSE 'e2,e1' END AS eids, 'unsupported_generalization' AS tags, event_id % 7 <> 0 AS abstain, CASE WHEN event_id % 2 = 0 THEN 'Normalized structured prediction.' ELSE 'ok' END AS rationale_short FROM events")
CLAIMS = "SELECT p.instance_id, CASE WHEN p.instance_id % 3 = 0 THEN 'It wins on all sets' WHEN p.instance_id % 3 = 1 THEN 'Always better' ELSE 'It is anywhere better' END AS text, count(*) AS n FROM {pack} p GROUP BY p.instance_id"
query("p9_fallback", ["events"], lambda e: prediction.fallback_count(prediction.with_fallback(e.sparkSession.sql(REPLY, events=e).select("instance_id", prediction.recover_json(F.col("reply")).alias("parsed"), F.lit("warranted").alias("verdict"), F.lit(0.5).alias("confidence"), F.lit(False).alias("abstain"), F.lit("x").alias("rationale_short")))), "SELECT count(*) FILTER (event_id % 7 = 0) AS fallbacks, count(*) AS total FROM events")
query("p10_constant", ["events"], lambda e: prediction.constant_predictor(e.select(F.col("event_id").alias("instance_id"))).withColumn("issue_tags", F.array_join("issue_tags", ",")), "SELECT event_id AS instance_id, 'insufficient' AS verdict, CAST(0.25 AS DOUBLE) AS confidence, 'evidence_missing_or_incomplete' AS issue_tags, false AS abstain FROM events")
query("p11_rule_model", ["pack"], lambda p: prediction.rule_predictor(p.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "eid"))).alias("u")).select("instance_id", F.when(F.col("instance_id") % 3 == 0, "It wins on all sets").when(F.col("instance_id") % 3 == 1, "Always better").otherwise("It is anywhere better").alias("text"), F.col("u.eid").alias("eids"))).withColumn("predicted_eids", F.array_join("predicted_eids", ",")),
      f"WITH c AS ({CLAIMS.format(pack='[pack]')}) SELECT instance_id, CASE WHEN instance_id % 3 = 2 THEN 'warranted' WHEN n >= 2 THEN 'overclaimed' ELSE 'insufficient' END AS verdict, CAST(CASE WHEN instance_id % 3 = 2 THEN 0.6 WHEN n >= 2 THEN 0.7 ELSE 0.3 END AS DOUBLE) AS confidence, CASE WHEN instance_id % 3 < 2 AND n >= 2 THEN 'e1,e2' ELSE 'e1' END AS predicted_eids, false AS abstain FROM c")
query("p12_prompt", ["orders"], lambda o: o.select("o_orderkey", prediction.prompt(F.col("o_orderpriority"), F.array(F.struct(F.lit("e1").alias("eid"), F.col("o_orderstatus").alias("text")), F.struct(F.lit("e2").alias("eid"), F.lit("b").alias("text")))).alias("p")).select("o_orderkey", prediction.parse_prompt(F.col("p")).alias("x")).select("o_orderkey", "x.claim", F.array_join("x.eids", ",").alias("eids")), "SELECT o_orderkey, o_orderpriority AS claim, 'e1,e2' AS eids FROM orders")
# --- retrieval ---
UNITS = "SELECT b.item_id AS instance_id, d.doc_id AS ordinal, d.text FROM {documents} d JOIN {benchmark} b ON d.doc_id % (SELECT count(*) FROM {benchmark}) = b.item_id"
query("w7_bm25_topk", ["benchmark", "documents"], lambda b, d: retrieval.bm25(b.selectExpr("item_id AS instance_id", "text"), b.sparkSession.sql(UNITS, benchmark=b, documents=spread(d))).withColumn("place", F.col("place").cast("long")),
      f"""WITH units AS ({UNITS.format(benchmark='benchmark', documents='documents')}), t AS (SELECT instance_id, ordinal, regexp_extract_all(lower(text), '[a-zA-Z0-9_]+') AS w FROM units), s AS (SELECT instance_id, count(*) AS n, avg(len(w)) AS mean FROM t GROUP BY instance_id),
      q AS (SELECT item_id AS instance_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')) AS term FROM benchmark), tf AS (SELECT instance_id, ordinal, len(w) AS length, term, count(*) AS tf FROM (SELECT instance_id, ordinal, w, unnest(w) AS term FROM t) GROUP BY ALL), df AS (SELECT instance_id, term, count(*) AS df FROM tf GROUP BY ALL),
      sc AS (SELECT tf.instance_id, tf.ordinal, sum(ln(1 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * length / mean))) AS score FROM q JOIN tf ON q.instance_id = tf.instance_id AND q.term = tf.term JOIN df ON df.instance_id = tf.instance_id AND df.term = tf.term JOIN s ON s.instance_id = tf.instance_id GROUP BY 1, 2),
      r AS (SELECT t.instance_id, t.ordinal, round(coalesce(score, 0), 9) AS score FROM t LEFT JOIN sc ON t.instance_id = sc.instance_id AND t.ordinal = sc.ordinal) SELECT instance_id, ordinal, score, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, ordinal) AS place FROM r QUALIFY place <= 3""")  # fmt: skip
query("w8_full_pack", ["pack"], lambda p: retrieval.full_pack(p.select("instance_id", "ordinal", "eid")).withColumn("place", F.col("place").cast("long")), "SELECT instance_id, ordinal, eid, ordinal AS place FROM [pack]")
# --- ensemble ---
VOTES = """sums AS (SELECT instance_id, verdict, count(*) AS n, avg(confidence) AS mean, arg_min(no_eids, ballot_no) AS no_eids FROM [ballots] GROUP BY ALL), totals AS (SELECT instance_id, sum(n) AS ballots FROM sums GROUP BY 1),
  votes AS (SELECT t.instance_id, s.verdict, s.n AS wins, CAST(t.ballots AS BIGINT) AS ballots, s.n / t.ballots AS agreement, s.mean AS mean_confidence, s.no_eids FROM totals t LEFT JOIN (SELECT * FROM sums WHERE verdict IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY n DESC, verdict) = 1) s ON t.instance_id = s.instance_id)"""
FIRED = "emitted AS (SELECT *, concat_ws(',', CASE WHEN verdict IS NULL THEN 'unparsable_json' END, CASE WHEN mean_confidence < CAST(0.95 AS DOUBLE) THEN 'low_confidence' END, CASE WHEN verdict IN ('warranted', 'overclaimed', 'contradicted') AND no_eids THEN 'empty_evidence' END, CASE WHEN verdict IS NOT NULL AND agreement <= CAST(0.5 AS DOUBLE) THEN 'ensemble_split' END) AS fired FROM votes)"
query("a19_majority", ["ballots"], lambda b: ensemble.majority(b).select("instance_id", "verdict", F.coalesce("wins", F.lit(0)).alias("wins"), "ballots", F.round("agreement", 9).alias("agreement"), F.round("mean_confidence", 9).alias("mean_confidence")), f"WITH {VOTES} SELECT instance_id, verdict, coalesce(wins, 0) AS wins, ballots, round(agreement, 9) AS agreement, round(mean_confidence, 9) AS mean_confidence FROM votes")
emitted = lambda b: ensemble.abstain(ensemble.majority(b), threshold=0.95)
query("x_abstain", ["ballots"], lambda b: emitted(b).select("instance_id", "verdict", "abstain", F.array_join("fired", ",").alias("fired")), f"WITH {VOTES}, {FIRED} SELECT instance_id, CASE WHEN fired <> '' THEN 'insufficient' ELSE verdict END AS verdict, fired <> '' AS abstain, fired FROM emitted")
conflicting = lambda b: ensemble.abstain(ensemble.majority(b).withColumn("conflict", F.col("instance_id") % 3 == 0), threshold=0.95, conflict="conflict")
query("x4_conflict", ["ballots"], lambda b: conflicting(b).select("instance_id", "verdict", F.array_join("fired", ",").alias("fired")), f"WITH {VOTES}, {FIRED}, c AS (SELECT instance_id, verdict, concat_ws(',', nullif(replace(replace(fired, ',ensemble_split', ''), 'ensemble_split', ''), ''), CASE WHEN verdict <> 'contradicted' AND instance_id % 3 = 0 THEN 'checker_conflict' END, CASE WHEN contains(fired, 'ensemble_split') THEN 'ensemble_split' END) AS fired FROM emitted) SELECT instance_id, CASE WHEN fired <> '' THEN 'insufficient' ELSE verdict END AS verdict, fired FROM c")
query("x6_emission", ["ballots"], lambda b: emitted(b).select("instance_id", tx.rounded(F.col("confidence"), 3).alias("confidence"), (F.col("rationale_short").isNotNull()).alias("explained")), f"WITH {VOTES}, {FIRED} SELECT instance_id, round(round(coalesce(agreement * mean_confidence, 0), 4), 3) AS confidence, fired <> '' AS explained FROM emitted")
query("x7_ablation", ["ballots"], lambda b: ensemble.rule_counts(ensemble.abstain(ensemble.majority(b), threshold=0.95, disabled=("low_confidence", "ensemble_split"))), f"WITH {VOTES}, {FIRED} SELECT rule, count(*) AS n FROM (SELECT unnest(string_split(fired, ',')) AS rule FROM emitted) WHERE rule IN ('unparsable_json', 'empty_evidence') GROUP BY rule")
query("a27_rule_counts", ["ballots"], lambda b: ensemble.rule_counts(emitted(b)), f"WITH {VOTES}, {FIRED} SELECT rule, count(*) AS n FROM (SELECT unnest(string_split(fired, ',')) AS rule FROM emitted) WHERE rule <> '' GROUP BY rule")
RUNS = "passes AS (SELECT system, pass, CAST(count(*) FILTER (verdict = gold) AS DOUBLE) / count(*) AS accuracy, CAST(count(*) FILTER (verdict = 'warranted' AND gold <> 'warranted') AS DOUBLE) / count(*) FILTER (gold <> 'warranted') AS sfwr FROM [runs] GROUP BY system, pass)"
MEDIANS = "medians AS (SELECT system, metric, median(value) AS median, min(value) AS least, max(value) AS most, count(*) AS repeats, list(value ORDER BY pass) AS every FROM (SELECT system, pass, 'accuracy' AS metric, accuracy AS value FROM passes UNION ALL SELECT system, pass, 'sfwr', sfwr FROM passes) GROUP BY system, metric)"
passes = lambda r: r.groupBy("system", "pass").agg((F.count_if(F.col("verdict") == F.col("gold")) / F.count(F.lit(1))).alias("accuracy"), (F.count_if((F.col("verdict") == "warranted") & (F.col("gold") != "warranted")) / F.count_if(F.col("gold") != "warranted")).alias("sfwr"))
medians = lambda r: ensemble.repeat_medians(passes(r), ("accuracy", "sfwr"))
query("a20_median", ["runs"], lambda r: medians(r).withColumn("values", F.array_join(F.transform("values", lambda x: F.floor(x * 1000000 + 0.5).cast("string")), ",")),
      f"WITH {RUNS}, {MEDIANS} SELECT * EXCLUDE (every), array_to_string(list_transform(every, lambda x: CAST(CAST(floor(x * 1000000 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS VARCHAR)), ',') AS \"values\" FROM medians")
query("a21_dominance", ["runs"], lambda r: ensemble.dominance(medians(r)), f"""WITH {RUNS}, {MEDIANS}, g AS (SELECT *, CASE WHEN metric = 'sfwr' THEN -1 ELSE 1 END AS sign FROM medians), b AS (SELECT metric, system, sign * median AS m, greatest(sign * least, sign * most) AS best, least(sign * least, sign * most) AS worst FROM g),
  l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY metric ORDER BY m DESC, system) = 1) SELECT l.metric, l.system AS leader, CASE WHEN l.worst > max(b.best) THEN 'strict' WHEN l.worst >= max(b.best) THEN 'weak' ELSE 'none' END AS dominance FROM l JOIN b ON l.metric = b.metric AND l.system <> b.system GROUP BY l.metric, l.system, l.worst""")  # fmt: skip
