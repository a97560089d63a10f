"""Queries of construction, validation, probes and the numeric checker on the driver tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridict.functions import text as tx
from veridict.operators import construction as con
from veridict.operators import leakage, numeric, validation
from veridict.plans.adapters import oracle, view

Q, O = {}, {}


def query(name, needs, build, sql=None):
    Q[name] = lambda spark, sf_dir: build(*[view(spark, sf_dir, n) for n in needs])
    if sql:
        O[name] = oracle(sql)


# --- construction ---
def records(p):
    """Private records whose packs are the lines of an order."""
    unit = F.struct("ordinal", "eid", "source_kind", "modality", F.concat(F.lit("quantity "), F.col("l_quantity").cast("int").cast("string")).alias("text"), F.lit(None).cast("array<struct<value:double,unit:string,context:string>>").alias("normalized_numbers"), F.lit("private").alias("source_ref"))
    packed = p.groupBy("instance_id").agg(F.array_sort(F.collect_list(unit)).alias("evidence"))
    gold = F.struct(F.lit("warranted").alias("verdict"), F.array(F.lit("e1")).alias("supporting_eids"), F.array(F.lit("ablation")).alias("issue_tags"), F.lit("high").alias("severity"))
    return packed.select(F.lit("1").alias("schema_version"), "instance_id", F.struct(F.concat(F.lit("p"), (F.col("instance_id") % 7).cast("string")).alias("paper_id"), F.lit("x").alias("provenance_ref")).alias("paper"), F.struct(F.lit("c").alias("text"), F.lit("ablation").alias("claim_type"), F.lit("s").alias("scope"), F.lit("strong").alias("claim_strength")).alias("claim"), "evidence", gold.alias("gold"))


query("p1_project", ["pack"], lambda p: con.public_input(records(p)).select("instance_id", "paper_id", F.array_join("allowed_evidence_ids", ",").alias("allowed"), F.array_join(F.transform("evidence_pack", lambda u: u["text"]), ";").alias("texts"), F.size(F.json_object_keys(F.to_json("claim"))).cast("long").alias("claim_keys"), F.size(F.json_object_keys(F.to_json(F.col("evidence_pack")[0]))).cast("long").alias("unit_keys")),
      "SELECT instance_id, concat('p', CAST(instance_id % 7 AS STRING)) AS paper_id, string_agg(eid, ',' ORDER BY ordinal) AS allowed, string_agg(concat('quantity ', CAST(CAST(l_quantity AS INTEGER) AS STRING)), ';' ORDER BY ordinal) AS texts, CAST(3 AS BIGINT) AS claim_keys, CAST(4 AS BIGINT) AS unit_keys FROM [pack] GROUP BY instance_id")
query("p2_gold", ["pack"], lambda p: con.public_gold(records(p)).select("instance_id", F.to_json("gold").alias("gold")), """SELECT instance_id, '{"verdict":"warranted","supporting_eids":["e1"],"issue_tags":["ablation"]}' AS gold FROM [pack] GROUP BY instance_id""")
def derived(p):
    inputs, gold = con.derive(records(p))
    return inputs.join(gold, "instance_id").select("instance_id", "paper_id", F.array_join("allowed_evidence_ids", ",").alias("allowed"), F.to_json("gold").alias("gold"))


query("p3_derive", ["pack"], derived, """SELECT instance_id, concat('p', CAST(instance_id % 7 AS STRING)) AS paper_id, string_agg(eid, ',' ORDER BY ordinal) AS allowed, '{"verdict":"warranted","supporting_eids":["e1"],"issue_tags":["ablation"]}' AS gold FROM [pack] GROUP BY instance_id""")
query("p16_fingerprint", ["documents"], lambda d: d.select("doc_id", F.explode(tx.fingerprint(F.array(F.struct(F.lit("e1").alias("eid"), F.col("text").alias("text"))))).alias("u")).select("doc_id", "u.eid", F.md5("u.text").alias("digest")), "SELECT doc_id, 'e1' AS eid, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS digest FROM documents")
PEOPLE = "SELECT c_custkey AS instance_id, concat('n', CAST(c_nationkey AS STRING)) AS paper_id, CASE WHEN c_custkey % 3 = 0 AND c_custkey > 3 THEN c_custkey - 3 END AS seed_instance_id FROM customer"
people = lambda c: c.selectExpr("c_custkey AS instance_id", "concat('n', CAST(c_nationkey AS STRING)) AS paper_id", "CASE WHEN c_custkey % 3 = 0 AND c_custkey > 3 THEN c_custkey - 3 END AS seed_instance_id")
RATIOS = {"public": 0.5, "hidden_val": 0.3, "hidden_test": 0.2}
GREEDY = f"""people AS ({PEOPLE}), g AS (SELECT paper_id, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, paper_id) AS rn FROM people GROUP BY paper_id), t AS (SELECT CAST(sum(size) AS DOUBLE) AS n FROM g),
  f AS (SELECT CAST(0 AS BIGINT) AS rn, -n * CAST(0.2 AS DOUBLE) AS ht, -n * CAST(0.3 AS DOUBLE) AS hv, -n * CAST(0.5 AS DOUBLE) AS pu, '' AS paper_id, CAST(0 AS BIGINT) AS size, '' AS split FROM t UNION ALL
    SELECT s.rn, s.ht + CASE WHEN s.pick = 'hidden_test' THEN s.size ELSE 0 END, s.hv + CASE WHEN s.pick = 'hidden_val' THEN s.size ELSE 0 END, s.pu + CASE WHEN s.pick = 'public' THEN s.size ELSE 0 END, s.paper_id, s.size, s.pick
    FROM (SELECT g.rn, ht, hv, pu, g.paper_id, g.size, CASE WHEN ht <= hv AND ht <= pu THEN 'hidden_test' WHEN hv <= pu THEN 'hidden_val' ELSE 'public' END AS pick FROM f JOIN g ON g.rn = f.rn + 1) s)"""
query("w11_greedy_split", ["customer"], lambda c: con.assign_groups(con.form_groups(people(c), "paper"), RATIOS), f"WITH RECURSIVE {GREEDY} SELECT paper_id AS \"group\", size, split FROM f WHERE rn > 0")
query("j15_split_records", ["customer"], lambda c: con.split_records(people(c), "paper", RATIOS).select("instance_id", "split"), f"WITH RECURSIVE {GREEDY} SELECT instance_id, split FROM people JOIN f ON people.paper_id = f.paper_id")
query("a28_groups", ["customer"], lambda c: con.form_groups(people(c), "seed"), f"WITH people AS ({PEOPLE}) SELECT CAST(coalesce(seed_instance_id, instance_id) AS STRING) AS \"group\", count(*) AS size FROM people GROUP BY 1")
placed = lambda c: people(c).withColumn("split", F.concat(F.lit("s"), (F.col("instance_id") % 2).cast("string")))
query("a25_split_audit", ["customer"], lambda c: con.split_sizes(placed(c)), f"WITH people AS ({PEOPLE}) SELECT concat('s', CAST(instance_id % 2 AS STRING)) AS split, count(*) AS records, count(DISTINCT paper_id) AS papers FROM people GROUP BY 1")
query("a25_shared_papers", ["customer"], lambda c: con.papers_in_several(placed(c)), f"WITH people AS ({PEOPLE}) SELECT paper_id, count(DISTINCT instance_id % 2) AS splits FROM people GROUP BY 1 HAVING count(DISTINCT instance_id % 2) > 1")
query("k7_split_guarantees", ["customer"], lambda c: con.split_problems(placed(c), ("s0", "s1", "s2")), f"WITH people AS ({PEOPLE}) SELECT 'seed group in several splits' AS problem, CAST(coalesce(seed_instance_id, instance_id) AS STRING) AS what FROM people GROUP BY 2 HAVING count(DISTINCT instance_id % 2) > 1 UNION ALL SELECT 'split is empty', 's2'")
query("j10_collisions", ["orders"], lambda o: con.collisions(o.selectExpr("o_custkey AS instance_id", "o_orderstatus AS split")), "WITH s AS (SELECT DISTINCT o_custkey AS instance_id, o_orderstatus AS split FROM orders) SELECT a.instance_id, a.split AS \"left\", b.split AS \"right\" FROM s a JOIN s b ON a.instance_id = b.instance_id AND a.split < b.split")
empty_pack = lambda: F.array().cast("array<struct<eid:string,text:string>>")
query("j12_duplicates", ["documents"], lambda d: con.duplicates(d.select(F.col("lang").alias("split"), F.col("doc_id").alias("instance_id"), "text", empty_pack().alias("pack"))), "WITH n AS (SELECT lang AS split, doc_id AS instance_id, min(doc_id) OVER (PARTITION BY lang, trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS first FROM documents) SELECT * FROM n WHERE instance_id <> first")
query("j11_similar", ["benchmark"], lambda b: con.similar(b.select(F.lit("a").alias("split"), F.col("item_id").alias("instance_id"), "text").unionByName(b.select(F.lit("b").alias("split"), F.col("item_id").alias("instance_id"), F.concat("text", F.lit(" Indeed")).alias("text")))).select("left", "right"), "SELECT item_id AS \"left\", item_id AS \"right\" FROM benchmark")
query("j13_rekey", ["customer"], lambda c: con.rekey(people(c), c.selectExpr("c_custkey AS old", "concat('sas_', CAST(c_custkey AS STRING)) AS new")).select("instance_id", "seed_instance_id", "paper_id"), f"WITH people AS ({PEOPLE}) SELECT concat('sas_', CAST(instance_id AS STRING)) AS instance_id, CASE WHEN seed_instance_id IS NOT NULL THEN concat('sas_', CAST(seed_instance_id AS STRING)) END AS seed_instance_id, paper_id FROM people")
query("j14_new_ids", ["customer"], lambda c: con.new_ids(c.selectExpr("c_custkey AS old"), c.selectExpr("concat('sas_', lpad(CAST(c_custkey AS STRING), 8, '0')) AS instance_id"), seed=7))
# --- plain joins and set operations ---
query("j3_missing", ["gold", "submitted"], lambda g, p: g.join(p, "instance_id", "left_anti").select("instance_id"), "SELECT instance_id FROM [gold] WHERE instance_id NOT IN (SELECT instance_id FROM [submitted])")
query("j4_not_allowed", ["gold", "pred"], lambda g, p: p.join(g.select("instance_id", "supporting_eids"), "instance_id").select("instance_id", F.explode(F.array_except("predicted_eids", "supporting_eids")).alias("eid")), "SELECT DISTINCT instance_id, eid FROM (SELECT p.instance_id, unnest(list_filter(p.predicted_eids, lambda x: NOT list_contains(g.supporting_eids, x))) AS eid FROM [pred] p JOIN [gold] g ON p.instance_id = g.instance_id)")
query("j5_strict_left", ["gold", "pred"], lambda g, p: p.select("instance_id").join(g.select("instance_id", "verdict"), "instance_id", "left").withColumn("x", F.assert_true(F.col("verdict").isNotNull(), F.lit("no gold"))).where("x IS NULL").drop("x"), "SELECT p.instance_id, g.verdict FROM [pred] p LEFT JOIN [gold] g ON p.instance_id = g.instance_id")
query("j6_inner", ["gold", "submitted"], lambda g, p: p.join(g.select("instance_id", F.col("verdict").alias("gold")), "instance_id").select("instance_id", "gold"), "SELECT p.instance_id, g.verdict AS gold FROM [submitted] p JOIN [gold] g ON p.instance_id = g.instance_id")
query("j7_side_metadata", ["gold", "stress"], lambda g, s: g.join(s, "instance_id", "left").select("instance_id", F.coalesce("is_stress_case", F.lit(False)).alias("stressed")), "SELECT g.instance_id, coalesce(s.is_stress_case, false) AS stressed FROM [gold] g LEFT JOIN [stress] s ON g.instance_id = s.instance_id")
query("j9_covered", ["gold", "submitted"], lambda g, p: g.join(p, "instance_id", "left_semi").agg(F.count(F.lit(1)).alias("covered")), "SELECT count(*) AS covered FROM [gold] WHERE instance_id IN (SELECT instance_id FROM [submitted])")
query("o1_sorted", ["gold"], lambda g: g.select("instance_id", "verdict").orderBy("instance_id"), "SELECT instance_id, verdict FROM [gold] ORDER BY instance_id")
query("o3_shuffled", ["gold"], lambda g: g.select("instance_id", "verdict").orderBy(F.rand(7)), "SELECT instance_id, verdict FROM [gold]")
query("o4_set_operations", ["gold", "submitted"], lambda g, p: g.select("instance_id").subtract(p.select("instance_id")).union(g.select("instance_id").intersect(p.where("abstain").select("instance_id"))), "SELECT instance_id FROM [gold] EXCEPT SELECT instance_id FROM [submitted] WHERE NOT abstain")
query("o5_bag_union", ["gold", "pred"], lambda g, p: g.select("verdict").unionByName(p.select("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n")), "SELECT verdict, count(*) AS n FROM (SELECT verdict FROM [gold] UNION ALL SELECT verdict FROM [pred]) GROUP BY verdict")
# --- validation ---
document = lambda e: e.select(F.col("event_id").alias("id"), F.parse_json(F.concat(F.lit('{"a": [{"gold": '), F.col("props"), F.lit('}, {"note": "split"}], "split": "gold", "k": "golden"}'))).alias("document"))
WALK = "SELECT event_id AS id, '$.a[0].gold' AS path, 'key' AS hit FROM events UNION ALL SELECT event_id, '$.split', 'key' FROM events"
query("k1_forbidden", ["events"], lambda e: validation.forbidden(document(e)), f"{WALK} UNION ALL SELECT event_id, '$.a[1].note', 'value' FROM events")
query("k2_forbidden_keys", ["events"], lambda e: validation.forbidden(document(e), values=False), WALK)
PATH = "CASE event_id % 5 WHEN 0 THEN 'x/sample_internal_annotation.jsonl' WHEN 1 THEN 'a/b/gold.jsonl' WHEN 2 THEN 'my_predictions_v2.jsonl' WHEN 3 THEN 'gold/inputs.jsonl' ELSE 'toy_stress_cases.jsonl' END"
query("p18_profile", ["events"], lambda e: e.selectExpr("event_id", f"{PATH} AS path").select("event_id", validation.profile_of(F.col("path")).alias("profile")), "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'internal' WHEN 1 THEN 'gold' WHEN 2 THEN 'prediction' WHEN 3 THEN 'input' ELSE 'internal' END AS profile FROM events")
query("k3_profile_scan", ["events"], lambda e: validation.scan_by_profile(e.selectExpr("concat(event_id, '/', " + PATH + ") AS path", "parse_json('{\"verdict\": \"split\", \"x\": [\"gold\"], \"gold\": {\"note\": \"verdict\"}}') AS document")).groupBy("profile", "path", "hit").agg(F.count(F.lit(1)).alias("n")),
      """SELECT v.profile, v.path, v.hit, count(*) AS n FROM events JOIN (VALUES (1, 'gold', '$.verdict', 'value'), (2, 'prediction', '$.verdict', 'value'), (2, 'prediction', '$.x[0]', 'value'), (2, 'prediction', '$.gold', 'key'),
        (3, 'input', '$.verdict', 'key'), (3, 'input', '$.x[0]', 'value'), (3, 'input', '$.gold', 'key'), (3, 'input', '$.gold.note', 'value')) v(k, profile, path, hit) ON event_id % 5 = v.k GROUP BY ALL""")  # fmt: skip
query("k4_schema", ["events"], lambda e: e.select("event_id", validation.prediction_problems(F.parse_json(F.concat(F.lit('{"instance_id": "i", "verdict": "warranted", "confidence": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("0.5"), F.lit(', "predicted_eids": [], "issue_tags": ["'), F.when(F.col("event_id") % 3 == 0, "odd").otherwise("caption_chart_mismatch"), F.lit('"], "'), F.when(F.col("event_id") % 5 == 0, "extra").otherwise("abstain"), F.lit('": false}')))).alias("p")).select("event_id", F.array_join("p", ",").alias("problems")), "SELECT event_id, concat_ws(',', CASE WHEN event_id % 5 = 0 THEN 'unknown key' END, CASE WHEN event_id % 2 = 0 THEN 'confidence' END, CASE WHEN event_id % 3 = 0 THEN 'issue_tags' END) AS problems FROM events")
raw = lambda p: p.groupBy("instance_id").agg(F.collect_list("raw_eid").alias("eids"))
query("a26_repeated_eids", ["pack"], lambda p: raw(p).select("instance_id", F.explode(validation.repeated(F.col("eids"))).alias("eid")), "SELECT instance_id, raw_eid AS eid FROM [pack] GROUP BY 1, 2 HAVING count(*) > 1")
query("k5_inputs", ["pack"], lambda p: validation.input_violations(raw(p).select(F.col("instance_id").alias("line"), "instance_id", "eids", F.array(F.lit("raw1"), F.lit("raw2")).alias("allowed"))), "SELECT instance_id AS line, 'repeated eid' AS code, raw_eid AS detail FROM [pack] GROUP BY 1, 3 HAVING count(*) > 1 UNION ALL SELECT instance_id, 'allowed eid not in the pack', v.x FROM (SELECT DISTINCT instance_id FROM [pack]) i CROSS JOIN (VALUES ('raw1'), ('raw2')) v(x) WHERE NOT EXISTS (SELECT 1 FROM [pack] p WHERE p.instance_id = i.instance_id AND p.raw_eid = v.x)")
query("k6_preds", ["gold", "submitted"], lambda g, p: validation.prediction_violations(p.select(F.col("instance_id").alias("line"), "instance_id", "predicted_eids"), g.where("instance_id % 1009 <> 1").select("instance_id", F.col("supporting_eids").alias("allowed"))).withColumn("line", F.coalesce("line", F.lit(-1))), "WITH g AS (SELECT * FROM [gold] WHERE instance_id % 1009 <> 1) SELECT instance_id AS line, 'unknown instance_id' AS code, CAST(instance_id AS STRING) AS detail FROM [submitted] WHERE instance_id NOT IN (SELECT instance_id FROM g) UNION ALL SELECT DISTINCT line, 'eid not allowed', d FROM (SELECT p.instance_id AS line, unnest(list_filter(p.predicted_eids, lambda x: NOT list_contains(g.supporting_eids, x))) AS d FROM [submitted] p JOIN g ON p.instance_id = g.instance_id) UNION ALL SELECT CAST(-1 AS BIGINT), 'missing prediction', CAST(instance_id AS STRING) FROM g WHERE instance_id NOT IN (SELECT instance_id FROM [submitted])")
# --- probes ---
query("a18_baselines", ["labelled"], leakage.label_baselines, "WITH s AS (SELECT label, count(*) AS n FROM [labelled] GROUP BY label) SELECT CAST(sum(n) AS BIGINT) AS n, max(n) / sum(n) AS majority, round(sum(n * n) / (sum(n) * sum(n)), 9) AS stratified FROM s")
TOKENS = "own AS (SELECT instance_id, label, token, count(*) AS o FROM (SELECT instance_id, label, unnest(regexp_extract_all(lower(text), '[a-zа-яё0-9]+')) AS token FROM [labelled]) GROUP BY ALL)"
query("a22_nb_counts", ["labelled"], leakage.bayes_counts, f"WITH {TOKENS}, t AS (SELECT label, CAST(sum(o) AS BIGINT) AS tokens, count(DISTINCT token) AS vocabulary FROM own GROUP BY label) SELECT l.label, count(*) AS documents, any_value(t.tokens) AS tokens, any_value(t.vocabulary) AS vocabulary FROM [labelled] l JOIN t ON l.label = t.label GROUP BY l.label")
query("a23_tokens", ["labelled"], leakage.indicative_tokens, f"WITH {TOKENS}, n AS (SELECT label, count(*) AS inside, (SELECT count(*) FROM [labelled]) AS al FROM [labelled] GROUP BY label), c AS (SELECT label, token, count(*) AS count FROM own GROUP BY ALL), t AS (SELECT token, CAST(sum(count) AS BIGINT) AS total FROM c GROUP BY token HAVING sum(count) >= 2), s AS (SELECT c.label, c.token, c.count, t.total, round(c.count / n.inside - (t.total - c.count) / greatest(1, n.al - n.inside), 9) AS gap FROM c JOIN t ON c.token = t.token JOIN n ON c.label = n.label) SELECT label, row_number() OVER (PARTITION BY label ORDER BY gap DESC, token DESC) AS place, token, count, total, gap FROM s QUALIFY place <= 5")
BAYES = f"""{TOKENS}, g AS (SELECT token, sum(o) AS g FROM own GROUP BY token), pc AS (SELECT label, token, sum(o) AS c FROM own GROUP BY ALL), cl AS (SELECT l.label, count(*) AS n FROM [labelled] l GROUP BY l.label), tt AS (SELECT label, sum(o) AS t FROM own GROUP BY label),
  i AS (SELECT l.instance_id, l.label AS truth, coalesce((SELECT sum(o) FROM own WHERE own.instance_id = l.instance_id), 0) AS len, coalesce((SELECT count(*) FROM own JOIN g ON own.token = g.token WHERE own.instance_id = l.instance_id AND g.g = own.o), 0) AS lonely FROM [labelled] l),
  k AS (SELECT i.*, cl.label, cl.n - CASE WHEN cl.label = truth THEN 1 ELSE 0 END AS n1, tt.t - CASE WHEN cl.label = truth THEN len ELSE 0 END AS t1, greatest((SELECT count(*) FROM g) - lonely, 1) AS v1 FROM i CROSS JOIN cl JOIN tt ON tt.label = cl.label),
  s AS (SELECT k.instance_id, k.label, sum(own.o * ln((coalesce(pc.c, 0) - CASE WHEN k.label = k.truth THEN own.o ELSE 0 END + CAST(1 AS DOUBLE)) / (k.t1 + k.v1))) AS s FROM k JOIN own ON own.instance_id = k.instance_id JOIN g ON g.token = own.token AND g.g > own.o LEFT JOIN pc ON pc.label = k.label AND pc.token = own.token GROUP BY ALL),
  r AS (SELECT k.instance_id, k.truth, k.label, round(ln(n1 / ((SELECT count(*) FROM [labelled]) - 1)) + coalesce(s.s, 0), 9) AS score FROM k LEFT JOIN s ON s.instance_id = k.instance_id AND s.label = k.label WHERE n1 > 0)"""
query("m3_loo_nb", ["labelled"], leakage.leave_one_out_bayes, f"WITH {BAYES} SELECT instance_id, truth AS label, label AS predicted FROM r QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, label) = 1")
query("m2_permutation", ["labelled"], leakage.permutation_test)
query("w10_adjacent", ["labelled"], leakage.adjacent_equal, "WITH s AS (SELECT label = lag(label) OVER (ORDER BY instance_id) AS same FROM [labelled]) SELECT count(*) FILTER (same) AS matches, count(*) AS n FROM s")
query("m5_order_test", ["labelled"], leakage.order_test)
inputs = lambda p: records(p).select("instance_id", F.lit("two words").alias("claim"), F.col("evidence").alias("pack"), F.transform("evidence", lambda u: u["eid"]).alias("allowed"), "claim.claim_type", "claim.scope", "paper.paper_id")
query("p19_features", ["pack"], lambda p: leakage.features(inputs(p)),
      """WITH s AS (SELECT instance_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(length(CAST(CAST(l_quantity AS INTEGER) AS STRING)) + 9) AS DOUBLE) AS total, arg_max(source_kind, ordinal) AS last, arg_min(source_kind, ordinal) AS first, CAST(max(length(CAST(CAST(l_quantity AS INTEGER) AS STRING)) + 9) AS DOUBLE) AS longest, CAST(min(length(CAST(CAST(l_quantity AS INTEGER) AS STRING)) + 9) AS DOUBLE) AS shortest FROM [pack] GROUP BY instance_id)
      SELECT instance_id, 'evidence_count' AS name, n AS value FROM s UNION ALL SELECT instance_id, 'evidence_len_total', total FROM s UNION ALL SELECT instance_id, 'evidence_len_mean', round(total / n, 9) FROM s UNION ALL SELECT instance_id, 'claim_length_words', CAST(2 AS DOUBLE) FROM s
      UNION ALL SELECT instance_id, 'id_digits', CAST(length(CAST(instance_id AS STRING)) AS DOUBLE) FROM s UNION ALL SELECT instance_id, concat('modality=', modality), CAST(count(*) AS DOUBLE) FROM [pack] GROUP BY instance_id, modality UNION ALL SELECT instance_id, concat('last_source_kind=', last), CAST(1 AS DOUBLE) FROM s
      UNION ALL SELECT instance_id, 'claim_length_chars', CAST(9 AS DOUBLE) FROM s UNION ALL SELECT instance_id, 'evidence_len_max', longest FROM s UNION ALL SELECT instance_id, 'evidence_len_min', shortest FROM s UNION ALL SELECT instance_id, 'id_length', CAST(length(CAST(instance_id AS STRING)) AS DOUBLE) FROM s
      UNION ALL SELECT instance_id, concat('source_kind=', source_kind), CAST(count(*) AS DOUBLE) FROM [pack] GROUP BY instance_id, source_kind UNION ALL SELECT instance_id, concat('first_source_kind=', first), CAST(1 AS DOUBLE) FROM s
      UNION ALL SELECT instance_id, 'allowed_eids_count', n FROM s UNION ALL SELECT instance_id, v.name, CAST(1 AS DOUBLE) FROM s CROSS JOIN (VALUES ('claim_type=ablation'), ('scope=s')) v(name) UNION ALL SELECT instance_id, concat('paper_id=p', CAST(instance_id % 7 AS STRING)), CAST(1 AS DOUBLE) FROM s""")  # fmt: skip
FLOAT_FEATURES = "SELECT instance_id, name, value FROM (SELECT l.doc_id AS instance_id, 'chars' AS name, CAST(n_chars AS DOUBLE) AS value FROM labels l JOIN documents d ON l.doc_id = d.doc_id UNION ALL SELECT l.doc_id, concat('lang=', lang), CAST(1 AS DOUBLE) FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def doc_features(labels, documents):
    own = labels.join(documents, "doc_id").select(F.col("doc_id").alias("instance_id"), "lang", F.col("n_chars").cast("double").alias("chars"))
    return own.select("instance_id", F.lit("chars").alias("name"), F.col("chars").alias("value")).unionByName(own.select("instance_id", F.concat(F.lit("lang="), "lang").alias("name"), F.lit(1.0).alias("value")))


CLASSES = ("warranted", "overclaimed", "contradicted", "insufficient")
_side = lambda p: "1 - (" + " + ".join(f"pow({p}{i} / ({' + '.join(f'{p}{j}' for j in range(4))}), 2)" for i in range(4)) + ")"
query("a24_best_split", ["labels", "documents", "labelled"], lambda a, d, x: leakage.best_split(doc_features(a, d), x.select("instance_id", "label"), CLASSES),
      f"""WITH f AS ({FLOAT_FEATURES}), nm AS (SELECT DISTINCT name FROM f), v AS (SELECT nm.name, l.label, coalesce(f.value, 0) AS value FROM [labelled] l CROSS JOIN nm LEFT JOIN f ON f.instance_id = l.instance_id AND f.name = nm.name),
      c AS (SELECT name, value, {', '.join(f"CAST(count(*) FILTER (label = '{c}') AS DOUBLE) AS c{i}" for i, c in enumerate(CLASSES))} FROM v GROUP BY name, value),
      w AS (SELECT name, value, lead(value) OVER o AS nxt, {', '.join(f'sum(c{i}) OVER o AS l{i}, sum(c{i}) OVER a - sum(c{i}) OVER o AS r{i}, sum(c{i}) OVER a AS a{i}' for i in range(4))} FROM c WINDOW o AS (PARTITION BY name ORDER BY value), a AS (PARTITION BY name)),
      s AS (SELECT *, l0 + l1 + l2 + l3 AS nl, r0 + r1 + r2 + r3 AS nr FROM w WHERE nxt IS NOT NULL), t AS (SELECT name, (value + nxt) / 2 AS threshold, round(({_side('a')}) - (nl * ({_side('l')}) + nr * ({_side('r')})) / (nl + nr), 9) AS gain FROM s WHERE nl >= 3 AND nr >= 3) SELECT name, threshold, gain FROM t WHERE gain > 1e-12 ORDER BY gain DESC, name, threshold LIMIT 1""")  # fmt: skip
query("m4_loo_tree", ["labels", "documents", "labelled"], lambda a, d, x: leakage.leave_one_out_tree(doc_features(a, d), x.select("instance_id", "label")))
query("p21_p_value_class", ["events"], lambda e: e.select("event_id", tx.p_value_class((F.col("event_id") % 100) / 100).alias("class")), "SELECT event_id, CASE WHEN event_id % 100 < 5 THEN 'leak' WHEN event_id % 100 < 20 THEN 'suspect' ELSE 'clean' END AS class FROM events")
# --- numeric checker ---
CASES = (
    ("Method X outperforms all baselines.", "q > b + 1e-9"),
    ("Method X outperforms the Baseline.", "q > b + 1e-9"),
    ("Method X achieves 25.0 accuracy.", "q = 25"),
    ("Method X achieves the highest accuracy.", "NOT b > q + 1e-9"),
    ("Method X improves accuracy by 10.0 points over the Baseline.", "abs(round(q - b, 6) - 10) < 1e-9"),
    ("Method X improves accuracy by 50%.", "abs(abs(q - b) / b * 100 - 50) < 1e-9"),
    ("The mean accuracy is 20.5.", "abs(round((q + b) / 2, 6) - CAST(20.5 AS DOUBLE)) < 1e-9"),
    ("Method X outperforms any baseline.", "q > b + 1e-9"),
)
CLAIM = "CASE " + " ".join(f"WHEN n % {len(CASES)} = {i} THEN '{c}'" for i, (c, _) in enumerate(CASES)) + " END"
LINES = "SELECT l_orderkey AS instance_id, l_linenumber AS line, l_partkey AS part, l_quantity AS q, CAST(l_suppkey % 40 + 1 AS DOUBLE) AS b, l_orderkey + l_linenumber + l_partkey AS n FROM {lineitem}"


def lines(x):
    own = x.sparkSession.sql(LINES, lineitem=x)
    text = F.concat(F.lit("Method X = "), F.col("q").cast("string"), F.lit(", Baseline = "), F.col("b").cast("string"))
    unit = F.struct(F.lit("e1").alias("eid"), text.alias("text"), F.lit(None).cast("array<struct<value:double,unit:string,context:string>>").alias("normalized_numbers"))
    return own.withColumn("claim", F.expr(CLAIM)).withColumn("pack", F.array(unit))


IDS = "instance_id, line, part"
query("n1_measures", ["lineitem"], lambda x: numeric.check(lines(x)).select("instance_id", "line", "part", F.posexplode("measures")).select("instance_id", "line", "part", "pos", "col.label", "col.value", "col.eid"), f"WITH l AS ({LINES.format(lineitem='lineitem')}) SELECT {IDS}, CAST(0 AS INTEGER) AS pos, 'Method X' AS label, q AS value, 'e1' AS eid FROM l UNION ALL SELECT {IDS}, 1, 'Baseline', b, 'e1' FROM l")
query("n8_n14_checks", ["lineitem"], lambda x: numeric.check(lines(x)).select("instance_id", "line", "part", F.inline("checks")).select("instance_id", "line", "part", "status", F.array_join("eids", ",").alias("eids")),
      f"WITH l AS ({LINES.format(lineitem='lineitem')}) SELECT {IDS}, CASE WHEN CASE " + " ".join(f"WHEN n % {len(CASES)} = {i} THEN {t}" for i, (_, t) in enumerate(CASES)) + " END THEN 'ok' ELSE 'failed' END AS status, 'e1' AS eids FROM l")
query("n15_override", ["lineitem"], lambda x: numeric.override(numeric.check(lines(x).select("*", F.lit("warranted").alias("verdict"), F.lit(False).alias("abstain"), F.lit(0.5).alias("confidence"), F.array().cast("array<string>").alias("issue_tags"), F.array().cast("array<string>").alias("predicted_eids"), F.array(F.lit("e1")).alias("allowed"), F.lit("r").alias("rationale_short")))).select("instance_id", "line", "part", "verdict", "confidence", F.array_join("issue_tags", ",").alias("tags"), F.array_join("predicted_eids", ",").alias("eids")),
      f"WITH l AS ({LINES.format(lineitem='lineitem')}), s AS (SELECT {IDS}, CASE " + " ".join(f"WHEN n % {len(CASES)} = {i} THEN {t}" for i, (_, t) in enumerate(CASES)) + f" END AS good FROM l) SELECT {IDS}, CASE WHEN good THEN 'warranted' ELSE 'contradicted' END AS verdict, CAST(CASE WHEN good THEN 0.5 ELSE 0.9 END AS DOUBLE) AS confidence, CASE WHEN good THEN '' ELSE 'numerical_inconsistency' END AS tags, CASE WHEN good THEN '' ELSE 'e1' END AS eids FROM s")
