"""Building public data sets: projections, group-safe splits, overlap between splits, new identifiers."""

from __future__ import annotations

import random
import secrets
import string
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridict.functions.text import fingerprint, normal
from veridict.schemas import PUBLIC_CLAIM_FIELDS, PUBLIC_EVIDENCE_FIELDS

SIMILAR = 0.85
ALPHABET = string.ascii_lowercase + string.digits


def public_input(records: DataFrame) -> DataFrame:
    """Allow-listed claim and evidence fields, the paper's id, and the pack's ids in order; JSON leaves nulls out."""
    unit = lambda u: F.struct(*[u[f].alias(f) for f in PUBLIC_EVIDENCE_FIELDS])
    claim = F.struct(*[F.col(f"claim.{f}").alias(f) for f in PUBLIC_CLAIM_FIELDS]).alias("claim")
    return records.select("schema_version", F.col("paper.paper_id").alias("paper_id"), "instance_id", claim, F.transform("evidence", unit).alias("evidence_pack"), F.transform("evidence", lambda u: u["eid"]).alias("allowed_evidence_ids"))


def public_gold(records: DataFrame) -> DataFrame:
    return records.select("instance_id", F.struct(*[F.col(f"gold.{f}").alias(f) for f in ("verdict", "supporting_eids", "issue_tags")]).alias("gold"))


def refuse_repeats(rows: DataFrame, key: str = "instance_id") -> DataFrame:
    """``rows``; the job fails on a missing or repeated key."""
    of = Window.partitionBy(key)
    good = F.col(key).isNotNull() & (F.count(F.lit(1)).over(of) == 1)
    return rows.withColumn("__bad", F.assert_true(good, F.concat(F.lit("missing or repeated key: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).where("__bad IS NULL").drop("__bad")


def derive(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Public inputs and gold of private records: each row is refused (the job fails and names it) if its id is missing
    or repeated, if a field that the public half needs is missing, or if a forbidden key is left in the projection."""
    from veridict.operators.validation import forbidden
    from veridict.sources.tables import stored

    name = F.coalesce(F.col("instance_id").cast("string"), F.lit("null"))
    needed = [F.col(c).isNotNull() for c in ("schema_version", "paper.paper_id", "claim.text", "claim.claim_type", "claim.scope", "evidence", "gold.verdict")]
    whole = F.lit(True)
    for there in needed:
        whole = whole & there
    whole = whole & F.forall("evidence", lambda u: u["eid"].isNotNull())
    kept = refuse_repeats(records)
    kept = stored(kept.withColumn("__bad", F.assert_true(F.coalesce(whole, F.lit(False)), F.concat(F.lit("missing field: "), name))).where("__bad IS NULL").drop("__bad"))
    inputs = public_input(kept)
    hits = forbidden(inputs.select(F.col("instance_id").alias("id"), F.parse_json(F.to_json(F.struct(*inputs.columns))).alias("document")), values=True)
    worst = hits.select(F.assert_true(F.lit(False), F.concat(F.lit("private field in the projection of "), F.col("id").cast("string"), F.lit(": "), "path")))
    worst.collect()  # no rows, or the job has failed
    return inputs, public_gold(kept)


def group_key(by: str) -> Column:
    """One hop only: a variant of a variant is in its direct seed's group."""
    if by == "paper":
        return F.coalesce(F.nullif(F.col("paper_id").cast("string"), F.lit("")), F.lit("UNKNOWN"))
    if by == "seed":
        return F.coalesce(F.nullif(F.col("seed_instance_id").cast("string"), F.lit("")), F.col("instance_id").cast("string"))
    raise ValueError("groups are made by paper or by seed")


def form_groups(records: DataFrame, by: str) -> DataFrame:
    return records.groupBy(group_key(by).alias("group")).agg(F.count(F.lit(1)).alias("size"))


def assign_groups(groups: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """Largest groups first (ties by name), each to the split furthest below its target (ties by name).

    Each choice depends on all before it, so one task reads the groups (not the records) in order; it holds the
    splits' sums only.
    """
    wanted = {s: r for s, r in sorted(ratios.items()) if r > 0}
    if not wanted:
        raise ValueError("all ratios are zero")
    total = groups.agg(F.sum("size")).first()[0] or 0

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        short = {s: -r * total for s, r in wanted.items()}
        for batch in batches:
            chosen = []
            for size in batch["size"]:
                split = min(short, key=lambda s: (short[s], s))
                short[split] += size
                chosen.append(split)
            yield batch.assign(split=chosen)

    named = groups.select(F.col("group").cast("string").alias("group"), "size")
    return named.repartition(1).sortWithinPartitions(F.desc("size"), "group").mapInPandas(fold, "group string, size long, split string")


def split_records(records: DataFrame, by: str, ratios: dict[str, float]) -> DataFrame:
    """Records with their split, in id order."""
    assigned = assign_groups(form_groups(records, by), ratios).select("group", "split")
    return records.withColumn("group", group_key(by).cast("string")).join(assigned, "group").drop("group")


def split_problems(records: DataFrame, requested: tuple[str, ...] = ()) -> DataFrame:
    """Ids in two places, seed groups over several splits, requested splits that are empty."""
    twice = records.groupBy("instance_id").count().where("count > 1").select(F.lit("instance in two groups").alias("problem"), F.col("instance_id").cast("string").alias("what"))
    torn = records.groupBy(group_key("seed").cast("string").alias("what")).agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit("seed group in several splits").alias("problem"), "what")
    spark = records.sparkSession
    asked = spark.createDataFrame([(s,) for s in requested], "what string")
    empty = asked.join(records.select(F.col("split").alias("what")).distinct(), "what", "left_anti").select(F.lit("split is empty").alias("problem"), "what")
    return twice.unionByName(torn).unionByName(empty)


def split_sizes(records: DataFrame) -> DataFrame:
    return records.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("paper_id").alias("papers"))


def papers_in_several(records: DataFrame) -> DataFrame:
    return records.groupBy("paper_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def collisions(rows: DataFrame, key: str = "instance_id") -> DataFrame:
    """Keys that two splits share, per pair of splits; pairs are made within a key's set of splits."""
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    return sets.select(key, F.inline(pairs))


def duplicates(rows: DataFrame) -> DataFrame:
    """Within a split, rows with the same normalised claim and the same evidence: each with the first of its class. Texts
    are read once; their digests are what is written, grouped and joined."""
    from veridict.sources.tables import shared

    sign = F.sha2(F.concat_ws("\x1f", normal(F.col("text")), F.to_json(fingerprint(F.col("pack")))), 256)
    signed = shared(rows.select("split", "instance_id", sign.alias("sign")))
    first = signed.groupBy("split", "sign").agg(F.min("instance_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return signed.join(first, ["split", "sign"]).where("instance_id <> first").select("split", "first", "instance_id")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters, left text first (the measure is not symmetric); cheap upper bounds come first."""
    out = []
    for x, y in zip(a, b):
        m = SequenceMatcher(None, x, y)
        out.append(m.ratio() if m.real_quick_ratio() >= SIMILAR and m.quick_ratio() >= SIMILAR else 0.0)
    return pd.Series(out)


def similar(rows: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """Pairs of claims of two splits with a ratio of at least ``threshold`` (0.85 or more).

    A ratio r bounds the lengths: the longer is at most (2 - r) / r of the shorter. So texts meet by bands of the
    logarithm of their length and the next band, an equi-join; the text of the lower split name is the left one.
    """
    if threshold < SIMILAR:
        raise ValueError(f"thresholds below {SIMILAR} are not supported")
    step = F.log(F.lit((2 - threshold) / threshold))
    side = rows.select("split", "instance_id", normal(F.col("text")).alias("text")).withColumn("length", F.length("text")).where("length > 0").withColumn("band", F.floor(F.log("length") / step))
    near = side.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    a, b = side.alias("a"), near.alias("b")
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.split") < F.col("b.split"))).where(2 * F.least("a.length", "b.length") >= threshold * (F.col("a.length") + F.col("b.length")))
    rated = pairs.select(F.col("a.instance_id").alias("left"), F.col("b.instance_id").alias("right"), sequence_ratio("a.text", "b.text").alias("ratio"))
    return rated.where(F.col("ratio") >= threshold)


def rekey(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """``mapping(old, new)`` applied to ids and seeds; the job fails on one that has no new id."""
    ids = records.join(mapping.select(F.col("old").alias("instance_id"), F.col("new").alias("__i")), "instance_id", "left")
    both = ids.join(mapping.select(F.col("old").alias("seed_instance_id"), F.col("new").alias("__s")), "seed_instance_id", "left")
    good = F.col("__i").isNotNull() & (F.col("seed_instance_id").isNull() | F.col("__s").isNotNull())
    checked = both.withColumn("__bad", F.assert_true(good, F.lit("an id or a seed has no new id"))).where("__bad IS NULL")
    keep = [c for c in records.columns if c not in ("instance_id", "seed_instance_id")]
    return checked.select(F.col("__i").alias("instance_id"), F.col("__s").alias("seed_instance_id"), *keep)


def new_ids(old: DataFrame, reserved: DataFrame | None = None, seed: int | None = None) -> DataFrame:
    """``old(old)`` with fresh ids ``sas_`` + 8 characters; ids drawn twice or reserved are drawn again.

    With a seed ids follow from the old id (for tests); without one they come from the system's secure source.
    """

    def draw(round_: int):
        @F.pandas_udf("string")
        def ids(keys: pd.Series) -> pd.Series:
            pick = lambda k: (random.Random(f"{seed}:{round_}:{k}") if seed is not None else secrets.SystemRandom()).choices(ALPHABET, k=8)
            return keys.map(lambda k: "sas_" + "".join(pick(k)))

        return ids.asNondeterministic() if seed is None else ids

    from veridict.sources.tables import shared

    done, left, taken = None, old, reserved
    for round_ in range(20):
        drawn = shared(left.select("old", draw(round_)(F.col("old").cast("string")).alias("new")))
        good = drawn.withColumn("__n", F.row_number().over(Window.partitionBy("new").orderBy("old"))).where("__n = 1").drop("__n")
        good = good.join(taken.select(F.col("instance_id").alias("new")), "new", "left_anti").select("old", "new") if taken is not None else good
        good = shared(good)
        done = good if done is None else done.unionByName(good)
        left = shared(left.join(good, "old", "left_anti"))
        if left.isEmpty():
            return done
        used = good.select(F.col("new").alias("instance_id"))
        taken = used if taken is None else taken.select("instance_id").unionByName(used)
    raise RuntimeError("no free ids were found")


def orderly_ids(old: DataFrame, labels: DataFrame, reserved: DataFrame | None = None, seed: int | None = None, attempts: int = 20, least_p: float = 0.05) -> tuple[DataFrame, float | None]:
    """``new_ids``, drawn again until the labels (instance_id, label) do not cluster in the order of the new ids, or
    ``attempts`` are used up; and the p-value. With fewer than four labels any order is accepted."""
    from veridict.operators.leakage import order_test
    from veridict.sources.tables import shared

    if labels.limit(4).count() < 4:
        return new_ids(old, reserved, seed), None
    for attempt in range(attempts):
        ids = shared(new_ids(old, reserved, None if seed is None else seed + attempt))
        renamed = labels.join(ids, F.col("instance_id") == F.col("old")).select(F.col("new").alias("instance_id"), "label")
        p = order_test(renamed).first()["p"]
        if p >= least_p:
            break
    return ids, p


def rehearse(records: DataFrame, predict, by: str = "seed", ratios: dict[str, float] | None = None, split: str = "hidden_val") -> tuple[DataFrame, dict]:
    """A rehearsal of the hidden evaluation: split, project the student half of ``split``, check it, let ``predict``
    (inputs to predictions) answer, validate and score.

    Returns (problem, what) and a report; where the split came out empty, only problems.
    """
    from veridict.operators import evaluation, reports, validation
    from veridict.sources.tables import stored

    seed = F.col("stress.seed_instance_id") if "stress" in records.columns else F.lit(None).cast("string")
    placed = stored(split_records(records.withColumns({"paper_id": F.col("paper.paper_id"), "seed_instance_id": seed}), by, ratios or {"public": 0.5, "hidden_val": 0.3, "hidden_test": 0.2}))
    problems = split_problems(placed)
    if by != "seed":  # splits by paper may part a seed from its variants
        problems = problems.where("problem <> 'seed group in several splits'")
    own = placed.where(F.col("split") == split).drop("split", "seed_instance_id", "paper_id")
    size = own.count()
    if not size:
        return problems.unionByName(records.sparkSession.createDataFrame([("split is empty", split)], "problem string, what string")), {}
    inputs, gold = derive(own)
    document = lambda df: F.parse_json(F.to_json(F.struct(*df.columns)))
    student = validation.student_half_problems(inputs.select(F.lit(f"{split}/inputs.jsonl").alias("path"), document(inputs).alias("document")))
    pred = stored(predict(inputs))
    broken = pred.select(F.col("instance_id").cast("string").alias("what"), F.explode(validation.prediction_problems(document(pred))).alias("code")).select(F.concat(F.lit("prediction: "), "code").alias("problem"), "what")
    cross = validation.prediction_violations(pred.select(F.lit(None).cast("long").alias("line"), "instance_id", "predicted_eids"), inputs.select("instance_id", F.col("allowed_evidence_ids").alias("allowed"))).select(F.concat(F.lit("prediction: "), "code").alias("problem"), F.col("detail").alias("what"))
    problems = problems.unionByName(student.withColumnRenamed("path", "what")).unionByName(broken).unionByName(cross)
    flat = pred.select("instance_id", "verdict", "confidence", "abstain", "predicted_eids", "issue_tags", *[F.lit(None).cast("double").alias(c) for c in ("runtime_seconds", "gpu_seconds", "api_cost_usd")])
    scored = reports.score(evaluation.normal_gold(gold), flat).first()
    if not scored["scoreable"]:
        problems = problems.unionByName(records.sparkSession.createDataFrame([("not scored", split)], "problem string, what string"))
    sizes = {r["split"]: r["n"] for r in placed.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    return problems, {"split": split, "by": by, "instances": size, "accuracy": scored["accuracy"], "coverage": scored["coverage"], "sizes": sizes, "shared_papers": papers_in_several(placed).count()}
