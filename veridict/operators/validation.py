"""Validation and gates: recursive search for private keys, schema rules, cross checks, file profiles."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridict.functions.text import glob_pattern
from veridict.operators.prediction import kind
from veridict.schemas import ANNOTATION_RULES, DELEGATION_RULES, FORBIDDEN_KEYS, INPUT_RULES, PREDICTION_RULES, SYSTEM_CARD_RULES, Flag, ListOf, Number, Record, Text
from veridict.sources.tables import stored

# Which keys a profile allows, and which files have which profile (first match wins).
PROFILES = {"input": (), "gold": ("gold", "gold_verdict", "verdict", "supporting_eids"), "prediction": ("verdict",)}
RULES = (("*internal_annotation*", "internal"), ("toy_stress_cases.jsonl", "internal"), ("*gold*.json", "gold"), ("*gold*.jsonl", "gold"), ("*predictions*.jsonl", "prediction"), ("*preds*.jsonl", "prediction"))
DEFAULT_PROFILE = "input"


def _search(rows: DataFrame, sets: dict[str, tuple[str, ...]], values: bool) -> DataFrame:
    """``rows(id, profile, v)`` to (id, profile, path, hit): keys, and strings whose own key is none, of the profile's set.

    Level by level, all documents at once; what is still to be opened is written to the shared folder, so neither depth
    nor number of nodes is bounded. It goes on below a hit.
    """
    spark = rows.sparkSession
    among = lambda what: " OR ".join(f"(w.profile = '{p}' AND {what} IN ({', '.join(repr(k) for k in keys)}))" for p, keys in sets.items())
    opens = "(schema_of_variant({0}) LIKE 'OBJECT%' OR schema_of_variant({0}) LIKE 'ARRAY%')"
    inside = rows.where(opens.format("v")).select("id", "profile", F.lit("$").alias("path"), "v")
    found = []
    while True:
        level = spark.sql(
            f"""SELECT w.id, w.profile, concat(w.path, CASE WHEN e.key IS NULL THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END) AS path, e.value AS v,
                CASE WHEN {among("e.key")} THEN 'key' WHEN {str(values).lower()} AND schema_of_variant(e.value) = 'STRING' AND ({among("CAST(e.value AS STRING)")}) THEN 'value' END AS hit,
                {opens.format("e.value")} AS opens
                FROM {{walk}} w, LATERAL variant_explode(w.v) e""",
            walk=inside,
        )
        level = stored(level.where("hit IS NOT NULL OR opens"))
        found.append(level.where("hit IS NOT NULL").select("id", "profile", "path", "hit"))
        inside = level.where("opens").select("id", "profile", "path", "v")
        if inside.isEmpty():
            return reduce(DataFrame.unionByName, found)


def forbidden(rows: DataFrame, keys: tuple[str, ...] = FORBIDDEN_KEYS, values: bool = True, document: str = "document") -> DataFrame:
    """Paths of forbidden keys, and of strings equal to one whose own key is not, below ``document`` (VARIANT) of
    ``rows(id, document)``."""
    own = rows.select("id", F.lit("all").alias("profile"), F.col(document).alias("v"))
    return _search(own, {"all": keys}, values).drop("profile")


def load_rules(path: str) -> tuple[tuple[str, str], ...]:
    """Profile rules of a JSON file, a list of objects with ``glob`` and ``profile`` (and a reason)."""
    rules = json.loads(Path(path).read_text(encoding="utf-8"))
    for i, rule in enumerate(rules):
        if not isinstance(rule, dict) or not {"glob", "profile"} <= set(rule):
            raise ValueError(f"{path}: rule {i} needs glob and profile")
        if rule["profile"] not in (*PROFILES, "internal"):
            raise ValueError(f"{path}: rule {i} has the unknown profile {rule['profile']!r}")
    return tuple((r["glob"], r["profile"]) for r in rules)


def profile_of(path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Profile of a file: the first rule that fits; a rule with a slash fits the whole path, others the name."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F
    for glob, profile in rules:
        out = out.when((path if "/" in glob else name).rlike(glob_pattern(glob)), profile)
    return out.otherwise(DEFAULT_PROFILE) if rules else F.lit(DEFAULT_PROFILE)


def scan_by_profile(files: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``files(path, document)``: (id, profile, path, hit) by the key set of each file's profile, for keys and values
    alike; internal files are skipped."""
    own = files.select(F.col("path").alias("id"), profile_of(F.col("path"), rules).alias("profile"), F.col("document").alias("v")).where("profile <> 'internal'")
    return _search(own, {p: tuple(k for k in FORBIDDEN_KEYS if k not in allowed) for p, allowed in PROFILES.items()}, True)


def repeated(values: Column) -> Column:
    """Elements that stand in an array more than once."""
    return F.array_sort(F.filter(F.array_distinct(values), lambda e: F.size(F.filter(values, lambda x: x == e)) > 1))


def _false(condition: Column) -> Column:
    """Whether a condition fails or is unknown."""
    return ~F.coalesce(condition, F.lit(False))


def _bad(value: Column, rule, path: str) -> list[tuple[str, Column]]:
    """(code, whether it applies) of a VARIANT that is there."""
    of, get = kind(value, "$"), lambda t: F.try_variant_get(value, "$", t)
    if isinstance(rule, Text):
        fits = of == "STRING"
        if rule.least:
            fits &= F.length(get("string")) >= rule.least
        if rule.most:
            fits &= F.length(get("string")) <= rule.most
        if rule.one_of:
            fits &= get("string").isin(*rule.one_of)
        if rule.or_integer:
            fits |= of.startswith("BIGINT")
        return [(path, _false(fits))]
    if isinstance(rule, Number):
        fits = of.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        if rule.least is not None:
            fits &= get("double") >= rule.least
        if rule.most is not None:
            fits &= get("double") <= rule.most
        return [(path, _false(fits))]
    if isinstance(rule, Flag):
        return [(path, _false(of == "BOOLEAN"))]
    if isinstance(rule, ListOf):
        items = get("array<variant>")
        fits = of.startswith("ARRAY") & (F.size(items) >= rule.least)
        if rule.unique:
            texts = get("array<string>")
            fits &= F.size(F.array_distinct(texts)) == F.size(texts)
        wrong = F.exists(items, lambda x: reduce(lambda a, b: a | b, [bad for _, bad in _bad(x, rule.of, "")]))
        return [(path, _false(fits & ~wrong))]
    if isinstance(rule, Record):
        below = f"{path}." if path else ""
        found = [(path or "no object", _false(of.startswith("OBJECT")))]
        if rule.closed:
            keys = F.map_keys(get("map<string,variant>"))
            found.append((f"{path}: unknown key" if path else "unknown key", F.coalesce(F.size(F.array_except(keys, F.array(*[F.lit(n) for n in rule.fields]))) > 0, F.lit(False))))
        for name, (field, required) in rule.fields.items():
            own = F.try_variant_get(value, f"$.{name}", "variant")
            if required:
                found.append((f"{below}{name}", own.isNull()))
            found += [(code, own.isNotNull() & bad) for code, bad in _bad(own, field, f"{below}{name}")]
        return found
    raise TypeError(rule)


def record_problems(value: Column, rule: Record) -> Column:
    """Codes (paths, of lists the list's) of what a record given as VARIANT breaks of its rules; each once, in order."""
    return F.array_distinct(F.filter(F.array(*[F.when(bad, code) for code, bad in _bad(value, rule, "")]), lambda x: x.isNotNull()))


def input_problems(v: Column) -> Column:
    return record_problems(v, INPUT_RULES)


def prediction_problems(v: Column) -> Column:
    """Stricter than what scoring asks for."""
    return record_problems(v, PREDICTION_RULES)


def annotation_problems(v: Column) -> Column:
    return record_problems(v, ANNOTATION_RULES)


def system_card_problems(v: Column) -> Column:
    return record_problems(v, SYSTEM_CARD_RULES)


def delegation_problems(v: Column) -> Column:
    return record_problems(v, DELEGATION_RULES)


def input_violations(rows: DataFrame) -> DataFrame:
    """``rows(line, instance_id, eids, allowed)``: repeated ids, repeated eids in a pack, allowed ids without a unit."""
    twice = rows.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first")).where("n > 1")
    late = rows.join(twice, "instance_id").where("line > first").select("line", F.lit("repeated instance_id").alias("code"), F.col("instance_id").cast("string").alias("detail"))
    eids = rows.select("line", F.explode(repeated(F.col("eids"))).alias("detail")).select("line", F.lit("repeated eid").alias("code"), "detail")
    gone = rows.select("line", F.explode(F.array_except("allowed", "eids")).alias("detail")).select("line", F.lit("allowed eid not in the pack").alias("code"), "detail")
    return late.unionByName(eids).unionByName(gone)


def prediction_violations(preds: DataFrame, inputs: DataFrame) -> DataFrame:
    """``preds(line, instance_id, predicted_eids)``, ``inputs(instance_id, allowed)``: repeated, unknown and missing ids,
    and predicted eids that the input does not allow."""
    known = inputs.select("instance_id", "allowed", F.lit(True).alias("known"))
    joined = preds.join(known, "instance_id", "left")
    text = F.col("instance_id").cast("string").alias("detail")
    unknown = joined.where("known IS NULL").select("line", F.lit("unknown instance_id").alias("code"), text)
    outside = joined.where("known").select("line", F.explode(F.array_except("predicted_eids", "allowed")).alias("detail")).select("line", F.lit("eid not allowed").alias("code"), "detail")
    first = preds.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first")).where("n > 1")
    late = preds.join(first, "instance_id").where("line > first").select("line", F.lit("repeated instance_id").alias("code"), text)
    missing = inputs.join(preds.select("instance_id"), "instance_id", "left_anti").select(F.lit(None).cast("long").alias("line"), F.lit("missing prediction").alias("code"), text)
    return unknown.unionByName(outside).unionByName(late).unionByName(missing)


def student_half_problems(files: DataFrame) -> DataFrame:
    """``files(path, document)`` of what participants get: (problem, path) for gold files, private words, and no inputs."""
    name = F.element_at(F.split("path", "/"), -1)
    gold = files.where(F.lower(name).contains("gold")).select(F.lit("gold file").alias("problem"), "path").distinct()
    hits = scan_by_profile(files.withColumn("path", F.concat(F.lit("inputs/"), name))).select(F.concat(F.lit("private word at "), "path").alias("problem"), F.col("id").alias("path"))
    inputs = files.where(F.try_variant_get("document", "$.evidence_pack", "variant").isNotNull()).agg(F.count(F.lit(1)).alias("n"))
    none = inputs.where("n = 0").select(F.lit("no inputs").alias("problem"), F.lit("").alias("path"))
    return gold.unionByName(hits).unionByName(none)


def exit_code(violations: DataFrame) -> int:
    """0 where there are none, 1 otherwise."""
    return 0 if violations.isEmpty() else 1


def gate(build: Callable[[], DataFrame]) -> int:
    """The exit code of a gate: 0 clean, 1 violations, 2 where it could not be run at all (unreadable or broken input)."""
    try:
        return exit_code(build())
    except (PySparkException, OSError, ValueError):
        return 2
