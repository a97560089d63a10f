"""Deterministic check of a claim's numbers against its evidence pack. Arrays and higher-order functions, once for each
distinct claim and pack.

A row has a claim and a pack of units ``struct(eid, text, normalized_numbers)``; it gets at most one result per check,
``struct(claim_fragment, status, reason, eids)`` with status ok, failed or unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridict.sources.tables import spread

# Patterns and word lists that decide what is read from claims and tables.
LOWER_MARKER = r"(?iU)lower\s+(?:is|the)\s+better|less\s+is\s+better|lower[\s=-]+better|\(\s*↓\s*\)|↓"
HIGHER_MARKER = r"(?iU)higher\s+(?:is|the)\s+better|more\s+is\s+better|higher[\s=-]+better|\(\s*↑\s*\)|↑"
LOWER_METRICS = (
    r"(?iU)\b(rmse|mse|mae|mape|nll|wer|cer|fid|kid|ece|brier|perplexity|ppl|regret|error|errors|loss|losses|latency|runtime|"
    r"inference\s+time|training\s+time|wall[-\s]?clock|seconds?|secs?|millisecond\w*|ms\b|minutes?|hours?|cost|drop|degradation|"
    r"decline|violation\w*|failure\s+rate|overhead)\b"
)
PAIR = r"([A-Za-z][A-Za-z0-9 .\-']{0,40}?)\s*[=:]\s*(\d+(?:\.\d+)?)"
VS_PAIR = r"(?i)([A-Za-z][A-Za-z0-9 .\-']{0,30}?)\s+(\d+(?:\.\d+)?)\s+vs\.?\s+([A-Za-z][A-Za-z0-9 .\-']{0,30}?)\s+(\d+(?:\.\d+)?)"
METHOD_HINTS = ("method", "ours", "proposed", "our model", "full model", "our approach", "model")
BASELINE_HINTS = ("baseline", "sota", "previous", "competitor", "without", "standard")
SUBJECT = r"(?iU)^\W*(?:the\s+)?(.{0,60}?)\s+(?:outperform|achiev|reach|attain|report|improv|increas|reduc|rank|obtain|deliver|cut)\w*\b"
DIRECT = (
    r"(?iU)(?:achieves|reports|reaches|attains|accuracy of|score of|latency of|reduces\s+\w+\s+to|improves\s+\w+\s+to)\s+(\d+(?:\.\d+)?)"
    r"|(?:\bis|\bwas|\bequals)\s+(\d+(?:\.\d+)?)\s*(?:percentage\s+points?|points?|percent|%)"
)
COMPARE = r"(?i)outperform\w*\s+(?:the\s+)?([A-Z][A-Za-z0-9 \-']*)"
ALL_ANY = r"(?i)outperform\w*\s+(all|every|any)\s+(?:the\s+)?(?:compared\s+)?baselines?"
BEST = r"(?i)(best|ranks?\s+first|top[-\s]?1|state[-\s]of[-\s]the[-\s]art)"
BEST_LITERAL = r"(?i)(highest|largest|lowest|smallest)"
ORDINAL = r"(?iU)\b(second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|(\d+)(?:st|nd|rd|th))[-\s]+(?=\w*(?:smallest|largest|highest|lowest|best|worst))"
ORDINAL_WORDS = ("second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")
AGGREGATE = r"(?iU)\b(average|mean|overall|aggregate|across\s+(?:all\s+)?models)\b"
SERIES_HEAD = r"^\s*([^:=]{3,80}?)\s*:\s*(?=\D)"
MEAN = r"(?i)(?:mean|average)\s+(?:accuracy|score|latency|performance)?\s*(?:of\s*)?(?:is\s+)?(\d+(?:\.\d+)?)"
ABS_GAIN = r"(?iU)(?:improve\w*|increase\w*|gain\w*|reduc\w*|decreas\w*|lower\w*|cut\w*|shrink\w*)\s+.{0,60}?\bby\s+(\d+(?:\.\d+)?)\s+(?:percentage\s+)?points?"
PCT_GAIN = r"(?iU)(?:improve\w*|increase\w*|reduc\w*)\s+.{0,60}?\bby\s+(\d+(?:\.\d+)?)\s*%"
TOLERANCE = 1e-9
TOOL_CONFIDENCE, NUMERIC_TAG = 0.9, "numerical_inconsistency"

MEASURE = "struct<label:string,value:double,eid:string,lower:boolean,at:int>"
RESULT = "struct<claim_fragment:string,status:string,reason:string,eids:array<string>>"


def _marker(text: Column) -> Column:
    return F.when(text.rlike(LOWER_MARKER), True).when(text.rlike(HIGHER_MARKER), False)


def _direction_of(text: Column) -> Column:
    """struct(marker, metric) of a text."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(_marker(text).alias("marker"), text.rlike(LOWER_METRICS).alias("metric"))


def polarity(*known: Column) -> Column:
    """Whether less is better, from the texts' :func:`_direction_of`: an explicit marker first, then a metric's name;
    null if nothing tells."""
    any_metric = known[0]["metric"]
    for k in known[1:]:
        any_metric = any_metric | k["metric"]
    return F.coalesce(*[k["marker"] for k in known], F.when(any_metric, True))


def _measure(label: Column, value: Column, eid: Column, *known: Column) -> Column:
    name = F.trim(label)
    return F.struct(name.alias("label"), value.cast("double").alias("value"), eid.alias("eid"), polarity(*known, _direction_of(name)).alias("lower"), F.lit(0).alias("at"))


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def measures(pack: Column) -> Column:
    """All numbers of the pack with label, eid and direction, in order. The first of equal ones stays and takes the
    first direction that any of them knows."""

    def of_unit(u: Column) -> Column:
        text, eid = F.coalesce(u["text"], F.lit("")), F.coalesce(u["eid"], F.lit("?"))

        def found(known: Column) -> Column:
            pairs = F.zip_with(_all(text, PAIR, 1), _all(text, PAIR, 2), lambda a, b: _measure(a, b, eid, known))
            left = F.zip_with(_all(text, VS_PAIR, 1), _all(text, VS_PAIR, 2), lambda a, b: _measure(a, b, eid, known))
            right = F.zip_with(_all(text, VS_PAIR, 3), _all(text, VS_PAIR, 4), lambda a, b: _measure(a, b, eid, known))
            versus = F.flatten(F.zip_with(left, right, lambda a, b: F.array(a, b)))
            numbers = F.filter(F.coalesce(u["normalized_numbers"], F.array()), lambda n: n["value"].isNotNull())
            declared = F.transform(numbers, lambda n: _measure(F.coalesce(n["context"], F.lit("")), n["value"], eid, _direction_of(n["unit"]), known))
            none = F.array().cast(f"array<{MEASURE}>")
            return F.concat(pairs, F.when(text.rlike(VS_PAIR), versus).otherwise(none), declared)

        return _let(_direction_of(text), found)

    same = lambda a, b: (F.lower(a["label"]) == F.lower(b["label"])) & (a["value"] == b["value"]) & (a["eid"] == b["eid"])

    def first_of_each(found: Column) -> Column:
        numbered = F.transform(found, lambda m, i: F.struct(m["label"].alias("label"), m["value"].alias("value"), m["eid"].alias("eid"), m["lower"].alias("lower"), i.alias("at")))
        return _let(numbered, lambda n: F.transform(F.filter(n, lambda m: ~F.exists(n, lambda x: same(x, m) & (x["at"] < m["at"]))), lambda m: F.struct(m["label"].alias("label"), m["value"].alias("value"), m["eid"].alias("eid"), F.get(F.filter(n, lambda x: same(x, m) & x["lower"].isNotNull()), F.lit(0))["lower"].alias("lower"), m["at"].alias("at"))))

    return _let(F.flatten(F.transform(F.coalesce(pack, F.array()), of_unit)), first_of_each)


def series(pack: Column) -> Column:
    """Table rows: the mean of a unit's pair values under its heading (two values at least)."""

    def of_unit(u: Column, i: Column) -> Column:
        text = F.coalesce(u["text"], F.lit(""))
        head, values = F.regexp_extract(text, SERIES_HEAD, 1), F.transform(_all(text, PAIR, 2), lambda v: v.cast("double"))
        mean = F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values), 6)
        row = F.struct(F.trim(F.element_at(F.split(head, ","), 1)).alias("label"), mean.alias("value"), F.coalesce(u["eid"], F.lit("?")).alias("eid"), polarity(_direction_of(text), _direction_of(head)).alias("lower"), i.alias("at"))
        return F.when(text.rlike(SERIES_HEAD) & (F.size(values) >= 2), row)

    return F.filter(F.transform(F.coalesce(pack, F.array()), of_unit), lambda x: x.isNotNull())


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _hinted(label: Column, hints: tuple[str, ...]) -> Column:
    low = F.lower(label)
    out = F.contains(low, F.lit(hints[0]))
    for h in hints[1:]:
        out = out | F.contains(low, F.lit(h))
    return out


def is_subject(label: Column, subject: Column) -> Column:
    low, sub = F.trim(F.lower(label)), F.trim(F.lower(subject))
    return (sub != "") & (F.contains(low, sub) | F.contains(sub, low))


def _or_else(first: Column, second: Column) -> Column:
    return F.when(F.size(first) > 0, first).otherwise(second)


def _named(pool: Column, claim: Column, subject: Column) -> Column:
    """Measures that the claim names; no guess."""
    word = lambda m: F.concat(F.lit(r"(?U)\b\Q"), F.lower(m["label"]), F.lit(r"\E\b"))
    by_claim = F.filter(pool, lambda m: (m["label"] != "") & F.regexp_like(F.lower(claim), word(m)))
    return _or_else(F.filter(pool, lambda m: is_subject(m["label"], subject)), by_claim)


def _direction(found: Column) -> Column:
    """Distinct known directions: two are a conflict, none means that more is better."""
    return F.array_distinct(F.filter(F.transform(found, lambda m: m["lower"]), lambda x: x.isNotNull()))


def _conflict(found: Column) -> Column:
    return F.size(_direction(found)) > 1


def _lower(found: Column) -> Column:
    return F.coalesce(F.get(_direction(found), F.lit(0)), F.lit(False))


def wins(a: Column, b: Column, lower: Column) -> Column:
    return F.when(lower, a < b - TOLERANCE).otherwise(a > b + TOLERANCE)


def _eids(found: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(found, lambda m: m["eid"])))


def _result(fragment: Column, status: Column, reason: Column, eids: Column) -> Column:
    return F.struct(fragment.alias("claim_fragment"), status.alias("status"), reason.alias("reason"), eids.alias("eids")).cast(RESULT)




def _unknown(fragment: Column, reason: str, eids: Column | None = None) -> Column:
    return _result(fragment, F.lit("unknown"), F.lit(reason), F.array().cast("array<string>") if eids is None else eids)


def _judged(fragment: Column, good: Column, yes: Column, no: Column, eids: Column) -> Column:
    return _result(fragment, F.when(good, "ok").otherwise("failed"), F.when(good, yes).otherwise(no), eids)


def _text(x: Column) -> Column:
    return x.cast("string")


def _once(value: Column) -> Column:
    """The value, marked as not to be copied: an optimiser that pushes a filter on it (as a generator over it brings)
    through the stages would else write out each stage wherever a later one reads it."""
    return F.when(F.spark_partition_id() >= 0, value)


def check(rows: DataFrame, claim: str = "claim", pack: str = "pack") -> DataFrame:
    """Adds ``checks``, ``measures`` and ``series``, which depend on nothing but claim and pack: each distinct pair is
    checked once, dealt evenly, and joined back; the check of a pair costs some hundred times as much as moving it. Claim
    and pack must not change when they are read twice."""
    keys = [F.col(claim).alias("__claim"), F.col(pack).alias("__pack")]
    hashed = F.xxhash64(claim, pack)  # sorts as a number, before the texts
    pairs = rows.select(hashed.alias("__key"), *keys).distinct()
    found = _checked(spread(pairs), "__claim", "__pack")
    own = rows.withColumn("__hash", hashed)
    same = (F.col("__hash") == F.col("__key")) & F.col(claim).eqNullSafe(F.col("__claim")) & F.col(pack).eqNullSafe(F.col("__pack"))
    return own.join(found, same, "left").select(*rows.columns, "checks", "measures", "series")


def _checked(rows: DataFrame, claim: str, pack: str) -> DataFrame:
    """``check`` row by row. Stages are columns of their own, so that each is computed once per row."""
    c = F.coalesce(F.col(claim), F.lit(""))
    out = rows.withColumn("__c", c).withColumn("__m", _once(measures(F.col(pack)))).withColumn("__series", _once(series(F.col(pack))))
    out = out.withColumn("__subject", _once(F.trim(F.regexp_extract("__c", SUBJECT, 1))))
    c, m, subject = F.col("__c"), F.col("__m"), F.col("__subject")
    guessed = F.filter(m, lambda x: _hinted(x["label"], METHOD_HINTS) & ~_hinted(x["label"], BASELINE_HINTS))
    out = out.withColumn("__own", _once(_or_else(F.filter(m, lambda x: is_subject(x["label"], subject)), guessed)))
    own = F.col("__own")
    rest = F.filter(m, lambda x: ~F.exists(own, lambda s: s["at"] == x["at"]))
    out = out.withColumn("__rest", _once(rest)).withColumn("__base", _once(_or_else(F.filter("__rest", lambda x: _hinted(x["label"], BASELINE_HINTS)), F.col("__rest"))))
    out = out.withColumn("__named", _once(_named(m, c, subject))).withColumn("__nseries", _once(_named(F.col("__series"), c, subject)))
    base = F.col("__base")
    mine, other = F.get(own, F.lit(0)), F.get(base, F.lit(0))
    pair = F.array(mine, other)
    has_pair = (F.size(own) > 0) & (F.size(base) > 0)
    group = lambda pattern, i: F.regexp_extract("__c", pattern, i)
    number = lambda pattern: F.nullif(group(pattern, 1), F.lit("")).cast("double")

    direct_of = F.when((F.size("__nseries") > 0) & c.rlike(AGGREGATE), F.col("__nseries")).otherwise(F.col("__named"))
    said = F.coalesce(F.nullif(group(DIRECT, 1), F.lit("")), F.nullif(group(DIRECT, 2), F.lit(""))).cast("double")
    value = F.get(direct_of, F.lit(0))["value"]
    direct = F.when(c.rlike(DIRECT), F.when(F.size(direct_of) == 0, _unknown(group(DIRECT, 0), "the pack does not name what this number belongs to")).otherwise(_judged(group(DIRECT, 0), F.abs(value - said) < TOLERANCE, F.concat(F.lit("the table reports "), _text(value), F.lit(" as claimed")), F.concat(F.lit("the claim says "), _text(said), F.lit(", the table "), _text(value)), _eids(direct_of))))

    target = F.trim(group(COMPARE, 1))
    targets = F.filter("__rest", lambda x: F.contains(F.lower(x["label"]), F.lower(target)))
    rival = F.get(targets, F.lit(0))
    both = F.array(mine, rival)
    compare = F.when(
        c.rlike(COMPARE) & ~target.rlike(r"(?iU)^(all|any|every|most|the|compared)\b"),
        F.when((F.size(own) == 0) | (F.size(targets) == 0), _unknown(group(COMPARE, 0), "the pack has no numbers to compare")).when(_conflict(both), _unknown(group(COMPARE, 0), "the scales run in opposite directions", _eids(both))).otherwise(_judged(group(COMPARE, 0), wins(mine["value"], rival["value"], _lower(both)), F.concat(mine["label"], F.lit(" is better")), F.concat(rival["label"], F.lit(" is not worse")), _eids(both))),
    )

    quantifier = F.lower(group(ALL_ANY, 1))
    everyone = F.concat(F.slice(own, 1, 1), base)
    beats = lambda b: wins(mine["value"], b["value"], _lower(everyone))
    all_any = F.when(
        c.rlike(ALL_ANY),
        F.when(~has_pair, _unknown(group(ALL_ANY, 0), "the pack has no method and baseline to compare")).when(_conflict(everyone), _unknown(group(ALL_ANY, 0), "the scales run in opposite directions", _eids(F.concat(own, base)))).otherwise(_judged(group(ALL_ANY, 0), F.when(quantifier == "any", F.exists(base, beats)).otherwise(F.forall(base, beats)), F.lit("the baselines are worse as claimed"), F.lit("the baselines are not all worse"), _eids(F.concat(own, base)))),
    )

    quality, literal = c.rlike(BEST), ~c.rlike(BEST) & c.rlike(BEST_LITERAL)
    use_series = F.size("__nseries") > 0
    pool = F.when(use_series, F.col("__series")).otherwise(m)
    ranked = F.when(use_series, F.col("__nseries")).otherwise(F.col("__named"))
    out = out.withColumn("__pool", _once(pool)).withColumn("__ranked", _once(ranked))
    top = F.get("__ranked", F.lit(0))
    rivals = F.filter("__pool", lambda x: x["at"] != top["at"])
    word = F.lower(group(ORDINAL, 1))
    by_word = F
    for i, w in enumerate(ORDINAL_WORDS):
        by_word = by_word.when(word == w, i + 2)
    place = F.when(c.rlike(ORDINAL), by_word.otherwise(F.nullif(group(ORDINAL, 2), F.lit("")).cast("int"))).otherwise(1)
    fragment = F.concat(F.when(c.rlike(ORDINAL), F.concat(group(ORDINAL, 1), F.lit(" "))).otherwise(""), F.when(quality, group(BEST, 0)).otherwise(group(BEST_LITERAL, 0)))
    pool_of = F.concat(F.slice("__ranked", 1, 1), rivals)
    less = F.when(quality, _lower(pool_of)).otherwise(F.lower(group(BEST_LITERAL, 1)).isin("lowest", "smallest"))
    better = F.filter(rivals, lambda x: wins(x["value"], top["value"], less))
    actual = F.size(better) + 1
    best = F.when(
        quality | literal,
        F.when(F.size("__ranked") == 0, _unknown(fragment, "the pack does not name what is ranked"))
        .when(F.size(rivals) == 0, _unknown(fragment, "there is nothing to rank against", F.array(top["eid"])))
        .when(quality & _conflict(pool_of), _unknown(fragment, "the scales run in opposite directions", _eids(F.col("__pool"))))
        .otherwise(_judged(fragment, actual == place, F.concat(F.lit("it has place "), _text(actual), F.lit(" as claimed")), F.concat(F.lit("it has place "), _text(actual), F.lit(", not "), _text(place)), _eids(F.concat(F.slice("__ranked", 1, 1), _or_else(better, rivals))))),
    )

    mean = F.round(F.aggregate(m, F.lit(0.0), lambda a, x: a + x["value"]) / F.size(m), 6)
    mean_check = F.when(c.rlike(MEAN), F.when(F.size(m) == 0, _unknown(group(MEAN, 0), "the pack has no numbers")).otherwise(_judged(group(MEAN, 0), F.abs(mean - number(MEAN)) < TOLERANCE, F.concat(F.lit("the mean is "), _text(mean)), F.concat(F.lit("the mean is "), _text(mean), F.lit(", not "), _text(number(MEAN))), _eids(m))))

    gain = F.round(F.when(_lower(pair), other["value"] - mine["value"]).otherwise(mine["value"] - other["value"]), 6)
    absolute = F.when(c.rlike(ABS_GAIN), F.when(~has_pair, _unknown(group(ABS_GAIN, 0), "the pack has no method and baseline")).when(_conflict(pair), _unknown(group(ABS_GAIN, 0), "the scales run in opposite directions", _eids(pair))).otherwise(_judged(group(ABS_GAIN, 0), F.abs(gain - number(ABS_GAIN)) < TOLERANCE, F.concat(F.lit("the gain is "), _text(gain)), F.concat(F.lit("the gain is "), _text(gain), F.lit(", not "), _text(number(ABS_GAIN))), _eids(pair))))

    share = F.when(F.abs(other["value"]) >= TOLERANCE, F.abs(mine["value"] - other["value"]) / F.abs(other["value"]) * 100.0)
    relative = F.when(c.rlike(PCT_GAIN), F.when(~has_pair, _unknown(group(PCT_GAIN, 0), "the pack has no method and baseline")).when(share.isNull(), _unknown(group(PCT_GAIN, 0), "a share of zero is not defined", _eids(pair))).otherwise(_judged(group(PCT_GAIN, 0), F.abs(share - number(PCT_GAIN)) < TOLERANCE, F.format_string("the gain is %.2f%%", share), F.format_string("the gain is %.2f%%, not as claimed", share), _eids(pair))))

    checks = F.filter(F.array(direct, compare, all_any, best, mean_check, absolute, relative), lambda x: x.isNotNull())
    return out.withColumn("checks", _once(checks)).select(*rows.columns, "checks", F.col("__m").alias("measures"), F.col("__series").alias("series"))


def brief(checks: Column) -> Column:
    """The checks as lines for a prompt."""
    return F.array_join(F.transform(checks, lambda x: F.concat(F.lit("- ["), x["status"], F.lit("] "), x["claim_fragment"], F.lit(": "), x["reason"])), "\n")


def override(rows: DataFrame, allowed: str = "allowed", protect: str | None = None) -> DataFrame:
    """A failed check with evidence makes the verdict contradicted; nothing is ever upgraded, fallbacks are left."""
    failed = F.filter("checks", lambda x: (x["status"] == "failed") & (F.size(x["eids"]) > 0))
    hit = (F.size(failed) > 0) & (~F.col(protect) if protect else F.lit(True))
    eids = F.filter(F.flatten(F.transform(failed, lambda x: x["eids"])), lambda e: F.array_contains(allowed, e))
    keep = {
        "verdict": F.lit("contradicted"),
        "abstain": F.lit(False),
        "confidence": F.greatest("confidence", F.lit(TOOL_CONFIDENCE)),
        "issue_tags": F.array_union("issue_tags", F.array(F.lit(NUMERIC_TAG))),
        "predicted_eids": F.array_union("predicted_eids", eids),
        "rationale_short": F.left(F.concat(F.lit("Numeric check overrode the model verdict: "), F.get(failed, F.lit(0))["reason"]), F.lit(500)),
    }
    return rows.withColumn("__hit", hit).withColumns({k: F.when(F.col("__hit"), v).otherwise(F.col(k)) for k, v in keep.items()}).drop("__hit")
