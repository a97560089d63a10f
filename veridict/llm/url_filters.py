"""Operator 1: URL filters from a path-template tree per host, in DataFrame functions only.

Below each host, level by level: numbers within a segment become ``{n}``; a place with many different segments that
hardly recur becomes the wildcard ``*``; other siblings whose subtrees look alike merge. Alike is told without labels, by
how often each form of the rest of the path (its segments with words and numbers blanked) follows a sibling: by a
likelihood-ratio test it is held against its place as a whole, and, if it departs from that, against the siblings with
the same most frequent form; one that departs from those too stays by itself. Labels are then pooled over the merged template, and a
branch's own smoothed purity goes by its own labels with the pool's purity as the prior; so a branch with labels of its
own is judged by them, and one with none by those of the branches like it. It is rejected where that is too low.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.llm.common import measured, shared, stored, table

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: A place is variable from so many different segments on, if they have fewer URLs than this each.
VARIABLE_SEGMENTS, VARIABLE_URLS = 10, 3
#: Standard deviations by which the test statistic may exceed its mean among siblings that are alike.
DEVIATIONS = 3.0
#: Purity of a template without labels, the weight of a prior in URLs, and the purity below which a branch is rejected.
PRIOR, WEIGHT, LEAST_PURITY = 0.5, 2.0, 0.3
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = []
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found.append(F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found)


def purity(good: Column, bad: Column, prior: Column | float = PRIOR) -> Column:
    return (good + prior * F.lit(WEIGHT)) / (good + bad + F.lit(WEIGHT))


def alike(s: Column, own: Column, everything: Column, freedom: Column) -> Column:
    """Whether ``own`` paths, with the sum ``s`` of their forms' log shares, depart from ``everything`` by chance only.
    Both sides are for each path and rounded, so that the order of a sum decides nothing."""
    return F.round(s / own - F.log(own) + F.log(everything), 9) <= F.round((freedom + DEVIATIONS * F.sqrt(2 * freedom)) / (2 * own), 9)


def named_siblings(below: DataFrame) -> DataFrame:
    """``below(host, template, piece, rest, n)`` to one row per host, template and piece: what stands for it in the
    merged and in the exact template, and how many paths its place has."""
    place, sibling = ["host", "template"], ["host", "template", "piece"]
    cells = shared(below.groupBy(*sibling, "rest").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("urls")))
    siblings = shared(cells.groupBy(*sibling).agg(F.max(F.struct("m", "rest"))["rest"].alias("mode"), F.sum("m").alias("own"), F.sum("urls").alias("urls")))
    moded = shared(cells.join(siblings.select(*sibling, "mode"), sibling).select(*sibling, "mode", "rest", "m"))
    forms = measured(moded.groupBy(*place, "rest").agg(F.sum("m").alias("of_form")), 200)
    groups = measured(moded.groupBy(*place, "mode", "rest").agg(F.sum("m").alias("of_group")), 300)
    log_share = lambda of: F.sum(F.col("m") * (F.log("m") - F.log(of)))
    sums = moded.join(forms, [*place, "rest"]).join(groups, [*place, "mode", "rest"]).groupBy(*sibling).agg(log_share("of_form").alias("s"), log_share("of_group").alias("s_group"))
    counts = siblings.groupBy(*place).agg(F.count(F.lit(1)).alias("k"), F.sum("urls").alias("place_urls"))
    places = forms.groupBy(*place).agg(F.sum("of_form").alias("all"), (F.count(F.lit(1)) - 1).alias("freedom")).join(counts, place)
    of_mode = groups.groupBy(*place, "mode").agg(F.sum("of_group").alias("all_group"), (F.count(F.lit(1)) - 1).alias("freedom_group"))
    known = siblings.join(sums, sibling).join(measured(places, 200), place).join(measured(of_mode, 300), [*place, "mode"])
    variable = (F.col("k") >= VARIABLE_SEGMENTS) & (F.col("place_urls") < VARIABLE_URLS * F.col("k"))
    itself = F.concat(F.lit("="), "piece")
    merged = F.when(variable, "*").when(alike(F.col("s"), F.col("own"), F.col("all"), F.col("freedom")), "~")
    merged = merged.when(alike(F.col("s_group"), F.col("own"), F.col("all_group"), F.col("freedom_group")), F.concat(F.lit("~"), "mode")).otherwise(itself)
    return known.select(*sibling, merged.alias("as"), F.when(variable, "*").otherwise(itself).alias("itself"), "all")


def templates(paths: DataFrame) -> DataFrame:
    """``paths(host, path, n, good, bad)``, one row per host and path, with its merged and its exact template.

    Levels go on until no path has a further segment; paths that have ended, and such as are alone in their place (all
    below is theirs), are set aside. So there are as many levels as any two paths have alike.
    """
    segments = F.split("path", "/")
    pieces = F.transform(F.slice(segments, F.lit(2), F.size(segments)), lambda s: F.regexp_replace(s, "[0-9]+", "{n}"))
    start = paths.withColumn("pieces", pieces).withColumns({"template": F.lit(""), "exact": F.lit("")})
    tree = shared(start.where(F.size("pieces") > 0))
    ended, level = start.where(F.size("pieces") == 0), 0
    while not tree.isEmpty():
        level += 1
        forms = F.transform(F.slice("pieces", F.lit(level + 1), F.size("pieces")), lambda s: F.regexp_replace(s, "[A-Za-z]+", "w"))
        rest = F.concat((F.size("pieces") - level).cast("string"), F.lit(":"), F.array_join(forms, "/"))
        below = tree.withColumn("piece", F.get("pieces", F.lit(level - 1)))
        named = named_siblings(below.withColumn("rest", rest))
        step = below.join(measured(named, 300), ["host", "template", "piece"])
        longer = [F.concat("template", F.lit("/"), "as").alias("template"), F.concat("exact", F.lit("/"), "itself").alias("exact")]
        # a table, since a checkpoint keeps what the optimiser has inferred, which would double with each level
        step, _ = stored(step.select("host", "path", "n", "good", "bad", "pieces", *longer, ((F.size("pieces") == level) | (F.col("all") == 1)).alias("done")))
        ended = ended.unionByName(step.where("done").drop("done"))
        tree = step.where(~F.col("done")).drop("done")
    return ended.drop("pieces")


def template_verdicts(urls: DataFrame) -> DataFrame:
    """``urls(host, path, good)`` with good true, false or null (unlabelled) to (host, path, template, purity, verdict)."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    paths = urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), count(F.col("good"))("good"), count(~F.col("good"))("bad"))
    placed = shared(templates(paths))
    branches = shared(placed.groupBy("host", "template", "exact").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    pools = measured(branches.groupBy("host", "template").agg(purity(F.sum("good"), F.sum("bad")).alias("pool")), 200)
    judged = branches.join(pools, ["host", "template"]).select("host", "exact", F.round(purity(F.col("good"), F.col("bad"), F.col("pool")), 9).alias("purity"))
    found = placed.select("host", "path", "template", "exact").join(measured(judged, 200), ["host", "exact"])
    return found.select("host", "path", "template", "purity", F.when(F.col("purity") < LEAST_PURITY, "block").otherwise("allow").alias("verdict"))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict. URLs that a rule fits are the labelled ones of their host.

    Null URLs and those without ``://`` have an empty host and path and are judged together; rows that repeat are
    judged alike, each with a row of its own, and count as often among the labels; very long URLs are read whole; other
    columns are ignored.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parsed.withColumn("its", rule_for(F.col("host"), F.col("path"), rules))
    judged = template_verdicts(ruled.select("host", "path", (F.col("its.verdict") == "allow").alias("good")))
    by_rule = ruled.where("its IS NOT NULL").select("page_id", "host", "path", "its.rule", "its.verdict")
    by_tree = ruled.where("its IS NULL").join(judged, ["host", "path"]).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), "verdict")
    return by_rule.unionByName(by_tree)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda i: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{(h + p, v)[i]}'" for h, p, v in ordered) + " END"
    pure = lambda g, b, prior: f"(({g}) + {prior} * CAST({WEIGHT} AS DOUBLE)) / (({g}) + ({b}) + CAST({WEIGHT} AS DOUBLE))"
    url = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    parts = [
        f"u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{url}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{url}', 2), '') AS path FROM pages)",
        f"r AS (SELECT *, {case(0)} AS rule, {case(1)} AS ruled FROM u)",
        "paths AS (SELECT host, path, count(*) AS n, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad FROM r GROUP BY host, path)",
        "t0 AS (SELECT *, string_split(path, '/') AS segments FROM paths)",
    ]
    variable = f"k >= {VARIABLE_SEGMENTS} AND urls < {VARIABLE_URLS} * k"
    near = lambda s, al, freedom: f"round({s} / own - ln(own) + ln({al}), 9) <= round(({freedom} + {DEVIATIONS} * sqrt(2 * {freedom})) / (2 * own), 9)"
    alike_all, alike_group = near("s", "al", "freedom"), near("s_group", "al_group", "freedom_group")
    parts += [
        f"""walk AS (SELECT host, path, n, good, bad, list_transform(list_slice(segments, 2, len(segments)), lambda s: regexp_replace(s, '[0-9]+', '{{n}}', 'g')) AS pieces, '' AS template, '' AS exact, 0 AS level FROM t0
  UNION ALL SELECT host, path, n, good, bad, pieces, template || '/' || CASE WHEN {variable} THEN '*' WHEN {alike_all} THEN '~' WHEN {alike_group} THEN '~' || mode ELSE '=' || piece END, exact || '/' || CASE WHEN {variable} THEN '*' ELSE '=' || piece END, level + 1
  FROM (SELECT *, sum(ln(m) - ln(of_form)) OVER b AS s, sum(ln(m) - ln(of_group)) OVER b AS s_group FROM
   (SELECT *, count(*) OVER (PARTITION BY host, template, mode, rest) AS of_group, count(*) OVER g AS al_group, count(DISTINCT rest) OVER g - 1 AS freedom_group FROM
    (SELECT *, (max(struct_pack(m := m, r := rest)) OVER b).r AS mode FROM
     (SELECT *, count(*) OVER (PARTITION BY host, template, piece, rest) AS m, count(*) OVER (PARTITION BY host, template, rest) AS of_form, count(*) OVER b AS own, count(*) OVER p AS al, count(DISTINCT piece) OVER p AS k, count(DISTINCT rest) OVER p - 1 AS freedom, CAST(sum(n) OVER p AS BIGINT) AS urls FROM
      (SELECT *, pieces[level + 1] AS piece, CAST(len(pieces) - level - 1 AS VARCHAR) || ':' || array_to_string(list_transform(list_slice(pieces, level + 2, len(pieces)), lambda s: regexp_replace(s, '[A-Za-z]+', 'w', 'g')), '/') AS rest FROM walk WHERE level < len(pieces))
      WINDOW p AS (PARTITION BY host, template), b AS (PARTITION BY host, template, piece))
     WINDOW b AS (PARTITION BY host, template, piece))
    WINDOW g AS (PARTITION BY host, template, mode))
   WINDOW b AS (PARTITION BY host, template, piece)))""",
        f"pooled AS (SELECT *, {pure('sum(good) OVER q', 'sum(bad) OVER q', f'CAST({PRIOR} AS DOUBLE)')} AS pool FROM walk WHERE level = len(pieces) WINDOW q AS (PARTITION BY host, template))",
        f"j AS (SELECT host, path, CASE WHEN round({pure('sum(good) OVER q', 'sum(bad) OVER q', 'pool')}, 9) < {LEAST_PURITY} THEN 'block' ELSE 'allow' END AS verdict FROM pooled WINDOW q AS (PARTITION BY host, exact))",
    ]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\nSELECT r.page_id, r.host, r.path, r.rule, coalesce(r.ruled, j.verdict) AS verdict FROM r JOIN j ON r.host = j.host AND r.path = j.path"


OP1_SQL = _oracle()
