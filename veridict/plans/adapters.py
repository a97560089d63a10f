"""Views that turn the driver tables into gold labels, predictions, packs and ballots.

One text for Spark and for the oracle: CASE, split and concat mean the same in both.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_VERDICT = "CASE {x} WHEN 0 THEN 'warranted' WHEN 1 THEN 'overclaimed' WHEN 2 THEN 'contradicted' ELSE 'insufficient' END"
_GOLD = f"CASE event_type WHEN 'view' THEN 'warranted' WHEN 'click' THEN 'overclaimed' WHEN 'purchase' THEN 'contradicted' WHEN 'signup' THEN 'insufficient' ELSE {_VERDICT.format(x='event_id % 4')} END"

VIEWS = {
    "gold": f"""SELECT event_id AS instance_id, {_GOLD} AS verdict,
        split(concat('e', CAST(event_id % 4 AS STRING), ',e', CAST(user_id % 3 AS STRING)), ',') AS supporting_eids,
        split(concat('tag', CAST(event_id % 6 AS STRING), ',tag', CAST(user_id % 5 AS STRING)), ',') AS issue_tags FROM [events]""",
    "pred": f"""SELECT event_id AS instance_id, CASE WHEN event_id % 5 < 3 THEN {_GOLD} ELSE {_VERDICT.format(x='(event_id * 7) % 4')} END AS verdict,
        CAST(event_id % 101 AS DOUBLE) / 100 AS confidence, event_id % 9 = 0 AS abstain,
        split(concat('e', CAST(event_id % 4 AS STRING), ',e', CAST((user_id + event_id) % 3 AS STRING)), ',') AS predicted_eids,
        split(concat('tag', CAST(event_id % 6 AS STRING), ',tag', CAST((user_id + event_id) % 7 AS STRING)), ',') AS issue_tags,
        CAST(event_id % 13 AS DOUBLE) / 8 AS runtime_seconds, CAST(event_id % 3 AS DOUBLE) AS gpu_seconds,
        CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 5 AS DOUBLE) / 16 END AS api_cost_usd,
        concat('model-', CAST(event_id % 3 AS STRING)) AS model FROM [events]""",
    "submitted": """SELECT * FROM [pred] WHERE instance_id % 997 <> 0""",
    "stress": """SELECT event_id AS instance_id, event_id % 3 = 0 AS is_stress_case,
        CASE WHEN event_id % 3 = 0 THEN concat('kind', CAST(event_id % 4 AS STRING)) END AS stress_type FROM [events] WHERE event_id % 10 <> 9""",
    "pack": """SELECT l_orderkey AS instance_id, concat('e', CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS STRING)) AS eid,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS ordinal,
        concat('raw', CAST(l_linenumber AS STRING)) AS raw_eid, l_returnflag AS source_kind, l_linestatus AS modality, l_partkey, l_quantity, l_extendedprice, l_discount FROM [lineitem]""",
    "ballots": """SELECT l_orderkey AS instance_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS ballot_no,
        CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'contradicted' WHEN l_returnflag = 'N' THEN 'warranted' ELSE 'insufficient' END AS verdict,
        1 - l_discount AS confidence, l_suppkey % 4 = 0 AS no_eids FROM [lineitem]""",
    "labelled": """SELECT l.doc_id AS instance_id, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'warranted' WHEN l.quality = 1 THEN 'overclaimed' WHEN l.toxic = 0 THEN 'insufficient' ELSE 'contradicted' END AS label,
        lower(d.text) AS text FROM [labels] l JOIN [documents] d ON l.doc_id = d.doc_id""",
    "runs": """SELECT concat('system', CAST(s.range AS STRING)) AS system, r.range AS pass, p.instance_id, p.verdict, g.verdict AS gold, p.confidence
        FROM [pred] p JOIN [gold] g ON p.instance_id = g.instance_id CROSS JOIN [three] s CROSS JOIN [three] r WHERE (p.instance_id + s.range * 7 + r.range * 3) % 4 <> s.range""",
}
#: Tables of numbers that both engines make by themselves.
NUMBERS = {"three": "SELECT id AS range FROM range(3)"}


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\[([a-z]\w*)\]", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a driver table as a DataFrame."""
    if name in NUMBERS:
        return spark.sql(NUMBERS[name])
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(re.sub(r"\[([a-z]\w*)\]", r"{\1}", sql), **{n: view(spark, sf_dir, n) for n in names_in(sql)})


def oracle(body: str) -> str:
    """SQL for the oracle: ``[name]`` in ``body`` names a view, which comes before it with those that it needs."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        if name in parts or (name not in VIEWS and name not in NUMBERS):
            return
        if name in NUMBERS:
            parts[name] = "SELECT range FROM range(3)"
            return
        for n in names_in(VIEWS[name]):
            add(n)
        parts[name] = VIEWS[name]

    for n in names_in(body):
        add(n)
    plain = lambda s: re.sub(r"\[([a-z]\w*)\]", r"\1", s)
    heads = ", ".join(f"{n} AS ({plain(s)})" for n, s in parts.items())
    body = plain(body).strip()
    if not heads:
        return body
    return f"WITH {heads}, {body[5:]}" if body.startswith("WITH ") else f"WITH {heads} {body}"
