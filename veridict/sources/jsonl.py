"""JSON Lines and other structured files: scans that refuse broken input, and sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridict.sources.tables import shared

STRUCTURED = ("json", "jsonl", "ndjson", "yaml", "yml")


def read_typed(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Typed scan of one or several files; a broken line fails the job. Columns not asked for are not parsed."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def numbered_lines(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """file, line (from 1, blank lines counted), text (blanks at its ends stripped) of lines that are not blank.

    Files are read in splits of any size. Within a split lines follow each other, so a line's number is its distance from
    its split's first line plus the lines of the splits before; only those counts, one row a split, are gathered.
    """
    raw = spark.read.options(**options).text(paths)
    at = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = at.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = shared(blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    line = (F.col("id") - F.col("first") + F.col("before") + 1).alias("line")
    whole = at.join(starts, ["file", "block"]).select("file", line, "value")
    first = F.when(F.col("line") == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    return whole.select("file", "line", F.regexp_replace(first, r"(?U)^\s+|\s+$", "").alias("text")).where("text <> ''")


def parsed(lines: DataFrame, kind: str = "") -> DataFrame:
    """``lines(file, line, text)`` with document (VARIANT); what is no JSON, or no ``kind`` of it, fails the job and is
    named by file and line."""
    document = F.try_parse_json("text")
    good = F.schema_of_variant("document").startswith(kind) if kind else F.col("document").isNotNull()
    message = F.format_string(f"%s:%d: not a JSON {kind.lower() or 'value'}", "file", "line")
    checked = lines.withColumn("document", document).withColumn("bad", F.assert_true(F.coalesce(good, F.lit(False)), message))
    return checked.where("bad IS NULL").select("file", "line", "document")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, line, document (VARIANT); a byte-order mark is dropped; a line that is no object fails the job."""
    return parsed(numbered_lines(spark, paths), "OBJECT")


def read_lenient(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Untyped scan that keeps what parses and drops nothing silently: broken lines have a null document."""
    return spark.read.text(paths).where(F.trim("value") != "").select(F.try_parse_json("value").alias("document"), F.col("value").alias("text"))


def keep_last(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Per key the last row in this order: later files, then later lines win."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def stress_metadata(spark: SparkSession, paths: list[str]) -> DataFrame:
    """instance_id, is_stress_case, stress_type, seed_instance_id of private records; the last file's row stays."""
    lines = None
    for at, path in enumerate(paths):
        own = read_lines(spark, path).withColumn("at", F.lit(at))
        lines = own if lines is None else lines.unionByName(own)
    get = lambda p, t: F.try_variant_get("document", p, t)
    rows = lines.select(get("$.instance_id", "string").alias("instance_id"), F.coalesce(get("$.stress.is_stress_case", "boolean"), F.lit(False)).alias("is_stress_case"), get("$.stress.stress_type", "string").alias("stress_type"), get("$.stress.seed_instance_id", "string").alias("seed_instance_id"), "at", "line")
    return keep_last(rows, "instance_id", "at", "line").drop("at", "line")


def _yaml_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        import yaml
    except ImportError:
        yaml = None
    for batch in batches:
        rows = []
        for path, text in zip(batch["path"], batch["text"]):
            if yaml:
                rows += [(path, json.dumps(d)) for d in yaml.safe_load_all(text) if d is not None]
        yield pd.DataFrame(rows, columns=["path", "json"])


def read_structured(spark: SparkSession, folder: str) -> DataFrame:
    """path, document (VARIANT) of every JSON, JSON Lines and YAML file below a folder.

    A broken file fails the job, never is it left out; other suffixes are ignored; YAML needs its library, without
    which such files give nothing.
    """
    whole = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    files = whole.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text")).withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))).where(F.col("suffix").isin(*STRUCTURED))
    lines = files.where("suffix IN ('jsonl', 'ndjson')").select("path", F.explode(F.split("text", "\r?\n")).alias("json")).where(F.trim("json") != "")
    plain = files.where("suffix = 'json'").select("path", F.col("text").alias("json"))
    yaml = files.where("suffix IN ('yaml', 'yml')").select("path", "text").mapInPandas(_yaml_documents, "path string, json string")
    found = lines.unionByName(plain).unionByName(yaml).select("path", F.try_parse_json("json").alias("document"))
    good = F.assert_true(F.col("document").isNotNull(), F.format_string("%s: broken JSON", "path"))
    return found.withColumn("bad", good).where("bad IS NULL").drop("bad")


def collect_splits(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """split, instance_id, text, pack (JSON) of the input records in each split's folder; private files are left out,
    and so are values without a claim text and a pack. A broken line fails the job; a record without an id has its file's
    name and its line instead."""
    frames = []
    for split, folder in folders.items():
        lines = read_lines_below(spark, folder)
        text = F.try_variant_get("document", "$.claim.text", "string")
        frames.append(lines.where((F.trim(text) != "") & F.schema_of_variant(F.try_variant_get("document", "$.evidence_pack", "variant")).isNotNull()).select(F.lit(split).alias("split"), F.coalesce(F.try_variant_get("document", "$.instance_id", "string"), F.format_string("<%s:%d>", F.element_at(F.split("file", "/"), -1), "line")).alias("instance_id"), text.alias("text"), F.from_json(F.try_variant_get("document", "$.evidence_pack", "variant").cast("string"), "array<struct<eid:string,text:string>>").alias("pack")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_lines_below(spark: SparkSession, folder: str) -> DataFrame:
    """file, line, document of every JSON Lines file below a folder but private ones; values of any kind."""
    lines = numbered_lines(spark, folder, recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    return parsed(lines.where(~F.element_at(F.split("file", "/"), -1).contains("internal_annotation")))


def write_lines(rows: DataFrame, path: str) -> None:
    """UTF-8 JSON Lines; absent (null) fields are left out."""
    rows.write.mode("overwrite").json(path)


def write_two_sided(inputs: DataFrame, gold: DataFrame, students: str, staff: str, public: str = "public") -> None:
    """Inputs of all splits and gold of the public one for students, gold of all for staff; partitioned by split."""
    inputs.write.mode("overwrite").partitionBy("split").json(f"{students}/inputs")
    gold.where(F.col("split") == public).write.mode("overwrite").partitionBy("split").json(f"{students}/gold")
    gold.write.mode("overwrite").partitionBy("split").json(f"{staff}/gold")


def replace_all(text: str, changes: dict[str, str]) -> tuple[str, int]:
    """Literal replacements in a small text, and how many were made."""
    hits = 0
    for old, new in changes.items():
        hits += text.count(old)
        text = text.replace(old, new)
    return text, hits
