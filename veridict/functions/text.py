"""Scalar text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the identifier format.
ID_SHAPE = "^sas_[a-z0-9]{8}$"
ID_COUNTER = "_[0-9]{2,}$"
FORBIDDEN_ID_PARTS = ("seed", "stress", "scope", "expansion", "removal", "evidence", "numeric", "perturbation", "distractor", "gold", "hidden", "challenge", "autostress", "warrant", "overclaim", "contradict", "insufficient")


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zA-Z0-9_]+"), F.lit(0))


def mixed_tokens(text: Column) -> Column:
    """Latin and Cyrillic words and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zа-яё0-9]+"), F.lit(0))


def normal(text: Column) -> Column:
    """Lower case, ends stripped, runs of (Unicode) blanks as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def first_filled(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def fingerprint(pack: Column) -> Column:
    """Ordered (eid, normalised text) of an evidence pack; null packs are empty."""
    empty = F.array().cast("array<struct<eid:string,text:string>>")
    return F.coalesce(F.transform(pack, lambda u: F.struct(u["eid"].alias("eid"), normal(u["text"]).alias("text"))), empty)


def id_problems(name: Column) -> Column:
    """Codes of what is wrong with the shape of an identifier."""
    part = F.exists(F.array(*[F.lit(p) for p in FORBIDDEN_ID_PARTS]), lambda p: F.contains(F.lower(name), p))
    found = F.array(F.when(~name.rlike(ID_SHAPE), "shape"), F.when(part, "word"), F.when(name.rlike(ID_COUNTER), "counter"))
    return F.filter(found, lambda x: x.isNotNull())


def glob_pattern(glob: str) -> str:
    """A file glob as a regular expression."""
    special = {"*": ".*", "?": "."}
    return "^" + "".join(special.get(c, c if c.isalnum() or c == "_" else "\\" + c) for c in glob) + "$"


def p_value_class(p: Column) -> Column:
    return F.when(p < 0.05, "leak").when(p < 0.20, "suspect").otherwise("clean")


def rounded(x: Column, digits: int) -> Column:
    """A double half up at ``digits``, of the product as SQL engines round it; Spark's own goes by the decimal that it
    prints, so 0.5045 (504.49999999999994 thousandths) becomes 0.505 there."""
    return F.round(x * 10.0**digits) / 10.0**digits
