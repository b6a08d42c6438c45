"""Drainage structures: wording to type and subtype, subtype to code and price, depth and number hints."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from planquant.functions import rules
from planquant.functions.arrays import let
from planquant.functions.text import extract, matches, rlike, strip


def _code_of(kind: str, subtype: str | None) -> tuple[str, float]:
    if subtype in rules.SUBTYPE_CODES:
        return rules.SUBTYPE_CODES[subtype]
    return rules.DEFAULT_STRUCTURES[kind]


def _ordered() -> list[tuple[str, str, str | None]]:
    return [*(r for r in rules.STRUCTURE_WORDINGS if r[2]), *(r for r in rules.STRUCTURE_WORDINGS if not r[2])]


def wording_of(text: Column, with_generic: bool = True) -> Column:
    """The place in `_ordered` of the wording that a text has: the first specific one, failing that the first generic one; or null."""
    up = strip(F.upper(F.coalesce(text, F.lit(""))))
    number = lambda s: reduce(lambda out, k: F.when(rlike(s, "(?i)" + k[1][0]), k[0]).otherwise(out), reversed([(n, r) for n, r in enumerate(_ordered()) if r[2] or with_generic]), F.lit(None).cast("int"))
    return let(up, number)


def _structures() -> Column:
    """What each wording of `_ordered` stands for."""

    def entry(kind: str, subtype: str | None) -> str:
        code, price = _code_of(kind, subtype)
        name = kind.replace("_", " ")
        fields = {
            "fdot_code": code, "description": f"{name}, {subtype}" if subtype else name, "type": kind, "subtype": subtype or "STANDARD", "unit": "EA", "unit_price": float(price),
            "confidence": 0.95 if subtype else 0.70, "reason": f"Pattern match: {subtype}" if subtype else f"Generic {kind.lower()} match",
        }
        quoted = lambda v: f"{v}D" if isinstance(v, float) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "named_struct(" + ", ".join(f"'{n}', {quoted(v)}" for n, v in fields.items()) + ")"

    return F.expr("array(" + ", ".join(entry(kind, subtype) for _, kind, subtype in _ordered()) + ")")


def structure_of(text: Column, with_generic: bool = True) -> Column:
    """struct(fdot_code, description, type, subtype, unit, unit_price, confidence, reason), or null.

    The first specific wording wins (0.95); failing that the first generic one (0.70). Wordings are tried once, whatever
    fields are read: what a wording stands for is looked up by its number."""
    return F.get(_structures(), wording_of(text, with_generic))


def structure_number(text: Column) -> Column:
    return extract(text, r"#\s*(\d+)")


# Ways to give a depth.
_DEPTHS = (r"(\d+)['\s]*(?:-\s*(\d+)['\s]*)?DEEP", r"DEPTH[:\s]*(\d+)['\s]*(?:-\s*(\d+)['\s]*)?", r"(\d+)['\s]*TO['\s]*(\d+)['\s]*(?:DEEP|DEPTH)?")


def depth_bucket(text: Column) -> Column:
    """The mean of a depth or range of depths, as one of five buckets; null if there is none."""
    up = F.upper(F.coalesce(text, F.lit("")))
    means = [(a + F.coalesce(b, a)) / 2 for a, b in ((extract(up, p, 1).try_cast("double"), extract(up, p, 2).try_cast("double")) for p in _DEPTHS)]
    d = F.coalesce(*means)
    return F.when(d < 4, "<4'").when(d < 6, "4'-6'").when(d < 8, "6'-8'").when(d < 10, "8'-10'").when(d.isNotNull(), ">10'")


# Mentions of structures in running text.
_MENTIONS = (
    r"(?:TYPE\s*[A-Z][-\s]?\d?|[A-Z][-\s]?\d?\s*TYPE)?\s*INLET(?:\s*#?\d+)?(?:\s*\([^)]+\))?",
    r"(?:TYPE\s*[A-Z0-9][-\s]?\d?|[A-Z0-9][-\s]?\d?\s*TYPE)?\s*MANHOLE(?:\s*#?\d+)?",
    r"JUNCTION\s*BOX(?:\s*#?\d+)?",
    r"CATCH\s*BASIN(?:\s*#?\d+)?",
    r"(?:MH|CB|JB|INL?)\s*#?\d+",
)


def structures_in(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """A row per mention (each stretch of text once) with its structure."""
    up = F.upper(F.col(text_col))
    every = F.concat(*[matches(up, "(?i)" + p, 0, with_start=True) for p in _MENTIONS])
    hits = pages.select(*keys, F.explode(every).alias("h")).select(*keys, F.col("h.start").alias("start"), F.col("h.m").alias("m")).dropDuplicates([*keys, "start", "m"])
    return hits.withColumn("s", structure_of(F.col("m"))).filter("s is not null").select(*keys, "start", "m", "s.*")


def structure_codes(spark: SparkSession) -> DataFrame:
    """The embedded price table: fdot_code, type, subtype, price, depth."""
    return spark.createDataFrame(list(rules.STRUCTURES), "fdot_code string, type string, subtype string, price double, depth string")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Twice the characters in common blocks over all characters of both: the longest common block (the first in a, then in b), then the same to
    its left and to its right."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right, strict=True)], dtype="float64")

    return ratio(a, b)


def closest_subtype(structures: DataFrame, wanted: DataFrame) -> DataFrame:
    """For subtypes without a code of their own: the table's subtype of the same type that is most like it (`sequence_ratio`), a shared
    depth counting a tenth; over half alike, the first by code on ties. Only distinct pairs of subtypes of one type are compared."""
    asked = wanted.select("type", "subtype", "depth").distinct()
    pairs = asked.alias("w").join(structures.alias("s"), F.col("w.type") == F.col("s.type"))
    likeness = pairs.select("w.type", F.upper("w.subtype").alias("a"), F.upper("s.subtype").alias("b")).distinct().withColumn("r", sequence_ratio(F.col("a"), F.col("b")))
    scored = pairs.select("w.type", "w.subtype", "w.depth", F.col("s.fdot_code").alias("code"), F.col("s.price").alias("price"), F.col("s.depth").alias("has"), F.upper("w.subtype").alias("a"), F.upper("s.subtype").alias("b")).join(likeness, ["type", "a", "b"])
    score = F.col("r") + F.when(F.col("depth") == F.col("has"), 0.1).otherwise(0.0)
    scored = scored.withColumn("score", score).filter("score > 0.5")
    return scored.groupBy("type", "subtype", "depth").agg(F.min_by(F.struct(F.col("code").alias("fdot_code"), "price"), F.struct((-F.col("score")).alias("s"), "code")).alias("best")).select("type", "subtype", "depth", "best.*")


#: What a type without a default has.
FALLBACK = ("425-1-541", 4200.0)


def code_lookup(wanted: DataFrame, structures: DataFrame) -> DataFrame:
    """wanted(type, subtype, depth) with fdot_code, price and how they were found: direct (the subtype has a code), standard, closest, or
    default (of the type). Subtypes compare in capitals."""
    up = F.upper("subtype")
    table = lambda d, n: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, v[n])])
    kind = lambda n, cast: F.coalesce(F.element_at(table(rules.DEFAULT_STRUCTURES, n), F.col("type")), F.lit(FALLBACK[n])).cast(cast)
    direct = F.element_at(table(rules.SUBTYPE_CODES, 0), up)
    rest = wanted.filter(direct.isNull() & up.isNotNull() & (up != "") & (up != "STANDARD"))
    near = closest_subtype(structures, rest).select(F.col("type").alias("_t"), F.col("subtype").alias("_s"), F.col("depth").alias("_d"), F.col("fdot_code").alias("_code"), F.col("price").alias("_price"))
    j = wanted.join(near, F.col("type").eqNullSafe(F.col("_t")) & F.col("subtype").eqNullSafe(F.col("_s")) & F.col("depth").eqNullSafe(F.col("_d")), "left")
    found = F.when(direct.isNotNull(), "direct").when(up == "STANDARD", "standard").when(F.col("_code").isNotNull(), "closest").otherwise("default")
    return j.select(*wanted.columns, F.coalesce(direct, F.col("_code"), kind(0, "string")).alias("fdot_code"), F.coalesce(F.element_at(table(rules.SUBTYPE_CODES, 1), up).cast("double"), F.col("_price"), kind(1, "double")).alias("price"), found.alias("found"))
