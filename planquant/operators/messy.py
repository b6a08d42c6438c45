"""Fallbacks for text that no table or item pattern reads: material mentions, and quantities from nearby lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from planquant.functions.text import clean_ocr, first_wins, matches, none_if_empty, parse_number, strip
from planquant.operators.summary import CODE, UNITS

# Mentions of pipes, structures and ends.
_PIPE = "(?i)(\\d{1,2})[\"”″]?\\s*(RCP|HDPE|PVC|DIP|PIPE|CONC)"
_STRUCTURE = r"(?i)(TYPE\s+[A-Z])?\s*(INLET|MANHOLE|MH|JUNCTION BOX)\s*#?\s*(\d+)?"
_END = r"(?i)(STRAIGHT|WINGED|U-TYPE)?\s*(ENDWALL|MES|MITERED END SECTION|FES|FLARED END)"
_FIELDS = "struct<kind:int,hit:int,type:string,size:string,material:string,subtype:string,id:string,style:string,raw_match:string>"


def messy_materials(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Material mentions of a page after the misreading rules, one per type, size, material and number; all of low confidence."""
    null = F.lit(None).cast("string")

    def row(kind: int, i: Column, x: Column, t: Column, size: Column = null, material: Column = null, subtype: Column = null, number: Column = null, style: Column = null) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("hit"), t.alias("type"), size.alias("size"), material.alias("material"), subtype.alias("subtype"), number.alias("id"), style.alias("style"), x["m"].alias("raw_match")).cast(_FIELDS)

    def pipe(x, i):
        m = F.upper(x["g2"])
        return row(0, i, x, F.lit("pipe"), F.concat(x["g1"], F.lit('"')), F.when(m == "CONC", "RCP").otherwise(m))

    def structure(x, i):
        t = F.upper(x["g2"])
        return row(1, i, x, F.lower(F.when(t == "MH", "MANHOLE").otherwise(t)), subtype=x["g1"], number=x["g3"])

    def end(x, i):
        t = F.upper(x["g2"])
        name = F.when(F.contains(t, F.lit("MES")) | F.contains(t, F.lit("MITERED")), "mes").when(F.contains(t, F.lit("FES")) | F.contains(t, F.lit("FLARED")), "fes").otherwise("endwall")
        return row(2, i, x, name, style=F.coalesce(F.upper(x["g1"]), F.lit("STANDARD")))

    t = F.col("_clean")
    every = F.concat(F.transform(matches(t, _PIPE, 2), pipe), F.transform(matches(t, _STRUCTURE, 3), structure), F.transform(matches(t, _END, 2), end))
    found = pages.select(*keys, clean_ocr(F.col(text_col)).alias("_clean")).select(*keys, F.explode(every).alias("x")).select(*keys, "x.*")
    return first_wins(found, [*keys, "type", "size", "material", "id"], ["kind", "hit"]).drop("kind", "hit").withColumn("confidence", F.lit("low"))


_QUANTITY = r"\b(\d{1,7}(?:,\d{3})*(?:\.\d+)?)\b"
_UNIT = r"(?i)\b(" + "|".join(UNITS) + r")\b"


def nearby_items(lines: DataFrame, keys: list[str]) -> DataFrame:
    """For lines (keys, line_no, line, code) with a code: the largest number and the first unit from two lines before to
    three after; the line without code, numbers and units is the description. Confidence .75."""
    from pyspark.sql import Window

    around = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(-2, 3)
    context = F.array_join(F.collect_list("line").over(around), "\n")
    c = lines.withColumn("_context", context).filter(F.col("code").isNotNull())
    numbers = F.transform(F.regexp_extract_all("_context", F.lit(_QUANTITY), F.lit(1)), lambda q: parse_number(q))
    bare = F.regexp_replace(F.regexp_replace(F.replace("line", "code", F.lit("")), _QUANTITY, ""), _UNIT, "")
    out = c.select(*keys, "line_no", F.col("code").alias("pay_item_no"), none_if_empty(strip(F.regexp_replace(bare, r"\s+", " "))).alias("description"), F.array_max(numbers).alias("quantity"), F.upper(F.get(F.regexp_extract_all("_context", F.lit(_UNIT), F.lit(1)), F.lit(0))).alias("unit"), F.lit(0.75).alias("confidence"))
    return out.filter("description is not null and quantity is not null and unit is not null")


def code_lines(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Lines that aren't blank, with the first code in them."""
    kept = F.filter(F.transform(F.split(text_col, "\n"), strip), lambda x: x != "")
    return pages.select(*keys, F.posexplode(kept).alias("line_no", "line")).withColumn("code", none_if_empty(F.regexp_extract("line", CODE, 1)))
